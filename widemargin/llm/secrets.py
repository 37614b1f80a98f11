"""Secret scan with corpus-wide ownership frequency.

Base kinds (assign, access, hex) are patterns with a length check.  Besides,
``opaque`` candidates are collected: long words that mix letters and digits.  For
every candidate value the distinct owners and repositories that hold it are
counted over the whole corpus.  What many owners hold is a copied example; what
few hold is owner-specific and looks live.  Opaque candidates that look live and
have the entropy of a random string become spans too; base spans always stay.

Owners and repositories are columns.  Counting goes by (value, owner, repository)
first, combined before the shuffle, so a value in a third of all texts is counted
like any other.

Null texts are empty; null owners are an owner.  Rows that repeat id and text share
results.  Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, functions as F

from widemargin.llm.common import row_key, small_batches, staged

#: Fixed order of the kinds.
KINDS = ("assign", "access", "hex", "opaque")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_KEYWORDS = ("passw", "secret", "token", "api")
_SCHEMA = "doc_id long, key long, owner string, repo string, found array<struct<start:int,kind:int,end:int,value:string,entropy:double>>"


def _entropy(value: str) -> float:
    """Bits per character."""
    from collections import Counter
    from math import log2
    return -sum(n / len(value) * log2(n / len(value)) for n in Counter(value).values())


def candidates(text: str) -> list[tuple]:
    """(start, kind number, end, value, entropy), sorted; opaque ones overlap no base span."""
    found = []
    if "=" in text or ":" in text:
        lower = text.lower()
        if any(k in lower for k in _KEYWORDS):
            found += [(m.start(), 0, m.end(), m.group(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.group()) for m in _ACCESS.finditer(text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end(), m.group()) for m in _HEX.finditer(text)]
    taken = sorted((s, e) for s, _, e, _ in found)
    at = upto = 0
    for m in _OPAQUE.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            upto, at = max(upto, taken[at][1]), at + 1
        value = m.group()
        if upto <= m.start() and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            found.append((m.start(), 3, m.end(), value))
    return sorted((*f, _entropy(f[3])) for f in found)


def _scan(batches):
    import pyarrow as pa
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("entropy", pa.float64())]))
    names = ("start", "kind", "end", "value", "entropy")
    for batch in batches:
        found = [[dict(zip(names, c)) for c in candidates(t)] if t else [] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "key", "owner", "repo")], pa.array(found, kind)],
                                         ["doc_id", "key", "owner", "repo", "found"])


def ownership(found: DataFrame) -> DataFrame:
    """(digest, n_found, n_repos, n_owners) of every candidate value: how often it is found, in how many repositories, of how many owners."""
    each = found.select("owner", "repo", F.explode("found").alias("c")).select(
        "owner", "repo", F.sha2("c.value", 256).alias("digest"))
    by_repo = each.groupBy("digest", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("digest", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("digest").agg(F.sum("n").alias("n_found"), F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def find_secrets(documents: DataFrame, owner: Column, repo: Column, most_owners: int = 2, entropy: float = 3.0) -> DataFrame:
    """(doc_id, spans) per row of ``documents`` (doc_id, text, ...): spans hold (start, kind, end, live, n_owners), sorted.

    A value is live when ``most_owners`` owners at most hold it and it has
    ``entropy`` bits per character.  Opaque candidates that aren't live are left out.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), owner.cast("string").alias("owner"),
                            repo.cast("string").alias("repo"), "text")
    found = staged(docs.mapInArrow(_scan, _SCHEMA))
    counts = ownership(found)
    # rows that repeat id and text: their candidates once
    each = (found.where(F.size("found") > 0).select("key", "found").dropDuplicates(["key"])
            .select("key", F.explode("found").alias("c")).withColumn("digest", F.sha2("c.value", 256)))
    live = (F.col("n_owners") <= most_owners) & (F.col("c.entropy") >= entropy)
    judged = each.join(counts, "digest").withColumn("live", live).where(F.col("live") | (F.col("c.kind") < len(KINDS) - 1))
    spans = judged.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(
        F.col("c.start").alias("start"), F.col("c.kind").alias("kind"), F.col("c.end").alias("end"), "live", "n_owners"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean,n_owners:bigint>>")
    return found.select("doc_id", "key").join(spans, "key", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(documents: DataFrame, owner: Column, repo: Column, **options) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_opaque, n_live, base_sha256, spans)."""
    found = find_secrets(documents, owner, repo, **options)
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS) - 1)
    return found.select("doc_id", *[of(k) for k in range(len(KINDS))], F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
                        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def fingerprint(value: str) -> str:
    """Digest under which ``ownership`` lists a value."""
    return hashlib.sha256(value.encode()).hexdigest()
