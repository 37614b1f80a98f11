"""Personal data: base patterns, and terms that reveal them by corpus co-occurrence.

The base kinds (email, ip, card, phone) are patterns with a check each.  Their
values are the protected entities.  A term anywhere in a document of an entity, but
in no base span, discloses it as far as knowing the term tells of the entity:

    disclosure = log(N * c(entity, term) / (c(entity) * c(term))) / log(N / c(entity))

with document counts over the whole corpus; 1 means that the term occurs only
beside the entity.  Terms of at least ``support`` common documents are removed at
``remove`` and generalised to their kind of word at ``generalise``, wherever they
occur in a document that holds the entity.

Only DataFrame expressions are used.  The patterns are written so that Java's
matcher is linear: possessive repeats, and starts inside a run that can't match
are skipped.  Null texts are empty.  Rows that repeat id and text share results.
Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from widemargin.llm.common import marked, row_key, staged

#: Fixed order of the kinds; ``term`` is what the co-occurrence adds.
KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "[A-Za-z0-9._%+-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_PATTERNS = {
    # a start inside a run of these characters matches only right behind another match
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_TERM = r"\p{L}{3,}+"
_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _matches(text: Column, pattern: str, keep=None) -> Column:
    """array<struct<start,end,value>> of the leftmost non-overlapping matches, or of those whose value ``keep`` accepts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.arrays_zip(found.alias("value"), F.slice(between, 1, F.size(found)).alias("gap"))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        out = F.concat(acc["out"], F.array(F.struct(
            start.cast("int").alias("start"), end.cast("int").alias("end"), x["value"].alias("value"))))
        out = out if keep is None else F.when(keep(x["value"]), out).otherwise(acc["out"])
        return F.struct(end.cast("int").alias("at"), out.alias("out"))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(F.size(found) > 0, F.aggregate(zipped, state, step, lambda acc: acc["out"])).otherwise(none)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z")
    if kind == "card":
        digits = F.regexp_replace(value, "[^0-9]", "")
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _checked(text: Column, kind: str, number: int) -> Column:
    """Matches of a base kind that pass its check."""
    valid = F.filter(_matches(text, _PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    return F.transform(valid, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"),
                                                 s["end"].alias("end"), s["value"].alias("value")))


def _entity(kind: Column, value: Column) -> Column:
    """Protected entity: its kind and its value without layout."""
    plain = F.when(kind == 0, F.lower(value)).when(kind == 1, value).otherwise(F.regexp_replace(value, "[^0-9]", ""))
    return F.concat_ws(":", kind.cast("string"), plain)


def base_spans(documents: DataFrame) -> DataFrame:
    """``documents`` with _spans: (start, kind number, end, value) of the base kinds, in order."""
    df = documents.withColumn("_text", F.coalesce("text", F.lit("")))
    none = F.array().cast(_SPANS)
    for number, kind in enumerate(KINDS[:-1]):
        # a digit run of the least length, in the only text that can match
        may = F.col("_text").contains(_NEEDS[kind]) if kind != "card" else F.col("_text").rlike("[0-9][0-9 -]{12}")
        found = _checked(F.col("_text"), kind, number)
        df = df.withColumn(f"_{kind}", F.when(may, found.cast(_SPANS)).otherwise(none))
    spans = F.sort_array(F.concat(*[F.col(f"_{k}") for k in KINDS[:-1]]))
    return df.withColumn("_spans", spans).drop("_text", *[f"_{k}" for k in KINDS[:-1]])


def _pairs(seen: DataFrame) -> DataFrame:
    """(key, entity, term): each term outside the base spans of a document, with each entity of it."""
    # copies of a row share their key and count once
    held = seen.where(F.size("_spans") > 0).dropDuplicates(["key"])
    state = F.struct(F.lit(0).alias("upto"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        piece = F.substring(F.col("text"), acc["upto"] + 1, F.greatest(s["start"] - acc["upto"], F.lit(0)))
        return F.struct(F.greatest(s["end"], acc["upto"]).alias("upto"), F.concat(acc["out"], F.array(piece)).alias("out"))

    outside = F.aggregate("_spans", state, step, lambda acc: F.array_join(F.concat(
        acc["out"], F.array(F.substring(F.col("text"), acc["upto"] + 1, F.length("text")))), " "))
    entities = F.array_distinct(F.transform("_spans", lambda s: _entity(s["kind"], s["value"])))
    each = held.select("key", entities.alias("entities"), F.explode(_words(outside)).alias("term"))
    return each.select("key", F.explode("entities").alias("entity"), "term")


def _words(text: Column) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), F.lower))


def disclosures(documents: DataFrame, seen: DataFrame, support: int, generalise: float) -> DataFrame:
    """(entity, term, disclosure) of the terms that reveal an entity; counts are documents of the corpus."""
    total = documents.count()
    held = seen.where(F.size("_spans") > 0).select("key", F.explode("_spans").alias("s"))
    entities = (held.select("key", _entity(F.col("s.kind"), F.col("s.value")).alias("entity")).distinct()
                .groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= support))
    pairs = (_pairs(seen).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"))
             .where(F.col("n_both") >= support).join(entities, "entity"))
    pairs = staged(pairs)
    # counted before the join: what a candidate term selects may be a large part of all words
    counts = documents.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    n = F.lit(float(max(total, 1)))
    # copies of a row share their key, so a count can exceed that of the keys: never below it
    n_term = F.greatest("n_term", "n_both")
    pmi = F.log(n * F.col("n_both") / (F.col("n_entity") * n_term))
    information = F.log(n / F.col("n_entity"))
    value = F.when(information > 0, pmi / information)
    return pairs.join(counts, "term").select("entity", "term", value.alias("disclosure")).where(F.col("disclosure") >= generalise)


def _occurrences(text: Column, spans: Column, terms: Column, remove: float) -> Column:
    """Every occurrence in ``text`` of one of ``terms``, (term, disclosure) each, in no base span."""
    values = F.transform(terms, lambda t: t["term"])
    words = F.filter(_matches(text, _TERM, keep=lambda value: F.array_contains(values, F.lower(value))),
                     lambda w: ~F.exists(spans, lambda s: (s["start"] < w["end"]) & (s["end"] > w["start"])))

    def span(w):
        term = F.get(terms, F.array_position(values, F.lower(w["value"])).cast("int") - 1)
        return F.struct(w["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), w["end"].alias("end"), term["term"].alias("value"),
                        F.when(term["d"] >= remove, "remove").otherwise("generalise").alias("action"))
    return F.transform(words, span)


def find_pii(documents: DataFrame, support: int = 3, generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """(doc_id, key, spans): one row per row of ``documents`` (doc_id, text, ...).

    spans holds (start, kind, end, value, action), sorted; action is ``mask`` for
    base kinds, ``generalise`` or ``remove`` for terms.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", row_key())
    found = base_spans(docs)
    seen = staged(found.select("doc_id", "key", "_spans", F.when(F.size("_spans") > 0, F.col("text")).alias("text")))
    revealing = staged(disclosures(docs, seen, support, generalise))
    terms = (_pairs(seen).join(revealing, ["entity", "term"]).groupBy("key", "term").agg(F.max("disclosure").alias("d"))
             .groupBy("key").agg(F.sort_array(F.collect_list(F.struct("term", "d"))).alias("terms")))
    full = "array<struct<start:int,kind:int,end:int,value:string,action:string>>"
    base = F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
                                                   s["value"].alias("value"), F.lit("mask").alias("action"))).cast(full)
    added = F.when(F.col("terms").isNotNull(), _occurrences(F.col("text"), F.col("_spans"), F.col("terms"), remove).cast(full))
    return seen.join(terms, "key", "left").select(
        "doc_id", "key", F.sort_array(F.concat(base, F.coalesce(added, F.array().cast(full)))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans)."""
    found = find_pii(documents, **options)
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS) - 1)
    return found.select("doc_id", *[of(k) for k in range(len(KINDS))], F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


def sanitise(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with base data masked by its kind, and revealing terms removed or generalised.

    Rows without findings stay as they are; n_chars follows the text if there is such a column.
    """
    hits = staged(find_pii(documents, **options).where(F.size("spans") > 0).dropDuplicates(["key"])
                  .select(F.col("key").alias("_key"), F.col("spans").alias("_spans")))
    given = documents.withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text")))
    touched, clean = marked(given, hits, "_key")
    touched = touched.join(hits, "_key", "left")
    label = lambda s: F.when(s["kind"] < len(KINDS) - 1, F.concat(F.lit("["), F.upper(F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)), F.lit("]"))).when(s["action"] == "remove", F.lit("")).otherwise(F.lit("[WORD]"))
    cuts = "array<struct<start:int,end:int,label:string>>"
    # what of each span lies behind the spans before it: nothing found stays visible
    state = F.struct(F.lit(0).alias("upto"), F.array().cast(cuts).alias("out"))

    def step(acc, s):
        piece = F.struct(F.greatest(s["start"], acc["upto"]).alias("start"), s["end"].alias("end"),
                         F.when(s["start"] < acc["upto"], F.lit("")).otherwise(label(s)).alias("label"))
        return F.when(s["end"] > acc["upto"], F.struct(s["end"].alias("upto"), F.concat(acc["out"], F.array(piece)).cast(cuts).alias("out"))).otherwise(acc)

    cut = F.aggregate("_spans", state, step, lambda acc: acc["out"])
    touched = touched.withColumn("_cuts", cut)
    pieces = F.transform(F.sequence(F.lit(0), F.size("_cuts")), lambda i: F.concat(
        F.when(i == 0, F.lit("")).otherwise(F.get(F.col("_cuts"), i - 1)["label"]),
        F.substring(F.col("text"), F.when(i == 0, 0).otherwise(F.get(F.col("_cuts"), i - 1)["end"]) + 1,
                    F.when(i == F.size("_cuts"), F.length("text")).otherwise(F.get(F.col("_cuts"), i)["start"])
                    - F.when(i == 0, 0).otherwise(F.get(F.col("_cuts"), i - 1)["end"]))))
    touched = touched.withColumn("text", F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(F.array_join(pieces, "")))
    if "n_chars" in documents.columns:
        touched = touched.withColumn("n_chars", F.when(F.col("_cuts").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return clean.select(documents.columns).union(touched.select(documents.columns))
