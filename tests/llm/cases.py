"""Small inputs with nulls, empty and long texts, repeated rows and columns whose names clash."""

from __future__ import annotations

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, key long, hash long, fragment int, "
          "vals string, _mark long, spans string, n int, score double, places string, target double, path string, `select` string")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(40_000))


def documents(spark, texts):
    rows = [(i, t, "en", f"s{(i or 1) % 3}" if (i or 1) % 4 else None, 0, *[None] * 13) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"{rng.choice('abcdefgh')}o{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, share):
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def nasty(spark, rng, extra=()):
    """Copies, near copies, a passage in many texts, a run of one word, and the odd rows."""
    base, passage = words(rng, 120, 10**6), words(rng, 60, 10**6)
    texts = [base, base, base.upper()] + [edited(rng, base, 0.02) for _ in range(12)]
    texts += [f"{words(rng, 30)} {passage} {words(rng, 20)}" for _ in range(10)]
    texts += [" ".join(["again"] * 90), f"{passage}\n{passage}", None, "", " \t\n", "one", "one two\x0bthree", "é\x00ß 🙂 ſK", LONG, LONG + " end"]
    texts += list(extra)
    rows = list(enumerate(texts))
    rows += [rows[0], rows[20], (None, base), (None, None), (None, "no id"), (7, "another text with the id seven")]
    return documents(spark, rows)
