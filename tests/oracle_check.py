"""Run registered queries beside their reference SQL and compare all values.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.6f}"
    return str(value)


def compare(df, con, sql):
    """None when the two results hold the same rows, else a short description."""
    got_cols = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in got_cols) for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != got_cols:
        return f"columns {got_cols} against {sorted(names)}"
    order = [names.index(c) for c in got_cols]
    want = sorted(tuple(_plain(r[i]) for i in order) for r in result.fetchall())
    if got == want:
        return None
    only_got, only_want = set(got) - set(want), set(want) - set(got)
    return (f"{len(got)} rows against {len(want)}; only here {sorted(only_got)[:3]}; "
            f"only there {sorted(only_want)[:3]}")


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import make_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = make_session(), connect(sf_dir)
    sql, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sql:
                problem = compare(df, con, sql[name])
            else:
                rows = df.collect()
                problem, shown = None, [r.asDict() for r in rows[:2]]
                print(f"     {name}: {len(rows)} rows, {shown}")
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        spark.catalog.clearCache()
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:6.2f}s {'sql' if name in sql else '-  '} {name} {problem or ''}",
              flush=True)
    print(f"{bad} problems")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
