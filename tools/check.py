"""Compare catalogue queries with their oracles: python check.py [name ...] (SF_DIR, default sf0.01)."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(frame) -> list[tuple]:
    def value(v):
        if v is None or type(v).__name__ in ("NaTType", "NAType") or v != v:
            return "NULL"
        kind = type(v).__name__
        if kind in ("bool", "bool_"):
            return str(bool(v))
        if kind.startswith("float"):
            return repr(float(v))
        if kind.startswith("int"):
            return repr(int(v))
        if kind in ("date", "Timestamp", "datetime", "datetime64"):
            return str(v)[:19].replace(" 00:00:00", "")
        return str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(value(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


def compare(spark, con, query, sf_dir: str) -> str:
    start = time.time()
    got = query.run(spark, sf_dir).toPandas()
    spent = time.time() - start
    if query.sql is None:
        return f"rows {len(got)} ({spent:.1f}s)" + (" EMPTY" if len(got) == 0 else "")
    start = time.time()
    want = con.execute(query.sql).fetchdf()
    spent_sql = time.time() - start
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    note = " EMPTY" if not a else ""
    if a == b:
        return f"ok {len(a)} ({spent:.1f}s, sql {spent_sql:.1f}s){note}"
    left, right = set(a), set(b)
    extra = [r for r in a if r not in right][:3]
    missing = [r for r in b if r not in left][:3]
    return f"MISMATCH spark={len(a)} oracle={len(b)} cols={sorted(got.columns)}\n   spark  {extra}\n   oracle {missing}"


def main(names: list[str]) -> int:
    from chronopanel.plans import load
    from chronopanel.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf_dir)
    catalogue = load()
    import importlib
    chosen = [q for q in catalogue.values() if not names or q.name in names or any(
        q.run.__module__ and n.startswith("@") and n[1:] in q.ids for n in names)]
    bad = 0
    for q in chosen:
        try:
            verdict = compare(spark, con, q, sf_dir)
        except Exception as error:  # report and go on
            verdict = "ERROR " + str(error)[:int(os.environ.get("ERR", "700"))]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        good = verdict.startswith(("ok", "rows")) and "EMPTY" not in verdict
        bad += not good
        if not good or not os.environ.get("QUIET"):
            print(f"{q.name}: {verdict}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
