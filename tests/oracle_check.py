"""Run registered queries beside their checking SQL: python tests/oracle_check.py [sf] [names...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


SAME = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
        "FLOAT": "float", "TIMESTAMP": "timestamp_ntz", "DATE": "date"}


def shared(con, text: str) -> str:
    """Build the common tables of a text once per connection and return its final SELECT."""
    if not hasattr(text, "order"):
        return text
    from shelfspark.plans.registered.base import CTES

    have = {r[0] for r in con.execute("SELECT table_name FROM duckdb_tables()").fetchall()}
    for name in text.order:
        if name not in have:
            con.execute(f"CREATE TEMP TABLE {name} AS {CTES[name][0]}")
    return text.final


def canon(row):
    return tuple("NaN" if isinstance(v, float) and math.isnan(v) else v for v in row)


def compare(df, con, text: str) -> str:
    """Empty when rows, names, types and values agree."""
    rel = con.execute(shared(con, text))
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    cols = sorted(df.columns)
    if cols != sorted(names):
        return f"columns {cols} vs {sorted(names)}"
    got_types = dict(df.dtypes)
    bad = {c: (got_types[c], types[c]) for c in cols if SAME.get(types[c], types[c].lower()) != got_types[c]}
    got = sorted((canon(tuple(r[c] for c in cols)) for r in df.collect()), key=repr)
    idx = [names.index(c) for c in cols]
    exp = sorted((canon(tuple(r[i] for i in idx)) for r in want), key=repr)
    msg = f"types {bad} " if bad else ""
    if len(got) != len(exp):
        msg += f"rows {len(got)} vs {len(exp)} "
    if got != exp:
        a, b = set(got), set(exp)
        msg += f"values: {len(a - b)} only spark e.g. {sorted(a - b, key=repr)[:2]} | {len(b - a)} only sql e.g. {sorted(b - a, key=repr)[:2]}"
    return msg


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as entry

    from shelfspark.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                               "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    todo = sys.argv[2:] or list(entry.queries())
    failed = []
    for name in todo:
        t = time.time()
        try:
            df = entry.queries()[name](spark, sf)
            text = {**entry.ORACLES, **entry.LLM_ORACLES}.get(name)
            if text is None:
                n = df.count()
                print(f"rows {name} {n} {time.time() - t:.1f}s", flush=True)
                continue
            msg = compare(df, con, text)
        except Exception as exc:
            msg = f"{type(exc).__name__}: {str(exc)[:700]}"
        print(f"{'FAIL' if msg else 'ok  '} {name} {time.time() - t:.1f}s {msg[:1100]}", flush=True)
        if msg:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
