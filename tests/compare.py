"""Run registered queries against their SQL in DuckDB: python tests/compare.py [folder] [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def normal(value):
    if value is None:
        return ("null",)
    if isinstance(value, float):
        return ("null",) if math.isnan(value) else ("f", 0.0 if value == 0 else value)
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return ("l", tuple(normal(v) for v in value))
    if isinstance(value, dict):
        return ("d", tuple((k, normal(v)) for k, v in sorted(value.items())))
    return (type(value).__name__, value)


def rows_of(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, sorted(tuple(normal(v) for v in row) for row in zip(*columns))


def compare(spark, con, fn, sql, folder):
    ours = fn(spark, folder).toArrow()
    names, rows = rows_of(ours)
    if sql is None:
        return f"rows={len(rows)} (no SQL)"
    theirs = con.execute(sql).to_arrow_table()
    other_names, other_rows = rows_of(theirs)
    assert names == other_names, (names, other_names)
    kinds = {n: (str(ours.schema.field(n).type), str(theirs.schema.field(n).type)) for n in names}
    assert len(rows) == len(other_rows), (len(rows), len(other_rows))
    wrong = [(a, b) for a, b in zip(rows, other_rows) if a != b]
    assert not wrong, (len(wrong), names, wrong[:2])
    odd = {n: k for n, k in kinds.items() if k[0].replace("large_", "") != k[1].replace("large_", "")}
    return f"rows={len(rows)}" + (f" types differ: {odd}" if odd else "")


def connect(folder):
    import duckdb
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    from stratafold.plans.registry import PLANS
    from stratafold.session import build_session
    extra = {k[5:]: v for k, v in os.environ.items() if k.startswith("CONF_")}
    spark = build_session(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", **extra})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, (fn, sql) in PLANS.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            text = compare(spark, con, fn, sql, folder)
        except Exception as error:  # noqa: BLE001
            bad += 1
            text = "FAIL " + str(error)[:900]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(f"{name:28s} {time.time() - start:6.2f}s {text}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
