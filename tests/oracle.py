"""Run registered queries in Spark and their SQL in DuckDB and compare."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}" if v != int(v or 0) or abs(v) > 1e15 else str(int(v))
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in sorted(v.items(), key=lambda kv: str(kv[0]))) + "}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    if v.__class__.__name__ == "Decimal":
        return canon(float(v))
    return str(v)


def compare(spark, con, name, build, sql, sf_dir):
    t = time.time()
    df = build(spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted([tuple(canon(r[c]) for c in cols) for r in df.collect()])
    took = time.time() - t
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    if sql is None:
        return f"rows-only {len(rows)} rows {took:.1f}s", bool(rows)
    t = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    if sorted(names) != cols:
        return f"COLUMNS spark={cols} sql={sorted(names)}", False
    pos = [names.index(c) for c in cols]
    took = f"{took:.1f}s/{time.time() - t:.1f}"
    want = sorted([tuple(canon(r[i]) for i in pos) for r in cur.fetchall()])
    odd = [c for c in cols if not _same_kind(kinds[c], types[c])]
    if odd:
        return f"TYPES {[(c, kinds[c], types[c]) for c in odd]}", False
    if len(want) != len(rows):
        return f"COUNT spark={len(rows)} sql={len(want)}\n  {rows[:3]}\n  {want[:3]}", False
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    if bad:
        have, wanted = set(rows), set(want)
        only_a = [r for r in rows if r not in wanted][:3]
        only_b = [r for r in want if r not in have][:3]
        return f"VALUES {len(bad)}/{len(rows)} differ {cols}\n  spark {only_a}\n  sql   {only_b}", False
    return f"ok {len(rows)} rows {took}s", True


def _same_kind(a: str, b: str) -> bool:
    b = b.lower()
    if a in ("int", "bigint", "smallint", "tinyint"):
        return "int" in b and b != "hugeint" or b == "number"
    if a in ("double", "float"):
        return b in ("double", "float", "number")
    if a.startswith("decimal"):
        return b.startswith("decimal") or b == "number"
    if a == "string":
        return b in ("varchar", "string")
    if a == "boolean":
        return b.startswith("bool")
    return True


def main() -> None:
    import __spark_entry__ as entry
    from haggle.session import get_session

    sf = "/root/testdata/sf0.01"
    picks = [a for a in sys.argv[1:] if not a.startswith("--")]
    hot = None
    for a in sys.argv[1:]:
        if a.startswith("--sf="):
            sf = a[5:]
        if a.startswith("--hot="):
            hot = a[6:]
    spark = get_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    if hot:
        # groups above this many rows take the split path
        spark.conf.set("haggle.hot.rows", hot)
    con = connect(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = []
    for name, build in queries.items():
        if picks and not any(p in name for p in picks):
            continue
        try:
            msg, ok = compare(spark, con, name, build, sqls.get(name), sf)
        except Exception as e:
            msg, ok = f"ERROR {type(e).__name__} {str(e)[:400]}", False
        print(("  " if ok else "X ") + name, msg, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    spark.stop()


if __name__ == "__main__":
    main()
