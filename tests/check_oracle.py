"""Compare registered queries with their SQL twins: ``python tests/check_oracle.py SF_DIR [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from promptmill.plans.inputs import TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> tuple[bool, str]:
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rows_of(cols, rel.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w][:1]
        return False, f"{len(got)} vs {len(want)} rows; first difference: {str(diff)[:600]}"
    return True, f"{len(got)} rows"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from promptmill.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad, oracles = connect(sf_dir), 0, oracle_sql()
    for name, fn in queries().items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            if name in oracles:
                ok, note = compare(fn(spark, sf_dir), con, oracles[name])
            else:
                ok, note = True, f"{len(fn(spark, sf_dir).collect())} rows, no SQL twin"
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} [{time.time() - t0:.1f}s] {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
