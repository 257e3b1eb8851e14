"""Compares a query with its oracle in DuckDB, as sorted rows with columns by name; python tests/oracle.py [NAME...] prints the failures."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.01"


def _plain(x):
    if x is None or isinstance(x, bool | str):
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 4) + 0.0
    if isinstance(x, list | tuple) or hasattr(x, "tolist"):
        return tuple(_plain(v) for v in list(x))
    if isinstance(x, int):
        return x
    return str(x)


def _rows(names: list[str], rows) -> tuple[list[str], list]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def differences(spark, name: str, query, sql: str, data: str = DATA) -> str | None:
    """What differs, or None."""
    df = query(spark, data)
    got = _rows(df.columns, df.collect())
    db = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    db.execute("SET TimeZone = 'UTC'")
    found = db.execute(sql)
    want = _rows([d[0] for d in found.description], found.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]}, not {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, not {len(want[1])}"
    wrong = [(a, b) for a, b in zip(got[1], want[1], strict=True) if repr(a) != repr(b)]
    return f"{len(wrong)} of {len(got[1])} rows differ: {str(wrong[0][0])[:300]}, not {str(wrong[0][1])[:300]}" if wrong else None


if __name__ == "__main__":
    import time

    sys.path.insert(0, str(Path(__file__).parent.parent))
    from conftest import session

    import __spark_entry__ as entry

    spark, sql = session(), entry.oracle_sql()
    for name, query in entry.queries().items():
        if (sys.argv[1:] and name not in sys.argv[1:]) or (not sys.argv[1:] and (name.startswith("op") or name == "pipeline")):
            continue
        began = time.time()
        try:
            wrong = differences(spark, name, query, sql[name]) if name in sql else f"(no oracle) {query(spark, DATA).count()} rows"
        except Exception as e:  # one query's failure must not hide the others'
            wrong = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name} {time.time() - began:.1f}s {wrong or 'ok'}", flush=True)
