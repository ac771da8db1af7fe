"""Side-by-side check of the registered queries against their SQL in DuckDB."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def _key(row):
    return tuple(_cell(v) for v in row)


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when both sides hold the same columns, types and rows."""
    columns = sorted(spark_df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != columns:
        return [f"columns {columns} != {sorted(rel.columns)}"]
    out = []
    kinds = dict(zip(rel.columns, [str(t) for t in rel.types], strict=True))
    families = {
        "int": {"INTEGER", "BIGINT", "SMALLINT", "TINYINT", "HUGEINT"}, "bigint": {"BIGINT", "HUGEINT", "INTEGER"},
        "double": {"DOUBLE", "FLOAT"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"},
    }
    for field in spark_df.schema:
        want = families.get(field.dataType.simpleString(), set())
        if kinds[field.name] not in want:
            out.append(f"type of {field.name}: {field.dataType.simpleString()} vs {kinds[field.name]}")
    ours = sorted(map(_key, spark_df.select(*[f"`{c}`" for c in columns]).collect()))
    names = ", ".join('"' + c + '"' for c in columns)
    theirs = sorted(map(_key, con.sql(f"SELECT {names} FROM ({sql}) q").fetchall()))
    if len(ours) != len(theirs):
        out.append(f"rows {len(ours)} != {len(theirs)}")
    bad = [(a, b) for a, b in zip(ours, theirs, strict=False) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ in {columns}, first {bad[:2]}")
    return out


if __name__ == "__main__":
    from conftest import make_session

    from skylag.plans.catalog import QUERIES
    from skylag.plans.oracles import ORACLES

    sf = sys.argv[1]
    names = sys.argv[2:] or list(QUERIES)
    session = make_session()
    con = connect(sf)
    failed = []
    for name in names:
        began = time.time()
        try:
            df = QUERIES[name](session, sf)
            if name in ORACLES:
                diff = differences(df, con, ORACLES[name])
            else:
                diff = [] if df.count() else ["no rows"]
        except Exception as exc:  # report and go on
            diff = [f"{type(exc).__name__}: {str(exc)[:1500]}"]
        print(f"{name:32s} {time.time() - began:6.1f}s {'ok' if not diff else 'FAIL ' + '; '.join(diff)}", flush=True)
        failed += [name] if diff else []
    print(f"{len(names) - len(failed)}/{len(names)} equal; failed: {failed}")
