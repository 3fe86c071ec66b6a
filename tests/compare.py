"""Comparison of a Spark result with its SQL twin, order aside."""

from __future__ import annotations

import math

import duckdb
import pyarrow as pa

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value) if abs(value) < 2**53 else value
    return value


def _rows(table: pa.Table) -> tuple[list[str], list[tuple]]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    rows = [tuple(_plain(v) for v in row) for row in zip(*columns)]
    return names, sorted(rows, key=repr)


def difference(spark_frame, sql: str, folder: str) -> str | None:
    """None when both give the same rows, else what differs."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    wanted_names, wanted = _rows(con.execute(sql).to_arrow_table())
    got_names, got = _rows(spark_frame.toArrow())
    if wanted_names != got_names:
        return f"columns {got_names} instead of {wanted_names}"
    if wanted == got:
        return None
    missing, extra = set(wanted) - set(got), set(got) - set(wanted)
    show = lambda rows: [str(r)[:400] for r in sorted(rows, key=repr)[:3]]
    return f"{len(got)} rows instead of {len(wanted)}; missing {len(missing)} {show(missing)}; extra {len(extra)} {show(extra)}"
