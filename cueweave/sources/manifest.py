"""Which folders a table consists of: new data first, then one atomic rename.

`<table>/data/<run>/…` holds what a run wrote and never changes. `<table>/manifest/<n>.json`
maps names (partitions, formats) to such folders; the highest number is the
table. A writer fills a new run folder and renames a finished manifest to the
next number, which succeeds for one of two rivals only. Whatever fails before leaves
the old table, and readers of an older manifest keep its files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer published first; read again and repeat."""


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def new_run(path: str) -> str:
    """Name of a folder for the data of one run."""
    return f"data/run-{uuid.uuid4().hex}"


def version(spark: SparkSession, path: str) -> int:
    """Number of the manifest in force; 0 if there is none."""
    folder, fs = _fs(spark, f"{path}/manifest")
    if not fs.exists(folder):
        return 0
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)


def read(spark: SparkSession, path: str, number: int | None = None) -> dict[str, str]:
    """Name → folder (below `path`) of the manifest in force, or of the given one."""
    number = version(spark, path) if number is None else number
    if number == 0:
        return {}
    target, fs = _fs(spark, f"{path}/manifest/{number}.json")
    stream = fs.open(target)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, folders: dict[str, str], after: int) -> int:
    """Make `folders` the table, as the manifest that follows number `after`."""
    draft, fs = _fs(spark, f"{path}/manifest/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    try:
        out.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
    finally:
        out.close()
    target, _ = _fs(spark, f"{path}/manifest/{after + 1}.json")
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise Conflict(f"manifest {after + 1} of {path} exists")
    return after + 1
