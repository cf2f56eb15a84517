"""Tables in a folder that change all at once or not at all.

Data files are written first, under a name of their own. Then a manifest with the next number is put in place by a rename that
fails if that number is taken, so of two writers that began at the same version one finds out, reads again and decides
anew. Readers follow the newest manifest: what was written without one is never seen. The rename is as atomic as the file system's;
where a local folder's is not, a lock keeps the writers of this process apart.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.shared import cut, join_counted

LOG = "_log"
#: Changes that are kept beside the rows they change before both are written anew.
MOST_CHANGES = 20
TRIES = 20
_LOCK = threading.Lock()


class Conflict(RuntimeError):
    """Others were faster each time."""


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, name: str):
    p = _path(spark, name)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, folder: str) -> list[int]:
    fs, p = _files(spark, f"{folder}/{LOG}")
    return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, dict]:
    """(version, manifest) of the newest or a given version; (-1, {}) if nothing was published."""
    if version is None:
        version = max(versions(spark, folder), default=-1)
    if version < 0:
        return -1, {}
    fs, p = _files(spark, f"{folder}/{LOG}/{version:020d}.json")
    stream = fs.open(p)
    try:
        return version, json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def publish(spark: SparkSession, folder: str, version: int, content: dict) -> bool:
    """Put a manifest in place as ``version``; False if there is one already."""
    fs, temporary = _files(spark, f"{folder}/{LOG}/.{uuid.uuid4().hex}")
    stream = fs.create(temporary)
    stream.write(json.dumps(content).encode())
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    target = _path(spark, f"{folder}/{LOG}/{version:020d}.json")
    try:
        with _LOCK:
            context.rename(temporary, target, none)
        return True
    except Py4JJavaError as e:
        fs.delete(temporary, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise


def _written(df: DataFrame, folder: str, name: str) -> str:
    place = f"data/{uuid.uuid4().hex}/{name}"
    df.write.parquet(f"{folder}/{place}")
    return place


def write_tables(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame], replace: bool = False) -> int:
    """Add rows to several tables of a folder, or replace them, in one step that readers see whole; gives the version.

    If any table can't be written, nothing is published and readers keep the old ones. Rows that others publish meanwhile stay,
    but for tables that are replaced.
    """
    places = {name: _written(df, folder, name) for name, df in tables.items()}
    for _ in range(TRIES):
        version, old = manifest(spark, folder)
        now = dict(old.get("tables", {}))
        for name, place in places.items():
            now[name] = [*([] if replace else now.get(name, [])), place]
        if publish(spark, folder, version + 1, old | {"tables": now}):
            return version + 1
    raise Conflict(f"{folder}: {TRIES} tries")


def read_table(spark: SparkSession, folder: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the newest, or a given, version; columns that some writes lack are null there."""
    _, found = manifest(spark, folder, version)
    places = found.get("tables", {}).get(name)
    if not places:
        raise KeyError(f"{folder} has no table {name}")
    return spark.read.option("mergeSchema", True).parquet(*[f"{folder}/{p}" for p in places])


def begin(rows: DataFrame, folder: str) -> None:
    """Publish rows, whose ids differ, as a table that ``transact`` changes."""
    if not publish(rows.sparkSession, folder, 0, {"rows": _written(rows, folder, "rows"), "changes": []}):
        raise Conflict(f"{folder} is there already")


def current(spark: SparkSession, folder: str, key: str = "id", version: int | None = None) -> DataFrame:
    """The rows after all changes up to the newest, or a given, version."""
    return _state(spark, folder, key, manifest(spark, folder, version)[1])


def _state(spark: SparkSession, folder: str, key: str, found: dict) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{found['rows']}")
    if not found["changes"]:
        return rows
    parts = [spark.read.schema(rows.schema).parquet(f"{folder}/{p}").withColumn("at_change", F.lit(k)) for k, p in enumerate(found["changes"])]
    changes = parts[0]
    for p in parts[1:]:
        changes = changes.unionByName(p)
    newest = changes.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "at_change").alias("row")).select("row.*")
    return join_counted(rows, newest.select(key), key, "left_anti").unionByName(newest)


def transact(spark: SparkSession, folder: str, change: Callable[[DataFrame], DataFrame], key: str = "id", tries: int = TRIES) -> DataFrame:
    """Replace the rows that ``change`` gives, of the rows there are, in one step; gives them as they were written.

    ``change`` gets the current rows and returns the new ones of some keys, which must differ. If others publish in between, it is
    asked again with what is there then. After MOST_CHANGES changes all rows are written anew.
    """
    for _ in range(tries):
        version, found = manifest(spark, folder)
        if version < 0:
            raise KeyError(f"{folder} has no table")
        rows = _state(spark, folder, key, found)
        place = _written(change(rows).select(rows.columns), folder, "change")
        new = found | {"changes": [*found["changes"], place]}
        if len(new["changes"]) > MOST_CHANGES:
            new |= {"rows": _written(_state(spark, folder, key, new), folder, "rows"), "changes": []}
        if publish(spark, folder, version + 1, new):
            return spark.read.schema(rows.schema).parquet(f"{folder}/{place}")
    raise Conflict(f"{folder}: {tries} tries")


def scan_tables(scan: DataFrame, entities: Mapping[str, tuple[str, list[str]]], links: Mapping[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """Tables of several entities and links out of one scan's rows, which are computed once.

    ``entities`` is name -> (key column, other columns): one row for each key, with the smallest of each other column's values.
    ``links`` is name -> (column, column): the different pairs as (src, dst). Null keys and ends are left out.
    """
    rows = cut(scan)
    out = {}
    for name, (key, columns) in entities.items():
        known = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id"))
        out[name] = known.agg(*[F.min(c).alias(c) for c in columns]) if columns else known.agg(F.count("*").alias("n"))
    for name, (a, b) in links.items():
        out[name] = rows.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src is not null and dst is not null").distinct()
    return out
