"""A table of answers by key, in which the last record of a key counts: buckets of keys, and a manifest of their files.

An upsert rewrites only the buckets that its keys fall into and then writes the next manifest, which names the files
of every bucket. A reader takes the last manifest; what a run has written that ended before its manifest is in none."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import stored

BUCKETS = 64
_BUCKET = "__bucket"


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _versions(spark: SparkSession, path: str) -> list[int]:
    system, place = _place(spark, f"{path}/manifests")
    if not system.exists(place):
        return []
    return sorted(int(f.getPath().getName()[:-5]) for f in system.listStatus(place) if f.getPath().getName().endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The manifest of a version, of the last one without it; None of a table that isn't there yet. files: for each
    bucket the version that wrote it."""
    known = _versions(spark, path)
    if not known:
        return None
    return json.loads(spark.read.text(f"{path}/manifests/{known[-1] if version is None else version:09d}.json", wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, told: dict) -> None:
    """Writes a manifest under its version's name; an error if another writer was there first."""
    system, made = _place(spark, f"{path}/manifests/.{told['version']:09d}-{spark.sparkContext.applicationId}-{id(told)}")
    out = system.create(made)
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    _, final = _place(spark, f"{path}/manifests/{told['version']:09d}.json")
    if system.exists(final) or not system.rename(made, final):
        system.delete(made, False)
        raise RuntimeError(f"{path} was changed by another writer; upsert again")


def _read(spark: SparkSession, path: str, told: dict, buckets: Iterable[str]) -> DataFrame | None:
    files = [f"{path}/data/{told['files'][b]:09d}/{_BUCKET}={b}" for b in buckets if b in told["files"]]
    return spark.read.schema(told["schema"]).parquet(*files) if files else None


def upsert(rows: DataFrame, path: str, keys: list[str], order: str | None = None, buckets: int = BUCKETS) -> int:
    """Puts rows into the table at path and gives its new version. Of the records of a key the one of the greatest
    `order` counts; of equal ones, and without an order, a new one before an old one. Nulls in keys equal nulls.

    The number of buckets, the keys and the columns are those of the first upsert. Many records of one key meet in
    partial states before they are moved; only buckets that new keys fall into are read and written again."""
    spark = rows.sparkSession
    told = manifest(spark, path)
    if told is None:
        told = {"version": -1, "buckets": buckets, "keys": keys, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "files": {}}
    if told["keys"] != keys:
        raise ValueError(f"the table's keys are {told['keys']}")
    names = [f.name for f in spark.createDataFrame([], told["schema"]).schema]
    bucket = F.pmod(F.xxhash64(*[F.struct(F.col(f"`{k}`")) for k in keys]), F.lit(told["buckets"])).cast("int")

    def last(df: DataFrame, *order_by: Column) -> DataFrame:
        whole = F.struct(*[F.col(f"`{c}`") for c in names])
        best = df.groupBy(_BUCKET, *[F.col(f"`{k}`") for k in keys]).agg(F.max_by(F.struct(whole.alias("r"), F.col("__new")), F.struct(*order_by, F.col("__new"), F.to_json(whole))).alias("m"))
        return best.select(_BUCKET, "m.r.*", "m.__new")

    by = [F.col(f"`{order}`")] if order else []
    new = stored(last(rows.select(names).withColumns({_BUCKET: bucket, "__new": F.lit(1)}), *by))
    touched = sorted(str(r[0]) for r in new.select(_BUCKET).distinct().collect())  # a row a bucket
    if not touched:
        return told["version"]
    old = _read(spark, path, told, touched)
    both = new if old is None else last(new.unionByName(old.withColumns({_BUCKET: bucket, "__new": F.lit(0)})), *by)
    version = told["version"] + 1
    both.drop("__new").repartition(len(touched), _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{path}/data/{version:09d}")
    _publish(spark, path, told | {"version": version, "files": told["files"] | {b: version for b in touched}})
    return version


def upserted(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table at path, of the last version or of one that is still there."""
    told = manifest(spark, path, version)
    if told is None:
        raise ValueError(f"no table in {path}")
    rows = _read(spark, path, told, told["files"])
    return rows if rows is not None else spark.createDataFrame([], told["schema"])


def not_there(rows: DataFrame, path: str) -> DataFrame:
    """Rows whose key the table doesn't have; all of them where there is no table yet. Nulls in keys equal nulls."""
    spark = rows.sparkSession
    told = manifest(spark, path)
    if told is None:
        return rows
    there = upserted(spark, path).select(*[F.col(f"`{k}`").alias(f"__there{i}") for i, k in enumerate(told["keys"])])
    same = F.lit(True)
    for i, k in enumerate(told["keys"]):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__there{i}"))
    return rows.join(there, same, "left_anti")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Takes away the manifests before the last `keep`, and what no manifest left names; the versions taken away. Not
    while a writer is at work."""
    known = _versions(spark, path)
    kept = [manifest(spark, path, v) for v in known[-keep:]]
    used = {(v, b) for told in kept for b, v in told["files"].items()}
    for v in known[:-keep]:
        system, place = _place(spark, f"{path}/manifests/{v:09d}.json")
        system.delete(place, False)
    system, data = _place(spark, f"{path}/data")
    for folder in system.listStatus(data):
        v = int(folder.getPath().getName())
        for part in system.listStatus(folder.getPath()):
            name = part.getPath().getName()
            if name.startswith(f"{_BUCKET}=") and (v, name.partition("=")[2]) not in used:
                system.delete(part.getPath(), True)
        if not any(v == u for u, _ in used):
            system.delete(folder.getPath(), True)
    return known[:-keep]
