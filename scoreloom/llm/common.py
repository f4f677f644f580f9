"""What the operators share: table access, the shared folder, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word of a text, as all operators here see it: a run without ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"

_OWN_FOLDER: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, through Spark's own reader (any store)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where the session doesn't name one (tests on one machine) a temporary folder is made."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDER:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN_FOLDER[app] = "file://" + tempfile.mkdtemp(prefix="scoreloom-")
    return _OWN_FOLDER[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """df as a table written to the shared folder and read back: cuts the lineage, survives lost executors.

    options: those of the writer."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, whatever the number of uses in body.

    The lambda of a higher-order function binds it; the optimizer can't inline it again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def utf8_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and borders of an array of texts without nulls, as Arrow holds them."""
    wide = pa.types.is_large_string(texts.type)
    _, borders, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(borders, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def utf8_array(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The array of texts that has these bytes and borders."""
    if at[-1] < 1 << 31:
        return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data))


class Memo(dict):
    """make(key) of short strings, kept in two generations of at most `size` each: memory stays bounded, and what is
    used often survives when the older generation goes."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.size:
                self.older = self.copy()
                self.clear()
            self[key] = value
        return value


#: Name of the column that holds a row's hash while a sample is drawn.
_ROW = "__scoreloom_row"


def hash_sample(df: DataFrame, most: int, salt: str, by: str | None = None) -> DataFrame:
    """At most `most` rows of df (of each value of `by`): rows that are equal in all columns count as one, and of the
    distinct ones those of the smallest hash are taken. The same rows whatever the partitioning; never fewer than
    there are, up to `most`, whichever columns repeat or are null.

    An estimate of the distinct rows sets a bound on the hash that about twice as many pass, so that no task gathers
    more at any size; where it lets too few pass it is widened. by: a column of few values (a row each comes to the
    driver); rows where it is null are left out."""
    columns = df.columns
    if by:
        df = df.filter(F.col(by).isNotNull())
    rows = df.withColumn(_ROW, F.xxhash64(F.lit(salt), *[F.col(f"`{c}`") for c in columns]))
    group = [by] if by else []
    n = {tuple(r[:-1]): r[-1] for r in rows.groupBy(*group).agg(F.approx_count_distinct(_ROW)).collect()}
    share = {g: 2 * most / max(1, k) for g, k in n.items()}
    while True:
        within = F.lit(False)
        for g, part in share.items():
            mine = F.col(by) == F.lit(g[0]) if by else F.lit(True)
            within = within | (mine & (F.lit(True) if part >= 1 else F.col(_ROW) < F.lit(int(part * 2**64) - 2**63)))
        few = rows.filter(within).dropDuplicates([*group, _ROW])
        short = [g for g, part in share.items() if part < 1]
        if short:
            have = {tuple(r[:-1]): r[-1] for r in few.groupBy(*group).count().collect()}
            short = [g for g in short if have.get(g, 0) < most]
        if not short:
            break
        for g in short:
            share[g] *= 4
    if not by:
        return few.orderBy(_ROW).limit(most).select(columns)
    place = F.row_number().over(W.partitionBy(by).orderBy(_ROW))
    return few.withColumn(_ROW, place).filter(F.col(_ROW) <= most).select(columns)
