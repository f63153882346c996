"""Helpers shared by the training-data operators: words, working tables and session settings."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A word is a run of anything but the ASCII white space below.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Rows in one Arrow batch; with a mean text of a few kB a batch stays in the low megabytes.
BATCH_ROWS = 512
#: Bits of the filter that `perhaps_among` broadcasts (4 MB at most, whatever the input). Results do not depend on it.
FILTER_BITS = 1 << 25


def prepared(spark: SparkSession) -> SparkSession:
    """Settings that the operators rely on; smaller batches set by the caller are kept."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    # A union of differently partitioned parts must not be taken for one partitioning (it fails at run time when parts are coalesced).
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) not in range(1, BATCH_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a fresh one only where it is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="proofmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def working_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/proofmill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: the lineage ends there, and a lost executor loses nothing."""
    path = working_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def perhaps_among(rows: DataFrame, column: str, known: DataFrame, known_column: str, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose value may be among the known ones, so that the exact join after it shuffles few others.

    A Bloom filter with one hash: bitmaps of a fixed total size are broadcast.  A row that has a partner always stays, some others do
    (the more, the more values are known); rows without a value go.
    """
    slot = lambda value: F.pmod(F.xxhash64(value), F.lit(bits))
    at = slot(F.col(known_column))
    maps = known.where(F.col(known_column).isNotNull()).groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    near = rows.where(F.col(column).isNotNull()).withColumn("_slot", slot(F.col(column)))
    met = near.join(F.broadcast(maps), F.bitmap_bucket_number("_slot") == F.col("_bucket"))
    spot = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, (spot % 8).cast("int")) == 1).select(*rows.columns)


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, wherever the optimizer moves the expression (an alias may be copied into each of its uses)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def computed(docs: DataFrame, source: str, into: str, kind: str | T.DataType, make) -> DataFrame:
    """docs with the column `into` computed from the column `source`; a column of that name is replaced in its place.

    make() is called once a task and gives a function from a list of values to as many new values.  All other columns stay in Arrow, so
    integers beside nulls keep their value.
    """
    kind = T.StructType.fromDDL(f"x {kind}")[0].dataType if isinstance(kind, str) else kind
    field = T.StructField(into, kind)
    schema = T.StructType([field if f.name == into else f for f in docs.schema.fields] if into in docs.columns else [*docs.schema.fields, field])
    made = to_arrow_type(kind)

    def run(batches):
        work = make()
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            columns[into] = pa.array(work(columns[source].to_pylist()), made)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, schema)


def text_or_empty(value) -> str:
    """A nullable text cell of a pandas batch."""
    return value if isinstance(value, str) else ""
