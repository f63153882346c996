"""Writers for the tables of a run."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """A fresh folder for intermediate tables, in the folder that the driver and all executors share (spark.checkpoint.dir).

    Where it is unset, only a Spark in one process may use a folder of its own; a cluster must name one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="proofmill-")


#: Shuffle files of a write are deleted once it is done; else they would stay until the driver happens to collect what refers to them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> None:
    """df as a Parquet table at a path of the shared folder; its shuffles take no disk afterwards."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def landed(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: the lineage ends there, and a lost executor loses nothing."""
    path = f"{work_folder(df.sparkSession)}/{name}"
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deal_packs(table: DataFrame, counts: DataFrame, partition: str, packs: int = 50, rows: int = 1_000_000) -> DataFrame:
    """Rows dealt so that a task has about `packs` packs, and each pack lies in one task; one of more than `rows` rows in several.

    counts: partition, rows.  The number of tasks is named, since small tables would be coalesced into one task that writes all folders.
    """
    n, total = counts.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    large = counts.filter(F.col("rows") > rows).select(F.col(partition).alias("_pack"), F.ceil(F.col("rows") / rows).alias("_pieces"))
    hashed = F.xxhash64(*[F.col(c) for c, kind in table.dtypes if "map<" not in kind])
    dealt = table.join(F.broadcast(large), F.col(partition).eqNullSafe(F.col("_pack")), "left").withColumn("_piece", F.coalesce(F.pmod(hashed, F.col("_pieces")), F.lit(0)))
    return dealt.repartition(max(1, -(-n // packs), -(-total // rows)), partition, "_piece").select(*table.columns)


def write_pack(tables: dict[str, DataFrame], folder: str, partition: str = "pack_id") -> None:
    """One Parquet table per name, partitioned by pack, plus a one-row-per-pack manifest as JSON, written last.

    Tasks move their own files into place (commit algorithm 2), not the driver one folder after the other.
    """
    counts = None
    for name, table in tables.items():
        part = landed(table.groupBy(partition).agg(F.count("*").alias("rows")), "pack-rows")
        deal_packs(table, part, partition).write.mode("overwrite").partitionBy(partition).parquet(f"{folder}/{name}")
        part = part.withColumn("table", F.lit(name))
        counts = part if counts is None else counts.unionByName(part)
    manifest = counts.groupBy(partition).agg(F.to_json(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("table", "rows"))))).alias("tables"))
    manifest.write.mode("overwrite").json(f"{folder}/manifest")


def read_pack(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")
