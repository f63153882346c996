"""Content fingerprints that do not depend on row order, and tamper checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.functions import text as tx


def task_fingerprint(task: Column, lists: dict[str, Column], workspace: Column, revision: Column) -> Column:
    """Hash of the normalised task, canonical workspace path and base revision."""
    slashed = F.regexp_replace(F.replace(workspace, F.lit("\\"), F.lit("/")), "/$", "")
    canonical = F.when(slashed.rlike("(?i)^[a-z]:/"), F.lower(slashed)).otherwise(slashed)
    base = tx.trimmed(F.coalesce(revision, F.lit("")))
    clean = [F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(c, lambda x: tx.collapsed(x)), lambda x: x != ""))), "\u0001")
             for c in lists.values()]
    parts = [canonical, F.when(base == "", "unversioned").otherwise(base), tx.collapsed(task), *clean]
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


def row_hash(columns: list[str]) -> Column:
    """Hash of a row; NULL and empty stay distinct."""
    return F.sha2(F.concat_ws("\u0000", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]), 256)


def group_fingerprint(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Order-free fingerprint per group.

    Each row hash contributes two 60-bit words; their sums (and the row count) combine
    in partial aggregates, so no group is ever collected.
    """
    h = row_hash(columns)
    words = df.select(*keys, h.alias("h")).select(*keys, *[
        F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)").alias(f"w{i}") for i in range(4)])
    sums = words.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.sum(f"w{i}").alias(f"s{i}") for i in range(4)])
    return sums.select(*keys, "rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("fingerprint"))


def review_fingerprint(reviews: DataFrame, cited: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Order-insensitive hash over decisions and their cited slice ids; reviewer is trimmed."""
    clean = reviews.withColumn("reviewer", tx.trimmed(F.col("reviewer")))
    a = group_fingerprint(clean, keys, columns).select(*keys, F.col("fingerprint").alias("a"))
    b = group_fingerprint(cited, keys, [c for c in cited.columns if c not in keys]).select(*keys, F.col("fingerprint").alias("b"))
    return a.join(b, keys, "left").select(*keys, F.sha2(F.concat_ws(":", "a", F.coalesce("b", F.lit("-"))), 256).alias("fingerprint"))


def tamper_check(stored: DataFrame, recomputed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose stored fingerprint differs from the recomputed one, or lacks a counterpart."""
    both = stored.select(*keys, F.col("fingerprint").alias("stored")).join(
        recomputed.select(*keys, F.col("fingerprint").alias("recomputed")), keys, "full")
    return both.filter(~F.col("stored").eqNullSafe(F.col("recomputed"))).select(
        *keys, F.when(F.col("stored").isNull(), "not-stored").when(F.col("recomputed").isNull(), "missing").otherwise("modified").alias("reason"))
