"""Line-interval coverage: which slices together cover a cited range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.functions import text as tx
from proofmill.functions.frames import stage

BUCKET = 64


def buckets(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / BUCKET), F.floor(end / BUCKET)))


def interval_cover(intervals: DataFrame, slices: DataFrame, keys: list[str], within: list[str] | None = None) -> DataFrame:
    """Greedy witnesses of every interval that slices cover completely.

    `keys` identify an interval; both sides carry full_name, revision, path and line
    bounds; `within` names further columns both sides must agree on.  The join is an equi-join on file and 64-line bucket, so one hot file is
    spread over its buckets.  Only the longest window per start line can be a witness,
    so windows are reduced to that by partial aggregates before they are listed per
    interval: a list is bounded by the lines that the interval and its windows span, and
    walked once.
    """
    file = [*(within or []), "full_name", "revision", "path"]
    valid = intervals.filter((F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")))
    wanted = valid.select(*dict.fromkeys([*keys, *file]), "start_line", "end_line",
                          buckets(F.col("start_line"), F.col("end_line")).alias("bucket"))
    windows = slices.select(*file, "slice_id", F.col("start_line").alias("w_start"), F.col("end_line").alias("w_end"),
                            buckets(F.col("start_line"), F.col("end_line")).alias("bucket"))
    pairs = wanted.join(windows, [*file, "bucket"]).filter(
        (F.col("w_start") <= F.col("end_line")) & (F.col("w_end") >= F.col("start_line")))
    best = pairs.groupBy(*keys, "start_line", "end_line", "w_start").agg(
        F.min(F.struct((-F.col("w_end")).alias("far"), "slice_id")).alias("b"))
    listed = best.groupBy(*keys, "start_line", "end_line").agg(F.array_sort(F.collect_list(F.struct(
        F.col("w_start").alias("start"), (-F.col("b.far")).alias("far"), F.col("b.slice_id").alias("id")))).alias("windows"))
    # One pass over the windows in order of their starts: `pick` is the furthest-reaching one that is usable at line `next`; it is taken
    # when a window starts beyond `next`, or at the end.
    none = F.struct(F.lit(0).cast("long").alias("far"), F.lit(None).cast("string").alias("id"))
    begin = F.struct(F.col("start_line").cast("long").alias("next"), none.alias("pick"), F.array().cast("array<string>").alias("ids"))

    def taken(acc: Column) -> Column:
        usable = (acc["pick"]["far"] >= acc["next"]) & (acc["next"] <= F.col("end_line"))
        return F.struct(F.when(usable, acc["pick"]["far"] + 1).otherwise(acc["next"]).alias("next"), acc["pick"].alias("pick"),
                        F.when(usable, F.array_append(acc["ids"], acc["pick"]["id"])).otherwise(acc["ids"]).alias("ids"))

    def step(acc: Column, w: Column) -> Column:
        now = F.when(w["start"] > acc["next"], taken(acc)).otherwise(acc)
        this = F.struct(w["far"].alias("far"), w["id"].alias("id"))
        return F.get(F.transform(F.array(now), lambda n: F.struct(
            n["next"].alias("next"), F.when((w["start"] <= n["next"]) & (w["far"] > n["pick"]["far"]), this).otherwise(n["pick"]).alias("pick"), n["ids"].alias("ids"))), F.lit(0))

    done = stage(listed, r=F.aggregate("windows", begin, step, taken))
    return done.filter(F.col("r.next") > F.col("end_line")).select(*keys, F.col("r.ids").alias("witnesses"))


def same_revision(slices: DataFrame, atlases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slices at the pinned revision of their repository, and the excluded rest."""
    key = ["full_name", "revision"]
    pinned = atlases.select(*key).distinct()
    return slices.join(pinned, key, "left_semi"), slices.join(pinned, key, "left_anti")


def semantic_window(strategy: Column) -> Column:
    return strategy.isNotNull() & (strategy != "line-window")


EDGE = ["full_name", "src", "dst", "kind", "source_url"]


def relation_support(relations: DataFrame, slices: DataFrame) -> DataFrame:
    """Is an edge backed by its cited source lines and by a slice of the target file?

    `slices` must already be limited to pinned revisions (`same_revision`).
    """
    anchor = tx.line_anchor(F.col("source_url"))
    edges = stage(relations, a=anchor).withColumn(
        "located", (F.col("evidence_path") == F.col("src")) & F.col("a.start_line").isNotNull())
    cited = edges.filter("located").select(*EDGE, "revision", F.col("src").alias("path"), "a.start_line", "a.end_line")
    source = interval_cover(cited, slices, EDGE)
    best = slices.groupBy("full_name", F.col("path").alias("dst")).agg(F.min(F.struct(
        (~semantic_window(F.col("strategy"))).alias("plain"), (-F.col("relevance")).alias("rel"), "start_line", "slice_id")).alias("b")
    ).select("full_name", "dst", F.col("b.slice_id").alias("target"))
    joined = edges.join(source, EDGE, "left").join(best, ["full_name", "dst"], "left")
    limits = F.array_compact(F.array(
        F.when(~F.col("located"), "no-source-line").when(F.col("witnesses").isNull(), "source-lines-not-covered"),
        F.when(F.col("target").isNull(), "no-target-evidence")))
    backing = F.array_sort(F.array_distinct(F.array_compact(F.array_append(
        F.coalesce("witnesses", F.array().cast("array<string>")), F.col("target")))))
    return joined.select(*EDGE, "revision", (F.size(limits) == 0).alias("supported"), limits.alias("limitations"), backing.alias("slice_ids"))


LINK = ["full_name", "test_path", "test_symbol", "request"]


def fixture_support(links: DataFrame, symbols: DataFrame, slices: DataFrame) -> DataFrame:
    """Is a fixture link backed by complete requester and provider declarations?"""
    s = symbols.select("full_name", "revision", "path", F.col("name").alias("symbol"), "role", "start_line", "end_line", "fixture_requests", "fixture_name")
    asks = links.withColumnsRenamed({"test_path": "path", "test_symbol": "symbol"}).join(s, ["full_name", "path", "symbol"]).filter(
        F.col("role").isin("test", "fixture") & F.array_contains("fixture_requests", F.col("request")))
    asks = asks.withColumn("test_path", F.col("path")).withColumn("test_symbol", F.col("symbol"))
    gives = links.filter("fixture_path is not null").withColumn("path", F.col("fixture_path")).withColumn(
        "symbol", F.col("fixture_symbol")).join(s, ["full_name", "path", "symbol"]).filter("role = 'fixture'")
    columns = [*LINK, "revision", "path", "start_line", "end_line"]
    asked = interval_cover(asks.select(*columns).dropDuplicates(LINK), slices, LINK).withColumnRenamed("witnesses", "ask_ids")
    given = interval_cover(gives.select(*columns).dropDuplicates(LINK), slices, LINK).withColumnRenamed("witnesses", "give_ids")
    joined = links.join(asked, LINK, "left").join(given, LINK, "left")
    limits = tx.reasons((F.col("status") != "candidate", "unresolved"), (F.col("ask_ids").isNull(), "requester-not-covered"),
                        (F.col("give_ids").isNull(), "provider-not-covered"))
    empty = F.array().cast("array<string>")
    backing = F.array_sort(F.array_distinct(F.concat(F.coalesce("ask_ids", empty), F.coalesce("give_ids", empty))))
    return joined.select(*LINK, (F.size(limits) == 0).alias("supported"), limits.alias("limitations"), backing.alias("slice_ids"))
