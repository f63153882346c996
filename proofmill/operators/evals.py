"""Paired evaluation runs: plans, summaries, snapshots and judge logs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmill import fixed_values as fv
from proofmill.functions import text as tx

VARIANTS = ("baseline", "treatment")


def eval_plan(tasks: DataFrame, variants: tuple[str, ...] = VARIANTS) -> DataFrame:
    """tasks (suite, task_id, repetitions) x repetitions x distinct variants, with stable run ids."""
    names = F.array_distinct(F.array(*[F.lit(x) for x in variants]))
    rows = tasks.select("suite", "task_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repetitions"))).alias("repetition"))
    rows = rows.select("*", F.explode(names).alias("variant"))
    return rows.withColumn("run_id", F.concat("task_id", F.lit("-"), "variant", F.lit("-r"), F.col("repetition").cast("string")))


def eval_plan_totals(plan: DataFrame, treatment: str = "treatment", treatment_calls: int = 5) -> DataFrame:
    """Planned runs and the most model calls they may use, per suite."""
    calls = F.when(F.col("variant") == treatment, treatment_calls).otherwise(1)
    return plan.groupBy("suite").agg(F.count("*").alias("runs"), F.sum(calls).alias("max_calls"))


def _metrics() -> list[Column]:
    return [F.count("run_id").alias("runs"), F.count_if(F.col("verification_exit_code") == 0).alias("verified"),
            F.sum("duration_ms").alias("_d"), F.sum("changed_files").alias("_c")]


def _averages(df: DataFrame, keys: list[str]) -> DataFrame:
    n = F.greatest("runs", F.lit(1))
    return df.select(*keys, "runs", "verified", (F.col("verified") / n).alias("verification_rate"),
                     F.round(F.coalesce("_d", F.lit(0.0)) / n, 3).alias("avg_duration_ms"),
                     F.round(F.coalesce("_c", F.lit(0)) / n, 6).alias("avg_changed_files"))


def eval_summary(runs: DataFrame, variants: tuple[str, ...] = VARIANTS) -> DataFrame:
    """Per variant metrics; a variant without runs still has a row."""
    names = runs.sparkSession.createDataFrame([(v,) for v in variants], "variant string")
    per = runs.groupBy("variant").agg(*_metrics())
    joined = names.join(per, "variant", "left").withColumns({"runs": F.coalesce("runs", F.lit(0)), "verified": F.coalesce("verified", F.lit(0))})
    return _averages(joined, ["variant"])


def eval_rollup(runs: DataFrame) -> DataFrame:
    """The same metrics by suite, task and variant, with subtotals."""
    per = runs.rollup("suite", "task_id", "variant").agg(*_metrics(), F.grouping_id().cast("long").alias("level"))
    return _averages(per, ["suite", "task_id", "variant", "level"])


def eval_paired_delta(runs: DataFrame, first: str = "baseline", second: str = "treatment") -> DataFrame:
    """Both variants of a (task, worker, repetition) side by side; unpaired runs stay."""
    key = ["task_id", "worker", "repetition"]

    def side(variant: str, tag: str) -> DataFrame:
        return runs.filter(F.col("variant") == variant).select(
            *key, (F.col("verification_exit_code") == 0).alias(f"{tag}_ok"), F.col("duration_ms").alias(f"{tag}_ms"))

    both = side(first, "first").join(side(second, "second"), key, "full")
    outcome = (F.when(F.col("first_ms").isNull() | F.col("second_ms").isNull(), "unpaired")
               .when(F.col("first_ok").isNull() | F.col("second_ok").isNull(), "not-verified")
               .when(F.col("second_ok") & ~F.col("first_ok"), "improved").when(F.col("first_ok") & ~F.col("second_ok"), "regressed").otherwise("same"))
    return both.select(*key, outcome.alias("outcome"), F.round(F.col("second_ms") - F.col("first_ms"), 3).alias("delta_ms"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added, removed and changed files of each run; ignored directories do not count."""
    def hashed(df: DataFrame, name: str) -> DataFrame:
        kept = df.filter(~F.exists(F.split("path", "/"), lambda s: s.isin(fv.SNAPSHOT_IGNORED)))
        return kept.select("run", "path", F.sha2("content", 256).alias(name))

    both = hashed(before, "a").join(hashed(after, "b"), ["run", "path"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return both.select("run", "path", change.alias("change"))


def last_object(text: str) -> str | None:
    """Last balanced `{...}` in free text that parses as a JSON object."""
    found, depth, start, quoted, skip = None, 0, 0, False, False
    for i, ch in enumerate(text):
        if quoted:
            if skip:
                skip = False
            elif ch == "\\":
                skip = True
            elif ch == '"':
                quoted = False
        elif ch == '"':
            quoted = depth > 0
        elif ch == "{":
            start = i if depth == 0 else start
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if depth == 0:
                try:
                    json.loads(text[start:i + 1])
                    found = text[start:i + 1]
                except ValueError:
                    pass
    return found


@F.pandas_udf(T.StringType())
def last_json_object(logs: pd.Series) -> pd.Series:
    return logs.map(last_object, na_action="ignore")


JUDGE = "approvedRepositories array<string>, rationale string"


def judge_decisions(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Judge verdicts (log_id, allowed, log) -> approved lists and violations."""
    parsed = logs.withColumn("doc", last_json_object("log")).withColumn("j", F.from_json("doc", JUDGE))
    approved = F.array_distinct(F.coalesce("j.approvedRepositories", F.array().cast("array<string>")))
    rows = parsed.select("log_id", approved.alias("approved"), tx.trimmed(F.col("j.rationale")).alias("rationale"), F.array_compact(F.array(
        F.when(F.col("doc").isNull(), "no-json-object").when(F.col("j.approvedRepositories").isNull(), "approved-missing"),
        F.when(F.col("doc").isNotNull() & (F.length(tx.trimmed(F.coalesce("j.rationale", F.lit("")))) < 12), "rationale-vague"),
        F.when(F.size(F.array_except(approved, "allowed")) > 0, "approved-not-allowed"))).alias("reasons"))
    return (rows.filter(F.size("reasons") == 0).drop("reasons"),
            rows.filter(F.size("reasons") > 0).select("log_id", F.explode("reasons").alias("reason")))
