"""Does a reference repay its context cost?  Points, blockers and a decision per task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.functions import text as tx
from proofmill.operators.structure import cap_per_group
from proofmill.params import DEFAULT, Params


def slice_facts(slices: DataFrame, strength: DataFrame, relations: DataFrame) -> DataFrame:
    """Per repository: which kinds of evidence its slices hold."""
    no = F.lit(False)

    def role(column: str, name: str):
        return F.bool_or(F.coalesce(F.array_contains(column, name), no))

    j = slices.select("slice_id", "full_name", "evidence_roles", "architecture_roles").join(strength.select("slice_id", "rank"), "slice_id", "left")
    facts = j.groupBy("full_name").agg(
        role("evidence_roles", "implementation").alias("source"), role("evidence_roles", "test").alias("test"),
        *[role("architecture_roles", r).alias(f"r_{r}") for r in ("contract", "invariant", "failure", "relationship", "test")],
        F.count_if(F.coalesce("rank", F.lit(0)) >= 2).alias("strong"))
    edges = relations.select("full_name").distinct().withColumn("edges", F.lit(True))
    return facts.join(edges, "full_name", "left").withColumn("edges", F.coalesce("edges", no))


def advisory_benefit(assessments: DataFrame, facts: DataFrame, content: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(task_id, full_name, score, signals, blockers, eligible, benefit_rank).

    assessments: accepted pairs with domain, capabilities, n_capabilities; content: matched / total per pair.
    """
    j = assessments.join(facts, "full_name", "left").join(content.select("task_id", "full_name", F.col("matched").alias("c_hit"), F.col("total").alias("c_all")),
                                                          ["task_id", "full_name"], "left")
    no = F.lit(False)
    flag = {n: F.coalesce(n, no) for n in ("source", "test", "edges", "r_contract", "r_invariant", "r_failure", "r_relationship", "r_test")}
    strong = F.coalesce("strong", F.lit(0))
    caps = F.coalesce(F.col("capabilities") / F.nullif("n_capabilities", F.lit(0)) >= 0.5, no)
    acts = F.coalesce(F.col("c_hit") / F.col("c_all") >= 0.5, no)
    pair = flag["source"] & flag["test"]
    mechanism = flag["r_contract"] | flag["r_invariant"] | flag["r_failure"]
    related = flag["edges"] | flag["r_relationship"]
    signals = [((F.col("domain") >= 60) & caps & acts, 25, "same-core-problem-evidence"), (pair, 20, "implementation-test-pair"),
               (mechanism, 15, "behavioral-contract-or-failure"), (related, 15, "resolved-architecture-relationship"),
               (flag["r_test"] & flag["test"], 15, "behavioral-test-concept"), (strong >= 2, 10, "multiple-syntactic-or-stronger-observations")]
    score = F.lit(0)
    for cond, points, _name in signals:
        score = score + F.when(cond, points).otherwise(0)
    out = j.select("task_id", "full_name", "domain", score.cast("long").alias("score"), tx.reasons(*[(c, n) for c, _p, n in signals]).alias("signals"), tx.reasons(
        (F.col("domain") < 60, "domain-below-60"), (~caps, "core-capability-coverage"), (~acts, "behavioral-capability-evidence"), (~pair, "no-implementation-test-pair"),
        (~mechanism & ~related, "no-mechanism-or-relationship"), (strong < 2, "too-few-strong-slices"), (score < params.benefit_threshold, "score-below-threshold")).alias("blockers"))
    return out.withColumn("eligible", F.size("blockers") == 0)


def advisory_decision(benefit: DataFrame, limit: int = 2) -> DataFrame:
    """learn / skip per task, with up to two eligible repositories."""
    top = cap_per_group(benefit.filter("eligible"), ["task_id"], [F.desc("score"), "full_name"], limit)
    chosen = top.groupBy("task_id").agg(F.array_sort(F.collect_list("full_name")).alias("selected"))
    return benefit.select("task_id").distinct().join(chosen, "task_id", "left").select(
        "task_id", F.when(F.col("selected").isNull(), "skip").otherwise("learn").alias("decision"), F.array_join("selected", "|").alias("selected"))


def selected_pairs(benefit: DataFrame, limit: int = 2) -> DataFrame:
    w = Window.partitionBy("task_id").orderBy(F.desc("score"), "full_name")
    return benefit.filter("eligible").withColumn("selection_rank", F.row_number().over(w).cast("long")).filter(F.col("selection_rank") <= limit).select(
        "task_id", "full_name", "selection_rank")
