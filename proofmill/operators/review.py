"""Review gate, confirmation and citation checks; violations are rows, never exceptions.

Reviews are keyed by (repository, review_no); citations live in child tables with one
row per cited slice or bundle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.functions import paths as pt
from proofmill.functions import text as tx
from proofmill.operators.domain import match_terms
from proofmill.operators.structure import cap_per_group
from proofmill.params import DEFAULT, Params
from proofmill.sources.sinks import landed

KEY = ["repository", "review_no"]
RISK = {"low": 0, "medium": 1, "high": 2}


def review_citations(reviews: DataFrame, cited_slices: DataFrame, cited_bundles: DataFrame, slices: DataFrame,
                     bundles: DataFrame, bundle_slices: DataFrame, known: DataFrame) -> DataFrame:
    """Citation errors of reviews: unknown or foreign ids, duplicates, slices outside the cited bundles."""
    unknown = reviews.join(known.select(F.col("full_name").alias("repository")).distinct(), "repository", "left_anti").select(
        *KEY, F.lit("").alias("cited"), F.lit("unknown-repository").alias("reason"))
    nth = Window.partitionBy("pack_id", "repository").orderBy("review_no")
    repeated = reviews.withColumn("nth", F.row_number().over(nth)).filter("nth > 1").select(
        *KEY, F.lit("").alias("cited"), F.lit("duplicate-decision").alias("reason"))
    b = cited_bundles.join(bundles.select("bundle_id", F.col("full_name").alias("owner")), "bundle_id", "left")
    bad_bundle = b.select(*KEY, F.col("bundle_id").alias("cited"), F.when(F.col("owner").isNull(), "unknown-bundle").when(
        F.col("owner") != F.col("repository"), "foreign-bundle").alias("reason"))
    s = cited_slices.join(slices.select("slice_id", F.col("full_name").alias("owner")).distinct(), "slice_id", "left")
    inside = (cited_bundles.join(bundle_slices.select("bundle_id", "slice_id"), "bundle_id").select(*KEY, "slice_id").distinct().withColumn("inside", F.lit(True)))
    has_bundles = cited_bundles.select(*KEY).distinct().withColumn("bundled", F.lit(True))
    s = s.join(inside, [*KEY, "slice_id"], "left").join(has_bundles, KEY, "left")
    bad_slice = s.select(*KEY, F.col("slice_id").alias("cited"), F.when(F.col("owner").isNull(), "unknown-slice").when(
        F.col("owner") != F.col("repository"), "foreign-slice").when(
        F.coalesce("bundled", F.lit(False)) & F.col("inside").isNull(), "slice-outside-bundles").alias("reason"))
    return unknown.unionByName(repeated).unionByName(bad_bundle.filter("reason is not null")).unionByName(bad_slice.filter("reason is not null"))


def domain_review(reviews: DataFrame, fit_slices: DataFrame, cited_slices: DataFrame, slices: DataFrame, terms: DataFrame,
                  domain: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Same-domain reasons per review (KEY, reason).

    terms: (term) capability words of the task; domain: (repository, domain score).
    """
    score = F.coalesce("domain", F.lit(0))
    fit = fit_slices.select(*KEY, "slice_id").distinct()
    own = slices.select("slice_id", F.col("full_name").alias("owner"), "path", "content")
    bound = fit.join(cited_slices.select(*KEY, "slice_id").distinct().withColumn("is_cited", F.lit(True)), [*KEY, "slice_id"], "left").join(
        own.select("slice_id", "owner", "path"), "slice_id", "left")
    ok = F.col("is_cited").isNotNull() & (F.col("owner") == F.col("repository"))
    unbound = bound.filter(~F.coalesce(ok, F.lit(False))).select(*KEY, F.concat(F.lit("evidence-unbound:"), "slice_id").alias("reason"))
    behaving = bound.filter(ok & pt.is_behavior_code(F.col("path")))
    # Only text of behavior code is dealt by slice, once; the cited part of it is landed, since the index and the check both read it.
    code = own.filter(pt.is_behavior_code(F.col("path"))).select("slice_id", "content")
    texts = landed(code.join(behaving.select("slice_id").distinct(), "slice_id", "left_semi").select("slice_id", tx.normalize_text(F.col("content")).alias("norm")), "cited-texts")
    hits = match_terms(texts, ["slice_id"], "norm", terms).select("slice_id").distinct()
    supported = behaving.join(hits, "slice_id", "left_semi").select(*KEY).distinct().withColumn("supported", F.lit(True))
    counts = fit.groupBy(*KEY).agg(F.count("*").alias("n_fit"))
    joined = reviews.join(domain.select("repository", "domain"), "repository", "left").join(supported, KEY, "left").join(counts, KEY, "left")
    missing = F.col("relation").isNull()
    flat = joined.select(*KEY, F.explode(tx.reasons(
        (score < params.min_domain, "domain-mismatch"), (missing, "domain-fit-missing"),
        (~missing & (F.col("relation") != "same-domain"), F.concat(F.lit("domain-relation:"), "relation")),
        (~missing & (F.length(tx.trimmed(F.coalesce("rationale", F.lit("")))) < 20), "domain-rationale"),
        (~missing & F.col("n_fit").isNull(), "domain-evidence-missing"),
        (~missing & F.col("supported").isNull(), "domain-behavior-missing"))).alias("reason"))
    fitted = reviews.filter("relation is not null").select(*KEY)
    return flat.unionByName(unbound.join(fitted, KEY, "left_semi"))


def review_gate(accepted: DataFrame, reviews: DataFrame, cited_slices: DataFrame, cited_bundles: DataFrame,
                domain_reasons: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One result per accepted repository and decision; approved when adopt/adapt has no reasons.

    accepted: (repository, license_rejection or NULL); reviews carry counts of patterns, mismatches and risks.
    """
    counted = cited_slices.groupBy(*KEY).agg(F.countDistinct("slice_id").alias("n_slices"))
    bundled = cited_bundles.groupBy(*KEY).agg(F.count("*").alias("n_bundles"))
    extra = domain_reasons.groupBy(*KEY).agg(F.array_sort(F.collect_set("reason")).alias("domain_reasons"))
    j = accepted.join(reviews, "repository", "left").join(counted, KEY, "left").join(bundled, KEY, "left").join(extra, KEY, "left")
    rank = F.create_map(*[F.lit(x) for kv in RISK.items() for x in kv])
    active = F.col("verdict").isin("adopt", "adapt")
    none = F.array().cast("array<string>")
    checks = tx.reasons(
        (F.col("license_rejection").isNotNull(), F.col("license_rejection")),
        (F.col("confidence") < params.min_confidence, F.concat(F.lit("Confidence "), tx.number_text(F.col("confidence")), F.lit(f" < {params.min_confidence:g}"))),
        (rank[F.col("risk")] > RISK[params.max_review_risk], F.concat(F.lit("Review risk "), "risk", F.lit(f" exceeds {params.max_review_risk}"))),
        (F.coalesce("n_slices", F.lit(0)) < params.min_cited_slices, F.concat(F.lit("Evidence slices "), F.coalesce("n_slices", F.lit(0)).cast("string"), F.lit(f" < {params.min_cited_slices}"))),
        (F.col("n_bundles").isNull(), "No inspected evidence bundle was cited"), (F.col("n_patterns") == 0, "No transferable pattern was stated"),
        (tx.trimmed(F.col("summary")) == "", "No review summary was stated"),
        ((F.col("verdict") == "adapt") & (F.col("n_mismatches") == 0), "Adapt verdict requires at least one mismatch"),
        ((F.col("risk") != "low") & (F.col("n_risks") == 0), F.concat("risk", F.lit(" risk review requires at least one stated risk"))))
    reasons = (F.when(F.col("verdict").isNull(), F.array(F.lit("No second-stage review decision")))
               .when(F.col("verdict") == "pending", F.array(F.lit("Review is still pending")))
               .when(F.col("verdict") == "reject", F.array(F.lit("Reviewer rejected the precedent")))
               .otherwise(F.concat(F.coalesce("domain_reasons", none), checks)))
    return j.withColumn("reasons", reasons).select(
        *KEY, "pack_id", "verdict", "relation", "confidence", "risk", "reviewer", "reasons",
        (F.coalesce(active, F.lit(False)) & (F.size("reasons") == 0)).alias("approved"))


def gate_report(gate: DataFrame) -> DataFrame:
    """Approved and total candidates per pack and verdict."""
    return gate.groupBy("pack_id", "verdict").agg(F.count_if("approved").alias("approved"), F.count("*").alias("candidates"),
                                                  F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.sum(F.size("reasons")).alias("reasons"))


def review_candidates(assessments: DataFrame, slices: DataFrame, bundles: DataFrame, coverage: DataFrame, params: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(candidates with their default decision, violations) per pack, first accepted ones with evidence."""
    key = "full_name"
    counts = slices.groupBy(key).agg(F.count("*").alias("slices"))
    packs = bundles.groupBy(key).agg(F.count("*").alias("bundles"))
    offered = assessments.filter("accepted").join(counts, key)
    offered = cap_per_group(offered, ["pack_id"], ["candidate_rank", key], params.max_repositories)
    joined = offered.join(packs, key, "left").join(coverage.select(key, F.col("score").alias("coverage")), key, "left")
    violations = joined.select("pack_id", key, F.explode(tx.reasons(
        (F.col("coverage").isNull(), "missing-atlas"), (F.col("bundles").isNull(), "missing-bundles"))).alias("reason"))
    good = joined.filter("coverage is not null and bundles is not null").select(
        "pack_id", key, "candidate_rank", "slices", "bundles", "coverage", F.lit("pending").alias("verdict"), F.lit(0.0).alias("confidence"), F.lit("high").alias("risk"))
    return good, violations


def approved_slice_ids(gate: DataFrame, cited_slices: DataFrame, cited_bundles: DataFrame, bundle_slices: DataFrame) -> DataFrame:
    """Slices cited by approved reviews, directly or through cited bundles."""
    yes = gate.filter("approved").select(*KEY)
    direct = cited_slices.join(yes, KEY, "left_semi").select("slice_id")
    through = cited_bundles.join(yes, KEY, "left_semi").select("bundle_id").distinct().join(bundle_slices.select("bundle_id", "slice_id"), "bundle_id").select("slice_id")
    return direct.union(through).distinct()


def evidence_index(slices: DataFrame, approved: DataFrame) -> DataFrame:
    """Citable index of approved slices; content is never read."""
    return slices.select("slice_id", "full_name", "path", "start_line", "end_line", F.array_join("architecture_roles", "|").alias("roles"),
                         "strategy", "license").join(approved, "slice_id", "left_semi")


def confirm_gate(gate: DataFrame, confirmations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Independent confirmation: (gate rows after it, violations per pack).

    confirmations: pack_id, confirmer, rationale, pack_ok / task_ok / review_ok, and approved (array).
    """
    per = gate.groupBy("pack_id").agg(F.collect_set(F.when(F.col("approved"), F.col("repository"))).alias("passed"),
                                      F.collect_set(F.lower(tx.trimmed(F.col("reviewer")))).alias("reviewers"))
    j = confirmations.join(per, "pack_id", "left")
    who = F.lower(tx.trimmed(F.col("confirmer")))
    none = F.array().cast("array<string>")
    checked = j.withColumn("reasons", tx.reasons(
        (~F.col("pack_ok"), "different-pack"), (~F.col("task_ok"), "different-task"), (~F.col("review_ok"), "different-review"),
        (who == "", "confirmer-missing"), (F.length(tx.trimmed(F.col("rationale"))) < 12, "rationale-vague"),
        (F.array_contains("reviewers", who), "same-identity"), (F.size("confirmed") == 0, "nothing-approved"),
        (F.size(F.array_except("confirmed", F.coalesce("passed", none))) > 0, "confirms-unapproved")))
    valid = checked.filter(F.size("reasons") == 0).select("pack_id", "confirmed")
    out = gate.join(valid, "pack_id", "left")
    kept = F.col("approved") & F.coalesce(F.array_contains("confirmed", F.col("repository")), F.lit(False))
    out = out.withColumn("reasons", F.when(F.col("approved") & ~kept, F.array_append("reasons", F.lit("Not approved by the independent confirmer"))).otherwise(F.col("reasons")))
    return out.withColumn("approved", kept).drop("confirmed"), checked.filter(F.size("reasons") > 0).select("pack_id", F.explode("reasons").alias("reason"))


def read_ledger_check(citations: DataFrame, read_log: DataFrame, keys: list[str]) -> DataFrame:
    """Citations of items that were never read."""
    return citations.select(*keys).distinct().join(read_log.select(*keys).distinct(), keys, "left_anti")


def run_counts(tables: dict[str, tuple[DataFrame, Column]], key: str = "pack_id") -> DataFrame:
    """Distinct counts per pack of several tables, one column each, missing ones 0."""
    out = None
    for name, (df, what) in tables.items():
        part = df.groupBy(key).agg(F.countDistinct(what).alias(name))
        out = part if out is None else out.join(part, key, "full")
    return out.select(key, *[F.coalesce(n, F.lit(0)).alias(n) for n in tables])


def cited_evidence_payload(slices: DataFrame, cited: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Cited slices of a pack in order, content cut where the pack's character budget ends.

    cited: pack_id, slice_id.  Running totals are taken in two steps, per directory
    and then over directory totals, so a pack with very many citations is not one task.
    """
    picked = cited.select("pack_id", "slice_id").distinct().join(slices.select("slice_id", "path", "start_line", F.length("content").alias("chars")), "slice_id")
    picked = picked.withColumn("block", pt.dirname(F.col("path")))
    inside = Window.partitionBy("pack_id", "block").orderBy("path", "start_line", "slice_id").rowsBetween(Window.unboundedPreceding, -1)
    blocks = picked.groupBy("pack_id", "block").agg(F.sum("chars").alias("chars"))
    above = Window.partitionBy("pack_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("pack_id", "block", F.coalesce(F.sum("chars").over(above), F.lit(0)).alias("offset"))
    placed = picked.withColumn("prior", F.coalesce(F.sum("chars").over(inside), F.lit(0))).join(offsets, ["pack_id", "block"])
    left = F.greatest(F.lit(params.payload_characters) - F.col("prior") - F.col("offset"), F.lit(0))
    sized = placed.select("pack_id", "slice_id", "chars", F.least(left, F.col("chars")).alias("kept"))
    out = sized.join(slices.select("slice_id", "content"), "slice_id")
    return out.select("pack_id", "slice_id", F.expr("substring(content, 1, int(kept))").alias("content"), (F.col("kept") < F.col("chars")).alias("truncated"))
