"""Repository scoring: transparent point rules over metadata and tree flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill import fixed_values as fv
from proofmill.functions import paths as pt
from proofmill.functions import text as tx
from proofmill.functions.frames import at_most
from proofmill.params import DEFAULT, Params


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(c))).cast("long")


def _any(pattern: str) -> Column:
    return F.bool_or(F.col("path").rlike(pattern))


def tree_flags(tree: DataFrame) -> DataFrame:
    """One pass over the tree: what each repository holds, by path alone."""
    p = F.col("path")
    return tree.filter("type = 'blob'").groupBy("full_name").agg(
        F.count("*").alias("files"), F.bool_or(pt.is_test(p) & pt.is_code(p)).alias("has_tests"),
        _any(fv.CI_WORKFLOW).alias("has_ci"), _any(fv.WORKFLOW_DIR).alias("has_workflows"),
        _any(fv.GOVERNANCE_DOC).alias("has_governance"), _any(fv.EXAMPLE_TREE).alias("has_examples"),
        _any(fv.TRANSFER_TREE).alias("has_packages"), _any(fv.IMPLEMENTATION_TREE).alias("has_source_tree"),
        _any(fv.ROOT_README).alias("has_readme"), _any(fv.DOCS_TREE).alias("has_docs"),
        _any(fv.SCORE_MANIFEST).alias("has_manifest"), _any(fv.DECISION_TREE).alias("has_decisions"),
        _any(fv.STATIC_CHECKS).alias("has_checks"))


FLAGS = ["has_tests", "has_ci", "has_workflows", "has_governance", "has_examples", "has_packages", "has_source_tree",
         "has_readme", "has_docs", "has_manifest", "has_decisions", "has_checks"]


def with_flags(repositories: DataFrame, flags: DataFrame, on: str = "full_name") -> DataFrame:
    """Attach flags; a repository without a tree has every flag false and no files."""
    out = repositories.join(flags.withColumnRenamed("full_name", on), on, "left")
    return out.select(*[c for c in repositories.columns], F.coalesce("files", F.lit(0)).alias("files"),
                      *[F.coalesce(f, F.lit(False)).alias(f) for f in FLAGS])


def days_since_push(now: Column, pushed: str = "pushed_at") -> Column:
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(pushed).cast("timestamp"))
    return F.greatest(F.lit(0.0), micros / F.lit(86_400_000_000.0))


def _points(*pairs: tuple[Column, int]) -> Column:
    total = F.lit(0.0)
    for cond, points in pairs:
        total = total + F.when(cond, points).otherwise(0)
    return total


def maturity(df: DataFrame, now: Column, params: Params = DEFAULT) -> DataFrame:
    days = days_since_push(now)
    base = F.least(F.lit(38.0), F.log10(F.col("stars") + 1) * 11) + F.least(F.lit(12.0), F.log10(F.col("forks") + 1) * 5)
    total = base + _points((F.col("has_tests"), 18), (F.col("has_ci"), 12), (F.col("has_governance"), 8),
                           (days < params.recent_days, 8))
    return df.withColumn("maturity", clamp(total)).withColumn("maturity_reasons", tx.reasons(
        (F.col("has_tests"), "Behavioral test files"), (F.col("has_ci"), "Automated CI workflow"),
        (F.col("has_governance"), "Project governance documentation"),
        (days < params.recent_days, "Recently maintained"), (days > params.stale_days, "Maintenance appears stale")))


def transferability(df: DataFrame) -> DataFrame:
    small = F.col("size_kb") < 150_000
    return df.withColumn("transferability", clamp(65 + _points(
        (F.col("has_examples"), 15), (F.col("has_packages"), 10), (small, 10)))).withColumn(
        "transferability_reasons", tx.reasons(
            (F.lit(True), "license-independent-transfer-baseline: 65; structural heuristic only"),
            (F.col("has_examples"), "Contains examples"), (F.col("has_packages"), "Implementation boundaries are visible"),
            (small, "Repository size is inspectable")))


def clarity(df: DataFrame) -> DataFrame:
    huge = F.col("files") > 30_000
    return df.withColumn("clarity", clamp(20 + _points(
        (F.col("has_readme"), 18), (F.col("has_docs"), 22), (F.col("has_examples"), 18), (F.col("has_manifest"), 12),
        (huge, -15)))).withColumn("clarity_reasons", tx.reasons(
            (F.col("has_readme"), "Root README"), (F.col("has_docs"), "Architecture or documentation tree"),
            (F.col("has_examples"), "Executable usage examples"), (F.col("has_manifest"), "Machine-readable project manifest"),
            (huge, "Very large tree may obscure patterns")))


def design(df: DataFrame) -> DataFrame:
    return df.withColumn("design", clamp(25 + _points(
        (F.col("has_source_tree"), 15), (F.col("has_tests"), 20), (F.col("has_decisions"), 15), (F.col("has_checks"), 10),
        (F.col("has_workflows"), 10)))).withColumn("design_reasons", tx.reasons(
            (F.col("has_source_tree"), "Separated implementation tree"), (F.col("has_tests"), "Design is exercised by tests"),
            (F.col("has_decisions"), "Design decisions are documented"),
            (F.col("has_checks"), "Static engineering checks are configured"),
            (F.col("has_workflows"), "Continuous verification exists")))


def risk(df: DataFrame, now: Column, params: Params = DEFAULT) -> DataFrame:
    stale, large = days_since_push(now) > params.stale_days, F.col("size_kb") > 300_000
    found = tx.reasons((F.col("archived"), "Repository is archived"), (F.col("fork"), "Repository is a fork"),
                       (stale, "No recent maintenance signal"), (large, "Large attack and review surface"))
    return df.withColumn("risk", clamp(5 + _points((F.col("archived"), 30), (F.col("fork"), 10), (stale, 18), (large, 8)))
                         ).withColumn("risk_reasons", F.when(F.size(found) > 0, found).otherwise(
                             F.array(F.lit("No elevated metadata risk detected"))))


def score_repositories(repositories: DataFrame, now: Column, params: Params = DEFAULT) -> DataFrame:
    """The five task-independent dimensions of flagged repositories."""
    return risk(design(clarity(transferability(maturity(repositories, now, params)))), now, params)


def overall(df: DataFrame) -> DataFrame:
    w = fv.OVERALL_WEIGHTS
    return df.withColumn("overall", clamp(
        F.col("domain") * w["domain"] + F.col("maturity") * w["maturity"] + F.col("transferability") * w["transferability"]
        + F.col("clarity") * w["clarity"] + F.col("design") * w["design"] + (100 - F.col("risk")) * w["safety"]))


def license_policy(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    known = F.col("license").isNotNull() & (F.col("license") != "")
    listed = known & F.col("license").isin(list(params.allowed_licenses))
    blocked = ~listed if params.license_policy == "allowlist" else F.lit(False)
    return df.withColumn("license_warnings", tx.reasons(
        (known, F.concat(F.lit("license-metadata: "), "license")),
        (~known, "license-unknown: no reliable license metadata; terms require inspection"),
        (known & ~listed, "license-not-allowlisted: inspect the applicable terms before reuse"),
        (F.lit(True), "learning-only: reference selection does not authorize copying, redistribution, or dependency "
                      "installation; preserve attribution and verify applicable terms before reuse"),
    )).withColumn("license_rejections", tx.reasons((blocked, "license-policy: license is not allowlisted")))


def acceptance(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Rejection reasons; a repository is accepted when there are none."""
    def text(label: str, column: str, op: str, limit: int) -> Column:
        return F.concat(F.lit(label + " "), F.col(column).cast("string"), F.lit(f" {op} {limit}"))

    found = F.concat(tx.reasons(
        (F.col("domain") == 0, "domain-metadata-missing: same-domain reference required"),
        (F.col("overall") < params.min_overall, text("Overall", "overall", "<", params.min_overall)),
        (F.col("domain") < params.min_domain, text("Domain match", "domain", "<", params.min_domain)),
        (F.col("risk") > params.max_risk, text("Risk", "risk", ">", params.max_risk))), "license_rejections")
    return df.withColumn("rejection_reasons", found).withColumn("accepted", F.size(found) == 0)


def assess_repositories(candidates: DataFrame, repositories: DataFrame, flags: DataFrame, domain: DataFrame, now: Column,
                        params: Params = DEFAULT, tree_key: str = "full_name") -> DataFrame:
    """Assess (task, repository) candidates: scores are computed once per repository."""
    scored = score_repositories(with_flags(repositories, flags, tree_key), now, params)
    keep = ["full_name", "maturity", "maturity_reasons", "transferability", "clarity", "design", "risk", "license"]
    pairs = (candidates.join(scored.select(*keep), "full_name")
             .join(domain.select("task_id", "full_name", F.col("domain").alias("domain_score")), ["task_id", "full_name"], "left")
             .withColumn("domain", F.coalesce("domain_score", F.lit(0).cast("long"))).drop("domain_score"))
    return acceptance(license_policy(overall(pairs), params), params)


def select_learning_set(assessments: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """First accepted repositories: requested ones first, then in candidate order."""
    w = Window.partitionBy("task_id").orderBy("origin_priority", "candidate_rank", "full_name")
    return (assessments.filter("accepted").withColumn("selection_rank", F.row_number().over(w).cast("long"))
            .filter(F.col("selection_rank") <= params.max_repositories)
            .select("task_id", "full_name", "selection_rank", "origin_priority"))


def rank_assessments(assessments: DataFrame, limit: int | None = None) -> DataFrame:
    w = Window.partitionBy("task_id").orderBy(F.desc("accepted"), F.desc("overall"), "full_name")
    out = assessments.withColumn("assessment_rank", F.row_number().over(w).cast("long"))
    return out if limit is None else out.filter(F.col("assessment_rank") <= limit)


def merge_assessments(requested: DataFrame, automatic: DataFrame) -> DataFrame:
    """Requested assessments, then automatic ones that were not requested."""
    key = ["task_id", "full_name"]
    extra = automatic.join(requested.select(*key).distinct(), key, "left_anti")
    return requested.withColumn("origin_priority", F.lit(0).cast("long")).unionByName(
        extra.withColumn("origin_priority", F.lit(1).cast("long")))


def coverage_score(qualified: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Points per evidence category present among fully read files (full_name, path, category)."""
    points = F.create_map(*[F.lit(x) for kv in fv.CATEGORY_POINTS.items() for x in kv])
    per = qualified.groupBy("full_name", "category").agg(F.count("*").alias("files"))
    required = F.array(*[F.lit(c) for c in params.required_categories])
    out = per.groupBy("full_name").agg(
        F.sum(points[F.col("category")]).cast("long").alias("score"), F.array_sort(F.collect_set("category")).alias("present"))
    out = out.withColumn("missing_required", F.array_sort(F.array_except(required, "present")))
    return out.withColumn("sufficient", (F.col("score") >= params.min_coverage) & (F.size("missing_required") == 0))


def coverage_samples(qualified: DataFrame, per_category: int | None = None) -> DataFrame:
    """The ranked source paths behind each category."""
    w = Window.partitionBy("full_name", "category").orderBy("path")
    return (qualified.select("full_name", "category", "path").distinct().withColumn("sample", F.row_number().over(w).cast("long"))
            .filter(at_most(F.col("sample"), per_category)))


def coverage_gate(assessments: DataFrame, coverage: DataFrame, read_failures: DataFrame, params: Params = DEFAULT,
                  key: str = "full_name") -> DataFrame:
    """Add coverage rejections to assessments."""
    w = Window.partitionBy(key).orderBy("path")
    failures = (read_failures.withColumn("rn", F.row_number().over(w)).groupBy(key).agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "path", "reason"))),
                    lambda s: F.concat(s["path"], F.lit(": "), s["reason"])), "; ").alias("failed")))
    joined = assessments.join(coverage.select(
        F.col("full_name").alias(key), F.col("score").alias("cov"), "missing_required", "sufficient"), key, "left").join(failures, key, "left")
    extra = tx.reasons(
        (F.coalesce("cov", F.lit(0)) < params.min_coverage,
         F.concat(F.lit("Architecture evidence coverage "), F.coalesce("cov", F.lit(0)).cast("string"), F.lit(f" < {params.min_coverage}"))),
        (F.size("missing_required") > 0,
         F.concat(F.lit("Missing required architecture evidence: "), F.array_join("missing_required", ", "))),
        (~F.coalesce("sufficient", F.lit(False)) & F.col("failed").isNotNull(),
         F.concat(F.lit("Architecture reads incomplete: "), "failed")))
    gated = joined.withColumn("rejection_reasons", F.concat("rejection_reasons", extra))
    return gated.withColumn("accepted", F.size("rejection_reasons") == 0).drop("cov", "missing_required", "sufficient", "failed")


CATEGORY_KIND = {"source": "implementation", "test": "test", "design": "documentation", "overview": "documentation",
                 "manifest": "manifest"}


def required_kind_gate(selected: DataFrame, slice_kinds: DataFrame, bundles: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Violations: a selected repository without a slice of a required kind, or without a bundle."""
    kinds = sorted({CATEGORY_KIND[c] for c in params.required_categories if c in CATEGORY_KIND})
    needed = selected.select("full_name").distinct().withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    missing = needed.join(slice_kinds.select("full_name", "kind").distinct(), ["full_name", "kind"], "left_anti")
    bare = selected.select("full_name").distinct().join(bundles.select("full_name").distinct(), "full_name", "left_anti")
    return missing.select("full_name", F.concat(F.lit("missing-kind:"), "kind").alias("reason")).unionByName(
        bare.select("full_name", F.lit("no-bundle").alias("reason")))


PRACTICES = ["decisions-near-code", "upstream-tests-as-evidence", "end-to-end-example", "automatic-verification",
             "check-against-local-constraints", "remote-content-is-evidence-only"]


def infer_practices(slices: DataFrame, assessments: DataFrame) -> DataFrame:
    """Practice codes of each pack from slice paths, roles and CI evidence."""
    low = F.lower("path")
    seen = slices.groupBy("pack_id").agg(
        F.bool_or(low.rlike("architecture|design|adr")).alias("p0"),
        F.bool_or(low.rlike("test|spec") | F.coalesce(F.array_contains("evidence_roles", "test"), F.lit(False))).alias("p1"),
        F.bool_or(low.rlike("example|sample")).alias("p2"))
    ci = assessments.groupBy("pack_id").agg(F.bool_or(F.array_contains("maturity_reasons", "Automated CI workflow")).alias("p3"))
    flags = seen.join(ci, "pack_id", "full").select("pack_id", *[F.coalesce(f"p{i}", F.lit(False)).alias(f"p{i}") for i in range(4)],
                                                   F.lit(True).alias("p4"), F.lit(True).alias("p5"))
    return flags.select("pack_id", F.explode(tx.reasons(*[(F.col(f"p{i}"), name) for i, name in enumerate(PRACTICES)])).alias("practice"))


def score_matrix(scores_long: DataFrame) -> DataFrame:
    """(task_id, full_name, dimension, score) -> one column per dimension.

    One aggregate with a column per dimension: the rows of a pair become one before the shuffle where they lie together (`pivot` deals
    every row by pair and dimension first, then by pair).
    """
    dims = ["domain", "maturity", "transferability", "clarity", "design", "risk", "overall"]
    return scores_long.groupBy("task_id", "full_name").agg(*[F.max(F.when(F.col("dimension") == d, F.col("score"))).alias(d) for d in dims])
