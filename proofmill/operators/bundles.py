"""Evidence bundles: per-concern candidate slices, a diverse pick, and the kinds they cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill import fixed_values as fv
from proofmill.functions import paths as pt
from proofmill.functions import text as tx
from proofmill.functions.frames import stage
from proofmill.operators.intervals import EDGE, interval_cover
from proofmill.operators.structure import cap_per_group
from proofmill.operators.windows import diverse_slices
from proofmill.params import DEFAULT, Params

FAILURE = tx.ascii_word(fv.FAILURE_WORDS, "(?i)")
CONCERNS = ["system-architecture", "technology-selection", "testing-strategy", "failure-semantics", "module-boundary"]


def _flag(paths: DataFrame, name: str) -> DataFrame:
    return paths.select("full_name", "path").distinct().withColumn(name, F.lit(True))


def _ancestors(p):
    parts = F.split(p, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def bundle_candidates(slices: DataFrame, tree: DataFrame, entries: DataFrame, tests: DataFrame, relations: DataFrame, modules: DataFrame) -> DataFrame:
    """Slices per (repository, concern, discriminator), content not carried."""
    p = F.col("path")
    ends = relations.select("full_name", "kind", F.explode(F.array("src", "dst")).alias("path"))
    flagged = (slices.withColumns({
        "arch": pt.is_arch_doc(p), "manifest": p.rlike(fv.MANIFEST_FILE), "decision": p.rlike(fv.DESIGN_DECISION),
        "support": pt.is_test_support(p), "failing": F.col("content").rlike(FAILURE)}).drop("content")
        .join(_flag(entries, "entry"), ["full_name", "path"], "left").join(_flag(tests, "tested"), ["full_name", "path"], "left")
        .join(_flag(ends.filter("kind = 'tests'"), "target"), ["full_name", "path"], "left").na.fill(False, ["entry", "tested", "target"]))
    c = F.col
    concerns = tx.reasons((c("arch") | c("entry") | c("manifest") | c("tested"), CONCERNS[0]), (c("manifest") | c("decision"), CONCERNS[1]),
                          (c("tested") | c("support") | c("target") | c("arch"), CONCERNS[2]), (c("failing"), CONCERNS[3]))
    short = F.element_at(F.create_map(*[F.lit(x) for pair in zip(CONCERNS, ("system", "technology", "testing", "failure")) for x in pair]), F.col("concern"))
    fixed = flagged.withColumn("concern", F.explode(concerns)).withColumn("discriminator", short)
    # Modules: a slice belongs to every module root above it and to modules its edges touch.
    roots = modules.filter(F.col("kind").isin("application", "library", "package")).select("full_name", "root")
    under = slices.select("full_name", "path").distinct().withColumn("root", F.explode(_ancestors(p))).join(roots, ["full_name", "root"])
    edge = relations.select("full_name", "src", "dst").distinct()
    touch = edge.select("full_name", "src", "dst", F.explode(F.array("src", "dst")).alias("path")).withColumn(
        "root", F.explode(F.filter(_ancestors(p), lambda r: r != p))).join(roots, ["full_name", "root"])
    touched = touch.select("full_name", F.explode(F.array("src", "dst")).alias("path"), "root")
    members = under.select("full_name", "path", "root").union(touched.select("full_name", "path", "root")).distinct()
    module = flagged.join(members, ["full_name", "path"]).withColumn("concern", F.lit(CONCERNS[4])).withColumnRenamed("root", "discriminator")
    columns = ["full_name", "revision", "concern", "discriminator", "slice_id", "path", "start_line", "end_line", "relevance", "strategy", "evidence_roles", "architecture_roles", "decision"]
    return fixed.select(*columns).unionByName(module.select(*columns))


def build_bundles(candidates: DataFrame, relations: DataFrame, atlases: DataFrame, params: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(bundles, bundle_slices): diverse picks with enough kinds, capped in creation order."""
    keys = ["full_name", "concern", "discriminator"]
    picked = diverse_slices(candidates, keys, params.slices_per_bundle)
    pinned = atlases.select("full_name", F.col("revision").alias("pin")).distinct()
    picked = picked.join(pinned, "full_name").withColumn(
        "bundle_id", tx.stable_id(F.col("full_name"), F.col("pin"), F.col("concern"), F.col("discriminator")))
    # Edges count only when this bundle's own slices cover their lines and hold their target.
    edges = stage(relations.select(*EDGE, "revision", "evidence_path"), a=tx.line_anchor(F.col("source_url"))).filter(
        (F.col("evidence_path") == F.col("src")) & F.col("a.start_line").isNotNull())
    at_pin = picked.filter("revision = pin")
    holders = at_pin.select("bundle_id", "full_name", F.col("path").alias("src")).distinct()
    cited = edges.join(holders, ["full_name", "src"]).select("bundle_id", *EDGE, "revision", F.col("src").alias("path"), "a.start_line", "a.end_line")
    covered = interval_cover(cited, at_pin, ["bundle_id", *EDGE], within=["bundle_id"]).select("bundle_id", *EDGE)
    targets = at_pin.select("bundle_id", F.col("path").alias("dst")).distinct()
    related = covered.join(targets, ["bundle_id", "dst"]).groupBy("bundle_id").agg(F.count("*").alias("relations"))
    kinds = picked.select("bundle_id", F.explode(pt.slice_kinds(F.col("path"), F.col("evidence_roles"), F.col("architecture_roles"))).alias("kind"))
    summary = picked.groupBy("bundle_id", *keys).agg(F.bool_or("decision").alias("explicit"), F.count("*").alias("slices"))
    kinds = kinds.groupBy("bundle_id").agg(F.collect_set("kind").alias("kinds"))  # six kinds exist
    j = summary.join(kinds, "bundle_id").join(related, "bundle_id", "left").withColumn("relations", F.coalesce("relations", F.lit(0)))
    every = F.array_sort(F.array_distinct(F.when(F.col("relations") > 0, F.array_append("kinds", F.lit("relationship"))).otherwise(F.col("kinds"))))
    j = stage(j, evidence_kinds=every).filter(F.size("evidence_kinds") >= params.min_kinds)
    order = F.array_position(F.array(*[F.lit(c) for c in CONCERNS]), F.col("concern"))
    kept = cap_per_group(j, ["full_name"], [order, "discriminator"], params.bundles_per_repository)
    limits = tx.reasons((~F.col("explicit"), "no-explicit-rationale"), (F.col("relations") == 0, "no-resolved-relation"),
                        (~F.array_contains("evidence_kinds", "test"), "no-direct-test"))
    bundles = kept.select("bundle_id", *keys, F.when(F.col("explicit"), "explicit").otherwise("observed").alias("ceiling"), "evidence_kinds",
                          "slices", "relations", limits.alias("limitations"))
    return bundles, picked.join(kept.select("bundle_id"), "bundle_id", "left_semi").select("bundle_id", "full_name", "slice_id", "path", "start_line", "place")


def bundle_membership(item_slices: DataFrame, bundle_slices: DataFrame, item: str) -> DataFrame:
    """Distinct (item, bundle) pairs that share a slice."""
    return item_slices.select(item, "slice_id").join(bundle_slices.select("bundle_id", "slice_id"), "slice_id").select(item, "bundle_id").distinct()
