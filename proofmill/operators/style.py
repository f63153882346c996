"""Style inventory and audit over markup and CSS corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill import fixed_values as fv
from proofmill.functions import text as tx
from proofmill.sources.sinks import landed

CLASS_ATTRIBUTE = r"(?i)(?<![A-Za-z0-9_])" + fv.CLASS_ATTRIBUTE
COLOR = fv.COLOR_LITERAL.replace("(?:WORD_END)", r"(?![A-Za-z0-9_])")


def _all(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all("content", F.lit(pattern), F.lit(group))


def _class_list(content: str = "content") -> Column:
    attributes = F.regexp_extract_all(content, F.lit(CLASS_ATTRIBUTE), F.lit(0))
    values = F.transform(attributes, lambda a: F.concat(*[F.regexp_extract(a, CLASS_ATTRIBUTE, g) for g in (1, 2, 3)]))
    return F.filter(F.flatten(F.transform(values, lambda x: F.split(x, f"{tx.SPACES}+"))), lambda t: t != "")


def class_tokens(sources: DataFrame) -> DataFrame:
    """One row per token of a static class attribute."""
    return sources.select("workspace", "path", F.explode(_class_list()).alias("token"))


def style_variables(sources: DataFrame) -> DataFrame:
    """Variable -> value per workspace; the last definition by (path, position) wins."""
    found = sources.select("workspace", "path", F.posexplode(F.arrays_zip(
        _all(fv.VARIABLE_DEFINITION, 1).alias("name"), _all(fv.VARIABLE_DEFINITION, 2).alias("value"))).alias("pos", "d"))
    return found.groupBy("workspace", F.lower("d.name").alias("variable")).agg(
        F.max_by(tx.trimmed(F.col("d.value")), F.struct("path", "pos")).alias("value"))


def resolve_style_vars(sources: DataFrame) -> DataFrame:
    """Background values per file, with `var(--x)` replaced through the workspace table."""
    raw = sources.select("workspace", "path", F.posexplode(_all(fv.BACKGROUND)).alias("pos", "raw")).filter("raw <> ''")
    only_var = r"(?i)^var\(\s*(--[a-z0-9_-]+)\s*\)$"
    variable = F.nullif(F.regexp_extract(tx.trimmed(F.col("raw")), only_var, 1), F.lit(""))
    raw = raw.withColumn("named", variable).withColumn("variable", F.lower("named"))
    joined = raw.join(style_variables(sources), ["workspace", "variable"], "left")
    resolved = F.when(F.col("variable").isNull(), F.col("raw")).otherwise(F.col("value"))
    label = F.when(F.col("variable").isNull(), F.col("raw")).otherwise(F.concat("named", F.lit(" -> "), "value"))
    return joined.select("workspace", "path", "pos", label.alias("label"), resolved.alias("resolved")).filter("resolved is not null")


def style_values(sources: DataFrame) -> DataFrame:
    """(workspace, path, bucket, value): every style signal occurrence, values normalised."""
    classes = _class_list()

    def tokens(pattern: str) -> Column:
        return F.filter("classes", lambda t: t.rlike(pattern))

    buckets = {
        "custom-property-definitions": _all(r"(?i)(--[a-z0-9_-]+)\s*:\s*[^;}{]{1,160}"),
        "custom-property-references": _all(fv.VARIABLE_REFERENCE),
        "colors": _all(COLOR),
        "font-sizes": F.concat(_all(fv.FONT_SIZE), tokens(fv.CLASS_FONT_SIZE)),
        "radii": F.concat(_all(fv.BORDER_RADIUS), tokens(fv.CLASS_RADIUS)),
        "pure-black-backgrounds": tokens(fv.CLASS_BLACK),
        "near-black-backgrounds": tokens(fv.CLASS_NEAR_BLACK),
        "border-declarations": F.concat(_all(r"(?i)(?<![A-Za-z0-9_])(border(?:-[a-z]+)?)\s*:"), tokens(fv.CLASS_BORDER)),
        "shadows": F.concat(_all(r"(?i)(box-shadow)\s*:"), tokens(fv.CLASS_SHADOW)),
        "gradients": F.concat(_all(r"(?i)(?<![A-Za-z0-9_])((?:linear|radial|conic)-gradient)(?![A-Za-z0-9_])"),
                              tokens(fv.CLASS_GRADIENT)),
        "responsive-signals": F.concat(_all(r"(?i)(@media)\s*\("), tokens(fv.CLASS_RESPONSIVE)),
        "card-like-references": _all(rf"(?i)(?<![A-Za-z0-9_])({fv.CARD_WORDS})(?![A-Za-z0-9_])"),
    }
    rows = F.flatten(F.array(*[_tagged(name, values) for name, values in buckets.items()]))
    plain = (sources.select("workspace", "path", "content", classes.alias("classes"))
             .select("workspace", "path", F.explode(rows).alias("r")).select("workspace", "path", "r.bucket", "r.value"))
    backgrounds = resolve_style_vars(sources).withColumn("c", tx.style_color(F.col("resolved")))
    dark = backgrounds.filter("c.pure_black or c.near_black").select(
        "workspace", "path", F.when(F.col("c.pure_black"), "pure-black-backgrounds").otherwise("near-black-backgrounds").alias("bucket"),
        F.col("label").alias("value"))
    every = plain.unionByName(dark)
    return every.withColumn("value", F.lower(tx.collapsed(F.col("value")))).filter("value <> ''")


def _tagged(bucket: str, values: Column) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(bucket).alias("bucket"), x.alias("value")))


def style_metrics(sources: DataFrame) -> DataFrame:
    """Count and number of files per workspace, bucket and value."""
    per_file = style_values(sources).groupBy("workspace", "bucket", "value", "path").agg(F.count("*").alias("n"))
    return per_file.groupBy("workspace", "bucket", "value").agg(F.sum("n").alias("count"), F.count("*").alias("files"))


def style_metric_paths(sources: DataFrame) -> DataFrame:
    """The distinct files behind each metric, one row each."""
    return style_values(sources).select("workspace", "bucket", "value", "path").distinct()


def _profiles() -> Column:
    rows = [F.struct(F.lit(p).alias("profile"), F.lit(b).alias("max_borders"), F.lit(c).alias("max_cards"), F.lit(t).alias("min_types"),
                     F.lit(float(r)).alias("max_share"), F.lit(g).alias("gradient_policy"))
            for p, (b, c, t, r, g) in fv.STYLE_PROFILES.items()]
    return F.array(*rows)


def workspace_facts(sources: DataFrame, metrics: DataFrame) -> DataFrame:
    """The totals the audit rules look at, one row per workspace."""
    def total(bucket: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("bucket") == bucket, F.col("count"))), F.lit(0))

    def kinds(bucket: str) -> Column:
        return F.count(F.when(F.col("bucket") == bucket, 1))

    radius = F.col("bucket") == "radii"
    facts = metrics.groupBy("workspace").agg(
        total("border-declarations").alias("borders"), total("card-like-references").alias("cards"),
        total("gradients").alias("gradients"), total("radii").alias("radii"),
        F.coalesce(F.max(F.when(radius, F.col("count"))), F.lit(0)).alias("top_radius"),
        kinds("font-sizes").alias("types"), kinds("responsive-signals").alias("responsive"), kinds("colors").alias("colors"),
        kinds("custom-property-references").alias("tokens"), kinds("pure-black-backgrounds").alias("black"),
        kinds("near-black-backgrounds").alias("near"))
    files = sources.groupBy("workspace").agg(F.count("*").alias("files"))
    return files.join(facts, "workspace", "full").na.fill(0)


def style_audit(facts: DataFrame) -> DataFrame:
    """Findings of every workspace against every profile."""
    rows = facts.withColumn("p", F.explode(_profiles())).select("*", "p.*")
    some = F.col("files") > 0
    found = tx.reasons(
        (F.col("files") == 0, "no-local-visual-sources"), (F.col("black") > 0, "pure-black-surface"), (F.col("near") > 0, "near-black-surface"),
        (F.col("borders") > F.col("max_borders"), "border-heavy-surface"), (F.col("cards") > F.col("max_cards"), "card-grid-saturation"),
        ((F.col("radii") >= 5) & (F.col("top_radius") / F.greatest("radii", F.lit(1)) > F.col("max_share")), "uniform-radius-repetition"),
        (some & (F.col("types") < F.col("min_types")), "weak-type-hierarchy"), (some & (F.col("responsive") == 0), "responsive-evidence-missing"),
        ((F.col("gradient_policy") == "avoid") & (F.col("gradients") > 0), "profile-gradient-mismatch"),
        ((F.col("colors") > 10) & (F.col("tokens") < 3), "raw-color-sprawl"))
    severity = F.when(F.col("signal") == "no-local-visual-sources", "info").when(F.col("signal") == "pure-black-surface", "error").otherwise("warning")
    return rows.select("workspace", "profile", F.explode(found).alias("signal")).withColumn("severity", severity)


def audit_status(facts: DataFrame, findings: DataFrame) -> DataFrame:
    worst = findings.groupBy("workspace", "profile").agg(
        F.bool_or(F.col("severity") == "error").alias("error"), F.bool_or(F.col("severity") == "warning").alias("warning"))
    every = facts.select("workspace", F.explode(F.array(*[F.lit(p) for p in fv.STYLE_PROFILES])).alias("profile"))
    return every.join(worst, ["workspace", "profile"], "left").select(
        "workspace", "profile", F.when(F.col("error"), "blocked").when(F.col("warning"), "review").otherwise("clean").alias("status"))


SPEC_LIMITS = {"colors": 8, "font-sizes": 8, "radii": 6}


def style_spec_facts(metrics: DataFrame) -> DataFrame:
    """Leading colours, type sizes and radii of a workspace, plus token count and responsiveness.

    The metrics are landed and read from there, as they come from whole texts; all buckets are ranked together.
    """
    metrics = landed(metrics.select("workspace", "bucket", "value", "count"), "style-metrics")
    w = Window.partitionBy("workspace", "bucket").orderBy(F.desc("count"), "value")
    limit = F.create_map(*[F.lit(x) for kv in SPEC_LIMITS.items() for x in kv])[F.col("bucket")]
    tops = metrics.filter(F.col("bucket").isin(*SPEC_LIMITS)).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max(SPEC_LIMITS.values())).filter(F.col("rn") <= limit)

    def listed(bucket: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("bucket") == bucket, F.struct("rn", "value"))))
        return F.transform(rows, lambda s: s["value"])

    lists = tops.groupBy("workspace").agg(*[listed(b).alias(b.replace("-", "_")) for b in SPEC_LIMITS])
    flags = metrics.groupBy("workspace").agg(
        F.count(F.when(F.col("bucket") == "custom-property-definitions", 1)).alias("custom_properties"),
        F.bool_or(F.col("bucket") == "responsive-signals").alias("responsive"))
    return flags.join(lists, "workspace", "left")


def route_visual_tasks(tasks: DataFrame, text: Column) -> DataFrame:
    """Style or software route of each task, from four weighted signals."""
    def hit(ascii_words: str, plain: str) -> Column:
        return text.rlike(tx.ascii_word(ascii_words, "(?i)") + "|" + plain)

    signals = {name: (hit(words, plain), points) for name, points, words, plain in fv.VISUAL_SIGNALS}
    score = F.lit(0)
    for cond, points in signals.values():
        score = score + F.when(cond, points).otherwise(0)
    score = F.least(F.lit(100), score).cast("long")
    explicit, surface, stack, quality = [signals[n][0] for n in signals]
    visual = (explicit | (surface & (stack | quality))) & (score >= fv.VISUAL_ROUTE_THRESHOLD)
    archetype = None
    for name, words, plain in fv.VISUAL_ARCHETYPES:
        archetype = F.when(hit(words, plain), name) if archetype is None else archetype.when(hit(words, plain), name)
    return tasks.select("task_id", score.alias("score"), F.when(visual, "visual-style").otherwise("software-precedent").alias("route"),
                        tx.reasons(*[(cond, n) for n, (cond, _p) in signals.items()]).alias("signals"),
                        F.when(visual, archetype.otherwise(fv.DEFAULT_ARCHETYPE)).alias("archetype"))
