"""Readers and row checks for landed repository data; bad rows go to a quarantine with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill import fixed_values as fv
from proofmill.functions import text as tx
from proofmill.functions.frames import stage
from proofmill.params import DEFAULT, Params

RAW_REPOSITORY = (
    "full_name string, html_url string, description string, stargazers_count double, forks_count double, "
    "open_issues_count double, size double, archived boolean, fork boolean, default_branch string, pushed_at string, "
    "created_at string, license struct<spdx_id:string>, language string, topics array<string>")
RAW_TREE = (
    "full_name string, revision string, truncated boolean, tree array<struct<path:string,type:string,sha:string,size:double>>")


def read_repositories(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return shape_repositories(spark.read.schema(RAW_REPOSITORY).format(fmt).load(path))


def read_trees(spark: SparkSession, path: str, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    return scan_trees(spark.read.schema(RAW_TREE).format(fmt).load(path))


def shape_repositories(raw: DataFrame) -> DataFrame:
    """Typed repository rows: NULL description -> '', missing topics -> [], unusable licence -> NULL."""
    spdx = F.col("license.spdx_id")
    return raw.select(
        "full_name", "html_url", F.coalesce("description", F.lit("")).alias("description"),
        F.col("stargazers_count").cast("long").alias("stars"), F.col("forks_count").cast("long").alias("forks"),
        F.col("open_issues_count").cast("long").alias("open_issues"), F.col("size").cast("long").alias("size_kb"),
        "archived", "fork", "default_branch", F.try_to_timestamp("pushed_at").alias("pushed_at"),
        F.try_to_timestamp("created_at").alias("created_at"),
        F.when(~spdx.isin("", "NOASSERTION"), spdx).alias("license"), "language",
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"))


def validate_repositories(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid raw rows and a quarantine with the reasons of each bad row."""
    texts = ["full_name", "html_url", "default_branch", "pushed_at", "created_at"]
    numbers = ["stargazers_count", "forks_count", "open_issues_count", "size"]
    no = F.lit(False)

    def bad_number(c: str) -> Column:
        return ~F.coalesce((F.col(c) >= 0) & ~F.isnan(c) & (F.col(c) != float("inf")), no)

    checks = [(F.coalesce(F.col(c), F.lit("")) == "", f"empty:{c}") for c in texts]
    checks += [(~F.coalesce(F.col("full_name").rlike(r"(?i)^[a-z0-9_.-]+/[a-z0-9_.-]+$"), no), "name-shape"),
               (~F.coalesce(F.col("html_url").rlike(r"(?i)^https?://[^/?#@\s]+([/?#].*)?$"), no), "url-shape")]
    checks += [(F.try_to_timestamp(c).isNull(), f"date:{c}") for c in ("pushed_at", "created_at")]
    checks += [(bad_number(c), f"count:{c}") for c in numbers]
    checks += [(F.col(c).isNull(), f"flag:{c}") for c in ("archived", "fork")]
    judged = raw.withColumn("reasons", tx.reasons(*checks))
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)


def scan_trees(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Explode recursive trees; a truncated tree or a bad size rejects the whole repository."""
    def bad(e: Column) -> Column:
        return (e["path"].isNull() | e["type"].isNull() | e["sha"].isNull()
                | F.coalesce((e["size"] < 0) | F.isnan(e["size"]) | (e["size"] == float("inf")), F.lit(False)))

    judged = raw.withColumn("reasons", tx.reasons(
        (F.coalesce("truncated", F.lit(False)), "tree-truncated"), (F.col("tree").isNull(), "tree-missing"),
        (F.exists("tree", bad), "tree-malformed")))
    entries = judged.filter(F.size("reasons") == 0).select("full_name", "revision", F.inline("tree"))
    good = entries.filter(F.col("type").isin("blob", "tree")).withColumn("size", F.col("size").cast("long"))
    return good, judged.filter(F.size("reasons") > 0).select("full_name", "revision", F.explode("reasons").alias("reason"))


def judged_blobs(encoded: DataFrame) -> DataFrame:
    """Every encoded file with its content, or with the reason why it has none; white space is stripped, the shape checked and the text
    decoded once per file."""
    bare = stage(encoded, bare=F.regexp_replace("encoded", f"{tx.SPACES}+", "")).drop("encoded")
    n = F.octet_length("bare")  # a text of the right shape is ASCII
    ok = (n > 0) & (n % 4 == 0) & F.col("bare").rlike(r"^[A-Za-z0-9+/]*={0,2}$")
    raw = stage(bare, raw=F.when(ok, F.struct(F.try_to_binary("bare", F.lit("base64")).cast("string").alias("text")))).drop("bare")
    judged = stage(raw, reason=F.when(F.col("raw").isNull(), "invalid-base64").when(~F.coalesce(F.is_valid_utf8("raw.text"), F.lit(False)), "invalid-utf8"))
    return judged.withColumn("content", F.when(F.col("reason").isNull(), F.col("raw.text"))).drop("raw")


def decode_blobs(encoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base64 text -> string after white space is stripped and the shape is checked; bytes that are not UTF-8 are set aside.

    Each of the two reads `judged_blobs`; who wants both in one pass reads that.
    """
    judged = judged_blobs(encoded)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null").drop("content")


def style_glob() -> str:
    """A file name pattern, of any case, that holds every name the style rules accept; files it refuses are not even listed for reading."""
    def any_case(word: str) -> str:
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)

    names = [f"*.{any_case(e)}" for e in fv.STYLE_EXTENSIONS]
    names += [f"{any_case(start)}*.{any_case(e)}" for start in fv.STYLE_CONFIG_STARTS for e in fv.STYLE_CONFIG_EXTENSIONS]
    return "{" + ",".join(names) + "}"


def read_workspaces(spark: SparkSession, root: str) -> DataFrame:
    """(workspace, path, content) of every style source below `root`/<workspace>/.

    Files are listed by name (`style_glob`), so contents of others are never read; bytes that are not UTF-8 are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", style_glob()).load(root)
    rel = F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), r"\\", "/")
    named = files.filter(rel.rlike(fv.STYLE_FILE) | rel.rlike(fv.STYLE_CONFIG))
    rows = named.select(F.substring_index(rel, "/", 1).alias("workspace"), F.regexp_replace(rel, "^[^/]*/", "").alias("path"), F.col("content").cast("string").alias("content"))
    return rows.filter(F.is_valid_utf8("content"))


def scan_workspaces(files: DataFrame, params: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Style sources by name rules outside ignored directories; with a limit, candidates beyond it are skipped."""
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    kept = (files.withColumn("path", path)
            .filter((path.rlike(fv.STYLE_FILE) | path.rlike(fv.STYLE_CONFIG))
                    & ~F.exists(folders, lambda s: s.isin(fv.STYLE_IGNORED_DIRS))))
    if params.workspace_candidates is None:
        return kept, kept.limit(0).select("workspace", "path", F.lit("maximum-candidates-reached").alias("reason"))
    w = Window.partitionBy("workspace").orderBy("path")
    ranked = kept.select("workspace", "path").withColumn("nth", F.row_number().over(w))
    inside = ranked.filter(F.col("nth") <= params.workspace_candidates).select("workspace", "path")
    # Traversal stops at the first candidate over the limit; that one is reported.
    over = ranked.filter(F.col("nth") == params.workspace_candidates + 1).select(
        "workspace", "path", F.lit("maximum-candidates-reached").alias("reason"))
    return kept.join(inside, ["workspace", "path"], "left_semi"), over


def budget_workspace_files(sources: DataFrame, params: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Keep files in path order within file and character budgets; a file that does not
    fit is skipped and later ones may still fit.

    Whether a file fits depends on every file kept before it, so the choice is one walk over a workspace's
    (path, length) pairs that remembers the kept paths only (`workspace_files` at most); reasons follow from
    running sums over what was kept, and content is joined back afterwards.
    """
    sizes = sources.select("workspace", "path", F.length("content").alias("chars"))
    w = Window.partitionBy("workspace").orderBy("path")
    bounded = sizes if params.workspace_candidates is None else sizes.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= params.workspace_candidates).drop("nth")
    listed = bounded.groupBy("workspace").agg(F.array_sort(F.collect_list(F.struct("path", "chars"))).alias("files"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"))

    def reason(n: Column, used: Column, chars: Column) -> Column:
        left = F.lit(params.workspace_characters) - used
        return (F.when(n >= params.workspace_files, "maximum-files-reached").when(left <= 0, "maximum-characters-reached")
                .when((chars > params.workspace_file_characters) | (chars > left), "file-exceeds-remaining-character-budget"))

    def step(acc: Column, f: Column) -> Column:
        fits = reason(F.size(acc["kept"]), acc["used"], f["chars"]).isNull()
        return F.when(fits, F.struct((acc["used"] + f["chars"]).alias("used"), F.array_append(acc["kept"], f["path"]).alias("kept"))).otherwise(acc)

    chosen = listed.select("workspace", F.explode(F.aggregate("files", start, step)["kept"]).alias("path")).withColumn("kept", F.lit(1))
    marked = bounded.join(chosen, ["workspace", "path"], "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    judged = marked.withColumns({"n": F.coalesce(F.sum("kept").over(before), F.lit(0)), "used": F.coalesce(F.sum(F.col("kept") * F.col("chars")).over(before), F.lit(0))})
    judged = judged.select("workspace", "path", F.when(F.col("kept") == 0, reason(F.col("n"), F.col("used"), F.col("chars"))).alias("reason"))
    kept = sources.join(judged.filter("reason is null").select("workspace", "path"), ["workspace", "path"], "left_semi")
    return kept, judged.filter("reason is not null")
