"""Reading order and line windows: which files to look at, and which lines of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill import fixed_values as fv
from proofmill.functions import paths as pt
from proofmill.functions import text as tx
from proofmill.functions.frames import at_most, stage
from proofmill.operators.intervals import BUCKET, buckets, semantic_window
from proofmill.operators.structure import cap_per_group, category_paths, parsed_files
from proofmill.params import DEFAULT, Params
from proofmill.sources.sinks import landed

REPO = ["full_name"]
NO_TEXT = "cast(array() as array<string>)"


def listed_terms(terms: DataFrame) -> DataFrame:
    """The lower-cased terms of each repository as one short array."""
    return terms.groupBy(*REPO).agg(F.array_sort(F.collect_set(F.lower("term"))).alias("terms"))


def with_listed(df: DataFrame, listed: DataFrame) -> DataFrame:
    return df.join(listed, REPO, "left").withColumn("terms", F.coalesce("terms", F.expr(NO_TEXT)))


def with_terms(df: DataFrame, terms: DataFrame) -> DataFrame:
    """Attach the lower-cased terms of each repository as one short array."""
    return with_listed(df, listed_terms(terms))


def _matches(text: Column) -> Column:
    return F.filter("terms", lambda t: F.contains(text, t))


def is_public(name: Column, language: Column, visibility: Column) -> Column:
    return ~name.startswith("_") & ((language != "rust") | F.coalesce(visibility, F.lit("")).startswith("pub"))


def told(symbols: DataFrame, name: str, default: str) -> Column:
    """A column that only some parsers give (exported, error_signals, variants), or its default."""
    return F.coalesce(F.col(name), F.expr(default)) if name in symbols.columns else F.expr(default)


def public_surface(symbols: DataFrame) -> Column:
    """Whether a declaration is exported by name, or public by the rules of its language."""
    return told(symbols, "exported", "false") | is_public(F.col("name"), F.col("language"), F.col("visibility"))


def failure_signals(symbols: DataFrame) -> Column:
    """What a declaration raises, catches or signals as an error: sorted distinct names."""
    return F.array_sort(F.array_distinct(F.concat("raises", "catches", told(symbols, "error_signals", NO_TEXT))))


def semantic_roles(symbols: DataFrame) -> Column:
    """contract, invariant, failure, test roles of a parsed declaration."""
    fails = (F.size(failure_signals(symbols)) > 0) | (F.col("unsafe_count") > 0)
    return tx.reasons(
        ((F.col("role") == "implementation") & (F.col("kind") != "module") & public_surface(symbols), "contract"),
        (F.col("assertion_count") > 0, "invariant"), (fails, "failure"),
        ((F.col("role") == "test") & F.coalesce("has_body", F.lit(True)), "test"))


def inspected_roles(symbols: DataFrame) -> Column:
    """The roles that reading a file shows: as `semantic_roles`, but neither private members nor test classes count."""
    hidden = F.coalesce(F.col("visibility").isin("private", "protected"), F.lit(False))
    return F.filter(semantic_roles(symbols), lambda r: ~((r == "contract") & hidden) & ~((r == "test") & (F.col("kind") == "class")))


def architecture_roles(symbols: DataFrame) -> Column:
    """The second role set, used for supplements of one file."""
    fails = (F.size(failure_signals(symbols)) > 0) | (F.col("unsafe_count") > 0)
    return tx.reasons(
        (F.col("kind").isin("class", "struct", "union", "enum", "trait", "impl", "type"), "contract"),
        ((F.size("fields") > 0) | (F.size(told(symbols, "variants", NO_TEXT)) > 0), "data-model"),
        (fails, "failure"), (F.col("kind").isin("trait", "impl") | F.exists("bases", lambda b: b.rlike("(?i)protocol|abstract|abc")), "extension-point"),
        (F.col("role").isin("test", "fixture"), "test"))


def _structural_score() -> Column:
    p = F.col("path")
    return (F.when(p.rlike(fv.MANIFEST_FILE), 100).otherwise(0) + F.when(p.rlike(fv.ENTRY_FILE) & ~pt.is_marker(p), 60).otherwise(0)
            + F.when(F.size(_matches(F.lower(p))) > 0, 30).otherwise(0) + F.when(pt.is_test(p), 10).otherwise(0) - pt.depth(p)).cast("long")


def rank_structural_files(tree: DataFrame, terms: DataFrame, limit: int | None = None) -> DataFrame:
    """Structural read order of each repository."""
    p = F.col("path")
    wanted = (p.rlike(fv.MANIFEST_FILE) | pt.is_implementation(p) | (pt.is_test(p) & pt.is_code(p)) | pt.is_test_support(p)
              | p.rlike(fv.OVERVIEW_FILE) | p.rlike(fv.DESIGN_FILE) | p.rlike(fv.SECURITY_FILE) | p.rlike(fv.AUTOMATION_FILE))
    scored = with_terms(tree.filter((F.col("type") == "blob") & wanted).select("full_name", "path", "size"), terms).withColumn("score", _structural_score())
    w = Window.partitionBy(*REPO).orderBy(F.desc("score"), "path")
    out = scored.withColumn("read_rank", F.row_number().over(w).cast("long"))
    return (out if limit is None else out.filter(F.col("read_rank") <= limit)).select("full_name", "path", "size", "score", "read_rank")


def rank_slice_paths(eligible: DataFrame, terms: DataFrame, preferred: DataFrame) -> DataFrame:
    """Score and reason of every slice-eligible path; those below 5 are dropped."""
    p = F.col("path")
    low = F.lower(p)
    flagged = eligible.join(preferred.select("full_name", "path").distinct().withColumn("preferred", F.lit(True)), ["full_name", "path"], "left")
    rows = stage(with_terms(flagged, terms), found=_matches(low))
    facts = [(F.coalesce("preferred", F.lit(False)), 16.0, "design-atlas structural evidence"), (F.size("found") > 0, 0.0, None),
             (low.rlike(fv.SLICE_DESIGN), 35.0, "design documentation"), (low.rlike(fv.OVERVIEW_FILE), 28.0, "project overview"),
             (p.rlike(fv.EXAMPLE_TREE), 18.0, "usage example"), (pt.is_test(p), 12.0, "behavioral evidence"),
             (pt.is_test_support(p), 6.0, "test-support evidence, not a test case"), (pt.is_implementation(p), 8.0, "implementation source")]
    score = F.size("found") * 20.0 - pt.depth(p) * 0.5
    for cond, points, _label in facts:
        score = score + F.when(cond, points).otherwise(0.0)
    named = F.concat(F.lit("path matches "), F.array_join("found", ", "))
    why = F.array_join(tx.reasons(*[(c, named if label is None else label) for c, _pts, label in facts]), "; ")
    return rows.select("full_name", "path", score.alias("score"), F.when(why == "", "representative source").otherwise(why).alias("reason"),
                       pt.is_marker(p).alias("marker"), pt.modality(p).alias("modality")).filter("score >= 5")


def slice_read_candidates(ranked: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The files each modality may contribute: never more than the whole read budget."""
    w = Window.partitionBy("full_name", "modality").orderBy("marker", F.desc("score"), "path")
    out = ranked.withColumn("modality_rank", F.row_number().over(w).cast("long"))
    return out.filter(at_most(F.col("modality_rank"), params.files_per_repository))


READ_ORDER = ["source", "test", "manifest", "overview", "design", "automation"]


def top_files_per_category(ranked: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Rotate over categories, best file first, within the file and character budgets."""
    cats = category_paths(ranked.select("full_name", "path")).join(ranked.select("full_name", "path", "size", "read_rank"), ["full_name", "path"])
    w = Window.partitionBy("full_name", "category").orderBy("read_rank")
    top = cats.withColumn("nth", F.row_number().over(w)).filter(at_most(F.col("nth"), params.atlas_files))
    order = F.array_position(F.array(*[F.lit(c) for c in READ_ORDER]), F.col("category"))
    turn = top.groupBy("full_name", "path", "size").agg(F.min(F.struct("nth", order.alias("turn"))).alias("slot"))
    by_turn = Window.partitionBy(*REPO).orderBy("slot.nth", "slot.turn", "path")
    read = turn.withColumn("read_order", F.row_number().over(by_turn).cast("long")).filter(at_most(F.col("read_order"), params.atlas_files))
    before = Window.partitionBy(*REPO).orderBy("read_order").rowsBetween(Window.unboundedPreceding, -1)
    if params.atlas_characters is None:
        return read.select("full_name", "path", "read_order", F.col("size").alias("chars"), F.lit(False).alias("truncated"))
    left = F.lit(params.atlas_characters) - F.coalesce(F.sum("size").over(before), F.lit(0))
    out = read.withColumn("left", left).filter("left > 0")
    return out.select("full_name", "path", "read_order", F.least("left", "size").alias("chars"), (F.col("left") < F.col("size")).alias("truncated"))


STRUCTURE = rf"(?<![A-Za-z0-9_])({fv.STRUCTURE_WORDS})(?![A-Za-z0-9_])"


def best_line_window(blobs: DataFrame, terms: DataFrame, max_lines: int = 60) -> DataFrame:
    """Best window of each file: whole when short, else the earliest best-scoring stride."""
    rows = stage(with_terms(blobs, terms), all_lines=tx.lines(F.col("content")))
    n = F.size("all_lines")
    stride = max(10, max_lines // 2)

    def scored(start: Column) -> Column:
        return F.lower(F.array_join(F.slice("all_lines", start + 1, max_lines), "\n"))

    def rating(text: Column, start: Column) -> Column:
        hits = F.size(F.filter("terms", lambda t: F.contains(text, t))) * 4
        words = F.size(F.regexp_extract_all(text, F.lit(STRUCTURE), F.lit(1)))
        return F.struct((hits + F.least(F.lit(12), words)).alias("score"), (-start).alias("start"))

    starts = F.when(n > max_lines, F.sequence(F.lit(0), n - 1, F.lit(stride))).otherwise(F.expr("cast(array() as array<int>)"))
    texts = F.transform(starts, lambda s: F.struct(s.alias("at"), scored(s).alias("text")))
    rows = stage(rows, best=F.array_max(F.transform(texts, lambda x: rating(x["text"], x["at"]))))
    start = F.coalesce(-F.col("best.start"), F.lit(0))
    return rows.select("full_name", "revision", "path", (start + 1).cast("long").alias("start_line"),
                       F.least(start + max_lines, n).cast("long").alias("end_line"),
                       F.coalesce("best.score", F.lit(1)).cast("long").alias("relevance"))


def with_text(rows: DataFrame, texts: DataFrame, *columns: str) -> DataFrame:
    """Line ranges of files with their `text`, the number of lines of the file and `columns` of it.

    The ranges of a file meet its lines as one list, so the lines are not copied to every range.
    """
    file = ["full_name", "path"]
    own = [c for c in rows.columns if c not in file]
    listed = rows.groupBy(*file).agg(F.collect_list(F.struct(*own)).alias("ranges"))
    lined = texts.select(*file, *columns, tx.lines(F.col("content")).alias("all_lines"))

    def cut(r: Column) -> Column:
        text = F.array_join(F.slice("all_lines", r["start_line"].cast("int"), (r["end_line"] - r["start_line"] + 1).cast("int")), "\n")
        return F.struct(*[r[c].alias(c) for c in own], F.size("all_lines").alias("file_lines"), text.alias("text"))

    return listed.join(lined, file).select(*file, *columns, F.inline(F.transform("ranges", cut)))


def best_symbol_window(symbols: DataFrame, blobs: DataFrame, terms: DataFrame, max_lines: int = 60) -> DataFrame:
    """Best complete declaration of each parsed file, by the rules of its language."""
    length = F.col("end_line") - F.col("start_line") + 1
    lang, kind, role, p = F.col("language"), F.col("kind"), F.col("role"), F.col("path")
    body = F.coalesce("has_body", F.lit(True))
    fits = (length <= max_lines) & (
        ((lang == "python") & (~pt.is_test(p) | ((role == "test") & (kind != "class") & body)))
        | ((lang == "rust") & (kind != "module") & ((role != "test") | body)) | ((lang == "typescript") & (length >= 2)))
    narrow = symbols.filter(fits).select("full_name", "revision", "path", "name", "kind", "language", "role", "visibility", "start_line", "end_line")
    rows = stage(with_terms(with_text(narrow, blobs), terms),
                 body_norm=tx.normalize_text(F.col("text")), name_norm=tx.normalize_text(F.col("name")))

    def phrase(where: str) -> Column:
        return F.size(F.filter("terms", lambda t: tx.contains_normalized(F.col(where), t)))

    plain_body, plain_name = F.size(_matches(F.lower("text"))), F.size(_matches(F.lower("name")))
    visible = F.coalesce("visibility", F.lit(""))
    base = phrase("name_norm") * 8 + phrase("body_norm") * 5
    rust = base + F.when(kind.isin("trait", "struct", "enum", "impl"), 4).otherwise(0) + F.when(visible == "pub", 3).otherwise(0)
    script = (plain_body * 5 + plain_name * 8 + F.when(visible == "export", 3).otherwise(0) + F.when(kind.isin("interface", "type"), 4).otherwise(0)
              + F.when(role == "test", 3).otherwise(0))
    score = F.when(lang == "python", base).when(lang == "rust", rust).otherwise(script - length * 0.01).cast("double")
    relevance = F.when(lang == "python", base).when(lang == "rust", rust).otherwise(script + 2).cast("long")
    strategy = F.when(lang == "python", "python-ast").when(lang == "rust", "rust-syntax").otherwise("typescript-ast")
    best = rows.select("full_name", "revision", "path", "name", "start_line", "end_line", score.alias("score"), relevance.alias("relevance"), strategy.alias("strategy"))
    return best.groupBy("full_name", "revision", "path").agg(F.min_by(
        F.struct("start_line", "end_line", "relevance", "strategy", "name"), F.struct(-F.col("score"), "start_line", "name")).alias("b")).select(
            "full_name", "revision", "path", "b.*")


ROLE_RELEVANCE = {"contract": 3, "data-model": 4, "failure": 6, "extension-point": 5, "test": 7}


def supplement_windows(symbols: DataFrame, primary: DataFrame, max_lines: int = 60, max_windows: int = 4) -> DataFrame:
    """Further declarations of a file for roles the primary window lacks: with it at most `max_windows` windows.

    One role after the other takes the first declaration that has it and meets no window so far.  What a file has taken is a short list
    on its rows, so every step is a minimum over the file, and all steps share one shuffle.
    """
    rows = symbols.join(primary.select("full_name", "path", F.struct(F.col("start_line").cast("long").alias("a"), F.col("end_line").cast("long").alias("b")).alias("main")), ["full_name", "path"])
    file = Window.partitionBy("full_name", "path")
    c = F.col
    hidden = ~is_public(c("name"), c("language"), c("visibility"))
    usable = F.coalesce("has_body", F.lit(True)) & (c("end_line") - c("start_line") < max_lines)
    rows = rows.select("full_name", "path", F.min("main").over(file).alias("main"), usable.alias("usable"), F.struct(
        hidden.alias("hidden"), c("start_line").cast("long").alias("start_line"), "name", c("end_line").cast("long").alias("end_line"), architecture_roles(rows).alias("roles")).alias("s"))
    inside = (c("s.start_line") >= c("main.a")) & (c("s.end_line") <= c("main.b"))
    rows = rows.withColumns({"spans": F.array("main"), "seen": F.array_compact(F.array(*[
        F.when(F.max(inside & F.array_contains("s.roles", role)).over(file), F.lit(role)) for role in fv.ARCHITECTURE_ROLES]))})
    for n, role in enumerate(fv.ARCHITECTURE_ROLES):
        apart = F.forall("spans", lambda x: (c("s.end_line") < x["a"]) | (x["b"] < c("s.start_line")))
        fits = (F.size("spans") < max(1, max_windows)) & ~F.array_contains("seen", role) & c("usable") & F.array_contains("s.roles", role) & apart
        rows = rows.withColumn(f"took{n}", F.min(F.when(fits, c("s"))).over(file))
        took = c(f"took{n}")
        rows = rows.withColumns({
            "spans": F.when(took.isNull(), c("spans")).otherwise(F.array_append("spans", F.struct(took["start_line"].alias("a"), took["end_line"].alias("b")))),
            "seen": F.when(took.isNull(), c("seen")).otherwise(F.array_union("seen", took["roles"]))})
    picks = F.array(*[F.struct(c(f"took{n}").alias("s"), F.lit(ROLE_RELEVANCE[role]).cast("long").alias("relevance"), F.lit(role).alias("role")) for n, role in enumerate(fv.ARCHITECTURE_ROLES)])
    files = rows.groupBy("full_name", "path").agg(F.first(F.filter(picks, lambda p: p["s"].isNotNull())).alias("picks"))
    return files.select("full_name", "path", F.inline("picks")).select("full_name", "path", "s.name", "s.start_line", "s.end_line", "relevance", "role")


def candidate_windows(ranked: DataFrame, blobs: DataFrame, symbols: DataFrame, imports: DataFrame, relations: DataFrame, terms: DataFrame,
                      params: Params = DEFAULT) -> DataFrame:
    """All candidate slices of the ranked files.

    Primary window, every fitting declaration, import anchors and relation anchors are
    one union; equal ranges keep the first source; roles come from the declarations a
    window holds completely.
    """
    file = ["full_name", "path"]
    m = params.lines_per_slice
    chosen = landed(ranked.select(*file, "score", F.col("reason").alias("path_reason")), "window-files")
    terms = landed(terms, "window-terms")
    texts = landed(blobs.join(chosen.select(*file), file, "left_semi").filter(~F.contains("content", F.lit("\u0000"))), "window-texts")
    sym = landed(symbols.join(chosen.select(*file), file, "left_semi"), "window-declarations")
    parsed = parsed_files(sym).select(*file, F.lit(True).alias("parsed"))
    semantic = landed(best_symbol_window(sym, texts, terms, m), "window-semantic")
    plain = best_line_window(texts.join(semantic.select(*file), file, "left_anti"), terms, m)
    columns = [*file, "start_line", "end_line", "relevance", "strategy", "origin"]
    strategy = F.when(F.col("language") == "python", "python-ast").when(F.col("language") == "rust", "rust-syntax").otherwise("typescript-ast")
    declared = sym.filter((F.col("kind") != "module") & ~((F.col("role") == "test") & ~F.coalesce("has_body", F.lit(True))))
    anchors = landed(imports.join(chosen.select(*file), file, "left_semi").join(parsed, file, "left_semi").select(*file, "line"), "window-anchors")
    edge = stage(relations.select("full_name", F.col("src").alias("path"), "source_url"), a=tx.line_anchor(F.col("source_url")))
    union = (semantic.withColumn("origin", F.lit(0)).select(*columns)
             .unionByName(plain.withColumns({"strategy": F.lit("line-window"), "origin": F.lit(0)}).select(*columns))
             .unionByName(declared.withColumns({"relevance": (F.size(semantic_roles(declared)) * 5).cast("long"), "strategy": strategy, "origin": F.lit(1)}).select(*columns))
             .unionByName(anchors.select(*file, F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.lit(2).cast("long").alias("relevance"),
                                         F.lit("line-window").alias("strategy"), F.lit(2).alias("origin")))
             .unionByName(edge.filter("a.start_line is not null").select(*file, "a.start_line", "a.end_line", F.lit(2).cast("long").alias("relevance"),
                                                                        F.lit("line-window").alias("strategy"), F.lit(3).alias("origin"))))
    valid = union.filter((F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")) & (F.col("end_line") - F.col("start_line") < m))
    span = [*file, "start_line", "end_line"]
    first = valid.groupBy(*span).agg(F.min_by(F.struct("relevance", "strategy"), F.struct("origin", -F.col("relevance"), "strategy")).alias("w")).select(*span, "w.*")
    first = landed(first, "window-spans")
    # Declarations inside a window and anchors in it: both start in one 64-line block of the window, so they meet by file and block.
    blocks = first.select(*span, buckets(F.col("start_line"), F.col("end_line")).alias("block"))
    block = lambda line: F.floor(F.col(line) / BUCKET)
    inner = sym.select(*file, F.col("start_line").alias("s"), F.col("end_line").alias("e"), "role", "kind", semantic_roles(sym).alias("roles"),
                       F.coalesce("has_body", F.lit(True)).alias("body"))
    held = blocks.join(inner.withColumn("block", block("s")), [*file, "block"]).filter((F.col("s") >= F.col("start_line")) & (F.col("e") <= F.col("end_line"))).groupBy(*span).agg(
        F.count("*").alias("held"), F.array_distinct(F.flatten(F.collect_list("roles"))).alias("roles"),
        F.bool_or((F.col("role") == "implementation") & (F.col("kind") != "module")).alias("impl"), F.bool_or(F.col("role") == "test").alias("test"),
        F.bool_or((F.col("role") == "test") & F.col("body")).alias("bodied_test"), F.bool_or((F.col("role") == "test") & F.col("body") & (F.col("kind") != "class")).alias("test_function"))
    anchored = blocks.join(anchors.select(*file, "line", block("line").alias("block")), [*file, "block"]).filter((F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line"))).select(
        *span).distinct().withColumn("anchor", F.lit(True))
    has_test = sym.groupBy(*file).agg(F.bool_or(F.col("role") == "test").alias("file_has_test"))
    rows = (first.join(held, span, "left").join(anchored, span, "left").join(parsed, file, "left").join(has_test, file, "left").join(chosen, file)
            .na.fill(False, ["impl", "test", "bodied_test", "test_function", "anchor", "parsed", "file_has_test"]).na.fill(0, ["held"]))
    rows = with_text(rows, texts, "revision").filter(F.col("end_line") <= F.col("file_lines")).withColumnRenamed("text", "content")
    rows = rows.filter(~tx.is_blank(F.col("content")))
    p, c = F.col("path"), F.col("content")
    rust, python = p.rlike(fv.RUST_FILE), p.rlike(fv.PYTHON_FILE)
    text_test = F.when(rust, c.rlike(fv.RUST_TEST_FUNCTION) & c.rlike(fv.RUST_ASSERTION)).when(python, c.rlike(fv.PYTHON_TEST_FUNCTION) & c.rlike(fv.PYTHON_ASSERTION)).otherwise(True)
    evidence = F.when(F.col("parsed") & rust, F.col("bodied_test")).when(F.col("parsed") & python, F.col("test_function")).otherwise(text_test)
    keep = (~(python & pt.is_test(p) & (F.col("strategy") != "python-ast") & ~evidence)
            & ~(rust & F.col("file_has_test") & (F.col("strategy") != "rust-syntax") & ~F.col("anchor"))
            & ~((F.col("held") == 0) & ~F.col("anchor") & F.col("parsed")) & ~(pt.is_test(p) & ~evidence & ~F.col("anchor")))
    roles = F.array_distinct(F.concat(F.coalesce("roles", F.expr(NO_TEXT)), F.when(F.col("anchor"), F.array(F.lit("relationship"))).otherwise(F.expr(NO_TEXT))))
    return rows.filter(keep).select(
        tx.stable_id(F.col("full_name"), F.col("revision"), p, F.col("start_line"), F.col("end_line")).alias("slice_id"), "full_name", "revision", "path",
        "start_line", "end_line", F.round(F.col("score") + F.col("relevance")).cast("long").alias("relevance"), "strategy",
        F.when(F.col("parsed"), tx.reasons((F.col("test"), "test"), (F.col("impl"), "implementation"))).alias("evidence_roles"),
        F.array_sort(roles).alias("architecture_roles"), "content")


def dedupe_slices(slices: DataFrame, relations: DataFrame) -> DataFrame:
    """(slice_id, status): kept, duplicate or low-value.

    Same kinds, endpoint path and trimmed content are one group; its winner is a
    partial aggregate, so a hot group of copies shrinks before the shuffle, and the
    join back is by group key.  Contents are read once, as hashes that are landed.
    """
    ends = relations.select("full_name", F.col("src").alias("path")).union(relations.select("full_name", F.col("dst").alias("path"))).distinct().withColumn("endpoint", F.col("path"))
    kinds = F.array_join(F.array_sort(pt.slice_kinds(F.col("path"), F.col("evidence_roles"), F.col("architecture_roles"))), ",")
    body = F.unhex(F.sha2(tx.trimmed(tx.lf(F.col("content"))), 256))
    rows = slices.select("slice_id", "full_name", "path", "start_line", "relevance", kinds.alias("kinds"), tx.is_blank(F.col("content")).alias("blank"), body.alias("body"))
    rows = landed(rows.join(ends, ["full_name", "path"], "left").withColumn("endpoint", F.coalesce("endpoint", F.lit(""))), "slice-bodies")
    key = ["full_name", "kinds", "endpoint", "body"]
    winner = rows.filter(~F.col("blank")).groupBy(*key).agg(F.min(F.struct(
        -F.col("relevance"), "path", "start_line", "slice_id")).alias("w")).select(*key, F.col("w.slice_id").alias("winner"))
    return rows.join(winner, key, "left").select("slice_id", F.when(F.col("blank"), "low-value").when(
        F.col("slice_id") == F.col("winner"), "kept").otherwise("duplicate").alias("status"))


def diverse_slices(candidates: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """One best slice per leading kind, then the most relevant rest, per group."""
    order = ["documentation", "manifest", "implementation", "test"]
    kind = pt.primary_kind(F.col("path"), F.col("evidence_roles"), F.col("architecture_roles"))
    rows = candidates.withColumn("kind", kind)
    per_kind = Window.partitionBy(*keys, "kind").orderBy(F.desc("relevance"), "path", "start_line", "slice_id")
    # Only the first `limit` of a kind can be chosen, which prunes before the second ranking.
    rows = rows.withColumn("nth", F.row_number().over(per_kind)).filter(at_most(F.col("nth"), limit))
    slot = F.when(F.col("nth") == 1, F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind"))).otherwise(0)
    rows = rows.withColumn("slot", F.when(slot == 0, len(order) + 1).otherwise(slot))
    w = Window.partitionBy(*keys).orderBy("slot", F.desc("relevance"), "path", "start_line", "slice_id")
    return rows.withColumn("place", F.row_number().over(w).cast("long")).filter(at_most(F.col("place"), limit)).drop("nth", "slot")
