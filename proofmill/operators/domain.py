"""Domain vocabulary, repository search and rank fusion.

Terms meet texts through an inverted index (exploded tokens) and an equi-join, so
no task x repository product is ever formed.  Distinct terms are matched once and
joined back to tasks afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofmill.functions import text as tx
from proofmill.functions.frames import stage
from proofmill.params import DEFAULT, Params
from proofmill.sources.sinks import landed


def lexical_anchors(tasks: DataFrame, limit: int = 12) -> DataFrame:
    """Fallback vocabulary: most frequent content words, ties by first occurrence."""
    body = tasks["task"]
    if "must_have" in tasks.columns:
        body = F.concat_ws(" ", tasks["task"], tasks["must_have"])
    language = tasks["language"] if "language" in tasks.columns else None
    eco = tasks["ecosystem"] if "ecosystem" in tasks.columns else None
    words = tasks.select("task_id", F.posexplode(tx.meaningful_terms(body, language, eco)).alias("pos", "term"))
    counted = (words.filter(F.col("term").rlike("^[a-z0-9]+$"))
               .groupBy("task_id", "term").agg(F.count("*").alias("hits"), F.min("pos").alias("pos")))
    w = Window.partitionBy("task_id").orderBy(F.desc("hits"), "pos")
    return (counted.withColumn("anchor_rank", F.row_number().over(w)).filter(F.col("anchor_rank") <= limit)
            .select("task_id", "anchor_rank", "term", "hits"))


def anchor_queries(anchors: DataFrame) -> DataFrame:
    """The first two and the first three anchors, joined into query texts."""
    first = (anchors.filter("anchor_rank <= 3").groupBy("task_id")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("anchor_rank", "term"))), lambda s: s["term"]).alias("a")))
    joined = F.array(F.array_join(F.slice("a", 1, 2), " "), F.array_join("a", " "))
    return first.select("task_id", F.array_distinct(joined).alias("query_terms"))


def _aliases(name: Column, aliases: Column) -> Column:
    normal = F.array_sort(F.array_distinct(F.transform(aliases, tx.normalize_text)))
    return F.filter(normal, lambda a: (a != tx.normalize_text(name)) & (a != ""))


def normalized_concepts(concepts: DataFrame) -> DataFrame:
    return concepts.select(
        "task_id", "kind", "ordinal", tx.normalize_text(F.col("name")).alias("concept"),
        _aliases(F.col("name"), F.col("aliases")).alias("aliases"))


def task_terms(tasks: DataFrame, concepts: DataFrame) -> DataFrame:
    """Every match term of a task: profile names and aliases, or lexical anchors."""
    profile = normalized_concepts(concepts).select(
        "task_id", "kind", "concept",
        F.explode(F.array_distinct(F.concat(F.array("concept"), "aliases"))).alias("term"))
    profile = profile.filter("term <> ''").withColumn("is_alias", F.col("term") != F.col("concept"))
    bare = tasks.join(concepts.select("task_id").distinct(), "task_id", "left_anti")
    lexical = lexical_anchors(bare).select(
        "task_id", F.lit("lexical").alias("kind"), F.col("term").alias("concept"), "term", F.lit(False).alias("is_alias"))
    return profile.unionByName(lexical)


def advisory_tasks(requests: DataFrame, max_capabilities: int = 6) -> tuple[DataFrame, DataFrame]:
    """Task rows from short requests (task, purpose, capabilities), and violations."""
    shaped = requests.select(
        "task_id", tx.collapsed(F.col("task")).alias("task"), tx.plain_search_term(F.col("purpose")).alias("purpose"),
        F.slice(F.array_distinct(F.filter(F.transform("capabilities", lambda c: tx.plain_search_term(c)), lambda c: c != "")),
                1, max_capabilities).alias("capabilities"))
    shaped = shaped.withColumn("evidence", F.rtrim(F.substring("task", 1, 600))).withColumn("reasons", tx.reasons(
        (F.col("task") == "", "task-empty"), (F.col("purpose") == "", "purpose-empty"),
        (F.size("capabilities") == 0, "capabilities-empty")))
    return shaped.filter(F.size("reasons") == 0).drop("reasons"), shaped.filter(F.size("reasons") > 0)


def plan_queries(tasks: DataFrame, concepts: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """At most five distinct queries per task; qualifiers are columns, not text."""
    purposes = (normalized_concepts(concepts.filter("kind = 'purpose'"))
                .select("task_id", F.slice(F.concat(F.array("concept"), "aliases"), 1, 3).alias("query_terms")))
    bare = tasks.join(purposes.select("task_id"), "task_id", "left_anti")
    terms = purposes.unionByName(anchor_queries(lexical_anchors(bare)))

    def shaped(values: Column, language: Column) -> Column:
        return F.transform(values, lambda q: F.struct(q.alias("query"), language.alias("language")))

    nothing = F.lit(None).cast("string")
    own = F.filter(F.transform(F.coalesce("queries", F.array().cast("array<string>")), tx.trimmed), lambda q: q != "")
    found = F.coalesce("query_terms", F.array().cast("array<string>"))
    by_language = F.when(F.col("language").isNotNull(), F.slice(found, 1, 1)).otherwise(F.array().cast("array<string>"))
    planned = F.slice(F.array_distinct(F.concat(
        shaped(own, nothing), shaped(by_language, F.col("language")), shaped(found, nothing))), 1, params.max_queries)
    rows = tasks.join(terms, "task_id", "left").select("task_id", F.posexplode(planned).alias("pos", "q"))
    return rows.select("task_id", (F.col("pos") + 1).cast("long").alias("query_no"), "q.query",
                       F.col("q.language").alias("language"), F.lit(params.min_stars).cast("long").alias("min_stars"))


def repository_text(repositories: DataFrame) -> Column:
    return F.concat_ws(" ", "full_name", "description", F.concat_ws(" ", "topics"))


def _index_keys(normalized: Column) -> Column:
    """Tokens of a text plus its CJK characters (CJK terms match inside tokens)."""
    cjk = F.regexp_extract_all(normalized, F.lit(f"({tx.CJK})"), 1)
    return F.array_distinct(F.concat(tx.tokens(normalized), cjk))


def _lookup_keys(term: Column) -> Column:
    """Keys that every text with the term has: its tokens, or a CJK character of it."""
    return F.when(tx.has_cjk(term), F.array(F.regexp_extract(term, f"({tx.CJK})", 1))).otherwise(F.array_distinct(tx.tokens(term)))


def match_terms(texts: DataFrame, ids: list[str], normalized: str, terms: DataFrame) -> DataFrame:
    """(ids, term) for every normalised `term` that occurs in a normalised text.

    The index carries ids and the tokens that terms have, and is landed once.  A term meets it on the rarest of its tokens; texts rejoin
    just the phrase candidates.
    """
    each = landed(terms.select("term").distinct().filter("term <> ''").withColumn("key", F.explode(_lookup_keys(F.col("term")))), "term-keys")
    tokens = texts.select(*ids, F.explode(_index_keys(F.col(normalized))).alias("key"))
    index = landed(tokens.join(each.select("key").distinct(), "key", "left_semi"), "text-index")
    counts = index.groupBy("key").agg(F.count("*").alias("n"))
    keyed = each.join(counts, "key", "left").groupBy("term").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))
    hits = index.join(keyed, "key").drop("key")
    phrase = F.contains("term", F.lit(" ")) | tx.has_cjk(F.col("term"))
    single = hits.filter(~phrase)
    phrases = (hits.filter(phrase).join(texts.select(*ids, normalized), ids)
               .filter(tx.contains_normalized(F.col(normalized), F.col("term"))))
    return single.unionByName(phrases.select(*ids, "term"))


def term_matches(terms: DataFrame, repositories: DataFrame) -> DataFrame:
    """Which task terms occur in which repository's name, description or topics."""
    texts = repositories.select("full_name", tx.normalize_text(repository_text(repositories)).alias("norm"))
    found = match_terms(texts, ["full_name"], "norm", terms)
    return terms.join(found, "term").select("task_id", "kind", "concept", "term", "full_name")


def domain_signal(terms: DataFrame, matches: DataFrame) -> DataFrame:
    """Domain score of every (task, repository) pair with a purpose match; others score 0."""
    sizes = terms.groupBy("task_id").agg(
        F.countDistinct(F.when(F.col("kind") == "capability", F.col("concept"))).alias("n_capabilities"),
        F.count(F.when(F.col("kind") == "lexical", 1)).alias("n_anchors"))
    pairs = matches.groupBy("task_id", "full_name").agg(
        F.countDistinct(F.when(F.col("kind").isin("purpose", "lexical"), F.col("term"))).alias("matched"),
        F.countDistinct(F.when(F.col("kind") == "capability", F.col("concept"))).alias("capabilities"))
    score = F.when(F.col("n_anchors") > 0, F.round(25 + 50 * F.col("matched") / F.col("n_anchors"))).otherwise(
        F.round(60 + 25 * F.col("capabilities") / F.greatest("n_capabilities", F.lit(1))))
    return (pairs.filter("matched > 0").join(sizes, "task_id")
            .select("task_id", "full_name", score.cast("long").alias("domain"), "matched", "capabilities", "n_capabilities"))


def search_topk(queries: DataFrame, repositories: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Top repositories by stars for each query; all query tokens must occur.

    Of the repositories that have the same words of any query and the same language, only the first `candidate_limit` can be found, so just
    these go on.  A query meets them on its rarest token, by an index of tokens and names only; the other tokens are checked on these
    candidates.
    """
    usable = repositories.filter(~F.col("archived") & ~F.col("fork") & (F.col("stars") >= params.min_stars))
    queries = landed(queries.select("task_id", "query_no", "query", F.lower("language").alias("language")), "search-queries")
    asked = queries.select("query", "language").distinct().withColumn("query_tokens", tx.tokens(tx.normalize_text(F.col("query"))))
    each = asked.select("query", "language", F.explode("query_tokens").alias("token"))
    vocabulary = landed(each.select("token").distinct(), "search-vocabulary")
    words = usable.select("full_name", "stars", F.lower("language").alias("repo_language"), F.explode(tx.tokens(tx.normalize_text(repository_text(usable)))).alias("token"))
    docs = words.join(vocabulary, "token", "left_semi").groupBy("full_name", "stars", "repo_language").agg(F.array_sort(F.collect_set("token")).alias("doc_tokens"))
    alike = Window.partitionBy("doc_tokens", "repo_language").orderBy(F.desc("stars"), "full_name")
    docs = landed(docs.withColumn("nth", F.row_number().over(alike)).filter(F.col("nth") <= params.candidate_limit).drop("nth"), "search-tokens")
    index = docs.select("full_name", F.explode("doc_tokens").alias("token"))
    common = index.join(each.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    key = F.struct(F.coalesce("n", F.lit(0)), "token")
    rarest = each.join(common, "token", "left").groupBy(F.col("query").alias("of_query"), F.col("language").alias("of_language")).agg(F.min_by("token", key).alias("token"))
    keyed = asked.join(rarest, F.col("query").eqNullSafe(F.col("of_query")) & F.col("language").eqNullSafe(F.col("of_language"))).drop("of_query", "of_language")
    found = (index.join(keyed, "token").drop("token").join(docs, "full_name")
             .filter((F.size(F.array_except("query_tokens", "doc_tokens")) == 0)
                     & (F.col("language").isNull() | (F.col("language") == F.col("repo_language")))))
    w = Window.partitionBy("query", "language").orderBy(F.desc("stars"), "full_name")
    top = (found.withColumn("hit_rank", F.row_number().over(w).cast("long"))
           .filter(F.col("hit_rank") <= params.candidate_limit).select("query", "language", "hit_rank", "full_name", "stars"))
    q = queries.withColumnRenamed("query", "asked_query").withColumnRenamed("language", "asked_language")
    same = (q["asked_query"] == top["query"]) & q["asked_language"].eqNullSafe(top["language"])
    return q.join(top, same).select("task_id", "query_no", "hit_rank", "full_name", "stars")


def fuse_search_hits(hits: DataFrame, domain: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Reciprocal-rank fusion over a task's queries, then the weighted candidate score."""
    first = hits.groupBy("task_id", "query_no", "full_name").agg(F.min("hit_rank").alias("pos"), F.max("stars").alias("stars"))
    fused = first.groupBy("task_id", "full_name").agg(
        F.count("*").alias("hits"), F.sum(1 / (10 + F.col("pos"))).alias("rrf"), F.max("stars").alias("stars"))
    scored = fused.join(domain.select("task_id", "full_name", "domain"), ["task_id", "full_name"], "left").withColumn(
        "domain", F.coalesce("domain", F.lit(0)))
    score = F.round(F.col("domain") * 10 + F.col("hits") * 12 + F.col("rrf") * 40 + F.log10(F.col("stars") + 1), 2)
    w = Window.partitionBy("task_id").orderBy(F.desc("score"), F.desc("stars"), "full_name")
    return (scored.withColumn("score", score).withColumn("candidate_rank", F.row_number().over(w).cast("long"))
            .filter(F.col("candidate_rank") <= params.inspect_limit)
            .select("task_id", "candidate_rank", "full_name", "score", "hits", "domain", "stars"))


def exclude_requested(ranked: DataFrame, requested: DataFrame) -> DataFrame:
    """Drop repositories the user already asked for, after the inspect limit."""
    asked = requested.select("task_id", F.lower("repository").alias("requested_name")).distinct()
    same = (ranked["task_id"] == asked["task_id"]) & (F.lower(ranked["full_name"]) == asked["requested_name"])
    return ranked.join(asked, same, "left_anti")


def _capability_terms(concepts: DataFrame) -> DataFrame:
    """Capability names, aliases and their longer word parts, normalised."""
    caps = normalized_concepts(concepts.filter("kind = 'capability'"))
    whole = F.concat(F.array("concept"), "aliases")
    parts = F.filter(F.flatten(F.transform(whole, lambda a: F.split(a, "[ +_-]+"))),
                     lambda p: F.length(p) >= F.when(p.rlike(r"[^\x00-\x7f]"), 2).otherwise(3))
    return caps.select("task_id", "concept", F.explode(F.array_distinct(F.concat(whole, parts))).alias("term")).filter("term <> ''")


def content_capability_coverage(concepts: DataFrame, slices: DataFrame) -> DataFrame:
    """Capabilities of each task whose words occur in a repository's code or test slices, and the paths that support each.

    `evidence` has one entry per capability found, in order: "capability: path, path"; `paths` counts the distinct paths of all of them.

    Files that hold the same terms count as one kind of file, and tasks that ask for the same terms, concept by concept, as one wish.
    Wishes meet kinds of files, and these the repositories; tasks come in at the end, so no task meets a file.  Paths wait with the
    repository until its wishes are known, so a path is not sent once per wish.
    """
    terms = landed(_capability_terms(concepts), "capability-terms")
    totals = terms.groupBy("task_id").agg(F.countDistinct("concept").alias("total"))
    behavior = slices.filter(F.arrays_overlap("evidence_roles", F.array(F.lit("implementation"), F.lit("test"))))
    texts = stage(behavior.select("slice_id", "full_name", "path", "content"), norm=tx.normalize_text(F.col("content"))).drop("content")
    found = match_terms(texts, ["slice_id", "full_name", "path"], "norm", terms)
    by_path = found.groupBy("full_name", "path").agg(F.array_sort(F.collect_set("term")).alias("held"))
    files = landed(by_path.groupBy("full_name", "held").agg(F.count("*").alias("n"), F.collect_list("path").alias("names")), "files-by-terms")
    kinds = landed(files.select("held").distinct().withColumn("kind_no", F.monotonically_increasing_id()), "kinds-of-files")
    words = kinds.select("kind_no", F.explode("held").alias("term"))
    asked = terms.join(words.select("term").distinct(), "term", "left_semi").groupBy("task_id", "concept").agg(F.array_sort(F.collect_set("term")).alias("words"))
    # The concepts of a task in the order of the parts of its wish.
    tasks = landed(asked.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("words", "concept"))).alias("parts")).select(
        "task_id", F.col("parts.words").alias("wish"), F.col("parts.concept").alias("concepts")), "task-wishes")
    wishes = landed(tasks.select("wish").distinct().withColumn("wish_no", F.monotonically_increasing_id()), "wishes")
    wanted = wishes.select("wish_no", F.posexplode("wish").alias("part", "words")).select("wish_no", "part", F.explode("words").alias("term"))
    met = landed(wanted.join(words, "term").groupBy("wish_no", "kind_no").agg(F.collect_set("part").alias("parts")), "wishes-of-kinds")
    repositories = landed(files.join(kinds, "held").select("full_name", "kind_no", "n", "names"), "repository-files")
    hits = repositories.select("full_name", "kind_no", "n").join(met, "kind_no").groupBy("wish_no", "full_name").agg(
        F.sum("n").alias("paths"), F.collect_list(F.struct("kind_no", "parts")).alias("kinds"))
    hits = hits.withColumn("found", F.array_sort(F.array_distinct(F.flatten("kinds.parts"))))
    shelves = repositories.groupBy("full_name").agg(F.map_from_entries(F.collect_list(F.struct("kind_no", "names"))).alias("shelf"))

    def supporting(part: Column) -> Column:
        of_part = F.filter("kinds", lambda k: F.array_contains(k["parts"], part))
        return F.array_join(F.array_sort(F.flatten(F.transform(of_part, lambda k: F.col("shelf")[k["kind_no"]]))), ", ")

    there = shelves.withColumnRenamed("full_name", "of_repository")
    supports = F.transform("found", lambda part: F.struct(part.alias("part"), supporting(part).alias("names")))
    listed = hits.join(there, F.col("full_name").eqNullSafe(F.col("of_repository"))).select("wish_no", "full_name", "found", "paths", supports.alias("supports"))
    named = landed(tasks.join(wishes, "wish").select("task_id", "wish_no", "concepts").join(totals, "task_id"), "tasks-of-wishes")
    matched = F.size("found").cast("long")
    evidence = F.array_sort(F.transform("supports", lambda s: F.concat(F.get("concepts", s["part"]), F.lit(": "), s["names"])))
    return listed.join(named, "wish_no").select(
        "task_id", "full_name", matched.alias("matched"), "total", (matched / F.col("total")).alias("ratio"), "paths", evidence.alias("evidence"))


def validate_domain_profiles(tasks: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profile checks per task; returns (valid tasks, violation rows)."""
    joined = concepts.join(tasks.select("task_id", "task", "must_have", "language", "ecosystem"), "task_id")
    grounded = F.lower(F.regexp_replace(F.concat_ws(" ", "task", F.concat_ws(" ", "must_have")), f"{tx.SPACES}+", " "))

    def bad_term(t: Column) -> Column:
        return (F.length(tx.trimmed(t)) < 2) | (F.length(t) > 100) | ~t.rlike(r"^[\p{L}\p{N} +_-]+$")

    def generic(t: Column) -> Column:
        return F.size(tx.meaningful_terms(tx.normalize_text(t), F.col("language"), F.col("ecosystem"))) == 0

    quote = tx.collapsed(F.col("evidence"))
    checked = joined.withColumn("reasons", tx.reasons(
        (bad_term(F.col("name")) | F.exists("aliases", bad_term), "term-shape"),
        (generic(F.col("name")) | F.exists("aliases", generic), "term-generic"),
        (F.size("aliases") > 6, "too-many-aliases"),
        ((F.length(tx.trimmed(F.col("evidence"))) < 3) | (F.length("evidence") > 600), "quote-length"),
        (~F.contains(grounded, F.lower(quote)), "quote-not-grounded")))
    per_concept = checked.select("task_id", "kind", "ordinal", F.explode("reasons").alias("reason"))
    counts = (concepts.filter("kind = 'capability'").groupBy("task_id")
              .agg(F.count("*").alias("n"), F.countDistinct(tx.normalize_text(F.col("name"))).alias("names")))
    per_task = counts.select("task_id", F.lit("capability").alias("kind"), F.lit(0).cast("long").alias("ordinal"), F.explode(tx.reasons(
        (F.col("n") > 8, "capability-count"), (F.col("n") != F.col("names"), "capability-duplicate"))).alias("reason"))
    violations = per_concept.unionByName(per_task)
    valid = (tasks.join(concepts.filter("kind = 'capability'").select("task_id").distinct(), "task_id", "left_semi")
             .join(violations.select("task_id").distinct(), "task_id", "left_anti"))
    return valid, violations


def normalize_task_lists(tasks: DataFrame, column: str, max_items: int, max_chars: int) -> tuple[DataFrame, DataFrame]:
    """Trim, collapse, dedupe and sort a list column; over-long lists or items are violations."""
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(column, tx.collapsed), lambda v: v != "")))
    shaped = tasks.withColumn("items", clean).withColumn("reasons", tx.reasons(
        (F.size(column) > max_items, f"{column}-items"),
        (F.exists("items", lambda v: F.length(v) > max_chars), f"{column}-length")))
    return (shaped.filter(F.size("reasons") == 0).drop("reasons", column).withColumnRenamed("items", column),
            shaped.filter(F.size("reasons") > 0).select("task_id", F.explode("reasons").alias("reason")))


def judged_refs(requested: DataFrame, host: str = "github.com", limit: int = 2, rows_per_task: int = 500_000) -> DataFrame:
    """owner/name or host URL with an optional @revision -> normalised refs, each with its reasons against it.

    The rows are dealt by task once, and one sort serves both windows.  The number of partitions is named, since short rows shrink so
    much in a shuffle that partitions coalesced by their bytes would hold gigabytes in a sort.
    """
    raw = tx.trimmed(F.col("requested"))
    quoted = host.replace(".", r"\.")
    url = rf"(?i)^(https?://{quoted}/[^/]+/[^@/?#]+)(?:@(.+))?$"
    is_url = raw.rlike(r"(?i)^https?://")
    name = F.when(is_url, F.regexp_extract(raw, rf"(?i)^https?://{quoted}/([^/]+/[^@/?#]+)(?:@.+)?$", 1)).otherwise(
        F.substring_index(raw, "@", 1))
    revision = F.when(is_url, F.regexp_extract(raw, url, 2)).otherwise(
        F.when(F.contains(raw, F.lit("@")), F.regexp_replace(raw, r"^[^@]*@", "")))
    name = F.lower(F.regexp_replace(tx.trimmed(name), r"(?i)\.git$", ""))
    revision = F.nullif(tx.trimmed(revision), F.lit(""))
    rows = requested.select("task_id", "seq", name.alias("repository"), revision.alias("revision"), F.array_compact(F.array(
        F.when(raw == "", "empty").when(is_url & ~raw.rlike(url), "url-shape"),
        F.when(~F.coalesce(name.rlike(r"^[a-z0-9_.-]+/[a-z0-9_.-]+$"), F.lit(False)), "name-shape"),
        F.when((F.length(revision) > 200) | revision.rlike(r"[\x00\r\n]"), "revision-shape"))).alias("reasons"))
    same = Window.partitionBy("task_id", "repository").orderBy("seq")
    # The same order as `same`, so the rows need not be sorted again.
    task = Window.partitionBy("task_id").orderBy("repository", "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = rows.repartition(max(1, -(-requested.count() // rows_per_task)), "task_id")
    return dealt.withColumn("nth", F.row_number().over(same)).withColumn("n", F.count("*").over(task)).withColumn(
        "reasons", F.array_compact(F.concat("reasons", F.array(
            F.when((F.size("reasons") == 0) & (F.col("nth") > 1), "duplicate"), F.when(F.col("n") > limit, "too-many")))))


def parse_repository_refs(requested: DataFrame, host: str = "github.com", limit: int = 2) -> tuple[DataFrame, DataFrame]:
    """Normalised refs and violations of requested names (`judged_refs`)."""
    flagged = judged_refs(requested, host, limit)
    good = flagged.filter(F.size("reasons") == 0).select("task_id", "seq", "repository", "revision")
    return good, flagged.filter(F.size("reasons") > 0).select("task_id", "seq", F.explode("reasons").alias("reason"))


def window_term_hits(windows: DataFrame, terms: DataFrame, on: list[str], text: str = "content") -> DataFrame:
    """Number of distinct terms that occur as plain lower-case substrings of each window.

    `terms` holds the terms of the same key columns `on`, so the join is an equi-join;
    the terms of one key become one array and the text is scanned in place.
    """
    listed = terms.groupBy(*on).agg(F.array_sort(F.collect_set(F.lower("term"))).alias("wanted"))
    lowered = F.lower(F.col(text))
    return windows.join(listed, on, "left").withColumn(
        "term_hits", F.size(F.filter(F.coalesce("wanted", F.array().cast("array<string>")),
                                     lambda t: F.contains(lowered, t))).cast("long")).drop("wanted")
