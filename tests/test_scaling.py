"""Work that must not multiply: what the plans of operators read, copy and send once."""

import re

from pyspark.sql import functions as F


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_encoded_files_are_stripped_and_decoded_once(spark):
    from proofmill.sources import scans

    rows = spark.createDataFrame([("a", "aGk=\n"), ("b", "*"), ("c", "/w=="), ("d", None), ("e", "")], "path string, encoded string")
    judged = scans.judged_blobs(rows)
    assert {tuple(r) for r in judged.collect()} == {("a", None, "hi"), ("b", "invalid-base64", None), ("c", "invalid-utf8", None), ("d", "invalid-base64", None), ("e", "invalid-base64", None)}
    assert optimized(judged).count("regexp_replace") == 1
    good, bad = scans.decode_blobs(rows)
    assert [tuple(r) for r in good.collect()] == [("a", "hi")] and bad.count() == 4


def test_supplements_and_texts_need_no_python_group_and_no_copied_lines(spark):
    from proofmill.operators import windows

    shape = ("full_name string, revision string, path string, name string, kind string, language string, role string, visibility string, start_line bigint, end_line bigint, has_body boolean, "
             "raises array<string>, catches array<string>, bases array<string>, fields array<string>, assertion_count bigint, unsafe_count bigint")
    one = lambda name, kind, at, role="implementation", **k: ("r", "r1", "f", name, kind, "python", role, None, at, at + 4, True, k.get("raises", []), [], k.get("bases", []), k.get("fields", []), 0, 0)
    symbols = spark.createDataFrame([one("main", "class", 1), one("_late", "function", 10, raises=["X"]), one("fails", "function", 20, raises=["X"], fields=["a"]), one("over", "function", 22, fields=["a"]),
                                     one("Base", "class", 30, bases=["Protocol"]), one("t", "function", 40, role="test")], shape)
    primary = spark.createDataFrame([("r", "f", 1, 5)], "full_name string, path string, start_line bigint, end_line bigint")
    out = windows.supplement_windows(symbols, primary)
    assert sorted((r.name, r.start_line, r.role, r.relevance) for r in out.collect()) == [("Base", 30, "extension-point", 5), ("fails", 20, "data-model", 4), ("t", 40, "test", 7)]
    assert len(windows.supplement_windows(symbols, primary, max_windows=2).collect()) == 1
    assert "Pandas" not in optimized(out)
    texts = spark.createDataFrame([("r", "f", "a\nb\nc")], "full_name string, path string, content string")
    ranges = spark.createDataFrame([("r", "f", 1, 2), ("r", "f", 3, 3)], "full_name string, path string, start_line bigint, end_line bigint")
    cut = windows.with_text(ranges, texts)
    assert sorted((r.start_line, r.text, r.file_lines) for r in cut.collect()) == [(1, "a\nb", 3), (3, "c", 3)]


def test_citations_meet_what_they_cite_in_one_join(spark):
    from proofmill.operators import lineage

    claims = spark.createDataFrame([(1, "a", "observed", 0.1, 1, ["s1"], ["s1", "s9"], ["b1"], ["o1"]), (1, "b", "unknown", 0.1, 1, [], [], [], [])],
                                   "concept_no long, claim_id string, status string, confidence double, n_limitations long, slice_ids array<string>, counter_ids array<string>, bundle_ids array<string>, observation_ids array<string>")
    pair = lambda rows, a, b: spark.createDataFrame(rows, f"{a} string, {b} string")
    out = lineage.claim_checks(claims, pair([("b1", "observed")], "bundle_id", "ceiling"), pair([("b1", "s1")], "bundle_id", "slice_id"), pair([("s1", "x.py"), ("s2", "y.py")], "slice_id", "path"),
                               pair([("o1", "syntactic")], "observation_id", "strength"), pair([("o1", "s1"), ("o1", "s2")], "observation_id", "slice_id"))
    assert sorted((r.claim_id, r.reason, r.cited) for r in out.collect()) == [
        ("a", "observation-slices-missing", "o1"), ("a", "slice-outside-bundles", "s9"), ("a", "supporting-and-counter", "s1"), ("a", "unknown-slice", "s9")]
    assert len(re.findall(r"\bJoin\b", optimized(out))) == 1


def test_style_specs_read_texts_once(spark):
    from proofmill.operators import style

    sources = spark.createDataFrame([("w", "a.css", "p { color: #fff; font-size: 12px; border-radius: 4px; } h1 { font-size: 30px; font-size: 30px }"), ("v", "b.css", ".card { }")], "workspace string, path string, content string")
    out = style.style_spec_facts(style.style_metrics(sources))
    assert "regexp" not in optimized(out)
    assert {(r.workspace, tuple(r.colors or ()), len(r.font_sizes or ())) for r in out.collect()} == {("w", ("#fff",), 2), ("v", (), 0)}


def test_tasks_with_equal_wishes_meet_repositories_once(spark):
    from proofmill.operators import domain

    concepts = spark.createDataFrame([(f"t{i}", "capability", n, name, []) for i in range(6) for n, name in enumerate(["retry budget", "json dumps" if i % 2 else "gone word"])],
                                     "task_id string, kind string, ordinal int, name string, aliases array<string>")
    slices = spark.createDataFrame([(f"s{i}", "r", f"p{i % 5}", ["implementation"], "a retry budget" if i % 2 else "json dumps retry") for i in range(20)],
                                   "slice_id string, full_name string, path string, evidence_roles array<string>, content string")
    out = domain.content_capability_coverage(concepts, slices)
    assert {(r.task_id, r.matched, r.total, r.paths) for r in out.collect()} == {(f"t{i}", 2 if i % 2 else 1, 2, 5) for i in range(6)}
    assert "Expand" not in optimized(out)


def test_only_the_first_of_equal_repositories_are_searched(spark, monkeypatch):
    from proofmill.operators import domain

    kept = {}
    real = domain.landed
    monkeypatch.setattr(domain, "landed", lambda df, name: kept.setdefault(name, real(df, name)))
    rows = [(f"o/r{i:03d}", "hot ring", [], 100 + i % 50, False, False, "rust" if i % 2 else None) for i in range(200)]
    repositories = spark.createDataFrame(rows, "full_name string, description string, topics array<string>, stars long, archived boolean, fork boolean, language string")
    queries = spark.createDataFrame([("t", 1, "hot ring", None), ("t", 2, "ring", "Rust"), ("t", 3, "cold ring", None)], "task_id string, query_no long, query string, language string")
    got = sorted((r.query_no, r.hit_rank, r.full_name) for r in domain.search_topk(queries, repositories).collect())
    order = sorted(rows, key=lambda r: (-r[3], r[0]))
    want = [(1, n + 1, r[0]) for n, r in enumerate(order[:12])] + [(2, n + 1, r[0]) for n, r in enumerate([r for r in order if r[6] == "rust"][:12])]
    assert got == want
    assert kept["search-tokens"].count() == 24


def test_score_matrix_is_one_aggregate(spark):
    from proofmill.operators import scoring

    rows = spark.createDataFrame([("t", "r", "risk", 3), ("t", "r", "domain", 5), ("t", "q", "risk", 1)], "task_id string, full_name string, dimension string, score long")
    out = scoring.score_matrix(rows)
    assert {(r.full_name, r.domain, r.risk, r.design) for r in out.collect()} == {("r", 5, 3, None), ("q", None, 1, None)}
    assert optimized(out).count("Aggregate") == 1


def test_rounds_of_observations_are_one_table_and_need_no_broadcast(spark):
    from proofmill.operators import observations

    rows = spark.createDataFrame([("r", "contracts", f"d{i}", "syntactic", ["p"], [f"s{i}", f"s{i + 1}"]) for i in range(9)],
                                 "full_name string, section string, discriminator string, strength string, paths array<string>, slice_ids array<string>")
    out = observations.select_observations(rows, spark.createDataFrame([("s1", 5)], "slice_id string, relevance long"))
    assert sorted(r.place for r in out.collect()) == list(range(1, 10))
    plan = optimized(out)
    assert plan.count("Relation") == 1 and "Union" not in plan


def test_packs_are_dealt_over_tasks_and_lie_in_one_file(spark, tmp_path):
    from proofmill.sources import sinks

    rows = spark.range(0, 1200, 1, 4).select((F.col("id") % 120).cast("string").alias("pack_id"), "id")
    sinks.write_pack({"rows": rows}, str(tmp_path))
    back = sinks.read_pack(spark, str(tmp_path), "rows").select("pack_id", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).alias("task"))
    files = back.groupBy("pack_id").agg(F.countDistinct("task").alias("n"), F.min("task").alias("task"), F.count("*").alias("rows"))
    assert files.filter("n <> 1 or rows <> 10").count() == 0 and files.count() == 120
    assert files.select("task").distinct().count() == 3
    assert spark.read.json(f"{tmp_path}/manifest").count() == 120
    hot = spark.range(100).select(F.when(F.col("id") < 90, "hot").alias("pack_id"), "id")
    dealt = sinks.deal_packs(hot, hot.groupBy("pack_id").agg(F.count("*").alias("rows")), "pack_id", rows=10)
    tasks = {r["pack_id"]: r["n"] for r in dealt.withColumn("task", F.spark_partition_id()).groupBy("pack_id").agg(F.countDistinct("task").alias("n")).collect()}
    assert tasks["hot"] > 2 and tasks[None] == 1 and sorted(r["id"] for r in dealt.collect()) == list(range(100))


def test_review_lands_only_cited_code(spark, monkeypatch):
    from proofmill.operators import review as rv

    kept, real = [], rv.landed
    monkeypatch.setattr(rv, "landed", lambda df, name: kept.append((name, sorted(r["slice_id"] for r in df.collect()))) or real(df, name))
    reviews = spark.createDataFrame([("r", 1, "same-domain", "shares the product responsibility")], "repository string, review_no bigint, relation string, rationale string")
    cited = spark.createDataFrame([("r", 1, "a"), ("r", 1, "b")], "repository string, review_no bigint, slice_id string")
    slices = spark.createDataFrame([("a", "r", "src/app/m.py", "a retry"), ("b", "r", "README.md", "retry"), ("c", "r", "src/app/n.py", "retry")], "slice_id string, full_name string, path string, content string")
    out = rv.domain_review(reviews, cited, cited, slices, spark.createDataFrame([("retry",)], "term string"), spark.createDataFrame([("r", 60)], "repository string, domain bigint"))
    assert out.collect() == [] and kept == [("cited-texts", ["a"])]


def test_refs_are_dealt_and_sorted_once(spark):
    from proofmill.operators import domain

    rows = spark.createDataFrame([("t", 1, "a/b"), ("t", 2, "A/b.git"), ("u", 1, "x"), ("v", 1, "c/d@r")], "task_id string, seq bigint, requested string")
    good, bad = domain.parse_repository_refs(rows)
    plan = domain.judged_refs(rows, rows_per_task=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and len(re.findall(r"\bSort \[", plan)) == 1 and ", 2), REPARTITION_BY_NUM" in plan
    assert sorted(tuple(r) for r in good.collect()) == [("t", 1, "a/b", None), ("v", 1, "c/d", "r")]
    assert sorted(tuple(r) for r in bad.collect()) == [("t", 2, "duplicate"), ("u", 1, "name-shape")]


def test_lineage_knows_concepts_from_one_aggregate(spark):
    from proofmill.operators import lineage

    concepts = spark.createDataFrame([(1, "test"), (2, "other"), (3, "other")], "concept_no bigint, kind string")
    links = spark.createDataFrame([(1, "c"), (1, "c"), (1, "gone")], "concept_no bigint, claim_id string")
    claims = spark.createDataFrame([("c", "inferred", ["s"], ["o"])], "claim_id string, status string, slice_ids array<string>, observation_ids array<string>")
    slices = spark.createDataFrame([(1, "s"), (2, "t")], "concept_no bigint, slice_id string")
    seen = spark.createDataFrame([("o", "testConcepts", "strong")], "observation_id string, section string, strength string")
    out = lineage.concept_lineage(concepts, links, slices, claims, seen, spark.createDataFrame([(2, "reject"), (1, "adapt")], "concept_no bigint, decision string"))
    assert "LeftAnti" not in optimized(out)
    assert sorted(tuple(r) for r in out.collect()) == [
        (1, "duplicate-claim", "c"), (1, "unknown-claim", "gone"), (2, "evidence-not-from-claims", "t"), (2, "no-claims", ""), (3, "no-claims", ""), (3, "only-negative-space", "")]


def test_texts_are_normalised_once_for_all_terms(spark):
    from proofmill.functions import text as tx

    rows = spark.createDataFrame([(1, "theStore of the"), (2, "other"), (3, None)], "id int, text string")
    out = tx.with_terms_held(rows, "text", {"a": "the", "b": "of the", "c": "Store"}).drop("text")
    assert {tuple(r) for r in out.collect()} == {(1, True, True, True), (2, False, False, False), (3, None, None, None)}
    assert optimized(out).count("regexp_replace(") == 3


def test_files_of_a_batch_leave_the_parser_in_small_parts():
    import pyarrow as pa

    from proofmill.operators import adapters

    def odd(path, content):
        if content == "broken":
            raise KeyError(path)
        return {"imports": [dict(module=content, names=[], level=0, line=1, scope="module", context=[])]}

    batch = pa.RecordBatch.from_pylist([{"content_hash": str(i), "path": f"p{i}", "content": c} for i, c in enumerate(["a", "broken", "long text", "d", "e"])])
    parts = list(adapters._runner(odd, 8, files=2)(iter([batch])))
    assert [p.num_rows for p in parts] == [2, 2, 1]
    rows = [r for p in parts for r in p.to_pylist()]
    assert [r["status"] for r in rows] == ["parsed", "unavailable", "budget-exceeded", "parsed", "parsed"] and rows[0]["imports"][0]["module"] == "a"


def test_rounds_of_a_cover_send_no_join_side_through_the_driver(spark, monkeypatch):
    from proofmill.operators import cover

    plans = []
    real = cover.landed

    def kept(df, name):
        if name == "cover-state":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(cover, "landed", kept)
    shape = ("full_name string, slice_id string, path string, start_line bigint, end_line bigint, relevance bigint, revision string, chars bigint, plain boolean, anchor boolean, "
             "features array<string>, endpoint boolean")
    rows = spark.createDataFrame([("r", f"s{i}", f"p{i % 3}", 1, 9, i, "v", 10, False, i == 1, [f"task:{i % 4}"], True) for i in range(30)], shape)
    relations = spark.createDataFrame([("r", "p0", "p1", "p0", "https://host.example/x#L1-L2")], "full_name string, src string, dst string, evidence_path string, source_url string")
    out = cover.select_cover(spark.createDataFrame([("t", "r", 1)], "task_id string, full_name string, selection_rank long"), rows, relations)
    assert out.count() == 30 and out.filter("status = 'selected'").count() >= 4
    assert len(plans) > 4 and not [p for p in plans if "Broadcast" in p]
    # The candidates of one task and repository meet its state in several tasks.
    assert any("share" in p for p in plans)


def test_the_tree_is_landed_without_file_contents(spark, monkeypatch):
    from proofmill.plans import registry, views

    registry.load()
    monkeypatch.setattr(views, "_LANDED_AT", {})
    inputs = views.Inputs(spark, "/root/testdata/sf0.001")
    tree = inputs("v_tree")
    assert {name for _app, _folder, name in views._LANDED_AT} == {"v_tree"}
    blobs = inputs.sql("select full_name, revision, path, 'blob' as type, cast(length(content) as bigint) as size from v_blobs")
    assert {name for _app, _folder, name in views._LANDED_AT} == {"v_tree", "v_files", "v_extra"}
    assert tree.exceptAll(blobs).isEmpty() and blobs.exceptAll(tree).isEmpty() and tree.schema.simpleString() == blobs.schema.simpleString()


def test_scores_of_found_repositories_aggregate_only_their_lines(spark, monkeypatch):
    from proofmill.plans import discovery, registry, views

    queries = registry.spark_queries()
    monkeypatch.setattr(views, "_LANDED_AT", {})
    rows = sorted(queries["score_matrix"](spark, "/root/testdata/sf0.001").collect())
    assert not [name for _app, _folder, name in views._LANDED_AT if name == "v_catalog"]
    inputs = views.Inputs(spark, "/root/testdata/sf0.001")
    # A search makes no column that needs the suppliers of every part.
    searched = inputs.unlanded("v_catalog").select("full_name", "stars")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in "\n".join(line.split("Relation")[0] for line in searched.split("\n"))
    found = discovery.found_catalog(inputs)
    names = discovery.hits(inputs).select("full_name").distinct()
    whole = inputs("v_catalog").join(names, "full_name", "left_semi").select(*found.columns)
    assert 0 < found.count() and found.exceptAll(whole).isEmpty() and whole.exceptAll(found).isEmpty()
    # The whole catalogue is landed now and is read instead.
    again = views.Inputs(spark, "/root/testdata/sf0.001")
    kept = discovery.found_catalog(again).select(*found.columns)
    assert kept.exceptAll(whole).isEmpty() and whole.exceptAll(kept).isEmpty()
    assert sorted(queries["score_matrix"](spark, "/root/testdata/sf0.001").collect()) == rows


def test_observations_are_settled_wherever_their_places_are(spark, monkeypatch):
    from proofmill.fixed_values import STRENGTH_LEVELS
    from proofmill.operators import observations

    names = []
    real = observations.landed
    monkeypatch.setattr(observations, "landed", lambda df, name: names.append(name) or real(df, name))
    # Two observations a file, files of five strengths: a second one comes before the first ones of weaker files.
    rows = spark.createDataFrame([("r", "contracts", f"f{level}{k}", strength, [f"p{level}"], [f"s{level}"]) for level, strength in enumerate(STRENGTH_LEVELS) for k in range(2)],
                                 "full_name string, section string, discriminator string, strength string, paths array<string>, slice_ids array<string>")
    out = observations.select_observations(rows, spark.createDataFrame([("s1", 5)], "slice_id string, relevance long"))
    assert [r.discriminator for r in out.orderBy("place").collect()] == [f"f{level}{k}" for level in (4, 3, 2, 1, 0) for k in range(2)]
    assert names.count("observation-ranks") == 3


def test_copies_of_an_observation_stay(spark):
    from proofmill.operators import observations

    shape = "full_name string, section string, discriminator string, strength string, paths array<string>, slice_ids array<string>"
    rows = spark.createDataFrame([("r", "contracts", "a", "syntactic", ["p"], ["s1", "s1"])] * 2 + [(None, "contracts", "b", "textual", ["p"], ["s1"]), ("r", None, None, "resolved", [None], ["s1"])], shape)
    out = observations.select_observations(rows, spark.createDataFrame([("s1", 50)], "slice_id string, relevance long"))
    # A null path or section is not shared with others; copies weigh twice.
    assert sorted((r.full_name or "", r.discriminator or "", r.place, round(r.utility, 6)) for r in out.collect()) == [
        ("", "b", 1, 1130.5), ("r", "", 3, 1320.5), ("r", "a", 1, 2280.5), ("r", "a", 2, 2280.5)]


def test_landing_leaves_no_shuffle_files(spark):
    import time

    from proofmill.sources import sinks

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before, set_before = files(), spark.conf.get(sinks.CLEANUP)
    table = sinks.landed(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    until = time.time() + 20
    while (left := files() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and spark.conf.get(sinks.CLEANUP) == set_before and table.count() == 7


def test_cover_candidates_are_joined_without_texts(spark, monkeypatch, tmp_path):
    from proofmill.operators import windows
    from proofmill.plans import evidence, registry, views

    registry.load()
    monkeypatch.setattr(views, "_LANDED_AT", {})
    kept = {}
    real = windows.landed
    monkeypatch.setattr(windows, "landed", lambda df, name: kept.setdefault(name, real(df, name)))
    texts = [(i, "\n".join(f"line {n} of {i % 70} runs" for n in range(12)), "en", "src1", 200) for i in range(240)]
    spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    inputs = views.Inputs(spark, str(tmp_path))
    rows = evidence.cover_rows(inputs)
    assert "content" not in optimized(rows)
    assert "content" not in kept["slice-bodies"].columns and dict(kept["slice-bodies"].dtypes)["body"] == "binary"
    ids = windows.dedupe_slices(inputs("v_slices"), inputs("v_relations")).filter("status = 'kept'").join(evidence.rel.pinned(inputs), "slice_id", "left_semi")
    assert 0 < rows.count() == ids.count()


def test_claims_in_turns_break_the_same_rules(spark, monkeypatch):
    from proofmill.operators import lineage

    statuses = ["explicit", "observed", "inferred", "unknown", None]
    rows = [(i % 7 or None, f"c{i % 40}" if i % 11 else None, statuses[i % 5], (i % 10) / 10, i % 2, [f"s{i % 9}", f"s{i % 4}", None][: i % 4], [f"s{i % 5}"] if i % 3 else None,
             [f"b{i % 4}", "b-none"][: i % 3], [f"o{i % 6}"][: i % 2]) for i in range(120)]
    claims = spark.createDataFrame(rows, "concept_no long, claim_id string, status string, confidence double, n_limitations long, slice_ids array<string>, counter_ids array<string>, bundle_ids array<string>, observation_ids array<string>")
    pair = lambda rows, a, b: spark.createDataFrame(rows, f"{a} string, {b} string")
    world = [pair([("b0", "explicit"), ("b1", "observed"), ("b2", "observed")], "bundle_id", "ceiling"), pair([("b0", "s0"), ("b0", "s1"), ("b1", "s2"), ("b3", "s3"), ("b2", None)], "bundle_id", "slice_id"),
             pair([(f"s{i}", "docs/adr/1.md" if i % 2 else "x.py") for i in range(7)], "slice_id", "path"), pair([(f"o{i}", s) for i, s in enumerate(["textual", "syntactic", "resolved", "missing"])], "observation_id", "strength"),
             pair([("o0", "s0"), ("o1", "s1"), ("o1", "s2"), ("o5", "s5")], "observation_id", "slice_id")]
    whole = lineage.claim_checks(claims, *world)
    made = []
    real = lineage.write_table
    monkeypatch.setattr(lineage, "write_table", lambda df, path: made.append(path) or real(df, path))
    turns = lineage.claim_checks(claims, *world, claims_a_turn=30)
    assert len(made) == 4 and not re.findall(r"\bJoin\b", optimized(turns))
    seen = lambda df: sorted(str(tuple(r)) for r in df.select("concept_no", "claim_id", "reason", "cited").collect())
    assert seen(turns) == seen(whole) and len({r.reason for r in whole.collect()}) >= 12
    assert len(re.findall(r"\bJoin\b", optimized(whole))) == 1
