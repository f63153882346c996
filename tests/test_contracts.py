"""Small inputs with known results."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from proofmill.functions import paths as pt
from proofmill.functions import text as tx
from proofmill.operators import cover, domain, evals, scoring, style, windows
from proofmill.params import DEFAULT

TREE = ["README.md", "docs/architecture/queue.md", "lib/queue.ts", "examples/drain.ts", "test/queue.test.ts", ".github/workflows/verify.yml", "CONTRIBUTING.md", "package.json", "tsconfig.json"]
NOW = "2026-09-01 00:00:00"


def repo(spark, **over):
    base = dict(full_name="lakeside/queue", stars=7300, forks=410, size_kb=9100, archived=False, fork=False, license="MIT", pushed_at="2026-08-01 00:00:00")
    base.update(over)
    schema = "full_name string, stars long, forks long, size_kb long, archived boolean, fork boolean, license string, pushed_at string"
    return spark.createDataFrame([tuple(base[c.split()[0]] for c in schema.split(", "))], schema)


def scored(spark, tree=TREE, **over):
    df = spark.createDataFrame([("lakeside/queue", "blob", p) for p in tree], "full_name string, type string, path string")
    flagged = scoring.with_flags(repo(spark, **over), scoring.tree_flags(df))
    return scoring.score_repositories(flagged, F.lit(NOW)).first()


def test_scores_of_a_mature_repository(spark):
    r = scored(spark)
    assert (r.maturity, r.transferability, r.clarity, r.design, r.risk) == (96, 100, 90, 95, 5)


def test_archived_and_stale_risk_is_53(spark):
    assert scored(spark, archived=True, pushed_at="2020-01-01 00:00:00").risk == 53


def test_empty_tree_and_large_repository_transfer_is_65(spark):
    assert scored(spark, tree=[], size_kb=200_000).transferability == 65


def test_between_180_and_730_days_is_neither_recent_nor_stale(spark):
    r = scored(spark, pushed_at="2025-09-01 00:00:00")
    assert r.risk == 5 and "Recently maintained" not in r.maturity_reasons and "Maintenance appears stale" not in r.maturity_reasons


@pytest.mark.parametrize("license_", [None, "GPL-3.0", "MIT"])
def test_licence_changes_warnings_only(spark, license_):
    df = repo(spark, license=license_)
    warn = scoring.license_policy(df).first()
    strict = scoring.license_policy(df, replace(DEFAULT, license_policy="allowlist")).first()
    assert warn.license_rejections == [] and bool(strict.license_rejections) == (license_ != "MIT")


def fuse(spark, batches):
    rows = [("t", q, i + 1, n, s) for q, batch in enumerate(batches) for i, (n, s) in enumerate(batch)]
    hits = spark.createDataFrame(rows, "task_id string, query_no int, hit_rank long, full_name string, stars long")
    dom = spark.createDataFrame([("t", "x", 0)], "task_id string, full_name string, domain long")
    return [(r.full_name, r.score) for r in domain.fuse_search_hits(hits, dom).orderBy("candidate_rank").collect()]


def test_cross_query_agreement_wins(spark):
    assert [n for n, _ in fuse(spark, [[("once", 5000), ("again", 200)], [("again", 200)]])] == ["again", "once"]


def test_duplicate_hits_count_once(spark):
    assert fuse(spark, [[("a", 100)] * 3]) == fuse(spark, [[("a", 100)]])


def test_domain_terms_match_words_not_substrings(spark):
    rows = [("fooCacheBar baz", "cache", True), ("concatenate", "cat", False), ("LRUCache", "lru cache", True), ("解析器工具", "解析", True), ("x", "", False)]
    df = spark.createDataFrame(rows, "text string, term string, want boolean")
    assert df.filter(tx.contains_term(F.col("text"), F.col("term")) != F.col("want")).count() == 0


def test_match_terms_needs_no_nested_loop(spark):
    texts = spark.createDataFrame([("r1", "hot ring tool"), ("r2", "ring"), ("r3", "解析 器")], "full_name string, norm string")
    terms = spark.createDataFrame([("ring",), ("hot ring",), ("析",)], "term string")
    out = domain.match_terms(texts, ["full_name"], "norm", terms)
    assert {tuple(r) for r in out.collect()} == {("r1", "ring"), ("r2", "ring"), ("r1", "hot ring"), ("r3", "析")}
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rank_caps_are_pruned_before_the_shuffle(spark):
    from proofmill.operators.structure import cap_per_group

    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    assert "WindowGroupLimit" in cap_per_group(df, ["k"], ["id"], 3)._jdf.queryExecution().toString()


def test_path_classes(spark):
    rows = [("src/a.ts", True, False), ("test/a.test.ts", False, True), ("conftest.py", False, False), ("tests/conftest.py", False, False), ("a.d.ts", False, False),
            ("main.py", True, False), ("scripts/tool.py", False, False), ("pkg/mod.py", True, False), ("src/build.rs", False, False)]
    df = spark.createDataFrame(rows, "path string, impl boolean, test boolean")
    p = F.col("path")
    assert df.filter((pt.is_implementation(p) != F.col("impl")) | (pt.is_test(p) != F.col("test"))).collect() == []


def test_join_path_folds_dots(spark):
    rows = [("src/a", "../b/./c", "src/b/c"), (".", "./x", "x"), ("a", "../../b", "../b"), ("a", "..", ".")]
    df = spark.createDataFrame(rows, "base string, rel string, want string")
    assert df.filter(pt.join_path(F.col("base"), F.col("rel")) != F.col("want")).collect() == []


def audit(spark, path, content):
    src = spark.createDataFrame([("w", path, content)], "workspace string, path string, content string")
    facts = style.workspace_facts(src, style.style_metrics(src))
    found = style.style_audit(facts).filter("profile = 'calm-product'")
    status = style.audit_status(facts, style.style_audit(facts)).filter("profile = 'calm-product'").first().status
    return {(r.signal, r.severity) for r in found.collect()}, status


def test_black_boxed_sheet_is_blocked(spark):
    boxes = " ".join(f"#tile{i} .card {{ border: 2px dashed #555; border-radius: 9px; }}" for i in range(9))
    found, status = audit(spark, "web/night.css", f"html {{ background-color: #000; color: #ddd; font-size: 16px; }} {boxes}")
    assert status == "blocked" and ("pure-black-surface", "error") in found
    assert {"uniform-radius-repetition", "weak-type-hierarchy", "responsive-evidence-missing"} <= {s for s, _ in found}


def test_near_black_class_is_a_warning(spark):
    found, _ = audit(spark, "web/Panel.jsx", '<aside className="p-4 bg-neutral-950 text-base"><b>status</b></aside>')
    assert ("near-black-surface", "warning") in found and not any(s == "pure-black-surface" for s, _ in found)


def test_tokenised_responsive_sheet_is_clean(spark):
    sheet = "\n".join([
        ":root { --paper: #eef2f0; --sheet: #ffffff; --text: #2b2f33; --mark: #7a3e1d; }",
        "main { background: var(--paper); color: var(--text); font-size: 17px; }",
        ".title { font-size: 52px; } .lead { font-size: 26px; } .note { font-size: 12px; }",
        ".action { background: var(--mark); border-radius: 8px; } .page { background: var(--sheet); border-radius: 3px; }",
        "@media (min-width: 960px) { .lead { font-size: 30px; } }"])
    assert audit(spark, "web/day.css", sheet) == (set(), "clean")


def test_eval_summary_and_plan(spark):
    runs = spark.createDataFrame([("a", "baseline", 1, 100.0, 2), ("b", "treatment", 0, 50.0, 4), ("c", "treatment", None, 70.0, 0)],
                                 "run_id string, variant string, verification_exit_code int, duration_ms double, changed_files long")
    got = {r.variant: (r.runs, r.verified, r.verification_rate, r.avg_duration_ms) for r in evals.eval_summary(runs, ("baseline", "treatment", "none")).collect()}
    assert got == {"baseline": (1, 0, 0.0, 100.0), "treatment": (2, 1, 0.5, 60.0), "none": (0, 0, 0.0, 0.0)}
    tasks = spark.createDataFrame([("s", "t", 2)], "suite string, task_id string, repetitions long")
    assert evals.eval_plan(tasks).count() == 4


def test_last_object_in_free_text():
    assert evals.last_object('x {broken {"a": "}"} ') is None
    assert evals.last_object('{"a": 1} noise {"b": "x}y"} {bad}') == '{"b": "x}y"}'
    assert evals.last_object("nothing") is None


SLICE = ("slice_id string, full_name string, revision string, path string, start_line long, end_line long, relevance long, strategy string, "
         "evidence_roles array<string>, architecture_roles array<string>, content string")


def test_refinement_keeps_marginal_evidence_and_audits_duplicates(spark):
    api = "export interface Api {}"
    rows = [("one", "r", "v", "src/api.ts", 1, 2, 20, "typescript-ast", ["implementation"], ["contract"], api),
            ("two", "r", "v", "src/copy.ts", 1, 2, 20, "typescript-ast", ["implementation"], ["contract"], api + "\n"),
            ("blank", "r", "v", "src/b.ts", 1, 1, 9, "line-window", None, [], " \n"),
            ("test", "r", "v", "test/api.test.ts", 1, 2, 20, "typescript-ast", ["test"], ["invariant", "test"], "test('api', () => expect(true))")]
    slices = spark.createDataFrame(rows, SLICE)
    edges = spark.createDataFrame([], "full_name string, revision string, src string, dst string, kind string, source_url string, evidence_path string")
    status = {r.slice_id: r.status for r in windows.dedupe_slices(slices, edges).collect()}
    assert status == {"one": "kept", "two": "duplicate", "blank": "low-value", "test": "kept"}
    kept = slices.filter(F.col("slice_id").isin("one", "test"))
    terms = spark.createDataFrame([("r", "api")], "full_name string, term string")
    chosen = spark.createDataFrame([("t", "r", 1)], "task_id string, full_name string, selection_rank long")
    out = cover.select_cover(chosen, cover.cover_candidates(kept, edges, terms), edges).collect()
    assert {(r.slice_id, r.status, r.gain) for r in out} == {("test", "selected", 1420), ("one", "selected", 1200)}
    roles = cover.role_coverage(kept, edges).first()
    assert roles.covered == ["contract", "invariant", "test"] and roles.missing == ["failure", "relationship"]


def test_multi_line_strings_of_manifests(spark):
    from proofmill.sources.manifests import python_manifest_facts

    text = '''[project]
name = """demo"""
description = """
several lines with a [list and "quotes"
dependencies = ["not-this"]
"""
# a comment with """ and [ in it
dependencies = [
    "one>=1",  # why """
    "two",
]
readme = ''' + "'''a\n[b\'\'\'" + '''

[project.scripts]
run = "demo:main"
'''
    files = spark.createDataFrame([("r", "v", "pyproject.toml", text)], "full_name string, revision string, path string, content string")
    row = python_manifest_facts(files).first()
    import tomllib

    want = tomllib.loads(text)["project"]
    assert (row.package_name, row.dependencies, row.scripts, row.entry_targets, row.status) == (want["name"], want["dependencies"], ["run"], ["demo:main"], "parsed")


def test_style_names_are_listed_before_reading(spark, tmp_path):
    import fnmatch
    import re

    from proofmill import fixed_values as fv
    from proofmill.sources import scans

    names = ["a.css", "B.SCSS", "x.vue", "tailwind.config.ts", "Theme.json", "themes.js", "tokens.dark.mjs", "design-tokens.cjs", "styles.ts", "style.json", "palette.js", "a.txt", "server.ts", "main.rs", "theme.py"]
    glob = scans.style_glob()
    for name in names:
        accepted = bool(re.search(fv.STYLE_FILE, name) or re.search(fv.STYLE_CONFIG, name))
        assert not accepted or any(fnmatch.fnmatchcase(name, g) for g in glob.strip("{}").split(",")), name
        (tmp_path / "ws").mkdir(exist_ok=True)
        (tmp_path / "ws" / name).write_text("x")
    read = scans.read_workspaces(spark, str(tmp_path))
    assert {r.path for r in read.collect()} == {n for n in names if re.search(fv.STYLE_FILE, n) or re.search(fv.STYLE_CONFIG, n)}
    assert not any(f.endswith((".txt", ".rs", ".py", "server.ts")) for f in read.inputFiles())


def test_roles_of_exports_error_signals_and_variants(spark):
    from proofmill.operators import windows as wn

    base = "name string, language string, visibility string, role string, kind string, raises array<string>, catches array<string>, unsafe_count long, assertion_count long, has_body boolean, fields array<string>, bases array<string>"
    more = base + ", exported boolean, error_signals array<string>, variants array<string>"
    row = lambda name, visibility="", role="implementation", kind="function", fields=(), exported=None, signals=(), variants=(): (
        name, "typescript", visibility, role, kind, [], [], 0, 0, True, list(fields), [], exported, list(signals), list(variants))
    rows = [row("_hidden"), row("_shared", exported=True), row("parse", signals=["ParseError"]), row("Shape", kind="enum", variants=["Square"]), row("inner", visibility="private"), row("Suite", role="test", kind="class")]
    full = spark.createDataFrame(rows, more)
    found = {r.name: r for r in full.select("name", wn.semantic_roles(full).alias("s"), wn.architecture_roles(full).alias("a"), wn.inspected_roles(full).alias("i"), wn.failure_signals(full).alias("f")).collect()}
    assert found["_hidden"].s == [] and found["_shared"].s == ["contract"] and found["parse"].s == ["contract", "failure"] and found["parse"].f == ["ParseError"]
    assert found["Shape"].a == ["contract", "data-model"] and found["inner"].s == ["contract"] and found["inner"].i == [] and found["Suite"].s == ["test"] and found["Suite"].i == []
    few = spark.createDataFrame([r[:12] for r in rows], base)
    assert {r.name: r.s for r in few.select("name", wn.semantic_roles(few).alias("s")).collect()}["_shared"] == []


def test_capability_coverage_lists_supporting_paths(spark):
    from proofmill.operators import domain

    concepts = spark.createDataFrame([("t", "capability", 1, "Retry Budget", ["again"]), ("t", "capability", 2, "json dumps", []), ("t", "capability", 3, "gone word", []),
                                      ("u", "capability", 1, "json dumps", []), ("u", "capability", 2, "again", []), ("u", "purpose", 0, "json", [])],
                                     "task_id string, kind string, ordinal int, name string, aliases array<string>")
    slices = spark.createDataFrame([("s1", "r", "src/b.py", ["implementation"], "a retry\n budget"), ("s2", "r", "src/b.py", ["implementation"], "try again, json"), ("s3", "r", "src/a.py", ["implementation"], "again"),
                                    ("s4", "r", "tests/c.py", ["test"], "json.dumps(x)"), ("s5", "r", "docs/d.md", [], "json dumps again"), ("s6", "q", "x.py", ["test"], "budget"), ("s7", "q", "y.py", ["test"], "nothing")],
                                   "slice_id string, full_name string, path string, evidence_roles array<string>, content string")
    out = {(r.task_id, r.full_name): (r.matched, r.total, r.paths, r.evidence) for r in domain.content_capability_coverage(concepts, slices).collect()}
    assert out == {("t", "r"): (2, 3, 3, ["json dumps: src/b.py, tests/c.py", "retry budget: src/a.py, src/b.py"]),
                   ("t", "q"): (1, 3, 1, ["retry budget: x.py"]),
                   ("u", "r"): (2, 2, 3, ["again: src/a.py, src/b.py", "json dumps: src/b.py, tests/c.py"])}
