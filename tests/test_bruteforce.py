"""Distributed operators against plain re-computations on small random inputs."""

import random
from dataclasses import replace
from types import SimpleNamespace

from pyspark.sql import functions as F

from proofmill.fixed_values import BLUEPRINT_SECTIONS, STRENGTH_LEVELS
from proofmill.operators import cover, intervals, observations
from proofmill.params import DEFAULT
from proofmill.sources import scans
from tests import greedy


def naive_cover(windows, start, end):
    order = sorted(windows, key=lambda w: (-w[1], w[0], w[2]))
    picked, at = [], start
    while at <= end:
        w = next((w for w in order if w[0] <= at <= w[1]), None)
        if w is None:
            return None
        picked.append(w[2])
        at = w[1] + 1
    return picked


def test_interval_cover(spark):
    rng = random.Random(3)
    windows, spans = [], []
    for f in range(8):
        for i in range(25):
            s = rng.randint(1, 200)
            windows.append(("r", "v", f"p{f}", f"s{f}-{i}", s, s + rng.randint(0, 60)))
        spans += [("r", "v", f"p{f}", i, *(lambda a: (a, a + rng.randint(-1, 90)))(rng.randint(0, 200))) for i in range(25)]
    w = spark.createDataFrame(windows, "full_name string, revision string, path string, slice_id string, start_line long, end_line long")
    q = spark.createDataFrame(spans, "full_name string, revision string, path string, n long, start_line long, end_line long")
    out = intervals.interval_cover(q, w, ["path", "n"])
    got = {(r.path, r.n): list(r.witnesses) for r in out.collect()}
    want = {}
    for _r, _v, p, n, s, e in spans:
        found = naive_cover([(x[4], x[5], x[3]) for x in windows if x[2] == p], s, e) if 1 <= s <= e else None
        if found:
            want[(p, n)] = found
    assert got == want and len(want) > 20
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_interval_cover_of_very_many_windows(spark):
    """One interval under 100,000 windows: the list is walked once."""
    import time

    windows = spark.range(100_000).selectExpr("'r' full_name", "'v' revision", "'p' path", "concat('s', lpad(id, 6, '0')) slice_id", "id + 1 start_line", "id + 300 end_line")
    one = spark.createDataFrame([("r", "v", "p", 1, 5, 100_000)], "full_name string, revision string, path string, n long, start_line long, end_line long")
    begun = time.time()
    found = intervals.interval_cover(one, windows, ["path", "n"]).first().witnesses
    assert time.time() - begun < 90
    at, want = 5, []
    while at <= 100_000:  # the window that starts at the line reaches furthest
        want.append(f"s{at - 1:06d}")
        at += 300
    assert list(found) == want


ROW = ("full_name string, slice_id string, path string, start_line long, end_line long, relevance long, revision string, chars long, plain boolean, "
       "anchor boolean, features array<string>, endpoint boolean")


def test_reduced_candidates_give_the_same_cover(spark):
    rng = random.Random(5)
    names = ["modality:test", "modality:implementation", "role:contract", "role:failure", "task:a", "task:b", "task:c"]
    rows = [("r", f"s{i:04d}", f"p{i % 40}", 1, 9, rng.randint(0, 6), "v", rng.randint(5, 60), False, False,
             sorted(rng.sample(names, rng.randint(1, 4))), False) for i in range(600)]
    df = spark.createDataFrame(rows, ROW)
    reduced = cover.reduce_candidates(df).collect()
    for slots, chars in ((48, 10_000), (6, 90), (3, 40)):
        full = greedy.greedy_cover(df.collect(), [], slots, chars)
        small = greedy.greedy_cover(reduced, [], slots, chars)
        assert [(x.slice_id, g) for x, g, _ in full] == [(x.slice_id, g) for x, g, _ in small]
        assert sum(x.chars for x, _g, _f in full) <= chars
    assert len(reduced) < 400


def test_cover_rounds_match_the_loop(spark):
    rng = random.Random(13)
    names = ["modality:test", "modality:implementation", "modality:documentation", "role:contract", "role:failure", "task:a", "task:b", "task:c"]
    repos, items, edges = [f"r{i}" for i in range(7)], [], []
    for repo in repos[:-1]:
        for i in range(40):
            start = rng.randint(1, 30)
            items.append((repo, f"{repo}-s{i:03d}", f"p{rng.randint(0, 6)}", start, start + rng.randint(0, 20), rng.randint(0, 6), "v", rng.randint(5, 60), False, rng.random() < 0.4,
                          sorted(rng.sample(names, rng.randint(0, 3))), True))
        for _ in range(rng.choice([0, 3, 12])):
            src, dst, start = f"p{rng.randint(0, 6)}", f"p{rng.randint(0, 6)}", rng.randint(1, 30)
            edges.append(dict(full_name=repo, src=src, dst=dst, s=start, e=start + rng.randint(0, 25), located=rng.random() < 0.8))
    selected = [("t1", "r0", 1), ("t1", "r1", 2), ("t2", "r2", 1), ("t3", "r6", 1), ("t3", "r3", 4), ("t3", "r4", 7), ("t4", "r0", 2), ("t5", "r5", 1), ("t6", "r6", 1)]
    candidates = spark.createDataFrame(items, ROW)
    relations = spark.createDataFrame([(e["full_name"], e["src"], e["dst"], e["src"] if e["located"] else "other", f"https://host.example/x#L{e['s']}-L{e['e']}") for e in edges],
                                      "full_name string, src string, dst string, evidence_path string, source_url string")
    chosen = spark.createDataFrame(selected, "task_id string, full_name string, selection_rank long")
    backed = 0
    for slices, chars in ((48, 100_000), (5, 100_000), (48, 130), (1, 60)):
        out = cover.select_cover(chosen, candidates, relations, replace(DEFAULT, max_slices=slices, slice_characters=chars)).collect()
        got = {(r.task_id, r.full_name, r.slice_id): (r.place, r.status, r.gain, tuple(r.gains)) for r in out}
        want = greedy.cover_of_tasks(selected, candidates.collect(), edges, slices, chars)
        assert len(out) == len(got)
        for k, v in want.items():
            assert got[k] == v, k
        backed += sum("role:relationship" in v[3] for v in want.values())
    assert backed > 3


def test_cover_spreads_the_candidates_of_one_task(spark):
    rows = spark.range(0, 200_000, 1, 8).selectExpr("'r' full_name", "cast(id as string) slice_id", "concat('p', id % 5000) path", "1L start_line", "9L end_line", "id % 7 relevance", "'v' revision",
                                                    "id % 900 + 1 chars", "false plain", "false anchor", "array(concat('task:', id % 11), concat('task:', id % 13)) features", "true endpoint")
    relations = spark.createDataFrame([], "full_name string, src string, dst string, evidence_path string, source_url string")
    one = spark.createDataFrame([("t", "r", 1)], "task_id string, full_name string, selection_rank long")
    out = cover.select_cover(one, rows, relations)
    assert out.filter("status = 'selected'").count() >= 7 and out.count() == 200_000
    import inspect

    assert "InPandas" not in inspect.getsource(cover)


def test_supported_edge_completes_the_relationship():
    edge = dict(src="a", dst="b", s=1, e=4, located=True)

    def item(i, path, anchor, s, e):
        return SimpleNamespace(slice_id=i, path=path, anchor=anchor, start_line=s, end_line=e, relevance=1, chars=5, features=["modality:implementation"])

    picked = greedy.greedy_cover([item("x", "a", True, 1, 4), item("y", "b", False, 1, 9)], [edge], 10, 100)
    assert [(p.slice_id, g) for p, g, _ in picked] == [("x", 1080), ("y", 200)]


def test_observation_selection_matches_the_naive_greedy(spark):
    rng = random.Random(7)
    obs = [("r", rng.choice(BLUEPRINT_SECTIONS), f"d{i:03d}", rng.choice(STRENGTH_LEVELS), sorted({f"p{rng.randint(0, 20)}" for _ in range(2)}),
            sorted({f"s{rng.randint(0, 30)}" for _ in range(3)})) for i in range(160)]
    slices = [(f"s{i}", i * 40) for i in range(31)]
    rel = dict(slices)
    rank = {s: i for i, s in enumerate(STRENGTH_LEVELS)}
    left, secs, paths, ids, want = list(obs), set(), set(), set(), []
    while left and len(want) < 30:
        def score(o):
            return ((o[1] not in secs) * 1000 + rank[o[3]] * 100 + 20 * len(set(o[4]) - paths) + 10 * len(set(o[5]) - ids) + min(9, max(rel[x] for x in o[5]) / 100))
        left.sort(key=lambda o: (-score(o), BLUEPRINT_SECTIONS.index(o[1]), o[2]))
        o = left.pop(0)
        want.append(o[2])
        secs.add(o[1])
        paths |= set(o[4])
        ids |= set(o[5])
    df = spark.createDataFrame(obs, "full_name string, section string, discriminator string, strength string, paths array<string>, slice_ids array<string>")
    s = spark.createDataFrame(slices, "slice_id string, relevance long")
    got = observations.select_observations(df, s, replace(DEFAULT, observations_per_repository=30)).orderBy("place")
    assert [r.discriminator for r in got.collect()] == want


def test_whole_observation_order_of_several_repositories(spark):
    rng = random.Random(17)
    obs = [(f"r{rng.randint(0, 3)}", rng.choice(BLUEPRINT_SECTIONS), f"d{i:03d}", rng.choice(STRENGTH_LEVELS), sorted({f"p{rng.randint(0, 9)}" for _ in range(rng.randint(0, 3))}),
            sorted({f"s{rng.randint(0, 50)}" for _ in range(rng.randint(1, 4))})) for i in range(300)]
    obs += [("r9", "contracts", f"same{i:03d}", "syntactic", ["one"], ["s1"]) for i in range(60)]  # all compete for the same things
    slices = [(f"s{i}", i * 40) for i in range(45)]
    rel, rank, want = dict(slices), {s: i for i, s in enumerate(STRENGTH_LEVELS)}, []
    for repo in sorted({o[0] for o in obs}):
        left, secs, paths, ids = [o for o in obs if o[0] == repo], set(), set(), set()
        n = 0
        while left:
            def score(o):
                known = [rel[x] for x in o[5] if x in rel]
                return ((o[1] not in secs) * 1000 + rank[o[3]] * 100 + 20 * len(set(o[4]) - paths) + 10 * len(set(o[5]) - ids) + min(9, max([0, *known]) / 100))
            left.sort(key=lambda o: (-score(o), BLUEPRINT_SECTIONS.index(o[1]), o[2]))
            n += 1
            want.append((repo, left[0][1], left[0][2], n, round(score(left[0]), 6)))
            o = left.pop(0)
            secs.add(o[1])
            paths |= set(o[4])
            ids |= set(o[5])
    df = spark.createDataFrame(obs, "full_name string, section string, discriminator string, strength string, paths array<string>, slice_ids array<string>")
    got = observations.select_observations(df, spark.createDataFrame(slices, "slice_id string, relevance long"))
    assert sorted((r.full_name, r.section, r.discriminator, r.place, round(r.utility, 6)) for r in got.collect()) == sorted(want)
    assert observations.select_observations(df.limit(0), spark.createDataFrame(slices, "slice_id string, relevance long")).count() == 0


def test_workspace_budget_skips_but_goes_on(spark):
    rng = random.Random(11)
    files = [(f"w{i % 3}", f"f{i:03d}.css", "x" * rng.randint(0, 90)) for i in range(90)]
    limits = replace(DEFAULT, workspace_files=12, workspace_characters=500, workspace_file_characters=70)
    kept, skipped = scans.budget_workspace_files(spark.createDataFrame(files, "workspace string, path string, content string"), limits)
    want_kept, want_skip = set(), {}
    for w in ("w0", "w1", "w2"):
        n = used = 0
        for ws, p, c in sorted(files):
            if ws != w:
                continue
            if n >= 12:
                want_skip[(w, p)] = "maximum-files-reached"
            elif used >= 500:
                want_skip[(w, p)] = "maximum-characters-reached"
            elif len(c) > 70 or len(c) > 500 - used:
                want_skip[(w, p)] = "file-exceeds-remaining-character-budget"
            else:
                n, used = n + 1, used + len(c)
                want_kept.add((w, p))
    assert {(r.workspace, r.path) for r in kept.collect()} == want_kept
    assert {(r.workspace, r.path): r.reason for r in skipped.collect()} == want_skip


def test_readers_round_trip_through_files(spark, tmp_path):
    rows = [("a/b", "https://host.example/a/b", None, 5.0, 1.0, 0.0, 10.0, False, False, "main", "2020-01-01T00:00:00Z", "2019-01-01T00:00:00Z", ("NOASSERTION",), None, None)]
    spark.createDataFrame(rows, scans.RAW_REPOSITORY).write.json(str(tmp_path / "repos"))
    r = scans.read_repositories(spark, str(tmp_path / "repos")).first()
    assert (r.description, r.license, r.topics, r.stars) == ("", None, [], 5)
    (tmp_path / "ws" / "one" / "src").mkdir(parents=True)
    (tmp_path / "ws" / "one" / "src" / "a.css").write_text("body{}")
    (tmp_path / "ws" / "one" / "src" / "server.ts").write_text("x")
    kept, _over = scans.scan_workspaces(scans.read_workspaces(spark, str(tmp_path / "ws")))
    assert [(k.workspace, k.path, k.content) for k in kept.collect()] == [("one", "src/a.css", "body{}")]


def test_fingerprint_ignores_row_order_but_not_bytes(spark):
    from proofmill.operators.fingerprints import group_fingerprint

    df = spark.createDataFrame([("p", "a", "x"), ("p", "b", None), ("p", "b", "")], "k string, path string, content string")

    def value(d):
        return group_fingerprint(d, ["k"], ["path", "content"]).first().fingerprint

    assert value(df) == value(df.orderBy(F.desc("path")).repartition(3))
    assert value(df) != value(df.withColumn("content", F.coalesce("content", F.lit(""))))
