"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and every stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from proofmill.llm import decontamination, html_extract, near_dedup, pii, quality_classifier, quality_rules, sentencepiece, substring_dedup, toxicity, warc
from tests.llm.conftest import awkward_rows, prose

N = len(awkward_rows())


@pytest.fixture(scope="module")
def labels(ready):
    return ready.createDataFrame([(0, 1, 0), (1, 0, 1), (2, 1, 1), (2, 1, 0), (3, None, None), (None, 1, 1), (99, 0, 0), (4, 5, 7)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def items(ready):
    return ready.createDataFrame([(1, prose(1, 30)), (2, None), (3, ""), (None, "x y z"), (4, prose(1, 30))], "item_id bigint, text string")


def test_quality_classifier(awkward, nothing, labels):
    out = quality_classifier.classify(awkward, quality_classifier.fit(awkward, labels))
    assert out.count() == N and out.where("kept is null or posterior is null").isEmpty()
    assert quality_classifier.classify(nothing, quality_classifier.fit(nothing, labels)).count() == 0
    unlabelled = quality_classifier.classify(awkward, quality_classifier.fit(awkward, labels.limit(0)))
    assert unlabelled.where("not kept").isEmpty()


def test_sentencepiece(awkward, nothing):
    coded = sentencepiece.encode(awkward, into="coded")
    back = sentencepiece.decode(coded, ids_col="coded", into="back").select("text", "back", "coded").collect()
    assert len(back) == N
    for r in back:
        if r.text is None:
            assert r.coded is None and r.back is None
        else:
            assert r.back == r.text.replace("▁", " ")
    assert sentencepiece.encode(nothing).count() == 0


def test_quality_rules(awkward, nothing):
    voted = quality_rules.with_votes(awkward)
    out = quality_rules.judge(voted, quality_rules.fit(voted))
    assert out.count() == N and out.where("kept is null or n_words is null").isEmpty()
    assert out.where("text is null and (n_words <> 0 or not base_failed)").isEmpty()
    empty = quality_rules.with_votes(nothing)
    assert quality_rules.judge(empty, quality_rules.fit(empty)).count() == 0


def test_toxicity(awkward, nothing, labels):
    out = toxicity.score(awkward, labels)
    assert out.count() == N and out.where("score is null or score < 0 or score > 1").isEmpty()
    assert toxicity.score(nothing, labels).count() == 0
    assert toxicity.score(awkward, labels.where("toxic = 0")).where("score <> 0 or predicted <> 0").isEmpty()


def test_decontamination(awkward, nothing, items):
    found = {(r.doc_id, tuple(m.item_id for m in r.matches)) for r in decontamination.find_matches(awkward, items).collect()}
    assert (1, (1, 4)) in found and (7, ()) in found
    left = decontamination.decontaminate(awkward, items)
    assert left.columns == awkward.columns and left.count() == N - 1
    assert decontamination.decontaminate(nothing, items).count() == 0
    assert decontamination.decontaminate(awkward, items.limit(0)).count() == N


def test_near_dedup(awkward, nothing):
    rows = near_dedup.near_duplicates(awkward).collect()
    assert len(rows) == N
    by = {(r.id, r.n_shingles): r for r in rows}
    assert all(r.component_id == 2 and not r.kept for r in rows if r.id == 6)
    assert by[7, 0].component_id == 7 and by[8, 0].kept and all(r.kept and r.component_id is None for r in rows if r.id is None)
    out = near_dedup.deduplicate(awkward)
    assert out.columns == awkward.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(x for x in ids if x is not None) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 11, 12, 13, 14] and ids.count(None) == 2  # two unlike texts under one id both stay
    assert near_dedup.near_duplicates(nothing).count() == 0 and near_dedup.deduplicate(nothing).count() == 0


def test_substring_dedup(awkward, nothing):
    rows = substring_dedup.repeated_passages(awkward).collect()
    assert len(rows) == N
    for r in rows:
        assert r.n_removed == (r.n_words if r.id == 6 else 0), r
    assert substring_dedup.repeated_passages(nothing).count() == 0


def test_pii(awkward, nothing):
    weights = pii.fit(awkward)
    rows = {r.doc_id: r.spans for r in pii.find_spans(awkward, weights).select("doc_id", "spans").collect()}
    assert [s.kind for s in rows[14]] == ["email", "phone"] and rows[7] == [] and rows[8] == []
    hidden = {r.doc_id: r.text for r in pii.mask(awkward, weights).collect()}
    assert hidden[7] is None and hidden[14].endswith("call <PHONE> or mail <EMAIL>")
    assert pii.find_spans(nothing, pii.fit(nothing)).count() == 0


def test_pages(ready, nothing):
    rows = [(1, "http://a.example/x", "<p>one</p>", "k"), (2, "http://a.example/y", "<p>one</p>", None), (2, "http://a.example/y", "<p>one</p>", None), (3, None, None, "k"), (None, "bad url\r\n", "<p>one</p>", "k"),
            (4, "http://b.example/", "", "k"), (5, "http://b.example/", "<article>" + "<p>word word</p>" * 50_000 + "<p", "k"), (6, "http://b.example/", "a < b &amp &lt;i&gt; <b", "k")]
    pages = ready.createDataFrame(rows, "page_id bigint, url string, html string, digest string")
    out = html_extract.extract(pages).collect()
    text = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and text[3] == "" and text[4] == "" and text[1] == "one" and text[6] == "a < b & <i>" and len(text[5].split()) == 100_000
    archives = warc.write_archives(pages, warc.archive_folder(ready))
    back = warc.read_archives(ready, archives, keep_payloads=True).collect()
    assert len(back) == len(rows)
    kinds = sorted((r.id is None, r.id, r.record_type, r.refers_to) for r in back)
    assert kinds == [(False, 1, "response", None), (False, 2, "revisit", 1), (False, 2, "revisit", 1), (False, 3, "response", None), (False, 4, "revisit", 3), (False, 5, "response", None), (False, 6, "response", None), (True, None, "revisit", 1)]
    empty = pages.limit(0)
    assert html_extract.extract(empty).count() == 0
    assert warc.read_archives(ready, warc.write_archives(empty, warc.archive_folder(ready))).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(ready, awkward, nothing, name, stage):
    folder = "/root/testdata/sf0.001"
    out = stage(ready, awkward, folder)
    assert set(awkward.columns) - {"ids"} <= set(out.columns)
    if name != "token ids":
        assert out.columns == awkward.columns
    assert 0 < out.count() <= N
    assert stage(ready, nothing, folder).count() == 0


def test_all_null_columns_survive(awkward):
    assert awkward.where(F.col("doc_id").isNull() & F.col("text").isNull()).count() == 1


LARGE = 2**53 + 1


def test_large_ids_beside_nulls(ready):
    rows = [(LARGE, prose(1, 80), LARGE), (None, prose(2, 80), None), (LARGE + 2, prose(3, 80), LARGE + 2), (None, None, LARGE)]
    docs = ready.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint").coalesce(1)
    want = [(LARGE, LARGE), (LARGE + 2, LARGE + 2), (None, LARGE), (None, None)]
    pairs = lambda df, a="doc_id", b="n_chars": sorted(((r[a], r[b]) for r in df.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or 0))
    weights = pii.fit(docs)
    items = ready.createDataFrame([(5, prose(9, 30))], "item_id bigint, text string")
    assert pairs(pii.mask(docs, weights)) == want and pairs(pii.find_spans(docs, weights)) == want
    assert pairs(decontamination.decontaminate(docs, items)) == want and pairs(decontamination.find_matches(docs, items)) == want
    assert pairs(near_dedup.deduplicate(docs)) == want
    ids = [LARGE, LARGE + 2, None, None]
    alone = lambda df, name: sorted((r[name] for r in df.collect()), key=lambda x: (x is None, x or 0))
    assert alone(near_dedup.near_duplicates(docs), "id") == ids and alone(substring_dedup.repeated_passages(docs), "id") == ids
    labels = ready.createDataFrame([(LARGE, 1), (LARGE + 2, 0)], "doc_id bigint, toxic int")
    assert alone(toxicity.score(docs, labels), "row_id") == ids
    pages = ready.createDataFrame([(LARGE, "http://a.example/", "<p>x</p>"), (None, "http://a.example/", "<p>y</p>"), (LARGE + 2, "http://a.example/", "<p>z</p>")], "page_id bigint, url string, html string").coalesce(1)
    assert alone(html_extract.extract(pages), "page_id") == [LARGE, LARGE + 2, None]


def test_texts_of_many_numbers_take_linear_time():
    import time

    text = " ".join(f"10.{i % 250}.{i % 7}.{i % 99} +1 ({i % 800 + 100}) 555-{i % 9000 + 1000}" for i in range(34_000))
    weights = {"phone:bias": 0.1, "ip:bias": 0.1, "card:bias": -1.0}
    begun = time.process_time()
    assert len(pii.find(text, weights)) >= 60_000 - 10 and len(text) > 900_000
    assert time.process_time() - begun < 40


def test_an_empty_row_does_not_drive_out_a_document_of_its_id(ready):
    docs = ready.createDataFrame([(1, None), (1, prose(4, 90)), (1, prose(4, 90)), (2, prose(4, 90)), (3, ""), (3, prose(5, 90))], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text or "") for r in near_dedup.deduplicate(docs).collect()) == sorted([(1, ""), (1, prose(4, 90)), (3, ""), (3, prose(5, 90))])


def test_long_passages_enter_automata_in_pieces():
    ws = [f"w{i % 700}" .encode() for i in range(4000)]
    whole = substring_dedup.Automata([(1, b" ".join(ws).decode())], 50)
    cut = substring_dedup.Automata([(1, b" ".join(ws).decode())], 50, piece_words=120, most_letters=500)
    other = [b"x", *ws, b"y", *ws[:40]]  # a passage's windows occur together, so it occurs as a whole
    assert len(cut.all) > 3
    for automata in (whole, cut):
        gone = automata.covered(2, other)
        assert gone[1:4001].all() and not gone[0] and not gone[4001:].any() and not automata.covered(1, other).any()
    words = [f"v{i}" for i in range(1_000_000)]
    large = substring_dedup.Automata([(1, " ".join(words))], 50)
    assert large.covered(2, [w.encode() for w in words]).all()
    del large


def test_a_large_record_is_read_in_bounded_memory(tmp_path):
    import base64
    import hashlib
    import os
    import time

    import pyarrow.fs as fs

    payload = os.urandom(40_000_000)
    path = tmp_path / "large.warc.gz"
    from proofmill.llm.warc import Stream, member, read_member, record
    data = member(record(7, "http://a.example/", payload, 7), 0)
    path.write_bytes(data)
    most = 0

    class Watched(Stream):
        def more(self):
            nonlocal most
            piece = super().more()
            most = max(most, len(self.buffer))
            return piece

    with fs.LocalFileSystem().open_input_file(str(path)) as source:
        begun = time.process_time()
        found, after = read_member(Watched(source, len(data), 0), 0, False)
    assert found["id"] == 7 and found["payload_bytes"] == 40_000_000 and found["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode() and after == len(data)
    assert 0 < most < 20 * warc.READ_BYTES and time.process_time() - begun < 10, (most, time.process_time() - begun)


def test_token_ids_and_round_trip_are_one_pass(ready, awkward):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    out = corpus_pipeline.token_ids(ready, docs, "")
    assert out.columns == [*docs.columns, "ids", "round_trip"]
    want = sentencepiece.decode(sentencepiece.encode(docs), into="decoded").withColumn("round_trip", F.col("decoded").eqNullSafe(F.col("text"))).drop("decoded")
    key = lambda r: repr((r.doc_id, r.text, r.lang, r.ids, r.round_trip))
    assert sorted(map(key, out.collect())) == sorted(map(key, want.collect()))
    assert out.where("not round_trip").count() == 1 and out.where("text is null and not round_trip").count() == 0
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_filter_before_a_shuffle_loses_no_partner(ready, monkeypatch):
    from proofmill.llm import common

    known = ready.createDataFrame([(i,) for i in (0, -1, 7, 2**62, -(2**62), 63, 64, 32768, None, 7)], "k bigint")
    rows = ready.range(-3000, 3000).unionByName(known.select(F.col("k").alias("id")))
    for bits, most in ((common.FILTER_BITS, 14), (64, 6010)):
        kept = [r.id for r in common.perhaps_among(rows, "id", known, "k", bits).collect()]
        assert {0, -1, 7, 2**62, -(2**62), 63, 64} <= set(kept) and None not in kept and len(kept) <= most
    assert common.perhaps_among(rows, "id", known.limit(0), "k").isEmpty()
    # Only texts that share something, and only windows that may begin a passage, go into the shuffles of the joins.
    let_in = []

    def counted(found, column, *more):
        out = common.perhaps_among(found, column, *more)
        let_in.append((found.count(), out.count()))
        return out

    monkeypatch.setattr(substring_dedup, "perhaps_among", counted)
    docs = ready.createDataFrame([(i, prose(i % 60 if i in (3, 63) else i, 200)) for i in range(70)], "doc_id bigint, text string")
    out = substring_dedup.repeated_passages(docs.unionByName(ready.createDataFrame([(100, prose(5, 90) + " other end")], "doc_id bigint, text string")))
    assert {r.id: r.n_removed for r in out.where("n_removed > 0").collect()} == {63: 200, 100: 90}
    (texts, met), (windows, starts) = let_in
    assert texts == 71 and met <= 4 and starts <= 4 < windows
