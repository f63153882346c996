"""Packing, prefix tries and token alignment: edge cases, and results against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from proofmill.llm import alignment, packing, prefix_trie
from proofmill.llm.queries import QUERIES
from tests.llm.conftest import DATA, awkward_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BIG = 2**53 + 1
ODD = "ab c\n\n\t  \r x'sé中　▁<s>\U0001f6000123.,;)}\x1c\x85\x00"


def odd_texts(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 60))) for _ in range(n)]


# -- packing ---------------------------------------------------------------------------------------
def check_pieces(rows, documents, capacity):
    """Pieces equal the library's ids, and every sequence is gapless and not longer than the capacity."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for i, text in documents:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity, partition_rows", [(2048, 20_000), (40, 30), (2048, 7)])
def test_packing_of_awkward_rows(ready, awkward, capacity, partition_rows):
    rows = packing.pack(awkward, capacity=capacity, partition_rows=partition_rows).collect()
    check_pieces(rows, [(r[0], r[1]) for r in awkward_rows()], capacity)


def test_packing_of_odd_texts_and_ids(ready, nothing):
    documents = [*enumerate(odd_texts(3, 600)), (BIG, "big"), (BIG + 2, None), (None, "no id"), (None, "no id"), (4, "<|endoftext|>it's a<|startoftext|> 'twas DON'T 3rd")]
    docs = ready.createDataFrame(documents, "doc_id bigint, text string")
    check_pieces(packing.pack(docs, partition_rows=50).collect(), documents, 2048)
    assert packing.pack(nothing).count() == 0


def test_packing_tokenizes_a_run_of_letters_once():
    """Words that differ in case, digits and punctuation share what is remembered; the ids are the library's."""
    from tokenizers import Tokenizer

    letters = "".join(chr(c) for c in range(0xC0, 0x100))
    texts = ["Word, word WORD! (word) 7word7 wo'rd", None, "", " word  7\t", letters, "don't <|endoftext|> a<|b word中word \x85word", "ÉCOLE-école×école"]
    memory = packing.Remembered(packing.Tokens(packing.default_tokenizer()), 1)
    packing.ids_of(packing.pa.array(texts[:4]), memory)
    assert set(memory.places) == {"word", ",", "!", "(", ")", "7", "wo'rd", ""}
    ends, ids = packing.ids_of(packing.pa.array(texts), memory)
    library = Tokenizer.from_file(packing.default_tokenizer())
    got = [np.frombuffer(ids[a:b], dtype="<u4").tolist() for a, b in zip(ends[:-1], ends[1:])]
    assert got == [library.encode(text or "", add_special_tokens=False).ids for text in texts]


def test_packing_meets_its_bound(ready):
    packed = packing.pack(ready.read.parquet(f"{DATA}/sf0.01/documents.parquet"))
    used, bound = packing.certificate(packed)
    assert used <= bound + 1
    split = packing.pack(ready.read.parquet(f"{DATA}/sf0.01/documents.parquet"), partition_rows=64)
    used, bound = packing.certificate(split)
    assert used <= bound + 2


def test_bounds_hold():
    """No dual feasible function promises more than the best packing of small cases needs."""
    r = random.Random(1)

    def fewest(lengths, capacity):
        best = len(lengths)

        def place(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(lengths):
                best = len(rooms)
                return
            for k in range(len(rooms)):
                if rooms[k] >= lengths[i]:
                    place(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
            place(i + 1, [*rooms, capacity - lengths[i]])

        place(0, [])
        return best

    for _ in range(200):
        capacity = r.randint(5, 12)
        lengths = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 7))), reverse=True)
        bound = packing.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        least = fewest(lengths, capacity)
        assert math.ceil(bound - 1e-9) <= least <= max(packing.best_fit(lengths, capacity)) + 1
    assert math.ceil(packing.lower_bound(np.bincount([7, 7, 7, 6, 6], minlength=12), 11) - 1e-9) == 5


# -- prefix tries ----------------------------------------------------------------------------------
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = (*own.get(c - int(math.fmod(c, 20)), [])[:h], *ts[h:])
    members = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    leaves, saved, out = {}, {}, Counter()
    for node in sorted(members, key=len, reverse=True):
        words = len(WORD.findall(node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in below[node])
        leaves[node] = sum(leaves[k] for k in below[node]) or 1
        ends = ",".join(str(c) for c in sorted(c for c in members[node] if len(whole[c]) == len(node)))
        out[min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def odd_conversations():
    r = random.Random(1)
    rows = [(c if r.random() < 0.97 else None, r.choice([None, 0, 1, 2, 3, 4]), r.choice(["a", None, "b"]), r.choice(["", "x y", " z ", None]), i)
            for i, c in enumerate(c for c in range(-30, 60) for _ in range(r.choice([0, 1, 1, 2, 3, 5, 9, 30])))]
    rows += [(100 + c, t, "user", f"hot {t}", 0) for c in range(60) for t in range(3)]  # one very common conversation
    rows += [(300 + c, 0, "user", "hot 0", 0) for c in range(40)] + [(300 + c, 1, "user", prose(c, 3), 0) for c in range(40)]  # one very common first turn
    rows += [(777, t, "user", str(t % 3), 0) for t in range(500)]
    rows += [(BIG, 0, "user", "big", None), (BIG + 2, 0, "user", "big", None), (BIG, 0, "user", "big", None)]
    return rows


@pytest.mark.parametrize("options", [{}, {"segment_turns": 3, "shard_turns": 5}, {"segment_turns": 1, "shard_turns": 2}, {"segment_turns": 64, "shard_turns": 100}])
def test_prefix_trie(ready, options):
    rows = odd_conversations()
    turns = ready.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, depth bigint")
    got = Counter(tuple(r[c] for c in COLUMNS) for r in prefix_trie.prefix_trie(turns, **options).collect())
    assert got == trie_by_hand([r[:4] for r in rows])


def test_prefix_trie_of_few_rows(ready):
    none = ready.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert prefix_trie.prefix_trie(none).count() == 0
    for c in range(8):  # some of these conversations lose all their turns
        rows = [(c, 0, None, None), (None, 1, "a", "b")]
        got = Counter(tuple(r[c] for c in COLUMNS) for r in prefix_trie.prefix_trie(ready.createDataFrame(rows, none.schema)).collect())
        assert got == trie_by_hand(rows)


def test_double_array_holds_just_its_sequences():
    r = np.random.default_rng(3)
    sequences = [r.integers(0, 40, r.integers(0, 9)) for _ in range(400)]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
    trie = prefix_trie.DoubleArray(np.concatenate(sequences), starts)
    prefixes = {tuple(s[:d]) for s in sequences for d in range(1, len(s) + 1)}
    assert sum(map(len, trie.levels)) == len(prefixes)
    slots = set()
    for p in prefixes:
        at = np.array([0])
        for code in p:
            at = trie.child(at, np.array([code]))
        slots.add(int(at[0]))
    assert -1 not in slots and len(slots) == len(prefixes)
    for p in list(prefixes)[:200]:
        for code in range(40):
            if (*p, code) not in prefixes:
                at = np.array([0])
                for x in (*p, code):
                    at = trie.child(at, np.array([x]))
                assert at[0] == -1


# -- alignment -------------------------------------------------------------------------------------
def aligned_by_hand(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.default_tokenizers()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    found, counts = [], Counter()
    for i, text in rows:
        sides = []
        if text:
            encoded = a.encode(" " + text, add_special_tokens=False)
            sides = [[(x, bytes(letters[c] for c in s)) for x, s in zip(encoded.ids, encoded.tokens)],
                     [(x, bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode()) for x in b.encode(text)]]
            if any(b"".join(s for _, s in side) != (" " + text).encode() for side in sides):
                sides = []
        spans = []
        for side in sides:
            at, out = 0, []
            for x, s in side:
                out.append((at, at + len(s), x))
                at += len(s)
            spans.append(out)
        spans = spans or [[], []]
        links = [(x, y) for s, e, x in spans[0] for t, f, y in spans[1] if s < f and t < e] if len(spans[0]) < 400 else None
        if links is None:  # long texts: sweep
            links, j = [], 0
            for s, e, x in spans[0]:
                while spans[1][j][1] <= s:
                    j += 1
                k = j
                while k < len(spans[1]) and spans[1][k][0] < e:
                    links.append((x, spans[1][k][2]))
                    k += 1
        groups, p, q = [], 0, 0
        for end in sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}):
            k, m = p, q
            while p < len(spans[0]) and spans[0][p][1] <= end:
                p += 1
            while q < len(spans[1]) and spans[1][q][1] <= end:
                q += 1
            groups.append(",".join(str(x) for _, _, x in spans[0][k:p]) + "|" + ",".join(str(x) for _, _, x in spans[1][m:q]))
        counts.update(links)
        found.append((i, len(spans[0]), len(spans[1]), groups, links))
    highest = defaultdict(int)
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return Counter((i, n, m, len(g), len(ls), sum(counts[p] == highest[p[1]] for p in ls), sum(counts[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
                   for i, n, m, g, ls in found)


@pytest.mark.parametrize("options", [{}, {"task_bytes": 500, "radixes": 3, "memory_words": 300}])
def test_alignment_of_odd_texts(ready, options):
    rows = [*enumerate(odd_texts(2, 900)), (None, "hello"), (None, None), (BIG, "big id"), (BIG + 2, ""), (5, "<|endoftext|> </s> <unk> x"), (5, "<|endoftext|>"), (6, "x" * 20_000), (7, "\n\n  y  \n  z\r\n w")]
    got = Counter(tuple(r) for r in alignment.align(ready.createDataFrame(rows, "doc_id bigint, text string"), **options).collect())
    assert got == aligned_by_hand(rows)


def test_alignment_of_awkward_rows(awkward, nothing):
    got = Counter(tuple(r) for r in alignment.align(awkward).collect())
    assert got == aligned_by_hand([(r[0], r[1]) for r in awkward_rows()])
    assert alignment.align(nothing).count() == 0


def test_alignment_of_documents(ready):
    rows = [tuple(r) for r in ready.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in QUERIES["op13_alignment"](ready, f"{DATA}/sf0.001").collect())
    assert got == aligned_by_hand(rows)


def test_merging_equals_sorting():
    r = np.random.default_rng(5)
    runs, want = [], Counter()
    for _ in range(30):
        n = int(r.integers(1, 40_000))
        pairs = np.sort(r.integers(0, 3000, n)) << 3
        times = r.integers(1, 5, n).astype(np.uint32)
        for p, t in zip(pairs.tolist(), times.tolist()):
            want[p] += t
        runs.append((int(pairs[0]), n, alignment.packed(np.diff(pairs, prepend=0).astype("<i8"), np.zeros(n, dtype="<u4"), times.astype("<u4"))))
    blocks = list(alignment.merged(runs))
    pairs = np.concatenate([b[0] for b in blocks])
    assert np.all(pairs[1:] > pairs[:-1])
    assert dict(zip(pairs.tolist(), np.concatenate([b[1] for b in blocks]).tolist())) == want
