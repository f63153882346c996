"""Alignment of two tokenizers over the same bytes, with corpus-wide link counts by external spill counting.

1. A chunk of documents is encoded by both tokenizers.  Words (with the white space before them) are encoded and aligned once while a worker
   remembers them: both tokenizers end a token at each word's end.  A link is a pair of tokens whose byte ranges overlap; a group is
   what lies between two neighbouring offsets where tokens of both end.
2. The chunk's links become pair-document records (pair, document, times) in order of the pair, side B first.  They are radix-partitioned
   by the B id, and each part is one sorted run, compressed with zstd: a row of the table of runs.
3. Runs of one radix are dealt to tasks of about `task_bytes` (so no B id, however common, has to fit one task); each task merges its runs
   with a heap over their blocks and counts each pair.  The tasks' counts of a pair are added, and each B id's highest count is the
   maximum over its pairs, which lie together in that order.
4. The runs are read once more beside the counts of their radix, and what each record contributes goes back to its document: sums by
   chunk and document, added over the radixes.

Tokenizers are read, never trained; the files' places are parameters.

Defined results: a text that is null, empty, or that either tokenizer does not give back byte for byte (U+2581 in the text, for one) has no
tokens, all counts 0 and an empty `groups_sha256`; repeated rows and rows without an id each count by themselves; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import written
from proofmill.llm.remembered import Remembered, ragged
from proofmill.llm.sentencepiece import chunks

RADIXES = 16
CHUNK_BYTES = 2_000_000
#: Compressed bytes of runs that one merging task takes.
TASK_BYTES = 16_000_000
#: Pairs of a run that are merged together.
BLOCK_PAIRS = 8192
MEMORY_WORDS = 250_000
A_BITS = 20
MARK = "▁"
#: ASCII white space ends a word; other white space, and characters that pieces of B join to what comes before, make a text be encoded whole.
UNIT = re.compile("[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level tokenizers: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, and what they make of words."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes_a[i] = bytes([letters[c] for c in piece]) if all(c in letters for c in piece) else piece.encode()
        model = proto.ModelProto()
        with open(path_b, "rb") as f:
            model.ParseFromString(f.read())
        model.normalizer_spec.add_dummy_prefix = False  # texts come with their space
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        byte = model.SentencePiece.BYTE
        self.bytes_b = [bytes([int(p.piece[3:5], 16)]) if p.type == byte else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        joined = {c for p in model.pieces for c in p.piece.lstrip(MARK)[1:] if p.type != byte} | {c for p in model.pieces if p.piece.startswith(MARK) for c in p.piece.lstrip(MARK)}
        odd = "".join(c for c in "\t\n\x0b\x0c\r" if c in joined)
        if MARK in joined:
            raise ValueError("only models whose pieces do not span words are read")
        self.whole = re.compile(f"{OTHER_SPACE.pattern[:-1]}{re.escape(odd)}]")
        self.length_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        self.names_a, self.names_b = [str(i) for i in range(len(self.bytes_a))], [str(i) for i in range(len(self.bytes_b))]

    def units(self, text: str | None) -> list[str]:
        """The words of space + text; a text without words has none."""
        if not text:
            return []
        text = " " + text
        return [text] if self.whole.search(text) else UNIT.findall(text)

    def __call__(self, units: list[str]) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
        """The units, and for them: pair numbers of its links; numbers of A tokens, B tokens, groups, and 1 if both give it back; its groups as text."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        ids_b = self.b.encode(units, num_threads=1)
        good = [b"".join([self.bytes_a[i] for i in a]) == x and b"".join([self.bytes_b[i] for i in b]) == x for x, a, b in zip((u.encode("utf-8", "replace") for u in units), ids_a, ids_b)]
        ids_a, ids_b = [a if g else [] for g, a in zip(good, ids_a)], [b if g else [] for g, b in zip(good, ids_b)]
        n_a, flat_a = ragged(ids_a)
        n_b, flat_b = ragged(ids_b)
        ends_a, ends_b = np.cumsum(self.length_a[flat_a]), np.cumsum(self.length_b[flat_b])
        ends = np.union1d(ends_a, ends_b)  # every stretch between neighbouring ends lies in one token of each side: one link
        of_a, of_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        unit_a = np.repeat(np.arange(len(units)), n_a)
        links = np.bincount(unit_a[of_a], minlength=len(units))
        common = np.isin(ends_a, ends_b, assume_unique=True)
        groups = np.bincount(unit_a[common], minlength=len(units))
        cuts_a = np.flatnonzero(common) + 1
        cuts_b = np.searchsorted(ends_b, ends_a[common]) + 1
        names_a, names_b = [self.names_a[i] for i in flat_a], [self.names_b[i] for i in flat_b]
        texts, a, b = [], 0, 0
        for x, y in zip(cuts_a.tolist(), cuts_b.tolist()):
            texts.append(f"{','.join(names_a[a:x])}|{','.join(names_b[b:y])}")
            a, b = x, y
        at = np.concatenate([[0], np.cumsum(groups)]).tolist()
        told = [";".join(texts[x:y]).encode() for x, y in zip(at, at[1:])]
        facts = np.stack([n_a, n_b, groups, np.array(good, dtype=np.int64)], axis=1)
        return units, [(links, flat_b[of_b] << A_BITS | flat_a[of_a]), (np.full(len(units), 4), facts.reshape(-1)),
                (np.fromiter(map(len, told), dtype=np.int64, count=len(told)), np.frombuffer(b"".join(told), dtype=np.uint8))]


class Memory(Remembered):
    """Words' links (int64), four facts, and their groups as text (bytes)."""

    def __init__(self, path_a: str, path_b: str, most: int):
        self.pair = Pair(path_a, path_b)
        super().__init__(self.pair, 3, most)
        self.values[2] = self.values[2].astype(np.uint8)


@cache
def memory_of(path_a: str, path_b: str, most: int) -> Memory:
    """A worker keeps it for its next tasks."""
    return Memory(path_a, path_b, most)


def packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpacked(blob: bytes, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, documents, times) of a run; pairs are stored as differences."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return (np.cumsum(np.frombuffer(raw, dtype="<i8", count=rows)), np.frombuffer(raw, dtype="<u4", count=rows, offset=8 * rows), np.frombuffer(raw, dtype="<u4", count=rows, offset=12 * rows))


ALIGNED = ("id bigint, chunk bigint, document int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
           "radix int, first bigint, records bigint, run binary")


def aligned(docs: DataFrame, id_col: str, text_col: str, paths: tuple[str, str], radixes: int, memory_words: int) -> DataFrame:
    """Two kinds of rows: documents (radix is null), and runs (document is null).  One pass, no shuffle."""

    def run(batches):
        memory, task, numbers = memory_of(*paths, memory_words), TaskContext.get().partitionId() << 32, count()
        for part in chunks(batches, "the_text", CHUNK_BYTES):
            texts = part.column("the_text").to_pylist()
            if not texts:
                continue
            chunk = task + next(numbers)
            cut = [memory.pair.units(t) for t in texts]
            at, ends = memory.at(list(chain.from_iterable(cut))), np.cumsum([0, *map(len, cut)])
            n = len(texts)
            of = np.repeat(np.arange(n), np.diff(ends))
            facts = memory.values[1].reshape(-1, 4)[at]
            ok = np.bincount(of, weights=facts[:, 3], minlength=n) == np.diff(ends)
            at, of, facts = at[ok[of]], of[ok[of]], facts[ok[of]]
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])
            sums = [np.bincount(of, weights=facts[:, i], minlength=n).astype(np.int64) for i in range(3)]
            pairs, pair_ends = memory.gather(0, at)
            links = np.diff(pair_ends[ends])
            starts, lengths, chars = memory.starts[2][at].tolist(), memory.lengths(2, at).tolist(), memory.values[2].data
            shas = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                shas.append(hashlib.sha256(b";".join([chars[s : s + k] for s, k in zip(starts[a:b], lengths[a:b])])).hexdigest() if b > a else "")
            none = lambda kind, m=n: pa.nulls(m, kind)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.full(n, chunk)), pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, sums), pa.array(links), pa.array(shas, pa.string()),
                                              none(pa.int32()), none(pa.int64()), none(pa.int64()), none(pa.binary())], names=NAMES)
            rows = runs_of(pairs, np.repeat(np.arange(n), links), radixes)
            if rows:
                m, (radix, first, records, blob) = len(rows), zip(*rows)
                yield pa.RecordBatch.from_arrays([none(pa.int64(), m), pa.array(np.full(m, chunk)), none(pa.int32(), m), *(none(pa.int64(), m) for _ in range(4)), none(pa.string(), m),
                                                  pa.array(radix, pa.int32()), pa.array(first, pa.int64()), pa.array(records, pa.int64()), pa.array(blob, pa.binary())], names=NAMES)

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("the_text")).mapInArrow(run, ALIGNED)


NAMES = [c.split()[0] for c in ALIGNED.split(", ")]


def runs_of(pairs: np.ndarray, documents: np.ndarray, radixes: int) -> list[tuple[int, int, int, bytes]]:
    """(radix, first pair, records, run) per radix: records (pair, document, times) in order."""
    if not len(pairs):
        return []
    order = np.argsort(documents, kind="stable") if np.any(documents[1:] < documents[:-1]) else slice(None)
    pairs, documents = pairs[order], documents[order]
    by_pair = np.argsort(pairs, kind="stable")
    pairs, documents = pairs[by_pair], documents[by_pair]
    new = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (documents[1:] != documents[:-1])]))
    times = np.diff(np.concatenate([new, [len(pairs)]]))
    pairs, documents = pairs[new], documents[new]
    radix = (pairs >> A_BITS) % radixes
    out = []
    for r in range(radixes):
        mine = np.flatnonzero(radix == r)
        if len(mine):
            p = pairs[mine]
            out.append((r, int(p[0]), len(mine), packed(np.diff(p, prepend=0).astype("<i8"), documents[mine].astype("<u4"), times[mine].astype("<u4"))))
    return out


def summed_by_pair(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal neighbours put together."""
    if not len(pairs):
        return pairs, times
    heads = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    return pairs[heads], np.add.reduceat(times, heads)


def merged(runs: list[tuple[int, int, bytes]]):
    """(pairs, times) blocks in order, each pair once, from runs given as (first pair, records, blob).

    A heap holds each run's next pair.  A run is unpacked when its turn comes, and what lies below all next pairs is complete.
    """
    heap = [(first, i, 0) for i, (first, _, _) in enumerate(runs)]
    heapq.heapify(heap)
    opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    held_pairs, held_times, held = [], [], 0

    def complete(limit):
        nonlocal held_pairs, held_times, held
        pairs, times = np.concatenate(held_pairs), np.concatenate(held_times)
        order = np.argsort(pairs, kind="stable")
        pairs, times = summed_by_pair(pairs[order], times[order])
        cut = len(pairs) if limit is None else int(np.searchsorted(pairs, limit))
        held_pairs, held_times, held = [pairs[cut:]], [times[cut:]], len(pairs) - cut
        return pairs[:cut], times[:cut]

    most = BLOCK_PAIRS * 4
    while heap:
        _, i, at = heapq.heappop(heap)
        if at == 0:
            pairs, _, times = unpacked(runs[i][2], runs[i][1])
            opened[i] = summed_by_pair(pairs, times.astype(np.int64))
        pairs, times = opened[i]
        held_pairs.append(pairs[at : at + BLOCK_PAIRS])
        held_times.append(times[at : at + BLOCK_PAIRS])
        held += len(held_pairs[-1])
        if at + BLOCK_PAIRS < len(pairs):
            heapq.heappush(heap, (int(pairs[at + BLOCK_PAIRS]), i, at + BLOCK_PAIRS))
        else:
            del opened[i]
        if held > most and heap:
            yield complete(heap[0][0])
            most = max(BLOCK_PAIRS * 4, 2 * held)
    if held:
        yield complete(None)


def counted(table: pa.Table) -> pa.Table:
    """Pair counts of one task's runs."""
    runs = list(zip(table["first"].to_pylist(), table["records"].to_pylist(), table["run"].to_pylist()))
    blocks = list(merged(runs))
    pairs, times = (np.concatenate([b[i] for b in blocks]) if blocks else np.zeros(0, dtype=np.int64) for i in range(2))
    return pa.table({"pair": pairs, "times": times})


def contributed(runs: pa.Table, counts: pa.Table) -> pa.Table:
    """What the records of each run give to its chunk's documents: links that are their B id's best, and counts."""
    pairs, times, best = counts["pair"].to_numpy(), counts["times"].to_numpy(), counts["best"].to_numpy(zero_copy_only=False)
    order = np.argsort(pairs)
    pairs, times, best = pairs[order], times[order], best[order].astype(np.int64)
    rows = []
    for chunk, n, blob in zip(runs["chunk"].to_pylist(), runs["records"].to_pylist(), runs["run"].to_pylist()):
        pair, document, links = unpacked(blob, n)
        at = np.searchsorted(pairs, pair)
        size = int(document.max()) + 1
        totals, bests = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        np.add.at(totals, document, times[at] * links)
        np.add.at(bests, document, best[at] * links)
        rows.append((chunk, bests.tolist(), totals.tolist()))
    return pa.Table.from_pylist([{"chunk": c, "bests": b, "totals": t} for c, b, t in rows], schema=pa.schema([("chunk", pa.int64()), ("bests", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64()))]))


def returned(documents: pa.Table, given: pa.Table) -> pa.Table:
    """Documents of one chunk with the sums of what the radixes gave back."""
    place = documents["document"].to_numpy()
    size = int(place.max(initial=-1)) + 1
    sums = np.zeros((2, size), dtype=np.int64)
    for i, name in enumerate(("bests", "totals")):
        for values in given[name]:
            values = values.values.to_numpy()
            sums[i, : len(values)] += values
    return documents.append_column("n_best", pa.array(sums[0][place])).append_column("count_sum", pa.array(sums[1][place]))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] | None = None, radixes: int = RADIXES,
          task_bytes: int = TASK_BYTES, memory_words: int = MEMORY_WORDS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    both = written(aligned(docs, id_col, text_col, tokenizers or default_tokenizers(), radixes, memory_words), "alignment")
    documents = both.where("document is not null").select("id", "chunk", "document", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    runs = both.where("radix is not null").select("chunk", "radix", "first", "records", "run")
    total = runs.agg(F.sum(F.length("run"))).first()[0] or 0
    splits = max(1, -(-total // (radixes * task_bytes)))
    runs = runs.withColumn("split", F.pmod(F.xxhash64("chunk"), F.lit(splits)))
    counts = runs.select("radix", "split", "first", "records", "run").groupBy("radix", "split").applyInArrow(counted, "pair bigint, times bigint")
    counts = counts.groupBy("pair").agg(F.sum("times").alias("times"))
    b = F.shiftright("pair", A_BITS)
    counts = written(counts.withColumn("b", b), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("times").alias("highest"))
    counts = counts.join(highest, "b").select(F.pmod("b", F.lit(radixes)).cast("int").alias("radix"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(splits - 1).cast("bigint"))).alias("split"), "pair", "times",
                                              (F.col("times") == F.col("highest")).alias("best"))
    given = runs.select("radix", "split", "chunk", "records", "run").groupBy("radix", "split").cogroup(counts.groupBy("radix", "split")).applyInArrow(contributed, "chunk bigint, bests array<bigint>, totals array<bigint>")
    out = documents.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(returned, "id bigint, chunk bigint, document int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint")
    return out.select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
