"""Best-fit packing with bounds that certify it.

1. Texts become token ids with a 0 at their end; what exceeds a sequence is cut into pieces of a whole sequence (the last may be shorter).
   Whole pieces are sequences of their own.
2. The other pieces are dealt evenly to partitions of about `partition_rows`, each packed by best-fit decreasing.
3. Dual feasible functions give a lower bound of each partition's number of sequences.  A partition that meets its bound (before rounding
   up, so that no company could help it either) is certified and stays.
4. A partition with a gap exchanges documents with its neighbour: the pieces of both ones' unfilled sequences are packed anew by best-fit
   decreasing, and the better of old and new stays.  The neighbours of the next turn are these pairs, so after log2(partitions) turns
   the unfilled rest of the whole table has met.  What takes part is at most half of `partition_rows` a partition, emptiest sequences
   first, so every task is bounded; the others' pieces stay where they are.  No row is dropped.

`certificate` compares the number of sequences with the bound of the whole table.

The tokenizer is read, never trained.  Nothing in the pre-tokenizer reaches across white space, and it cuts plain words at the ends of
letters and at digits.  These parts are tokenized once while a worker remembers them; the ids of words and texts are put together from theirs.

Defined results: a null text counts as empty and is the one id 0; repeated rows, rows with equal ids and rows without an id are each packed
by themselves; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import written
from proofmill.llm.remembered import Remembered, ragged
from proofmill.llm.sentencepiece import chunks

CAPACITY = 2048
PARTITION_ROWS = 20_000
CHUNK_BYTES = 4_000_000
#: Parts that are tokenized as one line.
LINE_PARTS = 500
#: Plain words (ASCII and Latin-1 letters; no apostrophe: contractions; no "<|": special strings), and what ends a run of letters in them.
PLAIN = r"^[\x21-\x26\x28-\x7e\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+$"
NO_LETTERS = r"([^A-Za-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+|[0-9])"
#: The steps before the model that cut plain words into runs of letters, digits and runs of other characters, in lower case.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Largest k of the rounding functions u(k).
LARGEST_K = 100


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Tokens:
    """Ids of parts of words.

    Where the tokenizer is known to cut plain words into lower-case parts, these are given to its model alone, many in a line, and the marks
    of word ends tell them apart.  All else is tokenized as whole words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        mark = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.cuts = bool(mark) and made["normalizer"] == NORMALIZER and made["pre_tokenizer"] == PRE_TOKENIZER
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        if self.cuts:
            for piece, i in self.tokenizer.get_vocab().items():
                self.ends[i] = piece.endswith(mark)
            self.lines = Tokenizer.from_file(path)
            self.lines.normalizer = normalizers.Sequence([])
            self.lines.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def parts(self, words: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """(the parts of all words one after another, where each word's parts end, from 0); a word that is not plain is one part."""
        if not self.cuts:
            return words.dictionary_encode(), np.arange(len(words) + 1)
        plain = pc.and_not(pc.match_substring_regex(words, PLAIN), pc.match_substring(words, "<|"))
        apart = pc.utf8_lower(pc.replace_substring_regex(words, NO_LETTERS, r" \1 "))
        return split(pc.if_else(plain, apart, words))

    def __call__(self, parts: list[str]) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
        order, lengths, values = [], [], []
        plain = pc.and_not(pc.match_substring_regex(pa.array(parts), PLAIN), pc.match_substring(pa.array(parts), "<|")).to_pylist() if self.cuts else [False] * len(parts)
        others = [w for w, is_plain in zip(parts, plain) if not is_plain]
        plain = [w for w, is_plain in zip(parts, plain) if is_plain]
        lines = [plain[i : i + LINE_PARTS] for i in range(0, len(plain), LINE_PARTS)]
        for line, ids in zip(lines, encoded(self.lines, [" ".join(line) for line in lines]) if lines else []):
            ids = np.array(ids, dtype=np.int64)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(line):
                order += line
                lengths.append(np.diff(ends, prepend=0))
                values.append(ids)
            else:
                others += line
        rest_lengths, rest = ragged(encoded(self.tokenizer, others))
        return [*order, *others], [(np.concatenate([*lengths, rest_lengths]), np.concatenate([*values, rest]))]


def encoded(tokenizer, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@cache
def memory_of(path: str) -> Remembered:
    """A worker keeps it for its next tasks."""
    return Remembered(Tokens(path), 1)


def split(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(what lies between white space in all texts, one after another, where that of each text ends, from 0); white space at a text's ends leaves empty strings."""
    lists = pc.ascii_split_whitespace(texts)
    return lists.flatten().dictionary_encode(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])


def binary(ends: np.ndarray, data) -> pa.LargeBinaryArray:
    """Byte strings that lie one after another in `data`; ends from 0."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, dtype=np.int64)), data])


def merged(strings: pa.LargeBinaryArray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The byte strings between two ends put together, without a copy."""
    bounds = np.frombuffer(strings.buffers()[1], dtype=np.int64, count=len(strings) + 1) if len(strings) else np.zeros(1, dtype=np.int64)
    return binary(bounds[ends], strings.buffers()[2] or pa.py_buffer(b""))


def ids_of(texts: pa.Array, memory: Remembered) -> tuple[np.ndarray, memoryview]:
    """(where the bytes of each text's ids end, from 0, the ids of all texts as unsigned little-endian 32-bit numbers)."""
    words, text_ends = split(texts.fill_null(""))
    parts, word_ends = memory.learn.parts(words.dictionary)
    values, part_ends = memory.gather(0, memory.at(parts.dictionary.to_numpy(zero_copy_only=False).tolist()))
    by_part = binary(part_ends * 4, pa.py_buffer(values.astype("<u4")))
    by_word = merged(by_part.take(parts.indices), word_ends)
    by_text = merged(by_word.take(words.indices), text_ends)
    return np.frombuffer(by_text.buffers()[1], dtype=np.int64, count=len(texts) + 1), memoryview(by_text.buffers()[2])


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32, place) per piece of every row; place is a number of its own for every piece.  One pass, no shuffle."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        memory, task, numbers, end = memory_of(path), TaskContext.get().partitionId() << 40, count(), np.array([end_id], dtype="<u4").tobytes()
        for part in chunks(batches, "the_text", CHUNK_BYTES):
            bounds, ids = ids_of(part.column("the_text"), memory)
            rows = []
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                total = (b - a) // 4 + 1
                for k, at in enumerate(range(0, total, capacity)):
                    crc = zlib.crc32(ids[a + 4 * at : min(a + 4 * (at + capacity), b)])
                    rows.append((i, k, at, min(capacity, total - at), zlib.crc32(end, crc) if at + capacity >= total else crc, task + next(numbers)))
            if not rows:
                continue
            of, *columns = zip(*rows)
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(of)), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                                             names=["id", "piece", "start", "length", "ids_crc32", "place"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("the_text"))
    return texts.mapInArrow(run, "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, place bigint")


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """The sequence of every piece, pieces being put one after another where they leave the least room."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used, out = 0, 0, []  # bit r of `rooms`: a sequence with room r exists
    for w in lengths:
        fitting = rooms >> w
        if fitting:
            room = w + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen = capacity, used
            used += 1
        if room > w:
            by_room[room - w].append(chosen)
            rooms |= 1 << (room - w)
        out.append(chosen)
    return out


def lower_bound(counts: np.ndarray, capacity: int) -> float:
    """The best bound that dual feasible functions give for pieces of these lengths (counts by length), not rounded up.

    The first family keeps middle lengths, raises those above capacity - e to a whole sequence and ignores those below e; the second, u(k),
    rounds to multiples of 1/k.  Each gives at most 1 in sum over any sequence, so no packing needs less than the sum over all pieces.
    """
    size = np.arange(capacity + 1, dtype=np.int64)
    n, total = np.cumsum(counts), np.cumsum(counts * size)
    e = np.arange(0, capacity // 2 + 1)
    below = np.where(e > 0, total[np.maximum(e - 1, 0)], 0)
    best = float(np.max((n[-1] - n[capacity - e]) + (total[capacity - e] - below) / capacity))
    for k in range(1, LARGEST_K + 1):
        value = np.where((k + 1) * size % capacity == 0, size * k, (k + 1) * size // capacity * capacity)
        best = max(best, int(counts @ value) / (k * capacity))
    return best


PACKED = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, place bigint, node bigint, bin bigint, offset bigint, settled boolean, gap double"


def repacked(capacity: int, most_rows: int, last: bool):
    """Packs the pieces of one node; with earlier sequences given (child, bin), the better packing stays."""

    def run(table: pa.Table) -> pa.Table:
        length, place = table["length"].to_numpy(), table["place"].to_numpy()
        order = np.lexsort((place, -length))
        table, length = table.take(pa.array(order)), length[order]
        bins = np.array(best_fit(length.tolist(), capacity), dtype=np.int64)
        if "bin" in table.column_names:
            _, before = np.unique(table["child"].to_numpy() << np.int64(32) | table["bin"].to_numpy(), return_inverse=True)
            if before.max() <= bins.max():
                bins = before.astype(np.int64)
        n = int(bins.max()) + 1
        filled = np.bincount(bins, weights=length, minlength=n).astype(np.int64)
        by_bin = np.argsort(bins, kind="stable")
        offset = np.empty(len(length), dtype=np.int64)
        ends = np.cumsum(length[by_bin])
        first = np.cumsum(filled) - filled
        offset[by_bin] = ends - length[by_bin] - first[bins[by_bin]]
        gap = n - lower_bound(np.bincount(length, minlength=capacity + 1), capacity)
        settled = np.ones(n, dtype=bool)
        if not last and gap > 1e-9:
            emptiest = np.argsort(filled, kind="stable")
            rows = np.cumsum(np.bincount(bins, minlength=n)[emptiest])
            settled[emptiest[(rows <= most_rows) & (filled[emptiest] < capacity)]] = False
        keep = table.select(["id", "piece", "start", "length", "ids_crc32", "place", "node"])
        return pa.Table.from_arrays([*keep.columns, pa.array(bins), pa.array(offset), pa.array(settled[bins]), pa.array(np.full(len(bins), gap))],
                                    names=[*keep.column_names, "bin", "offset", "settled", "gap"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    rows = written(pieces(docs, id_col, text_col, tokenizer, capacity), "pieces")
    whole = rows.where(F.col("length") == capacity).select("id", "piece", "start", "length", "ids_crc32", (-1 - F.col("place")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    loose = rows.where(F.col("length") < capacity)
    levels = max(0, -(-loose.count() // partition_rows) - 1).bit_length()
    node = F.pmod(F.xxhash64("place"), F.lit(1 << levels))
    done, level = [whole], 0
    todo = loose.withColumn("node", node)
    while True:
        turn = written(todo.groupBy("node").applyInArrow(repacked(capacity, partition_rows // 2, level == levels), PACKED), f"packed-{level}")
        number = F.lit(level << 57).bitwiseOR(F.shiftleft("node", 25)).bitwiseOR(F.col("bin"))
        done.append(turn.where("settled").select("id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset"))
        left = turn.where("not settled")
        if level == levels or left.isEmpty():
            break
        level += 1
        todo = left.drop("offset", "settled", "gap").withColumnRenamed("node", "child").withColumn("node", F.shiftright("child", 1))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences used, lower bound of any packing of these pieces); lengths are counted before they meet."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in packed.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    return packed.select("sequence_id").distinct().count(), int(np.ceil(lower_bound(counts, capacity) - 1e-9))
