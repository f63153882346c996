"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is WINDOW consecutive words of one document. Every word covered by a window that also starts in a document with a smaller id goes.

1. Anchors. The smallest hash among the GRAM-word grams of a window is its anchor, so equal windows have equal anchors, and a document has few
   distinct ones. Only anchors of two or more documents can belong to a recurring window.
2. Recurring passages are confirmed: the windows under such anchors are hashed whole (128 bits) and counted; those of two or more
   documents recur. Neighbouring ones that always occur together, in all their documents, form one passage. (Two windows always occur together
   when the exclusive-or of hashes over their places agrees, places of the second being moved back by one.)
3. Automata. Documents are dealt into shards of about SHARD_WORDS words. A shard's automaton (pyahocorasick) holds the passages that occur in
   its documents; words are mapped to characters first, so a match is a match of whole words. All documents of the shard that share
   anything are streamed through it, which locates every occurrence; the words of those from a smaller id go.

Documents with equal words are one class: only the smallest id is searched, the others go whole if they are as long as a window.
No step gathers more than one document's own windows or one shard.

Defined results: a null text has no words; a row without an id gives and loses nothing; rows with equal ids do not take from
each other; repeated rows each get their own result; texts below WINDOW words lose nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import computed, perhaps_among, text_or_empty, words, written
from proofmill.llm.near_dedup import WordHashes, mixed

WINDOW = 50
#: Words in the grams that anchors are taken from. Longer ones meet by chance less often; the result does not depend on it.
GRAM = 24
SHARD_WORDS = 1_000_000
#: Words of a passage that enter an automaton together, and distinct words of one automaton (characters are fewer than 1,112,064).
PIECE_WORDS = 100_000
MOST_LETTERS = 1_000_000
SECOND = np.uint64(0xD6E8FEB86659FD93)
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def split(text: str | None) -> list[bytes]:
    """Words as bytes: bytes are split at exactly the ASCII white space."""
    return text_or_empty(text).encode("utf-8", "surrogatepass").split()


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word grams from the hashes of the words, by doubling."""
    out, done, power, width = None, 0, h, 1
    while True:
        if n & width:
            out = power if out is None else mixed(out[: len(h) - (done + width) + 1] * FACTOR + power[done : len(h) - width + 1])
            done += width
        width *= 2
        if width > n:
            return out
        half = width // 2
        power = mixed(power[: len(h) - width + 1] * FACTOR + power[half:] + np.uint64(width))


def window_anchors(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The anchor of each window: the smallest hash of its grams."""
    low, n, width = grams(h, gram), window - gram + 1, 1
    least = low
    while 2 * width <= n:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = n - width
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def hashes_of(ws: list[bytes], memory: WordHashes) -> np.ndarray:
    return np.fromiter(map(memory.__getitem__, ws), dtype=np.uint64, count=len(ws))


def digest(ws: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(ws))


def described(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, digest, n_words, sha256, anchors) of every row."""

    def describe():
        memory = WordHashes()

        def of(text):
            ws = split(text)
            anchors = np.zeros(0, dtype=np.uint64)
            if len(ws) >= window:
                a = window_anchors(hashes_of(ws, memory), window, gram)
                anchors = np.unique(a[np.concatenate([[True], a[1:] != a[:-1]])])
            whole = b" ".join(ws)
            return xxhash.xxh3_128_digest(whole), len(ws), hashlib.sha256(whole).hexdigest(), anchors.view(np.int64).tolist()

        return lambda texts: [of(t) for t in texts]

    return computed(docs, "text", "described", "struct<digest:binary,n_words:bigint,sha256:string,anchors:array<bigint>>", describe).select("id", "described.*")


def candidate_windows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(h1, h2, id, place) of the windows whose anchors are among the row's `recurring` ones."""

    def run(batches):
        memory = WordHashes()
        for batch in batches:
            parts = []
            for row_id, text, own, recurring in zip(batch["id"], batch["text"], batch["digest"], batch["recurring"]):
                ws = split(text)
                if len(ws) < window or digest(ws) != own:
                    continue
                h = hashes_of(ws, memory)
                at = np.flatnonzero(np.isin(window_anchors(h, window, gram), np.asarray(recurring, dtype=np.int64).view(np.uint64)))
                parts.append(pd.DataFrame({"h1": grams(h, window)[at].view(np.int64), "h2": grams(mixed(h ^ SECOND), window)[at].view(np.int64), "id": row_id, "place": at}))
            if parts:
                yield pd.concat(parts)

    return docs.mapInPandas(run, "h1 bigint, h2 bigint, id bigint, place bigint")


def passages_of(windows: DataFrame) -> DataFrame:
    """(first, start, n, h1, h2): runs of recurring windows of the document that has them first, which occur together everywhere; h1, h2 are of the first window."""
    from pyspark.sql import Window

    order = Window.partitionBy("first").orderBy("place")
    follows = (F.col("place") == F.lag("place").over(order) + 1) & (F.col("places") == F.lag("places").over(order)) & (F.col("before") == F.lag("here").over(order))
    runs = windows.withColumn("breaks", F.when(follows, 0).otherwise(1)).withColumn("run", F.sum("breaks").over(order))
    return runs.groupBy("first", "run").agg(F.min("place").alias("start"), F.count("*").alias("n"), F.min_by(F.struct("h1", "h2"), "place").alias("h")).select("first", "start", "n", "h.h1", "h.h2")


def passage_texts(docs: DataFrame, passages: DataFrame, window: int) -> DataFrame:
    """passages with their words (joined by one space), cut out of the documents that have them first."""
    lists = passages.groupBy("first").agg(F.collect_list(F.struct("start", "n", "h1", "h2")).alias("cuts"))

    def run(batches):
        memory = WordHashes()
        for batch in batches:
            rows = []
            for first, text, cuts in zip(batch["first"], batch["text"], batch["cuts"]):
                ws = split(text)
                h = hashes_of(ws, memory)
                whole = grams(h, window).view(np.int64) if len(ws) >= window else np.zeros(0, dtype=np.int64)
                for c in cuts:
                    if c["start"] + c["n"] <= len(whole) and whole[c["start"]] == c["h1"]:  # another row may share the id
                        rows.append((first, c["h1"], c["h2"], b" ".join(ws[c["start"] : c["start"] + c["n"] + window - 1]).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(rows, columns=["first", "h1", "h2", "passage"])

    return docs.join(lists, docs["id"] == lists["first"]).select("first", "text", "cuts").mapInPandas(run, "first bigint, h1 bigint, h2 bigint, passage string")


class Automaton:
    """An Aho-Corasick automaton over words: every distinct word of the passages is one character."""

    def __init__(self):
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        self.machine = ahocorasick.Automaton()

    def add(self, first: int, ws: list[bytes]) -> None:
        key = "".join([self.letter(w) for w in ws])
        if first < self.machine.get(key, (first + 1, 0))[0]:
            self.machine.add_word(key, (first, len(ws)))

    def letter(self, word: bytes) -> str:
        known = self.letters.get(word)
        if known is None:
            n = len(self.letters) + 1
            known = self.letters[word] = chr(n if n < 0xD800 else n + 0x800)  # surrogates are no characters
        return known

    def matches(self, ws: list[bytes]):
        get = self.letters.get
        return self.machine.iter("".join([get(w, "\0") for w in ws]))


class Automata:
    """The passages of a shard in as few automata as their letters allow.

    A long passage enters as pieces of at most PIECE_WORDS words that overlap by all but one word of a window: their windows are the
    passage's windows, so the same words are covered.
    """

    def __init__(self, passages, window: int, piece_words: int = PIECE_WORDS, most_letters: int = MOST_LETTERS):
        self.all: list[Automaton] = []
        for first, passage in passages:
            ws = split(passage)
            for at in range(0, max(1, len(ws) - window + 1), piece_words - window + 1):
                if not self.all or len(self.all[-1].letters) + piece_words > most_letters:
                    self.all.append(Automaton())
                self.all[-1].add(first, ws[at : at + piece_words])
        for automaton in self.all:
            automaton.machine.make_automaton()

    def covered(self, row_id: int, ws: list[bytes]) -> np.ndarray:
        """Which words lie in an occurrence of a passage from a smaller id."""
        edges = np.zeros(len(ws) + 1, dtype=np.int64)
        for automaton in self.all:
            for end, (first, n) in automaton.matches(ws):
                if first < row_id:
                    edges[end - n + 1] += 1
                    edges[end + 1] -= 1
        return np.cumsum(edges[:-1]) > 0


def locator(window: int):
    def locate(key, docs: pd.DataFrame, passages: pd.DataFrame) -> pd.DataFrame:
        """One shard: (id, digest, n_removed, kept_sha256, spans) of its documents."""
        automata = Automata(zip(passages["first"].tolist(), passages["passage"]), window)
        rows = []
        for row_id, text in zip(docs["id"].tolist(), docs["text"]):
            ws = split(text)
            gone = automata.covered(row_id, ws)
            kept = b" ".join([w for w, g in zip(ws, gone.tolist()) if not g])
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]
            rows.append((row_id, digest(ws), int(gone.sum()), hashlib.sha256(kept).hexdigest(), spans))
        return pd.DataFrame(rows, columns=["id", "digest", "n_removed", "kept_sha256", "spans"])

    return locate


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, spans) per row; spans are the removed word ranges, end exclusive."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = written(described(texts, window, gram), "anchors")
    classes = rows.where(F.col("id").isNotNull() & (F.col("n_words") >= window)).groupBy("digest").agg(F.min("id").alias("rep"), F.first("n_words").alias("n_words"), F.first("anchors").alias("anchors"))
    classes = written(classes, "classes")
    # A number stands for (rep, digest) until the anchors are known; classes that shared one would only have more windows looked at.
    numbered = classes.select("rep", "digest", F.xxhash64("rep", "digest").alias("class_no"), "anchors")
    anchored = numbered.select("class_no", F.explode("anchors").alias("anchor"))
    shared = anchored.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    recurring = anchored.join(shared, "anchor").groupBy("class_no").agg(F.collect_list("anchor").alias("recurring"))
    wanted = written(numbered.drop("anchors").join(recurring, "class_no").drop("class_no"), "wanted")
    several = rows.where("id is not null").groupBy(F.col("id").alias("rep"), "digest").agg((F.count("*") > 1).alias("several")).where("several")
    met = perhaps_among(texts, "id", wanted, "rep").join(wanted.join(several, ["rep", "digest"], "left"), F.col("id") == F.col("rep"))
    met = written(met.select("id", "text", "digest", "recurring", F.coalesce("several", F.lit(False)).alias("several")), "sharing")  # later steps read these texts only
    # A row given more than once counts once, or its places would cancel in the xor below.
    once = met.where("several").groupBy("id", "digest", F.array_join(words(F.col("text")), " ").alias("text")).agg(F.first("recurring").alias("recurring"))
    sharing = met.where("not several").drop("several").unionByName(once.select("id", "text", "digest", "recurring"))
    found = written(candidate_windows(sharing, window, gram), "candidates")

    place = F.struct("id", "place")
    windows = found.groupBy("h1", "h2").agg(F.min(place).alias("at"), F.max("id").alias("last"), F.count("*").alias("places"), F.bit_xor(F.xxhash64("id", "place")).alias("here"),
                                            F.bit_xor(F.xxhash64("id", F.col("place") - 1)).alias("before")).where("last > at.id")
    passages = written(passages_of(windows.select("h1", "h2", F.col("at.id").alias("first"), "at.place", "places", "here", "before")), "passages")
    total = classes.join(wanted.select("digest"), "digest", "left_semi").agg(F.sum("n_words")).first()[0] or 0
    shard = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-total // SHARD_WORDS)))).cast("int")

    starts = passages.select("h1", "h2", "first")
    there = perhaps_among(found.select("h1", "h2", "id"), "h1", starts, "h1").join(starts, ["h1", "h2"]).where("id > first").select("h1", "h2", "id").distinct()
    there = written(there.withColumn("shard", shard), "occurrences")
    dealt = passage_texts(sharing, passages, window).join(there.select("h1", "h2", "shard").distinct(), ["h1", "h2"])
    reps = sharing.select("id", "text").join(there.select("id").distinct(), "id", "left_semi").withColumn("shard", shard)
    located = reps.groupBy("shard").cogroup(dealt.select("shard", "first", "passage").groupBy("shard")).applyInPandas(locator(window), "id bigint, digest binary, n_removed bigint, kept_sha256 string, spans array<struct<start:int,end:int>>")
    located = written(located.distinct(), "located")

    named = rows.drop("anchors").join(classes.select("digest", "rep"), "digest", "left").join(located, ["id", "digest"], "left")
    copy = F.coalesce(F.col("id") > F.col("rep"), F.lit(False))
    everything = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    return named.select(
        "id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        F.when(copy, everything).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))).alias("spans"))
