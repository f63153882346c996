"""Conversation prefix trie by double arrays.

Conversations become sequences of turns; every distinct sequence of first turns is a node.  Equal conversations are one sequence with a
count, so a conversation that very many rows copy costs one row.

1. Turns are put in order by one range sort with running counts, so a conversation may be of any length.
2. Sequences are cut into segments of `segment_turns`; a segment hangs below the node that ends the segments before it.
3. Segments are dealt to shards by their prefix (the first turn, or the node they hang below); shards above `shard_turns` are split.
4. In each shard the distinct turns get dense ids, and the sequences are packed into the arrays BASE and CHECK: the child of node s by
   turn t is slot BASE[s] + t, and CHECK of that slot is s.  The traversal gives every node's aggregates.
5. Nodes that several shards share (those above a cut or a split) are merged by their fingerprints.  All aggregates are made such that
   they add up: a first traversal finds each node's smallest conversation; that sequence owns the node, and as owners of deeper nodes
   on its path stay the same, a sequence owns its path from one depth on.  A second traversal adds up what sequences own.

Fingerprints are 128-bit: the exclusive or of a hash of each turn at its place.

Digests of conversation ids: ids are put together in order in blocks of ID_BLOCK neighbouring values, and each node's blocks then run
through SHA-256 one after another, so one task holds a few blocks at a time, however many conversations end at a node.

Defined results: a null role or text is empty; rows without a conv_id belong to no conversation; a null turn comes first, equal turns are
in order of role and text; repeated rows are turns of their own; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofmill.llm.common import WORD, written

SEGMENT_TURNS = 1024
SHARD_TURNS = 50_000
ID_BLOCK = 4096
#: Free slots tried for a node with several children before they go behind the last used slot.
TRIES = 2048
SHARED_EVERY, SHARED_TURNS = 20, 4
NO_IDS = hashlib.sha256(b"").hexdigest()
NONE = np.iinfo(np.int64).max


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, k1, k2, words): every turn with its place in its conversation, from 0."""
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    key = ["conv_id", "turn", "role", "text", "row"]
    rows = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    rows = rows.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), F.xxhash64("role", "text").alias("k1"),
                       F.xxhash64(F.lit(1), "role", "text").alias("k2"), F.regexp_count("text", F.lit(WORD.pattern)).cast("bigint").alias("words"))
    return written(rows, "turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, pos, k1, k2, words, f1, f2), and (conv_id, n) of all conversations, those without turns included."""
    rows = ordered_turns(turns)
    runs = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), "n")
    sizes = runs.groupBy("conv_id").agg(F.sum("n").alias("own"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS).alias("shared")
    convs = sizes.select("conv_id", "own", shared, (F.col("conv_id") - F.col("conv_id") % SHARED_EVERY).alias("base"))
    lengths = sizes.where(F.col("conv_id") % SHARED_EVERY == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = convs.join(lengths, "base", "left").withColumn("taken", F.least("shared", F.coalesce("base_own", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "shared", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("shared"), F.lit(0))).alias("n")), "conversations")
    placed = rows.join(runs.join(convs.drop("n", "base"), "conv_id").drop("n"), ["conv_id", "part"]).withColumn("pos", F.col("at") + F.col("shift"))
    own = placed.where("pos >= shared").select("conv_id", (F.col("pos") - F.col("shared") + F.col("taken")).alias("pos"), "k1", "k2", "words")
    heads = placed.where((F.col("conv_id") % SHARED_EVERY == 0) & (F.col("pos") < SHARED_TURNS)).select(F.col("conv_id").alias("base"), "pos", "k1", "k2", "words")
    lent = convs.where("taken > 0").select("conv_id", "base", "taken").join(heads, "base").where("pos < taken").select("conv_id", "pos", "k1", "k2", "words")
    out = own.unionByName(lent)
    return out.withColumn("f1", F.xxhash64("k1", "k2", "pos")).withColumn("f2", F.xxhash64(F.lit(2), "k1", "k2", "pos")), convs.select("conv_id", "n")


def digests(ended: DataFrame) -> DataFrame:
    """(e1, e2, n, ends_sha256) for the conversations (conv_id, e1, e2, n) that end at each node."""
    node = ["e1", "e2", "n"]
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    blocks = ended.groupBy(*node, F.floor(F.col("conv_id") / ID_BLOCK).alias("block")).agg(ids.alias("ids"))

    def run(batches):
        now, sha = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*node, "ids"))):
                if key != now:
                    if now is not None:
                        done.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if done:
                yield as_batch(done)
        if now is not None:
            yield as_batch([(*now, sha.hexdigest())])

    def as_batch(rows):
        *keys, shas = zip(*rows)
        return pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), pa.array(shas, pa.string())], names=[*node, "ends_sha256"])

    return blocks.repartition(*node).sortWithinPartitions(*node, "block").mapInArrow(run, "e1 bigint, e2 bigint, n bigint, ends_sha256 string")


class DoubleArray:
    """BASE and CHECK over the sequences of one shard, built level by level."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        """codes: dense turn ids of all sequences one after another; starts: where each begins (and the last ends)."""
        self.base, self.check = np.zeros(1024, dtype=np.int64), np.full(1024, -1, dtype=np.int64)
        self.check[0] = 0  # the root
        self.end, self.holes = 1, np.zeros(0, dtype=np.int64)
        self.levels = []  # slots by depth
        lengths = np.diff(starts)
        width = int(codes.max(initial=0)) + 1
        here = np.zeros(len(lengths), dtype=np.int64)
        for depth in range(int(lengths.max(initial=0))):
            alive = np.flatnonzero(lengths > depth)
            code = codes[starts[alive] + depth]
            edges, of = np.unique(here[alive] * width + code, return_inverse=True)
            slots = self.place(edges // width, edges % width)
            here[alive] = slots[of]
            self.levels.append(slots)

    def place(self, parents: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Slots for the children of one level (sorted by parent and code); a parent's children share its BASE."""
        slots = np.empty(len(parents), dtype=np.int64)
        heads = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        sizes = np.diff(np.concatenate([heads, [len(parents)]]))
        for a, n in zip(heads[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            steps = code[a : a + n] - code[a]
            tried = self.holes[:TRIES]
            for step in steps[1:].tolist():
                tried = tried[self.free(tried + step)]
            slots[a : a + n] = self.take((tried[0] if len(tried) else self.end) + steps)
        single = heads[sizes == 1]
        slots[single] = self.take(np.concatenate([self.holes[: len(single)], self.end + np.arange(max(0, len(single) - len(self.holes)))]))
        self.base[parents[heads]] = slots[heads] - code[heads]
        self.check[slots] = parents
        return slots

    def free(self, slots: np.ndarray) -> np.ndarray:
        return (slots >= self.end) | (self.check[np.minimum(slots, len(self.check) - 1)] < 0)

    def take(self, slots: np.ndarray) -> np.ndarray:
        last = int(slots.max(initial=0))
        if last >= self.end:
            if last >= len(self.check):
                more = max(last + 1, 2 * len(self.check)) - len(self.check)
                self.base, self.check = np.concatenate([self.base, np.zeros(more, dtype=np.int64)]), np.concatenate([self.check, np.full(more, -1, dtype=np.int64)])
            self.holes = np.concatenate([self.holes, np.arange(self.end, last + 1)])
            self.end = last + 1
        at = np.searchsorted(self.holes, slots)
        self.holes = np.delete(self.holes, at)  # all slots taken were holes; holes are in order
        self.check[slots] = 0  # taken; `place` enters the parent
        return slots

    def child(self, slot, code):
        """The slot reached from slot by a turn, -1 where there is none."""
        at = self.base[slot] + code
        inside = (at > 0) & (at < self.end)
        return np.where(inside & (self.check[np.where(inside, at, 0)] == slot), at, -1)


class Shard:
    """One shard's segments packed into a double array, with the nodes' columns by slot.

    Every sequence starts with the number of the node it hangs below, so the array's level 0 holds these nodes.
    """

    def __init__(self, table: pa.Table):
        column = lambda name: table[name].to_numpy().astype(np.int64)
        self.start, self.rep, self.copies, self.n = column("pos"), column("rep"), column("copies"), column("n")
        lists = table["path"].combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        turns = lists.flatten()
        k1, k2, f1, f2, self.words = (turns.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
        self.ends = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
        _, codes = np.unique(np.rec.fromarrays([k1, k2]), return_inverse=True)
        roots, root = np.unique(np.rec.fromarrays([self.start, column("s1"), column("s2")]), return_inverse=True)
        lengths = np.diff(self.ends)
        starts = self.ends + np.arange(len(self.ends))
        full = np.empty(starts[-1], dtype=np.int64)
        full[starts[:-1]] = root.reshape(-1)
        full[np.arange(len(codes)) + np.repeat(np.arange(1, len(lengths) + 1), lengths)] = codes.reshape(-1)
        self.trie = trie = DoubleArray(full, starts)
        size = trie.end
        self.f1, self.f2, self.depth, self.word = (np.zeros(size, dtype=np.int64) for _ in range(4))
        self.members, self.least, self.longest = np.zeros(size, dtype=np.int64), np.full(size, NONE), np.zeros(size, dtype=np.int64)
        here = trie.child(np.zeros(len(lengths), dtype=np.int64), full[starts[:-1]])
        self.depth[here], self.f1[here], self.f2[here] = self.start, column("s1"), column("s2")
        self.roots = trie.levels[0] if trie.levels else np.zeros(0, dtype=np.int64)
        self.count(here, np.arange(len(lengths)))
        self.paths = [(np.arange(len(lengths)), here)]
        for step in range(int(lengths.max(initial=0))):
            alive = np.flatnonzero(lengths > step)
            at = self.ends[alive] + step
            up, below = here[alive], trie.child(here[alive], full[starts[alive] + 1 + step])
            self.depth[below], self.word[below] = self.depth[up] + 1, self.words[at]
            self.f1[below], self.f2[below] = self.f1[up] ^ f1[at], self.f2[up] ^ f2[at]
            here[alive] = below
            self.count(below, alive)
            self.paths.append((alive, below))
        self.last = here

    def count(self, slots: np.ndarray, rows: np.ndarray) -> None:
        np.add.at(self.members, slots, self.copies[rows])
        np.minimum.at(self.least, slots, self.rep[rows])
        np.maximum.at(self.longest, slots, self.n[rows])

    def slots(self) -> np.ndarray:
        """All nodes in order of depth, but for the top of the array."""
        return np.concatenate(self.trie.levels) if self.trie.levels else np.zeros(0, dtype=np.int64)

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Sums over every node's subtree within the shard."""
        out = values.copy()
        for level in reversed(self.trie.levels[1:]):
            np.add.at(out, self.trie.check[level], out[level])
        return out


FIRST = "f1 bigint, f2 bigint, depth bigint, rep bigint, longest bigint"


def first_nodes(table: pa.Table) -> pa.Table:
    """Every node's smallest conversation and longest member."""
    s = Shard(table)
    at = s.slots()
    return pa.table({"f1": s.f1[at], "f2": s.f2[at], "depth": s.depth[at], "rep": s.least[at], "longest": s.longest[at]})


SECOND = "f1 bigint, f2 bigint, depth bigint, p1 bigint, p2 bigint, rep bigint, members bigint, children bigint, leaves bigint, saved bigint"


def second_nodes(table: pa.Table) -> pa.Table:
    """Every node's aggregates that add up over shards."""
    s = Shard(table)
    column = lambda name: table[name].to_numpy().astype(np.int64)
    since, leaf, tail = column("since"), column("leaf"), column("copies") * column("words_after") - column("owned_after")
    owned = np.zeros(s.trie.end, dtype=np.int64)
    for rows, slots in s.paths:
        owned[slots[s.depth[slots] >= since[rows]]] = 1
    children = np.zeros(s.trie.end, dtype=np.int64)
    for level in s.trie.levels[1:]:
        np.add.at(children, s.trie.check[level], owned[level])
    leaves, saved = np.zeros(s.trie.end, dtype=np.int64), (s.members - owned) * s.word
    np.add.at(leaves, s.last, leaf)
    np.add.at(saved, s.last, tail)
    leaves, saved = s.summed(leaves), s.summed(saved)
    at = s.slots()
    top = np.zeros(s.trie.end, dtype=bool)
    top[s.roots] = True
    hung = top[at] & (s.depth[at] > 0)  # counted by the shard of the segment before, but for its children
    up = s.trie.check[at]
    none = pa.scalar(None, pa.int64())
    masked = lambda values, mask: pa.compute.if_else(pa.array(mask), none, pa.array(values))
    return pa.table({"f1": s.f1[at], "f2": s.f2[at], "depth": s.depth[at], "p1": masked(s.f1[up], top[at]), "p2": masked(s.f2[up], top[at]), "rep": masked(s.least[at], hung),
                     "members": np.where(hung, 0, s.members[at]), "children": children[at], "leaves": np.where(hung, 0, leaves[at]), "saved": np.where(hung, 0, saved[at])})


def prefix_trie(turns: DataFrame, segment_turns: int = SEGMENT_TURNS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node."""
    rows, convs = rebuilt(turns)
    xor = [F.bit_xor("f1").alias("x1"), F.bit_xor("f2").alias("x2")]
    path = F.transform(F.array_sort(F.collect_list(F.struct("pos", "k1", "k2", "f1", "f2", "words"))), lambda t: F.struct(t["k1"], t["k2"], t["f1"], t["f2"], t["words"]))
    segments = rows.groupBy("conv_id", F.floor(F.col("pos") / segment_turns).alias("segment")).agg(path.alias("path"), *xor, F.sum("words").alias("words"))
    segments = written(segments, "segments")
    ends = segments.groupBy("conv_id").agg(F.bit_xor("x1").alias("e1"), F.bit_xor("x2").alias("e2"))
    ended = written(convs.join(ends, "conv_id", "left").select("conv_id", "n", F.coalesce("e1", F.lit(0)).alias("e1"), F.coalesce("e2", F.lit(0)).alias("e2")), "ends")
    sequences = ended.groupBy("e1", "e2", "n").agg(F.min("conv_id").alias("rep"), F.count("*").alias("copies"))

    order = Window.partitionBy("rep").orderBy("segment")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    held = segments.withColumnRenamed("conv_id", "rep").join(sequences.select("rep", "copies", "n"), "rep")
    held = held.select("rep", "segment", "path", "copies", "n", "words", *(F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0)).alias(f"s{i}") for i in (1, 2)),
                       F.coalesce(F.sum("words").over(after), F.lit(0)).alias("words_after"), (F.col("segment") * segment_turns).alias("pos"))
    prefix = F.when(F.col("segment") == 0, F.xxhash64(F.get("path", F.lit(0))["k1"], F.get("path", F.lit(0))["k2"])).otherwise(F.xxhash64("s1", "s2", "segment"))
    held = written(held.withColumn("prefix", prefix), "prefixes")
    total = held.agg(F.sum(F.size("path"))).first()[0] or 0
    held = held.withColumn("shard", F.pmod("prefix", F.lit(-(-total // shard_turns) or 1)))
    parts = held.groupBy("shard").agg(F.ceil(F.sum(F.size("path")) / (2 * shard_turns)).alias("parts"))
    held = held.join(parts, "shard").withColumn("split", F.pmod(F.xxhash64("rep", "segment"), F.col("parts"))).drop("parts", "prefix")

    node = ["f1", "f2", "depth"]
    turnless = sequences.where("n = 0")
    firsts = held.select("shard", "split", "pos", "rep", "copies", "n", "path", "s1", "s2").groupBy("shard", "split").applyInArrow(first_nodes, FIRST)
    firsts = firsts.unionByName(turnless.select(F.lit(0).cast("bigint").alias("f1"), F.lit(0).cast("bigint").alias("f2"), F.lit(0).cast("bigint").alias("depth"), "rep", F.lit(0).cast("bigint").alias("longest")))
    firsts = firsts.groupBy(*node).agg(F.min("rep").alias("rep"), F.max("longest").alias("longest"))
    owners = written(firsts.groupBy("rep").agg(F.min("depth").alias("since"), F.max((F.col("depth") == F.col("longest")).cast("bigint")).alias("leaf")), "owners")

    never = F.lit(int(NONE)).cast("bigint")
    first = F.greatest(F.col("since") - F.col("pos"), F.lit(1))  # the first owned turn of the segment, from 1
    owned = F.when(first > F.size("path"), F.lit(0)).when(first == 1, F.col("words")).otherwise(
        F.aggregate(F.slice("path", F.least(first, F.size("path")).cast("int"), F.size("path")), F.lit(0).cast("bigint"), lambda s, t: s + t["words"]))
    told = held.join(owners, "rep", "left").withColumn("since", F.coalesce("since", never)).withColumn("leaf", F.coalesce("leaf", F.lit(0)))
    told = told.withColumn("owned", owned).withColumn("owned_after", F.coalesce(F.sum("owned").over(after), F.lit(0))).drop("owned", "words", "segment")
    seconds = told.groupBy("shard", "split").applyInArrow(second_nodes, SECOND)
    root = turnless.join(owners, "rep", "left").selectExpr("0L f1", "0L f2", "0L depth", "cast(null as bigint) p1", "cast(null as bigint) p2", "rep", "copies members", "0L children",
                                                           "coalesce(if(since = 0, leaf, 0), 0) leaves", "0L saved")
    nodes = seconds.unionByName(root).groupBy(*node).agg(F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("rep").alias("conv_id"), F.sum("members").alias("n_convs"),
                                                         F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    nodes = written(nodes, "nodes")
    parents = nodes.where("n_children > 0").select(F.col("f1").alias("p1"), F.col("f2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    ids = digests(ended).select(F.col("e1").alias("f1"), F.col("e2").alias("f2"), F.col("n").alias("depth"), "ends_sha256")
    out = nodes.join(parents, ["p1", "p2", "depth"], "left").join(ids, node, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))
