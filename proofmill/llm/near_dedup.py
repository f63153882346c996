"""Near-duplicate classes by a signature-coordinate inverted join.

1. Every document becomes the set of its word shingles (64-bit hashes), a digest of that set, and a MinHash signature: MINIMA minima, the
   first COORDINATES of which make coordinates of WIDTH neighbouring minima each. Documents with equal sets are one class; only its
   representative (smallest id) goes on.
2. Inverted lists: a representative is posted under each coordinate-value pair. Pairs held by one representative only have no partner and fall away.
3. Prefix merging: two documents at the threshold agree in at least `matches_needed` coordinates, so with a document's m shared pairs in
   order of rarity, one of its m - matches_needed + 1 rarest is common to both. Only these are merged; documents with fewer shared
   pairs are skipped, and so are the long lists behind the prefixes.
4. Collisions of a merged pair are counted over all MINIMA, one bit each, inside the merge itself; so are the parities of the sets (below).
   Pairs that differ in at most `flips_allowed` bits are confirmed on the full shingle sets.
   Parities: each shingle flips one of PARITIES bits of its set, so two sets differ in at most as many bits as shingles. That bound holds
   always; it tells pairs just below the threshold apart, of which a large group of loose copies has very many.

Both bounds lie 4.7 standard deviations beyond the mean of a pair at the threshold, so a true link is missed a few times in a
million there, and far less above it.

Large lists: all pairs of a list are never written out. First each member meets the list's most central member (a hub: most
agreement with everybody else), and components are formed. A pair within one component needs no test any more. Then
pairs of different components meet: by further hubs while that is cheaper, then each with each, so no link between components is lost.

Defined results: without words, the set is empty and linked with nothing; with fewer words than a shingle, the whole word sequence is the one
shingle; rows with equal ids count as one document; a row without an id is linked with nothing and kept; repeated rows share their
class; columns beyond the id and the text are not read by `near_duplicates` and pass through `deduplicate`.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.common import computed, text_or_empty, written
from proofmill.llm.components import components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
MINIMA = 128
COORDINATES = 64
#: Neighbouring minima that make one coordinate's value.
WIDTH = 2
PARITIES = 512
#: Words whose hashes a task remembers; when full, the memory starts anew. Results do not depend on it.
MEMORY_WORDS = 150_000
#: Pairs of different components, as a multiple of all postings, up to which each meets each without a further hub; more hubs only change the work.
DIRECT = 1000
HUB_ROUNDS = 4
A = np.random.default_rng(20240501).integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
B = np.random.default_rng(20240502).integers(0, 1 << 32, MINIMA, dtype=np.uint32)


def matches_needed(similarity: float, coordinates: int = COORDINATES, width: int = WIDTH) -> int:
    """Agreeing coordinates that a pair at the threshold reaches but for about two in a million cases (4.7 standard deviations).

    Coordinates that share minima agree together more often than independent ones; the variance counts these neighbours.
    """
    p = similarity**width
    variance = p * (1 - p) + 2 * sum(similarity ** (width + d) - p * p for d in range(1, width))
    return max(1, int(coordinates * p - 4.7 * (coordinates * variance) ** 0.5))


def flips_allowed(similarity: float, minima: int = MINIMA) -> int:
    """Differing bits that a pair at the threshold does not exceed but for about two in a million cases: a differing minimum differs in its bit half the time."""
    p = (1 - similarity) / 2
    return int(minima * p + 4.7 * (minima * p * (1 - p)) ** 0.5) + 1


class WordHashes(dict):
    """64-bit hashes of words, remembered within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; A-Z are lower-cased, words are split at ASCII white space."""
    ws = text_or_empty(text).encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), dtype=np.uint64, count=len(ws))
    n = min(n, len(ws))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = mixed(out + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates as ints, one bit of each minimum packed into longs); a minimum is the smallest value of its own hash function."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, (x[at : at + 2048, None] * A + B).min(axis=0), out=least)
    wide = mixed(least.astype(np.uint64))
    value = np.zeros(COORDINATES, dtype=np.uint64)
    for i in range(WIDTH):
        value = mixed(value + np.roll(wide[:COORDINATES], -i))
    return (value >> np.uint64(32)).astype(np.uint32).view(np.int32), np.packbits((wide & np.uint64(1)).astype(np.uint8)).view(np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each of PARITIES places, packed into longs."""
    places = (shingles & np.uint64(PARITIES - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=PARITIES) & 1).astype(np.uint8)).view(np.int64)


def described(docs: DataFrame, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """(id, n_shingles, digest, coordinates, bits, parity) of every row; the last four are null for an empty set."""

    def describe():
        hashes = WordHashes()

        def of(text):
            s = shingle_set(text, shingle_words, hashes)
            return (len(s), xxhash.xxh3_128_digest(s.tobytes()), *(x.tolist() for x in (*signature(s), parities(s)))) if len(s) else (0, None, None, None, None)

        return lambda texts: [of(t) for t in texts]

    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("the_text"))
    kind = "struct<n_shingles:bigint,digest:binary,coordinates:array<int>,bits:array<bigint>,parity:array<bigint>>"
    return computed(texts, "the_text", "described", kind, describe).select("id", "described.*")


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9 and both > 0


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle_words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; written to the shared folder."""
    held = written(pairs.distinct(), "candidates")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("the_text"))
    wanted = held.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = texts.join(wanted, "id", "left_semi")
    both = held.join(texts.select(F.col("id").alias("a"), F.col("the_text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("the_text").alias("text_b")), "b")

    def verify(batches):
        hashes = WordHashes()
        for batch in batches:
            memory: dict[str, np.ndarray] = {}
            keep = []
            for x, y in zip(batch["text_a"], batch["text_b"]):
                for t in (x, y):
                    if t not in memory:
                        memory[t] = shingle_set(t, shingle_words, hashes)
                keep.append(similar(memory[x], memory[y], similarity))
            yield batch.loc[keep, ["a", "b"]]

    return written(both.mapInPandas(verify, "a bigint, b bigint").distinct(), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of docs: component_id is the smallest id reachable over links, kept says whether it is the row's own."""
    needed = matches_needed(similarity)
    rows = written(described(docs, id_col, text_col, shingle_words), "signatures")
    linked = rows.where("digest is not null and id is not null")
    classes = linked.groupBy("digest").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ("n_shingles", "coordinates", "bits", "parity")))
    classes = written(classes, "classes")

    postings = classes.select("rep", F.posexplode("coordinates").alias("coordinate", "value"))
    postings = postings.select("rep", (F.shiftleft(F.col("coordinate").cast("bigint"), 32).bitwiseOR(F.col("value").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("token"))
    shared = postings.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    held = postings.join(shared, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("size", "token"))).alias("held")).where(F.size("held") >= needed)
    held = held.withColumn("central", F.aggregate("held", F.lit(0.0), lambda s, x: s + F.log(x["size"].cast("double"))))
    held = held.withColumn("held", F.slice("held", F.lit(1), F.size("held") - (needed - 1)))
    held = written(held.select("rep", "central", F.col("held.token").alias("prefix")), "prefixes")  # each in order of (size, token)
    member = F.struct("rep", "n_shingles", "bits", "parity", "central").alias("member")
    lists = written(held.join(classes.drop("coordinates"), "rep").select(F.explode("prefix").alias("token"), member), "lists")

    def links(pairs):
        return confirmed(pairs, docs, id_col, text_col, shingle_words, similarity)

    def pairs(left, right, *conditions):
        """Distinct pairs of two lists' members under one token that their sizes and bits allow."""
        met = left.join(right.withColumnRenamed("member", "other"), "token").where(may_link(F.col("member"), F.col("other"), similarity))
        for c in conditions:
            met = met.where(c)
        return met.select(F.least("member.rep", "other.rep").alias("a"), F.greatest("member.rep", "other.rep").alias("b")).where("a < b")

    hubs = lists.groupBy("token").agg(F.max_by("member", F.struct("member.central", -F.col("member.rep"))).alias("member"))
    found = links(pairs(lists, hubs))
    labels = written(components(found), "components")
    for turn in range(HUB_ROUNDS):
        placed = lists.join(labels, F.col("member.rep") == F.col("node"), "left").select("token", "member", F.coalesce("component", "member.rep").alias("component"))
        placed = written(placed, "placed")
        sizes = placed.groupBy("token", "component").agg(F.count("*").alias("n")).groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"), F.count("*").alias("parts"))
        open_lists = sizes.where("parts > 1").select("token", "n", ((F.col("n") * F.col("n") - F.col("own")) / 2).alias("cross"))
        cross, members = open_lists.agg(F.sum("cross"), F.sum("n")).first()
        if cross is None:
            break
        placed = placed.join(open_lists.select("token"), "token", "left_semi")
        each = cross <= DIRECT * max(members, 100_000) or turn == HUB_ROUNDS - 1
        if each:  # a pair comes out under the first token that both prefixes hold, and only there
            placed = placed.join(held.select(F.col("rep").alias("holder"), "prefix"), F.col("member.rep") == F.col("holder")).drop("holder")
            right = placed.withColumnRenamed("component", "its_component").withColumnRenamed("prefix", "its_prefix")
            new = pairs(placed, right, "component < its_component", F.get(F.array_intersect("prefix", "its_prefix"), F.lit(0)) == F.col("token"))
        else:
            right = placed.groupBy("token").agg(F.max_by(F.struct("member", "component"), F.xxhash64("member.rep", F.lit(turn))).alias("hub")).select("token", "hub.member", F.col("hub.component").alias("its_component"))
            new = pairs(placed, right, "component <> its_component")
        new = links(new)
        if not new.isEmpty():
            found = found.unionByName(new)
            labels = written(components(found), "components")
        if each:
            break

    named = classes.select("digest", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def may_link(x, y, similarity: float):
    """Whether the sizes, the bits of the minima and the parities of two members allow a link."""
    n, m = x["n_shingles"], y["n_shingles"]
    sizes = F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9
    flips = differing(x["bits"], y["bits"], MINIMA // 64) <= flips_allowed(similarity)
    return sizes & flips & (differing(x["parity"], y["parity"], PARITIES // 64) <= (1 - similarity) / (1 + similarity) * (n + m) + 1e-9)


def differing(a, b, longs: int):
    return reduce(lambda s, i: s + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))), range(longs), F.lit(0))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose id is their class's smallest, with all columns; of several rows with one such id, one of each shingle set stays (the smallest text)."""
    copies, digest = "copies", "set_digest"
    while copies in docs.columns or digest in docs.columns:
        copies, digest = copies + "_", digest + "_"
    kept = near_duplicates(docs, id_col, text_col, shingle_words, similarity).where("kept and id is not null").groupBy("id").agg(F.count("*").alias(copies)).withColumnRenamed("id", f"{copies}_id")
    there = docs.join(kept, F.col(id_col).cast("bigint") == F.col(f"{copies}_id")).drop(f"{copies}_id")
    single = there.where(F.col(copies) == 1).drop(copies)

    def digests():
        hashes = WordHashes()
        return lambda texts: [xxhash.xxh3_128_digest(shingle_set(t, shingle_words, hashes).tobytes()) for t in texts]

    several = computed(there.where(F.col(copies) > 1).drop(copies), text_col, digest, "binary", digests)
    several = several.groupBy(F.col(id_col).alias(copies), digest).agg(F.min_by(F.struct(*docs.columns), F.coalesce(text_col, F.lit(""))).alias("row")).select("row.*")
    return single.unionByName(several).unionByName(docs.where(F.col(id_col).isNull()))
