"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is cut into marked words (each word with the space marks before it; no piece of the models spans such a border).
The distinct words of a batch are sorted, so that walking them in order is a depth-first traversal of their trie: the forward
states of a common prefix are computed once and reused by every word below it.

A forward state says, for one prefix, which piece ends it, the score so far and where that piece starts.

* Unigram models: the usual Viterbi step, the best score over all pieces that end at the prefix.
* BPE models: the same step under a constraint between neighbours.  A segmentation is the one that merging yields exactly when
  merging gives back each pair of neighbouring pieces by itself, so a piece may follow another only if the pair is stable.
  Just one path of every prefix meets this, which makes the forward pass give the ids of the SentencePiece library.
  (A free best-score path would give other ids with a BPE model, as its scores are merge ranks.)

Characters without a piece become byte pieces (or the unknown id where the model has none).  Tokenizers are read, never trained;
the file's place is a parameter.

Defined results: a null text has null ids, an empty text has no ids; repeated rows each get their own result; other columns
pass through.  Decoding gives back the text exactly where the model normalises nothing and the text holds no U+2581,
which the models use as their space mark.
"""

from __future__ import annotations

import gc
import re
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
NO_PIECE = ({}, -1)
MARKED_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
#: Distinct words and stable pairs that a worker remembers within a task and between tasks; when full, what came last goes. Results do not depend on it.
MEMORY_WORDS = 450_000
KEPT_WORDS = 80_000
MEMORY_PAIRS = 300_000
#: Bytes of text that are encoded together; the more, the longer the shared prefixes. Results do not depend on it.
CHUNK_BYTES = 4_000_000
#: What a character without a piece costs below the worst piece in a unigram model (as in the library).
UNKNOWN_PENALTY = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def tree_of(ids: dict[str, int]) -> dict:
    """The pieces as a tree: a node maps a character to (node below, id of the piece that ends here or -1)."""
    tree: dict = {}
    for piece, i in sorted(ids.items()):  # a piece comes after its prefixes
        node = tree
        for c in piece[:-1]:
            node = node.setdefault(c, ({}, -1))[0]
        node[piece[-1]] = ({}, i)
    return tree


def read_model(path: str):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


class Surfaces:
    """What each piece stands for in a text; all that decoding needs."""

    def __init__(self, model):
        self.dummy_prefix = model.normalizer_spec.add_dummy_prefix
        self.surface = [b"" if p.type == CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else " ⁇ ".encode() if p.type == UNKNOWN else p.piece.replace(MARK, " ").encode() for p in model.pieces]

    def decode(self, ids) -> str:
        text = b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


class Vocabulary:
    """Pieces, scores and settings of a model file that normalises nothing."""

    def __init__(self, path: str):
        model = read_model(path)
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models without normalisation and with leading space marks are read")
        if any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError("models with user-defined pieces are not read")
        self.bpe = model.trainer_spec.model_type == BPE
        if not self.bpe and model.trainer_spec.model_type != UNIGRAM:
            raise ValueError("only BPE and unigram models are read")
        self.dummy_prefix = spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("only models whose pieces do not span words are read")
        self.scores = [p.score for p in model.pieces]
        self.tree = tree_of(self.ids)
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.size, self.texts = len(model.pieces), [p.piece for p in model.pieces]
        self.worst = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.surfaces = Surfaces(model)
        self._stable: dict[int, bool] = {}

    def merges(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best-scored neighbours, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stable(self, left: int, right: int) -> bool:
        """Whether merging keeps two neighbouring pieces (with left < 0: the single piece) as they are; characters without a piece never merge."""
        key = left * self.size + right
        known = self._stable.get(key)
        if known is None:
            if len(self._stable) >= MEMORY_PAIRS:
                self._stable.clear()
            parts = [self.texts[x] for x in (left, right) if x >= 0]
            known = self._stable[key] = self.merges("".join(parts)) == parts
        return known

    def follow(self, word: str, scores: list, starts: list, pieces: list, opens: list) -> None:
        """Adds the forward states of the prefixes of a word that are longer than those on the stacks.

        A state is the prefix's best score, and where its last piece starts and which it is (-1: a character without one). Its open
        starts are (start, node of the piece tree) for every start from which the characters so far begin some longer piece, so that
        only these are tried, longest first. With a BPE model the first stable piece is the only one, so it is not looked further.
        """
        root, worth, size, known, bpe = self.tree.get, self.scores, self.size, self._stable, self.bpe
        for i in range(len(scores), len(word) + 1):
            char = word[i - 1]
            best, chosen, at, following = None, -1, i - 1, []
            for start, nodes in opens[i - 1]:
                node = nodes.get(char)
                if node is not None:
                    nodes, piece = node
                    if nodes:
                        following.append((start, nodes))
                    if piece >= 0:
                        if bpe:
                            if best is None:
                                fits = known.get(pieces[start] * size + piece)
                                if fits or fits is None and self.stable(pieces[start], piece):
                                    best, chosen, at = scores[start] + worth[piece], piece, start
                        elif best is None or scores[start] + worth[piece] > best:
                            best, chosen, at = scores[start] + worth[piece], piece, start
            nodes, piece = root(char, NO_PIECE)
            if nodes:
                following.append((i - 1, nodes))
            if best is None or not bpe:
                score = scores[i - 1] + (worth[piece] if piece >= 0 else self.worst)
                if best is None or score > best:
                    best, chosen, at = score, piece, i - 1
            scores.append(best)
            starts.append(at)
            pieces.append(chosen)
            opens.append(following)

    def encode_words(self, words) -> tuple[list[str], list[int], list[int]]:
        """Distinct marked words in order, the ends of their ids, and all their ids one after another.

        Depth-first over the trie of the words, with the forward states of the current branch on stacks.
        """
        words, ends, ids = sorted(words), [], []
        stacks = [0.0], [0], [-1], [()]
        _, starts, pieces, _ = stacks
        before = ""
        for word in words:
            if word.startswith(before):
                shared = len(before)
            else:
                shared = 0
                while before[shared] == word[shared]:
                    shared += 1
            for stack in stacks:
                del stack[shared + 1 :]
            self.follow(word, *stacks)
            i, found = len(word), []
            while i:
                start = starts[i]
                if pieces[i] >= 0:
                    found.append(pieces[i])
                elif self.bytes:
                    found += [self.bytes[b] for b in reversed(word[start:i].encode("utf-8", "surrogatepass"))]
                elif not found or found[-1] != self.unknown:
                    found.append(self.unknown)
                i = start
            found.reverse()
            ids += found
            ends.append(len(ids))
            before = word
        return words, ends, ids

    def marked(self, text: str) -> list[str]:
        if not text:
            return []
        return MARKED_WORD.findall((MARK if self.dummy_prefix else "") + text.replace(" ", MARK))

    def decode(self, ids) -> str:
        return self.surfaces.decode(ids)


class Encoder:
    """Encodes lists of texts, remembering words within a bound."""

    def __init__(self, vocabulary: Vocabulary, memory_words: int = MEMORY_WORDS):
        self.vocabulary, self.memory_words = vocabulary, memory_words
        self.places: dict[str, int] = {}
        self.ends, self.ids = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def trim(self, most: int = KEPT_WORDS) -> None:
        """Forget all but the words that were learned first; common words come early."""
        if len(self.places) > most:
            self.places = dict(islice(self.places.items(), most))
            self.ends = self.ends[: most + 1].copy()
            self.ids = self.ids[: self.ends[-1]].copy()

    def learn(self, words: set[str]) -> None:
        if len(self.places) + len(words) > self.memory_words:
            self.trim(min(KEPT_WORDS, self.memory_words // 2))
        collecting = gc.isenabled()
        gc.disable()  # the states are many small objects without cycles; walking them costs more than the encoding
        try:
            new, ends, ids = self.vocabulary.encode_words(words.difference(self.places))
        finally:
            if collecting:
                gc.enable()
        self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
        self.ends = np.concatenate([self.ends, len(self.ids) + np.array(ends, dtype=np.int64)])
        self.ids = np.concatenate([self.ids, np.array(ids, dtype=np.int32)])

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's ids end, from 0); a null text has none."""
        cut = [() if t is None else self.vocabulary.marked(t) for t in texts]
        self.learn(set().union(*cut))
        counts = np.cumsum([0, *map(len, cut)])
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=counts[-1])
        lengths = self.ends[at + 1] - self.ends[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(self.ends[at] - ends[:-1], lengths) + np.arange(ends[-1])]
        bounds = ends[counts]
        if not self.vocabulary.bytes:  # neighbouring unknown characters of one text are one piece, also across words
            same = (ids == self.vocabulary.unknown) & (np.concatenate([[-1], ids])[:-1] == self.vocabulary.unknown)
            same[bounds[:-1][bounds[:-1] < len(ids)]] = False
            bounds = np.concatenate([[0], np.cumsum(~same)])[bounds]
            ids = ids[~same]
        return ids, bounds


@cache
def encoder_of(path: str, memory_words: int = MEMORY_WORDS) -> Encoder:
    """The encoder of a model file; a worker keeps it, with what it remembers, for its next tasks."""
    encoder = Encoder(Vocabulary(path), memory_words)
    gc.freeze()  # the vocabulary stays; the collector need not walk it again and again
    return encoder


@cache
def surfaces_of(path: str) -> Surfaces:
    return Surfaces(read_model(path))


def encode(docs: DataFrame, model: str | None = None, text_col: str = "text", into: str = "ids", memory_words: int = MEMORY_WORDS,
           chunk_bytes: int = CHUNK_BYTES, round_trip: str | None = None) -> DataFrame:
    """docs with one more column `into` of piece ids (a column of that name is replaced); one pass, no shuffle.

    round_trip names a further column: whether the ids decode to the text (a null text counts as true).  It is made in the same pass, so
    a task needs one Python worker, not a second one for `decode`.  memory_words and chunk_bytes trade memory for time; results do not
    depend on them.
    """
    path = model or default_model()
    added = [T.StructField(into, T.ArrayType(T.IntegerType()))] + ([T.StructField(round_trip, T.BooleanType())] if round_trip else [])
    docs = docs.drop(*[f.name for f in added])
    schema = T.StructType([*docs.schema.fields, *added])

    def run(batches):
        encoder = encoder_of(path, memory_words)
        for part in released(chunks(batches, text_col, chunk_bytes), encoder):
            texts = part.column(text_col).to_pylist()
            ids, ends = encoder(texts)
            columns = [*part.columns, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids), mask=part.column(text_col).is_null())]
            if round_trip:
                decode = encoder.vocabulary.decode
                columns.append(pa.array([t is None or decode(ids[a:b].tolist()) == t for t, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist())], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, model: str | None = None, ids_col: str = "ids", into: str = "text") -> DataFrame:
    """docs with one more column `into` of decoded text (a column of that name is replaced); null ids give a null text."""
    path = model or default_model()
    docs = docs.drop(into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.StringType())])

    def run(batches):
        surfaces = surfaces_of(path)
        for part in chunks(batches, ids_col):
            texts = [None if x is None else surfaces.decode(x) for x in part.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, into])

    return docs.mapInArrow(run, schema)


def released(parts, encoder: Encoder):
    """The parts; after the last, a waiting worker holds little."""
    try:
        yield from parts
    finally:
        encoder.trim()


def chunks(batches, column: str, size: int = CHUNK_BYTES):
    """Record batches whose column holds about `size` bytes (one row at least): small ones are put together, large ones cut."""
    held, total = [], 0
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(1, batch.column(column).nbytes))
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            held.append(part)
            total += part.column(column).nbytes
            if total >= size:
                yield from together(held)
                held, total = [], 0
    yield from together(held)


def together(batches: list[pa.RecordBatch]):
    if batches:
        yield from pa.Table.from_batches(batches).combine_chunks().to_batches()
