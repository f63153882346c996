"""What a worker remembers of words: ragged rows of integers by word, within a bound; results never depend on it."""

from __future__ import annotations

import gc
from collections.abc import Callable
from contextlib import contextmanager
from itertools import chain, islice, repeat

import numpy as np

MEMORY_WORDS = 700_000


class Remembered:
    """Rows of integers (one or more kinds) by word.

    `learn(words)` gives the words in an order of its choice and, for each kind, the lengths of their rows and their values one after another.  When the memory is full,
    the words learned last go; common words come early.
    """

    def __init__(self, learn: Callable[[list], tuple[list, list[tuple[np.ndarray, np.ndarray]]]], kinds: int, most: int = MEMORY_WORDS):
        self.learn, self.most = learn, most
        self.places: dict = {}
        self.starts = [np.zeros(1, dtype=np.int64) for _ in range(kinds)]
        self.values = [np.zeros(0, dtype=np.int64) for _ in range(kinds)]

    def trim(self, most: int) -> None:
        if len(self.places) > most:
            self.places = dict(islice(self.places.items(), most))
            self.starts = [s[: most + 1].copy() for s in self.starts]
            self.values = [v[: s[-1]].copy() for s, v in zip(self.starts, self.values)]

    def at(self, words: list) -> np.ndarray:
        """Places of words, which may repeat; what is not remembered is learned."""
        at = self.known(words)
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = {words[i] for i in missing}
            if len(self.places) + len(new) > self.most:
                self.trim(self.most // 2)
                at = self.known(words)
                missing = np.flatnonzero(at < 0).tolist()
                new = {words[i] for i in missing}
            with uncollected():
                new, learned = self.learn(list(new))
            for i, (lengths, values) in enumerate(learned):
                self.starts[i] = np.concatenate([self.starts[i], self.starts[i][-1] + np.cumsum(lengths)])
                self.values[i] = np.concatenate([self.values[i], values])
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
            at[missing] = self.known([words[i] for i in missing])
        return at

    def known(self, words: list) -> np.ndarray:
        """Places of words, -1 where one is not remembered."""
        return np.fromiter(map(self.places.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def lengths(self, kind: int, at: np.ndarray) -> np.ndarray:
        return self.starts[kind][at + 1] - self.starts[kind][at]

    def gather(self, kind: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of the words one after another, where each word's values end, from 0)."""
        lengths = self.lengths(kind, at)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.values[kind][np.repeat(self.starts[kind][at] - ends[:-1], lengths) + np.arange(ends[-1])], ends


@contextmanager
def uncollected():
    """Many small lists without cycles are made within; walking them again and again costs more than making them."""
    collecting = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if collecting:
            gc.enable()


def ragged(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    return lengths, np.fromiter(chain.from_iterable(rows), dtype=np.int64, count=int(lengths.sum()))
