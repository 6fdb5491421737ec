"""Helpers of the Arrow functions: texts as bytes, and slices of bounded size."""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa


def encoded(batch: pa.Array) -> list[bytes]:
    """UTF-8 texts; null becomes empty."""
    return [t or b"" for t in batch.cast(pa.large_binary()).to_pylist()]


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to at most limit (or hold a single larger item)."""
    at = 0
    while at < len(sizes):
        upto, total = at, 0
        while upto < len(sizes) and (upto == at or total + sizes[upto] <= limit):
            total += sizes[upto]
            upto += 1
        yield at, upto
        at = upto


class Numbers:
    """Numbers for tokens in order of first sight, forgotten as a whole once there are more than limit."""

    def __init__(self, limit: int):
        self.limit = limit
        self.reset()

    def reset(self) -> None:
        self.of: defaultdict[bytes, int] = defaultdict(count().__next__)

    def full(self) -> bool:
        return len(self.of) > self.limit

    def __call__(self, tokens: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """The tokens' numbers, and those tokens that are new, in order of their numbers."""
        before = len(self.of)
        at = np.fromiter(map(self.of.__getitem__, tokens), np.int64, len(tokens))
        return at, list(islice(self.of, before, None))


def tokenizer_of(path: str):
    """Per worker process: the tokenizer of a file, on one thread, as each task has one core."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


_TOKENIZERS: dict = {}


def held(key: tuple, make: Callable):
    """Per worker process: what make gives, kept over tasks until one lets go of it."""
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Forgets what tasks of other kinds left in this process, which would stay beside what its next tasks need."""
    _HELD.clear()
    _TOKENIZERS.clear()
    pa.default_memory_pool().release_unused()


_HELD: dict = {}
