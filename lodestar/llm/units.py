"""Whole texts as sequences of word units that tokenizers encode one by one.

A unit begins at a space or line end between two characters that are no white space, or at the text's
start. Byte-level pre-tokenizers of the given kind and sentence pieces that hold their space mark in
front only never join characters across such a place, so the ids of a text are those of its units, and
each distinct unit is encoded once a worker. A place where either side may be white space is no cut.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Bytes of text looked at together; units handed on together; distinct units, and their characters, that a worker remembers.
WINDOW, STEP, REMEMBERED, REMEMBERED_CHARS = 1 << 23, 1 << 21, 1_000_000, 1 << 25
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: First bytes of the characters among which the white space beyond ASCII is.
WIDE = np.zeros(256, bool)
WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


@dataclass
class Slice:
    """Units of consecutive rows: ``rows[i]`` has the next ``counts[i]`` of ``units``; ``ends[i]`` tells whether the row ends there."""

    rows: np.ndarray
    counts: np.ndarray
    ends: np.ndarray
    units: pa.StringArray


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where units of the texts ``data[bounds[i]:bounds[i + 1]]`` (UTF-8) begin, in order; an empty text has none."""
    found = [np.zeros(0, np.int32)]
    for low in range(0, len(data), WINDOW):
        part = data[low : low + WINDOW]
        at = np.flatnonzero((part == 32) | (part == 10)) + low
        at = at[(at > 2) & (at + 1 < len(data))]
        before, after, second = data[at - 1], data[at + 1], data[at - 2]
        wide = (before >= 128) & ((second == 0xC2) | (second >= 128) & (second < 192) & WIDE[data[at - 3]])
        found.append(at[~(SPACES[before] | SPACES[after] | WIDE[after] | wide)].astype(np.int32))
    inner, starts = np.concatenate(found), np.unique(bounds[:-1][np.diff(bounds) > 0])
    last = np.concatenate([starts, bounds[1:] - 1])
    places = np.minimum(np.searchsorted(inner, last), max(0, len(inner) - 1))
    inner = np.delete(inner, places[inner[places] == last]) if len(inner) else inner
    return np.insert(inner, np.searchsorted(inner, starts), starts)


def slices(texts: pa.Array, step: int = STEP) -> Iterator[Slice]:
    """The units of every text in order, ``step`` at a time; a null text is empty."""
    texts = pa.concat_arrays([texts.cast(pa.string()).fill_null("")])
    if not len(texts):
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2] or pa.py_buffer(b"")
    starts = cuts(np.frombuffer(held, np.uint8)[: bounds[-1]], bounds)
    edges, row = np.searchsorted(starts, bounds), 0
    starts = np.append(starts, bounds[-1]).astype(np.int32)
    for low in range(0, max(1, len(starts) - 1), step):
        high = min(low + step, len(starts) - 1)
        ended = int(np.searchsorted(edges[1:], high, "right"))
        last = ended + (ended < len(texts) and high > edges[min(ended, len(texts))])
        rows = np.arange(row, last)
        counts = np.diff(np.clip(edges[row : last + 1], low, high))
        yield Slice(rows, counts, rows < ended, pa.StringArray.from_buffers(high - low, pa.py_buffer(starts[low : high + 1].copy()), held))
        row = ended


class Memory:
    """The numbers of distinct units; ``learn`` is called with those not seen before."""

    def __init__(self, learn: Callable[[list[str]], None]):
        self.learn, self.number, self.chars = learn, {}, 0

    def numbers(self, units: pa.StringArray) -> np.ndarray:
        """The number of every unit, in order of first sight."""
        coded = units.dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        unseen = np.flatnonzero(known < 0)
        if len(unseen):
            fresh = [words[i] for i in unseen]
            self.learn(fresh)
            known[unseen] = np.arange(len(self.number), len(self.number) + len(fresh))
            self.number.update(zip(fresh, known[unseen].tolist(), strict=True))
            self.chars += sum(map(len, fresh))
        return known[coded.indices.to_numpy(zero_copy_only=False)]

    def full(self, most: int = REMEMBERED) -> bool:
        return len(self.number) > most or self.chars > REMEMBERED_CHARS


@dataclass
class Ragged:
    """Rows of unequal length in one array, grown by lists of rows."""

    values: np.ndarray
    starts: np.ndarray

    @classmethod
    def empty(cls, kind) -> Ragged:
        return cls(np.zeros(0, kind), np.zeros(1, np.int64))

    def grown(self, lengths: np.ndarray, values: np.ndarray) -> Ragged:
        return Ragged(np.concatenate([self.values, values.astype(self.values.dtype)]), np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)]))

    def lengths(self, rows: np.ndarray) -> np.ndarray:
        return self.starts[rows + 1] - self.starts[rows]

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The values of ``rows``, row after row."""
        n = self.lengths(rows)
        ends = np.cumsum(n)
        return self.values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[rows] - (ends - n), n)]


def single_threaded() -> None:
    """Keep a tokenizer to the task's core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
