"""Words of whole texts as NumPy arrays, a few megabytes at a time.

A word is a maximal run of characters other than blank and U+0009 to U+000D. Texts arrive as Arrow batches; ``slices``
cuts them so that memory follows the bytes of text, not the number of rows.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
PRIME = np.uint64(0x9E3779B97F4A7C15)


def release() -> None:
    """Give memory that is free again back to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Sub-batches of at most ``limit`` bytes in ``column``, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop
        release()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after another, and where each text starts (one entry more than texts)."""
    flat = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = flat.buffers()
    starts = np.frombuffer(offsets, np.int64, len(flat) + 1, flat.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[starts[0]:starts[-1]], starts - starts[0]


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where each text's words start, the words as codes, and the distinct words the codes stand for.

    ``lower`` lower-cases A to Z only. A null text has no words.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words, offsets = lists.values, lists.offsets.to_numpy()
    # White space at either end of a text leaves an empty piece.
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate([[0], np.cumsum(real)])
    coded = words.filter(pa.array(real)).dictionary_encode()
    return before[offsets], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * PRIME + np.uint64(seed))


def hash_strings(strings: pa.Array, seed: int = 0) -> np.ndarray:
    """One 64-bit hash per string, the same in every process."""
    data, starts = text_bytes(strings)
    lengths = np.diff(starts)
    if not len(data):
        return mix(np.full(len(strings), seed, np.uint64))
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()), PRIME, np.uint64)]))
    place = np.arange(len(data)) - np.repeat(starts[:-1], lengths)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(draws(256, seed)[data] * powers[place], dtype=np.uint64)])
    return mix(sums[starts[1:]] - sums[starts[:-1]] + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive entries (also those that span two texts)."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * PRIME + hashes[i:i + n]
    return mix(out)


def hash_texts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of the whole word sequence of every text."""
    counts = np.diff(starts)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(counts.max(initial=0)), PRIME, np.uint64)]))
    place = np.arange(len(hashes)) - np.repeat(starts[:-1], counts)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers[place], dtype=np.uint64)])
    return mix(sums[starts[1:]] - sums[starts[:-1]] + counts.astype(np.uint64))


def text_ids(dictionary: pa.Array, codes: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A 128-bit identity of each text's word sequence; null for a text without words."""
    halves = [hash_texts(hash_strings(dictionary, seed)[codes], starts) for seed in (11, 12)]
    raw = np.stack(halves, 1).astype(">u8").tobytes()
    empty = np.diff(starts) == 0
    return pa.array([None if e else raw[16 * i:16 * i + 16] for i, e in enumerate(empty)], pa.binary())


def counts_of(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    before = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return before[starts[1:]] - before[starts[:-1]]
