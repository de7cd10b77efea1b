"""Benchmark decontamination: CGK embedding, bit sampling over item-sized windows, exact edit verification.

Texts and items are sequences of words, lower-cased and stripped to letters and digits. A passage is a leak of an item
of L words when its word edit distance to the item is at most ``TOLERANCE`` * L.

1. Windows of L words are taken for every length L among the items. A leak of L words shares at least
   (L - 1) - 2 * TOLERANCE * L word pairs with its item, so windows with fewer pairs known from any item of L words are
   skipped: nothing within the tolerance is lost here. All other windows are embedded and looked up.
2. A CGK embedding walks over the window: at step t it writes the current word and moves on if a random bit, drawn from
   (t, word), says so. Sequences at small edit distance then agree in most places.
3. ``TABLES`` times, ``SAMPLES`` places of the embedding are read as a key; a window and an item that agree in any key
   are a candidate pair. With half of the places agreeing, one pair is found with probability above 0.997.
4. Candidates are confirmed by the exact edit distance between the item and the best stretch around the window. A
   stretch that lacks more of the item's words than the tolerance allows is beyond it without being measured.

The items are a stated query set: they are read in blocks of bounded size, and each block is sent to all tasks for one
pass over the documents. Few passes: a block holds ``BLOCK_WORDS`` words of items.

Defined results: null and empty texts, and items without words, have no leaks; repeated documents or items each give
their own rows; ties of equal distance go to the earliest stretch; empty tables give no rows; other columns are ignored.
Items of fewer than five words only match exactly and are looked up by a hash of the whole window.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import words as W

TOLERANCE = 0.2
TABLES, SAMPLES, WALKS = 48, 3, 4
BLOCK_WORDS = 200_000
_PAD = -2


def normal_words(texts: pa.Array):
    """Where each text's normalised words start, their codes, and the distinct normalised words."""
    starts, codes, dictionary = W.split_words(texts)
    plain = pc.replace_substring_regex(pc.utf8_lower(dictionary), r"[^\p{L}\p{N}]+", "").dictionary_encode()
    codes = plain.indices.to_numpy(zero_copy_only=False)[codes]
    # Words of punctuation only are no words here.
    real = np.array(pc.binary_length(plain.dictionary).to_numpy(zero_copy_only=False) > 0)[codes] if len(codes) \
        else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(real)])
    return before[starts], codes[real], plain.dictionary


def _tolerated(length):
    return np.floor(TOLERANCE * length + 1e-9).astype(np.int64)


def _spread(symbols: np.ndarray) -> np.ndarray:
    return W.mix(symbols.astype(np.uint64) * W.PRIME)


def _embed(symbols: np.ndarray, spread: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int,
           walk: int) -> np.ndarray:
    """The first 2 * length of the 3 * length places of the CGK embedding of windows of at most ``length`` symbols.

    Every other walk starts at the window's end, so that an edit near one end leaves half of the walks in step.
    """
    done, out = np.zeros(len(starts), np.int64), np.full((2 * length, len(starts)), _PAD, np.int64)
    for t, salt in enumerate(W.draws(2 * length, 31 + walk) | np.uint64(1)):
        place = np.maximum(ends - 1 - done, 0) if walk % 2 else np.minimum(starts + done, len(symbols) - 1)
        out[t] = np.where(starts + done < ends, symbols[place], _PAD)
        # The top bit of a product with an odd number: random per step and symbol. Past the end nothing is read any more.
        done += ((spread[place] * salt) >> np.uint64(63)).astype(np.int64)
    return out


def _keys(symbols, spread, starts, ends, length) -> np.ndarray:
    """One key per table (rows) and window (columns), from places that even a slow walk fills."""
    keys, rng = [], np.random.default_rng(length)
    for walk in range(WALKS):
        embedded = _embed(symbols, spread, starts, ends, length, walk)
        for _ in range(TABLES // WALKS):
            key = np.full(len(starts), len(keys), np.uint64)
            for place in rng.choice(2 * length, SAMPLES, replace=False):
                key = (key ^ embedded[place].astype(np.uint64)) * W.PRIME
                key ^= key >> np.uint64(29)
            keys.append(key)
    return np.array(keys)


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of the item to any stretch of the text, and that stretch."""
    n = len(text)
    row, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1)
    for word in item:
        down, cross = row + 1, row[:-1] + (text != word)
        new, source = down.copy(), origin.copy()
        better = cross < new[1:]
        new[1:][better], source[1:][better] = cross[better], origin[:-1][better]
        # Insertions: the least of what lies to the left, one more per step.
        level = new - steps
        low = np.minimum.accumulate(level)
        from_left = low < level
        pick = np.where(from_left, 0, steps)
        source = source[np.maximum.accumulate(pick)]
        row, origin = low + steps, source
    end = int(np.argmin(row))
    return int(row[end]), int(origin[end]), end


class Items:
    """A block of benchmark items, prepared for matching."""

    def __init__(self, ids, texts):
        starts, codes, self.words = normal_words(pa.array(texts, pa.string()))
        self.ids, self.items = ids, [codes[a:b].astype(np.int64) for a, b in zip(starts, starts[1:], strict=False)]
        self.size = max(1, len(self.words))
        pairs = [x[:-1] * self.size + x[1:] for x in self.items if len(x) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.tables = {}
        by_length = {}
        for k, x in enumerate(self.items):
            if len(x):
                by_length.setdefault(len(x), []).append(k)
        self.exact = {}
        for length, members in by_length.items():
            flat = np.concatenate([self.items[k] for k in members])
            at = np.arange(len(members)) * length
            if not _tolerated(length):
                hashes, same = W.hash_windows(_spread(flat), length)[at], {}
                for h, k in zip(hashes.tolist(), members, strict=True):
                    same.setdefault(h, []).append(k)
                self.exact[length] = same, np.array(sorted(same), np.uint64)
                continue
            found = {}
            for table in _keys(flat, _spread(flat), at, at + length, length):
                for key, k in zip(table.tolist(), members, strict=True):
                    found.setdefault(key, []).append(k)
            own = np.concatenate([self.items[k][:-1] * self.size + self.items[k][1:] for k in members])
            own = np.searchsorted(self.pairs, np.unique(own))
            self.tables[length] = found, np.array(sorted(found), np.uint64), own

    def search(self, batch: pa.RecordBatch):
        """(row, item number, start, stop, distance) of all leaks in a batch of documents."""
        starts, codes, dictionary = normal_words(batch.column("text"))
        number = pc.fill_null(pc.index_in(dictionary, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        symbols = number.astype(np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
        n = len(symbols)
        if not n or not (self.tables or self.exact):
            return []
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        stop = starts[1:][doc]
        both = np.flatnonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0) & (doc[:-1] == doc[1:]))
        key = symbols[both] * self.size + symbols[both + 1]
        pair = np.searchsorted(self.pairs, key)
        real = np.append(self.pairs, -1)[pair] == key
        known, pair = both[real], pair[real]
        spread, pairs = _spread(symbols), set()
        for length, (table, keys, own) in self.tables.items():
            # Where the pairs known from items of this length start.
            mine = np.zeros(len(self.pairs), bool)
            mine[own] = True
            both = known[mine[pair]]
            need = length - 1 - 2 * int(_tolerated(length))
            if need > 0:
                # The first and last of ``need`` known pairs that fit into one window, and the windows around them.
                a, z = both[:max(0, len(both) - need + 1)], both[need - 1:]
                fit = (z - a <= length - 2)
                a, z = a[fit], z[fit]
                fit = doc[a] == doc[z]
                a, z = a[fit], z[fit]
                low = np.maximum(z - (length - 2), starts[doc[a]])
                size = a - low + 1
                first = np.unique(np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum()))
            else:
                first = np.flatnonzero(symbols >= 0)
            if not len(first):
                continue
            for block in np.array_split(first, -(-len(first) // 20_000)):
                got = _keys(symbols, spread, block, np.minimum(block + length, stop[block]), length)
                where = np.minimum(np.searchsorted(keys, got), len(keys) - 1)
                for t, w in zip(*np.nonzero(keys[where] == got), strict=True):
                    pairs.update((int(block[w]), k) for k in table[int(got[t, w])])
        # Overlapping windows of one item are one stretch of text.
        regions = {}
        for at, k in sorted(pairs):
            length = len(self.items[k])
            slack = int(_tolerated(length))
            begin = max(int(starts[doc[at]]), at - slack - 3)
            end = min(int(stop[at]), at + length + slack + 3)
            seen = regions.setdefault((int(doc[at]), k), [])
            if seen and begin <= seen[-1][1] - length:
                seen[-1][1] = max(seen[-1][1], end)
            else:
                seen.append([begin, end])
        found = self._equal(symbols, spread, doc, starts)
        for (row, k), spans in sorted(regions.items()):
            allowed, taken = int(_tolerated(len(self.items[k]))), -1
            for begin, end in spans:
                # Several leaks of one item may follow each other within a region: the best one splits it in two.
                open_ = [(max(begin, taken), end)]
                while open_:
                    begin, end = open_.pop()
                    if begin >= end or np.count_nonzero(~np.isin(self.items[k], symbols[begin:end])) > allowed:
                        continue
                    distance, a, b = best_stretch(self.items[k], symbols[begin:end])
                    if distance > allowed or a == b:
                        continue
                    found.append((row, k, begin + a - int(starts[row]), begin + b - int(starts[row]), distance))
                    taken = max(taken, begin + b)
                    open_ += [(begin, begin + a), (begin + b, end)]
        return found

    def _equal(self, symbols, spread, doc, starts):
        """What ``search`` gives for items too short for any edit; their stretches do not overlap."""
        found = []
        for length, (same, hashes) in self.exact.items():
            got, ends = W.hash_windows(spread, length), {}
            at = np.flatnonzero(hashes[np.minimum(np.searchsorted(hashes, got), len(hashes) - 1)] == got)
            for at in at[doc[at] == doc[at + length - 1]].tolist():
                row = int(doc[at])
                for k in same[int(got[at])]:
                    if at >= ends.get((row, k), 0) and np.array_equal(symbols[at:at + length], self.items[k]):
                        ends[row, k] = at + length
                        found.append((row, k, at - int(starts[row]), at + length - int(starts[row]), 0))
        return found


def _search(items: Items, kind: pa.DataType):
    def run(batches):
        for batch in W.slices(batches):
            found = items.search(batch)
            if found:
                rows = pa.array([r for r, *_ in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), pa.array([items.ids[k] for _, k, *_ in found], kind),
                     *[pa.array([f[i] for f in found], pa.int64()) for i in (2, 3, 4)],
                     pa.array([len(items.items[k]) for _, k, *_ in found], pa.int64())],
                    ["doc_id", "item_id", "start_word", "stop_word", "distance", "item_words"])
    return run


def _blocks(benchmark: DataFrame):
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"].encode().split())
        if size >= BLOCK_WORDS:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per leak: doc_id, item_id, the stretch in normalised words, its edit distance, the item's words."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = benchmark.schema["item_id"].dataType
    schema = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {kind.simpleString()}, start_word long, stop_word long, "
              "distance long, item_words long")
    docs = docs.select("doc_id", "text")
    # The later of two windows of equal distance is dropped by the search, so blocks only need to be put together.
    found = [docs.mapInArrow(_search(block, to_arrow_type(kind)), schema) for block in _blocks(benchmark)]
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The doc_ids with a leak, once each."""
    return leaks(docs, benchmark).select("doc_id").distinct()


def _spare(items: Items):
    def run(batches):
        for batch in W.slices(batches):
            fine = np.ones(batch.num_rows, bool)
            fine[[row for row, *_ in items.search(batch)]] = False
            yield batch.filter(pa.array(fine))
    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, with all their columns; judged beside the text, without a shuffle."""
    for block in _blocks(benchmark):
        docs = docs.mapInArrow(_spare(block), docs.schema)
    return docs
