"""Alignment of two tokenizers over the same bytes: where tokens of A and of B end together, text is cut into groups.

Both token sequences become ascending byte ends. Merging the ends is divided by merge paths: a binary search on every
``PIECE``-th diagonal of the merge finds how many ends of A and of B stand before it, so pieces are of equal work whatever
the texts look like, and are merged independently. A piece emits the ends that A and B share; an end of A that stands last
in its piece and whose equal end of B opens the next piece is found when neighbouring pieces are stitched.

Spark cuts the documents into partitions, tokens are made once, and what is stored per document is its distinct id pairs
with their multiplicities. Pairs are counted per task before they are shuffled. Two tokens that end together are each
other's suffix, so there are at most as many pairs as the tokens of both vocabularies have bytes (about 500,000 for 50,000 and
32,000 tokens): that bounds the table of counts, which is broadcast.

Defined results: null and empty texts, and texts that either tokenizer changes (its tokens' bytes are not the blank and the
text), have no tokens: zeros and an empty digest; strings of special tokens in texts are plain text; ties for the highest count of
a B id all count; repeated rows each get a row and are counted each; very long texts are encoded whole; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scale
from . import words as W

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = 131_072
# Distinct pairs a task holds before it adds them up.
HELD = 4_000_000
LONG_RUN = 10_000
RUNS = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")
# Fixed value: how byte-level BPE of this kind cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: visible Latin-1 ones as they are, others from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """A byte-level BPE file: ids of texts, and the bytes of each id.

    Where ids are merge ranks, as checked here, ranks alone encode, which is several times faster than the file's own
    library; other files of this kind are encoded by that library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, vocabulary = _byte_letters(), file["model"]["vocab"]
        special = {t["content"] for t in file.get("added_tokens", [])}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if token not in special:
                self.bytes[i] = bytes(letters[c] for c in token)
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in file["model"]["merges"]]
        ranked = all(vocabulary.get(t) == 256 + i for i, t in enumerate(merged)) and all(
            len(self.bytes[i]) == 1 for i in range(256))
        if ranked:
            import tiktoken

            ranks = {b: i for i, b in enumerate(self.bytes) if b}
            self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            self.ranked = None
        self.path, self.own = path, None

    def _exact(self, text: str) -> list[int]:
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.path)
            self.own.encode_special_tokens = True
        return self.own.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        # The pattern's matcher of the fast way gives up on runs of several hundred thousand characters.
        return [self._exact(t) if self.ranked is None or len(t) > LONG_RUN and RUNS.search(t)
                else self.ranked.encode_ordinary(t) for t in texts]


class PieceTokens:
    """A sentencepiece file that puts a blank before the text: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.encode = lambda texts: model.encode(texts, num_threads=1)
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(model.id_to_piece(list(range(model.get_piece_size()))))]


def diagonals(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Where each piece of the merge of ``a`` and ``b`` (equal ends: A first) begins in both, and where the last stops."""
    at = np.minimum(np.arange(0, len(a) + len(b) + piece, piece), len(a) + len(b))
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        first = np.zeros(len(at), bool)
        first[open_] = a[mid[open_]] <= b[at[open_] - 1 - mid[open_]]
        low, high = np.where(open_ & first, mid + 1, low), np.where(open_ & ~first, mid, high)
    return low, at - low


def shared_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``a`` and ``b`` (ascending, no repeats) of the ends that both have, merged piece by piece."""
    in_a, in_b = diagonals(a, b, piece)
    found_a, found_b = [], []
    for i, i_end, j, j_end in zip(in_a, in_a[1:], in_b, in_b[1:], strict=False):
        # The first end of B may close a token of A that the piece before ends with.
        if i and j < j_end and a[i - 1] == b[j]:
            found_a.append([i - 1])
            found_b.append([j])
        place = np.searchsorted(a[i:i_end], b[j:j_end])
        inside = np.flatnonzero(place < i_end - i)
        inside = inside[a[i + place[inside]] == b[j + inside]]
        found_a.append(i + place[inside])
        found_b.append(j + inside)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(found_a or none).astype(np.int64), np.concatenate(found_b or none).astype(np.int64)


class Aligner:
    """Groups of the texts of a slice; all texts are merged as one, since their ends are shared by both tokenizers."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        self.raw_a, self.raw_b = (pa.array(t.bytes, pa.binary()) for t in (self.a, self.b))
        self.len_a, self.len_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        # What an id is written as inside and at the end of its side of a group.
        self.marks = pa.array([f"{i}{s}" for i in range(len(self.a.bytes)) for s in ",|"]
                              + [f"{i}{s}" for i in range(len(self.b.bytes)) for s in ",;"])
        self.shift = int(len(self.b.bytes) - 1).bit_length()

    def _encode(self, tokens, raw: pa.Array, texts: list[str]):
        """Ids of all texts in one array, the tokens of each text, the bytes of all tokens, and where each text's start."""
        lists = tokens.encode(texts)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum()))
        taken = raw.take(pa.array(ids))
        data, offsets = taken.buffers()[2], np.frombuffer(taken.buffers()[1], np.int32, len(ids) + 1)
        ends = np.concatenate([[0], np.cumsum(counts)])
        flat = data.to_pybytes() if data is not None else b""
        return ids, counts, flat, offsets[ends].tolist()

    def groups(self, texts: list[str | None]):
        """Per text: tokens of A and B, groups, the digest's text as bytes; and all texts' ids at shared ends."""
        n = len(texts)
        n_a, n_b, n_groups, written = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [b""] * n
        full = [i for i, t in enumerate(texts) if t]
        some = [texts[i] for i in full]
        a, counts_a, bytes_a, cuts_a = self._encode(self.a, self.raw_a, [" " + t for t in some])
        b, counts_b, bytes_b, cuts_b = self._encode(self.b, self.raw_b, some)
        sound = np.zeros(len(some), bool)
        for i, t in enumerate(some):
            want = b" " + t.encode()
            sound[i] = (bytes_a[cuts_a[i]:cuts_a[i + 1]] == want) and (bytes_b[cuts_b[i]:cuts_b[i + 1]] == want)
        a, b = a[np.repeat(sound, counts_a)], b[np.repeat(sound, counts_b)]
        keep, counts_a, counts_b = np.array(full, np.int64)[sound], counts_a[sound], counts_b[sound]
        at_a, at_b = shared_ends(np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b]))
        stops_a = np.concatenate([[0], np.cumsum(counts_a)])
        owner = np.searchsorted(stops_a[1:], at_a, "right")
        n_a[keep], n_b[keep], n_groups[keep] = counts_a, counts_b, np.bincount(owner, minlength=len(keep))
        # Groups in turn, each the ids of A, then those of B: a token moves on by the other side's tokens before it.
        sizes_a, sizes_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        order = np.empty(len(a) + len(b), np.int64)
        code_a, code_b = 2 * a, 2 * b + 2 * len(self.len_a)
        code_a[at_a] += 1
        code_b[at_b] += 1
        order[np.arange(len(a)) + np.repeat(at_b + 1 - sizes_b, sizes_a)] = code_a
        order[np.arange(len(b)) + np.repeat(at_a + 1, sizes_b)] = code_b
        text = self.marks.take(pa.array(order))
        if len(order):
            offsets = np.frombuffer(text.buffers()[1], np.int32, len(order) + 1)
            view = memoryview(text.buffers()[2])
            cuts = offsets[stops_a + np.concatenate([[0], np.cumsum(counts_b)])].tolist()
            for i, s, e in zip(keep.tolist(), cuts, cuts[1:], strict=False):
                written[i] = view[s:e - 1]
        return n_a, n_b, n_groups, written, keep[owner], (a[at_a] << self.shift) | b[at_b]


def _tokens(a_path: str, b_path: str, kind: pa.DataType, whole: bool):
    def run(batches):
        aligner = Aligner(a_path, b_path)
        for batch in W.slices(batches, limit=3 << 20):
            texts = batch.column("text").to_pylist()
            n_a, n_b, n_groups, written, owner, pairs = aligner.groups(texts)
            # Distinct pairs of each text.
            key, times = np.unique((owner << 40) | pairs, return_counts=True)
            cuts = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.int64) << 40)
            pairs, times = (key & ((1 << 40) - 1)).astype("<u4"), times.astype("<u4")
            spans = list(zip(cuts, cuts[1:], strict=False))
            columns = [batch.column("doc_id").cast(kind), pa.array(n_a), pa.array(n_b), pa.array(n_groups),
                       pa.array([hashlib.sha256(w).hexdigest() if len(w) else "" for w in written]),
                       pa.array([pairs[s:e].tobytes() for s, e in spans], pa.binary()),
                       pa.array([times[s:e].tobytes() for s, e in spans], pa.binary())]
            names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"]
            if whole:
                columns.append(pa.array([bytes(w).decode() for w in written]))
                names.append("groups")
            yield pa.RecordBatch.from_arrays(columns, names)
    return run


def _flat(column, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _added(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(np.concatenate(pairs), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(times), len(distinct)).astype(np.int64)


def _count(batches):
    """Pairs and their counts over one partition."""
    pairs, times, held = [], [], 0
    for batch in batches:
        pairs.append(_flat(batch.column("pairs")).astype(np.int64))
        times.append(_flat(batch.column("times")).astype(np.int64))
        held += len(pairs[-1])
        if held > HELD:
            pairs, times = ([x] for x in _added(pairs, times))
            held = len(pairs[0])
    if held:
        pairs, times = _added(pairs, times)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], ["pair", "n"])


def pair_counts(stored: DataFrame, shift: int) -> DataFrame:
    """pair, n (links that hold it) and best (whether no pair with its B id has more)."""
    counts = scale.materialise(stored.select("pairs", "times").mapInArrow(_count, "pair long, n long")
                               .groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair").bitwiseAND((1 << shift) - 1)
    most = counts.groupBy(b.alias("_b")).agg(F.max("n").alias("_most"))
    return counts.join(most, b == F.col("_b")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def _score(table, names: list[str]):
    def run(batches):
        pair, n, best = table.value
        for batch in batches:
            sizes = np.array([len(x) // 4 for x in batch.column("pairs").to_pylist()], np.int64)
            times = _flat(batch.column("times")).astype(np.int64)
            at = np.searchsorted(pair, _flat(batch.column("pairs")))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            sums = [np.concatenate([[0], np.cumsum(x * times)]) for x in (n[at], best[at])] if len(pair) else \
                [np.zeros(1, np.int64)] * 2
            count_sum, n_best = (pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums)
            columns = {"n_links": batch.column("n_groups"), "n_best": n_best, "count_sum": count_sum}
            yield pa.RecordBatch.from_arrays(
                [columns[c] if c in columns else batch.column(c) for c in names], names)
    return run


def align(docs: DataFrame, a_path: str, b_path: str, groups: bool = False) -> DataFrame:
    """Per document: tokens, groups, links and how common they are in the corpus; with ``groups`` also the groups written out.

    Every group ends with one link: the last tokens of its two sides.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    shift = int(len(PieceTokens(b_path).bytes) - 1).bit_length()
    extra = ", groups string" * groups
    stored = scale.materialise(docs.select("doc_id", "text").mapInArrow(
        _tokens(a_path, b_path, to_arrow_type(kind), groups),
        f"doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary, times binary{extra}"))
    counts = pair_counts(stored, shift).toArrow().sort_by("pair")
    table = spark.sparkContext.broadcast(tuple(
        counts.column(c).to_numpy().astype(np.int64) for c in ("pair", "n", "best")))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * groups
    return stored.mapInArrow(
        _score(table, names), f"doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
        f"count_sum long, groups_sha256 string{extra}")
