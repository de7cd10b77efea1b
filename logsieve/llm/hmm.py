"""Hidden Markov language model: hidden states emit words; Baum-Welch trains it, the forward recursion scores whole texts.

A word is emitted in two steps: the state emits a word class (``CLASSES`` of them, from the word's first two and last
three characters, so unseen words have one as well), the class its word by counts over the whole corpus, add-half smoothed
with one unseen word a class. Transitions and class emissions are a bounded table, which every task gets; word counts grow
with the corpus and are never broadcast: texts are coded in blocks of a few megabytes, a block's distinct words are sent out
by hash buckets, as many as the corpus needs, counted there, and each block gets back the counts of its own words.

Training (``fit``): every round is one pass over the coded blocks. A task runs the scaled forward and backward recursions and
adds up expected counts of starts, transitions and class emissions; a grouping adds them over all tasks, in units of
2**-20, so that sums do not depend on their order, and the table of the next round (a bounded number of rows) goes through
the driver. In training, texts are cut into sequences of at most ``SEQUENCE`` tokens; every token counts. A sequence that
continues a text starts from the average state. Scoring runs over whole texts, whatever their length, and is exact.

Defined results: a null or empty text is its end token alone; rows of equal doc_id are scored each; a null doc_id is
training text; without training texts states and classes are uniform; an empty table gives no rows; other columns are
ignored. A held-out row's words only enter the counts if training rows hold them too.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scale
from . import words as W

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATES = 8
CLASSES = 16_384
ROUNDS = 8
SEQUENCE = 512
# Bytes of text in a block, and, on average, bytes whose blocks' distinct words one task counts.
BLOCK = 8 << 20
BUCKET = 16 << 20
# Tokens whose recursions are held at once.
HELD = 250_000
# Words of prior weight with which a state's class emissions lean on the corpus's shares.
PRIOR = 50.0
UNIT = float(1 << 20)
# The class of the end token; words have the classes from 1.
END = 0


@dataclass
class Model:
    """Start, follow-on start, transition (from, to) and class emission (state, class) probabilities; log10 of what a
    class's words are divided by; training tokens, distinct ones, and texts."""

    start: np.ndarray
    onward: np.ndarray
    moves: np.ndarray
    emits: np.ndarray
    class_log: np.ndarray
    tokens: int
    distinct: int
    texts: int


def word_classes(words: pa.Array) -> np.ndarray:
    """The class of each word."""
    if not len(words):
        return np.zeros(0, np.uint16)
    ends = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, 2), pc.utf8_slice_codeunits(words, -3, None), "\t")
    return (1 + W.hash_strings(ends, 5) % np.uint64(CLASSES - 1)).astype(np.uint16)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


CODED_BLOCK = "block long, bucket int, docs array<{0}>, held array<boolean>, sizes array<int>, codes binary, kinds binary, " \
    "words binary, trained binary"


def _code(kind: pa.DataType, buckets: int):
    """Per block one row with its rows' ids and word numbers (bucket null), and per bucket one with its distinct words.

    A block's words are numbered by bucket, so the counts of its buckets in turn are those of its words in turn.
    """
    def run(batches):
        number, part = 0, TaskContext.get().partitionId()
        names = ["block", "bucket", "docs", "held", "sizes", "codes", "kinds", "words", "trained"]
        types = [pa.int64(), pa.int32(), pa.list_(kind), pa.list_(pa.bool_()), pa.list_(pa.int32()), *[pa.binary()] * 4]
        for batch in W.slices(batches, limit=BLOCK):
            starts, codes, words = W.split_words(batch.column("text"), lower=True)
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            sizes = np.diff(starts)
            bucket = (W.hash_strings(words, 17) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            codes, words, bucket = rank[codes], words.take(pa.array(order)), bucket[order]
            trained = np.bincount(codes[np.repeat(~held, sizes)], minlength=len(words)).astype(np.int32)
            block, number = (part << 32) + number, number + 1
            rows = [(block, None, batch.column("doc_id").to_pylist(), held.tolist(), sizes.tolist(), _pack(codes),
                     _pack(word_classes(words)), None, None)]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
            for s, e in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
                # Words hold no line break.
                text = "\n".join(words.slice(s, e - s).to_pylist()).encode()
                rows.append((block, int(bucket[s]), None, None, None, None, None,
                             zstandard.ZstdCompressor(level=1).compress(text), _pack(trained[s:e])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    return run


def _count(rows: pa.Table) -> pa.Table:
    """The counts of one bucket's words, back per block; and per class the bucket's tokens and distinct words (block null)."""
    texts = [zstandard.ZstdDecompressor().decompress(x).decode() for x in rows.column("words").to_pylist()]
    words = pc.split_pattern(pa.array(texts, pa.large_string()), "\n")
    sizes = pc.list_value_length(words).to_numpy()
    coded = words.flatten().cast(pa.string()).dictionary_encode()
    codes, trained = coded.indices.to_numpy(), [_unpack(x, np.int32) for x in rows.column("trained").to_pylist()]
    n = np.bincount(codes, np.concatenate(trained), len(coded.dictionary)).astype(np.int64)
    kinds = word_classes(coded.dictionary)
    known = np.bincount(kinds[n > 0], minlength=CLASSES)
    some = np.flatnonzero(known)
    parts = np.split(n[codes], np.cumsum(sizes)[:-1])
    bucket = rows.column("bucket")[0].as_py()
    blocks = rows.column("block").to_pylist()
    none = [None] * len(blocks)
    return pa.table([pa.array([*blocks, None], pa.int64()), pa.array([bucket] * (len(blocks) + 1), pa.int32()),
                     pa.array([*map(_pack, parts), None], pa.binary()), pa.array([*none, some.tolist()], pa.list_(pa.int64())),
                     pa.array([*none, np.bincount(kinds, n, CLASSES).astype(np.int64)[some].tolist()], pa.list_(pa.int64())),
                     pa.array([*none, known[some].tolist()], pa.list_(pa.int64()))],
                    names=["block", "bucket", "n", "k", "tokens", "distinct"])


CODED = "docs array<{0}>, held array<boolean>, sizes array<int>, classes binary, known array<int>, logs array<double>"


def _recode(kind: pa.DataType):
    """A block with classes in place of words, and per row the sum of log10(count + 1/2) and the known words."""
    def run(block: pa.Table, counts: pa.Table) -> pa.Table:
        packed = counts.sort_by("bucket").column("n").to_pylist()
        n = np.concatenate([_unpack(x, np.int64) for x in packed] or [np.zeros(0, np.int64)])
        row = block.slice(0, 1).to_pylist()[0]
        codes, sizes = _unpack(row["codes"], np.int32), np.array(row["sizes"], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        sums = np.concatenate([[0.0], np.cumsum(np.log10(n + 0.5)[codes])])
        logs = sums[starts[1:]] - sums[starts[:-1]]
        known = W.counts_of((n > 0)[codes], starts)
        return pa.table([block.column("block").slice(0, 1), pa.array([row["docs"]], pa.list_(kind)), pa.array([row["held"]]),
                         pa.array([row["sizes"]], pa.list_(pa.int32())), pa.array([_pack(_unpack(row["kinds"], np.uint16)[codes])], pa.binary()),
                         pa.array([known.tolist()], pa.list_(pa.int32())), pa.array([logs.tolist()], pa.list_(pa.float64()))],
                        names=["block", "docs", "held", "sizes", "classes", "known", "logs"])
    return run


def code(docs: DataFrame) -> tuple[DataFrame, dict[str, np.ndarray], int]:
    """Blocks of coded rows, stored; per class the training tokens and distinct words; and the number of training rows."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    arrow, text = to_arrow_type(kind), F.coalesce("text", F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    coded = scale.materialise(docs.select("doc_id", text.alias("text"), held.alias("held")).mapInArrow(
        _code(arrow, max(1, -(-size // BUCKET))), CODED_BLOCK.format(kind.simpleString())))
    counts = scale.materialise(coded.where("bucket IS NOT NULL").select("block", "bucket", "words", "trained").groupBy(
        "bucket").applyInArrow(_count, "block long, bucket int, n binary, k array<long>, tokens array<long>, distinct array<long>"))
    blocks = coded.where("bucket IS NULL").select("block", "docs", "held", "sizes", "codes", "kinds")
    back = counts.where("block IS NOT NULL").select("block", "bucket", "n")
    stored, coded = coded, scale.materialise(blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        _recode(arrow), "block long, " + CODED.format(kind.simpleString())))
    classes = counts.where("block IS NULL").select(F.explode(F.arrays_zip("k", "tokens", "distinct")).alias("c")).groupBy(
        F.col("c.k").alias("k")).agg(F.sum("c.tokens").alias("tokens"), F.sum("c.distinct").alias("distinct")).toPandas()
    texts = coded.select(F.explode("held").alias("h")).where("NOT h").count()
    per_class = {c: np.zeros(CLASSES, np.int64) for c in ("tokens", "distinct")}
    for c, values in per_class.items():
        values[classes["k"].to_numpy(np.int64)] = classes[c]
        values[END] = texts if c == "tokens" else min(texts, 1)
    scale.discard(stored, counts)
    return coded, per_class, texts


def first_model(per_class: dict[str, np.ndarray], texts: int, states: int = STATES, seed: int = 7) -> Model:
    """Sticky states whose class emissions are the corpus's shares times fixed random factors."""
    tokens, distinct = per_class["tokens"], per_class["distinct"]
    shares = tokens + 0.5 * (distinct + (np.arange(len(tokens)) != END))
    random = (W.draws(states * len(tokens), seed) >> np.uint64(11)).astype(float) / float(1 << 53)
    emits = shares / max(shares.sum(), 1.0) * np.exp(2.0 * random.reshape(states, -1) - 1.0)
    emits /= emits.sum(axis=1, keepdims=True)
    moves = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(moves, 0.9 if states > 1 else 1.0)
    even = np.full(states, 1.0 / states)
    # The end token is the only one of its class, and certain in it.
    class_log = np.log10(np.maximum(shares, 0.5))
    class_log[END] = 0.0
    return Model(even, even, moves, emits, class_log, int(tokens.sum()), int(distinct.sum()), texts)


def _sequences(classes: np.ndarray, sizes: np.ndarray, longest: int | None):
    """Start and length of each sequence in ``classes`` (each text closed by the end token), and whether it continues one."""
    lengths = sizes + 1
    first = np.cumsum(lengths) - lengths
    if longest is None:
        return first, lengths, np.zeros(len(first), bool)
    pieces = -(-lengths // longest)
    piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return (np.repeat(first, pieces) + piece * longest,
            np.minimum(np.repeat(lengths, pieces) - piece * longest, longest), piece > 0)


def _batches(lengths: np.ndarray, held: int):
    """Sequences, longest first, in batches of about ``held`` tokens."""
    order = np.argsort(-lengths, kind="stable")
    bins = (np.cumsum(lengths[order]) - lengths[order]) // held
    for some in np.split(order, np.flatnonzero(np.diff(bins)) + 1):
        if len(some):
            yield some


def _steps(first: np.ndarray, lengths: np.ndarray):
    """Places of the tokens step by step (all first tokens, all second ones, ...), and where each step begins.

    Lengths descend, so the sequences still running at a step are the first ones.
    """
    alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, lengths[0] + 1))
    begins = np.concatenate([[0], np.cumsum(alive)])
    step = np.repeat(np.arange(len(alive)), alive)
    return first[np.arange(begins[-1]) - begins[step]] + step, begins


def forward(classes, first, lengths, starts, model: Model, keep: bool):
    """Scaled forward recursion: log10 likelihoods and, if kept, the state distributions, scales and emissions by step."""
    places, begins = _steps(first, lengths)
    seen = model.emits.T[classes[places]]
    logs, n = np.zeros(len(lengths)), len(lengths)
    alphas, scales = (np.empty_like(seen), np.empty(len(seen))) if keep else (None, None)
    alpha, begins = starts, begins.tolist()
    for t in range(len(begins) - 1):
        b, e = begins[t], begins[t + 1]
        n = e - b
        alpha = (alpha if t == 0 else alpha[:n] @ model.moves) * seen[b:e]
        total = alpha.sum(axis=1)
        alpha /= total[:, None]
        if keep:
            alphas[b:e], scales[b:e] = alpha, total
        logs[:n] += np.log10(total)
    return logs, alphas, scales, seen, begins, places


def expect(classes, first, lengths, onward, model: Model):
    """Expected counts of one batch: starts, follow-on starts, transitions, the states of each token, log10 likelihood."""
    starts = np.where(onward[:, None], model.onward, model.start)
    logs, alphas, scales, seen, begins, places = forward(classes, first, lengths, starts, model, True)
    moves = np.zeros_like(model.moves)
    back = np.ones((0, len(model.start)))
    for t in range(len(begins) - 2, -1, -1):
        b, e = begins[t], begins[t + 1]
        beta = np.ones((e - b, len(model.start)))
        if len(back):
            # ``back`` is emission times backward value over scale of the next step, of the sequences that go on.
            moves += alphas[b:b + len(back)].T @ back
            beta[:len(back)] = back @ model.moves.T
        back = seen[b:e] * beta / scales[b:e, None]
        alphas[b:e] *= beta
    states = alphas[:len(lengths)]
    return (states[~onward].sum(axis=0), states[onward].sum(axis=0), moves * model.moves, alphas, classes[places],
            float(logs.sum()))


def _rows_of(batches):
    """Each block's classes with the end tokens put in, sizes, and the row itself."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            sizes = np.array(row["sizes"], np.int64)
            classes = np.full(int(sizes.sum()) + len(sizes), END, np.uint16)
            inside = np.ones(len(classes), bool)
            inside[np.cumsum(sizes + 1) - 1] = False
            classes[inside] = _unpack(row["classes"], np.uint16)
            yield row, classes, sizes
        W.release()


def _expected(model):
    """Expected counts of one partition: a row per class, and rows (negative keys) for starts, transitions, likelihood."""
    def run(batches):
        m = Model(**model.value)
        states, found = len(m.start), False
        emits, starts, onwards, moves, likely = np.zeros((states, CLASSES)), 0.0, 0.0, 0.0, 0.0
        for row, classes, sizes in _rows_of(batches):
            found = True
            first, lengths, onward = _sequences(classes, sizes, SEQUENCE)
            ends = np.cumsum(sizes + 1)
            train = ~np.array(row["held"], bool)[np.searchsorted(ends, first, "right")]
            first, lengths, onward = first[train], lengths[train], onward[train]
            for some in _batches(lengths, HELD):
                s, o, a, gamma, kinds, log = expect(classes, first[some], lengths[some], onward[some], m)
                starts, onwards, moves, likely = starts + s, onwards + o, moves + a, likely + log
                for k in range(states):
                    emits[k] += np.bincount(kinds, gamma[:, k], CLASSES)
        if found:
            some = np.flatnonzero(emits.any(axis=0))
            table = np.concatenate([emits[:, some].T, np.atleast_2d(starts + np.zeros(states)), np.atleast_2d(onwards + np.zeros(states)),
                                    moves + np.zeros((states, states)), np.full((1, states), likely)])
            keys = np.concatenate([some, [-1, -2], -3 - np.arange(states), [-3 - states]])
            sums = np.rint(table * UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), *[pa.array(sums[:, k].copy()) for k in range(states)]],
                                             ["k", *[f"s{k}" for k in range(states)]])
    return run


def baum_welch(coded: DataFrame, model: Model, per_class: dict[str, np.ndarray]) -> tuple[Model, float]:
    """One round: the model re-estimated from expected counts, and the log10 likelihood of the model given."""
    states = len(model.start)
    names = [f"s{k}" for k in range(states)]
    shared = coded.sparkSession.sparkContext.broadcast(vars(model))
    # At most CLASSES + STATES + 3 rows.
    got = coded.mapInArrow(_expected(shared), "k long, " + ", ".join(f"{c} long" for c in names)).groupBy("k").agg(
        *[F.sum(c).alias(c) for c in names]).toPandas()
    shared.destroy()
    keys, values = got["k"].to_numpy(np.int64), got[names].to_numpy(np.int64) / UNIT
    sums = {int(k): v for k, v in zip(keys, values, strict=True) if k < 0}
    emits = np.zeros((states, CLASSES))
    emits[:, keys[keys >= 0]] = values[keys >= 0].T
    zero = np.zeros(states)
    shares = per_class["tokens"] + 0.5 * (per_class["distinct"] + (np.arange(CLASSES) != END))
    emits = emits + PRIOR * shares / shares.sum()
    moves = np.array([sums.get(-3 - k, zero) for k in range(states)]) + model.moves
    start = sums.get(-1, zero) + 1.0 / states
    occupied = emits.sum(axis=1)
    return Model(start / start.sum(), occupied / occupied.sum(), moves / moves.sum(axis=1, keepdims=True),
                 emits / occupied[:, None], model.class_log, model.tokens, model.distinct, model.texts), \
        float(sums.get(-3 - states, zero)[0])


def fit(coded: DataFrame, per_class: dict[str, np.ndarray], texts: int, states: int = STATES, rounds: int = ROUNDS):
    """The trained model and the log10 likelihood of the training sequences before each round."""
    model, likely = first_model(per_class, texts, states), []
    if texts:
        for _ in range(rounds):
            model, log = baum_welch(coded, model, per_class)
            likely.append(log)
    return model, likely


def _scored(model, kind: pa.DataType):
    def run(batches):
        m = Model(**model.value)
        base = np.log10(m.tokens + 0.5 * (m.distinct + 1))
        end = np.log10(m.texts + 0.5)
        for row, classes, sizes in _rows_of(batches):
            first, lengths, _ = _sequences(classes, sizes, None)
            likely = np.zeros(len(sizes))
            for some in _batches(lengths, HELD):
                likely[some] = forward(classes, first[some], lengths[some], np.tile(m.start, (len(some), 1)), m, False)[0]
            # What a class's words are divided by; the end token's share in its class is one.
            over = np.concatenate([[0.0], np.cumsum(m.class_log[classes])])
            logs = np.array(row["logs"], float)
            score = likely + logs - (over[first + lengths] - over[first])
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["docs"], kind), pa.array(row["held"], pa.bool_()), pa.array(sizes + 1),
                 pa.array(np.array(row["known"], np.int64) + (m.texts > 0)), pa.array(np.full(len(sizes), m.tokens, np.int64)),
                 pa.array(logs + end - (sizes + 1) * base), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def score(coded: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (words alone) and score (the model)."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = coded.schema["docs"].dataType.elementType
    shared = coded.sparkSession.sparkContext.broadcast(vars(model))
    return coded.mapInArrow(_scored(shared, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, "
                            "n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Train on the rows that are not held out and score every row."""
    coded, per_class, texts = code(docs)
    model, _ = fit(coded, per_class, texts, states, rounds)
    return score(coded, model)
