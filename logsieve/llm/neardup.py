"""Near duplicates on five-word shingles: MinHash bands, odd sketches, exact confirmation.

1. Every document gets the identity of its word sequence, 250 MinHash samples of its shingle set, 50 band keys of five
   samples, and an odd sketch: samples are hashed into 1,024 bits, each toggling one bit. The bits in which two sketches
   differ estimate how many samples differ, so high similarities are told apart precisely by XOR and a bit count.
2. Documents with the same word sequence are one class; only classes go on.
3. In each band bucket the sketches of all members are compared with two of them (the least and the greatest identity).
   Of those that reach ``SCREEN`` each class keeps two, the least and the nearest; these pairs are confirmed on their
   full shingle sets.
4. Linked classes form components. Buckets that still hold several components are compared in blocks, across components
   only, so nothing is lost when two members are no match for the bucket's first or last one. In a bucket of n copies of
   one text this leaves n comparisons instead of n squared. Blocks come with the full sets, so that rows that are near but
   not near enough are settled where they meet: only links between components leave a block, not pairs.

Two sets at similarity 0.75 share no band with probability (1 - 0.75 ** 5) ** 50, about 1e-6, and fall below the screen
with about 1e-7; every link reported is exact.

Defined results: null and blank texts have no shingles, are their own component and are kept; a null doc_id is never the
smallest of a component that has another; repeated rows are copies; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scale
from . import words as W
from .components import components

WORDS = 5
BANDS, ROWS = 50, 5
BITS = 1_024
SCREEN = 0.6
# Rows and shingles that one block of a bucket holds on average, at most.
BLOCK, BLOCK_SHINGLES = 2_048, 1 << 20
_N = BANDS * ROWS
_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def shingle_sets(texts: pa.Array):
    """Identity of each text's words, its distinct shingle hashes one text after another, and where they start."""
    starts, codes, dictionary = W.split_words(texts, lower=True)
    counts = np.diff(starts)
    ids = W.text_ids(dictionary, codes, starts)
    hashes = W.hash_strings(dictionary)[codes]
    doc = np.repeat(np.arange(len(counts)), counts)
    windows = W.hash_windows(hashes, WORDS)
    inside = doc[WORDS - 1:] == doc[:len(windows)] if len(windows) else np.zeros(0, bool)
    owner, value = doc[:len(windows)][inside], windows[inside]
    # Shorter texts: their whole sequence is the one shingle.
    few = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(few):
        whole = W.hash_texts(hashes, starts)
        owner, value = np.concatenate([owner, few]), np.concatenate([value, whole[few]])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[fresh], value[fresh]
    return ids, value, np.searchsorted(owner, np.arange(len(counts) + 1))


def _samples(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash samples, one row per set; sets must not be empty."""
    x = (value >> np.uint64(32)).astype(np.uint32)
    factors, shifts = (W.draws(_N, s).astype(np.uint32) | np.uint32(1) for s in (21, 22))
    out = np.empty((len(at), _N), np.uint32)
    held = np.empty_like(x)
    for i in range(_N):
        np.multiply(x, factors[i], out=held)
        np.add(held, shifts[i], out=held)
        out[:, i] = np.minimum.reduceat(held, at)
    return out


def _odd_sketches(samples: np.ndarray) -> np.ndarray:
    place = W.mix(samples.astype(np.uint64) + W.draws(_N, 23)) % np.uint64(BITS)
    cell = np.arange(len(samples))[:, None] * BITS + place.astype(np.int64)
    odd = np.bincount(cell.ravel(), minlength=len(samples) * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, BITS), axis=1)


def similarity(differing: np.ndarray) -> np.ndarray:
    """Estimated share of equal samples from the number of differing sketch bits."""
    share = np.minimum(2.0 * differing / BITS, 1 - 1e-9)
    return 1.0 + BITS / 2.0 * np.log1p(-share) / 2.0 / _N


def _most_bits(screen: float) -> int:
    return int(np.flatnonzero(similarity(np.arange(BITS // 2)) >= screen).max())


def _sign(batches):
    for batch in W.slices(batches, limit=1 << 21):
        ids, value, at = shingle_sets(batch.column("text"))
        sizes = np.diff(at)
        some = np.flatnonzero(sizes > 0)
        bands, sketches = [None] * len(sizes), [None] * len(sizes)
        if len(some):
            samples = _samples(value, at[some])
            keys = W.draws(BANDS, 24)[None, :].repeat(len(some), 0)
            for r in range(ROWS):
                keys = W.mix(keys * W.PRIME + samples[:, r::ROWS])
            odd = _odd_sketches(samples)
            for i, k in enumerate(some):
                bands[k], sketches[k] = keys[i].view(np.int64), odd[i].tobytes()
        digests = pa.array([None if t is None else hashlib.md5(t.encode()).hexdigest()
                            for t in batch.column("text").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), digests, ids, pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())),
             pa.array(sketches, pa.binary())], ["doc_id", "text_md5", "gid", "n_shingles", "bands", "sketch"])


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, gid, n_shingles, band keys and odd sketch of every document; one pass over the texts."""
    return docs.select("doc_id", "text").mapInArrow(
        _sign, f"doc_id {_kind(docs)}, text_md5 string, gid binary, n_shingles long, bands array<long>, sketch binary")


def _sets(batches):
    for batch in W.slices(batches):
        ids, value, at = shingle_sets(batch.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(value.view(np.int64)))
        yield pa.RecordBatch.from_arrays([ids, lists], ["gid", "shingles"])


def _screen(batches):
    """(gid, hub, similarity) for rows whose sketch is near that of the bucket's first or last member."""
    most = _most_bits(SCREEN)

    def bits(column):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BITS // 16)

    for batch in batches:
        if not batch.num_rows:
            continue
        own = bits(batch.column("sketch"))
        for hub in ("low", "high"):
            apart = _POPCOUNT[own ^ bits(batch.column(f"{hub}_sketch"))].sum(1, dtype=np.int32)
            near = (apart <= most) & pc.not_equal(batch.column("gid"), batch.column(hub)).to_numpy(False)
            rows = batch.filter(pa.array(near))
            yield pa.RecordBatch.from_arrays(
                [rows.column("gid"), rows.column(hub), pa.array(similarity(apart[near]))], ["gid", "hub", "estimate"])


def _sets_of(gids: DataFrame, docs: DataFrame, members: DataFrame) -> DataFrame:
    """Full shingle sets of the classes; written to the shared folder."""
    # Any document of the class will do: its least one.
    wanted = members.join(gids, "gid", "left_semi").select("doc_id").distinct()
    sets = scale.filter_by(docs.select("doc_id", "text"), wanted, ["doc_id"]).select("text").mapInArrow(_sets, "gid binary, shingles array<long>")
    # A doc_id that stands on several texts brings further sets; each set is kept once.
    return scale.materialise(sets.where("gid IS NOT NULL").dropDuplicates(["gid"]))


def _confirm(pairs: DataFrame, docs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs of gids whose full shingle sets are similar enough; written to the shared folder."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("gid")).distinct(), docs, members)
    one = sets.select(F.col("gid").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("gid").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("bigint")
    total = F.size("x").cast("bigint") + F.size("y") - both
    links = scale.materialise(pairs.join(one, "a").join(two, "b").where(100 * both >= 75 * total).select("a", "b"))
    scale.discard(sets)
    return links


def _across(batches):
    """Links between different components among the rows of one (bucket, block, block), which arrive together."""
    most = _most_bits(SCREEN)

    def pairs(rows):
        gid, root, sketch, block = (pa.chunked_array([r.column(c) for r in rows]).to_pylist()
                                    for c in ("gid", "root", "sketch", "block"))
        bits = np.frombuffer(b"".join(sketch), np.uint16).reshape(-1, BITS // 16)
        names = {r: i for i, r in enumerate(dict.fromkeys(root))}
        comp = np.array([names[r] for r in root])
        sets = pa.chunked_array([r.column("shingles") for r in rows])
        size = pc.list_value_length(sets).to_numpy().astype(np.int64)
        start = np.cumsum(size) - size
        values, codes = np.unique(pc.list_flatten(sets).to_numpy(), return_inverse=True)
        held = np.zeros(len(values), bool)
        i_block, block = rows[0].column("i")[0].as_py(), np.array(block)
        same = i_block == rows[0].column("j")[0].as_py()
        for p in np.flatnonzero(block == i_block):
            others = (comp != comp[p]) & ((np.arange(len(comp)) > p) if same else (block != i_block))
            others = np.flatnonzero(others)
            near = others[_POPCOUNT[bits[others] ^ bits[p]].sum(1, dtype=np.int32) <= most]
            if not len(near):
                continue
            mine = codes[start[p]:start[p] + size[p]]
            held[mine] = True
            ends = np.cumsum(size[near])
            at = np.arange(ends[-1]) + np.repeat(start[near] - ends + size[near], size[near])
            both = np.add.reduceat(held[codes[at]].astype(np.int64), ends - size[near])
            held[mine] = False
            for q in near[100 * both >= 75 * (size[p] + size[near] - both)]:
                # One link joins two components; further ones between them say nothing new.
                if comp[q] != comp[p]:
                    comp[comp == comp[q]] = comp[p]
                    yield min(gid[p], gid[q]), max(gid[p], gid[q])

    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    held, current = [], None

    def done():
        found = pairs(held) if held else iter(())
        while some := list(itertools.islice(found, 10_000)):
            yield pa.RecordBatch.from_pydict({"a": [x[0] for x in some], "b": [x[1] for x in some]}, schema)

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j")), strict=True))
        at = 0
        while at < len(keys):
            stop = at
            while stop < len(keys) and keys[stop] == keys[at]:
                stop += 1
            if keys[at] != current:
                yield from done()
                held, current = [], keys[at]
            held.append(batch.slice(at, stop - at))
            at = stop
    yield from done()


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable) and kept, one row per document."""
    return _linked(docs).drop("text_md5")


def _linked(docs: DataFrame) -> DataFrame:
    signed = scale.materialise(signatures(docs))
    members = scale.materialise(signed.where("gid IS NOT NULL").groupBy("gid").agg(
        F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    keys = members.select("gid", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("gid").alias("low"),
                                      F.max("gid").alias("high")).where("n > 1")
    shared = scale.materialise(keys.join(buckets, "key").select("key", "n", "gid", "low", "high"))
    sketches = members.select("gid", "sketch")
    near = (shared.select("gid", "low", "high").distinct().join(sketches, "gid")
            .join(sketches.toDF("low", "low_sketch"), "low").join(sketches.toDF("high", "high_sketch"), "high")
            .mapInArrow(_screen, "gid binary, hub binary, estimate double"))
    # Two hubs per class: the least, on which the members of a large group agree, and the nearest.
    hubs = near.groupBy("gid").agg(F.min("hub").alias("one"), F.max(F.struct("estimate", "hub")).alias("two"))
    pairs = hubs.select("gid", F.explode(F.array("one", F.col("two.hub"))).alias("hub")).select(
        F.least("gid", "hub").alias("a"), F.greatest("gid", "hub").alias("b")).distinct()
    pairs = scale.materialise(pairs)
    links = _confirm(pairs, docs, members)
    roots = components(links)

    # Buckets that still hold several components.
    many = shared.join(roots, F.col("gid") == F.col("node"), "left").select(
        "key", "n", "gid", F.coalesce("root", "gid").alias("root"))
    many = scale.materialise(many)
    still = (many.groupBy("key").agg(F.min("root").alias("_l"), F.max("root").alias("_h"))
             .where(F.col("_l") != F.col("_h")).select("key"))
    open_rows = scale.materialise(many.join(still, "key", "left_semi"))
    sets = _sets_of(open_rows.select("gid").distinct(), docs, members)
    sizes = sets.select("gid", F.size("shingles").alias("_size"))
    blocks = open_rows.join(sizes, "gid").groupBy("key").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("_size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    open_rows = (open_rows.join(blocks, "key").join(sketches, "gid").join(sets, "gid")
                 .withColumn("block", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int")))
    # Each row meets every block of its bucket once: blocks * n rows in place of n * n pairs.
    open_rows = open_rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "gid", "root",
        "sketch", "shingles")
    more = scale.materialise(open_rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
                             .mapInArrow(_across, "a binary, b binary").distinct())
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    classes = members.select("gid", "doc_id").join(roots, F.col("gid") == F.col("node"), "left").select(
        "gid", "doc_id", F.coalesce("root", "gid").alias("root"))
    least = classes.groupBy("root").agg(F.min("doc_id").alias("component"))
    named = scale.materialise(classes.join(least, "root").select("gid", "component"))
    out = signed.select("doc_id", "text_md5", "gid", "n_shingles").join(named, "gid", "left")
    for table in (shared, pairs, many, sets, more):
        scale.discard(table)
    component = F.when(F.col("gid").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "text_md5", "n_shingles", component.alias("component_id"),
                      component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents kept, with all their columns; of rows with one doc_id and text, one."""
    dropped = _linked(docs).where("NOT kept").select("doc_id", F.col("text_md5").alias("__text_md5")).distinct()
    out = scale.filter_by(docs.withColumn("__text_md5", F.md5(F.col("text").cast("binary"))), dropped,
                          ["doc_id", "__text_md5"], how="left_anti").drop("__text_md5")
    # Where doc_ids are unique this finds nothing to drop, and rows are only shuffled if some are not.
    repeated = docs.select("doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return out
    repeated = scale.materialise(repeated.select(F.col("doc_id").alias("__repeated_id")))
    same = F.col("doc_id").eqNullSafe(F.col("__repeated_id"))
    return out.join(repeated, same, "left_anti").unionByName(
        out.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))
