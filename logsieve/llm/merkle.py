"""Merkle manifest of a dataset, with octopus multiproofs.

Every row is a leaf; the leaves of a source, in ascending doc_id, form a tree of ``FANOUT`` children a node, and the roots
of the sources, in the order of the sources, form the tree above. Leaves are numbered without a sort of a whole source:
they are range-partitioned, and counts per partition give each its first number. A level of the tree is one grouping by
(source, parent), so a level shuffles a sixteenth of the level below.

Proofs: a leaf partition holds one run of consecutive leaves per source. From the ends of its runs alone it follows which
nodes are missing to prove all its leaves at once (the octopus): at each level the siblings left of the first and right of
the last node that its leaves lead to. These coordinates are fetched once by a join; the partition then derives the shared
interiors up to the root and expands the proof of each of its leaves locally.

Defined results: a null in a column of the leaf stands as ``-``; a null source is a source of its own and comes first; null
doc_ids come first in their source and are never tampered with; rows of equal doc_id go by their leaf; repeated rows are
leaves of their own (which of them stands first is fixed when leaves are stored and makes no difference to their values);
empty and long texts are hashed whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scale

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FANOUT = 16
BITS = 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
# Leaves that one task proves, and the most tasks.
PART_LEAVES = 16_384
MAX_PARTS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The key of the tree above the sources; keys of sources are longer.
TOP = ""


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _leaf(**changed: Column) -> Column:
    return F.sha2(F.concat(*[_field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, key of the source (sorts as sources do, null first), leaf, and the leaf after tampering or null."""
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.select(
        "doc_id", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("source"))).alias("_k"),
        _leaf().alias("leaf"), F.when(struck, _leaf(text=F.translate("text", UPPER, LOWER))).alias("_bent"))


def _numbered(rows: DataFrame, order: list[str], total: int, part_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_part``, their position ``_pos`` within ``_k`` and its size ``_n``; and the runs (_part, _k, _lo, _hi, _n).

    ``rows`` is stored and has a column ``_tie`` that tells equal rows apart. Runs are as many as parts and keys together.
    """
    parts = min(MAX_PARTS, max(1, -(-total // part_rows)))
    cut = scale.materialise(rows.repartitionByRange(parts, "_k", *order, "_tie")
                            .withColumn("_part", F.spark_partition_id()))
    runs = cut.groupBy("_part", "_k").agg(F.count(F.lit(1)).alias("_c"))
    all_of, so_far = Window.partitionBy("_k"), Window.partitionBy("_k").orderBy("_part")
    runs = scale.materialise(runs.select("_part", "_k", (F.sum("_c").over(so_far) - F.col("_c")).alias("_lo"),
                                         (F.sum("_c").over(so_far) - 1).alias("_hi"), F.sum("_c").over(all_of).alias("_n")))
    place = F.row_number().over(Window.partitionBy("_part", "_k").orderBy(*order, "_tie"))
    placed = (cut.withColumn("_i", place).join(runs.drop("_hi"), ["_part", "_k"])
              .withColumn("_pos", F.col("_lo") + F.col("_i") - 1).drop("_i", "_lo", "_tie"))
    return placed, runs


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The nodes (_k, level, idx, n, hash) of every level from the leaves up; ``most`` is the largest number of leaves."""
    out, level = [nodes], 0
    while most > 1:
        level, most = level + 1, -(-most // FANOUT)
        children = F.sort_array(F.collect_list(F.struct("idx", "hash")))
        up = out[-1].where(F.col("n") > 1).groupBy(
            "_k", F.shiftright("idx", BITS).alias("idx"), F.ceil(F.col("n") / FANOUT).cast("long").alias("n")).agg(
            F.sha2(F.array_join(F.transform(children, lambda x: x["hash"]), ""), 256).alias("hash"))
        out.append(scale.materialise(up.select("_k", F.lit(level).alias("level"), "idx", "n", "hash")))
    return out


def _missing(runs: DataFrame, most: int) -> DataFrame:
    """The coordinates (_part, _k, level, idx) that a run's leaves need and do not derive: the minimal union of siblings."""
    depth = 0
    while FANOUT ** depth < most:
        depth += 1
    if not depth:
        return runs.select("_part", "_k", F.lit(0).alias("level"), F.lit(0).cast("long").alias("idx")).where(F.lit(False))
    rows = runs.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    down = lambda c: F.expr(f"shiftright({c}, {BITS} * level)")
    rows = rows.select("_part", "_k", "level", down("_lo").alias("lo"), down("_hi").alias("hi"),
                       (down("_n - 1") + 1).alias("n")).where("n > 1")
    first = F.shiftleft(F.shiftright("lo", BITS), BITS)
    last = F.least(F.shiftleft(F.shiftright("hi", BITS), BITS) + FANOUT - 1, F.col("n") - 1)
    none = F.array().cast("array<bigint>")
    left = F.when(first < F.col("lo"), F.sequence(first, F.col("lo") - 1)).otherwise(none)
    right = F.when(last > F.col("hi"), F.sequence(F.col("hi") + 1, last)).otherwise(none)
    return rows.select("_part", "_k", "level", F.explode(F.concat(left, right)).alias("idx"))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class _Run:
    """One tree's nodes as far as a run of its leaves needs them: what was fetched, and what is derived from it."""

    def __init__(self, lo: int, n: int, known: list[str], fetched: dict[tuple[int, int], str]):
        self.starts, self.rows, self.memo, level = [], [], {}, 0
        while n > 1:
            hi = lo + len(known) - 1
            first, last = lo // FANOUT * FANOUT, min(hi // FANOUT * FANOUT + FANOUT, n) - 1
            row = ([fetched[level, i] for i in range(first, lo)] + known
                   + [fetched[level, i] for i in range(hi + 1, last + 1)])
            self.starts.append(first)
            self.rows.append(row)
            known = [_sha("".join(row[i:i + FANOUT])) for i in range(0, len(row), FANOUT)]
            lo, n, level = first // FANOUT, -(-n // FANOUT), level + 1
        self.root = known[0]

    def siblings(self, level: int, idx: int) -> tuple[str, str]:
        """The hashes before and after a node in its group."""
        row, at = self.rows[level], idx - self.starts[level]
        group = at // FANOUT * FANOUT
        return "".join(row[group:at]), "".join(row[at + 1:group + FANOUT])

    def proof(self, idx: int, level: int = 0) -> str:
        if level == len(self.rows):
            return ""
        if level == 0:
            return "".join(self.siblings(0, idx)) + self.proof(idx // FANOUT, 1)
        if (level, idx) not in self.memo:
            self.memo[level, idx] = "".join(self.siblings(level, idx)) + self.proof(idx // FANOUT, level + 1)
        return self.memo[level, idx]

    def fold(self, idx: int, value: str, level: int = 0) -> str:
        """The root that ``value`` leads to at a place, given the original siblings."""
        if level == len(self.rows):
            return value
        if (level, idx, value) not in self.memo:
            before, after = self.siblings(level, idx)
            folded = _sha(before + value + after)
            if level == 0:
                return self.fold(idx // FANOUT, folded, 1)
            self.memo[level, idx, value] = self.fold(idx // FANOUT, folded, level + 1)
        return self.memo[level, idx, value]


def _expand(mine: pa.Table, given: pa.Table) -> pa.Table:
    """The proofs of one part's leaves. ``given`` holds the fetched nodes and, at level -1, each source's place."""
    mine = mine.sort_by([("_k", "ascending"), ("_pos", "ascending")])
    fetched, place, sources = {}, {}, 0
    for k, level, idx, value, n in zip(*[given.column(c).to_pylist() for c in ("_k", "level", "idx", "hash", "n")],
                                       strict=True):
        if level < 0:
            place[k], sources = idx, n
        else:
            fetched.setdefault(k, {})[level, idx] = value
    keys, pos, sizes, leaf, bent = (mine.column(c).to_pylist() for c in ("_k", "_pos", "_n", "leaf", "_bent"))
    runs, at = [], 0
    while at < len(keys):
        # A part holds consecutive leaves of a source, so the run's length follows from its first position and its key.
        stop = at + 1
        while stop < len(keys) and keys[stop] == keys[at]:
            stop += 1
        runs.append((at, stop, _Run(pos[at], sizes[at], leaf[at:stop], fetched.get(keys[at], {}))))
        at = stop
    top = _Run(place[keys[0]], sources, [run.root for _, _, run in runs], fetched.get(TOP, {}))
    out = {c: [] for c in ("subroot", "root", "proof_sha256", "folded_root", "verified")}
    for start, stop, run in runs:
        s = place[keys[start]]
        above = top.proof(s)
        for i in range(start, stop):
            out["subroot"].append(run.root)
            out["root"].append(top.root)
            out["proof_sha256"].append(_sha(run.proof(pos[i]) + above))
            folded = top.fold(s, run.fold(pos[i], leaf[i] if bent[i] is None else bent[i]))
            out["folded_root"].append(folded)
            out["verified"].append(folded == top.root)
    kinds = [pa.string()] * 4 + [pa.bool_()]
    return pa.table([mine.column("doc_id"), mine.column("leaf"),
                     *[pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)]],
                    names=["doc_id", "leaf", *out])


def manifest(docs: DataFrame, part_leaves: int = PART_LEAVES) -> tuple[DataFrame, DataFrame]:
    """The nodes of the whole tree (_k, level, idx, n, hash; ``TOP`` above the sources) and one row per leaf with its proof.

    The second table has doc_id, leaf, subroot, root, proof_sha256 (the siblings, level by level), folded_root (from the
    tampered leaf, where there is one) and verified.
    """
    stored = scale.materialise(leaves(docs).withColumn("_tie", F.monotonically_increasing_id()))
    placed, runs = _numbered(stored, ["doc_id", "leaf"], stored.count(), part_leaves)
    placed = scale.materialise(placed)
    # The sources' places need their keys alone; their number is the size of the tree above.
    sources = runs.select("_k", F.lit(0).alias("_tie")).distinct()
    n_sources, most = sources.agg(F.count(F.lit(1))).first()[0], runs.agg(F.max("_n")).first()[0] or 0
    sources = sources.select(F.lit(TOP).alias("_k"), F.col("_k").alias("_source"), "_tie")
    seated, _ = _numbered(scale.materialise(sources), ["_source"], n_sources, part_leaves)
    seated = scale.materialise(seated.select("_source", F.col("_pos").alias("_s")))
    levels = _levels(placed.select("_k", F.lit(0).alias("level"), F.col("_pos").alias("idx"), F.col("_n").alias("n"),
                                   F.col("leaf").alias("hash")), most)
    nodes = reduce(DataFrame.unionByName, levels)
    subroots = nodes.where("n = 1").join(seated, F.col("_k") == F.col("_source"))
    top = _levels(scale.materialise(subroots.select(
        F.lit(TOP).alias("_k"), F.lit(0).alias("level"), F.col("_s").alias("idx"), F.lit(n_sources).cast("long").alias("n"),
        "hash")), n_sources)
    nodes = reduce(DataFrame.unionByName, top, nodes)
    # A part's sources are consecutive as well.
    seats = runs.join(seated, F.col("_k") == F.col("_source")).select("_part", "_k", "_s")
    wide = seats.groupBy("_part").agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi")).select(
        "_part", F.lit(TOP).alias("_k"), "_lo", "_hi", F.lit(n_sources).cast("long").alias("_n"))
    wanted = _missing(runs.unionByName(wide), max(most, n_sources))
    fetched = wanted.join(nodes, ["_k", "level", "idx"]).select("_part", "_k", "level", "idx", "hash", "n")
    given = fetched.unionByName(seats.select(
        "_part", "_k", F.lit(-1).alias("level"), F.col("_s").alias("idx"), F.lit(None).cast("string").alias("hash"),
        F.lit(n_sources).cast("long").alias("n")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    proofs = placed.groupBy("_part").cogroup(given.groupBy("_part")).applyInArrow(
        _expand, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
        "verified boolean")
    return nodes, proofs
