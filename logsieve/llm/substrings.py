"""Substring deduplication: words covered by a 50-word window that also starts in a document with a smaller doc_id.

A suffix automaton of a reference text gives, for a document streamed past it, the longest match that ends at each word
(matching statistics); where that reaches 50 words, the window ending there occurs in the reference. Sending automata of
the whole corpus to every document would cost the square of the corpus, so each document is only streamed past the
references it shares an anchor with:

1. Documents of the same text are one class: of a class only the smallest doc_id is compared, the others lose all their
   windows. Every 50-word window has an anchor, the 16-word run in it with the least hash; equal windows have equal
   anchors. Anchors are counted over all documents; one pass over the texts, then small rows only.
2. The smallest document of an anchor that occurs in several is its reference. Stretches of windows whose anchor has a
   reference elsewhere go to it; the stretches of the reference itself make up its automaton.
3. What the reference does not contain may still repeat among later documents. Those windows, few by then, are settled
   by the least doc_id per 128-bit hash of the window, counted before they are shuffled.

Hot passages cost one stretch per document, joined to a reference that Spark may repeat; no group is gathered. All
windows are judged on the input.

Defined results: null and short texts have no windows and lose nothing; rows of one doc_id do not count as smaller than
each other; a null doc_id is never smaller and nothing is smaller than it; repeated rows each get a row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scale
from . import words as W

WINDOW = 50
ANCHOR = 16
SALT_ROWS = 2_000


def _least_in(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive entries, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def _anchors(hashes: np.ndarray, starts: np.ndarray):
    """For every window inside one text: its first word and the hash of its anchor."""
    runs = W.hash_windows(hashes, ANCHOR)
    width = WINDOW - ANCHOR + 1
    if len(runs) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = _least_in(runs, width)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    first = np.flatnonzero(doc[WINDOW - 1:] == doc[:len(least)])
    return first, least[first]


def _survey(batches):
    """Word count, identity, digest of all words and the distinct anchors of every document."""
    for batch in W.slices(batches):
        texts = batch.column("text")
        starts, codes, dictionary = W.split_words(texts)
        hashes = W.hash_strings(dictionary)[codes]
        first, anchor = _anchors(hashes, starts)
        cuts = np.searchsorted(first, starts)
        anchors = [np.unique(anchor[a:b]).view(np.int64) for a, b in zip(cuts, cuts[1:], strict=False)]
        digests = [hashlib.sha256(b" ".join(t.encode().split())).hexdigest()
                   for t in texts.fill_null("").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), W.text_ids(dictionary, codes, starts), pa.array(np.diff(starts), pa.int64()),
             pa.array(digests), pa.array(anchors, pa.list_(pa.int64()))],
            ["doc_id", "gid", "n_words", "sha256", "anchors"])


def _stretches(batches):
    """Stretches of windows by reference: (reference, class, first word, text)."""
    for batch in W.slices(batches):
        texts = batch.column("text")
        starts, codes, dictionary = W.split_words(texts)
        hashes = W.hash_strings(dictionary)[codes]
        first, anchor = _anchors(hashes, starts)
        cuts = np.searchsorted(first, starts)
        out = {"ref": [], "gid": [], "least": [], "place": [], "piece": []}
        for i, (gid, least, text, known) in enumerate(zip(
                *(batch.column(c).to_pylist() for c in ("gid", "least", "text")), batch.column("refs"), strict=True)):
            known = known.values
            key = known.field("anchor").to_numpy(zero_copy_only=False).view(np.uint64)
            refs, names = np.unique(np.array(known.field("ref").to_pylist(), object), return_inverse=True)
            order = np.argsort(key)
            key, names = key[order], names[order]
            mine, at = anchor[cuts[i]:cuts[i + 1]], first[cuts[i]:cuts[i + 1]] - starts[i]
            where = np.minimum(np.searchsorted(key, mine), len(key) - 1)
            held = np.flatnonzero(key[where] == mine)
            to, at = names[where[held]], at[held]
            words = text.encode().split()
            breaks = np.flatnonzero((np.diff(at) != 1) | (to[1:] != to[:-1])) + 1
            for some in np.split(np.arange(len(at)), breaks) if len(at) else ():
                out["ref"].append(refs[to[some[0]]])
                out["gid"].append(gid)
                out["least"].append(least)
                out["place"].append(int(at[some[0]]))
                out["piece"].append(b" ".join(words[at[some[0]]:at[some[-1]] + WINDOW]).decode())
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["ref"], pa.binary()), pa.array(out["gid"], pa.binary()),
             pa.array(out["least"], batch.column("least").type), pa.array(out["place"], pa.int64()),
             pa.array(out["piece"], pa.string())], list(out))


class Automaton:
    """Suffix automaton over words. ``texts`` are kept apart by marks that match nothing."""

    def __init__(self, texts):
        self.next, self.link, self.size = [{}], [-1], [0]
        last = 0
        for k, text in enumerate(texts):
            for word in ([("mark", k)] if k else []) + text:
                last = self._add(last, word)

    def _add(self, last, word):
        step, link, size = self.next, self.link, self.size
        new = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if p >= 0:
            q = step[p][word]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and step[p].get(word) == q:
                    step[p][word] = twin
                    p = link[p]
                link[q] = link[new] = twin
        return new

    def longest(self, text) -> list[int]:
        """Matching statistics: the longest match that ends at each word."""
        step, link, size = self.next, self.link, self.size
        state, length, out = 0, 0, []
        for word in text:
            to = step[state].get(word)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = step[state].get(word)
            if to is not None:
                state, length = to, length + 1
            out.append(length)
        return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of every run of set flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _stream(batches):
    """Stream stretches past the automaton of their reference: covered words, and windows still open.

    Rows come sorted by (ref, salt), the reference's own row first.
    """
    automaton = None
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    window = pa.struct([("place", pa.int64()), ("one", pa.int64()), ("two", pa.int64())])
    for batch in batches:
        out = {"gid": [], "least": [], "spans": [], "open": []}
        for i in range(batch.num_rows):
            own, gid, least, place, piece, before = (batch.column(c)[i].as_py() for c in (
                "pieces", "gid", "least", "place", "piece", "before"))
            if own is not None:
                automaton = Automaton([p.encode().split() for p in own])
                continue
            words = piece.encode().split()
            hit = np.zeros(len(words) - WINDOW + 1, bool)
            if before:
                hit = np.array(automaton.longest(words)[WINDOW - 1:]) >= WINDOW
            left, windows = np.flatnonzero(~hit), []
            if len(left):
                codes = pa.array(words, pa.binary()).cast(pa.string()).dictionary_encode()
                index = codes.indices.to_numpy(zero_copy_only=False)
                one, two = (W.hash_windows(W.hash_strings(codes.dictionary, s)[index], WINDOW)[left].view(np.int64)
                            for s in (41, 42))
                windows = [{"place": place + int(p), "one": a, "two": b}
                           for p, a, b in zip(left, one.tolist(), two.tolist(), strict=True)]
            out["gid"].append(gid)
            out["least"].append(least)
            out["spans"].append([{"start": place + a, "stop": place + b + WINDOW - 1} for a, b in _runs(hit)])
            out["open"].append(windows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["gid"], pa.binary()), pa.array(out["least"], batch.column("least").type),
             pa.array(out["spans"], pa.list_(span)), pa.array(out["open"], pa.list_(window))], list(out))


def _cut(batches):
    """Remove the spans from the words of each text."""
    for batch in W.slices(batches):
        removed, digests = [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = text.encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            for s in spans:
                gone[s["start"]] += 1
                gone[s["stop"]] -= 1
            keep = np.cumsum(gone[:-1]) == 0
            removed.append(int((~keep).sum()))
            digests.append(hashlib.sha256(b" ".join(w for w, k in zip(words, keep, strict=True) if k)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("gid"), pa.array(removed, pa.int64()), pa.array(digests)],
                                         ["gid", "n_removed", "kept_sha256"])


def _own_text(batches):
    """Only the rows whose text is that of the class: one doc_id may stand on several texts."""
    for batch in W.slices(batches):
        starts, codes, dictionary = W.split_words(batch.column("text"))
        same = [a == b for a, b in zip(W.text_ids(dictionary, codes, starts).to_pylist(),
                                       batch.column("gid").to_pylist(), strict=True)]
        yield batch.filter(pa.array(same, pa.bool_()))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the words kept, one row per document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    survey = scale.materialise(docs.mapInArrow(
        _survey, f"doc_id {kind}, gid binary, n_words long, sha256 string, anchors array<long>"))
    # Classes of equal word sequences that have windows, by their smallest doc_id.
    classes = scale.materialise(survey.where(F.col("n_words") >= WINDOW).groupBy("gid").agg(
        F.min("doc_id").alias("least"), F.first("anchors").alias("anchors")))
    anchors = classes.where("least IS NOT NULL").select("least", "gid", F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(
        F.min(F.struct("least", "gid")).alias("_r"), F.max("least").alias("_last")).where("_r.least != _last").select(
            "anchor", F.col("_r.gid").alias("ref"))
    # At most the anchors of one document per row.
    routes = scale.materialise(anchors.join(shared, "anchor").groupBy("least", "gid").agg(
        F.collect_list(F.struct("anchor", "ref")).alias("refs")))
    texts = scale.filter_by(docs, routes.select(F.col("least").alias("doc_id")).distinct(), ["doc_id"])
    texts = texts.join(routes, F.col("doc_id") == F.col("least")).select("gid", "least", "refs", "text")
    texts = texts.mapInArrow(_own_text, texts.schema)
    # Repeated rows would send the same text again; only where there are any are texts dealt out by class to fold them.
    if not survey.where(F.col("n_words") >= WINDOW).groupBy("gid", "doc_id").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["gid"])
    texts = scale.materialise(texts)
    pieces = scale.materialise(texts.mapInArrow(
        _stretches, f"ref binary, gid binary, least {kind}, place long, piece string"))

    # The reference's row goes first, once per salt; only references with many stretches are salted.
    own = pieces.where("ref = gid").groupBy("ref").agg(
        F.collect_list("piece").alias("pieces"), F.first("least").alias("_ref_least"))
    sent = pieces.where("ref != gid")
    counts = scale.materialise(sent.groupBy("ref").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("_s")))
    own = own.join(counts, "ref")
    sent = scale.lookup_join(sent, counts.where("_s > 1"), ["ref"])
    sent = sent.withColumn("salt", F.pmod(F.xxhash64("gid", "place"), F.coalesce("_s", F.lit(1))).cast("int"))
    blank = {c: F.lit(None).cast(t) for c, t in pieces.dtypes if c != "ref"}
    rows = (own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_s") - 1))).withColumns(blank)
            .select("ref", "salt", "pieces", *blank)
            .unionByName(sent.withColumn("pieces", F.lit(None).cast("array<string>"))
                         .select("ref", "salt", "pieces", *blank)))
    # A reference of the same doc_id (on another text) is not smaller.
    least_of = pieces.where("ref = gid").select("ref", F.col("least").alias("_rl")).distinct()
    same = sent.select("ref", "least").join(least_of, ["ref"]).where("least = _rl").select("ref", "least").distinct()
    rows = rows.join(F.broadcast(same.withColumn("_same", F.lit(True))), ["ref", "least"], "left") \
        if not same.isEmpty() else rows.withColumn("_same", F.lit(None).cast("boolean"))
    rows = rows.withColumn("before", F.col("_same").isNull()).drop("_same")
    streamed = scale.materialise(
        rows.repartition("ref", "salt").sortWithinPartitions("ref", "salt", F.col("pieces").isNull()).mapInArrow(
            _stream, f"gid binary, least {kind}, spans array<struct<start:long,stop:long>>, "
                     "open array<struct<place:long,one:long,two:long>>"))

    rest = streamed.select("gid", "least", F.explode("open").alias("w")).select("gid", "least", "w.*")
    firsts = rest.groupBy("one", "two").agg(F.min("least").alias("_first"), F.max("least").alias("_last")).where(
        "_first != _last").select("one", "two", "_first")
    late = rest.join(firsts, ["one", "two"]).where(F.col("least") > F.col("_first")).select(
        "gid", F.col("place").alias("start"), (F.col("place") + WINDOW).alias("stop"))
    spans = (streamed.select("gid", F.explode("spans").alias("s")).select("gid", "s.*").unionByName(late)
             .distinct().groupBy("gid").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    cut = scale.materialise(texts.select("gid", "text").join(spans, "gid").mapInArrow(
        _cut, "gid binary, n_removed long, kept_sha256 string").dropDuplicates(["gid"]))
    out = (survey.select("doc_id", "gid", "n_words", "sha256").join(classes.select("gid", "least"), "gid", "left")
           .join(cut, "gid", "left"))
    for table in (routes, texts, pieces, counts, streamed):
        scale.discard(table)
    copy, alone = F.col("least") < F.col("doc_id"), F.col("doc_id").isNull()
    return out.select(
        "doc_id", "n_words",
        F.when(alone, F.lit(0)).when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
        .cast("bigint").alias("n_removed"),
        F.when(alone, F.col("sha256")).when(copy, F.sha2(F.lit("").cast("binary"), 256))
        .otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"))
