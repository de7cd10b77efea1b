"""Token ids in a binary format of shuffled planes.

A file is a Parquet part; each of its rows is a segment: the ids of some consecutive documents, cut into blocks of
``BLOCK`` ids. A block is transposed into planes (``byte``: the n-th bytes of all ids together; ``bit``: the n-th bits),
and each plane is compressed with zstandard; planes of zeros are not stored. The segment row holds the chunk index
(where each plane of each block starts, how many ids each block has), the document index (doc_id, first id, ids) and a
CRC-32 of the payload, and the segment's first id within its file. Documents are never split over segments.

Documents are range-partitioned by doc_id, so file numbers ascend with doc_id; the first id of each file is the sum of
the ids in the files before it, taken from the index. The text is shuffled, not the ids, and tokens are made once, after
the shuffle. A segment is closed at ``SEGMENT`` ids, so memory is that of one segment or of one document.

Defined results: a null text is empty and gives the end id alone; rows of equal doc_id are ordered by text, and repeated
rows are written once each; a null doc_id comes first; an empty table writes no segments; other columns are ignored.
"""

from __future__ import annotations

import gc
import json
import os
import sys
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scale
from . import align
from . import words as W

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 65_536
SEGMENT = 1_000_000
LEVEL = 3
END = 1
AT_ONCE = 2_048
SLICE = 3 << 20
# Words of letters that lower-casing maps one to one and normalisation leaves alone, with a mark at most.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"
# Normalisation and splitting of the files that can be encoded word by word.
BY_WORDS = [
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
      "behavior": "Removed", "invert": True},
     {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]]


class Encoder:
    """Ids of texts; by distinct words where the tokenizer's file shows that this is the same as encoding whole texts.

    A file of the ``BY_WORDS`` kind drops white space, lower-cases and closes each run of letters with a closing token, so a
    text's ids are those of its words in turn. Of a slice of text the distinct words go to the tokenizer; those of plain
    letters, with one full stop or comma at most, are first reduced to their distinct stems, which the file's merges as
    ranks encode many to a call (a NUL stands for the end of a word). Nothing is kept between slices. Files of other kinds
    get whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.ranked = None
        steps = [(file.get("normalizer") or {}).get("normalizers"), (file.get("pre_tokenizer") or {}).get("pretokenizers")]
        self.by_words = steps == BY_WORDS and file["model"].get("end_of_word_suffix") == "</w>"
        if self.by_words:
            vocabulary, merges = file["model"]["vocab"], file["model"]["merges"]
            merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
            if all(vocabulary.get(t) == 512 + i for i, t in enumerate(merged)):
                import tiktoken

                special, letters = {t["content"] for t in file["added_tokens"]}, align._byte_letters()
                ranks = {bytes(letters[c] for c in t.removesuffix("</w>")) + b"\0" * t.endswith("</w>"): i
                         for t, i in vocabulary.items() if t not in special}
                self.ranked = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
                self.closes = np.zeros(max(ranks.values()) + 1, bool)
                self.closes[[i for t, i in ranks.items() if t.endswith(b"\0")]] = True
            self.marks = {p: self.tokenizer.encode(p, add_special_tokens=False).ids for p in ".,"}
        # The parsed file is far larger than what is kept of it.
        del file
        gc.collect()
        W.release()

    def _stems(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all stems one after another, and where each starts."""
        data, at = W.text_bytes(pc.binary_join_element_wise(stems, "", "\0"))
        ids = np.array(self.ranked.encode_ordinary(data[at[0]:at[-1]].tobytes().decode()), np.int64)
        return ids.astype(np.uint32), np.concatenate([[0], np.flatnonzero(self.closes[ids]) + 1])

    def _listed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # A result of the tokenizer is much larger than its ids, so few are held at a time.
        ids, sizes = [np.zeros(0, np.uint32)], []
        for k in range(0, len(texts), AT_ONCE):
            lists = [e.ids for e in self.tokenizer.encode_batch(texts[k:k + AT_ONCE], add_special_tokens=False)]
            sizes += map(len, lists)
            ids.append(np.fromiter(chain.from_iterable(lists), np.uint32))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words one after another, and where each word's start."""
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False).astype(bool)
        if self.ranked is None or not plain.any():
            return self._listed(words.to_pylist())
        some = words.filter(pa.array(plain))
        stems = pc.utf8_rtrim(pc.utf8_lower(some), ".,").dictionary_encode()
        flat, starts = self._stems(stems.dictionary)
        odd, odd_starts = self._listed(words.filter(pa.array(~plain)).to_pylist())
        marks, mark_starts = self._mark_ids()
        # Each word is one stretch of ids (its stem's, or its own) and perhaps that of a mark.
        body, mark = np.empty(len(words), np.int64), np.zeros(len(words), np.int64)
        body[plain] = stems.indices.to_numpy()
        body[~plain] = len(starts) - 1 + np.arange(len(words) - plain.sum())
        for k, p in enumerate(self.marks, 1):
            mark[np.flatnonzero(plain)[pc.ends_with(some, p).to_numpy(zero_copy_only=False).astype(bool)]] = k
        mark += len(starts) + len(odd_starts) - 2
        flat, starts = np.concatenate([flat, odd, marks]), np.concatenate(
            [starts, len(flat) + odd_starts[1:], len(flat) + len(odd) + mark_starts[1:]])
        ids, at = _stretches(flat, starts, np.stack([body, mark], 1).ravel())
        return ids, at[::2]

    def _mark_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """No mark, then the marks."""
        lists = [[], *self.marks.values()]
        return (np.array(list(chain.from_iterable(lists)), np.uint32),
                np.concatenate([[0], np.cumsum([len(x) for x in lists])]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each closed by the end id, and where each text starts."""
        if self.by_words:
            starts, codes, words = W.split_words(texts)
            ids, at = _stretches(*self._words(words), codes)
            before = at[starts]
        else:
            ids, before = self._listed(pc.fill_null(texts, "").to_pylist())
        text_starts = before + np.arange(len(before))
        out = np.full(int(text_starts[-1]), END, np.uint32)
        # Each text's end id stays where it is; the ids fill the places between.
        free = np.ones(len(out), bool)
        free[text_starts[1:] - 1] = False
        out[free] = ids
        return out, text_starts


def _stretches(flat: np.ndarray, starts: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The wanted stretches of ``flat`` (stretch k from ``starts[k]`` on) one after another, and where each starts."""
    lengths = np.diff(starts)[wanted]
    before = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    source = np.repeat(starts[wanted].astype(np.int64) - before[:-1], lengths)
    source += np.arange(before[-1])
    return flat[source], before


def pack(ids: np.ndarray, mode: str = "byte", block: int = BLOCK) -> tuple[bytes, list[int], list[int]]:
    """Payload, where each plane ends in it (planes of all blocks in turn), and the ids of each block."""
    planes = 4 if mode == "byte" else 32
    packer, parts, ends, counts, size = zstandard.ZstdCompressor(level=LEVEL), [], [], [], 0
    for at in range(0, len(ids), block):
        some = np.ascontiguousarray(ids[at:at + block], "<u4")
        counts.append(len(some))
        for p in range(planes):
            if mode == "byte":
                plane = np.ascontiguousarray(some.view(np.uint8)[p::4])
            else:
                plane = np.packbits(((some >> np.uint32(p)) & np.uint32(1)).astype(np.uint8))
            if plane.any():
                parts.append(packer.compress(plane.tobytes()))
                size += len(parts[-1])
            ends.append(size)
    return b"".join(parts), ends, counts


def unpack(payload: bytes, ends: list[int], counts: list[int], mode: str = "byte") -> np.ndarray:
    """The ids that ``pack`` was given."""
    planes = 4 if mode == "byte" else 32
    reader, out, start, k = zstandard.ZstdDecompressor(), [], 0, 0
    for n in counts:
        some = np.zeros(n, "<u4")
        for p in range(planes):
            if ends[k] > start:
                raw = np.frombuffer(reader.decompress(payload[start:ends[k]]), np.uint8)
                if mode == "byte":
                    some.view(np.uint8)[p::4] = raw
                else:
                    some |= np.unpackbits(raw, count=n).astype("<u4") << np.uint32(p)
            start, k = ends[k], k + 1
        out.append(some)
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def _schema(kind: str) -> str:
    return (f"file int, segment int, first long, n_ids long, mode string, doc_ids array<{kind}>, doc_starts array<long>, "
            "doc_sizes array<long>, block_ids array<long>, plane_ends array<long>, crc32 long, payload binary")


def _write(path: str, mode: str, kind: pa.DataType):
    def run(batches):
        # Threads of the tokenizer would each keep memory of their own; Spark runs a task per core already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens, part = Encoder(path), TaskContext.get().partitionId()
        docs, held, sizes, total, number, first = [], [], [], 0, 0, 0

        def segment():
            payload, ends, counts = pack(np.concatenate(held), mode)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()),
                 pa.array([total], pa.int64()), pa.array([mode]), pa.array([docs], pa.list_(kind)), pa.array([starts], pa.list_(pa.int64())),
                 pa.array([sizes], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
                 pa.array([ends], pa.list_(pa.int64())), pa.array([zlib.crc32(payload)], pa.int64()),
                 pa.array([payload], pa.binary())],
                ["file", "segment", "first", "n_ids", "mode", "doc_ids", "doc_starts", "doc_sizes", "block_ids", "plane_ends",
                 "crc32", "payload"])

        for batch in W.slices(batches, limit=SLICE):
            ids, starts = tokens.encode(batch.column("text"))
            W.release()
            names, at = batch.column("doc_id").to_pylist(), 0
            while at < len(names):
                # As many documents as fill the segment, or one.
                stop = max(at + 1, int(np.searchsorted(starts, starts[at] + SEGMENT - total, "right")) - 1)
                docs += names[at:stop]
                sizes += np.diff(starts[at:stop + 1]).tolist()
                held.append(ids[starts[at]:starts[stop]])
                total += int(starts[stop] - starts[at])
                if total >= SEGMENT or stop < len(names):
                    yield segment()
                    docs, held, sizes, total, number, first = [], [], [], 0, number + 1, first + total
                at = stop
        if docs:
            yield segment()
        tokens = held = None
        W.release()
    return run


def write_ids(docs: DataFrame, target: str, tokenizer: str, mode: str = "byte") -> None:
    """Tokenize all documents and write them to ``target`` in ascending doc_id order."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_write(tokenizer, mode, to_arrow_type(kind)), _schema(kind.simpleString())).write.parquet(target)


def _read(kind: pa.DataType, whole: bool):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if zlib.crc32(row["payload"]) != row["crc32"]:
                    raise ValueError(f"segment {row['segment']} of file {row['file']} is damaged")
                ids = unpack(row["payload"], row["plane_ends"], row["block_ids"], row["mode"])
                parts = [ids[s:s + n] for s, n in zip(row["doc_starts"], row["doc_sizes"], strict=True)]
                columns = {"doc_id": pa.array(row["doc_ids"], kind),
                           "start": pa.array([row["first"] + s for s in row["doc_starts"]], pa.int64()),
                           "n_tokens": pa.array(row["doc_sizes"], pa.int64()),
                           "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64())}
                if whole:
                    ends = np.concatenate([row["doc_starts"], [row["n_ids"]]]).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(columns)
        W.release()
    return run


def read_ids(spark: SparkSession, source: str, ids: bool = True) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, the ids."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = spark.read.parquet(source)
    element = rows.schema["doc_ids"].dataType.elementType
    # The index: ids per file, read without the payload. One row per file, as many as the writer's range partitions.
    files = rows.groupBy("file").agg(F.sum("n_ids").alias("_n"))
    files = files.select("file", (F.sum("_n").over(Window.orderBy("file")) - F.col("_n")).alias("_before"))
    if rows.select("file").distinct().count() <= scale.BROADCAST_ROWS:
        files = F.broadcast(files)
    rows = rows.join(files, "file").withColumn("first", F.col("first") + F.col("_before")).drop("_before")
    schema = f"doc_id {element.simpleString()}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    return rows.mapInArrow(_read(to_arrow_type(element), ids), schema)


def new_target(spark: SparkSession) -> str:
    return f"{scale.shared_dir(spark)}/logsieve/ids-{uuid.uuid4().hex}"
