"""Secret scans: named patterns, and candidate strings whose sliding-window Shannon entropy is high for their class.

All of it is built-in functions. Entropies are kept as whole numbers: with c the counts of a window of W characters, the
entropy is log2 W - (sum of c log2 c) / W, and c log2 c is tabulated as an integer, so adding and removing one character
per step never drifts.

Defined results: a null text is empty and has no spans; ties (spans of two kinds at one place) go in the order of the
kinds; repeated rows each get a row; an empty table gives no rows; other columns are ignored. Positions count code
points, ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
# Runs of 24 or more are the maximal runs of [0-9a-f] that are long enough.
HEX = r"[0-9a-f]{24,}"
# Runs that may hold a secret: no shorter than the window.
WINDOW = 24
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}"
# Class -> pattern of its strings and least entropy (bits) of a window. Tried in this order.
# Letters need both cases, with a small letter that has no small one beside it: words and names in camel case have none.
CLASSES = {"hex": (r"^([0-9a-f]+|[0-9A-F]+)$", 3.0), "base64": (r"[0-9]", 3.9),
           "letters": (r"[A-Z][a-z](?![a-z])|(?<![a-z])[a-z][A-Z]", 4.0)}
# Candidates that match one of these are not secrets, whatever their entropy.
ALLOWED = [r"^[^A-Za-z]*$", r"EXAMPLE|example|placeholder|dummy|xxxx",
           r"(?i)abcdefghijklmnop|0123456789abcdef|1234567890",
           r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"]
# Names and paths are allowed too: letters or up to four digits, joined. Told by what they hold and what they don't, since a
# repeated group would be matched by recursion, as deep as the string is long.
JOINED, NOT_JOINED = r"[-_/=+]", r"^[-_/=+]|[-_/=+]$|[A-Za-z][0-9]|[0-9][A-Za-z]|[0-9]{5}"
# Matches whose positions are added up at once: copies of the growing list stay short.
CHUNK = 256
_ONE = 1 << 20


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chunked(array: Column) -> Column:
    last = F.greatest(F.floor((F.size(array) - 1) / CHUNK), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(array, c * CHUNK + 1, F.lit(CHUNK)))


def _apart(candidates: Column, base: Column) -> Column:
    """The candidates that overlap no base span; of the base spans in order, only chunks that reach a candidate are compared."""
    def overlap(x, y):
        return (x["start"] < y["stop"]) & (y["start"] < x["stop"])

    def chunk(some):
        return F.struct(F.get(some, F.lit(0))["start"].alias("start"),
                        F.array_max(F.transform(some, lambda b: b["stop"])).alias("stop"), some.alias("spans"))

    near = F.transform(F.filter(_chunked(F.array_sort(base)), lambda some: F.size(some) > 0), chunk)
    return _once(near, lambda chunks: F.filter(candidates, lambda x: ~F.exists(
        chunks, lambda c: overlap(c, x) & F.exists(c["spans"], lambda b: overlap(b, x)))))


def _found(text: Column, pattern: str, short: str | None = None) -> Column:
    """Structs of start, stop and string of all matches, from the lengths of the pieces between them.

    ``short`` is a pattern that any text with a match contains; it spares the others the work.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    both = F.arrays_zip(F.slice(F.transform(pieces, F.length), 1, F.size(matches)).alias("gap"), matches.alias("m"))
    spans = F.array().cast("array<struct<start:int,stop:int,m:string>>")

    def length(x):
        return x["gap"] + F.length(x["m"])

    def step(acc, x):
        at = acc["at"] + x["gap"]
        span = F.struct(at.alias("start"), (at + F.length(x["m"])).alias("stop"), x["m"].alias("m"))
        return F.struct((acc["at"] + length(x)).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def placed(chunks):
        sums = F.transform(chunks, lambda chunk: F.aggregate(chunk, F.lit(0), lambda acc, x: acc + length(x)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        firsts = F.aggregate(sums, start, lambda acc, n: F.struct(
            (acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(chunks, firsts, lambda chunk, first: F.aggregate(
            chunk, F.struct(first.alias("at"), spans.alias("out")), step)["out"]))

    found = _once(both, lambda all_of: _once(_chunked(all_of), placed))
    return F.when(F.regexp_like(text, F.lit(short or pattern)), found)


def _lowest(string: Column, window: int) -> Column:
    """The smallest sum of c log2 c over all windows of the string, in units of 2**-20."""
    table = F.array(*[F.lit(round(c * math.log2(c) * _ONE) if c else 0) for c in range(window + 2)])
    codes = F.transform(F.filter(F.split(string, ""), lambda c: c != ""), F.ascii)
    # Code 0 is no character of a candidate: while the first window fills, it stands for what leaves.
    moves = F.zip_with(codes, F.concat(F.array_repeat(F.lit(0), window), codes),
                       lambda new, old: F.struct(new.alias("new"), old.alias("old")))
    moves = F.filter(moves, lambda x: x["new"].isNotNull())
    # The counts of all characters as one string, the count of character k standing at k: one place changes per count.
    start = F.struct(F.repeat(F.lit("A"), F.lit(128)).alias("counts"), F.lit(0).alias("sum"), F.lit(0).alias("n"),
                     F.lit(2**31 - 1).alias("best"))

    def weight(n):
        return F.element_at(table, n + 1)

    def count(counts, k):
        return F.ascii(F.substring(counts, k + 1, F.lit(1))) - ord("A")

    def put(counts, k, n):
        return F.overlay(counts, F.char(n + ord("A")), k + 1, F.lit(1))

    def step(acc, x):
        new, old, leaves = x["new"], x["old"], x["old"] > 0
        here = count(acc["counts"], new)
        # The count of what leaves already includes the new character when both are the same.
        there = count(acc["counts"], old) + (old == new).cast("int")
        total = acc["sum"] + weight(here + 1) - weight(here)
        total = F.when(leaves, total + weight(F.greatest(there - 1, F.lit(0))) - weight(there)).otherwise(total)
        added = put(acc["counts"], new, here + 1)
        counts = F.when(leaves, put(added, old, there - 1)).otherwise(added)
        return F.struct(counts.alias("counts"), total.alias("sum"), (acc["n"] + 1).alias("n"),
                        F.when(acc["n"] + 1 >= window, F.least(acc["best"], total)).otherwise(acc["best"])
                        .alias("best"))

    return F.aggregate(moves, start, step)["best"]


def _high_entropy(string: Column, window: int) -> Column:
    """Whether some window reaches the entropy of the string's class."""
    def most(bits):
        return F.lit(int(window * (math.log2(window) - bits) * _ONE))

    bound = F.lit(-1)
    for pattern, bits in reversed(CLASSES.values()):
        bound = F.when(F.regexp_like(string, F.lit(pattern)), most(bits)).otherwise(bound)
    return F.when(bound < 0, F.lit(False)).otherwise(_lowest(string, window) <= bound)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(F.coalesce(found, F.array().cast("array<struct<start:int,stop:int,m:string>>")),
                       lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"),
                                          x["stop"].alias("stop")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.element_at(names, x["k"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def scan(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans; one row per document, no shuffle.

    Candidate strings that overlap a base span, or match the allow-list, add nothing.
    """
    text = F.col("_t")
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    rows = rows.select(
        "doc_id", _found(text, ASSIGN, r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]").alias("_a"),
        _found(text, ACCESS).alias("_k"), _found(text, HEX).alias("_h"), _found(text, CANDIDATE).alias("_c"))
    # The value of an assignment: what the pattern's second group matched.
    value = lambda x: F.regexp_extract(x["m"], ASSIGN, 2)
    rows = rows.withColumns({"_a": _spans(F.filter("_a", lambda x: F.length(value(x)) >= 6), "assign"),
                             "_k": _spans(F.filter("_k", lambda x: F.length(x["m"]) >= 20), "access"),
                             "_h": _spans(F.col("_h"), "hex")})
    rows = rows.withColumn("_base", F.concat("_a", "_k", "_h"))
    fresh = _apart(F.col("_c"), F.col("_base"))
    rows = rows.withColumn("_c", F.when(F.size("_c") > 0, fresh))
    not_allowed = F.filter("_c", lambda x: ~(_any(x["m"], ALLOWED) | (
        F.regexp_like(x["m"], F.lit(JOINED)) & ~F.regexp_like(x["m"], F.lit(NOT_JOINED)))))
    rows = rows.withColumn("_c", F.when(F.size("_c") > 0, not_allowed))
    high = F.filter("_c", lambda x: _high_entropy(x["m"], window))
    rows = rows.withColumn("_e", _spans(F.when(F.size("_c") > 0, high), "entropy"))
    return rows.select(
        "doc_id", F.size("_a").cast("bigint").alias("n_assign"), F.size("_k").cast("bigint").alias("n_access"),
        F.size("_h").cast("bigint").alias("n_hex"), F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.concat("_base", "_e")).alias("spans"), F.size("_e").cast("bigint").alias("n_entropy"))


def _any(string: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.regexp_like(string, F.lit(p))
    return out
