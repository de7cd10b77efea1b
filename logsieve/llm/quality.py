"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit per rule. A policy is
a named, versioned mask over these bits, so applying another policy, or asking what a policy would keep without one of
its rules, reads the ledger only.

Defined results: a null text counts as empty and fails the word count; repeated rows give one ledger row each; an empty
table gives an empty ledger; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
# Name -> failing condition over the measurements. The place in this list is the rule's bit: append only.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
}
# Name and version -> rules that reject.
POLICIES = {
    "base@1": ["few_words", "repeated_words"],
    "corpus@1": ["few_words", "repeated_words", "symbols"],
    "corpus@2": list(RULES),
}
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_SPACE = np.isin(np.arange(256), np.frombuffer(W.SPACES.encode(), np.uint8))


def _measure(batches):
    for batch in W.slices(batches):
        texts = batch.column("text")
        data, at = W.text_bytes(texts)
        starts, codes, _ = W.split_words(texts)
        counts = np.diff(starts)
        # Three-word windows within one text, told apart by text as well.
        doc = np.repeat(np.arange(len(counts)), counts).astype(np.uint64)
        repeated = np.zeros(len(codes), bool)
        if len(codes) > 2:
            key = W.hash_windows(codes.astype(np.uint64), 3) + doc[2:] * W.PRIME
            inside = np.flatnonzero(doc[2:] == doc[:-2])
            _, which, seen = np.unique(W.mix(key[inside]), return_inverse=True, return_counts=True)
            first = inside[seen[which] > 1]
            for i in range(3):
                repeated[first + i] = True
        lines = [[x for x in t.split("\n") if x.strip(W.SPACES)] for t in texts.fill_null("").to_pylist()]
        lead = (data & 0xC0) != 0x80
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n_words": counts.astype(np.int64),
            "word_chars": W.counts_of(lead & ~_SPACE[data], at), "n_symbols": W.counts_of(_SYMBOL[data], at),
            "n_lines": np.array([len(x) for x in lines], np.int64),
            "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
            "n_repeat_words": W.counts_of(repeated, starts)})


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every document's whole text."""
    return docs.select("doc_id", "text").mapInArrow(
        _measure, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES))


def ledger(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """Measurements and ``fail_bits``: bit i is set where rule i fails."""
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
            for i, condition in enumerate(rules.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs).withColumn("fail_bits", total)


def mask(names: list[str], rules: dict[str, str] = RULES) -> int:
    return sum(1 << list(rules).index(n) for n in names)


def passes(names: list[str], rules: dict[str, str] = RULES) -> Column:
    """True where none of the named rules failed."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(names, rules)).cast("bigint")) == 0


def apply_policy(book: DataFrame, policy: str, policies: dict[str, list[str]] = POLICIES,
                 rules: dict[str, str] = RULES) -> DataFrame:
    """The ledger with ``kept`` under a policy and ``base_failed`` under the base rules."""
    return book.withColumns({"base_failed": ~passes(policies["base@1"], rules), "kept": passes(policies[policy], rules),
                             "policy": F.lit(policy)})


def ablations(book: DataFrame, policies: dict[str, list[str]] = POLICIES,
              rules: dict[str, str] = RULES) -> DataFrame:
    """Per policy and rule: documents rejected by the policy, failing the rule, and kept again without the rule.

    The ledger is first counted per distinct bit pattern, at most 2 to the number of rules, so nothing else is shuffled.
    """
    patterns = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    plan = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"),
                              F.lit(mask(names, rules)).cast("bigint").alias("all_bits"),
                              F.lit(mask([r], rules)).cast("bigint").alias("bit"))
                     for p, names in policies.items() for r in names])
    hit = F.col("fail_bits").bitwiseAND(F.col("all_bits"))

    def where(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return (patterns.withColumn("_p", F.explode(plan)).select("fail_bits", "n", "_p.*")
            .groupBy("policy", "rule").agg(
                F.sum("n").alias("n_docs"), where(hit != 0).alias("n_rejected"),
                where(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0).alias("n_failing"),
                where(hit == F.col("bit")).alias("n_only_by_rule")))


def _judge(condition_mask: int, rules: dict[str, str]):
    """Arrow batches of whole rows to those rows that fail none of the masked rules."""
    def run(batches):
        for batch in W.slices(batches):
            texts = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column("text")],
                                               ["doc_id", "text"])
            (measured,) = _measure([texts])
            frame = measured.to_pandas()
            fine = np.ones(batch.num_rows, bool)
            for i, condition in enumerate(rules.values()):
                if condition_mask >> i & 1:
                    fine &= ~frame.eval(condition).to_numpy()
            yield batch.filter(pa.array(fine))
    return run


def keep(docs: DataFrame, policy: str, policies: dict[str, list[str]] = POLICIES,
         rules: dict[str, str] = RULES) -> DataFrame:
    """The documents that a policy keeps, with all their columns: rules are measured beside the text, without a shuffle."""
    return docs.mapInArrow(_judge(mask(policies[policy], rules), rules), docs.schema)
