"""Secret scans: all spans against a brute-force version, and very long texts."""

import math
import random
import re
from collections import Counter

from logsieve.llm import secrets

# The patterns of the base kinds, leftmost and non-overlapping, in Python's notation.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(text):
    """Every span as (start, kind, stop): classes, allow-list, overlaps and windows spelled out."""
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    out = list(base)
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        s, a, b = m[0], m.start(), m.end()
        if len(s) < 24 or any(x < b and a < y for x, _, y in base):
            continue
        pieces = re.split("[-_/=+]+", s)
        joined = len(pieces) > 1 and all(re.fullmatch("[A-Za-z]+|[0-9]{1,4}", p) for p in pieces)
        known = (not re.search("[A-Za-z]", s) or re.search("EXAMPLE|example|placeholder|dummy|xxxx", s)
                 or re.search("abcdefghijklmnop|0123456789abcdef|1234567890", s.lower())
                 or re.fullmatch("[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", s))
        if joined or known:
            continue
        bits = (3.0 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) else 3.9 if re.search("[0-9]", s)
                else 4.0 if re.search("[A-Z][a-z](?![a-z])|(?<![a-z])[a-z][A-Z]", s) else None)
        if bits is None:
            continue
        best = max(-sum(c / 24 * math.log2(c / 24) for c in Counter(s[i:i + 24]).values()) for i in range(len(s) - 23))
        if best >= bits - 1e-6:
            out.append((a, 3, b))
    names = ["assign", "access", "hex", "entropy"]
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_all_spans_equal_brute_force(spark):
    rng = random.Random(21)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "0123456789",
                 "abcXYZ0189+/_=-", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "aB3", "-_/=+ab12"]
    starts = ["token=", "API_KEY : '", "password\"=", "AKIA", "secret:", "", "", "", "", "x.", "é", "-"]
    texts = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(1, 8)):
            body = "".join(rng.choices(rng.choice(alphabets), k=rng.choice([3, 12, 20, 23, 24, 25, 40, 70])))
            if rng.random() < 0.2:
                body = rng.choice(["-", "/", "_", "=-"]).join(rng.choice(["abc", "Key", "2024", "12345", "x1", "deadbeef"])
                                                             for _ in range(rng.randrange(2, 14)))
            parts.append(rng.choice(starts) + body)
        texts.append(rng.choice([" ", "\n", ", ", " é "]).join(parts))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.spans for r in secrets.scan(frame).collect()}
    wrong = [(t, got[i], plain_spans(t)) for i, t in enumerate(texts) if got[i] != plain_spans(t)]
    assert not wrong, wrong[0]
    assert sum("entropy" in s for s in got.values()) > 50


def test_very_long_texts(spark):
    rng = random.Random(4)
    hexes = ["".join(rng.choices("0123456789abcdef", k=24)) for _ in range(100)]
    many = " ".join(hexes[i % 100] for i in range(100_000))
    texts = {"chain": "ab-" * 350_000 + "cd", "path": "/usr" * 250_000, "blob": "".join(rng.choices("abcXYZ0189+/_=-kLm", k=300_000)),
             "spaces": "token" + " " * 1_000_000 + "=", "assign": "token=" * 170_000, "letters": "aB" * 100_000, "many": many}
    frame = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r.doc_id: r for r in secrets.scan(frame).collect()}
    assert [got[k].spans for k in ("chain", "path", "spaces", "letters")] == [""] * 4
    assert got["blob"].spans == "entropy:0:300000" and got["assign"].n_assign == 1
    assert got["many"].n_hex == 100_000
    assert got["many"].spans == ",".join(f"hex:{25 * i}:{25 * i + 24}" for i in range(100_000))
