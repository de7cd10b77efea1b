"""Tokenizer alignment, Merkle manifest and hidden Markov scores against brute force, on awkward rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from logsieve.llm import align, hmm, merkle
from logsieve.llm.queries import ORACLES, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k string, hash string, n int, block long"
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    pool = ["".join(rng.choices("abcdefgé", k=rng.randrange(1, 7))) for _ in range(200)]
    texts = [" ".join(rng.choices(pool, k=rng.randrange(1, 90))) for _ in range(60)]
    texts += [None, "", " \t\n", "One TWO two\none", "a" * 30_000, " ".join(rng.choices(pool, k=9_000)), "▁x y",
              "<|endoftext|> <s> </s> <0x41>", "é\x85日本 🙂‍x\x00y", "  two  blanks \n\n end ", texts[0], texts[0], texts[1].upper()]
    out = [(i, t, None if i % 5 == 0 else "en", None if i % 11 == 0 else f"s{i % 3}", len(t or "") if i % 4 else None,
            "k", "h", 1, 2) for i, t in enumerate(texts)]
    return [*out, out[4], out[4], (4, "other", None, "s1", 5, None, None, None, None), (None, "no id", "en", "s2", 5, *[None] * 4),
            (None, None, None, None, None, *[None] * 4), (-7, "Lone", "x", "only", 4, *[None] * 4)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def in_order(values):
    return sorted(values, key=repr)


def test_merge_paths_find_all_shared_ends():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(1, 150, rng.integers(0, 60))) for _ in range(2))
        both = np.intersect1d(a, b)
        for piece in (1, 2, 7, 1000):
            x, y = align.shared_ends(a, b, piece)
            assert a[x].tolist() == both.tolist() == b[y].tolist()
            cut_a, cut_b = align.diagonals(a, b, piece)
            work = np.diff(cut_a + cut_b)
            assert (work[:-1] == piece).all() and work.sum() == len(a) + len(b)


def plain_groups(texts):
    """Group texts from the tokenizers' own libraries, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))
    letters = align._byte_letters()
    out = []
    for t in texts:
        groups = []
        if t:
            ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                       for i in ids_b for p in [b.id_to_piece(i)]]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
                j, side_a, side_b, at_a, at_b = 0, [], [], 0, 0
                for i, x in zip(ids_a, bytes_a, strict=True):
                    side_a.append(i)
                    at_a += len(x)
                    while at_b < at_a:
                        side_b.append(ids_b[j])
                        at_b += len(bytes_b[j])
                        j += 1
                    if at_a == at_b:
                        groups.append((side_a, side_b))
                        side_a, side_b = [], []
        out.append(groups)
    return out


def test_alignment_equals_plain_walk(docs, rows, nothing):
    groups = plain_groups([r[1] for r in rows])
    counts = Counter((g[0][-1], g[1][-1]) for some in groups for g in some)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    expected = []
    for r, some in zip(rows, groups, strict=True):
        links = [(g[0][-1], g[1][-1]) for g in some]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in some)
        expected.append((r[0], sum(len(g[0]) for g in some), sum(len(g[1]) for g in some), len(some), len(links),
                         sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
                         hashlib.sha256(text.encode()).hexdigest() if some else "", text))
    got = align.align(docs, tokenizer_path(A), tokenizer_path(B), groups=True)
    assert in_order(map(tuple, got.collect())) == in_order(expected)
    assert sum(bool(x) for x in groups) > 60 and not groups[66]
    assert align.align(nothing, tokenizer_path(A), tokenizer_path(B)).count() == 0


def test_ranks_encode_as_the_file_does():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path(A))
    own.encode_special_tokens = True
    tokens = align.ByteTokens(tokenizer_path(A))
    assert tokens.ranked is not None
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 40):
        text = " " + "".join(f"a{chr(c)}b {chr(c)}1{chr(c)}\n" for c in points[at:at + 40])
        assert tokens.encode([text])[0] == own.encode(text, add_special_tokens=False).ids
    long = " " + "ab" * 300_000 + " " * 400_000 + "!"
    assert tokens.encode([long])[0] == own.encode(long, add_special_tokens=False).ids


def test_pairs_in_chunks_add_up(monkeypatch):
    rng = np.random.default_rng(2)
    batches, total = [], Counter()
    for _ in range(7):
        pairs, times = rng.integers(0, 50, 30).astype("<u4"), rng.integers(1, 4, 30).astype("<u4")
        for p, t in zip(pairs.tolist(), times.tolist(), strict=True):
            total[p] += t
        batches.append(pa.RecordBatch.from_pydict({"pairs": pa.array([pairs.tobytes(), b""]),
                                                   "times": pa.array([times.tobytes(), b""])}))
    monkeypatch.setattr(align, "HELD", 40)
    (out,) = list(align._count(iter(batches)))
    assert dict(zip(out["pair"].to_pylist(), out["n"].to_pylist(), strict=True)) == dict(total)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(r, text):
        return sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    def climb(nodes):
        """The root, and per leaf its siblings by level."""
        proofs, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            up, up_groups = [], []
            for s in range(0, len(nodes), 16):
                run = nodes[s:s + 16]
                for k in range(len(run)):
                    for i in groups[s + k]:
                        proofs[i].append((run[:k], run[k + 1:]))
                up.append(sha("".join(run)))
                up_groups.append([i for g in groups[s:s + 16] for i in g])
            nodes, groups = up, up_groups
        return nodes[0], proofs

    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append((r, leaf(r, r[1])))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    roots = []
    for s in order:
        by_source[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        roots.append(climb([h for _, h in by_source[s]]))
    root, above = climb([r for r, _ in roots])
    out = []
    for s, (subroot, proofs), top in zip(order, roots, above, strict=True):
        for (r, h), proof in zip(by_source[s], proofs, strict=True):
            way = proof + top
            value = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                value = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for before, after in way:
                value = sha("".join([*before, value, *after]))
            out.append((r[0], h, subroot, root, sha("".join("".join(b + a) for b, a in way)), value, value == root))
    return out


@pytest.mark.parametrize("part_leaves", [7, 40, 10_000])
def test_manifest_equals_plain_tree(spark, docs, rows, part_leaves):
    more = [(1000 + i, f"Text {i}", "en", "big", i, *[None] * 4) for i in range(700)]
    more += [(i, "T", None, f"many{i:03}", 1, *[None] * 4) for i in range(40)]
    both = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    nodes, proofs = merkle.manifest(both, part_leaves)
    got = [tuple(r) for r in proofs.collect()]
    assert in_order(got) == in_order(plain_manifest(rows + more))
    assert {r[6] for r in got} == {True, False}
    tops = nodes.where("_k = '' AND n = 1").collect()
    assert [t.hash for t in tops] == [got[0][3]]


def test_manifest_of_few_rows(spark, nothing):
    assert merkle.manifest(nothing)[1].count() == 0
    one = spark.createDataFrame([(3, "A", None, None, None, *[None] * 4)], SCHEMA)
    (r,) = merkle.manifest(one)[1].collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha("") and r.verified == (r.folded_root == r.root)


def test_octopus_asks_for_no_node_twice_or_in_vain(spark):
    runs = spark.createDataFrame([(0, "a", 5, 40, 300), (1, "a", 41, 299, 300)], "_part int, _k string, _lo long, _hi long, _n long")
    asked = {(r._part, r.level, r.idx) for r in merkle._missing(runs, 300).collect()}
    assert asked == ({(0, 0, i) for i in [*range(5), *range(41, 48)]} | {(0, 1, i) for i in range(3, 16)}
                     | {(0, 2, 1)} | {(1, 0, i) for i in range(32, 41)} | {(1, 1, i) for i in range(2)})


def plain_tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in lower.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]


def test_scores_equal_plain_forward_recursion(docs, rows, nothing):
    coded, per_class, texts = hmm.code(docs)
    model, likely = hmm.fit(coded, per_class, texts, states=3, rounds=3)
    assert len(likely) == 3 and likely == sorted(likely)
    got = [tuple(r) for r in hmm.score(coded, model).collect()]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows]
    counts, n_train = Counter(), 0
    for r, h in zip(rows, held, strict=True):
        if not h:
            counts.update(plain_tokens(r[1]))
            n_train += 1
    assert texts == n_train
    total, distinct = sum(counts.values()) + n_train, len(counts) + 1
    every = sorted({w for r in rows for w in plain_tokens(r[1])})
    kind = dict(zip(every, hmm.word_classes(pa.array(every)).tolist(), strict=True))
    class_tokens, class_words = Counter(), Counter()
    for w, n in counts.items():
        class_tokens[kind[w]] += n
        class_words[kind[w]] += 1
    expected = []
    for r, h in zip(rows, held, strict=True):
        tokens = plain_tokens(r[1])
        base = sum(math.log10((c + 0.5) / (total + 0.5 * (distinct + 1))) for c in [*(counts[w] for w in tokens), n_train])
        state, score = model.start, 0.0
        for t, w in enumerate([*tokens, None]):
            k = 0 if w is None else kind[w]
            inside = 1.0 if w is None else (counts[w] + 0.5) / (class_tokens[k] + 0.5 * (class_words[k] + 1))
            state = (state if t == 0 else state @ model.moves) * model.emits[:, k] * inside
            score += math.log10(state.sum())
            state = state / state.sum()
        expected.append((r[0], h, len(tokens) + 1, sum(counts[w] > 0 for w in tokens) + 1, total, base, score))
    for x, y in zip(in_order(got), in_order(expected), strict=True):
        assert x[:5] == y[:5]
        assert x[5] == pytest.approx(y[5], rel=1e-9) and x[6] == pytest.approx(y[6], rel=1e-9)
    assert hmm.score_documents(nothing).count() == 0


def test_probabilities_add_up(docs):
    coded, per_class, texts = hmm.code(docs)
    model, _ = hmm.fit(coded, per_class, texts, states=2, rounds=1)
    for p in (model.start, model.onward, *model.moves, *model.emits):
        assert p.sum() == pytest.approx(1.0) and (p >= 0).all()


def test_round_equals_plain_baum_welch():
    """Expected counts of batches against sums over all state paths."""
    import itertools

    rng = np.random.default_rng(4)
    states, kinds = 2, 5
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    model = hmm.Model(norm(rng.random(states)), norm(rng.random(states)), norm(rng.random((states, states))),
                      norm(rng.random((states, kinds))), None, 0, 0, 0)
    classes, sizes = rng.integers(0, kinds, 17).astype(np.uint16), np.array([0, 6, 3, 4])
    first, lengths, onward = hmm._sequences(classes, sizes, 4)
    assert lengths.tolist() == [1, 4, 3, 4, 4, 1] and onward.tolist() == [False, False, True, False, False, True]
    start, follow, moves, emits, likely = np.zeros(2), np.zeros(2), np.zeros((2, 2)), np.zeros((2, kinds)), 0.0
    for f, n, o in zip(first, lengths, onward, strict=True):
        seen, paths = classes[f:f + n], {}
        for path in itertools.product(range(states), repeat=int(n)):
            p = (model.onward if o else model.start)[path[0]] * model.emits[path[0], seen[0]]
            for t in range(1, n):
                p *= model.moves[path[t - 1], path[t]] * model.emits[path[t], seen[t]]
            paths[path] = p
        whole = sum(paths.values())
        likely += math.log10(whole)
        for path, p in paths.items():
            (follow if o else start)[path[0]] += p / whole
            for t in range(n):
                emits[path[t], seen[t]] += p / whole
                if t:
                    moves[path[t - 1], path[t]] += p / whole
    sums = [np.zeros(2), np.zeros(2), np.zeros((2, 2)), np.zeros((2, kinds)), 0.0]
    for some in hmm._batches(lengths, 5):
        s, o, a, gamma, seen, log = hmm.expect(classes, first[some], lengths[some], onward[some], model)
        sums[0], sums[1], sums[2], sums[4] = sums[0] + s, sums[1] + o, sums[2] + a, sums[4] + log
        for k in range(states):
            sums[3][k] += np.bincount(seen, gamma[:, k], kinds)
    for x, y in zip(sums, (start, follow, moves, emits, likely), strict=True):
        assert np.allclose(x, y)


def test_held_out_texts_score_better_than_words_alone(spark):
    got = QUERIES["op13_hidden_markov"](spark, "/root/testdata/sf0.01").toPandas()
    for _, some in got.groupby("held_out"):
        assert some["score"].sum() > some["base_score"].sum() + 0.2 * some["n_tokens"].sum()
        assert (some["score"] > some["base_score"]).mean() > 0.9


def test_registered_queries(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op11_merge_path", "op12_merkle_octopus", "op13_hidden_markov"):
        assert QUERIES[name](spark, SF).count() == n
    assert "op12_merkle_octopus" in ORACLES
