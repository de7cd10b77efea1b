"""The registered queries of the corpus operators and, where SQL can state their results, that SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import align, decontam, hmm, html_text, merkle, mixing, neardup, planes, quality, secrets, sharding, substrings, url_lists

POLICY = "corpus@2"
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark, sf_dir):
    book = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")), POLICY)
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       "kept", "fail_bits")


def op2_hash_tree(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.tree(), sharding.tree(extra=1))


def op3_url_lists(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_lists.filter_captures(url_lists.dated_captures(pages),
                                     url_lists.intervals(url_lists.list_events(pages)))


def op4_text_density(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_odd_sketches(spark, sf_dir):
    return neardup.link(table(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_bit_planes(spark, sf_dir):
    target = planes.new_target(spark)
    planes.write_ids(table(spark, sf_dir, "documents"), target, tokenizer_path())
    return planes.read_ids(spark, target, ids=False)


def op9_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken",
                                                                "source")


def op10_suffix_automata(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op11_merge_path(spark, sf_dir):
    return align.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                       tokenizer_path("piece_bpe_32k.model"))


def op12_merkle_octopus(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))[1]


def op13_hidden_markov(spark, sf_dir):
    return hmm.score_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_hash_tree, op3_url_lists, op4_text_density, op5_secret_scan, op6_odd_sketches,
    op7_decontamination, op8_bit_planes, op9_mixing, op10_suffix_automata, op11_merge_path,
    op12_merkle_octopus, op13_hidden_markov)}

_WORDS = r"'[^\x20\x09-\x0D]+'"


def _hash(*parts: str) -> str:
    joined = " || ':' || ".join(parts)
    return f"('0x' || substr(md5({joined}), 1, 8))::BIGINT"


def _quality_sql() -> str:
    bits = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(quality.RULES.values()))
    base, kept = (quality.mask(quality.POLICIES[p]) for p in ("base@1", POLICY))
    return rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
p AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM p) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM d, (VALUES (0), (1), (2)) v(k) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w JOIN l USING (r) LEFT JOIN c USING (r)),
b AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {base}) <> 0 AS base_failed,
       (fail_bits & {kept}) = 0 AS kept, fail_bits
FROM b"""


def _tree_rows(root: sharding.Node, name: str) -> str:
    rows = []
    for region in root.children:
        rows.append(("", region.name, region.weight, len(root.children), -1))
        for rack in region.children:
            rows.append((region.name, rack.name, rack.weight, len(region.children), -1))
            rows += [(rack.name, s.name, s.weight, len(rack.children), s.shard) for s in rack.children]
    return f"{name}(parent, name, weight, siblings, shard) AS (VALUES {', '.join(map(repr, rows))})"


def _descent(tree: str, out: str) -> str:
    cost = f"-ln(({_hash(repr(sharding.SEED), 'n.name', 'd.key')} + 0.5) / 4294967296.0) / n.weight"
    steps, before = [], "(SELECT r, key, '' AS at FROM k)"
    for level in range(3):
        steps.append(f"{out}{level} AS (SELECT r, key, arg_min(n.name, {cost}) AS at FROM {before} d "
                     f"JOIN {tree} n ON n.parent = d.at GROUP BY r, key)")
        before = f"{out}{level}"
    return ",\n".join(steps)


# The table of CRC-32, byte by byte.
_CRC_TABLE = """crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
          lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS tab
        FROM (SELECT unnest(range(256)) AS i))"""


def _sharding_sql() -> str:
    seed = repr(sharding.SEED)
    return f"""
WITH {_tree_rows(sharding.tree(), 't')}, {_tree_rows(sharding.tree(extra=1), 'g')},
k AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, coalesce(text, '') AS text
      FROM documents),
{_descent('t', 's')},
{_descent('g', 'w')},
{_CRC_TABLE},
h AS (SELECT r, hex(encode(text)) AS hex FROM k),
c AS (SELECT r, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(hex) // 2),
          lambda i: ('0x' || substr(hex, 2 * i + 1, 2))::BIGINT)),
          lambda x, y: xor(tab[(xor(x, y) & 255) + 1], x >> 8)), 4294967295) AS crc FROM h, crc),
a AS (SELECT k.doc_id, (octet_length(encode(k.text)) + 16)::BIGINT AS size, c.crc AS text_crc32, t.shard::INTEGER AS shard,
             g.shard::INTEGER AS grown_shard, {_hash(seed, "'slot'", 'k.key')} AS h
      FROM k JOIN c USING (r) JOIN s2 USING (r) JOIN t ON t.name = s2.at AND t.shard >= 0
      JOIN w2 USING (r) JOIN g ON g.name = w2.at AND g.shard >= 0)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY h, doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM a"""


def _urls_sql() -> str:
    host = (r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), "
            r"'\.$', '')")
    path = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1)"
    return f"""
WITH c AS (SELECT page_id, url, DATE '{url_lists.FIRST_DAY}' + ({_hash("'fetched'", 'page_id::VARCHAR')} % 366)::INTEGER AS fetched,
                  {host} AS h, list_filter(string_split({path}, '/'), lambda x: x <> '') AS p FROM pages),
n AS (SELECT DISTINCT u.* FROM (SELECT unnest([
          {{'list': 'malware', 'kind': 'host', 'pattern': h, 'every': 3}},
          {{'list': 'adult', 'kind': 'domain', 'pattern': array_to_string(string_split(h, '.')[greatest(1, len(string_split(h, '.')) - 1):], '.'), 'every': 5}},
          {{'list': 'spam', 'kind': 'prefix', 'pattern': h || '/' || p[1], 'every': 4}}]) AS u FROM c WHERE h <> '')
      WHERE u.pattern IS NOT NULL),
e AS (SELECT *, {_hash('list', 'kind', 'pattern')} AS x FROM n),
f AS (SELECT list, kind, pattern, DATE '{url_lists.FIRST_DAY}' + (x // 60 % 250)::INTEGER AS a,
             (x // 15000 % 90 + 5)::INTEGER AS len, (x // 1350000 % 40 + 1)::INTEGER AS pause FROM e WHERE x % every = 0),
v AS (SELECT list, kind, pattern, a AS valid_from, a + len AS valid_to FROM f
      UNION ALL SELECT list, kind, pattern, a + len + pause, NULL FROM f),
m AS (SELECT c.page_id, v.* FROM c JOIN v ON c.fetched >= v.valid_from AND (v.valid_to IS NULL OR c.fetched < v.valid_to)
        AND CASE v.kind WHEN 'host' THEN c.h = v.pattern
              WHEN 'domain' THEN c.h = v.pattern OR ends_with(c.h, '.' || v.pattern)
              ELSE starts_with(c.h || '/' || array_to_string(c.p, '/') || '/', v.pattern || '/') END
      WHERE c.h <> ''),
g AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
             min({{'l': list, 'k': kind, 'p': pattern, 'f': valid_from, 't': valid_to}}) AS x FROM m GROUP BY page_id)
SELECT c.url, c.fetched, c.page_id, coalesce(g.n, 0) AS n_active, g.lists, x.l || ':' || x.k || ':' || x.p AS entry,
       x.f AS valid_from, x.t AS valid_to, g.n IS NOT NULL AS blocked
FROM c LEFT JOIN g USING (page_id)"""


def _neardup_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), {_WORDS}) AS w
      FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (
        SELECT doc_id, w, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) WHEN len(w) > 0 THEN [1]
                                 ELSE []::BIGINT[] END) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * p.n >= 75 * (x.n + y.n - p.n)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)"""


def _mixing_sql() -> str:
    w = mixing.WEIGHTS
    return rf"""
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::BIGINT AS size FROM documents),
k AS (SELECT *, floor(-ln(({_hash(repr(mixing.SEED), "coalesce(doc_id::VARCHAR, 'null')")} + 0.5) / 4294967296.0)
              / greatest(0.1, 1.0::DOUBLE - coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0)::DOUBLE / greatest(size, 1)::DOUBLE) * 4294967296.0)::BIGINT AS key
      FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size) * {mixing.CAP} AS cap FROM k GROUP BY source),
g AS (SELECT *, [{', '.join(map(str, w))}][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(w)} + 1)::INTEGER]::DOUBLE AS w FROM s),
o AS (SELECT *, sum(source_size) OVER () * {mixing.SHARE} - coalesce(sum(cap) OVER before, 0) AS rest,
             sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open FROM g
      WINDOW before AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT rest / open AS level FROM o WHERE rest * w < cap * open ORDER BY cap / w, source IS NULL, source LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM v) * w, cap))::DOUBLE AS target FROM o),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
x AS (SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
             sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size > 0 THEN epochs + (middle <= budget)::BIGINT ELSE 0 END * size)::BIGINT AS taken, source
FROM x"""


def _substrings_sql() -> str:
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM p) WHERE first < doc_id),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM h, (SELECT unnest(range(50)) AS k)),
x AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
y AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
z AS (SELECT y.doc_id, string_agg(word, ' ' ORDER BY y.i) AS kept FROM y LEFT JOIN c ON c.doc_id = y.doc_id AND c.i = y.i
      WHERE c.i IS NULL GROUP BY y.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(x.gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(z.kept, '')) AS kept_sha256
FROM w LEFT JOIN x USING (doc_id) LEFT JOIN z USING (doc_id)"""


def _merkle_sql(depth: int = 6) -> str:
    """``depth`` levels within sources and above them, enough for 16 ** depth leaves a source."""
    def field(c):
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"

    def leaf(text):
        return f"sha256({' || '.join(field(text if c == 'text' else c) for c in merkle.FIELDS)})"

    def levels(name):
        """Nodes with what stands before and after them in their group (w), and each leaf's way up (x)."""
        steps = []
        for k in range(depth):
            side = "string_agg(h, '') OVER (PARTITION BY k, i // 16 ORDER BY i ROWS BETWEEN"
            steps += [
                f"{name}w{k} AS (SELECT *, coalesce({side} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, "
                f"coalesce({side} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}n{k})",
                f"{name}n{k + 1} AS (SELECT k, i // 16 AS i, CASE WHEN n = 1 THEN 1 ELSE (n + 15) // 16 END AS n, "
                f"CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h "
                f"FROM {name}n{k} GROUP BY k, i // 16, n)",
                f"{name}x{k + 1} AS (SELECT r, x.k, x.i // 16 AS i, CASE WHEN n = 1 THEN v ELSE sha256(b || v || a) "
                f"END AS v, CASE WHEN n = 1 THEN p ELSE p || b || a END AS p "
                f"FROM {name}x{k} x JOIN {name}w{k} w ON w.k = x.k AND w.i = x.i)"]
        return ",\n".join(steps)

    return f"""
WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, *, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS k,
             hex(encode(doc_id::VARCHAR)) AS hex FROM documents),
c AS (SELECT r, k, doc_id, {leaf("text")} AS leaf,
             {leaf(f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')")} AS low,
             xor(list_reduce(list_prepend(4294967295, list_transform(range(length(hex) // 2),
                 lambda i: ('0x' || substr(hex, 2 * i + 1, 2))::BIGINT)),
                 lambda x, y: xor(tab[(xor(x, y) & 255) + 1], x >> 8)), 4294967295) AS crc FROM d, crc),
e AS (SELECT r, k, doc_id, leaf, CASE WHEN crc % 5 = 0 THEN low ELSE leaf END AS bent,
             row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
             count(*) OVER (PARTITION BY k) AS n FROM c),
n0 AS (SELECT k, i, n, leaf AS h FROM e), x0 AS (SELECT r, k, i, bent AS v, '' AS p FROM e),
{levels("")},
s AS (SELECT k AS source, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n, h FROM n{depth}),
tn0 AS (SELECT '' AS k, i, n, h FROM s),
tx0 AS (SELECT r, '' AS k, s.i, v, p FROM x{depth} x JOIN s ON s.source = x.k),
{levels("t")}
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(x.p) AS proof_sha256, x.v AS folded_root, x.v = t.h AS verified
FROM e JOIN tx{depth} x USING (r) JOIN s ON s.source = e.k JOIN tn{depth} t ON true"""


ORACLES = {"op1_quality_rules": _quality_sql(), "op2_hash_tree": _sharding_sql(), "op3_url_lists": _urls_sql(),
           "op6_odd_sketches": _neardup_sql(), "op9_mixing": _mixing_sql(), "op10_suffix_automata": _substrings_sql(),
           "op12_merkle_octopus": _merkle_sql()}
