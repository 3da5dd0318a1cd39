"""The registered queries opN_<name> over the whole test tables, and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, automaton_dedup, conversation_trie, html_main, licenses, mixing, near_dup, packing, quality, sharding, suffix_dedup, token_file, vector_codes
from .common import new_path, table

VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op2_token_file(spark, sf_dir):
    path = new_path(spark, "tokens")
    token_file.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary())
    return token_file.read_tokens(spark, path)


def op3_html_main(spark, sf_dir):
    return html_main.extract(table(spark, sf_dir, "pages"))


def op4_near_dup(spark, sf_dir):
    return near_dup.linked(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_sharding(spark, sf_dir):
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op6_nearest(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 50 = 0"), k=5)


def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.removed(table(spark, sf_dir, "documents"), rewrite=False).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_quality(spark, sf_dir):
    return quality.assess(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_mixing(spark, sf_dir):
    found = mixing.copies(table(spark, sf_dir, "documents"))
    return found.selectExpr("row.doc_id", "size", "source_size", "target", "size * copies AS taken")


def op10_licenses(spark, sf_dir):
    return licenses.labelled(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark, sf_dir):
    turns = conversation_trie.turns_of(table(spark, sf_dir, "conversations"))
    return conversation_trie.trie(conversation_trie.spliced(turns))


def op12_vector_codes(spark, sf_dir):
    return vector_codes.coded(table(spark, sf_dir, "embeddings")).select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def op13_automaton_dedup(spark, sf_dir):
    return automaton_dedup.removed(table(spark, sf_dir, "documents"), rewrite=False).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_token_file, op3_html_main, op4_near_dup, op5_sharding, op6_nearest, op7_suffix_dedup, op8_quality, op9_mixing, op10_licenses, op11_conversation_trie, op12_vector_codes, op13_automaton_dedup)
}


def _quality_sql() -> str:
    m = quality.MARGIN
    bins = {
        "symbols": ("n_symbols", "word_chars"),
        "dup_lines": ("n_dup_lines", "n_lines"),
        "repeats": ("n_repeat_words", "n_words"),
        "long_words": ("word_chars", "n_words * 20"),
    }
    binned = ", ".join(f"CASE WHEN {b} > 0 THEN least({a} * 1000 // ({b}), {quality.GRID}) ELSE 0 END AS {k}" for k, (a, b) in bins.items())
    long = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {k} AS bin FROM f" for k in bins)
    quant = lambda g: f"SELECT {g} metric, count(*) AS docs, quantile_disc(bin, 0.5) + {quality.SPREAD} * (quantile_disc(bin, 0.75) - quantile_disc(bin, 0.25)) AS lim FROM long GROUP BY ALL"
    above = " OR ".join(f"f.{k} > (SELECT lim + {m[k]} FROM chosen c WHERE c.metric = '{k}' AND c.lang IS NOT DISTINCT FROM f.lang AND c.source IS NOT DISTINCT FROM f.source)" for k in bins)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS p, w FROM w WHERE len(w) >= 3),
h AS (SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS k FROM g),
dup AS (SELECT r, p FROM h QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM dup) GROUP BY r),
base AS (SELECT d.r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, {binned} FROM base),
long AS ({long}),
own AS ({quant('lang, source,')}), bylang AS ({quant('lang,')}), whole AS ({quant('')}),
chosen AS (SELECT own.lang, own.source, own.metric, (own.docs * own.lim + {quality.PRIOR} * ((bylang.docs * bylang.lim + {quality.PRIOR} * whole.lim)::DOUBLE / (bylang.docs + {quality.PRIOR}))) / (own.docs + {quality.PRIOR}) AS lim
  FROM own JOIN bylang ON own.lang IS NOT DISTINCT FROM bylang.lang AND own.metric = bylang.metric JOIN whole ON own.metric = whole.metric),
j AS (SELECT *, n_words < {quality.MIN_WORDS} OR n_repeat_words * 100 > n_words * 50 AS base_failed, {above} AS above FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT above AS kept FROM j"""


def mixing_sql(select: str) -> str:
    """The mix over table documents; ``select`` picks from m (all columns, size, source_size, target, n)."""
    w = ", ".join(f"{x}::DOUBLE" for x in mixing.WEIGHTS)
    return f"""
WITH s AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
q AS (SELECT *, [{w}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS w, source_size * {mixing.MOST}::DOUBLE AS cap FROM p),
v AS (SELECT *, (sum(source_size) OVER () * {mixing.SHARE}::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q),
t AS (SELECT source, source_size, coalesce(least(cap, max(level) FILTER (level * w < cap) OVER () * w), cap) AS target FROM v),
r AS (SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || ':7'), 1, 13))::BIGINT / {2**mixing.DRAW_BITS}::DOUBLE AS draw
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
m AS (SELECT *, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS n FROM r)
{select}"""


def _licenses_sql() -> str:
    show = lambda x: "NULL" if x is None else str(int(x)) if isinstance(x, int) else f"'{x}'"
    grams = ", ".join(f"({', '.join(map(show, row))})" for row in licenses.template_grams())
    return f"""
WITH tp(w1, w2, w3, w4, template, label, phrase, place, grams, shift) AS (VALUES {grams}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT r, unnest(range(1, len(w))) AS p, w FROM d WHERE len(w) > 1),
h AS (SELECT r, p - 1 AS pos, tp.* FROM g JOIN tp ON w[p] = w1 AND w[p + 1] = w2 AND (w3 IS NULL OR w[p + 2] = w3 AND w[p + 3] = w4)),
v AS (SELECT DISTINCT r, template, label, phrase, grams, shift, pos - place AS diagonal, place FROM h),
a AS (SELECT r, template, label, phrase, grams, shift, diagonal, diagonal + min(place) AS first_word FROM v GROUP BY r, template, label, phrase, grams, shift, diagonal),
e AS (SELECT a.r, a.label, a.phrase, a.first_word, count(DISTINCT v.place) / any_value(a.grams) AS score FROM a JOIN v ON a.r = v.r AND a.template = v.template AND v.diagonal BETWEEN a.diagonal AND a.diagonal + a.shift GROUP BY a.r, a.template, a.label, a.phrase, a.diagonal, a.first_word),
k AS (SELECT * FROM e WHERE CASE WHEN phrase = 1 THEN score = 1 ELSE score >= {licenses.LEAST_SCORE} END),
s AS (SELECT r, count(*) FILTER (phrase = 1) AS n_base, min(first_word) FILTER (phrase = 1) AS first_word, max(first_word) FILTER (phrase = 1) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase = 1) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM k GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN s USING (r)"""


_NEAR_DUP = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[p:p + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id"""


_NEAREST = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.e, c.e) / (q.n * c.n)) AS score FROM u q JOIN u c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id GROUP BY q.vec_id, c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""


_SUFFIX = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, doc_id, c, substr(h, 1024 * c + 1, 1122) AS h FROM (SELECT r, doc_id, h, unnest(range((length(h) + 1023) // 1024)) AS c FROM d)),
b AS (SELECT r, doc_id, 512 * c + j AS i, substr(h, 2 * j + 1, 2) AS x, CASE WHEN 2 * j + 100 <= length(h) THEN substr(h, 2 * j + 1, 100) END AS k FROM (SELECT r, doc_id, c, h, unnest(range(least(512, length(h) // 2))) AS j FROM p)),
m AS (SELECT k, min(doc_id) AS f FROM b WHERE k IS NOT NULL GROUP BY k),
s AS (SELECT r, i, x, f < doc_id AS hit FROM b LEFT JOIN m USING (k)),
c AS (SELECT r, i, x, coalesce(i - max(CASE WHEN hit THEN i END) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) < 50, FALSE) AS gone FROM s),
e AS (SELECT r, i, x, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), FALSE) AS begins FROM c),
t AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM e GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN t USING (r)"""


_TRIE = """
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(struct_pack(k := k, b := strlen(text)) ORDER BY turn NULLS FIRST, k) AS l FROM t GROUP BY conv_id),
x AS (SELECT o.conv_id, o.l, coalesce(h.l, []) AS lead, {crc} % 9 AS h FROM o LEFT JOIN o h ON h.conv_id = o.conv_id - o.conv_id % 5),
c AS (SELECT conv_id, list_concat(lead[1:h], l[h + 1:]) AS l FROM x),
p AS (SELECT conv_id, d, len(l) AS n, md5(array_to_string(list_transform(l[1:d], lambda e: e.k), ',')) AS k, CASE WHEN d > 0 THEN md5(array_to_string(list_transform(l[1:d - 1], lambda e: e.k), ',')) END AS up, CASE WHEN d > 0 THEN l[d].b ELSE 0 END AS b
  FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM c)),
n AS (SELECT d, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM p GROUP BY d, k),
m AS (SELECT n.*, (SELECT count(*) FROM n y WHERE y.d = n.d + 1 AND y.up = n.k) AS n_children FROM n),
a AS (SELECT m.n_children, (m.n_convs - 1) * m.b AS own, p.d, p.k FROM m JOIN p ON p.conv_id = m.conv_id AND p.d <= m.d),
s AS (SELECT d, k, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved FROM a GROUP BY d, k)
SELECT m.conv_id::BIGINT AS conv_id, m.d::BIGINT AS depth, u.conv_id::BIGINT AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s USING (d, k) LEFT JOIN n u ON u.d = m.d - 1 AND u.k = m.up"""


#: CRC-32 of decimal conv_id, bit by bit.
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, strlen(o.conv_id::VARCHAR) + 1), lambda i: ascii(substr(o.conv_id::VARCHAR, i, 1))::BIGINT)),
  lambda a, c: list_reduce(list_concat([xor(a, c)], range(8)), lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)), 4294967295)"""


def _codes_sql() -> str:
    """Every assignment in full: each part against all entries of its book."""
    scale, parts, entries = vector_codes.SCALE, vector_codes.PARTS, vector_codes.ENTRIES
    floored = "((s - ((s % n) + n) % n) // n)"
    assign = lambda r: f"""a{r} AS MATERIALIZED (SELECT x.r, x.p, x.v, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b{r} b USING (p)
  QUALIFY row_number() OVER (PARTITION BY x.r, x.p ORDER BY d, b.e) = 1)"""  # noqa: E731
    move = lambda r: f"""m{r} AS (SELECT p, e, i, sum(v[i])::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS i FROM a{r}) GROUP BY p, e, i),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(c.v, b.v) AS v FROM b{r} b LEFT JOIN (SELECT p, e, list({floored} ORDER BY i) AS v FROM m{r} GROUP BY p, e) c USING (p, e))"""  # noqa: E731
    rounds = ",\n".join(f"{assign(r)},\n{move(r)}" for r in range(vector_codes.ROUNDS))
    last = vector_codes.ROUNDS
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS v FROM (SELECT r, v, unnest(range({parts})) AS p FROM k)),
b0 AS MATERIALIZED (SELECT p, r AS e, v FROM x WHERE r < {entries}),
{rounds},
{assign(last)},
c AS (SELECT r, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY r),
h AS (SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(v, ',') AS t FROM b{last}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c USING (r), h"""


_WINDOWS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, p, array_to_string(w[p:p + 49], ' ') AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
f AS (SELECT k, min(doc_id) AS f FROM g GROUP BY k),
c AS (SELECT DISTINCT r, q FROM (SELECT r, unnest(range(p, p + 50)) AS q FROM g JOIN f USING (k) WHERE f < doc_id)),
e AS (SELECT r, list(q) AS gone FROM c GROUP BY r),
k AS (SELECT d.r, string_agg(w[p], ' ' ORDER BY p) AS kept FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d) d LEFT JOIN c ON c.r = d.r AND c.q = d.p WHERE c.q IS NULL GROUP BY d.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN e USING (r) LEFT JOIN k USING (r)"""


ORACLES = {
    "op11_conversation_trie": _TRIE.replace("{crc}", _CRC32),
    "op12_vector_codes": _codes_sql(),
    "op13_automaton_dedup": _WINDOWS,
    "op7_suffix_dedup": _SUFFIX,
    "op6_nearest": _NEAREST,
    "op4_near_dup": _NEAR_DUP,
    "op8_quality": _quality_sql(),
    "op9_mixing": mixing_sql("SELECT doc_id, size, source_size, target::DOUBLE AS target, size * n AS taken FROM m"),
    "op10_licenses": _licenses_sql(),
}
