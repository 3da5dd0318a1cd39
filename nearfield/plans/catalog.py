"""The registered queries over table embeddings, and the DuckDB SQL that states their answers.

Queries are rows whose id is divisible by 10; distances are squared L2 unless said otherwise. Inputs
that the reference takes from a random generator are given by formula here, so that SQL can follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import vectors as V
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import search as S
from ..operators import traces as T
from ..operators.exact import knn, top_rows
from ..operators.near_graph import near_graph
from ..sources import layout
from ..sources.tables import base, queries, written

K = 10
DEGREE = 16
CODE_BYTES = 32
RERANK_POOL = 50
PACKED = 800
ENTRY = 0
HOPS = 64
#: Answers are given to six decimals.
DIGITS = 6

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, DIGITS) for n in names})


def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = base(spark, sf_dir)
    return rows, queries(rows)


def graph(rows: DataFrame, degree: int = DEGREE) -> DataFrame:
    return written(G.knn_graph(rows, degree), "graph")


def exact(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    rows, asked = load(spark, sf_dir)
    return knn(rows, asked, k)


# Pieces of SQL that several statements share.
L2 = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
BASE = "base AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def knn_sql(k: int, score: str = L2.format("q.v", "b.v"), extra: str = "TRUE") -> str:
    return f"SELECT q.id AS qid, row_number() OVER w AS rank, b.id, {score} AS dist FROM base q JOIN base b ON q.id % 10 = 0 AND {extra} WINDOW w AS (PARTITION BY q.id ORDER BY {score}, b.id) QUALIFY row_number() OVER w <= {k}"


def graph_sql(degree: int = DEGREE) -> str:
    d = L2.format("a.v", "b.v")
    return f"edges AS (SELECT a.id AS src, row_number() OVER w AS pos, b.id AS dst, {d} AS dist FROM base a JOIN base b ON a.id <> b.id WINDOW w AS (PARTITION BY a.id ORDER BY {d}, b.id) QUALIFY row_number() OVER w <= {degree})"


EXACT = f"WITH {BASE}, gt AS ({knn_sql(K)})"
GRAPH = f"WITH {BASE}, {graph_sql()}"
GRAPH8 = f"WITH {BASE}, {graph_sql(8)}"
CODES = f"codes AS (SELECT id, list_transform(range(1, {CODE_BYTES + 1}), lambda i: least(greatest(round((coalesce(v[i], 0) * 0.5 + 0.5) * 255.0), 0), 255)::BIGINT) AS code FROM base)"
CODE_D = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"


# --- exact search -------------------------------------------------------------------------------------


@query(f"WITH {BASE} SELECT qid, rank::INT AS rank, id, round(dist, 6) AS dist FROM ({knn_sql(K)})")
def exact_knn_l2(spark, sf_dir):
    return rounded(exact(spark, sf_dir), "dist")


@query(f"WITH {BASE} SELECT qid, rank::INT AS rank, id, round(dist, 6) AS dist FROM ({knn_sql(K, '0.0 - list_inner_product(q.v, b.v)')})")
def exact_knn_mips(spark, sf_dir):
    rows, asked = load(spark, sf_dir)
    return rounded(knn(rows, asked, K, "mips"), "dist")


@query(f"WITH {BASE} SELECT qid, rank::INT AS rank, id, round(dist, 6) AS dist FROM ({knn_sql(K, '0.0 - list_inner_product(q.v, b.v) / (sqrt(list_inner_product(b.v, b.v)) * sqrt(list_inner_product(q.v, q.v)))')})")
def exact_knn_cosine(spark, sf_dir):
    rows, asked = load(spark, sf_dir)
    return rounded(knn(rows, asked, K, "cosine"), "dist")


@query(f"WITH {BASE} SELECT qid, rank::INT AS rank, id, round(dist, 6) AS dist FROM ({knn_sql(K, extra='q.label = b.label')})")
def exact_knn_label_filtered(spark, sf_dir):
    """Only rows with the query's own label."""
    rows, asked = load(spark, sf_dir)
    asked = asked.join(rows.select(F.col("id").alias("qid"), "label"), "qid")
    return rounded(knn(rows, asked, K, match="label"), "dist")


@query(f"WITH {BASE}, gt AS ({knn_sql(50)}) SELECT qid, rank::INT AS rank, id FROM gt WHERE qid < 200 AND rank <= 5")
def truth_cut(spark, sf_dir):
    """The truth of the first 20 queries, cut from 50 neighbours to 5."""
    return exact(spark, sf_dir, 50).where("qid < 200 and rank <= 5").select("qid", "rank", "id")


# --- scalar functions ---------------------------------------------------------------------------------


@query(f"WITH {BASE} SELECT id, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM base")
def vector_norms(spark, sf_dir):
    return base(spark, sf_dir).select("id", F.round(V.norm(F.col("vec")), DIGITS).alias("norm"))


@query(f"WITH {BASE}, n AS (SELECT id, v, greatest(sqrt(list_inner_product(v, v)), 1e-12) AS n FROM base) SELECT id, round(list_sum(list_transform(list_zip(v, range(1, len(v) + 1)), lambda z: z[1] / n * z[2])), 6) AS checksum FROM n")
def normalized_vectors(spark, sf_dir):
    weighted = F.transform(V.normalized(F.col("vec")), lambda x, i: x * (i + 1))
    return base(spark, sf_dir).select("id", F.round(F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x), DIGITS).alias("checksum"))


@query(f"WITH {BASE}, {CODES} SELECT id, list_sum(code)::BIGINT AS total, list_sum(list_transform(list_zip(code, range(1, {CODE_BYTES + 1})), lambda z: z[1] * z[2]))::BIGINT AS checksum FROM codes")
def sq_encode(spark, sf_dir):
    coded = base(spark, sf_dir).select("id", V.quantized(F.col("vec"), CODE_BYTES).alias("code"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return coded.select("id", total(F.transform("code", lambda x: x.cast("long"))).alias("total"), total(F.transform("code", lambda x, i: x.cast("long") * (i + 1))).alias("checksum"))


@query("SELECT b AS bits, round(CASE WHEN b % 32768 < 1024 THEN 0.0 ELSE (CASE WHEN b >= 32768 THEN -1.0 ELSE 1.0 END) * pow(2.0, (b % 32768) // 1024 - 15) * (1.0 + (b % 1024) / 1024.0) END, 6) AS value FROM (SELECT DISTINCT (vec_id * 131) % 31744 + 32768 * (vec_id % 2) AS b FROM embeddings)")
def half_floats(spark, sf_dir):
    """Finite half-precision bit patterns given by formula."""
    bits = base(spark, sf_dir).select(((F.col("id") * 131) % 31744 + F.lit(32768) * (F.col("id") % 2)).cast("int").alias("b")).distinct()
    return bits.select(F.col("b").cast("long").alias("bits"), F.round(V.from_half(F.col("b")) + 0.0, DIGITS).alias("value"))


@query("WITH t AS (SELECT vec_id AS id, vec_id * 37 % 6000 AS len FROM embeddings) SELECT id, len::BIGINT AS len, (greatest(CASE WHEN l <= 4096 AND l > 2048 THEN 2 ELSE (l + 4095) // 4096 END, 1) * 4096)::BIGINT AS charge FROM (SELECT *, CASE WHEN len = 0 THEN 4096 ELSE len END AS l FROM t)")
def page_charge(spark, sf_dir):
    lengths = base(spark, sf_dir).select("id", (F.col("id") * 37 % 6000).alias("len"))
    return lengths.withColumn("charge", P.page_charge(F.col("len")).cast("long"))


@query(f"SELECT vec_id AS id, vec_id * {PACKED} // 4096 AS page_first, (vec_id * {PACKED} + {PACKED - 1}) // 4096 AS page_last FROM embeddings")
def page_spans(spark, sf_dir):
    first, last = P.page_span(F.col("id"), PACKED, PACKED)
    return base(spark, sf_dir).select("id", first.alias("page_first"), last.alias("page_last"))


@query(f"WITH {BASE}, p AS (SELECT id, (id * {PACKED} // 4096) AS f, ((id * {PACKED} + {PACKED - 1}) // 4096) AS l, v FROM base WHERE id % 10 = 0) SELECT id AS qid, round(v[1], 6) AS head, (l - f + 1) * 4096 AS aligned_bytes, len(v)::BIGINT * 4 AS buffered_bytes FROM p")
def point_fetch_bytes(spark, sf_dir):
    """The queries' rows fetched by id, and the bytes that takes by whole pages or by record."""
    rows, asked = load(spark, sf_dir)
    first, last = P.page_span(F.col("qid"), PACKED, PACKED)
    got = asked.select("qid").join(rows.select(F.col("id").alias("qid"), "vec"), "qid")
    return got.select("qid", F.round(F.get("vec", F.lit(0)).cast("double"), DIGITS).alias("head"), ((last - first + 1) * P.PAGE).alias("aligned_bytes"), (F.size("vec").cast("long") * 4).alias("buffered_bytes"))


@query(f"SELECT vec_id AS id, 4096 + vec_id * {CODE_BYTES} AS code_at, 8192 + vec_id * {DEGREE * 4} AS neighbours_at, 65536 + vec_id * greatest(CASE WHEN 262144 // (SELECT count(*) FROM embeddings) >= {PACKED} THEN 262144 // (SELECT count(*) FROM embeddings) ELSE {PACKED} END, 0) AS vector_at FROM embeddings")
def section_addresses(spark, sf_dir):
    """Where a record's code, neighbours and vector lie in sections given by formula; the stride is the section's share or the packed size."""
    rows = base(spark, sf_dir).select("id")
    stride = rows.agg(P.stride_of(F.lit(262144), F.count(F.lit(1)), F.lit(PACKED)).alias("stride"))
    spread = rows.withColumn("one", F.lit(1)).join(F.broadcast(stride.withColumn("one", F.lit(1))), "one")
    return spread.select("id", (F.col("id") * CODE_BYTES + 4096).alias("code_at"), (F.col("id") * (DEGREE * 4) + 8192).alias("neighbours_at"), (F.col("id") * F.col("stride") + 65536).alias("vector_at"))


@query("SELECT vec_id AS id, vec_id AS page_first, vec_id AS page_last FROM embeddings")
def page_aligned_spans(spark, sf_dir):
    """Records that each start on a page of their own."""
    first, last = P.page_span(F.col("id"), P.PAGE, PACKED)
    return base(spark, sf_dir).select("id", first.alias("page_first"), last.alias("page_last"))


@query(f"SELECT page, count(*) AS n_ids, min(id) AS min_id, max(id) AS max_id FROM (SELECT vec_id AS id, unnest(range(vec_id * {PACKED} // 4096, (vec_id * {PACKED} + {PACKED - 1}) // 4096 + 1)) AS page FROM embeddings) GROUP BY page")
def ids_on_page(spark, sf_dir):
    first, last = P.page_span(F.col("id"), PACKED, PACKED)
    touched = base(spark, sf_dir).select("id", F.explode(F.sequence(first, last)).alias("page"))
    return touched.groupBy("page").agg(F.count(F.lit(1)).alias("n_ids"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))


_ALIGN = lambda x: f"(({x}) + 4095) // 4096 * 4096"


@query(f"""
WITH m AS (SELECT count(*) AS n, max(len(embedding))::BIGINT AS dim FROM embeddings),
a AS (SELECT *, {_ALIGN('160')} AS off_codes FROM m),
b AS (SELECT *, {_ALIGN(f'off_codes + n * {CODE_BYTES}')} AS off_graph FROM a),
c AS (SELECT *, {_ALIGN(f'off_graph + n * {DEGREE} * 4')} AS off_vectors FROM b),
d AS (SELECT *, {_ALIGN('off_vectors + n * dim * 4')} AS off_pivots FROM c)
SELECT n, dim, off_codes, off_graph, off_vectors, off_pivots, {_ALIGN('off_pivots + 65536')} AS bytes, xor(xor(xor(n, dim), {DEGREE}), n * dim * 4) AS checksum FROM d""")
def layout_offsets(spark, sf_dir):
    """Where the sections of a laid-out index start, for a header of 160 bytes."""
    return layout.header(base(spark, sf_dir), DEGREE, CODE_BYTES)


@query("""
WITH t AS (SELECT vec_id AS id, vec_id * 977 % 700000 AS logical FROM embeddings),
s AS (SELECT *, logical // 4096 AS n, logical % 4096 AS w, logical // 4096 * 40 // 160 AS before, (logical // 4096 + 1) * 40 // 160 AS after FROM t)
SELECT id, logical, (CASE WHEN logical >= 655360 THEN 1 WHEN after <> before THEN 0 ELSE 1 END)::INT AS tier,
  (CASE WHEN logical >= 655360 THEN 120 * 4096 + logical - 655360 WHEN after <> before THEN before * 4096 + w ELSE (n - before) * 4096 + w END)::BIGINT AS tier_offset,
  (CASE WHEN logical >= 655360 THEN 700000 - logical ELSE 4096 - w END)::BIGINT AS contiguous FROM s""")
def stripe_map(spark, sf_dir):
    """160 stripes of 4 KiB, 40 of them in the fast tier, and a slow tail up to 700,000 bytes."""
    at = base(spark, sf_dir).select("id", (F.col("id") * 977 % 700000).alias("logical"))
    place = P.stripe_place(F.col("logical"), 4096, 40, 160, 700000)
    return at.select("id", "logical", place["tier"].cast("int").alias("tier"), place["tier_offset"].cast("long").alias("tier_offset"), place["contiguous"].cast("long").alias("contiguous"))


@query(f"{EXACT} SELECT qid, id, round(1.0 / (1.0 + greatest(dist, 0)) + CASE WHEN rank <= 4 THEN 1001.0 - rank ELSE 0 END, 6) AS weight, (CASE WHEN rank <= 4 THEN 64 ELSE 16 END)::INT AS rounds FROM gt")
def score_weights(spark, sf_dir):
    """Weights of a query's neighbours as candidates, the next four boosted, and how long their pages stay pinned."""
    weight = P.score_weight(F.col("dist"), F.col("rank") - 1, 4)
    return exact(spark, sf_dir).withColumn("w", weight).select("qid", "id", F.round("w", DIGITS).alias("weight"), P.pin_rounds(F.col("w")).alias("rounds"))


# --- coded search -------------------------------------------------------------------------------------


def coded(rows: DataFrame) -> DataFrame:
    return rows.select("id", V.quantized(F.col("vec"), CODE_BYTES).alias("code"))


def code_nearest(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    codes = coded(rows)
    of = asked.select("qid").join(codes, F.col("qid") == F.col("id")).select("qid", F.col("code").alias("qvec"))
    return knn(codes.select("id", F.col("code").alias("vec")), of, k).withColumn("dist", F.col("dist").cast("long"))


_CODE_KNN = f"WITH {BASE}, {CODES}, ck AS (SELECT q.id AS qid, row_number() OVER w AS rank, b.id, {CODE_D.format('q.code', 'b.code')} AS dist FROM codes q JOIN codes b ON q.id % 10 = 0 WINDOW w AS (PARTITION BY q.id ORDER BY {CODE_D.format('q.code', 'b.code')}, b.id) QUALIFY row_number() OVER w <= {{0}})"
_RERANK = _CODE_KNN.format(RERANK_POOL) + f", rr AS (SELECT qid, row_number() OVER w AS rank, ck.id, {L2.format('q.v', 'b.v')} AS dist FROM ck JOIN base q ON q.id = qid JOIN base b ON b.id = ck.id WINDOW w AS (PARTITION BY qid ORDER BY {L2.format('q.v', 'b.v')}, ck.id) QUALIFY row_number() OVER w <= {K})"


@query(_CODE_KNN.format(K) + " SELECT qid, rank::INT AS rank, id, dist FROM ck")
def code_knn(spark, sf_dir):
    return code_nearest(*load(spark, sf_dir), K)


def reranked(spark, sf_dir) -> DataFrame:
    rows, asked = load(spark, sf_dir)
    return S.reranked(code_nearest(rows, asked, RERANK_POOL).select("qid", "id"), rows, asked, K)


@query(_RERANK + " SELECT qid, rank::INT AS rank, id, round(dist, 6) AS dist FROM rr")
def code_knn_rerank(spark, sf_dir):
    return rounded(reranked(spark, sf_dir), "dist")


_RECALL = _RERANK + f", gt AS ({knn_sql(K)}), rec AS (SELECT g.qid, count(r.id) AS hits, count(r.id) / count(*) AS recall FROM gt g LEFT JOIN rr r ON g.qid = r.qid AND g.id = r.id GROUP BY g.qid)"


def code_recall(spark, sf_dir) -> DataFrame:
    return M.recall(reranked(spark, sf_dir), exact(spark, sf_dir), K)


@query(_RECALL + " SELECT qid, hits, round(recall, 6) AS recall FROM rec")
def recall_code_vs_exact(spark, sf_dir):
    return rounded(code_recall(spark, sf_dir), "recall")


@query(_RECALL + " SELECT label, count(*) AS n_queries, round(avg(recall), 6) AS recall FROM rec JOIN base ON id = qid GROUP BY label")
def recall_per_label(spark, sf_dir):
    labels = base(spark, sf_dir).select(F.col("id").alias("qid"), "label")
    return code_recall(spark, sf_dir).join(labels, "qid").groupBy("label").agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("recall"), DIGITS).alias("recall"))


@query(_RECALL + f" SELECT count(*) AS n_queries, round(avg(recall), 6) AS recall, round(avg(recall) * count(*) / (count(*) * {RERANK_POOL} / 1000.0), 6) AS recall_per_kio FROM rec")
def recall_per_kio(spark, sf_dir):
    """Recall over thousand full-precision reads, of which the rerank does a fixed number a query."""
    all_ = code_recall(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_queries"), F.avg("recall").alias("r"))
    return all_.select("n_queries", F.round("r", DIGITS).alias("recall"), F.round(F.col("r") * F.col("n_queries") / (F.col("n_queries") * RERANK_POOL / 1000.0), DIGITS).alias("recall_per_kio"))


@query(f"{EXACT} SELECT rank::INT AS rank, round(quantile_cont(dist, 0.5), 6) AS p50, round(quantile_cont(dist, 0.9), 6) AS p90, round(quantile_cont(dist, 0.99), 6) AS p99 FROM gt WHERE rank > 1 GROUP BY rank")
def distance_percentiles(spark, sf_dir):
    p = lambda x: F.round(F.percentile("dist", F.lit(x)), DIGITS)
    return exact(spark, sf_dir).where("rank > 1").groupBy("rank").agg(p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"))


# --- graphs -------------------------------------------------------------------------------------------


@query(f"{GRAPH} SELECT src, pos::INT AS pos, dst, round(dist, 6) AS dist FROM edges")
def knn_graph_edges(spark, sf_dir):
    return rounded(G.knn_graph(base(spark, sf_dir), DEGREE), "dist")


@query()  # approximate, so that SQL has no answer to hold it against; tests measure its recall
def approx_knn_graph(spark, sf_dir):
    return rounded(near_graph(base(spark, sf_dir), DEGREE), "dist")


_THIN = "CASE WHEN src % 11 = 0 THEN 0 WHEN src % 7 = 0 THEN 3 ELSE 12 END"


@query(f"{GRAPH}, t AS (SELECT id AS src, list(dst ORDER BY pos) FILTER (pos <= {_THIN}) AS n FROM base LEFT JOIN edges ON id = src GROUP BY id), p AS (SELECT src, unnest(range(1, 9)) AS pos, coalesce(n, []) AS n FROM t) SELECT src, pos::INT AS pos, CASE WHEN len(n) = 0 THEN src WHEN pos <= len(n) THEN n[pos] ELSE n[len(n)] END AS dst FROM p".replace("CASE WHEN src % 11 = 0 THEN 0 WHEN src % 7", "CASE WHEN id % 11 = 0 THEN 0 WHEN id % 7"))
def graph_padded(spark, sf_dir):
    """Rows of uneven degree, cut or padded to 8: none for ids divisible by 11, three for those divisible by 7."""
    rows = base(spark, sf_dir)
    keep = F.when(F.col("src") % 11 == 0, 0).when(F.col("src") % 7 == 0, 3).otherwise(12)
    thin = G.neighbours(G.knn_graph(rows, DEGREE).where(F.col("pos") <= keep))
    whole = rows.select(F.col("id").alias("src")).join(thin, "src", "left")
    return G.edges_of(whole.select("src", G.padded(F.coalesce("nbrs", F.array().cast("array<bigint>")), F.col("src"), 8).alias("nbrs")))


@query(f"WITH {BASE}, f AS (SELECT id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM base), m AS (SELECT i, avg(x) AS m FROM f GROUP BY i) SELECT id, round(sum((x - m) * (x - m)), 6) AS dist FROM f JOIN m USING (i) GROUP BY id ORDER BY round(sum((x - m) * (x - m)), 9), id LIMIT 1")
def medoid_entry(spark, sf_dir):
    return rounded(G.medoid(base(spark, sf_dir)), "dist")


@query(f"{GRAPH} SELECT row_number() OVER (ORDER BY count(*) DESC, dst)::INT AS rank, dst AS id, count(*) AS indegree FROM edges GROUP BY dst QUALIFY rank <= 20")
def indegree_hubs(spark, sf_dir):
    return G.hubs(graph(base(spark, sf_dir)), 20).select("rank", "id", "indegree")


_TWO_HOP = f"{GRAPH}, own AS (SELECT src AS qid, pos, dst AS via FROM edges WHERE src % 10 = 0), th AS (SELECT DISTINCT qid, dst AS id FROM own JOIN edges ON src = via WHERE own.pos <= 4 AND dst <> qid AND NOT EXISTS (SELECT 1 FROM own o WHERE o.qid = own.qid AND o.via = dst))"


@query(f"{_TWO_HOP} SELECT qid, id FROM th")
def two_hop_candidates(spark, sf_dir):
    rows, asked = load(spark, sf_dir)
    return G.two_hop(graph(rows), asked, 4)


@query(f"{_TWO_HOP}, p AS (SELECT qid, id // 4 AS page, count(*) AS cover FROM th GROUP BY ALL) SELECT qid, row_number() OVER w::INT AS rank, page, cover FROM p WINDOW w AS (PARTITION BY qid ORDER BY cover DESC, page) QUALIFY row_number() OVER w <= 8".replace("row_number() OVER w::INT", "(row_number() OVER w)::INT"))
def two_hop_prefetch_budget(spark, sf_dir):
    """The eight pages of four records that hold most of a query's two-hop candidates."""
    rows, asked = load(spark, sf_dir)
    return G.cover_ranked(G.two_hop(graph(rows), asked, 4), F.call_function("div", F.col("id"), F.lit(4)), 8)


def _bfs_sql(levels: int, degree: int = 8) -> str:
    sql = f"WITH {BASE}, {graph_sql(degree)}, o0 AS (SELECT {ENTRY}::BIGINT AS id, 0 AS level, 0::BIGINT AS ord)"
    for k in range(1, levels + 1):
        sql += f", n{k} AS (SELECT e.dst AS id, o.ord AS parent, e.pos FROM o{k - 1} o JOIN edges e ON e.src = o.id WHERE o.level = {k - 1} AND e.dst NOT IN (SELECT id FROM o{k - 1}) QUALIFY row_number() OVER (PARTITION BY e.dst ORDER BY o.ord, e.pos) = 1)"
        sql += f", o{k} AS (SELECT * FROM o{k - 1} UNION ALL SELECT id, {k}, row_number() OVER (ORDER BY parent, pos) - 1 + (SELECT count(*) FROM o{k - 1}) FROM n{k})"
    return sql


@query(_bfs_sql(4) + " SELECT id, level::INT AS level FROM o4")
def bfs_levels_h4(spark, sf_dir):
    return G.breadth_first(graph(base(spark, sf_dir), 8), ENTRY, levels=4).select("id", "level")


@query(_bfs_sql(3) + " SELECT id, ord FROM o3")
def bfs_order_h3(spark, sf_dir):
    return G.breadth_first(graph(base(spark, sf_dir), 8), ENTRY, levels=3).select("id", "ord")


@query(_bfs_sql(4) + " SELECT id, ord FROM o4 WHERE ord < 64")
def entry_subgraph(spark, sf_dir):
    """The first 64 nodes found breadth-first from the entry."""
    return G.breadth_first(graph(base(spark, sf_dir), 8), ENTRY, nodes=64).select("id", "ord")


@query(f"{_bfs_sql(4)}, f AS (SELECT id, ord FROM o4 WHERE ord < 64) SELECT id, 'neighbours' AS part, (SELECT count(*) * 4 FROM edges WHERE src = f.id)::BIGINT AS bytes FROM f UNION ALL SELECT id, 'vector' AS part, (len(v) * 4)::BIGINT AS bytes FROM f JOIN base USING (id) WHERE ord < 32")
def entry_pin_set(spark, sf_dir):
    """What is pinned of the first 64 nodes found from the entry: their neighbour lists, and the vectors of the first 32."""
    rows = base(spark, sf_dir)
    edges = graph(rows, 8)
    return G.entry_pins(G.breadth_first(edges, ENTRY, nodes=64), edges, rows, 32)


_STAR = f"WITH RECURSIVE {BASE}, {graph_sql(8)}, nb AS MATERIALIZED (SELECT src, list(dst ORDER BY pos) AS near FROM edges GROUP BY src), q AS (SELECT [{ENTRY}::BIGINT] AS queue, 1 AS head UNION ALL SELECT list_concat(queue, list_filter(coalesce(near, []), lambda x: NOT list_contains(queue, x))), head + 1 FROM q LEFT JOIN nb ON src = queue[head] WHERE head <= len(queue)), d AS (SELECT queue FROM q ORDER BY head DESC LIMIT 1), f AS (SELECT unnest(queue) AS old_id, unnest(range(len(queue))) AS new_id FROM d)"


@query(f"{_STAR} SELECT new_id, old_id FROM f UNION ALL SELECT (SELECT count(*) FROM f) + row_number() OVER (ORDER BY id) - 1 AS new_id, id AS old_id FROM base WHERE id NOT IN (SELECT old_id FROM f)")
def star_pack_map(spark, sf_dir):
    """The whole permutation: nodes in order of discovery from the entry, then the others ascending."""
    rows = base(spark, sf_dir)
    return G.permutation(G.breadth_first(graph(rows, 8), ENTRY), rows.select("id")).select("new_id", "old_id")


def by_norm_order(rows: DataFrame) -> DataFrame:
    """A permutation given by formula: ids in descending order of id * 7919 mod 10007."""
    from ..operators.ordering import numbered

    keyed = rows.select(F.col("id").alias("old_id"), (-(F.col("id") * 7919 % 10007)).alias("key"))
    return written(numbered(keyed, ["key", "old_id"], "new_id").select("new_id", "old_id"), "id-map")


_MAP = f"{GRAPH8}, im AS (SELECT id AS old_id, row_number() OVER (ORDER BY -(id * 7919 % 10007), id) - 1 AS new_id FROM base), be AS (SELECT e.*, a.new_id AS ns, b.new_id AS nd FROM edges e JOIN im a ON a.old_id = src JOIN im b ON b.old_id = dst)"


@query(f"{_MAP} SELECT ns AS src, pos::INT AS pos, nd AS dst FROM be")
def graph_remap(spark, sf_dir):
    rows = base(spark, sf_dir)
    return G.remapped(graph(rows, 8), by_norm_order(rows))


@query(f"{_MAP} SELECT im.new_id AS id, old_id, round(list_sum(v), 6) AS checksum FROM im JOIN base ON base.id = old_id")
def layout_order(spark, sf_dir):
    """Rows moved to their new places, written by range of them; the map is checked to be a permutation."""
    rows = base(spark, sf_dir)
    id_map = G.checked_map(by_norm_order(rows), rows.count())
    moved = G.laid_out(rows.withColumn("was", F.col("id")), id_map, 4)
    return moved.select("id", F.col("was").alias("old_id"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double")), DIGITS).alias("checksum"))


@query(f"{EXACT}, im AS (SELECT id AS old_id, row_number() OVER (ORDER BY -(id * 7919 % 10007), id) - 1 AS new_id FROM base) SELECT qid, rank::INT AS rank, old_id AS id FROM gt JOIN im ON new_id = gt.id")
def result_ids_translated(spark, sf_dir):
    """Result ids taken as new ids and given back as old ones."""
    rows = base(spark, sf_dir)
    return exact(spark, sf_dir).join(by_norm_order(rows), F.col("id") == F.col("new_id")).select("qid", "rank", F.col("old_id").alias("id"))


@query(f"{_MAP} SELECT count(*) AS n_edges, round(avg(abs(nd - ns)), 6) AS mean_new, round(avg(abs(dst - src)), 6) AS mean_old, round(avg((abs(nd - ns) <= 64)::INT), 6) AS within_64, round(avg((abs(nd - ns) <= 256)::INT), 6) AS within_256, round(avg((abs(nd - ns) <= 4096)::INT), 6) AS within_4096 FROM be WHERE ns % 64 = 0")
def edge_locality(spark, sf_dir):
    rows = base(spark, sf_dir)
    return rounded(G.edge_locality(graph(rows, 8), by_norm_order(rows)), "mean_new", "mean_old", "within_64", "within_256", "within_4096")


@query(ORACLES["edge_locality"].replace(" WHERE ns % 64 = 0", ""))
def edge_locality_whole(spark, sf_dir):
    """edge_locality over every edge."""
    rows = base(spark, sf_dir)
    return rounded(G.edge_locality(graph(rows, 8), by_norm_order(rows), 1), "mean_new", "mean_old", "within_64", "within_256", "within_4096")


def _share(a: str, b: str) -> str:
    f, e = lambda x: f"({x} * {PACKED} // 4096)", lambda x: f"(({x} * {PACKED} + {PACKED - 1}) // 4096)"
    return f"(NOT ({e(a)} < {f(b)} OR {e(b)} < {f(a)}))::INT"


_PL = {"new_1": "(abs(nd - ns) <= 1)::INT", "new_2": "(abs(nd - ns) <= 2)::INT", "new_3": "(abs(nd - ns) <= 3)::INT", "new_bin": f"(abs(nd - ns) < {P.bin_capacity(PACKED)})::INT", "new_64": "(abs(nd - ns) <= 64)::INT", "new_share": _share("ns", "nd"), "old_2": "(abs(dst - src) <= 2)::INT", "old_share": _share("src", "dst")}


@query(f"{_MAP} SELECT count(*) AS n_edges, {', '.join(f'round(avg({x}) * 100, 6) AS {n}' for n, x in _PL.items())} FROM be WHERE ns % 8 = 0 AND src <> dst")
def page_locality(spark, sf_dir):
    rows = base(spark, sf_dir)
    return rounded(G.page_locality(graph(rows, 8), by_norm_order(rows), PACKED, P.bin_capacity(PACKED)), *_PL)


@query(ORACLES["page_locality"].replace("ns % 8 = 0 AND ", ""))
def page_locality_whole(spark, sf_dir):
    """page_locality over every edge but those of a node to itself."""
    rows = base(spark, sf_dir)
    return rounded(G.page_locality(graph(rows, 8), by_norm_order(rows), PACKED, P.bin_capacity(PACKED), 1), *_PL)


@query(f"{_MAP}, pg AS (SELECT src, count(DISTINCT p) AS n FROM (SELECT src, unnest(range(nd * {PACKED} // 4096, (nd * {PACKED} + {PACKED - 1}) // 4096 + 1)) AS p FROM be) GROUP BY src) SELECT count(*) AS n_nodes, round(avg(n), 6) AS mean_pages FROM pg")
def pages_per_expand(spark, sf_dir):
    rows = base(spark, sf_dir)
    return rounded(G.pages_per_expansion(graph(rows, 8), by_norm_order(rows), rows, PACKED), "mean_pages")


# --- graph search -------------------------------------------------------------------------------------


def _level_sql(levels: int, beam: int) -> str:
    sql = f"{GRAPH}, {CODES}, qs AS (SELECT id AS qid, code AS qc FROM codes WHERE id % 10 = 0), b0 AS (SELECT qid, 1 AS pos, {ENTRY}::BIGINT AS id, {CODE_D.format('qc', 'code')} AS d FROM qs JOIN codes ON id = {ENTRY}), v0 AS (SELECT NULL::BIGINT AS qid, NULL::BIGINT AS id, NULL::INT AS lvl, NULL::BIGINT AS pos WHERE FALSE)"
    for k in range(levels):
        sql += f", x{k} AS (SELECT qid, id, min(pos) AS pos FROM b{k} WHERE (qid, id) NOT IN (SELECT (qid, id) FROM v{k}) GROUP BY ALL)"
        sql += f", v{k + 1} AS (SELECT * FROM v{k} UNION ALL SELECT qid, id, {k}, pos FROM x{k})"
        sql += f", c{k} AS (SELECT x.qid, e.dst AS id FROM x{k} x JOIN edges e ON e.src = x.id WHERE NOT EXISTS (SELECT 1 FROM v{k + 1} v WHERE v.qid = x.qid AND v.id = e.dst AND (v.lvl < {k} OR v.pos <= x.pos)))"
        sql += f", f{k} AS (SELECT qid, row_number() OVER w AS pos, id, {CODE_D.format('qc', 'code')} AS d FROM c{k} JOIN qs USING (qid) JOIN codes USING (id) WINDOW w AS (PARTITION BY qid ORDER BY {CODE_D.format('qc', 'code')}, id) QUALIFY row_number() OVER w <= {beam})"
        sql += f", b{k + 1} AS (SELECT * FROM f{k} UNION ALL SELECT * FROM b{k} WHERE qid NOT IN (SELECT qid FROM f{k}))"
    return sql


def level_found(spark, sf_dir, levels: int = 3, beam: int = 8) -> DataFrame:
    rows, asked = load(spark, sf_dir)
    codes = written(coded(rows), "codes")
    of = asked.select("qid").join(codes, F.col("qid") == F.col("id")).select("qid", F.col("code").alias("qcode"))
    return S.level_beam(of, graph(rows).select("src", "pos", "dst"), codes, ENTRY, beam, levels)


@query(_level_sql(3, 8) + " SELECT qid, pos::INT AS pos, id, d FROM b3")
def level_beam_3(spark, sf_dir):
    return level_found(spark, sf_dir)


@query(_level_sql(3, 8) + f", r AS (SELECT b3.qid, row_number() OVER w AS rank, b3.id, {L2.format('q.v', 'b.v')} AS dist FROM b3 JOIN base q ON q.id = b3.qid JOIN base b ON b.id = b3.id WINDOW w AS (PARTITION BY b3.qid ORDER BY {L2.format('q.v', 'b.v')}, b3.id, pos) QUALIFY row_number() OVER w <= 4) SELECT qid, rank::INT AS rank, id, round(dist, 6) AS dist FROM r")
def level_beam_3_rerank(spark, sf_dir):
    rows, asked = load(spark, sf_dir)
    return rounded(S.reranked(level_found(spark, sf_dir).select("qid", "id", "pos"), rows, asked, 4), "dist")


_MIPS = "0.0 - list_inner_product({0}, {1})"
NEAR = "adj AS MATERIALIZED (SELECT src, list({'id': dst, 'v': v, 'label': label} ORDER BY pos) AS near FROM edges JOIN base ON dst = id GROUP BY src)"
ASKED = f"asked AS (SELECT id AS qid, v AS qv, label AS ql, {ENTRY}::BIGINT AS entry FROM base WHERE id % 10 = 0)"


#: Longest list of a search by label.
MOST = 128


def _oneshot_sql(name: str, width: int, dist: str = L2, own_k: int = 0, asked: str = "asked", rows: str = "base", adj: str = "adj", own: str = "coalesce({0} = ql, FALSE)") -> str:
    """A recursive table ``name``_w (qid, qv, ql, cand, seen, n), one row per query and expansion, and ``name`` of the last ones; cand holds (d, id, done, own)."""
    kth = f"list_filter(list_transform(a, lambda c, i: CASE WHEN c.own THEN i END), lambda i: i IS NOT NULL)[{own_k}]"
    keep = f"greatest({width}, least({MOST}, coalesce({kth}, len(a))))" if own_k else str(width)
    at = "list_filter(cand, lambda c: NOT c.done)[1].id"
    return f"""{name}_w AS (SELECT qid, qv, ql, [{{'d': {dist.format("qv", "v")}, 'id': entry, 'done': FALSE, 'own': {own.format('label', 'id')}}}] AS cand, [entry] AS seen, 0::BIGINT AS n FROM {asked} JOIN {rows} ON id = entry
UNION ALL SELECT qid, qv, ql, list_slice(a, 1, {keep}), list_concat(seen, list_transform(fresh, lambda x: x.id)), n + 1 FROM (
  SELECT *, list_sort(list_concat(list_transform(cand, lambda c: {{'d': c.d, 'id': c.id, 'done': c.done OR c.id = node, 'own': c.own}}), fresh)) AS a FROM (
    SELECT *, list_transform(list_filter(coalesce(near, []), lambda x: NOT list_contains(seen, x.id)), lambda x: {{'d': {dist.format("qv", "x.v")}, 'id': x.id, 'done': FALSE, 'own': {own.format('x.label', 'x.id')}}}) AS fresh
    FROM (SELECT *, {at} AS node FROM {name}_w) LEFT JOIN {adj} ON src = node WHERE node IS NOT NULL))),
{name} AS (SELECT * FROM {name}_w WHERE {at} IS NULL)"""


def _found_sql(name: str, k: int = K, which: str = "cand") -> str:
    """(qid, rank, id, dist, n_dist, n_expand) of table ``name``."""
    return f"SELECT qid, unnest(range(1, least({k}, len({which})) + 1))::INT AS rank, unnest(list_slice({which}, 1, {k})).id AS id, unnest(list_slice({which}, 1, {k})).d AS dist, len(seen)::BIGINT AS n_dist, n AS n_expand FROM {name}"


_SEARCH = f"WITH RECURSIVE {BASE}, {graph_sql()}, {NEAR}, {ASKED}"
_SEARCH8 = f"WITH RECURSIVE {BASE}, {graph_sql(8)}, {NEAR}, {ASKED}"


def oneshot(spark, sf_dir, width: int = 20, degree: int = DEGREE, iters: int | None = None, metric: str = "l2") -> DataFrame:
    rows, asked = load(spark, sf_dir)
    rows = written(rows, "rows")
    adj = S.adjacency(graph(rows, degree), rows)
    return S.greedy(asked, adj, rows, ENTRY, width, K, metric, iters)


@query(f"{_SEARCH}, {_oneshot_sql('s', 20)} SELECT * REPLACE (round(dist, 6) AS dist) FROM ({_found_sql('s')})")
def oneshot_search(spark, sf_dir):
    return rounded(oneshot(spark, sf_dir), "dist")


@query(f"{_SEARCH}, {_oneshot_sql('s', 20, _MIPS)} SELECT * REPLACE (round(dist, 6) AS dist) FROM ({_found_sql('s')})")
def oneshot_search_mips(spark, sf_dir):
    return rounded(oneshot(spark, sf_dir, metric="mips"), "dist")


def _labelled_sql(own: str, takes: str) -> str:
    """Search by label, completed exactly for queries that found fewer than K; ``own`` and ``takes`` say which rows a query may take."""
    return f"""{_SEARCH}, {_oneshot_sql('s', 40, own_k=K, own=own)}, o AS (SELECT * REPLACE (list_filter(cand, lambda c: c.own) AS cand) FROM s),
x AS (SELECT qid, row_number() OVER w AS rank, b.id, {L2.format('qv', 'b.v')} AS dist FROM o JOIN base b ON {takes} WHERE len(cand) < {K} WINDOW w AS (PARTITION BY qid ORDER BY {L2.format('qv', 'b.v')}, b.id)),
f AS (SELECT qid, rank, id, dist FROM ({_found_sql('o')}) WHERE qid IN (SELECT qid FROM o WHERE len(cand) >= {K}) UNION ALL SELECT qid, rank, id, dist FROM x WHERE rank <= {K})
SELECT qid, rank::INT AS rank, id, round(dist, 6) AS dist, label FROM f JOIN (SELECT id AS qid, label FROM base) USING (qid)"""


def label_search(spark, sf_dir, **how) -> DataFrame:
    rows, asked = load(spark, sf_dir)
    rows = written(rows, "rows")
    labels = rows.select(F.col("id").alias("qid"), "label")
    asked = asked.join(labels, "qid")
    found = S.labelled(asked, S.adjacency(graph(rows), rows, "label"), rows, ENTRY, 40, K, most=MOST, **how)
    return rounded(found.join(labels, "qid").select("qid", "rank", "id", "dist", "label"), "dist")


@query(_labelled_sql("coalesce({0} = ql, FALSE)", "b.label = ql"))
def label_filtered_search(spark, sf_dir):
    """Graph search for the nearest rows with the query's label, tested as candidates are admitted."""
    return label_search(spark, sf_dir)


@query(_labelled_sql("coalesce(({0} = ql OR {0} = 7) AND {1} % 13 <> 0, FALSE)", "(b.label = ql OR b.label = 7) AND b.id % 13 <> 0"))
def universal_label_search(spark, sf_dir):
    """Search by label where rows of label 7 answer every query, and rows with ids divisible by 13 are dummies that are only walked."""
    return label_search(spark, sf_dir, universal=7, dummy=lambda i: i % 13 == 0)


_LADDER = f"{_SEARCH8}, gt AS ({knn_sql(K)}), " + ", ".join(_oneshot_sql(f"s{w}", w) for w in (10, 20, 40))
_LADDER += ", f AS (" + " UNION ALL ".join(f"SELECT *, {w} AS width FROM ({_found_sql(f's{w}')})" for w in (10, 20, 40)) + ")"
_LADDER += f", r AS (SELECT g.qid, width, (SELECT count(*) FROM f JOIN gt USING (qid, id) WHERE f.qid = g.qid AND f.width = g.width) / {K} AS recall FROM (SELECT DISTINCT qid, width FROM f) g)"
_LADDER += ", l AS (SELECT width::INT AS width, round(avg(recall), 6) AS recall, (SELECT round(avg(n_dist), 3) FROM f WHERE f.width = r.width) AS mean_dist FROM r GROUP BY width)"


@query(f"{_LADDER} SELECT * FROM l")
def oneshot_recall_ladder(spark, sf_dir):
    """Mean recall and distances computed for growing candidate lists on a graph of degree 8."""
    rows, asked = load(spark, sf_dir)
    rows = written(rows, "rows")
    adj, truth = S.adjacency(graph(rows, 8), rows), written(knn(rows, asked, K), "truth")
    steps = written(S.greedy_sweep(asked, adj, rows, ENTRY, [10, 20, 40], K, "width"), "ladder")
    cost = steps.groupBy("width").agg(F.round(F.avg("n_dist"), 3).alias("mean_dist"))
    return M.recall(steps, truth, K, "width").groupBy("width").agg(F.round(F.avg("recall"), DIGITS).alias("recall")).join(cost, "width")


@query(f"{_LADDER} SELECT min(width) AS width FROM l WHERE recall >= 0.9")
def ladder_first_enough(spark, sf_dir):
    """The smallest candidate list whose mean recall reaches 0.9."""
    return M.first_enough(oneshot_recall_ladder(spark, sf_dir), 0.9)


_CODED = f"{_SEARCH}, {CODES}, crows AS (SELECT id, code AS v, label FROM codes JOIN base USING (id)), casked AS (SELECT id AS qid, v AS qv, label AS ql, {ENTRY}::BIGINT AS entry FROM crows WHERE id % 10 = 0), cadj AS MATERIALIZED (SELECT src, list({{'id': dst, 'v': v, 'label': label}} ORDER BY pos) AS near FROM edges JOIN crows ON dst = id GROUP BY src)"


@query(f"{_CODED}, {_oneshot_sql('s', 40, CODE_D, asked='casked', rows='crows', adj='cadj')}, c AS (SELECT qid, id FROM ({_found_sql('s', 40)})), r AS (SELECT qid, row_number() OVER w AS rank, c.id, {L2.format('q.v', 'b.v')} AS dist FROM c JOIN base q ON q.id = qid JOIN base b ON b.id = c.id WINDOW w AS (PARTITION BY qid ORDER BY {L2.format('q.v', 'b.v')}, c.id)) SELECT qid, rank::INT AS rank, id, round(dist, 6) AS dist FROM r WHERE rank <= {K}")
def oneshot_search_coded(spark, sf_dir):
    """Search that walks by codes and scores what it found at full precision."""
    rows, asked = load(spark, sf_dir)
    rows = written(rows, "rows")
    codes = written(coded(rows).select("id", F.col("code").cast("array<float>").alias("vec")), "codes")
    of = asked.select("qid").join(codes, F.col("qid") == F.col("id")).select("qid", F.col("vec").alias("qvec"))
    found = S.greedy(of, S.adjacency(graph(rows), codes), codes, ENTRY, 40, 40)
    return rounded(S.reranked(found.select("qid", "id"), rows, asked, K), "dist")


_SHARD_EDGES = f"edges AS (SELECT a.id AS src, row_number() OVER w AS pos, b.id AS dst FROM base a JOIN base b ON a.id <> b.id AND a.id % 4 = b.id % 4 WINDOW w AS (PARTITION BY a.id ORDER BY {L2.format('a.v', 'b.v')}, b.id) QUALIFY row_number() OVER w <= 8)"
_SHARD_ASKED = "asked AS (SELECT q.id * 4 + s.shard AS qid, v AS qv, label AS ql, entry FROM base q, (SELECT id % 4 AS shard, min(id) AS entry FROM base GROUP BY id % 4) s WHERE q.id % 10 = 0)"


@query(f"WITH RECURSIVE {BASE}, {_SHARD_EDGES}, {NEAR}, {_SHARD_ASKED}, {_oneshot_sql('s', 20)}, f AS ({_found_sql('s')}), c AS (SELECT qid // 4 AS qid, sum(n_dist)::BIGINT AS n_dist FROM f WHERE rank = 1 GROUP BY qid // 4), b AS (SELECT qid // 4 AS qid, row_number() OVER w AS rank, id, dist FROM f WINDOW w AS (PARTITION BY qid // 4 ORDER BY dist, id)) SELECT qid, rank::INT AS rank, id, round(dist, 6) AS dist, n_dist FROM b JOIN c USING (qid) WHERE rank <= {K}")
def sharded_search(spark, sf_dir):
    """Four shards with a graph each, every query over all of them."""
    rows, asked = load(spark, sf_dir)
    return rounded(S.sharded(asked, rows, 4, 8, 20, K), "dist")


def _hops_sql(name: str, limits: list[tuple[int, int]]) -> str:
    """A recursive table ``name``_w, one row per query, (beam, hops) and hop, and ``name`` of the last ones; node is the one that the hop expanded."""
    runs = ", ".join(f"({b}, {h})" for b, h in limits)
    return f"""{name}_w AS (SELECT qid, qv, beam, hops, 0 AS hop, NULL::BIGINT AS node, [{{'d': {L2.format("qv", "v")}, 'id': entry}}] AS best, [{{'d': {L2.format("qv", "v")}, 'id': entry}}] AS front, [entry] AS seen FROM asked JOIN base ON id = entry, (VALUES {runs}) AS r(beam, hops)
UNION ALL SELECT qid, qv, beam, hops, hop + 1, front[1].id, list_slice(list_sort(list_concat(best, admitted)), 1, beam), list_sort(list_concat(front[2:], admitted)), list_concat(seen, list_transform(fresh, lambda x: x.id)) FROM (
  SELECT *, list_filter(fresh, lambda x, i: len(list_filter(best, lambda y: y.d <= x.d)) + len(list_filter(fresh[:i - 1], lambda y: y.d <= x.d)) < beam) AS admitted FROM (
    SELECT s.*, list_transform(list_filter(coalesce(near, []), lambda x: NOT list_contains(seen, x.id)), lambda x: {{'d': {L2.format("qv", "x.v")}, 'id': x.id}}) AS fresh
    FROM {name}_w s LEFT JOIN adj ON src = front[1].id WHERE len(front) > 0 AND hop < hops))),
{name} AS (SELECT * FROM {name}_w WHERE len(front) = 0 OR hop = hops)"""


def _best_sql(name: str) -> str:
    return f"SELECT qid, beam, unnest(range(1, least({K}, len(best)) + 1))::INT AS rank, unnest(list_slice(best, 1, {K})).id AS id, unnest(list_slice(best, 1, {K})).d AS dist FROM {name}"


_HOPS = f"{_SEARCH8}, {_hops_sql('s', [(16, HOPS)])}, tr AS (SELECT qid, src, dst AS id FROM s_w JOIN edges ON src = node)"
BEAMS = [(beam, HOPS) for beam in (4, 8, 16, 32, 64)]
EFS = [(ef, ef) for ef in (100, 200, 400, 800, 1600)]
_SWEEP_RECALL = "gt AS (" + knn_sql(K) + "), f AS (" + _best_sql("s") + f"), r AS (SELECT qid, beam, count(gt.id) / {K} AS recall FROM f LEFT JOIN gt USING (qid, id) GROUP BY qid, beam)"


def hop_limited(spark, sf_dir, beam: int = 16, hops: int = HOPS):
    rows, asked = load(spark, sf_dir)
    rows = written(rows, "rows")
    return S.best_first(asked, S.adjacency(graph(rows, 8), rows), rows, ENTRY, beam, hops, K)


@query(f"{_HOPS} SELECT qid, rank, id, round(dist, 6) AS dist FROM ({_best_sql('s')})")
def best_first_search(spark, sf_dir):
    return rounded(hop_limited(spark, sf_dir)[0], "dist")


@query(f"{_HOPS} SELECT qid, count(*) AS fetches, count(DISTINCT id) AS unique_ids, count(DISTINCT src) AS expanded FROM tr GROUP BY qid")
def best_first_trace(spark, sf_dir):
    """Fetches per query: every neighbour of every expanded node."""
    trace = hop_limited(spark, sf_dir)[1]
    return trace.groupBy("qid").agg(F.count(F.lit(1)).alias("fetches"), F.count_distinct("id").alias("unique_ids"), F.count_distinct("src").alias("expanded"))


@query(_level_sql(3, 8) + f", gt AS ({knn_sql(4)}), h AS (SELECT g.qid, count(b.id) AS twice, count(DISTINCT b.id) AS once FROM gt g LEFT JOIN b3 b ON b.qid = g.qid AND b.id = g.id AND b.pos <= 4 GROUP BY g.qid), n AS (SELECT qid, count(DISTINCT id) AS got FROM b3 WHERE pos <= 4 GROUP BY qid) SELECT qid, round(once / 4, 6) AS recall, round(once / least(4, got), 6) AS recall_of_results, round(twice / 4, 6) AS recall_with_repeats FROM h JOIN n USING (qid)")
def recall_variants(spark, sf_dir):
    """Recall of coded level search by distinct ids, over what it returned, and with repeats."""
    found, truth = written(level_found(spark, sf_dir).withColumnRenamed("pos", "rank"), "found"), written(exact(spark, sf_dir, 4), "truth")
    of, rep = M.recall_at_most(found, truth, 4).withColumnRenamed("recall", "recall_of_results"), M.recall_with_repeats(found, truth, 4).withColumnRenamed("recall", "recall_with_repeats")
    return rounded(M.recall(found, truth, 4).select("qid", "recall").join(of, "qid").join(rep, "qid"), "recall", "recall_of_results", "recall_with_repeats")


@query(f"{_SEARCH8}, {_hops_sql('s', BEAMS)}, {_SWEEP_RECALL}, c AS (SELECT beam, count(*) + (SELECT count(*) FROM asked) AS fetches FROM s_w JOIN edges ON src = node GROUP BY beam), a AS (SELECT beam, avg(recall) AS recall, count(*) AS n FROM r GROUP BY beam) SELECT beam::INT AS beam, round(recall, 6) AS recall, fetches, round(recall * n / (fetches / 1000.0), 6) AS recall_per_kio FROM a JOIN c USING (beam)")
def beam_sweep(spark, sf_dir):
    """Recall, fetches and recall per thousand fetches of hop-limited search as the beam grows."""
    rows, asked = load(spark, sf_dir)
    rows = written(rows, "rows")
    adj, truth = S.adjacency(graph(rows, 8), rows), written(knn(rows, asked, K), "truth")
    results, reads = S.best_first_sweep(asked, adj, rows, ENTRY, BEAMS, K, "beam")
    per = M.recall(written(results, "sweep"), truth, K, "beam").groupBy("beam").agg(F.avg("recall").alias("recall"), F.count(F.lit(1)).alias("n"))
    cost = reads.groupBy("beam").agg(F.count(F.lit(1)).alias("fetches"))
    joined = per.join(cost, "beam").withColumn("fetches", F.col("fetches") + F.col("n"))  # and the entry, once a query
    return joined.select("beam", F.round("recall", DIGITS).alias("recall"), "fetches", F.round(F.col("recall") * F.col("n") / (F.col("fetches") / 1000.0), DIGITS).alias("recall_per_kio"))


@query(f"{_HOPS}, h AS (SELECT dst AS id FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 20) SELECT qid, count(*) AS fetches, count(h.id) AS hits, round(count(h.id) * 100.0 / count(*), 6) AS hit_pct FROM tr LEFT JOIN h USING (id) GROUP BY qid")
def best_first_pinned(spark, sf_dir):
    """Of a hop-limited search's fetches, those that the 20 largest hubs would have answered from a pinned set."""
    rows = base(spark, sf_dir)
    steps = hop_limited(spark, sf_dir)[1]
    return rounded(T.pinned_hits(steps, G.hubs(graph(rows, 8), 20)), "hit_pct")


@query(f"{_SEARCH8}, {_hops_sql('s', EFS)}, {_SWEEP_RECALL} SELECT beam::INT AS ef, round(avg(recall), 6) AS recall, count(*) AS n_queries FROM r GROUP BY beam")
def ef_sweep(spark, sf_dir):
    """Recall of hop-limited search as hops and beam grow together."""
    rows, asked = load(spark, sf_dir)
    rows = written(rows, "rows")
    adj, truth = S.walkable(graph(rows, 8), rows), written(knn(rows, asked, K), "truth")
    out = S.best_first_sweep(asked, adj, rows, ENTRY, EFS, K, "ef", traced=False)[0]
    return M.recall(written(out, "sweep"), truth, K, "ef").groupBy("ef").agg(F.round(F.avg("recall"), DIGITS).alias("recall"), F.count(F.lit(1)).alias("n_queries"))


_RUNS = [("vectors", 20), ("vectors", 40), ("codes", 20), ("codes", 40)]
_MATRIX = f"{_CODED}, gt AS ({knn_sql(K)}), " + ", ".join(_oneshot_sql(f"{walk}{width}", width, *((CODE_D, 0, "casked", "crows", "cadj") if walk == "codes" else ())) for walk, width in _RUNS)
_MATRIX += ", f AS (" + " UNION ALL ".join(f"SELECT '{walk}' AS walk, {width} AS width, qid, id, n_dist, n_expand FROM ({_found_sql(f'{walk}{width}', width)})" for walk, width in _RUNS) + ")"
_MATRIX += f", r AS (SELECT walk, width, qid, f.id, n_dist, n_expand, row_number() OVER (PARTITION BY walk, width, qid ORDER BY {L2.format('q.v', 'b.v')}, f.id) AS rank FROM f JOIN base q ON q.id = qid JOIN base b ON b.id = f.id)"


@query(f"{_MATRIX} SELECT walk, width::INT AS width, count(DISTINCT qid) AS n_queries, round(count(gt.id) / (count(DISTINCT qid) * {K}), 6) AS recall, round(avg(n_dist) FILTER (r.rank = 1), 3) AS mean_dist, round(avg(n_expand) FILTER (r.rank = 1), 3) AS mean_expand FROM r LEFT JOIN gt ON gt.qid = r.qid AND gt.id = r.id WHERE r.rank <= {K} GROUP BY walk, width".replace("count(DISTINCT qid)", "count(DISTINCT r.qid)"))
def search_matrix(spark, sf_dir):
    """A result row per run of a parameter table: what is walked (vectors, or codes with a rerank) by the candidate list's width."""
    rows, asked = load(spark, sf_dir)
    rows, edges = written(rows, "rows"), graph(rows)
    codes = written(coded(rows).select("id", F.col("code").cast("array<float>").alias("vec")), "codes")
    of = asked.select("qid").join(codes, F.col("qid") == F.col("id")).select("qid", F.col("vec").alias("qvec"))
    walks = {"vectors": (asked, S.adjacency(edges, rows), rows), "codes": (of, S.adjacency(edges, codes), codes)}
    truth, out = written(knn(rows, asked, K), "truth"), None
    for walk, width in _RUNS:
        queries_, adj, points = walks[walk]
        found = written(S.greedy(queries_, adj, points, ENTRY, width, width), "found")
        cost = found.where("rank = 1").agg(F.round(F.avg("n_dist"), 3).alias("mean_dist"), F.round(F.avg("n_expand"), 3).alias("mean_expand"))
        per = M.recall(S.reranked(found.select("qid", "id"), rows, asked, K), truth, K).agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("recall"), DIGITS).alias("recall"))
        row = per.withColumn("one", F.lit(1)).join(cost.withColumn("one", F.lit(1)), "one").select(F.lit(walk).alias("walk"), F.lit(width).alias("width"), "n_queries", "recall", "mean_dist", "mean_expand")
        out = row if out is None else out.unionByName(row)
    return out


# --- traces: the exact neighbours in order are a query's accesses -------------------------------------

_TRACE = f"{EXACT}, tr AS (SELECT qid, qid // 10 * {K} + rank - 1 AS seq, id FROM gt)"


def trace(spark, sf_dir) -> DataFrame:
    at = (F.call_function("div", F.col("qid"), F.lit(10)) * K + F.col("rank") - 1).cast("long")
    return exact(spark, sf_dir).select("qid", at.alias("seq"), "id")


@query(f"{_TRACE}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS nth FROM tr) SELECT qid, count(*) AS fetches, count(*) FILTER (nth = 1) AS misses FROM n GROUP BY qid")
def compulsory_misses(spark, sf_dir):
    return T.first_touches(trace(spark, sf_dir))


@query(f"{_TRACE}, {graph_sql()}, h AS (SELECT dst AS id FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 50) SELECT qid, count(*) AS fetches, count(h.id) AS hits, round(count(h.id) * 100.0 / count(*), 6) AS hit_pct FROM tr LEFT JOIN h USING (id) GROUP BY qid")
def pinned_hit_rate(spark, sf_dir):
    """Hits of a cache that holds the 50 nodes of largest in-degree."""
    hubs = G.hubs(graph(base(spark, sf_dir)), 50)
    return rounded(T.pinned_hits(trace(spark, sf_dir), hubs), "hit_pct")


@query(f"{_TRACE} SELECT (row_number() OVER (ORDER BY count(*) DESC, id))::INT AS rank, id, count(*) AS n FROM tr GROUP BY id QUALIFY rank <= 20")
def access_frequency_topk(spark, sf_dir):
    return top_rows(T.frequencies(trace(spark, sf_dir)), [F.col("n").desc(), F.col("id")], 20).select("rank", "id", "n")


@query(f"{_TRACE} SELECT qid, count(*) AS fetches, count(DISTINCT id) AS unique_ids FROM tr GROUP BY qid")
def unique_per_query(spark, sf_dir):
    return T.unique_per_query(trace(spark, sf_dir))


_SESSION = 200


@query(f"{_TRACE}, s AS (SELECT seq // {_SESSION} AS session, seq, id, lag(seq) OVER w AS before FROM tr WINDOW w AS (PARTITION BY seq // {_SESSION}, id ORDER BY seq)), d AS (SELECT a.seq, a.before, (SELECT count(DISTINCT b.id) FROM s b WHERE b.session = a.session AND b.seq > a.before AND b.seq < a.seq) AS n FROM s a), c AS (SELECT unnest([8, 32, 128]) AS capacity) SELECT capacity::INT AS capacity, count(*) AS accesses, count(*) FILTER (before IS NOT NULL AND n < capacity) AS hits, round(count(*) FILTER (before IS NOT NULL AND n < capacity) * 100.0 / count(*), 6) AS hit_pct FROM d, c GROUP BY capacity")
def recency_hit_rates(spark, sf_dir):
    """Hit rates of caches that keep the most recently used records, emptied after every 200 accesses."""
    distances = T.reuse_distances(trace(spark, sf_dir), F.call_function("div", F.col("seq"), F.lit(_SESSION)))
    return rounded(T.hit_rates(distances, [8, 32, 128]), "hit_pct")


def _recency_sql(of: str, capacity: int) -> str:
    return f"SELECT count(*) AS accesses, count(*) FILTER (before IS NOT NULL AND n < {capacity}) AS hits FROM (SELECT a.before, (SELECT count(DISTINCT b.id) FROM {of} b WHERE b.session = a.session AND b.seq > a.before AND b.seq < a.seq) AS n FROM {of} a)"


@query(f"{_TRACE}, r AS (SELECT seq // {_SESSION} AS session, seq, id, lag(seq) OVER (PARTITION BY seq // {_SESSION}, id ORDER BY seq) AS before FROM tr), g AS (SELECT seq // {_SESSION} AS session, seq, id // 4 AS id, lag(seq) OVER (PARTITION BY seq // {_SESSION}, id // 4 ORDER BY seq) AS before FROM tr) SELECT 'record' AS unit, * FROM ({_recency_sql('r', 64)}) UNION ALL SELECT 'page' AS unit, * FROM ({_recency_sql('g', 16)})")
def page_against_record_hits(spark, sf_dir):
    """Hits of caches of 64 records and of 16 pages of four records, which take the same bytes."""
    accesses, session = trace(spark, sf_dir), F.call_function("div", F.col("seq"), F.lit(_SESSION))
    pages = accesses.withColumn("id", F.call_function("div", F.col("id"), F.lit(4)))
    both = [T.hit_rates(T.reuse_distances(t, session), [c]).select(F.lit(u).alias("unit"), "accesses", "hits") for u, t, c in (("record", accesses, 64), ("page", pages, 16))]
    return both[0].unionByName(both[1])


_WHOLE = "w{0} AS (SELECT seq, {1} AS id, lag(seq) OVER (PARTITION BY {1} ORDER BY seq) AS before FROM tr), d{0} AS (SELECT a.seq, a.before, (SELECT count(DISTINCT b.id) FROM w{0} b WHERE b.seq > a.before AND b.seq < a.seq) AS n FROM w{0} a)"


@query(f"{_TRACE}, {_WHOLE.format('', 'id')}, c AS (SELECT unnest([8, 32, 128, 512]) AS capacity) SELECT capacity::INT AS capacity, count(*) AS accesses, count(*) FILTER (before IS NOT NULL AND n < capacity) AS hits, round(count(*) FILTER (before IS NOT NULL AND n < capacity) * 100.0 / count(*), 6) AS hit_pct FROM d, c GROUP BY capacity")
def whole_trace_hit_rates(spark, sf_dir):
    """Hit rates of caches that keep the most recently used records over the whole trace."""
    return rounded(T.hit_rates(T.whole_reuse_distances(trace(spark, sf_dir)), [8, 32, 128, 512]), "hit_pct")


@query(f"{_TRACE}, {_WHOLE.format('r', 'id')}, {_WHOLE.format('g', 'id // 4')} SELECT 'record' AS unit, count(*) AS accesses, count(*) FILTER (before IS NOT NULL AND n < 64) AS hits FROM dr UNION ALL SELECT 'page' AS unit, count(*) AS accesses, count(*) FILTER (before IS NOT NULL AND n < 16) AS hits FROM dg")
def whole_trace_page_hits(spark, sf_dir):
    """Hits over the whole trace of caches of 64 records and of 16 pages of four records."""
    accesses = trace(spark, sf_dir)
    pages = accesses.withColumn("id", F.call_function("div", F.col("id"), F.lit(4)))
    both = [T.hit_rates(T.whole_reuse_distances(t), [c]).select(F.lit(u).alias("unit"), "accesses", "hits") for u, t, c in (("record", accesses, 64), ("page", pages, 16))]
    return both[0].unionByName(both[1])


@query(f"{_TRACE}, f AS (SELECT id, count(*) AS n, row_number() OVER (ORDER BY id) AS place, count(*) OVER () AS total FROM tr GROUP BY id), t AS (SELECT unnest([10, 25, 50, 75, 90]) AS target) SELECT target::INT AS target, count(*) FILTER (place <= floor((100 - target) * total / 100)) AS pinned, sum(n)::BIGINT AS fetches, sum(CASE WHEN place <= floor((100 - target) * total / 100) THEN 0 ELSE n END)::BIGINT AS misses, round(sum(CASE WHEN place <= floor((100 - target) * total / 100) THEN 0 ELSE n END) * 100.0 / sum(n), 6) AS miss_pct FROM f, t GROUP BY target")
def target_miss_pinning(spark, sf_dir):
    return rounded(T.target_misses(trace(spark, sf_dir), [10, 25, 50, 75, 90]), "miss_pct")


@query(f"""WITH RECURSIVE {_TRACE.removeprefix("WITH ")}, {_WHOLE.format('', 'id')}, p AS (SELECT qid, avg(CASE WHEN before IS NOT NULL AND n < 128 THEN 0.0 ELSE 1.0 END) AS rate FROM d JOIN tr USING (seq) GROUP BY qid),
m AS (SELECT row_number() OVER (ORDER BY qid) AS n, qid, rate FROM p),
r AS (SELECT 0::BIGINT AS n, 0::BIGINT AS qid, 32 AS beam UNION ALL SELECT m.n, m.qid, CASE WHEN rate > 0.45 THEN greatest(4, beam // 2) WHEN rate < 0.25 THEN least(64, beam * 2) ELSE beam END FROM r JOIN m ON m.n = r.n + 1)
SELECT qid, beam::INT AS beam FROM r WHERE n > 0""")
def adaptive_beam_replay(spark, sf_dir):
    """The beam after each query, from its share of misses in a cache of the 128 most recently used records."""
    accesses = written(trace(spark, sf_dir), "trace")
    missed = F.when(F.col("distance") < 128, 0.0).otherwise(1.0)
    rates = T.whole_reuse_distances(accesses).join(accesses.select("qid", "seq"), "seq").groupBy("qid").agg(F.avg(missed).alias("rate"))
    return T.adaptive_beams(rates, "qid")


_PROMOTE = f"{EXACT}, {graph_sql()}, l AS (SELECT unnest([1, 2, 4, 8]) AS top), p AS (SELECT DISTINCT top, g.qid, e.dst AS id FROM gt g, l JOIN edges e ON TRUE WHERE g.rank > 1 AND g.rank <= top + 1 AND e.src = g.id), u AS (SELECT p.*, gt.id IS NOT NULL AS used FROM p LEFT JOIN gt ON gt.qid = p.qid AND gt.id = p.id)"


@query(f"{_PROMOTE} SELECT top::INT AS top, count(*) AS promoted, count(*) FILTER (used) AS used, count(*) - count(*) FILTER (used) AS leftover, round(count(*) FILTER (used) / count(*), 6) AS precision FROM u GROUP BY top")
def promote_precision(spark, sf_dir):
    """Of the neighbours of a query's best results, promoted ahead, how many the query then uses."""
    found = written(exact(spark, sf_dir), "truth")
    tops = found.where("rank > 1").withColumn("top", F.explode(F.array(*[F.lit(t) for t in (1, 2, 4, 8)]))).where("rank <= top + 1")
    edges = graph(base(spark, sf_dir))
    promoted = tops.join(edges, F.col("id") == F.col("src")).select("top", "qid", F.col("dst").alias("id")).distinct()
    held = promoted.join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return held.groupBy("top").agg(F.count(F.lit(1)).alias("promoted"), F.count("hit").alias("used")).select("top", "promoted", "used", (F.col("promoted") - F.col("used")).alias("leftover"), F.round(F.col("used") / F.col("promoted"), DIGITS).alias("precision"))


_PAGES = f"{EXACT}, w AS (SELECT qid, id // 4 AS page, 1.0 / (1.0 + greatest(dist, 0)) + CASE WHEN rank <= 4 THEN 1001.0 - rank ELSE 0 END AS w FROM gt), p AS (SELECT qid, page, round(sum(w), 6) AS utility FROM w GROUP BY ALL)"


@query(f"{_PAGES} SELECT qid, (row_number() OVER o)::INT AS rank, page, utility FROM p WINDOW o AS (PARTITION BY qid ORDER BY utility DESC, page) QUALIFY row_number() OVER o <= 4")
def page_utility_rank(spark, sf_dir):
    """The four pages of largest utility per query."""
    weight = P.score_weight(F.col("dist"), F.col("rank") - 1, 4)
    pages = exact(spark, sf_dir).select("qid", F.call_function("div", F.col("id"), F.lit(4)).alias("page"), weight.alias("w")).groupBy("qid", "page").agg(F.round(F.sum("w"), DIGITS).alias("utility"))
    order = Window.partitionBy("qid").orderBy(F.col("utility").desc(), "page")
    return pages.withColumn("rank", F.row_number().over(order)).where("rank <= 4").select("qid", "rank", "page", "utility")


#: Microseconds of an access by what answers it: the record's cache, its page, or the store.
TIMES = {"record": 0.5, "page": 3.0, "store": 80.0}
_US = f"CASE WHEN r.before IS NOT NULL AND r.n < 64 THEN {TIMES['record']} WHEN g.before IS NOT NULL AND g.n < 64 THEN {TIMES['page']} ELSE {TIMES['store']} END"


@query(f"{_TRACE}, {_WHOLE.format('r', 'id')}, {_WHOLE.format('g', 'id // 4')}, t AS (SELECT {_US} AS us FROM dr r JOIN dg g USING (seq)), c AS (SELECT CASE WHEN us >= 20 THEN 'slow' WHEN us >= 2 THEN 'soft' ELSE 'hit' END AS path, us FROM t) SELECT path, count(*) AS n, round(sum(us), 6)::DOUBLE AS us, round(sum(us) * 100 / sum(sum(us)) OVER (), 6)::DOUBLE AS share_pct FROM c GROUP BY path")
def path_breakdown(spark, sf_dir):
    """Accesses and their time by path, told apart at 2 and 20 microseconds; an access takes as long as what holds it: the 64 records or the 64 pages used last, or the store."""
    accesses = trace(spark, sf_dir)
    records = T.whole_reuse_distances(accesses).select("seq", F.col("distance").alias("record"))
    pages = T.whole_reuse_distances(accesses.withColumn("id", F.call_function("div", F.col("id"), F.lit(4)))).select("seq", F.col("distance").alias("page"))
    us = F.when(F.col("record") < 64, TIMES["record"]).when(F.col("page") < 64, TIMES["page"]).otherwise(TIMES["store"])
    timed = records.join(pages, "seq").select(us.alias("us")).withColumn("path", F.when(F.col("us") >= 20, "slow").when(F.col("us") >= 2, "soft").otherwise("hit"))
    sums = timed.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("us").alias("us"))
    return rounded(sums.withColumn("share_pct", F.col("us") * 100 / F.sum("us").over(Window.partitionBy())), "us", "share_pct")


@query(f"{_SEARCH}, gt AS ({knn_sql(K)}), {_oneshot_sql('s', 20)}, f AS ({_found_sql('s')}) SELECT qid, count(gt.id) AS hits, round(count(gt.id) / {K}, 6) AS recall, any_value(n_dist) AS n_dist, any_value(n_expand) AS n_expand FROM f LEFT JOIN gt USING (qid, id) GROUP BY qid")
def flagship(spark, sf_dir):
    """One-shot graph search held against exact neighbours: recall and cost of every query."""
    found = written(oneshot(spark, sf_dir), "found")
    cost = found.select("qid", "n_dist", "n_expand").distinct()
    return rounded(M.recall(found, exact(spark, sf_dir), K).join(cost, "qid"), "recall")
