"""Registered queries over navigable graphs, byte budgets and the steps of real searches, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.pages import page_span
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import navigable as N
from ..operators import parted as P
from ..operators import search as S
from ..operators import traces as T
from ..operators.exact import knn
from ..operators.near_graph import near_graph
from ..operators.pruned import knn_pruned
from ..sources.tables import base, written
from .catalog import _CODED, _HOPS, _SEARCH8, _SWEEP_RECALL, _TWO_HOP, _found_sql, _hops_sql, _oneshot_sql, ASKED, BASE, BEAMS, CODE_D, DEGREE, DIGITS, ENTRY, HOPS, K, L2, ORACLES, by_norm_order, coded, graph, graph_sql, knn_sql, load, query, rounded

WIDTH = 32
LEVEL = 64


def _prune_sql(name: str, cands: str, degree: int = DEGREE) -> str:
    """Table ``name`` (src, pos, dst, dist): each step keeps the nearest candidate left and drops those it occludes."""
    return f"""{name}_w AS (SELECT src AS p, dst AS c, dist AS d, v, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rk, 1 AS step FROM {cands} JOIN base ON id = dst
UNION ALL SELECT w.p, w.c, w.d, w.v, row_number() OVER (PARTITION BY w.p ORDER BY w.d, w.c), w.step + 1 FROM {name}_w w JOIN {name}_w f ON f.p = w.p AND f.rk = 1 WHERE w.rk > 1 AND w.step < {degree} AND {N.ALPHA * N.ALPHA!r} * {L2.format('f.v', 'w.v')} > w.d),
{name} AS MATERIALIZED (SELECT p AS src, step AS pos, c AS dst, d AS dist FROM {name}_w WHERE rk = 1)"""


_BOTH = "SELECT DISTINCT src, dst, dist FROM (SELECT src, dst, dist FROM {0} UNION ALL SELECT dst, src, dist FROM {0} QUALIFY row_number() OVER (PARTITION BY dst ORDER BY dist, src) <= 64)"
_NAV = f"""WITH RECURSIVE {BASE}, {graph_sql(WIDTH)}, c1 AS MATERIALIZED ({_BOTH.format('edges')}), {_prune_sql('n1', 'c1')},
c2 AS MATERIALIZED ({_BOTH.format('n1')}), c3 AS (SELECT * FROM c2 QUALIFY count(*) OVER (PARTITION BY src) > {DEGREE}), {_prune_sql('n2', 'c3')},
nav AS MATERIALIZED (SELECT src, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS pos, dst, dist FROM c2 QUALIFY count(*) OVER (PARTITION BY src) <= {DEGREE} UNION ALL SELECT src, pos, dst, dist FROM n2)"""


def navigable_graph(rows):
    return written(N.navigable(graph(rows, WIDTH), rows, DEGREE), "navigable")


@query(f"{_NAV} SELECT src, pos::INT AS pos, dst, round(dist, 6) AS dist FROM nav")
def navigable_graph_edges(spark, sf_dir):
    """The graph that occlusion pruning and reverse edges make of the 32 nearest neighbours, at most 16 edges a node."""
    return rounded(navigable_graph(base(spark, sf_dir)), "dist")


_LEVEL = f"lv AS (SELECT id, v FROM base WHERE (SELECT count(*) FROM base) <= {LEVEL} OR ((id % {N.MODULUS}) * {N.MULTIPLIER}) % {N.MODULUS} < {N.MODULUS * LEVEL} // (SELECT count(*) FROM base) ORDER BY ((id % {N.MODULUS}) * {N.MULTIPLIER}) % {N.MODULUS}, id LIMIT {2 * LEVEL})"
_NAV_SEARCH = f"""{_NAV}, adj AS MATERIALIZED (SELECT src, list({{'id': dst, 'v': v, 'label': label}} ORDER BY pos) AS near FROM nav JOIN base ON dst = id GROUP BY src), {_LEVEL},
casked AS (SELECT q.id AS qid, q.v AS qv, label AS ql, lv.id AS entry FROM base q, lv WHERE q.id % 10 = 0 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY {L2.format('q.v', 'lv.v')}, lv.id) = 1)"""


def _entered(spark, sf_dir, width: int):
    rows, asked = load(spark, sf_dir)
    rows = written(rows, "rows")
    adj = S.walkable(navigable_graph(rows), rows)
    return rows, asked, adj, S.greedy(N.entries(rows, asked, LEVEL), adj, rows, None, width, K)


@query(f"{_NAV_SEARCH}, {_oneshot_sql('s', 20, asked='casked')} SELECT * REPLACE (round(dist, 6) AS dist) FROM ({_found_sql('s')})")
def navigable_search(spark, sf_dir):
    """One-shot search over the navigable graph, entered at the nearest row of a hashed level."""
    return rounded(_entered(spark, sf_dir, 20)[3], "dist")


_ENTRIES = " UNION ALL ".join(f"SELECT '{name}' AS entry, count(DISTINCT qid) AS n_queries, round(count(gt.id) / (count(DISTINCT qid) * {K}), 6) AS recall, round(avg(n_expand) FILTER (f.rank = 1), 3) AS mean_expand FROM ({_found_sql(s)}) f LEFT JOIN gt USING (qid, id)" for name, s in (("level", "s"), ("first", "z")))


@query(f"{_NAV_SEARCH}, {ASKED}, gt AS ({knn_sql(K)}), {_oneshot_sql('s', 40, asked='casked')}, {_oneshot_sql('z', 40)} {_ENTRIES}")
def navigable_entries(spark, sf_dir):
    """Recall and expansions of search over the navigable graph, entered by level or at the first row."""
    rows, asked, adj, by_level = _entered(spark, sf_dir, 40)
    truth, out = written(knn(rows, asked, K), "truth"), None
    for name, found in (("level", by_level), ("first", S.greedy(asked, adj, rows, ENTRY, 40, K))):
        found = written(found, "found")
        cost = found.where("rank = 1").agg(F.round(F.avg("n_expand"), 3).alias("mean_expand")).withColumn("one", F.lit(1))
        row = M.recall(found, truth, K).agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("recall"), DIGITS).alias("recall")).withColumn("one", F.lit(1)).join(cost, "one")
        row = row.select(F.lit(name).alias("entry"), "n_queries", "recall", "mean_expand")
        out = row if out is None else out.unionByName(row)
    return out


TOP, RATIO, LAYERS = 16, 4, 2


def _layers_sql() -> str:
    """Tables layer0 (the top) to layer2, the descent through each but the top, d1 and d2, and e2 (.., entry) of the last one's rows."""
    near = L2.format("a.v", "b.v")
    sql = f"keyed AS (SELECT id, v, label, ((id % {N.MODULUS}) * {N.MULTIPLIER}) % {N.MODULUS} AS key FROM base), layer0 AS MATERIALIZED (SELECT * FROM keyed ORDER BY key, id LIMIT {TOP})"
    sql += f", e0 AS (SELECT q.id AS qid, q.v AS qv, q.label AS ql, t.id AS entry FROM base q, layer0 t WHERE q.id % 10 = 0 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY {L2.format('q.v', 't.v')}, t.id) = 1)"
    for i in range(1, LAYERS + 1):
        sql += f", layer{i} AS MATERIALIZED (SELECT * FROM keyed WHERE key < greatest((SELECT max(key) + 1 FROM layer0), {N.MODULUS * TOP * RATIO**i} // (SELECT count(*) FROM base)))"
        sql += f", le{i} AS (SELECT a.id AS src, row_number() OVER w AS pos, b.id AS dst FROM layer{i} a JOIN layer{i} b ON a.id <> b.id WINDOW w AS (PARTITION BY a.id ORDER BY {near}, b.id) QUALIFY row_number() OVER w <= 8)"
        sql += f", la{i} AS MATERIALIZED (SELECT src, list({{'id': dst, 'v': v, 'label': label}} ORDER BY pos) AS near FROM le{i} JOIN layer{i} ON dst = id GROUP BY src)"
        sql += f", {_oneshot_sql(f'd{i}', 4, asked=f'e{i - 1}', rows=f'layer{i}', adj=f'la{i}')}, e{i} AS (SELECT qid, qv, ql, cand[1].id AS entry FROM d{i})"
    return sql


_LAYERED = f"{_NAV}, adj AS MATERIALIZED (SELECT src, list({{'id': dst, 'v': v, 'label': label}} ORDER BY pos) AS near FROM nav JOIN base ON dst = id GROUP BY src), {_layers_sql()}, {_oneshot_sql('s', 20, asked=f'e{LAYERS}')}"


@query(f"{_LAYERED} SELECT f.qid, rank, id, round(dist, 6) AS dist, n_dist, n_expand, {' + '.join(f'd{i}.n' for i in range(1, LAYERS + 1))} AS n_descent FROM ({_found_sql('s')}) f {' '.join(f'JOIN d{i} ON d{i}.qid = f.qid' for i in range(1, LAYERS + 1))}")
def layered_search(spark, sf_dir):
    """One-shot search over the navigable graph, entered where a descent through hashed layers ends; with the descent's expansions."""
    rows, asked = load(spark, sf_dir)
    rows = written(rows, "rows")
    entered = written(N.descended(rows, asked, lambda layer: graph(layer, 8), TOP, RATIO, layers=LAYERS), "entered")
    found = S.greedy(entered.drop("n_expand"), S.adjacency(navigable_graph(rows), rows), rows, None, 20, K)
    return rounded(found.join(entered.select("qid", F.col("n_expand").alias("n_descent")), "qid"), "dist")


@query(f"WITH {BASE} SELECT count(*) FILTER (id % 20 = 0) AS n_nodes, TRUE AS reached FROM base")
def approx_graph_recall(spark, sf_dir):
    """Whether the approximate graph holds 0.9 of the exact neighbours of every 20th row, all rows searched."""
    rows = written(base(spark, sf_dir), "rows")
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    truth = knn(rows, asked, DEGREE, exclude_self=True)
    found = near_graph(rows, DEGREE).where("src % 20 = 0").select(F.col("src").alias("qid"), F.col("pos").alias("rank"), F.col("dst").alias("id"))
    return M.recall(found, written(truth, "truth"), DEGREE).agg(F.count(F.lit(1)).alias("n_nodes"), (F.avg("recall") >= 0.9).alias("reached"))


# --- byte budgets: records of 400 bytes, end to end on pages of 512

_SPANS = "r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY id) AS nth, id, range(id * 400 // 512, (id * 400 + 399) // 512 + 1) AS pages FROM th)"
BUDGETS = [pages * 512 for pages in (1, 3, 16)]


@query(f"""WITH RECURSIVE {_TWO_HOP.removeprefix("WITH ")}, {_SPANS},
f AS (SELECT qid, b AS budget, b AS left_, []::BIGINT[] AS held, 0::BIGINT AS nth, NULL::BIGINT AS id, 0::BIGINT AS charge FROM (SELECT DISTINCT qid FROM r), (SELECT unnest({BUDGETS})::BIGINT AS b)
UNION ALL SELECT qid, budget, left_ - paid, CASE WHEN paid > 0 THEN list_concat(held, fresh) ELSE held END, nth, id, paid FROM (SELECT *, CASE WHEN 512 * len(fresh) <= left_ THEN 512 * len(fresh) ELSE 0 END AS paid FROM (
  SELECT f.qid, budget, left_, held, r.nth, r.id, list_filter(pages, lambda p: NOT list_contains(held, p)) AS fresh FROM f JOIN r ON r.qid = f.qid AND r.nth = f.nth + 1)))
SELECT qid, budget, nth, id, charge FROM f WHERE charge > 0""")
def budgeted_prefetch(spark, sf_dir):
    """Two-hop candidates in order of id, as far as budgets of 1, 3 and 16 pages go: one that costs too much is passed over."""
    from pyspark.sql import Window

    rows, asked = load(spark, sf_dir)
    first, last = page_span(F.col("id"), 400, 400, 512)
    order = F.row_number().over(Window.partitionBy("qid").orderBy("id"))
    records = G.two_hop(graph(rows), asked, 4).select("qid", order.cast("long").alias("nth"), "id", first.alias("first"), last.alias("last"))
    return G.budgeted(records, BUDGETS, 512)


# --- the steps of a hop-limited search of 16 hops

_STEPS = f"{_SEARCH8}, {_hops_sql('s', [(16, 16)])}, st AS (SELECT qid, hop, src, pos, dst AS id, edges.dist AS near, qv FROM s_w JOIN edges ON src = node), t AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY qid, hop, pos) AS seq, dense_rank() OVER (ORDER BY qid, hop) AS step FROM st)"


def search_steps(spark, sf_dir):
    """(rows, edges, trace) of a hop-limited search."""
    rows, asked = load(spark, sf_dir)
    rows = written(rows, "rows")
    edges = graph(rows, 8)
    steps = S.best_first(asked, S.adjacency(edges, rows), rows, ENTRY, 16, 16, K)[1]
    return rows, asked, edges, written(steps, "steps")


@query(f"{_STEPS}, a AS (SELECT t.*, min(seq) OVER (PARTITION BY step) AS began FROM t), l AS (SELECT a.seq, a.began, (SELECT max(b.seq) FROM t b WHERE b.id = a.id AND b.seq < a.began) AS before FROM a), n AS (SELECT before, (SELECT count(DISTINCT b.id) FROM t b WHERE b.seq > l.before AND b.seq < l.began) AS n FROM l), c AS (SELECT unnest([8, 32, 128, 512]) AS capacity) SELECT capacity::INT AS capacity, count(*) AS total, count(*) FILTER (before IS NOT NULL AND n < capacity) AS hits, round(count(*) FILTER (before IS NOT NULL AND n < capacity) * 100.0 / count(*), 6) AS hit_pct FROM n, c GROUP BY capacity")
def semantic_next_hits(spark, sf_dir):
    """Of the neighbours of each expanded node, those in caches of the most recently used records at the moment of expansion."""
    return rounded(T.next_hits(search_steps(spark, sf_dir)[3], [8, 32, 128, 512]), "hit_pct")


TOPS = [0, 1, 2, 4, 8, 16]


@query(f"""{_STEPS}, v AS (SELECT t.qid, t.hop, t.step, t.pos, t.id, {L2.format('qv', 'b.v')} AS d FROM t JOIN base b ON b.id = t.id),
k AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY d, id, pos) AS nth FROM v), g AS (SELECT unnest({TOPS}) AS top),
o AS (SELECT DISTINCT top, k.qid, k.hop, k.step, e.dst AS id FROM g JOIN k ON k.nth <= top JOIN edges e ON e.src = k.id WHERE e.dst <> {ENTRY} AND NOT EXISTS (SELECT 1 FROM t WHERE t.qid = k.qid AND t.id = e.dst AND t.hop <= k.hop)),
p AS (SELECT DISTINCT top, id, (SELECT count(*) FROM t WHERE t.id = o.id AND t.step <= o.step) AS epoch FROM o),
u AS (SELECT top, p.id, epoch < (SELECT count(*) FROM t WHERE t.id = p.id) AS used FROM p)
SELECT g.top::INT AS top, count(u.id) AS promoted, count(*) FILTER (used) AS used, count(u.id) - count(*) FILTER (used) AS leftover FROM g LEFT JOIN u USING (top) GROUP BY g.top""")
def promote_per_step(spark, sf_dir):
    """Neighbours of each expansion's nearest neighbours, promoted ahead, and how many a later fetch uses."""
    rows, asked, edges, steps = search_steps(spark, sf_dir)
    from ..functions.vectors import squared_l2

    scored = steps.join(rows.select("id", "vec"), "id").join(asked, "qid").select(*steps.columns, squared_l2(F.col("qvec"), F.col("vec")).alias("dist"))
    return T.promoted_per_step(written(scored, "scored"), edges, ENTRY, TOPS)


# --- exact search that skips what bounds exclude


@query(ORACLES["exact_knn_l2"])
def exact_knn_l2_pruned(spark, sf_dir):
    return rounded(knn_pruned(*load(spark, sf_dir), K)[0], "dist")


@query(ORACLES["exact_knn_mips"])
def exact_knn_mips_pruned(spark, sf_dir):
    return rounded(knn_pruned(*load(spark, sf_dir), K, "mips")[0], "dist")


# --- what a run did, and sweeps by how queries are drawn


@query(f"{_HOPS} SELECT (SELECT count(*) FROM s) AS queries, (SELECT sum(hop)::BIGINT FROM s) AS expanded, (SELECT sum(len(seen))::BIGINT FROM s) AS distances, (SELECT count(*) FROM tr) AS fetches, (SELECT count(*) * max(len(v)) * 4 FROM tr, base WHERE base.id = tr.id)::BIGINT AS bytes")
def search_run_metrics(spark, sf_dir):
    """One row of a hop-limited run: queries, expansions, distances, fetches and their bytes, counted while it runs."""
    rows, asked = load(spark, sf_dir)
    rows, counters = written(rows, "rows"), S.Counters()
    S.best_first(asked, S.adjacency(graph(rows, 8), rows), rows, ENTRY, 16, HOPS, K, counters)
    totals = counters.totals()
    width = rows.agg(F.max(F.size("vec")).cast("long").alias("dim"))
    return width.select(*[F.lit(v).cast("long").alias(c) for c, v in totals.items()], (F.lit(totals["fetches"]).cast("long") * F.col("dim") * 4).alias("bytes"))


#: The nth query, by a count of ten ids, is asked n_queries // (4 * n) times: as often as its rank goes into a quarter of all.
_DRAWS = "m AS (SELECT count(*) AS m FROM asked), draws AS (SELECT 'uniform' AS dist, qid, 1::BIGINT AS times FROM asked UNION ALL SELECT 'skewed', qid, m // (4 * (qid // 10 + 1)) FROM asked, m WHERE m // (4 * (qid // 10 + 1)) > 0)"


@query(f"""{_SEARCH8}, {_hops_sql('s', BEAMS)}, {_SWEEP_RECALL}, {_DRAWS}, tr AS (SELECT beam, qid, dst AS id FROM s_w JOIN edges ON src = node UNION ALL SELECT beam, qid, {ENTRY} FROM s),
c AS (SELECT dist, beam, sum(times)::BIGINT AS fetches, count(DISTINCT id) AS misses FROM tr JOIN draws USING (qid) GROUP BY ALL), a AS (SELECT dist, beam, sum(times)::BIGINT AS n_queries, sum(recall * times) / sum(times) AS recall FROM r JOIN draws USING (qid) GROUP BY ALL)
SELECT dist, beam::INT AS beam, n_queries, round(recall, 6) AS recall, fetches, misses, round((fetches - misses) * 100.0 / fetches, 6) AS hit_pct FROM a JOIN c USING (dist, beam)""")
def beam_sweep_by_draw(spark, sf_dir):
    """Recall, fetches and first touches of hop-limited search by beam, where each query is asked once, and where few are asked often.

    A query asked again takes the same steps, so each is searched once and counts as often as it is asked. Every
    record stays held after its first touch.
    """
    rows, asked = load(spark, sf_dir)
    rows = written(rows, "rows")
    adj, truth = S.adjacency(graph(rows, 8), rows), written(knn(rows, asked, K), "truth")
    results, reads = S.best_first_sweep(asked, adj, rows, ENTRY, BEAMS, K, "beam")
    per = M.recall(written(results, "sweep"), truth, K, "beam")
    m = asked.agg(F.count(F.lit(1)).alias("m"))
    often = F.floor(F.col("m") / (4 * (F.floor(F.col("qid") / 10) + 1)))
    skewed = asked.select("qid").crossJoin(F.broadcast(m)).select(F.lit("skewed").alias("dist"), "qid", often.alias("times")).where("times > 0")  # m is one row
    draws = asked.select(F.lit("uniform").alias("dist"), "qid", F.lit(1).cast("long").alias("times")).unionByName(skewed)
    touched = reads.select("beam", "qid", "id").unionByName(per.select("beam", "qid", F.lit(ENTRY).cast("long").alias("id")))
    cost = touched.join(draws, "qid").groupBy("dist", "beam", "id").agg(F.sum("times").alias("times")).groupBy("dist", "beam").agg(F.sum("times").alias("fetches"), F.count(F.lit(1)).alias("misses"))
    found = per.join(draws, "qid").groupBy("dist", "beam").agg(F.sum("times").alias("n_queries"), F.round(F.sum(F.col("recall") * F.col("times")) / F.sum("times"), DIGITS).alias("recall"))
    return found.join(cost, ["dist", "beam"]).select("dist", "beam", "n_queries", "recall", "fetches", "misses", F.round((F.col("fetches") - F.col("misses")) * 100.0 / F.col("fetches"), DIGITS).alias("hit_pct"))


@query(ORACLES["oneshot_search"])
def partitioned_search(spark, sf_dir):
    """One-shot search over a graph in parts: vectors once, walks inside parts, whole parts read by range."""
    rows, asked = load(spark, sf_dir)
    rows = written(rows, "rows")
    parts = P.in_parts(rows, graph(rows))
    return rounded(P.greedy_in_parts(asked, parts, ENTRY, 20, K).drop("trips"), "dist")


PAGE_ROWS = 16


def by_pages(spark, sf_dir):
    """Candidates (qid, id) of a walk by codes, their rerank on vectors read by page in a given order, what was read, and the map (id, num)."""
    rows, asked = load(spark, sf_dir)
    rows = written(rows, "rows")
    codes = written(coded(rows).select("id", F.col("code").cast("array<float>").alias("vec")), "codes")
    of = asked.select("qid").join(codes, F.col("qid") == F.col("id")).select("qid", F.col("vec").alias("qvec"))
    found = written(S.greedy(of, S.adjacency(graph(rows), codes), codes, ENTRY, 40, 40).select("qid", "id"), "found")
    numbers = by_norm_order(rows).select(F.col("old_id").alias("id"), F.col("new_id").alias("num"))
    vectors = P.in_order(rows.join(numbers, "id"))
    return found, *P.reranked_by_pages(found, asked, vectors, numbers, PAGE_ROWS, K), numbers


@query(ORACLES["oneshot_search_coded"])
def paged_rerank(spark, sf_dir):
    """Search by codes whose candidates' vectors are read from pages, each page once for all queries."""
    return rounded(by_pages(spark, sf_dir)[1], "dist")


_PAGED = f"{_CODED}, {_oneshot_sql('s', 40, CODE_D, asked='casked', rows='crows', adj='cadj')}, im AS (SELECT id, row_number() OVER (ORDER BY -(id * 7919 % 10007), id) - 1 AS num FROM base), c AS (SELECT qid, id, num // {PAGE_ROWS} AS page FROM ({_found_sql('s', 40)}) JOIN im USING (id))"


@query(f"{_PAGED} SELECT count(DISTINCT qid) AS n_queries, count(*) AS candidates, count(DISTINCT id) AS records, count(DISTINCT page) AS pages, (SELECT count(*) FROM (SELECT DISTINCT qid, page FROM c)) AS pages_apart FROM c")
def paged_rerank_reads(spark, sf_dir):
    """Records and pages that the batched rerank reads, counted while it reads, and the pages that its queries would read one by one."""
    found, _, reads, numbers = by_pages(spark, sf_dir)
    apart = found.join(numbers, "id").select("qid", F.floor(F.col("num") / PAGE_ROWS).alias("page")).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page").alias("p"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    seen = [F.lit(reads[name]).cast("long").alias(name) for name in ("records", "pages")]
    return apart.agg(F.count(F.lit(1)).alias("n_queries"), total("n", "candidates"), total("p", "pages_apart")).select("n_queries", "candidates", *seen, "pages_apart")
