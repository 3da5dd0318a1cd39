"""One-shot search over a graph that lies in parts, where no vector is stored more than once.

Rows are numbered in an order by hyperplane codes and written as raw rows in that order: a file of vectors, and a file of
neighbours' numbers with the row's id. A part is ``part_rows`` consecutive numbers, so that a number says
its part and a part is one range of each file. A superstep has two shuffles:

* queries ask parts for rows by number. A task reads a part that is asked for once for up to about BLOCK queries, and answers with
  the rows' ids, distances and neighbours, and with those of rows that a walk from them meets inside the part;
* answers go back to their queries, which expand their best open candidate, one after the other, until
  one has a neighbour that hasn't been answered yet. Then that one and those of the next open candidates are asked for.

So the expansions, in their order, are those of a search that looks up one node at a time, and a walk that stays
in its part needs no shuffle. Parts that nobody asks for aren't read. A part that many ask for is read once per block of queries,
by as many tasks. Distances are summed as in the exact search; vectors of queries pass through untouched.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.tables import new_path, written
from ..sources.vector_files import _fs, register
from .exact import _exact, matrix
from .near_graph import _coded
from .ordering import numbered
from .search import reranked

PART_ROWS = 1024
FILE_ROWS = 1 << 16
#: Queries that one task answers from a part.
BLOCK = 256
#: Open candidates whose neighbours are asked for at once, and rows that a walk inside a part expands.
AHEAD = 12
#: Pages that one read of a batch may span.
RUN_PAGES = 64

CAND, KNOWN = "array<struct<dist:double,id:bigint,num:bigint,done:boolean>>", "array<struct<num:bigint,id:bigint,dist:double,nbrs:array<bigint>>>"
FOUND = "qid bigint, num bigint, id bigint, dist double, nbrs array<bigint>, block bigint"
STATE = f"qid bigint, qvec array<float>, cand {CAND}, seen array<bigint>, known {KNOWN}, n_expand bigint, trips bigint, wants array<bigint>, block bigint"


@dataclass(frozen=True)
class RawRows:
    """A folder of raw rows of one width: where each file's rows start."""

    path: str
    kind: str
    width: int
    names: tuple[str, ...]
    starts: tuple[int, ...]

    @classmethod
    def of(cls, path: str, kind: str, width: int) -> RawRows:
        """From the manifest of ``path``: a row a file."""
        store, at = _fs(f"{path}/manifest.json")
        with store.open_input_file(at) as f:
            parts = json.loads(f.read())["parts"]
        starts = np.cumsum([0] + [p["rows"] for p in parts]).tolist()
        return cls(path, kind, width, tuple(p["name"] for p in parts), tuple(starts))

    def read(self, first: int, n: int) -> np.ndarray:
        """Up to ``n`` rows from number ``first`` on, a range of each file that they reach into."""
        stride, out, n = np.dtype(self.kind).itemsize * self.width, [], min(n, self.starts[-1] - first)
        while n > 0:
            file = bisect_right(self.starts, first) - 1
            here = min(n, self.starts[file + 1] - first)
            store, at = _fs(f"{self.path}/{self.names[file]}")
            with store.open_input_file(at) as f:
                out.append(f.read_at(here * stride, (first - self.starts[file]) * stride))
            first, n = first + here, n - here
        return np.frombuffer(b"".join(out), self.kind).reshape(-1, self.width)


@dataclass(frozen=True)
class Parts:
    """A graph in parts, with the map (id, num) of its rows."""

    vectors: RawRows
    links: RawRows
    part_rows: int
    numbers: DataFrame

    def tables(self) -> tuple[RawRows, RawRows, int]:
        return self.vectors, self.links, self.part_rows


def in_parts(base: DataFrame, edges: DataFrame, part_rows: int = PART_ROWS, seed: int = 1) -> Parts:
    """``base`` (id, vec) and ``edges`` (src, pos, dst) written in parts, at most 2^32 rows.

    Edges from or to rows without a vector are left out; ids must differ, vectors have one length and aren't empty.
    """
    spark = base.sparkSession
    register(spark)
    rows = base.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec"))
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("dim")).first()
    if not shape["n"]:
        raise ValueError("a graph in parts needs a row")
    if shape["least"] != shape["dim"] or not shape["dim"]:
        raise ValueError("vectors of one length are wanted")
    moved = written(numbered(_coded(rows, 1, seed).select("id", "vec", F.col("codes")[0].alias("code")), ["code", "id"], "num").select("num", "id", "vec"), "numbers")
    src, dst = (moved.select(F.col("id").alias(end), F.col("num").alias(f"{end}_num")) for end in ("src", "dst"))
    near = written(edges.join(src, "src").join(dst, "dst").groupBy(F.col("src_num").alias("num")).agg(F.array_sort(F.collect_list(F.struct("pos", "dst_num")))["dst_num"].alias("near")), "near")
    degree = near.agg(F.max(F.size("near"))).first()[0] or 0
    # short lists are filled with the row itself, which a search has seen when it gets there
    filled = F.slice(F.concat(F.coalesce("near", F.array().cast("array<bigint>")), F.array_repeat("num", degree)), 1, degree) if degree else F.array().cast("array<bigint>")
    words = F.array(F.col("id").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("id", 32))
    files, vectors, links = 1 + shape["n"] // FILE_ROWS, new_path(spark, "vectors"), new_path(spark, "links")
    ordered = lambda df: df.repartitionByRange(files, "num").sortWithinPartitions("num")
    ordered(moved).select(F.col("num").alias("id"), "vec").write.format("raw_f32").mode("append").save(vectors)
    ordered(moved.select("num", "id").join(near, "num", "left")).select(F.col("num").alias("src"), F.concat(words, filled).alias("nbrs")).write.format("raw_u32").mode("append").save(links)
    return Parts(RawRows.of(vectors, "<f4", shape["dim"]), RawRows.of(links, "<u4", 2 + degree), part_rows, moved.select("id", "num"))


def _met(dist: np.ndarray, near: np.ndarray, wanted: list[int], reach: float, ahead: int) -> list[int]:
    """Rows of a part: those wanted, and what is met from them in it, nearest first, by ``ahead`` expansions."""
    got, heap = set(wanted), [(dist[i], i) for i in wanted if dist[i] <= reach]
    heapify(heap)
    while heap and ahead:
        ahead -= 1
        for j in near[heappop(heap)[1]]:
            if 0 <= j < len(dist) and j not in got:
                got.add(j)
                if dist[j] <= reach:
                    heappush(heap, (dist[j], j))
    return sorted(got)


def _answers(asks: DataFrame, parts: Parts, metric: str, ahead: int) -> DataFrame:
    """FOUND rows for asks (qid, qvec, reach, part, nums, block); rows beyond ``reach`` come without their neighbours, which nobody needs."""
    vectors, links, part_rows = parts.tables()

    def look(asked):
        import pyarrow as pa

        first = asked.column("part")[0].as_py() * part_rows
        rows, found = vectors.read(first, part_rows).astype(np.float64), links.read(first, part_rows).astype(np.int64)
        ids, nbrs = found[:, 0] | (found[:, 1] << 32), found[:, 2:]
        near, qids, places, dists, lists = (nbrs - first).tolist(), [], [], [], []
        each = zip(asked.column("qid").to_pylist(), matrix(asked, "qvec"), asked.column("reach").to_pylist(), asked.column("nums").to_pylist())
        for qid, qvec, reach, nums in each:
            dist = _exact(metric, qvec, rows)
            at = _met(dist.tolist(), near, [x - first for x in nums], reach, ahead)
            qids.append(np.full(len(at), qid))
            places.append(np.array(at, np.int64))
            dists.append(dist[at])
            lists += [nbrs[i] if dist[i] <= reach else None for i in at]
        place = np.concatenate(places)
        columns = [np.concatenate(qids), place + first, ids[place], np.concatenate(dists)]
        block = np.full(len(place), asked.column("block")[0].as_py())
        return pa.table([*map(pa.array, columns), pa.array(lists, pa.list_(pa.int64())), pa.array(block)], ["qid", "num", "id", "dist", "nbrs", "block"])

    return asks.groupBy("part", "block").applyInArrow(look, FOUND)


def _walked(cand: list, seen: set, known: dict, width: int) -> int:
    """Expand the best open of ``cand``, (dist, id, num, done) in order, while all its neighbours are known; returns the expansions."""
    n = 0
    while (nth := next((i for i, c in enumerate(cand) if not c[3]), None)) is not None:
        fresh = [x for x in dict.fromkeys(known[cand[nth][2]][2]) if x not in seen]
        if any(x not in known for x in fresh):
            break
        cand[nth] = (*cand[nth][:3], True)
        seen.update(fresh)
        cand += [(known[x][1], known[x][0], x, False) for x in fresh]
        cand.sort()
        del cand[width:]
        n += 1
    return n


def _advance(width: int, ahead: int):
    """The function that lets a block of queries walk on with the answers they got."""

    def advance(state, found):
        import pyarrow as pa

        by_query: dict[int, list] = {}
        for row in zip(*(found.column(c).to_pylist() for c in ("qid", "num", "id", "dist", "nbrs"))):
            by_query.setdefault(row[0], []).append(row[1:])
        out: dict[str, list] = {c: [] for c in ("cand", "seen", "known", "n_expand", "trips", "wants")}
        kept = zip(*(state.column(c).to_pylist() for c in ("qid", "cand", "seen", "known", "n_expand", "trips", "wants")))
        for qid, cand, seen, known, n, trips, wants in kept:
            cand, seen = [(c["dist"], c["id"], c["num"], c["done"]) for c in cand], set(seen)
            known = {x["num"]: (x["id"], x["dist"], x["nbrs"]) for x in known}
            for num, i, dist, nbrs in by_query.get(qid, []):
                if num not in seen and num not in known:
                    known[num] = (i, dist, nbrs)
            if not trips:  # the entry
                cand, seen = [(known[x][1], known[x][0], x, False) for x in wants], set(wants)
            n += _walked(cand, seen, known, width)
            open_ = [c[2] for c in cand if not c[3]]
            wants = dict.fromkeys(x for c in open_[:ahead] for x in known[c][2] if x not in seen and x not in known)
            reach = cand[-1][0] if len(cand) == width else float("inf")
            held = set(open_) if open_ else ()
            known = [{"num": x, "id": i, "dist": d, "nbrs": b if d <= reach else None} for x, (i, d, b) in known.items() if open_ and (x in held or x not in seen)]
            new = {"cand": [dict(zip(("dist", "id", "num", "done"), c)) for c in cand], "seen": list(seen), "known": known, "n_expand": n, "trips": trips + 1, "wants": list(wants)}
            for name, value in new.items():
                out[name].append(value)
        columns = {**{c: state.column(c) for c in ("qid", "qvec", "block")}, **{c: pa.array(v, state.schema.field(c).type) for c, v in out.items()}}
        return pa.table([columns[c] for c in state.column_names], state.column_names)

    return advance


def greedy_in_parts(queries: DataFrame, parts: Parts, entry: int, width: int, k: int, metric: str = "l2", ahead: int = AHEAD) -> DataFrame:
    """``search.greedy`` over a graph in parts: (qid, rank, id, dist, n_dist, n_expand, trips); trips are the supersteps a query took.

    A query's state holds its list, the numbers it has seen, and answers that may still be needed. An entry that
    isn't in the table, and no queries, give no rows.
    """
    asked = written(queries.select(F.col("qid").cast("long").alias("qid"), F.col("qvec").cast("array<float>").alias("qvec")), "queries")
    blocks = 1 + asked.count() // BLOCK
    at = parts.numbers.where(F.col("id") == entry).select("num").first()
    none = lambda name, kind: F.array().cast(kind).alias(name)
    zero = lambda name: F.lit(0).cast("long").alias(name)
    first = F.array(F.lit(at["num"] if at else -1).cast("long")).alias("wants")
    state = asked.select("qid", "qvec", none("cand", CAND), none("seen", "array<bigint>"), none("known", KNOWN), zero("n_expand"), zero("trips"), first, F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("long").alias("block"))
    state, ended = written(state if at else state.limit(0), "search"), []
    while True:
        open_ = F.size("wants") > 0
        ended.append(state.where(~open_))
        state = state.where(open_)
        if state.isEmpty():
            break
        reach = F.when(F.size("cand") < width, F.lit(float("inf"))).otherwise(F.element_at("cand", -1)["dist"])
        wants = state.select("qid", "qvec", "block", reach.alias("reach"), F.explode("wants").alias("num"))
        by = ["qid", "block", F.floor(F.col("num") / parts.part_rows).alias("part")]
        asks = wants.groupBy(*by).agg(F.first("qvec").alias("qvec"), F.first("reach").alias("reach"), F.collect_list("num").alias("nums"))
        found = _answers(asks, parts, metric, ahead)
        state = written(state.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_advance(width, ahead), STATE), "search")
    for part in ended:
        state = state.unionByName(part)
    top = state.select("qid", F.posexplode(F.slice("cand", 1, k)).alias("rank", "c"), F.size("seen").cast("long").alias("n_dist"), "n_expand", "trips")
    return top.select("qid", (F.col("rank") + 1).alias("rank"), F.col("c.id").alias("id"), F.col("c.dist").alias("dist"), "n_dist", "n_expand", "trips")


def in_order(rows: DataFrame) -> RawRows:
    """Vectors of ``rows`` (num, vec) written as raw rows; ``num`` counts from 0 without gaps."""
    register(rows.sparkSession)
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    path, files = new_path(rows.sparkSession, "vectors"), 1 + shape["n"] // FILE_ROWS
    moved = rows.repartitionByRange(files, "num").sortWithinPartitions("num")
    moved.select(F.col("num").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec")).write.format("raw_f32").mode("append").save(path)
    return RawRows.of(path, "<f4", shape["dim"] or 1)


def fetched(asked: DataFrame, vectors: RawRows, page_rows: int, reads: Observation | None = None) -> DataFrame:
    """(num, vec) of each different number in ``asked`` (num), every page of ``page_rows`` rows read once, whoever asks for it.

    Pages are dealt in runs, so that neighbouring ones are one read; ``reads`` observes pages and records. Null numbers and
    numbers beyond the table are left out.
    """
    last = vectors.starts[-1]

    def read(run):
        import pyarrow as pa

        nums = np.sort(run.column("num").to_numpy())
        pages = np.unique(nums // page_rows)
        out = {"page": [], "rows": []}
        for near in np.split(pages, np.flatnonzero(np.diff(pages) > 1) + 1):
            first = int(near[0]) * page_rows
            held = vectors.read(first, len(near) * page_rows)
            for page in near.tolist():
                own = nums[nums // page_rows == page]
                out["page"].append(page)
                out["rows"].append([{"num": n, "vec": held[n - first]} for n in own.tolist()])
        return pa.table([pa.array(out["page"], pa.int64()), pa.array(out["rows"], pa.list_(pa.struct([("num", pa.int64()), ("vec", pa.list_(pa.float32()))])))], ["page", "rows"])

    runs = asked.where((F.col("num") >= 0) & (F.col("num") < last)).select(F.col("num").cast("long").alias("num")).distinct()
    runs = runs.withColumn("run", F.floor(F.col("num") / (page_rows * RUN_PAGES)))
    pages = runs.groupBy("run").applyInArrow(read, "page long, rows array<struct<num:bigint,vec:array<float>>>")
    if reads is not None:
        pages = pages.observe(reads, F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum(F.size("rows")), F.lit(0)).cast("long").alias("records"))
    return pages.select(F.inline("rows"))


def reranked_by_pages(found: DataFrame, queries: DataFrame, vectors: RawRows, numbers: DataFrame, page_rows: int, k: int) -> tuple[DataFrame, dict[str, int]]:
    """(qid, rank, id, dist) of candidates ``found`` (qid, id) by squared L2 on vectors read by page, and the pages and records read.

    ``numbers`` holds (id, num). All queries' candidates are fetched together, so that a page is read once.
    """
    asked, reads = written(found.select("qid", "id").join(numbers, "id"), "asked"), Observation()
    vecs = written(fetched(asked, vectors, page_rows, reads), "fetched")
    return reranked(asked.select("qid", "id"), numbers.join(vecs, "num").select("id", "vec"), queries, k), {n: reads.get.get(n) or 0 for n in ("pages", "records")}
