"""Nearest vectors by largest inner product: multiprobe p-stable hashing, exact reranking.

Vectors are scaled by the largest norm and given one more coordinate that makes them unit vectors, so
the largest inner product is the smallest distance.  A table hashes a vector by a few p-stable
functions floor((a.v + b) / w) to a bucket.  A query visits buckets in the order of their estimated
chance to hold a neighbour, until the chances add up to a level; several tables are merged.  The
chance model (how a neighbour's projection spreads around the query's) and the level that reaches the
wanted recall are fitted on the true neighbours of a bounded sample of queries, found among all rows.

Equal vectors are one entry with their smallest ids (one more than asked for is all that can ever be
returned), equal queries are searched once.  A crowded bucket is cut into blocks.  Blocks are dealt out
over lanes of a bounded number of vectors: these sit in memory while any number of queries streams by,
and a query comes once to a lane, with the list of the blocks it visits there.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from journeyloom.llm.common import prepare_workers, table
from journeyloom.sources.workspace import settle


@dataclass(frozen=True)
class Search:
    k: int = 20
    tables: int = 2
    recall: float = 0.96  # of the sampled queries' true neighbours; sets how many buckets are visited
    width: float = 2.0  # of a cell, in standard deviations of the projections
    block_rows: int = 2048
    lane_rows: int = 8192
    sample_queries: int = 64
    seed: int = 11


LEVELS = (0.5, 0.6, 0.7, 0.78, 0.85, 0.9, 0.94, 0.97, 0.985, 0.995, 0.999)


class Hashing:
    """Functions of all tables, cell width and chance model: bounded by the dimension."""

    def __init__(self, search: Search, dimension: int, rows: int, norm: float):
        rng = np.random.default_rng(search.seed)
        # Half the binary digits of the row count: buckets grow like the root of the rows.
        self.functions = max(1, round(math.log2(max(rows, 2)) / 2))
        self.search, self.norm, self.tables = search, norm, search.tables
        self.directions = rng.standard_normal((search.tables * self.functions, dimension + 1))
        self.shift = rng.random(len(self.directions))
        self.mix = rng.integers(-(2**63), 2**63 - 1, len(self.directions)) | 1
        self.base = rng.integers(-(2**63), 2**63 - 1, search.tables)  # else cells of zeros were one bucket in all tables
        self.spread, self.slope, self.noise, self.success = 1.0, 1.0, 0.5, LEVELS[-1]

    def project(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        if query:
            unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            extra = np.zeros((len(unit), 1))
        else:
            unit = vectors / self.norm
            extra = np.sqrt(np.maximum(0, 1 - (unit * unit).sum(1, keepdims=True)))
        return np.hstack([unit, extra]) @ self.directions.T

    def fit(self, queries: np.ndarray, neighbours: np.ndarray) -> None:
        """``neighbours``: one true neighbour per row of ``queries``."""
        x, y = self.project(queries, True), self.project(neighbours)
        self.spread = float(y.std()) or 1.0
        self.slope = float((x * y).sum() / max((x * x).sum(), 1e-12))
        self.noise = max(float((y - self.slope * x).std()), 1e-3)
        # The lowest level at which enough of the true neighbours lie in a visited bucket.
        distinct, which = np.unique(queries, axis=0, return_inverse=True)
        projected, keys = self.project(distinct, True), self.keys(neighbours).tolist()
        for level in LEVELS:
            self.success = level
            visited = [set(self.probes(p).tolist()) for p in projected]
            hits = [not visited[q].isdisjoint(own) for q, own in zip(which.ravel().tolist(), keys)]
            if np.mean(hits) >= self.search.recall:
                break

    def cells(self, projections: np.ndarray) -> np.ndarray:
        return np.floor(projections / (self.search.width * self.spread) + self.shift).astype(np.int64)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors x tables: the buckets as 64-bit numbers; buckets that share one are visited together."""
        mixed = self.cells(self.project(vectors)) * self.mix
        return mixed.reshape(len(vectors), self.tables, self.functions).sum(2) + self.base

    def probes(self, projection: np.ndarray) -> np.ndarray:
        """Buckets in the order of their chances, per table until ``success`` is reached."""
        width, out = self.search.width * self.spread, []
        for t in range(self.tables):
            options = []
            for f in range(t * self.functions, (t + 1) * self.functions):
                mean = self.slope * projection[f]
                low = math.floor((mean - 4 * self.noise) / width + self.shift[f])
                high = math.floor((mean + 4 * self.noise) / width + self.shift[f])
                edge = [0.5 * (1 + math.erf(((c - self.shift[f]) * width - mean) / self.noise / math.sqrt(2))) for c in range(low, high + 2)]
                chance = np.diff(edge)
                some = chance > 0
                options.append((chance[some], np.arange(low, high + 1)[some] * self.mix[f]))
            best = np.cumprod([1.0] + [o[0].max(initial=0.0) for o in reversed(options)])[::-1]
            # All buckets above a floor, which is lowered until their chances add up.
            floor = best[0] / 16
            while True:
                chance, code = np.ones(1), self.base[t : t + 1]
                for (more, cell), rest in zip(options, best[1:]):
                    chance, code = np.outer(chance, more).ravel(), np.add.outer(code, cell).ravel()
                    likely = chance * rest >= floor
                    chance, code = chance[likely], code[likely]
                if floor == 0 or chance.sum() >= self.success:
                    break
                floor = floor / 4 if floor > best[0] * 1e-12 else 0.0
            order = np.argsort(-chance, kind="stable")
            out.append(code[order[: np.searchsorted(np.cumsum(chance[order]), self.success) + 1]])
        return np.concatenate(out)


QUERIES_A_TASK = 100


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector double) without null, zero or non-finite vectors, of the most frequent dimension."""
    cast = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = cast.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
    common = good.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return good.where(F.size("vector") == (common["d"] if common else 0))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.float64)


def _best(scores: np.ndarray, vectors: np.ndarray, query: np.ndarray, k: int, largest: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k best, with all that tie with the last of them, and their inner products.

    The products of a whole block differ from those summed row by row in the last bits, so everything
    within a margin of the k-th score is summed anew.  Rows that are not visited score minus infinity.
    """
    visited = scores > -np.inf
    if k < visited.sum():
        last = np.partition(scores, len(scores) - k)[len(scores) - k]
        margin = 1e-12 * len(query) * np.abs(query).max() * largest
        at = np.flatnonzero(scores >= last - margin)
    else:
        at = np.flatnonzero(visited)
    return at, (vectors[at] * query).sum(1)


FOUND = "query bigint, scores array<double>, ids array<bigint>"
QUERIES_AT_ONCE = 128


def _visit(queries: np.ndarray, blocks: list[list[int]], vectors: np.ndarray, names: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Queries x vectors: inner products where a query visits the vector's block; block by block."""
    scores = np.full((len(queries), len(vectors)), -np.inf)
    who = np.repeat(np.arange(len(queries)), [len(x) for x in blocks])
    asked = np.concatenate([np.array(x, np.int64) for x in blocks])
    which = np.minimum(np.searchsorted(names, asked), len(names) - 1)
    here = names[which] == asked
    who, which = who[here], which[here]
    order = np.argsort(which, kind="stable")
    who, which = who[order], which[order]
    cuts = np.flatnonzero(np.diff(which, prepend=-1, append=-1)) if len(which) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        low, high = begins[which[a]], begins[which[a] + 1]
        scores[who[a:b], low:high] = queries[who[a:b]] @ vectors[low:high].T
    return scores


def _rank_lanes(k: int):
    """Streams rows (lane, is_query, block, id, vector, ids, blocks), vectors of a lane first and by block, to the best per query."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, held, ids, blocks, ready = None, [], [], [], None
        best: dict[int, list[tuple[float, int]]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(q, [-s for s, _ in top], [i for _, i in top]) for q, top in best.items()]
            best.clear()
            kinds = (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["query", "scores", "ids"])

        for batch in batches:
            if not batch.num_rows:
                continue
            names, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            own, keys = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_pylist()
            matrix = _matrix(batch.column(4), batch.num_rows)
            change = np.flatnonzero((names[1:] != names[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for at, end in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if names[at] != lane:
                    lane, held, ids, blocks, ready = names[at], [], [], [], None
                if not kinds[at]:
                    held.append(matrix[at:end])
                    ids += batch.column(5).slice(at, end - at).to_pylist()
                    blocks.append(own[at:end].astype(np.int64))
                    continue
                if not held:
                    continue
                if ready is None:
                    vectors, block = np.vstack(held), np.concatenate(blocks)
                    begins = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                    ready = vectors, block[begins], np.append(begins, len(block)), np.abs(vectors).max()
                vectors, found_names, begins, largest = ready
                asked = batch.column(6).slice(at, end - at).to_pylist()
                for a in range(at, end, QUERIES_AT_ONCE):
                    b = min(end, a + QUERIES_AT_ONCE)
                    scores = _visit(matrix[a:b], asked[a - at : b - at], vectors, found_names, begins)
                    for row, one in zip(range(a, b), scores):
                        where, exact = _best(one, vectors, matrix[row], k + 1, largest)
                        found = {(-s, i) for p, s in zip(where.tolist(), exact.tolist()) for i in ids[p]}
                        found.update(best.get(keys[row], ()))
                        best[keys[row]] = heapq.nsmallest(k + 1, found)
            if len(best) > 100_000:
                yield flush()
        if best:
            yield flush()

    return run


def search_vectors(vectors: DataFrame, id_column: str, vector_column: str, is_query, search: Search = Search()) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found for each row that fulfils ``is_query``.

    ``is_query`` is a condition on ``id``.  Null, zero and non-finite vectors, null ids and vectors of
    another than the most frequent dimension take no part.  Ties go to the smaller id; rows that
    repeat id and vector are one.  Fewer than k candidates are all returned.  Starts jobs.
    """
    spark, k = vectors.sparkSession, search.k
    prepare_workers(spark)
    rows = settle(usable(vectors, id_column, vector_column).distinct(), "vectors")
    # The row-number limit works per task before the shuffle: a hot vector arrives as k + 1 rows a task.
    first = Window.partitionBy("vector").orderBy("id")
    entries = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = settle(entries.withColumn("id", F.col("ids")[0]), "vector_entries")
    asked = rows.where(is_query)
    queries = settle(asked.groupBy("vector").agg(F.min("id").alias("id")), "vector_queries")
    facts = entries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")).first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not facts["n"]:
        return empty
    usable_ids = rows.count()  # copies count: a vector of many ids can serve a query alone
    hashing = Hashing(search, facts["d"], facts["n"], facts["norm"])
    sample = queries.orderBy(F.xxhash64("id"), "id").limit(search.sample_queries).collect()
    if not sample:
        return empty
    _fit(hashing, sample, entries, k)
    ship = spark.sparkContext.broadcast(hashing.__dict__ | {"search": search.__dict__})

    def restored() -> Hashing:
        one = Hashing.__new__(Hashing)
        one.__dict__.update(ship.value | {"search": Search(**ship.value["search"])})
        return one

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = restored()
        for batch in batches:
            keys = h.keys(_matrix(batch.column(1), batch.num_rows)).tolist() if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], ["id", "vector", "ids", "keys"])

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = restored()
        for batch in batches:
            probes = [h.probes(p) for p in h.project(_matrix(batch.column(1), batch.num_rows), True)] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probes, pa.list_(pa.int64()))], ["id", "keys"])

    placed = entries.select("id", "vector", "ids").mapInArrow(place, "id bigint, vector array<double>, ids array<bigint>, keys array<bigint>")
    in_buckets = placed.select("id", "vector", "ids", F.posexplode("keys").alias("_t", "bucket"))
    in_buckets = settle(in_buckets, "vector_buckets")
    blocks = in_buckets.groupBy("bucket").agg(F.ceil(F.count("*") / search.block_rows).cast("int").alias("blocks"), F.min("_t").alias("_t"))
    lanes = 1 + facts["n"] // search.lane_rows  # per table: a vector is in a lane once
    block = F.xxhash64("bucket", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = in_buckets.join(blocks.drop("_t"), "bucket").select("id", "vector", "ids", "_t", block.alias("block"))
    # Visiting costs far more than a query weighs, so queries are dealt out by number.
    visited = queries.select("id", "vector").repartition(1 + queries.count() // QUERIES_A_TASK, "id").mapInArrow(visit, "id bigint, keys array<bigint>")
    probed = visited.select("id", F.explode("keys").alias("bucket")).join(blocks, "bucket")
    found = settle(_rank(dealt, probed, queries, (search.tables, lanes), k), "vector_candidates")
    # Queries that met fewer candidates than there are visit every block of the first table.
    short = queries.join(found.where(F.size("ids") > min(k, usable_ids - 1)).select(F.col("query").alias("id")), "id", "left_anti")
    short = settle(short, "short_queries")
    if not short.isEmpty():
        every = short.select("id", F.lit(0).alias("_t")).join(blocks, "_t")
        more = _rank(dealt, every, queries, (search.tables, lanes), k)
        found = found.join(more.select("query"), "query", "left_anti").unionByName(more)
    mine = asked.join(queries.select("vector", F.col("id").alias("query")), "vector").select(F.col("id").alias("query_id"), "query")
    pairs = F.filter(F.arrays_zip("ids", "scores"), lambda x: x["ids"] != F.col("query_id"))
    best = mine.join(found, "query").select("query_id", F.posexplode(F.slice(pairs, 1, k)).alias("at", "x"))
    return best.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))


def _rank(dealt: DataFrame, probed: DataFrame, queries: DataFrame, lanes: tuple[int, int], k: int) -> DataFrame:
    """(query, scores, ids): the k + 1 best of all visited blocks, ordered.

    ``probed`` names the buckets of every query, and of how many blocks they are; vectors travel once per lane.
    """
    tables, each = lanes
    lane = (F.pmod("block", F.lit(each)) * tables + F.col("_t")).alias("lane")
    visits = probed.select("id", "_t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_no"), "bucket").select("id", "_t", F.xxhash64("bucket", "_no").alias("block"))
    asked = visits.groupBy("id", lane).agg(F.collect_list("block").alias("blocks")).join(queries, "id")
    stream = dealt.select(lane, F.lit(False).alias("is_query"), "block", "id", "vector", "ids", F.lit(None).cast("array<bigint>").alias("blocks")).unionByName(
        asked.select("lane", F.lit(True).alias("is_query"), F.lit(0).cast("bigint").alias("block"), "id", "vector", F.lit(None).cast("array<bigint>").alias("ids"), "blocks")
    )
    part = stream.repartition(tables * each, "lane").sortWithinPartitions("lane", "is_query", "block").mapInArrow(_rank_lanes(k), FOUND)
    pairs = F.flatten(F.collect_list(F.transform(F.arrays_zip("scores", "ids"), lambda x: F.struct((-x["scores"]).alias("s"), x["ids"].alias("i")))))
    merged = part.groupBy("query").agg(F.slice(F.array_sort(F.array_distinct(pairs)), 1, k + 1).alias("_top"))
    return merged.select("query", F.transform("_top", lambda x: -x["s"]).alias("scores"), F.col("_top.i").alias("ids"))


def _fit(hashing: Hashing, sample: list, entries: DataFrame, k: int) -> None:
    """True neighbours of the sampled queries among all entries; at most k rows per query come back."""
    queries = np.array([r["vector"] for r in sample])

    def top(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                matrix = _matrix(batch.column(0), batch.num_rows)
                scores = queries @ matrix.T
                at = np.argsort(-scores, 1)[:, : k + 1]
                number = np.repeat(np.arange(len(queries)), at.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number, pa.int64()), pa.array(np.take_along_axis(scores, at, 1).ravel()), pa.array(matrix[at.ravel()].tolist(), pa.list_(pa.float64()))],
                    ["q", "score", "vector"],
                )

    near = entries.select("vector").mapInArrow(top, "q bigint, score double, vector array<double>")
    order = Window.partitionBy("q").orderBy(F.desc("score"))
    got = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n").between(2, k + 1)).collect()
    if got:
        hashing.fit(queries[[r["q"] for r in got]], np.array([r["vector"] for r in got]))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0)
