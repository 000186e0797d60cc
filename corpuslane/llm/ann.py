"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are reduced from inner product to distance (one more coordinate makes all norms equal), rotated at random,
and cut into lists by k-means over a bounded sample. Within each probed list the columns are read in blocks: from the
partial distance over the first columns a hypothesis test decides, for all queries and candidates of a list at once,
which pairs cannot come among the nearest any more. Scores of what is left are exact inner products of the original
vectors.

Of each query the nearest list is scanned first; the k-th distance found there bounds what counts in its other lists.
A list is sent to as many blocks of queries as ask for it, nothing else is. With list_recall=1.0 the search is exact:
all lists are probed, and a pair is given up only once its partial distance alone exceeds the bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialize

#: The index is fitted on at most SAMPLE_ROWS rows and has about sqrt(rows) / 2 lists, MOST_LISTS at most (a sample row a
#: list would teach it little more); every row is indexed.
NEAREST, SAMPLE_ROWS, MOST_LISTS = 20, 20000, 4096
#: Rows and queries of a list that a task compares at once, queries of them side by side, columns of a block.
BLOCK_ROWS, BLOCK_QUERIES, SIDE, COLUMNS = 16384, 4096, 256, 16
#: Share of true neighbours that the probed lists must hold on the sample (which sets how many are probed), queries that
#: it is measured with, and the test's width in standard deviations of the distance estimate.
LIST_RECALL, TRIAL_QUERIES, EPSILON = 0.97, 256, 2.1


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not all zero, no null or non-finite component."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))


def kmeans(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        own = nearest_lists(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=lists)
        full = n > 0
        centres[full] = sums[full] / n[full, None]
    return centres


def nearest_lists(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    out = []
    for i in range(0, len(x), 2048):
        d = (centres**2).sum(1) - 2 * x[i : i + 2048] @ centres.T
        out.append(d.argmin(1)[:, None] if n == 1 else np.argsort(d, 1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def augmented(x: np.ndarray, largest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(largest**2 - (x**2).sum(1), 0))
    return np.c_[x, rest]


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def probes_needed(points: np.ndarray, queries: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """Least number of nearest lists that hold `recall` of the k true neighbours of the trial queries within the sample."""
    own = nearest_lists(points, centres, 1)[:, 0]
    ranks = []
    for q in queries[:TRIAL_QUERIES]:
        d = ((points - q) ** 2).sum(1)
        near = np.argpartition(d, min(k, len(d) - 1))[: k + 1]
        place = np.empty(len(centres), np.int64)
        place[nearest_lists(q[None], centres, len(centres))[0]] = np.arange(len(centres))
        ranks.append(place[own[near]])
    ranks = np.sort(np.concatenate(ranks))
    return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)]) + 1


def scan(ids: np.ndarray, x: np.ndarray, rotated: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, rotated_queries: np.ndarray, bounds: np.ndarray, k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the k nearest candidates of each query in one list, by blocks of columns.

    bounds: of each query the squared distance beyond which a candidate doesn't matter. Up to 4k candidates are all
    scored, as a bound takes k of them. epsilon is the test's width; 0 gives up only what exceeds the bound for certain.
    """
    out: list[list[np.ndarray]] = [[], [], []]
    for i in range(0, len(queries), SIDE):
        part = _scan_side(ids, x, rotated, query_ids[i : i + SIDE], queries[i : i + SIDE], rotated_queries[i : i + SIDE], bounds[i : i + SIDE], k, epsilon)
        for held, found in zip(out, part):
            held.append(found)
    if not out[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(map(np.concatenate, out))


def _distances(rotated: np.ndarray, queries: np.ndarray, columns: slice) -> np.ndarray:
    """Squared distances over some columns, queries x candidates."""
    a, b = rotated[:, columns], queries[:, columns]
    return np.maximum((b**2).sum(1)[:, None] + (a**2).sum(1)[None] - 2 * b @ a.T, 0)


def _scan_side(ids, x, rotated, query_ids, queries, rotated_queries, bounds, k, epsilon):
    n, dim = rotated.shape
    own = query_ids[:, None] == ids[None]
    if n <= 4 * k:
        q, c = np.nonzero(~own)
    else:
        slack = 1e-9 * ((rotated_queries**2).sum(1) + (rotated[0] ** 2).sum())  # well above rounding
        # a bound from a few candidates read in full
        first = np.arange(0, n, max(1, n // (4 * k)))
        d = np.where(own[:, first], np.inf, _distances(rotated[first], rotated_queries, slice(0, dim)))
        bounds = np.minimum(bounds, np.partition(d, k - 1, 1)[:, k - 1])
        done = min(COLUMNS, dim)
        part = _distances(rotated, rotated_queries, slice(0, done))
        # a sharper one from those that look nearest so far
        near = np.argpartition(part, 2 * k, 1)[:, : 2 * k]
        d = np.where(np.take_along_axis(own, near, 1), np.inf, ((rotated[near] - rotated_queries[:, None]) ** 2).sum(2))
        bounds = np.minimum(bounds, np.partition(d, k - 1, 1)[:, k - 1]) + slack
        # of the whole bound, the share that the columns so far may take
        width = lambda: min(1.0, (1 + epsilon / math.sqrt(done)) ** 2 * done / dim) if epsilon else 1.0
        q, c = np.nonzero((part <= bounds[:, None] * width()) & ~own)
        part = part[q, c]
        while done < dim:
            to = min(done + COLUMNS, dim)
            part = part + ((rotated[c, done:to] - rotated_queries[q, done:to]) ** 2).sum(1)
            done = to
            keep = part <= bounds[q] * width()
            q, c, part = q[keep], c[keep], part[keep]
    score = np.einsum("ij,ij->i", x[c], queries[q])
    order = np.lexsort((ids[c], -score, q))
    q, c, score = q[order], c[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    best = rank < k
    return query_ids[q[best]], ids[c[best]], score[best]


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


_HITS = "query_id bigint, vec_id bigint, score double"


def search(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", is_query: Column | None = None, k: int = NEAREST, list_recall: float = LIST_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query row, its own id aside.

    Rows with an unusable vector (see usable), a null id or another number of components than most rows take no part.
    Ties go to the smaller id. With fewer than k + 1 rows every query gets all others. Rows that share an id count as
    one row each as candidates and as one query. list_recall=1.0 is exact.
    """
    spark = rows.sparkSession
    exact = list_recall >= 1.0
    data = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("x"), F.coalesce(is_query if is_query is not None else F.col(id_col) % 20 == 0, F.lit(False)).alias("is_query"))
    data = data.filter(F.col("id").isNotNull() & usable(F.col("x")))
    shape = data.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("m")).orderBy(F.desc("n"), "dim").first()
    if shape is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, n, largest = shape["dim"], shape["n"], math.sqrt(shape["m"])
    data = data.filter(F.size("x") == dim)
    lists = max(1, min(MOST_LISTS, round(math.sqrt(n) / 2)))
    # at most SAMPLE_ROWS vectors reach the driver, whatever the table's size
    sample = data.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toArrow()
    turn = rotation(dim + 1)
    raw = _matrix(sample["x"], dim)
    points = augmented(raw, largest) @ turn
    centres = kmeans(points, min(lists, len(points)))
    lists = len(centres)
    probes = lists if exact else probes_needed(points, np.c_[raw, np.zeros(len(raw))] @ turn, centres, k, list_recall)
    shared = spark.sparkContext.broadcast((centres, turn, largest))

    def make_assign():
        centres, turn, largest = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = nearest_lists(augmented(_matrix(batch.column(1), dim), largest) @ turn, centres, 1)[:, 0]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=["id", "x", "is_query", "list"])

        return step

    placed = materialize(arrow_map(data, make_assign, "id bigint, x array<double>, is_query boolean, list int"))
    # one row a list: at most MOST_LISTS
    counts = {r[0]: r[1] for r in placed.groupBy("list").count().collect()}
    sizes = np.array([counts.get(i, 0) for i in range(lists)])
    known = spark.sparkContext.broadcast(sizes)

    def make_probe():
        centres, turn, _ = shared.value
        sizes = known.value

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                x = _matrix(part.column(1), dim)
                order = nearest_lists(np.c_[x, np.zeros(len(x))] @ turn, centres, lists)
                held = np.cumsum(sizes[order], 1)
                # more lists than usual where the usual ones hold too few candidates
                enough = np.maximum((held < k + 1).sum(1) + 1, probes)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([o[:e].astype(np.int32) for o, e in zip(order, enough)], pa.list_(pa.int32()))], names=["id", "x", "lists"])

        return step

    queries = placed.filter("is_query").dropDuplicates(["id"]).select("id", "x")
    probed = materialize(arrow_map(queries, make_probe, "id bigint, x array<double>, lists array<int>"))
    # at most MOST_LISTS rows
    blocks = F.broadcast(spark.createDataFrame([(i, max(1, -(-int(s) // BLOCK_ROWS))) for i, s in enumerate(sizes)], "list int, blocks int"))

    def compare(asked: DataFrame) -> DataFrame:
        """Hits of asked (id, x, list, bound), list by list."""
        # one row a list reaches the driver
        wanted = {r[0]: -(-r[1] // BLOCK_QUERIES) for r in asked.groupBy("list").count().collect()}
        query_blocks = F.broadcast(spark.createDataFrame(list(wanted.items()), "list int, query_blocks int"))
        asked = asked.join(query_blocks, "list").join(blocks, "list")
        asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.pmod(F.xxhash64("id"), "query_blocks").cast("int").alias("qb"), "id", "x", "bound")
        base = placed.join(query_blocks, "list").join(blocks, "list")
        base = base.select("list", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("qb"), "id", "x")

        def cell(found: pa.Table, asked: pa.Table) -> pa.Table:
            names = ["query_id", "vec_id", "score"]
            if not found.num_rows or not asked.num_rows:
                return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
            _, turn, largest = shared.value
            x, q = _matrix(found["x"], dim), _matrix(asked["x"], dim)
            hits = scan(found["id"].to_numpy(), x, augmented(x, largest) @ turn, asked["id"].to_numpy(), q, np.c_[q, np.zeros(len(q))] @ turn, asked["bound"].to_numpy(), k, 0.0 if exact else EPSILON)
            return pa.table([pa.array(h) for h in hits], names=names)

        return base.groupBy("list", "b", "qb").cogroup(asked.groupBy("list", "b", "qb")).applyInArrow(cell, _HITS)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    near = compare(probed.select("id", "x", F.element_at("lists", 1).alias("list"), F.lit(float("inf")).alias("bound")))
    near = materialize(near.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank"))
    # the squared distance in the augmented space is |q|^2 + largest^2 - 2 <q, x>
    last = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    bound = F.when(F.col("n") >= k, F.aggregate("x", F.lit(largest**2), lambda a, v: a + v * v) - 2 * F.col("s")).otherwise(F.lit(float("inf")))
    rest = probed.filter(F.size("lists") > 1).join(last.withColumnRenamed("query_id", "id"), "id", "left")
    rest = rest.select("id", "x", F.coalesce(bound, F.lit(float("inf"))).alias("bound"), F.explode(F.slice("lists", 2, lists)).alias("list"))
    hits = near.unionByName(compare(rest)) if lists > 1 else near
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
