"""Mixing sources to target weights by Cube-method balanced sampling.

Each source gets a target; a row's expected number of copies is its source's target over its source's size. The
fractional parts are moved through the null space of two constraints (words and rows) until all but two of a block are
0 or 1; what stays open of all blocks goes to the next level, and at most two rows a source are left for the landing.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, join_counted, materialize

WEIGHTS = (5, 2, 1)
BLOCK_ROWS = 4096
#: Rows that may change sides at the end to restore a source's total of words; it bends their chances a little.
LANDING_MOVES = 8


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, n) per source of sizes (source, source_size, n).

    Sources in code-point order, null last, take the weights in turn and divide share x all sizes by weight; a target
    stops at most x its source's size and the rest is divided anew. Only sums reach the driver, however many sources.
    """
    spark = sizes.sparkSession
    by_name = F.col("source").asc_nulls_last()
    ordered = materialize(sizes.repartitionByRange(by_name).sortWithinPartitions(by_name))
    ordered = ordered.withColumn("__file", F.col("_metadata.file_name"))
    before, total = [], 0
    for f, n in sorted((r[0], r[1]) for r in ordered.groupBy("__file").count().collect()):
        before.append((f, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(before or [("", 0)], "__file string, __before bigint"))
    rank = F.row_number().over(Window.partitionBy("__file").orderBy(by_name)) - 1 + F.col("__before")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = materialize(ordered.join(offsets, "__file").withColumn("source_rank", rank).withColumn("weight", weight).drop("__file", "__before"))
    row = ranked.agg(F.sum("source_size"), F.sum(F.when(F.col("source_size") > 0, F.col("weight")))).first()
    everything, open_weight = row[0] or 0, row[1] or 0
    level, capped = (share * everything / open_weight if open_weight else 0.0), -1
    while open_weight:
        full = F.col("weight") * F.lit(level) >= most * F.col("source_size")
        n, size, w = ranked.filter(F.col("source_size") > 0).agg(F.count_if(full), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not w:
            level = level if w else float("inf")
            break
        capped = n
        level = (share * everything - most * (size or 0)) / w
    target = F.when(F.col("source_size") > 0, F.least(F.col("weight") * F.lit(level), most * F.col("source_size"))).otherwise(F.lit(0.0))
    return ranked.withColumn("target", target.cast("double"))


def flight(sizes: list[int], p: list[float], rng: random.Random, land: bool) -> list[float]:
    """Cube flight over one block: moves p through the null space of (sum of size x p, sum of p).

    All but at most two entries end as 0 or 1. With land those are decided as well: first keeping the words alone,
    then by chance, then up to LANDING_MOVES single rows change sides where that brings the words nearer to their total.
    """
    before, p = list(p), list(p)
    eps = 1e-9
    live: list[int] = []

    def move(units: list[int], u: list[float]) -> None:
        up = down = float("inf")
        for i, d in zip(units, u):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, p[i] / -d), min(down, (1 - p[i]) / -d)
        step = up if rng.random() * (up + down) < down else -down
        for i, d in zip(units, u):
            x = p[i] + step * d
            p[i] = 0.0 if x < eps else 1.0 if x > 1 - eps else x

    for i in sorted(range(len(p)), key=lambda i: -sizes[i]):  # large rows are settled first, so that small ones are left
        if p[i] < eps or p[i] > 1 - eps:
            p[i] = float(round(p[i]))
            continue
        live.append(i)
        while len(live) == 3:
            a, b, c = (sizes[k] for k in live)
            u = [float(b - c), float(c - a), float(a - b)]
            top = max(map(abs, u))
            move(live, [x / top for x in u] if top else [1.0, -1.0, 0.0])
            live = [k for k in live if 0 < p[k] < 1]
    if land:
        if len(live) == 2:
            a, b = (float(sizes[k]) for k in live)
            top = max(a, b)
            move(live, [b / top, -a / top] if a and b else [1.0, -1.0])
            live = [k for k in live if 0 < p[k] < 1]
        for k in live:
            p[k] = 1.0 if rng.random() < p[k] else 0.0
        # a large row that was left may miss the total by its size: exchange single rows while that brings it nearer
        miss = sum(s * x for s, x in zip(sizes, p)) - sum(s * x for s, x in zip(sizes, before))
        free = [i for i in range(len(p)) if 0 < before[i] < 1 and sizes[i]]
        for _ in range(LANDING_MOVES):
            change = lambda i: sizes[i] if p[i] == 0 else -sizes[i]
            best = min(free, key=lambda i: abs(miss + change(i)), default=None)
            if best is None or abs(miss + change(best)) >= abs(miss):
                break
            miss += change(best)
            p[best] = 1 - p[best]
    return p


_SCHEMA = "doc_id bigint, row_key bigint, source_rank bigint, size bigint, source_size bigint, target double, base int, p double, block bigint"


def _settler(seed: int, level: int, last: bool):
    def settle(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by([("row_key", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
        rng = random.Random(f"{seed}:{key[0].as_py()}:{key[1].as_py()}:{level}")
        p = flight(block["size"].to_pylist(), block["p"].to_pylist(), rng, last)
        return block.set_column(block.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    return settle


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block_rows: int = BLOCK_ROWS, seed: int = 7, row_key: Column | None = None) -> DataFrame:
    """(doc_id, row_key, size, source_size, target, copies, taken) of every row.

    copies is 0 to ceil(most); taken = copies x size. Rows of a null source form a source of their own; a null text has
    size 0; sources without words get target 0 and no copies. Chance comes from seed, the source's rank and the block
    alone, so reruns agree. Repeated rows count as rows of their own.
    """
    key = row_key if row_key is not None else F.xxhash64(F.col(id_col), F.col(text_col))
    rows = materialize(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), key.alias("row_key"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(sizes, weights, share, most)
    pi = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # null sources need a key of their own
    named = lambda df: df.withColumn("__key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    joined = join_counted(named(rows), named(targets).withColumn("__n", F.col("n")), "__key", rows.count(), F.xxhash64("row_key", "doc_id"), "inner", "__n")
    blocks = F.ceil(F.col("n") / block_rows)
    joined = joined.select("doc_id", "row_key", "source_rank", "size", "source_size", "target", F.floor(pi).cast("int").alias("base"), (pi - F.floor(pi)).alias("p"), F.pmod(F.xxhash64("row_key", "doc_id"), blocks).alias("block"))
    largest = (sizes.agg(F.max("n")).first()[0] or 0) + block_rows - 1
    blocks_now, level, done = largest // block_rows, 0, []
    pending = joined
    while True:
        last = blocks_now <= 1

        settled = materialize(pending.groupBy("source_rank", "block").applyInArrow(_settler(seed, level, last), _SCHEMA))
        if last:
            done.append(settled)
            break
        done.append(settled.filter(F.col("p").isin(0.0, 1.0)))
        blocks_now = -(-2 * blocks_now // block_rows)
        pending = settled.filter(~F.col("p").isin(0.0, 1.0)).withColumn("block", F.pmod(F.xxhash64("block"), F.lit(blocks_now)))
        level += 1
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    copies = (F.col("base") + F.col("p")).cast("int")
    return whole.select("doc_id", "row_key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with every row repeated as often as mix() says; all columns stay.

    Rows with a null or empty text have no words: they are kept or dropped by chance as their source's share says, and
    sources without words go. Equal rows are interchangeable: one stands for all copies of its group. An empty table
    stays empty. Columns of any name but maps may stand beside.
    """
    # the id beside the hash: rows of different ids are never taken for equal
    keys = {"__key": F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), "__id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1))}
    plan = mix(docs, row_key=keys["__key"], **options).groupBy(F.col("row_key").alias("__key"), F.coalesce("doc_id", F.lit(-1)).alias("__id"))
    plan = materialize(plan.agg(F.sum("copies").cast("int").alias("__copies")).filter("__copies > 0"))
    # equal rows meet before the join, so no key is hot; the plan grows with docs: one join strategy at every size
    joined = docs.withColumns(keys).dropDuplicates(["__key", "__id"]).join(plan.hint("merge"), ["__key", "__id"])
    both = joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns])
