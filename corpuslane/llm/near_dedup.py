"""Near-duplicates by b-bit MinHash with exact confirmation.

Equal shingle sets form a class, of which one representative goes on. Bands of minima give candidates; the low BITS
bits of each minimum, packed in longs, estimate similarity by bit counts, corrected for chance collisions; what the
estimate cannot rule out is confirmed on full sets of 64-bit shingle hashes.

Within a bucket members are first compared with two centres only, so a group of n copies costs n comparisons. Members
that then still lie outside the bucket's largest component are compared with all others, in blocks, so no link is lost
and one stranger among n members costs n comparisons. With HASHES minima in BANDS bands a link of similarity 0.8 misses
all its buckets with probability 5e-8; the estimate's margin is five standard deviations.

Joins on a bucket, a centre, a node or a class spread hot keys by salts that follow from the key's own number of rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, arrow_map, join_counted, looked_up, materialize, remove, scratch_dir, worker_cache

HASHES, BANDS, BITS = 128, 32, 4
ROWS = HASHES // BANDS
MARGIN_SIGMAS = 5.0
#: Members that a task compares with as many others; pairs of a centre that meet its set at once.
BLOCK, STAR = 256, 4096
#: Most bits (as a power of two: 32 MB) of the filter that spares a shuffle of texts.
FILTER_BITS = 28

_U = np.uint64
_RNG = np.random.default_rng(977)
_A = _RNG.integers(0, 1 << 63, HASHES, dtype=_U) * _U(2) + _U(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=_U)
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M2
    x = (x ^ (x >> _U(27))) * _M3
    return x ^ (x >> _U(31))


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of a text: A-Z in lower case, words between ASCII white space."""

    def __init__(self, words: int):
        self.words = words

    def shingles(self, text: str | None) -> np.ndarray:
        parts = (text or "").encode().lower().split()
        if not parts:
            return np.zeros(0, _U)
        # hashing a word costs less than looking it up, and no word stays in the worker
        w = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), _U, len(parts))
        k = min(self.words, len(w))
        n = len(w) - k + 1
        h = np.full(n, k, _U)
        for j in range(k):
            h = _mixed(h * _M1 + w[j : j + n])
        return np.unique(h)


def minima(h: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, ~_U(0), _U)
    for i in range(0, len(h), 4096):
        np.minimum(out, (h[i : i + 4096, None] * _A + _B).min(0), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    rows = m.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=_U)
    for j in range(ROWS):
        key = _mixed(key * _M1 + rows[:, j])
    return key.view(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    low = (m & _U((1 << BITS) - 1)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).view(np.int64)


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures: matching minima counted by bits, less those that match by chance."""
    low = F.lit(0x1111111111111111)
    total = F.lit(0)
    for i in range(HASHES * BITS // 64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        any_bit = x
        for s in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftright(x, s))
        total = total + F.bit_count(any_bit.bitwiseAND(low))
    chance = 1.0 / (1 << BITS)
    return ((HASHES - total) / float(HASHES) - chance) / (1 - chance)


def least_estimate(similarity: float) -> float:
    chance = 1.0 / (1 << BITS)
    c = similarity + (1 - similarity) * chance
    return similarity - MARGIN_SIGMAS * (c * (1 - c) / HASHES) ** 0.5 / (1 - chance)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, key (digest of the set; null for an empty one), sig, bands of every row."""

    def make():
        shingler = worker_cache("shingler", str(words), lambda: Shingler(words))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, keys, sigs, bands = [], [], [], []
            for t in batch.column(1):
                h = shingler.shingles(t.as_py())
                n.append(len(h))
                if len(h):
                    m = minima(h)
                    keys.append(_set_key(h))
                    sigs.append(packed(m))
                    bands.append(band_keys(m))
                else:
                    keys.append(None)
                    sigs.append(None)
                    bands.append(None)
            many = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, many), pa.array(bands, many)], names=["doc_id", "text_hash", "n_shingles", "key", "sig", "bands"])

        return step

    data = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    return arrow_map(data, make, "doc_id bigint, text_hash bigint, n_shingles bigint, key binary, sig array<bigint>, bands array<bigint>")


def _set_key(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, shingles array<bigint>) of the documents in wanted (rep, doc_id, key).

    A filter of at most 2^FILTER_BITS bits, whatever the number of rows, goes to the tasks, so that few other texts are
    shingled and shuffled; the join then drops the filter's false hits.
    """
    spark = docs.sparkSession
    size = 1 << max(16, min(FILTER_BITS, (8 * wanted.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    words64 = wanted.select(place(F.col("doc_id")).alias("p")).groupBy((F.col("p") / 64).cast("bigint").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(p, 64) as int))) as b")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[words64["w"].to_numpy()] = words64["b"].to_numpy()
    shared = spark.sparkContext.broadcast(bits.view(_U))

    def make():
        shingler, table = worker_cache("shingler", str(words), lambda: Shingler(words)), shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = batch.column(2).to_numpy()
            hit = np.nonzero(table[p >> 6] >> (p & 63).astype(_U) & _U(1))[0]
            part = batch.take(pa.array(hit))
            sets = [shingler.shingles(t.as_py()) for t in part.column(1)]
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(_set_key, sets)), pa.binary()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], names=["doc_id", "key", "shingles"])

        return step

    data = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull()).withColumn("p", place(F.col("doc_id")))
    found = arrow_map(data, make, "doc_id bigint, key binary, shingles array<bigint>").dropDuplicates(["doc_id", "key"])
    return found.join(wanted, ["doc_id", "key"]).select("rep", "shingles")


def attached(pairs: DataFrame, end: str, other: str, table: DataFrame, column: str) -> DataFrame:
    """pairs (a, b, salts) with `column` of table (rep, ...) for rep = end; a hot end's row is repeated for its salts."""
    need = pairs.groupBy(end).agg(F.max("salts").alias("__n"))
    right = table.select(F.col("rep").alias(end), F.col(table.columns[-1]).alias(column)).join(need, end)
    right = right.select(end, column, F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__salt"))
    left = pairs.withColumn("__salt", F.pmod(F.xxhash64(other), F.col("salts")).cast("int"))
    return left.join(right, [end, "__salt"]).drop("__salt")


def likely(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, salts) whose signatures (rep, sig) look similar enough."""
    both = attached(attached(pairs, "a", "b", sigs, "ga"), "b", "a", sigs, "gb")
    return both.filter(estimate(F.col("ga"), F.col("gb")) >= least).select("a", "b", "salts")


def confirmed(pairs: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """The pairs (a, b) of pairs (a, b, salts) with whole * intersection >= part * union of their sets (rep, shingles)."""
    both = F.size(F.array_intersect("sa", "sb"))
    joined = attached(attached(pairs, "a", "b", sets, "sa"), "b", "a", sets, "sb")
    joined = joined.select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
    return joined.filter(whole * F.col("i") >= part * (F.col("t") - F.col("i"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): the least node that it reaches.

    Alternates large-star and small-star steps until the edges stay as they are. Groups are only aggregated and joined,
    never collected, so a node of any degree is fine. No edges give no rows.
    """
    spark = edges.sparkSession
    path = scratch_dir(spark)
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), path)
    state = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = state(now)
    with_least = lambda e, n: join_counted(e, e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "a", n, F.xxhash64("b"))
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        middle, last = scratch_dir(spark), path
        large = with_least(both, 2 * before[0]).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        large = materialize(large, middle)
        near = with_least(large, large.count())
        path = scratch_dir(spark)
        now = materialize(near.select("a", F.col("m").alias("b")).unionByName(near.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), path)
        remove(spark, middle)
        remove(spark, last)
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _salts(size: str):
    return F.ceil(F.col(size) / STAR).cast("int").alias("salts")


def _linked(reps: DataFrame, docs: DataFrame, words: int, part: int, whole: int) -> DataFrame:
    """(node, component) of the classes in reps (rep, doc_id, key, sig, bands) that link with another one."""
    least = least_estimate(part / whole)
    sigs = reps.select("rep", "sig")
    spread = reps.select("rep", F.explode("bands").alias("bucket"))
    buckets = spread.groupBy("bucket").agg(F.min("rep").alias("c1"), F.min_by("rep", F.xxhash64("rep")).alias("c2"), F.count("*").alias("n")).filter("n > 1").withColumn("size", F.col("n"))
    members = materialize(join_counted(spread, buckets, "bucket", BANDS * reps.count(), F.xxhash64("rep")))
    wanted = materialize(members.select("rep").distinct().join(reps.select("rep", "doc_id", "key"), "rep"))
    sets = materialize(full_sets(docs, wanted, words))
    star = members.select("rep", "size", F.explode(F.array_distinct(F.array("c1", "c2"))).alias("c")).filter("rep <> c")
    star = star.groupBy(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).agg(F.max("size").alias("size")).select("a", "b", _salts("size"))
    first = materialize(components(confirmed(likely(star, sigs, least), sets, part, whole)))
    # what two centres left apart: in buckets with several components, members outside the largest one against all
    placed = members.select("bucket", "rep").join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = materialize(placed)
    each = placed.groupBy("bucket", "component").agg(F.count("*").alias("m"))
    top = each.groupBy("bucket").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("n"), F.count("*").alias("kinds")).filter("kinds > 1")
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    top = top.select("bucket", "n", F.col("n").alias("size"), F.col("top.component").alias("top"), blocks(F.col("n")).alias("all_blocks"), blocks(F.col("n") - F.col("top.m")).alias("few_blocks"))
    open_rows = join_counted(placed, top, "bucket", placed.count(), F.xxhash64("rep")).join(sigs, "rep")
    open_rows = materialize(open_rows.withColumn("few", F.col("component") != F.col("top")))
    left = open_rows.filter("few").select("bucket", "size", F.pmod(F.xxhash64("rep"), "few_blocks").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("j"), F.col("rep").alias("x"), F.col("component").alias("cx"), F.col("sig").alias("gx"))
    right = open_rows.select("bucket", F.explode(F.sequence(F.lit(0), F.col("few_blocks") - 1)).alias("i"), F.pmod(F.xxhash64("rep", "bucket"), "all_blocks").cast("int").alias("j"), F.col("rep").alias("y"), F.col("component").alias("cy"), F.col("sig").alias("gy"), "few")
    across = left.join(right, ["bucket", "i", "j"]).filter((F.col("cx") != F.col("cy")) & (~F.col("few") | (F.col("x") < F.col("y"))) & (estimate(F.col("gx"), F.col("gy")) >= least))
    across = across.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("size").alias("size")).select("a", "b", _salts("size"))
    late = materialize(confirmed(materialize(across), sets, part, whole))
    at = lambda n, c: first.select(F.col("node").alias(n), F.col("component").alias(c))
    joined = looked_up(looked_up(late, "a", at("a", "ca"), F.xxhash64("b")), "b", at("b", "cb"), F.xxhash64("a"))
    second = materialize(components(joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))))
    final = looked_up(first, "component", second.select(F.col("node").alias("component"), F.col("component").alias("last")), F.xxhash64("node"))
    final = final.select("node", F.coalesce("last", "component").alias("component"))
    # nodes that only the second round linked
    return final.unionByName(second.join(first, "node", "left_anti").select("node", "component"))


def _rows(docs: DataFrame, words: int, part: int, whole: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component (a number of the component; null where a row links with nothing), component_id of every row."""
    sigs = materialize(signatures(docs, words))
    some = sigs.filter(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    reps = some.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.count("*").alias("n"))
    # once written, the numbers stay
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()))
    final = materialize(_linked(reps, docs, words, part, whole))
    classes = reps.select("rep", "key", "doc_id", "n").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    classes = materialize(classes.select("key", "doc_id", "n", F.coalesce("component", "rep").alias("component")))
    ids = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_key = looked_up(classes.select("key", F.col("n").alias("rows"), "component"), "component", ids, F.xxhash64("key"))
    rows = join_counted(sigs.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")), of_key.withColumnRenamed("rows", "n"), "key", sigs.count(), F.xxhash64("doc_id"), "left")
    return rows.select("doc_id", "text_hash", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Rows link where whole * intersection >= part * union of their shingle sets; component_id is the least id reachable.
    A null or wordless text links with nothing and keeps its own id. A null id takes no part: component_id is null and
    kept true. Rows of one id with different texts are rows of their own, linked only as their texts are. Repeated rows
    give repeated results, an empty table none.
    """
    rows = _rows(docs, words, part, whole).select("doc_id", "n_shingles", "component_id")
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, words: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """docs without the near-duplicates: of each component one row of least id stays, with all its columns.

    Of several such rows that of the least text hash stays, then that of the least hash of all columns. Rows with a
    null id, and null or wordless texts, all stay; an empty table stays empty. Columns of any name may stand beside.
    """
    found = _rows(docs, words, part, whole).filter(F.col("component").isNotNull())
    # one row a text: copies are counted, of the rest of the component the least one is taken
    texts = materialize(found.groupBy("component", F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.count("*").alias("__n")))
    kept = texts.groupBy("component").agg(F.min(F.struct("__id", "__hash", "__n")).alias("k")).select("k.*").withColumn("__rows", F.col("__n"))
    typed = docs.withColumn("__id", F.col("doc_id").cast("bigint")).withColumn("__hash", F.xxhash64(F.col("text").cast("string")))
    wordless = F.col("__id").isNull() | ~F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t])
    # kept grows with docs: one join strategy at every size
    joined = join_counted(typed.filter(~wordless).withColumn("__own", own), materialize(kept).hint("merge"), ["__id", "__hash"], docs.count(), F.col("__own"), "inner", "__n")
    single = joined.filter(F.col("__rows") == 1).select(*columns)
    several = joined.filter(F.col("__rows") > 1).groupBy("__id", "__hash").agg(F.min_by(F.struct(*columns), "__own").alias("__row"))
    several = several.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
    return single.unionByName(several).unionByName(typed.filter(wordless).select(*columns))
