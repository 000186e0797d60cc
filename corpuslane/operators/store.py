"""Entities, relationships and provenance: updates by credibility, and rule-based resolution."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING, OVERWRITE, CREDIBILITY = "missing", "overwrite", "credibility"
#: Entities of an item that travel in one row.
MOST_LISTED = 256


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def insert(entities: DataFrame, new: DataFrame, meta: DataFrame, module: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """(entities, provenance) after an insert: each new row also gets a provenance row."""
    rows = entities.unionByName(new.drop("credibility"), allowMissingColumns=True)
    log = new.select(F.col("id").alias("entity_id"), F.lit(module).cast("bigint").alias("module_id"), "credibility", now.alias("changed"))
    return rows, meta.unionByName(log)


def update(old: DataFrame, new: DataFrame, key: str, behaviour: str) -> DataFrame:
    """old with the values of new rows of the same key; both carry credibility.

    missing fills nulls, overwrite takes every new value that isn't null, credibility does so where the new row's is
    higher. Rows of new without an old one are left out; credibility becomes the larger of those that were used.
    """
    columns = [c for c in old.columns if c not in (key, "credibility")]
    n = new.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.col("credibility").alias("__cred"))
    joined = old.join(n, key, "left")
    if behaviour == MISSING:
        pick = lambda c: F.coalesce(F.col(c), F.col(f"__{c}"))
    elif behaviour == OVERWRITE:
        pick = lambda c: F.coalesce(F.col(f"__{c}"), F.col(c))
    elif behaviour == CREDIBILITY:
        higher = F.col("__cred") > F.coalesce("credibility", F.lit(-1))
        pick = lambda c: F.when(higher, F.coalesce(F.col(f"__{c}"), F.col(c))).otherwise(F.col(c))
    else:
        raise ValueError(f"unknown behaviour {behaviour}")
    return joined.select(key, *[pick(c).alias(c) for c in columns], F.greatest("credibility", "__cred").alias("credibility"))


def meta_latest(meta: DataFrame, key: str = "entity_id", order: str = "changed") -> DataFrame:
    """The latest (credibility, changed) of every entity."""
    return meta.groupBy(key).agg(F.max(F.struct(order, "credibility")).alias("m")).select(key, F.col("m.credibility").alias("credibility"), F.col(f"m.{order}").alias(order))


def relate(edges: DataFrame, new: DataFrame, pair: list[str]) -> DataFrame:
    """edges with the new pairs that they lack."""
    return edges.unionByName(new.dropDuplicates(pair).join(edges.select(*pair), pair, "left_anti").select(*edges.columns))


def set_parent(children: DataFrame, links: DataFrame, key: str, parent: str) -> DataFrame:
    """A one-to-many relationship stored on the child: parent keys from links (key, parent)."""
    return children.join(links.select(key, F.col(parent).alias("__p")), key, "left").withColumn(parent, F.coalesce("__p", parent)).drop("__p")


def contains(entities: DataFrame, probes: DataFrame, on: list[str]) -> DataFrame:
    """probes with `found`: whether entities have a row with the same values."""
    known = entities.select(*on).distinct().withColumn("__f", F.lit(True))
    return probes.join(known, on, "left").withColumn("found", F.coalesce("__f", F.lit(False))).drop("__f")


def is_empty(entities: DataFrame, key: str = "id") -> Column:
    """Whether a row has no attribute but its key."""
    return F.coalesce(*[F.col(c).cast("string") for c in entities.columns if c != key]).isNull()


def import_graph(parents: DataFrame, known: DataFrame, children: DataFrame, links: DataFrame, rules: list[list[str]], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(parents, children) after an import of parents and then of children.

    A parent that a rule finds among the known ones (same columns) takes their key; children get the key of the parent
    that links (key, parent) names, null where that parent is neither known nor imported.
    """
    probes = parents.withColumnRenamed(key, "probe_id")
    found = lookup_exact(probes, known, rules, key)
    resolved = probes.select("probe_id").join(found, "probe_id", "left").select("probe_id", F.coalesce(key, "probe_id").alias(key))
    new = probes.join(found, "probe_id", "left_anti").withColumnRenamed("probe_id", key)
    mapped = links.join(resolved.withColumnRenamed(key, "__k"), links["parent"] == F.col("probe_id")).select(links[key], F.col("__k").alias("parent"))
    return known.unionByName(new.select(*known.columns)), set_parent(children, mapped, key, "parent")


def own_attributes(entities: DataFrame, key: str = "id") -> DataFrame:
    """(key, attribute, value) of every attribute that is set."""
    rest = [c for c in entities.columns if c != key]
    text = entities.select(key, *[F.col(c).cast("string").alias(c) for c in rest])
    return text.unpivot([key], rest, "attribute", "value").filter("value is not null")


def prearrange(entities: DataFrame, title: str, normalize) -> DataFrame:
    """Adds title_normalized and drops rows without a title."""
    return entities.filter(blank_to_null(F.col(title)).isNotNull()).withColumn("title_normalized", normalize(F.col(title)))


def lookup_exact(probes: DataFrame, entities: DataFrame, rules: list[list[str]], key: str = "id", probe_key: str = "probe_id") -> DataFrame:
    """(probe_key, key, rule_no): by rules, lists of attributes that must all be equal and set; longer lists go first.

    One equi-join a rule; of several hits the first rule's holds, then the smallest key.
    """
    hits = []
    for no, rule in enumerate(sorted(rules, key=lambda r: -len(r))):
        known = entities.groupBy(*rule).agg(F.min(key).alias(key)).dropna(subset=rule)
        hits.append(probes.join(known, rule).select(probe_key, key, F.lit(no).alias("rule_no")))
    every = reduce(lambda a, b: a.unionByName(b), hits)
    return every.groupBy(probe_key).agg(F.min(F.struct("rule_no", key)).alias("m")).select(probe_key, F.col(f"m.{key}").alias(key), F.col("m.rule_no").alias("rule_no"))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def _most_shared(met: DataFrame, least: int) -> DataFrame:
    """(probe_id, id, shared): the ids that most of a probe's lists (probe_id, ids) hold, all of equals, from `least` lists.

    Lists come sorted by probe, so what is kept from batch to batch are the counts of one probe.
    """
    kinds = {"probe_id": met.schema["probe_id"].dataType, "id": met.schema["ids"].dataType.elementType}

    def run(batches):
        kept = None
        for b in batches:
            if not b.num_rows:
                continue
            # pairs as numbers: place of the probe, then of the id
            probes, ids = b.column(0).dictionary_encode(), b.column(1).flatten().dictionary_encode()
            n = max(len(ids.dictionary), 1)
            owners = probes.indices.to_numpy().astype(np.int64)[pc.list_parent_indices(b.column(1)).to_numpy()]
            pairs, counts = np.unique(owners * n + ids.indices.to_numpy(), return_counts=True)
            counted = pa.table({"probe_id": probes.dictionary.take(pa.array(pairs // n)), "id": ids.dictionary.take(pa.array(pairs % n)), "n": pa.array(counts, pa.int64())})
            if kept is not None:
                same = pc.equal(counted["probe_id"], kept["probe_id"][0])
                both = pa.concat_tables([kept, counted.filter(same)]).group_by(["probe_id", "id"], use_threads=False).aggregate([("n", "sum")])
                counted = pa.concat_tables([both.select(["probe_id", "id", "n_sum"]).rename_columns(["probe_id", "id", "n"]), counted.filter(pc.invert(same))])
            open_ = pc.equal(counted["probe_id"], b.column(0)[-1])
            yield from best(counted.filter(pc.invert(open_)))
            kept = counted.filter(open_) if pc.any(open_).as_py() else None
        if kept is not None:
            yield from best(kept)

    def best(counted):
        if not counted.num_rows:
            return []
        at = counted["probe_id"].combine_chunks().dictionary_encode()
        at, n = at.indices.to_numpy(), counted["n"].to_numpy()
        most = np.full(at.max() + 1, least, np.int64)
        np.maximum.at(most, at, n)
        return counted.filter(pa.array(n == most[at])).rename_columns(["probe_id", "id", "shared"]).to_batches()

    schema = ", ".join(f"{c} {kind.simpleString()}" for c, kind in kinds.items()) + ", shared bigint"
    return met.repartition("probe_id").sortWithinPartitions("probe_id").mapInArrow(run, schema)


def lookup_related(probe_edges: DataFrame, entity_edges: DataFrame, probes: DataFrame, entities: DataFrame, least: int, title: str = "title") -> DataFrame:
    """(probe_id, id, shared): the entity that shares at least `least` related items with a probe.

    Most shared items first, then the more similar title, then the smaller id.
    """
    # an item once a row on either side, so counts need no second look at the items; the entities of an item travel to its
    # probes as lists, and pairs are made where they are counted
    edges = entity_edges.select("id", "item").distinct().join(entities.select("id"), "id", "left_semi")
    listed = edges.groupBy("item").agg(F.collect_list("id").alias("ids"))
    cut = F.transform(F.sequence(F.lit(0), (F.size("ids") - 1).cast("int"), F.lit(MOST_LISTED)), lambda i: F.slice("ids", i + 1, MOST_LISTED))
    lists = listed.select("item", F.explode(cut).alias("ids"))
    met = probe_edges.select("probe_id", "item").distinct().join(lists, "item").filter(F.col("probe_id").isNotNull()).select("probe_id", "ids")
    shared = _most_shared(met, least)
    named = shared.join(probes.select("probe_id", F.col(title).alias("pt")), "probe_id").join(entities.select("id", F.col(title).alias("et")), "id")
    rank = F.row_number().over(Window.partitionBy("probe_id").orderBy(F.desc("shared"), F.desc(F.round(similarity(F.col("pt"), F.col("et")), 9)), "id"))
    return named.withColumn("r", rank).filter("r = 1").select("probe_id", "id", "shared")
