"""Dictionaries as tables (key, values array<string>): membership, translation, text search, union, and hierarchies.

Joins leave the side to Catalyst, which broadcasts a dictionary when its size says so and shuffles it otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a dictionary up to which they are sought within a text; more of them are found by the join.
MOST_KNOWN = 10_000
SENSITIVE, INSENSITIVE, FIRST_UPPER = "sensitive", "insensitive", "first_upper"


def few_keys(words: DataFrame) -> list[str] | None:
    """All keys of a dictionary (key) of at most MOST_KNOWN, else None."""
    found = words.select("key").filter("key is not null").distinct().limit(MOST_KNOWN + 1).collect()
    return sorted(r["key"] for r in found) if len(found) <= MOST_KNOWN else None


def create(rows: DataFrame, key: str, value: str) -> DataFrame:
    """A dictionary of key -> sorted distinct values."""
    return rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_set(value)).alias("values"))


def info(words: DataFrame) -> DataFrame:
    """One row: n_keys, n_values (distinct), min_key_length, simple_keys (no key has anything but letters, digits, _)."""
    flat = words.select(F.explode_outer("values").alias("v")).agg(F.count_distinct("v").alias("n_values"))
    keys = words.agg(F.count("*").alias("n_keys"), F.min(F.length("key")).alias("min_key_length"), F.bool_and(~F.col("key").rlike("[^A-Za-z0-9_]")).alias("simple_keys"))
    return keys.crossJoin(flat)  # one row each


def contains_key(rows: DataFrame, text: str, words: DataFrame, mode: str = SENSITIVE) -> DataFrame:
    """Rows whose text is a key; first_upper also turns down a text that begins with a small letter."""
    c = F.col(text)
    if mode == SENSITIVE:
        return rows.join(words.select(F.col("key").alias(text)).distinct(), text, "left_semi")
    low = words.select(F.lower("key").alias("__k")).distinct()
    hits = rows.join(low, F.lower(c) == F.col("__k"), "left_semi")
    return hits.filter(~c.rlike("^[a-z]")) if mode == FIRST_UPPER else hits


def contains_value(rows: DataFrame, text: str, words: DataFrame) -> DataFrame:
    return rows.join(words.select(F.explode("values").alias(text)).distinct(), text, "left_semi")


def translate(rows: DataFrame, text: str, words: DataFrame) -> DataFrame:
    """rows with `values`, null where text is no key."""
    return rows.join(words.withColumnRenamed("key", text), text, "left")


def text_search(rows: DataFrame, key: str, text: str, words: DataFrame, most_words: int = 1) -> DataFrame:
    """(key, pos, hit) of every dictionary key of up to most_words words in text, with repetition.

    Punctuation counts as a blank. Of hits that start at one word the longest holds; a hit inside an earlier one
    doesn't (leftmost, non-overlapping).
    """
    split = F.filter(F.split(F.regexp_replace(F.col(text), "[^A-Za-z0-9_À-ÿ-]", " "), " "), lambda w: w != "")
    cut = rows.select(key, split.alias("w"))
    if most_words == 1:
        each = cut.select(key, F.posexplode("w").alias("pos", "hit"))
        if (few := few_keys(words)) is not None:
            return each.filter(F.col("hit").isin(few))
        return each.join(words.select(F.col("key").alias("hit")), "hit", "left_semi").select(key, "pos", "hit")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most_words), F.size("w") - i + 1)), lambda n: F.struct((i - 1).alias("pos"), n.alias("n"), F.array_join(F.slice(F.col("w"), i, n), " ").alias("hit")))))
    found = cut.filter(F.size("w") > 0).select(key, F.explode(spans).alias("s")).select(key, "s.*").join(words.select(F.col("key").alias("hit")), "hit", "left_semi")
    best = found.groupBy(key, "pos").agg(F.max(F.struct("n", "hit")).alias("b"))
    listed = best.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", F.col("b.n").alias("n"), F.col("b.hit").alias("hit")))).alias("l"))
    pick = F.aggregate("l", F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<pos:int,hit:string>>").alias("kept")), lambda a, x: F.when(x["pos"] >= a["end"], F.struct((x["pos"] + x["n"]).alias("end"), F.array_append(a["kept"], F.struct(x["pos"].alias("pos"), x["hit"].alias("hit"))).alias("kept"))).otherwise(a), lambda a: a["kept"])
    return listed.select(key, F.explode(pick).alias("h")).select(key, "h.pos", "h.hit")


def starts_with(words: DataFrame, prefix: str) -> DataFrame:
    return words.filter(F.col("key").startswith(prefix))


def extend(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of keys, and of the values of each."""
    both = a.unionByName(b).select("key", F.explode_outer("values").alias("v"))
    return both.groupBy("key").agg(F.sort_array(F.collect_set("v")).alias("values"))


def add(words: DataFrame, new: DataFrame, append: bool = True) -> DataFrame:
    """Insert keys; a key that exists gets the values too (append) or stays as it is."""
    return extend(words, new) if append else words.unionByName(new.join(words.select("key"), "key", "left_anti").select(*words.columns))


def go_up(rows: DataFrame, name: str, *levels: tuple[str, DataFrame, int]) -> DataFrame:
    """Follow name through dictionaries: (column, dictionary, which value: 1 the first, -1 the last) for each level."""
    for column, words, which in levels:
        step = words.select(F.col("key").alias("__k"), F.try_element_at("values", F.lit(which)).alias(column))
        rows = rows.join(step, F.col(name) == F.col("__k"), "left").drop("__k")
        name = column
    return rows


def is_simple(c: Column) -> Column:
    return ~c.rlike("[^A-Za-z0-9_]")
