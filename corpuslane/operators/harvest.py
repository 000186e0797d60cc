"""Change detection, projection and upsert of harvested records."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_by_years(rows: DataFrame, start: str, end: str) -> DataFrame:
    """One row for every calendar year of [start, end], clipped at both ends, as from_date and to_date."""
    years = F.sequence(F.year(start), F.year(end))
    out = rows.filter(F.col(start) <= F.col(end)).withColumn("__y", F.explode(years))
    return out.withColumns({"from_date": F.greatest(F.col(start), F.make_date("__y", F.lit(1), F.lit(1))), "to_date": F.least(F.col(end), F.make_date("__y", F.lit(12), F.lit(31)))}).drop("__y")


def parse_dmy(c: Column) -> Column:
    """dd/MM/yyyy as a date, null if it is none."""
    return F.try_to_date(c, "dd/MM/yyyy") if hasattr(F, "try_to_date") else F.to_date(c, "dd/MM/yyyy")


def diff_new(crawled: DataFrame, indexed: DataFrame, key: str = "url") -> DataFrame:
    return crawled.join(indexed.select(key), key, "left_anti")


def diff_changed(crawled: DataFrame, indexed: DataFrame, key: str = "url", date: str = "last_update") -> DataFrame:
    """Crawled rows that the index lacks, or has without a date or with an earlier one."""
    old = indexed.select(key, F.col(date).alias("__old"), F.lit(True).alias("__known"))
    return crawled.join(old, key, "left").filter(F.col("__known").isNull() | F.col("__old").isNull() | (F.col(date) > F.col("__old"))).drop("__old", "__known")


def diff_changed_v0(crawled: DataFrame, indexed: DataFrame, key: str = "url", date: str = "last_update") -> DataFrame:
    """Crawled rows whose date differs from the index's, those that it lacks among them."""
    old = indexed.select(key, F.col(date).alias("__old"), F.lit(True).alias("__known"))
    return crawled.join(old, key, "left").filter(F.col("__known").isNull() | ~F.col(date).eqNullSafe(F.col("__old"))).drop("__old", "__known")


def dict_dedup(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every key; aggregated before the shuffle, so a hot key costs one row a task."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(F.col(order).alias("__o"), *rest)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def update_window(rows: DataFrame, date: str, now: datetime.date, weeks: int) -> DataFrame:
    """Rows of the last weeks before now, the day itself included."""
    first = now - datetime.timedelta(weeks=weeks)
    return rows.filter(F.col(date).between(F.lit(first), F.lit(now)))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group without outer blanks; null where nothing matches."""
    return F.nullif(F.trim(F.regexp_extract(c, pattern, group)), F.lit(""))


def scrape(pages: DataFrame, html: str, scalars: dict[str, str], lists: dict[str, str]) -> DataFrame:
    """Columns of first matches (scalars) and of all matches (lists) of patterns with one group."""
    c = F.col(html)
    return pages.withColumns({n: first_group(c, p) for n, p in scalars.items()} | {n: F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(1)), lambda x: F.trim(x)) for n, p in lists.items()})


def costs(c: Column) -> Column:
    """A cost string without its spaces."""
    return F.replace(c, F.lit(" "), F.lit(""))


def programme_split(funded: Column, sub: Column) -> tuple[Column, Column]:
    """(programme, subprogramme): before and after the first dash of funded, else of sub up to its second dash."""
    a, b = first_group(funded, "^([^-]+)-(.*)$", 1), first_group(funded, "^([^-]+)-(.*)$", 2)
    c, d = first_group(sub, "^([^-]+)-([^-]+)", 1), first_group(sub, "^([^-]+)-([^-]+)", 2)
    return F.coalesce(a, c), F.coalesce(b, d)


def year_of(c: Column) -> Column:
    return F.when(F.length(c) > 4, F.substring(c, 1, 4))


def index_guard(rows: DataFrame, needed: tuple[str, ...] = ("year", "title", "last_update")) -> DataFrame:
    return rows.dropna(subset=list(needed))


def upsert(index: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The index after the changes: the last change of a key takes the place of its row."""
    last = dict_dedup(changes, key, order).select(*index.columns)
    return index.join(last.select(key), key, "left_anti").unionByName(last)


def child_counts(children: DataFrame, key: str, converted: str) -> DataFrame:
    return children.groupBy(key).agg(F.count("*").alias("n_found"), F.count(converted).alias("n_ok"))


def denormalize(parents: DataFrame, children: DataFrame, key: str, prefix: str = "deliv_") -> DataFrame:
    """Every child with its parent's columns; its own ones carry the prefix."""
    own = children.select(key, *[F.col(c).alias(prefix + c) for c in children.columns if c != key])
    return parents.join(own, key)


def range_not_missing(rows: DataFrame, needed: str, date: str, first, last) -> DataFrame:
    """Rows that have `needed` and a date in [first, last]; none where first is after last."""
    return rows.filter(F.col(needed).isNotNull() & F.col(date).between(F.lit(first), F.lit(last)))


def field_completeness(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, found, total): how many rows have each field, in one pass."""
    one = rows.agg(F.count("*").alias("total"), *[F.count(f).alias(f) for f in fields])
    return one.select("total", F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*fields))).alias("field", "found")).select("field", "found", "total")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__r = 1").drop("__r")
