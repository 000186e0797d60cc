"""Boosted keyword and phrase search, facets, filters, paging and similar rows over an index of records."""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

#: What words are made of, in lower case.
LETTERS = "a-z0-9à-öø-ÿ"
FIELDS = {"abbr": 6.0, "title": 5.0, "subprogramme": 3.0, "objective": 1.0, "origWeb": 1.0}
FACETS = ("programme", "subprogramme", "year", "coordinator", "participant", "country")


def terms_of(keyword: str) -> list[str]:
    """Distinct lower-case words of a keyword string, in order."""
    return list(dict.fromkeys(w for w in re.split(f"[^{LETTERS}]+", keyword.lower()) if w))


def multi_match(index: DataFrame, keyword: str, boosts: dict[str, float] = FIELDS) -> DataFrame:
    """Rows with a score > 0: the best field's boost x sum of tf x ln(1 + (N - df + 0.5) / (df + 0.5)).

    Document frequencies come from one aggregation of counts; nothing is exploded or shuffled by term.
    An empty keyword gives all rows with score 0.
    """
    words = terms_of(keyword)
    if not words:
        return index.withColumn("score", F.lit(0.0))
    fields = [f for f in boosts if f in index.columns]
    # a word is counted where no letter or digit stands beside it; texts without it cost one look
    low = lambda f: F.lower(F.col(f).cast("string"))
    times = lambda f, w: F.when(low(f).contains(w), F.regexp_count(low(f), F.lit(f"{w}(?<![{LETTERS}]{w})(?![{LETTERS}])"))).otherwise(0)
    tf = {(f, i): times(f, w) for f in fields for i, w in enumerate(words)}
    counted = index.withColumns({f"__{f}_{i}": F.coalesce(c, F.lit(0)) for (f, i), c in tf.items()})
    seen = counted.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"__{f}_{i}") > 0).alias(f"{f}_{i}") for f, i in tf]).first()
    idf = lambda df: F.lit(math.log(1 + (seen["n"] - df + 0.5) / (df + 0.5)))
    score = lambda f: reduce(lambda a, b: a + b, [F.col(f"__{f}_{i}") * idf(seen[f"{f}_{i}"]) for i in range(len(words))]) * boosts[f]
    best = F.greatest(*[score(f) for f in fields]) if len(fields) > 1 else score(fields[0])
    return counted.withColumn("score", F.round(best, 6)).drop(*[f"__{f}_{i}" for f, i in tf]).filter("score > 0")


def phrase_match(index: DataFrame, keyword: str, fields: dict[str, float] = FIELDS) -> DataFrame:
    """Rows one of whose fields has the words of keyword (quotes dropped) next to each other; score: the best such boost."""
    phrase = " " + " ".join(t for t in re.split(f"[^{LETTERS}]+", keyword.replace('"', "").lower()) if t) + " "
    hit = lambda f: F.concat(F.lit(" "), F.array_join(tokens(F.col(f).cast("string")), " "), F.lit(" ")).contains(phrase)
    parts = [F.when(hit(f), F.lit(b)).otherwise(F.lit(0.0)) for f, b in fields.items() if f in index.columns]
    return index.withColumn("score", F.greatest(*parts) if len(parts) > 1 else parts[0]).filter("score > 0")


def highlight(text: Column, keyword: str, before: str = "<b>", after: str = "</b>") -> Column:
    """Every word of keyword in text, whatever its case, between the two marks."""
    words = "|".join(map(re.escape, terms_of(keyword)))
    return F.regexp_replace(text, rf"(?i)\b({words})\b", f"{before}$1{after}") if words else text


def page(hits: DataFrame, number: int | str, size: int = 20, order: list[Column] | None = None) -> DataFrame:
    """Rows of a page, from 0; anything that is no page number counts as 0."""
    try:
        n = max(0, int(number))
    except (TypeError, ValueError):
        n = 0
    return hits.orderBy(*(order or [F.desc("score"), F.asc("id")])).offset(n * size).limit(size)


def _terms(rows: DataFrame, facets: tuple[str, ...]) -> DataFrame:
    """(facet, term) once a row, from all facets in one pass."""
    parts = []
    named = lambda f: lambda v: F.struct(F.lit(f).alias("facet"), v.alias("term"))
    for f in facets:
        values = F.array_distinct(F.transform(F.col(f), lambda v: F.lower(v.cast("string")))) if rows.schema[f].dataType.typeName() == "array" else F.array(F.lower(F.col(f).cast("string")))
        parts.append(F.transform(values, named(f)))
    return rows.select(F.explode(F.concat(*parts)).alias("x")).select("x.*").filter("term is not null")


def facet_counts(rows: DataFrame, facets: tuple[str, ...], size: int = 20) -> DataFrame:
    """(facet, term, n, rank): the size most frequent terms of each facet, all facets in one shuffle."""
    counts = _terms(rows, facets).groupBy("facet", "term").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "term"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= size)


def facet_merge(base: DataFrame, filtered: DataFrame) -> DataFrame:
    """(facet, term, label): `filtered z base` of every base term, 0 where the filtered rows have none."""
    few = filtered.select("facet", "term", F.col("n").alias("m"))
    return base.join(few, ["facet", "term"], "left").select("facet", "term", F.concat_ws(" z ", F.coalesce("m", F.lit(0)).cast("string"), F.col("n").cast("string")).alias("label"))


def facet_filter(rows: DataFrame, chosen: dict[str, list[str]], valid: tuple[str, ...] = FACETS) -> DataFrame:
    """Rows that have, in every valid chosen field, one of its values (without regard to case)."""
    tests = []
    for f, values in chosen.items():
        if f not in valid or not values:
            continue
        low = [v.lower() for v in values]
        if rows.schema[f].dataType.typeName() == "array":
            tests.append(F.exists(f, lambda v: F.lower(v.cast("string")).isin(low)))
        else:
            tests.append(F.lower(F.col(f).cast("string")).isin(low))
    return rows.filter(reduce(and_, tests)) if tests else rows


def filter_parse(options: list[str]) -> dict[str, list[str]]:
    """`field=value` options by field; quotes are dropped, values after the first = stay whole."""
    out: dict[str, list[str]] = {}
    for o in options:
        field, sep, value = o.replace('"', "").partition("=")
        if sep:
            out.setdefault(field, []).append(value)
    return out


def query_serialize(chosen: dict[str, list[str]], keyword: str) -> str:
    """`keyword=K AND f=v`, several values of a field as `(f=b OR f=a)`, the later value first."""
    parts = [f"keyword={keyword}"]
    for f in ("country", "programme", "subprogramme", "coordinator", "participant", "year"):
        values = [v for v in chosen.get(f, []) if v]
        if len(values) == 1:
            parts.append(f"{f}={values[0]}")
        elif values:
            parts.append("(" + " OR ".join(f"{f}={v}" for v in reversed(values)) + ")")
    return " AND ".join(parts)


_SECTION = re.compile(r'keyword=((?:(?:"[\w\s]+"|\w+)(?:\s(?:OR|AND)\s)?)+)(?=\sAND\s\w+=|$)')


def query_parse(text: str) -> str:
    """The keyword section of a canonical query without its ORs; empty if there is none."""
    m = _SECTION.search(text)
    return m[1].replace(" OR", "") if m else ""


def legacy_query(text: str) -> tuple[list[str], dict[str, str]]:
    r"""(keywords, field -> value) of `word field:value field:"a value" "field":value`; `\:` is a plain colon."""
    keywords, specs = [], {}
    for m in re.finditer(r'(?:"([^"]*)"|((?:\\.|[^\s:"\\])+)):(?:"([^"]*)"|(\S+))|"([^"]*)"|((?:\\.|[^\s"])+)', text):
        field = m[1] if m[1] is not None else m[2]
        if field is not None:
            specs[field.replace("\\:", ":")] = (m[3] if m[3] is not None else m[4]).replace("\\:", ":")
        else:
            keywords.append((m[5] if m[5] is not None else m[6]).replace("\\:", ":"))
    return keywords, specs


def get_by_id(index: DataFrame, children: DataFrame, key: str, value, most: int = 50) -> DataFrame:
    """The row of a key with at most `most` of its children, in order of child id."""
    few = children.filter(F.col("parent_id") == value).orderBy("child_id").limit(most)
    return index.filter(F.col(key) == value).limit(1).join(few, F.col(key) == F.col("parent_id"), "left").drop("parent_id")


def more_like_this(index: DataFrame, key, most: int = 3, top_terms: int = 25, id_col: str = "id", text_col: str = "objective") -> DataFrame:
    """The rows most alike a row: the sum of tf x idf over the row's top_terms words of largest tf x idf."""
    source = index.filter(F.col(id_col) == key).select(F.explode(tokens(F.col(text_col))).alias("w")).groupBy("w").agg(F.count("*").alias("tf"))
    # the words of one row bound what is broadcast and collected
    words = F.broadcast(source)
    n = index.count()
    df = index.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("w")).join(words, "w").groupBy("w", "tf").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    top = df.withColumn("idf", idf).orderBy(F.desc(F.round(F.col("tf") * F.col("idf"), 9)), "w").limit(top_terms)
    rows = index.filter(F.col(id_col) != key).select(id_col, F.explode(tokens(F.col(text_col))).alias("w")).join(F.broadcast(top), "w")
    return rows.groupBy(id_col).agg(F.round(F.sum("idf"), 6).alias("score")).orderBy(F.desc("score"), id_col).limit(most)
