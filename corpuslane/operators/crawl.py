"""Focused crawl over a table of pages and links: ranking pages by what links to them and what their headers say."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keyword patterns from the most to the least telling.
PATTERNS = ("deliverables?", "public documents", "documents", "publications?", "results?", "outputs?", "library", "downloads?", "reports?", "work ?packages?")
TIERS = (1, 2, len(PATTERNS))
DOCUMENTS = {"pdf": "application/pdf", "ps": "application/postscript", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "odt": "application/vnd.oasis.opendocument.text", "rtf": "application/rtf", "zip": "application/zip", "html": "text/html", "htm": "text/html", "txt": "text/plain"}
ERRORS = {1: "no start address", 2: "the page could not be read", 3: "no page found", 4: "no record found"}


def suffix(url: Column) -> Column:
    """The suffix of the path in lower case; null where the address has a query or none."""
    return F.when(~url.contains("?"), F.nullif(F.lower(F.regexp_extract(url, r"^[a-z]+://[^/]+/(?:[^/#]*/)*[^/#]*\.([A-Za-z0-9]+)(?:#.*)?$", 1)), F.lit("")))


def mime(links: DataFrame, url: str = "url") -> DataFrame:
    """links with the MIME type of their suffix, null for an unknown one."""
    spark = links.sparkSession
    table = F.broadcast(spark.createDataFrame(list(DOCUMENTS.items()), "__s string, mime string"))
    return links.withColumn("__s", suffix(F.col(url))).join(table, "__s", "left").drop("__s")


def file_name(url: Column) -> Column:
    """The last part of the path."""
    return F.regexp_extract(url, r"^[a-z]+://[^/]+/(?:[^?#]*/)?([^/?#]*)", 1)


def store_name(url: Column) -> Column:
    """A file name for an address: colons as full stops, slashes, question and hash marks dropped."""
    return F.regexp_replace(F.replace(url, F.lit(":"), F.lit(".")), "[/?#]", "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-z]+://([^/:?#]+)", 1))


def same_domain(a: Column, b: Column) -> Column:
    """Whether two addresses have one host, a leading www. or wiki. aside."""
    bare = lambda u: F.regexp_replace(host(u), r"^(www|wiki)\.", "")
    return bare(a) == bare(b)


def _first(hay: Column, patterns: tuple[str, ...]) -> Column:
    """Number of the first pattern that matches; one that ends in an optional s and is plain otherwise is a mere search."""
    stems = [p.removesuffix("s?") for p in patterns]
    return F.coalesce(*[F.when(hay.contains(s) if re.fullmatch("[a-z0-9 ]+", s) else hay.rlike(p), i) for i, (p, s) in enumerate(zip(patterns, stems))])


def level_rank(links: DataFrame, patterns: tuple[str, ...] = PATTERNS) -> DataFrame:
    """(page, rank, documents): links (page, base, url, text, mime) that match a pattern add to their page.

    A wanted document adds 10, and 100 more if its name looks like D<number>; an html page adds twice the number of
    patterns for the first and that number less i for pattern i. Scripts, mail addresses, addresses over 200
    characters and other domains don't count.
    """
    k = len(patterns)
    # columns instead of filters: a filter would be pushed below them and work them out again
    url = F.when(F.contains("url", F.lit("#")), F.regexp_replace("url", "#.*$", "")).otherwise(F.col("url"))
    low = F.lower("url")
    near = links.withColumn("url", url).withColumns({"hay": F.lower(F.concat_ws(" ", "text", "url")), "fit": ~(low.startswith("javascript:") | low.startswith("mailto:")) & (F.length("url") <= 200)})
    same = near.withColumn("fit", F.col("fit") & same_domain(F.col("base"), F.col("url")))
    hit = same.withColumn("i", F.when(F.col("fit"), _first(F.col("hay"), patterns)))
    document = F.col("mime").isNotNull() & (F.col("mime") != "text/html")
    weight = F.when(document, 10 + F.when(F.lower(file_name(F.col("url"))).rlike(r"^d[0-9]"), 100).otherwise(0)).otherwise(F.when(F.col("i") == 0, 2 * k).otherwise(k - F.col("i")))
    found = hit.groupBy("page").agg(F.sum(F.when(F.col("i").isNotNull(), weight)).alias("rank"), F.count_if(document & F.col("i").isNotNull()).alias("documents"))
    return found.filter("rank is not null")


def title_rank(headers: DataFrame, patterns: tuple[str, ...] = PATTERNS) -> DataFrame:
    """(page, rank): headers (page, text) add four times the number of patterns for the first, else that number less i."""
    k = len(patterns)
    first = _first(F.lower("text"), patterns)
    return headers.withColumn("i", first).filter("i is not null").groupBy("page").agg(F.sum(F.when(F.col("i") == 0, 4 * k).otherwise(k - F.col("i"))).alias("rank"))


def anchor_rank(links: DataFrame, patterns: tuple[str, ...] = PATTERNS) -> DataFrame:
    """(url, rank): 10 for an address that an anchor of the first pattern leads to."""
    return links.filter(F.lower("text").rlike(patterns[0])).groupBy("url").agg(F.lit(10).cast("bigint").alias("rank"))


def cascade(links: DataFrame, patterns: tuple[str, ...] = PATTERNS) -> DataFrame:
    """links of the best tier that a page has: the first pattern, then the next two, then the rest, then all."""
    hay = F.lower(F.concat_ws(" ", "text", "url"))
    tier = F.when(hay.rlike(patterns[0]), 0).when(hay.rlike("|".join(patterns[1:3])), 1).when(hay.rlike("|".join(patterns[3:])), 2).otherwise(3)
    marked = links.withColumn("tier", tier)
    best = marked.groupBy("page").agg(F.min("tier").alias("tier"))
    return marked.join(best, ["page", "tier"])


def frontier(parts: list[DataFrame]) -> DataFrame:
    """(url, rank): the ranks of all parts added up."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("url").agg(F.sum("rank").alias("rank"))


def unvisited(front: DataFrame, visited: DataFrame) -> DataFrame:
    return front.join(visited.select("url").distinct(), "url", "left_anti")


def best_page(front: DataFrame, group: str | None = None) -> DataFrame:
    """The address of highest rank (of equals the first by name), by group if one is named."""
    top = F.min(F.struct((-F.col("rank")).alias("r"), "url"))
    out = (front.groupBy(group) if group else front.groupBy()).agg(top.alias("b"))
    return out.select(*([group] if group else []), F.col("b.url").alias("url"), (-F.col("b.r")).alias("rank"))


def crawl(start: str, links: DataFrame, most: int = 10) -> list[str]:
    """Addresses in the order of their discovery from start, until none is new or `most` are known.

    links (base, url) stand in for the web. A site's frontier is at most `most` addresses, so it lives on the driver.
    """
    known, open_ = [start], [start]
    while open_ and len(known) < most:
        found = links.filter(F.col("base").isin(open_)).select("url").distinct().orderBy("url").limit(most + len(known)).collect()
        open_ = [r["url"] for r in found if r["url"] not in known][: most - len(known)]
        known += open_
    return known
