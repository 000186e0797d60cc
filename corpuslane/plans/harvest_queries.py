"""Harvest queries; events and orders stand in for crawls, lineitem for the children of a project."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import harvest as H
from .registry import query

INDEXED = "indexed AS (SELECT o_orderkey AS url, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS last_update, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0)"
CRAWLED = "crawled AS (SELECT o_orderkey AS url, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 2 AS INT) AS last_update, o_totalprice + 1 AS v FROM orders)"


def indexed(t):
    d = t.orders.filter("o_orderkey % 3 <> 0")
    return d.select(F.col("o_orderkey").alias("url"), F.when(F.col("o_orderkey") % 11 != 0, F.to_date("o_orderdate")).alias("last_update"), F.col("o_totalprice").alias("v"))


def crawled(t):
    return t.orders.select(F.col("o_orderkey").alias("url"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 2).cast("int")).alias("last_update"), (F.col("o_totalprice") + 1).alias("v"))


@query("split_by_years", "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 500 AS b FROM orders), y AS (SELECT *, unnest(generate_series(year(a), year(b))) AS y FROM o) SELECT o_orderkey, greatest(a, make_date(y, 1, 1)) AS from_date, least(b, make_date(y, 12, 31)) AS to_date FROM y")
def _(t):
    o = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("a")).withColumn("b", F.date_add("a", 500))
    return H.split_by_years(o, "a", "b").select("o_orderkey", "from_date", "to_date")


@query("parse_dmy", "SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS DATE) AS d FROM orders")
def _(t):
    return t.orders.select("o_orderkey", H.parse_dmy(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("d"))


@query("diff_new", f"WITH {INDEXED}, {CRAWLED} SELECT * FROM crawled WHERE url NOT IN (SELECT url FROM indexed)")
def _(t):
    return H.diff_new(crawled(t), indexed(t))


@query("diff_changed", f"WITH {INDEXED}, {CRAWLED} SELECT c.* FROM crawled c LEFT JOIN indexed i ON c.url = i.url WHERE i.url IS NULL OR i.last_update IS NULL OR c.last_update > i.last_update")
def _(t):
    return H.diff_changed(crawled(t), indexed(t))


@query("diff_changed_v0", f"WITH {INDEXED}, {CRAWLED} SELECT c.* FROM crawled c LEFT JOIN indexed i ON c.url = i.url WHERE i.url IS NULL OR c.last_update IS DISTINCT FROM i.last_update")
def _(t):
    return H.diff_changed_v0(crawled(t), indexed(t))


@query("dict_dedup", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def _(t):
    return H.dict_dedup(t.events.select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("update_window", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-16' AND DATE '1998-01-01'")
def _(t):
    return H.update_window(t.orders.withColumn("d", F.to_date("o_orderdate")), "d", datetime.date(1998, 1, 1), 50).select("o_orderkey")


SCALARS = {"title": "<title>([^<]*)</title>", "h1": "<h1>([^<]*)</h1>", "lang": '<html lang="([a-z]+)"'}
LISTS = {"links": '<a href="([^"]+)"', "items": "<li><a[^>]*>([^<]+)</a>"}


@query("scrape_fields", f"SELECT page_id, {', '.join(f'''nullif(trim(regexp_extract(html, '{p}', 1)), '') AS {n}''' for n, p in SCALARS.items())}, {', '.join(f'''array_to_string(list_transform(regexp_extract_all(html, '{p}', 1), lambda x: trim(x)), '|') AS {n}''' for n, p in LISTS.items())} FROM pages")
def _(t):
    s = H.scrape(t.pages, "html", SCALARS, LISTS)
    return s.select("page_id", *SCALARS, *[F.array_join(n, "|").alias(n) for n in LISTS])


@query("src_catalogue", "SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1)) AS link, unnest(regexp_extract_all(html, '<li><a[^>]*>([^<]+)</a>', 1)) AS label FROM pages")
def _(t):
    s = H.scrape(t.pages, "html", {}, LISTS)
    return s.select("page_id", F.explode(F.arrays_zip("links", "items")).alias("z")).select("page_id", F.col("z.links").alias("link"), F.col("z.items").alias("label"))


@query("costs", "SELECT o_orderkey, replace(regexp_replace(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), '([0-9]{3})$', ' \\1'), ' ', '') AS cost FROM orders")
def _(t):
    return t.orders.select("o_orderkey", H.costs(F.regexp_replace(F.floor("o_totalprice").cast("bigint").cast("string"), "([0-9]{3})$", " $1")).alias("cost"))


@query("programme_split", "WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'nodash' ELSE p_brand || '-' || p_type || '-x' END AS f, p_type || '-' || p_size || '-z' AS s FROM part) SELECT p_partkey, coalesce(nullif(trim(regexp_extract(f, '^([^-]+)-(.*)$', 1)), ''), nullif(trim(regexp_extract(s, '^([^-]+)-([^-]+)', 1)), '')) AS programme, coalesce(nullif(trim(regexp_extract(f, '^([^-]+)-(.*)$', 2)), ''), nullif(trim(regexp_extract(s, '^([^-]+)-([^-]+)', 2)), '')) AS subprogramme FROM x")
def _(t):
    p = t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "nodash").otherwise(F.concat("p_brand", F.lit("-"), "p_type", F.lit("-x"))).alias("f"), F.concat("p_type", F.lit("-"), F.col("p_size").cast("string"), F.lit("-z")).alias("s"))
    a, b = H.programme_split(F.col("f"), F.col("s"))
    return p.select("p_partkey", a.alias("programme"), b.alias("subprogramme"))


@query("year_of", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y') END AS y FROM orders")
def _(t):
    start = F.when(F.col("o_orderkey") % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy"))
    return t.orders.select("o_orderkey", H.year_of(start).alias("y"))


@query("index_guard", f"WITH {INDEXED} SELECT url FROM indexed WHERE last_update IS NOT NULL")
def _(t):
    return H.index_guard(indexed(t), ("last_update", "v")).select("url")


@query("sink_index_proj", f"WITH {INDEXED}, {CRAWLED}, ch AS (SELECT * FROM crawled WHERE last_update > DATE '1997-01-01') SELECT * FROM indexed WHERE url NOT IN (SELECT url FROM ch) UNION ALL SELECT * FROM ch")
def _(t):
    return H.upsert(indexed(t), crawled(t).filter("last_update > DATE '1997-01-01'"), "url", "last_update")


@query("deliv_counts", "SELECT l_orderkey, count(*) AS n_found, count(CASE WHEN l_quantity > 10 THEN 1 END) AS n_ok FROM lineitem GROUP BY l_orderkey")
def _(t):
    return H.child_counts(t.lineitem.select("l_orderkey", F.when(F.col("l_quantity") > 10, F.lit(1)).alias("text")), "l_orderkey", "text")


@query("denormalize", "SELECT o_orderkey, o_orderstatus, l_linenumber AS deliv_l_linenumber, l_quantity AS deliv_l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def _(t):
    return H.denormalize(t.orders.select("o_orderkey", "o_orderstatus"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity"), "o_orderkey")


@query("range_not_missing", f"WITH {INDEXED} SELECT url FROM indexed WHERE v IS NOT NULL AND last_update BETWEEN DATE '1995-01-01' AND DATE '1996-06-30'")
def _(t):
    return H.range_not_missing(indexed(t), "v", "last_update", datetime.date(1995, 1, 1), datetime.date(1996, 6, 30)).select("url")


@query("field_completeness", f"WITH {INDEXED} SELECT 'last_update' AS field, count(last_update) AS found, count(*) AS total FROM indexed UNION ALL SELECT 'v', count(v), count(*) FROM indexed")
def _(t):
    return H.field_completeness(indexed(t), ["last_update", "v"])
