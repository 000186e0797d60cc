"""HTML and crawl queries over pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions.spread import spread
from ..operators import crawl as C
from .registry import query
from .text_queries import lit

A_SQL = "a AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">[^<]*</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1)) AS text FROM pages)"
URL_SQL = "CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(base, '^([a-z]+://[^/?#]+)', 1) || href ELSE href END"


def nodes(t):
    return H.node_table(t.pages)


def links(t):
    """(page, base, url, text, mime) of every anchor."""
    found = H.links(nodes(t), t.pages).join(t.pages.select("page_id", F.col("url").alias("base")), "page_id")
    return C.mime(found.select(F.col("page_id").alias("page"), "base", "url", "text"))


@query("html_nodes")
def _(t):
    return nodes(t).drop("attrs")


@query("html_tag_counts", "SELECT page_id, (length(html) - length(replace(html, '<p>', ''))) // 3 AS n_p, (length(html) - length(replace(html, '<li>', ''))) // 4 AS n_li FROM pages")
def _(t):
    n = nodes(t).groupBy("page_id").agg(F.count_if(F.col("tag") == "p").alias("n_p"), F.count_if(F.col("tag") == "li").alias("n_li"))
    return t.pages.select("page_id").join(n, "page_id", "left").select("page_id", F.coalesce("n_p", F.lit(0)).alias("n_p"), F.coalesce("n_li", F.lit(0)).alias("n_li"))


@query("html_clean", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\x{A0}]+', ' ', 'g'), ' \"''()')) AS clean FROM pages")
def _(t):
    return t.pages.select("page_id", F.md5(H.clean(F.col("html"))).alias("clean"))


@query("html_entities")
def _(t):
    return t.bounded().pages.select("page_id", F.md5(H.decoded("html")).alias("decoded"))


@query("html_text")
def _(t):
    text = F.transform(F.sort_array(F.collect_list(F.struct("node_id", "text"))), lambda s: s["text"])
    return nodes(t).filter("text <> ''").groupBy("page_id").agg(F.array_join(text, " ").alias("text"))


@query("html_clean_tree")
def _(t):
    return t.bounded().pages.select("page_id", T.to_ascii(H.text_format(H.clean(F.col("html")))).alias("clean"))


@query("text_format")
def _(t):
    return t.documents.select("doc_id", F.md5(H.text_format("text")).alias("t"))


@query("html_meta", "SELECT page_id, 'charset' AS name, 'utf-8' AS vals FROM pages")
def _(t):
    return H.meta(nodes(t)).select("page_id", "name", F.array_join("values", "|").alias("vals"))


@query("link_extract", f"WITH {A_SQL} SELECT DISTINCT page_id, {URL_SQL} AS url, trim(text) AS text FROM a")
def _(t):
    return H.links(nodes(t), t.pages)


@query("pager_links", f"WITH {A_SQL} SELECT page_id, href, text FROM a WHERE regexp_matches(text, '(?i)^ ?[0-9]+ ?$|next')")
def _(t):
    return H.pager_links(nodes(t))


@query("header_count", "SELECT page_id, 1 AS n FROM pages WHERE regexp_matches(regexp_extract(html, '<h1>([^<]*)</h1>', 1), 'th')")
def _(t):
    return H.header_count(nodes(t), "th")


@query("frame_links", "SELECT page_id, url || '?menu' AS src FROM pages UNION ALL SELECT page_id, 'top.html' FROM pages")
def _(t):
    framed = F.concat("html", F.lit('<iframe src="'), "url", F.lit('?menu"></iframe><frame src="top.html"><frame name="none">'))
    return H.frames(H.node_table(t.pages.withColumn("html", framed)))


@query("meta_kw", "SELECT page_id, 'utf-8' AS charset FROM pages")
def _(t):
    return H.meta(nodes(t)).filter("name = 'charset'").select("page_id", F.array_join("values", "").alias("charset"))


@query("same_domain", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^(www|wiki)\\.', '') = 'ththre.example.com' AS same FROM pages")
def _(t):
    return t.pages.select("page_id", C.same_domain(F.col("url"), F.lit("http://www.ththre.example.com/x")).alias("same"))


@query("src_filename", "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/(?:[^?#]*/)?([^/?#]*)', 1) AS name FROM pages")
def _(t):
    return t.pages.select("page_id", C.file_name(F.col("url")).alias("name"))


@query("sink_file", "SELECT page_id, regexp_replace(replace(url, ':', '.'), '[/?#]', '', 'g') AS name FROM pages")
def _(t):
    return t.pages.select("page_id", C.store_name(F.col("url")).alias("name"))


@query("src_mime", "SELECT p_partkey, ['application/pdf', 'text/html', NULL, 'application/zip'][1 + (p_partkey % 4)::INT] AS mime FROM part")
def _(t):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".PDF", ".html", ".pdf?x=1", ".zip#a")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = t.part.select("p_partkey", F.concat(F.lit("http://ex.org/a.b/D"), F.col("p_partkey").cast("string"), ext).alias("url"))
    return C.mime(p).select("p_partkey", "mime")


@query("src_crawler", "SELECT p_partkey % 300 AS page_id, count(html) AS n FROM part LEFT JOIN pages ON page_id = p_partkey % 300 GROUP BY 1")
def _(t):
    wanted = t.part.select((F.col("p_partkey") % 300).alias("page_id"))
    return wanted.join(t.pages.select("page_id", "html"), "page_id", "left").groupBy("page_id").agg(F.count("html").alias("n"))


@query("src_htmlpage", "SELECT page_id, regexp_extract(html, 'charset=\"?([A-Za-z0-9-]+)', 1) AS charset, regexp_extract(html, '<title>([^<]*)</title>', 1) <> '' AS titled FROM pages")
def _(t):
    return t.pages.select("page_id", F.regexp_extract("html", 'charset="?([A-Za-z0-9-]+)', 1).alias("charset"), (F.regexp_extract("html", "<title>([^<]*)</title>", 1) != "").alias("titled"))


SAMPLE = """l AS (SELECT l_orderkey AS page, 'http://www.ex.org/' || l_orderkey AS base, CASE WHEN l_linenumber % 4 = 0 THEN 'javascript:void' WHEN l_linenumber % 5 = 0 THEN 'http://other.org/a.pdf' WHEN l_linenumber % 3 = 0 THEN 'http://ex.org/D' || l_partkey || '.pdf' ELSE 'http://ex.org/p' || l_partkey || '.html' END AS url, ['Deliverables', 'Results page', 'Reports', 'About'][1 + (l_partkey % 4)::INT] AS text FROM lineitem)"""


def sample(t):
    n, k = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    url = F.when(n % 4 == 0, "javascript:void").when(n % 5 == 0, "http://other.org/a.pdf").when(n % 3 == 0, F.concat(F.lit("http://ex.org/D"), k, F.lit(".pdf"))).otherwise(F.concat(F.lit("http://ex.org/p"), k, F.lit(".html")))
    text = F.element_at(F.array(*[F.lit(x) for x in ("Deliverables", "Results page", "Reports", "About")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    return C.mime(t.lineitem.select(F.col("l_orderkey").alias("page"), F.concat(F.lit("http://www.ex.org/"), F.col("l_orderkey").cast("string")).alias("base"), url.alias("url"), text.alias("text")))


FIRST = "CASE " + " ".join(f"WHEN regexp_matches(hay, {lit(p)}) THEN {i}" for i, p in enumerate(C.PATTERNS)) + " END"


@query("crawl_rank", f"WITH {SAMPLE}, h AS (SELECT *, lower(text || ' ' || url) AS hay FROM l WHERE url NOT LIKE 'javascript%' AND url NOT LIKE '%other.org%'), i AS (SELECT *, {FIRST} AS i FROM h) SELECT page, sum(CASE WHEN url LIKE '%.pdf' THEN 110 WHEN i = 0 THEN 20 ELSE 10 - i END)::BIGINT AS rank, count(*) FILTER (url LIKE '%.pdf') AS documents FROM i WHERE i IS NOT NULL GROUP BY page")
def _(t):
    return C.level_rank(sample(t))


@query("title_rank", f"WITH {SAMPLE}, h AS (SELECT page, lower(text) AS hay FROM l), i AS (SELECT page, {FIRST} AS i FROM h) SELECT page, sum(CASE WHEN i = 0 THEN 40 ELSE 10 - i END)::BIGINT AS rank FROM i WHERE i IS NOT NULL GROUP BY page")
def _(t):
    return C.title_rank(sample(t))


@query("anchor_rank", f"WITH {SAMPLE} SELECT DISTINCT url, 10::BIGINT AS rank FROM l WHERE text = 'Deliverables'")
def _(t):
    return C.anchor_rank(sample(t))


@query("cascade", f"WITH {SAMPLE}, m AS (SELECT *, CASE text WHEN 'Deliverables' THEN 0 WHEN 'Results page' THEN 2 WHEN 'Reports' THEN 2 ELSE 3 END AS tier FROM l) SELECT page, tier, url, text FROM m WHERE tier = (SELECT min(tier) FROM m x WHERE x.page = m.page)")
def _(t):
    return C.cascade(sample(t)).select("page", "tier", "url", "text")


@query("best_page", "SELECT l_suppkey AS site, url, rank FROM (SELECT l_suppkey, url, rank, row_number() OVER (PARTITION BY l_suppkey ORDER BY rank DESC, url) AS r FROM (SELECT l_suppkey, 'p' || l_partkey AS url, count(*) AS rank FROM lineitem GROUP BY ALL)) WHERE r = 1")
def _(t):
    front = t.lineitem.groupBy(F.col("l_suppkey").alias("site"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("url")).agg(F.count("*").alias("rank"))
    return C.best_page(front, "site")


@query("frontier", f"WITH {SAMPLE}, u AS (SELECT DISTINCT url, 10 AS rank FROM l WHERE text = 'Deliverables' UNION ALL SELECT DISTINCT url, 10 FROM l WHERE text = 'Deliverables') SELECT url, sum(rank)::BIGINT AS rank FROM u WHERE url NOT LIKE '%.html' GROUP BY url")
def _(t):
    s = sample(t)
    r = C.anchor_rank(s)
    return C.unvisited(C.frontier([r, r]), s.filter("url like '%.html'"))


@query("crawl_loop", "SELECT * FROM (VALUES (0, 'n0'), (1, 'n1'), (2, 'n2'), (3, 'n3'), (4, 'n4'), (5, 'n5')) v(i, url)")
def _(t):
    r = t.region.select(F.concat(F.lit("n"), F.col("r_regionkey").cast("string")).alias("base"), F.concat(F.lit("n"), (F.col("r_regionkey") + 1).cast("string")).alias("url"))
    return t.spark.createDataFrame(list(enumerate(C.crawl("n0", r))), "i int, url string")


@query("doc_anchor", f"WITH {SAMPLE} SELECT DISTINCT page, url FROM l WHERE url LIKE '%.pdf'")
def _(t):
    return sample(t).filter("mime = 'application/pdf'").select("page", "url").distinct()


@query("error_codes", "SELECT * FROM (VALUES (1, 'no start address'), (2, 'the page could not be read'), (3, 'no page found'), (4, 'no record found')) v(code, message)")
def _(t):
    return t.spark.createDataFrame(list(C.ERRORS.items()), "code int, message string")


@query("css_parse")
def _(t):
    style = F.regexp_extract("html", "<style>([^<]*)</style>", 1)
    return H.per_page(t.pages.select("page_id", F.concat(F.lit("<style>"), style, F.lit("</style>")).alias("html")), lambda ns: [(s, k, v) for n in ns if n.tag == "style" for s, p in H.css_rules("".join(n.text)) for k, v in p.items()], "selector string, property string, value string")


@query("css_color", "SELECT r_regionkey, ['255,255,255', '0,0,128', '255,170,0', '1,2,3', ''][1 + r_regionkey] AS rgb FROM region")
def _(t):
    names = ["#fff", "navy", "#FFAA00", "rgb(1, 2, 3)", "nonsense"]
    rgb = [",".join(map(str, H.color_rgb(n) or ())) for n in names]
    return t.region.join(F.broadcast(t.spark.createDataFrame(list(enumerate(rgb)), "r_regionkey int, rgb string")), "r_regionkey").select("r_regionkey", "rgb")


@query("css_cascade", "SELECT page_id, round(power(1.4, 1.8) * power(2, 3) * 1.2, 6) AS h1 FROM pages WHERE html LIKE '%<h1>%'")
def _(t):
    return nodes(t).filter("tag = 'h1'").groupBy("page_id").agg(F.round(F.max("visibility"), 6).alias("h1"))


@query("visibility")
def _(t):
    return nodes(t).groupBy("page_id", "tag").agg(F.round(F.max("visibility"), 6).alias("v"))


@query("color_visibility", "SELECT r_regionkey, [1.0, 1.3, 0.6, 1.0, 1.0][1 + r_regionkey]::DOUBLE AS v FROM region")
def _(t):
    vals = [H.color_visibility(H.color_rgb(c)) for c in ("black", "red", "#eeeeee", "white", None)]
    return t.region.join(F.broadcast(t.spark.createDataFrame(list(enumerate(vals)), "r_regionkey int, v double")), "r_regionkey").select("r_regionkey", "v")


@query("seq_most_freq")
def _(t):
    return H.most_frequent(nodes(t))


@query("seq_sift")
def _(t):
    return H.per_page(t.pages, H.sift, "node_id int, tag string, text string")


@query("seq_regions")
def _(t):
    return H.regions(nodes(t)).select("page_id", "region", "header", F.size("records").alias("n"))


@query("seq_chunks")
def _(t):
    return H.chunks(nodes(t)).select("page_id", "record", F.size("chunks").alias("n"))


@query("seq_wrap")
def _(t):
    r = H.regions(nodes(t))
    return r.groupBy("page_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("region", "header", "records")))).alias("wrapped"))


@query("seq_wrap_h")
def _(t):
    return H.best_header(nodes(t))


@query("seq_menu")
def _(t):
    return H.per_page(t.pages, H.menu, "text string, href string")


@query("seq_xml")
def _(t):
    r = H.regions(nodes(t)).select("page_id", "region", F.xxhash64("header").alias("h"), F.concat(F.lit("<area><header>"), F.coalesce("header", F.lit("")), F.lit("</header>"), F.array_join(F.transform("records", lambda x: F.concat(F.lit("<entry>"), F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</entry>"))), ""), F.lit("</area>")).alias("xml"))
    return r.select("page_id", "region", "xml")


@query("region_common_parent")
def _(t):
    def parent(ns):
        members = [n for n in ns if n.tag == "li"]
        p = H.common_parent(ns, members) if members else None
        return [(p.tag, p.depth)] if p else []

    return H.per_page(t.pages, parent, "tag string, depth int")


@query("table_records")
def _(t):
    rows = F.concat(F.lit("<table><tr><th>Title</th><th>Date</th></tr><tr><td><a href='x"), F.col("p_partkey").cast("string"), F.lit(".pdf'>"), "p_name", F.lit("</a></td><td>"), F.col("p_size").cast("string"), F.lit("</td></tr></table>"))
    parts = spread(t.part.select("p_partkey", "p_name", "p_size"), "p_partkey")
    return H.per_page(parts.select(F.col("p_partkey").alias("page_id"), rows.alias("html")), lambda ns: [(i, link, "|".join(cells), head) for i, link, cells, head in H.table_rows(ns)], "row_id int, link string, cells string, is_header boolean")


@query("seq_interval")
def _(t):
    from pyspark.sql import Window

    a = nodes(t).filter("tag = 'a'")
    gap = F.col("node_id") - F.lag("node_id").over(Window.partitionBy("page_id").orderBy("node_id"))
    g = a.withColumn("gap", gap).filter("gap is not null").groupBy("page_id").agg(F.mode("gap", True).alias("m"), (F.max("gap") - F.min("gap")).alias("spread"))
    return g.select("page_id", F.when(F.col("spread") > 10, -1).otherwise(F.col("m")).alias("interval"))
