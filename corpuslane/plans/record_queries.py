"""Record, web page and schema queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import segment as S
from ..functions.extract import ORG_KINDS, organization_type
from ..functions.spread import spread
from ..operators import records as R
from ..sources import model as M
from .registry import query


def rows(t):
    """Texts and links of line items as if read from a page, one page an order."""
    k = F.col("l_partkey").cast("string")
    texts = F.array(F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("D1."), k, F.lit(" Report"))).otherwise(F.lit("A plain text")), F.concat(F.lit("A longer description of part "), k))
    links = F.array(F.concat(F.lit("http://ex.org/D"), k, F.lit(".pdf")))
    return t.lineitem.select(F.col("l_orderkey").alias("page"), "l_linenumber", texts.alias("texts"), links.alias("links"))


@query("rec_from_text", "SELECT l_orderkey AS page, l_linenumber, 'D1.' || l_partkey || ' Report' AS title, 'A longer description of part ' || l_partkey AS description FROM lineitem WHERE l_linenumber % 2 = 0")
def _(t):
    return rows(t).withColumn("r", R.from_text(F.col("texts"), F.col("links"))).filter("r is not null").select("page", "l_linenumber", "r.title", "r.description")


@query("rec_from_link", "SELECT l_orderkey AS page, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN length('D1.' || l_partkey || ' Report') > 10 THEN 'D1.' || l_partkey || ' Report' ELSE 'A longer description of part ' || l_partkey END ELSE 'A plain text' END AS title, 'http://ex.org/D' || l_partkey || '.pdf' AS link FROM lineitem")
def _(t):
    return rows(t).withColumn("r", R.from_link(F.col("texts"), F.col("links"))).select("page", "l_linenumber", "r.title", "r.link")


@query("rec_title_check", "SELECT * FROM (VALUES ('Download', false), ('[12]', false), ('A fine title', true), ('', false)) v(title, ok)")
def _(t):
    return t.spark.createDataFrame([("Download",), ("[12]",), ("A fine title",), ("",)], "title string").select("title", R.title_ok(F.col("title")).alias("ok"))


@query("rec_choose", "WITH n AS (SELECT l_orderkey, count(*) FILTER (l_linenumber % 2 = 0) AS nt, count(*) AS nl FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey AS page, CASE WHEN nt > 3 THEN 'text' WHEN nl > 3 THEN 'link' ELSE 'manual' END AS kind, count(*) AS n FROM lineitem JOIN n USING (l_orderkey) WHERE nt <= 3 OR l_linenumber % 2 = 0 GROUP BY ALL")
def _(t):
    made = rows(t).select("page", R.from_text(F.col("texts"), F.col("links")).alias("a"), R.from_link(F.col("texts"), F.col("links")).alias("b"))
    return R.choose(made.withColumn("c", F.col("b")), "page", "a", "b", "c").groupBy("page", "kind").agg(F.count("*").alias("n"))


@query("region_deliv", "SELECT o_custkey, o_orderkey FROM (SELECT *, last_value(CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 2 = 0 END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS inside FROM orders) WHERE inside AND o_orderkey % 7 <> 0")
def _(t):
    text = F.when(F.col("o_orderkey") % 2 == 0, "Public Deliverables").otherwise("Contact")
    o = t.orders.select("o_custkey", "o_orderkey", text.alias("t"), (F.col("o_orderkey") % 7 == 0).alias("h"))
    return R.section(o, "o_custkey", "o_orderkey", "t", "h").select("o_custkey", "o_orderkey")


@query("web_generalize", "SELECT * FROM (VALUES ('Authors:', 'authors'), ('Key words', 'keywords'), ('Colour', NULL)) v(h, p)")
def _(t):
    return t.spark.createDataFrame([("Authors:",), ("Key words",), ("Colour",)], "h string").select("h", R.generalize(F.col("h")).alias("p"))


@query("web_publtype", "SELECT * FROM (VALUES ('Journal papers', 'article'), ('Book chapters', 'incollection'), ('Talks', NULL)) v(h, p)")
def _(t):
    return t.spark.createDataFrame([("Journal papers",), ("Book chapters",), ("Talks",)], "h string").select("h", R.publication_type(F.col("h")).alias("p"))


@query("web_title_score", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 70 ELSE 0 END AS s FROM part")
def _(t):
    return t.part.select("p_partkey", R.title_score(F.when(F.col("p_partkey") % 2 == 0, "Great Works of Art").otherwise("some (works"), 50, ["of"]).alias("s"))


@query("web_visibility_headers")
def _(t):
    return R.visibility_headers(H.node_table(t.pages))


@query("web_pubpage")
def _(t):
    nodes = H.node_table(t.pages)
    title = R.visibility_headers(nodes).groupBy("page_id").agg(F.min_by("text", "node_id").alias("title"))
    longest = nodes.filter("length(text) >= 200 and tag not in ('script', 'style')").groupBy("page_id").agg(F.max_by("text", F.struct(F.length("text"), -F.col("node_id"))).alias("abstract"))
    return title.join(longest, "page_id", "left").select("page_id", "title", F.length("abstract").alias("abstract"))


@query("web_publist")
def _(t):
    cited = F.concat(F.lit("[1] Novak, J. "), "p_name", F.lit(" studies of everything. 1999. [2] Kral, P. Another "), "p_type", F.lit(" paper, vol. 3, 2001."))
    block = spread(t.part.select("p_partkey", "p_name", "p_type"), "p_partkey").select("p_partkey", F.replace(cited, F.lit(" [2]"), F.lit("\n[2]")).alias("b"))
    return S.parse_citation(S.citations(block, "p_partkey", "b"), "content").select("p_partkey", "ord", "title", "year", "type")


@query("proc_split", "SELECT p_partkey, 2 AS n FROM part")
def _(t):
    text = F.concat(F.lit("\nTitle of the first paper\nJ. Novak\nAbstract\n"), "p_name", F.lit("\nbody\nTitle of the second paper\nAbstract\n"), "p_type")
    return t.part.select("p_partkey", F.size(R.split_proceedings(text)).alias("n"))


@query("ee_org_kinds", "SELECT count(*) AS n FROM (SELECT unnest(range(19)))")
def _(t):
    words = t.spark.createDataFrame([(w, k) for w, k in ORG_KINDS], "w string, k string")
    return words.filter(organization_type(F.concat("w", F.lit("y of X"))) == F.col("k")).agg(F.count("*").alias("n"))


@query("entity_schemas", "SELECT 34 AS n")
def _(t):
    for ddl in M.ENTITIES.values():
        t.spark.createDataFrame([], ddl)
    return t.spark.createDataFrame([(len(M.ENTITIES),)], "n int")


@query("ddl_parse", "SELECT * FROM (VALUES ('pub', 'id', 'bigint'), ('pub', 'title', 'string'), ('pub', 'cost', 'decimal(18,2)')) v(tbl, col, typ)")
def _(t):
    found = M.parse_ddl('CREATE TABLE data.pub (id BIGINT NOT NULL, title VARCHAR(200), cost NUMERIC(18,2), CONSTRAINT pk PRIMARY KEY (id));')
    return t.spark.createDataFrame([(n, f.name, f.dataType.simpleString()) for n, s in found.items() for f in s], "tbl string, col string, typ string")
