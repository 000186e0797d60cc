"""Builder and persistence queries over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import norm_publication
from ..operators import sqlbuilder as B
from ..operators import store as P
from .registry import query
from .search_queries import words
from .text_queries import _PUB


def q(t, *names):
    return B.Query({n: getattr(t, n) for n in names}).from_(*names)


@query("sql_select", "SELECT n_name, r_name FROM nation, region WHERE n_nationkey < 3")
def _(t):
    return q(t, "nation", "region").where("n_nationkey <", 3).select("n_name", "r_name").frame()


@query("sql_distinct", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def _(t):
    return q(t, "orders").distinct("o_custkey").order_by("o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice").frame()


@query("sql_where", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R' OR l_discount < 0.01 AND l_tax > 0.07 OR l_orderkey = l_partkey")
def _(t):
    return q(t, "lineitem").where("l_quantity >", 45).and_("l_returnflag", "R").or_("l_discount <", 0.01).and_("l_tax >", 0.07).or_("l_orderkey", "l_partkey", column=True).select("l_orderkey", "l_linenumber").frame()


@query("sql_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ALL HAVING count(*) > 100")
def _(t):
    return q(t, "lineitem").group_by("l_returnflag", "l_linestatus", n=F.count("*"), qty=F.round(F.sum("l_quantity"), 2)).having("n > 100").frame()


@query("sql_order", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey DESC LIMIT 15 OFFSET 5")
def _(t):
    return q(t, "orders").order_by("o_orderpriority", "o_orderkey", desc=True).limit(15).offset(5).select("o_orderkey", "o_orderpriority").frame()


@query("sql_insert", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT * FROM (VALUES (90, 'A', 1), (91, NULL, 0))")
def _(t):
    return B.insert(t.nation, [{"n_nationkey": 90, "n_name": "A", "n_regionkey": 1}, {"n_nationkey": 91, "n_regionkey": B.DEFAULT}], {"n_regionkey": 0})


@query("sql_update", "SELECT s_suppkey, CASE WHEN s_suppkey < 10 THEN s_acctbal + 100 ELSE s_acctbal END AS s_acctbal, CASE WHEN s_suppkey < 10 THEN NULL ELSE s_name END AS s_name, CASE WHEN s_suppkey < 10 THEN 7 ELSE s_nationkey END AS s_nationkey FROM supplier")
def _(t):
    return B.update(t.supplier, F.col("s_suppkey") < 10, {"s_acctbal": "+=100", "s_name": None, "s_nationkey": B.DEFAULT}, {"s_nationkey": 7}).select("s_suppkey", "s_acctbal", "s_name", "s_nationkey")


@query("sql_delete", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0)")
def _(t):
    return B.delete(t.customer, F.col("c_acctbal") < 0).select("c_custkey")


@query("sql_returning", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0")
def _(t):
    return B.returning(t.customer, F.col("c_acctbal") < 0, "c_custkey", "c_name")


@query("sql_fulltext", f"WITH w AS (SELECT doc_id, {words('text')} AS w FROM documents) SELECT doc_id FROM w WHERE list_contains(w, 'license') AND (list_contains(w, 'gnu') OR list_contains(w, 'apache')) AND NOT list_contains(w, 'ontion') OR list_contains(w, 'moron')")
def _(t):
    return B.fulltext(t.documents, ["text"], "license & (gnu | apache) & !ontion | moron").select("doc_id")


@query("sql_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
def _(t):
    return B.Query({"customer": t.customer, "orders": t.orders}).from_("customer").join("orders", (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_totalprice") > 400000), "left").select("c_custkey", "o_orderkey").frame()


@query("sql_join_kinds", "SELECT 'semi' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'full', count(*) FROM customer FULL JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 'right', count(*) FROM customer RIGHT JOIN orders ON c_custkey = o_custkey")
def _(t):
    on = F.col("c_custkey") == F.col("o_custkey")
    make = lambda how: B.Query({"customer": t.customer, "orders": t.orders}).from_("customer").join("orders", on, how).frame().agg(F.count("*").alias("n")).select(F.lit(how.removeprefix("left_")).alias("kind"), "n")
    out = make("left_semi")
    for how in ("left_anti", "full", "right"):
        out = out.unionByName(make(how))
    return out


@query("sql_compile", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 100.5 AND c_name <> 'o''x' GROUP BY c_mktsegment")
def _(t):
    return t.spark.sql("SELECT c_mktsegment, count(*) AS n FROM {customer} WHERE c_acctbal > :low AND c_name <> :name GROUP BY c_mktsegment", args={"low": 100.5, "name": "o'x"}, customer=t.customer)


@query("sql_fetch", "SELECT count(*) AS n, min(n_nationkey) AS first_id FROM nation")
def _(t):
    b = q(t, "nation").order_by("n_nationkey")
    return t.spark.createDataFrame([(b.count(), b.fetch_one()["n_nationkey"])], "n bigint, first_id int")


PUBS = "pub AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS title, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS note, (doc_id % 90)::INT AS credibility FROM documents)"
NEW = "new AS (SELECT doc_id AS id, 'q' || quality AS title, CASE WHEN toxic = 0 THEN 'N' || quality END AS note, (doc_id % 70)::INT AS credibility FROM labels)"


def pubs(t):
    i = F.col("doc_id")
    return t.documents.select(i.alias("id"), F.when(i % 4 != 0, F.col("source")).alias("title"), F.when(i % 3 != 0, F.col("lang")).alias("note"), (i % 90).cast("int").alias("credibility"))


def news(t):
    i = F.col("doc_id")
    quality = F.col("quality").cast("string")
    return t.labels.select(i.alias("id"), F.concat(F.lit("q"), quality).alias("title"), F.when(F.col("toxic") == 0, F.concat(F.lit("N"), quality)).alias("note"), (i % 70).cast("int").alias("credibility"))


def update_sql(pick: str) -> str:
    return f"WITH {PUBS}, {NEW} SELECT p.id, {pick.format(c='title')} AS title, {pick.format(c='note')} AS note, CASE WHEN n.id IS NULL THEN p.credibility ELSE greatest(p.credibility, n.credibility) END AS credibility FROM pub p LEFT JOIN new n ON p.id = n.id"


@query("db_update_missing", update_sql("coalesce(p.{c}, n.{c})"))
def _(t):
    return P.update(pubs(t), news(t), "id", P.MISSING)


@query("db_update_overwrite", update_sql("coalesce(n.{c}, p.{c})"))
def _(t):
    return P.update(pubs(t), news(t), "id", P.OVERWRITE)


@query("db_update", update_sql("CASE WHEN n.credibility > p.credibility THEN coalesce(n.{c}, p.{c}) ELSE p.{c} END"))
def _(t):
    return P.update(pubs(t), news(t), "id", P.CREDIBILITY)


@query("db_insert", "SELECT 'row' AS what, count(*) AS n, sum(id)::BIGINT AS s FROM (SELECT s_suppkey AS id FROM supplier UNION ALL SELECT 1000 + n_nationkey FROM nation) UNION ALL SELECT 'meta', 25, sum(n_nationkey + 1000)::BIGINT FROM nation")
def _(t):
    old = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    new = t.nation.select((F.col("n_nationkey") + 1000).cast("bigint").alias("id"), F.col("n_name").alias("title"), F.lit(50).alias("credibility"))
    meta = t.spark.createDataFrame([], "entity_id bigint, module_id bigint, credibility int, changed timestamp")
    rows, log = P.insert(old, new, meta, 3, F.current_timestamp())
    one = lambda df, what, c: df.agg(F.count("*").alias("n"), F.sum(c).alias("s")).select(F.lit(what).alias("what"), "n", "s")
    return one(rows, "row", "id").unionByName(one(log, "meta", "entity_id"))


@query("db_meta", "SELECT user_id AS entity_id, credibility, changed FROM (SELECT user_id, floor(value)::BIGINT AS credibility, ts AS changed, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, floor(value) DESC) AS r FROM events) WHERE r = 1")
def _(t):
    return P.meta_latest(t.events.select(F.col("user_id").alias("entity_id"), F.floor("value").alias("credibility"), F.col("ts").alias("changed")))


@query("db_contains", "SELECT p_partkey, p_brand, p_brand IN (SELECT p_brand FROM part WHERE p_size = 1) AS found FROM part")
def _(t):
    return P.contains(t.part.filter("p_size = 1"), t.part.select("p_partkey", "p_brand"), ["p_brand"])


@query("db_relationship", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def _(t):
    pairs = t.lineitem.select("l_partkey", "l_suppkey")
    return P.relate(pairs.filter("l_quantity > 25").distinct(), pairs, ["l_partkey", "l_suppkey"])


@query("db_set_parent", "SELECT o_orderkey AS id, c_custkey AS parent FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def _(t):
    kids = t.orders.select(F.col("o_orderkey").alias("id"), F.lit(None).cast("bigint").alias("parent"))
    paying = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return P.set_parent(kids, t.orders.join(paying, "o_custkey").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent")), "id", "parent")


@query("db_rel_update", "SELECT l_partkey AS a, l_suppkey AS b, round(greatest(max(l_tax) FILTER (l_quantity <= 25), coalesce(max(l_tax) FILTER (l_quantity > 25), 0)), 6) AS w FROM lineitem GROUP BY ALL HAVING count(*) FILTER (l_quantity <= 25) > 0")
def _(t):
    edge = lambda c: t.lineitem.filter(c).groupBy("l_partkey", "l_suppkey").agg(F.max("l_tax").alias("w")).select(F.struct("l_partkey", "l_suppkey").alias("id"), "w", (F.col("w") * 100).cast("int").alias("credibility"))
    out = P.update(edge("l_quantity <= 25"), edge("l_quantity > 25").withColumn("w", F.col("w")), "id", P.OVERWRITE)
    old = edge("l_quantity <= 25").select("id", F.col("w").alias("o"))
    return out.join(old, "id").select(F.col("id.l_partkey").alias("a"), F.col("id.l_suppkey").alias("b"), F.round(F.greatest("w", "o"), 6).alias("w"))


@query("ent_compile", f"WITH {PUBS} SELECT id FROM pub WHERE title IS NOT NULL OR note IS NOT NULL")
def _(t):
    p = pubs(t).drop("credibility")
    return p.filter(~P.is_empty(p)).select("id")


@query("ent_own_attrs", f"WITH {PUBS} SELECT id, 'title' AS attribute, title AS value FROM pub WHERE title IS NOT NULL UNION ALL SELECT id, 'note', note FROM pub WHERE note IS NOT NULL")
def _(t):
    return P.own_attributes(pubs(t).drop("credibility"))


@query("er_prearrange", f"WITH {PUBS} SELECT id, {_PUB.replace('{c}', 'title')} AS title_normalized FROM pub WHERE title IS NOT NULL")
def _(t):
    return P.prearrange(pubs(t), "title", norm_publication).select("id", "title_normalized")


BAND = "floor({c}_acctbal / 2000)::BIGINT"
PROBES = f"pr AS (SELECT c_custkey AS probe_id, c_nationkey AS nation, {BAND.format(c='c')} AS band FROM customer), en AS (SELECT s_suppkey AS id, s_nationkey AS nation, {BAND.format(c='s')} AS band FROM supplier)"


def parties(t):
    """(probes, entities): customers, and suppliers that they may be, by nation and balance."""
    band = lambda c: F.floor(F.col(f"{c}_acctbal") / 2000).alias("band")
    return t.customer.select(F.col("c_custkey").alias("probe_id"), F.col("c_nationkey").alias("nation"), band("c")), t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), band("s"))


@query(
    "er_lookup0",
    f"""WITH {PROBES}, h AS (SELECT probe_id, 0 AS rule_no, min(id) AS id FROM pr JOIN en USING (nation, band) GROUP BY probe_id UNION ALL SELECT probe_id, 1, min(id) FROM pr JOIN en USING (nation) GROUP BY probe_id)
    SELECT probe_id, id, rule_no FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY rule_no, id) AS r FROM h) WHERE r = 1""",
)
def _(t):
    return P.lookup_exact(*parties(t), [["nation"], ["nation", "band"]])


@query(
    "er_lookup1",
    """WITH pe AS (SELECT DISTINCT o_custkey AS probe_id, l_partkey AS item FROM lineitem JOIN orders ON o_orderkey = l_orderkey), ee AS (SELECT DISTINCT l_suppkey AS id, l_partkey AS item FROM lineitem),
    sh AS (SELECT probe_id, id, count(DISTINCT item) AS shared FROM pe JOIN ee USING (item) GROUP BY ALL HAVING count(DISTINCT item) >= 3),
    n AS (SELECT sh.*, a.c_name AS pt, b.s_name AS et FROM sh JOIN customer a ON probe_id = a.c_custkey JOIN supplier b ON id = b.s_suppkey)
    SELECT probe_id, id, shared FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY shared DESC, round(1 - levenshtein(pt, et) / greatest(length(pt), length(et)), 9) DESC, id) AS r FROM n) WHERE r = 1""",
)
def _(t):
    bought = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("probe_id"), F.col("l_partkey").alias("item")).distinct()
    sold = t.lineitem.select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("item")).distinct()
    return P.lookup_related(bought, sold, t.customer.select(F.col("c_custkey").alias("probe_id"), F.col("c_name").alias("title")), t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title")), 3)


@query("er_bind", "SELECT c_custkey, coalesce(n_nationkey, -1) AS nation_id FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    dim = t.nation.select(F.col("n_nationkey").alias("k"), "n_nationkey")
    return t.customer.join(dim, F.col("c_nationkey") == F.col("k"), "left").select("c_custkey", F.coalesce("n_nationkey", F.lit(-1)).alias("nation_id"))


@query("src_table_load", "SELECT * FROM part WHERE p_partkey = 42")
def _(t):
    return t.part.filter(F.col("p_partkey") == 42)


@query("src_es_scan", "SELECT url, page_id FROM pages")
def _(t):
    return t.pages.select("url", "page_id")


@query("src_es_page", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return t.orders.filter("o_orderstatus = 'F'").select("o_orderkey")
