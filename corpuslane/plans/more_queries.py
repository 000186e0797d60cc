"""Queries of what the other modules leave out: readers, registries, checks and import order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import html as H
from ..functions import segment as S
from ..functions import text as T
from ..operators import dictionary as D
from ..operators import records as R
from ..operators import store as P
from ..sources import files
from ..sources.scratch import scratch_dir
from .extract_queries import CITE_SQL, cites
from .registry import query
from .store_queries import PROBES, parties
from .text_queries import CLEAN_SQL


@query("src_xml_dir", "SELECT p_partkey, p_name AS title, 'x' || p_size AS link FROM part")
def _(t):
    xml = F.concat(F.lit("<r><e><title>"), "p_name", F.lit("</title><link>x"), F.col("p_size").cast("string"), F.lit("</link></e></r>"))
    return t.part.select("p_partkey", F.explode(files.title_links(xml)).alias("e")).select("p_partkey", "e.title", "e.link")


@query("src_pdf", "SELECT count(*) AS n, sum(length(url))::BIGINT AS chars FROM pages")
def _(t):
    path = scratch_dir(t.spark)
    t.pages.select("url").coalesce(1).write.text(path)
    out = files.converted(t.spark, path + "/*.txt", lambda b: b.decode())
    return out.select(F.explode(F.split("text", "\n")).alias("l")).filter("l <> ''").agg(F.count("*").alias("n"), F.sum(F.length("l")).alias("chars"))


@query("file_clean", f"SELECT count(*) AS lines, sum(length({CLEAN_SQL}))::BIGINT AS chars FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents)")
def _(t):
    path = scratch_dir(t.spark)
    t.documents.select("text").write.mode("overwrite").text(path)
    lines = t.spark.read.option("lineSep", "\n").text(path).select(T.clean_text(F.col("value")).alias("l"))
    return lines.agg(F.count("*").alias("lines"), F.sum(F.length("l")).alias("chars"))


@query("sink_db_insert", "SELECT s_suppkey AS id, s_name AS title FROM supplier UNION ALL SELECT 1000 + n_nationkey, n_name FROM nation")
def _(t):
    old = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    new = t.nation.select((F.col("n_nationkey") + 1000).cast("bigint").alias("id"), F.col("n_name").alias("title"), F.lit(50).alias("credibility"))
    meta = t.spark.createDataFrame([], "entity_id bigint, module_id bigint, credibility int, changed timestamp")
    return P.insert(old, new, meta, 3, F.current_timestamp())[0]


@query("dict_sensitivity", "SELECT 'sensitive' AS mode, 0 AS n UNION ALL SELECT 'insensitive', 25 UNION ALL SELECT 'first_upper', 0")
def _(t):
    words = t.nation.select(F.col("n_name").alias("key"), F.array("n_name").alias("values"))
    probes = t.nation.select(F.lower("n_name").alias("w"))
    made = [D.contains_key(probes, "w", words, m).agg(F.count("*").cast("int").alias("n")).select(F.lit(m).alias("mode"), "n") for m in (D.SENSITIVE, D.INSENSITIVE, D.FIRST_UPPER)]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query("ee_registry", f"WITH {CITE_SQL} SELECT id, '80-' || s || '-' || id || '-X' AS isbn, s AS volume FROM cites")
def _(t):
    return E.extract(cites(t), "t", 4 | 32).select("id", "isbn", "volume")


@query("ee_fax", "SELECT p_partkey, '+420 541 141 ' || (100 + p_partkey % 900) AS fax FROM part")
def _(t):
    text = F.concat(F.lit("Tel: +420 111 222 333, Fax: +420 541 141 "), (F.col("p_partkey") % 900 + 100).cast("string"), F.lit("."))
    return t.part.select("p_partkey", E.fax(text).alias("fax"))


@query("ee_person_shapes", "SELECT 'surname_initials' AS shape, 'Novak' AS last UNION ALL SELECT 'initials_surname', 'Kral' UNION ALL SELECT 'surname_name', 'Maly' UNION ALL SELECT 'name_initial_surname', 'Dvorak' UNION ALL SELECT 'name_surname', 'Bily'")
def _(t):
    df = t.spark.createDataFrame([("Novak, J. A.",), ("P. Kral",), ("Maly, Jan",), ("Jan B. Dvorak",), ("Karel Bily",)], "t string")
    return df.select(F.try_element_at(E.persons(F.col("t")), F.lit(1)).alias("p")).select("p.shape", "p.last")


@query("ee_org_check", f"WITH {CITE_SQL} SELECT id, 2 AS n FROM cites")
def _(t):
    good = F.filter(E.organizations(F.col("t")), lambda o: (F.length(o["title"]) >= 10) & E.event_type(o["title"]).isNull() & (o["credibility"] > 0))
    return cites(t).select("id", F.size(good).alias("n"))


@query("doc_chap_roman", "SELECT doc_id, '1' AS number, 'Introduction' AS name FROM documents UNION ALL SELECT doc_id, '2', 'Methods and so on' FROM documents")
def _(t):
    d = t.documents.select("doc_id", F.concat(F.lit("Top\nI. Introduction\nx\nII. Methods and so on\n"), "source").alias("t"))
    return S.chapters(d, "doc_id", "t").select("doc_id", "number", "name")


@query("seq_tagmatch", "SELECT page_id, 'ul>li>a' AS path FROM pages WHERE html LIKE '%<li><a%'")
def _(t):
    return H.per_page(t.pages, H.link_path, "path string")


@query("er_rules_api", f"WITH {PROBES} SELECT count(*) AS n FROM pr WHERE nation IN (SELECT nation FROM en) OR band IN (SELECT band FROM en)")
def _(t):
    rules = [["nation"]]
    rules.append(["band"])  # a rule of the user's
    return P.lookup_exact(*parties(t), rules).agg(F.count("*").alias("n"))


@query("er_import", "SELECT 'parent' AS kind, r_regionkey::BIGINT AS id, NULL::BIGINT AS parent FROM region UNION ALL SELECT 'child', n_nationkey, n_regionkey FROM nation")
def _(t):
    region = t.region.select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("title"))
    known = region.filter("id < 3")
    # the same regions arrive under other keys
    arriving = region.select((F.col("id") + F.when(F.col("id") < 3, 100).otherwise(0)).alias("id"), "title")
    links = t.nation.select(F.col("n_nationkey").cast("bigint").alias("id"), (F.col("n_regionkey") + F.when(F.col("n_regionkey") < 3, 100).otherwise(0)).cast("bigint").alias("parent"))
    children = links.select("id", F.lit(None).cast("bigint").alias("parent"))
    parents, children = P.import_graph(arriving, known, children, links, [["title"]])
    return parents.select(F.lit("parent").alias("kind"), "id", F.lit(None).cast("bigint").alias("parent")).unionByName(children.select(F.lit("child").alias("kind"), "id", "parent"))


@query("web_below_header", "SELECT page_id, true AS below FROM pages WHERE html LIKE '%<h1>%'")
def _(t):
    return H.below_headers(H.node_table(t.pages)).groupBy("page_id").agg((F.count("*") > 0).alias("below"))


@query("web_topic", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 'Graph theory' END AS topic FROM part")
def _(t):
    header = F.when(F.col("p_partkey") % 2 == 0, "Journal papers").otherwise("Graph theory")
    return t.part.select("p_partkey", R.topic(header).alias("topic"))


@query("web_unbound", "SELECT p_partkey, '80-1-2-X' AS isbn FROM part")
def _(t):
    parts = F.array(F.lit("some text"), F.concat(F.lit("on "), "p_name"), F.lit("ISBN 80-1-2-X"))
    return t.part.select("p_partkey", R.first_found(parts, E.isbn).alias("isbn"))
