"""Search queries; documents stand in for an index of projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from .registry import query

PROJECTS = """projects AS (SELECT doc_id AS id, source || '-' || doc_id AS abbr, split_part(text, chr(10), 1) AS title, text AS objective, lang AS programme, lang || '-' || (doc_id % 4) AS subprogramme,
    source AS coordinator, 2000 + doc_id % 15 AS year, [source, 'src' || (doc_id % 5), 'SRC' || (doc_id % 5)] AS participant, ['C' || (doc_id % 7), 'C' || (doc_id % 3)] AS country FROM documents)"""
WORDS = r"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9à-öø-ÿ]+'), lambda w: w <> '')"


def projects(t):
    d = t.documents
    s = lambda c: c.cast("string")
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat("source", F.lit("-"), s(F.col("doc_id"))).alias("abbr"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("objective"),
        F.col("lang").alias("programme"),
        F.concat("lang", F.lit("-"), s(F.col("doc_id") % 4)).alias("subprogramme"),
        F.col("source").alias("coordinator"),
        (F.col("doc_id") % 15 + 2000).alias("year"),
        F.array("source", F.concat(F.lit("src"), s(F.col("doc_id") % 5)), F.concat(F.lit("SRC"), s(F.col("doc_id") % 5))).alias("participant"),
        F.array(F.concat(F.lit("C"), s(F.col("doc_id") % 7)), F.concat(F.lit("C"), s(F.col("doc_id") % 3))).alias("country"),
    )


def words(c: str) -> str:
    return WORDS.replace("{c}", c)


def match_sql(terms: list[str]) -> str:
    fields = {"abbr": 6, "title": 5, "subprogramme": 3, "objective": 1}
    tf = ", ".join(f"len(list_filter({f}_w, lambda x: x = '{w}')) AS {f}_{i}" for f in fields for i, w in enumerate(terms))
    cut = ", ".join(f"{words(f)} AS {f}_w" for f in fields)
    df = ", ".join(f"count(*) FILTER ({f}_{i} > 0) AS d_{f}_{i}" for f in fields for i in range(len(terms)))
    score = ", ".join("(" + " + ".join(f"{f}_{i} * ln(1 + (n - d_{f}_{i} + 0.5) / (d_{f}_{i} + 0.5))" for i in range(len(terms))) + f") * {b}" for f, b in fields.items())
    return f"""{PROJECTS}, cut AS (SELECT *, {cut} FROM projects), tf AS (SELECT *, {tf} FROM cut), df AS (SELECT count(*) AS n, {df} FROM tf),
    hits AS (SELECT p.*, round(greatest({score}), 6) AS score FROM tf p, df)"""


MATCH = f"WITH {match_sql(['the', 'license', 'ontion'])}"


@query("kw_match_all", f"WITH {PROJECTS} SELECT id, title FROM projects")
def _(t):
    return S.multi_match(projects(t), "").select("id", "title")


@query("kw_multi_match", f"{MATCH} SELECT id, score FROM hits WHERE score > 0")
def _(t):
    return S.multi_match(projects(t), "the license ontion").select("id", "score")


@query("kw_phrase", f"WITH {PROJECTS} SELECT id, CASE WHEN contains(' ' || array_to_string({words('title')}, ' ') || ' ', ' licensed under ') THEN 5.0 ELSE 1.0 END::DOUBLE AS score FROM projects WHERE contains(' ' || array_to_string({words('objective')}, ' ') || ' ', ' licensed under ')")
def _(t):
    return S.phrase_match(projects(t), '"Licensed under"').select("id", "score")


@query("kw_highlight", f"WITH {PROJECTS} SELECT id, regexp_replace(title, '(?i)\\b(the|license)\\b', '<b>\\1</b>', 'g') AS h FROM projects")
def _(t):
    return projects(t).select("id", S.highlight(F.col("title"), "the License").alias("h"))


@query("kw_page", f"{MATCH} SELECT id, score FROM hits WHERE score > 0 ORDER BY score DESC, id LIMIT 20 OFFSET 20")
def _(t):
    return S.page(S.multi_match(projects(t), "the license ontion"), "1").select("id", "score")


FACETED = "SELECT 'programme' AS facet, lower(programme) AS term FROM {r} UNION ALL SELECT 'subprogramme', lower(subprogramme) FROM {r} UNION ALL SELECT 'year', year::VARCHAR FROM {r} UNION ALL SELECT 'coordinator', lower(coordinator) FROM {r} UNION ALL SELECT 'participant', unnest(list_distinct(list_transform(participant, lambda v: lower(v)))) FROM {r} UNION ALL SELECT 'country', unnest(list_distinct(list_transform(country, lambda v: lower(v)))) FROM {r}"
TOP = "SELECT facet, term, n, rank FROM (SELECT facet, term, count(*) AS n, row_number() OVER (PARTITION BY facet ORDER BY count(*) DESC, term)::INT AS rank FROM ({f}) GROUP BY facet, term) WHERE rank <= 20"


def top_sql(rows: str) -> str:
    return TOP.replace("{f}", FACETED.replace("{r}", rows))


CHOSEN = {"programme": ["EN", "fr"], "country": ["c1", "C5"]}
CHOSEN_SQL = "chosen AS (SELECT * FROM projects WHERE lower(programme) IN ('en', 'fr') AND len(list_filter(country, lambda v: lower(v) IN ('c1', 'c5'))) > 0)"


@query("facet_counts", f"{MATCH}, matched AS (SELECT * FROM hits WHERE score > 0) {top_sql('matched')}")
def _(t):
    return S.facet_counts(S.multi_match(projects(t), "the license ontion"), S.FACETS)


@query("facet_filter", f"WITH {PROJECTS}, {CHOSEN_SQL} SELECT id, programme, year FROM chosen")
def _(t):
    return S.facet_filter(projects(t), CHOSEN).select("id", "programme", "year")


@query("facet_merge", f"WITH {PROJECTS}, {CHOSEN_SQL}, base AS ({top_sql('projects')}), few AS ({top_sql('chosen')}) SELECT b.facet, b.term, coalesce(f.n, 0) || ' z ' || b.n AS label FROM base b LEFT JOIN few f ON b.facet = f.facet AND b.term = f.term")
def _(t):
    p = projects(t)
    return S.facet_merge(S.facet_counts(p, S.FACETS), S.facet_counts(S.facet_filter(p, CHOSEN), S.FACETS))


@query("filter_parse", "SELECT * FROM (VALUES ('country', 'Czech Republic'), ('programme', 'fp7'), ('programme', 'a=b')) v(field, val)")
def _(t):
    parsed = S.filter_parse(['programme=fp7', 'country="Czech Republic"', "programme=a=b", "nothing"])
    return t.spark.createDataFrame([(f, v) for f, vs in parsed.items() for v in vs], "field string, val string")


@query("query_serialize", "SELECT 'keyword=k AND country=France AND (programme=b OR programme=a)' AS q")
def _(t):
    return t.spark.createDataFrame([(S.query_serialize({"programme": ["a", "b"], "country": ["France"]}, "k"),)], "q string")


@query("query_parse", "SELECT * FROM (VALUES (1, 'young people'), (2, '\"a b\" c'), (3, '')) v(i, q)")
def _(t):
    return t.spark.createDataFrame([(i, S.query_parse(q)) for i, q in enumerate(["keyword=young OR people AND year=2009", 'keyword="a b" OR c', "year=1"], 1)], "i int, q string")


@query("legacy_query", "SELECT * FROM (VALUES ('', 'nuclear'), ('country', 'Czech Republic'), ('subprogramme', 'PEOPLE'), ('', 'a:b')) v(field, val)")
def _(t):
    keywords, specs = S.legacy_query('nuclear country:"Czech Republic" "subprogramme":PEOPLE a\\:b')
    return t.spark.createDataFrame([("", k) for k in keywords] + list(specs.items()), "field string, val string")


@query("get_by_id", "SELECT o_orderkey, o_totalprice, l_linenumber AS child_id, l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders) ORDER BY l_linenumber LIMIT 50")
def _(t):
    first = t.orders.agg(F.min("o_orderkey")).first()[0]
    lines = t.lineitem.select(F.col("l_orderkey").alias("parent_id"), F.col("l_linenumber").alias("child_id"), "l_partkey")
    return S.get_by_id(t.orders.select("o_orderkey", "o_totalprice"), lines, "o_orderkey", first)


@query(
    "more_like_this",
    f"""WITH {PROJECTS}, toks AS (SELECT id, unnest({words('objective')}) AS w FROM projects), src AS (SELECT w, count(*) AS tf FROM toks WHERE id = 11 GROUP BY w),
    df AS (SELECT w, count(DISTINCT id) AS df FROM toks GROUP BY w), n AS (SELECT count(*) AS n FROM projects),
    top AS (SELECT w, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM src JOIN df USING (w), n ORDER BY round(tf * ln(1 + (n - df + 0.5) / (df + 0.5)), 9) DESC, w LIMIT 25)
    SELECT id, round(sum(idf), 6) AS score FROM toks JOIN top USING (w) WHERE id <> 11 GROUP BY id ORDER BY score DESC, id LIMIT 3""",
)
def _(t):
    return S.more_like_this(projects(t), 11)
