"""Dictionary and classification queries; part names, nations and document words stand in for dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import dictionary as D
from .registry import query
from .search_queries import words

BY_BRAND = "dict AS (SELECT p_brand AS key, list_sort(list(DISTINCT p_type)) AS vals FROM part GROUP BY p_brand)"


def by_brand(t):
    return D.create(t.part, "p_brand", "p_type")


def nations(t):
    return t.nation.select(F.col("n_name").alias("key"), F.array(F.col("n_regionkey").cast("string")).alias("values"))


@query("sink_dict", f"WITH {BY_BRAND} SELECT key, array_to_string(vals, '|') AS vals FROM dict")
def _(t):
    return by_brand(t).select("key", F.array_join("values", "|").alias("vals"))


@query("src_dict", f"WITH {BY_BRAND}, v AS (SELECT count(DISTINCT p_type) AS n_values FROM part) SELECT count(*) AS n_keys, n_values, min(length(key))::INT AS min_key_length, bool_and(NOT regexp_matches(key, '[^A-Za-z0-9_]')) AS simple_keys FROM dict, v GROUP BY n_values")
def _(t):
    return D.info(by_brand(t))


@query("dict_contains_key", "SELECT s_suppkey, lower(n_name) AS nm FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 0")
def _(t):
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.lower("n_name")).otherwise(F.concat("n_name", F.lit("x"))).alias("nm"))
    return D.contains_key(s, "nm", nations(t), D.INSENSITIVE)


@query("dict_first_upper", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) END AS nm FROM nation WHERE n_nationkey % 2 = 1")
def _(t):
    n = t.nation.select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.substring("n_name", 2, 99)))).alias("nm"))
    return D.contains_key(n, "nm", nations(t), D.FIRST_UPPER)


@query("dict_contains_value", "SELECT p_partkey, p_type FROM part WHERE p_type IN (SELECT p_type FROM part WHERE p_size < 5)")
def _(t):
    few = D.create(t.part.filter("p_size < 5"), "p_brand", "p_type")
    return D.contains_value(t.part.select("p_partkey", "p_type"), "p_type", few)


KEYS = "keys AS (SELECT w AS key FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM benchmark) WHERE length(w) >= 3 GROUP BY w)"


def keys(t):
    return t.benchmark.select(F.explode(F.split("text", "[^A-Za-z]+")).alias("key")).filter("length(key) >= 3").distinct()


@query(
    "dict_text_search",
    f"WITH {KEYS}, w AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[^A-Za-z0-9_À-ÿ-]', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents), e AS (SELECT doc_id, unnest(generate_series(0, len(w) - 1)) AS pos, unnest(w) AS hit FROM w) SELECT doc_id, pos::INT AS pos, hit FROM e WHERE hit IN (SELECT key FROM keys)",
)
def _(t):
    return D.text_search(t.documents, "doc_id", "text", keys(t))


@query(
    "dict_text_search_phrases",
    """WITH p AS (SELECT lower(n_name) || ' ' || lower(r_name) AS key FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT lower(r_name) FROM region),
    s AS (SELECT s_suppkey, lower(n_name) || ' ' || lower(r_name) AS a FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT s_suppkey, 1 AS pos, a AS hit FROM s WHERE a NOT LIKE 'united %' AND a NOT LIKE 'saudi %' UNION ALL SELECT s_suppkey, 1, a FROM s WHERE a LIKE 'united %' OR a LIKE 'saudi %'""",
)
def _(t):
    names = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.lower("n_name").alias("n"), F.lower("r_name").alias("r"))
    words_ = names.select(F.concat("n", F.lit(" "), "r").alias("key")).unionByName(names.select(F.col("r").alias("key"))).distinct()
    s = t.supplier.join(names, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("in "), "n", F.lit(" "), "r", F.lit(" now")).alias("txt"))
    return D.text_search(s, "s_suppkey", "txt", words_, 4)


@query("dict_translate", f"WITH {BY_BRAND} SELECT p_partkey, array_to_string(vals, '|') AS vals FROM part LEFT JOIN dict ON key = CASE WHEN p_partkey % 3 = 0 THEN 'none' ELSE p_brand END")
def _(t):
    p = t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "none").otherwise(F.col("p_brand")).alias("b"))
    return D.translate(p, "b", by_brand(t)).select("p_partkey", F.array_join("values", "|").alias("vals"))


@query("dict_prefix", f"WITH {BY_BRAND} SELECT key FROM dict WHERE starts_with(key, 'Brand#1')")
def _(t):
    return D.starts_with(by_brand(t), "Brand#1").select("key")


@query("dict_extend", "SELECT p_brand AS key, array_to_string(list_sort(list(DISTINCT p_type)), '|') AS vals FROM part WHERE p_size < 10 OR p_size > 40 GROUP BY p_brand")
def _(t):
    a, b = D.create(t.part.filter("p_size < 10"), "p_brand", "p_type"), D.create(t.part.filter("p_size > 40"), "p_brand", "p_type")
    return D.extend(a, b).select("key", F.array_join("values", "|").alias("vals"))


@query("dict_add", "SELECT n_name AS key, n_regionkey::VARCHAR AS vals FROM nation UNION ALL SELECT 'ATLANTIS', '9'")
def _(t):
    new = t.spark.createDataFrame([("ATLANTIS", ["9"]), ("NATION_3", ["7"])], "key string, values array<string>")
    return D.add(nations(t), new, append=False).select("key", F.array_join("values", "|").alias("vals"))


@query("dict_sizes", f"WITH {BY_BRAND} SELECT key, len(vals)::INT AS n FROM dict")
def _(t):
    return by_brand(t).select("key", F.size("values").alias("n"))


@query("geo_up", "SELECT s_suppkey, n_name AS country, r_name AS continent FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(t):
    up = lambda df, k, v: D.create(df.select(F.col(k).cast("string").alias("k"), F.col(v).cast("string").alias("v")), "k", "v")
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("string").alias("place"))
    out = D.go_up(s, "place", ("country", up(t.nation, "n_nationkey", "n_name"), -1), ("region_", up(t.nation, "n_name", "n_regionkey"), 1), ("continent", up(t.region, "r_regionkey", "r_name"), 1))
    return out.select("s_suppkey", "country", "continent")


MODEL = f"""tok AS (SELECT lang, unnest({words('text')}) AS term FROM documents), cnt AS (SELECT lang, term, count(*) AS n FROM tok GROUP BY ALL),
model AS (SELECT lang, term, n / total AS p FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS total, rank() OVER (PARTITION BY lang ORDER BY n DESC) AS r FROM cnt) WHERE r <= 20)"""
SCORED = f"""{MODEL}, dt AS (SELECT doc_id, unnest({words('text')}) AS term FROM documents), sc AS (SELECT doc_id, m.lang, sum(p) AS score FROM dt JOIN model m USING (term) GROUP BY ALL)"""


@query("lang_train", f"WITH {MODEL} SELECT lang, term, round(p, 9) AS p FROM model")
def _(t):
    return C.train(t.documents, "lang", "text").select("lang", "term", F.round("p", 9).alias("p"))


@query("lang_all", f"WITH {SCORED} SELECT doc_id, lang, round(score / sum(score) OVER (PARTITION BY doc_id), 6) AS share FROM sc")
def _(t):
    return C.scores(t.documents, "doc_id", "text", C.train(t.documents, "lang", "text")).select("doc_id", "lang", F.round("share", 6).alias("share"))


@query("lang_identify", f"WITH {SCORED}, b AS (SELECT *, score / sum(score) OVER (PARTITION BY doc_id) AS share, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, lang DESC) AS r FROM sc) SELECT d.doc_id, b.lang, round(coalesce(share, 0), 6) AS share FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id AND r = 1")
def _(t):
    return C.identify(t.documents, "doc_id", "text", C.train(t.documents, "lang", "text")).select("doc_id", "lang", F.round("share", 6).alias("share"))


@query("lang_prob", f"WITH {MODEL} SELECT lang, round(coalesce(max(p) FILTER (term = 'the'), 0), 9) AS p FROM model GROUP BY lang")
def _(t):
    return C.train(t.documents, "lang", "text").groupBy("lang").agg(F.round(F.coalesce(F.max(F.when(F.col("term") == "the", F.col("p"))), F.lit(0.0)), 9).alias("p"))


@query("text_sample")
def _(t):
    return t.documents.select("doc_id", C.sample_word(F.col("text"), 3).alias("word"))


def type_sql() -> str:
    head = "lower(substr(text, 1, 5000))"
    sums = ", ".join(" + ".join(f"CASE WHEN contains({head}, '{p}') THEN {w} ELSE 0 END" for p, w in ws) + f" AS s_{k}" for k, ws in C.TYPE_WEIGHTS.items())
    cases = " ".join(f"WHEN s_{k} = best THEN '{k}'" for k in C.TYPE_WEIGHTS)
    return f"WITH s AS (SELECT doc_id, {sums} FROM documents), b AS (SELECT *, greatest({', '.join('s_' + k for k in C.TYPE_WEIGHTS)}) AS best FROM s) SELECT doc_id, CASE WHEN best = 0 THEN 'misc' WHEN s_article = best AND s_unpublished > 0 AND best - s_unpublished <= 20 THEN 'unpublished' {cases} END AS kind FROM b"


@query("doc_type", type_sql())
def _(t):
    return t.documents.select("doc_id", C.document_type(F.col("text")).alias("kind"))


@query(
    "conv_credibility",
    f"""WITH known AS (SELECT DISTINCT lower(w) AS key FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM benchmark) WHERE length(w) >= 3),
    w AS (SELECT doc_id, 1 + doc_id % 3 AS pages, list_filter({words('text')}, lambda x: length(x) >= 3) AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS t FROM w), ok AS (SELECT doc_id, count(*) AS ok FROM e WHERE t IN (SELECT key FROM known) GROUP BY doc_id)
    SELECT w.doc_id, CASE WHEN len(w) = 0 THEN 0 ELSE floor(round(coalesce(ok, 0) / len(w) * least(1.0, coalesce(ok, 0) / pages / 80) * 100, 9))::INT END AS credibility FROM w LEFT JOIN ok ON w.doc_id = ok.doc_id""",
)
def _(t):
    known = keys(t).select(F.lower("key").alias("key")).distinct()
    return C.conversion_credibility(t.documents, "doc_id", "text", F.col("doc_id") % 3 + 1, known)
