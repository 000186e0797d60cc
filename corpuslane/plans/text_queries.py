"""Queries of the text functions over whole documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import query


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_steps(c: str, steps: list[tuple[str, str]]) -> str:
    return reduce(lambda x, s: f"regexp_replace({x}, {lit(s[0])}, {lit(s[1])}, 'g')", steps, c)


NORM = f"regexp_replace({sql_steps('{c}', T.NORM_STEPS)}, {lit(T.JOINED)}, '\\1\\2', 'g')"
NATIONAL = f"translate({{c}}, {lit(T.ACCENTED)}, {lit(T.PLAIN)})"
SPACES = lit(T.BLANK + "+")


def sql_space(c: str) -> str:
    return f"trim(regexp_replace({c}, {SPACES}, ' ', 'g'), ' ')"


def national(c: str) -> str:
    return NATIONAL.replace("{c}", c)


@query("hash24", "SELECT doc_id, ('0x' || substr(md5(text), 1, 6))::INT AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", T.hash24(F.col("text")).alias("h"))


@query("norm_text", f"SELECT page_id, md5({NORM.replace('{c}', 'html')}) AS clean FROM pages")
def _(t):
    return t.pages.select("page_id", F.md5(T.norm_text(F.col("html"))).alias("clean"))


@query("normalize_record", f"SELECT doc_id, md5({NORM.replace('{c}', 'text')}) AS objective, {NORM.replace('{c}', 'split_part(text, chr(10), 1)')} AS title FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(T.norm_text(F.col("text"))).alias("objective"), T.norm_text(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"))


@query("norm_national", f"SELECT doc_id, md5({national('text')}) AS plain FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(T.norm_national(F.col("text"))).alias("plain"))


_PUB = f"lower({sql_space('regexp_replace(regexp_replace(' + national('{c}') + ', ' + lit(chr(92) + '([^)]*' + chr(92) + ')') + chr(44) + chr(39)*2 + chr(44) + lit('g') + '), ' + lit('[^A-Za-z0-9 ]') + chr(44) + chr(39)*2 + chr(44) + lit('g') + ')')})"


@query("norm_publication", f"SELECT doc_id, {_PUB.replace('{c}', 'split_part(text, chr(10), 1)')} AS title_normalized FROM documents")
def _(t):
    return t.documents.select("doc_id", T.norm_publication(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title_normalized"))


_FORMS = reduce(lambda e, f: f"CASE WHEN w = '{f[0]}' THEN '{f[1]}' ELSE {e} END", T.ORG_FORMS, "w")
_WORDS = ", ".join(f"'{w}'" for w in T.ORG_WORDS)
_NAT_TITLE = national("replace(t, '&', ' and ')")


@query(
    "norm_organization",
    f"""WITH d AS (SELECT doc_id, 'Univerzita of ' || source || ' & Dept. for ' || split_part(text, ' ', 1) || ', Ltd' AS t FROM documents),
    x AS (SELECT doc_id, {sql_space(f"regexp_replace(lower({_NAT_TITLE}), '[^a-z0-9_]', ' ', 'g')")} AS s FROM d)
    SELECT doc_id, array_to_string(list_transform(list_filter(string_split(s, ' '), lambda w: w NOT IN ({_WORDS}) AND w <> ''), lambda w: {_FORMS}), ' ') AS org FROM x""",
)
def _(t):
    title = F.concat(F.lit("Univerzita of "), "source", F.lit(" & Dept. for "), F.split_part("text", F.lit(" "), F.lit(1)), F.lit(", Ltd"))
    return t.documents.select("doc_id", T.norm_organization(title).alias("org"))


_P = "regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(" + national("t") + ", '([A-Z0-9]+-){2,}[A-Z0-9]+', '', 'g'), '[^A-Za-z0-9_]', ' ', 'g')), 'projects?', '', 'g'), '^ *and', '', 'g')"


@query(
    "norm_project",
    f"""WITH d AS (SELECT p_partkey, 'IST-' || p_size || '-A' || p_partkey || ' And Project ' || p_name || ' ' || (1990 + p_size) || ' study' AS t FROM part),
    x AS (SELECT p_partkey, {_P} AS s FROM d), y AS (SELECT p_partkey, s, regexp_extract(s, '(19[0-9][0-9]|20[0-9][0-9])', 1) AS yr FROM x)
    SELECT p_partkey, {sql_space("CASE WHEN yr <> '' THEN replace(s, yr, '') || ' ' || yr ELSE s END")} AS proj FROM y""",
)
def _(t):
    name = F.concat(F.lit("IST-"), F.col("p_size").cast("string"), F.lit("-A"), F.col("p_partkey").cast("string"), F.lit(" And Project "), "p_name", F.lit(" "), (F.col("p_size") + 1990).cast("string"), F.lit(" study"))
    return t.part.select("p_partkey", T.norm_project(name).alias("proj"))


_EV = "regexp_replace(regexp_replace(" + national("t") + ", '(?i)^(in )? ?(online )?proc[^ ]* ?(of)? ?(the)?', ''), '(?i) ?[0-9]+(th|st|nd|rd)', '', 'g')"
_EL = "regexp_replace(regexp_replace(regexp_replace(s, '[^A-Za-z ]', '', 'g'), '(?i)^ ?[a-z]{2,10}th ', ''), '(?i)^.*annual', '')"


@query(
    "norm_event",
    f"""WITH d AS (SELECT p_partkey, 'Proceedings of the ' || p_size || 'th Annual Conference on ' || p_name || ' ' || CASE WHEN p_partkey % 2 = 0 THEN (1960 + p_size)::VARCHAR ELSE lpad((p_partkey % 100)::VARCHAR, 2, '0') END AS t FROM part),
    x AS (SELECT p_partkey, {_EV} AS s FROM d),
    y AS (SELECT p_partkey, s, list_max(list_transform(regexp_extract_all(s, '[0-9]+'), lambda n: CASE WHEN length(n) = 2 THEN CASE WHEN n::INT > 50 THEN n::INT + 1900 ELSE n::INT + 2000 END WHEN length(n) = 4 AND n::BIGINT BETWEEN 1901 AND 2099 THEN n::INT END)) AS yr FROM x)
    SELECT p_partkey, {sql_space(f"CASE WHEN yr IS NOT NULL THEN {_EL} || ' ' || yr ELSE {_EL} END")} AS ev FROM y""",
)
def _(t):
    year = F.when(F.col("p_partkey") % 2 == 0, (F.col("p_size") + 1960).cast("string")).otherwise(F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"))
    name = F.concat(F.lit("Proceedings of the "), F.col("p_size").cast("string"), F.lit("th Annual Conference on "), "p_name", F.lit(" "), year)
    return t.part.select("p_partkey", T.norm_event(name).alias("ev"))


@query(
    "norm_location",
    """WITH x AS (SELECT n_nationkey, array_to_string(list_transform(string_split(lower(n_name || ' UPON ' || n_nationkey || ' river'), ' '), lambda w: CASE WHEN w IN ('of','am','an','and','de','la','le','upon','nad') THEN w ELSE upper(substr(w, 1, 1)) || substr(w, 2) END), ' ') AS s FROM nation),
    y AS (SELECT n_nationkey, trim(regexp_replace(s, '[0-9]+', '', 'g'), ' ') AS s FROM x)
    SELECT n_nationkey, CASE WHEN length(s) >= 2 THEN upper(substr(s, 1, 1)) || substr(s, 2) END AS loc FROM y""",
)
def _(t):
    name = F.concat("n_name", F.lit(" UPON "), F.col("n_nationkey").cast("string"), F.lit(" river"))
    return t.nation.select("n_nationkey", T.norm_location(name, True).alias("loc"))


_CLEAN = reduce(lambda e, p: f"replace({e}, '{p[0]}', '{p[1]}')", T.LIGATURES, "text")
_FROM, _TO = T.ACCENTED + T.QUOTES + T.DASHES + "’‘", T.PLAIN + '"' * len(T.QUOTES) + "-" * len(T.DASHES) + "''"

#: clean_text() of the column text.
CLEAN_SQL = f"regexp_replace(translate({_CLEAN}, {lit(_FROM)}, {lit(_TO)}), '[^\\x09\\x0A\\x0D\\x20-\\x7E]', '', 'g')"


@query("clean_text", f"SELECT doc_id, md5({CLEAN_SQL}) AS clean FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("clean"))


@query("to_ascii", f"SELECT doc_id, md5(regexp_replace({national('text')}, '[^\\x00-\\x7F]', '', 'g')) AS a FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(T.to_ascii(F.col("text"))).alias("a"))


@query("white_space", f"SELECT doc_id, md5({sql_space('text')}) AS w FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(T.white_space(F.col("text"))).alias("w"))
