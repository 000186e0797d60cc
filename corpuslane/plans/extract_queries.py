"""Extraction queries over documents and over citation-like strings made from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions.spread import spread
from .registry import query
from .text_queries import lit

CITE_SQL = """cites AS (SELECT p_partkey AS id, p_size AS s, 'Novak, J. A. and P. Kral: ' || p_name || ' methods for ' || p_type || '. In Proc. 12th International Conference on Fuzzy Systems, vol. ' || p_size || ', pp. ' || p_partkey || '-' || (p_partkey + p_size) || ', 12 March ' || (1980 + p_size % 40) || CASE WHEN p_size % 5 = 0 THEN ' (to appear)' ELSE '' END || '. Published by Springer Verlag, ISBN 80-' || p_size || '-' || p_partkey || '-X, ISSN 0317-8471, 1234-567' || (p_partkey % 10) || '. See http://ex.org/' || p_partkey || '., mail j(at)ex.org and {a,b}@uni.cz, tel +420 541 141 ' || (100 + p_partkey % 900) || ' or +44.20.7946.0' || (100 + p_partkey % 900) || ', 10:' || lpad((p_size % 60)::VARCHAR, 2, '0') || ' PM, host 10.0.' || p_size || '.1, 12 Long Hill Street, Faculty of Science, Brno University of Technology' AS t FROM part)"""


def cites(t):
    p, s, k = F.col, F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    n = (F.col("p_partkey") % 900 + 100).cast("string")
    parts = ["Novak, J. A. and P. Kral: ", p("p_name"), " methods for ", p("p_type"), ". In Proc. 12th International Conference on Fuzzy Systems, vol. ", s, ", pp. ", k, "-", (F.col("p_partkey") + F.col("p_size")).cast("string"), ", 12 March ", (F.col("p_size") % 40 + 1980).cast("string"), F.when(F.col("p_size") % 5 == 0, " (to appear)").otherwise(""), ". Published by Springer Verlag, ISBN 80-", s, "-", k, "-X, ISSN 0317-8471, 1234-567", (F.col("p_partkey") % 10).cast("string"), ". See http://ex.org/", k, "., mail j(at)ex.org and {a,b}@uni.cz, tel +420 541 141 ", n, " or +44.20.7946.0", n, ", 10:", F.lpad((F.col("p_size") % 60).cast("string"), 2, "0"), " PM, host 10.0.", s, ".1, 12 Long Hill Street, Faculty of Science, Brno University of Technology"]
    rows = spread(t.part.select("p_partkey", "p_name", "p_type", "p_size"), "p_partkey")
    return rows.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("s"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("t"))


def on_cites(name: str, sql: str | None, columns):
    @query(name, f"WITH {CITE_SQL} {sql}" if sql else None)
    def _(t):
        return cites(t).select("id", *[c.alias(n) for n, c in columns(F.col("t")).items()])


joined = lambda c: F.array_join(c, "|")

query("re_email", f"SELECT doc_id, array_to_string(regexp_extract_all(text, {lit(E.EMAIL)}), '|') AS mails FROM documents")(lambda t: t.documents.select("doc_id", joined(E.all_matches(F.col("text"), E.EMAIL)).alias("mails")))
query("re_ip", f"SELECT doc_id, array_to_string(regexp_extract_all(text, {lit(E.IP)}), '|') AS ips FROM documents")(lambda t: t.documents.select("doc_id", joined(E.all_matches(F.col("text"), E.IP)).alias("ips")))
on_cites("ee_email", "SELECT id, 'a@uni.cz|b@uni.cz|j@ex.org' AS mails FROM cites", lambda T: dict(mails=joined(E.emails(T))))
on_cites("ee_url", "SELECT id, 'http://ex.org/' || id AS urls FROM cites", lambda T: dict(urls=joined(E.urls(T))))
on_cites("ee_isbn", "SELECT id, '80-' || s || '-' || id || '-X' AS isbn FROM cites", lambda T: dict(isbn=E.isbn(T)))
on_cites("ee_issn", "SELECT id, array_to_string(list_filter(regexp_extract_all(t, '[0-9]{4}-[0-9]{3}[0-9X]'), lambda m: list_sum(list_transform(generate_series(1, 8), lambda i: (9 - i) * CASE WHEN substr(replace(m, '-', ''), i::INT, 1) = 'X' THEN 10 ELSE substr(replace(m, '-', ''), i::INT, 1)::INT END)) % 11 = 0), '|') AS issn FROM cites", lambda T: dict(issn=joined(E.issns(T))))
on_cites("ee_pages", "SELECT id, s::BIGINT AS pages FROM cites", lambda T: dict(pages=E.pages(T)))
on_cites("ee_volume", "SELECT id, s AS volume FROM cites", lambda T: dict(volume=E.volume(T)))
on_cites("ee_flags", "SELECT id, s % 5 = 0 AS to_appear, false AS submitted FROM cites", lambda T: dict(to_appear=E.to_appear(T), submitted=E.submitted(T)))
on_cites("ee_phone", "SELECT id, '+420 541 141 ' || (100 + id % 900) || ':Czech Republic|+44 20 7946 0' || (100 + id % 900) || ':United Kingdom' AS phones FROM cites", lambda T: dict(phones=joined(F.transform(E.phones(T), lambda p: F.concat(p["number"], F.lit(":"), F.coalesce(p["country"], F.lit("?")))))))
on_cites("ee_publisher", "SELECT id, regexp_extract(t, '(?i)publish(?:ed by|er):? ([A-Za-z][A-Za-z &-]*[A-Za-z])', 1) AS publisher FROM cites", lambda T: dict(publisher=E.publisher(T)))
on_cites("ee_date", "SELECT id, (1980 + s % 40) || '-3-12' AS dates FROM cites", lambda T: dict(dates=joined(F.transform(F.filter(E.dates(T), lambda d: d["day"].isNotNull()), lambda d: F.concat_ws("-", d["year"].cast("string"), d["month"].cast("string"), d["day"].cast("string"))))))
on_cites("ee_time", "SELECT id, '22:' || (s % 60) AS times FROM cites", lambda T: dict(times=joined(F.transform(E.times(T), lambda d: F.concat_ws(":", d["hour"].cast("string"), d["minute"].cast("string"))))))
on_cites("ee_street", "SELECT id, '12 Long Hill Street' AS street FROM cites", lambda T: dict(street=E.street(T)))
on_cites("ee_address", "SELECT id, regexp_extract(t, '^(.*?) methods', 1) AS address FROM cites", lambda T: dict(address=E.address(T, "methods")))
on_cites("ee_event", "SELECT id, '12th International Conference on Fuzzy Systems:conference:80' AS events FROM cites", lambda T: dict(events=joined(F.transform(E.events(T), lambda e: F.concat_ws(":", e["title"], e["type"], e["credibility"].cast("string"))))))
on_cites("ee_event_type", "SELECT id, 'conference' AS kind FROM cites", lambda T: dict(kind=E.event_type(T)))
on_cites("ee_org", "SELECT id, 'Faculty of Science:faculty:Brno University of Technology|Brno University of Technology:university:' AS orgs FROM cites", lambda T: dict(orgs=joined(F.transform(E.organizations(T), lambda o: F.concat(o["title"], F.lit(":"), o["type"], F.lit(":"), F.coalesce(o["parent"], F.lit("")))))))
on_cites("ee_org_score", "SELECT id, 58 AS score FROM cites", lambda T: dict(score=E.organization_score(F.lit("Faculty of Science"))))
on_cites("ee_person_initials", "SELECT id, 'Novak:J. A.|Kral:P.' AS persons FROM cites", lambda T: dict(persons=joined(F.transform(F.filter(E.persons(T), lambda p: p["shape"].isin("surname_initials", "initials_surname")), lambda p: F.concat(p["last"], F.lit(":"), p["first"])))))
on_cites("ee_title", None, lambda T: dict(title=E.title(T)))
on_cites("ee_booktitle", None, lambda T: dict(booktitle=E.booktitle(T)))
on_cites("ee_person", None, lambda T: dict(persons=joined(F.transform(E.persons(T), lambda p: F.concat(p["last"], F.lit(":"), p["first"], F.lit(":"), p["shape"])))))
on_cites("ee_editors", "SELECT id, '' AS editors FROM cites", lambda T: dict(editors=F.array_join(F.array().cast("array<string>"), "|")))
on_cites("ee_fullname", "SELECT id, 'Jan Novak' AS name FROM cites", lambda T: dict(name=E.full_name(F.lit("Jan"), F.lit(""), F.lit("Novak"))))
on_cites("ee_month_num", "SELECT id, [3, 12, NULL][1 + (id % 3)::INT]::INT AS m FROM cites", lambda T: dict(m=E.month_number(F.element_at(F.array(F.lit("March"), F.lit("dec"), F.lit("x")), (F.col("id") % 3 + 1).cast("int")))))
on_cites("ee_day_num", "SELECT id, 1 + (id % 28)::INT AS d FROM cites", lambda T: dict(d=E.day_number(F.concat((F.col("id") % 28 + 1).cast("string"), F.lit("th")))))


@query("ee_datetime", "SELECT event_id, date_trunc('second', ts) AS stamp FROM events")
def _(t):
    return t.events.select("event_id", F.try_element_at(E.datetimes(F.concat(F.lit("at "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00"))), F.lit(1)).alias("stamp"))


@query("ee_project", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'FP' || p_size || ':50|Big idea:30' ELSE 'AB' || p_size || ':10' END AS projects FROM part")
def _(t):
    s = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("of the FP"), s, F.lit(' project and "Big idea" project, project FP'), s)).otherwise(F.concat(F.lit("in project AB"), s, F.lit(" we")))
    return t.part.select("p_partkey", joined(F.transform(E.projects(text), lambda p: F.concat_ws(":", p["name"], p["credibility"].cast("string")))).alias("projects"))


@query("ee_location", "SELECT s_suppkey, n_name AS city, r_name AS country, CASE WHEN s_suppkey % 2 = 0 THEN 76 ELSE 24 END AS credibility FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(t):
    cities = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("city"), F.col("r_name").alias("country"), "n_nationkey")
    s = t.supplier.join(cities, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("at "), "city", F.lit(", country of "), F.when(F.col("s_suppkey") % 2 == 0, F.col("country")).otherwise(F.lit("x"))).alias("txt"))
    return E.locations(s, "s_suppkey", "txt", cities.select("city", "country"))
