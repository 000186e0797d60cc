"""Heavy work on small tables is spread over the cores, and an extractor works each step out once."""

import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslane.catalog import QUERIES
from corpuslane.functions import bibtex as B
from corpuslane.functions import extract as E
from corpuslane.functions import segment as S
from corpuslane.functions.text import tokens
from corpuslane.operators import classify as CL
from corpuslane.operators import crawl as CR
from corpuslane.operators import dictionary as DI
from corpuslane.operators import store as P
from corpuslane.plans.article_queries import bib
from corpuslane.plans.extract_queries import cites
from corpuslane.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_citations_are_spread(spark):
    df = cites(Tables(spark, SF))
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sum(n > 0 for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("extractor, pattern, most", [(E.dates, E.DATE_KINDS[0][1], 8), (E.emails, E.EMAIL, 1), (E.organizations, E.ORGANIZATION, 1), (E.title, E.BAD_TITLE, 1)])
def test_steps_run_once(spark, extractor, pattern, most):
    df = spark.createDataFrame([("x",)], "t string").select(extractor(F.col("t")).alias("x"))
    assert plan(df).count(pattern) <= most


def test_odd_texts(spark):
    texts = [None, "", "no year", "99999 x1985y", "1 May 1985, May 2, 1986; 1987-13-01 1988", "June 1990", "x1985, 1986", "May 1985 and 3rd May 1999 or 2001/02/31"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [None if r[0] is None else [(d["year"], d["month"], d["day"]) for d in r[0]] for r in df.select(E.dates(F.col("t"))).collect()]
    assert got[:4] == [None, [], [], []]
    assert got[4:] == [[(1985, 5, 1), (1986, 5, 2), (1988, None, None)], [(1990, 6, None)], [(1986, None, None)], [(1999, 5, 3), (2001, 2, 31), (1985, 5, None)]]
    out = S.parse_citation(df, "t").select("year", "month", "event", "organization").collect()
    assert [r.year for r in out] == [None, None, None, None, 1988, 1990, 1986, 2001]
    names = df.select(E.persons(F.lit("Novak, J. A. and P. Kral, Maly, Jan")).alias("p"), E.persons(F.lit(None).cast("string")).alias("n"), E.persons(F.lit("x")).alias("e")).first()
    assert [(p["last"], p["shape"]) for p in names.p] == [("Novak", "surname_initials"), ("Kral", "initials_surname"), ("Maly", "surname_name")]
    assert names.n is None and names.e == []


def test_bibtex_is_spread_and_not_grouped(spark):
    assert bib(Tables(spark, SF)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert not [q for q in ("bib_map", "bib_grammar") if "Aggregate" in plan(QUERIES[q](spark, SF))]


def test_bibtex_wide(spark):
    texts = ["@book{a, title = {X}, title = {Y {Z}}, year = 1999}\n@misc{b, note = {n}}\n@misc{c}", "@book{a, title = {open", None, "@misc(d, url = {u--v}, pages = \"3\")"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    rows = sorted(tuple(r) for r in B.wide(df, "k", "t", ("title", "year", "url")).collect())
    assert rows == [(0, 0, "a", "book", "Y Z", "1999", None), (0, 1, "b", "misc", None, None, None), (3, 0, "d", "misc", None, None, "u–v")]
    assert [(r.k, r.title, r.year, r.first_page) for r in B.publications(df, "k", "t").orderBy("k", "entry").collect()] == [(0, "Y Z", 1999, None), (0, None, None, None), (3, None, None, 3)]


@pytest.mark.parametrize("name", ["web_publist", "table_records"])
def test_rows_made_of_parts_are_spread(spark, name):
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_related_lookup_makes_pairs_where_it_counts(spark):
    rng = random.Random(5)
    bought = [(rng.randrange(40), rng.randrange(30)) for _ in range(400)] + [(99, i) for i in range(30)] + [(None, 1)]
    sold = [(f"e{rng.randrange(700)}", rng.randrange(29)) for _ in range(6000)] + [(f"e{i}", 29) for i in range(700)] + [("gone", i) for i in range(30)]
    probes = spark.createDataFrame([(p, f"name {p}") for p in [*range(40), 99]], "probe_id bigint, title string")
    entities = spark.createDataFrame([(f"e{i}", f"nome {i % 60}") for i in range(700)], "id string, title string")
    similar = {(p, e): round(r.s, 9) for p, e, r in ((r.probe_id, r.id, r) for r in probes.crossJoin(entities.withColumnRenamed("title", "et")).select("probe_id", "id", P.similarity(F.col("title"), F.col("et")).alias("s")).collect())}
    want = {}
    for p in {p for p, _ in bought if p is not None}:
        items = {i for q, i in bought if q == p}
        shared = Counter(e for e, i in set(sold) if i in items and e != "gone")
        if fit := [(-n, -similar[p, e], e) for e, n in shared.items() if n >= 3]:
            want[p] = (min(fit)[2], -min(fit)[0])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("7", before):  # a probe's lists in many batches, and many probes in one
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            df = P.lookup_related(spark.createDataFrame(bought, "probe_id bigint, item int"), spark.createDataFrame(sold, "id string, item int"), probes, entities, 3)
            assert {r.probe_id: (r.id, r.shared) for r in df.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "collect_list" in plan(df)


def test_link_ranks_read_a_link_once(spark):
    assert plan(QUERIES["crawl_rank"](spark, SF)).count("work ?packages?") == 1


@pytest.mark.parametrize("name", ["html_entities", "html_clean_tree"])
def test_page_batches_are_bounded(spark, name):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        QUERIES[name](spark, SF)
        long = spark.range(40, numPartitions=1).select(F.expr("repeat('x', 1000000)").alias("t"))
        rows = F.pandas_udf(lambda s: pd.Series([len(s)] * len(s)), "int")
        assert long.select(rows("t").alias("n")).agg(F.max("n")).first()[0] <= 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_few_known_words_are_sought_within_the_text(spark, monkeypatch):
    texts = ["the Graph of the x-ray", "", None, "a b", "Graph graph über", "unknown words only here", "the " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    words = spark.createDataFrame([("the",), ("graph",), ("graph",), ("Graph",), ("x-ray",), (None,)], "key string")
    run = lambda: (DI.text_search(df, "i", "t", words.distinct()), CL.conversion_credibility(df, "i", "t", F.lit(1), words.distinct()))
    few = run()
    assert not [x for x in few if "Join" in plan(x)]
    monkeypatch.setattr(DI, "MOST_KNOWN", 2)
    many = run()
    assert all("Join" in plan(x) for x in many)
    for a, b in zip(few, many):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert sorted(tuple(r) for r in few[0].collect())[:4] == [(0, 0, "the"), (0, 1, "Graph"), (0, 3, "the"), (0, 4, "x-ray")]


def test_link_ranks_of_odd_links(spark):
    base = "http://ex.org/"
    links = [("a", base, "JavaScript:x('results')", "Results", None), ("a", base, "http://www.ex.org/r#results\nx", "About", None), ("b", base, "http://other.org/results", "Results", None), ("c", base, "http://ex.org/D1.pdf#x", "Reports", "application/pdf"), ("c", base, "http://ex.org/x", None, "text/html"), ("c", None, "http://ex.org/results", "Results", None), ("d", base, None, "Results", None), ("e", base, "http://ex.org/" + "x" * 200, "Results", None), ("f", base, "mailto:results@ex.org", "Results", None), ("g", base, "http://ex.org/g", "Deliverable", None)]
    df = spark.createDataFrame(links, "page string, base string, url string, text string, mime string")
    assert sorted(tuple(r) for r in CR.level_rank(df).collect()) == [("a", 6, 0), ("c", 110, 1), ("g", 20, 0)]


def test_articles_are_spread(spark):
    assert QUERIES["art_extract"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_addresses_are_sought_where_they_may_be(spark):
    plain = spark.createDataFrame([("no address in here",), (None,), ("",)], "t string").select(E.emails(F.col("t")).alias("e"))
    assert [r.e for r in plain.collect()] == [[], None, []]
    # the pattern sees words with an at sign alone, and unmasking is asked for only where a sign of it is
    assert "array_join(filter(split" in plan(plain) and "CASE WHEN (((" in plan(plain)
    texts = [
        "a@b.cz", "x a@b.cz\nc@d.eu\te@f.org, a@b.cz", "j (AT) ex (dOt) org", "j[At]ex[dot]org and k &#64; ex.org", "k<IMG src=at.png>ex.org", "k AT-sign ex.org, k at-SIGN ex.org",
        "{a, b}@ex.org {c}@x.y d@x.y", "{a}@ {b,c}@ex.org", "a@b", "@b.cz a@@b.cz a@b.cz@d.eu", "xa@b.cz a@b.cz", "é@b.cz aé@b.cz", "(atom) [atlas] a&#64;b.cz t-s (dog)",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.e for r in df.select(E.emails(F.col("t")).alias("e")).collect()]
    for t, found in zip(texts, got, strict=True):
        x = re.sub(r"(?i) ?(?:\(at\)|\[at\]|&#64;|<img[^>]*>| at-sign ) ?", "@", t)
        x = re.sub(r"(?i) ?(?:\(dot\)|\[dot\]) ?", ".", x)
        group = r"\{[A-Za-z0-9._, -]+\}@[A-Za-z0-9.-]+"
        want = [n.strip(" ") + "@" + g.split("}@")[1] for g in re.findall(group, x) for n in re.split(" *, *", g[1 : g.index("}")])]
        want = list(dict.fromkeys(want + re.findall(E.EMAIL, re.sub(group, " ", x))))
        assert found == [m for m in want if not any(o != m and m in o for o in want)], t


def test_title_is_sought_in_the_opening(spark):
    long = "y " * S.OPENING
    texts = [None, "", "One two three", "Abstract of it\nOne two three\nx", "a b\n" * 3000 + "\n  One two three \n", "One two three " + long, long + "\nOne two three", "x" * (S.OPENING - 3) + "\nOne two three", "a\n" * (S.OPENING // 2) + "One two three"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(S.article_title(F.col("t")).alias("x"))
    assert [r.x for r in df.collect()] == [None, None, "One two three", "One two three", "One two three", ("One two three " + long).strip(" "), long.strip(" "), "One two three", "One two three"]
    assert "substring" in plan(df)


def test_tokens_are_matched(spark):
    texts = [None, "", " ", "The 2nd Ärger, the-end!", "ŽÍŽALA İstanbul 12×3 ÷ KK 𝒳y", "a\nb\tc\x00d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(tokens(F.col("t")).alias("w"))
    # a negated class of several ranges made threads wait for each other
    assert "[^" not in plan(df)
    want = [None if t is None else [w for w in re.split("[^a-z0-9à-öø-ÿ]+", t.lower()) if w] for t in texts]
    assert [r.w for r in df.collect()] == want
