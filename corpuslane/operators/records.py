"""Records of a page: titles and links chosen from texts, and publication records from headers and citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import clean

MARK = r"(?i)(deliverable|\bD ?[0-9]+(\.[0-9]+)*\b)"
UNWANTED = r"(?i)^(download|pdf|here|link|click here|view|more|doc|file|full text|\[?[0-9]+\]?)$"
#: Header words of a publication page and the property that each stands for.
PROPERTIES = {"author": "authors", "authors": "authors", "writers": "authors", "title": "title", "name": "title", "abstract": "abstract", "summary": "abstract", "keywords": "keywords", "key words": "keywords", "year": "year", "date": "year", "published": "year", "publisher": "publisher", "pages": "pages", "volume": "volume", "isbn": "isbn", "issn": "issn", "doi": "doi", "journal": "parent", "proceedings": "parent", "conference": "event", "editor": "editors", "editors": "editors", "language": "language", "url": "url", "link": "url"}
PUBLICATION_TYPES = (("journal", "article"), ("conference", "inproceedings"), ("proceedings", "inproceedings"), ("book chapter", "incollection"), ("chapter", "incollection"), ("book", "book"), ("phd", "phdthesis"), ("master", "mastersthesis"), ("technical report", "techreport"), ("report", "techreport"), ("manual", "manual"))

#: Parts of a page that aren't text, and tags that don't end one.
NO_TEXT = (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->", r"(?i)</?p\b[^>]*>")
#: How an abstract begins that may be short, and how a long text does that is none.
ABSTRACT_STARTS = ("In this p", "The paper", "This book", "This paper", "This publica", "We present")
NO_ABSTRACT = ("CiteU", "CiteS", "Microso", "Was ", "I ha", "I was", "I pre")


def from_text(texts: Column, links: Column) -> Column:
    """struct<title, description, link>: title is the first text with a mark, description the longest; null without a mark."""
    title = F.try_element_at(F.filter(texts, lambda t: t.rlike(MARK)), F.lit(1))
    longest = F.array_max(F.transform(texts, lambda t: F.length(t)))
    about = F.try_element_at(F.filter(texts, lambda t: F.length(t) == longest), F.lit(1))
    return F.when(title.isNotNull(), F.struct(title.alias("title"), about.alias("description"), F.try_element_at(links, F.lit(1)).alias("link")))


def title_ok(title: Column) -> Column:
    return title.isNotNull() & (F.length(F.trim(title)) > 2) & ~F.trim(title).rlike(UNWANTED)


def from_link(texts: Column, links: Column, pattern: str = MARK) -> Column:
    """struct<title, description, link>: the first link that matches, with the first fair text of over 10 characters."""
    link = F.try_element_at(F.filter(links, lambda x: x.rlike(pattern)), F.lit(1))
    title = F.try_element_at(F.filter(texts, lambda t: (F.length(t) > 10) & title_ok(t)), F.lit(1))
    return F.when(link.isNotNull(), F.struct(title.alias("title"), F.lit(None).cast("string").alias("description"), link.alias("link")))


def choose(records: DataFrame, page: str, by_text: str, by_link: str, manual: str) -> DataFrame:
    """Records of one kind a page: by text if over 3, else by link if over 3, else the manual ones."""
    n = records.groupBy(page).agg(F.count(by_text).alias("nt"), F.count(by_link).alias("nl"))
    kind = F.when(F.col("nt") > 3, "text").when(F.col("nl") > 3, "link").otherwise("manual")
    picked = F.when(F.col("kind") == "text", F.col(by_text)).when(F.col("kind") == "link", F.col(by_link)).otherwise(F.col(manual))
    return records.join(n.select(page, kind.alias("kind")), page).select(page, "kind", picked.alias("r")).filter("r is not null").select(page, "kind", "r.*")


def section(texts: DataFrame, key: str, order: str, text: str, is_header: str, word: str = "deliverable") -> DataFrame:
    """Texts between a header that holds word and the next header that doesn't."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    inside = F.last(F.when(F.col(is_header), F.lower(F.col(text)).contains(word)), ignorenulls=True).over(w)
    return texts.withColumn("__in", inside).filter(F.col("__in") & ~F.col(is_header)).drop("__in")


def generalize(header: Column) -> Column:
    """The canonical property of a free header text; null for an unknown one."""
    clean = F.trim(F.regexp_replace(F.lower(header), "[^a-z ]", ""))
    return reduce(lambda e, p: F.when(clean == p[0], p[1]).otherwise(e), PROPERTIES.items(), F.lit(None).cast("string"))


def publication_type(header: Column) -> Column:
    low = F.lower(header)
    return reduce(lambda e, p: F.when(low.contains(p[0]), p[1]).otherwise(e), reversed(PUBLICATION_TYPES), F.lit(None).cast("string"))


def title_score(text: Column, initial: int, known: list[str]) -> Column:
    """initial less 65 x the share of words that aren't capitalised or known, 20 more if all are, 15 less for a bracket left open."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    bad = F.size(F.filter(words, lambda w: ~(w.rlike("^[A-Z0-9]") | F.lower(w).isin(known)))) / F.greatest(F.size(words), F.lit(1))
    open_ = F.regexp_count(text, F.lit(r"\(")) != F.regexp_count(text, F.lit(r"\)"))
    score = F.lit(initial) - 65 * bad + F.when(bad == 0, 20).otherwise(0) - F.when(open_, 15).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(score, 0).cast("int")))


def visibility_headers(nodes: DataFrame, key: str = "page_id", start: float = 4.0, step: float = 0.5, least: float = 2.0) -> DataFrame:
    """(key, node_id, text, header): nodes over the first of start, start - step .. least that any node of the page reaches."""
    shown = nodes.filter("text <> '' and tag not in ('script', 'style', 'title')")
    top = shown.groupBy(key).agg(F.max("visibility").alias("top"))
    level = F.when(F.col("top") >= start, F.lit(start)).otherwise(F.lit(start) - F.ceil((F.lit(start) - F.col("top")) / step) * step)
    levels = top.select(key, level.alias("header")).filter(F.col("header") >= least)
    return shown.join(levels, key).filter(F.col("visibility") >= F.col("header")).select(key, "node_id", "text", "header")


def split_proceedings(text: Column) -> Column:
    """Articles of a proceedings: the parts that begin with a line before each abstract."""
    parts = F.split(text, r"(?i)\n(?=[^\n]{10,150}\n(?:[^\n]*\n){0,4}?[ \t]*abstract\b)")
    return F.filter(parts, lambda p: p.rlike(r"(?i)\babstract\b"))


def page_abstract(html: Column) -> Column:
    """The longest text of a page that has over 200 characters or begins like an abstract; null without one."""
    body = reduce(lambda c, p: F.regexp_replace(c, p, " "), NO_TEXT, html)
    starts = lambda x, words: reduce(lambda a, b: a | b, [x.startswith(w) for w in words])
    texts = F.transform(F.regexp_extract_all(body, F.lit(">([^<>]+)<"), F.lit(1)), clean)
    fair = F.filter(texts, lambda x: ((F.length(x) > 200) & ~starts(x, NO_ABSTRACT)) | starts(x, ABSTRACT_STARTS))
    return F.array_max(F.transform(fair, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]


def topic(header: Column) -> Column:
    """A header that names no kind of publication is a topic."""
    return F.when(publication_type(header).isNull(), header)


def first_found(texts: Column, extract) -> Column:
    """What extract finds in the first of the texts where it finds anything: for properties without a header."""
    return F.try_element_at(F.filter(F.transform(texts, extract), lambda x: x.isNotNull()), F.lit(1))
