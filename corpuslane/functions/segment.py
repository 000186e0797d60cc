"""Segmentation of articles: head, chapters, references, citations, and the citation parser."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import extract as E

HEADINGS = ("introduction", "related work", "background", "methods", "methodology", "experiments", "evaluation", "results", "discussion", "conclusion", "conclusions", "acknowledgements", "appendix")
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
#: What is shorter or longer is no citation.
LEAST_CITATION, MOST_CITATION = 40, 1000
#: Published accuracy of each extractor; the citation parser runs them from the best to the worst.
ACCURACY = {"to_appear": 0.99, "volume": 0.94, "pages": 0.93, "organization": 0.9, "isbn": 0.89, "event": 0.82, "url": 0.8, "date": 0.77, "publisher": 0.752, "title": 0.73, "telephone": 0.71, "authors": 0.69, "issn": 0.67}


def head(text: Column) -> Column:
    """Through the abstract, else up to the introduction, else up to the first blank line."""
    a = E.first_match(text, r"(?is)^(.*?\babstract\b.*?)\n[ \t]*\n", 1)
    b = E.first_match(text, r"(?is)^(.*?)\n[ \t]*(?:1\.?[ \t]*)?introduction\b", 1)
    c = E.first_match(text, r"(?s)^(.*?)\n[ \t]*\n", 1)
    return F.coalesce(b, a, c, text)


def roman(c: Column) -> Column:
    """A Roman numeral's value; null for what is none."""
    letters = F.split(F.upper(c), "")
    value = lambda x: reduce(lambda e, r: F.when(x == r, ROMAN[r]).otherwise(e), ROMAN, F.lit(0))
    vals = F.transform(F.filter(letters, lambda x: x != ""), value)
    # a smaller value before a larger one counts against it
    total = F.aggregate(F.reverse(vals), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top")), lambda a, v: F.struct((a["sum"] + F.when(v < a["top"], -v).otherwise(v)).alias("sum"), F.greatest(a["top"], v).alias("top")), lambda a: a["sum"])
    return F.when(F.upper(c).rlike("^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (c != ""), total)


_CHAPTER = r"(?m)^[ \t]*((?:[0-9]+(?:\.[0-9]+)*\.?)|(?:[IVXL]+\.))[ \t]+([A-Z][^\n]{2,80})$"

_ALONE = r"(?im)^[ \t]*(?:" + "|".join(HEADINGS) + r")[ \t]*$"


def chapters(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, name, start, style, text): numbered headings with what follows up to the next one, else usual names."""
    c = F.col(text)
    numbered = F.regexp_extract_all(c, F.lit(_CHAPTER), F.lit(0))
    alone = F.regexp_extract_all(c, F.lit(_ALONE), F.lit(0))
    use = F.when(F.size(numbered) > 1, F.transform(numbered, lambda h: F.struct(F.lit("numbered").alias("style"), h.alias("h")))).otherwise(F.transform(alone, lambda h: F.struct(F.lit("alone").alias("style"), h.alias("h"))))
    # what stands between headings of the style in use gives their places
    gaps = F.split(c, F.when(F.size(numbered) > 1, F.lit(_CHAPTER)).otherwise(F.lit(_ALONE)), F.lit(-1))
    placed = rows.select(key, use.alias("u"), gaps.alias("g"))
    parts = F.arrays_zip(F.col("u").alias("u"), F.slice("g", 1, F.size("u")).alias("before"), F.slice("g", 2, F.size("u")).alias("text"))
    each = placed.filter(F.size("u") > 0).select(key, F.posexplode(parts).alias("pos", "p"))
    # a document's headings alone meet here
    before = F.sum(F.length("p.before") + F.length("p.u.h")).over(Window.partitionBy(key).orderBy("pos")) - F.length("p.u.h")
    full = each.select(key, F.struct(F.col("p.u.style").alias("style"), F.col("p.u.h").alias("h"), before.cast("int").alias("start"), F.col("p.text").alias("text")).alias("s"))
    number = F.regexp_extract(F.trim("s.h"), r"^([0-9]+(?:\.[0-9]+)*|[IVXL]+)", 1)
    name = F.when(F.col("s.style") == "numbered", F.regexp_extract(F.trim("s.h"), r"^[0-9IVXL.]+[ \t]+(.*)$", 1)).otherwise(F.trim("s.h"))
    return full.select(key, F.when(F.col("s.style") == "numbered", F.coalesce(roman(number).cast("string"), number)).alias("number"), name.alias("name"), F.col("s.start").alias("start"), F.col("s.style").alias("style"), F.btrim(F.col("s.text"), F.lit(" \t\r\n")).alias("text"))


def bibliography(text: Column) -> Column:
    """The last block headed References or Bibliography, up to an appendix or the end."""
    return E.first_match(text, r"(?is)^.*\n[ \t]*(?:[0-9]+\.?[ \t]*)?(?:references|bibliography)[ \t]*\n(.*?)(?:\n[ \t]*appendix\b.*)?$", 1)


def citations(rows: DataFrame, key: str, block: str) -> DataFrame:
    """(key, ord, marker, content, credibility): a reference block cut by the style of its first 50 characters."""
    c = F.trim(F.col(block))
    opening = F.substring(c, 1, 50)
    style = F.when(opening.rlike(r"^\[[^\]]{1,12}\]"), "[x]").when(opening.rlike(r"^\([0-9]+\)"), "(n)").when(opening.rlike(r"^[0-9]+\]"), "n]").when(opening.rlike(r"^[0-9]+\."), "n.").otherwise("line")
    cut = {"[x]": r"(?m)(?=^[ \t]*\[[^\]\n]{1,12}\])", "(n)": r"(?m)(?=^[ \t]*\([0-9]+\))", "n]": r"(?m)(?=^[ \t]*[0-9]+\])", "n.": r"(?m)(?=^[ \t]*[0-9]+\.[ \t])", "line": "\n"}
    mark = r"^(\[[^\]]{1,12}\]|\([0-9]+\)|[0-9]+\]|[0-9]+\.)?"
    cred = {"[x]": 80, "(n)": 80, "n]": 70, "n.": 70, "line": 60}
    pick = lambda d, f: reduce(lambda e, k: F.when(F.col("style") == k, f(d[k])).otherwise(e), d, F.lit(None))
    styled = rows.select(key, c.alias("c"), style.alias("style"))
    parts = styled.select(key, pick(cred, F.lit).alias("credibility"), F.posexplode(F.filter(F.transform(pick(cut, lambda p: F.split("c", p)), lambda p: F.trim(F.regexp_replace(p, "[ \t\n]+", " "))), lambda p: F.length(p).between(LEAST_CITATION, MOST_CITATION))).alias("ord", "p"))
    return parts.select(key, "ord", E.first_match(F.col("p"), mark, 1).alias("marker"), F.trim(F.regexp_replace("p", mark, "")).alias("content"), F.col("credibility").cast("int").alias("credibility"))


def reference_sentences(bodies: DataFrame, refs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, marker, sentence): sentences of body that hold a marker of the document's references."""
    sentences = bodies.select(key, F.explode(F.split(F.regexp_replace(body, "[ \t\n]+", " "), r"(?<=[.!?]) (?=[A-Z\[])")).alias("sentence"))
    marks = sentences.withColumn("marker", F.explode(F.regexp_extract_all("sentence", F.lit(r"(\[[^\]]{1,12}\])"), F.lit(1))))
    return marks.join(refs.select(key, "marker").distinct(), [key, "marker"], "left_semi").select(key, "marker", "sentence").distinct()


def cita_clear(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^[ \t.,;:\-\[\]()0-9]+", ""), r"[ \t,;:\-]+$", "")


def abstract(c: Column) -> Column:
    return E.first_match(c, r"(?is)\babstract\b[ \t.:—-]*\n?(.*?)(?:\n[ \t]*\n|\n[ \t]*(?:key ?words|1\.?[ \t]*introduction)|$)", 1)


def keywords(c: Column) -> Column:
    block = E.first_match(c, r"(?is)\bkey ?words\b[ \t.:—-]*(.*?)(?:\n[ \t]*\n|$)", 1)
    return F.filter(F.transform(F.split(F.coalesce(block, F.lit("")), "[,;·]"), lambda w: F.trim(F.regexp_replace(w, "[ \t\n.]+", " "))), lambda w: w != "")


#: Characters within which the title of most texts stands; where it doesn't, the whole text is searched.
OPENING = 2000


def article_title(c: Column) -> Column:
    """The first line of several words that looks like no author, address or heading line."""
    bad = r"(?i)^(abstract|keywords?|introduction|contents|page|proceedings|copyright|department|university|http|[0-9. ]+)\b|@|^[A-Z]\. ?[A-Z]"
    first = lambda text: F.try_element_at(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (F.size(F.split(x, " ")) > 2) & ~x.rlike(bad)), F.lit(1))
    # the last line of the opening may be cut, so the lines before it count
    opening = F.substring(c, 1, OPENING)
    lines = F.when(F.contains(opening, F.lit("\n")), F.substring(opening, F.lit(1), F.length(opening) - F.length(F.substring_index(opening, "\n", -1)) - 1))
    return F.coalesce(first(lines), first(c))


def assign_emails(rows: DataFrame, key: str, names: str, mails: str) -> DataFrame:
    """(key, mail, name): for each address the person with most name parts (initials by half) in its local part."""
    each = rows.select(key, F.explode(mails).alias("mail"), names).select(key, "mail", F.explode(names).alias("name"))
    local = F.lower(F.split_part("mail", F.lit("@"), F.lit(1)))
    parts = F.split(F.lower("name"), "[ .,]+")
    score = F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.when((F.length(p) > 1) & F.contains(local, p), 1.0).when((p != "") & local.startswith(F.substring(p, 1, 1)), 0.5).otherwise(0.0))
    return each.withColumn("s", score).groupBy(key, "mail").agg(F.min(F.struct((-F.col("s")).alias("s"), "name")).alias("b")).select(key, "mail", F.when(F.col("b.s") < 0, F.col("b.name")).alias("name"))


def parse_citation(rows: DataFrame, text: str) -> DataFrame:
    """rows with the parts of a citation; extractors run by falling accuracy, each on what the ones before left.

    Adds title, authors, year, month, publisher, event, organization, pages, volume, isbn, issn, url, to_appear, type,
    credibility and rest.
    """
    c = F.col("rest")
    df = rows.withColumn("rest", F.col(text))
    gone = lambda p: F.regexp_replace("rest", p, " ")
    df = df.withColumn("to_appear", E.to_appear(c)).withColumn("rest", gone(r"(?i)\(?to appear\)?"))
    df = df.withColumn("volume", E.volume(c)).withColumn("rest", gone(E.VOLUME))
    df = df.withColumn("pages", E.pages(c)).withColumn("rest", gone(E.PAGES))
    df = df.withColumn("organization", E.first_match(c, E.ORGANIZATION, 1)).withColumn("isbn", E.isbn(c)).withColumn("rest", gone(E.ISBN))
    df = df.withColumn("event", E.first_match(c, E.EVENT, 1)).withColumn("rest", gone(E.EVENT))
    df = df.withColumn("url", E.urls(c)).withColumn("rest", gone(E.URL))
    df = df.withColumn("date", F.array_max(E.dates(c)))
    df = df.withColumn("year", F.col("date.year")).withColumn("month", F.col("date.month")).drop("date")
    undated = reduce(lambda e, kind: F.regexp_replace(e, kind[1], " "), E.DATE_KINDS, c)
    df = df.withColumn("rest", F.when(c.rlike(E.ANY_YEAR), undated).otherwise(c))
    df = df.withColumn("publisher", E.publisher(c)).withColumn("rest", gone(r"(?i)publish(?:ed by|er):? [A-Za-z][A-Za-z &-]*[A-Za-z]"))
    df = df.withColumn("title", E.title(c)).withColumn("rest", F.when(F.col("title").isNotNull(), F.replace("rest", "title", F.lit(" "))).otherwise(c))
    df = df.withColumn("authors", F.filter(E.persons(c), lambda p: p["shape"].isin("surname_initials", "initials_surname")))
    df = df.withColumn("issn", E.issns(c))
    return df.withColumn("type", citation_type()).withColumn("credibility", citation_credibility(F.col(text)))


def citation_type() -> Column:
    """BibTeX type by priority of what was found."""
    return F.when(F.col("event").isNotNull(), "inproceedings").when(F.col("volume").isNotNull() & F.col("pages").isNotNull(), "article").when(F.col("isbn").isNotNull(), "book").when(F.col("organization").isNotNull() & F.col("year").isNotNull(), "techreport").when(F.col("to_appear"), "unpublished").otherwise("misc")


def citation_credibility(text: Column) -> Column:
    """70, with credit for what was found and debit for what was left; 0 without a title."""
    bonus = F.when(F.size("authors") > 0, 10).otherwise(-15) + F.when(F.col("year").isNotNull(), 10).otherwise(-10) + F.when(F.col("publisher").isNotNull() | F.col("event").isNotNull(), 5).otherwise(0)
    left = (F.pow(F.lit(2.0), F.length("rest") / F.greatest(F.length(text), F.lit(1))) - 1) * 20
    return F.when(F.col("title").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.round(70 + bonus - left, 0).cast("int"))))
