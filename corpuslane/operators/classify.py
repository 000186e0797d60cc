"""Language, document-type and conversion-quality classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .dictionary import few_keys

MODEL_WORDS, TYPE_WINDOW, PAGE_WORDS = 20, 5000, 80
#: Words of a model up to which they are sought within a text; more of them are found by the join alone.
MOST_KNOWN = 10_000
#: Keyword patterns of document types with their weights.
TYPE_WEIGHTS = {
    "manual": [("user guide", 30), ("manual", 20), ("installation", 15), ("troubleshooting", 20)],
    "thesis": [("thesis", 40), ("supervisor", 15), ("dissertation", 40), ("faculty", 10)],
    "report": [("technical report", 50), ("report", 20), ("deliverable", 25), ("work package", 25)],
    "article": [("abstract", 30), ("keywords", 20), ("introduction", 15), ("references", 20)],
    "unpublished": [("draft", 30), ("submitted to", 30), ("preprint", 40)],
    "license": [("licensed under", 50), ("license", 25), ("all rights reserved", 20)],
}


def train(rows: DataFrame, lang: str, text: str, size: int = MODEL_WORDS) -> DataFrame:
    """(lang, term, p): the words of each language whose frequency is among its `size` largest, ties kept."""
    counts = rows.select(lang, F.explode(tokens(F.col(text))).alias("term")).groupBy(lang, "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy(lang)
    ranked = counts.withColumns({"total": F.sum("n").over(w), "r": F.rank().over(w.orderBy(F.desc("n")))})
    return ranked.filter(F.col("r") <= size).select(F.col(lang).alias("lang"), "term", (F.col("n") / F.col("total")).alias("p"))


def scores(rows: DataFrame, key: str, text: str, model: DataFrame) -> DataFrame:
    """(key, lang, score, share): the summed probability of the words, for every language that knows one of them.

    Words are counted by row before the join; a model has a few words a language.
    """
    # a model has some MODEL_WORDS words a language: it is worked out once, other words go before the texts are taken apart
    few = model.select("lang", "term", "p").limit(MOST_KNOWN + 1).collect()
    words = tokens(F.col(text))
    if len(few) <= MOST_KNOWN:
        model = rows.sparkSession.createDataFrame(few, model.select("lang", "term", "p").schema)
        words = F.filter(words, lambda w: w.isin(sorted({r["term"] for r in few})))
    counts = rows.select(key, F.explode(words).alias("term")).join(model.select("term").distinct(), "term", "left_semi").groupBy(key, "term").agg(F.count("*").alias("n"))
    found = counts.join(model, "term").groupBy(key, "lang").agg(F.sum(F.col("n") * F.col("p")).alias("score"))
    return found.withColumn("share", F.col("score") / F.sum("score").over(Window.partitionBy(key)))


def identify(rows: DataFrame, key: str, text: str, model: DataFrame) -> DataFrame:
    """(key, lang, share): the best language (ties: the first by name); null and 0 where no word is known."""
    found = scores(rows, key, text, model)
    best = found.groupBy(key).agg(F.max_by(F.struct("lang", "share"), F.struct(F.round("score", 9), F.col("lang"))).alias("b"))
    return rows.select(key).join(best, key, "left").select(key, F.col("b.lang").alias("lang"), F.coalesce("b.share", F.lit(0.0)).alias("share"))


def sample_word(text: Column, seed: int = 0) -> Column:
    """A random word of a text, null without words."""
    words = tokens(text)
    return F.try_element_at(words, (F.floor(F.rand(seed) * F.size(words)) + 1).cast("int"))


def document_type(text: Column, producer: Column | None = None, pages: Column | None = None) -> Column:
    """The type with the largest sum of weights among the keyword patterns in the opening part up to the references.

    A presentation producer or a single page decides at once; without any keyword it is misc; an article within 20
    points of unpublished is unpublished.
    """
    head = F.lower(F.substring(text, 1, TYPE_WINDOW))
    sums = {t: sum((F.when(head.contains(p), F.lit(w)).otherwise(F.lit(0)) for p, w in ws), F.lit(0)) for t, ws in TYPE_WEIGHTS.items()}
    best = F.greatest(*sums.values())
    out = F.lit("misc")
    for t in reversed(list(sums)):
        out = F.when(sums[t] == best, t).otherwise(out)
    out = F.when(best == 0, "misc").when((sums["article"] == best) & (sums["unpublished"] > 0) & (best - sums["unpublished"] <= 20), "unpublished").otherwise(out)
    if pages is not None:
        out = F.when(pages == 1, "poster").otherwise(out)
    if producer is not None:
        out = F.when(F.lower(producer).contains("powerpoint"), "presentation").otherwise(out)
    return out


def conversion_credibility(rows: DataFrame, key: str, text: str, pages: Column, known: DataFrame) -> DataFrame:
    """(key, credibility): int(ok / (ok + bad) x min(1, ok / pages / 80) x 100) over words of 3 letters or more.

    ok words are keys of known (key); a text without such words has credibility 0.
    """
    words = F.filter(tokens(F.col(text)), lambda w: F.length(w) >= 3)
    cut = rows.select(key, pages.alias("pages"), words.alias("w"))
    value = F.floor(F.round(F.col("ok") / F.col("total") * F.least(F.lit(1.0), F.col("ok") / F.col("pages") / PAGE_WORDS) * 100, 9)).cast("int")
    out = lambda joined: joined.select(key, F.when(F.col("total") > 0, value).otherwise(F.lit(0)).alias("credibility"))
    if (few := few_keys(known)) is not None:
        ok = F.size(F.filter("w", lambda w: w.isin(few))) if few else F.lit(0)
        return out(cut.select(key, "pages", F.size("w").alias("total"), ok.cast("bigint").alias("ok")))
    each = cut.select(key, F.explode("w").alias("key_")).groupBy(key, "key_").agg(F.count("*").alias("n"))
    ok = each.join(known.select(F.col("key").alias("key_")), "key_", "left_semi").groupBy(key).agg(F.sum("n").alias("ok"))
    joined = cut.select(key, "pages", F.size("w").alias("total")).join(ok, key, "left").withColumn("ok", F.coalesce("ok", F.lit(0)))
    return out(joined)
