"""Goldens of the text functions."""

import random
import string

import pytest
from pyspark.sql import functions as F

from corpuslane.functions import text as T


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.r for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_hash24(spark):
    rng = random.Random(0)
    words = ["".join(rng.choice(string.ascii_letters) for _ in range(12)) for _ in range(20)]
    got = one(spark, T.hash24, *words, words[0], "nuclear")
    assert got[20] == got[0] and len(set(got[:20])) == 20 and max(got) <= 0xFFFFFF
    assert got[21] == 4047235


@pytest.mark.parametrize(
    "given,want",
    [
        (r"A text         with \nencoded white \n\r\tspaces.", "A text with encoded white spaces."),
        (r"A text    <b>     with \nmarked <img src=' ' />white \n\r\tspaces</b>.", "A text with marked white spaces."),
        (r"A text    <b>     with \nhy-     phens in white \n\r\two-   rds</b>.", "A text with hyphens in white words."),
        (r"tools, by:\n&#149;\tNaming a common", "tools, by: Naming a common"),
        (r"given tasks. &lt;br/&gt;Another sort", "given tasks. Another sort"),
        ("leaders . . . . . 12", "leaders 12"),
        (None, None),
    ],
)
def test_norm_text(spark, given, want):
    assert one(spark, T.norm_text, given) == [want]


def test_normalisers(spark):
    assert one(spark, T.norm_publication, "Žluťoučký (and so on) Kůň: 2nd!  Part") == ["zlutoucky kun 2nd part"]
    assert one(spark, T.norm_organization, "The Univerzita of Brno, Inc & Dept") == ["university brno and department"]
    assert one(spark, T.norm_event, "Proc. of the 12th Annual Workshop on Graphs '07") == ["Workshop on Graphs 2007"]
    assert one(spark, T.norm_project, "IST-1999-20710 And project MEMORIES 2004 study") == ["memories study 2004"]
    assert one(spark, T.norm_location, "FRANKFURT AM MAIN", "x", "usti nad labem") == ["Frankfurt am Main", None, "Usti nad Labem"]
    assert one(spark, T.clean_text, "ﬁne “quotes” – it’s \x07ok") == ['fine "quotes" - it\'s ok']
