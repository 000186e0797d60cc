"""Entity extraction from text as column expressions; patterns stay in the subset that Java and RE2 share."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import white_space

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"\b(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}\b"
URL = r"(?:https?|ftp)://[A-Za-z0-9.:/?#@!$&'()*+,;=%~_-]+"
ISBN = r"ISBN:? ?([0-9]+-[0-9]+-[0-9]+-[0-9X])"
ISSN = r"[0-9]{4}-[0-9]{3}[0-9X]"
PHONE = r"\+[0-9][0-9 ().-]{6,18}[0-9]"
PAGES = r"(?:pp?\.|pages) ?([0-9]+)(?: ?- ?([0-9]+))?"
VOLUME = r"(?i)(?:vol\.|volume|num\.|number) ?([0-9]+)"
STREET = r"([0-9]+ [A-Z][A-Za-z ]*? (?:Street|Avenue|Road|Broadway|Way))"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DIAL = {"420": "Czech Republic", "421": "Slovakia", "44": "United Kingdom", "49": "Germany", "33": "France", "1": "United States", "48": "Poland", "43": "Austria"}
EVENT_TYPES = ("conference", "workshop", "symposium", "congress", "seminar", "meeting", "summer school", "colloquium", "forum", "course")
ORG_KINDS = (("universit", "university"), ("institut", "institute"), ("department", "department"), ("faculty", "faculty"), ("school", "school"), ("college", "college"), ("laborator", "laboratory"), ("center", "center"), ("centre", "center"), ("academy", "academy"), ("agency", "agency"), ("council", "council"), ("society", "society"), ("association", "association"), ("consortium", "consortium"), ("corporation", "corporation"), ("office", "office"), ("bureau", "bureau"), ("group", "group"))
ORG_PARENTS = {"department": ("faculty", "school", "university", "college", "institute"), "faculty": ("university",), "laboratory": ("department", "faculty", "university", "institute"), "school": ("university",), "institute": ("university", "academy"), "center": ("university", "institute"), "group": ("department", "university")}
BAD_TITLE = r"(?i)^(?:in|vol|volume|pages?|pp|no|editor|eds?|proceedings|http|isbn|issn)\b"


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def once(value: Column, body) -> Column:
    """body(value), with value worked out once however often body names it; lambdas would work it out for each element."""
    return F.transform(F.array(value), body)[0]


#: One of these, in any case, is in every text that unmask_email changes; plain searches for them cost little.
MASKED_AT, MASKED_DOT = ("(at", "[at", "&#64;", "<im", "t-s"), ("(do", "[do")


def _has_any(c: Column, parts: tuple[str, ...]) -> Column:
    """Whether c has one of parts, whatever the case of their ASCII letters."""
    cases = [p for part in parts for p in map("".join, product(*[sorted({x.lower(), x.upper()}) for x in part]))]
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in cases])


def unmask_email(c: Column) -> Column:
    """Spelled-out at and dot signs, and their entities, as characters."""
    at = lambda x: F.when(_has_any(x, MASKED_AT), F.regexp_replace(x, r"(?i) ?(?:\(at\)|\[at\]|&#64;|<img[^>]*>| at-sign ) ?", "@")).otherwise(x)
    dot = lambda x: F.when(_has_any(x, MASKED_DOT), F.regexp_replace(x, r"(?i) ?(?:\(dot\)|\[dot\]) ?", ".")).otherwise(x)
    return once(at(c), dot)


def emails(c: Column) -> Column:
    """All addresses of a text, `{a,b}@host` as one each; an address inside another one is dropped."""
    # no address has a blank in it, and the pattern is slow on words without an at sign
    plain = lambda x: all_matches(F.array_join(F.filter(F.split(x, " "), lambda w: F.contains(w, F.lit("@"))), " "), EMAIL)

    def find(x: Column) -> Column:
        groups = all_matches(x, r"\{[A-Za-z0-9._, -]+\}@[A-Za-z0-9.-]+")
        grouped = F.flatten(F.transform(groups, lambda g: F.transform(F.split(F.regexp_extract(g, r"\{([^}]*)\}", 1), " *, *"), lambda n: F.concat(F.trim(n), F.regexp_extract(g, r"(@[A-Za-z0-9.-]+)", 1)))))
        some = F.contains(x, F.lit("}@"))
        rest = F.when(some, F.regexp_replace(x, r"\{[A-Za-z0-9._, -]+\}@[A-Za-z0-9.-]+", " ")).otherwise(x)
        return F.array_distinct(F.concat(F.when(some, grouped).otherwise(F.array().cast("array<string>")), plain(rest)))

    return once(once(unmask_email(c), find), lambda found: F.filter(found, lambda m: ~F.exists(found, lambda o: (o != m) & F.contains(o, m))))


def urls(c: Column) -> Column:
    return F.transform(all_matches(c, URL), lambda u: F.regexp_replace(u, "[.,]+$", ""))


def issns(c: Column) -> Column:
    """ISSNs whose weighted digit sum is a multiple of 11."""
    def good(m: Column) -> Column:
        d = F.replace(m, F.lit("-"), F.lit(""))
        digit = lambda i: F.when(F.substring(d, i, 1) == "X", 10).otherwise(F.ascii(F.substring(d, i, 1)) - 48)
        return reduce(lambda a, b: a + b, [digit(i) * (9 - i) for i in range(1, 9)]) % 11 == 0

    return F.filter(all_matches(c, ISSN), good)


def isbn(c: Column) -> Column:
    return first_match(c, ISBN, 1)


def pages(c: Column) -> Column:
    """Difference of the first page range, or the page where there is no second number."""
    a, b = first_match(c, PAGES, 1), first_match(c, PAGES, 2)
    return F.when(b.isNull(), a.cast("bigint")).otherwise(F.abs(b.cast("bigint") - a.cast("bigint")))


def volume(c: Column) -> Column:
    return first_match(c, VOLUME, 1).cast("int")


def phones(c: Column) -> Column:
    """array<struct<number, country>>: dots as blanks; the country of the longest dial prefix."""
    def country(n: Column) -> Column:
        digits = F.regexp_replace(n, "[^0-9]", "")
        return reduce(lambda e, p: F.when(digits.startswith(p[0]), p[1]).otherwise(e), sorted(DIAL.items(), key=lambda p: len(p[0])), F.lit(None).cast("string"))

    return F.transform(all_matches(c, PHONE), lambda m: F.struct(F.replace(m, F.lit("."), F.lit(" ")).alias("number"), country(m).alias("country")))


def to_appear(c: Column) -> Column:
    return c.rlike(r"(?i)\(?to appear\)?")


def submitted(c: Column) -> Column:
    return c.rlike(r"(?i)submitted (to|for)")


def chunks(c: Column) -> Column:
    """The text cut at full stops or commas, whichever is commoner."""
    dots, commas = F.regexp_count(c, F.lit(r"\.")), F.regexp_count(c, F.lit(","))
    parts = F.when(dots >= commas, F.split(c, r"\.")).otherwise(F.split(c, ","))
    return F.transform(parts, lambda p: F.trim(p))


def title(c: Column) -> Column:
    """The longest chunk of 19 to 203 characters that has few digits and a fair start (first of equals)."""
    fit = F.filter(chunks(c), lambda p: F.length(p).between(19, 203) & (F.regexp_count(p, F.lit("[0-9]")) * 4 < F.length(p)) & ~p.rlike(BAD_TITLE))
    first_of = lambda fit, longest: F.try_element_at(F.filter(fit, lambda p: F.length(p) == longest), F.lit(1))
    return once(fit, lambda fit: once(F.array_max(F.transform(fit, lambda p: F.length(p))), lambda longest: first_of(fit, longest)))


def booktitle(c: Column) -> Column:
    return F.try_element_at(F.filter(chunks(c), lambda p: p.rlike("(?i)journal|book")), F.lit(1))


def publisher(c: Column) -> Column:
    named = first_match(c, r"(?i)publish(?:ed by|er):? ([A-Za-z][A-Za-z &-]*[A-Za-z])", 1)
    return F.coalesce(named, first_match(c, r"([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)* Press)\b", 1))


def month_number(c: Column) -> Column:
    return once(F.lower(c), lambda low: reduce(lambda e, m: F.when(low.isin(MONTHS[m], MONTHS[m][:3]), m + 1).otherwise(e), range(12), F.lit(None).cast("int")))


def day_number(c: Column) -> Column:
    return first_match(c, r"(?i)^([0-9]{1,2})(?:st|nd|rd|th)?$", 1).cast("int")


_MONTH = "(January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
#: (kind, pattern, groups of year, month, day), applied in order; what a kind matches is taken out of the text for the next.
DATE_KINDS = [
    ("dmy", r"\b([0-9]{1,2})(?:st|nd|rd|th)? " + _MONTH + r",? ((?:19|20)[0-9]{2})\b", 3, 2, 1),
    ("ymd", r"\b((?:19|20)[0-9]{2})[-/]([0-9]{1,2})[-/]([0-9]{1,2})\b", 1, 2, 3),
    ("mdy", r"\b" + _MONTH + r" ([0-9]{1,2})(?:st|nd|rd|th)?,? ((?:19|20)[0-9]{2})\b", 3, 1, 2),
    ("my", r"\b" + _MONTH + r",? ((?:19|20)[0-9]{2})\b", 2, 1, 0),
    ("y", r"\b((?:19|20)[0-9]{2})\b", 1, 0, 0),
]
#: Every kind has a year of this shape; where there is none, no kind need be tried.
ANY_YEAR = r"(?:19|20)[0-9]{2}\b"


def dates(c: Column) -> Column:
    """array<struct<year, month, day>> with nulls for what isn't said; days over 31 and months over 12 are dropped."""
    found = _each_of_rest(c, [(p, _date_of(p, y, m, d)) for _, p, y, m, d in DATE_KINDS], " ", ANY_YEAR)
    return F.filter(found, lambda s: (F.coalesce(s["month"], F.lit(1)) <= 12) & (F.coalesce(s["day"], F.lit(1)) <= 31))


def _each_of_rest(rest: Column, kinds: list, gap: str, need: str) -> Column:
    """What each (pattern, make) makes of its matches; they are taken out of the text for the next.

    need: what every match has; a text, or what is left of it, without that is not searched again.
    """
    (p, make), *later = kinds

    def both(matches: Column) -> Column:
        made = F.transform(matches, make)
        if not later:
            return made
        left = F.when(F.size(matches) > 0, F.regexp_replace(rest, p, gap)).otherwise(rest)
        return once(left, lambda r: F.concat(made, _each_of_rest(r, later, gap, need)))

    return F.when(rest.rlike(need), once(all_matches(rest, p), both)).when(rest.isNotNull(), F.transform(F.array().cast("array<string>"), make))


def _date_of(p: str, y: int, m: int, d: int):
    none = F.lit(None).cast("int")

    def make(x: Column) -> Column:
        month = none
        if m:
            month = once(F.regexp_extract(x, p, m), lambda raw: F.coalesce(month_number(raw), first_match(raw, "^([0-9]+)$", 1).cast("int")))
        return F.struct(F.regexp_extract(x, p, y).cast("int").alias("year"), month.alias("month"), (F.regexp_extract(x, p, d).cast("int") if d else none).alias("day"))

    return make


TIME = r"\b([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))? ?([AaPp][Mm])?\b"


def times(c: Column) -> Column:
    """array<struct<hour, minute, second>> of 24-hour and AM/PM times; impossible ones are dropped."""
    def make(x: Column) -> Column:
        h, half = F.regexp_extract(x, TIME, 1).cast("int"), F.lower(F.regexp_extract(x, TIME, 4))
        hour = F.when(half == "pm", h % 12 + 12).when(half == "am", h % 12).otherwise(h)
        return F.struct(hour.alias("hour"), F.regexp_extract(x, TIME, 2).cast("int").alias("minute"), F.coalesce(first_match(x, TIME, 3).cast("int"), F.lit(0)).alias("second"))

    return F.filter(F.transform(all_matches(c, TIME), make), lambda s: (s["hour"] < 24) & (s["minute"] < 60) & (s["second"] < 60))


STAMP = r"\b((?:19|20)[0-9]{2})-([0-9]{2})-([0-9]{2})[ T]([0-9]{2}):([0-9]{2}):([0-9]{2})"


def datetimes(c: Column) -> Column:
    """Timestamps written as yyyy-mm-dd hh:mm:ss; a zone is passed over."""
    return F.filter(F.transform(all_matches(c, STAMP), lambda x: F.try_to_timestamp(F.replace(x, F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss"))), lambda t: t.isNotNull())


def street(c: Column) -> Column:
    return first_match(c, STREET, 1)


PERSON_SHAPES = [
    ("surname_initials", r"\b([A-Z][a-z]+), ((?:[A-Z]\. ?)+)", 1, 2, 80),
    ("name_initial_surname", r"\b([A-Z][a-z]+) [A-Z]\. ([A-Z][a-z]+)\b", 2, 1, 75),
    ("initials_surname", r"\b((?:[A-Z]\. ?)+)([A-Z][a-z]+)\b", 2, 1, 80),
    ("surname_name", r"\b([A-Z][a-z]+), ([A-Z][a-z]+)\b", 1, 2, 60),
    ("name_surname", r"\b([A-Z][a-z]+) ([A-Z][a-z]+)\b", 2, 1, 50),
]


def persons(c: Column) -> Column:
    """array<struct<last, first, shape, credibility>>: each shape takes its matches out of the text for the next."""
    return _each_of_rest(c, [(shape[1], _person_of(*shape)) for shape in PERSON_SHAPES], " ; ", "[A-Z][a-z]")


def _person_of(name: str, p: str, last: int, first: int, cred: int):
    return lambda x: F.struct(F.regexp_extract(x, p, last).alias("last"), F.trim(F.regexp_extract(x, p, first)).alias("first"), F.lit(name).alias("shape"), F.lit(cred).alias("credibility"))


def full_name(first: Column, middle: Column, last: Column) -> Column:
    return F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(middle, F.lit("")), F.nullif(last, F.lit("")))


EVENT = r"((?:[0-9]+(?:st|nd|rd|th) )?(?:Annual |International |European |World )*(?:Conference|Workshop|Symposium|Congress|Seminar) (?:on|of|for) [A-Z][A-Za-z-]*(?: (?:and |of |in |for )?[A-Z][A-Za-z-]*)*)"


def events(c: Column) -> Column:
    """array<struct<title, acronym, type, credibility>>: 80 with an ordinal, 70 without."""
    def make(x: Column) -> Column:
        return F.struct(x.alias("title"), event_type(x).alias("type"), F.when(x.rlike("^[0-9]"), 80).otherwise(70).alias("credibility"))

    return F.transform(all_matches(c, EVENT, 1), make)


def event_type(c: Column) -> Column:
    return once(F.lower(c), lambda low: reduce(lambda e, w: F.when(low.contains(w), w).otherwise(e), reversed(EVENT_TYPES), F.lit(None).cast("string")))


def organization_type(c: Column) -> Column:
    return once(F.lower(c), lambda low: reduce(lambda e, k: F.when(low.contains(k[0]), k[1]).otherwise(e), reversed(ORG_KINDS), F.lit(None).cast("string")))


ORGANIZATION = r"((?:[A-Z][A-Za-z]+ )*(?:University|Institute|Department|Faculty|School|College|Laboratory|Center|Centre|Academy|Agency|Council|Society|Association|Consortium|Corporation)(?: (?:of|for) [A-Z][A-Za-z]+(?: (?:and )?[A-Z][A-Za-z]+)*)?)"


def organizations(c: Column) -> Column:
    """array<struct<title, type, parent, credibility>>: the parent is the next organisation of a type that may hold it."""
    found = F.transform(all_matches(c, ORGANIZATION, 1), lambda x: F.struct(x.alias("title"), organization_type(x).alias("type")))
    may_hold = lambda child, t: reduce(lambda e, k: F.when(child == k, t.isin(*ORG_PARENTS[k])).otherwise(e), ORG_PARENTS, F.lit(False))
    parent = lambda found, o, i: F.try_element_at(F.filter(F.slice(found, i + 2, F.size(found)), lambda p: may_hold(o["type"], p["type"])), F.lit(1))["title"]
    full = lambda found: F.transform(found, lambda o, i: F.struct(o["title"].alias("title"), o["type"].alias("type"), F.when(F.size(found) > i + 1, parent(found, o, i)).alias("parent"), organization_score(o["title"]).alias("credibility")))
    return once(found, full)


def organization_score(c: Column) -> Column:
    """Mean over the words: 100 for an acronym or a keyword, 50 for another capitalised one, -50 in lower case."""
    every = F.filter(F.split(c, " "), lambda w: w != "")
    value = lambda w: F.when(w.rlike("^[A-Z]{2,}$") | organization_type(w).isNotNull(), 100).when(w.rlike("^[A-Z]"), 50).when(w.isin("of", "for", "and", "the"), 25).otherwise(-50)
    return once(every, lambda words: F.when(F.size(words) > 0, F.round(F.aggregate(words, F.lit(0), lambda a, w: a + value(w)) / F.size(words)).cast("int")))


PROJECT = r"(?:[Tt]he ([A-Z][A-Za-z0-9-]+) project|[Pp]roject ([A-Z][A-Z0-9-]+)\b|\"([^\"]{3,80})\" project)"


def projects(c: Column) -> Column:
    """array<struct<name, credibility>>: quoted names 30, `the X project` 50, acronyms 10; the best of a name stays."""
    def make(x: Column) -> Column:
        a, b, q = (F.regexp_extract(x, PROJECT, i) for i in (1, 2, 3))
        return F.struct(F.when(a != "", a).when(b != "", b).otherwise(q).alias("name"), F.when(a != "", 50).when(b != "", 10).otherwise(30).alias("credibility"))

    found = F.transform(all_matches(c, PROJECT), make)
    return F.filter(found, lambda s, i: ~F.exists(F.transform(found, lambda o, j: F.struct(o["name"].alias("n"), o["credibility"].alias("c"), j.alias("j"))), lambda o: (o["n"] == s["name"]) & ((o["c"] > s["credibility"]) | ((o["c"] == s["credibility"]) & (o["j"] < i)))))


def locations(rows: DataFrame, key: str, text: str, cities: DataFrame) -> DataFrame:
    """(key, city, country, credibility): cities (city, country) in text; 61, +15 with their country, -37 with only others."""
    words = F.array_distinct(F.filter(F.split(F.col(text), "[^A-Za-z0-9_]+"), lambda w: w != ""))
    each = rows.select(key, F.col(text).alias("__t"), F.explode(words).alias("city")).join(cities, "city")
    own = F.col("__t").contains(F.col("country"))
    other = F.col("__t").rlike("(?i)country of ") & ~own
    return each.select(key, "city", "country", (F.lit(61) + F.when(own, 15).when(other, -37).otherwise(0)).alias("credibility"))


def address(text: Column, postcode: str) -> Column:
    """What stands before a city's post code, else the street."""
    before = F.nullif(white_space(F.substring_index(text, postcode, 1)), F.lit(""))
    return F.when(text.contains(postcode), before).otherwise(street(text))


def fax(c: Column) -> Column:
    """The first telephone number after the word fax."""
    return F.try_element_at(phones(F.regexp_extract(c, r"(?i)fax:? *([^a-z]*)", 1)), F.lit(1))["number"]


#: Extractors by bit, as a mask selects them.
REGISTRY = {1: ("email", emails), 2: ("url", urls), 4: ("isbn", isbn), 8: ("issn", issns), 16: ("pages", pages), 32: ("volume", volume), 64: ("publisher", publisher), 128: ("title", title), 256: ("booktitle", booktitle), 512: ("event", events), 1024: ("organization", organizations), 2048: ("person", persons), 4096: ("project", projects), 8192: ("date", dates), 16384: ("time", times), 32768: ("telephone", phones), 65536: ("to_appear", to_appear), 131072: ("submitted", submitted), 262144: ("street", street), 524288: ("datetime", datetimes)}


def extract(rows: DataFrame, text: str, mask: int) -> DataFrame:
    """rows with a column for each extractor whose bit mask has."""
    return rows.withColumns({name: f(F.col(text)) for bit, (name, f) in REGISTRY.items() if mask & bit})
