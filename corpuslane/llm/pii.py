"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Four base patterns and opaque values of `key = value` give the seeds. The words around them induce lexical patterns. A
pattern counts if its words stand beside identifiers in most places where they occur at all (which no stop word does)
and if its values are seeds or accepted rather than known negatives (too short, too few digits); unseen values neither
help nor harm it. Values of patterns that count are accepted, until nothing is added; they get spans of kind `id`.

Positions come from pairing the pieces of split() with the matches of regexp_extract_all(), running sums from blocks of
blocks, so the work is linear in a text's length and in its number of matches; every regular expression advances
linearly as well (possessive quantifiers, starts only at the edge of a run). The neighbours of a word are sought in all
of the text between it and the next word with a digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, looked_up, materialize

KINDS = ("email", "ip", "card", "phone", "id")
#: Distinct accepted values of a pattern at least; their share of accepted and negative ones; identifiers among the
#: places where a pattern's word occurs.
LEAST_SEEDS, CONFIDENT, LEAST_RATE = 3, 0.6, 0.5
#: The key of a value after a colon, as a colon follows ordinary words too; any key may stand before an equals sign.
SECRET = r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|credential)[^a-z]*"
#: An identifier found by context has at least so many characters and digits.
LEAST_LENGTH, LEAST_DIGITS = 8, 3
#: Elements that a running sum adds one by one; code points of the pieces that a text is masked in.
STEP, PIECE = 64, 512

_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_SPACE = r"\x20\x09-\x0D"
CANDIDATE = rf"(?<![^{_SPACE}])[^{_SPACE}0-9]*+[0-9][^{_SPACE}]*+"


def _let(value: Column, use) -> Column:
    """use(value), which is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, plus, levels: int = 2) -> Column:
    """array<int> of what plus makes of 0 and all values before each.

    An array grows by copying, so it grows by STEP elements only: blocks of values are worked out apart from what stands
    before each, which is a shorter running sum.
    """

    def short(part: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        add = lambda acc, v: F.struct(plus(acc["at"], v).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(part, zero, add, lambda acc: acc["out"])

    if not levels:
        return short(values, F.lit(0))
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / STEP).cast("int")), lambda i: F.slice(v, i * STEP + 1, STEP))
    total = lambda block: F.aggregate(block, F.lit(0), plus)
    return _let(values, lambda v: _let(cut(v), lambda blocks: F.flatten(F.zip_with(blocks, running(F.transform(blocks, total), plus, levels - 1), short))))


def _add(a: Column, b: Column) -> Column:
    return (a + b).cast("int")


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b).cast("int")


def _placed(text: Column, pattern: str, item) -> Column:
    """item(match, start, gap before, gap after) of each leftmost non-overlapping match, start in code points."""

    def places(gaps: Column, found: Column) -> Column:
        steps = F.transform(found, lambda m, i: (F.length(F.get(gaps, i)) + F.length(m)).cast("int"))
        return _let(running(steps, _add), lambda ends: F.transform(found, lambda m, i: item(m, F.get(ends, i) + F.length(F.get(gaps, i)), F.get(gaps, i), F.get(gaps, i + 1))))

    return _let(F.split(text, pattern, -1), lambda gaps: _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: places(gaps, found)))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, m>> of the leftmost non-overlapping matches, in code points."""
    return _placed(text, pattern, lambda m, start, before, after: F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("m")))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    return F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def _valid_ip(m: Column) -> Column:
    plain = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(m, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.substring(plain(p), 1, 3).cast("int") <= 255))


def _spans(text: Column, kind: int, pattern: str, maybe: Column, holds) -> Column:
    """array<struct<start, kind, end>> of the matches that hold; texts that can't match cost one look."""
    found = matches(text, pattern)
    if holds is not None:
        found = F.filter(found, lambda x: holds(x["m"]))
    spans = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    return F.when(maybe, spans).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """All base spans as array<struct<start, kind (index in KINDS), end>> by start, then kind."""
    parts = [
        _spans(text, 0, EMAIL, text.contains("@"), None),
        _spans(text, 1, IP, text.rlike(r"[0-9]\.[0-9]"), _valid_ip),
        _spans(text, 2, CARD, text.rlike(r"[0-9][\x20-]?[0-9]"), _luhn),
        _spans(text, 3, PHONE, text.contains("+"), lambda m: F.length(_digits(m)).between(9, 15)),
    ]
    return F.array_sort(F.concat(*parts))


_SPANS = "array<struct<start:int,kind:int,end:int>>"
_CANDIDATES = "array<struct<start:int,end:int,value:string,left:string,left2:string,right:string>>"


def candidates(text: Column) -> Column:
    """array<struct<start, end, value, left, left2, right>> of identifier-like words with their neighbours.

    Neighbours are words without a digit, as far away as the next word with one.
    """
    none = lambda c: F.nullif(c, F.lit(""))

    def item(m: Column, at: Column, before: Column, after: Column) -> Column:
        # what stands before = or : in the word is its left neighbour
        head = F.regexp_extract(m, r"^([^=:]++[=:]++[^A-Za-z0-9+]*+)[^=:]++$", 1)
        lead = F.greatest(F.length(F.regexp_extract(m, r"^([^A-Za-z0-9+]*+)", 1)), F.length(head))
        core = F.regexp_replace(F.substring(m, lead + 1, F.length(m)), r"[^A-Za-z0-9]++$", "")
        # from its end backwards, so that a long gap isn't searched
        back, two = F.reverse(F.lower(before)), rf"^[{_SPACE}]*+([^{_SPACE}]++)(?:[{_SPACE}]++([^{_SPACE}]++))?+"
        word = lambda n: none(F.reverse(F.regexp_extract(back, two, n)))
        left = F.when(head != "", F.lower(F.regexp_replace(head, "[^=:A-Za-z_-]", ""))).otherwise(word(1))
        right = none(F.lower(F.regexp_extract(after, rf"^[{_SPACE}]*+([^{_SPACE}]++)", 1)))
        return F.struct((at + lead).alias("start"), (at + lead + F.length(core)).alias("end"), core.alias("value"), left.alias("left"), word(2).alias("left2"), right.alias("right"))

    return F.when(text.rlike("[0-9]"), _placed(text, CANDIDATE, item)).otherwise(F.array().cast(_CANDIDATES))


def beside(base: Column, found: Column) -> Column:
    """array<struct<seed, covered>> of the candidates: whether one overlaps a base span, whether it lies within one."""

    def furthest(order: int, place: str) -> Column:
        """Of each candidate the furthest end of the base spans that start before its `place`, or there if order is 1."""
        spans = F.transform(base, lambda b: F.struct(b["start"].alias("pos"), F.lit(1 - order).alias("t"), b["end"].alias("v")))
        places = F.transform(found, lambda c: F.struct(c[place].alias("pos"), F.lit(order).alias("t"), F.lit(0).alias("v")))
        ends = lambda events: F.zip_with(events, running(F.transform(events, lambda e: e["v"]), _larger), lambda e, m: F.when(e["t"] == order, m))
        return F.array_compact(_let(F.array_sort(F.concat(spans, places)), ends))

    seeds = lambda a, b: F.transform(found, lambda c, i: F.struct((F.get(a, i) > c["start"]).alias("seed"), (F.get(b, i) >= c["end"]).alias("covered")))
    some = _let(furthest(0, "end"), lambda a: _let(furthest(1, "start"), lambda b: seeds(a, b)))
    none = F.transform(found, lambda c: F.struct(F.lit(False).alias("seed"), F.lit(False).alias("covered")))
    return F.when((F.size(base) > 0) & (F.size(found) > 0), some).otherwise(none)


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _keyed() -> Column:
    """Whether an occurrence is an opaque value (letters and digits) of a key."""
    left, left2 = F.coalesce("left", F.lit("")), F.coalesce("left2", F.lit(""))
    equals = left.rlike("[a-z0-9_][^a-z0-9=:]*=+[^a-z0-9=:]*$") | (left.rlike("^=+$") & left2.rlike("[a-z]"))
    colon = left.rlike(rf"{SECRET}:[^a-z0-9=:]*$") | (left.rlike("^:$") & left2.rlike(rf"{SECRET}$"))
    return (equals | colon) & F.col("value").rlike("[A-Za-z]") & ~F.col("value").contains("@")


def discover(occurrences: DataFrame, words: DataFrame) -> DataFrame:
    """(key, start, end) of unseen identifiers among occurrences (key, copies, start, end, value, left, left2, right, seed, covered).

    seed: overlaps a base span; covered: lies within one.

    words (word, n): how often each word occurs in all texts, whose number of copies is `copies`.
    """
    of = lambda name, a, b=None: F.struct(F.concat_ws(" ", F.lit(name), *([b] if b else []), a).alias("pattern"), F.col(a).alias("a"), (F.col(b) if b else F.lit(None).cast("string")).alias("b"))
    patterns = F.array_compact(F.array(F.when(F.col("left").isNotNull(), of("L", "left")), F.when(F.col("left").isNotNull() & F.col("left2").isNotNull(), of("B", "left", "left2")), F.when(F.col("right").isNotNull(), of("R", "right"))))
    shaped = (F.length("value") >= LEAST_LENGTH) & (F.length(_digits(F.col("value"))) >= LEAST_DIGITS)
    named = occurrences.withColumn("patterns", patterns).withColumn("shaped", shaped).withColumn("keyed", _keyed() & F.col("shaped") & ~F.col("covered")).withColumn("v", F.xxhash64("value"))
    named = materialize(named.drop("left", "left2", "right", "value"))
    each = named.select(F.explode("patterns").alias("p"), "v", "copies", "shaped", (F.col("seed") | F.col("shaped")).alias("like")).select("p.*", "v", "copies", "shaped", "like")
    # values of a hot pattern are summed up before they meet
    each = materialize(each.groupBy("pattern", "v").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.bool_or("shaped").alias("shaped"), F.bool_or("like").alias("like"), F.sum(F.when(F.col("like"), F.col("copies")).otherwise(0)).alias("near")))
    near = each.groupBy("pattern").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.sum("near").alias("near"), F.count_if("like").alias("values"), F.count("*").alias("n")).filter(F.col("values") >= LEAST_SEEDS)
    near = materialize(near)
    # a pair of words occurs at most as often as the rarer of them; what is no word by itself has no other places
    of_word = lambda c: words.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    near = looked_up(near.withColumnRenamed("n", "edges"), "a", of_word("a"), F.xxhash64("pattern"))
    near = looked_up(materialize(near), "b", of_word("b"), F.xxhash64("pattern"))
    distinctive = materialize(near.filter(F.col("near") >= LEAST_RATE * F.coalesce(F.least("n_a", "n_b"), "near")).select("pattern", F.col("edges").alias("n")))
    edges = materialize(join_counted(each, distinctive, "pattern", each.count(), F.xxhash64("v")).select("pattern", "v", "shaped"))
    seeds = named.filter(F.col("seed") | F.col("keyed")).select("v").distinct().withColumn("seeded", F.lit(True))
    edges = materialize(looked_up(edges, "v", seeds, F.xxhash64("pattern")).withColumn("seeded", F.coalesce("seeded", F.lit(False))))
    fixed = materialize(edges.groupBy("pattern").agg(F.count_if("seeded").alias("yes"), F.count_if(~F.col("seeded") & ~F.col("shaped")).alias("no"), F.count_if(~F.col("seeded") & F.col("shaped")).alias("n")))
    # values that a pattern may add, with the patterns of each
    unseen = materialize(edges.filter(~F.col("seeded") & F.col("shaped")).select("pattern", "v"))
    places, all_unseen = materialize(unseen.groupBy("v").agg(F.count("*").alias("n"))), unseen.count()
    scored, before = fixed, 0
    while True:
        good = materialize(scored.filter((F.col("yes") >= LEAST_SEEDS) & (F.col("yes") >= CONFIDENT * (F.col("yes") + F.col("no")))).select("pattern", "n"))
        # accepted values are only ever added, so patterns are as well
        if (now := good.count()) == before:
            break
        before = now
        accepted = join_counted(unseen, good, "pattern", all_unseen, F.xxhash64("v")).select("v").distinct().join(places, "v")
        more = join_counted(unseen, materialize(accepted), "v", all_unseen, F.xxhash64("pattern")).groupBy("pattern").agg(F.count("*").alias("more"))
        scored = fixed.join(more, "pattern", "left").select("pattern", (F.col("yes") + F.coalesce("more", F.lit(0))).alias("yes"), "no", "n")
    open_rows = materialize(named.filter(~F.col("seed") & F.col("shaped")).select("key", "start", "end", F.explode("patterns.pattern").alias("pattern")))
    counts = open_rows.groupBy("pattern").agg(F.count("*").alias("n")).join(good.select("pattern"), "pattern")
    by_pattern = join_counted(open_rows, counts, "pattern", open_rows.count(), F.xxhash64("key", "start"))
    # digits within a secret may pass for a card: the whole of it counts
    return named.filter("keyed").select("key", "start", "end").unionByName(by_pattern.select("key", "start", "end")).distinct()


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (array of spans), spans (base and added ones) of every row.

    A null text counts as empty. Equal texts get equal spans, repeated rows repeated results; other columns don't
    matter.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("t"))
    narrow = narrow.select("doc_id", F.md5(F.col("t").cast("binary")).alias("key"), base_spans(F.col("t")).alias("base"), candidates(F.col("t")).alias("found"))
    words = docs.select(F.explode(F.split(F.lower(text), rf"[{_SPACE}]+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return _with_added(materialize(narrow), words)


def _with_added(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Adds `spans` to rows (doc_id, key, base, found)."""
    # most texts hold no candidate
    some = rows.filter(F.size("found") > 0)
    texts = materialize(some.groupBy("key").agg(F.first("base").alias("base"), F.first("found").alias("found"), F.count("*").alias("copies")))
    flagged = texts.select("key", "copies", F.explode(F.arrays_zip("found", beside(F.col("base"), F.col("found")).alias("beside"))).alias("c"))
    added = discover(flagged.select("key", "copies", "c.found.*", "c.beside.*"), words).groupBy("key").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end")).alias("added"))
    # a text may have many copies
    right = texts.select("key", F.col("copies").alias("n")).join(added, "key")
    joined = join_counted(rows.drop("found"), right, "key", rows.count(), F.xxhash64("doc_id"), "left")
    return joined.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_SPANS))))).drop("added")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id of every row (see find)."""
    rows = find(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("bigint").alias("n_id"),
    )


def masked(text: Column, spans: Column) -> Column:
    """text with each span (overlapping ones together) replaced by the name of its kind in angle brackets."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def cut(pieces: Column, a: Column, b: Column) -> Column:
        """Code points a to b of the text that the pieces make up."""
        first = F.floor(a / PIECE).cast("int")
        some = F.slice(pieces, first + 1, F.floor((b - 1) / PIECE).cast("int") - first + 1)
        return F.when(b > a, F.substring(F.array_join(some, ""), a - first * PIECE + 1, b - a)).otherwise(F.lit(""))

    def out(pieces: Column, before: Column) -> Column:
        part = lambda s, i: F.when(s["start"] >= F.get(before, i), F.concat(cut(pieces, F.get(before, i), s["start"]), F.element_at(names, s["kind"] + 1))).otherwise(F.lit(""))
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(F.transform(spans, part), ""), cut(pieces, end, F.length(text)))

    furthest = running(F.transform(spans, lambda s: s["end"]), _larger)
    done = _let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda pieces: _let(furthest, lambda before: out(pieces, before)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def without_personal_data(docs: DataFrame) -> DataFrame:
    """docs with every span masked in text (and n_chars, where there is such a column, made to fit).

    All rows and columns stay: null and empty texts, and texts without personal data, as they are; repeated rows stay
    repeated, an empty table empty. Columns of any name may stand beside text.
    """
    found = find(docs).filter(F.size("spans") > 0).groupBy(F.col("key").alias("__key")).agg(F.first("spans").alias("__spans"), F.count("*").alias("__n"))
    keyed = docs.withColumn("__key", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    # spans grow with docs: one join strategy at every size; a text may have many copies
    joined = join_counted(keyed, materialize(found).hint("merge"), "__key", docs.count(), F.xxhash64("doc_id"), "left", "__n")
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col("__spans")))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
