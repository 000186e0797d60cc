"""Personal data and near-duplicates against brute force, and the pipeline."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from corpuslane.llm import near_dedup, pii

from .conftest import EDGE, LONG

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (name, p) in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if name == "card" and not (12 <= len(d) <= 19 and luhn(d)):
                continue
            if name == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return [(PATTERNS[k][0], a, z) for a, k, z in sorted(out)]


def written(spans):
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def test_base_spans_match_brute_force(spark):
    rng = random.Random(1)
    alphabet = [*"a1@.+-_% 9()é😀\n", "4222222222222", "a@b.c", "1.2.3.4", "+1 (212) 555-1234", "300.1.1.1", "4532-0151-1283-0366"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += ["1" * 20000, "a" * 60000 + "@", "@".join(["a.b"] * 1000), "4222222222222 " * 100, "1.1" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.s for r in df.select("i", pii._written(pii.base_spans(F.col("text"))).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == written(plain_spans(t)), repr(t[:200])


def secrets(n=300):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = []
    for i in range(n):
        seed = [f"user{i}@mail.example.com", f"10.{i % 250}.3.{i % 99}", f"+1 (212) 555-{1000 + i}"][i % 3]
        text = f"{rng.choice(words)} {rng.choice(words)} contact {seed} today {rng.choice(words)} version 2.0 of it"
        if i % 10 == 0:
            text += f" contact QX{i:04d}77ZZ19 today"
        rows.append((i, text, "a"))
    return rows


def test_context_finds_unseen_identifiers(make):
    rows = secrets()
    out = {r.doc_id: r for r in pii.personal_data(make(rows)).collect()}
    for i, text, _ in rows:
        r = out[i]
        assert r.base_sha256 == hashlib.sha256(written(plain_spans(text)).encode()).hexdigest()
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(plain_spans(text))
        found = [s.split(":") for s in r.spans.split(",")]
        extra = [text[int(a) : int(z)] for k, a, z in found if k == "id"]
        assert extra == ([f"QX{i:04d}77ZZ19"] if i % 10 == 0 else [])


def test_context_finds_secrets_and_no_stop_words(make):
    rng, rows, want = random.Random(3), [], {}
    secret = lambda: hashlib.blake2b(rng.randbytes(9), digest_size=20).hexdigest()
    for i in range(60):
        words = ["the", "a", "of", "and"] * 8
        rng.shuffle(words)
        words.insert(9, f"user{i}@mail.example.com")  # seeds stand beside stop words
        words.insert(20, f"20{i:02d}112233")  # as do numbers that identify no one
        if i % 6 == 0:
            want[i] = [secret()]
            words.insert(15, [f'token = "{want[i][0]}"', f"password={want[i][0]}", f"secret: {want[i][0]}"][i // 6 % 3])
        rows.append((i, " ".join(words), "a"))
    rows.append((99, "width = 2.0 time: 20250101T101010 the end", "a"))
    out = {r.doc_id: r for r in pii.personal_data(make(rows)).collect()}
    for i, text, _ in rows:
        found = [s.split(":") for s in out[i].spans.split(",") if s]
        assert [text[int(a) : int(z)] for k, a, z in found if k == "id"] == want.get(i, []), text


def plain_candidates(text):
    """(start, end, value, left, left2, right) of the words with a digit, by plain Python."""
    out, words = [], [(m.start(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    digit = [bool(re.search("[0-9]", w)) for _, w in words]
    for k, (at, w) in enumerate(words):
        if not digit[k]:
            continue
        before, after = [], []
        for j in range(k - 1, -1, -1):
            if digit[j]:
                break
            before.append(words[j][1].lower())
        for j in range(k + 1, len(words)):
            if digit[j]:
                break
            after.append(words[j][1].lower())
        m = re.match(r"([^=:]++[=:]++[^A-Za-z0-9+]*+)[^=:]++$", w)
        head = m[1] if m else ""
        lead = max(len(re.match("[^A-Za-z0-9+]*", w)[0]), len(head))
        core = re.sub(r"[^A-Za-z0-9]+$", "", w[lead:])
        left = re.sub("[^=:A-Za-z_-]", "", head).lower() if head else before[0] if before else None
        out.append((at + lead, at + lead + len(core), core, left, before[1] if len(before) > 1 else None, after[0] if after else None))
    return out


def plain_added(texts):
    """Spans that context adds to each text: the same rules over dictionaries."""
    words, count, found = {}, {}, {}
    for t in texts:
        count[t] = count.get(t, 0) + 1
        for w in re.split(r"[\x20\x09-\x0D]+", t.lower()):
            words[w] = words.get(w, 0) + 1
    edges, near = {}, {}
    for t in count:
        base = [(a, z) for _, a, z in plain_spans(t)]
        for a, z, v, left, left2, right in plain_candidates(t):
            seed, covered = any(x < z and a < y for x, y in base), any(x <= a and z <= y for x, y in base)
            shaped = len(v) >= 8 and len(re.sub("[^0-9]", "", v)) >= 3
            one, two = left or "", left2 or ""
            equals = re.search("[a-z0-9_][^a-z0-9=:]*=+[^a-z0-9=:]*$", one) or re.search("^=+$", one) and re.search("[a-z]", two)
            colon = re.search(rf"{pii.SECRET}:[^a-z0-9=:]*$", one) or one == ":" and re.search(rf"{pii.SECRET}$", two)
            keyed = bool((equals or colon) and re.search("[A-Za-z]", v) and "@" not in v and shaped and not covered)
            patterns = [("L", left)] * (left is not None) + [("B", left2, left)] * (left is not None and left2 is not None) + [("R", right)] * (right is not None)
            found.setdefault(t, []).append((a, z, v, patterns, seed, shaped, keyed))
            for p in patterns:
                edges.setdefault(p, {})[v] = shaped
                if seed or shaped:
                    n, like = near.setdefault(p, [0, set()])
                    near[p][0] = n + count[t]
                    like.add(v)
    few = {p for p, (n, like) in near.items() if len(like) >= pii.LEAST_SEEDS and n >= pii.LEAST_RATE * min([words[w] for w in p[1:] if w in words], default=n)}
    accepted, good = {v for x in found.values() for _, _, v, _, seed, _, keyed in x if seed or keyed}, set()
    while True:
        yes = {p: sum(v in accepted for v in edges[p]) for p in few}
        no = {p: sum(v not in accepted and not shaped for v, shaped in edges[p].items()) for p in few}
        now = {p for p in few if yes[p] >= pii.LEAST_SEEDS and yes[p] >= pii.CONFIDENT * (yes[p] + no[p])}
        if len(now) == len(good):
            break
        good = now
        accepted |= {v for p in good for v, shaped in edges[p].items() if shaped}
    return {t: sorted({(a, z) for a, z, _, patterns, seed, shaped, keyed in x if keyed or shaped and not seed and good & set(patterns)}) for t, x in found.items()}


def test_context_matches_brute_force(make):
    rng, rows = random.Random(11), []
    words = ["card", "no", "the", "of", "id", "ref", "see", "ticket", "="]
    values = [lambda: f"user{rng.randrange(99)}@ex.org", lambda: f"AB{rng.randrange(10**6):06d}", lambda: f"{rng.randrange(10**9):09d}", lambda: str(rng.randrange(99)), lambda: f"10.0.{rng.randrange(99)}.{rng.randrange(300)}", lambda: f'key="x{rng.randrange(10**7)}"', lambda: f"token: z{rng.randrange(10**8)}"]
    for i in range(400):
        rows.append((i, " ".join(rng.choice(values)() if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 14))), "a"))
    rows += [(1000 + i, rows[i % 7][1], "a") for i in range(60)]  # copies
    want = plain_added([t for _, t, _ in rows])
    out = {r.doc_id: r for r in pii.personal_data(make(rows)).collect()}
    assert any(want.values()) and len(out) == len(rows)
    for i, text, _ in rows:
        spans = sorted([(a, k, z) for k, a, z in ((x[0], int(x[1]), int(x[2])) for x in (["id", *s] for s in want.get(text, [])))])
        base = [(a, [p[0] for p in PATTERNS].index(k), z) for k, a, z in plain_spans(text)]
        merged = sorted(base + [(a, 4, z) for a, _, z in spans])
        assert out[i].spans == written([(pii.KINDS[k], a, z) for a, k, z in merged]), text


def test_many_matches_in_one_text(spark):
    """The work is linear: copying arrays at each match would take minutes here."""
    text = "".join(f"w a{i}@b.cz 10.0.0.{i % 300} x{'y' * (i % 700 == 0) * 900} " for i in range(30000))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    df = df.select("text", pii.base_spans(F.col("text")).alias("s"), pii.candidates(F.col("text")).alias("c"))
    df = df.select(pii._written(F.col("s")).alias("w"), pii.masked(F.col("text"), F.col("s")).alias("m"), "c", pii.beside(F.col("s"), F.col("c")).alias("b"), "s")
    r = df.first()
    spans = plain_spans(text)
    assert r.w == written(spans)
    out, at = [], 0
    for k, a, z in spans:
        out += [text[at:a], f"<{k.upper()}>"] if a >= at else []
        at = max(at, z)
    assert r.m == "".join(out) + text[at:]
    assert [(c.start, c.end, c.value, c.left, c.left2, c.right) for c in r.c] == plain_candidates(text)
    assert len(r.b) == len(r.c) == 60000 and all(x.seed == any(a < c.end and c.start < z for _, a, z in spans[i : i + 1]) for i, (x, c) in enumerate(zip(r.b[:2], r.c)))


def test_pii_edges(edge, empty):
    out = pii.personal_data(edge).collect()
    assert sorted(r.doc_id or 0 for r in out) == sorted(i or 0 for i, _, _ in EDGE)
    assert all(r.spans == "" for r in out if r.doc_id in (2, 3, 4))
    assert pii.personal_data(empty).count() == 0
    assert pii.without_personal_data(empty).count() == 0


def test_masking(make):
    df = make([(1, "write a@b.cz or +1 (212) 555-1234!", "a"), (2, "clean text", "a"), (3, None, "b")])
    out = pii.without_personal_data(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "write <EMAIL> or <PHONE>!" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "clean text" and got[3].text is None and got[3].n_chars is None


def word_sets(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def plain_components(ids, sets, part=80):
    parent = {i: i for i in ids if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and ids[a] is not None and ids[b] is not None and 100 * len(x & y) >= part * len(x | y):
                lo, hi = sorted((find(ids[a]), find(ids[b])))
                parent[hi] = lo
    return {i: find(i) for i in parent}


def variants():
    """Groups of near copies around the threshold, chains, exact copies and unrelated texts."""
    rng, rows = random.Random(3), []
    vocabulary = [f"v{i}" for i in range(4000)]
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 40, 200]))]
        for c in range(rng.choice([1, 2, 14])):
            text = list(base)
            for _ in range(int(len(text) * rng.choice([0, 0, 0.02, 0.05, 0.08, 0.11]))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, " ".join(text).upper() if c % 5 == 4 else " ".join(text), "a"))
            if c and c % 3 == 0:
                base = text  # a chain away from the first
    return rows


def test_near_duplicates_match_brute_force(make):
    rows = variants()
    for k in (2, 5):
        sets = word_sets([t for _, t, _ in rows], k)
        want = plain_components([i for i, _, _ in rows], sets)
        out = near_dedup.near_duplicates(make(rows), words=k).collect()
        assert len(out) == len(rows)
        size = {i: len(s) for (i, _, _), s in zip(rows, sets)}
        for r in out:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], size[r.doc_id], want[r.doc_id] == r.doc_id)


def test_rows_of_one_id_with_different_texts(make):
    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(5, one, "a"), (5, two, "b"), (3, one + " tail", "a"), (9, two, "c"), (9, two, "c"), (1, "all alone", "c"), (1, "all alone", "d")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(make(rows)).collect())
    assert got == [(1, 1, True), (1, 1, True), (3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False), (9, 5, False)]
    kept = sorted((r.doc_id, r.text) for r in near_dedup.deduplicated(make(rows)).collect())
    assert kept == [(1, "all alone"), (3, one + " tail"), (5, two)]


def test_strangers_in_a_hot_bucket(make, monkeypatch):
    """All rows meet in every bucket: a star of copies, a second group apart from its centres, and single strangers."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "STAR", 5)
    rng, rows = random.Random(8), []
    for size in (30, 9, 5, 1, 1, 1):
        base = [f"g{len(rows)}w{i}" for i in range(100)]
        for _ in range(size):
            text = list(base)
            text[rng.randrange(100)] = f"x{rng.randrange(999)}"
            rows.append((len(rows) * 31 % 97, " ".join(text), "a"))
    want = plain_components([i for i, _, _ in rows], word_sets([t for _, t, _ in rows], 5))
    sigs = near_dedup.signatures(make(rows), 5).dropDuplicates(["key"]).collect()
    reps = make(rows).sparkSession.createDataFrame([(r.doc_id, r.doc_id, r.key, r.sig, [1, 2]) for r in sigs], "rep bigint, doc_id bigint, key binary, sig array<bigint>, bands array<bigint>")
    got = {r.node: r.component for r in near_dedup._linked(reps, make(rows), 5, 80, 100).collect()}
    assert {i: got.get(i, i) for i in want} == want and len(set(want.values())) == 6


def test_near_duplicates_edges(edge, empty):
    out = near_dedup.near_duplicates(edge, words=2).collect()
    assert len(out) == len(EDGE)
    got = {r.doc_id: r for r in out}
    assert got[7].component_id == 1 and not got[7].kept
    assert all(got[i].component_id == i and got[i].kept and got[i].n_shingles == 0 for i in (2, 3, 4))
    assert got[None].component_id is None and got[None].kept
    assert got[5].n_shingles == len(word_sets([LONG], 2)[0]) and got[6].n_shingles == 1
    assert near_dedup.near_duplicates(empty).count() == 0


def test_deduplicated_keeps_one_of_each(make, edge):
    rows = variants()
    df = make(rows + rows[:5])  # repeated rows
    want = plain_components([i for i, _, _ in rows], word_sets([t for _, t, _ in rows], 5))
    out = near_dedup.deduplicated(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(want.values()))
    assert near_dedup.deduplicated(edge).filter("doc_id is null").count() == 1


def test_estimate_is_unbiased(spark):
    rng = np.random.default_rng(0)
    rows, true = [], []
    for n in (100, 400, 800, 950):
        common = rng.integers(0, 2**63, n, dtype=np.uint64)
        a, b = (np.unique(np.r_[common, rng.integers(0, 2**63, 1000 - n, dtype=np.uint64)]) for _ in range(2))
        true.append(n / (2000 - n))
        rows.append((near_dedup.packed(near_dedup.minima(a)).tolist(), near_dedup.packed(near_dedup.minima(b)).tolist()))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<bigint>, b array<bigint>")
    got = [r.e for r in df.select("i", near_dedup.estimate(F.col("a"), F.col("b")).alias("e")).orderBy("i").collect()]
    assert np.abs(np.array(got) - true).max() < 0.15


def test_no_word_stays_in_the_worker():
    shingler = near_dedup.Shingler(2)
    shingler.shingles("a b c")
    tracemalloc.start()
    try:
        for i in range(20):
            shingler.shingles(" ".join(f"w{i}x{j}" for j in range(2000)))
        kept = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert kept < 500_000


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = dict(near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert near_dedup.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_pipeline(spark, make, tmp_path):
    import corpus_pipeline

    from .test_selection import corpus

    rows, known = corpus(400)
    rows += [(1000 + i, t, s) for i, t, s in rows[:30]]  # copies
    rows += [(2000, "reach me at who@example.org " + rows[1][1], "s1"), (2001, None, None), (2002, "", "s2")]
    docs = make(rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(known, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == docs.columns, name
        d.write.parquet(f"{tmp_path}/{len(seen)}")
        d = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append({r.doc_id: r.text for r in d.collect()})
    toxic = {i for i, _, t in known if t}
    assert len(toxic & set(seen[0])) <= 0.1 * len(toxic)
    assert len({i for i, *_ in known} - toxic - set(seen[0])) <= 0.05 * len(known)
    assert not {i for i in seen[1] if 1000 <= i < 1030 and i - 1000 in seen[0]}
    assert "who@example.org" not in " ".join(t or "" for t in seen[2].values())
    out = corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path))
    assert out.count() == d.count() and out.agg(F.sum("n_tokens")).first()[0] > 0


def test_pipeline_edges(spark, edge, empty, labels, tmp_path):
    import corpus_pipeline

    for name, df in (("edge", edge.unionByName(edge.filter("doc_id = 8"))), ("empty", empty)):
        df.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/edge").collect()
    assert {r.doc_id for r in out} <= {i for i, _, _ in EDGE} and all(r.n_tokens == len(r.ids) for r in out)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
