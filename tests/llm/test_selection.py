"""Mixing, nearest neighbours, quality and toxicity."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslane.llm import ann, mixing, quality, toxicity

from .conftest import EDGE


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Water filling by repetition."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, left, out = {s for s in names if sizes[s]}, share * sum(sizes.values()), {s: 0.0 for s in names}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total >= most * sizes[s]}
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mix_targets_and_balance(make):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 300)), ["s1", "s2", "s10", None, "t"][0 if i % 3 == 0 else i % 5]) for i in range(1500)]
    df = make(rows)
    out = mixing.mix(df, block_rows=64).collect()
    assert len(out) == len(rows)
    size = {i: len(t.split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    sums = {}
    for i in size:
        sums[source[i]] = sums.get(source[i], 0) + size[i]
    want, taken = plain_targets(sums), {}
    for r in out:
        assert r.size == size[r.doc_id] and r.source_size == sums[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    for s in want:
        assert taken[s] == pytest.approx(want[s], rel=0.02)
    again = mixing.mix(df, block_rows=64).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in out)


def test_flight_keeps_sums_and_probabilities():
    import random

    sizes, p, hits = [5, 3, 8, 2, 7, 1, 4, 6] * 4, [0.3] * 32, np.zeros(32)
    for seed in range(400):
        q = mixing.flight(sizes, p, random.Random(seed), False)
        assert sum(0 < x < 1 for x in q) <= 2
        assert sum(q) == pytest.approx(sum(p)) and np.dot(q, sizes) == pytest.approx(np.dot(p, sizes))
        hits += q
    assert np.abs(hits / 400 - 0.3).max() < 0.12


def test_mix_edges(edge, empty):
    assert mixing.mix(edge).count() == len(EDGE)
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed_documents(edge)
    assert mixed.columns == edge.columns
    plan = {}
    for r in mixing.mix(edge, row_key=F.xxhash64(*edge.columns)).collect():
        plan[r.doc_id] = plan.get(r.doc_id, 0) + r.copies
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in plan.items() if v}


def vectors(spark, n, clustered):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, 24)) * rng.uniform(0.5, 2, (n, 1))
    if clustered:
        x = 0.3 * x + rng.standard_normal((40, 24))[rng.integers(0, 40, n)] * 3
    x = x.astype(np.float32)
    x[1::97] = x[0]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    full = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(full, -np.inf)
    return df, full


@pytest.mark.parametrize("clustered", [False, True])
def test_search_recall(spark, clustered):
    df, full = vectors(spark, 3000, clustered)
    out = ann.search(df).toPandas()
    recall = []
    for q, g in out.groupby("query_id"):
        assert q % 20 == 0 and len(g) == 20 and q not in set(g.vec_id)
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and (np.diff(g.score) <= 0).all()
        assert np.allclose(g.score, full[q, g.vec_id])
        recall.append((g.score.to_numpy() >= np.sort(full[q])[-20] - 1e-9).mean())
    assert len(recall) == 150 and np.mean(recall) >= 0.9


@pytest.mark.parametrize("clustered", [False, True])
def test_exact_search(spark, monkeypatch, clustered):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    df, full = vectors(spark, 2000, clustered)
    got = {}
    for r in ann.search(df, list_recall=1.0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(got) == list(range(0, 2000, 20))
    for q, found in got.items():
        assert [found[i][1] for i in range(1, 21)] == pytest.approx(np.sort(full[q])[::-1][:20])
        assert len({v for v, _ in found.values()}) == 20


def test_search_with_equal_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(map(tuple, ann.search(df).collect())) == [(0, 1, 1, 3.0), (0, 2, 1, 2.0)]


def test_search_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [float("inf"), 0.0])]
    df = spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], "vec_id bigint, embedding array<float>, id string, x string, list string")
    got = sorted(tuple(r) for r in ann.search(df).collect())
    # too few rows: every query gets all others, ties by id
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert ann.search(df.limit(0)).count() == 0


def corpus(n=600):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("aeioutrnshl"), rng.integers(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [words[k] for k in rng.integers(0, 300, rng.integers(20, 120))]
        toxic, good = int(i % 4 == 0), int(i % 5 != 0)
        if toxic:
            for _ in range(4):
                text.insert(int(rng.integers(0, len(text))), str(rng.choice(["moron", "scumbag", "zzidiot"])))
        if not good:
            text = [text[0]] * 60
            if toxic:
                text.append("moron")
        rows.append((i, " ".join(text), f"s{i % 3}"))
        labels.append((i, good, toxic))
    return rows, labels


def test_classifiers_on_held_out(spark, make):
    rows, known = corpus()
    df, labels = make(rows), spark.createDataFrame(known, "doc_id bigint, quality int, toxic int")
    for f, at in ((toxicity.toxicity, 2), (quality.quality, 1)):
        out = f(df, labels).collect()
        assert len(out) == len(rows)
        for r in out:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        held = [r for r in out if r.held_out]
        assert np.mean([r.predicted == known[r.doc_id][at] for r in held]) > 0.9


def test_toxicity_labels_of_fold_0_do_not_matter(spark, make):
    rows, known = corpus(300)
    df = make(rows)
    flip = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in known]
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.toxicity(df, spark.createDataFrame(k, "doc_id bigint, quality int, toxic int")).collect()) for k in (known, flip))
    assert [x[0] for x in a] == [x[0] for x in b] and np.allclose([x[1] for x in a], [x[1] for x in b])


class PlainKneserNey:
    """Interpolated Kneser-Ney of two classes over one shared backoff, from n-gram -> (toxic count, ordinary count)."""

    def __init__(self, counts):
        self.counts = counts
        seen = {g[i:] for g in counts for i in range(len(g) - 1)}
        self.shared = {}  # in how many ways an n-gram is preceded; a word's start isn't, and counts once
        for g in seen:
            self.shared[g[1:]] = self.shared.get(g[1:], 0) + 1
        for g in seen:
            if g[0] == "\x02" and len(g) < toxicity.ORDER:
                self.shared[g] = self.shared.get(g, 0) + 1
        self.alphabet = sorted({g[-1] for g in counts}) + ["an unknown one"]

    def mix(self, table, context, c, lower):
        inside = {x: table[context + x] for x in self.alphabet if table.get(context + x)}
        total, d = sum(inside.values()), toxicity.DISCOUNT
        return (max(inside.get(c, 0) - d, 0) + d * len(inside) * lower) / total if total else lower

    def backoff(self, context, c):
        p = 1 / len(self.alphabet)
        for i in range(len(context), -1, -1):
            p = self.mix(self.shared, context[i:], c, p)
        return p

    def p(self, cls, context, c):
        own = {g: n[cls] for g, n in self.counts.items()}
        return self.mix(own, context, c, self.backoff(context[1:] if len(context) == toxicity.ORDER - 1 else context, c))

    def word(self, word):
        w, out = f"\x02{word}\x03", 0.0
        for i in range(1, len(w)):
            context = w[max(0, i - toxicity.ORDER + 1) : i]
            out += np.log(self.p(0, context, w[i])) - np.log(self.p(1, context, w[i]))
        return out


def plain_counts(rows, y, folds):
    counts = {}
    for i, text, _ in rows:
        if zlib.crc32(str(i).encode()) % 5 in folds and i in y:
            for w in set(re.findall(r"\w+", text.lower())):
                for g in toxicity.ngrams(w):
                    counts.setdefault(g, [0, 0])[1 - y[i]] += 1
    return counts


def test_kneser_ney_against_plain_probabilities(spark, make):
    rows, known = corpus(40)
    k = next(i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 1)
    rows[k] = (k, rows[k][1] + " hapaxword ünïq😀", rows[k][2])
    rows = [(i, " ".join(t.split()[:12] + t.split()[-3:]), s) for i, t, s in rows]
    y = {i: x for i, _, x in known}
    counts = plain_counts(rows, y, (1, 2, 3))
    plain = PlainKneserNey(counts)
    for context in ["", "\x02", "\x02h", "hapa", "apaxw", "\x02mor", "zz"]:
        for cls in (0, 1):
            assert sum(plain.p(cls, context, c) for c in plain.alphabet) == pytest.approx(1, abs=1e-9)
    model = toxicity.fit(make(rows), spark.createDataFrame(known, "doc_id bigint, quality int, toxic int"), most_rows=3)
    got = model.ratios.lookup()
    assert any(t + o == 1 for t, o in counts.values())
    words = ["hapaxword", "hapax", "never", "ünïq", "x" * 30, "moron", *rows[3][1].split()[:10]]
    assert np.allclose(got.words(words), [plain.word(w) for w in words], atol=1e-9)
    texts = ["moron and moron, hapax!", "", "...", rows[1][1], "a-b moron"]
    for text, f in zip(texts, toxicity.Scorer(got).features(texts)):
        found = re.findall(r"\w+", text.lower())
        total = sum(plain.word(w) for w in found)
        assert f[0] == pytest.approx(total / (sum(map(len, found)) + len(found)) if found else 0, abs=1e-9)
        units = {max([plain.word(w) for w in re.findall(r"\w+", u)], default=0.0) for u in set(text.lower().split())}
        assert f[1] == pytest.approx(max(units, default=0.0), abs=1e-9)


def test_classifier_edges(edge, empty, labels):
    for f in (toxicity.toxicity, quality.quality):
        assert f(edge, labels).count() == len(EDGE)
        assert f(empty, labels).count() == 0
        assert f(edge, labels.limit(0)).count() == len(EDGE)
    model = toxicity.fit(edge, labels)
    kept = toxicity.without_toxic(edge, model)
    assert kept.columns == edge.columns and kept.count() <= len(EDGE)


def test_rates_shrink_toward_parents(spark, make):
    rows, known = corpus(400)
    rows = [(i, t, "big" if i < 390 else "tiny") for i, t, _ in rows]
    out = quality.quality(make(rows), spark.createDataFrame(known, "doc_id bigint, quality int, toxic int"))
    got = {r.doc_id: r for r in out.collect()}
    mean = np.mean([r.evidence for r in got.values()])
    tiny = np.mean([got[i].evidence for i in range(390, 400)])
    assert min(mean, tiny) - 1e-6 <= got[395].host_rate <= max(mean, tiny) + 1e-6


def plain_strength(groups):
    """(n, rate, prior) of each group to how many documents the prior is worth, by the method of moments."""
    n, k = sum(g[0] for g in groups), len(groups)
    if k < 2:
        return 10.0
    within = sum(g[0] * g[2] * (1 - g[2]) for g in groups) / n
    between = max((sum(g[0] * (g[1] - g[2]) ** 2 for g in groups) - k * within) / n, 1e-9)
    return min(max(within / between - 1, 1.0), 1e6)


def test_rates_match_plain_shrinkage(spark, make):
    rows, known = corpus(300)
    hosts = ["a"] * 200 + ["b"] * 60 + [None] * 35 + ["tiny"] * 5
    rows = [(i, None if i % 50 == 7 else t, h) for (i, t, _), h in zip(rows, hosts)]
    df = make(rows).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "x").when(F.col("doc_id") % 3 == 1, "y"))
    got = {r.doc_id: r for r in quality.quality(df, spark.createDataFrame(known, "doc_id bigint, quality int, toxic int")).collect()}
    paths, by_host = {}, {}
    for i, _, h in rows:
        paths.setdefault((h, (i % 3) % 3 if i % 3 < 2 else None), []).append(round(got[i].evidence, 9))
    for (h, _), v in paths.items():
        by_host.setdefault(h, []).extend(v)
    mean = sum(map(sum, by_host.values())) / len(rows)
    k = plain_strength([(len(v), sum(v) / len(v), mean) for v in by_host.values()])
    host_rate = {h: (sum(v) + k * mean) / (len(v) + k) for h, v in by_host.items()}
    k = plain_strength([(len(v), sum(v) / len(v), host_rate[h]) for (h, _), v in paths.items()])
    for (h, c), v in paths.items():
        for i in [i for i, _, x in rows if x == h and (i % 3 if i % 3 < 2 else None) == c]:
            r, own = got[i], got[i].evidence
            rate = min(max((max(sum(v) - own, 0) + k * host_rate[h]) / (len(v) - 1 + k), 1e-4), 1 - 1e-4)
            odds = np.log(own / (1 - own)) + np.log(rate / (1 - rate)) - np.log(mean / (1 - mean))
            assert (r.host_rate, r.path_rate, r.score) == pytest.approx((host_rate[h], rate, 1 / (1 + np.exp(-odds))), abs=1e-6)
