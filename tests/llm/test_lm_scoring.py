"""LM scoring: the baseline by its definition, the sampler and the scores by enumeration, held-out gain."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from edgewright.llm import lm_scoring

from .conftest import ordered


@pytest.mark.parametrize("small", [False, True])
def test_base_scores_equal_definition(docs, rows, no_docs, monkeypatch, small):
    if small:  # several blocks, and several parts of the vocabulary
        monkeypatch.setattr(lm_scoring, "BLOCK", 500)
        monkeypatch.setattr(lm_scoring, "PART", 2000)
    found = lm_scoring.score(docs).collect()
    tokens = [[*(r[1] or "").encode().lower().split(), None] for r in rows]
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 == 0 for r in rows]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = [(r[0], h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for r, h, t in zip(rows, held, tokens, strict=True)]
    assert ordered((*tuple(r)[:5], round(r["base_score"], 6)) for r in found) == ordered(want)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    assert lm_scoring.score(no_docs).count() == 0


def test_nothing_to_learn_from(docs):
    held = docs.filter(lm_scoring.common.held_out(10, 0))
    rows = lm_scoring.score(held).collect()
    assert rows and all((r["train_tokens"], r["n_known"]) == (0, 0) and math.isfinite(r["score"]) and r["score"] < 0 for r in rows)


@pytest.fixture(scope="module")
def with_junk(spark):
    """Scores a token of documents, and of held-out rows of words that training lacks."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(1)
    ids = [i for i in range(10**6, 10**6 + 200) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    junk = [(i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(400))) for i in ids[:3]]
    scored = lm_scoring.score(table.union(spark.createDataFrame([*junk, (ids[3], "один два три четыре пять " * 9)], table.schema)))
    return {r["doc_id"]: r for r in scored.collect()}, set(ids)


def test_words_that_training_lacks_score_worst(with_junk):
    rows, junk = with_junk
    real = [r["score"] / r["n_tokens"] for r in rows.values() if r["held_out"] and r["doc_id"] not in junk and r["n_tokens"] > 20]
    assert all(rows[i]["score"] / rows[i]["n_tokens"] < min(real) for i in list(sorted(junk))[:3])
    assert all(rows[i]["held_out"] for i in junk)


def test_known_words_score_above_the_baseline(with_junk):
    rows, junk = with_junk
    known = [r for r in rows.values() if r["held_out"] and r["doc_id"] not in junk and r["n_known"] >= 0.97 * r["n_tokens"]]
    tokens = sum(r["n_tokens"] for r in known)
    assert len(known) > 10 and sum(r["score"] - r["base_score"] for r in known) / tokens > 0.03


def test_order_of_words_is_scored(spark):
    """Texts of set phrases, in order and shuffled."""
    rng = random.Random(3)
    lexicon = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)]
    texts = []
    for _ in range(60):
        phrases = [rng.sample(lexicon, 5) for _ in range(6)]
        texts.append([w for _ in range(25) for w in rng.choice(phrases)])
    rows = list(enumerate(" ".join(t) for t in texts)) + [(1000 + i, " ".join(rng.sample(t, len(t)))) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] > got[1000 + i] for i in range(60))


def test_words_are_scored_after_those_before_them_in_other_texts(spark):
    """Held-out texts without repeats, in phrases of training texts, and the same words in another order."""
    rng = random.Random(4)
    lexicon = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
    phrases = [lexicon[i : i + 5] for i in range(0, 200, 5)]
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    rows = [(i, " ".join(w for p in rng.sample(phrases, 8) for w in p)) for i in range(300) if zlib.crc32(str(i).encode()) % 10]
    for i in range(0, 40, 2):
        text = [w for p in rng.sample(phrases, 8) for w in p]
        rows += [(held[i], " ".join(text)), (held[i + 1], " ".join(rng.sample(text, len(text))))]
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[held[i]] > got[held[i + 1]] + 10 for i in range(0, 40, 2))


@pytest.mark.parametrize("small", [False, True])
def test_scores_are_a_distribution(spark, monkeypatch, small):
    """Chances of the texts that training holds sum to less than one, and to nearly one."""
    if small:  # the blocks that score a pair aren't those that seat it
        monkeypatch.setattr(lm_scoring, "BLOCK", 40)
        monkeypatch.setattr(lm_scoring, "PART", 300)
        monkeypatch.setattr(lm_scoring, "PAIRS", 300)
    texts = ["", "a", "b c", "a a d"]
    training = [i for i in range(900) if zlib.crc32(str(i).encode()) % 10]
    held = [i for i in range(900) if i not in set(training)][: len(texts)]
    rows = [(i, texts[i % 7 % 4]) for i in training] + list(zip(held, texts, strict=True))
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    chances = dict(zip(texts, (10 ** got[i] for i in held), strict=True))
    assert 0.5 < sum(chances.values()) < 1 and chances["a"] > 0.1
    by_text = {t: {round(got[i], 9) for i, x in rows if x == t} for t in texts}
    assert all(len(x) == 1 for x in by_text.values())


def test_keyed_draws_follow_their_laws():
    keys = lm_scoring.keyed(np.arange(200_000, dtype=np.uint64), 3, 1)
    assert np.histogram(lm_scoring.uniform(keys, 0), 20, (0, 1))[0] == pytest.approx(np.full(20, 10_000), rel=0.05)
    z = lm_scoring.normal(keys, 0)
    assert (z.mean(), z.std()) == pytest.approx((0, 1), abs=0.01)
    for a in (1.0, 1.4, 30.0, 5e4):
        g = lm_scoring.keyed_gamma(np.full(len(keys), a), keys)
        assert (g.mean(), g.var()) == pytest.approx((a, a), rel=0.02) and (g > 0).all()
    for m in (0.3, 20.0, 900.0):
        n = lm_scoring.keyed_poisson(np.full(len(keys), m), keys)
        assert (n.mean(), n.var()) == pytest.approx((m, m), rel=0.02)
    for x in (0.02, 0.9, 30.0):
        t = lm_scoring.draw_tables(np.full(40_000, 5), np.full(40_000, x), 0.53125, None, keys[:40_000])
        w = np.exp(lm_scoring.stirling(0.53125)[5, 1:6] + np.arange(1, 6) * math.log(x))
        assert np.bincount(t, minlength=6)[1:] / 40_000 == pytest.approx(w / w.sum(), abs=0.01)


def test_grid_of_restaurants():
    c, t = np.array([5, 5, 9, 700]), np.array([2, 1, 2, 30])
    for i, d in enumerate(lm_scoring.DISCOUNTS):
        for j, a in enumerate(lm_scoring.STRENGTHS):
            want = sum(lm_scoring.log_rising(np.array([a]), d, np.array([y]))[0] - lm_scoring.log_rising(np.array([a]), 1.0, np.array([x]))[0] for x, y in zip(c, t, strict=True))
            assert lm_scoring.restaurants_grid(c, t)[i, j] == pytest.approx(want, abs=1e-6)


def test_spelling_is_a_distribution():
    """Over an alphabet of all bytes, chances of words by length sum to less than one and to nearly one with the longer ones' prefix."""
    words = [b"ab", b"abc", b"b", b""]
    base = lm_scoring.Spelling(np.bincount(lm_scoring._spelt(words)[0], minlength=lm_scoring.SPELLED * 257).astype(float))
    end = base([b""])[0]
    singles = [bytes([x]) for x in range(256)]
    one = base(singles)
    starts = [np.exp(base.logs[lm_scoring._spelt([w])[0][0]]) for w in singles]
    assert end + sum(starts) == pytest.approx(1) and (one <= starts).all()
    assert base([b"ab"])[0] > base([b"ba"])[0] and base.logs10([b"ab" * 400])[0] < -100


def partitions(n):
    """The sizes of blocks of every partition of n different things."""
    if n == 0:
        yield []
        return
    for rest in partitions(n - 1):
        yield [*rest, 1]
        for i in range(len(rest)):
            yield [*rest[:i], rest[i] + 1, *rest[i + 1 :]]


@pytest.mark.parametrize("d", [0.03125, 0.5, 0.96875])
def test_stirling_numbers_count_seatings(d):
    for n in range(1, 8):
        want = Counter()
        for sizes in partitions(n):
            want[len(sizes)] += math.prod(math.prod(k - d for k in range(1, s)) for s in sizes)
        assert np.exp(lm_scoring.stirling(d)[n, 1 : n + 1]) == pytest.approx([want[t] for t in range(1, n + 1)])


def test_logarithm_of_gamma():
    x = np.array([1e-3, 0.5, 1.0, 3.7, 50.0, 1e4, 1e7])
    assert lm_scoring.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("x", [0.02, 0.9, 30.0])
def test_tables_follow_their_law(x):
    rng, d = np.random.default_rng(3), 0.53125
    for n in (2, 5, 40):
        t = lm_scoring.draw_tables(np.full(40_000, n), np.full(40_000, x), d, rng)
        w = np.exp(lm_scoring.stirling(d)[n, 1 : n + 1] + np.arange(1, n + 1) * math.log(x))
        assert np.bincount(t, minlength=n + 1)[1:] / 40_000 == pytest.approx(w / w.sum(), abs=0.01)


@pytest.mark.parametrize("x", [0.02, 0.9, 30.0, 900.0])
@pytest.mark.parametrize("d", [0.15625, 0.53125, 0.84375])
def test_limit_law_of_many_customers(x, d):
    """Above EXACT, mean and deviation are those of the exact law."""
    n, rng = 1500, np.random.default_rng(4)
    w = lm_scoring.stirling(d, n)[n, 1:] + np.arange(1, n + 1) * math.log(x)
    w = np.exp(w - w.max())
    mean = float(w @ np.arange(1, n + 1) / w.sum())
    sd = math.sqrt(float(w @ (np.arange(1, n + 1) - mean) ** 2 / w.sum()))
    t = lm_scoring.draw_tables(np.full(20_000, n), np.full(20_000, x), d, rng)
    assert t.mean() == pytest.approx(mean, rel=0.05, abs=0.1) and t.std() == pytest.approx(sd, rel=0.2, abs=0.1)


def test_sampler_agrees_with_enumeration():
    """Two documents under one parent: its mean predictive probability over all seatings, and over sweeps."""
    counts, d, a, d0, a0, base = [{0: 4, 1: 1}, {0: 3, 2: 2}], 0.5, 2.0, 0.5, 1.0, 1 / 4
    rising = lambda s, step, n: math.prod(s + step * k for k in range(n))
    s = lambda disc, n, t: math.exp(lm_scoring.stirling(disc)[n, t])
    cells = [(i, w, c) for i, doc in enumerate(counts) for w, c in doc.items()]
    total, mean = 0.0, np.zeros(3)
    for ts in itertools.product(*(range(1, c + 1) for _, _, c in cells)):
        at = Counter()
        weight = 1.0
        for (i, w, c), t in zip(cells, ts, strict=True):
            at[w] += t
            weight *= s(d, c, t)
        for i, doc in enumerate(counts):
            weight *= rising(a, d, sum(t for (j, _, _), t in zip(cells, ts, strict=True) if j == i)) / rising(a, 1, sum(doc.values()))
        for tops in itertools.product(*(range(1, at[w] + 1) for w in range(3))):
            one = weight * math.prod(s(d0, at[w], t) for w, t in enumerate(tops)) * base ** sum(tops) * rising(a0, d0, sum(tops)) / rising(a0, 1, sum(at.values()))
            p = lm_scoring.predictive(np.array([at[w] - d0 * t for w, t in enumerate(tops)]), (sum(at.values()), sum(tops), d0, a0), base)
            total += one
            mean += one * p
    rng, kept = np.random.default_rng(5), np.zeros(3)
    doc, word, c = (np.array([x[k] for x in cells]) for k in range(3))
    t, top = np.ones(len(c), np.int64), np.ones(3, np.int64)
    for k in range(6000):
        at = np.bincount(word, t).astype(np.int64)
        p = lm_scoring.predictive(at - d0 * top, (at.sum(), top.sum(), d0, a0), base)
        kept += p * (k >= 500)
        gamma = rng.gamma(a / d + np.bincount(doc, t))
        t = lm_scoring.draw_tables(c, d * gamma[doc] * p[word], d, rng)
        at = np.bincount(word, t).astype(np.int64)
        top = lm_scoring.draw_tables(at, np.full(3, d0 * rng.gamma(a0 / d0 + np.minimum(top, at).sum()) * base), d0, rng)
    assert kept / 5500 == pytest.approx(mean / total, rel=0.06)


def test_scores_take_words_one_by_one():
    """At each place the chances of all types, the end among them, sum to one."""
    p, p_end, (d, a), (e, b) = np.array([0.3, 0.25, 0.15, 0.2]), 0.1, (0.4, 3.0), (0.7, 1.5)
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 4, n) for n in (0, 1, 7, 40, 0)]
    flat = np.concatenate(texts)
    found = lm_scoring.text_scores(np.array([len(t) for t in texts]), flat, np.log10(p[flat]), p_end, (d, a), (e, b))
    for text, got in zip(texts, found, strict=True):
        log, document, after = 0.0, Counter(), {}
        past = None
        for w in [*text.tolist(), 4]:
            mine = after.setdefault(past, Counter())
            of_document = [(max(document[x] - d, 0) + (a + d * len(document)) * q) / (sum(document.values()) + a) for x, q in enumerate([*p, p_end])]
            chance = [(max(mine[x] - e, 0) + (b + e * len(mine)) * of_document[x]) / (sum(mine.values()) + b) for x in range(5)]
            assert sum(chance) == pytest.approx(1)
            log += math.log10(chance[w])
            document[w] += mine[w] == 0  # a new table of the word before is a customer of the document
            mine[w] += 1
            past = w
        assert got == pytest.approx(log)


def test_grid_of_words_restaurants():
    """Against the product of chances of a seating with one table for each pair of words."""
    texts, trained = [[0, 1, 0, 1, 0, 1], [2], [], [1, 1, 1]], np.array([True, True, True, False])
    grid = lm_scoring.context_grid(np.array([len(t) for t in texts]), np.array(sum(texts, [])), 3, trained)
    for i, d in enumerate(lm_scoring.DISCOUNTS):
        for j, a in enumerate(lm_scoring.STRENGTHS):
            log = 0.0
            for text, mine in zip(texts, trained, strict=True):
                seen: dict = {}
                for past, w in zip([None, *text], [*text, "end"], strict=True):
                    at = seen.setdefault(past, Counter())
                    log += mine * math.log((at[w] - d if at[w] else a + d * len(at)) / (sum(at.values()) + a))
                    at[w] += 1
            assert grid[i, j] == pytest.approx(log)


def test_arrays_come_back():
    for x in (np.arange(1000, dtype=np.int32), np.array([], np.int32), np.array([-5, 1 << 40])):
        assert (lm_scoring.unpacked(lm_scoring.packed(x), x.dtype.str) == x).all()


def test_tables_of_sweeps_and_shuffles_are_gone_when_texts_are_rated(spark, docs):
    folder, local = (Path(x.removeprefix("file:")) for x in (lm_scoring.common.shared_folder(spark), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()))
    before, shuffled = set(folder.iterdir()), set(local.rglob("shuffle_*.data"))
    lm_scoring.score(docs)
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before if spark.read.parquet(str(p)).count()}
    assert left == {"blocks", "lexicon", "pairs", "kept"}
    assert sum(p.stat().st_size for p in set(local.rglob("shuffle_*.data")) - shuffled) < 1 << 20


def test_texts_are_scored_alike_in_parts(monkeypatch):
    rng = np.random.default_rng(7)
    n = np.array([0, 3, 0, 12, 5, 1, 0, 40, 2])
    types, log_p = rng.integers(0, 5, n.sum()), np.log10(rng.random(n.sum()))
    whole = lm_scoring.text_scores(n, types, log_p, 0.1, (0.4, 3.0), (0.7, 1.5))
    for some in (1, 4, 15):
        monkeypatch.setattr(lm_scoring, "SCORED", some)
        assert lm_scoring.text_scores(n, types, log_p, 0.1, (0.4, 3.0), (0.7, 1.5)).tolist() == whole.tolist()


def test_numbers_come_back_from_their_index():
    for x in (np.repeat(np.array([0.5, 7.25, 3.0], np.float32), 100), np.array([], np.float32)):
        assert (lm_scoring.unindexed(lm_scoring.indexed(x), "<f4") == x).all()
