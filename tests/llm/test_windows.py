"""Suffix dedup and substring dedup against brute force."""

from __future__ import annotations

import dataclasses
import random
from collections import Counter

import numpy as np
import pytest

from edgewright.llm import substring_dedup, suffix_dedup, windows

from .conftest import ordered


def brute(texts, size, join):
    units = [(t or "").encode() for t in texts]
    units = [u.split() if join else u for u in units]
    window = lambda u, i: tuple(u[i : i + size])
    n = Counter(window(u, i) for u in units for i in range(len(u) - size + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - size + 1):
            if n[window(u, i)] > 1:
                gone[i : i + size] = [True] * size
        kept = [x for x, g in zip(u, gone, strict=True) if not g]
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(u), sum(gone), spans, b" ".join(kept) if join else bytes(kept)))
    return out


@pytest.mark.parametrize("hot", [10_000, 2])
def test_words(docs, rows, hot):
    units = dataclasses.replace(substring_dedup.UNITS, hot=hot)
    found = [(r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in substring_dedup.remove_repeats(docs, units).collect()]
    assert ordered(found) == ordered((r[0], n, gone, kept) for r, (n, gone, _, kept) in zip(rows, brute([r[1] for r in rows], 35, True), strict=True))


@pytest.mark.parametrize(("hot", "batches", "grouped"), [(10_000, 4, 1 << 14), (2, 3, 1 << 14), (10_000, 1, 3), (1, 2, 2)])
def test_bytes(docs, rows, monkeypatch, hot, batches, grouped):
    """Whatever the batches, the size of a hot group, and how many suffixes are taken at once."""
    monkeypatch.setattr(suffix_dedup, "GROUPED", grouped)
    units = dataclasses.replace(suffix_dedup.UNITS, hot=hot)
    found = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs, units, batches).collect()]
    assert ordered(found) == ordered((r[0], *x) for r, x in zip(rows, brute([r[1] for r in rows], 400, False), strict=True))


def test_texts_that_repeat_themselves(spark):
    """Periods around size - gram + 1, where a window holds each gram once."""
    rng = random.Random(15)
    texts = []
    for period in (23, 24, 25):
        for more in (1, 3, 10, 23, 35):
            for _ in range(8):
                line = [f"w{rng.getrandbits(40)}" for _ in range(period)]
                texts.append(" ".join((line * 4)[: period + 34 + more]))
    rows = list(enumerate(texts))
    found = [(r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert ordered(found) == ordered((i, x[1]) for (i, _), x in zip(rows, brute(texts, 35, True), strict=True))
    texts = []
    for period in (272, 273, 274):
        for more in (1, 40, 272, 400):
            for _ in range(6):
                line = "".join(rng.choice("abcdefghijklmnop") for _ in range(period))
                texts.append((line * 4)[: period + 399 + more])
    rows = list(enumerate(texts))
    found = [(r["doc_id"], r["n_removed"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), suffix_dedup.UNITS, 2).collect()]
    assert ordered(found) == ordered((i, x[1]) for (i, _), x in zip(rows, brute(texts, 400, False), strict=True))


def test_empty(no_docs):
    assert substring_dedup.remove_repeats(no_docs).count() == 0
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_levels_grow_geometrically(spark):
    family = suffix_dedup.Family()
    for i in range(6):
        family.add(spark.createDataFrame([(0, 1, 5, 1), (i, 1, 100 + i, 1)], "lead long, more long, key long, n long"))
    assert [rank for rank, _ in family.levels] == [2, 1]
    assert [tuple(r) for r in family.matching().collect()] == [(0, 1, 5, 6)]


def test_arrays_are_in_the_order_of_bytes():
    rng = random.Random(16)
    text = bytes(rng.choice(b"ab\xff\x00") for _ in range(500))
    places = list(range(0, 480, 7))
    first, more = suffix_dedup.leads(text, np.array(places))
    assert sorted(places, key=lambda p: text[p : p + 16]) == sorted(places, key=lambda p: (first[places.index(p)], more[places.index(p)]))
    rows = np.array([[rng.choice(b"ab") for _ in range(6)] for _ in range(60)], np.uint8)
    group = np.repeat([0, 1, 2], 20)
    order, common = suffix_dedup._classes(rows, group)
    assert [(group[i], bytes(rows[i])) for i in order] == sorted((group[i], bytes(rows[i])) for i in range(60))
    for k in range(1, 60):
        a, b = bytes(rows[order[k - 1]]), bytes(rows[order[k]])
        want = next((i for i in range(6) if a[i] != b[i]), 6) if group[order[k]] == group[order[k - 1]] else -1
        assert common[k] == want


def test_texts_over_a_chunk(spark, monkeypatch):
    """Chunks of fewer units than a text change nothing."""
    rng = random.Random(17)
    shared = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120))
    fill = lambda n: " ".join("".join(rng.choice("ijklmnop") for _ in range(4)) for _ in range(n))
    rows = [(i, fill(90 + i) + " " + shared + " " + fill(70)) for i in range(3)] + [(3, fill(300)), (4, shared * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = [t for _, t in rows]
    for chunk in (450, 1000):
        monkeypatch.setattr(windows, "CHUNK", chunk)
        found = sorted((r["doc_id"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(df, batches=2).collect())
        assert found == [(i, x[1], x[2]) for i, x in enumerate(brute(texts, 400, False))]
        monkeypatch.setattr(windows, "CHUNK", chunk // 8)
        found = sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeats(df).collect())
        assert found == [(i, x[1]) for i, x in enumerate(brute(texts, 35, True))]


def test_windows_under_the_size_are_kept(spark):
    """399 shared bytes stay and 400 go, wherever they stand."""
    rng = random.Random(18)
    fill = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    rows = []
    for n in (399, 400, 401, 672, 800):
        for before in (0, 1, 150, 300):
            shared = fill(n)
            rows += [(len(rows) + k, fill(before) + shared + fill(after)) for k, after in enumerate((0, 200))]
    found = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute([t for _, t in rows], 400, False)
    assert found == {i: x[1] for i, x in enumerate(want)} and sum(x[1] > 0 for x in want) == 32


def test_a_batch_added_later_changes_nothing(docs):
    one = suffix_dedup.remove_repeats(docs, batches=1).select("doc_id", "n_removed", "n_spans")
    many = suffix_dedup.remove_repeats(docs, batches=5).select("doc_id", "n_removed", "n_spans")
    assert ordered(one.collect()) == ordered(many.collect())


def test_windows_of_equal_hash_are_compared(monkeypatch):
    monkeypatch.setattr(windows, "gram_hashes", lambda units, length: np.zeros(max(0, len(units) - length + 1), np.uint64))
    u = windows.Units(3, 2, bytes, windows.hash_bytes, b"")
    assert [x.tolist() for x in windows.repeated_in([b"abcde", b"xbcdy"], u)] == [[1], [1]]
