"""Ranked search against a plain sum over all terms of all documents."""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter

from pyspark.sql import functions as F

from edgewright.llm import ranking
from tests.oracle import assert_equal

from .conftest import SCHEMA, ordered

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows, items, k=20):
    docs = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in rows]
    docs = [(i, t) for i, t in docs if t]
    n, words = len(docs), sum(len(t) for _, t in docs)
    df = Counter(w for _, t in docs for w in set(t))
    out = []
    for item, text in items:
        got = []
        for i, t in docs:
            m, tf = 75 + 25 * len(t) * n // words, Counter(t)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 12 * m)) for w in TERM.findall((text or "").translate(LOWER)) if tf[w])
            if score > 0:
                got.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(got)[:k], 1)]
    return out


def test_sql(spark, data):
    assert_equal(ranking.op12_ranking(spark, data).toPandas(), ranking.ORACLE, data)


def test_odd_rows(spark, docs, rows, no_docs):
    items = [(1, rows[0][1][:200]), (2, None), (3, ""), (4, "ZÜRICH ist schön"), (5, "la la la word"), (5, "la la la word"), (None, rows[3][1]), (7, "nowhere...")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("own"))
    assert ordered(ranking.ranked(docs, asked).collect()) == ordered(plain([(r[0], r[1]) for r in rows], items))
    assert ranking.ranked(no_docs, asked).count() == 0 and ranking.ranked(docs, asked.limit(0)).count() == 0


def test_small_blocks_groups_and_strata_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    letters = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(30)]
    rows = [(i, " ".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 9, 40, 200]))), None, None, None) for i in range(300)]
    items = [(i, " ".join(rng.choice(letters) for _ in range(6))) for i in range(25)]
    monkeypatch.setattr(ranking, "ITEMS", 7)
    monkeypatch.setattr(ranking, "GROUP", 700)
    monkeypatch.setattr(ranking, "STRATA", 3)
    monkeypatch.setattr(ranking, "SEEDS", 50)
    got = ranking.ranked(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), 5)
    assert ordered(got.collect()) == ordered(plain([r[:2] for r in rows], items, 5))
