"""Toxicity: decoding against brute force over all ways, held-out accuracy, and hidden words."""

from __future__ import annotations

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgewright.llm import toxicity

from .conftest import SCHEMA

WORDS = "trash stupid clown worthless moron idiot loser the there other mother weather stone".split()


@pytest.fixture(scope="module")
def model():
    return toxicity.CharacterModel(toxicity.character_counts(WORDS, np.arange(1, 1 + len(WORDS))))


def hidden(word, rng):
    kind = rng.randrange(5)
    if kind == 0:
        return "".join({"i": "1", "o": "0", "e": "3", "a": "4", "s": "$", "t": "7"}.get(c, c) for c in word)
    if kind == 1:
        return " ".join(word)
    if kind == 2:
        return word[0] + "".join(c * rng.choice([1, 3]) for c in word[1:])
    if kind == 3:
        return ".".join(word)
    return word.upper()


def test_counts_of_characters(model):
    """Probabilities after any context sum to less than one over the characters seen, and follow counts."""
    letters = sorted({c for w in WORDS for c in w} | {"\n"})
    for before in ("\n\n\n", "\n\nt", "the", "xyz"):
        assert 0.5 < sum(np.exp(-model.cost(before, c)) for c in letters) <= 1 + 1e-9
    assert model.cost("oth", "e") < model.cost("oth", "r")


@pytest.mark.parametrize("text", ["1d10t", "m0r0n", "i.d.i.o.t", "t h e", "stuuupid", "$t0ne!", "l.o s", "a1b", "zz0"])
def test_decoding_finds_the_best_way(model, text):
    runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", text)]
    ways = []
    for i, (c, n) in enumerate(runs):
        alone = (i < 2 or not runs[i - 2][0].isalnum()) or (i + 2 >= len(runs) or not runs[i + 2][0].isalnum())
        ways.append(toxicity._ways(c, n, alone))
    best = None
    for way in itertools.product(*ways):
        cost, letters = sum(p for _, p in way), "".join(e for e, _ in way)
        for word in [w for w in letters.split("\n") if w]:
            padded = "\n\n\n" + word + "\n"
            cost += sum(model.cost(padded[i - 3 : i], padded[i]) for i in range(3, len(padded)))
        if best is None or cost < best[0] - 1e-9:
            best = cost, " ".join(letters.replace("\n", " ").split())
    assert toxicity.decoded(text, model) == best[1]


def test_restores_words_and_leaves_plain_ones(model):
    restore, rng = toxicity.Restorer(model), random.Random(2)
    for word in WORDS[:7]:
        assert all(restore(f"there {hidden(word, rng)} mother") == f"there {word} mother" for _ in range(12))
    plain = "the other, mother's weather: stone 12 (there) - 3.5 a! no!!"
    assert restore(plain) == plain


def test_held_out_documents(spark, data):
    data = data.replace("sf0.001", "sf0.01")
    found = toxicity.op13_toxicity(spark, data)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").filter("held_out AND toxic IS NOT NULL").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.9 * len(rows)


def test_finds_hidden_words_and_leaves_clean_texts(spark):
    rng = random.Random(4)
    calm = ["".join(rng.choice("aeionrsthl") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    bad = WORDS[:7]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(calm) for _ in range(rng.randint(5, 80))]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text), None, None, None))
        labels.append((i, toxic))
    for i in range(600, 640):
        text = [rng.choice(calm) for _ in range(40)]
        if i < 620:
            text[20:20] = [hidden(rng.choice(bad), rng) for _ in range(3)]
        rows.append((i, " ".join(text), None, None, None))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert sum(got[i] for i in range(600, 620)) >= 18 and not any(got[i] for i in range(620, 640))
    assert sum(got[i] == t for i, t in labels) >= 590


def test_odd_rows(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (2, 0), (3, 1), (4, None), (9, 0), (None, 1), (5, 7)], "doc_id long, toxic int").withColumn("h", F.lit("own"))
    found = toxicity.score(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (9, 10, 11)}) == 1  # null, empty and blank
    assert all(r["score"] < 1e-9 for r in toxicity.score(docs, labels.limit(0)).collect())
    assert all(r["score"] > 1 - 1e-9 for r in toxicity.score(docs, labels.filter("toxic = 1")).collect())
    assert toxicity.score(no_docs, labels).count() == 0
    table = toxicity.character_model(docs)
    kept = toxicity.restored(docs, table)
    assert kept.columns == docs.columns and kept.count() == len(rows) and kept.filter("text IS NULL").count() == 2
    texts = {r[0]: r[1] for r in rows}
    assert all(r["text"] == texts[r["doc_id"]].lower() for r in kept.filter("doc_id < 6").collect() if not toxicity._HIDDEN.search(texts[r["doc_id"]].lower()))
