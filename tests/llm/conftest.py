"""Small tables with odd rows: nulls, empty texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(7)
    shared = words(rng, 90)
    texts = [words(rng, 60) for _ in range(6)] + [words(rng, 20) + " " + shared + " " + words(rng, 15), shared + " tail", "la " * 300, None, "", "   ", "x", shared[:399], "word " * 40 + words(rng, 50), "Zürich ist schön " * 40]
    texts += [texts[0]] * 3 + [texts[1] + " end"]
    out = [(i, t, ["en", "de", None][i % 3], "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return out + [out[0], (None, texts[2], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Odd rows, in a table with columns that operators also use as names."""
    from pyspark.sql import functions as F

    clash = {c: F.lit("own") for c in ("spans", "keys", "key", "id", "fp", "score", "block", "label", "component", "words", "start")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(clash)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def as_key(x):
    return tuple((v is not None, v) if not isinstance(v, (list, dict)) else (True, repr(v)) for v in x)


def ordered(xs):
    return sorted((tuple(x) for x in xs), key=as_key)
