"""Language ID by string kernels: Nystroem landmarks and one-versus-rest kernel ridge regression.

The kernel of two texts is the number of different character n-grams, of 1 to 3 symbols, that both
hold (a blended-spectrum presence kernel), over the root of the product of either's own number. A
text's symbols are its lower-cased characters, of any script; white space counts as one. N-grams are
numbered by a hash of ``BITS`` bits, so that no alphabet is listed: few share a number.

A bounded sample of labelled texts gives the landmarks W and the ridge regression over their
Nystroem features; folded together these are one coefficient for each landmark and language. Whole
texts are then scored in batches: a presence matrix times the landmarks' presence matrix gives the
kernel values, and these times the coefficients give the scores. The model is broadcast; its size
is bounded by the parameters, not by the data.

Scores of all languages sum to one, so the best can't tell that a text is in none of them. What can
is the share of a text's n-grams that some landmark holds: ``keep_confident`` asks for most of what
labelled texts reach.

Defined results: a null text, or one without a letter, is ``und`` with score 0; equal scores go to
the first language in code-point order; without labelled texts everything is ``und``; repeated rows
get equal results; very long texts are scored whole, though the training sample takes none over
``LONGEST`` characters, ``SAMPLE_BYTES`` in all at most, and the ``SAMPLE // 20`` most frequent languages; other columns are kept by ``keep_confident`` and ignored otherwise.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The bound on the training sample: texts in all and for each language, and characters of each.
SAMPLE, SAMPLE_EACH, LONGEST, SAMPLE_BYTES = 12_000, 600, 20_000, 64 << 20
LANDMARKS, RIDGE, BITS, BATCH = 160, 1e-3, 21, 64
#: A document stays in the pipeline if the share of its n-grams that landmarks know reaches SLACK times
#: what all labelled texts but this share of them reach, each landmark without itself.
SLACK, STRANGE = 0.7, 0.01
_SPACE = np.array([chr(c).isspace() for c in range(0x3101)])


@dataclass(frozen=True)
class Model:
    languages: list[str]
    grams: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    least_known: float


class Kernel:
    """Maps texts to their different n-grams, each by its number; holds what a task reuses."""

    def __init__(self) -> None:
        self.last = np.zeros(1 << BITS, np.int32)

    def grams(self, text: str) -> np.ndarray:
        """The different n-grams of a text, each by its number."""
        s = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
        s = np.where(_SPACE[np.minimum(s, 0x3100)], np.uint32(32), s) * np.uint32(0x9E3779B1)
        pairs = (s[:-1] ^ s[:-1] >> np.uint32(15)) * np.uint32(0x85EBCA77) + s[1:]
        triples = (pairs[:-1] ^ pairs[:-1] >> np.uint32(13)) * np.uint32(0xC2B2AE3D) + s[2:]
        ids = np.concatenate([s ^ np.uint32(0x27D4EB2F), pairs ^ np.uint32(0x165667B1), triples])
        ids = (ids ^ ids >> np.uint32(16)) * np.uint32(0x7FEB352D)
        ids = ((ids ^ ids >> np.uint32(15)) * np.uint32(0x846CA68B) >> np.uint32(32 - BITS)).astype(np.int32)
        order = np.arange(len(ids), dtype=np.int32)
        self.last[ids] = order
        return ids[self.last[ids] == order]

    def place(self, grams: np.ndarray) -> np.ndarray:
        """The column of each n-gram that the landmarks know; their number for all others."""
        at = np.full(len(self.last), len(grams), np.int32)
        at[grams] = np.arange(len(grams))
        return at


def presence(texts: list[str], kernel: Kernel, column: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' presence rows over the landmarks' n-grams, and how many different ones each has."""
    rows, own = np.zeros((len(texts), width + 1), np.float32), np.ones(len(texts), np.float32)
    for i, text in enumerate(texts):
        g = kernel.grams(text)
        own[i] = max(1, len(g))
        rows[i, column[g]] = 1
    return rows[:, :width], own


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """The model from labelled texts; as many landmarks from each language as its turn gives."""
    names = sorted(set(languages))
    kernel = Kernel()
    each = {n: [i for i, x in enumerate(languages) if x == n] for n in names}
    turns = sorted((rank, names.index(n), i) for n in names for rank, i in enumerate(each[n]))
    chosen = [i for _, _, i in turns[:landmarks]]
    held = [kernel.grams(texts[i]) for i in chosen]
    grams = np.unique(np.concatenate([*held, np.zeros(0, np.int32)]))
    column = kernel.place(grams)
    marks = np.zeros((len(grams), len(chosen)), np.float32)
    for j, g in enumerate(held):
        marks[column[g], j] = 1 / np.sqrt(len(g) or 1)
    landmark, by_others = np.isin(np.arange(len(texts)), chosen), ((marks > 0).sum(axis=1) > 1).astype(np.float32)
    k, known = np.zeros((len(texts), len(chosen))), np.zeros(len(texts))
    for a in range(0, len(texts), BATCH):
        rows, own = presence(texts[a : a + BATCH], kernel, column, len(grams))
        k[a : a + BATCH] = rows @ marks / np.sqrt(own)[:, None]
        known[a : a + BATCH] = np.where(landmark[a : a + BATCH], rows @ by_others, rows.sum(axis=1)) / own
    value, vector = np.linalg.eigh(k[chosen])
    good = value > 1e-8 * value.max(initial=1e-12)
    half = vector[:, good] / np.sqrt(value[good])
    features, y = k @ half, np.array([[x == n for n in names] for x in languages], float)
    mean, y_mean = features.mean(axis=0), y.mean(axis=0)
    f = features - mean
    beta = np.linalg.solve(f.T @ f + ridge * len(texts) * np.eye(f.shape[1]), f.T @ (y - y_mean))
    return Model(names, grams, marks, (half @ beta).astype(np.float32), (y_mean - mean @ beta).astype(np.float32), SLACK * float(np.quantile(known, STRANGE)))


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.kernel = model, Kernel()
        self.column = self.kernel.place(model.grams)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """The language of each text, its score, and the share of the text's n-grams that are known."""
        m = self.model
        names, scores, known = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        real = [i for i, t in enumerate(texts) if t and m.languages and any(map(str.isalpha, t))]
        for a in range(0, len(real), BATCH):
            some = real[a : a + BATCH]
            rows, own = presence([texts[i] for i in some], self.kernel, self.column, len(m.grams))
            got = (rows @ m.landmarks / np.sqrt(own)[:, None]) @ m.weights + m.bias
            for i, top, score, share in zip(some, got.argmax(axis=1).tolist(), got.max(axis=1).tolist(), (rows.sum(axis=1) / own).tolist(), strict=True):
                names[i], scores[i], known[i] = m.languages[top], min(1.0, max(0.0, score)), share
        return names, scores, known


def train(docs: DataFrame) -> Model:
    """The model from the documents whose CRC-32 of the id, modulo 3, isn't 1, and that have a lang.

    The sample holds the least hashes of different texts for each language."""
    short = F.length("text") <= LONGEST
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & short & ~common.held_out(3, 1)).select("lang", "text")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE // 20).collect()}
    if not counts:
        return Model([], np.zeros(0, np.int32), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32), 0.0)
    each = min(SAMPLE_EACH, SAMPLE // len(counts))
    share = F.create_map(*[F.lit(x) for n, c in counts.items() for x in (n, min(1.0, 1.5 * each / c))])
    h = F.xxhash64("text")
    near = rows.withColumn("h", h).filter(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    order = [F.pmod("h", F.lit(1 << 20)), "h", "lang"]
    sizes = near.groupBy("lang", "h").agg(F.min(F.octet_length("text")).alias("size"))
    wanted, taken, room = [], Counter(), SAMPLE_BYTES
    for row in sizes.orderBy(*order).limit(2 * SAMPLE).collect():
        if taken[row["lang"]] < each and row["size"] <= room:
            taken[row["lang"]] += 1
            room -= row["size"]
            wanted.append((row["lang"], row["h"]))
    chosen = docs.sparkSession.createDataFrame(wanted, "lang string, h long")
    sample = near.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))  # SAMPLE rows at most
    rows = sample.orderBy(*order).collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; predictions see the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for ids, held, texts in common.rows_of(batches):
            names, scores, _ = scorer(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.held_out(3, 1).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_confident(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language the model tells and knows."""
    sent, where = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            names, _, known = scorer(batch.column(where).to_pylist())
            yield batch.filter(pc.and_(pc.not_equal(pa.array(names, pa.string()), "und"), pc.greater_equal(pa.array(known, pa.float64()), sent.value.least_known)))

    return docs.mapInArrow(run, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
