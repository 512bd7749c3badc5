"""Toxicity: noisy-channel deobfuscation, then a linear score of the restored text.

A word may be hidden by look-alike symbols (``1d10t``), by spacing (``c l o w n``, ``c.l.o.w.n``) or by
repetition (``stuuupid``). What could be hidden is a lattice: a look-alike stands for one of its
letters or for itself, a separator between single characters is dropped or kept, a run of one
character is taken as it is or as one or two. Viterbi decoding finds the way through the lattice of
the best product of the channel's costs and a character language model, whose n-grams of up to
``ORDER`` characters are counted over the words of all documents. Plain words have one way only and
are never decoded.

A text's features are its restored words and their character n-grams, each present or not, numbered by a
hash. A logistic regression over those that speak for label 1, each scaled by its log odds and with a
weight of zero or more, so that a long harmless text hides nothing, is fitted on a bounded sample of labelled texts, as many of each label, and its intercept moved to the share that the
labels have among all labelled texts. Labels join hashes and not texts. Then every whole text is scored.

Defined results: a null or empty text has no feature, and the score of the model's intercept; without
texts of both labels every score is 0, or 1 if all labels are; a document labelled several times counts
as its highest label; labels other than 0 and 1 are ignored; repeated texts are one text of the sample,
with their highest label; rows without an id are scored; very long texts are scored whole, though the
sample takes none over ``LONGEST`` bytes; an empty table gives an empty result; ``restored`` keeps other columns, and they are ignored otherwise.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Order of the character model, bits of its table, and the customers that back-off counts for.
ORDER, MODEL_BITS, BACK_OFF = 4, 19, 4.0
#: Bits of a feature's number, and characters of its n-grams.
BITS, GRAM = 20, 5
#: The bound on the labelled sample: different texts of each label, and bytes of each.
SAMPLE, LONGEST = 6_000, 40_000
#: Texts of the sample that a feature is in at least, and its least log odds; ridge; steps of the fit and their size.
SEEN, ODDS, RIDGE, STEPS, RATE = 3, 0.5, 0.02, 200, 0.05
#: Bytes of text taken together, and words that a worker remembers.
GROUP, REMEMBERED = 12 << 20, 500_000
#: The letters that a symbol looks like.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "*": "aeiou"}
#: What may stand between the single characters of a word.
SEPARATORS = " .-_~'*"
#: Costs, in natural logarithms: of a look-alike, of one kept as itself, of a dropped separator, of a kept one, and of
#: a run that stands for fewer characters, and for each of its characters.
LOOK, KEPT, DROPPED, BREAK, RUN, EACH = 1.5, 4.0, 0.7, 0.7, 2.0, 0.1
_SYMBOLS = re.escape("".join(x for x in LOOKS if x != "*"))
_LETTER = r"[^\W\d_]"
_LAST = _SYMBOLS.replace("!", "").replace(re.escape("|"), "")
_HIDDEN = re.compile(rf"{_LETTER}[{_SYMBOLS}*]+{_LETTER}|(?<![^\W_])[{_SYMBOLS}]+{_LETTER}(?:{_LETTER}|[{_LAST}])|{_LETTER}{{2}}[{_LAST}]+(?!\w)|({_LETTER})\1\1|(?<!\w){_LETTER}(?:[._~'*-]+{_LETTER}){{2,}}(?!\w)")
_SPACED = re.compile(rf"(?<!\S)[\w{_SYMBOLS}](?: [\w{_SYMBOLS}]){{2,}}(?!\S)")
_WORD = re.compile(f"{_LETTER}+")
_END = "\n"


# ---------------------------------------------------------------- the character model


def _mixed(x: np.ndarray, bits: int) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ x >> np.uint64(32)) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - bits)).astype(np.int64)


def _places(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table's places of n-grams, rows of code points, and of the contexts before their last ones."""
    h = np.full(len(grams), grams.shape[1], np.uint64)
    for column in grams.T[:-1]:
        h = h * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64) + np.uint64(1)
    return _mixed(h * np.uint64(0x9E3779B97F4A7C15) + grams.T[-1].astype(np.uint64) + np.uint64(1), MODEL_BITS), _mixed(h ^ np.uint64(0xD6E8FEB86659FD93), MODEL_BITS)


def character_counts(words: list[str], times: np.ndarray) -> np.ndarray:
    """The table of n-gram and context counts of words, each as often as it occurs."""
    out = np.zeros(1 << MODEL_BITS)
    pad = _END * (ORDER - 1)
    s = np.frombuffer(pad.join(f"{w}{_END}" for w in ["", *words]).encode("utf-32-le", "replace"), "<u4")
    size = np.array([len(w) + ORDER for w in words])
    at = np.arange(1, 1 + size.sum())
    weight = np.repeat(times, size).astype(float)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) >= ORDER - 1
    at, weight = at[inside], weight[inside]
    for order in range(1, ORDER + 1):
        for place in _places(np.stack([s[at - k] for k in range(order - 1, -1, -1)], axis=1)):
            out += np.bincount(place, weight, minlength=len(out))
    return out


class CharacterModel:
    """Costs, minus natural logarithms, of a character after those before it in a word."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        self.cost = lru_cache(1 << 18)(self._cost)

    def _cost(self, before: str, c: str) -> float:
        codes = [ord(x) for x in before + c]
        p = 1e-4
        for order in range(1, ORDER + 1):
            n, total = (self.table[place[0]] for place in _places(np.array([codes[len(codes) - order :]])))
            p = (min(n, total) + BACK_OFF * p) / (total + BACK_OFF)
        return -math.log(p)


# ---------------------------------------------------------------- the channel


def _ways(c: str, run: int, alone: bool) -> list[tuple[str, float]]:
    """What a run of one observed character may stand for, and its cost; _END parts words."""
    if c.isalpha():
        literal = [(c * run, 0.0)]
        return literal + [(c * k, RUN + EACH * run) for k in (1, 2) if k < run]
    ways = [(_END, KEPT if c in LOOKS and c != "*" else BREAK if c in SEPARATORS else 0.0)]
    if c in LOOKS:
        ways += [(x * k, LOOK + EACH * run) for x in LOOKS[c] for k in (1, 2) if k <= run]
    if c in SEPARATORS and alone:
        ways.append(("", DROPPED))
    return ways


def decoded(hidden: str, model: CharacterModel) -> str:
    """The likeliest words, with spaces between them, that ``hidden`` (in lower case) stands for."""
    runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", hidden, re.S)]
    start = _END * (ORDER - 1)
    states: dict[str, tuple[float, tuple | None]] = {start: (0.0, None)}
    for i, (c, run) in enumerate([*runs, (_END, 1)]):
        alone = (i < 2 or not runs[i - 2][0].isalnum()) or (i + 2 >= len(runs) or not runs[i + 2][0].isalnum())
        ways = _ways(c, run, alone) if i < len(runs) else [(_END, 0.0)]
        after: dict[str, tuple[float, tuple | None]] = {}
        for state, (cost, path) in states.items():
            for emitted, price in ways:
                total, s = cost + price, state
                if emitted == _END:
                    if s != start:
                        total, s = total + model.cost(s, _END), start
                else:
                    for x in emitted:
                        total += model.cost(s, x)
                        s = (s + x)[1:]
                if s not in after or total < after[s][0]:
                    after[s] = total, (path, emitted)
        states = after
    path, out = states[start][1], []
    while path:
        out.append(path[1])
        path = path[0]
    return " ".join("".join(reversed(out)).replace(_END, " ").split())


class Restorer:
    """Restores texts; remembers what hidden words stand for."""

    def __init__(self, model: CharacterModel) -> None:
        self.model, self.known = model, {}

    def word(self, hidden: str) -> str:
        if hidden not in self.known:
            if len(self.known) > REMEMBERED:
                self.known = {}
            self.known[hidden] = decoded(hidden, self.model)
        return self.known[hidden]

    def spaced(self, text: str) -> str:
        """A lower-cased text with its runs of single characters restored."""
        return _SPACED.sub(lambda m: self.word(m[0]), text)

    def token(self, token: str) -> str:
        """A lower-cased token between white space, restored."""
        return self.word(token) if _HIDDEN.search(token) else token

    def __call__(self, text: str) -> str:
        return re.sub(r"\S+", lambda m: self.token(m[0]), self.spaced(text.lower()))


def _groups(texts: pa.Array) -> Iterator[pa.Array]:
    texts = pc.utf8_lower(texts.fill_null(""))
    size = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64)) // GROUP
    for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(size)) + 1) if len(texts) else ():
        yield texts.slice(rows[0], len(rows))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The text and code of each token between white space, and the different tokens."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    return np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets))), np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()


def character_model(docs: DataFrame) -> np.ndarray:
    """The table of the character model over the plain words of all texts; its size is fixed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << MODEL_BITS)
        for batch in batches:
            for texts in _groups(batch.column(0)):
                _, codes, names = _tokens(texts)
                times = np.bincount(codes, minlength=len(names))
                words, n = [], []
                for name, k in zip(names, times.tolist(), strict=True):
                    if name.isalpha():
                        words.append(name)
                        n.append(k)
                    elif not _HIDDEN.search(name):
                        some = _WORD.findall(name)
                        words += some
                        n += [k] * len(some)
                if words:
                    table += character_counts(words, np.array(n))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], ["place", "n"])

    found = docs.select("text").mapInArrow(run, "place int, n double").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # a row a place
    table = np.zeros(1 << MODEL_BITS)
    table[np.asarray(found["place"])] = np.asarray(found["n"])
    return table


def restored(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """``docs`` with texts lower-cased and restored."""
    sent, where = docs.sparkSession.sparkContext.broadcast(table), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(CharacterModel(sent.value))
        for batch in batches:
            texts = pa.array([None if t is None else restore(t) for t in batch.column(where).to_pylist()], batch.column(where).type)
            yield batch.set_column(where, batch.schema.field(where), texts)

    return docs.mapInArrow(run, docs.schema)


# ---------------------------------------------------------------- features


class Features:
    """The features of texts: numbers of the restored words and of their n-grams, remembered by token."""

    def __init__(self, model: CharacterModel, only: np.ndarray | None = None) -> None:
        """``only`` tells for each number whether it is wanted."""
        self.restore, self.only = Restorer(model), only
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.first, self.numbers = np.zeros(2, np.int64), np.zeros(0, np.int64)

    def _learn(self, tokens: list[str]) -> None:
        words, of = [], []
        for i, token in enumerate(tokens):
            some = [token] if token.isalpha() and not _HIDDEN.search(token) else _WORD.findall(self.restore.token(token))
            words += some
            of += [i] * len(some)
        at = np.array(of, np.int64)
        numbers = _mixed(np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in words], np.uint64) * np.uint64(0x9E3779B97F4A7C15), BITS)
        s = np.frombuffer("".join(f"{_END}{w}{_END}" for w in words).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        size = np.array([len(w) + 2 for w in words], np.int64)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(s))
        begin = np.flatnonzero(left >= GRAM)
        h = np.zeros(len(begin), np.uint64)
        for k in range(GRAM):
            h = h * np.uint64(0x100000001B3) + s[begin + k] + np.uint64(7)
        at, numbers = np.concatenate([at, np.repeat(at, size)[begin]]), np.concatenate([numbers, _mixed(h, BITS)])
        if self.only is not None:
            wanted = self.only[numbers]
            at, numbers = at[wanted], numbers[wanted]
        order = np.argsort(at, kind="stable")
        n = len(self.first) - 1
        self.known.update(zip(tokens, range(n, n + len(tokens)), strict=True))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(at, minlength=len(tokens)))])
        self.numbers = np.concatenate([self.numbers, numbers[order]])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of lower-cased texts: how many features each has, and the features, ascending."""
        if len(self.known) > REMEMBERED:
            self._forget()
        spaced = np.flatnonzero(pc.match_substring_regex(texts, r"(^|\s)\S( \S){2,}(\s|$)"))
        if len(spaced):
            each = texts.to_pylist()
            for i in spaced.tolist():
                each[i] = self.restore.spaced(each[i])
            texts = pa.array(each, pa.string())
        of, codes, names = _tokens(texts)
        if new := [t for t in names if t not in self.known]:
            self._learn(new)
        codes = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[codes]
        some = self.first[codes + 1] > self.first[codes]
        cell = np.unique(of[some] * len(self.first) + codes[some])
        of, codes = cell // len(self.first), cell % len(self.first)
        n = self.first[codes + 1] - self.first[codes]
        rows = np.arange(n.sum()) + np.repeat(self.first[codes] - (np.cumsum(n) - n), n)
        both = np.unique(np.repeat(of, n) << BITS | self.numbers[rows])
        return np.bincount(both >> BITS, minlength=len(texts)), both & (1 << BITS) - 1


# ---------------------------------------------------------------- the classifier


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def __call__(self, n: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        z = np.bincount(np.repeat(np.arange(len(n)), n), self.weights[numbers], minlength=len(n)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(n: np.ndarray, numbers: np.ndarray, toxic: np.ndarray, odds: float | None = None) -> Model:
    """Logistic regression over features scaled by their log odds; ``odds`` of label 1 where the texts aren't in proportion."""
    none = np.zeros(1 << BITS)
    positive, negative = int(toxic.sum()), int(len(toxic) - toxic.sum())
    if not positive or not negative:
        share = positive / max(1, len(toxic))
        return Model(none, 500.0 if share else -500.0)
    of = np.repeat(np.arange(len(n), dtype=np.int32), n)
    held = np.bincount(numbers, minlength=1 << BITS)
    with_label = np.bincount(numbers[toxic[of] == 1], minlength=1 << BITS)
    scale = np.log((with_label + 1) / (positive + 2)) - np.log((held - with_label + 1) / (negative + 2))
    use = np.flatnonzero((held >= SEEN) & (scale >= ODDS))
    column = np.full(1 << BITS, -1, np.int32)
    column[use] = np.arange(len(use))
    good = column[numbers] >= 0
    of, at = of[good], column[numbers[good]]
    x, y = scale[use].astype(np.float32)[at], toxic.astype(float)
    w, bias = np.zeros(len(use)), math.log(positive / negative)
    mean, square = np.zeros(len(use) + 1), np.zeros(len(use) + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(of, x * w[at], minlength=len(n)) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        gradient = np.append(np.bincount(at, x * error[of], minlength=len(use)) + RIDGE * w, error.sum())
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8) * (1 - step / (STEPS + 1))
        w, bias = np.maximum(w - move[:-1], 0), bias - move[-1]
    weights = none
    weights[use] = w * scale[use]
    return Model(weights, float(bias) + (math.log(odds * negative / positive) if odds else 0.0))


def train(docs: DataFrame, labels: DataFrame, table: np.ndarray) -> Model:
    """The model from labelled documents that aren't held out: of each label, the texts of least hashes."""
    spark = docs.sparkSession
    marks = labels.filter("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumnRenamed("doc_id", "of")
    short = docs.filter(~common.held_out(5, 0) & (F.octet_length("text") <= LONGEST)).select("doc_id", F.xxhash64("text").alias("h"), "text")
    known = common.written(short.select("doc_id", "h").join(marks, F.col("doc_id") == F.col("of")).groupBy("h").agg(F.max("toxic").alias("toxic")), "labelled")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    wanted = [(r["h"], r["toxic"]) for label in (0, 1) for r in known.filter(F.col("toxic") == label).orderBy("h").limit(SAMPLE).collect()]
    chosen = F.broadcast(spark.createDataFrame(wanted, "of long, toxic int"))  # 2 * SAMPLE rows at most
    texts = short.join(chosen, F.col("h") == F.col("of")).groupBy("h", "toxic").agg(F.min("text").alias("text"))
    sent = spark.sparkContext.broadcast(table)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take = Features(CharacterModel(sent.value))
        for batch in batches:
            at = 0
            for some in _groups(batch.column(2)):
                n, numbers = take(some)
                each = [common.packed(x.astype("<i4")) for x in np.split(numbers, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), batch.column(1).slice(at, len(some)), pa.array(each, pa.binary())], ["h", "toxic", "features"])
                at += len(some)

    rows = texts.mapInArrow(run, "h long, toxic int, features binary").orderBy("h").toArrow()
    each = [common.unpacked(x, "<i4") for x in rows["features"].to_pylist()]
    odds = counts[1] / counts[0] if len(counts) == 2 else None
    return fit(np.array([len(x) for x in each], np.int64), np.concatenate([*each, np.zeros(0, np.int32)]), np.asarray(rows["toxic"]).astype(np.int64), odds)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; a score sees the text alone."""
    table = character_model(docs)
    sent = docs.sparkSession.sparkContext.broadcast((table, train(docs, labels, table)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, model = sent.value
        take = Features(CharacterModel(table), model.weights > 0)
        for batch in batches:
            scores = np.concatenate([*(model(*take(some)) for some in _groups(batch.column(2))), np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.held_out(5, 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
