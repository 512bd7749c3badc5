"""Packing by cutting-stock column generation.

Documents become token ids with an end id. A document is cut every ``LENGTH`` tokens; full pieces
are sequences of their own, and the rest are packed. Their lengths, rounded up to ``WIDTH``, give a
histogram of bounded size whatever the data; only that reaches the driver. A linear program over
patterns (how many pieces of each class a sequence holds) covers it with the fewest sequences: the
simplex method keeps as many patterns as there are classes, and a knapsack dynamic program finds
the pattern that pays most at the current prices, until none pays. Pattern counts are rounded down
and what is left is packed by greedy patterns.

The pieces of a class are ranked: within small buckets by their id, and each bucket starts where the
buckets before it end. A broadcast table of bounded size then turns class and rank into a sequence
and a place in it. No class meets in one task, and no row is joined by its ``doc_id``.

Defined results: a null or empty text is one piece with the end id alone; repeated rows, and rows
that share an id, are packed each for itself; very long texts are cut like others; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common

TOKENIZER, END = "word_bpe_49k.json", 1
LENGTH, WIDTH = 2048, 16
#: Pieces of a rank bucket, on average; words that a worker remembers; bytes of text split at a time.
BUCKET, REMEMBERED, GROUP = 4096, 500_000, 4 << 20
#: The program stops within a sequence, or this share, of a lower bound, or after so many steps;
#: its patterns cover the histogram after any number of them.
GAP, STEPS = 5e-4, 2_000

#: White space beyond ASCII's, and what may count as such: texts that hold some are tokenized whole.
_OTHER_SPACE = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200b\u2028-\u202f\u205f\u3000\ufeff]"
#: What ends the last token of a word in the vocabulary (a fixed value of TOKENIZER).
_WORD_END = "</w>"
#: A plain word and what may follow it: two to the tokenizer, and each the same wherever it stands.
_PLAIN = re.compile("([a-zß-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)")


def gathered(ids: np.ndarray, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words in a row, and where each word's end; a word's are at first[word]:first[word + 1]."""
    n = first[words + 1] - first[words]
    ends = np.cumsum(n)
    return ids[np.arange(n.sum()) + np.repeat(first[words] - (ends - n), n)], ends


class Encoder:
    """Token ids of texts: the different words of a group of texts are looked up once, and ids are
    taken from one flat array by the words' numbers. A word is tokenized once, unless forgotten."""

    def __init__(self, path: str, end: int = END) -> None:
        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(_WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        """Word 0 is the end id and word 1 has none; others are numbered in ``known``."""
        self.known: dict[str, int] = {"": 1}
        self.ids, self.first = np.array([self.end], "<u4"), np.array([0, 1, 1])

    def _add(self, ids: np.ndarray, ends: np.ndarray) -> range:
        """Takes new words in, and gives their numbers."""
        n = len(self.first) - 1
        self.first = np.concatenate([self.first, self.first[-1] + ends])
        self.ids = np.concatenate([self.ids, ids])
        return range(n, n + len(ends))

    def _tokenized(self, texts: list[str]) -> range:
        ids = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return self._add(np.concatenate(ids), np.cumsum([len(x) for x in ids]))

    def _learn(self, words: list[str]) -> None:
        """Plain words go through the tokenizer together, and are told apart by the ends of words."""
        plain, pairs, other = {"": 0}, [], []
        took = []
        for w in words:
            if m := _PLAIN.fullmatch(w.lower()):
                pairs += [plain.setdefault(x, len(plain)) for x in m.groups()]
                took.append(w)
            else:
                other.append(w)
        if took:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([*plain][1:])], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(plain) - 1:
                ids, ends = gathered(ids, np.array([0, 0, *stops.tolist()]), np.array(pairs))
                self.known.update(zip(took, self._add(ids, ends[1::2]), strict=True))
            else:
                other = words
        if other:
            self.known.update(zip(other, self._tokenized(other), strict=True))

    def __call__(self, texts: pa.Array) -> Iterator[list[np.ndarray]]:
        """The ids of each text, the end id last, for groups of texts."""
        texts = texts.fill_null("")
        size = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64)) // GROUP
        for some in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(size)) + 1) if len(texts) else ():
            yield self._group(texts.slice(some[0], len(some)))

    def _group(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self._forget()
        odd = np.flatnonzero(pc.match_substring_regex(texts, _OTHER_SPACE))
        if len(odd):
            whole = texts.take(pa.array(odd)).to_pylist()
            texts = pc.if_else(pc.match_substring_regex(texts, _OTHER_SPACE), "", texts)
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        different = words.dictionary.to_pylist()
        if new := [w for w in different if w not in self.known]:
            self._learn(new)
        numbers = np.fromiter(map(self.known.__getitem__, different), np.int64, len(different))[np.asarray(words.indices)]
        last = np.asarray(lists.offsets)[1:] - lists.offsets[0].as_py()
        known = len(self.first), len(self.ids)
        at, more = last, np.zeros(len(last), np.int64)
        if len(odd):  # such a text is a word of its own, in front of its end id; it isn't remembered
            at, more = np.concatenate([last[odd], last]), np.concatenate([np.array(self._tokenized(whole)), more])
        ids, ends = gathered(self.ids, self.first, np.insert(numbers, at, more))
        self.first, self.ids = self.first[: known[0]], self.ids[: known[1]]
        here = last + np.arange(len(last)) + np.searchsorted(odd, np.arange(len(last)), "right")
        return np.split(ids, ends[here][:-1])


@lru_cache(1)
def encoder(path: str, end: int) -> Encoder:
    return Encoder(path, end)


def tokenized(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, doc_tokens and the CRC-32 of each piece's ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end)
        for batch in batches:
            n, crcs = [], []
            for group in encode(batch.column(1)):
                n += map(len, group)
                crcs += [[zlib.crc32(ids[a : a + length]) for a in range(0, len(ids), length)] for ids in group]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "doc_tokens", "crcs"])

    docs = common.id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>")


def best_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The knapsack program: the counts of each size, within ``room``, that are worth most."""
    worth, took = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        n = np.searchsorted(sizes, c, "right")
        got = worth[c - sizes[:n]] + prices[:n]
        worth[c], took[c] = worth[c - 1], -1
        if n and (j := got.argmax()) is not None and got[j] > worth[c]:
            worth[c], took[c] = got[j], j
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return float(worth[room]), pattern


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan, free of threads that would wait for Spark's."""
    n = len(matrix)
    rows = np.hstack([matrix, np.eye(n)])
    for c in range(n):
        top = c + int(np.abs(rows[c:, c]).argmax())
        rows[[c, top]] = rows[[top, c]]
        rows[c] /= rows[c, c]
        factor = rows[:, c].copy()
        factor[c] = 0
        rows -= factor[:, None] * rows[c]
    return rows[:, n:]


def generate_columns(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[int, np.ndarray]]:
    """(times, pattern) that hold exactly ``demand`` pieces of each size; sizes ascend, within ``room``."""
    m = len(sizes)
    columns = np.diag(room // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns)) if m else columns
    used = inverse @ demand
    least = float(sizes @ demand) / room  # and by prices that pay any pattern one at most
    for step in range(STEPS if m else 0):
        prices = inverse.sum(axis=0)
        value, pattern = best_pattern(prices, sizes, room)
        least = max(least, float(prices @ demand) / value)
        if value <= 1 + 1e-9 or used.sum() <= least + max(1, GAP * least):
            break
        direction = inverse @ pattern
        ratio = np.where(direction > 1e-9, used / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = pattern
        if step % 128 == 127:
            inverse = _inverse(columns)
        else:
            row = inverse[out] / direction[out]
            inverse = inverse - np.outer(direction, row)
            inverse[out] = row
        used = np.maximum(inverse @ demand, 0)
    found, left = [], demand.astype(np.int64).copy()
    for k in range(m):
        pattern = columns[:, k].astype(np.int64)
        held = pattern > 0
        times = min(int(used[k] + 1e-9), int((left[held] // pattern[held]).min()))
        if times:
            found.append((times, pattern))
            left -= times * pattern
    while left.any():  # what rounding left: the largest that still fit, again and again
        pattern, free = np.zeros(m, np.int64), room
        for j in reversed(range(m)):
            pattern[j] = min(left[j], free // sizes[j])
            free -= pattern[j] * sizes[j]
        held = pattern > 0
        times = int((left[held] // pattern[held]).min())
        found.append((times, pattern))
        left -= times * pattern
    return found


def _placement(counts: dict[int, int], room: int) -> tuple[list[tuple[int, ...]], int]:
    """Rows (class, first rank, past rank, each, first sequence, first place), and how many sequences."""
    classes = np.array(sorted(counts), np.int64)
    rows, sequence = [], 0
    ranked = dict.fromkeys(counts, 0)
    for times, pattern in generate_columns(classes, np.array([counts[c] for c in classes], np.int64), room):
        place = 0
        for j in np.flatnonzero(pattern)[::-1]:
            c, each = int(classes[j]), int(pattern[j])
            rows.append((c, ranked[c], ranked[c] + times * each, each, sequence, place))
            ranked[c] += times * each
            place += each
        sequence += times
    return rows, sequence


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, width: int = WIDTH) -> DataFrame:
    """Every piece with its sequence and offset."""
    spark = docs.sparkSession
    tokens = common.written(tokenized(docs, path or public_tokenizers.path(TOKENIZER), length), "tokens")
    buckets = max(1, tokens.count() // BUCKET)
    pieces = tokens.select("doc_id", "doc_tokens", F.posexplode("crcs").alias("piece", "ids_crc32")).withColumn("start", F.col("piece").cast("long") * length)
    pieces = pieces.withColumn("length", F.least(F.lit(length), F.col("doc_tokens") - F.col("start")).cast("long"))
    kind = F.when(F.col("length") == length, 0).otherwise(F.ceil(F.col("length") / width)).cast("int")
    pieces = pieces.select("*", kind.alias("class"), F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(buckets)).alias("bucket"))
    in_bucket = Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = common.written(pieces.groupBy("class", "bucket").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))), "buckets")
    counts = {r["class"]: r["n"] for r in sizes.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    full = counts.pop(0, 0)
    rows, rest = _placement(counts, length // width)
    rows.append((0, 0, full, 1, rest, 0))
    table = spark.createDataFrame(rows, "of int, low long, high long, each long, sequence long, place long")
    ranked = pieces.withColumn("in_bucket", F.row_number().over(in_bucket) - 1).join(sizes.drop("n"), ["class", "bucket"]).withColumn("rank", F.col("ahead") + F.col("in_bucket"))
    placed = ranked.join(F.broadcast(table), (F.col("class") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    k = F.col("rank") - F.col("low")
    placed = placed.withColumn("sequence_id", F.expr("sequence + (rank - low) div each")).withColumn("place", F.col("place") + k % F.col("each"))
    ahead = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, packed."""
    return pack(common.table(spark, sf_dir, "documents"))
