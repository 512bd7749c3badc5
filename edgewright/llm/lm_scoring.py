"""LM scoring by a hierarchical Pitman-Yor model, and by an additive baseline over words.

A text is A-Z lower-cased and split into words, with one end after them; to the baseline, words that
training lacks are one type.

The model: what follows a word, anywhere in the corpus, is one Chinese restaurant, and so is what texts
begin with; the customers of all of them are the tokens of the training texts. Their common parent, the
restaurant of the corpus, has their tables as customers, over a base that spells words byte by byte. So
a word is likely if it often followed the word before it, or else if it follows many different words;
a word that training lacks costs its spelling, and each such word is one of its own.

Training seats all customers by Gibbs sampling. A restaurant's tables for a word, of c customers, have
the conditional law S_d(c, t) x ** t, with generalized Stirling numbers S_d and x = d g p: p is the
parent's predictive probability and g, drawn from a Gamma(strength / d + tables), makes the words of a
restaurant independent given it. So all tables are drawn at once, exactly for up to ``EXACT`` customers and
by the law's Gaussian limit above. Discounts and strengths are drawn from their posterior on a grid
after every sweep; while the words' restaurants are seated, the parent stands still. What the seatings
kept, of all chains, give a token after the word before it is averaged; it is what a text's own
restaurants have as their parent. There are one for the text and one for each of its words: they
start empty, take the text's words one by one, with one table for each word of a restaurant, and
have the discounts and strengths of the grid that suit the training texts best.

Texts are read once, into blocks that hold numbers of words. A block sends digests of its different
pairs of words and gets the corpus's counts back; one block that has a pair of two customers or
more in training seats it. Draws are made from a digest of the pair, so that a block that scores the
pair finds the same tables again, and no sweep sends pairs. What sweeps send are numbers of tables, as
arrays, to the parts of the vocabulary: a frequent word is one number a block, however many follow it.
Words are told apart by their characters, pairs by 64 bits.

Defined results: a null or empty text is the end alone; without training texts every count is zero and
all bytes of a spelling are as likely; repeated rows count each time; very long texts are scored whole;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import packed, unpacked

CHAINS, BURN_IN, KEPT, SEED = 2, 1, 2, 42
ADDED = 0.1
#: Bytes of text in a block, for each part of the vocabulary, and for each part of the pairs of words.
BLOCK, PART, PAIRS = 8 << 20, 64 << 20, 16 << 20
#: Contexts of a spelling, and what a context's uniform law counts for.
SPELLED, EVEN = 4096, 4.0
#: Customers up to which tables are drawn from their exact law.
EXACT = 512
#: The logarithm of what doubles of one and more don't change by.
NOTHING = -39.5
#: Words of texts that are scored at once.
SCORED = 1 << 16
#: The grid of discounts and strengths, and where the chains start on it.
DISCOUNTS, STRENGTHS, START = (np.arange(16) + 0.5) / 16, 2.0 ** np.arange(-3, 21), (8, 8)


def lgamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the Gamma function of positive numbers, by Stirling's series."""
    x = np.asarray(x, float)
    small = np.log(np.prod([x + k for k in range(8)], axis=0))
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return np.where(x < 1e6, series - small, (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x))


@lru_cache(64)
def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """The logarithms of S_d(c, t): row c and column t, up to ``most``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore"):
        for c in range(most):
            stay = out[c] + np.log(np.maximum(c - d * t, 0))
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay[1:])
    return out


def draw_tables(c: np.ndarray, x: np.ndarray, d: float, rng: np.random.Generator | None, keys: np.ndarray | None = None) -> np.ndarray:
    """For each cell of c customers, tables from the law S_d(c, t) x ** t, by ``rng`` or by what each
    cell's key says, which gives the same draw wherever it is made."""
    t = np.ones(len(c), np.int64)
    if not len(c):
        return t
    log_s, log_x = stirling(d), np.log(x)
    equal = Places(c)
    order, first = equal.order, equal.first
    for n, a, b in zip(c[order[first]].tolist(), first.tolist(), [*first.tolist()[1:], len(c)], strict=True):
        if n < 2 or n > EXACT:
            continue
        cells, step, log_r = order[a:b], max(64, (1 << 15) // min(n, 64)), log_s[n, 1 : n + 1] - log_s[n, 1]
        small = (log_x[cells] <= 0) | (n <= 100) & (n * log_x[cells] < 300)
        u = rng.random(len(cells)) if keys is None else uniform(keys[cells], 0)
        for some, drawn, by_powers in ((cells[small], u[small], True), (cells[~small], u[~small], False)):
            for i in range(0, len(some), step):
                at = some[i : i + step]
                if by_powers:  # weights past the last that counts are less than a sum of doubles can hold
                    w = np.empty((1 + int(np.flatnonzero(log_r + np.arange(n) * log_x[at].max() > NOTHING)[-1]), len(at)))
                    w[0], w[1:] = 1, x[at]
                    np.cumprod(w, axis=0, out=w)
                    w *= np.exp(log_r[: len(w), None])
                else:
                    w = log_r[:, None] + np.arange(n)[:, None] * log_x[at]
                    np.exp(w - w.max(axis=0), out=w)
                np.cumsum(w, axis=0, out=w)  # a column for each cell
                t[at] = 1 + np.count_nonzero(w < drawn[i : i + step] * w[-1], axis=0)
    many = np.flatnonzero(c > EXACT)
    if len(many):  # tables are a compound Poisson law's, given that their customers sum to c
        n, x = c[many].astype(float), x[many]
        u = np.full(len(n), 0.5)  # u = 1 - z solves x z u ** (d - 1) = c
        low, high = np.full(len(n), 1e-300), np.ones(len(n))
        for _ in range(80):
            u = np.sqrt(low * high)
            big = np.log(x) + np.log1p(-np.minimum(u, 1 - 1e-12)) + (d - 1) * np.log(u) > np.log(n)
            low, high = np.where(big, u, low), np.where(big, high, u)
        mean = x / d * (1 - u**d)
        spread = np.maximum(mean - n / (1 + (1 - u) * (1 - d) / u), 1e-9)
        one_large = spread > 0.9 * mean  # one table holds nearly all, and the others come by chance
        if keys is None:
            chance, noise = rng.poisson(np.minimum(mean, 1e9)), rng.normal(size=len(mean))
        else:
            chance, noise = keyed_poisson(np.minimum(mean, 1e9), keys[many]), normal(keys[many], 0)
        drawn = np.where(one_large, 1 + chance, np.rint(mean + noise * np.sqrt(spread)))
        t[many] = np.clip(drawn, 1, n).astype(np.int64)
    return t


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that look random for each different 64 bits."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def keyed(hashes: np.ndarray, draw: int, chain: int) -> np.ndarray:
    """The keys of a draw's random numbers."""
    return mixed(hashes + np.uint64(xxhash.xxh64_intdigest(b"%d %d" % (draw, chain), SEED)))


def uniform(keys: np.ndarray, nth: int) -> np.ndarray:
    """The ``nth`` number of each key, over 0 and under 1."""
    return ((mixed(keys + np.uint64((nth + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def normal(keys: np.ndarray, nth: int) -> np.ndarray:
    return np.sqrt(-2 * np.log(uniform(keys, nth + 1))) * np.cos(2 * np.pi * uniform(keys, nth + 2))


def keyed_poisson(mean: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Poisson numbers by inversion; from a mean of 64 on, by the normal limit."""
    out = np.maximum(np.rint(mean + np.sqrt(mean) * normal(keys, 2)), 0)
    few = np.flatnonzero(mean < 64)
    u, term = uniform(keys[few], 5), np.exp(-mean[few])
    total, n = term.copy(), np.zeros(len(few))
    for k in range(1, 160):
        n += u > total
        term = term * mean[few] / k
        total += term
    out[few] = n
    return out


def keyed_gamma(shape: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Gamma numbers of shapes of one and more, by Marsaglia and Tsang's rejection."""
    d = shape - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out, left = d.copy(), np.arange(len(shape))
    for k in range(12):  # each round leaves five in a hundred at most
        x = normal(keys[left], 4 * k)
        v = np.maximum(1 + c[left] * x, 1e-30) ** 3
        good = np.log(uniform(keys[left], 4 * k + 3)) < 0.5 * x * x + d[left] * (1 - v + np.log(v))
        out[left[good]] = (d[left] * v)[good]
        left = left[~good]
        if not len(left):
            break
    return out


def log_rising(start: np.ndarray, step: float, n: np.ndarray) -> np.ndarray:
    """The logarithm of start (start + step) ... of n factors."""
    return n * np.log(step) + lgamma(start / step + n) - lgamma(start / step)


def on_grid(log_weights: np.ndarray, rng: np.random.Generator) -> tuple[int, int]:
    w = np.exp(log_weights - log_weights.max()).ravel()
    return tuple(int(i) for i in np.unravel_index(rng.choice(len(w), p=w / w.sum()), log_weights.shape))


def seat_counts(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The sum of log S_d(c, t) over cells of up to EXACT customers, for each discount of the grid."""
    few = (c > 1) & (c <= EXACT)
    times = np.bincount(c[few] * (EXACT + 1) + t[few])
    pairs = np.flatnonzero(times)
    n = times[pairs]
    return np.array([float(n @ stirling(d)[pairs // (EXACT + 1), pairs % (EXACT + 1)]) for d in DISCOUNTS])


# ---------------------------------------------------------------- the base


def _spelt(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The context and symbol of each byte of words and of their ends, and whose they are."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    symbol = np.full(size.sum() + len(words), 256, np.int64)
    inside = np.ones(len(symbol), bool)
    inside[ends] = False
    symbol[inside] = np.frombuffer(b"".join(words), np.uint8)
    of = np.repeat(np.arange(len(words)), size + 1)
    place = np.arange(len(symbol)) - (ends - size)[of]
    one, two = (np.where(place >= k, np.roll(symbol, k), 257) for k in (1, 2))
    return ((two * 1009 + one) % SPELLED) * 257 + symbol, of


class Spelling:
    """The law of words as strings of bytes with an end, each byte after the two before it."""

    def __init__(self, counts: np.ndarray) -> None:
        each = counts.reshape(SPELLED, 257)
        self.logs = np.log((each + EVEN / 257) / (each.sum(axis=1, keepdims=True) + EVEN)).ravel()

    def _logs(self, words: list[bytes]) -> np.ndarray:
        out = [np.zeros(0)]
        for a in range(0, len(words), 1 << 14):
            some = words[a : a + (1 << 14)]
            cell, of = _spelt(some)
            out.append(np.bincount(of, self.logs[cell], minlength=len(some)))
        return np.concatenate(out)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """The probability of each word, no less than what single precision holds."""
        return np.exp(np.maximum(self._logs(words), -80.0))

    def logs10(self, words: list[bytes]) -> np.ndarray:
        """The logarithm of the probability of each word, however long."""
        return self._logs(words) / np.log(10)


def spelling(held: DataFrame) -> Spelling:
    """Counts over the different training words of each block; the table's size is fixed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SPELLED * 257)
        for words, trained in common.rows_of(batches):
            for w, n in zip(words, trained, strict=True):
                some = [x for x, k in zip(words_in(w), unpacked(n, "<i4").tolist(), strict=False) if k]
                total += np.bincount(_spelt(some)[0], minlength=len(total)) if some else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    found = held.select("words", "trained").mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SPELLED * 257)
    counts[np.asarray(found["cell"])] = np.asarray(found["n"])
    return Spelling(counts)


# ---------------------------------------------------------------- blocks of texts


def pairs_of(n: np.ndarray, codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The different (document, word before, word) of texts as one number each, and how often they occur;
    the word before the first is -1."""
    doc, before = np.repeat(np.arange(len(n)), n), np.roll(codes, 1)
    before[(np.cumsum(n) - n)[n > 0]] = -1
    return np.unique((doc * (width + 1) + before + 1) * width + codes, return_counts=True)


def chained(n: np.ndarray, codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token of texts of n words, the end among them: its text, the word before it and itself;
    ``width`` stands for the end and, as a word before, for the start."""
    after = np.insert(codes, np.cumsum(n), width)
    return np.repeat(np.arange(len(n)), n + 1), np.roll(after, 1), after


def digests(words: list[bytes]) -> np.ndarray:
    """A digest of each word, and one for the end, or the start, after them."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, [*words, b" "]), np.uint64, len(words) + 1)


def pair_keys(before: np.ndarray, after: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A digest of each pair of words, from theirs."""
    return mixed(h[before] * np.uint64(0x9E3779B97F4A7C15) + mixed(h)[after])


def context_grid(n: np.ndarray, codes: np.ndarray, width: int, trained: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The logarithmic weights of the grid for the discount and strength of words' restaurants in training
    texts, each pair of words having one table; the end is a word too."""
    pair, times = pairs or pairs_of(n, codes, width)
    of = pair // width
    used = trained[of // (width + 1)]
    of, times = of[used], times[used]
    last = np.where(n > 0, codes[np.maximum(np.cumsum(n) - 1, 0)] if len(codes) else 0, -1)
    of, times = np.concatenate([of, (np.arange(len(n)) * (width + 1) + last + 1)[trained]]), np.concatenate([times, np.ones(int(trained.sum()), np.int64)])
    return one_table_grid(of, times)


def document_grid(n: np.ndarray, codes: np.ndarray, width: int, trained: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The same for the restaurants of training texts, whose customers are the tables of their words'."""
    pair, _ = pairs or pairs_of(n, codes, width)
    cell, times = np.unique(pair // width // (width + 1) * width + pair % width, return_counts=True)
    used = trained[cell // width]
    return one_table_grid(np.concatenate([cell[used] // width, np.flatnonzero(trained)]), np.concatenate([times[used], np.ones(int(trained.sum()), np.int64)]))


def tallied(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of small numbers, and how often each occurs."""
    n = np.bincount(x)
    each = np.flatnonzero(n)
    return each, n[each]


def one_table_grid(of: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The logarithmic weights of the grid for restaurants ``of`` cells, each of so many customers at one table."""
    same = Places(of)
    (many, tables), (each, customers), (cells, held) = (tallied(x) for x in (same.size, np.add.reduceat(times[same.order], same.first) if len(of) else times, times[times > 1]))
    rising = lambda start, x, times: float(times @ lgamma(start + x)) - times.sum() * float(lgamma(np.array(start)))
    of_customers = [rising(a, each, customers) for a in STRENGTHS]
    seats = [float(held @ (lgamma(cells - d) - lgamma(np.array(1 - d)))) if len(cells) else 0.0 for d in DISCOUNTS]
    return np.array([[s + float(tables @ many) * np.log(d) + rising(a / d, many, tables) - x for a, x in zip(STRENGTHS, of_customers, strict=True)] for d, s in zip(DISCOUNTS, seats, strict=True)])


def words_in(row: bytes) -> list[bytes]:
    """The different words of a block."""
    flat = unpacked(row, "u1").tobytes()
    return flat.split(b" ") if flat else []


def _block(number: int, ids: pa.Array, held: np.ndarray, texts: pa.Array, parts: int) -> dict:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    codes, words = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
    doc = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
    real = np.array([w != "" for w in words], bool)
    if not real.all():
        codes, doc = codes[real[codes]], doc[real[codes]]
    part = (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(parts)).astype(np.int64)
    part[~real] = parts
    often = np.bincount(codes, minlength=len(words))
    order = np.lexsort((-often, part))  # by part, frequent words first
    new = np.empty(len(order), np.int64)
    new[order] = np.arange(len(order))
    codes, order = new[codes], order[: int(real.sum())]
    words_of = np.bincount(doc, minlength=len(texts))
    found, sizes = np.unique(part[order], return_counts=True)
    width = max(1, len(order))
    pairs = pairs_of(words_of, codes, width)
    return {
        "block": number, "doc_id": ids.to_pylist(), "held": held.tolist(), "n": packed(words_of.astype(np.int32)), "grids": np.concatenate([f(words_of, codes, width, ~held, pairs).ravel() for f in (document_grid, context_grid)]).tolist(), "codes": packed(codes.astype(np.int32)),
        "words": packed(np.frombuffer(" ".join(map(words.__getitem__, order.tolist())).encode("utf-8", "replace"), np.uint8), 5), "parts": found.tolist(), "sizes": sizes.tolist(), "trained": packed(np.bincount(codes[~held[doc]], minlength=len(order)).astype(np.int32)),
    }


_BLOCK = "block long, doc_id array<long>, held array<boolean>, n binary, grids array<double>, codes binary, words binary, parts array<int>, sizes array<int>, trained binary"


def blocks(docs: DataFrame, parts: int) -> DataFrame:
    """Texts in blocks: numbers of words, and the different words by part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        names = [f.split()[0] for f in _BLOCK.split(", ")]
        kinds = {"block": pa.int64(), "doc_id": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "parts": pa.list_(pa.int32()), "sizes": pa.list_(pa.int32()), "grids": pa.list_(pa.float64())}
        for batch in batches:
            texts = batch.column(2).fill_null("")
            size = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64)) // BLOCK
            for rows in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(size)) + 1) if len(batch) else ():
                some = slice(rows[0], rows[0] + len(rows))
                row = _block(number, batch.column(0)[some], np.asarray(batch.column(1).to_pylist(), bool)[some], texts[some], parts)
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([row[n]], kinds.get(n, pa.binary())) for n in names], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.held_out(10, 0).alias("held"), "text")
    return common.written(rows.mapInArrow(run, _BLOCK), "blocks")


def indexed(x: np.ndarray) -> bytes:
    """An array of few different numbers as these and which of them stands where."""
    values, at = np.unique(x, return_inverse=True)
    head = packed(values)
    return len(head).to_bytes(8, "little") + head + packed(at.astype("<i4"))


def unindexed(data: bytes, dtype: str) -> np.ndarray:
    cut = 8 + int.from_bytes(data[:8], "little")
    return unpacked(data[8:cut], dtype)[unpacked(data[cut:], "<i4")]


# ---------------------------------------------------------------- pairs of words


def in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of numbers from zero on in the order of these, and the numbers there. Numbers sort faster
    than places by number, so a place is put in lower bits."""
    bits = len(keys).bit_length()
    at, mask = np.arange(len(keys)).astype(keys.dtype), (1 << bits) - 1
    if int(keys.max(initial=0)) < 1 << 63 - bits:
        there = np.sort(keys << bits | at)
        return (there & mask).astype(np.int64), there >> bits
    order = (np.sort(keys >> bits << bits | at) & mask).astype(np.int64)
    if (keys[order][1:] < keys[order][:-1]).any():  # the lower bits tell some apart
        order = np.argsort(keys, kind="stable")
    return order, keys[order]


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, a place of each, and which of them stands at each place."""
    order, there = in_order(keys)
    new = np.ones(len(keys), bool)
    new[1:] = there[1:] != there[:-1]
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return there[new], order[new], at


class Pairs:
    """The tokens of a block's texts and its different pairs of words, in the order of their keys."""

    def __init__(self, n: np.ndarray, codes: np.ndarray, words: list[bytes]) -> None:
        self.words, self.width, self.hashes = words, len(words), digests(words)
        self.doc, before, after = chained(n, codes, self.width)
        self.keys, first, self.at = grouped(pair_keys(before, after, self.hashes))
        self.before, self.after = before[first], after[first]


def _pairs(row: pa.Table) -> Pairs:
    n, codes = (unpacked(row[c][0].as_py(), "<i4").astype(np.int64) for c in ("n", "codes"))
    return Pairs(n, codes, words_in(row["words"][0].as_py()))


def pair_counts(held: DataFrame, parts: int) -> DataFrame:
    """For each block and part of the pairs, what the corpus's training texts count of each of the block's
    pairs, doubled, and one more in one of the blocks that have the pair in training."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = pa.Table.from_batches([batch.slice(k, 1)])
                pairs, trained = _pairs(row), ~np.asarray(row["held"][0].as_py(), bool)
                n = np.bincount(pairs.at, trained[pairs.doc], minlength=len(pairs.keys)).astype(np.int64)
                part = ((pairs.keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                found, starts = np.unique(part, return_index=True)
                cuts = list(zip(starts.tolist(), [*starts.tolist()[1:], len(part)], strict=True))
                columns = [found, [batch.column(0)[k].as_py()] * len(cuts), [packed(np.diff(pairs.keys[a:b], prepend=np.uint64(0))) for a, b in cuts], [packed(n[a:b].astype("<i4")) for a, b in cuts]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["slice", "block", "keys", "n"])

    def count(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        keys = [np.cumsum(unpacked(x, "<u8"), dtype=np.uint64) for x in rows["keys"].to_pylist()]
        cuts = np.cumsum([len(x) for x in keys])[:-1]
        at = grouped(np.concatenate(keys))[2]
        n = np.concatenate([unpacked(x, "<i4") for x in rows["n"].to_pylist()]).astype(np.int64)
        c = 2 * np.bincount(at, n).astype(np.int64)[at]
        mine = np.flatnonzero(n)
        c[mine[grouped(at[mine])[1]]] += 1
        return pa.table([rows["slice"], rows["block"], pa.array([packed(x) for x in np.split(c, cuts)], pa.binary())], ["slice", "block", "pairs"])

    sent = held.select("block", "n", "codes", "words", "held").mapInArrow(send, "slice int, block long, keys binary, n binary")
    return common.written(sent.groupBy("slice").applyInArrow(count, "slice int, block long, pairs binary"), "pairs")


def _counts(rows: pa.Table) -> np.ndarray:
    """What the rows of one block's pairs say, in the order of the keys."""
    rows = rows.take(pc.sort_indices(rows["slice"]))
    return np.concatenate([np.zeros(0, np.int64), *(unpacked(x, "<i8") for x in rows["pairs"].to_pylist())])


_SEATS = "block long, width int, sizes array<int>, ends array<long>, tables binary, contexts binary, before binary, after binary, c binary, keys binary, h binary, hashes binary"


def seats(held: DataFrame, pairs: DataFrame, base: Broadcast, path: str) -> DataFrame:
    """What each block seats: the pairs of two customers and more, and how many tables its words, and what
    follows them, have from pairs of one; ``h`` is the base probability of the former's words."""

    def run(row: pa.Table, counts: pa.Table) -> pa.Table:
        if not len(row):
            return pa.table([pa.array([], k) for k in kinds], names)
        mine, c = _pairs(row), _counts(counts)
        once, many = c == 3, np.flatnonzero((c & 1 == 1) & (c > 3))
        words, contexts = (np.bincount(x[once], minlength=mine.width + 1) for x in (mine.after, mine.before))
        each, at = np.unique(mine.after[many], return_inverse=True)
        h = base.value([mine.words[i] if i < mine.width else b"" for i in each.tolist()]) if len(each) else np.zeros(0)
        of_context = mine.hashes[np.unique(mine.before[many])]
        arrays = [words[:-1].astype("<i4"), contexts[:-1].astype("<i4"), mine.before[many].astype("<i4"), mine.after[many].astype("<i4"), c[many] >> 1, mine.keys[many], h[at].astype("<f4"), of_context]
        columns = [[row["block"][0].as_py()], [mine.width], row["sizes"].to_pylist(), [[int(words[-1]), int(contexts[-1])]], *([packed(x)] for x in arrays)]
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    names, kinds = [x.split()[0] for x in _SEATS.split(", ")], [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.binary()] * 8]
    rows = held.select("block", "n", "codes", "words", "sizes")
    return common.rewritten(rows.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(run, _SEATS), path)


# ---------------------------------------------------------------- the corpus restaurant, by parts

#: What a part sends a block about its words: at first, places in the part and counts, later for each
#: chain the customers less discounts and the tables of what follows. Row -1 of a part holds sums over its
#: words and, at first, their base probabilities and counts.
_REPLY = "part int, block long, place binary, c binary, rest array<binary>, tables array<binary>, h binary, sums array<double>"
_NAMES, _KINDS = ["part", "block", "place", "c", "rest", "tables", "h", "sums"], [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.binary(), pa.list_(pa.float64())]
#: Sums of a chain in a part: customers, tables, Stirling numbers by discount, and the words' restaurants.
_GRID = len(DISCOUNTS) * len(STRENGTHS)
_EACH = 2 + len(DISCOUNTS) + _GRID


def lexicon(held: DataFrame, base: Broadcast) -> DataFrame:
    """The first replies: every word's count, and its place in its part."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, parts, sizes, words, trained in common.rows_of(batches):
            for row in zip(numbers, parts, sizes, words, trained, strict=True):
                edges = np.cumsum([0, *row[2]])
                each, n = words_in(row[3]), unpacked(row[4], "<i4")
                cut = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
                columns = [row[1], [row[0]] * len(cut), [b" ".join(each[a:b]) for a, b in cut], [packed(n[a:b]) for a, b in cut]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "block", "words", "n"])

    def count(rows: pa.Table) -> pa.Table:
        each = [w.split(b" ") for w in rows["words"].to_pylist()]
        coded = pa.array([w for words in each for w in words], pa.binary()).dictionary_encode()
        n = [unpacked(x, "<i4") for x in rows["n"].to_pylist()]
        often = np.bincount(np.asarray(coded.indices), np.concatenate([np.zeros(0), *n]), minlength=len(coded.dictionary)).astype(np.int64)
        rank = np.empty(len(often), np.int32)
        rank[np.argsort(-often, kind="stable")] = np.arange(len(often), dtype=np.int32)  # small numbers for frequent words
        h = np.empty(len(often), np.float32)
        h[rank] = base.value(coded.dictionary.to_pylist()) if len(often) else 0
        total = np.empty(len(often), np.int64)
        total[rank] = often
        places = np.split(rank[np.asarray(coded.indices)], np.cumsum([len(w) for w in each])[:-1])
        m = len(places)
        columns = [[rows["part"][0].as_py()] * (m + 1), [*rows["block"].to_pylist(), -1], [*map(packed, places), b""], [*(packed(total[p]) for p in places), packed(total)], [[]] * (m + 1), [[]] * (m + 1), [*[b""] * m, packed(h.astype("<f4"))], [*[[]] * m, [float((total > 0).sum())]]]
        return pa.table([pa.array(x, k) for x, k in zip(columns, _KINDS, strict=True)], _NAMES)

    sent = held.select("block", "parts", "sizes", "words", "trained").mapInArrow(send, "part int, block long, words binary, n binary")
    return common.written(sent.groupBy("part").applyInArrow(count, _REPLY), "lexicon")


def restaurants_grid(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The logarithmic weights of the grid for restaurants of c customers at t tables, but for their cells."""
    (customers, n), (tables, m) = (np.unique(x, return_counts=True) for x in (c, t))
    rising = lambda start, x, times: float(times @ lgamma(start + x)) - times.sum() * float(lgamma(np.array(start)))
    of_customers = [rising(a, customers, n) for a in STRENGTHS]
    return np.array([[float(m @ tables) * np.log(d) + rising(a / d, tables, m) - x for a, x in zip(STRENGTHS, of_customers, strict=True)] for d in DISCOUNTS])


class Chain:
    """The numbers of one chain that all tasks share: grid places, and the parent's totals."""

    def __init__(self, seed: int, end: float, texts: int) -> None:
        """``end`` is the base probability of the end."""
        self.rng, self.base, self.texts = np.random.default_rng([SEED, seed]), end, texts
        self.context, self.corpus = START, START
        self.customers = self.tables = 0.0

    def resume(self, sums: np.ndarray, seated: np.ndarray) -> None:
        """Takes in what blocks and parts have seated, and draws discounts and strengths. What ends texts and
        what they begin with are no words of a part."""
        ends, self.starts = int(seated[0]), int(seated[1])
        end = draw_tables(np.array([ends]), np.array([self.x() * self.base]), self.d(), self.rng)[0] if ends else 0
        self.end = ends - self.d() * end
        self.customers, self.tables = float(sums[0]) + ends, float(sums[1]) + end
        cells = sums[2 : 2 + len(DISCOUNTS)] + seat_counts(np.array([ends]), np.array([int(end)]))
        self.totals = self.customers, self.tables, self.d(), self.strength()  # of the seating that was drawn
        grid = np.array([[s + float(log_rising(np.array([a]), d, np.array([self.tables]))[0] - log_rising(np.array([a]), 1.0, np.array([self.customers]))[0]) for a in STRENGTHS] for s, d in zip(cells, DISCOUNTS, strict=True)])
        if self.customers:
            self.corpus = on_grid(grid, self.rng)
            of_words = sums[2 + len(DISCOUNTS) :].reshape(len(DISCOUNTS), len(STRENGTHS)) + restaurants_grid(np.array([self.texts]), np.array([self.starts]))
            self.context = on_grid(of_words + seated[2:, None], self.rng)

    def d(self) -> float:
        return float(DISCOUNTS[self.corpus[0]])

    def strength(self) -> float:
        return float(STRENGTHS[self.corpus[1]])

    def x(self) -> float:
        """The weight of a new table at the parent, before the base, given a draw of its Gamma variable."""
        return self.d() * float(self.rng.gamma(self.strength() / self.d() + self.tables)) if self.tables else self.d()

    def state(self) -> dict:
        """What a block has to know of the seating besides its words'."""
        return {"totals": self.totals, "end": self.end, "starts": self.starts, "base": self.base, "d": float(DISCOUNTS[self.context[0]]), "strength": float(STRENGTHS[self.context[1]])}


def predictive(rest: np.ndarray, totals: tuple[float, ...], base: np.ndarray | float) -> np.ndarray:
    """The parent's predictive probability of words from their customers less discounts and their base."""
    customers, tables, d, strength = totals
    return (rest + (strength + d * tables) * base) / (customers + strength)


def pair_tables(c: np.ndarray, keys: np.ndarray, before: np.ndarray, p: np.ndarray, tables: np.ndarray, hashes: np.ndarray, state: dict, draw: int, chain: int) -> np.ndarray:
    """A draw of the tables of pairs of c customers: ``p`` is the parent's probability of their words,
    ``tables`` are the tables so far of the restaurants that ``before`` names, ``hashes`` the digests of
    those that it does name, in order."""
    named = np.bincount(before) > 0
    some, at = np.flatnonzero(named), (np.cumsum(named) - 1)[before]
    gamma = keyed_gamma(state["strength"] / state["d"] + np.maximum(tables[some], 1), keyed(hashes, draw, chain))
    return draw_tables(c, state["d"] * gamma[at] * p, state["d"], None, keyed(keys, draw, chain))


def _sums(rows: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size)
    for r in rows.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    return out


def _joined(rows: list[bytes], dtype: str, read: Callable[[bytes, str], np.ndarray] = unpacked) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *(read(x, dtype) for x in rows)])


def sweep(seating: DataFrame, replies: DataFrame, first: DataFrame, chains: list[Chain], draw: int, paths: tuple[str, str]) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Seats the customers of all words' restaurants, then those of the parent; also the sums of parts and of
    blocks. Draw 0 gives each pair one table. ``paths`` take the two tables that a sweep writes."""
    states = [c.state() for c in chains] if draw else [None] * len(chains)

    def seat(row: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(row):
            return pa.table([pa.array([], k) for k in kinds], names)
        answers = answers.take(pc.sort_indices(answers["part"]))
        get = lambda name, kind: unpacked(row[name][0].as_py(), kind)
        m, width, block = len(answers), row["width"][0].as_py(), row["block"][0].as_py()
        before, after, c, keys, h = get("before", "<i4"), get("after", "<i4"), get("c", "<i8"), get("keys", "<u8"), get("h", "<f4")
        once = [np.append(get(x, "<i4"), n).astype(np.int64) for x, n in zip(("tables", "contexts"), row["ends"][0].as_py(), strict=True)]
        cuts = np.cumsum(row["sizes"][0].as_py())[:-1] if m else []
        sent: list[list[list[bytes]]] = []
        sums: list[float] = []
        for k, state in enumerate(states):
            t = np.ones(len(c), np.int64)
            if state is not None:
                rest = np.append(_joined([x[k] for x in answers["rest"].to_pylist()], "<f4", unindexed).astype(float), state["end"])
                sofar = np.append(_joined([x[k] for x in answers["tables"].to_pylist()], "<i4").astype(np.int64), state["starts"])
                p = predictive(rest[after], state["totals"], np.where(after == width, state["base"], h.astype(float)))
                t = pair_tables(c, keys, before, p, sofar, get("hashes", "<u8"), state, draw, k)
            both = [x + np.bincount(at, t, minlength=width + 1).astype(np.int64) for x, at in zip(once, (after, before), strict=True)]
            sums += [float(both[0][-1]), float(both[1][-1]), *seat_counts(c, t)]
            sent.append([[packed(x.astype("<i4")) for x in np.split(b[:-1], cuts)] if m else [] for b in both])
        by_place = [list(zip(*(x[i] for x in sent), strict=True)) for i in (0, 1)]
        columns = [[*answers["part"].to_pylist(), -1], [block] * (m + 1), *([*map(list, x), []] for x in by_place), [*[[]] * m, sums]]
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    names, kinds = ["part", "block", "words", "contexts", "sums"], [pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.float64())]
    answers = replies.filter("block >= 0").select("block", "part", "rest", "tables")
    seated = seating.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(seat, "part int, block long, words array<binary>, contexts array<binary>, sums array<double>")
    seated = common.rewritten(seated, paths[0])
    of_blocks = _sums(seated.filter("part = -1"), len(chains) * (2 + len(DISCOUNTS))).reshape(len(chains), -1)
    discounts, xs = [c.d() for c in chains], [c.x() for c in chains]

    def update(rows: pa.Table, state: pa.Table) -> pa.Table:
        rows, state = (x.take(pc.sort_indices(x["block"])) for x in (rows, state))  # the state's first is of block -1
        places = [unpacked(x, "<i4") for x in state["place"].to_pylist()[1:]]
        at, part, m = np.concatenate([np.zeros(0, np.int32), *places]), rows["part"][0].as_py(), len(places)
        h, customers = unpacked(state["h"][0].as_py(), "<f4").astype(float), unpacked(state["c"][0].as_py(), "<i8")
        words, contexts, sums = rows["words"].to_pylist(), rows["contexts"].to_pylist(), []
        replied: list[list[list[bytes]]] = []
        for k, (d, x) in enumerate(zip(discounts, xs, strict=True)):
            c, tables = (np.bincount(at, _joined([y[k] for y in z], "<i4"), minlength=len(h)).astype(np.int64) for z in (words, contexts))
            seen = np.flatnonzero(c)
            t = draw_tables(c[seen], (x if draw else d * len(h)) * h[seen], d, np.random.default_rng([SEED, draw, k, part]))
            left = c.astype("<f4")
            left[seen] -= (d * t).astype("<f4")
            used = customers > 0
            sums += [float(c.sum()), float(t.sum()), *seat_counts(c[seen], t), *restaurants_grid(customers[used], tables[used]).ravel()]
            replied.append([[indexed(left[p]) for p in places], [packed(tables[p].astype("<i4")) for p in places]])
        by_place = [list(zip(*(x[i] for x in replied), strict=True)) for i in (0, 1)]
        columns = [[part] * (m + 1), [*rows["block"].to_pylist(), -1], *[[b""] * (m + 1)] * 2, *([*map(list, x), []] for x in by_place), [b""] * (m + 1), [*[[]] * m, sums]]
        return pa.table([pa.array(x, k) for x, k in zip(columns, _KINDS, strict=True)], _NAMES)

    state = first.select(F.col("part").alias("of"), "block", "place", "h", F.when(F.col("block") < 0, F.col("c")).alias("c"))
    back = seated.filter("part >= 0").drop("sums").groupBy("part").cogroup(state.groupBy("of")).applyInArrow(update, _REPLY)
    back = common.rewritten(back, paths[1])
    return back, _sums(back.filter("block = -1"), len(chains) * _EACH).reshape(len(chains), -1), of_blocks


def score(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    with common.freed(spark):
        return _score(spark, docs)


def _score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    held = blocks(docs, max(1, -(-size // PART)))
    base = spark.sparkContext.broadcast(spelling(held))  # of fixed size
    first, pairs = lexicon(held, base), pair_counts(held, max(1, -(-size // PAIRS)))
    seats_at, seated_at, unkept_at = (common.place(spark, name) for name in ("seats", "seated", "replies"))
    seating = seats(held, pairs, base, seats_at)
    texts = held.select(F.explode("held").alias("h")).filter("NOT h").count()
    types = _sums(first.filter("block = -1"), 1)[0]
    chains = [Chain(k, float(base.value([b""])[0]), texts) for k in range(CHAINS)]
    replies, kept, said = first, None, []
    for draw in range(BURN_IN + KEPT + 1):
        replies, of_parts, of_blocks = sweep(seating, replies, first, chains, draw, (seated_at, unkept_at if draw < BURN_IN else common.place(spark, "kept")))
        for chain, x, y in zip(chains, of_parts, of_blocks, strict=True):
            used = chain.state() if draw else None  # of the draw: what was known before it
            chain.resume(x, y)
            if draw > BURN_IN:
                said[-1].append((used, chain.state()))
        if draw >= BURN_IN:
            rows = replies.filter("block >= 0").select("block", "part", F.lit(draw - BURN_IN + 1).alias("kind"), "c", "rest", "tables")
            kept = rows if kept is None else kept.union(rows)
            said.append([])
    said.pop()
    for path in (seats_at, seated_at, unkept_at):  # nothing reads them any more
        common.rewritten(spark.createDataFrame([], first.schema), path)
    words = first.filter("block >= 0").select("block", "part", F.lit(0).alias("kind"), "c", "rest", "tables")
    counted = pairs.select("block", F.col("slice").alias("part"), F.lit(-1).alias("kind"), F.col("pairs").alias("c"), F.array().cast("array<binary>").alias("rest"), F.array().cast("array<binary>").alias("tables"))
    answers = words.union(kept).union(counted)
    grids = _sums(held.select(F.col("grids").alias("sums")), 2 * _GRID).reshape(2, _GRID)
    document, context = ((float(DISCOUNTS[i // len(STRENGTHS)]), float(STRENGTHS[i % len(STRENGTHS)])) for i in (grids.argmax(axis=1).tolist() if texts else [START[0] * len(STRENGTHS) + START[1]] * 2))
    names, kinds = ["doc_id", "held_out", "n_words", "n_known", "logs", "score"], [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def rate(row: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(row):
            return pa.table([pa.array([], k) for k in kinds], names)
        n, codes = unpacked(row["n"][0].as_py(), "<i4").astype(np.int64), unpacked(row["codes"][0].as_py(), "<i4").astype(np.int64)
        pairs, answers = _pairs(row), answers.take(pc.sort_indices(answers, [("kind", "ascending"), ("part", "ascending")]))
        of = {k: answers.filter(pc.equal(answers["kind"], k)) for k in range(-1, KEPT + 2)}
        counts = _joined(of[0]["c"].to_pylist(), "<i8")
        c = _joined(of[-1]["c"].to_pylist(), "<i8") >> 1
        customers, many = np.append(counts, texts), np.flatnonzero(c > 1)
        h = base.value(pairs.words) if pairs.width else np.zeros(0)
        q, new = np.zeros(len(c)), np.append(counts == 0, False)
        before, after = pairs.before, pairs.after
        named, of_past = pairs.hashes[np.flatnonzero(np.bincount(before[many]))], customers[before]
        for k in range(CHAINS):
            rest, tables = ([_joined([x[k] for x in of[i][name].to_pylist()], dtype, read) for i in range(1, KEPT + 2)] for name, dtype, read in (("rest", "<f4", unindexed), ("tables", "<i4", unpacked)))
            for i, each in enumerate(said):
                used, state = each[k]
                p = predictive(np.append(rest[i].astype(float), used["end"])[after[many]], used["totals"], np.append(h.astype("<f4").astype(float), used["base"])[after[many]])
                t = np.minimum(c, 1)
                t[many] = pair_tables(c[many], pairs.keys[many], before[many], p, np.append(tables[i].astype(np.int64), used["starts"]), named, used, BURN_IN + 1 + i, k)
                p = predictive(np.append(rest[i + 1].astype(float), state["end"]), state["totals"], np.append(h, state["base"]))
                p[new] = predictive(np.array(0.0), state["totals"], 1.0)  # before its spelling
                d, strength = used["d"], used["strength"]
                share = strength + d * np.append(tables[i + 1].astype(np.int64), state["starts"])
                q += (c - d * t + share[before] * p[after]) / (of_past + strength) / (len(said) * CHAINS)
        logs_q = np.log10(np.maximum(q, 1e-300))
        unseen = np.flatnonzero(counts == 0)
        if len(unseen):
            spelt = np.zeros(pairs.width + 1)
            spelt[unseen] = base.value.logs10([pairs.words[i] for i in unseen.tolist()])
            logs_q += spelt[after]
        logs, known = logs_of(n, codes, np.log10(counts + ADDED)), logs_of(n, codes, (counts > 0).astype(float))
        each, ends = logs_q[pairs.at], np.cumsum(n + 1) - 1
        got = text_scores(n, codes, np.delete(each, ends), 10.0 ** each[ends], document, context)
        return pa.table([pa.array(row["doc_id"][0].as_py(), pa.int64()), pa.array(row["held"][0].as_py(), pa.bool_()), pa.array(n), pa.array(np.rint(known).astype(np.int64)), pa.array(logs), pa.array(got)], names)

    rated = held.select("block", "doc_id", "held", "n", "codes", "words").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(rate, "doc_id long, held_out boolean, n_words long, n_known long, logs double, score double")
    tokens = int(held.select(F.inline(F.arrays_zip("held", "doc_id"))).filter("NOT held").count()) + _trained(held)
    n_tokens = F.col("n_words") + 1
    different = int(types) + (texts > 0)
    base_score = F.col("logs") + F.lit(float(np.log10(texts + ADDED))) - n_tokens * F.lit(float(np.log10(tokens + ADDED * (different + 1))))
    return rated.select("doc_id", "held_out", n_tokens.alias("n_tokens"), (F.col("n_known") + int(texts > 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base_score.alias("base_score"), "score")


def _trained(held: DataFrame) -> int:
    """The words of all training texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (trained,) in common.rows_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([int(unpacked(x, "<i4").sum()) for x in trained], pa.int64())], ["n"])

    return held.select("trained").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def logs_of(n: np.ndarray, codes: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The sum of a value of words over each text, added up in the order of the words."""
    return np.bincount(np.repeat(np.arange(len(n)), n), value[codes], minlength=len(n))


class Places:
    """The places of equal keys, in order."""

    def __init__(self, keys: np.ndarray) -> None:
        self.order, there = in_order(keys)
        new = np.ones(len(keys), bool)
        new[1:] = there[1:] != there[:-1]
        self.first = np.flatnonzero(new)
        self.size = np.diff(self.first, append=len(keys))

    def before(self, mark: np.ndarray | None = None) -> np.ndarray:
        """For each place, how many places before it, with ``mark`` if given, have the same key."""
        count = np.ones(len(self.order), np.int64) if mark is None else mark[self.order].astype(np.int64)
        up = np.cumsum(count) - count
        out = np.empty(len(self.order), np.int64)
        out[self.order] = up - np.repeat(up[self.first], self.size)
        return out


def text_scores(n: np.ndarray, types: np.ndarray, log_p: np.ndarray, p_end: float | np.ndarray, document: tuple[float, float], context: tuple[float, float]) -> np.ndarray:
    """The log10 probability of texts of n words: each word given those before it, then the end.

    ``log_p`` and ``p_end`` have what the corpus's seating gives each word and the end, given the word
    before, ``document`` and ``context`` the discounts and strengths of a text's own restaurant and of
    those of its words."""
    starts, p_end = np.cumsum([0, *n]), np.broadcast_to(p_end, len(n))
    cuts = [0, *(np.flatnonzero(np.diff(starts[1:] // SCORED)) + 1).tolist(), len(n)]
    some = [(slice(a, b), slice(starts[a], starts[b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return np.concatenate([_some_scores(n[r], types[w], log_p[w], p_end[r], document, context) for r, w in some])


def _some_scores(n: np.ndarray, types: np.ndarray, log_p: np.ndarray, p_end: np.ndarray, document: tuple[float, float], context: tuple[float, float]) -> np.ndarray:
    ends = np.cumsum(n)
    doc = np.repeat(np.arange(len(n)), n + 1)
    width = int(types.max(initial=0)) + 2
    types, log_p = np.insert(types, ends, width - 1), np.insert(log_p, ends, np.log10(p_end))
    past = np.roll(types, 1)
    past[ends - n + np.arange(len(n))] = width - 1  # nothing before: no word ever follows the end
    after = doc * width + past
    again = Places(after * width + types).before()
    new = again == 0  # a customer of the document's restaurant
    word = Places(doc * width + types).before(new)
    of_doc, of_past = Places(doc), Places(after)
    guests, dishes = of_doc.before(new), of_doc.before(new & (word == 0))
    (d, a), (e, b) = document, context
    p = 10.0 ** np.maximum(log_p, -280)
    of_document = (np.where(word > 0, word - d, 0) + (a + d * dishes) * p) / (guests + a)
    plain = np.log10(np.where(word > 0, 1.0, (a + d * dishes) / (guests + a))) + log_p  # of a word the text lacks so far
    all_after = of_past.before()
    share = (b + e * of_past.before(new)) / (all_after + b)
    logs = np.where(word + again > 0, np.log10(np.where(again > 0, again - e, 0) / (all_after + b) + share * of_document), np.log10(share) + plain)
    return np.bincount(doc, logs, minlength=len(n))


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, tokens, perplexity, base_perplexity) of scored texts, a token."""
    rate = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), rate("score").alias("perplexity"), rate("base_score").alias("base_perplexity"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores, learnt from nine tenths of them."""
    return score(common.table(spark, sf_dir, "documents"))
