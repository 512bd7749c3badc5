"""Windows of fixed length that occur more than once in a corpus: what two operators share.

A text is a row of units (words or bytes). Every window of ``size`` units has a minimiser: the least
hash among its grams of ``gram`` units. Equal windows have equal minimisers, so consecutive windows
with one minimiser travel together, as one string (a super-k-mer), to the minimiser's bucket.

Only minimisers that occur at least twice can belong to repeated windows; ``find`` sends the strings
of those alone. In a bucket, windows are sorted by a hash of their content and equal neighbours are
compared unit by unit. A minimiser of more than ``hot`` strings would make a large bucket; its windows
are dealt out one by one by a 128-bit digest instead, and counted with partial sums before the
shuffle: there the digest alone tells windows apart, so two different ones would have to share 128
bits to be taken for equal. Texts meet what was found about them by a join on their id and hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Units handled at once, and the most windows in a string, as a share of the window.
CHUNK, CUT = 1 << 17, 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POSITION = np.uint64(0xFFFF)
WHO = ["id", "text_hash"]


@dataclass(frozen=True)
class Units:
    """How a text is cut into units, and the windows that count."""

    size: int
    gram: int
    split: Callable[[bytes], list[bytes] | bytes]
    hashes: Callable[[list[bytes] | bytes], np.ndarray]
    join: bytes
    hot: int = 10_000


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)


_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([i])) for i in range(256)], np.uint64)


def hash_bytes(text: bytes) -> np.ndarray:
    return _BYTE[np.frombuffer(text, np.uint8)]


def _powers(base: np.uint64, n: int, known: dict = {}) -> np.ndarray:  # noqa: B006
    if len(known.get(base, ())) < n:
        steps = np.full(max(n, 4 * CHUNK), base, np.uint64)
        steps[0] = 1
        known[base] = np.cumprod(steps)
    return known[base][:n]


def gram_hashes(units: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of ``length`` units, from prefix sums modulo 2 ** 64."""
    n = len(units) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * _powers(_ODD, len(units)), out=sums[1:])
    h = (sums[length:] - sums[:n]) * _powers(_ODD_INVERSE, n)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def _least(units: np.ndarray, ends: np.ndarray, u: Units) -> Iterator[tuple[np.ndarray, ...]]:
    """Chunks of windows that lie in one text: where each starts, the hash and place of its least gram
    (the first of equal ones), and whether it has that gram twice. ``ends`` are where texts end."""
    for a in range(0, len(units) - u.size + 1, CHUNK):
        part = units[a : a + CHUNK + u.size - 1]
        h = gram_hashes(part, u.gram)
        at = np.arange(len(h), dtype=np.uint64) & _POSITION
        grams = u.size - u.gram + 1
        first = _sliding_least(h & ~_POSITION | at, grams)
        last = _sliding_least(h & ~_POSITION | _POSITION - at, grams)
        start = np.arange(len(first)) + a
        inside = np.flatnonzero(start + u.size <= ends[np.searchsorted(ends, start, "right")])
        if not len(inside):
            continue
        twice = (first[inside] & _POSITION) != (_POSITION - (last[inside] & _POSITION))
        place = inside + (((first[inside] & _POSITION).astype(np.int64) - inside) & 0xFFFF)
        yield inside + a, first[inside] >> np.uint64(16), place + a, twice


def runs(units: np.ndarray, ends: np.ndarray, u: Units) -> tuple[np.ndarray, ...]:
    """Runs of windows that share a minimiser: first window, how many, minimiser, whether it occurs
    twice in the run."""
    out: list[tuple[np.ndarray, ...]] = []
    for start, key, place, twice in _least(units, ends, u):
        new = np.ones(len(start), bool)
        new[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)
        begin = np.flatnonzero(new)
        within = np.arange(len(start)) - np.repeat(begin, np.diff([*begin, len(start)]))
        begin = np.flatnonzero(within % (CUT * u.size) == 0)
        n = np.diff([*begin, len(start)])
        twice |= place != np.repeat(place[begin], n)  # in two windows of the run, though in none twice
        out.append((start[begin], n, key[begin].astype(np.int64), np.logical_or.reduceat(twice, begin)))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def anchors(units: np.ndarray, ends: np.ndarray, u: Units) -> tuple[np.ndarray, np.ndarray]:
    """The different places of windows' minimisers, in order, and their hashes."""
    found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, key, place, _ in _least(units, ends, u):
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1]
        found[0].append(place[new])
        found[1].append(key[new].astype(np.int64))
    place, key = (np.concatenate(x) for x in found)
    place, first = np.unique(place, return_index=True)
    return place, key[first]


#: Stands for a null ``doc_id``.
_NO_ID = -(1 << 63)


def identified(docs: DataFrame) -> DataFrame:
    """The UTF-8 text with what tells rows apart: the id and a hash of the text.

    Both joins with what is found read these columns and no others, so they share one shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(text.cast("binary").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("text_hash"))


def with_spans(base: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text and spans of every row of ``base``."""
    doc_id = F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id")
    return base.join(found, WHO, "left").select(doc_id, "text", "spans")


def chunks(texts: list[bytes], u: Units) -> Iterator[tuple[int, list, list | bytes, np.ndarray, np.ndarray]]:
    """Texts in groups of about CHUNK units: the first one's place, each one's units, then all units,
    their hashes and where texts end among them."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        held.append(u.split(text))
        size += len(held[-1])
        if size >= CHUNK or i == len(texts) - 1:
            ends = np.cumsum([len(x) for x in held])
            flat = b"".join(held) if isinstance(held[0], bytes) else [w for x in held for w in x]
            yield first, held, flat, u.hashes(flat), ends
            held, size, first = [], 0, i + 1


def minimisers(base: DataFrame, u: Units) -> DataFrame:
    """(key, id, text_hash) for every run of windows, twice where its minimiser is in it twice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (np.asarray(batch.column(c)) for c in (1, 2))
            for first, _, _, units, ends in chunks(batch.column(0).to_pylist(), u):
                start, _, key, twice = runs(units, ends, u)
                row = first + np.searchsorted(ends, start, "right")
                again = np.repeat(np.arange(len(key)), 1 + twice)
                yield pa.RecordBatch.from_arrays([pa.array(key[again]), pa.array(ids[row[again]]), pa.array(hashes[row[again]])], ["key", *WHO])

    return base.select("text", *WHO).mapInArrow(run, ", ".join(f"{c} long" for c in ("key", *WHO)))


def repeated_keys(keys: DataFrame) -> DataFrame:
    """(key, n) of the minimisers that occur at least twice."""
    return common.written(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "repeated")


def _slices(strings: list[bytes], u: Units) -> Callable[[int, int], bytes]:
    """The window at an offset of a string, as bytes."""
    if not u.join:
        return lambda row, at: strings[row][at : at + u.size]
    edges: dict[int, list[int]] = {}

    def window(row: int, at: int) -> bytes:
        if row not in edges:
            edges[row] = [0, *(np.flatnonzero(np.frombuffer(strings[row], np.uint8) == u.join[0]) + 1).tolist(), len(strings[row]) + 1]
        return strings[row][edges[row][at] : edges[row][at + u.size] - 1]

    return window


def repeated_in(strings: list[bytes], u: Units) -> list[np.ndarray]:
    """For each string, the offsets of its windows that another window among the strings equals."""
    split = [x if not u.join else x.split(u.join) for x in strings]
    flat = b"".join(split) if not u.join else [w for x in split for w in x]
    lengths = np.array([len(x) for x in split])
    h = gram_hashes(u.hashes(flat), u.size)
    starts = np.cumsum(lengths) - lengths
    n = np.maximum(lengths - u.size + 1, 0)
    row = np.repeat(np.arange(len(strings)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    h = h[starts[row] + at]
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    left, right = order[same], order[same + 1]
    names: dict[bytes, int] = {}
    name = np.array([names.setdefault(s, len(names)) for s in strings])
    unsure = np.flatnonzero((name[row[left]] != name[row[right]]) | (at[left] != at[right]))
    window = _slices(strings, u)
    flagged = np.zeros(len(row), bool)
    flagged[left] = flagged[right] = True
    wrong = [k for k, a, b, c, d in zip(unsure.tolist(), row[left[unsure]].tolist(), at[left[unsure]].tolist(), row[right[unsure]].tolist(), at[right[unsure]].tolist(), strict=True) if window(a, b) != window(c, d)]
    for value in {int(h[left[k]]) for k in wrong}:  # different windows of one hash: count these by content
        seen: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(h == np.uint64(value)).tolist():
            seen.setdefault(window(int(row[i]), int(at[i])), []).append(i)
        for places in seen.values():
            flagged[places] = len(places) > 1
    return [at[(a := slice(e - k, e))][flagged[a]] for e, k in zip(np.cumsum(n).tolist(), n.tolist(), strict=True)]


def _strings(found: DataFrame, u: Units, hot: bool) -> DataFrame:
    """The runs of windows whose minimiser is in ``keys``: as strings, or window by window if hot."""
    fields = "key long, id long, text_hash long, start long, " + ("low long, high long" if hot else "string binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(3)
            ids, hashes = (np.asarray(batch.column(c)) for c in (1, 2))
            for first, held, _, units, ends in chunks(batch.column(0).to_pylist(), u):
                start, n, key, _ = runs(units, ends, u)
                row = np.searchsorted(ends, start, "right")
                begin = start - (ends[row] - np.array([len(x) for x in held])[row])
                keep = np.zeros(len(key), bool)
                cuts = np.searchsorted(row, np.arange(len(held) + 1))
                for i in range(len(held)):
                    part = slice(cuts[i], cuts[i + 1])
                    keep[part] = np.isin(key[part], np.asarray(wanted[first + i].values))
                row, begin, n, key = row[keep], begin[keep], n[keep], key[keep]
                if hot:
                    again = np.repeat(np.arange(len(key)), n)
                    offset = begin[again] + np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
                    row, key = row[again], key[again]
                    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(u.join.join(held[r][a : a + u.size]) if u.join else held[r][a : a + u.size]) for r, a in zip(row.tolist(), offset.tolist(), strict=True)), np.int64).reshape(-1, 2)
                    more = [pa.array(offset.astype(np.int64)), pa.array(digests[:, 0]), pa.array(digests[:, 1])]
                else:
                    text = [held[r][a : a + k + u.size - 1] for r, a, k in zip(row.tolist(), begin.tolist(), n.tolist(), strict=True)]
                    more = [pa.array(begin.astype(np.int64)), pa.array([u.join.join(x) if u.join else x for x in text], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[first + row]), pa.array(hashes[first + row]), *more], [f.split()[0] for f in fields.split(", ")])

    return found.select("text", *WHO, "keys").mapInArrow(run, fields)


def _count_strings(strings: DataFrame, u: Units) -> DataFrame:
    """(id, text_hash, start, n): runs of n repeated windows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(rows: pa.RecordBatch) -> pa.RecordBatch:
            flagged = repeated_in(rows.column(4).to_pylist(), u)
            row, at, n = [], [], []
            for i, offsets in enumerate(flagged):
                if len(offsets):
                    cut = np.flatnonzero(np.diff(offsets) > 1) + 1
                    begin = offsets[np.concatenate([[0], cut])]
                    row += [i] * len(begin)
                    at += begin.tolist()
                    n += np.diff(np.concatenate([[0], cut, [len(offsets)]])).tolist()
            row = np.array(row, np.int64)
            ids, hashes, starts = (np.asarray(rows.column(c))[row] for c in (1, 2, 3))
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hashes), pa.array(starts + np.array(at, np.int64)), pa.array(np.array(n, np.int64))], [*WHO, "start", "n"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = np.asarray(batch.column(0))
            last = np.flatnonzero(keys != keys[-1])
            cut = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on in the next batch
            if cut or (held and held[-1].column(0)[0].as_py() != keys[0]):
                yield counted(pa.concat_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield counted(pa.concat_batches(held))

    return strings.repartition("key").sortWithinPartitions("key").mapInArrow(run, "id long, text_hash long, start long, n long")


def keys_of_texts(keys: DataFrame, repeated: DataFrame) -> DataFrame:
    return keys.join(repeated.select("key"), "key").groupBy(*WHO).agg(F.collect_set("key").alias("keys"))


def find(base: DataFrame, keys: DataFrame, repeated: DataFrame, u: Units) -> DataFrame:
    """(id, text_hash, spans) with spans the (start, n) of runs of repeated windows, for the texts
    that have some. ``keys`` are the minimisers of texts, ``repeated`` those that occur twice."""
    wanted = common.written(keys_of_texts(keys, repeated.filter(F.col("n") <= u.hot)), "wanted")
    spans = _count_strings(_strings(base.join(wanted, WHO), u, False), u)
    hot = repeated.filter(F.col("n") > u.hot)
    if hot.limit(1).count():
        single = common.written(_strings(base.join(keys_of_texts(keys, hot), WHO), u, True).drop("key"), "windows")
        many = common.written(single.groupBy("low", "high").agg(F.count("*").alias("times")).filter("times > 1").drop("times"), "counted")
        spans = spans.union(single.join(many, ["low", "high"]).select(*WHO, "start", F.lit(1).cast("long").alias("n")))
    return spans.groupBy(*WHO).agg(F.collect_set(F.struct("start", "n")).alias("spans"))


def covered(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """The maximal runs of units, as (from, to), that windows cover."""
    out: list[list[int]] = []
    for a, n in sorted((s["start"], s["n"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n - 1 + size)
        else:
            out.append([a, a + n - 1 + size])
    return [(a, b) for a, b in out]
