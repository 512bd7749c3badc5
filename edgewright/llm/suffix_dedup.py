"""Suffix-array dedup with a logarithmic family of indexes.

Every byte covered by a 400-byte string that also starts anywhere else is removed. Suffix arrays of
every position take more than eight bytes for each byte of text, and more to sort, so these are
sparse: they hold the suffixes that start at minimisers, the least hash among a 400-byte window's
128-byte grams. Equal windows hold an equal minimiser at an equal place, so two of them always have
two such suffixes that agree on 128 bytes.

A new batch of documents gets a suffix array: its suffixes, dealt to parts, in the order of their
first sixteen bytes and then of a hash of the first 128; those that agree on all that are one row. It is
merge-scanned against the arrays of the levels that exist; suffixes that agree with another's are
matches. Then it becomes a level itself, and while the last two levels are of equal rank they merge
into one of the next: a suffix is rewritten only as often as the logarithm of the number of batches,
and an index can go on growing (``Family.add``).

What matches is extended in suffix arrays of its own, by content. The suffixes of a matching
minimiser are sorted by the 400 bytes that follow, and by the 272 that precede, read backwards; the
common prefixes of neighbours tell for any length which suffixes agree on it. A window that starts
some bytes before a suffix is repeated if another suffix is in its class on both sides. So windows
are compared byte by byte, and a group needs two sorts, not one for each window.

Minimisers of more than ``hot`` suffixes are first told apart by a 128-bit digest of the 672 bytes,
summed before the shuffle, and then split by half of the window, left or right, that the suffixes
must agree on; copies of a passage are one row there. Only there a digest stands for content.

Defined results: a null or empty text, or one of fewer than 400 bytes, loses nothing; repeated rows
and copies lose every byte that a window covers, the first copy too; a text that repeats itself
counts as well; very long texts are read whole; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, windows

WINDOW, GRAM = 400, 128
#: Batches that the query's documents arrive in, and suffixes whose arrays are made at once.
BATCHES, GROUPED = 2, 1 << 14
_ORDER = ["lead", "more", "key"]
UNITS = windows.Units(WINDOW, GRAM, bytes, windows.hash_bytes, b"", hot=40_000)


def leads(text: bytes, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the next eight bytes of the suffixes at ``places``, as longs in the order of the bytes."""
    padded = np.frombuffer(text + bytes(16), np.uint8)
    each = np.ascontiguousarray(padded[places[:, None] + np.arange(16)]).view(">u8").astype(np.uint64) ^ np.uint64(1 << 63)
    return each[:, 0].astype(np.int64), each[:, 1].astype(np.int64)


def suffixes(base: DataFrame, u: windows.Units) -> DataFrame:
    """(lead, more, key, id, text_hash, n) of the suffixes that start at minimisers; n is 2 where a text
    has a minimiser more than once."""
    names = [*_ORDER, *windows.WHO, "n"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (np.asarray(batch.column(c)) for c in (1, 2))
            for first, _, flat, units, ends in windows.chunks(batch.column(0).to_pylist(), u):
                place, key = windows.anchors(units, ends, u)
                row = np.searchsorted(ends, place, "right")
                order = np.lexsort((key, row))
                new = np.ones(len(order), bool)
                new[1:] = (row[order][1:] != row[order][:-1]) | (key[order][1:] != key[order][:-1])
                n = np.minimum(np.diff([*np.flatnonzero(new), len(order)]), 2)
                one = order[new]
                row = first + row[one]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*leads(flat, place[one]), key[one], ids[row], hashes[row], n.astype(np.int64))], names)

    return base.select("text", *windows.WHO).mapInArrow(run, ", ".join(f"{c} long" for c in names))


class Family:
    """Suffix arrays (lead, more, key, n) in levels of geometrically growing rank."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self.matches: list[DataFrame] = []

    @staticmethod
    def _sorted(rows: DataFrame, name: str) -> DataFrame:
        return common.written(rows.groupBy(*_ORDER).agg(F.sum("n").alias("n")).sortWithinPartitions(*_ORDER), name)

    def add(self, suffixes: DataFrame) -> None:
        """Takes in a batch's suffixes (lead, more, key, n, ...), and notes which match any others."""
        new = self._sorted(suffixes.select(*_ORDER, "n"), "suffixes")
        self.matches.append(new.filter("n > 1").select(*_ORDER))
        for rank, level in self.levels:
            self.matches.append(common.written(new.select(*_ORDER).hint("merge").join(level.select(*_ORDER), _ORDER), f"matches-{rank}"))
        self.levels.append((0, new))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, self._sorted(a.union(b), f"level-{rank + 1}")))

    def matching(self) -> DataFrame:
        """(lead, more, key, n) of all suffixes that match others, with how many agree."""
        found, rows = self.matches[0], self.levels[0][1]
        for more in self.matches[1:]:
            found = found.union(more)
        for _, level in self.levels[1:]:
            rows = rows.union(level)
        return rows.join(found.distinct(), _ORDER, "left_semi").groupBy(*_ORDER).agg(F.sum("n").alias("n"))


def _classes(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A suffix array of the rows of a matrix of bytes, within groups: the order, and how many bytes each
    has in common with the one before it, -1 for the first of a group."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    common_bytes = np.full(len(rows), -1)
    same = group[order][1:] == group[order][:-1]
    for a in range(1, len(rows), 1 << 14):
        b = min(len(rows), a + (1 << 14))
        differ = rows[order[a:b]] != rows[order[a - 1 : b - 1]]
        common_bytes[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    common_bytes[1:][~same] = -1
    return order, common_bytes


def repeated_windows(texts: list[bytes], left: np.ndarray, group: np.ndarray, times: np.ndarray, u: windows.Units, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether the window that starts so many bytes before each suffix is repeated: a row for each
    suffix, a column for 0 to size - gram bytes. A text holds ``left`` bytes before the suffix and up to
    ``size`` after; ``times`` is how often it occurs, and only windows from ``low`` to ``high`` count."""
    n, reach = len(texts), u.size - u.gram
    before, after = np.zeros((n, reach), np.uint8), np.zeros((n, u.size), np.uint8)
    right = np.array([len(t) for t in texts]) - left
    for i, (t, k) in enumerate(zip(texts, left.tolist(), strict=True)):
        held = np.frombuffer(t, np.uint8)
        before[i, :k] = held[:k][::-1]
        after[i, : len(t) - k] = held[k:]
    (by_left, same_left), (by_right, same_right) = _classes(before, group), _classes(after, group)
    out, of_left, of_right = np.zeros((n, reach + 1), bool), np.empty(n, np.int64), np.empty(n, np.int64)
    for back in range(reach + 1):
        fits = np.flatnonzero((left >= back) & (right >= u.size - back) & (low <= back) & (back <= high))
        if not len(fits):
            continue
        of_left[by_left], of_right[by_right] = np.cumsum(same_left < back), np.cumsum(same_right < u.size - back)
        _, which = np.unique(of_left[fits] * (n + 1) + of_right[fits], return_inverse=True)
        out[fits, back] = (np.bincount(which, times[fits])[which] > 1) if len(fits) else False
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true values in rows: the row, the first column and the past-last one."""
    padded = np.zeros((len(flags), flags.shape[1] + 2), np.int8)
    padded[:, 1:-1] = flags
    row, first = np.nonzero(np.diff(padded, axis=1) == 1)
    return row, first, np.nonzero(np.diff(padded, axis=1) == -1)[1]


def _around(found: DataFrame, u: windows.Units) -> DataFrame:
    """The suffixes whose minimiser is in ``keys``: (key, id, text_hash, left, context, places); those of
    a text that agree on all bytes around, as in a text that goes on repeating itself, are one row."""
    names = ["key", *windows.WHO, "left", "context", "places"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(3)
            ids, hashes = (np.asarray(batch.column(c)) for c in (1, 2))
            for first, held, _, units, ends in windows.chunks(batch.column(0).to_pylist(), u):
                place, key = windows.anchors(units, ends, u)
                row = np.searchsorted(ends, place, "right")
                keep = np.zeros(len(key), bool)
                cuts = np.searchsorted(row, np.arange(len(held) + 1))
                for i in range(len(held)):
                    part = slice(cuts[i], cuts[i + 1])
                    keep[part] = np.isin(key[part], np.asarray(wanted[first + i].values))
                row, key, place = row[keep], key[keep], place[keep]
                place = place - (ends[row] - np.array([len(x) for x in held], np.int64)[row])
                left = np.minimum(place, u.size - u.gram)
                places: dict[tuple, list[int]] = {}
                for r, k, p, before in zip(row.tolist(), key.tolist(), place.tolist(), left.tolist(), strict=True):
                    places.setdefault((r, k, before, held[r][p - before : p + u.size]), []).append(p)
                r, k, before, context = zip(*places, strict=True) if places else ([], [], [], [])
                r = first + np.array(r, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(ids[r]), pa.array(hashes[r]), pa.array(before, pa.int32()), pa.array(context, pa.binary()), pa.array(places.values(), pa.list_(pa.int64()))], names)

    return found.select("text", *windows.WHO, "keys").mapInArrow(run, "key long, id long, text_hash long, left int, context binary, places array<long>")


def _extended(rows: DataFrame, u: windows.Units, by: list[str], keep: list[str]) -> DataFrame:
    """(*keep, back, n) of runs of repeated windows: n of them, the last one ``back`` bytes before the
    suffix. Rows are (*by, *keep, left, context, times,
    low, high); a task takes whole groups of equal ``by`` together."""
    names = [*keep, "back", "n"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: pa.RecordBatch) -> pa.RecordBatch:
            keys = np.stack([np.asarray(rows.column(c)) for c in by], axis=1)
            group = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
            left, times, low, high = (np.asarray(rows.column(c)).astype(np.int64) for c in ("left", "times", "low", "high"))
            row, first, past = _runs(repeated_windows(rows.column("context").to_pylist(), left, group, times, u, low, high))
            kept = rows.select(keep).take(pa.array(row))
            return pa.RecordBatch.from_arrays([*kept.columns, pa.array(first.astype(np.int64)), pa.array((past - first).astype(np.int64))], names)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            for a in range(0, len(batch), GROUPED):
                part = batch.slice(a, GROUPED)
                keys = np.stack([np.asarray(part.column(c)) for c in by], axis=1)
                other = np.flatnonzero((keys != keys[-1]).any(axis=1))
                cut = int(other[-1]) + 1 if len(other) else 0  # the last group may go on
                same = not held or all(held[-1].column(c)[-1].as_py() == part.column(c)[0].as_py() for c in by)
                if cut or not same:
                    yield found(pa.concat_batches([*held, part.slice(0, cut)]))
                    held = []
                held.append(part.slice(cut))
        if held and sum(map(len, held)):
            yield found(pa.concat_batches(held))

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, ", ".join(f"{c} {'array<long>' if c == 'places' else 'long'}" for c in names))


def find(base: DataFrame, keys: DataFrame, repeated: DataFrame, u: windows.Units) -> DataFrame:
    """(id, text_hash, spans) with spans the (start, n) of runs of repeated windows, for the texts
    that have some. ``keys`` are the minimisers of texts, ``repeated`` (key, n) those that match."""
    whole = [F.size("places").cast("long").alias("times"), F.lit(0).cast("long").alias("low"), F.lit(u.size - u.gram).cast("long").alias("high")]
    who = [*windows.WHO, "places"]
    spans = lambda of: of.withColumn("place", F.explode("places")).select(*windows.WHO, (F.col("place") - F.col("back") - F.col("n") + 1).alias("start"), "n")
    wanted = common.written(windows.keys_of_texts(keys, repeated.filter(F.col("n") <= u.hot)), "wanted")
    rows = _around(base.join(wanted, windows.WHO), u).select("key", *who, "left", "context", *whole)
    out = spans(_extended(rows, u, ["key"], who))
    hot = repeated.filter(F.col("n") > u.hot)
    if hot.limit(1).count():
        half = (u.size - u.gram) // 2
        digest = F.unhex(F.substring(F.sha2(F.concat(F.col("left").cast("string").cast("binary"), F.lit(":").cast("binary"), "context"), 256), 1, 32))
        many = common.written(_around(base.join(windows.keys_of_texts(keys, hot), windows.WHO), u).withColumn("digest", digest), "around")
        each = many.groupBy("key", "digest").agg(F.first("left").alias("left"), F.first("context").alias("context"), F.sum(F.size("places")).alias("times"))
        each = common.written(each.withColumn("own", F.xxhash64("key", "digest")), "contexts")
        right = F.xxhash64(F.substring(F.col("context"), F.col("left") + 1, F.lit(u.size - half)))
        far = F.xxhash64(F.substring(F.col("context"), F.col("left") - half, F.lit(half + 1)))
        sides = F.array(F.struct(right.alias("sub"), F.lit(0).cast("long").alias("low"), F.lit(half).cast("long").alias("high")), F.struct(far.alias("sub"), F.lit(half + 1).cast("long").alias("low"), F.lit(u.size - u.gram).cast("long").alias("high")))
        dealt = each.select("key", "own", "left", "context", "times", F.inline(sides)).filter("high = %d OR left > %d" % (half, half))
        seen = common.written(_extended(dealt, u, ["key", "sub"], ["key", "own"]), "extended")
        out = out.union(spans(many.withColumn("own", F.xxhash64("key", "digest")).select("key", "own", *who).join(seen, ["key", "own"])))
    return out.groupBy(*windows.WHO).agg(F.collect_set(F.struct("start", "n")).alias("spans"))


def remove_repeats(docs: DataFrame, units: windows.Units = UNITS, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes left) of every row."""
    base = windows.identified(docs)
    each = common.written(suffixes(base, units).withColumn("batch", F.pmod(F.xxhash64("id", "text_hash"), F.lit(batches))), "minimisers")
    family = Family()
    for batch in range(batches):
        family.add(each.filter(F.col("batch") == batch))
    repeated = common.written(family.matching().groupBy("key").agg(F.sum("n").alias("n")), "repeated")
    found = find(base, each, repeated, units)

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, spans in common.rows_of(rows):
            out: list[list] = [[], [], [], []]
            for text, some in zip(texts, spans, strict=True):
                gone, kept, end = windows.covered(some, units.size), [], 0
                for a, b in gone:
                    kept.append(text[end:a])
                    end = b
                kept = b"".join([*kept, text[end:]])
                for column, value in zip(out, (len(text), len(text) - len(kept), len(gone), kept), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = windows.with_spans(base, found)
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses, and a digest of what it keeps."""
    done = remove_repeats(common.table(spark, sf_dir, "documents"))
    return done.selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) AS kept_sha256")
