"""SimHash near-dedup by pivot distance tables.

A fingerprint takes, for each of 64 bits, the majority over the XXH64 values of a text's shingles.
Two fingerprints link when they differ in ``most`` bits or fewer; a document's component is what
links reach.

Links are found over distinct fingerprints, so copies cost nothing. The bits are cut into blocks;
two linked fingerprints agree outside some ``most`` blocks, so one row per choice of blocks to
ignore brings every linked pair into a bucket together. Buckets are split by the pivot table, every
fingerprint's Hamming distances to reference fingerprints: by the triangle inequality linked ones
differ by ``most`` at each coordinate, so a fingerprint goes to its cell of two coordinates, and to
the next one if it stands that near. In a cell pairs are formed along a third coordinate, only within
``most`` of each other, discarded by the others, and verified bit by bit. Only a spanning forest of
the links leaves a task, so large groups of near copies stay linear. Components follow by contracting
edges to parents, cut by checkpoint().

The pipeline's ``keep_one`` links by a rule, a Jaccard similarity of 0.8 of the sets of 5-word
shingles. It first takes the links of the fingerprints, found by the pivot table as above, and verifies
them on the whole sets. Fingerprints within 2 bits are few of the near copies of 0.8, so what they leave
apart goes on: least hashes of these in bands bring similar texts into buckets (a pair of 0.8 shares one
with a chance of 0.998). In a bucket a spanning tree of the largest estimated similarities gives one
pair fewer than texts, whatever the bucket's size; pairs that 512 bits of parity prove too far apart
go, and the others are verified on their whole sets, so nothing below the rule is linked. A bucket
over ``CELL`` texts is dealt into cells, each with the bucket's most central text. ``exact`` joins
the prefixes of the sets instead, which has every pair of the rule: sets that similar share a shingle
among their first fifth in any common order; its pairs grow with the square of a group of texts that
are less similar to each other.

Defined results: a null or empty text has no shingles and fingerprint zero, linked like any other;
a text with fewer words than a shingle takes the whole sequence; repeated rows and copies share a
component; an empty table gives an empty result; other columns are ignored by ``near_dedup`` and kept
by ``keep_one``, whatever their names. A null ``doc_id`` keeps its row; it names a component only where
no other id is in it. ``keep_one`` takes rows of one id and one text for one; different texts stay
apart whether or not they share an id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WORDS, MOST_BITS, BLOCKS, REFERENCES = 3, 2, 6, 24
SEED = 42
#: Width of a cell of a pivot coordinate, and how many coordinates split buckets.
WIDTH, SPLIT = 8, 2
#: Shingles whose bits are unpacked at once, and rows whose texts or sets a task holds.
CHUNK, HELD = 1 << 16, 512
#: What the pipeline asks for: words of a shingle, and the similarity of linked texts as a fraction.
SHINGLE, SIMILAR = 5, (4, 5)
#: Bands of least hashes and hashes of a band; the estimate from which a pair is verified; texts of a cell.
BANDS, ROWS, LEAST, CELL = 20, 6, 0.68, 2048
#: Texts whose shingles are counted for the order, from how many texts on one is frequent, how many are
#: told apart, and the longs of parity of a set.
SAMPLE, FREQUENT, MOST_FREQUENT, PARITY = 1 << 15, 4, 1 << 18, 8
#: Nodes from here on stand for fingerprints whose rows all lack an id.
_NO_DOC = 1 << 62


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of a text."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    n, ones = len(tokens) - words + 1, np.zeros(64, np.int64)
    for a in range(0, n, CHUNK):
        part = tokens[a : a + CHUNK + words - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False))
        digests = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), np.uint8)
        bits = np.unpackbits(digests.reshape(-1, 8), axis=1)
        for b in range(0, len(bits), 128):  # sums of up to 128 ones fit a byte
            ones += bits[b : b + 128].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fingerprint, as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.rows_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([_signed(fingerprint(t, words)) for t in texts], pa.int64())], ["doc_id", "fp"])

    docs = common.id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(run, "doc_id long, fp long")


def block_masks(most: int = MOST_BITS, blocks: int = BLOCKS) -> list[int]:
    """For each choice of ``most`` blocks to ignore, the bits that are kept, as signed longs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    ignored = [sum(1 << b for k in pick for b in range(edges[k], edges[k + 1])) for pick in combinations(range(blocks), most)]
    return [_signed(~x & (1 << 64) - 1) for x in ignored]


def reference(i: int) -> int:
    return xxhash.xxh64_intdigest(b"%d" % i, SEED)


def pivot_table(fps: np.ndarray, references: int = REFERENCES) -> np.ndarray:
    """Hamming distances of each fingerprint to the reference fingerprints, which are fixed."""
    refs = np.array([reference(i) for i in range(references)], np.uint64)
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def linked(fps: np.ndarray, keys: np.ndarray, most: int, tally: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs among fingerprints of one bucket by ``keys``.

    Each bucket is sorted by a pivot coordinate, and pairs are formed by their distance in that order
    until none is within ``most`` of the other there. ``tally`` gets how many pairs were formed, and
    how many the other coordinates left."""
    pivots = pivot_table(fps)
    along = pivots[:, SPLIT]
    order = np.lexsort((along, *keys.T[::-1]))
    fps, keys, pivots, along = fps[order], keys[order], pivots[order], along[order]
    left, right, n = [], [], [0, 0]
    same = np.arange(len(fps))
    lag = 1
    while len(same := same[same + lag < len(fps)]) and len(same := same[(along[same + lag] - along[same] <= most) & (keys[same] == keys[same + lag]).all(axis=1)]):
        for a in range(0, len(same), CHUNK):
            i = same[a : a + CHUNK]
            n[0] += len(i)
            i = i[np.abs(pivots[i] - pivots[i + lag]).max(axis=1) <= most]
            n[1] += len(i)
            i = i[np.bitwise_count(fps[i] ^ fps[i + lag]) <= most]
            left.append(i)
            right.append(i + lag)
        lag += 1
    if tally is not None:
        tally[:] = n
    none = [np.zeros(0, np.int64)]
    return order[np.concatenate(left or none)], order[np.concatenate(right or none)]


class Forest:
    """Union-find over the ids of one task; ``edges`` spans what was united."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.links: tuple[list[int], list[int]] = ([], [])  # the pairs that united two trees

    def root(self, x: int) -> int:
        up = self.parent
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(p, p)
        return x

    def unite(self, a: int, b: int) -> None:
        pair = a, b
        a, b = self.root(a), self.root(b)
        if a != b:
            self.links[0].append(min(pair))
            self.links[1].append(max(pair))
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        found = [(x, r) for x in self.parent if (r := self.root(x)) != x]
        return [x for x, _ in found], [r for _, r in found]


def _spanning(buckets: DataFrame, most: int, linked_ends: bool = False) -> DataFrame:
    """A spanning forest (a, b) of the links between the nodes of rows (pick, kept, fp, node), where
    a pick and what is kept name a bucket. Its edges lead to roots, or are links if ``linked_ends``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), None

        def link(rows: np.ndarray) -> None:
            keys = rows[:, :2]
            same = (keys[1:] == keys[:-1]).all(axis=1)
            shared = np.zeros(len(rows), bool)
            shared[1:] |= same
            shared[:-1] |= same
            rows = rows[shared]
            if len(rows):
                i, j = linked(np.ascontiguousarray(rows[:, 2]).view(np.uint64), rows[:, :2], most)
                for a, b in zip(rows[i, 3].tolist(), rows[j, 3].tolist(), strict=True):
                    forest.unite(a, b)

        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in range(4)], axis=1)
            if held is not None:
                rows = np.concatenate([held, rows])
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            end = last[-1] + 1 if len(last) else 0  # the last bucket may go on in the next batch
            link(rows[:end])
            held = rows[end:]
        if held is not None:
            link(held)
        a, b = forest.links if linked_ends else forest.edges()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return buckets.repartition("pick", "kept").sortWithinPartitions("pick", "kept").mapInArrow(run, "a long, b long")


def links(representatives: DataFrame, most: int = MOST_BITS, blocks: int = BLOCKS, linked_ends: bool = False) -> DataFrame:
    """A spanning forest (a, b) of the links between the ``node`` of rows (node, fp), fp distinct."""
    fp, rows = F.col("fp"), representatives.select("node", "fp", F.lit(0).alias("cell"))
    for i in range(SPLIT):
        d = F.bit_count(fp.bitwiseXOR(F.lit(_signed(reference(i)))))
        near = F.array_distinct(F.array((d / WIDTH).cast("int"), ((d + most) / WIDTH).cast("int")))
        rows = rows.select("node", "fp", "cell", F.explode(near).alias("more")).select("node", "fp", (F.col("cell") * 32 + F.col("more")).alias("cell"))
    masks = block_masks(most, blocks)
    each = F.array(*[F.struct((F.lit(k) + F.col("cell") * len(masks)).alias("pick"), fp.bitwiseAND(F.lit(m)).alias("kept")) for k, m in enumerate(masks)])
    return _spanning(rows.select(F.inline(each), "fp", "node"), most, linked_ends)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the least node that it reaches.

    A round gives every node the least of its neighbours and itself as its parent, after a jump to
    that one's own parent, and contracts each edge to the parents of its ends. Edges within a parent
    go, so tasks that found one group again and again cost one pass over what they sent."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct().checkpoint()
    steps: list[DataFrame] = []
    for _ in range(rounds):
        if not edges.limit(1).count():
            break
        near = edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("first")).checkpoint()
        second = near.select(F.col("node").alias("first"), F.col("first").alias("parent"))
        step = near.join(second, "first").select("node", "parent").checkpoint()
        steps.append(step)
        of_a, of_b = (step.select(F.col("node").alias(x), F.col("parent").alias(f"p{x}")) for x in ("a", "b"))
        moved = edges.join(of_a, "a").join(of_b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        up = step.select(F.col("parent").alias("a")).distinct().join(of_a, "a").select("a", F.col("pa").alias("b"))
        both = moved.union(up).filter("a <> b")
        edges = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    else:
        raise RuntimeError(f"edges are left after {rounds} rounds")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    label = steps[0].withColumnRenamed("parent", "component")
    for step in steps[1:]:
        further = step.select(F.col("node").alias("component"), "parent")
        label = label.join(further, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
    return label.checkpoint()


def near_dedup(docs: DataFrame, words: int = WORDS, most: int = MOST_BITS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row of ``docs``."""
    of_doc = common.written(fingerprints(docs, words), "fingerprints")
    reps = common.written(of_doc.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", F.coalesce("least", F.col("fp").bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(_NO_DOC)).alias("node")), "representatives")
    found = components(common.written(links(reps, most), "links"))
    placed = common.written(reps.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "components")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return of_doc.join(placed, "fp").select("doc_id", hexed, F.when(F.col("component_id") < _NO_DOC, F.col("component_id")).alias("component_id"))


_PERMUTE = np.array([xxhash.xxh64_intdigest(b"order %d" % i, SEED) | 1 for i in range(BANDS * ROWS)], np.uint64)
_MULTIPLIERS = np.array([xxhash.xxh64_intdigest(b"shingle %d" % i, SEED) | 1 for i in range(SHINGLE + 1)], np.uint64)


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def key_of(tokens: list[bytes]) -> int:
    """What texts of the same words share."""
    return _signed(xxhash.xxh3_64_intdigest(b" ".join(tokens)))


def shingles(tokens: list[bytes]) -> np.ndarray:
    """The different hashes of a text's shingles, in order; a shorter text is one shingle."""
    n = len(tokens) - SHINGLE + 1
    if n < 1:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), SEED)], np.uint64)
    words = np.frombuffer(b"".join(map(xxhash.xxh64_digest, tokens, repeat(SEED))), np.uint64)
    h = words[:n] * _MULTIPLIERS[0]
    for k in range(1, SHINGLE):
        h += words[k : k + n] * _MULTIPLIERS[k]
    h = (h ^ h >> np.uint64(31)) * _MULTIPLIERS[SHINGLE]
    return np.unique(h ^ h >> np.uint64(29))


def prefix(h: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set, rare ones first: a similar set has one of them in its own prefix."""
    known, counts = frequent
    at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
    count = np.where(known[at] == h, counts[at], 0) if len(known) else np.zeros(len(h), np.int64)
    part, whole = SIMILAR
    return h[np.lexsort((h, count))][: len(h) + 1 + -len(h) * part // whole]


def parity(h: np.ndarray) -> np.ndarray:
    """Whether the number of shingles in each of 64 * PARITY classes is odd; two sets differ in at
    least as many shingles as classes."""
    odd = np.bincount((h % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _far(shared: Column | int, n_a: Column, n_b: Column) -> Column:
    """Whether sets of ``n_a`` and ``n_b`` shingles that share so many are less similar than the rule."""
    part, whole = SIMILAR
    return shared * F.lit(part + whole) < (n_a + n_b) * F.lit(part)


def _frequent(docs: DataFrame, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of frequent shingles in a sample of rows (id, text), in order, and their counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in common.rows_of(batches):
            for text in texts:
                yield pa.RecordBatch.from_arrays([pa.array(shingles(tokens_of(text)).view(np.int64))], ["h"])

    share = int(min(1.0, SAMPLE / max(documents, 1)) * (1 << 20))
    sample = docs.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share)
    counts = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT)
    found = counts.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toArrow()
    h, n = (found.column(c).to_numpy().astype(t) for c, t in (("h", np.int64), ("n", np.int64)))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], n[order]


def _signature(h: np.ndarray) -> np.ndarray:
    """The least of each of BANDS * ROWS hashes of a set."""
    least = np.full(len(_PERMUTE), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(h), 256):
        np.minimum(least, (h[a : a + 256, None] * _PERMUTE).min(axis=0), out=least)
    return least


def _mapped(docs: DataFrame, frequent=None) -> DataFrame:
    """id, key, fp, n, odd, and sketch and bands, or the first shingles if ``frequent`` gives their order."""
    lists = pa.list_(pa.int64())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.rows_of(batches, HELD):
            out: list[list] = [[], [], [], [], [], []]
            for text in texts:  # one text's words at a time
                tokens = tokens_of(text)
                h = shingles(tokens)
                least = _signature(h) if frequent is None else None
                more = (least.astype(np.uint8).tobytes(), _bands(least)) if frequent is None else (None, prefix(h, frequent.value).view(np.int64))
                for column, x in zip(out, (key_of(tokens), _signed(fingerprint(text)) if frequent is None else None, len(h), parity(h), *more), strict=True):
                    column.append(x)
            kinds = pa.int64(), pa.int64(), pa.int64(), lists, pa.binary(), lists
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["id", "key", "fp", "n", "odd", "sketch", "first"])

    return docs.mapInArrow(run, "id long, key long, fp long, n long, odd array<long>, sketch binary, first array<long>")


def _bands(least: np.ndarray) -> np.ndarray:
    rows = np.ascontiguousarray(least.reshape(BANDS, ROWS))
    return np.array([_signed(xxhash.xxh3_64_intdigest(r.tobytes(), k)) for k, r in enumerate(rows)], np.int64)


def tree(sketches: np.ndarray) -> list[tuple[int, int]]:
    """The edges of a spanning tree of the largest estimated similarities, those above LEAST."""
    n, out = len(sketches), []
    near, to = (sketches == sketches[0]).sum(axis=1), np.zeros(n, np.int64)
    near[0] = -1
    for _ in range(n - 1):
        j = int(near.argmax())
        if near[j] >= LEAST * sketches.shape[1]:
            out.append((int(to[j]), j))
        inside = near < 0
        again = (sketches == sketches[j]).sum(axis=1)
        to[again > near] = j
        near = np.maximum(near, again)
        near[inside] = near[j] = -1
    return out


def _trees(cells: DataFrame) -> DataFrame:
    """The pairs (a, b) of the spanning tree of each cell of rows (bucket, cell, key, sketch)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: tuple | None = None
        keys: list[int] = []
        sketches: list[bytes] = []
        out: tuple[list, list] = ([], [])

        def close() -> None:
            if len(keys) > 1:
                for i, j in tree(np.frombuffer(b"".join(sketches), np.uint8).reshape(len(keys), -1)):
                    if keys[i] != keys[j]:  # a central text may also be in the cell by itself
                        out[0].append(min(keys[i], keys[j]))
                        out[1].append(max(keys[i], keys[j]))

        for buckets, numbers, some, held in common.rows_of(batches):
            for at, key, sketch in zip(zip(buckets, numbers, strict=True), some, held, strict=True):
                if at != cell:
                    close()
                    cell = at
                    keys.clear()
                    sketches.clear()
                keys.append(key)
                sketches.append(sketch)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    dealt = cells.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", "key")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _candidates(reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys that share a band, a tree's worth for each bucket."""
    bands = reps.select("key", F.explode("first").alias("bucket"))
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = common.written(bands.join(sizes, "bucket"), "shared")
    cells = shared.withColumn("cells", F.ceil(F.col("size") / CELL))
    dealt = cells.select("bucket", F.pmod(F.xxhash64("key", "bucket"), "cells").alias("cell"), "key")
    if not cells.filter("cells > 1").isEmpty():
        weight = shared.groupBy("key").agg(F.sum("size").alias("weight"))  # the most central shares most with others
        middle = cells.filter("cells > 1").join(weight, "key").groupBy("bucket", "cells").agg(F.max_by("key", F.struct("weight", "key")).alias("key"))
        dealt = dealt.union(middle.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"), "key"))
    return _trees(dealt.join(reps.select("key", "sketch"), "key").select("bucket", "cell", "key", "sketch"))


#: Bits of the bitmap of ids whose sets are asked for: of fixed size, it only saves work.
_BITS = 1 << 24


def _bitmap(ids: DataFrame) -> np.ndarray:
    place = F.pmod(F.xxhash64("id"), F.lit(_BITS))
    words = ids.select(place.alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS INT))")).alias("x")).toArrow()
    out = np.zeros(_BITS // 64, np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose whole shingle sets are similar. ``docs`` are (id, text).

    Sets are made again for texts that a pair names, told by a bitmap of their ids; texts stay where
    they are, and sets meet pairs in joins."""
    of_a, of_b = (reps.select(F.col("key").alias(x), F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}")) for x in ("a", "b"))
    differ = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    near = pairs.join(of_a, "a").join(of_b, "b").filter(~_far((F.col("n_a") + F.col("n_b") - differ) / 2, F.col("n_a"), F.col("n_b")))
    near = common.written(near.drop("odd_a", "odd_b"), "candidates")
    ends = F.array(*(F.struct(F.col(f"id_{x}").alias("id"), F.col(x).alias("key")) for x in ("a", "b")))
    wanted = near.select(F.inline(ends)).distinct()
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.asarray(batch.column(2))
            asked = batch.take(pa.array(np.flatnonzero(sent.value[p >> 6] >> (p & 63) & 1)))
            for ids, texts, _ in common.rows_of([asked], HELD):
                keys, sets = [], []
                for text in texts:
                    tokens = tokens_of(text)
                    keys.append(key_of(tokens))
                    sets.append(shingles(tokens).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "key", "held"])

    sets = docs.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(_BITS)).alias("p")).mapInArrow(run, "id long, key long, held array<long>")
    sets = common.written(sets.join(wanted, ["id", "key"], "left_semi").dropDuplicates(["key"]).select("key", "held"), "sets")
    held_a, held_b = (sets.select(F.col("key").alias(x), F.col("held").alias(f"held_{x}")) for x in ("a", "b"))
    shared = F.size(F.array_intersect("held_a", "held_b"))
    linked = near.join(held_a, "a").join(held_b, "b").filter(~_far(shared, F.col("n_a"), F.col("n_b")))
    return common.written(linked.select("a", "b"), "links")


def similar(docs: DataFrame, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """The different texts of rows (id, text) by their ``key``, with their least ``id``, and links (a, b)
    between keys. They join what all links of the rule join: nearly always, or always if ``exact``."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, docs.count())) if exact else None
    rows = common.written(_mapped(docs, frequent), "mapped")
    reps = rows.groupBy("key").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("fp", "n", "odd", "sketch", "first")))
    reps = common.written(reps, "representatives")
    return reps.select("key", "id"), _all_links(docs, reps) if exact else _near_links(docs, reps)


def _fingerprint_pairs(reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys that join what fingerprints of ``MOST_BITS`` or fewer join, each within these."""
    of_fp = common.written(reps.groupBy("fp").agg(F.min("key").alias("node")), "fingerprints")
    same = reps.join(of_fp, "fp").filter("key <> node").select(F.col("node").alias("a"), F.col("key").alias("b"))
    return links(of_fp.select("node", "fp"), linked_ends=True).union(same).distinct()


def _near_links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Links of the rule: those that fingerprints find by pivot tables, then, for texts that are farther
    apart than these tell, those that bands find between what the former left apart."""
    close = _verified(_fingerprint_pairs(reps), docs, reps)
    found = components(close).select("node", "component")
    of_a, of_b = (found.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in ("a", "b"))
    rest = _candidates(reps).join(of_a, "a", "left").join(of_b, "b", "left").filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
    return close.union(_verified(rest.select("a", "b"), docs, reps))


def _all_links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Links that join all that the rule's links join, from shared shingles of prefixes."""
    bucket = Window.partitionBy("h")
    row = F.struct("key", "n", "at")
    placed = reps.select("key", "n", F.posexplode("first").alias("at", "h")).withColumn("size", F.count("*").over(bucket)).filter("size > 1")
    placed = placed.withColumn("before", F.lag(row).over(bucket.orderBy("n", "key"))).withColumn("lead", F.first(row).over(bucket.orderBy("n", "key")))
    placed = common.written(placed.drop("size"), "shared")

    def pairs(of: DataFrame, x: str, y: str) -> DataFrame:
        shared = F.least(F.col(f"{x}.n") - F.col(f"{x}.at"), F.col(f"{y}.n") - F.col(f"{y}.at"))  # at most, where a pair first meets
        near = of.filter((F.col(f"{x}.key") != F.col(f"{y}.key")) & ~_far(shared, F.col(f"{x}.n"), F.col(f"{y}.n")))
        return near.select(F.least(f"{x}.key", f"{y}.key").alias("a"), F.greatest(f"{x}.key", f"{y}.key").alias("b"))

    each = placed.select(row.alias("row"), "before", "lead").filter("before IS NOT NULL")
    early = common.written(pairs(each, "row", "before").union(pairs(each, "row", "lead")).distinct(), "early")
    links = _verified(early, docs, reps)
    found = components(links).select(F.col("node").alias("key"), "component")
    label = reps.select("key").join(found, "key", "left").select("key", F.coalesce("component", "key").alias("label"))
    placed = placed.select("h", "key", "n", "at").join(label, "key")
    placed = placed.withColumn("least", F.min("label").over(bucket)).withColumn("most", F.max("label").over(bucket)).filter("least < most").drop("least", "most")
    placed = common.written(placed, "parted")
    x, y = placed.select("h", F.struct("key", "n", "at", "label").alias("x")), placed.select("h", F.struct("key", "n", "at", "label").alias("y"))
    late = pairs(x.join(y, "h").filter("x.label < y.label"), "x", "y").distinct()
    late = common.written(late.join(early, ["a", "b"], "left_anti"), "late")
    return links.union(_verified(late, docs, reps))


#: Stands for a null ``doc_id``, which comes after all others.
_LAST = (1 << 63) - 1


def keep_one(docs: DataFrame, exact: bool = False) -> DataFrame:
    """One row of ``docs`` from each group of near copies, with all its columns: that of the least id.

    Texts are moved once, to meet the ids and keys that stay."""
    columns, where = docs.columns, docs.columns.index("text")
    names = [n for n in (f"own_{i}" for i in range(len(columns) + 2)) if n not in columns][:2]
    id_, key = names
    with_id = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)))
    reps, links = similar(with_id.select(F.col(id_).alias("id"), "text"), exact)
    label = components(links).select(F.col("node").alias("key"), "component")
    first = reps.join(label, "key", "left").groupBy(F.coalesce("component", "key").alias("c")).agg(F.min(F.struct("id", "key")).alias("row"))
    kept = common.written(first.select(F.col("row.id").alias(id_), F.col("row.key").alias(key)), "kept")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [key_of(tokens_of(t)) for t in batch.column(where).to_pylist()]
            yield batch.append_column(key, pa.array(keys, pa.int64()))

    schema = T.StructType([*with_id.schema.fields, T.StructField(key, T.LongType())])
    return with_id.mapInArrow(run, schema).join(kept, names, "left_semi").dropDuplicates(names).select(columns)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    return near_dedup(common.table(spark, sf_dir, "documents"))
