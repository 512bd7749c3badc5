"""Ranked lexical search over a length-stratified index.

Terms are runs of digits, letters and characters beyond ASCII, with A-Z lower-cased. A document's
score for an item sums, over the item's terms with repeats, w * ((10^9 tf) div (1000 tf + 12 m)): w is
the term's weight, tf its occurrences in the document, and m the normaliser from the document's length.

Documents of equal m are a stratum. Rows are sorted by m over all partitions, and those of one m are
spread by a hash, so that a stratum is in few tasks and none is too large for one. In a task, postings
lie by term, stratum and tf, so an impact is computed once for each of these and not for each document.
The largest tf of a term in a stratum bounds what the stratum can score; an item visits strata by
descending bound, in steps of doubling size, and stops where the bound is below its current k-th score.
First thresholds are the k-th scores among a few thousand documents, so that tasks without a good
document return nothing. Bounds only save work: no document that could be ranked is left out.

Items are taken in blocks of bounded size, each against all documents; a block's terms are broadcast
and postings hold these terms alone. Statistics cover every document.

Defined results: a null or empty text has no terms; a document without terms is no part of N, and an
item without terms has no results; rows that repeat a document each count and are ranked, rows that
repeat an item are items of their own, with equal rows; a document without an id comes after equal
scores that have one; very long texts are taken whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 20
#: Items and bytes of their texts in a block; bytes of text split at a time; documents that give first
#: thresholds; strata whose postings are laid out together.
ITEMS, ITEM_BYTES, GROUP, SEEDS, STRATA = 4096, 4 << 20, 4 << 20, 4096, 256
#: The least normaliser, and what a document of average length adds to it.
LEAST, AVERAGE = 75, 25
_NO_ID = np.iinfo(np.int64).max
#: What each byte of a text becomes: a space if it is no part of a term.
_BYTES = np.array([c if chr(c).isalnum() and c < 128 or c > 127 else 32 for c in range(256)], np.uint8)
_BYTES[65:91] += 32


def terms(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """For groups of texts: how many they are, the text and the code of each term, and the different terms by code."""
    texts = texts.fill_null("")
    size = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64)) // GROUP
    for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(size)) + 1) if len(texts) else ():
        some = pa.concat_arrays([texts.slice(rows[0], len(rows))])
        offsets = np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + len(some) + 1]
        data = np.frombuffer(some.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        plain = pa.StringArray.from_buffers(len(some), pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(_BYTES[data]))
        lists = pc.ascii_split_whitespace(plain)
        coded = lists.flatten().dictionary_encode()
        codes, of = np.asarray(coded.indices).astype(np.int64), np.repeat(np.arange(len(some)), np.diff(np.asarray(lists.offsets)))
        real = np.asarray(pc.not_equal(coded.dictionary, "")).astype(bool)[codes] if len(codes) else np.zeros(0, bool)
        yield len(some), of[real], codes[real], coded.dictionary


@dataclass(frozen=True)
class Items:
    """A block of items: their different terms, and each item's terms with their number."""

    vocabulary: pa.Array
    held: list[np.ndarray]
    times: list[np.ndarray]


def _items(texts: list[str | None]) -> Items:
    counts: list[dict[str, int]] = []
    for m, of, codes, names in terms(pa.array(texts, pa.string())):
        names, base = names.to_pylist(), len(counts)
        counts += [{} for _ in range(m)]
        for i, c in zip((of + base).tolist(), codes.tolist(), strict=True):
            counts[i][names[c]] = counts[i].get(names[c], 0) + 1
    place = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
    return Items(pa.array(list(place), pa.string()), [np.array([place[t] for t in c], np.int64) for c in counts], [np.array(list(c.values()), np.int64) for c in counts])


def postings(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """doc_id, n (its terms with repeats), and of the terms in ``vocabulary`` their places and tf."""
    sent, width = docs.sparkSession.sparkContext.broadcast(vocabulary), max(1, len(vocabulary))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            at = 0
            for m, of, codes, names in terms(batch.column(1)):
                place = np.asarray(pc.fill_null(pc.index_in(names, value_set=known), -1)).astype(np.int64)[codes]
                cell, tf = np.unique((of * width + place)[place >= 0], return_counts=True)
                edges = pa.array(np.searchsorted(cell, np.arange(m + 1) * width).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (cell % width, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, m), pa.array(np.bincount(of, minlength=m).astype(np.int64)), *lists], ["doc_id", "n", "terms", "tf"])
                at += m

    docs = common.id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return common.written(docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>").filter("n > 0"), "postings")


class Found:
    """The k best documents of each item so far; equal scores by the smaller id."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        self.k, self.floor = k, floor.copy()  # the least score that can still be ranked
        self.ids = [np.zeros(0, np.int64) for _ in floor]
        self.scores = [np.zeros(0, np.int64) for _ in floor]

    def take(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.floor[q]
        ids, scores = np.concatenate([self.ids[q], ids[good]]), np.concatenate([self.scores[q], scores[good]])
        if len(ids) > self.k:
            top = np.lexsort((ids, -scores))[: self.k]
            ids, scores = ids[top], scores[top]
        self.ids[q], self.scores[q] = ids, scores
        if len(ids) == self.k:
            self.floor[q] = max(self.floor[q], int(scores.min()))


def search(found: Found, items: Items, weights: np.ndarray, ids: np.ndarray, m: np.ndarray, of: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
    """Takes in documents sorted by m, whose postings are (of, term, tf)."""
    strata, stratum = np.unique(m, return_inverse=True)
    for a in range(0, len(strata), STRATA):
        here = (stratum >= a) & (stratum < a + STRATA)
        mine = here[of]
        _search_strata(found, items, weights, ids, strata[a : a + STRATA], stratum[of[mine]] - a, of[mine], term[mine], tf[mine])


def _search_strata(found: Found, items: Items, weights: np.ndarray, ids: np.ndarray, strata: np.ndarray, stratum: np.ndarray, of: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
    s, v = len(strata), len(weights)
    cell = term * s + stratum
    order = np.lexsort((tf, cell))
    of, tf, cell = of[order], tf[order], cell[order]
    new = np.ones(len(cell), bool)
    new[1:] = (cell[1:] != cell[:-1]) | (tf[1:] != tf[:-1])
    first = np.flatnonzero(new)  # of each term, stratum and tf
    once = tf[first].astype(np.int64)
    impact = np.repeat((1_000_000_000 * once) // (1000 * once + 12 * strata[cell[first] % s]), np.diff([*first, len(cell)]))
    start = np.searchsorted(cell, np.arange(v * s + 1))
    last = start[1:] - 1
    most = np.where(start[1:] > start[:-1], impact[last] if len(impact) else 0, 0).reshape(v, s)  # tf ascends, and so does impact
    worth = most * weights[:, None]
    for q, (held, times) in enumerate(zip(items.held, items.times, strict=True)):
        bound = times @ worth[held]
        visits = np.flatnonzero(bound >= found.floor[q])
        visits = visits[np.argsort(-bound[visits], kind="stable")]
        step, at = 1, 0
        while at < len(visits) and bound[visits[at]] >= found.floor[q]:
            chosen = visits[at : at + step]
            at, step = at + step, step * 2
            cells = (held[:, None] * s + chosen).ravel()
            n = start[cells + 1] - start[cells]
            rows = np.arange(n.sum()) + np.repeat(start[cells] - (np.cumsum(n) - n), n)
            score = impact[rows] * np.repeat(np.repeat(times * weights[held], len(chosen)), n)
            docs, back = np.unique(of[rows], return_inverse=True)
            total = np.zeros(len(docs), np.int64)
            if int(bound[chosen[0]]) < 1 << 53:
                total = np.bincount(back, score, minlength=len(docs)).astype(np.int64)  # whole numbers that doubles hold
            else:
                np.add.at(total, back, score)
            found.take(q, ids[docs], total)


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents, all against all documents."""
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // ITEMS), -(-size["bytes"] // ITEM_BYTES))
    dealt = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"))
    if blocks > 1:
        dealt = common.written(dealt, "items")
    return reduce(DataFrame.unionByName, [_ranked(docs, dealt.filter(F.col("block") == b).drop("block"), k) for b in range(blocks)])


def _ranked(docs: DataFrame, some: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    asked = some.collect()  # ITEMS rows or so
    items = _items([r["text"] for r in asked])
    index = postings(docs, items.vocabulary)
    total = index.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    n, words = total["docs"], total["words"]
    df = np.zeros(len(items.vocabulary), np.int64)
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term of the block
        df[r["term"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    sent = spark.sparkContext.broadcast((items, weights))
    m: Column = (F.lit(LEAST) + F.expr(f"({AVERAGE} * n * {n}L) div {max(1, words)}L")).cast("long")
    index = index.filter(F.size("terms") > 0).withColumn("m", m)

    def run(batches: Iterable[pa.RecordBatch], floor: np.ndarray) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        found = Found(floor, k)
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(_NO_ID))
            counts = np.asarray(pc.list_value_length(batch.column(1)))
            flat = [np.asarray(batch.column(c).flatten()).astype(np.int64) for c in (1, 2)]
            search(found, items, weights, ids, np.asarray(batch.column(3)), np.repeat(np.arange(len(ids)), counts), *flat)
        ids, scores = np.concatenate([*found.ids, np.zeros(0, np.int64)]), np.concatenate([*found.scores, np.zeros(0, np.int64)])
        item = np.repeat(np.arange(len(found.ids)), [len(x) for x in found.ids])
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], ["item", "doc_id", "score"])

    schema, columns = "item int, doc_id long, score long", ["doc_id", "terms", "tf", "m"]
    floor = np.ones(len(items.held), np.int64)
    seeds = index.orderBy(F.xxhash64("doc_id", "n", "terms", "tf")).limit(SEEDS).select(*columns)
    firsts = seeds.mapInArrow(lambda b: run(b, floor), schema).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).collect()
    for r in firsts:
        if r["n"] == k:
            floor[r["item"]] = r["least"]
    by_length = index.withColumn("spread", F.xxhash64("doc_id", "n", "terms")).repartitionByRange("m", "spread").sortWithinPartitions("m").select(*columns)
    best = by_length.mapInArrow(lambda b: run(b, floor), schema)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(asked)], f"item int, item_id {some.schema['item_id'].dataType.simpleString()}")
    return top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return ranked(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLE = rf"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
  ) GROUP BY ALL
), sizes AS (
  SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), totals AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes
), postings AS (
  SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term, docs
), scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * ({LEAST} + ({AVERAGE} * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals
  GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0
) WHERE rank <= {K}
"""
