"""Benchmark decontamination by pigeonhole edit matching.

A document holds a test item if some stretch of it is within ``errors`` edits of the item, where
``errors`` is a share of the item's length. Cut into ``errors + 1`` pieces, an item so matched has
at least one piece without an edit; so exact hits of pieces, found by one automaton over all
pieces, lead to every match. Around each hit Myers's bit-parallel algorithm computes the least edit
distance of the item to any stretch of the window; overlapping windows are merged first, so a text
full of hits is read once for an item.

Documents and items are compared as UTF-8 bytes with A-Z lower-cased and every run of ASCII
punctuation and white space as one space. Items are a query set against all rows: they are
broadcast in blocks of bounded size, each block against all documents, without a shuffle of texts.

Defined results: a null or empty document matches nothing, nor does an item that is null or has no
letter or digit; an item without an id keeps its null; items shorter than ``1 / rate`` bytes match without edits, and as whole words;
repeated items and repeated documents each give their pairs; very long texts are read whole; empty
tables give an empty result; ``keep_clean`` keeps all columns.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Edits allowed for each byte of an item, and the bytes of items in a broadcast block.
RATE, BLOCK = 0.07, 1 << 22

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain(text: str | None) -> str:
    """The bytes that are compared, one to a character."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(_PLAIN).split()).decode("latin-1")


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of an item, as even as can be, and where each begins."""
    edges = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def bit_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    return dict(masks)


def least_distance(masks: dict[str, int], length: int, text: str) -> int:
    """Myers: the least edit distance of an item to any stretch of ``text``."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score, best = full, 0, length, length
    for c in text:
        eq = masks.get(c, 0)
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
        down_again = eq | minus
        up, down = up << 1 & full, down << 1 & full
        plus = down | (full & ~(down_again | up))
        minus = up & down_again
    return best


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE) -> None:
        self.items = [(i, t, int(len(t) * rate)) for i, t in items if t]
        self.masks: dict[int, dict[str, int]] = {}
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text, errors) in enumerate(self.items):
            for at, piece in pieces(text, errors) if errors else [(-1, f" {text} ")]:
                places[piece].append((k, at))
        self.hits = ahocorasick.Automaton()
        for piece, where in places.items():
            self.hits.add_word(piece, (len(piece), where))
        if places:
            self.hits.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int]]:
        """(item, its least distance) of every item within its errors."""
        if not self.items or not text:
            return []
        text = f" {text} "
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (length, where) in self.hits.iter(text):
            for k, at in where:
                start, (_, item, errors) = end - length + 1 - at, self.items[k]
                windows[k].append((max(0, start - errors), start + len(item) + errors))
        found = []
        for k, spans in windows.items():
            name, item, errors = self.items[k]
            if not errors:
                found.append((name, 0))
                continue
            masks = self.masks.setdefault(k, {}) or bit_masks(item)
            self.masks[k] = masks
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            best = min(least_distance(masks, len(item), text[a:b]) for a, b in merged)
            if best <= errors:
                found.append((name, best))
        return found


def item_blocks(items: DataFrame, block: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text) in blocks of about ``block`` bytes, one on the driver at a time."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = -(-size // block)
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield sorted(((r["item_id"], plain(r["text"])) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance) of every document and item that it holds."""
    docs = common.id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    schema, out = "doc_id long, item_id long, distance int", None
    for block in item_blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate)
            for ids, texts in common.rows_of(batches):
                rows = [(i, *hit) for i, t in zip(ids, texts, strict=True) for hit in matcher(plain(t))]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["doc_id", "item_id", "distance"])

        some = docs.mapInArrow(run, schema)
        out = some if out is None else out.union(some)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def keep_clean(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item; one pass over them for each block of items."""
    where = docs.columns.index("text")
    for block in item_blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher(plain(t)) for t in batch.column(where).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the benchmark items that it holds, with their distance."""
    return matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
