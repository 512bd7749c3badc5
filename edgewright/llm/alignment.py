"""Cross-tokenizer alignment: how two tokenizers cut the same text, over exactly deduplicated texts.

Rows meet by their full text, so that each different text is tokenized by both and aligned once; what
it adds to the counts of id pairs is weighted by its copies, and its measures go back to all rows that
hold it by the text's SHA-256. Byte offsets where a token of A and one of B both end cut both into
groups; the pair of tokens that ends a group is a link.

A worker remembers aligned chunks: a space or line feed after a character that isn't white space is the
end of a token in both tokenizers, whatever surrounds it, so the text between two such places always
gets the same tokens. New chunks are tokenized in one string. Texts with other white space than
ASCII's, or white space at the end, are tokenized whole, and so are texts with a chunk that a tokenizer
doesn't give back byte by byte.

Texts go into blocks; a block sends each different id pair once, with its count, and gets back what the
pair's count is over the corpus. So what is shuffled for counting grows with the different pairs of a
block, and no id pair is a hot key.

Defined results: a null or empty text, or one that a tokenizer doesn't give back, has no tokens, zero in
every measure and '' as ``groups_sha256``; strings of special tokens are plain text; repeated rows, and
rows without an id, each get their own result; very long texts are aligned whole; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from . import common

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a block, and tokenized together; chunks that a worker remembers.
BLOCK, TOGETHER, REMEMBERED = 8 << 20, 1 << 15, 600_000
#: White space beyond ASCII's, and what may count as such; and white space that ends a text.
_ODD = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200b\u2028-\u202f\u205f\u2581\u3000\ufeff]|[ \t-\r]\\z"
_MEASURES = ["n_a", "n_b", "n_groups", "n_links"]


def byte_values() -> dict[str, int]:
    """The byte of each character in a byte-level vocabulary: printable characters of Latin-1 stand for
    themselves, and the others, in order, for what follows U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Aligner:
    """Tokens, groups and links of texts; remembers those of chunks."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_path)
        value = byte_values()
        vocabulary = {i: t for t, i in self.a.get_vocab().items()}
        special = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        self.bytes_a = [special[i].encode() if i in special else bytes(value[c] for c in vocabulary.get(i, "")) for i in range(max(vocabulary) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.len_a, self.len_b = (np.array([len(x) for x in table]) for table in (self.bytes_a, self.bytes_b))
        self._forget()

    def _forget(self) -> None:
        """Chunk 0 is a lone space, which stands for texts that are taken whole."""
        self.chunks: dict[str, int] = {" ": 0}
        self.strings: list[str] = [""]
        self.n_a, self.n_b, self.first = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(2, np.int64)
        self.bad = np.zeros(1, bool)
        self.links = np.zeros(0, np.int64)  # numbers of pairs
        self.pairs: dict[int, int] = {}

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of a text that starts with a space; nothing if a tokenizer doesn't give it back."""
        a = self.a.encode(text, add_special_tokens=False).ids
        b = self.b.encode(text[1:], num_threads=1)
        want = text.encode("utf-8", "replace")
        if b"".join(map(self.bytes_a.__getitem__, a)) != want or b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def _aligned(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Where groups end in bytes, the last place of each group in a and in b, and the groups written out."""
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        ends, last_a, last_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        out, i, j = [], 0, 0
        for p, q in zip((last_a + 1).tolist(), (last_b + 1).tolist(), strict=True):
            out.append(f"{names_a[i] if p == i + 1 else ','.join(names_a[i:p])}|{names_b[j] if q == j + 1 else ','.join(names_b[j:q])}")
            i, j = p, q
        return ends, last_a, last_b, out

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        """The worker's own numbers of id pairs."""
        different, at = np.unique(keys, return_inverse=True)
        return np.array([self.pairs.setdefault(k, len(self.pairs)) for k in different.tolist()], np.int64)[at] if len(keys) else keys

    def _learn(self, chunks: list[str]) -> None:
        size, group = 0, []
        for chunk in chunks:
            group.append(chunk)
            size += len(chunk)
            if size >= TOGETHER:
                self._learn_group(group)
                size, group = 0, []
        if group:
            self._learn_group(group)

    def _learn_group(self, chunks: list[str]) -> None:
        got = self._ids(" a" + "".join(chunks))  # the first word lets any chunk follow
        if got is None and len(chunks) > 1:
            middle = len(chunks) // 2
            self._learn_group(chunks[:middle])
            return self._learn_group(chunks[middle:])
        k = len(chunks)
        numbers = range(len(self.strings), len(self.strings) + k)
        if got is None:
            self._add(numbers, chunks, np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(0, np.int64), [""] * k, True)
            return None
        a, b = got
        ends, last_a, last_b, written = self._aligned(a, b)
        stops = np.cumsum([2, *(len(c.encode("utf-8", "replace")) for c in chunks)])
        cut = np.searchsorted(ends, stops, "right")  # groups up to and with each chunk
        cut_a, cut_b = np.searchsorted(np.cumsum(self.len_a[a]), stops, "right"), np.searchsorted(np.cumsum(self.len_b[b]), stops, "right")
        keys = a[last_a] << 32 | b[last_b]
        edges = cut.tolist()
        self._add(numbers, chunks, np.diff(cut_a), np.diff(cut_b), np.diff(cut), self._numbers(keys[cut[0] :]), [";".join(written[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)], False)
        return None

    def _add(self, numbers: range, chunks: list[str], n_a: np.ndarray, n_b: np.ndarray, n: np.ndarray, links: np.ndarray, strings: list[str], bad: bool) -> None:
        self.chunks.update(zip(chunks, numbers, strict=True))
        self.strings += strings
        self.n_a, self.n_b = np.concatenate([self.n_a, n_a]), np.concatenate([self.n_b, n_b])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(n)])
        self.links = np.concatenate([self.links, links])
        self.bad = np.concatenate([self.bad, np.full(len(chunks), bad)])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of texts that aren't empty: the measures as rows, the digests, and all links: the text and the pair's number."""
        if len(self.chunks) > REMEMBERED:
            self._forget()
        odd = np.asarray(pc.match_substring_regex(texts, _ODD))
        plain = pc.binary_join_element_wise(" ", pc.if_else(pa.array(odd), "", texts), "")
        data = np.frombuffer(plain.buffers()[2], np.uint8, plain.buffers()[2].size)
        offsets = np.frombuffer(plain.buffers()[1], np.int32, len(plain) + 1 + plain.offset)[plain.offset :].astype(np.int64)
        data = data[: offsets[-1]]
        space = (data == 32) | (data >= 9) & (data <= 13)
        cut = (data == 32) | (data == 10)
        cut[1:] &= ~space[:-1]
        cut[offsets[:-1]] = True
        starts = np.flatnonzero(cut)
        edges = np.append(starts, len(data)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(data)).dictionary_encode()
        different = coded.dictionary.to_pylist()
        if new := [c for c in different if c not in self.chunks]:
            self._learn(new)
        codes = np.fromiter(map(self.chunks.__getitem__, different), np.int64, len(different))[np.asarray(coded.indices)]
        bounds = np.searchsorted(starts, offsets)
        of = np.repeat(np.arange(len(texts)), np.diff(bounds))
        odd[of[self.bad[codes]]] = True
        n = np.diff(self.first)[codes]
        n[odd[of]] = 0
        links = self.links[np.arange(n.sum()) + np.repeat(self.first[codes] - (np.cumsum(n) - n), n)]
        link_of = np.repeat(of, n)
        measures = np.stack([np.bincount(of, x, minlength=len(texts)).astype(np.int64) for x in (self.n_a[codes], self.n_b[codes], n)])
        digests = []
        each, edges = codes.tolist(), bounds.tolist()
        for i, strange in enumerate(odd.tolist()):
            if not strange:
                digests.append(hashlib.sha256(";".join(map(self.strings.__getitem__, each[edges[i] : edges[i + 1]])).encode()).hexdigest())
                continue
            digests.append("")
            measures[:, i] = 0
            if got := self._ids(" " + texts[i].as_py()):
                ends, last_a, last_b, written = self._aligned(*got)
                digests[-1] = hashlib.sha256(";".join(written).encode()).hexdigest()
                measures[:, i] = len(got[0]), len(got[1]), len(ends)
                links = np.concatenate([links, self._numbers(got[0][last_a] << 32 | got[1][last_b])])
                link_of = np.concatenate([link_of, np.full(len(ends), i)])
        return measures, digests, link_of, links


@lru_cache(1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


_BLOCK = "block long, keys array<binary>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, n binary, links binary, pairs array<struct<a: int, b: int, n: long>>"


def aligned(texts: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Blocks of texts (key, text, copies): measures, the links of each text as places in the block's
    different id pairs, and these pairs with their counts."""
    kinds = [pa.int64(), pa.list_(pa.binary()), *[pa.list_(pa.int64())] * 3, pa.list_(pa.string()), pa.binary(), pa.binary(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))]
    names = [re.split("[ :]", f)[0] for f in _BLOCK.split(", ") if not re.match("[bn]: ", f)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, number = aligner(byte_path, piece_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            size = np.cumsum(np.asarray(pc.binary_length(batch.column(1))).astype(np.int64)) // BLOCK
            for rows in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(size)) + 1) if len(batch) else ():
                some = batch.slice(rows[0], len(rows))
                measures, digests, of, links = align(some.column(1))
                order = np.argsort(of, kind="stable")
                of, links = of[order], links[order]
                copies = np.asarray(some.column(2))
                times = np.bincount(links, copies[of], minlength=len(align.pairs)).astype(np.int64)
                held = np.flatnonzero(times)
                dense = np.zeros(len(times), np.int64)
                dense[held] = np.arange(len(held))
                keys = np.fromiter(align.pairs, np.int64, len(align.pairs))[held]
                pairs = pa.StructArray.from_arrays([pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(times[held])], ["a", "b", "n"])
                n = np.bincount(of, minlength=len(some)).astype(np.int32)
                row = [[number], [some.column(0).to_pylist()], *([m.tolist()] for m in measures), [digests], [common.packed(n)], [common.packed(dense[links].astype(np.int32))]]
                number += 1
                yield pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(row, kinds, strict=False)), pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs)], names)

    return common.written(texts.mapInArrow(run, _BLOCK), "aligned")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, count): how many links of the corpus hold the ids linked."""
    return blocks.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("count"))


def measures(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    byte_path, piece_path = byte_path or public_tokenizers.path(BYTE_LEVEL), piece_path or public_tokenizers.path(PIECES)
    rows = common.id_and_text(docs)
    texts = rows.filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies")).select(F.unhex(F.sha2("text", 256)).alias("key"), "text", "copies")
    blocks = aligned(texts, byte_path, piece_path)
    counts = common.written(pair_counts(blocks), "pair_counts")
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    rated = counts.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    asked = blocks.select(F.col("block").alias("asking"), F.posexplode("pairs").alias("place", "pair")).select("asking", "place", "pair.a", "pair.b")
    answers = asked.join(rated, ["a", "b"]).select("asking", "place", "count", "best")
    names = ["key", *_MEASURES, "n_best", "count_sum", "groups_sha256"]
    kinds = [pa.binary(), *[pa.int64()] * 6, pa.string()]

    def finish(block: pa.Table, said: pa.Table) -> pa.Table:
        if not len(block):
            return pa.table([pa.array([], k) for k in kinds], names)
        count, best = np.zeros(len(said), np.int64), np.zeros(len(said), bool)
        place = np.asarray(said["place"])
        count[place], best[place] = np.asarray(said["count"]), np.asarray(said["best"])
        n, links = (common.unpacked(block[c][0].as_py(), "<i4").astype(np.int64) for c in ("n", "links"))
        ends = np.cumsum(n)
        totals = [np.concatenate([[0], np.cumsum(x)]) for x in (best[links].astype(np.int64), count[links])]
        sums = [t[ends] - t[ends - n] for t in totals]
        groups = block["n_groups"][0].values
        return pa.table([block["keys"][0].values, block["n_a"][0].values, block["n_b"][0].values, groups, groups, *map(pa.array, sums), block["digests"][0].values], names)

    schema = "key binary, " + ", ".join(f"{n} long" for n in names[1:-1]) + ", groups_sha256 string"
    done = blocks.drop("pairs").groupBy("block").cogroup(answers.groupBy("asking")).applyInArrow(finish, schema)
    asking = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2("text", 256)).alias("key"))
    joined = asking.join(done, "key", "left")
    return joined.select("doc_id", *(F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in names[1:-1]), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the two tokenizers align on every document."""
    return measures(common.table(spark, sf_dir, "documents"))
