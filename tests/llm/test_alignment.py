"""Cross-tokenizer alignment against a brute force over tokens as the libraries give them."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from edgewright.llm import alignment

from .conftest import ordered

A, B = public_tokenizers.path(alignment.BYTE_LEVEL), public_tokenizers.path(alignment.PIECES)
ODD = ["word", " ", "  ", "\n", "\n\n", "\t", "ab\r", "the", "'s", "é", "日本", "▁", "<s>", "<0x41>", "<|endoftext|>", "\x00", "\x85", " ", "123", "$$", "🙂", ". "]


class Plain:
    """Tokens and groups by the definition; byte values by a decoder for single ids."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        self.value = alignment.byte_values()

    def __call__(self, text):
        """(groups, digest) of a text, nothing where it has no tokens."""
        if not text:
            return None
        got, whole = self.a.encode(" " + text, add_special_tokens=False), (" " + text).encode()
        a, b = got.ids, self.b.encode(text)
        of_a = [bytes(self.value[c] for c in t) for t in got.tokens]
        of_b = []
        for i in b:
            p = self.b.id_to_piece(i)
            of_b.append(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode())
        if b"".join(of_a) != whole or b"".join(of_b) != whole:
            return None
        groups, i, j, at = [], 0, 0, 0
        while i < len(a):
            x, y, left, right = [a[i]], [b[j]], len(of_a[i]), len(of_b[j])
            while left != right:
                if left < right:
                    i += 1
                    x.append(a[i])
                    left += len(of_a[i])
                else:
                    j += 1
                    y.append(b[j])
                    right += len(of_b[j])
            groups.append((x, y))
            i, j, at = i + 1, j + 1, at + left
        return groups, hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()


def expected(rows):
    plain = Plain()
    each = [(r[0], plain(r[1])) for r in rows]
    count = Counter((x[-1], y[-1]) for _, got in each if got for x, y in got[0])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for i, got in each:
        if not got:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x[-1], y[-1]) for x, y in got[0]]
        out.append((i, sum(len(x) for x, _ in got[0]), sum(len(y) for _, y in got[0]), len(links), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), got[1]))
    return out


def test_odd_rows(spark, docs, rows, no_docs):
    assert ordered(alignment.measures(docs).collect()) == ordered(expected(rows))
    assert alignment.measures(no_docs).count() == 0


def test_odd_texts(spark):
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice(ODD) for _ in range(rng.randint(1, 14)))) for i in range(400)]
    got = alignment.measures(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert ordered(got) == ordered(expected(rows))
    assert any(not r["groups_sha256"] for r in got)


def test_documents(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    assert ordered(alignment.op11_alignment(spark, data).collect()) == ordered(expected([tuple(r) for r in table.collect()]))


def test_forgetting_and_small_blocks_change_nothing(spark, data, monkeypatch):
    texts = pa.array([r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").filter("text <> ''").limit(20).collect()])
    whole = alignment.Aligner(A, B)(texts)
    monkeypatch.setattr(alignment, "REMEMBERED", 10)
    monkeypatch.setattr(alignment, "TOGETHER", 64)
    align = alignment.Aligner(A, B)
    for i in range(len(texts)):
        m, d, _, _ = align(texts.slice(i, 1))
        assert d == whole[1][i : i + 1] and m[:, 0].tolist() == whole[0][:, i].tolist()
