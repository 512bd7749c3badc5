"""Secret scans with a trigram inverted index.

From each rule's regex follows a Boolean trigram query: an OR over the regex's alternatives of an
AND over the trigrams that each alternative must hold, in lower case. Each block of documents gets
an inverted index of the trigrams that some query asks for: for each, the ordered list of documents
with it. A rule's candidates are the union, over its alternatives, of intersected postings; only
these are verified with the regex, on their whole text. A rule with an alternative that has no
mandatory trigram scans every document. An index covers one block and stays in its task, so nothing
is shuffled and a hot source is like any other.

Defined results: a null text counts as empty; an empty text has no spans; spans are in code points,
end exclusive; repeated rows get equal results; very long texts are scanned whole; an empty table
gives an empty result; ``redact`` keeps all other columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re import _constants as kind_of
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex, and the least length of the group that decides."""

    kind: str
    regex: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.regex, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The three base kinds, then those that this operator adds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
ADDED = (
    # through END, if no other BEGIN comes first; without END, through the lines of Base64
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----|(?:(?:\s|\\[nr])+(?:(?:Proc-Type|DEK-Info):[^\r\n]*|[A-Za-z0-9+/]{16,}={0,2}|(?<=[\r\n])[A-Za-z0-9+/]+={0,2}(?=[ \t]*(?:[\r\n]|\Z))))*)"),
    Rule("hub_token", r"gh[opsu]_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + ADDED
#: A character class of up to so many letters is written out, and a rule of more alternatives scans fully.
SMALL_CLASS, MOST_ALTERNATIVES = 6, 256
#: Bytes of text that one index covers.
BLOCK = 1 << 23


def alternatives(regex: str) -> list[list[str]]:
    """For each alternative of a regex, the lower-cased strings that any match holds."""

    def of_class(items: list) -> list[str] | None:
        letters = set()
        for op, value in items:
            if op is kind_of.LITERAL:
                letters.add(chr(value).lower())
            elif op is kind_of.RANGE and value[1] - value[0] < SMALL_CLASS:
                letters |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return sorted(letters) if len(letters) <= SMALL_CLASS else None

    def walk(items) -> list[list[str]]:
        """Alternatives as runs of fixed text; an empty string between runs marks any text."""
        out: list[list[str]] = [[""]]
        for op, value in items:
            if op is kind_of.LITERAL:
                more = [[chr(value).lower()]]
            elif op is kind_of.IN and (letters := of_class(value)):
                more = [[x] for x in letters]
            elif op is kind_of.BRANCH:
                more = [x for branch in value[1] for x in walk(branch)]
            elif op is kind_of.SUBPATTERN:
                more = walk(value[3])
            elif op in (kind_of.MAX_REPEAT, kind_of.MIN_REPEAT) and value[:2] == (0, 1):
                more = [[""], *walk(value[2])]
            elif op in (kind_of.MAX_REPEAT, kind_of.MIN_REPEAT) and value[0] >= 1:
                more = [[*x, ""] if len(x) > 1 or value[1] > 1 else x for x in walk(value[2])]
            else:
                more = [["", ""]]
            out = [[*a[:-1], a[-1] + b[0], *b[1:]] for a in out for b in more]
            if len(out) > MOST_ALTERNATIVES:
                return [["", ""]]
        return out

    return walk(parser.parse(regex))


def trigram_query(regex: str) -> list[frozenset[bytes]] | None:
    """The OR of ANDs of trigrams that a match must satisfy; None if some alternative needs none."""
    found = {frozenset(run[i : i + 3] for text in runs for run in [text.encode()] for i in range(len(run) - 2)) for runs in alternatives(regex)}
    if not all(found):
        return None
    return sorted((x for x in found if not any(y < x for y in found)), key=sorted)


class Index:
    """The inverted index of a block of texts, over the trigrams that queries ask for."""

    def __init__(self, texts: list[bytes], number: np.ndarray, asked: int) -> None:
        self.documents = len(texts)
        joined = np.frombuffer(b"\n\n".join(texts).lower(), np.uint8)
        starts = np.cumsum([0, *(len(t) + 2 for t in texts)])
        self.postings = [np.zeros(0, np.int64)] * asked
        if len(joined) >= 3:
            wide = joined.astype(np.int32)
            got = number[(wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]]
            at = np.flatnonzero(got)
            which, document = got[at] - 1, np.searchsorted(starts, at, "right") - 1
            pairs = np.unique(which.astype(np.int64) * len(texts) + document)
            cuts = np.searchsorted(pairs, np.arange(asked + 1) * len(texts))
            self.postings = [pairs[a:b] % len(texts) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def candidates(self, query: list[list[int]] | None) -> list[int]:
        """The documents that satisfy an OR of ANDs; None asks for all."""
        if query is None:
            return list(range(self.documents))
        found = np.zeros(0, np.int64)
        for every in query:
            lists = sorted((self.postings[t] for t in every), key=len)
            common_to_all = lists[0]
            for more in lists[1:]:
                common_to_all = np.intersect1d(common_to_all, more, assume_unique=True)
            found = np.union1d(found, common_to_all)
        return found.tolist()


class Scanner:
    """Finds the spans of all rules in lists of texts."""

    def __init__(self, rules: Iterable[Rule] = RULES) -> None:
        self.rules = list(rules)
        queries = [trigram_query(r.regex) for r in self.rules]
        asked = sorted({t for q in queries if q for every in q for t in every})
        self.asked, self.number = len(asked), np.zeros(1 << 24, np.int16)
        for i, t in enumerate(asked):
            self.number[int.from_bytes(t, "big")] = i + 1
        at = {t: i for i, t in enumerate(asked)}
        self.queries = [q and [[at[t] for t in every] for every in q] for q in queries]
        # a run of fewer characters can't pass, so a full scan may ask the regex engine for longer ones only
        self.patterns = [re.compile(re.sub(r"\+$", f"{{{r.least},}}", r.regex), re.ASCII) if q is None and r.least and not r.group and not r.any_case and re.fullmatch(r"\[[^]]+\]\+", r.regex) else r.compiled() for r, q in zip(self.rules, queries, strict=True)]

    def __call__(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text, its spans (start, rule's place, end) in order."""
        out: list[list[tuple[int, int, int]]] = []
        block, size = [], 0
        for t in texts:
            block.append(t or "")
            size += len(block[-1])
            if size >= BLOCK:
                out += self._block(block)
                block, size = [], 0
        return out + (self._block(block) if block else [])

    def _block(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        index = Index([t.encode("utf-8", "replace") for t in texts], self.number, self.asked)
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, pattern, query) in enumerate(zip(self.rules, self.patterns, self.queries, strict=True)):
            for i in index.candidates(query):
                for m in pattern.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        spans[i].append((m.start(), k, m.end()))
        return [sorted(x) for x in spans]



def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end), of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for ids, texts in common.rows_of(batches):
            spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in found] for found in scanner(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    docs = common.id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each span, or run of overlapping spans, replaced by ``[SECRET]``; spans that only
    touch are replaced one by one."""
    where = docs.columns.index("text")

    def masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
        if not spans:
            return text
        parts, end = [], 0
        for a, _, b in spans:
            if a >= end:
                parts += [text[end:a], "[SECRET]"]
            end = max(end, b)
        return "".join(parts) + text[end:]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            texts = batch.column(where).to_pylist()
            clean = [masked(t, s) for t, s in zip(texts, scanner(texts), strict=True)]
            yield batch.set_column(where, batch.schema.field(where), pa.array(clean, batch.schema.field(where).type))

    return docs.mapInArrow(run, docs.schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans, of every document."""
    spans = scan(common.table(spark, sf_dir, "documents"))
    written_out = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    kinds = [r.kind for r in BASE]
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(kinds)), written_out), ",")
    return spans.select("doc_id", *map(of_kind, kinds), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", written_out), ",").alias("spans"))
