"""Substring dedup by super-k-mer partitioning.

A window is 35 consecutive words of one document. Every word covered by a window whose words also
start anywhere else is removed; windows are judged on the input. See ``windows`` for the method:
consecutive windows that share a minimiser (of 12 words) travel as one string to its bucket, where
sorting counts windows exactly.

Defined results: a null or empty text, or one of fewer than 35 words, loses nothing; repeated rows
and copies lose every word that a window covers, the first copy too; a text that repeats itself
counts as well; very long texts are read whole; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, windows

WINDOW, GRAM = 35, 12
UNITS = windows.Units(WINDOW, GRAM, bytes.split, windows.hash_words, b" ")


def remove_repeats(docs: DataFrame, units: windows.Units = UNITS) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every row."""
    base = windows.identified(docs)
    keys = common.written(windows.minimisers(base, units), "minimisers")
    found = windows.find(base, keys, windows.repeated_keys(keys), units)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, spans in common.rows_of(batches):
            n_words, n_removed, kept = [], [], []
            for text, some in zip(texts, spans, strict=True):
                words = text.split()
                n_words.append(len(words))
                for a, b in reversed(windows.covered(some, units.size)):
                    del words[a:b]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    joined = windows.with_spans(base, found)
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses, and a digest of what it keeps."""
    done = remove_repeats(common.table(spark, sf_dir, "documents"))

    return done.selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) AS kept_sha256")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), w AS (
  SELECT doc_id, unnest(range(1, len(words) - {WINDOW - 2})) AS pos, words FROM d WHERE len(words) >= {WINDOW}
), h AS (
  SELECT doc_id, pos, md5(array_to_string(words[pos:pos + {WINDOW - 1}], ' ')) AS digest FROM w
), many AS (
  SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY digest) AS times FROM h) WHERE times > 1
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(pos, pos + {WINDOW})))) AS places FROM many GROUP BY doc_id
), left_over AS (
  SELECT d.doc_id, words, coalesce(len(places), 0) AS n_removed,
         list_transform(list_filter(range(1, len(words) + 1), lambda i: places IS NULL OR NOT list_contains(places, i)), lambda i: words[i]) AS kept
  FROM d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, len(words)::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM left_over
"""
