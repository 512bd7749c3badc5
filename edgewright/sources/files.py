"""Readers of entity, pair, cluster and embedding files."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that tell a header row.
ENTITY_HEADER = ("protein_id", "sequence", "id", "seq", "entity_id")
PAIR_HEADER = ("protein_a", "protein_b", "label", "id_a", "id_b")
CLUSTER_HEADER = ("protein_id", "cluster_id", "representative_id")
_NEVER_NULL = "\u0001null"


def _columns(spark: SparkSession, path: str, words: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Rows of a delimited file as string columns, and what names them: the first row, in lower case, if
    it holds one of ``words``; it is no row then. A comma for .csv, else a tab. No text is null."""
    sep = "," if path.endswith((".csv", ".csv.gz")) else "\t"
    read = lambda header, schema=None: spark.read.csv(path, schema=schema, sep=sep, header=header, inferSchema=False, nullValue=_NEVER_NULL, emptyValue="")
    df = read(False)
    first = df.head(1)
    names = [str(x).strip().lower() for x in first[0]] if first else []
    if not any(x in words for x in names):
        return df, []
    return read(True, df.schema), names


def read_named(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A headerless file with the names that are given; further columns are left out."""
    df, _ = _columns(spark, path)
    return df.select(*(F.trim(c).alias(n) for c, n in zip(df.columns, names, strict=False)))


def read_matches(spark: SparkSession, path: str, patterns: dict[str, str], joined: str = " ") -> DataFrame:
    """One row a line of a text file: for each name the first groups of all matches of its pattern, joined; null if there is none."""
    found = {n: F.array_join(F.regexp_extract_all("value", F.lit(p), F.lit(1)), joined) for n, p in patterns.items()}
    return spark.read.text(path).select(*(F.when(F.col("value").rlike(p), found[n]).alias(n) for n, p in patterns.items()))


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON results, a file or a line each, as rows of a schema; keys that it doesn't name are left out."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id, seq) of FASTA files: the id ends at white space, lines of a sequence are joined."""
    records = spark.read.option("lineSep", "\n>").text(path)
    lines = F.split(F.regexp_replace("value", "^>", ""), "\r?\n")
    return records.select(F.regexp_extract(F.element_at(lines, 1), r"^(\S+)", 1).alias("entity_id"), F.upper(F.regexp_replace(F.array_join(F.slice(lines, 2, 1 << 30), ""), r"\s", "")).alias("seq")).filter("entity_id <> ''")


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith((".fa", ".fasta", ".faa")):
        return read_fasta(spark, path)
    df, _ = _columns(spark, path, ENTITY_HEADER)
    return df.select(F.trim(df.columns[0]).alias("entity_id"), F.upper(F.trim(df.columns[1])).alias("seq"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, label); without a third column every pair has label 1. A label that is no number fails."""
    df, _ = _columns(spark, path, PAIR_HEADER)
    label = F.trim(df.columns[2]).cast("int") if len(df.columns) > 2 else F.lit(1)
    return df.select(F.trim(df.columns[0]).alias("a"), F.trim(df.columns[1]).alias("b"), label.alias("label"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(entity, grp) by the names in a file's header, or from headerless (representative, member) rows."""
    df, names = _columns(spark, path, CLUSTER_HEADER)
    group, entity = (names.index("cluster_id") if "cluster_id" in names else names.index("representative_id"), names.index("protein_id")) if names else (0, 1)
    return df.select(F.trim(df.columns[entity]).alias("entity"), F.trim(df.columns[group]).alias("grp"))


def read_split(spark: SparkSession, train: str, test: str) -> DataFrame:
    """A supplied split (side, a, b, label)."""
    parts = [read_pairs(spark, path).select(F.lit(side).alias("side"), "a", "b", "label") for side, path in (("train", train), ("test", test))]
    return parts[0].union(parts[1])


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(entity, v) from delimited text (id, numbers ...) or .npz files with arrays ids and X."""
    if path.endswith(".npz"):

        def load(batches):
            for batch in batches:
                for content in batch.column(0).to_pylist():
                    with np.load(io.BytesIO(content)) as found:
                        ids, x = [str(i) for i in found["ids"]], found["X"].astype(float)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), lists], ["entity", "v"])

        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(load, "entity string, v array<double>")
    df, _ = _columns(spark, path, ENTITY_HEADER)
    return df.select(F.trim(df.columns[0]).alias("entity"), F.array(*[F.col(c).cast("double") for c in df.columns[1:]]).alias("v"))
