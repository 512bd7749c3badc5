"""Features of sequences, as columns: composition, and composition-transition-distribution by groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The alphabet, and for seven attributes the letters of their three groups.
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
ATTRIBUTES = {
    "hydrophobicity": ("RKEDQN", "GASTPHY", "CLVIMFW"),
    "normalized_vdw_volume": ("GASTPDC", "NVEQIL", "MHKFRYW"),
    "polarity": ("LIFWCMVY", "PATGS", "HQRKNED"),
    "charge": ("KR", "ANCQGHILMFPSTWYV", "DE"),
    "secondary_structure": ("EALMQKRH", "VIYCWFT", "GNPSD"),
    "solvent_accessibility": ("ALFCGIVW", "RKQEND", "MSPTHY"),
    "polarizability": ("GASDT", "CPNVEQIL", "KMHFRYW"),
}
DIGITS = 6


def cleaned(seq: Column) -> Column:
    """The letters of the alphabet alone; one A if none is left."""
    kept = F.regexp_replace(F.coalesce(seq, F.lit("")), f"[^{ALPHABET}]", "")
    return F.when(kept == "", "A").otherwise(kept)


def letter_share(seq: Column, letters: str) -> Column:
    """The share of a sequence's letters that are among ``letters``."""
    rest = F.replace(seq, F.lit(letters), F.lit("")) if len(letters) == 1 else F.translate(seq, letters, "")
    return (F.length(seq) - F.length(rest)) / F.length(seq)


def composition(df: DataFrame) -> DataFrame:
    """(entity_id, feature, value): the share of each letter."""
    clean = df.select("entity_id", cleaned(F.col("seq")).alias("s"))
    each = [F.struct(F.lit(c).alias("feature"), F.round(letter_share(F.col("s"), c), DIGITS).alias("value")) for c in ALPHABET]
    return clean.select("entity_id", F.inline(F.array(*each)))


def group_codes(seq: Column, attribute: str) -> Column:
    """A sequence as the digits 1 to 3 of its letters' groups."""
    groups = ATTRIBUTES[attribute]
    return F.translate(seq, "".join(groups), "".join(str(i + 1) * len(g) for i, g in enumerate(groups)))


def ctd_composition(df: DataFrame) -> DataFrame:
    """(entity_id, feature, value): the share of each attribute's groups."""
    clean = df.select("entity_id", cleaned(F.col("seq")).alias("s"))
    each = [F.struct(F.lit(f"{a}_C{i + 1}").alias("feature"), F.round(letter_share(F.col("s"), g), DIGITS).alias("value")) for a, groups in ATTRIBUTES.items() for i, g in enumerate(groups)]
    return clean.select("entity_id", F.inline(F.array(*each)))


def _is_one_of(*texts: str):
    return lambda p: p.isin(*texts)


def ctd_transition(df: DataFrame) -> DataFrame:
    """(entity_id, feature, value): how often two groups stand side by side, among adjacent pairs.

    A run of one group becomes one digit, so changes are counted by replacing, without arrays."""
    clean = df.select("entity_id", cleaned(F.col("seq")).alias("s"))
    coded = clean.select("entity_id", F.length("s").alias("n"), *(group_codes(F.col("s"), a).alias(a) for a in ATTRIBUTES))
    each = []
    for a in ATTRIBUTES:
        for x, y in ("12", "13", "23"):
            runs = F.regexp_replace(F.col(a), "(.)\\1+", "$1")
            doubled = F.regexp_replace(runs, "(.)", "$1$1")  # every adjacent pair of runs stands apart
            n = F.size(F.filter(F.split(F.substring(doubled, 2, 1 << 30), "(?<=\\G..)"), _is_one_of(f"{x}{y}", f"{y}{x}")))
            each.append(F.struct(F.lit(f"{a}_T{x}{y}").alias("feature"), F.round(F.coalesce(F.try_divide(n, F.col("n") - 1), F.lit(0.0)), DIGITS).alias("value")))
    return coded.select("entity_id", F.inline(F.array(*each)))


def ctd_distribution(df: DataFrame) -> DataFrame:
    """(entity_id, feature, value): where the first, quarter, half, three quarter and last letter of a
    group stand, as an unrounded share of the length; 0 for an absent group.

    The place of a group's k-th letter is the length of what stands before it, found within the row."""
    clean = df.select("entity_id", cleaned(F.col("seq")).alias("s")).withColumn("n", F.length("s"))
    coded = F.array(*[F.struct(F.lit(a).alias("attribute"), group_codes(F.col("s"), a).alias("codes")) for a in ATTRIBUTES])
    digits = F.explode(F.array(*map(F.lit, "123"))).alias("digit")
    rows = clean.select("entity_id", "n", F.inline(coded)).select("*", digits)
    rows = rows.withColumn("c", F.col("n") - F.length(F.replace("codes", F.col("digit"), F.lit(""))))
    at = lambda k: F.length(F.expr(f"substring_index(codes, digit, cast({k} AS INT))")) + 1
    picks = [("000", "1"), ("025", "greatest(floor(c * 0.25D), 1)"), ("050", "greatest(floor(c * 0.5D), 1)"), ("075", "greatest(floor(c * 0.75D), 1)"), ("100", "c")]
    each = F.array(*[F.struct(F.lit(q).alias("q"), F.when(F.col("c") > 0, at(k) / F.col("n")).otherwise(F.lit(0.0)).alias("value")) for q, k in picks])
    return rows.select("entity_id", "attribute", "digit", F.inline(each)).select("entity_id", F.concat("attribute", F.lit("_D"), "digit", F.lit("_"), "q").alias("feature"), "value")


def chunks(df: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """(entity_id, chunk, weight, seq): pieces of ``size`` letters, each ``overlap`` into the one before;
    ``weight`` is a piece's own length. An empty sequence is one empty piece."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length("seq") - overlap - 1, F.lit(0)), F.lit(step))
    rows = df.select("entity_id", "seq", F.posexplode(starts).alias("chunk", "start"))
    piece = F.substring("seq", F.col("start") + 1, F.lit(size))
    return rows.select("entity_id", "chunk", F.length(piece).alias("weight"), piece.alias("seq"))


def letter_histogram(df: DataFrame) -> DataFrame:
    """(letter, n, share) over all sequences: counted within each sequence before the shuffle."""
    clean = df.select(cleaned(F.col("seq")).alias("s"))
    sums = clean.agg(F.sum(F.length("s")).alias("every"), *[F.sum(F.length("s") - F.length(F.replace("s", F.lit(c), F.lit("")))).alias(c) for c in ALPHABET])
    each = F.array(*[F.struct(F.lit(c).alias("letter"), F.col(c).alias("n")) for c in ALPHABET])
    return sums.select("every", F.inline(each)).select("letter", "n", F.round(F.try_divide("n", "every"), DIGITS).alias("share"))


def capped(seq: Column, cap: int = 1022, terminal: str = "N") -> Column:
    """The first (N) or last (C) ``cap`` letters."""
    return F.substring(seq, 1, cap) if terminal == "N" else F.right(seq, F.lit(cap))


# Hydropathy of Kyte and Doolittle, average masses of free amino acids, and of water.
HYDROPATHY = {"A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3}
MASS = {"A": 89.0932, "C": 121.1582, "D": 133.1027, "E": 147.1293, "F": 165.1891, "G": 75.0666, "H": 155.1546, "I": 131.1729, "K": 146.1876, "L": 131.1729, "M": 149.2113, "N": 132.1179, "P": 115.1305, "Q": 146.1445, "R": 174.201, "S": 105.0926, "T": 119.1192, "V": 117.1463, "W": 204.2252, "Y": 181.1885}
WATER = 18.0153
AROMATIC, HELIX, TURN, SHEET = "FWY", "EMALK", "NPGSD", "VIYFWLT"


def properties(df: DataFrame) -> DataFrame:
    """(entity_id, mass, aromaticity, hydropathy, helix, turn, sheet): weighted counts of letters."""
    clean = df.select("entity_id", cleaned(F.col("seq")).alias("s"))
    counted = clean.select("entity_id", "s", F.length("s").alias("n"), *[(F.length("s") - F.length(F.translate("s", c, ""))).alias(f"of_{c}") for c in ALPHABET])
    # whole numbers of the scales' last digit, so that sums are exact in any order
    weighted = lambda scale, unit: sum((F.col(f"of_{c}").cast("long") * round(scale[c] * unit) for c in ALPHABET), F.lit(0).cast("long"))
    share = lambda letters: F.round(letter_share(F.col("s"), letters), DIGITS)
    mass = (weighted(MASS, 10_000) - (F.col("n").cast("long") - 1) * round(WATER * 10_000)) / 10_000
    return counted.select("entity_id", mass.alias("mass"), share(AROMATIC).alias("aromaticity"), F.round(weighted(HYDROPATHY, 10) / (F.col("n") * 10), DIGITS).alias("hydropathy"), share(HELIX).alias("helix"), share(TURN).alias("turn"), share(SHEET).alias("sheet"))


# pK of the charged groups of a chain, positive and negative.
PK_POSITIVE = {"N_end": 7.5, "K": 10.0, "R": 12.0, "H": 5.98}
PK_NEGATIVE = {"C_end": 3.55, "D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
# pK of the ends of chains whose first, or last, letter has one of its own.
PK_FIRST = {"A": 7.59, "E": 7.7, "M": 7.0, "P": 8.36, "S": 6.93, "T": 6.82, "V": 7.44}
PK_LAST = {"D": 4.55, "E": 4.75}


@F.pandas_udf(T.DoubleType())
def isoelectric_point(k: pd.Series, r: pd.Series, h: pd.Series, d: pd.Series, e: pd.Series, c: pd.Series, y: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    """Where a chain with these counts of letters and pK of its ends carries no net charge, by bisection of all rows at once."""
    one = np.ones(len(k))
    positive = [(one, np.asarray(first)), (k, PK_POSITIVE["K"]), (r, PK_POSITIVE["R"]), (h, PK_POSITIVE["H"])]
    negative = [(one, np.asarray(last)), (d, PK_NEGATIVE["D"]), (e, PK_NEGATIVE["E"]), (c, PK_NEGATIVE["C"]), (y, PK_NEGATIVE["Y"])]
    low, step = np.zeros(len(k)), 7.0
    for _ in range(50):
        ph = low + step
        charge = sum(np.asarray(n) / (1 + 10 ** (ph - pk)) for n, pk in positive) - sum(np.asarray(n) / (1 + 10 ** (pk - ph)) for n, pk in negative)
        low, step = np.where(charge > 0, ph, low), step / 2
    return pd.Series(np.round(low + step, DIGITS))


def isoelectric_points(df: DataFrame) -> DataFrame:
    """(entity_id, isoelectric_point) from the counts of the letters that can be charged, and the end letters."""
    clean = df.select("entity_id", cleaned(F.col("seq")).alias("s"))
    n = [(F.length("s") - F.length(F.replace("s", F.lit(x), F.lit("")))).cast("long") for x in "KRHDECY"]
    end = lambda letter, own, other: F.coalesce(F.create_map(*[F.lit(v) for x in own.items() for v in x])[letter], F.lit(other))
    ends = end(F.left("s", F.lit(1)), PK_FIRST, PK_POSITIVE["N_end"]), end(F.right("s", F.lit(1)), PK_LAST, PK_NEGATIVE["C_end"])
    return clean.select("entity_id", isoelectric_point(*n, *ends).alias("isoelectric_point"))


def pair_index(df: DataFrame, weights: DataFrame, other: float = 0.0) -> DataFrame:
    """(entity_id, pair_index): ten times the weight of all letters that follow each other, over the length.

    ``weights`` (pair, weight) is a parameter, a row for each of the alphabet's pairs at most; pairs without a
    row weigh ``other``. With the published weights of letter pairs this is the instability index."""
    split = df.select("entity_id", F.split(cleaned(F.col("seq")), "").alias("l"))
    following = F.zip_with(F.slice("l", 1, F.size("l") - 1), F.slice("l", 2, F.size("l")), lambda x, y: F.concat(x, y))
    pairs = split.select("entity_id", F.size("l").alias("n"), following.alias("p")).select("entity_id", "n", F.explode_outer("p").alias("pair"))
    counts = pairs.groupBy("entity_id", "n", "pair").agg(F.count("pair").alias("times"))
    few = weights.groupBy("pair").agg(F.max("weight").cast("double").alias("weight")).filter(F.col("pair").rlike(f"^[{ALPHABET}]{{2}}$"))  # the alphabet's pairs alone
    each = counts.join(F.broadcast(few), "pair", "left").withColumn("weight", F.coalesce("weight", F.lit(float(other))))
    return each.groupBy("entity_id").agg(F.round(10 * F.sum(F.col("weight") * F.col("times")) / F.max("n"), DIGITS).alias("pair_index"))


def feature_names() -> list[str]:
    """All features in order: letters, then each attribute's composition, transition and distribution."""
    names = list(ALPHABET)
    for a in ATTRIBUTES:
        names += [f"{a}_C{d}" for d in "123"] + [f"{a}_T{p}" for p in ("12", "13", "23")]
        names += [f"{a}_D{d}_{q}" for d in "123" for q in ("000", "025", "050", "075", "100")]
    return names


def feature_vectors(df: DataFrame) -> DataFrame:
    """(entity, v): the 167 features of each entity as one array, in the order of their names."""
    long = composition(df).union(ctd_composition(df)).union(ctd_transition(df)).union(ctd_distribution(df))
    by_name = long.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m"))
    names = F.array(*[F.lit(n) for n in feature_names()])
    return by_name.select(F.col("entity_id").alias("entity"), F.transform(names, lambda n: F.col("m")[n]).alias("v"))
