"""Queries that make features of sequences, vectors and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgewright.functions import sequence, vectors
from edgewright.operators import audit, categories, metrics
from edgewright.plans.audit_queries import CANONICAL_SQL
from edgewright.plans.catalogue import query
from edgewright.sources import tables as t

LETTERS = sequence.ALPHABET
CLEAN = f"{t.SEQUENCES_SQL}, clean AS (SELECT entity_id, CASE WHEN r = '' THEN 'A' ELSE r END AS s FROM (SELECT entity_id, regexp_replace(coalesce(seq, ''), '[^{LETTERS}]', '', 'g') AS r FROM seqs))"
_CODED = " UNION ALL ".join(f"SELECT entity_id, length(s) AS n, '{a}' AS attribute, translate(s, '{''.join(g)}', '{''.join(str(i + 1) * len(x) for i, x in enumerate(g))}') AS codes FROM clean" for a, g in sequence.ATTRIBUTES.items())
CODED = f"{CLEAN}, coded AS ({_CODED})"


@query("letter_composition", f"WITH {CLEAN}, f AS (SELECT unnest(string_split('{','.join(LETTERS)}', ',')) AS feature) SELECT entity_id, feature, round((length(s) - length(replace(s, feature, ''))) / length(s), 6) AS value FROM clean, f")
def letter_composition(spark, sf_dir):
    return sequence.composition(t.sequences(spark, sf_dir))


@query("ctd_composition", f"WITH {CODED}, d AS (SELECT unnest(['1', '2', '3']) AS digit) SELECT entity_id, attribute || '_C' || digit AS feature, round((n - length(replace(codes, digit, ''))) / n, 6) AS value FROM coded, d")
def ctd_composition(spark, sf_dir):
    return sequence.ctd_composition(t.sequences(spark, sf_dir))


@query("ctd_transition", f"""WITH {CODED}, p AS (SELECT entity_id, n, attribute, list_transform(range(1, n), lambda i: substr(codes, i, 2)) AS pairs FROM coded), d AS (SELECT unnest(['12', '13', '23']) AS digits)
SELECT entity_id, attribute || '_T' || digits AS feature, CASE WHEN n > 1 THEN round(len(list_filter(pairs, lambda x: x = digits OR x = reverse(digits))) / (n - 1), 6) ELSE 0 END AS value FROM p, d""")
def ctd_transition(spark, sf_dir):
    return sequence.ctd_transition(t.sequences(spark, sf_dir))


@query("ctd_distribution", f"""WITH {CODED}, d AS (SELECT unnest(['1', '2', '3']) AS digit), p AS (
  SELECT entity_id, n, attribute, digit, list_filter(range(1, n + 1), lambda i: substr(codes, i, 1) = digit) AS places FROM coded, d
), q AS (SELECT * FROM (VALUES ('000', 0.0), ('025', 0.25), ('050', 0.5), ('075', 0.75), ('100', 1.0)) v(q, share))
SELECT entity_id, attribute || '_D' || digit || '_' || q AS feature, CASE WHEN len(places) = 0 THEN 0 ELSE places[greatest(floor(len(places) * share), 1)::INTEGER] / n END AS value FROM p, q""")
def ctd_distribution(spark, sf_dir):
    return sequence.ctd_distribution(t.sequences(spark, sf_dir))


@query("letter_histogram", f"WITH {CLEAN}, f AS (SELECT unnest(string_split('{','.join(LETTERS)}', ',')) AS letter), n AS (SELECT letter, sum(length(s) - length(replace(s, letter, '')))::BIGINT AS n, sum(length(s)) AS every FROM clean, f GROUP BY letter) SELECT letter, n, round(n / every, 6) AS share FROM n")
def letter_histogram(spark, sf_dir):
    return sequence.letter_histogram(t.sequences(spark, sf_dir))


def _weighted(scale: dict[str, float], unit: int) -> str:
    return " + ".join(f"(length(s) - length(replace(s, '{c}', ''))) * {round(x * unit)}" for c, x in scale.items())


def _share(letters: str) -> str:
    return f"round((length(s) - length(translate(s, '{letters}', ''))) / length(s), 6)"


@query("sequence_properties", f"""WITH {CLEAN} SELECT entity_id, ({_weighted(sequence.MASS, 10_000)} - (length(s) - 1) * {round(sequence.WATER * 10_000)}) / 10000 AS mass, {_share(sequence.AROMATIC)} AS aromaticity,
  round(({_weighted(sequence.HYDROPATHY, 10)}) / (length(s) * 10), 6) AS hydropathy, {_share(sequence.HELIX)} AS helix, {_share(sequence.TURN)} AS turn, {_share(sequence.SHEET)} AS sheet FROM clean""")
def sequence_properties(spark, sf_dir):
    return sequence.properties(t.sequences(spark, sf_dir))


PAIRS = "pairs AS (SELECT x.vec_id AS a, y.vec_id AS b, x.embedding::DOUBLE[] AS u, y.embedding::DOUBLE[] AS v FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)"
_IN_SQL = {
    "sum": "list_transform(range(1, len(u) + 1), lambda i: u[i] + v[i])",
    "abs_diff": "list_transform(range(1, len(u) + 1), lambda i: abs(u[i] - v[i]))",
    "product": "list_transform(range(1, len(u) + 1), lambda i: u[i] * v[i])",
    "joined": "list_concat(u, v)",
}
_IN_SQL["diff_product"] = f"list_concat({_IN_SQL['abs_diff']}, {_IN_SQL['product']})"
_IN_SQL["combined"] = f"list_concat({_IN_SQL['sum']}, {_IN_SQL['diff_product']})"


def vector_pairs(spark, sf_dir):
    """Pairs (a, b) of vectors with neighbouring ids, and the vectors as doubles."""
    v = t.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity"), F.col("embedding").cast("array<double>").alias("v"), "label")
    pairs = v.select(F.col("entity").alias("a"), (F.col("entity") + 1).alias("b"), F.col("label").alias("of_a")).join(v.select(F.col("entity").alias("b"), F.col("label").alias("of_b")), "b")
    return pairs.select("a", "b", (F.col("of_a") == F.col("of_b")).cast("int").alias("label")), v.select("entity", "v")


def _fusion(kind: str) -> None:
    @query(f"pair_{kind}", f"WITH {PAIRS}, f AS (SELECT a, b, {_IN_SQL[kind]} AS feat FROM pairs) SELECT a, b, i - 1 AS place, round(feat[i], 6) AS value FROM f, unnest(range(1, len(feat) + 1)) t(i)")
    def run(spark, sf_dir):
        pairs, v = vector_pairs(spark, sf_dir)
        fused = vectors.fuse(pairs, v, kind)
        return fused.select("a", "b", F.posexplode("feat").alias("place", "value")).select("a", "b", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


for _kind in vectors.FUSIONS:
    _fusion(_kind)


@query("scalar_pair_features", f"""WITH {t.PART_PAIRS_SQL} SELECT a, b, x.p_size + y.p_size AS total, abs(x.p_size - y.p_size) AS gap, least(x.p_size, y.p_size) AS low, greatest(x.p_size, y.p_size) AS high
FROM edges JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b""")
def scalar_pair_features(spark, sf_dir):
    part = t.table(spark, sf_dir, "part")
    left, right = (part.select(F.col("p_partkey").alias(x), F.col("p_size").alias(f"size_{x}")) for x in ("a", "b"))
    joined = t.part_pairs(spark, sf_dir).join(left, "a").join(right, "b")
    return joined.select("a", "b", *vectors.scalar_features(F.col("size_a"), F.col("size_b")))


USERS = "c AS (SELECT c_custkey::VARCHAR AS entity_id, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 3 > 0 LEFT JOIN region ON r_regionkey = c_nationkey % 5 AND r_regionkey % 2 = 0)"


def categorized(spark, sf_dir):
    """(entity_id, category, source) of customers: a nation, else a region, else none."""
    c = t.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"), "c_nationkey")
    nation = t.table(spark, sf_dir, "nation").filter("n_nationkey % 3 > 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    region = t.table(spark, sf_dir, "region").filter("r_regionkey % 2 = 0").select(F.col("r_regionkey").alias("r"), "r_name")
    joined = c.join(nation, "c_nationkey", "left").withColumn("r", F.col("c_nationkey") % 5).join(region, "r", "left")
    category, source = categories.first_source({"nation": F.col("n_name"), "region": F.col("r_name")})
    return joined.select("entity_id", category.alias("category"), source.alias("source"))


@query("category_by_priority", f"WITH {USERS} SELECT entity_id, coalesce(n_name, r_name) AS category, CASE WHEN n_name IS NOT NULL THEN 'nation' WHEN r_name IS NOT NULL THEN 'region' END AS source FROM c")
def category_by_priority(spark, sf_dir):
    return categorized(spark, sf_dir)


@query("category_imputed", """WITH d AS (SELECT doc_id AS entity_id, md5(text) AS seq, CASE WHEN doc_id % 2 = 0 THEN lang END AS category FROM documents),
p AS (SELECT seq, min(category) AS peer FROM d WHERE category IS NOT NULL GROUP BY seq HAVING count(DISTINCT category) = 1)
SELECT entity_id, coalesce(category, peer) AS category, category IS NULL AND peer IS NOT NULL AS imputed FROM d LEFT JOIN p USING (seq)""")
def category_imputed(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    known = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    return categories.imputed(docs.select(F.col("doc_id").alias("entity_id"), F.md5(F.col("text").cast("binary")).alias("seq"), known.alias("category")))


KINDS = f"""{CANONICAL_SQL}, {USERS}, cat AS (SELECT entity_id, coalesce(n_name, r_name) AS category FROM c), kinds AS (
  SELECT a, b, label, CASE WHEN x.category IS NULL OR y.category IS NULL THEN 'unresolved' WHEN x.category = y.category THEN x.category ELSE 'different' END AS kind
  FROM canonical LEFT JOIN cat x ON x.entity_id = a LEFT JOIN cat y ON y.entity_id = b
)"""


def kinds(spark, sf_dir):
    return categories.pair_categories(audit.canonical(t.event_pairs(spark, sf_dir)), categorized(spark, sf_dir))


@query("pair_category_pivot", f"WITH {KINDS} SELECT kind, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1 FROM kinds GROUP BY kind")
def pair_category_pivot(spark, sf_dir):
    return categories.by_label(kinds(spark, sf_dir))


@query("same_category_auc", f"""WITH {KINDS}, s AS (SELECT label AS y, (kind <> 'different')::INT AS p FROM kinds WHERE kind <> 'unresolved'), sums AS (SELECT sum(y * p) AS tp, sum((1 - y) * p) AS fp, sum(y * (1 - p)) AS fn, sum((1 - y) * (1 - p)) AS tn FROM s)
SELECT 'all' AS grp, round((tp * tn + (tp * fp + fn * tn) / 2) / ((tp + fn) * (fp + tn)), 6) AS roc_auc FROM sums""")
def same_category_auc(spark, sf_dir):
    return metrics.roc_auc(categories.same_category_scores(kinds(spark, sf_dir)))
