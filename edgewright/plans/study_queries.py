"""Studies put together from the operators: split audits, matched sets, differences, sweeps, cross-validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from edgewright.functions import sequence, vectors
from edgewright.functions.draws import uniform, uniform_sql
from edgewright.operators import graph, inference, metrics, models, negatives, splits, stats
from edgewright.operators.ranges import checkpointed, quantiles
from edgewright.plans import graph_queries, inference_queries, split_queries
from edgewright.plans.audit_queries import CANONICAL_SQL
from edgewright.plans.catalogue import query
from edgewright.plans.inference_queries import AUC, BOOT, COMPONENTS, REPLICATES
from edgewright.sources import tables as t

U = uniform_sql
#: A supplied split: event pairs as they come, every fifth by number for testing.
SUPPLIED = f"""{t.EVENT_PAIRS_SQL}, split AS (SELECT CASE WHEN ord % 5 = 0 THEN 'test' ELSE 'train' END AS side, a, b, label FROM raw)"""


def supplied(spark, sf_dir):
    side = F.when(F.col("ord") % 5 == 0, "test").otherwise("train").alias("side")
    return t.event_pairs(spark, sf_dir).select(side, "a", "b", "label")


@query("split_overlap", f"""WITH {SUPPLIED}, p AS (SELECT DISTINCT a, b FROM split WHERE side = 'test'), tr AS (SELECT DISTINCT a, b FROM split WHERE side = 'train'),
m AS (SELECT p.*, x.a IS NOT NULL AS s, y.a IS NOT NULL AS r FROM p LEFT JOIN tr x ON x.a = p.a AND x.b = p.b LEFT JOIN tr y ON y.a = p.b AND y.b = p.a AND y.a <> y.b),
e AS (SELECT side, unnest([a, b]) AS entity FROM split), te AS (SELECT DISTINCT entity FROM e WHERE side = 'test')
SELECT count(*) AS test_pairs, count(*) FILTER (s) AS same, count(*) FILTER (r) AS reversed, count(*) FILTER (s OR r) AS either, (SELECT count(*) FROM te) AS test_entities,
  (SELECT count(*) FROM te WHERE entity IN (SELECT entity FROM e WHERE side = 'train')) AS shared_entities FROM m""")
def split_overlap(spark, sf_dir):
    return splits.overlap(supplied(spark, sf_dir))


CLUSTERS = "c AS (SELECT threshold, entity, right(entity, threshold) AS grp FROM (SELECT DISTINCT unnest([a, b]) AS entity FROM raw), (SELECT unnest([1, 2, 3])::INTEGER AS threshold))"


@query("split_integrity", f"""WITH {SUPPLIED}, {CLUSTERS}, e AS (SELECT DISTINCT side, unnest([a, b]) AS entity FROM split),
g AS (SELECT threshold, grp, count(*) FILTER (side = 'train') AS x, count(*) FILTER (side = 'test') AS y FROM e JOIN c USING (entity) GROUP BY ALL)
SELECT threshold, count(*) AS groups, count(*) FILTER (x > 0 AND y > 0) AS shared_groups, sum(y)::BIGINT AS test_entities, round(sum(y) FILTER (x > 0 AND y > 0) / sum(y), 6) AS leaking_share FROM g GROUP BY threshold""")
def split_integrity(spark, sf_dir):
    """Clusters at three thresholds: users whose last one, two or three digits agree."""
    split = supplied(spark, sf_dir)
    entities = split.select(F.explode(F.array("a", "b")).alias("entity")).distinct()
    grp = F.expr("right(entity, threshold)").alias("grp")
    return splits.integrity(split, entities.withColumn("threshold", F.explode(F.array(*map(F.lit, (1, 2, 3))))).select("threshold", "entity", grp))


def _shared(column: str, keyed: str) -> str:
    return f"{column} AS (SELECT name, count(*) AS n FROM (SELECT name, key FROM ({keyed}) GROUP BY name, key HAVING count(DISTINCT side) = 2) GROUP BY name)"


_AUDITED = {
    "shared_entities": "SELECT name, side, entity AS key FROM e", "shared_sequences": "SELECT name, side, text AS key FROM e JOIN documents ON doc_id::VARCHAR = entity WHERE text IS NOT NULL",
    "shared_clusters": "SELECT e.name, side, grp AS key FROM e JOIN c ON c.threshold = e.name AND c.entity = e.entity", "shared_pairs": "SELECT name, side, least(a, b) || '|' || greatest(a, b) AS key FROM named",
}


@query("split_integrity_audit", f"""WITH {SUPPLIED}, {CLUSTERS}, named AS (SELECT t.name, split.* FROM split, (VALUES (1), (2), (3)) t(name)),
e AS (SELECT DISTINCT name, side, unnest([a, b]) AS entity FROM named), {', '.join(_shared(k, v) for k, v in _AUDITED.items())},
p AS (SELECT name, count(*) FILTER (side = 'train') AS train_pairs, count(*) FILTER (side = 'test') AS test_pairs FROM named GROUP BY name),
n AS (SELECT name, count(*) FILTER (side = 'train') AS train_entities, count(*) FILTER (side = 'test') AS test_entities FROM e GROUP BY name)
SELECT p.name, train_pairs, test_pairs, train_entities, test_entities, {', '.join(f'coalesce({k}.n, 0) AS {k}' for k in _AUDITED)}, {' + '.join(f'coalesce({k}.n, 0)' for k in _AUDITED)} = 0 AS passed
FROM p JOIN n USING (name) {' '.join(f'LEFT JOIN {k} ON {k}.name = p.name' for k in _AUDITED)}""")
def split_integrity_audit(spark, sf_dir):
    """What both sides of the supplied split have, with users in clusters of equal last digits, and documents as their sequences."""
    split = supplied(spark, sf_dir).select("side", "a", "b")
    name = F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("name")
    ends = split.select(F.explode(F.array("a", "b")).alias("entity")).distinct()
    clusters = ends.select("entity", name).select("name", "entity", F.expr("right(entity, name)").alias("grp"))
    texts = t.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("entity"), F.col("text").alias("seq"))
    return splits.integrity_audit(split.select("*", name), clusters, texts)


@query("grouped_share", f"""WITH {t.SEQUENCES_SQL}, g AS (SELECT seq, count(*) AS n FROM seqs WHERE seq IS NOT NULL GROUP BY seq)
SELECT sum(n)::BIGINT AS members, count(*) AS groups, round(coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 6) AS share_not_alone FROM g""")
def grouped_share(spark, sf_dir):
    return splits.grouped_share(t.sequences(spark, sf_dir).filter("seq IS NOT NULL").select(F.col("entity_id").alias("entity"), F.col("seq").alias("grp")))


@query("early_stopping_holdout", f"WITH {CANONICAL_SQL} SELECT a, b, label, {U(42, 'label', 'a', 'b')} < 0.15 AS held FROM canonical")
def early_stopping_holdout(spark, sf_dir):
    return splits.holdout(split_queries.canonical(spark, sf_dir), ["a", "b"])


@query("weighted_choice", f"SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > 0 ORDER BY -ln(greatest({U(42, 'p_partkey')}, {2.0**-49})) / p_retailprice, p_partkey LIMIT 25")
def weighted_choice(spark, sf_dir):
    return splits.weighted_choice(t.table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_partkey", "p_retailprice", 25)


@query("train_only_degrees", f"""WITH {CANONICAL_SQL}, s AS (SELECT {U(42, 'label', 'a', 'b')} >= 0.2 AS train, a, b FROM canonical WHERE label = 1), e AS (SELECT train, unnest([a, b]) AS entity FROM s)
SELECT entity, count(*) AS degree, count(*) FILTER (train) AS train_degree FROM e GROUP BY entity""")
def train_only_degrees(spark, sf_dir):
    return splits.train_degrees(splits.random_split(split_queries.canonical(spark, sf_dir)))


@query("negatives_N0", f"WITH {CANONICAL_SQL} SELECT 'N0' AS set_name, a, b, label FROM canonical WHERE label = 0")
def negatives_n0(spark, sf_dir):
    """The negatives that the pairs come with."""
    return split_queries.canonical(spark, sf_dir).filter("label = 0").select(F.lit("N0").alias("set_name"), "a", "b", "label")


SEEDS = list(range(1000, 1030))


@query("seed_sweep", f"WITH {t.PART_PAIRS_SQL}, n AS (SELECT count(*) AS n FROM edges) SELECT seed::INTEGER AS seed, n, n AS different, 0::BIGINT AS known FROM n, range({SEEDS[0]}, {SEEDS[-1] + 1}) r(seed)")
def seed_sweep(spark, sf_dir):
    """Degree-matched sets of thirty seeds: each serves every positive, and holds none twice."""
    pairs = checkpointed(t.part_pairs(spark, sf_dir))

    def counted(made):
        known = made.join(pairs.withColumn("known", F.lit(1)), ["a", "b"], "left")
        each = known.groupBy("seed", "a", "b").agg(F.count("*").alias("n"), F.count("known").alias("known"))
        return each.groupBy("seed").agg(F.sum("n").alias("n"), F.count("*").alias("different"), F.sum("known").alias("known"))

    return negatives.swept(pairs, split_queries.strata(spark, sf_dir, "degree", pairs), "N2", SEEDS, counted)


@query("seed_sweep_summary")
def seed_sweep_summary(spark, sf_dir):
    """Mean, deviation, least and greatest over seeds of the mean degree at ends of degree-matched sets."""
    pairs = checkpointed(t.part_pairs(spark, sf_dir))
    degree = checkpointed(graph.degrees(pairs.withColumn("label", F.lit(1))).select(F.col("node").alias("entity"), F.col("total_degree").alias("x")))

    def mean(made):
        ends = made.select("seed", F.explode(F.array("a", "b")).alias("entity")).join(degree, "entity", "left")
        return ends.groupBy("seed").agg(F.avg(F.coalesce("x", F.lit(0))).alias("m"))

    each = negatives.swept(pairs, split_queries.strata(spark, sf_dir, "degree", pairs), "N2", SEEDS, mean)
    return each.agg(F.count("*").alias("seeds"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("sd"), F.round(F.min("m"), 6).alias("low"), F.round(F.max("m"), 6).alias("high"))


@query("dataset_builders", f"""WITH {t.PART_PAIRS_SQL}, n AS (SELECT count(*) AS n FROM edges), s AS (SELECT unnest(['N2', 'N5']) AS set_name)
SELECT 'R0' AS regime, 'positives' AS set_name, 1 AS label, n FROM n UNION ALL SELECT 'R0', set_name, 0, n FROM s, n""")
def dataset_builders(spark, sf_dir):
    """R0 with each set: as many negatives as positives."""
    return _built(spark, sf_dir, "R0").groupBy("regime", "set_name", "label").agg(F.count("*").alias("n"))


def _built(spark, sf_dir, regime):
    pairs = checkpointed(t.part_pairs(spark, sf_dir)).withColumn("label", F.lit(1))
    pooled = splits.pools(t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("grp")))
    strata = {kind: split_queries.strata(spark, sf_dir, kind, pairs.select("a", "b")) for kind in ("degree", "degree_length")}

    def sets(positives, candidates):
        n2, n5 = (negatives.matched(positives, strata[kind], name, candidates=candidates) for name, kind in (("N2", "degree"), ("N5", "degree_length")))
        return n2.union(n5)

    return splits.datasets(pairs, pooled, sets, regimes=(regime,))


@query("dataset_builders_by_pool")
def dataset_builders_by_pool(spark, sf_dir):
    """R3 by side and set, and how many ends of a set's negatives lie outside the pool of its side (0)."""
    pooled = splits.pools(t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("grp")))
    rows = _built(spark, sf_dir, "R3")
    ends = rows.select("set_name", "side", "label", F.explode(F.array("a", "b")).alias("entity")).join(pooled, "entity")
    return ends.groupBy("set_name", "side", "label").agg(F.count("*").alias("ends"), F.count_if(F.col("pool") != F.col("side")).alias("outside"))


@query("distinct_entity_description", f"""WITH {graph_queries.POOLED.replace("SELECT 'reference' AS set_name, degree AS x FROM ends JOIN degree USING (node)", "SELECT 'reference' AS set_name, degree AS x FROM degree").replace("SELECT unnest([p_partkey, p_partkey + 1]) AS node FROM part WHERE p_partkey % 3 = 0", "SELECT DISTINCT unnest([p_partkey, p_partkey + 1]) AS node FROM part WHERE p_partkey % 3 = 0")}
SELECT set_name, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, quantile_cont(x, .25) AS q1, quantile_cont(x, .5) AS median, quantile_cont(x, .75) AS q3, min(x) AS low, max(x) AS high FROM pooled GROUP BY set_name""")
def distinct_entity_description(spark, sf_dir):
    """Degrees of entities, each counted once however many pairs name it."""
    pairs, other, degree = _sides(spark, sf_dir)
    ends = pairs.union(other).select("set_name", F.explode(F.array("a", "b")).alias("entity_id")).distinct()
    return stats.describe(ends.join(degree, "entity_id", "left").select("set_name", F.coalesce("x", F.lit(0)).alias("x")))


def _sides(spark, sf_dir):
    pairs = t.part_pairs(spark, sf_dir)
    degree = graph.degrees(pairs.withColumn("label", F.lit(1))).select(F.col("node").alias("entity_id"), F.col("total_degree").alias("x"))
    other = t.table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.lit("part_mod").alias("set_name"), F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    return pairs.select(F.lit("reference").alias("set_name"), "a", "b"), other, degree


@query("balance_medians", f"WITH {graph_queries.POOLED}, m AS (SELECT set_name, median(x) AS m FROM pooled GROUP BY set_name) SELECT x.set_name, r.m AS median_reference, x.m AS median, r.m - x.m AS gap FROM m x, m r WHERE r.set_name = 'reference' AND x.set_name <> 'reference'")
def balance_medians(spark, sf_dir):
    m = quantiles(graph_queries.pooled(spark, sf_dir), ["set_name"], "x", [0.5], "q").select("set_name", F.col("q")[0].alias("median"))
    ref = m.filter("set_name = 'reference'").select(F.col("median").alias("median_reference"))
    return m.filter("set_name <> 'reference'").join(ref).select("set_name", "median_reference", "median", (F.col("median_reference") - F.col("median")).alias("gap"))  # one row of the reference


@query("ks_p_value", f"""WITH {graph_queries.POOLED}, spine AS (SELECT DISTINCT x FROM pooled), n AS (SELECT count(*) FILTER (set_name = 'reference') AS n, count(*) FILTER (set_name <> 'reference') AS m FROM pooled),
f AS (SELECT (SELECT avg((p.x <= s.x)::INT) FROM pooled p WHERE set_name = 'reference') - (SELECT avg((p.x <= s.x)::INT) FROM pooled p WHERE set_name <> 'reference') AS gap FROM spine s),
z AS (SELECT max(abs(gap)) AS ks, sqrt(any_value(n) * any_value(m) / (any_value(n) + any_value(m))) AS root FROM f, n), y AS (SELECT ks, (root + 0.12 + 0.11 / root) * round(ks, 6) AS v FROM z)
SELECT 'part_mod' AS set_name, round(ks, 6) AS ks, round(CASE WHEN v < 0.2 THEN 1 ELSE least(1, greatest(0, list_sum([2 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * v * v) for k in range(1, 101)]))) END, 9) AS p_value FROM y""")
def ks_p_value(spark, sf_dir):
    pooled = checkpointed(graph_queries.pooled(spark, sf_dir))
    n = pooled.agg(F.count_if(F.col("set_name") == "reference").alias("n"), F.count_if(F.col("set_name") != "reference").alias("m"))
    return stats.compare(pooled, "reference").join(n).select("set_name", "ks", F.round(inference.kolmogorov_p(F.col("ks"), F.col("n"), F.col("m")), 9).alias("p_value"))  # one row each


@query("mean_degree_bootstrap")
def mean_degree_bootstrap(spark, sf_dir):
    """The difference of mean degrees of two sets, over components of the graph of both drawn together."""
    pairs, other, degree = _sides(spark, sf_dir)
    both = checkpointed(pairs.union(other))
    labels = graph.components(both.select("a", "b")).select(F.col("node").alias("entity_id"), "component")
    ends = both.select((F.col("set_name") != "reference").cast("int").alias("side"), F.explode(F.array("a", "b")).alias("entity_id"))
    rows = ends.join(labels, "entity_id").join(degree, "entity_id", "left").select("component", "side", F.coalesce("x", F.lit(0)).alias("x"))
    return inference.weighted_mean_bootstrap(rows, REPLICATES)


@query("unpaired_bootstrap_difference", f"""WITH {BOOT}, rows2 AS (SELECT replicate, y, 1 - p * p AS p FROM rows WHERE y IS NOT NULL),
boot2 AS (SELECT replicate, {AUC} AS roc_auc FROM (SELECT *, rank() OVER (PARTITION BY replicate ORDER BY p) + (count(*) OVER (PARTITION BY replicate, p) - 1) / 2 AS r FROM rows2) GROUP BY replicate),
x AS (SELECT roc_auc, row_number() OVER (ORDER BY replicate) AS place FROM boot WHERE roc_auc IS NOT NULL), y AS (SELECT roc_auc, row_number() OVER (ORDER BY replicate DESC) AS place FROM boot2 WHERE roc_auc IS NOT NULL)
SELECT place, round(round(x.roc_auc, 6) - round(y.roc_auc, 6), 6) AS difference FROM x JOIN y USING (place)""")
def unpaired_bootstrap_difference(spark, sf_dir):
    """Two scores in replicates that aren't the same ones: the other's are numbered from the last."""
    rows = inference_queries.scored(spark, sf_dir)
    first, other = inference.bootstrap_pair(rows, rows.withColumn("p", 1 - F.col("p") * F.col("p")), REPLICATES)
    return inference.unpaired_difference(first, other.withColumn("replicate", -F.col("replicate")))


L2 = f"""l1 AS (SELECT component, {AUC} AS v FROM (SELECT *, rank() OVER (PARTITION BY component ORDER BY p) + (count(*) OVER (PARTITION BY component, p) - 1) / 2 AS r FROM rest) GROUP BY component),
l2 AS (SELECT component, {AUC} AS v FROM (SELECT component, y, rank() OVER (PARTITION BY component ORDER BY q) + (count(*) OVER (PARTITION BY component, q) - 1) / 2 AS r FROM rest) GROUP BY component),
f1 AS (SELECT {AUC} AS e FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM s2)), f2 AS (SELECT {AUC} AS e FROM (SELECT y, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2 AS r FROM s2))"""


@query("paired_jackknife_difference", f"""WITH {COMPONENTS}, s2 AS (SELECT *, CASE WHEN p > 0.2 THEN 1.0 ELSE p END AS q FROM s), rest AS (SELECT c.component, s2.y, s2.p, s2.q FROM comps c JOIN s2 ON s2.component <> c.component), {L2}
SELECT count(*) AS components, any_value(round(round(f1.e, 6) - round(f2.e, 6), 6)) AS difference, round((count(*) - 1) * var_pop(l1.v - l2.v), 12) AS variance FROM l1 JOIN l2 USING (component), f1, f2 WHERE l1.v IS NOT NULL AND l2.v IS NOT NULL""")
def paired_jackknife_difference(spark, sf_dir):
    return _paired(spark, sf_dir)


def _paired(spark, sf_dir):
    rows = inference_queries.scored(spark, sf_dir)
    return inference.paired_jackknife(rows, rows.withColumn("p", F.when(F.col("p") > 0.2, 1.0).otherwise(F.col("p"))))


@query("paired_jackknife_p_value")
def paired_jackknife_p_value(spark, sf_dir):
    one = _paired(spark, sf_dir).withColumn("se", F.sqrt("variance"))
    return one.select("components", "difference", "se", inference.t_p_value("difference", "se", (F.col("components") - 1).cast("double")).alias("p_value"))


@query("test_families")
def test_families(spark, sf_dir):
    """Tests of three kinds in one table, adjusted within their family, with how many of each reject."""
    rows = inference_queries.scored(spark, sf_dir)
    boot = inference.interval(inference.bootstrap(rows, REPLICATES)).select(F.lit("bootstrap").alias("family"), F.lit(0).alias("test"), F.col("p_value").alias("p"))
    jack = inference.jackknife(rows).withColumn("t", inference.t_interval("full_auc", "variance", "components")).select(F.lit("jackknife").alias("family"), F.lit(0).alias("test"), F.col("t.p_value").alias("p"))
    pair = paired_jackknife_p_value(spark, sf_dir).select(F.lit("paired").alias("family"), F.lit(0).alias("test"), F.col("p_value").alias("p"))
    done = inference.adjusted(boot.union(jack).union(pair))
    return done.groupBy("family").agg(F.count("*").alias("tests"), F.count_if("reject").alias("rejected"), F.min("p_adj").alias("least"))


@query("component_giant_flags", f"""WITH {inference_queries.LOCO}, size AS (SELECT component, count(*) AS n FROM s GROUP BY component)
SELECT component, n_left, round(roc_auc, 6) AS roc_auc, component = (SELECT component FROM size ORDER BY n DESC, component LIMIT 1) AS is_giant FROM loco""")
def component_giant_flags(spark, sf_dir):
    """Leave-one-component-out with the component of most pairs told."""
    rows = inference_queries.scored(spark, sf_dir)
    size = rows.groupBy("component").agg(F.count("*").alias("n"))
    giant = size.agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("giant"))
    left = inference.without_each(rows).join(F.broadcast(giant))  # one row
    return left.select("component", "n_left", F.round("roc_auc", 6).alias("roc_auc"), (F.col("component") == F.col("giant")).alias("is_giant"))


@query("ece_frequency_sensitivity", f"""WITH {t.SCORED_ITEMS_SQL}, b AS (SELECT unnest([5, 10, 15, 20])::INTEGER AS bins),
e AS (SELECT grp, bins, list_distinct(quantile_cont(p, list_transform(range(0, 21), lambda i: i / 20))) AS at20, list_distinct(quantile_cont(p, list_transform(range(0, 6), lambda i: i / 5))) AS at5, list_distinct(quantile_cont(p, list_transform(range(0, 11), lambda i: i / 10))) AS at10, list_distinct(quantile_cont(p, list_transform(range(0, 16), lambda i: i / 15))) AS at15 FROM scored, b GROUP BY grp, bins),
c AS (SELECT grp, bins, CASE bins WHEN 5 THEN at5 WHEN 10 THEN at10 WHEN 15 THEN at15 ELSE at20 END AS edges FROM e),
d AS (SELECT s.grp, bins, p, y, greatest(0, len(list_filter(edges, lambda x: x < p)) - 1) AS bin FROM scored s JOIN c USING (grp)), g AS (SELECT grp, bins, bin, count(*) AS n, avg(p) AS conf, avg(y) AS acc FROM d GROUP BY ALL)
SELECT grp, bins, round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece FROM g GROUP BY grp, bins""")
def ece_frequency_sensitivity(spark, sf_dir):
    return metrics.ece_frequencies(t.scored_items(spark, sf_dir), (5, 10, 15, 20))


@query("weighted_vector_means", """WITH e AS (SELECT label, 1 + vec_id % 5 AS w, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings)
SELECT label AS entity, place::INTEGER AS place, round(sum(w * x::DOUBLE) / sum(w), 9) AS x FROM e GROUP BY label, place""")
def weighted_vector_means(spark, sf_dir):
    rows = t.table(spark, sf_dir, "embeddings").select(F.col("label").alias("entity"), (1 + F.col("vec_id") % 5).alias("weight"), F.col("embedding").cast("array<double>").alias("v"))
    return vectors.weighted_means(rows, ["entity"]).withColumn("x", F.round("x", 9))


@query("overlaid_vectors", "SELECT vec_id AS entity, CASE WHEN vec_id % 7 = 0 THEN -embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END AS first, vec_id % 7 = 0 AS replaced FROM embeddings")
def overlaid_vectors(spark, sf_dir):
    v = t.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity"), F.col("embedding").cast("array<double>").alias("v"))
    other = v.filter("entity % 7 = 0").withColumn("v", F.transform("v", lambda x: -x))
    return vectors.overlaid(v, other).select("entity", F.col("v")[0].alias("first"), "replaced")


@query("sequence_chunks", f"""WITH {t.SEQUENCES_SQL}, s AS (SELECT entity_id, coalesce(seq, '') AS seq FROM seqs), c AS (SELECT entity_id, seq, unnest(range(0, greatest(length(seq) - 100, 1), 900)) AS start FROM s)
SELECT entity_id, (start // 900)::INTEGER AS chunk, length(substr(seq, start + 1, 1000))::INTEGER AS weight, md5(substr(seq, start + 1, 1000)) AS digest FROM c""")
def sequence_chunks(spark, sf_dir):
    rows = t.sequences(spark, sf_dir).withColumn("seq", F.coalesce("seq", F.lit("")))
    return sequence.chunks(rows, 1000, 100).select("entity_id", "chunk", "weight", F.md5("seq").alias("digest"))


_PK = {"first": "CASE left(s, 1) " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in sequence.PK_FIRST.items()) + f" ELSE {sequence.PK_POSITIVE['N_end']} END", "last": "CASE right(s, 1) " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in sequence.PK_LAST.items()) + f" ELSE {sequence.PK_NEGATIVE['C_end']} END"}
_TIMES = lambda c: f"(length(s) - length(replace(s, '{c}', '')))"
_CHARGE = " + ".join(["1 / (1 + pow(10::DOUBLE, low + w - pk_first))", *(f"of_{c} / (1 + pow(10::DOUBLE, low + w - {sequence.PK_POSITIVE[c]}))" for c in "KRH")]) + "".join([" - 1 / (1 + pow(10::DOUBLE, pk_last - low - w))", *(f" - of_{c} / (1 + pow(10::DOUBLE, {sequence.PK_NEGATIVE[c]} - low - w))" for c in "DECY")])


@query("isoelectric_points", f"""WITH {t.SEQUENCES_SQL}, kept AS (SELECT entity_id, CASE WHEN x = '' THEN 'A' ELSE x END AS s FROM (SELECT entity_id, regexp_replace(coalesce(seq, ''), '[^{sequence.ALPHABET}]', '', 'g') AS x FROM seqs)),
counted AS (SELECT entity_id, ({_PK['first']})::DOUBLE AS pk_first, ({_PK['last']})::DOUBLE AS pk_last, {', '.join(f'{_TIMES(c)} AS of_{c}' for c in 'KRHDECY')} FROM kept)
SELECT entity_id, round(list_reduce(list_transform(range(50), lambda i: 7 / pow(2::DOUBLE, i)), lambda low, w: CASE WHEN {_CHARGE} > 0 THEN low + w ELSE low END, 0::DOUBLE) + 7 / pow(2::DOUBLE, 50), 6) AS isoelectric_point FROM counted""")
def isoelectric_points(spark, sf_dir):
    return sequence.isoelectric_points(t.sequences(spark, sf_dir))


_HYDROPATHY_SQL = ", ".join(f"('{c}', {v})" for c, v in sequence.HYDROPATHY.items())


@query("hydropathy_pair_index", f"""WITH {t.SEQUENCES_SQL}, w(letter, v) AS (VALUES {_HYDROPATHY_SQL}),
kept AS (SELECT entity_id, CASE WHEN x = '' THEN 'A' ELSE x END AS s FROM (SELECT entity_id, regexp_replace(coalesce(seq, ''), '[^{sequence.ALPHABET}]', '', 'g') AS x FROM seqs)),
letters AS (SELECT entity_id, string_split(s, '') AS l FROM kept),
pairs AS (SELECT entity_id, len(l) AS n, unnest(CASE WHEN len(l) > 1 THEN list_zip(l[:-2], l[2:]) ELSE [NULL] END) AS p FROM letters)
SELECT entity_id, round(10 * coalesce(sum((round(x.v * 10) + round(y.v * 10))::BIGINT / 10::DOUBLE), 0) / max(n), 6) AS pair_index
FROM pairs LEFT JOIN w x ON x.letter = p[1] LEFT JOIN w y ON y.letter = p[2] GROUP BY entity_id""")
def hydropathy_pair_index(spark, sf_dir):
    """The index of letter pairs, each weighing the hydropathy of both its letters."""
    rows = [(x + y, round(v + w, 1)) for x, v in sequence.HYDROPATHY.items() for y, w in sequence.HYDROPATHY.items()]
    return sequence.pair_index(t.sequences(spark, sf_dir), spark.createDataFrame(rows, "pair string, weight double"))


ORDER = ["purchase", "view", "click"]


@query("custom_order", f"""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
SELECT event_type, n, row_number() OVER (ORDER BY coalesce(list_position({ORDER}, event_type), {len(ORDER) + 1}), n DESC, event_type)::BIGINT AS place FROM c""")
def custom_order(spark, sf_dir):
    """Kinds of events in an order that is given, others after them by their number."""
    c = t.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    known = F.array_position(F.array(*map(F.lit, ORDER)), F.col("event_type"))
    ranked = c.withColumn("own", F.when(known > 0, known).otherwise(len(ORDER) + 1))
    rows = ranked.withColumn("turn", F.dense_rank().over(Window.orderBy("own", F.desc("n"), "event_type")))  # a row for each kind of event
    return rows.select("event_type", "n", F.col("turn").cast("long").alias("place"))


@query("joined_schemas", "SELECT o_orderkey AS key, o_totalprice AS price, NULL AS size FROM orders UNION ALL SELECT p_partkey, NULL, p_size FROM part")
def joined_schemas(spark, sf_dir):
    """Rows of two tables that share a column; either lacks one of the other's."""
    orders = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    return orders.unionByName(t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size")), allowMissingColumns=True)


@query("cross_validation")
def cross_validation(spark, sf_dir):
    """Logistic regression over vectors in five stratified folds: each metric's mean and deviation."""
    v = t.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("a"), F.col("vec_id").alias("b"), F.col("embedding").cast("array<double>").alias("feat"), (F.col("label") % 2).alias("label"))
    folded = v.join(splits.folds(v.select("a", "b", "label")).select("a", "fold"), "a").select("feat", "label", "fold")
    scored = checkpointed(models.cross_validated(folded, 5).select(F.col("fold").alias("grp"), F.col("label").alias("y"), "p"))
    each = metrics.confusion(scored).join(metrics.roc_auc(scored), "grp").join(metrics.average_precision(scored), "grp")
    return each.agg(F.count("*").alias("folds"), *(f(c).alias(f"{n}_{c}") for c in ("roc_auc", "pr_auc", "mcc", "f1") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))))


def _scalars(spark, sf_dir, pairs=None):
    """(entity_id, degree, length) of every part; ``pairs`` are the part pairs, where they are at hand."""
    degree = graph.degrees((t.part_pairs(spark, sf_dir) if pairs is None else pairs).withColumn("label", F.lit(1)))
    parts = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.length(F.concat("p_name", "p_type")).alias("length"))
    return checkpointed(stats.entity_statistics(parts, degree).select("entity_id", F.col("degree").cast("double").alias("degree"), F.col("length").cast("double").alias("length")))


@query("negative_designs")
def negative_designs(spark, sf_dir):
    """Models of degree and length, trained with each set of negatives and tested with each: the area."""
    positives = checkpointed(t.part_pairs(spark, sf_dir))
    s = _scalars(spark, sf_dir, positives)
    rows = None
    for name, kind in (("N1", "random"), ("N2", "degree"), ("N5", "degree_length")):
        made = negatives.matched(positives, split_queries.strata(spark, sf_dir, kind, positives), name).select("a", "b").withColumn("label", F.lit(0))
        mine = positives.withColumn("label", F.lit(1)).union(made).withColumn("set_name", F.lit(name))
        rows = mine if rows is None else rows.union(mine)
    x, y = (s.toDF(k, f"d_{k}", f"l_{k}") for k in ("a", "b"))
    feat = F.array(F.col("d_a") + F.col("d_b"), F.abs(F.col("d_a") - F.col("d_b")), F.col("l_a") + F.col("l_b"), F.abs(F.col("l_a") - F.col("l_b")))
    side = F.when(uniform(42, "label", "a", "b") < 0.2, "test").otherwise("train")
    sets = rows.join(x, "a").join(y, "b").select("set_name", side.alias("side"), feat.alias("feat"), "label")
    scored = models.trained_on_each(sets).withColumn("grp", F.concat_ws(">", "trained_on", "grp"))
    return metrics.roc_auc(scored)


@query("nested_features")
def nested_features(spark, sf_dir):
    """Random negatives told apart by length, by degree, and by both: the area of each."""
    positives = checkpointed(t.part_pairs(spark, sf_dir))
    s = _scalars(spark, sf_dir, positives)
    made = negatives.matched(positives, split_queries.strata(spark, sf_dir, "random"), "N1").select("a", "b").withColumn("label", F.lit(0))
    x, y = (s.toDF(k, f"d_{k}", f"l_{k}") for k in ("a", "b"))
    rows = checkpointed(positives.withColumn("label", F.lit(1)).union(made).join(x, "a").join(y, "b").withColumn("test", uniform(42, "label", "a", "b") < 0.2))
    scalars = {n: list(vectors.scalar_features(F.col(f"{n[0]}_a"), F.col(f"{n[0]}_b"))) for n in ("length", "degree")}
    out = None
    for name, cols in {"length": scalars["length"], "degree": scalars["degree"], "both": scalars["length"] + scalars["degree"]}.items():
        given = rows.select("test", "label", F.array(*cols).alias("feat"))
        scored = models.fit_predict(given.filter("NOT test"), given.filter("test")).select(F.lit(name).alias("grp"), F.col("label").alias("y"), "p")
        out = scored if out is None else out.union(scored)
    return metrics.roc_auc(out)
