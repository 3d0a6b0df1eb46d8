"""Named queries on profiles, entity views, lookups, motifs, components and splits, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairbench.functions.text import ALIASES, alias, first_path
from pairbench.operators import alignment, components, metrics, motifs, profiles, records, similar, splits, vectors
from pairbench.plans.catalog import AP, BOTH, DNA, DRAW, PAIRS, RC, REPLICATES, RESOLVED, RUNS, VERDICTS, M, sequences
from pairbench.sources import sinks
from pairbench.sources.tables import measurements, table

Query = Callable[[SparkSession, str], DataFrame]

#: Two motifs of six places for the sequence stand-in.
MOTIFS = {
    "rise": [0.5, -0.25, -1.0, 0.75, 1.0, -0.5, 0.25, -1.25, -0.75, 1.5, -0.25, 0.0, 0.25, 0.5, -1.5, 1.0, 1.25, -1.0, 0.5, -0.25, -0.5, 0.75, 1.0, -1.0],
    "fall": [-1.0, 1.0, 0.5, -0.25, 0.75, 0.25, -0.5, -1.0, 1.5, -1.25, 0.25, 0.5, -0.25, -0.5, 1.25, 0.0, 0.5, 1.0, -0.75, -1.0, 1.0, -0.25, -1.5, 0.75],
}
WIDTH, SPAN, NEAR = 6, 20, 0.25

INV = "i AS (SELECT cluster, count(DISTINCT entity) AS n_entities, (array_agg(entity ORDER BY n_mut, entity))[1] AS reference FROM m GROUP BY cluster)"
CELLS = "c AS (SELECT user_id, user_id % 10 AS g, event_type, round(avg(value), 6) AS cell FROM events GROUP BY ALL)"
SCAN = f"""{DNA}, w AS (SELECT 'rise' AS motif, {MOTIFS["rise"]}::DOUBLE[] AS w UNION ALL SELECT 'fall', {MOTIFS["fall"]}::DOUBLE[]),
  l AS (SELECT unnest(['A', 'C', 'G', 'T']) AS b), mers AS (SELECT {" || ".join(f"l{i}.b" for i in range(WIDTH))} AS k FROM {", ".join(f"l l{i}" for i in range(WIDTH))}),
  weighed AS (SELECT motif, k, list_sum(list_transform(range(0, {WIDTH}), lambda i: w[i * 4 + strpos('ACGT', substr(k, i + 1, 1))])) AS x FROM mers CROSS JOIN w),
  c AS (SELECT doc_id, unnest(list_transform(range(1, length(seq) - {WIDTH - 2}), lambda a: substr(seq, a, {WIDTH}))) AS k FROM d WHERE length(seq) >= {WIDTH}),
  n AS (SELECT doc_id, k, {RC.format("k")} AS rc, count(*) AS n FROM c GROUP BY ALL),
  o AS (SELECT doc_id, motif, x, n FROM n JOIN weighed s ON s.k = n.k UNION ALL SELECT doc_id, motif, x, n FROM n JOIN weighed s ON s.k = n.rc),
  b AS (SELECT doc_id, motif, max(x) AS top FROM o GROUP BY ALL),
  z AS (SELECT doc_id, motif, round(any_value(top), 5) AS best, round(any_value(top) + ln(sum(n * exp(x - top))), 5) AS total FROM o JOIN b USING (doc_id, motif) GROUP BY ALL)"""
ALIAS_SQL = "CASE lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))" + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items()) + " ELSE lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))) END"


def _m(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: f(measurements(s, d))


def _e(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: f(table(s, d, "embeddings"))


def _detection(m: DataFrame) -> DataFrame:
    """AUROC of finding silent records by low power, per cluster."""
    dead = m.groupBy("cluster", "entity", "source").agg(F.round(-F.sum(F.col("score") + 0.5), 6).alias("score"), F.when(F.count_if(F.col("label") == 1) > 0, 0).otherwise(1).alias("label"))
    return metrics.auroc(dead, "cluster")


def _suppression(s: SparkSession, d: str) -> DataFrame:
    cells = table(s, d, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("cell")).withColumn("g", F.col("user_id") % 10)
    return profiles.suppression(cells.withColumn("label", F.when(F.col("cell") > 60, 1).otherwise(0)), "user_id", "g", "event_type", "cell", "label")


def _hard_summary(m: DataFrame) -> DataFrame:
    every = records.summary(m).groupBy("cluster").agg(F.count("*").alias("n"))
    silent = records.verdicts(m).where("verdict <> 'ok'").groupBy("cluster").agg(F.count("*").alias("n_silent"))
    return every.join(silent, "cluster", "full").na.fill(0, ["n", "n_silent"])


def _deltas(m: DataFrame) -> DataFrame:
    base = metrics.average_precision(m.withColumn("score", F.abs("score")), "source").select("source", F.col("ap").alias("base_ap"))
    return metrics.average_precision(m, "source").join(base, "source").select("source", "ap", "base_ap", F.round(F.col("ap") - F.col("base_ap"), 6).alias("delta"))


def _big(m: DataFrame) -> DataFrame:
    big = records.inventory(m).where("n_entities >= 5").select("cluster")
    return m.join(big, "cluster", "left_semi").groupBy("cluster").agg(F.count("*").alias("n_rows"))


def _predict(e: DataFrame) -> DataFrame:
    cells = e.select(F.col("vec_id").alias("v"), F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    return profiles.weighted_profile(vectors.nearest(e, 5), cells)


def _cyclic(e: DataFrame) -> DataFrame:
    """A donor for each vector of a family, never itself if there is another: the next id, in a ring."""
    w = Window.partitionBy("label")
    return e.select("vec_id", "label", F.coalesce(F.lead("vec_id").over(w.orderBy("vec_id")), F.min("vec_id").over(w)).alias("donor"))


def _components(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return components.components(vectors.edges(e, NEAR).select(F.col("i").alias("u"), F.col("j").alias("v")), e.select(F.col("vec_id").alias("id")))


def _scan(s: SparkSession, d: str) -> DataFrame:
    return motifs.scan(sequences(s, d), "seq", MOTIFS).drop("seq")


def _pwm_select(s: SparkSession, d: str) -> DataFrame:
    labels = table(s, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return motifs.select(_scan(s, d).join(labels, "doc_id"))


def _window_cut(s: SparkSession, d: str) -> DataFrame:
    genome = sequences(s, d).select(F.col("doc_id").alias("chrom"), "seq")
    return motifs.cut(genome.select("chrom", (F.col("chrom") * 7 % 50).alias("start")), genome, SPAN)


def _window_sample(s: SparkSession, d: str) -> DataFrame:
    """Per type all events over 100, and as many others, in hashed order."""
    e = table(s, d, "events").select("event_type", "event_id", (F.col("value") > 100).alias("positive"))
    w = Window.partitionBy("event_type")
    ranked = e.withColumn("n", F.count_if("positive").over(w)).withColumn("r", F.row_number().over(Window.partitionBy("event_type", "positive").orderBy(splits.draw("windows", F.col("event_id")), "event_id")))
    return ranked.where(F.col("positive") | (F.col("r") <= F.col("n"))).select("event_type", "event_id", "positive")


def _family_holdout(m: DataFrame) -> DataFrame:
    return m.where("family = 'ECONOMY'").groupBy("cluster").agg(F.count_distinct("entity").alias("n_entities"))


def _disjoint(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part")
    held = splits.smallest_first(part, "p_brand", 0.2)
    return splits.overlap(part.join(held, "p_brand", "left_anti"), part.join(held, "p_brand", "left_semi"), "p_brand")


def _edit_profiles(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select("p_type", "p_name").distinct()
    return alignment.profiles(p.toDF("t", "ref").join(p.toDF("t", "var"), "t").where("ref < var"), "ref", "var")


def _component_folds(s: SparkSession, d: str) -> DataFrame:
    return splits.group_folds(_components(s, d), "component", 5, "components")


def _folds_sql(sizes: str, group: str, seed: str, folds: int) -> str:
    """Recursive SQL for the greedy folds of a (group, n) table: the largest group into the emptiest fold."""
    return f"""o AS (SELECT {group}::VARCHAR AS grp, n, row_number() OVER (ORDER BY n DESC, {DRAW.format(seed, group)}) AS i FROM {sizes}),
      f(i, grp, n, fold, filled) AS (SELECT 0::BIGINT, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, list_transform(range({folds}), lambda x: 0::BIGINT)
        UNION ALL SELECT i, grp, n, k - 1, list_transform(filled, lambda x, j: x + CASE WHEN j = k THEN n ELSE 0 END)
        FROM (SELECT o.i, o.grp, o.n, list_position(filled, list_min(filled))::BIGINT AS k, filled FROM f JOIN o ON o.i = f.i + 1))"""


CARVE = f"""p AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), o AS (SELECT p_brand, n, row_number() OVER (ORDER BY {DRAW.format("carve", "p_brand")}) AS i, (sum(n) OVER () * 0.2)::DOUBLE AS target FROM p),
  f(i, p_brand, n, taken, got) AS (SELECT 0::BIGINT, NULL::VARCHAR, 0::BIGINT, false, 0::BIGINT
    UNION ALL SELECT o.i, o.p_brand, o.n, got < target AND got + o.n <= 1.25 * target, CASE WHEN got < target AND got + o.n <= 1.25 * target THEN got + o.n ELSE got END FROM f JOIN o ON o.i = f.i + 1)"""


CATALOG: list[tuple[str, Query, str | None]] = [
    ("interaction_power", _m(lambda m: profiles.power(m, "source")), f"WITH {M} SELECT source, round(sum(score + 0.5), 6) AS power FROM m GROUP BY source"),
    ("power_ratio", _m(lambda m: profiles.power_ratio(m, records.inventory(m))), f"WITH {M}, {INV}, p AS (SELECT cluster, entity, round(sum(score + 0.5), 6) AS power FROM m GROUP BY ALL) SELECT p.cluster, p.entity, CASE WHEN f.power > 0 THEN round(p.power / f.power, 6) END AS ratio FROM p JOIN i USING (cluster) JOIN p f ON f.cluster = p.cluster AND f.entity = i.reference"),
    ("expected_count_calls", _m(lambda m: profiles.expected_count(m, "source")), f"WITH {M}, p AS (SELECT source, score + 0.5 AS p, round_even(round(sum(score + 0.5) OVER (PARTITION BY source), 6), 0)::BIGINT AS k, row_number() OVER (PARTITION BY source ORDER BY score DESC) AS r FROM m) SELECT source, k, CASE WHEN k <= 0 THEN 'Infinity'::DOUBLE ELSE coalesce(max(p) FILTER (r = k), min(p)) END AS cutoff FROM p GROUP BY source, k"),
    ("ece", _m(lambda m: metrics.ece(m, F.col("score") + 0.5)), f"WITH {M}, b AS (SELECT score + 0.5 AS p, label, ntile(15) OVER (ORDER BY score) AS bin FROM m WHERE label <> -1), g AS (SELECT count(*) AS n, abs(avg(p) - avg(label)) AS gap FROM b GROUP BY bin) SELECT round(sum(n * gap) / sum(n), 6) AS ece FROM g"),
    ("detection_auroc", _m(_detection), f"WITH {M}, q AS (SELECT cluster, entity, source, round(-sum(score + 0.5), 6) AS score, count(*) FILTER (label = 1) = 0 AS dead FROM m GROUP BY ALL), k AS (SELECT cluster, dead, rank() OVER (PARTITION BY cluster ORDER BY score) + (count(*) OVER (PARTITION BY cluster, score) - 1) / 2.0 AS r FROM q) SELECT cluster, round((coalesce(sum(r) FILTER (dead), 0) - count(*) FILTER (dead) * (count(*) FILTER (dead) + 1) / 2.0) / nullif(count(*) FILTER (dead) * count(*) FILTER (NOT dead), 0), 6) AS auroc FROM k GROUP BY cluster"),
    ("suppression", _suppression, f"WITH {CELLS}, k AS (SELECT user_id, g, event_type, rank() OVER (PARTITION BY user_id ORDER BY cell) + (count(*) OVER (PARTITION BY user_id, cell) - 1) / 2.0 AS r, cell > 60 AS high, min(user_id) OVER (PARTITION BY g) AS ref FROM c) SELECT a.user_id, round(count(*) FILTER (b.high AND a.r < b.r) / nullif(count(*) FILTER (b.high), 0), 6) AS suppression FROM k a JOIN k b ON b.user_id = a.ref AND b.event_type = a.event_type GROUP BY a.user_id"),
    ("site_summary", _m(profiles.site_summary), f"WITH {M} SELECT site, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, count(*) FILTER (label = -1) AS n_nocall, max(score) AS max_score FROM m GROUP BY site"),
    ("audit_invariants", _m(profiles.audit), f"WITH {M} SELECT source, min(score) < -0.5 AS under, max(score) > 0.5 AS over, min(score) > -0.3 AS no_low, abs(median(score)) > 0.1 AS off_centre, avg((label = 1)::INT) > 0.05 AS many_positives, count(DISTINCT site) AS n_sites FROM m GROUP BY source"),
    ("noise_floor", _m(lambda m: profiles.noise(records.replicate_pairs(m))), f"WITH {M}, {REPLICATES} SELECT count(*) AS n_pairs, round(median(jaccard), 6) AS median_jaccard, round(median(rho), 5) AS median_rho, count(*) FILTER (jaccard < 0.2) AS n_low_jaccard, count(*) FILTER (rho < 0.3) AS n_low_rho, round(1 - sum(n_differ) / nullif(sum(n_hard), 0), 6) AS agreement FROM p"),
    ("pair_id_duplicates", _m(lambda m: records.pair_ids(m).where("n > 1").agg(F.count("*").alias("n_ids"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))), f"WITH {M}, p AS (SELECT count(*) AS n FROM m GROUP BY entity, source, site, replicate HAVING count(*) > 1) SELECT count(*) AS n_ids, coalesce(sum(n), 0)::BIGINT AS n_rows FROM p"),
    ("clusters_with_at_least_k", _m(_big), f"WITH {M} SELECT cluster, count(*) AS n_rows FROM m GROUP BY cluster HAVING count(DISTINCT entity) >= 5"),
    ("entity_view", _m(lambda m: profiles.entity_view(records.survivors(m), records.inventory(m))), f"WITH {RESOLVED}, {INV} SELECT entity, source, cluster, reference <> entity AS is_variant, coalesce(n_entities, 1) AS n_entities FROM r LEFT JOIN i USING (cluster) WHERE rank = 1"),
    ("reference_rows", _m(lambda m: profiles.reference_rows(records.survivors(m), records.inventory(m))), f"WITH {M}, {INV}, e AS (SELECT cluster, entity, row_number() OVER (PARTITION BY cluster ORDER BY entity) AS row FROM (SELECT DISTINCT cluster, entity FROM m)) SELECT e.entity, e.row::INT AS row, CASE WHEN f.entity = e.entity THEN -1 ELSE coalesce(f.row, -1) END::INT AS reference_row FROM e LEFT JOIN i USING (cluster) LEFT JOIN e f ON f.cluster = e.cluster AND f.entity = i.reference"),
    ("hard_set_summary", _m(_hard_summary), f"WITH {VERDICTS} SELECT cluster, count(*) AS n, count(*) FILTER (verdict <> 'ok') AS n_silent FROM v GROUP BY cluster"),
    ("per_group_deltas", _m(_deltas), f"WITH {RUNS}, a AS (SELECT source, {AP} AS ap FROM r GROUP BY source), q AS (SELECT source, abs(score) AS score, sum(label) AS h, count(*) AS n FROM m WHERE label <> -1 GROUP BY source, abs(score)), u AS (SELECT *, sum(h) OVER d AS hits, sum(n) OVER d AS rows_, sum(h) OVER e AS tot FROM q WINDOW d AS (PARTITION BY source ORDER BY score DESC ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY source)), b AS (SELECT source, {AP} AS base_ap FROM u GROUP BY source) SELECT source, ap, base_ap, round(ap - base_ap, 6) AS delta FROM a JOIN b USING (source)"),
    ("knn_predict", _e(_predict), f"WITH {BOTH}, k AS (SELECT q, v, greatest(cosine, 0.0) AS w FROM b QUALIFY row_number() OVER (PARTITION BY q ORDER BY cosine DESC, v) <= 5), x AS (SELECT vec_id AS v, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT q, pos::INT AS pos, round(coalesce(sum(w * x) / nullif(sum(w), 0), avg(x)), 5) AS value FROM k JOIN x USING (v) GROUP BY q, pos"),
    ("displacement_rank", _e(vectors.farther_share), f"WITH {BOTH}, t AS (SELECT label, q AS v, round(sum(1 - cosine), 4) AS distance FROM b GROUP BY ALL), c AS (SELECT label, v FROM t QUALIFY row_number() OVER (PARTITION BY label ORDER BY distance, v) = 1), o AS (SELECT b.q, b.cosine AS mine FROM b JOIN c ON b.label = c.label AND b.v = c.v) SELECT q, round(count(*) FILTER (cosine < mine) / nullif(count(*) - 1, 0), 6) AS farther FROM b JOIN o USING (q) GROUP BY q"),
    ("ablate_cyclic", _e(_cyclic), "SELECT vec_id, label, coalesce(lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id), min(vec_id) OVER (PARTITION BY label)) AS donor FROM embeddings"),
    ("family_components", _components, f"WITH RECURSIVE {PAIRS}, l AS (SELECT i AS a, j AS b FROM p WHERE cosine >= {NEAR} UNION ALL SELECT j, i FROM p WHERE cosine >= {NEAR}), r(id, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen) SELECT id, min(seen) AS component FROM r GROUP BY id"),
    ("pwm_scan", _scan, f"WITH {SCAN} SELECT * FROM z"),
    ("pwm_select", _pwm_select, f"WITH {SCAN}, s AS (SELECT motif || ':best' AS source, best AS score, quality AS label FROM z JOIN labels USING (doc_id) UNION ALL SELECT motif || ':total', total, quality FROM z JOIN labels USING (doc_id)), f AS (SELECT source, score, sum(label) AS h, count(*) AS n FROM s WHERE label <> -1 GROUP BY source, score), r AS (SELECT *, sum(h) OVER e AS hits, sum(n) OVER e AS rows_, sum(h) OVER g AS tot, sum(n) OVER g AS all_ FROM f WINDOW e AS (PARTITION BY source ORDER BY score DESC ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY source)) SELECT source AS choice, {AP} AS ap, max(tot)::BIGINT AS n_pos, max(all_)::BIGINT AS n FROM r GROUP BY source ORDER BY ap DESC NULLS LAST, choice LIMIT 1"),
    ("window_cut", _window_cut, f"WITH {DNA} SELECT doc_id AS chrom, doc_id * 7 % 50 AS start, CASE WHEN seq IS NULL OR length(substr(seq, (doc_id * 7 % 50 + 1)::BIGINT, {SPAN})) < {SPAN} THEN 'off_end' ELSE 'ok' END AS status, CASE WHEN length(substr(seq, (doc_id * 7 % 50 + 1)::BIGINT, {SPAN})) = {SPAN} THEN substr(seq, (doc_id * 7 % 50 + 1)::BIGINT, {SPAN}) END AS window FROM d"),
    ("window_sample", _window_sample, "SELECT event_type, event_id, positive FROM (SELECT event_type, event_id, value > 100 AS positive, count(*) FILTER (value > 100) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type, value > 100 ORDER BY sha256('windows:' || event_id::VARCHAR), event_id) AS r FROM events) WHERE positive OR r <= n"),
    ("fold_family_holdout", _m(_family_holdout), f"WITH {M} SELECT cluster, count(DISTINCT entity) AS n_entities FROM m WHERE family = 'ECONOMY' GROUP BY cluster"),
    ("fold_disjointness", _disjoint, "WITH h AS (SELECT p_brand FROM (SELECT p_brand, coalesce(sum(n) OVER (ORDER BY n, p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () * 0.2 AS target FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)) WHERE before < target) SELECT count(*) AS n_shared FROM (SELECT p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM h) INTERSECT SELECT p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM h))"),
    ("organism_alias", lambda s, d: table(s, d, "nation").select("n_nationkey", alias(F.col("n_name")).alias("name")), f"SELECT n_nationkey, {ALIAS_SQL.format('n_name')} AS name FROM nation"),
    ("archive_groups", lambda s, d: table(s, d, "pages").groupBy(first_path(F.col("url")).alias("head")).agg(F.count("*").alias("n")), "SELECT split_part(regexp_replace(url, '^https?://', ''), '/', 2) AS head, count(*) AS n FROM pages GROUP BY 1"),
    ("fasta_manifest", lambda s, d: sinks.manifest(sequences(s, d), "doc_id", "seq"), f"WITH {DNA} SELECT doc_id, length(seq)::INT AS length, substr(sha256(seq), 1, 8) AS digest FROM d"),
    ("edit_profiles", _edit_profiles, None),
    ("greedy_clusters", lambda s, d: similar.clusters(table(s, d, "part"), "p_type", "p_partkey", "p_name", most=3), None),
    ("group_folds", lambda s, d: splits.group_folds(table(s, d, "part"), "p_brand", 5, "groups"), f"WITH RECURSIVE g AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), {_folds_sql('g', 'p_brand', 'groups', 5)} SELECT grp AS p_brand, n, fold FROM f WHERE i > 0"),
    ("component_folds", _component_folds, f"WITH RECURSIVE {PAIRS}, l AS (SELECT i AS a, j AS b FROM p WHERE cosine >= {NEAR} UNION ALL SELECT j, i FROM p WHERE cosine >= {NEAR}), r(id, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen), c AS (SELECT id, min(seen) AS component FROM r GROUP BY id), g AS (SELECT component, count(*) AS n FROM c GROUP BY 1), {_folds_sql('g', 'component', 'components', 5)} SELECT grp AS component, n, fold FROM f WHERE i > 0"),
    ("validation_carve", lambda s, d: splits.validation_carve(table(s, d, "part"), "p_brand", 0.2, "carve"), f"WITH RECURSIVE {CARVE} SELECT p_brand, n FROM f WHERE taken UNION ALL SELECT p_brand, n FROM (SELECT * FROM o ORDER BY n, i LIMIT 1) WHERE NOT EXISTS (SELECT 1 FROM f WHERE taken)"),
]
