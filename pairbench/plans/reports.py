"""Queries of the report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbench.operators import metrics, records, reports
from pairbench.plans.catalog import AP, RUNS, VERDICTS, M
from pairbench.sources.tables import measurements, table


def _m(f):
    return lambda s, d: f(measurements(s, d))


def _labelled(s: SparkSession, d: str) -> DataFrame:
    return reports.coverage(table(s, d, "documents"), table(s, d, "labels").where("doc_id % 4 <> 0").union(table(s, d, "labels").selectExpr("doc_id + 100000000", "quality", "toxic")), "doc_id")


def _order(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "part").select(F.col("p_partkey").alias("row"), F.col("p_brand").alias("key"))
    b = table(s, d, "part").select(F.col("p_partkey").alias("row"), F.when(F.col("p_size") % 5 == 0, "?").otherwise(F.col("p_brand")).alias("key"))
    return reports.order_mismatches(a, b, "row", "key")


def _difference(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    return reports.symmetric_difference(p.where("p_size < 30").select("p_name", "p_type"), p.where("p_size > 20").select("p_name", "p_type"))


def _mean_sd(m: DataFrame) -> DataFrame:
    model = metrics.average_precision(m, "source").select(F.lit("model").alias("method"), "ap")
    base = metrics.average_precision(m.withColumn("score", F.abs("score")), "source").select(F.lit("base").alias("method"), "ap")
    return reports.mean_sd([model, base], ["method"], "ap")


def _merge_sources(m: DataFrame) -> DataFrame:
    """What the merge keeps of each source: records and rows kept and dropped."""
    r = records.resolve(m)
    kept = F.col("rank") == 1
    return r.groupBy("source").agg(F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_dropped"), F.sum(F.when(kept, F.col("n_rows")).otherwise(0)).alias("rows_kept"))


def _families(m: DataFrame) -> DataFrame:
    """Entities and variants (over one edit) by family, with silent records: three tables in one."""
    e = m.groupBy("family").agg(F.count_distinct("entity").alias("n_entities"), F.count_distinct(F.when(F.col("n_mut") > 1, F.col("entity"))).alias("n_variants"))
    silent = records.verdicts(m).groupBy("family").agg(F.count_if(F.col("verdict") != "ok").alias("n_silent"))
    return e.join(silent, "family", "full").na.fill(0)


CATALOG = [
    ("coverage_audit", _labelled, """WITH l AS (SELECT doc_id FROM labels WHERE doc_id % 4 <> 0 UNION SELECT doc_id + 100000000 FROM labels)
       SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL THEN 'both' WHEN d.doc_id IS NOT NULL THEN 'only_a' ELSE 'only_b' END AS status
       FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN l ON d.doc_id = l.doc_id"""),
    ("key_collisions", lambda s, d: reports.collisions(table(s, d, "part"), "p_name", "p_brand"), "SELECT p_name, count(DISTINCT p_brand) AS n_owners FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1"),
    ("starved_groups", lambda s, d: reports.starved(table(s, d, "part"), "p_name", F.col("p_size") > 20), "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) = count(*) FILTER (p_size > 20)"),
    ("source_audit", _m(lambda m: reports.source_audit(m, 3)), f"""WITH {M}, e AS (SELECT source, entity, count(*) AS n, count(DISTINCT slot) AS k, min(cluster) AS cluster FROM m GROUP BY ALL), p AS (SELECT source, count(DISTINCT slot) AS places FROM m GROUP BY 1),
       z AS (SELECT source, cluster, count(*) AS size FROM e GROUP BY ALL), y AS (SELECT source, max(size) AS largest, median(size) AS typical FROM z GROUP BY 1)
       SELECT e.source, count(*) FILTER (n <> 3) AS n_odd_rows, count(*) FILTER (k <> places) AS n_odd_places, any_value(largest) AS largest, any_value(typical) AS typical, any_value(largest > greatest(12, 6 * typical)) AS oversized
       FROM e JOIN p USING (source) JOIN y USING (source) GROUP BY e.source"""),
    ("duplicate_cells", _m(lambda m: reports.duplicate_cells(m, "entity", "slot")), f"WITH {M} SELECT entity, slot, count(*) AS n FROM m GROUP BY ALL HAVING count(*) > 1"),
    ("missing_keys", lambda s, d: reports.missing_keys(table(s, d, "part").withColumnRenamed("p_partkey", "k"), table(s, d, "lineitem").where("l_quantity > 25").select(F.col("l_partkey").alias("k")), "k"),
     "SELECT DISTINCT p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 25)"),
    ("order_mismatches", _order, "SELECT count(*) FILTER (p_size % 5 = 0) AS n_mismatches, count(*) AS n_rows FROM part"),
    ("symmetric_difference", _difference, """WITH a AS (SELECT p_name, p_type FROM part WHERE p_size < 30), b AS (SELECT p_name, p_type FROM part WHERE p_size > 20)
       SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""),
    ("baseline_by_fold", _m(lambda m: reports.by_fold(m, ["family"], "replicate", ["O", "F"], "score")), f"""WITH {M} SELECT family, round(avg(score) FILTER (replicate = 'O'), 6) AS "mean_O", round(median(score) FILTER (replicate = 'O'), 6) AS "median_O",
       round(avg(score) FILTER (replicate = 'F'), 6) AS "mean_F", round(median(score) FILTER (replicate = 'F'), 6) AS "median_F" FROM m GROUP BY 1"""),
    ("setting_mean_sd", _m(_mean_sd), f"""WITH {RUNS}, a AS (SELECT source, {AP} AS ap FROM r GROUP BY source), q AS (SELECT source, abs(score) AS score, sum(label) AS h, count(*) AS n FROM m WHERE label <> -1 GROUP BY source, abs(score)),
       u AS (SELECT *, sum(h) OVER d AS hits, sum(n) OVER d AS rows_, sum(h) OVER e AS tot FROM q WINDOW d AS (PARTITION BY source ORDER BY score DESC ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY source)),
       b AS (SELECT source, {AP} AS ap FROM u GROUP BY source), t AS (SELECT 'model' AS method, ap FROM a UNION ALL SELECT 'base', ap FROM b)
       SELECT method, round(avg(ap), 6) AS mean, round(stddev_samp(ap), 6) AS sd, count(*) AS n FROM t GROUP BY 1"""),
    ("fold_members", lambda s, d: reports.fold_members(table(s, d, "part").withColumn("fold", F.col("p_partkey") % 5), "fold", "p_partkey", "p_type"),
     "SELECT p_partkey % 5 AS fold, count(DISTINCT p_partkey) AS n, array_to_string(list_sort(list(DISTINCT p_type)), ', ') AS families FROM part GROUP BY 1"),
    ("cluster_report", _m(reports.cluster_report), f"""WITH {M}, c AS (SELECT cluster, min(family) AS family, count(*) AS n_rows, bool_or(n_mut = 1) AS has_reference, max(n_mut) AS max_edits FROM m GROUP BY 1)
       SELECT *, round(count(*) OVER (PARTITION BY family) / count(*) OVER (), 6) AS share, round(count(*) OVER (PARTITION BY family) / count(*) OVER (), 6) > 0.4 AS dominant FROM c"""),
    ("small_to_other", lambda s, d: reports.small_to_other(table(s, d, "part"), "p_name", 3), """SELECT "group", sum(n)::BIGINT AS n, count(*) AS n_groups FROM (SELECT CASE WHEN count(*) < 3 THEN 'other' ELSE p_name END AS "group", count(*) AS n FROM part GROUP BY p_name) GROUP BY 1"""),
    ("tier_names", lambda s, d: reports.tier_names(table(s, d, "part"), "p_type", "p_retailprice", "p_partkey"), "SELECT p_partkey, p_type || '-' || lpad(row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey)::VARCHAR, 4, '0') AS name FROM part"),
    ("arm_verdict", _m(lambda m: reports.verdict(m, "cluster", "replicate", "score", "F")), f"""WITH {M}, p AS (SELECT cluster, replicate, round(median(score), 6) AS med FROM m GROUP BY ALL),
       o AS (SELECT cluster, max(med) FILTER (replicate = 'F') AS base, max(med) AS best, max({{'m': med, 'r': replicate}}).r AS arm FROM p GROUP BY 1)
       SELECT cluster, CASE WHEN base IS NULL THEN 'no control' WHEN best > base THEN 'better: ' || arm ELSE 'control holds' END AS verdict FROM o"""),
    ("manifest_check", lambda s, d: reports.manifest_check(table(s, d, "customer").where("c_custkey % 3 <> 0").select("c_name"), table(s, d, "customer").where("c_custkey % 2 = 0").select("c_name"), "c_name", "00$"),
     """SELECT c_name, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN 'filed' WHEN c_custkey % 3 <> 0 THEN 'missing' WHEN regexp_matches(c_name, '00$') THEN 'ancillary' ELSE 'unfiled' END AS status
       FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0"""),
    ("merge_composition", _m(_merge_sources), f"""WITH {M}, s AS (SELECT entity, source, cluster, count(*) AS n_rows, max(score) AS max_score, count(*) FILTER (label = 1) AS n_pos FROM m GROUP BY ALL),
       t AS (SELECT *, count(*) OVER (PARTITION BY cluster, source) > 1 AS in_series FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY in_series DESC, n_pos DESC, max_score DESC, source) AS rank FROM t)
       SELECT source, count(*) FILTER (rank = 1) AS n_kept, count(*) FILTER (rank > 1) AS n_dropped, coalesce(sum(n_rows) FILTER (rank = 1), 0)::BIGINT AS rows_kept FROM r GROUP BY 1"""),
    ("variants_by_family", _m(_families), f"""WITH {VERDICTS}, e AS (SELECT family, count(DISTINCT entity) AS n_entities, count(DISTINCT entity) FILTER (n_mut > 1) AS n_variants FROM m GROUP BY 1), z AS (SELECT family, count(*) FILTER (verdict <> 'ok') AS n_silent FROM v GROUP BY 1)
       SELECT coalesce(e.family, z.family) AS family, coalesce(n_entities, 0) AS n_entities, coalesce(n_variants, 0) AS n_variants, coalesce(n_silent, 0) AS n_silent FROM e FULL JOIN z ON e.family = z.family"""),
]
