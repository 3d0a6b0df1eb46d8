"""Named queries over the star-schema stand-ins, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbench.operators import metrics, records, splits, vectors, windows
from pairbench.sources.tables import MEASUREMENTS_SQL as M
from pairbench.sources.tables import measurements, table

SUMMARY = M + """, s AS (
  SELECT entity, source, min(cluster) AS cluster, min(family) AS family, count(*) AS n_rows, max(score) AS max_score,
         count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, count(*) FILTER (label = -1) AS n_gray
  FROM m GROUP BY entity, source)"""
VERDICTS = SUMMARY + """, v AS (
  SELECT *, CASE WHEN n_pos > 0 THEN 'ok' WHEN max(n_pos) OVER (PARTITION BY cluster, source) > 0 THEN 'dead_variant' ELSE 'no_evidence' END AS verdict FROM s)"""
RESOLVED = SUMMARY + """, t AS (SELECT *, count(*) OVER (PARTITION BY cluster, source) > 1 AS in_series FROM s), r AS (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY in_series DESC, n_pos DESC, max_score DESC, source) AS rank FROM t)"""
RUNS = M + """, o AS (SELECT source, score, sum(label) AS h, count(*) AS n FROM m WHERE label <> -1 GROUP BY source, score), r AS (
  SELECT *, sum(h) OVER d AS hits, sum(n) OVER d AS rows_, sum(h) OVER e AS tot, sum(n) OVER e AS all_ FROM o
  WINDOW d AS (PARTITION BY source ORDER BY score DESC ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY source))"""
AP = "round(sum(h / nullif(tot, 0) * hits / rows_), 6)"
AUC = "round((sum(h * (all_ - rows_ + (n + 1) / 2.0)) - max(tot) * (max(tot) + 1) / 2.0) / nullif(max(tot) * (max(all_) - max(tot)), 0), 6)"
PAIRS = """p AS (
  SELECT a.label, a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)"""
REPLICATES = """o AS (SELECT entity, source, slot, CASE WHEN min(label) = max(label) THEN min(label) ELSE -1 END AS label, round(avg(score), 6) AS score FROM m GROUP BY ALL),
      q AS (SELECT a.entity, a.source AS source_a, b.source AS source_b, a.label AS x, b.label AS y, a.score AS s, b.score AS t, a.label <> -1 AND b.label <> -1 AS hard
        FROM o a JOIN o b ON a.entity = b.entity AND a.slot = b.slot AND a.source < b.source),
      k AS (SELECT *, rank() OVER (PARTITION BY entity, source_a, source_b ORDER BY s) + (count(*) OVER (PARTITION BY entity, source_a, source_b, s) - 1) / 2.0 AS ra,
        rank() OVER (PARTITION BY entity, source_a, source_b ORDER BY t) + (count(*) OVER (PARTITION BY entity, source_a, source_b, t) - 1) / 2.0 AS rb FROM q),
      p AS (SELECT entity, source_a, source_b, count(*) AS n_common, count(*) FILTER (hard) AS n_hard, count(*) FILTER (hard AND x <> y) AS n_differ,
        round(count(*) FILTER (hard AND x + y = 2) / nullif(count(*) FILTER (hard AND x + y >= 1), 0), 6) AS jaccard,
        CASE WHEN min(ra) < max(ra) AND min(rb) < max(rb) THEN round(corr(ra, rb), 5) END AS rho FROM k GROUP BY ALL)"""
BOTH = PAIRS + ", b AS (SELECT label, i AS q, j AS v, cosine FROM p UNION ALL SELECT label, j, i, cosine FROM p)"
DRAW = "sha256('{}:' || {}::VARCHAR)"
DNA = """d AS (SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents)"""
RC = "translate(reverse({}), 'ACGT', 'TGCA')"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("start"))


def sequences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", windows.dna(F.col("text")).alias("seq"))


def _histogram(m: DataFrame) -> DataFrame:
    return m.groupBy(F.least(F.floor((F.col("score") + 0.5) / 0.025), F.lit(39)).alias("bin")).agg(F.count("*").alias("n"))


def _complete(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    cells = e.groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("cell"))
    axes = e.select("user_id").distinct().crossJoin(e.select("event_type").distinct())
    return axes.join(cells, ["user_id", "event_type"], "left").select("user_id", "event_type", "cell", F.col("cell").isNull().alias("missing"))


def _pages(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "https?://([^/]+)", 1).alias("host"), F.regexp_count("html", F.lit("<p>")).alias("n_paragraphs"))


def _namespace(s: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    kind = F.when(u.rlike("^https://m\\."), "mobile").when(u.rlike("^https://"), "secure").when(u.rlike("\\?"), "query").otherwise("plain")
    return table(s, d, "pages").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def _bands(m: DataFrame) -> DataFrame:
    band = F.when(F.col("score") < -0.25, "low").when(F.col("score") < 0, "mid").when(F.col("score") < 0.25, "high").otherwise("top")
    return m.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


def _seed_spread(m: DataFrame) -> DataFrame:
    per = m.groupBy("cluster", "replicate", "source").agg(F.avg("score").alias("x")).groupBy("cluster", "replicate").agg(F.stddev_samp("x").alias("sd"))
    return per.groupBy("cluster").agg(F.round(F.avg("sd"), 6).alias("spread"), F.count("sd").alias("n"))


def _zscores(m: DataFrame) -> DataFrame:
    stats = m.groupBy("cluster").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("sd"))
    return stats.withColumn("scale", F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")))


def _hard_set(m: DataFrame) -> DataFrame:
    ap = metrics.average_precision(m, "source")
    return ap.where(F.col("ap").isNull() | (F.col("ap") < 0.5)).select("source", "ap", F.when(F.col("ap").isNull(), "dead").otherwise("low").alias("reason"))


def _levenshtein(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    a, b = c.toDF("i", "x", "r"), c.toDF("j", "y", "r")
    return a.join(b, "r").where("i < j").select("i", "j", F.levenshtein("x", "y").alias("distance"))


def _token_resolver(s: SparkSession, d: str) -> DataFrame:
    tokens = table(s, d, "part").select(F.explode(F.split("p_type", " ")).alias("token"))
    return tokens.groupBy(F.lower("token").alias("token")).agg(F.count("*").alias("n"))


On = Callable[[DataFrame], DataFrame]


def _m(f: On) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: f(measurements(s, d))


def _e(f: On) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: f(table(s, d, "embeddings"))


CATALOG: list[tuple[str, Callable[[SparkSession, str], DataFrame], str | None]] = [
    ("record_summary", _m(records.summary), f"WITH {SUMMARY} SELECT * FROM s"),
    ("record_verdicts", _m(lambda m: records.verdicts(m).groupBy("verdict").agg(F.count("*").alias("n"), F.sum("n_rows").alias("n_rows"))), f"WITH {VERDICTS} SELECT verdict, count(*) AS n, sum(n_rows)::BIGINT AS n_rows FROM v GROUP BY verdict"),
    ("source_summary", _m(records.source_summary), f"WITH {VERDICTS} SELECT source, count(*) AS n_records, median(max_score) AS median_max, sum(n_pos)::BIGINT AS n_pos, sum(n_neg)::BIGINT AS n_neg, count(*) FILTER (verdict <> 'ok') AS n_silent, round(count(*) FILTER (verdict <> 'ok') / count(*), 6) AS frac_silent FROM v GROUP BY source"),
    ("merge_resolve", _m(records.survivors), f"WITH {RESOLVED} SELECT entity, source, cluster, family, n_rows, n_pos, max_score, in_series FROM r WHERE rank = 1"),
    ("merge_survivor_rows", _m(lambda m: records.surviving_rows(m).groupBy("source").agg(F.count("*").alias("n"))), f"WITH {RESOLVED} SELECT source, count(*) AS n FROM m WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rank > 1 AND r.entity = m.entity AND r.source = m.source) GROUP BY source"),
    ("duplicate_records", _m(lambda m: records.summary(m).groupBy("entity").agg(F.count("*").alias("n")).where("n > 1")), f"WITH {SUMMARY} SELECT entity, count(*) AS n FROM s GROUP BY entity HAVING count(*) > 1"),
    ("cluster_inventory", _m(records.inventory), f"WITH {M} SELECT cluster, min(family) AS first_family, count(DISTINCT entity) AS n_entities, count(DISTINCT source) AS n_sources, count(*) AS n_rows, (array_agg(entity ORDER BY n_mut, entity))[1] AS reference, max(n_mut) AS max_edits, count(DISTINCT entity) FILTER (n_mut > 1) AS n_variants, count(DISTINCT entity) FILTER (label = 1) AS n_positive_entities FROM m GROUP BY cluster"),
    ("family_dominance", _m(records.dominance), f"WITH {M}, n AS (SELECT family, count(*) AS n FROM m GROUP BY family) SELECT family, n, round(n / sum(n) OVER (), 6) AS share, round(n / sum(n) OVER (), 6) > 0.01 AS dominant FROM n"),
    ("replicate_reconcile", _m(records.replicate_reconcile), f"WITH {M} SELECT entity, source, site, CASE WHEN min(label) = max(label) THEN min(label) ELSE -1 END AS label, round(avg(score), 6) AS score, count(*) AS n_replicates FROM m GROUP BY entity, source, site"),
    ("replicate_pairs", _m(records.replicate_pairs), f"WITH {M}, {REPLICATES} SELECT *, jaccard < 0.2 AS low_jaccard, rho < 0.3 AS low_rho FROM p"),
    ("pair_ids", _m(records.pair_ids), f"WITH {M} SELECT substr(sha256(entity::VARCHAR || chr(31) || source::VARCHAR || chr(31) || site::VARCHAR || chr(31) || replicate), 1, 24) AS pair_id, count(*) AS n FROM m GROUP BY 1"),
    ("schema_checks", _m(records.checks), f"WITH {M} SELECT 'label' AS \"check\", count(*) FILTER (label NOT IN (-1, 0, 1)) AS n_rows FROM m UNION ALL SELECT 'family_upper', count(*) FILTER (family <> upper(family)) FROM m UNION ALL SELECT 'replicate', count(*) FILTER (replicate NOT IN ('O', 'F')) FROM m"),
    ("score_histogram", _m(_histogram), f"WITH {M} SELECT least(floor((score + 0.5) / 0.025), 39)::BIGINT AS bin, count(*) AS n FROM m GROUP BY 1"),
    ("binarise_summary", _m(lambda m: m.groupBy("label").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))), f"WITH {M} SELECT label, count(*) AS n, min(score) AS low, max(score) AS high FROM m GROUP BY label"),
    ("pivot_labels", _m(lambda m: m.groupBy("source").pivot("label", [-1, 0, 1]).count().na.fill(0).toDF("source", "gray", "neg", "pos")), f"WITH {M} SELECT source, count(*) FILTER (label = -1) AS gray, count(*) FILTER (label = 0) AS neg, count(*) FILTER (label = 1) AS pos FROM m GROUP BY source"),
    ("identity_bands", _m(_bands), f"WITH {M} SELECT CASE WHEN score < -0.25 THEN 'low' WHEN score < 0 THEN 'mid' WHEN score < 0.25 THEN 'high' ELSE 'top' END AS band, count(*) AS n, round(avg(score), 6) AS mean FROM m GROUP BY 1"),
    ("quantile_report", _m(lambda m: m.groupBy("cluster").agg(*[F.round(F.percentile("score", p), 6).alias(f"p{int(p * 100)}") for p in (0.1, 0.25, 0.5, 0.75, 0.9)])), f"WITH {M} SELECT cluster, " + ", ".join(f"round(quantile_cont(score, {p}), 6) AS p{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9)) + " FROM m GROUP BY cluster"),
    ("seed_spread", _m(_seed_spread), f"WITH {M}, a AS (SELECT cluster, replicate, source, avg(score) AS x FROM m GROUP BY ALL), b AS (SELECT cluster, replicate, stddev_samp(x) AS sd FROM a GROUP BY ALL) SELECT cluster, round(avg(sd), 6) AS spread, count(sd) AS n FROM b GROUP BY cluster"),
    ("standardise", _m(_zscores), f"WITH {M} SELECT cluster, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, CASE WHEN round(stddev_pop(score), 6) = 0 THEN 1.0 ELSE round(stddev_pop(score), 6) END AS scale FROM m GROUP BY cluster"),
    ("ap_by_group", _m(lambda m: metrics.average_precision(m, "source")), f"WITH {RUNS} SELECT source, {AP} AS ap, max(tot)::BIGINT AS n_pos, max(all_)::BIGINT AS n FROM r GROUP BY source"),
    ("auroc_by_group", _m(lambda m: metrics.auroc(m, "source")), f"WITH {RUNS} SELECT source, {AUC} AS auroc FROM r GROUP BY source"),
    ("precision_at_k", _m(lambda m: metrics.precision_at(m, "source", 10)), f"WITH {RUNS} SELECT source, CASE WHEN max(all_) >= 10 THEN round(sum(h * least(n, greatest(10 - (rows_ - n), 0)) / n) / 10, 6) END AS p_at_k FROM r GROUP BY source"),
    ("recall_at_precision", _m(lambda m: metrics.recall_at(m, "source", 0.9)), f"WITH {RUNS} SELECT source, CASE WHEN max(tot) > 0 THEN round(coalesce(max(CASE WHEN hits / rows_ >= 0.9 THEN hits / nullif(tot, 0) END), 0.0), 6) END AS recall FROM r GROUP BY source"),
    ("spearman_by_group", lambda s, d: metrics.spearman(table(s, d, "lineitem").select("l_suppkey", "l_quantity", "l_discount"), "l_suppkey", "l_quantity", "l_discount"), "WITH t AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY l_suppkey ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_suppkey, l_discount) - 1) / 2.0 AS ry FROM lineitem) SELECT l_suppkey, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN round(corr(rx, ry), 5) END AS rho FROM t GROUP BY l_suppkey"),
    ("macro_metrics", _m(lambda m: metrics.macro(m, "source")), f"WITH {RUNS}, g AS (SELECT source, {AP} AS ap, {AUC} AS auroc FROM r GROUP BY source) SELECT round(avg(ap), 5) AS ap, count(ap) AS n_ap, round(avg(auroc), 5) AS auroc, count(auroc) AS n_auroc FROM g"),
    ("chance_aupr", _m(lambda m: metrics.chance(m, "source")), f"WITH {M}, g AS (SELECT source, avg(label) AS rate FROM m WHERE label <> -1 GROUP BY source) SELECT round(avg(rate), 6) AS chance_ap, count(*) AS n FROM g WHERE rate > 0"),
    ("call_scores", _m(lambda m: metrics.calls(m, "source", 0.4)), f"WITH {M}, g AS (SELECT source, count(*) FILTER (score >= 0.4) AS n_called, sum(label)::BIGINT AS n_true, count(*) FILTER (score >= 0.4 AND label = 1) AS hit FROM m WHERE label <> -1 GROUP BY source) SELECT source, n_called, n_true, round(hit / nullif(n_called, 0), 6) AS precision, round(hit / nullif(n_true, 0), 6) AS recall, round(2 * hit / nullif(n_called + n_true, 0), 6) AS f1, round(hit / nullif(n_called + n_true - hit, 0), 6) AS jaccard FROM g"),
    ("hard_set_selection", _m(_hard_set), f"WITH {RUNS}, g AS (SELECT source, {AP} AS ap FROM r GROUP BY source) SELECT source, ap, CASE WHEN ap IS NULL THEN 'dead' ELSE 'low' END AS reason FROM g WHERE ap IS NULL OR ap < 0.5"),
    ("matrix_completeness", _complete, "WITH c AS (SELECT user_id, event_type, round(avg(value), 6) AS cell FROM events GROUP BY ALL), u AS (SELECT DISTINCT user_id FROM events), t AS (SELECT DISTINCT event_type FROM events) SELECT u.user_id, t.event_type, cell, cell IS NULL AS missing FROM u CROSS JOIN t LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = t.event_type"),
    ("cosine_edges", _e(lambda e: vectors.edges(e, 0.25)), f"WITH {PAIRS} SELECT * FROM p WHERE cosine >= 0.25"),
    ("medoids", _e(vectors.medoids), f"WITH {BOTH}, t AS (SELECT label, q AS v, round(sum(1 - cosine), 4) AS distance FROM b GROUP BY ALL) SELECT label, v AS medoid, distance FROM t QUALIFY row_number() OVER (PARTITION BY label ORDER BY distance, v) = 1"),
    ("knn_topk", _e(lambda e: vectors.nearest(e, 5).drop("label")), f"WITH {BOTH}, k AS (SELECT q, v, cosine, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, v) AS rank FROM b) SELECT * FROM k WHERE rank <= 5"),
    ("vector_mean_pool", _e(vectors.pool), "WITH c AS (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings) SELECT label, pos, round(avg(x::DOUBLE), 6) AS mean FROM c GROUP BY ALL"),
    ("cobinding_overlap", lambda s, d: windows.overlapping(events(s, d), "event_type", "start", 301), "WITH e AS (SELECT DISTINCT event_type AS g, (epoch_us(ts) // 1000000)::BIGINT AS s FROM events) SELECT g, s FROM e WHERE EXISTS (SELECT 1 FROM e x WHERE x.g <> e.g AND abs(x.s - e.s) < 301)"),
    ("revcomp_palindromes", lambda s, d: sequences(s, d).select("doc_id", "seq", windows.reverse_complement(F.col("seq")).alias("rc")), f"WITH {DNA} SELECT doc_id, seq, {RC.format('seq')} AS rc FROM d"),
    ("kmer_vocabulary", lambda s, d: windows.kmers(sequences(s, d), "seq", 6), f"WITH {DNA}, w AS (SELECT unnest(list_transform(range(1, length(seq) - 4), lambda i: substr(seq, i, 6))) AS w FROM d WHERE length(seq) >= 6) SELECT least(w, {RC.format('w')}) AS kmer, count(*) AS n, count(*) FILTER (w = {RC.format('w')}) AS n_palindromes FROM w GROUP BY 1"),
    ("balanced_entity_folds", lambda s, d: splits.balanced_folds(table(s, d, "part"), "p_partkey", 5, "folds"), f"SELECT p_partkey, ntile(5) OVER (ORDER BY {DRAW.format('folds', 'p_partkey')}, p_partkey) AS fold FROM (SELECT DISTINCT p_partkey FROM part)"),
    ("fold_variant_fraction", lambda s, d: splits.variant_fraction(table(s, d, "part"), "p_brand", "p_partkey", 0.2, "variants"), f"SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY {DRAW.format('variants', 'p_partkey')}, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM (SELECT DISTINCT p_brand, p_partkey FROM part)) WHERE r <= greatest(1, round_even(n * 0.2, 0))"),
    ("fold_digest", lambda s, d: splits.digest(table(s, d, "part"), "p_brand", "p_partkey"), "SELECT p_brand, substr(sha256(array_to_string(list_sort(list(DISTINCT p_partkey::VARCHAR)), chr(10))), 1, 12) AS digest FROM part GROUP BY p_brand"),
    ("smallest_first_carve", lambda s, d: splits.smallest_first(table(s, d, "part"), "p_brand", 0.2), "SELECT p_brand, n FROM (SELECT p_brand, n, coalesce(sum(n) OVER (ORDER BY n, p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () * 0.2 AS target FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)) WHERE before < target"),
    ("page_fields", _pages, "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, 'https?://([^/]+)', 1) AS host, len(regexp_extract_all(html, '<p>'))::INT AS n_paragraphs FROM pages"),
    ("id_namespace", _namespace, "SELECT CASE WHEN regexp_matches(url, '^https://m\\.') THEN 'mobile' WHEN regexp_matches(url, '^https://') THEN 'secure' WHEN regexp_matches(url, '\\?') THEN 'query' ELSE 'plain' END AS kind, count(*) AS n FROM pages GROUP BY 1"),
    ("token_resolver", _token_resolver, "SELECT lower(token) AS token, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS token FROM part) GROUP BY 1"),
    ("levenshtein_edges", _levenshtein, "SELECT a.n_nationkey AS i, b.n_nationkey AS j, levenshtein(a.n_name, b.n_name)::INT AS distance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
]
