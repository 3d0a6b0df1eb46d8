"""Queries on names and identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbench.operators import alignment, canonical, naming, records
from pairbench.sources.tables import MEASUREMENTS_SQL as M
from pairbench.sources.tables import measurements, table

KINDS = [("registry", r"^[A-Z][a-z]+#\d{9}$"), ("brand", r"^Brand#\d+$"), ("mobile", r"^https?://m\."), ("web", r"^https?://")]
IGNORE, MANUAL = ["small", "large"], {"widget": "DEVICE", "bolt": "FASTENER"}


def _organism(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.select("c_custkey", naming.organism(F.col("c_mktsegment"), ["machinery", "unknown"], {"BUILDING": "house"}, F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))).alias("organism"))


def _namespaces(s: SparkSession, d: str) -> DataFrame:
    ids = [table(s, d, t).select(F.col(c).alias("id")) for t, c in (("customer", "c_name"), ("part", "p_brand"), ("pages", "url"), ("nation", "n_name"))]
    every = ids[0].unionByName(ids[1]).unionByName(ids[2]).unionByName(ids[3])
    return every.groupBy(naming.namespace(F.col("id"), KINDS).alias("kind")).agg(F.count("*").alias("n"))


def _tokens(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    known = p.where("p_partkey % 7 = 0").select(F.explode(F.split("p_name", " ")).alias("token")).distinct().select("token", F.upper("token").alias("target"))
    return naming.resolve_tokens(p, "p_name", known, IGNORE, MANUAL, " ")


def _prefixes(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").withColumn("tidy", F.replace("p_name", F.lit(" "), F.lit("_")))
    names = p.select(F.concat_ws("_", "p_type", "tidy").alias("name"))
    refs = p.select(F.col("p_type").alias("ref")).union(p.where("p_partkey % 3 = 0").select(F.concat_ws("_", "p_type", F.split_part("tidy", F.lit("_"), F.lit(1)))))
    return naming.longest_prefix(names, refs, "name", "ref")


def _subsumed(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select("c_nationkey", F.col("c_custkey").cast("string").alias("k"))
    return naming.subsumed(c, "c_nationkey", "k", 2)


def _cluster_ids(s: SparkSession, d: str) -> DataFrame:
    inv = records.inventory(measurements(s, d)).withColumn("base", F.substring("cluster", 1, 7))
    return naming.cluster_ids(inv, "base", "reference").select("cluster", "reference", "cluster_id")


def _located(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    protein = F.concat_ws(" ", "p_type", "p_name", "p_brand")
    construct = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.col("p_name"), F.lit("!")))
    domain = F.when(F.col("p_size") % 3 != 0, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise("?")
    return p.select("p_partkey", canonical.locate(protein, construct, domain).cast("int").alias("at"))


def _links(s: SparkSession, d: str) -> DataFrame:
    found = table(s, d, "pages").select(F.explode(naming.labels(F.col("html"), 'href="/([^"]+)"')).alias("label"))
    return found.groupBy("label").agg(F.count("*").alias("n"))


def _groups(s: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://[^/]+/", "")
    return table(s, d, "pages").groupBy(naming.archive_group(path).alias("head")).agg(F.count("*").alias("n"))


def _headers(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    fields = {"OS": F.col("c_mktsegment"), "NK": F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")), "BAL": F.when(F.col("c_acctbal") < 0, F.lit("low"))}
    head = c.select("c_custkey", naming.header(F.col("c_name"), fields).alias("head"))
    return head.select("c_custkey", "head", naming.fasta_fields(F.col("head"))["organism"].alias("organism"))


def _windows(s: SparkSession, d: str) -> DataFrame:
    """Constructs that cover their padded envelope, or end short of it."""
    docs = table(s, d, "documents").select("doc_id", F.col("text").alias("c")).where("c IS NOT NULL")
    docs = docs.withColumn("f", F.greatest(F.length("c") - 20 - F.col("doc_id") % 15, F.lit(1))).withColumn("l", F.least(F.col("f") + 19, F.length("c")))
    return canonical.windows(docs.withColumn("r", F.lit(None).cast("string")), "c", "f", "l", "r", 5).select("doc_id", "window", "origin", "env_first", "env_last", "full")


def _conflicts(s: SparkSession, d: str) -> DataFrame:
    return canonical.conflicting(table(s, d, "part").withColumn("g", F.concat_ws("/", "p_brand", "p_type")), "g", "p_name")


def _identity(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select("p_type", "p_name").distinct()
    return alignment.profiles(p.toDF("t", "ref").join(p.toDF("t", "var"), "t").where("ref < var"), "ref", "var")


_SUB = "substr(c, greatest(f - 5, 1), least(l + 5, length(c)) - greatest(f - 5, 1) + 1)"
CATALOG = [
    ("organism_resolve", _organism, """SELECT c_custkey, CASE WHEN o = 'BUILDING' THEN 'house' ELSE o END AS organism FROM (
       SELECT c_custkey, CASE WHEN lower(trim(c_mktsegment)) IN ('machinery', 'unknown', '') THEN coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, '') ELSE trim(c_mktsegment) END AS o
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""),
    ("namespace_classes", _namespaces, """SELECT CASE WHEN regexp_matches(id, '^[A-Z][a-z]+#[0-9]{9}$') THEN 'registry' WHEN regexp_matches(id, '^Brand#[0-9]+$') THEN 'brand'
       WHEN regexp_matches(id, '^https?://m\\.') THEN 'mobile' WHEN regexp_matches(id, '^https?://') THEN 'web' ELSE 'unknown' END AS kind, count(*) AS n
       FROM (SELECT c_name AS id FROM customer UNION ALL SELECT p_brand FROM part UNION ALL SELECT url FROM pages UNION ALL SELECT n_name FROM nation) GROUP BY 1"""),
    ("label_resolver", _tokens, """WITH t AS (SELECT unnest(string_split(p_name, ' ')) AS token, p_partkey FROM part), k AS (SELECT DISTINCT token FROM t WHERE p_partkey % 7 = 0), n AS (SELECT token, count(*) AS n FROM t WHERE token <> '' GROUP BY 1)
       SELECT n.token, CASE WHEN n.token IN ('small', 'large') THEN NULL WHEN n.token = 'widget' THEN 'DEVICE' WHEN n.token = 'bolt' THEN 'FASTENER' ELSE upper(k.token) END AS target,
       CASE WHEN n.token IN ('small', 'large') THEN 'ignored' WHEN n.token IN ('widget', 'bolt') THEN 'manual' WHEN k.token IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS status, n
       FROM n LEFT JOIN k ON lower(k.token) = lower(n.token)"""),
    ("longest_prefix", _prefixes, """WITH p AS (SELECT p_partkey, p_type, replace(p_name, ' ', '_') AS t FROM part), n AS (SELECT DISTINCT p_type || '_' || t AS name FROM p),
       r AS (SELECT p_type AS ref FROM p UNION SELECT p_type || '_' || split_part(t, '_', 1) FROM p WHERE p_partkey % 3 = 0)
       SELECT name, arg_max(ref, length(ref)) AS ref FROM n LEFT JOIN r ON name = ref OR starts_with(name, ref || '_') GROUP BY name"""),
    ("subsumed_sequences", _subsumed, """WITH c AS (SELECT DISTINCT c_nationkey AS family, c_custkey::VARCHAR AS s FROM customer)
       SELECT a.family, a.s AS short, b.s AS long FROM c a JOIN c b ON a.family = b.family AND length(a.s) < length(b.s) AND contains(b.s, a.s)
       QUALIFY row_number() OVER (PARTITION BY a.family, a.s ORDER BY length(b.s) DESC, b.s) = 1"""),
    ("cluster_ids", _cluster_ids, f"""WITH {M}, i AS (SELECT cluster, (array_agg(entity ORDER BY n_mut, entity))[1] AS reference FROM m GROUP BY cluster),
       b AS (SELECT *, regexp_replace(regexp_replace(substr(cluster, 1, 7), '^C:', ''), '#[0-9]+$', '') AS base FROM i), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY reference) AS k FROM b)
       SELECT cluster, reference, 'C:' || base || CASE WHEN k > 1 THEN '#' || k::VARCHAR ELSE '' END AS cluster_id FROM n"""),
    ("joined_ids", lambda s, d: naming.joined_ids(table(s, d, "part"), "p_size", "p_type", "p_partkey"), """WITH o AS (SELECT p_size, array_to_string(list_sort(list(DISTINCT p_type)), '/') AS names, min(p_partkey) AS tie FROM part GROUP BY 1)
       SELECT p_size, CASE WHEN count(*) OVER (PARTITION BY names) > 1 THEN names || '#' || tie::VARCHAR ELSE names END AS joined FROM o"""),
    ("locate_spans", _located, """SELECT p_partkey, coalesce(nullif(instr(p, c), 0), nullif(instr(p, q), 0))::INT AS at FROM (SELECT p_partkey, p_type || ' ' || p_name || ' ' || p_brand AS p,
       CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || '!' END AS c, CASE WHEN p_size % 3 <> 0 THEN split_part(p_name, ' ', 1) ELSE '?' END AS q FROM part)"""),
    ("label_links", _links, "SELECT label, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href=\"/([^\"]+)\"', 1)) AS label FROM pages) GROUP BY 1"),
    ("archive_stems", _groups, """SELECT CASE WHEN instr(p, '/') > 0 THEN split_part(p, '/', 1) ELSE regexp_replace(p, '\\.[^.]*$', '') END AS head, count(*) AS n
       FROM (SELECT regexp_replace(url, '^https?://[^/]+/', '') AS p FROM pages) GROUP BY 1"""),
    ("fasta_headers", _headers, """SELECT c_custkey, '>' || c_name || ' OS=' || c_mktsegment || CASE WHEN c_nationkey % 2 = 0 THEN ' NK=' || c_nationkey::VARCHAR ELSE '' END || CASE WHEN c_acctbal < 0 THEN ' BAL=low' ELSE '' END AS head,
       CASE WHEN c_nationkey % 2 <> 0 AND c_acctbal < 0 THEN c_mktsegment || ' BAL=low' ELSE c_mktsegment END AS organism FROM customer"""),
    ("canonical_windows", _windows, f"""WITH d AS (SELECT doc_id, text AS c, greatest(length(text) - 20 - doc_id % 15, 1) AS f, least(greatest(length(text) - 20 - doc_id % 15, 1) + 19, length(text)) AS l FROM documents WHERE text IS NOT NULL)
       SELECT doc_id, {_SUB} AS window, CASE WHEN f - 5 >= 1 AND l + 5 <= length(c) THEN 'construct' ELSE 'short' END AS origin, f - greatest(f - 5, 1) + 1 AS env_first, l - greatest(f - 5, 1) + 1 AS env_last,
       f - 5 >= 1 AND l + 5 <= length(c) AS full FROM d"""),
    ("construct_conflicts", _conflicts, None),
    ("identity_profiles", _identity, None),
]
