"""Queries on the closed schema: a stand-in table with natural faults, its checks and its counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbench.operators import contract
from pairbench.sources.tables import table

#: The stand-in: residues from part names, bases from order numbers, faults from discounts and taxes.
RAW_SQL = """t AS (
  SELECT upper(replace(p_name, ' ', '')) AS dbd_seq, p_type AS dbd_family, 'part' AS dbd_source, p_brand AS wt_id,
         (p_size % 3)::INT AS n_mut_from_wt, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '1' WHEN 2 THEN '1,2' ELSE '40' END AS mut_positions,
         p_partkey::VARCHAR AS protein_id, NULL::VARCHAR AS species,
         translate(l_orderkey::VARCHAR, '0123456789', 'ACGTACGTAN') AS dna_seq,
         (length(l_orderkey::VARCHAR) + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END)::INT AS dna_len,
         CASE WHEN l_returnflag = 'R' THEN 'other' WHEN l_linestatus = 'O' THEN 'full' ELSE 'core_only' END AS dna_context,
         (CASE WHEN l_tax = 0.08 THEN 2 WHEN l_quantity >= 47.5 THEN 1 WHEN l_quantity <= 42.5 THEN 0 ELSE -1 END)::TINYINT AS label,
         CASE WHEN l_quantity = 50 AND l_tax = 0 THEN 0.6 ELSE l_quantity / 50.0 - 0.5 END AS raw_score, 'pbm_escore' AS score_type,
         CASE WHEN l_tax = 0.07 THEN 0.3 ELSE 0.45 END AS threshold_pos, 0.35 AS threshold_neg, 'PBM' AS assay, l_linenumber::VARCHAR AS stringency,
         CASE WHEN l_discount = 0.1 THEN 'guess' WHEN l_quantity <= 42.5 AND l_discount > 0 THEN 'assayed_unbound' WHEN l_discount = 0.05 THEN 'synthetic' END AS neg_provenance,
         'S' || l_suppkey::VARCHAR AS source_dataset, 'lineitem' AS source_file
  FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT substr(sha256(dbd_seq || chr(31) || dna_seq || chr(31) || assay || chr(31) || stringency), 1, 24) AS pair_id, * FROM t)"""


def raw(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    size, q, tax, off, key = (F.col(c) for c in ("p_size", "l_quantity", "l_tax", "l_discount", "l_orderkey"))
    return lines.select(
        F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("dbd_seq"),
        F.col("p_type").alias("dbd_family"),
        F.lit("part").alias("dbd_source"),
        F.col("p_brand").alias("wt_id"),
        (size % 3).alias("n_mut_from_wt"),
        F.when(size % 4 == 0, "").when(size % 4 == 1, "1").when(size % 4 == 2, "1,2").otherwise("40").alias("mut_positions"),
        F.col("p_partkey").cast("string").alias("protein_id"),
        F.translate(key.cast("string"), "0123456789", "ACGTACGTAN").alias("dna_seq"),
        (F.length(key.cast("string")) + F.when(F.col("l_linenumber") == 7, 1).otherwise(0)).alias("dna_len"),
        F.when(F.col("l_returnflag") == "R", "other").when(F.col("l_linestatus") == "O", "full").otherwise("core_only").alias("dna_context"),
        F.when(tax == 0.08, 2).when(q >= 47.5, 1).when(q <= 42.5, 0).otherwise(-1).alias("label"),
        F.when((q == 50) & (tax == 0), 0.6).otherwise(q / 50.0 - 0.5).alias("raw_score"),
        F.lit("pbm_escore").alias("score_type"),
        F.when(tax == 0.07, 0.3).otherwise(0.45).alias("threshold_pos"),
        F.lit(0.35).alias("threshold_neg"),
        F.lit("PBM").alias("assay"),
        F.col("l_linenumber").cast("string").alias("stringency"),
        F.when(off == 0.1, "guess").when((q <= 42.5) & (off > 0), "assayed_unbound").when(off == 0.05, "synthetic").alias("neg_provenance"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source_dataset"),
        F.lit("lineitem").alias("source_file"),
    )


def _row(name: str, severity: str, bad: str, example: str, frm: str = "c", n: str = "count(*) FILTER ({})") -> str:
    return f"SELECT '{name}' AS \"check\", '{severity}' AS severity, coalesce({n.format(bad)}, 0)::BIGINT AS n_rows, min({example}) FILTER ({bad}) AS example FROM {frm}"


_N = "sum(n) FILTER ({})"
CHECKS_SQL = "WITH " + RAW_SQL + """,
a AS (SELECT dbd_seq, wt_id, mut_positions, n_mut_from_wt, count(*) AS n FROM c GROUP BY ALL),
l AS (SELECT wt_id, min(length(dbd_seq)) AS ref_len FROM a WHERE n_mut_from_wt = 0 GROUP BY 1),
x AS (SELECT a.*, ref_len, list_transform(list_filter(string_split(coalesce(mut_positions, ''), ','), lambda p: trim(p) <> ''), lambda p: trim(p)::INT) AS p FROM a LEFT JOIN l USING (wt_id)),
w AS (SELECT wt_id, min(n_mut_from_wt) AS least, count(DISTINCT length(dbd_seq)) AS lengths FROM a GROUP BY 1),
r AS (SELECT pair_id, count(*) - 1 AS n FROM c GROUP BY 1 HAVING count(*) > 1)
""" + "\nUNION ALL ".join(
    [_row(f"null:{f.name}", "error", f"{f.name} IS NULL", "''") for f in contract.FIELDS if f.required]
    + [
        _row("dna_alphabet", "error", "regexp_matches(dna_seq, '[^ACGT]')", "dna_seq"),
        _row("dna_len", "error", "length(dna_seq) <> dna_len", "dna_seq"),
        _row("dna_too_long", "error", "dna_len > 20", "dna_seq"),
        _row("dna_context", "error", "dna_context NOT IN ('full', 'core_only')", "dna_context"),
        _row("label", "error", "label NOT IN (-1, 0, 1)", "label::VARCHAR"),
        _row("provenance_missing", "error", "label = 0 AND trim(coalesce(neg_provenance, '')) = ''", "source_dataset"),
        _row("provenance_unknown", "error", "neg_provenance NOT IN ('assayed_unbound', 'selection_absent', 'synthetic')", "neg_provenance"),
        _row("score_bounds", "error", "score_type = 'pbm_escore' AND (raw_score < -0.5 OR raw_score > 0.5)", "source_dataset"),
        _row("thresholds", "error", "threshold_pos < threshold_neg", "source_dataset"),
        _row("pair_id", "error", "pair_id <> substr(sha256(concat_ws(chr(31), dbd_seq, dna_seq, assay, coalesce(stringency, ''))), 1, 24)", "pair_id"),
        _row("provenance_on_others", "warning", "label <> 0 AND neg_provenance IS NOT NULL", "neg_provenance"),
        _row("pair_id_duplicate", "error", "true", "pair_id", "r", _N),
        _row("residue_alphabet", "error", "regexp_matches(upper(dbd_seq), '[^ACDEFGHIKLMNPQRSTVWYX]')", "dbd_seq", "x", _N),
        _row("residue_unresolved", "error", "regexp_matches(upper(dbd_seq), '[^ACDEFGHIKLMNPQRSTVWY]')", "dbd_seq", "x", _N),
        _row("residue_case", "error", "dbd_seq <> upper(dbd_seq)", "dbd_seq", "x", _N),
        _row("mutations_negative", "error", "n_mut_from_wt < 0", "dbd_seq", "x", _N),
        _row("position_count", "error", "len(p) <> n_mut_from_wt", "mut_positions", "x", _N),
        _row("position_range", "error", "coalesce(list_min(p) < 1 OR list_max(p) > ref_len, false)", "mut_positions", "x", _N),
        _row("residue_x", "warning", "dbd_seq LIKE '%X%'", "dbd_seq", "x", "sum(n * (length(dbd_seq) - length(replace(dbd_seq, 'X', '')))) FILTER ({})"),
        _row("reference_elsewhere", "warning", "least > 0", "wt_id", "w"),
        _row("reference_missing", "warning", "least IS NULL OR least < 0", "wt_id", "w"),
        _row("ragged", "warning", "lengths > 1", "wt_id", "w"),
        "SELECT 'no_rows', 'error', (count(*) = 0)::BIGINT, NULL FROM c",
    ]
)
STATS_SQL = f"""WITH {RAW_SQL} SELECT count(*) AS n_rows, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, count(*) FILTER (label = -1) AS n_gray,
  round(count(*) FILTER (label = 1) / count(*), 6) AS pos_rate, round(count(*) FILTER (label = 0) / nullif(count(*) FILTER (label = 1), 0), 2) AS neg_per_pos,
  count(DISTINCT wt_id) AS n_clusters, count(DISTINCT dbd_seq) AS n_dbd, count(DISTINCT dna_seq) AS n_dna FROM c"""
COERCE_SQL = f"""WITH {RAW_SQL} SELECT source_dataset, count(*) AS n, count(species) AS n_species, count(DISTINCT pair_id) AS n_ids, min(pair_id) AS first_id,
  round(sum(raw_score), 6) AS total, sum(dna_len)::BIGINT AS bases FROM c GROUP BY 1"""
COMPLETE_SQL = """WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT *, CASE WHEN n = 4 THEN 'complete' WHEN n > 4 THEN 'too_many' WHEN n >= 0.75 * 4 THEN 'near_complete' ELSE 'truncated' END AS status FROM n"""


def _coerced(s: SparkSession, d: str) -> DataFrame:
    got = contract.coerce(raw(s, d)).groupBy("source_dataset")
    return got.agg(
        F.count("*").alias("n"), F.count("species").alias("n_species"), F.count_distinct("pair_id").alias("n_ids"), F.min("pair_id").alias("first_id"),
        F.round(F.sum("raw_score"), 6).alias("total"), F.sum("dna_len").alias("bases"),
    )


CATALOG = [
    ("schema_contract", lambda s, d: contract.validate(contract.coerce(raw(s, d))), CHECKS_SQL),
    ("schema_coerce", _coerced, COERCE_SQL),
    ("schema_stats", lambda s, d: contract.stats(contract.coerce(raw(s, d))), STATS_SQL),
    ("experiment_completeness", lambda s, d: contract.completeness(table(s, d, "lineitem"), "l_orderkey", 4, 0.75), COMPLETE_SQL),
]
