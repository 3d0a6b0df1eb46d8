"""The closed schema of a measurement table: coercion to it, and its checks as one small table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    required: bool = True


# Names, order, types and bounds of the interchange table.
FIELDS = [
    Field("pair_id", "string"),
    Field("dbd_seq", "string"),
    Field("dbd_family", "string"),
    Field("dbd_source", "string"),
    Field("wt_id", "string"),
    Field("n_mut_from_wt", "int"),
    Field("mut_positions", "string", False),
    Field("protein_id", "string", False),
    Field("species", "string", False),
    Field("dna_seq", "string"),
    Field("dna_len", "int"),
    Field("dna_context", "string"),
    Field("label", "tinyint"),
    Field("raw_score", "double"),
    Field("score_type", "string"),
    Field("threshold_pos", "double"),
    Field("threshold_neg", "double"),
    Field("assay", "string"),
    Field("stringency", "string", False),
    Field("neg_provenance", "string", False),
    Field("source_dataset", "string"),
    Field("source_file", "string"),
]
RESIDUES, BASES = "ACDEFGHIKLMNPQRSTVWY", "ACGT"
CONTEXTS, PROVENANCE, MOST_BASES, ID_KEYS = ["full", "core_only"], ["assayed_unbound", "selection_absent", "synthetic"], 20, ["dbd_seq", "dna_seq", "assay", "stringency"]


def pair_id(keys: list[str] = ID_KEYS) -> Column:
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys])
    return F.substring(F.sha2(text, 256), 1, 24)


DERIVED = {"pair_id": lambda: pair_id(), "dna_len": lambda: F.length("dna_seq")}


def schema() -> T.StructType:
    return T.StructType([T.StructField(f.name, T._parse_datatype_string(f.kind), True) for f in FIELDS])


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schema())


def coerce(df: DataFrame) -> DataFrame:
    """df in the closed schema: unknown columns and missing required ones are errors, missing optional
    ones are null, derived ones are computed if all their values are missing."""
    names = [f.name for f in FIELDS]
    if extra := [c for c in df.columns if c not in names]:
        raise ValueError(f"unexpected columns: {extra}")
    if lost := [f.name for f in FIELDS if f.required and f.name not in df.columns and f.name not in DERIVED]:
        raise ValueError(f"missing columns: {lost}")
    given = [c for c in DERIVED if c in df.columns]
    filled = df.select([F.count(c).alias(c) for c in given]).first() if given else None
    derive = {c for c in DERIVED if c not in given or not filled[c]}
    base = df.select(*[c for c in df.columns if c not in derive], *[F.lit(None).cast(f.kind).alias(f.name) for f in FIELDS if f.name not in df.columns and f.name not in derive])
    return base.select([(DERIVED[f.name]() if f.name in derive else F.col(f.name)).cast(f.kind).alias(f.name) for f in FIELDS])


def literals(df: DataFrame, **values) -> DataFrame:
    """df with constant columns; provenance stays only where the label is 0."""
    out = df.withColumns({k: F.lit(v) for k, v in values.items()})
    return out.withColumn("neg_provenance", F.when(F.col("label") == 0, F.col("neg_provenance"))) if "neg_provenance" in out.columns else out


def tidy_keys(df: DataFrame, key: str, score: str) -> DataFrame:
    """Keys trimmed and in upper case; rows without a score go."""
    return df.withColumn(key, F.upper(F.trim(key))).where(F.col(score).isNotNull())


def _positions(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p) != "")


def _report(df: DataFrame, severity: str, checks: dict[str, tuple[Column, Column]], weight: Column) -> DataFrame:
    """One aggregate: for each check the rows behind it and its least offending value."""
    cells = []
    for name, (bad, value) in checks.items():
        rows = F.coalesce(F.sum(F.when(bad, weight)), F.lit(0)).cast("long")
        cells.append(F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"), rows.alias("n_rows"), F.min(F.when(bad, value.cast("string"))).alias("example")))
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def validate(df: DataFrame) -> DataFrame:
    """(check, severity, n_rows, example) for every rule. Rules on constructs run over distinct
    constructs weighted by their rows; rules on clusters count clusters."""
    one = F.lit(1)
    col = F.col
    rows = {f"null:{f.name}": (col(f.name).isNull(), F.lit("")) for f in FIELDS if f.required}
    negative, provenance = col("label") == 0, col("neg_provenance")
    rows |= {
        "dna_alphabet": (col("dna_seq").rlike(f"[^{BASES}]"), col("dna_seq")),
        "dna_len": (F.length("dna_seq") != col("dna_len"), col("dna_seq")),
        "dna_too_long": (col("dna_len") > MOST_BASES, col("dna_seq")),
        "dna_context": (F.coalesce(~col("dna_context").isin(CONTEXTS), F.lit(True)), col("dna_context")),
        "label": (F.coalesce(~col("label").isin(-1, 0, 1), F.lit(True)), col("label")),
        "provenance_missing": (negative & (F.trim(F.coalesce(provenance, F.lit(""))) == ""), col("source_dataset")),
        "provenance_unknown": (provenance.isNotNull() & ~provenance.isin(PROVENANCE), provenance),
        "score_bounds": ((col("score_type") == "pbm_escore") & ~col("raw_score").between(-0.5, 0.5), col("source_dataset")),
        "thresholds": (col("threshold_pos") < col("threshold_neg"), col("source_dataset")),
        "pair_id": (pair_id() != col("pair_id"), col("pair_id")),
    }
    notes = {"provenance_on_others": (~negative & provenance.isNotNull(), provenance)}
    repeated = df.groupBy("pair_id").agg((F.count("*") - 1).alias("n")).where("n > 0")
    twice = _report(repeated, "error", {"pair_id_duplicate": (F.lit(True), col("pair_id"))}, col("n"))

    axis = df.groupBy("dbd_seq", "wt_id", "mut_positions", "n_mut_from_wt").agg(F.count("*").alias("n"))
    lengths = axis.where("n_mut_from_wt = 0").groupBy("wt_id").agg(F.min(F.length("dbd_seq")).alias("ref_len"))
    axis = axis.join(lengths, "wt_id", "left").withColumn("p", _positions(col("mut_positions")))
    seq, given = col("dbd_seq"), F.transform("p", lambda p: F.trim(p).try_cast("int"))
    outside = F.exists(given, lambda p: p.isNull() | (col("ref_len").isNotNull() & ((p < 1) | (p > col("ref_len")))))
    constructs = {
        "residue_alphabet": (F.upper(seq).rlike(f"[^{RESIDUES}X]"), seq),
        "residue_unresolved": (F.upper(seq).rlike(f"[^{RESIDUES}]"), seq),
        "residue_case": (seq != F.upper(seq), seq),
        "mutations_negative": (col("n_mut_from_wt") < 0, seq),
        "position_count": (F.size("p") != col("n_mut_from_wt"), col("mut_positions")),
        "position_range": (F.coalesce(outside, F.lit(False)), col("mut_positions")),
    }
    unresolved = {"residue_x": (F.instr(seq, "X") > 0, seq)}
    x_count = col("n") * (F.length(seq) - F.length(F.replace(seq, F.lit("X"), F.lit(""))))

    clusters = axis.groupBy("wt_id").agg(F.min("n_mut_from_wt").alias("least"), F.count_distinct(F.length("dbd_seq")).alias("lengths"))
    wide = {
        "reference_elsewhere": (col("least") > 0, col("wt_id")),
        "reference_missing": (col("least").isNull() | (col("least") < 0), col("wt_id")),
        "ragged": (col("lengths") > 1, col("wt_id")),
    }
    parts = [
        _report(df, "error", rows, one),
        _report(df, "warning", notes, one),
        twice,
        _report(axis, "error", constructs, col("n")),
        _report(axis, "warning", unresolved, x_count),
        _report(clusters, "warning", wide, one),
        _report(df.limit(1), "error", {"no_rows": (F.lit(False), F.lit(""))}, one).withColumn("n_rows", F.lit(0 if df.head(1) else 1).cast("long")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def stats(df: DataFrame) -> DataFrame:
    """One row of counts: labels, rates, clusters, entities, sites."""
    pos, neg, gray = (F.count_if(F.col("label") == x) for x in (1, 0, -1))
    return df.agg(
        F.count("*").alias("n_rows"), pos.alias("n_pos"), neg.alias("n_neg"), gray.alias("n_gray"), F.round(pos / F.nullif(F.count("*"), F.lit(0)), 6).alias("pos_rate"),
        F.round(neg / F.nullif(pos, F.lit(0)), 2).alias("neg_per_pos"), F.count_distinct("wt_id").alias("n_clusters"), F.count_distinct("dbd_seq").alias("n_dbd"), F.count_distinct("dna_seq").alias("n_dna"),
    )


def family_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("dbd_family").agg(F.count("*").alias("n"))


def completeness(df: DataFrame, experiment: str, expected: int, near: float = 0.99) -> DataFrame:
    """Rows of each experiment against those expected: complete, near_complete, truncated or too_many."""
    n = df.groupBy(experiment).agg(F.count("*").alias("n"))
    status = F.when(F.col("n") == expected, "complete").when(F.col("n") > expected, "too_many").when(F.col("n") >= near * expected, "near_complete").otherwise("truncated")
    return n.withColumn("status", status)
