"""Names and identifiers: aliases, placeholders, namespaces, longest prefixes, containment, cluster ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tidy(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def organism(name: Column, placeholders: list[str], aliases: dict[str, str], cached: Column) -> Column:
    """The name with single spaces; a placeholder or nothing gives the cached name or ''; then its alias."""
    clean = tidy(F.coalesce(name, F.lit("")))
    known = F.when(F.lower(clean).isin([p.lower() for p in placeholders] + [""]), F.coalesce(tidy(cached), F.lit(""))).otherwise(clean)
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    return F.coalesce(table[known], known) if aliases else known


def namespace(name: Column, kinds: list[tuple[str, str]], otherwise: str = "unknown") -> Column:
    """The first kind whose pattern the name matches."""
    out = F.lit(otherwise)
    for kind, pattern in reversed(kinds):
        out = F.when(name.rlike(pattern), kind).otherwise(out)
    return out


def resolve_tokens(df: DataFrame, text: str, known: DataFrame, ignore: list[str], manual: dict[str, str], separator: str = ",") -> DataFrame:
    """(token, target, status, n): every token of a list column, as ignored, manual, resolved (in lower
    case by `known`: token, target) or unresolved."""
    tokens = df.select(F.explode(F.split(text, separator)).alias("t")).select(F.trim("t").alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))
    table = F.create_map(*[F.lit(x) for pair in manual.items() for x in pair])
    out = tokens.withColumn("low", F.lower("token")).join(known.select(F.lower("token").alias("low"), F.col("target").alias("found")).dropDuplicates(["low"]), "low", "left")
    status = F.when(F.col("token").isin(ignore), "ignored").when(table[F.col("token")].isNotNull(), "manual").when(F.col("found").isNotNull(), "resolved").otherwise("unresolved")
    target = F.when(F.col("token").isin(ignore), None).otherwise(F.coalesce(table[F.col("token")], F.col("found")))
    return out.select("token", target.alias("target"), status.alias("status"), "n")


def longest_prefix(names: DataFrame, references: DataFrame, name: str, ref: str, separator: str = "_") -> DataFrame:
    """(name, ref): a name's own reference, or the longest one that it begins with, up to a separator;
    NULL if there is none. Every prefix of a name is looked up by an equi-join."""
    own = names.select(F.col(name).alias("name")).distinct()
    parts = F.split("name", F.lit(separator.replace("|", "\\|")))
    cut = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))
    found = own.select("name", F.explode(cut).alias("ref")).join(references.select(F.col(ref).alias("ref")).distinct(), "ref")
    best = found.groupBy("name").agg(F.max_by("ref", F.length("ref")).alias("ref"))
    return own.join(best, "name", "left")


def subsumed(df: DataFrame, family: str, seq: str, seed: int = 4) -> DataFrame:
    """(family, short, long): each distinct sequence that a longer one of its family contains, with the
    longest such (ties to the least). Candidates share the short one's first `seed` letters, so no two
    sequences meet without a seed; sequences under `seed` letters meet by all they have."""
    own = df.select(F.col(family).alias("family"), F.col(seq).alias("s")).where(F.col("s") != "").distinct()
    head = own.select("family", F.col("s").alias("short"), F.substring("s", 1, seed).alias("key"))

    def grams(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length("s")), lambda i: F.substring(F.col("s"), i, F.lit(n)))

    sizes = own.where(F.length("s") < seed).agg(F.collect_set(F.length("s")).alias("n")).first()["n"]  # seed - 1 numbers at most
    every = F.flatten(F.array(*[grams(n) for n in sorted({seed, *sizes})]))
    body = own.select("family", F.col("s").alias("long"), F.explode(F.array_distinct(every)).alias("key"))
    met = head.join(body, ["family", "key"]).where((F.length("short") < F.length("long")) & (F.instr("long", F.col("short")) > 0))
    best = F.min(F.struct((-F.length("long")).alias("n"), "long")).alias("m")
    return met.groupBy("family", "short").agg(best).select("family", "short", F.col("m.long").alias("long"))


def cluster_ids(df: DataFrame, base: str, reference: str) -> DataFrame:
    """df with cluster_id: "C:" and the base name; the second and later clusters of a base, in the order
    of their references, take "#2", "#3" and so on. A name that already begins with "C:" is stripped."""
    plain = F.regexp_replace(F.regexp_replace(F.col(base), "^C:", ""), r"#\d+$", "")
    nth = F.row_number().over(Window.partitionBy(plain).orderBy(reference))
    return df.withColumn("cluster_id", F.concat(F.lit("C:"), plain, F.when(nth > 1, F.concat(F.lit("#"), nth.cast("string"))).otherwise("")))


def joined_ids(df: DataFrame, key: str, name: str, tie: str) -> DataFrame:
    """(key, joined): the key's names joined by "/"; keys with the same names take "#" and their least tie."""
    own = df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(name)), "/").alias("names"), F.min(tie).alias("tie"))
    same = F.count("*").over(Window.partitionBy("names")) > 1
    return own.select(key, F.when(same, F.concat("names", F.lit("#"), F.col("tie").cast("string"))).otherwise(F.col("names")).alias("joined"))


def strip_keys(names: Column, prefix: str) -> Column:
    """A map with the prefix taken from its keys; it must hold 'REF'."""
    out = F.transform_keys(names, lambda k, _: F.regexp_replace(k, f"^{prefix}", ""))
    return F.when(F.map_contains_key(out, "REF"), out).otherwise(F.raise_error(F.lit("no reference sequence")))


def archive_group(path: Column) -> Column:
    """The first folder of a path, or the file's stem if the archive is flat."""
    return F.when(F.instr(path, "/") > 0, F.split_part(path, F.lit("/"), F.lit(1))).otherwise(F.regexp_replace(path, r"\.[^.]*$", ""))


def labels(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def header(name: Column, fields: dict[str, Column]) -> Column:
    """A FASTA header: the name and key=value for every field that is not null."""
    return F.concat_ws(" ", F.concat(F.lit(">"), name), *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in fields.items()])


def fasta_fields(head: Column) -> Column:
    """organism, reviewed and fragment of a sequence header."""
    return F.struct(
        F.nullif(F.regexp_extract(head, r"OS=(.+?)(?: [A-Z]{2}=|$)", 1), F.lit("")).alias("organism"), F.startswith(head, F.lit(">sp")).alias("reviewed"), F.contains(head, F.lit("(Fragment)")).alias("fragment")
    )
