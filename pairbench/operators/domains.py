"""Domain calls from hits: co-located hits collapse, whitelisted families, padded window, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIT = "struct<score:double,family:string,first:int,last:int>"


def collapse(hits: Column, share: float = 0.5) -> Column:
    """Greedy choice among an array of hits (score, family, first, last): by falling score and length,
    a hit goes if it overlaps a kept one by over `share` of the shorter. One sequence has few hits."""
    span = lambda h: h["last"] - h["first"] + 1
    order = F.transform(hits, lambda h: F.struct((-h["score"]).alias("a"), (-span(h)).alias("b"), h["family"].alias("c"), h["first"].alias("d"), h.alias("hit")))
    ranked = F.transform(F.array_sort(order), lambda x: x["hit"])
    shared = lambda x, y: F.least(x["last"], y["last"]) - F.greatest(x["first"], y["first"]) + 1
    clash = lambda kept, h: F.exists(kept, lambda k: shared(k, h) > share * F.least(span(k), span(h)))
    return F.aggregate(ranked, F.array().cast(f"array<{HIT}>"), lambda kept, h: F.when(clash(kept, h), kept).otherwise(F.array_append(kept, h.cast(HIT))))


def call(df: DataFrame, seq: str, hits: str, families: list[str], pad: int = 10, repeats: bool = False) -> DataFrame:
    """df with status (ok, no_domain, mixed, repeat_array, nonstandard), label, and the window's first
    and last residue (1-based) and text. hits: array of (score, family, first, last)."""
    allowed = F.filter(F.col(hits), lambda h: h["family"].isin(families))
    kept = collapse(F.coalesce(allowed, F.array().cast(f"array<{HIT}>")))
    out = df.withColumn("kept", kept).withColumn("names", F.array_sort(F.array_distinct(F.transform("kept", lambda h: h["family"]))))
    some = F.size("kept") > 0  # without a hit there is no window
    first = F.when(some, F.greatest(F.array_min(F.transform("kept", lambda h: h["first"])) - pad, F.lit(1)))
    last = F.when(some, F.least(F.array_max(F.transform("kept", lambda h: h["last"])) + pad, F.length(seq)))
    out = out.withColumn("first", first).withColumn("last", last).withColumn("window", F.col(seq).substr(F.col("first"), F.col("last") - F.col("first") + 1))
    many = (F.size("kept") > 1) & F.lit(not repeats)
    status = F.when(F.size("kept") == 0, "no_domain").when(F.size("names") > 1, "mixed").when(many, "repeat_array").when(F.col("window").rlike("[^ACDEFGHIKLMNPQRSTVWY]"), "nonstandard").otherwise("ok")
    return out.withColumn("status", status).withColumn("label", F.array_join("names", ", ")).drop("kept", "names")
