"""Pairs of sequences within a few edits, found by the words they share, and clusters of such pairs.

An edit spoils at most q words of q letters. So of two sequences whose aligned part has m letters of
each at least and `most` edits at most, m - q + 1 - q * most words are common, counted with their
repeats. Pairs that share fewer are never aligned. A pair with that many in common shares one among the
rarest words of either, all but that number less one, so only these are posted and joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairbench.operators import alignment
from pairbench.operators.components import cut

LONGEST = 4  # letters of a word


def _floor(size: Column, whole: bool, least: float) -> Column:
    """The letters of a sequence of this size that take part in an alignment at least."""
    return size if whole else F.ceil(size * least).cast("int")


def _word(size: Column, most: int, whole: bool, least: float) -> Column:
    """The length of words by which a sequence of this size meets others of its size and more; 0 if it
    is so short that edits can spoil all its letters."""
    n = F.floor(_floor(size, whole, least) / math.ceil(1.5 * (most + 1))).cast("int")
    some = F.when(_floor(size, whole, least) > most, 1).otherwise(0)
    return F.least(F.greatest(n, some), F.lit(LONGEST))


def candidates(seqs: DataFrame, most: int, least: float = 0.6, whole: bool = False) -> DataFrame:
    """(family, a, b): a is shorter than b, or as long and before it; pairs within a family that have
    enough words in common. seqs: (family, seq), distinct. With `whole` all letters are aligned, else
    `least` of the shorter one's. Sequences too short for any word meet all others of their family."""
    own = seqs.withColumn("size", F.length("seq")).withColumn("q", _word(F.col("size"), most, whole, least))
    own = own.withColumn("id", F.xxhash64("family", "seq"))

    def words(q: Column) -> Column:
        """Words with the number of their repeat, as hashes."""
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.col("size") - q + 1, F.lit(1))), lambda i: F.substring(F.col("seq"), i, q))
        return F.when(F.col("size") >= q, every).otherwise(F.array().cast("array<string>"))

    roles = F.transform(F.sequence(F.lit(1), F.greatest(F.col("q"), F.lit(1))), lambda i: i)
    posted = own.where("q > 0").withColumn("w", F.explode(roles))
    every = posted.select("family", "id", "size", "w", (F.col("w") == F.col("q")).alias("home"), F.explode(words(F.col("w"))).alias("word"))
    counted = every.groupBy("family", "id", "size", "w", "home", "word").agg(F.count("*").alias("n"))
    counted = counted.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("word", F.xxhash64("word", "turn"))
    # Rarest first; hashes break ties, so the order is the same for all.
    rarity = counted.groupBy("family", "w", "word").agg(F.count("*").alias("df"))
    ranked = counted.join(rarity, ["family", "w", "word"])
    # The least number of common words that a partner of this sequence in this role can have.
    shortest = own.where("q > 0").groupBy("family", F.col("q").alias("w")).agg(F.min("size").alias("short"))
    need = F.greatest(_floor(F.col("short"), whole, least) - F.col("w") + 1 - F.col("w") * most, F.lit(1))
    ranked = ranked.join(shortest, ["family", "w"]).withColumn("at", F.row_number().over(Window.partitionBy("family", "id", "w").orderBy("df", "word")))
    rare = ranked.where(F.col("at") <= F.greatest(F.col("size") - F.col("w") + 1, F.lit(1)) - need + 1)
    a = rare.where("home").select("family", "w", "word", F.col("id").alias("i"))
    b = rare.select("family", "w", "word", F.col("id").alias("j"))
    met = a.join(b, ["family", "w", "word"]).where("i <> j").select("family", "w", "i", "j").distinct()
    lists = counted.groupBy("family", "id", "w").agg(F.collect_list("word").alias("words"))
    text = own.select("family", "id", "seq", "size")
    both = met.join(lists.select("family", "w", F.col("id").alias("i"), F.col("words").alias("x")), ["family", "w", "i"]).join(lists.select("family", "w", F.col("id").alias("j"), F.col("words").alias("y")), ["family", "w", "j"])
    both = both.join(text.select("family", F.col("id").alias("i"), F.col("seq").alias("a"), F.col("size").alias("m")), ["family", "i"]).join(text.select("family", F.col("id").alias("j"), F.col("seq").alias("b"), F.col("size").alias("n")), ["family", "j"])
    common = F.size(F.array_intersect("x", "y")) >= F.greatest(_floor(F.greatest("m", "n") if whole else F.col("m"), whole, least) - F.col("w") + 1 - F.col("w") * most, F.lit(1))
    order = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("a") < F.col("b")))
    found = both.where(order & common & ((F.col("n") - F.col("m") <= most) if whole else F.lit(True))).select("family", "a", "b")
    tiny = own.where("q = 0").select("family", F.col("seq").alias("a"), F.col("size").alias("m"))
    short = tiny.join(own.select("family", F.col("seq").alias("b"), F.col("size").alias("n")), "family").where(order & ((F.col("n") - F.col("m") <= most) if whole else F.lit(True)))
    return found.unionByName(short.select("family", "a", "b")).distinct()


def unit_edits(a: str, b: str) -> int:
    return 0 if a == b else -1


def near(df: DataFrame, family: str | None, seq: str, most: int = 5, least: float = 0.6, score: alignment.Score = alignment.plain, whole: bool = False) -> DataFrame:
    """(family, a, b, n_edits, n_aligned): the pairs of distinct sequences of a family (of the whole table
    if None) with at most `most` edits and at least `least` of the shorter one aligned. With `whole` both
    are aligned end to end and edits are counted one by one (insertions, deletions, substitutions)."""
    group = F.col(family).cast("string") if family else F.lit("")
    seqs = df.where(F.col(seq).isNotNull() & (F.col(seq) != "")).select(F.coalesce(group, F.lit("")).alias("family"), F.col(seq).alias("seq")).distinct()
    asked = candidates(cut(seqs), most, least, whole)
    pairs = asked.select("a", "b").distinct()

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = list(zip(batch["a"], batch["b"], strict=True))
            if whole:
                columns = alignment.align_all(rows, unit_edits, -1, -1, False)
                got = [(sum(i < 0 or j < 0 or a[i] != b[j] for i, j in zip(x.tolist(), y.tolist(), strict=True)), int(((x >= 0) & (y >= 0)).sum())) for (a, b), (x, y) in zip(rows, columns, strict=True)]
            else:
                # The longer one is the reference, as in clustering.
                got = [g[:3:2] for g in alignment.edit_profiles([(b, a) for a, b in rows], score)]
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "n_edits": [g[0] for g in got], "n_aligned": [g[1] for g in got]})

    known = pairs.mapInPandas(run, "a string, b string, n_edits long, n_aligned long")
    enough = F.col("n_edits") <= most
    if not whole:
        enough &= F.col("n_aligned") >= least * F.greatest(F.length("a"), F.lit(1))
    return asked.join(known.where(enough), ["a", "b"]).select("family", "a", "b", "n_edits", "n_aligned")


def first_seeds(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, seed) of greedy selection in the order of ids: an id joins the first seed it is paired with, or
    becomes a seed. nodes: (id); pairs: (u, v), u < v. In each round all ids are decided whose first
    partner that may still be a seed is one (they join it), or that have none left (they are seeds), which
    gives the same as one by one. The table is cut in the shared folder each round."""
    pairs = cut(pairs.select("u", "v").distinct())
    state = cut(nodes.select("id", F.lit(None).cast(nodes.schema["id"].dataType).alias("seed")))
    while True:
        # A partner that has joined another seed is no seed.
        live = pairs.join(state.select(F.col("id").alias("u"), F.col("seed").alias("of")), "u").where("of IS NULL OR of = u")
        first = live.groupBy("v").agg(F.min(F.struct("u", "of")).alias("first"))
        now = state.join(first, F.col("id") == F.col("v"), "left")
        seed = F.when(F.col("seed").isNotNull(), F.col("seed")).when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.of"))
        state = cut(now.select("id", seed.alias("seed")))
        if state.where("seed IS NULL").isEmpty():
            return state


def clusters(df: DataFrame, family: str, key: str, seq: str, most: int = 5, least: float = 0.6, score: alignment.Score = alignment.plain) -> DataFrame:
    """(key, family, seed_seq): the clusters of the sequential rule (longest first, then by sequence; each
    joins the first seed within `most` edits and `least` overlap, or becomes one), a family over many
    tasks. Null and empty sequences take no part; a null family is one of its own."""
    own = df.where(F.col(seq).isNotNull() & (F.col(seq) != ""))
    place = lambda f, s: F.struct(F.coalesce(f.cast("string"), F.lit("")).alias("f"), (-F.length(s)).alias("l"), s.alias("s"))
    nodes = own.select(place(F.col(family), F.col(seq)).alias("id")).distinct()
    # b is the longer one and comes first; of equal length, a does.
    pairs = near(own, family, seq, most, least, score)
    x, y = place(F.col("family"), F.col("a")), place(F.col("family"), F.col("b"))
    found = first_seeds(nodes, pairs.select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")))
    seeds = found.select("id", F.col("seed.s").alias("seed_seq"))
    return own.join(seeds, place(F.col(family), F.col(seq)) == F.col("id")).select(key, family, "seed_seq")
