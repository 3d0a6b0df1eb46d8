"""Holdout splits by hashed order: reproducible in any engine, independent per group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairbench.operators import ordering


def draw(seed: str, key: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string")), 256)


def balanced_folds(df: DataFrame, key: str, folds: int, seed: str) -> DataFrame:
    """Distinct keys dealt to folds whose sizes differ by one at most."""
    keys, total = ordering.running(df.select(key).distinct().withColumn("_draw", draw(seed, F.col(key))), ["_draw", key])
    return keys.select(key, (ordering.tile(F.col("before"), total, folds) + 1).cast("int").alias("fold"))


def variant_fraction(df: DataFrame, group: str, key: str, fraction: float, seed: str) -> DataFrame:
    keys = df.select(group, key).distinct()
    w = Window.partitionBy(group)
    rank = F.row_number().over(w.orderBy(draw(seed, F.col(key)), key))
    return keys.withColumn("rank", rank).withColumn("n", F.count("*").over(w)).where(F.col("rank") <= F.greatest(F.lit(1), F.bround(F.col("n") * fraction))).select(group, key)


def digest(df: DataFrame, group: str, key: str) -> DataFrame:
    text = F.array_join(F.array_sort(F.collect_set(F.col(key).cast("string"))), "\n")
    return df.groupBy(group).agg(F.substring(F.sha2(text, 256), 1, 12).alias("digest"))


def smallest_first(df: DataFrame, group: str, share: float) -> DataFrame:
    """Whole groups, smallest first, until the target is reached."""
    n, total = ordering.running(df.groupBy(group).agg(F.count("*").alias("n")), ["n", group], "n")
    return n.where(F.col("before") < total * share).select(group, "n")


def _one_task(groups: DataFrame, run, schema: str) -> DataFrame:
    """A sequential rule over one row a group; the rows themselves stay distributed."""
    return groups.coalesce(1).mapInPandas(lambda batches: iter([run(pd.concat(list(batches), ignore_index=True))]), schema)


def group_folds(df: DataFrame, group: str, folds: int, seed: str) -> DataFrame:
    """(group, n, fold): whole groups, largest first, each into the emptiest fold, the lowest of equal ones."""
    n = df.groupBy(F.col(group).cast("string").alias(group)).agg(F.count("*").alias("n")).withColumn("draw", draw(seed, F.col(group)))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["n", "draw"], ascending=[False, True])
        filled, fold = [0] * folds, []
        for size in own["n"]:
            fold.append(filled.index(min(filled)))
            filled[fold[-1]] += size
        return own[[group, "n"]].assign(fold=fold)

    return _one_task(n, run, f"`{group}` string, n long, fold long")


def validation_carve(df: DataFrame, group: str, share: float, seed: str, slack: float = 1.25) -> DataFrame:
    """(group, n) set aside, in hashed order until the target: groups that would pass slack times the
    target are skipped; if all would, the smallest is taken."""
    n = df.groupBy(F.col(group).cast("string").alias(group)).agg(F.count("*").alias("n")).withColumn("draw", draw(seed, F.col(group)))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        target, got, taken = own["n"].sum() * share, 0, []
        for i, size in own.sort_values("draw")["n"].items():
            if got < target and got + size <= slack * target:
                taken.append(i)
                got += size
        if not taken and len(own):
            taken = [own.sort_values(["n", "draw"]).index[0]]
        return own.loc[taken, [group, "n"]]

    return _one_task(n, run, f"`{group}` string, n long")


def overlap(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Number of keys on both sides of a split; 0 if disjoint."""
    return train.select(key).distinct().join(test.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n_shared"))
