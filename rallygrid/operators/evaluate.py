"""Classification metrics without a driver loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Cells per unit of a score or value in which sums run first.
CELLS = 1_024


def auc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """ROC-AUC by ranks with ties shared, over counts per distinct score, in two levels: sums run
    over cells of scores (about a thousand for probabilities), then inside each cell, so no task
    orders all scores of a group."""
    by = by or []
    one = by or [F.lit(1).alias("_all")]
    keys = by or ["_all"]
    cell = F.floor(F.col(score) * CELLS).alias("_cell")
    counts = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*one, cell, F.col(score).alias("_s")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("_p"), F.sum((F.col(label) != 1).cast("long")).alias("_n")
    )
    before = lambda *p: Window.partitionBy(*keys, *p[:-1]).orderBy(p[-1]).rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_m")).withColumn("_base", F.coalesce(F.sum("_m").over(before("_cell")), F.lit(0))).drop("_m")
    below = F.col("_base") + F.coalesce(F.sum("_n").over(before("_cell", "_s")), F.lit(0))
    wins = counts.join(cells, [*keys, "_cell"]).withColumn("_u", F.col("_p") * (below + F.col("_n") / 2))
    out = wins.groupBy(*keys).agg(F.sum("_u").alias("_u"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    return out.select(*by, F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_u") / (F.col("_p") * F.col("_n"))).alias("auc"))


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str]) -> DataFrame:
    """``*by, q``: exact quantiles with linear interpolation, as an array in the order of ``shares``.

    Counts per distinct value run up over cells of values and then inside the cells that hold a
    wanted rank, so no task orders or holds all values of a group. Null keys are no group, null values no value."""
    by = list(by)
    counts = df.filter(" and ".join(f"`{c}` is not null" for c in (*by, value))).groupBy(*by, F.floor(F.col(value) * CELLS).alias("_cell"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    cells = counts.groupBy(*by, "_cell").agg(F.sum("_n").alias("_m"))
    upto = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_base", F.coalesce(F.sum("_m").over(upto), F.lit(0))).withColumn("_all", F.sum("_m").over(Window.partitionBy(*by)))
    at = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_all") - 1)).alias("pos")) for i, p in enumerate(shares)])
    ranks = F.flatten(F.transform(at, lambda x: F.array(F.struct(x.i.alias("i"), x.pos.alias("pos"), F.floor(x.pos).alias("k")), F.struct(x.i.alias("i"), x.pos.alias("pos"), F.ceil(x.pos).alias("k")))))
    inside = lambda low, n: lambda x: (x.k >= F.col(low)) & (x.k < F.col(low) + F.col(n))
    cells = cells.withColumn("_asked", F.filter(F.array_distinct(ranks), inside("_base", "_m"))).filter(F.size("_asked") > 0)
    rows = counts.join(cells, [*by, "_cell"])
    low = F.col("_base") + F.coalesce(F.sum("_n").over(Window.partitionBy(*by, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = rows.withColumn("_low", low).select(*by, "_v", F.explode(F.filter("_asked", inside("_low", "_n"))).alias("x"))
    share = F.col("x.pos") - F.floor("x.pos")
    weight = F.when(F.floor("x.pos") == F.ceil("x.pos"), 1.0).when(F.col("x.k") == F.floor("x.pos"), 1 - share).otherwise(share)
    each = hits.groupBy(*by, F.col("x.i").alias("i")).agg(F.sum(F.col("_v") * weight).alias("q"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x.q).alias("q"))  # a row per share


def probability_scores(df: DataFrame, label: str, p: str, by: list[str] | None = None, eps: float = 1e-15) -> DataFrame:
    """n, accuracy at 0.5, Brier score and log-loss."""
    y, q = F.col(label).cast("double"), F.col(p)
    clipped = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), q))
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.avg(((q >= 0.5).cast("int") == y.cast("int")).cast("int")).alias("accuracy"),
        F.avg((q - y) * (q - y)).alias("brier"),
        F.avg(-y * F.log(clipped) - (1 - y) * F.log(1 - clipped)).alias("log_loss"),
    )


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 per class."""
    rows = df.select(F.explode(F.array(F.struct(F.col(label).alias("c"), F.lit(1).alias("is_true")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("is_true")))).alias("x"), (F.col(label) == F.col(predicted)).alias("hit"))
    g = rows.groupBy(F.col("x.c").alias("class")).agg(
        F.sum(F.when(F.col("x.is_true") == 1, 1).otherwise(0)).cast("long").alias("support"),
        F.sum(F.when(F.col("x.is_true") == 0, 1).otherwise(0)).cast("long").alias("guessed"),
        F.sum(F.when((F.col("x.is_true") == 1) & F.col("hit"), 1).otherwise(0)).cast("long").alias("hits"),
    )
    precision = F.try_divide(F.col("hits"), F.col("guessed"))
    recall = F.try_divide(F.col("hits"), F.col("support"))
    return g.select("class", "support", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * F.col("hits"), F.col("support") + F.col("guessed")).alias("f1"))
