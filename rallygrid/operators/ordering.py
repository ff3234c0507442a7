"""Row numbers, exact splits and joins that keep both sides' columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallygrid.session import cut_lineage


def global_row_number(df: DataFrame, order: Sequence[Column], name: str = "id") -> DataFrame:
    """Rows numbered from 0 in a total order: a sort in ranges, numbers inside each range, and the
    sizes of the ranges before (a row a partition). No task orders all rows."""
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_k", inside).join(F.broadcast(before), "_part").withColumn(name, (F.col("_base") + F.col("_k") - 1).cast("long")).drop("_part", "_k", "_base")


def digest_order(*columns: str, seed: int = 42) -> Column:
    """A repeatable pseudo-random text of the columns' values, the same in any engine."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.8) -> DataFrame:
    """Adds ``part``: of every class exactly floor(share * n) rows are ``train``, the rest ``test``.

    Rows of a class are ordered by a digest of the key. The rows are counted per class and
    leading digits of the digest (4,096 cells a class); only the cell that holds the border is ordered
    row by row, so a class of a third of all rows isn't sorted by one task. Ties by key."""
    rows = df.withColumn("_h", digest_order(key)).withColumn("_cell", F.substring("_h", 1, 3))
    cells = rows.groupBy(label, "_cell").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(label).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_upto", F.sum("_n").over(upto)).withColumn(
        "_want", F.floor(F.sum("_n").over(Window.partitionBy(label)) * F.lit(share) + F.lit(1e-9)) - (F.col("_upto") - F.col("_n"))
    )
    marked = rows.withColumnRenamed(label, "_label").join(
        cells.select(F.col(label).alias("_of"), F.col("_cell").alias("_at"), "_n", "_want"),
        F.col("_label").eqNullSafe(F.col("_of")) & (F.col("_cell") == F.col("_at")),
    )
    inside = F.row_number().over(Window.partitionBy("_label", F.when((F.col("_want") > 0) & (F.col("_want") < F.col("_n")), F.col("_cell")).otherwise(F.col("_h"))).orderBy("_h", key))
    train = F.when(F.col("_want") <= 0, False).when(F.col("_want") >= F.col("_n"), True).otherwise(inside <= F.col("_want"))
    return marked.withColumn("part", F.when(train, "train").otherwise("test")).withColumnRenamed("_label", label).select(*df.columns, "part")


def join_with_suffixes(left: DataFrame, right: DataFrame, on: Sequence[str], suffixes: tuple[str, str] = ("_x", "_y"), how: str = "inner") -> DataFrame:
    """An equi-join in which columns of both sides, the keys apart, get a suffix."""
    both = (set(left.columns) & set(right.columns)) - set(on)
    named = lambda df, suffix: df.select(*[F.col(f"`{c}`").alias(f"{c}{suffix}" if c in both else c) for c in df.columns])
    return named(left, suffixes[0]).join(named(right, suffixes[1]), list(on), how)


def first_known(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Per key and column the first value that is known, in ascending order of the given columns; they may come
    from different rows. Pre-aggregated; null where none is known."""
    return df.groupBy(*keys).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])
