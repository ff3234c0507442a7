"""Scans of the formats the pipeline reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallygrid.session import cut_lineage

#: Column types of a raw match feed; every other column is text (fixed values).
FEED_INTS = ("draw_size", "match_num", "best_of", "minutes", "winner_ht", "winner_rank", "winner_rank_points", "loser_ht", "loser_rank", "loser_rank_points", *[f"{s}_{c}" for s in "wl" for c in ("ace", "df", "svpt", "1stIn", "1stWon", "2ndWon", "SvGms", "bpSaved", "bpFaced")])
FEED_DOUBLES = ("winner_age", "loser_age")


def feed_schema(columns: Sequence[str]) -> T.StructType:
    kind = lambda c: T.IntegerType() if c in FEED_INTS else T.DoubleType() if c in FEED_DOUBLES else T.StringType()
    return T.StructType([T.StructField(c, kind(c)) for c in columns])


def scan_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, skip_names: Sequence[str] = (), recursive: bool = False) -> DataFrame:
    """CSV with a header and an explicit schema (no inference pass); bad cells are null, bad
    lines go to ``_corrupt``. Files whose name holds one of ``skip_names`` are left out; adds
    ``source_file`` and ``season`` (the leading four digits of the name, else null)."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    reader = spark.read.schema(full).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    df = reader.option("ignoreCorruptFiles", True).csv(path)
    return provenance(df, skip_names)


def provenance(df: DataFrame, skip_names: Sequence[str] = ()) -> DataFrame:
    """Adds the file's name and season, in place of columns of these names in the file."""
    own = [F.col(f"`{c}`") for c in df.columns if c not in ("source_file", "season")]
    out = df.select(*own, F.col("_metadata.file_name").alias("source_file"))
    for part in skip_names:
        out = out.filter(~F.contains("source_file", F.lit(part)))
    return out.withColumn("season", F.substring("source_file", 1, 4).try_cast("int"))


def scan_parquet(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    reader = spark.read.option("mergeSchema", False).option("ignoreCorruptFiles", True)
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    paths = [path] if isinstance(path, str) else path
    return reader.parquet(*paths)


def scan_mixed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV and Parquet files below a folder, united by name; bad lines stay in ``_corrupt``."""
    return scan_csv(spark, path, schema, recursive=True).unionByName(provenance(scan_parquet(spark, path, recursive=True)), allowMissingColumns=True)


def scan_report(df: DataFrame) -> DataFrame:
    """``source_file, n, n_corrupt`` of a scan that kept ``_corrupt`` and ``source_file``; a file that is listed
    in a folder but not here gave no row (unreadable or empty)."""
    # Bad lines are only known once a line is read whole, so the rows are written first.
    return cut_lineage(df).groupBy("source_file").agg(F.count("*").alias("n"), F.count("_corrupt").alias("n_corrupt"))


def scan_json_list(spark: SparkSession, path: str, list_column: str, schema: T.StructType) -> DataFrame:
    """One row per element of the list in each JSON document, with its position from 1."""
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    return docs.select("*", F.posexplode_outer(list_column).alias("pos", "item")).drop(list_column).withColumn("pos", F.col("pos") + 1)


def scan_excel(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """A workbook, read on the driver as workbooks are small by format (about a million rows);
    needs an Excel reader of pandas, which may be absent."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading Excel files needs openpyxl") from e
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet).astype("string"))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no rows in {what}")
    return df


def days_ahead(df: DataFrame, date: str, first: Column, days: int) -> DataFrame:
    """Rows dated within ``days`` from the first day on; prunes partitions by date."""
    return df.filter(F.col(date).between(first, F.date_add(first, days)))
