"""Sinks: Parquet, CSV and JSON reports, model folders."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession

from rallygrid.operators.ordering import global_row_number


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_parquet_indexed(df: DataFrame, path: str, order: list[Column]) -> None:
    """Parquet with a running index kept as ``__index_level_0__``."""
    write_parquet(global_row_number(df, order, "__index_level_0__"), path)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_json_note(values: dict, path: str) -> None:
    """A small note as one JSON file, on any file system Spark knows."""
    fs, where = _file_system(SparkSession.active(), path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(json.dumps(values, indent=2, sort_keys=True).encode()))
    finally:
        out.close()


def read_json_note(path: str) -> dict:
    rows = SparkSession.active().read.text(path, wholetext=True).collect()  # one small file
    return json.loads(rows[0]["value"])


def remove(path: str) -> bool:
    """Drop a file or folder, as of a cache; False if there was none."""
    fs, where = _file_system(SparkSession.active(), path)
    return bool(fs.delete(where, True))


def model_folder(root: str, tour: str, surface: str, engine: str, version: str) -> str:
    return f"{root}/{tour}_{surface}_{engine}_{version}".lower()


def save_model(model: PipelineModel, folder: str, features: list[str], metrics: dict, metadata: dict | None = None) -> None:
    model.write().overwrite().save(f"{folder}/model")
    write_json_note({"features": features, "metrics": metrics, "metadata": metadata or {}}, f"{folder}/notes.json")


def load_model(folder: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{folder}/model"), read_json_note(f"{folder}/notes.json")
