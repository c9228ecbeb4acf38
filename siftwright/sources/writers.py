"""Writing result tables, one folder per stage, partitioned by dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Stage folders in pipeline order.
STAGES = ["data", "preprocess", "associations", "prompt", "hypotheses", "validation", "summary"]

_NESTED = (T.ArrayType, T.MapType, T.StructType)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that the table fits a CSV file."""
    return df.select(*[
        F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, _NESTED) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = flat(df).write.mode("overwrite").option("header", True).option("escape", '"')
    (writer.partitionBy(by) if by else writer).csv(path)


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("ignoreNullFields", False)
    (writer.partitionBy(by) if by else writer).json(path)


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_text(df: DataFrame, path: str, column: str, by: str | None = None) -> None:
    """One file row per line of `column`."""
    keep = [by] if by else []
    writer = df.select(*keep, F.col(column).alias("value")).write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).text(path)


class StageStore:
    """Result folders root/<stage>/<table>/dataset=<name>/."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, stage: str, table: str) -> str:
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage!r}; stages are {STAGES}")
        return f"{self.root}/{stage}/{table}"

    def save(self, stage: str, table: str, df: DataFrame, form: str = "parquet") -> str:
        path = self.path(stage, table)
        by = "dataset" if "dataset" in df.columns else None
        {"parquet": write_parquet, "csv": write_csv, "json": write_json}[form](df, path, by)
        return path

    def load(self, stage: str, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(stage, table))
