"""Readers and writers of feeds, pairs, reports and models' registry."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from kithline.functions.text import NA_TOKENS, null_tokens


def separator(spark: SparkSession, path: str, among: Sequence[str] = ("\t", ",", ";", "|")) -> str:
    """The sign that occurs most often in the first line of a delimited file; the first of equal ones."""
    row = spark.read.text(path).first()
    return max(among, key=row[0].count) if row else among[0]


def read_text_feed(spark: SparkSession, path: str, columns: Sequence[str], sep: str | None = None, na: Sequence[str] = NA_TOKENS) -> DataFrame:
    """A delimited file with a header, all columns as text, without inference; texts for missing values become null.  The separator is found if it isn't given."""
    sep = sep or separator(spark, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return null_tokens(spark.read.csv(path, schema=schema, header=True, sep=sep, nullValue=None, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False), na)


def read_reviewed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reviewed pairs from CSV with a declared schema; rows without a category are dropped."""
    df = null_tokens(spark.read.csv(path, schema=schema, header=True), ("", "NA"))
    return df.where("category is not null")


def read_table(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """A DataFrame as it is, a path as Parquet, any other text as a table's name."""
    if isinstance(source, DataFrame):
        return source
    return spark.read.parquet(source) if "/" in source else spark.table(source)


def write_csv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str] = ()) -> None:
    """The columns as CSV with a header, ordered over all files if an order is given."""
    out = df.select(*columns)
    (out.orderBy(*order) if order else out).write.mode("overwrite").csv(path, header=True)


def write_review(pairs: DataFrame, directory: str, key: str = "phone_number") -> None:
    """Pairs to review and the others as CSV, both ordered by key, and all of them as Parquet."""
    cols = [key, *[f"{c}_name{i}" for c in ("first", "middle", "last") for i in (1, 2)]]
    write_csv(pairs.where("keep = 1"), f"{directory}/review", cols, [key])
    write_csv(pairs.where("keep = 0"), f"{directory}/no_review", cols, [key])
    pairs.select(*cols, "keep").write.mode("overwrite").parquet(f"{directory}/pairs")


def write_stage(tables: dict[str, DataFrame], directory: str) -> None:
    """What a stage hands to the next (name tables, pairs, features, train and test rows, predictions), each as a Parquet table of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{directory}/{name}")


def write_reports(tables: dict[str, DataFrame], directory: str) -> None:
    """Small report tables, one CSV folder each."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").csv(f"{directory}/{name}", header=True)


def _registry(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/registry.json")
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def save_registry(spark: SparkSession, path: str, entries: dict[str, dict]) -> None:
    """Where models are, as JSON beside them, on whatever file system the path names."""
    p, fs = _registry(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(entries).encode()))
    out.close()


def load_registry(spark: SparkSession, path: str) -> dict[str, dict]:
    text = spark.read.text(f"{path}/registry.json", wholetext=True).first()
    return json.loads(text[0])
