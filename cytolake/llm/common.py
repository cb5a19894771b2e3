"""Helpers shared by the text operators: reading tables, cutting lineage, chunking text."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import pandas_udf

#: White space as Unicode defines it; Python's own \s also holds the separators 0x1c-0x1f.
SPACE = "\t-\r \x85\xa0  -     　"

#: Cuts a text where the byte-level pre-tokeniser always cuts it: a run of other characters with at
#: most one blank before it, or white space up to the last character before such a run.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session (tests) may leave it unset: its warehouse takes its place."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir") + "/intermediate"
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialised table that no later plan reads."""
    spark = df.sparkSession
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_udf(one: Callable[[str | None], tuple], result: str):
    """A Pandas UDF from a text column to a struct of `result` (DDL), by a function of one text."""
    columns = [x.split()[0] for x in result.split(", ")]

    @pandas_udf(result)
    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=columns, dtype=object)

    return rows
