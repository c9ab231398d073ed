"""Files in and out; schemas are always given, so nothing is read twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=header)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """name, size, modified of the files under a path, without their bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("name"), F.col("length").alias("size"), "modificationTime")


def zip_entries(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, size, data of each entry of zip files, one file at a time in a task."""

    def entries(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            for where, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for info in z.infolist():
                        yield pa.RecordBatch.from_arrays([pa.array([where]), pa.array([info.filename]), pa.array([info.file_size], pa.int64()), pa.array([z.read(info)], pa.binary())], names=["archive", "name", "size", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(entries, "archive string, name string, size long, data binary")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
