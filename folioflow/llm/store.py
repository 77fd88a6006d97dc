"""Intermediate tables and files in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import shared_dir

#: Arrow batches that fit a small Python worker even where texts are long, and Parquet batches that fit the heap (by default
#: 4,096 texts, in arrays that are made anew, twice as large, as they fill).
OPTIONS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
    "spark.sql.parquet.columnarReaderBatchSize": "512",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options these operators count on."""
    for option, value in OPTIONS.items():
        spark.conf.set(option, value)
    return spark


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later reads recompute nothing and survive lost executors."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a path without scheme is local."""
    uri = f"file://{uri}" if uri.startswith("/") else uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, parts) -> int:
    """Write byte strings to a new file and return its size."""
    store, path = opened(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    size = 0
    with store.open_output_stream(path, compression=None) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    return size


def read_bytes(uri: str) -> bytes:
    store, path = opened(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


def commit(spark: SparkSession, folder: str, names: list[tuple[str, str]], manifest: bytes) -> None:
    """Give the finished temporary files their names, then publish the manifest; a folder without one isn't complete.

    Files are named by tasks. A task that is repeated finds files that have their names already.
    """
    store, path = opened(folder)
    store.create_dir(path, recursive=True)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = opened(folder)
        for batch in batches:
            for temporary, final in zip(batch.column("temporary").to_pylist(), batch.column("final").to_pylist(), strict=True):
                kinds = [x.type for x in own.get_file_info([f"{at}/{temporary}", f"{at}/{final}"])]
                if kinds[0] == fs.FileType.File:
                    own.move(f"{at}/{temporary}", f"{at}/{final}")
                elif kinds[1] != fs.FileType.File:
                    raise FileNotFoundError(f"{folder}/{temporary}")
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    if names:
        rows = spark.createDataFrame(names, "temporary string, final string")
        rows.repartition(min(len(names), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(name, "n long").collect()
    with store.open_output_stream(f"{path}/_manifest.tmp", compression=None) as out:
        out.write(manifest)
    store.move(f"{path}/_manifest.tmp", f"{path}/manifest.json")


def shielded(docs: DataFrame, *helpers: Column) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table with its columns named by their places, so that no helper column can clash with one, whatever its name,
    and the helpers beside them; and what gives the columns back, with their names and in their order."""
    places = [(f"_c{k}", name) for k, name in enumerate(docs.columns)]
    quoted = [F.col("`" + name.replace("`", "``") + "`").alias(place) for place, name in places]

    def restored(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(place).alias(name) for place, name in places])

    return docs.select(*quoted, *helpers), restored


def with_text(docs: DataFrame) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """``shielded`` with the text as a string, ``text``; the names of the table's own columns there; and what gives them back.

    A text that is a string already is one of them, so that no task gets it twice."""
    if docs.columns.count("text") != 1 or docs.schema["text"].dataType != T.StringType():
        rows, restored = shielded(docs, F.col("text").cast("string").alias("text"))
        return rows, rows.columns[:-1], restored
    rows, restored = shielded(docs)
    place = rows.columns[docs.columns.index("text")]
    rows = rows.withColumnRenamed(place, "text")
    return rows, rows.columns, lambda found: restored(found.withColumnRenamed("text", place))
