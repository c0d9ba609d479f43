"""Helpers that the text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word in the sense of the counting contracts: a maximal run without ASCII white space.
WORD_JAVA = r"[^\x20\x09-\x0D]+"

#: The folder that holds this package; Python workers started on the same machine import it from there.
#: On a cluster the package is shipped with --py-files.
ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark (the path may be in any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """mapInArrow by workers that can import this package."""
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return df.mapInArrow(fn, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. A local session without one gets its own; a cluster must name one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="wayfold-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The same cut for larger tables: written as Parquet (compressed) in the shared folder and reread."""
    path = f"{folder or shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that `stored` wrote and nobody reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        deleted(df.sparkSession, path)


class Scratch:
    """Tables that are needed only while a result is made: a folder in the shared one, deleted at the end.

    Inside, shuffle files are deleted as soon as the query that wrote them has ended (a Spark setting, put back at
    the end), so many small steps don't fill the disks.
    """

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        self.before = self.spark.conf.get(self.CLEANUP, None)
        self.spark.conf.set(self.CLEANUP, "true")
        return self

    def __exit__(self, *_: object) -> None:
        if self.before is None:
            self.spark.conf.unset(self.CLEANUP)
        else:
            self.spark.conf.set(self.CLEANUP, self.before)
        deleted(self.spark, self.folder)

    def stored(self, df: DataFrame) -> DataFrame:
        return stored(df, self.folder)


def map_texts(df: DataFrame, fn: Callable[[list], dict[str, list]], schema: str, text: str = "text", keep: list[str] | None = None, rows: int = 512) -> DataFrame:
    """Adds columns that a function computes from slices of at most `rows` texts.

    fn gets a list of str or None and returns {column: values}; schema declares those columns (DDL).
    The columns named in `keep` (default: all but the text and those of an added name) go along. Row-wise, so no shuffle.
    """
    added = df.sparkSession.createDataFrame([], schema).schema
    keep = [c for c in df.columns if c != text and c not in added.names] if keep is None else keep
    fields = [df.schema[c] for c in keep] + list(added)
    out = StructType(fields)
    target = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                made = fn(batch.column(batch.num_columns - 1).to_pylist())
                arrays = [batch.column(i).cast(target.field(i).type) for i in range(len(keep))]
                arrays += [pa.array(made[f.name], type=target.field(f.name).type) for f in added]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return arrow_map(df.select(*keep, F.col(text).cast("string").alias("__text")), run, out)


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_JAVA)), F.lit(0)).cast("long")


def sql_regex_count(column: str) -> str:
    """The same count in the oracle's SQL."""
    return f"len(regexp_extract_all(coalesce({column}, ''), '[^\\x20\\x09-\\x0D]+'))"


_ASCII_UPPER = re.compile("[A-Z]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def lower_ascii(text: str) -> str:
    """Lower-cases A-Z and nothing else."""
    return text.translate(_LOWER) if _ASCII_UPPER.search(text) else text
