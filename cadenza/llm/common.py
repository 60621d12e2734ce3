"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from cadenza.session import ensure_checkpoint_dir

# the contracts' white space: space and the ASCII controls 9 to 13
WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WRITTEN: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the session's shared checkpoint folder."""
    _WRITTEN.append(f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def work_paths() -> list[str]:
    """The folders named so far and not dropped, in order."""
    return list(_WRITTEN)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that ``work_path`` has named: nothing may read them any more."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _WRITTEN.remove(path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: cuts
    the lineage, and a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_arrow(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """``docs``, to be handed to Arrow tasks: Spark's default of 10,000 rows a
    batch is lowered, as a row here is a whole text.  A session with a setting of its
    own keeps it."""
    conf = docs.sparkSession.conf
    if conf.get(_ROWS) == "10000":
        conf.set(_ROWS, str(rows))
    return docs


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Return a worker's unused memory to the system: an idle worker keeps no
    more than it must."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def small_batches(batches, text_col: int, max_bytes: int = 2_000_000,
                  max_rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds about ``max_bytes`` of text
    (one long row may exceed it) and at most ``max_rows`` rows: the working
    arrays of a task stay bounded whatever the batch settings are."""
    for batch in batches:
        col, start, size = batch.column(text_col), 0, 0
        lengths = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and (size + n > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if len(lengths) > start:
            yield batch.slice(start)
    give_back()


def word_table(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words of the texts (runs without space or ASCII controls 9 to 13): the
    number of each word, the distinct words, and each text's first word (one
    more entry than texts).  A null text has no word."""
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    bounds = np.asarray(words.offsets, np.int64)
    bounds = bounds - bounds[0]
    coded = words.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    number = np.asarray(coded.indices, np.int64) if len(coded) else np.zeros(0, np.int64)
    if "" in distinct:  # before a leading and after a trailing separator
        real = number != distinct.index("")
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        number = number[real]
    return number, distinct, bounds
