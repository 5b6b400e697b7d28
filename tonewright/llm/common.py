"""What the operators of this subpackage share: scratch tables and word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The six ASCII white-space characters that separate words. ``bytes.split()``
#: splits at exactly these, so ``text.encode().split()`` gives the words
#: ``[^\x20\x09-\x0D]+`` of a text.
SPACES = "\t\n\x0b\x0c\r "

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where unset (tests)."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="tonewright-")
    return _own_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a reader of it.

    Cuts the lineage: a lost executor costs a re-read of the table, never the
    work before it. The shuffle files of the work are removed once the table is whole. ``drop`` removes a table that no later plan reads.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tonewright-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._tonewright_path = path
    return back


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables made by ``materialize``."""
    for t in tables:
        path = getattr(t, "_tonewright_path", None)
        if path is None:
            continue
        jvm = t.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns (case does not tell names apart)."""
    taken, out = [c.lower() for c in columns], []
    for name in names:
        while any(c.startswith(name) for c in taken):
            name = "_" + name
        out.append(name)
    return out


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that what Python holds of their texts at a time stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
