"""Helpers shared by the operators: stored intermediates, word splitting, held-out rows, Arrow batch sizes."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.session import checkpoint_dir

#: The six ASCII white-space characters of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Session settings that operators change while they run.
SETTINGS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch",
            "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold")
_held: ContextVar[list[str] | None] = ContextVar("held", default=None)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a fresh scratch folder only on a local master that names none."""
    local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    if local and not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        return checkpoint_dir(spark, fallback=tempfile.mkdtemp(prefix="slotwise-llm-"))
    return checkpoint_dir(spark)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, partition_by: str | None = None, compression: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: the plan is cut and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.option("compression", compression)
    writer = writer.partitionBy(partition_by) if partition_by else writer
    held = _held.get()
    if held is not None:
        held.append(path)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Delete the files of frames that ``store`` returned, once nothing reads them any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/llm-" in folder:
                _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def finished(name: str) -> Callable:
    """Decorator: the frame that an operator returns is stored; then all that the call stored before it is deleted and ``SETTINGS`` are put back."""
    def decorate(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def run(rows: DataFrame, *args, **options) -> DataFrame:
            spark = rows.sparkSession
            before = {s: spark.conf.get(s, None) for s in SETTINGS}
            held: list[str] = []
            around = _held.get()
            _held.set(held)
            try:
                result = operator(rows, *args, **options)
                _held.set(around)
                return store(result, name)  # it belongs to the enclosing call, if there is one
            finally:
                _held.set(around)
                for folder in held:
                    _delete(spark, folder)
                for s, value in before.items():
                    spark.conf.unset(s) if value is None else spark.conf.set(s, value)
        return run
    return decorate


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch of texts holds, in rows and in bytes (a single longer row is a batch of its own)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null text: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0 (a null id counts as the empty text, which is held out)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
