"""The table bundle, loading with the declared schema, and the generic sinks."""

from __future__ import annotations

import dataclasses
from collections.abc import Collection, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from slotwise.sources.schema import SCHEMAS, TABLES


@dataclasses.dataclass(frozen=True)
class Tables:
    users: DataFrame
    court_owners: DataFrame
    courts: DataFrame
    court_images: DataFrame
    bookings: DataFrame
    reviews: DataFrame
    court_availability: DataFrame
    payments: DataFrame
    payouts: DataFrame
    promotions: DataFrame
    promotion_targets: DataFrame
    voucher_usage: DataFrame

    def replace(self, **frames: DataFrame) -> "Tables":
        return dataclasses.replace(self, **frames)

    def items(self) -> Iterable[tuple[str, DataFrame]]:
        for name in TABLES:
            yield name, getattr(self, name)


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Cast known columns to the declared types; add absent declared columns as NULL."""
    schema = SCHEMAS[name]
    present = set(df.columns)
    cols = []
    for field in schema.fields:
        if field.name in present:
            cols.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    extra = [F.col(c) for c in df.columns if c not in schema.fieldNames()]
    return df.select(*cols, *extra)


def read_if_present(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The parquet folder ``path``, or None when there is no such folder; every other failure is raised."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_tables(spark: SparkSession, path: str, optional: Collection[str] = ()) -> Tables:
    """Read ``{path}/{table}`` parquet for each of the twelve tables, with the declared schema.

    A table whose folder does not exist is an error, unless ``optional`` names
    it: then it is empty (a new deployment has no payments or usage yet).
    """
    frames = {}
    for name in TABLES:
        df = read_if_present(spark, f"{path}/{name}", SCHEMAS[name])
        if df is None:
            if name not in optional:
                raise FileNotFoundError(f"table {name}: {path}/{name} does not exist")
            df = empty_table(spark, name)
        frames[name] = df.select(*SCHEMAS[name].fieldNames())
    return Tables(**frames)


def ensure_columns(df: DataFrame, columns: Mapping[str, tuple[T.DataType | str, object]]) -> DataFrame:
    """Add only the columns that are missing, typed, with their default value."""
    missing = {name: F.lit(default).cast(dtype) for name, (dtype, default) in columns.items()
               if name not in df.columns}
    return df.withColumns(missing) if missing else df


def insert_or_ignore(df: DataFrame, new: DataFrame, unique: Sequence[Sequence[str]],
                     order: str = "id") -> DataFrame:
    """Append rows of ``new`` whose unique keys are absent from ``df``.

    Inside the batch, rows are taken in ``order`` and a row is ignored when an
    earlier inserted row shares a key, as sequential ``INSERT OR IGNORE`` does.
    """
    from slotwise.plans.greedy import first_wins

    batch = new
    for key in unique:
        key = list(key)
        batch = batch.join(df.select(*key).dropna().distinct(), on=key, how="left_anti")
    kept, _ = first_wins(batch, unique, order)
    return df.unionByName(kept.select(*df.columns))


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: Sequence[str] | None = None) -> None:
    """Persist a result as parquet (bookings are best partitioned by booking_date).

    A partitioned write first brings the rows of one partition value together
    with a rebalance: Spark splits large values over several tasks and merges
    small ones, so a value gets few files however many tasks made the rows.
    """
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)
