"""Several tables written as one: readers see all of a batch's new tables, or all of the old ones.

Each publication writes its tables to folders of their own. Only when all are complete does a version file name the folder of
every table, those that the batch left alone included; it is written aside and renamed into place, and its number is reserved before by
creating a file that must not exist, so of two publications from the same version one fails. Readers follow the version file with
the greatest number, so a job that dies between two tables leaves nothing but folders that no version names.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from slotwise.sources.schema import SCHEMAS
from slotwise.sources.tables import write_table


class PublishConflict(RuntimeError):
    """Another publication took the next version first."""


def _hadoop(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def _listed(spark: SparkSession, root: str) -> tuple[int, int]:
    """The greatest complete version and the greatest reserved one; 0 if there is none."""
    fs, folder = _hadoop(spark, f"{root}/_versions")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    found = lambda kind: max([int(m[1]) for n in names if (m := re.fullmatch(rf"(\d+)\.{kind}", n))], default=0)
    return found("json"), found("taken")


def current(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """``(version, {table: folder})`` that readers see."""
    version, _ = _listed(spark, root)
    if not version:
        return 0, {}
    return version, json.loads(spark.read.text(f"{root}/_versions/{version:012d}.json", wholetext=True).first()[0])


def _commit(spark: SparkSession, root: str, version: int, folders: Mapping[str, str]) -> None:
    fs, taken = _hadoop(spark, f"{root}/_versions/{version:012d}.taken")
    if fs.exists(taken) or not fs.createNewFile(taken):
        raise PublishConflict(f"version {version} of {root} is taken")
    _, aside = _hadoop(spark, f"{root}/_versions/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
    out.close()
    _, named = _hadoop(spark, f"{root}/_versions/{version:012d}.json")
    if not fs.rename(aside, named):
        raise PublishConflict(f"version {version} of {root} could not be put in place")


def publish(spark: SparkSession, root: str, frames: Mapping[str, DataFrame],
            partition_by: Mapping[str, Sequence[str]] | None = None) -> int:
    """Write ``frames`` (table name -> new contents) and make them visible together; the new version.

    The frames may read the tables that they replace, whose folders stay. A publication that began from a version that has
    been followed meanwhile raises ``PublishConflict`` and changes nothing that readers see.
    """
    version, folders = current(spark, root)
    _, taken = _listed(spark, root)
    new = {name: f"{root}/{name}/{uuid.uuid4().hex}" for name in frames}
    for name, df in frames.items():
        write_table(df, new[name], partition_by=(partition_by or {}).get(name))
    if _listed(spark, root)[0] != version:
        raise PublishConflict(f"{root} has moved on from version {version}")
    _commit(spark, root, max(version, taken) + 1, folders | new)
    return max(version, taken) + 1


def read(spark: SparkSession, root: str, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The published tables ``names`` (all by default), all of the same version, with their declared schema where there is one."""
    _, folders = current(spark, root)
    out = {}
    for name in names or sorted(folders):
        if name not in folders:
            raise FileNotFoundError(f"{root} has published no table {name}")
        found = spark.read.parquet(folders[name])
        out[name] = found.select(*[c for c in SCHEMAS[name].fieldNames() if c in found.columns]) if name in SCHEMAS else found
    return out
