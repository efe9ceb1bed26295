"""Tables kept in buckets of a key, so that a log of changes reads and rewrites only the buckets it touches.

``<table>/data/<id>/_bucket=<n>`` holds files, ``<table>/_versions/<v>`` is a small list that says which folder each
bucket of version v is in. An update writes new folders for the buckets it touches and then the next list; readers
stay with the version they began with, and a job that fails leaves nothing but unused files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from alertfold.sources.spool_files import opened

BUCKETS = 256
_BUCKET = "_bucket"


@dataclass
class Version:
    """Which folder each bucket is in; buckets without rows are left out."""

    number: int
    key: str
    buckets: int
    schema: dict
    places: dict[str, str]


def _versions(path: str) -> tuple[fs.FileSystem, str, list[int]]:
    system, folder = opened(path)
    found = system.get_file_info(fs.FileSelector(f"{folder}/_versions", allow_not_found=True))
    return system, folder, sorted(int(i.base_name) for i in found if i.base_name.isdigit())


def current(path: str) -> Version:
    """The newest version of a table."""
    system, folder, numbers = _versions(path)
    if not numbers:
        raise ValueError(f"no table at {path}")
    with system.open_input_stream(f"{folder}/_versions/{numbers[-1]}") as file:
        return Version(**json.loads(file.read()))


def _publish(path: str, version: Version) -> None:
    system, folder, numbers = _versions(path)
    if numbers and numbers[-1] >= version.number:
        raise RuntimeError(f"{path} has been changed by somebody else; begin again")
    system.create_dir(f"{folder}/_versions")
    staged = f"{folder}/_versions/.{uuid.uuid4().hex}"
    with system.open_output_stream(staged) as file:
        file.write(json.dumps(vars(version)).encode())
    system.move(staged, f"{folder}/_versions/{version.number}")


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _written(rows: DataFrame, path: str, key: str, buckets: int) -> dict[str, str]:
    """Write rows by bucket into a new folder; the place of each bucket that got any."""
    place = f"data/{uuid.uuid4().hex}"
    rows.withColumn(_BUCKET, bucket_of(F.col(key), buckets)).write.partitionBy(_BUCKET).parquet(f"{path}/{place}")
    system, folder = opened(path)
    found = system.get_file_info(fs.FileSelector(f"{folder}/{place}"))
    return {i.base_name.split("=")[1]: place for i in found if i.base_name.startswith(f"{_BUCKET}=")}


def write_table(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Make a new table of ``rows``, whose column ``key`` names a row. One shuffle, by bucket."""
    if _versions(path)[2]:
        raise ValueError(f"there is a table at {path}")
    dealt = rows.repartition(buckets, bucket_of(F.col(key), buckets))
    places = _written(dealt, path, key, buckets)
    _publish(path, Version(0, key, buckets, json.loads(rows.schema.json()), places))


def _read(spark: SparkSession, path: str, version: Version, buckets: list[str] | None = None) -> DataFrame:
    chosen = version.places if buckets is None else {b: version.places[b] for b in buckets if b in version.places}
    schema = StructType.fromJson(version.schema)
    if not chosen:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{place}/{_BUCKET}={b}" for b, place in sorted(chosen.items())])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest version. It stays the same rows, whatever is updated meanwhile."""
    return _read(spark, path, current(path))


def update_table(
    spark: SparkSession, path: str, log: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]
) -> int:
    """Apply a log, which has the table's key, to the buckets it touches; the number of those.

    ``apply(base, log)`` gives the rows after the changes and must not give rows of keys that are in neither. What
    is read of the table is written back without a shuffle, as long as ``apply`` makes none. One writer at a time:
    an update that finds a newer version than it began with fails and changes nothing.
    """
    before = current(path)
    touched = [str(r[0]) for r in log.select(bucket_of(F.col(before.key), before.buckets)).distinct().collect()]
    if not touched:
        return 0
    after = apply(_read(spark, path, before, touched), log)
    places = {b: place for b, place in before.places.items() if b not in touched}
    places |= _written(after.select(*StructType.fromJson(before.schema).names), path, before.key, before.buckets)
    _publish(path, replace(before, number=before.number + 1, places=places))
    return len(touched)


def clear_versions(path: str, keep: int = 1) -> None:
    """Delete all but the newest ``keep`` versions, and the files that none of these names."""
    system, folder, numbers = _versions(path)
    named = set()
    for number in numbers[-keep:]:
        with system.open_input_stream(f"{folder}/_versions/{number}") as file:
            named |= {(place, b) for b, place in json.loads(file.read())["places"].items()}
    for number in numbers[:-keep]:
        system.delete_file(f"{folder}/_versions/{number}")
    for info in system.get_file_info(fs.FileSelector(f"{folder}/data", allow_not_found=True)):
        place = f"data/{info.base_name}"
        parts = system.get_file_info(fs.FileSelector(f"{folder}/{place}"))
        used = [p for p in parts if p.base_name.startswith(f"{_BUCKET}=") and (place, p.base_name.split("=")[1]) in named]
        if not used:
            system.delete_dir(f"{folder}/{place}")
            continue
        for part in parts:
            if part.type == fs.FileType.Directory and part not in used:
                system.delete_dir(f"{folder}/{place}/{part.base_name}")
