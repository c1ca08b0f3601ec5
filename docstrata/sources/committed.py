"""A versioned table on plain Parquet: upserts and deletes rewrite only the files that hold their keys, and commit at once.

``data`` holds Parquet files, never changed once written; ``versions`` has one manifest for each version, which names the files
of the table with the range of their first key and their number of rows. A change writes its files first and then adds the
next manifest by a rename that does not overwrite: readers see the version before or the one after, and of two writers
of one version one wins. The other looks at what the winner did: a change that touched other files and other keys is
added on top, any other raises ``Conflict`` and its files are removed. The rename is as atomic as the file system makes it
(HDFS does; a store without such a rename needs a catalogue of its own).
"""

from __future__ import annotations

import bisect
import json
import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from docstrata.sources.shared import remove, stored

FILE_ROWS = 1_000_000
_RANGED = ("bigint", "int", "smallint", "tinyint", "string")  # keys whose ranges are kept; of others every file is looked into


class Conflict(Exception):
    """Another writer changed the same files or keys since the change was prepared."""


@dataclass
class Manifest:
    version: int
    schema: t.StructType
    keys: list[str]
    files: dict[str, tuple]  # name below the folder -> least first key, greatest, rows


@dataclass
class Change:
    """A prepared change: files to go and to come, on top of a version, and the keys it is about."""

    base: Manifest
    gone: set[str] = field(default_factory=set)
    come: dict[str, tuple] = field(default_factory=dict)
    keys: DataFrame | None = None
    part: str = ""


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, folder: str) -> list[int]:
    fs, where = _fs(spark, f"{folder}/versions")
    if not fs.exists(where):
        return []
    return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(where) if s.getPath().getName().endswith(".json"))


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> Manifest:
    """The manifest of a version, or of the newest one."""
    version = _names(spark, folder)[-1] if version is None else version
    lines = spark.sparkContext.wholeTextFiles(f"{folder}/versions/{version:012d}.json").collect()
    spec = json.loads(lines[0][1])
    return Manifest(version, t.StructType.fromJson(spec["schema"]), spec["keys"], {k: tuple(v) for k, v in spec["files"].items()})


def _commit(spark: SparkSession, folder: str, new: Manifest) -> bool:
    """Adds the manifest as its version, unless that version is there already."""
    spec = {"schema": new.schema.jsonValue(), "keys": new.keys, "files": new.files}
    fs, hidden = _fs(spark, f"{folder}/versions/.{uuid.uuid4().hex}")
    out = fs.create(hidden, False)
    out.write(json.dumps(spec).encode())
    out.close()
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{folder}/versions/{new.version:012d}.json")
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        context.rename(hidden, target, options)
        return True
    except Exception as e:
        fs.delete(hidden, False)
        if "FileAlreadyExists" in str(e) or fs.exists(target):
            return False
        raise


def create(folder: str, rows: DataFrame, *keys: str, file_rows: int = FILE_ROWS) -> Manifest:
    """A new table of ``rows``, whose ``keys`` are unique and not null, as version 0. Raises ``Conflict`` if there is one already."""
    spark = rows.sparkSession
    base = Manifest(-1, rows.schema, list(keys), {})
    if _names(spark, folder):
        raise Conflict(f"there is a table in {folder}")
    _check_keys(rows, base)
    part, files = _written(spark, folder, base, rows, file_rows)
    new = Manifest(0, rows.schema, list(keys), files)
    if not _commit(spark, folder, new):
        remove(spark, f"{folder}/{part}")
        raise Conflict(f"there is a table in {folder}")
    return new


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The rows of one version (the newest by default), whatever is committed meanwhile."""
    at = manifest(spark, folder, version)
    return _of_files(spark, folder, at, at.files)


def _of_files(spark: SparkSession, folder: str, at: Manifest, names) -> DataFrame:
    names = list(names)
    return spark.read.schema(at.schema).parquet(*(f"{folder}/{n}" for n in names)) if names else spark.createDataFrame([], at.schema)


def _check_keys(rows: DataFrame, at: Manifest) -> None:
    bad = rows.groupBy(*at.keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1 OR " + " OR ".join(f"`{k}` IS NULL" for k in at.keys))
    if bad.limit(1).count():
        raise ValueError(f"keys {at.keys} must be unique and not null")


def _written(spark: SparkSession, folder: str, at: Manifest, rows: DataFrame, file_rows: int) -> tuple[str, dict[str, tuple]]:
    """Files of ``rows`` in ranges of the first key: their folder, and each with its range."""
    rows = stored(rows.select(*at.schema.names))
    total = rows.count()
    part = f"data/{uuid.uuid4().hex}"
    if not total:
        return part, {}
    first = at.keys[0]
    rows.repartitionByRange(-(-total // file_rows), *at.keys).sortWithinPartitions(*at.keys).write.parquet(f"{folder}/{part}")
    ranged = at.schema[first].dataType.simpleString() in _RANGED
    low, high = (F.min(first), F.max(first)) if ranged else (F.lit(None), F.lit(None))
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    told = spark.read.schema(at.schema).parquet(f"{folder}/{part}").groupBy(name.alias("f")).agg(low.alias("low"), high.alias("high"), F.count(F.lit(1)).alias("n")).collect()  # a row for each file
    return part, {f"{part}/{r['f']}": (r["low"], r["high"], r["n"]) for r in told}


def _held(spark: SparkSession, keys: DataFrame, at: Manifest, files: dict[str, tuple]) -> list[str]:
    """Files whose range holds one of the keys. Each task looks up its keys among the ranges, and names each file once."""
    names = sorted(files, key=lambda n: (files[n][0] is not None, files[n][0]))
    free = [n for n in names if files[n][0] is None]
    names = names[len(free) :]
    lows, highs = [files[n][0] for n in names], [files[n][1] for n in names]
    most = []  # the greatest key of this file and those before: ranges may overlap
    for h in highs:
        most.append(max(h, most[-1]) if most else h)

    def run(batches):
        seen = set()
        for batch in batches:
            for key in batch.column(0).to_pylist():
                for i in range(bisect.bisect_left(most, key), bisect.bisect_right(lows, key)):
                    if highs[i] >= key:
                        seen.add(i)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int64())], names=["i"])

    hit = keys.select(at.keys[0]).mapInArrow(run, "i long").distinct().collect() if names else []  # no more than there are files
    return free + [names[r["i"]] for r in hit]


def _touched(spark: SparkSession, folder: str, at: Manifest, keys: DataFrame) -> set[str]:
    """Files that hold one of the keys: those whose range does, and of them those whose keys do."""
    near = _held(spark, keys, at, at.files)
    rows = _of_files(spark, folder, at, near)
    if not near:
        return set()
    path = F.split(F.col("_metadata.file_path"), "/")
    found = rows.select(*at.keys, F.concat_ws("/", F.slice(path, -3, 3)).alias("__f")).join(keys, at.keys, "left_semi").select("__f").distinct().collect()
    return {r["__f"] for r in found}


def prepare_upsert(spark: SparkSession, folder: str, rows: DataFrame, *, file_rows: int = FILE_ROWS) -> Change:
    """Rows in place of those with their keys, others added; nothing is visible before ``commit``."""
    at = manifest(spark, folder)
    rows = stored(rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in at.schema)))
    _check_keys(rows, at)
    keys = rows.select(*at.keys)
    gone = _touched(spark, folder, at, keys)
    kept = _of_files(spark, folder, at, gone).join(keys, at.keys, "left_anti").select(*at.schema.names)
    part, come = _written(spark, folder, at, kept.unionByName(rows), file_rows)
    return Change(at, gone, come, keys, part)


def prepare_delete(spark: SparkSession, folder: str, keys: DataFrame, *, file_rows: int = FILE_ROWS) -> Change:
    """Rows with the given keys go; keys that the table lacks, and null ones, are ignored."""
    at = manifest(spark, folder)
    keys = stored(keys.select(*(F.col(k).cast(at.schema[k].dataType).alias(k) for k in at.keys)).dropna().distinct())
    gone = _touched(spark, folder, at, keys)
    kept = _of_files(spark, folder, at, gone).join(keys, at.keys, "left_anti").select(*at.schema.names)
    part, come = _written(spark, folder, at, kept, file_rows) if gone else ("", {})
    return Change(at, gone, come, keys, part)


def commit(spark: SparkSession, folder: str, change: Change, tries: int = 20) -> Manifest:
    """The change as the next version; over others that came first if they touched neither its files nor its keys."""
    now = change.base
    for _ in range(tries):
        if not change.gone and not change.come:
            return now
        files = {n: r for n, r in now.files.items() if n not in change.gone} | change.come
        new = Manifest(now.version + 1, now.schema, now.keys, files)
        if _commit(spark, folder, new):
            return new
        now = manifest(spark, folder)
        added = {n: r for n, r in now.files.items() if n not in change.base.files}
        if not change.gone <= set(now.files) or (change.keys is not None and _held(spark, change.keys, now, added)):
            if change.part:
                remove(spark, f"{folder}/{change.part}")
            raise Conflict(f"version {now.version} of {folder} changed the same files or keys")
    raise Conflict(f"{tries} other writers came first")


def upsert(spark: SparkSession, folder: str, rows: DataFrame, **how) -> Manifest:
    return commit(spark, folder, prepare_upsert(spark, folder, rows, **how))


def delete(spark: SparkSession, folder: str, keys: DataFrame, **how) -> Manifest:
    return commit(spark, folder, prepare_delete(spark, folder, keys, **how))


def vacuum(spark: SparkSession, folder: str, keep: int = 10) -> int:
    """Removes all but the newest ``keep`` manifests, and the files that none of those names; the number of such files.

    Not to be run while a change is prepared: its files are in no manifest yet.
    """
    versions = _names(spark, folder)
    held = {n for v in versions[-keep:] for n in manifest(spark, folder, v).files}
    remove(spark, *(f"{folder}/versions/{v:012d}.json" for v in versions[:-keep]))
    fs, where = _fs(spark, f"{folder}/data")
    lost = [f"data/{p.getPath().getName()}/{f.getPath().getName()}" for p in (fs.listStatus(where) if fs.exists(where) else []) for f in fs.listStatus(p.getPath()) if f.getPath().getName().endswith(".parquet")]
    lost = [n for n in lost if n not in held]
    remove(spark, *(f"{folder}/{n}" for n in lost))
    return len(lost)
