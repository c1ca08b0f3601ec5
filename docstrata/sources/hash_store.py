"""A history of content hashes in which a batch reads little however long the history is.

Hashes lie in buckets by their first bits. Each batch adds, for each bucket that it has new hashes of, a file of hashes and a Bloom
filter; ``compact`` makes one of each for a bucket again and cuts buckets in two until none has more than ``BUCKET_ROWS`` hashes. A batch
reads the filters of its own hashes' buckets, and the hashes of those buckets alone whose filters say that one of its hashes
may be there. All is tables of Spark in one folder, one sub-folder for each generation of buckets.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.sources.shared import remove, stored

BUCKET_ROWS = 20_000
BITS, PROBES = 12, 6  # bits of a filter for each hash, and how many of them a hash sets: one hash in 300 is thought to be there wrongly
_HASHES, _FILTERS = "file_hash string, batch long, bucket long", "places long, filter binary, batch long, bucket long"


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _generation(spark: SparkSession, folder: str) -> tuple[str, int]:
    """The sub-folder in use and the bits of its bucket numbers; both are in its name."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(where) if s.getPath().getName().startswith("gen-")) if fs.exists(where) else []
    if not names:
        return "gen-000000-00", 0
    return names[-1], int(names[-1].split("-")[2])


def _with_bucket(rows: DataFrame, bits: int) -> DataFrame:
    """The first ``bits`` bits of the hash (hexadecimal, 15 digits of which count) as a number."""
    head = F.conv(F.substring("file_hash", 1, 15), 16, 10).cast("long")
    return rows.withColumn("bucket", F.shiftright(head, 60 - bits) if bits else F.lit(0).cast("long"))


def _probes(hashes: list[str], places: int) -> np.ndarray:
    """The ``PROBES`` places of each hash, from its later digits: the first ones are alike in a bucket."""
    tail = np.array([[int(h[-16:-8], 16), int(h[-8:], 16) | 1] for h in hashes], np.uint64).reshape(len(hashes), 2)
    return ((tail[:, :1] + tail[:, 1:] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(places)).astype(np.int64)


def _filters(hashes: DataFrame, batch: int) -> DataFrame:
    """A filter for each bucket; rows come bucket by bucket, and one bucket is held at a time."""

    def run(batches):
        now, held = None, []

        def told():
            places = max(64, -(-BITS * len(held) // 64) * 64)
            bits = np.zeros(places, bool)
            bits[_probes(held, places).ravel()] = True
            return pa.RecordBatch.from_arrays(
                [pa.array([places]), pa.array([np.packbits(bits).tobytes()], pa.binary()), pa.array([batch]), pa.array([now])], names=["places", "filter", "batch", "bucket"]
            )

        for part in batches:
            for bucket, value in zip(part.column("bucket").to_pylist(), part.column("file_hash").to_pylist()):
                if bucket != now and held:
                    yield told()
                    held = []
                now = bucket
                held.append(value)
        if held:
            yield told()

    return hashes.select("bucket", "file_hash").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _FILTERS)


def add(spark: SparkSession, folder: str, hashes: DataFrame, batch: int) -> DataFrame:
    """The hashes (``file_hash``, hexadecimal SHA-256) of a batch that no other batch has; they are added under its number.

    Null hashes are left out, repeated ones count once. A batch that is run again replaces what it added and gives the same answer.
    """
    generation, bits = _generation(spark, folder)
    base = f"{folder}/{generation}"
    mine = stored(_with_bucket(hashes.select("file_hash").where("file_hash IS NOT NULL").distinct(), bits))
    new = mine
    if _there(spark, f"{base}/filters"):
        buckets = [r["bucket"] for r in mine.select("bucket").distinct().collect()]  # at most as many as the batch has hashes
        filters = spark.read.schema(_FILTERS).parquet(f"{base}/filters").where(F.col("bucket").isin(buckets) & (F.col("batch") != batch))

        def run(hashes: pa.Array, places: pa.Array, bits: pa.Array) -> pa.Array:
            found = []
            for h, n, f in zip(hashes.to_pylist(), places.to_pylist(), bits.to_pylist()):
                at = _probes([h], n)[0]
                block = np.frombuffer(f, np.uint8)
                found.append(bool(((block[at >> 3] >> (7 - (at & 7))) & 1).all()))
            return pa.array(found, pa.bool_())

        maybe = stored(mine.join(filters, "bucket").where(F.arrow_udf(run, "boolean")("file_hash", "places", "filter")).select("file_hash", "bucket").distinct())
        reached = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]
        known = spark.read.schema(_HASHES).parquet(f"{base}/hashes").where(F.col("bucket").isin(reached) & (F.col("batch") != batch))
        new = stored(mine.join(known.join(maybe.select("file_hash"), "file_hash", "left_semi").select("file_hash"), "file_hash", "left_anti"))
    else:
        new = stored(new)
    for name, rows in (("hashes", new.withColumn("batch", F.lit(batch).cast("long"))), ("filters", _filters(new, batch))):
        remove(spark, *_of_batch(spark, f"{base}/{name}", batch))
        rows.repartition("bucket").write.mode("append").partitionBy("batch", "bucket").parquet(f"{base}/{name}")
    return new.select("file_hash")


def _of_batch(spark: SparkSession, path: str, batch: int) -> list[str]:
    return [f"{path}/batch={batch}"] if _there(spark, f"{path}/batch={batch}") else []


def compact(spark: SparkSession, folder: str, *, bucket_rows: int = BUCKET_ROWS) -> int:
    """One file and one filter for each bucket, and as many buckets as keep them below ``bucket_rows`` on average; how many there are.

    The new generation gets its name once it is whole, and counts from then on; the one before is removed by the next call.
    Batches so far become one, number -1, so a batch from before is not to be run again after it.
    """
    generation, bits = _generation(spark, folder)
    base = f"{folder}/{generation}"
    if not _there(spark, f"{base}/hashes"):
        return 1
    rows = spark.read.schema(_HASHES).parquet(f"{base}/hashes").select("file_hash").distinct()
    total = rows.count()
    while total >> bits > bucket_rows:
        bits += 1
    placed = stored(_with_bucket(rows, bits))
    hidden = f"{folder}/new-{uuid.uuid4().hex}"
    placed.withColumn("batch", F.lit(-1).cast("long")).repartition("bucket").write.partitionBy("batch", "bucket").parquet(f"{hidden}/hashes")
    _filters(placed, -1).repartition("bucket").write.partitionBy("batch", "bucket").parquet(f"{hidden}/filters")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    number = int(generation.split("-")[1])
    fs.rename(path(hidden), path(f"{folder}/gen-{number + 1:06d}-{bits:02d}"))
    older = [s.getPath().toString() for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("gen-") and int(s.getPath().getName().split("-")[1]) < number]
    remove(spark, *older)
    return 1 << bits
