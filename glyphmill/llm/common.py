"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

SLICE_BYTES = 1 << 19
BATCH_BYTES = 8 << 20
HOT = 10_000  # rows of one key that a task of a shuffle join may hold
HOT_KEYS = 100_000  # of at most 24 bytes each, for a broadcast


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent on one machine (as in tests) a temporary folder is made and set; a
    cluster without it is refused, since a folder that one machine has would lose data.
    """
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        where = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


_scopes: list[list[str]] = []  # of each settled() that runs, the tables it has stored


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage.

    A lost executor then costs the tasks it ran, never the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glyphmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` that no later step reads."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that ``make`` gives, stored; what was stored on the way is deleted, since nothing reads it
    any more. If ``make`` fails its tables stay, for a look at them."""
    _scopes.append([])
    try:
        out = stored(make(), name)
        made = _scopes[-1]
    finally:
        _scopes.pop()
    for folder in made[:-1]:
        delete(out.sparkSession, folder)
    return out


def fresh(columns: list[str], base: str) -> str:
    """A column name that none of ``columns`` has, whatever its case."""
    taken, name = {c.lower() for c in columns}, f"_{base}"
    while name.lower() in taken:
        name = "_" + name
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches that hold whole texts, so that a Python worker stays small.

    The limits are settings of the session, read when a query runs, which may be after its operator has
    returned; so they stay.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def attached(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` joined with ``groups``, a stored table of one row a key with the ``size`` of each group.

    Keys of more than ``HOT`` rows would each fill a task of a shuffle join. They are at most one in
    ``HOT`` of the rows; while they number at most ``HOT_KEYS`` they are broadcast, so their rows stay
    where they are. Beyond that the join is left to the skew splits of adaptive execution.
    """
    hot = groups.where(F.col(size) > HOT)
    number = hot.select(key).limit(HOT_KEYS + 1).count()
    if number == 0 or number > HOT_KEYS:
        return rows.join(groups, key)
    usual = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(size) <= HOT), key)
    return rows.join(F.broadcast(hot), key).unionByName(usual)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``most`` bytes; a longer text is a run."""
    data, at = flat(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG = 64


def token_hashes(data: np.ndarray, at: np.ndarray, gap: np.ndarray = SPACE, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens in a run of texts.

    A token is a maximal run of bytes that are not ``gap``, after mapping bytes by ``fold``
    (ASCII lower case unless told otherwise). Returns the hashes, the tokens' first bytes, and
    for each row the index of its first token, with the total at the end.
    """
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    fold.take(data, out=padded[:n])
    data = padded[:n]
    inside = (~gap).take(data)
    edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
    mark = inside.copy()
    mark[1:] &= ~inside[:-1]
    mark[edge] = inside[edge]
    starts = np.flatnonzero(mark)
    mark = inside.copy()
    mark[:-1] &= ~inside[1:]
    mark[edge - 1] = inside[edge - 1]
    length = np.flatnonzero(mark) + 1 - starts
    bounds = np.searchsorted(starts, at)
    # tokens are read eight bytes at a time, all of them at once
    words = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    h = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    live = np.flatnonzero(length <= _LONG)
    at_, rest = starts[live], length[live]
    while len(live):
        x = (h[live] ^ (words[at_] & _MASK[np.minimum(rest, 8)])) * np.uint64(0xD6E8FEB86659FD93)
        h[live] = x ^ (x >> np.uint64(29))
        more = rest > 8
        live, at_, rest = live[more], at_[more] + 8, rest[more] - 8
    for i in np.flatnonzero(length > _LONG).tolist():
        h[i] = xxh64_intdigest(data[starts[i] : starts[i] + length[i]].tobytes())
    return mix(h), starts, bounds
