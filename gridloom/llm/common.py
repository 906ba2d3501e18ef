"""Helpers shared by the text operators: words, hashes, Arrow passes and scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
_M1, _M2, _M3 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8 (``bytes.split`` cuts at exactly those six)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(raw: bytes, kind: int = 0) -> np.ndarray:
    """hashed_words without the places."""
    return hashed_words(raw, kind)[0]


def hashed_words(raw: bytes, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of a text in UTF-8, cut like `words`, by arrays over its bytes; and where the words begin.

    A word's hash is the sum of its bytes plus one, each times a fixed odd number for its place; words of over PLACES bytes
    are hashed by themselves. Hashes of different kinds are independent.
    """
    b = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(_INK[b])
    if not len(at):
        return np.zeros(0, U64), at
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
    size = np.diff(np.r_[first, len(at)])
    place = np.arange(len(at)) - np.repeat(first, size)
    long = size.max() > PLACES
    ink = b[at].astype(U64)
    ink += U64(1)
    ink *= _PLACE[kind][np.minimum(place, PLACES - 1) if long else place]
    h = mix(np.add.reduceat(ink, first) * _M1)
    if long:
        for i in np.flatnonzero(size > PLACES):
            h[i] = xxhash.xxh3_64_intdigest(raw[at[first[i]] : at[first[i]] + size[i]], kind)
    return h, at[first]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * _M2
    return x ^ (x >> U64(29))


#: Places within a word that have a number of their own.
PLACES = 512
_PLACE = [mix(mix(np.arange(1 + k * PLACES, 1 + (k + 1) * PLACES, dtype=U64) * _M1) * _M3) | U64(1) for k in range(2)]
_INK = np.ones(256, bool)
_INK[[9, 10, 11, 12, 13, 32]] = False


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two windows side by side (or overlapping by a fixed number of words)."""
    return mix(left * _M1 + (right ^ _M3))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows, built by doubling: 1, 2, 4, ... words, then one overlapping step to n."""
    if len(h) < n:
        return h[:0]
    size, cur = 1, h
    while 2 * size <= n:
        cur = join_hashes(cur[:-size], cur[size:])
        size *= 2
    if size < n:
        cur = join_hashes(cur[: -(n - size)], cur[n - size :])
    return cur


def text_key(col: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text, as two longs, computed on the JVM."""
    return F.xxhash64(col), F.xxhash64(F.lit(7), col)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns whose name (any case) an operator is about to add."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def _slices(b: pa.RecordBatch, at: list[int], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """b in slices of at most `rows` rows and `size` bytes of text in the columns `at`; a row that is larger goes alone."""
    total = np.zeros(b.num_rows, np.int64)
    for c in (b.column(i) for i in at):
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            total += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    start = 0
    while start < b.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(total[start : start + rows]), size, side="right")))
        yield b.slice(start, n)
        start += n


def add_columns(df: DataFrame, fields: str, fn: Callable[[list], list], inputs: list[str], rows: int = 512, size: int = 8 << 20) -> DataFrame:
    """df plus columns that fn computes from the input columns' values, at most `rows` rows and `size` bytes of text at a time.

    fn gets a list of Python values for each input column and returns one array or list for each new
    column. Input columns with a new column's name are replaced.
    """
    new = T.StructType.fromDDL(fields)
    types = [_arrow_type(f.dataType) for f in new.fields]
    kept = without(df, [f.name for f in new.fields])
    extra = [c for c in inputs if c not in kept.columns]
    src = df.select(*[F.col(f"`{c}`") for c in kept.columns], *[F.col(f"`{c}`").alias(f"__in_{c}") for c in extra])
    out = T.StructType([*kept.schema.fields, *new.fields])
    names, n_kept = [f.name for f in out.fields], len(kept.columns)
    at = [src.columns.index(c if c not in extra else f"__in_{c}") for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, at, rows, size):
                got = fn(*[b.column(i).to_pylist() for i in at])
                cols = [pa.array(g, t) if not isinstance(g, pa.Array) else g for g, t in zip(got, types)]
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n_kept)], *cols], names=names)

    return src.mapInArrow(run, out)


def _arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal key from batches that are sorted by it; holds one group and one batch at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[lo] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as spark.checkpoint.dir names it; on one machine, unset, a temporary one is set."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = at or tempfile.mkdtemp(prefix="gridloom_checkpoints_")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


#: What this process has put down for later steps: paths, and tables of the warehouse (session, name).
SCRATCH: list[tuple[SparkSession, str, str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, fixes row ids, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/gridloom_{name}_{uuid.uuid4().hex}"
    df.write.parquet(path)
    SCRATCH.append((df.sparkSession, "path", path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop_scratch(tables: list[DataFrame] | None = None, since: int = 0, but: tuple[DataFrame, ...] = ()) -> None:
    """Deletes scratch that nothing reads any more: the given tables made by `stored`, else all from a place in SCRATCH on but some."""
    only = None if tables is None else {getattr(t, "scratch_path", None) for t in tables}
    held = {getattr(t, "scratch_path", None) for t in but}
    for i in reversed(range(since, len(SCRATCH))):
        spark, kind, name = SCRATCH[i]
        if name in held or (only is not None and name not in only):
            continue
        del SCRATCH[i]
        if kind == "table":
            spark.sql(f"drop table if exists `{name}`")
        else:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
