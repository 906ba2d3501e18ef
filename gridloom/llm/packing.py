"""Token ids packed into rows of fixed capacity: best-fit-decreasing with a segment tree over free space.

Documents longer than the capacity are split into pieces of at most that many tokens. Each task packs its
own pieces in groups of bounded size, so nothing is shuffled and a lost task is packed again alike; only
a group's last rows are left partly empty. Which pieces share a row depends on how the input is cut into
partitions; what is stored of each document does not.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridloom.llm.common import _arrow_type

#: A group is packed when it holds this many tokens or pieces.
GROUP_TOKENS, GROUP_PIECES = 4_000_000, 20_000
_CLOSE = re.compile(r" \s|\s ")


class Encoder:
    """Ids of a byte-level BPE given as ranks. Keeps the ids of up to CACHED words between calls."""

    CACHED = 200_000

    def __init__(self, path: str) -> None:
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.uint16 if max(ranks.values()) < 65_535 else np.uint32
        self.cache: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), self.dtype).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        if _CLOSE.search(text):  # a space beside white space belongs to a run, so words aren't independent there
            return np.frombuffer(self._ids(text), self.dtype)
        if len(self.cache) > self.CACHED:
            self.cache.clear()
        cache, head = self.cache, text.split(" ")
        chunks = [*head[:1], *[" " + w for w in head[1:]]]
        for c in chunks:
            if c not in cache:
                cache[c] = self._ids(c)
        return np.frombuffer(b"".join([cache[c] for c in chunks]), self.dtype)

    def decode(self, ids: np.ndarray) -> str:
        return self.bpe.decode_bytes(ids.tolist()).decode("utf-8", "surrogatepass")


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


class _FreeSpace:
    """Open bins by free space, with a segment tree that finds the least free space of at least n."""

    def __init__(self, capacity: int) -> None:
        self.leaf = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaf)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, free: int, by: int) -> None:
        at = self.leaf + free
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, bin_: int, free: int) -> None:
        if free:
            self.bins[free].append(bin_)
            self._change(free, 1)

    def take(self, n: int) -> tuple[int, int] | None:
        """(bin, free space) of the tightest bin that holds n."""
        count, at = self.count, self.leaf + n
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaf:
                at = 2 * at if count[2 * at] else 2 * at + 1
        free = at - self.leaf
        self._change(free, -1)
        return self.bins[free].pop(), free


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers. Equal sizes keep their order; every size is 1 to capacity."""
    space, bins = _FreeSpace(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = space.take(sizes[i])
        if found is None:
            bins.append([i])
            space.put(len(bins) - 1, capacity - sizes[i])
        else:
            bins[found[0]].append(i)
            space.put(found[0], found[1] - sizes[i])
    return bins


def pack(df: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", capacity: int = 2048, pad: int = 0) -> DataFrame:
    """One row for each packed sequence:

    `bin_id` long, `n_tokens` int (without padding), `n_segments` int, `cu_seqlens` array<int> (from 0 to
    n_tokens), `input_ids` and `position_ids` binary (little-endian rows of `capacity` ids, uint16 or, for
    larger vocabularies, uint32; positions uint32 and from 0 in each segment and in the padding), and
    `segments`, an array of struct(id, row, part, parts): the document's id, the number of its input row,
    and which of how many pieces this is. Pieces of one row in order give back its ids exactly.

    Null and empty texts have no ids and are in no row, so an empty table gives an empty table. Null ids
    are kept; repeated rows have row numbers of their own. Other columns aren't carried.
    """
    kind = df.schema[id_col].dataType
    out = T.StructType.fromDDL(
        "bin_id long, n_tokens int, n_segments int, cu_seqlens array<int>, input_ids binary, position_ids binary")
    seg = T.StructType([T.StructField("id", kind), *T.StructType.fromDDL("row long, part int, parts int").fields])
    out = out.add("segments", T.ArrayType(seg))
    seg_type = _arrow_type(seg)

    def rows(pieces: list, base: int) -> pa.RecordBatch:
        bins = best_fit_decreasing([len(p[0]) for p in pieces], capacity)
        cols: list[list] = [[] for _ in range(7)]
        for n, members in enumerate(bins):
            ids = np.full(capacity, pad, pieces[0][0].dtype)
            pos = np.zeros(capacity, np.uint32)
            ends = np.cumsum([0, *[len(pieces[i][0]) for i in members]])
            for i, a, b in zip(members, ends[:-1], ends[1:]):
                ids[a:b] = pieces[i][0]
                pos[a:b] = np.arange(b - a)
            pos[ends[-1] :] = np.arange(capacity - ends[-1])
            for c, v in zip(cols, (base + n, int(ends[-1]), len(members), ends.tolist(), ids.tobytes(), pos.tobytes(), [pieces[i][1] for i in members])):
                c.append(v)
        types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(seg_type)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        pieces, tokens, made, row = [], 0, 0, part << 40
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = enc.encode(text.as_py())
                parts = -(-len(ids) // capacity)
                for k in range(parts):
                    piece = ids[k * capacity : (k + 1) * capacity]
                    pieces.append((piece, {"id": key, "row": row, "part": k, "parts": parts}))
                    tokens += len(piece)
                    if tokens >= GROUP_TOKENS or len(pieces) >= GROUP_PIECES:
                        got = rows(pieces, (part << 40) + made)
                        made += got.num_rows
                        yield from (got.slice(i, 256) for i in range(0, got.num_rows, 256))
                        pieces, tokens = [], 0
                row += 1
        if pieces:
            got = rows(pieces, (part << 40) + made)
            yield from (got.slice(i, 256) for i in range(0, got.num_rows, 256))

    return df.select(id_col, text_col).mapInArrow(run, out)


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet at any place Spark can write; read them back with spark.read.parquet."""
    packed.write.parquet(path)


def unpack(packed: DataFrame, dtype: type = np.uint16) -> DataFrame:
    """One row for each piece: id, row, part, parts and its `ids`, from packed rows."""
    seg = packed.schema["segments"].dataType.elementType
    out = T.StructType([*seg.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for blob, cut, segs in zip(*[b.column(c).to_pylist() for c in ("input_ids", "cu_seqlens", "segments")]):
                ids = np.frombuffer(blob, dtype)
                got += [{**s, "ids": ids[x:y].tolist()} for s, x, y in zip(segs, cut[:-1], cut[1:])]
            if got:
                yield pa.RecordBatch.from_pylist(got, schema=pa.schema([(f.name, _arrow_type(f.dataType)) for f in out.fields]))

    return packed.mapInArrow(run, out)
