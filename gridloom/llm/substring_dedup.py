"""Exact substring deduplication by level-wise doubling.

A window of `window` words (35) repeats if its word sequence also starts anywhere else. Candidates are
found on short windows first and only those repeated at one length are looked at at twice that length:

* level 9 (a quarter of 35, rounded up): one 9-word window for each 35-word window, its leftmost
  minimum of 9-word hashes. Equal 35-word windows choose equal 9-word windows at equal offsets, so a
  35-word window whose choice occurs nowhere else can't repeat, and about one position in 14 is looked up;
* level 18: the 18-word windows that start or end with a surviving 9-word window's first word;
* level 35: the 35-word windows all of whose looked-up 18-word windows survive.

A level is one question, "which of these hashes occur twice in the corpus?". Documents are stored once
in batches of bounded size; a batch asks with its own distinct hashes, packed as binary and dealt by hash
range, so a passage in a third of all documents costs one 8-byte entry for each batch, not a row for
each document. Answers go back by batch. Batches are stored bucketed by their id, so that texts are not
shuffled again from level to level. Hashes have 64 bits, at the last level 128: two of them, made from two
independent hashes of the words, so that two different windows both of whose parts repeat aren't taken for one.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import SCRATCH, U64, drop_scratch, gram_hashes, hashed_words, partitions, stored, without, word_hashes

#: A batch is closed beyond this many bytes (between the two, by the input's size) or documents; one document may exceed it alone.
BATCH_BYTES, BATCH_DOCS = (1_000_000, 16_000_000), 16_384
#: Bytes of text in a bucket of the stored table, at about which their number starts to grow with the input.
BUCKET_BYTES = 128_000_000
#: Distinct hashes that one task compares at a level.
PART_HASHES = 4_000_000
BATCH, TEXT = "__batch", "__text"


def levels(window: int) -> list[int]:
    """Window lengths from about a quarter of the full one to it, each at most twice the one before."""
    sizes = [window]
    while sizes[0] > 12:
        sizes.insert(0, -(-sizes[0] // 2))
    return sizes


#: Bytes of text whose windows are worked out together; a longer text alone.
BLOCK_BYTES = 256_000


class _Block:
    """Windows of some documents, end to end, by level. No window looked at reaches from one document into the next."""

    def __init__(self, texts: list[str | None], window: int) -> None:
        parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.parts, self.raw = parts, b"\n".join(parts)
        self.window, self.sizes = window, levels(window)
        self.h, at = hashed_words(self.raw)
        self.ends = np.searchsorted(at, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1))  # words up to each document's end
        count = np.diff(self.ends, prepend=0)
        self.begin, self.end = np.repeat(self.ends - count, count), np.repeat(self.ends, count)  # of each word's document
        self.starts = np.flatnonzero(np.arange(len(self.h)) + window <= self.end)

    @functools.cached_property
    def anchor(self) -> np.ndarray:
        """For each full window the place of its leftmost least short window."""
        base = self.sizes[0]
        view = np.lib.stride_tricks.sliding_window_view(gram_hashes(self.h, base), self.window - base + 1)
        return view.argmin(1)[self.starts] + self.starts

    def asked(self, level: int, alive: np.ndarray | None) -> np.ndarray:
        """Hashes, by row, to look up at a level, given the surviving hashes of the one before."""
        last = level == len(self.sizes) - 1
        if not len(self.starts):
            return np.zeros((0, 1 + last), U64)
        at = self._looked_up(level, alive)
        return self.full(at) if last else gram_hashes(self.h, self.sizes[level])[at][:, None]

    def full(self, at: np.ndarray) -> np.ndarray:
        """128 bits of the full windows at some places."""
        if not len(at):
            return np.zeros((0, 2), U64)
        return np.stack([gram_hashes(self.h, self.window)[at], gram_hashes(word_hashes(self.raw, 1), self.window)[at]], 1)

    def _looked_up(self, level: int, alive: np.ndarray | None) -> np.ndarray:
        size = self.sizes[level]
        if level == 0:
            return self.starts if len(self.sizes) == 1 else np.unique(self.anchor)
        small = self.sizes[level - 1]
        ok = _among(gram_hashes(self.h, small)[:, None], alive)
        if not ok.any():
            return np.zeros(0, np.int64)
        if level < len(self.sizes) - 1:
            # Both extensions of a surviving shorter window, inside the document.
            live = self._inner(level - 1, ok)
            at, of = np.concatenate([live, live - (size - small)]), np.concatenate([live, live])
            return np.unique(at[(at >= self.begin[of]) & (at + size <= self.end[of])])
        p = self.starts
        # Every shorter window looked up inside a full window must have survived.
        if level == 1:
            return p[ok[self.anchor]]
        keep = np.ones(len(p), bool)
        for q in self._own(level - 1):
            fits = (q >= p) & (q + small <= p + self.window)
            keep &= ~fits | ok[np.clip(q, 0, len(ok) - 1)]
        return p[keep]

    def _own(self, level: int) -> list[np.ndarray]:
        """For each full window, the starts of the windows that its anchor gives rise to at a level."""
        out = [self.anchor]
        for i in range(1, level + 1):
            step = self.sizes[i] - self.sizes[i - 1]
            out = [x for q in out for x in (q, q - step)]
        return out

    def _inner(self, level: int, ok: np.ndarray) -> np.ndarray:
        lo, hi = self.begin[self.starts], self.end[self.starts] - self.sizes[level]
        at = np.unique(np.concatenate([q[(q >= lo) & (q <= hi)] for q in self._own(level)]))
        return at[ok[at]]

    def covered(self, alive: np.ndarray) -> list[np.ndarray]:
        """Which words of each document lie in a repeated window."""
        out = np.zeros(len(self.h), bool)
        if len(self.starts) and len(alive):
            at = self.starts[_among(gram_hashes(self.h, self.window)[self.starts][:, None], alive[:, :1])]
            at = at[_among(self.full(at), alive)]
            if len(at):
                n = len(self.h) + 1
                out = np.cumsum(np.bincount(at, minlength=n)[:-1] - np.bincount(at + self.window, minlength=n)[:-1]) > 0
        return np.split(out, self.ends[:-1])


def _blocks(texts: list[str | None], window: int) -> Iterator[_Block]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t or "") > BLOCK_BYTES:
            yield _Block(held, window)
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield _Block(held, window)


def _order(h: np.ndarray) -> np.ndarray:
    return np.argsort(h[:, 0], kind="stable") if h.shape[1] == 1 else np.lexsort((h[:, 1], h[:, 0]))


def _among(h: np.ndarray, alive: np.ndarray | None) -> np.ndarray:
    """Which rows of h are among the rows of alive, which are sorted."""
    out = np.zeros(len(h), bool)
    if alive is None or not len(alive) or not len(h):
        return out
    at = np.searchsorted(alive[:, 0], h[:, 0])
    left = np.arange(len(h))
    while len(left):  # rows of equal first column are looked at one after the other
        left = left[at[left] < len(alive)]
        left = left[alive[at[left], 0] == h[left, 0]]
        hit = (alive[at[left]] == h[left]).all(1)
        out[left[hit]] = True
        left = left[~hit]
        at[left] += 1
    return out


def _alive(answers: pa.Table, width: int) -> np.ndarray:
    blobs = [b for b in answers.column("hashes").to_pylist() if b]
    h = np.frombuffer(b"".join(blobs), U64).reshape(-1, width)
    return h[_order(h)]


def _batches(df: DataFrame, most: int) -> DataFrame:
    """df plus a batch id: runs of rows of a partition, closed by size (bytes of text) or number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, at, held, docs = TaskContext.get().partitionId() << 32, 0, 0, 0
        for b in batches:
            ids = np.empty(b.num_rows, np.int64)
            sizes = pc.binary_length(b.column(b.schema.get_field_index(TEXT))).fill_null(0).to_pylist()
            for i, size in enumerate(sizes):
                if docs and (held + size > most or docs >= BATCH_DOCS):
                    at, held, docs = at + 1, 0, 0
                ids[i] = base + at
                held, docs = held + size, docs + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids)], names=[*b.schema.names, BATCH])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(BATCH, T.LongType())]))


def _store(df: DataFrame, buckets: int) -> DataFrame:
    """df as a table of the warehouse, bucketed by batch: grouping and joining by batch then moves no text."""
    spark = df.sparkSession
    name = f"gridloom_batches_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, BATCH).sortBy(BATCH).format("parquet").saveAsTable(name)
    SCRATCH.append((spark, "table", name))
    return spark.table(name)


def _repeated(asked: DataFrame, n_parts: int, width: int) -> DataFrame:
    """(batch, hashes): of each batch's hashes those that occur twice in the corpus."""

    def check(t: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(x, U64).reshape(-1, width) for x in t.column("hashes").to_pylist()]
        twice = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(b)] for x, b in zip(t.column("twice").to_pylist(), blocks)]
        h, rep = np.concatenate(blocks), np.concatenate(twice).astype(bool)
        order = _order(h)
        s = h[order]
        same = (s[1:] == s[:-1]).all(1)
        many = np.r_[same, False]
        many[1:] |= same
        rep[order] |= many
        ends = np.cumsum([len(b) for b in blocks])
        found = [b[r] for b, r in zip(blocks, np.split(rep, ends[:-1]))]
        kept = [(i, f.tobytes()) for i, f in zip(t.column(BATCH).to_pylist(), found) if len(f)]
        return pa.table({BATCH: pa.array([i for i, _ in kept], pa.int64()), "hashes": pa.array([f for _, f in kept], pa.binary())})

    return asked.repartition(n_parts, "part").groupBy("part").applyInArrow(check, f"{BATCH} long, hashes binary")


def _pack(hashes: list[np.ndarray], batch: int, n_parts: int, width: int) -> pa.Table:
    """A batch's distinct hashes, by part, with a bit for those it holds more than once."""
    h = np.concatenate(hashes) if hashes else np.zeros((0, width), U64)
    h = h[_order(h)]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]).any(1)]) if len(h) else np.zeros(0, np.int64)
    n = np.diff(np.r_[new, len(h)])
    h = h[new]
    part = ((h[:, 0] >> U64(32)) % U64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    h, n, part = h[order], n[order], part[order]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(h) else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], len(h)] if len(h) else cuts
    return pa.table({
        "part": pa.array(part[cuts], pa.int64()),
        BATCH: pa.array([batch] * len(cuts), pa.int64()),
        "hashes": pa.array([h[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
        "twice": pa.array([np.packbits(n[a:b] > 1).tobytes() for a, b in zip(cuts, ends)], pa.binary()),
    })


def _asking(window: int, n_parts: int):
    def ask(t: pa.Table) -> pa.Table:
        got = [b.asked(0, None) for b in _blocks(t.column(TEXT).to_pylist(), window)]
        return _pack(got, t.column(BATCH)[0].as_py(), n_parts, _width(levels(window), 0))

    return ask


def _width(sizes: list[int], level: int) -> int:
    return 2 if level == len(sizes) - 1 else 1


def _asking_on(window: int, n_parts: int, level: int):
    sizes = levels(window)

    def ask(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows or not answers.num_rows:
            return _pack([], 0, n_parts, _width(sizes, level))
        alive = _alive(answers, _width(sizes, level - 1))
        got = [b.asked(level, alive) for b in _blocks(t.column(TEXT).to_pylist(), window)]
        return _pack(got, t.column(BATCH)[0].as_py(), n_parts, _width(sizes, level))

    return ask


ASKED = f"part long, {BATCH} long, hashes binary, twice binary"
OUT = ["n_words", "n_removed", "kept_text"]


def remove_repeats(df: DataFrame, text_col: str = "text", window: int = 35) -> DataFrame:
    """df plus `n_words`, `n_removed` (long) and `kept_text`: the words in no repeated window, joined by one space.

    Words are runs of characters other than space and \\x09-\\x0D. A text of fewer words than the window
    keeps them all; a null text has none and keeps an empty text. Very long texts are read whole, each in one task
    with the batch it is in. Windows are judged on the input. Repeated
    rows count as separate texts, so all windows of a row that comes twice repeat. Other columns stay;
    those named like the new ones are replaced. An empty table gives an empty table.

    Eager: stores df once, as a table of the warehouse, and runs the levels; the last pass is lazy and
    reads that table.
    """
    spark = df.sparkSession
    kept = without(df.withColumn(TEXT, F.col(f"`{text_col}`")) if text_col.lower() in OUT else df.withColumnRenamed(text_col, TEXT), OUT)
    size = kept.agg(F.sum(F.octet_length(TEXT).cast("long"))).first()[0] or 0
    buckets = max(partitions(spark), -(-size // BUCKET_BYTES))
    store = _store(_batches(kept, min(max(size // (2 * buckets), BATCH_BYTES[0]), BATCH_BYTES[1])), buckets)
    n_parts = max(partitions(spark), -(-size // 5 // PART_HASHES))
    sizes = levels(window)
    texts = store.select(BATCH, TEXT)
    answers, width = None, 1
    for level, length in enumerate(sizes):
        if answers is None:
            asked = texts.groupBy(BATCH).applyInArrow(_asking(window, n_parts), ASKED)
        else:
            asked = texts.groupBy(BATCH).cogroup(answers.groupBy(BATCH)).applyInArrow(_asking_on(window, n_parts, level), ASKED)
        width, before = _width(sizes, level), answers
        answers = stored(_repeated(asked, n_parts, width), f"repeats_{length}")
        if before is not None:
            drop_scratch(tables=[before])
        if answers.isEmpty():
            break
    names = [c for c in store.columns if c != BATCH and not (c == TEXT and text_col.lower() in OUT)]
    shown = [text_col if c == TEXT else c for c in names]
    out = T.StructType([*[T.StructField(s, store.schema[c].dataType) for s, c in zip(shown, names)], *T.StructType.fromDDL("n_words long, n_removed long, kept_text string").fields])

    def last(t: pa.Table, a: pa.Table) -> pa.Table:
        alive = _alive(a, width)
        n, gone, text = [], [], []
        for block in _blocks(t.column(TEXT).to_pylist(), window):
            for raw, hit in zip(block.parts, block.covered(alive)):
                n.append(len(hit))
                gone.append(int(hit.sum()))
                ws = raw.split()
                text.append(b" ".join([w for w, c in zip(ws, hit.tolist()) if not c] if gone[-1] else ws).decode("utf-8", "surrogatepass"))
        got = t.select(names)
        return pa.Table.from_arrays(
            [*got.columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.string())],
            names=[*shown, *OUT])

    return store.groupBy(BATCH).cogroup(answers.groupBy(BATCH)).applyInArrow(last, out)
