"""Near-duplicate join on word shingles: MinHash candidates, Bayesian pruning, exact verification.

1. Every text becomes a set of five-word shingles. Texts with equal sets are one class from here on, so
   exact copies cost nothing more, however many there are. A class has ROWS * BANDS MinHash values.
2. Classes that agree on all values of a band share a bucket. Of buckets with the same members one is
   kept. A pair at similarity 0.8 shares no bucket with probability (1 - 0.8**5)**32 = 3e-6.
3. In a bucket, pairs are compared on 32 MinHash values at a time. After m of n agree, similarity has a
   Beta(m + 1, n - m + 1) posterior (uniform prior); the pair is dropped once its probability of reaching
   the threshold is below TOLERANCE. What is left joins the bucket's members to groups, by forests.
4. Groups are put together to candidate components. In a component, pairs that pass step 3 are verified
   on whole shingle sets. Links are counted where they are found and never stored as pairs.

Large buckets and components are cut into blocks, and each pair of blocks is a task of its own, so no
group is gathered in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import (
    SCRATCH, U64, add_columns, drop_scratch, gram_hashes, mix, partitions, sorted_groups, stored, text_key, word_hashes,
)
from gridloom.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
ROWS, BANDS = 5, 32
VALUES = ROWS * BANDS
CHECK = 32
TOLERANCE = 1e-7
#: Classes in a block: of signatures (320 bytes each), and of whole texts.
BUCKET_BLOCK, TEXT_BLOCK = 256, 256
#: Sets held by more rows than this share of the table, and than this many, come back to their rows by a broadcast: there are 4096 at most.
HOT_SHARE, HOT_ROWS = 1 / 4096, 1024

_FACTORS = mix(np.arange(1, VALUES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles; a text of 1 to n - 1 words is one shingle."""
    h = word_hashes(text.encode("utf-8", "surrogatepass") if text else b"")
    return np.unique(gram_hashes(h, min(n, len(h))) if len(h) else h)


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty shingle set."""
    low = np.full(VALUES, ~U64(0))
    for i in range(0, len(s), 256):
        np.minimum(low, (s[i : i + 256, None] * _FACTORS).min(0), out=low)
    return low


def bands(sig: np.ndarray) -> list[int]:
    """A bucket id for each band."""
    x = np.arange(1, BANDS + 1, dtype=U64)
    for k in range(ROWS):
        x = mix(x * U64(0xD6E8FEB86659FD93) + sig.reshape(BANDS, ROWS)[:, k])
    return x.view(np.int64).tolist()


@cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """By checkpoint, the fewest matches with P(similarity >= threshold) >= tolerance.

    With m of n matches that probability is P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in range(CHECK, VALUES + 1, CHECK):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def likely_pairs(a: np.ndarray, b: np.ndarray | None, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose MinHash values (uint16, one row for each class) survive all checkpoints.

    Within a (first < second) if b is None. Pairs are held as one byte each for the first checkpoint.
    """
    other = a if b is None else b
    need = least_matches(threshold, tolerance)
    same = np.zeros((len(a), len(other)), np.uint8)
    for k in range(CHECK):
        same += a[:, k, None] == other[None, :, k]
    ok = same >= need[0]
    if b is None:
        ok = np.triu(ok, 1)
    i, j = np.nonzero(ok)
    got = same[i, j].astype(np.int64)
    for c, least in enumerate(need[1:], 1):
        for at in range(0, len(i), 200_000):
            s = slice(at, at + 200_000)
            got[s] += (a[i[s], c * CHECK : (c + 1) * CHECK] == other[j[s], c * CHECK : (c + 1) * CHECK]).sum(1)
        keep = got >= least
        i, j, got = i[keep], j[keep], got[keep]
    return i, j


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index of each of n nodes' component under links (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return root


def _sigs(col: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, VALUES)


def _compare_buckets(threshold: float, tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for t in sorted_groups(batches, ["bucket", "x", "y"]):
            if t.num_rows < 2:
                continue
            ids = t.column("rid").to_numpy()
            order = np.argsort(ids)
            ids, sig = ids[order], _sigs(t.column("sig"))[order]
            x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
            if x == y:
                i, j = likely_pairs(sig, None, threshold, tolerance)
            else:
                side = t.column("block").to_numpy()[order]
                p, q = np.flatnonzero(side == x), np.flatnonzero(side == y)
                i, j = likely_pairs(sig[p], sig[q], threshold, tolerance)
                i, j = p[i], q[j]
            r = roots(len(ids), i, j)
            linked = np.flatnonzero(r != np.arange(len(ids)))
            a.extend(ids[linked].tolist())
            b.extend(ids[r[linked]].tolist())
            if len(a) > 20_000:
                yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=_LINKS)
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=_LINKS)

    return run


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_FOUND = pa.schema([("rid", pa.int64()), ("root", pa.int64()), ("links", pa.int64()), ("alone", pa.bool_())])


def _overlap(s: np.ndarray, t: np.ndarray) -> int:
    if len(s) > len(t):
        s, t = t, s
    return int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())


def _verify(threshold: float, tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["component", "x", "y"]):
            order = np.argsort(t.column("rid").to_numpy())
            ids = t.column("rid").to_numpy()[order]
            first = np.r_[True, ids[1:] != ids[:-1]]  # one row of a class is enough
            order, ids = order[first], ids[first]
            sig, copies = _sigs(t.column("sig"))[order], t.column("copies").to_numpy()[order]
            texts, side = t.column("text"), t.column("block").to_numpy()[order]
            x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
            sets = [shingles(texts[int(k)].as_py()) for k in order]
            if x == y:
                i, j = likely_pairs(sig, None, threshold, tolerance)
            else:
                p, q = np.flatnonzero(side == x), np.flatnonzero(side == y)
                i, j = likely_pairs(sig[p], sig[q], threshold, tolerance)
                i, j = p[i], q[j]
            size = np.array([len(s) for s in sets])
            fits = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
            i, j = i[fits], j[fits]
            both = np.array([_overlap(sets[p], sets[q]) for p, q in zip(i, j)], np.int64)
            true = both / np.maximum(size[i] + size[j] - both, 1) >= threshold
            i, j = i[true], j[true]
            links = np.zeros(len(ids), np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            r = roots(len(ids), i, j)
            alone = t.column("blocks")[0].as_py() == 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(ids[r]), pa.array(links), pa.array([alone] * len(ids))], schema=_FOUND)

    return run


def _blocks(df: DataFrame, key: str, size: int) -> DataFrame:
    """df (key, rid, n members) once for each pair of blocks (x <= y) that its row's block is in."""
    cut = df.withColumn("blocks", F.ceil(F.col("n") / size).cast("int")).withColumn(
        "block", F.expr("cast(pmod(xxhash64(rid, 11), blocks) as int)"))
    return cut.withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        key, "rid", "blocks", "block", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"))


def classes(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): the join's result by shingle set.

    rows: one row for each row of df: `id`, its text's key (k1, k2), row number and `set`, a 16-byte key of
    the shingle set, null without words. sets: `set`, `class_id` (least id in the class), `n_links` (rows
    similar to a row of the set, without itself), `copies` (rows of the set), `first_row` (row number of the class's first row by id).
    """
    mark = len(SCRATCH)
    k1, k2 = text_key(F.col("text"))
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumns({"k1": k1, "k2": k2})

    def sign(texts: list[str | None]) -> list:
        keys, sigs, bands_ = [], [], []
        for t in texts:
            s = shingles(t)
            if not len(s):
                keys.append(None), sigs.append(None), bands_.append(None)
                continue
            both = np.stack([mix(s), mix(s * U64(0xA0761D6478BD642F) + U64(1))])
            keys.append(both.sum(1).tobytes())
            low = signature(s)
            sigs.append((low >> U64(48)).astype(np.uint16).tobytes())
            bands_.append(bands(low))
        return [keys, sigs, bands_]

    signed = add_columns(src, "set binary, sig binary, bands array<long>", sign, ["text"], rows=256).drop("text")
    signed = stored(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    rows = signed.select("id", "k1", "k2", "row", "set")
    grouped = signed.where("set is not null").groupBy("set").agg(
        F.min(F.struct("id", "k1", "k2")).alias("rep"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least"),
        F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    reps = stored(grouped.select(
        F.monotonically_increasing_id().alias("rid"), "set", "rep.id", "rep.k1", "rep.k2", "least", "copies", "sig", "bands"), "sets")

    members = reps.select("rid", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(
        F.count("*").alias("n"), F.expr("bit_xor(xxhash64(rid))").alias("h1"), F.expr("bit_xor(xxhash64(rid, 5))").alias("h2")).where("n > 1")
    kept = stored(shared.groupBy("n", "h1", "h2").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "buckets")
    n = partitions(df.sparkSession)
    tasks = _blocks(members.join(kept, "bucket"), "bucket", BUCKET_BLOCK).join(reps.select("rid", "sig"), "rid")
    pairs = tasks.repartition(n, "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").select("bucket", "x", "y", "block", "rid", "sig")
    candidates = components(pairs.mapInArrow(_compare_buckets(threshold, tolerance), "a long, b long"))

    inside = stored(candidates.select(F.col("node").alias("rid"), F.col("root").alias("component")), "candidates")
    sizes = inside.groupBy("component").agg(F.count("*").alias("n"))
    spread = _blocks(inside.join(sizes, "component"), "component", TEXT_BLOCK)
    needed = inside.join(reps.select("rid", "id", "k1", "k2", "copies", "sig"), "rid").drop("component")
    texts = src.withColumnRenamed("id", "i").withColumnRenamed("k1", "t1").withColumnRenamed("k2", "t2").join(
        needed, F.expr("i <=> id and t1 = k1 and t2 = k2")).select("rid", "text", "copies", "sig")
    work = spread.join(texts, "rid").repartition(n, "component", "x", "y").sortWithinPartitions("component", "x", "y")
    found = stored(
        work.select("component", "x", "y", "blocks", "block", "rid", "copies", "sig", "text").mapInArrow(
            _verify(threshold, tolerance), "rid long, root long, links long, alone boolean"), "verified")

    several = components(found.where("not alone").select(F.col("rid").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("rid").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    by_rid = counted.join(several.select(F.col("node").alias("rid"), F.col("root").alias("far")), "rid", "left").select(
        "rid", "links", F.coalesce("far", "root").alias("class"))
    joined = reps.select("rid", "set", "least", "copies").join(by_rid, "rid", "left").select(
        "set", "least", "copies", F.coalesce("class", "rid").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = stored(joined, "joined")
    first = joined.groupBy("class").agg(F.min("least").alias("first"))
    sets = joined.join(first, "class").select("set", "copies", F.col("first.id").alias("class_id"), "n_links", F.col("first.row").alias("first_row"))
    sets = stored(sets, "classes")
    drop_scratch(since=mark, but=(signed, sets))
    return rows, sets


def _with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows with `class_id`, `n_links` and `first_row` of their set; rows without words have nulls.

    Rows without a set aren't joined, and sets with very many rows are broadcast, so no key gathers more rows in
    one task than HOT_ROWS or HOT_SHARE of the table.
    """
    most = max(HOT_ROWS, int(HOT_SHARE * rows.count()))
    hot = sets.where(F.col("copies") > most).drop("copies")
    cold = sets.where(F.col("copies") <= most).drop("copies")
    bare = rows.where("set is null").withColumns({"class_id": F.lit(None).cast(sets.schema["class_id"].dataType), "n_links": F.lit(None).cast("long"), "first_row": F.lit(None).cast("long")})
    some = rows.where("set is not null").join(F.broadcast(hot.withColumnsRenamed({c: f"hot_{c}" for c in hot.columns})), F.expr("set = hot_set"), "left")
    own = ["class_id", "n_links", "first_row"]
    found = some.where("hot_set is not null").select(*rows.columns, *[F.col(f"hot_{c}").alias(c) for c in own])
    rest = some.where("hot_set is null").select(*rows.columns).join(cold, "set").select(*rows.columns, *own)
    return bare.unionByName(found).unionByName(rest)


def join(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each row of df: the id, `class_id` (least id of the class) and `n_links` (other rows with a
    Jaccard similarity of at least the threshold).

    A class is a connected component of links. Copies and repeated rows link to each other. A text without
    words is in a class of its own without links. Ids must be integers; a null id is carried as null, and
    gives no class its name unless all of a class's ids are null. Very long texts are compared whole, as sets of
    8-byte hashes. An empty table gives an empty table.
    """
    return _with_sets(*classes(df, text_col, id_col, threshold, tolerance)).select(
        F.col("id").alias(id_col), F.expr("if(set is null, id, class_id)").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_first(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """df's rows without near duplicates: of each class the row of least id stays, whole; of rows that are
    alike in id and text, one.

    Rows without words stay. Null ids are equal to each other here, and a null id is kept only where its class has
    no other. Ids must be integers. Very long texts are compared whole. An empty table gives an empty table.
    """
    rows, sets = classes(df, text_col, id_col, threshold)
    stay = _with_sets(rows, sets).where("set is null or row = first_row").select(
        F.col("id").alias("__id"), F.col("k1").alias("__s1"), F.col("k2").alias("__s2"), F.col("set").isNull().alias("__bare"))
    stay = stored(stay.groupBy("__id", "__s1", "__s2").agg(F.max("__bare").alias("__bare")), "staying")
    k1, k2 = text_key(F.col(f"`{text_col}`"))
    keyed = df.withColumns({"__k1": k1, "__k2": k2})
    out = keyed.join(stay, F.expr(f"cast(`{id_col}` as long) <=> __id and __k1 = __s1 and __k2 = __s2"))
    names = df.columns
    twice = rows.where("set is not null").groupBy("id", "k1", "k2").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    if not twice:
        alone = out.where("__bare").select(*[F.col(f"`{c}`") for c in names])
        return out.where("not __bare").dropDuplicates([id_col, "__k1", "__k2"]).select(*[F.col(f"`{c}`") for c in names]).unionByName(alone)
    return out.select(*[F.col(f"`{c}`") for c in names])
