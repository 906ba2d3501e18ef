"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. Of every ten consecutive
words the leftmost smallest 4-word hash is a fingerprint, so texts that share ten words share one at the
same offset. Documents' and items' fingerprints are joined, and each hit is extended: the ten words
around it must equal the item's. Every shared span of ten words or more is found.

Items of fewer than ten words have no full window; for each such length that occurs, all windows of that
length are fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stored, text_key, without

WINDOW, GRAM = 10, 4
#: Item windows are broadcast up to this many (about 200 bytes each); beyond it both sides are shuffled.
BROADCAST_WINDOWS = 200_000
#: Low bits of a packed fingerprint that hold its position.
POS_BITS = 27

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words after lower-casing (fixed value).
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _APART)
    return F.filter(parts, lambda w: w != "")


def _grams(words: str, n: int) -> str:
    """SQL for the packed fingerprint of each n-word window: hash bits over its position."""
    rest = "".join(f", get({words}, i + {k})" for k in range(1, n))
    return (
        f"transform(slice({words}, 1, greatest(size({words}) - {n - 1}, 0)), (w, i) -> "
        f"shiftleft(shiftrightunsigned(xxhash64(w{rest}), {POS_BITS}), {POS_BITS}) | i)")


def _winnowed(grams: str) -> str:
    """SQL for each ten-word window's smallest packed fingerprint (ties: leftmost, as the position is in it)."""
    wide = WINDOW - GRAM
    rest = ", ".join(f"get({grams}, i + {k})" for k in range(1, wide + 1))
    return f"transform(slice({grams}, 1, greatest(size({grams}) - {wide}, 0)), (x, i) -> least(x, {rest}))"


def _prints(df: DataFrame, lengths: list[int]) -> DataFrame:
    """df (with __w) plus __n, __fp and __at: a window length, fingerprint hash bits and position; one row for each.

    All lengths are taken from one pass over the texts and their words.
    """
    arrays = []
    out = df
    if WINDOW in lengths:
        out = out.withColumn("__g", F.expr(_grams("__w", GRAM)))
        arrays.append((WINDOW, f"array_distinct({_winnowed('__g')})"))
    arrays += [(n, _grams("__w", n)) for n in lengths if n != WINDOW]
    # The outer form: for the inner one the optimizer adds a filter that computes the whole array again.
    if len(arrays) == 1:
        out = out.select(*df.columns, F.lit(arrays[0][0]).alias("__n"), F.explode_outer(F.expr(arrays[0][1])).alias("__x"))
    else:
        every = ", ".join(f"transform({v}, x -> named_struct('n', {n}, 'x', x))" for n, v in arrays)
        out = out.select(*df.columns, F.explode_outer(F.expr(f"concat({every})")).alias("__v")).select(*df.columns, F.col("__v.n").alias("__n"), F.col("__v.x").alias("__x"))
    low = (1 << POS_BITS) - 1
    return out.select(
        *df.columns, "__n", F.expr(f"shiftrightunsigned(__x, {POS_BITS})").alias("__fp"),
        F.expr(f"cast(__x & {low}L as int)").alias("__at"))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(__item, __n, __fp, __off, __win): each window of the items, its fingerprint and where that is in it."""
    base = items.select(F.col(f"`{id_col}`").alias("__item"), words_of(F.col(f"`{text_col}`")).alias("__w")).where("size(__w) > 0")
    full = base.where(f"size(__w) >= {WINDOW}").withColumn("__g", F.expr(_grams("__w", GRAM)))
    full = full.withColumn("__v", F.expr(_winnowed("__g")))
    low = (1 << POS_BITS) - 1
    full = full.select("__item", "__w", F.posexplode_outer("__v").alias("__p", "__x")).where("__x is not null").select(
        "__item", F.lit(WINDOW).alias("__n"), F.expr(f"shiftrightunsigned(__x, {POS_BITS})").alias("__fp"),
        F.expr(f"cast(__x & {low}L as int) - __p").alias("__off"), F.expr(f"slice(__w, __p + 1, {WINDOW})").alias("__win"))
    short = base.where(f"size(__w) < {WINDOW}")
    small = [
        short.where(f"size(__w) = {n}").select(
            "__item", F.lit(n).alias("__n"), F.expr(f"shiftrightunsigned(get({_grams('__w', n)}, 0), {POS_BITS})").alias("__fp"),
            F.lit(0).alias("__off"), F.col("__w").alias("__win"))
        for n in range(1, WINDOW)]
    for s in small:
        full = full.unionByName(s)
    return full


def _hits(docs: DataFrame, windows: DataFrame, lengths: list[int], small: bool) -> DataFrame:
    """(__k1, __k2, __item, __n, __p): every occurrence of an item's window in a text, by the text's key."""
    keyed = docs.select("__k1", "__k2", words_of(F.col("__text")).alias("__w"))
    same = "__n = __m and __fp = __f"
    # Items that share a window are one row with a list, so a window that many items hold is compared once.
    right = windows.groupBy(F.col("__n").alias("__m"), F.col("__fp").alias("__f"), "__off", "__win").agg(F.collect_set("__item").alias("__who"), F.max(F.col("__item").isNull()).alias("__none"))
    found = ["__k1", "__k2", F.explode(F.expr("if(__none, array_append(__who, null), __who)")).alias("__item"), "__n", "__p"]
    near = ["__k1", "__k2", "__who", "__none", "__n", F.expr("__at - __off").alias("__p")]
    equal = "__at >= __off and slice(__w, greatest(__at - __off, 0) + 1, __n) = __win"
    if small:
        return _prints(keyed, lengths).join(F.broadcast(right), F.expr(same)).where(equal).select(*near).select(*found)
    # The shuffled way carries keys only and fetches the words of texts with a hit for the comparison.
    slim = _prints(keyed, lengths).select("__k1", "__k2", "__n", "__fp", "__at").distinct()
    maybe = slim.join(right, F.expr(same)).select("__k1", "__k2", "__who", "__none", "__n", "__at", "__off", "__win")
    return maybe.join(keyed.dropDuplicates(["__k1", "__k2"]), ["__k1", "__k2"]).where(equal).select(*near).select(*found)


NEW = ["n_words", "n_hit", "items", "contaminated"]


def find_contamination(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """docs plus `n_words`, `n_hit` (words inside an occurrence of an item's window), `items` (ids of the items
    with an occurring window, as sorted strings) and `contaminated` (n_hit > 0).

    Null texts have no words; items without words have no window. Equal texts get equal results, so copies
    and repeated rows are looked up by text. Very long texts are read whole, up to 2 ** 27 words. Null item ids are left out of `items` but count as hits. Other
    columns stay; those named like the new ones are replaced. Empty tables are fine on either side.

    Eager: it counts the items' windows to choose between broadcast and shuffle, and stores what it finds
    for each contaminated text.
    """
    windows = item_windows(items, item_id, item_text)
    lengths = {r["__n"]: r["n"] for r in windows.groupBy("__n").agg(F.count("*").alias("n")).collect()}
    k1, k2 = text_key(F.col("__text"))
    base = without(docs.withColumn("__text", F.col(f"`{text_col}`")), NEW).withColumns({"__k1": k1, "__k2": k2})
    n_words = F.size(words_of(F.col("__text"))).cast("long").alias("n_words")
    kept = [F.col(f"`{c}`") for c in base.columns if c not in ("__text", "__k1", "__k2")]
    none = [F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated")]
    if not lengths:
        return base.select(*kept, n_words, *none)
    hits = _hits(base.select("__k1", "__k2", "__text"), windows, sorted(lengths), sum(lengths.values()) <= broadcast_windows)
    by_text = hits.groupBy("__k1", "__k2").agg(
        F.collect_set(F.struct(F.col("__p").alias("p"), F.col("__n").alias("n"))).alias("__spans"),
        F.collect_set(F.col("__item").cast("string")).alias("__items"),
    ).select(
        "__k1", "__k2", F.sort_array("__items").alias("__items"),
        F.expr("cast(size(array_distinct(flatten(transform(__spans, s -> sequence(s.p, s.p + s.n - 1))))) as bigint)").alias("__hit"))
    # Stored, so that the join below is between two exchanges and a text held by many rows can be split.
    by_text = stored(by_text, "contaminated")
    return base.select(*kept, "__k1", "__k2", n_words).join(by_text, ["__k1", "__k2"], "left").select(
        *kept, "n_words", F.coalesce("__hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("__items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("__hit", F.lit(0)) > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs without any item's window, with docs' columns. Null and empty texts stay; empty tables are fine."""
    hold = {c: f"__keep_{i}" for i, c in enumerate(docs.columns)}
    marked = find_contamination(docs.select(*[F.col(f"`{c}`").alias(a) for c, a in hold.items()]), items, hold[text_col])
    return marked.where("not contaminated").select(*[F.col(a).alias(c) for c, a in hold.items()])
