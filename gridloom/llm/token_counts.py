"""Token counts of a byte-level BPE by rank-synchronous array merging.

Texts are cut at spaces that stand between two other characters, where no pre-token can cross, and the
count of each short chunk is remembered. Chunks not yet seen are pre-tokenized, and their distinct
pre-tokens are merged together as one ragged array: in every round each sequence's lowest-rank pair is
applied at all its places at once, until no sequence has a pair left; then the symbols are counted.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame

from gridloom.llm.common import add_columns

#: The white space of the pre-tokenizer's pattern, and the pattern itself (fixed values of this vocabulary).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
_CLOSE = re.compile(rf" [{SPACE}]|[{SPACE}] ")
_CUT = re.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])")
NONE = np.iinfo(np.int64).max


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """Counts for one vocabulary file (tokenizers' JSON). Keeps counts of up to CACHED chunks of up to SHORT characters."""

    CACHED, SHORT = 400_000, 64

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.byte_id = np.array([vocab[c] for c in _byte_symbols()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        order = np.argsort((left << 32) | right, kind="stable")
        self.keys = ((left << 32) | right)[order]
        self.rank = order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.pretokens = regex.compile(PATTERN).findall
        self.cache: dict[str, int] = {}

    def merged_lengths(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token (none is empty)."""
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        sym = self.byte_id[np.frombuffer(b"".join(tokens), np.uint8)]
        seq = np.repeat(np.arange(len(tokens)), size)
        done = np.zeros(len(tokens), np.int64)
        while len(sym):
            key = (sym[:-1] << 32) | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (seq[:-1] == seq[1:]), self.rank[at], NONE)
            rank = np.append(rank, NONE)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, starts)
            count = np.diff(np.append(starts, len(sym)))
            over = low == NONE
            done[seq[starts[over]]] = count[over]
            low = np.repeat(low, count)
            hit = (rank == low) & (low != NONE)
            # Of overlapping places (aaa) every second one counts, from the left.
            idx = np.flatnonzero(hit)
            if len(idx):
                run = np.r_[True, np.diff(idx) > 1]
                begin = idx[run][np.cumsum(run) - 1]
                idx = idx[(idx - begin) % 2 == 0]
            keep = low != NONE
            keep[idx + 1] = False
            sym[idx] = self.made[rank[idx]]
            sym, seq = sym[keep], seq[keep]
        return done

    def _learn(self, chunks: list[str]) -> dict[str, int]:
        cut = [[t.encode("utf-8", "surrogatepass") for t in self.pretokens(c)] for c in chunks]
        distinct = list(dict.fromkeys(t for ts in cut for t in ts))
        length = dict(zip(distinct, self.merged_lengths(distinct).tolist()))
        return {c: sum(map(length.__getitem__, ts)) for c, ts in zip(chunks, cut)}

    def chunks(self, text: str) -> list[str]:
        head, *rest = _CUT.split(text) if _CLOSE.search(text) else text.split(" ")
        out = [" " + w for w in rest]
        return [head, *out] if head else out

    def counts(self, texts: list[str | None]) -> list[int]:
        segments, fixed = [], []
        for t in texts:
            parts = self.special.split(t) if t and self.special else [t or ""]
            fixed.append(len(parts) - 1)
            segments.append([c for p in parts if p for c in self.chunks(p)])
        if len(self.cache) > self.CACHED:
            self.cache.clear()
        cache = self.cache
        new = list(dict.fromkeys(c for s in segments for c in s if c not in cache))
        if not new:
            return [n + sum(map(cache.__getitem__, s)) for n, s in zip(fixed, segments)]
        got = self._learn(new)
        cache.update({c: n for c, n in got.items() if len(c) <= self.SHORT})
        long = {c: n for c, n in got.items() if len(c) > self.SHORT}
        return [n + sum(long[c] if c in long else cache[c] for c in s) if long else n + sum(map(cache.__getitem__, s)) for n, s in zip(fixed, segments)]


@functools.cache
def counter(path: str) -> MergeCounter:
    """One for each worker process."""
    return MergeCounter(path)


def count_tokens(df: DataFrame, path: str, text_col: str = "text", limit: int = 512) -> DataFrame:
    """df plus `n_bytes` (UTF-8), `n_tokens` (long) and `over_limit` (n_tokens > limit).

    The vocabulary file is read where the tasks run. Null counts as empty: 0 bytes, 0 tokens. Special
    strings inside a text count as one token each. Very long texts are counted whole; memory follows the longest
    text. An empty table gives an empty table. Rows, repeats and other columns stay; input columns
    named like the new ones are replaced.
    """

    def run(texts: list[str | None]) -> list:
        n = counter(path).counts(texts)
        return [[len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], n, [x > limit for x in n]]

    return add_columns(df, "n_bytes long, n_tokens long, over_limit boolean", run, [text_col], rows=256)
