"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and decoding.

No piece of the vocabulary has a space behind another character, so the lattice falls apart into units: a
run of spaces and the characters behind it. A unit falls apart further wherever no piece crosses; these
stretches are filtered and sampled by themselves, so a text without any space costs no more steps than
another. The forward pass is done once for each distinct unit. It leaves, at each position, the pieces that
end there, longest first, with their share of all paths so far; a backward sample draws pieces from a
stretch's end to its start. All stretches of a batch draw together, step by step.

Shares are kept as 32-bit thresholds, summed within a position only, and a draw is a 32-bit number that is
compared within the position's own pieces, the last of which takes whatever is left. So a draw can't leave its
position, and ids depend on nothing that is cached or batched beside a text.

A piece of score s weighs (1 - s) ** -theta: scores of a BPE vocabulary are ranks. A character that no
piece can cover weighs as its UTF-8 bytes, which are pieces too. Draws depend on the seed, the row's key,
the number of the stretch in the text and the step, not on batches or partitions.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import U64, add_columns

MARK = "▁"
ALL = np.uint32(0xFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def draws(seed: int, key: np.ndarray, part: np.ndarray, step: int) -> np.ndarray:
    """32 random bits for each (key, part), by counter."""
    x = _mixed(key.astype(U64) + U64((seed * 0x9E3779B97F4A7C15 + 1) % 2**64))
    x = _mixed(x ^ (part.astype(U64) * U64(0xD1342543DE82EF95) + U64(step * 0x2545F4914F6CDD1D % 2**64)))
    return (x >> U64(32)).astype(np.uint32)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (size of them) for each pair, one behind the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Steps:
    """A trie's steps (node, character) -> node as an open-addressed table that is probed by whole arrays."""

    def __init__(self, steps: dict[tuple[int, int], int]) -> None:
        key = np.array([(n << 21) | c for n, c in steps], np.int64)
        to = np.fromiter(steps.values(), np.int64, len(steps))
        self.bits = max(4, int(4 * len(key)).bit_length())
        self.key, self.to = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int64)
        slot = self._slot(key)
        while len(key):
            free = self.key[slot] < 0
            self.key[slot[free]] = key[free]  # of keys that meet in a slot the last one stays
            mine = self.key[slot] == key
            self.to[slot[mine]] = to[mine]
            key, to, slot = key[~mine], to[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def __call__(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The node behind each step, -1 where there is none."""
        key = (node << 21) | char
        slot = self._slot(key)
        have = self.key[slot]
        out = np.where(have == key, self.to[slot], -1)
        open_ = np.flatnonzero((have != key) & (have >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            have = self.key[slot[open_]]
            hit = have == key[open_]
            out[open_[hit]] = self.to[slot[open_[hit]]]
            open_ = open_[~hit & (have >= 0)]
        return out


class PieceSampler:
    """One vocabulary and theta. Keeps the lattices of distinct units up to NODES positions between calls."""

    #: Positions kept, characters learned at a time, and bytes of text sampled at a time.
    NODES, LEARN, BLOCK = 400_000, 100_000, 500_000

    def __init__(self, path: str, theta: float) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        surface: list[bytes] = []
        self.byte_id = np.zeros(256, np.int32)
        self.weight: dict[str, tuple[int, float]] = {}
        size = sp.get_piece_size()
        for i in range(size):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                surface.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                surface.append(b"")
            else:
                s = p.replace(MARK, " ")
                if " " in s.lstrip(" "):
                    raise ValueError(f"piece {p!r} has a space behind another character")
                surface.append(s.encode())
                self.weight[s] = (i, (1.0 - sp.get_score(i)) ** -theta)
        self.spelling = np.frombuffer(b"".join(surface), np.uint8)
        self.spelled = np.fromiter(map(len, surface), np.int64, size)
        self.spelled_at = np.cumsum(self.spelled) - self.spelled
        self.longest = max(map(len, self.weight))
        self.log_byte = -theta * np.log(1.0 + size)
        self._trie()
        self.reset()

    def _trie(self) -> None:
        """The pieces as a trie; at each node its piece or -1."""
        step: dict[tuple[int, int], int] = {}
        piece, logw = [-1], [0.0]
        for s, (i, w) in self.weight.items():
            node = 0
            for c in map(ord, s):
                node = step.setdefault((node, c), len(piece))
                if node == len(piece):
                    piece.append(-1)
                    logw.append(0.0)
            piece[node], logw[node] = i, np.log(w)
        self.step = Steps(step)
        self.at_piece, self.at_logw = np.array(piece, np.int64), np.array(logw)

    def reset(self) -> None:
        self.units: dict[bytes, int] = {}  # unit -> its number; its stretches are parts[number] to parts[number + 1]
        self.parts = np.zeros(1, np.int64)
        self.first, self.last = np.zeros(0, np.int32), np.zeros(0, np.int32)  # of each stretch, its nodes
        self.edge = np.zeros(0, np.int32)  # of each node, its first edge
        self.used = 0
        self.top, self.prev, self.piece = np.empty(1 << 16, np.uint32), np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32)

    def _edges(self, chars: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece, log weight) of every piece in the units, longest first; stop: each character's unit's end.

        A negative piece is a character spelled in bytes.
        """
        live, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        covered = np.zeros(len(chars), bool)
        found = []
        for size in range(1, self.longest + 1):
            if size > 1:
                inside = live + size <= stop[live]
                live, node = live[inside], node[inside]
            node = self.step(node, chars[live + size - 1])
            known = node >= 0
            live, node = live[known], node[known]
            piece = self.at_piece[node]
            hit = piece >= 0
            if size == 1:
                covered[live[hit]] = True
            found.append((live[hit], np.full(hit.sum(), size), piece[hit], self.at_logw[node[hit]]))
            if not len(live):
                break
        bare = np.flatnonzero(~covered)
        c = chars[bare]
        n_bytes = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        found.append((bare, np.ones(len(bare), np.int64), -c - 1, n_bytes * self.log_byte))
        return tuple(np.concatenate(x) for x in zip(*reversed(found)))

    def _learn(self, new: list[bytes]) -> None:
        """Forward pass over units not yet known, all together, by the number of characters behind in the stretch."""
        raw = np.frombuffer(b"".join(new), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        size = np.diff(np.cumsum((raw & 0xC0) != 0x80)[ends - 1], prepend=0)  # in characters
        chars = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.cumsum(size) - size
        start, length, piece, logw = self._edges(chars, np.repeat(begin + size, size))
        # A stretch ends wherever no piece crosses. Node of a position: one for each character's end, one more for each stretch.
        n = len(chars)
        crossed = np.cumsum(np.bincount(start + 1, minlength=n + 2) - np.bincount(start + length, minlength=n + 2))[: n + 1] > 0
        cut = np.flatnonzero(~crossed[:n])  # positions where a stretch begins
        part = np.cumsum(~crossed[:n]) - 1  # of each character
        src = start + part[start]
        dst = src + length
        depth = start + length - cut[part[start]]
        order = np.argsort(dst, kind="stable")
        deep = depth[order]
        order = order[np.argsort(deep.astype(np.uint16) if len(deep) and deep.max() < 65_536 else deep, kind="stable")]  # 16 bits: radix sort
        src, dst, piece, logw, depth = src[order], dst[order], piece[order], logw[order], depth[order]
        at = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])  # each node's first edge
        node, many = dst[at], np.diff(np.r_[at, len(dst)])
        alpha = np.zeros(n + len(cut))
        e, total = np.empty(len(dst)), np.empty(len(at))
        cuts = np.searchsorted(depth[at], np.arange(1, depth[-1] + 2))
        for a, b in zip(cuts[:-1], cuts[1:]):  # nodes of one depth
            lo, hi = at[a], at[b] if b < len(at) else len(dst)
            x = alpha[src[lo:hi]] + logw[lo:hi]
            here = at[a:b] - lo
            high = np.maximum.reduceat(x, here)
            e[lo:hi] = np.exp(x - np.repeat(high, many[a:b]))
            total[a:b] = np.add.reduceat(e[lo:hi], here)
            alpha[node[a:b]] = high + np.log(total[a:b])
        for k in range(1, many.max()):  # shares add up within their node alone
            more = at[many > k] + k
            e[more] += e[more - 1]
        top = np.clip(np.ceil(e / np.repeat(e[at + many - 1], many) * 2.0**32) - 1, 0, float(ALL)).astype(np.uint32)
        top[at + many - 1] = ALL
        base = len(self.edge)
        new_used = self.used + len(dst)
        while new_used > len(self.top):  # rooms double, so that learning a few units doesn't copy all of them
            self.top, self.prev, self.piece = (np.concatenate([x, np.empty_like(x)]) for x in (self.top, self.prev, self.piece))
        self.top[self.used : new_used], self.prev[self.used : new_used], self.piece[self.used : new_used] = top, base + src, piece
        edge = np.zeros(n + len(cut), np.int32)
        edge[node] = self.used + at
        self.edge = np.concatenate([self.edge, edge])
        self.used = new_used
        many_parts = np.diff(np.searchsorted(cut, np.r_[begin, n]))
        first = base + cut + np.arange(len(cut))
        self.first = np.concatenate([self.first, first.astype(np.int32)])
        self.last = np.concatenate([self.last, (first + np.diff(np.r_[cut, n])).astype(np.int32)])
        self.units.update(zip(new, range(len(self.units), len(self.units) + len(new))))
        self.parts = np.concatenate([self.parts, self.parts[-1] + np.cumsum(many_parts)])

    def _numbers(self, units: pa.Array) -> np.ndarray:
        """The number of each unit, learned if need be."""
        coded = units.dictionary_encode()
        d = coded.dictionary
        at, raw = np.frombuffer(d.buffers()[1], np.int64)[d.offset : d.offset + len(d) + 1].tolist(), d.buffers()[2].to_pybytes()
        known = [raw[a:b] for a, b in zip(at[:-1], at[1:])]
        if len(self.edge) > self.NODES:
            self.reset()
        got = list(map(self.units.get, known, itertools.repeat(-1)))
        new = [u for u, g in zip(known, got) if g < 0]
        if new:
            sizes = np.cumsum([len(u) for u in new])
            cuts = [0, *(np.flatnonzero(np.diff(sizes // self.LEARN)) + 1).tolist(), len(new)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                self._learn(new[a:b])
            got = list(map(self.units.__getitem__, known))
        return np.array(got, np.int64)[coded.indices.to_numpy()]

    def _draw(self, units: pa.Array, key: np.ndarray, unit_row: np.ndarray, before: int, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, number of ids of each unit, stretches of the last row) of units, row by row; `before` counts the first row's earlier stretches."""
        number = self._numbers(units)
        count = self.parts[number + 1] - self.parts[number]
        part = _spread(self.parts[number], count)
        row = np.repeat(unit_row, count)
        begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        place = np.arange(len(part)) - np.repeat(begins, np.diff(np.r_[begins, len(part)]))
        place[row == row[0]] += before
        behind = int(place[-1]) + 1
        key = key[row]
        node, first = self.last[part], self.first[part]
        live, step = np.arange(len(part)), 0
        steps = np.zeros(len(part), np.int64)
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            e = self.edge[node[live]]
            r = draws(seed, key[live], place[live], step)
            over = np.flatnonzero(r > self.top[e])
            while len(over):
                e[over] += 1
                over = over[r[over] > self.top[e[over]]]
            seen.append((live, self.piece[e]))
            node[live] = self.prev[e]
            step += 1
            steps[live] = step
            live = live[node[live] > first[live]]
        end = np.cumsum(steps)
        ids = np.empty(end[-1], np.int32)
        for s, (w, p) in enumerate(seen):  # drawn from the end
            ids[end[w] - 1 - s] = p
        of_unit = np.add.reduceat(steps, np.cumsum(count) - count)
        spelled = np.flatnonzero(ids < 0)
        if len(spelled):
            c = -(ids[spelled].astype(np.int64) + 1)
            raw = np.frombuffer(c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            width = np.ones(len(ids), np.int64)
            width[spelled] = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            out = np.repeat(ids, width)
            out[out < 0] = self.byte_id[raw]
            of_unit = np.add.reduceat(width, np.cumsum(of_unit) - of_unit)
            ids = out
        return ids, of_unit, behind

    def sample(self, texts: list[str | None], keys: np.ndarray, seed: int) -> list[np.ndarray | None]:
        """Ids of each text; None for None. A text is read with one space before it, which decoding drops."""
        raw = [b"" if t is None else b" " + t.encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        buf = np.frombuffer(b"".join(raw), np.uint8)
        if not len(buf):
            return [None for _ in texts]
        starts = np.r_[0, ends[:-1]]
        space = buf == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[starts[starts < ends]] = True
        at = np.flatnonzero(begins)
        row = np.searchsorted(ends, at, side="right")
        offsets = np.r_[at, len(buf)]
        units = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buf)])
        cuts = [0, *(np.flatnonzero(np.diff(at // self.BLOCK)) + 1).tolist(), len(at)]
        parts, sizes, before, last = [], [], 0, -1
        for a, b in zip(cuts[:-1], cuts[1:]):
            ids, n, behind = self._draw(units[a:b], keys, row[a:b], before if row[a] == last else 0, seed)
            parts.append(ids)
            sizes.append(n)
            before, last = behind, row[b - 1]
        ids = np.concatenate(parts) if len(parts) > 1 else parts[0]
        total = np.r_[0, np.cumsum(np.concatenate(sizes))]
        unit_cuts = np.searchsorted(at, np.r_[starts, len(buf)])
        cuts = total[unit_cuts]
        return [None if t is None else ids[a:b] for t, a, b in zip(texts, cuts[:-1], cuts[1:])]

    def decode_all(self, many: list[np.ndarray | list[int] | None]) -> list[str | None]:
        """The texts whose ids these are; None for None."""
        size = np.fromiter((0 if x is None else len(x) for x in many), np.int64, len(many))
        flat = np.concatenate([np.asarray(x, np.int64) for x in many if x is not None and len(x)] or [np.zeros(0, np.int64)])
        width = self.spelled[flat]
        raw = self.spelling[_spread(self.spelled_at[flat], width)].tobytes()
        cuts = np.r_[0, np.cumsum(width)][np.r_[0, np.cumsum(size)]].tolist()
        return [None if x is None else raw[a:b].decode("utf-8", "surrogatepass")[1:] for x, a, b in zip(many, cuts[:-1], cuts[1:])]

    def decode(self, ids: np.ndarray | list[int] | None) -> str | None:
        """The text whose ids these are."""
        return self.decode_all([ids])[0]


@functools.cache
def sampler(path: str, theta: float) -> PieceSampler:
    """One for each worker process."""
    return PieceSampler(path, theta)


def encode(df: DataFrame, path: str, text_col: str = "text", key_col: str = "doc_id", theta: float = 1.0, seed: int = 0, check: bool = False) -> DataFrame:
    """df plus `piece_ids` array<int>, a sampled segmentation that decodes to the text exactly.

    The same seed, key and text give the same ids wherever the row is. A null text has null ids; an empty
    one has the ids of the space put before every text. Null keys and repeated rows are sampled like any
    other, equal key and text alike. Very long texts are sampled in blocks of BLOCK bytes of whole units; an empty
    table gives an empty table. Other columns stay; one named `piece_ids` is replaced. check adds
    `lossless`, whether decoding the ids gave the text, found in the same pass.
    """

    def run(texts: list[str | None], keys: list[int]) -> list:
        got = sampler(path, theta).sample(texts, np.array(keys, np.int64), seed)
        sizes = np.array([0 if g is None else len(g) for g in got])
        flat = np.concatenate([g for g in got if g is not None] or [np.zeros(0, np.int32)])
        offsets = pa.array(np.cumsum([0, *sizes]), pa.int32(), mask=np.array([*[g is None for g in got], False]))
        ids = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
        return [ids, [d == t for d, t in zip(sampler(path, theta).decode_all(got), texts)]] if check else [ids]

    keyed = df.withColumn("__key", F.xxhash64(F.col(f"`{key_col}`")))
    return add_columns(keyed, "piece_ids array<int>" + ", lossless boolean" * check, run, [text_col, "__key"], rows=256).drop("__key")


def decode(df: DataFrame, path: str, ids_col: str = "piece_ids", theta: float = 1.0) -> DataFrame:
    """df plus `decoded`, the text of the ids; null for null. Other columns stay; one named `decoded` is replaced."""

    def run(ids: list) -> list:
        return [sampler(path, theta).decode_all(ids)]

    return add_columns(df, "decoded string", run, [ids_col], rows=256)
