"""Language identification: a linear-chain CRF labels every word, forward-backward marginals label the document.

Word potentials are sums over hashed features: the word itself (lexicon), its affixes of one to three
characters and its character n-grams. Learned transitions let the language change within a text; texts that
switch languages are put together from the training sample, so that changes are seen in training.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.chain_crf import Adam, marginals, pair_counts
from gridloom.llm.common import U64, add_columns, mix

LETTERS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 17
UNKNOWN = "und"
_POWER = mix(np.arange(1, 65, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every feature of the words, worked out on arrays of their lower-cased characters.

    Features are the whole word, prefixes and suffixes of one to three characters, and the 2- and 3-grams of the
    word between two end marks. A kind of feature and its characters make a 64-bit hash, whose upper bits are the bucket.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = [w.lower() for w in words]
    size = np.fromiter(map(len, low), np.int64, len(low))
    c = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(low)), size)
    at = np.arange(len(c)) - start[of]
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(kind: int, word: np.ndarray, *chars: np.ndarray) -> None:
        x = np.full(len(word), U64(kind))
        for k, ch in enumerate(chars):
            x = x + (ch + U64(1)) * _POWER[k]
        found.append(((mix(x * U64(0xC2B2AE3D27D4EB4F)) >> U64(64 - 17)).astype(np.int64), word))

    whole = np.add.reduceat(mix((c + U64(1)) * _POWER[at % 64] + (at // 64).astype(U64)), start)
    add(1, np.arange(len(low)), whole)
    for n in (1, 2, 3):
        w = np.flatnonzero(size >= n)
        add(10 + n, w, *[c[start[w] + k] for k in range(n)])
        add(20 + n, w, *[c[start[w] + size[w] - n + k] for k in range(n)])
    mark = np.insert(np.insert(c, start, 0), np.cumsum(size) + np.arange(1, len(low) + 1), 0)  # a 0 before and behind each word
    owner = np.repeat(np.arange(len(low)), size + 2)
    for n in (2, 3):
        i = np.flatnonzero(owner[: len(mark) - n + 1] == owner[n - 1 :])
        add(30 + n, owner[i], *[mark[i + k] for k in range(n)])
    return np.concatenate([f for f, _ in found]), np.concatenate([w for _, w in found])


def _potentials(weights: np.ndarray, feats: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(of, weights[feats, j], n) for j in range(weights.shape[1])], 1) if n else np.zeros((0, weights.shape[1]))


class _Rows:
    """Rows of numbers by word: a young and an old generation of up to `most` words each.

    Words met again move from old to young; when the young are full they become the old, and what was not met
    meanwhile is gone.
    """

    def __init__(self, width: int, most: int) -> None:
        self.width, self.most = width, most
        self.old: tuple[dict[str, int], np.ndarray] = ({}, np.zeros((0, width)))
        self._renew()

    def _renew(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, self.width))

    def _put(self, words: list[str], rows: np.ndarray) -> None:
        n = len(self.at)
        while n + len(words) > len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])  # doubles, so that few words don't copy all
        self.rows[n : n + len(words)] = rows
        self.at.update(zip(words, range(n, n + len(words))))

    def get(self, words: list[str], make) -> np.ndarray:
        """The rows of distinct words; make gives those of words that aren't here."""
        if len(self.at) > self.most:
            self.old = (self.at, self.rows)
            self._renew()
        missing = [w for w in words if w not in self.at]
        kept = [w for w in missing if w in self.old[0]]
        if kept:
            self._put(kept, self.old[1][[self.old[0][w] for w in kept]])
        new = [w for w in missing if w not in self.old[0]]
        if new:
            self._put(new, make(new))
        return self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray
    start: np.ndarray
    trans: np.ndarray
    known: _Rows | None = field(default=None)

    CACHED = 200_000

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": None}

    def _make(self, words: list[str]) -> np.ndarray:
        return _potentials(self.weights, *word_features(words), len(words))

    def _marginals(self, found: list[list[str]]) -> np.ndarray:
        """Each word's probability of each language; texts end to end, none without words."""
        if self.known is None:
            self.known = _Rows(len(self.langs), self.CACHED)
        flat = list(itertools.chain.from_iterable(found))
        number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        rows = self.known.get(list(number), self._make)
        first = np.zeros(len(flat), bool)
        first[np.cumsum([0] + [len(ws) for ws in found[:-1]])] = True
        return marginals(rows[np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))], first, self.start, self.trans)[0]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, share of the letters' marginals it has) of each text; `und` and 0 without letters."""
        found = [LETTERS.findall(t) if t else [] for t in texts]
        full = [i for i, ws in enumerate(found) if ws]
        langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not full or not self.langs:
            return langs, score
        p = self._marginals([found[i] for i in full])
        size = np.fromiter(map(len, itertools.chain.from_iterable(found)), float, len(p))
        starts = np.cumsum([0] + [len(found[i]) for i in full[:-1]])
        share = np.add.reduceat(p * size[:, None], starts) / np.add.reduceat(size, starts)[:, None]
        best = share.argmax(1)
        for j, i in enumerate(full):
            langs[i], score[i] = self.langs[best[j]], min(1.0, share[j, best[j]])
        return langs, score

    def tag(self, texts: list[str | None]) -> list[list[tuple[str, str]]]:
        """(word, language) of every word of each text."""
        found = [LETTERS.findall(t) if t else [] for t in texts]
        full = [ws for ws in found if ws]
        if not full or not self.langs:
            return [[(w, UNKNOWN) for w in ws] for ws in found]
        best = iter(self._marginals(full).argmax(1).tolist())
        return [[(w, self.langs[next(best)]) for w in ws] for ws in found]


def switched(found: list[tuple[list[str], int]], most: int) -> list[tuple[list[str], list[int]]]:
    """Up to `most` chains of runs of 5 to 20 words, each run from a text of another language than the one before."""
    rng = np.random.default_rng(0)
    if len({lab for _, lab in found}) < 2:
        return []
    out = []
    for _ in range(most):
        words, labels, last = [], [], -1
        for _ in range(4):
            ws, lab = found[rng.integers(len(found))]
            if lab != last:
                at = rng.integers(max(1, len(ws) - 5))
                run = ws[at : at + rng.integers(5, 21)]
                words, labels, last = words + run, labels + [lab] * len(run), lab
        out.append((words, labels))
    return out


def fit(texts: list[str], labels: list[str], steps: int = 30, mixed: float = 0.25) -> LanguageModel:
    """A model from texts and their languages; a text without letters teaches nothing.

    mixed: how many texts that switch languages are put together, as a share of the texts.
    """
    found = [LETTERS.findall(t or "") for t in texts]
    pairs = [(ws, lab) for ws, lab in zip(found, labels) if ws]
    langs = sorted({lab for _, lab in pairs})
    k = len(langs)
    if k == 0:
        return LanguageModel([], np.zeros((BUCKETS, 1)), np.zeros(1), np.zeros((1, 1)))
    plain = [(ws, langs.index(lab)) for ws, lab in pairs]
    chains = [(ws, [lab] * len(ws)) for ws, lab in plain] + switched(plain, int(mixed * len(plain)))
    flat = [w for ws, _ in chains for w in ws]
    vocab = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ids = np.fromiter(map(vocab.__getitem__, flat), np.int64, len(flat))
    y = np.array([lab for _, ls in chains for lab in ls])
    first = np.zeros(len(flat), bool)
    first[np.cumsum([0] + [len(ws) for ws, _ in chains[:-1]])] = True
    feats, of = word_features(list(vocab))
    gold = np.zeros((len(vocab), k))
    np.add.at(gold, (ids, y), 1.0)
    # Start from smoothed log shares of each feature's labels, then climb the chain's likelihood.
    seen = np.stack([np.bincount(feats, gold[of, j], BUCKETS) for j in range(k)], 1)
    prior = seen.sum(0) + 1.0
    logs = np.log((seen + 0.5) / prior)
    logs[seen.sum(1) == 0] = 0
    w = 0.3 * (logs - logs.mean(1, keepdims=True))
    p = {"w": w, "s": np.zeros(k), "t": np.full((k, k), -2.0) + 2.0 * np.eye(k)}
    inner = np.flatnonzero(~first)
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (y[inner - 1], y[inner]), 1.0)
    gold_start = np.eye(k)[y[first]].sum(0)
    opt = Adam(p, 0.05)
    n = len(flat)
    for _ in range(steps):
        m, f, b, e = marginals(_potentials(p["w"], feats, of, len(vocab))[ids], first, p["s"], p["t"])
        diff = gold.copy()
        for j in range(k):
            diff[:, j] -= np.bincount(ids, m[:, j], len(vocab))
        grad = np.stack([np.bincount(feats, diff[of, j], BUCKETS) for j in range(k)], 1)
        opt.step({
            "w": grad / n - 1e-6 * p["w"],
            "s": (gold_start - m[first].sum(0)) / n - 1e-4 * p["s"],
            "t": (gold_pairs + 0.01 * n / k / k - pair_counts(f, b, e, first, p["t"])) / n - 1e-4 * p["t"],
        })
    return LanguageModel(langs, p["w"], p["s"], p["t"])


def fit_from(docs: DataFrame, where: str = "true", docs_most: int = 800, chars_most: int = 4000) -> LanguageModel:
    """Fit on at most docs_most documents of 1 to chars_most characters with a language, lowest doc_id hash first.

    `where` is SQL over doc_id. The bound is on the training sample alone; predictions cover everything.
    Only hashes in the lowest share of the hash range that holds about four times the bound of such documents
    are looked at, so what the partitions send doesn't grow with their number. The share grows until the
    bound, or every such document, is reached; so the sample is that of the whole range.
    """
    fit_for = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.length("text").between(1, chars_most)).where(where)
    total = fit_for.count()
    share = min(1.0, 4 * docs_most / max(1, total))
    while True:
        rows = (
            fit_for.where(f"shiftright(xxhash64(doc_id), 2) <= {int(share * 2**62) - 2**61}L")
            .select("doc_id", "text", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text", "lang").limit(docs_most)
            .select("text", "lang").toPandas()
        )
        if share == 1.0 or len(rows) >= docs_most:
            break
        share = min(1.0, 4 * share)
    return fit(rows["text"].tolist(), rows["lang"].tolist())


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """df plus `lang_pred` and `score` (0 to 1, its share of the text's letters).

    Null texts and texts without a letter get `und` and 0. Ties go to the language first in alphabetical
    order. Very long texts are labelled whole; memory follows the longest. An empty table gives an empty table. Rows, repeats and other columns stay; input columns named like the new ones are replaced.
    """

    def run(texts: list[str | None]) -> list:
        return list(model.predict(texts))

    return add_columns(df, "lang_pred string, score double", run, [text_col], rows=128)


def tag_words(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """df plus `word_langs` array<struct<word, lang>>: the language of every word by its marginals, so a text may hold several.

    Null texts and texts without a letter have none. Rows, repeats and other columns stay; one of that name is replaced.
    """

    def run(texts: list[str | None]) -> list:
        return [[[{"word": w, "lang": lang} for w, lang in ws] for ws in model.tag(texts)]]

    return add_columns(df, "word_langs array<struct<word:string,lang:string>>", run, [text_col], rows=128)
