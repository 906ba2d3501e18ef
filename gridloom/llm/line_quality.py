"""Quality classifier: a linear-chain CRF labels every line good or bad; its marginals give document quality.

A line's potentials come from dense features of the line and of its two neighbours. Labels exist for
documents only, so training starts with every line carrying its document's label and then, once, gives
lines of bad documents that look good the label good, all but the worst one. Document quality is the
length-weighted mean of the good-line marginals, put through a logistic curve fitted on the same sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.chain_crf import Adam, marginals, pair_counts
from gridloom.llm.common import add_columns

#: Shares above these count as separate features.
STEPS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8)
SYMBOLS = frozenset("#*$%&|<>{}[]~^\\=_@")
N_SHARES = 9
WIDTH = N_SHARES * (1 + len(STEPS)) + 5


#: Lines whose features are held at a time.
BLOCK = 8192


def line_blocks(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features of each line, its length in characters), BLOCK lines at a time; an empty or null text is one empty line."""
    lines = (text or "").split("\n")
    seen: set[str] = set()
    for at in range(0, len(lines), BLOCK):
        yield _features(lines[at : at + BLOCK], seen)


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """line_blocks of a whole text."""
    blocks = list(line_blocks(text))
    return np.vstack([f for f, _ in blocks]), np.concatenate([s for _, s in blocks])


def _features(lines: list[str], seen: set[str]) -> tuple[np.ndarray, np.ndarray]:
    shares, flags = np.zeros((len(lines), N_SHARES)), np.zeros((len(lines), 5))
    size = np.array([len(x) for x in lines], float)
    for i, line in enumerate(lines):
        ws = line.split()
        if not ws:
            flags[i, 0] = 1
            continue
        n, m = len(line), len(ws)
        up = sum(map(str.isupper, line))
        letters = sum(map(str.isalpha, line))
        sym = sum(line.count(c) for c in SYMBOLS)
        shares[i] = (
            up / n,
            sum(map(str.isdigit, line)) / n,
            sym / n,
            line.count("!") / n,
            1 - letters / n,
            sum(map(str.isupper, ws)) / m,
            1 - len(set(ws)) / m,
            sum(len(w) == 1 for w in ws) / m,
            sum(not w[0].isalnum() for w in ws) / m,
        )
        flags[i, 1:] = (line in seen, ws[-1][-1] in ".!?", min(m, 60) / 60, min(letters / m, 20) / 20)
        seen.add(line)
    stepped = (shares[:, :, None] > np.array(STEPS)).reshape(len(lines), -1)
    return np.hstack([shares, stepped, flags]), size


def _design(blocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Own, previous and next line's features and a constant, for chains laid end to end; the chain starts."""
    x = np.vstack(blocks)
    first = np.zeros(len(x), bool)
    first[np.cumsum([0] + [len(b) for b in blocks[:-1]])] = True
    prev, nxt = np.zeros_like(x), np.zeros_like(x)
    prev[1:], nxt[:-1] = x[:-1], x[1:]
    prev[first] = 0
    nxt[np.r_[first[1:], True]] = 0
    return np.hstack([x, prev, nxt, np.ones((len(x), 1))]), first


@dataclass
class LineQualityModel:
    weights: np.ndarray
    start: np.ndarray
    trans: np.ndarray
    slope: float
    offset: float

    def _parts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Of each line, what its features add to its own potentials, the next line's and the previous one's (six numbers); its length."""
        own, before, after = np.split(self.weights[:-1], 3)
        w = np.hstack([own, before, after])
        got = [(f @ w, size) for f, size in line_blocks(text)]
        return np.vstack([x for x, _ in got]), np.concatenate([size for _, size in got])

    def means(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted mean of the good-line marginals of each text."""
        if not texts:
            return np.zeros(0)
        got = [self._parts(t) for t in texts]
        at = np.cumsum([0] + [len(s) for _, s in got[:-1]])
        x, weight = np.vstack([x for x, _ in got]), np.concatenate([s for _, s in got]) + 1.0
        first = np.zeros(len(x), bool)
        first[at] = True
        score = x[:, :2] + self.weights[-1]
        inner = np.flatnonzero(~first)
        score[inner] += x[inner - 1, 2:4]
        score[inner - 1] += x[inner, 4:]
        p = marginals(score, first, self.start, self.trans)[0][:, 1]
        return np.add.reduceat(p * weight, at) / np.add.reduceat(weight, at)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = self.slope * (self.means(texts) - 0.5) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str | None], labels: list[int], steps: int = 60, penalty: float = 1e-3) -> LineQualityModel:
    """A model from labelled texts. Without texts, or with one label only, every score is that label's share."""
    blocks = [line_features(t) for t in texts]
    y_doc = np.array(labels, int)
    width = 3 * WIDTH + 1
    model = LineQualityModel(np.zeros((width, 2)), np.zeros(2), np.zeros((2, 2)), 0.0, 0.0)
    if len(set(labels)) < 2:
        model.offset = 8.0 * (2 * y_doc[0] - 1) if len(y_doc) else 0.0
        return model
    x, first = _design([f for f, _ in blocks])
    owner = np.cumsum(first) - 1
    y = y_doc[owner]
    p = {"w": model.weights, "s": model.start, "t": model.trans}
    for turn in range(2):
        gold = np.eye(2)[y]
        pairs = np.zeros((2, 2))
        inner = np.flatnonzero(~first)
        np.add.at(pairs, (y[inner - 1], y[inner]), 1.0)
        opt = Adam(p, 0.05)
        for _ in range(steps):
            m, f, b, e = marginals(x @ p["w"], first, p["s"], p["t"])
            n = len(x)
            opt.step({
                "w": x.T @ (gold - m) / n - penalty * p["w"],
                "s": (gold - m)[first].sum(0) / n - penalty * p["s"],
                "t": (pairs - pair_counts(f, b, e, first, p["t"])) / n - penalty * p["t"],
            })
        if turn == 0:
            good = marginals(x @ p["w"], first, p["s"], p["t"])[0][:, 1]
            worst = np.full(len(y_doc), np.inf)
            np.minimum.at(worst, owner, good)
            y = np.where((y == 0) & (good > 0.6) & (good > worst[owner]), 1, y)
    mean = model.means(texts)
    a, c = 4.0, 0.0
    for _ in range(300):
        q = 1 / (1 + np.exp(-np.clip(a * (mean - 0.5) + c, -30, 30)))
        a += 4 * ((y_doc - q) * (mean - 0.5)).mean() - 1e-4 * a
        c += 1.0 * (y_doc - q).mean()
    model.slope, model.offset = float(a), float(c)
    return model


def fit_from(docs: DataFrame, labels: DataFrame, where: str = "true", docs_most: int = 3000, chars_most: int = 20_000) -> LineQualityModel:
    """Fit on at most docs_most labelled documents of at most chars_most characters each.

    The sample is the documents of lowest hash of doc_id among labelled ones for which `where` (SQL over
    doc_id) holds: a bounded sample by design; scoring covers everything. Of several labels for one id the
    highest counts; null labels and ids are left out.
    """
    picked = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(where)
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_most)
    )
    rows = (
        docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= chars_most)
        .join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(docs_most)
        .select("text", "quality").toPandas()
    )
    return fit([t if isinstance(t, str) else None for t in rows["text"]], [int(q) for q in rows["quality"]])


def score(df: DataFrame, model: LineQualityModel, text_col: str = "text") -> DataFrame:
    """df plus `score` (0 to 1, higher: good likelier) and `predicted` (1 if score >= 0.5, else 0).

    Null and empty texts are scored as one empty line. Very long texts are scored whole; the features of BLOCK
    lines are held at a time and six numbers for each line, so memory follows the text itself. Rows, repeats and other columns stay as they are,
    but input columns named like the two new ones are replaced. An empty table gives an empty table.
    """

    def run(texts: list[str | None]) -> list:
        s = model.scores(texts)
        return [s, (s >= 0.5).astype(np.int32)]

    return add_columns(df, "score double, predicted int", run, [text_col])
