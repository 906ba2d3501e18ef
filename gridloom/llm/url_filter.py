"""URL filters: allow and block rules in a trie over reversed host labels and path segments.

The trie is a driver-side parameter of at most MOST_RULES rules and is shipped with the tasks.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import add_columns

MOST_RULES = 1_000_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and paths that start with `path`."""

    verdict: str
    host: str
    path: str = "/"

    def __str__(self) -> str:
        return self.host + self.path


@dataclass
class _Node:
    """labels: by the next host label; segments: by the next whole path segment; tails: by a last, open piece; sizes: of the tails, longest first."""

    labels: dict[str, _Node] = field(default_factory=dict)
    paths: _Node | None = None
    segments: dict[str, _Node] = field(default_factory=dict)
    tails: dict[str, Rule] = field(default_factory=dict)
    sizes: list[int] = field(default_factory=list)


class RuleTrie:
    """Longest match: the deepest host with a fitting path wins, and on one host the longest path.

    Of rules with equal host and path the first counts.
    """

    def __init__(self, rules: list[Rule], default: str = "allow") -> None:
        if len(rules) > MOST_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are shipped to the executors")
        self.root, self.default = _Node(), default
        for r in rules:
            if r.verdict not in ("allow", "block"):
                raise ValueError(f"verdict {r.verdict!r}")
            node = self.root
            for label in reversed(r.host.translate(_LOWER).split(".")):
                node = node.labels.setdefault(label, _Node())
            node.paths = node.paths or _Node()
            node = node.paths
            *whole, tail = r.path.split("/")
            for seg in whole:
                node = node.segments.setdefault(seg, _Node())
            if tail not in node.tails:
                node.tails[tail] = r
                at = bisect.bisect_left(node.sizes, -len(tail), key=int.__neg__)
                if at == len(node.sizes) or node.sizes[at] != len(tail):
                    node.sizes.insert(at, len(tail))

    def _by_path(self, node: _Node, path: str) -> Rule | None:
        best, parts = None, path.split("/")
        for i, part in enumerate(parts):
            for n in node.sizes:
                if n <= len(part) and (hit := node.tails.get(part[:n])) is not None:
                    best = hit
                    break
            if i == len(parts) - 1 or part not in node.segments:
                break
            node = node.segments[part]
        return best

    def find(self, host: str, path: str) -> Rule | None:
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            if node.paths is not None:
                best = self._by_path(node.paths, path) or best
        return best

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        host, path = split_url(url)
        rule = self.find(host, path)
        return host, path, str(rule) if rule else None, rule.verdict if rule else self.default


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): after the first ``://`` up to ``/ ? #``, A-Z lower-cased; then up to ``? #``. Else empty."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    for c in "?#":
        rest = rest.partition(c)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def filter_urls(df: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """df plus `host`, `path`, `rule` (null if none fits) and `verdict` (the rule's, else `default`).

    Null urls and urls without ``://`` have an empty host and path. Very long urls are read whole; a url costs its
    labels and segments, and for each segment the distinct lengths of the rules' last pieces there, not their
    number. Every row stays, repeats too; input columns named like the new ones are replaced. An empty table
    gives an empty table.
    """
    trie = RuleTrie(rules, default)

    def run(urls: list[str | None]) -> list:
        return list(zip(*map(trie.judge, urls))) or [[], [], [], []]

    return add_columns(df, "host string, path string, rule string, verdict string", run, [url_col], rows=4096)


def kept_urls(df: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """The rows of df whose url is allowed, with df's own columns, also those named like the ones of filter_urls."""
    hold = {c: f"__keep_{i}" for i, c in enumerate(df.columns)}
    mark = filter_urls(df.select(*[F.col(f"`{c}`").alias(a) for c, a in hold.items()]), rules, hold[url_col], default)
    return mark.where("verdict = 'allow'").select(*[F.col(a).alias(c) for c, a in hold.items()])
