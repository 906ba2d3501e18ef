"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

A rule is a condition under which a document is rejected. The cascade is nested conditionals over the rules, so a
row's later rules aren't evaluated once one rejects it; words and lines are cut only when the first rule
that needs them is reached, and then once. The order comes from a sample: each rule's cost is the time it takes
to evaluate there, its selectivity the share it rejects, and rules go by rejection per cost. A document's
verdict doesn't depend on the order.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import without

#: The six characters that part words, as Spark SQL writes them (fixed values).
WHITE = r"' \t\n\u000B\u000C\r'"
#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"


def words_sql(text: str) -> str:
    """SQL for the array of words ``[^\\x20\\x09-\\x0D]+`` of a text column; none for null."""
    return rf"filter(split(coalesce({text}, ''), '[ \\t\\n\\x0B\\f\\r]+'), w -> w <> '')"


def lines_sql(text: str) -> str:
    """SQL for the array of a text's lines with a word."""
    return f"filter(split(coalesce({text}, ''), '\\n'), l -> btrim(l, {WHITE}) <> '')"


def count_of_sql(text: str, chars: str) -> str:
    """SQL for the number of a text's characters that are among these."""
    return f"cast(coalesce(length({text}) - length(translate({text}, '{chars}', '')), 0) as bigint)"


def let_sql(value: str, name: str, body: str) -> str:
    """SQL for a body over a value that is worked out once and only if the body is reached."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def dup_lines_sql(lines: str) -> str:
    """SQL for the number of lines that equal an earlier line."""
    return f"cast(size({lines}) - size(array_distinct({lines})) as bigint)"


def repeat_words_sql(words: str) -> str:
    """SQL for the number of words in 3-word windows that a text holds twice or more, all of them counted.

    Windows are sorted as longs, 36 bits of hash over 28 bits of position. Only positions whose hash bits
    occur twice go on to an exact comparison, again by sorting, of the windows' words.
    """
    at = lambda i: f"get({words}, {i})"
    packed = f"transform(sequence(0, size({words}) - 3), i -> shiftleft(shiftrightunsigned(xxhash64({at('i')}, {at('i + 1')}, {at('i + 2')}), 28), 28) | i)"
    near = lambda a, x: f"shiftrightunsigned({x}, 28) = shiftrightunsigned(get({a}, j + 1), 28) or shiftrightunsigned({x}, 28) = shiftrightunsigned(get({a}, j - 1), 28)"
    maybe = let_sql(f"sort_array({packed})", "s", f"filter(transform(s, (x, j) -> if(coalesce({near('s', 'x')}, false), cast(x & 268435455L as int), null)), x -> x is not null)")
    exact = let_sql(
        f"array_sort(transform(c, i -> struct(concat_ws(' ', {at('i')}, {at('i + 1')}, {at('i + 2')}) as g, i as p)))", "t",
        "sort_array(filter(transform(t, (x, j) -> if(coalesce(x.g = get(t, j + 1).g, false) or coalesce(x.g = get(t, j - 1).g, false), x.p, null)), x -> x is not null))")
    covered = let_sql(exact, "p", "aggregate(transform(p, (x, j) -> least(3, coalesce(get(p, j + 1) - x, 3))), 0L, (a, x) -> a + x)")
    return f"if(size({words}) < 4, 0L, {let_sql(maybe, 'c', f'if(size(c) = 0, 0L, {covered})')})"


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts_sql(text: str, words: str, lines: str) -> dict[str, str]:
    """SQL of each count that rules may name, over a text, its words and its lines."""
    return {
        "n_words": f"cast(size({words}) as bigint)", "word_chars": f"cast(length(array_join({words}, '')) as bigint)", "n_symbols": count_of_sql(text, SYMBOLS),
        "n_dup_lines": dup_lines_sql(lines), "n_repeat_words": repeat_words_sql(words), "n_digits": count_of_sql(text, "0123456789"),
    }


def base_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df plus the counts of BASE (long). A null text has none of anything. Same-named columns are replaced."""
    return _counted(df, text_col).drop("__text")


def _counted(df: DataFrame, text_col: str) -> DataFrame:
    """base_counts plus `__text`. All counts are fields of one expression over words and lines that are cut once; wherever
    the optimizer moves it, it stays linear in the text."""
    kept = without(df.withColumn("__text", F.col(f"`{text_col}`")), list(BASE))
    sql = counts_sql("__text", "ws", "ls")
    fields = ", ".join(f"'{n}', {sql[n]}" for n in BASE)
    both = let_sql(words_sql("__text"), "ws", let_sql(lines_sql("__text"), "ls", f"named_struct({fields})"))
    return kept.withColumn("__c", F.expr(both)).withColumns({n: F.col(f"__c.{n}") for n in BASE}).drop("__c")


@dataclass(frozen=True)
class Rule:
    """A name and SQL, true where a document is rejected (null counts as false).

    The SQL may name {text}, {words} (its words), {lines} (its lines with a word) and the counts of counts_sql.
    """

    name: str
    rejects: str

    def needs(self) -> set[str]:
        return set(re.findall(r"\{(\w+)\}", self.rejects))


#: The rules of the base verdict. A text of 50 words has 99 characters at least, so the first rejects nothing the second keeps.
BASE_RULES = [
    Rule("few_characters", "coalesce(length({text}), 0) < 99"),
    Rule("few_words", "{n_words} < 50"),
    Rule("repeated_words", "100 * {n_repeat_words} > 50 * {n_words}"),
]
MORE_RULES = [
    Rule("symbols", "5 * {n_symbols} > {n_words}"),
    Rule("word_length", "{word_chars} < 2 * {n_words} or {word_chars} > 20 * {n_words}"),
    Rule("duplicate_lines", "5 * {n_dup_lines} > {n_words}"),
    Rule("digits", "2 * {n_digits} > {word_chars}"),
    Rule("long_word", "exists({words}, w -> length(w) > 1000)"),
    Rule("bullet_lines", "size({lines}) >= 5 and 10 * size(filter({lines}, l -> substr(ltrim(l), 1, 1) in ('-', '*', '•'))) > 9 * size({lines})"),
    Rule("cut_lines", "size({lines}) >= 5 and 10 * size(filter({lines}, l -> endswith(rtrim(l), '...') or endswith(rtrim(l), '…'))) > 3 * size({lines})"),
]
RULES = [*BASE_RULES, *MORE_RULES]


def cascade_sql(rules: list[Rule], text: str, have: dict[str, str] | None = None) -> str:
    """SQL, true where no rule rejects: rules are tried in order, and what they need is worked out when first needed.

    have: SQL of what is at hand already, such as columns of counts.
    """
    have = {"text": text, **(have or {})}
    if not rules:
        return "true"
    first, rest = rules[0], rules[1:]
    own = counts_sql(have["text"], have.get("words", "ws"), have.get("lines", "ls"))
    counts = {n: own[n] for n in first.needs() if n in own and n not in have}
    used = first.needs() | {k for k, cut in (("words", "ws"), ("lines", "ls")) for c in counts.values() if re.search(rf"\b{cut}\b", c)}
    for name, var, cut in (("words", "ws", words_sql), ("lines", "ls", lines_sql)):
        if name in used and name not in have:
            return let_sql(cut(text), var, cascade_sql(rules, text, {**have, name: var}))
    rejects = first.rejects.format(**{**have, **{n: f"({c})" for n, c in counts.items()}})
    return f"case when {rejects} then false else {cascade_sql(rest, text, have)} end"


#: Rows of the sample on which rules are rated.
SAMPLE_ROWS = 1000


def sample_of(df: DataFrame, text_col: str) -> DataFrame:
    """About SAMPLE_ROWS whole texts (`text`), each row with the same chance; at most twice as many, and on the executors.

    Only the order of rules hangs on it.
    """
    total = df.count()
    text = df.select(F.col(f"`{text_col}`").alias("text"))
    if total > SAMPLE_ROWS:
        text = text.where(F.rand(11) < SAMPLE_ROWS / total).limit(2 * SAMPLE_ROWS)
    return text.coalesce(1)


def order_rules(sample: DataFrame, rules: list[Rule], text: str = "text", have: dict[str, str] | None = None) -> list[Rule]:
    """The rules by rejection per cost, both estimated on the sample.

    Each rule is evaluated by itself over the stored sample, once to warm up and once timed, so order may differ
    from run to run; verdicts don't.
    """
    sample = sample.cache()
    try:
        total = sample.count()
        if not total:
            return list(rules)
        base = _timed(sample, "true")[1]
        rated = []
        for i, r in enumerate(rules):
            kept, seconds = _timed(sample, cascade_sql([r], text, have))
            rated.append((-((total - kept) / total) / max(seconds - base, 1e-3), seconds, i, r))
        return [r for *_, r in sorted(rated, key=lambda x: x[:3])]
    finally:
        sample.unpersist()


def _timed(sample: DataFrame, condition: str) -> tuple[int, float]:
    hits = sample.select(F.expr(f"coalesce(sum(if({condition}, 1, 0)), 0)").alias("n"))
    best = float("inf")
    for _ in range(2):
        t = time.perf_counter()
        n = hits.first()[0]
        best = min(best, time.perf_counter() - t)
    return int(n), best


def judge(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df plus the base counts, `base_failed` and `kept`.

    All base counts are asked for, so they are worked out for every row; the other rules are a cascade over the
    rows that the base keeps, rated on a sample of such rows. Null, empty and short texts fail. Very long texts
    are judged whole, up to 2 ** 28 words. Rows and repeats stay; input columns named like the new ones are
    replaced. An empty table gives an empty table.
    """
    failed = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
    have = {n: n for n in BASE}
    counted = _counted(without(df, ["base_failed", "kept"]) if text_col.lower() not in ("base_failed", "kept") else df, text_col)
    sample = _counted(sample_of(df, text_col), "text").cache()
    rules = order_rules(sample.where(f"not ({failed})"), MORE_RULES, "__text", have)
    sample.unpersist()
    return counted.withColumn("base_failed", F.expr(failed)).withColumn(
        "kept", F.expr(f"case when base_failed then false else {cascade_sql(rules, '__text', have)} end")).drop("__text")


def keep(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df that pass every rule, with df's columns; the cascade works out nothing it doesn't need.

    Null, empty and short texts go; repeated rows stay or go alike. An empty table gives an empty table.
    """
    rules = order_rules(sample_of(df, text_col), RULES)
    return df.where(F.expr(cascade_sql(rules, f"`{text_col}`")))
