"""The text operators against brute force, exact round trips and held-out accuracy, with odd inputs."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import (
    chain_crf, decontaminate, jaccard_join, language_id, line_quality, packing, piece_sampling, quality_rules, queries, substring_dedup, token_counts, url_filter,
)
from gridloom.llm.common import word_hashes, words
from gridloom.llm.components import components

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score string, `n_words` string, Text2 string"
ODD = [None, "", "   \n\t ", "a", "one two three four", "日本語 テキスト ▁ 🎉", "x" * 5000, "\n\n\nend\n", "no\x0bbreak\x1cword"]


def frame(spark, texts):
    return spark.createDataFrame([(i if i % 7 else None, t, "s", "n", t) for i, t in enumerate(texts)], SCHEMA)


def sample_texts():
    return pq.read_table(f"{DATA}/documents.parquet", columns=["text"]).column("text").to_pylist()


def mixed(seed=0, n=60):
    """Short texts over few words, with copies, shared passages and repeated rows."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    out = []
    for _ in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 150))]
        if rng.random() < 0.4:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 20) : rng.randint(30, 60)]
        out.append(" ".join(w))
    base = [rng.choice(vocab) for _ in range(120)]
    for _ in range(20):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    return out + [out[0], out[-1], out[-1]] + ODD


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    score, start, trans = rng.normal(size=(7, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    first = np.array([True, False, False, True, False, False, False])
    got = chain_crf.marginals(score, first, start, trans)[0]
    import itertools

    for a, b in ((0, 3), (3, 7)):
        want, total = np.zeros((b - a, 3)), 0.0
        for y in itertools.product(range(3), repeat=b - a):
            w = np.exp(start[y[0]] + sum(score[a + i, k] for i, k in enumerate(y)) + sum(trans[p, q] for p, q in zip(y, y[1:])))
            total += w
            for i, k in enumerate(y):
                want[i, k] += w
        assert np.allclose(got[a:b], want / total)


def test_quality_is_learned(spark):
    d = "/root/testdata/sf0.01"
    docs = pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"]).to_pandas().merge(pq.read_table(f"{d}/labels.parquet").to_pandas(), on="doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in docs.doc_id])
    m = line_quality.fit(docs.text[~held].tolist(), docs.quality[~held].tolist())
    assert ((m.scores(docs.text[held].tolist()) >= 0.5) == docs.quality[held]).mean() > 0.95
    got = line_quality.score(frame(spark, ODD), m).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert line_quality.score(frame(spark, ODD).limit(0), m).count() == 0
    assert line_quality.fit([], []).scores([None]).tolist() == [0.5]


def test_language_is_learned(spark):
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text", "lang"]).to_pandas().dropna()
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in docs.doc_id])
    train = docs[~held & (docs.text.str.len() < 3000)][:300]
    m = language_id.fit(train.text.tolist(), train.lang.tolist(), steps=4)
    assert (np.array(m.predict(docs.text[held].tolist())[0]) == docs.lang[held]).mean() > 0.97
    got = {r.Text2: r for r in language_id.identify(frame(spark, [*ODD, "123 !"]), m).collect()}
    assert {got[t].lang_pred for t in (None, "", "123 !")} == {"und"} and got[None].score == 0
    assert language_id.fit([], []).predict(["x"])[0] == ["und"]


@pytest.mark.parametrize("same_id", [False, True])
def test_language_sample_is_the_lowest_hashes_of_usable_rows(spark, same_id, monkeypatch):
    made = [(7 if same_id else i, f"text {i}", "en" if i % 50 == 0 or same_id else None) for i in range(2000)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "fit", lambda texts, labels: (texts, labels))
    hashed = docs.where("lang is not null").select("text", F.xxhash64("doc_id").alias("h")).collect()
    want = [r.text for r in sorted(hashed, key=lambda r: (r.h, r.text))[:20]]
    assert language_id.fit_from(docs, docs_most=20) == (want, ["en"] * 20)
    many = spark.range(2000).selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang")
    low = [r.text for r in many.orderBy(F.xxhash64("doc_id")).limit(20).collect()]
    assert language_id.fit_from(many, docs_most=20)[0] == low


def test_words_are_cut_and_hashed_as_bytes_split_them():
    texts = [t for t in [*ODD, *sample_texts()[:20], "a" * 600 + " " + "a" * 601 + " " + "a" * 600, " a\x0bb\x1cc  d\n"] if t]
    seen = {}
    for t in texts:
        ws = words(t)
        for kind in (0, 1):
            h = word_hashes(t.encode(), kind).tolist()
            assert len(h) == len(ws)
            for w, x in zip(ws, h):
                assert seen.setdefault((kind, w), x) == x
    assert len(set(seen.values())) == len(seen)


def brute_dedup(texts, window):
    ws = [words(t) for t in texts]
    n = collections.Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for w in ws:
        gone = {p for i in range(len(w) - window + 1) if n[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return collections.Counter(out)


@pytest.mark.parametrize("window", [5, 20, 35])
def test_repeated_windows_go(spark, window, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", (2000, 2000))
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 500)
    texts = mixed(window)
    got = substring_dedup.remove_repeats(frame(spark, texts), window=window)
    assert "Text2" in got.columns and got.columns.count("n_words") == 1
    assert collections.Counter((r.n_words, r.n_removed, r.kept_text) for r in got.collect()) == brute_dedup(texts, window)


def test_equal_short_hashes_are_told_apart_at_the_end(spark, monkeypatch):
    """With one hash value for every word at the first hash, only the second tells windows apart."""
    real = substring_dedup.hashed_words
    monkeypatch.setattr(substring_dedup, "hashed_words", lambda raw, kind=0: (np.ones(len(raw.split()), np.uint64), real(raw)[1]))
    texts = [" ".join(f"{c}{i}" for i in range(50)) for c in "ab"] + ["z " + " ".join(f"a{i}" for i in range(40))]
    block = substring_dedup._Block(texts, 35)
    alive, n = np.unique(block.full(block.starts), axis=0, return_counts=True)
    alive = alive[n > 1]
    assert [int(x.sum()) for x in block.covered(alive[substring_dedup._order(alive)])] == [40, 0, 40]


def test_dedup_of_nothing(spark):
    assert substring_dedup.remove_repeats(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 200_000])
def test_contamination_equals_brute_force(spark, most):
    texts = mixed(3)
    items = [(str(i), t) for i, t in enumerate([" ".join(texts[0].split()[5:30]).upper(), "W1, w2", texts[70], None, "..", " ".join(texts[1].split()[:10])])]
    table = spark.createDataFrame(items, "item_id string, text string")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    import re

    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    want = collections.Counter()
    for t in texts:
        w, hit, ids = cut(t), set(), []
        for i, it in items:
            iw = cut(it)
            n = min(len(iw), 10)
            grams = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
            at = [k for k in range(len(w) - n + 1) if n and tuple(w[k : k + n]) in grams]
            hit |= {p for k in at for p in range(k, k + n)}
            ids += [i] if at else []
        want[(t, len(w), len(hit), tuple(sorted(ids)), bool(hit))] += 1
    got = decontaminate.find_contamination(frame(spark, texts), table, broadcast_windows=most)
    assert collections.Counter((r.Text2, int(r.n_words), r.n_hit, tuple(r["items"]), r.contaminated) for r in got.collect()) == want
    assert decontaminate.find_contamination(frame(spark, texts), table.limit(0)).where("contaminated").count() == 0
    assert decontaminate.keep_clean(frame(spark, texts), table).count() == sum(n for k, n in want.items() if not k[-1])


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_sampled_pieces_decode_exactly(spark):
    texts = [*ODD, *sample_texts()[:60], " lead", "tail  ", "a  b\n c"]
    one = piece_sampling.encode(frame(spark, texts), MODEL)
    got = piece_sampling.decode(one, MODEL).collect()
    assert all(r.decoded == r.Text2 for r in got)
    assert piece_sampling.encode(frame(spark, texts), MODEL, check=True).where("not lossless").count() == 0
    again = piece_sampling.encode(frame(spark, texts).repartition(7), MODEL).collect()
    key = lambda r: (str(r.doc_id), r.Text2 or "")
    assert sorted((key(r), r.piece_ids) for r in got if r.doc_id) == sorted((key(r), r.piece_ids) for r in again if r.doc_id)
    other = piece_sampling.encode(frame(spark, texts), MODEL, seed=1).collect()
    assert [r.piece_ids for r in other] != [r.piece_ids for r in got]
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    plain = next(r for r in got if r.Text2 == "one two three four")
    assert "".join(sp.id_to_piece(i) for i in plain.piece_ids) == "▁one▁two▁three▁four"


def test_draws_follow_path_weights():
    s = piece_sampling.PieceSampler(MODEL, 1.0)

    def paths(u):
        if not u:
            yield (), 1.0
        for k in range(1, len(u) + 1):
            if (h := s.weight.get(u[:k])) is not None:
                for p, w in paths(u[k:]):
                    yield (h[0], *p), w * h[1]

    want = dict(paths(" there"))
    n = 20_000
    got = collections.Counter(tuple(g.tolist()) for g in s.sample(["there"] * n, np.arange(n), 7))
    assert set(got) <= set(want) and max(abs(got[k] / n - w / sum(want.values())) for k, w in want.items()) < 0.02


def test_draws_stay_in_their_position(monkeypatch):
    texts = [*ODD, *sample_texts()[:40], "ab" * 3000, "文字" * 2000 + " tail"]
    keys = np.arange(len(texts))
    full = piece_sampling.PieceSampler(MODEL, 1.0)
    rng = random.Random(1)
    while len(full.edge) < full.NODES * 0.9:
        full.sample(["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) + str(i) for i in range(60_000)], np.arange(60_000), 0)
    fresh = piece_sampling.PieceSampler(MODEL, 1.0)
    for edge in (0, 1, 0xFFFFFFFE, 0xFFFFFFFF):
        with monkeypatch.context() as m:
            m.setattr(piece_sampling, "draws", lambda seed, key, part, step, edge=edge: np.full(len(key), edge, np.uint32))
            for s in (full, fresh):
                assert s.decode_all(s.sample(texts, keys, 0)) == texts
    want = full.sample(texts, keys, 5)
    alone = [fresh.sample([t], keys[i : i + 1], 5)[0] for i, t in enumerate(texts)]
    fresh.reset()
    fresh.LEARN, fresh.BLOCK = 64, 100
    again = fresh.sample(texts, keys, 5)
    same = lambda a, b: (a is None and b is None) or a.tolist() == b.tolist()
    assert all(map(same, want, alone)) and all(map(same, want, again))


def test_pieces_of_very_long_texts():
    s = piece_sampling.PieceSampler(MODEL, 1.0)
    texts = ["no spaces at all".replace(" ", "") * 20_000, "word " * 200_000, "語" * 100_000, "a" * 300_000, " " * 100_000]
    assert s.decode_all(s.sample(texts, np.arange(len(texts)), 0)) == texts


def test_url_rules():
    trie = url_filter.RuleTrie(queries.URL_RULES)
    judge = lambda u: trie.judge(u)[2:]
    assert judge("http://a.b.example.com/en/x?y") == ("example.com/en/", "block")
    assert judge("http://x.www.EXAMPLE.com/en/") == ("www.example.com/en/", "allow")
    assert judge("http://example.com/en") == ("com/", "allow") and judge("https://n.net/es/") == ("net/es/", "block")
    assert judge("http://com") == (None, "allow") and judge("http://notcom/") == (None, "allow")
    assert trie.judge(None) == ("", "", None, "allow") and trie.judge("no scheme/") == ("", "", None, "allow")
    t = url_filter.RuleTrie([url_filter.Rule("block", "a", "/x/y"), url_filter.Rule("allow", "a", "/x/"), url_filter.Rule("block", "a", "/x")], "block")
    assert [t.judge(f"s://a{p}")[2] for p in ("/x/yz/q", "/x/z", "/xyz", "/")] == ["a/x/y", "a/x/", "a/x", None]
    with pytest.raises(ValueError):
        url_filter.RuleTrie([url_filter.Rule("maybe", "a")])


def test_url_table(spark):
    df = spark.createDataFrame([(1, "http://a.net/fr/", "clash"), (1, "http://a.net/fr/", "clash"), (None, None, "x")], "page_id long, url string, host string")
    got = url_filter.filter_urls(df, queries.URL_RULES)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted(r.verdict for r in got.collect()) == ["allow", "block", "block"]
    assert url_filter.kept_urls(df, queries.URL_RULES).count() == 1
    assert url_filter.filter_urls(df.limit(0), queries.URL_RULES).count() == 0


def test_best_fit_decreasing_equals_plain_search():
    rng = random.Random(2)
    for cap in (1, 7, 64, 100):
        sizes = [rng.randint(1, cap) for _ in range(300)]
        free, want = [], []
        for i in sorted(range(300), key=lambda i: -sizes[i]):
            fits = [b for b in range(len(free)) if free[b] >= sizes[i]]
            if fits:
                b = min(fits, key=lambda b: free[b])
                free[b] -= sizes[i]
            else:
                free.append(cap - sizes[i])
            want.append(sorted(free))
        bins = packing.best_fit_decreasing(sizes, cap)
        assert sorted(cap - sum(sizes[i] for i in b) for b in bins) == sorted(free)
        assert sorted(i for b in bins for i in b) == list(range(300))


def test_packed_documents_come_back(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_TOKENS", 5000)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = [*ODD, *sample_texts()[:40], sample_texts()[0]]
    packed = packing.pack(frame(spark, texts), path, capacity=128)
    for r in packed.collect():
        pos = np.frombuffer(r.position_ids, np.uint32)
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 128 and len(r.input_ids) == 256
        assert all(pos[a:b].tolist() == list(range(b - a)) for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]))
    enc, got = packing.encoder(path), collections.defaultdict(dict)
    for r in packing.unpack(packed).collect():
        got[(r.row, r.parts)][r.part] = r.ids
    back = collections.Counter(enc.decode(np.concatenate([p[k] for k in range(n)])) for (_, n), p in got.items() if len(p) == n)
    assert back == collections.Counter(t for t in texts if t)
    assert packing.pack(frame(spark, texts).limit(0), path).count() == 0


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "hello", "wörld", "'re", "123", "!!", "aaaaaa", "<|endoftext|>", "\u00a0", "\x85", "日本", "\x1c"]
    texts = [*[t for t in ODD if t], *["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)], *sample_texts()]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.MergeCounter(path).counts(texts) == want
    got = {r.Text2: r for r in token_counts.count_tokens(frame(spark, ODD), path, limit=3).collect()}
    assert got[None].n_tokens == 0 and got[None].n_bytes == 0 and got["x" * 5000].over_limit


def brute_rules(t):
    """(base counts, base_failed, kept) of a text."""
    t = t or ""
    w = [x.decode() for x in words(t)]
    n = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {p for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for p in range(i, i + 3)}
    lines = [x for x in t.split("\n") if x.encode().strip(b" \t\n\x0b\x0c\r")]
    counts = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
    failed = counts[0] < 50 or 2 * counts[4] > counts[0]
    bullets, cut = sum(x.lstrip(" ")[:1] in ("-", "*", "•") for x in lines), sum(x.rstrip(" ").endswith(("...", "…")) for x in lines)
    more = (5 * counts[2] > counts[0], not 2 * counts[0] <= counts[1] <= 20 * counts[0], 5 * counts[3] > counts[0], 2 * sum(c in "0123456789" for c in t) > counts[1],
            any(len(x) > 1000 for x in w), len(lines) >= 5 and 10 * bullets > 9 * len(lines), len(lines) >= 5 and 10 * cut > 3 * len(lines))
    return counts, failed, not failed and not any(more)


def ruled_texts():
    words_ = [f"word{i}" for i in range(200)]
    plain = " ".join(words_)
    by_line = lambda mark, end, n: "\n".join((mark if i < n else "") + f"line {i} is here now" + (end if i < n else "") for i in range(20))
    return [plain, plain + " " + "y" * 1001, plain + " " + "y" * 1000, " ".join(f"{i}{i * i}" for i in range(100, 300)), " ".join(f"a{i}b" for i in range(10, 90)),
            by_line("- ", "", 20), by_line("- ", "", 18), by_line(" • ", "", 19), by_line("", "...", 6), by_line("", "… ", 7), by_line("* ", "", 4)]


def test_rules_and_their_cascade(spark):
    texts = [*mixed(5), *sample_texts()[:80], "a b c a b c\n" * 30, "q q q q", "aa bb cc dd aa bb cc", "### $$$ " * 60, *ruled_texts()]
    got = quality_rules.judge(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        counts, failed, kept = brute_rules(r.Text2)
        assert (int(r.n_words), r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts, repr(r.Text2[:80])
        assert (r.base_failed, r.kept) == (failed, kept), repr(r.Text2[:80])
    kept = collections.Counter(r.Text2 for r in got if r.kept)
    assert collections.Counter(r.Text2 for r in quality_rules.keep(frame(spark, texts)).collect()) == kept and len(kept) > 20
    for order in (quality_rules.RULES, quality_rules.RULES[::-1]):
        assert frame(spark, texts).where(F.expr(quality_rules.cascade_sql(order, "text"))).count() == sum(kept.values())
    assert quality_rules.judge(frame(spark, texts).limit(0)).count() == 0 == quality_rules.keep(frame(spark, texts).limit(0)).count()


def test_later_rules_are_not_evaluated(spark):
    df = spark.createDataFrame([("a b",)], "text string")
    boom = quality_rules.Rule("boom", "raise_error('evaluated') is not null and {n_repeat_words} > 0 and size({lines}) > 0")
    assert df.where(F.expr(quality_rules.cascade_sql([quality_rules.BASE_RULES[1], boom], "text"))).count() == 0
    with pytest.raises(Exception, match="evaluated"):
        df.where(F.expr(quality_rules.cascade_sql([boom, quality_rules.BASE_RULES[1]], "text"))).count()
    sql = quality_rules.cascade_sql(quality_rules.RULES, "text")
    assert sql.count("[ ") == 1 and sql.count("btrim") == 1  # words and lines are cut in one place


def test_rules_go_by_rejection_per_cost(spark):
    df = spark.createDataFrame([(f"w{i} " * 5,) for i in range(300)], "text string")
    slow = quality_rules.Rule("slow", "{n_repeat_words} > 0 and size(array_distinct(transform(sequence(1, 20000), i -> i + {n_words}))) > 0")
    order = quality_rules.order_rules(df, [quality_rules.Rule("never", "{n_words} < 0"), slow, quality_rules.Rule("cheap", "{n_words} < 50")])
    assert [r.name for r in order] == ["cheap", "slow", "never"]


def test_clashing_names_in_rules(spark):
    df = spark.createDataFrame([("x " * 60, "mine", True, 7)], "Text string, kept string, base_failed boolean, n_words int")
    assert quality_rules.keep(df, "Text").columns == df.columns
    got = quality_rules.judge(df, "Text")
    assert got.columns == ["Text", *quality_rules.BASE, "base_failed", "kept"] and got.first().n_words == 60


def test_lines_of_form_feeds_hold_no_word_and_lines_of_f_do(spark):
    texts = ["f\nf\n f \nf", "\x0c\n\x0c\n \x0c\n\x0c", "a\x0c\na\x0c\n\x0b\n\x0b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert [r.n_dup_lines for r in quality_rules.base_counts(df).orderBy("i").collect()] == [2, 0, 1]


def test_judge_rates_rules_on_what_the_base_keeps(spark, monkeypatch):
    rated = []

    def order(sample, rules, text, have):
        rated.append((sample.count(), rules))
        return rules[::-1]

    monkeypatch.setattr(quality_rules, "order_rules", order)
    df = spark.createDataFrame([("a b",), (" ".join(f"word{i}" for i in range(80)),)], "text string")
    assert sorted(r.kept for r in quality_rules.judge(df).collect()) == [False, True]
    assert rated == [(1, quality_rules.MORE_RULES)]


def brute_join(texts, threshold=0.8):
    sets = [set(jaccard_join.shingles(t).tolist()) for t in texts]
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, find(i), links[i]) for i in range(len(texts))]


@pytest.mark.parametrize("block", [3, 1024])
def test_join_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", block)
    monkeypatch.setattr(jaccard_join, "TEXT_BLOCK", block)
    texts = mixed(9)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, class_id string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.join(df).collect())
    assert got == brute_join(texts)


def test_one_of_each_class_stays(spark):
    texts = mixed(9)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, class_id string")
    kept = jaccard_join.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c, _ in brute_join(texts) if i == c)
    assert jaccard_join.join(df.limit(0)).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    need = jaccard_join.least_matches(0.8, 1e-7)
    assert list(need) == sorted(need) and need[-1] < 0.8 * jaccard_join.VALUES
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**16, (1, jaccard_join.VALUES)).astype(np.uint16)
    b = np.where(rng.random((400, jaccard_join.VALUES)) < 0.8, a, a + np.uint16(1))
    assert len(jaccard_join.likely_pairs(a, b, 0.8, 1e-7)[0]) == 400


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (500, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_kept_text_hash_is_that_of_its_words(spark):
    r = substring_dedup.remove_repeats(frame(spark, ["a  b\tc"])).select(F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("h")).first()
    assert r.h == hashlib.sha256(b"a b c").hexdigest()


@pytest.fixture(scope="module")
def models():
    texts = [t for t in sample_texts() if t][:60]
    quality = line_quality.fit(texts, [i % 2 for i in range(len(texts))], steps=5)
    return quality, language_id.fit(texts, [("en", "de")[i % 2] for i in range(len(texts))], steps=3)


ITEMS = [("1", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), ("2", "short item"), (None, None)]


def operators(spark, models):
    """Each of the ten as a function of a table with `doc_id` and `text`, and the columns it adds or, in place of all, returns."""
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    piece, bpe = MODEL, public_tokenizers.path("byte_bpe_50k.json")
    return {
        "quality": (lambda d: line_quality.score(d, models[0]), ["score", "predicted"]),
        "dedup": (substring_dedup.remove_repeats, ["n_words", "n_removed", "kept_text"]),
        "language": (lambda d: language_id.identify(d, models[1]), ["lang_pred", "score"]),
        "words": (lambda d: language_id.tag_words(d, models[1]), ["word_langs"]),
        "contamination": (lambda d: decontaminate.find_contamination(d, items), ["n_words", "n_hit", "items", "contaminated"]),
        "pieces": (lambda d: piece_sampling.encode(d, piece, check=True), ["piece_ids", "lossless"]),
        "urls": (lambda d: url_filter.filter_urls(d, queries.URL_RULES, "text"), ["host", "path", "rule", "verdict"]),
        "packing": (lambda d: packing.pack(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=256), None),
        "tokens": (lambda d: token_counts.count_tokens(d, bpe), ["n_bytes", "n_tokens", "over_limit"]),
        "rules": (quality_rules.judge, [*quality_rules.BASE, "base_failed", "kept"]),
        "jaccard": (jaccard_join.join, None),
    }


NAMES = ["quality", "dedup", "language", "words", "contamination", "pieces", "urls", "packing", "tokens", "rules", "jaccard"]
#: Further columns: one of every name an operator adds, with other letters' case for some, and internal-looking ones.
CLASH = ["Score", "predicted", "n_words", "n_removed", "kept_text", "lang_pred", "n_hit", "items", "contaminated", "piece_ids", "lossless", "host", "path", "Rule", "verdict",
         "n_bytes", "n_tokens", "over_limit", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_id", "n_links", "word_langs", "decoded", "own"]


def clashing(spark, texts):
    fields = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(i if i % 7 else None, t, *["mine"] * len(CLASH)) for i, t in enumerate(texts)], fields)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_and_clashing_names(spark, models, name):
    run, new = operators(spark, models)[name]
    assert run(clashing(spark, []).limit(0)).count() == 0
    texts = [*ODD, *ODD, None, "http://a.example.com/en/x", ITEMS[0][1]]
    got = run(clashing(spark, texts))
    rows = got.collect()
    if name == "packing":
        assert sum(r.n_segments for r in rows) >= sum(bool(t) for t in texts)
        return
    assert len(rows) == len(texts)
    if name == "jaccard":
        assert got.columns == ["doc_id", "class_id", "n_links"]
        return
    low = [c.lower() for c in new]
    assert sorted(got.columns) == sorted([*[c for c in ["doc_id", "text", *CLASH] if c.lower() not in low], *new])
    assert collections.Counter(r.text for r in rows) == collections.Counter(texts) and all(r.own == "mine" for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_very_long_texts(spark, models, name):
    run, new = operators(spark, models)[name]
    words_ = " ".join(f"w{i % 5000}x{i % 7}" for i in range(200_000))
    texts = [words_, "\n" * 200_000, "y" * 300_000, "short", "ab \n" * 50_000, "语言" * 50_000]
    rows = run(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    if name == "packing":
        assert sum(r.n_tokens for r in rows) == sum(len(packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")).encode(t)) for t in texts)
        return
    assert len(rows) == len(texts)
    by = {r.doc_id: r for r in rows}
    if name == "pieces":
        assert all(r.lossless for r in rows)
    if name == "dedup":
        assert [by[i].n_words for i in range(6)] == [200_000, 0, 1, 1, 50_000, 1] and by[4].n_removed == 50_000
    if name == "rules":
        assert [by[i].n_words for i in range(6)] == [200_000, 0, 1, 1, 50_000, 1] and by[4].n_dup_lines == 49_999
    if name == "tokens":
        lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        assert [by[i].n_tokens for i in (1, 3, 4)] == [len(lib.encode(texts[i], add_special_tokens=False).ids) for i in (1, 3, 4)]
    if name == "jaccard":
        assert all(r.n_links == 0 for r in rows)


def test_a_million_lines_are_scored_in_blocks(models):
    import tracemalloc

    text = "a line of text\n" * 1_000_000
    tracemalloc.start()
    got = models[0].scores([text])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 <= got[0] <= 1 and most < 800e6


def test_many_rules_of_one_host():
    import time

    rules = [url_filter.Rule("block", "h", f"/p{i:06d}") for i in range(100_000)] + [url_filter.Rule("allow", "h", "/p000001")]
    trie = url_filter.RuleTrie(rules)
    t = time.perf_counter()
    assert [trie.judge(f"x://h/p{i:06d}/more")[2] for i in range(2000)] == [f"h/p{i:06d}" for i in range(2000)]
    assert trie.judge("x://h/p000001")[3] == "block" and trie.judge("x://h/q")[2:] == (None, "allow")  # the first of equal rules
    assert time.perf_counter() - t < 2


def test_kept_urls_keep_own_columns(spark):
    df = spark.createDataFrame([("http://a.com/", "MINE", "R", "V"), ("http://a.net/fr/", "x", "y", "z")], "url string, host string, rule string, verdict string")
    got = url_filter.kept_urls(df, queries.URL_RULES)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [("http://a.com/", "MINE", "R", "V")]


def test_words_of_switched_texts_get_their_languages():
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text", "lang"]).to_pandas().dropna()
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in docs.doc_id])
    train = docs[~held & (docs.text.str.len() < 3000)][:400]
    m = language_id.fit(train.text.tolist(), train.lang.tolist())
    found = [(language_id.LETTERS.findall(t), m.langs.index(lab)) for t, lab in zip(docs.text[held], docs.lang[held]) if language_id.LETTERS.findall(t)]
    hit = total = 0
    for ws, labels in language_id.switched(found, 100):
        for (_, lang), lab in zip(m.tag([" ".join(ws)])[0], labels):
            hit, total = hit + (lang == m.langs[lab]), total + 1
    assert total > 1000 and hit / total > 0.9


def test_remembered_words_give_the_same_potentials():
    m = language_id.fit(["one two three", "eins zwei drei"], ["en", "de"], steps=2)
    m.CACHED = 3
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(a, a + 9)) for a in range(0, 200, 5)]
    want = [m.predict([t])[1][0] for t in texts]
    fresh = language_id.LanguageModel(m.langs, m.weights, m.start, m.trans)
    assert np.allclose(want, fresh.predict(texts)[1])


def test_cached_chunks_are_short():
    c = token_counts.MergeCounter(public_tokenizers.path("byte_bpe_50k.json"))
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["two  spaces " + "and words " * 200, "q" * 5000, "a\u00a0 b \u2003c d", "x \n y", " \x1c a \x1c"]
    assert c.counts(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    assert max(map(len, c.cache)) <= c.SHORT and len(c.cache) < 40


def test_hot_sets_come_back_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_ROWS", 3)
    texts = mixed(2) + ["one two three four five six seven"] * 9
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.join(df).collect()) == brute_join(texts)


def test_joins_keep_null_ids(spark):
    one = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, one, "a"), (5, one, "b"), (3, one + " w60", "c"), (None, "alone in here", "d"), (None, None, "e"), (None, None, "f")], "doc_id long, text string, Class_id string")
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jaccard_join.join(df).collect())
    assert got == sorted([("None", "3", 2), ("5", "3", 2), ("3", "3", 2), ("None", "None", 0), ("None", "None", 0), ("None", "None", 0)])
    assert sorted(r.Class_id for r in jaccard_join.keep_first(df).collect()) == ["c", "d", "e", "f"]


def test_scratch_is_deleted(spark):
    from gridloom.llm.common import SCRATCH, drop_scratch, stored

    mark = len(SCRATCH)
    df = spark.createDataFrame(list(enumerate(mixed(4))), "doc_id long, text string")
    out = stored(substring_dedup.remove_repeats(df), "kept")
    drop_scratch(since=mark, but=(out,))
    assert [kind for _, kind, _ in SCRATCH[mark:]] == ["path"] and out.count() == df.count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("gridloom_batches")]


def test_sampling_many_distinct_words_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    texts = [" ".join("".join(chr(97 + c) for c in w) for w in rng.integers(0, 26, (20_000, 9))) for _ in range(12)]
    s = piece_sampling.PieceSampler(MODEL, 1.0)
    tracemalloc.start()
    for k, t in enumerate(texts):
        s.sample([t], np.array([k]), 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
