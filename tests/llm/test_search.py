"""URL rules, ranked search and collocations on small tables, against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stellwerk.llm import best_position, collocations, url_rules

PAGES = "page_id bigint, url string, id string, mark int, rank int, token string, tokens string, host int"


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "x", 1, 2, "t", "t", 3) for i, u in enumerate(urls)], PAGES)


def plain_verdict(url, places, patterns):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = []
    for action, text in places:
        h, _, p = text.partition("/")
        if (host == h or host.endswith(f".{h}")) and path.startswith(f"/{p}"):
            fits.append((len(text), len(h), action, text))
    if fits:
        *_, action, text = max(fits)
        return host, path, text, action
    hits = {action for action, p in patterns if host + path and re.search(url_rules.regex_of(p), host + path)}
    return host, path, None, "block" if hits == {"block"} else "allow"


URLS = [
    "https://a.example.org/es/1", "https://example.org/en/1570", "http://Example.ORG/en/2", "https://x.com/de/", "https://x.com/de",
    "https://x.com/fr/a?b#c", "https://x.com/FR/a", "https://notorg/", "https://org", "https://org/", "org/es/", None, "", "://", "://org/",
    "https://org?x.org/", "https://m.casino-win.example.com/en/1", "https://casinowin.example.com/", "http://a.com/responsible-gaming?casino",
    "http://casino.net/responsible-gaming", "http://casino.org/x", "http://casino.org:80/x", "https://x.net/payday/quick-loans",
    "https://x.net/loan/payday", "https://ads.y.net/", "https://bads.y.net/", "ftp://a.b://c.org/", "https://y.net/" + "a-" * 50_000 + "casino",
    "https://é.org/ü", "https://x.net/a\nb/casino", "https://y.net/wp-login.php", "https://y.net/wp-login.phpx",
]


def test_verdicts_against_plain_rules(spark):
    got = {r.page_id: r for r in url_rules.judge(pages_of(spark, URLS)).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        want = plain_verdict(url, url_rules.PLACES, url_rules.PATTERNS)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == want, url
    by_url = {u: got[i].verdict for i, u in enumerate(URLS)}
    assert by_url["https://m.casino-win.example.com/en/1"] == "block" and by_url["https://casinowin.example.com/"] == "allow"
    assert by_url["http://casino.net/responsible-gaming"] == "allow" and by_url["http://casino.org/x"] == "allow"


def test_tokens_bound_every_match():
    assert url_rules.bounded_tokens("||example.org/en/1") == ("en", "example", "org")
    assert url_rules.bounded_tokens("casino") == () and url_rules.bounded_tokens("^ca*no^") == ()
    for _, pattern in [*url_rules.PATTERNS, *((a, f"||{p}") for a, p in url_rules.PLACES)]:
        regex = re.compile(url_rules.regex_of(pattern))
        for url in filter(None, URLS):
            address = url.partition("://")[2]
            if regex.search(address):
                assert set(url_rules.bounded_tokens(pattern)) <= set(re.split("[^a-z0-9]+", address.lower())), (pattern, url)


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_both_forms_of_the_index_and_rules_without_a_token(spark, monkeypatch, broadcast):
    """Beyond the bound the tokens are shuffled, frequent ones in shares; every rule still meets its addresses."""
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", broadcast)
    monkeypatch.setattr(url_rules, "SPREAD", 3)
    rng = random.Random(5)
    words = ["casino", "shop", "a", "news", "x1"]
    urls = [f"https://{rng.choice(words)}.{rng.choice(words)}.net/{rng.choice(words)}-{rng.choice(words)}" for _ in range(120)]
    patterns = (("block", "asin"), ("block", "^news^"), ("allow", "*x1"), ("block", "/a-"))
    places = (("block", "shop.net/"), ("allow", "news.shop.net/"), ("allow", "net/a"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages_of(spark, urls), places, patterns).collect()}
    assert got == {i: plain_verdict(u, places, patterns) for i, u in enumerate(urls)}


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = pages_of(spark, ["https://example.org/en/1"] * 3 + ["https://b.org/en/1"] * 4)
    host, path = url_rules.host_and_path(F.col("url"))
    tokens = pages.select(url_rules.tokens_of(F.concat(host, path)).alias("tokens"))
    filed = {r.text: (t, n) for t, n, r in url_rules.index(tokens, url_rules.rules())}
    assert filed["example.org/en/1"] == ("example", 3) and filed["org/"] == ("org", 7) and filed["^casino^"] == ("casino", 0)


def test_rules_on_repeated_rows_and_empty_tables(spark):
    pages = pages_of(spark, ["https://x.com/de/a", None])
    assert sorted(r.verdict for r in url_rules.judge(pages.union(pages)).collect()) == ["allow", "allow", "block", "block"]
    assert url_rules.judge(pages.limit(0)).collect() == []
    assert {r.verdict for r in url_rules.judge(pages, (), ()).collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_rules.rules((("deny", "org/"),))


DOCS = "doc_id bigint, text string, n int, terms string, score string, item string, lang string"


def docs_of(spark, texts, langs=None):
    return spark.createDataFrame(
        [(i, t, 1, "x", "y", "z", langs[i] if langs else "en") for i, t in enumerate(texts)], DOCS
    )


def plain_terms(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_search(texts, items, k):
    held = [Counter(plain_terms(t)) for t in texts]
    n_docs, n_terms = sum(1 for h in held if h), sum(h.total() for h in held)
    df = Counter(t for h in held for t in h)
    out = {}
    for item, asked in items.items():
        scores = []
        for doc, h in enumerate(held):
            score = 0
            for t in set(plain_terms(asked)) & set(h):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 50 + (50 * h.total() * n_docs) // n_terms
                score += w * ((10**9 * h[t]) // (1000 * h[t] + 20 * m))
            if score > 0:
                scores.append((-score, doc))
        out[item] = [(n, doc, -s) for n, (s, doc) in enumerate(sorted(scores)[:k], 1)]
    return out


def random_texts(n, seed, letters="abcdefghij"):
    rng = random.Random(seed)
    return [" ".join(rng.choice(letters) + rng.choice(["", "x", "É"]) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("part, block, k", [(8_000_000, 2_000_000, 5), (20, 40, 3), (8_000_000, 25, 50)])
def test_search_against_brute_force(spark, monkeypatch, part, block, k):
    """Over one and several passes, blocks and tasks; with copies, so that scores are tied."""
    texts = random_texts(150, 3)
    texts += texts[:40] + [None, "", "...", "A a_b É", "bx " * 20_000]
    items = {1: "a bx cÉ, zz", 2: "", 3: "qq", 4: "a a a", 5: " ".join(random_texts(5, 9)), 6: None}
    monkeypatch.setattr(best_position, "PART_CHARS", part)
    monkeypatch.setattr(best_position, "BLOCK", block)
    asked = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    got = defaultdict(list)
    for r in best_position.search(docs_of(spark, texts).repartition(3), asked, k).orderBy("item_id", "rank").collect():
        got[r.item_id].append((r.rank, r.doc_id, r.score))
    want = plain_search(texts, items, k)
    assert dict(got) == {i: v for i, v in want.items() if v}


def test_search_stops_early_and_strictly_below_the_kth(spark):
    """One rare and one frequent term: the best positions end the search; a tie at the k-th place does not."""
    rng = np.random.default_rng(1)
    n = 20_000
    counts = rng.integers(1, 9, n)
    docs = np.concatenate((np.arange(n), np.arange(0, n, 1000)))
    terms = np.concatenate((np.zeros(n, int), np.ones(n // 1000, int)))
    corpus = best_position.Corpus(n, int(counts.sum()), {0: n, 1: n // 1000})
    weights = np.array([corpus.weight(0) + 5, corpus.weight(1)])
    lists = best_position.Block(np.full(n, 10), docs, terms, np.concatenate((counts, np.full(n // 1000, 3))), corpus, weights)
    found, scores, accesses = lists.search([0, 1], 5, [])
    exact = np.bincount(lists.docs, lists.impacts, n).astype(np.int64)
    order = np.lexsort((np.arange(n), -exact))[:5]
    assert found.tolist() == order.tolist() and scores.tolist() == exact[order].tolist()
    assert accesses < n / 10
    same = best_position.Block(np.full(n, 10), np.arange(n), np.zeros(n, int), np.ones(n, int), corpus, weights)
    assert same.search([0], 7, [])[0].tolist() == list(range(7))
    assert len(same.search([0], 7, [10**12] * 7)[0]) == 0


def test_search_on_empty_tables_null_ids_and_repeats(spark):
    docs = docs_of(spark, ["a b", "a"])
    items = spark.createDataFrame([(1, "a"), (1, "b"), (None, "b")], "item_id bigint, text string")
    got = {(r.item_id, r.rank, r.doc_id) for r in best_position.search(docs, items).collect()}
    assert got == {(1, 1, 0), (1, 2, 1), (None, 1, 0)}
    assert best_position.search(docs.limit(0), items).collect() == [] == best_position.search(docs, items.limit(0)).collect()
    odd = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (5, "c")], "doc_id bigint, text string")
    assert [r.doc_id for r in best_position.search(odd, items.where("text = 'a'")).orderBy("rank").collect()] == [3, 3, None]


def plain_collocations(texts, langs, least, top):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in zip(texts, langs):
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for size in range(1, 5):
                counts[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = {}
    for lang, f in counts.items():
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in candidates.items():
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            longer = [
                b for h, b in candidates.items()
                if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
            ]
            if not any(100 * b >= 80 * a for b in longer):
                rows.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out[lang] = [
            (n, p.decode(), -a, left, right, total[lang], -s) for n, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)
        ]
    return {lang: rows for lang, rows in out.items() if rows}


def mined(spark, texts, langs, **how):
    got = defaultdict(list)
    for r in collocations.mine(docs_of(spark, texts, langs).repartition(2), **how).orderBy("lang", "rank").collect():
        got[r.lang].append((r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score))
    return dict(got)


@pytest.mark.parametrize("least, top, reach", [(3, 2000, 2), (3, 4, 1), (5, 3, 1)])
def test_collocations_against_brute_force(spark, least, top, reach):
    """With scores to settle in several steps: few reported phrases, covered ones among the best, ties at the last rank."""
    rng = random.Random(11)
    fixed = ["alpha beta gamma delta", "new york city", "es de", "New York", "x y x y x y"]
    texts = [
        "".join(
            rng.choice(fixed) + rng.choice([" ", ". ", "\t", "\n", " a ", " b c "]) for _ in range(rng.randrange(0, 25))
        )
        for _ in range(60)
    ]
    texts += ["é\x85ü é\x85ü", None, "", " . ", "to be " * 3000]
    langs = [rng.choice(["en", "es", None, "und"]) for _ in texts]
    assert mined(spark, texts, langs, min_count=least, top=top, first_reach=reach) == plain_collocations(texts, langs, least, top)


def test_collocations_of_random_words(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    langs = ["en"] * 20 + ["es"] * 20
    for top in (1, 6):
        assert mined(spark, texts, langs, min_count=4, top=top, first_reach=1) == plain_collocations(texts, langs, 4, top)


def test_collocations_on_empty_tables_and_repeats(spark):
    docs = docs_of(spark, ["p q"] * 30 + ["p"] * 7)
    assert [(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.mine(docs).collect()] == [
        ("en", 1, "p q", 30, 37, 30, 67, 895522)
    ]
    assert collocations.mine(docs.limit(29)).collect() == [] == collocations.mine(docs.limit(0)).collect()


def test_a_sieve_holds_back_nothing(spark):
    rng = np.random.default_rng(4)
    h = rng.integers(-(1 << 63), 1 << 63, (500, 3), np.int64)
    for size in (1, 2, 3):
        table = spark.createDataFrame([([int(x) for x in row[:size]],) for row in h], "g array<bigint>")
        sieve = collocations.Sieve(table)
        assert sieve.passes([np.ascontiguousarray(h[:, k]) for k in range(size)]).all()
        other = rng.integers(-(1 << 63), 1 << 63, (500, 3), np.int64)
        assert sieve.passes([np.ascontiguousarray(other[:, k]) for k in range(size)]).mean() < 0.05
