"""Near-duplicates against brute force."""

from __future__ import annotations

import random
import re

import pytest
import xxhash

from stellwerk.llm import simhash
from stellwerk.llm.components import components


def plain_fingerprint(text):
    words = re.findall("[^ \t-\r]+", "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids):
    """Smallest id reachable over links of at most four bits, by repeated relaxation over all pairs."""
    best = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 4 and best[j] < best[i]:
                    best[i], changed = best[j], True
    return best


def near_fingerprints(n=150, seed=5):
    rnd = random.Random(seed)
    out = [rnd.getrandbits(64) for _ in range(20)]
    while len(out) < n:
        x = rnd.choice(out)
        for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 4, 4, 5, 6])):
            x ^= 1 << b
        out.append(x)
    return list(dict.fromkeys(out))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("limit", [4096, 3, 1])
def test_links_connect_what_brute_force_connects(spark, limit):
    fps = near_fingerprints()
    table = spark.createDataFrame([(signed(x),) for x in fps], "fp bigint")
    edges = simhash.links(table, limit)
    root = {r.a: r.b for r in components(edges).collect()}
    order = sorted(range(len(fps)), key=lambda i: signed(fps[i]))
    expected = plain_components([fps[i] for i in order], list(range(len(order))))
    for k, i in enumerate(order):
        assert root.get(signed(fps[i]), signed(fps[i])) == signed(fps[order[expected[k]]])


def test_documents_against_brute_force(spark):
    rnd = random.Random(2)
    words = ["alpha", "Beta", "gämma", "x", "delta", "EPSILON", "zeta", "10"]
    long = [rnd.choice(words) + str(rnd.randrange(50)) for _ in range(300)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 40))) for _ in range(60)]
    texts += [None, "", "  \n", "one two", "One  TWO\n", "a b c d", " ".join(long), " ".join(long), " ".join([*long[:-1], "end"])]
    texts += ["word " * 70_000, "ÄÖ İ ß \x1c y z w"]
    rows = [(i, t, "fr", "s", 1, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, first string, id int, component_id string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    expected = plain_components(fps, list(range(len(texts))))
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [got[i].component_id for i in range(len(texts))] == expected
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected))


def test_empty_repeated_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.one_of_each(empty).collect() == []
    df = spark.createDataFrame(
        [(1, "a b"), (1, "a b"), (2, "a b"), (3, "c d e f g"), (3, "h i j k l"), (None, "m n o p q"), (None, "a b")],
        "doc_id bigint, text string",
    )
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect() if r.doc_id is not None)
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3), (3, 3)]
    kept = simhash.one_of_each(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 3), (True, 0), (True, 0)]


def test_components_of_chains_loops_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(5, 5), (9, 8), (8, 9)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r.a: r.b for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, **{100 + i: 100 for i in range(1, 30)}}
