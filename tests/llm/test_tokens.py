"""Token counts and the tokenization automaton against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stellwerk.llm.presplit import Remembered, WordVocabulary
from stellwerk.llm.token_automaton import Codec, TokenAutomaton, encode_decode
from stellwerk.llm.token_counts import MergeCounter, count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rnd = random.Random(1)
    pieces = ["Hello", "it's", "WORLD's", "日本語", "ﬁn", "İstanbul", "ΣΑΣ", "12³", "<|endoftext|>", "<|startoftext|>", "naïve",
              "!!!???", "\x1c", "é", "  ", "\n", "🙂", "a" * 90, "internationalisation", "don't", "Ǆ", "ͅ"]
    out = ["", " ", "<|endoftext|>", "ab" * 3000, "x" * 5000, "  "]
    out += ["".join(rnd.choice(pieces) + rnd.choice(["", " "]) for _ in range(rnd.randrange(30))) for _ in range(300)]
    out += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz'0") for _ in range(rnd.randrange(1, 20))) for _ in range(2000)]
    return out


def test_texts_as_the_library_has_them(library):
    vocabulary = WordVocabulary(PATH)
    counter, codec = MergeCounter(vocabulary), Codec(vocabulary)
    for text in texts():
        expected = library.encode(text, add_special_tokens=False)
        codes = codec.encode(text)
        assert " ".join(codes) == " ".join(map(str, expected.ids)), text
        assert codec.decode(codes) == library.decode(expected.ids, skip_special_tokens=False), text
        assert counter.text(text) == len(expected.ids), text


def test_automaton_accepts_exactly_what_merging_gives():
    merges = [("a", "b"), ("b", "a"), ("a", "a"), ("ab", "a"), ("aa", "aa"), ("ab", "ab"), ("b", "b"), ("ba", "bb")]
    ids = {t: i for i, t in enumerate(["a", "b", *dict.fromkeys(x + y for x, y in merges)])}
    merges = [m for k, m in enumerate(merges) if m[0] + m[1] not in [x + y for x, y in merges[:k]]]
    automaton = TokenAutomaton(ids, merges)

    def merged(word):
        tokens = list(word)
        for u, v in merges:
            k = 0
            while k < len(tokens) - 1:
                if tokens[k] == u and tokens[k + 1] == v:
                    tokens[k : k + 2] = [u + v]
                k += 1
        return tokens

    def splits(word):
        if not word:
            yield []
        for t in ids:
            if word.startswith(t):
                yield from ([t, *rest] for rest in splits(word[len(t) :]))

    for n in range(1, 9):
        for bits in range(1 << n):
            word = "".join("ab"[bits >> k & 1] for k in range(n))
            assert automaton.encode(word) == merged(word)
            assert [s for s in splits(word) if automaton.accepts(s)] == [merged(word)]


def test_merges_must_make_new_tokens_from_known_ones():
    with pytest.raises(ValueError):
        TokenAutomaton({"a": 0, "b": 1, "abc": 2}, [("ab", "c")])


def test_remembered_is_bounded():
    calls = []
    known = Remembered(lambda w: calls.append(w) or len(w), 3, longest=4)
    for w in ["a", "bb", "ccc", "a", "dddd", "a", "eeeee", "eeeee"]:
        assert known[w] == len(w)
    assert len(known) <= 3 and calls.count("a") == 1 and calls.count("eeeee") == 2


def test_queries_over_awkward_rows(spark, library):
    rows = [(1, "Hello <|endoftext|> World", 7, "x"), (2, None, 7, "y"), (3, "", None, None), (3, "", None, None), (None, "ü" * 2500, 1, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, id string")
    got = sorted((tuple(r) for r in count_tokens(df, PATH).collect()), key=str)
    n = len(library.encode("ü" * 2500, add_special_tokens=False).ids)
    assert got == sorted([(1, 25, 3, False), (2, 0, 0, False), (3, 0, 0, False), (3, 0, 0, False), (None, 5000, n, n > 2048)], key=str)
    coded = {r.doc_id: r for r in encode_decode(df, PATH, with_ids=True).collect()}
    e = library.encode("Hello <|endoftext|> World", add_special_tokens=False)
    assert coded[1].ids == " ".join(map(str, e.ids)) and coded[1].n_tokens == len(e.ids)
    decoded = library.decode(e.ids, skip_special_tokens=False)
    assert coded[1].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert coded[2].ids_sha256 == hashlib.sha256(b"").hexdigest() and coded[2].n_tokens == 0
    empty = spark.createDataFrame([], df.schema)
    assert count_tokens(empty, PATH).collect() == [] and encode_decode(empty, PATH).collect() == []
