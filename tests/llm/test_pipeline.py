"""The pipeline, stage by stage and as a whole, against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from stellwerk.llm import decontamination, disclosure
from tests.llm.test_native import plain_spans
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """The smallest documents with awkward ones added, and their benchmark."""
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = bench.orderBy("item_id").first().text
    text = "The thing and the other of it is for that with was on by the end of the day. Mail bo.x@mail.example.com or 10.2.3.4 now!"
    more = [(9001, None), (9002, ""), (9003, "12 34 !?"), (9004, "漢字 かな"), (9005, text), (9006, text), (9007, text.upper()),
            (9008, f"Of the thing and that.\n{item}\nIn the end."), (9009, f"{text} <|endoftext|> the of and")]
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in more]
    docs.union(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    return folder


def masked(text):
    """Later spans first, so that earlier places hold; a span inside an earlier one is not replaced."""
    spans, until = [], 0
    for start, _, end, kind in plain_spans(text):
        if start >= until:
            spans.append((start, end, disclosure.LABELS[kind]))
        until = max(until, end)
    for start, end, label in reversed(spans):
        text = text[:start] + label + text[end:]
    return text


def test_stages_and_run(spark, source):
    docs = spark.read.parquet(f"{source}/documents.parquet")
    schema, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, source).toPandas(), docs.schema)
        assert docs.columns == schema
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{source}/documents.parquet").collect()}

    kept = seen["language_id"]
    assert set(before) - set(kept) == {9001, 9002, 9003, 9004}
    ids = sorted(kept)
    groups = plain_components([plain_fingerprint(kept[i]) for i in ids], ids)
    assert sorted(seen["near_dedup"]) == sorted(set(groups))
    items = [r.text for r in spark.read.parquet(f"{source}/benchmark.parquet").collect()]
    parts = [tuple(map(decontamination.grams, decontamination.question_and_answer(t))) for t in items]

    def leaks(text):
        words = decontamination.words_of(text.lower())
        return any(min(decontamination.covered(p, words) for p in part) >= decontamination.VERIFY for part in parts)

    clean = {i for i, t in seen["near_dedup"].items() if not leaks(t)}
    assert set(seen["decontamination"]) == clean and 9008 not in clean
    for i in clean:
        assert seen["pii"][i] == masked(seen["decontamination"][i]), i
    assert set(seen["pii"]) == clean
    assert "[EMAIL]" in seen["pii"][9005]

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, source).collect()}
    assert set(got) == clean
    for i, text in seen["pii"].items():
        ids = " ".join(map(str, library.encode(text, add_special_tokens=False).ids))
        assert got[i].ids == ids and got[i].ids_sha256 == hashlib.sha256(ids.encode()).hexdigest()


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "bpe"]


def test_empty_repeated_and_extra_columns(spark, source):
    docs = spark.read.parquet(f"{source}/documents.parquet")
    odd = docs.selectExpr("*", "1 AS stay", "'x' AS mark", "2 AS rows", "'k' AS key", "3 AS id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, source)
        assert out.columns == odd.columns
        assert stage(spark, odd.limit(0), source).collect() == []
        twice = Counter(r.doc_id for r in stage(spark, odd.union(odd), source).collect())
        once = Counter(r.doc_id for r in out.collect())
        assert set(twice) == set(once)
