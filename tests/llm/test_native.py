"""License scan, line quality and personal data on small tables, against plain Python."""

from __future__ import annotations

import hashlib
import re
import time
from collections import Counter, defaultdict

import duckdb
import pytest

from stellwerk.llm import catalog, disclosure, licenses, line_quality
from tests.compare import compare

ODD = "doc_id bigint, text string, source string, id string, mark int, host string, spans string"


def rows_of(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, source, "x", 1, "h", "z") for i, t in enumerate(texts)], ODD)


def test_license_places_and_labels(spark):
    notice = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction"
    )
    texts = [
        "CC BY cc-by, cc\nBY",
        "all rights reserved ALL RIGHTS RESERVED all rights",
        "under the GNU General Public License",
        "Licensed under the Apache License, Version 2.0.",
        f"x {notice} y",
        "Licensed under the GNU General Public License, version 3, or all rights reserved?",
        None,
        "",
        "cc",
        "É cc by é",
        "cc by " * 30_000,
        "allrights reserved of the license of the software",
    ]
    got = {r.doc_id: r for r in licenses.scan(rows_of(spark, texts)).collect()}
    for i, text in enumerate(texts):
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        words = re.findall(licenses.WORD, lowered)
        places = [
            (k, label) for phrase, label in licenses.PHRASES for k in range(len(words))
            if words[k : k + len(phrase.split())] == phrase.split()
        ]
        starts = [k for k, _ in places]
        assert (got[i].n_words, got[i].n_base) == (len(words), len(places))
        assert (got[i].first_word, got[i].last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert got[i].base_labels == ",".join(sorted({x for _, x in places}))
    assert [got[i].labels for i in range(12)] == [
        "cc-by", "reserved", "gpl", "apache-2.0", "mit", "gpl,gpl-3.0,reserved", "", "", "", "cc-by", "cc-by", "",
    ]
    assert got[4].score == 1.0 or got[4].score >= licenses.COVERAGE
    assert got[6].score == 0.0 and all(0 <= r.score <= 1 for r in got.values())


def test_license_repeated_rows_and_empty_table(spark):
    df = rows_of(spark, ["cc by x"])
    twice = df.union(df)
    assert [(r.n_base, r.n_words) for r in licenses.scan(twice).collect()] == [(1, 3), (1, 3)]
    assert licenses.scan(spark.createDataFrame([], ODD)).collect() == []


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
    )


def test_quality_measures(spark):
    sentence = "one two three four five six seven eight nine ten"
    texts = [
        None, "", " \t\n", sentence, f"{sentence}\n{sentence}", "a b\na b\n\n\n a b\n", "a " * 100, "#*$ %&|<> \x1c é🙂 \x0b x",
        f"{sentence} x {sentence} y {sentence}", "word" * 40_000, " ".join(f"w{i % 5000}" for i in range(20_000)), "x y  z",
    ]
    got = {r.doc_id: r for r in line_quality.rate(rows_of(spark, texts)).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_quality(text), i
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_lines_of_many_documents_are_removed(spark):
    def own(i):
        return " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x{chr(97 + k)}" for k in range(26))

    common = "Subscribe to our   newsletter No 17 now and here for all the best news of the day and more"
    rows = [(i, f"{own(i)}\n{common}", "a") for i in range(40)]
    rows += [(100, "\n".join([common.replace("17", "4").upper()] + ["p q r s t u v w"]), "a")]
    rows += [(200 + i, f"{own(300 + i)}\n{common}", "b") for i in range(8)] + [(300, common + "\nmore words", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in line_quality.rate(df).collect()}
    holders = defaultdict(set)
    for i, text, host in rows:
        for line in text.split("\n"):
            holders[host or "", re.sub(r"\s+", " ", re.sub("[0-9]+", "0", line.lower()))].add(i)
    for i, text, host in rows:
        removed = 0
        for line in text.split("\n"):
            n = len(holders[host or "", re.sub(r"\s+", " ", re.sub("[0-9]+", "0", line.lower()))])
            if n > line_quality.LINE_DOCUMENTS:
                removed += len(line.split())
        assert got[i].n_removed_words == removed, i
    assert not got[100].base_failed and not got[100].kept
    assert all(got[i].kept for i in range(40)) and all(got[200 + i].kept for i in range(8))
    again = line_quality.rate(df.union(df)).collect()
    assert len(again) == 2 * len(rows) and {(r.doc_id, r.n_removed_words) for r in again} >= {(0, got[0].n_removed_words)}
    assert line_quality.rate(spark.createDataFrame([], df.schema)).collect() == []


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def luhn(digits):
        values = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return sum(v - 9 if v > 9 else v for v in values) % 10 == 0

    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")))
                or (kind == "card" and 14 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 10 <= len(digits) <= 15)
            ):
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def test_personal_data_spans_and_masks(spark):
    texts = [
        None, "", "a@b.c%x@y.z.w q@@z", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 1.2.3.4", "4111 1111 1111 1111, 4111-1111-1111-1111-4111",
        "4111 1111  1111 1111", "+1 (269) 555-3296 4524132264652876", "+49 30 1234567, ++12 3 4567890-1", "🙂 é x@y.com 4111111111111111",
        "x@" * 50, "1" * 50_000, "1 " * 20_000, "@a.b a@.b a@-.- ", "x@a..b y@a.b..c z@" + "a." * 2000 + "b", "no data here",
    ]
    df = rows_of(spark, texts).drop("mark")
    got = {r.doc_id: r for r in disclosure.find(df).collect()}
    for i, text in enumerate(texts):
        assert [tuple(s)[:4] for s in got[i].pii_base] == plain_spans(text), text[:60]
        assert got[i].pii_spans == got[i].pii_base
    clean = {r.doc_id: r.text for r in disclosure.sanitise(df).collect()}
    assert clean[0] is None and clean[14] == "no data here"
    assert clean[8] == "🙂 é [EMAIL] [CARD]" and clean[7] == "[PHONE], +[PHONE]"
    assert disclosure.sanitise(df).columns == df.columns
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in plain_spans(texts[8]))
    digest = disclosure.find(df.where("doc_id = 8")).select(disclosure.digest_text("pii_base").alias("x")).first().x
    assert digest == joined and len(hashlib.sha256(digest.encode()).hexdigest()) == 64


def test_terms_that_give_an_entity_away(spark):
    filler = ["quiet", "river", "stone", "green", "early", "paper", "light"]
    mail = "jd@mail.example.org"
    rows = [(i, f"Today {filler[i]} Zanzibaro {filler[i + 1]} wrote {mail} about {filler[i + 2]} things") for i in range(5)]
    # Copies of one document are one surrounding, whatever their number.
    rows += [(20 + i, "Copied Unicorno text from cp@mail.example.org here") for i in range(9)]
    again = "Walruso"
    rows += [(50, "\n".join(f"line {x} {again} at 10.20.30.40 {y}" for x, y in zip(filler, filler[1:])))]
    rows += [(100 + i, f"Today {filler[i % 7]} {filler[(i + 2) % 7]} wrote about things of page {i}") for i in range(60)]
    got = {r.doc_id: r for r in disclosure.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i in range(5):
        added = [(s.kind, s.value) for s in got[i].pii_spans if s.order == len(disclosure.KINDS)]
        assert ("removed", "zanzibaro") in added and ("removed", "today") not in added and ("term", "today") not in added
        (span,) = [s for s in got[i].pii_spans if s.value == "zanzibaro"]
        assert rows[i][1][span.start : span.end] == "Zanzibaro"
    assert all(got[20 + i].pii_spans == got[20 + i].pii_base for i in range(9))
    assert got[50].pii_spans == got[50].pii_base and len(got[50].pii_base) == 6
    assert all(not got[100 + i].pii_spans for i in range(60))


def test_disclosure_repeated_null_and_empty(spark):
    df = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (None, "+49 30 1234567"), (2, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, disclosure_text(r.pii_spans)) for r in disclosure.find(df).collect())
    assert got == [(0, "phone:0:14"), (1, "email:0:5"), (1, "email:0:5"), (2, "")]
    assert disclosure.find(spark.createDataFrame([], df.schema)).collect() == []
    everywhere = spark.createDataFrame([(i, f"word{chr(97 + i)} Namo a@b.c") for i in range(4)], df.schema)
    assert all(r.pii_spans == r.pii_base for r in disclosure.find(everywhere).collect())


def disclosure_text(spans):
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def test_disclosing_terms_go_wherever_they_stand(spark):
    filler = ["quiet", "river", "stone", "green", "early", "paper", "light"]
    mail = "jd@mail.example.org"
    far = "x y. " * 60
    rows = [(i, f"{filler[i]} Zanzibaro {filler[i + 1]} wrote {mail} about {filler[i + 2]} things") for i in range(5)]
    rows += [(5, f"🙂 Dear ZANZIBARO, {far} {filler[5]} zanzibaro {filler[6]} wrote {mail} {far} Zanzibaro Zanzibaros")]
    rows += [(6, "No address here, only Zanzibaro."), (7, "zanzibaro@b.example.org and Zanzibaro")]
    rows += [(100 + i, f"Today {filler[i % 7]} {filler[(i + 2) % 7]} wrote about things of page {i}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in disclosure.find(df.union(df.where("doc_id = 6"))).collect()}
    for i, text in rows:
        own = [m.span() for m in re.finditer(r"(?i)\bzanzibaro\b(?!@)", text)]
        assert [(s.start, s.end) for s in got[i].pii_spans if s.value == "zanzibaro"] == own, i
        assert {s.kind for s in got[i].pii_spans if s.order == len(disclosure.KINDS)} <= {"removed", "term"}
    assert [len(got[i].pii_spans) - len(got[i].pii_base) for i in (5, 6, 7, 100)] == [3, 1, 1, 0]
    clean = {r.doc_id: r.text for r in disclosure.sanitise(df).collect()}
    assert not any(re.search(r"(?i)\bzanzibaro\b", t) for t in clean.values()) and "Zanzibaros" in clean[5]


def test_common_lines_of_a_large_host_are_removed(spark):
    def own(i):
        name = "".join(chr(97 + i // 26**k % 26) for k in range(3))  # numbers would be alike in all lines
        return " ".join(f"{name}x{chr(97 + k)}" for k in range(26))

    line = "the same line stands here"
    rows = [(i, f"{own(i)}\n{line}" if i < 12 else own(i), "hot") for i in range(3000)]
    rows += [(5000 + i, f"{own(i)}\n{line}", "small") for i in range(12)] + [(6000 + i, f"{own(i)}\n{line}", "few") for i in range(10)]
    rows += [(7000, f"{line}\n" * 5 + own(1), "hot"), (7001, f"{line} 7 b c d e f g h i j k l m n o p q r s", "hot")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r.n_removed_words for r in line_quality.rate(df).collect()}
    assert all(got[i] == (5 if i < 12 else 0) for i in range(3000))
    assert all(got[5000 + i] == 5 for i in range(12)) and all(got[6000 + i] == 0 for i in range(10))
    assert got[7000] == 25 and got[7001] == 0


def test_personal_data_in_texts_of_many_spans(spark):
    """As many addresses as a table of members has, with a term to replace between them: in seconds, not in squares."""
    many = "".join(f"ü{chr(97 + k % 26)}@mail.example.org Zanzibaro 10.0.0.{k % 256}, " for k in range(4_000))
    filler = ["quiet", "river", "stone", "green", "early", "paper"]
    rows = [(i, f"{filler[i]} Zanzibaro {filler[i + 1]} wrote +49 30 1234567 now") for i in range(5)] + [(9, many)]
    rows += [(100 + i, f"Today {filler[i % 6]} wrote about things of page {i}") for i in range(80)]
    start = time.time()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = disclosure.find(df).where("doc_id = 9").first()
    assert [tuple(s)[:4] for s in found.pii_base] == plain_spans(many)
    assert [s.start for s in found.pii_spans if s.order == 4] == [m.start() for m in re.finditer("Zanzibaro", many)]
    clean = disclosure.sanitise(df).where("doc_id = 9").first().text
    assert clean == "".join("ü[EMAIL]  [IP], " for _ in range(4_000))
    assert time.time() - start < 100


def test_a_term_of_many_documents_gives_nobody_away(spark):
    """Three of its forty documents name the entity: told by information alone, not with any certainty."""
    rows = [(i, f"x{chr(97 + i)}lo Zanzibaro r{chr(97 + i)}lo wrote jd@mail.example.org") for i in range(3)]
    rows += [(10 + i, f"only Zanzibaro of page {i}") for i in range(37)] + [(100 + i, f"some page {i}") for i in range(9000)]
    got = {r.doc_id: r for r in disclosure.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert not any(s.value == "zanzibaro" for r in got.values() for s in r.pii_spans)
    assert {s.value for r in got.values() for s in r.pii_spans if s.order == 4} == {"wrote"}  # of three documents, all with the entity


def test_columns_named_like_the_spans(spark):
    df = spark.createDataFrame([(1, "a@b.c", "mine", 7)], "doc_id bigint, text string, pii_base string, held int")
    assert [tuple(r) for r in disclosure.sanitise(df).collect()] == [(1, "[EMAIL]", "mine", 7)]
    with pytest.raises(ValueError):
        disclosure.find(df)
    assert len(disclosure.find(df, names=("own", "all")).first()["all"]) == 1


def test_find_moves_no_texts(spark):
    """Spans are joined, texts are not: no exchange of the plan carries them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = disclosure.find(docs).select("doc_id", "pii_base", "pii_spans")
        plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert len(moved) == 2 and not any("text#" in columns for columns in moved)


def test_operator_and_sql_agree_on_planted_terms(spark, tmp_path):
    """On a table in which terms do disclose an entity, near it and elsewhere."""
    filler = ["quiet", "river", "stone", "green", "early", "paper", "light"]
    rows = [(i, f"{filler[i]} Zanzibaro {filler[i + 1]} wrote jd@mail.example.org about {filler[i + 2]} things") for i in range(5)]
    rows += [(6, "No address here, only ZANZIBARO."), (7, None), (8, "zanzibaro@b.example.org and Zanzibaro"), (9, "")]
    rows += [(100 + i, f"Today {filler[i % 7]} {filler[(i + 2) % 7]} wrote about things of page {i}") for i in range(80)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalog.SQL["op10_disclosure"]).df()
    got = catalog.op10_disclosure(spark, str(tmp_path)).toPandas()
    assert compare(got, want) is None
    assert got.spans.str.contains("term:|removed:").sum() == 7


def test_operator_and_sql_agree_on_a_large_host(spark, tmp_path):
    """A line of twelve documents in a host of 1,500: less than a share of any size would ask for."""
    rows = [(i, "\n".join([*(["the same line stands here"] if i < 12 else []), " ".join(f"w{i}x{k}" for k in range(25))]), "hot") for i in range(1500)]
    rows = [(i, t.translate(str.maketrans("0123456789", "abcdefghij")), h) for i, t, h in rows]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.op4_line_quality(spark, str(tmp_path)).toPandas()
    assert compare(got, con.execute(catalog.SQL["op4_line_quality"]).df()) is None and (got.n_removed_words > 0).sum() == 12
