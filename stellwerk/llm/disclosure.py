"""Personal data: patterns, and the terms around them that give them away.

Patterns find e-mail addresses, network addresses, card and telephone numbers: the protected
entities. A term that stands near an entity reveals it as far as the corpus ties the two
together: with n(t, e) documents in which t stands near e, n(t) documents with t, n(e) with e
and N in all, the pointwise mutual information log(n(t, e) N / (n(t) n(e))) is set against the
information of the entity itself, log(N / n(e)). A term that reveals at least REMOVE of it is
removed, one that reveals at least GENERALISE is replaced by a general word, wherever it stands:
the window around an entity is for the statistics only. Ties are only believed if they were
seen in SURROUNDINGS documents and in as many different surroundings, and if the entity follows from the term with
some certainty (the lower confidence bound of its share of the term's documents is SURE), so that neither copies
nor repetitions within a document count as evidence. Nothing is said about the terms near an
entity of fewer documents: of it, only what the patterns find is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.llm.common import free_names, let, running, sieve, sifted
from stellwerk.session import materialise

#: Kinds in order, with what they look like. The look-arounds keep a search from
#: starting inside a run that it has given up on, so that long runs are read once; they do not
#: change what is found (a kept card number is a whole run of 14 to 19 digits).
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?!\.?[A-Za-z0-9-])",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
HINTS = {"email": "@", "phone": "+", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Characters looked at on each side of an entity, and words taken there.
NEAR_CHARS, NEAR_WORDS = 120, 8
#: Documents, and different surroundings, that must tie a term to an entity, and the shares of its information.
SURROUNDINGS, REMOVE, GENERALISE = 3, 0.9, 0.6
#: The entity must follow from the term in at least this share of the documents with the term: the lower bound of
#: a one-sided interval of 95 %.
SURE, Z = 1 / 3, 1.645
#: Characters of a text that are cut out at once when it is masked.
CHUNK = 4096
TERM = r"\p{L}{3,}"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "removed": ""}


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def value(k: Column) -> Column:
        d = F.substring(digits, n - k, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(k % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, k: acc + value(k))
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def spans_between(pieces: Column, found: Column, kind: str) -> Column:
    """Spans of matches from the pieces of text around them."""

    def one(at: Column) -> Callable[[Column, Column], Column]:
        def span(value: Column, k: Column) -> Column:
            start = F.get(at, 2 * k + 1)
            return F.struct(
                start.alias("start"), F.lit(KINDS.index(kind) if kind in KINDS else len(KINDS)).alias("order"),
                F.get(at, 2 * k + 2).alias("end"), F.lit(kind).alias("kind"), value.alias("value"),
            )

        return span

    def places(around: Column) -> Column:
        sizes = F.flatten(F.transform(found, lambda m, k: F.array(F.length(F.get(around, k)), F.length(m))))
        return running(sizes, F.lit(0), lambda x, y: x + y)

    return let(let(pieces, places), lambda at: F.transform(found, one(at)))


def _matches(kind: str, text: Column) -> Column:
    """Spans (start, kind number, end, kind, value) of one kind; positions in code points, end exclusive."""
    pattern = PATTERNS[kind]

    def spans(found: Column) -> Column:
        return F.filter(spans_between(F.split(text, pattern, -1), found, kind), lambda s: _valid(kind, s["value"]))

    hint = text.contains(HINTS[kind]) if len(HINTS[kind]) == 1 else text.rlike(HINTS[kind])
    return F.when(hint, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start:int,order:int,end:int,kind:string,value:string>>"


def base_spans(text: Column) -> Column:
    """All pattern spans of a text, by start, then kind."""
    return F.sort_array(F.concat(*[_matches(k, text) for k in KINDS]))


def digest_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _entity(kind: Column, value: Column) -> Column:
    """One name for the spellings of an entity."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.concat(kind, F.lit(":"), F.when(kind == "email", F.lower(value)).when(kind == "ip", value).otherwise(digits))


def _blanked(text: Column) -> Column:
    """The text with addresses, the only entities with letters, replaced by as many blanks."""

    def blank(found: Column) -> Column:
        pieces = F.arrays_zip(F.split(text, PATTERNS["email"], -1).alias("0"), found.alias("1"))
        gap = lambda p: F.repeat(F.lit(" "), F.coalesce(F.length(p["1"]), F.lit(0)))
        return F.array_join(F.transform(pieces, lambda p: F.concat(p["0"], gap(p))), "")

    found = F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0))
    return F.when(text.contains("@"), let(found, blank)).otherwise(text)


def _chunks(text: Column) -> Column:
    """The text in parts of CHUNK characters."""
    parts = F.sequence(F.lit(0), F.floor(F.length(text) / CHUNK).cast("int"))
    return F.transform(parts, lambda c: F.substring(text, c * CHUNK + 1, F.lit(CHUNK)))


def _cut(chunks: Column, a: Column, b: Column) -> Column:
    """Characters a to b; a place is looked for within a chunk, not from the start of the text."""

    def part(c: Column) -> Column:
        lo = F.greatest(a - c * CHUNK, F.lit(0))
        return F.substring(F.get(chunks, c), lo + 1, F.least(b - c * CHUNK, F.lit(CHUNK)) - lo)

    first = F.floor(a / CHUNK).cast("int")
    return F.when(a < b, F.array_join(F.transform(F.sequence(first, F.floor((b - 1) / CHUNK).cast("int")), part), "")).otherwise("")


def _near(found: DataFrame) -> DataFrame:
    """Terms near each entity: id, mark, entity, around, term."""
    # Sides are cut out before the spans become rows, so that no row carries the text.
    def sides(chunks: Column) -> Column:
        def both(s: Column) -> Column:
            start = F.greatest(s["start"] - NEAR_CHARS, F.lit(0))
            entity = _entity(s["kind"], s["value"]).alias("entity")
            left = _cut(chunks, start, s["start"]).alias("side")
            right = _cut(chunks, s["end"], s["end"] + NEAR_CHARS).alias("side")
            return F.array(
                F.struct(entity, F.lit(True).alias("left"), start.alias("at"), left),
                F.struct(entity, F.lit(False).alias("left"), s["end"].alias("at"), right),
            )

        return F.flatten(F.transform("spans", both))

    one = found.select("id", "mark", F.explode(let(_chunks(F.col("text")), sides)).alias("c")).select("id", "mark", "c.*")

    def terms(side: Column) -> Column:
        def add(acc: Column, piece: Column) -> Column:
            start = acc["at"] + F.length(piece["0"])
            end = start + F.length(piece["1"])
            term = F.struct(F.lower(piece["1"]).alias("term"), start.alias("start"), end.alias("end"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(term)).alias("out"))

        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<term:string,start:int,end:int>>").alias("out"))
        return let(
            F.regexp_extract_all(side, F.lit(TERM), F.lit(0)),
            lambda m: F.aggregate(F.arrays_zip(F.slice(F.split(side, TERM, -1), F.lit(1), F.size(m)).alias("0"), m.alias("1")), empty, add)["out"],
        )

    one = one.withColumn("side", _blanked(F.col("side")))
    one = one.where(F.col("side").rlike(TERM))
    one = one.withColumn("terms", terms(F.col("side")))
    whole = F.filter("terms", lambda t: F.when(F.col("left"), (t["start"] > 0) | (F.col("at") == 0)).otherwise(t["end"] < NEAR_CHARS))
    one = one.withColumn("terms", whole)
    nearest = F.when(
        F.col("left"), F.slice("terms", F.greatest(F.size("terms") - NEAR_WORDS + 1, F.lit(1)), F.lit(NEAR_WORDS))
    ).otherwise(F.slice("terms", 1, NEAR_WORDS))
    around = F.xxhash64(F.transform(nearest, lambda t: t["term"]))
    return one.select("id", "mark", "entity", around.alias("around"), F.explode(nearest).alias("t")).select(
        "id", "mark", "entity", "around", "t.term"
    )


def least_share(hits: Column, n: Column) -> Column:
    """Lower bound of a share of which ``hits`` of ``n`` were seen, by Wilson's interval."""
    p, zz = hits / n, Z * Z
    middle = p + zz / (2 * n)
    margin = Z * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / n + zz / (4 * n * n))
    return (middle - margin) / (1 + zz / n)


def disclosing_terms(rows: DataFrame, holders: DataFrame, near: DataFrame) -> DataFrame:
    """entity, term, disclosed: what the corpus ties to an entity, and how much of it that gives away."""
    tied = (
        near.groupBy("entity", "term")
        .agg(
            F.count_distinct(F.struct("id", "mark")).alias("both"), F.count_distinct("around").alias("surroundings")
        )
        .where((F.col("both") >= SURROUNDINGS) & (F.col("surroundings") >= SURROUNDINGS))
    )
    with_entity = (
        holders.select(F.explode(F.array_distinct(F.transform("spans", lambda s: _entity(s["kind"], s["value"])))).alias("entity"))
        .groupBy("entity").agg(F.count("*").alias("n_entity"))
    )
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text")), F.lit(TERM), F.lit(0)))
    # Counting by hash keeps the keys short; equal hashes of different terms are one in 10^19.
    with_term = rows.select(F.explode(words).alias("term")).groupBy(F.xxhash64("term").alias("hash")).agg(F.count("*").alias("n_term"))
    joined = tied.join(with_entity, "entity").withColumn("hash", F.xxhash64("term")).join(with_term, "hash")
    joined = joined.where(least_share(F.col("both"), F.col("n_term")) >= SURE).withColumn("n", F.lit(rows.count()))
    told = F.log2(F.col("both") * F.col("n") / (F.col("n_term") * F.col("n_entity")))
    ratio = F.try_divide(told, F.log2(F.col("n") / F.col("n_entity")))  # null if every document has the entity
    return joined.select("entity", "term", F.coalesce(ratio, F.lit(0.0)).alias("disclosed")).where(F.col("disclosed") >= GENERALISE)


def _holders_of(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """id, mark, known (term to kind): the documents that hold a disclosing term anywhere, with those that they hold."""
    own = F.transform(F.regexp_extract_all(_blanked(F.col("text")), F.lit(TERM), F.lit(0)), lambda w: F.xxhash64(F.lower(w)))
    words = rows.select("id", "mark", F.explode(F.array_distinct(own)).alias("hash"))
    held = words.join(terms.withColumn("hash", F.xxhash64("term")), "hash").groupBy("id", "mark")
    return held.agg(F.map_from_entries(F.collect_set(F.struct("term", "kind"))).alias("known"))


def _places(text: Column, known: Column) -> Column:
    """Spans of every place of the known terms in the whole text, like those of _matches."""

    def spans(text: Column, found: Column) -> Column:
        every = spans_between(F.split(text, TERM, -1), found, "term")
        own = F.transform(every, lambda s: s.withField("value", F.lower(s["value"])))
        own = F.transform(own, lambda s: s.withField("kind", F.try_element_at(known, s["value"])))
        return F.filter(own, lambda s: s["kind"].isNotNull())

    return let(_blanked(text), lambda t: let(F.regexp_extract_all(t, F.lit(TERM), F.lit(0)), lambda m: spans(t, m)))


def _masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind's label; overlapping spans by the first one's."""

    labels = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])

    def joined(chunks: Column, until: Column) -> Column:
        def replaced(s: Column, k: Column) -> Column:
            at = F.get(until, k)
            return F.when(s["start"] >= at, F.concat(_cut(chunks, at, s["start"]), F.element_at(labels, s["kind"]))).otherwise("")

        rest = _cut(chunks, F.element_at(until, -1), F.length(text))
        return F.concat(F.array_join(F.transform(spans, replaced), ""), rest)

    # Up to where the text is dealt with when each span comes.
    until = running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda x, y: F.greatest(x, y))
    return let(_chunks(text), lambda c: let(until, lambda u: joined(c, u)))


def _extra_spans(rows: DataFrame) -> DataFrame:
    """id, mark, extra: the spans of disclosing terms, for the documents that have any."""
    holders = materialise(rows.where("size(spans) > 0"))
    told = disclosing_terms(rows, holders, _near(holders)).groupBy("term").agg(F.max("disclosed").alias("disclosed"))
    kind = F.when(F.col("disclosed") >= REMOVE, "removed").otherwise("term")
    terms = materialise(told.select("term", kind.alias("kind")))
    known = materialise(_holders_of(rows, terms))
    # Only the texts that the sieve lets through are moved to the terms that they hold.
    possible = sifted(rows.select("id", "mark", "text"), _row_key("id", "mark"), sieve(known, _row_key("id", "mark")), "held").where("held")
    held = known.withColumnsRenamed({"id": "i", "mark": "m"})
    joined = possible.join(held, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")))
    # Repeated rows have the same spans.
    return joined.select("id", "mark", _places(F.col("text"), F.col("known")).alias("extra")).dropDuplicates(["id", "mark"])


def _row_key(key: str, mark: str) -> Column:
    return F.xxhash64(key, mark)


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str] = ("pii_base", "pii_spans")
) -> DataFrame:
    """Every row of ``docs`` with two columns more: pii_base and pii_spans (arrays of start, order, end, kind, value).

    pii_spans has the base spans and those of disclosing terms (kinds ``removed`` and ``term``),
    by start, then kind. A term that discloses any entity is marked wherever it stands, in every
    document; one that discloses several has the kind of the one it gives away most of. A null
    text has none. Repeated rows are treated alike and count as documents in the statistics.
    Columns may have any names but those of ``names``; spans are joined to the rows, so texts
    are only moved if they are asked for.
    """
    if taken := {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(taken)} are there already; give other names")
    base, all_ = names
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark, key, hit, extra = free_names(docs, "mark", "key", "hit", "extra")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"), base_spans(text).alias("spans"))
    known = materialise(_extra_spans(rows)).withColumnsRenamed({"id": key, "mark": hit, "extra": extra})
    marked = docs.withColumn(base, base_spans(text)).withColumn(mark, F.xxhash64(text))
    joined = marked.join(known, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(mark) == F.col(hit)), "left")
    more = F.when(F.col(extra).isNotNull(), F.sort_array(F.concat(base, extra))).otherwise(F.col(base))
    return joined.withColumn(all_, more).drop(mark, key, hit, extra)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span in its text replaced; other columns and the texts without spans stay.

    Only rows that may have a disclosing term are joined to its spans; the others stay where they are.
    """
    all_, mark, key, hit, extra, held = free_names(docs, "pii_spans", "mark", "key", "hit", "extra", "held")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"), base_spans(text).alias("spans"))
    known = materialise(_extra_spans(rows))
    marked = sifted(docs.withColumn(mark, F.xxhash64(text)), _row_key(id_col, mark), sieve(known, _row_key("id", "mark")), held)
    spans = known.withColumnsRenamed({"id": key, "mark": hit, "extra": extra})
    some = marked.where(held).join(spans, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(mark) == F.col(hit)), "left")
    more = F.coalesce(F.col(extra), F.array().cast(SPANS))
    found = some.withColumn(all_, F.sort_array(F.concat(base_spans(text), more)))
    plain = marked.where(~F.col(held)).withColumn(all_, base_spans(text))
    clean = F.when(F.size(all_) > 0, _masked(F.col(text_col), F.col(all_))).otherwise(F.col(text_col))
    return reduce(DataFrame.unionAll, [x.withColumn(text_col, clean).select(*docs.columns) for x in (plain, found)])
