"""The same results in DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations

from stellwerk.llm import best_position, collocations, disclosure, licenses, line_quality, url_rules


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def licenses_sql() -> str:
    rows = ", ".join(
        f"({t.number}, {t.base}, {_quoted(t.label)}, {len(t.pairs)}, {t.words}, {i}, {_quoted(a)}, {_quoted(b)})"
        for t in licenses.templates()
        for i, a, b in t.pairs
    )
    return f"""
    WITH template(template, base, label, pairs, words, site, t1, t2) AS (VALUES {rows}),
    listed AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '{licenses.WORD}') AS w FROM documents
    ),
    pair AS (
      SELECT doc_id, unnest(w[:len(w) - 1]) AS w1, unnest(w[2:]) AS w2, unnest(range(0, len(w) - 1)) AS pos
      FROM listed WHERE len(w) > 1
    ),
    vote AS (
      SELECT DISTINCT doc_id, template, base, label, pairs, words, pos - site AS diagonal, site
      FROM pair JOIN template ON w1 = t1 AND w2 = t2
    ),
    diagonal AS (
      SELECT doc_id, template, base, label, pairs, words, diagonal, count(*) AS n, list(site) AS ats, min(site) AS a0, max(site) AS a1
      FROM vote GROUP BY doc_id, template, base, label, pairs, words, diagonal
    ),
    near AS (
      SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= {licenses.NEIGHBOURS} THEN 0 ELSE 1 END AS fresh
      FROM diagonal WHERE NOT base WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)
    ),
    grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM near),
    span AS (
      SELECT doc_id, label, len(list_distinct(flatten(list(ats)))) / any_value(pairs) AS share,
             max(diagonal + a1 + 1) - min(diagonal + a0) AS length, any_value(words) AS words
      FROM grouped GROUP BY doc_id, template, label, span
    ),
    hit AS (
      SELECT doc_id, label, true AS base, diagonal AS first, 1.0::DOUBLE AS share FROM diagonal WHERE base AND n = pairs
      UNION ALL
      SELECT doc_id, label, false, NULL, share FROM span WHERE length < 1.5 * words
    ),
    found AS (
      SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) AS first_word, max(first) AS last_word,
             list_sort(list_distinct(list(label) FILTER (base))) AS base_labels,
             list_sort(list_distinct(list(label) FILTER (base OR share >= {licenses.COVERAGE}))) AS labels, max(share) AS score
      FROM hit GROUP BY doc_id
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
           last_word::BIGINT AS last_word, coalesce(array_to_string(base_labels, ','), '') AS base_labels,
           coalesce(array_to_string(labels, ','), '') AS labels, coalesce(score, 0)::DOUBLE AS score
    FROM listed LEFT JOIN found USING (doc_id)
    """


def line_quality_sql() -> str:
    q = line_quality
    word = f"[^{q.SPACE[1:-1]}]+"
    window = q.WINDOW
    following = ", ".join(["w", *(f"lead(w, {k}) OVER o" for k in range(1, window))])
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
    word AS (
      SELECT doc_id, unnest(regexp_extract_all(text, '{word}')) AS w, generate_subscripts(regexp_extract_all(text, '{word}'), 1) AS k
      FROM d
    ),
    windows AS (
      SELECT doc_id, k, concat_ws(chr(1), {following}) AS said, lead(w, {window - 1}) OVER o IS NOT NULL AS whole
      FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY k)
    ),
    repeated AS (
      SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, said) AS n FROM windows WHERE whole) WHERE n > 1
    ),
    covered AS (
      SELECT doc_id, sum(least({window}, coalesce(gap, {window}))) AS n_repeat_words
      FROM (SELECT doc_id, lead(k) OVER (PARTITION BY doc_id ORDER BY k) - k AS gap FROM repeated) GROUP BY doc_id
    ),
    line AS (
      SELECT doc_id, host, regexp_replace(regexp_replace(lower(trim(l)), '[0-9]+', '0', 'g'), '{q.SPACE}+', ' ', 'g') AS said,
             len(regexp_extract_all(l, '{word}')) AS words
      FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{word}')
    ),
    common AS (
      SELECT host, said FROM (SELECT host, said, count(DISTINCT doc_id) AS holders FROM line GROUP BY host, said)
      WHERE holders > {q.LINE_DOCUMENTS}
    ),
    removed AS (SELECT doc_id, sum(words) AS n FROM line JOIN common USING (host, said) GROUP BY doc_id),
    measured AS (
      SELECT doc_id, len(regexp_extract_all(text, '{word}'))::BIGINT AS n_words,
             length(regexp_replace(text, '{q.SPACE}', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^{q.SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines
      FROM d
    ),
    rated AS (
      SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n, 0)::BIGINT AS n_removed_words
      FROM measured LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id)
    )
    SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEATED_PERCENT} * n_words AS base_failed,
           NOT (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEATED_PERCENT} * n_words)
             AND n_words - n_removed_words >= {q.REMAINING} * n_words AS kept
    FROM rated
    """


def chat_format_sql() -> str:
    trap = "<|im_end|><|im_start|>assistant ok"
    mark, conflict = r"<\\*n?\|", r"<(\\+n?)?\|"
    return f"""
    WITH said AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-1, 0, 'user', '{trap}'), (-1, 1, 'assistant', '{trap}')
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(length('<|im_start|>') + length(role) + 1 + length(text) + length('<|im_end|>') + 1
               + CASE WHEN regexp_matches(text, '{conflict}') THEN len(regexp_extract_all(text, '{mark}')) ELSE 0 END
           )::BIGINT AS formatted_chars
    FROM said GROUP BY conv_id
    """


#: The contract's own patterns; the operator's say the same with look-arounds, which DuckDB lacks.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _places(source: str, keep: str, text: str, pattern: str) -> str:
    """Matches of a pattern with start and end, from the lengths of the pieces between them."""
    return f"""
      SELECT {keep}, value, (before + sum(length(piece) + length(value)) OVER o - length(piece) - length(value) + length(piece)) AS start
      FROM (
        SELECT {keep}, 0 AS before, unnest(regexp_extract_all({text}, '{pattern}')) AS value,
               unnest(string_split_regex({text}, '{pattern}')[:len(regexp_extract_all({text}, '{pattern}'))]) AS piece,
               generate_subscripts(regexp_extract_all({text}, '{pattern}'), 1) AS k, rid FROM {source}
      ) WINDOW o AS (PARTITION BY rid ORDER BY k)
    """


def disclosure_sql() -> str:
    q = disclosure
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    luhn = (
        f"list_sum(list_transform(range(0, length({digits})), lambda k: CASE WHEN k % 2 = 0 THEN {digits}[length({digits}) - k]::INT "
        f"WHEN {digits}[length({digits}) - k]::INT > 4 THEN 2 * {digits}[length({digits}) - k]::INT - 9 "
        f"ELSE 2 * {digits}[length({digits}) - k]::INT END)) % 10 = 0"
    )
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(value, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(x AS INT), 999) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 14 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
    }
    each = " UNION ALL ".join(
        f"SELECT rid, doc_id, {i} AS ord, '{kind}' AS kind, value, start, start + length(value) AS stop "
        f"FROM ({_places('d', 'rid, doc_id', 'text', PLAIN[kind])}) WHERE {valid[kind]}"
        for i, kind in enumerate(q.KINDS)
    )
    blanked = (
        f"array_to_string(list_transform(range(1, len(string_split_regex(side, '{PLAIN['email']}')) + 1), lambda i: "
        f"string_split_regex(side, '{PLAIN['email']}')[i] || repeat(' ', coalesce(length(regexp_extract_all(side, '{PLAIN['email']}')[i]), 0))), '')"
    )
    blanked_text = blanked.replace("(side", "(text")
    share, zz = "(both_ / n_term)", q.Z * q.Z
    near_chars, near_words = q.NEAR_CHARS, q.NEAR_WORDS
    counts = ", ".join(f"count(*) FILTER (kind = '{k}')::BIGINT AS n_{k}" for k in q.KINDS)
    joined = "coalesce(string_agg(kind || ':' || start::INT || ':' || stop::INT, ',' ORDER BY start, ord, stop), '')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    span AS MATERIALIZED ({each}),
    entity AS (
      SELECT *, kind || ':' || CASE kind WHEN 'email' THEN lower(value) WHEN 'ip' THEN value ELSE {digits} END AS entity FROM span
    ),
    side AS (
      SELECT row_number() OVER () AS rid, * FROM (
        SELECT e.rid AS doc, entity, true AS on_left, greatest(start - {near_chars}, 0) AS site,
               substring(text, greatest(start - {near_chars}, 0)::INT + 1, (start - greatest(start - {near_chars}, 0))::INT) AS side
        FROM entity e JOIN d ON d.rid = e.rid
        UNION ALL
        SELECT e.rid, entity, false, stop, substring(text, stop::INT + 1, {near_chars}) FROM entity e JOIN d ON d.rid = e.rid
      )
    ),
    clean AS (SELECT rid, doc, entity, on_left, site, {blanked} AS side FROM side),
    term AS (
      SELECT rid, doc, entity, on_left, site, lower(value) AS term, start, start + length(value) AS stop
      FROM ({_places('clean', 'rid, doc, entity, on_left, site', 'side', q.TERM)})
    ),
    whole AS (SELECT * FROM term WHERE CASE WHEN on_left THEN start > 0 OR site = 0 ELSE stop < {near_chars} END),
    nearest AS (
      SELECT * FROM whole
      QUALIFY CASE WHEN on_left THEN row_number() OVER (PARTITION BY rid ORDER BY start DESC)
                   ELSE row_number() OVER (PARTITION BY rid ORDER BY start) END <= {near_words}
    ),
    near AS (
      SELECT n.*, around FROM nearest n JOIN (SELECT rid, string_agg(term, ' ' ORDER BY start) AS around FROM nearest GROUP BY rid) USING (rid)
    ),
    tied AS (
      SELECT entity, term, count(DISTINCT doc) AS both_ FROM near GROUP BY entity, term
      HAVING count(DISTINCT doc) >= {q.SURROUNDINGS} AND count(DISTINCT around) >= {q.SURROUNDINGS}
    ),
    with_entity AS (SELECT entity, count(DISTINCT rid) AS n_entity FROM entity GROUP BY entity),
    with_term AS (
      SELECT term, count(*) AS n_term FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '{q.TERM}'))) AS term FROM d)
      GROUP BY term
    ),
    told AS (
      SELECT entity, term, disclosed FROM (
        SELECT entity, term, CASE WHEN n = n_entity THEN 0 ELSE log2(both_ * n / (n_term * n_entity)) / log2(n / n_entity) END AS disclosed
        FROM tied JOIN with_entity USING (entity) JOIN with_term USING (term), (SELECT count(*) AS n FROM d)
          WHERE ({share} + {zz} / (2 * n_term) - {q.Z} * sqrt({share} * (1 - {share}) / n_term + {zz} / (4.0 * n_term * n_term)))
                / (1 + {zz} / n_term) >= {q.SURE}
      ) WHERE disclosed >= {q.GENERALISE}
    ),
    kind_of AS (SELECT term, CASE WHEN max(disclosed) >= {q.REMOVE} THEN 'removed' ELSE 'term' END AS kind FROM told GROUP BY term),
    bare AS (SELECT rid, rid AS doc, {blanked_text} AS side FROM d),
    added AS (
      SELECT doc AS rid, {len(q.KINDS)} AS ord, kind, start, start + length(value) AS stop
      FROM ({_places('bare', 'rid, doc', 'side', q.TERM)}) JOIN kind_of ON lower(value) = term
    ),
    base AS (SELECT rid, {counts}, sha256({joined}) AS base_sha256 FROM span GROUP BY rid),
    everything AS (
      SELECT rid, {joined} AS spans FROM (
        SELECT rid, ord, kind, start, stop FROM span UNION ALL SELECT rid, ord, kind, start, stop FROM added
      ) GROUP BY rid
    )
    SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0)::BIGINT AS n_{k}' for k in q.KINDS)},
           coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN base USING (rid) LEFT JOIN everything USING (rid)
    """


def url_rules_sql() -> str:
    places, patterns = [], []
    for r in url_rules.rules():
        host, _, path = r.text.partition("/")
        row = f"({r.rank}, {_quoted(r.action)}, {_quoted(r.text)}, {_quoted(host)}, {_quoted('/' + path)})"
        places.append(row) if r.place else patterns.append(f"({r.rank}, {_quoted(r.action)}, {_quoted(r.text)}, {_quoted(r.regex)})")
    parts = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return f"""
    WITH place(rank, action, rule, h, p) AS (VALUES {', '.join(places)}),
    pattern(rank, action, pattern, regex) AS (VALUES {', '.join(patterns)}),
    page AS (
      SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{parts}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '{parts}', 2) AS path FROM pages
    ),
    address AS (SELECT DISTINCT host, path FROM page),
    fits AS (
      SELECT host, path, arg_max(rule, rank) AS rule, arg_max(action, rank) AS action FROM address JOIN place
      ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path
    ),
    reads AS (
      SELECT host, path, arg_max(pattern, rank) AS pattern, arg_max(action, rank) AS action FROM address JOIN pattern
      ON regexp_matches(host || path, regex) WHERE host || path <> '' GROUP BY host, path
    )
    SELECT page_id, host, path, rule, coalesce(fits.action, reads.action, 'allow') AS verdict,
           CASE WHEN rule IS NULL THEN pattern END AS pattern
    FROM page LEFT JOIN fits USING (host, path) LEFT JOIN reads USING (host, path)
    """


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def best_position_sql() -> str:
    b = best_position
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '{term}') AS w FROM documents),
    whole AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
    asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWERED}, '{term}')) AS t FROM benchmark),
    posting AS (
      SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d)
      WHERE t IN (SELECT t FROM asked) GROUP BY r, doc_id, n, t
    ),
    weight AS (
      SELECT t, floor({b.WEIGHT_SCALE} * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM posting, whole GROUP BY t, n_docs
    ),
    impact AS (
      SELECT r, doc_id, t, w * (({b.TF_SCALE}::BIGINT * tf)
             // (1000 * tf + 20 * ({100 - b.LENGTH_SHARE} + ({b.LENGTH_SHARE} * n * n_docs) // n_terms))) AS score
      FROM posting JOIN weight USING (t), whole
    ),
    total AS (SELECT item_id, r, doc_id, sum(score)::BIGINT AS score FROM asked JOIN impact USING (t) GROUP BY item_id, r, doc_id),
    ranked AS (
      SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
      FROM total WHERE score > 0
    )
    SELECT * FROM ranked WHERE rank <= 50
    """


def collocations_sql() -> str:
    c = collocations
    return f"""
    WITH piece AS (
      SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM (
        SELECT coalesce(lang, '{c.UNKNOWN}') AS lang, unnest(regexp_split_to_array({LOWERED}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents
      )
    ),
    start AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM piece),
    gram AS (SELECT lang, w, i, unnest(range(1, least({c.LONGEST}, len(w) - i + 1) + 1)) AS size FROM start),
    counted AS (SELECT lang, list_slice(w, i, i + size - 1) AS g, size, count(*)::BIGINT AS f FROM gram GROUP BY ALL),
    total AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY lang),
    candidate AS (SELECT * FROM counted WHERE size > 1 AND f >= {c.MIN_COUNT}),
    cut AS (SELECT *, unnest(range(1, size)) AS k FROM candidate),
    scored AS (
      SELECT cut.lang, cut.g, cut.f AS a, k, left_.f AS l, right_.f AS r, ({c.SCALE}::HUGEINT * cut.f) // (left_.f + right_.f) AS score
      FROM cut JOIN counted left_ ON left_.lang = cut.lang AND left_.g = list_slice(cut.g, 1, k)
      JOIN counted right_ ON right_.lang = cut.lang AND right_.g = list_slice(cut.g, k + 1, cut.size)
    ),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
    part AS (SELECT *, unnest(range(2, size)) AS n FROM candidate WHERE size > 2),
    inside AS (
      SELECT lang, list_slice(g, i, i + n - 1) AS g, max(f) AS most
      FROM (SELECT *, unnest(range(1, size - n + 2)) AS i FROM part) GROUP BY ALL
    ),
    ranked AS (
      SELECT lang, a, l, r, score, array_to_string(g, ' ') AS phrase FROM lowest LEFT JOIN inside USING (lang, g)
      WHERE most IS NULL OR 100 * most < {c.COVERED} * a
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INTEGER AS rank, phrase, a, l, r, n,
           score::BIGINT AS score
    FROM ranked JOIN total USING (lang) QUALIFY rank <= {c.TOP}
    """


SQL = {
    "op1_licenses": licenses_sql(),
    "op4_line_quality": line_quality_sql(),
    "op8_chat_format": chat_format_sql(),
    "op10_disclosure": disclosure_sql(),
    "op11_url_rules": url_rules_sql(),
    "op12_best_position": best_position_sql(),
    "op13_collocations": collocations_sql(),
}
