"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern over host and path: ``||`` stands before a host or any of its subdomains,
``^`` for a separator or an end, ``*`` for anything, the rest for itself. A token is a whole run
of letters and digits; every address that fits a rule holds each token that the pattern bounds on both
sides. A rule is filed under the one of its tokens that the fewest addresses hold, counted over
all of them. The tokens of an address fetch its candidate rules, and only these run as regular expressions.
Rules without a bounded token are filed under the empty token, which every address fetches.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places (host and path) with their verdicts, the longest of which decides.
PLACES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Patterns of the method: what they block unless another one allows it.
PATTERNS = (
    ("block", "^casino^"),
    ("block", "^bets^"),
    ("block", "^betting^"),
    ("block", "^poker^"),
    ("block", "^pills^"),
    ("block", "^viagra^"),
    ("block", "^xxx^"),
    ("block", "^porn^"),
    ("block", "^payday^*loan"),
    ("block", "^warez^"),
    ("block", "||ads."),
    ("block", "||doubleclick.net^"),
    ("block", "/wp-login.php^"),
    ("allow", "||edu/library/"),
    ("allow", "/responsible-gaming^"),
)
#: Up to so many rules the index is broadcast; beyond, tokens are joined by shuffles, with those of more
#: addresses than SPREAD dealt out to several tasks.
BROADCAST_RULES, SPREAD = 20_000, 100_000


@dataclass(frozen=True)
class Rule:
    """``rank`` orders rules by precedence, the highest decides."""

    rank: int
    action: str
    text: str
    place: bool
    regex: str
    tokens: tuple[str, ...]


def regex_of(pattern: str) -> str:
    """The regular expression of a pattern, over host and path."""
    out, rest = "(?s)", pattern
    if rest.startswith("||"):
        out, rest = r"(?s)^(?:[^/]*\.)?", rest[2:]
    for k, c in enumerate(rest):
        if c == "*":
            out += ".*"
        elif c == "^":
            out += "(?:^|[^A-Za-z0-9])" if k == 0 else "(?:[^A-Za-z0-9]|$)"
        else:
            out += re.escape(c)
    return out


def bounded_tokens(pattern: str) -> tuple[str, ...]:
    """Lower-cased tokens that every matching address holds as a whole."""
    marked = "^" + pattern[2:] if pattern.startswith("||") else f"*{pattern}"
    marked += "*"
    found = re.finditer("[A-Za-z0-9]+", marked)
    return tuple(sorted({m.group().lower() for m in found if marked[m.start() - 1] != "*" and marked[m.end()] != "*"}))


def rules(places: Sequence[tuple[str, str]] = PLACES, patterns: Sequence[tuple[str, str]] = PATTERNS) -> list[Rule]:
    """Rules by rising precedence: blocking patterns, allowing patterns, places by length, each by length.

    Of equally long places that with the longer host decides, of equal ones the first given.
    """

    def length(k: int, text: str) -> tuple[int, int, int]:
        return len(text), len(text.split("/")[0]), -k

    known = [((0, action == "allow", *length(k, p)), action, p, p, False) for k, (action, p) in enumerate(patterns)]
    known += [((1, False, *length(k, p)), action, p, f"||{p}", True) for k, (action, p) in enumerate(places)]
    if odd := {action for _, action, *_ in known} - {"allow", "block"}:
        raise ValueError(f"a rule allows or blocks, it does not {sorted(odd)}")
    return [
        Rule(rank, action, text, place, regex_of(pattern), bounded_tokens(pattern))
        for rank, (_, action, text, pattern, place) in enumerate(sorted(known, key=lambda x: x[0]))
    ]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty if it is null or has no ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    given = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(given, parts, 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(given, parts, 2)


def tokens_of(address: Column) -> Column:
    """Distinct tokens of an address, and the empty one."""
    lowered = F.translate(address, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.concat(F.split(lowered, "[^a-z0-9]+"), F.array(F.lit(""))))


def _table(df: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """A small table of the driver's, as one literal."""
    said = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return df.sparkSession.range(1, numPartitions=1).select(F.inline(said))


def index(addresses: DataFrame, known: Sequence[Rule]) -> list[tuple[str, int, Rule]]:
    """(token, number of addresses that hold it, rule) for every rule, under its rarest token.

    ``addresses`` has a column ``tokens``. What comes to the driver is one count per token of the rules.
    """
    wanted = sorted({t for r in known for t in (r.tokens or ("",))})
    if not wanted:
        return []
    table = _table(addresses, [{"token": t} for t in wanted], "token:string")
    table = F.broadcast(table) if len(wanted) <= BROADCAST_RULES else table
    one = addresses.select(F.explode("tokens").alias("token"))
    if len(wanted) <= BROADCAST_RULES:
        held = one.join(table, "token").groupBy("token").agg(F.count("*").alias("n"))
    else:  # summed before the join, so that frequent tokens do not meet in one task
        held = one.groupBy("token").agg(F.count("*").alias("n")).join(table, "token")
    counts = {r.token: r.n for r in held.collect()}
    rarest = [(min(r.tokens or ("",), key=lambda t: (counts.get(t, 0), t)), r) for r in known]
    return [(t, counts.get(t, 0), r) for t, r in rarest]


def _candidates(addresses: DataFrame, filed: list[tuple[str, int, Rule]]) -> DataFrame:
    """Addresses with each rule that one of their tokens fetches: id, mark, address, rank, regex."""
    rows = [
        {"token": t, "shares": max(1, math.ceil(n / SPREAD)), "rank": r.rank, "regex": r.regex} for t, n, r in filed if n > 0
    ]
    table = _table(addresses, rows, "token:string,shares:int,rank:int,regex:string")
    one = addresses.select("id", "mark", "address", F.explode("tokens").alias("token"))
    if len(rows) <= BROADCAST_RULES:
        return one.join(F.broadcast(table), "token")
    # A frequent token's addresses go to as many tasks as it has shares, its rules to each of them.
    hot = {t: math.ceil(n / SPREAD) for t, n, _ in filed if n > SPREAD}
    shares = F.coalesce(F.try_element_at(F.from_json(F.lit(json.dumps(hot)), "map<string,int>"), F.col("token")), F.lit(1))
    one = one.withColumn("share", F.pmod(F.xxhash64("id", "mark"), shares))
    dealt = table.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares").cast("bigint") - 1)))
    return one.join(dealt, ["token", "share"])


def judge(
    pages: DataFrame,
    places: Sequence[tuple[str, str]] = PLACES,
    patterns: Sequence[tuple[str, str]] = PATTERNS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``id_col``, host, path, rule, verdict, pattern for every row.

    The longest place that fits decides; ``rule`` names it. Without one the patterns do: an allowing one
    before the blocking ones; ``pattern`` names the longest that fits. What nothing blocks is allowed, so
    a null or empty address, or one without ``://``, is, with empty host and path. Places fit a host as it stands, with a port if
    it has one. Repeated rows get equal results; other columns are not read.
    """
    known = rules(places, patterns)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("address", F.concat("host", "path")).withColumn("mark", F.xxhash64("address"))
    addresses = rows.where("address != ''").select("id", "mark", "address", tokens_of(F.col("address")).alias("tokens"))
    hits = _candidates(addresses, index(addresses, known)).where(F.regexp_like("address", F.col("regex")))
    best = hits.groupBy(F.col("id").alias("i"), F.col("mark").alias("m")).agg(F.max("rank").alias("rank"))
    joined = rows.join(best, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left")
    said = [{"rank": r.rank, "text": r.text, "place": r.place, "action": r.action} for r in known]
    table = _table(pages, said, "rank:int,text:string,place:boolean,action:string").withColumnRenamed("rank", "number")
    table = F.broadcast(table) if len(said) <= BROADCAST_RULES else table
    joined = joined.join(table, F.col("rank") == F.col("number"), "left")
    return joined.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.when(F.col("place"), F.col("text")).alias("rule"),
        F.coalesce("action", F.lit("allow")).alias("verdict"),
        F.when(~F.col("place"), F.col("text")).alias("pattern"),
    )
