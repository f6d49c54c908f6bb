"""Configuration documents: candidate profile, skill lexicon, search profiles.

These are small documents written by hand. Lexicon entries come as plain text or
as one text per language; :func:`flatten_entries` brings both to one row per
candidate text.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from stellwerk.schema import SEARCH_PROFILE_SCHEMA


class ConfigError(TypeError):
    """A configuration document whose root is not an object."""


@dataclass(frozen=True)
class Entry:
    """One lexicon entry: a label and the lower-cased texts that stand for it."""

    list_name: str
    category: str
    entry_no: int
    label: str
    candidates: tuple[str, ...]


@dataclass(frozen=True)
class Profile:
    """Candidate profile: skill lists by name, and known companies."""

    entries: tuple[Entry, ...]
    known_companies: tuple[str, ...] = field(default=())

    def of(self, category: str) -> list[Entry]:
        return [e for e in self.entries if e.category == category]


def load_json(spark: SparkSession, path: str) -> dict:
    """Read one small JSON object through Spark's file systems."""
    doc = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    if not isinstance(doc, dict):
        raise ConfigError(f"{path}: the root must be an object")
    return doc


def flatten_entries(categories: dict[str, list], list_name: str) -> tuple[Entry, ...]:
    """Entries of every category; labels are the English text where languages differ."""
    flat = []
    for category, items in categories.items():
        for number, item in enumerate(items):
            texts = list(item.values()) if isinstance(item, dict) else [item]
            label = item["en"] if isinstance(item, dict) else item
            flat.append(Entry(list_name, category, number, label, tuple(dict.fromkeys(str(t).lower() for t in texts))))
    return tuple(flat)


def profile_from_dict(doc: dict) -> Profile:
    return Profile(flatten_entries(doc.get("skills", {}), "profile"), tuple(doc.get("known_companies", ())))


def load_profile(spark: SparkSession, path: str) -> Profile:
    return profile_from_dict(load_json(spark, path))


def load_lexicon(spark: SparkSession, path: str) -> tuple[Entry, ...]:
    return flatten_entries(load_json(spark, path), "global")


def _profile_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.json)?(?:\.example)?$", 1).alias("profile"),
        F.col("value"),
    )


def load_search_profiles(spark: SparkSession, path: str) -> DataFrame:
    """One row per search profile file, ``profile`` being the file's stem.

    Accepts a file, a folder or a glob. A document whose root is not an object
    fails the job when its row is read.
    """
    raw = _profile_texts(spark, path)
    checked = raw.withColumn(
        "value",
        F.when(F.col("value").rlike(r"^\s*\{"), F.col("value")).otherwise(
            F.raise_error(F.concat(F.lit("search profile root must be an object: "), F.col("profile")))
        ),
    )
    return checked.select("profile", F.from_json("value", SEARCH_PROFILE_SCHEMA).alias("d")).select("profile", "d.*")


def checked_profiles(spark: SparkSession, path: str, wanted: Sequence[str] | None = None) -> DataFrame:
    """The profiles below ``path`` with an ``error``, instead of failing the job; see :func:`read_profiles`.

    With ``wanted`` only these count, and those without a document are among the rows. Spark's scan passes over files
    of no byte at all: such a one is as good as absent.
    """
    found = read_profiles(_profile_texts(spark, path))
    if wanted is None:
        return found
    asked = spark.createDataFrame([(w,) for w in dict.fromkeys(wanted)], "profile string")
    absent = F.when(F.col("_read").isNull(), F.lit("no such profile")).otherwise(F.col("error"))
    return asked.join(found.withColumn("_read", F.lit(True)), "profile", "left").withColumn("error", absent).drop("_read")


def read_profiles(texts: DataFrame) -> DataFrame:
    """``profile, value`` to the profile's settings and ``error``.

    The error is NULL for a document that is one JSON object with every setting of its kind. Otherwise it says what is
    wrong, and no setting of the document counts. A NULL or empty document is no JSON object.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"}
    kinds = f"v {SEARCH_PROFILE_SCHEMA.simpleString()}, _corrupt string"
    inside = F.concat(F.lit('{"v":'), F.col("value"), F.lit("}"))
    # One element of a list, and one value of a key: no text that closes either early is both.
    alone = F.from_json(F.concat(F.lit('{"v":['), F.col("value"), F.lit("]}")), "v array<variant>, _corrupt string", options)
    keyed = F.from_json(inside, "v variant, _corrupt string", options)
    read = texts.select("profile", "value", alone.alias("a"), keyed.alias("k"), F.from_json(inside, kinds, options).alias("d"))
    single = F.col("a._corrupt").isNull() & (F.size("a.v") == 1) & F.col("k._corrupt").isNull()
    error = (
        F.when(~F.coalesce(single, F.lit(False)), F.lit("no valid JSON"))
        .when(~F.col("value").rlike(r"^\s*\{"), F.lit("the root must be an object"))
        .when(F.col("d._corrupt").isNotNull(), F.lit("a setting is not of its kind"))
    )
    settings = read.select("profile", "d.v", error.alias("error")).withColumn("v", F.when(F.col("error").isNull(), F.col("v")))
    return settings.select("profile", "v.*", "error")


def lexicon_frame(spark: SparkSession, entries: tuple[Entry, ...]) -> DataFrame:
    """One row per candidate text, for the join form of skill matching."""
    rows = [
        (e.list_name, e.category, e.entry_no, e.label, candidate)
        for e in entries
        for candidate in e.candidates
    ]
    return spark.createDataFrame(
        rows, "list_name string, category string, entry_no int, label string, candidate string"
    )
