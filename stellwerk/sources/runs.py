"""Run folders, raw exports, link lists and captured pages as DataFrames.

Each scan adds ``seq``, the arrival order that first-wins rules need, and where rows
come from a run, ``run_id``.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from stellwerk import fixed
from stellwerk.functions.extra import keys_of_items, keys_of_line
from stellwerk.functions.links import provider_from_url
from stellwerk.functions.text import text
from stellwerk.schema import RUN_SCHEMA
from stellwerk.session import materialise
from stellwerk.sources.sinks import CSV_OPTIONS


#: A run file (``<run>/jobs.json``), or a part of what the engine wrote for a run in its place.
_RUN_PATH = r"/([^/]+)/(jobs\.json|all_jobs_raw\.json)(?:/(?:run_id=([^/]+)/)?(part-[^/]*))?$"
#: A run file's list is read with scores as text: other JSON kinds are problems to report, not silence.
_LOOSE = ", ".join(f"{f.name} string" for f in RUN_SCHEMA.fields)


def _run_texts(spark: SparkSession, folder: str, parts: bool) -> DataFrame:
    """Whole run files, or the lines of runs written in parts: run_id, file, value."""
    path = F.col("_metadata.file_path")
    name = "part-*" if parts else "{" + ",".join(fixed.RUN_FILES) + "}"
    found = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(folder, wholetext=not parts)
    )
    said = found.select("value", *[F.regexp_extract(path, _RUN_PATH, k).alias(n) for k, n in enumerate(["folder", "file", "part_of", "part"], 1)])
    said = said.where((F.col("file") != "") & ((F.col("part") != "") if parts else (F.col("part") == "")))
    return said.select(F.coalesce(F.nullif("part_of", F.lit("")), "folder").alias("run_id"), "folder", "file", "value")


def _chosen(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Whole files and written parts that count: the second name only where the first does not exist."""
    first, second = fixed.RUN_FILES
    path = F.col("path")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(
        F.regexp_extract(path, _RUN_PATH, 1).alias("folder"), F.regexp_extract(path, _RUN_PATH, 2).alias("name")
    )
    # One row per run folder, less than the driver's own list of these files. Joined by a shuffle, a run's texts would meet in one task.
    hidden = F.broadcast(files.where(F.col("name") == first).select("folder", F.lit(second).alias("file")).distinct())
    return tuple(_run_texts(spark, folder, parts).join(hidden, ["folder", "file"], "left_anti") for parts in (False, True))


_STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}


def _wrapped(value: Column) -> Column:
    return F.concat(F.lit('{"v":'), value, F.lit("}"))


def _items(value: Column) -> Column:
    """The list a run file holds; NULL unless the file as a whole is one."""
    wrapped, options = _wrapped(value), {**_STRICT, "columnNameOfCorruptRecord": "_corrupt"}
    read = F.from_json(wrapped, f"v array<struct<{_LOOSE.replace(' string', ':string')}>>, _corrupt string", options)
    # As the value of a key it could go on with further keys, as an element of a list with further elements or ends; not as both.
    alone = F.from_json(F.concat(F.lit('{"v":['), value, F.lit("]}")), "v array<string>, _corrupt string", options)
    whole = value.rlike(r"^\s*\[") & value.rlike(r"\]\s*$") & read["_corrupt"].isNull() & alone["_corrupt"].isNull() & (F.size(alone["v"]) == 1)
    return F.when(whole, read["v"])


def _with_score(df: DataFrame) -> DataFrame:
    number = F.expr("try_cast(relevance_score AS double)")
    return df.withColumn("relevance_score", F.when(number == F.floor(number), number.cast("int")))


def scan_run_folders(spark: SparkSession, folder: str, extra: bool = False) -> DataFrame:
    """Postings of ``<folder>/<run>/jobs.json``, else ``all_jobs_raw.json``.

    Either may be one JSON list or what :func:`stellwerk.sources.sinks.write_run` leaves, a folder
    of parts with a posting per line. The choice goes by existence, so an unreadable
    preferred file hides the other. A file that is not a JSON list as a whole contributes
    nothing; see :func:`run_problems`. A list is read by one task; runs, and the parts of a
    run, spread over tasks. With ``extra`` a last column of that name holds the keys that are no
    run fields, as a JSON object (NULL without any); see :func:`stellwerk.functions.extra.extra_value`.
    """
    files, parts = _chosen(spark, folder)
    value = F.col("value")
    items = _items(value)
    if extra:
        others = keys_of_items(F.from_json(_wrapped(value), "v array<variant>", _STRICT)["v"])
        items = F.when(items.isNotNull(), F.arrays_zip(items.alias("r"), others.alias("extra")))
    else:
        items = F.transform(items, lambda r: F.struct(r.alias("r")))
    more = ["extra"] if extra else []
    listed = files.select("run_id", F.posexplode(items).alias("seq", "i")).select(
        "run_id", F.col("seq").cast("long").alias("seq"), "i.r.*", *[f"i.{c}" for c in more]
    )
    line = F.from_json("value", f"seq long, {_LOOSE}", _STRICT).alias("r")
    written = parts.select("run_id", line, *[keys_of_line(value).alias(c) for c in more]).select(
        "run_id", F.coalesce("r.seq", F.monotonically_increasing_id()).alias("seq"), *[f"r.{n}" for n in RUN_SCHEMA.names], *more
    )
    return _with_score(listed.unionByName(written))


def run_problems(spark: SparkSession, folder: str) -> DataFrame:
    """``run_id, file, problem, n``: files that are no JSON list, and scores that are no whole number."""
    files, _ = _chosen(spark, folder)
    items = _items(F.col("value"))
    number = "try_cast(x.relevance_score AS double)"
    odd = F.expr(f"size(filter(items, x -> x.relevance_score IS NOT NULL AND ({number} IS NULL OR {number} <> floor({number}))))")
    read = files.select("run_id", "file", items.alias("items"))
    rejected = read.where("items IS NULL").select("run_id", "file", F.lit("not a JSON list").alias("problem"), F.lit(1).alias("n"))
    scores = read.where("items IS NOT NULL").select("run_id", "file", F.lit("score is no whole number").alias("problem"), odd.alias("n"))
    return rejected.union(scores.where("n > 0"))


def scan_run_table(spark: SparkSession, path: str) -> DataFrame:
    """Postings written by :func:`stellwerk.sources.sinks.write_run`, by ``run_id``."""
    return spark.read.schema(run_table_schema()).json(path)


def run_table_schema() -> StructType:
    return StructType([*RUN_SCHEMA.fields, StructField("seq", LongType()), StructField("run_id", StringType())])


def scan_raw_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``all_jobs_raw.csv`` below ``folder``: the fixed headers as text, by name.

    The name may be a file or, as :func:`stellwerk.sources.sinks.write_run` leaves it, a
    folder of parts. Files are grouped by their first line, so columns may stand in any
    order; a missing one reads as '', and ``others`` lists the values of columns beyond the
    fixed ones. ``path`` and ``seq`` give file and row order. Quoted fields may span lines,
    so a file is read by one task, in order.
    """
    path = F.col("_metadata.file_path")
    wanted = path.rlike(rf"/{re.escape(fixed.RAW_CSV)}(/[^/]*)?$")
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(folder).where(wanted)
    placed = lines.select("value", path.alias("path"), F.monotonically_increasing_id().alias("at"))
    first = placed.groupBy("path").agg(F.min_by("value", "at").alias("header"))
    groups: dict[str, list[str]] = {}
    for row in first.toLocalIterator():  # names of files, not their contents
        groups.setdefault(row.header, []).append(row.path)
    out = spark.createDataFrame([], f"{', '.join(f'{h} string' for h in fixed.HEADERS)}, others array<string>, path string, seq long")
    for header, paths in sorted(groups.items()):
        names = next(csv.reader([header.lstrip("\ufeff")]), [])
        # Columns get their place as name, so that repeated or empty headers do no harm.
        schema = ", ".join(f"c{k} string" for k in range(len(names)))
        rows = spark.read.schema(schema).options(**CSV_OPTIONS).option("multiLine", True).option("enforceSchema", True).csv(sorted(paths))
        place = {name: f"c{k}" for k, name in enumerate(names)}
        extra = [f"c{k}" for k, name in enumerate(names) if name not in fixed.HEADERS or place[name] != f"c{k}"]
        out = out.union(
            rows.select(
                *[text(place[h]).alias(h) if h in place else F.lit("").alias(h) for h in fixed.HEADERS],
                (F.array(*extra) if extra else F.array().cast("array<string>")).alias("others"),
                path.alias("path"),
                F.monotonically_increasing_id().alias("seq"),
            )
        )
    return out


def scan_link_list(spark: SparkSession, path: str) -> DataFrame:
    """Postings to inject by link, from a CSV with a ``link`` column."""
    name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    rows = (
        spark.read.options(**CSV_OPTIONS)
        .option("multiLine", True)
        .csv(path)
        .select("link", name.alias("file"), F.monotonically_increasing_id().alias("seq"))
    )
    return manual_postings(rows, F.col("file"))


def manual_postings(links: DataFrame, source: Column, now: Column | None = None) -> DataFrame:
    """Template postings for ``link, seq`` rows; blank links go.

    The id is the row's ``seq``, so two links never collapse by sharing a clock value.
    """
    out = links.where(F.coalesce(F.col("link"), F.lit("")) != "")
    fixed_fields = {k: F.lit(v) for k, v in fixed.MANUAL_TEMPLATE.items()}
    return out.select(
        "seq",
        F.col("seq").cast("string").alias("job_id"),
        provider_from_url(F.col("link"), default=fixed.FALLBACK_PROVIDER).alias("provider"),
        "link",
        *[v.alias(k) for k, v in fixed_fields.items()],
        F.concat(F.lit("Manual | "), source).alias("search_criteria"),
        F.lit(0).alias("relevance_score"),
        (now if now is not None else F.lit(None).cast("string")).alias("scraped_at"),
    )


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages ``page_id, url, html`` with the portal the URL belongs to."""
    return spark.read.parquet(path).withColumn("provider", provider_from_url(F.col("url")))


def with_arrival_order(df: DataFrame, *order: str) -> DataFrame:
    """Unique ``seq`` that follows the given columns inside each task's rows.

    For inputs without an order of their own. Range partitioning makes ids grow with
    the order across tasks, without one task seeing everything. It samples its input before it
    reads it, so the input is written once and whatever made it, such as parsed pages, runs once.
    """
    return materialise(df).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())


__all__ = [
    "manual_postings",
    "scan_link_list",
    "scan_pages",
    "run_problems",
    "scan_raw_csv",
    "scan_run_folders",
    "scan_run_table",
    "with_arrival_order",
]
