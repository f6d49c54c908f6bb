"""Posting schemas."""

from __future__ import annotations

from pyspark.sql import types as T

from stellwerk.fixed import HEADERS

#: Key columns plus every header; all text, scores as integers.
RUN_FIELDS = ["job_id", "description"] + HEADERS

RUN_SCHEMA = T.StructType(
    [T.StructField(name, T.IntegerType() if name == "relevance_score" else T.StringType()) for name in RUN_FIELDS]
)

RAW_CSV_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in HEADERS])

#: Columns of a posting parsed from a result page.
CARD_FIELDS = [
    "title",
    "company",
    "location",
    "link",
    "job_id",
    "posted_at_relative",
    "description",
    "work_location_type",
    "employment_type",
]

#: Columns a detail page may overwrite. NULL means "page says nothing", '' overwrites.
DETAIL_FIELDS = ["title", "company", "location", "description", "work_location_type", "employment_type"]

PROVIDER_CONF = T.StructType(
    [
        T.StructField("enabled", T.BooleanType()),
        T.StructField("max_results", T.IntegerType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("locations", T.ArrayType(T.StringType())),
    ]
)

#: Search profile document, as far as any stage reads it.
SEARCH_PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("profile_name", T.StringType()),
        T.StructField("active_providers", T.MapType(T.StringType(), PROVIDER_CONF)),
        T.StructField(
            "search_parameters",
            T.StructType(
                [
                    T.StructField("locations", T.ArrayType(T.StringType())),
                    T.StructField("posted_within_days", T.IntegerType()),
                    T.StructField("fetch_full_description", T.BooleanType()),
                ]
            ),
        ),
        T.StructField("search_queries", T.ArrayType(T.StringType())),
        T.StructField("scoring_weights", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField(
            "filtering",
            T.StructType(
                [
                    T.StructField("min_relevance_score", T.DoubleType()),
                    T.StructField("exclude_keywords", T.ArrayType(T.StringType())),
                    T.StructField("required_keywords", T.ArrayType(T.StringType())),
                    T.StructField("exclude_companies", T.ArrayType(T.StringType())),
                ]
            ),
        ),
        T.StructField(
            "work_preferences",
            T.StructType(
                [
                    T.StructField("work_location_types", T.ArrayType(T.StringType())),
                    T.StructField("employment_types", T.ArrayType(T.StringType())),
                    T.StructField("exclude_types", T.ArrayType(T.StringType())),
                ]
            ),
        ),
        T.StructField(
            "language_requirements", T.StructType([T.StructField("required", T.ArrayType(T.StringType()))])
        ),
        T.StructField(
            "output",
            T.StructType(
                [
                    T.StructField("formats", T.ArrayType(T.StringType())),
                    T.StructField("base_filename", T.StringType()),
                    T.StructField("separate_files_by_type", T.BooleanType()),
                ]
            ),
        ),
        T.StructField("report", T.StructType([T.StructField("top_n_jobs", T.IntegerType())])),
    ]
)
