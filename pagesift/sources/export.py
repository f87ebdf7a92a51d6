"""Sinks: entity tables (O04) and the tagged record stream."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_timestamp

RECORD_ORDER = {"run": 0, "place": 1, "review": 2, "review-photo": 3}


def _camel(name: str) -> str:
    return re.sub(r"_([a-z])", lambda m: m.group(1).upper(), name)


def _record_struct(df: DataFrame) -> F.Column:
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName() == "timestamp":
            c = iso_timestamp(c)
        cols.append(c.alias(_camel(f.name)))
    return F.struct(*cols)


def run_record(summary: DataFrame, job_keywords: DataFrame, progress: DataFrame, max_places: int, max_reviews: int) -> DataFrame:
    """The run's one row: the four counts, ``job`` (regions, keywords in order, limits) and ``checkpoint`` (per region
    the number of completed keywords and places).  Only job-sized lists are gathered; completed ids stay in the ledger."""
    kw = progress.filter(F.col("place_id").isNull())
    ids = progress.filter(F.col("place_id").isNotNull()).groupBy("region").agg(F.count(F.lit(1)).alias("completed_places"))
    state = (kw.groupBy("region").agg(F.sum(F.col("completed").cast("bigint")).alias("completed_keywords"), F.count(F.lit(1)).alias("keywords"))
             .join(ids, "region", "left")
             .select(F.struct("region", "keywords", "completed_keywords", F.coalesce("completed_places", F.lit(0)).alias("completed_places")).alias("s")))
    order = job_keywords.select(F.struct("keyword_index", "keyword").alias("k"))
    parts = (summary.select(F.struct(*summary.columns).alias("n"), F.lit(None).cast(order.schema["k"].dataType).alias("k"), F.lit(None).cast(state.schema["s"].dataType).alias("s"))
             .unionByName(order, allowMissingColumns=True).unionByName(state, allowMissingColumns=True))
    one = parts.agg(F.max("n").alias("n"), F.array_sort(F.collect_set("k")).alias("k"), F.array_sort(F.collect_set("s")).alias("s"))
    return one.select("n.*", F.struct(F.transform("s", lambda x: x["region"]).alias("regions"), F.transform("k", lambda x: x["keyword"]).alias("keywords"),
                                      F.lit(max_places).alias("max_places"), F.lit(max_reviews).alias("max_reviews")).alias("job"),
                      F.col("s").alias("checkpoint"))


def export_tagged_records(run: DataFrame, place_rows: DataFrame, reviews: DataFrame, photos: DataFrame,
                          path: str) -> None:
    """NDJSON lines ``{"type": …, "data": {…}}`` in run -> place -> review ->
    review-photo order; nulls are written.  Lines are range-partitioned on (kind, id),
    so every kind is written by as many tasks as its records need, and the files in
    name order give the record order."""
    parts = []
    for kind, df in (("run", run), ("place", place_rows), ("review", reviews), ("review-photo", photos)):
        line = F.to_json(F.struct(F.lit(kind).alias("type"), _record_struct(df).alias("data")),
                         {"ignoreNullFields": "false"})
        key = F.coalesce(F.col("id").cast("string"), F.lit("")) if "id" in df.columns else F.lit("")
        parts.append(df.select(F.lit(RECORD_ORDER[kind]).alias("_ord"), key.alias("_id"), line.alias("value")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    (u.repartitionByRange("_ord", "_id").sortWithinPartitions("_ord", "_id").select("value")
     .write.mode("overwrite").text(path))


def export_entity_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One directory per entity (search_results, places, reviews, photos, …)."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/{name}")
