"""Annotated corpora of several layouts -> id, text, entities array<struct<start,end,type,text>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PLACE = "start:int,end:int,start_offset:int,end_offset:int,label:string,type:string,text:string,value:string"
SAMPLE = (
    f"id string, source_text string, text string, content string, privacy_mask string, span_labels array<struct<{_PLACE}>>, annotations array<struct<{_PLACE}>>, "
    f"entities array<struct<{_PLACE}>>, labels array<struct<{_PLACE}>>"
)


def _entities(found: Column, text: Column) -> Column:
    def one(e: Column) -> Column:
        start, end = F.coalesce(e["start"], e["start_offset"], F.lit(0)), F.coalesce(e["end"], e["end_offset"], F.lit(0))
        cut = F.substr(text, start + 1, F.greatest(F.lit(0), end - start))
        return F.struct(start.alias("start"), end.alias("end"), F.coalesce(e["type"], e["label"], F.lit("UNKNOWN")).alias("type"), F.coalesce(e["text"], e["value"], cut).alias("text"))

    return F.transform(found, one)


def normal(samples: DataFrame) -> DataFrame:
    """Rows of SAMPLE: annotations beside a privacy mask, an entity list, or labels with places, in this order."""
    text = F.coalesce("source_text", "text", "content")
    found = F.when(F.col("privacy_mask").isNotNull(), F.coalesce("span_labels", "annotations")).when(F.col("entities").isNotNull(), F.col("entities")).otherwise(F.col("labels"))
    rows = samples.select(F.col("id"), text.alias("text"), found.alias("found")).where("text is not null and text <> ''")
    return rows.select("id", "text", F.coalesce(_entities(F.col("found"), F.col("text")), F.array().cast("array<struct<start:int,end:int,type:string,text:string>>")).alias("entities"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, or files with one list or object."""
    lines = path.endswith(".jsonl")
    return normal(spark.read.schema(SAMPLE).option("multiLine", not lines).json(path))
