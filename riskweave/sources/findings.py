"""Findings of external classifiers -> (object_id, input_ord, entity_type, count, confidence, source)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.exposure import likelihood_confidence, severity_confidence
from ..registry import canonical

MACIE = "object_id string, findings array<struct<severity:struct<score:int>,classificationDetails:struct<result:struct<sensitiveData:array<struct<category:string,detections:array<struct<type:string,count:bigint>>>>>>>>"
DLP = "object_id string, findings array<struct<infoType:struct<name:string>,likelihood:string>>"
PURVIEW = "object_id string, classifications array<struct<typeName:string,count:bigint,confidence:double>>"
PRESIDIO = "object_id string, entity_type string, start int, `end` int, score double"


def _grouped(rows: DataFrame, source: str, ord_: int) -> DataFrame:
    out = rows.groupBy("object_id", "entity_type").agg(F.sum("count").alias("count"), F.max("confidence").alias("confidence"))
    return out.select("object_id", F.lit(ord_).alias("input_ord"), "entity_type", "count", "confidence", F.lit(source).alias("source"))


def macie(rows: DataFrame, ord_: int = 0) -> DataFrame:
    f = rows.select("object_id", F.explode("findings").alias("f"))
    s = f.select("object_id", F.col("f.severity.score").alias("s"), F.explode("f.classificationDetails.result.sensitiveData").alias("d"))
    d = s.select("object_id", "s", F.explode("d.detections").alias("x"))
    return _grouped(d.select("object_id", canonical(F.col("x.type")).alias("entity_type"), F.coalesce("x.count", F.lit(1)).alias("count"), severity_confidence(F.col("s")).alias("confidence")), "macie", ord_)


def dlp(rows: DataFrame, ord_: int = 0) -> DataFrame:
    f = rows.select("object_id", F.explode("findings").alias("f"))
    return _grouped(f.select("object_id", canonical(F.col("f.infoType.name")).alias("entity_type"), F.lit(1).cast("long").alias("count"), likelihood_confidence(F.col("f.likelihood")).alias("confidence")), "dlp", ord_)


def purview(rows: DataFrame, ord_: int = 0) -> DataFrame:
    """MICROSOFT.<group>.<country>.<type> names give their last part where no alias is known."""
    f = rows.select("object_id", F.explode("classifications").alias("f"))
    name = F.upper("f.typeName")
    short = F.when(F.startswith(name, F.lit("MICROSOFT.")) & (F.size(F.split(name, r"\.")) >= 3), F.substring_index(name, ".", -1)).otherwise(name)
    return _grouped(f.select("object_id", canonical(short).alias("entity_type"), F.coalesce("f.count", F.lit(1)).alias("count"), F.coalesce("f.confidence", F.lit(0.85)).alias("confidence")), "purview", ord_)


def presidio(rows: DataFrame, ord_: int = 0) -> DataFrame:
    return _grouped(rows.select("object_id", canonical(F.col("entity_type")).alias("entity_type"), F.lit(1).cast("long").alias("count"), F.col("score").alias("confidence")), "presidio", ord_)
