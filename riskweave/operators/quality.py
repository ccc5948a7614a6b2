"""Detection quality: detections against annotated entities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_IOU = 0.5


def _one_to_one(pdf: pd.DataFrame) -> pd.DataFrame:
    used_d, used_t, keep = set(), set(), []
    for at, d, t in pdf.sort_values(["d_ord", "iou", "t_ord"], ascending=[True, False, True])[["d_ord", "t_ord"]].itertuples():
        if d not in used_d and t not in used_t:
            used_d.add(d)
            used_t.add(t)
            keep.append(at)
    return pdf.loc[keep]


def matched(truth: DataFrame, found: DataFrame, key: str = "id", iou: float = LEAST_IOU) -> DataFrame:
    """Pairs of a detection and an annotation of one type that overlap enough, each used once."""
    t = truth.select(key, "entity_type", F.col("start").alias("t_start"), F.col("end").alias("t_end"), F.xxhash64("entity_type", "start", "end").alias("t_ord"))
    d = found.select(key, "entity_type", F.col("start").alias("d_start"), F.col("end").alias("d_end"), F.col("start").alias("d_ord"))
    common = F.least("t_end", "d_end") - F.greatest("t_start", "d_start")
    share = common / (F.greatest("t_end", "d_end") - F.least("t_start", "d_start"))
    pairs = t.join(d, [key, "entity_type"]).where(common > 0).withColumn("iou", share).where(F.col("iou") >= iou)
    return pairs.groupBy(key, "entity_type").applyInPandas(_one_to_one, pairs.schema)


def metrics(truth: DataFrame, found: DataFrame, key: str = "id", by_type: bool = False) -> DataFrame:
    """tp, fp, fn, precision, recall, f1; 0 where nothing is to be divided by."""
    rows = truth.select("entity_type", F.lit("t").alias("k")).unionByName(found.select("entity_type", F.lit("d").alias("k"))).unionByName(matched(truth, found, key).select("entity_type", F.lit("m").alias("k")))
    counts = rows.groupBy(*(["entity_type"] if by_type else [])).agg(F.count_if(F.col("k") == "m").alias("tp"), F.count_if(F.col("k") == "d").alias("d"), F.count_if(F.col("k") == "t").alias("t"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, d, t = F.col("tp"), F.col("d"), F.col("t")
    return counts.select(*(["entity_type"] if by_type else []), tp, (d - tp).alias("fp"), (t - tp).alias("fn"), share(tp, d).alias("precision"), share(tp, t).alias("recall"), share(2 * tp, d + t).alias("f1"))
