"""Reports as lines of text: a DataFrame with one column `value`, or one whole document; save() writes them by extension.

Row formats (JSON lines, CSV) are as large as the results and stay distributed; the documents (JSON, Markdown, HTML)
hold the summary and the `top` riskiest rows, which is their feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import report

TOP = 100


def _csv(*values: Column) -> Column:
    def quoted(v: Column) -> Column:
        v = F.coalesce(v.cast("string"), F.lit(""))
        return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return F.concat_ws(",", *[quoted(v) for v in values])


def _pairs(between: str, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries("entities")), lambda e: F.concat(e["key"], F.lit(between), e["value"].cast("string"))), separator)


def json_lines(results: DataFrame) -> DataFrame:
    return results.select(F.to_json(F.struct(*results.columns)).alias("value"))


def csv_lines(results: DataFrame) -> DataFrame:
    """path,size_bytes,score,tier,entities,error under a heading; entities as `T:n, T:n`."""
    head = results.sparkSession.createDataFrame([("path,size_bytes,score,tier,entities,error",)], "value string")
    return head.unionByName(results.select(_csv(F.col("path"), F.col("size_bytes"), F.col("score"), F.col("tier"), _pairs(":", ", "), F.col("error")).alias("value")))


def inventory_csv(items: DataFrame) -> DataFrame:
    """path,score,tier,entities,exposure; entities as `T:n|T:n`."""
    return items.select(_csv(F.col("path"), F.coalesce("score", F.lit(0)), F.col("tier"), _pairs(":", "|"), F.col("exposure")).alias("value"))


def inventory(spark, path: str) -> DataFrame:
    """An inventory file: {"files": [...]} or a list of rows, as path, score, tier, exposure, entities."""
    row = "struct<path:string,score:int,tier:string,exposure:string,entities:map<string,bigint>>"
    whole = spark.read.text(path, wholetext=True)
    rows = F.coalesce(F.from_json("value", f"struct<files:array<{row}>>")["files"], F.from_json("value", f"array<{row}>"))
    return whole.select(F.explode(rows).alias("r")).select("r.*")


def _parts(results: DataFrame, top: int) -> tuple[dict, list, list]:
    """Summary, entity counts and the top rows: a bounded number of rows each."""
    return report.summary(results).first().asDict(), report.entity_histogram(results).collect(), report.ordered(results, limit=top).select("path", "score", "tier").collect()


def _document(results: DataFrame, text: str) -> DataFrame:
    return results.sparkSession.createDataFrame([(text,)], "value string")


def json_document(results: DataFrame, summary: dict | None = None, top: int = TOP) -> DataFrame:
    import json

    found, entities, rows = _parts(results, top)
    body = {"summary": found | (summary or {}), "entities": {r["entity_type"]: r["count"] for r in entities}, "results": [r.asDict() for r in rows]}
    return _document(results, json.dumps(body, indent=2, default=str))


def markdown(results: DataFrame, top: int = TOP) -> DataFrame:
    found, entities, rows = _parts(results, top)
    cell = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["# Risk report", "", f"{found['total_files']} files, {found['error_count']} errors, mean score {found['mean_score'] or 0:.1f}", "", "| Tier | Files |", "|---|---|"]
    lines += [f"| {t} | {found[f'tier_{t.lower()}']} |" for t in reversed(report.TIER_ORDER)]
    lines += ["", "| Entity | Count |", "|---|---|", *(f"| {cell(r['entity_type'])} | {r['count']} |" for r in entities)]
    lines += ["", "| Path | Score | Tier |", "|---|---|---|", *(f"| {cell(r['path'])} | {r['score']} | {r['tier']} |" for r in rows)]
    return _document(results, "\n".join(lines) + "\n")


def html(results: DataFrame, top: int = TOP) -> DataFrame:
    from html import escape

    found, entities, rows = _parts(results, top)
    table = lambda head, body: "<table><tr>" + "".join(f"<th>{h}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{escape(str(c))}</td>" for c in r) + "</tr>" for r in body) + "</table>"
    parts = [f"<p>{found['total_files']} files, {found['error_count']} errors, mean score {found['mean_score'] or 0:.1f}</p>",
             table(("Tier", "Files"), [(t, found[f"tier_{t.lower()}"]) for t in reversed(report.TIER_ORDER)]), table(("Entity", "Count"), [(r["entity_type"], r["count"]) for r in entities]),
             table(("Path", "Score", "Tier"), [tuple(r) for r in rows])]
    return _document(results, "<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>Risk report</title></head><body><h1>Risk report</h1>" + "".join(parts) + "</body></html>")


FORMATS = {"json": json_document, "jsonl": json_lines, "csv": csv_lines, "md": markdown, "html": html, "htm": html}


def save(results: DataFrame, path: str, **options) -> None:
    """Write the report that the extension of the path names; the path becomes a folder of text files, as Spark writes them."""
    kind = path.rpartition(".")[2].lower()
    if kind not in FORMATS:
        raise ValueError(f"no report format .{kind}; known: {', '.join(sorted(FORMATS))}")
    FORMATS[kind](results, **options).write.mode("overwrite").text(path)
