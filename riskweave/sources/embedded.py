"""A label inside a file: a custom property of an Office Open XML document, or a comment in HTML, Markdown and XML.

Other kinds cannot hold one; their label goes to the index alone, under a pointer `id:hash`.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROPERTY = "riskweave-label"
OFFICE, MARKUP = (".docx", ".xlsx", ".pptx"), (".html", ".htm", ".xml", ".md")
_PART = "docProps/custom.xml"
_FORMAT = "{D5CDD505-2E9C-101B-9397-08002B2CF9AE}"  # the id of user-defined properties


def can_hold(name: str) -> bool:
    return name.lower().endswith(OFFICE + MARKUP)


def _comment(label: str) -> str:
    return f"<!-- {PROPERTY}: {label.replace('-', '&#45;')} -->"


def get(name: str, data: bytes) -> str | None:
    low = name.lower()
    if low.endswith(OFFICE):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            text = z.read(_PART).decode() if _PART in z.namelist() else ""
        found = re.search(rf'<property[^>]*name="{PROPERTY}"[^>]*>\s*<vt:lpwstr>(.*?)</vt:lpwstr>', text, re.S)
        return unescape(found[1]) if found else None
    if low.endswith(MARKUP):
        found = re.search(rf"<!-- {PROPERTY}: (.*?) -->", data.decode("utf-8", "replace"), re.S)
        return found[1].replace("&#45;", "-") if found else None
    return None


def put(name: str, data: bytes, label: str) -> bytes:
    """The file's bytes with the label in the place of any it had."""
    low = name.lower()
    if low.endswith(MARKUP):
        text = re.sub(rf"<!-- {PROPERTY}: .*? -->\n?", "", data.decode("utf-8"), flags=re.S)
        return (text.rstrip("\n") + "\n" + _comment(label) + "\n").encode()
    if not low.endswith(OFFICE):
        raise ValueError(f"{name} cannot hold a label")
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        names = old.namelist()
        before = old.read(_PART).decode() if _PART in names else ""
        kept = [x for x in re.findall(r"<property .*?</property>", before, re.S) if f'name="{PROPERTY}"' not in x]
        kept.append(f'<property fmtid="{_FORMAT}" pid="{len(kept) + 2}" name="{PROPERTY}"><vt:lpwstr>{escape(label)}</vt:lpwstr></property>')
        part = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/custom-properties" '
                'xmlns:vt="http://schemas.openxmlformats.org/officeDocument/2006/docPropsVTypes">' + "".join(kept) + "</Properties>")
        for n in names:
            if n == _PART:
                continue
            content = old.read(n)
            if n == "[Content_Types].xml" and b"custom-properties+xml" not in content:
                kind = b'<Override PartName="/docProps/custom.xml" ContentType="application/vnd.openxmlformats-officedocument.custom-properties+xml"/>'
                content = content.replace(b"</Types>", kind + b"</Types>")
            if n == "_rels/.rels" and b"custom-properties" not in content:
                link = b'<Relationship Id="rIdLabel" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/custom-properties" Target="docProps/custom.xml"/>'
                content = content.replace(b"</Relationships>", link + b"</Relationships>")
            new.writestr(n, content)
        new.writestr(_PART, part)
    return out.getvalue()


def labels(files: DataFrame) -> DataFrame:
    """(path, content) -> path, label (null without one), error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append((path, get(path, bytes(content)), None))
                except Exception as e:
                    rows.append((path, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "label", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, label string, error string")


def labelled(files: DataFrame) -> DataFrame:
    """(path, content, label) -> path, content with the label in it, method: embedded, or pointer where the file cannot hold one or is broken."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, content, label in zip(pdf["path"], pdf["content"], pdf["label"]):
                try:
                    rows.append((path, put(path, bytes(content), label), "embedded"))
                except Exception:  # the label is not lost: the index has it
                    rows.append((path, bytes(content), "pointer"))
            yield pd.DataFrame(rows, columns=["path", "content", "method"])

    return files.select("path", "content", F.col("label").cast("string").alias("label")).mapInPandas(run, "path string, content binary, method string")
