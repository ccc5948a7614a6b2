"""Files as DataFrames: listing, kinds, text, archive members."""

from __future__ import annotations

import csv
import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Leading bytes and extensions of file kinds.
MAGIC = (("25504446", "application/pdf"), ("504B0304", "application/zip"), ("1F8B", "application/gzip"), ("377ABCAF271C", "application/x-7z-compressed"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("D0CF11E0A1B11AE1", "application/x-ole-storage"), ("7B5C727466", "application/rtf"))
EXTENSIONS = {"txt": "text/plain", "md": "text/markdown", "log": "text/plain", "csv": "text/csv", "tsv": "text/tab-separated-values", "json": "application/json", "xml": "application/xml", "html": "text/html", "htm": "text/html", "pdf": "application/pdf", "zip": "application/zip", "gz": "application/gzip", "tar": "application/x-tar", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "rtf": "application/rtf", "png": "image/png", "jpg": "image/jpeg"}
MOST_BYTES = 100 << 20
MOST_DEPTH, MOST_MEMBERS, MOST_RATIO = 3, 1000, 100
MOST_ROWS = 50_000


def listing(spark: SparkSession, path: str, recursive: bool = True, hidden: bool = False, extensions: tuple = (), max_files: int | None = None) -> DataFrame:
    """path, modificationTime, length, content; Spark reads the content only where a query asks for it.  max_files takes the first by path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    rows = rows if hidden else rows.where(~F.substring_index("path", "/", -1).rlike(r"^\."))
    rows = rows if max_files is None else rows.orderBy("path").limit(max_files)
    return rows.where(F.lower(F.substring_index("path", ".", -1)).isin(*[e.lstrip(".").lower() for e in extensions])) if extensions else rows


def metadata(files: DataFrame) -> DataFrame:
    """path, name, extension, kind (by content, else by name), size_bytes, modified, content_hash, quick_hash, encrypted of listed files."""
    from ..functions import text

    head = F.substring("content", 1, 512)
    # an encrypted zip sets the first flag of its first entry; Office wraps encrypted files in a compound document
    flagged = F.startswith(head, F.lit(b"PK\x03\x04")) & (F.conv(F.hex(F.substring("content", 7, 1)), 16, 10).cast("int").bitwiseAND(1) == 1)
    wrapped = F.startswith(head, F.lit(bytes.fromhex("D0CF11E0A1B11AE1"))) & F.lower("path").rlike(r"\.(?:docx|xlsx|pptx)$")
    locked = F.contains(F.substring("content", -2048, 2048), F.lit(b"/Encrypt")) & F.startswith(head, F.lit(b"%PDF"))
    name = F.substring_index("path", "/", -1)
    return files.select(
        "path", name.alias("name"), F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("").alias("extension"),
        F.coalesce(kind_by_content(F.col("content")), kind_by_name(F.col("path"))).alias("kind"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"),
        text.content_hash(F.col("content")).alias("content_hash"), text.quick_hash(F.col("content")).alias("quick_hash"), F.coalesce(flagged | wrapped | locked, F.lit(False)).alias("encrypted"))


def kind_by_name(path: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), F.lower(F.substring_index(path, ".", -1)))


def kind_by_content(content: Column) -> Column:
    head, out = F.hex(F.substring(content, 1, 16)), F.lit(None).cast("string")
    for magic, kind in reversed(MAGIC):
        out = F.when(F.startswith(head, F.lit(magic)), kind).otherwise(out)
    return out


def fault(path: Column, length: Column, content: Column) -> Column:
    """Why a file is not taken; null if it is."""
    named, found = kind_by_name(path), kind_by_content(content)
    office = named.isin("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet") & (found == "application/zip")
    return F.when(length > MOST_BYTES, "too_large").when(length == 0, "empty").when(named.isNull(), "unknown_type").when(found.isNotNull() & (found != named) & ~office, "type_mismatch")


def _decoded(data: bytes) -> str:
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _sheets(z: zipfile.ZipFile) -> str:
    """Every sheet under its heading: the rows' cells that are not blank, numbers and formula results too."""
    import re
    from xml.etree import ElementTree

    names = z.namelist()
    words = lambda x: "".join(t.text or "" for t in x.iter() if _tag(t) == "t")
    shared = [words(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _tag(x) == "si"] if "xl/sharedStrings.xml" in names else []
    titles = [x.get("name") for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _tag(x) == "sheet"] if "xl/workbook.xml" in names else []
    parts = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
    out = []
    for k, (number, part) in enumerate(parts):
        rows = []
        for row in ElementTree.fromstring(z.read(part)).iter():
            if _tag(row) != "row":
                continue
            cells = []
            for cell in row:
                value = next((x.text or "" for x in cell if _tag(x) == "v"), None)
                if cell.get("t") == "s" and value is not None and value.isdigit() and int(value) < len(shared):
                    value = shared[int(value)]
                elif value is None:
                    value = words(cell)
                if value.strip():
                    cells.append(value)
            if cells:
                rows.append(" | ".join(cells))
        if rows:
            out.append("\n".join([f"[Sheet: {titles[k] if k < len(titles) else number}]", *rows]))
    return "\n".join(out)


def text_of(name: str, data: bytes) -> str:
    """Text of plain, tabular, RTF and Office Open XML content; empty for other kinds."""
    low = name.lower()
    if low.endswith((".csv", ".tsv")):
        rows = csv.reader(io.StringIO(_decoded(data)), delimiter="\t" if low.endswith(".tsv") else ",")
        return "\n".join(" | ".join(c for c in row if c.strip()) for row, _ in zip(rows, range(MOST_ROWS)))
    if low.endswith((".docx", ".xlsx")):
        from xml.etree import ElementTree

        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if sum(x.file_size for x in z.infolist()) > MOST_RATIO * max(1, len(data)):
                return ""
            if low.endswith(".xlsx"):
                return _sheets(z)
            out = []
            for part in sorted(n for n in z.namelist() if n == "word/document.xml"):
                for p in ElementTree.fromstring(z.read(part)).iter():
                    if _tag(p) == "p":
                        out.append("".join(t.text or "" for t in p.iter() if _tag(t) == "t"))
            return "\n".join(x for x in out if x)
    if low.endswith(".rtf"):
        import re

        return re.sub(r"\\'([0-9a-f]{2})|\\par\b ?|\\[a-z]+-?\d* ?|[{}]", lambda m: chr(int(m[1], 16)) if m[1] else "\n" if m[0].startswith("\\par") else "", _decoded(data)).strip()
    if low.rpartition(".")[2] in ("txt", "md", "log", "json", "xml", "html", "htm", ""):
        return _decoded(data)
    return ""


class Limit(Exception):
    """An archive holds more than is taken; what was read before stays."""


PACKED = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}
ARCHIVES = (".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz")


def _members(name: str, data: bytes, depth: int) -> Iterator[tuple[str, bytes]]:
    """Members of an archive and of archives in it, without those of unsafe names; Limit beyond a limit."""
    low, taken, total, most = name.lower(), 0, 0, min(MOST_BYTES, MOST_RATIO * max(1024, len(data)))
    found: Iterator[tuple[str, int, object]] = iter(())
    if depth > MOST_DEPTH:
        raise Limit("nested too deep")
    if low.endswith(ARCHIVES) and not low.endswith(".zip"):
        tar = tarfile.open(fileobj=io.BytesIO(data))
        found = ((m.name, m.size, lambda m=m: tar.extractfile(m).read()) for m in tar if m.isfile())
    elif low.endswith(".zip"):
        archive = zipfile.ZipFile(io.BytesIO(data))
        found = ((m.filename, m.file_size, lambda m=m: archive.read(m)) for m in archive.infolist() if not m.is_dir())
    elif low.endswith(tuple(PACKED)):
        opened = PACKED["." + low.rpartition(".")[2]](io.BytesIO(data))
        inner = opened.read(most + 1)
        found = iter([(name.rpartition(".")[0].rpartition("/")[2], len(inner), lambda: inner)])
    for member, size, read in found:
        taken, total = taken + 1, total + size
        if taken > MOST_MEMBERS:
            raise Limit("too many members")
        if total > most:
            raise Limit("too large unpacked")
        if member.startswith("/") or ".." in member.split("/"):
            continue
        inner = read()
        if member.lower().endswith((*ARCHIVES, *PACKED)):
            for n, b in _members(member, inner, depth + 1):
                yield f"{member}/{n}", b
        else:
            yield member, inner


def members(files: DataFrame) -> DataFrame:
    """(path, content) archives -> path, member, content, error: a row for each member, and one with the error where reading ended early."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = []
                try:
                    for name, inner in _members(path, bytes(content), 0):
                        rows.append((path, name, inner, None))
                except Limit as e:
                    rows.append((path, None, None, str(e)))
                except Exception as e:  # a broken archive is a row, not a failed job
                    rows.append((path, None, None, type(e).__name__))
                yield pd.DataFrame(rows or [(path, None, None, None)], columns=["path", "member", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, content binary, error string")


def texts(files: DataFrame) -> DataFrame:
    """(path, content) -> path, text, warning."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    text = text_of(path, bytes(content))
                    cut = path.lower().endswith((".csv", ".tsv")) and text.count("\n") + 1 >= MOST_ROWS
                    out.append((path, text, f"rows beyond {MOST_ROWS} left out" if cut else None if text else "no text"))
                except Exception as e:
                    out.append((path, "", type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "text", "warning"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, warning string")


def cloud_uri(uri: Column) -> Column:
    """struct(provider, bucket, key) of s3://, gs:// and https blob addresses; null for others."""
    plain = F.regexp_extract(uri, "^(s3|gs)://([^/]+)/(.+)$", 1)
    blob = F.regexp_extract(uri, r"^https://[^./]+\.blob\.core\.windows\.net/([^/]+)/(.+)$", 1)
    part = lambda k: F.regexp_extract(uri, "^(?:s3|gs)://([^/]+)/(.+)$", k)
    return F.when(plain != "", F.struct(F.when(plain == "s3", "s3").otherwise("gcs").alias("provider"), part(1).alias("bucket"), part(2).alias("key"))).when(
        blob != "", F.struct(F.lit("azure").alias("provider"), blob.alias("bucket"), F.regexp_extract(uri, r"^https://[^/]+/[^/]+/(.+)$", 1).alias("key")))
