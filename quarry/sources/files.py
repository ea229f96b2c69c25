"""Files as documents: a binary scan, one parser an extension, clean text and its counts.

Text, HTML and CSV are parsed by Column expressions; only JSON and DOCX bytes go to
Python, null for all other rows. Files of other extensions or above the size limit
are left out. A file that can't be parsed keeps its row: text is null and error says why.
"""

from __future__ import annotations

import io
import json
import math
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.functions import text as T
from quarry.operators.windows import BLANKS

MAX_BYTES = 30 << 20
PREVIEW = 500
TEXT_LIMIT = 20_000


# -- JSON -----------------------------------------------------------------------------------


def number_text(x: float) -> str:
    """A double in its shortest form: plain from 1e-6 up to 1e21, an exponent outside; null if not finite."""
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    _, found, exponent = Decimal(repr(abs(x))).normalize().as_tuple()
    digits = "".join(map(str, found))
    point = len(digits) + exponent
    if 0 < point <= 21:
        out = digits[:point].ljust(point, "0") + ("." + digits[point:] if exponent < 0 else "")
    elif -6 < point <= 0:
        out = "0." + "0" * -point + digits
    else:
        out = digits[0] + ("." + digits[1:] if digits[1:] else "") + f"e{point - 1:+d}"
    return "-" + out if x < 0 else out


def _quoted(s: str) -> str:
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", json.dumps(s, ensure_ascii=False))


def _lines(value, pad: str) -> str:
    inner = pad + "  "
    if isinstance(value, dict):
        small = sorted((k for k in value if re.fullmatch("0|[1-9][0-9]{0,9}", k) and int(k) < 2**32 - 1), key=int)
        first = set(small)
        keys = small + [k for k in value if k not in first]
        parts = [f"{inner}{_quoted(k)}: {_lines(value[k], inner)}" for k in keys]
        return "{\n" + ",\n".join(parts) + "\n" + pad + "}" if parts else "{}"
    if isinstance(value, list):
        return "[\n" + ",\n".join(inner + _lines(v, inner) for v in value) + "\n" + pad + "]" if value else "[]"
    if isinstance(value, str):
        return _quoted(value)
    if isinstance(value, float):
        return number_text(value)
    return {None: "null", True: "true", False: "false"}[value]


def _refuse(name: str):
    raise ValueError(name)


def json_text(raw: str) -> str:
    """JSON indented by two, numbers as doubles; a string alone as itself; anything else unchanged."""
    try:
        value = json.loads(raw, parse_int=float, parse_constant=_refuse)
        return value.encode("utf-8", "replace").decode() if isinstance(value, str) else _lines(value, "")
    except (ValueError, RecursionError):
        return raw


@F.pandas_udf(StringType())
def pretty_json(raw: pd.Series) -> pd.Series:
    return raw.map(json_text, na_action="ignore")


# -- DOCX -----------------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"


def _runs(node) -> str:
    if node.tag == _W + "t":
        return node.text or ""
    if node.tag == _W + "tab":
        return "\t"
    if node.tag == _W + "noBreakHyphen":
        return "‑"
    if node.tag in (_W + "pPr", _W + "rPr", _W + "del", _MC + "Choice"):
        return ""
    return "".join(map(_runs, node)) + ("\n\n" if node.tag == _W + "p" else "")


def docx_text(content: bytes) -> str | None:
    """Paragraphs, each followed by a blank line; None where the bytes are no such document."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
        return "" if body is None else _runs(body)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, RecursionError):
        return None


@F.pandas_udf(StringType())
def docx(content: pd.Series) -> pd.Series:
    return content.map(docx_text, na_action="ignore")


# -- documents ------------------------------------------------------------------------------


def parse(files: DataFrame, pdf_reader: Callable[[bytes], str] | None = None) -> DataFrame:
    """``files`` (path, content and others) of the known extensions with ext, text and error.

    ``pdf_reader`` turns the bytes of a PDF into text on the executors; there is none built in,
    and PDF files get an error without one.
    """
    ext = T.extension(F.col("path"))
    known = files.where(T.supported(F.col("path"))).withColumn("ext", ext)
    raw = F.make_valid_utf8(F.col("content").cast("string"))

    @F.pandas_udf(StringType())
    def pdf(content: pd.Series) -> pd.Series:
        return content.map(pdf_reader, na_action="ignore")

    of_pdf = pdf(F.when(F.col("ext") == "pdf", F.col("content"))) if pdf_reader else F.lit(None).cast("string")
    body = (
        F.when(F.col("ext").isin("html", "htm"), T.html_text(raw))
        .when(F.col("ext") == "csv", T.csv_lines(raw))
        .when(F.col("ext") == "json", pretty_json(F.when(F.col("ext") == "json", raw)))
        .when(F.col("ext") == "docx", docx(F.when(F.col("ext") == "docx", F.col("content"))))
        .when(F.col("ext") == "pdf", of_pdf)
        .otherwise(raw)
    )
    missing = F.when((F.col("ext") == "pdf") & F.lit(pdf_reader is None), "no PDF reader given").otherwise(F.concat(F.lit("cannot be read as "), F.col("ext")))
    return known.withColumn("text", T.normalize(body)).withColumn("error", F.when(F.col("text").isNull(), missing))


def doc_id(path: Column) -> Column:
    return F.concat(F.lit("doc_"), F.left(F.sha2(path, 256), F.lit(32)))


_STEPS = [(re.compile(pattern), to) for pattern, to in (("\r\n?", "\n"), ("[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), ("[ \t]+\n", "\n"))]
_LINES = re.compile("\n{3,}")


def normalised(pieces: Iterable[str]) -> Iterator[str]:
    """As functions.text.normalize, of a text that comes in pieces which end with its lines."""
    held, begun = "", False  # blanks that may be the text's last
    for piece in pieces:
        for pattern, to in _STEPS:
            piece = pattern.sub(to, piece)
        piece = _LINES.sub("\n\n", held + piece)
        piece = piece if begun else piece.lstrip(BLANKS)
        begun = begun or bool(piece)
        solid = len(piece.rstrip(BLANKS))
        held = piece[solid:]
        if solid:
            yield piece[:solid]


def describe(parsed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Document rows of parsed files, with the columns of ``keep``; the id is made from the path, characters are UTF-16 units."""
    return parsed.select(
        doc_id(F.col("path")).alias("doc_id"),
        F.regexp_extract("path", "([^/]*)$", 1).alias("name"),
        F.col("length").alias("size"),
        "ext",
        F.coalesce(F.length(F.encode("text", "UTF-16BE")) / 2, F.lit(0)).cast("long").alias("chars"),
        T.count_tokens(F.col("text")).alias("tokens"),
        F.col("path").alias("file_path"),
        F.lit("parsed").alias("status"),
        F.col("modificationTime").alias("created_at"),
        "text",
        "error",
        *keep,
    )


def ingest(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, pdf_reader: Callable[[bytes], str] | None = None) -> DataFrame:
    """Document rows with text for every known file below ``path``; Spark's scan gives no row for a file of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return describe(parse(files.where(F.col("length") <= max_bytes), pdf_reader))


def preview(docs: DataFrame, limit: int = PREVIEW) -> DataFrame:
    """``docs`` with the first characters of each text."""
    return docs.withColumn("preview", F.substring(F.coalesce("text", F.lit("")), 1, limit))


def read_text(docs: DataFrame, limit: int = TEXT_LIMIT) -> DataFrame:
    """doc_id, the text's first ``limit`` characters, and its whole length."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.substring(text, 1, limit).alias("text"), F.length(text).cast("long").alias("total"))


def with_fallback(docs: DataFrame, texts: DataFrame, files: DataFrame, pdf_reader: Callable[[bytes], str] | None = None) -> DataFrame:
    """``docs`` (doc_id, file_path) with the kept text of ``texts`` (doc_id, text), or the file parsed
    again where there is none; only files of such documents are parsed."""
    joined = docs.join(texts.select("doc_id", F.col("text").alias("kept")), "doc_id", "left")
    lost = joined.where("kept is null").select(F.col("file_path").alias("path")).distinct()
    again = parse(files.join(lost, "path", "left_semi"), pdf_reader).select(F.col("path").alias("file_path"), F.col("text").alias("parsed"))
    return joined.join(again, "file_path", "left").withColumn("text", F.coalesce("kept", "parsed", F.lit(""))).select(*docs.columns, "text")

