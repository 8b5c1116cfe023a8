"""Readers: Parquet tables, JSON seeds with fixed schemas, and spreadsheet exports."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """Condition cards from a JSON array."""
    return spark.read.schema(schemas.CARDS).option("multiLine", True).json(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """One row per gold query."""
    rows = spark.read.schema(schemas.GOLD).option("multiLine", True).json(path)
    return rows.select("label_source", "snapshot_id", F.explode("queries").alias("q")).select("label_source", "snapshot_id", "q.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of PDF files; a bad entry stops the query with a message.

    Every file is a PDF named once, the corpus is NORMATIVE, and a date is in ISO form.
    """
    rows = spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)
    named = rows.groupBy("file").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in rows.columns if c != "file"])
    checks = {
        "a file name is missing or no PDF": F.coalesce(F.lower("file").endswith(".pdf"), F.lit(False)),
        "a file is listed twice": F.col("n") == 1,
        "only the normative corpus is loaded by manifest": F.coalesce(F.col("corpus"), F.lit("NORMATIVE")) == "NORMATIVE",
        "a date is not in ISO form": F.col("declared_date").isNull() | F.col("declared_date").try_cast("date").isNotNull(),
    }
    wrong = F.lit(None).cast("string")
    for message, holds in checks.items():
        wrong = F.coalesce(wrong, F.when(~holds, F.lit(message)))
    return named.select(*rows.columns, F.assert_true(wrong.isNull(), wrong).alias("_ok")).where(F.col("_ok").isNull()).drop("_ok")


#: Rows of a workbook that are handed on at once.
SHEET_BATCH = 10_000
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes) -> Iterator[dict[str, str]]:
    """Rows of a workbook's first sheet as column letters to text."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_NS}t")))
        with book.open("xl/worksheets/sheet1.xml") as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{_NS}row":
                    continue
                cells = {}
                for cell in row.iter(f"{_NS}c"):
                    column = re.match("[A-Z]+", cell.get("r", "A"))
                    value = cell.find(f"{_NS}v")
                    if cell.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
                    elif value is None or value.text is None:
                        text = ""
                    else:
                        text = shared[int(value.text)] if cell.get("t") == "s" else value.text
                    cells[column.group(0) if column else "A"] = text
                yield cells
                row.clear()


def read_sheets(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """source_file, source_row (from 2) and the named columns of all workbooks under a path.

    The first row holds the names; a column that is not there is empty. One task reads one file, and hands its rows on in batches.
    """
    schema = "source_file string, source_row int, " + ", ".join(f"`{c}` string" for c in columns)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = sheet_rows(content)
                places = {v.strip(): k for k, v in next(rows, {}).items()}
                found = ((name, n, *(r.get(places.get(c, ""), "") for c in columns)) for n, r in enumerate(rows, 2))
                for some in itertools.batched(found, SHEET_BATCH):
                    yield pd.DataFrame(some, columns=["source_file", "source_row", *columns])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, schema)


def load_support_export(spark: SparkSession, path: str, question: str = "Описание", solution: str = "Решение", topic: str = "Тема", subtopic: str = "Подтема") -> DataFrame:
    """Past questions and solutions from spreadsheets, without direct identifiers; rows that lack either leave."""
    raw = read_sheets(spark, path, [question, solution, topic, subtopic])
    names = {question: "question", solution: "solution", topic: "topic", subtopic: "subtopic"}
    redactions = [T.redaction_count(F.col(f"`{c}`")) for c in names]
    clean = raw.select("source_row", *[T.redact(F.col(f"`{c}`")).alias(n) for c, n in names.items()], (redactions[0] + redactions[1] + redactions[2] + redactions[3]).alias("redactions"))
    kept = clean.where("question <> '' and solution <> ''")
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return kept.select("source_row", "question", "solution", blank("topic"), blank("subtopic"), F.sha2(F.lower("question"), 256).alias("question_hash"), "redactions")
