"""Bulk files as tables of strings: CSV, JSON and XLSX, told apart by their extension."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file whose first row names its columns; every value is a string, a byte-order mark is dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, inferSchema=False, encoding="UTF-8", escape='"')
    if not df.columns:
        raise ValueError(f"{path} is empty")
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file that holds an array of flat objects; the first object's keys are the columns, every value a string."""
    first = spark.read.text(path, wholetext=True).select(F.expr("from_json(value, 'array<map<string,string>>')").alias("rows")).select(F.map_keys(F.get("rows", F.lit(0))).alias("head"), F.size("rows").alias("n"))
    head = first.head()
    if head is None or not head["n"] or head["n"] < 1 or head["head"] is None:
        raise ValueError(f"{path} holds no array of objects")
    keys = list(head["head"])  # in the order of the file
    # the whole file is one value anyway: an array cannot be split
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.expr("from_json(value, 'array<map<string,string>>')")).alias("m"))
    return rows.select(*[F.col("m")[k].alias(k) for k in keys])


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_rows(content: bytes) -> Iterator[list[str]]:
    """The rows of a workbook's first sheet as strings, cached values for formulas; an empty cell is an empty string."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheet = book.find(f"{_MAIN}sheets")[0].get(f"{_REL}id")
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = rels[sheet].lstrip("/")
        for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_MAIN}row"):
            out: list[str] = []
            for k, cell in enumerate(row.findall(f"{_MAIN}c")):
                at = _column(cell.get("r")) if cell.get("r") else k
                out += [""] * (at + 1 - len(out))
                value = cell.find(f"{_MAIN}v")
                if cell.get("t") == "inlineStr":
                    out[at] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                elif value is not None and value.text is not None:
                    out[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
            yield out


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook; the first row names the columns, rows that are longer are cut to them."""
    book = spark.read.format("binaryFile").load(path).select("content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = list(xlsx_rows(content))
                yield pd.DataFrame({"n": range(len(rows)), "cells": rows})

    rows = book.mapInPandas(unpack, "n int, cells array<string>")
    head = rows.where("n = 0").head()
    if head is None or not any(head["cells"]):
        raise ValueError(f"{path} is empty")
    names = head["cells"]
    return rows.where("n > 0").select(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(names)])


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {".csv": read_csv, ".json": read_json, ".xlsx": read_xlsx}


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A bulk file by its extension, whatever its case."""
    kind = PurePosixPath(path).suffix.lower()
    if kind not in READERS:
        raise ValueError(f"unsupported format: {kind or path}")
    return READERS[kind](spark, path)


def load_sources(path: str, **settings: str) -> list[dict]:
    """A registry of sources from a JSON or YAML file; ``${NAME}`` is replaced before it is parsed."""
    with open(path, encoding="utf-8") as f:
        body = re.sub(r"\$\{(\w+)\}", lambda m: settings.get(m[1], m[0]), f.read())
    if path.endswith(".json"):
        data = json.loads(body)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML registries need PyYAML; JSON ones do not") from e
        data = yaml.safe_load(body)
    return data["sources"] if isinstance(data, dict) else data
