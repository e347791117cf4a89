"""Problem 6: lines repeated across one site's documents.

Method: every visible line goes down a token tree of fixed depth (the number of its tokens, then its first tokens, with a
wildcard slot for tokens that hold a digit) and is counted at its leaf.  Trees of all partitions are merged by adding up
their leaves' documents; leaves that cover too few documents of a source are pruned, and with them every line that cannot be
repeated often enough.  The template of a leaf that is left has the word of nearly all its lines in each place, and a
wildcard where no word is that common; again the slots' counts of all partitions are added up.

``repeated_lines`` then counts the lines of the leaves that are left by their own text; ``templates`` and ``template_lines``
go by the templates, so lines with a counter or a date in them are found too; ``without_lines`` takes either away.

Defined results: null and empty texts show no lines but count as documents of their source; a null source is a source of
its own; a line that stands twice in a document counts once; equal rows count as separate documents; extra columns are
untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, checkpointed, python_udf
from .pages import visible_lines

#: Depth of the tree below the token count, and what makes a line or a template common in a source.
DEPTH, MIN_DOCS, MIN_SHARE = 4, 5, 0.2
#: The share of a leaf's lines that a word needs in its place not to be a slot.
FIXED = 0.8

LINES = "struct<line:array<int>,template:array<bigint>,said:array<bigint>>"


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def tree_path(text: str) -> str:
    """The way of a line to its leaf."""
    tokens = text.split(" ")
    head = ["*" if any(c.isdigit() for c in t) else t for t in tokens[:DEPTH]]
    return f"{len(tokens)} {' '.join(head)}"


def _line_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    digest = xxhash.xxh3_64_intdigest
    known: dict[str, tuple[int, int]] = {}  # a page's furniture is hashed once a task
    for texts in batches:
        out = []
        for text in texts:
            numbers, templates, said = [], [], []
            for n, line in visible_lines(text) if text else ():
                keys = known.get(line)
                if keys is None:
                    keys = (_signed(digest(tree_path(line))), _signed(digest(line)))
                    if len(known) < 20_000:
                        known[line] = keys
                numbers.append(n)
                templates.append(keys[0])
                said.append(keys[1])
            out.append((numbers, templates, said))
        yield pd.DataFrame(out, columns=["line", "template", "said"])


def parsed(df: DataFrame, record: str, source: str, text: str, keep: str | None = None) -> DataFrame:
    """(doc, record, source, lines) and the column ``keep``: the leaf and the hash of every visible line, written once."""
    kept = [F.col(keep)] if keep else []
    rows = df.select(F.col(record).alias("record"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), python_udf(_line_batches, LINES)(text).alias("lines"), *kept)
    return checkpointed(rows.withColumn("doc", F.monotonically_increasing_id()))


def _sized(common: DataFrame) -> DataFrame:
    """What is common in the sources, written once and broadcast if its counted rows are few.

    A source of documents of L lines each has at most L / min_share common lines, so the rows follow the number of sources
    and not that of documents; for very many sources the join shuffles.
    """
    common = checkpointed(common)
    return bounded_broadcast(common, common.count(), 64)


def _common_lines(docs: DataFrame, min_docs: int, min_share: float) -> tuple[DataFrame, DataFrame]:
    """(doc, record, source, line_no, leaf, said) of the lines below common leaves, and how many documents are many in each source."""
    totals = docs.groupBy("source").agg(F.greatest(F.lit(min_docs), F.ceil(F.count("*") * F.lit(min_share) - F.lit(1e-9)).cast("bigint")).alias("least"))
    leaves = docs.select("doc", "source", F.explode(F.array_distinct("lines.template")).alias("leaf")).groupBy("source", "leaf").agg(F.count("*").alias("docs"))
    common = _sized(leaves.join(totals, "source").where("docs >= least").select("source", "leaf"))
    lines = docs.select("doc", "record", "source", F.explode(F.arrays_zip("lines.line", "lines.template", "lines.said")).alias("l"))
    lines = lines.select("doc", "record", "source", F.col("l.line").alias("line_no"), F.col("l.template").alias("leaf"), F.col("l.said").alias("said"))
    return lines.join(common, ["source", "leaf"], "left_semi"), totals


def repeated_lines(df: DataFrame, record: str, source: str, text: str, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(record, line_no) of every line whose text stands in at least ``min_docs`` documents and ``min_share`` of its source's."""
    lines, totals = _common_lines(parsed(df, record, source, text), min_docs, min_share)
    often = lines.select("source", "said", "doc").distinct().groupBy("source", "said").agg(F.count("*").alias("docs"))
    return lines.join(_sized(often.join(totals, "source").where("docs >= least").select("source", "said")), ["source", "said"], "left_semi").select("record", "line_no")


TEMPLATE = "struct<line:array<int>,tokens:array<array<string>>>"


def _token_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, wanted in batches:
        out = []
        for text, numbers in zip(texts, wanted):
            asked = set(numbers)
            found = [(n, ["*" if any(c.isdigit() for c in t) else t for t in line.split(" ")]) for n, line in visible_lines(text) if n in asked]
            out.append(([n for n, _ in found], [t for _, t in found]))
        yield pd.DataFrame(out, columns=["line", "tokens"])


def _templated(df: DataFrame, record: str, source: str, text: str, min_docs: int, min_share: float) -> DataFrame:
    """(doc, record, source, line_no, template) of the lines that keep to a common template."""
    rows = df.select(F.col(record).alias("record"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    docs = parsed(rows, "record", "source", "text", keep="text")
    lines, totals = _common_lines(docs, min_docs, min_share)
    asked = lines.groupBy("doc").agg(F.collect_list("line_no").alias("numbers"), F.collect_list("leaf").alias("leaves"))
    read = docs.select("doc", "record", "source", "text").join(asked, "doc")
    read = read.withColumn("t", python_udf(_token_batches, TEMPLATE)("text", "numbers")).withColumn("at", F.map_from_arrays("numbers", "leaves")).drop("text")
    read = read.select("doc", "record", "source", "at", F.explode(F.arrays_zip("t.line", "t.tokens")).alias("l"))
    read = checkpointed(read.select("doc", "record", "source", F.col("l.line").alias("line_no"), F.element_at("at", F.col("l.line")).alias("leaf"), F.col("l.tokens").alias("tokens")))
    words = read.select("source", "leaf", F.posexplode("tokens").alias("place", "token")).groupBy("source", "leaf", "place", "token").agg(F.count("*").alias("n"))
    slots = words.groupBy("source", "leaf", "place").agg(F.max_by("token", F.struct("n", "token")).alias("token"), F.max("n").alias("n"), F.sum("n").alias("of"))
    slots = slots.withColumn("token", F.when(F.col("n") >= F.col("of") * FIXED, F.col("token")).otherwise("*"))
    shapes = slots.groupBy("source", "leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias("shape"))  # as long as a line
    kept = read.join(_sized(shapes), ["source", "leaf"]).where(F.forall(F.zip_with("tokens", "shape", lambda t, w: (w == "*") | (t == w)), lambda good: good))
    kept = kept.select("doc", "record", "source", "line_no", F.array_join("shape", " ").alias("template"))
    often = kept.select("source", "template", "doc").distinct().groupBy("source", "template").agg(F.count("*").alias("docs"))
    return kept.join(_sized(often.join(totals, "source").where("docs >= least").select("source", "template", "docs")), ["source", "template"])


def templates(df: DataFrame, record: str, source: str, text: str, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(source, template, docs): the templates that cover many documents of a source, ``*`` being a slot."""
    return _templated(df, record, source, text, min_docs, min_share).select("source", "template", "docs").distinct()


def template_lines(df: DataFrame, record: str, source: str, text: str, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(record, line_no, template) of the lines that keep to a template of many documents."""
    return _templated(df, record, source, text, min_docs, min_share).select("record", "line_no", "template")


def without_lines(df: DataFrame, record: str, text: str, lines: DataFrame) -> DataFrame:
    """``df`` with the numbered lines of ``lines`` taken out of ``text``; texts without such lines stay as they are."""
    gone = lines.groupBy("record").agg(F.collect_set("line_no").alias("_gone")).withColumnRenamed("record", "_record")
    kept = F.array_join(F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda x, i: ~F.array_contains("_gone", i + 1)), "\n")
    return df.join(gone, F.col(f"`{record}`") == F.col("_record"), "left").withColumn(text, F.when(F.col("_gone").isNull(), F.col(f"`{text}`")).otherwise(kept)).drop("_gone", "_record")
