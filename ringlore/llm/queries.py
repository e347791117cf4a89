"""The pN_ queries, each over its whole tables with production parameters, and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boiler, mixing, names, neardup, packing, pii, repeats, subjects, survivors, textforms
from .common import table
from .twins import SQL

__all__ = ["QUERIES", "SQL"]


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spam = table(spark, sf_dir, "spam_reports").select(F.lit("spam_reports").alias("src_table"), F.col("id").alias("record_id"), F.col("note").alias("text"))
    calls = table(spark, sf_dir, "personal_call_logs").select(F.lit("personal_call_logs").alias("src_table"), F.col("id").alias("record_id"), F.col("notes").alias("text"))
    return spam.unionByName(calls)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = pii.with_scrubbed(_notes(spark, sf_dir).where(F.col("text").isNotNull()), "text")
    return notes.select("src_table", "record_id", F.explode("pii.items").alias("i")).select("src_table", "record_id", "i.pii_type", "i.item_no")


def p1_scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_scrubbed(_notes(spark, sf_dir), "text").select("src_table", "record_id", F.col("pii.redacted").alias("redacted"))


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"phone_number_id": F.col("phone_number_id"), "name_key": survivors.name_key(F.col("normalized_name"))}
    return survivors.survivors(table(spark, sf_dir, "phone_identities"), keys, "id", table(spark, sf_dir, "claim_source_trust"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir).where("undisputed").select("phone_number_id", "survivor_id")


def p2_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, text in (("phone_identities", "normalized_name"), ("phone_observations", "context_text")):
        odd = textforms.irregular(table(spark, sf_dir, name).where(F.col("id").isNotNull()), ["id"], text)
        parts.append(odd.select(F.lit(name).alias("src_table"), F.col("id").alias("record_id")))
    return parts[0].unionByName(parts[1])


def p3_unified_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "phone_observations").select("id", "context_text")
    return textforms.unified(rows, ["id"], "context_text").select(F.col("id").alias("record_id"), "form", "changed")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "phone_identities").where("identity_type IS NULL OR identity_type NOT IN ('UNKNOWN', 'HOTLINE')")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.variant_pairs(_named(spark, sf_dir), "id", "normalized_name", "identity_type", "phone_number_id")


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.entities(_named(spark, sf_dir), "id", "normalized_name", "identity_type", "phone_number_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boiler.with_article(table(spark, sf_dir, "raw_documents").select("id", "raw_content", "http_status"), "raw_content", status="http_status")
    return found.select(F.col("id").alias("raw_document_id"), F.explode("article_lines").alias("line_no"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_lines(table(spark, sf_dir, "raw_documents"), "id", "source_id", "raw_content").withColumnRenamed("record", "raw_document_id")


def p6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without the lines that repeat within its source."""
    docs = table(spark, sf_dir, "raw_documents").select("id", "source_id", "raw_content")
    lines = repeats.repeated_lines(docs, "id", "source_id", "raw_content")
    return repeats.without_lines(docs.drop("source_id"), "id", "raw_content", lines).select(F.col("id").alias("raw_document_id"), F.col("raw_content").alias("text"))


def p6_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The templates of each source, such as notices with a date in them."""
    return repeats.templates(table(spark, sf_dir, "raw_documents"), "id", "source_id", "raw_content").withColumnRenamed("source", "source_id")


def p5_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of every page, one line of the article a line."""
    docs = table(spark, sf_dir, "raw_documents").select("id", "raw_content", "http_status")
    return boiler.with_body(docs, "raw_content", status="http_status").select(F.col("id").alias("raw_document_id"), F.col("article").alias("text"))


def _article_pieces(model: dict) -> Callable[[list[str]], list[list[str]]]:
    said = boiler.Said(model)

    def pieces(texts: list[str]) -> list[list[str]]:
        return [" ".join(leaf.text for leaf in leaves).split() for leaves in boiler.articles(texts, model, said)]

    return pieces


def _article_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "raw_documents").where("http_status IS NULL OR http_status < 400")
    return neardup.sketches(docs, "id", "raw_content", 3, _article_pieces(boiler.load_model()))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_pairs(_article_sketches(spark, sf_dir), 0.6).withColumnsRenamed({"a": "doc_a", "b": "doc_b"})


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(_article_sketches(spark, sf_dir), 0.6).withColumnsRenamed({"record": "raw_document_id", "group": "group_id"})


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [(r["container_kind"], r["capacity_tokens"]) for r in table(spark, sf_dir, "pack_capacities").orderBy("capacity_tokens").collect()]
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", kinds).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = p8_pack(spark, sf_dir).groupBy("container_kind").agg(F.sum("n_tokens").alias("tokens"), (F.max("container") + 1).alias("containers"), F.count("*").alias("pieces"))
    kinds = table(spark, sf_dir, "pack_capacities")
    return used.join(kinds, "container_kind").withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[mixing.Share]]:
    targets = [(r["source"], r["target_share"], r["max_repeats"]) for r in table(spark, sf_dir, "mix_targets").orderBy("source").collect()]
    return mixing.mixed(mixing.measured(table(spark, sf_dir, "documents"), "doc_id", "source", "text", [t[0] for t in targets]), targets)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.share_report(*_mix(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL")
    return subjects.with_subjects(docs, "text", keep=["doc_id"]).select("doc_id", F.explode("subjects").alias("subject"))


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_found(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_scrubbed, p2_found, p2_survivors, p3_found, p3_unified_contexts, p4_found, p4_entities, p5_found, p5_articles, p6_found, p6_cleaned, p6_templates, p7_found, p7_groups, p8_pack, p8_fill, p9_mix, p9_shares, p10_found, p10_composition)
}
