"""Library catalogs as entity-attribute-value tables, and planning from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_fields(item_data: DataFrame, values: DataFrame, fields: DataFrame, wanted: list[str]) -> DataFrame:
    """(item_id, one column for each wanted field) of (item_id, field_id, value_id), (value_id, value), (field_id, field_name)."""
    named = fields.where(F.col("field_name").isin(*wanted))
    rows = item_data.join(F.broadcast(named), "field_id") if len(wanted) <= 64 else item_data.join(named, "field_id")
    return rows.join(values, "value_id").groupBy("item_id").pivot("field_name", wanted).agg(F.first("value"))


def todo(planned: DataFrame, done: DataFrame, key: str, recheck_below: float | None = None) -> DataFrame:
    """What is planned and not done; with ``recheck_below`` also what was done with a lower score."""
    good = done if recheck_below is None else done.where(F.col("score") >= recheck_below)
    return planned.join(good.select(key), key, "left_anti")


def attachment_path(raw: Column, key: Column, storage: str, base: str) -> Column:
    """A stored path (``storage:x``, ``attachments:x``, ``file://x`` or plain) as one path."""
    return (
        F.when(raw.startswith("storage:"), F.concat(F.lit(storage.rstrip("/") + "/"), key, F.lit("/"), F.substring(raw, 9, 100000))).when(raw.startswith("attachments:"), F.concat(F.lit(base.rstrip("/") + "/"), F.substring(raw, 13, 100000)))
        .when(raw.startswith("file://"), F.regexp_replace(raw, "^file://", "")).otherwise(raw)
    )


def pdf_attachments(items: DataFrame, attachments: DataFrame) -> DataFrame:
    """(item_id, …, path): the attachments (item_id, path) that are PDF files, with their items."""
    return items.join(attachments.where(F.lower("path").like("%.pdf")), "item_id")


def parent_items(files: DataFrame, by_key: DataFrame, by_name: DataFrame) -> DataFrame:
    """Adds parent_id to files (…, key, name): the parent of the key (key, parent_id), else of the file's name (name, parent_id).

    Both lookups are equi joins; of several parents of one key or name the smallest counts.
    """
    first = lambda df, c, out: df.groupBy(c).agg(F.min("parent_id").alias(out))
    both = files.join(first(by_key, "key", "_by_key"), "key", "left").join(first(by_name, "name", "_by_name"), "name", "left")
    return both.select(*files.columns, F.coalesce("_by_key", "_by_name").alias("parent_id"))


def audited_with_tables(audits: DataFrame) -> DataFrame:
    """Audits (…, n_declared, n_extracted) of documents in which a table was declared or found."""
    return audits.where((F.col("n_declared") > 0) | (F.col("n_extracted") > 0))


def worst_first(audits: DataFrame, n: int | None = None, below: float | None = None) -> DataFrame:
    """Audits (doc_id, score, …) by rising score, then doc_id; only those under ``below``; the first ``n``."""
    picked = audits if below is None else audits.where(F.col("score") < below)
    ordered = picked.orderBy("score", "doc_id")
    return ordered if n is None else ordered.limit(n)


def target_list(audits: DataFrame, exported: DataFrame) -> DataFrame:
    """(doc_id): documents audited with tables and documents with an export, each once."""
    return audited_with_tables(audits).select("doc_id").union(exported.select("doc_id")).distinct()
