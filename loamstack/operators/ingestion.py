"""Ingestion of documents into tables: a status for each document, chunks of the good ones, and counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunking, sinks


def with_status(docs: DataFrame) -> DataFrame:
    """``status`` (success or error) and ``error`` (why) of each document; a bad one never stops the others."""
    reason = F.when(F.col("doc_id").isNull(), "no_id").otherwise(T.reject_reason("text"))
    return docs.withColumns({"error": reason, "status": F.when(reason.isNull(), "success").otherwise("error")})


def summary(statuses: DataFrame) -> DataFrame:
    return statuses.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "success").alias("n_success"), F.count_if(F.col("status") == "error").alias("n_error"), F.count_if(F.col("status") == "partial").alias("n_partial"))


def table_counts(**tables: DataFrame) -> DataFrame:
    """(name, n) of each table: one count each, in one plan."""
    out = None
    for name, rows in tables.items():
        part = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def ingest(docs: DataFrame, path: str, progress: Callable[[str], None] | None = None) -> dict[str, str]:
    """Writes documents with their status, parents, children and relations as tables under ``path``; says each when it is there.

    Each table is written whole; a second run appends nothing twice if ``path`` is a new one. Paths by table.
    """
    marked = with_status(docs)
    p = chunking.parents(chunking.good_documents(docs))
    c = chunking.children(p)
    made = {"documents": marked, "parents": p, "children": c, "relations": chunking.relations(p, c)}
    for name, rows in made.items():
        sinks.store(rows, f"{path}/{name}", mode="overwrite")
        if progress:
            progress(name)
    return {name: f"{path}/{name}" for name in made}


def delete_document(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without some documents (doc_id), their parents, children and relations."""
    lost = tables["parents"].join(gone.select("doc_id"), "doc_id", "left_semi").select("parent_id")
    by_doc = {name: sinks.delete(tables[name], gone, ["doc_id"]) for name in ("documents", "parents", "children")}
    return by_doc | {"relations": sinks.delete(tables["relations"], lost, ["parent_id"])}
