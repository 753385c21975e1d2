"""Document sources: text files, binary files through a parser, manifests and records with defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, title string, text string, page_count int, method string, error string"


def stem_title(path):
    """A file's name without folders and ending, underscores as blanks, in title case."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def text_files(spark: SparkSession, path: str, recursive: bool = True, pattern: str = "*.txt") -> DataFrame:
    """Each file whole, as one document."""
    raw = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).text(path, wholetext=True)
    name = F.input_file_name()
    return raw.select(name.alias("path"), stem_title(name).alias("title"), F.col("value").alias("text"), F.lit(1).alias("page_count"), F.lit("text").alias("method"), F.lit(None).cast("string").alias("error"))


def parsed_files(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]], pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """Binary files through ``parse`` (bytes to page texts); empty pages are left out, a failing file gives a row with its error."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    pages = [p for p in parse(data) if p and p.strip()]
                    rows.append((name, "\n".join(pages), len(pages), None))
                except Exception as e:  # one bad file must not end the scan
                    rows.append((name, None, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "page_count", "error"])

    out = raw.select("path", "content").mapInPandas(run, "path string, text string, page_count int, error string")
    return out.select("path", stem_title(F.col("path")).alias("title"), "text", "page_count", F.lit("parsed").alias("method"), "error")


def directory(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]] | None = None, recursive: bool = True) -> DataFrame:
    """All text files of a folder and, with a parser, its PDF files, as one table. A kind that the folder lacks is no error."""
    out = text_files(spark, path, recursive)
    return out if parse is None else out.unionByName(parsed_files(spark, path, parse, recursive=recursive))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a JSON list, by their JSON kind: strings are texts, objects have title and text; other kinds are dropped."""
    raw = spark.read.text(path, wholetext=True).select(F.expr("try_variant_get(try_parse_json(value), '$', 'array<variant>')").alias("entries"))
    each = raw.select(F.explode("entries").alias("entry")).withColumn("kind", F.expr("schema_of_variant(entry)"))
    is_object = F.col("kind").startswith("OBJECT")
    of = lambda key, default: F.when(is_object, F.coalesce(F.expr(f"try_variant_get(entry, '$.{key}', 'string')"), F.lit(default)))
    return each.where(is_object | (F.col("kind") == "STRING")).select(
        of("title", "Unknown").otherwise("Text Document").alias("title"), of("text", "").otherwise(F.expr("try_variant_get(entry, '$', 'string')")).alias("text")
    )


def inline(texts: DataFrame) -> DataFrame:
    """Rows (x) as documents: what starts with http or arxiv: is refused with an error, all else is a text; null is an error, too."""
    bad = F.when(F.col("x").isNull(), "no source").when(F.col("x").startswith("http"), "web addresses are not read").when(F.col("x").startswith("arxiv:"), "paper numbers are not read")
    return texts.select(F.lit("Text Document").alias("title"), F.when(bad.isNull(), F.col("x")).alias("text"), F.lit(1).alias("page_count"), F.lit("inline").alias("method"), bad.alias("error"))


def listing_stub(spark: SparkSession, query: str, max_results: int) -> DataFrame:
    """What stands for a web listing without a network: ten rows at most, numbered."""
    return spark.range(max(0, min(10, max_results))).select(F.concat(F.lit("paper-"), F.col("id").cast("string")).alias("paper_id"), F.lit(query).alias("query"))


def page_images(spark: SparkSession, path: str, render: Callable[[bytes], list[bytes]], first: int = 0, last: int | None = None) -> DataFrame:
    """(path, page, image, error) of documents through ``render`` (bytes to page images), for a range of pages; a failing file gives a row with its error."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(name, i, page, None) for i, page in enumerate(render(data)) if i >= first and (last is None or i <= last)]
                except Exception as e:  # one bad file must not end the scan
                    rows.append((name, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page", "image", "error"]).astype({"page": "Int32"})

    return raw.select("path", "content").mapInPandas(run, "path string, page int, image binary, error string")


def image_bytes(column):
    """The bytes of an image given as base64, with or without a data: head."""
    return F.unbase64(F.element_at(F.split(column, ","), -1))
