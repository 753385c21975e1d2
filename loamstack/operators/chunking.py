"""Quality filter and parent/child chunks with overlapping word windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PARENT, PARENT_OVERLAP, CHILD, CHILD_OVERLAP = 1000, 50, 250, 50


def good_documents(docs: DataFrame) -> DataFrame:
    """Documents that pass every quality rule; null texts don't."""
    return docs.where(T.reject_reason("text").isNull())


def window_chunks(docs: DataFrame, size: int, overlap: int, keys: list[str], position: str, words: str = "__w") -> DataFrame:
    """keys, a 0-based position, and the text of each window."""
    split = docs.withColumn(words, T.words("text"))
    return split.select(*keys, F.posexplode(T.windows(F.col(words), size, overlap)).alias(position, "text"))


def parent_id(position: str) -> Column:
    return F.concat(F.col("doc_id").cast("string"), F.lit("_parent_"), F.col(position).cast("string"))


def parents(docs: DataFrame) -> DataFrame:
    out = window_chunks(docs, PARENT, PARENT_OVERLAP, ["doc_id"], "position")
    return out.select(parent_id("position").alias("parent_id"), "doc_id", "position", "text")


def children(parent_chunks: DataFrame) -> DataFrame:
    return _children(parent_chunks.withColumn("__w", T.words("text")))


def _children(parent_words: DataFrame) -> DataFrame:
    keys = ["parent_id", "doc_id", F.col("position").alias("parent_position")]
    out = parent_words.select(*keys, F.posexplode(T.windows(F.col("__w"), CHILD, CHILD_OVERLAP)).alias("position", "text"))
    return out.select(F.concat("parent_id", F.lit("_child_"), F.col("position").cast("string")).alias("chunk_id"), *out.columns)


def children_of(docs: DataFrame) -> DataFrame:
    """``children(parents(docs))``, the words of a document being told apart once: a parent's text has the same words as its window."""
    split = docs.select("doc_id", T.words("text").alias("__d"))
    own = split.select("doc_id", F.posexplode(T.window_words(F.col("__d"), PARENT, PARENT_OVERLAP)).alias("position", "__w"))
    return _children(own.withColumn("parent_id", parent_id("position")))


def hierarchical(chunks: DataFrame, key: str, size: int, overlap: int, least: int) -> DataFrame:
    """Windows that end at a sentence, without those under ``least`` words unless last; positions are renumbered."""
    raw = window_chunks(chunks, size, overlap, [key], "__i")
    ends = Window.partitionBy(key)
    kept = (
        raw.withColumn("__last", F.max("__i").over(ends))
        .withColumn("text", F.when(F.col("__i") < F.col("__last"), T.trim_sentence("text")).otherwise(F.col("text")))
        .withColumn("n_words", F.size(T.words("text")))
        .where((F.col("n_words") >= least) | (F.col("__i") == F.col("__last")))
    )
    return kept.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("__i")) - 1).alias("position"), "n_words", "text")


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section, title, text): lines under the heading before them; text before any heading is the introduction.

    Computed inside each row, without a shuffle: the lines between the headings' places are cut out.
    """
    split = docs.select("doc_id", "text", F.transform(F.split("text", "\n"), lambda x: F.trim(x)).alias("__lines"))
    lines = F.col("__lines")
    heads = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(T.HEADING))
    starts = split.withColumn("__starts", F.concat(F.array(F.lit(-1)), heads))
    at = F.col("__starts")

    def section(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(at, k + 1), F.size(lines))
        title = F.when(start < 0, "Introduction").otherwise(F.trim(F.replace(F.get(lines, start), F.lit("#"), F.lit(""))))
        return F.struct(title.alias("title"), F.slice(lines, start + 2, end - start - 1).alias("lines"))

    found = F.filter(F.transform(at, section), lambda s: F.size(s["lines"]) > 0)
    whole = F.array(F.struct(F.lit("Content").alias("title"), F.array(F.col("text")).alias("lines")))
    out = starts.select("doc_id", F.posexplode(F.when(F.size(found) > 0, found).otherwise(whole)).alias("section", "s"))
    return out.select("doc_id", "section", F.col("s.title").alias("title"), F.trim(F.array_join("s.lines", "\n")).alias("text"))


#: Lines that head a section of a paper: a known name, a numbered one, or a Roman numeral and words. Case doesn't matter.
NAMED = "abstract|acknowledgments|background|conclusion|discussion|introduction|methodology|methods|references|related work|results"
NUMBERED = "background|conclusion|discussion|introduction|methodology|results"
PAPER_HEADING = rf"(?i)^({NAMED}|\d+\.?\s+({NUMBERED})|[ivx]+\.?\s+[a-z][a-z\s]+)$"
SECTION = "array<struct<title:string,text:string>>"


def pattern_sections(text: Column, least: int = 200) -> Column:
    """Sections from each heading line (neither the first nor the last line) to the next, those of more than ``least`` characters. Linear in the text."""

    def cut(lines: Column, heads: Column) -> Column:
        def section(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(heads, k + 1), F.size(lines))
            title = F.regexp_replace(F.trim(F.get(lines, start)), rf"(?i)^\d+\.?\s+({NUMBERED})$", "$1")
            return F.struct(title.alias("title"), F.trim(F.array_join(F.slice(lines, start + 1, end - start), "\n")).alias("text"))

        return F.filter(F.transform(heads, section), lambda s: F.length(s["text"]) > least).cast(SECTION)

    def heads(lines: Column, n: Column) -> Column:
        return F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i < n - 1) & F.trim(F.get(lines, i)).rlike(PAPER_HEADING))

    return T.let(F.split(text, "\n"), lambda lines: T.let(heads(lines, F.size(lines)), lambda h: cut(lines, h)))


def titled_sections(text: str, titles: str, least: int = 100) -> Column:
    """Sections by known titles (columns' names): each is looked for after the one before and runs to the next title, those of more than ``least`` characters."""
    start = "locate(titles[i], text, acc.pos)".replace("titles", titles).replace("text", text)
    end = f"coalesce(nullif(locate({titles}[i + 1], {text}, s + length({titles}[i])), 0), length({text}) + 1)"
    found = f"trim(substring({text}, s, e - s))"
    kind = "array<struct<title:string,text:string>>"
    step = f"""CASE WHEN s = 0 THEN acc ELSE named_struct('pos', e, 'found', CASE WHEN length({found}) > {least}
     THEN concat(acc.found, array(named_struct('title', {titles}[i], 'text', {found}))) ELSE acc.found END) END"""
    lets = f"element_at(transform(array({start}), s -> element_at(transform(array({end}), e -> {step}), 1)), 1)"
    first = f"named_struct('pos', 1, 'found', cast(array() as {kind}))"
    every = f"CASE WHEN size({titles}) > 0 THEN sequence(0, size({titles}) - 1) ELSE cast(array() as array<int>) END"
    # try_element_at and null: titles[i + 1] past the end is null, and locate of null is null.
    return F.expr(f"aggregate({every}, {first}, (acc, i) -> {lets}, acc -> acc.found)".replace(f"{titles}[i + 1]", f"get({titles}, i + 1)"))


def paper_sections(docs: DataFrame, titles: str | None = None) -> DataFrame:
    """(doc_id, section, title, text): by known titles where a document has such sections, else by headings, else the whole document."""
    by_title = titled_sections("text", titles) if titles else F.array().cast(SECTION)
    by_line = pattern_sections(F.col("text"))
    whole = F.array(F.struct(F.lit("Full Document").alias("title"), F.col("text").alias("text"))).cast(SECTION)
    found = docs.withColumn("__t", F.coalesce(by_title, F.array().cast(SECTION))).withColumn("__l", F.when(F.size("__t") == 0, by_line))
    chosen = F.when(F.size("__t") > 0, F.col("__t")).when(F.size("__l") > 0, F.col("__l")).otherwise(whole)
    out = found.select("doc_id", F.posexplode(chosen).alias("section", "s"))
    return out.select("doc_id", "section", F.col("s.title").alias("title"), F.col("s.text").alias("text"))


def section_chunks(sections_of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents and children of sections, with ids document_parent_section_window and ..._child_window; parents' positions run through the document."""
    windows = window_chunks(sections_of, PARENT, PARENT_OVERLAP, ["doc_id", "section", "title"], "window")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "window")) - 1
    own = F.concat(F.col("doc_id").cast("string"), F.lit("_parent_"), F.col("section").cast("string"), F.lit("_"), F.col("window").cast("string"))
    p = windows.select(own.alias("parent_id"), "doc_id", "section", "title", place.alias("position"), "text")
    return p, children(p.select("parent_id", "doc_id", "position", "text"))


def hierarchical_chunks(docs: DataFrame, titles: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The hierarchical chunker: tidied texts, sections, parents of 1000 words and children of 150 that end at sentences."""
    tidied = docs.withColumn("text", T.tidy("text"))
    secs = paper_sections(tidied, titles).withColumn("key", F.concat(F.col("doc_id").cast("string"), F.lit("_"), F.col("section").cast("string")))
    p = hierarchical(secs, "key", 1000, 50, 100).select(F.concat("key", F.lit("_parent_"), F.col("position").cast("string")).alias("parent_id"), "key", "position", "n_words", "text")
    c = hierarchical(p, "parent_id", 150, 10, 30)
    return p, c.select(F.concat("parent_id", F.lit("_child_"), F.col("position").cast("string")).alias("chunk_id"), *c.columns)


def relations(parent_chunks: DataFrame, child_chunks: DataFrame) -> DataFrame:
    """Each parent with its children in order; children of unknown parents are dropped."""
    own = child_chunks.groupBy("parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "chunk_id"))), lambda c: c["chunk_id"]).alias("child_ids"))
    return parent_chunks.select("parent_id").join(own, "parent_id", "left").withColumn("child_ids", F.coalesce("child_ids", F.array().cast("array<string>")))
