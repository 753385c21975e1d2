"""The engine as one object: questions to validated responses, validation of given answers, and reads of the log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ValidationConfig, from_env
from .functions import models, prompts
from .operators import chunking, querylog, response, retrieval, validation


class Engine:
    """Answers tables of questions from a table of documents (doc_id, text)."""

    def __init__(self, documents: DataFrame, generator: Callable[[], models.Generator] = models.ExtractiveGenerator, config: ValidationConfig | None = None):
        self.config = config or from_env()
        self.generator = generator
        self.parents = chunking.parents(chunking.good_documents(documents))
        self.children = chunking.children(self.parents)

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """One row a question (query_id, query): the packed context and its figures."""
        return retrieval.results(questions, retrieval.retrieve(questions, self.parents, self.children))

    def answer(self, questions: DataFrame, include_validation: bool = True) -> DataFrame:
        """(query_id, response): each question's whole response as JSON."""
        found = self.retrieve(questions).withColumnsRenamed({"query": "question", "text": "context"})
        prompt = found.select(F.col("query_id").alias("prompt_id"), prompts.user_message(F.col("question"), F.col("context")).alias("prompt"))
        said = models.generate(prompt, self.generator, self.config.retries, self.config.retry_delay)
        both = found.join(said.select(F.col("prompt_id").cast("bigint").alias("query_id"), "answer"), "query_id", "left")
        checked = self.validate(both.withColumn("context", F.nullif("context", F.lit(""))))
        return response.query_response(checked, include_validation).select("query_id", "response")

    def validate(self, answers: DataFrame) -> DataFrame:
        """Scores and verdicts of (question, answer, context)."""
        return validation.validate(answers)

    @staticmethod
    def logged(log: DataFrame, query_id: int) -> DataFrame:
        """A logged query; LookupError if there is none."""
        own = log.where(F.col("id") == query_id)
        if own.isEmpty():
            raise LookupError(f"no query {query_id}")
        return own

    @staticmethod
    def stats(log: DataFrame, days: int = 7) -> DataFrame:
        if not 1 <= days <= 365:
            raise ValueError("days must be 1 to 365")
        return querylog.stats(querylog.trailing(log, days))


def healthy(spark: SparkSession, *tables: str) -> dict[str, bool]:
    """Whether the session works, and each table can be read."""
    out = {"session": spark.range(1).count() == 1}
    for path in tables:
        try:
            spark.read.parquet(path).limit(1).collect()
            out[path] = True
        except Exception:  # any failure to read is what is asked for
            out[path] = False
    return out
