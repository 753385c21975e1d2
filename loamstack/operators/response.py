"""What a user gets: detector results with defaults, cache keys, sources with fallbacks, notes, and whole responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ValidationConfig
from ..functions import scores as S
from ..functions import text as T
from .querylog import high_quality

RAW = "risk_score double, hallucination_detected boolean, confidence double, issues array<map<string,string>>, suggestions array<string>, sla_certificate string"
SOURCE = "source_id int, document_id string, section_title string, relevance_score double, token_count int"
NOTES = {
    "low": "Low risk: the passages support this answer well.",
    "medium": "Moderate risk: check the important details.",
    "high": "Raised risk: check this answer by hand.",
    "critical": "Critical risk: do not rely on this answer.",
}


def parsed_detection(raw: Column, config: ValidationConfig | None = None) -> Column:
    """A detector's JSON as a struct, with defaults for what it lacks; unreadable JSON counts as empty."""
    config = config or ValidationConfig()
    r = F.from_json(raw, RAW)
    risk = F.coalesce(r["risk_score"], F.lit(config.default_risk))
    none = F.array().cast("array<map<string,string>>")
    return F.struct(
        risk.alias("risk_score"),
        F.coalesce(r["hallucination_detected"], risk > 0.5).alias("is_hallucination"),
        F.coalesce(r["confidence"], F.lit(0.5)).alias("confidence"),
        S.risk_level(risk).alias("risk_level"),
        (F.coalesce(r["issues"], none) if config.issues else none).alias("issues"),
        (F.coalesce(r["suggestions"], F.array().cast("array<string>")) if config.suggestions else F.array().cast("array<string>")).alias("suggestions"),
        r["sla_certificate"].alias("sla_certificate"),
    )


def cache_key(answer: Column, context: Column, query: Column, config: ValidationConfig | None = None) -> Column:
    """A digest of all that a verdict depends on; of the context the first 1000 characters."""
    config = config or ValidationConfig()
    parts = F.struct(
        answer.alias("answer"), F.lit(config.backend).alias("backend"), F.substring(context, 1, 1000).alias("context"),
        F.lit(config.model or "default").alias("model"), F.coalesce(query, F.lit("")).alias("query"),
    )
    return F.sha2(F.to_json(parts), 256)


def failed(error: Column) -> Column:
    """The verdict on an answer whose validation failed."""
    return F.struct(
        F.lit(False).alias("valid"), F.lit(1.0).alias("risk"), F.lit("critical").alias("level"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("quality"),
        F.array(F.concat(F.lit("Validation failed: "), error)).alias("warnings"), F.array(F.lit("Manual review required")).alias("recommendations"),
    )


def unvalidated(confidence: float = 0.5) -> Column:
    """The verdict where validation is switched off: taken as valid, with middling scores."""
    return F.struct(
        F.lit(True).alias("valid"), F.lit(0.5).alias("risk"), F.lit("medium").alias("level"), F.lit(confidence).alias("confidence"), F.lit(0.5).alias("quality"),
        F.array(F.lit("Answer was not validated")).alias("warnings"), F.array().cast("array<string>").alias("recommendations"),
    )


def sources_or_context(answer_sources: Column, context_sources: Column) -> Column:
    """The answer's own sources, else those of its context, numbered, with defaults for what they lack."""
    made = F.transform(
        context_sources,
        lambda s, i: F.struct(
            (i + 1).alias("source_id"), F.coalesce(s["document_id"], F.lit("unknown")).alias("document_id"),
            F.coalesce(s["section_title"], F.concat(F.lit("Section "), (i + 1).cast("string"))).alias("section_title"),
            F.coalesce(s["relevance_score"], F.lit(0.0)).alias("relevance_score"), F.coalesce(s["token_count"], F.lit(0)).alias("token_count"),
        ),
    )
    kind = f"array<struct<{SOURCE.replace(' ', ':').replace(',:', ',')}>>"
    return F.when(F.size(F.coalesce(answer_sources, F.array().cast(kind))) > 0, answer_sources.cast(kind)).otherwise(F.coalesce(made.cast(kind), F.array().cast(kind)))


def quality_note(level: Column, served: Column) -> Column:
    """A note for answers that are not served, or whose risk is high or critical; else null."""
    text = F
    for name, note in NOTES.items():
        text = text.when(level == name, note)
    return F.when(~served | level.isin("high", "critical"), F.struct(level.alias("risk_level"), text.otherwise("Risk unknown.").alias("message")))


def user_response(validated: DataFrame) -> DataFrame:
    """What a user sees of each answer: no internal figures, and a note only where there is reason."""
    warnings = F.when(F.size("warnings") > 0, F.col("warnings"))
    return validated.withColumns({"note": quality_note(F.col("level"), F.col("served")), "shown_warnings": warnings})


def query_response(validated: DataFrame, include_validation: bool = True) -> DataFrame:
    """Each answer's whole response as JSON: answer, verdict, token usage (a token for four characters)."""
    prompt, done = T.tokens_by_chars(F.coalesce("context", F.lit(""))), T.tokens_by_chars(F.coalesce("answer", F.lit("")))
    usage = F.struct(prompt.alias("prompt_tokens"), done.alias("completion_tokens"), (prompt + done).alias("total_tokens"))
    verdict = F.struct("valid", F.round("risk", 6).alias("risk"), "level", F.round("confidence", 6).alias("confidence"), F.round("quality", 6).alias("quality"), "warnings", "recommendations")
    parts = [F.col("question").alias("query"), F.col("answer"), usage.alias("token_usage")]
    return validated.withColumn("response", F.to_json(F.struct(*parts, *([verdict.alias("validation")] if include_validation else []))))


def hallucination_details(log: DataFrame, query_id) -> DataFrame:
    """A logged query's risk by its id; no row if there is none."""
    own = log.where(F.col("id") == query_id)
    return own.select("id", "hallucination_score", "level", "quality_score", high_quality().alias("is_high_quality"))


def request_problem(text: Column, temperature: Column, max_tokens: Column, score: Column, days: Column) -> Column:
    """Why a request is refused, by the first limit that it breaks; null if it is taken. Null limits are defaults and pass."""
    n = F.coalesce(F.length(text), F.lit(0))
    return (
        F.when(n == 0, "empty_query")
        .when(n > 2000, "long_query")
        .when(~temperature.between(0, 1), "temperature_out_of_range")
        .when(~max_tokens.between(50, 2048), "max_tokens_out_of_range")
        .when(~score.between(0, 1), "score_out_of_range")
        .when(~days.between(1, 365), "days_out_of_range")
    )
