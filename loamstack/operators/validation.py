"""Risk, quality, confidence and verdict of answers against their context, as plain expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T

CONTEXT = (50, 8000)


def with_questions(conversations: DataFrame) -> DataFrame:
    """Assistant turns (conv_id, turn, answer) with the last user turn before them as the question."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)
    return conversations.withColumn("question", asked).where("role = 'assistant'").select("conv_id", "turn", "question", F.col("text").alias("answer"))


def is_valid(level: Column, quality: Column, confidence: Column) -> Column:
    return (level != "critical") & (quality >= 0.5) & (confidence >= 0.5)


def is_served(valid: Column, level: Column, confidence: Column) -> Column:
    return valid & (level != "critical") & (confidence >= 0.3)


def validate(answers: DataFrame) -> DataFrame:
    """Adds every score and verdict to (question, answer, context); a null context means that nothing was retrieved."""
    context = F.substring("context", 1, CONTEXT[1])
    out = answers.withColumn("__c", F.coalesce(F.length(context), F.lit(0))).withColumn("__ok", F.col("__c").between(*CONTEXT) & F.col("answer").isNotNull())
    ratio = F.try_divide(0.3 * F.length("answer"), F.col("__c"))
    out = out.withColumn("risk", F.when(F.col("__ok"), F.least(ratio, F.lit(0.9))).otherwise(0.5))
    q, c = F.array_distinct(T.words(F.lower("question"))), T.words(F.lower("context"))
    shared = F.try_divide(F.size(F.array_intersect(q, c)), F.size(q))
    out = out.withColumns({
        "level": F.when(F.col("__ok"), S.risk_level(F.col("risk"))).otherwise("high"),
        "is_hallucination": F.col("__ok") & (F.col("risk") > 0.5),
        "detector_confidence": F.when(F.col("__ok"), 0.75).otherwise(0.0),
        "n_sources": F.when(F.col("context").isNull(), 0).otherwise(1),
        "source_quality": F.when(F.col("context").isNull(), 0.5).otherwise(S.clamp(F.coalesce(shared, F.lit(0.0)))),
        "completeness": S.completeness(F.col("answer")),
    })
    out = out.withColumn("quality", S.clamp(0.4 * (1 - F.col("risk")) + 0.2 * F.col("detector_confidence") + 0.2 * F.col("source_quality") + 0.2 * F.col("completeness")))
    n = F.col("n_sources")
    out = out.withColumn("confidence", S.clamp(F.col("detector_confidence") * 0.3 + F.col("quality") * 0.3 + F.least(n / 3, F.lit(1.0)) * 0.2 + F.least(n / 5, F.lit(1.0)) * 0.2))
    out = out.withColumn("valid", is_valid(F.col("level"), F.col("quality"), F.col("confidence")))
    level, quality, conf = F.col("level"), F.col("quality"), F.col("confidence")
    warnings = [
        F.when(level == "high", "High hallucination risk detected").when(level == "critical", "Critical hallucination risk - answer should not be served"),
        F.when(F.col("is_hallucination"), "Potential hallucination detected"),
        F.when(quality < 0.6, F.concat(F.lit("Low quality score: "), T.fixed(quality, 2))),
        F.when(conf < 0.6, F.concat(F.lit("Low confidence: "), T.fixed(conf, 2))),
        F.when(n == 0, "No sources found for answer").when(n < 2, "Limited sources available"),
        F.when(n == 0, "No results from retrieval pipeline"),
    ]
    advice = [
        F.when(~F.col("__ok"), "Manual review recommended"),
        F.when(quality < 0.7, "Consider regenerating answer with different prompt"),
        F.when(n == 0, "Retrieve more relevant sources before generating answer"),
        F.when(F.floor(F.col("__c") / 4) < 100, "Insufficient context - expand search parameters"),
    ]
    listed = lambda parts: F.filter(F.array(*parts), lambda x: x.isNotNull())
    return out.withColumns({
        "served": is_served(F.col("valid"), level, conf), "warnings": listed(warnings), "recommendations": listed(advice),
    }).drop("__c", "__ok")


def regeneration(answers: DataFrame, temperature: float = 0.7, top_p: float = 0.9, attempts: int = 2) -> DataFrame:
    """The sampling parameters of each retry of an answer whose risk is above 0.7."""
    k = F.explode(F.sequence(F.lit(1), F.lit(attempts)))
    out = answers.where("risk > 0.7").withColumn("attempt", k)
    return out.withColumns({"temperature": F.greatest(F.lit(0.1), F.lit(temperature) - 0.1 * F.col("attempt")), "top_p": F.greatest(F.lit(0.7), F.lit(top_p) - 0.05 * F.col("attempt"))})
