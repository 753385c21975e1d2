"""Prompt templates, how one is chosen for a question, and the blocks that prompts are built from."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fixed

KINDS = {
    "comparison": ("compare", "difference", "versus", "vs", "contrast"),
    "summary": ("summarize", "summary", "overview", "brief"),
    "explanation": ("explain", "how does", "why does", "what is", "describe"),
    "concise": ("when", "where", "who", "which year", "what year"),
    "detailed": ("detailed", "comprehensive", "thorough", "all", "everything"),
}
INTENTS = {
    "comparison": (("compare", "difference", "versus"), "high"),
    "explanation": (("explain", "how", "why"), "high"),
    "summary": (("summarize", "summary", "overview"), "medium"),
    "factual": (("when", "where", "who", "what year"), "low"),
}
OPINION = ("should", "better", "best", "worst", "opinion")
#: kind -> (system message, user message, most tokens, temperature)
TEMPLATES = {
    "standard": ("Answer from the given passages only.", "Passages:\n{context}\n\nQuestion: {query}\nAnswer:", 512, 0.7),
    "concise": ("Answer in one or two sentences from the passages.", "Passages:\n{context}\n\nQuestion: {query}\nShort answer:", 128, 0.3),
    "detailed": ("Answer at length and cite the passages.", "Passages:\n{context}\n\nQuestion: {query}\nFull answer:", 1024, 0.7),
    "comparison": ("Set out likenesses and differences found in the passages.", "Passages:\n{context}\n\nCompare: {query}\nComparison:", 768, 0.5),
    "explanation": ("Explain step by step from the passages.", "Passages:\n{context}\n\nExplain: {query}\nExplanation:", 768, 0.6),
    "summary": ("Sum up the passages.", "Passages:\n{context}\n\nTopic: {query}\nSummary:", 384, 0.5),
}


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def kind(query: Column) -> Column:
    """The first kind one of whose words the question holds (as a substring)."""
    low, out = F.lower(query), F
    for name, parts in KINDS.items():
        out = out.when(_any(low, parts), name)
    return out.otherwise("standard")


def intent(query: Column) -> Column:
    low, name, level = F.lower(query), F, F
    for k, (parts, hard) in INTENTS.items():
        name, level = name.when(_any(low, parts), k), level.when(_any(low, parts), hard)
    kind_of = name.otherwise("general")
    return F.struct(
        kind_of.alias("type"), level.otherwise("medium").alias("complexity"), F.coalesce(_any(low, OPINION), F.lit(False)).alias("is_opinion"),
        (kind_of == "comparison").alias("requires_comparison"), (kind_of == "explanation").alias("requires_explanation"),
        (kind_of == "summary").alias("requires_summary"), (kind_of == "factual").alias("is_factual"),
    )


def filled(template: str, query: Column, context: Column) -> Column:
    """A template with its places filled at once, so that braces in a question or a passage stay what they are."""
    parts = [p for p in re.split(r"(\{query\}|\{context\})", template) if p]
    return F.concat(*({"{query}": query, "{context}": context}.get(p, F.lit(p)) for p in parts))


def user_message(query: Column, context: Column, chosen: Column | None = None, templates: dict[str, tuple] | None = None) -> Column:
    """The user message by the question's kind (or a chosen one); unknown kinds take the standard template."""
    templates, chosen = templates or TEMPLATES, kind(query) if chosen is None else chosen
    text = F
    for name, (_, user, _, _) in templates.items():
        text = text.when(chosen == name, filled(user, query, context))
    return text.otherwise(filled(templates["standard"][1], query, context))


def system_message(chosen: Column, templates: dict[str, tuple] | None = None) -> Column:
    templates = templates or TEMPLATES
    text = F
    for name, (system, *_) in templates.items():
        text = text.when(chosen == name, F.lit(system))
    return text.otherwise(F.lit(templates["standard"][0]))


def messages(query: Column, context: Column, more: Column | None = None, templates: dict[str, tuple] | None = None) -> Column:
    """The chat messages of a question: array<struct<role, content>>; ``more`` is further context, put after the first."""
    chosen = kind(query)
    whole = context if more is None else F.when(F.length(more) > 0, F.concat(context, F.lit("\n\nAdditional context:\n"), more)).otherwise(context)
    pair = (("system", system_message(chosen, templates)), ("user", user_message(query, whole, chosen, templates)))
    return F.array(*(F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in pair))


def with_template(name: str, system: str, user: str, most_tokens: int = 512, temperature: float = 0.7) -> dict[str, tuple]:
    """The templates and one more, or another in place of one of them."""
    if "{query}" not in user or "{context}" not in user:
        raise ValueError("a template must have a place for {query} and one for {context}")
    return TEMPLATES | {name: (system, user, most_tokens, temperature)}


def sources_block(context: Column, sources: Column) -> Column:
    """A context with a line for each of sources array<struct<document_id, section_title, relevance_score>>."""
    lines = F.transform(sources, lambda s, i: F.format_string("[Source %d] | Document: %s | Section: %s | Relevance: %s", i + 1, s["document_id"], s["section_title"], fixed(s["relevance_score"], 2)))
    block = F.concat(F.lit("=== Context ===\n"), context, F.lit("\n\n=== Sources ===\n"), F.array_join(lines, "\n"), F.lit("\n"))
    return F.when(F.size(sources) > 0, block).otherwise(context)


#: Inputs of cross-encoders by kind of model; sequence models ask for a word, others take the two texts as a pair.
PAIR_FORMATS = {"sequence": "Query: {query} Document: {context} Relevant:", "pair": "{query} [SEP] {context}"}


def pair_input(query: Column, document: Column, most: int = 512, model: str = "sequence") -> Column:
    """A cross-encoder's input, the document cut so that the whole fits."""
    room = F.greatest(F.lit(most) - F.length(query) - 20, F.lit(0))
    return filled(PAIR_FORMATS[model], query, F.substring(document, F.lit(1), room))


def ranking_prompt(query: Column, passages: Column, reasons: bool = True, most: int = 4096) -> Column:
    """A listwise ranker's prompt: passages array<struct<chunk_id, text>> in order, by the first eight characters of their ids.

    A prompt of more than ``most`` characters is cut, so that a closing line still fits.
    """
    lines = F.transform(passages, lambda p, i: F.concat(F.lit("["), F.substring(p["chunk_id"], 1, 8), F.lit("] "), F.substring(p["text"], 1, 500)))
    form = '{"ranking": ["id", ...]' + (', "reasoning": {"1": "why"}' if reasons else "") + "}"
    text = F.concat(F.lit("Order these passages by how well they answer the question.\nQuestion: "), query, F.lit("\n\n"), F.array_join(lines, "\n"), F.lit(f"\n\nAnswer as JSON: {form}"))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 100), F.lit(f"\n\nAnswer as JSON: {form}"))).otherwise(text)
