"""What statuses are called, and ladders from one set of statuses to another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for statuses, and messages for outcomes.
READABLE = {
    "SOURCE_BASED": "source check", "PHOTO_CARD": "photocard", "MULTIMODAL": "text and image", "EXPERT_REVIEW": "awaiting expert review", "FINALIZED": "review complete",
    "NOT_FOUND": "not found in claimed source", "INCOMPLETE": "check incomplete", "CONFIRMED": "relevant article found in claimed source", "MATCHED": "matched",
    "MISMATCHED": "mismatched", "REAL": "real", "FAKE": "fake", "ALTERED": "altered", "MISLEADING": "misleading",
}
TECHNICAL = r"(?i)gemini|existing_fallback|labse|deberta|banglabert|efficientnet|traceback|exception|\b(?:NLI|OCR|HTTP|API)\b|\b[A-Z]+_[A-Z_]+\b|embedding|token count|model.version|pipeline|extractor"
LIMITS = "Some automated checks have limitations; review the available source evidence before drawing a conclusion."
ATTEMPTS = {
    "timeout": "timed out", "network_error": "could not reach the service", "http_error": "the service returned an error", "permanent_error": "the request was rejected",
    "quota_exhausted": "the daily image-reading limit has been reached", "malformed_response": "returned an invalid response",
}
SOURCE_LINES = {"NOT_FOUND": "Not found in the claimed source", "INCOMPLETE": "Source check incomplete"}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def title_case(status: Column) -> Column:
    """EXPERT_REVIEW as Expert Review."""
    return F.initcap(F.replace(status, F.lit("_"), F.lit(" ")))


def reasoning(**parts: Column) -> Column:
    """One sentence per part that isn't null: its name, and what it says."""
    said = [F.concat(F.lit(name.replace("_", " ").capitalize() + ": "), value, F.lit(".")) for name, value in parts.items()]
    return F.array_join(F.array_compact(F.array(*said)), " ")


def readable(text: Column) -> Column:
    """An explanation for readers: words for statuses, one general sentence in place of technical ones, none twice."""
    words = F.split(text, r"\b")
    plain = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(_map(READABLE), w), w)), "")
    parts = F.transform(F.split(plain, r"(?<=[.!?])\s+|\n"), lambda s: F.when(s.rlike(TECHNICAL), F.lit(LIMITS)).otherwise(s))
    return F.coalesce(F.array_join(F.array_distinct(parts), " "), F.lit(""))


def attempt_messages(attempts: Column) -> Column:
    """A message per attempt array<struct<attempt, outcome>> that didn't succeed."""
    failed = F.filter(attempts, lambda a: ~a["outcome"].eqNullSafe(F.lit("success")))
    return F.transform(failed, lambda a: F.concat(F.lit("Image reading attempt "), a["attempt"].cast("string"), F.lit(" "), F.coalesce(F.try_element_at(_map(ATTEMPTS), F.coalesce(a["outcome"], F.lit(""))), F.lit("failed")), F.lit(".")))


def kept_warnings(warnings: Column, dropped: str = "(?i)date|source") -> Column:
    return F.filter(warnings, lambda w: ~w.rlike(dropped))


def axes(label: Column) -> Column:
    """struct<source, content> of one of the old labels, which had both in one; null axes where it says nothing."""
    source = F.when(label == "NOT_FOUND_IN_CLAIMED_SOURCE", "NOT_FOUND").when(label.isNotNull(), "CONFIRMED")
    content = F.when(label == "TRUE", "MATCHED").when(label.isin("FALSE", "PARTIALLY_TRUE"), "ALTERED")
    return F.struct(source.alias("source"), content.alias("content"))


def from_axes(source: Column, content: Column) -> Column:
    """The old label of both axes, as far as there is one."""
    return F.when(source == "NOT_FOUND", "NOT_FOUND_IN_CLAIMED_SOURCE").when(content == "MATCHED", "TRUE").when(content == "ALTERED", "FALSE")


def verdict_of_axes(source: Column, content: Column, date: Column) -> Column:
    """FAKE, ALTERED or MISLEADING by the first axis that fails, else REAL; open axes don't fail."""
    return F.when(source == "NOT_FOUND", "FAKE").when(content == "ALTERED", "ALTERED").when(date == "MISMATCHED", "MISLEADING").otherwise("REAL")


def headline_status(content: Column, exact: Column, basis: Column, same: Column) -> Column:
    """ALTERED, EXACT_MATCHED, MEANING_PRESERVED, or null without a finding; same (equal keys) counts where exact is unknown."""
    is_exact = F.coalesce(exact, F.coalesce(same, F.lit(False))) | F.coalesce(basis == "exact", F.lit(False))
    return F.when(content == "ALTERED", "ALTERED").when(content == "MATCHED", F.when(is_exact, "EXACT_MATCHED").otherwise("MEANING_PRESERVED"))


def vote_fault(kind: Column, source: Column, content: Column, date: Column) -> Column:
    """Why a vote's further findings don't hold together; null if they do."""
    any_axis = F.coalesce(source, content, date).isNotNull()
    return F.when((kind == "MULTIMODAL") & any_axis, "no axes").when((kind != "MULTIMODAL") & ~source.eqNullSafe(F.lit("CONFIRMED")) & F.coalesce(content, date).isNotNull(), "no source")


def retrieval_failed(fetched: Column, fetch_errors: Column, extracted: Column, extraction_errors: Column) -> Column:
    return ((fetched > 0) & (fetch_errors >= fetched)) | ((extracted > 0) & (extraction_errors >= extracted))


def equivalent(entails: Column, contradicts: Column, cosine: Column) -> Column:
    """Whether a title says the same as a headline; false where the cosine or a model's answer is missing."""
    return F.coalesce((F.coalesce(entails, F.lit(0.0)) >= 0.80) & (F.coalesce(contradicts, F.lit(0.0)) <= 0.20) & (cosine >= 0.70) & F.coalesce(entails, contradicts).isNotNull(), F.lit(False))


def predicted_verdict(prediction: Column) -> Column:
    return F.when(prediction.isNull(), F.lit(None)).when(prediction == "FAKE", "FAKE").otherwise("REAL")


def summary(kind: Column, status: Column, source: Column, headline: Column, date: Column, claimed_date: Column, prediction: Column, final: Column) -> Column:
    """struct<lines, stage, final>: what a client shows of a result, and which notice it stands for."""
    checked = (kind != "MULTIMODAL") & source.isNotNull()
    found = checked & (source == "CONFIRMED")
    lines = F.array_compact(F.array(
        F.when(final.isNotNull(), F.concat(F.lit("Final decision: "), F.initcap(final))),
        F.when(checked, F.try_element_at(_map(SOURCE_LINES), source)),
        F.when(found, F.concat(F.lit("Headline: "), F.coalesce(title_case(headline), F.lit("No verdict")))),
        F.when(found & claimed_date.isNotNull() & date.isNotNull(), F.concat(F.lit("Date: "), title_case(date))),
        F.when(kind == "MULTIMODAL", F.concat(F.lit("AI decision: "), F.initcap(prediction))),
    ))
    stage = F.when(status == "FAILED", "failed").when(final.isNotNull() & (status == "FINALIZED"), F.concat(F.lit("final:"), final)).when(F.coalesce(source, prediction).isNotNull() & status.isin("EXPERT_REVIEW", "ESCALATED", "FINALIZED"), "preliminary")
    return F.struct(lines.alias("lines"), stage.alias("stage"), final.isNotNull().alias("final"))
