"""Tags, estimates and document roll-ups of chunks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words (looked for anywhere in the lower-case text), patterns and weights of the content rules
TAGS = {
    "definitions": ("definition", "define", "means", "refers to"),
    "procedural": ("first", "second", "third", "step", "process"),
    "conclusions": ("result", "conclusion", "therefore", "thus"),
    "examples": ("example", "for instance", "such as"),
    "questions": ("?",),
    "technical": ("API", "URL", "HTTP", "JSON", "XML"),
}
AS_WRITTEN = ("technical",)  # these are looked for in the text as it is
NUMERIC = "[0-9]"
UNCERTAIN = ("unclear", "uncertain", "maybe", "possibly")
DEFINITIVE = ("clearly", "definitely", "precisely", "exactly")
SPECULATIVE = ("might", "could", "possibly", "perhaps", "allegedly", "supposedly")
SWEEPING = ("it is known", "everyone knows", "obviously")
ATTRIBUTION = ("according to", "research shows", "data indicates")  # in the text as it is
PRECISE = "[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]+[.][0-9]+|[A-Z]{2,}"


def holds(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text holds any of the words."""
    return reduce(or_, (F.contains(text, F.lit(w)) for w in words))


def lowered(text: str, low: str | None) -> Column:
    """The lower-case text, or the column that has it: rules look at it up to twenty times, and Spark would make it each time."""
    return F.lower(text) if low is None else F.col(low)


def tags(text: str, low: str | None = None) -> Column:
    low = lowered(text, low)
    found = [F.when(holds(F.col(text) if name in AS_WRITTEN else low, words), F.lit(name)) for name, words in TAGS.items()]
    return F.array_compact(F.array(*found, F.when(F.col(text).rlike(NUMERIC), F.lit("numeric"))))


def context(parts: dict[str, Column]) -> Column:
    """'name: value | name: value', without what is null."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in parts.items()])


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def confidence(text: str, about: str, low: str | None = None) -> Column:
    low, n = lowered(text, low), F.length(text)
    score = F.lit(0.7) + F.when(n < 50, -0.1).when(n > 500, 0.1).otherwise(0.0) + F.when(F.length(about) > 50, 0.1).otherwise(0.0)
    return clamped(score - F.when(holds(low, UNCERTAIN), 0.15).otherwise(0.0) + F.when(holds(low, DEFINITIVE), 0.1).otherwise(0.0))


def risk(text: str, low: str | None = None) -> Column:
    low = lowered(text, low)
    words = sum((F.when(F.contains(low, F.lit(w)), 0.1).otherwise(0.0) for w in SPECULATIVE), F.lit(0.1))
    return clamped(words + F.when(holds(low, SWEEPING), 0.2).otherwise(0.0) - F.when(holds(F.col(text), ATTRIBUTION), 0.1).otherwise(0.0) - F.when(F.col(text).rlike(PRECISE), 0.05).otherwise(0.0))


def document_quality(chunks: DataFrame, key: str) -> DataFrame:
    """Mean confidence and risk of each document, and its flags; a mean of zero raises none."""
    out = chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg("risk"), 6).alias("risk"))
    flags = F.array_compact(F.array(F.when((F.col("confidence") < 0.5) & (F.col("confidence") > 0), "low_confidence"), F.when(F.col("risk") > 0.5, "high_hallucination_risk")))
    return out.withColumn("flags", F.array_join(flags, ","))
