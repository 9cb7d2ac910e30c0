"""Keyword relevance with a three-way decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vocab

DESCRIPTION_CHARS = 1400


def judgement(title: Column, description: Column, industry: Column) -> Column:
    """struct(cs, non, cs_keywords, non_cs_keywords, ambiguous, decision, confidence, source).

    1.2 times the title's weight, plus description and industry. One expression that names each text once and binds texts
    and scores to variables, so that a filter on the decision copies it once, however the plan is optimized.
    """
    low = lambda c: F.coalesce(F.lower(c), F.lit(""))
    texts = F.struct(low(title).alias("t"), F.left(low(description), F.lit(DESCRIPTION_CHARS)).alias("d"), low(industry).alias("i"))
    yes, no = (vocab.CS_TITLE, vocab.CS_DESCRIPTION, vocab.CS_INDUSTRY), (vocab.NON_CS_TITLE, vocab.NON_CS_DESCRIPTION, vocab.NON_CS_INDUSTRY)

    def hits(x: Column) -> Column:
        sides = [text.weighted_hits(x[name], words).alias(f"{side}_{name}") for side, lists in (("yes", yes), ("no", no)) for name, words in zip("tdi", lists, strict=True)]
        return F.struct(*sides, text.any_of(x["t"], vocab.AMBIGUOUS_TITLES).alias("ambiguous"))

    def summed(h: Column) -> Column:
        score = lambda side: F.round(1.2 * text.total_weight(h[f"{side}_t"]) + text.total_weight(h[f"{side}_d"]) + text.total_weight(h[f"{side}_i"]), 4)
        words = lambda side: F.concat_ws(",", F.array_distinct(F.transform(F.concat(*[h[f"{side}_{n}"] for n in "tdi"]), lambda k: k["word"])))
        return F.struct(score("yes").alias("cs"), score("no").alias("non"), words("yes").alias("cs_keywords"), words("no").alias("non_cs_keywords"), h["ambiguous"].alias("ambiguous"))

    def judged(s: Column) -> Column:
        d = lambda name: decision(s["cs"], s["non"], s["ambiguous"])[name].alias(name)
        return F.struct(*[s[n].alias(n) for n in ("cs", "non", "cs_keywords", "non_cs_keywords", "ambiguous")], d("decision"), d("confidence"), d("source"))

    return text.let(text.let(text.let(texts, hits), summed), judged)


def scores(df: DataFrame, title: str = "job_title", description: str = "job_description", industry: str = "industry") -> DataFrame:
    """cs_score and non_cs_score, matched keywords, ambiguity, and the struct _r that they come from."""
    out = df.withColumn("_r", judgement(F.col(title), F.col(description), F.col(industry)))
    names = {"cs_score": "cs", "non_cs_score": "non", "cs_keywords": "cs_keywords", "non_cs_keywords": "non_cs_keywords", "is_ambiguous_title": "ambiguous"}
    return out.withColumns({k: F.col(f"_r.{v}") for k, v in names.items()})


def decision(cs: Column, non: Column, ambiguous: Column) -> Column:
    """struct(decision, confidence, source): drop, keep, or the fallback for undecided rows."""
    drop = (non >= 3) & (non - cs >= 1.5)
    keep = (cs >= 3) & (cs - non >= 1) & ~(ambiguous & (non > 0))
    soft = ambiguous & (cs >= 2.4) & (non <= 1.2)
    name = F.when(drop, "drop").when(keep | soft, "keep").when(cs >= non, "keep").otherwise("drop")
    sure = F.when(drop, F.least(F.lit(0.99), 0.65 + 0.06 * non)).when(keep, F.least(F.lit(0.99), 0.62 + 0.05 * cs)).when(soft, 0.72).otherwise(0.51)
    return F.struct(name.alias("decision"), F.round(sure, 4).alias("confidence"), F.when(drop | keep | soft, "rule").otherwise("fallback").alias("source"))


def audited(df: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """All rows with is_cs_related, its source and confidence. ``judged`` (record_id, is_cs_related, confidence) settles undecided rows."""
    out = scores(df).withColumns({"is_cs_related": F.col("_r.decision") == "keep", "cs_filter_source": F.col("_r.source"), "cs_filter_confidence": F.col("_r.confidence")}).drop("_r")
    if judged is None:
        return out
    j = judged.select("record_id", F.col("is_cs_related").alias("_is"), F.col("confidence").alias("_conf"))
    joined = out.join(j, "record_id", "left")
    use = (F.col("cs_filter_source") == "fallback") & F.col("_is").isNotNull()
    return joined.withColumns(
        {"is_cs_related": F.when(use, F.col("_is")).otherwise(F.col("is_cs_related")), "cs_filter_confidence": F.when(use, F.col("_conf")).otherwise(F.col("cs_filter_confidence")), "cs_filter_source": F.when(use, "judged").otherwise(F.col("cs_filter_source"))}
    ).drop("_is", "_conf")


def kept(audit: DataFrame) -> DataFrame:
    return audit.filter("is_cs_related")


def source_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("cs_filter_source", "is_cs_related").agg(F.count("*").alias("n"))
