"""Similarities as Spark columns: tag similarity, one-to-one matching, hashed embeddings, cosine; and difflib as a pandas UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .parse import embedding_tokens
from .text import let, tag_token

DIMENSION = 384


def char_set(c: Column) -> Column:
    return F.filter(F.array_distinct(F.split(c, "")), lambda x: x != "")


def dice(a: Column, b: Column) -> Column:
    """Of the sets of characters."""
    x, y = char_set(a), char_set(b)
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(x, y)), F.size(x) + F.size(y)), F.lit(0.0))


def token_similarity(a: Column, b: Column, least_contained: int = 1) -> Column:
    """1 for equal tokens, .9 if one contains the other, else the Dice share of characters, to four digits."""
    tokens = F.struct(F.coalesce(tag_token(a), F.lit("")).alias("x"), F.coalesce(tag_token(b), F.lit("")).alias("y"))
    return let(tokens, lambda t: similarity_of_tokens(t["x"], t["y"], least_contained))


def similarity_of_tokens(x: Column, y: Column, least_contained: int = 1) -> Column:
    long = F.least(F.char_length(x), F.char_length(y)) >= least_contained
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(long & (F.contains(x, y) | F.contains(y, x)), 0.9).otherwise(F.round(dice(x, y), 4))


def _tagged(tags: Column) -> Column:
    return F.transform(tags, lambda t, k: F.struct(k.alias("k"), t.alias("tag"), F.coalesce(tag_token(t), F.lit("")).alias("token")))


def one_to_one(student: Column, job: Column, least: float) -> Column:
    """Pairs of tags, most similar first and no tag twice: array<struct(similarity, job, student)>.

    Ties go by the place in the job's list, then in the student's.
    """
    pair = "struct<neg:double,j:int,s:int,job:string,student:string>"

    def matched(both: Column) -> Column:
        def row(j: Column, s: Column) -> Column:
            return F.struct((-similarity_of_tokens(s["token"], j["token"])).alias("neg"), j["k"].alias("j"), s["k"].alias("s"), j["tag"].alias("job"), s["tag"].alias("student"))

        pairs = F.flatten(F.transform(both["job"], lambda j: F.transform(both["student"], lambda s: row(j, s))))
        ranked = F.array_sort(F.filter(pairs, lambda p: p["neg"] <= -least)).cast(f"array<{pair}>")
        free = lambda taken, p: ~F.exists(taken, lambda t: (t["j"] == p["j"]) | (t["s"] == p["s"]))
        chosen = F.aggregate(ranked, F.array().cast(f"array<{pair}>"), lambda taken, p: F.when(free(taken, p), F.concat(taken, F.array(p))).otherwise(taken))
        return F.transform(chosen, lambda p: F.struct((-p["neg"]).alias("similarity"), p["job"].alias("job"), p["student"].alias("student")))

    return let(F.struct(_tagged(student).alias("student"), _tagged(job).alias("job")), matched)


def tags_score(student: Column, job: Column, least: float) -> Column:
    """Share of the job's tags that are matched, in percent; 100 for a job without tags."""
    return F.when(F.size(job) == 0, 100.0).when(F.size(student) == 0, 0.0).otherwise(F.round(F.size(one_to_one(student, job, least)) / F.size(job) * 100, 2))


def token_slot(token: Column, dimension: int = DIMENSION) -> Column:
    """struct(slot, sign): the place that the token's md5 names, and whether it adds or takes one."""
    digest = F.md5(token)
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    return F.struct((F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dimension).alias("slot"), sign.alias("sign"))


def hash_embedding(text: Column, dimension: int = DIMENSION) -> Column:
    """array<double> of unit length, for short texts; vector.embed does long ones by grouping."""

    def summed(slots: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.aggregate(F.filter(slots, lambda s: s["slot"] == i), F.lit(0.0), lambda a, s: a + s["sign"]))

    return unit(let(F.transform(embedding_tokens(text), lambda t: token_slot(t, dimension)), summed))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    return let(a, lambda v: let(norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))))


def cosine(a: Column, b: Column) -> Column:
    """Zero where a vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio; no SQL function computes it, so keep it behind blocking."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


@F.pandas_udf(StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    """All named and numbered entities; the common ones have a plain column form in text.unescape."""
    import html

    return s.map(html.unescape, na_action="ignore")
