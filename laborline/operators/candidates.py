"""Candidates for a requested job: known names that resemble it, scored by name, skills, the quality and size of their assets.

Requests and names meet in an inverted index of letters. A letter counts once more for each of its occurrences, so the entries
that two names share are at least the letters that any matching can pair up: they bound the similarity from above, and only
pairs that can reach a bound are compared. No pair that reaches it is lost, and nothing is a cross join: names that share no
letter don't meet. The index holds each different request and name once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.similarity import sequence_ratio
from ..session import checkpointed, join_hot
from .resolve import candidate_score, name_key, name_tokens

#: A name is a candidate from this similarity on; similarity of a name that holds the other, as a candidate and in the score.
LEAST, HELD, HELD_IN_SCORE = 0.45, 0.78, 0.82
MOST_NAMES, MOST, LEAST_SCORE = 12, 5, 0.16


def counted_letters(c: Column) -> Column:
    """The letters of a key, each with the number of its occurrence."""
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    return text.let(letters, lambda a: F.transform(a, lambda x, i: F.concat(x, F.size(F.filter(F.slice(a, 1, i + 1), lambda y: y == x)).cast("string"))))


def _share(tokens: Column, key: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.filter(tokens, lambda t: F.contains(key, t))).cast("double"), F.size(tokens)), F.lit(0.0))


def similar_names(requests: DataFrame, names: DataFrame) -> DataFrame:
    """request, name, found (the similarity by which it is a candidate, from LEAST on), similarity (that of the score)."""
    r = checkpointed(requests.select("request").filter(F.trim("request") != "").distinct().withColumns({"a": name_key(F.col("request")), "tokens": name_tokens(F.col("request"))}))
    n = checkpointed(names.select("name").filter(F.trim("name") != "").distinct().withColumns({"b": name_key(F.col("name")), "plain": name_key(F.col("name"), False)}))
    asked = r.select("request", F.explode(F.array_distinct(F.concat(counted_letters(F.coalesce("a", F.lit(""))), F.transform("tokens", lambda t: F.concat(F.left(t, F.lit(1)), F.lit("1")))))).alias("entry"))
    known = n.select("name", F.explode(F.array_union(counted_letters(F.coalesce("b", F.lit(""))), counted_letters(F.coalesce("plain", F.lit(""))))).alias("entry"))
    met = asked.join(known, "entry").groupBy("request", "name").agg(F.count("*").alias("shared"))
    both = met.join(r, "request").join(n, "name")
    letters = F.char_length("a") + F.char_length("b")
    held = lambda x: F.coalesce(F.contains(x, F.col("a")) | F.contains(F.col("a"), x), F.lit(False))
    both = both.withColumns({"hits": _share(F.col("tokens"), F.col("plain")), "_held": held(F.col("plain")), "_bound": F.coalesce(2.0 * F.col("shared") / letters, F.lit(0.0))})
    some = both.filter((F.col("_bound") >= LEAST) | F.col("_held") | (F.col("hits") >= LEAST))
    ratio = checkpointed(some.withColumn("ratio", F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(sequence_ratio(F.col("a"), F.col("b")))))
    keyed = F.col("a").isNotNull() & F.col("b").isNotNull()
    similarity = F.round(F.least(F.lit(1.0), F.greatest("ratio", F.when(held(F.col("b")), HELD_IN_SCORE).otherwise(0.0), _share(F.col("tokens"), F.col("b")))), 4)
    scored = ratio.withColumn("similarity", F.when(keyed, similarity).otherwise(0.0))
    return scored.select("request", "name", F.greatest("similarity", F.when(F.col("_held"), HELD).otherwise(0.0), "hits").alias("found"), "similarity").filter(F.col("found") >= LEAST)


def term_overlap(left: Column, right: Column) -> Column:
    """The share of the terms on the left that equal, hold or are held by one on the right."""
    hits = F.filter(left, lambda t: F.exists(right, lambda o: F.contains(o, t) | F.contains(t, o)))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(F.round(F.size(hits) / F.size(left), 4))


def terms(c: Column) -> Column:
    """Keys of terms, each once, in order."""
    return F.array_distinct(F.array_compact(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: name_key(x, False))))


def candidate_jobs(requests: DataFrame, assets: DataFrame, most: int = MOST) -> DataFrame:
    """request_id, place, name, candidate_score, name_score, skill_score, reason: the best candidates of each request, ``most`` at most.

    ``requests``: request_id, request, terms (the student's; an empty array gives no points for skills). ``assets``, a row for
    each known name: name, place (their order, which decides ties), terms, quality, sample_count, is_core, required_points.
    Blank requests have no candidates. Of equal scores the name found first stands first. Candidates are chosen once for each
    different request with its terms, and given to all rows that ask for the same.
    """
    found = similar_names(requests, assets)
    order = assets.select("name", F.col("place").alias("_at"))
    ranked = found.join(order, "name").withColumn("_n", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("found"), "_at"))).filter(F.col("_n") <= MOST_NAMES)
    listed = checkpointed(ranked.groupBy("request").agg(F.collect_list(F.struct("name", "similarity", "_n")).alias("_names")))
    rows = checkpointed(requests.select("request_id", F.struct("request", terms(F.col("terms")).alias("own")).alias("_k")))
    asked = checkpointed(rows.select("_k").distinct().select("_k", "_k.request", F.col("_k.own").alias("_own")))
    have = assets.select("name", terms(F.concat(F.array("name"), F.coalesce("terms", F.array().cast("array<string>")))).alias("_terms"), "quality", "sample_count", "is_core", "required_points")
    met = checkpointed(join_hot(asked, listed, "request").select("_k", "request", "_own", F.inline("_names")))
    both = join_hot(met, have, "name").withColumn("skill_score", term_overlap(F.col("_own"), F.col("_terms")))
    scored = both.withColumn("candidate_score", candidate_score(F.col("similarity"), F.col("skill_score"), F.col("quality"), F.col("sample_count"), F.col("is_core"))).filter(F.col("candidate_score") >= LEAST_SCORE)
    said = F.array_compact(
        F.array(
            F.when(F.col("similarity") >= 0.75, F.concat(F.lit("岗位名称与“"), "request", F.lit("”相近"))), F.when(F.col("skill_score") > 0, "学生技能/经历与该岗位知识点存在重合"),
            F.when(F.col("required_points") > 0, F.concat(F.lit("该岗位沉淀了 "), F.col("required_points").cast("string"), F.lit(" 个必备知识点"))),
        )
    )
    reason = F.concat("name", F.lit("："), F.when(F.size(said) > 0, F.array_join(said, "，")).otherwise("该岗位是本地资产中的可能相关标准岗位"), F.lit("。"))
    best = scored.withColumn("place", F.row_number().over(Window.partitionBy("_k").orderBy(F.desc("candidate_score"), "_n"))).filter(F.col("place") <= most)
    kept = best.select("_k", F.struct("place", "name", "candidate_score", F.col("similarity").alias("name_score"), "skill_score", reason.alias("reason")).alias("_c"))
    lists = checkpointed(kept.groupBy("_k").agg(F.array_sort(F.collect_list("_c")).alias("_c")))
    return join_hot(rows, lists, "_k").select("request_id", F.inline("_c"))
