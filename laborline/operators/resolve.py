"""From a requested name to a known one: staged lookups, candidates, confirmation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import registry, text, vocab
from ..functions.similarity import sequence_ratio
from ..session import checkpointed, join_hot

#: Stage, its rank, its confidence; the last one's is the similarity itself.
STAGES = [("exact", 1, 1.0), ("normalized", 2, 0.96), ("alias", 3, 0.98), ("tokens", 4, 0.9), ("similarity", 5, None)]
LEAST, MARGIN, CANDIDATE, MOST = 0.82, 0.08, 0.72, 5
#: Similarity of a key that contains the other, at least; letters of a key that is compared by similarity, at least.
CONTAINED, LEAST_LETTERS = 0.86, 4


def name_key(name: Column, drop_levels: bool = True) -> Column:
    """Lower case without weak words, symbols and, if asked, words of level; NULL for nothing."""
    key = F.translate(F.lower(text.clean_text(name)), "＋＃", "+#")
    key = F.regexp_replace(key, vocab.WEAK_NAME_WORDS, "")
    if drop_levels:
        key = F.regexp_replace(key, vocab.LEVEL_NAME_WORDS, "")
    return F.nullif(F.regexp_replace(key, vocab.NAME_SYMBOLS, ""), F.lit(""))


def name_tokens(name: Column) -> Column:
    """Latin words and the known role words in it, as keys: of these the specific ones (three letters, or Latin), else all."""
    low = F.lower(text.clean_text(name))
    latin = F.transform(F.regexp_extract_all(low, F.lit(r"([a-zA-Z][a-zA-Z0-9+#/]*)"), F.lit(1)), lambda t: name_key(t, False))

    def chosen(compact: Column) -> Column:
        known = F.array_compact(F.array(*[F.when(F.contains(compact, F.lit(k)), F.lit(k)) for k in dict.fromkeys(w.replace("/", "") for w in vocab.ROLE_WORDS)]))
        every = F.array_distinct(F.concat(F.array_compact(latin), known))
        special = F.filter(every, lambda t: (F.char_length(t) >= 3) | F.rlike(t, F.lit("[a-zA-Z+#/]")))
        return F.when(F.size(special) > 0, special).otherwise(every)

    return F.coalesce(text.let(name_key(low, False), chosen), F.array().cast("array<string>"))


def grams(c: Column, n: int) -> Column:
    """The different runs of ``n`` letters."""
    some = F.transform(F.sequence(F.lit(1), F.char_length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.char_length(c) >= n, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))


def token_pairs(requests: DataFrame, names: DataFrame) -> DataFrame:
    """(request, name): names whose key holds every token of the request. They meet in a pair of letters of the longest token."""
    longest = F.reduce("tokens", F.lit(""), lambda a, b: F.when(F.char_length(b) > F.char_length(a), b).otherwise(a))
    asked = requests.filter(F.size("tokens") > 0).select("request", "tokens", F.left(longest, F.lit(2)).alias("gram"))
    have = names.select("name", "plain", F.explode(F.array_union(grams(F.col("plain"), 1), grams(F.col("plain"), 2))).alias("gram"))
    return asked.join(have, "gram").filter(F.forall("tokens", lambda t: F.contains(F.col("plain"), t))).select("request", "name")


def similar_pairs(requests: DataFrame, names: DataFrame) -> DataFrame:
    """(request, name, score) from CANDIDATE on: difflib's ratio of the keys, or CONTAINED if one holds the other.

    Pairs meet in two letters that follow one another. Matching letters that are all apart reach CANDIDATE only in keys of
    11 letters together (k of them need 3k - 1 letters): those also meet in single letters. So no pair is lost.
    """
    short = F.char_length("key") <= 10
    pieces = lambda c: F.array_union(grams(F.col(c), 2), F.when(short, grams(F.col(c), 1)).otherwise(F.array().cast("array<string>")))
    a = requests.filter(F.char_length("key") >= LEAST_LETTERS).select("request", F.col("key").alias("a"), F.explode(pieces("key")).alias("gram"))
    b = names.filter("key is not null").select("name", F.col("key").alias("b"), F.explode(pieces("key")).alias("gram"))
    pairs = a.join(b, "gram").filter((F.char_length("gram") == 2) | (F.char_length("a") + F.char_length("b") <= 11)).select("request", "name", "a", "b").distinct()
    ratio = checkpointed(pairs.withColumn("ratio", sequence_ratio(F.col("a"), F.col("b"))))
    inside = F.contains("a", F.col("b")) | F.contains("b", F.col("a"))
    return ratio.select("request", "name", F.when(inside, F.greatest("ratio", F.lit(CONTAINED))).otherwise(F.col("ratio")).alias("score")).filter(F.col("score") >= CANDIDATE)


def resolve(requests: DataFrame, names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """request, status (resolved, ambiguous, unresolved), stage, name, confidence, candidates.

    requests: a column request; names: a column name; aliases: alias, name. The first stage with a hit decides: one hit
    resolves, several are ambiguous. By similarity the best resolves from LEAST on if it is MARGIN ahead of the next;
    else the likely ones are candidates of an unresolved request. Every stage is an equi join.
    """
    r = checkpointed(requests.select("request").distinct().withColumns({"key": name_key(F.col("request")), "tokens": name_tokens(F.col("request"))}))
    n = checkpointed(names.select("name").filter("name is not null").distinct().withColumns({"key": name_key(F.col("name")), "plain": name_key(F.col("name"), False)}))
    hit = lambda df, k: df.select("request", F.lit(k).alias("stage_no"), "name", F.lit(STAGES[k - 1][2]).cast("double").alias("score"))
    hits = hit(r.join(n.select("name", F.col("name").alias("request")), "request"), 1).unionByName(hit(r.join(n.select("name", "key"), "key"), 2))
    if aliases is not None:
        known = aliases.join(n.select("name"), "name", "left_semi").select(name_key(F.col("alias")).alias("key"), "name").distinct()
        hits = hits.unionByName(hit(r.join(known, "key"), 3))
    hits = hits.unionByName(hit(token_pairs(r, n), 4))
    settled = checkpointed(hits)
    left = r.join(settled.select("request"), "request", "left_anti")
    ranked = similar_pairs(left, n).withColumn("_n", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("score"), "name"))).filter(F.col("_n") <= MOST)
    ranked = ranked.select("request", F.lit(5).alias("stage_no"), "name", "score", "_n")
    first = settled.groupBy("request").agg(F.min("stage_no").alias("stage_no"))
    staged = settled.join(first, ["request", "stage_no"]).groupBy("request", "stage_no").agg(F.array_sort(F.collect_set("name")).alias("candidates"), F.max("score").alias("confidence"))
    staged = staged.withColumn("sure", F.size("candidates") == 1)
    by_score = F.array_sort(F.collect_list(F.struct("_n", "name")))
    at = lambda k: F.coalesce(F.max(F.when(F.col("_n") == k, F.col("score"))), F.lit(0.0))
    liked = ranked.groupBy("request", "stage_no").agg(F.transform(by_score, lambda x: x["name"]).alias("candidates"), at(1).alias("confidence"), at(2).alias("_next"))
    liked = liked.withColumn("sure", (F.col("confidence") >= LEAST) & (F.col("confidence") - F.col("_next") >= MARGIN)).drop("_next")
    decided = staged.unionByName(liked.withColumn("candidates", F.when(F.col("sure"), F.slice("candidates", 1, 1)).otherwise(F.col("candidates"))))
    label = F.coalesce(*[F.when(F.col("stage_no") == k, F.lit(s)) for s, k, _ in STAGES])
    sure = F.coalesce("sure", F.lit(False))
    status = F.when(sure, "resolved").when(F.col("stage_no") < 5, "ambiguous").otherwise("unresolved")
    return r.select("request").join(decided, "request", "left").select(
        "request", status.alias("status"), F.when(status != "unresolved", label).alias("stage"), F.when(sure, F.col("candidates")[0]).alias("name"),
        F.when(sure, F.round("confidence", 4)).alias("confidence"), F.slice(F.coalesce("candidates", F.array().cast("array<string>")), 1, MOST).alias("candidates"),
    )


def confirmed(resolved: DataFrame, choices: DataFrame, broad: list[str]) -> DataFrame:
    """A saved choice (request, choice) goes first; broad requests without one need confirmation."""
    joined = resolved.join(choices.select("request", "choice"), "request", "left")
    needs = F.col("choice").isNull() & (F.lower("request").isin(*broad) | (F.col("status") != "resolved"))
    return joined.withColumns({"name": F.coalesce("choice", "name"), "needs_confirmation": needs}).drop("choice")


def quality_score(degree: Column, major: Column, skill: Column, path: Column, level: Column) -> Column:
    return 0.2 * degree + 0.2 * major + 0.15 * skill + 0.3 * path + 0.15 * level


def candidate_score(name: Column, skill: Column, quality: Column, samples: Column, is_core: Column) -> Column:
    """.35 name, .35 skill, .20 quality, .10 of sample size and core membership."""
    return F.round(0.35 * name + 0.35 * skill + 0.20 * quality + 0.10 * (0.7 * F.least(samples / 300.0, F.lit(1.0)) + 0.3 * is_core.cast("int")), 4)


def with_standard_names(df: DataFrame, listed: str, sources: list[tuple[str, str]]) -> DataFrame:
    """``df`` with named: array<struct(source, names)>, the standard names of a list in a text by each (domain, module), once each, in order.

    The dictionaries are long, so they are asked once for each different item of a module, not for each row.
    """
    lists = checkpointed(df.select(F.col(listed).alias("_l")).filter("_l is not null").distinct())
    modules = list(dict.fromkeys(m for _, m in sources))
    cut = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), registry.items(F.col("_l"), m).alias("x")) for m in modules])).alias("e")
    items = checkpointed(lists.select("_l", cut).select("_l", F.col("e.m").alias("m"), F.posexplode("e.x").alias("at", "x")).select("_l", "at", F.struct("m", "x").alias("k")))
    different = checkpointed(items.select("k").distinct())
    names = [(F.col("k.m") == m, F.struct(F.lit(f"{d} {m}").alias("source"), registry.standard_name(F.col("k.x"), d, m).alias("name"))) for d, m in sources]
    known = checkpointed(different.select("k", F.array_compact(F.array(*[F.when(own, name) for own, name in names])).alias("n")))
    said = join_hot(items, known, "k").groupBy("_l").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("_n"))
    every = F.flatten(F.transform("_n", lambda x: x["n"]))
    of = lambda source: F.array_distinct(F.transform(F.filter(every, lambda x: x["source"] == source), lambda x: x["name"]))
    done = checkpointed(said.select(F.col("_l").alias(listed), F.array(*[F.struct(F.lit(f"{d} {m}").alias("source"), of(f"{d} {m}").alias("names")) for d, m in sources]).alias("named")))
    none = F.array(*[F.struct(F.lit(f"{d} {m}").alias("source"), F.array().cast("array<string>").alias("names")) for d, m in sources])
    return join_hot(df, done, listed, "left").withColumn("named", F.coalesce("named", none))
