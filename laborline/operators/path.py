"""Career goals and paths: decision ladder, candidate scores, options, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vocab


def goal_decision(target_score: Column, other_score: Column, target_accuracy: Column, other_accuracy: Column, target_pass: Column, other_pass: Column) -> Column:
    """keep_target, switch or keep_both: a job that passes replaces one that doesn't by 10 points and better accuracy,
    one that passes by 20 points and .25."""
    ds, da = other_score - target_score, other_accuracy - target_accuracy
    return (
        F.when(target_score.isNull() & other_score.isNull(), "none").when(target_score.isNull(), "switch").when(other_score.isNull(), "keep_target")
        .when(~target_pass & other_pass & (ds >= 10) & (da > 0), "switch").when(target_pass & other_pass & (ds >= 20) & (da >= 0.25), "switch").otherwise("keep_target")
    )


def goal_score(match: Column, is_target: Column, direct: Column, transition: Column, hinted: Column, growing: Column) -> Column:
    """50, and .45 of the match for the target (.20 for others); by the source of a direct path that names the job 14 (graph),
    10 (offline) or 4 (fallback), of a transition path 10, 7 or 2, nothing without one (NULL); 10 for a hint, 5 for a target
    of a student whose growth is above average."""
    step = lambda c, a, b, n: F.when(c == "graph", a).when(c == "offline", b).when(c.isNotNull(), n).otherwise(0.0)
    points = 50 + F.when(is_target, 0.45).otherwise(0.20) * match + step(direct, 14.0, 10.0, 4.0) + step(transition, 10.0, 7.0, 2.0)
    points = points + F.when(hinted, 10.0).otherwise(0.0) + F.when(growing & is_target, 5.0).otherwise(0.0)
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), points)), 2)


def option_score(base: Column, source: Column, confidence: Column, ends_at_goal: Column, kind: Column) -> Column:
    """10 for graph, 4 for offline and -12 for fallback sources, 5 for high confidence, 6 for the goal at the end, 4 direct and 2 transfer."""
    return (
        base + F.when(source == "graph", 10).when(source == "offline", 4).when(source == "fallback", -12).otherwise(0) + F.when(confidence == "high", 5).otherwise(0)
        + F.when(ends_at_goal, 6).otherwise(0) + F.when(kind == "direct", 4).when(kind == "transfer", 2).otherwise(0)
    )


def best_options(options: DataFrame, student: str, score: str, ordinal: str) -> DataFrame:
    """Each student's best option; ties by the options' order."""
    return options.withColumn("_n", F.row_number().over(Window.partitionBy(student).orderBy(F.desc(score), ordinal))).filter("_n = 1").drop("_n")


def strategy(score: Column) -> Column:
    return F.when(score >= 80, "direct").when(score >= 70, "steady").otherwise("bridge")


def without_fallback(options: DataFrame, source: str = "source") -> DataFrame:
    return options.filter(F.col(source) != "fallback")


def gaps(required: DataFrame, have: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Required items that aren't there."""
    return required.select(*keys, item).distinct().join(have.select(*keys, item), [*keys, item], "left_anti")


def gap_priority(kind: Column, overall_score: Column) -> Column:
    """Skills, tools and practice are urgent; degree, major and certificates under a score of 75; the rest by its type."""
    urgent, formal = kind.isin("hard_skills", "tool_skills", "practice_experience"), kind.isin("education", "major", "certificates")
    return F.when(urgent | (formal & (overall_score < 75)), "high").when(formal | kind.isin("soft_skills", "career_direction"), "medium").otherwise("low")


def gap_hint(kind: Column, item: Column, suggestions: Column) -> Column:
    """The first suggestion that names the item, else the text for the type of gap."""
    said = F.when(item != "", F.get(F.filter(suggestions, lambda x: F.contains(x, item)), F.lit(0)))

    def filled(template: str, unnamed: str) -> Column:
        left, _, right = template.partition("{}")
        return F.concat(F.lit(left), F.when(item == "", unnamed).otherwise(item), F.lit(right)) if unnamed else F.lit(template)

    return F.coalesce(said, *[F.when(kind == k, filled(*v)) for k, v in vocab.GAP_HINTS.items()], F.lit(vocab.GAP_HINT_OTHER))


def gap_analysis(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, gap_type, gap_item, current_status, action_hint, priority, source: a row for each gap of a student and a job.

    Five sources in turn: what the match found missing, the job's skills, its tools, the student's weaknesses, dimensions
    without evidence. Skills and tools that the student has, that the match found or that an earlier source names are left out;
    equal gaps count once. ``pairs`` has a row for each pair, with the arrays missing_items (dimension, required_item,
    student_item, reason), matched_items (dimension, required_item), hard_skills, tool_skills, required_skills,
    required_tools, weaknesses, missing_dimensions, improvement_suggestions, and overall_match_score. Everything is an
    expression over a pair's own arrays, so nothing is shuffled. Null arrays count as empty, blank texts are left out.
    """
    some = F.col("_a")
    clean = lambda x: F.coalesce(text.clean_text(x), F.lit(""))
    listed = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), clean), lambda x: x != ""))
    named = lambda c: F.coalesce(F.col(c), F.array())
    missing = F.transform(
        F.filter(named("missing_items"), lambda x: x.isNotNull()),
        lambda x: F.struct(F.coalesce(F.nullif(clean(x["dimension"]), F.lit("")), F.lit("general")).alias("type"), clean(x["required_item"]).alias("item"), F.coalesce(F.nullif(clean(x["student_item"]), F.lit("")), clean(x["reason"])).alias("status")),
    )
    found = F.transform(F.filter(named("matched_items"), lambda x: x.isNotNull()), lambda x: F.struct(clean(x["dimension"]).alias("type"), clean(x["required_item"]).alias("item")))
    parts = [missing.alias("missing"), found.alias("found"), *[listed(c).alias(c) for c in ("hard_skills", "tool_skills", "required_skills", "required_tools", "weaknesses", "missing_dimensions", "improvement_suggestions")]]
    bound = pairs.select(*keys, F.coalesce(F.col("overall_match_score").cast("double"), F.lit(0.0)).alias("_score"), F.struct(*parts).alias("_a"))
    gap = lambda kind, item, status, hint, priority, source: F.struct(kind.alias("gap_type"), item.alias("gap_item"), status.alias("current_status"), hint.alias("action_hint"), priority.alias("priority"), F.lit(source).alias("source"))
    hint = lambda kind, item: gap_hint(kind, item, some["improvement_suggestions"])
    first = F.transform(some["missing"], lambda x: gap(x["type"], x["item"], x["status"], hint(x["type"], x["item"]), gap_priority(x["type"], F.col("_score")), "job_match.missing_items"))

    def open_items(kind: str, required: str, source: str) -> Column:
        of_kind = lambda c: F.transform(F.filter(some[c], lambda x: x["type"] == kind), lambda x: x["item"])
        left = F.array_except(some[required], F.concat(of_kind("missing"), of_kind("found"), some[kind]))
        return F.transform(left, lambda x: gap(F.lit(kind), x, F.lit(vocab.GAP_STATUS[kind]), hint(F.lit(kind), x), F.lit("high"), source))

    missing_status = vocab.GAP_DIMENSION_STATUS.split("{}")
    weak = F.transform(some["weaknesses"], lambda x: gap(F.lit("student_weakness"), x, x, F.lit(vocab.GAP_WEAKNESS_HINT), F.lit("medium"), "student_profile.weaknesses"))
    absent = F.transform(some["missing_dimensions"], lambda x: gap(F.lit("missing_dimension"), x, F.concat(F.lit(missing_status[0]), x, F.lit(missing_status[1])), F.lit(vocab.GAP_DIMENSION_HINT), F.lit("medium"), "student_profile.missing_dimensions"))
    gaps = F.concat(first, open_items("hard_skills", "required_skills", "job_profile.hard_skills"), open_items("tool_skills", "required_tools", "job_profile.tools_or_tech_stack"), weak, absent)
    return bound.select(*keys, F.posexplode(F.array_distinct(gaps)).alias("place", "_g")).select(*keys, (F.col("place") + 1).alias("place"), "_g.*")


#: Path type and source: points, the base under the match, its least value, and the match below which (or from which) it has priority.
OPTION_RULES = [
    ("direct_vertical", "graph", 8.0, 0.0, None), ("direct_vertical", "offline", 4.0, 0.0, ("from", 75.0)), ("transfer", "graph", 6.0, 2.0, ("below", 80.0)), ("transfer", "offline", 3.0, 5.0, ("below", 75.0)),
]


def candidate_options(options: DataFrame, kind: str = "path_type", source: str = "source", match: str = "match_score") -> DataFrame:
    """path_score_hint and priority_hint of written paths: the match (of transfers a little less, 50 at least) and points by type and source."""
    hint, priority = None, None
    for name, tier, points, off, rule in OPTION_RULES:
        mine = (F.col(kind) == name) & (F.col(source) == tier)
        base = F.greatest(F.lit(50.0), F.col(match) - off) if name == "transfer" else F.col(match)
        value = F.round(F.greatest(F.lit(0.0), base + points), 2)
        high = F.lit(True) if rule is None else F.col(match) >= rule[1] if rule[0] == "from" else F.col(match) < rule[1]
        word = F.when(high, "high").otherwise("medium")
        hint, priority = (F.when(mine, value), F.when(mine, word)) if hint is None else (hint.when(mine, value), priority.when(mine, word))
    return options.withColumns({"path_score_hint": hint, "priority_hint": priority}).filter("path_score_hint is not null")


def goal_candidates(sources: list[tuple[DataFrame, str]], student: str, most: int | None = None) -> DataFrame:
    """student, job, place: jobs from several tables (student, job, an order within), in the tables' order, each once."""
    rows = None
    for k, (table, order) in enumerate(sources):
        part = table.select(student, "job", F.lit(k).alias("_k"), F.col(order).alias("_o")).filter(F.trim("job") != "")
        rows = part if rows is None else rows.unionByName(part)
    once = rows.groupBy(student, "job").agg(F.min(F.struct("_k", "_o")).alias("_at"))
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy(student).orderBy("_at", "job"))).drop("_at")
    return placed if most is None else placed.filter(F.col("place") <= most)


def with_offline_paths(graph: DataFrame, profiles: DataFrame, job: str = "job") -> DataFrame:
    """(job, path, kind, source): paths of the graph, and those that job profiles list as JSON arrays (vertical_paths, transfer_paths)."""
    listed = F.array(*[F.struct(F.lit(k).alias("kind"), F.from_json(c, "array<string>").alias("paths")) for k, c in (("PROMOTE_TO", "vertical_paths"), ("TRANSFER_TO", "transfer_paths"))])
    offline = profiles.select(job, F.explode(listed).alias("l")).select(job, "l.kind", F.explode("l.paths").alias("path")).filter(F.trim("path") != "").distinct()
    known = graph.select(job, "path", "kind").distinct()
    rest = offline.join(known, [job, "path", "kind"], "left_anti")
    return known.withColumn("source", F.lit("graph")).unionByName(rest.withColumn("source", F.lit("offline")))


def primary_goal(user_job: Column, target_job: Column, recommended_job: Column, target: dict[str, Column], recommended: dict[str, Column]) -> Column:
    """struct(primary_plan_job, target_job_role, recommended_job_role, source, confidence, reasons): which job to plan for.

    ``target`` and ``recommended`` hold score, accuracy (a share, or hundredths above 1), asset_found, hard_pass and success. The
    target stays without a recommendation of its own assets; a recommendation takes its place where the target has none, or by
    10 points and better accuracy if it passes the gates; a target that passed the whole evaluation yields only to 20 points and
    .25 of accuracy.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    share = lambda c: F.when(c > 1, c / 100.0).otherwise(F.coalesce(c, F.lit(0.0)))
    sure = lambda d, k: F.coalesce(d[k], F.lit(False))
    fields = {"user": blank(user_job), "target": blank(target_job), "other": blank(recommended_job), "ts": F.coalesce(target["score"], F.lit(0.0)), "os": F.coalesce(recommended["score"], F.lit(0.0)), "ta": share(target["accuracy"]), "oa": share(recommended["accuracy"])}
    row = "struct<role:string,other_role:string,source:string,confidence:string,switch:boolean,reasons:array<string>>"

    def decided(x: Column) -> Column:
        ds, da = x["os"] - x["ts"], x["oa"] - x["ta"]
        own = F.coalesce(F.nullif(x["user"], F.lit("")), x["target"])
        strong = F.when(sure(recommended, "success"), "primary_goal").otherwise("primary_goal_candidate")
        case = lambda role, other, source, confidence, switch, *reasons: F.struct(*[c if isinstance(c, Column) else F.lit(c) for c in (role, other, source, confidence, switch)], F.array(*[r if isinstance(r, Column) else F.lit(r) for r in reasons])).cast(row)
        number = lambda c: F.format_string("%.2f", c)
        percent = lambda c: F.concat(F.bround(c * 100, 0).cast("long").cast("string"), F.lit("%"))
        known = sure(recommended, "asset_found")
        none = case("original_goal", "reference_only", F.when(known, "respect_user_target").otherwise("fallback_user_target"), F.when(sure(target, "asset_found"), "medium").otherwise("low"), False, F.when(known, "系统推荐岗位与用户目标岗位一致或差异不足，主目标保留用户原始目标岗位。").otherwise("系统推荐岗位缺少有效后处理资产，主目标保留用户原始目标岗位。"))
        ahead = [
            F.concat(x["other"], F.lit("主展示分"), number(x["os"]), F.lit("，高于"), F.coalesce(F.nullif(x["target"], F.lit("")), x["user"]), number(x["ts"]), F.lit("，优势为"), number(ds), F.lit("分。")),
            F.concat(x["other"], F.lit("知识点覆盖率"), percent(x["oa"]), F.lit("，高于目标岗位"), percent(x["ta"]), F.lit("。")),
            F.concat(x["other"], F.when(sure(recommended, "success"), "已通过赛题综合评测，更适合作为当前主路径。").otherwise("虽未完全通过赛题综合评测，但更接近达标，适合作为短期主路径候选。")),
        ]
        passes = sure(recommended, "hard_pass")
        chosen = (
            F.when((x["other"] == "") | (x["other"] == x["target"]) | ~known, none)
            .when(~sure(target, "asset_found"), case("stretch_goal", strong, "match_asset_score", "medium_high", True, "用户目标岗位未命中完整评测资产，系统优先采用资产完整的推荐岗位作为短期主路径。"))
            .when(sure(target, "success") & ~(passes & (ds >= 20) & (da >= 0.25)), case("original_goal", "secondary_goal", "respect_user_target", "high", False, "用户目标岗位已通过赛题综合评测，除非推荐岗位优势特别明显，否则优先尊重用户原目标。"))
            .when(passes & (ds >= 10) & (da > 0), case("stretch_goal", strong, "match_asset_score", F.when((ds >= 20) | sure(recommended, "success"), "medium_high").otherwise("medium"), True, *ahead))
            .otherwise(case("original_goal", "secondary_goal", "respect_user_target", "medium", False, "系统推荐岗位优势未达到切换阈值，主目标继续保留用户原始目标岗位。"))
        )

        def told(c: Column) -> Column:
            plan = F.when(c["switch"], x["other"]).otherwise(F.coalesce(F.nullif(own, F.lit("")), F.when((x["other"] == "") | (x["other"] == x["target"]) | ~known, x["other"]).otherwise("")))
            kept = F.when((x["user"] != "") & (plan != "") & (x["user"] != plan), F.array(F.concat(F.lit("用户原始目标"), x["user"], F.lit("不被否定，建议作为中期补强后的冲刺目标或备选目标保留。")))).otherwise(F.array().cast("array<string>"))
            return F.struct(plan.alias("primary_plan_job"), c["role"].alias("target_job_role"), c["other_role"].alias("recommended_job_role"), c["source"].alias("source"), c["confidence"].alias("confidence"), F.array_distinct(F.concat(c["reasons"], kept)).alias("reasons"))

        return text.let(chosen, told)

    return text.let(F.struct(*[c.alias(n) for n, c in fields.items()]), decided)
