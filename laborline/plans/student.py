"""The student job: profiles scored, matched with the job they name or with all, goals and paths chosen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import match, path, report, student


def profiles(students: DataFrame) -> DataFrame:
    """Adds completeness, competitiveness and band to students with array columns and text fields."""
    n = lambda c: F.coalesce(F.size(F.array_distinct(c)), F.lit(0)) if c in students.columns else F.lit(0)
    col = lambda c: F.col(c) if c in students.columns else F.lit(None).cast("string")
    target, hints = F.coalesce(F.trim(col("target_job")) != "", F.lit(False)), n("occupation_hints") > 0
    about = lambda word: F.coalesce(F.size(F.filter("practice", lambda t: F.contains(t, F.lit(word)))), F.lit(0))
    full = student.completeness(
        student.share([col(c) for c in ("name", "phone", "email", "school", "major", "degree", "graduation_year")]), student.share([col(c) for c in ("degree", "school", "major", "graduation_year")]),
        n("skills") + n("tools"), about("项目"), about("实习"), n("awards"), target, hints,
    )
    strong = student.competitiveness(col("degree"), col("major"), n("skills"), n("tools"), about("项目"), about("实习"), n("certificates"), n("awards"), target, hints, n("domain_tags"), F.col("practice"))
    return students.withColumns({"completeness": full, "competitiveness": strong}).withColumn("band", student.band(F.col("competitiveness")))


def recommendations(students: DataFrame, jobs: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best jobs of each student."""
    scored = match.scored(profiles(students), jobs, on=None)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("student_id").orderBy(F.desc("overall"), "job_name"))).filter(F.col("rank") <= k)


def goals(students: DataFrame, jobs: DataFrame) -> DataFrame:
    """The best other job against the named one, and which of them to plan for."""
    scored = match.scored(profiles(students), jobs, on=None).withColumns({"accuracy": F.col("skill") / 100, "passed": F.col("basic") >= 60})
    side = lambda df, p: df.select("student_id", *[F.col(c).alias(f"{p}_{c}") for c in ("job_name", "overall", "accuracy", "passed")])
    own = side(scored.filter(F.col("job_name") == F.col("target_job")), "target")
    others = scored.filter(~F.col("job_name").eqNullSafe(F.col("target_job")))
    best = side(others.withColumn("_n", F.row_number().over(Window.partitionBy("student_id").orderBy(F.desc("overall"), "job_name"))).filter("_n = 1"), "other")
    both = students.select("student_id").join(own, "student_id", "left").join(best, "student_id", "left")
    choice = path.goal_decision(*[F.col(f"{p}_{c}") for c in ("overall", "accuracy", "passed") for p in ("target", "other")])
    return both.withColumn("decision", choice).withColumn("goal_job", F.when(F.col("decision") == "switch", F.col("other_job_name")).otherwise(F.col("target_job_name")))


def reports(goals: DataFrame) -> DataFrame:
    lines = {"student": F.concat(F.lit("student "), F.col("student_id").cast("string")), "job": F.col("goal_job"), "match": F.format_string("%.2f", "target_overall"), "goal_and_path": F.col("decision")}
    done = report.markdown(goals, lines)
    return done.withColumn("missing_sections", report.missing_sections(F.col("report")))
