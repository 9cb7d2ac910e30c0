"""Cleaning of postings: canonical columns, parsed fields, anomaly flags, layered de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse, text, vocab
from ..session import checkpointed

#: Parts in which an audit ranks the rows of a key.
SALTS = 64
COMPLETENESS_COLUMNS = ["job_title", "company_name", "job_address", "salary_range", "industry", "company_size", "company_type", "job_description", "company_description", "updated_at"]


def completeness(columns: list[Column]) -> Column:
    """How many of the columns are neither NULL nor blank."""
    filled = [F.when(F.trim(c.cast("string")) != "", 1).otherwise(0) for c in columns]
    total = F.lit(0)
    for f in filled:
        total = total + f
    return total.cast("int")


def anomalies(flags: list[tuple[str, Column]]) -> Column:
    """The names of the flags that hold, joined by commas."""
    return F.concat_ws(",", *[F.when(cond, F.lit(name)) for name, cond in flags])


def layered_dedup(df: DataFrame, keys: list[tuple[str, Column]], order: list[Column], audit: bool = False) -> DataFrame:
    """Of rows with the same key the best by ``order`` stays; each rule sees what the ones before kept. Rows without a key stay.

    ``order`` must be total. With ``audit`` all rows come back, with duplicate_rule: the rule that dropped a row, or NULL; the
    rows of a key are then ranked in SALTS parts first, so that a key with a third of all rows is no task's own.
    """
    kept, dropped = df, None
    for name, key in keys:
        if audit:
            kept = checkpointed(kept)  # read by two branches
        ranked = kept.withColumn("_key", F.nullif(key, F.lit("")))
        # Rows without a key get one of their own for the window, so that they don't meet in one task.
        alone = F.when(F.col("_key").isNull(), F.monotonically_increasing_id())
        ranked = ranked.withColumn("_alone", alone)
        steps = [["_key", "_alone", "_salt"], ["_key", "_alone"]] if audit else [["_key", "_alone"]]
        if audit:
            ranked = ranked.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        for parts in steps:
            ranked = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(*parts).orderBy(*order)))
            if audit:
                lost = ranked.filter("_n > 1").drop("_key", "_n", "_alone", "_salt").withColumn("duplicate_rule", F.lit(name))
                dropped = lost if dropped is None else dropped.unionByName(lost)
            ranked = ranked.filter("_n = 1").drop("_n")
        kept = ranked.drop("_key", "_alone", "_salt")
    if not audit:
        return kept
    return kept.withColumn("duplicate_rule", F.lit(None).cast("string")).unionByName(dropped)


def clean_postings(raw: DataFrame, today: str, ordinal: str | None = None) -> DataFrame:
    """Wide clean table: raw shadows, normalized columns, parsed salary, size and date, ids, completeness, anomalies.

    source_row_no is the column ``ordinal`` of ``raw``, the place of a row in its source; NULL where there is none.
    """
    place = F.lit(None) if ordinal is None else F.col(f"`{ordinal}`")
    df = text.aliased_columns(raw, {"source_row_no": place.cast("long")})
    names = list(vocab.COLUMN_ALIASES)
    df = text.with_raw(df, names)
    df = df.withColumns({c: text.clean_text(F.col(c)) for c in names if c not in ("job_description", "company_description")})
    df = df.withColumns({"job_description": text.strip_html(F.col("job_description")), "company_description": text.strip_html(F.col("company_description"))})
    df = df.withColumns(
        {
            "company_name_norm": text.company_name(F.col("company_name")), "job_title_norm": text.job_title(F.col("job_title")), "_address": text.address(F.col("job_address")),
            "_salary": parse.salary(F.col("salary_range")), "_size": parse.company_size(F.col("company_size")), "company_type_norm": text.company_type(F.col("company_type")),
            "updated_at_std": parse.posted_date(F.col("updated_at"), today),
        }
    )
    df = df.withColumns(
        {
            "job_address_norm": F.col("_address.full"), "city": F.col("_address.city"), "district": F.col("_address.district"),
            "salary_min": F.col("_salary.low"), "salary_max": F.col("_salary.high"), "salary_unit": F.col("_salary.unit"), "salary_months": F.col("_salary.months"),
            "salary_month_min": F.col("_salary.month_low"), "salary_month_max": F.col("_salary.month_high"), "is_salary_negotiable": F.col("_salary.negotiable"),
            "company_size_norm": F.col("_size.label"), "company_size_min": F.col("_size.low"), "company_size_max": F.col("_size.high"),
            "completeness_score": completeness([F.col(c) for c in COMPLETENESS_COLUMNS]),
        }
    ).drop("_address", "_salary", "_size")
    core = text.key_of(F.col("company_name_norm"), F.col("job_title_norm"), F.col("job_address_norm"))
    return df.withColumns(
        {
            "duplicate_core_key": F.when(F.replace(core, F.lit("|"), F.lit("")) != "", core),
            "record_id": text.stable_id(text.key_of(*[F.col(c) for c in ("job_code", "job_url", "company_name", "job_title", "job_address")])),
            "abnormal_reasons": anomalies(posting_flags()),
        }
    ).withColumn("is_abnormal", F.col("abnormal_reasons") != "")


def posting_flags() -> list[tuple[str, Column]]:
    return [
        ("missing_job_title", F.col("job_title").isNull()),
        ("missing_company_name", F.col("company_name").isNull()),
        ("missing_job_description", F.col("job_description").isNull()),
        ("salary_min_gt_salary_max", F.col("salary_month_min") > F.col("salary_month_max")),
        ("invalid_job_url", ~F.rlike(F.col("job_url"), F.lit("^https?://"))),
        ("job_description_too_short", F.coalesce(F.char_length("job_description"), F.lit(0)) < 10),
    ]


def drop_duplicates(clean: DataFrame, audit: bool = False) -> DataFrame:
    """By code, then address of the posting, then company, title and place; fuller and later postings stay.

    Ties end with the place in the source and a hash of all raw columns, so the order is total but for equal rows.
    """
    whole = F.xxhash64(*[F.col(f"{c}_raw") for c in vocab.COLUMN_ALIASES])
    order = [F.desc("completeness_score"), F.desc_nulls_last("updated_at_std"), F.asc_nulls_last("source_row_no"), F.asc("record_id"), whole]
    keys = [("job_code", F.col("job_code")), ("job_url", F.col("job_url")), ("core_key", F.col("duplicate_core_key"))]
    return layered_dedup(clean, keys, order, audit)
