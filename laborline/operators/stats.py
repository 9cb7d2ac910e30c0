"""Distributions, gates and statistics per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Different values that one task ranks.
RANGE_ROWS = 100_000


def _ranked(counts: DataFrame, groups: list[str], top: int | None) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(F.desc("count"), F.asc("name"))
    out = counts.withColumn("rank", F.row_number().over(w))
    return out if top is None else out.filter(F.col("rank") <= top)


def distribution(df: DataFrame, groups: list[str], value: Column, top: int | None = None, unknown: str | None = None, nonblank_ratio: bool = False) -> DataFrame:
    """groups, rank, name, count, ratio (four digits, of the group's rows). Ties by name.

    Missing values count as ``unknown`` if given, else are left out; with ``nonblank_ratio`` they are left out of the
    ratio as well.
    """
    name = F.nullif(F.trim(value.cast("string")), F.lit(""))
    rows = df.select(*groups, (F.coalesce(name, F.lit(unknown)) if unknown else name).alias("name"))
    counts = rows.groupBy(*groups, "name").agg(F.count("*").alias("count"))
    if nonblank_ratio:
        counts = counts.filter(F.col("name").isNotNull())
    total = F.sum("count").over(Window.partitionBy(*groups))
    counts = counts.withColumn("_total", total).filter(F.col("name").isNotNull())
    return _ranked(counts, groups, top).select(*groups, "rank", "name", "count", F.round(F.col("count") / F.col("_total"), 4).alias("ratio"))


def multi_distribution(df: DataFrame, groups: list[str], values: Column, unknown: str, top: int | None = None) -> DataFrame:
    """As distribution, of the different values of each row's array; rows without any count as ``unknown``. Ratio: of rows."""
    once = F.filter(F.array_distinct(values), lambda x: x.isNotNull() & (x != ""))
    filled = F.when(F.coalesce(F.size(once), F.lit(0)) > 0, once).otherwise(F.array(F.lit(unknown)))
    rows = df.groupBy(*groups).agg(F.count("*").alias("_total"))
    counts = df.select(*groups, F.explode(filled).alias("name")).groupBy(*groups, "name").agg(F.count("*").alias("count"))
    joined = counts.join(rows, groups)
    return _ranked(joined, groups, top).select(*groups, "rank", "name", "count", F.round(F.col("count") / F.col("_total"), 4).alias("ratio"))


def nested(dist: DataFrame, groups: list[str], out: str) -> DataFrame:
    """One row a group, with the ranked entries as an array of structs."""
    entry = F.struct("rank", "name", "count", "ratio")
    return dist.groupBy(*groups).agg(F.array_sort(F.collect_list(entry)).alias(out))


def salary_stats(df: DataFrame, groups: list[str], low: Column, high: Column, digits: int = 2) -> DataFrame:
    """Means, medians and quartiles of the bounds and of their middle (or the one there is), and valid counts.

    Equal values are counted first, with partial counts before the shuffle, in a checkpoint that all else reads. They are ranked
    by running counts within as many ranges of values as keep a range at RANGE_ROWS different values.
    """
    bounds = df.select(*groups, low.cast("double").alias("min"), high.cast("double").alias("max"), F.coalesce((low + high) / 2, low, high).cast("double").alias("mid"))
    names = ("min", "max", "mid")
    long = bounds.select(*groups, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in names])).alias("x")).select(*groups, "x.k", "x.v")
    counted = checkpointed(long.filter("v is not null").groupBy(*groups, "k", "v").agg(F.count("*").alias("c")))
    placed = running_counts(counted, [*groups, "k"], "v", "c", -(-counted.count() // RANGE_ROWS))
    wide = []
    for k in names:
        mine = F.col("k") == k
        wide.append(F.round(F.sum(F.when(mine, F.col("v") * F.col("c"))) / F.sum(F.when(mine, F.col("c"))), digits).alias(f"{k}_mean"))
        for name, share in (("median", 0.5), ("p25", 0.25), ("p75", 0.75)):
            at = share * (F.col("total") - 1)
            held = lambda r: F.max(F.when(mine & (F.col("before") <= r) & (F.col("before") + F.col("c") > r), F.col("v")))  # noqa: B023, E731
            lower, upper = held(F.floor(at)), held(F.ceil(at))
            part = F.max(F.when(mine, at - F.floor(at)))
            wide.append(F.round(lower + (upper - lower) * part, digits).alias(f"{k}_{name}"))
    wide.append(F.coalesce(F.max("total"), F.lit(0)).alias("valid_count"))
    found = placed.groupBy(*groups).agg(*wide)
    return df.select(*groups).distinct().join(found, groups, "left").withColumn("valid_count", F.coalesce("valid_count", F.lit(0)))


def running_counts(counted: DataFrame, groups: list[str], value: str, count: str, ranges: int) -> DataFrame:
    """``counted`` with before (the group's rows of smaller values) and total.

    Values are dealt to ranges of the group by approximate quantiles; a range's rows are summed by a window, the ranges by a
    second one of ``ranges`` rows a group. With one range the group's values are few, and one window does.
    """
    if ranges <= 1:
        w = Window.partitionBy(*groups)
        so_far = w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return counted.withColumns({"before": F.coalesce(F.sum(count).over(so_far), F.lit(0)), "total": F.sum(count).over(w)})
    cuts = counted.groupBy(*groups).agg(F.percentile_approx(value, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(1_000)).alias("_cuts"), F.sum(count).alias("total"))
    dealt = counted.join(cuts, groups).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    inside = Window.partitionBy(*groups, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*groups, "_range").agg(F.sum(count).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(above), F.lit(0))).drop("_n")
    out = dealt.withColumn("_in", F.coalesce(F.sum(count).over(inside), F.lit(0))).join(sums, [*groups, "_range"])
    return out.withColumn("before", F.col("_base") + F.col("_in")).drop("_base", "_in", "_range")


def compact_salary(df: DataFrame, groups: list[str], low: Column, high: Column, order: list[Column], k: int = 5, digits: int = 2) -> DataFrame:
    """Mean bounds and middle of each group's first ``k`` rows; the middle of rows that have both bounds."""
    rows = first_k(df.withColumns({"_low": low.cast("double"), "_high": high.cast("double")}), groups, order, k)
    mid = (F.col("_low") + F.col("_high")) / 2
    return rows.groupBy(*groups).agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), digits).alias(n) for n, c in (("min_avg", F.col("_low")), ("max_avg", F.col("_high")), ("mid_avg", mid))], F.count("*").alias("samples"))


def top_names(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The commonest values that aren't blank, with their counts; ties by name."""
    return df.filter(F.trim(column) != "").groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column).limit(n)


def group_rows(df: DataFrame, name: str, column: str, fallback: str) -> DataFrame:
    """Rows whose cleaned ``column`` is ``name``; where there are none, those whose ``fallback`` is."""
    marked = df.withColumn("_own", F.coalesce(F.trim(column) == name, F.lit(False))).filter(F.col("_own") | (F.trim(fallback) == name))
    flag = marked.agg(F.coalesce(F.max("_own"), F.lit(False)).alias("_any"))  # one row
    return marked.join(F.broadcast(flag), F.col("_own") == F.col("_any")).drop("_own", "_any")


def longest(df: DataFrame, groups: list[str], body: str, order: list[Column], k: int = 5) -> DataFrame:
    """The ``k`` rows of each group with the longest text."""
    return first_k(df, groups, [F.desc(F.char_length(F.coalesce(body, F.lit("")))), *order], k)


def modes(df: DataFrame, groups: list[str], value: str, k: int = 1) -> DataFrame:
    """The ``k`` commonest values of each group; ties by value."""
    return distribution(df, groups, F.col(value), top=k).select(*groups, "rank", F.col("name").alias(value), "count")


def ordered_gate(dist: DataFrame, groups: list[str], rank_of: Column) -> DataFrame:
    """The commonest known level of each group; a tie goes to the higher level."""
    known = dist.withColumn("_rank", rank_of).filter(F.col("_rank") >= 0)
    best = known.groupBy(*groups).agg(F.max_by("name", F.struct("count", "_rank")).alias("gate"), F.max(F.struct("count", "_rank"))["_rank"].alias("gate_rank"))
    return best


def gate_set(dist: DataFrame, groups: list[str], least: float = 0.1, most: int = 5, fallback: int = 3) -> DataFrame:
    """Names with a ratio of at least ``least`` (``most`` of them); where there are none, the first ``fallback``."""
    has = F.max(F.when(F.col("ratio") >= least, 1).otherwise(0)).over(Window.partitionBy(*groups))
    marked = dist.withColumn("_has", has)
    keep = F.when(F.col("_has") == 1, (F.col("ratio") >= least) & (F.col("rank") <= most)).otherwise(F.col("rank") <= fallback)
    return marked.filter(keep).drop("_has")


def must_or_preferred(df: DataFrame, groups: list[str], name: str, is_must: Column, rows: DataFrame, must_ratio: float = 0.35, must_share: float = 0.5, preferred_ratio: float = 0.05) -> DataFrame:
    """Each name's share of rows and of must among its mentions, and its class: must, preferred or rare.

    rows: groups and _total, the group's rows.
    """
    seen = df.groupBy(*groups, name).agg(F.count("*").alias("mentions"), F.count_if(is_must).alias("musts")).join(rows, groups)
    ratio, share = F.col("mentions") / F.col("_total"), F.col("musts") / F.col("mentions")
    kind = F.when((ratio >= must_ratio) & (share >= must_share), "must").when(ratio >= preferred_ratio, "preferred").otherwise("rare")
    return seen.select(*groups, name, "mentions", F.round(ratio, 4).alias("ratio"), F.round(share, 4).alias("must_share"), kind.alias("class"))


def weighted_presence(df: DataFrame, groups: list[str], parts: list[tuple[Column, float]], out: str = "completeness") -> DataFrame:
    """Mean over the group's rows of the weights of what is present."""
    total = F.lit(0.0)
    for present, weight in parts:
        total = total + F.avg(F.when(present, weight).otherwise(0.0))
    return df.groupBy(*groups).agg(F.count("*").alias("rows"), F.round(total, 4).alias(out))


def capped_selection(df: DataFrame, category: str, order: list[Column], cap: int, n: int) -> DataFrame:
    """``n`` rows by ``order``, at most ``cap`` of a category; if that leaves room, the others in order. Adds display_order.

    ``order`` must be total. Only rows that rank within ``n`` of their category are compared globally.
    """
    within = df.withColumn("_in", F.row_number().over(Window.partitionBy(category).orderBy(*order))).filter(F.col("_in") <= max(n, cap))
    first = within.withColumn("_late", (F.col("_in") > cap).cast("int")).orderBy("_late", *order).limit(n)
    return first.withColumn("display_order", F.row_number().over(Window.orderBy("_late", *order))).drop("_in", "_late")


def first_k(df: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col("position") <= k)


def ordered_distinct(df: DataFrame, groups: list[str], value: str, order: Column, out: str, most: int) -> DataFrame:
    """The first ``most`` different values of each group in the order of their first appearance."""
    firsts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.min(order).alias("_first"))
    ranked = firsts.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy("_first", value))).filter(F.col("_n") <= most)
    return ranked.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(value).alias("v")))), lambda x: x["v"]).alias(out))
