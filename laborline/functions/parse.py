"""Salaries, sizes, dates and requirements out of text, as one struct each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import _plain, any_of, clean_text, compact, let, list_like, matches, sentences

NUMBER = r"(\d+(?:\.\d+)?)"


def _group(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def salary(c: Column, strict: bool = False) -> Column:
    """struct(low, high, unit, months, month_low, month_high, negotiable).

    A range, else one amount with a unit, else the first two numbers. With ``strict``, K counts as thousands and each
    bound keeps its own unit.
    """
    text = clean_text(c)
    if strict:
        text = F.regexp_replace(text, r"(?i)(\d)\s*k\b", "$1千")
    core = F.regexp_replace(text, r"[·•]?\s*\d{1,2}\s*薪", "")
    return let(F.struct(text.alias("text"), core.alias("core")), lambda t: _salary(t["text"], t["core"], strict))


def _salary(text: Column, core: Column, strict: bool) -> Column:
    negotiable = F.coalesce(F.contains(text, F.lit("面议")), F.lit(False))
    months = F.coalesce(F.try_to_number(_group(text, r"(\d{1,2})\s*薪", 1), F.lit("99")).cast("int"), F.lit(12))
    unit = (
        F.when(text.isNull(), "unknown").when(negotiable, "negotiable").when(F.rlike(core, F.lit(r"元\s*/\s*(天|日)")), "day")
        .when(F.rlike(core, F.lit(r"元\s*/\s*(小时|时)")), "hour").when(F.rlike(core, F.lit(r"(年薪|/年|元/年|万/年)")), "year").otherwise("month")
    )
    between = NUMBER + (r"\s*(万|千|元)?" if strict else "") + r"\s*[-~至]\s*" + NUMBER + r"\s*(万|千|元)?"
    single = NUMBER + r"\s*(万|千|元)"
    is_range, is_single = F.rlike(core, F.lit(between)), F.rlike(core, F.lit(single))
    numbers = F.regexp_extract_all(core, F.lit(NUMBER), F.lit(1))
    last = 4 if strict else 3
    low = F.when(is_range, _group(core, between, 1)).when(is_single, _group(core, single, 1)).otherwise(F.get(numbers, F.lit(0)))
    high = F.when(is_range, _group(core, between, last - 1)).when(is_single, _group(core, single, 1)).otherwise(F.coalesce(F.get(numbers, F.lit(1)), F.get(numbers, F.lit(0))))
    loose = F.when(F.contains(core, F.lit("万")), "万").when(F.contains(core, F.lit("千")), "千")
    token = F.when(is_range, _group(core, between, last)).when(is_single, _group(core, single, 2)).otherwise(loose)
    low_token = F.when(is_range, F.coalesce(_group(core, between, 2), token)).otherwise(token) if strict else token
    times = lambda t: F.when(t == "万", 10000.0).when(t == "千", 1000.0).otherwise(1.0)
    priced = text.isNotNull() & ~negotiable
    a = F.when(priced, low.try_cast("double") * times(low_token))
    b = F.when(priced, high.try_cast("double") * times(token))
    found = F.struct(a.alias("a"), b.alias("b"), unit.alias("unit"), F.when(priced, months).otherwise(12).alias("months"), negotiable.alias("negotiable"))
    return let(found, _monthly)


def _monthly(found: Column) -> Column:
    unit = found["unit"]
    per_month = lambda x: F.round(F.when(unit == "day", x * 21.75).when(unit == "hour", x * 8 * 21.75).when(unit == "year", x / 12).otherwise(x), 2)
    a, b = found["a"], found["b"]
    return F.struct(
        F.round(a, 2).alias("low"), F.round(b, 2).alias("high"), unit.alias("unit"), found["months"].alias("months"),
        per_month(a).alias("month_low"), per_month(b).alias("month_high"), found["negotiable"].alias("negotiable"),
    )


def company_size(c: Column) -> Column:
    """struct(label, low, high) from a range, 以上, 少于 or 以下; other text stays as the label."""
    return let(clean_text(c), _company_size)


def _company_size(text: Column) -> Column:
    between, above, fewer, below = r"(\d+)\s*[-~至]\s*(\d+)\s*人", r"(\d+)\s*人以上", r"少于\s*(\d+)\s*人", r"(\d+)\s*人以下"
    n = lambda p, k=1: _group(text, p, k).try_cast("int")
    is_between, is_above, is_fewer, is_below = (F.coalesce(F.rlike(text, F.lit(p)), F.lit(False)) for p in (between, above, fewer, below))
    label = (
        F.when(is_between, F.concat(n(between).cast("string"), F.lit("-"), n(between, 2).cast("string"), F.lit("人")))
        .when(is_above, F.concat(n(above).cast("string"), F.lit("人以上"))).when(is_fewer, F.concat(F.lit("少于"), n(fewer).cast("string"), F.lit("人")))
        .when(is_below, F.concat(n(below).cast("string"), F.lit("人以下"))).otherwise(text)
    )
    low = F.when(is_between, n(between)).when(is_above, n(above))
    high = F.when(is_between, n(between, 2)).when(~is_above & is_fewer, n(fewer)).when(~is_above & is_below, n(below))
    return F.struct(label.alias("label"), low.alias("low"), high.alias("high"))


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date with the day clamped to the month, NULL for months that don't exist."""
    ok = month.between(1, 12)
    first = F.when(ok, F.make_date(year, month, F.lit(1)))
    return F.date_add(first, F.least(F.greatest(day, F.lit(1)), F.day(F.last_day(first))) - 1)


def posted_date(c: Column, today: str) -> Column:
    """A date from four notations. Without a year it is this year's, unless over 30 days ahead of ``today``: last year's."""
    return let(clean_text(c), lambda t: _posted_date(t, today))


def _posted_date(text: Column, today: str) -> Column:
    now = F.to_date(F.lit(today))
    n = lambda p, k: _group(text, p, k).try_cast("int")
    full, short, iso = r"(\d{4})年(\d{1,2})月(\d{1,2})日", r"(\d{1,2})月(\d{1,2})日", r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$"
    this_year = _day(F.year(now), n(short, 1), n(short, 2))
    dated = F.when(this_year > F.date_add(now, 30), _day(F.year(now) - 1, n(short, 1), n(short, 2))).otherwise(this_year)
    strict = F.try_to_timestamp(F.regexp_replace(text, "/", "-"), F.lit("yyyy-M-d")).cast("date")
    return F.when(F.rlike(text, F.lit(iso)), strict).when(F.rlike(text, F.lit(full)), _day(n(full, 1), n(full, 2), n(full, 3))).when(F.rlike(text, F.lit(short)), dated).otherwise(F.try_to_timestamp(text).cast("date"))


def degree_requirement(text: Column, profile: Column | None = None) -> Column:
    """struct(degree, rank, method): the lowest of the degrees named; "no limit" holds only if it stands alone."""
    hits = matches(text, vocab.DEGREE_PATTERNS)
    real = F.filter(hits, lambda x: x != vocab.NO_LIMIT)
    pairs = lambda a: F.array_min(F.transform(a, lambda x: F.struct(degree_rank(x).alias("rank"), x.alias("degree"))))
    named = pairs(F.when(F.size(real) > 0, real).otherwise(hits))
    other = pairs(matches(profile, vocab.DEGREE_PATTERNS)) if profile is not None else F.lit(None).cast("struct<rank:int,degree:string>")
    found = F.coalesce(named, other)
    method = F.when(named.isNotNull(), "text").when(other.isNotNull(), "profile").otherwise("none")
    return F.struct(F.coalesce(found["degree"], F.lit(vocab.UNKNOWN)).alias("degree"), F.coalesce(found["rank"], F.lit(-1)).alias("rank"), method.alias("method"))


def degree_rank(label: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(r) for r in vocab.DEGREE_RANK.values()]), F.array_position(F.array(*[F.lit(k) for k in vocab.DEGREE_RANK]), label).cast("int") - 1), F.lit(-1))


def majors(text: Column) -> Column:
    """Known majors that the text names by any alias."""
    return F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in words]), F.lit(name)) for name, words in vocab.MAJOR_ALIASES.items()]))


def certificates(text: Column) -> Column:
    """array<struct(name, force)>: certificates that the text names by any alias; the force by the words of the first sentence
    that names it: preferred before must before mentioned, unknown if no sentence does."""
    low = F.lower(text)

    def force(sentence: Column) -> Column:
        return F.when(sentence.isNull(), "unknown").when(any_of(sentence, vocab.CERT_PREFERRED), "preferred").when(any_of(sentence, vocab.CERT_MUST), "must").otherwise("mentioned")

    def names_any(keys: list[str]):
        return lambda s: any_of(s["token"], keys)

    def found(said: Column) -> Column:
        out = []
        for name, words in vocab.CERTIFICATE_ALIASES.items():
            forms = list(dict.fromkeys([name, *words]))
            keys = list(dict.fromkeys(_plain(w) for w in forms if _plain(w)))
            first = F.get(F.filter(said, names_any(keys)), F.lit(0))["sentence"]
            out.append(F.when(any_of(low, [w.lower() for w in forms]), F.struct(F.lit(name).alias("name"), let(first, force).alias("force"))))
        return F.array_compact(F.array(*out))

    return let(F.transform(sentences(text), lambda s: F.struct(F.left(s, F.lit(220)).alias("sentence"), compact(s).alias("token"))), found)


def extraction_confidence(degree: Column, major: Column, certificate: Column) -> Column:
    """Mean of three parts, each 1 for text, .65 for a profile, and .25 (certificates .6) for neither."""
    part = lambda m, low: F.when(m == "text", 1.0).when(m == "profile", 0.65).otherwise(low)
    return F.round((part(degree, 0.25) + part(major, 0.25) + part(certificate, 0.6)) / 3, 4)


def experience(text: Column) -> Column:
    return matches(text, vocab.EXPERIENCE_PATTERNS)


def practice(text: Column) -> Column:
    return matches(text, vocab.PRACTICE_PATTERNS)


def soft_skills(text: Column) -> Column:
    return matches(text, vocab.SOFT_SKILL_PATTERNS)


def skills(text: Column, aliases: dict[str, list[str]] = vocab.SKILL_ALIASES) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), F.lit(name)) for name, words in aliases.items()]))


def level_rank(text: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in vocab.LEVEL_RANK.items()], F.lit(0))


def title_tokens(title: Column) -> Column:
    """Latin words, domain keywords and runs of Chinese characters, without stop words, sorted."""
    text = F.lower(clean_text(title))
    latin = F.regexp_extract_all(text, F.lit(r"([a-z][a-z0-9.+#-]*)"), F.lit(1))
    chinese = F.regexp_extract_all(text, F.lit(r"([\x{4e00}-\x{9fa5}]{2,})"), F.lit(1))
    known = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(k)), F.lit(k)) for k in vocab.DOMAIN_KEYWORDS]))
    stop = F.array(*[F.lit(s) for s in vocab.STOP_TOKENS])
    return F.coalesce(F.array_sort(F.array_except(F.array_union(F.array_union(latin, known), chinese), stop)), F.array().cast("array<string>"))


def primary_tokens(tokens: Column, most: int = 3) -> Column:
    """The longest, ties by name."""
    keyed = F.array_sort(F.transform(tokens, lambda t: F.struct((-F.char_length(t)).alias("n"), t.alias("t"))))
    return F.transform(F.slice(keyed, 1, most), lambda x: x["t"])


def embedding_tokens(text: Column) -> Column:
    """Latin words of two letters or more; runs of Chinese characters with their bigrams and trigrams."""
    clean = F.coalesce(clean_text(text), F.lit(""))
    latin = F.transform(F.regexp_extract_all(clean, F.lit(r"([A-Za-z0-9_]{2,})"), F.lit(1)), lambda x: F.lower(x))
    runs = F.regexp_extract_all(clean, F.lit(r"([\x{4e00}-\x{9fff}]{2,})"), F.lit(1))
    grams = lambda run, n: F.when(F.char_length(run) >= n, F.transform(F.sequence(F.lit(1), F.char_length(run) - n + 1), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(latin, F.flatten(F.transform(runs, lambda r: F.concat(F.array(r), grams(r, 2), grams(r, 3)))))


def path_nodes(text: Column) -> Column:
    """The steps of a path written with arrows."""
    return F.filter(F.transform(F.split(text, r"\s*(?:->|→|=>|➡|>)\s*"), lambda x: F.trim(x)), lambda x: x != "")


def path_targets(source: Column, text: Column, chained: bool = True) -> Column:
    """Direct targets of ``source``: every later step, sorted; or only the last one."""
    nodes = F.filter(path_nodes(text), lambda x: x != source)
    return F.array_sort(F.array_distinct(nodes)) if chained else F.slice(nodes, -1, 1)


def is_job_name(c: Column) -> Column:
    """Whether a cleaned name is more than a key: not job_..., not twelve hexadecimal digits or more, and with a letter."""
    t = F.coalesce(clean_text(c), F.lit(""))
    return (t != "") & ~F.startswith(t, F.lit("job_")) & ~F.rlike(t, F.lit("^[0-9a-fA-F]{12,}$")) & F.rlike(t, F.lit(r"[\x{4e00}-\x{9fff}A-Za-z]"))


def domain_tags(name: Column, *tags: Column) -> Column:
    """Domains of which a word is in the name or one of the tag arrays, in the domains' order."""
    merged = F.lower(F.concat_ws(" ", name, *[F.array_join(t, " ") for t in tags]))
    return let(merged, lambda m: F.array_compact(F.array(*[F.when(any_of(m, [w.lower() for w in words]), F.lit(d)) for d, words in vocab.DOMAINS.items()])))


def major_list(c: Column) -> Column:
    """Majors out of free text, sorted: a JSON array, else parts between delimiters without the words of relation and preference."""
    listed = list_like(c, ordered=False)
    plain = c
    for pattern, into in ((r"(等)?相关类专业", ""), (r"(等)?相关专业", ""), (r"(专业优先|优先考虑|优先)", ""), ("[与和]", "、")):
        plain = F.regexp_replace(plain, pattern, into)
    parts = F.transform(F.split(plain, r"[、,，;/；|]+"), lambda x: F.trim(x))
    rest = F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))
    empty = F.array().cast("array<string>")
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", empty).when(F.contains(c, F.lit("专业不限")), F.array(F.lit("专业不限"))).when(F.size(listed) > 1, listed).otherwise(rest)


RELATIONS = "array<struct<source_job:string,target_job:string,to_job:string,relation_type:string,path_type:string,type:string,reason:string,confidence:string>>"


def relation_details(c: Column, source: Column) -> Column:
    """array<struct(source_job, target_job, relation_type, reason, confidence)> from a JSON array of relations under any of their
    names: promotions and transfers between two different jobs, each once."""
    clean = lambda *cs: F.coalesce(*[clean_text(x) for x in cs])
    row = lambda r: F.struct(
        clean(r["source_job"], source).alias("source_job"), clean(r["target_job"], r["to_job"]).alias("target_job"), F.upper(clean(r["relation_type"], r["path_type"], r["type"])).alias("relation_type"),
        clean(r["reason"]).alias("reason"), clean(r["confidence"]).alias("confidence"),
    )
    good = lambda r: r["relation_type"].isin("PROMOTE_TO", "TRANSFER_TO") & (r["source_job"] != r["target_job"])
    same = lambda a, b: (a["source_job"] == b["source_job"]) & (a["target_job"] == b["target_job"]) & (a["relation_type"] == b["relation_type"])
    once = lambda rows: F.filter(rows, lambda r, i: ~F.exists(F.slice(rows, F.lit(1), i), lambda b: same(r, b)))
    return let(F.filter(F.transform(F.coalesce(F.from_json(c, RELATIONS), F.array().cast(RELATIONS)), row), good), once)


def resume_skills(section: Column, whole: Column) -> Column:
    """Skills that the section of skills names; if it names none, those of the whole text."""
    found = lambda t: matches(F.lower(F.coalesce(t, F.lit(""))), vocab.RESUME_SKILLS_BY_PATTERN)
    return let(found(section), lambda own: F.when(F.size(own) > 0, own).otherwise(found(whole)))


def resume_certificates(text: Column) -> Column:
    return matches(F.lower(text), vocab.RESUME_CERTIFICATES_BY_PATTERN)


def resume_awards(text: Column) -> Column:
    """The pieces between sentence ends that speak of an award, each once."""
    parts = F.transform(F.split(text, r"[。；;\n]"), lambda x: F.regexp_replace(x, "^[ ，,]+|[ ，,]+$", ""))
    return F.array_distinct(F.filter(parts, lambda x: any_of(x, vocab.RESUME_AWARDS)))
