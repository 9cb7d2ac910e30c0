"""Text normalization as Spark columns. Missing text is NULL inside the engine; exporters write it back as blank."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab

#: White space of any script; Java's plain \s is ASCII only.
WS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]
BRACKETS = r"[()（）【】\[\]]"
SENTENCE_END = r"[。！？!?；;\n]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unescape(c: Column) -> Column:
    """The common entities; ampersands last, so that nothing is unescaped twice."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


def fold_null(c: Column, words: tuple[str, ...] = vocab.NULL_WORDS) -> Column:
    """NULL for the words, whatever their case. The text is named once, so that what it is made of is computed once."""
    return F.regexp_substr(c, F.lit(rf"(?is)^(?!(?:{'|'.join(re.escape(w) for w in words)})\z).*"))


def clean_text(c: Column, null_words: tuple[str, ...] = vocab.NULL_WORDS, keep_lines: bool = False, entities: bool = True) -> Column:
    """Unescaped, white space collapsed and trimmed, NULL for the words that mean missing."""
    text = unescape(c.cast("string")) if entities else c.cast("string")
    if keep_lines:
        text = F.regexp_replace(F.regexp_replace(text, r"[^\S\n]+", " "), r" ?\n[ \n]*", "\n")
        return fold_null(F.regexp_replace(text, rf"^{WS}+|{WS}+$", ""), null_words)
    return fold_null(F.trim(F.regexp_replace(text, WS + "+", " ")), null_words)


def strip_html(c: Column) -> Column:
    """Line ends for breaks, paragraphs and items; a space for any other tag."""
    text = F.regexp_replace(clean_text(c), r"(?i)<br\s*/?>|</p>|</li>", "\n")
    text = unescape(F.regexp_replace(text, r"<[^>]+>", " "))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\x{3000}]+", " "), r"\n+", "\n")
    return F.nullif(F.regexp_replace(text, r"^[ \n]+|[ \n]+$", ""), F.lit(""))


def compact(c: Column, drop: str = r"[()（）\[\]【】<>《》\-_/\\|·,，;；:：+.#\s]") -> Column:
    """Lower case without punctuation and spaces, for loose comparison."""
    return F.regexp_replace(F.lower(c), drop, "")


def tag_token(c: Column) -> Column:
    return compact(F.regexp_replace(F.lower(clean_text(c)), r"^(证书|学历|学校|专业|项目|实习|技能|工具)[:：]", ""))


def first_rule(text: Column, rules: list[tuple[str, str]], otherwise: Column) -> Column:
    """The value of the first rule whose substring is there."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in rules], otherwise)


def matches(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The values of all pattern rules that match, in the rules' order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.rlike(text, F.lit(p)), F.lit(v)) for p, v in rules])))


def company_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(clean_text(c), BRACKETS, ""), WS + "+", "")


def expand_suffixes(text: Column, rules: list[tuple[str, str]] = vocab.TITLE_SUFFIXES) -> Column:
    """Short titles to full ones, unless the full one is already there."""
    pairs = F.array(*[F.struct(F.lit(short).alias("short"), F.lit(full).alias("full")) for short, full in rules])
    return F.aggregate(pairs, text, lambda x, r: F.when(F.contains(x, r["short"]) & ~F.contains(x, r["full"]), F.replace(x, r["short"], r["full"])).otherwise(x))


def job_title(c: Column) -> Column:
    text = F.regexp_replace(F.lower(clean_text(c)), BRACKETS, "")
    text = F.regexp_replace(text, "(" + "|".join(vocab.PROMO_WORDS) + ")", "")
    return F.nullif(expand_suffixes(F.regexp_replace(text, r"[\s_/|｜]+", "")), F.lit(""))


def job_family(title: Column) -> Column:
    return first_rule(F.lower(clean_text(title)), vocab.JOB_FAMILIES, F.lit("其他"))


def company_type(c: Column) -> Column:
    text = clean_text(c)
    return F.when(text.isNotNull(), first_rule(text, vocab.COMPANY_TYPES, text))


def address(c: Column) -> Column:
    """struct(full, city, district): at most three levels."""
    text = F.regexp_replace(F.regexp_replace(clean_text(c), r"[，,/｜|]+", "-"), r"\s*-\s*", "-")
    parts = F.filter(F.transform(F.split(text, "-+"), lambda x: clean_text(x)), lambda x: x.isNotNull())
    return F.struct(F.nullif(F.array_join(F.slice(parts, 1, 3), "-"), F.lit("")).alias("full"), F.get(parts, F.lit(0)).alias("city"), F.get(parts, F.lit(1)).alias("district"))


def sentences(c: Column, least: int = 2, most: int = 240) -> Column:
    cut = F.transform(F.split(c, SENTENCE_END), lambda s: F.trim(s))
    return F.filter(cut, lambda s: (F.char_length(s) >= least) & (F.char_length(s) <= most))


def evidence(c: Column, keywords: list[str], most: int = 220) -> Column:
    """The first sentence with any of the keywords."""
    hit = lambda s: reduce(lambda a, b: a | b, [F.contains(F.lower(s), F.lit(k.lower())) for k in keywords])
    return F.left(F.get(F.filter(sentences(c), hit), F.lit(0)), F.lit(most))


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def weighted_hits(text: Column, weights: dict[str, float]) -> Column:
    """array<struct(word, weight)> of the keywords that the text contains, over one literal: the text is named once."""
    known = F.array(*[F.struct(F.lit(k).alias("word"), F.lit(float(w)).alias("weight")) for k, w in weights.items()])
    return F.filter(known, lambda k: F.contains(text, k["word"]))


def total_weight(hits: Column) -> Column:
    return F.round(F.aggregate(hits, F.lit(0.0), lambda total, k: total + k["weight"]), 4)


def keyword_score(text: Column, weights: dict[str, float]) -> Column:
    return F.round(reduce(lambda a, b: a + b, [F.when(F.contains(text, F.lit(k)), F.lit(w)).otherwise(F.lit(0.0)) for k, w in weights.items()]), 4)


def keywords_found(text: Column, words: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words]))


def alias_normalized(c: Column, aliases: dict[str, list[str]]) -> Column:
    """The first entry that equals, contains or is contained in the token (two letters at least); else the text itself."""

    def named(x: Column) -> Column:
        token, tests = x["token"], []
        for name, words in aliases.items():
            forms = list(dict.fromkeys(w for w in (_plain(y) for y in (name, *words)) if w))
            test = token.isin(*forms)
            for w in (w for w in forms if len(w) >= 2):
                test = test | F.contains(token, F.lit(w)) | ((F.char_length(token) >= 2) & F.contains(F.lit(w), token))
            tests.append(F.when(test, F.lit(name)))
        return F.when(token != "", F.coalesce(*tests, x["plain"]))

    return let(let(clean_text(c), lambda t: F.struct(compact(t).alias("token"), t.alias("plain"))), named)


def _plain(text: str) -> str:
    return re.sub(r"[()（）\[\]【】<>《》\-_/\\|·,，;；:：+.#\s]", "", text.lower())


def list_like(c: Column, ordered: bool = True) -> Column:
    """A JSON array of strings or a delimited list, each item once; in order, or sorted."""
    parsed = F.when(F.rlike(F.trim(c), F.lit(r"^\[")), F.from_json(c, "array<string>"))
    items = F.coalesce(parsed, F.split(c, r"[、,，;；/|]"))
    cleaned = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    once = F.coalesce(F.array_distinct(cleaned), F.array().cast("array<string>"))
    return once if ordered else F.array_sort(once)


def tolerant_json(c: Column, schema: str) -> Column:
    """Plain JSON, else the contents of a code fence, else the outermost braces."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    # Text that is no JSON would give a struct of NULLs, which coalesce keeps.
    return F.coalesce(*[F.when(F.get_json_object(x, "$").isNotNull(), F.from_json(x, schema)) for x in (c, fenced, braces)])


def aliased_columns(df: DataFrame, more: dict[str, Column] | None = None, aliases: dict[str, list[str]] = vocab.COLUMN_ALIASES) -> DataFrame:
    """The canonical columns: of each, the first header that is there, else NULL; with ``more`` columns of ``df`` beside them."""
    have = {c.strip().lstrip("﻿"): c for c in df.columns}
    first = {name: next((have[a] for a in names if a in have), None) for name, names in aliases.items()}
    return df.select(*[(F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")).alias(n) for n, c in first.items()], *[c.alias(n) for n, c in (more or {}).items()])


def with_raw(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_raw": F.col(c) for c in columns})


def key_of(*parts: Column, sep: str = "||") -> Column:
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def stable_id(text: Column, length: int = 24, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(text), 1, length))


def banded(score: Column, bands: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first bound that the score reaches."""
    out = None
    for bound, label in bands:
        out = F.when(score >= bound, F.lit(label)) if out is None else out.when(score >= bound, F.lit(label))
    return out.otherwise(F.lit(otherwise))
