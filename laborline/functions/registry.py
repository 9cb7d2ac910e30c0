"""Dictionaries of standard names by domain and module, with each module's separators of lists: one place to look them up.

Modules differ in what they know and in how they cut lists, so the same text can have other standard names in another one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import clean_text, let

#: Standard names of the job profile's module with their aliases. Fixed values.
PROFILE_MAJORS: dict[str, list[str]] = {
    "计算机科学与技术": ["计算机科学与技术", "计算机科学", "计算机技术", "计算机", "软件工程", "网络工程"],
    "数据科学与大数据技术": ["数据科学与大数据技术", "数据科学", "大数据", "数据技术", "人工智能与大数据"],
    "人工智能": ["人工智能", "机器学习", "智能科学与技术", "模式识别"],
    "统计学": ["统计学", "应用统计", "数理统计", "经济统计"],
    "数学": ["数学", "应用数学", "数学与应用数学", "计算数学"],
    "电子信息工程": ["电子信息", "电子信息工程", "通信工程", "自动化"],
    "信息管理与信息系统": ["信息管理与信息系统", "信息管理", "信息系统", "信管"],
    "金融学": ["金融学", "金融工程", "金融科技"],
    "市场营销": ["市场营销", "电子商务", "工商管理"],
}
PROFILE_SKILLS: dict[str, list[str]] = {
    "Python": ["python", "python3", "py"],
    "Java": ["java", "spring", "springboot", "jvm"],
    "C++": ["c++", "cpp", "stl"],
    "SQL": ["sql", "mysql", "postgresql", "hive sql", "oracle"],
    "数据分析": ["数据分析", "数据处理", "数据清洗", "业务分析", "分析建模"],
    "数据挖掘": ["数据挖掘", "特征工程", "特征分析"],
    "机器学习": ["机器学习", "machine learning", "ml", "sklearn", "xgboost", "lightgbm"],
    "深度学习": ["深度学习", "deep learning", "pytorch", "tensorflow", "神经网络"],
    "NLP": ["nlp", "自然语言处理", "文本挖掘", "llm", "大语言模型"],
    "数据可视化": ["数据可视化", "可视化", "图表分析", "dashboard"],
    "爬虫": ["爬虫", "scrapy", "requests", "beautifulsoup", "selenium"],
    "A/B测试": ["ab测试", "a/b测试", "实验分析", "ab实验"],
    "推荐系统": ["推荐系统", "推荐算法", "召回", "排序"],
}
PROFILE_TOOLS: dict[str, list[str]] = {
    "Excel": ["excel", "vlookup", "数据透视表", "pivot"],
    "Power BI": ["powerbi", "power bi"],
    "Tableau": ["tableau"],
    "Git": ["git", "github", "gitlab"],
    "Linux": ["linux", "shell", "bash"],
    "Spark": ["spark", "pyspark"],
    "Hadoop": ["hadoop", "hdfs", "mapreduce"],
    "Flink": ["flink"],
    "Hive": ["hive"],
    "Docker": ["docker"],
    "Kubernetes": ["kubernetes", "k8s"],
    "Redis": ["redis"],
    "Kafka": ["kafka"],
    "Airflow": ["airflow"],
    "Pandas": ["pandas"],
    "NumPy": ["numpy"],
    "Scikit-learn": ["scikit-learn", "sklearn"],
    "PyTorch": ["pytorch", "torch"],
    "TensorFlow": ["tensorflow"],
}
PROFILE_CERTIFICATES: dict[str, list[str]] = {
    "CET-4": ["cet-4", "cet4", "英语四级", "大学英语四级", "四级"],
    "CET-6": ["cet-6", "cet6", "英语六级", "大学英语六级", "六级"],
    "PMP": ["pmp", "项目管理专业人士"],
    "CPA": ["cpa", "注册会计师"],
    "软考": ["软考", "软件设计师", "系统架构设计师", "信息系统项目管理师"],
    "计算机二级": ["计算机二级", "全国计算机等级考试二级", "ncre二级"],
    "教师资格证": ["教师资格证", "教资"],
}
#: Separators of lists, by module. Fixed values.
DELIMITERS = {
    "aggregator": r"[、,，;；/|｜\n]+", "assets": r"[、,，;；/|｜\n]+", "job_profile": r"[、,，;；/|｜\n]+", "match": r"[、,，;；/|｜\n]+", "student": r"[、,，;；/|｜\n\t]+", "resume": r"[、,，;；|/\n]+",
    "extraction": r"[、,，;/；|]+", "graph": r"[、,，;/；|]+", "response": r"[、,，;/；|]+",
}
SIGNS = r"[()（）\[\]【】\-_/|｜·,，;；:+.#\s]"


@dataclass(frozen=True)
class Entry:
    """Aliases of standard names, in the order in which they are tried, and whether an alias may stand inside the text."""

    aliases: dict[str, list[str]]
    contained: bool = True


REGISTRY: dict[tuple[str, str], Entry] = {
    ("major", "assets"): Entry(vocab.MAJOR_ALIASES),
    ("certificate", "assets"): Entry(vocab.CERTIFICATE_ALIASES),
    ("skill", "aggregator"): Entry(vocab.SKILL_ALIASES),
    ("major", "job_profile"): Entry(PROFILE_MAJORS),
    ("skill", "job_profile"): Entry(PROFILE_SKILLS),
    ("tool", "job_profile"): Entry(PROFILE_TOOLS),
    ("certificate", "job_profile"): Entry(PROFILE_CERTIFICATES),
    ("major", "student"): Entry(vocab.STUDENT_MAJORS),
    ("skill", "student"): Entry(vocab.STUDENT_SKILLS),
    ("certificate", "student"): Entry(vocab.STUDENT_CERTIFICATES),
}


def entry(domain: str, module: str) -> Entry:
    try:
        return REGISTRY[domain, module]
    except KeyError:
        known = ", ".join(f"{d} of {m}" for d, m in REGISTRY)
        raise KeyError(f"no names of {domain} in {module}; there are: {known}") from None


def compact(word: str) -> str:
    return re.sub(SIGNS, "", word.lower())


def standard_name(c: Column, domain: str, module: str) -> Column:
    """The first standard name that the text equals, or one of whose aliases it equals, holds or is held by (from two letters
    on), signs and case aside; the cleaned text itself where there is none, NULL for no text."""
    e = entry(domain, module)

    def named(x: Column) -> Column:
        token, tests = x["token"], []
        for name, words in e.aliases.items():
            forms = [f for f in dict.fromkeys(map(compact, words)) if f]
            test = (x["plain"] == name) | token.isin(*dict.fromkeys([compact(name), *forms]))
            for f in forms if e.contained else []:
                test = test | ((F.char_length(token) >= 2) & F.contains(F.lit(f), token))
                test = test | F.contains(token, F.lit(f)) if len(f) >= 2 else test
            tests.append(F.when(test, F.lit(name)))
        return F.coalesce(*tests, x["plain"])

    plain = clean_text(c, entities=False)
    return F.when(plain.isNotNull(), let(let(plain, lambda t: F.struct(F.regexp_replace(F.lower(t), SIGNS, "").alias("token"), t.alias("plain"))), named))


def items(c: Column, module: str) -> Column:
    """The different items of a list in a text: a JSON array, or cut by the module's separators; in order, an empty array for none."""
    empty = F.array().cast("array<string>")
    parsed = F.when(F.rlike(F.trim(c), F.lit(r"(?s)^\[.*\]$")), F.from_json(c, "array<string>"))
    cleaned = F.transform(F.coalesce(parsed, F.split(c, DELIMITERS[module])), lambda x: clean_text(x, entities=False))
    return F.coalesce(F.array_distinct(F.filter(cleaned, lambda x: x.isNotNull())), empty)


def standard_names(c: Column, domain: str, module: str) -> Column:
    """The standard names of a list in a text, each once, in order."""
    return F.array_distinct(F.transform(items(c, module), lambda x: standard_name(x, domain, module)))
