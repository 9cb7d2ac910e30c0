"""Entries of one written resume, and of odd ones."""

from laborline.operators import entries

BODY = """张三
教育背景：
北京某大学（985）软件工程 本科 2018.09-2022.06
主修课程 数据结构
2022.09 - 至今 上海某学院 硕士学位 绩点3.8
计算机科学
获得奖学金
工作经历
无日期的一行
2020.07-08.30 某某科技有限公司 Java开发工程师：负责接口；编写测试
优化性能
优化性能。
优化性能
2021.01~2021.03 腾讯 后台开发 2021.04至2021.05 阿里集团 产品助理
写文档
2021.01~2021.03 腾讯 后台开发，重复
2021.01~2021.03 腾讯 后台开发 重复
2022.01-至今
项目经验 智能招聘平台的长标题接着写在同一行里面
智能招聘平台
担任:后端负责人，负责接口
技术栈:Spring
数据大屏系统 2023
https://x.y 前端工程师
产品经理
2022/1-2022/5 推荐系统 项目描述:召回
另一个平台
2022/1-2022/5 推荐系统
求职意向 Java开发"""


def rows(spark, f, *bodies):
    df = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "id long, body string")
    return sorted(tuple(r) for r in f(entries.section_lines(df, "id", "body"), "id").collect())


def test_entries_of_a_resume(spark):
    assert rows(spark, entries.schools, BODY) == [
        (0, 1, "北京某大学", "985", "软件工程", "本科", "2018.09", "2022.06", "主修课程 数据结构"),
        (0, 2, "上海某学院", "", "计算机科学", "硕士", "2022.09", "至今", "绩点3.8 获得奖学金"),
    ]
    assert rows(spark, entries.internships, BODY) == [
        (0, 1, "某某科技有限公司", "Java开发工程师", "2020.07", "2020.08.30", "负责接口; 编写测试 优化性能"),
        (0, 2, "腾讯", "后台开发", "2021.01", "2021.03", ""),
        (0, 3, "阿里集团", "产品助理", "2021.04", "2021.05", "写文档"),
        (0, 4, "腾讯", "后台开发,重复", "2021.01", "2021.03", ""),
    ]
    assert rows(spark, entries.projects, BODY) == [
        (0, 1, "智能招聘平台的长标题接着写在同一行里面", "后端负责人", "", "", "智能招聘平台 担任:后端负责人,负责接口 技术栈:Spring"),
        (0, 2, "数据大屏系统 2023", "前端工程师", "", "", "产品经理"),
        (0, 3, "推荐系统", "", "2022/1", "2022/5", "项目描述:召回 另一个平台"),
    ]


def test_entries_of_odd_resumes(spark):
    odd = [None, "", " \n　\n", "实习经历", "没有标题 2020.01-2020.02 某公司", "教育经历\n课程\n项目经历\n，；\n实习经历\n2020.01-2020.02"]
    for f in (entries.schools, entries.internships, entries.projects):
        assert rows(spark, f, *odd) == []
    assert rows(spark, entries.projects, "项目经历\n2020.01-2020.02 A\n\n科研项目：\n2021.01-2021.02 B") == [(0, 1, "A", "", "2020.01", "2020.02", ""), (0, 2, "B", "", "2021.01", "2021.02", "")]


def test_lines_of_several_ranges_and_near_repeats(spark):
    df = spark.createDataFrame([(["前言 2020.01-2020.02 甲，2020.03-2020.04 乙；", "丙", "丙。", "丁"],)], "l array<string>")
    assert df.select(entries.by_dates(df["l"])).first()[0] == ["2020.01-2020.02 甲", "2020.03-2020.04 乙", "丙", "丁"]
