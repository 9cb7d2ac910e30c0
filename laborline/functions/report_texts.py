"""Texts of the sections of a career report: fixed values.

A line holds fields in braces: an optional kind, paths of which the first that has a value counts, and what stands for none. A
line that begins with ``?path?`` is left out where that field is blank.
"""

NONE = "暂无明确记录"

STUDENT = [
    "学生姓名：{student.name|未提供}",
    "教育背景：{student.school|未提供学校}，{student.degree|未提供学历}，专业为{student.major|未提供专业}，预计毕业年份{student.graduation_year|未提供}。",
    "核心硬技能：{list:student.hard_skills}。",
    "工具技能：{list:student.tool_skills}。",
    "证书与资质：{list:student.certificates}。",
    "软技能标签：{list:student.soft_skills}。",
    "项目经历摘要：{projects:student.project_experience}。",
    "实习经历摘要：{internships:student.internship_experience}。",
    "画像完整度得分：{number:student.profile_completeness_score}；竞争力得分：{number:student.competitiveness_score}。",
    "潜力画像：{student.growth_level|未明确}；优势方向：{list:student.preferred_directions or student.domain_tags}。",
    "学生画像总结：{student.summary|暂无总结}",
]
JOB = [
    "目标岗位：{job.requested_job_name or job.standard_job_name|未明确}",
    "标准化岗位：{job.resolved_job_name|暂无明确记录}；画像资产状态：{job.asset_status}",
    "岗位类别与层级：{job.job_category|未明确类别} / {job.job_level|未明确层级}；样本数：{job.sample_count|0}。",
    "学历主流画像：{job.degree_gate or job.mainstream_degree or job.degree_requirement|未明确}；学历分布：{shares:job.degree_distribution}。",
    "专业主流画像：{list:job.major_gate_set or job.mainstream_majors or job.major_requirement}；专业分布：{shares:job.major_distribution}。",
    "证书要求画像：必备证书为{list:job.must_have_certificates}；偏好证书为{list:job.preferred_certificates or job.mainstream_certificates}；证书分布：{shares:job.certificate_distribution}；无明确证书要求比例：{percent:job.no_certificate_requirement_ratio}。",
    "核心技能要求：{list:job.hard_skills}。",
    "工具/技术栈要求：{list:job.tool_skills}。",
    "核心知识点要求：{list12:job.required_knowledge_points}。",
    "加分知识点：{list12:job.preferred_knowledge_points}。",
    "岗位七维能力画像：{abilities:job.ability_requirements|暂无岗位七维能力画像资产}。",
    "软技能与实践要求：软技能包括{list:job.soft_skills}；实践要求包括{list:job.practice_requirement}。",
    "薪资概况：{job.salary_text|暂无明确薪资统计}。",
    "城市分布：{named:job.city_distribution|暂无明确分布信息}。",
    "行业分布：{named:job.industry_distribution|暂无明确分布信息}。",
    "岗位画像总结：{job.summary|暂无总结}",
]
ASSET_FOUND = ("已命中标准岗位画像资产：", "。")
ASSET_MISSING = "当前目标岗位未完整命中标准岗位画像资产，以下画像仅基于已有岗位结构、SQL事实与规则抽取结果，可信度有限。"
SALARY = "月薪下界均值{job.salary_min}，上界均值{job.salary_max}，中位参考{job.salary_mid}"
MATCH = [
    "目标岗位：{match.target_job_name|未明确}",
    "第一层：规则匹配结果。",
    "综合匹配分数：{number:match.overall_match_score}；匹配等级：{match.match_level|未明确}。",
    "四维度分数：基础要求 {number:match.basic_requirement_score}，职业技能 {number:match.vocational_skill_score}，职业素质 {number:match.professional_quality_score}，发展潜力 {number:match.development_potential_score}。",
    "说明：旧规则综合分代表规则侧综合匹配程度，不等同于赛题硬门槛全部通过。",
    "匹配优势：{list:match.strengths}。",
    "当前短板：{list:match.weaknesses}。",
    "补强建议：{list:match.improvement_suggestions}。",
    "投递建议：{match.recommendation|暂无明确建议}",
    "分析摘要：{match.analysis_summary|暂无摘要}",
    "第二层：赛题评测结果。",
    "赛题资产分：{number:target.asset_match_score}；主展示分：{number:target.display_match_score}；风险等级：{target.risk_level|暂无明确记录}。",
    "学历匹配：学生学历为{target.degree.student_value|暂无明确记录}；岗位门槛/主流要求为{target.degree.job_gate or target.degree.mainstream_requirement|暂无明确记录}；结论：{bool:target.degree.pass}；风险：{target.degree.risk_level|暂无明确记录}；说明：{target.degree.message or target.degree.reason|暂无明确记录}。",
    "专业匹配：学生专业为{target.major.student_value|暂无明确记录}；岗位专业集合为{list:target.major.job_gate_set or target.major.mainstream_majors}；结论：{bool:target.major.pass}；风险：{target.major.risk_level|暂无明确记录}；说明：{target.major.message or target.major.reason|暂无明确记录}。",
    "证书匹配：学生证书为{list:target.certificate.student_values}；必备证书为{list:target.certificate.must_have_certificates}；偏好证书为{list:target.certificate.preferred_certificates}；结论：{bool:target.certificate.pass}；风险：{target.certificate.risk_level|暂无明确记录}；说明：{target.certificate.message or target.certificate.reason|暂无明确记录}。",
    "三项硬门槛总体结论：{bool:target.all_pass}。",
    "技能知识点匹配：要求知识点包括{list:target.required_knowledge_points}；已命中知识点包括{list:target.matched_knowledge_points}；缺失知识点包括{list:target.missing_knowledge_points}；知识点覆盖率为{percent:target.knowledge_point_accuracy}；是否达到 80%：{bool:target.knowledge_pass}。",
    "七维能力匹配：总体能力适配度为{percent:target.ability_score}；优势能力为{list:target.main_strengths}；风险能力为{list:target.main_risks}。能力差距明细：{gaps:target.abilities|暂无能力匹配数据}。",
    "赛题综合评测：硬门槛通过={bool:target.hard_info_pass}；技能准确性达标={bool:target.skill_accuracy_pass}；最终赛题匹配成功={bool:target.contest_match_success}。",
]
NO_ASSETS = "岗位评测资产不足，学历/专业/证书和知识点硬门槛结论仅供参考。"
EXPLAINED = "?target.score_explanation?分数解释：{target.score_explanation}"
GOAL = [
    "用户原始目标岗位：{plan.user_target_job or plan.primary_target_job|未明确}",
    "系统推荐岗位：{plan.system_recommended_job|暂无明确记录}",
    "系统推荐主路径岗位：{plan.primary_plan_job or plan.primary_target_job|未明确}",
    "原目标角色：{plan.target_job_role|暂无明确记录}；推荐岗位角色：{plan.recommended_job_role|暂无明确记录}。",
    "主目标决策来源：{plan.goal_decision_source|暂无明确记录}；置信度：{plan.goal_decision_confidence|暂无明确记录}。",
    "备选目标岗位：{list:plan.secondary_target_jobs}。",
    "目标定位：{plan.goal_positioning|暂无明确定位}",
    "选择原因：{plan.goal_reason|暂无明确说明}",
    "规则决策依据：{list:plan.goal_decision_reason}。",
    "目标岗位路径数据状态：{plan.path_status|available}。",
    "路径数据说明：{plan.path_message|当前目标岗位存在可用路径数据。}",
]
PATHS = ["直接路径：{list:plan.direct_path}。", "过渡路径：{list:plan.transition_path}。", "长期路径：{list:plan.long_term_path}。", "路径策略：{plan.path_strategy|未明确}。", "路径决策摘要：{plan.decision_summary|暂无摘要}"]
NO_PATHS = [
    "直接路径：暂无真实路径数据。", "过渡路径：暂无真实路径数据。", "长期路径：暂无真实路径数据。", "路径策略：{plan.path_strategy|未明确}。", "路径决策摘要：{plan.path_message|当前目标岗位暂无真实晋升/转岗路径数据，系统不会强行生成不存在的职业路径。}",
    "可信度说明：当前目标岗位没有真实路径数据，报告不会展示或生成任何伪造的晋升/转岗路径。",
]
SHORT, MID = "短期计划（建议 3-6 个月）：", "中期计划（建议 6-18 个月）："
NO_SHORT, NO_MID = "暂无明确短期计划", "暂无明确中期计划"
SHORT_WITHOUT_PATHS = [
    "围绕学历、专业、证书三项硬门槛核验结果，补充可证明的简历材料与证书信息。", "优先补齐缺失知识点：{list8:target.missing_knowledge_points}。",
    "准备 1-2 个与{plan.primary_plan_job or plan.primary_target_job|主路径岗位}直接相关的项目案例，突出技术选型、问题定位和结果指标。",
]
MID_WITHOUT_PATHS = [
    "围绕{plan.primary_plan_job or plan.primary_target_job|主路径岗位}持续积累真实项目或实习经验，并用作品集证明岗位关键能力。", "将{plan.user_target_job}作为中期补强后的冲刺目标，逐步补齐其关键知识点与项目证据。",
    "根据投递反馈动态调整目标岗位和备选岗位，不依赖当前缺失的晋升/转岗路径数据。",
]
PATH_WORDS = ["纵向路径", "横向转岗路径", "晋升路径", "转岗路径", "过渡路径"]
ABILITY_ACTIONS = {
    "沟通能力": "补充跨团队协作、需求沟通或客户对接案例，在简历中写清沟通对象、协作过程和交付结果。", "实习能力": "优先补充与目标岗位相关的实习、真实项目或交付经历，用作品集证明岗位实践能力。",
    "抗压能力": "补充高复杂度项目、紧急问题定位或多任务推进经历，体现抗压和结果导向。", "创新能力": "沉淀项目优化、方案设计、技术攻关或创新改进案例，突出问题、方案和效果指标。",
    "学习能力": "整理近期学习路线、技术复盘和新技术应用案例，证明快速学习和持续成长能力。", "证书要求": "结合岗位证书偏好补充可验证证书或资格证明，降低硬门槛风险。",
}
RISK = [
    "主要风险与缺口：{list:plan.risk_and_gap}。",
    "匹配短板补充：{list:match.weaknesses}。",
    "学历风险：{target.degree.message|暂无明确记录}",
    "专业风险：{target.major.message|暂无明确记录}",
    "证书风险：{target.certificate.message|暂无明确记录}",
    "知识点缺口：{list:target.missing_knowledge_points}；知识点覆盖率：{percent:target.knowledge_point_accuracy}；是否达到 80%：{bool:target.knowledge_pass}。",
    "七维能力风险：优势能力为{list:target.main_strengths}；风险能力为{list:target.main_risks}；建议行动：{actions:target.abilities|暂无明确记录}。",
    "赛题匹配成功结论：{bool:target.contest_match_success}。",
    "动态调整建议：{list:match.improvement_suggestions}。",
    "建议每 1-2 个月根据岗位招聘要求、项目产出、实习反馈和技能掌握情况更新一次职业规划，并同步修订简历与目标岗位优先级。",
]
CONCLUDED = "{plan.decision_summary or match.analysis_summary|暂无综合结论}"
CONCLUDED_OTHER = "系统建议以{plan.primary_plan_job or plan.primary_target_job}作为短期主路径，同时保留{plan.user_target_job}作为中期补强后的冲刺目标。当前主路径岗位暂无真实晋升/转岗路径数据，因此本报告不生成职业路径，只从岗位匹配、硬门槛评测、知识点缺口和行动计划角度给出建议。"
CONCLUDED_SAME = "当前建议以{plan.primary_plan_job or plan.primary_target_job or match.target_job_name|目标岗位}作为求职目标，但本地岗位图谱和离线岗位画像中暂未沉淀该岗位明确晋升/转岗路径。因此本报告不生成目标岗位路径，仅从岗位匹配、硬门槛评测、技能知识点缺口和行动计划角度给出建议。"
ADVICE_OTHER = "短期优先围绕{plan.primary_plan_job or plan.primary_target_job}准备项目证据、知识点补齐和投递材料；{plan.user_target_job}作为中期补强后的冲刺目标持续跟踪。"
ADVICE = "{match.recommendation|建议围绕目标岗位持续补齐核心技能、项目经验与岗位表达能力。}"
SUMMARY = [
    "用户原始目标岗位：{plan.user_target_job|暂无明确记录}；系统推荐岗位：{plan.system_recommended_job|暂无明确记录}；主路径岗位：{plan.primary_plan_job or plan.primary_target_job or match.target_job_name|目标岗位}。",
    "目标平衡建议：{plan.balance|建议根据投递反馈和知识点补齐进度动态调整主目标与备选目标。}",
]
ADDRESSED = "报告对象：{student.name|学生}；报告主路径岗位：{plan.primary_plan_job or plan.primary_target_job or match.target_job_name|目标岗位}。"
TITLES = ["学生基本情况与能力画像", "目标岗位画像与职业探索", "人岗匹配分析", "职业目标设定与职业路径规划", "分阶段行动计划", "风险分析与动态调整建议", "总结与建议"]
