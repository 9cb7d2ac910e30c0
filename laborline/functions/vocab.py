"""Word lists, tables and patterns that results depend on. Kept in their natural order, which decides ties."""

from __future__ import annotations

#: Header names that mean a canonical column.
COLUMN_ALIASES: dict[str, list[str]] = {
    "job_title": ["职位名称", "岗位名称", "职位", "岗位", "job_title"],
    "job_address": ["工作地址", "工作地点", "地址", "城市", "job_address"],
    "salary_range": ["薪资范围", "薪资", "工资范围", "salary_range"],
    "company_name": ["公司全称", "公司名称", "企业名称", "company_name"],
    "industry": ["所属行业", "行业", "industry"],
    "company_size": ["人员规模", "公司规模", "规模", "company_size"],
    "company_type": ["企业性质", "公司类型", "融资阶段", "company_type"],
    "job_code": ["职位编码", "岗位编码", "job_code"],
    "job_description": ["职位描述", "岗位详情", "岗位描述", "工作内容", "job_description"],
    "company_description": ["公司简介", "公司详情", "company_description"],
    "updated_at": ["更新时间", "更新日期", "updated_at"],
    "job_url": ["岗位链接", "岗位来源地址", "职位链接", "job_url"],
}

NULL_WORDS = ("", "nan", "none", "null", "n/a", "na", "-")

#: First substring found decides.
COMPANY_TYPES: list[tuple[str, str]] = [
    ("不需要融资", "不需要融资"), ("未融资", "未融资"), ("天使轮", "天使轮"), ("A轮", "A轮"), ("B轮", "B轮"), ("C轮", "C轮"),
    ("D轮", "D轮及以上"), ("上市", "上市公司"), ("国企", "国企"), ("央企", "央企"), ("民营", "民营"), ("民企", "民营"), ("私企", "民营"),
    ("合资", "合资"), ("外资", "外资"), ("外商独资", "外资"), ("事业单位", "事业单位"), ("政府", "政府/公共机构"), ("高校", "高校/院校"), ("学校", "高校/院校"),
]

PROMO_WORDS = ("急聘", "诚聘", "直招", "校招", "社招", "双休", "五险一金", "包吃住", "可实习", "接受小白", "可转正")

#: Short form, full form.
TITLE_SUFFIXES: list[tuple[str, str]] = [
    ("java开发", "java开发工程师"), ("python开发", "python开发工程师"), ("前端开发", "前端开发工程师"), ("后端开发", "后端开发工程师"),
    ("测试开发", "测试开发工程师"), ("实施工程", "实施工程师"), ("技术支持工程", "技术支持工程师"), ("运维工程", "运维工程师"), ("数据分析员", "数据分析师"),
]

JOB_FAMILIES: list[tuple[str, str]] = [
    ("前端", "前端开发"), ("后端", "后端开发"), ("全栈", "全栈开发"), ("java", "Java开发"), ("python", "Python开发"), ("测试", "测试"),
    ("算法", "算法"), ("数据分析", "数据分析"), ("数据开发", "数据开发"), ("数据", "数据类"), ("产品", "产品"), ("实施", "实施交付"),
    ("运维", "运维"), ("安全", "安全"), ("架构", "架构"), ("ui", "UI设计"), ("设计", "设计"), ("销售", "销售"), ("技术支持", "技术支持"),
]

DOMAIN_KEYWORDS = [
    "java", "python", "golang", "go", "c++", "c#", "php", "vue", "react", "angular", "node", "node.js", "html", "css", "javascript",
    "typescript", "sql", "mysql", "oracle", "redis", "mongodb", "postgresql", "linux", "docker", "kubernetes", "前端", "后端", "全栈",
    "开发", "工程师", "测试", "算法", "数据", "分析", "产品", "实施", "运维", "安全", "架构", "设计", "视觉", "ui", "交互", "销售", "技术支持",
]
STOP_TOKENS = [
    "工程师", "开发", "专员", "顾问", "助理", "岗位", "高级", "资深", "中级", "初级", "经理", "主管", "负责人", "实习", "全职", "兼职",
]

CS_TITLE = {
    "java": 3.0, "python": 3.0, "golang": 3.0, "go开发": 3.0, "c++": 3.0, "c#": 3.0, "php": 3.0, "前端": 3.0, "后端": 3.0, "全栈": 3.0,
    "算法": 3.0, "软件": 2.8, "开发工程师": 2.6, "测试开发": 2.8, "运维": 2.6, "网络安全": 2.8, "数据开发": 2.6, "数据分析": 2.3, "数据库": 2.4,
    "机器学习": 3.0, "人工智能": 3.0, "大数据": 2.8, "产品经理": 1.4, "实施工程师": 1.2, "技术支持工程师": 1.0, "ui": 1.3, "交互": 1.3,
}
CS_DESCRIPTION = {
    "java": 2.2, "python": 2.2, "golang": 2.2, "c++": 2.0, "c#": 2.0, "sql": 2.2, "mysql": 2.0, "oracle": 1.8, "redis": 1.8, "mongodb": 1.8,
    "postgresql": 1.8, "html": 1.6, "css": 1.6, "javascript": 2.0, "typescript": 2.0, "vue": 1.8, "react": 1.8, "spring": 1.8, "linux": 1.6,
    "docker": 1.6, "kubernetes": 1.6, "软件开发": 2.0, "系统开发": 1.8, "系统设计": 1.8, "编程": 1.8, "代码": 1.8, "数据库": 1.8, "前端": 1.6,
    "后端": 1.6, "算法": 2.0, "数据分析": 1.8, "数据建模": 1.8, "产品需求": 1.0, "软件实施": 1.2, "信息化": 1.4,
}
CS_INDUSTRY = {"信息技术": 1.8, "互联网": 1.8, "软件": 1.8, "计算机": 1.8, "it": 1.4, "人工智能": 1.8, "电子商务": 1.2, "大数据": 1.6, "云计算": 1.6, "网络安全": 1.8}
NON_CS_TITLE = {
    "化学": 3.2, "化工": 3.2, "食品": 3.2, "微生物": 3.2, "生物": 3.0, "制药": 3.0, "药学": 3.0, "医学": 3.0, "护士": 3.2, "医生": 3.2,
    "机械": 3.0, "电气": 3.0, "土木": 3.0, "建筑": 3.0, "暖通": 3.0, "施工": 3.0, "财务": 2.8, "会计": 2.8, "出纳": 2.8, "销售": 2.8,
    "招商主管": 2.8, "导购": 2.8, "客服": 2.6, "人事": 2.8, "行政": 2.8, "教师": 2.8, "普工": 3.0, "仓管": 2.8, "物流": 2.6,
}
NON_CS_DESCRIPTION = {
    "化学工程": 2.8, "化工工艺": 2.8, "食品": 2.8, "微生物": 2.8, "生物实验": 2.6, "药品": 2.6, "药学": 2.6, "临床": 2.8, "病房": 2.8,
    "护理": 2.8, "机械设计": 2.8, "机械制图": 2.8, "cad": 2.0, "土建": 2.8, "施工现场": 2.8, "工艺流程": 2.4, "生产车间": 2.8, "质量检验": 2.6,
    "销售客户": 2.4, "渠道拓展": 2.4, "会计核算": 2.6, "财税": 2.6, "招聘培训": 2.4, "行政后勤": 2.6,
}
NON_CS_INDUSTRY = {
    "食品": 2.4, "化工": 2.4, "生物": 2.4, "医药": 2.4, "医疗": 2.4, "建筑": 2.4, "土木": 2.4, "机械": 2.4, "制造": 2.0, "餐饮": 2.4,
    "零售": 1.8, "物流": 1.8, "教育": 1.8, "房地产": 1.8,
}
AMBIGUOUS_TITLES = ["实施工程师", "技术支持工程师", "产品经理", "数据分析师", "ui设计师", "交互设计师", "运营", "项目经理"]

UNKNOWN, NO_LIMIT = "未明确", "学历不限"
DEGREE_RANK = {"未明确": -1, "学历不限": 0, "高中/中专": 1, "大专": 2, "本科": 3, "硕士": 4, "博士": 5}
DEGREE_PATTERNS = [
    (r"(学历不限|不限学历|无学历要求)", "学历不限"),
    (r"(博士|博士研究生|PhD|PHD|phd)", "博士"),
    (r"(硕士|研究生|master|MBA|mba)", "硕士"),
    (r"(本科|学士|bachelor)", "本科"),
    (r"(大专|专科|高职|college)", "大专"),
    (r"(高中|中专)", "高中/中专"),
]
MAJOR_ALIASES: dict[str, list[str]] = {
    "计算机科学与技术": ["计算机科学与技术", "计算机科学", "计算机技术", "计算机", "网络工程"],
    "软件工程": ["软件工程", "软件开发", "软件技术"],
    "数据科学与大数据技术": ["数据科学与大数据技术", "数据科学", "大数据", "数据技术"],
    "人工智能": ["人工智能", "机器学习", "智能科学与技术", "模式识别"],
    "统计学": ["统计学", "应用统计", "数理统计", "经济统计"],
    "数学": ["数学", "应用数学", "数学与应用数学", "计算数学"],
    "电子信息工程": ["电子信息", "电子信息工程", "通信工程", "自动化", "电子科学与技术"],
    "信息管理与信息系统": ["信息管理与信息系统", "信息管理", "信息系统", "信管"],
    "地理信息科学": ["地理信息", "GIS", "gis", "测绘工程", "遥感科学与技术"],
    "网络空间安全": ["网络空间安全", "信息安全", "网络安全", "安全工程"],
    "物联网工程": ["物联网工程", "物联网"],
    "金融学": ["金融学", "金融工程", "金融科技"],
    "市场营销": ["市场营销", "电子商务", "工商管理"],
}
CERTIFICATE_ALIASES: dict[str, list[str]] = {
    "CET-4": ["CET-4", "cet-4", "cet4", "英语四级", "大学英语四级", "四级"],
    "CET-6": ["CET-6", "cet-6", "cet6", "英语六级", "大学英语六级", "六级"],
    "PMP": ["PMP", "pmp", "项目管理专业人士"],
    "CPA": ["CPA", "cpa", "注册会计师"],
    "软考": ["软考", "软件设计师", "系统架构设计师", "信息系统项目管理师", "系统集成项目管理工程师"],
    "软件评测师": ["软件评测师", "软件测试工程师证书"],
    "ISTQB": ["ISTQB", "istqb", "国际软件测试认证"],
    "计算机二级": ["计算机二级", "全国计算机等级考试二级", "NCRE二级", "ncre二级"],
    "教师资格证": ["教师资格证", "教资"],
    "日语N1": ["日语N1", "日语一级", "JLPT N1", "N1"],
    "日语N2": ["日语N2", "日语二级", "JLPT N2", "N2"],
    "日语N3": ["日语N3", "日语三级", "JLPT N3", "N3"],
    "CCNA": ["CCNA", "ccna"],
    "HCIA": ["HCIA", "hcia", "华为HCIA"],
    "HCIP": ["HCIP", "hcip", "华为HCIP"],
    "AWS认证": ["AWS认证", "AWS Certified", "aws认证"],
    "阿里云认证": ["阿里云认证", "ACP认证", "ACA认证"],
    "Oracle认证": ["Oracle认证", "OCP", "ocp"],
}
CERT_MUST = ["必须", "必备", "需持有", "需要持有", "持有", "具备", "取得", "通过", "要求"]
CERT_PREFERRED = ["优先", "加分", "更佳", "最好", "有者优先", "可优先"]
NO_CERTIFICATE = "无明确要求"

SKILL_ALIASES: dict[str, list[str]] = {
    "Python": ["python", "python3", "py"],
    "Java": ["java", "spring", "springboot"],
    "C++": ["c++", "cpp"],
    "SQL": ["sql", "mysql", "postgresql", "oracle", "hive sql"],
    "机器学习": ["机器学习", "machine learning", "ml", "sklearn", "scikit-learn"],
    "深度学习": ["深度学习", "deep learning", "pytorch", "tensorflow"],
    "NLP": ["nlp", "自然语言处理", "文本挖掘", "大语言模型", "llm"],
    "数据分析": ["数据分析", "数据处理", "数据清洗", "业务分析"],
    "数据可视化": ["数据可视化", "可视化", "tableau", "power bi", "powerbi"],
    "Excel": ["excel", "vlookup", "数据透视表"],
    "Spark": ["spark", "pyspark"],
    "Hadoop": ["hadoop", "hdfs", "mapreduce"],
    "Flink": ["flink"],
    "Docker": ["docker"],
    "Linux": ["linux", "shell", "bash"],
    "Git": ["git", "github", "gitlab"],
}
EXPERIENCE_PATTERNS = [
    (r"(经验不限|无需经验|不限经验|接受应届|应届生|应届毕业生|可实习)", "经验不限/应届可投"),
    (r"([1-2]\s*年|一到两年|1年以上|2年以上)", "1-2年经验"),
    (r"([3-5]\s*年|三到五年|3年以上|5年以上)", "3-5年经验"),
    (r"(5\s*年以上|五年以上|8\s*年以上|10\s*年以上)", "5年以上经验"),
    (r"(实习经验|有实习经历|校内外实践)", "有实习/实践经验"),
    (r"(项目经验|有项目经历|项目落地)", "有项目经验"),
]
PRACTICE_PATTERNS = [
    (r"(实习经验|实习经历|可实习|在校实习)", "实习要求"),
    (r"(项目经验|项目经历|独立负责项目|有完整项目)", "项目要求"),
    (r"(出差|驻场|外派)", "可接受出差/驻场"),
    (r"(英语读写|英文文档|口语流利|CET-6|英语六级)", "英语能力要求"),
    (r"(抗压|高强度|加班)", "抗压/强执行要求"),
    (r"(跨部门|协同|沟通业务|客户沟通)", "跨部门协作要求"),
]
SOFT_SKILL_PATTERNS = [
    (r"(沟通|表达|协调|跨部门)", "沟通协作"),
    (r"(学习能力|自驱|主动学习|快速学习)", "学习能力"),
    (r"(责任心|认真负责|owner意识|主人翁)", "责任心"),
    (r"(逻辑思维|结构化思考|分析能力|问题拆解)", "逻辑分析"),
    (r"(抗压|执行力|结果导向|推动落地)", "执行抗压"),
    (r"(团队合作|团队协作|合作意识)", "团队合作"),
    (r"(创新|探索|好奇心)", "创新意识"),
]
LEVEL_RANK = {"实习": 1, "初级": 2, "中级": 3, "高级": 4, "专家": 5, "负责人": 5}

#: key, label, keywords
ABILITY_DIMENSIONS: list[tuple[str, str, list[str]]] = [
    ("professional_skill", "专业技能", ["技能", "开发", "测试", "设计", "数据库", "算法", "编程", "架构", "技术", "工具"]),
    ("certificate", "证书要求", ["证书", "资格证", "认证", "英语", "CET", "软考", "日语", "等级证"]),
    ("innovation", "创新能力", ["创新", "技术攻关", "方案设计", "优化", "研发", "算法", "建模", "改进", "新技术", "产品创新", "解决方案", "架构设计"]),
    ("learning", "学习能力", ["学习能力", "快速学习", "自驱", "成长", "培训", "适应能力", "主动学习", "学习新技术", "善于总结", "勤恳好学"]),
    ("pressure_resistance", "抗压能力", ["抗压", "压力", "承受压力", "多任务", "紧急响应", "责任心", "驻场", "加班", "高强度", "结果导向", "心理素质"]),
    ("communication", "沟通能力", ["沟通", "协调", "表达", "客户对接", "跨部门", "团队协作", "汇报", "需求沟通", "文档编写", "培训客户", "协作"]),
    ("internship_practice", "实习能力", ["实习", "项目经验", "实践经验", "交付", "上线", "驻场", "项目实施", "业务实践", "工作经验", "项目经历", "实际项目"]),
]
ABILITY_WEIGHTS = {"professional_skill": 0.25, "certificate": 0.10, "innovation": 0.10, "learning": 0.15, "pressure_resistance": 0.10, "communication": 0.15, "internship_practice": 0.15}

CURATED_INCLUDE = [
    "软件", "测试", "Java", "java", "前端", "后端", "开发", "算法", "数据", "数据库", "网络", "信息", "计算机", "嵌入", "硬件", "运维",
    "DevOps", "实施", "技术支持", "C/C++", "cc++", "质量", "项目经理", "架构", "物联网", "自动驾驶", "操作系统",
]
CURATED_EXCLUDE = [
    "HRBP", "招聘", "销售", "客服", "翻译", "律师", "法务", "专利", "APP推广", "app推广", "广告", "商务", "运营", "财务", "会计", "行政",
    "人事", "董事长", "总经理助理", "CEO助理", "VP销售",
]
CURATED_EXCLUDE_EXACT = ["VP", "储备经理人"]
DISPLAY_ALIASES = {"java": "Java开发工程师", "JAVA": "Java开发工程师", "Java": "Java开发工程师", "cc++": "C/C++嵌入式软件开发工程师", "c/c++": "C/C++嵌入式软件开发工程师", "C/C++": "C/C++嵌入式软件开发工程师"}

REPORT_SECTIONS = ["student", "job", "match", "goal_and_path", "phase_plan", "risk", "summary"]

#: Words and symbols that a lookup key of a job name leaves out, and role words that a name is searched by. Fixed values.
WEAK_NAME_WORDS = "(岗位|职位|职务|方向|招聘|急聘|校招|社招|热招|岗位要求)"
LEVEL_NAME_WORDS = "(初级|中级|高级|资深|专家级|实习生|实习)"
NAME_SYMBOLS = r"[\s\-_/\\|｜,，;；:：()（）\[\]【】{}<>《》\"'“”‘’·]+"
ROLE_WORDS = [
    "c/c++", "c++", "c#", "java", "python", "android", "ios", "web", "app", "qa", "嵌入式软件", "嵌入式", "软件测试", "硬件测试", "质量管理", "技术支持", "项目经理", "项目招投标",
    "知识产权", "专利代理", "前端开发", "前端", "测试开发", "测试", "开发", "实施", "运维", "数据", "算法", "产品", "运营", "销售", "客服", "商务", "培训", "咨询", "律师", "法务",
    "翻译", "档案", "资料", "质检", "风电",
]

#: Words near a contact, and mail domains that are well known. Fixed values.
EMAIL_CONTEXT = ["邮箱", "邮件", "Email", "E-mail", "email", "mail", "联系方式", "联系"]
PHONE_CONTEXT = ["电话", "手机", "Tel", "TEL", "tel", "Phone", "phone", "联系方式", "联系"]
EMAIL_DOMAINS = ["com.cn", "edu.cn", "net.cn", "org.cn", "gov.cn", "qq.com", "163.com", "126.com", "gmail.com", "outlook.com", "hotmail.com", "foxmail.com", "icloud.com"]
NOT_A_PHONE = "(身份证|学号|编号|日期|生日|出生)"

#: Points of a degree in a student's competitiveness, by the first one named. Fixed values.
DEGREE_POINTS = [("博士", 18.0), ("硕士", 16.0), ("本科", 13.0), ("大专", 10.0), ("专科", 10.0), ("高中", 6.0)]

#: Words that put a job into a domain. Fixed values.
DOMAINS: dict[str, list[str]] = {
    "数据分析": ["数据分析", "SQL", "Excel", "Tableau", "Power BI", "A/B测试"],
    "人工智能": ["机器学习", "深度学习", "NLP", "推荐系统", "Python", "PyTorch", "TensorFlow"],
    "大数据工程": ["Spark", "Hadoop", "Hive", "Flink", "Kafka", "SQL"],
    "软件开发": ["Java", "Python", "C++", "Git", "Docker", "Kubernetes", "Redis"],
    "商业分析": ["数据分析", "A/B测试", "Excel", "Power BI", "沟通协作"],
}

#: Patterns and words of resumes. Fixed values.
RESUME_SKILLS = [
    ("C++", r"c\+\+"), ("Java", "java"), ("JavaScript", r"javascript|\bjs\b"), ("Oracle", "oracle"), ("Mysql", "mysql"), ("SQL", r"(?:\bsql\b|sql语句|sql语言)"), ("eclipse", "eclipse"),
    ("Linux", "linux"), ("Netty", "netty"), ("Dubbo", "dubbo"), ("Jquery", "jquery"), ("Bootstrap", "bootstrap"), ("SSH", "ssh"), ("C", r"(?:\bc\b|c语言)"),
]
RESUME_CERTIFICATES = [("大学英语六级", "(?:大学英语六级|英语六级|cet-?6)"), ("普通话二级甲等", "普通话二级甲等"), ("C1驾照", "(?:c1驾照|c1驾驶证)")]
RESUME_AWARDS = ["奖学金", "励志奖", "优秀", "一等奖", "二等奖", "三等奖", "国家励志"]
RESUME_DEGREES = ["博士研究生", "硕士研究生", "硕士", "本科", "大专", "专科", "中专"]
RESUME_SKILLS_BY_PATTERN = [(p, name) for name, p in RESUME_SKILLS]
RESUME_CERTIFICATES_BY_PATTERN = [(p, name) for name, p in RESUME_CERTIFICATES]

#: Standard names of students' majors, skills, certificates and directions with their aliases, and rules of tags. Fixed values.
STUDENT_MAJORS: dict[str, list[str]] = {
    "计算机科学与技术": ["计算机科学与技术", "计算机科学", "计算机技术", "计算机", "软件工程", "网络工程"],
    "数据科学与大数据技术": ["数据科学与大数据技术", "数据科学", "大数据", "数据技术", "人工智能与大数据"],
    "人工智能": ["人工智能", "智能科学与技术", "机器学习"],
    "统计学": ["统计学", "应用统计", "数理统计", "经济统计"],
    "信息管理与信息系统": ["信息管理与信息系统", "信管", "信息管理", "信息系统"],
    "电子信息工程": ["电子信息工程", "电子信息", "通信工程", "自动化"],
    "数学": ["数学与应用数学", "应用数学", "数学"],
    "金融学": ["金融学", "金融工程", "金融科技", "投资学"],
    "市场营销": ["市场营销", "营销管理", "电子商务", "工商管理"],
}
STUDENT_SKILLS: dict[str, list[str]] = {
    "Python": ["python", "py", "python3"], "Java": ["java", "java8", "java11", "jdk"], "C++": ["c++", "cpp"], "SQL": ["sql", "mysql", "postgresql", "oracle sql", "hive sql"],
    "机器学习": ["机器学习", "machine learning", "ml", "sklearn", "scikit-learn"], "深度学习": ["深度学习", "deep learning", "dl", "pytorch", "tensorflow"],
    "数据分析": ["数据分析", "数据处理", "数据清洗", "分析建模", "业务分析"], "数据可视化": ["可视化", "数据可视化", "图表分析", "dashboard"], "NLP": ["nlp", "自然语言处理", "文本挖掘"],
    "爬虫": ["爬虫", "web scraping", "scrapy", "requests", "beautifulsoup"], "Linux": ["linux", "shell", "bash"], "Git": ["git", "github", "gitlab"], "Excel": ["excel", "vlookup", "pivot", "数据透视表"],
    "Power BI": ["powerbi", "power bi", "bi 工具", "bi报表"], "Tableau": ["tableau"], "Spark": ["spark", "pyspark"], "Hadoop": ["hadoop", "hdfs", "mapreduce"], "Docker": ["docker", "容器化"],
    "Kubernetes": ["kubernetes", "k8s"], "HTML/CSS": ["html", "css", "html5", "css3"], "JavaScript": ["javascript", "js", "typescript", "ts"],
}
STUDENT_TOOLS = ["Excel", "Power BI", "Tableau", "Git", "Docker", "Kubernetes", "Linux", "Spark", "Hadoop"]
STUDENT_CERTIFICATES: dict[str, list[str]] = {
    "CET-4": ["cet-4", "cet4", "英语四级", "大学英语四级", "四级"], "CET-6": ["cet-6", "cet6", "英语六级", "大学英语六级", "六级"], "计算机二级": ["计算机二级", "全国计算机等级考试二级", "ncre二级"],
    "软考": ["软考", "软件设计师", "系统架构设计师", "信息系统项目管理师"], "教师资格证": ["教师资格证", "教资"], "CPA": ["cpa", "注册会计师"], "PMP": ["pmp", "项目管理专业人士"],
}
STUDENT_DIRECTIONS: dict[str, list[str]] = {
    "数据分析": ["数据分析", "数据分析师", "bi分析", "商业分析", "数据运营"], "算法工程": ["算法工程师", "机器学习工程师", "nlp算法", "推荐算法", "算法"],
    "后端开发": ["后端开发", "java开发", "python后端", "go后端", "服务端开发"], "前端开发": ["前端开发", "web前端", "前端工程师", "vue", "react"], "测试开发": ["测试开发", "软件测试", "自动化测试", "测试工程师"],
    "产品经理": ["产品经理", "数据产品", "ai产品", "产品助理"], "运维/DevOps": ["运维", "devops", "sre", "云平台运维"], "网络安全": ["网络安全", "安全工程师", "渗透测试", "安全运营"],
}
EXPERIENCE_WORDS: dict[str, list[str]] = {
    "数据处理": ["数据清洗", "数据处理", "etl", "报表", "sql", "分析"], "建模算法": ["模型", "机器学习", "深度学习", "预测", "分类", "推荐"], "工程开发": ["开发", "接口", "系统", "平台", "后端", "前端", "工程"],
    "科研实践": ["科研", "论文", "实验", "竞赛", "专利"], "业务协作": ["业务", "沟通", "需求", "协作", "运营"],
}

#: Resumes: headings of sections, words that end a company's name, words that name a position, labels inside descriptions,
#: levels of schools. Fixed values, in the order in which they are tried.
RESUME_HEADINGS: dict[str, list[str]] = {
    "education": ["教育经历", "教育背景", "学历背景", "学习经历"], "internship": ["实习经历", "工作经历", "实践经历", "校园经历"], "project": ["项目经历", "项目经验", "科研项目", "课程项目"],
    "skills": ["专业技能", "技能特长", "技能证书", "掌握技能", "语言能力", "计算机能力"], "awards": ["获奖情况", "荣誉奖项", "奖励荣誉"], "self_evaluation": ["自我评价", "个人总结", "个人优势"],
    "target_job": ["求职意向", "目标岗位", "应聘岗位", "目标职位", "意向岗位"],
}
RESUME_COMPANY_ENDS = ["有限责任公司", "股份有限公司", "有限公司", "集团", "科技", "网络", "软件", "信息技术", "研究院", "工作室", "银行", "中心"]
RESUME_POSITIONS = [
    "高级软件工程师", "软件研发工程师", "后端开发工程师", "前端开发工程师", "Java工程师", "Java开发工程师", "Python工程师", "数据分析师", "产品经理", "测试工程师", "开发工程师", "软件工程师", "前端工程师", "后端工程师",
    "算法工程师", "运维工程师", "实施工程师", "销售工程师", "运营专员", "运营助理", "产品助理", "技术助理", "研究助理", "工程师", "实习生", "助理", "专员",
]
RESUME_LABELS = ["开发环境：", "项目描述：", "项目介绍：", "责任描述：", "职责描述：", "语言能力：", "计算机能力：", "其他能力：", "毕业设计"]
RESUME_SCHOOL_LEVELS = [("985", r"(?<!\d)985(?!\d)|九八五"), ("211", r"(?<!\d)211(?!\d)|二一一"), ("双一流", "双一流|一流大学|一流学科"), ("一本", "一本|本科一批"), ("二本", "二本|本科二批")]
RESUME_PROJECT_HEADINGS = ["项目经历", "项目经验", "科研项目", "课程项目"]

#: Gaps between a student and a job: what to do about each type, with the words for an unnamed item. Fixed values.
GAP_HINTS = {
    "hard_skills": ("围绕 {} 补充系统学习和项目实践，并在简历中补充应用场景与成果。", "岗位核心硬技能"),
    "tool_skills": ("补充 {} 的实操案例，例如分析看板、数据处理脚本或作品集。", "岗位工具栈"),
    "practice_experience": ("围绕“{}”补充课程项目、实习任务或业务场景复盘。", "岗位实践要求"),
    "soft_skills": ("在项目和实习经历中补充 {} 的行为证据与协作成果。", "关键软技能"),
    "certificates": ("如岗位确实重视 {}，可规划短期备考或补充替代性证明材料。", "相关证书"),
    "education": ("若学历/专业背景不完全匹配，建议通过相关课程、项目、证书或竞赛提升岗位方向背书。", ""),
    "major": ("若学历/专业背景不完全匹配，建议通过相关课程、项目、证书或竞赛提升岗位方向背书。", ""),
}
GAP_HINT_OTHER = "结合岗位要求补充可量化的学习成果、项目经验和简历表达证据。"
GAP_STATUS = {"hard_skills": "学生侧尚未形成稳定技能证据", "tool_skills": "学生侧尚未形成稳定工具使用证据"}
GAP_WEAKNESS_HINT = "将该短板拆成可执行训练任务，并补充可量化成果或项目证明。"
GAP_DIMENSION_STATUS, GAP_DIMENSION_HINT = "学生画像仍缺少{}相关证据", "优先补充该维度的信息、经历或作品材料，以便提升后续匹配和报告质量。"

#: What is said of a degree, a major and certificates at each level of risk. Fixed values.
HARD_INFO_MESSAGES = {
    "degree": {"high_match": "学历达到岗位主流要求，学历风险较低。", "risk": "学历可满足部分企业要求，但仍存在更高学历样本，建议用项目和技能增强竞争力。", "no_match": "学历暂未覆盖岗位样本中的主流要求，存在明显风险。"},
    "major": {"high_match": "专业属于岗位主流相关方向，专业匹配风险较低。", "risk": "专业与岗位存在一定相关性，但不是最主流要求，建议用项目经历强化方向证明。", "no_match": "专业与岗位主流要求重合较弱，存在明显专业匹配风险。"},
    "certificate": {"high_match": "证书项满足岗位要求或岗位证书硬性要求较弱。", "risk": "没有触发强制证书风险，但建议补充岗位高频偏好证书提升竞争力。", "no_match": "缺少岗位高频强制证书，证书项存在明显风险。"},
}
#: Ranks of degrees where a student is compared with a job; other labels have none.
COMPARED_DEGREE_RANK = {"学历不限": 0, "高中/中专": 1, "高中": 1, "中专": 1, "大专": 2, "专科": 2, "本科": 3, "硕士": 4, "研究生": 4, "博士": 5}

#: What a question is about: class, confidence, domain of data, whether SQL, the graph of paths or documents are asked, and its
#: words; the first class with a word in the question holds. Words with capitals stand as they are. Fixed values.
INTENTS = [
    ("career_path_question", 0.92, "path_graph", "path", ["路径图谱", "岗位路径", "职业路径", "晋升", "转岗", "promote_to", "transfer_to", "图谱关系"]),
    ("report_question", 0.86, "report_state", "", ["报告", "总结", "行动计划", "职业建议", "结论", "规划建议"]),
    ("match_explanation", 0.88, "job_match_state", "", ["为什么推荐", "为什么不匹配", "匹配", "风险", "覆盖率", "赛题评测", "硬门槛", "最推荐"]),
    ("student_profile_question", 0.86, "student_profile_state", "", ["我的学历", "我的专业", "我的技能", "我的证书", "我的项目", "我的实习", "学生画像", "个人画像", "我会什么"]),
    ("job_requirement_question", 0.84, "semantic_job_knowledge", "semantic", ["岗位要求", "学历要求", "专业要求", "证书要求", "技能要求", "学历", "专业", "证书", "知识点", "需要什么", "要求是什么"]),
    ("company_search", 0.9, "sql_market", "sql", ["公司", "企业", "厂", "投递清单", "投递公司"]),
    ("salary_search", 0.88, "sql_market", "sql", ["薪资", "工资", "收入", "月薪", "待遇", "k", "K", "万", "高薪"]),
    ("industry_search", 0.82, "sql_market", "sql", ["行业", "领域", "产业"]),
]
CITY_QUESTION = ["城市", "地区", "地点", "北京", "上海", "广州", "深圳", "杭州", "成都", "南京", "苏州", "武汉"]
MARKET_WORDS = ["有哪些", "哪些", "查询", "筛选", "多少", "分布", "样本", "机会", "岗位"]
CITIES = ["北京", "上海", "广州", "深圳", "杭州", "苏州", "南京", "成都", "武汉", "西安", "重庆", "天津", "长沙", "郑州", "青岛", "厦门", "宁波", "福州", "东莞", "佛山", "珠海", "哈尔滨"]
CITY_NAME = r"([\x{4e00}-\x{9fff}]{2,12}(?:市|省|自治区|特别行政区|自治州|地区|盟|县|区))"
SALARY_WORDS = ["薪资", "工资", "收入", "月薪", "k", "K", "w", "W", "万"]
JOB_WORDS = ["java", "python", "golang", "c++", "前端", "后端", "测试", "运维", "算法", "数据", "产品", "安卓", "android", "ios"]
JOB_NAME = r"([\x{4e00}-\x{9fff}A-Za-z0-9+#/]{2,20}(?:开发|测试|工程师|运维|算法|产品))"

#: Words that put a student into a domain, domains of majors, and dimensions that a profile's weaknesses speak of. Fixed values.
STUDENT_DOMAINS: dict[str, list[str]] = {
    "数据智能": ["数据分析", "机器学习", "深度学习", "NLP", "Power BI", "Tableau", "Spark", "Hadoop"],
    "软件研发": ["Java", "Python", "C++", "HTML/CSS", "JavaScript", "Git", "Docker", "Kubernetes"],
    "商业分析": ["数据分析", "Excel", "Power BI", "Tableau", "SQL"],
    "人工智能": ["机器学习", "深度学习", "NLP", "Python"],
    "云计算/大数据": ["Spark", "Hadoop", "Docker", "Kubernetes", "Linux", "SQL"],
}
MAJOR_DOMAINS = [("信息技术", ["计算机科学与技术", "软件工程", "人工智能", "数据科学与大数据技术"]), ("数理分析", ["统计学", "数学"]), ("商业管理", ["金融学", "市场营销"])]
MISSING_DIMENSIONS = [
    ("核心技能/工具栈", ["技能", "工具"]), ("项目经历", ["项目"]), ("实习经历", ["实习"]), ("证书/竞赛背书", ["证书", "获奖"]), ("求职方向明确度", ["求职意向", "职业方向"]), ("教育背景完整度", ["教育", "学历", "专业"]),
]
