"""Word lists of the retrieval rules. Every rule takes its list as a parameter; these are the defaults."""

# Region names as written, and their short form, in the order in which they are tried.
REGIONS = [("深圳市", "深圳"), ("深圳", "深圳"), ("广东省", "广东"), ("广东", "广东"), ("河南省", "河南"), ("河南", "河南"), ("湖北省", "湖北"), ("湖北", "湖北"), ("四川省", "四川"), ("四川", "四川"), ("陕西省", "陕西"), ("陕西", "陕西"), ("北京市", "北京"), ("北京", "北京"), ("天津市", "天津"), ("天津", "天津"), ("西藏自治区", "西藏"), ("西藏", "西藏"), ("吉林省", "吉林"), ("吉林", "吉林"), ("云南省", "云南"), ("云南", "云南")]
# Hazards.
HAZARDS = [("气象灾害", "气象灾害"), ("台风", "台风"), ("热带气旋", "台风"), ("暴雨", "暴雨"), ("洪涝", "洪涝"), ("洪水", "洪涝"), ("山洪", "山洪"), ("地震", "地震"), ("震灾", "地震"), ("滑坡", "地质灾害"), ("泥石流", "地质灾害"), ("地质灾害", "地质灾害"), ("大雾", "气象灾害"), ("暴雪", "气象灾害"), ("寒潮", "气象灾害")]
# Kinds of document.
DOCUMENT_KINDS = ["预案", "规划", "报告", "公报", "通知", "规范", "办法", "指南", "案例"]
# The shorter lists that the filter hints use.
FILTER_REGIONS = ["深圳", "广东", "河南", "湖北", "四川", "陕西", "北京", "天津", "西藏", "吉林", "云南"]
FILTER_HAZARDS = ["台风", "暴雨", "洪涝", "地震", "山洪", "地质灾害", "气象灾害"]
FILTER_KINDS = ["预案", "规划", "报告", "公报", "通知", "规范", "办法"]
# Words that tell the kind of a query.
SCENARIO = ["怎么办", "怎么做", "如何", "怎么处置", "如何处置", "怎么避险", "如何避险", "撤离", "疏散", "应采取", "措施", "救援"]
KEYWORD = ["第", "条", "章", "附件", "附录", "标准", "阈值", "启动条件", "文件", "规定"]
MULTI_HOP = ["分别", "对比", "比较", "同时", "以及", "和", "与", "哪些部门", "跨", "综合"]
QUANTITY = ["损失", "震级", "级以上", "人数", "比例"]
TERMS = ["应急响应", "启动", "疏散", "避险", "损失", "学校", "居民", "高层建筑"]
EXACT_MARKERS = ["第", "条", "章", "附件", "附录"]
# Patterns of response levels, years, articles and numbers.
LEVEL = r"(?i)(?:iv|iii|ii|i|ⅳ|ⅲ|ⅱ|ⅰ|一|二|三|四|1|2|3|4)\s*级"
YEAR = r"(?<!\d)(?:19|20)\d{2}\s*年?"
ARTICLE = r"第\s*[一二三四五六七八九十百千万\d]+\s*[章节条款]"
NUMBER = r"\d+(?:\.\d+)?"
# Expansions of a query.
HAZARD_MORE = {"台风": ["台风", "热带气旋", "防御措施", "应急处置"], "暴雨": ["暴雨", "洪涝", "防汛", "应急处置"], "洪涝": ["洪涝", "洪水", "防汛", "转移避险"], "地震": ["地震", "震灾", "疏散", "避险"], "地质灾害": ["地质灾害", "滑坡", "泥石流", "避险转移"], "山洪": ["山洪", "洪涝", "转移避险", "预警"], "气象灾害": ["气象灾害", "预警", "应急响应", "防御措施"]}
REGION_MORE = {"深圳": ["深圳", "深圳市"], "广东": ["广东", "广东省"], "河南": ["河南", "河南省"], "湖北": ["湖北", "湖北省"], "四川": ["四川", "四川省"], "陕西": ["陕西", "陕西省"], "北京": ["北京", "北京市"], "天津": ["天津", "天津市"], "西藏": ["西藏", "西藏自治区"], "吉林": ["吉林", "吉林省"], "云南": ["云南", "云南省"]}
SUBJECT_MORE = {"学校": ["学校", "师生", "停课", "安全管理"], "居民": ["居民", "群众", "转移安置"], "高层": ["高层建筑", "居民", "疏散", "避险"], "高层建筑": ["高层建筑", "居民", "疏散", "避险"], "房屋": ["房屋", "建筑", "风险排查"], "企业": ["企业", "生产", "应急处置"]}
INTENT_MORE = {"怎么办": ["应急处置", "防御措施", "避险", "转移安置"], "怎么做": ["应急处置", "防御措施", "职责", "措施"], "如何": ["如何", "措施", "流程", "要求"], "疏散": ["疏散", "撤离", "避险", "转移安置"], "撤离": ["撤离", "疏散", "避险", "转移安置"], "避险": ["避险", "转移", "安置", "预警"]}
TYPE_MORE = {"scenario": ["应急预案", "响应流程", "责任主体"], "multi_hop": ["综合评估", "部门职责", "处置流程"], "ambiguous": ["预警", "应急处置", "防灾减灾"]}
# What the knowledge base covers, and what it doesn't.
DOMAIN = ["灾害", "灾情", "防灾", "减灾", "救灾", "救助", "应急", "预警", "应急响应", "预案", "救援", "疏散", "撤离", "避险", "安置", "抢险", "风险普查", "指挥体系", "灾后重建", "台风", "暴雨", "洪水", "洪涝", "山洪", "地震", "滑坡", "泥石流", "寒潮", "暴雪"]
DOMAIN_PATTERNS = [r"(?i)(?:Ⅰ|Ⅱ|Ⅲ|Ⅳ|Ⅴ|I|II|III|IV|V|一|二|三|四|五)级(?:应急)?响应", r"第[一二三四五六七八九十百0-9]+条"]
OUTSIDE = ["Transformer", "稀疏注意力", "4K视频", "剪辑电脑", "糖尿病", "胰岛素", "量化交易", "套利", "量子计算", "表面码", "法式可颂", "新能源汽车股票", "Java虚拟机", "垃圾回收器", "围棋强化学习", "黑洞", "分布式数据库", "计算机博士", "增肌饮食", "摄影", "景深", "NTFS", "现代诗", "CUDA", "矩阵乘法", "科幻电影", "电商平台", "优惠券", "蛋白质折叠"]
# Statements that need a citation, and lines that are structure.
POLICY_FACT = r"(?i)(?:(?:Ⅰ|Ⅱ|Ⅲ|Ⅳ|Ⅴ|I|II|III|IV|V|一|二|三|四|五)级(?:应急)?响应|\d{4}年(?:\d{1,2}月(?:\d{1,2}日)?)?|第[一二三四五六七八九十百0-9]+条|\d+(?:\.\d+)?\s*(?:%|％|人|户|万元|亿元|小时|分钟|毫米|级以上))"
STRUCTURE = r"^(?:#{1,6}\s+|[-*+]\s*(?:\*{0,2})?$|\d+[.、)]\s*$)"
POLICY_TERMS = ["应", "必须", "不得", "启动", "响应", "预警", "组织", "决定", "负责", "报告"]
# Sentences and labels of template answers.
NO_ANSWER = "当前知识库没有足够依据回答该问题。"
HEADER = "根据知识库检索结果，可以这样处理："
LOW_HEADER = "当前知识库未覆盖该问题，以下为一般建议："
EMPTY_SNIPPET = "知识库片段为空。"
SOURCES = "来源："
LABELS = ["处置建议", "启动条件或责任主体", "注意事项", "补充依据"]
LABELS_WHO = ["启动条件或责任主体", "处置建议", "注意事项", "补充依据"]
LABELS_SOURCE = ["政策依据", "适用范围", "关键条款", "补充依据"]
ASK_WHO = ["谁", "哪个部门", "哪级", "启动"]
ASK_SOURCE = ["来源", "依据", "文件", "规定"]
# Query policy by type: rewrite, multi, rerank, mmr, dense, sparse, rerank depth, branches.
POLICY = {"keyword": (False, False, False, False, 30, 40, 20, 2), "exact_fact": (False, False, False, False, 30, 40, 20, 2), "scenario": (True, True, True, True, 35, 30, 30, 3), "multi_hop": (True, True, True, True, 40, 35, 35, 3), "ambiguous": (True, True, True, False, 30, 30, 25, 2)}
CONFIDENCE = {"keyword": 0.86, "exact_fact": 0.88, "scenario": 0.78, "multi_hop": 0.72, "ambiguous": 0.45}
WEIGHTS = {"raw": 1.0, "normalized": 0.9, "expanded": 0.7, "hyde": 0.6}
# Marks of a bibliography line.
REFERENCE_MARKS = ["doi", "journal", "press", "出版社", "学报", "vol.", "no."]
# Patterns of the line types, in the order in which they are tried: table, bibliography, contents, list.
TABLE_LINE = r"^\|.*\|$"
REFERENCE_HEAD = r"(?i)^(参考文献|references?)\s*[:：]?\s*$"
REFERENCE_LINE = r"^\s*(?:\[\d+\]|\d+[.)、])\s*.+"
CONTENTS_LINES = [r"^\s*[-—]?\s*\d{1,4}\s*[-—]?\s*$", r"\.{2,}\s*\d+\s*$", r"^\s*\d+(?:\.\d+)*\s+.{2,40}\s+\d{1,4}\s*$"]
LIST_LINE = r"^\s*(?:[-*+]\s+|\d+[.)、]\s+|[（(]?[一二三四五六七八九十]+[）)]\s*|[①②③④⑤⑥⑦⑧⑨⑩]\s*)"
# What goes when file names are matched in a query.
MATCH_DROP = r"[\s\-_—–·•,，。；：:（）()《》“”\"'`]+"
# Parts of the hypothetical texts; region, hazard and terms go between them.
HYDE_SHORT = ["发生", "风险时，应查询应急预案中关于", "的规定，重点关注预警发布、应急响应启动、人员疏散转移、临时安置和部门职责等政策段落。"]
HYDE_LONG = ["针对用户描述的", "处置场景，应检索应急预案和防灾减灾文件中关于", "的内容，包括风险研判、预警响应、学校或居民避险、转移安置、救援协同和责任主体。"]
HYDE_HAZARD, HYDE_REGION, HYDE_AREA, HYDE_TERMS = "灾害", "相关地区", "地区", "预警、响应、处置、避险"
