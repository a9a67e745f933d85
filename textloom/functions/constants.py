"""Fixed values of the text, typing and scoring rules, and regular-expression pieces valid in Java and in RE2."""

from __future__ import annotations

# Token and sentence rules.
STOPWORDS = (
    "的", "了", "和", "与", "及", "在", "对", "是", "把", "将", "用", "从", "看", "再", "又", "按", "上", "下", "中", "后", "前",
    "研究", "专题", "方法", "策略", "系列", "一个", "我们", "你", "我", "他", "她", "它", "以及", "关于", "如何", "为什么", "什么",
    "哪些", "这种", "这个", "那个", "进行", "问题", "分析", "实战", "框架", "系统", "模型",
)
NOISE_TOKENS = (
    "title", "type", "source", "created", "updated", "status", "confidence", "related", "tags", "raw", "sources", "guide", "topic", "wiki",
    "markdown", "http", "https", "com", "www", "作者", "链接", "原文", "公众号", "阅读", "点击", "本文", "文中", "内容", "整理", "草稿", "待补充",
)
NOISE_WORDS = ("section", "candidate", "reason", "score", "yes", "no")
NOISE_FIELDS = ("title", "type", "source", "created", "updated", "status", "confidence", "related", "tags")
NOISE_INSIDE = ("我们", "你", "我", "在", "与", "及", "的", "了", "和")
SENTENCE_HEADS = ("raw sources", "最后更新", "来源批次", "当前 related", "当前主题", "该页由一批 raw 资料自动聚合生成")
SENTENCE_FIELDS = ("title:", "type:", "source:", "tags:", "related:")
KEY_SUFFIXES = (("专题", "系列", "方法论", "框架", "实战", "研究"), ("入门", "详解", "拆解", "笔记", "综述"))
NEGATIVE = ("不", "无", "未", "不能", "避免", "风险", "失效", "下降", "回撤")
POSITIVE = ("可", "能够", "适合", "有效", "优势", "增强", "提升", "改善", "稳健")
VERIFY_MARKS = ("环境异常", "完成验证后即可继续访问", "去验证")
BACKLINK_SECTIONS = ("## 与其他知识的关联", "## 关联", "## 相关知识", "## 延伸阅读")
NO_SECTION = "无明确关联章节"
UNSORTED = "未分类主题"
UNKNOWN = "unknown"
MIN_BODY = 100

# Page types.
TYPES = ("guide", "topic", "strategy", "concept", "paper")
TYPE_KEYWORDS = {
    "strategy": ("策略", "交易", "信号", "参数", "回测", "品种", "择时", "仓位"),
    "concept": ("概念", "定义", "机制", "原理", "边界", "误区", "本质", "解释"),
    "paper": ("paper", "论文", "文献", "研究", "作者", "样本", "结论", "局限", "启发"),
    "topic": ("专题", "主题", "综述", "系列", "汇总", "框架", "脉络", "共识"),
    "guide": ("指南", "入门", "guide", "手册", "清单", "流程", "步骤"),
}
TITLE_MARKS = {
    "paper": ("paper", "论文", "研报"),
    "strategy": ("策略", "信号", "系统"),
    "concept": ("概念", "定义", "机制", "原理"),
    "topic": ("专题", "综述", "系列", "框架"),
    "guide": ("入门", "指南", "guide"),
}
SOURCE_BONUS = {"report": "paper", "pdf": "paper", "note": "concept", "wechat": "topic"}
TYPE_MATCH = {
    "guide": {"guide": 2, "topic": 2, "concept": 1},
    "topic": {"topic": 3, "concept": 2, "guide": 1, "paper": 1},
    "strategy": {"strategy": 3, "topic": 2, "concept": 2},
    "concept": {"concept": 3, "topic": 2, "strategy": 1, "paper": 1, "guide": 1},
    "paper": {"paper": 3, "topic": 2, "concept": 2},
}
TYPE_SUFFIX = {"guide": "指南", "topic": "专题", "strategy": "策略", "concept": "概念", "paper": "论文笔记"}
TITLE_ENDS = ("指南", "专题", "策略", "概念", "论文笔记", "研究", "框架", "方法")
SECTION_KEYWORDS = {
    "strategy": {
        "核心逻辑": ("核心", "逻辑", "基于", "策略", "框架"),
        "信号结构": ("信号", "条件", "触发", "入场", "出场"),
        "适用品种": ("品种", "适用", "合约", "标的"),
        "参数": ("参数", "周期", "窗口", "阈值", "倍数"),
        "风险": ("风险", "回撤", "止损", "杠杆", "风控"),
    },
    "concept": {
        "定义": ("定义", "指", "即", "就是", "指的是", "概念"),
        "机制": ("机制", "过程", "如何", "通过", "影响"),
        "边界": ("边界", "局限", "条件", "注意", "限制", "仅当"),
        "常见误区": ("误区", "误解", "不是", "不同于", "切忌"),
    },
    "paper": {
        "研究问题": ("提出", "研究", "问题", "目标", "旨在", "探索"),
        "方法": ("方法", "模型", "采用", "使用", "利用", "算法"),
        "结论": ("结论", "发现", "结果表明", "因此", "验证"),
        "局限": ("局限", "不足", "未能", "挑战", "改进"),
        "启发": ("启发", "启示", "参考", "借鉴", "价值"),
    },
    "guide": {
        "使用路径": ("步骤", "流程", "路径", "顺序", "阶段"),
        "推荐阅读顺序": ("推荐", "建议", "先", "后", "阅读"),
        "落地步骤": ("实施", "落地", "部署", "配置", "操作"),
    },
}
SECTION_ORDER = {
    "guide": ("使用路径", "推荐阅读顺序", "落地步骤"),
    "strategy": ("核心逻辑", "信号结构", "适用品种", "风险", "参数"),
    "concept": ("定义", "机制", "边界", "常见误区"),
    "paper": ("研究问题", "方法", "结论", "局限", "启发"),
    "topic": (),
}

# White space as in Unicode, white space within a line, characters that end a line.
WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)
IN_LINE_WS = r"[ \t\x1F\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
LINE_ENDS = r"[\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
TRIM = f"^{WS}+|{WS}+$"
TOKEN = r"[A-Za-z][A-Za-z0-9+\-]+|[\x{4E00}-\x{9FFF}]{2,}"
WORD_END = r"^[^\pL\pN_]+|[^\pL\pN_]+$"
WIKILINK = r"\[\[([^\]]+)\]\]"
_H = IN_LINE_WS
NOISE_LINE = (
    rf"^{_H}*(?:(?:{'|'.join(NOISE_FIELDS)}):[^\n]*|\*\*raw sources\*\*:?{_H}*|raw{_H}+sources{_H}*:?{_H}*|https?://{NOT_WS}+{_H}*"
    rf"|\[[^\]\n]+\]\([^\)\n]+\){_H}*|[-*]{_H}*`[^`\n]+`{_H}*)$"
)
NOISE_SET = (*STOPWORDS, *NOISE_TOKENS, *NOISE_WORDS)
NOISE_SHAPE = r"^(?:.?|\pN+|[0-9]{4}[-/]?[0-9]{1,2}(?:[-/]?[0-9]{1,2})?|.{0,10}md|.{0,8}html|.{0,8}json|[\x{4E00}-\x{9FFF}]{7,})$"
NOISE_PART = "|".join(NOISE_INSIDE)
NOISE_HEAD = rf"^(?:{'|'.join(SENTENCE_HEADS)})"
FIELD_HEAD = rf"^(?:{'|'.join(SENTENCE_FIELDS)})"
SENTENCE_EDGE = r"^[ \-#*`\t\r\n]+|[ \-#*`\t\r\n]+$"
CANONICAL_NAME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}_.*\.md$"

# The wording of the explanation of a page type.
HIT_WORD, HIT_TITLE, HIT_SOURCE, HIT_TAGS = "关键词[{}]+2", "标题特征[{}]+4", "来源类型[{}]+1", "标签推断[已有页统计]+"
BREAKDOWN, POINTS, NO_HIT, BEST_TYPE, LEAD = "### 各类型得分详情", " 分  →  ", "无命中", "- 最佳类型: ", " (与第2名分差: "
NO_SCORE = "所有类型得分均为0，选择默认 [guide, topic]"
