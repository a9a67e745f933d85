"""Problem 5: template residue, filler, error pages and script notices."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._text import fold_str, slices

# Phrases by kind, folded. A phrase of kind frame counts only beside a placeholder.
PHRASES = {
    "error": (
        "404 not found", "403 forbidden", "500 internal server error", "internal server error", "502 bad gateway", "bad gateway", "503 service unavailable",
        "service unavailable", "504 gateway time-out", "504 gateway timeout", "gateway time-out", "gateway timeout", "page not found", "this page could not be found",
        "the requested url was not found on this server", "you don't have permission to view this resource", "you don't have permission to access", "access denied",
        "request blocked", "please try again in a few minutes", "please try again later", "error: upstream prematurely closed connection", "upstream prematurely closed connection",
        "too many requests", "connection timed out", "connection refused", "server error in", "an error occurred while processing your request", "this site can't be reached", "nginx/",
        "request id:", "error code:", "http error", "http 4", "http 5", "apache/",
        "环境异常", "当前环境异常", "完成验证后即可继续访问", "去验证", "返回上一页", "返回首页", "请返回首页或刷新后重试", "刷新后重试", "点击重新加载", "轻触查看原因", "错误码", "如有疑问请联系管理员",
        "您的访问请求已被安全策略拦截", "已被安全策略拦截", "该内容已被发布者删除", "此内容已被发布者删除", "内容已被删除", "无法访问此页面", "系统繁忙", "请稍后再试", "请稍后重试", "访问过于频繁", "参数错误",
        "未登录或登录状态已失效", "登录状态已失效", "验证码已失效", "验证码错误", "链接已过期", "该页面涉嫌违规", "暂停展示", "此帐号已自主注销", "内容无法查看", "此内容因违规无法查看", "服务器开小差了", "页面走丢了",
        "页面不存在", "您访问的页面不存在", "服务器错误", "服务器内部错误", "请求超时", "网络异常", "网络不给力", "时间:", "该公众号已迁移", "此账号已被屏蔽",
    ),
    "script": (
        "you need to enable javascript to run this app", "please turn on javascript and reload the page", "please enable javascript", "enable javascript to continue", "javascript is disabled",
        "javascript is required", "this site works only with scripting switched on", "enable cookies and scripts to view this content", "this page requires javascript", "your browser does not support javascript", "noscript",
        "请启用 javascript 后继续浏览", "请启用 javascript", "请开启 javascript", "检测到脚本未运行", "正文无法加载", "本页面需要脚本支持", "您的浏览器已禁用脚本", "浏览器版本过低", "请升级后打开", "加载中,请稍候",
        "若长时间无响应请允许脚本运行", "请允许脚本运行", "内容需在客户端渲染", "请开启脚本",
    ),
    "filler": (
        "lorem ipsum dolor sit amet", "consectetur adipiscing elit", "sed do eiusmod tempor incididunt", "ut labore et dolore magna aliqua", "ut enim ad minim veniam", "quis nostrud exercitation",
        "duis aute irure dolor", "excepteur sint occaecat", "your text goes here", "replace this paragraph with real copy", "this is placeholder text", "insert text here", "the quick brown fox jumps over the lazy dog", "asdf asdf", "test test test",
        "测试测试测试测试", "随便写点什么占个位置", "这里是示例文字", "请替换为正式内容", "段落内容段落内容", "此处放置正文", "这是一段占位文本", "用于查看排版效果", "内容待填", "版式预览用", "啊啊啊啊", "测一下换行",
        "请在此输入文章内容", "字数不限", "请在此输入", "此处输入内容", "示例文本示例文本", "占位文字", "正文正文正文",
    ),
    "blank": (
        "[object object]", "undefined", "nan-nan-nan", "点击量:null", "标题:undefined", "[图片占位]", "[图片说明占位]", "(数据待核)", "todo 补图补数据", "日期:nan",
    ),
    "frame": (
        "亲爱的", "你好!以下是本期内容", "dear ", "thank you for reading issue", "thank you for reading", "原文链接", "导语", "配图", "正文从这里开始", "section:", "来源", "日期", "标题", "作者", "摘要", "期数", "hello ", "尊敬的",
    ),
}
# The words that placeholder Latin is drawn from. Marked words are hardly met elsewhere; the others only count beside them.
LATIN_MARKS = frozenset(
    "lorem ipsum dolor amet consectetur consectetuer adipiscing adipisicing elit eiusmod tempor incididunt labore dolore magna aliqua aliquam enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure "
    "reprehenderit voluptate velit esse cillum fugiat pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit laborum vestibulum pellentesque curabitur mauris phasellus vivamus sapien tincidunt praesent suspendisse "
    "ullamcorper malesuada fermentum sollicitudin vulputate condimentum faucibus ultrices posuere cubilia habitant morbi tristique senectus netus egestas volutpat tellus turpis euismod lobortis feugiat dignissim blandit luptatum zzril delenit augue".split()
)
LATIN_OTHERS = frozenset("sit sed do ut et ad ex ea in eu non qui id est nulla anim nunc ac at vel nec eget ante mi leo diam justo cras nam donec proin integer aenean maecenas quam orci porta urna".split())
#: Words and different marked words that a segment of placeholder Latin has at least.
LATIN_WORDS, LATIN_DIFFERENT = 3, 2
# Forms of a field that a template engine left unfilled.
PLACEHOLDER = re.compile(
    r"\{\{\{?[^{}\n]{1,40}\}?\}\}|[$#@]\{[^{}\n]{1,40}\}|<%[=-]?[^%\n]{1,40}%>|\{%[^%\n]{1,40}%\}|__[a-z一-鿿][a-z_一-鿿]{0,30}?__(?:待定)?|@@[a-z_一-鿿]{1,30}@@"
    r"|[【\[](?:此处|请)(?:插入|填写|填入|输入)[^】\]\n]{0,30}[】\]]|%(?=[a-z_]*[a-z]{3})[a-z_]{3,30}%|%[一-鿿]{2,6}%|<(?:[a-z]+_[a-z_]+|title|author|summary|cover|count|nickname|date|[一-鿿]{2,6})>"
    r"|_{2,}[年月日万%]|_{4,}"
)
#: Words of a sentence that speaks about a placeholder instead of leaving one.
MENTION = re.compile(r"模板里|模板中|变量|脚本中|正则|占位符|stands for|in the template|placeholder|variable|regex|template engine|render\(|printf|默认值|替换成|单元测试|配置项|语法|ctx\)")
# Words without which none of the general forms below can match; they only call for a look at their segment.
HINTS = (
    "javascript", "script", " js ", "脚本", "not found", "exist", "error", "denied", "forbidden", "unavailable", "not available", "no longer available", "removed", "deleted", "timed out", "went wrong", "try again", "be found", "failed to load",
    "不存在", "删除", "下架", "屏蔽", "失败", "无法", "找不到", "权限", "维护", "繁忙", "出错", "超时", "失效", "不可用", "待定", "待补", "待填", "xxx", "tbd", "tba", "text here", "content here", "copy here", "title here", "dummy text", "sample text", "filler text", "此处", "这里添加", "某某",
)
#: General forms of a notice that makes up its segment, from the segment's start, by kind.
FORMS = {
    "script": re.compile(
        r"(?:(?:sorry|note|notice|warning|error)\b[,:!. ]*)?(?:please |kindly |you (?:need|have|must) (?:to )?|to (?:use|view|see|continue|access|read)[^.\n]{0,40}?,? ?)+(?:enable|re-enable|switch|turn|allow|activate|permit)\b[^.\n]{0,25}?\b(?:javascript|scripts?|scripting|js)\b[^.\n]{0,70}"
        r"|(?:this|the|our) (?:site|website|web site|page|app|application|content|service|feature)[^.\n]{0,30}\b(?:requires?|needs?|depends on|works? only with)\b[^.\n]{0,20}\b(?:javascript|scripts?|scripting)\b[^.\n]{0,60}"
        r"|(?:it (?:looks like|seems) )?(?:your browser[^.\n]{0,40})?\b(?:javascript|scripts?)\b[^.\n]{0,20}\b(?:is|are|has been|have been)?\s?(?:disabled|blocked|not (?:enabled|supported|available)|turned off|switched off)[^.\n]{0,70}"
        r"|(?:检测到|提示|抱歉|对不起|注意)?[,: ]*(?:您的|你的|当前)?浏览器[^。\n]{0,8}(?:不支持|禁用了?|关闭了?|未开启|未启用|屏蔽了?)[^。\n]{0,4}(?:javascript|脚本|js)[^。\n]{0,24}"
        r"|[^。,，\n]{0,14}[,，]?(?:请|需要?|须)(?:您|你|先)?(?:在[^。,\n]{0,8})?(?:启用|开启|打开|允许)[^。\n]{0,6}(?:javascript|脚本|js)[^。\n]{0,24}"
    ),
    "error": re.compile(
        r"(?:(?:sorry|oops|whoops|error|we(?:'re| are) sorry)\b[,:!. ]*)?(?:but )?(?:the |this |that |your )?(?:requested |web ?)?(?:page|content|article|post|resource|url|link|file|site|website|server|service|request|account|address)\b[^.\n]{0,45}?"
        r"(?:(?:could|can)(?:n't| ?not) be (?:found|loaded|displayed|completed|processed|reached)|(?:was|were) not found|not found|does(?:n't| not) exist|(?:is|are) (?:currently |temporarily |no longer )?(?:unavailable|not available|available)(?! (?:in|for|from|at|on|with|to))|has been (?:removed|deleted|denied|blocked|moved)|encountered an? [^.\n]{0,30}?error|timed out|failed to load|is (?:down|under maintenance))[^.\n]{0,60}"
        r"|(?:http )?(?:error )?(?:code )?[45]\d\d\b[\s:.\-]*[^.\n]{0,50}"
        r"|(?:access|permission)(?: to [^.\n]{0,40}?)? ?(?:has been |is |was )?(?:denied|forbidden|blocked|restricted)[^.\n]{0,40}"
        r"|(?:oops|sorry)?[,!. ]*(?:something went wrong|an? (?:unexpected |internal |unknown |server |application )*error (?:has )?occurred)[^.\n]{0,50}"
        r"|(?:please )?(?:refresh|reload|retry|try again|check your (?:network|connection|internet)|go back to the home)[^.\n]{0,50}"
        r"|(?:抱歉|对不起|很遗憾|温馨提示|提示|出错了)?[,:!。 ]*(?:您?所?(?:访问|请求|查看|浏览|打开)的)?(?:该|此|本|当前|这个)?(?:页面|内容|文章|本文|网页|网站|站点|链接|资源|图文|帖子|视频|账号|公众号|服务|系统|服务器|本文)(?:已经?|暂时|正在|目前|被|可能|因[^。\n]{0,12}?)*(?:不存在|(?:作者|发布者|发布人|管理员|平台)?(?:自行)?(?:删除|下架|屏蔽|移除|封禁)|无法(?:找到|访问|显示|打开|查看|加载)|加载失败|打开失败|访问失败|找不到了?|失效|过期|维护中?|升级中?|繁忙|出错了?|出现异常|发生错误|超时|不可用)[^。\n]{0,24}"
        r"|(?:抱歉|对不起)?[,: ]*(?:您|你)?(?:没有|暂无|无)(?:访问|查看|浏览|阅读|操作)?权限[^。\n]{0,20}"
    ),
    "template": re.compile(
        r"[(（\[【]?(?:此处|这里|请在此处?|请在这里)(?:添加|补充|填写|插入|输入|放置?|替换为?)[^)）\]】。\n]{0,20}[)）\]】]?"
        r"|(?:标题|作者|正文|内容|摘要|日期|导语|来源|title|author|summary|date|body)\s*[:：]?\s*(?:待定|待补充?|待填写?|x{3,}|某某某?|tbd|tba|n/a)"
    ),
    "filler": re.compile(
        r"(?:please )?(?:insert|replace|put|enter|type|add|place) (?:this |your |the |some |own )*(?:text|content|copy|title|headline|description|paragraph|body|words)s?\b(?: (?:here|with [^.\n]{0,40}))"
        r"|(?:this is |here is |some )?(?:a |an )?(?:dummy|placeholder|sample|filler) (?:text|copy|content|paragraph)\b[^.\n]{0,40}"
        r"|(?=[^\n]*[^\W\d_])((?!哈|呵|嘿|lol|ha)[^\n]{2,40}?)(?:[\s,.;、,。]*\1){2,}[\s.。]{0,3}"
    ),
}
#: Unfilled slots as they are spelt, before folding: all capitals in brackets; a plain name in single braces.
SLOT = re.compile(
    r"\[(?:(?:(?:INSERT|ENTER|ADD)[ _][A-Z]|YOUR|FULL|FIRST|LAST|COMPANY|CLIENT|CUSTOMER|RECIPIENT|PRODUCT|CITY|EMAIL|PHONE|ADDRESS|TITLE|AUTHOR)[A-Z _/'-]{0,40}|[A-Z]{3,}(?:[ _][A-Z]{2,})+)\]"
    r"|<(?:(?:FIRST|LAST|FULL|YOUR|USER|COMPANY)[ _])?(?:NAME|DATE|TITLE|AUTHOR|EMAIL|COMPANY|ADDRESS|CITY)>"
    r"|(?<![$\w\\{])\{(?:(?:first|last|full|user|customer|client|company|product|order|recipient)_?)?(?:name|title|date|email|company|city|address|author)\}(?!\})"
    r"|\$(?:title|date|name|author|content|summary|url|email)\$"
)
QUOTES = "`'\"“”「」『』‘’"
#: A segment is residue if phrases cover this share of it; a page is an error page if residue covers this share of it.
SEGMENT_SHARE, PAGE_SHARE = 0.6, 0.5
#: Characters that a segment of a general form has at most: the forms are bounded, so that none is lost.
LONGEST_FORM = 400

_SPLIT = re.compile(r"\n|(?<=[。!?;])|(?<=[a-z]{2}\.)(?= ?[a-z一-鿿])")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"(?<![a-z0-9_])[a-z]+(?![a-z0-9_])[.,;:]?")
_TAIL = re.compile(r"^[#>*\-\s▍|]+")
_NOTE = re.compile(r"(?:ref|traceback id|trace id|request id|event id|incident id)[ #:]*[0-9a-f]{6,}|(?:错误码|request id|error code|时间)\s*:\s*[\w\-: .]*|nginx/[\d.]*|apache/[\d.]*|http(?: error)? [45]\d\d|\b[45]\d\d\b|\([45]\d\d\)")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """All phrases and marked words in one multi-pattern automaton."""
    a = ahocorasick.Automaton()
    for kind, phrases in PHRASES.items():
        for p in phrases:
            a.add_word(p, (kind, len(p)))
    for w in LATIN_MARKS:
        a.add_word(w, ("latin", len(w)))
    for w in HINTS:
        if w not in a:
            a.add_word(w, ("hint", len(w)))
    a.make_automaton()
    return a


def score_text(text: str | None) -> tuple[str | None, float, int]:
    """(kind, coverage, residue characters) of one body; kind is template, filler, error, script or null.

    Coverage is the residue's share of the body without white space; null and blank bodies give (None, 0, 0).
    """
    if not text or not text.strip():
        return None, 0.0, 0
    folded = fold_str(text)
    hits = [(end - n + 1, end + 1, kind) for end, (kind, n) in automaton().iter(folded)]
    fields = [(m.start(), m.end()) for m in PLACEHOLDER.finditer(folded)] if any(c in folded for c in "{<_@[【%") else []
    if any(c in text for c in "{<[$"):
        fields = sorted({*fields, *[(m.start(), m.end()) for m in SLOT.finditer(text)]})
    if not fields and not any(k != "frame" for _, _, k in hits):
        return None, 0.0, 0
    chars = dict.fromkeys(("template", "filler", "error", "script"), 0)
    # segments are looked at only in lines with a hit
    at = sorted([*[(x, None) for x in hits], *[(x, 0) for x in fields]], key=lambda x: x[0][:2])
    k = 0
    while k < len(at):
        low = folded.rfind("\n", 0, at[k][0][0]) + 1
        high = folded.find("\n", at[k][0][0])
        high = len(folded) if high < 0 else high
        last = k
        while last < len(at) and at[last][0][0] <= high:
            last += 1
        if all(f is None and x[2] == "frame" for x, f in at[k:last]):
            k = last
            continue
        start = low
        for end in [*_cuts(text[low:high], folded[low:high], low), high + 1]:
            here = k
            while k < last and at[k][0][0] < end:
                k += 1
            if k > here:
                kind, n = _segment(folded, start, min(end, len(folded)), [x for x, f in at[here:k] if f is None], [x for x, f in at[here:k] if f == 0])
                if kind:
                    chars[kind] += n
            start = end
        k = max(k, last)
    # an error page or notice is one only if it makes up the body; template and filler lines are wrong anywhere
    page = chars["error"] + chars["script"]
    residue = sum(chars.values())
    if not residue:
        return None, 0.0, 0
    total = len(_SPACE.sub("", folded))
    if page and residue >= PAGE_SHARE * (total - (_covered(folded, [m.span() for m in _NOTE.finditer(folded)]) if residue < total else 0)):
        kind = "error" if chars["error"] >= chars["script"] else "script"
    elif chars["template"]:
        kind = "template"
    elif chars["filler"]:
        kind = "filler"
    else:
        return None, page / total, page
    return kind, residue / total, residue


def _cuts(text: str, folded: str, base: int = 0) -> list[int]:
    """Ends of the segments, counted from base; a full stop ends one before a Han or a capital letter, which only the text before folding shows."""
    cuts = []
    for m in _SPLIT.finditer(folded):
        at = m.end() if m.group() else m.start()
        if not m.group() and folded[at - 1] == "." and text[at + (folded[at] == " ")].islower():
            continue
        cuts.append(base + at)
    return cuts


def _segment(s: str, start: int, end: int, hits: list, fields: list) -> tuple[str | None, int]:
    """Kind and length of one segment if it is residue."""
    seg = s[start:end]
    body = _TAIL.sub("", seg)
    size = len(_SPACE.sub("", body))
    if not size:
        return None, 0
    if not fields and all(k == "hint" for _, _, k in hits):
        form = _form(seg) if size <= LONGEST_FORM else None
        return (form, size) if form else (None, 0)
    if any(k == "latin" for _, _, k in hits):
        hits = [x for x in hits if x[2] != "latin"] + _latin(s, start, end)
    loose = [(a, b) for a, b in fields if not (a > 0 and s[a - 1] in QUOTES) and not (b < len(s) and s[b : b + 1] in QUOTES and s[b : b + 1])]
    blanks = [x for x in hits if x[2] == "blank"]
    if (loose or blanks) and not MENTION.search(seg):
        covered = _covered(s, [*loose, *[(a, b) for a, b, k in hits if k in ("blank", "frame")]])
        if loose or covered >= 0.5 * size:
            return "template", size
    real = [x for x in hits if x[2] in ("error", "script", "filler")]
    form = _form(seg) if any(k == "hint" or k in FORMS for _, _, k in hits) else None
    if form and not real:
        return form, size
    if not real or any(0 < a and s[a - 1] in QUOTES for a, _, _ in real):
        return None, 0
    spans = [(a, b) for a, b, _ in real] + [(start + m.start(), start + m.end()) for m in _NOTE.finditer(seg)]
    if _covered(s, spans) < SEGMENT_SHARE * size:
        return (form, size) if form else (None, 0)
    by = {k: _covered(s, [(a, b) for a, b, x in real if x == k]) for k in ("error", "script", "filler")}
    return max(by, key=lambda k: by[k]), size


def _form(seg: str) -> str | None:
    """The kind whose general form covers the segment; none if it is quoted or speaks about placeholders."""
    body = _TAIL.sub("", seg).strip(" 。.!?;,、 ")
    if not body or body[0] in QUOTES or MENTION.search(seg):
        return None
    for kind, form in FORMS.items():
        m = form.match(body)
        if m and (m.end() >= 0.85 * len(body) if kind != "template" else m.end() == len(body)):
            return kind
    return None


def _latin(s: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """The words of placeholder Latin in one segment, in any order, as filler; none if there are too few."""
    words = [(m.start(), m.end(), m.group().rstrip(".,;:")) for m in _WORD.finditer(s, start, end)]
    words = [x for x in words if x[2] in LATIN_MARKS or x[2] in LATIN_OTHERS]
    if len(words) < LATIN_WORDS or len({w for _, _, w in words if w in LATIN_MARKS}) < LATIN_DIFFERENT:
        return []
    return [(a, b, "filler") for a, b, _ in words]


def _covered(s: str, spans: list[tuple[int, int]]) -> int:
    """Characters other than white space in the union of spans."""
    n, at = 0, -1
    for a, b in sorted(spans):
        a = max(a, at)
        if b > a:
            n += len(_SPACE.sub("", s[a:b]))
            at = b
    return n


def score_residue(df: DataFrame, id_col: str = "ordinal", texts: tuple[str, ...] = ("content_text", "content_markdown")) -> DataFrame:
    """(id, kind, coverage) for every row: the worst of its text columns; kind is null for a clean row.

    Null and blank texts are clean; repeated rows each give a row; null ids stay null. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, *texts):
                best: list[tuple[str | None, float]] = [(None, 0.0)] * b.num_rows
                for c in texts:
                    for i, t in enumerate(b.column(c).to_pylist()):
                        kind, share, _ = score_text(t)
                        if (kind is not None, share) > (best[i][0] is not None, best[i][1]):
                            best[i] = (kind, share)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([k for k, _ in best], pa.string()), pa.array([c for _, c in best], pa.float64())], names=["id", "kind", "coverage"])

    return df.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("string").alias(c) for c in texts]).mapInArrow(run, "id long, kind string, coverage double")
