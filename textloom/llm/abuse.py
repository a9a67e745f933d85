"""Problem 8: abusive, hateful or sexual content, by Levenshtein automata over lexicon tries and context windows."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._text import code_points, slices, tables

# The lexicon, by category, then by language. Matched on text folded and reduced to letters and digits.
STRONG = {
    "abusive": (
        "打断你的腿", "长得像猪想得也像猪", "趁早滚蛋", "老子弄死你", "弄死你信不信", "没人想听你放屁", "活着浪费空气", "找到你家门口", "怎么还不去死", "回去吃屎", "脑子被驴踢", "抽你两巴掌",
        "你妈没教过你做人", "给我跪下道歉", "骗到坟里去", "滚远点", "没拴好跑出来叫", "没人要的货", "活该亏光", "操你妈", "你妈死了", "去死吧", "杀你全家", "滚出去死", "不得好死", "也敢发文",
        "nobody wants you here", "hope you choke", "even your mother hates you", "go kill yourself", "eat shit", "post such crap", "shut up you worthless", "crawl back to your hole",
        "find you and break your", "should go to hell", "hope you lose it all", "brain dead", "piss off", "you pathetic", "fuck you", "drop dead", "i will kill you", "piece of shit",
    ),
    "hateful": (
        "讲理等于对牛弹琴", "这群劣等货", "房子都烧了才解气", "骨子里就是贼", "天生下贱", "不配和我们坐在一起", "孩子也别放过", "早晚是祸害", "灭光什么时候太平", "像蟑螂一样", "早该清理干净", "打一个别手软",
        "生来就比我们低一等", "都是寄生虫", "统统赶出去", "人进店脏", "移民进店脏", "教徒进店脏", "族进店脏", "劣等民族", "滚回你们国家",
        "out of their homes", "are subhuman", "breed like rats", "stink like them", "should be driven out", "deserve to live among", "they are born thieves", "by nature no", "served here they are", "go back to your country", "inferior race", "wipe out the", "exterminate the", "is a disease on", "are a disease",
    ),
    "sexual": (
        "巨乳御姐", "在线陪聊想看哪里", "一夜情群", "美女主动上门", "自慰直播间", "湿身诱惑", "伸进她的内裤", "喘着粗气缠在一起", "裸聊视频", "身材火辣随便看", "脱光衣服骑在", "呻吟不止", "情趣丝袜女主播",
        "激情互动湿到", "黄片资源", "高清做爱", "露点不打码", "看片加群", "上门服务包夜", "全套口活", "同城约炮", "无码成人片", "点开就硬", "床上高潮", "秘方私聊", "援交", "成人视频免费",
        "hot nude cams", "horny girls", "horny singles", "get laid now", "big tits", "wet pussy", "tore off her panties", "fucked until dawn", "moaned as he thrust", "her naked thighs", "explicit sex videos", "leaked nudes", "busty models", "masturbate live", "hardcore porn", "sucked his",
    ),
}
WEAK = (
    "傻逼", "傻比", "煞笔", "白痴", "人渣", "杂种", "废物", "垃圾", "畜生", "贱货", "脑残", "蠢货", "混蛋", "王八蛋", "智障", "狗东西", "窝囊废", "贱人", "狗杂碎", "丑八怪", "败类", "他妈的",
    "moron", "scumbag", "bastard", "loser", "idiot", "imbecile", "clown", "trash", "dumbass", "bitch", "whore", "slut", "retard", "asshole", "vermin", "subhuman", "fucking", "cunt", "faggot",
)
# Slots whose products are strong terms too, by category: what is done or wished, and to whom; what is offered, and of whom.
SLOTS = {
    "abusive": (
        (("我要", "老子要", "老子今晚就", "早晚", "迟早", "信不信我", "小心我", "一定要", "看我不"), ("弄死", "打死", "砍死", "捅死", "掐死", "整死", "搞死", "杀了", "宰了", "废了", "剁了"), ("你",)),
        (("你们全家", "你全家", "你爹妈", "祝你", "祝你们", "你怎么不", "你赶紧", "你早点", "你们早点", "你咋不"), ("去死", "死光", "早点死", "不得好死", "死绝", "暴毙", "出门被车撞")),
        (("你这个", "你个", "你这种", "你就是个", "你真是个", "你们这群", "你们这帮", "一群", "死"), ("蠢猪", "不要脸的东西", "臭婊子", "死全家的", "缺德玩意", "狗娘养的", "没脑子的", "臭傻子", "贱骨头", "窝囊废", "狗杂种")),
        (("i will", "i ll", "i am going to", "i m going to", "gonna", "we will", "we ll", "someone should"), ("kill", "murder", "stab", "strangle", "shoot", "hurt", "bury", "hunt", "beat", "destroy"), ("you",)),
        (("i will", "i ll", "going to", "gonna"), ("break", "smash", "cut off", "rip off"), ("your",), ("legs", "face", "neck", "skull", "head", "arms", "teeth", "bones")),
        (("go", "please", "just", "already", "hope you"), ("die", "rot", "choke", "burn"), ("in a fire", "in hell", "alone", "already", "slowly")),
        (("rot in", "burn in", "go to", "see you in"), ("hell you", "hell and die")),
        (("hang", "kill", "shoot", "drown"), ("yourself",)),
        (("you",), ("stupid", "fucking", "worthless", "dumb", "filthy", "disgusting", "pathetic", "ugly", "miserable", "little", "goddamn"), ("bitch", "pig", "coward", "rat", "creep", "freak", "cow", "waste of space", "piece of garbage", "piece of trash")),
    ),
    "hateful": (
        (("这群", "这帮", "那群", "那帮", "这些", "那些", "他们"), ("人渣都该死", "畜生都该死", "劣等人", "低等人种", "杂种滚出去")),
        (("统统", "全都", "通通", "都"), ("该死", "该灭", "该被灭绝", "该滚出去", "该被清洗")),
        (("把这些", "把这群", "把那帮", "把他们", "把这帮"), ("难民", "移民", "外地人", "教徒", "黑鬼", "异族", ""), ("都灭光", "赶尽杀绝", "全杀了", "全部消灭", "都烧死")),
        (("那种人", "这种人", "这些人", "那帮人", "他们"), ("天生", "骨子里", "生来", "从根上"), ("低等", "劣等", "下贱", "肮脏", "是贼", "坏种")),
        (("all of them", "they all", "these people", "those people"), ("should be", "must be", "deserve to be", "need to be"), ("gassed", "exterminated", "wiped out", "shot", "deported and shot", "burned", "killed", "hanged")),
    ),
    "sexual": (
        (("hot", "horny", "busty", "slutty"), ("girls", "milfs", "teens", "babes", "chicks", "models", "moms", "housewives")),
        (("free", "live", "xxx", "hardcore"), ("porn", "sex cams", "xxx videos", "sex chat", "cams live", "fuck videos")),
        (("send", "trade", "leaked"), ("nudes",)),
        (("spread her", "between her", "opened her"), ("legs and he thrust", "naked thighs", "legs and he entered", "legs as he")),
        (("免费看", "在线看", "高清", "无码", "最新"), ("黄片", "黄色视频", "做爱视频", "成人电影", "无码高清", "三级片")),
        (("裸聊", "约炮", "包夜", "口爆", "内射"), ("妹子", "美女", "少妇", "学生妹", "加微信", "加薇信", "在线", "价格")),
    ),
}
# Words that degrade a group if it is said to be them, and the groups: a verb of being stands between, or nothing but a few words.
DEHUMAN = (
    "vermin", "parasites", "cockroaches", "savages", "subhuman", "scum", "filth", "rats", "pigs", "animals", "a plague", "garbage",
    "寄生虫", "蟑螂", "畜生", "牲口", "劣等货", "劣等", "祸害", "害虫", "渣滓", "贱种", "蝗虫",
)
GROUP = re.compile(
    r"(?:(?:immigrants|foreigners|refugees|migrants|muslims|jews|christians|blacks|whites|asians|arabs|gypsies|gays|lesbians|women|men|peasants|the poor|(?:these|those|such) (?:people|\w+s))\s+(?:are|were|is)|\bthey (?:are|were))"
    r"(?: (?:all|just|nothing but|like|only|a bunch of|no better than|filthy|dirty|lazy|subhuman|disgusting|worse than))*\s*$"
    r"|(?:(?:这|那)(?:群|帮|些|种|类)[^,，。!?、]{0,8}|他们|她们|外地人|乡下人|移民|难民|教徒|[^,，。!?、]{1,4}(?:族|教徒|地方)的?人)(?:[^,，。!?、]{0,3})(?:就是|都是|全是|不过是|简直是|天生是|是)[^,，。!?、]{0,4}$"
)
#: Degrading words that other things are too: they need a group named by what it is, not "they".
LITERAL = frozenset({"rats", "pigs", "animals", "parasites", "cockroaches", "garbage"})
# Words of a sentence that speaks to someone; words beside a quotation that name a term instead of using it; compounds that a term is part of.
ADDRESS = re.compile(r"你|您|楼主|评论里那个|全家|谁家|这种|\byou(?:r|re)?\b|\bur?\b|whoever")
NAMING = re.compile(r"敏感词|词表|审核|过滤|取证|举报|屏蔽|留言会|moderat|term to hide|lists? [\"“]|word list|blocklist|slur list|性教育|读本|医生|误区|防治|疾病|癌|cancer|screening|census|museum|博物馆|文书")
TECHNICAL = re.compile(r"(?:废物|垃圾)(?:再?利用|回收|分类|处理|处置|焚烧|填埋|排放|债|邮件|短信|桶|箱|袋|场|站|车)|寄生虫病|性教育|勃起障碍|sex ratio|zombie process|naked put|dumb terminal|junk bond|裸卖空|kill -9|先 ?kill|trash (?:can|bin|collection|folder)")
#: Before a weak Latin term: someone is spoken to, or it is a call by itself.
SPOKEN = re.compile(
    r"\b(?:you|u|ya)(?:'?re| are|r| were|'ve always been| look like| sound like)?(?: (?:are|just|such|all|so|a|an|the|complete|completely|total|absolute|utter|stupid|fucking|dumb|worthless|little|pathetic|bloody|filthy|goddamn|damn|real|nothing but|piece of|bunch of|biggest|bit of|kind of|old|ugly|lazy|\w+ly))*\s*$"
    r"|(?:^|[,;:!?.\"“]|\bwhat an?|\bshut up|\bhey|\bonly an?|\bsuch an?)\s*(?:(?:absolute|complete|total|fucking|stupid|dumb|little|pathetic|worthless)\s+)*$"
)
#: After a call: its clause ends, or it is said whose it is.
ENDS = re.compile(r"s?\s*(?:$|[\n,.!?;:…。!?、\"”]|you\b|like you)")
#: After a term: a word that makes it one of a list of words. Before a quotation: it is a mere speaker's label, or it speaks to someone in scare quotes.
LISTED = re.compile(r"(?:、[^,，。、]{1,12}){0,8}(?:等|这类|这种|这个|之类的?|一类|一)(?:敏感)?(?:词|字样|字眼|留言|说法)")
LABEL = re.compile(r"[\s\-*>#]*(?:(?:网友|用户|楼主|读者|匿名|reader|user|guest)\s*\d*\s*:)?\s*")
SCARE = re.compile(r"(?:你|您|你们)(?:就?是|真是|这|那|个|种|群|们|才是|简直是|也是|一?个){0,4}$|\byou(?:'re| are)?(?: just)?(?: an?| such an?)? ?$")
QUOTATION = re.compile(r"“[^“”\n]{1,120}”|「[^「」\n]{1,120}」|『[^『』\n]{1,120}』|‘[^‘’\n]{1,120}’|\"[^\"\n]*\"")
#: Characters round a term or its quotation in which its context is looked for, never beyond the line.
WINDOW = 60
#: Weight of a strong term, of a weak one, of a weak one that addresses someone; a sentence is abusive from THRESHOLD on.
#: A term that is quoted weighs W_QUOTED of it, one named in a quotation or part of a technical compound W_NAMED.
W_STRONG, W_WEAK, W_ADDRESSED, W_QUOTED, W_NAMED, THRESHOLD = 1.0, 0.4, 0.75, 0.3, 0.1, 0.7
#: Terms at least this long may differ by one edit.
FUZZY_FROM = {"han": 5, "latin": 9}

# Digits and signs that stand for letters beside Latin letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Words that a misspelt term could be.
COMMON = frozenset({"lose", "moon", "morn", "cown", "lown", "trah", "rash", "losre"})
_SENTENCE = re.compile(r"\n|[。!?！？]+|(?<=[a-z]{2})\.(?=\s|$)")


def _bare(term: str) -> str:
    return "".join(c for c in term if c.isalnum())


class Trie:
    """Lexicon trie as lists; forward for terms, backward for reversed ones."""

    def __init__(self) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.term: list[list[int]] = [[]]

    def add(self, s: str, number: int) -> None:
        node = 0
        for c in s:
            nxt = self.child[node].get(c)
            if nxt is None:
                nxt = len(self.child)
                self.child.append({})
                self.term.append([])
                self.child[node][c] = nxt
            node = nxt
        self.term[node].append(number)

    def walk(self, s: str) -> int:
        node = 0
        for c in s:
            node = self.child[node][c]
        return node

    def intersect(self, node: int, text: str, limit: int = 1) -> list[tuple[int, int]]:
        """(term, length used) of terms under node within limit edits of a prefix of text.

        The Levenshtein automaton is run as the set of (node, edits) it can be in, intersected with the trie step by step.
        """
        out: dict[int, int] = {}
        states = self._closed({node: 0}, limit)
        for used in range(len(text) + 1):
            for n in states:
                for t in self.term[n]:
                    out.setdefault(t, used)
            if used == len(text) or not states:
                break
            c = text[used]
            nxt: dict[int, int] = {}
            for n, e in states.items():
                kids = self.child[n]
                if (k := kids.get(c)) is not None and e < nxt.get(k, 9):
                    nxt[k] = e
                if e < limit:
                    if e + 1 < nxt.get(n, 9):
                        nxt[n] = e + 1  # a character too many in the text
                    for k in kids.values():
                        if e + 1 < nxt.get(k, 9):
                            nxt[k] = e + 1  # another character
            states = self._closed(nxt, limit)
        return list(out.items())

    def _closed(self, states: dict[int, int], limit: int) -> dict[int, int]:
        """With the nodes reached by characters that the text lacks."""
        for n, e in list(states.items()):
            if e < limit:
                for k in self.child[n].values():
                    if e + 1 < states.get(k, 9):
                        states[k] = e + 1
        return states


def slot_terms() -> list[tuple[str, str]]:
    """(term, category) of the products of all slots."""
    return [("".join(p), c) for c, groups in SLOTS.items() for g in groups for p in itertools.product(*g)]


def misspellings(term: str) -> set[str]:
    """A Latin term of five letters with two neighbours swapped or a vowel inside left out; common words are none."""
    if len(term) < 5 or not term.isascii():
        return set()
    swapped = {term[:i] + term[i + 1] + term[i] + term[i + 2 :] for i in range(1, len(term) - 1)}
    short = {term[:i] + term[i + 1 :] for i in range(1, len(term) - 1) if term[i] in "aeiou"}
    return (swapped | short) - {term} - COMMON


class Lexicon:
    """Terms, the tries, and an automaton of anchors: of a term with one edit, its first or its last half is unchanged."""

    def __init__(self) -> None:
        strong = dict.fromkeys([*((_bare(t), c) for c, ts in STRONG.items() for t in ts), *((_bare(t), c) for t, c in slot_terms())])
        weak = dict.fromkeys([*(_bare(t) for t in WEAK), *sorted({m for t in WEAK for m in misspellings(_bare(t))})])
        self.terms: list[tuple[str, str, bool]] = [*((t, c, True) for t, c in strong), *((t, "abusive", False) for t in weak), *((_bare(t), "hateful", False) for t in DEHUMAN)]
        self.dehuman = len(self.terms) - len(DEHUMAN)  # the number of the first degrading word
        self.forward, self.backward = Trie(), Trie()
        anchors: dict[str, list[tuple[str, int, int]]] = {}
        for i, (t, _, strong) in enumerate(self.terms):
            latin = t.isascii()
            fuzzy = strong and len(t) >= FUZZY_FROM["latin" if latin else "han"]
            if not fuzzy:
                anchors.setdefault(t, []).append(("exact", i, 0))
                continue
            half = len(t) // 2
            self.forward.add(t, i)
            self.backward.add(t[::-1], i)
            anchors.setdefault(t[:half], []).append(("forward", i, half))
            anchors.setdefault(t[half:], []).append(("backward", i, len(t) - half))
        self.automaton = ahocorasick.Automaton()
        for a, uses in anchors.items():
            todo = []
            for how, i, n in uses:
                if how == "exact":
                    todo.append((how, i))
                elif how == "forward":
                    todo.append((how, self.forward.walk(a)))
                else:
                    todo.append((how, self.backward.walk(a[::-1])))
            self.automaton.add_word(a, (len(a), list(dict.fromkeys(todo))))
        self.automaton.make_automaton()
        self.longest = max(len(t) for t, _, _ in self.terms)

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(term, start, end) of every term in a reduced text, misspelt by at most one edit where the term is long enough."""
        out = set()
        for end, (n, todo) in self.automaton.iter(text):
            start = end - n + 1
            for how, x in todo:
                if how == "exact":
                    out.add((x, start, end + 1))
                elif how == "forward":
                    for t, used in self.forward.intersect(x, text[end + 1 : end + 2 + self.longest]):
                        out.add((t, start, end + 1 + used))
                else:
                    back = text[max(0, start - self.longest - 1) : start][::-1]
                    for t, used in self.backward.intersect(x, back):
                        out.add((t, start - used, end + 1))
        return sorted(out)


@lru_cache(maxsize=1)
def lexicon() -> Lexicon:
    return Lexicon()


@lru_cache(maxsize=1)
def _leet() -> tuple[np.ndarray, np.ndarray]:
    to = np.arange(0x110000, dtype=np.uint32)
    latin = np.zeros(0x110000, dtype=bool)
    for a, b in LEET.items():
        to[ord(a)] = ord(b)
    latin[ord("a") : ord("z") + 1] = True
    return to, latin


def reduce_batch(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded, reduced, places of the reduced code points in folded, reduced offsets).

    Reduced: letters and digits only; digits and signs beside a Latin letter become the letters they stand for.
    """
    fold, _, keep = tables()
    folded = fold[cp]
    to, latin = _leet()
    signs = (folded == ord("@")) | (folded == ord("$"))
    is_latin = latin[folded]
    near = np.zeros(len(folded), dtype=bool)
    near[1:] |= is_latin[:-1]
    near[:-1] |= is_latin[1:]
    kept = keep[folded] | (signs & near)
    place = np.flatnonzero(kept)
    red = folded[place]
    lat = latin[red]
    beside = np.zeros(len(red), dtype=bool)
    beside[1:] |= lat[:-1]
    beside[:-1] |= lat[1:]
    # runs of digits are letters only if every digit has one: 0,1,3,4,5,7,8
    swap = beside & ~lat & (to[red] != red)
    red = np.where(swap, to[red], red)
    cum = np.zeros(len(folded) + 1, dtype=np.int64)
    np.cumsum(kept, out=cum[1:])
    return folded, red, place, cum[off]


def _quotation(folded: str, a: int, b: int) -> tuple[int, int] | None:
    """The quotation that a term at (a, b) stands in: within one line, of at most twice WINDOW characters, with other words in its line."""
    line = folded.rfind("\n", 0, a) + 1
    stop = folded.find("\n", b)
    stop = len(folded) if stop < 0 else stop
    for m in QUOTATION.finditer(folded, line, stop):  # straight marks pair up from the line's start
        if m.start() >= a:
            break
        if m.end() >= b and m.end() - m.start() <= 2 * WINDOW + 2:
            before, after = folded[line : m.start()], folded[m.end() : stop]
            alone = LABEL.fullmatch(before) and not any(c.isalnum() for c in after)
            return None if alone or SCARE.search(before) else m.span()
    return None


def _factor(folded: str, a: int, b: int) -> float:
    """Weight of a term at (a, b) by the window round it: 1 if it is used, less if it is quoted, named or technical."""
    near = max(0, a - 16)
    if any(m.start() < b and m.end() > a for m in TECHNICAL.finditer(folded, near, b + 16)):
        return W_NAMED
    span = _quotation(folded, a, b)
    if span is None:
        if not LISTED.match(folded, b):
            return 1.0
        span = (a, b)
    before = _SENTENCE.split(folded[max(0, span[0] - WINDOW) : span[0]])[-1]
    after = _SENTENCE.split(folded[span[1] : span[1] + WINDOW])[0]
    return W_NAMED if NAMING.search(before + folded[span[0]]) or NAMING.search(after) else W_QUOTED


def _spoken(folded: str, start: int, a: int, b: int) -> bool:
    """Whether a weak Latin term at (a, b) is said to someone: of them, or as a call that ends its clause."""
    m = SPOKEN.search(folded, start, a)
    return bool(m) and (m.group().startswith(("you", "u", "ya")) or bool(ENDS.match(folded, b)))


def score_sentences(folded: str, found: list[tuple[int, int, int]]) -> list[tuple[float, str]]:
    """(score, category) of the sentences with terms; found: (term, start, end) in folded."""
    lex = lexicon()
    cuts = [0, *[m.end() for m in _SENTENCE.finditer(folded)], len(folded)]
    by: dict[int, list[tuple[int, int, int]]] = {}
    for t, a, b in found:
        by.setdefault(int(np.searchsorted(cuts, a, side="right")) - 1, []).append((t, a, b))
    out = []
    for k, terms in by.items():
        start, end = cuts[k], cuts[min(k + 1, len(cuts) - 1)]
        sentence = folded[start:end]
        strong: dict[int, float] = {}
        weak = degrades = 0.0
        score = {"abusive": 0.0, "hateful": 0.0, "sexual": 0.0}
        for t, a, b in terms:
            word, _, is_strong = lex.terms[t]
            if "、" in folded[a:b]:
                continue  # of two words of a list
            if word.isascii() and ((a > 0 and "a" <= folded[a - 1] <= "z") or (b < len(folded) and "a" <= folded[b : b + 1] <= "z")):
                if not is_strong or len(word) < 9:
                    continue  # inside a longer word
            factor = _factor(folded, a, b)
            if is_strong:
                strong[t] = max(factor, strong.get(t, 0.0))
            elif t >= lex.dehuman:
                said = GROUP.search(folded, max(start, a - WINDOW), a)
                if said and not (word in LITERAL and said.group().lstrip().startswith("they")):
                    degrades = max(degrades, factor)
            else:
                spoken = _spoken(folded, max(start, a - WINDOW), a, b) if word.isascii() else ADDRESS.search(sentence)
                weak = max(weak, factor * (W_ADDRESSED if spoken else W_WEAK))
        for c in score:  # quoted terms don't add up to a use
            own = [f for t, f in strong.items() if lex.terms[t][1] == c]
            score[c] = W_STRONG * (sum(f for f in own if f == 1.0) or max(own, default=0.0))
        score["abusive"] += weak
        score["hateful"] += W_STRONG * degrades
        best = max(score, key=lambda c: score[c])
        if strong and degrades == 0:
            best = max({lex.terms[t][1] for t in strong}, key=lambda c: score[c])
        total = sum(v for v in score.values() if v >= W_WEAK) or max(score.values())
        if total > 0:
            out.append((total, best))
    return out


def score_abuse(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str | None = "source") -> DataFrame:
    """(id, source, score, category, sentences): every row's highest sentence score, that sentence's category (null
    under the threshold) and the number of sentences at or over it.

    Null, blank and clean texts score 0; repeated rows each give a row; null ids and sources stay null. Whole texts are
    read, each in one task, with no shuffle. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon()
        for whole in batches:
            for b in slices(whole, "text"):
                cp, off = code_points(b.column("text"))
                folded, red, place, red_off = reduce_batch(cp, off)
                flat = red.astype("<u4").tobytes().decode("utf-32-le")
                scores, cats, counts = [], [], []
                for i in range(b.num_rows):
                    a, z = int(red_off[i]), int(red_off[i + 1])
                    found = lex.matches(flat[a:z]) if z > a else []
                    best, cat, n = 0.0, None, 0
                    if found:
                        doc = folded[off[i] : off[i + 1]].astype("<u4").tobytes().decode("utf-32-le", "replace")
                        at = place[a:z] - off[i]
                        for s, c in score_sentences(doc, [(t, int(at[x]), int(at[y - 1]) + 1) for t, x, y in found]):
                            n += s >= THRESHOLD
                            if s > best:
                                best, cat = s, c
                    scores.append(best)
                    cats.append(cat if best >= THRESHOLD else None)
                    counts.append(n)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("source"), pa.array(scores, pa.float64()), pa.array(cats, pa.string()), pa.array(counts, pa.int32())], names=["id", "source", "score", "category", "sentences"])

    src = F.col(source).cast("string") if source else F.lit(None).cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), src.alias("source"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id long, source string, score double, category string, sentences int")


def abuse_rates(scored: DataFrame) -> DataFrame:
    """(source, docs, abusive_docs, rate) per source, null sources together; docs counts distinct ids."""
    one = scored.groupBy("source", "id").agg(F.max("score").alias("score"))
    return one.groupBy("source").agg(F.count("*").alias("docs"), F.sum((F.col("score") >= THRESHOLD).cast("long")).alias("abusive_docs")).withColumn("rate", F.col("abusive_docs") / F.col("docs"))
