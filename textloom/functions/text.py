"""Text functions as Column expressions: they stay in the JVM. Null counts as empty text unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import constants as K


def _c(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def strip(x: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_c(x), K.TRIM, "")


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def first_match(x: Column | str, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where nothing matches (an empty group stays empty)."""
    return F.when(F.regexp_like(_c(x), F.lit(pattern)), F.regexp_extract(_c(x), pattern, group))


def title(text: Column | str, stem: Column | str) -> Column:
    """Title field anywhere in the text, else the first top heading, else the stem; an empty field takes the next line."""
    field = strip(first_match(text, rf"(?md)^title:{K.WS}*\"?(.*?)\"?$"))
    heading = strip(first_match(text, rf"(?md)^#{K.WS}+(.+)$"))
    return F.coalesce(blank_to_null(field), F.when(F.regexp_like(_c(text), F.lit(rf"(?md)^#{K.WS}+(.+)$")), heading), _c(stem))


def distinct_in_order(a: Column) -> Column:
    """Non-null elements once each, in the order first seen."""
    return F.array_distinct(F.filter(a, lambda x: x.isNotNull()))


def clean_array(a: Column | str) -> Column:
    """Stripped elements without null and blank ones; a null array is empty."""
    a = F.col(a) if isinstance(a, str) else a
    return F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), strip), lambda x: x != "")


def field_list(text: Column | str, field: str) -> Column:
    """Items of a one-line bracketed list field, unquoted and unbracketed, distinct in order; absent: empty."""
    raw = F.regexp_replace(strip(first_match(text, rf"(?md)^{field}:{K.WS}*\[(.*?)\]{K.WS}*$")), rf"\]\]{K.WS}*,{K.WS}*\[\[", ",")

    def item(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(strip(x), '^"+|"+$', ""), "^'+|'+$", "")
        return strip(F.regexp_replace(x, r"^\[+|\]+$", ""))

    return F.array_distinct(F.filter(F.transform(F.split(raw, ","), item), lambda x: x != ""))


def page_type(text: Column | str) -> Column:
    """Type field anywhere in the text; unknown where absent."""
    return F.coalesce(strip_or_null(first_match(text, rf"(?md)^type:{K.WS}*\"?(.*?)\"?$")), F.lit(K.UNKNOWN))


def strip_or_null(x: Column) -> Column:
    return F.regexp_replace(x, K.TRIM, "")


def clean_markdown(text: Column | str) -> Column:
    """T4: front matter at the start, fences, images, links with their text and noise lines go; wiki links keep their names; one line."""
    x = F.regexp_replace(_c(text), r"^---\n(?s:.*?)\n---\n", " ")
    x = F.regexp_replace(x, r"```(?s:.*?)```", " ")
    x = F.regexp_replace(x, r"!\[[^\]]*\]\([^\)]+\)", " ")
    x = F.regexp_replace(x, r"\[[^\]]+\]\([^\)]+\)", " ")
    x = F.regexp_replace(x, K.WIKILINK, "$1")
    x = F.regexp_replace(F.regexp_replace(x, K.LINE_ENDS, "\n"), f"(?imd){K.NOISE_LINE}", "")
    return strip(F.regexp_replace(x, f"{K.WS}+", " "))


def normal_token(x: Column | str) -> Column:
    """T5: stripped, lower case, no signs at the ends."""
    return F.regexp_replace(F.lower(strip(x)), K.WORD_END, "")


def is_noise_token(x: Column) -> Column:
    """T7."""
    return x.isin(*K.NOISE_SET) | F.regexp_like(x, F.lit(f"(?s){K.NOISE_SHAPE}")) | ((F.length(x) >= 5) & F.regexp_like(x, F.lit(K.NOISE_PART)))


def raw_tokens(x: Column | str) -> Column:
    """T6 without cleaning and without the noise filter."""
    return F.filter(F.transform(F.regexp_extract_all(_c(x), F.lit(K.TOKEN), F.lit(0)), normal_token), lambda t: t != "")


def tokens(x: Column | str) -> Column:
    """Words and Han runs of the cleaned text, normal, without noise."""
    return F.filter(raw_tokens(clean_markdown(x)), lambda t: ~is_noise_token(t))


def is_noise_sentence(x: Column) -> Column:
    """Short, a report line, code-like, a field, or fewer than two useful tokens."""
    return (
        (F.length(x) < 12)
        | F.regexp_like(x, F.lit(f"(?i){K.NOISE_HEAD}"))
        | (F.length(x) - F.length(F.replace(x, F.lit("`"), F.lit(""))) >= 2)
        | F.regexp_like(x, F.lit(K.FIELD_HEAD))
        | (F.size(F.filter(raw_tokens(x), lambda t: ~is_noise_token(t))) < 2)
    )


def key_sentences(text: Column | str, limit: int) -> Column:
    """Distinct sentences of the cleaned text that aren't noise, in order, at most limit; only CJK stops and !?; end one."""
    parts = F.split(clean_markdown(text), r"(?<=[。！？!?；;])")
    parts = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, f"{K.WS}+", " "), K.SENTENCE_EDGE, ""))
    return F.slice(F.array_distinct(F.filter(parts, lambda s: ~is_noise_sentence(s))), 1, limit)


def title_key(x: Column | str) -> Column:
    """Up to the first colon or bracket, without a series suffix, else without a genre suffix."""
    head = strip(F.regexp_replace(_c(x), r"(?s)[：:（(].*$", ""))
    one, two = (strip(first_match(head, rf"^(.+?)(?:{'|'.join(s)})$")) for s in K.KEY_SUFFIXES)
    return F.coalesce(blank_to_null(one), blank_to_null(two), head)


def preview(text: Column | str) -> Column:
    """The first 600 characters of the cleaned text."""
    return F.substring(clean_markdown(text), 1, 600)


def month_of_path(path: Column | str) -> Column:
    """The parent folder's name if it starts like a month, else unknown."""
    parent = F.regexp_extract(_c(path), r"([^/]*)/[^/]*$", 1)
    return F.when(F.regexp_like(parent, F.lit(r"^[0-9]{4}-[0-9]{2}")), parent).otherwise(F.lit(K.UNKNOWN))


def month_of_file(name: Column | str) -> Column:
    """YYYY-MM of a file name that starts with a date, dashed or compact; else null."""
    n = _c(name)
    dashed, compact = r"^([0-9]{4})-([0-9]{2})-[0-9]{2}", r"^([0-9]{4})([0-9]{2})[0-9]{2}"
    return F.coalesce(*[F.when(F.regexp_like(n, F.lit(p)), F.concat_ws("-", F.regexp_extract(n, p, 1), F.regexp_extract(n, p, 2))) for p in (dashed, compact)])


def slug(x: Column | str) -> Column:
    """T14."""
    s = F.regexp_replace(F.regexp_replace(_c(x), r'[\\/:*?"<>|]', "_"), f"{K.WS}+", "_")
    s = F.regexp_replace(s, r"^[._]+|[._]+$", "")
    return F.coalesce(blank_to_null(s), F.lit("untitled"))


def file_name(x: Column | str, most: int = 80) -> Column:
    """T15."""
    s = strip(F.translate(_c(x), '\\/:*?"<>|', "_________"))
    return F.substring(F.replace(F.replace(s, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit("")), 1, most)


def account_name(x: Column | str) -> Column:
    """T16."""
    return strip(F.translate(_c(x), "/\\", "__"))


def account_file_name(x: Column | str) -> Column:
    """T16, as the crawler's progress and list files spell it."""
    return F.translate(_c(x), "/ ", "__")


def normal_name(x: Column | str) -> Column:
    """T17."""
    return strip(F.translate(F.lower(_c(x)), "-_ ", ""))


def wikilinks(text: Column | str) -> Column:
    """Link names in the whole text, front matter too, in order, with repeats."""
    return F.filter(F.transform(F.regexp_extract_all(_c(text), F.lit(K.WIKILINK), F.lit(1)), strip), lambda x: x != "")


def related_titles(items: Column, self_title: Column | None = None) -> Column:
    """Unbracketed, unquoted, without blanks and the page itself, distinct in order."""

    def one(x: Column) -> Column:
        x = F.replace(F.replace(strip(x), F.lit("[["), F.lit("")), F.lit("]]"), F.lit(""))
        x = strip(F.regexp_replace(x, r"^\[+|\]+$", ""))
        return F.regexp_replace(F.regexp_replace(x, '^"+|"+$', ""), "^'+|'+$", "")

    own = strip(self_title) if self_title is not None else F.lit("")
    return F.array_distinct(F.filter(F.transform(items, one), lambda x: (x != "") & ((own == "") | (x != own))))


def related_line(text: Column | str, self_title: Column | None = None) -> Column:
    """T20."""
    return F.concat(F.lit("related: ["), F.array_join(related_titles(field_list(text, "related"), self_title), ", "), F.lit("]"))


def is_negative(x: Column) -> Column:
    """T21."""
    return F.regexp_like(x, F.lit("|".join(K.NEGATIVE)))


def is_positive(x: Column) -> Column:
    """T21."""
    return F.regexp_like(x, F.lit("|".join(K.POSITIVE)))


def is_verify_page(text: Column | str) -> Column:
    """Empty, marked as a verification page, or under MIN_BODY characters once stripped."""
    x = _c(text)
    return (x == "") | F.regexp_like(x, F.lit("|".join(K.VERIFY_MARKS))) | (F.length(strip(x)) < K.MIN_BODY)


def clean_file(text: Column | str) -> Column:
    """No console residue, no runs of blank lines, one newline at the end."""
    x = F.replace(_c(text), F.lit("#< CLIXML"), F.lit(""))
    return F.concat(strip(F.regexp_replace(x, "\n{3,}", "\n\n")), F.lit("\n"))


def body(text: Column | str) -> Column:
    """What follows the front matter, stripped; the whole text where there is none."""
    x = _c(text)
    parts = F.split(x, "---", 3)
    return strip(F.when(x.startswith("---") & (F.size(parts) == 3), F.element_at(parts, F.lit(-1))).otherwise(x))


def source_of(text: Column | str) -> Column:
    """Source field in the block between the first two fences of a text that starts with one; else null."""
    x = _c(text)
    parts = F.split(x, "---", 3)
    block = F.when(x.startswith("---") & (F.size(parts) == 3), F.element_at(parts, F.lit(2)))
    block = F.regexp_replace(block, K.LINE_ENDS, "\n")
    return F.when(F.regexp_like(block, F.lit(rf"(?md)^{K.IN_LINE_WS}*source:")), strip(F.regexp_extract(block, rf"(?md)^{K.IN_LINE_WS}*source:(.*)$", 1)))


def passes_quality(text: Column | str) -> Column:
    """F5 for one file: a body of at least MIN_BODY characters without verification marks."""
    b = body(text)
    return ~((b == "") | F.regexp_like(b, F.lit("|".join(K.VERIFY_MARKS))) | (F.length(b) < K.MIN_BODY))


def backlink_section(text: Column | str) -> Column:
    """The first of the known headings that occurs in the text."""
    x = _c(text)
    out = F.lit(K.NO_SECTION)
    for s in reversed(K.BACKLINK_SECTIONS):
        out = F.when(x.contains(s), F.lit(s)).otherwise(out)
    return out


def section_start(text: Column | str, marker: Column) -> Column:
    """0-based place after the marker; null where it is absent."""
    at = F.instr(_c(text), marker)
    return F.when(at > 0, at - 1 + F.length(marker))


def section_end(text: Column | str, marker: Column) -> Column:
    """0-based place of the line end before the next second-level heading, else the text's length."""
    x, start = _c(text), section_start(text, marker)
    rest = x.substr(start + 1, F.length(x))
    nxt = F.regexp_instr(rest, F.lit(rf"\n##{K.WS}+"))
    return F.when(start.isNotNull(), F.when(nxt > 0, start + nxt - 1).otherwise(F.length(x)))


def insert_in_section(text: Column | str, marker: Column, line: Column) -> Column:
    """The text with a line after the last list line of the marker's section (and the blank lines after it), else at its
    end, else as its only content; the text itself where the marker is absent."""
    x = _c(text)
    start, end = section_start(x, marker), section_end(x, marker)
    sec = x.substr(start + 1, end - start)
    before, after = x.substr(F.lit(1), start), x.substr(end + 1, F.length(x))
    item = r"(?:^|\n)[ \t]*(?:[-*+] |[0-9]+\. )"
    with_items = r"(?s)^((?:.*\n)?[ \t]*(?:[-*+] |[0-9]+\. )[^\n]*(?:\n|$)(?:[ \t\r]*\n)*(?:[ \t\r]+$)?)(.*)$"
    put = F.concat(F.regexp_extract(sec, with_items, 1), line, F.lit("\n"), F.regexp_extract(sec, with_items, 2))
    lead = F.regexp_extract(sec, r"^([\r\n]*)", 1)
    trimmed = F.regexp_replace(F.regexp_replace(sec, r"^[\r\n]+", ""), f"{K.WS}+$", "")
    new = (
        F.when(F.regexp_like(sec, F.lit(item)), put)
        .when(trimmed == "", F.concat(F.lit("\n\n"), line, F.lit("\n")))
        .otherwise(F.concat(lead, trimmed, F.lit("\n\n"), line, F.lit("\n")))
    )
    return F.when(start.isNull(), x).otherwise(F.concat(before, new, after))


def one_decimal(v: Column) -> Column:
    """A double with one digit after the point, rounded by its exact binary value.

    Where 20 v rounds to an odd integer, v lies near a tie: the rounding error of 16 v + 4 v tells on which side.
    """
    x, y = v * 16, v * 4
    s = x + y
    err, t = y - (s - x), ((s - 1) / 2).cast("long")
    up = (err > 0) | ((err == 0) & (t % 2 == 1))
    tenths = t + F.when(up, 1).otherwise(0)
    tied = F.concat((tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when((s == F.floor(s)) & (F.floor(s) % 2 == 1), tied).otherwise(F.format_string("%.1f", v))


def duration(seconds: Column) -> Column:
    """T31."""
    s = seconds.cast("double")
    return F.when(s < 60, F.concat(one_decimal(s), F.lit("秒"))).when(s < 3600, F.concat(one_decimal(s / 60), F.lit("分钟"))).otherwise(F.concat(one_decimal(s / 3600), F.lit("小时")))


def html_text(html: Column | str) -> Column:
    """T22, regular-expression form."""
    x = _c(html)
    for pattern, to in ((r"(?s)<script[^>]*>.*?</script>", ""), (r"(?s)<style[^>]*>.*?</style>", ""), (r"<br\s*/?>", "\n"), (r"</?p[^>]*>", "\n"), (r"</?div[^>]*>", "\n"), (r"<[^>]+>", ""), ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), (r"\n{3,}", "\n\n")):
        x = F.regexp_replace(x, pattern, to)
    return strip(x)


def display_path(path: Column, base: Column) -> Column:
    """Relative to the base where it lies under it, else as it is."""
    root = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"))
    return F.when(path.startswith(root), path.substr(F.length(root) + 1, F.length(path))).otherwise(path)
