"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as the inside of a Java character class.
SPACE = r"\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
HAN = r"\p{IsHan}"
CHUNK = 6000


def uni_trim(s: Column) -> Column:
    """Without white space of any script at the ends; SQL trim knows only the space."""
    return F.regexp_replace(s, f"^[{SPACE}]+|[{SPACE}]+$", "")


def line_trim(s: Column) -> Column:
    """uni_trim of a column: its ends are looked at first, as the pattern tries every place of the text."""
    return F.when(F.concat(F.left(s, F.lit(1)), F.right(s, F.lit(1))).rlike(f"[{SPACE}]"), uni_trim(s)).otherwise(s)


def squeezed(s: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(s, f"[{SPACE}]+", "")


def collapsed(s: Column) -> Column:
    """Runs of spaces and tabs become one space, three or more newlines two."""
    return uni_trim(F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def count_matches(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern))


def occurrences(s: Column, char: str) -> Column:
    """How often one character occurs, from lengths alone."""
    return F.length(s) - F.length(F.translate(s, char, ""))


def any_word(s: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of the words, tried one after the other."""
    test = F.contains(s, F.lit(words[0]))
    for w in words[1:]:
        test = test | F.contains(s, F.lit(w))
    return test


def han_block_count(s: Column) -> Column:
    """Characters from U+4E00 to U+9FFF."""
    return count_matches(s, r"[\u4E00-\u9FFF]")


def han_count(s: Column) -> Column:
    return count_matches(s, HAN)


def wide_count(s: Column) -> Column:
    """Characters beyond ASCII that are not white space."""
    return count_matches(s, rf"[^\x00-\x7F{SPACE}]")


def ascii_words(s: Column) -> Column:
    return count_matches(s, "[A-Za-z]+")


def words(s: Column) -> Column:
    """Fields between white space."""
    return count_matches(s, f"[^{SPACE}]+")


def is_foreign(s: Column) -> Column:
    """More ASCII letters than wide characters."""
    return count_matches(s, "[A-Za-z]") > wide_count(s)


def mostly_ascii(s: Column) -> Column:
    """At least half of the visible characters are ASCII; false for none."""
    seen = squeezed(s)
    return (F.length(seen) > 0) & (count_matches(seen, r"[\x00-\x7F]") * 2 >= F.length(seen))


def han_ratio(s: Column) -> Column:
    return F.when(F.length(s) > 0, han_block_count(s) / F.length(s)).otherwise(0.0)


def chunks(s: Column, size: int = CHUNK) -> Column:
    """Consecutive pieces of `size` characters; none for the empty text."""
    n = F.ceil(F.length(s) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(s, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def shortened(s: Column, n: int) -> Column:
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n)), F.lit("..."))).otherwise(s)


def key_value(s: Column) -> Column:
    """(key, value) around the first full-width or else half-width colon; null if a side is empty."""
    cut = F.when(F.contains(s, F.lit("：")), F.lit("：")).otherwise(F.lit(":"))
    at = F.locate("：", s)
    at = F.when(at > 0, at).otherwise(F.locate(":", s))
    key, value = uni_trim(F.substring(s, F.lit(1), at - 1)), uni_trim(F.substring(s, at + F.length(cut), F.length(s)))
    return F.when((at > 0) & (key != "") & (value != ""), F.struct(key.alias("key"), value.alias("value")))


def keywords(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, "[，、；;,]"), uni_trim), lambda k: k != "")


def html_text(s: Column) -> Column:
    """Visible text: script and style blocks go, tags become spaces, six entities are decoded, white space collapses."""
    bare = F.regexp_replace(s, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return uni_trim(F.regexp_replace(bare, f"[{SPACE}]+", " "))


def rtf_text(s: Column) -> Column:
    """RTF without groups of settings and control words."""
    bare = F.regexp_replace(s, r"\{\\\*[^{}]*\}|\{\\(fonttbl|colortbl|stylesheet|info)[^{}]*(\{[^{}]*\}[^{}]*)*\}", "")
    bare = F.regexp_replace(bare, r"\\par[d]?\b ?", "\n")
    return collapsed(F.regexp_replace(F.regexp_replace(bare, r"\\[a-z]+-?\d* ?", ""), r"[{}]", ""))


def sniffed(head: Column) -> Column:
    """The file type that the first bytes (binary) show; null under four bytes, empty if unknown."""
    text = F.lower(F.decode(F.substring(head, 1, 16), "ISO-8859-1"))
    hexed = F.hex(F.substring(head, 1, 4))
    return (
        F.when(F.octet_length(head) < 4, None)
        .when(hexed == "504B0304", "docx")
        .when(hexed == "D0CF11E0", "doc")
        .when(hexed == "25504446", "pdf")
        .when(text.startswith("{\\rtf"), "rtf")
        .when(text.startswith("<!doc") | text.startswith("<html"), "html")
        .otherwise("")
    )


def heading_level(s: Column) -> Column:
    """1 to 3 by the number that a heading starts with, 0 for other text; patterns are tried from the deepest."""
    rest = F.regexp_replace(s, r"^[(（]\d+[)）]", "")
    return (
        F.when(s.rlike(r"^\d+\.\d+\.\d+"), 3)
        .when(s.rlike(r"^[(（]\d+[)）]"), F.when(F.length(rest) <= 20, 3).otherwise(0))
        .when(s.rlike(r"^\d+\.\d+") | s.rlike(r"^[(（][一二三四五六七八九十]+[)）]"), 2)
        .when(s.rlike(r"^([一二三四五六七八九十]+|\d+)[、.]") | s.rlike(r"^第[一二三四五六七八九十\d]+[章节]") | s.rlike(r"^\d+ +[^\d ]"), 1)
        .otherwise(0)
    )


def caption(s: Column) -> Column:
    """(label, format, chapter, ordinal) of a caption such as `Figure 2-3 ...`; null for other text, and for numbers beyond an int."""
    part = lambda i: F.regexp_extract(s, r"^(图|表|Figure|Table) *(?:(\d+)([.-]))?(\d+)", i)
    form = F.when(part(3) == ".", "chapter_dot").when(part(3) == "-", "chapter_hyphen").otherwise("simple")
    return F.when(part(1) != "", F.struct(part(1).alias("label"), form.alias("format"), part(2).try_cast("int").alias("chapter"), part(4).try_cast("int").alias("ordinal")))


def is_toc_line(s: Column) -> Column:
    """A tab before a final page number, or leader dots."""
    return s.rlike(r"\t\d+$") | (count_matches(s, "…") >= 2) | (count_matches(s, r"\.") > 5) | (count_matches(s, "·") > 5)


def title_case(s: Column) -> Column:
    """Words in title case, but for hyphenated ones, `pH` and capitals of more than one letter."""

    def word(w: Column) -> Column:
        return F.when(F.contains(w, F.lit("-")) | (w == "pH") | w.rlike("^[A-Z]{2,}$"), w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1_000_000))))

    return F.array_join(F.transform(F.split(s, " "), word), " ")


def roman(n: Column) -> Column:
    """Roman digits, empty under 1."""
    # Roman numerals.
    steps = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
    out, left = F.lit(""), n
    for value, digits in steps:
        out = F.concat(out, F.repeat(F.lit(digits), F.floor(left / value).cast("int")))
        left = left % value
    return F.when(n > 0, out).otherwise("")


def first_year(s: Column) -> Column:
    return F.regexp_extract(s, r"20[2-3]\d", 0)


def masked_code(s: Column) -> Column:
    """The ends of a code; under nine characters as it is."""
    return F.when(F.length(s) < 9, s).otherwise(F.concat(F.left(s, F.lit(4)), F.lit("-****-"), F.right(s, F.lit(4))))


def code_hash(s: Column) -> Column:
    return F.sha2(F.upper(F.regexp_replace(s, "[- ]", "")), 256)


def safe_filename(s: Column) -> Column:
    return F.regexp_replace(s, r'[<>:"/\\|?*]', "_")


def font_key(s: Column) -> Column:
    """Lower case, without a subset prefix, spaces, hyphens and underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), r"^[^+]*\+", ""), "[ _-]", "")


def json_array_part(s: Column) -> Column:
    """From the first [ to the last ]; the text itself if there is none."""
    part = F.regexp_extract(s, r"(?s)\[.*\]", 0)
    return F.when(part != "", part).otherwise(s)


def twips(cm: Column) -> Column:
    return F.floor(cm * 567 + 0.5)


def line_twips(s: Column) -> Column:
    """Line spacing text in twips: names, multiples (`2倍`), points (`20磅`, `20pt`), bare numbers; 0 if unknown."""
    number = F.regexp_extract(s, r"^\D*?(\d+(?:\.\d+)?)", 1).try_cast("double")
    named = F.when(s == "single", 240.0).when(s == "1.5", 360.0).when(s == "double", 480.0)
    sized = F.when(s.rlike("倍$"), number * 240).when(s.rlike("(磅|pt)$"), number * 20).when(s.rlike(r"^\d+(\.\d+)?$"), F.when(number <= 10, number * 240).otherwise(number))
    return F.coalesce(named, sized, F.lit(0.0))


def permitted(code: Column, method: Column, resource: Column, verb: Column) -> Column:
    """Whether permission (code `resource:action`, method) covers a request; `*` covers all."""
    prefix = F.substring_index(code, ":", 1)
    verbs = F.when(method == "read", "GET").when(method == "create", "POST").when(method == "update", "PUT").when(method == "delete", "DELETE")
    return ((prefix == "*") | (prefix == resource)) & ((method == "*") | (verbs == verb))


def fallback_text(s: Column) -> Column:
    """Printable ASCII, Han characters and line ends of what is left of a file; null under ten bytes."""
    kept = F.regexp_replace(s, r"[^\x20-\x7E一-鿿\n\r]", "")
    return F.when(F.octet_length(kept) >= 10, kept)


# Han characters that text uses often lie from U+5000 to U+9000; the rest of the block counts as rare.
OFTEN, RARELY = r"[\u5000-\u9000]", r"[\u4E00-\u4FFF\u9001-\u9FFF]"


def is_garbage(line: Column) -> Column:
    """Whether a line looks like bytes read as Han characters: rare ones prevail, or many without any punctuation."""
    n, rare, common = F.length(line), count_matches(line, RARELY), count_matches(line, OFTEN)
    marks, plain = count_matches(line, "[，。、：；“”（）《》]"), count_matches(line, "[A-Za-z0-9]")
    mixed = (n > 30) & (marks == 0) & (rare + common > F.floor(n / 2)) & (plain > F.floor(n / 4))
    return (n >= 3) & (((rare * 2 > n) & (marks == 0)) | mixed | ((n > 10) & (rare > 5) & (common < F.floor(rare / 2))))


def cleaned_lines(s: Column) -> Column:
    """The lines of a text that say something: none that are blank, of one character, garbage or mostly control characters."""
    lines = F.transform(F.split(s, "\n"), uni_trim)
    return F.array_join(F.filter(lines, lambda x: (F.length(x) >= 2) & ~is_garbage(x) & (count_matches(x, r"[^\x00-\x1F]") * 2 >= F.length(x))), "\n")


def after_marker(s: Column, marker: str) -> Column:
    """What follows a section's marker and a colon or semicolon; empty for the marker alone, null for other text."""
    whole = uni_trim(s)
    rest = uni_trim(F.substring(whole, len(marker) + 1, 1 << 30))
    return F.when(whole.startswith(marker) & rest.rlike("^([：:；;]|$)"), uni_trim(F.regexp_replace(rest, "^([：:]|[；;]+)", "")))


def science_depth(s: Column) -> Column:
    """The parts of a decimal heading number, four at most; 0 without one."""
    number = F.regexp_extract(uni_trim(s), r"^\d+(\.\d+){0,3}", 0)
    return F.when(number == "", 0).otherwise(F.size(F.split(number, r"\.")))


def arts_depth(s: Column) -> Column:
    """The depth of a heading numbered `一、`, `（一）`, `1.` or `（1）`; 0 for other text."""
    t = uni_trim(s)
    return F.when(t.rlike("^[一二三四五六七八九十]+、"), 1).when(t.rlike(r"^(（[一二三四五六七八九十]+）|\([一二三四五六七八九十]+\))"), 2).when(t.rlike(r"^\d+\."), 3).when(t.rlike(r"^(（\d+）|\(\d+\))"), 4).otherwise(0)


def _first_place(lines: Column, test) -> Column:
    return F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull()))


def let(value: Column, body) -> Column:
    """body with value worked out once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def section_by_heading(s: Column, starts: list[str], ends: list[str]) -> Column:
    """The lines after the first one that is a start, or begins with it and a space, up to one that begins with an end."""
    any_of = lambda tests: tests[0] if len(tests) == 1 else tests[0] | any_of(tests[1:])
    begins = lambda low: _first_place(low, lambda x: any_of([(x == w.lower()) | x.startswith(w.lower() + " ") for w in starts])) + 1
    ended = lambda rest: F.coalesce(_first_place(rest, lambda x: any_of([x.startswith(w.lower()) for w in ends])), F.size(rest))
    lower = lambda lines: F.transform(lines, lambda x: uni_trim(F.lower(x)))

    def cut(lines: Column) -> Column:
        return let(begins(lower(lines)), lambda start: F.when(start < F.size(lines), let(F.slice(lines, start + 1, F.size(lines)), lambda rest: F.array_join(F.slice(rest, 1, ended(lower(rest))), "\n"))).otherwise(""))

    return F.coalesce(let(F.split(s, "\n"), cut), F.lit(""))


# The title of the references, and what ends them.
REFERENCES_TITLE, AFTER_REFERENCES = "参考文献", ("附录", "致谢", "攻读", "声明")


def reference_lines(s: Column, title: str = REFERENCES_TITLE, ends: tuple[str, ...] = AFTER_REFERENCES) -> Column:
    """Lines after the title up to an end that are numbered or hold a Latin letter."""
    last = "^(" + "|".join(w.lower() for w in ends) + ")"

    def cut(lines: Column) -> Column:
        start = _first_place(F.transform(lines, F.lower), lambda x: x.startswith(title.lower())) + 1
        listed = lambda rest: F.slice(rest, 1, F.coalesce(_first_place(rest, lambda x: F.lower(x).rlike(last)), F.size(rest)))
        return let(F.slice(lines, start + 1, F.size(lines)), lambda rest: F.filter(listed(rest), lambda x: x.rlike(r"^(\[\d+\]|\d+\.)|[A-Za-z]")))

    return F.coalesce(let(F.transform(F.split(s, "\n"), uni_trim), cut), F.array().cast("array<string>"))


def spaced_heading_numbers(s: Column) -> Column:
    """A space after heading numbers (one digit, or up to two dots) that stand at the start or after white space."""
    return F.regexp_replace(s, r"(?<![^ \t\n\r])([1-9](?:[0-9]*(?:\.[0-9]*){1,2})?)(?<!\.)(?=[^0-9. \t\n\r])", "$1 ")


# Words that make a text after a single number a heading.
SINGLE_HEADING_WORDS = ("绪论", "引言", "研究", "对象", "方法", "结果", "分析", "结论", "总结", "参考文献", "致谢")


# Headings of the state of research, by pattern, and as they should read.
RESEARCH_STATES = (
    (r"^\d+\.\d+\s*国内外研究现状[：:]?\s*(\d*)$", "1.4 国内外研究现状"),
    (r"^\d+\.\d+\.\d+\s*国外研究现状[：:]?\s*(\d*)$", "1.4.1 国外研究现状"),
    (r"^\d+\.\d+\.\d+\s*国内(?:研究)?现状[：:]?\s*(\d*)$", "1.4.2 国内研究现状"),
)


def visible_text(s: Column) -> Column:
    """Headings and dates as they should read; the first rule that fits rewrites the trimmed text, others leave it alone."""
    t = uni_trim(s)
    numbered = lambda text, page: F.when(page == "", text).otherwise(F.concat(text, F.lit(" "), page))
    part = lambda pattern, i: F.regexp_extract(t, pattern, i)
    date, single = r"^(\d{4})年\s*(\d{1,2})\s*月", r"^([1-9]|1[0-9]|20)([\p{IsHan}A-Za-z].*?)(\d*)$"
    found = F.when(t.rlike(date), F.concat(part(date, 1), F.lit("年"), part(date, 2), F.lit("月")))
    for pattern, title in RESEARCH_STATES:
        found = found.when(t.rlike(pattern), numbered(F.lit(title), part(pattern, 1)))
    found = found.when(F.contains(t, F.lit("结论/总结")), F.replace(t, F.lit("结论/总结"), F.lit("结论")))
    found = found.when(t.rlike(r"^\d+(\.\d+)+[\p{IsHan}A-Za-z]"), F.regexp_replace(t, r"^(\d+(?:\.\d+)+)(?=[\p{IsHan}A-Za-z])", "$1 "))
    title = part(single, 2)
    is_title = (title != "") & (F.length(uni_trim(title)) <= 30) & title.rlike("|".join(SINGLE_HEADING_WORDS))
    return found.when(is_title, numbered(F.concat(part(single, 1), F.lit(" "), uni_trim(title)), part(single, 3))).otherwise(s)


# Names of font sizes, in points.
FONT_SIZES = {"初": 42.0, "小初": 36.0, "一": 26.0, "小一": 24.0, "二": 22.0, "小二": 18.0, "三": 16.0, "小三": 15.0, "四": 14.0, "小四": 12.0, "五": 10.5, "小五": 9.0, "六": 7.5, "小六": 6.5, "七": 5.5, "八": 5.0}


def font_points(s: Column) -> Column:
    """A font size by name or in points; 12 for anything else."""
    name = F.regexp_replace(uni_trim(s), "号$", "")
    table = F.create_map(*[F.lit(x) for pair in FONT_SIZES.items() for x in pair])
    number = uni_trim(F.regexp_replace(F.regexp_replace(name, "pt$", ""), "磅$", "")).try_cast("double")
    return F.coalesce(F.try_element_at(table, name), F.when(number > 0, number), F.lit(12.0))


def repaired_unit(s: Column) -> Column:
    """Lengths whose unit lost a letter, in full."""
    return F.when(s == "2.54", "2.54cm").when(s.rlike(r"^\d+(\.\d+)?c$"), F.concat(s, F.lit("m"))).otherwise(s)


def chinese_number(n: Column) -> Column:
    """1 to 5 as Chinese numerals, other numbers as they are."""
    return F.coalesce(F.get(F.split(F.lit("一,二,三,四,五"), ","), (n - 1).cast("int")), n.cast("string"))


def scaled_widths(widths: Column, total: Column) -> Column:
    """Widths in proportion that add up to total: rounded half up, at least 1, the last takes what is left; zeros without any width."""
    whole = F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)
    most = F.transform(widths, lambda x: F.greatest(F.floor(x * total / whole + 0.5), F.lit(1).cast("long")))
    head = F.slice(most, 1, F.size(most) - 1)
    last = total - F.aggregate(head, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(whole > 0, F.concat(head, F.array(last))).otherwise(F.transform(widths, lambda x: F.lit(0).cast("long")))


# Settings of payment providers that are secret, and the order of access levels.
SECRETS = {"alipay": ("private_key", "alipay_public_key"), "wechat": ("api_key", "api_v3_key", "platform_public_key")}
LEVELS = {"read": 1, "write": 2, "admin": 3}


def masked_settings(provider: Column, settings: Column) -> Column:
    """A provider's map of settings with six stars for secrets."""
    secret = lambda k: F.coalesce(*[F.when(provider == name, k.isin(*keys)) for name, keys in SECRETS.items()], F.lit(False))
    return F.transform_values(settings, lambda k, v: F.when(secret(k), "******").otherwise(v))


def level_allows(current: Column, required: Column) -> Column:
    """Whether an access level covers another; unknown levels cover nothing and are covered by none."""
    table = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, current) >= F.try_element_at(table, required), F.lit(False))


def parse_quality(coverage: Column, success: Column, verified: Column, schema: Column) -> Column:
    """(score, grade) of a parsed format text: a weighted mean, high from 0.98 on."""
    score = F.round(coverage * 0.35 + success * 0.30 + verified * 0.20 + schema * 0.15, 4)
    return F.struct(score.alias("score"), F.when(score >= 0.98, "high").otherwise("review").alias("grade"))


def paragraph_chunks(s: Column) -> Column:
    """The parts between blank lines, or the lines where there is one part at most; empty ones go."""
    cut = lambda pattern: F.filter(F.transform(F.split(s, pattern), lambda x: F.regexp_replace(x, r"^[ \t\n\r]+|[ \t\n\r]+$", "")), lambda x: x != "")
    parts = cut(r"\n[ \t]*\n")
    return F.when(F.size(parts) <= 1, cut("\n")).otherwise(parts)
