"""Lexical analysis as column expressions: normalisation, scripts, tokens, stop phrases, numerals, tags.

All are null in, null out unless said otherwise, and run inside whole-stage code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width forms and their half-width partners.
FULL = "　" + "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF = " " + "".join(chr(c) for c in range(0x21, 0x7F))
#: A sample table from traditional to simplified characters; callers pass their own for more.
TRADITIONAL, SIMPLIFIED = "檢視標題頁碼關鍵詞數據庫記錄", "检视标题页码关键词数据库记录"
#: Words dropped from queries.
STOP = ["the", "a", "an", "is", "are", "was", "were", "be", "of", "to", "in", "on", "at", "for", "and", "or", "by", "with", "what", "who", "how", "which", "where", "why", "when", "please", "this", "that", "it", "its", "do", "does"]
QUERY_SYNTAX = r'([:\\{}()\[\]\-*"~^|+!/])'
NUMERALS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12}
#: Common one-character family names.
SURNAMES = "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def halfwidth(text: Column | str) -> Column:
    """Full-width letters, digits, marks and blanks to their half-width forms."""
    return F.translate(c(text), FULL, HALF)


def simplified(text: Column | str, source: str = TRADITIONAL, target: str = SIMPLIFIED) -> Column:
    return F.translate(c(text), source, target)


def squeezed(text: Column | str) -> Column:
    """Lower case; every run of other than letters, digits and underscores becomes one blank."""
    return F.trim(F.regexp_replace(F.lower(c(text)), r"[^\p{L}\p{N}_]+", " "))


def tokens(text: Column | str) -> Column:
    """Words of a text after normalisation; an empty array for null and blank texts."""
    words = F.split(squeezed(halfwidth(text)), " ")
    return F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: w != "")


def script_runs(text: Column | str) -> Column:
    """Runs of ideographs and of other non-blank characters, in order."""
    return F.regexp_extract_all(c(text), F.lit(r"[一-龥]+|[^一-龥 ]+"), F.lit(0))


def english_share(text: Column | str) -> Column:
    """Share of a text's characters in the ASCII class of English text; null for empty texts."""
    t = c(text)
    return F.length(F.regexp_replace(t, r"[^`a-zA-Z0-9\s.,':;/\"?<>!()-]", "")) / F.nullif(F.length(t), F.lit(0))


def is_english(text: Column | str) -> Column:
    return F.coalesce(english_share(text) > 0.8, F.lit(False))


def is_chinese(text: Column | str) -> Column:
    """More than a fifth of the characters are ideographs."""
    t = c(text)
    return F.coalesce(F.length(F.regexp_replace(t, "[^一-鿿]", "")) / F.nullif(F.length(t), F.lit(0)) > 0.2, F.lit(False))


def question_is_chinese(text: Column | str) -> Column:
    """Query mode: at most three words, or at least 70 % of the words not purely alphabetic."""
    words = F.split(F.trim(c(text)), r"[ \t]+")
    odd = F.size(F.filter(words, lambda w: ~w.rlike("^[a-zA-Z]+$")))
    return (F.size(words) <= 3) | (odd / F.size(words) >= 0.7)


def without_stop_phrases(text: Column | str, stop: list[str] = STOP) -> Column:
    """Drop stop words; a text of stop words only stays as it is."""
    t = c(text)
    rest = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?i)(^|[^a-z])(?:" + "|".join(stop) + r")(?:[^a-z](?:" + "|".join(stop) + r"))*($|[^a-z])", "$1$2"), " +", " "))
    return F.when(rest == "", t).otherwise(rest)


def spaced_scripts(text: Column | str) -> Column:
    """A blank at every border between ideographs and Latin letters or digits."""
    a = F.regexp_replace(c(text), "([A-Za-z0-9])([一-龥])", "$1 $2")
    return F.regexp_replace(a, "([一-龥])([A-Za-z0-9])", "$1 $2")


def without_han_spaces(text: Column | str) -> Column:
    """Remove blanks that have no letter, digit or Latin mark on either side."""
    a = F.regexp_replace(c(text), r"([^a-z0-9.,)>]) +([^ ])", "$1$2")
    return F.regexp_replace(a, r"([^ ]) +([^a-z0-9.,(<])", "$1$2")


def escaped(text: Column | str) -> Column:
    """Query-syntax characters behind a backslash."""
    return F.trim(F.regexp_replace(c(text), QUERY_SYNTAX, r"\\$1"))


def truncated(text: Column | str, n: int) -> Column:
    """The first ``n`` blank-separated tokens."""
    return F.array_join(F.slice(F.split(c(text), " "), 1, n), " ")


def without_table_tags(text: Column | str) -> Column:
    return F.regexp_replace(c(text), r"</?(?:table|td|caption|tr|th)(?: [^<>]{0,12})?>", " ")


def clean_name(text: Column | str) -> Column:
    """Entity names: entities unescaped, quotes and control characters dropped, upper case."""
    t = c(text)
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(value))
    return F.trim(F.upper(F.regexp_replace(t, r'["\x00-\x1f\x7f-\x9f]', "")))


def split_markers(text: Column | str, markers: list[str]) -> Column:
    """Split at any marker; parts trimmed, blank ones dropped."""
    parts = F.split(c(text), "|".join(re.escape(m) for m in markers))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def is_float(text: Column | str) -> Column:
    return F.coalesce(c(text).rlike(r"^\s*[+-]?([0-9]*\.[0-9]+|[0-9]+\.?)\s*$"), F.lit(False))


def between_tags(text: Column | str, tag: str) -> Column:
    return F.regexp_extract_all(c(text), F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))


def delimiter_pattern(spec: str) -> str:
    """Alternation of a delimiter spec: back-quoted strings and single characters, longest first."""
    quoted = re.findall(r"`([^`]+)`", spec)
    single = list(re.sub(r"`[^`]+`", "", spec))
    return "|".join(re.escape(d) for d in sorted({*quoted, *single}, key=lambda d: (-len(d), d)) if d)


def numeral(text: Column | str) -> Column:
    """Digits, English words, Chinese and Roman numerals to an int; -1 where none fits."""
    t = F.lower(F.trim(c(text)))
    table = F.create_map(*[F.lit(x) for kv in {**NUMERALS, **ROMAN}.items() for x in kv])
    return F.coalesce(F.when(t.rlike("^[0-9]{1,9}$"), t.try_cast("int")), F.try_element_at(table, t), F.lit(-1))


def without_qa_prefix(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(c(text), r"(?i)^(?:问题|答案|回答|问|答|question|answer|user|assistant|q|a)[\t:： ]+", ""))


def without_position_tags(text: Column | str) -> Column:
    return F.regexp_replace(c(text), r"@@[\t0-9.-]+?##", "")


def starts_with_surname(text: Column | str, names: str = SURNAMES) -> Column:
    return F.coalesce(F.instr(F.lit(names), F.substring(c(text), 1, 1)) > 0, F.lit(False)) & (F.length(c(text)) > 0)


def boolean_text(text: Column | str) -> Column:
    """'yes' or 'no' for the usual glyphs and words of either, else null."""
    t = F.lower(F.trim(c(text)))
    return F.when(t.rlike("^(true|yes|是|\\*|✓|✔|☑|✅|√)$"), "yes").when(t.rlike("^(false|no|否|⍻|×)$"), "no")


DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "yyyyMMdd"]


def date_text(text: Column | str) -> Column:
    """Any of the known date forms as 'yyyy-MM-dd HH:mm:ss', else null."""
    t = c(text)
    return F.date_format(F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS]), "yyyy-MM-dd HH:mm:ss")


def column_name(text: Column | str) -> Column:
    """Header to column name: aliases after a slash and enumerations in brackets dropped, other marks to underscores."""
    t = F.regexp_replace(c(text), r"(/.*|（[^（）]+?）|\([^()]+?\))", "")
    return F.lower(F.trim(F.regexp_replace(F.trim(t), r"[^\p{L}\p{N}]+", "_")))


def without_thinking(text: Column | str) -> Column:
    return F.regexp_replace(c(text), r"(?s)^.*</think>", "")


def without_fences(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c(text), r"(?s)^\s*```[a-z]*\s*", ""), r"(?s)\s*```\s*$", ""))


def split_parts(text: Column | str, delimiters: list[str]) -> Column:
    """Parts between delimiters, the delimiters dropped."""
    return F.split(c(text), "|".join(re.escape(d) for d in delimiters))


def filled(template: str, **values: Column) -> Column:
    """A template with {name} slots; null values fill as empty."""
    out, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        out += [F.lit(template[at : m.start()]), F.coalesce(values[m.group(1)].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))


def bigrams(words: Column) -> Column:
    """Adjacent pairs of an array of words, joined by a blank."""
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def char_bigrams(text: Column) -> Column:
    """Distinct two-character pieces."""
    n = F.length(text)
    return F.when(n > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def key_lines(joint: str = "\n", **values: Column) -> Column:
    """'name: value' lines of the values that are not null or blank, in the order given, for a prompt."""
    parts = F.array(*[F.when(F.trim(v.cast("string")) != "", F.concat(F.lit(f"{n}: "), v.cast("string"))) for n, v in values.items()])
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), joint)


def message(key: Column, templates: list[str], **values: Column) -> Column:
    """One of several templates, by the remainder of an integer key, with its {name} slots filled."""
    out = None
    for i, t in enumerate(templates):
        names = set(re.findall(r"\{(\w+)\}", t))
        text = filled(t, **{n: v for n, v in values.items() if n in names}) if names else F.lit(t)
        cond = F.pmod(key, F.lit(len(templates))) == i
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out
