"""Text expressions: normalising, tokens, terms, numbers, flags. All stay in the JVM unless said."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Words, patterns and classes that results depend on.
FONT_MARK = r"(?s)字体白名单\s*[:：]\s*(.+)"
STOP_TERMS = ["什么", "哪些", "怎么", "如何", "为什么", "论文", "这篇", "作者"]
SECTION_ROLES = [
    ("abstract", ["abstract", "摘要"]),
    ("introduction", ["introduction", "引言", "绪论"]),
    ("related_work", ["related work", "background", "相关工作"]),
    ("dataset", ["dataset", "data set", "数据集", "data and feature"]),
    ("experiment", ["experiment", "implementation", "实验", "evaluation"]),
    ("result", ["result", "comparison", "结果", "analysis"]),
    ("ablation", ["ablation", "消融"]),
    ("method", ["method", "approach", "model", "方法"]),
    ("limitation", ["limitation", "future work", "局限", "不足"]),
    ("conclusion", ["conclusion", "总结", "结论"]),
    ("reference", ["reference", "bibliography", "参考文献"]),
    ("appendix", ["appendix", "supplement", "附录"]),
]
QUESTION_ROLES = {
    "experiment": ["实验", "结果", "数据集", "experiment", "result", "dataset"],
    "method": ["方法", "模型", "架构", "method", "model", "architecture"],
    "introduction": ["问题", "背景", "动机", "problem", "background", "motivation"],
    "conclusion": ["结论", "贡献", "局限", "conclusion", "contribution", "limitation"],
}
DIAERESIS, HIGH_MARK = "¨", "~"
#: Blanks that character-spaced formulas have too many of; a blank after a command is kept by a mark meanwhile.
FORMULA_RULES = [
    (r"(\\[A-Za-z]+)\s+(?=[A-Za-z])", "$1\x00"), (r"(?<=[A-Za-z])\s+(?=[A-Za-z])", ""), (r"(?<=[A-Za-z])\s+_\s*", "_"), (r"(?<=[A-Za-z])\s+\\_\s*", "\\\\_"), (r"(?<=_)\s+(?=[A-Za-z{])", ""),
    (r"(?<=\\_)\s+(?=[A-Za-z])", ""), (r"(?<=\d)\.\s+(?=\d)", "."), (r"(?<=[{^])\s+(?=-\s*\d)", ""), (r"(?<=-)\s+(?=\d)", ""),
]
NUMBER = r"(?U)(?<![\w.])[-+]?\d+(?:\.\d+)?%?(?![\w.])"
UUID_NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_each(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: None if xs is None else [unicodedata.normalize("NFKC", x) for x in xs])


@F.pandas_udf(StringType())
def _bare_letters(s: pd.Series) -> pd.Series:
    """NFKD without combining marks, case-folded."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).casefold())


def nfkc(text: Column) -> Column:
    """NFKC. ASCII text is its own NFKC; only other texts travel to the Python worker."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def letters_key(text: Column) -> Column:
    """Word characters alone, case-folded, of the NFKC form; empty for null."""
    return _bare_key(nfkc(F.coalesce(text, F.lit(""))))


def letters_keys(texts: Column) -> Column:
    """``letters_key`` of each of an array's texts."""
    given = F.transform(texts, lambda x: F.coalesce(x, F.lit("")))
    other = F.exists(given, lambda x: x.rlike(r"[^\x00-\x7F]"))
    return F.transform(F.coalesce(_nfkc_each(F.when(other, given)), given), _bare_key)


def _bare_key(text: Column) -> Column:
    bare = F.regexp_replace(text, r"(?U)[^\w]+", "")
    return F.replace(F.lower(bare), F.lit("ß"), F.lit("ss"))  # a plain lower(upper(...)) is simplified to lower(...)


def sort_key(name: Column) -> Column:
    """Case-folded Latin letters of a name, null if it has none. A diaeresis that stands alone, as some fonts print
    it, is kept as a mark behind all letters. ASCII names stay in the JVM."""
    marked = F.translate(name, DIAERESIS, HIGH_MARK)
    bare = F.coalesce(_bare_letters(F.when(marked.rlike(r"[^\x00-\x7F]"), marked)), F.lower(marked))
    return F.nullif(F.regexp_replace(bare, f"[^a-z{HIGH_MARK}]", ""), F.lit(""))


def normalize_spacing(text: Column) -> Column:
    """Everything of text normalising but NFKC: soft hyphens, line ends, runs of blanks, empty lines."""
    t = F.coalesce(text, F.lit(""))
    t = F.replace(t, F.lit("­"), F.lit(""))
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t\f\x0B]+", " ")
    t = F.regexp_replace(t, r" *\n *", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(t)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def unwrap(text: Column) -> Column:
    """Joins words hyphenated at a line's end and lines that run on."""
    t = F.regexp_replace(text, r"(?<=[A-Za-z])[-‐]\n(?=[a-z])", "")
    t = F.regexp_replace(t, r"(?<![.!?:;\n])\n(?=[a-z])", " ")
    return strip(t)


def formula_spacing(formula: Column) -> Column:
    """A formula without the blanks that character by character recognition puts between its parts."""
    t = normalize_spacing(nfkc(formula))
    for pattern, put in FORMULA_RULES:
        t = F.regexp_replace(t, pattern, put)
    return F.replace(t, F.lit("\x00"), F.lit(" "))


def normalize_prose(text: Column) -> Column:
    return unwrap(normalize_spacing(nfkc(text)))


def quality_flags(text: Column, require_text: bool = False) -> Column:
    """Names of what is odd about a text, in a fixed order."""
    flags = [
        F.when(text.contains("�"), "replacement_character"),
        F.when(text.contains("??"), "unresolved_placeholder"),
        F.when(text.rlike(r"(?U)\b(?:[A-Za-z]\s){5,}[A-Za-z]\b"), "possible_spaced_ocr_text"),
    ]
    if require_text:
        flags.insert(0, F.when(strip(text) == "", "empty_text"))
    return F.array_compact(F.array(*flags))


def estimate_tokens(text: Column) -> Column:
    words = F.regexp_count(text, F.lit(r"[A-Za-z0-9_]+"))
    cjk = F.regexp_count(text, F.lit(r"[㐀-鿿]"))
    symbols = F.regexp_count(text, F.lit(r"(?U)[^\w\s㐀-鿿]"))
    return F.greatest(F.lit(1), words + F.floor((cjk + 1) / 2) + F.floor(symbols / 4)).cast("long")


def uuid5_url(name: Column) -> Column:
    """UUID version 5 in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(UUID_NAMESPACE_URL)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def classify_section(path: Column) -> Column:
    """Role of a section by its titles; the first that fits."""
    value = F.lower(F.array_join(path, " "))
    role = F.lit("body")
    for name, words in reversed(SECTION_ROLES):
        fits = value.contains(words[0])
        for w in words[1:]:
            fits = fits | value.contains(w)
        role = F.when(fits, name).otherwise(role)
    return role


def question_terms(question: Column) -> Column:
    """Distinct terms of a question: latin words, numbers, runs of Chinese characters with their pairs
    and triples."""
    latin = F.regexp_extract_all(F.lower(question), F.lit(r"[a-z][a-z0-9_-]+"), F.lit(0))
    numbers = F.regexp_extract_all(question, F.lit(r"(?U)\d+(?:\.\d+)?%?"), F.lit(0))
    runs = F.regexp_extract_all(question, F.lit(r"[一-鿿]{2,}"), F.lit(0))
    parts = lambda n: F.flatten(F.transform(runs, lambda r: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.substring(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))))
    chinese = F.array_except(F.concat(runs, parts(2), parts(3)), F.array(*[F.lit(s) for s in STOP_TERMS]))
    return F.array_distinct(F.concat(latin, numbers, chinese))


def relevance(content: Column, terms: Column) -> Column:
    """Share of the terms that a text holds, 0.01 at least."""
    low = F.lower(content)
    found = F.size(F.filter(terms, lambda t: F.contains(low, t)))
    return F.when(found > 0, found / F.size(terms)).otherwise(F.lit(0.01))


def numbers_in(text: Column) -> Column:
    """Canonical numbers of a text, distinct: trailing zeros go, a percent sign stays."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), canonical_number))


def canonical_number(raw: Column) -> Column:
    percent = F.when(raw.endswith("%"), "%").otherwise("")
    bare = F.regexp_replace(F.regexp_replace(raw, "%$", ""), r"^\+", "")
    sign = F.when(bare.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(bare, "^-", ""), r"^0+(?=\d)", "")
    short = F.when(digits.contains("."), F.regexp_replace(digits, r"\.?0+$", "")).otherwise(digits)
    return F.concat(sign, short, percent)


def without_ids(text: Column, ids: Column) -> Column:
    """Text without evidence ids, longest first, so that their digits aren't taken for numbers."""
    longest = F.array_sort(ids, lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(longest, text, lambda t, i: F.replace(t, i, F.lit("")))


def compact_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def word_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)[\W_]+", ""))


def excerpt(text: Column, terms: Column, width: int) -> Column:
    """``width`` characters from shortly before the earliest term; from the start without one."""
    at = F.array_min(F.filter(F.transform(terms, lambda t: F.instr(F.lower(text), t)), lambda i: i > 0))
    start = F.greatest(F.lit(1), F.coalesce(at, F.lit(1)) - F.lit(width // 4))
    return F.substring(text, start, F.lit(width))


def html_to_prose(html: Column) -> Column:
    """Block tags end lines, other tags go, the common entities are read."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", "")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</?(?:p|div|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|blockquote)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return strip(F.regexp_replace(t, r" *\n[ \n]*", "\n"))


def matrix_to_markdown(matrix: Column) -> Column:
    """A table of strings as markdown: first row as header, short rows padded, bars escaped."""
    width = F.array_max(F.transform(matrix, lambda r: F.size(r)))
    cell = lambda c: F.trim(F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    rows = F.transform(matrix, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), (width - F.size(r)).cast("int"))), cell), " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width.cast("int")), " | "), F.lit(" |"))
    shown = F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))))
    return F.when(F.size(matrix) > 0, F.array_join(shown, "\n")).otherwise("")


def preview(markdown: Column, width: int = 260) -> Column:
    """Plain text of a markdown snippet, cut."""
    t = F.regexp_replace(markdown, r"!\[[^\]]*\]\([^)]*\)", "")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"[#*_`>|]+", "")
    return F.substring(strip(F.regexp_replace(t, r"(?U)\s+", " ")), 1, width)


def section_label(path: Column) -> Column:
    label = F.array_join(F.filter(path, lambda p: F.length(p) > 0), " > ")
    return F.when(label == "", "Document").otherwise(label)


def citation_counts(text: Column) -> dict[str, Column]:
    return {
        "numeric_citations": F.regexp_count(text, F.lit(r"\[\d+(?:\s*[,-]\s*\d+)*\]")),
        "author_year_citations": F.regexp_count(text, F.lit(r"\([A-Z][A-Za-z]+(?: et al\.)?,? \d{4}\)")),
        "urls": F.regexp_count(text, F.lit(r"https?://\S+")),
    }


def node_text(own: Column, lines: Column) -> Column:
    """A layout node's own text, else the contents of its lines' spans in order; white space made single."""
    spans = F.flatten(F.transform(lines, lambda x: F.transform(x["spans"], lambda s: s["content"])))
    text = F.when(F.trim(F.coalesce(own, F.lit(""))) != "", own).otherwise(F.array_join(F.coalesce(spans, F.array().cast("array<string>")), " "))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def font_whitelist(rule: Column) -> Column:
    """Font names that a rule lists after FONT_MARK, a line each, up to the first line that is none."""
    listed = F.regexp_extract(rule, FONT_MARK, 1)
    lines = F.filter(F.transform(F.split(listed, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    stop = F.array_position(F.transform(lines, lambda x: x.rlike(r"^[A-Za-z0-9._-]+$")), F.lit(False))
    return F.when(stop == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int")))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """The name-based UUID (version 5) of a text."""
    s = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.substr(F.lit("89ab"), F.conv(F.substr(s, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4 + 1, F.lit(1))
    cut = lambda a, n: F.substr(s, F.lit(a), F.lit(n))
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))
