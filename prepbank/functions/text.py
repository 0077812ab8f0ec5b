"""Text expressions. All are built-in column functions, so they stay inside the JVM.

Patterns avoid ``.`` and ``$`` where Java reads them differently from the wanted meaning:
``[^\\n]`` is "any but a newline" and ``\\z`` the very end of the text.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from prepbank import fixed
from prepbank.functions.jsons import let, parse_json
from prepbank.functions.template import fill

FENCE = "```"
# a regular-expression class of the same characters as fixed.WHITESPACE
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(c: Column) -> Column:
    """Drop whitespace of every kind from both ends (``trim`` alone drops blanks only)."""
    return F.btrim(c, F.lit(fixed.WHITESPACE))


def page_trim(c: Column) -> Column:
    """Strip with the whitespace set of the page scripts."""
    return F.btrim(c, F.lit(fixed.PAGE_WHITESPACE))


# ---- question texts ---------------------------------------------------------------------


def is_question(c: Column, marker: str = "?", min_len: int = fixed.MIN_QUESTION_LENGTH) -> Column:
    return c.contains(marker) & (F.length(c) > min_len)


def clean_question(c: Column) -> Column:
    """Unwrap ``_x_`` and ``*x*``, drop a leading list number, strip."""
    c = F.regexp_replace(c, r"_([^\n]*?)_", "$1")
    c = F.regexp_replace(c, r"\*([^\n]*?)\*", "$1")
    return strip(F.regexp_replace(c, r"\A\p{Nd}+\." + _SPACE + "*", ""))


def classify_role(c: Column) -> Column:
    """Role of the first keyword list with a word in the lower-cased text; plain substring match."""
    low = F.lower(c)
    role = F.lit(fixed.FALLBACK_ROLE)
    for name, words in reversed(fixed.ROLE_KEYWORDS.items()):
        role = F.when(reduce(or_, (low.contains(w) for w in words)), name).otherwise(role)
    return role


def is_project_question(c: Column) -> Column:
    return c.rlike("(?i)" + "|".join(fixed.PROJECT_WORDS))


def difficulty_label(question: Column) -> Column:
    return F.when(F.lower(question).contains("explain"), "medium").otherwise("hard")


def answer_strategy(role: Column, extracted: Column) -> Column:
    return (
        F.when(extracted, fixed.EXTRACTED_STRATEGY)
        .when(role == fixed.STAR_STRATEGY_ROLE, fixed.STAR_STRATEGY)
        .otherwise(fixed.CURATED_STRATEGY)
    )


def tags(role: Column, extracted: Column) -> Column:
    return F.array(role, F.when(extracted, fixed.EXTRACTED_TAG).otherwise(fixed.CURATED_TAG))


def category(extracted: Column) -> Column:
    return F.when(extracted, fixed.EXTRACTED_CATEGORY).otherwise(fixed.CURATED_CATEGORY)


def template_answer(question: Column) -> Column:
    return fill(fixed.EXTRACTED_ANSWER, question=question)


def doc_text(role: Column, type_: Column, question: Column) -> Column:
    return fill(fixed.DOCUMENT_TEXT, role=role, type=type_, question=question)


def query_text(role: Column, resume: Column, question_type: Column) -> Column:
    return fill(fixed.QUERY_TEXT, role=role, resume=resume, question_type=question_type)


# ---- web pages ----------------------------------------------------------------------------


def script_json(html: Column) -> Column:
    """Body of the first JSON script element whose body sits on one line, '' when there is none."""
    return F.regexp_extract(html, r'<script type="application/json"[^>]*>([^\n]*?)</script>', 1)


def extract_strings(html: Column) -> Column:
    """String elements of the JSON list embedded in a page; null when the body is no JSON list."""
    items = F.try_variant_get(parse_json(script_json(html)), "$", "array<variant>")
    is_text = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.transform(is_text, lambda v: F.try_variant_get(v, "$", "string"))


# ---- gates ----------------------------------------------------------------------------------


def resume_gate(c: Column) -> Column:
    """The fixed message for a background too short to use, else null."""
    return F.when(F.length(strip(c)) < fixed.MIN_BACKGROUND_LENGTH, fixed.SHORT_BACKGROUND)


def answer_or_default(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(fixed.NO_ANSWER))


def difficulty_tier(avg: Column) -> Column:
    return F.when(avg < fixed.EASIER_BELOW, "easier").when(avg >= fixed.HARDER_FROM, "harder").otherwise("none")


def tier_text(avg: Column) -> Column:
    return (
        F.when(avg < fixed.EASIER_BELOW, fixed.TIER_EASIER)
        .when(avg >= fixed.HARDER_FROM, fixed.TIER_HARDER)
        .otherwise("")
    )


def file_kind(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".docx"), "docx").otherwise("unsupported")


# ---- generated text ----------------------------------------------------------------------------


def strip_fences(c: Column) -> Column:
    return strip(F.regexp_replace(c, "```(?:json)?", ""))


def strip_prefix(c: Column) -> Column:
    """Drop a leading ``Answer:`` of any case, up to twice, stripping after each."""
    for _ in range(2):
        c = F.when(F.lower(c).startswith("answer:"), strip(F.substr(c, F.lit(8)))).otherwise(c)
    return c


def strip_trailing_fence(c: Column) -> Column:
    return F.substring_index(c, "\n" + FENCE, 1)


def framed_answer(response: Column, fallback: Column) -> Column:
    """Clean a generated answer; the key-point lines stand in for a missing one."""
    cleaned = strip(strip_trailing_fence(strip_prefix(response)))
    return F.when(F.length(response) > 0, cleaned).otherwise(fallback)


def _before(c: Column, pattern: str) -> Column:
    """The text ahead of the first match; the rest is not searched."""
    return F.split(c, pattern, 2)[0]


def strip_tail(c: Column) -> Column:
    """Cut the text at the first fence, function, class or note line."""
    return _before(c, r"\n(?:```|def [a-z]|class [A-Z]|(?i:Note:|\*\*Note))")


# A look at the first letter ahead of the labels spares most places the search for each of them.
_STARTS = "".join(sorted({x[0] + x[0].lower() for x in fixed.SECTION_LABELS}))
_LABEL_OR_HEADER = rf"(?=[{_STARTS}\n])(?i)(?=" + "|".join(fixed.SECTION_LABELS) + r"|\n[A-Z_]+:)"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _with_pieces(c: Column, use) -> Column:
    """``use(pieces)`` of a text that one scan has cut ahead of every label and header line: the pieces (p), their first letters in
    capitals (heads), and the places from 0 of those that are no white space (full) and that start with a header line (headers)."""
    size = max(map(len, fixed.SECTION_LABELS))
    white = F.lit(fixed.PAGE_WHITESPACE)

    def places(pieces, test):
        return F.array_compact(F.transform(pieces, lambda p, i: F.when(test(p), i)))

    def cut(pieces):
        heads = F.transform(pieces, lambda p: F.translate(F.left(p, F.lit(size)), _LOWER, _UPPER))
        full, headers = places(pieces, lambda p: F.ltrim(p, white) != ""), places(pieces, lambda p: p.startswith("\n"))
        return let(F.struct(pieces.alias("p"), heads.alias("heads"), full.alias("full"), headers.alias("headers")), use)

    return let(F.split(c, _LABEL_OR_HEADER), cut)


def _next(places: Column, after: Column) -> Column:
    return F.array_min(F.filter(places, lambda x: x > after))


def _section(label: str, cut: Column) -> Column:
    """The pieces from the first one with the label up to the first header line with text ahead of it, without the label.

    Each step is bound by ``let``: inside a function over an array an expression would be worked out for every element.
    """
    white = F.lit(fixed.PAGE_WHITESPACE)
    place = F.array_position(F.transform(cut["heads"], lambda h: F.left(h, F.lit(len(label)))), label).cast("int")

    def after_label(at):
        first = F.substr(F.get(cut["p"], at - 1), F.lit(len(label) + 1))
        return F.when(first.startswith(":"), F.substr(first, F.lit(2))).otherwise(first)

    def whole(at, first, end):
        return strip_tail(page_trim(F.concat(first, F.array_join(F.slice(cut["p"], at + 1, end - at), ""))))

    def found(at, first):
        # A header line that only white space parts from the label counts as its text.
        begins = F.when(F.ltrim(first, white) != "", at - 1).otherwise(_next(cut["full"], at - 1))
        ends = let(begins, lambda begin: F.coalesce(_next(cut["headers"], begin), F.size(cut["p"])))
        return let(let(ends, lambda end: whole(at, first, end)), lambda text: F.nullif(text, F.lit("")))

    return let(place, lambda at: F.when(at > 0, let(after_label(at), lambda first: found(at, first))))


def section(label: str, c: Column) -> Column:
    """Text after ``LABEL:`` up to the next line that starts with ``WORD:`` or the end; null when missing or empty. ``label`` is one of
    the section labels."""
    return _with_pieces(c, lambda cut: _section(label, cut))


def sections(c: Column) -> Column:
    """All sections as a struct by label, from one scan of the text."""
    return _with_pieces(c, lambda cut: F.struct(*[_section(x, cut).alias(x) for x in fixed.SECTION_LABELS]))


def bullets(c: Column) -> Column:
    """Lines without their list marker, less blank and code-like ones."""
    lines = F.transform(F.split(c, "\n"), lambda line: page_trim(F.regexp_replace(line, r"\A[-*]\s*", "")))
    return F.filter(lines, lambda line: (F.length(line) > 0) & ~line.rlike(r"\A(`|#|def |print\(|no_code|\w+\(\)\z)"))


def escape_html(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def score_text(c: Column) -> Column:
    return page_trim(F.regexp_replace(c, r"(?s)\A(.*?)/10", "$1"))


def clean_improved(c: Column) -> Column:
    """Drop a trailing END and fenced blocks, trim."""
    c = F.regexp_replace(c, r"(?i)\bEND\b\s*\z", "")
    return page_trim(F.regexp_replace(c, r"(?s)```.*?```", ""))


def nl2br(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit("<br>"))


def _plain(c: Column) -> Column:
    return F.concat(F.lit("<p>"), nl2br(escape_html(c)), F.lit("</p>"))


def plain_or_sections(c: Column) -> Column:
    """Escaped text with line breaks when score, summary and strengths are all missing, else null."""
    found = _with_pieces(c, lambda cut: F.coalesce(*[_section(x, cut) for x in ("SCORE", "SUMMARY", "STRENGTHS")]))
    return F.when(found.isNull(), _plain(c))


def feedback_sections(c: Column) -> Column:
    """All labelled sections of an evaluation text, cleaned, as one struct."""

    def shown(s):
        return F.struct(
            escape_html(score_text(s["SCORE"])).alias("score"),
            escape_html(s["SUMMARY"]).alias("summary"),
            F.transform(bullets(s["STRENGTHS"]), escape_html).alias("strengths"),
            F.transform(bullets(s["WEAKNESSES"]), escape_html).alias("weaknesses"),
            F.transform(bullets(s["IMPROVEMENT_TIPS"]), escape_html).alias("improvement_tips"),
            escape_html(F.nullif(clean_improved(s["IMPROVED_ANSWER"]), F.lit(""))).alias("improved_answer"),
            F.when(F.coalesce(s["SCORE"], s["SUMMARY"], s["STRENGTHS"]).isNull(), _plain(c)).alias("plain"),
        )

    return let(sections(c), shown)


# ---- lists and display ------------------------------------------------------------------------------


def md_bullets(items: Column, marker: str = "-") -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit(marker + " "), x)), "\n")


def key_points(points: Column) -> Column:
    """Trimmed, non-empty key points."""
    return F.filter(F.transform(points, page_trim), lambda p: p != "")


def one_decimal(c: Column) -> Column:
    """One-decimal display, rounded on the exact binary value, ties to even (so 0.15 shows 0.1).

    ``over`` has the sign of 20 x - (2 n + 1), which tells whether x lies above the middle of n/10 and (n + 1)/10.
    Near the middle both of its subtractions are exact in doubles, so the sign is right to the last bit.
    """
    x = F.abs(c)
    n = F.floor(x * 10)
    over = x * 4 - ((n * 2 + 1).cast("double") - x * 16)
    tenths = n + F.when((over > 0) | ((over == 0) & (n % 2 == 1)), 1).otherwise(0)
    digits = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(c < 0, F.concat(F.lit("-"), digits)).otherwise(digits)


def score_repr(c: Column) -> Column:
    """Shortest text of a score: 7.0, 8.25; plain digits from 0.0001 up to 1e16, else 1e-05 or 1e+16."""
    text = c.cast("string")
    size = F.abs(c)
    plain = F.rtrim(c.cast("decimal(38,20)").cast("string"), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0\z", "")
    power = F.substring_index(text, "E", -1)
    sign = F.when(power.startswith("-"), "-").otherwise("+")
    short = F.regexp_replace(power, "-", "")
    exponent = F.when(F.length(short) < 2, F.concat(F.lit("0"), short)).otherwise(short)
    return (
        F.when(~text.contains("E"), text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.concat(mantissa, F.lit("e"), sign, exponent))
    )


def local_time(c: Column, pattern: str = "M/d/yyyy, h:mm:ss a") -> Column:
    return F.date_format(c, pattern)


def session_uuid() -> Column:
    return F.uuid()
