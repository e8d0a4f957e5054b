"""Column expressions over text: classes of lines, statistics, labels, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words that decide the class of a line.
TABLE_BORDER = r"(\+[-+]+\+)|(\|.+\|)"
LIST_BULLET = r"^([0-9]+\.[\)\s]|[A-Za-z]\.|[-*•])\s+"
FORMULA = r"(\\begin\{equation\}|\\frac|\\sum|\\int|=|\[a-z]+)"
HEADER_KEYWORDS = ("chapter", "section", "appendix", "part", "lesson")
NOISE_SYMBOLS = "[@#$%^&]"


def words(text: Column) -> Column:
    """White-space separated words of a trimmed text, none for an empty one."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def header_level(line: Column) -> Column:
    """1 for chapters and short lines in capitals, 2 for other header words and short lines before a colon, else 0."""
    line = F.trim(line)
    low, n = F.lower(line), F.size(words(line))
    keyword = F.lit(False)
    for k in HEADER_KEYWORDS:
        keyword = keyword | low.startswith(k)
    capitals = (F.upper(line) == line) & (low != line)
    return F.when(keyword, F.when(low.startswith("chapter"), 1).otherwise(2)).when(capitals & (n <= 8), 1).when((n <= 10) & line.endswith(":"), 2).otherwise(0)


def paragraph_region(text: Column, level: Column | None = None) -> Column:
    """figure, table, list, formula, heading or text: the first rule that holds. ``level`` is its header level where that is known."""
    low = F.lower(text)
    return (
        F.when(text == "", "text")
        .when(low.startswith("figure") | low.startswith("fig "), "figure")
        .when(text.rlike(TABLE_BORDER), "table")
        .when(text.rlike(LIST_BULLET), "list")
        .when(text.rlike(FORMULA), "formula")
        .when((header_level(text) if level is None else level) > 0, "heading")
        .otherwise("text")
    )


def noise_score(text: Column) -> Column:
    """Weighted share of non-ASCII characters, broken words, symbols and repeated words, 1 at most."""
    chars = F.greatest(F.char_length(text), F.lit(1))
    lines = F.greatest(F.regexp_count(text, F.lit("\n")), F.lit(1))
    found = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    unique = F.coalesce(F.try_divide(F.size(F.array_distinct(found)), F.size(found)), F.lit(0.0))
    score = 0.4 * F.regexp_count(text, F.lit(r"[^\x00-\x7F]")) / chars + 0.2 * F.regexp_count(text, F.lit("-\n")) / lines + 0.2 * F.regexp_count(text, F.lit(NOISE_SYMBOLS)) / chars + 0.2 * (1 - unique)
    return F.least(F.lit(1.0), score)


def label(text: Column, most: int = 72) -> Column:
    """The first non-blank line of at most ``most`` characters, else the first line."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    fit = F.filter(lines, lambda x: (x != "") & (F.char_length(x) <= most))
    return F.when(F.coalesce(text, F.lit("")) == "", "Untitled").otherwise(F.coalesce(F.get(fit, F.lit(0)), F.get(lines, F.lit(0))))


def summary(text: Column, limit: int = 32) -> Column:
    """The first ``limit`` words, with an ellipsis if there are more."""
    w = words(text)
    return F.when(F.size(w) > limit, F.concat(F.array_join(F.slice(w, 1, limit), " "), F.lit("..."))).otherwise(F.array_join(w, " "))


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits joined by single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^0-9a-z]+", "-"), "^-+|-+$", "")


def sentence_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.regexp_replace(F.trim(text), r"([.!?])\s+", "$1\x01"), "\x01"), lambda s: F.trim(s) != ""))


def token_set(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Distinct lower-case words of three ASCII letters or more."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)))
    return F.array_except(found, F.array(*(F.lit(s) for s in stopwords))) if stopwords else found


def table_columns(text: Column) -> Column:
    """Most non-blank cells of a line with pipes, 1 at least."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("|")))
    cells = F.transform(lines, lambda x: F.size(F.filter(F.split(x, r"\|"), lambda c: F.trim(c) != "")))
    return F.greatest(F.coalesce(F.array_max(cells), F.lit(1)), F.lit(1))


def region_weight(region: Column) -> Column:
    return F.when(region == "table", 1.35).when(region == "figure", 1.25).when(region.isin("equation", "formula"), 1.15).when(region == "heading", 0.95).otherwise(1.0)


def sanitize(text: Column, patterns: tuple[str, ...]) -> Column:
    """The lines that match no pattern; the trimmed text if none is left."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.trim(x).rlike("|".join(patterns)))
    out = F.btrim(F.array_join(kept, "\n"), F.lit(" \n\t"))
    return F.when(out == "", F.trim(text)).otherwise(out)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of numbers in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def ratio(count: Column, expected: Column) -> Column:
    """count / expected, 1 at most, and 1 if nothing was expected."""
    return F.when(expected == 0, 1.0).otherwise(F.least(F.lit(1.0), count / expected))


def grams(tokens: Column, n: int) -> Column:
    """The runs of n words, joined by a space."""
    starts = F.slice(tokens, 1, F.greatest(F.size(tokens) - (n - 1), F.lit(0)))
    return F.transform(starts, lambda _, i: F.array_join(F.slice(tokens, i + 1, n), " "))


def containment(source: Column, latex: Column, n: int = 3) -> Column:
    """Share of the source's distinct word n-grams that a snippet without its commands has; 1 if the source has none."""
    clean = F.regexp_replace(F.regexp_replace(latex, r"\\[a-zA-Z]+", " "), r"[\{\}]", " ")
    own, there = (F.array_distinct(grams(words(F.lower(t)), n)) for t in (source, clean))
    return F.when(F.size(own) == 0, 1.0).otherwise(F.size(F.array_intersect(own, there)) / F.size(own))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


def region(text: Column) -> Column:
    """The class of a whole text: a table or formula anywhere, a list if half its lines are items, else by its first line."""
    lines = _lines(text)
    items = F.size(F.filter(lines, lambda x: F.trim(x).rlike(LIST_BULLET)))
    first = F.coalesce(F.trim(F.get(lines, F.lit(0))), F.lit(""))
    return (
        F.when(F.exists(lines, lambda x: x.rlike(TABLE_BORDER)), "table")
        .when(items >= F.greatest(F.lit(1), F.floor(F.size(lines) / 2)), "list")
        .when(text.rlike(FORMULA), "formula")
        .when(header_level(first) > 0, "heading")
        .otherwise("text")
    )


def list_depth(text: Column) -> Column:
    """The deepest item's level, by two blanks of indent each."""
    items = F.filter(_lines(text), lambda x: F.trim(x).rlike(LIST_BULLET))
    depth = F.transform(items, lambda x: F.floor((F.char_length(x) - F.char_length(F.ltrim(x))) / 2).cast("int") + 1)
    return F.greatest(F.coalesce(F.array_max(depth), F.lit(1)), F.lit(1))


def table_rows(text: Column) -> Column:
    """Lines with a pipe and a cell that isn't blank."""
    return F.size(F.filter(_lines(text), lambda x: F.contains(x, F.lit("|")) & (F.trim(F.replace(x, F.lit("|"), F.lit(""))) != "")))


def block_type(text: Column, kind: Column, level: Column) -> Column:
    """The plan's type of a chunk from its region, header level and first line."""
    capitals = (F.upper(text) == text) & (F.lower(text) != text) & (F.size(words(text)) <= 8)
    return (
        F.when(kind.isin("question", "figure", "table", "list"), kind)
        .when(kind == "formula", "equation")
        .when((level > 0) | text.rlike(r"(?i)^(chapter|section|appendix|part|lesson)([^A-Za-z0-9_\x{80}-\x{10FFFF}]|$)") | capitals, "section")
        .when(text.rlike(r"=|\\sum|\\int|\\frac"), "equation")
        .otherwise("text")
    )


def refined_type(raw: Column, levelled: Column) -> Column:
    """A layout element's class from its raw type's name."""
    has = lambda *s: raw.rlike("|".join(s))
    return F.when(has("table"), "table").when(has("figure", "image", "img"), "figure").when(has("equation", "formula", "math"), "equation").when(has("heading") | levelled, "heading").otherwise("text")


# Glyphs that are easily taken for others, and markers of a prompt.
LIKE_GLYPHS = r"(?i)((^|{edge})[S5]0[B8]|(^|{edge})SOB($|{edge})|[Il1]{{2,}}|0O|O0)"
ECHO_MARKS = ("style exemplars", "respond with:", "<<<source")


def ambiguous(text: Column) -> Column:
    """Whether glyphs occur that are easily taken for others (S and 5, l and 1, O and 0)."""
    edge = r"[^\p{L}\p{N}_]"
    return text.rlike(LIKE_GLYPHS.format(edge=edge))


def prompt_echo(text: Column) -> Column:
    """Whether two markers of a prompt occur."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(m)).cast("int") for m in ECHO_MARKS), F.lit(0)) >= 2


# How many letters prose has at least, and how many commands at most.
PROSE_LETTERS, PROSE_COMMANDS = 20, 1


def plain_prose(text: Column) -> Column:
    """Whether an equation's body is prose: fenced, labelled lines, or letters without commands and operators."""
    letters = lambda x: F.regexp_count(x, F.lit(r"\p{L}"))
    lines = _lines(text)
    labelled = (F.size(lines) >= 3) & (F.size(F.filter(lines, lambda x: letters(x) >= 4)) >= 2) & F.exists(lines, lambda x: F.contains(x, F.lit(":")))
    sparse = (letters(text) > PROSE_LETTERS) & (F.regexp_count(text, F.lit(r"\\")) <= PROSE_COMMANDS) & (F.regexp_count(text, F.lit(r"[=+\-/*_^]")) < letters(text) / 4)
    return (text != "") & (F.contains(text, F.lit("```")) | text.startswith("%") | labelled | sparse)
