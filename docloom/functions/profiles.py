"""Column expressions that judge documents and blocks: domains, styles, classes, scores, predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.latex import count_of

# Words of each domain; of equal scores the first domain wins.
DOMAIN_WORDS = {
    "mathematics": ("theorem", "lemma", "proof", "corollary", "equation", "matrix", "vector"),
    "computer_science": ("algorithm", "runtime", "complexity", "graph", "procedure", "pseudocode"),
    "physics": ("quantum", "energy", "electron", "momentum", "field", "particle"),
    "engineering": ("signal", "circuit", "controller", "thermal", "mechanical", "stress"),
}
ALGORITHM_MARKS = ("input:", "output:", "procedure", "step")
PHYSICS_MARKS = ("\\omega", "\\phi", "joule", "newton")
# Words of a style's domain, and of document types.
STYLE_WORDS = {
    "math": ("theorem", "lemma", "proof", "eigenvalue", "manifold"),
    "cs": ("algorithm", "complexity", "neural", "network", "bytecode", "computation"),
    "physics": ("quantum", "particle", "energy", "relativity", "plasma"),
    "bio": ("cell", "protein", "enzyme", "genome", "biomarker"),
    "finance": ("portfolio", "equity", "derivative", "valuation", "yield"),
}
TYPE_WORDS = {"thesis": ("thesis", "dissertation", "advisor", "committee"), "presentation": ("slide", "agenda", "speaker", "overview"), "book": ("chapter", "preface", "appendix")}
# Patterns of style features. The bracket pattern asks for literal backslashes, as found.
BRACKET_CITATION = r"\\[\[0-9]{1,3}(?:\s*,\s*[0-9]{1,3})*\\\]"
PAREN_CITATION = r"\([A-Z][A-Za-z-]+\s*,\s*[0-9]{4}\)"
MATH_TOKEN = r"\\(begin\{equation|frac|sum|int|alpha|beta|gamma|nabla|sqrt)"
SECTION_WORD = r"(?i)\b(section|chapter|part)\b"
REFERENCE_WORD = r"(?i)\b(references|bibliography)\b"
# Typographic profiles and the document classes that prefer them; the first is the default.
TYPOGRAPHY = {"scholarly-serif": ("book", "report", "memoir"), "technical-report": ("article", "elsarticle", "siamart", "ieeetran"), "presentation-sans": ("beamer", "metropolis")}
# Folders of modalities.
MODALITY_FOLDERS = {"pdf": "pdf", "page-image": "images", "json": "annotations", "latex-src": "latex", "text": "text"}
# Words that views of a page are scored by.
LAYOUT_VIEW_WORDS = ("column", "grid", "heading", "indent", "margin")
MATH_VIEW_WORDS = ("equation", "formula", "symbol", "integral", "matrix", "graph")


def any_of(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def hits(text: Column, words) -> Column:
    """How often the words occur, inside others too."""
    total = F.lit(0)
    for w in words:
        total = total + count_of(text, w)
    return total


def first_best(scores: dict[str, Column], least: Column | None = None) -> Column:
    """The name of the highest score, of equal ones the first; null if none is above ``least``."""
    best, out = F.greatest(*scores.values()), F.lit(None).cast("string")
    for name, s in reversed(scores.items()):
        out = F.when(s == best, name).otherwise(out)
    return out if least is None else F.when(best > least, out)


def style_features(text: Column) -> dict[str, Column]:
    """Counts of a text that its style is read from."""
    low, n = F.lower(text), lambda p: F.regexp_count(text, F.lit(p))
    figures, tables, sections = count_of(low, "figure"), count_of(low, "table"), n(SECTION_WORD)
    equations = F.floor(count_of(text, "=") / F.greatest(count_of(text, ".\n"), F.lit(1))).cast("int")
    return {
        "total_blocks": F.greatest(F.lit(1), sections + figures + tables + equations),
        "section_blocks": sections,
        "figure_blocks": F.floor(figures / 2).cast("int"),
        "table_blocks": F.floor(tables / 2).cast("int"),
        "equation_blocks": equations,
        "text_tokens": F.size(T.words(F.regexp_replace(text, r"\s+", " "))),
        "math_tokens": n(MATH_TOKEN) + count_of(text, "$") * 2,
        "bracket_citations": n(BRACKET_CITATION),
        "paren_citations": n(PAREN_CITATION),
        "reference_markers": n(REFERENCE_WORD),
    }


def document_type(text: Column, pages: Column) -> Column:
    """From columns total_blocks, section_blocks and figure_blocks: thesis, book, report, presentation or article."""
    low, figures = F.lower(text), F.col("figure_blocks") / F.greatest(F.col("total_blocks"), F.lit(1))
    return (
        F.when(any_of(low, TYPE_WORDS["thesis"]) & (pages >= 30), "thesis")
        .when(any_of(low, TYPE_WORDS["book"]) & (pages >= 50), "book")
        .when(pages >= 80, "book")
        .when((figures < 0.15) & (F.col("section_blocks") >= F.greatest(F.lit(4), F.floor(0.4 * F.col("total_blocks")))), "report")
        .when(any_of(low, TYPE_WORDS["presentation"]), "presentation")
        .when((figures > 0.35) & (pages <= 15), "presentation")
        .otherwise("article")
    )


def style_family(kind: Column) -> Column:
    """From the citations' styles and the document's type."""
    total = F.col("bracket_citations") + F.col("paren_citations")
    total = F.when(total == 0, 1).otherwise(total)
    return F.when((F.col("bracket_citations") / total > 0.55) & (F.col("section_blocks") >= 3), "ieee").when((F.col("paren_citations") / total > 0.45) & kind.isin("article", "report"), "acm").when(kind.isin("book", "thesis", "textbook"), "springer").otherwise("generic")


def style_domain(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(first_best({d: hits(low, w) for d, w in STYLE_WORDS.items()}, F.lit(0)), F.lit("default"))


def typography_profile(document_class: Column, requested: Column) -> Column:
    """The profile asked for, else the one that prefers the class, else the default."""
    asked, kind = F.lower(F.trim(F.coalesce(requested, F.lit("")))), F.lower(F.trim(F.coalesce(document_class, F.lit(""))))
    out = F.lit(next(iter(TYPOGRAPHY)))
    for name, classes in reversed(TYPOGRAPHY.items()):
        out = F.when(kind.isin(*classes), name).otherwise(out)
    return F.when(asked.isin(*TYPOGRAPHY), asked).otherwise(out)


def layout_class(text: Column, font_size: Column) -> Column:
    """Class of a text block on a page. A table needs a border, and a question no backslash: the patterns are those of paragraphs."""
    t = F.trim(text)
    low = F.lower(t)
    return (
        F.when(low.rlike(r"^(question|q)\s*([0-9]+[a-z]?|\([^)]+\))"), "question")
        .when(low.rlike(r"^(answer|solution)\b"), "answer")
        .when(low.startswith("figure") | low.startswith("fig."), "figure")
        .when(low.startswith("table") | text.rlike(T.TABLE_BORDER), "table")
        .when(t.rlike(T.LIST_BULLET), "list")
        .when(font_size >= 18, "heading")
        .when(text.rlike(T.FORMULA), "formula")
        .otherwise("text")
    )


def content_type(tag: Column, text: Column) -> Column:
    """A block's template by its tag, else by how its text begins."""
    low = F.lower(F.trim(text))
    named = F.when(tag == "question", "question_block").when(tag == "answer", "answer_block").when(tag == "equation", "display_equation").when(tag.isin("figure", "table"), tag)
    return named.when(low.startswith("proof"), "proof_block").when(low.startswith("theorem") | low.startswith("lemma"), "theorem_block").otherwise("paragraph")


def keep_child(parent: Column, child: Column, retain_neutral: bool = True, tolerance: float = 0.02) -> Column:
    """Whether a version stays: no worse than its parent, or little worse where that is allowed."""
    return (child >= parent) | (F.lit(retain_neutral) & (parent - child <= tolerance))


def template(questions: Column, proofs: Column, problems: Column, structured: Column) -> Column:
    """The template for a bundle; null where 40 % of its problems hold no points or answers."""
    some = (questions > 0) | (proofs > 0) | ((problems > 0) & (structured / F.greatest(problems, F.lit(1)) >= 0.4))
    return F.when(some, F.when(questions > 0, "math_worksheet.tex").when(proofs > 0, "proof_document.tex").otherwise("problem_set.tex"))


def modality_folder(modality: Column) -> Column:
    folders = F.create_map(*(F.lit(x) for kv in MODALITY_FOLDERS.items() for x in kv))
    return F.coalesce(F.try_element_at(folders, modality), modality)


def view_scores(descriptions: Column, region: Column, role: Column) -> tuple[Column, Column]:
    """How far descriptions of views speak of layout and of mathematics, 0 to 1."""
    text, n = F.array_join(F.transform(descriptions, lambda d: F.lower(d)), " "), F.greatest(F.size(descriptions), F.lit(1))
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    layout = hits(text, LAYOUT_VIEW_WORDS) / n + F.when(region.isin("section", "table"), 0.1).otherwise(0.0)
    math = (hits(text, MATH_VIEW_WORDS) + F.when(region.isin("equation", "formula"), 1.0).otherwise(0.0) + F.when(F.coalesce(role, F.lit("")) != "", 0.5).otherwise(0.0)) / n
    return clamp(layout), clamp(math)


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def layout_similarity(latex: Column, hint: Column) -> Column:
    """Share of a hint's words that a snippet holds, plus 0.2; 0.5 without a hint, 0.4 if a side has no word."""
    a, b = _tokens(hint), _tokens(latex)
    share = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)) + 0.2
    return F.when(F.coalesce(hint, F.lit("")) == "", 0.5).when((F.size(a) == 0) | (F.size(b) == 0), 0.4).otherwise(F.floor(F.greatest(F.lit(0.2), F.least(F.lit(1.0), share)) * 1000 + 0.5) / 1000)


def vision_candidate(latex: Column, hint: Column, region: Column, syntax: Column) -> Column:
    """Score of a snippet read from an image."""
    score = 0.45 * syntax + 0.35 * layout_similarity(latex, hint) + 0.2 * F.least(F.lit(1.0), F.char_length(latex) / 1200) + F.when(region.isin("figure", "table", "diagram"), 0.1).otherwise(0.0)
    return F.when(F.trim(latex) == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.floor(score * 1000 + 0.5) / 1000)))


def float_placement(panels: Column, kind: Column, references: Column) -> Column:
    return F.when(panels > 1, "p").when(kind.isin("plot", "diagram") | (references >= 3), "htbp").otherwise("H")


def merged(first: Column, second: Column, last_wins: bool = False) -> Column:
    """Two maps as one; of a key in both the first map's value stays, or the second's if the last wins."""
    if last_wins:
        first, second = second, first
    return F.map_concat(F.map_filter(second, lambda k, _: ~F.array_contains(F.map_keys(first), k)), first)


def token_labels(word_ids: Column, labels: Column, label_all: bool = False) -> Column:
    """Labels of tokens from labels of words: -100 for tokens of no word and, unless ``label_all``, for all but a word's first."""
    def label(w: Column, i: Column) -> Column:
        again = F.coalesce(F.get(word_ids, i - 1) == w, F.lit(False))
        return F.when(w.isNull() | (again & F.lit(not label_all)), -100).otherwise(F.get(labels, w))

    return F.transform(word_ids, label)


def noise_metrics(text: Column) -> dict[str, Column]:
    """What points to bad recognition: shares of characters, line length, broken and repeated words, the score, stray marks."""
    chars = F.greatest(F.char_length(text), F.lit(1))
    found = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    stray = F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"^\P{L}$"))
    return {
        "non_ascii_ratio": F.regexp_count(text, F.lit(r"[^\x00-\x7F]")) / chars,
        "digit_ratio": F.regexp_count(text, F.lit("[0-9]")) / chars,
        "symbol_ratio": F.regexp_count(text, F.lit(T.NOISE_SYMBOLS)) / chars,
        "avg_line_length": chars / F.greatest(F.regexp_count(text, F.lit("\n")), F.lit(1)),
        "broken_words": F.regexp_count(text, F.lit("-\n")),
        "unique_token_ratio": F.coalesce(F.try_divide(F.size(F.array_distinct(found)), F.size(found)), F.lit(0.0)),
        "noise_score": T.noise_score(text),
        "format_split_errors": F.size(stray) / F.greatest(F.size(found), F.lit(1)),
    }


def safe_label(text: Column, fallback: str, most: int = 100) -> Column:
    """The first line, cut to ``most`` characters; the fallback for a blank text."""
    first = F.trim(F.regexp_extract(F.trim(text), r"^([^\n]*)", 1))
    return F.when(first == "", fallback).otherwise(F.substring(first, 1, most))


def question_slug(value: Column) -> Column:
    """ASCII letters and digits only; empty without any."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^0-9a-z]", "")


def dataset_slug(name: Column) -> Column:
    out = T.slug(name)
    return F.when(out == "", "dataset").otherwise(out)


def reference_slug(text: Column) -> Column:
    """Letters and digits of any script, lower-case, joined by single hyphens."""
    out = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-")
    out = F.regexp_replace(out, "^-+|-+$", "")
    return F.when(out == "", "item").otherwise(out)


def inject_label(latex: Column, label: Column, kind: Column) -> Column:
    """A label put where it belongs: before an equation's end, after a caption, before a float's end, else below."""
    tag = F.concat(F.lit("\\label{"), label, F.lit("}"))

    def cut(pattern: str, before: Column, after: Column, behind: bool) -> tuple[Column, Column]:
        found = F.regexp_extract(latex, pattern, 0)
        at = F.instr(latex, found) + (F.char_length(found) if behind else 0)
        return found != "", F.concat(F.substring(latex, F.lit(1), at - 1), before, tag, after, F.substring(latex, at, F.lit(1 << 30)))

    line, none = F.lit("\n"), F.lit("")
    ends = {k: cut(p, F.lit("  ") if k != "equation" else none, line, False) for k, p in (("equation", r"\\end\{equation\*?\}"), ("figure", r"\\end\{figure\}"), ("table", r"\\end\{table\}"))}
    captioned, with_caption = cut(r"\\caption\{[^}]*\}", F.lit("\n  "), none, True)
    out = F.when((F.trim(latex) == "") | F.contains(latex, F.lit("\\label{")), latex)
    out = out.when((kind == "equation") & ends["equation"][0], ends["equation"][1])
    out = out.when(kind.isin("figure", "table") & captioned, with_caption)
    for k in ("figure", "table"):
        out = out.when((kind == k) & ends[k][0], ends[k][1])
    return out.otherwise(F.concat(latex, line, tag))
