"""Column expressions over LaTeX: escaping, symbols, plain text, checks of balance, classes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Glyphs and what they become, applied in this order.
SEQUENCES = (("∉", r"\notin"), ("⊈", r"\nsubseteq"), ("⊄", r"\nsubset"), ("≱", r"\ngeq"), ("≰", r"\nleq"))
GLYPHS = (
    ("−", "-"), ("–", "--"), ("—", "---"), ("“", "``"), ("”", "''"), ("‘", "`"), ("’", "'"), ("‚", ","), ("„", ",,"),
    ("…", r"\ldots"), ("•", r"\textbullet"), ("·", r"\cdot"), ("°", r"^{\circ}"),
    ("×", r"\times"), ("÷", r"\div"), ("±", r"\pm"), ("∓", r"\mp"), ("≤", r"\leq"), ("≥", r"\geq"), ("≠", r"\neq"),
    ("≈", r"\approx"), ("≡", r"\equiv"), ("∝", r"\propto"), ("∞", r"\infty"), ("√", r"\sqrt{}"), ("∂", r"\partial"),
    ("∇", r"\nabla"), ("∆", r"\Delta"),
    ("∈", r"\in"), ("∋", r"\ni"), ("⊂", r"\subset"), ("⊃", r"\supset"), ("⊆", r"\subseteq"), ("⊇", r"\supseteq"),
    ("∪", r"\cup"), ("∩", r"\cap"), ("∅", r"\emptyset"), ("∀", r"\forall"), ("∃", r"\exists"), ("∄", r"\nexists"),
    ("∴", r"\therefore"), ("∵", r"\because"),
    ("→", r"\rightarrow"), ("←", r"\leftarrow"), ("↔", r"\leftrightarrow"), ("⇒", r"\Rightarrow"), ("⇐", r"\Leftarrow"),
    ("⇔", r"\Leftrightarrow"), ("↑", r"\uparrow"), ("↓", r"\downarrow"),
    ("α", r"\alpha"), ("β", r"\beta"), ("γ", r"\gamma"), ("δ", r"\delta"), ("ε", r"\epsilon"), ("θ", r"\theta"),
    ("λ", r"\lambda"), ("μ", r"\mu"), ("π", r"\pi"), ("ρ", r"\rho"), ("σ", r"\sigma"), ("τ", r"\tau"), ("φ", r"\phi"),
    ("ω", r"\omega"), ("Δ", r"\Delta"), ("Γ", r"\Gamma"), ("Θ", r"\Theta"), ("Λ", r"\Lambda"), ("Π", r"\Pi"),
    ("Σ", r"\Sigma"), ("Φ", r"\Phi"), ("Ψ", r"\Psi"), ("Ω", r"\Omega"),
    ("²", "^{2}"), ("³", "^{3}"), ("¹", "^{1}"), ("⁰", "^{0}"), ("⁻", "^{- }"), ("⁺", "^{+ }"), ("½", r"\frac{1}{2}"),
    ("¢", r"\textcent"), ("£", r"\pounds"), ("¥", r"\textyen"), ("€", r"\texteuro"), ("©", r"\textcopyright"),
    ("®", r"\textregistered"), ("™", r"\texttrademark"), ("\ufffd", "?"), ("ℝ", r"\mathbb{R}"),
    ("′", "'"), ("″", "''"), ("‴", "'''"), ("«", "<<"), ("»", ">>"), ("‹", "<"), ("›", ">"),
    ("^", r"\^{}"), ("~", r"\textasciitilde{}"),
)
# Glyphs that are still left when GLYPHS has been applied.
MORE_GLYPHS = (("ℂ", r"\mathbb{C}"), ("ℤ", r"\mathbb{Z}"), ("ℕ", r"\mathbb{N}"), ("↦", r"\mapsto"), ("⋮", r"\vdots"), ("⋯", r"\cdots"), ("∠", r"\angle"), ("≅", r"\cong"), ("↻", r"\circlearrowright"))
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
# Packages and the commands that need them.
PACKAGES = {"booktabs": (r"\toprule", r"\midrule", r"\bottomrule"), "amsmath": (r"\align", r"\begin{align", r"\begin{multline", r"\frac", r"\sum"), "graphicx": (r"\includegraphics",), "caption": (r"\caption",)}
# Patterns stripped from LaTeX, in this order.
PLAIN = ("%.*", r"(?s)\$[^$]+\$|\\\[.*?\\\]|\\\(.+?\\\)", r"\\(begin|end)\{[^\}]+\}", r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{[^}]*\})?", r"[{}]", r"\s+")
# Functions that an equation check and a normalisation know.
FUNCTIONS = ("sin", "cos", "tan", "cot", "sec", "csc", "log", "ln", "exp")
NORMALISED_FUNCTIONS = ("sin", "cos", "tan", "log", "ln", "exp")
# Classes of mathematical text, first match, with a score.
MATH_CLASSES = (
    (r"\\begin\{(equation|align|gather|cases)\}|\\\[|\\\]", "display-equation", 0.9),
    (r"\$(?:[^$]|\\\$)+\$", "inline-equation", 0.8),
    (r"(\\Rightarrow|\\therefore|\\because|\\implies)", "proof-step", 0.75),
    (r"(=|\\equiv|\\approx).*(\\\\|\n)", "derivation", 0.7),
    (r"[a-zA-Z]\\?\([^)]+\)\s*=\s*", "function-definition", 0.65),
)
# Style tokens of a snippet, 0.2 each.
STYLE = (r"\toprule", r"\midrule", r"\begin{align", r"\label", r"\caption", r"\begin{figure", r"\begin{table")
# Mutations of good LaTeX into a worse variant.
MUTATIONS = ((r"\toprule", r"\hline"), (r"\midrule", r"\hline"), (r"\begin{align}", r"\begin{eqnarray}"), (r"\end{align}", r"\end{eqnarray}"))


def replace_all(text: Column, pairs) -> Column:
    """Literal replacements, one after the other."""
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def symbols(text: Column) -> Column:
    """Glyphs as commands, control characters as spaces."""
    return replace_all(F.regexp_replace(text, CONTROL, " "), SEQUENCES + GLYPHS + MORE_GLYPHS)


def escape(text: Column, newline: str | None = r"\\ ") -> Column:
    """LaTeX's special characters, each escaped once; a line end becomes ``newline`` (None: stays)."""
    held = replace_all(text, (("\\", "\x01"), ("~", "\x02"), ("^", "\x03")))
    held = F.regexp_replace(held, r"([&%$#_{}])", r"\\$1")
    back = (("\x01", r"\textbackslash{}"), ("\x02", r"\textasciitilde{}"), ("\x03", r"\textasciicircum{}"))
    return replace_all(held, back + ((("\n", newline),) if newline is not None else ()))


def escape_plain(text: Column) -> Column:
    """``&`` and ``%`` that aren't escaped yet."""
    return F.regexp_replace(text, r"(?<!\\)([&%])", r"\\$1")


def fallback_candidate(text: Column) -> Column:
    """A text as a snippet: replacements in turn, so braces of the first are escaped again."""
    return F.trim(replace_all(text, (("\\", r"\textbackslash{}"), *((c, "\\" + c) for c in "&%$#_{}"))))


def plain_text(latex: Column) -> Column:
    """The words of a snippet: no comments, mathematics, environments or commands."""
    for p in PLAIN:
        latex = F.regexp_replace(latex, p, " ")
    return F.trim(latex)


def fences(text: Column) -> Column:
    """Code fences as verbatim environments."""
    return F.regexp_replace(text, r"(?s)```\n*(.*?)\n*```", "\\\\begin{verbatim}\n$1\n\\\\end{verbatim}")


def heading(label: Column, level: Column) -> Column:
    command = F.when(level <= 1, "section").when(level == 2, "subsection").when(level == 3, "subsubsection").otherwise("paragraph")
    return F.concat(F.lit("\\"), command, F.lit("{"), label, F.lit("}"))


def section_command(level: Column, document_class: str) -> Column:
    """The command of a named level; chapters only in classes that have them."""
    chapter = r"\chapter" if document_class.lower() in ("book", "report", "memoir") else r"\section"
    return F.when(level == "part", r"\part").when(level == "chapter", chapter).when(level == "subsection", r"\subsection").when(level == "subsubsection", r"\subsubsection").otherwise(r"\section")


def markdown_heading(text: Column) -> tuple[Column, Column]:
    """Level and LaTeX of a heading on the first non-blank line, null if that is none."""
    first = F.regexp_extract(text, r"^\s*([^\n]*)", 1)
    level = F.length(F.regexp_extract(first, r"^(#{1,6})\s+.+$", 1))
    level = F.when(level > 0, level)
    return level, heading(F.trim(F.regexp_extract(first, r"^#{1,6}\s+(.+)$", 1)), level)


def packages(latex: Column) -> Column:
    """Names of the packages whose commands occur."""
    def used(markers):
        found = F.lit(False)
        for m in markers:
            found = found | F.contains(latex, F.lit(m))
        return found

    return F.array_compact(F.array(*(F.when(used(m), p) for p, m in PACKAGES.items())))


def unclosed(text: Column, pairs: str = "{}") -> tuple[Column, Column]:
    """Of one kind of bracket: how many closers had no opener, and how many openers were left."""
    chars = F.regexp_extract_all(text, F.lit("[" + "".join("\\" + c for c in pairs) + "]"), F.lit(0))
    start = F.struct(F.lit(0).alias("extra"), F.lit(0).alias("open"))

    def step(s, c):
        up = c == pairs[0]
        return F.struct(
            F.when(~up & (s["open"] == 0), s["extra"] + 1).otherwise(s["extra"]).alias("extra"),
            F.when(up, s["open"] + 1).otherwise(F.greatest(s["open"] - 1, F.lit(0))).alias("open"),
        )

    out = F.aggregate(chars, start, step)
    return out["extra"], out["open"]


def nested(text: Column) -> Column:
    """Whether braces and square brackets close in the order that they were opened."""
    chars = F.regexp_extract_all(text, F.lit(r"[{}\[\]]"), F.lit(0))

    def step(s, c):
        closes = ((c == "}") & s.endswith("{")) | ((c == "]") & s.endswith("["))
        return F.when(s.startswith("!"), s).when(c.isin("{", "["), F.concat(s, c)).when(closes, F.left(s, F.length(s) - 1)).otherwise("!")

    return F.aggregate(chars, F.lit(""), step) == ""


def count_of(text: Column, token: str) -> Column:
    """How often a literal occurs."""
    return F.coalesce(((F.char_length(text) - F.char_length(F.replace(text, F.lit(token), F.lit("")))) / len(token)).cast("int"), F.lit(0))


def equation_issues(latex: Column) -> Column:
    """Codes of what is wrong with an equation; mathematics isn't parsed."""
    t = F.trim(latex)
    extra, left = unclosed(t, "()")
    unknown = [F.when(F.contains(t, F.lit(f)) & ~F.contains(t, F.lit("\\" + f)), "unknown-function") for f in FUNCTIONS]
    found = F.array_compact(F.array(F.when(~nested(t), "unbalanced-braces"), F.when((extra > 0) | (left > 0), "unbalanced-parentheses"), F.when(count_of(t, r"\left") != count_of(t, r"\right"), "unmatched-left-right"), *unknown))
    return F.when(t == "", F.array(F.lit("empty-equation"))).otherwise(found)


def equation_score(issues: Column) -> Column:
    """0.95 without issues, else 0.8 less 0.25 for each error and 0.1 for each warning; 0 for an empty equation."""
    warnings = F.size(F.filter(issues, lambda x: x.isin("unmatched-left-right", "unknown-function")))
    errors = F.size(issues) - warnings
    return F.when(F.array_contains(issues, "empty-equation"), 0.0).when(F.size(issues) == 0, 0.95).otherwise(F.greatest(F.lit(0.0), 0.8 - (errors * 0.25 + warnings * 0.1)))


# Notes on an equation's health.
HEALTH = {"extra": "extra closing brace", "open": "unmatched braces", "delimiters": "left/right delimiter mismatch", "placeholder": "placeholder '?' detected in equation"}


def equation_health(text: Column) -> Column:
    """Notes on an equation: braces, left and right delimiters, placeholders."""
    extra, left = unclosed(text)
    faults = {"extra": extra > 0, "open": (extra == 0) & (left > 0), "delimiters": count_of(text, r"\left") != count_of(text, r"\right"), "placeholder": F.contains(text, F.lit("?"))}
    return F.array_compact(F.array(*(F.when(holds, HEALTH[k]) for k, holds in faults.items())))


def snippet_syntax(latex: Column) -> Column:
    """1 less a sixth for each brace without a partner."""
    extra, left = unclosed(latex)
    return F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), (extra + left) / 6.0))


def document_syntax(latex: Column) -> Column:
    """1 less a tenth for each brace left open."""
    _, left = unclosed(latex)
    return F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), left / 10.0))


def style_score(latex: Column) -> Column:
    total = F.lit(0)
    for token in STYLE:
        total = total + F.contains(latex, F.lit(token)).cast("int")
    return F.least(F.lit(1.0), total * 0.2)


def math_class(text: Column) -> tuple[Column, Column]:
    """Class and score of a text by the first rule that holds."""
    t, low = F.trim(text), F.lower(F.trim(text))
    rules = [(t == "", "empty", 0.0)]
    for pattern, name, score in MATH_CLASSES:
        holds = t.rlike(pattern)
        if name == "inline-equation":
            holds = holds & (F.char_length(t) < 256)
        if name == "proof-step":
            holds = holds | low.startswith("proof")
        rules.append((holds, name, score))
    rules += [(low.startswith("question") | low.startswith("problem"), "question-stem", 0.6), (low.startswith("solution") | low.startswith("answer"), "solution-text", 0.6), (F.lit(True), "paragraph", 0.4)]
    name, score = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for holds, n, s in rules[1:]:
        name, score = name.when(holds, n), score.when(holds, s)
    return name, score


def math_environment(kind: Column, text: Column) -> Column:
    """The environment for a block; null where it needs none."""
    t = F.trim(text)
    existing = F.regexp_extract(t, r"\\begin\{([a-z*]+)\}", 1)
    return (
        F.when(t == "", None)
        .when(t.startswith("\\[") & t.endswith("\\]"), "displaymath")
        .when(existing != "", existing)
        .when(kind == "table", None)
        .when(t.rlike("(?i)(cases|piecewise)"), "cases")
        .when(F.contains(t, F.lit("&")) | F.contains(t, F.lit("\\")), "align*")
        .when(kind.isin("equation", "formula") | t.rlike(r"\$[^$].*?\$"), "equation")
    )


def normalise_equation(latex: Column) -> Column:
    """Fractions with braces, functions with a backslash, operators between single spaces."""
    out = F.regexp_replace(latex, r"\\frac\s+([^\s\\{}]+)\s+([^\s\\{}]+)", r"\\frac{$1}{$2}")
    out = F.regexp_replace(out, r"\\frac\s*([0-9A-Za-z])([0-9A-Za-z])", r"\\frac{$1}{$2}")
    out = F.regexp_replace(out, r"(?<![\\A-Za-z0-9_])(" + "|".join(NORMALISED_FUNCTIONS) + r")(?![A-Za-z0-9_])", r"\\$1")
    out = F.regexp_replace(out, r"\s*([=+\-*/])\s*", " $1 ")
    return F.trim(F.regexp_replace(out, r"\s{2,}", " "))


def close_brackets(latex: Column) -> Column:
    """Closers appended for the brackets left open; a closer without its opener stays."""
    chars = F.regexp_extract_all(latex, F.lit(r"[{}()\[\]]"), F.lit(0))

    def step(s, c):
        closes = ((c == "}") & s.startswith("}")) | ((c == ")") & s.startswith(")")) | ((c == "]") & s.startswith("]"))
        return F.when(c.isin("{", "(", "["), F.concat(F.translate(c, "{([", "})]"), s)).when(closes, F.substring(s, 2, 1 << 30)).otherwise(s)

    left, right = count_of(latex, r"\left"), count_of(latex, r"\right")
    out = F.concat(latex, F.aggregate(chars, F.lit(""), step))
    return F.when(left > right, F.concat(out, F.lit(r"\right."))).when(right > left, F.concat(F.lit(r"\left."), out)).otherwise(out)


def length_similarity(source: Column, generated: Column) -> Column:
    """1 less the relative difference of lengths; 0.2 beyond a half, 0 if a side is blank."""
    a, b = F.char_length(F.trim(source)), F.char_length(F.trim(generated))
    ratio = b / F.greatest(a, F.lit(1))
    return F.when((a == 0) | (b == 0), 0.0).when((ratio > 1.5) | (ratio < 0.5), 0.2).otherwise(F.least(F.lit(1.0), 1.0 - F.abs(1 - ratio)))


def caption_score(caption: Column, context: Column) -> Column:
    """0.6 of how many different words a caption has (12 suffice) and 0.4 of how many its context shares."""
    own = F.array_distinct(F.filter(F.split(F.trim(F.lower(caption)), r"\s+"), lambda w: w != ""))
    there = F.filter(F.split(F.trim(F.lower(context)), r"\s+"), lambda w: w != "")
    n = F.size(own)
    relevance = F.least(F.lit(1.0), F.size(F.array_intersect(own, there)) / F.greatest(n, F.lit(1)) + 0.2)
    return F.when(F.coalesce(caption, F.lit("")) == "", 0.0).otherwise(F.least(F.lit(1.0), n / 12.0) * 0.6 + relevance * 0.4)


# What a document's looks gain by; each needs one marker of every group.
AESTHETIC_BASE = 0.3
AESTHETICS = (
    (((r"\usepackage{booktabs}", r"\toprule"),), 0.2),
    (((r"\begin{align", r"\begin{equation}"),), 0.1),
    (((r"\usepackage{geometry}",), ("margin",)), 0.05),
    (((r"\begin{figure",), (r"\includegraphics",)), 0.15),
    (((r"\usepackage{hyperref}",),), 0.05),
    (((r"\begin{table}",), (r"\caption",)), 0.1),
)


def aesthetic_score(latex: Column) -> Column:
    """What a document's markers are worth, 1 at most."""
    total = F.lit(AESTHETIC_BASE)
    for groups, worth in AESTHETICS:
        holds = F.lit(True)
        for markers in groups:
            holds = holds & latex.rlike("|".join(re.escape(m) for m in markers))
        total = total + F.when(holds, worth).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
