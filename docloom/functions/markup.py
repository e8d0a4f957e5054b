"""Column expressions that turn Markdown into LaTeX and mend LaTeX: blocks, macros, environments, preambles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.latex import escape, replace_all
from docloom.functions.text import plain_prose

# Glyphs of recognised text and what they become.
OCR_GLYPHS = (("−", "-"), ("–", "-"), ("—", "-"), ("∗", "*"), ("ﬁ", "fi"), ("ﬂ", "fl"))
# Characters of mathematics, and words that keep a line out of it.
MATH_CHARACTERS = "=+−*/^±∞√<>≤≥≈≡"
TEXT_MARKERS = ("Section", "Question", "Introduction")
# Joined macros and macros that text must hold in math mode, in this order.
JOINED = ((r"\inR", r"\ensuremath{\in \mathbb{R}}"), (r"\inZ", r"\ensuremath{\in \mathbb{Z}}"), (r"\inN", r"\ensuremath{\in \mathbb{N}}"))
MATH_MACROS = ("pm", "times", "neq", "leq", "geq", "le", "ge", "in", "infty", "Rightarrow", "rightarrow", "leftarrow", "Leftrightarrow", "cdot", "approx", "equiv", "propto", "angle", "nabla", "partial", "alpha", "beta", "gamma", "theta", "pi", "mu", "sigma", "omega", "Delta")
# Glyphs and macros of a model's output, in this order.
OUTPUT_GLYPHS = (
    ("≠", r"\ensuremath{\neq}"), ("≤", r"\ensuremath{\leq}"), ("≥", r"\ensuremath{\geq}"), ("×", r"\ensuremath{\times}"), ("−", "-"), ("’", "'"), ("“", "``"), ("”", "''"), ("…", r"\dots"),
    ("̸=", r"\ensuremath{\neq}"), ("≈", r"\ensuremath{\approx}"), ("←", r"\ensuremath{\leftarrow}"), ("→", r"\ensuremath{\rightarrow}"), ("⇒", r"\ensuremath{\Rightarrow}"), ("⇐", r"\ensuremath{\Leftarrow}"),
    ("⇔", r"\ensuremath{\Leftrightarrow}"), ("±", r"\ensuremath{\pm}"), ("∞", r"\ensuremath{\infty}"), ("°", r"\ensuremath{^{\circ}}"), ("µ", r"\ensuremath{\mu}"),
)
OUTPUT_MACROS = ("Rightarrow", "rightarrow", "leftarrow", "leftrightarrow", "Leftarrow", "Leftrightarrow", "neq", "leq", "geq", "approx", "pm", "infty", "times")
# Lines of a prompt that a snippet repeats.
PROMPT_LINES = ("style exemplar", "content-type", "source text", "baseline snippet", "respond with", "<latex>", "<<<source", "high-quality exemplars")
INTERNAL_MACRO = r"\\providecommand.*(?:enit@|endtable)"
EQUATION_BLOCK = r"(?is)\\begin\{equation\*?\}(.*?)\\end\{equation\*?\}"
ENVIRONMENTS = {
    "table": r"(?s)\\begin\{table\}.*?\\end\{table\}",
    "figure": r"(?s)\\begin\{figure\}.*?\\end\{figure\}",
    "equation": r"(?s)\\begin\{(equation\*?|align\*?|multline)\}.*?\\end\{\1\}",
}
PACKAGE = r"\\usepackage(?:\[[^\]]*\])?\{([^}]+)\}"


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def keep_lines(text: Column, fit) -> Column:
    """The lines for which ``fit`` holds."""
    return F.array_join(F.filter(lines(text), fit), "\n")


def clean_glyphs(text: Column) -> Column:
    """Recognised text with plain glyphs, digits joined across gaps, and single spaces beside operators."""
    text = F.regexp_replace(replace_all(text, OCR_GLYPHS), r"(?<=[0-9])\s+(?=[0-9])", "")
    return F.regexp_replace(F.regexp_replace(text, r"([=+\-])\s{2,}", "$1 "), r"\s{2,}([=+\-])", " $1")


def inline_markdown(text: Column) -> Column:
    """Bold, italic, code and headings of Markdown as LaTeX."""
    text = F.regexp_replace(text, r"(\*\*|__)(.+?)\1", r"\\textbf{$2}")
    text = F.regexp_replace(text, r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", r"\\textit{$1}")
    text = F.regexp_replace(text, r"(?<!_)_(?!_)(.+?)(?<!_)_(?!_)", r"\\textit{$1}")
    text = F.regexp_replace(text, "`([^`]+)`", r"\\texttt{$1}")
    for level, command in ((1, "section"), (2, "subsection"), (3, "subsubsection"), ("4,6", "paragraph")):
        text = F.regexp_replace(text, rf"(?m)^#{{{level}}}\s+(.*?\S)[ \t]*$", rf"\\{command}{{$1}}")
    return text


def table_cells(line: Column) -> Column:
    """Escaped cells of a Markdown table line; an empty one holds a thin space, escaped like any text."""
    cells = F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|")
    return F.transform(cells, lambda c: escape(F.when(F.trim(c) == "", r"\,").otherwise(F.trim(c)), None))


def table_environment(rows: Column) -> Column:
    """A tabular from rows of cells (a column); the second row may be a separator. Rows are filled up to the header's width."""
    rule = F.coalesce(F.forall(F.get(rows, F.lit(1)), lambda c: c.rlike("^[-: ]*$")), F.lit(False))
    body = F.slice(rows, F.when(rule, 3).otherwise(2), F.greatest(F.size(rows), F.lit(1)))
    width = F.size(F.get(rows, F.lit(0)))
    row = lambda r: F.concat(F.lit("    "), F.array_join(r, " & "), F.lit(r" \\"))
    filled = lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0))))
    head = F.concat(F.lit("\\begin{table}[H]\n  \\centering\n  \\begin{tabular}{"), F.repeat(F.lit("l"), F.greatest(width, F.lit(1))), F.lit("}\n    \\toprule\n"), row(F.get(rows, F.lit(0))))
    middle = F.when(F.size(body) > 0, F.concat(F.lit("\n    \\midrule\n"), F.array_join(F.transform(body, lambda r: row(filled(r))), "\n"))).otherwise("")
    return F.concat(head, middle, F.lit("\n    \\bottomrule\n  \\end{tabular}\n\\end{table}"))


def is_mathy(line: Column) -> Column:
    """Whether a line is a formula in plain text: an operator, and letters in at most 70 % of it."""
    t = F.trim(line)
    marked = t.startswith("\\")
    for m in TEXT_MARKERS:
        marked = marked | F.contains(t, F.lit(m))
    return (t != "") & ~marked & t.rlike("[" + "".join("\\" + c for c in MATH_CHARACTERS) + "]") & (F.regexp_count(t, F.lit(r"\p{L}")) * 10 <= F.char_length(t) * 7)  # whole numbers: 90 * 0.7 is below 63


def _aligned(line: Column) -> Column:
    """An equation with an alignment mark before its first sign of equality."""
    return F.when(F.contains(line, F.lit("=")) & ~F.contains(line, F.lit("&")), F.concat(F.trim(F.regexp_extract(line, r"(?s)^([^=]*)=", 1)), F.lit(" & = "), F.trim(F.regexp_extract(line, r"(?s)^[^=]*=(.*)$", 1)))).otherwise(line)


def equation_body(line: Column) -> Column:
    """A display equation's line without its brackets, aligned."""
    body = F.regexp_replace(F.regexp_replace(F.trim(line), r"^(\[|\\\[)", ""), r"(\\\]|\])$", "")
    return _aligned(F.trim(body))


def force_align(latex: Column) -> Column:
    """A snippet as one align environment, unless it has one or is blank."""
    kept = F.filter(F.transform(lines(latex), lambda x: F.trim(x)), lambda x: x != "")
    body = F.array_join(F.transform(kept, _aligned), " \\\n")
    has = F.lower(latex).rlike(r"\\begin\{align(ed)?")
    return F.when(has | (F.size(kept) == 0), latex).otherwise(F.concat(F.lit("\\begin{align*}\n"), body, F.lit("\n\\end{align*}")))


def math_macros(text: Column) -> Column:
    """Macros that recognition joined or left in text, in math mode."""
    text = replace_all(text, JOINED)
    for m in ("Rightarrow", "rightarrow"):
        text = F.regexp_replace(text, rf"\\{m}([a-zA-Z])", rf"\\{m} $1")
    text = F.regexp_replace(text, r"\\sqrt(?![a-zA-Z])", r"\\ensuremath{\\surd}")
    for m in MATH_MACROS:
        text = F.regexp_replace(text, rf"\\{m}(?![a-zA-Z])", rf"\\ensuremath{{\\{m}}}")
    return text


def demote_equations(latex: Column) -> Column:
    """Equation environments that hold prose become escaped paragraphs."""
    found, rest = F.regexp_extract_all(latex, F.lit(EQUATION_BLOCK), F.lit(0)), F.split(latex, EQUATION_BLOCK)

    def rendered(block):
        body = F.regexp_extract(block, EQUATION_BLOCK, 1)
        flat = F.array_join(F.filter(F.transform(lines(body), lambda x: F.trim(x)), lambda x: x != ""), " ")
        return F.when(plain_prose(F.trim(body)), F.when(flat == "", "").otherwise(F.concat(F.lit("\\par "), escape(flat, None), F.lit("\\par\n")))).otherwise(block)

    return F.array_join(F.zip_with(rest, F.transform(found, rendered), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def refine_output(text: Column) -> Column:
    """A model's LaTeX with glyphs and macros in math mode and bare formulas as displays."""
    text = F.regexp_replace(replace_all(text, OUTPUT_GLYPHS), r"\\Rightarrow(?=[a-zA-Z0-9])", r"\\Rightarrow ")
    for m in OUTPUT_MACROS:
        text = F.regexp_replace(text, rf"(?<!\\ensuremath\{{)\\{m}(?![a-zA-Z])", rf"\\ensuremath{{\\{m}}}")
    text = F.regexp_replace(text, r"\\begin\{align\*?\}\s*\\\[", "\\\\begin{align}\n")
    text = F.regexp_replace(text, r"\\\]\s*\\end\{align\*?\}", "\n\\\\end{align}")

    def display(line):
        t = F.trim(line)
        bare = ~t.rlike(r"^([%\\]|$)") & t.rlike(r"[=^_]") & ~t.rlike(r"\$|\\\(|\\\[")
        return F.when(bare, F.concat(F.lit(r"\[ "), t, F.lit(r" \]"))).otherwise(line)

    return F.array_join(F.transform(lines(text), display), "\n")


def balance_environments(latex: Column) -> Column:
    """An ``\\end`` appended for each environment left open, innermost first; a wrong ``\\end`` closes nothing."""
    marks = F.regexp_extract_all(latex, F.lit(r"\\(?:begin|end)\{[^}]+\}"), F.lit(0))

    def step(open_, mark):
        name = F.regexp_extract(mark, r"\{([^}]+)\}", 1)
        closes = F.coalesce(F.get(open_, F.size(open_) - 1) == name, F.lit(False))
        return F.when(mark.startswith("\\begin"), F.concat(open_, F.array(name))).when(closes, F.slice(open_, 1, F.greatest(F.size(open_) - 1, F.lit(0)))).otherwise(open_)

    left = F.reverse(F.aggregate(marks, F.array().cast("array<string>"), step))
    return F.concat(latex, F.array_join(F.transform(left, lambda n: F.concat(F.lit("\n\\end{"), n, F.lit("}"))), ""))


def before_document(latex: Column, line: Column, present: Column) -> Column:
    """A line put in before the document begins, unless it is ``present`` or there is no beginning."""
    at = F.instr(latex, F.lit("\\begin{document}"))
    return F.when((at == 0) | present, latex).otherwise(F.concat(F.substring(latex, F.lit(1), at - 1), line, F.lit("\n"), F.substring(latex, at, F.lit(1 << 30))))


def inject_package(latex: Column, package: Column) -> Column:
    line = F.concat(F.lit("\\usepackage{"), package, F.lit("}"))
    return before_document(latex, line, F.contains(latex, line) | F.contains(latex, F.concat(F.lit("\\usepackage["), package, F.lit("]"))))


def define_command(latex: Column, command: Column) -> Column:
    """A fallback for an undefined command: its own name in typewriter letters."""
    macro = F.concat(F.lit("\\providecommand{\\"), command, F.lit("}{\\texttt{\\"), command, F.lit("}}"))
    return before_document(latex, macro, F.contains(latex, macro))


def normalise_displays(latex: Column) -> Column:
    """``$$`` as alternating display brackets, closed at the end if need be, and align as aligned."""
    parts = F.split(latex, r"\$\$")
    last = F.size(parts) - 1
    body = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.when(i == last, F.when(last % 2 == 1, r"\]").otherwise("")).when(i % 2 == 0, r"\[").otherwise(r"\]"))), "")
    return replace_all(body, ((r"\begin{align}", r"\begin{aligned}"), (r"\end{align}", r"\end{aligned}")))


def clean_snippet(text: Column) -> Column:
    """A snippet without quoted source blocks, prompt lines and code fences."""

    def step(s, line):
        t, low = F.trim(line), F.lower(F.trim(line))
        opens, closes = low.startswith("<<<source"), s["skip"] & t.isin("SOURCE", ">>>")
        prompt = t.isin("```latex", "```")
        for p in PROMPT_LINES:
            prompt = prompt | low.startswith(p)
        gone = opens | s["skip"] | prompt
        return F.struct(F.when(opens, True).when(closes, False).otherwise(s["skip"]).alias("skip"), F.when(gone, s["kept"]).otherwise(F.concat(s["kept"], F.array(line))).alias("kept"))

    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("kept"))
    return F.btrim(F.array_join(F.aggregate(lines(text), start, step)["kept"], "\n"), F.lit(" \n\t\r"))


def bibtex_entries(text: Column) -> Column:
    """BibTeX of the lines that begin with a number or a number in brackets, named by their place."""
    rows = F.transform(lines(text), lambda x, i: F.when(x.rlike(r"^[\[?]?[0-9]+\]?\.? "), F.concat(F.lit("@article{ref"), i, F.lit(",\n  title={"), x, F.lit("},\n  author={Unknown},\n  year={2024}\n}"))))
    return F.array_join(F.array_compact(rows), "\n\n")


def placeholder_entry(key: Column) -> Column:
    """BibTeX for a citation that nothing is known of."""
    return F.concat(F.lit("@misc{"), key, F.lit(",\n  title={Placeholder reference},\n  author={Unknown},\n  year={2024},\n  note={Auto-generated placeholder for missing citation}\n}"))


def environments(latex: Column) -> Column:
    """(kind, at, text) of the tables, figures and equations of a document, numbered by kind."""

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(latex, F.lit(pattern), F.lit(0)), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.trim(x).alias("text")))

    return F.concat(*(found(k, p) for k, p in ENVIRONMENTS.items()))


def preamble_packages(latex: Column) -> Column:
    """Names of the packages that a preamble asks for, in order; lists are split at commas."""
    names = F.flatten(F.transform(F.regexp_extract_all(latex, F.lit(PACKAGE), F.lit(1)), lambda x: F.split(x, ",")))
    return F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != "")


def semantic_wrap(text: Column, latex: Column, domain: Column, proof_role: Column, conservative: bool = False) -> tuple[Column, Column]:
    """A snippet inside the environment that its text asks for, and the environment's name (empty: none)."""
    t, body = F.trim(text), F.trim(latex)
    formal, technical = domain.isin("mathematics", "physics"), domain.isin("computer_science", "engineering")
    word, first = F.lower(F.regexp_extract(t, r"(?i)^(theorem|lemma|definition|corollary|proposition)\b", 1)), F.trim(F.regexp_extract(t, r"^([^\n]*)", 1))
    algorithm = technical & t.rlike(r"(?i)\b(algorithm|procedure)\b")
    theorem = formal & (word != "")
    if conservative:
        algorithm, theorem = algorithm & F.contains(F.lower(t), F.lit("input:")), theorem & first.endswith(".")
    proof = formal & (proof_role.startswith("proof") | t.rlike(r"(?i)^(proof|sketch)\b"))
    name = F.when(word.isin("definition", "lemma", "corollary"), word).otherwise("theorem")
    label = F.when(algorithm, "algorithm").when(theorem, name).when(F.coalesce(proof, F.lit(False)), "proof").otherwise("")
    caption = F.when(F.char_length(first) > 80, F.concat(F.substring(first, 1, 77), F.lit("..."))).otherwise(first)
    coded = F.concat(F.lit("\\begin{algorithm}[H]\n\\caption{"), caption, F.lit("}\n\\begin{algorithmic}\n"), body, F.lit("\n\\end{algorithmic}\n\\end{algorithm}"))
    qed = F.when((label == "proof") & ~F.contains(body, F.lit("\\qedhere")), "\n\\qedhere").otherwise("")
    wrapped = F.concat(F.lit("\\begin{"), label, F.lit("}\n"), body, qed, F.lit("\n\\end{"), label, F.lit("}"))
    return F.when(label == "", latex).when(label == "algorithm", coded).otherwise(wrapped), label
