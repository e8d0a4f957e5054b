"""LaTeX functions, fusions, graphs and page layouts on small inline rows."""

import random

from pyspark.sql import functions as F

from docloom.functions import latex as L
from docloom.operators import fusion, graph, layout
from docloom.operators import latex as X


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_escapes(spark):
    assert one(spark, L.escape(F.col("t")), t="a_b\\{~^\n%") == r"a\_b\textbackslash{}\{\textasciitilde{}\textasciicircum{}\\ \%"
    assert one(spark, L.escape_plain(F.col("t")), t=r"a & b \& 5%") == r"a \& b \& 5\%"
    assert one(spark, L.fallback_candidate(F.col("t")), t="\\") == r"\textbackslash\{\}"


def test_symbols(spark):
    got = one(spark, L.symbols(F.col("t")), t="x ∈ A ∪ B ⇒ x ≥ 0 and y ≤ ∞ − 1\ufffd\x01")
    assert r"\in" in got and r"\cup" in got and r"\geq" in got and "- 1?" in got and "\x01" not in got


def test_plain_text_and_fences(spark):
    assert one(spark, L.plain_text(F.col("t")), t="\\section{A} one $x$ two % note\nthree") == "one two three"
    assert one(spark, L.fences(F.col("t")), t="a ```\nx = 1\n``` b") == "a \\begin{verbatim}\nx = 1\n\\end{verbatim} b"


def test_headings(spark):
    level, latex = L.markdown_heading(F.col("t"))
    assert one(spark, F.struct(level, latex), t="\n### Deep \nbody")[:] == (3, r"\subsubsection{Deep}")
    assert one(spark, level, t="no heading") is None


def test_brackets(spark):
    for t, issues in (("", ["empty-equation"]), ("{[}]", ["unbalanced-braces"]), (")(", ["unbalanced-parentheses"]), (r"\left( x", ["unbalanced-parentheses", "unmatched-left-right"]), ("sin x", ["unknown-function"]), ("x", [])):
        assert one(spark, L.equation_issues(F.col("t")), t=t) == issues, t
    assert one(spark, L.close_brackets(F.col("t")), t="{a(b]") == "{a(b])}"
    assert one(spark, L.close_brackets(F.col("t")), t=r"\left(a)") == r"\left(a)\right."
    assert one(spark, L.normalise_equation(F.col("t")), t=r"\frac 1 2 +sin x=\frac34") == r"\frac{1}{2} + \sin x = \frac{3}{4}"


def test_math_classes(spark):
    for t, kind in ((r"\begin{align}x\end{align}", "display-equation"), ("$x$", "inline-equation"), ("Proof. Clear", "proof-step"), ("f(x) = 2", "function-definition"), ("Question 1", "question-stem"), ("", "empty"), ("words", "paragraph")):
        assert one(spark, L.math_class(F.col("t"))[0], t=t) == kind, t


def test_references(spark):
    rows = spark.createDataFrame([(1, "c1", 1, "text", r"\label{a} x"), (1, "c2", 2, "text", r"\ref{a} \eqref{no} \ref{c1}")], "doc_id long, chunk_id string, pos int, region_type string, latex string")
    got = {(r.target, r.label, r.status) for r in X.link_references(X.references(rows).drop("at"), X.labels(rows)).collect()}
    assert got == {("a", "a", "resolved"), ("no", None, "unresolved"), ("c1", "a", "resolved")}
    assert X.reference_contexts(rows).first().context == "% Reference Context (text):\n\\label{a} x"


def test_log_windows(spark):
    logs = spark.createDataFrame([(1, "l.3 x\nl.40\nl.50\nl.60")], "id int, log string")
    assert [(r.first, r.last) for r in X.repair_windows(logs, "id", "log").orderBy("at").collect()] == [(1, 9), (34, 46), (44, 56)]


def test_unique_names_and_tables(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a")], "doc_id int, pos int, name string")
    assert [r.name for r in graph.unique_names(rows, ["doc_id"], "name", "pos").orderBy("pos").collect()] == ["a", "a-1", "b", "a-2"]
    a = spark.createDataFrame([(1, 1, 3), (1, 2, 2)], "doc_id int, pos int, columns int")
    none = fusion.table_diff(a, a.where("false")).first()
    assert (none.columns_match, none.count_match, none.column_delta) == (0.0, 0.0, 1.0)


def test_xy_cut():
    assert [b[4] for b in layout.xy_cut([(0, 200, 90, 220, "World"), (0, 100, 90, 120, "Hello")])] == ["Hello", "World"]
    two = [(0, 0, 200, 20, 1), (0, 30, 200, 50, 2), (300, 0, 500, 20, 3), (300, 30, 500, 50, 4)]
    assert [b[4] for b in layout.xy_cut(two)] == [1, 2, 3, 4]
    rng = random.Random(3)
    for _ in range(200):
        boxes = [(x := rng.randrange(600), y := rng.randrange(800), x + rng.randrange(1, 200), y + rng.randrange(1, 100), i) for i in range(rng.randrange(12))]
        assert sorted(layout.xy_cut(boxes)) == sorted(boxes)


def test_xy_order_by_page(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 200.0, 90.0, 220.0), (2, 0, 0.0, 100.0, 90.0, 120.0), (3, 1, 0.0, 0.0, 9.0, 9.0)], "id long, page int, x0 double, y0 double, x1 double, y1 double")
    assert {(r.id, r.place) for r in layout.xy_order(rows).collect()} == {(2, 1), (1, 2), (3, 1)}
