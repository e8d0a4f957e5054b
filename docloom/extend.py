"""What callers may plug in: extractors, agents, encoders, fusion strategies, branches, lookups, rules, converters.

A plug-in is a function over rows or columns, registered by name. Column functions stay in
the JVM; functions over batches of rows run in Python workers, with one set-up a worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import profiles as P
from docloom.operators import fusion
from docloom.operators.markup import word_vector


class Registry(dict):
    """Functions by name. ``auto`` is the order in which they are tried."""

    def register(self, name: str):
        def put(f):
            self[name] = f
            return f

        return put

    def chosen(self, names: str | list[str] = "auto") -> list[str]:
        """The names asked for that are registered; all in their order for ``auto`` and ``ensemble``."""
        asked = list(self) if names in ("auto", "ensemble") else [names] if isinstance(names, str) else names
        found = [n for n in asked if n in self]
        if not found:
            raise KeyError(f"none of {asked} is registered")
        return found


@dataclass
class Extractor:
    """Rows by batches in Python workers; ``warmup`` makes what a worker needs, once for each of its tasks and before its first batch."""

    schema: str
    extract_batch: Callable[[Any, pd.DataFrame], pd.DataFrame]
    warmup: Callable[[], Any] = lambda: None

    def __call__(self, rows: DataFrame) -> DataFrame:
        make, extract = self.warmup, self.extract_batch

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state, ready = None, False
            for b in batches:
                if not ready:
                    state, ready = make(), True
                yield extract(state, b)

        return rows.mapInPandas(run, self.schema)


def agent_result(content: Column, confidence: Column, metadata: Column | None = None) -> Column:
    """What an agent returns: content, a confidence from 0 to 1, and metadata."""
    held = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(confidence, F.lit(0.0))))
    return F.struct(F.coalesce(content, F.lit("")).alias("content"), held.alias("confidence"), (metadata if metadata is not None else F.create_map().cast("map<string,string>")).alias("metadata"))


#: Recognisers of text on pages: rows (page, ...) to (page, text).
OCR = Registry()
#: Encoders: a text column to a list of buckets.
ENCODERS = Registry(hash=word_vector)
#: Converters of data sets into (id, tokens, bboxes, ner_tags).
CONVERTERS = Registry()
#: Lookups: a query's text to a table of (key, ...), or None when offline.
LOOKUPS = Registry(offline=lambda: None)
#: Fusion strategies: candidates to one row a chunk.
FUSIONS = Registry(
    rule=lambda c: fusion.rule_choice(fusion.judged(c), "specialist"),
    weighted=lambda c: fusion.fused(fusion.judged(c)),
)


def recognise(pages: DataFrame, names: str | list[str] = "auto") -> DataFrame:
    """(page, backend, rank, text) of all chosen recognisers in long form; the first of them has rank 0."""
    parts = [OCR[n](pages).select("page", F.lit(n).alias("backend"), F.lit(i).alias("rank"), "text") for i, n in enumerate(OCR.chosen(names))]
    return reduce(DataFrame.unionByName, parts)


def first_text(recognised: DataFrame) -> DataFrame:
    """For each page the text of the first recogniser that found any."""
    return recognised.where("trim(text) <> ''").groupBy("page").agg(F.min_by("text", "rank").alias("text"), F.min_by("backend", "rank").alias("backend"))


def adaptive_choice(candidates: DataFrame, strategies: dict[str, Column], otherwise: str) -> Column:
    """The name of the first strategy whose condition a chunk's candidates meet."""
    out = F.lit(otherwise)
    for name, holds in reversed(strategies.items()):
        out = F.when(holds, name).otherwise(out)
    return out


def merge_texts(candidates: DataFrame, key: str, merge: Callable[[Column], Column]) -> DataFrame:
    """(key, latex): a merge function over each chunk's candidates, best first (source, latex, weighted)."""
    got = candidates.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("weighted")).alias("order"), "source", "latex", "weighted"))).alias("c"))
    return got.select(key, merge(F.col("c")).alias("latex"))


def dispatch(kind: Column, agents: dict[str, Column], otherwise: Column) -> Column:
    """The agent's column for a block's class; ``otherwise`` for classes without one."""
    out = otherwise
    for name, agent in reversed(agents.items()):
        out = F.when(kind == name, agent).otherwise(out)
    return out


def agent_rows(rows: DataFrame, keep: list[str], agents: dict[str, Column]) -> DataFrame:
    """(keep, agent, score, error): one row for each agent; one whose score is null or not a number has an error instead."""
    each = [F.struct(F.lit(n).alias("agent"), F.when(F.isnan(s), None).otherwise(s).alias("score")) for n, s in ((n, s.cast("double")) for n, s in agents.items())]
    out = rows.select(*keep, F.explode(F.array(*each)).alias("a"))
    return out.select(*keep, "a.agent", F.coalesce("a.score", F.lit(0.0)).alias("score"), F.when(F.col("a.score").isNull(), "failed").alias("error"))


@dataclass
class TypographyRule:
    """A directive and its parameter for documents that meet a condition."""

    name: str
    applies: Column
    directive: Column = field(default_factory=lambda: F.lit(""))


def typography_rules(document_class: Column, profile: Column, options: Column) -> list[TypographyRule]:
    """Seven rules from a document's class, its profile and a map of options."""
    asked = lambda k: F.try_element_at(options, F.lit(k))
    serif, slides = profile == "scholarly-serif", profile == "presentation-sans"
    return [
        TypographyRule("font", F.lit(True), F.when(serif, r"\usepackage{newtxtext}").when(slides, r"\usepackage{libertine}").otherwise(r"\usepackage{mathpazo}")),
        TypographyRule("language", asked("language").isNotNull(), F.concat(F.lit(r"\usepackage["), asked("language"), F.lit("]{babel}"))),
        TypographyRule("microtype", ~slides, F.lit(r"\usepackage{microtype}")),
        TypographyRule("spacing", asked("line_stretch").isNotNull(), F.concat(F.lit(r"\linespread{"), asked("line_stretch"), F.lit("}"))),
        TypographyRule("paragraphs", asked("parskip").isNotNull(), F.concat(F.lit(r"\setlength{\parskip}{"), asked("parskip"), F.lit("}"))),
        TypographyRule("penalties", serif | document_class.isin("article", "report"), F.lit(r"\emergencystretch=1em")),
        TypographyRule("quotes", F.lit(True), F.lit(r"\usepackage{csquotes}")),
    ]


def directives(rules: list[TypographyRule]) -> Column:
    """The directives of the rules that apply, in their order."""
    return F.array_compact(F.array(*(F.when(r.applies, r.directive) for r in rules)))


def typography(document_class: Column, requested: Column, options: Column) -> Column:
    return directives(typography_rules(document_class, P.typography_profile(document_class, requested), options))
