"""Benchmark decontamination by template canonicalisation, with DataFrame operations only.

A text becomes words and typed placeholders: numbers (digits, or English number words),
units after or before a number, and names (runs of capitalised words inside a sentence, one
placeholder each with its first word, so "New York" may become "Paris"). Windows of
``WINDOW`` such tokens are hashed
and joined with those of the benchmark's items, so a question asked again with other
numbers, units or names still meets its item. A capitalised word that may only begin a
sentence is read both ways, as a word and as a name; a window counts if either reading
meets; read as a name it makes one with the names that follow it. An item shorter than a window, or without a window of enough words, is matched by
its whole sequence of tokens with their values. A second look, at the documents that cover
enough of an item only, checks the slots: along one alignment an item's value must always
become the same value; alignments that break this don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

WINDOW = 5
#: Share of an item's windows that a document must hold.
COVERAGE = 0.8
#: Words that a window needs besides placeholders to tell an item.
MIN_WORDS = 2
#: The benchmark's windows, or the documents found, are sent to every executor up to so many rows.
BROADCAST_ROWS = 1_000_000
#: Words that are units where a number precedes them.
UNITS = ("kg", "g", "mg", "lb", "lbs", "oz", "km", "m", "cm", "mm", "mi", "miles", "ft", "feet", "inches", "l", "ml", "s", "ms", "min", "h", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "percent", "dollars", "cents", "euros", "usd", "eur")

#: Words that are numbers.
NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion", "dozen")


def tokens(text: Column) -> Column:
    """Lower-case words, and placeholders that hold their value: a type (0x01 number, 0x02 unit, 0x03 name, 0x05 word or name), the value, 0x04.

    Repeated groups are possessive: Java matches greedy ones by recursion, and a run of some
    2000 capitalised words overflowed a task's stack, which ends the executor.
    """
    text = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\x01\x02\x03\x04\x05", "     ")
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    numbered = F.regexp_replace(text, rf"(?<=[0-9])(\s?)(%|(?i:{units})(?![\p{{L}}\p{{N}}]))", "\x02$2\x04")
    numbered = F.regexp_replace(numbered, r"([$€£])(?=[0-9])", "\x02$1\x04")
    numbered = F.regexp_replace(numbered, "(?<![\\p{L}\\p{N}\x02])([0-9]+(?:[.,:/][0-9]+)*+)", "\x01$1\x04")
    text = F.when(text.rlike("[0-9]"), numbered).otherwise(text)
    text = F.regexp_replace(text, r"(\p{Lu}(?<=[\p{Ll},;] .)\p{L}*)(?:\s\p{Lu}\p{L}*)*+", "\x03$1\x04")
    text = F.regexp_replace(text, "(?<![\\p{L}\\p{N}\x01-\x03])(\\p{Lu}\\p{L}*)", "\x05$1\x04")
    return F.regexp_extract_all(F.lower(text), F.lit("[\x01-\x03\x05][^\x04]*\x04|[\\p{L}\\p{N}]+"), F.lit(0))


def _worded(rows: DataFrame) -> DataFrame:
    """``rows`` (column ``toks``) with number words, and units after these, as placeholders."""
    number = lambda t: t.isin(*NUMBERS, *(f"\x05{n}\x04" for n in NUMBERS))
    unit = lambda t, i: t.isin(*UNITS) & F.coalesce(number(F.get("toks", i - 1)), F.lit(False))
    return rows.withColumn("toks", F.transform("toks", lambda t, i: F.when(t.isin(*NUMBERS), F.concat(F.lit("\x01"), t, F.lit("\x04"))).when(unit(t, i), F.concat(F.lit("\x02"), t, F.lit("\x04"))).otherwise(t)))


def _named(token: Column) -> Column:
    return F.coalesce(token.startswith("\x03") | token.startswith("\x05"), F.lit(False))


def _follows_name(toks: Column, i: Column) -> Column:
    """Whether the name at ``i`` goes on one before it."""
    return _named(F.get(toks, i)) & _named(F.get(toks, i - 1))


def _read(toks: Column, names: bool) -> Column:
    """The tokens (a column) with each word or name read as a word, or as a name together with those before it."""
    if names:
        first = F.filter(toks, lambda t, i: ~_follows_name(toks, i))
        return F.transform(first, lambda t: F.when(t.startswith("\x05"), F.concat(F.lit("\x03"), F.substring(t, 2, 1 << 30))).otherwise(t))
    plain = lambda t: F.translate(t, "\x04\x05", "")
    return F.transform(toks, lambda t: F.when(t.startswith("\x05"), F.when(plain(t).isin(*NUMBERS), F.concat(F.lit("\x01"), F.substring(t, 2, 1 << 30))).otherwise(plain(t))).otherwise(t))


def _places(toks: Column, names: bool) -> Column:
    """For each token of a reading its place in ``toks``."""
    every = F.sequence(F.lit(0), F.greatest(F.size(toks) - 1, F.lit(0)))
    return F.filter(every, lambda i: ~_follows_name(toks, i)) if names else every


def _template(token: Column) -> Column:
    return F.when(token < "\x04", F.substring(token, 1, 1)).otherwise(token)


def _with_hashes(rows: DataFrame, window: int) -> DataFrame:
    """``rows`` (column ``toks``) with ``hashes``: one for each window of templates; texts with fewer tokens have one window of all.

    Two projections, as an array that a lambda reads must be a column: it would be made anew for each element.
    Explode the hashes with an outer generator: the filter that the optimizer adds to an inner one repeats all this.
    """
    each = F.col("_each")
    rows = rows.withColumn("_each", F.transform("toks", lambda t: F.xxhash64(_template(t))))
    long = F.transform(F.slice(each, 1, F.greatest(F.size(each) - (window - 1), F.lit(1))), lambda x, i: F.xxhash64(x, *(F.get(each, i + k) for k in range(1, window))))
    return rows.withColumn("hashes", F.when(F.size(each) == 0, F.array().cast("array<bigint>")).otherwise(long)).drop("_each")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.xxhash64("text").alias("key"), F.col("text"))


def _windows(rows: DataFrame, window: int, *keep: str) -> DataFrame:
    """(*keep, at, place, hash, slots) of each window: where it begins in its reading and in the tokens, and its placeholders with their values, null for words."""
    both = F.array(*(F.struct(_places(F.col("toks"), n).alias("places"), _read(F.col("toks"), n).alias("toks")) for n in (False, True)))
    rows = rows.select(*keep, F.explode(both).alias("r")).select(*keep, "r.places", "r.toks")
    rows = _with_hashes(rows, window)
    slots = lambda i: F.transform(F.slice("toks", i + 1, window), lambda t: F.when(t < "\x04", t))
    each = F.transform("hashes", lambda h, i: F.struct(h.alias("hash"), i.alias("at"), F.get("places", i).alias("place"), slots(i).alias("slots")))
    rows = rows.withColumn("_windows", each).select(*keep, F.explode_outer("_windows").alias("w"))
    return rows.select(*keep, "w.at", "w.place", "w.hash", "w.slots")


def item_windows(benchmark: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """(item_id, at, place, hash, slots, n_windows): the windows that tell each item; windows with fewer words than ``min_words`` are left out."""
    toks = _worded(benchmark.where("item_id is not null").select("item_id", tokens(F.col("text")).alias("toks")))
    each = _windows(toks, window, "item_id").where("hash is not null")
    words = F.size(F.filter("slots", lambda s: s.isNull()))
    each = each.where(words >= F.least(F.lit(min_words), F.size("slots")))
    each = each.join(_short(toks, window, min_words), "item_id", "left_anti")
    n = each.groupBy("item_id").agg(F.countDistinct("place").alias("n_windows"))
    return each.join(n, "item_id")


def _values(toks: Column) -> Column:
    """The tokens without their types."""
    return F.transform(toks, lambda t: F.translate(t, "\x01\x02\x03\x04\x05", ""))


def _short(toks: DataFrame, window: int, min_words: int) -> DataFrame:
    """(item_id, toks) of items that have tokens, but fewer than a window or no window of enough words."""
    words = lambda i: F.size(F.filter(F.slice("_words", i + 1, window), lambda t: t >= "\x04"))
    rows = toks.where(F.size("toks") > 0).withColumn("_words", _read(F.col("toks"), False))
    telling = F.exists(F.sequence(F.lit(0), F.greatest(F.size("toks") - window, F.lit(0))), lambda i: words(i) >= min_words)
    return rows.where((F.size("toks") < window) | ~telling).select("item_id", "toks")


def _whole_matches(docs: DataFrame, benchmark: DataFrame, window: int, min_words: int = MIN_WORDS) -> DataFrame | None:
    """(doc_id, key, item_id) where a document holds all tokens of a short item in a row, with their values; None without short items."""
    toks = _worded(benchmark.where("item_id is not null").select("item_id", tokens(F.col("text")).alias("toks")))
    short = _short(toks, window, min_words).select("item_id", F.size("toks").alias("size"), F.xxhash64(_values(F.col("toks"))).alias("hash"))
    short = materialize(short, "short-items")
    sizes = sorted(r["size"] for r in short.select("size").distinct().collect())
    if not sizes:
        return None
    rows = _worded(docs.select("doc_id", "key", tokens(F.col("text")).alias("toks"))).withColumn("toks", _values(F.col("toks")))

    def held_at(n: int) -> Column:  # a function, as a lambda's second parameter would be the index
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size("toks") - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("toks", i, n)))

    rows = rows.select("doc_id", "key", F.explode_outer(F.array_distinct(F.concat(*(held_at(n) for n in sizes)))).alias("hash"))
    return rows.join(_sized(short.select("item_id", "hash")), "hash").select("doc_id", "key", "item_id").distinct()


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, key, item_id, n_windows, n_matched, coverage): the documents that hold an item, and which.

    ``key`` is the text's xxhash64, so rows that repeat a doc_id are judged each; equal
    rows give one result. Null texts and texts without words hold nothing; a null doc_id
    is reported as null; items with a null id or without a token are never found. A short
    item counts as one window. Other columns are ignored.
    """
    items = materialize(item_windows(benchmark, window), "benchmark-windows")
    known = _sized(items.select("item_id", "place", "hash", "n_windows").distinct())
    docs = _keyed(docs)
    each = _worded(docs.select("doc_id", "key", tokens(F.col("text")).alias("toks"))).withColumnRenamed("toks", "both")
    each = _with_hashes(each.withColumn("toks", _read(F.col("both"), False)), window).withColumnRenamed("hashes", "words")
    each = _with_hashes(each.withColumn("toks", _read(F.col("both"), True)), window)
    each = each.select("doc_id", "key", F.explode_outer(F.array_union("words", "hashes")).alias("hash"))
    covered = each.join(known, "hash").groupBy("doc_id", "key", "item_id", "n_windows").agg(F.countDistinct("place").alias("n"))
    found = materialize(covered.where(F.col("n") >= coverage * F.col("n_windows")).select("doc_id", "key").distinct(), "template-hits")

    f = _sized(found).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"))
    again = docs.join(f, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left_semi")
    again = _worded(again.dropDuplicates(["doc_id", "key"]).select("doc_id", "key", tokens(F.col("text")).alias("toks")))
    again = _windows(again, window, "doc_id", "key").select("doc_id", "key", F.col("at").alias("_at"), "hash", F.col("slots").alias("own"))
    met = again.join(_sized(items), "hash").select("doc_id", "key", "item_id", "n_windows", "place", (F.col("_at") - F.col("at")).alias("shift"), "slots", "own").distinct()
    met = materialize(met, "template-matches")
    line = ["doc_id", "key", "item_id", "shift"]
    pairs = met.where(F.exists("slots", lambda s: s.isNotNull())).select(*line, F.explode(F.arrays_zip("slots", "own")).alias("s")).where("s.slots is not null")
    broken = pairs.groupBy(*line, "s.slots").agg(F.countDistinct("s.own").alias("values")).where("values > 1").select(*(F.col(c).alias("_" + c) for c in line)).distinct()
    same = F.lit(True)
    for c in line:
        same = same & F.col(c).eqNullSafe(F.col("_" + c))
    whole = met.join(broken, same, "left_anti").groupBy("doc_id", "key", "item_id", "n_windows").agg(F.countDistinct("place").alias("n_matched"))
    whole = whole.where(F.col("n_matched") >= coverage * F.col("n_windows"))
    short = _whole_matches(docs, benchmark, window)
    if short is not None:
        one = F.lit(1).cast("bigint")
        whole = whole.unionByName(short.withColumn("n_windows", one).withColumn("n_matched", one))
    return whole.withColumn("coverage", F.round(F.col("n_matched") / F.col("n_windows"), 6))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    hit = _sized(materialize(leaks(docs, benchmark, window, coverage).select("doc_id", "key").distinct(), "leaks"))
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["doc_id"]) & (F.xxhash64(docs["text"]) == hit["key"]), "left_anti")


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, one row for each item held."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, benchmark).select("doc_id", "item_id", "n_windows", "n_matched", "coverage")
