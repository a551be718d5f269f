"""Quality rules with cutoffs that adapt to each language and source. DataFrame functions only.

Each document gets integer measures. Their distribution per (language, source) is kept as a mergeable quantile sketch: counts by bin, where a
bin keeps the seven leading binary digits of a value, so a quantile is off by less than 1/64 of its value and merging is addition. Documents that
fail the base rule are left out of it. A cutoff lies ``REACH`` spreads from the median; the spread is the distance from the median to the nearer one of the outer
``TAILS`` quantiles, so junk on one side doesn't widen it up to half of a group, and at least one bin of the sketch there: nothing else is fixed. A group's cutoffs
are bounded by those of its language's merged sketch and, for measures that don't depend on the script, of all documents', so a source of mostly junk doesn't
set its own; a group with fewer than ``MIN_GROUP`` documents has the coarser ones alone. Documents are joined with their group's cutoffs and those outside are rejected.

Defined cases: null text has no words (and fails the base rule); null language or source is a group of its own; repeated rows count and are judged one by one; a
value at a cutoff stays; an empty table gives an empty table; other columns pass through untouched, save that one named like a result is replaced by it; a
very long text is measured within its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sluice.llm.scratch import Scratch

WS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
PUNCTUATION = "[!-/:-@\\[-`{-~]"
MIN_GROUP, REACH, TAILS = 100, 10, 10
SALTS = 16  #: parts of a group's rows in the join with its cutoffs
#: Measure: (expression over the base columns, whether too small a value is rejected, too; too large a one always is).
MEASURES: dict[str, tuple[str, bool]] = {
    "symbols": ("1000 * n_symbols div greatest(word_chars, 1)", False),
    "punctuation": ("1000 * n_punctuation div greatest(word_chars, 1)", False),
    "capitals": ("1000 * n_capitals div greatest(word_chars, 1)", False),
    "word_length": ("10 * word_chars div greatest(n_words, 1)", True),
}
BY_SCRIPT = {"punctuation", "capitals", "word_length"}  #: measures that only compare within a language
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_punctuation", "n_capitals"]


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts and one ``m_<measure>`` column each; helper columns start with two underscores."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__t", t)
    df = df.withColumn("__words", F.filter(F.split("__t", WS), lambda w: w != ""))
    df = df.withColumn("__lines", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    df = df.withColumn("__hash", F.transform("__words", lambda w: F.xxhash64(w)))
    df = df.withColumn("__win", F.when(F.size("__hash") >= 8, F.transform(F.sequence(F.lit(1), F.size("__hash") - 7), lambda i: F.xxhash64(F.slice("__hash", i, 8)))))
    df = df.withColumn("__sorted", F.when(F.size(F.array_distinct("__win")) < F.size("__win"), F.array_sort(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = lambda x, k: (x["h"] == F.get("__sorted", k - 1)["h"]) | (x["h"] == F.get("__sorted", k + 1)["h"])
    df = df.withColumn("__again", F.when(F.col("__sorted").isNotNull(), F.array_sort(F.transform(F.filter("__sorted", lambda x, k: F.coalesce(twice(x, k), F.lit(False))), lambda x: x["i"]))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-8).alias("p"))
    covered = F.aggregate("__again", start, lambda a, x: F.struct((a["n"] + F.least(F.lit(8), x - a["p"])).alias("n"), x.alias("p")), lambda a: a["n"])
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.regexp_count("__t", F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("__sorted").isNull(), F.lit(0)).otherwise(covered).cast("long"),
        "n_punctuation": F.regexp_count("__t", F.lit(PUNCTUATION)).cast("long"),
        "n_capitals": F.regexp_count("__t", F.lit("[A-Z]")).cast("long"),
    })
    return df.drop("__t", "__words", "__lines", "__hash", "__win", "__sorted", "__again").withColumns({f"m_{k}": F.expr(e).cast("long") for k, (e, _) in MEASURES.items()})


def failed_base() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def sketch(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """(language, source, measure, bin) -> n: additive, so sketches of parts merge by summing n."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(f"m_{k}").alias("v")) for k in MEASURES]))
    rows = measured.select(F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), each.alias("x")).select("g_lang", "g_source", "x.*")
    cut = F.greatest(F.length(F.bin("v")) - 7, F.lit(0))
    low = F.call_function("shiftleft", F.call_function("shiftright", F.col("v"), cut), cut)
    return rows.groupBy("g_lang", "g_source", "measure", low.alias("bin")).agg(F.count("*").alias("n"))


def _limits(q: Column) -> Column:
    """Cutoffs of a sketch with the quantiles q1, q2 (the median) and q3."""
    bin_ = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(q["q2"])) - 7, F.lit(0)))
    spread = F.greatest(F.least(q["q2"] - q["q1"], q["q3"] - q["q2"]), bin_)
    return F.struct((q["q2"] - REACH * spread).alias("lo"), (q["q2"] + REACH * spread).alias("hi"))


def _level(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Per group ``by`` the documents and a map from measure to cutoffs."""
    bins = sketches.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))
    # One array of (bin, n) per group and measure: its length is bounded by the number of bins, not by the documents.
    held = bins.groupBy(*by, "measure").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total"))
    none = F.lit(None).cast("long")
    parts = {"q1": (TAILS, 1), "q2": (2, 1), "q3": (TAILS, TAILS - 1)}  # the first bin where c / total reaches the second over the first
    start = F.struct(F.lit(0).cast("long").alias("c"), *[none.alias(k) for k in parts])
    sums = F.aggregate("bins", start, lambda a, x: F.struct((a["c"] + x["n"]).alias("c"), *[F.coalesce(a[k], F.when(d * (a["c"] + x["n"]) >= m * F.col("total"), x["bin"])).alias(k) for k, (d, m) in parts.items()]))
    held = held.select(*by, "measure", "total", sums.alias("q"))
    return held.groupBy(*by).agg(F.max("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("measure", _limits(F.col("q")).alias("limits")))).alias("limits"))


def cutoffs(sketches: DataFrame) -> DataFrame:
    """Per (language, source) group one row with the cutoffs of every measure, from the finest levels that have enough documents."""
    fine = _level(sketches, ["g_lang", "g_source"]).select(F.col("g_lang").alias("__lang"), F.col("g_source").alias("__source"), F.col("total").alias("total0"), F.col("limits").alias("limits0"))
    language = _level(sketches, ["g_lang"]).withColumnsRenamed({"total": "total1", "limits": "limits1"})
    joined = fine.join(language, F.col("__lang").eqNullSafe(F.col("g_lang")), "left").withColumn("limits2", _level(sketches, []).select("limits").scalar())
    own = [F.when(F.col(f"total{k}") >= MIN_GROUP, F.col(f"limits{k}")) for k in (0, 1)]
    last = F.when((F.col("total0") < MIN_GROUP) & (F.col("total1") < MIN_GROUP), F.col("limits2"))
    cols = [F.col("__lang"), F.col("__source")]
    for k, (_, down) in MEASURES.items():
        ends = [x[k] for x in (*own, last if k in BY_SCRIPT else F.col("limits2"))]
        cols.append(F.least(*[e["hi"] for e in ends]).alias(f"__hi_{k}"))  # least and greatest pass over levels that are null
        if down:
            cols.append(F.greatest(*[e["lo"] for e in ends]).alias(f"__lo_{k}"))
    return joined.select(*cols)


def judge(df: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The columns ``keep`` (all of them by default) with the base counts, ``base_failed`` and ``kept``.

    The measured rows are written, so that texts are measured once and a filter on ``kept`` meets plain columns: pushed down through
    the measures' nested expressions it would repeat them beyond what the optimiser can handle. The cutoffs are a written table of a few rows a
    group, so Spark knows their size and broadcasts them only if they are small; else a group's rows meet them in ``SALTS`` parts.
    """
    scratch = scratch or Scratch(df.sparkSession, "rules")
    results = [*BASE, "base_failed", "kept"]
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in results]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("__")).alias("__row"), F.col(text).alias("__text"), F.col(lang).alias("__l"), F.col(source).alias("__s"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("__part"))
    measured = scratch.table(with_measures(rows, "__text").drop("__text"), "measured")
    limits = scratch.table(cutoffs(scratch.table(sketch(measured.where(~failed_base()), "__l", "__s"), "sketch")), "cutoffs")
    limits = limits.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    inside = F.lit(True)
    for k, (_, down) in MEASURES.items():
        inside &= F.coalesce(F.col(f"m_{k}") <= F.col(f"__hi_{k}"), F.lit(True))
        if down:
            inside &= F.coalesce(F.col(f"m_{k}") >= F.col(f"__lo_{k}"), F.lit(True))
    same = F.col("__l").eqNullSafe(F.col("__lang")) & F.col("__s").eqNullSafe(F.col("__source")) & (F.col("__part") == F.col("__salt"))
    joined = measured.join(limits, same, "left").withColumn("base_failed", failed_base())
    return joined.select(*[F.col("__row")[c].alias(c) for c in keep], *BASE, "base_failed", (~F.col("base_failed") & inside).alias("kept"))
