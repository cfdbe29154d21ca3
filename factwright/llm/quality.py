"""Quality rules with cutoffs that hold a promise about good text.

Each rule rejects texts whose rate of something lies above a cutoff. Labelled texts are the holdout: for every stratum (language)
and rule, cutoffs are tried from the most lenient on, as long as the exact binomial test rejects that the rule loses more than
``risk`` of good texts: P(Binomial(n, risk) <= lost) <= error / tests. Trying cutoffs in this fixed order costs nothing; the
tests of all strata and rules share ``error`` (Bonferroni). With probability 1 - error, no rule in any stratum rejects more
than ``risk`` of good texts. Of the cutoffs so allowed, the one is taken that rejects most bad texts, a good one
counting ``LOSS`` times; a stratum with too few labels gets no cutoff and loses nothing.

The lower tail is summed from its largest term down; beyond TERMS terms the rest is bounded by a geometric series,
so that the test errs to the safe side. Only DataFrame functions are used.

Defined cases: a null, empty or wordless text has no words and fails the base rule of 50 words; null languages are a stratum of
their own; labels of unknown documents or without a quality do not count; of several labels of a document each counts; repeated
rows get equal results."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from factwright.llm.common import WORD
from factwright.session import cut

STEPS = 200  # cutoffs are multiples of 1 / STEPS
RISK, ERROR, LOSS = 0.01, 0.05, 5.0
TERMS = 1000

#: Name of each rule, and its rate's numerator and denominator.
RULES = {
    "symbols": ("n_symbols", "word_chars"), "capitals": ("n_capitals", "word_chars"), "exclamations": ("n_exclamations", "word_chars"),
    "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"),
}


def measures(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, lang, text): doc_id, lang and the counts that the rules use.

    Words in a three-word window that occurs twice: windows are hashed to 64 bits; where all differ, as in most texts, there are none.
    Else windows are sorted with their positions, neighbours of equal hash are marked, and the words that the
    marked positions cover are counted."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", "lang", text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    window = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    d = d.select(
        "doc_id", "lang", F.size("w").cast("long").alias("n_words"), F.array_join("w", "").alias("joined"), lines.alias("lines"),
        F.when(F.size("w") > 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), window)).alias("windows"))
    of = lambda c: F.length(F.regexp_replace("joined", f"[^{c}]+", "")).cast("long")
    d = d.select(
        "doc_id", "lang", "n_words", F.length("joined").cast("long").alias("word_chars"), of(r"#*$%&|<>").alias("n_symbols"),
        of("A-Z").alias("n_capitals"), of("!").alias("n_exclamations"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.col("windows")).alias("windows"))
    placed = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    d = d.withColumn("windows", F.array_sort(placed))
    h = lambda i: F.get("windows", i)["h"]
    twice = lambda x, i: F.when((x["h"] == h(i + 1)) | ((i > 0) & (x["h"] == h(F.greatest(i - 1, F.lit(0))))), x["i"])
    d = d.withColumn("windows", F.sort_array(F.filter(F.transform("windows", twice), lambda x: x.isNotNull())))
    covered = F.aggregate(
        "windows", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("end")),
        lambda s, i: F.struct((s["n"] + i + 3 - F.greatest(i, s["end"])).cast("long").alias("n"), (i + 3).alias("end")), lambda s: s["n"])
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("windows")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _step(rule: str) -> Column:
    """The rate in steps, rounded up: above cutoff j where it is larger than j."""
    over, under = RULES[rule]
    return F.coalesce(F.least(F.ceil(F.col(over) * STEPS / F.when(F.col(under) > 0, F.col(under))), F.lit(STEPS)), F.lit(0)).cast("int")


def log_gamma(x: Column) -> Column:
    """By Stirling's series at x + 7; x is at least 1."""
    y = x + 7
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - sum((F.log(x + i) for i in range(1, 7)), F.log(x))


def lower_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), from above where more than TERMS terms would be needed; 1 where k is at or over the mean."""
    k, n = k.cast("double"), n.cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    ratio = lambda i: i * (1 - p) / ((n - i + 1) * p)  # noqa: E731  of the term of i - 1 to that of i
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s, i):
        term = s["term"] * ratio(k - i + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1), F.least(k, F.lit(TERMS)).cast("int"))).otherwise(F.array().cast("array<int>"))
    last = F.greatest(ratio(F.greatest(k - TERMS, F.lit(0.0))), F.lit(0.0))
    total = F.aggregate(steps, zero, add, lambda s: s["sum"] + s["term"] * last / (1 - last))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.exp(top) * total, F.lit(1.0)))


def cutoffs(found: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Per stratum (stratum, rule, cutoff) of measured documents, for those that have one. A cutoff is in steps."""
    rates = F.array(*[F.struct(F.lit(r).alias("rule"), _step(r).alias("step")) for r in RULES])
    judged = found.join(labels.where("quality is not null").select("doc_id", "quality"), "doc_id")
    rows = judged.select(F.coalesce("lang", F.lit("")).alias("stratum"), "quality", F.inline(rates))
    hist = rows.groupBy("stratum", "rule", "step").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    grid = hist.select("stratum", "rule").distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(STEPS))))
    tests = hist.agg(F.greatest(F.count_distinct("stratum", "rule"), F.lit(1))).first()[0]
    one = Window.partitionBy("stratum", "rule")
    above = one.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    tried = grid.join(hist, ["stratum", "rule", "step"], "left").na.fill(0, ["good", "bad"]).select(
        "stratum", "rule", "step", F.sum("good").over(one).alias("n"), F.sum("bad").over(one).alias("n_bad"),
        F.coalesce(F.sum("good").over(above), F.lit(0)).alias("lost"), F.coalesce(F.sum("bad").over(above), F.lit(0)).alias("caught"))
    allowed = tried.where(lower_tail(F.col("lost"), F.col("n"), risk) <= error / tests)
    worth = F.col("caught") / F.greatest("n_bad", F.lit(1)) - LOSS * F.col("lost") / F.col("n")
    # what is lost and caught only grows along the order, so that the allowed are the begin of it
    return allowed.groupBy("stratum", "rule").agg(F.max(F.struct(worth.alias("worth"), "step"))["step"].alias("cutoff"))


def judge(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds base_failed, failed (the rules above their cutoffs) and kept to measured documents."""
    wide = chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    joined = found.join(wide, F.coalesce("lang", F.lit("")) == F.col("stratum"), "left")
    failed = F.array_compact(F.array(*[F.when(_step(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]))
    out = joined.withColumn("base_failed", base_failed()).withColumn("failed", failed).drop("stratum", *[f"cut_{r}" for r in RULES])
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Measures and verdict of every document (doc_id, lang, text)."""
    found = cut(measures(docs))
    return judge(found, cutoffs(found, labels))
