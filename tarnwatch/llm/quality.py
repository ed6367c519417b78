"""Quality rules whose cutoffs are risk-controlled on labelled documents.

Each rule compares a count with a share of another count. Its cutoffs form a fixed list from lenient
to strict, set before any label is seen. For every stratum (language) and cutoff the hypothesis
"the rule rejects more than ``risk`` of the good documents" is tested with the exact binomial tail,
from lenient to strict until the first failure (fixed sequence), at ``error / (rules * strata)``
(Bonferroni). With probability ``1 - error`` no cutoff that passes breaks its limit anywhere, so any
of them may be chosen: the one that rejects the most bad documents for the fewest good ones. A stratum
with too few labels to prove anything gets no cutoff, and its documents are judged by the base only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.llm.words import SPACE, WORD
from tarnwatch.session import stage

#: Rule: (counted column, weight of the count, compared column, cutoffs from lenient to strict).
#: A document is rejected if weight * count > cutoff * compared.
RULES = {
    "symbols": ("n_symbols", 100, "word_chars", (50, 40, 30, 25, 20, 15, 10, 7, 5, 3, 2, 1)),
    "duplicate_lines": ("n_dup_lines", 100, "n_lines", (90, 80, 70, 60, 50, 45, 40, 35, 30, 25, 20)),
    "repeats": ("n_repeat_words", 100, "n_words", (48, 45, 40, 35, 30, 25, 20, 15, 10)),
    "long_words": ("word_chars", 10, "n_words", (150, 130, 120, 110, 100, 95, 90, 85, 80, 75, 70)),
}
#: Good documents that may be rejected for each bad one, when a cutoff is chosen.
PRICE = 20


def counts(documents: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, lang`` and the counts of its whole text.

    ``n_repeat_words`` counts the words inside 3-word windows that occur twice or more. Windows are
    compared by 64-bit hash within their document. Only documents whose window hashes are not all
    distinct are sorted.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    windows = split.select(
        "doc_id", "lang", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("""CASE WHEN size(words) > 3 THEN transform(sequence(0, size(words) - 3),
               i -> xxhash64(words[i], words[i + 1], words[i + 2])) END""").alias("windows"),
    )
    ranked = windows.withColumn(
        "ranked",
        F.expr("""CASE WHEN size(array_distinct(windows)) < size(windows)
               THEN sort_array(transform(windows, (h, i) -> struct(h, i))) END"""),
    )
    repeated = ranked.withColumn(
        "places",
        F.expr("""sort_array(transform(filter(ranked, (x, k) -> coalesce(get(ranked, k - 1).h = x.h, false)
               OR coalesce(get(ranked, k + 1).h = x.h, false)), x -> x.i))"""),
    )
    covered = F.expr("""coalesce(aggregate(places, struct(0L AS total, -3 AS last),
               (s, p) -> struct(s.total + least(3, p - s.last) AS total, p AS last), s -> s.total), 0L)""")
    return repeated.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words")
    )


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them inside repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rejects(rule: str, cutoff: Column) -> Column:
    count, weight, compared, _ = RULES[rule]
    return weight * F.col(count) > cutoff * F.col(compared)


def binomial_tail(k: str, n: str, rate: float) -> Column:
    """P(X <= k) of X binomial(n, rate), summed exactly; 1 where k is above the mean."""
    return F.expr(f"""CASE WHEN n = 0 OR {k} > {n} * {rate}D THEN 1D ELSE least(1D, aggregate(sequence(0L, {k}),
        struct({n} * ln(1D - {rate}D) AS term, 0D AS total),
        (s, i) -> struct(s.term + ln(({n} - i) / (i + 1D)) + ln({rate}D / (1D - {rate}D)) AS term, s.total + exp(s.term) AS total),
        s -> s.total)) END""")


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = 0.005, error: float = 0.05) -> DataFrame:
    """One row per stratum and rule with a cutoff: ``stratum, rule, cutoff, n_good, false_rejections``.

    ``measured`` is the output of :func:`counts`. Labels with a null ``doc_id`` or ``quality`` are
    left out; of several labels of one document the lower counts.
    """
    judged = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_good"))
    labelled = measured.join(judged, F.col("doc_id") == F.col("_id"))
    sums = [F.count_if(F.col("_good") == 1).alias("n_good")]
    for rule, (_, _, _, cutoffs) in RULES.items():
        for good, name in ((1, "good"), (0, "bad")):
            sums += [F.count_if((F.col("_good") == good) & rejects(rule, F.lit(c))).alias(f"{name}_{rule}_{c}") for c in cutoffs]
    table = labelled.groupBy("lang").agg(*sums)
    tests = F.explode(F.array(*(
        F.struct(F.lit(rule).alias("rule"), F.lit(c).cast("long").alias("cutoff"), F.col(f"good_{rule}_{c}").alias("k"), F.col(f"bad_{rule}_{c}").alias("bad"))
        for rule, (_, _, _, cutoffs) in RULES.items() for c in cutoffs
    )))
    level = F.lit(error) / (len(RULES) * F.col("strata"))
    lenient_first = Window.partitionBy("stratum", "rule").orderBy(F.desc("cutoff"))
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), F.desc("cutoff"))
    return (
        table.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy()))
        .select(F.col("lang").alias("stratum"), "strata", F.col("n_good").alias("n"), tests.alias("test"))
        .select("stratum", "strata", "n", "test.*")
        .withColumn("failed", F.max(binomial_tail("k", "n", risk) > level).over(lenient_first))
        .where(~F.col("failed"))
        .withColumn("gain", F.col("bad") - PRICE * F.col("k"))
        .where("gain > 0")
        .withColumn("place", F.row_number().over(best))
        .where("place = 1")
        .select("stratum", "rule", "cutoff", F.col("n").alias("n_good"), F.col("k").alias("false_rejections"))
    )


def quality(documents: DataFrame, labels: DataFrame, risk: float = 0.005, error: float = 0.05) -> DataFrame:
    """One row per input row: the counts, ``base_failed``, ``rejected_by`` (rules) and ``kept``.

    Defined cases: null or empty text has no words and fails the base; a null language is a stratum
    of its own; rows repeating a ``doc_id`` are judged separately; empty labels leave the base
    alone; an empty table gives an empty result; other columns are not read.
    """
    measured = stage(counts(documents), "quality-counts")
    chosen = thresholds(measured, labels, risk, error).groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")
    )
    judged = measured.join(chosen, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    fired = F.array_compact(F.array(*(
        F.when(rejects(rule, F.try_element_at("cutoffs", F.lit(rule))), F.lit(rule)) for rule in RULES
    )))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), fired.alias("rejected_by"),
    ).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
