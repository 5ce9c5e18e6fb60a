"""Quality rules: document rules, failure rates by host shrunk by an empirical beta prior, host verdicts.

Everything is a DataFrame expression; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import WORD_GAP, col, fresh, others, packed, read_table, shared_table, unpacked

SYMBOL = r"[#*$%&|<>]"


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules.

    ``trusted_rate``: the shrunk failure rate below which a host's failures of a rule are forgiven.
    ``ban_rate``: the rate of short or repetitive documents from which a host is banned: what comes near to failing
    one of the two rules, by ``near``, goes, too. Clean documents stay whatever their host is.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_per_word: float = 0.3
    max_dup_line_share: float = 0.5
    trusted_rate: float = 0.02
    ban_rate: float = 0.95
    near: float = 2.0


#: The rules that count as failures of a host.
RULES = ("short", "repeats", "symbols", "lines")


def _indices(n: Column) -> Column:
    """0 .. n-1, empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def text_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long), or with those replaced.

    A null text has no words and counts 0 everywhere. A word counts in ``n_repeat_words`` if it lies in
    a three-word window found twice or more in the text. Windows are told apart by a 64-bit hash: the
    hashes are sorted within the row, equal neighbours are the repeats, and the union of the windows
    that start at their positions is measured from the gaps between them.
    """
    words, lines, hashes, placed_, starts_ = fresh(docs, "words", "lines", "hashes", "placed", "starts")
    body = F.coalesce(col(text), F.lit(""))
    split = docs.withColumn(words, F.array_remove(F.split(body, WORD_GAP), "")).withColumn(
        lines, F.filter(F.split(body, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    )
    n = F.size(words)
    grams = split.withColumn(
        hashes,
        F.transform(_indices(n - 2), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    )
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    placed = grams.withColumn(
        placed_,
        F.when(repeats, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )

    def twice(x: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get(placed_, k - 1)["h"])
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(F.get(placed_, k + 1)["h"] == x["h"], F.lit(False))

    starts = placed.withColumn(starts_, F.sort_array(F.transform(F.filter(placed_, twice), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform(starts_, lambda p, k: F.least(F.coalesce(F.get(starts_, k + 1) - p, F.lit(3)), F.lit(3))),
        F.lit(0),
        lambda total, x: total + x,
    )
    return starts.select(
        *map(col, others(docs, *_MEASURES)),
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def rule_failures(rules: QualityRules) -> dict[str, Column]:
    """Whether a measured document fails each rule."""
    return {
        "short": F.col("n_words") < rules.min_words,
        "repeats": 100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"),
        "symbols": F.col("n_symbols") > rules.max_symbols_per_word * F.col("n_words"),
        "lines": F.col("n_dup_lines") > rules.max_dup_line_share * F.col("n_lines"),
    }


def beta_prior(total_n: float, mean: float, between: float, within: float) -> tuple[float, float]:
    """Method of moments: a, b of the beta prior with the hosts' mean rate and their extra variance.

    ``between`` is the variance of the observed host rates, ``within`` the part of it that binomial
    noise explains. No extra variance, or a mean of 0 or 1, gives a prior of ``total_n`` documents,
    which pulls every host to the mean.
    """
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    extra = between - within
    strength = max(mean * (1 - mean) / extra - 1, 1e-3) if extra > 1e-12 else max(total_n, 1.0)
    strength = min(strength, max(total_n, 1.0))
    return mean * strength, (1 - mean) * strength


def host_verdicts(measured: DataFrame, host: str, rules: QualityRules) -> DataFrame:
    """One row a host: documents, failures, shrunk failure rate and trust of each rule, and ``banned``.

    Hosts are aggregated with partial sums, so a host with a third of all rows costs no more than
    another. The prior of each rule comes from one row of moments over the hosts.
    """
    sums = [F.sum(F.col(f"fails_{r}").cast("long")).alias(f"n_{r}") for r in RULES]
    hosts = shared_table(
        measured.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("n"), *sums), "hosts"
    )
    moments = []
    for r in RULES:
        rate, p = F.col(f"n_{r}") / F.col("n"), F.sum(f"n_{r}") / F.sum("n")
        moments += [
            p.alias(f"mean_{r}"),
            F.avg(rate).alias(f"avg_{r}"),
            F.var_pop(rate).alias(f"between_{r}"),
            F.avg(1 / F.col("n")).alias(f"inverse_{r}"),
        ]
    m = hosts.agg(F.sum("n").alias("total"), *moments).first()
    shrunk = {}
    for r in RULES:
        mean = m[f"mean_{r}"] or 0.0
        within = mean * (1 - mean) * (m[f"inverse_{r}"] or 0.0)
        a, b = beta_prior(float(m["total"] or 0), mean, m[f"between_{r}"] or 0.0, within)
        shrunk[f"rate_{r}"] = (F.col(f"n_{r}") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    rated = hosts.withColumns(shrunk)
    trusted = {f"trusts_{r}": F.col(f"rate_{r}") < rules.trusted_rate for r in RULES}
    return rated.withColumns({**trusted, "banned": F.greatest("rate_short", "rate_repeats") >= rules.ban_rate})


def quality_verdicts(
    docs: DataFrame, text: str = "text", host: str = "source", rules: QualityRules = QualityRules()
) -> DataFrame:
    """One row a document: ``docs`` without its text, with measures, rule failures, host rates and ``kept``.

    ``base_failed``: too short or mostly repeats. A document goes if it is ``base_failed``, if it fails another rule that
    its host is not trusted in, or if its host is banned and it comes near to failing; a document that is clear of all
    rules always stays. A null or empty text is too short. Null hosts are one host. Repeated rows are rows of their own;
    an empty table gives an empty table. Columns of ``docs`` of the names of new columns, in any case, are replaced by
    them; others keep their values whatever they are called.
    """
    kept = others(docs, text, *_NEW)
    judged = _judged(docs.select(packed(kept).alias("row"), col(host).alias("host"), col(text).alias("body")), rules, False)
    new = [c for c in judged.columns if c not in ("row", "host")]
    return judged.select(*unpacked("row", kept), *new)


def _judged(rows: DataFrame, rules: QualityRules, whole: bool) -> DataFrame:
    """``rows`` (row, host, body) with the columns of ``quality_verdicts``; the body stays with ``whole``."""
    fails = {f"fails_{r}": c for r, c in rule_failures(rules).items()}
    measured = text_measures(rows, "body").withColumns(fails)
    measured = shared_table(measured if whole else measured.drop("body"), "measures")
    hosts = host_verdicts(measured, "host", rules).select(
        "_host", "banned", *[f"trusts_{r}" for r in RULES], *[F.col(f"rate_{r}").alias(f"host_{r}") for r in RULES]
    )
    joined = measured.join(hosts, measured["host"].eqNullSafe(hosts["_host"]), "left").drop("_host")
    base = F.col("fails_short") | F.col("fails_repeats")
    near = (F.col("n_words") < rules.near * rules.min_words) | (
        rules.near * 100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    goes = base | (F.col("banned") & near)
    for r in RULES:
        goes = goes | (F.col(f"fails_{r}") & ~F.col(f"trusts_{r}"))
    return joined.withColumns({"base_failed": base, "kept": ~goes})


_NEW = {
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "banned",
    "base_failed", "kept", *(f"{x}_{r}" for r in RULES for x in ("fails", "trusts", "host")),
}


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that the verdicts of ``quality_verdicts`` keep, all columns unchanged whatever they are called.

    Rows are measured once and wait for the hosts' verdicts in the shared folder, so no text is shuffled unless there are
    too many hosts to be sent to every task. Repeated rows that are kept stay as often as they came.
    """
    rest = others(docs, text)
    judged = _judged(docs.select(packed(rest).alias("row"), col(host).alias("host"), col(text).alias("body")), rules, True)
    back = judged.filter("kept").select(*unpacked("row", rest), F.col("body").alias(text))
    return back.select(*map(col, docs.columns))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, rule failures, host rates and verdicts of every document.

    Null and empty texts have no words and fail as short; repeated rows are judged each.
    """
    verdicts = quality_verdicts(read_table(spark, sf_dir, "documents"))
    return verdicts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "source", *(f"fails_{r}" for r in RULES), *(F.round(f"host_{r}", 9).alias(f"host_{r}") for r in RULES),
    )
