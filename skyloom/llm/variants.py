"""Spelling variants: words one edit apart, found by their rarest positional bigrams, and the form that each goes by."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.arrow import map_rows
from skyloom.llm.common import drop_shared, read_table, shared_table

#: Code points of a bigram.
Q = 2
#: One edit spoils Q bigrams at most, so of the Q + 1 rarest of each of two near words one is common to both.
PREFIX = Q + 1
#: Words whose shorter one has as many code points or fewer may share no bigram; they meet by parts alone.
SHORT = PREFIX + Q - 1
#: Bigrams whose frequencies are sent to the tasks; rarer ones come before all of these, in their own order.
SENT_BIGRAMS = 65_536
#: A form has this many times the occurrences of the word it stands for.
RATIO = 10
#: Every word whose crc32 is divisible by this loses a code point in the damaged query.
DAMAGE = 31


def word_counts(docs: DataFrame, least: int = 7, damage: int | None = None) -> DataFrame:
    """``(word, n)``: runs of ASCII and Latin-1 letters of ``least`` code points or more with their occurrences in ``text``.

    Only A-Z are lower-cased. With ``damage``, each run whose crc32 of ``<doc_id>:<run>`` it divides loses the code point
    at that crc32 modulo its length. A null text holds no words, a null doc_id counts as an empty string; repeated
    rows count as often as they come; an empty table gives none. Other columns are not read.
    """
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("ident")
    pattern = F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}")
    runs = docs.select(ident, F.explode(F.regexp_extract_all("text", pattern, F.lit(0))).alias("run"))
    # most runs have no capital, and translate looks up every code point
    small = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(
        F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    )
    words = runs.select("ident", small.alias("word"))
    if damage:
        words = words.withColumn("h", F.crc32(F.concat_ws(":", "ident", "word").cast("binary")))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        words = words.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("word")).alias("word"))
        words = words.filter(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _rarest(words: DataFrame) -> DataFrame:
    """``words`` with ``grams``: the ``PREFIX`` rarest positional bigrams of each, by frequency, bigram and position."""
    places = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(Q)))
    grams = words.filter(F.length("word") >= Q).select(F.explode(places).alias("gram")).groupBy("gram").count()
    most = grams.orderBy(F.desc("count"), "gram").limit(SENT_BIGRAMS).collect()
    sent = words.sparkSession.sparkContext.broadcast({r["gram"]: r["count"] for r in most})

    def make():
        often = sent.value

        def of(word: str):
            found = [word[i : i + Q] for i in range(len(word) - Q + 1)]
            first = sorted((often.get(g, 0), g, i) for i, g in enumerate(found))[:PREFIX]
            return [{"gram": g, "pos": i} for _, g, i in first]

        def run(word, n):
            return {"word": word, "n": n, "grams": [of(w) for w in word]}

        return run

    return map_rows(words.select("word", "n"), make, "word string, n long, grams array<struct<gram:string,pos:int>>", rows=4096)


def _keys(words: DataFrame) -> DataFrame:
    """A row for each key under which a word may meet a near one: ``(key, longer, pos, word, n)``.

    A key is a rare bigram, the length of the shorter word, and two of its three parts: an edit is in one part, and leaves what
    is before that part and behind it whole. A word has keys as the shorter word (or of equal length), and as the longer
    one. Parts and length make the lists of frequent bigrams short, and lose no pair.
    """
    size = F.length("word")
    as_one = F.explode(F.array(F.struct(F.lit(False).alias("longer"), size.alias("m")), F.struct(F.lit(True).alias("longer"), (size - 1).alias("m"))))
    roles = words.select("word", "n", "grams", as_one.alias("role")).select("word", "n", "grams", "role.longer", "role.m")
    none = F.array(F.struct(F.lit("").alias("gram"), F.lit(0).alias("pos")))
    met = F.when(F.col("m") <= SHORT, none).otherwise(F.col("grams"))
    rows = roles.select("word", "n", "longer", "m", F.explode(met).alias("g"))
    first, second = (F.floor(F.col("m") * i / 3).cast("int") for i in (1, 2))

    def kept(side: int, before, behind):
        """The ``before`` first and the ``behind`` last code points, the edit being between them."""
        return F.struct(F.lit(side).alias("side"), F.substr("word", F.lit(1), before).alias("before"), F.substr("word", F.length("word") - behind + 1, behind).alias("behind"))

    zero = F.lit(0)
    parts = F.array(kept(0, second, zero), kept(1, zero, F.col("m") - first), kept(2, first, F.col("m") - second))
    rows = rows.select("word", "n", "longer", "m", "g", F.explode(parts).alias("s"))
    key = F.xxhash64("g.gram", "m", "s.side", "s.before", F.lit("\n"), "s.behind")
    return rows.select(key.alias("key"), "longer", F.col("g.pos").alias("pos"), "word", "n")


def _merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never sent to all tasks: Spark takes keys for as large as the words they come from,
    and tables for as large as their packed files, and either may be far more than the driver holds."""
    return df.hint("merge")


def near_words(words: DataFrame) -> DataFrame:
    """All pairs of distinct words one inserted, deleted or replaced code point apart: ``(a, a_n, b, b_n)``, each once.

    ``words`` has ``word`` and ``n`` and is read twice; a word may come once, and nulls take no part. Bigrams are
    ordered by their frequency, and words joined that share one of their ``PREFIX`` rarest at places that differ by one at
    most; every pair of the join is verified.
    """
    keys = _keys(_rarest(words.filter("word is not null and word <> ''")))
    a = keys.filter("not longer").select("key", *[F.col(c).alias(f"a_{c}") for c in ("pos", "word", "n")])
    b = keys.select("key", *[F.col(c).alias(f"b_{c}") for c in ("longer", "pos", "word", "n")])
    once = F.col("b_longer") | (F.col("a_word") < F.col("b_word"))
    close = F.abs(F.col("a_pos") - F.col("b_pos")) <= 1
    near = F.levenshtein("a_word", "b_word", 1) == 1
    met = a.join(_merged(b), (a["key"] == b["key"]) & once & close & near)
    return met.select(F.col("a_word").alias("a"), "a_n", F.col("b_word").alias("b"), "b_n").distinct()


def _roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` of ``links`` ``(word, form)``: forms are followed to the last, twice as far in each round."""
    roots = shared_table(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        followed = roots.join(_merged(on), F.col("root") == F.col("_at"), "left")
        if not followed.filter("_next is not null").take(1):
            return roots
        further = shared_table(followed.select("word", F.coalesce("_next", "root").alias("root")), "roots")
        drop_shared(roots)
        roots = further


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Each word of ``words`` ``(word, n)`` with its near words, the form it goes by and the root of its forms.

    ``n_near`` counts the words one edit away; ``form`` is the near word of the largest n (the first in code-point order of
    equal ones) if that is ``ratio`` times the word's own n or more, else null; ``root`` follows forms to the last, and is
    the word where it has none. ``ratio`` must exceed 1, so that forms make no circle. Words must be distinct and not
    null, of any length and script. An empty table gives no rows.
    """
    if ratio <= 1:
        raise ValueError("ratio must exceed 1")
    held = shared_table(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_words(held)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )).alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    found = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"), F.first("n").alias("of"))
    stands = -F.col("best.less") >= ratio * F.col("of")
    found = shared_table(found.select(
        "word", "n_near", F.when(stands, F.col("best.near")).alias("form"), F.when(stands, -F.col("best.less")).alias("form_n")
    ), "near")
    roots = _roots(found.filter("form is not null"))
    return (
        held.join(_merged(found), "word", "left").join(_merged(roots), "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 7 code points and 2 occurrences or more of all documents, after damage, with near words, forms and roots."""
    words = word_counts(read_table(spark, sf_dir, "documents"), 7, DAMAGE).filter("n >= 2")
    return spelling_variants(words)
