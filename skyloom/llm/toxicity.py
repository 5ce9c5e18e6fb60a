"""Toxicity: cumulative-link ordinal regression on sparse word features, giving expected severity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.arrow import map_rows
from skyloom.llm.common import col, fresh, others, read_table, shared_table

#: Labelled documents that the model is fitted on at most, those of the smallest hash of their id.
FIT_ROWS = 20_000
#: Words that carry a weight at most.
FEATURES = 2000

_BREAKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def word_set(text: str | None) -> set[bytes]:
    """The distinct lower-cased words of a text, without ASCII punctuation, and their beginnings.

    A beginning is the first 4, 5 or 6 bytes of a longer word and a star: inflected words share it.
    """
    words = set((text or "").lower().encode().translate(_BREAKS).split())
    starts = {w[:n] + b"*" for n in (4, 5, 6) for w in words if len(w) > n}
    return words | starts


@dataclass(frozen=True)
class Severity:
    """``weights`` of words, shared by ascending ``cuts``: P(grade > k) = sigmoid(score - cuts[k])."""

    weights: dict[bytes, float]
    cuts: tuple[float, ...]

    def score(self, words: set[bytes]) -> float:
        return sum(map(self.weights.__getitem__, words & self.weights.keys()))

    def above(self, score: float) -> list[float]:
        from math import exp

        return [1 / (1 + exp(min(max(c - score, -500.0), 500.0))) for c in self.cuts]


def fit(texts: list[set[bytes]], grades: list[int], features: int = FEATURES, ridge: float = 1e-4, lasso: float = 2e-4, steps: int = 500) -> Severity:
    """Cumulative-link model of the grades 0 .. K by proximal gradient ascent of the mean log-likelihood.

    Features are words whose documents differ between grade 0 and above beyond chance: the ``features``
    largest standard scores of the difference of shares, of 4 at least. ``lasso`` drops those of no use.
    A single grade, or no texts, gives a model without weights.
    """
    import numpy as np

    y = np.asarray(grades, np.int64)
    top = int(y.max()) if len(y) else 0
    if top == 0 or (y > 0).all():
        return Severity({}, (float("inf"),) if top == 0 else (float("-inf"),))
    seen: dict[bytes, list[int]] = {}
    for i, words in enumerate(texts):
        for w in words:
            seen.setdefault(w, []).append(i)
    n, pos = len(y), int((y > 0).sum())
    scored = []
    for w, at in seen.items():
        if len(at) < 5:
            continue
        a = int((y[at] > 0).sum())
        p = len(at) / n
        z = (a / pos - (len(at) - a) / (n - pos)) / (p * (1 - p) * (1 / pos + 1 / (n - pos)) + 1e-12) ** 0.5
        if abs(z) >= 4:
            scored.append((-abs(z), w))
    names = [w for _, w in sorted(scored)[:features]]
    rows = np.concatenate([seen[w] for w in names]) if names else np.empty(0, np.int64)
    cols = np.repeat(np.arange(len(names)), [len(seen[w]) for w in names]) if names else np.empty(0, np.int64)
    share = [(y > k).mean() for k in range(top)]
    cuts = np.array([-np.log(s / (1 - s)) if 0 < s < 1 else 0.0 for s in share]) + np.arange(top) * 1e-3
    w = np.zeros(len(names))
    velocity, cut_velocity = np.zeros_like(w), np.zeros_like(cuts)
    rate = 4.0
    for _ in range(steps):
        s = np.bincount(rows, w[cols], n) if len(names) else np.zeros(n)
        up = 1 / (1 + np.exp(np.clip(cuts[None, :] - s[:, None], -40, 40)))  # P(y > k)
        full = np.concatenate([np.ones((n, 1)), up, np.zeros((n, 1))], axis=1)
        hit, nxt = full[np.arange(n), y], full[np.arange(n), y + 1]
        chance = np.maximum(hit - nxt, 1e-12)
        slope_hit, slope_next = hit * (1 - hit), nxt * (1 - nxt)
        by_score = (slope_hit - slope_next) / chance
        grad = np.bincount(cols, by_score[rows], len(names)) / n - ridge * w
        cut_grad = np.array([
            (slope_next[y == k] / chance[y == k]).sum() - (slope_hit[y == k + 1] / chance[y == k + 1]).sum() for k in range(top)
        ]) / n
        velocity = 0.9 * velocity + grad
        cut_velocity = 0.9 * cut_velocity + cut_grad
        w = w + rate * velocity
        w = np.sign(w) * np.maximum(np.abs(w) - rate * lasso * 0.1, 0)
        cuts = np.maximum.accumulate(cuts + rate * cut_velocity + 0.0)
        cuts = cuts + np.arange(top) * 1e-9
    return Severity({name: float(v) for name, v in zip(names, w) if v}, tuple(float(c) for c in cuts))


def label_grades(labels: DataFrame) -> DataFrame:
    """``labels`` with ``grade``: 0 not toxic, 1 toxic, 2 toxic and of poor quality; null where ``toxic`` is.

    The order is the labellers': what they marked for both reasons is worse than what they marked for one.
    """
    poor = F.coalesce((F.col("quality") == 0).cast("int"), F.lit(0))
    return labels.withColumn("grade", F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, 1 + poor))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> tuple[list, list]:
    """Words and grades of at most ``rows`` labelled documents, one for each id, by the hash of the id.

    ``label`` is a grade of 0 or more; of several labels of an id the greatest counts, and of several texts the one of
    the least words in their order. Null ids, labels and texts without a label are left out; empty tables give none.
    The words are counted by label in Spark, and only those whose share differs between the labels by a standard
    score of 4, the ``FEATURES`` of the largest, reach the driver.
    """
    chosen = (
        labels.filter(col(key).isNotNull() & col(label).isNotNull())
        .groupBy(col(key).alias("_key")).agg(F.max(col(label).cast("int")).alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key").limit(rows)
    )
    found = docs.select(col(key).alias("_key"), col(text).alias("_text")).join(F.broadcast(chosen), "_key")

    kind = dict(found.dtypes)["_key"]

    def make():
        def run(keys, texts, marks):
            return {"_key": keys, "_label": marks, "words": [sorted(word_set(t)) for t in texts]}

        return run

    made = map_rows(found.select("_key", "_text", "_label"), make, f"_key {kind}, _label int, words array<binary>")
    sample = shared_table(made.groupBy("_key", "_label").agg(F.min("words").alias("words")), "sample")
    n, pos = (x or 0 for x in sample.agg(F.count(F.lit(1)), F.sum((F.col("_label") > 0).cast("int"))).first())
    wanted: set[bytes] = set()
    if 0 < pos < n:
        seen = sample.select("_label", F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("k"), F.sum((F.col("_label") > 0).cast("int")).alias("a"))
        p = F.col("k") / n
        gap = F.col("a") / pos - (F.col("k") - F.col("a")) / (n - pos)
        z = F.abs(gap) / F.sqrt(p * (1 - p) * (1 / pos + 1 / (n - pos)) + 1e-12)
        top = seen.filter("k >= 5").withColumn("z", z).filter("z >= 4").orderBy(F.desc("z"), "w").limit(FEATURES)
        wanted = {bytes(r["w"]) for r in top.select("w").collect()}

    def pick():
        def run(keys, marks, words):
            return {"_key": keys, "_label": marks, "words": [[w for w in x if w in wanted] for x in words]}

        return run

    kept = map_rows(sample.select("_key", "_label", "words"), pick, f"_key {kind}, _label int, words array<binary>").orderBy("_key").collect()
    return [{bytes(w) for w in r["words"]} for r in kept], [r["_label"] for r in kept]


def score_documents(docs: DataFrame, model: Severity, text: str = "text", limit: float = 0.5) -> DataFrame:
    """``docs`` without ``text``, with expected_severity, grade, p_toxic and toxic.

    ``expected_severity`` is the sum over thresholds of the probability to be above; ``grade`` the number of
    thresholds that are more likely passed than not; ``toxic`` if the first is, by ``limit``. A null or empty
    text has no words and gets the model's base rate; repeated rows are scored each; an empty table gives an empty
    table. The weights are bounded in number. Columns of the names of the four new ones, in any case, are replaced;
    others keep their values whatever they are called.
    """
    kept = others(docs, text, "expected_severity", "grade", "p_toxic", "toxic")
    (body,) = fresh(docs, "body")

    def make():
        def run(*columns: list) -> dict[str, list]:
            up = [model.above(model.score(word_set(t))) for t in columns[-1]]
            return dict(zip(kept, columns)) | {
                "expected_severity": [sum(p) for p in up],
                "grade": [sum(x > limit for x in p) for p in up],
                "p_toxic": [p[0] for p in up],
                "toxic": [p[0] >= limit for p in up],
            }

        return run

    source = docs.select(*map(col, kept), col(text).alias(body))
    zero = F.lit(0.0)
    shape = source.drop(body).withColumns({"expected_severity": zero, "grade": F.lit(0), "p_toxic": zero, "toxic": F.lit(True)})
    return map_rows(source, make, shape.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str, rows: int = FIT_ROWS) -> DataFrame:
    """Expected severity and grade of every document, by a model of at most ``rows`` labelled documents.

    Null and empty texts get the base rate; without labels every document has grade 0.
    """
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    texts, grades = labelled_sample(docs, label_grades(labels), "doc_id", "text", "grade", rows)
    return score_documents(docs.select("doc_id", "text"), fit(texts, grades))
