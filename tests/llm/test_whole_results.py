"""Whole results of the corpus operators against brute force, and odd tables through all of them."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import chunks, maxscore, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(20000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n ", "en", "s", 4), (4, "the same text", "en", "s", 13), (4, "the same text", "en", "s", 13),
    (5, "the same text", "de", None, 13), (6, LONG, "en", "s", len(LONG)), (6, LONG, "en", "s", len(LONG)), (7, LONG + " end", "en", "s", 1),
    (10, "ünï çödé 中文   😀 İ \x1c x y", "fr", "t", 1), (None, "a row without an id", "en", "t", 1), (None, LONG, "en", "t", 1),
]


# severity


def log_likelihood(words, grades, weights, cuts, ridge):
    total = 0.0
    for x, y in zip(words, grades):
        s = sum(weights.get(w, 0.0) for w in x)
        up = [1.0, *(1 / (1 + math.exp(c - s)) for c in cuts), 0.0]
        total += math.log(up[y] - up[y + 1])
    return total / len(grades) - ridge / 2 * sum(w * w for w in weights.values())


def test_severity_is_fitted_to_the_most_likely():
    """No weight or threshold can be moved to a likelier model; thresholds share the weights."""
    rng = np.random.default_rng(51)
    words, grades = [], []
    for _ in range(900):
        x = {f"w{i}".encode() for i in rng.integers(0, 12, 5)}
        strength = 1.5 * (b"w0" in x) + 2.5 * (b"w1" in x) - 1.2 * (b"w2" in x) + rng.logistic()
        words.append(x)
        grades.append(int(strength > 1.0) + int(strength > 3.0))
    model = toxicity.fit(words, grades, ridge=1e-3)
    assert len(model.cuts) == 2 and model.cuts[0] < model.cuts[1] and model.weights[b"w1"] > model.weights[b"w0"] > 0 > model.weights[b"w2"]
    best = log_likelihood(words, grades, model.weights, model.cuts, 1e-3)
    for step in (0.05, -0.05, 0.3, -0.3):
        for w in model.weights:
            assert log_likelihood(words, grades, model.weights | {w: model.weights[w] + step}, model.cuts, 1e-3) < best + 1e-6
        for k in range(2):
            cuts = list(model.cuts)
            cuts[k] += step
            assert log_likelihood(words, grades, model.weights, cuts, 1e-3) < best + 1e-6
    above = model.above(model.score({b"w1"}))
    assert above == [pytest.approx(1 / (1 + math.exp(c - model.weights[b"w1"]))) for c in model.cuts]


def test_severity_of_string_ids_repeated_rows_and_no_labels(spark):
    rows = [(f"d{i}", "vile word " + "x " * (i % 5) if i % 4 == 0 else "kind word " + "x " * (i % 5)) for i in range(80)]
    docs = spark.createDataFrame(rows + rows[:9] + [(None, "vile"), ("d1", None)], "name string, text string")
    marks = [(f"d{i}", i % 8 // 4, int(i % 4 == 0)) for i in range(80)]
    labels = spark.createDataFrame(marks + marks[:5] + [(None, 1, 1), ("d2", 0, None), ("none", 1, 1)], "name string, quality int, toxic int")
    graded = {r["name"]: r["grade"] for r in toxicity.label_grades(labels).filter("toxic is not null").collect()}
    assert graded["d0"] == 2 and graded["d4"] == 1 and graded["d1"] == 0
    words, grades = toxicity.labelled_sample(docs, toxicity.label_grades(labels), "name", "text", "grade", 1000)
    assert Counter(grades) == {0: 60, 1: 10, 2: 10}
    out = toxicity.score_documents(docs, toxicity.fit(words, grades)).collect()
    assert len(out) == docs.count() and all(r["toxic"] == (int(r["name"][1:]) % 4 == 0) for r in out if r["name"] and r["name"] != "d1")
    none = labels.limit(0)
    words, grades = toxicity.labelled_sample(docs, toxicity.label_grades(none), "name", "text", "grade", 1000)
    assert (words, grades) == ([], [])
    assert {r["grade"] for r in toxicity.score_documents(docs, toxicity.fit(words, grades)).collect()} == {0}


# chunks


def brute_spans(rows, least):
    """The removed spans of each row: runs of chunks that a smaller key holds, and as far as its text goes on with them.

    Chunks are compared themselves, and what is beside a run byte by byte at every place where the owner holds it.
    """
    table = chunks.gear_table()

    def cut(t):
        raw = (t or "").encode()
        ends = chunks.chunk_ends(raw, table)
        marks = chunks.word_marks(np.frombuffer(raw, np.uint8)) if raw else np.zeros(0, bool)
        found = [(a, b, int(marks[a:b].sum()), raw[a:b]) for a, b in zip([0, *ends], ends)]
        return found, [(0, len(raw), least, (raw,))] if raw and marks.sum() < least else [], raw, marks

    owner, texts = {}, {}
    for d, t in rows:
        if d is not None:
            texts.setdefault(d, set()).add((t or "").encode())
            parts, whole, *_ = cut(t)
            for *_, c in parts + whole:
                owner[c] = min(owner.get(c, d), d)

    def beside(d, anchor, rest, step):
        most = -1
        for other in texts[d]:
            for at in range(len(other) - len(anchor) + 1):
                if other[at : at + len(anchor)] == anchor:
                    n, i = 0, at + len(anchor) if step > 0 else at - 1
                    mine = rest if step > 0 else rest[::-1]
                    while n < len(mine) and 0 <= i < len(other) and other[i] == mine[n]:
                        n, i = n + 1, i + step
                    most = max(most, n)
        return most

    out = []
    for d, t in rows:
        parts, whole, raw, marks = cut(t)
        spans = set()
        if d is not None and whole and owner[whole[0][3]] < d:
            spans.add((0, len(raw)))
        run = []
        for c in [*parts, None] if d is not None and not spans else [None]:
            if c is not None and owner[c[3]] < d:
                run.append(c)
                continue
            words = sum(n for _, _, n, _ in run)
            if run and words >= chunks.SEED_WORDS:
                lows = Counter(owner[c_[3]] for c_ in run)
                low = min(lows, key=lambda x: (-lows[x], x))
                own = [(x, y) for x, y, _, c_ in run if owner[c_] == low]
                start, end = run[0][0], run[-1][1]
                (i, j), (k, m) = (own[0], own[-1]) if words >= least else ((start, end), (start, end))
                before = beside(low, raw[i:j], raw[max(0, i - chunks.REACH) : i], -1)
                behind = beside(low, raw[k:m], raw[m : m + chunks.REACH], 1)
                x, y = (min(start, i - before) if before >= 0 else start), (max(end, m + behind) if behind >= 0 else end)
                if (x, y) != (start, end):
                    x, y = chunks.whole_words(raw, x, y)
                    x, y = min(x, start), max(y, end)
                if words >= least or (min(before, behind) >= 0 and marks[x:y].sum() >= least):
                    spans.add((x, y))
            run = []
        joined = []
        for x, y in sorted(spans):
            if joined and x <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(y, joined[-1][1]))
            else:
                joined.append((x, y))
        out.append((str(d), tuple(joined)))
    return sorted(out)


@pytest.mark.parametrize("key", ["long", "string"])
def test_substring_dedup_is_that_of_all_chunks(spark, key):
    rng = np.random.default_rng(53)
    parts = [" ".join(rng.choice([f"v{i}" for i in range(300)], n)) for n in rng.integers(5, 120, 12)]
    rows = [(r[0], r[1]) for r in ODD] + [(100 + i, " ".join(rng.choice(parts, rng.integers(1, 6)))) for i in range(60)]
    rows = [(d if key == "long" or d is None else f"k{d:04d}", t) for d, t in rows]
    docs = spark.createDataFrame(rows, f"doc_id {key}, text string").repartition(4)
    out = chunks.drop_repeats(docs).collect()
    assert sorted((str(r["doc_id"]), tuple((s["start"], s["end"]) for s in r["removed"])) for r in out) == brute_spans(rows, chunks.MIN_WORDS)
    texts = {d: t for d, t in rows}
    for r in out:
        if r["doc_id"] is None or texts[r["doc_id"]] is None:
            continue
        raw, left, at = texts[r["doc_id"]].encode(), b"", 0
        for s in r["removed"]:
            left += raw[at : s["start"]]
            at = s["end"]
        assert (left + raw[at:]).decode() == r["text"]


# search


def test_maxscore_of_repeated_ids_and_empty_tables(spark):
    rng = np.random.default_rng(57)
    v = [(i // 2, [float(x) for x in rng.integers(-9, 9, 6)]) for i in range(60)]
    rows = spark.createDataFrame(v, "id long, v array<double>")
    found = maxscore.search(rows.filter("id % 10 = 0"), rows, 5, shard=16, block=2)
    want = []
    for q, x in v:
        if q % 10 == 0:
            want += [(q, s) for s in sorted((int(np.dot(x, y)) for i, y in v if i != q), reverse=True)[:5]]
    got = Counter((r["query_id"], r["score"]) for r in found.collect())
    best = {}
    for q, s in want:  # the two queries of one id share a list of five
        best.setdefault(q, []).append(s)
    assert got == Counter((q, s) for q, x in best.items() for s in sorted(x, reverse=True)[:5])
    assert maxscore.search(rows.limit(0), rows).count() == 0 and maxscore.search(rows, rows.limit(0)).count() == 0


# the pipeline


@pytest.mark.parametrize("rows", [ODD, [], [(1, None, None, None, None)], [(1, LONG, "en", "s", 1)] * 3])
def test_pipeline_on_odd_rows(spark, tmp_path, rows):
    import corpus_pipeline

    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("_text", "kept", "secrets", "N_WORDS")})
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        assert all(r["_text"] == "_text" and r["N_WORDS"] == "N_WORDS" for r in now.collect())
    left = sorted((r["doc_id"] is None, r["doc_id"], len(r["text"]), r["n_chars"]) for r in now.collect())
    assert left == ([(False, 6, len(LONG), len(LONG))] if rows is ODD else [(False, 1, len(LONG), len(LONG))] if len(rows) == 3 else [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(left)
