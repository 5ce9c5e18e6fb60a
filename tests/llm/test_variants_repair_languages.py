"""Spelling variants, conversation repair and language ID against brute force, SQL and held-out rows."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import chunks, languages, lm, registry, repair, secrets, variants

DATA = "/root/testdata/sf0.01"
LONG = "doc_id long, text string"


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(repr([r[c] for c in cols]) for r in df.collect())


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_conversation_repair"])
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = registry.queries()[name](spark, DATA)
    cur = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    assert rows_of(df) == sorted(repr([r[names.index(c)] for c in cols]) for r in cur.fetchall())


# spelling variants


def apart_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(words, ratio):
    near = {w: [x for x in words if apart_by_one(w, x)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (words[w], len(near[w]), form.get(w), words[form[w]] if w in form else None, root)
    return out


@pytest.mark.parametrize("letters,low,high", [("ab", 1, 6), ("abcd", 3, 7), ("aéñ𝒳", 1, 9), ("abcdefgh", 7, 9)])
def test_variants_of_any_length_and_script(spark, letters, low, high):
    rng = random.Random(len(letters) * 100 + high)
    words = {"".join(rng.choices(letters, k=rng.randint(low, high))): 10 ** rng.randint(0, 5) + rng.randint(0, 3) for _ in range(250)}
    for w in list(words)[:80]:  # near ones that random words would not give
        i = rng.randrange(len(w) + 1)
        words.setdefault(w[:i] + rng.choice(letters) + w[i + rng.randint(0, 1) :], rng.randint(1, 20))
    words.pop("", None)
    got = variants.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long"), 3).collect()
    assert {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got} == variants_by_hand(words, 3)


def test_forms_are_followed_to_the_last(spark):
    word = "abcdefghij"
    chain = [(word[:i] + "z" * (10 - i), 10**i) for i in range(11)]
    got = variants.spelling_variants(spark.createDataFrame(chain, "word string, n long")).collect()
    assert {r["root"] for r in got} == {word}


def test_ties_of_forms_go_by_code_point(spark):
    rows = [("sample", 1), ("samplé", 50), ("samplf", 50), ("sampla", 49)]
    got = {r["word"]: r["form"] for r in variants.spelling_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got["sample"] == "samplf" and got["sampla"] is None


def test_words_are_damaged_and_counted(spark):
    docs = [(1, "Ärger ÄRGERLICH ärgerlich Wordings, wordings\nwordings-WORDINGS ab×cdefgh"), (None, None), (2, ""), (None, "Wordings " * 500), (2, "ſtrange١words")]
    got = {r["word"]: r["n"] for r in variants.word_counts(spark.createDataFrame([(*d, "x") for d in docs], LONG + ", word string"), 7, 3).collect()}
    want = {}
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 3 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] = want.get(run, 0) + 1
    assert got == want and want


def test_no_words_and_a_bad_ratio(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert variants.spelling_variants(none).columns == ["word", "n", "n_near", "form", "form_n", "root"] and not variants.spelling_variants(none).collect()
    with pytest.raises(ValueError):
        variants.spelling_variants(none, 1)


def test_a_very_long_word_has_its_near_one(spark):
    long = "".join(random.Random(5).choices("abcdefghij", k=20_000))
    got = variants.spelling_variants(spark.createDataFrame([(long, 20), (long[:7000] + long[7001:], 2)], "word string, n long")).collect()
    assert sorted((r["n"], r["n_near"], r["form"] == long) for r in got) == [(2, 1, True), (20, 1, False)]


# conversation repair


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        held = out.setdefault(conv, [])
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        held += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def cheapest(rows):
    """Best (cost, audit, lines) of ``rows`` (initial, gone, cut, role, text), by all edits from all states of ``(s?(ua)+)?``."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def more(best):
        for _ in range(3):
            for st, (c, a, lines) in list(best.items()):
                for r in follows[st].replace("s", ""):
                    best[r] = min(best.get(r, (1e9,)), (c + 3, a + "I", [*lines, names[r] + ":"]))
        return best

    best = more({"": (0, "", [])})
    for initial, gone, cut, role, text in rows:
        new = {}
        for st, (c, a, lines) in best.items():
            moves = [(st, c + 4, a + "D", lines)]
            for r in () if gone else follows[st]:
                if r == initial:
                    moves.append((r, c + 3 * cut, a + "K", [*lines, f"{role}:{text}"]))
                if r != "s":
                    moves.append((r, c + 3 + 3 * cut, a + "R", [*lines, f"{names[r]}:{text}"]))
            for to, *v in moves:
                new[to] = min(new.get(to, (1e9,)), tuple(v))
        best = more(new)
    return min(best[st] for st in ("", "a") if st in best)


def repaired_by_hand(rows):
    out = {}
    for conv, got in damage(rows).items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, told, tally = set(), [], [0, 0, 0]
        for turn, role, text in got:
            shown = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                tally[fault] += 1
            told.append((role[:1], fault in (0, 1), fault == 2, role, text))
        turns = [t for t, *_ in got if t is not None]
        illegal = sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in zip(told, told[1:]))
        cost, audit, lines = cheapest(told)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *tally, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(spark, tmp_path, rows, parts=3):
    schema = "conv_id long, turn long, role string, text string, audit string, part int"
    spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(parts).write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op12_conversation_repair(spark, str(tmp_path)).collect()
    cols = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r[c] for c in cols) for r in got}


def test_chart_holds_the_least_cost_and_audit():
    for n in range(5):
        for roles in itertools.product("suax", repeat=n):
            for faults in itertools.product(((False, False), (True, False), (False, True)), repeat=n) if n < 4 else [((False, False),) * n]:
                rows = [(r, *f) for r, f in zip(roles, faults)]
                assert repair.parse(rows)[repair._END] == cheapest([(*r, "", "") for r in rows])[:2], rows


def test_joined_segments_give_what_one_chart_gives():
    rng = random.Random(7)
    for _ in range(300):
        rows = [(rng.choice("suuaaax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(1, 24))]
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(3))})
        cost, path, begun = repair._joined([repair._transfers(rows[a:b]) for a, b in zip(cuts, cuts[1:])])
        assert (cost, begun + "".join(a for a, _ in path)) == repair.parse(rows)[repair._END]


@pytest.mark.parametrize("bound", [1, 3, 1024])
def test_repair_by_hand(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", bound)
    rng = random.Random(bound)
    roles = ["user", "assistant", "system", "user", "assistant", "", "tool", None]
    texts = ["", " \t", None, "ok.", "ok", "Right? ", "no!\n", "half…", "é.", "ok."]
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.choice([1, 2, 5, 9, 30])):
            row = (conv, rng.choice([None, turn, turn, turn, turn + 3]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{turn}{rng.choice('.?x')}")
            rows += [row] * rng.choice([1, 1, 1, 1, 2])
    rows += [(99, None, "user", "Alone."), (99, None, "assistant", "Too.")]
    assert repaired(spark, tmp_path, rows) == repaired_by_hand(rows)


def test_one_conversation_holds_most_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", 64)
    rows = [(1, t, "user" if t % 2 else "assistant", f"Text {t % 700}.") for t in range(3000)] + [(1, 77, "user", "Same.")] * 500
    rows += [(c, t, "user", "Hi.") for c in range(2, 30) for t in range(2)]
    assert repaired(spark, tmp_path, rows, 6) == repaired_by_hand(rows)


def test_no_conversations_and_none_left(spark, tmp_path):
    assert repaired(spark, tmp_path / "none", []) == {}
    gone = [(c, 0, "user", "x.") for c in range(300) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert repaired(spark, tmp_path / "gone", gone) == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in gone}


def test_texts_larger_than_a_segment(spark, tmp_path):
    rows = [(1, t, ["user", "assistant"][t % 2], f"{t} " + "long " * 60_000 + ".") for t in range(8)]
    assert repaired(spark, tmp_path, rows) == repaired_by_hand(rows)


# language ID


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return languages.train(documents.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0), rows=60)


def test_held_out_accuracy(spark, documents):
    got = languages.op13_language_id(spark, DATA).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == documents.count() and {r["lang_pred"] for r in got} <= {"en", "de", "fr", "es", "und"}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.98


def test_machines_separate_within_families(model):
    assert model.family == {"de": "germanic", "en": "germanic", "es": "romance", "fr": "romance"}
    assert sorted(model.planes) == [("de", "en"), ("es", "fr")]


def test_odd_texts_and_clashing_columns(spark, model):
    texts = [None, "", " \n", "12 + 3 = 15 !?", "x", "und die der das ist nicht " * 90_000, "Ω", "the\x00and"]
    docs = spark.createDataFrame([(i, t, "old", "old", i) for i, t in enumerate(texts)], LONG + ", LANG_pred string, Score string, _rest int")
    docs = docs.union(docs)
    got = sorted(languages.identify(docs, model).collect(), key=lambda r: r["doc_id"])
    assert len(got) == 2 * len(texts) and all(r["_rest"] == r["doc_id"] for r in got)
    assert [r["lang_pred"] == "und" for r in got[::2]] == [True, True, True, True, False, False, False, False]
    assert all(r["score"] == 0 for r in got[:8]) and got[::2] == got[1::2]
    assert languages.identify(docs.limit(0), model).count() == 0


def test_nothing_learned_gives_und(spark, documents):
    none = documents.withColumn("lang", F.lit(None).cast("string"))
    assert languages.train(none) is None and languages.train(documents.limit(0)) is None
    assert {r["lang_pred"] for r in languages.identify(documents.limit(20), None).collect()} == {"und"}


def test_one_language_needs_no_machine(spark):
    docs = spark.createDataFrame([(1, "Some words.", "en"), (2, "Other words", "en")], LONG + ", lang string")
    learned = languages.train(docs)
    assert not learned.planes and [(r["lang_pred"], r["score"]) for r in languages.identify(docs, learned).collect()] == [("en", 1.0)] * 2


@pytest.mark.parametrize("piece", [1, 2, 3, 7])
def test_pieces_of_a_text_count_as_the_whole(monkeypatch, piece):
    rng = random.Random(piece)
    for _ in range(60):
        text = "".join(rng.choices("ab É  \n.1ß", k=rng.randint(0, 40)))
        whole = languages.trigram_counts(text)
        monkeypatch.setattr(languages, "PIECE", piece)
        assert (languages.trigram_counts(text) == whole).all(), repr(text)
        monkeypatch.undo()
    flat = " " + " ".join(re.findall("[a-zß-ÿ]+", "Ab ÉA".lower().replace("é", "É").replace("É", "ÿ"))) + " "
    assert languages.trigram_counts("Ab ÿA").sum() == len(flat.encode()) - 2


def test_codes_with_regions_have_their_language_family():
    assert languages.family_of(["pt-BR", "xx", "zh_TW", "EN"]) == {"pt-BR": "romance", "xx": "xx", "zh_TW": "sinitic", "EN": "germanic"}


# language model


def test_no_round_of_exchanges_lowers_the_likelihood():
    rng = np.random.default_rng(8)
    counts = rng.poisson(rng.random((60, 1)) * rng.random((1, 60)) * 30).astype(float)
    gains = []
    of, size = lm.exchange(counts, 9, gains=gains, share=0.0)

    def likelihood(of):
        member = np.eye(size)[of]
        table = member.T @ counts @ member
        f = lambda x: (x * np.log(np.maximum(x, 1.0))).sum()
        return f(table) - f(table.sum(0)) - f(table.sum(1))

    first = np.argsort(-(counts.sum(0) + counts.sum(1))[1:], kind="stable") + 1
    start = np.zeros(60, int)
    start[first] = 1 + np.arange(59) % (size - 1)
    assert min(gains) >= 0 and gains[-1] == 0 and likelihood(of) == pytest.approx(likelihood(start) + sum(gains))


def test_texts_are_split_once_into_numbers(spark):
    known = [b"\n", b"the", b"of"]
    docs = spark.createDataFrame([(1, "The of\x0bcat the CAT dog"), (2, None), (3, ""), (4, "dog dog")], "doc_id long, text string")
    got = {r["doc_id"]: (r["ids"], [bytes(x) for x in r["rare"]]) for r in lm.encode(docs, "text", known).collect()}
    assert got == {1: ([1, 2, -1, 1, -1, -2, 0], [b"cat", b"dog"]), 2: ([0], []), 3: ([0], []), 4: ([-1, -1, 0], [b"dog"])}


# substring dedup


@pytest.fixture(scope="module")
def planted(spark):
    """Pairs of documents that share a passage of 25 to 200 words and nothing else: rows, and what the second should lose."""
    rng = random.Random(3)
    texts = [r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").filter("lang = 'en'").select("text").collect()]
    vocabulary = [w for t in texts for w in t.split()]

    def some(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    rows, passages = [], {}
    for size in (25, 30, 40, 50, 100, 200):
        for _ in range(40):
            passage = some(size)
            for second in (False, True):
                before, behind = some(rng.randint(20, 200)), some(rng.randint(20, 200))
                if second:
                    start = len(before.encode()) + 1
                    passages[len(rows)] = (size, start, start + len(passage.encode()))
                rows.append((len(rows), f"{before} {passage} {behind}"))
    return rows, passages


def test_passages_are_found_to_their_edges(spark, planted):
    rows, passages = planted
    got = {r["doc_id"]: [(x["start"], x["end"]) for x in r["removed"]] for r in chunks.drop_repeats(spark.createDataFrame(rows, LONG)).collect()}
    lost, whole = {}, {}
    for doc, (size, start, end) in passages.items():
        inside = sum(max(0, min(b, end) - max(a, start)) for a, b in got[doc])
        lost[size], whole[size] = lost.get(size, 0) + inside, whole.get(size, 0) + end - start
        assert sum(b - a for a, b in got[doc]) - inside <= 64
    assert not [d for d in got if d not in passages and got[d]]
    recall = {size: lost[size] / whole[size] for size in lost}
    assert recall[25] >= 0.85 and all(r >= 0.95 for size, r in recall.items() if size >= 30), recall


def test_growth_stops_at_words_and_characters():
    assert chunks.grown(b"xx abc def ghi yy", b"-- abc def", 6, b"def ghi zz", 3) == (4, 5)
    assert chunks.grown(b"xx abc", b"-- nope", 3, b"abc", 3) == (-1, 0)
    assert chunks.grown(b"ab ab ab", b"x ab ab", 5, b"ab ab", 2) == (4, 3)
    raw = "één twee drieën".encode()
    assert chunks.whole_words(raw, 1, 16) == (6, 11) and chunks.whole_words(raw, 6, 10) == (6, 10)
    assert chunks.whole_words("字字字字".encode() * 9, 1, 50) == (3, 48)


def test_repeats_of_one_key_and_texts_of_several_owners(spark):
    rng = random.Random(9)
    some = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = some(30)
    rows = [(1, f"{some(50)} {passage} {some(40)}"), (1, some(80)), (1, some(60)), (2, f"{some(30)} {passage} {some(30)}"), (2, f"{some(30)} {passage} {some(30)}"), (None, passage)]
    rows.append(rows[3])
    got = chunks.drop_repeats(spark.createDataFrame(rows, LONG)).collect()
    assert len(got) == 7
    for r in got:
        assert (passage in r["text"]) == (r["doc_id"] != 2 and passage in next(t for d, t in rows if d == r["doc_id"] and (r["text"] in t or d == 2)))
        assert bool(r["removed"]) == (r["doc_id"] == 2)


# secrets


def test_checksummed_kinds_agree_with_sql(spark, tmp_path):
    rng = random.Random(6)
    letters = secrets.BASE62

    def token(prefix, right=True):
        body = "".join(rng.choices(letters, k=30))
        value, digits = zlib.crc32(body.encode()), ""
        for _ in range(6):
            value, d = divmod(value, 62)
            digits = letters[d] + digits
        return prefix + body + (digits if right else digits[::-1] + "")

    texts = [f"a {token('ghp_')} b", f"{token('npm_')},{token('ghs_')}", token("gho_") + "x", token("ghx_"), f"token = {token('ghp_')}", None, "", token("npm_", False)]
    texts += [f"é😀 {token('ghu_')}\n{token('ghr_')} AKIA{'B' * 16} 0123456789abcdef"]
    spark.createDataFrame(list(enumerate(texts)), LONG).write.parquet(f"{tmp_path}/documents.parquet")
    got = secrets.op3_secret_scan(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(registry.oracle_sql()["op3_secret_scan"])
    names, cols = [c[0] for c in cur.description], sorted(got.columns)
    want = sorted(repr([r[names.index(c)] for c in cols]) for r in cur.fetchall())
    assert rows_of(got) == want and sum("code_host" in w or "packages" in w for w in want) == 4


def test_no_side_of_a_join_of_variants_is_sent_to_all_tasks(spark):
    words = spark.createDataFrame([("separate", 50), ("seperate", 2), ("seprate", 1)], "word string, n long")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    made = variants.spelling_variants(words)
    for df in (variants.near_words(words), made):
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)
    assert {r["word"]: r["root"] for r in made.collect()} == {"separate": "separate", "seperate": "separate", "seprate": "separate"}
