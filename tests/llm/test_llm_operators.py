"""Each corpus operator against a brute-force version and on odd input."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from skyloom.llm import bpe, chunks, common, lm, maxscore, packing, quality, secrets, simhash, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(20000))
PASSAGE = " ".join(f"pass{i * 7919 % 1009}" for i in range(60))
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \t\n ", "en", "s", 4),
    (4, "the same text", "en", "s", 13),
    (4, "the same text", "en", "s", 13),
    (5, "the same text", "de", None, 13),
    (6, LONG, "en", "s", len(LONG)),
    (7, LONG, "en", "s", len(LONG)),
    (8, "start here " + PASSAGE + " and it ends", "en", "s", 1),
    (9, "another beginning " + PASSAGE + " with another end", "en", "s", 1),
    (10, "ünï çödé 中文   😀 İ \x1c x y", "fr", "t", 1),
    (None, "a row without an id", "en", "t", 1),
    (11, "password=abcdefghijkl AKIA" + "B" * 14 + " " + "0123456789abcdef" * 2, "en", "t", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


# quality


def brute_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {i + d for i in range(len(w) - 2) for d in range(3) if grams[w[i], w[i + 1], w[i + 2]] > 1}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(spark, odd):
    extra = [(20, "a b c a b c a b\nx\n x\nx\n\n## |", "en", "s", 1), (21, "a a a a", "en", "s", 1), (22, "a b a b", "en", "s", 1)]
    df = odd.union(spark.createDataFrame(extra, SCHEMA))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in quality.quality_verdicts(df).collect())
    assert got == sorted((str(d), *brute_measures(t)) for d, t, *_ in ODD + extra)


def test_quality_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), "x y " * 60
    rows = [(i, good if i % 40 else bad, "en", f"h{i % 3}", 1) for i in range(120)] + [(500 + i, "short", "en", "spam", 1) for i in range(400)] + [(999, good, "en", "spam", 1), (998, good + " " + " ".join(f"v{i}" for i in range(80)), "en", "spam", 1)]
    out = {r["doc_id"]: r for r in quality.quality_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(out[i]["kept"] == bool(i % 40) for i in range(120))
    assert out[999]["banned"] and not out[999]["kept"] and not out[999]["base_failed"]  # 80 words are near to 50
    assert out[998]["banned"] and out[998]["kept"]  # clear of all rules
    assert out[999]["host_short"] == pytest.approx(400 / 402, abs=0.02)


def test_quality_keeps_repeated_rows(spark, none):
    good = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, good, "en", "s", 1), (1, good, "en", "s", 1), (2, "short", "en", "s", 1)], SCHEMA)
    assert [r["doc_id"] for r in quality.keep_good(docs).collect()] == [1, 1]
    assert quality.keep_good(none).count() == 0


# BPE


def test_bpe_against_tiktoken(spark, odd, none):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((str(r["doc_id"]), list(memoryview(bytes(r["ids"])).cast("I")) if r["ids"] else [], bytes(r["decoded"])) for r in bpe.encode_documents(odd, ranks, P.PATTERN, decoded=True).collect())
    assert got == sorted((str(d), known.encode_ordinary(t or ""), (t or "").encode()) for d, t, *_ in ODD)
    assert bpe.encode_documents(none, ranks, P.PATTERN).count() == 0
    coder, rng = bpe.TextEncoder(ranks, P.PATTERN), np.random.default_rng(0)
    parts = ["a", "aa", " ", "  ", "\n", "'ll", "é", "中", "12", "!", "the", "\x1c", " ", "aaaaaaaaaaaaaaa"]
    for n in [0, 1, 3, 10, 200] * 40 + [4000]:
        text = "".join(rng.choice(parts, n))
        ids = coder.encode(text)
        assert (list(memoryview(ids).cast("I")) if ids else []) == known.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_bpe_tree_joins_equal_plain_merging():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"ca": 259, b"aa": 260, b"aaaa": 261, b"cab": 262}
    tree, rng = bpe.TreeEncoder(ranks), np.random.default_rng(1)
    for _ in range(500):
        piece = bytes(rng.choice(list(b"abc"), rng.integers(1, 80)))
        assert tree._halves(piece) == bpe.merge(piece, ranks)


# secrets


def brute_secrets(text):
    text, found = text or "", []
    assign = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    for name, pattern, size in (("assign", assign, lambda m: len(m[2]) >= 12), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16)):
        found += [(m.start(), ("assign", "access", "hex").index(name), name, m.end()) for m in re.finditer(pattern, text) if size(m)]
    return [f"{n}:{a}:{b}" for a, _, n, b in sorted(found)]


def test_secrets(spark, odd, none):
    rng = np.random.default_rng(2)
    parts = ["password", "PASSWD", "token", "tokentoken", "api_key", "ApiKey", "secret", "=", ":", " ", '"', "AKIA", "AKIAAKIA", "ABC123", "deadbeef", "0123", "abcdefgh", "ſecret", "\n", "é"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 40))) for _ in range(400)]
    docs = odd.union(spark.createDataFrame([(100 + i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA))
    got = Counter((r["doc_id"], tuple(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["secrets"])) for r in secrets.scan_secrets(docs).collect())
    assert got == Counter((d, tuple(brute_secrets(t))) for d, t, *_ in ODD + [(100 + i, t) for i, t in enumerate(texts)])
    assert secrets.scan_secrets(none).count() == 0


def test_checksum_and_mask(spark):
    body = "zQ" * 15
    digits, value = "", zlib.crc32(body.encode())
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = secrets.BASE62[d] + digits
    good, wrong = f"ghp_{body}{digits}", f"ghp_{body}000000"
    docs = spark.createDataFrame([(1, f"x {good} y", "en", "s", 1), (2, f"x {wrong} y", "en", "s", 1), (3, None, "en", "s", 1)], SCHEMA)
    assert [r["text"] for r in secrets.mask_secrets(docs).orderBy("doc_id").collect()] == ["x [secret] y", f"x {wrong} y", None]


# toxicity


def test_toxicity_orders_and_finds(spark, none):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        text = [str(x) for x in rng.choice(vocabulary, 40)] + (["vilething", "awfulperson"][: 1 + i % 2] if toxic else [])
        rows.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    texts, toxic = toxicity.labelled_sample(docs, marks, "doc_id", "text", "toxic", 500)
    model = toxicity.fit(texts, toxic)
    assert list(model.cuts) == sorted(model.cuts)
    out = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    assert sum(out[i]["toxic"] == (i % 6 == 0) for i in range(600)) >= 595
    odd = toxicity.score_documents(spark.createDataFrame(ODD, SCHEMA), model)
    assert odd.count() == len(ODD) and not odd.filter("toxic").count()
    assert toxicity.score_documents(none, model).count() == 0
    one_class = toxicity.fit([{b"a"}, {b"b"}], [0, 0])
    assert one_class.above(one_class.score({b"a"})) == [pytest.approx(0.0)]


# chunks


def test_chunks_resist_shifts():
    table, raw = chunks.gear_table(), LONG.encode()
    cut = lambda r: {r[a:b] for a, b in zip([0, *chunks.chunk_ends(r, table)], chunks.chunk_ends(r, table))}
    moved = cut(b"something new " + raw)
    assert b"".join(raw[a:b] for a, b in zip([0, *chunks.chunk_ends(raw, table)], chunks.chunk_ends(raw, table))) == raw
    assert len(cut(raw) - moved) <= 3


def test_gear_hash_is_the_rolling_one():
    table, raw = chunks.gear_table(), LONG[:500].encode()
    h, want = 0, []
    for b in raw:
        h = (h << 1) + int(table[b]) & 0xFFFFFFFF
        want.append(h)
    assert chunks.gear_hashes(np.frombuffer(raw, np.uint8), table).tolist() == want


def test_repeated_passages_go(odd, none, spark):
    got = {}
    for r in chunks.drop_repeats(odd).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[6][0]["text"] == LONG and got[7][0]["text"] == ""
    assert got[8][0]["text"].count("pass") == 60 and got[9][0]["text"].count("pass") <= 20
    assert got[9][0]["text"].startswith("another beginning ")
    assert got[1][0]["text"] is None and got[2][0]["text"] == "" and len(got[4]) == 2 and got[None][0]["text"] == "a row without an id"
    assert chunks.drop_repeats(none).count() == 0


@pytest.mark.parametrize("letters, size", [("".join(map(chr, range(0x4E00, 0x5200))), 300), ("กขคงจฉชซญดตถทธนบปพมยรลวสหอ", 400), ("abcdefghijklmnopqrstuvwxyz0123456789+/", 800)])
@pytest.mark.parametrize("space", ["", "\u00a0", "\u3000"])
def test_passages_without_ascii_space_go(spark, letters, size, space):
    rng = np.random.default_rng(16)

    def made(n):
        return space.join("".join(rng.choice(list(letters), 4)) for _ in range(n // 4))

    passage, heads, ends = made(size), [made(90), made(131)], [made(70), made(50)]
    texts = [h + passage + e for h, e in zip(heads, ends)]
    rows = [(1, texts[0], "en", "s", 1), (2, texts[1], "en", "s", 1), (3, texts[0], "de", "s", 1)]
    got = {r["doc_id"]: r["text"] for r in chunks.drop_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == texts[0] and got[3] == ""
    assert got[2].startswith(heads[1]) and got[2].endswith(ends[1])
    assert len(texts[1]) - len(got[2]) > len(passage) / 2


def test_copies_of_short_texts_go(spark):
    short = ["only a few words in this one text", "x", "   spaced    out   " + " " * 900 + "far", "中文"]
    rows = [(10 * c + i, t, "en", "s", 1) for c in (1, 2) for i, t in enumerate(short)]
    rows += [(30, "only a few words in this one text and more", "en", "s", 1), (None, "x", "en", "s", 1)]
    got = {r["doc_id"]: r["text"] for r in chunks.drop_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {10 + i: t for i, t in enumerate(short)} | {20 + i: "" for i in range(4)} | {30: rows[8][1], None: "x"}


# language model


@pytest.mark.parametrize("own_units, sent_words, events", [(32, 50, 8_000_000), (4, 12, 40), (2000, 100_000, 8_000_000)])
def test_lm_scores_are_those_of_its_classes(spark, odd, none, own_units, sent_words, events, monkeypatch):
    """Counts, transitions, emissions and scores by brute force from the class that each word was given."""
    monkeypatch.setattr(lm, "EVENTS", events)
    rng = np.random.default_rng(41)
    zipf = [f"{'abcd'[i % 4]}{i}" for i in np.minimum(rng.zipf(1.4, 4000), 900)]
    rows = ODD + [(50 + i, " ".join(zipf[i * 50 : i * 50 + 50]), "en", "s", 1) for i in range(80)] + [(7, LONG, "en", "s", 1)]
    rows = [r for r in rows if r[0] != 6 or own_units > 100]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    trained = [(d, t) for d, t, *_ in rows if d is None or d % 5 != 4]
    model = lm.train(df.filter("doc_id is null or doc_id % 5 <> 4"), classes=8, own_units=own_units, sent_words=sent_words)
    lines = [[*words(t), b"\n"] for _, t in trained]
    counts = Counter(w for line in lines for w in line)
    assert (model.n_tokens, model.n_types) == (sum(counts.values()), len(counts)) and len(model.words) <= sent_words + 1
    of = {w: c for w, (_, c) in model.words.items()}
    for r in model.rest.collect():
        word = bytes(r["word"])
        assert word not in of and r["c"] == counts[word]
        of[word] = r["class"]
    assert set(of) == set(counts) and of[b"\n"] == 0 and all(c > 0 for w, c in of.items() if w != b"\n")
    k = len(model.transition)
    table, sums = np.zeros((k, k)), np.ones(k)
    for line in lines:
        for a, b in zip([b"\n", *line], line):
            table[of[a], of[b]] += 1
    for w, c in of.items():
        sums[c] += counts[w] + 1
    share = (table.sum(axis=0) + 1) / (table.sum() + k)
    chance = (table + lm.PRIOR * share) / (table.sum(axis=1, keepdims=True) + lm.PRIOR)
    assert np.allclose(model.transition, np.log10(chance)) and np.allclose(model.emission, np.log10(sums))
    assert np.allclose(chance.sum(axis=1), 1)
    total = math.log10(sum(counts.values()) + len(counts) + 1)
    texts = {r[0]: r[1] for r in rows}
    out = lm.score(df, model).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in rows)
    for r in out:
        line = [*words(texts[r["doc_id"]]), b"\n"]
        assert r["n_tokens"] == len(line) and r["n_known"] == sum(w in counts for w in line)
        assert r["base_score"] == pytest.approx(sum(math.log10(counts[w] + 1) - total for w in line))
        cls = [of[w] if w in of else model.endings[lm.ending(w)] for w in line]
        true = sum(math.log10(chance[a, b] * (counts[w] + 1) / sums[b]) for a, b, w in zip([0, *cls], cls, line))
        assert r["score"] == pytest.approx(true)


def test_lm_of_nothing(spark, none, odd):
    empty = lm.train(none)
    assert empty.n_tokens == 0 and lm.score(none, empty).count() == 0
    assert lm.score(odd, empty).count() == len(ODD) and {r["n_known"] for r in lm.score(odd, empty).collect()} == {0}


def test_best_classes_are_the_best_moves():
    rng = np.random.default_rng(43)
    table = rng.poisson(20, (5, 5)).astype(float)
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    cells = rng.poisson(3.0, (30, 10)) * (rng.random((30, 10)) < 0.5)
    at, cell = np.nonzero(cells)
    best = lm.best_classes(at, cell, cells[at, cell], 30, table)
    for w in range(30):
        def likelihood(c):
            new = table.copy()
            new[:, c] += cells[w, :5]
            new[c, :] += cells[w, 5:]
            return f(new).sum() - f(new.sum(axis=0)).sum() - f(new.sum(axis=1)).sum()
        assert likelihood(best[w]) >= max(map(likelihood, range(1, 5))) - 1e-6


def test_exchange_ends_where_no_move_helps():
    rng = np.random.default_rng(4)
    counts = rng.poisson(rng.random((12, 1)) * rng.random((1, 12)) * 30 + 40 * (np.arange(12)[:, None] % 3 == np.arange(12)[None, :] % 3)).astype(float)

    def likelihood(of, size):
        member = np.eye(size)[of]
        table = member.T @ counts @ member
        f = lambda x: x * np.log(np.maximum(x, 1.0))
        return f(table).sum() - f(table.sum(axis=0)).sum() - f(table.sum(axis=1)).sum()

    start, size = lm.exchange(counts, 4, rounds=0)
    of, size = lm.exchange(counts, 4, rounds=50)
    best = likelihood(of, size)
    assert of[0] == 0 and (of[1:] > 0).all() and best > likelihood(start, size)
    for u in range(1, 12):
        for c in range(1, size):
            moved = of.copy()
            moved[u] = c
            assert likelihood(moved, size) <= best + 1e-6


# suffixes


def brute_repeats(rows, span):
    own, out = {}, []
    for d, t, *_ in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - span + 1):
            if d is not None:
                g = raw[p : p + span]
                own[g] = min(own.get(g, d), d)
    for d, t, *_ in rows:
        raw, gone = (t or "").encode(), bytearray()
        gone = bytearray(len(raw))
        for p in range(len(raw) - span + 1):
            if d is not None and own[raw[p : p + span]] < d:
                gone[p : p + span] = b"\1" * span
        out.append((str(d), bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("group, block, witnessed", [(4096, 1_000_000, 16), (1, 1_000_000, 16), (2, 30, 1), (4096, 1, 0)])
def test_suffix_dedup_is_exact(spark, odd, none, group, block, witnessed, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", group)
    monkeypatch.setattr(suffixes, "BLOCK", block)
    monkeypatch.setattr(suffixes, "WITNESSED", witnessed)
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("ab c"), 120)) for _ in range(6)]
    rows = list(ODD[:6]) + list(ODD[8:])
    for i in range(40):
        a, b = rng.choice(base), rng.choice(base)
        rows.append((100 + i, str(a)[: rng.integers(1, 120)] + str(b)[rng.integers(0, 60) :] + str(rng.choice(base)), "en", "s", 1))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((str(r["doc_id"]), bytes(r["kept"])) for r in suffixes.remove_repeats(docs).collect())
    assert got == brute_repeats(rows, 50)
    if group > 1:
        assert suffixes.remove_repeats(none).count() == 0


@pytest.mark.parametrize("group", [4096, 1])
def test_suffix_dedup_of_repeated_rows_is_exact(spark, group, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", group)
    rng = np.random.default_rng(17)
    base = ["".join(rng.choice(list("ab c"), 120)) for _ in range(4)]
    rows = []
    for i in range(20):
        text = str(rng.choice(base))[: rng.integers(60, 120)] + str(rng.choice(base))[rng.integers(0, 60) :]
        rows += [(100 + i, text, "en", "s", 1)] * (1 + i % 3)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((str(r["doc_id"]), bytes(r["kept"])) for r in suffixes.remove_repeats(docs).collect())
    assert got == brute_repeats(rows, 50)


@pytest.mark.parametrize("group", [4096, 700])
def test_suffix_dedup_of_a_key_of_many_segments_is_exact(spark, group, monkeypatch):
    """A passage in 5000 different surroundings: the keys at its edges have a segment for each."""
    monkeypatch.setattr(suffixes, "GROUP", group)
    rng = np.random.default_rng(23)
    letters = np.array(list("abcdefgh"))
    rows = [(f"d{i:05d}", f"{''.join(rng.choice(letters, 45))} {PASSAGE[:90]} {''.join(rng.choice(letters, 45))}") for i in range(5000)]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "name string, text string").repartition(3)
    got = sorted((r["name"], bytes(r["kept"])) for r in suffixes.remove_repeats(docs, "name").collect())
    assert got == brute_repeats(rows, 50)


def test_suffix_dedup_inside_repetitive_and_very_long_texts(spark):
    rows = [(1, "ab" * 900), (2, "a" * 3000 + "ab" * 300), (3, "x" + "ab" * 40 + "a" * 70), (4, "line of a text\n" * 500), (5, "line of a text\n" * 9)]
    got = sorted((str(r["doc_id"]), bytes(r["kept"])) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_repeats(rows, 50)
    rng = np.random.default_rng(29)
    long = rng.integers(97, 123, suffixes.PIECE + 70_000, dtype=np.uint8).tobytes().decode()
    at = suffixes.PIECE - 40  # a passage over the edge of a piece
    rows = [(1, "<" + long[at : at + 90] + ">"), (2, long), (3, "(" + long[-200:] + ")")]
    out = {r["doc_id"]: r["removed"] for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == [] and [tuple(x) for x in out[2]] == [(at, at + 90)] and [tuple(x) for x in out[3]] == [(1, 201)]


def test_multikey_quicksort_groups_what_is_equal():
    rng = np.random.default_rng(31)
    for n, span in ((1, 3), (400, 3), (3000, 40)):
        run, chars = np.sort(rng.integers(0, 5, n)), rng.integers(0, span, (n, 2)).astype(np.uint64)
        found = []
        for rows, group in suffixes.multikey_quicksort(lambda r, d: chars[r, d], run, lambda r, s: np.ones(len(s), bool), 2):
            for g in np.unique(group):
                found.append(frozenset(rows[group == g].tolist()))
        true = {}
        for i in range(n):
            true.setdefault((run[i], *chars[i]), set()).add(i)
        assert set(found) == {frozenset(x) for x in true.values() if len(x) > 1} and len(found) == len(set(found))


def test_anchors_cover_every_string_and_depend_on_it_alone():
    rng = np.random.default_rng(6)
    raw = bytes(rng.choice(list(b"abcd"), 3000))
    key, first, last = suffixes.anchors(raw, 50)
    assert first[0] == 0 and last[-1] == len(raw) - 50 and (first[1:] == last[:-1] + 1).all() and (last - first).max() <= 50 - suffixes.GRAM
    own = np.repeat(key, last - first + 1)
    for p in (0, 17, 1234, len(raw) - 50):
        assert suffixes.anchors(raw[p : p + 50], 50)[0].tolist() == [own[p]]


def test_blind_trie_orders():
    rng = np.random.default_rng(7)
    numbers = [int(x) for x in rng.integers(0, 64, 200)]
    trie = suffixes.BlindTrie()
    for i, x in enumerate(numbers):
        trie.add(x, i)
    groups = list(trie.groups())
    assert [numbers[g[0]] for g in groups] == sorted(set(numbers)) and sum(map(len, groups)) == 200


# search


def test_maxscore_is_exact(spark):
    rng = np.random.default_rng(8)
    v = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(20)]
    v += [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    rows = maxscore.whole_vectors(df, "vec_id", "embedding")
    queries = rows.filter("id % 50 = 0")
    got = {}
    for r in maxscore.search(queries, rows, 5, shard=64, block=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    data = {i: np.floor(256 * np.array(x)) for i, x in v if i is not None and i < 400}
    for q in [i for i in data if i % 50 == 0]:
        best = sorted((-int(x @ data[q]), i) for i, x in data.items() if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert maxscore.search(queries, rows.filter("id < 0"), 5).count() == 0


# near duplicates


def brute_fp(text, n=3):
    w = words(text)
    runs = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark, odd, none):
    got = {}
    for r in simhash.near_components(odd).collect():
        got.setdefault(r["doc_id"], set()).add((r["fp"] & (2**64 - 1), r["component_id"]))
    fps = {d: brute_fp(t) for d, t, *_ in ODD}
    least = {d: min(e for e in fps if e is not None and bin(fps[e] ^ fps[d]).count("1") <= 3) if d is not None else None for d in fps}
    for d in fps:
        assert {f for f, _ in got[d]} == {fps[d]}
        if d is not None:
            assert {c for _, c in got[d]} == {least[d]}
    assert simhash.near_components(none).count() == 0


@pytest.mark.parametrize("bucket", [1024, 5])
def test_trie_links_span_all_pairs(spark, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(9)
    fps = {int(x) for x in rng.integers(0, 2**63, 150)}
    for x in list(fps)[:40]:
        for _ in range(3):
            y = x
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                y ^= 1 << int(b)
            fps.add(y & (2**64 - 1))
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(s, [s]) for s in signed], "id long, fp array<long>")
    links = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in simhash.trie_links(df).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in links)
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                assert find(a) == find(b)


def test_near_dedup_keeps_one_of_each_group(spark, odd, none):
    rng = np.random.default_rng(10)
    rows = []
    for g in range(12):
        base = [f"g{g}w{x}" for x in rng.integers(0, 5000, 300)]
        for c in range(4):
            w = list(base)
            if c:
                w[int(rng.integers(300))] = "changed"
            rows.append((g * 10 + c, " ".join(w), "en", "s", 1))
    half = [f"h{i}" for i in range(200)]
    rows += [(900, " ".join(half), "en", "s", 1), (901, " ".join(half[:120] + [f"k{i}" for i in range(80)]), "en", "s", 1)]
    out = sorted(r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == [g * 10 for g in range(12)] + [900, 901]
    left = simhash.near_dedup(odd).collect()
    assert sorted(str(r["doc_id"]) for r in left) == sorted(map(str, (1, 2, 3, 4, 6, 8, 10, 11, None)))
    assert simhash.near_dedup(none).count() == 0


def jaccard(x, y):
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("bucket", [1024, 50])
def test_near_dedup_of_a_group_is_that_of_all_pairs(spark, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(13)
    base = [f"b{i}" for i in range(204)]
    texts = [" ".join(base)]
    for c in range(160):  # each changed word changes five of 200 shingles: 0.78 to 0.9 of the base, 0.6 to 0.8 of each other
        w = list(base)
        for at in rng.choice(40, int(rng.integers(2, 6)), replace=False):
            w[5 * int(at) + 2] = f"c{c}x{at}"
        texts.append(" ".join(w))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    order = [int(x) for x in rng.permutation(len(texts))]
    rows = [(i, texts[i], "en", "s", 1) for i in order]
    out = sorted(r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == sorted(set(root))


def near_candidates(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    fps = simhash.fingerprints(docs, "text", 5, simhash.NEAR_WORDS, True)
    links = simhash.trie_links(fps, budget=3, table_bits=32, near=simhash.NEAR_BITS)
    return {(min(r), max(r)) for r in links.collect()}


def test_near_candidates_are_found_at_the_stated_similarity(spark):
    texts, rng = [], np.random.default_rng(15)
    for p in range(1200):  # equal first and last parts of 8/9 of n shingles each: exactly 0.8
        n = int(rng.choice([63, 126, 252, 504]))
        words = [f"p{p}w{i}" for i in range(n + 4)]
        other = words[: n * 8 // 9 + 4] + [f"p{p}v{i}" for i in range(n // 9)]
        texts += [" ".join(words), " ".join(other)]
        if p < 4:
            x, y = (set(simhash.shingle_hashes(t, 5).tolist()) for t in texts[-2:])
            assert jaccard(x, y) == pytest.approx(0.8)
    found = near_candidates(spark, texts)
    recall = sum((2 * p, 2 * p + 1) in found for p in range(1200)) / 1200
    print("recall at 0.8:", recall)
    assert recall > 0.99


def test_near_dedup_weighs_a_repeated_line_once(spark):
    lines = [" ".join(f"l{k}w{i}" for i in range(20)) for k in range(10)]
    texts = [" ".join(lines), " ".join(lines + [lines[3]] * 30)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    assert [r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()] == [0]


def test_verified_links_span_what_all_pairs_do():
    rng = np.random.default_rng(14)
    sets = [np.unique(rng.integers(0, 14, 10)) for _ in range(60)]
    links = simhash.verified_links(sets, 0.8)
    near = [(i, j) for i in range(60) for j in range(i + 1, 60) if jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8]
    assert set(links) <= set(near)

    def roots(pairs):
        root = list(range(60))
        for i, j in pairs:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
        return root

    assert roots(links) == roots(near)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, None), (7, 7)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}


# packing


def test_best_boundaries_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(11)
    for _ in range(60):
        lengths = sorted({int(x) for x in rng.integers(1, 40, 9)})
        counts = [int(x) for x in rng.integers(1, 20, len(lengths))]
        k = int(rng.integers(1, 6))

        def cost(bounds):
            return sum(c * next(b for b in bounds if b >= x) for x, c in zip(lengths, counts))

        best = min(cost((*c, lengths[-1])) for n in range(k) for c in combinations(lengths[:-1], min(n, len(lengths) - 1)))
        found = packing.best_boundaries(lengths, counts, k)
        assert len(found) <= k and cost(found) == best


def test_packing_fills_batches(spark, odd, none, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    rng = np.random.default_rng(12)
    rows = [(i, "w " * int(n), "en", "s", 1) for i, n in enumerate(rng.integers(0, 50, 200))] + [(500, "w " * 900, "en", "s", 1)]
    out = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), buckets=4, budget=200).collect()
    assert len(out) == 201
    batches = {}
    for r in out:
        assert r["padding"] == r["boundary"] - r["n_tokens"] >= 0
        batches.setdefault((r["bucket"], r["batch_id"]), []).append(r)
    for b in batches.values():
        room = max(1, 200 // b[0]["boundary"])
        assert sorted(r["slot"] for r in b) == list(range(len(b))) and len(b) <= room
    for bucket in {k for k, _ in batches}:
        sizes = [(max(1, 200 // b[0]["boundary"]) - len(b)) for (k, _), b in batches.items() if k == bucket]
        assert sum(s > 0 for s in sizes) <= 1
    assert packing.pack_documents(odd).count() == len(ODD) and packing.pack_documents(none).count() == 0


# the whole


def test_clashing_columns_pass(spark):
    from pyspark.sql import functions as F

    good = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, good, "en", "s", 1)], SCHEMA).withColumns(
        {c: F.lit(9) for c in ("n_words", "kept", "ids", "secrets", "removed", "fp", "bucket", "score", "toxic", "_x")}
    )
    assert quality.quality_verdicts(docs).first()["n_words"] == 80
    assert secrets.scan_secrets(docs).first()["secrets"] == []
    assert chunks.drop_repeats(docs).first()["removed"] == []
    assert suffixes.remove_repeats(docs).first()["removed"] == []
    assert simhash.near_dedup(docs).columns == docs.columns
    assert packing.pack(docs, "n_chars", "doc_id").first()["bucket"] == 0
    assert toxicity.score_documents(docs, toxicity.Severity({}, (1.0,))).first()["toxic"] is False


def test_pipeline_on_a_fixture(spark, tmp_path):
    import corpus_pipeline

    good = [f"w{i * 37 % 4001}" for i in range(120)]
    rows = [
        (1, " ".join(good), "en", "s", 1),
        (2, " ".join(good), "en", "s", 1),
        (3, " ".join(good[:60] + ["x"] + good[61:]), "en", "s", 1),
        (4, "too short", "en", "s", 1),
        (5, " ".join(f"q{i}" for i in range(80)) + " " + PASSAGE, "en", "s", 1),
        (6, " ".join(f"r{i}" for i in range(80)) + " " + PASSAGE + " password=abcdefghijkl1 end", "en", "s", 1),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    left = {r["doc_id"]: r for r in docs.collect()}
    assert sorted(left) == [1, 5, 6]
    assert "password" not in left[6]["text"] and left[6]["text"].count("pass") <= 20 and left[5]["text"].count("pass") == 60
    assert left[6]["n_chars"] == len(left[6]["text"])
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [1, 5, 6]

