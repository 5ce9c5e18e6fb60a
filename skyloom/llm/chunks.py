"""Substring dedup: content-defined chunks cut by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.arrow import map_rows
from skyloom.llm.common import col, drop_shared, fresh, others, read_table, shared_table

#: Bytes of a chunk at least and at most, and the bits of the gear hash that are 0 where a chunk ends.
LEAST, MOST, BITS = 12, 256, 2
#: The same bits where no white space is near.
CLOSE_BITS = 4
#: Words in a row that must have been seen before for a stretch to go.
MIN_WORDS = 25
#: A stretch without white space counts as a word, and again for each ``MORE`` bytes beyond ``LONG_WORD``.
LONG_WORD, MORE = 24, 8
#: Words of a run of seen chunks from which a stretch may grow, and bytes that are compared beyond either end of it.
SEED_WORDS, REACH = 6, 2 * MOST


def gear_table():
    """A fixed random 32-bit number for each byte."""
    import numpy as np

    return np.random.Generator(np.random.PCG64(20240)).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def gear_hashes(data, table):
    """At each byte the gear hash of the 32 bytes up to it: the sum of table[byte] shifted by its distance.

    Sums over 1, 2, 4 ... 32 bytes are doubled, so the rolling hash takes five passes over the array.
    """
    import numpy as np

    h = table[data]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] += h[:-shift] << np.uint32(shift)
    return h


def chunk_ends(raw: bytes, table, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[int]:
    """Ends of the chunks of ``raw``: after white space where the hash's low ``bits`` of its upper half are 0.

    Where no such place comes for ``most`` bytes, as in texts without white space, chunks end at characters where
    ``CLOSE_BITS`` bits of the hash are 0. Chunks are ``least`` bytes long or more, but for the last. Without either
    place for ``most`` bytes a chunk ends at the next character. What a stretch is cut into depends on it alone but
    for its first chunks, so an insertion moves no cut beyond the next ones.
    """
    import numpy as np

    n = len(raw)
    if not n:
        return []
    data = np.frombuffer(raw, np.uint8)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    mask = np.uint32(((1 << bits) - 1) << 24)
    hashes = gear_hashes(data, table)
    places = np.flatnonzero(gap & ((hashes & mask) == 0)) + 1
    far = np.diff(np.concatenate([[0], places, [n]])) > most
    if far.any():
        close = (hashes & np.uint32(((1 << CLOSE_BITS) - 1) << 24)) == 0
        close[:-1] &= (data[1:] & 0xC0) != 0x80
        inner = np.flatnonzero(close) + 1
        places = np.union1d(places, inner[far[np.searchsorted(places, inner, "left")]])
    ends, last = [], 0
    for e in [*places[places < n].tolist(), n]:
        while e - last > most:
            cut = last + most
            while cut < n and raw[cut] & 0xC0 == 0x80:
                cut += 1
            if cut >= e:
                break
            ends.append(cut)
            last = cut
        if e - last >= least or e == n and e > last:
            ends.append(e)
            last = e
    return ends


def word_marks(data):
    """Whether a word is counted at each byte: where one starts, and in a long one every ``MORE`` bytes."""
    import numpy as np

    gap = (data == 32) | ((data >= 9) & (data <= 13))
    first = ~gap
    first[1:] &= gap[:-1]
    at = np.arange(len(data))
    inside = at - np.maximum.accumulate(np.where(first, at, 0))
    return first | ~gap & (inside >= LONG_WORD) & ((inside - LONG_WORD) % MORE == 0)


def chunk_rows(docs: DataFrame, text: str, width: bool, min_words: int = MIN_WORDS) -> DataFrame:
    """A row a chunk: digest of 128 bits (high, low), doc (the ``key`` of ``docs``) and, with ``width``, row, start, end, words.

    A text of fewer than ``min_words`` words is a chunk as a whole, too, of ``min_words`` words, so that copies of
    it can go. Such chunks are digested apart from others.
    """

    def make():
        import numpy as np
        import pyarrow as pa
        import xxhash

        table, digest = gear_table(), xxhash.xxh3_128_digest

        def run(keys: list, rows: list, texts: list) -> dict[str, list]:
            digests, sizes, starts, ends, words = [], [], [], [], []
            for t in texts:
                raw = t.encode() if t else b""
                cuts = chunk_ends(raw, table)
                sizes.append(len(cuts))
                if not cuts:
                    continue
                begin = [0, *cuts[:-1]]
                digests += [digest(raw[a:b]) for a, b in zip(begin, cuts)]
                seen = np.concatenate([[0], np.cumsum(word_marks(np.frombuffer(raw, np.uint8)))])
                short = seen[-1] < min_words
                if short:
                    sizes[-1] += 1
                    digests.append(digest(raw, 1))
                if width:
                    starts += begin
                    ends += cuts
                    words += np.diff(seen[[0, *cuts]]).tolist()
                    if short:
                        starts.append(0)
                        ends.append(len(raw))
                        words.append(min_words)
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            out = {
                "high": pa.array(both[:, 0]),
                "low": pa.array(both[:, 1]),
                "doc": [k for k, n in zip(keys, sizes) for _ in range(n)],
            }
            if width:
                out |= {"row": [r for r, n in zip(rows, sizes) for _ in range(n)], "start": starts, "end": ends, "words": words}
            return out

        return run

    source = docs.select("key", "row", text)
    kind = dict(docs.dtypes)["key"]
    schema = f"high long, low long, doc {kind}" + (", row long, start int, end int, words int" if width else "")
    return map_rows(source, make, schema)


def repeated_chunks(docs: DataFrame, text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc``, row, start, end, words, lo of each chunk whose digest also comes in documents of a smaller ``key``, ``lo`` the smallest.

    The digests' owners come from partial minima; chunks and the owners of repeated digests are then joined,
    with nothing above the join that needs a digest's rows together, so that a chunk that a third of all
    documents hold can be split over tasks.
    """
    owners = shared_table(
        chunk_rows(docs, text, False, min_words).groupBy("high", "low").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
        .filter("lo < hi").select("high", "low", "lo"),
        "owners",
    )
    found = chunk_rows(docs, text, True, min_words).join(owners, ["high", "low"]).filter("lo < doc")
    return shared_table(found.select("doc", "row", "start", "end", "words", "lo"), "repeats")


def runs_of(chunks: list[tuple], least: int) -> list[tuple]:
    """Runs (start, end, words, owner, first, last) of adjacent chunks (start, end, words, lo), with ``least`` words or more.

    ``owner`` is the smallest document of most of its chunks, first and last are the outermost chunks (start, end) that are its.
    """
    runs, held = [], []

    def close():
        words = sum(n for _, _, n, _ in held)
        if held and words >= least:
            counts = Counter(lo for *_, lo in held)
            owner = min(counts, key=lambda x: (-counts[x], x))
            own = [(a, b) for a, b, _, lo in held if lo == owner]
            runs.append((held[0][0], held[-1][1], words, owner, own[0], own[-1]))

    for c in sorted(set(chunks)):
        if held and c[0] == held[-1][0]:  # a short text is a chunk as a whole, too
            if c[1] >= held[-1][1]:
                held[-1] = c
            continue
        if held and c[0] != held[-1][1]:
            close()
            held = []
        held.append(c)
    close()
    return runs


def _same(a: bytes, b: bytes, back: bool) -> int:
    """How many bytes at their ends, or ``back`` from them at their beginnings turned round, two texts have in common."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if (a[len(a) - middle :] == b[len(b) - middle :]) if back else (a[:middle] == b[:middle]):
            low = middle
        else:
            high = middle - 1
    return low


def grown(owner: bytes, left: bytes, at: int, right: bytes, size: int) -> tuple[int, int]:
    """How far a stretch goes on before and behind: ``left[at:]`` and ``right[:size]`` come in ``owner``; -1 where they do not."""

    def best(anchor: bytes, rest: bytes, back: bool) -> int:
        most, place = -1, owner.find(anchor)
        while place >= 0:
            beside = owner[max(0, place - len(rest)) : place] if back else owner[place + len(anchor) : place + len(anchor) + len(rest)]
            most = max(most, _same(rest, beside, back))
            place = -1 if most == len(rest) else owner.find(anchor, place + 1)
        return most

    return best(left[at:], left[:at], True), best(right[:size], right[size:], False)


def whole_words(raw: bytes, start: int, end: int) -> tuple[int, int]:
    """The stretch without the halves of characters and, unless they are long, of words at its ends, nor white space before it."""
    gap = b" \t\n\x0b\x0c\r"
    first = start
    while first < end and first and raw[first] not in gap and raw[first - 1] not in gap and first - start <= LONG_WORD:
        first += 1
    if first - start <= LONG_WORD:
        start = first
    while 0 < start < end and raw[start] in gap:  # what is left before it keeps its space
        start += 1
    last = end
    while last > start and last < len(raw) and raw[last] not in gap and raw[last - 1] not in gap and end - last <= LONG_WORD:
        last -= 1
    if end - last <= LONG_WORD:
        end = last
    while start < end and raw[start] & 0xC0 == 0x80:
        start += 1
    while start < end < len(raw) and raw[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def growth(docs: DataFrame, marked: DataFrame, min_words: int) -> DataFrame:
    """``doc``, row, start, end, before, behind of runs in ``marked`` (doc, row, chunks): how far they go on in their owner's text.

    A run of ``min_words`` words is held by its outermost chunks, a shorter one as a whole. What goes to the owner's task are
    ``REACH`` bytes about each end, not texts; a run that its owner does not hold so has -1.
    """
    kind = dict(docs.dtypes)["key"]
    joined = docs.join(marked, (docs["key"] == marked["doc"]) & (docs["row"] == marked["mark"])).select("doc", "row", "body", "chunks")

    def ask():
        def run(docs_: list, rows: list, texts: list, found: list) -> dict[str, list]:
            out = []
            for doc, row, text, chunks in zip(docs_, rows, texts, found):
                raw = text.encode()
                for start, end, words, owner, first, last in runs_of([(x["start"], x["end"], x["words"], x["lo"]) for x in chunks], SEED_WORDS):
                    (a, b), (c, d) = (first, last) if words >= min_words else ((start, end), (start, end))
                    at = max(0, a - REACH)
                    out.append((owner, doc, row, start, end, raw[at:b], a - at, raw[c : d + REACH], d - c))
            names = ("owner", "doc", "row", "start", "end", "left", "at", "right", "size")
            return dict(zip(names, map(list, zip(*out)))) if out else {n: [] for n in names}

        return run

    asked = map_rows(joined, ask, f"owner {kind}, doc {kind}, row long, start int, end int, left binary, at int, right binary, size int", 64)
    asked = shared_table(asked, "ends")
    owners = docs.select(F.col("key").alias("own"), F.col("body").alias("text"))
    met = asked.join(owners, F.col("owner") == F.col("own")).select("doc", "row", "start", "end", "left", "at", "right", "size", "text")

    def answer():
        def run(docs_, rows, starts, ends, lefts, ats, rights, sizes, texts) -> dict[str, list]:
            cached: dict[str, bytes] = {}
            made = []
            for left, at, right, size, text in zip(lefts, ats, rights, sizes, texts):
                if text not in cached:
                    cached = {text: (text or "").encode()}
                made.append(grown(cached[text], left, at, right, size))
            return {"doc": docs_, "row": rows, "start": starts, "end": ends, "before": [x for x, _ in made], "behind": [x for _, x in made]}

        return run

    out = map_rows(met, answer, f"doc {kind}, row long, start int, end int, before int, behind int", 64)
    # an owner's key may come with several texts
    best = out.groupBy("doc", "row", "start", "end").agg(F.max("before").alias("before"), F.max("behind").alias("behind"))
    return shared_table(best, "growth")


def stretches(raw: bytes, chunks: list[tuple], found: dict[tuple[int, int], tuple[int, int]], min_words: int) -> list[tuple[int, int]]:
    """What of a text goes: runs of chunks, as far as they grow, of ``min_words`` words or more; those that meet are one."""
    import numpy as np

    seen = np.concatenate([[0], np.cumsum(word_marks(np.frombuffer(raw, np.uint8)))])
    out: list[tuple[int, int]] = []
    for start, end, words, _, first, last in runs_of(chunks, SEED_WORDS):
        before, behind = found.get((start, end), (-1, -1))
        a, b = (first[0], last[1]) if words >= min_words else (start, end)
        s = min(start, a - before) if before >= 0 else start
        e = max(end, b + behind) if behind >= 0 else end
        if words < min_words and min(before, behind) < 0:
            continue
        s, e = whole_words(raw, s, e) if (s, e) != (start, end) else (s, e)
        s, e = min(s, start), max(e, end)
        if words < min_words and seen[e] - seen[s] < min_words:
            continue
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs``, all rows, with ``text`` without its repeated stretches and ``removed``, their byte spans.

    A stretch is a run of adjacent chunks that documents of a smaller ``key`` hold too, or a shorter run as far as it goes on
    in the document that holds it, of ``min_words`` words or more, or the whole of a shorter text that such a document
    equals; the smallest document keeps its own. Chunks find stretches, and bytes are compared beyond the ends of a run, so
    a stretch ends with the words that both hold. Of a
    stretch without white space every ``MORE`` bytes beyond ``LONG_WORD`` count as a word. Chunks are told apart
    by 128-bit digests, and rows of one key by a hash of their text. A null text stays null, an empty one empty; a row of
    a null key is left as it is and takes nothing from others; repeated rows of one key take nothing from each other. An
    empty table gives an empty table. A column named ``removed``, in any case, is replaced; others keep their values
    whatever they are called.
    """
    kept = others(docs, text, "removed")
    body, doc, row, chunks = fresh(docs, "body", "doc", "row", "chunks")
    text_of = F.xxhash64(col(text))
    slim = docs.select(col(key).alias("key"), text_of.alias("row"), col(text).alias("body"))
    repeats = repeated_chunks(slim, "body", min_words)
    listed = shared_table(repeats.groupBy("doc", F.col("row").alias("mark")).agg(F.collect_list(F.struct("start", "end", "words", "lo")).alias("chunks")), "marked")
    drop_shared(repeats)
    ends = growth(slim, listed, min_words)
    ends = ends.groupBy(F.col("doc").alias("of"), F.col("row").alias("of_row")).agg(F.collect_list(F.struct("start", "end", "before", "behind")).alias("ends"))
    both = listed.join(ends, (listed["doc"] == F.col("of")) & (listed["mark"] == F.col("of_row")), "left")
    grow = fresh(docs, "grow")[0]
    marked = both.select(F.col("doc").alias(doc), F.col("mark").alias(row), F.col("chunks").alias(chunks), F.col("ends").alias(grow))
    owner, mine = fresh(docs, "owner", "mine")
    keyed = docs.select(*map(col, kept), col(text).alias(body), col(key).alias(owner), text_of.alias(mine))

    def make():
        def run(*columns: list) -> dict[str, list]:
            texts, found, ends = columns[-3:]
            spans, left = [], []
            for t, c, g in zip(texts, found, ends):
                raw, far = (t or "").encode(), {(x["start"], x["end"]): (x["before"], x["behind"]) for x in g or ()}
                runs = stretches(raw, [(x["start"], x["end"], x["words"], x["lo"]) for x in c], far, min_words) if c else []
                if runs:
                    parts, at = [], 0
                    for a, b in runs:
                        parts.append(raw[at:a])
                        at = b
                    t = b"".join([*parts, raw[at:]]).decode()
                spans.append([{"start": a, "end": b} for a, b in runs])
                left.append(t)
            return dict(zip(kept, columns)) | {body: left, "removed": spans}

        return run

    same = (keyed[owner] == marked[doc]) & (keyed[mine] == marked[row])
    joined = keyed.join(marked, same, "left").select(*map(col, kept), body, chunks, grow)
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,end:int>>")
    return map_rows(joined, make, joined.drop(chunks, grow).withColumn("removed", empty).schema).withColumnRenamed(body, text)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses: its bytes, those removed, their spans, and the text that is left.

    A null text counts no bytes and stays null; repeated rows of a doc_id take nothing from each other.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length("text").alias("n"))
    found = drop_repeats(docs)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"),
        "text",
    )
