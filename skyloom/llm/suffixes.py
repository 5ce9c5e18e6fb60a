"""Suffix-array dedup: repeated byte strings found by deep-shallow sorting of the suffixes that may repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.arrow import map_rows, whole_keys
from skyloom.llm.common import col, drop_shared, fresh, others, read_table, shared_table

#: Bytes of an anchor, and the longest piece of a text that is scanned at a time.
GRAM, PIECE = 16, 1 << 23


def anchors(raw: bytes, span: int, gram: int = GRAM):
    """Arrays (key, first, last): each ``span``-byte string of ``raw`` belongs to one anchor.

    The string that starts at p belongs to the leftmost ``gram``-byte string of the least hash in it; those that
    start at first .. last belong to the same one, whose hash is key. The choice depends on the string alone, so
    equal strings of different texts have equal keys. ``gram`` is 16 to 24.
    """
    import numpy as np

    keys, firsts, lasts = [], [], []
    n = len(raw) - span + 1  # strings
    for at in range(0, max(n, 0), PIECE):
        many = min(PIECE, n - at)
        part = raw[at : at + many + span - 1]
        places = sorted({0, 8, gram - 8})
        words = [np.ndarray((len(part) - gram + 1,), "<u8", part, o, (1,)).astype(np.uint64) for o in places]
        with np.errstate(over="ignore"):
            h = words[0] * np.uint64(0x9E3779B97F4A7C15)
            for w in words[1:]:
                h = ((h ^ (h >> np.uint64(29))) + w) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(29)
        least = (h & np.uint64(~0xFFFFFF & (2**64 - 1))) | np.arange(len(h), dtype=np.uint64)
        width, size = span - gram + 1, 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: many], least[width - size : width - size + many])
        own = (least[:many] & np.uint64(0xFFFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        keys.append(h[own[starts]])
        firsts.append(starts + at)
        lasts.append(np.concatenate([starts[1:] - 1, [many - 1]]) + at)
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(map(np.concatenate, (keys, firsts, lasts)))


#: Suffixes are ordered by this many bytes with multikey quicksort; blind tries order what is equal so far.
SHALLOW = 16
#: Segments of a key that are sorted together. A key with more is sorted in parts, and what stands for each part again.
GROUP = 4096
#: Anchors of a block, within which repeats are settled before anything is shuffled.
BLOCK = 400_000
#: Segments of one key in a block beyond which they are dealt by segment, and a witness stands for them at the key.
WITNESSED = 16


class BlindTrie:
    """Orders strings of one length by a binary trie that stores the positions of deciding bits only.

    A string is first led down blindly to some leaf; one comparison with that leaf's string tells the bit in which
    they differ, and the string branches off above the first node that asks for a later bit. Equal strings meet in a
    leaf. Strings are big-endian numbers; bit 0 is the last.
    """

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # a leaf [number, members], or a node (bit, left, right) as a list of three

    def add(self, number: int, member: int) -> None:
        node = self.root
        if node is None:
            self.root = [number, [member]]
            return
        while len(node) == 3:
            node = node[2] if number >> node[0] & 1 else node[1]
        bit = (node[0] ^ number).bit_length() - 1
        if bit < 0:
            node[1].append(member)
            return
        parent, node = None, self.root
        while len(node) == 3 and node[0] > bit:
            parent, node = node, node[2] if number >> node[0] & 1 else node[1]
        leaf = [number, [member]]
        new = [bit, node, leaf] if number >> bit & 1 else [bit, leaf, node]
        if parent is None:
            self.root = new
        elif parent[1] is node:
            parent[1] = new
        else:
            parent[2] = new

    def groups(self):
        """The members of each distinct string, in the order of the strings."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if len(node) == 3:
                stack += [node[2], node[1]]
            else:
                yield node[1]


def _heads(*keys):
    """Starts of the stretches of rows that are equal in all sorted ``keys``, and the number of each row's stretch."""
    import numpy as np

    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change), np.cumsum(change) - 1


def multikey_quicksort(word, run, several, depths: int):
    """Yields arrays of rows, and of their group's number, whose groups are equal in ``depths`` characters.

    ``word(rows, depth)`` is a character of each row (8 bytes as a number), ``run`` ascending numbers of the
    groups at the start. Every pass splits all open groups at once by a pivot of their own into less, equal and
    greater; the equal part goes on to its next character, the others stay at this one. ``several(rows, starts)``
    tells which groups are worth going on with.
    """
    import numpy as np

    rows, depth = np.arange(len(run)), np.zeros(len(run), np.int64)
    _, run = _heads(run)
    while len(rows):
        starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        size = np.diff(np.append(starts, len(rows)))
        live = (size > 1) & several(rows, starts)
        keep = np.repeat(live, size)
        rows, depth, run = rows[keep], depth[keep], run[keep]
        if not len(rows):
            return
        _, run = _heads(run)
        done = depth == depths
        if done.any():
            yield rows[done], run[done]
            rows, depth, run = rows[~done], depth[~done], run[~done]
            if not len(rows):
                return
            _, run = _heads(run)
        starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        size = np.diff(np.append(starts, len(rows)))
        c = word(rows, depth)
        three = np.stack([c[starts], c[starts + size // 2], c[starts + size - 1]])
        pivot = np.sort(three, axis=0)[1][run]
        side = (c >= pivot).astype(np.int8) + (c > pivot)
        place = np.zeros(len(rows), np.int64)
        before = starts.copy()  # where each group's next side begins
        for s in range(3):
            seen = np.cumsum(side == s)
            first = seen[starts] - (side[starts] == s)
            mine = side == s
            place[mine] = (before[run] + seen - 1 - first[run])[mine]
            before += np.append(seen[starts[1:] - 1], seen[-1]) - first
        order = np.empty(len(rows), np.int64)
        order[place] = np.arange(len(rows))
        rows, side, run, depth = rows[order], side[order], run[order], depth[order]
        depth = depth + (side == 1)
        _, run = _heads(run, side)


def equal_strings(groups, segments: list[bytes], span: int, owners):
    """For each segment a mask of its ``span``-byte strings that a segment of the same group with a smaller owner has.

    Deep-shallow sorting of the suffixes within each group: multikey quicksort by characters of 8 bytes to ``SHALLOW``
    bytes, then a blind trie for every stretch that is equal so far. A trie of two leaves is one comparison, and those
    comparisons are made for all such pairs at once; strings that a mix of their bytes tells from all others of a stretch
    need no leaf. Stretches of a single owner are left out. ``groups`` are ascending numbers, ``owners`` comparable numbers, ``span`` is ``SHALLOW`` + 8 or more.
    """
    import numpy as np

    masks = np.zeros(len(segments), np.int64)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    counts = np.maximum(sizes - span + 1, 0)
    of = np.repeat(np.arange(len(segments)), counts)
    if not len(of):
        return masks
    offset = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    text = b"".join(segments) + b"\0" * 8
    at = (np.cumsum(sizes) - sizes)[of] + offset
    words = np.ndarray((len(text) - 7,), ">u8", text, 0, (1,))
    own = np.asarray(owners)[of]

    def several(rows, starts):
        owner = own[rows]
        return np.minimum.reduceat(owner, starts) < np.maximum.reduceat(owner, starts)

    def settle(rows, starts):
        """Marks the rows of equal strings, stretches of ``rows``, whose owner is not the least of theirs."""
        owner = own[rows]
        least = np.repeat(np.minimum.reduceat(owner, starts), np.diff(np.append(starts, len(rows))))
        hit = rows[owner > least]
        np.bitwise_or.at(masks, of[hit], np.int64(1) << offset[hit])

    def word(rows, depth):
        return words[at[rows] + 8 * depth].astype(np.uint64)

    for rows, run in multikey_quicksort(word, np.asarray(groups)[of], several, SHALLOW // 8):
        starts, _ = _heads(run)
        size = np.diff(np.append(starts, len(rows)))
        pairs = starts[size == 2]
        a, b = rows[pairs], rows[pairs + 1]
        same = np.ones(len(pairs), bool)
        for o in range(SHALLOW, span, 8):
            o = min(o, span - 8)
            same &= words[at[a] + o] == words[at[b] + o]
        if same.any():
            both = np.stack([a[same], b[same]], axis=1).ravel()
            settle(both, np.arange(0, len(both), 2))
        # of longer stretches, what differs from all others in a mix of the bytes that are left is equal to none
        many = size > 2
        deep, stretch = rows[np.repeat(many, size)], np.repeat(np.arange(many.sum()), size[many])
        mix = np.zeros(len(deep), np.uint64)
        for o in range(SHALLOW, span, 8):
            mix = (mix ^ mix >> np.uint64(29) ^ words[at[deep] + min(o, span - 8)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        order = np.lexsort((mix, stretch))
        first, each = _heads(stretch[order], mix[order])
        order = np.sort(order[np.diff(np.append(first, len(order)))[each] > 1])
        deep, stretch = deep[order], stretch[order]
        first, _ = _heads(stretch)
        equal = []
        for members in np.split(deep, first[1:]) if len(first) else []:
            trie = BlindTrie()
            for i, p in zip(members.tolist(), at[members].tolist()):
                trie.add(int.from_bytes(text[p + SHALLOW : p + span], "big"), i)
            equal += [g for g in trie.groups() if len(g) > 1]
        if equal:
            ends = np.cumsum([len(g) for g in equal])
            settle(np.concatenate(equal), np.concatenate([[0], ends[:-1]]))
    return masks


#: Kinds of rows: a block's copy of a segment that is compared under its key, the same dealt by segment, a sign that a
#: key has such, a stretch known to repeat, and a stretch that repeats an earlier one of its own document.
REPRESENTATIVE, DEALT, WITNESS, REPEAT, ALIAS = range(5)
_ROWS = "kind byte, key long, seg long, doc {}, place long"


def _ranks(owners):
    """Dense ranks of an Arrow array's values, ascending, as numbers."""
    import numpy as np
    import pyarrow.compute as pc

    return pc.rank(owners, sort_keys="ascending", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)


def _blocks(docs: DataFrame, doc: str, text: str, span: int) -> DataFrame:
    """The anchors of ``docs`` in rows of kind, key, seg, doc and place (first << 16 | last - first).

    A segment reaches from the first string of an anchor to the end of its last; seg is its digest. In each block of
    some documents, the smallest document's segment stands for all equal ones: the others repeat it, or are aliases
    where they are of the same document, whose ``key`` is the place that they follow. Neighbouring repeats are joined.
    """
    schema = _ROWS.format(dict(docs.dtypes)[doc])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh64_intdigest

        def block(ids, raws, parts):
            key, first, last = (np.concatenate(x) for x in list(zip(*parts))[:3])
            seg = np.concatenate([p[3] for p in parts])
            of = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            ids = pa.chunked_array(ids).combine_chunks()
            rank = _ranks(ids)[of]
            place = first << 16 | last - first
            order = np.lexsort((rank, seg, key))
            starts, stretch = _heads(key[order], seg[order])
            head = np.empty(len(key), np.int64)
            head[order] = order[starts][stretch]
            kind = np.where(rank > rank[head], REPEAT, ALIAS)
            kind[order[starts]] = REPRESENTATIVE
            lead = order[starts]  # in the order of keys
            at, mine = _heads(key[lead])
            many = np.diff(np.append(at, len(lead))) > WITNESSED
            kind[lead[many[mine]]] = DEALT
            seen = key[head] if not (kind == ALIAS).any() else np.where(kind == ALIAS, place[head].astype(np.uint64), key)
            # neighbours that repeat, in one row
            again = kind == REPEAT
            more = np.flatnonzero(again)
            joined = np.zeros(len(more), bool)
            joined[1:] = (np.diff(more) == 1) & (of[more[1:]] == of[more[:-1]]) & (first[more[1:]] == last[more[:-1]] + 1)
            begin = np.flatnonzero(~joined)
            end = np.append(begin[1:], len(more))[: len(begin)] - 1
            rest = np.flatnonzero(~again)
            columns = [[kind[rest], seen[rest].view(np.int64), seg[rest].view(np.int64), of[rest], place[rest]]]
            if len(begin):
                a, b, d = first[more[begin]], last[more[end]], of[more[begin]]
                short = b - a < 1 << 16
                for s in np.flatnonzero(~short).tolist():  # too long for a place
                    for x in range(int(a[s]), int(b[s]) + 1, 1 << 16):
                        y = min(x + 0xFFFF, int(b[s]))
                        a, b, d = np.append(a, x), np.append(b, y), np.append(d, d[s])
                a, b, d = (x[np.append(short, np.ones(len(x) - len(short), bool))] for x in (a, b, d))
                marks = np.array([digest(raws[i][x : y + span]) for i, x, y in zip(d.tolist(), a.tolist(), b.tolist())], np.uint64)
                columns.append([np.full(len(a), REPEAT), marks.view(np.int64), marks.view(np.int64), d, a << 16 | b - a])
            signs = lead[at[many]]
            columns.append([np.full(len(signs), WITNESS), key[signs].view(np.int64), np.zeros(len(signs), np.int64), of[signs], np.zeros(len(signs), np.int64)])
            kind, key, seg, of, place = map(np.concatenate, zip(*columns))
            return pa.RecordBatch.from_arrays(
                [pa.array(kind.astype(np.int8)), pa.array(key), pa.array(seg), ids.take(pa.array(of)), pa.array(place)],
                names=["kind", "key", "seg", "doc", "place"],
            )

        ids, raws, parts, held = [], [], [], 0
        for batch in batches:
            owners = batch.column(0)
            for i, t in enumerate(batch.column(1)):
                raw = (t.as_py() or "").encode()
                if len(raw) < span:
                    continue
                key, first, last = anchors(raw, span)
                segs = np.fromiter((digest(raw[a:b]) for a, b in zip(first.tolist(), (last + span).tolist())), np.uint64, len(key))
                ids.append(owners.slice(i, 1))
                raws.append(raw)
                parts.append((key, first, last, segs))
                held += len(key)
                if held >= BLOCK:
                    yield block(ids, raws, parts)
                    ids, raws, parts, held = [], [], [], 0
        if parts:
            yield block(ids, raws, parts)

    return docs.select(col(doc), col(text)).filter(col(doc).isNotNull()).mapInArrow(run, schema)


def _settled(rows: DataFrame) -> DataFrame:
    """The repeats and aliases of ``rows``, and as REPRESENTATIVE the segments whose keys hold other ones, too.

    One shuffle deals a key's rows to a task: of each block one row a segment, and no more than ``WITNESSED`` of a key, so
    a key of a third of all documents brings that many rows a block. The other rows are dealt by segment or document.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(t, pick, kind):
            t = t.take(pa.array(pick)).combine_chunks()
            return t.set_column(0, "kind", pa.array(np.full(len(pick), kind, np.int8)))

        for t in whole_keys(batches, ["key"], 200_000):
            kind, key, seg = (t.column(c).to_numpy() for c in ("kind", "key", "seg"))
            passed = np.flatnonzero(kind >= REPEAT)
            if len(passed):
                yield from t.take(pa.array(passed)).to_batches()
            mine = np.flatnonzero(kind <= WITNESS)
            if not len(mine):
                continue
            rank = _ranks(t.column("doc").combine_chunks())
            mine = mine[np.lexsort((rank[mine], seg[mine], kind[mine] == WITNESS, key[mine]))]
            kind, key, seg, rank = kind[mine], key[mine], seg[mine], rank[mine]
            starts, stretch = _heads(key, seg, kind == WITNESS)
            least = rank[starts][stretch]
            again = (rank > least) & (kind != WITNESS)
            if again.any():
                yield from out(t, mine[again], REPEAT).to_batches()
            at, of = _heads(key)
            shared = np.maximum.reduceat(kind, at) > REPRESENTATIVE
            shared |= np.minimum.reduceat(least, at) < np.maximum.reduceat(least, at)
            asked = (rank == least) & (kind != WITNESS) & shared[of]
            if asked.any():
                yield from out(t, mine[asked], REPRESENTATIVE).to_batches()

    dealt = F.when(F.col("kind").isin(REPRESENTATIVE, WITNESS), F.xxhash64("key")).when(
        F.col("kind") == DEALT, F.xxhash64("key", "seg")
    ).otherwise(F.xxhash64("doc"))
    return rows.repartition(dealt).sortWithinPartitions("key").mapInArrow(run, rows.schema)


def _segment_bytes(docs: DataFrame, doc: str, text: str, wanted: DataFrame, span: int) -> DataFrame:
    """``wanted`` (key, seg, doc, place) with ``body``, the segment's bytes from the document."""
    by_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "seg", "place")).alias("segs"))
    slim = docs.select(col(doc).alias("owner"), col(text).alias("body"))
    joined = slim.join(by_doc, slim["owner"] == by_doc["doc"]).select("doc", "body", "segs")

    def make():
        import xxhash

        def run(ids: list, texts: list, lists: list) -> dict[str, list]:
            out: dict[str, list] = {"key": [], "seg": [], "doc": [], "place": [], "body": []}
            for d, t, segs in zip(ids, texts, lists):
                raw = t.encode() if t else b""
                for s in segs:
                    first, more = s["place"] >> 16, s["place"] & 0xFFFF
                    body = raw[first : first + more + span]
                    if xxhash.xxh64_intdigest(body) == s["seg"] & (2**64 - 1):  # rows of one id may differ
                        for name, value in (("key", s["key"]), ("seg", s["seg"]), ("doc", d), ("place", s["place"]), ("body", body)):
                            out[name].append(value)
            return out

        return run

    return map_rows(joined, make, f"key long, seg long, doc {dict(wanted.dtypes)['doc']}, place long, body binary")


def _sorted(bodies: DataFrame, span: int, strings: bool) -> DataFrame:
    """``bodies`` (key, part, base, cuts, seg, doc, place, body) sorted part by part.

    Rows seg, doc, place and mask where a string repeats; a segment's strings start at ``base`` in it. With ``strings``
    there is a row with base and body, too, for each string that no smaller document of its part has, if its key has
    several parts.
    """
    kind = dict(bodies.dtypes)["doc"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for t in whole_keys(batches, ["key", "part"], 20_000):
            key, part, base, cuts = (t.column(c).to_numpy() for c in ("key", "part", "base", "cuts"))
            segments = t.column("body").to_pylist()
            _, group = _heads(key, part)
            masks = equal_strings(group, segments, span, _ranks(t.column("doc").combine_chunks()))
            hit = np.flatnonzero(masks)
            at, bases, found, bodies = [hit], [base[hit]], [masks[hit] << base[hit]], [None] * len(hit)
            left = [
                (i, o) for i in (np.flatnonzero(cuts > 1).tolist() if strings else [])
                for o in range(len(segments[i]) - span + 1) if not masks[i] >> o & 1
            ]
            if left:
                rows, offsets = (np.array(x) for x in zip(*left))
                at.append(rows)
                bases.append(base[rows] + offsets)
                found.append(np.zeros(len(rows), np.int64))
                bodies += [segments[i][o : o + span] for i, o in left]
            at, bases, found = map(np.concatenate, (at, bases, found))
            if len(at):
                took = t.select(["key", "cuts", "seg", "doc", "place"]).take(pa.array(at)).combine_chunks()
                took = took.append_column("base", pa.array(bases.astype(np.int32))).append_column("mask", pa.array(found))
                yield from took.append_column("body", pa.array(bodies, pa.binary())).to_batches()

    dealt = bodies.repartition("key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(run, f"key long, cuts int, seg long, doc {kind}, place long, base int, mask long, body binary")


def _masks(bodies: DataFrame, span: int) -> DataFrame:
    """``doc``, place, seg and mask of the segments that hold strings of smaller documents.

    Each key is sorted in parts of ``GROUP`` segments, most keys in one. Of the parts of a larger key those strings that
    are no repeats so far, one document's of each part, are sorted again, dealt by their own hash, so that a string of a
    third of all documents brings one row a part.
    """
    large = bodies.groupBy("key").count().filter(F.col("count") > GROUP).select(
        "key", F.ceil(F.col("count") / GROUP).cast("int").alias("cuts")
    )
    large = shared_table(large, "large")
    placed = bodies.join(large, "key", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    placed = placed.withColumns({"part": F.pmod("seg", "cuts").cast("int"), "base": F.lit(0)})
    first = shared_table(_sorted(placed, span, True), "sorted")
    found = first.filter("body is null").select("doc", "place", "seg", "mask")
    again = first.filter("body is not null").drop("mask")
    if large.isEmpty():
        return found
    again = again.withColumn("part", F.pmod(F.xxhash64("body"), 64 * F.col("cuts")).cast("int"))
    return found.union(_sorted(again, span, False).select("doc", "place", "seg", "mask"))


def repeated_strings(docs: DataFrame, key: str, text: str, span: int) -> DataFrame:
    """Marks ``(kind, doc, place, seg, mask, of)``: which strings of a segment also start in a document of a smaller key.

    1. Blocks of documents settle what repeats within them; one segment of each kind goes on.
    2. One shuffle by anchor settles equal segments of different blocks, and finds keys of different segments.
    3. Only those segments are fetched and compared, by suffix sorting.
    A mask of -1 is of a stretch that repeats as a whole; an ALIAS shares the fate of the segment at ``of``.
    """
    settled = shared_table(_settled(_blocks(docs, key, text, span)), "settled")
    bodies = _segment_bytes(docs, key, text, settled.filter(F.col("kind") == REPRESENTATIVE), span)
    bodies = shared_table(bodies, "bodies")
    masks = shared_table(_masks(bodies, span), "masks")
    drop_shared(bodies)
    whole = settled.filter(F.col("kind") > WITNESS).select(
        "kind", "doc", "place", "seg", F.lit(-1).cast("long").alias("mask"), F.col("key").alias("of")
    )
    return whole.union(masks.select(F.lit(REPEAT).cast("byte"), "doc", "place", "seg", "mask", F.lit(0).cast("long")))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = 50) -> DataFrame:
    """``docs``, every row, with ``kept`` (binary), the bytes left, and ``removed``, the byte spans that went.

    Every byte goes that lies in a ``span``-byte string which also starts in a document of a smaller key; strings are
    those of the UTF-8 texts as they came. Keys are whole numbers or strings. A null or empty text is empty and loses
    nothing. A row of a null key is left whole and takes nothing from others; rows of one key, repeated ones too, take
    nothing from each other, and all keep their rows. An empty table gives an empty table. Columns of the names of the
    two new ones, in any case, are replaced; others keep their values whatever they are called; the text is dropped.
    """
    kept = others(docs, text, "kept", "removed")
    body, owner, doc = fresh(docs, "body", "owner", "doc")
    parts = ("kind", "place", "seg", "mask", "of")
    listed = fresh(docs, *parts)
    marks = repeated_strings(docs, key, text, span)
    by_doc = marks.groupBy(F.col("doc").alias(doc)).agg(F.collect_list(F.struct(*parts)).alias("x"))
    by_doc = by_doc.select(doc, *[F.col(f"x.{p}").alias(n) for p, n in zip(parts, listed)])
    keyed = docs.select(*map(col, kept), col(text).alias(body), col(key).alias(owner))
    joined = keyed.join(by_doc, keyed[owner] == by_doc[doc], "left").select(*map(col, kept), body, *listed)

    def make():
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import xxhash

        digest = xxhash.xxh64_intdigest

        def one(raw: bytes, marks) -> tuple[bytes, list]:
            depth = np.zeros(len(raw) + 1, np.int32)
            fate: dict[tuple, int] = {}
            aliases = []
            for kind, place, seg, mask, of in marks:
                if kind == ALIAS:
                    aliases.append((place, seg, of))
                else:
                    fate[place, seg] = fate.get((place, seg), 0) | mask
            now = [(*at, mask) for at, mask in fate.items()]
            now += [(place, seg, fate.get((of, seg), 0)) for place, seg, of in aliases]
            for place, seg, mask in now:
                first, more = place >> 16, place & 0xFFFF
                if not mask or digest(raw[first : first + more + span]) != seg & (2**64 - 1):
                    continue  # no repeat, or of another row of the same key
                if mask == -1:
                    depth[first] += 1
                    depth[first + more + span] -= 1
                else:
                    for o in range(more + 1):
                        if mask >> o & 1:
                            depth[first + o] += 1
                            depth[first + o + span] -= 1
            gone = np.cumsum(depth[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            return left, [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]

        def run(*columns) -> dict:
            texts, lists = columns[len(kept)].to_pylist(), columns[len(kept) + 1 :]
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists[0]), 0).to_numpy(zero_copy_only=False)).tolist()
            rows = list(zip(*(x.flatten().to_numpy(zero_copy_only=False).tolist() for x in lists)))
            done, at = [], 0
            for t, end in zip(texts, ends):
                raw = t.encode() if t else b""
                done.append(one(raw, rows[at:end]) if end > at else (raw, []))
                at = end
            out = {"kept": pa.array([a for a, _ in done], pa.binary()), "removed": [b for _, b in done]}
            return dict(zip(kept, columns)) | out

        return run

    empty = F.from_json(F.lit("[]"), "array<struct<start:int,end:int>>")
    return map_rows(joined, make, joined.drop(body, *listed).withColumns({"kept": F.lit(b""), "removed": empty}).schema, lists=False)


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the 50-byte strings that a smaller ``doc_id`` has: sizes, and a digest of what is left.

    Null texts count as empty: no bytes, no spans, the digest of nothing. Repeated rows keep a row each.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = remove_repeats(docs)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
