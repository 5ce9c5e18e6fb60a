"""SimHash near-duplicates: fingerprints of word shingles, self-joined in binary tries.

Fingerprints within ``budget`` differing bits of each other agree wholly in some choice of their
blocks, so rows are dealt by such choices. In each bucket pairs of trie nodes are walked down together,
adding up the bits in which they differ; a pair goes as soon as it has more than ``budget``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.arrow import map_rows
from skyloom.llm.common import col, components, drop_shared, fresh, others, read_table, shared_table

#: Rows of a bucket beyond which it is dealt out as pairs of parts.
BUCKET = 1024
#: Node pairs, or leaf pairs, held at a time.
FRONTIER = 200_000
#: Shingles of a group of candidates beyond which it is dealt out as pairs of parts.
SHINGLES = 1_000_000


def shingle_hashes(text: str | None, size: int, seed: int = 42):
    """XXH64 of each run of ``size`` lower-cased words, repeats included; of all words if they are fewer."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-size] + 1]).tolist()
    return np.array([h(line[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64)


def bit_majority(hashes) -> int:
    """The 64-bit number whose bits are set in over half of ``hashes``; 0 for none."""
    import numpy as np

    n = len(hashes)
    if not n:
        return 0
    lanes = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(n, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 255):  # a lane of eight bits holds 255 at most
        counts += lanes[at : at + 255].sum(axis=0).view(np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def remix(hashes, k: int):
    """An independent hash of each hash; the same one for k = 0."""
    import numpy as np

    if not k:
        return hashes
    x = hashes + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3, words: int = 1, distinct: bool = False) -> DataFrame:
    """``docs`` without ``text``, with ``fp``: an array of ``words`` longs, 64 bits of fingerprint each.

    With ``distinct`` a repeated shingle weighs no more than others. A null text, like one without words, has
    fingerprint zero; repeated rows have theirs each. There is no shuffle. A column named ``fp``, in any case, is replaced.
    """
    kept = others(docs, text, "fp")
    (body,) = fresh(docs, "body")

    def make():
        import numpy as np

        def signed(x: int) -> int:
            return x - (1 << 64) if x >= 1 << 63 else x

        def run(*columns: list) -> dict[str, list]:
            made = []
            with np.errstate(over="ignore"):
                for t in columns[-1]:
                    hashes = shingle_hashes(t, size)
                    if distinct:
                        hashes = np.unique(hashes)
                    made.append([signed(bit_majority(remix(hashes, k))) for k in range(words)])
            return dict(zip(kept, columns)) | {"fp": made}

        return run

    source = docs.select(*map(col, kept), col(text).alias(body))
    return map_rows(source, make, source.drop(body).withColumn("fp", F.array(F.lit(0).cast("long"))).schema)


def _blocks(bits: int, budget: int, n: int) -> list[list[tuple[int, int]]]:
    """Choices of blocks (shift, width) of which one at least is equal in two linked fingerprints.

    As many blocks as keep the mean bucket of ``n`` fingerprints small; the more there are, the more bits
    a choice fixes, and the more choices there are.
    """
    for m in range(budget + 1, bits + 1):
        edges = [bits * i // m for i in range(m + 1)]
        blocks = [(a, b - a) for a, b in zip(edges, edges[1:])]
        choices = [list(c) for c in combinations(blocks, m - budget)]
        if n >> min(sum(w for _, w in c) for c in choices) <= BUCKET or m >= budget + 3:
            return choices
    return [[(0, bits)]]


def trie_pairs(fps, groups, bits: int, budget: int, chunk: int = FRONTIER) -> Iterator[tuple]:
    """Index arrays (i, j), i < j, of rows of a group whose fingerprints differ in ``budget`` bits at most.

    ``fps``: unsigned numbers sorted within each group; ``groups``: (start, end) of each group. A trie
    node is the range of rows that share its prefix. All pairs of nodes of a level are split at once;
    stretches of the frontier are walked depth first, so no more than some ``chunk`` pairs are held.
    """
    import numpy as np

    n = len(fps)
    ones = np.zeros((bits, n + 1), np.int32)
    for d in range(bits):
        np.cumsum((fps >> np.uint64(bits - 1 - d)) & np.uint64(1), out=ones[d, 1:])
    lo = np.array([a for a, b in groups if b - a > 1], np.int64)
    hi = np.array([b for a, b in groups if b - a > 1], np.int64)
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        d, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > chunk:
            for at in range(0, len(alo), chunk):
                stack.append((d, *(x[at : at + chunk] for x in (alo, ahi, blo, bhi, err))))
            continue
        few = ((ahi - alo) * (bhi - blo) <= 32) | (d >= bits)
        if few.any():
            yield from _leaves(fps, alo[few], ahi[few], blo[few], bhi[few], budget, chunk)
            alo, ahi, blo, bhi, err = (x[~few] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        amid, bmid = (h - (ones[d][h] - ones[d][lo_]) for lo_, h in ((alo, ahi), (blo, bhi)))
        own = alo == blo
        parts = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1)]
        parts.append(tuple(x[~own] for x in (amid, ahi, blo, bmid, err + 1)))
        a, b, c, e, r = (np.concatenate(x) for x in zip(*parts))
        live = (a < b) & (c < e) & (r <= budget) & ~((a == c) & (b - a == 1))
        stack.append((d + 1, a[live], b[live], c[live], e[live], r[live].astype(np.int8)))


def _leaves(fps, alo, ahi, blo, bhi, budget: int, chunk: int) -> Iterator[tuple]:
    """The pairs between the rows of node pairs, tested in full."""
    import numpy as np

    sizes = (ahi - alo) * (bhi - blo)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4 * chunk, "right")))
        size = sizes[at:to]
        own = np.repeat(np.arange(at, to), size)
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        wide = (bhi - blo)[own]
        i, j = alo[own] + k // wide, blo[own] + k % wide
        near = (i < j) & (np.bitwise_count(fps[i] ^ fps[j]) <= budget)
        if near.any():
            yield i[near], j[near]
        at = to


class Forest:
    """Union-find that keeps the pairs that joined two sets."""

    def __init__(self, n: int):
        import numpy as np

        self.parent = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def add(self, i, j) -> None:
        import numpy as np

        while True:  # roots of all, at once
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                break
            self.parent = up
        new = self.parent[i] != self.parent[j]
        for a, b in zip(i[new].tolist(), j[new].tolist()):
            ra, rb = self.find(a), self.find(b)
            if ra != rb:
                self.parent[max(ra, rb)] = min(ra, rb)
                self.links.append((a, b))


def trie_links(fps: DataFrame, bits: int = 64, budget: int = 3, table_bits: int | None = None, near: int | None = None) -> DataFrame:
    """Links ``(a, b)`` that span the components of fingerprints within ``budget`` bits, each link such a pair.

    ``fps``: distinct rows of ``id`` long and ``fp`` array<long>. By default the first 64 bits are compared.
    With ``table_bits`` (32 or 64) every stretch of so many bits of ``fp`` is a table of its own, two rows
    are candidates if within ``budget`` in any, and linked if the first ``NEAR_OF`` longs of ``fp`` differ in
    ``near`` bits at most.

    Rows are dealt by (table, choice of blocks, their value). A bucket of more than ``BUCKET`` rows, as of
    near copies, is cut into parts by hash, and each pair of parts is a task's work, so no task takes a
    whole hot bucket. A bucket gives at most one link a row fewer than it has.
    """
    bits = table_bits or bits
    n = fps.count()
    choices = _blocks(bits, budget, n)
    words = fps.select(F.size("fp").alias("n")).limit(1).collect()
    width = words[0]["n"] if words and table_bits else 1
    mask = (1 << bits) - 1
    tables = []
    for w in range(width):
        for s in range(0, 64, bits):
            value = F.get("fp", F.lit(w))
            tables.append((len(tables), F.shiftrightunsigned(value, s).bitwiseAND(F.lit(mask if bits < 64 else -1).cast("long"))))

    def field(value: Column, choice: list[tuple[int, int]]) -> Column:
        kept = sum(((1 << w) - 1) << s for s, w in choice)
        kept = kept - (1 << 64) if kept >= 1 << 63 else kept
        return value.bitwiseAND(F.lit(kept).cast("long"))

    spread = fps.select(
        "id", F.slice("fp", 1, NEAR_OF).alias("fp"),
        F.explode(
            F.array(*[
                F.struct(F.lit(t * len(choices) + c).alias("part"), field(value, choice).alias("key"), value.alias("x"))
                for t, value in tables for c, choice in enumerate(choices)
            ])
        ).alias("k"),
    ).select("id", "fp", "k.*")
    hot = shared_table(
        spread.groupBy("part", "key").count().filter(F.col("count") > BUCKET)
        .select("part", "key", F.ceil(F.col("count") / BUCKET).cast("int").alias("cuts")),
        "buckets",
    )
    own = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: j != F.col("own"))
    dealt = (
        spread.join(hot, ["part", "key"], "left").withColumn("own", own)
        .withColumn("other", F.explode_outer(others))
        .select(
            "id", "fp", "x", "part", "key",
            F.coalesce(F.least("own", "other"), F.lit(-1)).alias("i"),
            F.coalesce(F.greatest("own", "other"), F.lit(-1)).alias("j"),
        )
    )
    dealt = dealt.repartition("part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j", "x", "id")
    return dealt.mapInArrow(_linker(bits, budget, near), "a long, b long")


def _linker(bits: int, budget: int, near: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held = None
        for batch in _with_end(batches):
            if batch is not None:
                cols = _numbers(batch)
                held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
                ids, fp, x, keys = held
                if len(ids) < 50_000:
                    continue
                cut = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys != keys[-1]).any() else 0
                if not cut:
                    continue
                now, held = [c[:cut] for c in held], [c[cut:] for c in held]
            elif held is None:
                return
            else:
                now = held
            a, b = _bucket_links(*now, bits, budget, near)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _with_end(batches):
    yield from (b for b in batches if b.num_rows)
    yield None


def _numbers(batch: pa.RecordBatch) -> list:
    """ids, fp (rows x words), x, and the columns that tell buckets apart."""
    import numpy as np

    named = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    ids, x = (named[c].to_numpy(zero_copy_only=False) for c in ("id", "x"))
    fp = named["fp"].flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    keys = np.stack([named[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "key", "i", "j")], axis=1)
    return [ids, fp.view(np.uint64), x.view(np.uint64), keys]


def _bucket_links(ids, fp, x, keys, bits: int, budget: int, near: int | None):
    """Links within each bucket of rows sorted by bucket and ``x``."""
    import numpy as np

    change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    edges = np.concatenate([[0], change, [len(ids)]])
    order = np.arange(len(ids))
    for a, b in zip(edges, edges[1:]):  # as signed numbers x is not in the order of its bits
        if b - a > 1 and x[a] > x[a + 1 : b].min(initial=x[a]):
            order[a:b] = a + np.argsort(x[a:b], kind="stable")
    ids, fp, x = ids[order], fp[order], x[order]
    forest = Forest(len(ids))
    for i, j in trie_pairs(x, list(zip(edges.tolist(), edges[1:].tolist())), bits, budget):
        if near is not None:
            close = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1) <= near
            i, j = i[close], j[close]
        forest.add(i, j)
    if not forest.links:
        return [], []
    a, b = np.array(forest.links).T
    return ids[a], ids[b]


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, budget: int = 3) -> DataFrame:
    """One row a document: ``key``, ``fp`` (long) and ``component_id``, the smallest key it is linked to.

    Equal fingerprints are one trie leaf, whatever the number of their documents, so groups of copies
    are never paired. Null and empty texts share fingerprint zero. Repeated keys keep their rows; null keys
    keep theirs too, with the component of their fingerprint, null if it has no other key.
    """
    marks = shared_table(
        fingerprints(docs.select(col(key).alias("_key"), col(text).alias("_text")), "_text", size)
        .select("_key", F.get("fp", F.lit(0)).alias("fp")),
        "marks",
    )
    least = shared_table(marks.groupBy("fp").agg(F.min("_key").alias("least")), "distinct")
    links = trie_links(least.select(F.col("fp").alias("id"), F.array("fp").alias("fp")), 64, budget)
    found = components(links)
    roots = found.join(least.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(F.min("least").alias("component_id"))
    mapped = found.join(roots, "root").select(F.col("node").alias("fp"), "component_id")
    named = shared_table(
        least.join(mapped, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "named"
    )
    return marks.join(named, "fp").select(F.col("_key").alias(key), "fp", "component_id")


#: Longs of a fingerprint, two tables of 32 bits each. Texts that share 0.8 of their shingles are within three bits in
#: one table with a chance of 0.26, and so in one of 18 with 0.996.
NEAR_WORDS = 9
#: They differ in 38.8 of the first 256 bits in the mean, with a deviation of 5.7; this is four deviations above.
NEAR_BITS, NEAR_OF = 62, 4


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` of which no near copy with a smaller ``key`` stays: one document of each group.

    Equal texts are one node. Different texts are candidates if any of 18 32-bit fingerprints of their distinct
    ``size``-word shingles are within three bits, by the trie join, and the first 256 bits within ``NEAR_BITS``;
    they are linked if their sets of shingles share ``similarity`` of their union, which is tested in full
    before anything is joined. Of each component the row of the smallest key stays; a null key comes after all
    others. Of repeated rows one stays. Null and empty texts are texts like others, equal among themselves, null apart
    from empty. Texts without a shingle are linked to equal ones only. An empty table gives an empty table; all columns
    keep their values whatever they are called.
    """
    digest = F.coalesce(F.sha2(col(text), 256), F.lit("null"))
    slim = docs.select(col(key).alias("_key"), digest.alias("_digest"), col(text).alias("_text"))
    marks = shared_table(fingerprints(slim, "_text", size, NEAR_WORDS, True), "marks")
    texts = shared_table(
        marks.groupBy("_digest").agg(F.min("_key").alias("_key"), F.first("fp").alias("fp"))
        .withColumn("id", F.monotonically_increasing_id()),
        "texts",
    )
    nodes = texts.filter(F.exists("fp", lambda x: x != 0)).select("id", "fp")
    links = shared_table(trie_links(nodes, budget=3, table_bits=32, near=NEAR_BITS).distinct(), "candidates")
    ends = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    wanted = shared_table(texts.join(ends, "id").select("id", "_key", "_digest"), "wanted")
    same = F.col("d._key").eqNullSafe(F.col("w._key")) & (F.col("d._digest") == F.col("w._digest"))
    bodies = slim.alias("d").join(wanted.alias("w"), same).select("id", F.col("d._text").alias("_text"))
    sets = shared_table(_shingle_sets(bodies, size).dropDuplicates(["id"]), "shingles")
    true = shared_table(true_links(links, sets, similarity), "links")
    groups = components(true)
    order = F.struct(F.col("_key").isNull(), "_key", "_digest")
    first = (
        groups.join(texts, groups["node"] == texts["id"]).groupBy("root")
        .agg(F.min(order).alias("o")).select(F.col("root"), F.col("o._digest").alias("_first"))
    )
    gone = groups.join(first, "root").join(texts, F.col("node") == F.col("id")).filter(F.col("_digest") != F.col("_first"))
    stays = shared_table(texts.join(gone.select("_digest"), "_digest", "left_anti").select("_key", "_digest"), "stays")
    drop_shared(marks, texts, links, wanted, sets, true)
    own, owner, of, least = fresh(docs, "digest", "owner", "of", "least")
    named = docs.withColumns({own: digest, owner: col(key)})
    kept = named.join(
        stays.withColumnsRenamed({"_digest": of, "_key": least}),
        (F.col(own) == F.col(of)) & F.col(owner).eqNullSafe(F.col(least)),
        "left_semi",
    )
    return kept.dropDuplicates([owner, own]).select(*map(col, docs.columns))


def true_links(candidates: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` that span the components of ``sets`` (``id``, ``set``) that share ``similarity`` of their union.

    A true link lies within a component of ``candidates``, though candidates that span it need not be true. So
    all pairs within each of their components are tested, but for those already joined by true links. A big
    component is cut into parts by hash, and each pair of parts is a task's work.
    """
    groups = components(candidates)
    members = shared_table(
        sets.join(groups, sets["id"] == groups["node"]).select("id", "root", "set"), "members"
    )
    cuts = F.ceil(F.greatest(F.count(F.lit(1)) / BUCKET, F.sum(F.size("set")) / SHINGLES)).cast("int")
    hot = shared_table(members.groupBy("root").agg(cuts.alias("cuts")).filter("cuts > 1"), "groups")
    own = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: j != F.col("own"))
    dealt = (
        members.join(hot, "root", "left").withColumn("own", own)
        .withColumn("other", F.explode_outer(others))
        .select(
            "id", "set", "root",
            F.coalesce(F.least("own", "other"), F.lit(-1)).alias("i"),
            F.coalesce(F.greatest("own", "other"), F.lit(-1)).alias("j"),
        )
    )
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held, key = [], None

        def found() -> pa.RecordBatch:
            ids = [x for x, _ in held]
            a = verified_links([x for _, x in held], similarity)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i, _ in a], pa.int64()), pa.array([ids[j] for _, j in a], pa.int64())], names=["a", "b"]
            )

        for batch in batches:
            named = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            flat, ends = named["set"].flatten().to_numpy(), named["set"].offsets.to_numpy()
            ends = (ends - ends[0]).tolist()
            for k, (x, *new) in enumerate(zip(*(named[c].to_pylist() for c in ("id", "root", "i", "j")))):
                if new != key:
                    if len(held) > 1:
                        yield found()
                    held, key = [], new
                held.append((x, np.array(flat[ends[k] : ends[k + 1]])))
        if len(held) > 1:
            yield found()

    return dealt.mapInArrow(run, "a long, b long")


def verified_links(sets: list, similarity: float) -> list[tuple[int, int]]:
    """Pairs of ``sets``, sorted arrays, that span the components of those sharing ``similarity`` of their union."""
    import numpy as np

    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    label, links = np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        j = j[np.minimum(sizes[j], sizes[i]) >= similarity * np.maximum(sizes[j], sizes[i]) - 1e-9]
        if not len(j):
            continue
        line = np.concatenate([sets[k] for k in j.tolist()])
        at = np.minimum(np.searchsorted(sets[i], line), sizes[i] - 1)
        seen = np.concatenate([[0], np.cumsum(sets[i][at] == line)])
        ends = np.concatenate([[0], np.cumsum(sizes[j])])
        shared = seen[ends[1:]] - seen[ends[:-1]]
        for k in j[shared >= similarity * (sizes[j] + sizes[i] - shared) - 1e-9].tolist():
            if label[k] != label[i]:
                label[label == label[k]] = label[i]
                links.append((i, k))
    return links


def _shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """``id`` and ``set``: the distinct shingle hashes of ``_text``."""

    def make():
        import numpy as np

        def run(ids: list, texts: list) -> dict[str, list]:
            return {"id": ids, "set": [np.unique(shingle_hashes(t, size).view(np.int64)).tolist() for t in texts]}

        return run

    return map_rows(docs.select("id", "_text"), make, "id long, set array<bigint>")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null and empty texts share fingerprint zero."""
    found = near_components(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
