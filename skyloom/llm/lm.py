"""LM scoring: Brown class-based bigrams, classes by exchange clustering.

Every training word has a class, chosen by the likelihood of class bigrams from the words that it stands next to. A
text's score is the sum over its tokens of log10 P(class | class before) + log10 P(word | class).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from itertools import repeat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.arrow import map_rows, whole_keys
from skyloom.llm.common import col, drop_shared, fresh, others, read_table, shared_table

#: The end of a text; no word holds a line feed.
END = b"\n"
#: Words that are exchanged with each other until none moves, classes, and words that are sent to the tasks.
OWN_UNITS, CLASSES, SENT_WORDS = 1024, 64, 100_000
#: Groups of endings, by which words that training has not seen get a class.
ENDINGS = 255
#: Weight of the class's share of all tokens in its smoothed chance after another class.
PRIOR = 50.0
#: Neighbours that a task counts before it sends anything on.
EVENTS = 3_000_000
#: Words without a number that a task names before it sends anything on.
NAMES = 300_000
#: Cells of words that are summed at a time, at the utmost.
CELLS = 4_000_000


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, and one end."""
    return [*(text or "").encode().lower().split(), END]


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def word_counts(docs: DataFrame, text: str, spill: int = 300_000) -> DataFrame:
    """``word`` (binary) and its count ``c`` over all rows; tasks count before anything is shuffled."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        seen: Counter = Counter()

        def flush():
            words = pa.array(list(seen.keys()), pa.binary())
            out = pa.RecordBatch.from_arrays([words, pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                seen.update(tokens(t.as_py()))
                if len(seen) >= spill:
                    yield flush()
        if seen:
            yield flush()

    found = docs.select(col(text).alias("text")).mapInArrow(run, "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").alias("c"))


def frequent(docs: DataFrame, text: str, sent_words: int) -> tuple[dict[bytes, int], int, int]:
    """Counts of the end and the ``sent_words`` most frequent words at most, in this order; tokens and distinct ones of all rows.

    The words are those of at least the count that fits. To the driver come they and the histogram of counts.
    """
    vocabulary = shared_table(word_counts(docs, text), "vocabulary")
    histogram = sorted(((r["c"], r["count"]) for r in vocabulary.groupBy("c").count().collect()), reverse=True)
    least, room = float("inf"), sent_words
    for c, k in histogram:
        if k > room:
            break
        least, room = c, room - k
    sent = {bytes(r["word"]): r["c"] for r in vocabulary.filter((F.col("c") >= least) | (F.col("word") == F.lit(END))).collect()}
    drop_shared(vocabulary)
    count = {END: sent.pop(END, 0)} | dict(sorted(sent.items(), key=lambda x: (-x[1], x[0])))
    return count, sum(c * k for c, k in histogram), sum(k for _, k in histogram)


def encode(docs: DataFrame, text: str, known: list[bytes], ids: str = "ids", rare: str = "rare") -> DataFrame:
    """``docs`` with the tokens of ``text`` as numbers in its place: ``ids`` are places in ``known``, or -1 - a place in ``rare``.

    ``rare`` are the words of the row that are not known, each once. Texts are split once here, and numbers read after that.
    """
    kept = others(docs, text, ids, rare)
    source = docs.select(*map(col, kept), col(text).alias(fresh(docs, "text")[0]))
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def make():
        import numpy as np
        import pyarrow as pa

        index = {w: i for i, w in enumerate(sent.value)}

        def run(*columns: list) -> dict:
            words, ends, names, rare_ends = [], [0], [], [0]
            for t in columns[-1]:
                words += tokens(t)
                ends.append(len(words))
            at = np.fromiter(map(index.get, words, repeat(-1)), np.int32, len(words))
            unknown = np.flatnonzero(at < 0)
            owner = np.searchsorted(ends, unknown, "right") - 1
            stops, numbers = np.searchsorted(owner, np.arange(len(ends)), "left"), []
            for i in range(len(ends) - 1):
                own: dict[bytes, int] = {}
                for j in unknown[stops[i] : stops[i + 1]].tolist():
                    numbers.append(-1 - own.setdefault(words[j], len(own)))
                names += own
                rare_ends.append(len(names))
            at[unknown] = numbers
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at)), pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), pa.array(names, pa.binary()))
            return dict(zip(kept, columns)) | {ids: lists[0], rare: lists[1]}

        return run

    shape = source.select(*map(col, kept)).withColumns({ids: F.array(F.lit(0)), rare: F.array(F.lit(b""))}).schema
    return map_rows(source, make, shape, 128)


class _Numbers(dict):
    """Numbers of words from ``first`` on; a new word gets the next one, and its name goes to ``names``."""

    def __init__(self, first: int):
        super().__init__()
        self.first, self.names = first, []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.first + len(self.names)
        self.names.append(word)
        return n


_CONTEXTS = "word binary, other binary, cells array<int>, counts array<long>"


def contexts(lines: DataFrame, known: list[bytes], labels, size: int, rest: bool) -> DataFrame:
    """What the words of ``lines`` (ids, rare) stand next to. ``labels`` give known words a number below ``size``, or -1.

    Rows word, cells, counts: cell x counts the neighbours before the word that are labelled x, cell size + x those
    after it, cell 2 * size the word itself. A task gives the known words, or with ``rest`` all others. With
    ``rest`` there are rows word, other and one count, of pairs of words that are both without a label, and rows of
    neither, a label in ``cells`` and how often each label comes after it. The neighbour before a text is another's end.
    """
    sent = lines.sparkSession.sparkContext.broadcast((known, labels))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known, own = sent.value
        wide, n_known = 2 * size + 1, len(known)
        own = np.append(own, -1)
        table = np.zeros(size * size, np.int64)
        numbers, events, pairs, held = _Numbers(n_known), [], [], 0

        def named(at):
            return [known[i] if i < n_known else numbers.names[i - n_known] for i in at.tolist()]

        def listed(key, base, values, type_):
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
            offsets = pa.array(np.append(at, len(key)).astype(np.int32))
            return at, [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in zip(values, type_)]

        def counted(parts):
            key = np.concatenate(parts)
            parts.clear()
            key.sort()
            at = np.flatnonzero(np.concatenate([key[:1] == key[:1], key[1:] != key[:-1]]))
            return key[at], np.diff(np.append(at, len(key)))

        def flush():
            if events:
                key, n = counted(events)
                word = key // wide
                at, lists = listed(word, wide, ((key % wide).astype(np.int32), n), (pa.int32(), pa.int64()))
                names = pa.array(named(word[at]), pa.binary())
                yield pa.RecordBatch.from_arrays([names, pa.nulls(len(at), pa.binary()), *lists], names=["word", "other", "cells", "counts"])
            if pairs:
                key, n = counted(pairs)
                first, second = map(named, (key >> 32, key & 0xFFFFFFFF))
                counts = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32)), pa.array(n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first, pa.binary()), pa.array(second, pa.binary()), pa.nulls(len(n), pa.list_(pa.int32())), counts],
                    names=["word", "other", "cells", "counts"],
                )

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                line = np.append(0, part.column(0).flatten().to_numpy()).astype(np.int64)  # every text ends with an end, which the next one follows
                rare = line < 0
                if rest and rare.any():
                    sizes = part.column(0).value_lengths().to_numpy()
                    firsts = np.append(0, np.cumsum(part.column(1).value_lengths().to_numpy()))[:-1]
                    global_ = np.fromiter(map(numbers.__getitem__, part.column(1).flatten().to_pylist()), np.int64)
                    line[rare] = global_[np.repeat(firsts, sizes)[rare[1:]] - 1 - line[rare]]
                else:
                    line[rare] = n_known
                label = own[np.minimum(line, n_known)]
                asked = (line >= n_known) == rest
                a, b = slice(None, -1), slice(1, None)
                left, right = asked[b] & (label[a] >= 0), asked[a] & (label[b] >= 0)
                events += [line[b][left] * wide + label[a][left], line[a][right] * wide + size + label[b][right]]
                held += len(events[-1]) + len(events[-2])
                if rest:
                    events.append(line[b][asked[b]] * wide + 2 * size)
                    both = (label[a] >= 0) & (label[b] >= 0)
                    table += np.bincount(label[a][both] * size + label[b][both], minlength=size * size)
                    neither = (label[a] < 0) & (label[b] < 0)
                    pairs.append(line[a][neither] << 32 | line[b][neither])
                    held += len(events[-1]) + len(pairs[-1])
                if held >= EVENTS or len(numbers.names) >= NAMES:
                    yield from flush()
                    numbers, events, pairs, held = _Numbers(n_known), [], [], 0
        yield from flush()
        if rest:
            used = table.reshape(size, size)
            own = np.flatnonzero(used.any(axis=1))
            one = pa.array(np.arange(len(own) + 1, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(len(own), pa.binary()), pa.nulls(len(own), pa.binary()), pa.ListArray.from_arrays(one, pa.array(own.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * size), pa.array(used[own].ravel())),
                ],
                names=["word", "other", "cells", "counts"],
            )

    return lines.select("ids", "rare").mapInArrow(run, _CONTEXTS)


def _by_word(found: DataFrame, wide: int, make: Callable, schema: str) -> DataFrame:
    """``make()``, once a task, over words (Arrow) and their summed cells: (words, at, cell, n), each word in one call.

    ``at`` are ascending places in words. Its result, and that of a call with None at the end, are batches or None.
    A task has sent a word once for each ``EVENTS`` neighbours, so a frequent one does not bring all of its tokens.
    """

    def run(batches):
        import numpy as np
        import pyarrow.compute as pc

        f = make()
        for t in whole_keys(batches, ["word"], max(500, min(20_000, CELLS // wide))):
            t = t.combine_chunks()
            word, cells, counts = (t.column(c).chunk(0) for c in ("word", "cells", "counts"))
            coded = word.dictionary_encode()
            sizes = pc.list_value_length(cells).to_numpy(zero_copy_only=False)
            key = np.repeat(coded.indices.to_numpy().astype(np.int64), sizes) * wide + cells.flatten().to_numpy()
            order = np.argsort(key, kind="stable")
            key, n = key[order], counts.flatten().to_numpy()[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            out = f(coded.dictionary, key[at] // wide, key[at] % wide, np.add.reduceat(n, at))
            if out is not None:
                yield out
        out = f(None, None, None, None)
        if out is not None:
            yield out

    words = found.filter("cells is not null and word is not null").select("word", "cells", "counts")
    return words.repartition("word").sortWithinPartitions("word").mapInArrow(run, schema)


def exchange(counts, classes: int, fixed: int = 1, rounds: int = 50, share: float = 1e-5, gains: list | None = None):
    """Class of each unit: units move to the class that raises the likelihood of class bigrams most.

    ``counts`` is the square table of unit bigrams. The first ``fixed`` units keep a class of their own. Units
    start in classes by rank of their frequency. A move is judged exactly: sum of f(class bigrams) less that of
    both marginals, f(x) = x log x, so the likelihood never falls. Rounds end when none moves or a round gains less than ``share``
    of the tokens' sum of logarithms; ``gains`` gets what each has gained. There is a free class even without units for it.
    """
    import numpy as np

    n = len(counts)
    free = max(1, min(classes - fixed, n - fixed))
    weight = counts.sum(axis=0) + counts.sum(axis=1)
    order = fixed + np.argsort(-weight[fixed:], kind="stable")
    of = np.zeros(n, np.int64)
    of[:fixed] = np.arange(fixed)
    of[order] = fixed + np.arange(n - fixed) % free
    size = fixed + free
    member = np.zeros((n, size))
    member[np.arange(n), of] = 1
    table = member.T @ counts @ member

    def f(x):
        return x * np.log(np.maximum(x, 1.0))

    own = np.diag(counts)
    whole = max(float(f(counts.sum())), 1.0)
    for _ in range(rounds):
        moved, gained = 0, 0.0
        to = counts @ member  # counts of each unit before each class
        by = counts.T @ member
        for u in order.tolist():
            a, s = of[u], own[u]
            right, left = to[u].copy(), by[u].copy()
            right[a] -= s
            left[a] -= s
            table[a, :] -= right
            table[:, a] -= left
            table[a, a] -= s
            base = f(table)
            rows = f(table + right[None, :]) - base
            cols = f(table + left[:, None]) - base
            diagonal = np.diag(table)
            gain = rows.sum(axis=1) - np.diag(rows) + cols.sum(axis=0) - np.diag(cols) + f(diagonal + right + left + s) - f(diagonal)
            # sums of a class without what the unit brings: but as a neighbour it stays in the sums of the others
            first, second = table.sum(axis=1) + left, table.sum(axis=0) + right
            gain -= f(first + right.sum() + s) - f(first) + f(second + left.sum() + s) - f(second)
            gain[:fixed] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b, :] += right
            table[:, b] += left
            table[b, b] += s
            if b != a:
                gained += float(gain[b] - gain[a])
                of[u] = b
                member[u, a], member[u, b] = 0, 1
                to[:, a] -= counts[:, u]
                to[:, b] += counts[:, u]
                by[:, a] -= counts[u, :]
                by[:, b] += counts[u, :]
                moved += 1
        if gains is not None:
            gains.append(gained)
        if not moved or gained < share * whole:
            break
    return of, size


def best_classes(at, cell, n, words: int, table, fixed: int = 1):
    """The class of each of ``words`` new words that raises the likelihood of class bigrams ``table`` most, as a move does.

    ``at``, ascending, are words, ``cell`` the class before (0 .. k - 1) or after (k .. 2k - 1) it, ``n`` how often.
    A word without neighbours goes to the class of the most tokens.
    """
    import numpy as np

    k = len(table)

    def f(x):
        return x * np.log(np.maximum(x, 1.0))

    def added(counts, side):
        """For each count, what a class's sum of that side loses to it."""
        seen, back = np.unique(counts, return_inverse=True)
        total = table.sum(axis=side)
        return (f(total[None, :] + seen[:, None]) - f(total)[None, :])[back]

    gain = 1e-9 * np.tile(table.sum(axis=0) / max(table.sum(), 1.0), (words, 1))
    if len(at):
        key, back = np.unique(n * (2 * k) + cell, return_inverse=True)
        x, c = (key // (2 * k)).astype(float)[:, None], key % (2 * k)
        lines = np.concatenate([table, table.T])[c]
        step = f(lines + x) - f(lines)
        for i in range(0, len(at), 100_000):  # words may be cut: their parts are added up
            part = step[back[i : i + 100_000]]
            mine = at[i : i + 100_000]
            starts = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            gain[mine[starts]] += np.add.reduceat(part, starts, axis=0)
    before = np.bincount(at[cell < k], n[cell < k], words)
    after = np.bincount(at[cell >= k], n[cell >= k], words)
    gain -= added(before, 0) + added(after, 1)
    # a word that comes next to the class it moves to raises a sum from both sides
    own, mine = cell < k, cell >= k
    second, first, diagonal = table.sum(axis=0), table.sum(axis=1), np.diag(table)
    for side, sums, other, classes in ((own, first, after, cell), (mine, second, before, cell - k)):
        w, c, x = at[side], classes[side], n[side].astype(float)
        m, s = other[w], sums[c]
        gain[w, c] += f(s + m) - f(s) - f(s + x + m) + f(s + x)
    place = np.unique(at[own] * k + cell[own]), np.unique(at[mine] * k + cell[mine] - k)
    both, i, j = np.intersect1d(*place, assume_unique=True, return_indices=True)
    if len(both):
        order = [np.argsort(at[x] * k + c, kind="stable") for x, c in ((own, cell[own]), (mine, cell[mine] - k))]
        x, y = n[own][order[0]][i].astype(float), n[mine][order[1]][j].astype(float)
        d = diagonal[both % k]
        gain[both // k, both % k] += f(d + x + y) - f(d + x) - f(d + y) + f(d)
    gain[:, :fixed] = -np.inf
    return np.argmax(gain, axis=1)


@dataclass(frozen=True)
class ClassModel:
    """What scoring needs: the most frequent words here, all others in a table.

    ``words``: log10(count + 1) and class; ``rest``: word, c, class of the others; ``endings``: class of words not seen,
    by their ending; ``transition``: log10 P(class | class before); ``emission``: log10 of each class's tokens, types
    and one for a word not seen.
    """

    rest: DataFrame
    n_tokens: int
    n_types: int
    words: dict[bytes, tuple[float, int]]
    endings: list[int]
    transition: list[list[float]]
    emission: list[float]


def train(docs: DataFrame, text: str = "text", classes: int = CLASSES, own_units: int = OWN_UNITS, sent_words: int = SENT_WORDS) -> ClassModel:
    """Learn counts, classes and transitions from all rows of ``docs``.

    1. The ``own_units`` most frequent words are exchanged with each other, by their bigrams over all rows.
    2. Each other of the ``sent_words`` most frequent words moves to its best class by its neighbours among those.
       Those that stand next to none of 1 take the class that most words of their ending have.
    3. Each other word of the corpus moves to its best class by its neighbours among the words of 1 and 2.
    4. Transitions and emissions are counts of the classes of all tokens, whatever their words.
    Steps 2 to 4 are jobs over tables that grow with the corpus. To the driver come the histogram of word counts, at
    most ``sent_words`` words (those of at least the count that fits), the bigrams of ``own_units`` words, and sums by
    class. Null and empty texts are an end alone; repeated rows count as often as they come; an empty table gives a
    model that knows no word.
    """
    found = frequent(docs, text, sent_words)
    lines = shared_table(encode(docs.select(col(text).alias("text")), "text", list(found[0])), "lines")
    model = fit(lines, found, classes, own_units)
    drop_shared(lines)
    return model


def fit(lines: DataFrame, found: tuple[dict[bytes, int], int, int], classes: int = CLASSES, own_units: int = OWN_UNITS) -> ClassModel:
    """Steps 1 to 4 of ``train`` over encoded ``lines`` (ids, rare), with what ``frequent`` has found."""
    import numpy as np

    spark = lines.sparkSession
    count, total, types = found
    known = list(count)
    units = {w: i if i <= own_units else -1 for i, w in enumerate(count)}
    size = min(own_units + 1, len(units))

    labels = spark.sparkContext.broadcast(units)

    def summed():
        import pyarrow as pa

        own = labels.value

        def f(words, at, cell, n):
            if words is None:
                return None
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            offsets = pa.array(np.append(starts, len(at)).astype(np.int32))
            names = words.take(pa.array(at[starts]))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([own[w] for w in names.to_pylist()], pa.int32()), names,
                    pa.ListArray.from_arrays(offsets, pa.array(cell.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(n)),
                ],
                names=["unit", "word", "cells", "counts"],
            )

        return f

    near = contexts(lines, known, np.fromiter(units.values(), np.int64, len(units)), size, False)
    near = shared_table(_by_word(near, 2 * size + 1, summed, "unit int, word binary, cells array<int>, counts array<long>"), "contexts")
    counts = np.zeros((size, size))
    for r in near.filter("unit >= 0").select("unit", "cells", "counts").collect():
        cells = np.array(r["cells"])
        counts[r["unit"], cells[cells >= size] - size] = np.array(r["counts"])[cells >= size]
    of, k = exchange(counts, classes)
    member = np.eye(k)[of]
    table = member.T @ counts @ member

    unit_class = of.tolist()
    second = _moved(near.filter("unit < 0"), 2 * size + 1, lambda: np.array([*unit_class, *(k + c for c in unit_class), 0]), table)
    label = {w: int(of[i]) for w, i in units.items() if i >= 0}
    label |= {bytes(r["word"]): r["class"] for r in second.filter("word is not null").select("word", "class").collect()}
    # next to rarer words alone: the class that most words of this ending have
    votes: dict[bytes, Counter] = {}
    for w, c in label.items():
        if c:
            votes.setdefault(w[-3:], Counter())[c] += 1
            votes.setdefault(b"", Counter())[c] += 1
    most = {e: min(v, key=lambda c: (-v[c], c)) for e, v in votes.items()}
    label = {w: label[w] if w in label else most.get(w[-3:], most.get(b"", k - 1)) for w in units}

    far = shared_table(contexts(lines, known, np.fromiter(label.values(), np.int64, len(label)), k, True), "contexts")
    drop_shared(near)
    moved = shared_table(_moved(far, 2 * k + 1, lambda: np.arange(2 * k + 1), table), "classes")
    rest = moved.filter("word is not null").select("word", "c", "class")
    pairs = far.filter("other is not null").groupBy("word", "other").agg(F.sum(F.get("counts", F.lit(0))).alias("n"))
    first, other = (rest.select(F.col("word").alias(w), F.col("class").alias(c)) for w, c in (("word", "a"), ("other", "b")))
    pairs = pairs.join(first, "word").join(other, "other").groupBy("a", "b").agg(F.sum("n").alias("n"))
    parts = far.filter("word is null").select(F.get("cells", F.lit(0)).alias("a"), "counts")
    parts = parts.union(moved.filter("word is null").select(F.col("class").alias("a"), F.col("table").alias("counts")))
    table = np.zeros((k, k))
    for r in parts.groupBy("a").agg(F.array(*[F.sum(F.get("counts", F.lit(i))) for i in range(k)]).alias("n")).collect():
        table[r["a"]] += r["n"]
    for r in pairs.collect():
        table[r["a"], r["b"]] += r["n"]
    drop_shared(far)
    share = (table.sum(axis=0) + 1) / (table.sum() + k)
    transition = np.log10((table + PRIOR * share[None, :]) / (table.sum(axis=1, keepdims=True) + PRIOR))
    sums = np.zeros(k)
    for w, c in label.items():
        sums[c] += count[w] + (count[w] > 0)
    for r in rest.groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        sums[r["class"]] += r["c"] + r["n"]
    emission = np.log10(sums + 1)
    words = {w: (float(np.log10(count[w] + 1)), c) for w, c in label.items()}
    return ClassModel(rest, total, types, words, _endings(rest, k), transition.tolist(), emission.tolist())


def _moved(found: DataFrame, wide: int, classes: Callable, table) -> DataFrame:
    """Rows word, c, class of ``found`` words by ``best_classes``, and rows class, table of the bigrams with them.

    ``classes()`` gives the cell of class bigrams that each cell of ``found`` counts in; c is the count of the last one.
    """

    def make():
        import numpy as np
        import pyarrow as pa

        to, k, sums = classes(), len(table), np.zeros(table.size, np.int64)

        def f(words, at, cell, n):
            if words is None:
                used = sums.reshape(k, k)
                own = np.flatnonzero(used.any(axis=1))
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * k), pa.array(used[own].ravel()))
                none = pa.nulls(len(own), pa.binary()), pa.nulls(len(own), pa.int64())
                return pa.RecordBatch.from_arrays([*none, pa.array(own.astype(np.int32)), made], names=["word", "c", "class", "table"])
            own = cell == wide - 1
            c = np.bincount(at[own], n[own], len(words)).astype(np.int64)
            at, key = at[~own], at[~own] * (2 * k) + to[cell[~own]]
            order = np.argsort(key, kind="stable")
            at, cell, n = at[order], key[order] % (2 * k), n[~own][order]
            best = best_classes(at, cell, n, len(words), table)
            before = cell < k
            place = np.where(before, cell * k + best[at], best[at] * k + cell - k)
            sums[:] += np.bincount(place, n, len(sums)).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [words.cast(pa.binary()), pa.array(c), pa.array(best.astype(np.int32)), pa.nulls(len(words), pa.list_(pa.int64()))],
                names=["word", "c", "class", "table"],
            )

        return f

    return _by_word(found, wide, make, "word binary, c long, class int, table array<long>")


def _endings(rest: DataFrame, k: int) -> list[int]:
    """The class that most words seen once have, for each group of endings; that of all endings where one has none."""
    once = rest.filter("c = 1").select(
        F.pmod(F.crc32(F.expr("substring(word, greatest(octet_length(word) - 2, 1), 3)")), F.lit(ENDINGS)).cast("int").alias("e"), "class"
    )
    found = once.groupBy("e", "class").count().collect()
    votes = [[0] * k for _ in range(ENDINGS + 1)]
    for r in found:
        votes[r["e"]][r["class"]] += r["count"]
        votes[ENDINGS][r["class"]] += r["count"]
    pick = [max(range(1, k), key=lambda c, v=v: (v[c], -c)) if any(v) else None for v in votes]
    return [p if p is not None else pick[ENDINGS] or 1 for p in pick[:ENDINGS]]


def score(docs: DataFrame, model: ClassModel, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with n_tokens, n_known, base_score and score.

    Tasks know the frequent words. The others, once for each text that holds them, are joined with the model's table;
    what a text's score lacks, counts and transitions to and from such words, is added from what was found. A null or
    empty text is an end alone. Repeated rows are scored each. An empty table gives an empty one. Columns of the names
    of the four new ones, in any case, are replaced; others keep their values whatever they are called.
    """
    new = ("n_tokens", "n_known", "base_score", "score")
    ids, rare = fresh(docs, "ids", "rare")
    return score_lines(encode(docs.select(*map(col, others(docs, *new))), text, list(model.words), ids, rare), model, ids, rare)


def score_lines(lines: DataFrame, model: ClassModel, ids: str = "ids", rare: str = "rare") -> DataFrame:
    """``score`` of texts that ``encode`` has split by the words of ``model``; the columns ``ids`` and ``rare`` go."""
    import numpy as np

    new = ("n_tokens", "n_known", "base_score", "score")
    kept = others(lines, ids, rare, *new)
    logged, by_class, guess, times, pairs, row = fresh(lines, "log", "class", "guess", "times", "pairs", "row")
    places, counts, classes_, names = fresh(lines, "places", "counts", "classes", "names")
    sent = lines.sparkSession.sparkContext.broadcast((model.words, model.endings, model.transition, model.emission))

    def make():
        import pyarrow as pa

        words, endings, transition, emission = sent.value
        logs = np.array([x for x, _ in words.values()] + [0.0])
        classes = np.array([c for _, c in words.values()] + [0], np.int64)
        transition, emission, n_words = np.array(transition), np.array(emission), len(words)

        def lists(sizes, values, type_):
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, type_))

        def run(*columns) -> dict:
            numbers, unknown = columns[-2], columns[-1]
            n, line = len(numbers), numbers.flatten().to_numpy().astype(np.int64)
            sizes, rares = numbers.value_lengths().to_numpy(), unknown.value_lengths().to_numpy()
            owner, first = np.repeat(np.arange(n), sizes), np.cumsum(sizes) - sizes
            gone = line < 0
            at = np.where(gone, n_words, line)
            of = np.where(gone, line, classes[at])
            before = np.append(0, of[:-1])
            before[first] = 0  # the end of a text has class 0
            sure = (before >= 0) & (of >= 0)
            value = np.bincount(owner[sure], transition[before[sure], of[sure]], n) - np.bincount(owner[~gone], emission[of[~gone]], n)
            log, n_known = np.bincount(owner, logs[at], n), np.bincount(owner, logs[at] > 0, n).astype(np.int64)
            often = np.bincount((np.cumsum(rares) - rares)[owner[gone]] - 1 - line[gone], minlength=int(rares.sum())).astype(np.int64)
            guesses = [endings[ending(w)] for w in unknown.flatten().to_pylist()]
            open_ = np.stack([before[~sure], of[~sure]], axis=1).ravel()
            made = pa.array(sizes.astype(np.int64)), pa.array(n_known), pa.array(log), pa.array(value), unknown, lists(rares, guesses, pa.int32())
            made += lists(rares, often, pa.int64()), lists(2 * np.bincount(owner[~sure], minlength=n), open_.astype(np.int32), pa.int32())
            return dict(zip(kept, columns)) | dict(zip(("n_tokens", "n_known", logged, by_class, names, guess, times, pairs), made))

        return run

    source = lines.select(*map(col, kept), col(ids), col(rare))
    zero, whole = F.lit(0.0), F.lit(0).cast("long")
    plain = source.select(*map(col, kept))
    shape = plain.withColumns({
        "n_tokens": whole, "n_known": whole, logged: zero, by_class: zero,
        names: F.array(F.lit(b"")), guess: F.array(F.lit(0)), times: F.array(whole), pairs: F.array(F.lit(0)),
    })
    parts = shared_table(map_rows(source, make, shape.schema, lists=False).withColumn(row, F.monotonically_increasing_id()), "scored")
    asked = parts.select(F.col(row).alias("row"), F.posexplode(names).alias("at", "word"))
    known = asked.join(model.rest, "word").groupBy(F.col("row").alias(row)).agg(
        F.collect_list(F.struct("at", "c", "class")).alias("x")
    ).select(row, F.col("x.at").alias(places), F.col("x.c").alias(counts), F.col("x.class").alias(classes_))
    joined = parts.join(known, row, "left").select(
        *map(col, kept), "n_tokens", "n_known", logged, by_class, guess, times, pairs, places, counts, classes_
    )
    total = float(np.log10(model.n_tokens + model.n_types + 1))

    def finish():
        *_, transition, emission = sent.value
        transition, emission = np.array(transition), np.array(emission)

        def flat(lists, n):
            import pyarrow.compute as pc

            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            return np.repeat(np.arange(n), sizes), lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes

        def run(*columns) -> dict:
            import pyarrow as pa

            n_tokens, n_known, logs, scored, guess, times, pairs, places, counts, classes = columns[len(kept) :]
            n = len(n_tokens)
            owner, of, first = flat(guess, n)
            of, often = of.astype(np.int64), flat(times, n)[1]
            at, place, _ = flat(places, n)
            place = first[at] + place.astype(np.int64)
            c = np.zeros(len(of))
            c[place], of[place] = flat(counts, n)[1], flat(classes, n)[1]
            logged = np.bincount(owner, often * np.log10(c + 1), n)
            by, line, _ = flat(pairs, n)
            line = line.astype(np.int64)
            rare = line < 0
            line[rare] = of[first[by[rare]] - 1 - line[rare]]
            moves = np.bincount(by[::2], transition[line[::2], line[1::2]], n)
            logs = logs.to_numpy() + logged
            score = scored.to_numpy() + logs + moves - np.bincount(owner, often * emission[of], n)
            known = n_known.to_numpy() + np.bincount(owner, often * (c > 0), n).astype(np.int64)
            made = n_tokens, pa.array(known), pa.array(logs - n_tokens.to_numpy() * total), pa.array(score)
            return dict(zip(kept, columns)) | dict(zip(new, made))

        return run

    shape = plain.withColumns({"n_tokens": whole, "n_known": whole, "base_score": zero, "score": zero})
    return map_rows(joined, finish, shape.schema, 4096, False)


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of those whose crc32 of doc_id, as text, has a remainder by 7 other than 2.

    Null ids train. Null and empty texts have one token, the end.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "text")
    found = frequent(docs.filter(~F.col("held_out")), "text", SENT_WORDS)
    lines = shared_table(encode(docs, "text", list(found[0])), "lines")
    model = fit(lines.filter(~F.col("held_out")), found)
    scored = score_lines(lines, model)
    drop_shared(lines)
    return scored.withColumn("train_tokens", F.lit(model.n_tokens).cast("long")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
