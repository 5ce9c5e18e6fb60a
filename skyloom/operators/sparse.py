"""One graph in a task as arrays of its edges: extreme eigenvalues, hops, lengths and dependencies in memory linear in nodes and edges.

A spectrum is the union of those of the components, so an eigenvalue that each of many components has comes as often as it
should. Searches advance 64 sources in each word of a node, or lists of those (source, node) that have just been reached.
"""

from __future__ import annotations

import numpy as np

#: Nodes of a graph of which a task holds the edges, and some hundred vectors or 4096 bits a node; larger ones are distributed.
HELD = 200_000
#: Nodes of a component whose matrix is solved as a whole.
DENSE = 1000
#: Sources that are searched from at a time by bits, and by lists.
BITS, LISTED = 4096, 16
#: Sources near each other whose lengths are searched together, parts of the nodes by nearness, and links that make a node a hub.
WIDE, RINGS, HUB = 64, 10, 64


def components(n: int, src, dst) -> np.ndarray:
    """The smallest node number of each node's component."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[src], label[dst])
        np.minimum.at(new, label[src], low)  # roots join, then all follow them
        np.minimum.at(new, label[dst], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def entries(n: int, src, dst, w, kind: str):
    """Row, column and value off the diagonal, and the diagonal, of ``spectral._matrix``."""
    row, col, value = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([w, w]).astype(float)
    if kind == "adjacency":
        return row, col, value, np.zeros(n)
    d = np.bincount(row, value, n)
    if kind == "laplacian":
        return row, col, -value, d
    root = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1.0)), 0.0)
    return row, col, -root[row] * value * root[col], (d > 0).astype(float)


def _krylov(apply, start: np.ndarray, m: int, locked: np.ndarray) -> np.ndarray:
    """Orthonormal rows that span the first ``m`` powers of ``apply`` on ``start``, away from the rows of ``locked``."""
    q = np.zeros((m, len(start)))
    x = start
    for j in range(m):
        size = np.linalg.norm(x)
        for _ in range(2):
            x = x - (locked @ x) @ locked - (q[:j] @ x) @ q[:j]
        left = np.linalg.norm(x)
        if left <= 1e-12 * size or not left:
            return q[:j]
        q[j] = x / left
        x = apply(q[j])
    return q


def largest_states(apply, n: int, k: int, low: float, high: float, tolerance: float = 1e-10, rounds: int = 40, seed: int = 42):
    """The ``k`` largest eigenvalues, descending, and their vectors as rows, of a symmetric operator with a spectrum in [low, high].

    Krylov spaces of Chebyshev polynomials of the operator, which raise what lies above a bound and hold down the rest. The
    bound is a Ritz value past the wanted ones, so never above the eigenvalue of that place. What is found is held
    out and searched for again, until nothing as large is left: that finds eigenvalues that come more than once.
    ArithmeticError where ``rounds`` spaces do not settle.
    """
    k, rng = min(k, n), np.random.default_rng(seed)
    scale = max(abs(low), abs(high), 1e-300)
    values, vectors = np.zeros(0), np.zeros((0, n))
    while len(values) < n:
        wanted = k if not len(values) else min(4, n - len(values))
        size = min(n - len(values), 2 * wanted + 40)
        bound, start = None, rng.normal(size=n)
        for _ in range(rounds):
            step, degree = apply, 1
            if bound is not None and low < bound < top:
                centre, half = (low + bound) / 2, (bound - low) / 2
                degree = int(min(400, max(2, np.ceil(3.0 / np.sqrt((top - bound) / half)))))

                def step(x, centre=centre, half=half, degree=degree):
                    before, now = x, (apply(x) - centre * x) / half
                    for _ in range(degree - 1):
                        before, now = now, 2 * (apply(now) - centre * now) / half - before
                    return now

            q = _krylov(step, start, size, vectors)
            moved = np.array([apply(x) for x in q])
            moved -= (moved @ vectors.T) @ vectors
            e, s = np.linalg.eigh(q @ moved.T)
            e, s = e[::-1], s[:, ::-1]
            few = min(wanted, len(e))
            found = s[:, :few].T @ q
            off = np.linalg.norm(s[:, :few].T @ moved - e[:few, None] * found, axis=1)
            # of what is searched for again, the largest alone has to be known, unless it is one of the wanted
            need = few if not len(vectors) or e[0] >= values[k - 1] - 1e-8 * scale else 1
            if off[:need].max(initial=0.0) <= (tolerance if need == few else 1e-6) * scale:
                break
            bound, top = e[min(len(e) - 1, wanted + 5)], e[0]
            start = s[:, : wanted + 6].sum(axis=1) @ q
        else:
            raise ArithmeticError(f"{rounds} rounds leave a residual of {off.max():.1e}")
        if len(values) >= k and e[0] < values[k - 1] - 1e-8 * scale:
            break
        values, vectors = np.concatenate([values, e[:few]]), np.vstack([vectors, found])
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[order]
    return values[:k], vectors[:k]


def spectrum(n: int, src, dst, w, kind: str, k: int, largest: bool = False, vectors: bool = False):
    """The ``k`` smallest eigenvalues ascending, or the largest by magnitude descending, component by component.

    With ``vectors`` also the sums of the magnitudes of each eigenvector's components. Equal eigenvalues of several
    components go by their smallest nodes, and each has its own component's vector.
    """
    row, col, value, diagonal = entries(n, src, dst, w, kind)
    linked = value != 0
    row, col, value = row[linked], col[linked], value[linked]
    label = components(n, row, col)
    by = np.argsort(label, kind="stable")
    place = np.empty(n, np.int64)
    firsts = np.flatnonzero(np.diff(label[by], prepend=-1))
    sizes = np.diff(np.append(firsts, n))
    place[by] = np.arange(n) - np.repeat(firsts, sizes)
    edge_order = np.argsort(label[row], kind="stable")
    ends = np.searchsorted(label[row][edge_order], label[by][firsts], "right")
    begins = np.searchsorted(label[row][edge_order], label[by][firsts], "left")
    found, sums = [], []
    for at, size, one, two in zip(firsts, sizes, begins, ends):
        if size == 1:
            found.append(diagonal[by[at : at + 1]] + value[edge_order[one:two]].sum())  # a loop counts at both of its ends
            sums.append(np.ones(1))
            continue
        own, e = by[at : at + size], edge_order[one:two]
        i, j, v, d = place[row[e]], place[col[e]], value[e], diagonal[own]
        if size <= DENSE:
            a = np.diag(d)
            np.add.at(a, (i, j), v)
            x, s = np.linalg.eigh(a) if vectors else (np.linalg.eigvalsh(a), None)
            first = np.argsort(-np.abs(x) if largest else x, kind="stable")[:k]
            found.append(x[first])
            sums.append(np.abs(s[:, first]).sum(0) if vectors else np.zeros(len(first)))
            continue
        ordered = np.argsort(i, kind="stable")
        i, j, v = i[ordered], j[ordered], v[ordered]
        starts = np.flatnonzero(np.diff(i, prepend=-1))  # every node of a component has an edge
        reach = np.add.reduceat(np.abs(v), starts)
        low, high = float((d - reach).min()), float((d + reach).max())
        if kind == "normalized":
            low, high = 0.0, 2.0
            if (w < 0).any():
                low, high = float((d - reach).min()), float((d + reach).max())
        span = 1e-9 * max(abs(low), abs(high))
        matrix = lambda x: d * x + np.add.reduceat(v * x[j], starts)
        least = lambda x: -matrix(x)
        x, s = largest_states(least, int(size), k, -high - span, -low + span)
        x = -x
        if largest:
            top, more = largest_states(matrix, int(size), k, low - span, high + span)
            x, s = np.concatenate([top, x]), np.vstack([more, s])
            first = np.argsort(-np.abs(x), kind="stable")[:k]
            x, s = x[first], s[first]
        found.append(x)
        sums.append(np.abs(s).sum(1))
    x, s = np.concatenate(found), np.concatenate(sums)
    key = np.round(-np.abs(x) if largest else x, 10)  # rounding must not order equal ones
    first = np.argsort(key, kind="stable")[:k]
    return (x[first], s[first]) if vectors else x[first]


def neighbours(n: int, src, dst, w=None):
    """``(starts, ends, col, w)``: each node's neighbours, both ways, without loops, once each with the least weight."""
    kept = src != dst
    row, col = np.concatenate([src[kept], dst[kept]]).astype(np.int64), np.concatenate([dst[kept], src[kept]]).astype(np.int64)
    weight = np.ones(len(row)) if w is None else np.concatenate([w[kept], w[kept]])
    order = np.lexsort((weight, col, row))
    row, col, weight = row[order], col[order], weight[order]
    first = np.ones(len(row), bool)
    first[1:] = (np.diff(row) != 0) | (np.diff(col) != 0)
    row, col, weight = row[first], col[first], weight[first]
    at = np.searchsorted(row, np.arange(n + 1))
    return at[:-1], at[1:], col, weight


def reached(n: int, links, sources):
    """``(level, new)`` for each 512 of ``sources`` and number of hops from 1 on: the bits of the sources that are so far from a node."""
    starts, ends, col, _ = links
    linked = np.flatnonzero(ends > starts)
    if not len(linked):
        return
    for at in range(0, len(sources), 512):
        some = np.asarray(sources[at : at + 512])
        bit = np.arange(len(some))
        seen = np.zeros((n, -(-len(some) // 64)), np.uint64)
        np.bitwise_or.at(seen, (some, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
        front, level = seen.copy(), 1
        while True:
            new = np.zeros_like(seen)
            new[linked] = np.bitwise_or.reduceat(front[col], starts[linked], axis=0)
            new &= ~seen
            if not new.any():
                break
            yield level, new
            seen |= new
            front, level = new, level + 1


def hop_counts(n: int, links, sources, inside=None) -> np.ndarray:
    """How many pairs of a source and a node, of those ``inside``, are so many hops apart, by hops."""
    out: dict[int, int] = {}
    for level, new in reached(n, links, sources):
        out[level] = out.get(level, 0) + int(np.bitwise_count(new if inside is None else new[inside]).sum(dtype=np.int64))
    return np.array([out.get(i, 0) for i in range(max(out, default=0) + 1)], np.int64)


def hop_sums(n: int, links, sources) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``sources`` reach each node, itself apart, and the sum of their hops."""
    near, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for level, new in reached(n, links, sources):
        counts = np.bitwise_count(new).sum(axis=1, dtype=np.int64)
        near += counts
        total += level * counts
    return near, total


def _expanded(n: int, links, keys):
    """For each neighbour of the nodes of ``keys`` (source * n + node): the place of the key, and the neighbour's key and weight."""
    starts, ends, col, w = links
    node = keys % n
    many = ends[node] - starts[node]
    of = np.repeat(np.arange(len(keys)), many)
    at = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + starts[node][of]
    return of, (keys - node)[of] + col[at], w[at]


def lengths(n: int, links, sources) -> np.ndarray:
    """Least sums of weights from ``sources``, inf if there is no way; only what came nearer is looked at again."""
    if (links[3] < 0).any():
        raise ValueError("weights may not be negative")
    far = np.full(len(sources) * n, np.inf)
    front = np.arange(len(sources)) * n + np.asarray(sources)
    far[front] = 0.0
    while len(front):
        of, key, w = _expanded(n, links, front)
        d = far[front][of] + w
        nearer = d < far[key]
        key, d = key[nearer], d[nearer]
        order = np.lexsort((d, key))
        key, d = key[order], d[order]
        first = np.ones(len(key), bool)
        first[1:] = np.diff(key) != 0
        front = key[first]
        far[front] = d[first]
    return far.reshape(len(sources), n)


def _close_by(n: int, links, sources, landmarks: int = 8) -> list:
    """``sources`` of one component in parts of up to ``WIDE`` that lie near each other, the first of each in their middle.

    Halves are taken by the lengths from some nodes that are far apart.
    """
    if len(sources) <= WIDE:
        return [sources]
    at, next_ = np.zeros((len(sources), landmarks)), 0
    for i in range(landmarks):
        at[:, i] = lengths(n, links, [sources[next_]])[0][sources]
        next_ = int(at[:, : i + 1].min(axis=1).argmax())
    todo, out = [np.arange(len(sources))], []
    while todo:
        some = todo.pop()
        if len(some) <= WIDE:
            middle = ((at[some] - at[some].mean(axis=0)) ** 2).sum(axis=1).argmin()
            out.append(sources[np.roll(some, -middle)])
            continue
        half = -(-len(some) // WIDE) // 2 * WIDE
        by = np.argpartition(at[some, np.ptp(at[some], axis=0).argmax()], half)
        todo += [some[by[:half]], some[by[half:]]]
    return out


def _wave(n: int, links, some) -> np.ndarray:
    """Least sums of weights from the sources ``some``, near each other, in a connected graph: a row a node, a column a source.

    Nodes are in the order of their length from the first source. Those of the nearest rings are settled before the next ring is
    looked at, and a node is compared with its neighbours only if one came nearer, for all sources at once.
    """
    starts, ends, col, w = links
    nodes = np.argsort(lengths(n, links, some[:1])[0], kind="stable") if n > WIDE else np.arange(n)
    place = np.empty(n, np.int64)
    place[nodes] = np.arange(n)
    many, begin = (ends - starts)[nodes], starts[nodes]
    far, open_ = np.full((n, len(some)), np.inf), np.zeros(n, bool)
    far[place[some], np.arange(len(some))] = 0.0
    col, ring, top = place[col], -(-n // RINGS), -(-n // RINGS)

    def neighbours_of(at):
        d = many[at]
        return col[np.arange(d.sum()) + np.repeat(begin[at] - np.cumsum(d) + d, d)]

    open_[neighbours_of(place[some])] = True
    while top < n + ring:
        at = np.flatnonzero(open_[:top])
        if not len(at):
            top += ring
            continue
        open_[at] = False
        at = at[np.argsort(-many[at], kind="stable")]
        before, d = far[at], many[at]
        now = before.copy()
        hubs = int((d > HUB).sum())
        for i in range(hubs):
            e = slice(begin[at[i]], begin[at[i]] + d[i])
            now[i] = np.minimum(now[i], (far[col[e]] + w[e, None]).min(axis=0))
        for j in range(d[hubs] if hubs < len(at) else 0):  # the j-th link of all that have so many
            has = slice(hubs, len(at) - int(np.searchsorted(d[::-1], j, "right")))
            e = begin[at[has]] + j
            way = far.take(col[e], axis=0)
            way += w[e, None]
            np.minimum(now[has], way, out=now[has])
        nearer = (now < before).any(axis=1)
        far[at[nearer]] = now[nearer]
        open_[neighbours_of(at[nearer])] = True
    return far[place]


def near_lengths(n: int, links, sources, part: int = 0, parts: int = 1):
    """``(some, nodes, far)`` for sets ``some`` of ``sources``: least sums of weights to the ``nodes`` of their component, a column a source.

    The lengths are those of ``lengths``, and no link without a finite weight is gone. Of ``parts`` such runs each has other sets.
    """
    starts, ends, col, w = links
    if (w < 0).any():
        raise ValueError("weights may not be negative")
    held = np.isfinite(w)
    row, col, w = np.repeat(np.arange(n), ends - starts)[held], col[held], w[held]
    label = components(n, row, col)
    by, e = np.argsort(label, kind="stable"), np.argsort(label[row], kind="stable")
    firsts = np.flatnonzero(np.diff(label[by], prepend=-1))
    lasts, place = np.append(firsts[1:], n), np.empty(n, np.int64)
    place[by] = np.arange(n) - np.repeat(firsts, lasts - firsts)
    bounds = np.searchsorted(label[row][e], np.append(label[by][firsts], n))
    wanted = np.zeros(n, bool)
    wanted[sources] = True
    turn = 0
    for first, last, one, two in zip(firsts, lasts, bounds, bounds[1:]):
        nodes = by[first:last]
        chosen = np.flatnonzero(wanted[nodes])
        if not len(chosen):
            continue
        ends = np.cumsum(np.bincount(place[row[e[one:two]]], minlength=len(nodes)))
        own = np.append(0, ends[:-1]), ends, place[col[e[one:two]]], w[e[one:two]]
        sets = _close_by(len(nodes), own, chosen)
        mine, turn = sets[(part - turn) % parts :: parts], turn + len(sets)
        for some in mine:
            yield nodes[some], nodes, _wave(len(nodes), own, some) if len(nodes) > 1 else np.zeros((1, 1))


def length_sums(n: int, links, sources, part: int = 0, parts: int = 1) -> tuple[float, int]:
    """The sum and the number of the least lengths above zero from ``sources``, or from one of ``parts`` of them."""
    total, many = 0.0, 0
    for _, _, far in near_lengths(n, links, sources, part, parts):
        seen = far[np.isfinite(far) & (far > 0)]
        total, many = total + float(seen.sum()), many + len(seen)
    return total, many


def dependencies(n: int, links, sources) -> np.ndarray:
    """Brandes' dependencies of ``sources`` on each node, added up."""
    total = np.zeros(n)
    for start in range(0, len(sources), LISTED):
        some = np.asarray(sources[start : start + LISTED])
        hops, ways = np.full(len(some) * n, -1, np.int32), np.zeros(len(some) * n)
        front = np.arange(len(some)) * n + some
        hops[front], ways[front] = 0, 1.0
        own, found = front, [front]
        while len(front):
            of, key, _ = _expanded(n, links, front)
            new = hops[key] < 0
            of, key = of[new], key[new]
            shares = ways[front][of]
            front = np.unique(key)
            hops[front] = len(found)
            np.add.at(ways, key, shares)
            found.append(front)
        depend = np.zeros(len(some) * n)
        for level in range(len(found) - 1, 0, -1):
            of, key, _ = _expanded(n, links, found[level])
            back = hops[key] == level - 1
            of, key = of[back], key[back]
            np.add.at(depend, key, ways[key] * ((1.0 + depend[found[level]]) / ways[found[level]])[of])
        depend[own] = 0.0
        total += depend.reshape(len(some), n).sum(axis=0)
    return total
