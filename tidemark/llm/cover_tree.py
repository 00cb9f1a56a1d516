"""Embedding near-dedup: cover trees and their dual traversal, exact at a threshold of the cosine.

On unit vectors a cosine of at least c is a distance of at most
sqrt(2 - 2c).  The upper levels of the tree are fitted on a sample: a node is
split by a net of half its radius.  Every vector belongs to the nearest of the
centres at their foot, and the covering radius of such a cell is measured on
all its members.  A vector visits the cells whose covering radius it can be
near enough to; a cell's members in bounded blocks have a tree of their own,
of nested levels with halving radii, and so have its visitors.  A dual
traversal drops pairs of nodes that are too far apart for their radii, counts
pairs that are near enough for them as a whole, and compares the rest.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..skew import attach, hot_keys
from .ann import usable
from .components import connected, star_forest
from .kernels import mix64
from .store import discard, store

#: Least cosine of a link.
LEAST = 0.98
#: Members of a block, visitors of a slice of one.
BLOCK, VISITORS = 1024, 8192
#: Numbers of the vectors drawn, by hash, to fit the upper levels; drawn vectors of a cell at least; nodes that a node is split into at most.
SAMPLE_NUMBERS, CELL_SAMPLE, FAN = 1 << 21, 32, 64
#: Added to every bound: more than rounding can take from a distance.  Cosines nearer to the threshold than CLOSE are taken again, pair by pair.
SLACK, CLOSE = 1e-6, 1e-12


def chord(least: float) -> float:
    """The distance of unit vectors at a cosine of ``least``."""
    return float(np.sqrt(max(0.0, 2 - 2 * least)))


def units(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, of length one; no row is zero."""
    x = x.astype(np.float64)
    if not x.size:
        return x
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])  # by powers of two: exact
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of unit (or zero) vectors."""
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def net(far: np.ndarray, radius: float) -> np.ndarray:
    """Rows, the first among them, that are more than ``radius`` apart and within it of all others."""
    near = far <= radius
    covered = np.zeros(len(far), bool)
    found = []
    at = 0
    while True:
        found.append(at)
        covered |= near[at]
        covered[at] = True
        at = int(covered.argmin())
        if covered[at]:
            return np.array(found)


class Tree:
    """A cover tree of unit vectors, in flat arrays by node.

    ``point`` is a node's vector, ``radius`` the largest distance from it to
    those below it, which are ``order[lo:hi]``; ``kids`` are its children (none
    of a leaf, which is one vector).  A node's first child is itself a level
    deeper: levels are nested, and each has at most half the radius of the one
    above.
    """

    def __init__(self, unit: np.ndarray, weight: np.ndarray):
        self.unit, self.weight = unit, weight
        far = distances(unit, unit)
        np.fill_diagonal(far, 0)
        self.order = np.arange(len(unit))
        point, radius, lo, hi, kids = [0], [float(far[0].max())], [0], [len(unit)], [np.zeros(0, np.int64)]
        todo = [0]
        while todo:
            k = todo.pop()
            if hi[k] - lo[k] == 1:
                continue
            mine = self.order[lo[k] : hi[k]].copy()  # its own point first
            inner = far[np.ix_(mine, mine)]
            half = 2.0 ** (np.ceil(np.log2(radius[k])) - 1) if radius[k] > 0 else 0.0
            heads = net(inner, half) if half > SLACK else np.arange(len(mine))
            owner = inner[:, heads].argmin(axis=1)
            owner[heads] = np.arange(len(heads))
            # the members of each child side by side, its own point first
            behind = np.ones(len(mine), np.int64)
            behind[heads] = 0
            by = np.lexsort((behind, owner))
            self.order[lo[k] : hi[k]] = mine[by]
            edge = np.append(np.searchsorted(owner[by], np.arange(len(heads))), len(mine))
            reach = np.maximum.reduceat(inner[by, heads[owner[by]]], edge[:-1])
            kids[k] = np.arange(len(point), len(point) + len(heads))
            point += mine[heads].tolist()
            radius += reach.tolist()
            lo += (lo[k] + edge[:-1]).tolist()
            hi += (lo[k] + edge[1:]).tolist()
            kids += [np.zeros(0, np.int64)] * len(heads)
            todo += [c for c in kids[k].tolist() if hi[c] - lo[c] > 1]
        self.point, self.radius, self.lo, self.hi, self.kids = np.array(point), np.array(radius), np.array(lo), np.array(hi), kids
        held = np.concatenate((np.zeros(1, np.int64), np.cumsum(weight[self.order])))
        self.held = held[self.hi] - held[self.lo]
        self.leaf = self.hi - self.lo == 1


class Links:
    """What a traversal finds: links of each vector of two trees, and pairs that connect all that is linked."""

    def __init__(self, a: Tree, b: Tree):
        self.a, self.b = a, b
        # by place in a tree's order: what its neighbours' ranges add begins and ends
        self.more = [np.zeros(len(t.order) + 1, np.int64) for t in (a, b)]
        self.one = [np.zeros(len(t.order), np.int64) for t in (a, b)]
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def whole(self, p: int, q: int) -> None:
        """All below node ``p`` with all below node ``q``."""
        a, b = self.a, self.b
        for k, t, n, held in ((0, a, p, b.held[q]), (1, b, q, a.held[p])):
            self.more[k][t.lo[n]] += held
            self.more[k][t.hi[n]] -= held
        left, right = a.order[a.lo[p] : a.hi[p]], b.order[b.lo[q] : b.hi[q]]
        self.pairs.append((left, np.full(len(left), right[0])))
        self.pairs.append((np.full(len(right), left[0]), right))

    def inside(self, p: int) -> None:
        """All below node ``p`` of the one tree with one another."""
        t = self.a
        self.more[0][t.lo[p]] += t.held[p]
        self.more[0][t.hi[p]] -= t.held[p]
        mine = t.order[t.lo[p] : t.hi[p]]
        self.one[0][mine] -= t.weight[mine]
        self.pairs.append((mine, np.full(len(mine), mine[0])))

    def single(self, i: np.ndarray, j: np.ndarray) -> None:
        """Vectors ``i`` of one tree with vectors ``j`` of the other."""
        np.add.at(self.one[0], i, self.b.weight[j])
        np.add.at(self.one[1], j, self.a.weight[i])
        self.pairs.append((i, j))

    def counts(self) -> list[np.ndarray]:
        out = []
        for t, more, one in zip((self.a, self.b), self.more, self.one, strict=True):
            total = one.copy()
            total[t.order] += np.cumsum(more)[:-1]
            out.append(total)
        return out


def _verified(x: np.ndarray, y: np.ndarray, cosine: np.ndarray, least: float) -> np.ndarray:
    fine = cosine >= least
    for k in np.flatnonzero(np.abs(cosine - least) < CLOSE):
        fine[k] = float(x[k] @ y[k]) / float(np.sqrt(x[k] @ x[k]) * np.sqrt(y[k] @ y[k])) >= least
    return fine


def traverse(a: Tree, b: Tree, least: float) -> Links:
    """Links of cosine >= ``least`` between two trees, or within one if both are the same."""
    out = Links(a, b)
    reach = chord(least)
    same = a is b
    todo = [(0, 0)]
    while todo:
        p, q = todo.pop()
        within = same and p == q
        if within and 2 * a.radius[p] + SLACK <= reach:
            out.inside(p)
            continue
        left = a.kids[p] if len(a.kids[p]) else np.array([p])
        right = b.kids[q] if len(b.kids[q]) else np.array([q])
        cosine = a.unit[a.point[left]] @ b.unit[b.point[right]].T
        far = np.sqrt(np.maximum(2 - 2 * cosine, 0))
        gap = a.radius[left][:, None] + b.radius[right]
        keep = far <= reach + gap + SLACK
        if within:
            keep = np.triu(keep, 1)
        i, j = np.nonzero(keep)
        leaves = a.leaf[left[i]] & b.leaf[right[j]]
        x, y = a.point[left[i[leaves]]], b.point[right[j[leaves]]]
        fine = _verified(a.unit[x], b.unit[y], cosine[i[leaves], j[leaves]], least) if len(x) else np.zeros(0, bool)
        out.single(x[fine], y[fine])
        i, j = i[~leaves], j[~leaves]
        sure = far[i, j] + gap[i, j] + SLACK <= reach
        for m, n in zip(left[i[sure]].tolist(), right[j[sure]].tolist(), strict=True):
            out.whole(m, n)
        todo += zip(left[i[~sure]].tolist(), right[j[~sure]].tolist(), strict=True)
        if within:
            todo += [(c, c) for c in left.tolist() if not a.leaf[c]]
    return out


# The upper levels -----------------------------------------------------------------


def split(unit: np.ndarray, most: int, finest: float) -> np.ndarray:
    """Centres of at most ``most`` cells of a sample.

    The node that most vectors are in is split first, by a net of half its
    radius (the farthest vector joins the net until all are within it, or FAN
    have joined), down to nodes of CELL_SAMPLE vectors or a radius of
    ``finest``.
    """
    if most <= 1 or len(unit) < 2 * CELL_SAMPLE:
        return units(_mean(unit))

    def reach(mine: np.ndarray) -> float:
        return float(distances(unit[mine[:1]], unit[mine]).max())

    everything = np.arange(len(unit))
    heap = [(-len(unit), 0, everything, reach(everything))]
    final: list[np.ndarray] = []
    made = 1
    while heap and len(heap) + len(final) < most:
        _, _, mine, radius = heapq.heappop(heap)
        if len(mine) < 2 * CELL_SAMPLE or radius <= finest:
            final.append(mine)
            continue
        owner = np.zeros(len(mine), np.int64)
        far = distances(unit[mine[:1]], unit[mine])[0]
        for k in range(1, min(FAN, most - len(heap) - len(final), len(mine) // CELL_SAMPLE + 1)):
            if far.max() <= radius / 2:
                break
            new = distances(unit[mine[far.argmax()]][None], unit[mine])[0]
            owner[new < far] = k
            far = np.minimum(far, new)
        if not owner.any():
            final.append(mine)
            continue
        for k in np.unique(owner).tolist():
            part = mine[owner == k]
            heapq.heappush(heap, (-len(part), made, part, reach(part)))
            made += 1
    cells = final + [h[2] for h in heap]
    return np.unique(units(np.concatenate([_mean(unit[c]) for c in cells])), axis=0)


def _mean(unit: np.ndarray) -> np.ndarray:
    """The mean as one row; the first vector where they cancel out."""
    mean = unit.mean(axis=0, keepdims=True)
    return mean if np.abs(mean).max(initial=0) > 1e-9 else unit[:1]


@dataclass
class Cells:
    """Cells of the sampled spaces.  A cell's core, if large, is an entry of its own: all its members are linked with one another."""

    centre: dict[str, np.ndarray]  # of each space
    first: dict[str, int]  # its first cell
    entry: np.ndarray | None = None  # (cells, 2): the entry of a cell's shell and of its core
    cell: np.ndarray | None = None  # by entry
    core: np.ndarray | None = None
    radius: np.ndarray | None = None
    parts: np.ndarray | None = None
    held: np.ndarray | None = None  # vectors, copies counted
    rep: np.ndarray | None = None  # the node that stands for a core
    slices: np.ndarray | None = None
    bonus: np.ndarray | None = None  # links that every member of a core has from outside, counted as a whole

    def entries(self, space: str) -> np.ndarray:
        lo, n = self.first[space], len(self.centre[space])
        return np.unique(self.entry[lo : lo + n])


def _by_space(batch: pa.RecordBatch, space: int, vector: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(space, rows, unit vectors) of a batch: a space's vectors have one length."""
    names = np.array(batch.column(space).to_pylist(), object)
    column = batch.column(vector)
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    known, code = np.unique(names.astype(str), return_inverse=True)
    by = np.argsort(code, kind="stable")
    edge = np.searchsorted(code[by], np.arange(len(known) + 1))
    for k, name in enumerate(known.tolist()):
        rows = by[edge[k] : edge[k + 1]]
        dims = offsets[rows[0] + 1] - offsets[rows[0]]
        yield name, rows, units(flat[offsets[rows][:, None] + np.arange(dims)])


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, space, vector) with the tag of their space and vector; equal tags, equal vectors."""
    for batch in batches:
        tag = []
        for space, vector in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            flat = None if space is None else vector.values.to_numpy(zero_copy_only=False)
            tag.append(None if space is None else hashlib.sha256(f"{space}\0".encode() + (flat.astype(np.float64) + 0.0).tobytes()).digest()[:16])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tag, pa.binary())], names=["vec_id", "space", "vector", "tag"])


def _place(shared) -> Callable:
    """Rows (node, m, space, vector) with their cell (-1 in a space without a sample) and the distance to its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Cells = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            at, far = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            for space, rows, unit in _by_space(batch, 2, 3):
                if space in cells.centre:
                    d = distances(unit, cells.centre[space])
                    best = d.argmin(axis=1)
                    at[rows], far[rows] = best + cells.first[space], d[np.arange(len(rows)), best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(far)], names=["node", "m", "space", "vector", "cell", "far"])

    return run


def _part(node: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return (mix64(node.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)


def _looks(cells: Cells, batch: pa.RecordBatch, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their entries, (row, entry) that a row visits, (row, core) that it is linked with as a whole) of a batch, by space."""
    reach = chord(least)
    cell, far = batch.column(4).to_numpy(), batch.column(5).to_numpy()
    for space, rows, unit in _by_space(batch, 2, 3):
        if space not in cells.centre:
            continue
        entries = cells.entries(space)
        centre = cells.centre[space]
        own_cell = cell[rows]
        is_core = (far[rows] <= reach / 2 - SLACK).astype(np.int64)
        own = cells.entry[own_cell, is_core]
        other = cells.cell[entries]
        d = distances(unit, centre)[:, other - cells.first[space]]
        keep = d <= cells.radius[entries] + reach + SLACK
        # what is nearer to the other centre lies beyond the plane between the two
        between = distances(centre, centre)[np.ix_(own_cell - cells.first[space], other - cells.first[space])]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d**2 - far[rows][:, None] ** 2) / (2 * between)
        keep &= ~((between > SLACK) & (plane > reach + SLACK))
        keep &= entries != own[:, None]
        # of two cores, or two that are none, one visits the other; a core is visited by all others
        core, mine = cells.core[entries], cells.core[own][:, None]
        turn = (own[:, None] < entries) == ((own[:, None] + entries) % 2 == 0)
        whole = core & (d + cells.radius[entries] + SLACK <= reach)
        keep &= np.where(core == mine, turn, core)
        r, e = np.nonzero(keep & ~whole)
        w, c = np.nonzero(keep & whole)
        yield rows, own, np.stack((rows[r], entries[e])), np.stack((rows[w], entries[c])), unit


def _count_looks(shared, least: float) -> Callable:
    """Rows as placed to (entry, visits, bonus): how many visit it, and how many links each member of a core has as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Cells = shared.value
        visits, bonus = (np.zeros(len(cells.cell), np.int64) for _ in range(2))
        for batch in batches:
            if batch.num_rows:
                weight = batch.column(1).to_numpy()
                for _, _, look, whole, _ in _looks(cells, batch, least):
                    visits += np.bincount(look[1], minlength=len(visits))
                    np.add.at(bonus, whole[1], weight[whole[0]])
        at = np.flatnonzero((visits > 0) | (bonus > 0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(visits[at]), pa.array(bonus[at])], names=["entry", "visits", "bonus"])

    return run


_BLOCKS = ["space", "entry", "part", "slice", "joins", "visitor", "node", "m", "vector"]


def _deal(shared, least: float) -> Callable:
    """Rows as placed to rows of blocks: members, in each slice of their part, and visitors, in a slice of each part.

    Members are joined with one another in their first slice, unless they are a
    core.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Cells = shared.value

        def rows_of(batch, row, entry, part, slice_, visitor):
            return pa.RecordBatch.from_arrays(
                [batch.column(2).take(pa.array(row)), pa.array(entry.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(slice_.astype(np.int32)),
                 pa.array(~cells.core[entry] & (slice_ == 0)), pa.array(np.full(len(row), visitor)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), batch.column(3).take(pa.array(row))],
                names=_BLOCKS,
            )

        def runs(many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Index of each run and place within it."""
            of = np.repeat(np.arange(len(many)), many)
            return of, np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)

        for whole in batches:
            for lo in range(0, whole.num_rows, 256):  # a row may go to many parts
                batch = whole.slice(lo, 256)
                node = batch.column(0).to_numpy()
                for rows, own, look, _, _ in _looks(cells, batch, least):
                    part = _part(node[rows], cells.parts[own])
                    of, slice_ = runs(cells.slices[own])
                    yield rows_of(batch, rows[of], own[of], part[of], slice_, False)
                    # members of a later part visit the earlier ones, unless all of them are linked anyway
                    of, at = runs(np.where(cells.core[own], 0, part))
                    yield rows_of(batch, rows[of], own[of], at, _part(node[rows[of]] + 1, cells.slices[own[of]]), True)
                    of, at = runs(cells.parts[look[1]])
                    row, entry = look[0][of], look[1][of]
                    yield rows_of(batch, row, entry, at, _part(node[row] + 1, cells.slices[entry]), True)

    return run


def _wholes(shared, least: float) -> Callable:
    """Rows as placed to (node, links, other) of the links that were counted as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Cells = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            node, weight = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows, own, _, whole, _ in _looks(cells, batch, least):
                mine = cells.core[own]
                inside = cells.held[own[mine]] - weight[rows[mine]] + cells.bonus[own[mine]]
                columns = [np.concatenate((node[rows[mine]], node[whole[0]])), np.concatenate((inside, cells.held[whole[1]])), np.concatenate((cells.rep[own[mine]], cells.rep[whole[1]]))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "links", "other"])

    return run


def _join(least: float, block: int) -> Callable:
    """Rows of blocks, sorted, members of each first, to (node, links, other)."""

    def found(links: Links, nodes: list[np.ndarray], same: bool) -> pa.RecordBatch | None:
        counts = links.counts()
        if same:
            total, names = counts[0] + counts[1], nodes[0]
        else:
            total, names = np.concatenate(counts), np.concatenate(nodes)
        on = total > 0
        if not on.any():
            return None
        a, b = star_forest(np.concatenate([nodes[0][i] for i, _ in links.pairs]), np.concatenate([nodes[-1][j] for _, j in links.pairs]))
        root = dict(zip(a.tolist(), b.tolist(), strict=True))
        other = [root.get(n, n) for n in names[on].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(names[on]), pa.array(total[on]), pa.array(other, pa.int64())], names=["node", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, home_nodes = None, None, None
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows, visiting = 0, False

        def flush():
            nonlocal home, home_nodes, rows
            if not held:
                return None
            node, weight, unit = (np.concatenate([h[k] for h in held]) for k in range(3))
            held.clear()
            rows = 0
            if not visiting:
                home, home_nodes = Tree(unit, weight), node
                return found(traverse(home, home, least), [node], True) if key[4] else None
            if home is None:
                return None
            return found(traverse(Tree(unit, weight), home, least), [node, home_nodes], False)

        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
            guest = batch.column(5).to_numpy(zero_copy_only=False)
            edge = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1] or guest[k] != guest[k - 1]), len(names)]
            column = batch.column(8)
            offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            node, weight = batch.column(6).to_numpy(), batch.column(7).to_numpy()
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if names[lo] != key or bool(guest[lo]) != visiting:
                    if (out := flush()) is not None:
                        yield out
                    if names[lo] != key:
                        home = None
                    key, visiting = names[lo], bool(guest[lo])
                while lo < hi:
                    to = min(hi, lo + block - rows) if visiting else hi
                    dims = offsets[lo + 1] - offsets[lo]
                    held.append((node[lo:to], weight[lo:to], units(flat[offsets[lo:to][:, None] + np.arange(dims)])))
                    rows += to - lo
                    lo = to
                    if visiting and rows >= block and (out := flush()) is not None:
                        yield out
        if (out := flush()) is not None:
            yield out

    return run


def _fit(nodes: DataFrame, least: float, block: int, sample: int) -> Cells:
    numbers = nodes.agg(F.sum(F.size("vector"))).first()[0]
    share = min(1.0, sample / max(1, numbers or 0))
    drawn = nodes.where(F.pmod(F.xxhash64("tag"), F.lit(1 << 20)) < int(share * (1 << 20))).select("space", "vector").toArrow()
    cells = Cells({}, {})
    made = 0
    for batch in drawn.combine_chunks().to_batches():
        for space, _, unit in _by_space(batch, 0, 1):
            most = min(-(-int(len(unit) / share) // block), len(unit) // CELL_SAMPLE)
            cells.centre[space] = split(unit, most, chord(least) / 4)
            cells.first[space] = made
            made += len(cells.centre[space])
    return cells


def _measure(cells: Cells, placed: DataFrame, least: float, block: int) -> None:
    """Members, covering radius and core of every cell, from all rows."""
    inner = (F.col("far") <= chord(least) / 2 - SLACK).cast("int").alias("inner")
    stats = placed.where("cell >= 0").groupBy("cell", inner).agg(
        F.count(F.lit(1)).alias("n"), F.max("far").alias("r"), F.sum("m").alias("held"), F.min("node").alias("rep"))
    found = {(s["cell"], s["inner"]): s for s in stats.collect()}  # two rows for each centre at most
    made = sum(len(c) for c in cells.centre.values())
    cells.entry = np.zeros((made, 2), np.int64)
    rows = []
    for cell in range(made):
        shell, core = found.get((cell, 0)), found.get((cell, 1))
        if core is not None and core["n"] > block:
            groups = [([shell] if shell else [], False), ([core], True)]
        else:
            groups = [([s for s in (shell, core) if s], False)]
        for k, (mine, is_core) in enumerate(groups):
            cells.entry[cell, k:] = len(rows)
            n = sum(s["n"] for s in mine)
            rows.append((cell, is_core, max((s["r"] for s in mine), default=-np.inf), max(1, -(-n // block)), sum(s["held"] for s in mine), min((s["rep"] for s in mine), default=-1)))
    for name, values, kind in zip(("cell", "core", "radius", "parts", "held", "rep"), zip(*rows, strict=True) if rows else [()] * 6, (np.int64, bool, np.float64, np.int64, np.int64, np.int64), strict=True):
        setattr(cells, name, np.array(values, kind))
    cells.slices, cells.bonus = np.ones(len(rows), np.int64), np.zeros(len(rows), np.int64)


def near_links(nodes: DataFrame, least: float = LEAST, block: int = BLOCK, sample: int = SAMPLE_NUMBERS) -> DataFrame:
    """(node, links, other) of ``nodes`` (node long, m long, tag binary, space string, vector): links between different nodes of a space.

    ``links`` sum up to the weight of a node's neighbours; (node, other)
    connect all that is linked, a row for each node and block at most.
    """
    spark = nodes.sparkSession
    cells = _fit(nodes, least, block, sample)
    kind = nodes.schema["vector"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(cells)
    placed = nodes.select("node", "m", "space", "vector").mapInArrow(_place(shared), f"node long, m long, space string, vector {kind}, cell int, far double")
    placed = store(placed, "placed")
    _measure(cells, placed, least, block)
    sampled, rest = placed.where("cell >= 0"), placed.where("cell < 0")
    measured = spark.sparkContext.broadcast(cells)
    looks = sampled.mapInArrow(_count_looks(measured, least), "entry int, visits long, bonus long").groupBy("entry").agg(F.sum("visits").alias("visits"), F.sum("bonus").alias("bonus"))
    for r in looks.collect():  # two rows for each centre at most
        cells.slices[r["entry"]], cells.bonus[r["entry"]] = max(1, -(-r["visits"] // VISITORS)), r["bonus"]
    # a large cell's later parts visit its earlier ones
    cells.slices += np.where(cells.core, 0, cells.parts - 1) * block // VISITORS
    ready = spark.sparkContext.broadcast(cells)
    schema = f"space string, entry int, part int, slice int, joins boolean, visitor boolean, node long, m long, vector {kind}"
    blocks = sampled.mapInArrow(_deal(ready, least), schema).unionByName(_small(rest, block))
    keys = ["space", "entry", "part", "slice"]
    dealt = blocks.select(*_BLOCKS).repartition(*keys).sortWithinPartitions(*keys, "visitor")
    found = dealt.mapInArrow(_join(least, block), "node long, links long, other long")
    if cells.core.any():
        found = found.unionByName(sampled.mapInArrow(_wholes(ready, least), "node long, links long, other long"))
    out = store(found, "links")
    discard(placed)
    return out


def _small(rest: DataFrame, block: int) -> DataFrame:
    """Blocks of the spaces without a sample: parts of them, each visited by the later ones."""
    sizes = store(rest.groupBy("space").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")), "spaces")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    placed = attach(rest.select("space", "node", "m", "vector"), sizes.select("space", "parts"), "space", sizes.where(F.col("n") >= max(1, total // 1000)).select("space"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    at = F.explode(F.sequence(F.lit(0), own)).alias("part")
    spread = placed.select("space", F.lit(-1).alias("entry"), at, F.lit(0).alias("slice"), F.lit(True).alias("joins"), own.alias("own"), "node", "m", "vector")
    return spread.select("space", "entry", "part", "slice", "joins", (F.col("part") != F.col("own")).alias("visitor"), "node", "m", "vector")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, least: float = LEAST, block: int = BLOCK, sample: int = SAMPLE_NUMBERS) -> DataFrame:
    """One row per row: id_col, n_links, component_id, kept.

    Vectors of one label and one length link at a cosine of at least ``least``
    in double precision (0 or more).  Vectors that are null or zero, that hold a
    null or non-finite component, or without a label link with nothing.
    n_links counts the other rows linked directly; component_id is the smallest
    id reachable; kept says that it is the row's own.

    Repeated rows and ids are vectors of their own.  Null ids are kept and
    never the smallest unless there is no other.  Other columns are ignored; an
    empty table gives no rows.  Equal vectors are one node with a weight; no
    pair of a group of copies is ever made, nor of a cell's core.
    """
    element = vectors.select(vector_col).schema[0].dataType.elementType.simpleString()
    kind = f"array<{element if element in ('float', 'double') else 'double'}>"
    id_type = vectors.select(id_col).schema[0].dataType.simpleString()
    vector = F.col(vector_col).cast(kind)
    space = F.concat_ws("|", F.size("vector").cast("string"), F.col("label").cast("string"))
    given = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), vector.alias("vector"))
    fine = usable(F.col("vector").cast("array<double>")) & F.col("label").isNotNull()
    given = given.select("vec_id", F.when(fine, space).alias("space"), F.when(fine, F.col("vector")).alias("vector"))
    rows = store(given.mapInArrow(_prepare, f"vec_id {id_type}, space string, vector {kind}, tag binary"), "vectors")
    copies = rows.where("tag is not null").groupBy("tag").agg(
        F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("least"), F.first("space").alias("space"), F.first("vector").alias("vector"))
    nodes = store(copies.withColumn("node", F.monotonically_increasing_id()), "nodes")
    links = near_links(nodes, least, block, sample)
    component = connected(links.select(F.col("node").alias("a"), F.col("other").alias("b"))).select(F.col("a").alias("of"), F.col("b").alias("root"))
    counted = links.groupBy(F.col("node").alias("at")).agg(F.sum("links").alias("links"))
    named = nodes.select("node", "tag", "m", "least").join(component, F.col("node") == F.col("of"), "left").join(counted, F.col("node") == F.col("at"), "left")
    named = store(named.select("tag", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")), "named")
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_tag = store(attach(named, of_root, "root", hot_keys(named, "root", named.count())).select("tag", "n_links", "component_id"), "tags")
    rows = rows.select("vec_id", "tag")
    out = attach(rows, of_tag, "tag", hot_keys(rows, "tag", rows.count()), "left")
    component_id = F.when(F.col("tag").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"))
    return out.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
