"""The k most similar vectors of every vector: a forest of random-projection trees, a shared priority queue, exact reranking.

Each inner node projects on the difference of two randomly drawn vectors; by default some steps move these two to the
means of their sides (``refine``), and the best of several draws is taken.
The forest is fitted on a bounded sample; every vector is indexed in one leaf of each tree. As a query a vector goes to
its own leaves and, by a priority queue that all trees share, to the next leaves whose hyperplanes it lies close to.
Vectors meet in their leaves, where cosines are computed exactly. Leaves that many vectors visit together, of either
tree, are searched in one task, so a vector is shuffled once for each task that it has leaves in and not for each leaf.
"""

from __future__ import annotations

import heapq
import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecframe.runtime import BROADCAST_BYTES, broadcast_if, materialize

#: Equal vectors beyond this number are indexed by their k + 1 smallest ids only; the others take over those answers.
COPIES = 64
#: Unit vectors this close have a cosine that rounds to 1.000000; those closer than ``SAME`` differ by float32's error only.
TIE, SAME = 1e-3, 3e-7
#: Any two vectors this close to a third one are ties of each other.
CLUMP = 4.9e-4
#: Ties of a sampled vector within the sample that make it the anchor of a hot group.
HOT = 4
#: Pairs that are reranked at once, and queries times vectors that are compared at once.
_PAIRS, _PRODUCTS = 1 << 14, 1 << 22
#: Candidates of a query, as a multiple of ``k``, beyond which all its products are computed in double precision.
_MANY = 8
#: Rows of a leaf that its tree of the second level is fitted on, at most.
_SUB_SAMPLE = 4096


@dataclass
class Tree:
    """Inner nodes: unit normals, offsets and children; a child below 0 is leaf ``-child - 1``."""

    normals: np.ndarray
    offsets: np.ndarray
    children: list[tuple[int, int]]
    leaves: int


def fit_tree(sample: np.ndarray, leaf_rows: int, rng: np.random.Generator, starts: int = 6, refine: int = 5) -> Tree:
    """A tree over unit vectors whose leaves hold ``leaf_rows`` of the sample at most.

    A split is a projection on the difference of two vectors drawn at random, the best of ``starts`` draws by the margin
    that it leaves; ``refine`` steps replace the two by the means of their sides, 0 keeps the random projection as drawn.
    """
    normals, offsets, children, leaves = [], [], [], 0

    def split(rows: np.ndarray) -> tuple[np.ndarray, float]:
        best, chosen = -1.0, None
        for _ in range(starts):
            a, b = rows[rng.choice(len(rows), 2, replace=False)]
            for _ in range(refine):
                side = rows @ (a - b) > 0
                if side.all() or not side.any():
                    break
                a, b = (x / max(float(np.linalg.norm(x)), 1e-12) for x in (rows[side].mean(0), rows[~side].mean(0)))
            normal = (a - b) / max(float(np.linalg.norm(a - b)), 1e-12)
            margin = rows @ normal
            share = float((margin > 0).mean())
            score = float(np.quantile(np.abs(margin), 0.1)) * (1 if 0.15 < share < 0.85 else 0.1)
            if score > best:
                best, chosen = score, (normal, margin)
        normal, margin = chosen
        even = 0.1 < float((margin > 0).mean()) < 0.9
        return normal, 0.0 if even else float(np.median(margin))

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf_rows:
            normal, offset = split(rows)
            side = rows @ normal > offset
            if side.any() and not side.all():
                at = len(children)
                normals.append(normal)
                offsets.append(offset)
                children.append((0, 0))
                children[at] = (grow(rows[side]), grow(rows[~side]))
                return at
        leaves += 1
        return -leaves

    grow(sample)
    width = sample.shape[1]
    return Tree(np.array(normals, np.float32).reshape(-1, width), np.array(offsets, np.float32), children, leaves)


def visits(forest: list[Tree], unit: np.ndarray, probes: int, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, tree, leaf, home) of the leaves that each row visits: its home in every tree, then the nearest others.

    One queue for all trees holds the branches not taken, by the distance to the farthest hyperplane on the way there.
    The search ends after ``probes`` leaves, or when the next branch is farther than ``slack``.
    """
    margins = [unit @ t.normals.T - t.offsets for t in forest]
    rows, trees, leaves, homes = [], [], [], []
    for i in range(len(unit)):
        queue = [(-1.0, t, 0 if len(tree.children) else -1) for t, tree in enumerate(forest)]
        found = 0
        while queue and found < max(probes, len(forest)):
            far, t, node = heapq.heappop(queue)
            if far > slack:
                break
            margin, children = margins[t][i], forest[t].children
            while node >= 0:
                m = float(margin[node])
                near, other = children[node] if m > 0 else children[node][::-1]
                heapq.heappush(queue, (max(far, abs(m)), t, other))
                node = near
            rows.append(i)
            trees.append(t)
            leaves.append(-node - 1)
            homes.append(far < 0)
            found += 1
    return np.array(rows, np.int64), np.array(trees, np.int32), np.array(leaves, np.int32), np.array(homes, bool)


def _unit64(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    return _unit64(x).astype(np.float32)


def _ties(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each unit vector the number of those about within :data:`TIE` of it, and whether it is the first of them."""
    count, first = np.zeros(len(unit), np.int64), np.zeros(len(unit), bool)
    for i in range(0, len(unit), 512):
        near = unit[i : i + 512] @ unit.T > 1 - 1e-6
        count[i : i + 512] = near.sum(axis=1)
        first[i : i + 512] = near.argmax(axis=1) >= np.arange(i, i + len(near))
    return count, first


def _anchors(unit: np.ndarray, most: int) -> np.ndarray:
    """Vectors of the sample that have :data:`HOT` ties in it at least, none a tie of another; the hottest first."""
    count, _ = _ties(unit.astype(np.float32))
    left = np.flatnonzero(count >= HOT)
    left = left[np.argsort(-count[left], kind="stable")]
    chosen = []
    while len(left) and len(chosen) < most:
        chosen.append(left[0])
        left = left[np.linalg.norm(unit[left] - unit[left[0]], axis=1) > TIE]
    return unit[chosen]


def _balls(unit: np.ndarray, anchors: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, distance) of the unit vectors within ``radius`` of an anchor."""
    row, at = np.nonzero(unit.astype(np.float32) @ anchors.T.astype(np.float32) > 1 - radius**2 / 2 - 1e-6)
    far = np.zeros(len(row))
    for i in range(0, len(row), _PAIRS):
        far[i : i + _PAIRS] = np.linalg.norm(unit[row[i : i + _PAIRS]] - anchors[at[i : i + _PAIRS]], axis=1)
    return row[far <= radius], at[far <= radius], far[far <= radius]


def _members(anchors, width: int):
    """(anchor, same, id) of the vectors within twice :data:`TIE` of an anchor, which holds all ties of those within once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, at = _matrix(b.column(1), width)
            for i in range(0, len(x), 2048):
                row, anchor, far = _balls(_unit64(x[i : i + 2048]), anchors.value, 2 * TIE)
                ids = b.column(0).take(pa.array(at[i : i + 2048][row]))
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(far <= SAME), ids], ["anchor", "same", "id"])

    return scan


def _answered(hot, width: int, k: int, answer: bool):
    """(id, near) of the vectors whose ``k`` neighbours are all ties of them among the smallest ids near an anchor.

    If not ``answer``: (id, vec) of the vectors to be indexed, which are all but those of an anchor's own direction that
    have an answer and more than ``k`` smaller ids of that direction before them.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, smallest, kept = hot.value
        for b in batches:
            x, at = _matrix(b.column(1), width)
            ids = b.column(0).take(pa.array(at)).to_numpy()
            out, indexed = {}, np.ones(len(x), bool)
            for i in range(0, len(x), 2048):
                unit = _unit64(x[i : i + 2048])
                row, anchor, far = _balls(unit, anchors, TIE)
                for a in np.unique(anchor):
                    others, vectors = smallest[a]
                    q = row[anchor == a]
                    tied = (np.round(unit[q] @ vectors.T, 6) == 1) & (ids[i + q][:, None] != others[None, :])
                    for r, d, t in zip(q, far[anchor == a], tied):
                        to = others[t][:k]
                        if len(to) == k:
                            out[int(ids[i + r])] = to
                            if d <= SAME and ids[i + r] not in kept[a]:
                                indexed[i + r] = False
            if answer:
                near = [[{"far": -1.0, "id": int(y)} for y in to] for to in out.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(near, pa.list_(pa.struct([("far", pa.float64()), ("id", pa.int64())])))], ["id", "near"])
            else:
                stay = pa.array(at[indexed])
                yield pa.RecordBatch.from_arrays([b.column(0).take(stay), b.column(1).take(stay)], ["id", "vec"])

    return scan


def _hot_groups(rows: DataFrame, anchors: np.ndarray, width: int, k: int):
    """The anchors; of each the ``4 k`` smallest ids near it with their unit vectors, and the ``k + 1`` of its direction."""
    sc = rows.sparkSession.sparkContext
    near = materialize(rows.mapInArrow(_members(sc.broadcast(anchors), width), "anchor int, same boolean, id long"))

    def smallest(df: DataFrame, n: int) -> DataFrame:
        return df.withColumn("r", F.dense_rank().over(Window.partitionBy("anchor").orderBy("id"))).where(F.col("r") <= n).select("anchor", "id").distinct()

    first = materialize(smallest(near, 4 * k))
    vectors = rows.join(F.broadcast(first), "id").dropDuplicates(["anchor", "id"]).select("anchor", "id", "vec").toArrow()
    x = _unit64(np.asarray(vectors["vec"].combine_chunks().flatten(), np.float32).reshape(-1, width))
    table = pd.DataFrame({"anchor": vectors["anchor"].to_numpy(), "id": vectors["id"].to_numpy()}).sort_values(["anchor", "id"])
    by = {a: (g["id"].to_numpy(), x[g.index.to_numpy()]) for a, g in table.groupby("anchor")}
    kept = {a: set() for a in by}
    for r in smallest(near.where("same"), k + 1).collect():
        kept[r["anchor"]].add(r["id"])
    return sc.broadcast((anchors, by, kept))


def _numbered(forest: list[Tree], unit: np.ndarray, probes: int, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home) of the leaves that each row visits, the leaves numbered through all trees."""
    before = np.cumsum([0, *[t.leaves for t in forest]], dtype=np.int64)
    got = []
    for i in range(0, max(1, len(unit)), 2048):
        row, tree, leaf, home = visits(forest, unit[i : i + 2048], probes, slack)
        got.append((row + i, before[tree] + leaf, home))
    return tuple(np.concatenate(x) for x in zip(*got))


def _parts(row: np.ndarray, leaf: np.ndarray, leaves: int, most: int) -> np.ndarray:
    """The part of each leaf, from the leaves that the rows of a sample visit.

    At first each leaf is a part. The two with most rows in common are joined, as long as the joined part has no more than
    ``most`` rows of the sample; so leaves of one region, siblings and those of different trees, come together.
    """
    members, rows, near, visited = {x: [x] for x in range(leaves)}, defaultdict(set), defaultdict(set), defaultdict(list)
    for r, x in zip(row.tolist(), leaf.tolist()):
        rows[x].add(r)
        for other in visited[r]:
            near[x].add(other)
            near[other].add(x)
        visited[r].append(x)
    queue = [(-len(rows[a] & rows[b]), a, b) for a in range(leaves) for b in near[a] if a < b]
    heapq.heapify(queue)
    new = leaves
    while queue:
        _, a, b = heapq.heappop(queue)
        if a not in members or b not in members or len(both := rows[a] | rows[b]) > most:
            continue
        members[new], rows[new] = members.pop(a) + members.pop(b), both
        near[new] = {c for c in near.pop(a) | near.pop(b) if c in members}
        for c in near[new]:
            near[c].add(new)
            heapq.heappush(queue, (-len(rows[c] & both), c, new))
        new += 1
    part = np.zeros(leaves, np.int32)
    for i, inside in enumerate(members.values()):
        part[inside] = i
    return part


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors of a list column and their row numbers: right width, all parts finite, not all zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(np.int64)
    at = np.flatnonzero(sizes == width)
    flat = column.take(pa.array(at)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return x[good], at[good]


def _assign(forest, width: int, probes: int, slack: float):
    """(leaf, id, home, vec) of the leaves that each vector visits, the leaves numbered through all trees."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, at = _matrix(b.column(1), width)
            for i in range(0, len(x), 2048):
                block = x[i : i + 2048]
                row, leaf, home = _numbered(forest.value, _unit(block), probes, slack)
                ids = b.column(0).take(pa.array(at[i : i + 2048][row]))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), ids, pa.array(home), _bytes(block[row])], ["leaf", "id", "home", "vec"])

    return scan


def _assign_parts(forest, parts, width: int, probes: int, slack: float):
    """(part, id, leaves, vec) of the parts with leaves that each vector visits, once a part; ``~leaf`` if not its home."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, at = _matrix(b.column(1), width)
            for i in range(0, len(x), 2048):
                block = x[i : i + 2048]
                row, leaf, home = _numbered(forest.value, _unit(block), probes, slack)
                part = parts.value[leaf]
                order = np.lexsort((leaf, part, row))
                row, leaf, home, part = row[order], leaf[order], home[order], part[order]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])]))
                leaves = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(np.where(home, leaf, ~leaf).astype(np.int32)))
                row = row[first]
                ids = b.column(0).take(pa.array(at[i : i + 2048][row]))
                yield pa.RecordBatch.from_arrays([pa.array(part[first]), ids, leaves, _bytes(block[row])], ["part", "id", "leaves", "vec"])

    return scan


def _bytes(x: np.ndarray) -> pa.Array:
    """The rows as binary values."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * 4), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())


def _floats(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The rows of a column of float32 bytes, one copy of them and no Python objects."""
    out = np.empty((len(column), width), np.float32)
    at = 0
    for c in column.chunks:
        if len(c):
            starts = np.frombuffer(c.buffers()[1], np.int64 if pa.types.is_large_binary(c.type) else np.int32)[c.offset : c.offset + len(c) + 1]
            out[at : at + len(c)] = np.frombuffer(c.buffers()[2], np.uint8)[starts[0] : starts[-1]].view(np.float32).reshape(-1, width)
            at += len(c)
    return out


def _nearest(ids: np.ndarray, raw: np.ndarray, unit: np.ndarray, home: np.ndarray, k: int, ask: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query id, neighbour id, cosine rounded to 6) of the k best others of each row among the home rows.

    Products in float32 choose the candidates. Of a query with many, ties mostly, all products are computed in double
    precision; the home rows stand in order of their ids, so a stable sort settles the ties.
    """
    at = np.flatnonzero(home)
    at = at[np.argsort(ids[at], kind="stable")]
    asked = np.arange(len(ids)) if ask is None else np.flatnonzero(ask)
    if not len(at) or not len(asked):
        return
    own, wide = unit[at], None
    step = max(1, min(512, _PRODUCTS // len(at)))
    for i in range(0, len(asked), step):
        q = asked[i : i + step]
        near = unit[q] @ own.T
        same = np.minimum(np.searchsorted(ids[at], ids[q]), len(at) - 1)
        mine = np.flatnonzero(ids[at[same]] == ids[q])
        near[mine, same[mine]] = -9
        if near.shape[1] > k:
            floor = np.partition(near, -k, axis=1)[:, -k] - 1e-5  # beyond float32's error and the rounding
            chosen = near >= np.maximum(floor, -8)[:, None]
        else:
            chosen = near > -8
        many = np.count_nonzero(chosen, axis=1) > _MANY * k
        if many.any():
            wide = _unit64(raw[at]) if wide is None else wide
            rows = np.flatnonzero(many)
            for j in range(0, len(rows), 64):
                r = rows[j : j + 64]
                cosine = np.round(_unit64(raw[q[r]]) @ wide.T, 6)
                cosine[near[r] == -9] = -9
                best = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
                yield np.repeat(ids[q[r]], best.shape[1]), ids[at[best.ravel()]], np.take_along_axis(cosine, best, 1).ravel()
            chosen[many] = False
        row, col = np.nonzero(chosen)
        cosine = np.zeros(len(row))
        for j in range(0, len(row), _PAIRS):
            a, b = raw[q[row[j : j + _PAIRS]]].astype(np.float64), raw[at[col[j : j + _PAIRS]]].astype(np.float64)
            a /= np.abs(a).max(axis=1, keepdims=True)
            b /= np.abs(b).max(axis=1, keepdims=True)
            dot = np.einsum("ij,ij->i", a, b)
            cosine[j : j + _PAIRS] = np.round(dot / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b)), 6)
        to = ids[at[col]]
        order = np.lexsort((to, -cosine, row))
        row, to, cosine = row[order], to[order], cosine[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        yield ids[q[row[rank < k]]], to[rank < k], cosine[rank < k]


def _clumps(ids: np.ndarray, raw: np.ndarray, unit: np.ndarray, home: np.ndarray, ask: np.ndarray, sample: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The neighbours of rows in a clump of more than k ties, from few candidates; these rows are asked no more.

    Every row of a clump is a tie of every other, so its neighbours are the smallest ids among its ties: k + 1 of the
    clump and the rows around it, out to the farthest tie, suffice as candidates.
    """
    anchors = _anchors(_unit64(sample), 16)
    if not len(anchors):
        return
    found = [[] for _ in anchors]
    for i in range(0, len(ids), 4096):
        row, anchor, far = _balls(_unit64(raw[i : i + 4096]), anchors, 2 * TIE)
        for a in np.unique(anchor):
            found[a].append((row[anchor == a] + i, far[anchor == a]))
    for parts in found:
        row, far = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0))
        clump, around = row[far <= CLUMP], row[far > CLUMP]
        inner = clump[home[clump]]
        asked = clump[ask[clump]]
        if len(inner) <= k or not len(asked):
            continue
        few = np.concatenate([inner[np.argsort(ids[inner], kind="stable")[: k + 1]], around[home[around]]])
        at = np.concatenate([few, asked])
        yield from _nearest(ids[at], raw[at], unit[at], np.arange(len(at)) < len(few), k, np.arange(len(at)) >= len(few))
        ask[asked] = False


def _search(width: int, k: int, leaf_rows: int, probes: int, slack: float, refine: int):
    """The search within one leaf; a leaf that the sample left too large is split again by a tree of its own."""

    def inside(ids, raw, unit, home, ask, rng) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if home.sum() <= 2 * leaf_rows:
            yield from _nearest(ids, raw, unit, home, k, ask)
            return
        own = unit[home]
        sample = own[rng.choice(len(own), min(len(own), 4096), replace=False)]
        count, first = _ties(sample)
        if (count >= HOT).any():
            yield from _clumps(ids, raw, unit, home, ask, sample, k)
        tree = fit_tree(sample[first], max(8, len(sample) * leaf_rows // len(own)), rng, refine=refine)
        if tree.leaves == 1:
            yield from _nearest(ids, raw, unit, home, k, ask)
            return
        row, _, leaf, nearest = visits([tree], unit, probes, slack)
        for x in range(tree.leaves):
            at = row[leaf == x]
            if len(at):
                yield from inside(ids[at], raw[at], unit[at], home[at] & nearest[leaf == x], ask[at], rng)

    def search(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        _, once = np.unique(ids, return_index=True)
        table = table.take(pa.array(once))  # by id, so that the same rows give the same trees in any order
        ids, home = table["id"].to_numpy(), table["home"].to_numpy()
        raw = _floats(table["vec"], width)
        rng = np.random.default_rng(int(table["leaf"][0].as_py()) + 1)
        got = [x for x in inside(ids, raw, _unit(raw), home, np.ones(len(ids), bool), rng) if len(x[0])]
        q, to, cosine = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        alone = np.setdiff1d(ids[home], q)  # they get an empty list, to be completed
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([starts, np.full(len(alone) + 1, len(q))]).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array(-cosine), pa.array(to)], names=["far", "id"]),
        )
        return pa.table({"id": pa.array(np.concatenate([q[starts], alone]), pa.int64()), "near": lists})

    return search


def _search_parts(width: int, k: int, leaf_rows: int, probes: int, slack: float, refine: int):
    """The search within the leaves of one part, each on its own; of each id the ``k`` best of them all."""
    inside = _search(width, k, leaf_rows, probes, slack, refine)

    def search(table: pa.Table) -> pa.Table:
        leaves = table["leaves"].combine_chunks()
        row, leaf = np.repeat(np.arange(len(leaves)), leaves.value_lengths().to_numpy()), leaves.flatten().to_numpy()
        home = leaf >= 0
        leaf = np.where(home, leaf, ~leaf).astype(np.int64)
        found = []
        for x in np.unique(leaf):
            at = np.flatnonzero(leaf == x)
            rows = table.select(["id", "vec"]).take(pa.array(row[at]))
            found.append(inside(pa.table({"leaf": pa.array(leaf[at]), "id": rows["id"], "home": pa.array(home[at]), "vec": rows["vec"]})))
        return _best(pa.concat_tables(found), k)

    return search


def _best(found: pa.Table, k: int) -> pa.Table:
    """(id, near) with one list for each id, as :func:`_merged` makes it."""
    ids, near = found["id"].to_numpy(), found["near"].combine_chunks()
    q, hits = np.repeat(ids, near.value_lengths().to_numpy()), near.flatten()
    far, to = hits.field(0).to_numpy(), hits.field(1).to_numpy()
    order = np.lexsort((to, far, q))
    q, far, to = q[order], far[order], to[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (far[1:] != far[:-1]) | (to[1:] != to[:-1])
    q, far, to = q[fresh], far[fresh], to[fresh]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    q, far, to = q[kept], far[kept], to[kept]
    ids = np.unique(ids)
    lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(q, ids), len(q)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(far), pa.array(to)], names=["far", "id"]))
    return pa.table({"id": pa.array(ids, pa.int64()), "near": lists})


def _subtree(width: int, leaf_rows: int, expected: int, refine: int):
    """A leaf's own tree, pickled, from a sample of its rows; the same for the same rows in any order."""

    def fit(table: pa.Table) -> pa.Table:
        order = np.argsort(table["id"].to_numpy(), kind="stable")[:_SUB_SAMPLE]
        unit = _unit(_floats(table["vec"].take(pa.array(order)), width))
        rng = np.random.default_rng(int(table["leaf"][0].as_py()) + 1)
        tree = fit_tree(unit[_ties(unit)[1]], max(8, len(unit) * leaf_rows // max(1, expected)), rng, refine=refine)
        return pa.table({"leaf": table["leaf"][:1], "blob": pa.array([pickle.dumps(tree)], pa.binary())})

    return fit


def _descend(width: int, probes: int, slack: float):
    def descend(rows: pa.Table, trees: pa.Table) -> pa.Table:
        if not len(rows):
            return rows.select(["leaf", "id", "home", "vec"])
        tree = pickle.loads(trees["blob"][0].as_py()) if len(trees) else Tree(np.zeros((0, width), np.float32), np.zeros(0, np.float32), [], 1)
        row, _, leaf, first = visits([tree], _unit(_floats(rows["vec"], width)), probes, slack)
        out = rows.take(pa.array(row))
        home = out["home"].to_numpy() & first
        return pa.table({"leaf": pa.array(out["leaf"].to_numpy() * (1 << 20) + leaf, pa.int64()), "id": out["id"], "home": pa.array(home), "vec": out["vec"]})

    return descend


def _refined(placed: DataFrame, width: int, expected: int, leaf_rows: int, group_rows: int, probes: int, slack: float, seed: int, refine: int) -> DataFrame:
    """The rows in leaves of a second level: each leaf's own tree is fitted in one task on a sample of bounded size.

    Rows meet their leaf's tree in groups of about ``group_rows`` rows, so no task holds a whole leaf of the first level.
    """
    sizes = materialize(placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(group_rows)).cast("int").alias("parts")))
    share = min(1.0, 2 * _SUB_SAMPLE / expected)
    sample = placed.where("home").where(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 20)) <= int(share * (1 << 20)))
    trees = materialize(sample.groupBy("leaf").applyInArrow(_subtree(width, leaf_rows, expected, refine), "leaf long, blob binary"))
    number = sizes.count()
    salted = placed.join(broadcast_if(sizes, number, 32), "leaf").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    copies = trees.join(broadcast_if(sizes, number, 32), "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), "blob")
    keys = ["leaf", "salt"]
    return salted.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(_descend(width, probes, slack), "leaf long, id long, home boolean, vec binary")


def _exact(asked, width: int, k: int):
    """(id, near) of a block of asked vectors within each partition, by brute force."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw = asked.value
        unit, best = _unit(raw), {}
        for b in batches:
            x, at = _matrix(b.column(1), width)
            others = b.column(0).take(pa.array(at)).to_numpy()
            for i in range(0, len(x), 4096):
                both, rows = np.concatenate([ids, others[i : i + 4096]]), np.concatenate([raw, x[i : i + 4096]])
                home = np.arange(len(both)) >= len(ids)
                for q, to, cosine in _nearest(both, rows, np.concatenate([unit, _unit(x[i : i + 4096])]), home, k, ~home):
                    for a, y, c in zip(q.tolist(), to.tolist(), cosine.tolist()):
                        best.setdefault(a, set()).add((-c, y))
                for a, found in best.items():
                    best[a] = set(sorted(found)[:k])
        near = [[{"far": f, "id": y} for f, y in sorted(v)] for v in best.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(near, pa.list_(pa.struct([("far", pa.float64()), ("id", pa.int64())])))], ["id", "near"])

    return scan


def _completed(best: DataFrame, rows: DataFrame, width: int, k: int) -> DataFrame:
    """``best`` with lists that the forest left too short replaced: their vectors, in blocks, against all rows."""
    best = materialize(best)
    sizes = {r[0]: r[1] for r in best.groupBy(F.size("near")).count().collect()}  # k + 1 rows at most
    need = min(k, sum(sizes.values()) - 1)
    if need < 1:
        return best.limit(0)
    if min(sizes) >= need:
        return best
    short = best.where(F.size("near") < need).select("id")
    asked = materialize(rows.join(short, "id", "left_semi").dropDuplicates(["id"]))
    size = max(1, BROADCAST_BYTES // (8 * width))
    blocks = max(1, -(-asked.count() // size))
    parts = []
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toArrow()
        x, at = _matrix(block["vec"], width)
        shared = rows.sparkSession.sparkContext.broadcast((block["id"].to_numpy()[at], x))
        parts.append(rows.mapInArrow(_exact(shared, width, k), "id long, near array<struct<far:double,id:long>>"))
    return best.join(short, "id", "left_anti").unionByName(_merged(reduce(DataFrame.unionAll, parts), k))


def _merged(found: DataFrame, k: int) -> DataFrame:
    return found.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))


def nearest_neighbors(df: DataFrame, id_col: str, vec_col: str, width: int, k: int = 10, trees: int = 2, probes: int = 4, slack: float = 0.05, leaf_rows: int = 2000, sample_rows: int = 8192, group_rows: int = 16_000, seed: int = 7, refine: int = 5, most_sample_rows: int = 65_536) -> DataFrame:
    """(id, near): for each usable vector its ``k`` most similar others, near being an array of (far = -cosine, id).

    Cosines are computed in double precision and rounded to 6 decimals; equal ones go by the smaller id. Vectors that are
    null, of another width, not finite or all zero take no part; an id that is delivered more than once counts once; an
    empty table, or a single vector, gives no rows. The forest is fitted on ``sample_rows`` rows, or, if these are less, on
    one of 500, but on ``most_sample_rows`` at most, chosen by the hash of their id; all rows are indexed. If by the sample
    the largest leaf would hold more than ``group_rows`` rows, each gets a second level of its own, fitted in the same way
    by the executors. A vector for which the leaves hold fewer than ``k`` others is compared with all rows. Vectors that are ties of a sampled
    vector with many ties (a hot group, of equal direction or nearly so) get the smallest ids of their ties, each compared
    in double precision; of one direction only those with the ``k + 1`` smallest ids are indexed. Of more than :data:`COPIES` equal vectors only the
    ``k + 1`` smallest ids are indexed, which is enough to answer exactly for all of them.
    """
    spark = df.sparkSession
    hashes = [F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2")]
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).where(F.col("id").isNotNull() & (F.size("vec") == width))
    keys = materialize(rows.select("id", *hashes).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).groupBy((F.col("n") > COPIES).alias("heavy"), F.when(F.col("n") > COPIES, F.col("h1")).alias("h1"), F.when(F.col("n") > COPIES, F.col("h2")).alias("h2")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("vectors")))
    size = keys.agg(F.sum("n"), F.count(F.when(F.col("heavy"), 1))).first()
    total, heavy = size[0] or 0, size[1]
    indexed = rows
    if heavy:
        heavies = broadcast_if(keys.where("heavy").select("h1", "h2"), heavy, 64)
        ranked = rows.select("id", *hashes).join(heavies, ["h1", "h2"]).select("h1", "h2", "id", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("id")).alias("r")).where(F.col("r") <= k + 1)
        chosen = materialize(ranked.groupBy("h1", "h2").agg(F.array_sort(F.collect_set("id")).alias("kept")))
        marked = rows.select("id", "vec", *hashes).join(broadcast_if(chosen, heavy, 200), ["h1", "h2"], "left")
        indexed = marked.where(F.col("kept").isNull() | F.array_contains("kept", F.col("id"))).select("id", "vec")
    sample_rows = min(max(sample_rows, total // 500), max(sample_rows, most_sample_rows))
    share = min(1.0, 1.2 * sample_rows / max(total, 1))  # some of these vectors may be unusable
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) <= int(share * (1 << 20))).limit(sample_rows + sample_rows // 2).toArrow()
    picked = picked.take(pa.array(np.argsort(picked["id"].to_numpy(), kind="stable")))
    x, _ = _matrix(picked["vec"], width) if len(picked) else (np.zeros((0, width), np.float32), None)
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))[:sample_rows]]
    in_leaf = max(8, int(len(x) * leaf_rows / max(total, 1)))
    wide = _unit64(x) if len(x) else x
    anchors = _anchors(wide[:8192], max(1, BROADCAST_BYTES // (32 * k * width)))
    if len(anchors):
        hot = _hot_groups(rows, anchors, width, k)
        indexed = indexed.mapInArrow(_answered(hot, width, k, False), "id long, vec array<float>")
        same, _, _ = _balls(wide, anchors, SAME)
        wide = np.concatenate([np.delete(wide, same, axis=0), anchors])
    x = wide.astype(np.float32)
    forest = spark.sparkContext.broadcast([fit_tree(x, in_leaf, rng, refine=refine) for _ in range(trees)])
    row, leaf, home = _numbered(forest.value, x, probes, slack)
    expected = int(np.bincount(leaf[home]).max() if len(x) else 0) * total // max(1, len(x))
    if expected > group_rows:
        placed = indexed.mapInArrow(_assign(forest, width, probes, slack), "leaf long, id long, home boolean, vec binary")
        placed = _refined(placed, width, expected, leaf_rows, group_rows, 2, slack, seed, refine)
        placed = placed.repartition(max(1, -(-total * trees // leaf_rows)), "leaf")
        found = placed.groupBy("leaf").applyInArrow(_search(width, k, leaf_rows, probes, slack, refine), "id long, near array<struct<far:double,id:long>>")
    else:  # parts are numbered, so that each task gets one of them
        part_rows = min(group_rows, max(2 * leaf_rows, total // spark.sparkContext.defaultParallelism))
        parts = _parts(row, leaf, sum(t.leaves for t in forest.value), part_rows * len(x) // max(1, total))
        placed = indexed.mapInArrow(_assign_parts(forest, spark.sparkContext.broadcast(parts), width, probes, slack), "part int, id long, leaves array<int>, vec binary")
        placed = placed.repartitionById(int(parts.max()) + 1, "part")
        found = placed.groupBy("part").applyInArrow(_search_parts(width, k, leaf_rows, probes, slack, refine), "id long, near array<struct<far:double,id:long>>")
    best = _completed(_merged(found, k), indexed, width, k)
    if heavy:
        answers = chosen.select("h1", "h2", "kept", F.col("kept")[0].alias("id")).join(best, "id")
        whole = F.slice(F.array_sort(F.concat(F.array(F.struct(F.lit(-1.0).alias("far"), F.col("id").alias("id"))), "near")), 1, k)
        taken = answers.select("h1", "h2", "kept", whole.alias("near"))
        others = rows.select("id", *hashes).join(broadcast_if(taken, heavy, 400), ["h1", "h2"]).where(~F.array_contains("kept", F.col("id")))
        best = best.unionByName(others.select("id", "near").dropDuplicates(["id"]))
    if len(anchors):
        answers = materialize(rows.mapInArrow(_answered(hot, width, k, True), "id long, near array<struct<far:double,id:long>>").dropDuplicates(["id"]))
        best = best.join(broadcast_if(answers.select("id"), answers.count(), 16), "id", "left_anti").unionByName(answers)
    return best


def p2_neighbors(docs: DataFrame) -> DataFrame:
    return nearest_neighbors(docs, "adv_id", "embedding", 384)


def p2_pairs(docs: DataFrame) -> DataFrame:
    """(adv_id_a, adv_id_b), a < b: pairs of which at least one is among the ten nearest of the other."""
    pairs = p2_neighbors(docs).select("id", F.explode("near.id").alias("to"))
    return pairs.select(F.least("id", "to").alias("adv_id_a"), F.greatest("id", "to").alias("adv_id_b")).distinct()
