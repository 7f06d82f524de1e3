"""Cover trees over the integer points of a block, and nearest-entry assignment of whole subtrees.

A tree's nodes have a centre, which is one of the points, and cover the points below them: the
children of a node are centres more than half its cover radius apart, and each point goes to the
first of them within that distance. Equal points are one. Points are kept in an order in which
every node's are consecutive, with cumulative sums, so that a node's count and sum are differences.

All distances are exact: squares and sums are below 2**53, where doubles hold every integer.
"""

from __future__ import annotations

import io
from dataclasses import astuple, dataclass, fields

import numpy as np

#: Points from which on a node is divided further.
LEAF = 8


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all ``points`` to all ``entries``."""
    one, other = points.astype(np.float64), entries.astype(np.float64)
    return (one * one).sum(axis=1)[:, None] - 2 * (one @ other.T) + (other * other).sum(axis=1)[None, :]


@dataclass(frozen=True)
class CoverTree:
    #: For every row of the block its place among the ordered distinct points.
    place: np.ndarray
    #: The distinct points in order, and how many rows each stands for.
    points: np.ndarray
    weights: np.ndarray
    #: Of every node: its centre's place, squared radius, first and last place, first and last child.
    centre: np.ndarray
    radius: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray
    last: np.ndarray

    def dumped(self) -> bytes:
        file = io.BytesIO()
        np.savez(file, **dict(zip((f.name for f in fields(self)), astuple(self))))
        return file.getvalue()

    @staticmethod
    def loaded(data: bytes) -> CoverTree:
        with np.load(io.BytesIO(data)) as held:
            return CoverTree(**held)


def net(centre: int, members: np.ndarray, apart: np.ndarray, square: float) -> list[tuple[int, np.ndarray]]:
    """Centres among ``members`` whose squared distances exceed ``square``, each with the members it is first to cover."""
    out, left = [], members
    while len(left):
        near = apart[centre, left] <= square
        out.append((centre, left[near]))
        left = left[~near]
        centre = int(left[0]) if len(left) else centre
    return out


def built(rows: np.ndarray) -> CoverTree:
    """The tree of a block's rows of integers; a block has one row at least."""
    distinct, owner, weights = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    apart = squares(distinct, distinct)
    order = np.zeros(len(distinct), np.int64)
    nodes = [[0, 0.0, 0, len(distinct), 0, 0]]
    todo = [(0, 0, np.arange(len(distinct)))]
    for number, centre, members in todo:
        node = nodes[number]
        radius = float(apart[centre, members].max())
        node[0], node[1], at = centre, radius, node[2]
        if len(members) < LEAF or radius == 0:
            order[at : at + len(members)] = members
            continue
        # Children lie within half the power of two that covers the node, so a square within a quarter.
        square = 4.0 ** np.ceil(np.log2(radius) / 2) / 4
        node[4] = len(nodes)
        for inner, held in net(centre, members, apart, square):
            todo.append((len(nodes), inner, held))
            nodes.append([inner, 0.0, at, at + len(held), 0, 0])
            at += len(held)
        node[5] = len(nodes)
    where = np.empty_like(order)
    where[order] = np.arange(len(order))
    centre, radius, begin, end, child, last = map(np.array, zip(*nodes))
    whole = [x.astype(np.int32) for x in (where[centre], begin, end, child, last)]
    kind = np.int32 if not len(distinct) or np.abs(distinct).max(initial=0) < 1 << 31 else np.int64
    return CoverTree(
        where[owner.ravel()].astype(np.int32), distinct[order].astype(kind), weights[order].astype(np.int64),
        whole[0], radius, *whole[1:],
    )


@dataclass(frozen=True)
class Assigned:
    #: Runs of points, by first and last place, with the entry that is nearest to all of each.
    begin: np.ndarray
    end: np.ndarray
    entry: np.ndarray
    #: Centres and points that were compared with the entries.
    compared: int


def assigned(tree: CoverTree, entries: np.ndarray) -> Assigned:
    """The nearest entry of every point, the first of equal ones.

    A node's points all have its centre's nearest entry if that is nearer than any other by more than
    twice the node's radius. Otherwise its children are looked at, or the points of a leaf one by one.
    """
    begins, ends, found, compared = [], [], [], 0
    # Of equal entries only the first is ever nearest; the others would leave every node in doubt.
    number = np.sort(np.unique(entries, axis=0, return_index=True)[1])
    entries = entries[number]

    def settle(begin: np.ndarray, end: np.ndarray, entry: np.ndarray) -> None:
        begins.append(begin), ends.append(end), found.append(number[entry])

    at, single = np.zeros(1, np.int64), []
    while len(at):
        far = squares(tree.points[tree.centre[at]], entries)
        compared += len(at)
        nearest = far.argmin(axis=1)
        if far.shape[1] > 1:
            first, second = np.sqrt(np.partition(far, 1, axis=1)[:, :2].T)
            # Square roots are rounded; what is that close counts as ambiguous.
            sure = second - first > 2 * np.sqrt(tree.radius[at]) * (1 + 1e-9) + 1e-6
        else:
            sure = np.ones(len(at), bool)
        sure |= tree.end[at] - tree.begin[at] == 1
        settle(tree.begin[at[sure]], tree.end[at[sure]], nearest[sure])
        at = at[~sure]
        leaf = tree.child[at] == tree.last[at]
        single.append(spread(tree.begin[at[leaf]], tree.end[at[leaf]]))
        at = spread(tree.child[at[~leaf]], tree.last[at[~leaf]])
    points = np.concatenate(single)
    if len(points):
        compared += len(points)
        settle(points, points + 1, squares(tree.points[points], entries).argmin(axis=1))
    return Assigned(np.concatenate(begins), np.concatenate(ends), np.concatenate(found), compared)


def spread(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of some ranges."""
    counts = (end - begin).astype(np.int64)
    return np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


def sums(tree: CoverTree, runs: Assigned, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of rows and componentwise sum of what each of ``count`` entries was given."""
    weights = tree.weights[:, None]
    upto = np.zeros((len(tree.points) + 1, 1 + tree.points.shape[1]), np.int64)
    np.cumsum(np.hstack([weights, weights * tree.points.astype(np.int64)]), axis=0, out=upto[1:])
    out = np.zeros((count, upto.shape[1]), np.int64)
    np.add.at(out, runs.entry, upto[runs.end] - upto[runs.begin])
    return out[:, 0], out[:, 1:]


def entries_of(tree: CoverTree, runs: Assigned) -> np.ndarray:
    """The entry of every row of the block."""
    out = np.empty(len(tree.points), np.int64)
    out[spread(runs.begin, runs.end)] = np.repeat(runs.entry, runs.end - runs.begin)
    return out[tree.place]
