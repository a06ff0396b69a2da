"""Cover tree over norm-augmented integer vectors, for inner product windows.

Every vector gets one more component, ``sqrt(M**2 - |x|**2)`` with the block's
largest norm ``M``: all then lie on a sphere of radius ``M``, and the inner
product with a query (whose extra component is 0) falls as the distance grows.

The tree is a cover tree: the members of a node lie within its covering radius;
its children are a net of its members (the node's own centre first), more than
the level's radius apart from each other and within it of the members they
cover. Level radii shrink by ``BASE``. A covering radius ``rho`` is the angle
``phi`` on the sphere, so with the angle ``theta`` between query and centre all
inner products below a node lie between ``|q| M cos(theta + phi)`` and
``|q| M cos(theta - phi)``.

The descent takes the node with the highest upper bound first. A query skips a
node when none of its windows meets the bounds: the node lies above the window,
below it, or below what the window's best rows reach already. Members of leaves
are verified by their exact integer products.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, fields

import numpy as np

from tally.llm.vectors import EXACT

BASE = 1.3
LEAF = 24
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
NO_ID = MOST  # a null id: last among ties


@dataclass
class CoverTree:
    """Points (rows of integers) in the order of the tree, and its nodes, the
    children of a node in one run. ``low``/``high``: labels below a node."""
    points: np.ndarray
    uids: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    start: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, uids: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> CoverTree:
        x = points.astype(np.float64)
        norms = (x * x).sum(1)
        rest = np.sqrt(norms.max() - norms)
        far = np.sqrt(np.maximum(0.0, 2.0 * (norms.max() - x @ x.T - rest[:, None] * rest)))
        np.fill_diagonal(far, 0.0)
        root = int(np.argmin(far.max(1)))
        top = far[root].max()
        # Nodes in breadth-first order: (centre, members, place of the first member).
        nodes, order, at = [(root, np.arange(len(x)))], np.arange(len(x)), 0
        start, child, children = [0], [], []
        while at < len(nodes):
            centre, members = nodes[at]
            reach = far[centre, members].max()
            child.append(len(nodes))
            if len(members) > LEAF and reach > 0:
                level = top
                while level >= reach:
                    level /= BASE
                net, nearest, owner = [centre], far[centre, members].copy(), np.zeros(len(members), np.int64)
                while True:
                    out = int(np.argmax(nearest))
                    if nearest[out] <= level:
                        break
                    new = int(members[out])
                    to = far[new, members]
                    owner[to < nearest] = len(net)
                    nearest = np.minimum(nearest, to)
                    net.append(new)
                first = start[at]
                by = np.argsort(owner, kind="stable")
                order[first:first + len(members)] = members[by]
                sizes = np.bincount(owner, minlength=len(net))
                for c, part in zip(net, np.split(members[by], np.cumsum(sizes)[:-1])):
                    nodes.append((c, part))
                    start.append(first)
                    first += len(part)
            children.append(len(nodes) - child[-1])
            at += 1
        start = np.array(start)
        end = start + np.array([len(m) for _, m in nodes])
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        # Covering radii and labels as they are, from the members.
        return cls(points[order], uids[order], ids[order], labels[order], start, end,
                   np.array([place[c] for c, _ in nodes]), np.array([far[c, m].max() for c, m in nodes]),
                   np.array(child), np.array(children), np.array([labels[m].min() for _, m in nodes]),
                   np.array([labels[m].max() for _, m in nodes]))

    def to_binary(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, f.name)).tobytes() for f in fields(self)]

    @classmethod
    def from_binary(cls, width: int, raw: list[bytes]) -> CoverTree:
        out = cls(*(np.frombuffer(b, np.float64 if f.name == "radius" else np.int64) for f, b in zip(fields(cls), raw)))
        out.points = out.points.reshape(-1, width)
        return out

    def __post_init__(self) -> None:
        self._ready = None

    def _bounds(self) -> tuple:
        """Points as doubles, the norm of the sphere, cosine and sine of every
        node's covering angle: made once."""
        if self._ready is None:
            x = self.points.astype(np.float64)
            norm = float(np.sqrt((x * x).sum(1).max()))
            cos = np.clip(1.0 - self.radius ** 2 / (2.0 * norm * norm), -1.0, 1.0) if norm else np.ones(len(self.radius))
            self._ready = x, norm, cos, np.sqrt(1.0 - cos * cos)
        return self._ready

    def search(self, queries: np.ndarray, best: Best, labels: np.ndarray, same: bool, uids: np.ndarray) -> None:
        """Offers ``best`` every row that can be in a window of a query, of the
        query's label (``same``) or of others; the row with the query's own uid
        is left out. All queries descend together: a node carries those that
        may not skip it, and the node with the highest bound of any is next."""
        x, norm, cos, sin = self._bounds()
        q = queries.astype(np.float64)
        lengths = np.sqrt((q * q).sum(1))
        scales = np.maximum(lengths * norm, 1e-300)
        exact = bool((lengths * norm).max(initial=0) < EXACT / 4)
        all_queries = np.arange(len(q))
        heap = [(-np.inf, 0, all_queries, np.full(len(q), np.inf))]
        while heap:
            _, node, asks, upper = heapq.heappop(heap)
            asks = asks[upper >= best.reached[asks].min(1)]
            if not len(asks):
                continue
            if not self.children[node]:  # a leaf: verified as it is
                self._verify(np.arange(self.start[node], self.end[node]), asks, queries, q, best, labels, same, uids, exact)
                continue
            kids = np.arange(self.child[node], self.child[node] + self.children[node])
            low, high, label = self.low[kids][:, None], self.high[kids][:, None], labels[asks]
            alive = (low <= label) & (label <= high) if same else (low != label) | (high != label)
            scale = scales[asks]
            slack = 1e-9 * scale + 1e-6
            cos_q = np.clip(x[self.centre[kids]] @ q[asks].T / scale, -1.0, 1.0)
            sin_q = np.sqrt(1.0 - cos_q * cos_q)
            c, s = cos[kids][:, None], sin[kids][:, None]
            upper = np.where(cos_q < c, cos_q * c + sin_q * s, 1.0) * scale + slack
            lower = np.where(cos_q > -c, cos_q * c - sin_q * s, -1.0) * scale - slack
            alive &= best.meets(asks, lower, upper)
            some = alive.any(1)
            # Leaves of one member are verified at once, all others in their turn.
            one = some & (self.end[kids] - self.start[kids] == 1)
            for k in np.flatnonzero(some & ~one).tolist():
                own = alive[k]
                heapq.heappush(heap, (-float(upper[k, own].max()), int(kids[k]), asks[own], upper[k, own]))
            if one.any():
                met = alive[one].any(0)
                self._verify(self.start[kids[one]], asks[met], queries, q, best, labels, same, uids, exact)

    def _verify(self, members, asks, queries, q, best: Best, labels, same, uids, exact) -> None:
        if exact:
            scores = np.rint(self._bounds()[0][members] @ q[asks].T).astype(np.int64)
        else:
            scores = (self.points[members].astype(object) @ queries[asks].T.astype(object)).astype(np.int64)
        fits = ((self.labels[members][:, None] == labels[asks]) == same) & (self.uids[members][:, None] != uids[asks])
        best.offer(asks, scores, fits, self.ids[members], self.uids[members])


class Best:
    """The best ``k`` rows of every window ``[low, high]`` of scores (long
    integers, a row per query, a column per window): highest score first, then
    smallest id, then smallest uid."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.high, self.k = high, k
        self.reached = low.copy()  # below it nothing enters a window any more
        n = low.size
        self.held = np.zeros(n, np.int64)
        self.scores, self.ids, self.uids = (np.zeros((n, k), np.int64) for _ in range(3))

    def meets(self, asks: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        return ((upper[:, :, None] >= self.reached[asks]) & (lower[:, :, None] <= self.high[asks])).any(2)

    def offer(self, asks: np.ndarray, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        inside = (fits[:, :, None] & (scores[:, :, None] >= self.reached[asks])
                  & (scores[:, :, None] <= self.high[asks]))
        row, ask, window = np.nonzero(inside)
        if not len(row):
            return
        place = asks[ask] * self.high.shape[1] + window
        hit = np.unique(place)
        # What the windows hit hold already, and what comes.
        n = self.held[hit]
        old = np.repeat(hit, n)
        at = np.arange(len(old)) - np.repeat(np.cumsum(n) - n, n)
        place = np.concatenate([old, place])
        s, i, u = (np.concatenate([a[old, at], b]) for a, b in
                   ((self.scores, scores[row, ask]), (self.ids, ids[row]), (self.uids, uids[row])))
        order = np.lexsort((u, i, -s, place))
        place = place[order]
        first = np.searchsorted(place, hit)
        rank = np.arange(len(place)) - np.repeat(first, np.diff(np.append(first, len(place))))
        keep = rank < self.k
        order, place, rank = order[keep], place[keep], rank[keep]
        self.scores[place, rank], self.ids[place, rank], self.uids[place, rank] = s[order], i[order], u[order]
        self.held[hit] = np.minimum(self.k, np.diff(np.append(first, len(keep))))
        full = hit[self.held[hit] == self.k]
        self.reached.reshape(-1)[full] = self.scores[full, self.k - 1]

    def found(self) -> tuple[np.ndarray, ...]:
        """Query, window, score, id and uid of all rows held."""
        place = np.repeat(np.arange(len(self.held)), self.held)
        at = np.arange(len(place)) - np.repeat(np.cumsum(self.held) - self.held, self.held)
        windows = self.high.shape[1]
        return place // windows, place % windows, self.scores[place, at], self.ids[place, at], self.uids[place, at]
