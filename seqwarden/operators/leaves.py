"""The only sequential piece of template mining: clusters inside one route.

Inside a route, a message joins the most similar cluster and generalizes it, or opens
a new one, so order matters. Spark partitions and sorts the rows; these helpers walk
one route at a time over arrays of integer-coded tokens. Clusters and messages
are found through sorted arrays by (position, token), so a step looks only at those that can
reach the threshold, and a token of a template takes about a dozen bytes.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd

from seqwarden.fixed_values import WILDCARD

WILD = 0  # code of the wildcard
DENSE = 48  # clusters up to which all are compared at once
SHORT = 128  # tokens of a message; of shorter ones as many times more clusters are compared at once
PAIRED = 256  # clusters met by single tokens from which on only those met by two are compared
COMPARED = 1 << 18  # tokens compared at once
ROWS_OUT = 10_000  # rows handed on at once
STRETCH = ["_leaf", "_msg", "_from", "_to", "_cluster", "_n"]


class Coder:
    """Integer codes for the tokens of one route."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {WILDCARD: WILD}

    def encode(self, message: str) -> np.ndarray:
        codes = self.codes
        return np.array([codes.setdefault(t, len(codes)) for t in message.split(" ")], dtype=np.int32)


class Postings:
    """Rows of a table of codes by (position, code): for each position the row numbers sorted by code, 8 bytes a code."""

    def __init__(self, table: np.ndarray, start: int = 0) -> None:
        self.n, length = table.shape
        self.start = start
        self.width = int(table.max()) + 2  # the last code is that of no row
        self.keys = np.empty(table.size, np.int32 if length * self.width < 1 << 31 else np.int64)
        self.rows = np.empty(table.size, np.int32)
        for p in range(length):
            own, order = slice(p * self.n, (p + 1) * self.n), np.argsort(table[:, p])
            self.keys[own] = table[order, p]
            self.keys[own] += p * self.width
            self.rows[own] = order
        self.rows += start

    def spans(self, positions: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``rows`` those that hold each code at its position begin and end."""
        asked = (positions * self.width + np.minimum(codes, self.width - 1)).astype(self.keys.dtype)
        return self.keys.searchsorted(asked, "left"), self.keys.searchsorted(asked, "right")


def least_equal(length: int, threshold: float) -> int:
    """The smallest number of equal positions that reaches the threshold."""
    return next(n for n in range(length + 1) if n / length >= threshold)


class Clusters:
    """Templates of one route, in the order they were opened, with indexes of the clusters by position and token.

    A cluster with ``need`` equal positions of ``length`` shares at least one of any ``length - need + 1`` of
    the message's tokens, and two of one more: the rarest ones are asked. The index is a list of ``Postings`` of runs of
    clusters, each run longer than the next, and the last few clusters are in none. It keeps the tokens that a
    template has lost since, so it may name a cluster too many, which the comparison drops; the wildcards are listed apart.
    """

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold
        self.table = np.zeros((0, 0), dtype=np.int32)
        self.n, self.need = 0, 0
        self.stamps: list[int] = []  # how often each template has changed
        self.runs: list[Postings] = []
        self.indexed = 0  # clusters in the runs
        self.wild: dict[int, array] = {}  # position -> clusters with the wildcard there

    @property
    def templates(self) -> np.ndarray:
        return self.table[: self.n]

    def best(self, message: np.ndarray) -> tuple[int, int]:
        """Cluster with the most equal positions (the earliest of equals) and that number, if it reaches the threshold, else -1, -1."""
        if not self.need:
            return self._most_equal(message, None, 0) if self.n else (-1, -1)
        found, top = self._most_equal(message, self._asked(message), -1) if self.indexed else (-1, -1)
        last, more = self._most_equal(message, None, self.indexed)
        if more > top:
            found, top = last, more
        return (found, top) if top >= self.need else (-1, -1)

    def _most_equal(self, message: np.ndarray, at: np.ndarray | None, start: int) -> tuple[int, int]:
        """The earliest of the clusters ``at`` (None: all from ``start`` on) with the most equal positions, and that number; -1, -1 of none."""
        found, top, step = -1, -1, max(1, COMPARED // len(message))
        for i in range(0, len(at), step) if at is not None else range(start, self.n, step):
            part = self.table[i : min(i + step, self.n)] if at is None else self.table[at[i : i + step]]
            equal = (part == message).sum(axis=1, dtype=np.int32)
            best = int(equal.argmax())
            if equal[best] > top:
                found, top = (i + best if at is None else int(at[i + best])), int(equal[best])
        return found, top

    def _asked(self, message: np.ndarray) -> np.ndarray:
        """The clusters of the runs, in order, that may reach the threshold; other clusters may be among them."""
        plain = np.flatnonzero(message != WILD)
        codes, sizes = message[plain].astype(np.int64), np.zeros(len(message), np.int64)
        spans = [run.spans(plain, codes) for run in self.runs]
        sizes[plain] = sum(high - low for low, high in spans)
        if len(plain) < len(message):
            for p in np.flatnonzero(message == WILD).tolist():
                sizes[p] = len(self.wild.get(p, ()))
        order = np.argsort(sizes, kind="stable")
        order = order[np.count_nonzero(sizes == 0) :]
        times, asked = 1, len(order) - self.need + 1  # unknown tokens are asked for nothing
        if asked < 1:
            return np.empty(0, np.int64)
        if self.need > 1 and sizes[order[:asked]].sum() > PAIRED:
            times, asked = 2, asked + 1
        chosen = np.zeros(len(message), bool)
        chosen[order[:asked]] = True
        lists = [np.array(self.wild[p], np.int32) for p in np.flatnonzero(chosen & (message == WILD)).tolist()]
        for run, (low, high) in zip(self.runs, spans):
            some = chosen[plain] & (high > low)
            lists += [run.rows[i:j] for i, j in zip(low[some].tolist(), high[some].tolist())]
        met = np.concatenate(lists)
        met.sort()
        return met[times - 1 :][met[times - 1 :] == met[: len(met) - times + 1]] if times > 1 else met

    def open(self, message: np.ndarray) -> int:
        if not self.n:
            self.need = least_equal(len(message), self.threshold)
        if self.n == len(self.table):
            grown = np.zeros((max(8, 2 * self.n), len(message)), dtype=np.int32)
            if self.n:
                grown[: self.n] = self.templates
            self.table = grown
        self.table[self.n] = message
        self.stamps.append(0)
        self._turned(self.n, np.flatnonzero(message == WILD))
        self.n += 1
        if self.need and self.n - self.indexed > DENSE * (1 + SHORT // len(message)) + self.indexed // 128:
            self._index_last()
        return self.n - 1

    def _index_last(self) -> None:
        """A run of the clusters that are in none and of the runs before it that are not longer than four times that."""
        start = self.indexed
        while self.runs and self.runs[-1].n <= 4 * (self.n - start):
            start = self.runs.pop().start
        self.runs.append(Postings(self.table[start : self.n], start))
        self.indexed = self.n

    def _turned(self, cluster: int, positions: np.ndarray) -> None:
        for p in positions.tolist():
            self.wild.setdefault(p, array("i")).append(cluster)

    def generalize(self, cluster: int, message: np.ndarray) -> np.ndarray:
        """Positions at which the template turned into the wildcard."""
        template = self.table[cluster]
        stale = np.flatnonzero((template != message) & (template != WILD))
        self.stamps[cluster] += bool(len(stale))
        template[stale] = WILD
        self._turned(cluster, stale)
        return stale

    def joined(self, cluster: int, message: np.ndarray) -> tuple[int, int, int]:
        """What ``still_joins`` asks for later: the template's stamp, its equal positions, and the clusters there are."""
        score = int((self.table[cluster] == message).sum()) if WILD not in message else -1
        return self.stamps[cluster], score, self.n

    def still_joins(self, cluster: int, message: Callable[[], np.ndarray], then: tuple[int, int, int]) -> bool:
        """Whether a message that joined the cluster surely does so again and changes nothing, given ``joined`` of that time.

        Its own template must not have changed. Other templates only lose tokens, so of them only those opened since could have
        more equal positions; they were opened by other messages, so none has all, and where few were opened they are compared.
        A message that holds the wildcard itself may gain by what others lose. ``message`` gives its codes, if they are asked for.
        """
        stamp, score, seen = then
        if score < 0 or self.stamps[cluster] != stamp:
            return False
        if seen == self.n or score >= self.table.shape[1] - 1:
            return True
        return self.n - seen <= DENSE and int((self.table[seen : self.n] == message()).sum(axis=1).max()) <= score

    def add(self, message: np.ndarray) -> tuple[int, bool]:
        """Cluster of the message, and whether this changed any template."""
        found, _ = self.best(message)
        if found >= 0:
            return found, bool(len(self.generalize(found, message)))
        return self.open(message), True


class Route:
    """What the fold keeps of one route: its clusters, and of each distinct message the text and a few numbers."""

    def __init__(self, leaf: str | None, threshold: float) -> None:
        self.leaf, self.coder, self.clusters = leaf, Coder(), Clusters(threshold)
        self.version = 0  # counts the changes of templates
        self.opened: list[object] = []  # first positions of the clusters
        self.known: dict[str, int] = {}  # message -> its place in the columns below
        self.since: list[object] = []  # position from which on it joins its cluster
        self.version_then, self.cluster, self.rows = array("q"), array("i"), array("q")
        self.stamp, self.score, self.seen = array("q"), array("i"), array("i")  # ``joined`` of that time

    def add(self, message: str, pos: object) -> tuple | None:
        """One more row. The stretch that it ends, if any."""
        clusters, i = self.clusters, self.known.get(message)
        if i is not None:
            then = self.stamp[i], self.score[i], self.seen[i]
            if self.version_then[i] == self.version or clusters.still_joins(self.cluster[i], lambda: self.coder.encode(message), then):
                self.rows[i] += 1
                return None
        codes = self.coder.encode(message)
        cluster, changed = clusters.add(codes)
        self.version += changed
        if cluster == len(self.opened):
            self.opened.append(pos)
        ended, joined = None, clusters.joined(cluster, codes)
        if i is None:
            self.known[message] = len(self.since)
            self.since.append(pos)
            for column, value in zip(self._columns(), (self.version, cluster, 1, *joined)):
                column.append(value)
            return None
        rows = self.rows[i] + 1
        if self.cluster[i] != cluster:
            ended = self._stretch(message, i, pos)
            self.since[i], rows = pos, 1
        for column, value in zip(self._columns(), (self.version, cluster, rows, *joined)):
            column[i] = value
        return ended

    def _columns(self) -> tuple[array, ...]:
        return self.version_then, self.cluster, self.rows, self.stamp, self.score, self.seen

    def _stretch(self, message: str, i: int, to: object) -> tuple:
        return self.leaf, message, self.since[i], to, self.opened[self.cluster[i]], self.rows[i]

    def still_open(self) -> Iterator[tuple]:
        """The stretches that hold to the end of the route."""
        for message, i in self.known.items():
            yield self._stretch(message, i, None)


def fold_sorted(threshold: float):
    """Batch function over rows sorted by (route, position).

    Emits one row per message and stretch of equal assignment: ``_from`` and ``_to``
    positions, the cluster named by its first position, and the number of rows.
    State is carried across batches, so memory holds the distinct messages of one route.
    """

    def ended(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        route = Route(None, threshold)
        for batch in batches:
            for leaf, message, pos in zip(batch["_leaf"], batch["_msg"], batch["_pos"]):
                if leaf != route.leaf:
                    yield from route.still_open()
                    route = Route(leaf, threshold)
                if (stretch := route.add(message, pos)) is not None:
                    yield stretch
        yield from route.still_open()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stretches = ended(batches)
        while done := list(islice(stretches, ROWS_OUT)):
            yield pd.DataFrame(done, columns=STRETCH, dtype=object)

    return run


class Matches:
    """What each of a slice of one route's messages would meet at the current templates, kept up as templates change.

    ``outcome`` is the cluster that a message would join without changing it, or -1 where its next
    row would change a template; it holds since position ``since`` (None: since the beginning).
    ``closed`` collects the stretches that ended: (message, from, to, cluster or None).
    """

    def __init__(self, threshold: float, messages: Sequence[str], best=None, equal=None, outcome=None, since=None, templates=(), opened=()) -> None:
        n = len(messages)
        self.texts, self.coder, self.clusters, self.opened = list(messages), Coder(), Clusters(threshold), list(opened)
        self.x = np.stack([self.coder.encode(m) for m in messages])
        for template in templates:
            self.clusters.open(self.coder.encode(template))
        self.clusters.need = self.need = least_equal(self.x.shape[1], threshold)
        self.best, self.equal, self.outcome = (np.full(n, -1) if v is None else np.array(v, np.int64) for v in (best, equal, outcome))
        self.since = [None] * n if since is None else list(since)
        self.closed: list[tuple] = []
        self.index = Postings(self.x)

    def _holding(self, positions: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
        """The messages with each code at its position, where there are any."""
        low, high = self.index.spans(positions, codes)
        return [self.index.rows[i:j] for i, j in zip(low.tolist(), high.tolist()) if j > i]

    def _opened(self, template: np.ndarray, cluster: int) -> np.ndarray:
        """Messages that a new cluster wins."""
        if self.need:
            lists = sorted(self._holding(np.arange(len(template)), template.astype(np.int64)), key=len)
            if len(lists) < self.need:
                return np.empty(0, np.int64)
            at = np.unique(np.concatenate(lists[: len(lists) - self.need + 1]))
        else:
            at = np.arange(len(self.x))
        score = (self.x[at] == template).sum(axis=1)
        won = (score >= self.need) & (score > self.equal[at])
        self.best[at[won]], self.equal[at[won]] = cluster, score[won]
        return at[won]

    def _generalized(self, cluster: int, stale: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Messages whose match may have changed as the template's stale positions turned into wildcards."""
        template, own = self.clusters.table[cluster], np.flatnonzero(self.best == cluster)
        moved = self._holding(np.tile(stale, 2), np.concatenate([before[stale].astype(np.int64), np.full(len(stale), WILD)]))
        if not moved:
            return own
        at = np.unique(np.concatenate(moved))
        score = (self.x[at] == template).sum(axis=1)
        mine = self.best[at] == cluster
        more = mine & (score >= self.equal[at])
        self.equal[at[more]] = score[more]
        won = ~mine & (score >= self.need) & ((score > self.equal[at]) | ((score == self.equal[at]) & (cluster < self.best[at])))
        self.best[at[won]], self.equal[at[won]] = cluster, score[won]
        for i in at[mine & ~more].tolist():
            self.best[i], self.equal[i] = self.clusters.best(self.x[i])
        return np.union1d(own, at[won])

    def step(self, message: str, pos: object) -> None:
        """One row that changes a template, at its position."""
        codes, clusters = self.coder.encode(message), self.clusters
        found, _ = clusters.best(codes)
        if found < 0:
            found = clusters.open(codes)
            self.opened.append(pos)
            touched = self._opened(codes, found)
        else:
            before = clusters.table[found].copy()
            touched = self._generalized(found, clusters.generalize(found, codes), before)
        if not len(touched):
            return
        template = clusters.templates[self.best[touched]]
        steady = (self.best[touched] >= 0) & ((template == self.x[touched]) | (template == WILD)).all(axis=1)
        fresh = np.where(steady, self.best[touched], -1)
        changed = fresh != self.outcome[touched]
        for i, new in zip(touched[changed].tolist(), fresh[changed].tolist()):
            self.closed.append((self.texts[i], self.since[i], pos, self.named(i)))
            self.outcome[i], self.since[i] = new, pos

    def named(self, i: int) -> object:
        """The current outcome of a message, a cluster named by its first position."""
        return self.opened[self.outcome[i]] if self.outcome[i] >= 0 else None

    def still_open(self) -> list[tuple]:
        """The stretches that hold until further notice."""
        return [(m, self.since[i], None, self.named(i)) for i, m in enumerate(self.texts)]

    def templates(self) -> list[str]:
        token = {code: t for t, code in self.coder.codes.items()}
        return [" ".join(token[c] for c in row) for row in self.clusters.templates.tolist()]


def changing_rows(threshold: float, rows: Iterable[tuple[str, object]], templates: Sequence[str] = ()) -> list[tuple[str, object]]:
    """Of one route's rows (message, position), in order, those that change the templates which the route has before them."""
    coder, clusters = Coder(), Clusters(threshold)
    for template in templates:
        clusters.open(coder.encode(template))
    return [(m, pos) for m, pos in rows if clusters.add(coder.encode(m))[1]]
