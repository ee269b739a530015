"""Histogram gradient boosting of many models at once, for `crossfit`.

Columns are binned once (`BINS` quantiles at most; nulls have a bin of their own). A tree grows level by level: one pass over the rows sums gradient,
Hessian and count per (model, node, column, bin) for all models, in tasks first; each model's best splits are found where its sums
meet, and only these go to the driver. So a pass moves as much as there are models, nodes, columns and bins, whatever the rows.

A split's gain is that of second order, G^2 / H on both sides less that of the node, nulls tried on either side; of equal gains the
first column, the lowest bin and nulls to the right win. Classes are balanced. Rows are kept as binned blocks with their margins, which
are brought up to date every `KEEP` trees and persisted; a lost block is made again from the one before.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crossfit

BINS, MISSING = 255, 255
BLOCK_ROWS, KEEP = 8_192, 10
LEAST_HESSIAN = 1e-3


class Tree:
    """Nodes in order of their making: (column, bin, nulls left, left, right), or a leaf with column -1."""

    def __init__(self):
        self.nodes, self.value = [[-1, 0, False, 0, 0]], [0.0]

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of `bins` ends in."""
        at = np.zeros(len(bins), dtype=np.int64)
        column, bin_, left_null, left, right = (np.array(v) for v in zip(*self.nodes))
        while True:
            inner = np.flatnonzero(column[at] >= 0)
            if not len(inner):
                return at
            n = at[inner]
            x = bins[inner, column[n]]
            goes_left = np.where(x == MISSING, left_null[n], x <= bin_[n])
            at[inner] = np.where(goes_left, left[n], right[n])

    def apply(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.place(bins)]


def best_split(sums: np.ndarray, least_rows: int, penalty: float):
    """(gain, column, bin, nulls left, sums of the left side, of the right) from one node's sums (columns, 256, [G, H, n]); None if no
    split gains."""
    total = sums[0].sum(0)
    below = np.cumsum(sums[:, :BINS], axis=1)
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + penalty + 1e-15)
    null = sums[:, MISSING][:, None]
    best = None
    for left_null in (False, True):
        left = below + null if left_null else below
        right = total - left
        fits = (np.minimum(left[..., 2], right[..., 2]) >= least_rows - 0.5) & (np.minimum(left[..., 1], right[..., 1]) >= LEAST_HESSIAN)
        gain = np.where(fits, score(left) + score(right) - score(total), -np.inf)
        c, b = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[c, b] > 1e-12 and (best is None or gain[c, b] > best[0] * (1 + 1e-12)):
            best = (float(gain[c, b]), int(c), int(b), left_null, left[c, b].tolist(), right[c, b].tolist())
    return best


class Boosted:
    """Trees of depth `depth`, `rounds` of them, each worth `rate` of its leaves' Newton steps."""

    name = "gbm"

    def __init__(self, rounds: int = 200, rate: float = 0.05, depth: int = 3, least_rows: int = 20, penalty: float = 0.0):
        self.rounds, self.rate, self.depth, self.least_rows, self.penalty = rounds, rate, depth, least_rows, penalty

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, dtype=np.uint8)
        for c, edges in enumerate(self.edges):
            out[:, c] = np.where(np.isnan(x[:, c]), MISSING, np.searchsorted(edges, x[:, c], side="left"))
        return out

    def _edges(self, rows: DataFrame, columns: int) -> list[np.ndarray]:
        """Upper bounds of the bins of each column: its quantiles among all rows."""
        shares = [i / BINS for i in range(1, BINS)]
        each = rows.select(*[F.col("x")[c].alias(f"c{c}") for c in range(columns)])
        found = each.agg(*[F.percentile_approx(f"c{c}", shares, 100_000).alias(f"c{c}") for c in range(columns)]).first() if columns else []
        return [np.unique(np.array(q or [0.0], dtype=float)) for q in found]

    def fit(self, rows: DataFrame, models: list[int], inner: int, numbers: int) -> Boosted:
        scale = crossfit.Scale(rows, models, inner, numbers)
        open_ = sorted(scale.mean)
        self.trees: dict[int, list[Tree]] = {m: [] for m in open_}
        if not open_:
            return self
        self.edges = self._edges(rows, len(scale.mean[open_[0]]))
        state, old = self._blocks(rows, open_).persist(), None
        settled = 0  # trees that the state's margins have
        for r in range(self.rounds):
            growing = {m: Tree() for m in open_}
            frontier = {m: [0] for m in open_}
            for _ in range(self.depth):
                pending = {m: self.trees[m][settled:] for m in open_}
                found = self._pass(state, open_, inner, scale.weight, pending, growing, frontier)
                if old is not None:
                    old.unpersist()  # `state` is there now
                    old = None
                frontier = {m: [] for m in open_}
                for m, node, (_, c, b, left_null, left, right) in found:
                    tree = growing[m]
                    at = len(tree.nodes)
                    tree.nodes[node] = [c, b, left_null, at, at + 1]
                    for g, h, _ in (left, right):
                        tree.nodes.append([-1, 0, False, 0, 0])
                        tree.value.append(-self.rate * g / (h + self.penalty + 1e-15))
                    frontier[m] += [at, at + 1]
                frontier = {m: n for m, n in frontier.items() if n}
                if not frontier:
                    break
            for m in open_:
                self.trees[m].append(growing[m])
            open_now = [m for m in open_ if len(growing[m].nodes) > 1]
            if not open_now:
                break
            if (r + 1) % KEEP == 0 and r + 1 < self.rounds:
                old, state = state, self._settle(state, open_, {m: self.trees[m][settled:] for m in open_}).persist()
                settled = r + 1
        for d in (state, old):
            if d is not None:
                d.unpersist()
        return self

    def _blocks(self, rows: DataFrame, models: list[int]) -> DataFrame:
        """Binned blocks of rows, with a margin per model."""
        bins_of, wide = self.bins, len(models)

        def run(batches):
            import pyarrow as pa

            for b in batches:
                for s in range(0, b.num_rows, BLOCK_ROWS):
                    x, y, inners = crossfit.arrays(b.slice(s, BLOCK_ROWS))
                    keep = (inners >= 0).any(1)
                    columns = [bins_of(x[keep]), y[keep], inners[keep].astype(np.int16), np.zeros((keep.sum(), wide))]
                    yield pa.RecordBatch.from_arrays([pa.array([int(keep.sum())]), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], ["n", "bins", "y", "inners", "margins"])

        return rows.select("x", "y", "inners").mapInArrow(run, "n long, bins binary, y binary, inners binary, margins binary")

    @staticmethod
    def _settle(state: DataFrame, models: list[int], pending: dict) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            for b in batches:
                margins = []
                for _, bins, _, _, margin in unpacked(b):
                    margins.append(np.column_stack([margin[:, i] + sum(t.apply(bins) for t in pending[m]) for i, m in enumerate(models)]).tobytes())
                yield b.set_column(4, "margins", pa.array(margins, pa.binary()))

        return state.mapInArrow(run, state.schema)

    def _pass(self, state: DataFrame, models: list[int], inner: int, weight: dict, pending: dict, growing: dict, frontier: dict):
        """(model, node, best split) of every frontier node that has one."""
        least_rows, penalty = self.least_rows, self.penalty

        def measure(batches):
            import pyarrow as pa

            total = {}
            for b in batches:
                for n, bins, y, inners, margin in unpacked(b):
                    for i, m in enumerate(models):
                        if not n or m not in frontier:
                            continue
                        on = crossfit.trained_on(inners, m, inner)
                        x, t = bins[on], y[on]
                        p = crossfit.probability(margin[on, i] + sum(tree.apply(x) for tree in pending[m]))
                        w = np.where(t > 0.5, weight[m][1], weight[m][0])
                        place = np.full(len(growing[m].nodes), -1)
                        place[frontier[m]] = np.arange(len(frontier[m]))
                        node = place[growing[m].place(x)]
                        here = node >= 0
                        cell = ((node[here, None] * x.shape[1] + np.arange(x.shape[1])) * 256 + x[here]).ravel()
                        size = len(frontier[m]) * x.shape[1] * 256
                        parts = [np.bincount(cell, np.repeat(v[here], x.shape[1]), size) for v in (w * (p - t), w * p * (1 - p), np.ones(len(t)))]
                        total[m] = total.get(m, 0) + np.stack(parts, axis=1).reshape(len(frontier[m]), -1)
            out = [(m, node, own.tobytes()) for m, v in total.items() for node, own in zip(frontier[m], v)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["model", "node", "v"])

        def find(batches):
            import pickle

            import pyarrow as pa

            at, held, out = None, 0, []
            rows = (r for b in batches for r in zip(b.column("model").to_pylist(), b.column("node").to_pylist(), b.column("v")))
            for m, node, v in chain(rows, [(None, None, None)]):
                if (m, node) != at:
                    if at and (split := best_split(held.reshape(-1, 256, 3), least_rows, penalty)):
                        out.append((*at, split))
                    at, held = (m, node), 0
                if v is not None:
                    held = held + np.frombuffer(v.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], ["found"])

        import pickle

        sums = state.mapInArrow(measure, "model int, node int, v binary")
        sums = sums.repartition("model", "node").sortWithinPartitions("model", "node")
        rows = sums.mapInArrow(find, "found binary").collect()
        return sorted((x for r in rows for x in pickle.loads(r.found)), key=lambda x: x[:2])

    def margin(self, m: int, x: np.ndarray) -> np.ndarray:
        """Log-odds; 0 where nothing could be learned."""
        if not self.trees.get(m):
            return np.zeros(len(x))
        bins = self.bins(x)
        return sum(t.apply(bins) for t in self.trees[m])


def unpacked(b):
    """(rows, bins, y, inners, margins) of each block of a batch."""
    for n, *data in zip(*(b.column(k).to_pylist() for k in ("n", "bins", "y", "inners", "margins"))):
        bins, y, inners, margin = (np.frombuffer(d, dtype=t) for d, t in zip(data, (np.uint8, float, np.int16, float)))
        yield n, *(a.reshape(n, -1) if n else a.reshape(0, 1) for a in (bins,)), y, *(a.reshape(n, -1) if n else a.reshape(0, 1) for a in (inners, margin))
