"""Rules over blocks of cube rows: a matrix with a row per cube row and a column per period.

Catalyst can express these rules with array functions, but those are interpreted cell by
cell: the detectors and the apply passes take some 100 times the CPU time of the same
rules over a matrix. So Spark plans, reads, partitions, explodes and joins, and hands the
measure arrays to a function in Arrow batches; rows never leave their partition, and
nothing but the measures (and the actions of a row) travels to Python.

Missing cells are NaN here. Sums run from left to right, as in the reference. Blocks hold
at most ``BLOCK_CELLS`` cells, so work space does not grow with the number of periods.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_CELLS = 1 << 20

Mask = Callable[[np.ndarray], np.ndarray]

#: Passes of an apply run, in order, as they stand in the log.
ZERO, REFUND, SPLIT, KEEP = 2, 3, 4, 5

FLAGS_T = "array<struct<pos: int, bits: int>>"
LOG_T = ("array<struct<pass: int, ord: bigint, step: int, pos: int, target: int, detector: int, "
         "value_before: double, value_after: double>>")


# --- detectors (D-01..D-04) -----------------------------------------------------------

def negatives(v: np.ndarray) -> np.ndarray:
    return v < 0


def _positive_sums(v: np.ndarray) -> np.ndarray:
    """Sum of the positive cells up to and including each position."""
    return np.cumsum(np.where(v > 0, v, 0.0), axis=1)


def refunds(v: np.ndarray) -> np.ndarray:
    """Negatives that the positive cells before them cover."""
    before = np.zeros_like(v)
    before[:, 1:] = _positive_sums(v)[:, :-1]
    return (v < 0) & (before >= np.abs(v))


def double_bookings(v: np.ndarray) -> np.ndarray:
    """Positive cells above twice the mean of the positive cells, beside a zero."""
    count = (v > 0).sum(axis=1)
    mean = np.where(count > 0, _positive_sums(v)[:, -1] / np.maximum(count, 1), 0.0)
    beside = np.zeros(v.shape, bool)
    beside[:, 1:] |= v[:, :-1] == 0
    beside[:, :-1] |= v[:, 1:] == 0
    return (v > 0) & (v > 2.0 * mean[:, None]) & beside


def _quantile(ordered: np.ndarray, count: np.ndarray, p: float) -> np.ndarray:
    """Linear-interpolated percentile of the first ``count`` cells of sorted rows; NaN without any.

    The interpolation starts from the nearer neighbour, so results equal the
    ``linear`` method's to the last bit.
    """
    h = (count - 1) * p
    low = np.floor(h)
    t = h - low
    rows = np.arange(len(ordered))
    at = np.maximum(low, 0).astype(np.int64)
    a, b = ordered[rows, at], ordered[rows, np.minimum(at + 1, np.maximum(count - 1, 0))]
    return np.where(count > 0, np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t), np.nan)


def outliers(v: np.ndarray) -> np.ndarray:
    """Cells outside 1.5 interquartile ranges of the row; bounds that are no number flag nothing."""
    ordered, count = np.sort(v, axis=1), (~np.isnan(v)).sum(axis=1)
    q1, q3 = _quantile(ordered, count, 0.25), _quantile(ordered, count, 0.75)
    reach = 1.5 * (q3 - q1)
    return (v < (q1 - reach)[:, None]) | (v > (q3 + reach)[:, None])


def flag_bits(v: np.ndarray, masks: list[tuple[int, Mask]]) -> np.ndarray:
    """Set of detectors that flag each cell (bit k: the k-th); masks are (least periods, rule)."""
    bits = np.zeros(v.shape, np.int32)
    with np.errstate(all="ignore"):
        for k, (least, mask) in enumerate(masks):
            if v.shape[1] >= max(1, least):
                bits |= np.where(mask(v), np.int32(1 << k), np.int32(0))
    return bits


# --- apply passes (X-04..X-09) ----------------------------------------------------------

class Actions:
    """Chosen fixes of a block: parallel arrays, sorted by row and order within the row."""

    def __init__(self, row, pos, ord_, kind, detector):
        at = np.lexsort((pos, ord_, row))
        self.row, self.pos, self.ord = row[at], pos[at], ord_[at]
        self.kind, self.detector = kind[at], detector[at]

    def of(self, kind: int) -> np.ndarray:
        return np.flatnonzero(self.kind == kind)

    def turns(self, kind: int) -> Iterator[np.ndarray]:
        """The actions of a kind by turn: first those that are the first of their row, and so on."""
        at = self.of(kind)
        new = np.ones(len(at), bool)
        new[1:] = self.row[at[1:]] != self.row[at[:-1]]
        first = np.flatnonzero(new)
        turn = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        for k in range(int(turn.max(initial=-1)) + 1):
            yield at[turn == k]


class Log:
    """Change entries of a block, written pass by pass."""

    def __init__(self, actions: Actions):
        self._actions = actions
        self._parts: list[tuple] = []

    def add(self, pass_no: int, action: np.ndarray, step, pos, before, after) -> None:
        n = len(action)
        self._parts.append((action, np.full(n, pass_no), np.broadcast_to(step, n), pos, before,
                            np.broadcast_to(after, n)))

    def lists(self, rows: int) -> pa.Array:
        """The entries of each row, by pass, order and step."""
        none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0),) * 2
        action, pass_no, step, pos, before, after = map(np.concatenate, zip(none, *self._parts))
        a = self._actions
        at = np.lexsort((step, a.ord[action], pass_no, a.row[action]))
        action = action[at]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(a.row[action], minlength=rows))])
        fields = {"pass": pa.array(pass_no[at].astype(np.int32)), "ord": pa.array(a.ord[action]),
                  "step": pa.array(step[at].astype(np.int32)), "pos": pa.array(pos[at].astype(np.int32)),
                  "target": pa.array(a.pos[action].astype(np.int32)),
                  "detector": pa.array(a.detector[action].astype(np.int32)),
                  "value_before": _nullable(before[at]), "value_after": _nullable(after[at])}
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)),
                                        pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))


def apply_passes(v: np.ndarray, actions: Actions, columns: list[str]) -> tuple[np.ndarray, Log]:
    """The matrix after all passes, and the log.

    Pass 2 zeroes cells at once. Pass 3 takes refunds in their order; each walks back over
    the positive cells before it and takes from them until it is used up, so a walk visits
    a cell only while something is left. Pass 4 splits spikes in their order with the zero
    beside them in the input; pass 5 records kept values.
    """
    original, v, log = v, v.copy(), Log(actions)
    a = actions
    at = a.of(ZERO)
    log.add(ZERO, at, 0, a.pos[at], original[a.row[at], a.pos[at]], 0.0)
    v[a.row[at], a.pos[at]] = 0.0
    for turn in a.turns(REFUND):
        row, pos = a.row[turn], a.pos[turn]
        rest = -v[row, pos]
        log.add(REFUND, turn, 0, pos, v[row, pos], 0.0)
        v[row, pos] = 0.0
        step = np.ones(len(turn), np.int64)
        left = np.flatnonzero((rest > 0) & (pos > 0))
        back = pos - 1
        while len(left):
            x = v[row[left], back[left]]
            hit = left[x > 0]
            x = x[x > 0]
            taken = np.minimum(x, rest[hit])
            log.add(REFUND, turn[hit], step[hit], back[hit], x, x - taken)
            v[row[hit], back[hit]] = x - taken
            rest[hit] -= taken
            step[hit] += 1
            back[left] -= 1
            left = left[(rest[left] > 0) & (back[left] >= 0)]
    width = v.shape[1]
    for turn in a.turns(SPLIT):
        row, pos = a.row[turn], a.pos[turn]
        after = (pos + 1 < width) & (original[row, np.minimum(pos + 1, width - 1)] == 0)
        ahead = (pos > 0) & (original[row, np.maximum(pos - 1, 0)] == 0)
        if not (after | ahead).all():
            lost = columns[pos[~(after | ahead)][0]]
            raise ValueError(f"Cannot split: '{lost}' has no zero neighbor")
        other = np.where(after, pos + 1, pos - 1)
        x, y = v[row, pos], v[row, other]
        half = x / 2.0
        whole = np.mod(x, 1.0) == 0
        small = np.where(whole, half - np.mod(half, 1.0), half)
        large = np.where(whole, x - small, half)
        v[row, pos], v[row, other] = large, small
        log.add(SPLIT, turn, np.where(after, 0, 1), pos, x, large)
        log.add(SPLIT, turn, np.where(after, 1, 0), other, y, small)
    at = a.of(KEEP)
    log.add(KEEP, at, 0, a.pos[at], v[a.row[at], a.pos[at]], v[a.row[at], a.pos[at]])
    return v, log


# --- Arrow in and out ---------------------------------------------------------------------

def _nullable(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=np.isnan(values))


def _blocks(cells: pa.ListArray, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row + 1, matrix) of a batch of measure arrays."""
    flat = cells.flatten().to_numpy(zero_copy_only=False).reshape(len(cells), width)
    step = max(1, BLOCK_CELLS // max(1, width))
    for i in range(0, len(cells), step):
        yield i, min(i + step, len(cells)), flat[i:i + step].astype(np.float64, copy=False)


def _cell_lists(v: np.ndarray) -> pa.Array:
    offsets = np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), _nullable(v.ravel()))


def _flag_lists(bits: np.ndarray) -> pa.Array:
    row, pos = np.nonzero(bits)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(bits)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(
        [pa.array(pos.astype(np.int32)), pa.array(bits[row, pos])], names=["pos", "bits"]))


def _chunks(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


_FLAG_LIST = pa.list_(pa.struct([("pos", pa.int32()), ("bits", pa.int32())]))
_LOG_LIST = pa.list_(pa.struct([
    ("pass", pa.int32()), ("ord", pa.int64()), ("step", pa.int32()), ("pos", pa.int32()), ("target", pa.int32()),
    ("detector", pa.int32()), ("value_before", pa.float64()), ("value_after", pa.float64())]))
_APPLIED = pa.struct([("cells", pa.list_(pa.float64())), ("log", _LOG_LIST)])
APPLIED_T = f"cells array<double>, log {LOG_T}"


def flags_column(cells: Column, width: int, masks: list[tuple[int, Mask]]) -> Column:
    """array<struct<pos, bits>>: the flagged positions of each row, and by which detectors."""

    @F.arrow_udf(FLAGS_T)
    def flags(arrays: pa.Array) -> pa.Array:
        return _chunks([_flag_lists(flag_bits(v, masks)) for _, _, v in _blocks(arrays, width)], _FLAG_LIST)

    return flags(cells)


def policy_column(cells: Column, columns: list[str], masks: list[tuple[int, Mask]],
                  kind_of: list[int], detector_of: list[int], order: list[int]) -> Column:
    """struct<cells, log> of rows whose fixes follow from their own flags.

    ``kind_of`` and ``detector_of`` say for each set of flags (by its bits) which pass treats
    the cell (0: none) and who is credited; ``order`` is the place of each position in its row.
    """
    kinds, credited, places = (np.array(x, np.int64) for x in (kind_of, detector_of, order))

    @F.arrow_udf(APPLIED_T)
    def applied(arrays: pa.Array) -> pa.Array:
        parts = []
        for _, _, v in _blocks(arrays, len(columns)):
            bits = flag_bits(v, masks)
            row, pos = np.nonzero(kinds[bits])
            chosen = bits[row, pos]
            parts.append(_applied(v, Actions(row, pos, places[pos], kinds[chosen], credited[chosen]), columns))
        return _chunks(parts, _APPLIED)

    return applied(cells)


def actions_column(cells: Column, actions: Column, columns: list[str]) -> Column:
    """struct<cells, log> of rows with given ``actions`` (array<struct<ord, pos, kind, detector>>, may be null)."""

    @F.arrow_udf(APPLIED_T)
    def applied(arrays: pa.Array, chosen: pa.Array) -> pa.Array:
        parts = []
        for i, j, v in _blocks(arrays, len(columns)):
            own = chosen[i:j]
            row = np.repeat(np.arange(j - i), own.value_lengths().fill_null(0).to_numpy())
            fields = dict(zip(("ord", "pos", "kind", "detector"), own.flatten().flatten()))
            ord_, pos, kind, detector = (fields[k].to_numpy(zero_copy_only=False).astype(np.int64) for k in fields)
            parts.append(_applied(v, Actions(row, pos, ord_, kind, detector), columns))
        return _chunks(parts, _APPLIED)

    return applied(cells, actions)


def _applied(v: np.ndarray, actions: Actions, columns: list[str]) -> pa.Array:
    with np.errstate(all="ignore"):
        after, log = apply_passes(v, actions, columns)
    return pa.StructArray.from_arrays([_cell_lists(after), log.lists(len(v))], fields=list(_APPLIED))
