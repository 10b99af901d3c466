"""Apply passes over blocks against a replay of one row and one action at a time."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from cubewash.functions import blocks


def replay(row, actions):
    """(row after all passes, log) of one row; actions are (ord, pos, kind, detector)."""
    v, original, log = list(row), list(row), []
    actions = sorted(actions)
    for o, p, kind, d in actions:
        if kind == blocks.ZERO:
            log.append((blocks.ZERO, o, 0, p, p, d, original[p], 0.0))
            v[p] = 0.0
    for o, p, kind, d in actions:
        if kind == blocks.REFUND:
            rest = -v[p]
            log.append((blocks.REFUND, o, 0, p, p, d, v[p], 0.0))
            step = 1
            for i in range(p - 1, -1, -1):
                if rest > 0 and v[i] is not None and v[i] > 0:
                    taken = min(v[i], rest)
                    log.append((blocks.REFUND, o, step, i, p, d, v[i], v[i] - taken))
                    v[i] -= taken
                    rest -= taken
                    step += 1
            v[p] = 0.0
    for o, p, kind, d in actions:
        if kind == blocks.SPLIT:
            other = p + 1 if p + 1 < len(v) and original[p + 1] == 0 else p - 1
            x, y = v[p], v[other]
            small = math.floor(x / 2) if x == math.floor(x) else x / 2
            v[p], v[other] = x - small, small
            both = sorted([(p, x, x - small), (other, y, small)])
            log += [(blocks.SPLIT, o, k, at, p, d, before, after) for k, (at, before, after) in enumerate(both)]
    for o, p, kind, d in actions:
        if kind == blocks.KEEP:
            log.append((blocks.KEEP, o, 0, p, p, d, v[p], v[p]))
    return v, log


def random_case(rng):
    n = rng.randint(1, 12)
    row = [rng.choice([None, 0.0, 0.0, float(rng.randint(1, 400)), rng.randint(1, 400) / 8, -float(rng.randint(1, 600))])
           for _ in range(n)]
    actions = []
    for o, p in enumerate(rng.sample(range(n), n)):
        x = row[p]
        beside = (p + 1 < n and row[p + 1] == 0) or (p > 0 and row[p - 1] == 0)
        kinds = [0, blocks.KEEP, blocks.ZERO] + ([blocks.REFUND] * 3 if x is not None and x < 0 else []) + (
            [blocks.SPLIT] * 2 if x is not None and x > 0 and beside else [])
        kind = rng.choice(kinds)
        if kind and not (kind == blocks.KEEP and x is None):
            actions.append((o, p, kind, rng.randint(0, 3)))
    return row, actions


@pytest.mark.parametrize("seed", range(40))
def test_passes_equal_the_replay(seed):
    rng = random.Random(seed)
    cases = [random_case(rng) for _ in range(30)]
    width = max(len(r) for r, _ in cases)
    cases = [(r + [None] * (width - len(r)), a) for r, a in cases]
    v = np.array([[math.nan if x is None else x for x in r] for r, _ in cases])
    flat = [(k, *a) for k, (_, actions) in enumerate(cases) for a in actions]
    row, ord_, pos, kind, who = (np.array(x, np.int64) for x in zip(*flat))
    after, log = blocks.apply_passes(v, blocks.Actions(row, pos, ord_, kind, who), [f"m{i}" for i in range(width)])
    entries = log.lists(len(v)).to_pylist()
    for k, (r, actions) in enumerate(cases):
        want, want_log = replay(r, actions)
        got = [None if math.isnan(x) else x for x in after[k].tolist()]
        assert got == want
        assert [tuple(e[f] for f in ("pass", "ord", "step", "pos", "target", "detector", "value_before", "value_after"))
                for e in entries[k]] == [e for p in (2, 3, 4, 5) for e in want_log if e[0] == p]


def test_the_input_is_left_as_it_was_and_a_split_needs_a_zero():
    v = np.array([[3.0, -2.0, 5.0]])
    one = lambda p, kind: blocks.Actions(*(np.array([x]) for x in (0, p, 0, kind, 0)))
    after, _ = blocks.apply_passes(v, one(1, blocks.REFUND), ["a", "b", "c"])
    assert v.tolist() == [[3.0, -2.0, 5.0]] and after.tolist() == [[1.0, 0.0, 5.0]]
    with pytest.raises(ValueError, match="'c' has no zero neighbor"):
        blocks.apply_passes(v, one(2, blocks.SPLIT), ["a", "b", "c"])
