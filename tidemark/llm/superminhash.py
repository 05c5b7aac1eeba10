"""SuperMinHash signatures (Ertl, 2017), for many sets at once.

An element's i-th draw goes to the i-th slot of its own random permutation, with value i + U[0, 1).
Slots keep minima. Once every slot of a set is below i + 1, later draws can't lower any of them: the
set is done. Large sets are done after two or three rounds, small ones after as many as there are slots.
"""

from __future__ import annotations

import numpy as np

from .common import golden, mix

SLOTS = 128
_HIGH = np.uint64(48)


#: Elements that are drawn for together, which bounds the permutations held at a time.
STRETCH = 1 << 14


def _minima(elements: np.ndarray, starts: np.ndarray, slots: int) -> np.ndarray:
    """Least values [set, slot] of these elements."""
    n_sets = len(starts) - 1
    sig = np.full(n_sets * slots, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n_sets), np.diff(starts))
    state = elements.copy()
    perm = np.broadcast_to(np.arange(slots, dtype=np.uint8), (len(state), slots)).copy()
    rows = np.arange(len(state))
    open_set = np.diff(starts) > 0
    for i in range(slots):
        if not len(state):
            break
        draw = mix(state + golden(i + 1))
        k = i + (((draw >> np.uint64(32)) * np.uint64(slots - i)) >> np.uint64(32)).astype(np.int64)
        slot = perm[rows, k]
        perm[rows, k] = perm[rows, i]
        value = (np.uint64(i) << _HIGH) | (mix(draw) >> np.uint64(16))
        np.minimum.at(sig, owner * slots + slot, value)
        top = sig.reshape(n_sets, slots).max(axis=1)
        still = open_set & (top >= (np.uint64(i + 1) << _HIGH))
        if not still.all():
            left = still[owner]
            if not left.all():
                state, owner, perm = state[left], owner[left], perm[left]
                rows = rows[: len(state)]
        open_set = still
    return sig.reshape(n_sets, slots)


def signatures(elements: np.ndarray, starts: np.ndarray, slots: int = SLOTS, stretch: int = STRETCH) -> np.ndarray:
    """uint16 signatures, a row for each set. Rows of empty sets are zero and mean nothing.

    A set's least values are the least of its parts' ones, so large sets are drawn for in stretches.
    """
    n_sets = len(starts) - 1
    sig = np.full((n_sets, slots), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(elements), stretch):
        b = min(a + stretch, len(elements))
        first, last = int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b, "left"))
        part = _minima(elements[a:b], np.clip(starts[first : last + 1], a, b) - a, slots)
        np.minimum(sig[first:last], part, out=sig[first:last])
    out = (mix(sig) & np.uint64(0xFFFF)).astype(np.uint16)
    out[np.diff(starts) == 0] = 0
    return out
