"""Lattices of vocabulary pieces over many words at once.

Every substring of a word, up to the longest piece, is looked up by a 64-bit hash of its characters, in a
table of 2**20 places by the hash's upper bits. Substrings that no piece begins with are not made longer.
"""

from __future__ import annotations

import numpy as np

from .common import golden, mix

_STEP = np.uint64(0xD6E8FEB86659FD93)
_PLACES = np.uint64(44)  # 64 - 20


def codes(words: list[str], width: int) -> np.ndarray:
    """Code points [word, position], zero after a word's end. No word is longer than ``width``."""
    flat = np.frombuffer("".join([w.ljust(width, "\0") for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.reshape(len(words), width)


def by_width(lengths: np.ndarray, most: int) -> list[tuple[int, np.ndarray]]:
    """(width, which) of words of alike length, ``most`` at a time: widths are multiples of four."""
    width = -(-np.maximum(lengths, 1) // 4) * 4
    out = []
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        out += [(w, at[a : a + most]) for a in range(0, len(at), most)]
    return out


class PieceTable:
    """Pieces by their place in ``names``."""

    def __init__(self, names: list[str], _inner: bool = False):
        self.longest = max(map(len, names), default=1)
        keys = np.zeros(len(names), np.uint64)
        lengths = np.array([len(x) for x in names], int)
        for width, at in by_width(lengths, 1 << 14):
            c, h = codes([names[i] for i in at.tolist()], width), np.zeros(len(at), np.uint64)
            for n in range(1, width + 1):
                h = (h + c[:, n - 1]) * _STEP
                own = lengths[at] == n
                keys[at[own]] = mix(h[own] + golden(n))
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = np.append(keys[self.order], np.uint64(0))
        place = (keys[self.order] >> _PLACES).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
        self.first = np.full(1 << 20, -1, np.int32)
        self.first[place[first]] = first
        self.crowd = int(np.diff(np.append(first, len(place))).max(initial=1))
        self.longer = np.zeros(1 << 20, bool)
        starts = sorted({x[:n] for x in names for n in range(1, len(x))})
        if starts and not _inner:
            self.longer[PieceTable(starts, True).keys[:-1] >> _PLACES] = True

    def lattice(self, c: np.ndarray) -> np.ndarray:
        """Of code points [word, position]: [word, end - 1, length - 1] -> piece, or -1."""
        n, width = c.shape
        span = min(self.longest, width)
        out = np.full(n * width * span, -1, np.int32)
        c = c.ravel()
        spot = np.flatnonzero(c)  # where a substring's last character stands
        room = width - spot % width  # characters from the first one to the row's end
        h = np.zeros(len(spot), np.uint64)
        for length in range(1, span + 1):
            h = (h + c[spot]) * _STEP
            key = mix(h + golden(length))
            place = key >> _PLACES
            at = self.first[place]
            hit = np.flatnonzero(at >= 0)
            at, k, to = at[hit], key[hit], spot[hit] * span + length - 1
            for _ in range(self.crowd):
                ok = self.keys[at] == k
                out[to[ok]] = self.order[at[ok]]
                at = np.minimum(at + 1, len(self.order))
            on = np.flatnonzero(self.longer[place] & (room > length))
            spot, room, h = spot[on] + 1, room[on], h[on]
        return out.reshape(n, width, span)
