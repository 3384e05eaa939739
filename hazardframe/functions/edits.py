"""Edit distance of sequences of any length, without the full matrix.

Two exact methods, each on arrays of symbol numbers (code points, or word numbers of the pair):

furthest   for e = 0, 1, 2, ... edits, the furthest place reached on every diagonal: about length + e^2 steps, for texts that
           differ little;
bits       one column of the matrix as two long integers (vertical steps up and down), one update per symbol of the other
           text: length * length / 64 word operations whatever the distance.

``edit_distance`` drops what both texts share at their ends and bounds the number from both sides in one pass: from below by the symbols
that one text has more often than the other, from above, at equal lengths, by the places that differ. Where the bounds meet, that is the
number. Else it follows the diagonals as long as that is cheaper, and turns to the columns beyond, at once if the lower bound says so. All
give the same number; the switch only bounds the cost.
"""

from __future__ import annotations

import numpy as np

_NEVER = -(1 << 40)
#: Bytes of symbol masks that ``bits`` keeps; masks of other symbols are built when met.
MASKS_HELD = 64 << 20


def common_start(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    n, at, block = min(len(a), len(b)), 0, 64
    while at < n:
        wrong = np.flatnonzero(a[at:at + block][:n - at] != b[at:at + block][:n - at])
        if len(wrong):
            return at + int(wrong[0])
        at, block = min(n, at + block), block * 2
    return n


def _slide(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How far each (i, j) can go along equal symbols; i after that. All diagonals together for a few symbols, the rest singly."""
    i = i.copy()
    shift = j - i
    left = np.flatnonzero((i >= 0) & (i < len(a)) & (j >= 0) & (j < len(b)))
    for _ in range(6):
        at = i[left]
        left = left[a[at] == b[at + shift[left]]]
        i[left] += 1
        left = left[(i[left] < len(a)) & (i[left] + shift[left] < len(b))]
        if not len(left):
            return i
    for x in left:
        at = int(i[x])
        i[x] = at + common_start(a[at:], b[at + int(shift[x]):])
    return i


def furthest(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The edit distance if it is at most ``most``, else None."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    reach = np.array([common_start(a, b)])  # diagonals -e to e of j - i
    for e in range(most + 1):
        if abs(m - n) <= e and reach[m - n + e] >= n:
            return e
        k = np.arange(-e - 1, e + 2)
        old = np.full(2 * e + 5, _NEVER)
        old[2:-2] = reach
        best = np.maximum(np.maximum(old[1:-1] + 1, old[:-2]), old[2:] + 1)  # a symbol changed, put in, left out
        best = np.minimum(best, np.minimum(n, m - k))
        best[(k < -n) | (k > m)] = _NEVER
        reach = np.where(best >= 0, _slide(a, b, best, best + k), _NEVER)
    return None


def bits(a: np.ndarray, b: np.ndarray) -> int:
    """The edit distance by columns as long integers."""
    if len(a) == 0 or len(b) == 0:
        return max(len(a), len(b))
    n = len(a)
    order = np.argsort(a, kind="stable")
    symbols, starts = np.unique(a[order], return_index=True)
    places = dict(zip(symbols.tolist(), np.split(order, starts[1:])))
    held: dict[int, int] = {}
    room = MASKS_HELD // (n // 8 + 1)

    def mask(symbol: int) -> int:
        if symbol in held:
            return held[symbol]
        at = places.get(symbol)
        if at is None:
            return 0
        row = np.zeros(n, np.uint8)
        row[at] = 1
        value = int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little")
        if len(held) < room:
            held[symbol] = value
        return value

    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, distance = full, 0, n
    for symbol in b.tolist():
        same = mask(symbol)
        straight = same | down
        flat = (((same & up) + up) ^ up) | same
        more = down | (full & ~(flat | up))
        less = up & flat
        if more & top:
            distance += 1
        elif less & top:
            distance -= 1
        more = (more << 1 | 1) & full
        less = less << 1 & full
        up = less | (full & ~(straight | more))
        down = more & straight
    return distance


def least_edits(a: np.ndarray, b: np.ndarray) -> int:
    """No edit distance is below this: an edit takes away at most one surplus symbol of either side."""
    _, kind = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = int(kind.max()) + 1 if len(kind) else 0
    surplus = np.bincount(kind[:len(a)], minlength=n) - np.bincount(kind[len(a):], minlength=n)
    return int(max(surplus[surplus > 0].sum(), -surplus[surplus < 0].sum()))


def edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    start = common_start(a, b)
    a, b = a[start:], b[start:]
    end = common_start(a[::-1], b[::-1])
    a, b = a[:len(a) - end], b[:len(b) - end]
    if len(a) == 0 or len(b) == 0:
        return max(len(a), len(b))
    least = least_edits(a, b)
    if len(a) == len(b) and int(np.count_nonzero(a != b)) == least:
        return least  # place by place, the texts differ in no more symbols than they must
    # e^2 steps of a few nanoseconds against len(a) * len(b) / 64 word operations.
    most = 16 + int((len(a) * len(b)) ** 0.5 / 16)
    found = furthest(a, b, most) if least <= most else None
    return bits(a, b) if found is None else found


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_numbers(*texts: str) -> list[np.ndarray]:
    """The words (split at single blanks) of texts as numbers, equal words alike."""
    known: dict[str, int] = {}
    return [np.array([known.setdefault(w, len(known)) for w in t.split(" ")] if t else [], np.int64) for t in texts]
