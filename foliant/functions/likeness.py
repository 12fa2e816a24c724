"""Whether difflib's ratio of two texts reaches a bound, told without the whole ratio.

difflib takes the longest common run of two texts, then those of what stands on either side of it. Parts are matched
here in the same way until what is matched reaches the bound, or what is left can't. In short texts the signs that agree
are the bits of one large integer, a row of bits for each sign of the first text: a run of n signs is a bit of the
n-fold conjunction of that integer with itself, each shifted by a row and a sign, and the lowest bit is the run that
difflib takes. In long ones difflib starts runs at rare signs alone, so only the places of these are looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

#: difflib's rule: in a second text of so many signs, those that make up more than a hundredth of it start no run.
FREQUENT = 200
#: The largest integer of bits.
BITS = 1 << 18
#: The longest run in a part (a from, a to, b from, b to), the earliest of those: where it starts in a and b, and its size.
Longest = Callable[[int, int, int, int], tuple[int, int, int]]


@lru_cache(maxsize=1024)
def _column(rows: int, width: int) -> int:
    """A bit at the beginning of each row."""
    return int.from_bytes((b"\1" + bytes(width // 8 - 1)) * rows, "little")


def _by_bits(a: str, b: str, places: dict[str, list[int]]) -> Longest:
    width = len(b) // 8 * 8 + 8  # whole bytes, with at least one bit that stays empty
    row = {c: sum(1 << j for j in at).to_bytes(width // 8, "little") for c, at in places.items()}
    empty = bytes(width // 8)
    same = int.from_bytes(b"".join([row.get(c, empty) for c in a]), "little")

    def longest(alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        column = _column(ahi - alo, width)
        found = same >> alo * width & (column << bhi) - (column << blo)
        runs, last, size = found, 0, 0
        while runs:
            last, size = runs, size + 1
            runs &= found >> size * (width + 1)
        i, j = divmod((last & -last).bit_length() - 1, width) if size else (0, blo)
        return alo + i, j, size

    return longest


def _by_places(a: str, b: str, places: dict[str, list[int]]) -> Longest:
    rare = [i for i, c in enumerate(a) if c in places]

    def longest(alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        best, ends, before = (alo, blo, 0), {}, -2
        for i in rare[bisect_left(rare, alo) : bisect_left(rare, ahi)]:
            last, ends = ends if i == before + 1 else {}, {}
            for j in places[a[i]]:
                if j >= bhi:
                    break
                if j >= blo:
                    k = ends[j] = last.get(j - 1, 0) + 1
                    if k > best[2]:
                        best = (i - k + 1, j - k + 1, k)
            before = i
        return best

    return longest


def alike(a: str, b: str, least: float) -> bool:
    """difflib.SequenceMatcher(None, a, b).ratio() >= least."""
    n, m = len(a), len(b)
    total = n + m
    enough = lambda matched: (2.0 * matched / total if total else 1.0) >= least
    if not enough(min(n, m)):
        return False
    places: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        places.setdefault(c, []).append(j)
    if m >= FREQUENT:
        places = {c: at for c, at in places.items() if len(at) <= m // 100 + 1}
    longest = (_by_bits if m < FREQUENT and n * m < BITS else _by_places)(a, b, places)
    matched, left, todo = 0, min(n, m), [(0, n, 0, m)] if n and m else []
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        i, j, size = longest(alo, ahi, blo, bhi)
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        left -= min(ahi - alo, bhi - blo)
        if size:
            matched += size
            if enough(matched):
                return True
            for part in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)):
                if rows := min(part[1] - part[0], part[3] - part[2]):
                    left += rows
                    todo.append(part)
        if not enough(matched + left):
            return False
    return enough(matched)
