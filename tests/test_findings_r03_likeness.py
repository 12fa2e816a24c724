"""likeness as difflib tells it, in less time."""

from __future__ import annotations

import difflib
import random
import time

from foliant.functions import models as M
from foliant.functions.likeness import alike


def _ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def test_alike_is_difflibs_ratio():
    """Texts of few and many signs, on both sides of difflib's rule for frequent signs, and empty ones."""
    chance = random.Random(6)
    pairs = [("", ""), ("", "a"), ("a", ""), ("a" * 300, "a" * 300), ("ab" * 150, "ba" * 150), ("x" * 5000, "x" * 150)]
    for longest, n in ((40, 2500), (500, 250)):
        for _ in range(n):
            signs = chance.choice(["ab", "abcdef", "abcdefghijklm é译", "".join(map(chr, range(97, 300)))])
            a, b = ("".join(chance.choices(signs, k=chance.randrange(longest))) for _ in range(2))
            pairs.append((a, chance.choice([b, a[::-1], a.replace("e", "é"), a[: len(a) // 2] + b[len(b) // 2 :]])))
    for a, b in pairs:
        ratio = _ratio(a, b)
        for least in (0.1, 0.3, 0.55, 0.8, ratio):
            assert alike(a, b, least) == (ratio >= least), (a, b, least)


def test_verdicts_take_less_than_ratios():
    chance = random.Random(7)
    word = lambda: "".join(chance.choices("etaoinshrdlucm", k=chance.randint(2, 9)))
    lines = [" ".join(word() for _ in range(n)) for n in (15, 20, 25, 28) * 15]

    def seconds(judge):
        began = time.perf_counter()
        for x in lines:
            judge(x, x[::-1])
            judge(x, x.replace("e", "é"))
        return time.perf_counter() - began

    assert min(seconds(M.change_refused) for _ in range(3)) * 1.5 < min(seconds(_ratio) for _ in range(3))
