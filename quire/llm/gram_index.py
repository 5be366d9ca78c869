"""Variable-length grams: which grams a word falls into, and how many of them one edit can change.

A word is framed by a begin and an end mark. At each place the longest gram of the
dictionary that starts there is taken, or the two code points there if none is longer, and
grams that lie within an earlier one are dropped. An edit can change
a gram that holds the place of the edit; one before it, if the text up to the edit is
the beginning of a longer gram; one behind it, if the text from the edit on is the end of a
longer gram. Every other gram of the word is also a gram of the edited word.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

QMIN, QMAX = 2, 3
BEGIN, END = "\x02", "\x03"


class Grams:
    """A dictionary of grams of QMIN + 1 to QMAX code points; every gram of QMIN code points belongs to it."""

    def __init__(self, grams):
        self.grams = frozenset(grams)
        self.heads = {g[:k] for g in self.grams for k in range(1, len(g))}  # proper beginnings
        self.tails = {g[k:] for g in self.grams for k in range(1, len(g))}  # proper endings

    def split(self, word: str) -> list[tuple[int, str]]:
        """The word's grams as (place, gram), by place."""
        s = BEGIN + word + END
        out, reach = [], 0
        for p in range(len(s) - QMIN + 1):
            to = p + QMIN
            if s[p:to] in self.heads:
                for end in range(min(len(s), p + QMAX), to, -1):
                    if s[p:end] in self.grams:
                        to = end
                        break
            if to > reach:
                out.append((p, s[p:to]))
                reach = to
        return out

    def affected(self, word: str, found: list[tuple[int, str]]) -> tuple[int, int]:
        """The most of the word's grams ``found`` that one code point more, and one replaced or deleted, can change."""
        s = BEGIN + word + END
        n = len(s)
        starts, ends = [p for p, _ in found], [p + len(g) for p, g in found]
        first, last = list(range(n + 1)), list(range(n + 1))  # [cut]: start of the longest head that ends there, end of the longest tail that starts there
        for cut in range(1, n):
            for p in range(max(0, cut - QMAX + 1), cut):
                if s[p:cut] in self.heads:
                    first[cut] = p
                    break
            for e in range(min(n, cut + QMAX - 1), cut, -1):
                if s[cut:e] in self.tails:
                    last[cut] = e
                    break
        more = other = 0
        for cut in range(1, n):  # starts and ends ascend, so the changed grams are neighbours
            low = min(bisect_left(starts, first[cut]), bisect_right(ends, cut))
            more = max(more, bisect_left(starts, cut) - low, bisect_right(ends, last[cut]) - low)  # insert before s[cut]
            if cut < n - 1:  # replace or delete s[cut]
                other = max(other, bisect_right(starts, cut) - low, bisect_right(ends, last[cut + 1]) - low)
        return more, other
