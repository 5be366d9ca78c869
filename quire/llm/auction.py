"""Bertsekas' auction for a shortest path through the lattice of a block of turns.

A node is a place between the block's turns and a state: nothing yet, after a system turn,
after a user turn, after an assistant turn. Its arcs are edits: Delete or Keep or Rerole the
next turn, or Insert one; behind the last turn a state costs what leaving with it costs. Node prices never
exceed an arc's cost plus the price at its end. A path grows from its origin by an arc on
which the two are equal, and where there is none its last node's price rises to the least of
them and the path gives the node up. When it leaves the block, it is a shortest one and its origin's price is its cost.

Of arcs that are equal, the path takes the one with the least letter. Prices only rise,
and a node's own stays while it is within the path, so an arc that is equal in the end was
so when its node chose; and every arc of every shortest path is equal in the end. A
state and a letter lead to one node. So the path has the least letters of all shortest ones.
"""

from __future__ import annotations

#: Codes of a turn: its role's initial (s, u, a, another), and flags.
INITIALS, OTHER, MUST_GO, CUT = "sua", 3, 4, 8
#: Costs of edits; CUT_COST is added for a turn that stays though its end is cut off.
DELETE, INSERT, REROLE, CUT_COST = 4, 3, 3, 3
#: The state after a turn that was added or got another role, by the state before.
ADDED = (2, 2, 3, 2)
#: The same after a turn that is kept, by its initial; -1 where it may not follow.
KEPT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
ROLES = ("", "", "user", "assistant")
#: What is added behind a conversation's last turn, by the state there, and its cost.
TAILS = ("", "II", "I", "")
ENDS = [INSERT * len(t) for t in TAILS]
INFINITE = 1 << 60


class Lattice:
    """A block of turns; ``exits`` is what leaving it in each state costs."""

    def __init__(self, codes: bytes, exits: list[int]):
        self.codes, self.exits = codes, exits
        price = min(exits)
        prices = [price] * 4
        for code in reversed(codes):  # no turn costs less than this, so these prices allow every arc
            price += DELETE if code & MUST_GO else CUT_COST if code & CUT else 0
            prices += [price] * 4
        self.prices = prices[::-1]

    def path(self, entry: int) -> tuple[int, str, int]:
        """Cost with the exit, letters, and state at the end of the least shortest path from ``entry``. Prices stay good for the next one."""
        codes, exits, price = self.codes, self.exits, self.prices
        n, way, letters = len(codes), [entry], []
        while True:
            node = way[-1]
            i, state = node >> 2, node & 3
            if i == n:
                best = exits[state]
                if price[node] >= best:
                    return price[entry], "".join(letters), state
            else:
                code, row = codes[i], i << 2
                best, letter, to = DELETE + price[node + 4], "D", node + 4
                added = ADDED[state]
                cost = INSERT + price[row + added]
                if cost < best:
                    best, letter, to = cost, "I", row + added
                if not code & MUST_GO:
                    more = CUT_COST if code & CUT else 0
                    kept = KEPT[state][code & 3]
                    if kept >= 0 and more + price[row + 4 + kept] < best:
                        best, letter, to = more + price[row + 4 + kept], "K", row + 4 + kept
                    cost = REROLE + more + price[row + 4 + added]
                    if cost < best:
                        best, letter, to = cost, "R", row + 4 + added
                if price[node] >= best:
                    way.append(to)
                    letters.append(letter)
                    continue
            price[node] = best
            if len(way) > 1:
                way.pop()
                letters.pop()


def costs(codes: bytes) -> list[int]:
    """The 16 costs of crossing a block with turns, by the states before and behind it."""
    out = [INFINITE] * 16
    for state in (2, 3):
        lattice = Lattice(codes, [0 if x == state else INFINITE for x in range(4)])
        for entry in range(4):
            out[4 * entry + state] = lattice.path(entry)[0]
    # Nothing leads back to the first two states: one stays in them by deleting, and enters the second by keeping a system turn.
    out[0] = out[5] = DELETE * len(codes)
    first = min((CUT_COST if c & CUT else 0 for c in codes if not c & MUST_GO and c & 3 == 0), default=INFINITE)
    out[1] = min(INFINITE, DELETE * (len(codes) - 1) + first)
    return out


def repaired(letters: str, entry: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The turns that the letters make of a block's turns."""
    out, i, state = [], 0, entry
    for letter in letters:
        if letter == "I":
            state = ADDED[state]
            out.append((ROLES[state], ""))
            continue
        if letter != "D":
            state = ADDED[state] if letter == "R" else KEPT[state][INITIALS.find(roles[i][:1])]
            out.append((ROLES[state] if letter == "R" else roles[i], texts[i]))
        i += 1
    return out
