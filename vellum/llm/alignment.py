"""Wagner-Fischer alignment of a conversation's turns with the alternating grammar.

A repaired conversation reads ``(s?(ua)+)?`` by its roles' initials.  For every feasible
length there is exactly one such string (odd lengths begin with ``s``), and an alignment of the
turns with it is a repair: Keep, Rerole, Delete, Insert.  Counted from its end, the string
of one length is the tail of the string of the next but one, so one table holds the tails of
all lengths: ``B[i][r]`` is the least cost of turning turns i.. into the last r letters.  Only a
band of it is filled (Ukkonen): with an incumbent repair of cost c, no cell more than c / DELETE
deletions or c / INSERT insertions off the diagonal can lie on a cheaper path.  The lengths
of least cost are traced back, and the audit first in ASCII order is the answer.

An insertion never pays: the pair around it can be removed for two deletions at most (4 < 5).
Audits of least cost hence have one letter per turn, which makes them comparable piece by
piece: a long conversation is cut, every piece is aligned from each grammar state to each
(``piece_table``), and the tables are joined like matrices (``join_tables``).
"""
from __future__ import annotations

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
INF = 1 << 40

#: Grammar states: nothing yet, after s, after u, after a.  START and DONE may end.
START, SYSTEM, USER, DONE = range(4)
STATES = 4


def _letter(r: int, end: str) -> str:
    """First of the last ``r`` letters of the alternating string that ends with ``end``."""
    return end if r % 2 else ("u" if end == "a" else "a")


def incumbent(turns: list[tuple[str, bool]]) -> int:
    """Cost of some repair: keep what fits, drop truncated turns, rerole or drop the rest."""
    cost, want, kept, system = 0, "u", 0, False
    for i, (letter, cut) in enumerate(turns):
        if cut:
            cost += DELETE
        elif letter == "s" and not kept and not system:
            system = True
        elif letter == want:
            kept, want = kept + 1, "a" if want == "u" else "u"
        elif i + 1 < len(turns) and turns[i + 1] == (want, False):
            cost += DELETE
        else:
            cost, kept, want = cost + REROLE, kept + 1, "a" if want == "u" else "u"
    if kept % 2:
        cost, kept = cost + DELETE, kept - 1
    if system and not kept:
        cost += DELETE
    return min(cost, DELETE * len(turns))


class Table:
    """Costs of turns i.. against the last r letters of the string that ends with ``end``,
    within the band of repairs that cost at most ``bound``."""

    def __init__(self, turns: list[tuple[str, bool]], end: str, bound: int):
        self.turns, self.end = turns, end
        n = len(turns)
        self.less, self.more = bound // DELETE, bound // INSERT
        self.low = [max(0, n - i - self.less) for i in range(n + 1)]
        self.high = [n - i + self.more for i in range(n + 1)]
        self.rows: list[list[int]] = [[]] * (n + 1)
        self.rows[n] = [INSERT * r for r in range(self.high[n] + 1)]
        for i in range(n - 1, -1, -1):
            letter, cut = turns[i]
            extra = TRUNCATED if cut else 0
            low, after, base = self.low[i], self.rows[i + 1], self.low[i + 1]
            out, top = [], len(after) + base
            left = INF
            for r in range(low, self.high[i] + 1):
                best = left + INSERT
                if r < top and r >= base:
                    best = min(best, after[r - base] + DELETE)
                if r > 0 and base <= r - 1 < top:
                    fit = KEEP if letter == _letter(r, end) else REROLE
                    best = min(best, after[r - 1 - base] + fit + extra)
                out.append(best)
                left = best
            self.rows[i] = out

    def cost(self, i: int, r: int) -> int:
        at = r - self.low[i]
        return self.rows[i][at] if 0 <= at < len(self.rows[i]) else INF

    def lengths(self, i: int, parity: int, least: int) -> list[int]:
        """Lengths of that parity, ``least`` or more, inside the band at turn i."""
        first = max(self.low[i], least)
        return list(range(first + (first - parity) % 2, self.high[i] + 1, 2))

    def trace(self, i: int, r: int) -> str:
        """The first audit in ASCII order among those of least cost from (i, r)."""
        out, n = [], len(self.turns)
        while i < n or r > 0:
            c = self.cost(i, r)
            if i < n and self.cost(i + 1, r) + DELETE == c:
                out.append("D")
                i += 1
            elif r > 0 and self.cost(i, r - 1) + INSERT == c:
                out.append("I")
                r -= 1
            else:
                keep = self.turns[i][0] == _letter(r, self.end)
                out.append("K" if keep else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def _between(tables: dict[str, Table], i: int, p: int, q: int) -> tuple[int, list]:
    """(least cost, candidates) of leading from state p (not START) to q over turns i..; a
    candidate is (table, length)."""
    t = tables["a" if q == DONE else "u"]
    n = len(t.turns)
    if q in (START, SYSTEM):
        return (DELETE * (n - i), [(t, 0)]) if p == q else (INF, [])
    # The next letter is a after u, else u; the last one is q's.
    parity = int((p == USER) == (q == DONE))
    least = 0 if p == q else 1
    best, found = INF, []
    for r in t.lengths(i, parity, least):
        c = t.cost(i, r)
        if c < best:
            best, found = c, []
        if c == best < INF:
            found.append((t, r))
    return best, found


def between(tables: dict[str, Table], p: int, q: int) -> tuple[int, str | None]:
    """Least cost and first audit of leading from state p to state q."""
    turns = next(iter(tables.values())).turns
    if p != START:
        cost, found = _between(tables, 0, p, q)
        return cost, min((t.trace(0, r) for t, r in found), default=None)
    n = len(turns)
    options = []
    if q == START:
        return DELETE * n, "D" * n
    if q != SYSTEM:                                     # no system turn: as from DONE, not empty
        t = tables["a" if q == DONE else "u"]
        options += [(t.cost(0, r), "", t, 0, r) for r in t.lengths(0, 0 if q == DONE else 1, 1)]
    for i, (letter, cut) in enumerate(turns):           # turn i is kept as the system turn
        if letter == "s":
            cost, found = _between(tables, i + 1, SYSTEM, q)
            lead = DELETE * i + (TRUNCATED if cut else 0)
            options += [(lead + cost, "D" * i + "K", t, i + 1, r) for t, r in found]
    best = min((o[0] for o in options), default=INF)
    if best >= INF:
        return INF, None
    return best, min(lead + (t.trace(i, r) if q != SYSTEM else "D" * (n - i))
                     for c, lead, t, i, r in options if c == best)


def _weave(audit: str, dropped: list[bool]) -> str:
    """Puts the required deletions back: each as early as it can stand (D is first)."""
    out, steps = [], iter(audit)
    for gone in dropped:
        if gone:
            out.append("D")
            continue
        for s in steps:
            out.append(s)
            if s != "I":
                break
    return "".join(out) + "".join(steps)


def align(letters: list[str], faults: list[str]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation.  ``faults``: b, d (must go), t or empty."""
    dropped = [f in ("b", "d") for f in faults]
    turns = [(a, f == "t") for a, f, gone in zip(letters, faults, dropped) if not gone]
    bound = incumbent(turns)
    tables = {"a": Table(turns, "a", bound)}
    cost, audit = min(o for o in (between(tables, START, START), between(tables, START, DONE)) if o[0] < INF)
    return cost + DELETE * sum(dropped), _weave(audit, dropped)


def piece_table(letters: list[str], faults: list[str]) -> tuple[list[int], list[str], list[int]]:
    """Per (entry, exit) state of a piece, row by row: costs, audits, and the place of the
    audit among those of the same entry."""
    dropped = [f in ("b", "d") for f in faults]
    turns = [(a, f == "t") for a, f, gone in zip(letters, faults, dropped) if not gone]
    # Any pair of states costs at most two insertions at either end, and the system turn, more.
    bound = incumbent(turns) + 4 * INSERT + DELETE
    tables = {e: Table(turns, e, bound) for e in "au"}
    costs, audits = [], []
    for p in range(STATES):
        for q in range(STATES):
            cost, audit = between(tables, p, q)
            costs.append(min(INF, cost + DELETE * sum(dropped)))
            audits.append("" if audit is None else _weave(audit, dropped))
    return costs, audits, _places(costs, audits)


def _places(costs: list[int], keys: list) -> list[int]:
    out = [STATES] * (STATES * STATES)
    for p in range(STATES):
        row = sorted((keys[k], k) for k in range(p * STATES, (p + 1) * STATES) if costs[k] < INF)
        for place, (_, k) in enumerate(row):
            out[k] = place
    return out


def join_tables(parts: list[tuple[list[int], list[int]]]) -> tuple[list[int], list[int], list[str]]:
    """(costs, places, paths) of consecutive parts (costs, places): a path lists the states
    after each part, as digits, of the cheapest and then first way through."""
    costs, keys, paths = [], [], []
    for p in range(STATES):
        best = {p: (0, (), "")}
        for c, place in parts:
            nxt: dict[int, tuple] = {}
            for s, (cost, key, path) in best.items():
                for q in range(STATES):
                    k = s * STATES + q
                    if c[k] < INF:
                        cand = (cost + c[k], key + (place[k],), path + str(q))
                        if q not in nxt or cand < nxt[q]:
                            nxt[q] = cand
            best = nxt
        for q in range(STATES):
            cost, key, path = best.get(q, (INF, (), ""))
            costs.append(cost)
            keys.append(key)
            paths.append(path)
    return costs, _places(costs, keys), paths


def repaired_roles(roles: list[str], letters: list[str], audit: str, state: int = START) -> list[tuple[int, str]]:
    """(turn or -1 for an insertion, role) of the repaired turns."""
    out, i = [], 0
    for step in audit:
        if step == "D":
            i += 1
            continue
        if step == "K":
            role, letter = roles[i], letters[i]
        else:
            letter = "a" if state == USER else "u"
            role = "assistant" if letter == "a" else "user"
        out.append((-1 if step == "I" else i, role))
        state = {"s": SYSTEM, "u": USER}.get(letter, DONE)
        i += step != "I"
    return out
