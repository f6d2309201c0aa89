"""Bin completion for one-dimensional packing, on counts of equal lengths."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np

Filling = tuple[int, ...]
# Fillings of more pieces are not asked whether another one dominates them.
DEALT = 5


class Lengths:
    """How many pieces of each length are left; finds the longest length not above a limit."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left: list[int] = [int(x) for x in counts]
        self.below: list[int] = []  # the longest length at or below, as of the last refresh
        self.refresh()

    def refresh(self) -> None:
        at = np.where(np.array(self.left) > 0, np.arange(len(self.left)), 0)
        self.below = np.maximum.accumulate(at).tolist()

    def longest(self, limit: int) -> int:
        n = self.below[limit] if limit > 0 else 0
        while n and not self.left[n]:
            n = self.below[n - 1]
        return n


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that no packing can do without: long pieces that exclude each other, and the waste they force."""
    n = np.arange(len(counts))
    total = int((counts * n).sum())
    best = -(-total // capacity)
    many, size = np.cumsum(counts[::-1])[::-1], np.cumsum(counts * n)
    half = capacity // 2
    over_half = int(many[half + 1]) if half + 1 < len(counts) else 0
    for k in range(0, half + 1):
        # Pieces over capacity - k share a bin with nothing of length k or more.
        alone = int(many[capacity - k + 1]) if capacity - k + 1 < len(counts) else 0
        middle = over_half - alone
        room = middle * capacity - int(size[capacity - k] - size[half])
        small = int(size[half] - (size[k - 1] if k else 0))
        best = max(best, alone + middle + max(0, -(-(small - room) // capacity)))
    return best


def dominates(a: Filling, b: Filling) -> bool:
    """Whether the pieces of ``b`` can be dealt into the pieces of ``a`` as if those were bins."""
    def deal(room: list[int], rest: Filling) -> bool:
        if not rest:
            return True
        for i, r in enumerate(room[:DEALT]):
            if r >= rest[0] and deal([*room[:i], r - rest[0], *room[i + 1:]], rest[1:]):
                return True
        return False

    return deal(list(a), b)


class Sums:
    """Subset sums of the pieces left: ``tables[i]`` has bit s set if pieces of the first i sizes can add up to s."""

    def __init__(self, stock: Lengths, space: int) -> None:
        self.left, self.space = stock.left, space
        self.sizes = [n for n in range(1, min(space, len(stock.left) - 1) + 1) if stock.left[n]]
        self.tables, bits, inside = [1], 1, (1 << (space + 1)) - 1
        for n in self.sizes:
            times, step = min(stock.left[n], space // n), 1
            while times > 0:
                bits |= (bits << (n * min(step, times))) & inside
                times, step = times - step, 2 * step
            self.tables.append(bits)

    def highest(self, i: int, limit: int) -> int:
        """The largest sum of the first i sizes that is not above ``limit``."""
        return (self.tables[i] & ((1 << (limit + 1)) - 1)).bit_length() - 1

    def pieces(self, target: int, i: int) -> Filling:
        """Pieces of the first i sizes that add up to ``target``, as long ones as possible."""
        out: Filling = ()
        while target:
            i = min(i, bisect_right(self.sizes, target))
            n = self.sizes[i - 1]
            times = min(self.left[n], target // n)
            while not self.tables[i - 1] >> (target - times * n) & 1:
                times -= 1
            out += (n,) * times
            target -= times * n
            i -= 1
        return out

    def around(self, i: int) -> Filling:
        """The fullest filling whose longest piece is the one of size i."""
        n = self.sizes[i - 1]
        most = min(self.left[n], self.space // n)
        rest, times = max((self.highest(i - 1, self.space - k * n) + k * n, k) for k in range(1, most + 1))
        return (n,) * times + self.pieces(rest - times * n, i - 1)


def fillings(stock: Lengths, space: int, most: int, tries: int) -> list[Filling]:
    """Undominated ways to fill ``space``, least waste first.

    Looked at are the fullest filling of all and, for each of the ``tries`` longest second pieces, the fullest one
    with it; both come from a table of subset sums, so a filling without waste is found if there is one. ``most``
    bounds the fillings returned.
    """
    sums = Sums(stock, space)
    if not sums.sizes:
        return [()]
    last = len(sums.sizes)
    found = {sums.pieces(sums.highest(last, space), last)}
    found.update(sums.around(i) for i in range(last, max(0, last - tries), -1))
    kept: list[Filling] = []
    for way in sorted(found, key=lambda f: (-sum(f), len(f), tuple(-x for x in f))):
        if not any(len(way) <= DEALT and dominates(other, way) for other in kept):
            kept.append(way)
            if len(kept) == most:
                break
    return kept


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing in bulk: around the longest piece, again and again the longest that still fits."""
    stock, out = Lengths(counts), []
    while top := stock.longest(capacity):
        way, room, need = [top], capacity - top, {top: 1}
        n = stock.longest(min(room, top))
        while n:
            if stock.left[n] > need.get(n, 0):
                way.append(n)
                need[n] = need.get(n, 0) + 1
                room -= n
                n = stock.longest(min(room, n))
            else:
                n = stock.longest(min(room, n - 1))
        times = min(stock.left[x] // k for x, k in need.items())
        for x, k in need.items():
            stock.left[x] -= k * times
        out.append((tuple(way), times))
        if len(out) % 16 == 0:
            stock.refresh()
    return out


class Level:
    """Choices at one depth of the search: what to fill and how often, the next to try, and the one in force."""

    def __init__(self, choices: list[tuple[Filling, int]], turns: int) -> None:
        self.choices, self.turns = choices, turns
        self.at, self.taken = 0, False


def pack(counts: np.ndarray, capacity: int, nodes: int = 10_000, most: int = 4,
         tries: int = 60) -> tuple[list[tuple[Filling, int]], int]:
    """Bins as (lengths in a bin, how many such bins), and the proven lower bound.

    Branch and bound over bin completions: the longest piece left gets the undominated fillings around it, least
    waste first, each applied to as many bins as its pieces allow, or to one bin only. A branch ends when its waste
    leaves no way to beat the incumbent, which is best-fit decreasing at first. Choices other than the first are
    turns; branches without a turn come first, then those with one, two and so on, as a wrong choice is as likely
    early as late. The search ends when the incumbent meets the lower bound, when no branch is left, or when
    ``nodes`` completions were tried; the incumbent is complete at any time.
    """
    n = np.arange(len(counts))
    total, bound = int((counts * n).sum()), lower_bound(counts, capacity)
    incumbent = best_fit(counts, capacity)
    bins = sum(times for _, times in incumbent)
    stock = Lengths(counts)
    path: list[tuple[Filling, int]] = []
    used, waste, spent, turns, cut = 0, 0, 0, 0, True

    def choices() -> list[tuple[Filling, int]]:
        top = stock.longest(capacity)
        stock.left[top] -= 1
        ways = [(top, *w) for w in fillings(stock, capacity - top, most, tries)]
        stock.left[top] += 1
        often = [min(stock.left[x] // way.count(x) for x in set(way)) for way in ways]
        return list(zip(ways, often)) + [(way, 1) for way, times in zip(ways, often) if times > 1]

    while cut and bins > bound and spent < nodes:
        cut, levels = False, [Level(choices(), 0)]
        while levels and bins > bound and spent < nodes:
            level = levels[-1]
            if level.taken:
                way, times = path.pop()
                for x in way:
                    stock.left[x] += times
                used, waste = used - times, waste - times * (capacity - sum(way))
                stock.refresh()
                level.taken = False
            made = level.turns + (level.at > 0)
            if level.at == len(level.choices) or made > turns:
                cut = cut or level.at < len(level.choices)
                levels.pop()
                continue
            way, times = level.choices[level.at]
            level.at += 1
            spent += 1
            for x in way:
                stock.left[x] -= times
            path.append((way, times))
            level.taken = True
            used, waste = used + times, waste + times * (capacity - sum(way))
            if total + waste > (bins - 1) * capacity:
                continue
            if stock.longest(capacity):
                levels.append(Level(choices(), made))
            elif used < bins:
                incumbent, bins = list(path), used
        turns += 1
    return incumbent, bound
