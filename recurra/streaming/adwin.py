"""ADWIN: a mean over a window that shrinks when its two parts differ (Bifet and Gavalda, 2007)."""

from __future__ import annotations

import math


class Adwin:
    """Exponential histogram of at most `per_row` buckets of each power of two."""

    def __init__(self, delta: float = 0.002, clock: int = 32, per_row: int = 5, least: int = 5):
        self.delta, self.clock, self.per_row, self.least = delta, clock, per_row, least
        self.reset()

    def reset(self) -> None:
        self.rows: list[list[tuple[float, float]]] = [[]]  # per power of two: (sum, squared deviation), oldest first
        self.width, self.total, self.spread, self.ticks = 0, 0.0, 0.0, 0
        self.before = self.after = 0.0

    @property
    def mean(self) -> float:
        return self.total / self.width if self.width else 0.0

    @property
    def variance(self) -> float:
        return self.spread / self.width if self.width else 0.0

    def add(self, value: float) -> bool:
        """Take a value in; true if the window was cut."""
        if self.width:
            d = value - self.mean
            self.spread += self.width * d * d / (self.width + 1)
        self.width += 1
        self.total += value
        self.rows[0].append((value, 0.0))
        self._compress()
        self.ticks += 1
        return self.ticks % self.clock == 0 and self.width > 2 * self.least and self._cut()

    def _compress(self) -> None:
        for i in range(len(self.rows)):
            if len(self.rows[i]) <= self.per_row:
                break
            (s1, v1), (s2, v2) = self.rows[i][:2]
            del self.rows[i][:2]
            n = 1 << i
            d = s1 / n - s2 / n
            if i + 1 == len(self.rows):
                self.rows.append([])
            self.rows[i + 1].append((s1 + s2, v1 + v2 + n * d * d / 2))

    def _cut(self) -> bool:
        changed = False
        while self.width > 2 * self.least and self._cut_once(not changed):
            changed = True
        return changed

    def _cut_once(self, first: bool) -> bool:
        """Drop the oldest bucket if any cut point parts two unlike means; remember the means of the first cut."""
        n0, s0 = 0, 0.0
        d = math.log(2 * math.log(self.width) / self.delta)
        variance = self.variance
        for i in range(len(self.rows) - 1, -1, -1):
            for s, _ in self.rows[i]:
                n0, s0 = n0 + (1 << i), s0 + s
                n1 = self.width - n0
                if n1 < self.least:
                    return False
                if n0 < self.least:
                    continue
                u0, u1 = s0 / n0, (self.total - s0) / n1
                m = 1 / (n0 - self.least + 1) + 1 / (n1 - self.least + 1)
                if abs(u0 - u1) > math.sqrt(2 * m * variance * d) + 2 / 3 * m * d:
                    if first:
                        self.before, self.after = u0, u1
                    self._drop()
                    return True
        return False

    def _drop(self) -> None:
        """Forget the oldest bucket."""
        i = len(self.rows) - 1
        s, v = self.rows[i].pop(0)
        n = 1 << i
        self.width -= n
        self.total -= s
        d = s / n - self.mean
        self.spread = max(0.0, self.spread - v - n * self.width * d * d / (n + self.width)) if self.width else 0.0
        while len(self.rows) > 1 and not self.rows[-1]:
            self.rows.pop()

    def fell(self, value: float) -> bool:
        """Add a value; true if the window was cut and the mean went down."""
        return self.add(value) and self.after < self.before

    def rose(self, value: float) -> bool:
        return self.add(value) and self.after > self.before
