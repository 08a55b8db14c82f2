"""Order books: the levels of a side with their best price at hand, plain and live books."""

from __future__ import annotations

import heapq

#: Prices this close count as one level.
NEAR = 1e-9
#: Fixed value: size shown at a best price that the exchange reports and no level holds.
REPORTED_SIZE = 100.0


class Side:
    """Levels (price -> size) and a heap of prices, best first; prices without a level
    leave the heap when they come to its top."""

    def __init__(self, bids: bool, levels: dict[float, float] | None = None):
        self._sign = -1.0 if bids else 1.0
        self.replace((levels or {}).items())

    def replace(self, levels) -> None:
        self.levels = {p: s for p, s in levels if s > 0}
        self._heap = [self._sign * p for p in self.levels]
        heapq.heapify(self._heap)

    def put(self, price: float, size: float) -> None:
        if size <= 0:
            self.levels.pop(price, None)
        else:
            if price not in self.levels:
                heapq.heappush(self._heap, self._sign * price)
            self.levels[price] = size

    def best(self) -> float | None:
        while self._heap and self._sign * self._heap[0] not in self.levels:
            heapq.heappop(self._heap)
        return self._sign * self._heap[0] if self._heap else None

    def cut(self, limit: float, slack: float) -> None:
        """Drop levels better than ``limit`` by more than ``slack`` (negative: also up to it)."""
        while (p := self.best()) is not None and self._sign * (limit - p) > slack:
            del self.levels[p]


class LiveBook:
    """A token's book between snapshots, kept in step with the exchange's own best prices.

    A change that reports a best price prunes levels beyond it; one that reports none takes
    the side's own. If the two best prices then do not cross, levels that reach the other
    side's go too.
    """

    def __init__(self, bids: dict | None = None, asks: dict | None = None, told: tuple = (None, None), initialized: bool = False, degraded: bool = False):
        self.sides = Side(True, bids), Side(False, asks)
        self.told, self.initialized, self.degraded = list(told), initialized, degraded

    def snapshot(self, bids, asks) -> None:
        for k, levels in enumerate((bids, asks)):
            self.sides[k].replace(levels)
            self.told[k] = self.sides[k].best()
        self.initialized, self.degraded = True, False

    def change(self, side: str, price: float | None, size: float | None, best_bid: float | None, best_ask: float | None) -> None:
        at = {"BUY": 0, "SELL": 1}.get(side)
        if at is not None and price is not None and size is not None:
            self.sides[at].put(price, size)
        for k, reported in enumerate((best_bid, best_ask)):
            if reported is None:
                self.told[k] = self.sides[k].best()
            elif reported > 0:
                self.told[k] = reported
                self.sides[k].cut(reported, NEAR)
        bid, ask = (self.told[k] or self.sides[k].best() for k in (0, 1))
        if bid is not None and ask is not None and bid < ask:
            self.sides[0].cut(ask, -NEAR)
            self.sides[1].cut(bid, -NEAR)

    def top(self) -> tuple[float | None, float | None, float, float]:
        """Best bid, best ask, and the sizes shown there."""
        prices, sizes = [], []
        for k, better in ((0, max), (1, min)):
            own, told = self.sides[k].best(), self.told[k]
            best = told if own is None else own if told is None else better(own, told)
            prices.append(best)
            sizes.append(0.0 if best is None else self.sides[k].levels.get(best, REPORTED_SIZE))
        return (*prices, *sizes)
