"""Control of long scoring runs: rate, retries, guard rails, run log. Driver side only."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class RateLimiter:
    """Requests a minute: halved on a refusal (not below least), a tenth more after each 100 successes (not above most)."""

    rate: float
    least: float
    most: float
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _free_at: float = field(default=0.0, init=False)
    _streak: int = field(default=0, init=False)

    def __post_init__(self) -> None:
        if not 0 < self.least <= self.most or self.rate <= 0:
            raise ValueError("rates must be positive and least not above most")
        self.rate = min(max(self.rate, self.least), self.most)

    def wait(self) -> None:
        while (left := self._free_at - self.clock()) > 0:
            self.sleep(left)
        self._free_at = self.clock() + 60 / self.rate

    def refused(self) -> None:
        self.rate, self._streak = max(self.least, self.rate / 2), 0

    def succeeded(self) -> None:
        self._streak += 1
        if self._streak == 100:
            self.rate, self._streak = min(self.most, self.rate * 1.1), 0


def backoff(attempt: int, base: float, most: float) -> float:
    """Seconds to wait before a retry: doubled each time, up to most; 0 if either is not positive."""
    return 0.0 if base <= 0 or most <= 0 else min(most, base * 2 ** max(attempt - 1, 0))


def with_retries(call: Callable[[], object], limiter: RateLimiter, retries: int, base: float = 1.0, most: float = 60.0, refused: type[Exception] = ConnectionError) -> object:
    """Call under a limiter; on a refusal back off and try again, `retries` times at most."""
    for attempt in range(retries + 1):
        limiter.wait()
        try:
            out = call()
        except refused:
            limiter.refused()
            if attempt == retries:
                raise
            limiter.sleep(backoff(attempt + 1, base, most))
        else:
            limiter.succeeded()
            return out
    raise AssertionError


def drop_rate_exceeded(dropped: int, attempted: int, most: float) -> bool:
    """Is the share of dropped items above the limit? Nothing attempted: no."""
    return attempted > 0 and dropped / attempted > most


def run_record(name: str, **figures: object) -> str:
    """One line of a run log."""
    return json.dumps({"run": name} | figures, sort_keys=True, default=str)
