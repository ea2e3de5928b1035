"""Calls of a service for each row: one client a task, a token bucket, exponential back-off, and failures as data."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


def passing(error: Exception) -> bool:
    """[FLT-21] Whether an error's message tells that it passes."""
    return any(w in str(error).lower() for w in config.DEFAULT.retryable)


@dataclass(frozen=True)
class Policy:
    """[UDF-5, SNK-8] At most ``tries`` calls of a row, waits of ``base`` * ``factor`` ** k between them (``most`` at most), and ``rate`` calls a
    second in each task after the first ``burst`` (None: no limit). All tasks that run at once share a service's limit, so divide it by them."""

    tries: int = 3
    base: float = 2.0
    factor: float = 2.0
    most: float = 60.0
    rate: float | None = None
    burst: int = 1
    again: Callable[[Exception], bool] = passing
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep


@dataclass
class Caller:
    """A client under a policy. ``client`` is what is called with a text."""

    client: Callable[[str], str | None]
    policy: Policy
    tokens: float = field(init=False)
    at: float = field(init=False)

    def __post_init__(self) -> None:
        self.tokens, self.at = float(self.policy.burst), self.policy.clock()

    def wait(self) -> None:
        """Take a token, or wait until there is one."""
        p = self.policy
        if p.rate is None:
            return
        now = p.clock()
        self.tokens, self.at = min(float(p.burst), self.tokens + (now - self.at) * p.rate), now
        if self.tokens < 1:
            p.sleep((1 - self.tokens) / p.rate)
            self.at, self.tokens = p.clock(), 1.0
        self.tokens -= 1

    def __call__(self, text: str) -> dict:
        p = self.policy
        for attempt in range(p.tries):
            self.wait()
            try:
                return {"value": self.client(text), "error": None, "attempts": attempt + 1}
            except Exception as e:
                if attempt + 1 == p.tries or not p.again(e):
                    return {"value": None, "error": f"{type(e).__name__}: {e}"[:500], "attempts": attempt + 1}
            p.sleep(min(p.most, p.base * p.factor**attempt))
        return {"value": None, "error": "no try allowed", "attempts": 0}


_KIND = "struct<value: string, error: string, attempts: int>"


def called(connect: Callable[[], Callable[[str], str | None]], policy: Policy = Policy()) -> Callable[[Column], Column]:
    """[UDF-3, UDF-5] A column of (value, error, attempts) for a column of texts.

    ``connect`` makes a client; every task calls it once, before its first text. Rows that fail for good carry their error, the others go
    on; null and blank texts are not sent and have neither value nor error. A task that is run again asks the service again.
    """

    @F.arrow_udf(_KIND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        caller = None
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                if t is None or not t.strip():
                    out.append({"value": None, "error": None, "attempts": 0})
                    continue
                caller = caller or Caller(connect(), policy)
                out.append(caller(t))
            yield pa.array(out, pa.struct([("value", pa.string()), ("error", pa.string()), ("attempts", pa.int32())]))

    return run
