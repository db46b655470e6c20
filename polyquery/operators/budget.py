"""Leased budgets: an ordered fold over a command log, and the sums that need no order."""

from __future__ import annotations

from collections import namedtuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLACK_MS = 1500  # what a lease's reclaim waits beyond its time to live, besides the largest pause
STATE = "ns string, budget string, cap bigint, available bigint, leased bigint, spent bigint, granted bigint, refused bigint, errors bigint"
Command = namedtuple("Command", "ns budget op lease holder amount ttl rate burst pause now log_index")


class Pool:
    """One budget's state; apply() takes commands in log order. cap = available + leased + spent, always."""

    def __init__(self) -> None:
        self.cap: int | None = None
        self.available = self.spent = self.granted = self.refused = self.errors = 0
        self.rate = self.burst = self.tokens = self.at = self.pause = 0
        self.leases: dict[str, dict] = {}
        self.settled: dict[str, int] = {}

    @property
    def leased(self) -> int:
        return sum(x["amount"] - x["spent"] for x in self.leases.values())

    def refill(self, now: int) -> None:
        if self.rate > 0 and now > self.at:
            self.tokens = min(self.burst, self.tokens + self.rate * (now - self.at) // 1000)
        self.at = max(self.at, now)

    def apply(self, c) -> None:
        getattr(self, f"do_{c.op}", self.fail)(c)

    def fail(self, c=None) -> None:
        self.errors += 1

    def do_define(self, c) -> None:
        if self.cap is not None or c.amount < 0:
            return self.fail()
        self.cap = self.available = int(c.amount)
        self.rate, self.burst, self.pause, self.at = int(c.rate), int(c.burst or c.amount), int(c.pause), int(c.now)
        self.tokens = self.burst if self.rate > 0 else 0

    def do_grant(self, c) -> None:
        if self.cap is None:
            return self.fail()
        if c.lease in self.settled:
            return self.fail()
        if c.lease in self.leases:
            return  # granted before: the same answer
        self.refill(int(c.now))
        amount = min(int(c.amount), self.available, *([self.tokens] if self.rate > 0 else []))
        if amount <= 0:
            self.refused += 1
            return
        if self.rate > 0:
            self.tokens -= amount
        self.available -= amount
        self.granted += 1
        self.leases[c.lease] = {"amount": amount, "spent": 0, "holder": c.holder, "reclaim": int(c.now) + int(c.ttl) + SLACK_MS + self.pause if c.ttl > 0 else None}

    def do_report(self, c) -> None:
        lease = self.leases.get(c.lease)
        if lease is None or lease["holder"] != c.holder:
            return self.fail()
        spent = max(lease["spent"], min(int(c.amount), lease["amount"]))
        self.spent += spent - lease["spent"]
        lease["spent"] = spent

    def do_return(self, c) -> None:
        lease = self.leases.get(c.lease)
        if lease is None or lease["holder"] != c.holder:
            return self.fail()
        self.do_report(c)
        self.available += lease["amount"] - lease["spent"]
        del self.leases[c.lease]
        if lease["reclaim"] is not None:
            self.settled[c.lease] = lease["reclaim"]

    def do_expire(self, c) -> None:
        for k, lease in list(self.leases.items()):
            if lease["reclaim"] is not None and c.now >= lease["reclaim"]:
                self.spent += lease["amount"] - lease["spent"]  # what wasn't reported counts as spent
                self.settled[k] = lease["reclaim"]
                del self.leases[k]

    def do_collect(self, c) -> None:
        self.settled = {k: r for k, r in self.settled.items() if c.now < r + int(c.ttl)}

    def do_reconcile(self, c) -> None:
        if self.cap is None:
            return self.fail()
        self.spent = min(max(int(c.amount), self.spent), self.cap)
        self.available = max(0, self.cap - self.spent - self.leased)


def fold(log: DataFrame) -> DataFrame:
    """Final state of each budget from commands (ns, budget, log_index, op, lease, holder, amount, ttl, rate, burst, pause, now).

    Commands change one budget only and their order counts: budgets are dealt over tasks, and each task folds its
    sorted commands as they come, holding one budget's state and never its log. Null numbers count as 0.
    """
    numbers = [F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in ("amount", "ttl", "rate", "burst", "pause", "now")]
    rows = log.select("ns", "budget", "op", "lease", "holder", *numbers, "log_index").repartition("ns", "budget")

    def run(batches):
        key, pool = None, None
        for b in batches:
            done = []
            for c in map(Command._make, zip(*(x.to_pylist() for x in b.columns), strict=True)):
                if (c.ns, c.budget) != key or pool is None:
                    if pool is not None:
                        done.append(state(key, pool))
                    key, pool = (c.ns, c.budget), Pool()
                pool.apply(c)
            if done:
                yield table(done)
        if pool is not None:
            yield table([state(key, pool)])

    return rows.sortWithinPartitions("ns", "budget", "log_index").mapInArrow(run, STATE)


def state(key: tuple, pool: Pool) -> tuple:
    return (*key, pool.cap or 0, pool.available, pool.leased, pool.spent, pool.granted, pool.refused, pool.errors)


def table(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in STATE.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if k == "string" else pa.int64()) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def reported(reports: DataFrame, leases: DataFrame) -> DataFrame:
    """(budget, spent) from cumulative reports (lease, amount) of untimed leases (budget, lease, amount): no order needed."""
    most = reports.groupBy("lease").agg(F.max("amount").alias("reported"))
    spent = F.least(F.coalesce("reported", F.lit(0)), "amount")
    return leases.join(most, "lease", "left").groupBy("budget").agg(F.sum(spent).cast("bigint").alias("spent"))


class Spender:
    """A holder's side of a lease: it spends from the chunks it was granted, in order, each up to its deadline.

    After a pause longer than it may be (0: any), all chunks are dropped, since the lease may be gone: only a new grant
    serves again. With a rate, spends are paced by tokens that accrue with time, up to `burst`.
    """

    def __init__(self, pause: int, rate: int = 0, burst: int = 0, now: int = 0) -> None:
        self.pause, self.rate, self.burst = pause, rate, burst
        self.tokens, self.at = burst, now
        self.chunks: list[list] = []  # [left, deadline or None]
        self.last: int | None = None

    def grant(self, amount: int, deadline: int | None = None) -> None:
        self.chunks.append([amount, deadline])

    def spend(self, n: int, now: int) -> bool:
        """Whether n was spent; what is refused (paused, paced, empty) changes no chunk that is still good."""
        if n <= 0:
            return True
        if self.last is not None and 0 < self.pause < now - self.last:
            self.chunks, self.last = [], now
            return False
        if self.rate > 0:
            self.tokens = min(self.burst, self.tokens + self.rate * max(0, now - self.at) // 1000)
            self.at = now
            if self.tokens < n:
                return False
        while self.chunks and (self.chunks[0][0] == 0 or (self.chunks[0][1] is not None and now >= self.chunks[0][1])):
            self.chunks.pop(0)
        if not self.chunks or self.chunks[0][0] < n:
            return False
        self.chunks[0][0] -= n
        if self.rate > 0:
            self.tokens -= n
        self.last = now
        return True
