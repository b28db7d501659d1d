"""Stateful streams in the order of event time: locks after runs of failures with their ends, and ledgers that grow by case."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from caseloom.operators.ledger import FIRST_PREVIOUS

#: step(own, at, tie, rest) gives the next own state, rows to put out, and (at, tie, rest) of what is to come back later.
Step = Callable[[tuple, int, int, tuple], tuple[tuple, list[tuple], list[tuple[int, int, tuple]]]]


#: Groups into which keys are dealt: each wakes once a trigger and holds the state of its keys.
BUCKETS = 1024


def in_time_order(stream: DataFrame, key: str, ts: str, tie: str, columns: dict[str, str], state: dict[str, tuple[str, object]], step: Step, output: str, late: str, buckets: int = BUCKETS) -> DataFrame:
    """What `step` puts out for the rows of each key, taken by time and then by `tie` (a long), whatever order they arrive in.

    A row waits in the state until the watermark, `late` behind the latest time seen, has passed it; a timer wakes
    keys without new rows. Rows later than that are dropped by the watermark; rows without key or time are left out.
    `columns` are the types of the other columns that a row carries, `state` the type and first value of what `step`
    remembers of a key. Keys share a group by their hash, as a group of its own for each of very many keys costs more than its
    rows; a group's state is what its keys remember and the rows of one span of `late`.
    """
    names, first = list(columns), tuple(v for _, v in state.values())
    held = {"_at": "long", "_tie": "long", **columns}
    own = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_time", F.col(ts).cast("timestamp")).withWatermark("_time", late)
    own = own.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_bucket"), F.col(key).alias("_key"), "_time", F.unix_micros("_time").alias("_at"), F.coalesce(F.col(tie).cast("long"), F.lit(-1)).alias("_tie"), *names)
    kind = dict(own.dtypes)["_key"]

    def run(_: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        serial = count()
        mine, waiting = {}, []
        if group.exists:
            known, *kept = group.get
            mine = dict(zip(known, zip(*kept[: len(first)], strict=True), strict=True))
            waiting = [(at, t, next(serial), who, tuple(rest)) for who, at, t, *rest in zip(*kept[len(first) :], strict=True)]
        for frame in frames:
            waiting += [(at, t, next(serial), who, tuple(rest)) for who, at, t, *rest in zip(*(frame[c].tolist() for c in ("_key", *held)), strict=True)]
        heapq.heapify(waiting)
        mark, out = group.getCurrentWatermarkMs(), []
        while waiting and waiting[0][0] // 1000 < mark:
            at, t, _, who, rest = heapq.heappop(waiting)
            mine[who], found, later = step(mine.get(who, first), at, t, rest)
            out += found
            for when, t, rest in later:
                heapq.heappush(waiting, (when, t, next(serial), who, rest))
        rows = [(who, at, t, *rest) for at, t, _, who, rest in sorted(waiting)]
        lists = lambda found, n: [list(c) for c in zip(*found, strict=True)] or [[]] * n
        group.update((list(mine), *lists(mine.values(), len(first)), *lists(rows, len(held) + 1)))
        if rows:
            group.setTimeoutTimestamp(max(rows[0][1] // 1000, mark + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in output.split(", ")])

    kinds = ", ".join([f"_keys array<{kind}>", *(f"{c} array<{t}>" for c, (t, _) in state.items()), f"_whose array<{kind}>", *(f"{c} array<{t}>" for c, t in held.items())])
    return own.groupBy("_bucket").applyInPandasWithState(run, output, kinds, "append", GroupStateTimeout.EventTimeTimeout)


def locks(logins: DataFrame, failures: int = 5, minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """(user_id, ts, kind) of a stream logins(user_id, login_id, ts, success): locked, when a run of failures reaches the limit, and released, when that lock ends.

    A success ends a run; rows whose success is null are neither. Each lock has its own end, also if the next one comes before it.
    """
    span = minutes * 60_000_000
    own = logins.where("success is not null").select("user_id", "ts", "login_id", F.col("success").cast("long").alias("ok"), F.col("user_id").cast("long").alias("who"))

    def step(mine: tuple, at: int, tie: int, rest: tuple) -> tuple:
        ok, who = rest
        if ok == 2:  # the end of a lock
            return mine, [(who, at, "released")], []
        streak = 0 if ok else mine[0] + 1
        if streak != failures:
            return (streak,), [], []
        return (streak,), [(who, at, "locked")], [(at + span, tie, (2, who))]

    out = in_time_order(own, "user_id", "ts", "login_id", {"ok": "long", "who": "long"}, {"streak": ("long", 0)}, step, "user_id long, at long, kind string", late)
    return out.select("user_id", F.timestamp_micros("at").cast("timestamp_ntz").alias("ts"), "kind")


def ledgers(blocks: DataFrame, late: str = "1 day") -> DataFrame:
    """(case_id, idx, ts, data_hash, action, previous_hash, hash) of a stream blocks(case_id, ts, block_id, data_hash, action): each block goes to the end of its case's ledger.

    Of a case only the next index and the last hash are remembered besides the blocks that wait for the watermark.
    """
    own = blocks.select("case_id", "ts", "block_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("shown"), "data_hash", "action", F.col("case_id").cast("long").alias("own_case"))

    def step(mine: tuple, at: int, tie: int, rest: tuple) -> tuple:
        idx, before = mine
        shown, data, action, case = rest
        now = hashlib.sha256("|".join(str(x) for x in (idx, shown, data, before, action) if x is not None).encode()).hexdigest()
        return (idx + 1, now), [(case, idx, shown, data, action, before, now)], []

    columns = {"shown": "string", "data_hash": "string", "action": "string", "own_case": "long"}
    return in_time_order(own, "case_id", "ts", "block_id", columns, {"idx": ("long", 0), "last": ("string", FIRST_PREVIOUS)}, step, "case_id long, idx int, ts string, data_hash string, action string, previous_hash string, hash string", late)
