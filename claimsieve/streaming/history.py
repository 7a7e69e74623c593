"""Policy history of claims as they arrive, in any order.

A day of a policy is settled once the watermark has passed it: no claim of that day is taken any more. Until then its claims wait
in state, and a timer calls when the first waiting day is settled. Settled days are then
taken in order, so the columns are those that :func:`claimsieve.operators.policy.policy_history` gives for the whole batch.
State is kept for buckets of policies, since a call per policy costs far more than its few claims. Per policy it holds (day, row index) of
waiting claims, day counts of the last 30 settled days, and the last day.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.policy import FREQUENT_CLAIMS, FREQUENT_DAYS
from ..schema import ROW_INDEX

DAY_MS = 86_400_000
#: Buckets of policies. A stream that goes on from its checkpoint needs the number it began with.
BUCKETS = 4096
#: Last day of a policy without settled claims.
NEVER = -(1 << 31)
#: Policies with their last day; (policy, day, claims) of recent days; (policy, day, row index) of waiting claims. The latter name policies by place.
STATE = (
    "policies array<string>, last array<int>, count_policies array<int>, count_days array<int>, counts array<long>, "
    "waiting_policies array<int>, waiting_days array<int>, waiting_rows array<long>"
)


def _place(policy: np.ndarray, day: np.ndarray) -> np.ndarray:
    """One number per (policy, day), in order of both."""
    return (policy.astype("int64") << 32) + (day.astype("int64") - NEVER)


def settle(
    last: np.ndarray, counts: tuple[np.ndarray, np.ndarray, np.ndarray], settled: tuple[np.ndarray, np.ndarray, np.ndarray], forget_days: int | None = None
) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], pd.DataFrame]:
    """Take settled claims (policy, day, row index): the new last days and counts, and (place, row, day, since, recent) per claim.

    ``last`` has the last day of each policy, ``counts`` (policy, day, claims) of recent days; policies are places in ``last``.
    """
    order = np.lexsort(settled[::-1])
    policy, day, row = (part[order].astype("int64") for part in settled)
    opens = np.flatnonzero(np.r_[True, _place(policy, day)[1:] != _place(policy, day)[:-1]]) if len(row) else np.zeros(0, int)
    policies, days, sizes = policy[opens], day[opens], np.diff(np.r_[opens, len(row)])
    first = np.r_[True, policies[1:] != policies[:-1]][: len(policies)]
    last, before = last.astype("int64"), np.r_[NEVER, days[:-1]][: len(days)]
    known = tuple(part.astype("int64") for part in counts)
    if forget_days is not None:
        late = (last[policies[first]] != NEVER) & (days[first] - last[policies[first]] > forget_days)
        last[policies[first][late]] = NEVER
        known = tuple(part[last[known[0]] != NEVER] for part in known)
    before = np.where(first, last[policies], before)
    at, own = np.unique(np.r_[_place(*known[:2]), _place(policies, days)], return_inverse=True)
    claims = np.zeros(len(at), "int64")
    np.add.at(claims, own, np.r_[known[2], sizes])
    upto = np.r_[0, np.cumsum(claims)]
    recent = upto[np.searchsorted(at, _place(policies, days), "right")] - upto[np.searchsorted(at, _place(policies, days - FREQUENT_DAYS), "left")]
    since = np.zeros(len(row), "int64")
    since[opens] = np.where(before == NEVER, -1, days - before)
    np.maximum.at(last, policies, days)
    count_policies, count_days = at >> 32, (at & 0xFFFFFFFF) + NEVER
    keep = count_days > last[count_policies] - FREQUENT_DAYS
    out = pd.DataFrame({"place": policy, "row": row, "day": day, "since": since, "recent": np.repeat(recent, sizes)})
    return last, (count_policies[keep], count_days[keep], claims[keep]), out


def stream_policy_history(
    claims: DataFrame, policy: str = "policy_number", day: str = "incident_date", delay: str = "7 days", forget_days: int | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(policy, row_idx, day, days_since_last_claim, claims_last_30d, rule_high_frequency) of a stream of claims.

    A claim appears when the watermark, the newest day less ``delay``, has passed its day; one that arrives after that is left out. Claims
    without policy are one group, as in a batch; claims without day don't appear. With ``forget_days`` a policy without claims for
    so many days loses its state, and its next claim counts as the first. Policies are dealt to ``buckets`` by hash.
    """
    if forget_days is not None and forget_days <= FREQUENT_DAYS:
        raise ValueError(f"a policy must be remembered for more than {FREQUENT_DAYS} days")
    rows = claims.where(F.col(day).isNotNull()).select(
        F.col(policy).cast("string").alias("policy"), F.col(ROW_INDEX).cast("long").alias("row"), F.unix_date(F.col(day).cast("date")).alias("day"), F.col(day).cast("timestamp").alias("at")
    )
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("policy"), F.lit(buckets)).cast("int")).withWatermark("at", delay)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, last, *counts_and_waiting = state.get if state.exists else [[] for _ in range(8)]
        counts, waiting = counts_and_waiting[:3], [[part] for part in counts_and_waiting[3:]]
        places = {name: place for place, name in enumerate(names)}
        for batch in batches:
            given = batch["policy"].astype(object)
            given = given.where(given.notna(), None).tolist()
            for part, new in zip(waiting, ([places.setdefault(name, len(places)) for name in given], batch["day"], batch["row"])):
                part.append(new)
        names, waiting = list(places), [np.concatenate([np.asarray(new, "int64") for new in part]) for part in waiting]
        last = np.r_[np.asarray(last, "int64"), np.full(len(names) - len(last), NEVER)]
        watermark = state.getCurrentWatermarkMs()
        due = waiting[1] * DAY_MS < watermark
        last, counts, out = settle(last, tuple(np.asarray(part, "int64") for part in counts), tuple(part[due] for part in waiting), forget_days)
        waiting = [part[~due] for part in waiting]
        timers = waiting[1]
        if forget_days is not None:
            idle = np.ones(len(names), bool)
            idle[waiting[0]] = False
            old = idle & ((last + forget_days) * DAY_MS < watermark)
            timers = np.r_[timers, last[idle & ~old] + forget_days]
        kept_names, kept_last, kept_counts, kept_waiting = names, last, counts, waiting
        if forget_days is not None and old.any():
            place, stays = np.cumsum(~old) - 1, ~old[counts[0]]
            kept_names, kept_last = [name for name, gone in zip(names, old) if not gone], last[~old]
            kept_counts = (place[counts[0][stays]], counts[1][stays], counts[2][stays])
            kept_waiting = [place[waiting[0]], *waiting[1:]]
        if kept_names:
            state.update((kept_names, *(part.tolist() for part in (kept_last, *kept_counts, *kept_waiting))))
            if len(timers):
                state.setTimeoutTimestamp(max(int(timers.min()) * DAY_MS, watermark) + 1)
        elif state.exists:
            state.remove()
        if len(out):
            out.insert(0, "policy", np.array(names, object)[out.pop("place")])
            yield out

    found = rows.groupBy("bucket").applyInPandasWithState(
        advance, "policy string, row long, day int, since int, recent long", STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.select(
        F.col("policy").alias(policy), F.col("row").alias(ROW_INDEX), F.date_from_unix_date("day").alias(day), F.col("since").alias("days_since_last_claim"),
        F.col("recent").alias("claims_last_30d"), F.when(F.col("recent") > FREQUENT_CLAIMS, 1).otherwise(0).alias("rule_high_frequency"),
    )
