"""State over ordered events: alerts, rate limits, notification collapse, approvals, retries.

F8 and F9 are anchored windows: whether an event counts depends on which earlier ones did, so a range window would be wrong.
They fold one key's events in order, over sorted rows here and as streams in `docketry.streaming`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.operators.fold import scanned

WINDOW_S, ALERT_AT, COLLAPSE_S, SIGNATURE_TTL_S = 600, 3, 300, 3600
#: Fixed values: (state, action) -> state.
TRANSITIONS = {("draft", "submit"): "in_review", ("in_review", "approve"): "approved", ("in_review", "reject"): "rejected", ("approved", "execute"): "executed", ("in_review", "edit"): "draft", ("approved", "edit"): "draft", ("rejected", "edit"): "draft", ("draft", "edit"): "draft"}


def blocked_in_window(blocked: DataFrame, window_s: int = WINDOW_S, alert_at: int = ALERT_AT) -> DataFrame:
    """Blocked queries of the user in the trailing window, and whether that raises an alert: (user_id, epoch)."""
    w = Window.partitionBy("user_id").orderBy("epoch").rangeBetween(-window_s, 0)
    n = F.count("*").over(w)
    return blocked.withColumn("recent", n).withColumn("alert", n >= alert_at)


def accept_times(times: list[float], limit: int, window_s: float, kept: list[float] | None = None) -> tuple[list[bool], list[float]]:
    """Sliding limit in which only accepted hits occupy the window."""
    kept, out = list(kept or []), []
    for t in times:
        kept = [x for x in kept if x > t - window_s]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out, kept


def rate_limited(hits: DataFrame, limit: int, window_s: float) -> DataFrame:
    """(domain, epoch, hit_id) with `accepted`, folded per domain in time order."""

    def step(kept: list[float] | None, row: tuple) -> tuple[list[float], list[tuple]]:
        (ok,), kept = accept_times([row[1]], limit, window_s, kept)
        return kept, [(*row, ok)]

    return scanned(hits.select("domain", "epoch", "hit_id"), "domain", ["epoch", "hit_id"], step, "domain string, epoch double, hit_id long, accepted boolean", ["domain", "epoch", "hit_id", "accepted"])


def anchor_starts(times: list[float], span: float, anchor: float | None = None) -> list[float]:
    """For each time the start of the row it joins: the open row's start if within `span` of it, else itself."""
    out = []
    for t in times:
        if anchor is None or t - anchor > span:
            anchor = t
        out.append(anchor)
    return out


def collapsed(notices: DataFrame, span: float = COLLAPSE_S) -> DataFrame:
    """(dedupe_key, started, count): notices within `span` of a row's creation are counted on it."""

    def step(open_row: tuple[float, int] | None, row: tuple) -> tuple[tuple[float, int], list[tuple]]:
        (start,) = anchor_starts([row[1]], span, open_row[0] if open_row else None)
        if open_row and start == open_row[0]:
            return (start, open_row[1] + 1), []
        return (start, 1), [(row[0], *open_row)] if open_row else []

    return scanned(notices.select("dedupe_key", "epoch"), "dedupe_key", ["epoch"], step, "dedupe_key string, started double, count long", ["dedupe_key", "started", "count"], lambda key, open_row: [(key, *open_row)])


def approve_step(now: tuple | None, actor: str, verb: str, epoch: float, key: str | None) -> tuple[tuple, str | None]:
    """(state, creator, signed at, keys seen) after one event of an action, and why the event was refused."""
    state, creator, signed, seen = now or ("draft", actor, None, ())
    refused = None
    if key is not None and key in seen:
        refused = "repeated"
    elif verb == "approve" and actor == creator:
        refused = "own_action"
    elif (state, verb) not in TRANSITIONS:
        refused = "not_allowed"
    elif verb == "execute" and signed is not None and epoch - signed > SIGNATURE_TTL_S:
        refused = "signature_expired"
    else:
        state = TRANSITIONS[state, verb]
        signed = epoch if verb == "approve" else signed
        seen = seen if key is None else (*seen, key)
    return (state, creator, signed, seen), refused


def approval_states(actions: DataFrame) -> DataFrame:
    """Folds the workflow's events: (action_id, step, actor, verb, epoch, idempotency_key) -> state after each, and why one was refused.

    Creators can't approve their own action, an approval lapses after its time to live, an edit resets, a repeated key does nothing.
    """

    def step(now: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        action_id, number, actor, verb, epoch, key = row
        now, refused = approve_step(now, actor, verb, epoch, key)
        return now, [(action_id, number, now[0], refused)]

    ordered = actions.select("action_id", "step", "actor", "verb", "epoch", "idempotency_key")
    return scanned(ordered, "action_id", ["step"], step, "action_id long, step long, state string, refused string", ["action_id", "step", "state", "refused"])


def backoff_seconds(attempt: Column, base: float = 30.0, cap: float = 3600.0) -> Column:
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))


def due_notices(outbox: DataFrame, now: float, max_attempts: int = 5, stale_s: float = 600) -> DataFrame:
    """Outbox rows to send now, by priority and age: pending and due, or claimed too long ago; exhausted rows are dead."""
    live = F.col("attempts") < max_attempts
    due = (F.col("status") == "pending") & (F.col("next_at") <= now)
    stale = (F.col("status") == "sending") & (F.col("claimed_at") < now - stale_s)
    return outbox.withColumn("verdict", F.when(~live, "dead").when(due, "send").when(stale, "reclaim").otherwise("wait")).orderBy(F.desc("priority"), "created_at")


def digest_rows(notices: DataFrame, flood_at: int = 20) -> DataFrame:
    """(user_id, hour, event_type, n, first_at, flooded): one digest row per user, hour and type; types of a user's hour beyond `flood_at` notices are marked."""
    hour = F.date_trunc("hour", F.timestamp_seconds("epoch"))
    return notices.groupBy("user_id", hour.alias("hour"), "event_type").agg(F.count("*").alias("n"), F.min("epoch").alias("first_at")).withColumn("flooded", F.col("n") > flood_at)


def delivery_outcome(code: Column, attempts: Column, max_attempts: int = 5) -> Column:
    """'sent', 'dead' (a permanent refusal, or no attempt left) or 'retry' of a delivery's HTTP code; null codes are lost connections."""
    permanent = code.between(400, 499) & ~code.isin(408, 425, 429)
    return F.when(code.between(200, 299), "sent").when(F.coalesce(permanent, F.lit(False)) | (attempts >= max_attempts), "dead").otherwise("retry")


def jittered(seconds: Column, key: Column, share: float = 0.2) -> Column:
    """A delay moved by up to `share` of itself either way, by a hash of the key, so that a run can be repeated."""
    return seconds * (1 + share * (F.pmod(F.xxhash64(key), F.lit(20_001)) / F.lit(10_000.0) - 1))
