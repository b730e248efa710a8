"""Event behaviour: rate limits, debounced saves, windows; batch forms and their streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.runtime import folded


def timed(events: DataFrame) -> DataFrame:
    """ts as an instant (UTC): watermarks and window arithmetic need it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def sliding_count(events: DataFrame, seconds: int) -> DataFrame:
    """Each event with the number of events of its user in the last `seconds`, itself included."""
    own = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    return timed(events).withColumn("hits", F.count("*").over(own))


def admit(times: list[float], limit: int, seconds: float) -> list[bool]:
    """Which requests pass: fewer than `limit` admitted ones lie within the last `seconds`; refused ones don't count."""
    held: list[float] = []
    out = []
    for t in times:
        held = [h for h in held if t - h <= seconds]
        ok = len(held) < limit
        if ok:
            held.append(t)
        out.append(ok)
    return out


def _wait(first: int, now: int, seconds: float) -> int:
    """Whole seconds, at least 1, until the first admitted event is `seconds` old."""
    return max(1, int((first + seconds * 1e6 - now) // 1e6) + 1)


def rate_limited(events: DataFrame, limit: int, seconds: float) -> DataFrame:
    """(event_id, user_id, allowed, retry_after): what passes depends on what passed before, so each user's events are folded in time order.
    retry_after: whole seconds, at least 1, until a refused event would pass; NULL for one that passed."""

    def step(held: deque, r: tuple) -> list[tuple]:
        while held and r.us - held[0] > seconds * 1e6:
            held.popleft()
        ok = len(held) < limit
        if ok:
            held.append(r.us)
        return [(r.event_id, r.user_id, ok, None if ok else _wait(held[0], r.us, seconds) if held else None)]

    rows = timed(events).select("event_id", "user_id", F.unix_micros("ts").alias("us"))
    out = folded(rows, "user_id", ["us", "event_id"], deque, step, "event_id long, user_id long, allowed boolean, retry_after double")
    return out.withColumn("retry_after", F.col("retry_after").cast("long"))


def rate_limited_stream(events: DataFrame, limit: int, seconds: float) -> DataFrame:
    """The same as a stream: the state of a user is the times it was admitted at within the last `seconds`."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["us", "event_id"])
        out, wait = [], []
        for us in pdf.us:
            held = [h for h in held if us - h <= seconds * 1e6]
            out.append(len(held) < limit)
            wait.append(None if out[-1] else _wait(held[0], us, seconds) if held else None)
            if out[-1]:
                held.append(int(us))
        state.update((held,))
        yield pd.DataFrame({"event_id": pdf.event_id, "user_id": pdf.user_id, "allowed": out, "retry_after": pd.Series(wait, dtype="Int64", index=pdf.index)})

    rows = timed(events).select("event_id", "user_id", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, allowed boolean, retry_after long", "held array<long>", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(user_id, start, last, events): bursts of events with less than `gap` between them; works on batches and, with a watermark, on streams."""
    w = F.session_window("ts", gap)
    return timed(events).groupBy("user_id", w).agg(F.count("*").alias("events"), F.max("ts").alias("last")).select("user_id", F.col("session_window.start").alias("start"), "last", "events")


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by windows of equal width; `late` is the watermark of a stream."""
    e = timed(events)
    if late:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def autosaves(edits: DataFrame, debounce: float = 1.5, longest: float = 10.0) -> DataFrame:
    """(user_id, saved_us, edits): saves of a debounced editor. A save runs `debounce` seconds after the last edit; an edit that comes
    `longest` seconds or more after the first unsaved one saves at once. The wait is looked at on an edit only."""

    def step(s: dict, r: tuple) -> list[tuple]:
        out = []
        if s["n"] and r.us - s["last"] >= debounce * 1e6:
            out.append((r.user_id, s["last"] + int(debounce * 1e6), s["n"]))
            s["first"], s["n"] = None, 0
        s["first"] = r.us if s["first"] is None else s["first"]
        s["last"], s["n"] = r.us, s["n"] + 1
        if r.us - s["first"] >= longest * 1e6:
            out.append((r.user_id, r.us, s["n"]))
            s["first"], s["n"] = None, 0
        return out

    def finish(user: int, s: dict) -> list[tuple]:
        return [(user, s["last"] + int(debounce * 1e6), s["n"])] if s["n"] else []

    rows = timed(edits).select("user_id", F.unix_micros("ts").alias("us"))
    return folded(rows, "user_id", ["us"], lambda: {"first": None, "last": None, "n": 0}, step, "user_id long, saved_us long, edits long", finish)


def saving(attempts: DataFrame, first_wait: float = 1.0, longest_wait: float = 30.0) -> DataFrame:
    """(document_id, at_us, sent, wait): what becomes of each attempt to save, attempts(document_id, at_us, status: ok, conflict or error).

    After an error the next attempt waits first_wait seconds, twice as long after each further one, longest_wait at most; attempts that
    come earlier are not sent. A success ends the waiting, a conflict stops all saving of the document.
    """

    def step(s: dict, r: tuple) -> list[tuple]:
        sent = not s["stopped"] and r.at_us >= s["free"]
        if sent and r.status == "error":
            s["wait"] = min(longest_wait, s["wait"] * 2 if s["wait"] else first_wait)
            s["free"] = r.at_us + int(s["wait"] * 1e6)
        elif sent:
            s["wait"], s["free"], s["stopped"] = 0.0, 0, r.status == "conflict"
        return [(r.document_id, r.at_us, sent, s["wait"])]

    kind = dict(attempts.dtypes)["document_id"]
    return folded(attempts.select("document_id", "at_us", "status"), "document_id", ["at_us"], lambda: {"wait": 0.0, "free": 0, "stopped": False}, step, f"document_id {kind}, at_us long, sent boolean, wait double")
