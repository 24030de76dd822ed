"""Monitors over event streams: windows, rates, drift, sessions, job states. Batch and streaming frames both work
where noted; stateful folds use Structured Streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TRANSITIONS = {"queued": {"running", "cancelled"}, "running": {"done", "failed", "cancelled"}, "done": set(), "failed": set(), "cancelled": set()}


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events and mean value per type and window; with `late`, a stream's watermark. Batch or stream."""
    e = events.withWatermark("ts", late) if late and events.isStreaming else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late and events.isStreaming else events
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def dedup_within(events: DataFrame, key: str, late: str) -> DataFrame:
    """Each key once within the watermark; on a batch frame once at all."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def rate_in_window(events: DataFrame, key: str, seconds: int = 60) -> DataFrame:
    """Events of the same key in the last seconds up to each event, itself and those of the same time counted.

    A key is worked on in spans of time, each with the events of the span before it, so that no task holds all events of a key.
    """
    width = seconds * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = events.withColumns({"__at": at, "__span": F.floor(at / (16 * width))})
    # an event also counts in the next span where it lies in the last seconds of its own
    both = F.when(F.pmod(F.col("__at"), F.lit(16 * width)) >= 15 * width, F.array("__span", F.col("__span") + 1)).otherwise(F.array("__span"))
    seen = spans.withColumn("__in", F.explode(both))
    w = Window.partitionBy(key, "__in").orderBy("__at").rangeBetween(-width, 0)
    return seen.withColumn("recent", F.count("*").over(w)).filter(F.col("__in") == F.col("__span")).drop("__at", "__span", "__in")


def drift(samples: DataFrame, key: str, *, long: int = 50, short: int = 10, least: int = 20, ratio: float = 0.15) -> DataFrame:
    """Rows where the mean of the last `short` values lies by `ratio` under that of the last `long`, after `least` samples."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    m = samples.withColumns({"n": F.row_number().over(w), "long": F.avg("value").over(w.rowsBetween(1 - long, 0)), "short": F.avg("value").over(w.rowsBetween(1 - short, 0))})
    return m.withColumn("drop", F.when(F.col("long") > 0, (F.col("long") - F.col("short")) / F.col("long"))).filter((F.col("n") >= least) & (F.col("drop") >= ratio))


def invalid_transitions(states: DataFrame, key: str = "job_id") -> DataFrame:
    """State changes that the machine forbids."""
    w = Window.partitionBy(key).orderBy("ts", "seq")
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, bs in TRANSITIONS.items() for b in sorted(bs)])
    changed = states.withColumn("before", F.lag("state").over(w)).filter("before IS NOT NULL AND before <> state")
    return changed.filter(~F.array_contains(pairs, F.concat_ws(">", "before", "state")))


def token_bucket(events: DataFrame, key: str, capacity: int, per_second: float) -> DataFrame:
    """Per event whether a token bucket of its key admits it; a stateful fold over a stream of (key, ts)."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (float(capacity), None)
        for pdf in batches:
            pdf = pdf.sort_values("ts")
            out = []
            for t in pdf["ts"]:
                s = t.timestamp()
                tokens = min(float(capacity), tokens + (0.0 if last is None else max(0.0, s - last) * per_second))
                last = s if last is None else max(last, s)
                ok = tokens >= 1
                tokens -= ok
                out.append(bool(ok))
            yield pd.DataFrame({key: [k[0]] * len(out), "ts": pdf["ts"].to_numpy(), "admitted": out})
        state.update((tokens, last))

    kinds = dict(events.dtypes)
    return events.groupBy(key).applyInPandasWithState(fold, f"{key} {kinds[key]}, ts {kinds['ts']}, admitted boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def success_window(samples: DataFrame, key: str, last: int = 30) -> DataFrame:
    """Success rate and 95th percentile over the last samples, and the step an additive-increase controller takes."""
    w = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(1 - last, 0)
    m = samples.withColumns({"rate": F.avg(F.col("ok").cast("double")).over(w), "p95": F.percentile("value", 0.95).over(w)})
    return m.withColumn("step", F.when(F.col("rate") < 0.8, "halve").when(F.col("rate") >= 0.95, "raise").otherwise("hold"))


def drift_alerts(samples: DataFrame, key: str, cooldown: str = "60 seconds", **limits) -> DataFrame:  # noqa: ANN003
    """The rows of drift() that are reported: after one, none of its key for the cooldown; a fold in order of time per key."""
    rows = drift(samples, key, **limits)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        keep, last, pause = [], None, pd.Timedelta(cooldown)
        for t in pdf["ts"]:
            keep.append(last is None or t - last >= pause)
            last = t if keep[-1] else last
        return pdf[keep]

    return rows.groupBy(key).applyInPandas(fold, rows.schema)


def controller_limits(samples: DataFrame, key: str, *, start: int = 4, low: int = 1, high: int = 16, window: int = 30, least: int = 10, step: int = 1, factor: float = 0.5, good: float = 0.95, slow: float = 60_000.0, cooldown: float = 10.0) -> DataFrame:
    """key, event_id, limit and reason of an additive-increase controller for every sample (ts, event_id, ok, value as latency).

    After `least` samples of the last `window` the limit rises by step where the share of successes is `good`, and falls by
    factor where it is not or where the 95th percentile of the latency is over `slow`; a change clears the window and rests for `cooldown` seconds.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        limit, seen, last, limits, reasons = start, [], None, [], []
        for t, ok, value in zip(pdf["ts"], pdf["ok"], pdf["value"], strict=True):
            seen = [*seen, (bool(ok), float(value))][-window:]
            reason = None
            if len(seen) >= least and (last is None or (t - last).total_seconds() >= cooldown):
                rate = sum(o for o, _ in seen) / len(seen)
                late = sorted(v for _, v in seen)[min(len(seen) - 1, int(0.95 * len(seen)))]
                if rate < good:
                    reason, new = "failures", max(low, int(limit * factor))
                elif late > slow:
                    reason, new = "latency", max(low, int(limit * factor))
                else:
                    reason, new = "increase", min(high, limit + step)
                if new == limit:
                    reason = None
                else:
                    limit, last, seen = new, t, []
            limits.append(limit)
            reasons.append(reason)
        return pd.DataFrame({key: pdf[key].to_numpy(), "event_id": pdf["event_id"].to_numpy(), "limit": limits, "reason": reasons})

    kinds = dict(samples.dtypes)
    return samples.groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, event_id {kinds['event_id']}, limit int, reason string")


def breaker_states(samples: DataFrame, key: str, *, window: int = 20, least: int = 5, rate: float = 0.5, rest: float = 30.0, probes: int = 1) -> DataFrame:
    """key, event_id and state of a circuit breaker before every sample (ts, event_id, ok): closed, open or half_open.

    It opens when, of the last `window` samples, at least `least` were seen and `rate` of them failed; after `rest` seconds the next
    sample is a probe: success of `probes` of them closes it, a failure opens it again.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        state, since, seen, passed, states = "closed", None, [], 0, []
        for t, ok in zip(pdf["ts"], pdf["ok"], strict=True):
            if state == "open" and (t - since).total_seconds() >= rest:
                state, passed = "half_open", 0
            states.append(state)
            if state == "half_open":
                passed = passed + 1 if ok else 0
                state, since, seen = ("closed", None, []) if passed >= probes else ("half_open", since, []) if ok else ("open", t, [])
            elif state == "closed":
                seen = [*seen, bool(ok)][-window:]
                if len(seen) >= least and 1 - sum(seen) / len(seen) >= rate:
                    state, since = "open", t
        return pd.DataFrame({key: pdf[key].to_numpy(), "event_id": pdf["event_id"].to_numpy(), "state": states})

    kinds = dict(samples.dtypes)
    return samples.groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, event_id {kinds['event_id']}, state string")


def not_yet_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of work whose key is not among the done ones: how a run resumes."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def first_good_tier(tries: DataFrame, key: str, good: float = 0.6) -> DataFrame:
    """key, tier and quality of the first tier whose quality is `good`, else of the best one, the first of equals. tries: key, tier (a number), quality."""
    t = tries.groupBy(key).agg(F.min(F.when(F.col("quality") >= good, F.struct("tier", "quality"))).alias("first"), F.min(F.struct((-F.col("quality")).alias("q"), "tier")).alias("best"))
    return t.select(key, F.coalesce("first.tier", "best.tier").alias("tier"), F.coalesce("first.quality", -F.col("best.q")).alias("quality"))
