"""Rate limits, sessions, frames and logs over keys of any size."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from quire.functions import text as T
from quire.operators.ranking import top_k
from quire.operators.scale import HOUR, POSITIONS, greatest_before, numbered, previous, running_total


def fold_in_order(rows: DataFrame, keys: list[str], step: Callable, fresh: Callable) -> DataFrame:
    """Run a stateful rule over each key's rows (keys, at, id, who, cost) in order of (at, id): adds ok and why.

    A task reads its keys' rows one after the other from a sorted shuffle and holds the
    state of one key and a batch of rows, however many rows the key has.
    """
    schema = StructType([rows.schema[k] for k in keys] + [StructField("id", LongType()), StructField("ok", BooleanType()), StructField("why", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in frames:
            said = []
            named = pdf[[*keys, "at", "who", "cost"]].astype(object)
            for *now, at, who, cost in named.where(named.notna(), None).itertuples(index=False, name=None):
                if now != key:
                    key, state = now, fresh()
                said.append(step(state, at, who, cost))
            out = pdf[[*keys, "id"]].copy()
            out["ok"], out["why"] = [not w for w in said], said
            yield out

    ordered = rows.select(*keys, "at", "id", "who", "cost").repartition(*keys).sortWithinPartitions(*keys, "at", "id")
    return ordered.mapInPandas(run, schema)


def runs(rows: DataFrame, keys: list[str], fresh: Column) -> DataFrame:
    """Adds `run`: rows from one that is `fresh` (nothing before it counts) up to the next."""
    return running_total(rows, keys, F.col("at"), ["at", "id"], F.when(fresh, 1).otherwise(0), "run")


def cut_at_pauses(rows: DataFrame, keys: list[str], idle: int) -> DataFrame:
    """Runs that begin after a pause of `idle` ms, after which the past no longer counts."""
    rows = previous(rows, keys, F.col("at"), ["at", "id"], "at", "_before", cheap=True)
    return runs(rows, keys, F.col("_before").isNull() | (F.col("at") - F.col("_before") >= idle)).drop("_before")


class _State:
    """How a rule's state is started."""

    def __init__(self, initial: list):
        self.initial = initial

    def __call__(self) -> list:
        return copy.deepcopy(self.initial)


def bucket_rule(capacity: int, period: int) -> tuple[Callable, _State]:
    """A bucket of `capacity` uses refilled evenly over `period` ms, counted in ms so that sums are exact.

    A refusal keeps the refill and takes nothing.
    """
    unit, full = period // capacity, period

    def step(state, at, who, cost):
        tokens, last = state
        tokens = full if last is None else min(full, tokens + at - last)
        state[1] = at
        if tokens < cost * unit:
            state[0] = tokens
            return "short"
        state[0] = tokens - cost * unit
        return ""

    return step, _State([full, None])


def token_bucket(events: DataFrame, key: str, capacity: int = 20, period: int = 60_000) -> DataFrame:
    """(key, id, ok) for events (key, at ms, id, cost). A pause of a whole period fills the bucket, whatever came before."""
    rows = cut_at_pauses(events.withColumn("who", F.lit("")), [key], period)
    return fold_in_order(rows, [key, "run"], *bucket_rule(capacity, period)).select(key, "id", "ok")


def window_rule(limit: int, period: int) -> tuple[Callable, _State]:
    """A window that starts at the first attempt, and again at the first one more than a period later."""
    def step(state, at, who, cost):
        if state[0] is None or at - state[0] > period:
            state[0], state[1] = at, 1
            return ""
        state[1] += 1
        return "" if state[1] <= limit else "over"

    return step, _State([None, 0])


def anchored_window(events: DataFrame, key: str, limit: int = 5, period: int = 900_000) -> DataFrame:
    rows = cut_at_pauses(events.withColumn("who", F.lit("")).withColumn("cost", F.lit(1)), [key], period + 1)
    return fold_in_order(rows, [key, "run"], *window_rule(limit, period)).select(key, "id", "ok")


def daily_cap(events: DataFrame, cap: int) -> DataFrame:
    """(day, id, ok): costs taken in order of (at, id) until the day's cap would be passed; refusals cost nothing.

    Of one cost only the first cap / cost events of a day can be taken, for once
    one is refused all later ones of that cost are. So a day of any size leaves
    that many candidates per cost, and the rest is refused unseen. An event that costs
    nothing always passes.
    """
    near = top_k(events.where("cost > 0"), ["day", "cost"], [F.asc("at"), F.asc("id")], cap, "_n").where(F.col("_n") <= F.floor(F.lit(cap) / F.col("cost")))
    days = near.groupBy("day").agg(F.sort_array(F.collect_list(F.struct("at", "id", "cost"))).alias("l"))
    start = F.struct(F.expr("cast(array() as array<bigint>)").alias("ids"), F.lit(0).cast("long").alias("used"))
    step = lambda a, x: F.when(a.used + x.cost <= cap, F.struct(
        F.array_append(a.ids, x.id).alias("ids"), (a.used + x.cost).alias("used"))).otherwise(a)
    taken = days.select("day", F.explode(F.reduce("l", start, step, lambda a: a.ids)).alias("id"), F.lit(True).alias("ok"))
    return events.join(taken, ["day", "id"], "left").select("day", "id", F.coalesce("ok", F.col("cost") <= 0).alias("ok"))


def admission_rule(overall: int, per_hour: int, per_day: int) -> tuple[Callable, _State]:
    """One running check per user, some overall, some a day, and an hourly bucket per user.

    State: running [(user, end)], buckets {user: [tokens, at]}, the day and its count. A
    bucket that has filled again is dropped at the first check of a day.
    """
    hour, day_ms = 3_600_000, 86_400_000
    unit = hour // per_hour

    def step(state, at, who, cost):
        running, buckets, day, used = state
        running[:] = [r for r in running if r[1] > at]
        if any(r[0] == who for r in running):
            return "already running"
        if len(running) >= overall:
            return "busy"
        if at // day_ms != day:
            state[2], state[3] = day, used = at // day_ms, 0
            for name in [n for n, (tokens, last) in buckets.items() if tokens + at - last >= hour]:
                del buckets[name]
        if used >= per_day:
            return "today's allowance used"
        tokens, last = buckets.get(who, (hour, at))
        tokens = min(hour, tokens + at - last)
        if tokens < unit:
            buckets[who] = [tokens, at]
            return "too many this hour"
        buckets[who] = [tokens - unit, at]
        state[3] += 1
        running.append([who, at + cost])
        return ""

    return step, _State([[], {}, None, 0])


def check_admission(events: DataFrame, service: str, overall: int = 2, per_hour: int = 6, per_day: int = 60) -> DataFrame:
    """(service, id, ok, why) for checks (service, at ms, id, who, cost = duration in ms), one service's checks in order.

    A service's checks are cut where nothing before can count: an hour after the last
    check all buckets are full, its day is over, and every check asked for has ended.
    """
    rows = previous(events, [service], F.col("at"), ["at", "id"], "at", "_before", cheap=True)
    rows = greatest_before(rows, [service], F.col("at"), ["at", "id"], F.col("at") + F.col("cost"), "_end")
    at, before = F.col("at"), F.col("_before")
    fresh = before.isNull() | ((at - before >= HOUR) & (F.floor(at / (24 * HOUR)) != F.floor(before / (24 * HOUR))) & (F.col("_end") <= at))
    rows = runs(rows, [service], fresh)
    return fold_in_order(rows, [service, "run"], *admission_rule(overall, per_hour, per_day)).select(service, "id", "ok", "why")


def recent_calls(log: DataFrame, order: list[Column], n: int = 200) -> DataFrame:
    """The latest calls: each task keeps n, so nothing is sorted whole."""
    return log.orderBy(*order).limit(n)


def usage_rollup(log: DataFrame, bucket: Column) -> DataFrame:
    """Calls, failures, latency and tokens per period, feature, connection and model. Latencies are whole ms.

    The percentile is exact and needs no list of latencies: calls are counted per latency, and
    counts running up and down a group's latencies tell where its 95 % fall.
    """
    keys = ["period", "feature", "connection", "model"]
    counts = log.withColumn("period", bucket).groupBy(*keys, "ms").agg(
        F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.sum(F.coalesce("tokensIn", F.lit(0))).alias("tokens"))
    timed = F.when(F.col("ms").isNotNull(), F.col("calls")).otherwise(0)
    w = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("_up", F.sum(timed).over(w.orderBy(F.asc("ms")))).withColumn("_all", F.col("_up") + F.sum(timed).over(w.orderBy(F.desc("ms"))) - timed)
    place = (F.col("_all") - 1) * F.lit(0.95)
    reached = lambda at: F.min(F.when(F.col("_up") > at, F.col("ms")))
    rows = counts.groupBy(*keys).agg(
        F.sum("calls").alias("calls"), F.sum("failures").alias("failures"), F.sum(F.col("ms") * F.col("calls")).alias("total_ms"), F.max("ms").alias("slowest"),
        reached(F.floor(place)).alias("_low"), reached(F.ceil(place)).alias("_high"), F.max(place - F.floor(place)).alias("_part"), F.sum("tokens").alias("tokens"))
    return rows.select(*keys, "calls", "failures", "total_ms", "slowest", F.round(F.col("_low") * (1 - F.col("_part")) + F.col("_high") * F.col("_part"), 4).alias("p95"), "tokens")


def share_usage(stored: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    """Stored use counts and last uses with new uses (key, at) added."""
    fresh = uses.groupBy(key).agg(F.count("*").alias("n"), F.max("at").alias("last"))
    joined = stored.join(fresh, key, "left")
    return joined.select(key, (F.col("use_count") + F.coalesce("n", F.lit(0))).alias("use_count"), F.greatest("last", "last_used").alias("last_used"))


def share_status(shares: DataFrame, now: Column) -> DataFrame:
    """Revoked, live or expired as of a time."""
    live = F.col("expires").isNull() | (F.col("expires") > now)
    return shares.withColumn("status", F.when(F.col("revoked").isNotNull(), "revoked").when(live, "live").otherwise("expired"))


def find_tokens(tokens: DataFrame, shares: DataFrame) -> DataFrame:
    """Presented tokens of the right form matched to live shares by hash."""
    good = tokens.where(F.col("token").rlike("^[A-Za-z0-9_-]{40,64}$")).withColumn("token_hash", T.sha256(F.col("token")))
    return good.join(shares.where("status = 'live'"), "token_hash")


def sessions(events: DataFrame, key: str, gap: int) -> DataFrame:
    """Visits: uses (key, at ms, id) less than `gap` ms apart belong together."""
    width = max(1, 30 * gap)  # a slice holds some 30 visits at most
    rows = previous(events, [key], F.col("at"), ["at", "id"], "at", "_before", width, cheap=True)
    fresh = F.when(F.col("_before").isNull() | (F.col("at") - F.col("_before") >= gap), 1).otherwise(0)
    rows = running_total(rows, [key], F.col("at"), ["at", "id"], fresh, "visit", width)
    return rows.groupBy(key, "visit").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("uses"))


def event_frames(chunks: DataFrame, request: str) -> DataFrame:
    """(request, frame_no, data): frames end at a blank line, wherever the network cut the text.

    A request's chunks (request, at, body) are never joined whole: each is cut at its
    own blank lines, the cuts are counted along the request, and only the pieces
    of one frame are put together.
    """
    order = ["at"]
    # A carriage return goes with the line end it stands before, even if a cut fell between the two.
    chunks = chunks.withColumn("_cr", F.endswith("body", F.lit("\r")))
    chunks = previous(chunks, [request], F.col("at"), order, "_cr", "_pcr", POSITIONS, cheap=True)
    whole = F.concat(F.when(F.coalesce("_pcr", F.lit(False)), "\r").otherwise(""), F.when(F.col("_cr"), F.expr("left(body, length(body) - 1)")).otherwise(F.col("body")))
    chunks = chunks.withColumn("body", F.replace(whole, F.lit("\r\n"), F.lit("\n"))).drop("_cr", "_pcr")
    # A chunk of line ends alone says nothing without what stands before it.
    solid = running_total(chunks, [request], F.col("at"), order, F.when(F.col("body").rlike(r"[^\n]"), 1).otherwise(0), "_g", POSITIONS)
    merged = solid.groupBy(request, "_g").agg(F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("at", "body"))).alias("l"))
    merged = merged.select(request, "at", F.array_join("l.body", "").alias("body"))
    tail = F.length(F.regexp_extract("body", r"\n*$", 0)) % 2
    merged = merged.withColumn("odd", tail)
    joined = previous(merged, [request], F.col("at"), order, "odd", "_odd", POSITIONS)
    kept = F.when(F.col("odd") == 1, F.expr("left(body, length(body) - 1)")).otherwise(F.col("body"))
    body = F.concat(F.when(F.coalesce("_odd", F.lit(0)) == 1, "\n").otherwise(""), kept)
    pieces = joined.select(request, "at", F.split(body, "\n\n").alias("p"))
    counted = running_total(pieces, [request], F.col("at"), order, F.size("p") - 1, "_n", POSITIONS)
    rows = counted.select(request, "at", (F.col("_n") - F.size("p") + 1).alias("_before"), F.posexplode("p").alias("i", "piece"))
    frames = rows.groupBy(request, (F.col("_before") + F.col("i")).alias("frame_no")).agg(F.sort_array(F.collect_list(F.struct("at", "i", "piece"))).alias("l"))
    lines = F.filter(F.split(F.array_join("l.piece", ""), "\n"), lambda x: x.startswith("data:"))
    data = F.array_join(F.transform(lines, lambda x: F.ltrim(F.substring(x, 6, F.length(x)))), "\n")
    return frames.select(request, "frame_no", data.alias("data")).where("data <> '' and data <> '[DONE]'")


def stream_answers(tokens: DataFrame, request: str, part_size: int = 1000) -> DataFrame:
    """(request, part, text, tokens, finished): an answer's tokens (request, at, kind, token) in order.

    A long answer comes as numbered parts, so no request is ever one row; `finished`
    says whether the request's end was seen.
    """
    done = tokens.groupBy(request).agg(F.bool_or(F.col("kind") == "done").alias("finished"))
    words = numbered(tokens.where("kind = 'token'"), [request], F.col("at"), ["at"], "_n")
    parts = words.groupBy(request, F.floor((F.col("_n") - 1) / part_size).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("at", "token"))).alias("l"), F.count("*").alias("tokens"))
    return parts.join(done, request).select(request, "part", F.array_join("l.token", "").alias("text"), "tokens", "finished")


def check_progress(steps: DataFrame, run: str) -> DataFrame:
    """The latest step of each run, its total, and whether it is done."""
    last = steps.groupBy(run).agg(F.max_by(F.struct("step", "total", "message"), "step").alias("s"))
    return last.select(run, "s.*", (F.col("s.step") >= F.col("s.total")).alias("done"))


def mask_secret(secret: Column) -> Column:
    return F.when(F.coalesce(secret, F.lit("")) == "", "").otherwise(F.concat(F.lit("set, ending …"), F.right(secret, F.lit(4))))


def connection_problems(base_url: Column, model: Column, secret: Column) -> Column:
    missing = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.array_compact(F.array(F.when(missing(base_url), "it has no address"), F.when(missing(model), "it has no model name"), F.when(missing(secret), "it has no key")))
