import random
import re

from pyspark.sql import functions as F

from quire.operators import limits as L
from quire.operators import scale as SC


def arrivals(seed, n=600, keys=3, gap=4000):
    """One key, 0, holds most of the rows."""
    rnd = random.Random(seed)
    at, rows = 0, []
    for i in range(n):
        at += rnd.randint(0, gap) + (90_000 if rnd.random() < 0.02 else 0)
        rows.append((0 if rnd.random() < 0.8 else rnd.randint(1, keys - 1), at, i, rnd.choice([1, 1, 1, 5]), rnd.choice("pqr")))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "key int, at long, id long, cost int, who string")


def bucket_by_hand(rows, capacity, period):
    state, ok = {}, {}
    for key, at, i, cost, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        tokens, last = state.get(key, (period, at))
        tokens = min(period, tokens + at - last)
        ok[i] = tokens >= cost * period // capacity
        state[key] = (tokens - cost * period // capacity if ok[i] else tokens, at)
    return ok


def test_bucket_for_hot_keys_in_segments(spark):
    rows = arrivals(1)
    want = bucket_by_hand(rows, 20, 60_000)
    assert 0 < sum(want.values()) < len(rows)
    got = {r.id: r.ok for r in L.token_bucket(frame(spark, rows).drop("who"), "key").collect()}
    assert got == want


def test_anchored_window(spark):
    rows = arrivals(2)
    state, want = {}, {}
    for key, at, i, *_ in rows:
        start, n = state.get(key, (None, 0))
        start, n = (at, 1) if start is None or at - start > 30_000 else (start, n + 1)
        state[key], want[i] = (start, n), n <= 5
    got = {r.id: r.ok for r in L.anchored_window(frame(spark, rows).select("key", "at", "id"), "key", 5, 30_000).collect()}
    assert got == want and not all(want.values())


def test_daily_cap_with_mixed_costs(spark):
    rows = arrivals(3)
    used, want = {}, {}
    for key, at, i, cost, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        day = at // 300_000
        want[i] = used.get(day, 0) + cost <= 43
        used[day] = used.get(day, 0) + (cost if want[i] else 0)
    df = frame(spark, rows).select(F.expr("cast(at div 300000 as string)").alias("day"), "at", "id", "cost")
    assert {r.id: r.ok for r in L.daily_cap(df, 43).collect()} == want and len(set(want.values())) == 2


def test_check_admission_over_quiet_nights(spark):
    rows = [(k % 2, at * 40 + at // 400_000 * 30_000_000, i, cost * 60_000, who) for k, at, i, cost, who in arrivals(4)]
    whole = {r.id: (r.ok, r.why) for r in L.check_admission(frame(spark, rows), "key").collect()}
    assert {w for _, w in whole.values()} >= {"", "already running", "busy", "too many this hour"}
    running, buckets, days = {}, {}, {}
    for key, at, i, cost, who in sorted(rows, key=lambda r: (r[1], r[2])):
        now = [r for r in running.get(key, []) if r[1] > at]
        tokens, last = buckets.get((key, who), (3_600_000, at))
        if any(r[0] == who for r in now):
            want = "already running"
        elif len(now) >= 2:
            want = "busy"
        elif days.get((key, at // 86_400_000), 0) >= 60:
            want = "today's allowance used"
        else:
            tokens = min(3_600_000, tokens + at - last)
            want = "" if tokens >= 600_000 else "too many this hour"
            buckets[key, who] = (tokens - (0 if want else 600_000), at)
            if not want:
                days[key, at // 86_400_000] = days.get((key, at // 86_400_000), 0) + 1
                now.append((who, at + cost))
        running[key] = now
        assert whole[i] == (not want, want), i


def test_slices_give_the_rows_a_window_gives(spark):
    rows = arrivals(5)
    df = frame(spark, rows)
    def pairs(d, c):
        return {r.id: r[c] for r in d.collect()}

    for fn in (lambda w: SC.numbered(df, ["key"], F.col("at"), ["at", "id"], "n", w),
               lambda w: SC.running_total(df, ["key"], F.col("at"), ["at", "id"], F.col("cost"), "n", w),
               lambda w: SC.greatest_before(df, ["key"], F.col("at"), ["at", "id"], -F.col("at") % 977, "n", w),
               lambda w: SC.previous(df, ["key"], F.col("at"), ["at", "id"], "at", "n", w)):
        assert pairs(fn(40_000), "n") == pairs(fn(10**15), "n")


def test_a_stray_time_and_a_hot_key_change_nothing(spark):
    rows = [(0, 1_000 * i, i, 1, "p") for i in range(200)] + [(0, 10**15, 200, 1, "p"), (None, 5, 201, 1, "p"), (None, 6, 202, 20, "p")]
    want = bucket_by_hand([r for r in rows if r[0] is not None], 20, 60_000)
    got = {r.id: r.ok for r in L.token_bucket(frame(spark, rows).drop("who"), "key").collect()}
    assert got == want | {201: True, 202: False}


def test_plans_do_not_depend_on_size(spark):
    def shape(n):
        df = frame(spark, arrivals(5)[:n])
        plan = L.token_bucket(df.drop("who"), "key")._jdf.queryExecution().optimizedPlan().toString()
        return re.sub(r"#\d+L?|\d+", "", plan)

    assert shape(3) == shape(600)


def test_daily_cap_lets_free_events_pass(spark):
    df = spark.createDataFrame([("d", 1, 1, 0), ("d", 2, 2, 3), ("d", 3, 3, 3), ("d", 4, 4, 0)], "day string, at long, id long, cost int")
    assert {r.id: r.ok for r in L.daily_cap(df, 4).collect()} == {1: True, 2: True, 3: False, 4: True}


def test_frames_survive_any_cut(spark):
    rnd = random.Random(9)
    rows, want = [], {}
    for req in range(4):
        frames = [f"event: t\ndata: a{i}\ndata:  b{'c' * rnd.randint(0, 9)}" for i in range(30)] + ["data: [DONE]", ": comment"]
        text = "\n\n".join(frames) + "\n\n"
        at = 0
        while text:
            n = rnd.choice([1, 1, 2, 3, 7, 20])
            rows.append((req, at, text[:n]))
            text, at = text[n:], at + 1
        want[req] = [f.split("data:", 1)[1].strip().replace("\ndata:  ", "\n") for f in frames[:30]]
    got = {}
    for r in L.event_frames(spark.createDataFrame(rows, "req int, at long, body string"), "req").orderBy("frame_no").collect():
        got.setdefault(r.req, []).append(r.data)
    assert got == want


def test_shares(spark):
    df = spark.sql("""select * from values (1, null, null), (2, timestamp'2026-01-09', null), (3, timestamp'2026-01-01', null), (4, null, timestamp'2026-01-01') as t(id, expires, revoked)""")
    got = {r.id: r.status for r in L.share_status(df, F.lit("2026-01-08").cast("timestamp")).collect()}
    assert got == {1: "live", 2: "live", 3: "expired", 4: "revoked"}
