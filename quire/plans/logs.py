"""Logs, limits and streams: events stand in for calls, uses, attempts and checks."""

from __future__ import annotations


from pyspark.sql import functions as F

from quire.operators import limits as L
from quire.plans import structuring as P
from quire.sources import files
from quire.sources.tables import table
from quire.streaming import usage as U


def _events(spark, sf):
    """Arrivals a thousand times as fast as logged, so that limits bite: (key, user_id, at ms, id, cost)."""
    e = table(spark, sf, "events")
    return e.select((F.col("user_id") % 10).alias("key"), "user_id", F.floor(F.unix_micros("ts") / 1000000).cast("long").alias("at"), F.col("event_id").alias("id"),
                    F.when(F.col("event_type") == "purchase", 5).otherwise(1).alias("cost"))


def token_bucket(spark, sf):
    return L.token_bucket(_events(spark, sf).select("key", "at", "id", "cost"), "key")


def anchored_window(spark, sf):
    return L.anchored_window(_events(spark, sf).select("user_id", "at", "id"), "user_id")


def _daily(spark, sf):
    return table(spark, sf, "events").select(F.to_date("ts").cast("string").alias("day"), F.unix_micros("ts").alias("at"), F.col("event_id").alias("id"),
                                             F.when(F.col("event_type") == "purchase", 5).otherwise(1).alias("cost"))


def daily_cap(spark, sf):
    return L.daily_cap(_daily(spark, sf), 400)


def check_admission(spark, sf):
    """Each check lasts its value in minutes; three services are kept apart."""
    e = table(spark, sf, "events").select((F.col("user_id") % 3).alias("service"), F.floor(F.unix_micros("ts") / 1000).cast("long").alias("at"), F.col("event_id").alias("id"),
                                          F.col("user_id").cast("string").alias("who"), F.floor(F.col("value") * 60000).cast("long").alias("cost"))
    return L.check_admission(e, "service")


def recent_calls(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id", F.unix_micros("ts").alias("at"))
    return L.recent_calls(e, [F.desc("at"), F.desc("event_id")])


def _log(spark, sf):
    return P._usage(spark, sf).withColumn("ms", F.floor(F.col("ms") * 10).cast("long"))


def usage_rollup(spark, sf):
    return L.usage_rollup(_log(spark, sf), F.to_date("at").cast("string"))


def usage_rollup_stream(spark, sf):
    """The day's usage from a stream of the JSON log; the last day closes with a row a day later."""
    path = files.scratch(spark, "usage-stream")
    log = _log(spark, sf)
    files.append_usage(log, path)
    last = log.agg(F.max("at").alias("at")).select((F.col("at") + F.expr("interval 3 days")).alias("at"))
    files.append_usage(last.select("at", F.lit("end").alias("feature"), F.lit(True).alias("ok"), F.lit(0).alias("ms")), path)
    got = U.run_to_table(U.usage_by_day(files.stream_usage(spark, path)), path + "-out", path + "-state")
    return got.select(F.to_date("w.start").cast("string").alias("period"), "feature", "connection", "model", "calls", "failures", F.col("total_ms").cast("long").alias("total_ms"),
                      F.col("slowest").cast("long").alias("slowest"), "tokens").where("feature <> 'end'")


def share_usage(spark, sf):
    stored = table(spark, sf, "customer").select(F.col("c_custkey").alias("share"), F.col("c_nationkey").cast("long").alias("use_count"), F.lit(0).cast("long").alias("last_used"))
    uses = table(spark, sf, "events").select(F.col("user_id").alias("share"), F.unix_micros("ts").alias("at"))
    return L.share_usage(stored, uses, "share")


def share_usage_stream(spark, sf):
    """The same counts merged batch by batch from a stream of uses."""
    path = files.scratch(spark, "shares")
    table(spark, sf, "customer").select(F.col("c_custkey").alias("share"), F.col("c_nationkey").cast("long").alias("use_count"), F.lit(0).cast("long").alias("last_used")).write.parquet(f"{path}/v=0")
    table(spark, sf, "events").select(F.col("user_id").alias("share"), F.unix_micros("ts").alias("at")).repartition(3, "at").write.parquet(path + "-uses")
    uses = spark.readStream.schema("share long, at long").option("maxFilesPerTrigger", 2).parquet(path + "-uses")
    U.merge_share_uses(uses, "share", path, path + "-state")
    newest = spark.read.parquet(path).agg(F.max("v").alias("v")).select("v").scalar()
    return spark.read.parquet(path).where(F.col("v") == newest).drop("v")


def share_status(spark, sf):
    k = F.col("o_orderkey")
    shares = table(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 7 != 0, F.col("o_orderdate") + F.make_dt_interval((k % 400).cast("int"))).alias("expires"), F.when((k % 11 == 0) & (F.col("o_orderstatus") == "P"), F.col("o_orderdate")).alias("revoked"))
    s = L.share_status(shares, F.lit("1998-01-01").cast("timestamp")).select("o_orderkey", "status")
    live = s.where("status = 'live'").agg(F.count("*").alias("n")).select("n").scalar()
    return s.withColumn("may_create", live < 100)


def token_hash_lookup(spark, sf):
    """Customers' tokens are known by hash; orders present them, some of the wrong form."""
    shares = table(spark, sf, "customer").select("c_custkey", F.sha2(F.sha2("c_name", 256), 256).alias("token_hash"), F.when(F.col("c_acctbal") > 0, "live").otherwise("expired").alias("status"))
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    tokens = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, name).otherwise(F.sha2(name, 256)).alias("token"))
    return L.find_tokens(tokens, shares).select("o_orderkey", "c_custkey")


def sessions(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.unix_micros("ts").alias("at"), F.col("event_id").alias("id"))
    return L.sessions(e, "user_id", 12 * 3600 * 1000000)


def sessions_stream(spark, sf):
    path = files.scratch(spark, "visits")
    e = table(spark, sf, "events").select("user_id", F.col("ts").alias("at"))
    e.write.parquet(path)
    e.agg(F.max("at").alias("m")).select(F.lit(-1).cast("long").alias("user_id"), (F.col("m") + F.expr("interval 3 days")).alias("at")).write.mode("append").parquet(path)
    stream = spark.readStream.schema("user_id long, at timestamp").parquet(path)
    got = U.run_to_table(U.visits(stream, "user_id"), path + "-out", path + "-state")
    return got.where("user_id >= 0").select("user_id", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "uses")


def token_bucket_stream(spark, sf):
    """The bucket over four micro-batches of four files, with events up to five minutes late; a last row far off lets the rest go."""
    path = files.scratch(spark, "bucket")
    e = _events(spark, sf).select("key", "at", "id", "cost")
    first, last = e.agg(F.min("at"), F.max("at")).first()
    comes = F.col("at") + F.pmod(F.xxhash64("id"), F.lit(300_000)) - F.lit(first)
    for part in range(4):
        e.where(F.floor(comes * 4 / F.lit(last - first + 300_001)) == part).repartition(4).write.mode("append").parquet(path)
    e.agg(F.lit(-1).cast("long").alias("key"), (F.max("at") + 10**9).alias("at"), F.lit(-1).cast("long").alias("id"), F.lit(1).alias("cost")).write.mode("append").parquet(path)
    stream = spark.readStream.schema("key long, at long, id long, cost int").option("maxFilesPerTrigger", 4).parquet(path)
    return U.run_to_table(U.limited(stream, "key", late="10 minutes"), path + "-out", path + "-state").where("key >= 0")


def _chunks(spark, sf):
    """Every turn a frame of two data lines, cut in three where it hurts: inside it and between its two line ends."""
    q = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit("'"))
    frame = F.concat(F.lit("event: token\ndata: "), q, F.lit("\ndata:"), "turn", F.lit("\n"))
    t = table(spark, sf, "conversations").select("conv_id", "turn", frame.alias("f"))
    cut = F.floor(F.length("f") / 2).cast("int")
    parts = F.array(F.left("f", cut), F.expr("substring(f, cast(floor(length(f) / 2) as int) + 1)"), F.lit("\n"))
    return t.select("conv_id", F.posexplode(parts).alias("i", "body"), "turn").select("conv_id", (F.col("turn") * 3 + F.col("i")).alias("at"), "body")


def event_frames(spark, sf):
    return L.event_frames(_chunks(spark, sf), "conv_id")


def stream_answers(spark, sf):
    """Turns are tokens; a conversation in which the system spoke was cut off, any other has its end."""
    c = table(spark, sf, "conversations")
    t = c.select("conv_id", F.col("turn").alias("at"), F.lit("token").alias("kind"), F.col("text").alias("token"))
    ends = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("at"), F.bool_or(F.col("role") == "system").alias("cut")).where("not cut").select(
        "conv_id", "at", F.lit("done").alias("kind"), F.lit("").alias("token"))
    return L.stream_answers(t.unionByName(ends), "conv_id", 2)


def check_progress(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("step"), (9800 + F.col("user_id")).alias("total"), F.col("event_type").alias("message"))
    return L.check_progress(e, "user_id")


def mask_secrets(spark, sf):
    c = table(spark, sf, "customer")
    secret = F.when(F.col("c_acctbal") > 0, F.col("c_name"))
    url, model = F.when(F.col("c_nationkey") > 3, "https://m"), F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment"))
    return c.select("c_custkey", L.mask_secret(secret).alias("hint"), F.array_join(L.connection_problems(url, model, secret), "; ").alias("problems"))


QUERIES = {f.__name__: f for f in (
    token_bucket, token_bucket_stream, anchored_window, daily_cap, check_admission, recent_calls, usage_rollup, usage_rollup_stream, share_usage, share_usage_stream,
    share_status, token_hash_lookup, sessions, sessions_stream, event_frames, stream_answers, check_progress, mask_secrets)}

_ARRIVALS = """ev AS (SELECT user_id % 10 AS key, user_id, epoch_us(ts) // 1000000 AS at_, event_id AS id, CASE WHEN event_type = 'purchase' THEN 5 ELSE 1 END AS cost FROM events)"""
_BUCKET = f"""WITH RECURSIVE {_ARRIVALS}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_, id) AS n FROM ev),
  s AS (SELECT key, n, id, at_, true AS ok, 60000 - cost * 3000 AS tokens FROM o WHERE n = 1 UNION ALL
    SELECT o.key, o.n, o.id, o.at_, least(60000, tokens + o.at_ - s.at_) >= cost * 3000, least(60000, tokens + o.at_ - s.at_) - CASE WHEN least(60000, tokens + o.at_ - s.at_) >= cost * 3000 THEN cost * 3000 ELSE 0 END
    FROM s JOIN o ON o.key = s.key AND o.n = s.n + 1) SELECT key, id, ok FROM s"""
_ROLL = """SELECT ts::DATE::VARCHAR AS period, event_type AS feature, 'c' || (user_id % 3) AS connection, 'm' || (user_id % 2) AS model, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS failures,
  sum(floor(value * 10)::BIGINT)::BIGINT AS total_ms, max(floor(value * 10)::BIGINT) AS slowest{p95}, coalesce(sum(CASE WHEN event_type <> 'error' THEN json_extract(props, '$.k')::BIGINT END), 0)::BIGINT AS tokens FROM events GROUP BY ALL"""
_SHARES = """SELECT c_custkey AS share, any_value(c_nationkey)::BIGINT + count(user_id) AS use_count, coalesce(max(epoch_us(ts)), 0) AS last_used FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY ALL"""
_VISITS = """WITH g AS (SELECT user_id, epoch_us(ts) AS a, event_id, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 43200000000)::INT, 1) AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  v AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY a, event_id)::BIGINT AS visit FROM g)"""

ORACLES = {
    "token_bucket": _BUCKET,
    "token_bucket_stream": _BUCKET,
    "anchored_window": f"""WITH RECURSIVE {_ARRIVALS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_, id) AS n FROM ev),
      s AS (SELECT user_id, n, id, at_ AS start, 1 AS c FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.n, o.id, CASE WHEN o.at_ - start > 900000 THEN o.at_ ELSE start END, CASE WHEN o.at_ - start > 900000 THEN 1 ELSE c + 1 END
        FROM s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1) SELECT user_id, id, c <= 5 AS ok FROM s""",
    "daily_cap": """WITH RECURSIVE o AS (SELECT ts::DATE::VARCHAR AS day, event_id AS id, CASE WHEN event_type = 'purchase' THEN 5 ELSE 1 END AS cost, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS n FROM events),
      s AS (SELECT day, n, id, cost AS used, true AS ok FROM o WHERE n = 1 UNION ALL SELECT o.day, o.n, o.id, CASE WHEN used + cost <= 400 THEN used + cost ELSE used END, used + cost <= 400 FROM s JOIN o ON o.day = s.day AND o.n = s.n + 1)
      SELECT day, id, ok FROM s""",
    "recent_calls": "SELECT event_id, event_type, user_id, epoch_us(ts) AS \"at\" FROM events ORDER BY ts DESC, event_id DESC LIMIT 200",
    "usage_rollup": _ROLL.replace("{p95}", ", round(quantile_cont(floor(value * 10)::DOUBLE, 0.95), 4) AS p95"),
    "usage_rollup_stream": _ROLL.replace("{p95}", ""),
    "share_usage": _SHARES,
    "share_usage_stream": _SHARES,
    "share_status": """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 AND o_orderstatus = 'P' THEN 'revoked' WHEN o_orderkey % 7 = 0 OR o_orderdate + to_days((o_orderkey % 400)::INT) > TIMESTAMP '1998-01-01' THEN 'live' ELSE 'expired' END AS status FROM orders)
      SELECT *, (SELECT count(*) FROM s WHERE status = 'live') < 100 AS may_create FROM s""",
    "token_hash_lookup": "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 <> 0 AND c_acctbal > 0",
    "sessions": f'{_VISITS} SELECT user_id, visit, min(a) AS "first", max(a) AS "last", count(*) AS uses FROM v GROUP BY ALL',
    "sessions_stream": f'{_VISITS} SELECT user_id, min(a) AS "first", max(a) AS "last", count(*) AS uses FROM v GROUP BY user_id, visit',
    "event_frames": """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS frame_no, ltrim(replace(replace(text, chr(10), ' '), '"', '''')) || chr(10) || turn AS data FROM conversations""",
    "stream_answers": """WITH n AS (SELECT conv_id, turn, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS part, NOT bool_or(role = 'system') OVER (PARTITION BY conv_id) AS finished FROM conversations)
      SELECT conv_id, part, string_agg(text, '' ORDER BY turn) AS text, count(*) AS tokens, any_value(finished) AS finished FROM n GROUP BY conv_id, part""",
    "check_progress": "WITH g AS (SELECT user_id, max(event_id) AS step, 9800 + user_id AS total, arg_max(event_type, event_id) AS message FROM events GROUP BY ALL) SELECT *, step >= total AS done FROM g",
    "mask_secrets": """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'set, ending …' || right(c_name, 4) ELSE '' END AS hint,
      array_to_string(list_filter([CASE WHEN c_nationkey <= 3 THEN 'it has no address' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'it has no model name' END, CASE WHEN NOT c_acctbal > 0 THEN 'it has no key' END], lambda x: x IS NOT NULL), '; ') AS problems FROM customer""",
}
