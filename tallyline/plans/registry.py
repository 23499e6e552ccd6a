"""The queue queries by name, and the same queries in DuckDB's SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.functions import codec
from tallyline.operators import batching, compaction, fold, statistics, transitions
from tallyline.plans import http
from tallyline.plans.views import EXPIRED, LEASED, NACKED, NOW, lease_log, queue_log, requests, table, task_table
from tallyline.sources import segments
from tallyline.streaming import processor

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder that all machines share: under spark.checkpoint.dir, or a local one where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tallyline-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


LOG = """log AS (SELECT user_id AS id, event_id AS pos, event_id // 1000 AS segment_id,
  CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'click' THEN 3 ELSE 4 END::BIGINT AS op,
  (user_id * 37) % 256 AS priority, event_id % 3 AS retries, event_id % 7 AS consumer_id, event_id % 97 AS expire_ts, props AS payload FROM events)"""
LATEST = f"""{LOG}, latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos DESC) = 1)"""
READY = f"""{LATEST}, ready AS (SELECT id, priority, CASE op WHEN 0 THEN 0 ELSE retries END AS retries, pos FROM latest WHERE op IN (0, 3, 4) OR (op = 1 AND expire_ts <= {NOW}))"""
PAYLOAD = """ended AS (SELECT id, max(pos) AS stop FROM {0} WHERE op IN (2, 5) GROUP BY 1),
live AS (SELECT l.* FROM {0} l LEFT JOIN ended USING (id) WHERE stop IS NULL OR pos > stop),
payloads AS (SELECT id, CASE WHEN count(*) FILTER (op = 0) > 0 THEN arg_max(payload, pos) FILTER (op = 0) ELSE arg_min(payload, pos) FILTER (op IN (1, 3, 4)) END AS payload FROM live GROUP BY 1)"""
TASKS = """tasks AS (SELECT o_orderkey AS id, c_mktsegment AS queue, 6 - left(o_orderpriority, 1)::BIGINT AS priority,
  CASE o_orderstatus WHEN 'O' THEN 'ready' WHEN 'P' THEN 'leased' ELSE 'acked' END AS state FROM orders JOIN customer ON o_custkey = c_custkey)"""
LEASES = """held AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'N' THEN 1 ELSE 2 END AS op, l_suppkey % 4 AS consumer_id, (l_linenumber % 3)::BIGINT AS retries FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_shipdate DESC, l_quantity DESC, l_extendedprice DESC) = 1),
checked AS (SELECT o_orderkey AS id, o_custkey % 4 AS consumer_id, CASE WHEN h.id IS NULL THEN 'not_found' WHEN h.consumer_id <> o_custkey % 4 THEN 'conflict' ELSE 'ok' END AS result, retries
  FROM orders LEFT JOIN (SELECT * FROM held WHERE op = 1) h ON h.id = o_orderkey)"""
ARRIVALS = """arrivals AS (SELECT event_type AS queue, epoch_us(ts) AS "at", event_id AS seq FROM events)"""


def _held(spark, d):
    s = lease_log(spark, d)
    return s.groupBy("id").agg(F.max(F.struct("pos", "op", "consumer_id", "retries")).alias("x")).select("id", "x.op", "x.consumer_id", "x.retries").where(F.col("op") == LEASED)


def _arrivals(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("queue"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"))


@query(f"WITH {READY} SELECT id, priority, retries, pos, row_number() OVER (ORDER BY priority DESC, pos) AS dispatch_rank FROM ready")
def recover_ready(spark: SparkSession, d: str) -> DataFrame:
    return fold.dispatch_rank(fold.ready(queue_log(spark, d), NOW))


@query(f"WITH {LATEST} SELECT id, op, priority, pos FROM latest")
def recover_latest_state(spark, d):
    return fold.latest(queue_log(spark, d), columns=("op", "priority")).select("id", "op", "priority", "pos")


@query(f"WITH {LATEST} SELECT id, consumer_id, expire_ts, retries, priority, pos FROM latest WHERE op = 1 AND expire_ts > {NOW}")
def recover_leases_at(spark, d):
    return fold.leases(queue_log(spark, d), NOW)


@query(f"WITH {TASKS} SELECT queue, count(*) FILTER (state = 'ready') AS ready_tasks, count(*) FILTER (state = 'leased') AS active_leases FROM tasks GROUP BY 1")
def status_by_queue(spark, d):
    return fold.status(task_table(spark, d))


@query(f"WITH {LOG} SELECT max(id) + 1 AS next_id FROM log")
def next_id(spark, d):
    return fold.next_id(queue_log(spark, d))


@query("SELECT event_id AS seq, row_number() OVER (ORDER BY event_id) + 1000000 AS id, 0::BIGINT AS op, (user_id * 37) % 256 AS priority FROM events WHERE event_type = 'signup'")
def push_ids(spark, d):
    """Ids without gaps: ranks within blocks of the arrival order, shifted by the blocks before."""
    new = queue_log(spark, d).where("op = 0").withColumnRenamed("pos", "seq")
    return transitions.push(None, new, 1000001, "seq", keep=("seq",)).select("seq", "id", "op", "priority")


@query(f"WITH {TASKS} SELECT id, queue, priority FROM tasks WHERE state = 'ready' ORDER BY priority DESC, id LIMIT 25")
def pop_top_k(spark, d):
    return fold.pop(task_table(spark, d).where("state = 'ready'"), 25, "id").select("id", "queue", "priority")


@query(f"WITH {TASKS} SELECT queue, id, priority, row_number() OVER (PARTITION BY queue ORDER BY priority DESC, id) AS rank FROM tasks WHERE state = 'ready' QUALIFY rank <= 5")
def pop_top_k_per_queue(spark, d):
    return fold.pop_per_queue(task_table(spark, d).where("state = 'ready'"), 5, "id").select("queue", "id", "priority", "rank")


@query(f"WITH {READY}, {PAYLOAD.format('log')} SELECT id, priority, retries, payload FROM (SELECT * FROM ready ORDER BY priority DESC, pos LIMIT 50) JOIN payloads USING (id)")
def pop_with_payload(spark, d):
    """The winners first, their payloads after: payload columns never enter the fold."""
    log = queue_log(spark, d)
    won = fold.pop(fold.ready(log, NOW), 50).select("id", "priority", "retries")
    own = log.join(F.broadcast(won.select("id")), "id", "left_semi")  # k rows
    return won.join(fold.payloads(own), "id")


@query(f"WITH {READY} SELECT r.id, ({NOW} + 30)::BIGINT AS expire_ts, 7::BIGINT AS consumer_id, 1::BIGINT AS op, retries, priority FROM ready r ORDER BY priority DESC, pos LIMIT 50")
def pop_lease_events(spark, d):
    won = fold.pop(fold.ready(queue_log(spark, d), NOW), 50)
    return won.select("id", F.lit(NOW + 30).cast("bigint").alias("expire_ts"), F.lit(7).cast("bigint").alias("consumer_id"), F.lit(LEASED).cast("bigint").alias("op"), "retries", "priority")


@query(f"WITH {LEASES} SELECT id, consumer_id, result FROM checked")
def ack_validate(spark, d):
    return transitions.validate(requests(spark, d), _held(spark, d)).select("id", "consumer_id", "result")


@query(f"WITH {LEASES} SELECT id, consumer_id, result, CASE WHEN result <> 'ok' THEN NULL WHEN retries + 1 >= 3 THEN 5 ELSE 3 END::BIGINT AS op FROM checked")
def nack_validate(spark, d):
    v = transitions.validate(requests(spark, d), _held(spark, d))
    op = F.when(F.col("result") == "ok", F.when(F.col("retries") + 1 >= 3, 5).otherwise(NACKED)).cast("bigint")
    return v.select("id", "consumer_id", "result", op.alias("op"))


@query(f"WITH {LEASES} SELECT result, CASE result WHEN 'ok' THEN 200 WHEN 'not_found' THEN 404 ELSE 409 END::BIGINT AS status, count(*) AS n FROM checked GROUP BY 1, 2")
def http_status_map(spark, d):
    v = transitions.validate(requests(spark, d), _held(spark, d))
    return v.groupBy("result", transitions.http_status(F.col("result")).alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {LATEST} SELECT id, retries + 1 AS retries, CASE WHEN retries + 1 >= 3 THEN 5 ELSE 3 END::BIGINT AS op, retries + 1 < 3 AS requeued FROM latest WHERE op = 1 AND expire_ts > {NOW}")
def nack_transition(spark, d):
    return transitions.failed(fold.leases(queue_log(spark, d), NOW), NACKED).select("id", "retries", "op", "requeued")


@query(f"WITH {LATEST} SELECT id, retries + 1 AS retries, CASE WHEN retries + 1 >= 3 THEN 5 ELSE 4 END::BIGINT AS op, retries + 1 < 3 AS requeued FROM latest WHERE op = 1 AND expire_ts <= {NOW}")
def expire_sweep(spark, d):
    held = fold.latest(queue_log(spark, d)).where(F.col("op") == LEASED)
    return transitions.expired(held.drop("op"), NOW).select("id", "retries", "op", "requeued")


FAILURES = f"""{LOG}, runs AS (SELECT *, sum((op = 2)::INT) OVER (PARTITION BY id ORDER BY pos) AS run FROM log),
fails AS (SELECT id, pos, op, sum((op IN (3, 4))::INT) OVER (PARTITION BY id, run ORDER BY pos)::BIGINT AS failures FROM runs)"""


@query(f"WITH {FAILURES} SELECT id, pos, failures FROM fails WHERE op IN (3, 4)")
def retry_counts(spark, d):
    return transitions.failures_since_ack(queue_log(spark, d))


@query(f"WITH {FAILURES} SELECT id, pos, failures FROM fails WHERE op IN (3, 4) AND failures >= 3")
def retry_dead_letter(spark, d):
    return transitions.dead_letters(queue_log(spark, d))


@query(f"WITH {LOG} SELECT id, count(*) FILTER (op = 1) AS deliveries, count(*) FILTER (op = 2) AS acks FROM log GROUP BY 1")
def delivery_count(spark, d):
    return transitions.deliveries(queue_log(spark, d))


@query(f"WITH {LOG}, b AS (SELECT id, pos, op, coalesce(lag(op) OVER (PARTITION BY id ORDER BY pos), -1) AS before FROM log) SELECT id, pos, before FROM b WHERE op = 2 AND before <> 1")
def late_ack(spark, d):
    return transitions.late_acks(queue_log(spark, d))


CLOSED = f"""{LOG}, closed AS (SELECT * FROM log WHERE segment_id < (SELECT max(segment_id) FROM log)),
last AS (SELECT * FROM closed QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos DESC) = 1), kept AS (SELECT * FROM last WHERE op NOT IN (2, 5))"""


@query(f"WITH {CLOSED} SELECT id, op, priority, pos FROM kept")
def compact_survivors(spark, d):
    s = fold.latest(compaction.closed(queue_log(spark, d)), columns=("op", "priority"))
    return s.where(~F.col("op").isin(2, 5)).select("id", "op", "priority", "pos")


@query(f"WITH {CLOSED}, {PAYLOAD.format('closed')} SELECT id, op, pos, retries, payloads.payload AS payload FROM kept JOIN payloads USING (id)")
def compact_payload(spark, d):
    return compaction.survivors(compaction.closed(queue_log(spark, d))).select("id", "op", "pos", "retries", "payload")


@query(f"WITH {CLOSED} SELECT (SELECT count(DISTINCT segment_id) FROM closed) AS segments_compacted, (SELECT count(*) FROM closed) AS events_read, (SELECT max(id) FROM closed) AS high_water, (SELECT count(*) FROM kept) AS survivors")
def compact_stats(spark, d):
    return compaction.stats(compaction.closed(queue_log(spark, d)))


@query(f"WITH {LATEST}, {PAYLOAD.format('log')} SELECT id, op, pos, payloads.payload AS payload FROM latest JOIN payloads USING (id) WHERE op NOT IN (2, 5)")
def compact_no_resurrection(spark, d):
    """Live tasks after a real compaction, whose active segment may end tasks that the compacted part still holds."""
    store = compaction.Store(spark, scratch(spark, "store"))
    store.append(queue_log(spark, d))
    store.compact()
    log = store.read()
    s = fold.latest(log, columns=("op",)).where(~F.col("op").isin(2, 5))
    return s.join(fold.payloads(log), "id").select("id", "op", "pos", "payload")


@query(f"WITH {LOG} SELECT segment_id, count(*) AS events, min(pos) AS first_pos, max(pos) AS last_pos, segment_id = (SELECT max(segment_id) FROM log) AS active FROM log GROUP BY 1")
def segment_listing(spark, d):
    s = queue_log(spark, d).groupBy("segment_id").agg(F.count("*").alias("events"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    return s.withColumn("active", F.col("segment_id") == F.max("segment_id").over(Window.partitionBy()))


@query(f"WITH {LOG} SELECT id, op, priority, payload FROM log WHERE segment_id = 0 AND pos = 123")
def point_read(spark, d):
    return queue_log(spark, d).where("segment_id = 0 and pos = 123").select("id", "op", "priority", "payload")


@query(f"WITH {LOG} SELECT segment_id, pos, id, op, lag(pos) OVER (PARTITION BY segment_id ORDER BY pos) AS before FROM log")
def scan_order(spark, d):
    return queue_log(spark, d).select("segment_id", "pos", "id", "op", F.lag("pos").over(Window.partitionBy("segment_id").orderBy("pos")).alias("before"))


@query("""WITH RECURSIVE f AS (SELECT event_type AS queue, event_id AS seq, strlen(props) + 19 AS size, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
r AS (SELECT queue, seq, n, 1::BIGINT AS segment_id, 0::BIGINT AS offset_, size FROM f WHERE n = 1
  UNION ALL SELECT f.queue, f.seq, f.n, CASE WHEN offset_ + r.size >= 4096 THEN segment_id + 1 ELSE segment_id END, CASE WHEN offset_ + r.size >= 4096 THEN 0 ELSE offset_ + r.size END, f.size FROM r JOIN f ON f.queue = r.queue AND f.n = r.n + 1)
SELECT queue, seq, segment_id, offset_ AS "offset" FROM r""")
def segment_rotation(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("queue"), F.col("event_id").alias("seq"), (F.octet_length("props") + codec.HEADER).cast("bigint").alias("size"))
    return batching.rotate(e, 4096)


def _frames(spark, d):
    log = queue_log(spark, d)
    return log.select("pos", "id", "op", "priority", "payload", codec.encode(F.col("op"), F.col("priority"), F.col("id"), F.col("payload")).alias("frame"))


@query(f"""WITH {LOG}, t AS (SELECT list(list_reduce(list_concat([n::UBIGINT], list_transform(range(8), lambda i: 0::UBIGINT)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::UBIGINT) ELSE a // 2 END) ORDER BY n) AS tab FROM range(256) r(n)),
b AS (SELECT pos, printf('%02X%02X', op, priority) || printf('%016X', id) || printf('%08X', strlen(payload)) || hex(encode(payload)) AS body FROM log),
c AS (SELECT pos, body, list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(len(body) // 2), lambda i: ((instr('0123456789ABCDEF', body[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', body[2 * i + 2]) - 1)::UBIGINT)),
  lambda c, x: xor(c // 256, tab[(xor(c % 256, x) + 1)::BIGINT])) AS crc FROM b, t)
SELECT pos, '4E' || printf('%08X', xor(crc, 4294967295::UBIGINT)::BIGINT) || body AS frame FROM c""")
def frame_encode(spark, d):
    return _frames(spark, d).select("pos", F.hex("frame").alias("frame"))


@query(f"WITH {LOG} SELECT pos, id, op, priority, payload, true AS same FROM log")
def frame_decode_roundtrip(spark, d):
    r = _frames(spark, d).withColumn("r", codec.decode(F.col("frame")))
    same = (F.col("r.id") == F.col("id")) & (F.col("r.op") == F.col("op")) & (F.col("r.priority") == F.col("priority")) & (F.col("r.payload") == F.col("payload").cast("binary"))
    return r.select("pos", "r.id", "r.op", "r.priority", F.col("r.payload").cast("string").alias("payload"), F.coalesce(same, F.lit(False)).alias("same"))


@query(f"WITH {LOG} SELECT pos, true AS rejected FROM log")
def frame_corruption(spark, d):
    """Every frame with one bit turned, a different one in each, is refused."""
    f = _frames(spark, d)
    at = F.pmod(F.xxhash64("pos"), F.octet_length("frame")).cast("int")
    byte = F.conv(F.hex(F.expr("substring(frame, __at + 1, 1)")), 16, 10).cast("int")
    turned = byte.bitwiseXOR(F.lit(1).cast("int") * F.expr("shiftleft(1, cast(pos % 8 as int))"))
    bad = F.concat(F.expr("substring(frame, 1, __at)"), F.unhex(F.lpad(F.hex(turned), 2, "0")), F.expr("substring(frame, __at + 2)"))
    return f.withColumn("__at", at).select("pos", codec.decode(bad).isNull().alias("rejected"))


@query(f"WITH {LOG} SELECT segment_id, count(*) AS events, sum(strlen(payload))::BIGINT AS bytes, min(id) AS least_id, max(id) AS most_id FROM log GROUP BY 1")
def segment_files(spark, d):
    """Writes the log as segment files and scans them again."""
    path = scratch(spark, "segments")
    log = queue_log(spark, d).select("segment_id", F.col("pos").alias("offset"), "id", "op", "priority", F.col("payload").cast("binary").alias("payload"))
    segments.write_segments(log, path)
    s = segments.read_segments(spark, path)
    return s.groupBy("segment_id").agg(F.count("*").alias("events"), F.sum(F.octet_length("payload")).alias("bytes"), F.min("id").alias("least_id"), F.max("id").alias("most_id"))


@query("SELECT event_id, to_base64(encode(props)) AS encoded, props AS decoded FROM events")
def base64_roundtrip(spark, d):
    e = table(spark, d, "events").select("event_id", F.base64(F.col("props").cast("binary")).alias("encoded"))
    return e.select("event_id", "encoded", F.try_to_binary("encoded", F.lit("base64")).cast("string").alias("decoded"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS payload, user_id % 256 AS priority FROM events""")
def http_push_body(spark, d):
    """Push requests as JSON; a fifth has a payload that is not base64."""
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 5 == 0, "***").otherwise(F.base64(F.col("props").cast("binary")))
    body = F.to_json(F.struct(text.alias("payload"), (F.col("user_id") % 256).alias("priority")))
    r = http.parse_push(body)
    return e.select("event_id", r["payload"].cast("string").alias("payload"), r["priority"].alias("priority"))


@query("SELECT DISTINCT c_mktsegment AS queue FROM customer")
def queue_catalog(spark, d):
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("queue")).distinct().orderBy("queue")


IDLE = 90_000_000
BATCHES = f"""{ARRIVALS}, g AS (SELECT *, CASE WHEN "at" - lag("at") OVER w >= {IDLE} THEN 1 ELSE 0 END AS fresh FROM arrivals WINDOW w AS (PARTITION BY queue ORDER BY "at", seq)), b AS (SELECT queue, "at", seq, sum(fresh) OVER (PARTITION BY queue ORDER BY "at", seq)::BIGINT AS batch FROM g)"""


@query(f"WITH {BATCHES} SELECT * FROM b")
def group_commit_idle(spark, d):
    return batching.idle_batches(_arrivals(spark, d), IDLE)


@query(f"WITH {BATCHES}, s AS (SELECT queue, batch, count(*) AS n FROM b GROUP BY 1, 2) SELECT queue, count(*) AS batches, max(n) AS largest, sum(n)::BIGINT AS arrivals FROM s GROUP BY 1")
def group_commit_sizes(spark, d):
    sizes = batching.idle_batches(_arrivals(spark, d), IDLE).groupBy("queue", "batch").agg(F.count("*").alias("n"))
    return sizes.groupBy("queue").agg(F.count("*").alias("batches"), F.max("n").alias("largest"), F.sum("n").alias("arrivals"))


@query(f"""WITH RECURSIVE {ARRIVALS}, a AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY "at", seq) AS i FROM arrivals),
r AS (SELECT queue, "at", seq, i, 0::BIGINT AS batch, "at" AS start, 1 AS n FROM a WHERE i = 1
  UNION ALL SELECT a.queue, a."at", a.seq, a.i, CASE WHEN r.n >= 8 OR a."at" - r.start >= 600000000 THEN batch + 1 ELSE batch END,
    CASE WHEN r.n >= 8 OR a."at" - r.start >= 600000000 THEN a."at" ELSE r.start END, CASE WHEN r.n >= 8 OR a."at" - r.start >= 600000000 THEN 1 ELSE r.n + 1 END
  FROM r JOIN a ON a.queue = r.queue AND a.i = r.i + 1) SELECT queue, "at", seq, batch FROM r""")
def group_commit_capped(spark, d):
    return batching.capped_batches(_arrivals(spark, d), 600_000_000, 8)


CLOSED = f"""r.n >= 8 OR a."at" - r.start >= 600000000 OR a."at" - r."at" >= {IDLE} OR r.seq % 11 = 0"""


@query(f"""WITH RECURSIVE {ARRIVALS}, a AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY "at", seq) AS i FROM arrivals),
r AS (SELECT queue, "at", seq, i, 0::BIGINT AS batch, "at" AS start, 1 AS n FROM a WHERE i = 1
  UNION ALL SELECT a.queue, a."at", a.seq, a.i, CASE WHEN {CLOSED} THEN batch + 1 ELSE batch END, CASE WHEN {CLOSED} THEN a."at" ELSE r.start END, CASE WHEN {CLOSED} THEN 1 ELSE r.n + 1 END
  FROM r JOIN a ON a.queue = r.queue AND a.i = r.i + 1) SELECT queue, "at", seq, batch FROM r""")
def group_commit_forced(spark, d):
    """All four ways to close a batch together: size, window, idle time, force."""
    return batching.capped_batches(_arrivals(spark, d).withColumn("force", F.col("seq") % 11 == 0), 600_000_000, 8, IDLE, force="force")


FIGURES = "SELECT event_type, count(*) AS runs, floor(min(value))::BIGINT AS least, floor(max(value))::BIGINT AS most, bool_and(value >= 0) AS all_ok FROM events GROUP BY 1"


def _figures(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("runs"), F.floor(F.min(v)).alias("least"), F.floor(F.max(v)).alias("most"), F.bool_and(v >= 0).alias("all_ok"))


@query(f"""WITH f AS ({FIGURES}) SELECT 0::BIGINT AS "at", '| event_type | runs | least | most | all_ok |' AS line UNION ALL SELECT 1, '|---|---|---|---|---|'
UNION ALL SELECT row_number() OVER (ORDER BY event_type) + 1, '| ' || concat_ws(' | ', event_type, runs, least, most, all_ok) || ' |' FROM f""")
def bench_markdown(spark, d):
    return statistics.markdown(_figures(spark, d), ["event_type"])


@query(FIGURES)
def bench_csv(spark, d):
    """Figures as read back from the CSV file."""
    path = scratch(spark, "results")
    statistics.write_results(_figures(spark, d), ["event_type"], path)
    return spark.read.schema("event_type string, runs bigint, least bigint, most bigint, all_ok boolean").csv(f"{path}/csv", header=True)


@query("SELECT event_type, count(*) AS runs, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS stddev, min(value) AS least, max(value) AS most, CASE WHEN max(epoch_us(ts)) > min(epoch_us(ts)) THEN round(count(*) * 1000000::DOUBLE / (max(epoch_us(ts)) - min(epoch_us(ts))), 6) END AS throughput, bool_and(value >= 0) AS all_ok FROM events GROUP BY 1")
def bench_stats(spark, d):
    e = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return statistics.run_figures(e, "event_type", "value", "at")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def bench_quantiles(spark, d):
    return statistics.quantiles(table(spark, d, "events"), "event_type", "value")


@query(f"WITH {LATEST}, n AS (SELECT id % 4 AS lane, count(*) AS pushed, count(*) FILTER (op NOT IN (2, 5)) AS live, count(*) FILTER (op IN (2, 5)) AS ended FROM latest GROUP BY 1) SELECT *, pushed = live + ended AS ok FROM n")
def integrity_check(spark, d):
    """Ids of the log against live tasks found in a store that was compacted, and tasks that the log says have ended."""
    log = queue_log(spark, d).withColumn("lane", F.col("id") % 4)
    store = compaction.Store(spark, scratch(spark, "integrity"))
    store.append(log.drop("lane"))
    store.compact()
    live = fold.latest(store.read(), columns=("op",)).where(~F.col("op").isin(2, 5)).withColumn("lane", F.col("id") % 4)
    ended = fold.latest(log, columns=("op", "lane")).where(F.col("op").isin(2, 5))
    return statistics.integrity(log, live, ended, "lane")


@query(f"WITH {TASKS} SELECT id, queue, priority, 'ready' AS state FROM tasks")
def sql_insert_ready(spark, d):
    return task_table(spark, d).withColumn("state", F.lit("ready"))


@query(f"WITH {TASKS} SELECT id FROM tasks WHERE state = 'ready' ORDER BY priority DESC, id LIMIT 1")
def sql_next_ready(spark, d):
    return fold.pop(task_table(spark, d).where("state = 'ready'"), 1, "id").select("id")


@query(f"WITH {TASKS} SELECT id, CASE WHEN state = 'leased' THEN 'acked' ELSE state END AS state FROM tasks")
def sql_update_acked(spark, d):
    return task_table(spark, d).select("id", F.when(F.col("state") == "leased", "acked").otherwise(F.col("state")).alias("state"))


@query(f"WITH {TASKS} SELECT count(*) AS n FROM tasks WHERE state = 'ready'")
def sql_count_ready(spark, d):
    return task_table(spark, d).where("state = 'ready'").agg(F.count("*").alias("n"))


@query(f"WITH {LATEST} SELECT id, op, pos, priority FROM latest")
def stateful_fold(spark, d):
    """The log as a stream through the stateful processor; its last change of each task is the batch fold."""
    source = scratch(spark, "stream-in")
    queue_log(spark, d).drop("payload", "segment_id").write.parquet(source)
    changes = processor.stream_latest(processor.events_stream(spark, source), scratch(spark, "stream-out"), scratch(spark, "stream-state"))
    return changes.groupBy("id").agg(F.max_by("op", "pos").alias("op"), F.max("pos").alias("pos"), F.max_by("priority", "pos").alias("priority"))


@query()
def command_fold(spark, d):
    """Commands made of events, one queue for each user, folded in order by the queue machine."""
    e = queue_log(spark, d)
    cmd = F.when(F.col("op") == 0, "push").when(F.col("op") == 1, "pop").when(F.col("op") == 2, "ack").when(F.col("op") == 3, "nack").otherwise("tick")
    c = e.select(F.col("id").cast("string").alias("queue"), F.col("pos").alias("seq"), (F.col("pos") / 10).cast("bigint").alias("now_s"), cmd.alias("cmd"), (F.col("pos") % 3 + 1).alias("id"), F.lit(1).cast("bigint").alias("consumer_id"), F.lit(50).cast("bigint").alias("lease_secs"), "priority", F.col("payload").cast("binary").alias("payload"))
    return processor.fold_commands(c)


@query(f"WITH {LATEST} SELECT id, op, pos FROM latest WHERE op = {EXPIRED}")
def recover_expired(spark, d):
    return fold.latest(queue_log(spark, d), columns=("op",)).where(F.col("op") == EXPIRED).select("id", "op", "pos")
