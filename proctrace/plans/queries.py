"""Every registered query, with its DuckDB twin, over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proctrace.functions import scalars
from proctrace.operators import detections, frames, history, quality, tasks
from proctrace.plans.registry import ORACLES, QUERIES
from proctrace.sources import driver_tables as src
from proctrace.sources.tables import register_views

#: Lower bounds of the lengths, which fit these tables; throttling to one frame in six hours.
SEGMENT, LIVE, THROTTLE_S = 10, 5, 6 * 3600.0

BASE = """
e AS (SELECT 'camera_' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS client_id, event_id AS frame_id, ts, user_id, event_type, value,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
frames AS (SELECT client_id, frame_id, ts, CASE k % 3 WHEN 0 THEN 640 WHEN 1 THEN 1280 ELSE 1920 END AS width,
  CASE k % 3 WHEN 0 THEN 480 WHEN 1 THEN 720 ELSE 1080 END AS height, event_type <> 'error' AS pipeline_ok, k, value, event_type, k % 25 AS bubble_count FROM e),
c0 AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN frame_id END IGNORE NULLS) OVER (PARTITION BY client_id ORDER BY ts, frame_id ROWS UNBOUNDED PRECEDING) AS last_id
  FROM e WHERE event_type IN ('signup', 'click', 'purchase')),
commands AS (SELECT client_id, ts, frame_id AS cmd_id, CASE event_type WHEN 'signup' THEN 'initialize' WHEN 'click' THEN 'start' ELSE 'terminate' END AS command,
  CASE WHEN event_type = 'signup' THEN frame_id ELSE last_id - CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END END AS task_id, user_id AS actor_id FROM c0),
j0 AS (SELECT *, last_value(CASE WHEN command = 'initialize' THEN task_id END IGNORE NULLS) OVER w AS open_id, count(*) FILTER (command = 'initialize') OVER w AS turn
  FROM commands WINDOW w AS (PARTITION BY client_id ORDER BY ts, cmd_id ROWS UNBOUNDED PRECEDING)),
judged AS (SELECT client_id, ts, cmd_id, command, task_id, actor_id, command = 'initialize' OR (coalesce(task_id = open_id, false)
  AND coalesce(count(*) FILTER (command = 'terminate' AND task_id = open_id) OVER (PARTITION BY client_id, turn ORDER BY ts, cmd_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0) AS accepted FROM j0),
attached AS (SELECT f.*, CASE WHEN m.command = 'initialize' THEN m.task_id END AS task_id FROM frames f
  ASOF LEFT JOIN (SELECT * FROM judged WHERE accepted AND command IN ('initialize', 'terminate')) m ON f.client_id = m.client_id AND f.ts >= m.ts),
det AS (SELECT client_id, frame_id, 1 AS box_no, k % 4 AS class_id, 1 - value / 500.0 AS confidence FROM e),
named AS (SELECT d.*, coalesce(c.class_name, 'class_' || CAST(d.class_id AS VARCHAR)) AS class_name FROM det d
  LEFT JOIN (VALUES (0, 'straight'), (1, 'Bent_tube'), (2, 'bending')) c(class_id, class_name) ON d.class_id = c.class_id),
bent AS (SELECT client_id, frame_id, bool_or(contains(lower(class_name), 'bent') OR contains(lower(class_name), 'bending')) AS bent,
  count(*) FILTER (contains(lower(class_name), 'bent') OR contains(lower(class_name), 'bending')) AS n_bent, count(*) AS n_boxes, string_agg(class_name, ',' ORDER BY class_name) AS names
  FROM named WHERE confidence > 0.8 GROUP BY 1, 2),
results AS (SELECT a.*, coalesce(b.bent, false) AS bent FROM attached a LEFT JOIN bent b ON a.client_id = b.client_id AND a.frame_id = b.frame_id),
counts AS (SELECT client_id, frame_id, ts, task_id, CASE WHEN task_id IS NULL THEN 0 ELSE count(*) OVER w - 1 + sum(bent::INT) OVER w END::BIGINT AS stored_count,
  CASE WHEN task_id IS NULL THEN 0 ELSE count(*) OVER w + sum(bent::INT) OVER w END::BIGINT AS after_count
  FROM results WHERE pipeline_ok WINDOW w AS (PARTITION BY task_id ORDER BY ts, frame_id ROWS UNBOUNDED PRECEDING)),
okn AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY ts, frame_id) AS no FROM attached WHERE pipeline_ok),
chunk AS (SELECT client_id, (no - 1) // 10 AS segment_no, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_frames, arg_max(frame_id, ts) AS last_frame, arg_max_null(task_id, ts) AS task_id
  FROM okn GROUP BY 1, 2 HAVING count(*) = 10),
segs AS (SELECT last_frame * 2 + CASE kind WHEN 'processed' THEN 1 ELSE 0 END AS id, client_id, task_id, kind, segment_no, n_frames, start_ts, end_ts,
  client_id || '/' || coalesce(CAST(task_id AS VARCHAR), 'no_task') || '/hls/' || kind || '_segment_' || CAST(epoch_us(start_ts) AS VARCHAR) || '.mp4' AS segment_path,
  client_id || '/' || coalesce(CAST(task_id AS VARCHAR), 'no_task') || '/hls/' || kind || '_playlist.m3u8' AS playlist_path,
  CASE kind WHEN 'processed' THEN client_id || '/' || coalesce(CAST(task_id AS VARCHAR), 'no_task') || '/hls/keypoints_' || CAST(epoch_us(start_ts) AS VARCHAR) || '.json' END AS keypoints_path
  FROM chunk, (VALUES ('raw'), ('processed')) t(kind)),
kp AS (SELECT o.client_id, o.frame_id, o.ts, c.segment_no, (o.no - 1) % 10 AS pos, c.task_id, epoch_us(c.start_ts) AS segment_start_us,
  CASE WHEN o.event_type <> 'view' THEN o.k * 6 END AS x, CASE WHEN o.event_type <> 'view' THEN CAST(floor(o.value) AS INTEGER) END AS y
  FROM okn o JOIN chunk c ON o.client_id = c.client_id AND (o.no - 1) // 10 = c.segment_no),
tasks AS (SELECT task_id, arg_max(actor_id, ts) FILTER (command = 'initialize') AS initiator_operator_id, '0' AS current_step,
  CASE arg_max(command, ts) WHEN 'terminate' THEN 'terminated' WHEN 'start' THEN 'running' ELSE 'initialized' END AS status,
  min(epoch_us(ts) // 1000000) FILTER (command = 'initialize') AS created_at, max(epoch_us(ts) // 1000000) AS updated_at,
  coalesce(max(epoch_us(ts) // 1000000) FILTER (command = 'start'), min(epoch_us(ts) // 1000000) FILTER (command = 'initialize')) AS start_time,
  coalesce(max(epoch_us(ts) // 1000000) FILTER (command = 'terminate'), 0) AS end_time FROM judged WHERE accepted GROUP BY task_id),
ulog AS (SELECT client_id, ts, frame_id AS seq, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'no_response' WHEN 'signup' THEN 'encode_error' ELSE 'success' END AS outcome FROM e)
"""
ISO = "CASE WHEN epoch_us({0}) % 1000000 = 0 THEN strftime({0}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') END"


def query(name: str, sql: str, base: str = "WITH"):
    """Registers a query and its twin; sql goes on from the common tables."""

    def add(f):
        QUERIES[name] = f
        ORACLES[name] = f"{base} {BASE} {sql}"
        return f

    return add


def us(c: str = "ts"):
    return F.unix_micros(c).alias(f"{c}_us" if c != "ts" else "ts_us")


def attached(spark: SparkSession, d: str, numbers: bool = False) -> DataFrame:
    return frames.attach_task(src.frames(spark, d), tasks.accepted_commands(src.commands(spark, d)), numbers)


def named(spark: SparkSession, d: str) -> DataFrame:
    return detections.with_class_name(src.detections(spark, d), src.classes(spark))


def with_bent(spark: SparkSession, d: str) -> DataFrame:
    """Frames with whether a confident box is bent."""
    bent = detections.bending_per_frame(detections.filter_confidence(named(spark, d))).select("client_id", "frame_id", "bent")
    return src.frames(spark, d).join(bent, ["client_id", "frame_id"], "left").withColumn("bent", F.coalesce("bent", F.lit(False)))


def results(spark: SparkSession, d: str) -> DataFrame:
    """Those frames with their task and its counters."""
    return frames.attach_task(with_bent(spark, d), tasks.accepted_commands(src.commands(spark, d)), bending=True)


def segs(spark: SparkSession, d: str) -> DataFrame:
    return frames.segments(attached(spark, d, numbers=True), SEGMENT)


def records(spark: SparkSession, d: str) -> DataFrame:
    seen = F.col("event_type") != "view"
    kp = frames.keypoint_frames(attached(spark, d, numbers=True), SEGMENT)
    return kp.withColumn("x", F.when(seen, F.col("k") * 6)).withColumn("y", F.when(seen, F.floor("value").cast("int")))


@query("frames_source", "SELECT client_id, frame_id, epoch_us(ts) AS ts_us, width, height, pipeline_ok FROM frames")
def frames_source(spark, d):
    return src.frames(spark, d).select("client_id", "frame_id", us(), "width", "height", "pipeline_ok")


def _addresses(spark, d):
    url = F.concat(F.lit("rtmp://localhost:1935/live/"), "client_id", F.lit("_"), (F.col("cmd_id") % 3).cast("string"))
    return quality.clients(src.commands(spark, d).where("command = 'initialize'").withColumn("url", url))


CLIENTS = "SELECT client_id, arg_max('rtmp://localhost:1935/live/' || client_id || '_' || CAST(cmd_id % 3 AS VARCHAR), ts) AS rtmp_url FROM commands WHERE command = 'initialize' GROUP BY 1"


@query("clients_dim", CLIENTS)
def clients_dim(spark, d):
    return _addresses(spark, d)


@query("clean_task_scan", "SELECT task_id, initiator_operator_id, current_step, status, strftime(make_timestamp(created_at * 1000000), '%Y-%m-%d %H:%M:%S') AS created_at, (SELECT count(*) FROM tasks) AS total FROM tasks")
def clean_task_scan(spark, d):
    return tasks.task_listing(tasks.fold_tasks(src.commands(spark, d)))


@query("playlist", "SELECT playlist_path, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || '#EXT-X-TARGETDURATION:10' || chr(10) || string_agg('#EXTINF:' || printf('%.3f', n_frames / 30.0::DOUBLE) || ',' || chr(10) || split_part(segment_path, '/', 4) || chr(10), '' ORDER BY start_ts, id) AS body, count(*) AS n_segments FROM segs GROUP BY 1")
def playlist(spark, d):
    return history.playlists(segs(spark, d))


@query("frame_payload", "SELECT doc_id, 'data:image/jpeg;base64,' || to_base64(encode(text)) AS url FROM documents")
def frame_payload(spark, d):
    return src.load(spark, d, "documents").select("doc_id", scalars.to_data_url(F.col("text").cast("binary")).alias("url"))


@query("adhoc_sql", "SELECT status, count(*) AS n, max(updated_at - created_at) AS longest FROM tasks GROUP BY status")
def adhoc_sql(spark, d):
    register_views(spark, {"clean_task": tasks.fold_tasks(src.commands(spark, d))})
    return spark.sql("SELECT status, count(*) AS n, max(updated_at - created_at) AS longest FROM clean_task GROUP BY status")


@query("detect_center_box", """, h AS (SELECT client_id, frame_id, width, height, width // 2 AS cx, height // 2 AS cy, least(200, width // 4) // 2 AS rw, least(200, height // 4) // 2 AS rh FROM frames)
SELECT client_id, frame_id, cx, cy, greatest(0, cx - rw) AS x1, greatest(0, cy - rh) AS y1, least(width, cx + rw) AS x2, least(height, cy + rh) AS y2, true AS mock FROM h""")
def detect_center_box(spark, d):
    return frames.detect_center_box(src.frames(spark, d))


@query("class_lookup", "SELECT client_id, frame_id, box_no, class_id, class_name FROM named")
def class_lookup(spark, d):
    return named(spark, d).select("client_id", "frame_id", "box_no", "class_id", "class_name")


@query("confidence_filter", "SELECT client_id, frame_id, box_no, confidence FROM det WHERE confidence > 0.8")
def confidence_filter(spark, d):
    return detections.filter_confidence(src.detections(spark, d)).select("client_id", "frame_id", "box_no", "confidence")


@query("clamp_thresholds", "SELECT frame_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 100.0 - 0.5)) AS threshold FROM e")
def clamp_thresholds(spark, d):
    return src.events(spark, d).select("frame_id", scalars.clamp01(F.col("value") / 100.0 - 0.5).alias("threshold"))


@query("bbox_truncate", "SELECT frame_id, CAST(trunc(value - 100) AS INTEGER) AS x1, CAST(trunc(value * 1.5) AS INTEGER) AS y1 FROM e")
def bbox_truncate(spark, d):
    return src.events(spark, d).select("frame_id", detections.truncated(F.col("value") - 100).alias("x1"), detections.truncated(F.col("value") * 1.5).alias("y1"))


@query("nms", """, m0 AS (SELECT l_orderkey AS frame_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS box_no, CAST(l_partkey % 2 AS INTEGER) AS class_id,
  (CAST(round(l_extendedprice * 100) AS BIGINT) % 1000) / 1000.0 AS conf, (l_partkey * 7) % 100 AS x1, (l_suppkey * 13) % 100 AS y1, 40 + CAST(l_quantity AS INTEGER) AS side FROM lineitem),
m AS (SELECT *, x1 + side AS x2, y1 + side AS y2, row_number() OVER (PARTITION BY frame_id, class_id ORDER BY conf DESC, box_no) AS r FROM m0),
g AS (SELECT frame_id, class_id, list({'b': box_no, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'a': side * side} ORDER BY r) AS boxes FROM m GROUP BY 1, 2),
w AS (SELECT frame_id, class_id, boxes, 1 AS i, [boxes[1]] AS kept FROM g UNION ALL
  SELECT frame_id, class_id, boxes, i + 1, CASE WHEN len(list_filter(kept, lambda q: greatest(0, least(q.x2, boxes[i + 1].x2) - greatest(q.x1, boxes[i + 1].x1)) * greatest(0, least(q.y2, boxes[i + 1].y2) - greatest(q.y1, boxes[i + 1].y1)) >
    0.45::DOUBLE * (q.a + boxes[i + 1].a - greatest(0, least(q.x2, boxes[i + 1].x2) - greatest(q.x1, boxes[i + 1].x1)) * greatest(0, least(q.y2, boxes[i + 1].y2) - greatest(q.y1, boxes[i + 1].y1))))) = 0 THEN list_append(kept, boxes[i + 1]) ELSE kept END
  FROM w WHERE i < len(boxes))
SELECT frame_id, class_id, unnest(list_transform(kept, lambda q: q.b)) AS box_no FROM w WHERE i = len(boxes)""", base="WITH RECURSIVE")
def nms(spark, d):
    return detections.nms(src.many_detections(spark, d))


@query("cleanliness_grade", """, s AS (SELECT client_id, frame_id, pipeline_ok, greatest(0, least(100, 100 - 5 * coalesce(bubble_count, 0)))::DOUBLE AS s FROM frames)
SELECT client_id, frame_id, CASE WHEN pipeline_ok THEN s ELSE 0.0::DOUBLE END AS score, CASE WHEN NOT pipeline_ok THEN 'Unknown' WHEN s >= 90 THEN 'Excellent' WHEN s >= 70 THEN 'Good' WHEN s >= 50 THEN 'Fair' ELSE 'Poor' END AS grade FROM s""")
def cleanliness_grade(spark, d):
    score, grade = detections.cleanliness(F.col("bubble_count"), F.col("pipeline_ok"))
    return src.frames(spark, d).select("client_id", "frame_id", score.alias("score"), grade.alias("grade"))


def _motion(spark, d):
    return attached(spark, d).withColumn("motion", detections.motion_actions(F.col("task_id"), F.when(F.col("pipeline_ok"), F.lit(True))))


@query("motion_actions", "SELECT client_id, frame_id, task_id IS NOT NULL AND pipeline_ok AS success, CASE WHEN NOT (task_id IS NOT NULL AND pipeline_ok) THEN 'Missing task or keypoints' END AS error, CASE WHEN task_id IS NOT NULL AND pipeline_ok THEN true END AS bending_detected, CASE WHEN task_id IS NOT NULL AND pipeline_ok THEN 'unknown' END AS submersion_status FROM attached")
def motion_actions(spark, d):
    return _motion(spark, d).select("client_id", "frame_id", "motion.success", "motion.error", "motion.actions.bending_detected", "motion.actions.submersion_status")


@query("bending_flag", "SELECT client_id, frame_id, bent, n_bent, n_boxes, names FROM bent")
def bending_flag(spark, d):
    return detections.bending_per_frame(detections.filter_confidence(named(spark, d)))


@query("stain_filter", "SELECT client_id, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS frame_no, count(*) AS n_stains, max(value) AS largest FROM e WHERE value > 100 GROUP BY 1, 2")
def stain_filter(spark, d):
    return detections.stains(src.events(spark, d).select("client_id", F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("frame_no"), F.col("value").alias("area")))


# halves occur among the coordinates, so the rounding shows
@query("bubble_summary", "SELECT frame_id, k % 4 AS bubble_count, k % 4 > 0 AS detected, CASE WHEN k % 4 > 0 THEN CAST(round_even(floor(value * 2) / 2, 0) AS INTEGER) END AS first_x, CASE WHEN k % 4 > 0 THEN CAST(round_even(k + 0.5::DOUBLE, 0) AS INTEGER) END AS first_radius, CASE WHEN k % 4 > 0 THEN CAST(round_even(k % 4 + 0.5::DOUBLE, 0) AS INTEGER) END AS last_y FROM e")
def bubble_summary(spark, d):
    circle = lambda i: F.struct((F.floor(F.col("value") * 2) / 2).alias("x"), (i + 0.5).cast("double").alias("y"), (F.col("k") + 0.5).cast("double").alias("radius"))
    circles = F.when(F.col("k") % 4 > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.col("k") % 4, F.lit(1))), circle)).otherwise(F.array().cast("array<struct<x:double,y:double,radius:double>>"))
    rows = src.events(spark, d).select("frame_id", detections.bubbles(circles).alias("b"))
    return rows.select("frame_id", "b.bubble_count", "b.detected", F.get("b.circles", F.lit(0))["x"].alias("first_x"), F.get("b.circles", F.lit(0))["radius"].alias("first_radius"), F.get("b.circles", F.size("b.circles") - 1)["y"].alias("last_y"))


@query("status_labels", """, s AS (SELECT c.client_id, c.frame_id, c.task_id, c.after_count, r.bent, r.bubble_count, greatest(0, 100 - 5 * r.bubble_count)::DOUBLE AS s FROM counts c JOIN results r ON c.client_id = r.client_id AND c.frame_id = r.frame_id)
SELECT client_id, frame_id, CASE WHEN bent THEN 'BENDING DETECTED! Count: ' ELSE 'Normal - Bending Count: ' END || CAST(after_count AS VARCHAR) AS bending_label, 'Task ID: ' || CAST(task_id AS VARCHAR) || ' | Bending: ' || CAST(after_count AS VARCHAR) AS task_label,
'Cleanliness: ' || CASE WHEN s >= 90 THEN 'Excellent' WHEN s >= 70 THEN 'Good' WHEN s >= 50 THEN 'Fair' ELSE 'Poor' END || ' (' || printf('%.1f', s) || ')' AS clean_label, 'Bubbles: ' || CAST(bubble_count AS VARCHAR) AS bubble_label FROM s""")
def status_labels(spark, d):
    n = F.col("after_count")
    score, grade = detections.cleanliness(F.col("bubble_count"), F.lit(True))
    return results(spark, d).where("pipeline_ok").select("client_id", "frame_id", detections.bending_label(F.col("bent"), n).alias("bending_label"), detections.task_label(F.col("task_id"), n).alias("task_label"), detections.cleanliness_label(grade, score).alias("clean_label"), detections.bubble_label(F.col("bubble_count")).alias("bubble_label"))


@query("task_point_lookup", "SELECT task_id, status, created_at, updated_at FROM tasks WHERE task_id = (SELECT min(task_id) FROM tasks)")
def task_point_lookup(spark, d):
    rows = tasks.fold_tasks(src.commands(spark, d))
    least = src.commands(spark, d).where("command = 'initialize'").agg(F.min("task_id")).first()[0]
    return history.lookup(rows, task_id=least).select("task_id", "status", "created_at", "updated_at")


@query("segments_null_filter", "SELECT id, kind, keypoints_path IS NOT NULL AS has_keypoints FROM segs")
def segments_null_filter(spark, d):
    return segs(spark, d).select("id", "kind", F.col("keypoints_path").isNotNull().alias("has_keypoints"))


# some paths name neither kind
@query("segment_kind", "SELECT id, CASE WHEN segment_no % 3 = 0 THEN NULL WHEN contains(segment_path, 'raw_segment') THEN 'raw' WHEN contains(segment_path, 'processed_segment') THEN 'processed' END AS kind FROM segs")
def segment_kind(spark, d):
    path = F.when(F.col("segment_no") % 3 == 0, F.replace("segment_path", F.lit("_segment_"), F.lit("_other_"))).otherwise(F.col("segment_path"))
    return history.with_kind(segs(spark, d).drop("kind").withColumn("segment_path", path)).select("id", "kind")


@query("frame_task_asof", "SELECT client_id, frame_id, task_id FROM attached")
def frame_task_asof(spark, d):
    return attached(spark, d).select("client_id", "frame_id", "task_id")


@query("segment_keypoints_join", "SELECT s.id, s.kind, CASE WHEN s.kind = 'processed' THEN s.keypoints_path END AS keypoints_path, CASE WHEN s.kind = 'processed' THEN n.n END AS n_records FROM segs s LEFT JOIN (SELECT client_id, segment_start_us, count(*) AS n FROM kp GROUP BY 1, 2) n ON s.client_id = n.client_id AND epoch_us(s.start_ts) = n.segment_start_us")
def segment_keypoints_join(spark, d):
    return history.segments_with_keypoints(segs(spark, d), records(spark, d)).select("id", "kind", "keypoints_path", "n_records")


# frames without content are kept
@query("result_cache", "SELECT doc_id, sha256(encode(t)) AS digest, strlen(t) AS n_bytes FROM (SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN text END AS t FROM documents)")
def result_cache(spark, d):
    docs = src.load(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.col("text")).cast("binary").alias("content"))
    return detections.infer_distinct(docs, "content", lambda x: x.select("digest", F.octet_length("content").cast("long").alias("n_bytes"))).select("doc_id", "digest", "n_bytes")


AS_OF = "2024-01-25 00:00:00"


@query("queue_status", f""", q AS (SELECT client_id, count(*) AS submitted, count(*) FILTER (ts <= TIMESTAMP '{AS_OF}') AS raw, count(*) FILTER (ts <= TIMESTAMP '{AS_OF}' AND pipeline_ok) AS ok FROM frames GROUP BY 1), u AS ({CLIENTS})
SELECT q.client_id, submitted - raw AS ca_ready, raw - ok // 10 * 10 AS ca_raw, ok - ok // 10 * 10 AS ca_processed, least(5, ok) AS rt_processed, rtmp_url FROM q LEFT JOIN u ON q.client_id = u.client_id""")
def queue_status(spark, d):
    return quality.queue_status(src.frames(spark, d), _addresses(spark, d), SEGMENT, LIVE, F.lit(AS_OF).cast("timestamp"))


@query("client_count", "SELECT count(DISTINCT client_id) AS total_clients FROM frames")
def client_count(spark, d):
    return src.frames(spark, d).agg(F.count_distinct("client_id").alias("total_clients"))


UPLOAD = """, u AS (SELECT client_id, count(*) FILTER (outcome <> 'encode_error') AS frames_sent, count(*) FILTER (outcome = 'success') AS frames_success, count(*) FILTER (outcome IN ('error', 'encode_error')) AS frames_error, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS elapsed_time FROM ulog GROUP BY 1)
SELECT *, CASE WHEN frames_sent = 0 THEN 0.0::DOUBLE ELSE frames_success::DOUBLE / frames_sent * 100 END AS success_rate, CASE WHEN elapsed_time > 0 THEN frames_sent / elapsed_time ELSE 0.0::DOUBLE END AS average_fps FROM u"""


@query("upload_stats", UPLOAD)
def upload_stats(spark, d):
    return quality.upload_stats(src.upload_log(spark, d))


@query("fps_sla", ", f AS (SELECT client_id, count(*) AS frames, greatest(1.0::DOUBLE, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS duration FROM frames GROUP BY 1) SELECT *, frames / duration AS avg_fps, frames / duration >= 0.8::DOUBLE * 0.00003::DOUBLE AS passed FROM f")
def fps_sla(spark, d):
    return quality.fps_sla(src.frames(spark, d), target=0.00003)


@query("processing_rate", "SELECT client_id, count(*) AS sent, count(*) FILTER (pipeline_ok) AS received, CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE (count(*) FILTER (pipeline_ok))::DOUBLE / count(*) * 100 END AS rate FROM frames GROUP BY 1")
def processing_rate(spark, d):
    f = src.frames(spark, d)
    return quality.processing_rate(f, f.where("pipeline_ok"))


@query("task_summary", "SELECT a.task_id, count(*) AS total_frames, count(*) FILTER (a.pipeline_ok) AS frames_with_result, max(c.stored_count) AS max_bending, round(avg(c.stored_count), 2) AS mean_bending FROM attached a LEFT JOIN counts c ON a.client_id = c.client_id AND a.frame_id = c.frame_id WHERE a.task_id IS NOT NULL GROUP BY 1")
def task_summary(spark, d):
    counted = results(spark, d)
    return quality.task_summary(counted.select("task_id", F.col("pipeline_ok").alias("has_result"), F.col("stored_count").alias("bending_count")))


@query("stage_failure_counts", """, m AS (SELECT 'motion' AS stage, task_id IS NOT NULL AND pipeline_ok AS ok, CASE WHEN NOT (task_id IS NOT NULL AND pipeline_ok) THEN 'Missing task or keypoints' END AS error FROM attached UNION ALL SELECT 'detection', pipeline_ok, CASE WHEN NOT pipeline_ok THEN 'pipeline failed' END FROM attached)
SELECT stage, error, count(*) FILTER (ok) AS n_success, count(*) FILTER (NOT ok) AS n_error FROM m GROUP BY 1, 2""")
def stage_failure_counts(spark, d):
    found = F.struct(F.col("pipeline_ok").alias("success"), F.when(~F.col("pipeline_ok"), "pipeline failed").alias("error"))
    return quality.stage_health(_motion(spark, d).withColumn("detection", found), ["motion", "detection"])


@query("rate_throttle", """, n AS (SELECT client_id, frame_id, first_value(frame_id) OVER (PARTITION BY client_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS next_id FROM frames),
kept AS (SELECT client_id, arg_min(frame_id, ts) AS frame_id FROM frames GROUP BY 1 UNION ALL SELECT n.client_id, n.next_id FROM kept k JOIN n ON k.client_id = n.client_id AND k.frame_id = n.frame_id WHERE n.next_id IS NOT NULL)
SELECT client_id, frame_id FROM kept""", base="WITH RECURSIVE")
def rate_throttle(spark, d):
    return frames.throttle(src.frames(spark, d), THROTTLE_S).select("client_id", "frame_id")


@query("segments", "SELECT id, client_id, task_id, kind, segment_no, n_frames, epoch_us(start_ts) AS start_us, epoch_us(end_ts) AS end_us, segment_path, playlist_path, keypoints_path FROM segs")
def segments(spark, d):
    return segs(spark, d).select("id", "client_id", "task_id", "kind", "segment_no", "n_frames", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "segment_path", "playlist_path", "keypoints_path")


@query("segment_frames", """, r AS (SELECT client_id, frame_id, pipeline_ok, row_number() OVER w AS a, CASE WHEN pipeline_ok THEN count(*) FILTER (pipeline_ok) OVER w END AS b FROM frames WINDOW w AS (PARTITION BY client_id ORDER BY ts, frame_id ROWS UNBOUNDED PRECEDING))
SELECT client_id, frame_id, (a - 1) // 10 AS raw_segment, (a - 1) % 10 AS raw_pos, (b - 1) // 10 AS ok_segment, (b - 1) % 10 AS ok_pos FROM r""")
def segment_frames(spark, d):
    return frames.assign_segments(src.frames(spark, d), SEGMENT).select("client_id", "frame_id", "raw_segment", "raw_pos", "ok_segment", "ok_pos")


@query("recent_results", "SELECT client_id, frame_id, no FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY ts DESC, frame_id DESC) AS no FROM frames WHERE pipeline_ok) WHERE no <= 5")
def recent_results(spark, d):
    return frames.recent(src.frames(spark, d), LIVE).select("client_id", "frame_id", "no")


@query("latest_result", "SELECT client_id, arg_max(frame_id, ts) AS frame_id, epoch_us(max(ts)) AS ts_us FROM frames WHERE pipeline_ok GROUP BY 1")
def latest_result(spark, d):
    return frames.latest(src.frames(spark, d)).select("client_id", "frame_id", us())


@query("running_bending", "SELECT client_id, frame_id, task_id, stored_count, after_count FROM counts")
def running_bending(spark, d):
    return results(spark, d).where("pipeline_ok").select("client_id", "frame_id", "task_id", "stored_count", "after_count")


@query("task_status_feed", """, b AS (SELECT client_id, date_trunc('day', min(ts)) AS t0, max(ts) AS t1 FROM frames GROUP BY 1), ticks AS (SELECT client_id, unnest(generate_series(t0, t1, INTERVAL 6 HOUR)) AS ts FROM b),
s AS (SELECT t.client_id, t.ts, m.command, m.task_id, m.ts AS mts FROM ticks t ASOF LEFT JOIN (SELECT * FROM judged WHERE accepted) m ON t.client_id = m.client_id AND t.ts >= m.ts),
x AS (SELECT s.*, c.task_id AS counted, c.after_count FROM s ASOF LEFT JOIN (SELECT * FROM counts WHERE task_id IS NOT NULL) c ON s.client_id = c.client_id AND s.ts >= c.ts)
SELECT client_id, epoch_us(ts) AS ts_us, CASE WHEN command IS NULL OR command = 'terminate' THEN '{"status":"no_active_task"}' ELSE '{"task_id":' || task_id || ',"status":"' || CASE command WHEN 'start' THEN 'running' ELSE 'initialized' END || '","cleaning_stage":"0","bending_count":' || CASE WHEN counted = task_id THEN after_count ELSE 0 END || ',"bubble_detected":false,"fully_submerged":false,"updated_at":"' || strftime(date_trunc('second', mts), '%Y-%m-%dT%H:%M:%S') || '"}' END AS message FROM x""")
def task_status_feed(spark, d):
    span = src.frames(spark, d).groupBy("client_id").agg(F.date_trunc("day", F.min("ts")).alias("t0"), F.max("ts").alias("t1"))
    ticks = span.select("client_id", F.explode(F.sequence("t0", "t1", F.expr("interval 6 hours"))).alias("ts"))
    return tasks.status_feed(ticks, src.commands(spark, d), with_bent(spark, d)).select("client_id", us(), "message")


@query("task_lifecycle", "SELECT * FROM tasks")
def task_lifecycle(spark, d):
    return tasks.fold_tasks(src.commands(spark, d))


@query("rejected_commands", "SELECT client_id, cmd_id, command, task_id FROM judged WHERE NOT accepted")
def rejected_commands(spark, d):
    return tasks.rejected_commands(src.commands(spark, d)).select("client_id", "cmd_id", "command", "task_id")


@query("progress_marks", """, p AS (SELECT *, row_number() OVER w AS n, count(*) FILTER (outcome = 'success') OVER w AS ok, count(*) FILTER (outcome = 'error') OVER w AS bad, min(ts) OVER w AS began FROM ulog WHERE outcome <> 'encode_error' WINDOW w AS (PARTITION BY client_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))
SELECT client_id, n AS frames_sent, ok AS frames_success, bad AS frames_error, CASE WHEN ts > began THEN n / ((epoch_us(ts) - epoch_us(began)) / 1e6) ELSE 0.0::DOUBLE END AS fps FROM p WHERE n % 30 = 0""")
def progress_marks(spark, d):
    return quality.progress(src.upload_log(spark, d))


@query("trajectory", """, t AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts, frame_id) - 1 AS index, count(*) OVER (PARTITION BY task_id) AS total FROM kp WHERE task_id IS NOT NULL)
SELECT task_id, index, x, y, index / total AS alpha FROM t WHERE x IS NOT NULL""")
def trajectory(spark, d):
    return quality.trajectory(records(spark, d))


@query("traceback_segments", f"SELECT task_id, row_number() OVER w AS no, id AS segment_id, segment_path, {ISO.format('start_ts')} AS start_time, {ISO.format('end_ts')} AS end_time, client_id, keypoints_path, count(*) OVER (PARTITION BY task_id) AS total_segments, first_value(playlist_path) OVER w AS playlist_path FROM segs WHERE kind = 'processed' AND task_id IS NOT NULL WINDOW w AS (PARTITION BY task_id ORDER BY start_ts, id)")
def traceback_segments(spark, d):
    return history.traceback_segments(segs(spark, d))


@query("traceback_playlist", "SELECT task_id, regexp_replace(arg_min(playlist_path, start_ts), '[^/]+$', 'raw_playlist.m3u8') AS playlist_path FROM segs WHERE task_id IS NOT NULL GROUP BY 1")
def traceback_playlist(spark, d):
    return history.traceback_playlist(segs(spark, d), "raw")


@query("task_playlist_path", "SELECT task_id, playlist_path FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY start_ts, id) AS r FROM segs WHERE task_id IS NOT NULL) WHERE r = 1")
def task_playlist_path(spark, d):
    return history.first_playlist(segs(spark, d))


ONE = "(SELECT * FROM segs WHERE kind = 'processed' AND task_id IS NOT NULL ORDER BY id LIMIT 1)"


def _one(spark, d):
    return segs(spark, d).where("kind = 'processed' and task_id is not null").agg(F.min(F.struct("id", "task_id")).alias("x")).first()["x"]


@query("segment_lookup", f"SELECT id AS segment_id, task_id, segment_path, split_part(segment_path, '/', 4) AS file_name FROM {ONE}")
def segment_lookup(spark, d):
    one = _one(spark, d)
    return history.segment_lookup(segs(spark, d), one["task_id"], one["id"])


@query("segment_keypoints", f"SELECT k.frame_id, k.pos, k.x, k.y FROM kp k JOIN {ONE} s ON k.client_id = s.client_id AND k.segment_start_us = epoch_us(s.start_ts)")
def segment_keypoints(spark, d):
    one = _one(spark, d)
    return history.segment_keypoints(segs(spark, d), records(spark, d), one["task_id"], one["id"]).select("frame_id", "pos", "x", "y")


@query("all_keypoints", """, a AS (SELECT k.*, s.id AS segment_id FROM kp k JOIN segs s ON s.kind = 'processed' AND s.client_id = k.client_id AND epoch_us(s.start_ts) = k.segment_start_us WHERE s.task_id IS NOT NULL)
SELECT task_id, segment_id, frame_id, pos, row_number() OVER (PARTITION BY task_id ORDER BY segment_start_us, segment_id, pos) AS frame_no, count(*) OVER (PARTITION BY task_id) AS total_frames, x, y FROM a""")
def all_keypoints(spark, d):
    return history.all_keypoints(records(spark, d)).select("task_id", "segment_id", "frame_id", "pos", "frame_no", "total_frames", "x", "y")
