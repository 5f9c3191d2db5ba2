"""Queries that apply the operators to the given tables, with thresholds that
reach every branch there, and SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlore.functions import text as T
from sessionlore.operators import audit, notes, packets, registry, search, sessions, summaries, transcripts
from sessionlore.sources.packets import archives_of, packets_of
from sessionlore.sources.shared import new_path
from sessionlore.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

WS = T.WHITE_SPACE
GAP_US, MIN_US, LOSS_LIMIT = 6 * 3600 * 1_000_000, 40_000, 100
AS_OF = "2024-06-01 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _second(c) -> F.Column:
    return F.timestamp_seconds(c)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), F.lit("").alias("character_name"), F.col("role").alias("display_name"),
        _second("turn").alias("started_at"), F.concat(F.lit("p"), F.col("turn").cast("string")).alias("audio_path"), F.col("text").alias("transcript_text"),
    )


# ---- transcripts -----------------------------------------------------------
@query(f"""
SELECT conv_id AS session_id,
       '# Transcript' || coalesce(chr(10) || chr(10) || string_agg(role || ': ' || t, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE t <> ''), '') || chr(10) AS markdown
FROM (SELECT conv_id, turn, role, trim(text, '{WS}') AS t FROM conversations) GROUP BY conv_id
""")
def transcript_markdown(spark, sf_dir):
    rows = _segments(spark, sf_dir)
    return transcripts.transcripts(rows.select("session_id"), rows)


@query(f"""
SELECT conv_id AS clip, trim(string_agg(trim(text, '{WS}'), ' ' ORDER BY turn), '{WS}') AS text FROM conversations GROUP BY conv_id
""")
def clip_text(spark, sf_dir):
    return transcripts.clip_texts(read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("clip"), F.col("turn").alias("pos"), "text"))


@query(f"""
WITH RECURSIVE d AS (SELECT doc_id, '# Transcript' || chr(10) || chr(10) || text AS text FROM documents),
l AS (SELECT doc_id, string_split_regex(text, '{T.LINE_END}') AS lines FROM d WHERE length(text) > 3000),
b AS (SELECT doc_id, CASE WHEN len(x) > 2 THEN x[3:] ELSE x END AS lines FROM (SELECT doc_id, CASE WHEN lines[-1] = '' THEN lines[:-2] ELSE lines END AS x FROM l)),
n AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM b),
g AS (SELECT doc_id, i, 0 AS chunk_no, length(line) + 1 AS size FROM n WHERE i = 1
      UNION ALL SELECT n.doc_id, n.i, CASE WHEN g.size + length(n.line) + 1 > 1500 THEN g.chunk_no + 1 ELSE g.chunk_no END,
                       CASE WHEN g.size + length(n.line) + 1 > 1500 THEN length(n.line) + 1 ELSE g.size + length(n.line) + 1 END FROM g JOIN n ON n.doc_id = g.doc_id AND n.i = g.i + 1)
SELECT doc_id, 0::BIGINT AS chunk_no, text FROM d WHERE length(text) <= 3000
UNION ALL SELECT g.doc_id, chunk_no::BIGINT, '# Transcript' || chr(10) || chr(10) || trim(string_agg(line, chr(10) ORDER BY g.i), '{WS}') || chr(10) FROM g JOIN n ON n.doc_id = g.doc_id AND n.i = g.i GROUP BY g.doc_id, chunk_no
""")
def transcript_chunks(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    chunks = T.transcript_chunks(F.concat(F.lit("# Transcript\n\n"), "text"), 3000, 1500)
    return docs.select("doc_id", F.posexplode(chunks).alias("chunk_no", "text")).withColumn("chunk_no", F.col("chunk_no").cast("long"))


@query(f"""
WITH RECURSIVE p AS (
  SELECT doc_id, 0 AS k, NULL::VARCHAR AS piece, trim(text, '{WS}') AS rest FROM documents WHERE length(text) > 1900
  UNION ALL SELECT doc_id, k + 1, CASE WHEN length(rest) <= 1900 THEN rest ELSE trim(left(rest, cut), '{WS}') END, CASE WHEN length(rest) <= 1900 THEN '' ELSE ltrim(substr(rest, cut + 1), '{WS}') END
  FROM (SELECT *, CASE WHEN two > 0 THEN 1900 - two - 1 WHEN one > 0 THEN 1900 - one ELSE 1900 END AS cut FROM (
    SELECT *, strpos(reverse(left(rest, 1900)), chr(10) || chr(10)) AS two, strpos(reverse(left(rest, 1900)), chr(10)) AS one FROM p WHERE rest <> '')))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::BIGINT AS piece_no, piece AS text FROM p WHERE k > 0 AND piece <> ''
UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 1900
""")
def message_pieces(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.message_pieces("text")).alias("piece_no", "text"))
    return rows.withColumn("piece_no", F.col("piece_no").cast("long"))


@query(f"""
SELECT conv_id AS session_id, CASE WHEN conv_id % 2 = 0 THEN 'audio' ELSE 'text' END AS mode, count(*)::BIGINT AS n_segments,
       CASE WHEN conv_id % 2 = 0 THEN sum((turn % 2 = 1)::INT) ELSE sum((role = 'user' AND trim(text, '{WS}') <> '')::INT) END::BIGINT AS n_done,
       CASE WHEN conv_id % 2 = 0 THEN count(*) - sum((turn % 2 = 1)::INT) ELSE 0 END::BIGINT AS n_skipped,
       CASE WHEN CASE WHEN conv_id % 2 = 0 THEN sum((turn % 2 = 1)::INT) ELSE sum((role = 'user' AND trim(text, '{WS}') <> '')::INT) END = 0 THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN conv_id % 2 = 0 AND sum((turn % 2 = 1)::INT) = 0 THEN '{sessions.NONE_TRANSCRIBED}'
            WHEN conv_id % 2 = 1 AND sum((role = 'user' AND trim(text, '{WS}') <> '')::INT) = 0 THEN '{sessions.NO_TEXT}' END AS error
FROM conversations GROUP BY conv_id
""")
def session_outcome(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id")
    segments = rows.select("session_id", (F.col("turn") % 2 == 1).alias("decodable"), F.when(F.col("role") == "user", F.col("text")).alias("transcript_text"))
    wanted = rows.select("session_id", F.when(F.col("session_id") % 2 == 0, "audio").otherwise("text").alias("mode")).distinct()
    return sessions.outcomes(wanted, segments)


@query("""
SELECT conv_id AS session_id, turn AS id, CASE WHEN role = 'assistant' THEN reverse(text) ELSE text END AS transcript_text FROM conversations
""")
def apply_transcripts(spark, sf_dir):
    rows = _segments(spark, sf_dir)
    results = rows.where("display_name = 'assistant'").select("session_id", "audio_path", F.reverse("transcript_text").alias("transcript_text"), F.col("id").alias("seq"))
    return sessions.apply_transcripts(rows, results).select("session_id", "id", "transcript_text")


# ---- packets ---------------------------------------------------------------
_BURSTS = f"""
SELECT user_id, burst, min(us) AS started_us, max(us) AS ended_us, count(*)::BIGINT AS n_packets, round(count(*)::DOUBLE * 0.02::DOUBLE, 6) AS duration_s FROM (
  SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS burst FROM (
    SELECT user_id, event_id, epoch_us(ts) AS us,
           coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= {GAP_US})::INT, 0) AS new FROM events))
GROUP BY user_id, burst HAVING count(*) * 20000 >= {MIN_US}
"""


@query(_BURSTS)
def speech_segments(spark, sf_dir):
    rows = packets.speech_segments(_events(spark, sf_dir), ["user_id"], GAP_US, MIN_US, at="ts", order="event_id")
    return rows.select("user_id", "burst", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), "n_packets", F.round("duration_s", 6).alias("duration_s"))


@query(f"""
SELECT user_id % 10 AS session_id, user_id, burst, kind AS first_type, n::BIGINT AS n_packets, forced FROM (
  SELECT *, burst = max(burst) OVER (PARTITION BY user_id) AND end_us - ended_us < {GAP_US} AS forced FROM (
    SELECT user_id, burst, max(us) AS ended_us, count(*) AS n, arg_min(event_type, (us, event_id)) AS kind FROM (
      SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS burst FROM (
        SELECT user_id, event_id, event_type, epoch_us(ts) AS us, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= {GAP_US})::INT, 0) AS new FROM events)) GROUP BY user_id, burst) b
  JOIN (SELECT user_id % 10 AS s, max(epoch_us(ts)) AS end_us FROM events GROUP BY 1) e ON e.s = b.user_id % 10) WHERE forced OR n * 20000 >= {MIN_US}
""")
def named_segments(spark, sf_dir):
    """Bursts with the type of their first event; each session ends with its last event."""
    rows = _events(spark, sf_dir).withColumn("session_id", F.col("user_id") % 10)
    ends = rows.groupBy("session_id").agg(F.max("ts").alias("end_at"))
    found = packets.speech_segments(rows, ["session_id", "user_id"], GAP_US, MIN_US, session_end=ends, names=("event_type",), at="ts", order="event_id")
    return found.select("session_id", "user_id", "burst", F.col("event_type").alias("first_type"), "n_packets", "forced")


@query(f"""
SELECT user_id, count(*)::BIGINT AS n_packets, sum(CASE WHEN gap BETWEEN 1 AND {LOSS_LIMIT} THEN gap ELSE 0 END)::BIGINT AS concealed,
       sum((event_type = 'error')::INT)::BIGINT AS corrupt, (count(*) + sum(CASE WHEN gap BETWEEN 1 AND {LOSS_LIMIT} THEN gap ELSE 0 END))::BIGINT AS frames
FROM (SELECT user_id, event_type, ((event_id % 65536 - lag(event_id % 65536) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 65536 + 65536) % 65536 AS gap FROM events)
GROUP BY user_id
""")
def packet_loss(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", (F.col("event_id") % 65536).alias("sequence"), F.struct("ts", "event_id").alias("at"), (F.col("event_type") == "error").alias("corrupt"))
    return packets.loss_profile(rows, ["user_id"], LOSS_LIMIT, order="at", corrupt="corrupt")


def _outcomes(rows: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "none").otherwise("data")
    return rows.select("event_id", "user_id", "ts", kind.alias("outcome"))


_QUARANTINE = """
SELECT event_id, user_id, CASE WHEN outcome = 'error' THEN (k - 1) % 3 + 1 ELSE 0 END::BIGINT AS failures,
       CASE WHEN outcome = 'data' THEN 'pass' WHEN outcome = 'error' AND k % 3 = 0 THEN 'quarantine' WHEN outcome = 'error' THEN 'drop' END AS action
FROM (SELECT *, sum((outcome = 'error')::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (
  SELECT *, sum((outcome = 'data')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'none' ELSE 'data' END AS outcome FROM events)))
"""


@query(_QUARANTINE)
def failure_quarantine(spark, sf_dir):
    rows = packets.quarantine(_outcomes(_events(spark, sf_dir)), ["user_id"], ["ts", "event_id"])
    return rows.select("event_id", "user_id", F.col("failures").cast("long").alias("failures"), "action")


@query(f"""
SELECT 'u' || user_id || '/' || burst AS path, (row_number() OVER (PARTITION BY user_id, burst ORDER BY event_id) - 1)::BIGINT AS packet_no, (event_id % 65536)::BIGINT AS sequence,
       (event_id % 1000003)::BIGINT AS timestamp, props AS payload FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS burst FROM (
    SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= {GAP_US})::INT, 0) AS new FROM events))
""")
def packet_archive_roundtrip(spark, sf_dir):
    """An archive for each burst of a user."""
    bursts = packets.with_bursts(_events(spark, sf_dir), ["user_id"], GAP_US, at="ts", order="event_id")
    rows = bursts.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), F.col("burst").cast("string")).alias("path"), F.col("event_id").alias("arrival_no"), (F.col("event_id") % 65536).alias("sequence"),
        (F.col("event_id") % 1000003).alias("timestamp"), F.col("props").cast("binary").alias("payload"),
    )
    return packets_of(archives_of(rows)).select("path", F.col("packet_no").cast("long").alias("packet_no"), F.col("sequence").cast("long").alias("sequence"), "timestamp", F.col("payload").cast("string").alias("payload"))


# ---- names -----------------------------------------------------------------
@query("""
SELECT c.event_id, c.user_id, coalesce(u.name, 'user ' || c.user_id) AS character_name
FROM (SELECT * FROM events WHERE event_type = 'click') c
LEFT JOIN LATERAL (SELECT 'name ' || s.event_id AS name FROM events s WHERE s.event_type = 'signup' AND s.user_id = c.user_id AND s.ts <= c.ts ORDER BY s.ts DESC, s.event_id DESC LIMIT 1) u ON true
""")
def name_asof(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("guild_id", F.lit(1))
    updates = rows.where("event_type = 'signup'").select("guild_id", "user_id", F.concat(F.lit("name "), F.col("event_id").cast("string")).alias("character_name"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"))
    starts = rows.where("event_type = 'click'").select("guild_id", "user_id", "event_id", F.col("ts").alias("started_at"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("fallback"))
    return registry.with_names_as_of(starts, updates, "fallback").select("event_id", "user_id", "character_name")


@query("""
SELECT o_orderkey, name AS character_name, CASE WHEN name = '' THEN fallback ELSE name END AS speaker FROM (
  SELECT o_orderkey, 'customer ' || o_custkey AS fallback,
         CASE WHEN c_custkey IS NULL THEN 'customer ' || o_custkey WHEN c_custkey % 7 = 0 THEN '' ELSE trim(c_name) END AS name
  FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = o_custkey)
""")
def name_lookup(spark, sf_dir):
    updates = read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.lit(1).cast("long").alias("guild_id"), F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 7 == 0, " ").otherwise(F.col("c_name")).alias("character_name"), _second("c_custkey").alias("updated_at"), F.col("c_custkey").alias("seq"))
    known = registry.register(updates.drop("seq").limit(0), updates)
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).cast("long").alias("guild_id"), F.col("o_custkey").alias("user_id"), T.display_label(F.lit(""), F.concat(F.lit("customer "), F.col("o_custkey").cast("string")), "o_custkey").alias("fallback"))
    return registry.with_names(rows, known, "fallback").select("o_orderkey", "character_name", T.speaker_label("character_name", "fallback").alias("speaker"))


@query(f"""
SELECT doc_id, s AS safe_name, (doc_id * 1000) || '_' || doc_id || '_' || s || '.skopus' AS archive, CASE WHEN length(p) > 110 THEN left(p, 107) || '...' ELSE p END AS preview
FROM (SELECT doc_id, coalesce(nullif(trim(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '_', 'g'), '_'), ''), 'speaker') AS s, trim(regexp_replace(text, '[{WS}]+', ' ', 'g'), '{WS}') AS p FROM documents)
""")
def safe_names(spark, sf_dir):
    """Whole texts as names of speakers, as file names and as previews."""
    return read(spark, sf_dir, "documents").select("doc_id", T.safe_name("text").alias("safe_name"), T.archive_name(_second("doc_id"), "doc_id", "text").alias("archive"), T.preview("text").alias("preview"))


# ---- sessions --------------------------------------------------------------
def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = F.lit(None).cast("string")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("guild_id"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("timestamp").alias("ended_at"), null.alias("transcript_path"), null.alias("summary_path"))


@query("SELECT o_custkey AS guild_id, max(o_orderkey) AS id, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
def latest_session(spark, sf_dir):
    return sessions.latest(_orders(spark, sf_dir)).select("guild_id", "id", "status")


@query("""
WITH e AS (SELECT event_id % 5000 AS sid, event_id, ts, event_type,
             row_number() OVER (PARTITION BY event_id % 5000 ORDER BY ts DESC, event_id DESC) AS r_any,
             row_number() OVER (PARTITION BY event_id % 5000, event_type = 'purchase' ORDER BY ts DESC, event_id DESC) AS r_fin,
             row_number() OVER (PARTITION BY event_id % 5000, event_type IN ('purchase', 'click') ORDER BY ts DESC, event_id DESC) AS r_tr,
             row_number() OVER (PARTITION BY event_id % 5000, event_type IN ('purchase', 'click', 'view') ORDER BY ts DESC, event_id DESC) AS r_su FROM events)
SELECT o.o_orderkey AS id,
  CASE WHEN a.sid IS NULL THEN o.o_orderstatus WHEN a.event_type = 'purchase' THEN 'completed' WHEN a.event_type IN ('click', 'view') THEN 'processing' WHEN a.event_type = 'error' THEN 'failed' ELSE 'recording' END AS status,
  epoch_us(f.ts) AS ended_us,
  CASE WHEN t.event_type = 'purchase' THEN 't' || t.event_id END AS transcript_path, CASE WHEN s.event_type = 'purchase' THEN 's' || s.event_id END AS summary_path
FROM orders o LEFT JOIN e a ON a.sid = o.o_orderkey AND a.r_any = 1
LEFT JOIN e f ON f.sid = o.o_orderkey AND f.r_fin = 1 AND f.event_type = 'purchase'
LEFT JOIN e t ON t.sid = o.o_orderkey AND t.r_tr = 1 AND t.event_type IN ('purchase', 'click')
LEFT JOIN e s ON s.sid = o.o_orderkey AND s.r_su = 1 AND s.event_type IN ('purchase', 'click', 'view')
""")
def session_updates(spark, sf_dir):
    kind = F.col("event_type")
    event = F.when(kind == "purchase", "finalize").when(kind == "click", "reset_audio").when(kind == "view", "reset_text").otherwise("status")
    changes = _events(spark, sf_dir).select(
        (F.col("event_id") % 5000).alias("session_id"), event.alias("event"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        F.when(kind == "error", "failed").otherwise("recording").alias("status"),
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("transcript_path"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("summary_path"),
    )
    return sessions.updated(_orders(spark, sf_dir), changes).select("id", "status", F.unix_micros("ended_at").alias("ended_us"), "transcript_path", "summary_path")


@query(f"""
SELECT c_custkey AS guild_id, CASE WHEN event_id IS NULL THEN '{sessions.NO_STATUS}' ELSE
  CASE WHEN event_id % 3 = 0 THEN 'Session' ELSE 'Session #' || (event_id % 3) END || ' status: ' || event_type || CASE WHEN event_id % 2 = 0 THEN '. message ' || event_id ELSE '.' END END AS status_text
FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) e ON e.user_id = c_custkey AND r = 1
""")
def session_status(spark, sf_dir):
    states = _events(spark, sf_dir).select(F.col("user_id").alias("guild_id"), F.col("event_type").alias("state"), (F.col("event_id") % 3).alias("session_id"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("message "), F.col("event_id").cast("string"))).otherwise("").alias("message"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"))
    return sessions.status_texts(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("guild_id")), states)


@query(f"""
SELECT r.g AS request_id, r.g AS guild_id, CASE WHEN error IS NULL THEN wanted END AS resolved_id, error FROM (
  SELECT r.g, wanted, CASE WHEN r.g % 11 = 0 THEN '{sessions.BUSY_RECORDING}' WHEN r.g % 13 = 0 THEN '{sessions.BUSY_PROCESSING}' WHEN s.o_orderkey IS NULL THEN '{sessions.NO_SESSION}'
         WHEN s.o_custkey <> r.g THEN '{sessions.OTHER_SERVER}' WHEN wanted % 5 = 0 THEN 'Session #' || wanted || ' has no recorded audio directory to reprocess.' END AS error
  FROM (SELECT c_custkey AS g, coalesce(CASE WHEN c_custkey % 4 = 1 THEN c_custkey WHEN c_custkey % 4 = 2 THEN -1 END, latest) AS wanted
        FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS latest FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey) r
  LEFT JOIN orders s ON s.o_orderkey = r.wanted) r
""")
def reprocess_resolution(spark, sf_dir):
    key = F.col("c_custkey")
    customers = read(spark, sf_dir, "customer")
    requests = customers.select(key.alias("request_id"), key.alias("guild_id"), F.when(key % 4 == 1, key).when(key % 4 == 2, -1).cast("long").alias("session_id"))
    active = customers.select(key.alias("guild_id"), F.when(key % 11 == 0, "recording").when(key % 13 == 0, "processing").alias("state")).where("state is not null")
    with_audio = read(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("session_id"))
    return sessions.resolved_requests(requests, _orders(spark, sf_dir), active, with_audio)


# ---- notes -----------------------------------------------------------------
def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.substring("source", 4, 10).cast("long").alias("guild_id"), F.col("lang").alias("note_type"), F.split("text", " ")[0].alias("title"), F.col("text").alias("content"),
        F.lit(None).cast("long").alias("source_session_id"), F.lit("{}").alias("metadata_json"), _second(F.col("doc_id")).alias("created_at"), _second(F.col("doc_id") * 7919 % 1000).alias("updated_at"),
    )


_N = "(SELECT doc_id AS id, substr(source, 4)::BIGINT AS guild_id, lang AS note_type, split_part(text, ' ', 1) AS title, text AS content, doc_id * 7919 % 1000 AS u FROM documents)"


@query(f"""
WITH n AS (SELECT id, guild_id, note_type, trim(title, '{WS}') AS title, trim(content, '{WS}') AS content FROM {_N}),
old AS (SELECT max(id) AS id, guild_id, note_type, title, arg_max(content, id) AS content FROM n WHERE id % 2 = 0 GROUP BY guild_id, note_type, title),
batch AS (SELECT max(id) AS last_id, min(id) AS first_id, guild_id, note_type, title, arg_max(content, id) AS content FROM n WHERE id % 2 = 1 AND title <> '' AND content <> '' GROUP BY guild_id, note_type, title),
fresh AS (SELECT b.guild_id, b.note_type, b.title, (SELECT max(id) FROM old) + row_number() OVER (ORDER BY first_id) AS id
          FROM batch b LEFT JOIN old o ON o.guild_id = b.guild_id AND o.note_type = b.note_type AND o.title = b.title WHERE o.id IS NULL)
SELECT coalesce(o.id, f.id)::BIGINT AS id, coalesce(o.guild_id, b.guild_id) AS guild_id, coalesce(o.note_type, b.note_type) AS note_type, coalesce(o.title, b.title) AS title,
       coalesce(b.content, o.content) AS content, b.last_id AS source_session_id, b.last_id IS NOT NULL AS touched
FROM old o FULL JOIN batch b ON o.guild_id = b.guild_id AND o.note_type = b.note_type AND o.title = b.title
LEFT JOIN fresh f ON f.guild_id = b.guild_id AND f.note_type = b.note_type AND f.title = b.title
""")
def notes_upsert(spark, sf_dir):
    rows = _notes(spark, sf_dir).withColumn("title", T.strip("title")).withColumn("content", T.strip("content"))
    from sessionlore.operators.upserts import last_per_key

    old = last_per_key(rows.where("id % 2 = 0"), notes.KEYS, ["id"])
    batch = rows.where("id % 2 = 1").select(*notes.KEYS, "content", F.col("id").alias("source_session_id"), "metadata_json", F.col("id").alias("seq"))
    as_of = F.lit(AS_OF).cast("timestamp")
    return notes.upsert(old, batch, as_of).select("id", *notes.KEYS, "content", "source_session_id", (F.col("updated_at") == as_of).alias("touched"))


@query(f"SELECT guild_id, id, rank::BIGINT AS rank FROM (SELECT guild_id, id, row_number() OVER (PARTITION BY guild_id ORDER BY u DESC, id DESC) AS rank FROM {_N}) WHERE rank <= 20")
def recent_notes(spark, sf_dir):
    return notes.recent(_notes(spark, sf_dir), 20).select("guild_id", "id", F.col("rank").cast("long").alias("rank"))


# All guilds, and one without notes.
_GUILDS = "(SELECT DISTINCT guild_id FROM " + _N + " UNION ALL SELECT -1)"


def _guilds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).select("guild_id").distinct().unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("guild_id")))


@query(f"""
SELECT g.guild_id, coalesce('{notes.LIST_HEADING}' || chr(10) || chr(10) || string_agg('- #' || id || ' [' || note_type || '] ' || title || ': ' || CASE WHEN length(p) > 110 THEN left(p, 107) || '...' ELSE p END, chr(10) ORDER BY rank), '{notes.NO_NOTES}') AS listing
FROM {_GUILDS} g LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY guild_id ORDER BY u DESC, id DESC) AS rank, trim(regexp_replace(content, '[{WS}]+', ' ', 'g'), '{WS}') AS p FROM {_N}) n ON n.guild_id = g.guild_id AND rank <= 25
GROUP BY g.guild_id
""")
def notes_listing(spark, sf_dir):
    return notes.listing(_guilds(spark, sf_dir), _notes(spark, sf_dir))


@query(f"""
SELECT g.guild_id, rtrim('{notes.SNAPSHOT_HEADING}' || coalesce(chr(10) || chr(10) || string_agg('## [' || note_type || '] ' || title || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY rank), ''), '{WS}') || chr(10) AS markdown
FROM {_GUILDS} g LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY guild_id ORDER BY u DESC, id DESC) AS rank FROM {_N}) n ON n.guild_id = g.guild_id AND rank <= 200
GROUP BY g.guild_id
""")
def notes_snapshot(spark, sf_dir):
    return notes.snapshots(_guilds(spark, sf_dir), _notes(spark, sf_dir))


@query(f"""
SELECT g.guild_id, coalesce(string_agg('[' || note_type || '] ' || title || chr(10) || content, chr(10) || chr(10) ORDER BY rank), '{notes.NO_PRIOR_NOTES}') AS context
FROM {_GUILDS} g LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY guild_id ORDER BY u DESC, id DESC) AS rank FROM {_N}) n ON n.guild_id = g.guild_id AND rank <= 200
GROUP BY g.guild_id
""")
def prior_notes_context(spark, sf_dir):
    return notes.prior_contexts(_guilds(spark, sf_dir), _notes(spark, sf_dir))


@query(f"""
SELECT guild_id AS session_id, first_seq AS seq, note_type, title, content FROM (
  SELECT guild_id, note_type, title, content, min(id) OVER (PARTITION BY guild_id, lower(note_type), lower(title)) AS first_seq,
         row_number() OVER (PARTITION BY guild_id, lower(note_type), lower(title) ORDER BY length(content) DESC, id) AS r
  FROM (SELECT id, guild_id, note_type, trim(title, '{WS}') AS title, trim(content, '{WS}') AS content FROM {_N}) WHERE title <> '' AND content <> '') WHERE r = 1
""")
def note_merge(spark, sf_dir):
    rows = _notes(spark, sf_dir).select(F.col("guild_id").alias("session_id"), F.col("id").alias("seq"), "note_type", "title", "content", F.lit("{}").alias("metadata"))
    return summaries.merged_updates(rows).drop("metadata")


def _corrections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Notes and rejected corrections after one for each label, some blank and
    some from a server that has no such note."""
    rows = _notes(spark, sf_dir).withColumn("metadata_json", F.when(F.col("id") % 3 == 0, "[1]").when(F.col("id") % 3 == 1, '{"corrected_by_user_id": 9, "k": [1]}').otherwise("{broken"))
    owner = rows.select(F.col("id").alias("doc_id"), F.when(F.col("guild_id") % 7 == 3, -1).otherwise(F.col("guild_id")).alias("guild_id"))
    given = read(spark, sf_dir, "labels").join(owner, "doc_id").select("guild_id", F.col("doc_id").alias("note_id"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.concat(F.lit(" corrected "), F.col("doc_id").cast("string"))).alias("content"), F.col("quality").cast("long").alias("user_id"), F.col("doc_id").alias("seq"))
    return notes.corrected(rows, given, F.lit(AS_OF).cast("timestamp"))


@query(f"""
WITH c AS (SELECT doc_id, quality, toxic, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'corrected ' || doc_id END AS content FROM labels)
SELECT n.id, CASE WHEN c.content <> '' THEN c.content ELSE n.content END AS content, coalesce(c.content <> '', false) AS corrected, CASE WHEN c.content <> '' THEN quality::BIGINT END AS corrected_by
FROM {_N} n LEFT JOIN c ON c.doc_id = n.id AND n.guild_id % 7 <> 3
""")
def note_corrections(spark, sf_dir):
    done, _ = _corrections(spark, sf_dir)
    part = lambda name, kind: F.try_variant_get(F.try_parse_json("metadata_json"), f"$.{name}", kind)
    was = F.coalesce(part("manually_corrected", "boolean"), F.lit(False))
    return done.select("id", "content", was.alias("corrected"), F.when(was, part("corrected_by_user_id", "long")).alias("corrected_by"))


@query(f"""
SELECT doc_id AS note_id, CASE WHEN doc_id % 5 = 0 THEN '{notes.BLANK_CORRECTION}' ELSE 'Could not find note #' || doc_id || ' in this server.' END AS error
FROM labels l JOIN {_N} n ON n.id = l.doc_id WHERE doc_id % 5 = 0 OR guild_id % 7 = 3
""")
def note_rejections(spark, sf_dir):
    return _corrections(spark, sf_dir)[1].select("note_id", "error")


# ---- search ----------------------------------------------------------------
def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = read(spark, sf_dir, "embeddings")
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("note_type"), F.col("source").alias("title"), F.col("text").alias("content"))
    notes_ = search.with_vectors(rows, vectors.select(F.col("vec_id").alias("note_id"), "embedding")).join(vectors.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("guild_id")), "id")
    questions = vectors.where("vec_id % 40 = 0").select(F.col("vec_id").alias("question_id"), F.col("label").cast("long").alias("guild_id"), "embedding")
    # The same questions in a server without notes.
    questions = questions.unionByName(questions.select((-1 - F.col("question_id")).alias("question_id"), F.lit(-1).cast("long").alias("guild_id"), "embedding"))
    return questions, notes_


_TOP = """
SELECT question_id, note_id, score, rank::BIGINT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, note_id) AS rank FROM (
    SELECT q.vec_id AS question_id, n.vec_id AS note_id, round(list_dot_product(q.embedding::DOUBLE[], n.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(n.embedding::DOUBLE[], n.embedding::DOUBLE[]))), 6) AS score
    FROM embeddings q JOIN embeddings n ON q.label = n.label JOIN documents d ON d.doc_id = n.vec_id WHERE q.vec_id % 40 = 0)) WHERE rank <= 8
"""


@query(_TOP)
def semantic_topk(spark, sf_dir):
    questions, rows = _vectors(spark, sf_dir)
    return search.top_notes(questions, rows.select("guild_id", "id", "embedding"), digits=6).select("question_id", "note_id", "score", F.col("rank").cast("long").alias("rank"))


@query(_TOP)
def semantic_topk_batch(spark, sf_dir):
    questions, rows = _vectors(spark, sf_dir)
    return search.top_notes_batch(questions, rows.select("guild_id", "id", "embedding"), digits=6).select("question_id", "note_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""
SELECT question_id, string_agg('[' || lang || '] ' || source || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
FROM ({_TOP}) t JOIN documents d ON d.doc_id = t.note_id GROUP BY question_id
UNION ALL SELECT -1 - vec_id, '{T.NO_NOTES_ANSWER}' FROM embeddings WHERE vec_id % 40 = 0
""")
def retrieval_context(spark, sf_dir):
    questions, rows = _vectors(spark, sf_dir)
    return search.contexts(questions, rows, digits=6)


# ---- responses -------------------------------------------------------------
def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    update = F.struct(F.col("role").alias("note_type"), F.concat(F.lit(" turn "), F.col("turn").cast("string")).alias("title"), F.col("text").alias("content"), F.lit(1).alias("metadata"))
    value = F.struct(F.col("text").alias("session_notes_markdown"), F.when(F.col("turn") % 3 == 1, "N/A").otherwise(F.col("text")).alias("cinematic_summary_markdown"), F.array(update, F.struct(F.col("role").alias("note_type"), F.lit("").alias("title"), F.lit("x").alias("content"), F.lit(2).alias("metadata"))).alias("note_updates"))
    raw = F.when(F.col("turn") % 5 == 4, "{broken").otherwise(F.to_json(value))
    return rows.select(F.col("conv_id").alias("session_id"), F.lit("single").alias("stage"), F.lit(0).alias("chunk_no"), (F.col("turn") + 1).alias("attempt"), raw.alias("raw"), F.lit(None).cast("string").alias("error"))


@query(f"""
SELECT conv_id AS session_id, (turn + 1)::BIGINT AS attempt, turn % 5 <> 4 AS parsed, turn % 5 <> 4 AND turn % 3 <> 1 AND length(trim(text, '{WS}')) >= 80 AS has_content,
       CASE WHEN turn % 5 = 4 THEN NULL WHEN trim(text, '{WS}') = '' THEN 0 ELSE 1 END::BIGINT AS n_updates FROM conversations
""")
def response_gate(spark, sf_dir):
    from sessionlore.functions.responses import has_content, normalized

    rows = _responses(spark, sf_dir).withColumn("payload", normalized("raw"))
    return rows.select("session_id", F.col("attempt").cast("long").alias("attempt"), F.col("payload").isNotNull().alias("parsed"), has_content(F.col("payload")).alias("has_content"), F.when(F.col("payload").isNotNull(), F.size("payload.note_updates")).cast("long").alias("n_updates"))


@query(f"""
WITH r AS (SELECT conv_id, turn + 1 AS attempt, turn % 5 = 4 AS broken, turn % 5 <> 4 AND turn % 3 <> 1 AND length(trim(text, '{WS}')) >= 80 AS ok, trim(text, '{WS}') AS t FROM conversations WHERE turn + 1 <= 3)
SELECT conv_id AS session_id, (min(attempt) FILTER (WHERE ok))::BIGINT AS attempt, arg_min(t, attempt) FILTER (WHERE ok) AS notes,
       CASE WHEN NOT bool_or(ok) THEN CASE WHEN bool_or(broken) THEN '{summaries.RAISED}' ELSE '{summaries.LOW_CONTENT}' END END AS error FROM r GROUP BY conv_id
""")
def first_accepted(spark, sf_dir):
    rows = summaries.accepted_responses(_responses(spark, sf_dir))
    return rows.select("session_id", F.col("attempt").cast("long").alias("attempt"), F.col("payload.session_notes_markdown").alias("notes"), "error")


@query("""
SELECT 'segment_without_session' AS problem, turn AS id FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)
UNION ALL SELECT 'embedding_without_note', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)
UNION ALL SELECT 'note_without_embedding', doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id NOT IN (SELECT vec_id FROM embeddings)
""")
def integrity_audit(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"))
    segments = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"))
    return audit.orphans(docs, segments, docs, read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("note_id")))


# ---- streams ---------------------------------------------------------------
def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _replayed(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there, and read its sink."""
    target = new_path(spark, name)
    run = rows.writeStream.format("parquet").option("path", f"{target}/out").option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{target}/out")


@query(f"SELECT user_id, started_us, ended_us, n_packets, duration_s FROM ({_BURSTS}) WHERE ended_us + {GAP_US} - 1 <= (SELECT max(epoch_us(ts)) FROM events) - 10000000")
def live_speech_segments(spark, sf_dir):
    rows = live.live_segments(_event_stream(spark, sf_dir), ["user_id"], GAP_US, MIN_US, at="ts")
    done = _replayed(spark, rows, "live-segments")
    return done.select("user_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), "n_packets", F.round("duration_s", 6).alias("duration_s"))


@query(f"SELECT event_id, user_id, action FROM ({_QUARANTINE})")
def live_failure_quarantine(spark, sf_dir):
    # One column that sorts by time and then by id.
    at = F.concat(F.lpad(F.unix_micros("ts").cast("string"), 20, "0"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    rows = live.live_quarantine(_outcomes(_event_stream(spark, sf_dir)).withColumn("at", at), "at", key="user_id")
    return _replayed(spark, rows, "live-quarantine").select(F.substring("at", 21, 20).cast("long").alias("event_id"), "user_id", "action")


def queries() -> dict[str, Query]:
    from sessionlore import file_queries, stream_queries, table_queries  # noqa: F401  add their own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
