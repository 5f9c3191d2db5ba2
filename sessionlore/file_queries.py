"""Queries over archive files on disk, and the job from recordings to transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionlore.functions.text import wav_path
from sessionlore.operators import packets
from sessionlore.plans import workloads
from sessionlore.queries import GAP_US, MIN_US, _events, query, read
from sessionlore.sources.packets import HEADER_ERROR, PAYLOAD_ERROR, archives_of, existing, register, write_archives, write_files
from sessionlore.sources.shared import new_path
from sessionlore.table_queries import stored

_FRAMED = f"""
framed AS (SELECT *, 'u' || user_id || '/' || burst || '.skopus' AS path, row_number() OVER (PARTITION BY user_id, burst ORDER BY event_id) - 1 AS packet_no FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS burst FROM (
    SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= {GAP_US})::INT, 0) AS new FROM events)))
"""


@query(f"""
WITH {_FRAMED}
SELECT path, packet_no::BIGINT AS packet_no, (event_id % 65536)::BIGINT AS sequence, (event_id % 1000003)::BIGINT AS timestamp, props AS payload, '' AS error FROM framed WHERE user_id % 5 > 1
UNION ALL SELECT DISTINCT path, -1, -1, -1, '', CASE WHEN user_id % 5 = 0 THEN '{PAYLOAD_ERROR}' ELSE '{HEADER_ERROR}' END FROM framed WHERE user_id % 5 < 2
""")
def packet_files(spark, sf_dir):
    """A file for each burst of a user, written and read again; the files of some users
    lose a byte, those of others all but a part of a header behind."""
    bursts = packets.with_bursts(_events(spark, sf_dir), ["user_id"], GAP_US, at="ts", order="event_id")
    rows = bursts.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), F.col("burst").cast("string"), F.lit(".skopus")).alias("path"), "user_id", F.col("event_id").alias("arrival_no"), (F.col("event_id") % 65536).alias("sequence"),
        (F.col("event_id") % 1000003).alias("timestamp"), F.col("props").cast("binary").alias("payload"),
    )
    rows = stored(rows, "packets")
    folder = new_path(spark, "archives")
    write_archives(rows.where("user_id % 5 > 1"), folder)
    last = rows.groupBy("path").agg((F.max("user_id") % 5).alias("kind"), F.max_by(F.length("payload"), "arrival_no").alias("size"))
    whole = archives_of(rows.where("user_id % 5 < 2")).join(last, "path")
    lost = F.when(F.col("kind") == 0, 1).otherwise(F.col("size") + 1)
    write_files(whole.select("path", F.substr("content", F.lit(1), F.length("content") - lost).alias("content")), folder)
    register(spark)
    found = spark.read.format("skopus").load(folder)
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-1).cast("long")).alias(c)
    return found.select("path", number("packet_no"), number("sequence"), number("timestamp"), F.coalesce(F.col("payload").cast("string"), F.lit("")).alias("payload"), F.coalesce("error", F.lit("")).alias("error"))


_SEGMENT = "'s/' || p_partkey || CASE p_partkey % 5 WHEN 0 THEN '.WAV' WHEN 1 THEN '.mp3' WHEN 2 THEN '.Skopus' ELSE '.skopus' END"


@query(f"""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'ready' WHEN 1 THEN 'unsupported' ELSE CASE WHEN p_size % 3 = 0 THEN 'ready' ELSE 'decode' END END AS route,
       CASE p_partkey % 5 WHEN 0 THEN 's/' || p_partkey || '.WAV' WHEN 1 THEN '' ELSE 's/' || p_partkey || '.wav' END AS ready_path FROM part
""")
def segment_routes(spark, sf_dir):
    """Segments routed by the files that are there: some have been decoded before."""
    parts = read(spark, sf_dir, "part").withColumn("audio_path", F.expr(_SEGMENT))
    folder = new_path(spark, "audio")
    made = parts.where("p_size % 3 = 0").select(F.concat(F.lit("s/"), F.col("p_partkey").cast("string"), F.lit(".wav")).alias("path"), F.col("p_name").cast("binary").alias("content"))
    write_files(made.unionByName(parts.where("p_partkey % 5 > 1").select(F.col("audio_path").alias("path"), F.lit(b"").alias("content"))), folder)
    return packets.routed(parts.select("p_partkey", "audio_path"), existing(parts.select(wav_path("audio_path").alias("path")), folder)).select("p_partkey", "route", F.coalesce("ready_path", F.lit("")).alias("ready_path"))


def _listening():
    """Tells the speaker of a file and its number of packets; some speakers are not understood."""

    def one(address: str) -> str:
        import pyarrow as pa
        from pyarrow import fs

        from sessionlore.sources.packets import packet_batch

        user = int(address.rsplit("/", 1)[1].split("_")[1])
        if user % 7 == 0:
            raise ValueError("not understood")
        store, path = fs.FileSystem.from_uri(address)
        with store.open_input_stream(path) as file:
            found = packet_batch(pa.array([path]), pa.array([file.read()], pa.binary()))
        return f" {user} {len(found['path'])}\n"

    return lambda addresses: [one(a) for a in addresses]


@query(f"""
WITH e AS (SELECT user_id, event_id, ts, epoch_us(ts) AS us FROM events WHERE event_type <> 'signup' AND event_type <> 'error'),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) >= {GAP_US})::INT, 0) AS new FROM e)),
s AS (SELECT user_id % 70 AS session_id, user_id, burst, min(us) AS us, min(ts) AS ts, count(*) AS n FROM b GROUP BY user_id, burst HAVING count(*) * 20000 >= {MIN_US}),
t AS (SELECT s.*, coalesce(u.name, 'user ' || s.user_id) AS name FROM s LEFT JOIN LATERAL (
  SELECT 'name ' || x.event_id AS name FROM events x WHERE x.event_type = 'signup' AND x.user_id = s.user_id AND x.ts <= s.ts ORDER BY x.ts DESC, x.event_id DESC LIMIT 1) u ON true),
o AS (SELECT session_id, count(*) AS n_segments, count(*) FILTER (user_id % 7 <> 0) AS n_done, '# Transcript' || string_agg(chr(10) || chr(10) || name || ': ' || user_id || ' ' || n, '' ORDER BY us, user_id) || chr(10) AS markdown FROM t GROUP BY session_id)
SELECT a.session_id, coalesce(n_segments, 0)::BIGINT AS n_segments, coalesce(n_done, 0)::BIGINT AS n_done, coalesce(n_segments - n_done, 0)::BIGINT AS n_skipped, CASE WHEN n_done > 0 THEN 'completed' ELSE 'failed' END AS status,
       CASE WHEN n_segments IS NULL THEN 'No decodable audio was captured for this session. Voice packets were received, but no valid speaker audio could be saved.' WHEN n_done = 0 THEN 'All audio failed' ELSE '' END AS error, CASE WHEN n_done > 0 THEN markdown ELSE '' END AS markdown
FROM (SELECT DISTINCT user_id % 70 AS session_id FROM events WHERE event_type <> 'signup') a LEFT JOIN o USING (session_id)
""".replace("'All audio failed'", "'No audio segments could be transcribed. All saved segments failed to decode.'"))
def recordings(spark, sf_dir):
    """Packets to archive files, segments with the names of their start, texts by a plain
    model that reads the files, outcomes and transcripts. Errors are packets without a header."""
    events = _events(spark, sf_dir).withColumn("guild_id", F.lit(1))
    updates = events.where("event_type = 'signup'").select("guild_id", "user_id", F.concat(F.lit("name "), F.col("event_id").cast("string")).alias("character_name"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"))
    rows = events.where("event_type != 'signup'").select(
        "guild_id", (F.col("user_id") % 70).alias("session_id"), "user_id", F.lit("").alias("display_name"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"),
        F.when(F.col("event_type") != "error", F.col("event_id") % 65536).cast("int").alias("sequence"), (F.col("event_id") % 1000003).alias("rtp_timestamp"), F.col("props").cast("binary").alias("payload"),
        F.col("ts").alias("received_at"), F.col("event_id").alias("arrival_no"),
    )
    _, outcomes, texts = workloads.recordings_to_transcripts(rows, updates, None, new_path(spark, "recordings"), _listening, stored, idle_us=GAP_US, min_speech_us=MIN_US)
    done = outcomes.join(texts, "session_id", "left")
    return done.select("session_id", "n_segments", "n_done", "n_skipped", "status", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("markdown", F.lit("")).alias("markdown"))
