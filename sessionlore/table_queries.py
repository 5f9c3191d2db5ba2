"""More queries: tables and sinks, keyed lookups and upserts, notices, prompts,
model calls, summaries end to end, and streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlore.functions import text as T
from sessionlore.operators import inference, long_transcripts, notes, packets, registry, sessions, summaries, transcripts
from sessionlore.operators.calls import Wording, answered
from sessionlore.plans import workloads
from sessionlore.queries import AS_OF, GAP_US, MIN_US, WS, _event_stream, _events, _N, _notes, _replayed, _second, _segments, query, read
from sessionlore.schemas import CHARACTERS
from sessionlore.sources.shared import new_path
from sessionlore.sources.tables import append_rows, latest_snapshot, read_markdown, read_table, write_markdown, write_table
from sessionlore.streaming import live


def stored(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---- tables and sinks --------------------------------------------------------
@query("SELECT turn AS id, conv_id AS session_id, role AS display_name, 'p' || turn AS audio_path, text AS transcript_text, turn * 1000000 AS started_us FROM conversations")
def segment_appends(spark, sf_dir):
    """Segments of even turns are written as a table, those of odd turns are appended."""
    rows = _segments(spark, sf_dir).withColumn("user_id", F.lit(1)).withColumn("ended_at", F.lit(None).cast("timestamp"))
    folder = new_path(spark, "tables")
    write_table(rows.where("id % 2 = 0"), folder, "transcript_segments")
    append_rows(rows.where("id % 2 = 1"), folder, "transcript_segments")
    return read_table(spark, folder, "transcript_segments").select("id", "session_id", "display_name", "audio_path", "transcript_text", F.unix_micros("started_at").alias("started_us"))


@query("""
SELECT session_id, transcript_text, row_number() OVER (ORDER BY odd, session_id, turn)::BIGINT AS id FROM (SELECT conv_id AS session_id, turn, text AS transcript_text, turn % 2 AS odd FROM conversations)
""")
def segment_ids(spark, sf_dir):
    """Segments of even turns, then those of odd turns, get ids in order of their append."""
    rows = _segments(spark, sf_dir).withColumn("user_id", F.lit(1)).withColumn("ended_at", F.lit(None).cast("timestamp")).withColumn("seq", F.col("session_id") * 100_000 + F.col("id"))
    folder = new_path(spark, "tables")
    write_table(rows.limit(0), folder, "transcript_segments")
    for odd in (0, 1):
        workloads.append_segments(rows.where(F.col("id") % 2 == odd).drop("id"), folder)
    return read_table(spark, folder, "transcript_segments").select("session_id", "transcript_text", "id")


@query("""
SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_custkey) AS id, c_nationkey::BIGINT AS guild_id, c_name AS title, 'recording' AS status, true AS fresh FROM customer
""")
def new_sessions(spark, sf_dir):
    last = read(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    asked = read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("guild_id"), F.col("c_custkey").alias("voice_channel_id"), F.col("c_custkey").alias("text_channel_id"), F.col("c_name").alias("title"), F.col("c_custkey").alias("seq"))
    made = sessions.new_sessions(asked, last, F.lit(AS_OF).cast("timestamp"))
    fresh = F.col("ended_at").isNull() & F.col("transcript_path").isNull() & F.col("summary_path").isNull() & (F.col("started_at") == F.lit(AS_OF).cast("timestamp"))
    return made.select("id", "guild_id", "title", "status", fresh.alias("fresh"))


_TRANSCRIPT = f"""
SELECT conv_id AS session_id, '# Transcript' || coalesce(chr(10) || chr(10) || string_agg(role || ': ' || t, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE t <> ''), '') || chr(10) AS markdown
FROM (SELECT conv_id, turn, role, trim(text, '{WS}') AS t FROM conversations) GROUP BY conv_id
"""


@query(f"SELECT sink, session_id, 'transcript' AS kind, markdown FROM ({_TRANSCRIPT}), (VALUES ('table'), ('text')) AS s(sink)")
def markdown_sinks(spark, sf_dir):
    rows = _segments(spark, sf_dir)
    documents = stored(transcripts.transcripts(rows.select("session_id"), rows).withColumn("kind", F.lit("transcript")), "markdown")
    folder = new_path(spark, "sinks")
    write_markdown(documents, f"{folder}/table")
    write_markdown(documents, f"{folder}/text", as_text=True)
    table = spark.read.parquet(f"{folder}/table").select(F.lit("table").alias("sink"), "session_id", "kind", "markdown")
    return table.unionByName(read_markdown(spark, f"{folder}/text").select(F.lit("text").alias("sink"), "session_id", "kind", "markdown"))


# ---- lookups and upserts -----------------------------------------------------
@query(f"SELECT id, guild_id, title FROM {_N} n WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = n.id AND n.guild_id = CASE WHEN l.quality = 1 THEN n.guild_id ELSE l.doc_id % 20 END)")
def notes_by_id(spark, sf_dir):
    """Labels ask for notes; those of bad quality name a guild that is mostly wrong."""
    rows = _notes(spark, sf_dir)
    asked = read(spark, sf_dir, "labels").join(rows.select(F.col("id").alias("doc_id"), "guild_id"), "doc_id").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, F.col("guild_id")).otherwise(F.col("doc_id") % 20).alias("guild_id"))
    return notes.by_id(rows, asked).select("id", "guild_id", "title")


@query("SELECT o_orderkey AS id, o_custkey AS guild_id, o_orderstatus AS status FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def sessions_by_id(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("guild_id"), F.col("o_orderstatus").alias("status"))
    return sessions.by_id(rows, read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id")))


@query("""
SELECT note_id, len(v)::BIGINT AS n, v[1] AS first, v[-1] AS last FROM (
  SELECT vec_id AS note_id, CASE WHEN vec_id % 3 = 0 THEN list_reverse(embedding) ELSE embedding END::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0)
""")
def vector_upserts(spark, sf_dir):
    """Known vectors of even ids; a batch with two rows for every third id."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("note_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    third = rows.where("note_id % 3 = 0")
    batch = third.withColumn("seq", F.lit(1)).unionByName(third.withColumn("embedding", F.reverse("embedding")).withColumn("seq", F.lit(2)))
    done = notes.upsert_embeddings(rows.where("note_id % 2 = 0"), batch)
    return done.select("note_id", F.size("embedding").cast("long").alias("n"), F.element_at("embedding", 1).alias("first"), F.element_at("embedding", -1).alias("last"))


@query("""
WITH u AS (SELECT o_custkey AS user_id, CASE WHEN arg_max(o_orderkey, (o_orderdate, o_orderkey)) % 5 = 0 THEN '' ELSE 'order ' || arg_max(o_orderkey, (o_orderdate, o_orderkey)) END AS name, epoch_us(max(o_orderdate)) AS us FROM orders GROUP BY o_custkey)
SELECT coalesce(u.user_id, c_custkey) AS user_id, CASE WHEN u.user_id IS NULL THEN c_name ELSE u.name END AS character_name, coalesce(u.us, c_custkey * 1000000) AS updated_us
FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) c FULL JOIN u ON u.user_id = c_custkey
""")
def registry_upserts(spark, sf_dir):
    """Half of the customers are registered; every order names its customer anew."""
    known = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.lit(1).cast("long").alias("guild_id"), F.col("c_custkey").alias("user_id"), F.col("c_name").alias("character_name"), _second("c_custkey").alias("updated_at"))
    name = F.when(F.col("o_orderkey") % 5 == 0, " \n").otherwise(F.concat(F.lit(" order "), F.col("o_orderkey").cast("string")))
    updates = read(spark, sf_dir, "orders").select(F.lit(1).cast("long").alias("guild_id"), F.col("o_custkey").alias("user_id"), name.alias("character_name"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), F.col("o_orderkey").alias("seq"))
    return registry.register(known, updates).select("user_id", "character_name", F.unix_micros("updated_at").alias("updated_us"))


@query("SELECT conv_id AS session_id, turn AS id, CASE WHEN conv_id % 3 <> 0 THEN text END AS transcript_text FROM conversations")
def segment_resets(spark, sf_dir):
    rows = _segments(spark, sf_dir)
    events = rows.select("session_id", F.when(F.col("session_id") % 3 == 0, "reset_audio").when(F.col("session_id") % 3 == 1, "reset_text").otherwise("finalize").alias("event"))
    return sessions.reset_segment_texts(rows, events).select("session_id", "id", "transcript_text")


# ---- packets and paths -------------------------------------------------------
@query("SELECT event_id, user_id FROM events WHERE event_type NOT IN ('view', 'error', 'signup')")
def valid_packets(spark, sf_dir):
    """Events without a payload, a header or a user stand for broken packets."""
    kind = F.col("event_type")
    rows = _events(spark, sf_dir).select(
        "event_id", F.when(kind != "signup", F.col("user_id")).alias("user_id"),
        F.when(kind == "view", F.lit("")).otherwise(F.col("props")).cast("binary").alias("payload"), F.when(kind != "error", F.col("event_id") % 65536).alias("sequence"),
    )
    return packets.valid_packets(rows).select("event_id", "user_id")


_PATH = "'a.wav/' || p_partkey || ' ' || p_name || CASE p_partkey % 6 WHEN 0 THEN '.WAV' WHEN 1 THEN '.skopus' WHEN 2 THEN '.Skopus' WHEN 3 THEN '.mp3' WHEN 4 THEN '' ELSE '.skopus.bak' END"


@query(f"""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'ready' WHEN 1 THEN r WHEN 2 THEN r ELSE 'unsupported' END AS route, CASE WHEN p_partkey % 6 = 4 THEN path ELSE regexp_replace(path, '\\.[^./]+$', '.wav') END AS wav
FROM (SELECT p_partkey, {_PATH} AS path, CASE WHEN p_size % 2 = 0 THEN 'ready' ELSE 'decode' END AS r FROM part)
""")
def suffix_routes(spark, sf_dir):
    rows = read(spark, sf_dir, "part").withColumn("path", F.expr(_PATH))
    return rows.select("p_partkey", T.suffix_route("path", F.col("p_size") % 2 == 0).alias("route"), T.wav_path("path").alias("wav"))


# ---- notices and prompts -----------------------------------------------------
@query("""
SELECT o_orderkey AS session_id, '## Session ' || o_orderkey || chr(10) || chr(10) || '### Session Notes' || chr(10) || o_orderpriority || chr(10) || chr(10) || '### Cinematic Summary' || chr(10) || 'status ' || o_orderstatus
       || CASE WHEN n > 0 THEN chr(10) || chr(10) || 'Updated ' || n || ' campaign notes.' ELSE '' END AS notice
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON l_orderkey = o_orderkey
""")
def completion_notices(spark, sf_dir):
    """Returned items stand for note updates; most orders have some, others none."""
    counts = summaries.update_counts(read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("session_id")))
    rows = read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "session_id").join(counts, "session_id", "left").fillna(0, ["n_updates"])
    return rows.select("session_id", T.completion_notice("session_id", "o_orderpriority", F.concat(F.lit("status "), F.col("o_orderstatus")), "n_updates").alias("notice"))


@query("SELECT doc_id, 'Session processing failed: ' || left(text, 1800) AS failed, 'Could not answer right now: ' || left(text, 1800) AS unanswered, left(text, 1900) AS answer FROM documents")
def failure_notices(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.failure_notice("text").alias("failed"), T.question_failure("text").alias("unanswered"), T.answer_text("text").alias("answer"))


@query("""
SELECT conv_id AS session_id, turn AS id, 'As ' || role || CASE WHEN turn + 1 > 1 THEN chr(10) || 'Try again.' ELSE '' END || CASE WHEN turn % 3 = 2 THEN chr(10) || 'All parts.' ELSE '' END || CASE WHEN turn % 2 = 0 THEN chr(10) || text ELSE '' END AS instructions,
       'Session transcript:' || chr(10) || text AS transcript_prompt, 'Question: ' || role || chr(10) || chr(10) || 'Relevant campaign notes:' || chr(10) || text AS question_prompt
FROM conversations
""")
def model_prompts(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").withColumn("stage", F.when(F.col("turn") % 3 == 2, "final").otherwise("single")).withColumn("context", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(""))
    made = T.prompts(F.concat(F.lit("As "), F.col("role")), F.col("turn") + 1, "stage", "Try again.", "All parts.", F.col("context"))
    return rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), made.alias("instructions"), T.transcript_prompt("text").alias("transcript_prompt"), T.question_prompt("role", "text").alias("question_prompt"))


# ---- models ------------------------------------------------------------------
def _reversing():
    def model(texts: list) -> list:
        if any(len(t) % 7 == 0 for t in texts):
            raise ValueError("no")
        return [None if len(t) % 7 == 1 else t[::-1] for t in texts]

    return model


@query("SELECT doc_id, CASE length(text) % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE reverse(text) END AS reply, CASE WHEN length(text) % 7 = 0 THEN 'ValueError: no' END AS reply_error FROM documents")
def model_replies(spark, sf_dir):
    """A plain function as the model; it refuses some texts, and has nothing to say to others."""
    return inference.with_model(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", _reversing, "reply", attempts=2).drop("text")


def _summarising():
    """Notes are the text's length, its begin and its end; few texts are refused."""

    def one(text: str) -> str:
        update = {"note_type": "NPC" if len(text) % 2 else "npc", "title": f"T{len(text) % 3}", "content": text[14:60], "metadata": {}}
        return json.dumps({"session_notes_markdown": f"{len(text)} " + text[14:60] + "n" * 80, "cinematic_summary_markdown": "c" * 80 + text[-40:], "note_updates": [update, update | {"title": " "}]})

    return lambda texts: [one(t.split(T.TRANSCRIPT_PROMPT, 1)[1]) for t in texts]


_WORDING = Wording("Tell what happened.", "Say more.", "One story of all parts.")
_SINGLE, _LIMIT = 2600, 900


def _summarised(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _segments(spark, sf_dir)
    return workloads.session_summaries(rows.select("session_id"), rows, _summarising, stored, _SINGLE, _LIMIT, attempts=2, wording=_WORDING)


_CALLS = f"""
WITH RECURSIVE d AS (SELECT session_id, markdown AS text FROM ({_TRANSCRIPT})),
l AS (SELECT session_id, string_split(rtrim(text, chr(10)), chr(10)) AS lines FROM (SELECT session_id, regexp_replace(text, '{T.LINE_END}', chr(10), 'g') AS text FROM d WHERE length(text) > {_SINGLE})),
n AS (SELECT session_id, unnest(lines[3:]) AS line, generate_subscripts(lines[3:], 1) AS i FROM l),
g AS (SELECT session_id, i, 0 AS chunk_no, length(line) + 1 AS size FROM n WHERE i = 1
      UNION ALL SELECT n.session_id, n.i, CASE WHEN g.size + length(n.line) + 1 > {_LIMIT} THEN g.chunk_no + 1 ELSE g.chunk_no END,
                       CASE WHEN g.size + length(n.line) + 1 > {_LIMIT} THEN length(n.line) + 1 ELSE g.size + length(n.line) + 1 END FROM g JOIN n ON n.session_id = g.session_id AND n.i = g.i + 1),
chunks AS (SELECT g.session_id, chunk_no, '# Transcript' || chr(10) || chr(10) || trim(string_agg(line, chr(10) ORDER BY g.i), '{WS}') || chr(10) AS text, count(*) OVER (PARTITION BY g.session_id) AS k
           FROM g JOIN n ON n.session_id = g.session_id AND n.i = g.i GROUP BY g.session_id, chunk_no),
single AS (SELECT session_id, text FROM d WHERE length(text) <= {_SINGLE} UNION ALL SELECT session_id, text FROM chunks WHERE k = 1),
part AS (SELECT session_id, chunk_no, text, trim(length(text) || ' ' || substr(text, 15, 46) || repeat('n', 80), '{WS}') AS notes, trim(repeat('c', 80) || substr(text, greatest(1, length(text) - 39)), '{WS}') AS recap FROM chunks WHERE k > 1),
final AS (SELECT session_id, '# Transcript' || chr(10) || chr(10) || trim(string_agg(notes || chr(10) || chr(10) || recap, chr(10) || chr(10) ORDER BY chunk_no), '{WS}') || chr(10) AS text FROM part GROUP BY session_id),
last AS (SELECT session_id, text, false AS chunked FROM single UNION ALL SELECT session_id, text, true FROM final),
told AS (SELECT *, trim(length(text) || ' ' || substr(text, 15, 46) || repeat('n', 80), '{WS}') AS notes, trim(repeat('c', 80) || substr(text, greatest(1, length(text) - 39)), '{WS}') AS recap FROM last)
"""


@query(_CALLS + "SELECT session_id, '# Session Notes' || chr(10) || chr(10) || notes || chr(10) || chr(10) || '# Cinematic Summary' || chr(10) || chr(10) || recap || chr(10) AS markdown FROM told")
def session_summaries(spark, sf_dir):
    """Transcripts to chunks, model calls, recaps of chunks, a final call, and the summary."""
    return _summarised(spark, sf_dir)[0]


def _choosy():
    """Refuses by the length of the transcript: always, until it is asked again, never."""

    def one(prompt: str) -> str:
        told, text = prompt.split(T.TRANSCRIPT_PROMPT, 1)
        again, kind = _WORDING.retry in told, len(text) % 5
        if kind == 0 or (kind == 3 and not again):
            raise ValueError("no reply")
        good = kind == 4 or again and kind != 2
        return json.dumps({"session_notes_markdown": "n" * 90 if good else "None", "cinematic_summary_markdown": "c" * 90})

    def model(prompts: list) -> list:
        return [one(p) for p in prompts]

    return model


@query("""
WITH c AS (SELECT conv_id AS session_id, CASE WHEN turn % 2 = 0 THEN 'chunk' ELSE 'single' END AS stage, turn::BIGINT AS chunk_no, length(text) % 5 AS kind FROM conversations)
SELECT session_id, stage, chunk_no, CASE kind WHEN 4 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 2 ELSE 0 END::BIGINT AS attempt, CASE kind WHEN 0 THEN 'Could not generate summary' WHEN 2 THEN 'Could not generate non-empty summary' END AS error,
       CASE kind WHEN 4 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 2 ELSE 3 END::BIGINT AS n_attempts FROM c
""")
def retry_rounds(spark, sf_dir):
    """A model that answers some calls at once, others when asked again, some never."""
    calls = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.when(F.col("turn") % 2 == 0, "chunk").otherwise("single").alias("stage"), F.col("turn").cast("int").alias("chunk_no"), "text")
    done = answered(calls, _choosy, new_path(spark, "ledger"), _WORDING, stored)
    return done.select("session_id", "stage", F.col("chunk_no").cast("long").alias("chunk_no"), F.coalesce(F.col("attempt").cast("long"), F.lit(0).cast("long")).alias("attempt"), "error", "n_attempts")


@query("""
SELECT stage, attempt, count(*)::BIGINT AS n_calls FROM (
  SELECT DISTINCT CASE WHEN turn % 2 = 0 THEN 'chunk' ELSE 'single' END AS stage, turn, a::BIGINT AS attempt, text FROM conversations, (VALUES (1), (2), (3)) AS t(a)
  WHERE a <= CASE length(text) % 5 WHEN 4 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 2 ELSE 3 END) GROUP BY stage, attempt
""")
def ledger_calls(spark, sf_dir):
    """How many prompts reached the model in each round, of a run that is ended after
    its first round and then repeated over the same ledger."""
    calls = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.when(F.col("turn") % 2 == 0, "chunk").otherwise("single").alias("stage"), F.col("turn").cast("int").alias("chunk_no"), "text")
    ledger = new_path(spark, "ledger")
    answered(calls, _choosy, ledger, _WORDING, stored, attempts=1)
    answered(calls, _choosy, ledger, _WORDING, stored)
    rows = spark.read.parquet(ledger)
    return rows.groupBy("stage", F.col("attempt").cast("long").alias("attempt")).agg(F.count(F.lit(1)).alias("n_calls"))


@query(_CALLS + f"SELECT session_id, CASE WHEN k > 1 THEN 'chunk' ELSE 'single' END AS stage, chunk_no::BIGINT AS chunk_no, text FROM chunks UNION ALL SELECT session_id, 'single', 0, text FROM d WHERE length(text) <= {_SINGLE}")
def long_transcript_chunks(spark, sf_dir):
    """Chunks for the model, made from lines and not from whole transcripts."""
    rows = _segments(spark, sf_dir)
    made = long_transcripts.chunks(rows.select("session_id"), rows, stored, _SINGLE, _LIMIT)
    return made.select("session_id", "stage", F.col("chunk_no").cast("long").alias("chunk_no"), "text")


_UPDATES = _CALLS + f""",
raw AS (SELECT session_id, true AS chunked, 0 AS stage, chunk_no, text FROM part UNION ALL SELECT session_id, chunked, 1, 0, text FROM last),
u AS (SELECT session_id, chunked, stage, chunk_no, CASE WHEN length(text) % 2 = 1 THEN 'NPC' ELSE 'npc' END AS note_type, 'T' || (length(text) % 3) AS title, trim(substr(text, 15, 46), '{WS}') AS content FROM raw),
kept AS (SELECT *, row_number() OVER (PARTITION BY session_id, chunked, lower(note_type), lower(title) ORDER BY length(content) DESC, stage, chunk_no) AS r FROM u WHERE content <> '')
"""


@query(_UPDATES + "SELECT session_id, note_type, title, content FROM kept WHERE r = 1")
def session_note_updates(spark, sf_dir):
    """Updates of all calls of a session, merged where it had several."""
    return _summarised(spark, sf_dir)[1].select("session_id", "note_type", "title", "content")


@query(_UPDATES + """
, batch AS (SELECT session_id % 10 AS guild_id, note_type, title, min(session_id) AS s, max(session_id) AS source, arg_max(content, session_id) AS content FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, note_type, title ORDER BY stage DESC, chunk_no DESC) AS newest FROM (
    SELECT k.session_id, k.note_type, k.title, k.content, f.stage, f.chunk_no FROM kept k JOIN (SELECT session_id, chunked, lower(note_type) AS a, lower(title) AS b, min(stage) AS stage, arg_min(chunk_no, (stage, chunk_no)) AS chunk_no FROM kept GROUP BY 1, 2, 3, 4) f
    ON f.session_id = k.session_id AND f.a = lower(k.note_type) AND f.b = lower(k.title) WHERE k.r = 1)) WHERE newest = 1 GROUP BY 1, 2, 3)
SELECT guild_id, note_type, title, content, source AS source_session_id FROM batch
""")
def notes_after_sessions(spark, sf_dir):
    """The notes of ten guilds after the updates of all sessions, in session order."""
    from sessionlore.schemas import NOTES

    updates = stored(_summarised(spark, sf_dir)[1], "updates")
    owners = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), (F.col("conv_id") % 10).alias("guild_id")).distinct()
    done = workloads.notes_after(spark.createDataFrame([], NOTES), updates, owners, F.lit(AS_OF).cast("timestamp"))
    return done.select("guild_id", "note_type", "title", "content", "source_session_id")


@query(f"""
SELECT conv_id AS session_id, turn AS id, lower(t) IN ('', 'none', 'n/a', 'no session notes available.', 'no cinematic summary available.') AS placeholder, t AS notes, CASE WHEN turn % 6 = 3 THEN 0 ELSE 1 END::BIGINT AS n_updates FROM (
  SELECT *, trim(CASE turn % 6 WHEN 0 THEN text WHEN 1 THEN ' N/A ' WHEN 2 THEN 'None' WHEN 3 THEN 'No session notes available.' WHEN 4 THEN 'True' ELSE turn::VARCHAR END, '{WS}') AS t FROM conversations)
""")
def response_values(spark, sf_dir):
    """Responses whose notes are a text, a placeholder, null, true or a number,
    and whose updates are a list or no list; metadata that is no object."""
    from sessionlore.functions.responses import is_placeholder, normalized

    k = F.col("turn") % 6
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    value = F.when(k == 0, quoted(F.col("text"))).when(k == 1, '" N/A "').when(k == 2, "null").when(k == 3, '"No session notes available."').when(k == 4, "true").otherwise(F.col("turn").cast("string"))
    updates = F.when(k == 3, '{"note_type": "a"}').otherwise('[7, null, {"note_type": "a", "title": 5, "content": false, "metadata": [1]}, {"note_type": "a", "title": " ", "content": "c"}]')
    rows = read(spark, sf_dir, "conversations").withColumn("raw", F.concat(F.lit('{"session_notes_markdown": '), value, F.lit(', "note_updates": '), updates, F.lit("}")))
    rows = rows.withColumn("p", normalized("raw"))
    return rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), is_placeholder(F.col("p.session_notes_markdown")).alias("placeholder"), F.col("p.session_notes_markdown").alias("notes"), F.size("p.note_updates").cast("long").alias("n_updates"))


@query(f"""
WITH p AS (SELECT conv_id, turn, turn % 4 AS stage_no, trim(text, '{WS}') AS t FROM conversations)
SELECT conv_id AS session_id, stage, chunk_no::BIGINT AS chunk_no, '# Transcript' || chr(10) || chr(10) || t || chr(10) || chr(10) || t || chr(10) AS markdown FROM (
  SELECT conv_id, CASE WHEN turn % 2 = 0 THEN 'chunk' ELSE 'single' END AS stage, turn AS chunk_no, t FROM p WHERE length(t) >= CASE WHEN turn % 2 = 0 THEN 40 ELSE 80 END AND turn % 7 <> 6)
""")
def recap_parts(spark, sf_dir):
    """Accepted responses of each turn as a chunk or a whole, with the recap of its
    chunk; every seventh call has an error beside its reply."""
    rows = read(spark, sf_dir, "conversations")
    raw = F.to_json(F.struct(F.col("text").alias("session_notes_markdown"), F.col("text").alias("cinematic_summary_markdown")))
    calls = rows.select(F.col("conv_id").alias("session_id"), F.when(F.col("turn") % 2 == 0, "chunk").otherwise("single").alias("stage"), F.col("turn").cast("int").alias("chunk_no"), F.lit(1).alias("attempt"), raw.alias("raw"), F.when(F.col("turn") % 7 == 6, "failed").alias("error"))
    accepted = stored(summaries.accepted_responses(calls).where("payload is not null"), "accepted")
    parts = summaries.recaps(accepted.select(F.struct("session_id", "stage", "chunk_no").alias("session_id"), F.lit("chunk").alias("stage"), F.lit(0).alias("chunk_no"), "payload"))
    return parts.select("session_id.session_id", "session_id.stage", F.col("session_id.chunk_no").cast("long").alias("chunk_no"), "markdown")


@query(f"SELECT doc_id AS note_id, (length(lang) + 1 + length(title) + 1 + length(text))::DOUBLE AS size, 2.0::DOUBLE AS n FROM (SELECT doc_id, lang, text, split_part(text, ' ', 1) AS title FROM documents) WHERE (length(lang) + length(title) + length(text) + 2) % 5 <> 0")
def note_vectors(spark, sf_dir):
    """Vectors of all notes by a plain model, which fails on some."""

    def make():
        def model(texts: list) -> list:
            if any(len(t) % 5 == 0 for t in texts):
                raise ValueError("no")
            return [[float(len(t)), 1.0] for t in texts]

        return model

    return workloads.embedded(_notes(spark, sf_dir), make).select("note_id", F.element_at("embedding", 1).alias("size"), F.size("embedding").cast("double").alias("n"))


# ---- streams -----------------------------------------------------------------
@query("SELECT user_id, 'event ' || arg_max(event_id, (ts, event_id)) AS character_name, epoch_us(max(ts)) AS updated_us FROM events GROUP BY user_id")
def live_registry(spark, sf_dir):
    """A stream of name updates; each batch makes the next snapshot of the registry."""
    folder = new_path(spark, "registry")
    rows = _event_stream(spark, sf_dir).select(F.lit(1).cast("long").alias("guild_id"), "user_id", F.concat(F.lit(" event "), F.col("event_id").cast("string")).alias("character_name"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"))
    write = live.registry_writer(f"{folder}/table", buckets=8)
    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    found, version = latest_snapshot(spark, f"{folder}/table", "character_registry")
    assert version >= 0 and found.schema == CHARACTERS
    return found.select("user_id", "character_name", F.unix_micros("updated_at").alias("updated_us"))


@query("""
SELECT guild_id, note_type, title, arg_max(content, seq) AS content, max(seq) AS source_session_id, count(*) OVER ()::BIGINT AS n_notes FROM (
  SELECT user_id % 7 AS guild_id, event_type AS note_type, 'T' || (user_id % 11) AS title, 'event ' || event_id AS content, event_id AS seq FROM events) GROUP BY guild_id, note_type, title
""")
def live_notes(spark, sf_dir):
    """A stream of note updates; each batch merges into the buckets that it touches.
    Ids are dense over all batches."""
    folder = new_path(spark, "notes")
    rows = _event_stream(spark, sf_dir).select(
        (F.col("user_id") % 7).alias("guild_id"), F.concat(F.col("event_type"), F.lit(" ")).alias("note_type"), F.concat(F.lit(" T"), (F.col("user_id") % 11).cast("string")).alias("title"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("content"), F.col("event_id").alias("source_session_id"), F.lit("{}").alias("metadata_json"), F.col("event_id").alias("seq"),
    )
    write = live.notes_writer(f"{folder}/table", F.lit(AS_OF).cast("timestamp"), buckets=8)
    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    found, _ = latest_snapshot(spark, f"{folder}/table", "campaign_notes")
    return found.select("guild_id", "note_type", "title", "content", "source_session_id", F.lit(found.agg(F.max("id")).first()[0]).cast("long").alias("n_notes"))


@query(f"""
WITH e AS (SELECT user_id, epoch_us(ts) AS us, event_type = 'purchase' AS ended FROM events),
g AS (SELECT *, coalesce(sum(ended::INT) OVER (PARTITION BY user_id ORDER BY us, ended ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS era FROM e),
x AS (SELECT user_id, era, us AS end_us FROM g WHERE ended),
p AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY user_id, era ORDER BY us) >= {GAP_US})::INT, 0) AS new FROM g WHERE NOT ended),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id, era ORDER BY us ROWS UNBOUNDED PRECEDING) AS burst FROM p),
s AS (SELECT user_id, era, burst, min(us) AS started_us, max(us) AS ended_us, count(*) AS n, burst = max(burst) OVER (PARTITION BY user_id, era) AS last FROM b GROUP BY user_id, era, burst)
SELECT user_id, started_us, ended_us, n::BIGINT AS n_packets, forced FROM (SELECT s.*, end_us, coalesce(last AND end_us - ended_us < {GAP_US}, false) AS forced FROM s LEFT JOIN x USING (user_id, era))
WHERE (forced OR n * 20000 >= {MIN_US}) AND (NOT last OR end_us IS NOT NULL OR ended_us + {GAP_US} <= (SELECT max(us) FROM e) - 10000000)
""")
def live_segments_with_end(spark, sf_dir):
    """Purchases stand for the end of a session, which closes the open burst."""
    rows = _event_stream(spark, sf_dir).withColumn("ended", F.col("event_type") == "purchase")
    done = _replayed(spark, live.live_segments_with_end(rows, ["user_id"], GAP_US, MIN_US, at="ts", ended="ended"), "live-ends")
    return done.select("user_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), "n_packets", "forced")
