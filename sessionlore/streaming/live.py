"""Structured Streaming forms: speech segments, quarantine, live upserts.

Event time and watermarks make replays give the same result; a packet later
than the watermark is dropped and missing from its segment, a rule that a
live recorder working by arrival does not have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sessionlore.operators import notes, registry
from sessionlore.operators.packets import IDLE_US, MIN_SPEECH_US, PACKET_US, QUARANTINE_AFTER
from sessionlore.sources.versions import merge
from sessionlore.streaming import ordered


def live_segments(packets: DataFrame, keys: list[str], idle_us: int = IDLE_US, min_speech_us: int = MIN_SPEECH_US, packet_us: int = PACKET_US, delay: str = "10 seconds", names: tuple[str, ...] = (), at: str = "received_at") -> DataFrame:
    """Segments by session windows, emitted once the watermark has passed. A
    window joins packets exactly one gap apart, while a silence of that
    length must cut, so the gap is a microsecond less."""
    window = F.session_window(at, f"{idle_us - 1} microseconds")
    first = [F.min_by(n, at).alias(n) for n in names]
    rows = packets.withWatermark(at, delay).groupBy(*keys, window.alias("window")).agg(F.min(at).alias("started_at"), F.max(at).alias("ended_at"), F.count(F.lit(1)).alias("n_packets"), *first)
    return rows.where(F.col("n_packets") * packet_us >= min_speech_us).select(*keys, "started_at", "ended_at", "n_packets", (F.col("n_packets") * packet_us / 1e6).alias("duration_s"), *names)


def live_segments_with_end(packets: DataFrame, keys: list[str], idle_us: int = IDLE_US, min_speech_us: int = MIN_SPEECH_US, packet_us: int = PACKET_US, delay: str = "10 seconds", at: str = "received_at", ended: str = "session_ended", names: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`live_segments`, and a row whose ``ended`` column is true closes
    the burst that is still open, however short it is. Packets are taken in order of
    time once the watermark has passed them, whatever trigger they come in. State is
    the times within the delay and one open burst for each key."""
    return ordered.segments(packets, keys, idle_us, min_speech_us, packet_us, delay, at, ended, names)


def live_quarantine(packets: DataFrame, order: str, outcome: str = "outcome", key: str = "ssrc", limit: int = QUARANTINE_AFTER, at: str | None = None, delay: str = "10 seconds", forget: str | None = None) -> DataFrame:
    """(ssrc, order, outcome, action) with one counter per source as state. With
    ``at``, a time, packets count in order of it and of ``order`` over all triggers, and
    the time is returned too; without, in order of arrival, and of ``order`` within a
    trigger. A source that has had none for ``forget`` (as "1 hour") begins anew, and
    its state goes; one without failures has none."""
    if at is not None:
        return ordered.quarantine(packets, key, at, [order], outcome, limit, delay, None if forget is None else int(pd.Timedelta(forget).total_seconds() * 1e6))
    kept = packets.select(key, order, outcome).schema
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "action string"])
    silence = None if forget is None else int(pd.Timedelta(forget).total_seconds() * 1000)

    def step(key_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists and not state.hasTimedOut else 0
        whole = None
        if not state.hasTimedOut:
            whole = pd.concat(list(parts)).sort_values(order, kind="stable")
            actions, failures = ordered.runs_of_failures(whole[outcome].to_numpy(object), failures, limit)
            whole = whole.assign(action=actions)
        if failures:
            state.update((int(failures),))
            if silence is not None:
                state.setTimeoutDuration(silence)
        elif state.exists:
            state.remove()
        if whole is not None:
            yield whole

    timeout = GroupStateTimeout.NoTimeout if silence is None else GroupStateTimeout.ProcessingTimeTimeout
    return packets.select(key, order, outcome).groupBy(key).applyInPandasWithState(step, out, "failures long", "append", timeout)


def live_names_as_of(rows: DataFrame, updates: DataFrame, fallback: str, at: str = "started_at", name: str = "character_name", delay: str = "10 seconds") -> DataFrame:
    """As :func:`sessionlore.operators.registry.with_names_as_of`, of a stream of rows and
    one of updates; a row leaves once the watermark has passed it, so that updates
    before it have come."""
    return ordered.names_as_of(rows, updates, registry.KEYS, at, fallback, name, delay)


def snapshot_writer(folder: str, name: str, apply: Callable[..., DataFrame], keys: list[str] | None = None, buckets: int = 1, stream: str | None = None, counter: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each batch turns the newest version of a table
    into the next one, as :func:`sessionlore.sources.versions.merge` says. A batch is
    told by its stream and number, so one that is run again after a failure changes
    nothing more, and a new stream over an old table loses nothing. The stream is the
    running query's id, which its checkpoint keeps, unless it is named here."""

    def write(batch: DataFrame, number: int) -> None:
        query = stream or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        merge(batch, folder, name, apply, keys, buckets, query, number, counter)

    return write


def notes_writer(folder: str, as_of: Column, buckets: int = 64, stream: str | None = None) -> Callable[[DataFrame, int], None]:
    """Notes of batches as :func:`sessionlore.operators.notes.upsert` merges them."""
    write = snapshot_writer(folder, "campaign_notes", lambda old, batch, last: notes.upsert(old, batch, as_of, last), notes.KEYS, buckets, stream, "id")
    return lambda batch, number: write(notes.prepared(batch), number)


def vectors_writer(folder: str, buckets: int = 64, stream: str | None = None) -> Callable[[DataFrame, int], None]:
    return snapshot_writer(folder, "note_embeddings", notes.upsert_embeddings, ["note_id"], buckets, stream)


def registry_writer(folder: str, buckets: int = 64, stream: str | None = None) -> Callable[[DataFrame, int], None]:
    return snapshot_writer(folder, "character_registry", registry.register, registry.KEYS, buckets, stream)
