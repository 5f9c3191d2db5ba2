"""Streams whose rows are handled in order of event time, whatever trigger they
come in.

Rows of a key wait in state until the watermark has passed them: no earlier row
can come any more. Then they are released in order of time, and what is done with
them is what a batch job would do. A key's state is the rows within the delay and a
small summary of those before; it goes when both are empty, or when its time to live
is over.

Keys are dealt to buckets by a hash. A bucket has one state, and all its keys are
handled at once, in arrays: a call for each key costs milliseconds, however few its
rows are. Keys and what a step only hands on pass as texts, so that a missing value
does not turn whole numbers into floats.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

#: Of (summaries, released rows, watermark in us) makes (summaries, rows of the result,
#: least time in us at which it must be called again or None). Each frame has ``_key``
#: and may be None; released rows are in order of key, time and the given order.
Step = Callable[[pd.DataFrame | None, pd.DataFrame | None, int], tuple]

#: States of a stream; one holds all rows within the delay of its keys.
BUCKETS = 1024

#: Exact times, and columns that are null.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def as_text(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), _JSON) if columns else F.lit("{}")


def _packed(rows: pd.DataFrame | None) -> bytes | None:
    if rows is None or not len(rows):
        return None
    sink = io.BytesIO()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue()


def _opened(raw: bytes | None) -> pd.DataFrame | None:
    return None if raw is None else pa.ipc.open_stream(bytes(raw)).read_all().to_pandas()


def _joined(frames: list[pd.DataFrame | None]) -> pd.DataFrame | None:
    some = [f for f in frames if f is not None and len(f)]
    return pd.concat(some, ignore_index=True) if len(some) > 1 else some[0] if some else None


def in_order(rows: DataFrame, keys: list[str], at: str, order: list[str], used: list[str], kept: list[str], delay: str, step: Step, output: str, buckets: int = BUCKETS) -> DataFrame:
    """(keys, ``kept``, ``output``): the rows that ``step`` makes of released rows, which
    it gets with ``_key``, ``_us`` (the time), the columns that it has ``used``, and ``_row``, the text of the
    ``kept`` ones; those it returns have ``_key``, ``_row`` and ``output``, a DDL text. A row later
    than the watermark is dropped, as everywhere."""
    sorting = [f"_{c}_{k}" for k in range(len(order)) for c in ("null", "order")]

    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting = map(_opened, state.get) if state.exists else (None, None)
        mark = max(0, state.getCurrentWatermarkMs()) * 1000
        new = [] if state.hasTimedOut else [part.drop(columns=["_bucket", at]) for part in parts]
        rows = _joined([waiting, *new])
        released = None
        if rows is not None:
            ready = (rows["_us"] < mark).to_numpy()
            released, rows = rows[ready].sort_values(["_key", "_us", *sorting], kind="stable", ignore_index=True), rows[~ready]
        after, out, again = step(held, released if released is not None and len(released) else None, mark)
        after, left = _packed(after), _packed(rows)
        if after is None and left is None:
            if state.exists:
                state.remove()
        else:
            state.update((after, left))
            times = ([int(rows["_us"].min())] if left is not None else []) + ([again] if again is not None else [])
            if times:
                # A timer fires once the watermark is beyond it.
                state.setTimeoutTimestamp(max(min(times) // 1000, mark // 1000 + 1))
        if out is not None and len(out):
            yield out

    kind = lambda columns: StructType([rows.schema[c] for c in columns])
    # A missing number would turn the others into floats, whose order is not exact.
    sorted_by = [x for c in order for x in (F.col(c).isNull(), F.coalesce(c, F.lit("0").try_cast(rows.schema[c].dataType)))]
    thin = rows.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"), as_text(keys).alias("_key"), at, F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(0).cast("long")).alias("_us"), *used, as_text(kept).alias("_row"), *[x.alias(name) for name, x in zip(sorting, sorted_by, strict=True)])
    made = thin.withWatermark(at, delay).groupBy("_bucket").applyInPandasWithState(run, f"_key string, _row string, {output}", "_held binary, _waiting binary", "append", GroupStateTimeout.EventTimeTimeout)
    named = [c for c in made.columns if c not in ("_key", "_row")]
    read = made.select(F.from_json("_key", kind(keys), _JSON).alias("_key"), *([F.from_json("_row", kind(kept), _JSON).alias("_row")] if kept else []), *named)
    return read.select("_key.*", *(["_row.*"] if kept else []), *named)


def _starts(keys: np.ndarray) -> np.ndarray:
    """Whether a row is its key's first one."""
    return np.append(True, keys[1:] != keys[:-1])[: len(keys)]


def failures_in_runs(outcome: np.ndarray, first: np.ndarray, before: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The action of each row in order, and the number of failures after it: failures
    since the last good row or the last ``first`` one, which counts on from ``before``,
    counted anew after each ``limit``-th."""
    good, bad = outcome == "data", outcome == "error"
    total, place = np.cumsum(bad), np.arange(len(outcome))
    start, last_good = np.maximum.accumulate(np.where(first, place, 0)), np.maximum.accumulate(np.where(good, place, -1))
    base = np.where(last_good >= start, total[np.maximum(last_good, 0)], total[start] - bad[start] - before[start])
    count = total - base
    action = np.full(len(outcome), None, object)
    action[good] = "pass"
    action[bad] = np.where((count[bad] - 1) % limit == limit - 1, "quarantine", "drop")
    return action, count % limit


def runs_of_failures(outcome: np.ndarray, failures: int, limit: int) -> tuple[np.ndarray, int]:
    """As :func:`failures_in_runs` for the rows of one run, and the number after them."""
    if not len(outcome):
        return np.full(0, None, object), failures
    action, after = failures_in_runs(outcome, np.arange(len(outcome)) == 0, np.full(len(outcome), failures), limit)
    return action, int(after[-1])


def segments(rows: DataFrame, keys: list[str], idle_us: int, min_speech_us: int, packet_us: int, delay: str, at: str, ended: str, names: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """Bursts of packets in order of time, with the ``names`` of their first packet.
    A silence of ``idle_us`` closes a burst, and so does a row whose ``ended`` is true,
    after the packets of its own time; that keeps a burst that is still open then,
    however short it is."""
    thin = rows.select(*keys, at, F.coalesce(ended, F.lit(False)).alias("_ended"), *names)

    def step(held: pd.DataFrame | None, released: pd.DataFrame | None, mark: int) -> tuple:
        # An open burst goes before its key's rows, as one packet.
        parts = [] if held is None else [held.assign(_time=held["_last"], _ended=False)]
        if released is not None:
            times = released["_us"].to_numpy(np.int64)
            parts.append(pd.DataFrame({"_key": released["_key"], "_row": released["_row"], "_start": times, "_time": times, "_n": 1, "_ended": released["_ended"].to_numpy(bool)}))
        whole = _joined(parts)
        if whole is None:
            return None, None, None
        whole = whole.iloc[np.argsort(pd.factorize(whole["_key"])[0], kind="stable")]
        key, who = whole["_key"].to_numpy(object), whole["_row"].to_numpy(object)
        starts, times, weights, ends = whole["_start"].to_numpy(np.int64), whole["_time"].to_numpy(np.int64), whole["_n"].to_numpy(np.int64), whole["_ended"].to_numpy(bool)
        packets = np.flatnonzero(~ends)
        if not len(packets):
            return None, None, None
        speaker = np.cumsum(_starts(key))
        # Packets of one burst follow each other without a silence or an end between.
        new = _starts(speaker[packets])
        new[1:] |= (np.diff(times[packets]) >= idle_us) | (np.diff(np.cumsum(ends)[packets]) > 0)
        begin = np.flatnonzero(new)
        firsts, lasts = packets[begin], packets[np.append(begin[1:], len(packets)) - 1]
        size = np.add.reduceat(weights[packets], begin)
        end_at = np.flatnonzero(ends)
        at_end = np.append(end_at, len(times))[np.searchsorted(end_at, lasts)]
        ended_here = at_end < np.minimum(np.append(firsts[1:], len(times)), np.searchsorted(speaker, speaker[lasts], "right"))
        forced = ended_here & (np.append(times, 0)[at_end] - times[lasts] < idle_us)
        closed = ended_here | (mark >= times[lasts] + idle_us)
        closed[:-1] |= speaker[firsts[1:]] == speaker[firsts[:-1]]
        kept = closed & (forced | (size * packet_us >= min_speech_us))
        out = pd.DataFrame({"_key": key[firsts[kept]], "_row": who[firsts[kept]], "_started": starts[firsts[kept]], "_ended": times[lasts[kept]], "n_packets": size[kept], "duration_s": size[kept] * packet_us / 1e6, "forced": forced[kept]})
        first, last = firsts[~closed], lasts[~closed]
        after = pd.DataFrame({"_key": key[first], "_row": who[first], "_start": starts[first], "_last": times[last], "_n": size[~closed]})
        return after, out, int(times[last].min()) + idle_us if len(last) else None

    done = in_order(thin, keys, at, ["_ended"], ["_ended"], list(names), delay, step, "_started long, _ended long, n_packets long, duration_s double, forced boolean", buckets)
    return done.select(*keys, F.timestamp_micros("_started").alias("started_at"), F.timestamp_micros("_ended").alias("ended_at"), "n_packets", "duration_s", "forced", *names)


def quarantine(rows: DataFrame, key: str, at: str, order: list[str], outcome: str, limit: int, delay: str, forget_us: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(key, at, order, outcome, action). A source without failures has no state; one
    that has been silent for ``forget_us`` of event time begins anew."""
    thin = rows.select(key, at, *order, outcome)

    def step(held: pd.DataFrame | None, released: pd.DataFrame | None, mark: int) -> tuple:
        out = None
        if released is not None:
            name, times = released["_key"].to_numpy(object), released["_us"].to_numpy(np.int64)
            first, place = _starts(name), pd.Index([]) if held is None else pd.Index(held["_key"])
            found = place.get_indexer(name[first])
            before, last = np.zeros(len(times), np.int64), np.append(times[:1], times[:-1])
            last[first] = times[first]
            if held is not None:
                before[first] = np.where(found >= 0, held["_failures"].to_numpy(np.int64)[found], 0)
                last[first] = np.where(found >= 0, held["_last"].to_numpy(np.int64)[found], times[first])
            # Where a silence was too long, what was held is forgotten.
            silent = times - last >= forget_us if forget_us is not None else np.zeros(len(times), bool)
            before[silent] = 0
            action, failures = failures_in_runs(released[outcome].to_numpy(object), first | silent, before, limit)
            out = released[["_key", "_row"]].assign(action=action)
            final = np.append(first[1:], True)
            now = pd.DataFrame({"_key": name[final], "_failures": failures[final], "_last": times[final]})
            held = _joined([None if held is None else held.drop(index=found[found >= 0]), now])
        if held is None:
            return None, out, None
        held = held[held["_failures"] > 0]
        if forget_us is not None:
            held = held[held["_last"] + forget_us > mark]
        return held, out, int(held["_last"].min()) + forget_us if forget_us is not None and len(held) else None

    return in_order(thin, [key], at, order, [outcome], [at, *order, outcome], delay, step, "action string", buckets)


def names_as_of(rows: DataFrame, updates: DataFrame, keys: list[str], at: str, fallback: str, name: str, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows with the name of the last update (keys, character_name, updated_at, seq)
    at or before their time, an empty one too, else the ``fallback`` column. Of a key's
    updates, state keeps those within the delay and the last one before. A null key
    finds nothing."""
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    mine = [c for c in rows.columns if c not in keys]
    ups = updates.where(~null_key).select(*keys, F.col("updated_at").alias(at), F.lit(0).alias("_kind"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("_seq"), F.col("character_name").alias("_name"), F.lit("").alias("_own"))
    both = rows.where(~null_key).select(*keys, at, F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_seq"), F.col(fallback).cast("string").alias("_name"), as_text(mine).alias("_own")).unionByName(ups)

    def step(held: pd.DataFrame | None, released: pd.DataFrame | None, mark: int) -> tuple:
        if released is None:
            return held, None, None
        key, names = released["_key"].to_numpy(object), released["_name"].to_numpy(object)
        is_update, first = (released["_kind"] == 0).to_numpy(), _starts(key)
        index = np.arange(len(key))
        place, start = np.maximum.accumulate(np.where(is_update, index, -1)), np.maximum.accumulate(np.where(first, index, 0))
        before = (pd.Index([]) if held is None else pd.Index(held["_key"])).get_indexer(key)
        told = np.append([] if held is None else held["_told"].to_numpy(object), [None])
        found = np.where(place >= start, names[np.maximum(place, 0)], np.where(before >= 0, told[before], names))
        out = pd.DataFrame({"_key": key[~is_update], "_row": released["_row"].to_numpy(object)[~is_update], "_own": released["_own"].to_numpy(object)[~is_update], "_found": found[~is_update]})
        final = np.append(first[1:], True) & (place >= start)
        now = pd.DataFrame({"_key": key[final], "_told": names[place[final]]})
        return _joined([None if held is None else held[~held["_key"].isin(now["_key"])], now]), out, None

    met = in_order(both, keys, at, ["_kind", "_seq"], ["_kind", "_name", "_own"], [], delay, step, "_own string, _found string", buckets)
    kind = StructType([rows.schema[c] for c in mine])
    met = met.select(*keys, F.from_json("_own", kind, _JSON).alias("_own"), F.col("_found").alias(name)).select(*keys, "_own.*", name)
    return met.unionByName(rows.where(null_key).select(*keys, *mine, F.col(fallback).cast("string").alias(name)))
