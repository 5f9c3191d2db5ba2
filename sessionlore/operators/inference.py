"""Applying a caller's model to a column in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

Model = Callable[[list], list]


def with_model(rows: DataFrame, column: str, make_model: Callable[[], Model], output: str, kind: str = "string", attempts: int = 1, partitions: int | None = None, batch: int = 64) -> DataFrame:
    """``rows`` with ``output`` and ``<output>_error``. ``make_model`` is called
    once per worker task and returns a function from a list of inputs to a
    list of results. A failing batch is tried row by row, each up to
    ``attempts`` times; a row that still fails has an error, not the job. An
    empty reply is ``''`` or ``[]``. Persist the result before branching, or
    the model runs twice; ``partitions`` spreads a large session's rows."""
    if partitions:
        rows = rows.repartition(partitions)
    empty: object = [] if kind.startswith("array") else ""
    target = to_arrow_type(StructType.fromDDL(f"x {kind}")["x"].dataType)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()

        def one(value):
            error = None
            for _ in range(attempts):
                try:
                    return model([value])[0], None
                except Exception as e:  # noqa: BLE001  reported in the error column
                    error = f"{type(e).__name__}: {e}"
            return None, error

        def some(values: list) -> list[tuple]:
            try:
                found = model(values)
                if len(found) == len(values):
                    return [(x, None) for x in found]
            except Exception:  # noqa: BLE001, S110  the rows are tried one by one
                pass
            return [one(v) for v in values]

        for whole in batches:
            # A call's rows leave before the next call: Python holds no more of them than these.
            for part in (whole.slice(i, batch) for i in range(0, whole.num_rows, batch)):
                done = some(part.column(column).to_pandas().tolist())
                results = pa.array([(empty if x is None and e is None else x) for x, e in done], target)
                yield pa.RecordBatch.from_arrays([*part.columns, results, pa.array([e for _, e in done], pa.string())], [*part.schema.names, output, f"{output}_error"])

    return rows.mapInArrow(run, f"{fields}, `{output}` {kind}, `{output}_error` string")
