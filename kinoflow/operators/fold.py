"""Sequential state over ordered streams with bounded memory.

One shuffle puts each stream's rows into one partition, sorted; a Python iterator then walks them batch by batch and
carries the state of one stream at a time, so no stream is ever held whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def ordered(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("stream_id").sortWithinPartitions("stream_id", *order)


def fold_streams(df: DataFrame, machine: Callable[[], object], schema: str, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Runs a fresh ``machine()`` over each stream. ``push(row: dict)`` and ``finish()`` give lists of output dicts;
    stream_id is added."""
    rows = ordered(df, *order)
    out_type: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(out_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, state, out = None, None, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, schema=arrow)

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["stream_id"] != stream:
                    if state is not None:
                        out += [x | {"stream_id": stream} for x in state.finish()]
                    stream, state = row["stream_id"], machine()
                out += [x | {"stream_id": stream} for x in state.push(row)]
            if out:
                yield made()
                out = []
        if state is not None:
            out = [x | {"stream_id": stream} for x in state.finish()]
            if out:
                yield made()

    return rows.mapInArrow(run, schema)


def fold_packed(packed: DataFrame, machine: Callable[[], object], schema: str) -> DataFrame:
    """The same over runs of rows as :class:`kinoflow.operators.features.Pack` makes them, which must not interlace. A
    machine with ``push_batch(batch: pa.RecordBatch)`` gets each run as a whole."""
    tasks = max(80, int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # so that few streams share one
    rows = packed.repartition(tasks, "stream_id").sortWithinPartitions("stream_id", "seq")
    out_type: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(out_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, state, out = None, None, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, schema=arrow)

        for batch in batches:
            for s, data in zip(batch.column("stream_id").to_pylist(), batch.column("packed"), strict=True):
                if state is None or s != stream:
                    if state is not None:
                        out += [x | {"stream_id": stream} for x in state.finish()]
                    stream, state = s, machine()
                for part in pa.ipc.open_stream(data.as_buffer()):
                    if hasattr(state, "push_batch"):
                        out += [x | {"stream_id": stream} for x in state.push_batch(part)]
                    else:
                        out += [x | {"stream_id": stream} for row in part.to_pylist() for x in state.push(row)]
                if len(out) > 10_000:
                    yield made()
                    out = []
        if state is not None:
            out += [x | {"stream_id": stream} for x in state.finish()]
        if out:
            yield made()

    return rows.mapInArrow(run, schema)
