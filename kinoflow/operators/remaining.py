"""Keyframes of whole streams as one shot each, in bounded memory."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinoflow.functions.columns import METRICS
from kinoflow.operators.cascade import Selector, judged
from kinoflow.operators.features import Pack, as_arrow, compute_features
from kinoflow.operators.fold import fold_packed
from kinoflow.operators.keyframes import SAMPLES
from kinoflow.options import SelectOptions
from kinoflow.timebase import Timebase

CHOSEN = "stream_id long, bucket int, pts long, strict boolean, quality float"


class Remaining:
    """The choice of ``keyframes.select_remaining`` for one stream of runs. Where its buckets lie and how sharp a frame
    must be depends on all of it, so the runs go to a file and are looked at again: memory is that of one run."""

    def __init__(self, options: SelectOptions):
        self.o, self.file, self.ends = options, tempfile.TemporaryFile(), []
        self.tb = self.first = self.last = None

    def push_batch(self, batch: pa.RecordBatch) -> list[dict]:
        if self.tb is None:
            self.tb = Timebase(batch.column("tb_num")[0].as_py(), batch.column("tb_den")[0].as_py())
            self.first = batch.column("pts")[0].as_py()
        self.last = batch.column("pts")[-1].as_py()
        with pa.ipc.new_stream(self.file, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        self.ends.append(self.file.tell())
        return []

    def _runs(self, ranges: list[tuple[int, int]]) -> Iterator[dict[str, np.ndarray]]:
        """The frames of each run that lie in a bucket, with its number."""
        low, high = (np.array(x, np.int64) for x in zip(*ranges, strict=True))
        begin = 0
        for end in self.ends:
            self.file.seek(begin)
            table = pa.ipc.open_stream(self.file.read(end - begin)).read_all()
            begin = end
            cols = {c: table.column(c).to_numpy() for c in ("pts", "sharpness", "quality", "sane", "good")}
            at = high.searchsorted(cols["pts"], "right")
            inside = (at < len(high)) & (cols["pts"] >= low[np.minimum(at, len(high) - 1)])
            yield {c: v[inside] for c, v in cols.items()} | {"bucket": at[inside]}

    def _floor(self, ranges: list[tuple[int, int]]) -> np.float32:
        o, floor = self.o, np.float32(self.o.min_sharpness)
        total = sum(int(run["good"].sum()) for run in self._runs(ranges)) if o.adaptive_floor else 0
        if total < max(o.adaptive_min_samples, 1):
            return floor
        want, begin, seen = min(total, SAMPLES), 0, []
        for run in self._runs(ranges):
            sharp = run["sharpness"][run["good"]]
            nth = np.arange(begin, begin + len(sharp))
            seen.append(sharp[(nth == 0) | (nth * want // total != (nth - 1) * want // total)])
            begin += len(sharp)
        picked = np.sort(np.concatenate(seen))
        return min(floor, picked[min(int(len(picked) * float(o.adaptive_percentile)), len(picked) - 1)])

    def finish(self) -> list[dict]:
        ranges = Selector(self.o, self.tb).ranges(self.first, self.last + 1)
        floor, strict, other = self._floor(ranges), {}, {}
        for run in self._runs(ranges):
            fine = run["good"] & (run["sharpness"] >= floor) & np.isfinite(run["quality"])
            for bucket in np.unique(run["bucket"]).tolist():
                here = run["bucket"] == bucket
                for best, live, key in ((strict, fine & here, run["quality"]), (other, run["sane"] & here, run["sharpness"])):
                    if live.any():
                        i = int(np.argmax(np.where(live, key, -np.inf)))
                        if bucket not in best or key[i] > best[bucket][0]:
                            best[bucket] = (key[i], int(run["pts"][i]), float(run["quality"][i]))
        self.file.close()
        chosen = {b: (strict.get(b) or other.get(b), b in strict) for b in sorted({*strict, *other})}
        return [{"bucket": b, "pts": c[1], "strict": sure, "quality": c[2]} for b, (c, sure) in chosen.items()]


def remaining_keyframes(frames: DataFrame, options: SelectOptions = SelectOptions()) -> DataFrame:
    """CHOSEN: keyframes of streams that end without a closing cut, as ``keyframes.select_remaining`` chooses them, straight
    from frames. Times out of order are left out; each frame is looked at once, and a task a stream gets 17 bytes of it."""

    def columns(part: dict, made: dict) -> dict:
        sane, good, quality = judged(made, options)
        cols = {c: part[c] for c in ("pts", "tb_num", "tb_den")}
        return cols | {"sharpness": pa.array(made["sharpness"]), "quality": as_arrow(quality, pa.float32()), "sane": pa.array(sane), "good": pa.array(good)}

    return fold_packed(compute_features(frames, METRICS, admit=True, pack=Pack(columns)), lambda: Remaining(options), CHOSEN)
