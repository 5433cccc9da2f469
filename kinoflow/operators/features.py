"""One pass over frames that turns planes into a narrow row of features.

All features that a query needs come from a single pass: the frames of a stream lie sorted in one partition, runs of
equal size are stacked and worked on together, and the last frame of a batch is carried to the next for the lag-1
features. Long streams can be cut into chunks that overlap by one frame, so one stream needn't be one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from kinoflow.functions import kernels as K
from kinoflow.functions.columns import METRICS
from kinoflow.options import EXTRACTORS, SelectOptions
from kinoflow.timebase import LIMIT

#: Bytes of planes that are stacked together.
STACK = 32 << 20
COLUMNS = {
    "luma_mean": "double", "rgb_mean": "double", "hist_luma": "array<int>", "hist_hue": "array<int>", "hist_sat": "array<int>",
    "corr_luma": "double", "corr_hue": "double", "corr_sat": "double", "phash": "array<long>", "phash_distance": "double",
    "d_hue": "double", "d_sat": "double", "d_lum": "double", "d_edges": "double", "d_edges_adaptive": "double", "luma_planes": "binary",
    "hue_planes": "binary", "sat_planes": "binary", "val_planes": "binary", "edge_count": "long",
} | {m: "float" for m in METRICS}
CARRIED = ("stream_id", "seq", "pts", "tb_num", "tb_den", "width", "height")
NEEDS = {
    "luma": {"luma_mean", "hist_luma", "corr_luma", "phash", "phash_distance", "luma_planes", "brightness", "luma_variance",
             "sharpness", "noise", "motion_blur"},
    "hsv": {"hist_hue", "hist_sat", "corr_hue", "corr_sat", "d_hue", "d_sat", "d_lum", "d_edges", "d_edges_adaptive", "edge_count",
            "hue_planes", "sat_planes", "val_planes", "saturation_variance"},
    "rgb": {"rgb_mean", "clipping", "colorfulness"},
}


def first_of(column):
    return column[0].as_py() if isinstance(column, pa.Array) else column[0]


def even_planes(data: pa.Array, strides: pa.Array, height: int, row: int) -> np.ndarray | None:
    """(frames, height, row) without copies where all planes have one size and stride, else None."""
    if data.type != pa.binary() or data.null_count or strides.null_count or not height:
        return None
    stride = strides.to_numpy()
    offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
    sizes, s = np.diff(offsets), int(stride[0]) or row
    size = int(sizes[0])
    if (stride != stride[0]).any() or (sizes != size).any() or s < row or size < s * (height - 1) + row:
        return None
    flat = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(data), size)
    if s == row:
        return flat[:, : row * height].reshape(len(data), height, row)
    if size < s * height:
        flat = np.pad(flat, ((0, 0), (0, s * height - size)))
    return np.ascontiguousarray(flat[:, : s * height].reshape(len(data), height, s)[:, :, :row])


class Frames:
    """A stack of frames of one size, with views made from one another only when asked for."""

    def __init__(self, rows: dict[str, list], luma_only: bool = False):
        self.rows, self.n, self.luma_only = rows, len(rows["seq"]), luma_only
        self.w, self.h = first_of(rows["width"]), first_of(rows["height"])
        self.made: dict[str, object] = {}

    def _stack(self, name: str, stride: str, channels: int = 1) -> np.ndarray:
        row = self.w * channels
        data, strides = self.rows[name], self.rows[stride]
        if isinstance(data, pa.Array):
            whole = even_planes(data, strides, self.h, row)
            if whole is not None:
                return whole.reshape(self.n, self.h, self.w, channels) if channels > 1 else whole
            data, strides = data.to_pylist(), strides.to_pylist()
        parts = [K.unpack(d, self.w, self.h, s or row, channels) for d, s in zip(data, strides, strict=True)]
        return np.stack(parts)

    def get(self, name: str):
        if name not in self.made:
            self.made[name] = getattr(self, f"_{name}")()
        return self.made[name]

    def _has(self, name: str) -> bool:
        return name in self.rows and first_of(self.rows[name]) is not None

    def _rgb(self):
        return self._stack("rgb", "rgb_stride", 3)

    @property
    def order(self) -> str:
        return ("channel_order" in self.rows and first_of(self.rows["channel_order"])) or "bgr"

    def _luma(self):
        return self._stack("luma", "luma_stride") if self._has("luma") else K.to_luma(self.get("rgb"), self.order)

    def _hsv(self):
        if self._has("hue"):
            return tuple(self._stack(c, "hsv_stride") for c in ("hue", "sat", "val"))
        if self.luma_only or not self._has("rgb"):
            zero = np.zeros_like(self.get("luma"))
            return zero, zero, self.get("luma")
        return K.to_hsv(self.get("rgb"), self.order)

    def _gradients(self):
        return K.gradients(self.get("luma"))

    def shrink(self, longest: int) -> None:
        """Area averages with that longest side take the place of the frames: of the packed view, from which the others
        are then made, or of the single planes where there is none."""
        if self._has("rgb"):
            self.made = {"rgb": K.downscale(self.get("rgb"), longest)}
            self.rows = {k: v for k, v in self.rows.items() if k not in ("luma", "hue", "sat", "val")}
        else:
            small = {}
            if self._has("luma"):
                small["luma"] = K.downscale(self.get("luma")[..., None], longest)[..., 0]
            if self._has("hue"):
                small["hsv"] = tuple(K.downscale(p[..., None], longest)[..., 0] for p in self.get("hsv"))
            self.made = small
        self.w, self.h = K.downscaled_size(self.w, self.h, longest)


class Admission:
    """Times of a stream's frames in the timebase of its first, rounded up; None for frames that can't be admitted."""

    def __init__(self):
        self.tb = self.last = None

    def pts(self, pts: int, tb_num: int, tb_den: int) -> int | None:
        self.tb = self.tb or (tb_num, tb_den)
        num, den = self.tb
        if (tb_num, tb_den) != self.tb:
            pts = -(-pts * tb_num * den // (num * tb_den))
        if pts >= LIMIT or (self.last is not None and pts < self.last):
            return None
        self.last = pts
        return pts


def metrics_of(f: Frames, wanted: set[str], staged: SelectOptions | None, extractors: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The wanted metrics. With ``staged`` options the costly ones are 0 where the cheap ones already reject a frame,
    and those of extractors that are off are 0 everywhere."""
    out: dict[str, np.ndarray] = {}
    if wanted & {"brightness", "luma_variance"} or staged:
        out["brightness"], out["luma_variance"] = K.mean_variance(f.get("luma"))
    if "saturation_variance" in wanted or staged:
        out["saturation_variance"] = K.mean_variance(f.get("hsv")[1])[1]
    if "clipping" in wanted or staged:
        out["clipping"] = K.clipping(f.get("rgb"))
    live = np.ones(f.n, bool)
    if staged:
        o, t = staged, np.float32
        flat = (out["luma_variance"] < t(o.luma_variance)) & (out["saturation_variance"] < t(o.sat_variance))
        live = ~((out["brightness"] < t(o.black_mean)) | (out["brightness"] > t(o.bright_mean)) | flat | (out["clipping"] > t(o.max_clipping)))
    small = f.w < 3 or f.h < 3
    for name in EXTRACTORS:
        if name not in wanted:
            continue
        value = np.zeros(f.n, np.float32)
        if live.any() and (not staged or name in extractors):
            if name == "colorfulness":
                value[live] = K.colorfulness(f.get("rgb")[live], f.order)
            elif name == "noise":
                value[live] = K.noise(f.get("luma")[live])
            elif not small:  # the gradients are made once for both
                gx, gy = f.get("gradients")
                gx, gy = gx[live], gy[live]
                value[live] = K.sharpness_of(gx, gy) if name == "sharpness" else K.motion_blur_of(np.abs(gx) + np.abs(gy), K.directions(gx, gy))
        out[name] = value
    return out


def _lagged(now: np.ndarray, before, compare, empty: float = np.nan) -> tuple[np.ndarray, np.ndarray]:
    """(values, known): each frame against the one before it, the first against ``before`` if there is one."""
    values, known = np.full(len(now), empty, np.float64), np.ones(len(now), bool)
    if len(now) > 1:
        values[1:] = compare(now[:-1], now[1:])
    if before is None:
        known[0] = False
    else:
        values[:1] = compare(before, now[:1])
    return values, known


def listed(values) -> list:
    if isinstance(values, tuple):
        return [v if k else None for v, k in zip(values[0].tolist(), values[1].tolist(), strict=True)]
    return values.tolist() if isinstance(values, np.ndarray) else values


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, tuple):
        return pa.array(values[0], kind, mask=~values[1])
    if isinstance(values, np.ndarray) and values.ndim == 2:
        offsets = np.arange(len(values) + 1, dtype=np.int32) * np.int32(values.shape[1])
        return pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1), kind.value_type), type=kind)
    return values if isinstance(values, pa.Array) else pa.array(values, kind)


class FeatureMaker:
    def __init__(self, wanted: tuple[str, ...], bins: int, bins_hsv: tuple[int, int], hash_size: int, lowpass: int, kernel: int | None,
                 staged: SelectOptions | None, extractors: tuple[str, ...], reset_all: bool, luma_only: bool,
                 kernel_adaptive: int | None = None, longest: int | None = None):
        self.wanted, self.bins, self.bins_hsv = wanted, bins, bins_hsv
        self.hash_size, self.lowpass, self.kernel = hash_size, lowpass, kernel
        self.kernel_adaptive, self.longest = kernel_adaptive, longest
        self.staged, self.extractors, self.reset_all, self.luma_only = staged, extractors, reset_all, luma_only
        self.last: dict[str, np.ndarray] = {}
        self.size = None

    def run(self, rows: dict[str, list], fresh: bool) -> dict[str, list]:
        return {name: listed(values) for name, values in self.arrays(rows, fresh).items()}

    def arrays(self, rows: dict, fresh: bool) -> dict:
        """The wanted features as arrays, (values, known) where they may be unknown, or lists of bytes."""
        f = Frames(rows, self.luma_only)
        if self.longest and max(f.w, f.h) > self.longest and min(f.w, f.h):
            f.shrink(self.longest)
        resized = self.size is not None and self.size != (f.w, f.h)
        if fresh or (resized and self.reset_all):
            self.last = {}
        elif resized:  # planes of another size can't be compared; histograms and hashes can
            self.last = {k: v for k, v in self.last.items() if not k.startswith("plane")}
        self.size = (f.w, f.h)
        want, out = set(self.wanted), {}

        def lag(key: str, now: np.ndarray, compare, name: str) -> None:
            values, known = _lagged(now, self.last.get(key), compare)
            self.last[key] = now[-1:].copy()
            if name in want:
                out[name] = values, known

        if "luma_mean" in want:
            out["luma_mean"] = K.mean(f.get("luma"))
        if "rgb_mean" in want:
            out["rgb_mean"] = K.mean(f.get("rgb"))
        planes = {"luma": lambda: f.get("luma"), "hue": lambda: f.get("hsv")[0], "sat": lambda: f.get("hsv")[1]}
        for (name, plane), bins in zip(planes.items(), (self.bins, *self.bins_hsv), strict=True):
            if want & {f"hist_{name}", f"corr_{name}"}:
                hist = K.histogram(plane(), bins)
                if f"hist_{name}" in want:
                    out[f"hist_{name}"] = hist
                lag(f"hist_{name}", hist, K.correlation, f"corr_{name}")
        if want & {"phash", "phash_distance"}:
            code = K.phash(f.get("luma"), self.hash_size, self.lowpass)
            if "phash" in want:
                out["phash"] = code.view(np.int64)
            lag("phash", code, lambda a, b: K.hamming(a, b) / self.hash_size**2, "phash_distance")
        if want & {"d_hue", "d_sat", "d_lum", "d_edges", "d_edges_adaptive", "edge_count"}:
            for name, plane in zip(("d_hue", "d_sat", "d_lum"), f.get("hsv"), strict=True):
                if self.luma_only and name != "d_lum":
                    plane = np.zeros_like(plane)
                lag(f"plane_{name}", plane, K.mean_abs_diff, name)
            if want & {"d_edges", "d_edges_adaptive", "edge_count"}:
                thin, auto = K.edge_map(f.get("hsv")[2]), K.auto_kernel(f.w, f.h)
                edge = K.dilate(thin, self.kernel or auto)
                if "edge_count" in want:
                    out["edge_count"] = (edge > 0).reshape(f.n, -1).sum(axis=1)
                lag("plane_edges", edge, K.mean_abs_diff, "d_edges")
                if "d_edges_adaptive" in want:
                    lag("plane_edges_adaptive", K.dilate(thin, self.kernel_adaptive or auto), K.mean_abs_diff, "d_edges_adaptive")
        if want & set(METRICS):
            for name, values in metrics_of(f, want & set(METRICS), self.staged, self.extractors).items():
                if name in want:
                    out[name] = values
        for name, get in (("luma_planes", lambda: f.get("luma")), ("hue_planes", lambda: f.get("hsv")[0]),
                          ("sat_planes", lambda: f.get("hsv")[1]), ("val_planes", lambda: f.get("hsv")[2])):
            if name in want:
                out[name] = [np.ascontiguousarray(p).tobytes() for p in get()]
        return out


def _whole(column: pa.Array) -> np.ndarray:
    """Numbers; nulls are the least."""
    if column.null_count:
        column = column.fill_null(-(1 << 63) if column.type == pa.int64() else -(1 << 31))
    return column.to_numpy(zero_copy_only=False)


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it."""
    values = column.to_numpy(zero_copy_only=False) if pa.types.is_boolean(column.type) else _whole(column)
    return values[1:] != values[:-1]


def runs_of(data: dict[str, pa.Array]) -> list[tuple[int, int]]:
    """Where runs of frames begin and end that are worked on together: of one stream and piece, size and set of views."""
    n = len(data["seq"])
    change = np.zeros(max(n - 1, 0), bool)
    for name in ("width", "height", "stream_id", "of"):
        if name in data:
            change |= _differs(data[name])
    for name in ("luma", "hue"):
        if name in data and 0 < data[name].null_count < n:
            change |= _differs(data[name].is_null())
    if "channel_order" in data and len(data["channel_order"].unique()) > 1:
        names = data["channel_order"].to_pylist()
        change |= np.array([a != b for a, b in zip(names[1:], names[:-1], strict=True)], bool)
    at = [0, *(np.flatnonzero(change) + 1).tolist(), n]
    return list(zip(at[:-1], at[1:], strict=True))


class Gate:
    """Admission of batches of whole streams in order, or of pieces, whose times must all be admissible."""

    def __init__(self, pieces: bool):
        self.pieces, self.gate, self.stream = pieces, Admission(), None

    def admitted(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        stream = batch.column("stream_id")
        if self.pieces:
            apart = _differs(stream) | _differs(batch.column("of"))
        else:
            apart = _differs(stream)
        at = [0, *(np.flatnonzero(apart) + 1).tolist(), batch.num_rows]
        pts, num, den = (batch.column(c) for c in ("pts", "tb_num", "tb_den"))
        plain = not (pts.null_count or num.null_count or den.null_count)
        for begin, end in zip(at[:-1], at[1:], strict=True):
            key = (stream[begin].as_py(), batch.column("of")[begin].as_py() if self.pieces else None)
            if key != self.stream:
                self.gate, self.stream = Admission(), key
            if plain:
                plain = self._as_they_are(*(c.to_numpy()[begin:end] for c in (pts, num, den)))
            if not plain:
                break
        if plain:
            return batch
        if self.pieces:
            raise ValueError("frames in pieces need times in order, in one timebase")
        return self._one_by_one(batch.slice(0, begin), batch.slice(begin))

    def _as_they_are(self, pts: np.ndarray, num: np.ndarray, den: np.ndarray) -> bool:
        tb = self.gate.tb or (int(num[0]), int(den[0]))
        if (num != tb[0]).any() or (den != tb[1]).any() or (pts[1:] < pts[:-1]).any() or pts[-1] >= LIMIT:
            return False
        if self.gate.last is not None and pts[0] < self.gate.last:
            return False
        self.gate.tb, self.gate.last = tb, int(pts[-1])
        return True

    def _one_by_one(self, done: pa.RecordBatch, rest: pa.RecordBatch) -> pa.RecordBatch:
        times = []
        for s, *time in zip(*(rest.column(c).to_pylist() for c in ("stream_id", "pts", "tb_num", "tb_den")), strict=True):
            if (s, None) != self.stream:
                self.gate, self.stream = Admission(), (s, None)
            times.append((self.gate.pts(*time), *self.gate.tb))
        live = [i for i, t in enumerate(times) if t[0] is not None]
        rest = rest.take(pa.array(live, pa.int64()))
        for k, name in enumerate(("pts", "tb_num", "tb_den")):
            at = rest.schema.get_field_index(name)
            rest = rest.set_column(at, rest.schema.field(at), pa.array([times[i][k] for i in live], rest.schema.field(at).type))
        return pa.Table.from_batches([done, rest]).combine_chunks().to_batches()[0] if done.num_rows and live else rest if live else done


#: Rows of packed runs: the first seq of each and its columns in Arrow's stream format.
PACKED = "stream_id long, seq long, packed binary"


class Pack:
    """What a fold needs of a run of frames: columns, each a feature or CARRIED column or made from the others, of the rows
    that matter. ``columns(part, made)`` gives them as arrays of the whole run, ``matter(columns)`` tells which rows do;
    the first and last row of a run always count, as what lies before and after them is not at hand."""

    def __init__(self, columns, matter=None):
        self.columns, self.matter = columns, matter

    def packed(self, part: dict[str, pa.Array], made: dict, own: np.ndarray | None) -> pa.RecordBatch | None:
        cols = self.columns(part, made)
        n = len(part["seq"])
        keep = np.ones(n, bool) if self.matter is None else self.matter(cols).copy()
        keep[0] = keep[-1] = True
        if own is not None:
            keep &= own
        if not keep.any():
            return None
        batch = pa.record_batch(cols)
        if not keep.all():
            batch = batch.filter(pa.array(keep))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        first = int(np.argmax(keep))
        return pa.record_batch(
            {"stream_id": part["stream_id"].slice(first, 1), "seq": part["seq"].slice(first, 1), "packed": pa.array([sink.getvalue().to_pybytes()], pa.binary())}
        )


def compute_features(
    frames: DataFrame,
    wanted: tuple[str, ...],
    bins: int = 256,
    bins_hsv: tuple[int, int] = (256, 256),
    hash_size: int = 16,
    lowpass: int = 2,
    kernel: int | None = None,
    staged: SelectOptions | None = None,
    extractors: tuple[str, ...] = EXTRACTORS,
    reset_all: bool = False,
    luma_only: bool = False,
    chunk: int | None = None,
    extra: tuple[str, ...] = (),
    kernel_adaptive: int | None = None,
    longest: int | None = None,
    admit: bool = False,
    pack: Pack | None = None,
) -> DataFrame:
    """Per frame: stream_id, seq, pts, tb_num, tb_den, width, height, and the ``wanted`` COLUMNS.

    Features that compare a frame with the one before are null on a stream's first frame; after a change of size those
    of planes are null too, and with ``reset_all`` those of histograms and hashes. ``chunk``: streams are cut after
    so many of their ``seq`` (which must then count up by one), each piece with the frame before it, and spread over
    tasks. Frames are read with only the views that the features need. Features without a lag need no shuffle.

    ``longest``: frames are scaled down to that longest side first (the selector's thresholds are made for 256); width
    and height stay those of the frame. ``admit``: times become those of the stream's first timebase, and frames out of
    order or at the limit are left out, within the same pass; it needs whole streams, so no ``chunk``.

    Frames in pieces (with the columns PIECES, as ``sources.frames.lineitem_pieces`` makes them) aren't shuffled: each
    piece lies sorted in one partition, after the frame before it. Their times must be admissible as they are.
    ``pack``: what a fold needs of each run of frames, as :func:`kinoflow.operators.fold.fold_packed` takes it.
    """
    if admit and chunk:
        raise ValueError("admission needs whole streams")
    unknown = set(wanted) - set(COLUMNS)
    if unknown:
        raise ValueError(f"no such feature: {', '.join(sorted(unknown))}")
    lagged = {w for w in wanted if w.startswith(("corr_", "d_")) or w == "phash_distance"}
    have = set(frames.columns)
    pieces = {"of", "only_before"} <= have
    if pieces and chunk:
        raise ValueError("frames in pieces have their chunks")
    views = [c for c in ("rgb", "rgb_stride", "channel_order", "luma", "luma_stride", "hue", "sat", "val", "hsv_stride") if c in have]
    rows = frames.select(*CARRIED, *[c for c in extra if c not in CARRIED], *views, *(("of", "only_before") if pieces else ()))
    if pieces:
        pass
    elif lagged and chunk:
        piece = F.floor(F.col("seq") / chunk)
        both = F.array(F.struct(piece.alias("of"), F.lit(False).alias("only_before")), F.struct((piece + 1).alias("of"), F.lit(True).alias("only_before")))
        rows = rows.withColumn("_p", F.explode(F.when((F.col("seq") + 1) % chunk == 0, both).otherwise(F.slice(both, 1, 1))))
        rows = rows.select("*", "_p.of", "_p.only_before").drop("_p")
        rows = rows.repartition("stream_id", "of").sortWithinPartitions("stream_id", "of", "seq")
    elif lagged or admit or pack:
        rows = rows.repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    kept = [*CARRIED, *[c for c in extra if c not in CARRIED]]
    kinds = dict(frames.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in kept), *(f"{w} {COLUMNS[w]}" for w in wanted)])
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    args = (wanted, bins, bins_hsv, hash_size, lowpass, kernel, staged, extractors, reset_all, luma_only, kernel_adaptive, longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, group, gate = FeatureMaker(*args), None, Gate(pieces)
        for whole in batches:
            step = max(1, min(2048, STACK * whole.num_rows // max(whole.nbytes, 1)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                if admit:
                    batch = gate.admitted(batch)
                if not batch.num_rows:
                    continue
                data = dict(zip(batch.schema.names, batch.columns, strict=True))
                for begin, end in runs_of(data):
                    part = {k: v.slice(begin, end - begin) for k, v in data.items()}
                    key = first_of(part["stream_id"]), first_of(part["of"]) if "of" in part else None
                    if pieces and key != group and key[1] and not first_of(part["only_before"]):
                        raise ValueError("a piece lacks the frame before it")
                    made = maker.arrays(part, fresh=key != group)
                    group = key
                    own = None
                    if "only_before" in part:
                        skip = part["only_before"].to_numpy(zero_copy_only=False)
                        own = ~skip if skip.any() else None
                    if pack:
                        done = pack.packed(part, made, own)
                        if done is not None:
                            yield done
                        continue
                    cols = [part[f.name] if f.name in part and f.name not in made else as_arrow(made[f.name], f.type) for f in arrow]
                    out = pa.record_batch(cols, schema=arrow)
                    yield out if own is None else out.filter(pa.array(own))

    return rows.mapInArrow(run, PACKED if pack else schema)
