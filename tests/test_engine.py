"""The engine on Spark: oracles, batch against streaming, chunks against whole streams, checks of frames."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinoflow.functions import columns as C
from kinoflow.operators import cascade, detectors, features, keyframes
from kinoflow.operators.cascade import SceneMachine, Selector
from kinoflow.options import AdaptiveOptions, ContentOptions, HistogramOptions, PhashOptions, SceneOptions, SelectOptions, ThresholdOptions
from kinoflow.plans.queries import shots
from kinoflow.plans.registry import ORACLES, QUERIES
from kinoflow.sources import frames as S
from kinoflow.timebase import Timebase

MS = 1_000_000


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    assert names == sorted(con.sql(ORACLES[name]).columns)
    got = sorted([tuple(plain(r[c]) for c in names) for r in df.collect()], key=repr)
    want = sorted([tuple(map(plain, r)) for r in con.sql(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall()], key=repr)
    assert got and got == want


def test_every_frame_has_a_scene(spark, sf):
    got = [tuple(r) for r in QUERIES["scene_assoc"](spark, sf).select("stream_id", "pts").collect()]
    want = [tuple(r) for r in S.lineitem_rows(spark, sf).select("stream_id", "pts").collect()]
    assert sorted(got) == sorted(want)


def test_chunks_equal_whole_streams(spark, sf):
    frames = S.lineitem_frames(spark, sf)
    wanted = ("corr_luma", "phash_distance", "d_hue", "d_edges", "luma_mean")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(features.compute_features(frames, wanted, chunk=50)) == key(features.compute_features(frames, wanted))


def test_planes_aren_t_read_when_unused(spark, sf, tmp_path):
    path = str(tmp_path / "frames")
    S.lineitem_frames(spark, sf).limit(300).write.parquet(path)
    plan = S.read_frames(spark, path).select("stream_id", "luma")._jdf.queryExecution().toString()
    assert "rgb" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert features.compute_features(S.read_frames(spark, path), ("luma_mean",)).count() == 300


def picture(spark, rows):
    """rows: (stream, seq, pts, width, height, luma array or None, rgb array or None)."""
    out = []
    for s, q, p, w, h, luma, rgb in rows:
        raw = lambda x: None if x is None else np.ascontiguousarray(x, np.uint8).tobytes()
        out.append((s, q, p, 1, 1000, w, h, raw(rgb), w * 3, "rgb", raw(luma), w, None, None, None, w))
    return spark.createDataFrame(out, S.FRAMES)


def test_resize_restarts_plane_deltas_only(spark):
    rng = np.random.default_rng(0)
    sizes = [(8, 8)] * 3 + [(6, 4)] * 2
    rows = [(1, i, i * 40, w, h, rng.integers(0, 256, (h, w)), None) for i, (w, h) in enumerate(sizes)]
    wanted = ("d_lum", "corr_luma", "phash_distance")
    got = features.compute_features(picture(spark, rows), wanted, luma_only=True).orderBy("seq").collect()
    assert [r["d_lum"] is None for r in got] == [True, False, False, True, False]
    assert [r["corr_luma"] is None for r in got] == [True, False, False, False, False]
    got = features.compute_features(picture(spark, rows), wanted, luma_only=True, reset_all=True).orderBy("seq").collect()
    assert [r["phash_distance"] is None for r in got] == [True, False, False, True, False]


def test_column_forms_equal_kernels(spark, sf):
    frames = S.lineitem_frames(spark, sf)
    rows = features.compute_features(frames, ("hist_luma", "corr_luma", "phash", "phash_distance"), bins=16)
    by = detectors.by_seq()
    rows = rows.withColumns({"before": F.lag("hist_luma").over(by), "code": F.lag("phash").over(by)}).where("before is not null")
    rows = rows.select("corr_luma", "phash_distance", C.correlation(F.col("hist_luma"), F.col("before")).alias("c"), (C.hamming(F.col("phash"), F.col("code")) / 256).alias("h"))
    for r in rows.limit(500).collect():
        assert r["c"] == pytest.approx(r["corr_luma"], abs=1e-12) and r["h"] == r["phash_distance"]
    a = spark.createDataFrame([([1, 5], [4, 5]), ([], [])], "a array<int>, b array<int>").select(C.mean_abs_diff(F.col("a"), F.col("b")).alias("d")).collect()
    assert a[0]["d"] == 1.5 and np.isnan(a[1]["d"])


def test_detectors_run(spark, sf):
    frames = S.lineitem_frames(spark, sf)
    assert detectors.phash_cuts(frames, PhashOptions(min_duration=0)).count() > 0
    assert detectors.phash_cuts(frames, PhashOptions()).count() > 0
    assert detectors.frame_fades(frames, ThresholdOptions(threshold=30)).count() > 0
    assert detectors.frame_fades(frames, ThresholdOptions(threshold=100, min_duration=0), rgb=True).count() > 0
    scored = detectors.content_scores(frames, (1, 1, 1, 1))
    free = AdaptiveOptions(min_duration=0, adaptive_threshold=1.2)
    assert detectors.adaptive_cuts(scored, free.replace(min_duration=400 * MS)).count() < detectors.adaptive_cuts(scored, free).count()
    # one rule, as a window and as a fold
    means = S.event_series(spark, sf).withColumnRenamed("value", "mean")
    for o in (ThresholdOptions(min_duration=0, fade_bias=0.5, add_final_scene=True), ThresholdOptions(min_duration=0, method="ceiling", threshold=40)):
        wide = sorted((r["stream_id"], r["pts"]) for r in detectors.fade_cuts(means, o).collect())
        fold = sorted((r["stream_id"], r["pts"]) for r in detectors.fade_cuts(means, o.replace(min_duration=1)).collect())
        assert wide == fold and wide


def test_frame_checks(spark):
    good = (1, 0, 0, 1, 1000, 2, 2, None, 6, "rgb", b"1234", 2, None, None, None, 2)
    change = lambda **k: tuple(k.get(n, v) for n, v in zip([x.split()[0] for x in S.FRAMES.split(", ")], good, strict=True))
    cases = {
        None: good, "StrideTooSmall": change(luma_stride=1), "DataTooShort": change(luma=b"123"), "ZeroDimensions": change(width=0),
        "ZeroTimebase": change(tb_num=0), "FrameTooLarge": change(width=2000, height=2000, luma=None, luma_stride=2000),
        "WidthOverflow": change(width=(1 << 31) - 1, luma=None, rgb=b"x"), "PlaneTooShort:saturation": change(hue=b"1234", sat=b"1", val=b"1234"),
    }
    for error, row in cases.items():
        frame = spark.createDataFrame([row], S.FRAMES)
        ok, bad = S.checked(frame)
        assert (ok.count(), [r["error"] for r in bad.collect()]) == ((1, []) if error is None else (0, [error]))


def test_join_views(spark):
    cols = "stream_id long, seq long, pts long, tb_num int, tb_den int, width int, height int"
    rgb = spark.createDataFrame([(1, i, 40 * i, 1, 1000, 1, 1, b"abc", 3, "rgb") for i in range(4)], cols + ", rgb binary, rgb_stride int, channel_order string")
    luma = spark.createDataFrame([(1, 0, 0, 1, 25, 1, 1, b"a", 1), (1, 1, 1, 1, 25, 1, 1, b"a", 1), (1, 2, 9, 1, 25, 1, 1, b"a", 1), (1, 3, 3, 1, 25, 2, 1, b"ab", 2)], cols + ", luma binary, luma_stride int")
    hsv = spark.createDataFrame([(1, i, 40 * i, 1, 1000, 1, 1, b"a", b"b", b"c", 1) for i in range(4)], cols + ", hue binary, sat binary, val binary, hsv_stride int")
    good, bad = S.join_views(rgb, luma, hsv)
    assert sorted(r["seq"] for r in good.collect()) == [0, 1]
    assert {r["seq"]: r["error"] for r in bad.collect()} == {2: "TimestampMismatch", 3: "DimensionMismatch"}


def test_raw_planes(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.raw").write_bytes(bytes([i * 50] * 12))
    got = features.compute_features(S.read_raw_planes(spark, f"{tmp_path}/*.raw", 4, 3), ("luma_mean",)).orderBy("seq").collect()
    assert [(r["pts"], r["luma_mean"]) for r in got] == [(0, 0.0), (1, 50.0), (2, 100.0)]


def test_canonical_times(spark):
    rows = [(1, 0, 0, 1, 1000), (1, 1, 1, 1, 25), (1, 2, 39, 1, 1000), (1, 3, 1001, 1, 30000), (1, 4, (1 << 63) - 1, 1, 1000), (1, 5, 2, 1, 1)]
    df = spark.createDataFrame(rows, "stream_id long, seq long, pts long, tb_num int, tb_den int")
    got = S.canonical_pts(df).orderBy("seq").collect()
    assert [(r["pts"], r["rejected"]) for r in got] == [(0, None), (40, None), (39, "OutOfOrder"), (34, "OutOfOrder"), (None, "TimestampAtLimit"), (2000, None)]


def scene_rows(spark, sf):
    return cascade.scene_events(S.lineitem_frames(spark, sf), SceneOptions(luma_histogram=HistogramOptions(bins=16)))


def test_scenes_tile_and_hold_their_keyframes(spark, sf):
    rows = sorted(scene_rows(spark, sf).collect(), key=lambda r: (r["stream_id"], r["out_seq"]))
    spans = {}
    for r in rows:
        if r["event_kind"] == "scene":
            spans.setdefault(r["stream_id"], []).append((r["start_pts"], r["end_pts"]))
    assert len(spans) == 16
    for found in spans.values():
        assert all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False)) and all(a < b for a, b in found)
        assert found[0][0] == 40
    for r in rows:
        if r["event_kind"] == "keyframe":
            assert any(a <= r["pts"] < b for a, b in spans[r["stream_id"]])
    again = scene_rows(spark, sf).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_rejected_frames(spark):
    rows = [(1, i, p, 4, 4, np.full((4, 4), 9), None) for i, p in enumerate((0, 40, 20, 80))] + [(1, 9, 120, 0, 0, np.zeros((0, 0)), None)]
    frames = picture(spark, rows)
    assert sorted((r["seq"], r["error"]) for r in cascade.rejected_frames(frames).collect()) == [(2, "OutOfOrder"), (9, "ZeroDimensions")]


def test_selector_equals_windows(spark, sf):
    """The relational keyframe choice and the machine's, shot by shot."""
    o = SelectOptions(target_interval=80 * MS, min_sharpness=4000.0, adaptive_min_samples=3, black_mean=40.0, luma_variance=120.0, sat_variance=900.0)
    m = features.compute_features(S.lineitem_frames(spark, sf), C.METRICS)
    made = keyframes.select_keyframes(m, shots(spark, sf), o)
    got = sorted((r["stream_id"], r["start_pts"], r["pts"], r["strict"]) for r in made.collect())
    by = {}
    for r in sorted(m.collect(), key=lambda r: (r["stream_id"], r["seq"])):
        by.setdefault(r["stream_id"], []).append((r["pts"], {n: r[n] for n in C.METRICS}))
    want = []
    for s in sorted(shots(spark, sf).collect(), key=lambda s: (s["stream_id"], s["start_pts"])):
        selector = Selector(o, Timebase(1, 1000))
        for pts, metrics in by[s["stream_id"]]:
            if s["start_pts"] <= pts < s["end_pts"]:
                selector.observe(pts, metrics)
        want += [(s["stream_id"], s["start_pts"], p, strict) for p, _, strict in selector.finalize_shot(s["start_pts"], s["end_pts"])]
    assert got == sorted(want) and {x[3] for x in got} == {True, False}


@pytest.fixture(scope="module")
def lanes(spark, sf):
    o = SceneOptions(luma_histogram=HistogramOptions(bins=16))
    df = cascade.lane_features(S.lineitem_frames(spark, sf).where("stream_id < 3 and seq <= 120"), o)
    return o, df.toPandas()


def streamed(spark, tmp_path, table, make, parts=3):
    """Feeds the rows in ``parts`` files, one a batch, the last with the end marks."""
    schema = spark.createDataFrame(table.head(1)).schema
    src = tmp_path / "in"
    src.mkdir()
    bounds = np.quantile(table["seq"], np.linspace(0, 1, parts + 1)[1:])
    bounds[-1] = np.inf
    low = -np.inf
    for i, high in enumerate(bounds):
        part = table[(table["seq"] > low) & (table["seq"] <= high)]
        spark.createDataFrame(part.sample(frac=1, random_state=1), schema).coalesce(1).write.parquet(str(src / f"p{i}"))
        low = high
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    name = f"t{abs(hash(str(tmp_path)))}"
    query = make(rows).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def with_end(table):
    import pandas as pd

    table = table.assign(eos=False)
    end = table.groupby("stream_id").tail(1).assign(seq=lambda x: x["seq"].max() + 1, eos=True)
    return pd.concat([table, end])


def test_streaming_scenes_equal_batch(spark, lanes, tmp_path):
    from kinoflow.streaming.stateful import stream_scene_events

    o, table = lanes
    table = table.astype({c: "float64" for c in table.columns if table[c].dtype == "float32"})
    got = streamed(spark, tmp_path, with_end(table), lambda rows: stream_scene_events(rows, o))
    want = []
    for s, part in table.sort_values("seq").groupby("stream_id"):
        machine = SceneMachine(o)
        for row in part.to_dict("records"):
            row = {k: None if isinstance(v, float) and v != v else v for k, v in row.items()}
            want += [e | {"stream_id": s} for e in machine.push(row)]
        want += [e | {"stream_id": s} for e in machine.finish()]
    key = lambda r: (r["stream_id"], r["out_seq"], r["event_kind"], r["provenance"])
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(want) > 9


@pytest.fixture(scope="module")
def pictures(spark, sf):
    """The first frames of three streams, as a table; seq by arrival."""
    return S.lineitem_frames(spark, sf).where("stream_id < 3 and seq <= 90")


def frames_with_end(spark, frames):
    end = frames.groupBy("stream_id").agg((F.max("seq") + 1).alias("seq"), F.lit(True).alias("eos"))
    return S.with_all_columns(spark, frames).withColumn("eos", F.lit(False)).unionByName(end, allowMissingColumns=True)


def feed(spark, tmp_path, frames, make, cuts=(31, 62)):
    """The frames in batches of their seq, each batch in one file."""
    src = tmp_path / "in"
    src.mkdir(parents=True)
    table = frames_with_end(spark, frames)
    bounds = [-1, *cuts, 1 << 40]
    for i, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        part = table.where((F.col("seq") > low) & (F.col("seq") <= high)).orderBy(F.xxhash64("seq"))
        part.coalesce(1).write.parquet(str(src / f"p{i}"))
    rows = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    name = f"f{abs(hash(str(tmp_path)))}"
    query = make(rows).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


CASES = {
    "histogram": (HistogramOptions(bins=16, min_duration=200 * MS), detectors.histogram_cuts),
    "phash": (PhashOptions(size=6, lowpass=1, threshold=0.2, min_duration=200 * MS), detectors.phash_cuts),
    "fade": (ThresholdOptions(threshold=100, min_duration=200 * MS, add_final_scene=True), detectors.frame_fades),
    "content": (ContentOptions(weights=(1, 1, 1, 1), min_duration=120 * MS), detectors.content_cuts),
    "adaptive": (AdaptiveOptions(min_duration=200 * MS, adaptive_threshold=2.0), lambda f, o: detectors.adaptive_cuts(detectors.content_scores(f), o)),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_streaming_from_frames_equals_batch(spark, pictures, tmp_path, name):
    """Lag-1 features go on from batch to batch."""
    from kinoflow.streaming.stateful import stream_cuts

    options, batch = CASES[name]
    want = sorted((r["stream_id"], r["pts"]) for r in batch(pictures, options).collect())
    got = feed(spark, tmp_path, pictures, lambda rows: stream_cuts(rows, options))
    assert sorted((r["stream_id"], r["pts"]) for r in got) == want and want


def test_streaming_scenes_from_frames(spark, pictures, tmp_path):
    """Every event of the batch; an early frame and a late one come out as rejects and change nothing."""
    from kinoflow.streaming.stateful import stream_scenes

    o = SceneOptions(lanes=("threshold", "luma_histogram", "content", "adaptive"), luma_histogram=HistogramOptions(bins=16),
                     threshold=ThresholdOptions(threshold=100), max_scene_duration=1000 * MS)
    early = pictures.where("seq = 40").withColumns({"seq": F.lit(95).cast("long"), "pts": F.lit(40).cast("long")})
    want = cascade.scene_events(pictures, o).collect()
    got = feed(spark, tmp_path, pictures.unionByName(early), lambda rows: stream_scenes(rows, o, rejects=True))
    key = lambda r: (r["stream_id"], r["out_seq"], r["event_kind"], r["pts"], r["start_pts"], r["end_pts"], r["provenance"])
    assert sorted(map(str, map(key, (r for r in got if r["rejected"] is None)))) == sorted(map(str, map(key, want)))
    assert sorted((r["stream_id"], r["pts"], r["rejected"]) for r in got if r["rejected"]) == [(s, 40, "OutOfOrder") for s in range(3)]
    again = cascade.scene_events(pictures.unionByName(early), o, chunk=20).collect()
    assert sorted(map(str, map(key, again))) == sorted(map(str, map(key, want)))


def test_streaming_slack_and_late_rows(spark, tmp_path):
    """With slack, rows may come in a later batch; rows later still are told apart."""
    from kinoflow.streaming.stateful import stream_spaced

    batches = [[1, 2, 5, 6], [3, 4, 8, 12], [1, 7, 13]]
    schema = "stream_id long, seq long, pts long, score double, candidate boolean, eos boolean"
    src = tmp_path / "in"
    src.mkdir()
    for i, seqs in enumerate(batches):
        rows = [(1, q, q * 40, 0.0, True, False) for q in seqs] + ([(1, 99, 0, 0.0, False, True)] if i == 2 else [])
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"p{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    made = stream_spaced(stream, HistogramOptions(min_duration=0), slack=3, rejects=True)
    query = made.writeStream.format("memory").queryName("slacked").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.sql("SELECT * FROM slacked").collect()
    assert sorted(r["pts"] // 40 for r in got if not r["rejected"]) == [1, 2, 3, 4, 5, 6, 8, 12, 13]
    assert sorted(r["pts"] // 40 for r in got if r["rejected"] == "Late") == [1, 7]


def test_streaming_gates_equal_batch(spark, sf, tmp_path):
    from kinoflow.streaming.stateful import stream_content_cuts, stream_fades, stream_spaced

    means = S.event_series(spark, sf).withColumnRenamed("value", "mean")
    o = ThresholdOptions(min_duration=300 * MS, add_final_scene=True)
    want = sorted((r["stream_id"], r["pts"]) for r in detectors.fade_cuts(means, o).collect())
    (tmp_path / "a").mkdir()
    got = streamed(spark, tmp_path / "a", with_end(means.toPandas()), lambda rows: stream_fades(rows, o))
    assert sorted((r["stream_id"], r["pts"]) for r in got) == want and want
    scored = means.withColumn("score", F.abs(F.col("mean") - F.lag("mean").over(detectors.by_seq()))).select("stream_id", "seq", "pts", "score")
    c = ContentOptions(threshold=20.0, min_duration=120 * MS)
    want = sorted((r["stream_id"], r["pts"]) for r in detectors.flash_filtered(scored, c).collect())
    (tmp_path / "b").mkdir()
    got = streamed(spark, tmp_path / "b", with_end(scored.toPandas()), lambda rows: stream_content_cuts(rows, c))
    assert sorted((r["stream_id"], r["pts"]) for r in got) == want and want
    h = HistogramOptions(min_duration=120 * MS)
    marked = scored.withColumn("candidate", F.coalesce(F.col("score") > 30, F.lit(False)))
    want = sorted((r["stream_id"], r["pts"]) for r in detectors.spaced(marked, h).collect())
    (tmp_path / "c").mkdir()
    got = streamed(spark, tmp_path / "c", with_end(marked.toPandas()), lambda rows: stream_spaced(rows, h))
    assert sorted((r["stream_id"], r["pts"]) for r in got) == want and want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
