"""Streams in pieces, packed runs of features, and results that mustn't depend on how sums are ordered."""

import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from kinoflow.functions import kernels as K
from kinoflow.functions.columns import METRICS
from kinoflow.operators import cascade, detectors
from kinoflow.operators.features import compute_features
from kinoflow.operators.gates import FlashFilter
from kinoflow.options import AdaptiveOptions, ContentOptions, HistogramOptions, SceneOptions, SelectOptions, ThresholdOptions
from kinoflow.plans import queries
from kinoflow.plans.machine_oracles import EMB
from kinoflow.plans.registry import ORACLES, QUERIES
from kinoflow.sources import frames as S

MS = 1_000_000


def test_hash_bits_at_the_median_are_those_of_double_precision():
    """Frames of the embeddings whose two middle coefficients single precision takes for equal, or in the wrong order."""
    frames = (
        "80738b894f7874577f90869487b06887a49b557c7d7f90718e72884f9d7b7c98837a625c7b9d6c5a9aa6945e96a68b607aa2763c723e8f886584aca4676f7199",
        "93956c7c9174b47f637b7a3885b3926579a3715d7252ae618b957385707f79936e7a5c8a8e777679b56682856969486f628b79d19a8094878c8f8a7f7373a76f",
        "b4b16361746f78495d6b77a07c6884918c99618750b3796b91815e638c839169448764715d6a78976b87aa93898f73746773838c6d7d8f6b98a89059a45b5697",
        "94836945998e69722f71886a6ba07677607a89545b79a38b6d887b628e588aac91537c7b897290947c9875955c897f9c6579649f8c7c7f67963d9876bd858f85",
    )
    planes = np.stack([np.frombuffer(bytes.fromhex(f), np.uint8).reshape(8, 8) for f in frames])
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    for i, p in enumerate(planes):
        con.execute("INSERT INTO embeddings VALUES (?, ?)", [8 * i, ((p.reshape(-1) + 0.5) * 1.2 / 255 - 0.6).tolist()])
    want = con.execute(f"WITH {EMB} SELECT seq, k, b FROM bt ORDER BY seq, k").fetchall()
    got = np.unpackbits(K.phash(planes, 6, 1).view(np.uint8), axis=1, bitorder="little")[:, :36]
    assert [b for _, _, b in want] == got.reshape(-1).astype(bool).tolist()


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


def in_small_pieces(spark, sf, monkeypatch, name):
    """(rows of the query over pieces of a few frames, rows of its SQL)."""
    monkeypatch.setattr(S, "SPAN", 200)
    monkeypatch.setattr(queries, "PART_BITS", 9)
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in names) for r in df.collect()], key=repr)
    return got, sorted([tuple(map(plain, r)) for r in con.sql(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall()], key=repr)


@pytest.mark.parametrize(
    "name", ["hist_cuts", "content_cuts_suppress", "content_cuts_merge", "content_cuts_default", "adaptive_cuts_frames", "fade_cuts_gated", "edge_delta", "cascade_scenes", "cascade_keyframes",
     "keyframes_remaining", "scene_assoc", "keyframe_choice"],
)
def test_small_pieces_give_the_same_rows(spark, sf, monkeypatch, name):
    got, want = in_small_pieces(spark, sf, monkeypatch, name)
    assert got and got == want


@pytest.mark.parametrize("name", ["mean_abs_diff", "hist_correlation", "content_score", "content_score_edges", "plane_correlations", "phash_distance", "edge_delta"])
def test_planes_of_derived_frames_are_not_shuffled(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2  # the frames are drawn and looked at in one stage
    assert "Exchange" not in plan[: plan.rindex("MapInArrow")]


def test_streams_are_numbered_by_more_than_one_task(spark, sf):
    plan = S.lineitem_rows(spark, sf)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number()" in line and "Window" in line]
    assert windows and all("_piece" in line for line in windows)


@pytest.mark.parametrize("name", ["hist_cuts", "hist_cuts_default", "content_cuts_suppress", "content_cuts_merge", "content_cuts_default", "adaptive_cuts_frames", "fade_cuts_gated"])
def test_only_packed_runs_go_to_the_tasks_of_whole_streams(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    by_stream = [line for line in plan.splitlines() if "Exchange hashpartitioning(stream_id" in line and "_piece" not in line]
    assert len(by_stream) == 2  # packed runs, and the counts of pieces
    assert "Window" not in plan[: plan.index("MapInArrow", plan.index("packed"))].split("MapInArrow", 2)[1]


def test_a_piece_without_the_frame_before_it_is_refused(spark, sf):
    cut = S.lineitem_pieces(spark, sf).where("not only_before")
    assert compute_features(cut, ("luma_mean",)).count() > 0
    rows = cut.withColumn("of", cut.seq - 1)
    with pytest.raises(Exception, match="lacks the frame before it"):
        compute_features(rows, ("d_lum",)).collect()


def test_rows_left_out_don_t_change_the_flash_filter():
    rng = np.random.default_rng(5)
    for k in range(300):
        n = int(rng.integers(1, 80))
        pts = np.cumsum(rng.choice([0, 40, 40, 40, 400], n))
        score, there = rng.choice([0.0, 50.0], n, p=[p := rng.uniform(0.1, 0.9), 1 - p]), rng.random(n) < 0.95
        options = ContentOptions(min_duration=200 * MS, filter_mode=("merge", "suppress")[k % 2], initial_cut=bool(k % 3))
        rows = [{"pts": int(t), "tb_num": 1, "tb_den": 1000, "score": float(v) if at else None} for t, v, at in zip(pts, score, there)]
        whole, thin, kept = FlashFilter(options), FlashFilter(options), 0
        want = [c for row in rows for c in whole.push(row)]
        got, at = [], 0
        while at < n:
            end = min(n, at + int(rng.integers(1, 30)))
            cols = {"pts": pa.array(pts[at:end]), "tb_num": pa.array(np.full(end - at, 1)), "tb_den": pa.array(np.full(end - at, 1000))}
            keep = detectors.flash_rows(score[at:end], there[at:end], cols, options)
            keep[0] = keep[-1] = True
            got += [c for row, live in zip(rows[at:end], keep) if live for c in thin.push(row)]
            kept, at = kept + keep.sum(), end
        assert got == want


def lane_run(rng, n, start):
    """Arrays of a run of frames as the lanes see them."""
    at = lambda p: (rng.random(n), rng.random(n) < p)
    made = {c: at(0.97) for c in ("corr_luma", "corr_sat", "phash_distance")}
    there = rng.random(n) < 0.97
    made |= {c: (np.round(rng.choice([2.0, 40.0, 90.0], n) * rng.random(n), 3), there) for c in ("d_hue", "d_sat", "d_lum", "d_edges")}
    made["luma_mean"] = rng.choice([10.0, 150.0], n, p=[0.2, 0.8])
    made |= {m: (rng.random(n) * 200).astype(np.float32) for m in METRICS}
    made["clipping"], made["motion_blur"] = (rng.random(n).astype(np.float32) for _ in range(2))
    pts = start + np.cumsum(rng.choice([0, 40, 40, 40, 40, 300], n))
    size = 8 if rng.random() < 0.9 else 6
    part = {"pts": pa.array(pts), "seq": pa.array(pts), "stream_id": pa.array(pts)}
    return part | {c: pa.array(np.full(n, v, np.int32)) for c, v in (("tb_num", 1), ("tb_den", 1000), ("width", size), ("height", 8))}, made


def test_machine_run_by_run_equals_frame_by_frame():
    """Random lanes, least durations and caps; the plain machine is pushed every frame with all its columns."""
    rng, events = np.random.default_rng(11), 0
    for k in range(120):
        ms = lambda top: int(rng.integers(0, top)) * MS
        first = lambda: {"min_duration": ms(1500), "initial_cut": bool(rng.random() < 0.6)}
        lanes = [x for x in ("threshold", "luma_histogram", "sat_histogram", "phash", "content", "adaptive") if rng.random() < 0.6] or ["content"]
        o = SceneOptions(
            lanes=tuple(lanes), threshold=ThresholdOptions(threshold=100, add_final_scene=bool(k % 2), **first()),
            luma_histogram=HistogramOptions(threshold=0.8, **first()), sat_histogram=HistogramOptions(threshold=0.9, **first()),
            content=ContentOptions(weights=(1, 0.3, 0.7, k % 3), **first()), adaptive=AdaptiveOptions(adaptive_threshold=1.5, weights=(1, 1, 1, k % 2), **first()),
            max_scene_duration=[None, 700 * MS, 3000 * MS][k % 3],
            select=SelectOptions(target_interval=max(1, ms(2000)), min_sharpness=120.0, adaptive_min_samples=3, black_mean=20.0, max_clipping=0.9),
        )
        pack = cascade.packed_lanes(o)
        plain_machine, runs, want, got, start = cascade.SceneMachine(o), cascade.SceneMachine(o), [], [], 0
        for _ in range(int(rng.integers(1, 6))):
            n = int(rng.integers(1, 120))
            part, made = lane_run(rng, n, start)
            start = part["pts"][-1].as_py()
            lists = {c: v.to_pylist() for c, v in part.items()} | {c: v[0].tolist() if isinstance(v, tuple) else v.tolist() for c, v in made.items()}
            known = {c: v[1] for c, v in made.items() if isinstance(v, tuple)}
            for i in range(n):
                want += plain_machine.push({c: v[i] if c not in known or known[c][i] else None for c, v in lists.items()})
            got += runs.push_batch(pa.record_batch(pack.columns(part, made)))
        want, got = want + plain_machine.finish(), got + runs.finish()
        assert got == want, k
        events += len(got)
    assert events > 5000


def test_scenes_alone_are_those_among_all_events(spark, sf):
    frames = S.lineitem_pieces(spark, sf).where("stream_id < 4")
    names = ["stream_id", "start_pts", "end_pts", "provenance", "score"]
    o = SceneOptions(luma_histogram=HistogramOptions(bins=16), max_scene_duration=2000 * MS)
    both = [sorted(map(str, cascade.scene_events(frames, o, keyframes=k).where("event_kind = 'scene'").select(names).collect())) for k in (True, False)]
    assert both[0] and both[0] == both[1]


@pytest.mark.parametrize("name", ["cascade_scenes", "cascade_keyframes", "cascade_events"])
def test_the_scene_machine_gets_packed_runs(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3 and "packed" in plan
    assert len([line for line in plan.splitlines() if "Exchange hashpartitioning(stream_id" in line and "_piece" not in line]) == 2


def test_joined_views_carry_no_planes_that_nobody_asked_for(spark, sf):
    plan = QUERIES["views_join"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("MapInArrow") == 3  # each view is made once
    lines = plan.splitlines()
    shuffled = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning(stream_id" in line and ", seq" in line]
    assert len(shuffled) == 3 and all("octet_length" in line for line in shuffled)
    assert not any(f", {p}#" in line for line in shuffled for p in ("rgb", "luma", "hue", "sat", "val"))


@pytest.mark.parametrize("name", ["scene_assoc", "keyframe_choice", "effective_floor"])
def test_frames_meet_their_shots_in_parts_of_streams(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "last(shot" in line and "Window" in line]
    assert windows and all("_part" in line for line in windows)


def test_whole_streams_give_their_keyframes_to_one_look_at_each_frame(spark, sf, monkeypatch):
    """As the relational choice does, with more good frames than are sampled, and with a floor that lies below the least."""
    from kinoflow.operators import keyframes, remaining

    for o in (queries.SELECT, queries.SELECT.replace(min_sharpness=1e6, margin_ratio=0.1), queries.SELECT.replace(adaptive_floor=False, target_interval=7000 * MS)):
        for samples in (4096, 50):
            monkeypatch.setattr(keyframes, "SAMPLES", samples)
            monkeypatch.setattr(remaining, "SAMPLES", samples)
            frames = S.lineitem_frames(spark, sf).where("stream_id < 5")
            want = keyframes.select_remaining(compute_features(frames, METRICS), o).select("stream_id", "bucket", "pts", "strict", "quality")
            got = remaining.remaining_keyframes(S.lineitem_pieces(spark, sf).where("stream_id < 5"), o)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = QUERIES["keyframes_remaining"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3
