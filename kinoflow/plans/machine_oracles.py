"""DuckDB SQL for :mod:`kinoflow.plans.machine_queries`, and for the edge maps."""

from kinoflow.plans.oracles import DHSV, FLOOR, FR, GRAD, HSV, KEEP, METRICS, PX, SHARP, spaced


def corr(source: str, column: str, bins: int, tag: str) -> str:
    """CTEs that end in pc_{tag}: (stream_id, seq, correlation) of histograms of 64 values in ``bins`` bins."""
    return f"""hi_{tag} AS (SELECT stream_id, seq, {column} * {bins} // 256 AS bin, count(*) AS n FROM {source} GROUP BY ALL),
qs_{tag} AS (SELECT stream_id, seq, {bins} * sum(n * n) - 4096 AS aa FROM hi_{tag} GROUP BY ALL),
cr_{tag} AS (SELECT b.stream_id, b.seq, sum(a.n * b.n) AS ab FROM hi_{tag} b LEFT JOIN hi_{tag} a
  ON a.stream_id = b.stream_id AND a.seq = b.seq - 1 AND a.bin = b.bin GROUP BY ALL),
pc_{tag} AS (SELECT c.stream_id, c.seq, round(CASE WHEN y.aa = 0 AND x.aa = 0 THEN CASE WHEN coalesce(ab, 0) > 0 THEN 1 ELSE 0 END
    WHEN y.aa = 0 OR x.aa = 0 THEN 0 ELSE ({bins} * coalesce(ab, 0) - 4096) / (sqrt(x.aa::DOUBLE) * sqrt(y.aa::DOUBLE)) END, 9) AS correlation
  FROM cr_{tag} c JOIN qs_{tag} y USING (stream_id, seq) JOIN qs_{tag} x ON x.stream_id = c.stream_id AND x.seq = c.seq - 1)"""


def merge_cuts(ctes: str, scored: str, gap: int) -> str:
    """The merging flash filter, frame by frame."""
    return f"""WITH RECURSIVE {ctes}, nr AS (SELECT stream_id, pts, above, row_number() OVER (PARTITION BY stream_id ORDER BY pts) AS k FROM ({scored})),
run AS (
  SELECT stream_id, k, pts, CASE WHEN above THEN pts ELSE pts - {gap} END AS last, above AS armed, CAST(NULL AS BIGINT) AS held,
    CASE WHEN above THEN pts END AS cut FROM nr WHERE k = 1
  UNION ALL
  SELECT n.stream_id, n.k, n.pts, CASE WHEN n.above THEN n.pts ELSE r.last END,
    r.armed OR (r.held IS NULL AND n.above AND n.pts - r.last >= {gap}),
    CASE WHEN r.held IS NOT NULL THEN CASE WHEN n.pts - r.last >= {gap} AND NOT n.above AND r.last - r.held >= {gap} THEN NULL ELSE r.held END
      WHEN n.above AND n.pts - r.last < {gap} AND r.armed THEN n.pts END,
    CASE WHEN r.held IS NOT NULL THEN CASE WHEN n.pts - r.last >= {gap} AND NOT n.above AND r.last - r.held >= {gap} THEN r.last END
      WHEN n.above AND n.pts - r.last >= {gap} THEN n.pts END
  FROM run r JOIN nr n ON n.stream_id = r.stream_id AND n.k = r.k + 1)
SELECT stream_id, cut AS pts FROM run WHERE cut IS NOT NULL"""


def _bit(place: str) -> str:
    return f"((st >> ({place})::UBIGINT) & 1::UBIGINT)"


#: Edge maps of 8x8 frames as words of 64 bits, pixel (x, y) at bit 8 y + x. Each sweep visits the inner pixels one by one.
EDGE = f"""{HSV}, vl AS (SELECT stream_id, seq, list(v ORDER BY i) AS p, list(v ORDER BY v) AS o FROM hsv GROUP BY ALL),
th AS (SELECT *, o[33] AS med FROM vl),
cut AS (SELECT stream_id, seq, p, CAST(trunc(greatest((1::REAL - 1::REAL / 3::REAL) * med::REAL, 0)) AS INT) AS low,
  CAST(trunc(least((1::REAL + 1::REAL / 3::REAL) * med::REAL, 255)) AS INT) AS high FROM th),
sb AS (SELECT stream_id, seq, low, high, c - 1 AS loc,
    p[c - 7] + 2 * p[c + 1] + p[c + 9] - p[c - 9] - 2 * p[c - 1] - p[c + 7] AS gx,
    p[c + 7] + 2 * p[c + 8] + p[c + 9] - p[c - 9] - 2 * p[c - 8] - p[c - 7] AS gy
  FROM cut, (SELECT yy * 8 + xx + 1 AS c FROM range(1, 7) u(yy), range(1, 7) w(xx))),
mg AS (SELECT stream_id, seq, low, high, loc, abs(gx) + abs(gy) AS m, CASE WHEN 1000 * abs(gy) < 414 * abs(gx) THEN 1
    WHEN 1000 * abs(gy) > 2414 * abs(gx) THEN 8 WHEN sign(gx) = sign(gy) THEN 9 ELSE 7 END AS step FROM sb),
nm AS (SELECT a.stream_id, a.seq, a.loc, a.low, a.high, a.m FROM mg a
  LEFT JOIN mg b ON b.stream_id = a.stream_id AND b.seq = a.seq AND b.loc = a.loc + a.step
  LEFT JOIN mg c ON c.stream_id = a.stream_id AND c.seq = a.seq AND c.loc = a.loc - a.step
  WHERE a.m > 0 AND a.m >= coalesce(b.m, 0) AND a.m >= coalesce(c.m, 0)),
ws AS (SELECT stream_id, seq, coalesce(bit_or(CASE WHEN m >= high THEN 1::UBIGINT << loc::UBIGINT END), 0::UBIGINT) AS st,
    coalesce(bit_or(CASE WHEN m >= low AND m < high THEN 1::UBIGINT << loc::UBIGINT END), 0::UBIGINT) AS wk FROM nm GROUP BY ALL),
allf AS (SELECT fr.stream_id, fr.seq, coalesce(st, 0::UBIGINT) AS st, coalesce(wk, 0::UBIGINT) AS wk FROM fr LEFT JOIN ws USING (stream_id, seq)),
visit AS (SELECT row_number() OVER (ORDER BY sweep, CASE WHEN sweep % 2 = 0 THEN loc ELSE -loc END) AS k, sweep % 2 = 0 AS ahead, loc
  FROM range(4) s(sweep), (SELECT yy * 8 + xx AS loc FROM range(1, 7) u(yy), range(1, 7) w(xx))),
sweep AS (
  SELECT stream_id, seq, st, wk, 0::BIGINT AS k FROM allf
  UNION ALL
  SELECT stream_id, seq, CASE WHEN ((wk >> loc::UBIGINT) & 1::UBIGINT) = 1 AND (CASE WHEN ahead
      THEN {_bit('loc - 9')} | {_bit('loc - 8')} | {_bit('loc - 7')} | {_bit('loc - 1')}
      ELSE {_bit('loc + 9')} | {_bit('loc + 8')} | {_bit('loc + 7')} | {_bit('loc + 1')} END) = 1
    THEN st | (1::UBIGINT << loc::UBIGINT) ELSE st END, wk, visit.k
  FROM sweep JOIN visit ON visit.k = sweep.k + 1),
thin AS (SELECT stream_id, seq, st FROM sweep WHERE k = 144),
pix AS (SELECT stream_id, seq, loc // 8 AS y, loc % 8 AS x FROM thin, range(64) t(loc) WHERE ((st >> loc::UBIGINT) & 1::UBIGINT) = 1),
dil AS (SELECT DISTINCT stream_id, seq, y + dy AS y, x + dx AS x FROM pix, range(-2, 3) a(dy), range(-2, 3) b(dx)
  WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7),
full_map AS (SELECT stream_id, seq, bit_or(1::UBIGINT << (8 * y + x)::UBIGINT) AS e FROM dil GROUP BY ALL),
em AS (SELECT fr.stream_id, fr.seq, coalesce(e, 0::UBIGINT) AS e FROM fr LEFT JOIN full_map USING (stream_id, seq)),
ed AS (SELECT stream_id, seq, CAST(bit_count(e) AS BIGINT) AS edge_count,
  bit_count(xor(e, lag(e) OVER (PARTITION BY stream_id ORDER BY seq))) * 255 / 64.0::DOUBLE AS d_edges FROM em)"""

#: Frames of 8x8 from the embeddings, shrunk to 6x6 by the share of each pixel in each cell, and all their DCT coefficients.
EMB = """em AS (SELECT vec_id % 8 AS stream_id, vec_id // 8 AS seq, embedding FROM embeddings),
lp AS (SELECT stream_id, seq, list_transform(embedding, lambda e:
  CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 0.6::DOUBLE) * 255 / 1.2::DOUBLE))) AS DOUBLE)) AS p FROM em),
sh AS (SELECT c, j, greatest(0, least((c + 1) * 8 / 6.0::DOUBLE, j + 1) - greatest(c * 8 / 6.0::DOUBLE, j)) * 6 / 8.0::DOUBLE AS share
  FROM range(6) a(c), range(8) b(j)),
ax AS (SELECT u, j, sum(share * cos(pi() * (2 * c + 1) * u / 12.0::DOUBLE) * CASE WHEN u = 0 THEN sqrt(1 / 6.0::DOUBLE) ELSE sqrt(2 / 6.0::DOUBLE) END) AS a
  FROM range(6) t(u), sh GROUP BY ALL),
ba AS (SELECT y.u * 6 + x.u AS k, list(y.a * x.a ORDER BY y.j * 8 + x.j) AS w FROM ax y, ax x GROUP BY y.u, x.u),
co AS (SELECT stream_id, seq, k, list_dot_product(p, w) AS c FROM lp, ba),
md AS (SELECT stream_id, seq, median(c) AS m FROM co GROUP BY ALL),
bt AS (SELECT co.stream_id, co.seq, k, c > m AS b FROM co JOIN md USING (stream_id, seq)),
hd AS (SELECT y.stream_id, y.seq, y.seq * 40 AS pts, count(*) FILTER (WHERE x.b <> y.b) / 36.0::DOUBLE AS phash_distance
  FROM bt y JOIN bt x ON x.stream_id = y.stream_id AND x.seq = y.seq - 1 AND x.k = y.k GROUP BY ALL)"""


def fades(mean: str, dark: str, share: str) -> str:
    """CTEs that end in fd: (stream_id, pts) of all fades, and fe: where a stream ends in the dark."""
    return f"""{PX}, mn AS (SELECT stream_id, seq, seq * 40 AS pts, {mean} AS mean FROM rgb GROUP BY stream_id, seq),
dk AS (SELECT *, {dark} AS dark FROM mn), wa AS (SELECT *, lag(dark) OVER (PARTITION BY stream_id ORDER BY seq) AS was FROM dk),
ou AS (SELECT *, last_value(CASE WHEN dark AND coalesce(NOT was, TRUE) THEN pts END IGNORE NULLS)
  OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS out_at FROM wa),
fd AS (SELECT stream_id, pts AS seen, CAST(out_at + trunc((pts - out_at) * {share}::DOUBLE) AS BIGINT) AS pts FROM ou WHERE was AND NOT dark),
fe AS (SELECT stream_id, out_at AS pts FROM ou WHERE dark QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY seq DESC) = 1
  AND seq = (SELECT max(seq) FROM ou o WHERE o.stream_id = ou.stream_id))"""


SCORE = f"{DHSV}, ct AS (SELECT stream_id, seq, seq * 40 AS pts, (d_hue + d_sat + d_lum) / 3 AS score FROM dd)"
ADAPT = """rt AS (SELECT stream_id, seq, pts, score, (sum(score) OVER w - score) / 4 AS mean, count(*) OVER w AS n FROM ct
  WINDOW w AS (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
ar AS (SELECT stream_id, seq, pts, score, CASE WHEN abs(mean) < 1e-5 THEN CASE WHEN score >= 15 THEN 255 ELSE 0 END
  ELSE least(score / mean, 255) END AS ratio FROM rt WHERE n = 5)"""

_MEAN = fades("sum(luma) / 64.0::DOUBLE", "mean < 100", "0.5")


def _report(ts: str, least: int, name: str, when: str) -> str:
    made = f"struct_pack(ts := CAST({ts} AS BIGINT), least := {least}::BIGINT, name := '{name}')"
    return f"CASE WHEN {when} THEN [{made}] ELSE [] END"


_FITS = "x.ts > s AND (c IS NULL OR (x.ts > c AND x.ts - c >= x.least))"
_REPORTS = " || ".join([
    _report("fd.pts", 400, "threshold", "fd.pts IS NOT NULL"),
    _report("f.pts", 1000, "histogram", "pc_l.correlation <= 0.5"),
    _report("f.pts", 1200, "histogram", "pc_s.correlation <= 0.1"),
    _report("f.pts", 800, "content", "ct.score >= 60"),
    _report("f.pts - 80", 600, "adaptive", "ar.ratio >= 3 AND ar.score >= 15"),
])
#: Frame by frame: start of the shot s, last confirmed cut c, deferred reports d. Steps past the last frame settle those.
CONTEST = f"""WITH RECURSIVE {_MEAN}, {SCORE[len(PX) + 2:]}, {ADAPT}, {corr('px', 'luma', 16, 'l')}, {corr('hsv', 's', 16, 's')},
ff AS (SELECT f.stream_id, f.seq AS k, f.seq * 40 AS pts, max(f.seq) OVER (PARTITION BY f.stream_id) AS n FROM fr f),
rp AS (SELECT f.stream_id, f.k, f.pts, f.n, {_REPORTS} AS reps FROM ff f
  LEFT JOIN fd ON fd.stream_id = f.stream_id AND fd.seen = f.pts
  LEFT JOIN pc_l ON pc_l.stream_id = f.stream_id AND pc_l.seq = f.k
  LEFT JOIN pc_s ON pc_s.stream_id = f.stream_id AND pc_s.seq = f.k
  LEFT JOIN ct ON ct.stream_id = f.stream_id AND ct.seq = f.k
  LEFT JOIN ar ON ar.stream_id = f.stream_id AND ar.seq = f.k - 2),
steps AS (SELECT stream_id, k, pts, reps, FALSE AS past FROM rp
  UNION ALL SELECT stream_id, k + j, NULL, list_filter(reps, lambda x: FALSE), TRUE FROM rp, range(1, 9) t(j) WHERE k = n),
run AS (
  SELECT stream_id, k, pts AS s, CAST(NULL AS BIGINT) AS c, list_filter(reps, lambda x: FALSE) AS d, CAST(NULL AS BIGINT) AS was,
    CAST(NULL AS VARCHAR) AS name FROM steps WHERE k = 1
  UNION ALL
  SELECT stream_id, k, coalesce(w.ts, s), coalesce(w.ts, c), list_filter(found, lambda x: x.ts > w.ts), CASE WHEN w.ts IS NOT NULL THEN s END, w.name
  FROM (SELECT stream_id, k, s, c, found, list_filter(found, lambda x: x.ts = first_ts)[1] AS w
    FROM (SELECT *, list_min(list_transform(found, lambda x: x.ts)) AS first_ts
      FROM (SELECT n.stream_id, n.k, s, c, list_filter(reps, lambda x: {_FITS})
          || list_filter(d, lambda x: (x.name <> 'max_span' OR x.ts - s >= 1000) AND {_FITS})
          || CASE WHEN NOT past AND n.pts - s >= 1000 THEN [struct_pack(ts := n.pts, least := 0::BIGINT, name := 'max_span')] ELSE [] END AS found
        FROM run r JOIN steps n ON n.stream_id = r.stream_id AND n.k = r.k + 1))))
SELECT stream_id, was AS start_pts, s AS end_pts, name AS provenance FROM run WHERE was IS NOT NULL
UNION ALL
SELECT run.stream_id, s, rp.pts + 1, 'finalized' FROM run JOIN rp ON rp.stream_id = run.stream_id AND rp.k = rp.n WHERE run.k = rp.n + 8"""

_SCENES = f"""{METRICS}, {corr('px', 'luma', 16, 'l')}"""
KEYFRAMES = spaced(_SCENES, "SELECT stream_id, seq * 40 AS pts FROM pc_l WHERE correlation <= 0.5", 1000, """,
bnd AS (SELECT stream_id, pts FROM cuts UNION SELECT stream_id, min(pts) FROM jd GROUP BY stream_id),
si AS (SELECT jd.*, b.pts AS shot, CASE WHEN rejected THEN 0::REAL ELSE sharpness END AS sharp FROM jd ASOF JOIN bnd b
  ON jd.stream_id = b.stream_id AND jd.pts >= b.pts),
wi AS (SELECT *, (pts - shot) // 1000 AS win FROM si),
flo AS (SELECT stream_id, shot, win, list(sharpness ORDER BY sharpness) FILTER (WHERE NOT rejected) AS v FROM wi GROUP BY ALL),
fo AS (SELECT stream_id, shot, win, CASE WHEN len(v) >= 3
  THEN least(4000::REAL, v[least(CAST(trunc(len(v) * 0.25::DOUBLE) AS BIGINT), len(v) - 1) + 1]) ELSE 4000::REAL END AS floor FROM flo),
ch AS (SELECT wi.*, NOT rejected AND sharpness >= floor AS strict FROM wi JOIN fo USING (stream_id, shot, win)),
rk AS (SELECT *, row_number() OVER (PARTITION BY stream_id, shot, win
  ORDER BY strict DESC, CASE WHEN strict THEN quality ELSE sharp END DESC, pts) AS nth FROM ch)
SELECT stream_id, pts, 'boundary' AS provenance FROM bnd
UNION ALL SELECT stream_id, pts, CASE WHEN strict THEN 'quality' ELSE 'fallback' END FROM rk WHERE nth = 1 AND pts <> shot""").replace(
    "cuts.pts = nx.pts WHERE nx.after IS NOT NULL)\n,", "cuts.pts = nx.pts WHERE nx.after IS NOT NULL),"
)

_ONE_SHOT = FLOOR.replace(
    "st AS (SELECT stream_id, shot_key, min(seq * 40) AS start_pts, max(seq * 40) + 40 AS end_pts FROM fr GROUP BY ALL)",
    "st AS (SELECT stream_id, min(seq * 40) AS start_pts, max(seq * 40) + 1 AS end_pts FROM fr GROUP BY ALL)",
).replace("JOIN st ON st.stream_id = fr.stream_id AND st.shot_key = fr.shot_key", "JOIN st ON st.stream_id = fr.stream_id").replace(
    "good AS (SELECT stream_id, start_pts, list(sharpness ORDER BY sharpness) AS v FROM pl WHERE NOT rejected GROUP BY ALL)",
    """gd AS (SELECT stream_id, start_pts, sharpness, row_number() OVER (PARTITION BY stream_id, start_pts ORDER BY pts, seq) - 1 AS nth,
  count(*) OVER (PARTITION BY stream_id, start_pts) AS total FROM pl WHERE NOT rejected),
good AS (SELECT stream_id, start_pts, list(sharpness ORDER BY sharpness) AS v FROM gd
  WHERE nth = 0 OR nth * least(total, 4096) // total <> (nth - 1) * least(total, 4096) // total GROUP BY ALL)""",
)

MACHINE_ORACLES = {
    "frame_checks": f"""WITH {FR} SELECT stream_id, seq, CASE seq % 9 WHEN 0 THEN 'StrideTooSmall' WHEN 1 THEN 'DataTooShort'
      WHEN 2 THEN 'ZeroDimensions' WHEN 3 THEN 'ZeroTimebase' WHEN 4 THEN 'PlaneTooShort:saturation' WHEN 5 THEN 'FrameTooLarge'
      WHEN 6 THEN 'StrideTooSmall' WHEN 7 THEN 'WidthOverflow' END AS error FROM fr""",
    "views_join": f"""WITH {FR} SELECT stream_id, seq, CASE seq % 7 WHEN 0 THEN 'TimestampMismatch' WHEN 1 THEN 'DimensionMismatch' END AS error
      FROM fr""",
    "padded_planes": f"""WITH {GRAD}, {SHARP}, mn AS (SELECT stream_id, seq, sum(luma) / 64.0::DOUBLE AS luma_mean FROM px GROUP BY ALL)
      SELECT stream_id, seq, luma_mean, CAST(sharpness AS DOUBLE) AS sharpness FROM mn JOIN sh USING (stream_id, seq)""",
    "admitted_times": f"""WITH {FR}, tm AS (SELECT stream_id, seq, seq - CASE WHEN seq % 11 = 0 THEN 3 ELSE 0 END AS tick FROM fr),
      cp AS (SELECT stream_id, seq, CASE WHEN seq % 3 = 2 THEN (tick * 1200 + seq % 5 + 1199) // 1200 ELSE tick END AS pts FROM tm),
      bf AS (SELECT *, max(pts) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cp)
      SELECT stream_id, seq, pts, CASE WHEN pts < before THEN 'OutOfOrder' END AS rejected FROM bf""",
    "plane_correlations": f"""WITH {HSV}, {corr('hsv', 'h', 16, 'h')}, {corr('hsv', 's', 16, 's')}
      SELECT stream_id, seq, pc_h.correlation AS corr_hue, pc_s.correlation AS corr_sat FROM pc_h JOIN pc_s USING (stream_id, seq)""",
    "hist_cuts_default": spaced(f"{PX}, {corr('px', 'luma', 256, 'l')}", "SELECT stream_id, seq * 40 AS pts, correlation FROM pc_l WHERE correlation <= 0.5",
                                1000, "SELECT cuts.stream_id, cuts.pts, correlation FROM cuts JOIN cand USING (stream_id, pts)"),
    "content_cuts_default": merge_cuts(SCORE, "SELECT stream_id, pts, score >= 27 AS above FROM ct", 1000),
    "edge_delta": f"WITH RECURSIVE {EDGE} SELECT stream_id, seq, d_edges, edge_count FROM ed",
    "content_score_edges": f"""WITH RECURSIVE {EDGE}, {DHSV[len(HSV) + 2:]}
      SELECT stream_id, seq, round((d_hue * 1.0::DOUBLE + d_sat * 0.5::DOUBLE + d_lum * 2.0::DOUBLE + d_edges * 1.5::DOUBLE) / 5.0::DOUBLE, 9) AS score
      FROM dd JOIN ed USING (stream_id, seq)""",
    "fade_cuts_gated": spaced(_MEAN, "SELECT stream_id, pts FROM fd UNION ALL SELECT stream_id, pts FROM fe", 1000, KEEP),
    "fade_cuts_ceiling": f"WITH {fades('sum(r + g + b) / 192.0::DOUBLE', 'mean >= 150', '0.75')} SELECT stream_id, pts FROM fd",
    "adaptive_cuts_frames": spaced(f"{SCORE}, {ADAPT}", "SELECT stream_id, pts FROM ar WHERE ratio >= 3 AND score >= 15", 1000, KEEP),
    "phash_of_embeddings": f"WITH {EMB} SELECT stream_id, seq, phash_distance FROM hd",
    "phash_cuts": spaced(EMB, "SELECT stream_id, pts, phash_distance AS distance FROM hd WHERE phash_distance >= 0.395", 1000,
                         "SELECT cuts.stream_id, cuts.pts, distance FROM cuts JOIN cand USING (stream_id, pts)"),
    "keyframes_remaining": f"""WITH {_ONE_SHOT},
      ch AS (SELECT pl.*, NOT rejected AND sharpness >= floor AS strict FROM pl JOIN fl USING (stream_id, start_pts)),
      rk AS (SELECT *, row_number() OVER (PARTITION BY stream_id, start_pts, bucket
        ORDER BY strict DESC, CASE WHEN strict THEN quality ELSE sharpness END DESC, pts, seq) AS nth FROM ch)
      SELECT stream_id, bucket, pts, strict, CAST(quality AS DOUBLE) AS quality FROM rk WHERE nth = 1""",
    "cascade_scenes": CONTEST,
    "cascade_keyframes": KEYFRAMES,
}
