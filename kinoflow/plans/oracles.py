"""The same queries in DuckDB SQL."""

FR = """fr AS (
  SELECT l_orderkey % 16 AS stream_id, l_orderkey AS shot_key, CAST(l_quantity AS INT) AS qty,
    row_number() OVER (PARTITION BY l_orderkey % 16 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS seq
  FROM lineitem)"""
PX = f"""{FR}, raw AS (SELECT stream_id, seq, shot_key, qty, i, i % 8 AS x, i // 8 AS y FROM fr, range(64) t(i)),
px AS (
  SELECT stream_id, seq, i, x, y, (shot_key * 37) % 180 + (x * (shot_key % 5 + 1) * 3 + y * (shot_key % 7 + 1) * 2) % 60 + qty % 8 AS luma
  FROM raw),
rgb AS (SELECT *, luma AS r, (luma * 3 + x * 5) % 256 AS g, (luma * 7 + y * 11) % 256 AS b FROM px)"""
HSV = f"""{PX}, vd AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM rgb),
tn AS (SELECT *, CASE WHEN v = r THEN g - b WHEN v = g THEN b - r ELSE r - g END AS diff,
    CASE WHEN v = r THEN CASE WHEN g < b THEN 360 ELSE 0 END WHEN v = g THEN 120 ELSE 240 END AS turn FROM vd),
hsv AS (SELECT stream_id, seq, i, v,
    CASE WHEN v > 0 THEN (510 * d + v) // (2 * v) ELSE 0 END AS s,
    CASE WHEN d > 0 THEN least((60 * diff + turn * d + d) // (2 * d), 179) ELSE 0 END AS h FROM tn)"""
GRAD = f"""{PX}, ls AS (SELECT stream_id, seq, list(luma ORDER BY i) AS p FROM px GROUP BY stream_id, seq),
nb AS (SELECT stream_id, seq, p, c FROM ls, (SELECT yy * 8 + xx + 1 AS c FROM range(1, 7) u(yy), range(1, 7) w(xx))),
gr AS (SELECT stream_id, seq,
    p[c - 7] + 2 * p[c + 1] + p[c + 9] - p[c - 9] - 2 * p[c - 1] - p[c + 7] AS gx,
    p[c + 7] + 2 * p[c + 8] + p[c + 9] - p[c - 9] - 2 * p[c - 8] - p[c - 7] AS gy,
    4 * p[c] - 2 * (p[c - 8] + p[c + 8] + p[c - 1] + p[c + 1]) + p[c - 9] + p[c - 7] + p[c + 7] + p[c + 9] AS lap FROM nb)"""
MV = f"""{HSV}, lm AS (SELECT stream_id, seq, sum(luma) / 64.0::DOUBLE AS m, sum(luma * luma) / 64.0::DOUBLE AS q FROM px GROUP BY ALL),
sm AS (SELECT stream_id, seq, sum(s) / 64.0::DOUBLE AS m, sum(s * s) / 64.0::DOUBLE AS q FROM hsv GROUP BY ALL),
mv AS (SELECT lm.stream_id, lm.seq, CAST(lm.m AS REAL) AS brightness, CAST(greatest(lm.q - lm.m * lm.m, 0) AS REAL) AS luma_variance,
    CAST(greatest(sm.q - sm.m * sm.m, 0) AS REAL) AS saturation_variance FROM lm JOIN sm USING (stream_id, seq))"""
CLIP = """cl AS (SELECT stream_id, seq, CAST(count(*) FILTER (WHERE greatest(r, g, b) < 5 OR greatest(r, g, b) > 250) / 64.0::DOUBLE AS REAL) AS clipping
  FROM rgb GROUP BY ALL)"""
COLOR = """cs AS (SELECT stream_id, seq, sum(r - g) / 64.0::DOUBLE AS m1, sum(r + g - 2 * b) / 64.0::DOUBLE / 2 AS m2,
    sum((r - g) * (r - g)) / 64.0::DOUBLE AS q1, sum((r + g - 2 * b) * (r + g - 2 * b)) / 64.0::DOUBLE / 4 AS q2 FROM rgb GROUP BY ALL),
co AS (SELECT stream_id, seq, CAST(sqrt(greatest(q1 - m1 * m1, 0) + greatest(q2 - m2 * m2, 0)) + 0.3::DOUBLE * sqrt(m1 * m1 + m2 * m2) AS REAL) AS colorfulness
  FROM cs)"""
SHARP = """sh AS (SELECT stream_id, seq, CAST(sum(gx * gx + gy * gy) / 36.0::DOUBLE AS REAL) AS sharpness,
  CAST(sum(abs(lap)) * 0.2088987548863723::DOUBLE / 36 AS REAL) AS noise FROM gr GROUP BY ALL)"""
BLUR = """di AS (SELECT stream_id, seq, abs(gx) + abs(gy) AS m, CASE WHEN 1000 * abs(gy) < 414 * abs(gx) THEN 0
    WHEN 1000 * abs(gy) > 2414 * abs(gx) THEN 2 WHEN sign(gx) = sign(gy) THEN 1 ELSE 3 END AS way FROM gr),
bs AS (SELECT stream_id, seq, way, sum(m) AS m FROM di GROUP BY ALL),
bl AS (SELECT stream_id, seq, CAST(CASE WHEN sum(m) > 0
    THEN least(greatest(max(m) / sum(m)::DOUBLE - 0.25::DOUBLE, 0) / 0.75::DOUBLE, 1) ELSE 0 END AS REAL) AS motion_blur FROM bs GROUP BY stream_id, seq)"""
_grad_rest = GRAD[len(PX) :]
METRICS = f"""{MV}, {CLIP}, {COLOR}{_grad_rest}, {SHARP}, {BLUR},
me AS (SELECT mv.*, clipping, colorfulness, sharpness, noise, motion_blur, seq * 40 AS pts FROM mv JOIN cl USING (stream_id, seq)
  JOIN co USING (stream_id, seq) JOIN sh USING (stream_id, seq) JOIN bl USING (stream_id, seq)),
jd AS (SELECT *, brightness < 40 OR brightness > 240 OR (luma_variance < 120 AND saturation_variance < 900) OR clipping > 0.5::REAL AS rejected,
  1.0::REAL * sharpness / 1000.0::REAL - 0.3::REAL * noise / 20.0::REAL + 0.2::REAL * colorfulness / 50.0::REAL
    - 0.5::REAL * clipping - 0.0::REAL * motion_blur AS quality FROM me)"""
CORR = f"""{PX}, hi AS (SELECT stream_id, seq, luma * 16 // 256 AS bin, count(*) AS n FROM px GROUP BY ALL),
qs AS (SELECT stream_id, seq, 16 * sum(n * n) - 4096 AS aa FROM hi GROUP BY ALL),
cr AS (SELECT b.stream_id, b.seq, sum(a.n * b.n) AS ab FROM hi b LEFT JOIN hi a
  ON a.stream_id = b.stream_id AND a.seq = b.seq - 1 AND a.bin = b.bin GROUP BY ALL),
pc AS (SELECT cr.stream_id, cr.seq, round(CASE WHEN y.aa = 0 AND x.aa = 0 THEN 1 WHEN y.aa = 0 OR x.aa = 0 THEN 0
    ELSE (16 * coalesce(ab, 0) - 4096) / (sqrt(x.aa::DOUBLE) * sqrt(y.aa::DOUBLE)) END, 9) AS correlation
  FROM cr JOIN qs y USING (stream_id, seq) JOIN qs x ON x.stream_id = cr.stream_id AND x.seq = cr.seq - 1)"""


def spaced(ctes: str, candidates: str, gap: int, out: str) -> str:
    """The greedy spacing rule: from each cut to the first candidate ``gap`` later."""
    return f"""WITH RECURSIVE {ctes}, cand AS ({candidates}),
nx AS (SELECT stream_id, pts, min(pts) OVER (PARTITION BY stream_id ORDER BY pts
    RANGE BETWEEN {gap} FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM cand),
cuts AS (SELECT stream_id, min(pts) AS pts FROM cand GROUP BY stream_id
  UNION ALL SELECT nx.stream_id, nx.after FROM cuts JOIN nx ON cuts.stream_id = nx.stream_id AND cuts.pts = nx.pts WHERE nx.after IS NOT NULL)
{out}"""


DLUM = f"""{PX}, lg AS (SELECT stream_id, seq, abs(luma - lag(luma) OVER (PARTITION BY stream_id, i ORDER BY seq)) AS d FROM px),
dl AS (SELECT stream_id, seq, seq * 40 AS pts, sum(d) / 64.0::DOUBLE AS score FROM lg WHERE d IS NOT NULL GROUP BY ALL)"""
DHSV = f"""{HSV}, lg AS (SELECT stream_id, seq, abs(h - lag(h) OVER w) AS dh, abs(s - lag(s) OVER w) AS ds, abs(v - lag(v) OVER w) AS dv
  FROM hsv WINDOW w AS (PARTITION BY stream_id, i ORDER BY seq)),
dd AS (SELECT stream_id, seq, sum(dh) / 64.0::DOUBLE AS d_hue, sum(ds) / 64.0::DOUBLE AS d_sat, sum(dv) / 64.0::DOUBLE AS d_lum
  FROM lg WHERE dh IS NOT NULL GROUP BY ALL)"""
EV = """ev AS (SELECT user_id AS stream_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
de AS (SELECT stream_id, seq, abs(value - lag(value) OVER (PARTITION BY stream_id ORDER BY seq)) AS score FROM ev),
sc AS (SELECT stream_id, seq, score, sum(score) OVER w AS total, count(*) OVER w AS n FROM de WHERE score IS NOT NULL
  WINDOW w AS (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
ra AS (SELECT stream_id, seq, score, CASE WHEN abs((total - score) / 4) < 1e-5 THEN CASE WHEN score >= 15 THEN 255 ELSE 0 END
    ELSE least(score / ((total - score) / 4), 255) END AS ratio FROM sc WHERE n = 5)"""
SHOTS = "st AS (SELECT stream_id, shot_key, min(seq * 40) AS start_pts, max(seq * 40) + 40 AS end_pts FROM fr GROUP BY ALL)"
BUCKETS = f"""{SHOTS},
bn AS (SELECT *, least(greatest(CAST(ceil((end_pts - start_pts) / 80.0) AS BIGINT), 1), 16) AS n FROM st),
bi AS (SELECT *, unnest(range(n)) AS bucket FROM bn),
be AS (SELECT *, bucket / n::DOUBLE AS low, (bucket + 1) / n::DOUBLE AS high FROM bi),
bc AS (SELECT *, CASE WHEN bucket = 0 THEN low + 0.02::DOUBLE ELSE low END AS cl, CASE WHEN bucket = n - 1 THEN high - 0.02::DOUBLE ELSE high END AS ch,
  end_pts - start_pts AS span FROM be),
bk AS (SELECT stream_id, start_pts, CAST(bucket AS INT) AS bucket,
    start_pts + CAST(trunc(CASE WHEN cl >= ch OR trunc(cl * span) >= trunc(ch * span) THEN low ELSE cl END * span) AS BIGINT) AS lo,
    start_pts + CAST(trunc(CASE WHEN cl >= ch OR trunc(cl * span) >= trunc(ch * span) THEN high ELSE ch END * span) AS BIGINT) AS hi FROM bc)"""
FLOOR = f"""{METRICS}, {BUCKETS},
ins AS (SELECT jd.*, st.start_pts FROM jd JOIN fr USING (stream_id, seq) JOIN st ON st.stream_id = fr.stream_id AND st.shot_key = fr.shot_key),
pl AS (SELECT ins.*, bucket FROM ins JOIN bk USING (stream_id, start_pts) WHERE pts >= lo AND pts < hi),
good AS (SELECT stream_id, start_pts, list(sharpness ORDER BY sharpness) AS v FROM pl WHERE NOT rejected GROUP BY ALL),
sp AS (SELECT DISTINCT stream_id, start_pts FROM pl),
fl AS (SELECT sp.stream_id, sp.start_pts, CASE WHEN len(v) >= 3
    THEN least(4000::REAL, v[least(CAST(trunc(len(v) * 0.25::DOUBLE) AS BIGINT), len(v) - 1) + 1]) ELSE 4000::REAL END AS floor
  FROM sp LEFT JOIN good USING (stream_id, start_pts))"""
HCAND = "SELECT stream_id, seq * 40 AS pts, correlation FROM pc WHERE correlation <= 0.5"
KEEP = "SELECT stream_id, pts FROM cuts"


def sums(*names: str) -> str:
    return ", ".join(f"CAST(sum({n}) AS BIGINT) AS sum_{a}, CAST(sum({n} * (i + 1)) AS BIGINT) AS digest_{a}" for a, n in (x.split("=") for x in names))


def doubles(ctes: str, table: str, *names: str) -> str:
    return f"WITH {ctes} SELECT stream_id, seq, {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in names)} FROM {table}"


ORACLES = {
    "luma_from_bgr": f"WITH {PX} SELECT stream_id, seq, {sums('luma=((77 * r + 150 * g + 29 * b) >> 8)')} FROM rgb GROUP BY stream_id, seq",
    "hsv_from_bgr": f"WITH {HSV} SELECT stream_id, seq, {sums('h=h', 's=s', 'v=v')} FROM hsv GROUP BY stream_id, seq",
    "frame_means": f"""WITH {PX} SELECT stream_id, seq, sum(luma) / 64.0::DOUBLE AS luma_mean, sum(r + g + b) / 192.0::DOUBLE AS rgb_mean
      FROM rgb GROUP BY stream_id, seq""",
    "plane_mean_variance": doubles(MV, "mv", "brightness", "luma_variance", "saturation_variance"),
    "histogram_bins": f"WITH {PX} SELECT stream_id, seq, CAST(luma * 16 // 256 AS INT) AS bin, CAST(count(*) AS INT) AS n FROM px GROUP BY ALL",
    "clipping_ratio": doubles(f"{PX}, {CLIP}", "cl", "clipping"),
    "colorfulness": doubles(f"{PX}, {COLOR}", "co", "colorfulness"),
    "tenengrad": doubles(f"{GRAD}, {SHARP}", "sh", "sharpness"),
    "noise_sigma": doubles(f"{GRAD}, {SHARP}", "sh", "noise"),
    "motion_blur": doubles(f"{GRAD}, {BLUR}", "bl", "motion_blur"),
    "mean_abs_diff": f"WITH {DHSV} SELECT * FROM dd",
    "hist_correlation": f"WITH {CORR} SELECT stream_id, seq, correlation FROM pc",
    "hist_cuts": spaced(CORR, HCAND, 200, "SELECT cuts.stream_id, cuts.pts, correlation FROM cuts JOIN cand USING (stream_id, pts)"),
    "content_score": f"WITH {DHSV} SELECT stream_id, seq, round((d_hue + d_sat + d_lum) / 3, 9) AS score FROM dd",
    "content_cuts_suppress": spaced(DLUM, "SELECT stream_id, pts FROM dl WHERE score >= 27", 200, KEEP),
    "content_cuts_merge": f"""WITH RECURSIVE {DLUM}, nr AS (
        SELECT stream_id, pts, score >= 27 AS above, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS k FROM dl),
      run AS (
        SELECT stream_id, k, pts, CASE WHEN above THEN pts ELSE pts - 200 END AS last, above AS armed, CAST(NULL AS BIGINT) AS held,
          CASE WHEN above THEN pts END AS cut FROM nr WHERE k = 1
        UNION ALL
        SELECT n.stream_id, n.k, n.pts, CASE WHEN n.above THEN n.pts ELSE r.last END,
          r.armed OR (r.held IS NULL AND n.above AND n.pts - r.last >= 200),
          CASE WHEN r.held IS NOT NULL THEN CASE WHEN n.pts - r.last >= 200 AND NOT n.above AND r.last - r.held >= 200 THEN NULL ELSE r.held END
            WHEN n.above AND n.pts - r.last < 200 AND r.armed THEN n.pts END,
          CASE WHEN r.held IS NOT NULL THEN CASE WHEN n.pts - r.last >= 200 AND NOT n.above AND r.last - r.held >= 200 THEN r.last END
            WHEN n.above AND n.pts - r.last >= 200 THEN n.pts END
        FROM run r JOIN nr n ON n.stream_id = r.stream_id AND n.k = r.k + 1)
      SELECT stream_id, cut AS pts FROM run WHERE cut IS NOT NULL""",
    "fade_cuts": """WITH ev AS (
        SELECT user_id AS stream_id, value < 12 AS dark, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
      wa AS (SELECT *, seq * 40 AS pts, lag(dark) OVER (PARTITION BY stream_id ORDER BY seq) AS was FROM ev),
      ou AS (SELECT *, last_value(CASE WHEN dark AND coalesce(NOT was, FALSE) OR dark AND was IS NULL THEN pts END IGNORE NULLS)
        OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS out_at FROM wa)
      SELECT stream_id, CAST(out_at + trunc((pts - out_at) / 2.0) AS BIGINT) AS pts FROM ou WHERE was AND NOT dark""",
    "adaptive_ratio": f"WITH {EV} SELECT stream_id, seq, round(ratio, 6) AS ratio FROM ra",
    "adaptive_cuts": f"WITH {EV} SELECT stream_id, seq * 40 AS pts FROM ra WHERE ratio >= 3 AND score >= 15",
    "hard_gate": f"WITH {METRICS} SELECT stream_id, seq, rejected FROM jd",
    "composite_quality": doubles(METRICS, "jd", "quality"),
    "effective_floor": f"WITH {FLOOR} SELECT stream_id, start_pts, CAST(floor AS DOUBLE) AS floor FROM fl",
    "shot_buckets": f"WITH {FR}, {BUCKETS} SELECT * FROM bk",
    "keyframe_choice": f"""WITH {FLOOR},
      ch AS (SELECT pl.*, NOT rejected AND sharpness >= floor AS strict FROM pl JOIN fl USING (stream_id, start_pts)),
      rk AS (SELECT *, row_number() OVER (PARTITION BY stream_id, start_pts, bucket
        ORDER BY strict DESC, CASE WHEN strict THEN quality ELSE sharpness END DESC, pts, seq) AS nth FROM ch)
      SELECT stream_id, start_pts, bucket, pts, strict, CAST(quality AS DOUBLE) AS quality FROM rk WHERE nth = 1""",
    "scene_assoc": spaced(CORR, HCAND, 200, """SELECT f.stream_id, f.seq * 40 AS pts, coalesce(
        last_value(c.pts IGNORE NULLS) OVER (PARTITION BY f.stream_id ORDER BY f.seq ROWS UNBOUNDED PRECEDING),
        min(f.seq * 40) OVER (PARTITION BY f.stream_id)) AS start_pts
      FROM fr f LEFT JOIN cuts c ON c.stream_id = f.stream_id AND c.pts = f.seq * 40"""),
    "downscale": f"""WITH {PX}, sm AS (SELECT stream_id, seq, (y // 2) * 4 + x // 2 AS cell, (sum(r) + 2) // 4 AS r, (sum(g) + 2) // 4 AS g,
        (sum(b) + 2) // 4 AS b FROM rgb GROUP BY ALL)
      SELECT stream_id, seq, CAST(sum(r + g + b) AS BIGINT) AS total, CAST(sum((r + g + b) * (cell + 1)) AS BIGINT) AS digest
      FROM sm GROUP BY stream_id, seq""",
}
