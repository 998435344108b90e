"""The engine's own queries over the test schema, and their DuckDB equivalents.

Events stand in for timed frames, embeddings for hashed frames and documents for classified screens;
thresholds are those that make each rule both hold and fail on these tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expressions import half
from tidemark.functions.store import stored
from tidemark.operators import adaptive as Ad
from tidemark.operators import boundaries as B
from tidemark.operators import classify as C
from tidemark.operators import dedup as D
from tidemark.operators import manifest as M
from tidemark.operators import motion as Mo
from tidemark.operators import segments as S
from tidemark.operators import stability as St
from tidemark.operators import timeline as T
from tidemark.sources.sinks import ANALYSIS, session_documents
from tidemark.sources.sinks import classification_debug as classification_report
from tidemark.sources.tables import hashed_frames, screens, table, timed_frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HOUR = 3_600_000
MOTION = Mo.MotionConfig(fps=6, motion=37, anomaly=34)
SEGMENTS = S.SegmentConfig(gap_ms=4 * HOUR, guard_ms=HOUR // 2, short_ms=HOUR)
BOUNDS = B.BoundaryConfig(edge_ms=2 * HOUR, before_ms=30 * HOUR, after_ms=30 * HOUR, most=2, drift_ms=6 * HOUR)
STABLE = St.StabilityConfig(change=36, split=17, still=30, large=32, small=32, blend=28, slide=16, fade=0.15, edge_next=31, edge=8)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return add


# Tables in SQL.
TL = "tl AS (SELECT user_id AS job_id, event_id AS frame_id, epoch_us(ts) // 1000 AS ts_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_type AS label, value FROM events)"
SIG = """s0 AS (SELECT CAST(label AS BIGINT) AS job_id, vec_id AS frame_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s1 AS (SELECT *, (list_sort(e)[32] + list_sort(e)[33]) / 2 AS mid FROM s0),
sg AS (SELECT job_id, frame_id, row_number() OVER (PARTITION BY job_id ORDER BY frame_id) - 1 AS idx, list_transform(range(1, 65), lambda i: CASE WHEN e[i] > mid THEN 1 ELSE 0 END) AS b FROM s1)"""


def ham(a: str, b: str, low: int = 1, high: int = 64) -> str:
    return f"CAST(list_sum(list_transform(range({low}, {high + 1}), lambda i: abs({a}[i] - {b}[i]))) AS BIGINT)"


MO = f"{SIG}, mo AS (SELECT * FROM (SELECT job_id, idx, {ham('b', 'nb')} AS m FROM (SELECT *, lead(b) OVER (PARTITION BY job_id ORDER BY idx) AS nb FROM sg) WHERE nb IS NOT NULL))"
RUNS = f"""{MO}, sm AS (SELECT *, avg(m) OVER (PARTITION BY job_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS sm, lag(m) OVER (PARTITION BY job_id ORDER BY idx) AS prev FROM mo),
isl AS (SELECT *, idx - row_number() OVER (PARTITION BY job_id ORDER BY idx) AS island FROM sm WHERE sm > {MOTION.motion}),
runs AS (SELECT job_id, greatest(min(idx) - 1, 0) AS start_index, max(idx) + 1 AS end_index, arg_min(idx, (-m) * 100000 + idx) AS peak_index, max(m) AS score, 'multi' AS kind FROM isl GROUP BY job_id, island)"""
ANOM = f"anom AS (SELECT job_id, greatest(idx - 1, 0) AS start_index, idx + 1 AS end_index, idx AS peak_index, greatest(prev, m) AS score, 'anomaly' AS kind FROM sm WHERE prev > {MOTION.anomaly} AND m > {MOTION.anomaly})"
ZONES = f"""{RUNS}, {ANOM}, zz AS (SELECT *, start_index * 1000 // 6 AS start_ms, (end_index + 1) * 1000 // 6 AS end_ms, CASE kind WHEN 'multi' THEN 0 ELSE 1 END AS rk FROM (SELECT * FROM runs UNION ALL SELECT * FROM anom)),
zp AS (SELECT *, max(end_ms) OVER (PARTITION BY job_id ORDER BY start_ms, rk, peak_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe, row_number() OVER (PARTITION BY job_id ORDER BY start_ms, rk, peak_index) AS place FROM zz),
zg AS (SELECT *, sum(CASE WHEN start_ms - pe <= 166 THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY place) AS grp FROM zp),
zones AS (SELECT job_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, min(start_index) AS start_index, max(end_index) AS end_index, arg_min(peak_index, (-score) * 100000 + place) AS peak_index, max(score) AS score, CASE WHEN min(rk) = 0 THEN 'multi' ELSE 'anomaly' END AS kind FROM zg GROUP BY job_id, grp)"""
SEG = f"""{TL}, br AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY job_id ORDER BY idx) <= {SEGMENTS.gap_ms} THEN 0 ELSE 1 END AS brk FROM tl),
sgm AS (SELECT *, sum(brk) OVER (PARTITION BY job_id ORDER BY idx) AS seg FROM br)"""
ROLL = f"{SEG}, roll AS (SELECT job_id, CAST(seg AS BIGINT) AS seg, min(idx) AS start_index, max(idx) AS end_index, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS n_frames FROM sgm GROUP BY job_id, seg)"
REPS = f"""{SEG}, w0 AS (SELECT *, min(ts_ms) OVER w AS st, max(ts_ms) OVER w AS en, count(*) OVER w AS n, row_number() OVER (PARTITION BY job_id, seg ORDER BY idx) AS pos FROM sgm WINDOW w AS (PARTITION BY job_id, seg)),
w1 AS (SELECT *, CASE WHEN ts_ms BETWEEN st + {SEGMENTS.guard_ms} AND en - {SEGMENTS.guard_ms} THEN 1 ELSE 0 END AS inn, abs(ts_ms - (st + en) // 2) AS far FROM w0),
w2 AS (SELECT *, max(inn) OVER (PARTITION BY job_id, seg) AS any_inn FROM w1),
w3 AS (SELECT *, row_number() OVER (PARTITION BY job_id, seg ORDER BY CASE WHEN n = 1 THEN 0 WHEN any_inn = 1 THEN 1 - inn WHEN n >= 3 AND (pos = 1 OR pos = n) THEN 1 ELSE 0 END, far, idx) AS rn FROM w2),
reps AS (SELECT job_id, CAST(seg AS BIGINT) AS seg, frame_id, idx, ts_ms, st, en, n AS n_frames FROM w3 WHERE rn = 1)"""
GAPS = "SELECT job_id, 'segment_gap' AS boundary_type, en AS start_ms, nx AS end_ms, CASE WHEN nx <= en THEN en ELSE (en + nx) // 2 END AS peak_ms, 1 AS rk, seg AS before_seg, nseg AS after_seg, li AS start_index FROM (SELECT job_id, seg, max(ts_ms) AS en, max(idx) AS li, lead(min(ts_ms)) OVER (PARTITION BY job_id ORDER BY seg) AS nx, lead(seg) OVER (PARTITION BY job_id ORDER BY seg) AS nseg FROM sgm GROUP BY job_id, seg) WHERE nx IS NOT NULL"
MOVED = f"SELECT job_id, 'multi' AS boundary_type, ts_ms - {HOUR // 2} AS start_ms, ts_ms + {HOUR // 2} AS end_ms, ts_ms AS peak_ms, 0 AS rk, NULL AS before_seg, NULL AS after_seg, NULL AS start_index FROM tl WHERE label = 'error'"


def bounded(zones: bool, selected: str = "true") -> str:
    """Boundaries, the points of frames, guarded representatives and candidates, in plain SQL."""
    found = f"{GAPS} UNION ALL {MOVED}" if zones else GAPS
    return f"""{REPS}, bnd AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start_ms, coalesce(start_index, 0), rk, coalesce(before_seg, 0), end_ms, peak_ms) AS bnd FROM ({found})),
t0 AS (SELECT t.*, EXISTS (SELECT 1 FROM bnd b WHERE b.job_id = t.job_id AND t.ts_ms BETWEEN b.start_ms AND b.end_ms) AS inside,
EXISTS (SELECT 1 FROM bnd b WHERE b.job_id = t.job_id AND NOT t.ts_ms BETWEEN b.start_ms AND b.end_ms AND (abs(t.ts_ms - b.start_ms) <= {BOUNDS.edge_ms} OR abs(t.ts_ms - b.end_ms) <= {BOUNDS.edge_ms})) AS near, value / 100 >= 0.6 AS hp, (value - 20) / 100 >= 0.6 AS hn, value / 14 < 0.35 AS bl FROM sgm t),
tch AS (SELECT *, least(100, CASE WHEN inside THEN 35 ELSE 0 END + CASE WHEN near THEN 25 ELSE 0 END + CASE WHEN hp THEN 20 ELSE 0 END + CASE WHEN hn THEN 20 ELSE 0 END + CASE WHEN hp AND hn THEN 15 ELSE 0 END + CASE WHEN bl THEN 10 ELSE 0 END) AS pts FROM t0),
g0 AS (SELECT t.*, inside OR near AS doubtful, r.idx AS rep_idx, abs(t.ts_ms - (min(t.ts_ms) OVER w + max(t.ts_ms) OVER w) // 2) AS far, max(CASE WHEN t.idx = r.idx AND (inside OR near) THEN 1 WHEN t.idx = r.idx THEN 0 END) OVER w AS doubt FROM tch t JOIN reps r ON r.job_id = t.job_id AND r.seg = t.seg WINDOW w AS (PARTITION BY t.job_id, t.seg)),
g1 AS (SELECT *, row_number() OVER (PARTITION BY job_id, seg ORDER BY CASE WHEN doubt = 0 THEN CASE WHEN idx = rep_idx THEN 0 ELSE 2 END WHEN idx = rep_idx THEN 1 WHEN doubtful OR pts >= 65 THEN 2 ELSE 0 END, far, value, idx) AS rn FROM g0),
guarded AS (SELECT job_id, CAST(seg AS BIGINT) AS seg, frame_id, idx, ts_ms, label, doubtful AS near, idx <> rep_idx AS moved, CASE WHEN idx = rep_idx AND doubtful THEN '{B.NEAR_REVIEW}' END AS review FROM g1 WHERE rn = 1 AND {selected}),
c0 AS (SELECT t.job_id, b.bnd, t.frame_id, t.idx, t.ts_ms, t.pts >= 65 AS bad, CASE WHEN t.ts_ms BETWEEN b.start_ms - {BOUNDS.before_ms} AND b.start_ms - {BOUNDS.edge_ms} THEN 0 WHEN t.ts_ms BETWEEN b.end_ms + {BOUNDS.edge_ms} AND b.end_ms + {BOUNDS.after_ms} THEN 1 END AS side FROM tch t JOIN bnd b ON b.job_id = t.job_id WHERE NOT EXISTS (SELECT 1 FROM guarded g WHERE g.job_id = t.job_id AND g.idx = t.idx)),
c1 AS (SELECT *, coalesce(sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY job_id, bnd ORDER BY side, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c0 WHERE side IS NOT NULL),
looked AS (SELECT *, CASE WHEN bad THEN 'contaminated' ELSE 'recovered' END AS outcome FROM c1 WHERE before < {BOUNDS.most}),
recov AS (SELECT * FROM looked WHERE outcome = 'recovered'),
fin AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts_ms, idx) AS place FROM (SELECT job_id, frame_id, idx, ts_ms, 0 AS times, NULL AS boundary, review FROM guarded UNION ALL SELECT job_id, frame_id, idx, ts_ms, count(*) AS times, max(bnd) AS boundary, '{B.RECOVERED_REVIEW}' AS review FROM recov GROUP BY job_id, frame_id, idx, ts_ms)),
r0 AS (SELECT job_id, bnd, string_agg(CAST(frame_id AS VARCHAR), ' ' ORDER BY side, idx) FILTER (outcome = 'recovered') AS recovered, string_agg(CAST(frame_id AS VARCHAR), ' ' ORDER BY side, idx) FILTER (outcome = 'contaminated') AS rejected, count(*) FILTER (outcome = 'recovered') AS nr, count(*) FILTER (outcome = 'contaminated') AS nc, first(ts_ms ORDER BY side, idx) FILTER (outcome = 'recovered') AS first_ms FROM looked GROUP BY job_id, bnd),
dr AS (SELECT b.job_id, b.bnd, true AS drift FROM bnd b JOIN reps x ON x.job_id = b.job_id AND x.seg = b.before_seg JOIN reps y ON y.job_id = b.job_id AND y.seg = b.after_seg JOIN guarded g ON g.job_id = b.job_id AND g.idx = x.idx JOIN guarded h ON h.job_id = b.job_id AND h.idx = y.idx WHERE abs(h.ts_ms - g.ts_ms) <= {BOUNDS.drift_ms} AND g.label = h.label),
rep AS (SELECT b.job_id, b.bnd, b.boundary_type, b.start_ms, coalesce(recovered, '') AS recovered, coalesce(rejected, '') AS rejected, coalesce(nr, 0) AS nr, coalesce(nc, 0) AS nc, coalesce(drift, false) AS drift,
CASE WHEN nc > 0 AND nr = 0 THEN '{B.ONLY_CONTAMINATED}' WHEN nr > 0 AND first_ms <= b.start_ms THEN '{B.SKIPPED_BEFORE}' WHEN nr > 0 THEN '{B.SKIPPED_AFTER}' WHEN drift THEN '{B.REPEATED}' END AS issue_type,
concat_ws('; ', CASE WHEN drift THEN '{B.WARN_DRIFT}' END, CASE WHEN nc > 0 AND nr = 0 THEN '{B.WARN_CONTAMINATED}' END) AS warnings FROM bnd b LEFT JOIN r0 USING (job_id, bnd) LEFT JOIN dr USING (job_id, bnd)),
sm0 AS (SELECT job_id, count(*) AS boundaries_detected, count(issue_type) AS issues_detected, sum(nr) AS recovered_states, sum(nc) AS candidates_rejected, coalesce(min(bnd) FILTER (drift), 1000000) AS fd, coalesce(min(bnd) FILTER (nc > 0 AND nr = 0), 1000000) AS fc FROM rep GROUP BY job_id),
summed AS (SELECT f.job_id, coalesce(boundaries_detected, 0) AS boundaries_detected, coalesce(issues_detected, 0) AS issues_detected, CAST(coalesce(recovered_states, 0) AS BIGINT) AS recovered_states, CAST(coalesce(candidates_rejected, 0) AS BIGINT) AS candidates_rejected, contaminated_frames, edge_warnings,
CASE WHEN fd <= fc THEN concat_ws('; ', CASE WHEN fd < 1000000 THEN '{B.WARN_DRIFT}' END, CASE WHEN fc < 1000000 THEN '{B.WARN_CONTAMINATED}' END) WHEN fc < fd THEN concat_ws('; ', '{B.WARN_CONTAMINATED}', CASE WHEN fd < 1000000 THEN '{B.WARN_DRIFT}' END) ELSE '' END AS warnings
FROM (SELECT job_id, count(*) FILTER (pts >= 65) AS contaminated_frames FROM tch GROUP BY job_id) f JOIN (SELECT job_id, count(review) AS edge_warnings FROM guarded GROUP BY job_id) g USING (job_id) LEFT JOIN sm0 USING (job_id))"""


NB = f"""{SIG}, n0 AS (SELECT job_id, frame_id, idx, b, lag(b) OVER w AS pb, lead(b) OVER w AS nb, count(*) OVER (PARTITION BY job_id) AS n FROM sg WINDOW w AS (PARTITION BY job_id ORDER BY idx)),
n1 AS (SELECT job_id, frame_id, idx, n, CASE WHEN pb IS NOT NULL THEN {ham('b', 'pb')} END AS prev, CASE WHEN nb IS NOT NULL THEN {ham('b', 'nb')} END AS nxt, CAST(list_sum(list_transform(range(1, 33), lambda i: abs(b[i] - b[i + 32]))) AS BIGINT) AS split FROM n0),
nb AS (SELECT *, lag(prev) OVER (PARTITION BY job_id ORDER BY idx) AS prev2, lead(nxt) OVER (PARTITION BY job_id ORDER BY idx) AS nxt2 FROM n1)"""
SCREENS = "sc AS (SELECT lang AS job_id, doc_id AS idx, lang || '/' || source AS label, string_split(text, chr(10))[1] AS key_text, text AS all_text, (doc_id % 100) / 100.0 AS conf, string_split(text, ' ')[1:2] AS components, CASE WHEN doc_id % 5 = 0 THEN 'scrolled' ELSE '' END AS state FROM documents)"


# Timelines (scans T1-T5, S4-S6, A1, J2).
@query(f"WITH {TL} SELECT job_id, frame_id, idx, ts_ms, label FROM tl")
def timeline_build(spark, d):
    return timed_frames(spark, d).select("job_id", "frame_id", "idx", "ts_ms", "label")


@query("SELECT event_id AS frame_id, event_id * 1000 // 4 AS ts_ms, 'frame_' || lpad(CAST(event_id + 1 AS VARCHAR), CAST(greatest(4, length(CAST(event_id + 1 AS VARCHAR))) AS INTEGER), '0') AS stem FROM events")
def timestamp_from_filename(spark, d):
    named = table(spark, d, "events").select(F.col("event_id").alias("frame_id"), F.format_string("some/folder/FRAME_%04d.JPG", F.col("event_id") + 1).alias("path"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return named.select("frame_id", T.time_of_name(name, 4).alias("ts_ms"), F.lower(T.frame_id(F.col("path"))).alias("stem"))


_KNOWN = "kn AS (SELECT job_id, frame_id, ts_ms + 5 AS known_ms FROM tl WHERE label = 'view')"


def _overridden(spark, d):
    frames = timed_frames(spark, d)
    known = frames.where("label = 'view'").select("job_id", "frame_id", (F.col("ts_ms") + 5).alias("known_ms"))
    return T.override_times(frames.withColumn("ts_ms", F.when(F.col("label") != "error", F.col("ts_ms"))), known)


@query(f"WITH {TL}, {_KNOWN} SELECT t.job_id, t.frame_id, coalesce(known_ms, CASE WHEN label <> 'error' THEN ts_ms END) AS ts_ms, CASE WHEN known_ms IS NOT NULL THEN 'map' WHEN label <> 'error' THEN 'filename' ELSE 'unknown' END AS source FROM tl t LEFT JOIN kn k ON k.job_id = t.job_id AND k.frame_id = t.frame_id")
def timestamp_override(spark, d):
    return _overridden(spark, d).select("job_id", "frame_id", "ts_ms", "source")


@query(f"WITH {TL} SELECT job_id, count(*) AS n_frames, count(*) FILTER (label IN ('purchase', 'signup')) AS n_final, count(*) FILTER (label = 'error') AS n_removed, CASE WHEN count(DISTINCT CASE label WHEN 'view' THEN 'map' WHEN 'error' THEN 'unknown' ELSE 'filename' END) = 1 THEN min(CASE label WHEN 'view' THEN 'map' WHEN 'error' THEN 'unknown' ELSE 'filename' END) ELSE 'mixed' END AS strategy FROM tl GROUP BY job_id")
def timeline_summary(spark, d):
    status = F.when(F.col("label").isin("purchase", "signup"), "final").when(F.col("label") == "error", "removed").otherwise("candidate")
    return T.summary(_overridden(spark, d).withColumn("status", status))


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)")
def label_attach(spark, d):
    return T.first_match(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").withColumn("o", F.col("quality")), ["doc_id"], "o")


# Motion (W1, W2, W4, W8, W9, T6, J4, F8).
@query(f"WITH {MO} SELECT job_id, idx, m FROM mo")
def motion_series(spark, d):
    return Mo.series(hashed_frames(spark, d)).withColumn("m", F.col("m").cast("long"))


@query(f"WITH {RUNS} SELECT job_id, idx, sm FROM sm")
def motion_smooth(spark, d):
    return Mo.smooth(Mo.series(hashed_frames(spark, d)), MOTION).select("job_id", "idx", "sm")


def _zone_columns(df, *more):
    return df.select("job_id", *more, "start_index", "end_index", "peak_index", F.col("score").cast("long").alias("score"), "kind")


@query(f"WITH {RUNS} SELECT job_id, start_index, end_index, peak_index, score, kind FROM runs")
def motion_runs(spark, d):
    return _zone_columns(Mo.runs(Mo.series(hashed_frames(spark, d)), MOTION))


@query(f"WITH {RUNS}, {ANOM} SELECT job_id, start_index, end_index, peak_index, score, kind FROM anom")
def motion_anomalies(spark, d):
    return _zone_columns(Mo.anomalies(Mo.series(hashed_frames(spark, d)), MOTION))


def _zones(spark, d):
    return Mo.zones(Mo.series(hashed_frames(spark, d)), MOTION)


@query(f"WITH {ZONES} SELECT job_id, 'motion_' || lpad(CAST(row_number() OVER (PARTITION BY job_id ORDER BY start_ms) AS VARCHAR), 4, '0') AS zone_id, start_ms, end_ms, start_index, end_index, peak_index, score, kind FROM zones")
def motion_zones_merged(spark, d):
    return _zone_columns(_zones(spark, d), "zone_id", "start_ms", "end_ms")


@query(f"WITH {ZONES} SELECT job_id, start_ms, CASE WHEN end_ms - start_ms <= 400 THEN 30 WHEN end_ms - start_ms <= 1500 THEN 15 ELSE 8 END AS dense_fps FROM zones")
def dense_fps_ladder(spark, d):
    return _zones(spark, d).select("job_id", "start_ms", "dense_fps")


_IN = "EXISTS (SELECT 1 FROM zones z WHERE z.job_id = sg.job_id AND sg.idx BETWEEN z.start_index AND z.end_index)"


@query(f"WITH {ZONES} SELECT job_id, frame_id, idx FROM sg WHERE {_IN}")
def in_zone_semi(spark, d):
    return Mo.in_zone(hashed_frames(spark, d), _zones(spark, d)).select("job_id", "frame_id", "idx")


@query(f"WITH {ZONES} SELECT job_id, frame_id, idx FROM sg WHERE NOT {_IN}")
def out_of_zone_anti(spark, d):
    return Mo.in_zone(hashed_frames(spark, d), _zones(spark, d), inside=False).select("job_id", "frame_id", "idx")


@query(f"""WITH {ZONES}, dz AS (SELECT *, 'motion_' || lpad(CAST(row_number() OVER (PARTITION BY job_id ORDER BY start_ms) AS VARCHAR), 4, '0') AS zone_id, CASE WHEN end_ms - start_ms <= 400 THEN 30 WHEN end_ms - start_ms <= 1500 THEN 15 ELSE 8 END AS fps FROM zones),
e AS (SELECT *, unnest(range(0, CAST(ceil(greatest(end_ms - start_ms, 50) * fps / 1000.0) AS BIGINT))) AS i FROM dz)
SELECT job_id, zone_id, i + 1 AS ordinal, 'frame_z' || zone_id[8:] || '_' || lpad(CAST(i + 1 AS VARCHAR), 4, '0') || '.jpg' AS name, start_ms + i * 1000 // fps AS ts_ms FROM e""")
def dense_zone_scan(spark, d):
    return Mo.dense_times(_zones(spark, d))


def _flagged(spark, d):
    return Mo.zone_flags(hashed_frames(spark, d), _zones(spark, d))


# The high-rate source of a recording: five frames for each of the sparse ones, with some bits turned over.
_DENSE = f"""{ZONES}, dz AS (SELECT *, 'motion_' || lpad(CAST(row_number() OVER (PARTITION BY job_id ORDER BY start_ms) AS VARCHAR), 4, '0') AS zone_id, CASE WHEN end_ms - start_ms <= 400 THEN 30 WHEN end_ms - start_ms <= 1500 THEN 15 ELSE 8 END AS fps FROM zones),
dt AS (SELECT job_id, zone_id, fps, 'frame_z' || zone_id[8:] || '_' || lpad(CAST(i + 1 AS VARCHAR), 4, '0') || '.jpg' AS path, start_ms + i * 1000 // fps AS ts_ms FROM (SELECT *, unnest(range(0, CAST(ceil(greatest(end_ms - start_ms, 50) * fps / 1000.0) AS BIGINT))) AS i FROM dz)),
src AS (SELECT job_id, frame_id * 5 + j AS frame_id, (idx * 5 + j) * 1000 // 30 AS ts_ms, list_transform(range(1, 65), lambda i: CASE WHEN i <= j THEN 1 - b[i] ELSE b[i] END) AS b FROM sg, range(0, 5) t(j)),
lo AS (SELECT d.*, s.ts_ms AS lo_ms, s.frame_id AS lo_id, s.b AS lo_b FROM dt d ASOF LEFT JOIN src s ON s.job_id = d.job_id AND d.ts_ms >= s.ts_ms),
hi AS (SELECT d.*, s.ts_ms AS hi_ms, s.frame_id AS hi_id, s.b AS hi_b FROM lo d ASOF LEFT JOIN src s ON s.job_id = d.job_id AND d.ts_ms <= s.ts_ms),
dn AS (SELECT job_id, path, ts_ms, CASE WHEN lo_id IS NOT NULL AND (hi_id IS NULL OR ts_ms - lo_ms <= hi_ms - ts_ms) THEN lo_id ELSE hi_id END AS taken, CASE WHEN lo_id IS NOT NULL AND (hi_id IS NULL OR ts_ms - lo_ms <= hi_ms - ts_ms) THEN lo_b ELSE hi_b END AS b FROM hi)"""
_SCOUT = f"""fl0 AS (SELECT *, {_IN} AS inz, lag(b) OVER w AS pb, lead(b) OVER w AS nb FROM sg WINDOW w AS (PARTITION BY job_id ORDER BY idx)),
fl AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY idx) - 1 AS pl FROM fl0 WHERE inz OR NOT (coalesce({ham('b', 'pb')}, -1) > 33 AND coalesce({ham('b', 'nb')}, -1) > 33)),
walk AS (SELECT job_id, pl, idx, b, CASE WHEN inz THEN NULL ELSE b END AS last, true AS keep FROM fl WHERE pl = 0 UNION ALL SELECT s.job_id, s.pl, s.idx, s.b, CASE WHEN s.inz THEN NULL WHEN w.last IS NULL THEN s.b WHEN {ham('s.b', 'w.last')} >= 28 THEN s.b ELSE w.last END, CASE WHEN s.inz OR w.last IS NULL THEN true ELSE {ham('s.b', 'w.last')} >= 28 END FROM walk w JOIN fl s ON s.job_id = w.job_id AND s.pl = w.pl + 1),
mg AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts_ms, path) - 1 AS idx FROM (SELECT job_id, path, ts_ms, 'dense' AS pass, b FROM dn UNION ALL SELECT job_id, 'frame_' || lpad(CAST(idx + 1 AS VARCHAR), greatest(4, length(CAST(idx + 1 AS VARCHAR)))::INTEGER, '0') || '.jpg', idx * 1000 // 6, 'scout', b FROM walk WHERE keep))"""


def _recording(spark, d):
    """The sparse frames with paths, their zones, and the high-rate source."""
    scout = stored(hashed_frames(spark, d).withColumn("path", F.format_string("frame_%04d.jpg", F.col("idx") + 1)))
    zones = stored(Mo.zones(Mo.series(scout), MOTION))
    j = F.col("j").cast("long")
    each = scout.select("job_id", "frame_id", "idx", "sig", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j"))
    turned = F.col("sig").bitwiseXOR(F.expr("shiftleft(1L, j) - 1"))
    return scout, zones, each.select("job_id", (F.col("frame_id") * 5 + j).alias("frame_id"), F.floor((F.col("idx") * 5 + j) * 1000 / 30).alias("ts_ms"), turned.alias("sig"))


@query(f"WITH {_DENSE} SELECT job_id, path, ts_ms, taken FROM dn")
def dense_frames_taken(spark, d):
    _, zones, source = _recording(spark, d)
    return Ad.dense_frames(zones, source).select("job_id", "path", "ts_ms", F.col("frame.frame_id").alias("taken"))


@query(f"WITH RECURSIVE {_DENSE}, {_SCOUT} SELECT job_id, path, ts_ms, pass, idx FROM mg")
def adaptive_merge(spark, d):
    scout, zones, source = _recording(spark, d)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    kept = Ad.scouted(scout, zones, 33, 28).select("job_id", "path", T.time_of_name(name, MOTION.fps).alias("ts_ms"), F.lit("scout").alias("pass"), "sig")
    dense = Ad.dense_frames(zones, source).select("job_id", "path", "ts_ms", F.lit("dense").alias("pass"), F.col("frame.sig").alias("sig"))
    return Ad.merged(kept, dense).select("job_id", "path", "ts_ms", "pass", "idx")


@query(f"WITH RECURSIVE {_DENSE}, {_SCOUT}, kw AS (SELECT job_id, path, ts_ms, idx, [b] AS kept, true AS keep FROM mg WHERE idx = 0 UNION ALL SELECT job_id, path, ts_ms, idx, CASE WHEN far THEN list_append(kept, b) ELSE kept END, far FROM (SELECT s.job_id, s.path, s.ts_ms, s.idx, s.b, w.kept, list_bool_and(list_transform(w.kept, lambda k: list_sum(list_transform(range(1, 65), lambda i: abs(k[i] - s.b[i]))) >= 3)) AS far FROM kw w JOIN mg s ON s.job_id = w.job_id AND s.idx = w.idx + 1)) SELECT job_id, path, ts_ms, idx FROM kw WHERE keep")
def adaptive_frames(spark, d):
    scout, zones, source = _recording(spark, d)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    kept = Ad.scouted(scout, zones, 33, 28).select("job_id", "path", T.time_of_name(name, MOTION.fps).alias("ts_ms"), "sig")
    both = Ad.merged(kept, Ad.dense_frames(zones, source).select("job_id", "path", "ts_ms", F.col("frame.sig").alias("sig")))
    return Ad.unlike(both, 3).select("job_id", "path", "ts_ms", "idx")


# Stability.
_HALVES = f"""{SIG}, h0 AS (SELECT *, count(*) OVER (PARTITION BY job_id) AS n, lag(b) OVER w AS pb, lead(b) OVER w AS nb, lead(b, 2) OVER w AS nnb, lag(b, 2) OVER w AS ppb FROM sg WINDOW w AS (PARTITION BY job_id ORDER BY idx)),
h1 AS (SELECT job_id, frame_id, idx, n, {ham('b', 'pb')} AS prev, {ham('b', 'nb')} AS nxt, {ham('nb', 'nnb')} AS nxt2, {ham('pb', 'ppb')} AS prev2, CAST(list_sum(list_transform(range(1, 33), lambda i: abs(b[i] - b[i + 32]))) AS BIGINT) AS sides,
CAST(list_sum(list_transform(range(1, 33), lambda i: abs(b[i] - pb[i + 32]))) AS BIGINT) AS in_left, CAST(list_sum(list_transform(range(1, 33), lambda i: abs(b[i + 32] - nb[i]))) AS BIGINT) AS in_right, {ham('b', 'nb', 1, 16)} AS edge FROM h0)"""
_INNER = "idx > 0 AND idx < n - 1"


@query(f"""WITH RECURSIVE {_HALVES}, h2 AS (SELECT *, CASE WHEN idx = n - 1 AND idx > 0 AND sides > 17 THEN 'last_split' WHEN NOT ({_INNER}) THEN NULL WHEN prev > 36 AND nxt > 36 THEN 'between_changes' WHEN least(prev, nxt) > 30 AND sides > 17 THEN 'split' WHEN prev > 32 AND nxt <= 32 AND nxt2 > 32 AND sides > 17 THEN 'late' WHEN prev <= 32 AND nxt > 32 AND prev2 > 32 AND sides > 17 THEN 'early' END AS base,
CASE WHEN {_INNER} AND prev > 28 AND nxt > 28 THEN CASE WHEN in_left <= 16 AND in_right <= 16 THEN 'slide' WHEN (idx % 7) / 10 < 0.15 THEN 'fade' END END AS blend, {_INNER} AND nxt <= 31 AND edge > 8 AS edged FROM h1),
walk AS (SELECT job_id, frame_id, idx, base AS rule FROM h2 WHERE idx = 0 UNION ALL SELECT h.job_id, h.frame_id, h.idx, CASE WHEN h.base IS NOT NULL THEN h.base WHEN h.blend IS NOT NULL AND w.rule IS NULL THEN h.blend WHEN h.edged THEN 'edge' END FROM walk w JOIN h2 h ON h.job_id = w.job_id AND h.idx = w.idx + 1) SELECT job_id, frame_id, idx, rule FROM walk""")
def stability_rules(spark, d):
    return St.verdicts(_halved(spark, d), STABLE).select("job_id", "frame_id", "idx", "rule")


def _halved(spark, d):
    """Signatures whose halves stand in for those of images."""
    sig = F.col("sig")
    left, right = half(sig, False), half(sig, True)
    splits = F.array(F.struct(left.alias("left"), right.alias("right")))
    return hashed_frames(spark, d).withColumns({"is_split": St.is_split(splits, STABLE.split), "left_hash": left, "right_hash": right, "edge_hash": sig.bitwiseAND(F.lit(0xFFFF)), "fade_error": (F.col("idx") % 7) / 10})


@query(f"WITH {_HALVES} SELECT job_id, frame_id, idx, coalesce(prev, -1) AS prev, coalesce(nxt, -1) AS next, sides FROM h1")
def diffs_debug(spark, d):
    found = St.diffs(_halved(spark, d))
    return found.select("job_id", "frame_id", "idx", *[F.col(c).cast("long").alias(c) for c in ("prev", "next", "sides")])


@query(f"WITH {ZONES}, {NB[NB.index('n0 AS'):]} SELECT sg.job_id, sg.frame_id, sg.idx FROM sg JOIN nb ON nb.job_id = sg.job_id AND nb.idx = sg.idx WHERE NOT (NOT {_IN} AND coalesce(prev, -1) > 33 AND coalesce(nxt, -1) > 33)")
def scout_filter(spark, d):
    return St.scout(_flagged(spark, d), 33).select("job_id", "frame_id", "idx")


@query(f"WITH {NB}, tt AS (SELECT *, coalesce(max(CASE WHEN prev <= 30 THEN idx END) OVER (PARTITION BY job_id), 0) AS last FROM nb) SELECT job_id, frame_id, idx FROM tt WHERE n < 3 OR idx <= last")
def trailing_trim(spark, d):
    return St.trim_tail(hashed_frames(spark, d), 30).select("job_id", "frame_id", "idx")


# Deduplication.
@query(f"WITH RECURSIVE {SIG}, walk AS (SELECT job_id, idx, b AS last, true AS keep FROM sg WHERE idx = 0 UNION ALL SELECT s.job_id, s.idx, CASE WHEN {ham('s.b', 'w.last')} >= 30 THEN s.b ELSE w.last END, {ham('s.b', 'w.last')} >= 30 FROM walk w JOIN sg s ON s.job_id = w.job_id AND s.idx = w.idx + 1) SELECT job_id, idx FROM walk WHERE keep")
def dedup_consecutive(spark, d):
    return D.consecutive(hashed_frames(spark, d), 30)


@query(f"WITH RECURSIVE {ZONES}, fl AS (SELECT *, {_IN} AS inz FROM sg), walk AS (SELECT job_id, idx, CASE WHEN inz THEN NULL ELSE b END AS last, true AS keep FROM fl WHERE idx = 0 UNION ALL SELECT s.job_id, s.idx, CASE WHEN s.inz THEN NULL WHEN w.last IS NULL THEN s.b WHEN {ham('s.b', 'w.last')} >= 30 THEN s.b ELSE w.last END, CASE WHEN s.inz OR w.last IS NULL THEN true ELSE {ham('s.b', 'w.last')} >= 30 END FROM walk w JOIN fl s ON s.job_id = w.job_id AND s.idx = w.idx + 1) SELECT job_id, idx FROM walk WHERE keep")
def dedup_consecutive_zone_reset(spark, d):
    return D.consecutive_with_zones(_flagged(spark, d), 30)


@query(f"WITH RECURSIVE {SIG}, walk AS (SELECT job_id, idx, [b] AS kept, true AS keep FROM sg WHERE idx = 0 UNION ALL SELECT job_id, idx, CASE WHEN far THEN list_append(kept, b) ELSE kept END, far FROM (SELECT s.job_id, s.idx, s.b, w.kept, list_bool_and(list_transform(w.kept, lambda k: list_sum(list_transform(range(1, 65), lambda i: abs(k[i] - s.b[i]))) >= 26)) AS far FROM walk w JOIN sg s ON s.job_id = w.job_id AND s.idx = w.idx + 1)) SELECT job_id, idx FROM walk WHERE keep")
def dedup_global(spark, d):
    return D.leaders(hashed_frames(spark, d), 26)


@query(f"WITH {SIG}, both_kinds AS (SELECT job_id, idx, b FROM sg UNION ALL SELECT job_id, idx + 1000000, list_transform(range(1, 65), lambda i: CASE WHEN i <= idx % 20 THEN 1 - b[i] ELSE b[i] END) FROM sg) SELECT * FROM (SELECT x.job_id, x.idx AS a, y.idx AS b, {ham('x.b', 'y.b')} AS distance FROM both_kinds x JOIN both_kinds y ON x.job_id = y.job_id AND x.idx < y.idx) WHERE distance < 16")
def near_dup_pairs(spark, d):
    frames = hashed_frames(spark, d).select("job_id", "idx", "sig")
    # Copies with up to 19 of their bits turned over.
    turned = F.col("sig").bitwiseXOR(F.expr("shiftleft(1L, cast(idx % 20 AS int)) - 1"))
    copies = frames.withColumns({"sig": turned, "idx": F.col("idx") + 1_000_000})
    return D.near_pairs(frames.unionByName(copies), 16).withColumn("distance", F.col("distance").cast("long"))


@query(f"""WITH {SCREENS}, k AS (SELECT job_id, label, idx, state, list_sort(components) AS parts, lower(regexp_replace(key_text, '^\\s+|\\s+$', '', 'g')) AS t FROM sc)
SELECT job_id, label, idx FROM k QUALIFY row_number() OVER (PARTITION BY job_id, CASE WHEN t = '' AND len(parts) = 0 THEN 'path' || idx ELSE 'key' || label END, t, parts, state ORDER BY idx) = 1""")
def semantic_dedup(spark, d):
    return D.first_of_meaning(screens(spark, d)).select("job_id", "label", "idx")


# Segments (W3, W10, T5, T7, A2, A8).
@query(f"WITH {ROLL} SELECT job_id, 'segment_' || lpad(CAST(seg AS VARCHAR), 4, '0') AS segment_id, start_index, end_index, start_ms, end_ms, end_ms - start_ms AS duration_ms, n_frames, CASE WHEN n_frames = 1 THEN 'single_frame' WHEN end_ms - start_ms < {SEGMENTS.short_ms} THEN 'short_stable' ELSE 'stable' END AS segment_type FROM roll")
def segments(spark, d):
    return S.roll_up(timed_frames(spark, d), SEGMENTS).select("job_id", "segment_id", "start_index", "end_index", "start_ms", "end_ms", "duration_ms", "n_frames", "segment_type")


@query(f"WITH {REPS} SELECT job_id, seg, frame_id, idx, ts_ms, st, en, n_frames FROM reps")
def representatives(spark, d):
    return S.representatives(timed_frames(spark, d), SEGMENTS).withColumn("seg", F.col("seg").cast("long"))


@query(f"WITH {TL} SELECT job_id, idx, idx + 1 AS seg FROM tl")
def index_fallback_segments(spark, d):
    frames = timed_frames(spark, d).withColumn("ts_ms", F.when(F.col("idx") != 3, F.col("ts_ms")))
    alone = frames.withColumn("ts_ms", F.when(F.col("idx") > 0, F.col("ts_ms")))
    return S.assign(alone, SEGMENTS).select("job_id", "idx", F.col("seg").cast("long").alias("seg"))


@query(f"WITH {REPS}, b AS (SELECT job_id, min(ts_ms) AS begin_ms FROM tl GROUP BY job_id) SELECT r.job_id, r.ts_ms - b.begin_ms > {2 * SEGMENTS.guard_ms} AS late_start, r.en - r.st < {SEGMENTS.short_ms} AND r.n_frames > 1 AS short_first FROM reps r JOIN b ON b.job_id = r.job_id WHERE r.seg = 1")
def segment_warnings(spark, d):
    return S.warnings(timed_frames(spark, d), SEGMENTS)


# Boundaries.
@query(f"WITH {bounded(False)} SELECT job_id, 'boundary_' || lpad(CAST(bnd AS VARCHAR), 4, '0') AS boundary_id, start_ms, end_ms, peak_ms FROM bnd")
def boundaries(spark, d):
    return B.detect(timed_frames(spark, d), SEGMENTS).select("job_id", "boundary_id", "start_ms", "end_ms", "peak_ms")


def _moving(spark, d):
    """Frames with signs of motion made from their values."""
    value = F.col("value")
    return timed_frames(spark, d).withColumns({"motion_prev": value / 100, "motion_next": (value - 20) / 100, "sharpness": value / 14})


def _moved(spark, d):
    at = F.col("ts_ms")
    return timed_frames(spark, d).where("label = 'error'").select("job_id", F.lit("multi").alias("kind"), (at - HOUR // 2).alias("start_ms"), (at + HOUR // 2).alias("end_ms"), at.alias("peak_ms"))


@query(f"WITH {bounded(False)} SELECT job_id, idx, pts / 100.0::DOUBLE AS score, CASE WHEN pts >= 65 THEN 'likely_transition_contaminated' ELSE 'likely_stable_state' END AS class FROM tch")
def contamination_score(spark, d):
    frames = _moving(spark, d)
    kinds = B.judged(frames, SEGMENTS, BOUNDS)
    return kinds.select("job_id", "idx", (F.col("points") / 100).alias("score"), B.candidate_class(F.col("contaminated"), F.col("segment_type")).alias("class"))


@query(f"WITH {bounded(False)} SELECT job_id, seg, frame_id, idx, near, moved, review FROM guarded")
def edge_guard(spark, d):
    return B.guarded(_moving(spark, d), SEGMENTS, BOUNDS).select("job_id", F.col("seg").cast("long").alias("seg"), "frame_id", "idx", "near", "moved", "review")


@query(f"WITH {bounded(False)} SELECT job_id, bnd, frame_id, idx, side FROM recov")
def recovery_candidates(spark, d):
    return B.recovered(_moving(spark, d), SEGMENTS, BOUNDS).select("job_id", F.col("bnd").cast("long").alias("bnd"), "frame_id", "idx", F.col("side").cast("int").alias("side"))


@query(f"WITH {bounded(True)} SELECT job_id, 'boundary_' || lpad(CAST(bnd AS VARCHAR), 4, '0') AS boundary_id, boundary_type, start_ms, end_ms, peak_ms, CAST(before_seg AS BIGINT) AS before_seg, CAST(after_seg AS BIGINT) AS after_seg FROM bnd")
def boundaries_mixed(spark, d):
    found = B.detect(_moving(spark, d), SEGMENTS, _moved(spark, d))
    return found.select("job_id", "boundary_id", "boundary_type", "start_ms", "end_ms", "peak_ms", F.col("before_seg").cast("long").alias("before_seg"), F.col("after_seg").cast("long").alias("after_seg"))


@query(f"WITH {bounded(True)} SELECT job_id, bnd, frame_id, side, outcome FROM looked")
def recovery_rejected(spark, d):
    found = B.candidates(_moving(spark, d), SEGMENTS, BOUNDS, _moved(spark, d)).where("outcome is not null")
    return found.select("job_id", F.col("bnd").cast("long").alias("bnd"), "frame_id", F.col("side").cast("int").alias("side"), "outcome")


@query(f"WITH {bounded(True)} SELECT job_id, bnd, boundary_type, recovered, rejected, issue_type, warnings FROM rep")
def boundary_report(spark, d):
    found = B.report(_moving(spark, d), SEGMENTS, BOUNDS, _moved(spark, d))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return found.select("job_id", F.col("bnd").cast("long").alias("bnd"), "boundary_type", ids("recovered"), ids("rejected"), "issue_type", F.array_join("warnings", "; ").alias("warnings"))


_SUMMED = "SELECT job_id, boundaries_detected, issues_detected, recovered_states, candidates_rejected, contaminated_frames, edge_warnings, CAST(0 AS BIGINT) AS short_state_preserved, warnings FROM summed"


@query(f"WITH {bounded(False)} {_SUMMED}")
def boundary_summary(spark, d):
    return B.summary(_moving(spark, d), SEGMENTS, BOUNDS).withColumn("warnings", F.array_join("warnings", "; "))


@query(f"WITH {bounded(True)} {_SUMMED}")
def boundary_summary_mixed(spark, d):
    return B.summary(_moving(spark, d), SEGMENTS, BOUNDS, _moved(spark, d)).withColumn("warnings", F.array_join("warnings", "; "))


@query(f"WITH {bounded(True)} SELECT job_id, frame_id, times, boundary, review, place FROM fin")
def final_merge(spark, d):
    out = B.final(_moving(spark, d), SEGMENTS, BOUNDS, _moved(spark, d))
    return out.select("job_id", "frame_id", "times", F.col("boundary").cast("long").alias("boundary"), "review", F.col("place").cast("long").alias("place"))


def _chosen_reps(spark, d):
    """Two of three segments' representatives, as if other ones had not been selected."""
    return S.representatives(_moving(spark, d), SEGMENTS).where("seg % 3 <> 0").select("job_id", "frame_id")


_SELECTED = bounded(True, "seg % 3 <> 0")
_SHORT = "sh AS (SELECT r.job_id, r.frame_id, r.idx, r.ts_ms FROM reps r JOIN tch t ON t.job_id = r.job_id AND t.idx = r.idx WHERE r.n_frames > 1 AND r.en - r.st < {short} AND r.seg > 1 AND r.seg < (SELECT max(seg) FROM reps l WHERE l.job_id = r.job_id) AND r.seg % 3 = 0 AND t.pts < 65)".format(short=SEGMENTS.short_ms)


@query(f"""WITH {_SELECTED}, {_SHORT}, al AS (SELECT job_id, frame_id, times, boundary, review, idx, ts_ms, 0 AS stage FROM fin UNION ALL SELECT job_id, frame_id, 0, NULL, '{B.SHORT_REVIEW}', idx, ts_ms, 1 FROM sh),
on1 AS (SELECT job_id, frame_id, max(times) AS times, max(boundary) AS boundary, arg_max(coalesce(review, ''), stage) AS review, any_value(idx) AS idx, any_value(ts_ms) AS ts_ms FROM al GROUP BY job_id, frame_id)
SELECT job_id, frame_id, times, boundary, CASE WHEN review <> '' THEN review END AS review, row_number() OVER (PARTITION BY job_id ORDER BY ts_ms, idx) AS place FROM on1""")
def short_states_kept(spark, d):
    out = B.final(_moving(spark, d), SEGMENTS, BOUNDS, _moved(spark, d), _chosen_reps(spark, d))
    return out.select("job_id", "frame_id", "times", F.col("boundary").cast("long").alias("boundary"), "review", F.col("place").cast("long").alias("place"))


_CLASS = "y.label || '/' || (y.frame_id % 3)"


@query(f"""WITH {bounded(True)}, bk AS (SELECT job_id, frame_id, max(bnd) AS bnd FROM recov GROUP BY job_id, frame_id),
x AS (SELECT t.*, r.n_frames, r.en - r.st AS len, r.frame_id AS rep, t.frame_id = r.frame_id AS is_rep, coalesce(t.frame_id = g.frame_id, false) AS chosen, g.moved, k.bnd AS back FROM tch t JOIN reps r ON r.job_id = t.job_id AND r.seg = t.seg LEFT JOIN guarded g ON g.job_id = t.job_id AND g.seg = t.seg LEFT JOIN bk k ON k.job_id = t.job_id AND k.frame_id = t.frame_id),
y AS (SELECT *, chosen OR back IS NOT NULL AS fnl, 'segment_' || lpad(CAST(seg AS VARCHAR), 4, '0') AS segment FROM x),
c AS (SELECT y.job_id, y.frame_id, {_CLASS} AS lab, CASE WHEN y.frame_id % 2 = 0 THEN 'typed' END AS typ, f.place FROM y JOIN fin f ON f.job_id = y.job_id AND f.frame_id = y.frame_id),
u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY job_id, lab, frame_id % 7 ORDER BY place) = 1),
z AS (SELECT y.*, u.lab, u.typ, u.frame_id IS NOT NULL AS told FROM y LEFT JOIN u ON u.job_id = y.job_id AND u.frame_id = y.frame_id)
SELECT job_id, CAST(frame_id AS VARCHAR) AS frame_id, idx AS index, ts_ms AS timestamp_ms, 'in/frame_' || frame_id || '.jpg' AS path, 'frame_' || frame_id || '.jpg' AS filename, 'extracted' AS source, CASE WHEN fnl AND told THEN 'final' ELSE 'removed' END AS status,
CASE WHEN NOT (fnl AND told) THEN NULL WHEN back IS NOT NULL THEN '{B.KEPT_RECOVERED}' WHEN moved OR n_frames > 1 THEN '{B.KEPT_STABLE}' ELSE '{B.KEPT_SINGLE}' END AS keep_reason,
CASE WHEN fnl AND NOT told THEN '{B.REMOVED_DUPLICATE}' WHEN back IS NOT NULL THEN NULL WHEN is_rep AND moved THEN '{B.REMOVED_MOVED}' WHEN is_rep THEN NULL ELSE '{B.REMOVED_REST}' END AS remove_reason,
fnl AND told AS is_final, false AS is_blank_removed, fnl AND NOT told AS is_duplicate_removed, lab AS label, CASE WHEN told THEN coalesce(typ, split_part(lab, '/', 1)) END AS screen_type, value / 100 AS motion_score_prev, (value - 20) / 100 AS motion_score_next, value / 14 AS sharpness_score, CAST(NULL AS DOUBLE) AS brightness_score, CAST(NULL AS DOUBLE) AS contrast_score, segment AS segment_id,
'filename' AS timestamp_source, CASE WHEN n_frames = 1 THEN 'single_frame' WHEN len < {SEGMENTS.short_ms} THEN 'short_stable' ELSE 'stable' END AS segment_type, CASE WHEN is_rep OR chosen THEN segment END AS representative_for_segment, pts / 100.0::DOUBLE AS transition_contamination_score, pts >= 65 AS is_transition_contaminated,
coalesce(nullif(concat_ws('; ', CASE WHEN inside THEN 'inside_transition_zone' END, CASE WHEN near THEN 'near_transition_edge' END, CASE WHEN hp THEN 'high_motion_prev' END, CASE WHEN hn THEN 'high_motion_next' END, CASE WHEN hp AND hn THEN 'high_motion_prev_next' END, CASE WHEN bl THEN 'low_sharpness' END), ''), 'no_signal') AS contamination_reason,
CASE WHEN back IS NOT NULL OR (is_rep AND chosen AND (inside OR near)) THEN true END AS needs_review, CASE WHEN back IS NOT NULL THEN '{B.RECOVERED_REVIEW}' WHEN is_rep AND chosen AND (inside OR near) THEN '{B.NEAR_REVIEW}' END AS review_reason, CASE WHEN back IS NOT NULL THEN true END AS boundary_recovery, 'boundary_' || lpad(CAST(back AS VARCHAR), 4, '0') AS boundary_id, CASE WHEN chosen AND moved THEN CAST(rep AS VARCHAR) END AS replaced_representative_id FROM z""")
def timeline_final(spark, d):
    path = F.concat(F.lit("in/frame_"), F.col("frame_id"), F.lit(".jpg"))
    frames = _moving(spark, d).withColumns({"path": path, "source": F.lit("filename")})
    found = B.analyse(frames, SEGMENTS, BOUNDS, _moved(spark, d))
    again = stored(B.brought_back(found, BOUNDS))
    told = T.apply_changes(T.items(found.frames.withColumn("label", F.lit(None))), B.changes(found, BOUNDS, again))
    label = F.concat("label", F.lit("/"), (F.col("frame_id") % 3).cast("string"))
    shown = B.final_of(found, BOUNDS, again).select("job_id", "frame_id", "place").join(found.frames.select("job_id", "frame_id", "path", label.alias("label")), ["job_id", "frame_id"])
    classes = shown.select("job_id", F.col("place").alias("idx"), "path", "label", F.when(F.col("frame_id") % 2 == 0, "typed").alias("screen_type"), (F.col("frame_id") % 7).cast("string").alias("key_text"), F.array().cast("array<string>").alias("components"), F.lit("").alias("state"))
    return T.with_classes(told, D.first_of_meaning(classes), B.REMOVED_DUPLICATE, B.REMOVED_CONTAMINATED)


@query(f"WITH {REPS}, l AS (SELECT r.job_id, r.seg, r.ts_ms, t.label FROM reps r JOIN tl t ON t.job_id = r.job_id AND t.idx = r.idx), p AS (SELECT *, lead(seg) OVER w AS next_seg, lead(ts_ms) OVER w AS nms, lead(label) OVER w AS nl FROM l WINDOW w AS (PARTITION BY job_id ORDER BY seg)) SELECT job_id, seg, next_seg, label FROM p WHERE nl = label AND nms - ts_ms <= {6 * HOUR}")
def drift_pairs(spark, d):
    frames = timed_frames(spark, d)
    chosen = S.representatives(frames, SEGMENTS).join(frames.select("job_id", "idx", "label"), ["job_id", "idx"])
    return B.drifting(chosen, 6 * HOUR).select("job_id", F.col("seg").cast("long").alias("seg"), F.col("next_seg").cast("long").alias("next_seg"), "label")


@query(f"WITH {ROLL} SELECT job_id, seg FROM (SELECT *, max(seg) OVER (PARTITION BY job_id) AS last FROM roll) WHERE n_frames > 1 AND end_ms - start_ms < {SEGMENTS.short_ms} AND seg > 1 AND seg < last")
def short_states(spark, d):
    return B.short_states(S.roll_up(timed_frames(spark, d), SEGMENTS)).select("job_id", F.col("seg").cast("long").alias("seg"))


# Classification.
@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_isolate(spark, d):
    raw = table(spark, d, "events").select("event_id", F.concat(F.lit("Here you are:\n```json\n"), "props", F.lit("\n```\nBye {now}")).alias("raw"))
    return raw.select("event_id", F.from_json(C.isolate(F.col("raw")), "k long")["k"].alias("k"))


@query("""SELECT event_id, i AS position, CASE WHEN (event_id % 5 IN (0, 1) AND i < 2) OR (event_id % 5 = 2 AND i = 0) OR (event_id % 5 = 4 AND i = 1) THEN 'home/' || i ELSE 'unsorted' END AS label, CASE WHEN (event_id % 5 IN (0, 1) AND i < 2) OR (event_id % 5 = 2 AND i = 0) OR (event_id % 5 = 4 AND i = 1) THEN CAST(props->>'$.k' AS DOUBLE) / 50 ELSE 0 END AS conf,
CASE WHEN event_id % 5 = 4 AND i = 0 THEN 'item at index 0 was not an object' WHEN (event_id % 5 IN (0, 1, 4) AND i < 2) OR (event_id % 5 = 2 AND i = 0) THEN '' ELSE 'missing item from Gemini response' END AS uncertainty_reason,
CASE WHEN event_id % 5 = 1 AND i < 2 THEN 7 ELSE i + 1 END AS frame_index, CASE WHEN event_id % 5 = 0 AND i < 2 THEN 'a,1' WHEN event_id % 5 = 1 AND i < 2 THEN 'b' ELSE '' END AS components, event_id % 5 = 2 AND i = 0 AS is_transition FROM events, (SELECT unnest(range(0, 3)) AS i)""")
def answers_parsed(spark, d):
    i, share = F.col("event_id") % 5, F.get_json_object("props", "$.k").cast("double") / 50
    item = lambda n, more: F.concat(F.lit(f'{{"label": "home/{n}", "conf": '), share.cast("string"), F.lit(f"{more}}}"))
    more = ', "components": ["a", "", null, 1]', ', "components": "b", "frame_index": 7', ', "is_transition": "Yes"'
    listed = lambda x: F.concat(F.lit("["), item(0, x), F.lit(", "), item(1, x), F.lit("]"))
    answer = (
        F.when(i == 0, F.concat(F.lit('Sure:\n```json\nSee {"screens": '), listed(more[0]), F.lit("} .\n```\nBye")))
        .when(i == 1, listed(more[1]))
        .when(i == 2, F.concat(F.lit("It is [one "), item(0, more[2]), F.lit(" of them")))
        .when(i == 3, F.lit("no answer"))
        .otherwise(F.concat(F.lit('["x", '), item(1, ""), F.lit("]")))
    )
    parsed = C.answers(table(spark, d, "events").select("event_id", answer.alias("raw"), F.lit(3).alias("expected")))
    rows = C.normalise(C.exactly(parsed, "expected"))
    return rows.select("event_id", "position", "label", "conf", "uncertainty_reason", "frame_index", F.array_join("components", ",").alias("components"), "is_transition")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unsorted' WHEN doc_id % 3 = 1 THEN 'x' || source ELSE lang || '/' || source END AS label, CASE WHEN doc_id % 3 = 0 THEN 'unsorted' WHEN doc_id % 3 = 1 THEN 'x' || source ELSE lang END AS screen_type, doc_id / 500.0::DOUBLE AS conf, doc_id % 2 = 0 AS is_scroll_state FROM documents")
def classification_normalise(spark, d):
    i = F.col("doc_id")
    item = F.struct(F.when(i % 3 == 2, F.concat_ws("/", "lang", "source")).when(i % 3 == 1, F.lit("")).alias("label"), F.when(i % 3 == 1, F.concat(F.lit("x"), "source")).alias("screen_type"), (i / 500.0).alias("conf"), F.when(i % 2 == 0, "scrolled").alias("state"))
    raw = table(spark, d, "documents").select("doc_id", i.alias("position"), F.to_variant_object(item).alias("item"))
    return C.normalise(raw).select("doc_id", "label", "screen_type", "conf", "is_scroll_state")


_KINDS = "CASE doc_id % 6 WHEN 0 THEN 'Paywall/x' WHEN 1 THEN 'onboarding' WHEN 2 THEN 'transition' WHEN 3 THEN 'checkout' WHEN 4 THEN 'login' ELSE 'home' END"
_TYPES = "CASE doc_id % 16 WHEN 0 THEN 'Subscription' WHEN 1 THEN 'notification_prompt' WHEN 2 THEN 'sign_in_with_apple_google' WHEN 3 THEN 'cart' ELSE '' END"


def _any(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


@query(f"""WITH {SCREENS}, k AS (SELECT idx AS doc_id, CASE WHEN {_TYPES.replace('doc_id', 'idx')} <> '' THEN lower({_TYPES.replace('doc_id', 'idx')}) ELSE lower(split_part({_KINDS.replace('doc_id', 'idx')}, '/', 1)) END AS kind, idx % 7 = 0 AS moving, key_text, all_text, conf, lower(key_text || chr(10) || all_text) AS low FROM sc),
v AS (SELECT *, length(regexp_replace(all_text, '^\\s+|\\s+$', '', 'g')) AS na, length(regexp_replace(key_text, '^\\s+|\\s+$', '', 'g')) AS nk FROM k)
SELECT doc_id, concat_ws('; ', CASE WHEN kind IN ('paywall', 'special_offer', 'trial_offer', 'subscription') AND NOT {_any(C.PAYWALL_WORDS)} THEN 'paywall_without_pricing_text' END, CASE WHEN kind = 'onboarding' AND {_any(C.ONBOARDING_PRICE_WORDS)} THEN 'onboarding_with_pricing_text' END,
CASE WHEN (kind = 'transition' OR moving) AND na > 24 AND nk > 2 THEN 'transition_with_content' END, CASE WHEN conf >= 0.65 AND na = 0 AND nk = 0 AND kind NOT IN ('transition', 'system_tray', 'app_switcher', 'home_screen', 'loading', 'splash') THEN 'empty_text_at_high_conf' END, CASE WHEN conf < 0.65 THEN 'low_confidence' END,
CASE WHEN kind IN ('checkout', 'payment', 'cart') AND NOT {_any(C.CHECKOUT_WORDS)} THEN 'checkout_without_checkout_text' END, CASE WHEN kind IN ('auth', 'login', 'signup', 'otp_verification', 'sign_in_with_apple_google') AND NOT {_any(C.SIGN_IN_WORDS)} THEN 'auth_without_auth_text' END,
CASE WHEN kind IN ('permission', 'notification_prompt') AND NOT {_any(C.PERMISSION_WORDS)} THEN 'permission_without_permission_text' END) AS review_reason FROM v""")
def validate_rules(spark, d):
    shown = screens(spark, d).withColumnRenamed("idx", "doc_id").withColumns({"label": F.expr(_KINDS), "screen_type": F.expr(_TYPES), "is_transition": F.col("doc_id") % 7 == 0})
    return C.rules(shown).select("doc_id", C.reasons(F.lit(None).cast("string"), F.col("warnings")).alias("review_reason"))


@query(f"WITH {SCREENS} SELECT job_id, count(*) AS frame_count, count(*) FILTER (conf < 0.65) AS needs_review_count, count(*) FILTER (conf < 0.65) AS n_warned FROM sc GROUP BY job_id")
def classification_debug(spark, d):
    shown = screens(spark, d).withColumns({"needs_review": F.lit(False), "review_reason": F.lit("")})
    found = classification_report(C.rules(shown.withColumns({"label": F.lit("home"), "all_text": F.lit("x")})))
    return found.select("job_id", "frame_count", "needs_review_count", F.size("validation_warnings_by_frame").cast("long").alias("n_warned"))


# Roll-ups (A4-A7, W14-W16, S12, S13, S16, J9, F11-F13).
_PLACED = "pl AS (SELECT *, row_number() OVER (PARTITION BY job_id, label ORDER BY idx) - 1 AS number FROM sc WHERE label NOT IN ('transition', 'system_tray', 'app_switcher', 'home_screen'))"


@query(f"WITH {SCREENS}, {_PLACED} SELECT job_id, idx, number, replace(label, '/', '__') || '/' || lpad(CAST(number AS VARCHAR), 3, '0') || '.jpg' AS path FROM pl")
def rank_in_label(spark, d):
    return M.placed(screens(spark, d)).select("job_id", "idx", "number", "path")


@query(f"""WITH {SCREENS}, {_PLACED} SELECT job_id, job_id AS parent, upper(job_id[1]) || job_id[2:] AS title, 'http://host/images/' || job_id || '/' || replace(label, '/', '__') || '/' || lpad(CAST(number AS VARCHAR), greatest(3, length(CAST(number AS VARCHAR)))::INTEGER, '0') || '.jpg' AS url, job_id AS label, coalesce(key_text, '') AS key_text, array_to_string(components, ',') AS components, state FROM pl""")
def sections_view(spark, d):
    found = M.sections(M.tree(screens(spark, d)), "http://host").select("job_id", "parent", "title", F.explode("images").alias("x"))
    return found.select("job_id", "parent", "title", "x.url", "x.label", "x.key_text", F.array_join("x.components", ",").alias("components"), "x.state")


def _labelled(spark, d):
    """Documents as screens whose labels are their sources, with children for two of three."""
    i = F.col("doc_id") % 3
    label = F.when(i == 0, F.col("source")).otherwise(F.concat("source", F.lit("/"), (F.col("doc_id") % 5).cast("string")))
    return table(spark, d, "documents").select(F.col("lang").alias("job_id"), F.col("doc_id").alias("idx"), label.alias("label"))


@query(f"""WITH lb AS (SELECT lang AS job_id, doc_id AS idx, CASE doc_id % 3 WHEN 0 THEN source ELSE source || '/' || (doc_id % 5) END AS label FROM documents),
pl AS (SELECT *, row_number() OVER (PARTITION BY job_id, label ORDER BY idx) - 1 AS number, split_part(label, '/', 1) AS parent, nullif(split_part(label, '/', 2), '') AS child FROM lb),
fi AS (SELECT *, min(idx) OVER (PARTITION BY job_id, parent) AS first, min(idx) OVER (PARTITION BY job_id, label) AS child_first FROM pl)
SELECT job_id, dense_rank() OVER (PARTITION BY job_id ORDER BY first) - 1 AS position, parent, row_number() OVER (PARTITION BY job_id, parent ORDER BY child IS NOT NULL, CASE WHEN child IS NOT NULL THEN child_first END, idx) - 1 AS place, '/images/' || job_id || '/' || replace(label, '/', '__') || '/' || lpad(CAST(number AS VARCHAR), greatest(3, length(CAST(number AS VARCHAR)))::INTEGER, '0') || '.jpg' AS url FROM fi""")
def sections_in_order(spark, d):
    found = M.sections(M.tree(_labelled(spark, d))).select("job_id", "position", "parent", F.posexplode("images").alias("place", "x"))
    return found.select("job_id", F.col("position").cast("long").alias("position"), "parent", F.col("place").cast("long").alias("place"), "x.url")


@query("""WITH lb AS (SELECT lang AS job_id, doc_id AS idx, CASE doc_id % 3 WHEN 0 THEN source ELSE source || '/' || (doc_id % 5) END AS label FROM documents),
sc AS (SELECT job_id, min(idx) AS first, count(*) AS n FROM lb GROUP BY job_id, split_part(label, '/', 1)),
w AS (SELECT *, n * 414 - 24 + 80 AS width FROM sc)
SELECT job_id, row_number() OVER o - 1 AS position, 100 + CAST(coalesce(sum(width + 80) OVER (PARTITION BY job_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x, width, CAST(976 AS BIGINT) AS height, (n - 1) * 414 + 40 AS last_card FROM w WINDOW o AS (PARTITION BY job_id ORDER BY first)""")
def section_layout(spark, d):
    found = M.layout(M.sections(M.tree(_labelled(spark, d))))
    return found.select("job_id", F.col("position").cast("long").alias("position"), "x", "width", "height", F.element_at("cards", -1).cast("long").alias("last_card"))


@query(f"WITH {SCREENS} SELECT job_id, string_agg(DISTINCT label, ',' ORDER BY label) AS sections FROM sc GROUP BY job_id")
def section_names(spark, d):
    return M.section_names(screens(spark, d)).withColumn("sections", F.array_join("sections", ","))


@query(f"WITH {ZONES}, k AS (SELECT job_id, count(*) AS out_of FROM sg WHERE NOT {_IN} GROUP BY job_id) SELECT s.job_id, count(*) AS extracted, count(*) - coalesce(max(out_of), 0) AS dupes FROM sg s LEFT JOIN k ON k.job_id = s.job_id GROUP BY s.job_id")
def job_counters(spark, d):
    frames = hashed_frames(spark, d)
    return M.counters(frames, Mo.in_zone(frames, _zones(spark, d), inside=False))


@query(f"WITH {SCREENS}, {_PLACED}, n AS (SELECT job_id, split_part(label, '/', 2) AS child, count(*) AS c FROM pl GROUP BY ALL) SELECT job_id, child, c AS n_images FROM n")
def manifest_tree(spark, d):
    trees = M.tree(screens(spark, d)).select("job_id", F.explode("manifest").alias("parent", "node"))
    return trees.select("job_id", F.explode("node.children").alias("child", "images")).select("job_id", "child", F.size("images").cast("long").alias("n_images"))


_STEP = "CASE WHEN label = 'purchase' THEN 'paywall/annual' WHEN label = 'signup' THEN 'onboarding' WHEN label = 'error' THEN 'transition' WHEN label = 'click' AND idx % 3 = 0 THEN 'special_offer' WHEN label = 'click' THEN 'paywall/special_offer' ELSE label END"
_STEPS = f"st AS (SELECT job_id, idx, {_STEP} AS label FROM tl)"
_FUNNEL = f"{TL}, {_STEPS}, sh AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY idx) - 1 AS place FROM st WHERE label NOT IN ('transition', 'system_tray', 'app_switcher')), fu AS (SELECT job_id, string_agg(label, '>' ORDER BY place) AS sequence, list(DISTINCT label) AS kinds, count(*) AS n, min(CASE WHEN label LIKE 'paywall%' THEN place END) AS paywall_position, count(*) FILTER (label LIKE 'onboarding%') AS onboarding_count, bool_or(label LIKE 'special_offer%') AS has_downsell FROM sh GROUP BY job_id)"


def _profiles(spark, d):
    return M.funnel(timed_frames(spark, d).withColumn("label", F.expr(_STEP)))


@query(f"WITH {_FUNNEL} SELECT job_id, sequence, paywall_position, onboarding_count, has_downsell FROM fu")
def funnel_profile(spark, d):
    return _profiles(spark, d).withColumn("sequence", F.array_join("sequence", ">"))


@query(f"WITH {_FUNNEL} SELECT job_id, repeat('tier ' || job_id || ' ', 12)[1:80] AS competitive_tier, n AS funnel_length, paywall_position, has_downsell FROM fu WHERE job_id % 4 <> 0")
def session_list(spark, d):
    # Three of four jobs have an analysis.
    jobs = timed_frames(spark, d).select("job_id").distinct().where("job_id % 4 <> 0")
    texts = {c: F.lit("x") for c in ANALYSIS} | {"competitive_tier": F.expr("repeat('tier ' || job_id || ' ', 12)")}
    listed = M.session_list(session_documents(_profiles(spark, d), jobs.withColumns(texts)))
    return listed.withColumn("funnel_length", F.col("funnel_length").cast("long"))


@query(f"WITH {_FUNNEL} SELECT a.job_id AS job_a, b.job_id AS job_b, a.n AS steps_a, b.n AS steps_b, CAST(len(list_intersect(a.kinds, b.kinds)) AS BIGINT) AS shared_kinds, b.paywall_position - a.paywall_position AS paywall_shift FROM fu a JOIN fu b ON b.job_id = a.job_id + 1")
def session_compare(spark, d):
    profiles = _profiles(spark, d)
    return M.compare(profiles, profiles.select(F.col("job_id").alias("job_a"), (F.col("job_id") + 1).alias("job_b")))


@query(f"WITH {TL}, n AS (SELECT *, count(*) OVER (PARTITION BY job_id) AS n FROM tl) SELECT job_id, idx FROM n WHERE n <= 20 OR list_contains(list_transform(range(0, 20), lambda i: i * n // 20), idx)")
def even_subsample(spark, d):
    return M.evenly(timed_frames(spark, d)).select("job_id", "idx")


@query(f"WITH {SCREENS} SELECT idx, label NOT IN ('transition', 'system_tray', 'app_switcher', 'home_screen') AS image, split_part(label, '/', 1) NOT IN ('transition', 'system_tray', 'app_switcher', 'home_screen', 'unsorted') AS analysed, label NOT IN ('transition', 'system_tray', 'app_switcher') AS step FROM (SELECT idx, CASE idx % 4 WHEN 0 THEN 'home_screen' WHEN 1 THEN 'transition/x' WHEN 2 THEN 'unsorted' ELSE label END AS label FROM sc)")
def junk_filters(spark, d):
    label = F.col("label")
    shown = screens(spark, d).withColumn("label", F.expr("CASE idx % 4 WHEN 0 THEN 'home_screen' WHEN 1 THEN 'transition/x' WHEN 2 THEN 'unsorted' ELSE label END"))
    return shown.select("idx", (~label.isin(*M.NO_IMAGE)).alias("image"), (~M.parent(label).isin(*M.NO_ANALYSIS)).alias("analysed"), (~label.isin(*M.NO_STEP)).alias("step"))
