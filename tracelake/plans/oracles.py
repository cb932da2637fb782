"""DuckDB SQL with the results of the registered queries, built from a few shared common table expressions."""

from __future__ import annotations

from tracelake.functions.filters import zero_phase_kernel
from tracelake.operators.spectrum import BANDS
from tracelake.plans.queries import EXCLUDED, LEVEL

SIG = "sig AS (SELECT event_id AS i, value AS v FROM events)"
USR = "usr AS (SELECT CAST(user_id AS VARCHAR) AS rec, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS i, value AS v FROM events)"


def runs(source: str, mask: str, name: str = "r0") -> str:
    return f"{name} AS (SELECT min(i) AS s, max(i) + 1 AS e FROM (SELECT i, i - row_number() OVER (ORDER BY i) AS g FROM {source} WHERE {mask}) GROUP BY g)"


def merged(source: str, gap: int, name: str) -> str:
    return f"{name} AS (SELECT min(s) AS s, max(e) AS e FROM (SELECT s, e, sum(b) OVER (ORDER BY s) AS g FROM (SELECT s, e, CASE WHEN s - lag(e) OVER (ORDER BY s) <= {gap} THEN 0 ELSE 1 END AS b FROM {source})) GROUP BY g)"


def stats(source: str, intervals: str, rate: float, baseline: str, residual: str, digits: int = 6, where: str = "") -> str:
    return f"""SELECT s, e, avg(v) AS m0, avg({residual}) AS r, stddev_pop({residual}) AS sd, avg({baseline} + {residual}) AS mc, avg({baseline}) AS bc, sum(abs({residual})) / {rate} AS area
        FROM {intervals} JOIN {source} ON i >= s AND i < e {where} GROUP BY s, e"""


def event_columns(rate: float) -> str:
    return f"""'events' AS recording_id, s AS start_idx, e AS end_idx, round(s / {rate}, 6) AS start_time, round(e / {rate}, 6) AS end_time, round((e - s) / {rate}, 6) AS duration,
        round(mc, 6) AS mean_current, round(sd, 6) AS std_current, round(bc, 6) AS baseline_current, round(abs(r), 6) AS depth,
        round(CASE WHEN abs(bc) > 1e-10 THEN abs(r) / abs(bc) ELSE 0 END, 6) AS relative_depth, round(area, 6) AS area"""


def detected(way: str, rate: float = 1.0) -> str:
    """CTEs r_, m_ and x_ of one direction: residual beyond 25 from the fixed level, gap 1, three samples."""
    mask = f"v - {LEVEL} < -25.0" if way == "down" else f"v - {LEVEL} > 25.0"
    return ", ".join([runs("sig", mask, f"r_{way}"), merged(f"r_{way}", 1, f"m_{way}"), f"l_{way} AS (SELECT * FROM m_{way} WHERE e - s >= 3)", f"x_{way} AS ({stats('sig', f'l_{way}', rate, str(LEVEL), f'(v - {LEVEL})')})"])


def percentile_window(source: str, h: int, p: float, value: str = "v", name: str = "b") -> str:
    at = f"CAST(floor({p / 100.0} * (len(l) - 1) + 0.5) AS BIGINT) + 1"
    return f"""{name}_l AS (SELECT i, v, list_sort(list_filter(list({value}) OVER (ORDER BY i ROWS BETWEEN {h} PRECEDING AND {h - 1} FOLLOWING), lambda x: x IS NOT NULL)) AS l FROM {source}),
        {name} AS (SELECT i, v, CASE WHEN len(l) > 0 THEN l[{at}] END AS b FROM {name}_l)"""


PIPELINE_MIN = f"""
WITH {SIG}, {percentile_window("sig", 25, 90.0, "v", "p1")},
s1 AS (SELECT i, v, v - avg(b) OVER (ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS r FROM p1),
n1 AS (SELECT 1.4826 * median(abs(r - (SELECT median(r) FROM s1))) AS n FROM s1),
k AS (SELECT i, v, CASE WHEN abs(r) < 5.0 * n THEN v END AS w FROM s1 CROSS JOIN n1),
{percentile_window("k", 25, 50.0, "w", "p2")},
spare AS (SELECT quantile_disc(w, 0.5 ORDER BY w DESC) AS z FROM k),
s2 AS (SELECT i, v, avg(coalesce(b, z)) OVER (ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS bl FROM p2 CROSS JOIN spare),
q AS (SELECT i, v, bl, v - bl AS r FROM s2),
n2 AS (SELECT 1.4826 * median(abs(r - (SELECT median(r) FROM q))) AS n FROM q),
m AS (SELECT i FROM q CROSS JOIN n2 WHERE r > 2.0 * n),
{runs("m", "true")}, {merged("r0", 2, "ev")}, big AS (SELECT * FROM ev WHERE e - s >= 3)
SELECT s AS start_idx, e AS end_idx, round(avg(v), 6) AS mean_current, round(stddev_pop(r), 6) AS std_current, round(avg(bl), 6) AS baseline_current, round(abs(avg(r)), 6) AS depth,
    round(CASE WHEN abs(avg(bl)) > 1e-10 THEN abs(avg(r)) / abs(avg(bl)) ELSE 0 END, 6) AS relative_depth, round(sum(abs(r)), 4) AS area
FROM big JOIN q ON i >= s AND i < e GROUP BY s, e"""

N_EVENTS = "(SELECT count(*) FROM events)"
RAW_RANGES = "raw AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b})" for a, b in EXCLUDED) + ") t(a, b))"
NORMAL = f"""{RAW_RANGES}, cl AS (SELECT greatest(least(a, b), 0)::DOUBLE AS t0, least(greatest(a, b), {N_EVENTS})::DOUBLE AS t1 FROM raw), cp AS (SELECT * FROM cl WHERE t0 < t1),
    nm AS (SELECT min(t0) AS t0, max(t1) AS t1 FROM (SELECT t0, t1, sum(b) OVER (ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS g FROM
        (SELECT t0, t1, CASE WHEN t0 > max(t1) OVER (ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER (ORDER BY t0, t1) = 1 THEN 1 ELSE 0 END AS b FROM cp)) GROUP BY g)"""
KEPT = f"""{NORMAL}, kp AS (SELECT a AS t0, b AS t1 FROM (SELECT coalesce(lag(t1) OVER (ORDER BY t0), 0.0) AS a, t0 AS b FROM (SELECT * FROM nm UNION ALL SELECT {N_EVENTS}::DOUBLE, {N_EVENTS}::DOUBLE)) WHERE a < b)"""
TABLE = f"""{KEPT}, tb AS (SELECT row_number() OVER (ORDER BY t0) - 1 AS rg, i0, i1, coalesce(sum(i1 - i0) OVER (ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base
    FROM (SELECT t0, greatest(floor(t0), 0)::BIGINT AS i0, least(ceil(t1), {N_EVENTS})::BIGINT AS i1 FROM kp) WHERE i0 < i1)"""
CAT = f"{SIG}, {TABLE}, cat AS (SELECT base + i - i0 AS j, i, v, rg FROM sig JOIN tb ON i >= i0 AND i < i1)"
TWO = f"""{SIG}, {runs("sig", "v > 60.0", "ra")}, {merged("ra", 2, "a")}, {runs("sig", "v > 75.0", "rb")}, {merged("rb", 2, "b")},
    pr AS (SELECT a.s AS truth_id, b.s AS det_id, a.s AS ts, a.e AS te, b.s AS ds, b.e AS de, (least(a.e, b.e) - greatest(a.s, b.s)) / ((a.e - a.s) + (b.e - b.s) - (least(a.e, b.e) - greatest(a.s, b.s)))::DOUBLE AS iou
        FROM a JOIN b ON a.s < b.e AND b.s < a.e)"""
PSD = f"""{USR}, sz AS (SELECT rec, max(i) + 1 AS n FROM usr GROUP BY rec HAVING max(i) + 1 >= 32),
    sg AS (SELECT rec, unnest(range(0, (n - 32) // 16 + 1)) AS sgm FROM sz),
    xs AS (SELECT u.rec, sgm, u.i - sgm * 16 AS t, (v - avg(v) OVER (PARTITION BY u.rec, sgm)) * (0.5 - 0.5 * cos(2 * pi() * (u.i - sgm * 16) / 32)) AS x FROM usr u JOIN sg ON u.rec = sg.rec AND u.i >= sgm * 16 AND u.i < sgm * 16 + 32),
    ft AS (SELECT rec, sgm, k, sum(x * cos(2 * pi() * k * t / 32)) AS c, sum(x * sin(2 * pi() * k * t / 32)) AS s FROM xs CROSS JOIN (SELECT unnest(range(0, 17)) AS k) GROUP BY rec, sgm, k),
    psd AS (SELECT rec, k, k * 100.0 / 32 AS f, avg((c * c + s * s) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END) / (100.0 * 12.0) AS p FROM ft GROUP BY rec, k)"""
LABELS = f"{USR}, lb AS (SELECT rec, i, least(floor(v / 25), 3)::BIGINT AS l FROM usr)"
LABEL_RUNS = f"""{LABELS}, lr AS (SELECT rec, l, min(i) AS s, max(i) + 1 AS e FROM (SELECT rec, i, l, row_number() OVER (PARTITION BY rec ORDER BY i) - row_number() OVER (PARTITION BY rec, l ORDER BY i) AS g FROM lb) GROUP BY rec, l, g)"""
FEATURES = f"""{SIG}, {runs("sig", f"v - {LEVEL} > 25.0", "ru")}, {merged("ru", 1, "mu")}, lu AS (SELECT * FROM mu WHERE e - s >= 2), x AS ({stats("sig", "lu", 1.0, str(LEVEL), f"(v - {LEVEL})")}),
    fe AS (SELECT s, abs(r) / abs(bc) AS f_relative_depth, abs(r) AS f_depth, log10(greatest((e - s)::DOUBLE, 1e-12)) AS f_log_duration, (e - s)::DOUBLE AS f_duration, sd AS f_std_current, mc AS f_mean_current,
        log10(greatest(abs(area), 1e-12)) AS f_log_abs_area, 1.0::DOUBLE AS f_n_levels FROM x)"""
FEATURE_NAMES = ("relative_depth", "depth", "log_duration", "duration", "std_current", "mean_current", "log_abs_area", "n_levels")


def kernel_sql(kind: str) -> str:
    k = zero_phase_kernel(kind, 4, 0.1, 1.0)
    h = len(k) // 2
    values = ", ".join(f"({o - h}, {w!r})" for o, w in enumerate(map(float, k)))
    return f"""WITH {SIG}, n AS (SELECT max(i) AS last FROM sig), k(o, w) AS (VALUES {values}),
        kt AS (SELECT i, w::DOUBLE AS w, CASE WHEN i + o < 0 THEN -(i + o) WHEN i + o > last THEN 2 * last - (i + o) ELSE i + o END AS j FROM sig CROSS JOIN k CROSS JOIN n)
        SELECT kt.i AS sample_idx, round(sum(w * v), 6) AS filtered FROM kt JOIN sig ON sig.i = kt.j GROUP BY kt.i"""


CROSS = """WITH g AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s, count(*)::DOUBLE AS w FROM events GROUP BY event_type),
p AS (SELECT a.event_type AS lt, b.event_type AS rt, a.m - 60 AS m1, a.s / 4 AS s1, a.w AS w1, b.m AS m2, b.s / 3 AS s2, b.w AS w2 FROM g a JOIN g b ON a.event_type < b.event_type),
q AS (SELECT *, (m1 + m2) / 2 AS mid, (1 / (s2 * s2) - 1 / (s1 * s1)) / 2 AS a, m1 / (s1 * s1) - m2 / (s2 * s2) AS b, m2 * m2 / (2 * s2 * s2) - m1 * m1 / (2 * s1 * s1) + ln(w1 * s2 / (w2 * s1)) AS c FROM p),
z AS (SELECT *, (-b + sqrt(b * b - 4 * a * c)) / (2 * a) AS x1, (-b - sqrt(b * b - 4 * a * c)) / (2 * a) AS x2 FROM q WHERE b * b - 4 * a * c >= 0),
o AS (SELECT lt, rt, CASE WHEN x1 BETWEEN least(m1, m2) AND greatest(m1, m2) AND NOT x2 BETWEEN least(m1, m2) AND greatest(m1, m2) THEN x1
    WHEN x2 BETWEEN least(m1, m2) AND greatest(m1, m2) AND NOT x1 BETWEEN least(m1, m2) AND greatest(m1, m2) THEN x2 WHEN abs(x1 - mid) <= abs(x2 - mid) THEN x1 ELSE x2 END AS x FROM z
    UNION ALL SELECT lt, rt, mid FROM q WHERE b * b - 4 * a * c < 0)
SELECT lt AS left_type, rt AS right_type, round(x, 6) AS crossing FROM o"""

PEAKS = f"""{PSD}, o AS (SELECT unnest(range(-12, 13)) AS o), w AS (SELECT a.rec, a.k, median(b.p) AS ref FROM psd a CROSS JOIN o JOIN psd b ON b.rec = a.rec AND b.k = least(greatest(a.k + o, 0), 16) GROUP BY a.rec, a.k),
    l AS (SELECT rec, k, f, p, lag(p) OVER (PARTITION BY rec ORDER BY k) AS x, lead(p) OVER (PARTITION BY rec ORDER BY k) AS y FROM psd),
    pk AS (SELECT l.rec, l.k, f, p, ref FROM l JOIN w ON w.rec = l.rec AND w.k = l.k WHERE l.k >= 2 AND l.k < 16 AND p >= x AND p >= y AND p > 0 AND ref > 0)"""
MAINS_LABEL = "CASE WHEN abs(f - 50) <= 3.125 THEN 'mains 50 Hz' WHEN abs(f - 60) <= 3.125 THEN 'mains 60 Hz' ELSE '' END"
#: Segments per recording: 25 rows are a quarter of a second; the length is that of a quarter of the signal, 64 at least.
NOISE_SPECTRUM = f"""WITH {USR}, sz AS (SELECT rec, max(i) + 1 AS n FROM usr GROUP BY rec), hi AS (SELECT rec, i FROM usr WHERE v > 110.0),
    ed AS (SELECT rec, i AS e FROM hi UNION ALL SELECT rec, n FROM sz), rn AS (SELECT rec, coalesce(lag(e) OVER (PARTITION BY rec ORDER BY e) + 1, 0) AS a, e AS b FROM ed), cr AS (SELECT * FROM rn WHERE a < b),
    sg AS (SELECT rec, a, unnest(range(0, (b - a - 64) // 32 + 1)) AS sgm FROM cr WHERE b - a >= 64),
    xs AS (SELECT u.rec, a, sgm, u.i - a - sgm * 32 AS t, (v - avg(v) OVER (PARTITION BY u.rec, a, sgm)) * (0.5 - 0.5 * cos(2 * pi() * (u.i - a - sgm * 32) / 64)) AS x FROM usr u JOIN sg ON u.rec = sg.rec AND u.i >= a + sgm * 32 AND u.i < a + sgm * 32 + 64),
    ft AS (SELECT rec, a, sgm, k, sum(x * cos(2 * pi() * k * t / 64)) AS c, sum(x * sin(2 * pi() * k * t / 64)) AS s FROM xs CROSS JOIN (SELECT unnest(range(0, 33)) AS k) GROUP BY rec, a, sgm, k)
    SELECT rec AS recording_id, k AS bin, round(k * 100.0 / 64, 5) AS freq, round(avg((c * c + s * s) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) / (100.0 * 24.0), 5) AS psd FROM ft GROUP BY rec, k"""

#: Percentile 90, what lies within 5 noise levels, percentile 90 of that, what lies within again, median of that.
CONTROL_STEPS = f"""{SIG}, {percentile_window("sig", 25, 90.0, "v", "p1")},
s1 AS (SELECT i, v, v - avg(b) OVER (ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS r FROM p1), n1 AS (SELECT 1.4826 * median(abs(r - (SELECT median(r) FROM s1))) AS n FROM s1),
k1 AS (SELECT i, v, CASE WHEN abs(r) < 5.0 * n THEN v END AS w FROM s1 CROSS JOIN n1), {percentile_window("k1", 25, 90.0, "w", "p2")}, z1 AS (SELECT quantile_disc(w, 0.5 ORDER BY w DESC) AS z FROM k1),
s2 AS (SELECT i, v, v - avg(coalesce(b, z)) OVER (ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS r FROM p2 CROSS JOIN z1), m2 AS (SELECT s2.i, s2.v, r, w IS NOT NULL AS k FROM s2 JOIN k1 USING (i)),
n2 AS (SELECT 1.4826 * median(abs(r - (SELECT median(r) FROM m2 WHERE k))) AS n FROM m2 WHERE k),
k2 AS (SELECT i, v, CASE WHEN abs(r) < 5.0 * n THEN v END AS w FROM s2 CROSS JOIN n2), {percentile_window("k2", 25, 50.0, "w", "p3")}, z2 AS (SELECT quantile_disc(w, 0.5 ORDER BY w DESC) AS z FROM k2),
s3 AS (SELECT i, v, avg(coalesce(b, z)) OVER (ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l FROM p3 CROSS JOIN z2), m3 AS (SELECT s3.i, s3.v - l AS r, l, w IS NOT NULL AS k FROM s3 JOIN k2 USING (i)),
n3 AS (SELECT 1.4826 * median(abs(r - (SELECT median(r) FROM m3 WHERE k))) AS n FROM m3 WHERE k)"""
CONTROL = f"""WITH {CONTROL_STEPS} SELECT 'events' AS recording_id, round((SELECT n FROM n3), 4) AS noise_std, round(avg(l), 4) AS baseline_mean, round(stddev_pop(l), 4) AS baseline_std, count(*) AS n_samples FROM m3"""


def plan_events(way: str) -> str:
    """Events of one direction beyond 25 from the refined baseline: gap 1, three samples."""
    mask = "r < -25.0" if way == "down" else "r > 25.0"
    return ", ".join([runs("q3", mask, f"r_{way}"), merged(f"r_{way}", 1, f"m_{way}"), f"l_{way} AS (SELECT * FROM m_{way} WHERE e - s >= 3)", f"x_{way} AS ({stats('q3', f'l_{way}', 1.0, 'l', 'r')})"])


PLAN_EVENTS = f"""WITH {CONTROL_STEPS}, q3 AS (SELECT i, l + r AS v, l, r FROM m3), {plan_events("up")}, {plan_events("down")}
SELECT {event_columns(1.0)}, 1 AS n_levels, 'single_level' AS event_type, 'up' AS direction FROM x_up UNION ALL SELECT {event_columns(1.0)}, 1, 'single_level', 'down' FROM x_down"""


def greedy(least: float, name: str = "gm") -> str:
    """One-to-one pairs, best overlap first; ties go to the higher truth id, then the higher detection id. Needs RECURSIVE."""
    return f"""{name}_o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY iou DESC, truth_id DESC, det_id DESC) AS o FROM pr WHERE iou >= {least}),
    {name}_t(o, ut, ud, ok) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[], false UNION ALL
        SELECT g.o, CASE WHEN list_contains(ut, g.truth_id) OR list_contains(ud, g.det_id) THEN ut ELSE list_append(ut, g.truth_id) END,
            CASE WHEN list_contains(ut, g.truth_id) OR list_contains(ud, g.det_id) THEN ud ELSE list_append(ud, g.det_id) END, NOT (list_contains(ut, g.truth_id) OR list_contains(ud, g.det_id))
        FROM {name}_t t JOIN {name}_o g ON g.o = t.o + 1),
    {name} AS (SELECT g.* FROM {name}_o g JOIN {name}_t t USING (o) WHERE t.ok)"""


MADE_DEPTH, MADE_LEVELS = "({e} - {s} + {s} % 3)::DOUBLE", "{s} % 2"

_SPREAD = "((s2[u + 1] - s2[s + 1]) - (s1[u + 1] - s1[s + 1]) * (s1[u + 1] - s1[s + 1]) / (u - s))"
#: Optimal partition by its recursion over ends u: least 8 samples a segment, penalty 2 * 1.5 * ln n; then back from the end.
PARTITION = f"""WITH RECURSIVE {USR}, ps AS (SELECT rec, i, sum(v) OVER w AS a, sum(v * v) OVER w AS b FROM usr WINDOW w AS (PARTITION BY rec ORDER BY i)),
    pl AS MATERIALIZED (SELECT rec, count(*) AS n, 3.0 * ln(count(*)) AS beta, list_prepend(0.0, list(a ORDER BY i)) AS s1, list_prepend(0.0, list(b ORDER BY i)) AS s2 FROM ps GROUP BY rec HAVING count(*) >= 16),
    c(rec, u, f, o) AS (SELECT rec, 0::BIGINT, [-beta]::DOUBLE[], [0]::BIGINT[] FROM pl UNION ALL
        SELECT rec, u, list_append(f, CASE WHEN u < 8 THEN 'inf'::DOUBLE ELSE list_min(tot) END), list_append(o, CASE WHEN u < 8 THEN 0 ELSE list_position(tot, list_min(tot)) - 1 END)
        FROM (SELECT rec, u, f, o, list_transform(range(0, u - 7), lambda s: f[s + 1] + (u - s) * (ln(CASE WHEN {_SPREAD} > 0 THEN {_SPREAD} ELSE 1e-20 END) - ln(u - s)) + beta) AS tot
            FROM (SELECT c.rec, c.u + 1 AS u, f, o, s1, s2, beta FROM c JOIN pl USING (rec) WHERE c.u < n))),
    e AS (SELECT rec, arg_max(o, u) AS o, max(u) AS n FROM c GROUP BY rec),
    b(rec, t) AS (SELECT rec, n FROM e UNION ALL SELECT b.rec, o[t + 1] FROM b JOIN e USING (rec) WHERE t > 0)
    SELECT rec AS recording_id, 0::BIGINT AS event_start, t AS at FROM b JOIN e USING (rec) WHERE t > 0 AND t < n"""

ORACLES: dict[str, str] = {
    "pelt_changepoints": PARTITION,
    "control_stats": CONTROL,
    "plan_events": PLAN_EVENTS,
    "suggest_figures": f"""WITH {SIG}, d AS (SELECT abs(v - lag(v) OVER (ORDER BY i)) AS d FROM sig WHERE i < 100000), f AS (SELECT (SELECT median(d) * 1.4826 / sqrt(2) FROM d WHERE d IS NOT NULL) AS noise, quantile_cont(v, 0.01) AS low, quantile_cont(v, 0.99) AS high, count(*) AS n FROM sig WHERE i < 500000)
        SELECT 'events' AS recording_id, round(noise, 6) AS noise, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN noise / (high - low) < 0.05 THEN 5.0 WHEN noise / (high - low) < 0.15 THEN 3.0 ELSE 2.0 END::DOUBLE AS n_sigma,
            round(least(5.0, greatest(1.0, 0.1 * n / 100.0))::DOUBLE, 6) AS window_sec, 0.15::DOUBLE AS merge_gap_sec, 5 AS components FROM f""",
    "greedy_match": f"WITH RECURSIVE {TWO}, {greedy(0.3)} SELECT truth_id, det_id, round(iou, 6) AS iou FROM gm",
    "metrics_prf": f"""WITH RECURSIVE {TWO}, {greedy(0.6)}, {greedy(1e-12, "am")}, n AS (SELECT (SELECT count(*) FROM a) AS nt, (SELECT count(*) FROM b) AS nd, (SELECT count(*) FROM gm) AS tp, (SELECT count(*) FROM am) AS an),
        x AS (SELECT abs((de - ds) / (te - ts)::DOUBLE - 1) AS dw, {MADE_DEPTH.format(s="ts", e="te")} AS td, {MADE_DEPTH.format(s="ds", e="de")} AS dd, {MADE_LEVELS.format(s="ts")} = {MADE_LEVELS.format(s="ds")} AS ok FROM gm),
        m AS (SELECT median(dw) AS dw, median(abs(dd - td) / td) AS dp, avg(ok::INT) AS lv FROM x)
        SELECT 'events' AS recording_id, nt AS n_true, nd AS n_detected, tp, round(tp / nt::DOUBLE, 6) AS recall, round(tp / nd::DOUBLE, 6) AS precision, round(2.0 * tp / (nt + nd), 6) AS f1, round(2.0 * an / (nt + nd), 6) AS f1_any,
            round(dw, 6) AS dwell_err, round(dp, 6) AS depth_err, round(lv, 6) AS level_acc FROM n CROSS JOIN m""",
    "event_waveforms": f"WITH {SIG}, {runs('sig', 'v > 60.0')}, {merged('r0', 2, 'm')} SELECT s AS event, round(i / 100.0, 6) AS time, round(v, 6) AS signal, {LEVEL}::DOUBLE AS baseline, round(v - {LEVEL}, 6) AS residual FROM m JOIN sig ON i >= greatest(s - 3, 0) AND i < e + 3 WHERE e - s >= 6",
    "first_events": f"""WITH {SIG}, {detected('up')}, {detected('down')}, z AS (SELECT *, 'up' AS w FROM x_up UNION ALL SELECT *, 'down' FROM x_down)
        SELECT CAST(row_number() OVER (ORDER BY s, w) AS INTEGER) AS rank, s AS start_idx, e AS end_idx, w AS direction, round(abs(r), 6) AS depth FROM z QUALIFY rank <= 12""",
    "windowed_view": f"""WITH {CAT}, q AS (SELECT j - min(j) OVER () AS j, i, v FROM cat WHERE i >= 50 AND i < 950), n AS (SELECT count(*) AS n FROM q), c AS (SELECT *, j * 30 // n AS b FROM q CROSS JOIN n),
        e AS (SELECT j, i, v, row_number() OVER (PARTITION BY b ORDER BY v, j) AS lo, row_number() OVER (PARTITION BY b ORDER BY v DESC, j) AS hi FROM c), p AS (SELECT j, i, v, i - lag(i) OVER (ORDER BY j) > j - lag(j) OVER (ORDER BY j) AS g FROM e WHERE lo = 1 OR hi = 1)
        SELECT j::DOUBLE AS position, i::DOUBLE AS time, round(v, 6) AS value FROM p UNION ALL SELECT j - 0.5, NULL, NULL FROM p WHERE g""",
    "raw_round_trip": f"WITH {SIG} SELECT 'events' AS recording_id, i AS sample_idx, round(((round_even((v - 1.0) / 0.05, 0))::FLOAT * 0.05::FLOAT + 1.0::FLOAT)::DOUBLE, 3) AS value FROM sig",
    "events_csv": f"""WITH {SIG}, {detected('up')}, {detected('down')}, z AS (SELECT {event_columns(1.0)}, 'up' AS direction FROM x_up UNION ALL SELECT {event_columns(1.0)}, 'down' FROM x_down)
        SELECT *, CAST(row_number() OVER (ORDER BY start_idx, direction) - 1 AS INTEGER) AS event_id, 1 AS n_levels, 'single_level' AS event_type FROM z""",
    "best_config": """WITH s AS (SELECT l_linestatus, l_returnflag, avg(l_discount) AS x FROM lineitem GROUP BY ALL), u AS (SELECT * FROM s UNION ALL SELECT 'all', l_returnflag, avg(x) FROM s GROUP BY 2)
        SELECT l_linestatus, l_returnflag AS best, round(x, 6) AS score FROM u QUALIFY row_number() OVER (PARTITION BY l_linestatus ORDER BY x DESC, l_returnflag) = 1""",
    "noise_mad": f"WITH {USR}, c AS (SELECT rec, median(v) AS m FROM usr GROUP BY rec) SELECT rec AS recording_id, round(1.4826 * median(abs(v - m)), 6) AS noise FROM usr JOIN c USING (rec) GROUP BY rec",
    "noise_std": f"WITH {USR} SELECT rec AS recording_id, round(stddev_pop(v), 6) AS noise FROM usr GROUP BY rec",
    "noise_floor_diff": f"WITH {SIG}, d AS (SELECT abs(v - lag(v) OVER (ORDER BY i)) AS d FROM sig WHERE i < 100000) SELECT 'events' AS recording_id, round(median(d) * 1.4826 / sqrt(2), 6) AS noise FROM d WHERE d IS NOT NULL",
    "robust_noise_std": f"""WITH {USR}, d AS (SELECT rec, v - lag(v) OVER (PARTITION BY rec ORDER BY i) AS d FROM usr), c AS (SELECT rec, median(d) AS m FROM d WHERE d IS NOT NULL GROUP BY rec),
        r AS (SELECT rec, median(abs(d - m)) / 0.6745 / sqrt(2) AS x FROM d JOIN c USING (rec) WHERE d IS NOT NULL GROUP BY rec), p AS (SELECT rec, count(*) AS n, stddev_pop(v) AS sd FROM usr GROUP BY rec)
        SELECT rec AS recording_id, round(coalesce(CASE WHEN n >= 3 THEN nullif(x, 0) END, nullif(sd, 0), 1), 6) AS noise FROM p LEFT JOIN r USING (rec)""",
    "find_runs": f"WITH {SIG}, {runs('sig', 'v > 60.0')} SELECT 'events' AS recording_id, s AS start_idx, e AS end_idx FROM r0",
    "merge_intervals": f"WITH {SIG}, {runs('sig', 'v > 60.0')}, {merged('r0', 3, 'm')} SELECT 'events' AS recording_id, s AS start_idx, e AS end_idx FROM m",
    "event_stats": f"WITH {SIG}, {runs('sig', f'v - {LEVEL} > 40.0')}, {merged('r0', 2, 'm')}, x AS ({stats('sig', 'm', 1.0, str(LEVEL), f'(v - {LEVEL})')}) SELECT {event_columns(1.0)}, 1 AS n_levels, 'single_level' AS event_type FROM x",
    "detect_events_up": f"WITH {SIG}, {detected('up')} SELECT {event_columns(1.0)}, 'up' AS direction FROM x_up",
    "detect_events_down": f"WITH {SIG}, {detected('down')} SELECT {event_columns(1.0)}, 'down' AS direction FROM x_down",
    "detect_events_both": f"WITH {SIG}, {detected('up')}, {detected('down')} SELECT {event_columns(1.0)}, 'up' AS direction FROM x_up UNION ALL SELECT {event_columns(1.0)}, 'down' FROM x_down",
    "hysteresis_events": f"WITH {SIG}, {runs('sig', 'v > 50.0')}, h AS (SELECT s, e FROM r0 JOIN sig ON i >= s AND i < e GROUP BY s, e HAVING max(v) > 120.0), {merged('h', 1, 'm')} SELECT 'events' AS recording_id, s AS start_idx, e AS end_idx FROM m WHERE e - s >= 2",
    "baseline_percentile_direct": f"WITH {SIG}, {percentile_window('sig', 25, 90.0)} SELECT i AS sample_idx, round(b, 6) AS baseline FROM b",
    "baseline_smooth": f"WITH {SIG} SELECT i AS sample_idx, round(avg(v) OVER (ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS baseline FROM sig",
    "baseline_masked_fallback": f"WITH {SIG}, k AS (SELECT i, v, CASE WHEN v > 80.0 THEN v END AS w FROM sig), {percentile_window('k', 5, 50.0, 'w')}, z AS (SELECT quantile_disc(w, 0.5 ORDER BY w DESC) AS z FROM k) SELECT i AS sample_idx, round(coalesce(b, z), 6) AS baseline FROM b CROSS JOIN z",
    "baseline_sparse_interp": f"""WITH {SIG}, n AS (SELECT max(i) + 1 AS n, CAST(ceil((max(i) + 1) / 100.0) AS BIGINT) AS c FROM sig), ce AS (SELECT unnest(range(0, c)) AS s FROM n),
        l AS (SELECT s, list_sort(list(v)) AS l FROM ce JOIN sig ON i >= s * 100 - 200 AND i < s * 100 + 200 GROUP BY s), b AS (SELECT s, l[CAST(floor(0.9 * (len(l) - 1) + 0.5) AS BIGINT) + 1] AS b FROM l),
        p AS (SELECT i, greatest(least(i // 100, c - 2), 0) AS s FROM sig CROSS JOIN n)
        SELECT i AS sample_idx, round(coalesce(x.b + (i - p.s * 100) / 100.0::DOUBLE * (y.b - x.b), x.b), 6) AS baseline FROM p JOIN b x ON x.s = p.s LEFT JOIN b y ON y.s = p.s + 1""",
    "residual_within": f"WITH {SIG} SELECT i AS sample_idx, round(v - {LEVEL}, 6) AS residual FROM sig WHERE v - {LEVEL} < 20 AND v - {LEVEL} > -20",
    "block_median_baseline": f"""WITH {SIG}, m AS (SELECT i // 64 AS k, avg(i) AS c, median(v) AS m FROM sig GROUP BY 1), l AS (SELECT k, c, list_sort(list(m) OVER (ORDER BY k ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) AS l FROM m)
        SELECT 'events' AS recording_id, k AS block, round(c, 6) AS center, round(l[CAST(floor(0.8 * (len(l) - 1) + 0.5) AS BIGINT) + 1], 6) AS baseline FROM l""",
    "detrend_linear": f"""WITH {USR}, l AS (SELECT rec, regr_slope(v, i) AS b, regr_intercept(v, i) AS a FROM usr GROUP BY rec)
        SELECT rec AS recording_id, i AS sample_idx, round(a + b * i, 4) AS trend, round(v - (a + b * i), 4) AS detrended FROM usr JOIN l USING (rec)""",
    "pipeline_min": PIPELINE_MIN,
    "crop_range": f"WITH {SIG} SELECT i - 100 AS sample_idx, v AS value FROM sig WHERE i >= 100 AND i < 601",
    "normalise_ranges": f"WITH {NORMAL} SELECT t0, t1 FROM nm",
    "keep_ranges": f"WITH {KEPT} SELECT t0, t1 FROM kp",
    "concat_ranges": f"WITH {CAT} SELECT j AS sample_idx, i AS orig_idx, v AS value FROM cat",
    "nan_gaps": f"WITH {CAT} SELECT j::DOUBLE AS position, v AS value FROM cat UNION ALL SELECT base + i1 - i0 - 0.5, NULL FROM tb WHERE rg < (SELECT max(rg) FROM tb)",
    "restore_mapped": f"""WITH {CAT}, {runs("(SELECT j AS i, v FROM cat)", "v > 60.0")}, {merged("r0", 1, "m")}, q AS (SELECT x.i AS s0, y.i + 1 AS e0, (e - s)::DOUBLE AS du FROM m JOIN cat x ON x.j = s JOIN cat y ON y.j = e - 1)
        SELECT s0 AS start_idx, e0 AS end_idx, s0::DOUBLE AS start_time, e0::DOUBLE AS end_time, du AS duration FROM q""",
    "lowpass_bessel": kernel_sql("bessel"),
    "lowpass_butter": kernel_sql("butterworth"),
    "minmax_downsample": f"""WITH {SIG}, n AS (SELECT max(i) + 1 AS n FROM sig), c AS (SELECT i, v, i * 100 // n AS b FROM sig CROSS JOIN n), e AS (SELECT i, v, row_number() OVER (PARTITION BY b ORDER BY v, i) AS lo, row_number() OVER (PARTITION BY b ORDER BY v DESC, i) AS hi FROM c)
        SELECT i AS sample_idx, v AS value FROM e WHERE lo = 1 OR hi = 1""",
    "residual_histogram": f"""WITH {SIG}, p AS (SELECT quantile_cont(v, 0.0005) AS a, quantile_cont(v, 0.9995) AS b FROM sig), e AS (SELECT a - 0.05 * (b - a) AS lo, b + 0.05 * (b - a) AS hi FROM p),
        c AS (SELECT least(floor((v - lo) / ((hi - lo) / 200)), 199)::BIGINT AS bin, count(*) AS n, any_value((hi - lo) / 200) AS w FROM sig CROSS JOIN e WHERE v >= lo AND v <= hi GROUP BY 1)
        SELECT bin, n, round(n / sum(n) OVER () / w, 8) AS density FROM c""",
    "dwell_log_histogram": """WITH w AS (SELECT epoch(o_orderdate) - lag(epoch(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS d FROM orders), l AS (SELECT log10(d) AS x FROM w WHERE d > 0), e AS (SELECT min(x) AS lo, max(x) AS hi FROM l)
        SELECT CASE WHEN hi > lo THEN least(floor((x - lo) / ((hi - lo) / 40)), 39) ELSE 0 END::BIGINT AS bin, count(*) AS n FROM l CROSS JOIN e GROUP BY 1""",
    "events_table": f"""WITH {SIG}, {detected('up', 100.0)}, {detected('down', 100.0)}, z AS (SELECT *, 'up' AS w FROM x_up UNION ALL SELECT *, 'down' FROM x_down)
        SELECT CAST(row_number() OVER (ORDER BY s, w) AS INTEGER) AS id, round(s / 100.0, 6) AS start_s, round((e - s) / 100.0 * 1e3, 4) AS duration_ms, round(abs(r)::DECIMAL(18, 9), 3)::DOUBLE AS depth, round((abs(r) / abs(bc))::DECIMAL(18, 9), 4)::DOUBLE AS rel_depth, 1 AS levels, w AS direction FROM z""",
    "stride_preview": f"WITH {SIG}, n AS (SELECT greatest(1, count(*) // 100) AS k FROM sig) SELECT i AS sample_idx, v AS value FROM sig CROSS JOIN n WHERE i % k = 0",
    "thin_samples": f"WITH {SIG} SELECT i AS sample_idx, v AS value FROM sig WHERE i % 7 = 0",
    "iou_pairs": f"WITH {TWO} SELECT truth_id, det_id, round(iou, 6) AS iou FROM pr",
    "any_overlap": f"WITH {TWO} SELECT DISTINCT truth_id FROM pr",
    "nearest_start_asof": f"""WITH {TWO}, c AS (SELECT a.s AS id, b.s AS t, row_number() OVER (PARTITION BY a.s ORDER BY abs(b.s - a.s), b.s) AS k FROM a LEFT JOIN b ON abs(b.s - a.s) <= 5)
        SELECT id, id::DOUBLE AS t, t::DOUBLE AS nearest FROM c WHERE k = 1""",
    "clean_runs": f"""WITH {TWO}, n AS (SELECT max(i) + 1 AS n FROM sig), x AS (SELECT s - 2 AS s, e + 2 AS e FROM a UNION ALL SELECT n, n FROM n), g AS (SELECT greatest(coalesce(max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS p, s AS q FROM x)
        SELECT p AS start_idx, q AS end_idx FROM g WHERE p < q""",
    "welch_psd": f"WITH {PSD} SELECT rec AS recording_id, k AS bin, round(f, 6) AS freq, round(p, 6) AS psd FROM psd",
    "cumulative_rms": f"WITH {PSD} SELECT rec AS recording_id, k AS bin, round(sqrt(sum(CASE WHEN k > 0 THEN p ELSE 0 END * 3.125) OVER (PARTITION BY rec ORDER BY k)), 6) AS rms FROM psd",
    "band_rms": f"WITH {PSD}, bd(lo, hi) AS (VALUES {', '.join(f'({a}, {b})' for a, b in BANDS)}) SELECT rec AS recording_id, lo::DOUBLE AS low, hi::DOUBLE AS high, round(median(p), 6) AS median_psd, round(sum(p), 6) AS power FROM psd JOIN bd ON f >= lo AND f < hi AND f > 0 GROUP BY rec, lo, hi HAVING count(*) >= 2",
    "f3db": f"""WITH {PSD}, b AS (SELECT rec, median(p) AS b FROM psd WHERE k >= 1 AND k < 2 GROUP BY rec), m AS (SELECT rec, min(f) AS f FROM psd JOIN b USING (rec) WHERE b > 0 AND k >= 2 AND p < b / 2 GROUP BY rec)
        SELECT r.rec AS recording_id, round(CASE WHEN f < 0.95 * 50 THEN f END, 6) AS f3db FROM (SELECT DISTINCT rec FROM psd) r LEFT JOIN m USING (rec)""",
    "psd_ratio": f"WITH {PSD}, c AS (SELECT k, median(p) AS c FROM psd GROUP BY k) SELECT rec AS recording_id, k AS bin, round(CASE WHEN c > 0 THEN p / c END, 5) AS ratio FROM psd JOIN c USING (k)",
    "spectral_peaks": f"WITH {PEAKS} SELECT rec AS recording_id, k AS bin, f AS freq, round(p / ref, 5) AS ratio, {MAINS_LABEL} AS label FROM pk WHERE p / ref >= 2.5",
    "spectral_top_peaks": f"""WITH RECURSIVE {PEAKS}, c AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY p / ref DESC, k) AS o FROM pk WHERE p / ref >= 1.2),
        t(rec, o, kept) AS (SELECT DISTINCT rec, 0::BIGINT, []::BIGINT[] FROM c UNION ALL
            SELECT t.rec, c.o, CASE WHEN len(kept) < 2 AND len(list_filter(kept, lambda x: abs(x - k) <= 2)) = 0 THEN list_append(kept, k) ELSE kept END FROM t JOIN c ON c.rec = t.rec AND c.o = t.o + 1),
        z AS (SELECT rec, arg_max(kept, o) AS kept FROM t GROUP BY rec)
        SELECT c.rec AS recording_id, list_position(kept, k) AS rank, k AS bin, f AS freq, round(p / ref, 5) AS ratio, {MAINS_LABEL} AS label FROM c JOIN z ON z.rec = c.rec WHERE list_contains(kept, k)""",
    "noise_spectrum": NOISE_SPECTRUM,
    "gaussian_crossing": CROSS,
    "baseline_component": """WITH g AS (SELECT user_id, event_type, avg(value) - 50 AS m, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS w FROM g),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(m), event_type) AS k FROM s WHERE w >= 0.05) SELECT user_id, event_type AS component FROM r WHERE k = 1""",
    "effective_threshold": "WITH g AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) SELECT event_type, round(least(-m, m - 5 * s), 6) AS down, round(greatest(abs(m), m + 5 * s), 6) AS up FROM g",
    "event_features": f"WITH {FEATURES} SELECT s AS start_idx, {', '.join(f'round(f_{n}, 6) AS f_{n}' for n in FEATURE_NAMES)} FROM fe",
    "zscore_features": f"WITH {FEATURES}, st AS (SELECT {', '.join(f'avg(f_{n}) AS m_{n}, CASE WHEN stddev_pop(f_{n}) = 0 THEN 1 ELSE stddev_pop(f_{n}) END AS s_{n}' for n in FEATURE_NAMES)} FROM fe) SELECT s AS start_idx, {', '.join(f'round((f_{n} - m_{n}) / s_{n}, 5) AS f_{n}' for n in FEATURE_NAMES)} FROM fe CROSS JOIN st",
    "capture_rate_mean": "SELECT event_type, count(*) AS n, round((0.5 + count(*)) / (max(event_id) - min(event_id) + 1)::DOUBLE, 6) AS mean_rate FROM events GROUP BY 1",
    "rle_labels": f"WITH {LABEL_RUNS} SELECT rec AS recording_id, l AS label, s AS start_idx, e AS end_idx FROM lr",
    "merge_same_label": f"""WITH {LABEL_RUNS}, b AS (SELECT *, CASE WHEN lag(l) OVER (PARTITION BY rec ORDER BY s) = l THEN 0 ELSE 1 END AS nw FROM lr WHERE e - s >= 2), g AS (SELECT *, sum(nw) OVER (PARTITION BY rec ORDER BY s) AS g FROM b)
        SELECT rec AS recording_id, any_value(l) AS label, min(s) AS start_idx, max(e) AS end_idx FROM g GROUP BY rec, g""",
    "dwell_times": f"WITH {LABEL_RUNS} SELECT rec AS recording_id, l AS label, count(*) AS n_runs, round(avg((e - s) / 100.0::DOUBLE), 6) AS mean_dwell, round(max((e - s) / 100.0::DOUBLE), 6) AS max_dwell FROM lr GROUP BY rec, l",
    "transition_matrix": f"""WITH {LABELS}, t AS (SELECT rec, lag(l) OVER (PARTITION BY rec ORDER BY i) AS f, l AS o FROM lb), c AS (SELECT rec, f, o, count(*) AS n FROM t WHERE f IS NOT NULL GROUP BY ALL),
        z AS (SELECT DISTINCT rec, l FROM lb EXCEPT SELECT DISTINCT rec, f FROM c)
        SELECT rec AS recording_id, f AS from_label, o AS to_label, n, round(n / sum(n) OVER (PARTITION BY rec, f), 6) AS p FROM c UNION ALL SELECT rec, l, l, 0, 1.0 FROM z""",
    "segment_stats": f"""WITH {SIG}, c AS (SELECT i AS s FROM sig WHERE i > 0 AND v > 200 UNION ALL SELECT 0), sp AS (SELECT s, coalesce(lead(s) OVER (ORDER BY s), (SELECT max(i) + 1 FROM sig)) AS e FROM c)
        SELECT s AS start_idx, e AS end_idx, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) AS n FROM sp JOIN sig ON i >= s AND i < e GROUP BY s, e""",
    "array_runs": """WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings), r AS (SELECT vec_id, count(*) AS n FROM (SELECT vec_id, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM x WHERE v > 0) GROUP BY vec_id, g)
        SELECT e.vec_id, coalesce(max(n), 0)::BIGINT AS longest FROM embeddings e LEFT JOIN r USING (vec_id) GROUP BY e.vec_id""",
    "array_changepoint_1": """WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS v, len(embedding) AS n FROM embeddings), c AS (SELECT vec_id, k, n, sum(v) OVER (PARTITION BY vec_id ORDER BY k) AS s, sum(v) OVER (PARTITION BY vec_id) AS t FROM x),
        g AS (SELECT vec_id, k, round(pow(s / k - (t - s) / (n - k), 2) * k * (n - k) / n, 9) AS g FROM c WHERE k < n), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY g DESC, k) AS o FROM g)
        SELECT vec_id, k::BIGINT AS split, round(g, 6) AS gain FROM r WHERE o = 1""",
    "array_dft_power": """WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v, len(embedding) AS n FROM embeddings),
        f AS (SELECT vec_id, k, sum(v * cos(2 * 3.141592653589793 * k * i / n)) AS c, sum(v * sin(2 * 3.141592653589793 * k * i / n)) AS s FROM x CROSS JOIN (SELECT unnest(range(0, 8)) AS k) GROUP BY ALL) SELECT vec_id, k, round(c * c + s * s, 6) AS power FROM f""",
    "seed_mean_std": "SELECT l_returnflag, l_linestatus, l_linenumber, round(avg(l_discount), 6) AS mean, round(stddev_samp(l_discount), 6) AS std, count(*) AS n FROM lineitem GROUP BY ALL",
    "sensitivity": "WITH s AS (SELECT l_suppkey, avg(l_tax) AS x, count(*) AS n FROM lineitem GROUP BY 1) SELECT n % 5 AS grid, round(min(x), 6) AS worst, round(median(x), 6) AS middle, round(max(x), 6) AS best FROM s GROUP BY 1",
}
