"""DuckDB SQL for the registered queries, put together from common table expressions."""

FIELD = """field AS (
  SELECT CAST(event_id // 1000 AS INTEGER) AS t, event_id % 1000 AS gid, value::DOUBLE AS value FROM events
)"""


def block(x: int, y: int, z: int) -> str:
    """The region of cell gid for regions of x by y by z cells."""
    return f"CAST((gid % 10) // {x} + ((gid // 10) % 10) // {y} * {10 // x} + (gid // 100) // {z} * {10 // x * (10 // y)} AS INTEGER)"


def local(x: int, y: int, z: int) -> str:
    return f"CAST((gid % 10) % {x} + ((gid // 10) % 10) % {y} * {x} + (gid // 100) % {z} * {x * y} AS INTEGER)"


def bins(low: str, high: str, n: int | str) -> str:
    """The bin of value."""
    return f"CASE WHEN ({high}) = ({low}) THEN 0 ELSE CAST(trunc(least(greatest((value - ({low})) / ((({high}) - ({low})) / {n}), 0), {n} - 1)) AS INTEGER) END"


def uniform(stage: str) -> str:
    return f"(CAST('0x' || substr(md5('{stage}:' || t || ':' || gid || ':42'), 1, 8) AS BIGINT) / 4294967296.0)"


GRID_BLOCK, FINE_BLOCK = block(5, 5, 5), block(5, 2, 1)


def histogram_of(field: str, n: int, name: str = "") -> str:
    return f"""span{name} AS (SELECT t, min(value) AS lo, max(value) AS hi, count(*) AS n FROM {field} GROUP BY t
), binned{name} AS (SELECT t, gid, value, {bins('lo', 'hi', n)} AS bin FROM {field} JOIN span{name} USING (t)
), hist{name} AS (
  SELECT t, bin, coalesce(c, 0)::BIGINT AS n
  FROM (SELECT DISTINCT t FROM {field}) CROSS JOIN (SELECT unnest(range(0, {n}))::INTEGER AS bin)
  LEFT JOIN (SELECT t, bin, count(*) AS c FROM binned{name} GROUP BY t, bin) USING (t, bin)
)"""


def acceptance_of(ratio: float, name: str = "") -> str:
    return f"""ranked{name} AS (
  SELECT t, bin, n, row_number() OVER (PARTITION BY t ORDER BY n, bin) - 1 AS i, count(*) OVER (PARTITION BY t) AS nb,
         trunc(sum(n) OVER (PARTITION BY t) * {ratio}::DOUBLE)::BIGINT AS budget
  FROM hist{name}
), fold{name} AS (
  SELECT t, bin, n, i, nb, least(n, budget // nb)::BIGINT AS k, (budget - least(n, budget // nb))::BIGINT AS remaining,
         ((budget - least(n, budget // nb)) // nb)::BIGINT AS target
  FROM ranked{name} WHERE i = 0
  UNION ALL
  SELECT r.t, r.bin, r.n, r.i, r.nb, least(r.n, f.target)::BIGINT, (f.remaining - least(r.n, f.target))::BIGINT,
         ((f.remaining - least(r.n, f.target)) // (r.nb - r.i))::BIGINT
  FROM fold{name} f JOIN ranked{name} r ON r.t = f.t AND r.i = f.i + 1
), odds{name} AS (SELECT t, bin, n, k, CASE WHEN n = 0 THEN 0.0 ELSE k / n::DOUBLE END AS p FROM fold{name}
)"""


def sample_of(region: str, name: str = "") -> str:
    return f"""judged{name} AS (
  SELECT t, gid, {region} AS block_id, value, p, {uniform('importance')} < p AS taken FROM binned{name} JOIN odds{name} USING (t, bin)
), sample{name} AS (SELECT t, gid, block_id, value FROM judged{name} WHERE taken
)"""


def start(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join((FIELD, *parts)) + "\n"


SAMPLED = (histogram_of("field", 20), acceptance_of(0.1), sample_of(GRID_BLOCK))
FINE_SAMPLED = (histogram_of("field", 3), acceptance_of(0.3), sample_of(FINE_BLOCK))
FINE_HIST = f"""cell_bin AS (SELECT t, {FINE_BLOCK} AS block_id, {bins('0.0', '200.0', 3)} AS bin FROM field
), shape AS (
  SELECT t, block_id, [count(*) FILTER (bin = 0), count(*) FILTER (bin = 1), count(*) FILTER (bin = 2)] AS hist FROM cell_bin GROUP BY t, block_id
), may AS (
  SELECT t, block_id, coalesce(hist = lag(hist) OVER w AND lag(t) OVER w = t - 1, false) AS eq FROM shape WINDOW w AS (PARTITION BY block_id ORDER BY t)
)"""
PARITY = """run AS (
  SELECT t, block_id, sum(CASE WHEN eq THEN 0 ELSE 1 END) OVER (PARTITION BY block_id ORDER BY t) AS run FROM may
), flags AS (SELECT t, block_id, (row_number() OVER (PARTITION BY block_id, run ORDER BY t) - 1) % 2 = 1 AS reused FROM run
)"""
ERRORS = """previous AS (
  SELECT t, block_id, value, CASE WHEN lag(t) OVER w = t - 1 AND lag(taken) OVER w THEN lag(value) OVER w END AS before
  FROM judged WINDOW w AS (PARTITION BY gid ORDER BY t)
), error AS (
  SELECT t, block_id, count(before) AS n_reference, sqrt(avg((value - before) * (value - before))) AS rmse FROM previous GROUP BY t, block_id
)"""
ERROR_MAY = """may AS (
  SELECT t, block_id, coalesce(rmse <= 60.0 AND lag(t) OVER w = t - 1, false) AS eq FROM error WINDOW w AS (PARTITION BY block_id ORDER BY t)
)"""


def d2(a: str, b: str, x: int = 10, y: int = 10) -> str:
    return f"(({a}.gid % {x} - {b}.gid % {x}) ** 2 + (({a}.gid // {x}) % {y} - ({b}.gid // {x}) % {y}) ** 2 + ({a}.gid // {x * y} - {b}.gid // {x * y}) ** 2)::BIGINT"


def rebuilt_of(samples: str = "sample", name: str = "rebuilt", x: int = 10, y: int = 10) -> str:
    return f"""{name} AS (
  SELECT f.t, f.gid, any_value(f.value) AS value, arg_min(s.value, ({d2('f', 's', x, y)}) * 100000 + s.gid) AS rebuilt
  FROM field f JOIN {samples} s ON s.t = f.t GROUP BY f.t, f.gid
)"""


QUALITY = """
SELECT t, n, round(max_diff, 6) AS max_diff, round(sum_abs / n, 6) AS avg_diff, round(rmse, 6) AS rmse,
       round(CASE WHEN rmse = 0 THEN 10000.0 WHEN rmse IS NULL OR NOT isfinite(rmse) OR hi <= lo THEN -10000.0 ELSE 20 * log10((hi - lo) / rmse) END, 6) AS psnr,
       round(CASE WHEN sd_noise = 0 OR sd <= 0 THEN NULL ELSE 20 * log10(sd / sd_noise) END, 6) AS snr
FROM (
  SELECT t, count(*) AS n, max(abs(value - rebuilt)) AS max_diff, sum(abs(value - rebuilt)) AS sum_abs,
         sqrt(sum((value - rebuilt) ** 2) / nullif(count(*) - 1, 0)) AS rmse, max(value) AS hi, min(value) AS lo,
         stddev_pop(value) AS sd, stddev_pop(abs(value - rebuilt)) AS sd_noise
  FROM {pairs} GROUP BY t
)
"""
HISTOGRAM_SAMPLES = (*FINE_SAMPLED, FINE_HIST, PARITY, "own AS (SELECT t, gid, block_id, value FROM sample JOIN flags USING (t, block_id) WHERE NOT reused)")
FILL = f"""rate AS (
  SELECT t, had, CASE WHEN n_reused > 0 AND had < 300 THEN (300 - had) / n_open::DOUBLE / 10 ELSE 0.0 END AS rate
  FROM (SELECT t, count(*) FILTER (NOT reused) AS n_open, count(*) FILTER (reused) AS n_reused FROM flags GROUP BY t)
  JOIN (SELECT t, count(*) FILTER (taken) AS had FROM judged JOIN flags USING (t, block_id) WHERE NOT reused GROUP BY t) USING (t)
), drawn AS (
  SELECT t, gid, block_id, value, had FROM judged JOIN flags USING (t, block_id) JOIN rate USING (t) WHERE NOT reused AND NOT taken AND {uniform('fill')} < rate
), total AS (
  SELECT t, block_id, had + sum(n) OVER (PARTITION BY t ORDER BY block_id) AS s FROM (SELECT t, block_id, count(*) AS n, min(had) AS had FROM drawn GROUP BY t, block_id)
), stop AS (SELECT t, min(block_id) AS stop FROM total WHERE s >= 300 GROUP BY t)"""
FILLED = "SELECT t, gid, block_id, value FROM drawn LEFT JOIN stop USING (t) WHERE stop IS NULL OR block_id < stop"
EFFECTIVE = """effective AS (
  SELECT * FROM own UNION ALL
  SELECT o.t + 1 AS t, o.gid, o.block_id, o.value FROM own o JOIN flags f ON f.t = o.t + 1 AND f.block_id = o.block_id AND f.reused
)"""
COUNTS = """counts AS (
  SELECT t, count(*) FILTER (reused) AS blocks_reused, coalesce(sum(c), 0)::BIGINT AS n_samples
  FROM flags LEFT JOIN (SELECT t, block_id, count(*) AS c FROM own GROUP BY t, block_id) USING (t, block_id) GROUP BY t
)"""
WIDTHS = """moment AS (
  SELECT t, count(*) AS n, stddev_pop(value) AS sd, max(value) - min(value) AS span FROM field GROUP BY t
), width AS (
  SELECT t, n, sd, span, pow(24 * sqrt(pi()) / n, 1 / 3.0::DOUBLE) * sd AS scott, span / (1 + log2(n) + log2(1)) AS doane, span / log2(n + 1) AS sturges FROM moment
)"""


HEAD = "head AS (SELECT * FROM field WHERE t = 0), choice AS (SELECT (ceil(span / scott) + 1)::INTEGER AS s, (ceil(span / doane) + 1)::INTEGER AS d FROM width WHERE t = 0)"
INSIDE = "inside AS (SELECT * FROM rebuilt WHERE gid % 10 >= t % 3 AND gid % 10 < 10 - t % 4 AND (gid // 10) % 10 >= t % 2 AND (gid // 10) % 10 < 9 AND gid // 100 >= 1 AND gid // 100 < 4 + t % 6)"


def method_of(name: str, flags: str, own: str) -> tuple[str, ...]:
    """Own and effective samples, counts and quality of a method, given the table of its reuse flags and the query of its samples."""
    return (
        f"own_{name} AS ({own})",
        EFFECTIVE.replace("effective", f"effective_{name}").replace("own", f"own_{name}").replace("flags", flags),
        COUNTS.replace("counts", f"counts_{name}").replace("FROM own", f"FROM own_{name}").replace("flags", flags),
        rebuilt_of(f"effective_{name}", f"rebuilt_{name}"),
        f"quality_{name} AS (" + QUALITY.format(pairs=f"rebuilt_{name}") + ")",
    )


WITH_FILL = f"SELECT t, gid, block_id, value FROM sample JOIN flags USING (t, block_id) WHERE NOT reused UNION ALL {FILLED}"


def tried(bins_from: str, place: int, x: int = 10, y: int = 10) -> str:
    """Sampling and rebuilding the first timestep with a number of bins that is itself a result."""
    n = f"(SELECT {bins_from} FROM choice)"
    name = f"_{place}"
    hist = f"""span{name} AS (SELECT t, min(value) AS lo, max(value) AS hi FROM head GROUP BY t
), binned{name} AS (SELECT t, gid, value, {bins('lo', 'hi', n)} AS bin FROM head JOIN span{name} USING (t)
), hist{name} AS (
  SELECT t, bin, coalesce(c, 0)::BIGINT AS n FROM (SELECT DISTINCT t FROM head) CROSS JOIN (SELECT unnest(range(0, {n}))::INTEGER AS bin)
  LEFT JOIN (SELECT t, bin, count(*) AS c FROM binned{name} GROUP BY t, bin) USING (t, bin)
)"""
    return ", ".join((hist, acceptance_of(0.1, name), sample_of(GRID_BLOCK, name), rebuilt_of(f"sample{name}", f"rebuilt{name}", x, y).replace("field f", "head f"), f"score{name} AS (SELECT {n} AS num_bins, psnr, {-place} AS place FROM (" + QUALITY.format(pairs=f"rebuilt{name}") + "))"))


#: Rows of a timestep's samples, and with gid null its regions with their flags; the next timestep is judged against them.
ERROR_FILLED = f"""cell AS MATERIALIZED (SELECT t, gid, block_id, value, taken, {uniform('fill')} AS u FROM judged
), state AS (
  SELECT t, gid, block_id, value, 'importance' AS kind, false AS reused FROM cell WHERE t = 0 AND taken
  UNION ALL SELECT DISTINCT 0, NULL::BIGINT, block_id, NULL::DOUBLE, NULL, false FROM cell WHERE t = 0
  UNION ALL (
    WITH last AS (SELECT * FROM state
    ), now AS (SELECT * FROM cell WHERE t = (SELECT max(t) + 1 FROM last)
    ), gap AS (SELECT now.block_id, sqrt(avg((now.value - last.value) * (now.value - last.value))) AS rmse FROM now JOIN last ON last.gid = now.gid GROUP BY now.block_id
    ), flag AS (
      SELECT r.block_id, coalesce(rmse <= 60.0, false) AND NOT coalesce(w.reused, false) AS reused
      FROM (SELECT DISTINCT block_id FROM now) r LEFT JOIN gap USING (block_id) LEFT JOIN (SELECT block_id, reused FROM last WHERE gid IS NULL) w USING (block_id)
    ), open AS (SELECT now.* FROM now JOIN flag USING (block_id) WHERE NOT reused
    ), rate AS (
      SELECT had, CASE WHEN n_reused > 0 AND had < 300 THEN (300 - had) / n_open::DOUBLE / 10 ELSE 0.0 END AS rate
      FROM (SELECT count(*) FILTER (NOT reused) AS n_open, count(*) FILTER (reused) AS n_reused FROM flag), (SELECT count(*) FILTER (taken) AS had FROM open)
    ), drawn AS (SELECT t, gid, block_id, value, had FROM open, rate WHERE NOT taken AND u < rate
    ), total AS (
      SELECT block_id, had + sum(n) OVER (ORDER BY block_id) AS s FROM (SELECT block_id, count(*) AS n, min(had) AS had FROM drawn GROUP BY block_id)
    ), stop AS (SELECT min(block_id) AS stop FROM total WHERE s >= 300)
    SELECT t, gid, block_id, value, 'importance', false FROM open WHERE taken
    UNION ALL SELECT t, gid, block_id, value, 'fill', false FROM drawn, stop WHERE stop IS NULL OR block_id < stop
    UNION ALL SELECT (SELECT max(t) FROM now), NULL, block_id, NULL, NULL, reused FROM flag
  )
)"""
METHODS = ("importance", "histogram_reuse_filled", "error_reuse_filled")
METHOD_PARTS = (
    ("never AS (SELECT t, block_id, false AS reused FROM flags)", *method_of(METHODS[0], "never", "SELECT * FROM sample")),
    (FILL, *method_of(METHODS[1], "flags", WITH_FILL)),
    (ERROR_FILLED, "flags_e AS (SELECT t, block_id, reused FROM state WHERE gid IS NULL)", *method_of(METHODS[2], "flags_e", "SELECT t, gid, block_id, value FROM state WHERE gid IS NOT NULL")),
)
FLAG_COUNTS = "SELECT t, block_id, coalesce(c, 0)::BIGINT AS n_samples, reused FROM flags LEFT JOIN (SELECT t, block_id, count(*) AS c FROM own GROUP BY ALL) USING (t, block_id)"


def candidates_of(table: str, gid: str, x: int, y: int) -> str:
    return f"""extent AS (SELECT max({gid} % {x})::INTEGER + 1 AS xd, max({gid} // {x} % {y})::INTEGER + 1 AS yd, max({gid} // {x * y})::INTEGER + 1 AS zd FROM {table}
), size AS (
  SELECT bx, by_, bz, (xd::BIGINT * yd * zd) // (bx::BIGINT * by_ * bz) AS regions
  FROM extent, unnest(range(3, xd)) AS a(bx), unnest(range(3, yd)) AS b(by_), unnest(range(3, zd)) AS c(bz) WHERE xd % bx = 0 AND yd % by_ = 0 AND zd % bz = 0
), firsts AS (SELECT regions, bx, by_, bz, row_number() OVER (PARTITION BY regions ORDER BY bx, by_, bz) AS r FROM size
), candidate AS (SELECT (row_number() OVER (ORDER BY bx, by_, bz) - 1)::INTEGER AS place, bx::INTEGER AS bx, by_::INTEGER AS "by", bz::INTEGER AS bz, regions FROM firsts WHERE r = 1
)"""


GAPS = "pair AS (SELECT abs(b.value - a.value) AS gap FROM field a JOIN field b USING (gid) WHERE a.t = 0 AND b.t = 1), ordered AS (SELECT gap, row_number() OVER (ORDER BY gap) - 1 AS r, count(*) OVER () AS n FROM pair), bound AS (SELECT max(gap) AS value FROM ordered WHERE r = trunc(n * 0.75)::BIGINT)"
BEST = "best AS (SELECT num_bins, psnr FROM (SELECT * FROM score_0 UNION ALL SELECT * FROM score_1) ORDER BY psnr DESC, place DESC LIMIT 1)"
GROWING = FIELD.replace("event_id // 1000", "event_id % 10").replace("event_id % 1000 AS gid", "event_id // 10 AS gid")
COMPLETE = "t IN (SELECT t FROM field GROUP BY t HAVING count(*) = 1000)"
FIGURES = ("blocks_reused", "n_samples", "max_diff", "avg_diff", "psnr", "snr")


ORACLES = {
    "cell_geometry": start() + f"SELECT t, gid, CAST(gid % 10 AS INTEGER) AS x, CAST((gid // 10) % 10 AS INTEGER) AS y, CAST(gid // 100 AS INTEGER) AS z, {GRID_BLOCK} AS block_id, {local(5, 5, 5)} AS local_id, gid AS back FROM field",
    "block_extract": start() + f"SELECT t, gid, {local(5, 5, 5)} AS local_id, value FROM field WHERE {GRID_BLOCK} = 3",
    "timestep_range": start() + "SELECT t, min(value) AS lo, max(value) AS hi, count(*) AS n FROM field GROUP BY t",
    "orders_range": "SELECT CAST(o_orderkey // 1000 AS INTEGER) AS t, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders GROUP BY 1",
    "histogram": start(histogram_of("field", 20)) + "SELECT * FROM hist",
    "embeddings_histogram": "WITH plane AS (SELECT 0::INTEGER AS t, 0::BIGINT AS gid, unnest(embedding)::DOUBLE AS value FROM embeddings), " + histogram_of("plane", 20) + " SELECT * FROM hist",
    "block_histogram": start(f"cell_bin AS (SELECT t, {GRID_BLOCK} AS block_id, {bins('0.0', '200.0', 20)} AS bin FROM field)")
    + "SELECT t, block_id, bin, coalesce(c, 0)::BIGINT AS n FROM (SELECT DISTINCT t, block_id FROM cell_bin) CROSS JOIN (SELECT unnest(range(0, 20))::INTEGER AS bin) LEFT JOIN (SELECT t, block_id, bin, count(*) AS c FROM cell_bin GROUP BY ALL) USING (t, block_id, bin)",
    "bin_order": start(histogram_of("field", 20)) + "SELECT t, (row_number() OVER (PARTITION BY t ORDER BY n, bin) - 1)::INTEGER AS place, bin, n FROM hist",
    "acceptance": start(*SAMPLED[:2]) + "SELECT t, bin, n, k, round(p, 6) AS p FROM odds",
    "importance_sample": start(*SAMPLED) + "SELECT t, gid, block_id, value, 'importance' AS kind FROM sample",
    "sample_counts_per_block": start(*SAMPLED)
    + "SELECT t, block_id, coalesce(c, 0)::BIGINT AS n_samples FROM (SELECT DISTINCT t FROM field) CROSS JOIN (SELECT unnest(range(0, 8))::INTEGER AS block_id) LEFT JOIN (SELECT t, block_id, count(*) AS c FROM sample GROUP BY ALL) USING (t, block_id)",
    "block_rmse": start(*FINE_SAMPLED, ERRORS) + "SELECT t, block_id, n_reference, round(rmse, 6) AS rmse FROM error",
    "reuse_histogram": start(FINE_HIST, PARITY) + "SELECT t, block_id, reused FROM flags",
    "stream_reuse_histogram": start(FINE_HIST, PARITY) + "SELECT t, block_id, reused FROM flags",
    "stream_reuse_error": start(*FINE_SAMPLED, ERRORS, ERROR_MAY, PARITY) + "SELECT t, block_id, n_reference, round(rmse, 6) AS rmse, reused FROM flags JOIN error USING (t, block_id)",
    "stream_error_fill": start(*FINE_SAMPLED, ERROR_FILLED) + "SELECT t, gid, block_id, value, kind FROM state WHERE gid IS NOT NULL",
    "reuse_error": start(*FINE_SAMPLED, ERRORS, ERROR_MAY, PARITY) + "SELECT t, block_id, reused FROM flags",
    "temporal_error_samples": start(*FINE_SAMPLED, ERRORS, ERROR_MAY, PARITY) + "SELECT t, gid, block_id, value FROM sample JOIN flags USING (t, block_id) WHERE NOT reused",
    "fill_samples": start(*HISTOGRAM_SAMPLES, FILL) + f"SELECT t, gid, block_id, value, 'importance' AS kind FROM own UNION ALL SELECT t, gid, block_id, value, 'fill' FROM ({FILLED})",
    "coalesced_samples": start(*HISTOGRAM_SAMPLES, EFFECTIVE) + "SELECT t, gid, block_id, value FROM effective",
    "blocks_reused_stats": start(*HISTOGRAM_SAMPLES, COUNTS) + "SELECT * FROM counts",
    "nn_reconstruct": start(*SAMPLED, rebuilt_of()) + "SELECT t, gid, rebuilt FROM rebuilt",
    "knn3_reconstruct": start(*SAMPLED)
    + f"""SELECT t, gid, round((v1 * w1 + coalesce(v2 * w2, 0) + coalesce(v3 * w3, 0)) / (w1 + coalesce(w2, 0) + coalesce(w3, 0)), 6) AS rebuilt FROM (
  SELECT t, gid, max(v) FILTER (r = 1) AS v1, max(v) FILTER (r = 2) AS v2, max(v) FILTER (r = 3) AS v3, max(w) FILTER (r = 1) AS w1, max(w) FILTER (r = 2) AS w2, max(w) FILTER (r = 3) AS w3
  FROM (SELECT f.t, f.gid, s.value AS v, 1.0::DOUBLE / ({d2('f', 's')} + 1.0::DOUBLE) AS w, row_number() OVER (PARTITION BY f.t, f.gid ORDER BY {d2('f', 's')}, s.gid) AS r FROM field f JOIN sample s ON s.t = f.t)
  GROUP BY t, gid)""",
    "quality_metrics": start(*SAMPLED, rebuilt_of()) + QUALITY.format(pairs="rebuilt"),
    "quality_two_variables": start("pair AS (SELECT t, gid, value, o_totalprice AS rebuilt FROM field JOIN orders ON t = o_orderkey // 1000 AND gid = o_orderkey % 1000)") + QUALITY.format(pairs="pair"),
    "quality_roi": start(*SAMPLED, rebuilt_of(), INSIDE) + QUALITY.format(pairs="inside"),
    "linear_planes": start() + f"SELECT t, gid, round(3.0::DOUBLE * (gid % 10) - 2.0::DOUBLE * (gid // 10 % 10) + 0.5::DOUBLE * (gid // 100) + t, 6) AS rebuilt FROM field WHERE {COMPLETE}",
    "box_statistics": start("box AS (SELECT t, k AS box, (t + k) % 7 - 1 AS x0, (t + k) % 7 + k % 4 AS x1, k % 5 AS y0, k % 5 + 1 + t % 9 AS y1, t % 3 AS z0, t % 3 + k AS z1 FROM (SELECT DISTINCT t FROM field), (SELECT unnest(range(0, 12))::INTEGER AS k))")
    + "SELECT t, box, count(*) AS n, round(sum(value), 6) AS total FROM field JOIN box USING (t) WHERE gid % 10 >= x0 AND gid % 10 < x1 AND gid // 10 % 10 >= y0 AND gid // 10 % 10 < y1 AND gid // 100 >= z0 AND gid // 100 < z1 GROUP BY t, box",
    "sketch_quantiles": start() + " UNION ALL ".join(f"SELECT {w}::INTEGER AS width, {'0' if not w else f't // {w} * {w}'}::INTEGER AS first, share, count(*) AS n, true AS within FROM field, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.99])::DOUBLE AS share) GROUP BY ALL" for w in (1, 5, 0)),
    "range_statistics": start(*SAMPLED, rebuilt_of()) + "SELECT t, " + ", ".join(f"round({f}({c}), 6) AS {name}_{n}" for name, c in (("raw", "value"), ("sampled", "rebuilt")) for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("sd", "stddev_pop"))) + " FROM rebuilt GROUP BY t",
    "error_threshold": start(GAPS) + "SELECT value FROM bound",
    "bin_widths": start(WIDTHS) + "SELECT t, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("sd", "span", "scott", "doane", "sturges")) + ", " + ", ".join(f"(ceil(span / {c}) + 1)::INTEGER AS {c}_bins" for c in ("scott", "doane", "sturges")) + " FROM width",
    "config_bins": start(WIDTHS, HEAD, tried("s", 0), tried("d", 1), BEST) + "SELECT * FROM best",
    "bin_widths_textbook": start(WIDTHS, "skewed AS (SELECT f.t, avg(((value - m) / s) ** 3) AS skew FROM field f JOIN (SELECT t, avg(value) AS m, stddev_pop(value) AS s FROM field GROUP BY t) USING (t) GROUP BY f.t), full_width AS (SELECT t, n, span, span / (1 + log2(n) + log2(1 + abs(skew) / sqrt(6.0::DOUBLE * (n - 2) / ((n + 1.0::DOUBLE) * (n + 3))))) AS doane FROM moment JOIN skewed USING (t))")
    + "SELECT t, n, round(doane, 6) AS doane, (ceil(span / doane) + 1)::INTEGER AS doane_bins FROM full_width",
    "freedman_bins": start("ranked AS (SELECT t, value, row_number() OVER (PARTITION BY t ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY t) AS n FROM field), quartile AS (SELECT t, any_value(n) AS n, max(value) - min(value) AS span, max(value) FILTER (r = 3 * n // 4) - max(value) FILTER (r = n // 4) AS iqr FROM ranked GROUP BY t), wide AS (SELECT *, 2 * iqr / pow(n, 1 / 3.0::DOUBLE) AS width FROM quartile)")
    + "SELECT t, n, round(iqr, 6) AS iqr, round(width, 6) AS width, (ceil(span / width) + 1)::INTEGER AS bins FROM wide",
    "auto_configuration": start(candidates_of("field", "gid", 12, 12), GAPS, WIDTHS, HEAD, tried("s", 0, 12, 12), tried("d", 1, 12, 12), BEST).replace(FIELD, FIELD.replace("1000", "864"))
    + 'SELECT bx, "by", bz, num_bins, round(value, 6) AS error_threshold FROM candidate, best, bound WHERE place = 3',
    "bins_sweep": start(WIDTHS, HEAD, tried("s", 0), tried("d", 1)) + "SELECT num_bins, psnr, (-place)::INTEGER AS place FROM (SELECT * FROM score_0 UNION ALL SELECT * FROM score_1)",
    "snr_report": start(*SAMPLED, rebuilt_of(), INSIDE, "a AS (" + QUALITY.format(pairs="rebuilt") + "), b AS (" + QUALITY.format(pairs="inside") + ")") + "SELECT t, 'Pf' || t || '.bin' AS filename, a.snr, b.snr AS snr_roi FROM a LEFT JOIN b USING (t)",
    "method_figures": start(*FINE_SAMPLED, FINE_HIST, PARITY, *[part for m in METHOD_PARTS for part in m]) + " UNION ALL ".join(f"SELECT t, '{m}' AS method, blocks_reused, n_samples, max_diff, avg_diff, psnr FROM quality_{m} JOIN counts_{m} USING (t)" for m in METHODS),
    "growing_threshold": (start(GAPS) + "SELECT value FROM bound").replace(FIELD, GROWING),
    "growing_bins": (start(WIDTHS, HEAD, tried("s", 0), tried("d", 1)) + "SELECT num_bins, psnr, (-place)::INTEGER AS place FROM (SELECT * FROM score_0 UNION ALL SELECT * FROM score_1)").replace(FIELD, GROWING),
    "candidate_regions": f"WITH {candidates_of('orders', 'o_orderkey', 10, 20)} SELECT * FROM candidate",
    "boundary_corners": start(*SAMPLED) + "SELECT t, gid, min(value) AS value FROM (SELECT t, gid, value FROM sample UNION ALL SELECT t, gid, value FROM field WHERE gid % 10 IN (0, 9) AND (gid // 10) % 10 IN (0, 9) AND gid // 100 IN (0, 9)) GROUP BY t, gid",
    "filename_timesteps": start() + """SELECT path, timestep, (dense_rank() OVER (ORDER BY timestep) - 1)::INTEGER AS "index" FROM (
  SELECT path, try_cast(regexp_extract(path, 'Pf([0-9]+).bin', 1) AS INTEGER) AS timestep
  FROM (SELECT DISTINCT CASE WHEN t % 5 = 3 THEN '/run/notes_' || t ELSE '/run/Pf' || t || '.bin' END AS path FROM field)
) WHERE timestep IS NOT NULL""",
    "sample_union_dedup": start(*SAMPLED, "hist_b AS (SELECT * FROM hist), binned_b AS (SELECT * FROM binned)", acceptance_of(0.2, "_b"), sample_of(GRID_BLOCK, "_b")) + "SELECT t, gid, min(value) AS value, count(*) AS times FROM (SELECT t, gid, value FROM sample UNION ALL SELECT t, gid, value FROM sample_b) GROUP BY t, gid",
    "raw_files": start() + f"SELECT t, gid, value::FLOAT::DOUBLE AS value FROM field WHERE {COMPLETE}",
    "image_files": start() + f"SELECT t, gid, value FROM field WHERE {COMPLETE}",
    "images_to_raw": start() + f"SELECT t, gid, value::FLOAT::DOUBLE AS value, 10::INTEGER AS x_dim, 10::INTEGER AS y_dim, 10::INTEGER AS z_dim, 2.0::DOUBLE AS y_spacing, 'values' AS \"array\" FROM field WHERE {COMPLETE}",
    "rebuilt_images": start(*SAMPLED, rebuilt_of()) + f"SELECT t, gid, rebuilt FROM rebuilt WHERE {COMPLETE}",
    "sample_cloud": start(*HISTOGRAM_SAMPLES, EFFECTIVE, f"""cloud AS (
  SELECT t, 0 AS part, block_id AS k, gid, value FROM effective
  UNION ALL SELECT t, 1, gid % 10 // 9 * 4 + gid // 10 % 10 // 9 * 2 + gid // 100 // 9, gid, value FROM field WHERE gid % 10 IN (0, 9) AND gid // 10 % 10 IN (0, 9) AND gid // 100 IN (0, 9)
)""") + "SELECT t, row_number() OVER (PARTITION BY t ORDER BY part, k, gid) - 1 AS place, (gid % 10)::DOUBLE AS x, (gid // 10 % 10)::DOUBLE AS y, (gid // 100)::DOUBLE AS z, value::FLOAT::DOUBLE AS value FROM cloud",
    "sample_files": start(*HISTOGRAM_SAMPLES) + f"SELECT t, gid, block_id, {local(5, 2, 1)} AS local_id, value::FLOAT::DOUBLE AS value FROM own",
    "sample_file_blocks": start(*HISTOGRAM_SAMPLES) + FLAG_COUNTS,
    "roi_file": start() + "SELECT (row_number() OVER (ORDER BY t) - 1)::INTEGER AS t, (t % 3)::INTEGER AS x0, (10 - t % 4)::INTEGER AS x1, (t % 2)::INTEGER AS y0, 9::INTEGER AS y1, 1::INTEGER AS z0, (4 + t % 6)::INTEGER AS z1 FROM (SELECT DISTINCT t FROM field)",
    "error_fill_samples": start(*FINE_SAMPLED, ERROR_FILLED) + "SELECT t, gid, block_id, value, kind FROM state WHERE gid IS NOT NULL",
    "cell_positions": start() + "SELECT t, gid, (gid % 10) * 0.5::DOUBLE AS px, (gid // 10 % 10) * 2.0::DOUBLE AS py, (gid // 100) * 1.25::DOUBLE AS pz, gid AS back FROM field",
    "preset_timesteps": start("times AS (SELECT DISTINCT t FROM field)") + """SELECT preset, '/run/' || head || t || tail AS path, t AS timestep FROM times, (VALUES
  ('exaam', 'plt_temperature_', '.bin'), ('isabel_subsampled', 'Pf', '.binLE.raw_corrected_2_subsampled.vti.bin'), ('isabel', 'Pf', '.bin'), ('asteroid', 'pv_insitu_300x300x300_', '.bin')) AS p(preset, head, tail)""",
    "fixed_range_histogram": start(f"cell_bin AS (SELECT t, {bins('3.0', '50.0', 12)} AS bin FROM field)")
    + "SELECT t, bin, coalesce(c, 0)::BIGINT AS n FROM (SELECT DISTINCT t FROM cell_bin) CROSS JOIN (SELECT unnest(range(0, 12))::INTEGER AS bin) LEFT JOIN (SELECT t, bin, count(*) AS c FROM cell_bin GROUP BY ALL) USING (t, bin)",
    "stats_report": start(*FINE_SAMPLED, FINE_HIST, PARITY, FILL, f"own AS ({WITH_FILL})", EFFECTIVE, COUNTS, rebuilt_of("effective"), "quality AS (" + QUALITY.format(pairs="rebuilt").replace("round(", "(").replace(", 6)", ")") + "), report AS (SELECT t, " + ", ".join(FIGURES) + " FROM quality JOIN counts USING (t))")
    + "SELECT t, 'histogram_reuse_filled' AS method, 4e-6::DOUBLE AS file_gb, 0.3::DOUBLE AS ratio, '5/2/1' AS region_dims, 3::INTEGER AS num_bins, 'nearest' AS reconstruction, " + ", ".join(f"round({c}, 6) AS {c}" for c in FIGURES) + " FROM ("
    + "SELECT t, " + ", ".join(f"{c}::DOUBLE AS {c}" for c in FIGURES) + " FROM report" + "".join(f" UNION ALL SELECT {t}, " + ", ".join(f"{f}({c})" + (" FILTER (t > (SELECT min(t) FROM report))" if c == "blocks_reused" else "") for c in FIGURES) + " FROM report" for t, f in ((-1, "avg"), (-2, "stddev_pop"))) + ")",
}
