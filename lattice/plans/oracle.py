"""The named queries in DuckDB's SQL."""

from __future__ import annotations

from lattice.plans.fixtures import QUERY_STEP, TILE, VERTICES, sql

T = TILE
_PRODUCT = sql("SELECT a.i, b.j, sum(a.v * b.v) AS v FROM grid a JOIN grid b ON a.j = b.i GROUP BY 1, 2", "grid")
_HALF = "CASE WHEN {0} = 0 THEN 0 ELSE round_even({0} / pow(2.0, greatest(floor(log2(abs({0}))), -14) - 10), 0) * pow(2.0, greatest(floor(log2(abs({0}))), -14) - 10) END"


def _hash(i: str, seed: int) -> str:
    x = f"(({i} % 2147483648 * 1103515245 + 12345 + {seed * 7919}) % 2147483648)"
    return f"((({x} + {x} // 65536) % 2147483648 * 1103515245 + 12345) % 2147483648)"


def _uniform(i: str, low: float, high: float, seed: int = 5) -> str:
    return f"{low}::DOUBLE + {high - low}::DOUBLE * ({_hash(i, seed)}::DOUBLE / 2147483648::DOUBLE)"


def _conv(axis: str, tile: int | None, source: str) -> str:
    """Convolution of a relation of cells along an axis, within tiles or over all."""
    other = "i" if axis == "j" else "j"
    same = f" AND a.{axis} // {tile} = (b.{axis} + t.t - 8) // {tile}" if tile else ""
    # a is the input cell at offset t - 8 from output cell b; its tap is the one that mirrors the offset
    return f"SELECT b.i, b.j, sum(coalesce(a.v, 0) * k.tap) AS v FROM {source} b CROSS JOIN taps t JOIN taps k ON k.t = 16 - t.t LEFT JOIN {source} a ON a.{other} = b.{other} AND a.{axis} = b.{axis} + t.t - 8{same.replace(f'(b.{axis} + t.t - 8)', f'b.{axis}')} GROUP BY 1, 2"


def _heat(power: str, tile: int | None) -> str:
    def near(di: int, dj: int) -> str:
        inside = f" AND {{0}}.i // {tile} = g.i // {tile} AND {{0}}.j // {tile} = g.j // {tile}" if tile else ""
        name = {(0, 1): "e", (0, -1): "w", (1, 0): "s", (-1, 0): "n"}[di, dj]
        return f"LEFT JOIN grid {name} ON {name}.i = g.i + {di} AND {name}.j = g.j + {dj}{inside.format(name)}"

    joins = " ".join(near(*x) for x in ((0, 1), (0, -1), (1, 0), (-1, 0)))
    return f"""SELECT g.i, g.j, g.v + 0.125::DOUBLE * (p.v + (coalesce(s.v, g.v) + coalesce(n.v, g.v) - 2 * g.v) + (coalesce(e.v, g.v) + coalesce(w.v, g.v) - 2 * g.v) + (80 - g.v) / 8::DOUBLE) AS v
        FROM grid g JOIN {power} p ON p.i = g.i AND p.j = g.j {joins}"""


_DIST = "(SELECT p.i AS id, c.cid, sum((p.v - c.v) * (p.v - c.v)) AS d FROM cells1 p JOIN {0} c ON c.dim = p.j GROUP BY 1, 2)"


def _kmeans(rounds: int) -> str:
    """Expressions s1, c1, s2, ...: assignments to the centroids before, then their means."""
    out = ["c0 AS MATERIALIZED (SELECT i AS cid, j AS dim, v FROM cells1 WHERE i < 4)"]
    for r in range(1, rounds + 1):
        out.append(f"s{r} AS MATERIALIZED (SELECT id, arg_min(cid, (d, cid)) AS cid FROM {_DIST.format(f'c{r - 1}')} GROUP BY id)")
        out.append(f"c{r} AS MATERIALIZED (SELECT o.cid, o.dim, coalesce(m.v, o.v) AS v FROM c{r - 1} o LEFT JOIN (SELECT s.cid, p.j AS dim, avg(p.v) AS v FROM s{r} s JOIN cells1 p ON p.i = s.id GROUP BY 1, 2) m ON m.cid = o.cid AND m.dim = o.dim)")
    return "+" + ", ".join(out)


def _relax(rounds: int) -> str:
    out = [f"d0 AS MATERIALIZED (SELECT r AS v, CASE WHEN r = 0 THEN 0 ELSE 2147483647 END::BIGINT AS dist FROM range({VERTICES}) t(r))"]
    for r in range(1, rounds + 1):
        out.append(f"d{r} AS MATERIALIZED (SELECT o.v, least(o.dist, coalesce(m.d, o.dist)) AS dist FROM d{r - 1} o LEFT JOIN (SELECT e.dst, min(d.dist + e.w) AS d FROM edges e JOIN d{r - 1} d ON d.v = e.src WHERE d.dist < 2147483647 AND e.w > 0 GROUP BY 1) m ON m.dst = o.v)")
    return "+" + ", ".join(out) + f" SELECT v, dist FROM d{rounds}"


_RANK = f"""+own AS MATERIALIZED (SELECT src, dst FROM edges WHERE src <> dst AND w <> 0), deg AS MATERIALIZED (SELECT r AS v, coalesce(n, 0) AS n FROM range({VERTICES}) t(r) LEFT JOIN (SELECT src, count(*) AS n FROM own GROUP BY 1) ON src = r),
    g0 AS (SELECT v, n, CASE WHEN n > 0 THEN 1e0 / n ELSE 0e0 END AS g FROM deg),
    r1 AS MATERIALIZED (SELECT d.v, d.n, 0.15e0 + 0.85e0 * coalesce(s, 0e0) AS r FROM deg d LEFT JOIN (SELECT dst, sum(g) AS s FROM own JOIN g0 ON v = src GROUP BY 1) ON dst = d.v),
    r2 AS MATERIALIZED (SELECT d.v, d.n, 0.15e0 + 0.85e0 * coalesce(s, 0e0) AS r FROM deg d LEFT JOIN (SELECT dst, sum(r / greatest(n, 1)) AS s FROM own JOIN r1 ON v = src GROUP BY 1) ON dst = d.v),
    r3 AS MATERIALIZED (SELECT d.v, d.n, 0.15e0 + 0.85e0 * coalesce(s, 0e0) AS r FROM deg d LEFT JOIN (SELECT dst, sum(r / greatest(n, 1)) AS s FROM own JOIN r2 ON v = src GROUP BY 1) ON dst = d.v)
    SELECT v, round(r, 10) + 0e0 AS rank FROM r3"""

_MATRIX = "+m AS (SELECT app, avg(seconds) FILTER (config = 'baseline') AS baseline, avg(seconds) FILTER (config = 'software') AS software, avg(seconds) FILTER (config = 'hardware') AS hardware FROM runs GROUP BY 1)"
_SPEED = _MATRIX + ", s AS (SELECT app, 'baseline' AS config, baseline / baseline AS speedup FROM m UNION ALL SELECT app, 'software', baseline / software FROM m UNION ALL SELECT app, 'hardware', baseline / hardware FROM m)"
_CHANGED = "CASE WHEN (i * 7 + j) % 97 = 0 THEN 1 ELSE 0 END"

ORACLE_SQL = {
    "tile_partition": sql(f"SELECT i // {T} AS ti, j // {T} AS tj, count(*) AS n, sum(v * (i % {T} * {T} + j % {T} + 1)) AS checksum FROM grid GROUP BY 1, 2", "grid"),
    "tile_flatten": sql("SELECT i, j, v FROM grid", "grid"),
    "tile_fetch_2d": sql(f"SELECT i, j, v FROM grid WHERE i // {T} = 2 AND j // {T} = 1", "grid"),
    "row_stripe": sql(f"SELECT i, j, v FROM grid WHERE i // {T} = 1", "grid"),
    "col_stripe": sql(f"SELECT i, j, v FROM grid WHERE j // {T} = 2", "grid"),
    "tile_fetch_3d": sql("SELECT n, m, k, v FROM cube WHERE n // 4 = 1 AND m // 4 = 2 AND k // 4 = 0", "cube"),
    "tile_roundtrip_3d": sql("SELECT n, m, k, v FROM cube WHERE v <> 0", "cube"),
    "element_filters": sql("SELECT src, dst, w FROM edges WHERE w > 0 AND src <> dst", "edges"),
    "scalar_clamps": sql("SELECT i, j, least(greatest(v, 10), 90)::DOUBLE AS v, (v BETWEEN 10 AND 90)::BIGINT AS inside FROM grid", "grid"),
    "block_transpose": sql(f"SELECT j // {T} * {T} + i % {T} AS i, i // {T} * {T} + j % {T} AS j, v FROM grid", "grid"),
    "block_transpose_seq": sql(f"SELECT j // {T} * {T} + i % {T} AS i, i // {T} * {T} + j % {T} AS j, v FROM grid", "grid"),
    "transpose": sql("SELECT j AS i, i AS j, v FROM grid", "grid"),
    "cast_f32": sql("SELECT i, j, (v / 3)::FLOAT::DOUBLE AS v FROM cells1", "cells1"),
    "cast_f16": sql(f"SELECT i, j, {_HALF.format('v')} + 0.0::DOUBLE AS v FROM cells1", "cells1"),
    **{k: _PRODUCT for k in ("gemm_f64", "gemm_seq", "gemm_split_k", "gemm_whole", "gemm_ragged")},
    "gemm_f32": sql("SELECT a.j AS i, b.j, round(sum(a.v::FLOAT::DOUBLE * b.v::FLOAT::DOUBLE), 4) + 0.0::DOUBLE AS v FROM cells1 a JOIN cells1 b USING (i) GROUP BY 1, 2", "cells1"),
    "gemm_f16": sql(f"+h AS (SELECT i, j, {_HALF.format('v')} AS v FROM cells1) SELECT a.j AS i, b.j, round(sum(a.v * b.v), 4) + 0.0::DOUBLE AS v FROM h a JOIN h b USING (i) GROUP BY 1, 2", "cells1"),
    **{k: sql("SELECT a.i, b.j, sum((a.v % 16) * (b.v % 16))::DOUBLE AS v FROM grid a JOIN grid b ON a.j = b.i GROUP BY 1, 2", "grid") for k in ("gemm_f16_f32", "gemm_f32_f32", "gemm_f64_f32")},
    "squared_norms": sql("SELECT i AS id, round(sum(v * v), 4) + 0.0::DOUBLE AS v FROM cells1 GROUP BY 1", "cells1"),
    "neg2_dot": sql(f"SELECT q.i AS q, r.i AS ref, round(-2 * sum(q.v * r.v), 4) + 0.0::DOUBLE AS v FROM cells1 q JOIN cells1 r ON q.j = r.j WHERE q.i % {QUERY_STEP} = 0 GROUP BY 1, 2", "cells1"),
    "knn_topk": sql(f"+d AS (SELECT q.i AS q, r.i AS ref, sum((q.v - r.v) * (q.v - r.v)) AS d FROM cells1 q JOIN cells1 r ON q.j = r.j WHERE q.i % {QUERY_STEP} = 0 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, ref) - 1 AS rk FROM d) SELECT q, rk, ref, round(sqrt(d), 4) + 0.0::DOUBLE AS dist FROM k WHERE rk < 4", "cells1"),
    "kmeans_assign": sql(_kmeans(1) + " SELECT id, cid FROM s1", "cells1"),
    "kmeans_step": sql(_kmeans(1) + " SELECT cid, dim, round(v, 4) + 0.0::DOUBLE AS v FROM c1", "cells1"),
    "bfs": sql(f"+walk(v, cost) AS (SELECT 0::BIGINT, 0 UNION SELECT e.dst, w.cost + 1 FROM walk w JOIN edges e ON e.src = w.v WHERE w.cost < 40) SELECT r AS v, coalesce(c, -1) AS cost FROM range({VERTICES}) t(r) LEFT JOIN (SELECT v, min(cost) AS c FROM walk GROUP BY 1) ON v = r", "edges", recursive=True),
    "bellman_ford": sql(_relax(24), "edges"),
    "out_degree": sql(f"SELECT r AS v, coalesce(n, 0) AS degree FROM range({VERTICES}) t(r) LEFT JOIN (SELECT src, count(*) AS n FROM edges WHERE src <> dst AND w <> 0 GROUP BY 1) ON src = r", "edges"),
    "pagerank": sql(_RANK, "edges"),
    "graph_csr": sql(f"SELECT r AS v, coalesce(sum(n) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM (SELECT r, coalesce(n, 0) AS n FROM range({VERTICES + 1}) t(r) LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY 1) ON src = r)", "edges"),
    "graph_csr_targets": sql("SELECT src, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS place, dst FROM edges", "edges"),
    "graph_adjlist": sql(f"SELECT r AS v, r || ' ' || coalesce(n, 0) || coalesce(' ' || near, '') AS line FROM range({VERTICES}) t(r) LEFT JOIN (SELECT src, count(*) AS n, string_agg(dst::VARCHAR, ' ' ORDER BY dst) AS near FROM edges GROUP BY 1) ON src = r", "edges"),
    "graph_dense_row": sql(f"SELECT a.r AS i, b.r AS j, coalesce(w, 0)::DOUBLE AS v FROM range({VERTICES}) a(r) CROSS JOIN range({VERTICES}) b(r) LEFT JOIN edges ON src = a.r AND dst = b.r", "edges"),
    "graph_edge_check": sql("SELECT 2 * count(*) AS entries, count(*) AS stated, true AS ok FROM edges", "edges"),
    "graph_differences": sql("SELECT src, dst, 'left' AS side FROM edges WHERE w > 5 AND NOT w < 40 UNION ALL SELECT src, dst, 'right' FROM edges WHERE w < 40 AND NOT w > 5", "edges"),
    "conv_rows": sql(_conv("j", T, "grid"), "grid", "taps"),
    "conv_cols": sql(_conv("i", T, "grid"), "grid", "taps"),
    "conv_separable_tile": sql(f"+half AS MATERIALIZED ({_conv('j', T, 'grid')}) {_conv('i', T, 'half')}", "grid", "taps"),
    "conv_separable_global": sql(f"+half AS MATERIALIZED ({_conv('j', None, 'grid')}) {_conv('i', None, 'half')}", "grid", "taps"),
    "conv_separable_cells": sql(f"+half AS MATERIALIZED ({_conv('j', None, 'grid')}) {_conv('i', None, 'half')}", "grid", "taps"),
    "heat_step_tile": sql(_heat("grid", T), "grid"),
    "heat_two_steps": sql(f"+once AS MATERIALIZED ({_heat('power', None)}) {_heat('power', None).replace('grid', 'once')}", "grid", "power"),
    "negative_cycle": "SELECT false AS negative",
    "heat_step_global": sql(_heat("power", None), "grid", "power"),
    "ttv": sql("SELECT x.r AS n, y.r AS m, coalesce(s, 0)::DOUBLE AS v FROM range(16) x(r) CROSS JOIN range(16) y(r) LEFT JOIN (SELECT n, m, sum(v * a) AS s FROM cube JOIN vec USING (k) GROUP BY 1, 2) ON n = x.r AND m = y.r", "cube", "vec"),
    "tensor_contract": sql("SELECT z.r AS p, x.r AS n, y.r AS m, coalesce(s, 0)::DOUBLE AS v FROM range(16) z(r) CROSS JOIN range(16) x(r) CROSS JOIN range(16) y(r) LEFT JOIN (SELECT p, n, m, sum(v * a) AS s FROM cube JOIN mat USING (k) GROUP BY 1, 2, 3) c ON c.p = z.r AND c.n = x.r AND c.m = y.r", "cube", "mat"),
    "nan_inf_scan": sql("SELECT i, j FROM grid WHERE (i * 7 + j) % 97 = 0 OR (i + j * 5) % 89 = 0", "grid"),
    "tile_mismatch": sql(f"SELECT i // {T} AS ti, j // {T} AS tj, sum({_CHANGED})::BIGINT AS mismatches FROM grid GROUP BY 1, 2", "grid"),
    "stripe_mismatch": sql(f"SELECT i // {T} AS stripe, sum({_CHANGED})::BIGINT AS mismatches FROM grid GROUP BY 1", "grid"),
    "tensor_first_mismatch": sql("SELECT n, m, k, v + 1 AS a, v AS b FROM cube WHERE n + m + k = 11 ORDER BY n, m, k LIMIT 1", "cube"),
    "stage_durations": sql("SELECT stage, count(*) AS intervals, sum(end_us - start_us)::BIGINT AS total_us FROM intervals GROUP BY 1", "intervals"),
    "stage_rebased": sql("SELECT stage, seq, 0::BIGINT AS place, start_us - 1600000000000000 AS at_us FROM intervals UNION ALL SELECT stage, seq, 1, end_us - 1600000000000000 FROM intervals", "intervals"),
    "trace_events": sql("SELECT stage AS name, 'B' AS ph, 0::BIGINT AS pid, 0::BIGINT AS tid, start_us AS ts FROM intervals UNION ALL SELECT stage, 'E', 0, 0, end_us FROM intervals", "intervals"),
    "trace_merge": sql("+x AS (SELECT stage AS name, (seq > 100)::BIGINT AS tid, start_us, end_us FROM intervals) SELECT name, 'B' AS ph, tid, start_us AS ts FROM x UNION ALL SELECT name, 'E', tid, end_us FROM x", "intervals"),
    "log_parse": sql("+x AS (SELECT log, event_id, regexp_extract(line, 'End-to-end duration: ([0-9.]+) ms', 1) AS ms FROM loglines) SELECT log, row_number() OVER (PARTITION BY log ORDER BY event_id) - 1 AS ordinal, round(ms::DOUBLE / 1000, 6) + 0.0::DOUBLE AS seconds FROM x WHERE ms <> ''", "loglines"),
    "config_matrix": sql(_MATRIX + " SELECT app, round(baseline, 4) + 0.0::DOUBLE AS baseline, round(software, 4) + 0.0::DOUBLE AS software, round(hardware, 4) + 0.0::DOUBLE AS hardware FROM m", "runs"),
    "speedups": sql(_SPEED + " SELECT app, config, round(speedup, 4) + 0.0::DOUBLE AS speedup FROM s", "runs"),
    "speedup_report": sql(_SPEED + " SELECT config, round(avg(speedup), 4) + 0.0::DOUBLE AS mean, round(exp(avg(ln(speedup))), 4) + 0.0::DOUBLE AS geomean FROM s GROUP BY 1", "runs"),
    "gen_index_matrix": "SELECT r // 64 AS i, r % 64 AS j, r AS v FROM range(64 * 64) t(r)",
    "gen_uniform": f"SELECT r // 64 AS i, r % 64 AS j, {_uniform('r', 0.0, 1.0)} AS v FROM range(64 * 64) t(r)",
    "gen_points": f"SELECT r // 8 AS id, r % 8 AS dim, {_uniform('r', 0.0, 10.0)} AS v FROM range(64 * 8) t(r)",
    "gen_tensor": f"SELECT r // 256 AS n, r // 16 % 16 AS m, r % 16 AS k, {_uniform('r', -50.0, 50.0)} AS v FROM range(16 * 16 * 16) t(r)",
    "gen_graph": f"""WITH o AS (SELECT src, src * 4 + e AS seq FROM (SELECT r AS src, unnest(range({_hash('r', 5)} % 3 + 2)) AS e FROM range(500) t(r))),
        w AS (SELECT src, {_hash('seq', 6)} % 500 AS dst, {_hash('seq', 7)} % 10 + 1 AS w, seq * 2 AS seq FROM o),
        both_ AS (SELECT * FROM w UNION ALL SELECT dst, src, w, seq + 1 FROM w)
        SELECT src, dst, arg_max(w, seq) AS w FROM both_ GROUP BY 1, 2""",
}
