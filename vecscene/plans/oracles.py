"""SQL for the registered queries, for DuckDB over the same parquet tables."""

from __future__ import annotations

from ..sources.splats import FROM_EVENTS
from .queries import FINE, K, NEIGHBOURS, PROBES

S = f"with s as ({FROM_EVENTS})"
#: Splats with unit rotations.
U = S + ", n as (select *, sqrt(qw*qw+qx*qx+qy*qy+qz*qz) as qn from s), u as (select * exclude (qw,qx,qy,qz), qw/qn as w, qx/qn as x, qy/qn as y, qz/qn as z from n)"
_R = [["1-2*(y*y+z*z)", "2*(x*y+w*z)", "2*(x*z-w*y)"], ["2*(x*y-w*z)", "1-2*(x*x+z*z)", "2*(y*z+w*x)"], ["2*(x*z+w*y)", "2*(y*z-w*x)", "1-2*(x*x+y*y)"]]
_AXES = list(zip(("px", "py", "pz"), "xyz"))

V = "with v as (select vec_id as row_id, embedding::double[] as v from embeddings)"


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0e0 as {name}"


def _step(name: str, rows: str, c: str) -> str:
    """CTE of labels under centroids c (k, v)."""
    return f"{name} as (select row_id, k, d2 from (select a.row_id, c.k, list_distance(a.v, c.v) ** 2 as d2, row_number() over (partition by a.row_id order by list_distance(a.v, c.v), c.k) as o from {rows} a, {c} c) where o = 1)"


def _mean(name: str, labels: str, c: str) -> str:
    """CTE (k, pos, x, n, s) of new means; empty clusters are zero."""
    return (
        f"{name}_s as (select l.k, p.pos, sum(a.v[p.pos + 1]) as s, count(*) as n from v a join {labels} l using (row_id), (select unnest(range(64)) as pos) p group by 1, 2), "
        f"{name} as (select c.k, p.pos, coalesce(m.s / m.n, 0) as x, coalesce(m.n, 0) as n, coalesce(m.s, 0) as s, c.v[p.pos + 1] as was from {c} c cross join (select unnest(range(64)) as pos) p left join {name}_s m on m.k = c.k and m.pos = p.pos)"
    )


C0 = V + f", c0 as (select row_id as k, v from v where row_id < {K})"
L0 = C0 + ", " + _step("l0", "v", "c0")
M0 = L0 + ", " + _mean("m0", "l0", "c0")
_list = "c{j} as (select k, list(x order by pos) as v from m{i} group by k)"
LLOYD = M0 + "".join(", " + _list.format(i=i, j=i + 1) + ", " + _step(f"l{i + 1}", "v", f"c{i + 1}") + ", " + _mean(f"m{i + 1}", f"l{i + 1}", f"c{i + 1}") for i in range(2))
Q = "q as (select row_id as qid, v as qv from v where row_id % 20 = 0)"
EXACT = f"e as (select * from (select qid, row_id, list_distance(qv, v) as d, row_number() over (partition by qid order by list_distance(qv, v), row_id) as rank from q, v) where rank <= {NEIGHBOURS})"
PROBE = f"p as (select qid, k from (select qid, k, row_number() over (partition by qid order by list_distance(qv, v), k) as o from q, c0) where o <= {PROBES})"
IVF = f"i as (select * from (select p.qid, v.row_id, p.k as coarse, list_distance(qv, v.v) as d, row_number() over (partition by p.qid order by list_distance(qv, v.v), v.row_id) as rank from p join q on q.qid = p.qid join l0 on l0.k = p.k join v on v.row_id = l0.row_id) where rank <= {NEIGHBOURS})"
_N = f"n as (select event_id as seq, user_id as splat_id, row_number() over (partition by user_id order by ts, event_id) as n from events)"
_BOUNDS = "b as (select " + ", ".join(f"min({p}) as lo_{a}, max({p}) as hi_{a}" for p, a in _AXES) + " from s)"
_WAVES = [f"{f}(({p} - lo_{a}) / (hi_{a} - lo_{a} + 1e-8) * {float(2**d)}e0)" for d in range(10) for p, a in _AXES for f in ("sin", "cos")]
_BINS = S + ", c as (select id, least(floor(r*8), 7) as br, least(floor(g*8), 7) as bg, least(floor(b*8), 7) as bb from s)"
_ATTR = ["opacity", "opacity**2", "opacity**3", "sqrt(opacity+1e-8)", "ln(opacity+1e-8)", "1-opacity", "case when opacity>0.5 then 1e0 else 0e0 end", "case when opacity<0.5 then 1e0 else 0e0 end", "sx", "sy", "sz", "sx*sy*sz", "(sx+sy+sz)/3", "sqrt(sx*sx+sy*sy+sz*sz)", "sx/(sy+1e-8)", "sx/(sz+1e-8)", "sy/(sz+1e-8)", "sx*sx", "sy*sy", "sz*sz", "ln(sx+1e-8)", "ln(sy+1e-8)", "ln(sz+1e-8)"]
_ATTR2 = ["qw", "qx", "qy", "qz", "qw*qw", "qx*qx", "qy*qy", "qz*qz", "qw*qx", "qw*qy", "qw*qz", "qx*qy", "qx*qz", "qy*qz"]
_ALL_ATTR = [*_ATTR, *["0e0"] * (32 - len(_ATTR)), *_ATTR2, *["0e0"] * (32 - len(_ATTR2))]
_EXPLODE = "select id, cast(pos as int) as pos, round(x, 6) as x from (select id, unnest(range({n})) as pos, unnest([{xs}]) as x from {t})"
_HIST = "select c.id, i.r * 64 + i.g * 8 + i.b as pos, exp(-((i.r - br)**2 + (i.g - bg)**2 + (i.b - bb)**2) / 4e0) as x from c, (select a.r, b.g, d.b from (select unnest(range(8)) as r) a, (select unnest(range(8)) as g) b, (select unnest(range(8)) as b) d) i where abs(i.r - br) <= 2 and abs(i.g - bg) <= 2 and abs(i.b - bb) <= 2"

_NUM = "((row_id * 7919 + 17) % 10007)"
_W0 = "w0 as (select a.row_id, a.v, min(list_distance(a.v, c.v) ** 2) as d2 from v a, v c where c.row_id < 3 group by 1, 2)"
_DRAWN = _W0 + f", drawn as (select row_id, v from w0 where d2 > 0 and ({_NUM} + 0.5e0) / 10007e0 * (select sum(d2) from w0) < d2 * {2 * K}e0)"
_CAND = _DRAWN + ", cand as (select row_id as id, v as c, row_number() over (order by k, row_id) as o from (select row_id, v, 0 as k from v where row_id < 3 union all select row_id, v, 1 as k from drawn))"

_CUBE = "list_transform(range(512), lambda i: case when abs(i // 64 - least(floor(r*8), 7)) <= 2 and abs(i // 8 % 8 - least(floor(g*8), 7)) <= 2 and abs(i % 8 - least(floor(b*8), 7)) <= 2 then exp(-((i // 64 - least(floor(r*8), 7))**2 + (i // 8 % 8 - least(floor(g*8), 7))**2 + (i % 8 - least(floor(b*8), 7))**2) / 4e0) else 0e0 end)"
EMBEDDED = S + f", {_BOUNDS}, v as (select id as row_id, list_concat([{', '.join([*_WAVES, *['0e0'] * 4])}], {_CUBE}, [{', '.join(_ALL_ATTR)}]) as v from s, b)"

SQL = {
    "index_query": EMBEDDED + f", q as (select row_id as qid, v as qv from v where row_id % 500 = 0), {EXACT} select qid, rank::int as rank, row_id, round(d, 6) as distance from e",
    "kpar_oversample": V + f", {_DRAWN} select row_id from drawn",
    "kpar_weights": V + f", {_CAND} select id as row_id, count(*) as weight from (select id, row_number() over (partition by v.row_id order by list_distance(v.v, c), o) as r from v, cand) where r = 1 group by 1",
    "sample_rows": V + f" select row_id from v order by {_NUM}, row_id limit 100",
    "kmeans_bounded_lloyd": LLOYD + " select row_id, k::int as label from l2",
    "knn_join_all": V + f", q as (select row_id as qid, v as qv from v), {EXACT} select qid, rank::int as rank, row_id, round(d, 6) as distance from e",
    "knn_norm_bounded": "with u as (select vec_id as row_id, embedding::double[] as v from embeddings), v as (select row_id, list_transform(v, lambda x: x * (1 + row_id % 17)) as v from u)" + f", {Q}, {EXACT} select qid, rank::int as rank, row_id, round(d, 6) as distance from e",
    "ivf_stored_join": L0 + f", {Q}, {PROBE}, {IVF} select qid, rank::int as rank, row_id, round(d, 6) as distance from i",
    "coarse_probe_join": C0 + f", {Q}, {PROBE} select qid, k::int as coarse from p",
    "event_places": "with e as (select case when user_id % 10 > 0 then 0 else user_id end as part, event_id from events) select part, event_id, row_number() over (partition by part order by event_id) - 1 as place from e",
    "splat_scan": S + " select id, " + ", ".join(_r(c, c) for c in ("px", "py", "pz", "r", "g", "b", "opacity", "sx", "sy", "sz", "qw", "qx", "qy", "qz")) + " from s",
    "splat_json_roundtrip": S + " select id, " + ", ".join(_r(c, c) for c in ("px", "py", "pz", "r", "g", "b", "opacity", "sx", "sy", "sz")) + ", " + ", ".join(_r(a, a) for a in ("qw", "qx", "qy", "qz")) + ", 0::bigint as n_sh from s",
    "quat_normalize": U + " select id, " + ", ".join(_r(a, b) for a, b in (("w", "qw"), ("x", "qx"), ("y", "qy"), ("z", "qz"))) + " from u",
    "rotation_matrix": U + " select id, " + ", ".join(_r(_R[i][j], f"r{i}{j}") for i in range(3) for j in range(3)) + " from u",
    "covariance_3d": U + " select id, " + ", ".join(_r(" + ".join(f"({_R[i][k]})*s{'xyz'[k]}*s{'xyz'[k]}*({_R[j][k]})" for k in range(3)), f"c{i}{j}") for i in range(3) for j in range(i, 3)) + " from u",
    "cluster_bounds": S + " select user_id, count(*) as size, " + ", ".join(_r(f"{f}({p})", f"{f}_{a}") for p, a in _AXES for f in ("min", "max")) + " from s group by user_id",
    "contains_point": S + " select user_id, min(px) <= 5 and max(px) >= 5 and min(py) <= 0 and max(py) >= 0 and min(pz) <= 4.8e0 and max(pz) >= 4.8e0 as inside from s group by user_id",
    "position_bounds": S + " select " + ", ".join(_r(f"{f}({p})", f"{f}_{a}") for p, a in _AXES for f in ("min", "max")) + " from s",
    "position_encode": S + ", " + _BOUNDS + ", t as (select * from s, b) " + _EXPLODE.format(n=64, xs=", ".join([*_WAVES, *["0e0"] * 4]), t="t"),
    "color_normalize": S + " select id, " + ", ".join(_r(f"least(1, greatest(0, {c}*255/255))", c) for c in "rgb") + " from s",
    "color_bins": _BINS + " select id, br::bigint as br, bg::bigint as bg, bb::bigint as bb from c",
    "color_histogram": _BINS + f" select id, cast(pos as int) as pos, round(x, 6) as x from ({_HIST})",
    "attr_encode": S + " " + _EXPLODE.format(n=64, xs=", ".join(_ALL_ATTR), t="s"),
    "full_embedding": _BINS + ", " + _BOUNDS + ", t as (select * from s, b), all_ as (" + _EXPLODE.format(n=64, xs=", ".join([*_WAVES, *["0e0"] * 4]), t="t") + f" union all select id, cast(pos + 64 as int) as pos, round(x, 6) as x from ({_HIST}) union all select id, cast(pos + 576 as int) as pos, x from (" + _EXPLODE.format(n=64, xs=", ".join(_ALL_ATTR), t="s") + ")) select id, pos, x from all_ where x <> 0",
    "point_lookup": S + " select id, " + ", ".join(_r(c, c) for c in ("px", "py", "pz", "opacity")) + " from s where id in (7, 42, -1)",
    "embedding_norms": _BINS.replace("with s", "with s", 1) + ", " + _BOUNDS + f", h as (select id, sum(x*x) as h from ({_HIST}) group by id) select s.id, 640::bigint as dim, round(h.h + " + " + ".join(f"({w})**2" for w in _WAVES + _ATTR + _ATTR2) + ", 4) as norm_sq from s join h using (id), b",
    "vector_dot_norm": V + ", o as (select v as ov from v where row_id = 0) select row_id, " + ", ".join([_r("sqrt(list_dot_product(v, v))", "norm"), _r("list_dot_product(v, ov)", "dot0"), _r("list_distance(v, ov)", "distance0")]) + " from v, o",
    "gram_vs_direct": V + ", o as (select v as ov from v where row_id = 0) select row_id, " + ", ".join([_r("list_distance(v, ov) ** 2", "direct"), _r("list_dot_product(v, v) + list_dot_product(ov, ov) - 2 * list_dot_product(v, ov)", "gram")]) + " from v, o",
    "kmeans_assign": L0 + " select row_id, k::int as label, round(d2, 6) as d2 from l0",
    "kmeans_update": M0 + " select k::int as k, pos::int as pos, round(x, 6) as x from m0",
    "kmeans_inertia": L0 + " select round(sum(d2), 6) as inertia from l0",
    "kmeans_shift": M0 + " select round(sum((x - was) ** 2), 6) as shift from m0",
    "kmeans_lloyd_3": LLOYD + " select k::int as k, pos::int as pos, round(x, 6) as x from m2",
    "kmeans_minibatch_step": M0 + " select k::int as k, pos::int as pos, round((was + s) / (1 + n), 6) as x from m0",
    "kmeans_batchmean_step": M0 + " select k::int as k, pos::int as pos, round(case when n > 0 then (1 - 1 / (1e0 + n)) * was + x / (1e0 + n) else was end, 6) as x from m0",
    "kmeans_transform": C0 + " select a.row_id, c.k::int as k, round(list_distance(a.v, c.v), 6) as distance from v a, c0 c",
    "kpp_min_dist": V + " select a.row_id, round(min(list_distance(a.v, c.v) ** 2), 6) as min_d2 from v a, v c where c.row_id < 3 group by 1",
    "kpp_pick": V + ", m as (select a.row_id, min(list_distance(a.v, c.v) ** 2) as w from v a, v c where c.row_id < 3 group by 1), s as (select row_id, sum(w) over (order by row_id) as upto, sum(w) over () as whole from m), r as (select unnest([0, 1, 2, 3, 4]) as draw, unnest([0.05e0, 0.25e0, 0.5e0, 0.75e0, 0.95e0]) as r) select draw::int as draw, min(row_id) as row_id from s, r where upto >= r * whole group by 1",
    "knn_exact": V + f" select row_number() over (order by list_distance(a.v, o.v), a.row_id)::int as rank, a.row_id, round(list_distance(a.v, o.v), 6) as distance from v a, v o where o.row_id = 0 order by list_distance(a.v, o.v), a.row_id limit {NEIGHBOURS}",
    "ivf_query": L0 + f", {Q}, {PROBE}, {IVF} select rank::int as rank, row_id, round(d, 6) as distance from i where qid = 0",
    "ivf_candidates": L0 + f", {Q}, {PROBE} select p.qid, l0.row_id, p.k::int as coarse from p join l0 on l0.k = p.k",
    "ivf_join_query": L0 + f", {Q}, {PROBE}, {IVF} select qid, rank::int as rank, row_id, round(d, 6) as distance from i",
    "cluster_members": L0 + " select row_id, k::int as coarse, (row_number() over (partition by k order by row_id) - 1)::int as place from l0",
    "knn_exact_batch": V + f", {Q}, {EXACT} select qid, rank::int as rank, row_id, round(d, 6) as distance from e",
    "linear_search": V + " select a.row_id, round(list_distance(a.v, o.v), 6) as distance from v a, v o where o.row_id = 0 order by list_distance(a.v, o.v), a.row_id limit 10",
    "coarse_probe": C0 + f", {Q}, {PROBE} select qid, k::int as coarse from p",
    "ivf_batch_query": L0 + f", {Q}, {PROBE}, {IVF} select qid, rank::int as rank, row_id, round(d, 6) as distance from i",
    "ivf_query_details": L0 + f", {Q}, {PROBE}, {IVF}, z as (select l0.row_id, l0.k, v.v, row_number() over (partition by l0.k order by l0.row_id) - 1 as place from l0 join v using (row_id)), y as (select row_id, fine from (select a.row_id, b.place as fine, row_number() over (partition by a.row_id order by list_distance(a.v, b.v), b.place) as o from z a join z b on b.k = a.k and b.place < {FINE}) where o = 1) select qid, rank::int as rank, i.row_id, round(d, 6) as distance, coarse::int as coarse, fine::int as fine from i join y on y.row_id = i.row_id",
    "recall_at_k": L0 + f", {Q}, {PROBE}, {IVF}, {EXACT} select e.qid, round(count(i.row_id) / count(*)::double, 6) as recall from e left join i on i.qid = e.qid and i.row_id = e.row_id group by 1",
    "cluster_sizes": L0 + " select k::int as label, count(*) as size from l0 group by 1",
    "index_stats": L0 + ", z as (select k, count(*) as size from l0 group by 1) select sum(size)::bigint as n_splats, count(*) as n_coarse, sum(greatest(1, least(1000, floor(size / 5))))::bigint as n_fine from z",
    "latency_percentiles": "select count(value) as n, " + ", ".join([_r("avg(value)", "mean"), _r("stddev_pop(value)", "std"), _r("quantile_cont(value, 0.5)", "p50"), _r("quantile_cont(value, 0.95)", "p95"), _r("max(value)", "max"), _r("count(value) / sum(value)", "qps")]) + " from events",
    "access_count": f"with {_N} select seq, splat_id, n from n",
    "tier_access": f"with {_N} select seq, splat_id, case when n = 1 then 'cold' when n <= 10 then 'ram' else 'vram' end as outcome, n = 10 as promoted from n",
    "tier_counts": f"with {_N} select count(*) filter (n > 1) as cache_hits, count(*) filter (n = 1) as cache_misses, count(*) filter (n = 10) as promotions from n",
    "tier_final": "select user_id as splat_id, case when count(*) >= 10 then 'vram' else 'ram' end as tier from events group by 1",
}
