"""SQL formulations of the registered queries, for a single-node engine that checks their results.

They derive everything from the driver's tables by another route: neighbours by joins on lattice corners for all kinds at once, walks by one recursive query, components by a keyed recursion.
"""

from __future__ import annotations

from meshfront.functions.physics import K_BOLTZMANN, KPC, KPC_IN_KM, MSUN, PROTON_MASS

G = "(5e0 / 3e0)"


def r6(c: str) -> str:
    return f"floor(({c}) * 1e6 + 5e-1) / 1e6"


def lg(c: str) -> str:
    return f"CASE WHEN ({c}) > 0 THEN {r6(f'log10({c})')} ELSE 0e0 END"


def _norm(x: str, y: str, z: str) -> str:
    return f"sqrt(({x}) * ({x}) + ({y}) * ({y}) + ({z}) * ({z}))"


_BASE = """
o AS (SELECT o_orderkey AS id, o_totalprice AS p, o_orderpriority AS pr FROM orders),
side AS (SELECT CAST(ceil(cbrt(count(*)) - 1e-9) AS BIGINT) AS s FROM o),
f AS (SELECT id, pr, id % s AS ix, (id // s) % s AS iy, id // (s * s) AS iz, (p / 5000 + 1) * 1.0e4 AS t, (p / 100000 + 1) * 1.0e6 AS rho,
 CAST((id * id * 37 + id * 7919) % 401 - 200 AS DOUBLE) AS vx, CAST((id * id * 53 + id * 101) % 401 - 200 AS DOUBLE) AS vy, CAST((id * id * 71 + id * 307) % 401 - 200 AS DOUBLE) AS vz FROM o, side)"""

_UNIFORM = _BASE + """,
c AS MATERIALIZED (SELECT id AS row_id, ix + 5e-1 AS x, iy + 5e-1 AS y, iz + 5e-1 AS z, 1e0 AS dx, vx, vy, vz, t, rho, 0 AS level FROM f)"""

_TWO = _BASE + """,
c AS MATERIALIZED (SELECT id * 8 AS row_id, ix * 2 + 1e0 AS x, iy * 2 + 1e0 AS y, iz * 2 + 1e0 AS z, 2e0 AS dx, vx, vy, vz, t, rho, 0 AS level FROM f WHERE pr <> '1-URGENT'
 UNION ALL SELECT id * 8 + k, ix * 2 + 5e-1 + (k & 1), iy * 2 + 5e-1 + ((k >> 1) & 1), iz * 2 + 5e-1 + ((k >> 2) & 1), 1e0, vx, vy, vz, t * (k * 1e-2 + 1), rho * (k * 1e-2 + 1), 1 FROM f, (SELECT unnest(range(8)) AS k) WHERE pr = '1-URGENT')"""

_LATTICE = """,
g AS (SELECT min(dx) AS d, min(x - dx / 2) AS ox, min(y - dx / 2) AS oy, min(z - dx / 2) AS oz FROM c),
l AS MATERIALIZED (SELECT row_id, level, CAST(floor(dx / d + 5e-1) AS BIGINT) AS w, CAST(floor((x - dx / 2 - ox) / d + 5e-1) AS BIGINT) AS lx, CAST(floor((y - dx / 2 - oy) / d + 5e-1) AS BIGINT) AS ly, CAST(floor((z - dx / 2 - oz) / d + 5e-1) AS BIGINT) AS lz FROM c, g),
face (face, axis, way) AS (VALUES (0, 0, -1), (1, 0, 1), (2, 1, -1), (3, 1, 1), (4, 2, -1), (5, 2, 1)),
sides AS (SELECT l.*, face, axis, way FROM l, face),
same AS MATERIALIZED (SELECT s.row_id, s.face, n.row_id AS nbr_id FROM sides s JOIN l n ON n.level = s.level AND n.w = s.w
 AND n.lx = s.lx + CASE WHEN axis = 0 THEN way * s.w ELSE 0 END AND n.ly = s.ly + CASE WHEN axis = 1 THEN way * s.w ELSE 0 END AND n.lz = s.lz + CASE WHEN axis = 2 THEN way * s.w ELSE 0 END),
open1 AS MATERIALIZED (SELECT s.*, CASE WHEN way < 0 THEN -1 ELSE w END AS step FROM sides s ANTI JOIN same USING (row_id, face)),
coarse AS MATERIALIZED (SELECT s.row_id, s.face, n.row_id AS nbr_id FROM (SELECT *, lx + CASE WHEN axis = 0 THEN step ELSE 0 END AS tx, ly + CASE WHEN axis = 1 THEN step ELSE 0 END AS ty, lz + CASE WHEN axis = 2 THEN step ELSE 0 END AS tz FROM open1) s
 JOIN l n ON n.level = s.level - 1 AND n.w = 2 * s.w AND tx >= 0 AND ty >= 0 AND tz >= 0 AND n.lx = tx // (2 * s.w) * 2 * s.w AND n.ly = ty // (2 * s.w) * 2 * s.w AND n.lz = tz // (2 * s.w) * 2 * s.w),
open2 AS (SELECT s.*, k // 2 AS hi, k % 2 AS lo, CAST(k AS INTEGER) AS slot, CASE WHEN way < 0 THEN -(w // 2) ELSE w END AS away FROM open1 s ANTI JOIN coarse USING (row_id, face), (SELECT unnest(range(4)) AS k) WHERE w % 2 = 0),
fine AS MATERIALIZED (SELECT s.row_id, s.face, s.slot, n.row_id AS nbr_id FROM open2 s JOIN l n ON n.level = s.level + 1
 AND n.lx = s.lx + CASE WHEN axis = 0 THEN away ELSE hi * (s.w // 2) END AND n.ly = s.ly + CASE axis WHEN 1 THEN away WHEN 0 THEN hi * (s.w // 2) ELSE lo * (s.w // 2) END AND n.lz = s.lz + CASE WHEN axis = 2 THEN away ELSE lo * (s.w // 2) END),
links AS MATERIALIZED (SELECT row_id, face, 'same' AS kind, 0 AS slot, nbr_id FROM same UNION ALL SELECT row_id, face, 'coarse', 0, nbr_id FROM coarse UNION ALL SELECT row_id, face, 'fine', slot, nbr_id FROM fine)"""

_SAMPLES = """,
e AS (SELECT *, CASE WHEN t > 0 AND rho > 0 THEN t / pow(rho, 5e0 / 3e0 - 1) ELSE 0e0 END AS s FROM c),
samples AS MATERIALIZED (SELECT k.row_id, face, max(CASE WHEN kind <> 'fine' THEN CASE face // 2 WHEN 0 THEN x WHEN 1 THEN y ELSE z END END) AS p, avg(CASE face // 2 WHEN 0 THEN vx WHEN 1 THEN vy ELSE vz END) AS v, avg(t) AS t, avg(s) AS s
 FROM links k JOIN e ON e.row_id = k.nbr_id WHERE t > 0 AND rho > 0 GROUP BY k.row_id, face)"""


def _stencil() -> str:
    pairs = f"""SELECT c.row_id, a.face // 2 AS axis, a.v AS va, b.v AS vb, a.t AS ta, b.t AS tb, a.s AS sa, b.s AS sb,
 coalesce(b.p, CASE a.face // 2 WHEN 0 THEN x WHEN 1 THEN y ELSE z END + dx / 2) - coalesce(a.p, CASE a.face // 2 WHEN 0 THEN x WHEN 1 THEN y ELSE z END - dx / 2) AS far
 FROM c JOIN samples a ON a.row_id = c.row_id AND a.face % 2 = 0 JOIN samples b ON b.row_id = c.row_id AND b.face = a.face + 1 WHERE c.t > 0 AND c.rho > 0 AND dx > 0"""
    by = lambda e, k: f"coalesce(max(CASE WHEN axis = {k} THEN {e} END), 0e0)"
    grads = ", ".join(f"{by(f'({q}b - {q}a) / far', k)} AS g{q}{a}" for q in "vts" for k, a in enumerate("xyz"))
    return f""",
pairs AS (SELECT * FROM ({pairs}) WHERE abs(far) > 0),
grads AS (SELECT row_id, {grads} FROM pairs GROUP BY row_id),
st0 AS (SELECT c.*, coalesce(gvx, 0) + coalesce(gvy, 0) + coalesce(gvz, 0) AS divv, coalesce(gtx, 0) AS gtx, coalesce(gty, 0) AS gty, coalesce(gtz, 0) AS gtz, coalesce(gsx, 0) AS gsx0, coalesce(gsy, 0) AS gsy0, coalesce(gsz, 0) AS gsz0, grads.row_id IS NOT NULL AS valid,
 coalesce(gtx * gsx + gty * gsy + gtz * gsz, 0) AS rising FROM c LEFT JOIN grads USING (row_id)),
st AS MATERIALIZED (SELECT *, valid AND divv < 0 AND rising > 0 AS candidate, CASE WHEN gl > 0 THEN gtx / gl ELSE 0e0 END AS nx, CASE WHEN gl > 0 THEN gty / gl ELSE 0e0 END AS ny, CASE WHEN gl > 0 THEN gtz / gl ELSE 0e0 END AS nz FROM (SELECT *, {_norm("gtx", "gty", "gtz")} AS gl FROM st0))"""


def _ray(src: str, keep: str) -> str:
    """Rows of ``src`` with the exit face and the point beyond; src has x y z dx, p* and u*."""
    t = lambda c: f"CASE WHEN u{c} > 1e-14 THEN (({c} + dx / 2) - p{c}) / u{c} WHEN u{c} < -1e-14 THEN (({c} - dx / 2) - p{c}) / u{c} END"
    pos = lambda c: f"CASE WHEN t{c} > 1e-14 THEN t{c} ELSE 1e300 END"
    return f"""(SELECT *, px + ux * reach AS qx, py + uy * reach AS qy, pz + uz * reach AS qz FROM (SELECT *, tb + greatest(dx, 1e0) * 1e-10 AS reach,
 CASE WHEN tb >= 1e299 THEN -1 WHEN h0 = tb THEN 0 + CAST(ux > 0 AS INT) WHEN h1 = tb THEN 2 + CAST(uy > 0 AS INT) ELSE 4 + CAST(uz > 0 AS INT) END AS out FROM (SELECT *, least(h0, h1, h2) AS tb FROM (SELECT *, {pos("x")} AS h0, {pos("y")} AS h1, {pos("z")} AS h2
 FROM (SELECT {keep}, x, y, z, dx, px, py, pz, ux, uy, uz, {t("x")} AS tx, {t("y")} AS ty, {t("z")} AS tz FROM {src})))))"""


def _centers() -> str:
    src = "(SELECT row_id, way, x, y, z, dx, x AS px, y AS py, z AS pz, way * nx AS ux, way * ny AS uy, way * nz AS uz FROM st, (VALUES (1e0), (-1e0)) w(way) WHERE candidate)"
    good = "n.candidate AND {n} > 0 AND abs(n.nx * a.nx + n.ny * a.ny + n.nz * a.nz) >= 7e-1".format(n=_norm("n.nx", "n.ny", "n.nz"))
    better = lambda d, i, e, j: f"({e} < {d} - 1e-12 * greatest(1e0, abs({d}), abs({e})) OR (abs({e} - {d}) <= 1e-12 * greatest(1e0, abs({d}), abs({e})) AND {j} < {i}))"
    return f""",
hop AS (SELECT r.row_id, r.way, min(struct_pack(far := (n.x - qx) * (n.x - qx) + (n.y - qy) * (n.y - qy) + (n.z - qz) * (n.z - qz), slot := k.slot, id := n.row_id)).id AS id
 FROM {_ray(src, "row_id, way")} r JOIN links k ON k.row_id = r.row_id AND k.face = r.out JOIN st n ON n.row_id = k.nbr_id GROUP BY r.row_id, r.way),
fit AS (SELECT h.row_id, h.way, n.row_id AS id, n.divv FROM hop h JOIN st a ON a.row_id = h.row_id JOIN st n ON n.row_id = h.id WHERE {good}),
one AS (SELECT a.row_id, CASE WHEN u.id IS NOT NULL AND {better("a.divv", "a.row_id", "u.divv", "u.id")} THEN u.id ELSE a.row_id END AS id, CASE WHEN u.id IS NOT NULL AND {better("a.divv", "a.row_id", "u.divv", "u.id")} THEN u.divv ELSE a.divv END AS divv
 FROM st a LEFT JOIN fit u ON u.row_id = a.row_id AND u.way > 0 WHERE a.candidate),
nextid AS MATERIALIZED (SELECT a.row_id, CASE WHEN d.id IS NOT NULL AND {better("a.divv", "a.id", "d.divv", "d.id")} THEN d.id ELSE a.id END AS next_id FROM one a LEFT JOIN fit d ON d.row_id = a.row_id AND d.way < 0),
center AS MATERIALIZED (SELECT st.* FROM st JOIN nextid USING (row_id) WHERE next_id = st.row_id AND gl > 0)"""


def _long_paths(limit: int) -> str:
    """Starts that fail to reach a center or a resolved row in ``limit`` moves. What is resolved includes all that lies ahead of it, so a row finds a resolved one in reach if and only if the row ``limit`` moves ahead is one."""
    return f""",
mv AS MATERIALIZED (SELECT row_id, next_id FROM nextid JOIN st USING (row_id) WHERE gl > 0),
ahead(id, anc, n) AS (SELECT row_id, row_id, 0 FROM mv UNION ALL SELECT a.id, m.next_id, n + 1 FROM ahead a JOIN mv m ON m.row_id = a.anc WHERE m.next_id <> m.row_id),
depth AS MATERIALIZED (SELECT id, max(n) AS d FROM ahead GROUP BY id),
mark AS MATERIALIZED (SELECT id, anc FROM ahead WHERE n = {limit}),
since(id, first) USING KEY (id) AS (
 SELECT anc, min(id) FROM ahead JOIN depth USING (id) WHERE d <= {limit} GROUP BY anc
 UNION (SELECT a.anc, min(m.id) AS early FROM mark m JOIN depth d ON d.id = m.id AND d.d > {limit} JOIN recurring.since s ON s.id = m.anc AND s.first < m.id JOIN ahead a ON a.id = m.id
  LEFT JOIN recurring.since o ON o.id = a.anc WHERE o.first IS NULL OR m.id < o.first GROUP BY a.anc)),
far AS (SELECT count(*) AS n FROM mark m JOIN depth d ON d.id = m.id AND d.d > {limit} LEFT JOIN since s ON s.id = m.anc WHERE s.first IS NULL OR s.first >= m.id)"""


def _walk(name: str, starts: str, way: str, steps: int = 50) -> str:
    src = "(SELECT w.center, w.px, w.py, w.pz, w.ux, w.uy, w.uz, w.n, a.row_id AS cur, a.x, a.y, a.z, a.dx, a.t AS ct, a.rho AS cr FROM {0} w JOIN st a ON a.row_id = w.here WHERE w.reason = 'go' AND w.n < {1})".format(name, steps)
    ray = _ray(src, "center, n, cur, ct, cr")
    best = "min(struct_pack(far := (b.x - qx) * (b.x - qx) + (b.y - qy) * (b.y - qy) + (b.z - qz) * (b.z - qz), slot := k.slot, id := b.row_id))"
    return f""",
{name}(center, here, px, py, pz, ux, uy, uz, n, reason) AS (
 SELECT row_id, row_id, x, y, z, {way} * nx, {way} * ny, {way} * nz, 0, 'go' FROM {starts}
 UNION ALL
 SELECT h.center, coalesce(e.row_id, -1), qx, qy, qz, ux, uy, uz, n + 1, CASE WHEN e.row_id IS NULL THEN 'missing' WHEN e.divv >= 0 THEN 'nonconverging' WHEN (e.t - ct) * (e.rho - cr) <= 0 THEN 'thermodynamic' WHEN NOT e.candidate THEN 'candidate' ELSE 'go' END
 FROM (SELECT r.center, any_value(n) AS n, any_value(ct) AS ct, any_value(cr) AS cr, any_value(qx) AS qx, any_value(qy) AS qy, any_value(qz) AS qz, any_value(ux) AS ux, any_value(uy) AS uy, any_value(uz) AS uz,
  {best.replace("min(", "min(CASE WHEN b.row_id IS NOT NULL THEN ").replace("b.row_id))", "b.row_id) END)")} AS hit
  FROM {ray} r LEFT JOIN links k ON k.row_id = r.cur AND k.face = r.out LEFT JOIN st b ON b.row_id = k.nbr_id GROUP BY r.center) h LEFT JOIN st e ON e.row_id = h.hit.id)"""


def _shocks(steps: int = 50, floor: str = "1") -> str:
    a, b, cc = f"(2 * {G} * ({G} - 1))", f"(4 * {G} - ({G} - 1) * ({G} - 1) - ratio * (({G} + 1) * ({G} + 1)))", f"(-2 * ({G} - 1))"
    mach = f"CASE WHEN ratio <= 1 THEN 1e0 ELSE sqrt(greatest((sqrt(greatest({b} * {b} - 4 * {a} * {cc}, 0e0)) - {b}) / (2 * {a}), 1e0)) END"
    return f"""{_walk("up", "center", "-1e0", steps)},
upend AS MATERIALIZED (SELECT * FROM up WHERE reason <> 'go' OR n = {steps}),
reached AS MATERIALIZED (SELECT center.* FROM center JOIN upend ON upend.center = center.row_id WHERE reason IN ('nonconverging', 'thermodynamic', 'candidate')){_walk("down", "reached", "1e0", steps)},
downend AS MATERIALIZED (SELECT * FROM down WHERE reason <> 'go' OR n = {steps}),
both_ends AS (SELECT u.center AS row_id, a.row_id AS ui, d.row_id AS di, a.t AS ut, a.rho AS ur, d.t AS dt, d.rho AS dr, d.x - a.x AS ex, d.y - a.y AS ey, d.z - a.z AS ez, greatest(a.t, 1e4) AS t0
 FROM upend u JOIN downend w ON w.center = u.center JOIN st a ON a.row_id = u.here JOIN st d ON d.row_id = w.here WHERE u.reason IN ('nonconverging', 'thermodynamic', 'candidate') AND w.reason IN ('nonconverging', 'thermodynamic', 'candidate')),
judged AS MATERIALIZED (SELECT *, CASE WHEN dt > t0 AND dr > ur THEN {mach} END AS mach FROM (SELECT *, dt / t0 AS ratio FROM both_ends)),
shock AS MATERIALIZED (SELECT s.row_id, mach, ui, di, ut, ur, zw, CASE WHEN zw > 0 THEN ex / zw ELSE 0e0 END AS nx, CASE WHEN zw > 0 THEN ey / zw ELSE 0e0 END AS ny, CASE WHEN zw > 0 THEN ez / zw ELSE 0e0 END AS nz, c.x, c.y, c.z, c.dx, c.level
 FROM (SELECT *, {_norm("ex", "ey", "ez")} AS zw FROM judged WHERE mach >= {floor} * (1 - 1e-12)) s JOIN c USING (row_id))"""


def _dissipation() -> str:
    eff = f"""CASE WHEN mach > 1 THEN greatest(2e0 / ({G} * ({G} - 1) * mach * mach * cr) * ((2 * {G} * mach * mach - ({G} - 1)) / ({G} + 1) - pow(cr, {G})), 0e0) ELSE 0e0 END"""
    return f""",
dis AS MATERIALIZED (SELECT *, 5e-1 * ur * {MSUN / KPC**3!r} * pow(mach * cs, 3) * eff * {KPC**2!r} AS flux, 5e-1 * ur * {MSUN / KPC**3!r} * pow(mach * cs, 3) * eff * {KPC**2!r} * area AS total
 FROM (SELECT *, {eff} AS eff, sqrt({G} * {K_BOLTZMANN!r} * greatest(ut, 1e4) / (59e-2 * {PROTON_MASS!r})) AS cs, (dx / {KPC_IN_KM!r}) * (dx / {KPC_IN_KM!r}) / CASE WHEN big > 0 THEN least(greatest(big, 1 / sqrt(3e0)), 1e0) ELSE 1e0 END AS area
 FROM (SELECT *, greatest(abs(nx), abs(ny), abs(nz)) AS big, ({G} + 1) * mach * mach / (({G} - 1) * mach * mach + 2) AS cr FROM shock)) WHERE mach > 1)"""


def _component(name: str, nodes: str, edges: str) -> str:
    """Least reachable row of each node; edges (a, b) hold both directions."""
    return f""",
{name}(id, comp) USING KEY (id) AS (SELECT row_id, row_id FROM {nodes}
 UNION (SELECT DISTINCT ON (u.id) u.id, v.comp FROM recurring.{name} u JOIN {edges} e ON e.a = u.id JOIN {name} v ON v.id = e.b WHERE v.comp < u.comp ORDER BY u.id, v.comp))"""


def _catalog(tolerance: str = "3e-1", cosine: str = "7e-1", duplicate: str = "8e-1", floor: str = "1e0", tag: str = "", external: str = "2e5") -> str:
    na, nb = _norm("a.nx", "a.ny", "a.nz"), _norm("b.nx", "b.ny", "b.nz")
    dot = "abs(a.nx * b.nx + a.ny * b.ny + a.nz * b.nz)"
    far = _norm("b.x - a.x", "b.y - a.y", "b.z - a.z")
    along = lambda v: f"abs((b.x - a.x) * {v}.nx + (b.y - a.y) * {v}.ny + (b.z - a.z) * {v}.nz)"
    both = lambda e: f"(SELECT a, b FROM {e} UNION SELECT b, a FROM {e})"
    return f""",
sel{tag} AS MATERIALIZED (SELECT * FROM dis WHERE mach >= {floor}),
de0{tag} AS (SELECT a.row_id AS a, b.row_id AS b FROM links k JOIN sel{tag} a ON a.row_id = k.row_id JOIN sel{tag} b ON b.row_id = k.nbr_id WHERE {na} > 0 AND {nb} > 0 AND {far} > 0 AND least({dot} / ({na} * {nb}), {along("a")} / ({far} * {na}), {along("b")} / ({far} * {nb})) >= {duplicate}),
de{tag} AS MATERIALIZED {both(f"de0{tag}")}{_component(f"stack{tag}", f"sel{tag}", f"de{tag}")},
rep{tag} AS MATERIALIZED (SELECT s.row_id, first_value(s.row_id) OVER (PARTITION BY k.comp ORDER BY mach DESC, s.row_id) AS representative FROM sel{tag} s JOIN stack{tag} k ON k.id = s.row_id),
kept{tag} AS MATERIALIZED (SELECT s.* FROM sel{tag} s JOIN rep{tag} r ON r.row_id = s.row_id AND r.representative = s.row_id),
le0{tag} AS (SELECT a.row_id AS a, b.row_id AS b FROM links k JOIN kept{tag} a ON a.row_id = k.row_id JOIN kept{tag} b ON b.row_id = k.nbr_id WHERE abs(a.mach - b.mach) / greatest(a.mach, b.mach) <= {tolerance} AND CASE WHEN {na} = 0 OR {nb} = 0 THEN TRUE ELSE {dot} / ({na} * {nb}) >= {cosine} END),
le{tag} AS MATERIALIZED {both(f"le0{tag}")}{_component(f"surf{tag}", f"kept{tag}", f"le{tag}")},
mem{tag} AS MATERIALIZED (SELECT s.*, k.comp AS root FROM kept{tag} s JOIN surf{tag} k ON k.id = s.row_id)""" + ("" if tag else _GROUPS.replace("@external", external))


_GROUPS = f""",
region AS (SELECT min(x - dx / 2) AS x0, max(x + dx / 2) AS x1, min(y - dx / 2) AS y0, max(y + dx / 2) AS y1, min(z - dx / 2) AS z0, max(z + dx / 2) AS z1 FROM c),
ref AS (SELECT root, sum(area * mach) / sum(area) AS mm, arg_min(struct_pack(nx := nx, ny := ny, nz := nz), row_id) FILTER ({_norm("nx", "ny", "nz")} > 0) AS n FROM mem GROUP BY root),
ori AS (SELECT m.*, mm, CASE WHEN m.nx * n.nx + m.ny * n.ny + m.nz * n.nz < 0 THEN -1e0 ELSE 1e0 END AS turn, {_norm("m.nx", "m.ny", "m.nz")} > 0 AS has_n, zw > 0 AS has_z FROM mem m JOIN ref USING (root)),
agg AS (SELECT root, count(*) AS n_centers, max(mach) AS mach_peak, max(mm) AS mach_mean, sum(area) AS area, sum(total) AS total, sum(x * area) / sum(area) AS cx, sum(y * area) / sum(area) AS cy, sum(z * area) / sum(area) AS cz,
 sum(nx * area) / sum(area) AS ax, sum(ny * area) / sum(area) AS ay, sum(nz * area) / sum(area) AS az, min(x - dx / 2) AS xmin, max(x + dx / 2) AS xmax, min(y - dx / 2) AS ymin, max(y + dx / 2) AS ymax, min(z - dx / 2) AS zmin, max(z + dx / 2) AS zmax,
 min(level) AS level_min, max(level) AS level_max, CAST(count(DISTINCT level) AS INTEGER) AS level_count, sum(ut * area) / sum(area) AS ut, sum(ur * area) / sum(area) AS ur, coalesce(sum(CASE WHEN ut <= @external THEN area END), 0e0) / sum(area) AS ext,
 sqrt(sum((mach - mm) * (mach - mm) * area) / sum(area)) AS mach_std, sum(CASE WHEN has_n THEN area END) AS nw, sum(CASE WHEN has_n THEN nx * turn * area END) AS tx, sum(CASE WHEN has_n THEN ny * turn * area END) AS ty, sum(CASE WHEN has_n THEN nz * turn * area END) AS tz,
 coalesce(sum(CASE WHEN has_z THEN zw * area END) / sum(CASE WHEN has_z THEN area END), 0e0) AS zone_width_mean, coalesce(min(CASE WHEN has_z THEN zw END), 0e0) AS zone_width_min, coalesce(max(CASE WHEN has_z THEN zw END), 0e0) AS zone_width_max,
 concat('', max(CAST(x - dx / 2 <= x0 AS INT)), max(CAST(x + dx / 2 >= x1 AS INT)), max(CAST(y - dx / 2 <= y0 AS INT)), max(CAST(y + dx / 2 >= y1 AS INT)), max(CAST(z - dx / 2 <= z0 AS INT)), max(CAST(z + dx / 2 >= z1 AS INT))) AS faces,
 bool_or(x - dx / 2 <= x0 OR x + dx / 2 >= x1 OR y - dx / 2 <= y0 OR y + dx / 2 >= y1 OR z - dx / 2 <= z0 OR z + dx / 2 >= z1) AS touches_boundary FROM ori, region GROUP BY root),
grp AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY mach_peak DESC, cx, cy, cz, area DESC, root) - 1 AS group_id, {_norm("ax", "ay", "az")} AS al, CASE WHEN nw IS NULL THEN 1e0 ELSE 1 - least(greatest({_norm("tx / nw", "ty / nw", "tz / nw")}, 0e0), 1e0) END AS disp,
 CASE WHEN ext >= 8e-1 THEN 'external' WHEN ext <= 1 - 8e-1 THEN 'internal' ELSE 'mixed' END AS classification FROM agg),
flagged AS (SELECT *, concat_ws(';', CASE WHEN touches_boundary THEN 'touches_boundary' END, CASE WHEN n_centers < 2 THEN 'small_group' END, CASE WHEN disp > 3e-1 THEN 'normal_dispersion' END) AS flags FROM grp)"""

_MAP_WIDTH = (40, 24)


def _draw(source: str, h: str, v: str, value: str, weight: str = "1e0", where: str = "TRUE", statistic: str = "max", method: str = "amr", out=r6) -> str:
    nx, ny = _MAP_WIDTH
    if method == "point":
        fold = {"max": "max(val)", "mean": "sum(val * wt) / sum(wt)"}[statistic]
        return f"""
SELECT CAST(iy AS INTEGER) AS iy, CAST(ix AS INTEGER) AS ix, {out(fold)} AS value FROM (SELECT floor(({h} - a0) / (a1 - a0) * {nx}) AS ix, floor(({v} - b0) / (b1 - b0) * {ny}) AS iy, {value} AS val, {weight} AS wt FROM {source}, ext WHERE {where}) WHERE ix BETWEEN 0 AND {nx - 1} AND iy BETWEEN 0 AND {ny - 1} AND wt > 0 GROUP BY ALL"""
    fold = {"max": "max(val)", "mean": "sum(val * cover) / sum(cover)", "sum": "sum(val * cover) / any_value(pw * ph)"}[statistic]
    more = "" if statistic == "max" else "HAVING sum(cover) > 0"
    return f"""
SELECT CAST(iy AS INTEGER) AS iy, CAST(ix AS INTEGER) AS ix, {out(fold)} AS value FROM (SELECT *, greatest(least(hh + dx / 2, ix * pw + a0 + pw) - greatest(hh - dx / 2, ix * pw + a0), 0e0) * greatest(least(vv + dx / 2, iy * ph + b0 + ph) - greatest(vv - dx / 2, iy * ph + b0), 0e0) * wt AS cover
 FROM (SELECT *, unnest(range(iy0, iy1 + 1)) AS iy FROM (SELECT *, unnest(range(ix0, ix1 + 1)) AS ix FROM (SELECT hh, vv, dx, val, wt, a0, b0, pw, ph, CAST(greatest(floor((hh - dx / 2 - a0) / pw), 0) AS BIGINT) AS ix0, CAST(least(ceil((hh + dx / 2 - a0) / pw) - 1, {nx - 1}) AS BIGINT) AS ix1, CAST(greatest(floor((vv - dx / 2 - b0) / ph), 0) AS BIGINT) AS iy0, CAST(least(ceil((vv + dx / 2 - b0) / ph) - 1, {ny - 1}) AS BIGINT) AS iy1
 FROM (SELECT {h} AS hh, {v} AS vv, dx, {value} AS val, {weight} AS wt, a0, b0, (a1 - a0) / {nx} AS pw, (b1 - b0) / {ny} AS ph FROM {source}, ext WHERE {where}))))) GROUP BY iy, ix {more}"""


def _ext(h: str, v: str) -> str:
    return f", ext AS (SELECT min({h} - dx / 2) AS a0, max({h} + dx / 2) AS a1, min({v} - dx / 2) AS b0, max({v} + dx / 2) AS b1 FROM c)"


_FRONT = ", front AS MATERIALIZED (SELECT *, " + _norm("nx", "ny", "nz") + " > 0 AS valid_normal FROM dis WHERE mach >= 18e-1 AND flux > 0)"
_TRACK = """, trk AS (SELECT k AS galaxy_id, cx - ((k % 5) - 2) AS px, cy - 1e0 AS py, cz AS pz, cx, cy, cz FROM (SELECT CAST(c_custkey AS BIGINT) AS k, CAST((c_custkey * 17) % s AS DOUBLE) AS cx, CAST((c_custkey * 29) % s AS DOUBLE) AS cy, CAST((c_custkey * 43) % s AS DOUBLE) AS cz FROM customer, side)),
hits AS (SELECT galaxy_id, f.row_id, """ + _norm("f.x - cx", "f.y - cy", "f.z - cz") + """ AS far FROM trk JOIN front f ON f.x BETWEEN cx - 3 AND cx + 3 AND f.y BETWEEN cy - 3 AND cy + 3 AND f.z BETWEEN cz - 3 AND cz + 3),
nearest AS MATERIALIZED (SELECT galaxy_id, row_id, far FROM hits WHERE far <= 3 QUALIFY row_number() OVER (PARTITION BY galaxy_id ORDER BY far, row_id) = 1)"""


#: Components' covariances, the largest eigenvalue by the cosine formula, its vector as the longest cross product of two rows of A - l1, and the span along it.
_AXES = """,
pt AS (SELECT f.*, comp AS root FROM front f JOIN fc ON fc.id = f.row_id),
ctr AS (SELECT root, count(*) AS size, sum(flux) AS flux, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM pt GROUP BY root),
cv AS (SELECT root, any_value(size) AS size, any_value(ctr.flux) AS flux, sum((x - mx) * (x - mx)) AS a, sum((x - mx) * (y - my)) AS b, sum((x - mx) * (z - mz)) AS c, sum((y - my) * (y - my)) AS d, sum((y - my) * (z - mz)) AS e, sum((z - mz) * (z - mz)) AS f
 FROM pt JOIN ctr USING (root) GROUP BY root),
e0 AS (SELECT *, (a + d + f) / 3 AS q FROM cv),
e1 AS (SELECT *, sqrt(((a - q) * (a - q) + (d - q) * (d - q) + (f - q) * (f - q) + 2 * (b * b + c * c + e * e)) / 6) AS p FROM e0),
e2 AS (SELECT *, CASE WHEN p > 0 THEN acos(least(greatest(((a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - e * c) + c * (b * e - (d - q) * c)) / (2 * p * p * p), -1e0), 1e0)) / 3 ELSE 0e0 END AS phi FROM e1),
e3 AS (SELECT *, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi - 2 * pi() / 3) AS l2 FROM e2),
e4 AS (SELECT *, CASE WHEN l1 > 0 THEN (l1 - l2) / l1 ELSE 0e0 END AS gap, b * e - c * (d - l1) AS ux, c * b - (a - l1) * e AS uy, (a - l1) * (d - l1) - b * b AS uz,
 b * (f - l1) - c * e AS vx, c * c - (a - l1) * (f - l1) AS vy, (a - l1) * e - b * c AS vz, (d - l1) * (f - l1) - e * e AS wx, e * c - b * (f - l1) AS wy, b * e - (d - l1) * c AS wz FROM e3),
e5 AS (SELECT *, ux * ux + uy * uy + uz * uz AS uu, vx * vx + vy * vy + vz * vz AS vv, wx * wx + wy * wy + wz * wz AS ww FROM e4),
ax AS (SELECT root, size, flux, gap, sqrt(greatest(uu, vv, ww)) AS len, CASE WHEN uu >= vv AND uu >= ww THEN ux WHEN vv >= ww THEN vx ELSE wx END AS ax, CASE WHEN uu >= vv AND uu >= ww THEN uy WHEN vv >= ww THEN vy ELSE wy END AS ay, CASE WHEN uu >= vv AND uu >= ww THEN uz WHEN vv >= ww THEN vz ELSE wz END AS az FROM e5),
span AS MATERIALIZED (SELECT root, any_value(size) AS size, any_value(ax.flux) AS flux, any_value(gap) AS gap, max((x * ax + y * ay + z * az) / len) - min((x * ax + y * ay + z * az) / len) AS extent FROM pt JOIN ax USING (root) GROUP BY root)"""


def _per_cell(area: str) -> str:
    """Every retained cell; magnitudes as logarithms but just above Mach 1, where the efficiency cancels."""
    strong = lambda v: lg(f"CASE WHEN mach >= 102e-2 THEN {v} ELSE 0e0 END")
    zero = lambda v: f"coalesce({v}, 0e0)"
    return f"""SELECT row_id, {r6(zero('flux / 1e38'))} AS flux, {strong('flux')} AS lg_flux, {strong(f'flux * {area}')} AS lg_total, {lg(zero(f'{area} * 1e33'))} AS lg_area, {r6(zero('eff'))} AS efficiency, {r6(zero('cs / 1e5'))} AS sound_speed
FROM (SELECT c.row_id, d.* EXCLUDE (row_id) FROM c LEFT JOIN dis d ON d.row_id = c.row_id)"""


def sql() -> dict[str, str]:
    lattice_u, lattice = _UNIFORM + _LATTICE, _TWO + _LATTICE
    st_u, st = lattice_u + _SAMPLES + _stencil(), lattice + _SAMPLES + _stencil()
    cen = st + _centers()
    sho = cen + _shocks()
    dis = sho + _dissipation()
    ctl = dis + _catalog()
    q = lambda base, tail: f"WITH RECURSIVE {base.lstrip()}\n{tail}"
    links = lambda kind: f"SELECT row_id, face, slot, nbr_id FROM links WHERE kind = '{kind}'"
    front = dis + _FRONT
    comp = front + f", fe AS MATERIALIZED (SELECT p.row_id AS a, q.row_id AS b FROM front p JOIN front q ON p.row_id <> q.row_id AND q.x BETWEEN p.x - 2 AND p.x + 2 AND q.y BETWEEN p.y - 2 AND p.y + 2 AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) <= 18e-1 * 18e-1){_component('fc', 'front', 'fe')}"
    exact = "group_id, n_centers, level_min, level_max, level_count, classification, touches_boundary, NOT touches_boundary AS is_complete"
    names = {"mach_peak": "mach_peak", "mach_mean": "mach_mean", "centroid_x": "cx", "centroid_y": "cy", "centroid_z": "cz", "normal_x": "CASE WHEN al > 0 THEN ax / al ELSE 0e0 END", "normal_y": "CASE WHEN al > 0 THEN ay / al ELSE 0e0 END", "normal_z": "CASE WHEN al > 0 THEN az / al ELSE 0e0 END", "xmin": "xmin", "xmax": "xmax", "ymin": "ymin", "ymax": "ymax", "zmin": "zmin", "zmax": "zmax", "external_fraction": "ext", "valid_upstream_fraction": "1e0", "classification_confidence": "greatest(ext, 1 - ext)", "mach_std": "mach_std", "normal_dispersion": "disp", "zone_width_mean": "zone_width_mean", "zone_width_min": "zone_width_min", "zone_width_max": "zone_width_max"}
    summary = f"SELECT {exact}, {', '.join(f'{r6(v)} AS {k}' for k, v in names.items())}, {lg('area * 1e33')} AS lg_area, {r6('total / 1e5')} AS dissipation, {lg('ut')} AS lg_temperature, {lg('ur')} AS lg_density, flags"
    groups = f"{summary}, root, faces FROM flagged"
    counters = (
        ("center_step_limit", "SELECT n FROM far"),
        ("upstream_missing_neighbor", "SELECT count(*) FROM upend WHERE reason = 'missing'"), ("upstream_step_limit", "SELECT count(*) FROM upend WHERE reason = 'go'"),
        ("downstream_missing_neighbor", "SELECT count(*) FROM downend WHERE reason = 'missing'"), ("downstream_step_limit", "SELECT count(*) FROM downend WHERE reason = 'go'"),
        *((f"{k}_exit", f"SELECT count(*) FROM (SELECT reason FROM upend UNION ALL SELECT reason FROM downend) WHERE reason = '{k}'") for k in ("candidate", "thermodynamic", "nonconverging")),
        ("invalid_jump", "SELECT count(*) FROM judged WHERE mach IS NULL"), ("mach_rejected", "SELECT count(*) FROM judged WHERE mach < @floor * (1 - 1e-12)"),
    )
    diagnostics = lambda floor: " UNION ALL ".join(f"SELECT '{name}' AS name, CAST(({count}) AS BIGINT) AS n" for name, count in counters).replace("@floor", floor)
    limited = cen + _long_paths(1) + _shocks(2, "15e-1")
    grid = "m AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_partkey / 100 + 1e0 AS mach FROM part)"
    t_jump = f"((2 * {G} * mach * mach - ({G} - 1)) * (({G} - 1) * mach * mach + 2) / (mach * mach * ({G} + 1) * ({G} + 1)))"
    r_jump = f"(({G} + 1) * mach * mach / (({G} - 1) * mach * mach + 2))"
    eff = f"CASE WHEN mach > 1 THEN greatest(2e0 / ({G} * ({G} - 1) * mach * mach * {r_jump}) * ((2 * {G} * mach * mach - ({G} - 1)) / ({G} + 1) - pow({r_jump}, {G})), 0e0) ELSE 0e0 END"
    sweep_base, sweep = st_u + _centers() + _shocks() + _dissipation(), []
    for i, (t, n) in enumerate((a, b) for a in ("1e-1", "5e-1") for b in ("5e-1", "9e-1")):
        sweep_base += _catalog(t, n, "8e-1", "13e-1", f"_{i}")
        sweep.append(f"SELECT {t} AS mach_tolerance, {n} AS normal_cosine, 8e-1 AS duplicate_normal_cosine, 13e-1 AS min_mach, (SELECT count(*) FROM sel_{i}) AS n_input_centers, (SELECT count(*) FROM kept_{i}) AS n_representative_centers, count(DISTINCT root) AS n_groups, {lg('sum(area) * 1e33')} AS lg_area, {lg('sum(total)')} AS lg_dissipation, {r6('max(mach)')} AS mach_peak, {r6('sum(mach * area) / sum(area)')} AS mach_mean FROM mem_{i}")
    xy, xz, yz = (dis + _ext(*p) for p in (("x", "y"), ("x", "z"), ("y", "z")))
    unit = "least(greatest((lv - lo) / (CASE WHEN hi <= lo THEN 1e0 ELSE hi - lo END), 0e0), 1e0)"
    edges = [1.2, 1.5, 2.0, 2.5, 3.0, 4.0, 6.0]
    bins = lambda e: "(VALUES " + ", ".join(f"({k}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), {k == len(e) - 2})" for k, (a, b) in enumerate(zip(e, e[1:], strict=False))) + ") b(bin, lo, hi, is_last)"
    inside = "log10(mach) >= log10(lo) AND (log10(mach) < log10(hi) OR (is_last AND log10(mach) = log10(hi)))"
    signed = {k: f"(({k}x - f.x) * f.nx + ({k}y - f.y) * f.ny + ({k}z - f.z) * f.nz)" for k in "pc"}
    mid = {a: f"((p{a} + c{a}) / 2 - f.{a})" for a in "xyz"}
    along = "(" + " + ".join(f"{mid[a]} * f.n{a}" for a in "xyz") + ")"
    side = _norm(*(f"{mid[a]} - {along} * f.n{a}" for a in "xyz"))
    classes = _TRACK + f", cls AS MATERIALIZED (SELECT t.galaxy_id, coalesce(f.valid_normal, FALSE) AS near_shock, coalesce(f.valid_normal AND {signed['p']} * {signed['c']} <= 0 AND {side} <= 2 * f.dx, FALSE) AS crossed, coalesce(f.row_id, -1) AS nearest_shock_row, f.mach, n.far, {signed['p']} AS sp, {signed['c']} AS sc, {side} AS tr FROM trk t LEFT JOIN nearest n USING (galaxy_id) LEFT JOIN front f ON f.row_id = n.row_id)"
    crossing = front + classes
    large = comp + _AXES + """,
nums AS (SELECT comp, row_number() OVER (ORDER BY comp) - 1 AS component_id FROM (SELECT DISTINCT comp FROM fc)),
large AS MATERIALIZED (SELECT f.*, component_id, size AS component_size, CASE WHEN gap < 1e-6 THEN -1e0 ELSE extent END AS component_extent, span.flux AS component_flux
 FROM front f JOIN fc ON fc.id = f.row_id JOIN span ON span.root = comp JOIN nums USING (comp) WHERE size >= 5)"""
    kept = {"all": "TRUE", "column": "near_shock AND far < 15e-1", "crossed": "crossed", "near_or_crossed": "near_shock OR crossed", "near_shock": "near_shock"}
    none = lambda c, n: f"{r6(f'coalesce({c}, -999e0)')} AS {n}"
    return {
        "cells_level_filter": q(_TWO, "SELECT row_id, level FROM c WHERE level >= 1"),
        "cells_detection_mask": q(_TWO, "SELECT row_id, level, t >= 3e5 AND rho >= 2e6 AND rho <= 4e6 AS mask FROM c"),
        "cells_box": q(_TWO, "SELECT row_id FROM c WHERE abs(x - 10) <= 6 AND abs(y - 12) <= 6 AND abs(z - 14) <= 6"),
        "lattice_coords": q(lattice, "SELECT row_id, w, lx, ly, lz FROM l"),
        "links_same": q(lattice_u, links("same")),
        "links_coarse": q(lattice, links("coarse")),
        "links_fine": q(lattice, links("fine")),
        "face_samples": q(lattice + _SAMPLES, f"SELECT row_id, face, {r6('coalesce(p, -1e0)')} AS p, {r6('v')} AS v, {r6('t')} AS t, {r6('s')} AS s FROM samples"),
        "stencil_divergence": q(st_u, f"SELECT row_id, {r6('divv')} AS divv, valid, {', '.join(f'{r6(f"gt{a} / 1e6")} AS gt{a}, {r6(f"gs{a}0")} AS gs{a}' for a in 'xyz')} FROM st"),
        "candidates": q(st, "SELECT row_id FROM st WHERE candidate"),
        "center_next": q(cen, "SELECT row_id, next_id FROM nextid"),
        "shock_centers": q(cen, "SELECT row_id FROM center"),
        "walk_endpoints": q(sho, "SELECT u.center AS row_id, replace(u.reason, 'go', 'step_limit') AS upstream_reason, u.here AS upstream, coalesce(replace(d.reason, 'go', 'step_limit'), 'none') AS downstream_reason, coalesce(d.here, -1) AS downstream FROM upend u LEFT JOIN downend d ON d.center = u.center"),
        "walk_diagnostics": q(cen + _long_paths(50) + _shocks(), diagnostics("1")),
        "walk_diagnostics_limited": q(limited, diagnostics("15e-1")),
        "shocks_limited": q(limited, f"SELECT row_id, {r6('mach')} AS mach, ui AS upstream_index, di AS downstream_index FROM shock"),
        "shocks": q(sho, f"SELECT row_id, {r6('mach')} AS mach, ui AS upstream_index, di AS downstream_index, {r6('nx')} AS nx, {r6('ny')} AS ny, {r6('nz')} AS nz, level, {r6('zw')} AS zone_width FROM shock"),
        "jump_relations": f"WITH {grid} SELECT id, {r6(t_jump)} AS temperature_ratio, {r6(r_jump)} AS density_ratio, {r6('mach')} AS mach_back, {r6('mach')} AS mach_closed FROM m",
        "efficiency_curve": f"WITH {grid} SELECT id, {r6(eff)} AS efficiency FROM m",
        "upstream_state": q(sho, f"SELECT row_id, {r6('ut')} AS up_temp, {r6('ur')} AS up_rho FROM shock"),
        "dissipation": q(dis, _per_cell("area")),
        "dissipation_cell_area": q(dis, _per_cell(f"((dx / {KPC_IN_KM!r}) * (dx / {KPC_IN_KM!r}))")),
        "center_representatives": q(ctl, "SELECT c.row_id, coalesce(representative, -1) AS center_representative FROM c LEFT JOIN rep USING (row_id)"),
        "group_labels": q(ctl, "SELECT row_id, root FROM mem"),
        "shock_groups": q(ctl, groups),
        "group_quality_flags": q(ctl, "SELECT root, unnest(string_split(flags, ';')) AS flag FROM flagged WHERE flags <> ''"),
        "group_preview": q(ctl, f"SELECT group_id, n_centers, {r6('mach_peak')} AS mach_peak FROM grp WHERE group_id < 10"),
        "quality_summary": q(ctl, f"SELECT count(*) AS n_groups, count(*) FILTER (NOT touches_boundary) AS n_complete, count(*) FILTER (touches_boundary) AS n_boundary, {lg('sum(area) * 1e33')} AS lg_area, {lg('sum(total)')} AS lg_dissipation FROM grp"),
        "quality_counts": q(ctl, "SELECT 'classification' AS kind, classification AS name, count(*) AS n FROM flagged GROUP BY ALL UNION ALL SELECT 'flag', flag, count(*) FROM (SELECT unnest(string_split(flags, ';')) AS flag FROM flagged WHERE flags <> '') GROUP BY ALL"),
        "analysis_counts": q(ctl, "SELECT 'retained' AS name, count(*) AS n FROM c UNION ALL SELECT 'shock', count(*) FROM shock UNION ALL SELECT 'representative', count(*) FROM kept UNION ALL SELECT 'groups', count(*) FROM grp"),
        "shock_summary": q(dis, f"SELECT (SELECT count(*) FROM c) AS retained_cells, (SELECT count(*) FROM c) AS selected_cells, (SELECT count(*) FROM shock) AS shock_cells, (SELECT count(*) FROM shock) AS mach_positive, (SELECT count(*) FROM shock WHERE mach >= 15e-1) AS mach_above_1_5, count(*) FILTER (flux > 0) AS flux_positive, count(*) FILTER (total > 0) AS total_positive, {r6('max(mach)')} AS max_mach, {lg('max(flux)')} AS lg_max_flux, {lg('max(total)')} AS lg_max_total FROM dis"),
        "sensitivity_sweep": q(sweep_base, " UNION ALL ".join(sweep)),
        "map_extent": q(_TWO, " UNION ALL ".join(f"SELECT '{h}{v}' AS plane, min({h} - dx / 2) AS xmin, max({h} + dx / 2) AS xmax, min({v} - dx / 2) AS ymin, max({v} + dx / 2) AS ymax FROM c" for h, v in ("xy", "xz", "yz"))),
        "mach_map_max": q(sho + _ext("x", "y"), _draw("shock", "x", "y", "mach")),
        "mach_map_mean": q(xy, _draw("dis", "x", "y", "mach", "total", statistic="mean")),
        "mach_map_sum": q(sho + _ext("x", "y"), _draw("shock", "x", "y", "mach", statistic="sum")),
        "mach_map_slab": q(sho + _ext("x", "z"), _draw("shock", "x", "z", "mach", where="abs(y - 12) <= 5")),
        "diss_map": q(yz, _draw("dis", "y", "z", "flux", where="flux > 0", out=lambda c: r6(f"({c}) / 1e38"))),
        "point_map_max": q(sho + _ext("x", "y"), _draw("shock", "x", "y", "mach", method="point")),
        "point_map_mean": q(xy, _draw("dis", "x", "y", "mach", "total", statistic="mean", method="point")),
        "map_normalized": q(xy + f", px AS ({_draw('dis', 'x', 'y', 'flux', where='flux > 0', out=str)}), lim AS (SELECT min(log10(value)) AS lo, max(log10(value)) AS hi FROM px)", f"SELECT iy, ix, {r6(f'asinh({unit} * 4) / asinh(4e0)')} AS value FROM (SELECT iy, ix, log10(value) AS lv, lo, hi FROM px, lim)"),
        "map_dense": q(sho + _ext("x", "y") + f", px AS ({_draw('shock', 'x', 'y', 'mach', out=str)})", f"SELECT CAST(a AS INTEGER) AS iy, CAST(b AS INTEGER) AS ix, {r6('coalesce(value, -1e0)')} AS value FROM (SELECT unnest(range(24)) AS a) CROSS JOIN (SELECT unnest(range(40)) AS b) LEFT JOIN px ON iy = a AND ix = b"),
        "mach_distribution": q(dis, f"SELECT bin, {lg('coalesce(sum(total), 0e0) / any_value(log10(hi) - log10(lo))')} AS value FROM {bins(edges)} LEFT JOIN dis ON total > 0 AND mach >= 12e-1 AND {inside} GROUP BY bin"),
        "surface_histogram": q(sho, f"SELECT bin, {r6('coalesce(sum(dx * dx * 119e-2), 0e0) / any_value(log10(hi) - log10(lo))')} AS value FROM {bins([1.5, 2.0, 3.0, 4.0, 6.0])} LEFT JOIN shock ON mach >= 15e-1 AND {inside} GROUP BY bin"),
        "external_internal": q(sho, "SELECT c.row_id, coalesce(ut <= 2e5, FALSE) AS external, coalesce(ut > 2e5, FALSE) AS internal FROM c LEFT JOIN (SELECT * FROM shock WHERE mach >= 15e-1) s USING (row_id)"),
        "front_catalog": q(front, f"SELECT row_id, {r6('mach')} AS mach, {lg('flux')} AS lg_flux, {r6('nx')} AS nx, {r6('ny')} AS ny, {r6('nz')} AS nz, valid_normal FROM front"),
        "front_components": q(comp, "SELECT id AS row_id, comp AS root FROM fc"),
        "track_nearest_front": q(front + _TRACK, f"SELECT galaxy_id, coalesce(row_id, -1) AS front, {r6('coalesce(far, -1e0)')} AS far FROM trk LEFT JOIN nearest USING (galaxy_id)"),
        "track_crossing": q(crossing, f"SELECT galaxy_id, crossed, near_shock, nearest_shock_row, {none('mach', 'nearest_mach')}, {none('far', 'distance_to_shock')}, {none('sp', 'signed_distance_prev')}, {none('sc', 'signed_distance_now')}, {none('tr', 'transverse_distance')} FROM cls"),
        "track_compact": q(crossing, "SELECT galaxy_id AS galaxy_index, (SELECT count(*) FROM cls) AS n_galaxies, nearest_shock_row FROM cls WHERE crossed"),
        "track_crossing_large": q(
            large + classes.replace(" front f", " large f"),
            "SELECT galaxy_id, cls.crossed, near_shock, nearest_shock_row, coalesce(CASE WHEN near_shock THEN component_id END, -1) AS nearest_component_id, coalesce(CASE WHEN near_shock THEN component_size END, -1) AS nearest_component_size, "
            f"{none('CASE WHEN near_shock THEN component_extent END', 'nearest_component_extent')}, {none('cls.mach', 'nearest_mach')}, {lg('coalesce(CASE WHEN near_shock THEN large.flux END, 0e0)')} AS lg_flux, "
            f"{none('far', 'distance_to_shock')}, {none('sp', 'signed_distance_prev')}, {none('sc', 'signed_distance_now')}, {none('tr', 'transverse_distance')} FROM cls LEFT JOIN large ON large.row_id = nearest_shock_row",
        ),
        "track_compact_modes": q(crossing, " UNION ALL ".join(f"SELECT '{k}' AS keep, galaxy_id AS galaxy_index, (SELECT count(*) FROM cls) AS n_galaxies, near_shock, nearest_shock_row FROM cls WHERE {w}" for k, w in kept.items())),
        "front_large_all": q(large, f"SELECT row_id, component_id, component_size, {r6('component_extent')} AS component_extent, {lg('component_flux')} AS lg_component_flux FROM large"),
        "links_direct": q(lattice, "SELECT row_id, face, kind, slot, nbr_id FROM links WHERE kind <> 'fine'"),
        "maps_both": q(xy, f"SELECT 'mach' AS kind, * FROM ({_draw('shock', 'x', 'y', 'mach')}) UNION ALL SELECT 'flux', * FROM ({_draw('dis', 'x', 'y', 'flux', where='flux > 0', out=lambda c: r6(f'({c}) / 1e38'))})"),
        "catalog_roundtrip": q(ctl, groups),
        "catalog_csv": q(ctl, f"{summary}, 'kpc2' AS area_unit FROM flagged"),
        "catalog_v1_upgrade": q(ctl, f"SELECT group_id, '000000' AS faces, FALSE AS touches_boundary, CASE WHEN ut IS NOT NULL AND NOT isnan(ut) THEN 1e0 ELSE 0e0 END AS valid_upstream_fraction, {r6('greatest(ext, 1 - ext)')} AS classification_confidence, TRUE AS mach_std_unknown, TRUE AS normal_dispersion_unknown, 0e0 AS zone_width_mean, 0e0 AS zone_width_min, 0e0 AS zone_width_max, level_max - level_min + 1 AS level_count, FALSE AS is_complete, 'legacy_schema' AS flags FROM grp"),
        "neighbor_cache": q(lattice, "SELECT row_id, face, kind, slot, nbr_id FROM links"),
        "front_extent": q(comp + _AXES, f"SELECT root, size, {lg('flux')} AS lg_flux, {r6('CASE WHEN size = 1 THEN 0e0 WHEN gap < 1e-6 THEN -1e0 ELSE extent END')} AS extent FROM span"),
        "front_large": q(comp + _AXES, "SELECT fc.id AS row_id, size AS component_size FROM fc JOIN span ON root = comp WHERE size >= 5 AND gap >= 1e-6 AND extent >= 2"),
        "retained_rank": q(_TWO, "SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS rank FROM c"),
        "levels_inferred": q(_TWO, "SELECT row_id, CAST(round(log2((SELECT max(dx) FROM c) / dx)) AS INTEGER) AS level FROM c"),
        "groups_without_dissipation": q(ctl, f"SELECT root, count(*) AS n_centers, {r6('sum(area * (' + repr(KPC_IN_KM) + ' * ' + repr(KPC_IN_KM) + '))')} AS area, {r6('sum(mach * area) / sum(area)')} AS mach_mean, 'position_unit2' AS area_unit FROM mem GROUP BY root"),
    }
