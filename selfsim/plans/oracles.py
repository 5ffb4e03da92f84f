"""SQL of whole filters: search, transform, shrinkage, inverse, weighted sums, over planes z(n, ch, y, x, v).

It follows the definitions step by step, with joins in place of the batched numpy kernels, and is what their rows are compared with.
"""

from __future__ import annotations

from collections.abc import Sequence

from selfsim.operators.grid import positions
from selfsim.operators.transforms import basis_sql, dct, haar

#: Fixed values, as in the filters: the hard threshold in sigmas, the flat-patch bounds, the unguided divisor's pieces are theirs.
LAMBDA = 2.7
#: Frames of the one chunk that the volume's SQL reads.
MOST_FRAMES = 32


def refs_sql(name: str, planes: str, h: int, w: int, b: int, step: int) -> str:
    """name(n, ref, ry, rx) for the frames of planes."""
    at = [(i * len(xs) + j, y, x) for xs in [positions(w, b, step)] for i, y in enumerate(positions(h, b, step)) for j, x in enumerate(xs)]
    return f"{name} AS (SELECT n, v.* FROM (SELECT DISTINCT n FROM {planes}), (VALUES {', '.join(map(str, at))}) v(ref, ry, rx))"


def blocks_sql(name: str, planes: str, h: int, w: int, b: int) -> str:
    """name(n, ch, y, x, p): the block of every position."""
    return f"{name} AS (SELECT n, ch, y - i.range // {b} AS y, x - i.range % {b} AS x, list(v ORDER BY i.range) AS p FROM {planes}, range({b * b}) i WHERE y - i.range // {b} BETWEEN 0 AND {h - b} AND x - i.range % {b} BETWEEN 0 AND {w - b} GROUP BY ALL)"


def ssd_sql(b: int) -> str:
    return f"list_sum(list_transform(range(1, {b * b + 1}), lambda i: (a.p[i] - b.p[i]) * (a.p[i] - b.p[i])))"


def match_sql(name: str, refs: str, blocks: str, b: int, lo: int, hi: int, k: int, radius: int = 0, ps_num: int = 2, ps_range: int = 4, every: bool = False) -> list[str]:
    """name(n, ref, k, t, y, x, dist), by channel 0 of blocks. every: the same window in all frames within the radius, without prediction."""
    near = lambda frames: f"(SELECT r.n, ref, ry, rx, b.n AS t, b.y, b.x, {ssd_sql(b)} AS dist FROM {refs} r JOIN {blocks} a ON a.n = r.n AND a.ch = 0 AND a.y = ry AND a.x = rx JOIN {blocks} b ON b.ch = 0 AND b.n BETWEEN r.n - {frames} AND r.n + {frames} AND b.y BETWEEN ry - {lo} AND ry + {hi} AND b.x BETWEEN rx - {lo} AND rx + {hi})"
    own = "t = n AND y = ry AND x = rx"
    out = [f"{name}_0 AS (SELECT *, CASE WHEN {own} THEN -1 ELSE dist END AS d FROM {near(radius if every else 0)})"]
    parts = [f"SELECT n, ref, ry, rx, t, y, x, dist, d FROM {name}_0"]
    if radius and not every:
        out.append(f"{name}_s AS (SELECT n, ref, ry, rx, t, y, x FROM (SELECT *, row_number() OVER (PARTITION BY n, ref ORDER BY d, y, x) AS r FROM {name}_0) WHERE r <= {ps_num})")
        for step, side in ((-1, "p"), (1, "f")):
            last = f"{name}_s"
            for i in range(1, radius + 1):
                out.append(f"{name}_{side}{i} AS (SELECT g.*, {ssd_sql(b)} AS dist FROM (SELECT DISTINCT s.n, ref, ry, rx, c.n AS t, c.y, c.x FROM {last} s JOIN {blocks} c ON c.ch = 0 AND c.n = s.t + {step} AND c.y BETWEEN s.y - {ps_range} AND s.y + {ps_range} AND c.x BETWEEN s.x - {ps_range} AND s.x + {ps_range}) g JOIN {blocks} a ON a.n = g.n AND a.ch = 0 AND a.y = ry AND a.x = rx JOIN {blocks} b ON b.ch = 0 AND b.n = g.t AND b.y = g.y AND b.x = g.x)")
                out.append(f"{name}_{side}{i}s AS (SELECT n, ref, ry, rx, t, y, x FROM (SELECT *, row_number() OVER (PARTITION BY n, ref ORDER BY dist, y, x) AS r FROM {name}_{side}{i}) WHERE r <= {ps_num})")
                parts.append(f"SELECT n, ref, ry, rx, t, y, x, dist, dist FROM {name}_{side}{i}")
                last = f"{name}_{side}{i}s"
    out.append(f"{name} AS (SELECT n, ref, CAST(r - 1 AS INT) AS k, t, y, x, CASE WHEN r = 1 THEN 0 ELSE dist END AS dist FROM (SELECT *, row_number() OVER (PARTITION BY n, ref ORDER BY d, t, y, x) AS r FROM ({' UNION ALL '.join(parts)})) WHERE r <= {k})")
    return out


def separable(source: str, out: str, basis: str, b: int, keys: str, inverse: bool = False) -> list[str]:
    """out(keys, i, v): the two-dimensional transform of source(keys, i, v), i = b y + x."""
    of, to = ("k", "i") if inverse else ("i", "k")
    return [
        f"{out}_h AS (SELECT {keys}, s.i // {b} AS r, t.{to} AS u, sum(t.b * s.v) AS v FROM {source} s JOIN {basis} t ON t.{of} = s.i % {b} GROUP BY ALL)",
        f"{out} AS (SELECT {keys}, t.{to} * {b} + s.u AS i, sum(t.b * s.v) AS v FROM {out}_h s JOIN {basis} t ON t.{of} = s.r GROUP BY ALL)",
    ]


def along(source: str, out: str, basis: str, keys: str, inverse: bool = False) -> str:
    """The transform along k of source(keys, k, i, v)."""
    of, to = ("k", "i") if inverse else ("i", "k")
    return f"{out} AS (SELECT {keys}, t.{to} AS k, s.i, sum(t.b * s.v) AS v FROM {source} s JOIN {basis} t ON t.{of} = s.k GROUP BY ALL)"


def bm3d_stage(tag: str, source: str, guide: str | None, sigmas: Sequence[float], h: int, w: int, b: int = 8, step: int = 8, rng: int = 9, k: int = 8, radius: int = 0, ps_num: int = 2, ps_range: int = 4) -> list[str]:
    """tag_out(n, ch, y, x, v): a stage of the collaborative filter; with a guide the Wiener stage. sigmas by channel, as fractions of full scale."""
    on, keys = guide or source, "n, ref, ch"
    sigma = "CASE ch " + " ".join(f"WHEN {c} THEN {s!r}" for c, s in enumerate(sigmas)) + " END"
    parts = [refs_sql(f"{tag}_r", on, h, w, b, step), blocks_sql(f"{tag}_g", on, h, w, b)]
    parts += match_sql(f"{tag}_m", f"{tag}_r", f"{tag}_g", b, rng, rng, k, radius, ps_num, ps_range)

    def coefficients(name: str, planes: str) -> list[str]:
        took = f"{name}_p AS (SELECT m.n, m.ref, z.ch, m.k, i.range AS i, z.v FROM {tag}_m m, range({b * b}) i, {planes} z WHERE z.n = m.t AND z.y = m.y + i.range // {b} AND z.x = m.x + i.range % {b})"
        return [took, *separable(f"{name}_p", f"{name}_c", f"dct{b}", b, keys + ", s.k"), along(f"{name}_c", f"{name}_t", f"haar{k}", keys)]

    parts += coefficients(f"{tag}_s", source)
    first = "(k = 0 AND i = 0)"
    if guide is None:
        parts.append(f"{tag}_z AS (SELECT {keys}, k, i, CASE WHEN {first} OR abs(v) >= {LAMBDA} * ({sigma}) THEN 1.0 ELSE 0.0 END AS g, v FROM {tag}_s_t)")
        weight = "1.0 / greatest(sum(g), 1)"
    else:
        parts += coefficients(f"{tag}_b", guide)
        parts.append(f"{tag}_z AS (SELECT s.n, s.ref, s.ch, s.k, s.i, CASE WHEN s.k = 0 AND s.i = 0 THEN 1.0 ELSE b.v * b.v / (b.v * b.v + pow({sigma.replace('CASE ch', 'CASE s.ch')}, 2)) END AS g, s.v FROM {tag}_s_t s JOIN {tag}_b_t b USING (n, ref, ch, k, i))")
        weight = "1.0 / greatest(sum(g * g), 1e-12)"
    parts += [f"{tag}_w AS (SELECT {keys}, {weight} AS w FROM {tag}_z GROUP BY ALL)", f"{tag}_y AS (SELECT {keys}, k, i, g * v AS v FROM {tag}_z)", along(f"{tag}_y", f"{tag}_u", f"haar{k}", keys, True)]
    parts += separable(f"{tag}_u", f"{tag}_e", f"dct{b}", b, keys + ", s.k", True)
    parts.append(f"{tag}_a AS (SELECT m.t AS n, e.ch, m.y + e.i // {b} AS y, m.x + e.i % {b} AS x, sum(w * e.v) AS num, sum(w) AS den FROM {tag}_e e JOIN {tag}_m m USING (n, ref, k) JOIN {tag}_w w USING (n, ref, ch) GROUP BY ALL)")
    parts.append(f"{tag}_out AS (SELECT z.n, z.ch, z.y, z.x, CASE WHEN den > 1e-12 THEN num / den ELSE z.v END AS v FROM {source} z LEFT JOIN {tag}_a a USING (n, ch, y, x))")
    return parts


def once(source: str, parts: Sequence[str]) -> str:
    """The WITH list, each part computed once however often it is read."""
    return ", ".join([source, *(p.replace(" AS (SELECT", " AS MATERIALIZED (SELECT", 1) for p in parts)])


def rows(out: str) -> str:
    return f" SELECT CAST(n AS BIGINT) AS n, CAST(ch AS BIGINT) AS channel, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(v, 6) + 0.0 AS v FROM {out}"


def bm3d_sql(source: str, sigmas: Sequence[float], h: int, w: int, final: bool = False, radius: int = 0, b: int = 8, step: int = 8, rng: int = 9, k: int = 8) -> str:
    """The rows of the filter; source ends in z(n, ch, y, x, v). sigmas in 8-bit units."""
    own, shape = [0.75 * s / 255 for s in sigmas], {"b": b, "step": step, "rng": rng, "k": k}
    parts = [basis_sql(f"dct{b}", dct(b)), basis_sql(f"haar{k}", haar(k)), *bm3d_stage("a", "z", None, own, h, w, radius=0 if final else radius, **shape)]
    if final:
        parts += bm3d_stage("b", "z", "a_out", own, h, w, radius=radius, **shape)
    return once(source, parts) + rows("b_out" if final else "a_out")


def pnlm_sql(source: str, sigma: float, h: int, w: int, d: int = 1, a: int = 2, p: int = 6, k: int = 16) -> str:
    s = sigma / 255
    tent = "(1 - abs(2 * {0} + 1 - %d) / %d.0)" % (p, p)
    parts = [refs_sql("r", "z", h, w, p, p // 2), blocks_sql("g", "z", h, w, p), *match_sql("m", "r", "g", p, a, a, k, d, every=True)]
    parts += [
        f"q AS (SELECT m.n, ref, m.k, i.range AS i, z.v, CASE WHEN m.k = 0 THEN 1.0 ELSE exp(-greatest(dist / {p * p}.0 - {2 * s * s!r}, 0) / {4 * s * s!r}) END AS w FROM m, range({p * p}) i, z WHERE z.n = m.t AND z.y = m.y + i.range // {p} AND z.x = m.x + i.range % {p})",
        f"f AS (SELECT n, ref, avg(v) AS mean, least(1, greatest(0, (1.6 - var_pop(v) / {s * s!r}) / 0.7)) AS alpha FROM q GROUP BY ALL)",
        "e AS (SELECT n, ref, i, alpha * any_value(mean) + (1 - alpha) * (sum(w * v) / sum(w)) AS v FROM q JOIN f USING (n, ref) GROUP BY n, ref, i, alpha)",
        f"s AS (SELECT e.n, ry + i // {p} AS y, rx + i % {p} AS x, sum({tent.format(f'(i // {p})')} * {tent.format(f'(i % {p})')} * v) AS num, sum({tent.format(f'(i // {p})')} * {tent.format(f'(i % {p})')}) AS den FROM e JOIN r USING (n, ref) GROUP BY ALL)",
        "o AS (SELECT z.n, z.ch, z.y, z.x, CASE WHEN den > 1e-12 THEN num / den ELSE z.v END AS v FROM z LEFT JOIN s USING (n, y, x))",
    ]
    return once(source, parts) + rows("o")


def bm4d_stage(tag: str, source: str, guide: str | None, sigma: float, h: int, w: int, cube: int, most: int, tau: float, kaiser: Sequence[float], step: int = 3, reach: int = 7, energy: float = 1e-4) -> list[str]:
    """tag_out(n, ch, y, x, v): a stage of the volume filter over source; with a guide the Wiener stage. Sums are whole numbers of 2^-32."""
    on, n3, keys = guide or source, cube**3, "ref"
    yx = ", ".join(str((y, x)) for y in positions(h, cube, step) for x in positions(w, cube, step))
    inside = f"z.n = {{0}}.z + i.range // {cube * cube} AND z.y = {{0}}.y + i.range // {cube} % {cube} AND z.x = {{0}}.x + i.range % {cube}"
    parts = [
        f"{tag}_r AS (SELECT row_number() OVER (ORDER BY z, y, x) AS ref, z, y, x FROM (SELECT DISTINCT least(range * {step}, frames - {cube}) AS z FROM range({MOST_FRAMES}), cnt WHERE frames >= {cube} AND range * {step} < frames - {cube} + {step}), (VALUES {yx}) v(y, x))",
        f"{tag}_g AS (SELECT c.z, c.y, c.x, list(z.v ORDER BY i.range) AS p FROM (SELECT a.range AS z, b.range AS y, d.range AS x FROM range({MOST_FRAMES}) a, cnt, range({h - cube + 1}) b, range({w - cube + 1}) d WHERE a.range <= frames - {cube}) c, range({n3}) i, {on} z WHERE {inside.format('c')} GROUP BY ALL)",
        f"{tag}_d AS (SELECT ref, b.z, b.y, b.x, CASE WHEN b.z = r.z AND b.y = r.y AND b.x = r.x THEN -1 ELSE list_sum(list_transform(range(1, {n3 + 1}), lambda i: (a.p[i] - b.p[i]) * (a.p[i] - b.p[i]))) END AS dist FROM {tag}_r r JOIN {tag}_g a ON a.z = r.z AND a.y = r.y AND a.x = r.x JOIN {tag}_g b ON b.z BETWEEN r.z - {reach} AND r.z + {reach} AND b.y BETWEEN r.y - {reach} AND r.y + {reach} AND b.x BETWEEN r.x - {reach} AND r.x + {reach})",
        f"{tag}_k AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY dist, z, y, x) - 1 AS k, count(*) OVER (PARTITION BY ref) AS many FROM {tag}_d WHERE dist <= {tau * n3 * (sigma / 255) ** 2!r})",
        f"{tag}_m AS (SELECT ref, z, y, x, k, CAST(pow(2, floor(log2(least(many, {most})))) AS INT) AS size FROM {tag}_k WHERE k < pow(2, floor(log2(least(many, {most})))))",
    ]

    def cubes(name: str, src: str, out: str, inverse: bool) -> list[str]:
        """The transform along each axis of src(ref, size, k, i, v)."""
        of, to = ("k", "i") if inverse else ("i", "k")
        made = []
        for axis, (digit, rest) in enumerate(((f"s.i // {cube * cube}", f"s.i % {cube * cube} + t.{to} * {cube * cube}"), (f"s.i // {cube} % {cube}", f"s.i // {cube * cube} * {cube * cube} + t.{to} * {cube} + s.i % {cube}"), (f"s.i % {cube}", f"s.i // {cube} * {cube} + t.{to}"))):
            made.append(f"{name}{axis} AS (SELECT ref, size, s.k, {rest} AS i, sum(t.b * s.v) AS v FROM {src} s JOIN dct{cube} t ON t.{of} = {digit} GROUP BY ALL)")
            src = f"{name}{axis}"
        return [*made, f"{out} AS (SELECT * FROM {src})"]

    def coefficients(name: str, planes: str) -> list[str]:
        took = f"{name}_p AS (SELECT m.ref, m.size, m.k, i.range AS i, z.v FROM {tag}_m m, range({n3}) i, {planes} z WHERE {inside.format('m')})"
        return [took, *cubes(f"{name}_x", f"{name}_p", f"{name}_c", False), f"{name}_t AS (SELECT ref, s.size, t.k, s.i, sum(t.b * s.v) AS v FROM {name}_c s JOIN haars t ON t.size = s.size AND t.i = s.k GROUP BY ALL)"]

    parts += coefficients(f"{tag}_s", source)
    if guide is None:
        parts.append(f"{tag}_z AS (SELECT *, CASE WHEN abs(v) >= {LAMBDA * sigma / 255!r} THEN 1.0 ELSE 0.0 END AS g FROM {tag}_s_t)")
        weight = "1.0 / greatest(sum(g), 1)"
    else:
        parts += coefficients(f"{tag}_b", guide)
        parts.append(f"{tag}_z AS (SELECT s.*, b.v * b.v / (b.v * b.v + {(sigma / 255) ** 2!r}) AS g FROM {tag}_s_t s JOIN {tag}_b_t b USING (ref, size, k, i))")
        weight = f"1.0 / greatest(sum(g * g), {energy!r})"
    parts += [
        f"{tag}_w AS (SELECT {keys}, {weight} AS w FROM {tag}_z GROUP BY ALL)",
        f"{tag}_u AS (SELECT ref, s.size, t.i AS k, s.i, sum(t.b * s.g * s.v) AS v FROM {tag}_z s JOIN haars t ON t.size = s.size AND t.k = s.k GROUP BY ALL)",
        *cubes(f"{tag}_v", f"{tag}_u", f"{tag}_e", True),
        f"{tag}_l(i, b) AS (VALUES {', '.join(f'({i}, CAST({float(v)!r} AS DOUBLE))' for i, v in enumerate(kaiser))})",
        f"{tag}_f AS (SELECT m.z + e.i // {cube * cube} AS n, m.y + e.i // {cube} % {cube} AS y, m.x + e.i % {cube} AS x, e.v, w * lz.b * ly.b * lx.b AS w FROM {tag}_e e JOIN {tag}_m m USING (ref, k) JOIN {tag}_w USING (ref) JOIN {tag}_l lz ON lz.i = e.i // {cube * cube} JOIN {tag}_l ly ON ly.i = e.i // {cube} % {cube} JOIN {tag}_l lx ON lx.i = e.i % {cube})",
        f"{tag}_a AS (SELECT n, y, x, sum(CAST(round_even(w * v * 4294967296.0, 0) AS BIGINT)) AS num, sum(CAST(round_even(w * 4294967296.0, 0) AS BIGINT)) AS den FROM {tag}_f GROUP BY ALL)",
        f"{tag}_out AS (SELECT z.n, z.ch, z.y, z.x, CASE WHEN den > 0 THEN CAST(num AS DOUBLE) / CAST(den AS DOUBLE) ELSE z.v END AS v FROM {source} z LEFT JOIN {tag}_a a USING (n, y, x))",
    ]
    return parts


def bm4d_sql(source: str, sigma: float, h: int, w: int, stages: Sequence[tuple[int, int, float]], kaiser: dict[int, Sequence[float]]) -> str:
    haars = ", ".join(f"({size}, {k}, {i}, CAST({b!r} AS DOUBLE))" for size in (1, 2, 4, 8, 16, 32) for k, row in enumerate(haar(size)) for i, b in enumerate(row) if b)
    parts = ["cnt AS (SELECT max(n) + 1 AS frames FROM z)", f"haars(size, k, i, b) AS (VALUES {haars})", *[basis_sql(f"dct{c}", dct(c)) for c, *_ in stages]]
    for tag, guide, (cube, most, tau) in zip("ab", (None, "a_out"), stages, strict=True):
        parts += bm4d_stage(tag, "z", guide, sigma, h, w, cube, most, tau, kaiser[cube])
    return once(source, parts) + rows("b_out")


def noise_sql(source: str, h: int, w: int) -> str:
    """Of each frame its blind noise: 8 x 8 references every 4 pixels, 16 matches in a window of 40, the three nearest of each row."""
    b, k = 8, 16
    parts = [refs_sql("r", "z", h, w, b, 4), blocks_sql("g", "z", h, w, b), *match_sql("m", "r", "g", b, 20, 19, k)]
    parts += [
        f"q AS (SELECT m.n, ref, i.range AS i, list(g.p[i.range + 1] ORDER BY k) AS p FROM m JOIN g ON g.n = m.t AND g.y = m.y AND g.x = m.x AND g.ch = 0, range({b * b}) i GROUP BY ALL)",
        "d AS (SELECT a.n, a.ref, a.i, b.i AS j, list_sum(list_transform(range(1, len(a.p) + 1), lambda t: (a.p[t] - b.p[t]) * (a.p[t] - b.p[t]))) AS dist, len(a.p) AS k FROM q a JOIN q b USING (n, ref))",
        "e AS (SELECT *, row_number() OVER (PARTITION BY n, ref, i ORDER BY CASE WHEN i = j THEN 0 ELSE 1 END, dist, j) - 1 AS q FROM d)",
        "f AS (SELECT n, ref, avg(sqrt(dist / k)) AS s FROM e WHERE q BETWEEN 1 AND 3 GROUP BY ALL)",
    ]
    return once(source, parts) + " SELECT CAST(n AS BIGINT) AS n, count(*) AS n_groups, round(avg(s), 6) AS sigma, round(avg(s) / 1.3923023108614498, 6) AS unguided FROM f GROUP BY n"


def nlh_stage(tag: str, values: str, guide: str, reference: str | None, sigma: float, h: int, w: int, b: int, step: int, window: int, k: int, q: int, scale: float = 0.32, rounds: int = 2) -> list[str]:
    """tag_out(n, ch, y, x, v): a stage of the pixel-row filter; with a reference the Wiener stage. sigma as a fraction of full scale; groups have k blocks, a power of two."""
    lo = window // 2
    parts = [refs_sql(f"{tag}_r", guide, h, w, b, step), blocks_sql(f"{tag}_g", guide, h, w, b), *match_sql(f"{tag}_m", f"{tag}_r", f"{tag}_g", b, lo, window - lo - 1, k)]
    at = f"z.n = m.t AND z.y = m.y + i.range // {b} AND z.x = m.x + i.range % {b}"
    took = lambda name, planes: f"{tag}_{name} AS (SELECT m.n, ref, m.k, i.range AS r, z.v FROM {tag}_m m, range({b * b}) i, {planes} z WHERE {at})"
    gap = "list_sum(list_transform(range(1, len(a.p) + 1), lambda t: (a.p[t] - b.p[t]) * (a.p[t] - b.p[t])))"
    parts += [
        took("gr", guide),
        f"{tag}_l AS (SELECT n, ref, r, list(v ORDER BY k) AS p FROM {tag}_gr GROUP BY ALL)",
        f"{tag}_d AS (SELECT a.n, a.ref, a.r, b.r AS j, {gap} AS dist FROM {tag}_l a JOIN {tag}_l b USING (n, ref))",
        f"{tag}_q AS (SELECT n, ref, r, j, a FROM (SELECT *, row_number() OVER (PARTITION BY n, ref, r ORDER BY CASE WHEN r = j THEN 0 ELSE 1 END, dist, j) - 1 AS a FROM {tag}_d) WHERE a < {q})",
    ]

    def forward(name: str, planes: str) -> list[str]:
        """name_t(n, ref, r, c, j, v): the coefficients of each row's matrix of its q nearest rows."""
        return [
            took(name, planes),
            f"{tag}_{name}_k AS (SELECT n, ref, r, t.k AS j, sum(t.b * s.v) AS v FROM {tag}_{name} s JOIN hk t ON t.i = s.k GROUP BY ALL)",
            f"{tag}_{name}_t AS (SELECT o.n, o.ref, o.r, t.k AS c, s.j, sum(t.b * s.v) AS v FROM {tag}_q o JOIN {tag}_{name}_k s ON s.n = o.n AND s.ref = o.ref AND s.r = o.j JOIN hq t ON t.i = o.a GROUP BY ALL)",
        ]

    parts += forward("s", values)
    if reference is None:
        parts.append(f"{tag}_z AS (SELECT n, ref, r, c, j, CASE WHEN abs(v) < {2.025 * sigma!r} OR c >= {max(0, q - 2)} AND j >= 1 THEN 0.0 ELSE v END AS v FROM {tag}_s_t)")
    else:
        parts += forward("b", reference)
        parts.append(f"{tag}_z AS (SELECT s.n, s.ref, s.r, s.c, s.j, s.v * pow(b.v * b.v / greatest(b.v * b.v + {(scale * sigma) ** 2!r}, 1e-300), {rounds}) AS v FROM {tag}_s_t s JOIN {tag}_b_t b USING (n, ref, r, c, j))")
    parts += [
        f"{tag}_u AS (SELECT n, ref, r, t.i AS a, s.j, sum(t.b * s.v) AS v FROM {tag}_z s JOIN hq t ON t.k = s.c GROUP BY ALL)",
        f"{tag}_e AS (SELECT o.n, o.ref, o.j AS r, u.j, sum(u.v) AS v FROM {tag}_u u JOIN {tag}_q o ON o.n = u.n AND o.ref = u.ref AND o.r = u.r AND o.a = u.a GROUP BY ALL)",
        f"{tag}_y AS (SELECT n, ref, r, t.i AS k, sum(t.b * e.v) AS v FROM {tag}_e e JOIN hk t ON t.k = e.j GROUP BY ALL)",
        f"{tag}_c AS (SELECT n, ref, j AS r, count(*) AS many FROM {tag}_q GROUP BY ALL)",
        f"{tag}_a AS (SELECT m.t AS n, m.y + y.r // {b} AS y, m.x + y.r % {b} AS x, sum(y.v) AS num, sum(many) AS den FROM {tag}_y y JOIN {tag}_c USING (n, ref, r) JOIN {tag}_m m USING (n, ref, k) GROUP BY ALL)",
        f"{tag}_out AS (SELECT z.n, z.ch, z.y, z.x, CASE WHEN den > 0 THEN num / den ELSE z.v END AS v FROM z LEFT JOIN {tag}_a a USING (n, y, x))",
    ]
    return parts


def nlh_sql(source: str, sigma: float, h: int, w: int, stages: Sequence[tuple[int, int, int]], windows: tuple[int, int], k: int = 16, iters: int = 3, mix: float = 0.6) -> str:
    """The rows of the filter on a grey clip; stages are (block, step, rows)."""
    s, (hard, last) = sigma / 255, stages
    parts, basic = [basis_sql("hk", haar(k)), basis_sql("hq", haar(hard[2]))], "z"
    for i in range(iters):
        parts.append(f"mix{i} AS (SELECT z.n, z.ch, z.y, z.x, CAST({mix} AS DOUBLE) * p.v + CAST({1 - mix!r} AS DOUBLE) * z.v AS v FROM z JOIN {basic} p USING (n, ch, y, x))")
        parts += nlh_stage(f"h{i}", f"mix{i}", f"mix{i}", None, s, h, w, *hard[:2], windows[0], k, hard[2])
        basic = f"h{i}_out"
    parts += nlh_stage("f", "z", basic, basic, s, h, w, *last[:2], windows[1], k, last[2])
    return once(source, parts) + rows("f_out")
