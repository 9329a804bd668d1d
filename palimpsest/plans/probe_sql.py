"""Oracle text of the probe stages, parameterised by grid and profile."""

from __future__ import annotations

from palimpsest.functions.profiles import Profile
from palimpsest.operators import grid

_T = "[" + ", ".join("'inf'::DOUBLE" if t == float("inf") else f"{t}::DOUBLE" for t in grid.T95) + "]"


def near(a: str, c: str, cols: int, radius: int) -> str:
    return (f"abs({a}.cell // {cols} - {c}.cell // {cols}) <= {radius} AND abs({a}.cell % {cols} - {c}.cell % {cols}) <= {radius}")


def channel_field() -> str:
    """The field over ``m`` with a channel ``ch`` per row: draws are averaged over channels, spreads taken per channel."""
    return f"""SELECT f.*, spread FROM (SELECT ref_id, level_ix, cell, c, se, n AS draws, CASE WHEN n >= 2 THEN c - ({_T})[least(n - 1, 15) + 1] * se ELSE '-infinity'::DOUBLE END AS lower, rb, rt, cp, sd FROM (
        SELECT ref_id, level_ix, cell, avg(c) AS c, count(*) AS n, stddev_samp(c) / sqrt(count(*)) AS se, avg(rb) AS rb, avg(rt) AS rt, avg(cp) AS cp, avg(sd) AS sd FROM (
          SELECT ref_id, level_ix, draw, cell, avg(rho_base - rho_target) AS c, avg(rho_base) AS rb, avg(rho_target) AS rt, avg(rho_uncond - rho_target) AS cp,
            avg((eps_target - eps_base) * (eps_target - eps_base)) AS sd FROM m GROUP BY ref_id, level_ix, draw, cell) GROUP BY ref_id, level_ix, cell)) f
      JOIN (SELECT ref_id, level_ix, cell, avg(spread) AS spread FROM (SELECT ref_id, level_ix, cell, ch, stddev_samp(x0_base) * max(ratio) AS spread FROM m GROUP BY ref_id, level_ix, cell, ch)
        GROUP BY ref_id, level_ix, cell) USING (ref_id, level_ix, cell)"""


def stages(cols: int, cfg: Profile, channels: int = 1) -> dict[str, str]:
    """Fragments over ``m`` (measurements) and ``conf`` (confirmation estimates)."""
    tau = cfg.collapse_threshold
    smooth = cfg.map_smoothing
    out = {
        "field": f"""SELECT ref_id, level_ix, cell, c, se, n AS draws, CASE WHEN n >= 2 THEN c - ({_T})[least(n - 1, 15) + 1] * se ELSE '-infinity'::DOUBLE END AS lower,
            rb, rt, cp, spread, sd FROM (SELECT ref_id, level_ix, cell, avg(rho_base - rho_target) AS c, count(*) AS n,
            stddev_samp(rho_base - rho_target) / sqrt(count(*)) AS se, avg(rho_base) AS rb, avg(rho_target) AS rt, avg(rho_uncond - rho_target) AS cp,
            stddev_samp(x0_base) * max(ratio) AS spread, avg((eps_target - eps_base) * (eps_target - eps_base)) AS sd FROM m GROUP BY ref_id, level_ix, cell)""",
        "gated": f"""SELECT a.*, released FROM field a JOIN (SELECT a.ref_id, a.level_ix, a.cell,
            coalesce(avg(c.rb) BETWEEN {cfg.release_threshold} AND {cfg.mixing_limit} AND avg(c.spread) <= {cfg.mixing_limit} AND max(a.rb) <= {2 * cfg.mixing_limit}, false) AS released
            FROM field a JOIN field c ON a.ref_id = c.ref_id AND a.level_ix = c.level_ix AND {near('a', 'c', cols, cfg.gate_smoothing)}
            GROUP BY a.ref_id, a.level_ix, a.cell) g USING (ref_id, level_ix, cell)""",
        "pairs": """SELECT *, lead(level_ix) OVER w AS nl, lead(released) OVER w AS nr, lead(c) OVER w AS nc, lead(lower) OVER w AS nlow, lead(cp) OVER w AS ncp,
            min(level_ix) OVER (PARTITION BY ref_id) = max(level_ix) OVER (PARTITION BY ref_id) AS single FROM gated WINDOW w AS (PARTITION BY ref_id, cell ORDER BY level_ix)""",
        "sust": """SELECT ref_id, cell, coalesce(max(least(c, nc)) FILTER (ok), 0) AS s, coalesce(max(least(lower, nlow)) FILTER (ok), 0) AS lb,
            coalesce(max(least(-c, -nc)) FILTER (ok), 0) AS neg, coalesce(max(least(cp, ncp)) FILTER (ok), 0) AS sp,
            max({'v': least(c, nc), 'o': -level_ix, 'l': CASE WHEN single OR c >= nc THEN level_ix ELSE nl END}) FILTER (ok) AS s_level, bool_or(released) AS ever
            FROM (SELECT *, coalesce(nl = level_ix + 1 AND released AND nr, false) OR single AND released AS ok FROM pairs) GROUP BY ref_id, cell""",
        "maps": "SELECT ref_id, cell, s, lb, sp, ever FROM sust" if smooth == 0 else f"""SELECT a.ref_id, a.cell, avg(c.s) AS s, avg(c.lb) AS lb, avg(c.sp) AS sp,
            bool_or(a.ever) AS ever FROM sust a JOIN sust c ON a.ref_id = c.ref_id AND {near('a', 'c', cols, smooth)} GROUP BY a.ref_id, a.cell""",
        "mask": f"SELECT ref_id, cell FROM maps WHERE s >= {tau} AND lb > 0",
    }
    out["sust"] = "SELECT * REPLACE (s_level.l AS s_level) FROM (" + out["sust"] + ")"
    if channels > 1:
        out["field"] = channel_field()
    after = {
        "comp": "SELECT ref_id, cell, min(start) AS root FROM reach GROUP BY ref_id, cell",
        "clus": f"SELECT ref_id, cell, root FROM (SELECT *, count(*) OVER (PARTITION BY ref_id, root) AS size FROM comp) WHERE size >= {cfg.min_region_cells}",
        "regs": f"""SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY mass DESC, root) AS region FROM (SELECT ref_id, root, count(*) AS cells, sum(s) AS mass,
            avg(s) AS mean_collapse, max(s) AS peak_collapse, avg(sp) AS prompt_collapse, min(cell // {cols}) AS r0, max(cell // {cols}) AS r1,
            min(cell % {cols}) AS c0, max(cell % {cols}) AS c1 FROM clus JOIN maps USING (ref_id, cell) GROUP BY ref_id, root)""",
        "peaks": """SELECT ref_id, root, arg_max(level_ix, total) AS peak_level FROM (SELECT ref_id, root, level_ix, sum(c) AS total FROM clus JOIN field USING (ref_id, cell)
            GROUP BY ref_id, root, level_ix ORDER BY level_ix) GROUP BY ref_id, root""",
        "cdists": """SELECT ref_id, level_ix, cell, avg((x0_base - x0) * (x0_base - x0)) AS db, avg((x0_target - x0) * (x0_target - x0)) AS dt FROM conf GROUP BY ref_id, level_ix, cell""",
        "lr": "SELECT *, ln(greatest(db, 1e-12)) - ln(greatest(dt, 1e-12)) AS lr FROM cdists",
        "rsnap": "SELECT ref_id, root, level_ix, exp(avg(lr)) AS snap FROM clus JOIN lr USING (ref_id, cell) GROUP BY ref_id, root, level_ix",
        "msnap": """SELECT ref_id, exp(coalesce(avg(CASE WHEN inside IS NOT NULL THEN greatest(inside, ln(1e-12)) END), avg(greatest(frame, ln(1e-12))))) AS membership_snap, exp(avg(greatest(frame, ln(1e-12)))) AS frame_snap
            FROM (SELECT ref_id, level_ix, avg(lr) FILTER (root IS NOT NULL) AS inside, avg(lr) AS frame FROM lr LEFT JOIN clus USING (ref_id, cell) GROUP BY ref_id, level_ix) GROUP BY ref_id""",
    }
    return {"before": out, "after": after}


def reach(cols: int) -> str:
    return f"""SELECT ref_id, cell AS start, cell FROM mask UNION SELECT r.ref_id, r.start, k.cell FROM reach r JOIN mask k ON k.ref_id = r.ref_id AND (
      (k.cell // {cols} = r.cell // {cols} AND abs(k.cell - r.cell) = 1) OR abs(k.cell - r.cell) = {cols})"""


def text(inputs: dict[str, str], cols: int, cfg: Profile, select: str, extra: dict[str, str] | None = None, channels: int = 1) -> str:
    """Inputs, every probe stage, then ``select``."""
    st = stages(cols, cfg, channels)
    parts = [f"{n} AS MATERIALIZED ({t})" for n, t in {**inputs, **st["before"]}.items()]
    parts.append(f"reach AS ({reach(cols)})")
    parts += [f"{n} AS MATERIALIZED ({t})" for n, t in {**st["after"], **(extra or {})}.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {select}"
