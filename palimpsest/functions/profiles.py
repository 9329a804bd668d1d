"""Every number the audit decides with, per profile.

Fixed values: they have to equal the published profiles for equal verdicts.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Profile:
    profile: str = "custom"
    scout_levels: tuple[float, ...] = (-1, 0, 1, 2, 3, 4, 5, 6)
    scout_draws: int = 2
    scout_probes: int = 2
    scout_min_released: float = 0.05
    max_levels: int = 6
    draws: int = 8
    probes: int = 4
    collapse_threshold: float = 0.1
    release_threshold: float = 0.5
    mixing_limit: float = 1.1
    gate_smoothing: int = 1
    map_smoothing: int = 0
    min_region_cells: int = 3
    negative_area_limit: float = 0.5
    alpha: float = 0.05
    minimum_controls: int = 0
    base_sample_controls: int = 0
    control_steps: int = 24
    confirmation_draws: int = 8
    snap_threshold: float = 4.0


CUSTOM = Profile()
QUICK = Profile(profile="quick", max_levels=3, draws=4, probes=2, confirmation_draws=4, map_smoothing=1, min_region_cells=8)
STANDARD = Profile(profile="standard", map_smoothing=1, min_region_cells=8)
EVIDENCE = replace(STANDARD, profile="evidence", minimum_controls=19)
TOY = Profile(profile="toy", scout_levels=(-4, -2, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10), scout_draws=4, scout_probes=4,
              max_levels=12, draws=8, probes=16, confirmation_draws=8)
NAMED = {p.profile: p for p in (QUICK, STANDARD, EVIDENCE, TOY)}


def profile_table(spark: SparkSession) -> DataFrame:
    """One row per named profile (a four-row dimension)."""
    rows = [{**asdict(p), "scout_levels": [float(v) for v in p.scout_levels]} for p in NAMED.values()]
    names = list(rows[0])
    kinds = {tuple: "array<double>", list: "array<double>", str: "string", int: "int", float: "double"}
    schema = ", ".join(f"{n} {kinds[type(rows[0][n])]}" for n in names)
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
