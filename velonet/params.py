"""Constants of a study, and cyclist profiles."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    """Fixed values, in metres and seconds."""

    grid_m: float = 50.0
    city_buffer_m: float = 9000.0
    pop_sample_m: float = 50.0
    group_m: float = 50.0
    hex_m: float = 200.0
    min_trip_s: float = 600.0
    max_anchor_m: float = 10_000.0
    slope_step_m: float = 5.0
    infra_step_m: float = 5.0
    walk_kph: float = 6.0
    parallel_arcs: str = "sum"  # "sum": parallel segments add their costs; "min": the quickest counts
    od_transposed: bool = True  # True: the time from destination to origin stands for the way there


@dataclass(frozen=True)
class Profile:
    """Speeds by stress level in km/h, and trip limits in minutes and kilometres."""

    name: str
    kph: dict[int, float] = field(default_factory=dict)
    min_time: float = 10.0
    max_time: float = 30.0
    max_km: float | None = None  # no limit by distance unless given

    def mps(self) -> dict[int, float]:
        """Level -> metres a second. Levels without a speed are closed: practically infinite cost."""
        return {k: v / 3.6 or 1e-20 for k, v in self.kph.items()} | {k: 1e-20 for k in range(5, 11)}


#: The profiles' speeds and limits.
WORK = Profile("Work", {-1: 10, 0: 6, 1: 18, 2: 15, 3: 10, 4: 4})
SUPER = Profile("Super", {k: 18 for k in range(-1, 5)})
SCHOOL = Profile("School", {-1: 0, 0: 4, 1: 10, 2: 5, 3: 0, 4: 0}, 0.0, 15.0)
HIGHSCHOOL = Profile("Highschool", {-1: 12, 0: 6, 1: 16, 2: 12, 3: 6, 4: 0}, 0.0, 30.0)
UNIVERSITY = Profile("University", {-1: 15, 0: 6, 1: 18, 2: 15, 3: 10, 4: 4}, 0.0, 30.0)
PROFILES = {p.name: p for p in (WORK, SUPER, SCHOOL, HIGHSCHOOL, UNIVERSITY)}

#: Relative slowdown by slope in percent, from -11 to 11.
SLOPE_PENALTY = [8.0, 8.0] + [0.0] * 11 + [0.37, 0.37, 1.2, 1.2, 3.2, 3.2, 3.2, 3.2, 8.0, 8.0]
