"""Parameters of the river-arc pipeline and its presets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class RiverConfig:
    """Options of the arc pipeline; lengths in metres unless said otherwise."""

    river_threshold: tuple[float, float] = (5.0, 600.0)
    min_arcs: int = 3
    width_to_arcs: str | Callable = "regular"
    position_type: str | Callable = "regular"
    outer_arc_positions: tuple[float, ...] = ()
    elev_scale: float = 1.0
    r_coef: float = 0.4
    length_width_ratio: float = 6.0
    along_channel_reso: tuple[float, float] = (5.0, 300.0)
    snap_point_ratio: float = 0.3
    snap_arc_ratio: float = 0.2
    clean_rounds: int = 5
    pseudo_channel: int = 2
    pseudo_width: float = 18.0
    pseudo_rows: int = 4
    pseudo_spacing: float = 20.0
    close_polygons: bool = True
    smooth_banks: bool = False
    nudge_banks: bool = True
    diagnostics: bool = False

    @property
    def endpoints_scale(self) -> float:
        """Refinement near the ends of lines, on where there are outer arcs."""
        return 1.3 if self.outer_arc_positions else 1.0


def following_loosely() -> RiverConfig:
    return RiverConfig(length_width_ratio=30.0)


def with_outer_arcs() -> RiverConfig:
    return RiverConfig(outer_arc_positions=(0.1, 0.2))


def barrier_islands() -> RiverConfig:
    return RiverConfig(river_threshold=(5.0, 1000.0), elev_scale=-1.0, r_coef=20.0, length_width_ratio=100.0, along_channel_reso=(5.0, 1000.0))


def levees() -> RiverConfig:
    return RiverConfig(
        pseudo_channel=1, pseudo_width=25.0, pseudo_rows=4, length_width_ratio=80.0, snap_point_ratio=0.1, snap_arc_ratio=0.1,
        river_threshold=(18.0, 18.0), min_arcs=4, clean_rounds=3,
    )


def atlantic_coast() -> RiverConfig:
    return replace(RiverConfig(), length_width_ratio=0.0, river_threshold=(16.0, 600.0), clean_rounds=3)
