"""All thresholds of the drawing operators, with their defaults, as one immutable record."""

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Options:
    """Lengths are in the unit of the name: px pixels, mm millimetres."""

    # boxes
    min_side_px: float = 10.0
    max_side_px: float = 80.0
    squareness: float = 0.5
    column_max_side_px: float = 80.0
    column_squareness: float = 0.75
    framing_max_side_px: float = 300.0
    framing_squareness: float = 0.0
    nms_iou: float = 0.45
    # validation
    overlap_iou: float = 0.5
    off_grid_px: float = 80.0
    isolated_px: float = 200.0
    outside_tol_px: float = 50.0
    min_bay_mm: float = 3000.0
    max_bay_mm: float = 12000.0
    # grid
    fallback_bay_mm: float = 8400.0
    default_bay_mm: float = 6000.0
    plausible: float = 0.30
    least_dim_mm: float = 300.0
    most_dim_mm: float = 30_000.0
    margin_pt: float = 40.0
    margin_reach_px: float = 200.0
    label_band_px: float = 50.0
    fallback_x: int = 42
    fallback_y: int = 30
    sheet_w_pt: float = 3370.0
    sheet_h_pt: float = 2384.0
    # sizes
    min_column_mm: float = 800.0
    square_aspect: float = 0.20
    default_slab_mm: float = 200.0
    slab_tile: float = 4096.0
    default_storey_mm: float = 5000.0
    default_wall_mm: float = 200.0
    wall_height_mm: float = 2800.0
    sill_mm: float = 900.0
    grid_run_mm: float = 10_000.0
    default_px_per_mm: float = 1.0
    default_beam_mm: float = 800.0
    # sanitizer
    min_beam_mm: float = 500.0
    axis_tol_mm: float = 50.0
    perp_snap: float = 0.5
    along_anchor: float = 0.5
    step_anchor: float = 0.25
    across_anchor: float = 0.25
    dash_perp_mm: float = 150.0
    dash_long: float = 0.5
    aligned_cos: float = 0.9
    rect_min_mm: float = 200.0
    rect_max_mm: float = 1500.0
    steps_one: int = 4
    steps_both: int = 2
    # annotation
    search_factor: float = 3.0
    search_floor_px: float = 200.0
    tag_radius_px: float = 80.0
    framing_tag_radius_px: float = 120.0
    grid_align_px: float = 30.0
    # admittance
    clearance: float = 1.5
    max_growth: float = 3.0
    slab_min_area_px: float = 90_000.0
    slab_dup_iou: float = 0.5
    # stores and sessions
    max_jobs: int = 100
    history: int = 40
    session_minutes: int = 60
    export_limit: int = 5000
    min_observations: int = 2
    search_rows: int = 15
    low_confidence: float = 0.6


DEFAULTS = Options()


def with_profile(profile: dict, options: Options = DEFAULTS) -> Options:
    """The options after a project's profile; values of another type or out of their range are passed over.

    Wall height and thickness and sill height have to be above 0, the storey height within 2000 to 8000; a column size only raises the least one.
    """

    def number(key: str) -> float:
        v = profile.get(key)
        return float(v) if isinstance(v, int | float) else 0.0

    new = {name: number(key) for key, name in (("typical_wall_height_mm", "wall_height_mm"), ("typical_wall_thickness_mm", "default_wall_mm"), ("typical_sill_height_mm", "sill_mm")) if number(key) > 0}
    if 2000 <= number("floor_to_floor_height_mm") <= 8000:
        new["default_storey_mm"] = number("floor_to_floor_height_mm")
    if number("typical_column_size_mm") > options.min_column_mm:
        new["min_column_mm"] = number("typical_column_size_mm")
    return replace(options, **new)

#: Standard sides of square columns and standard diameters of round ones, in mm.
SQUARE_SIZES = [200, 250, 300, 350, 400, 450, 500, 600, 700, 800, 900, 1000, 1200]
ROUND_SIZES = [300, 350, 400, 450, 500, 600, 700, 800, 900, 1000, 1200]

#: Names of the column families that the modelling program holds.
ROUND_FAMILY = "CJY_RC Round Column"
SQUARE_FAMILY = "CJY_Concrete-Rectangular-Column"
