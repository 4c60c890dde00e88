"""Business rules: limits and what to do when a value breaks them. Values enter plans as literals."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rules:
    year_min: int = 1700
    year_max: int = 2026
    year_pivot: int = 25
    invalid_year_action: str = "flag_review"  # or none, reset_year, set_default
    year_default: int = 1980
    max_stories_wood_frame: int = 3
    stories_exceeded_action: str = "flag_review"  # or reset_construction, reset_stories
    min_area_sqft: float = 100.0
    invalid_area_action: str = "flag_review"  # or none
    max_building_value: int = 1_000_000_000
    max_contents_value: int = 500_000_000
    max_bi_value: int = 500_000_000
    invalid_value_action: str = "flag_review"  # or reset_value, none
    deterministic_score_threshold: float = 0.85  # conflict rules and keywords below it give way to later stages
    tfidf_confidence_threshold: float = 0.50  # neighbours below it give way to the default code
    default_occupancy_air: str = "311"
    default_construction_air: str = "100"
    default_occupancy_rms: str = "Com1"
    default_construction_rms: str = "W1"
    policy_id: str = ""
    insured_name: str = ""
    default_line_of_business: str = "COM"

    def default_code(self, field: str, target: str) -> str:
        """The code of what nothing else explains. field: occupancy or construction."""
        return getattr(self, f"default_{field}_{target.lower()}")


PRESETS = {
    "standard": Rules(),
    "strict": Rules(stories_exceeded_action="reset_construction", invalid_value_action="reset_value"),
    "lenient": Rules(invalid_area_action="none", invalid_value_action="none"),
    # The three named sets of limits.
    "Conservative": Rules(
        year_min=1850, max_stories_wood_frame=2, stories_exceeded_action="reset_construction", min_area_sqft=200.0, max_building_value=50_000_000, max_contents_value=25_000_000, max_bi_value=10_000_000,
        deterministic_score_threshold=0.90, tfidf_confidence_threshold=0.60,
    ),
    "Balanced": Rules(year_min=1800, max_building_value=100_000_000, max_contents_value=50_000_000, max_bi_value=25_000_000),
    "Permissive": Rules(
        max_stories_wood_frame=5, stories_exceeded_action="none", min_area_sqft=50.0, invalid_area_action="none", max_building_value=500_000_000, max_contents_value=200_000_000, max_bi_value=100_000_000,
        invalid_value_action="none", deterministic_score_threshold=0.70, tfidf_confidence_threshold=0.30,
    ),
}
