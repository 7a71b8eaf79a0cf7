"""Settings of a run and the values derived from them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..operators.regions import effective_min_area
from ..operators.templates import MODES


@dataclass(frozen=True)
class Settings:
    """Input, output, colours, areas, smoothing and templates of a run; a value out of range is an error."""

    image: str = ""
    out_dir: str = "output"
    max_colors: int = 48
    color_count: int = 48
    auto_color_count: bool = False
    min_label_area: int = 260
    resize_max: int = 1200
    smooth_d: int = 9
    smooth_sigma_color: float = 50.0
    smooth_sigma_space: float = 50.0
    number_mode: str = "numbers"
    write_colored_edges: bool = False
    debug: bool = False
    effective_min_label_area: int = 0
    effective_merge_area: int = 0
    detected_color_count: int = 0
    color_count_used: int = 0

    def __post_init__(self):
        rules = [
            (self.max_colors >= 1, "--max-colors must be at least 1"),
            (self.color_count >= 1, "--color-count must be at least 1"),
            (self.min_label_area >= 1, "--min-label-area must be at least 1"),
            (self.resize_max >= 0, "--resize-max must be zero or positive"),
            (self.smooth_d >= 0, "--smooth-d must be zero or positive"),
            (self.smooth_d <= 1 or self.smooth_d % 2 == 1, "--smooth-d must be odd, or 0 to disable smoothing"),
            (self.number_mode in MODES, f"--number-mode must be one of {', '.join(MODES)}"),
        ]
        for holds, message in rules:
            if not holds:
                raise ValueError(message)

    def derived(self, pixels: int, colours: int = 0) -> Settings:
        """With the areas that hold for an image of so many pixels, and the colours that it was brought to."""
        area = effective_min_area(pixels, self.min_label_area)
        return replace(self, effective_min_label_area=area, effective_merge_area=area, detected_color_count=colours, color_count_used=colours)
