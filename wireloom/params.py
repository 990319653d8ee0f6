"""Tunables of the geometry layer, recorded with its results."""

from __future__ import annotations

import dataclasses
import json


@dataclasses.dataclass(frozen=True)
class Params:
    # The documented defaults, in drawing points.
    wire_min_len: float = 6.0
    glyph_max_len: float = 8.0
    glyph_cell: float = 1.2
    baseline_tol: float = 2.5
    gap_factor: float = 1.45
    text_max_height: float = 12.0
    node_tol: float = 0.35
    terminal_diameter: float = 5.0
    label_bin: float = 50.0
    label_gap: float = 8.5
    label_overlap: float = 0.5
    bind_radius: float = 7.0
    label_radius_factor: float = 1.6
    review_confidence: float = 0.7
    ortho_tol: float = 0.25
    ocr_dpi: float = 600.0
    ocr_pad: float = 2.5
    layers: tuple[str, ...] = ()
    page: int | None = None
    node_rule: str = "cells"  # or "distance": the oldest node within node_tol
    documented_junctions: bool = False

    @classmethod
    def merged(cls, text: str | None = None, **overrides) -> Params:
        """The defaults, overridden by a JSON object and by keywords; unknown names are an error, those of ``FILE_NAMES`` are known."""
        given = {FILE_NAMES.get(name, name): value for name, value in (json.loads(text) if text else {}).items()}
        return cls(**{**given, **overrides})

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self))


# What existing parameter files call some of these.
FILE_NAMES = {
    "node_snap": "node_tol", "line_band": "baseline_tol", "word_gap_ratio": "gap_factor", "label_attach_dy": "label_gap",
    "endpoint_bind_radius": "bind_radius", "terminal_dot_max_dia": "terminal_diameter",
}
