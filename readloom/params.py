"""Frozen parameter presets. The numbers are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Matching:
    delta: int
    max_intron_shift: int
    max_missed_exon_len: int
    max_fake_terminal_exon_len: int
    max_suspicious_intron_abs_len: int
    max_suspicious_intron_rel_len: float
    resolve_ambiguous: str
    correct_minor_errors: bool
    minor_exon_extension: int = 50
    major_exon_extension: int = 300
    min_abs_exon_overlap: int = 10
    min_rel_exon_overlap: float = 0.2
    micro_intron_length: int = 50
    max_intron_rel_diff: float = 0.2
    apa_delta: int = 50
    minimal_exon_overlap: int = 5
    minimal_intron_absence_overlap: int = 20
    polya_window: int = 16
    polya_fraction: float = 0.75

    @property
    def max_intron_abs_diff(self) -> int:
        return min(30, self.max_intron_shift)


# Matching presets.
MATCHING = {
    "exact": Matching(0, 0, 0, 0, 0, 0.0, "monoexon_only", False),
    "precise": Matching(4, 30, 50, 20, 0, 0.0, "monoexon_and_fsm", True),
    "default": Matching(6, 60, 100, 40, 60, 1.0, "monoexon_and_fsm", True),
    "loose": Matching(12, 60, 100, 40, 60, 1.0, "all", True),
}

# Which corrections of read junctions each preset makes
# (fuzzy junctions, intron shifts, skipped exons, terminal exons, fake terminal exons, micro-intron retention).
SPLICE_CORRECTION = {
    "none": (False, False, False, False, False, False),
    "default_pacbio": (True, False, True, False, False, True),
    "conservative_ont": (True, False, True, False, False, False),
    "default_ont": (True, False, True, False, True, True),
    "all": (True, True, True, True, True, True),
    "assembly": (False, False, True, False, False, False),
}


@dataclass(frozen=True)
class Discovery:
    min_novel_intron_count: int
    graph_clustering_ratio: float
    graph_clustering_distance: int
    min_novel_isolated_intron_abs: int
    min_novel_isolated_intron_rel: float
    terminal_position_abs: int
    terminal_position_rel: float
    terminal_internal_position_rel: float
    min_known_count: int
    min_nonfl_count: int
    min_novel_count: int
    min_novel_count_rel: float
    min_mono_count_rel: float
    singleton_adjacent_cov: int
    fl_only: bool
    novel_monoexonic: bool
    require_monointronic_polya: bool
    require_monoexonic_polya: bool
    report: str


# Model construction presets.
DISCOVERY = {
    "reliable": Discovery(2, 0.5, 20, 5, 0.05, 1, 0.1, 0.1, 2, 4, 8, 0.05, 0.05, 50, True, False, True, True, "only_canonical"),
    "default_pacbio": Discovery(1, 0.5, 10, 2, 0.02, 1, 0.05, 0.05, 1, 2, 2, 0.02, 0.005, 100, False, True, False, True, "only_canonical"),
    "sensitive_pacbio": Discovery(1, 0.5, 5, 2, 0.005, 1, 0.01, 0.02, 1, 2, 2, 0.005, 0.001, 100, False, True, False, False, "only_stranded"),
    "pacbio_all": Discovery(1, 0.5, 5, 2, 0.005, 1, 0.01, 0.02, 1, 2, 1, 0.002, 0.001, 100, False, True, False, False, "only_stranded"),
    "default_ont": Discovery(1, 0.5, 20, 3, 0.02, 1, 0.05, 0.05, 1, 3, 3, 0.02, 0.02, 10, False, False, True, True, "only_canonical"),
    "sensitive_ont": Discovery(1, 0.5, 20, 3, 0.005, 1, 0.01, 0.02, 1, 2, 3, 0.005, 0.005, 10, False, True, False, False, "only_stranded"),
    "fl_pacbio": Discovery(1, 0.5, 10, 2, 0.02, 1, 0.05, 0.01, 1, 2, 3, 0.02, 0.005, 100, True, True, False, False, "only_canonical"),
    "all": Discovery(0, 0.3, 5, 1, 0.002, 1, 0.01, 0.01, 1, 1, 1, 0.002, 0.001, 500, False, True, False, False, "all"),
    "assembly": Discovery(0, 0.3, 5, 1, 0.05, 1, 0.01, 0.02, 1, 1, 1, 0.05, 0.01, 50, False, True, False, False, "only_stranded"),
}

#: Edit distance of UMIs by protocol.
UMI_DISTANCE = {"tenx": 3, "visium_5prime": 3, "curio": 3, "visium_hd": 4, "stereo": 4, "custom": 4}


def with_delta(preset: str, delta: int) -> Matching:
    if delta < 0:
        raise ValueError("delta must not be negative")
    return replace(MATCHING[preset], delta=delta)
