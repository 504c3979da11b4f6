"""Thresholds, seed terms and options, all parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

CATEGORIES = ("IO_TYPE", "VENDOR_TAG", "POINT_FUNC", "SUBCOMP", "EQUIP")


def _terms(text: str) -> tuple[str, ...]:
    return tuple(text.split())


# Results depend on exactly these terms and thresholds.
SEED_EQUIP = _terms("AHU CHW CRAC EF FAN FANCOIL FCU HHW HWP HX MAU PUMP SF VAV")
SEED_SUBCOMP = _terms("DAT FLOW MAT OAT POS PRESS PRESSURE RAT SAT SPEED STATIC TEMP")
SEED_POINT_FUNC = _terms("ALARM ALM CMD COMD DAY ENABLE MODE NIGHT PROOF RUN START STATUS STOP")
IO_TYPES = _terms("AI AO AV BV DI DO UI UO")
VENDOR_HINTS = _terms("BAC BACNET HONEYWELL JCI N2 SCHNEIDER SIEMENS TRANE")
EQUIP_STOPWORDS = _terms(
    "AIR ALARM ALM COLD COOL DAY FILTER FLOW HEAT HOT MODE NIGHT RET RETURN RUN START STOP SUP SUPPLY TEMP ZONE"
)
MEASUREMENT_KEYWORDS = _terms("FLOW HUM LEVEL POS PRESS SPEED STATIC TEMP")
FUNCTION_KEYWORDS = _terms("ALARM ALM CMD COMD ENABLE ENBL MODE PROOF RUN START STAT STATUS STOP")
PREFERRED_COLUMNS = ("label", "johnson controls name", "bas_raw")


@dataclass(frozen=True)
class VocabConfig:
    """What makes a token a term of which category, and which terms stay."""

    min_freq: int = 10
    min_buildings: int = 2
    max_equip: int = 150
    min_subcomp_score: int = 15
    min_point_func_score: int = 5
    bottom: int = 30
    seed_equip: tuple[str, ...] = SEED_EQUIP
    seed_subcomp: tuple[str, ...] = SEED_SUBCOMP
    seed_point_func: tuple[str, ...] = SEED_POINT_FUNC
    io_types: tuple[str, ...] = IO_TYPES
    vendor_hints: tuple[str, ...] = VENDOR_HINTS
    vendor_suffix: str = "NET"
    vendor_max_length: int = 8
    equip_stopwords: tuple[str, ...] = EQUIP_STOPWORDS
    equip_blacklist: tuple[str, ...] = ()
    measurement_keywords: tuple[str, ...] = MEASUREMENT_KEYWORDS
    function_keywords: tuple[str, ...] = FUNCTION_KEYWORDS


@dataclass(frozen=True)
class ExtractConfig:
    """How files are read and the column of point names is found."""

    preferred: tuple[str, ...] = PREFERRED_COLUMNS
    min_score: float = 0.2
    sample: int = 200
    seed: int = 42
    exact_sample: bool = True
    null_label: str = "nan"


@dataclass(frozen=True)
class Vocabulary:
    """Upper-case terms by category, as used to label tokens."""

    equip: frozenset[str] = field(default_factory=frozenset)
    subcomp: frozenset[str] = field(default_factory=frozenset)
    point_func: frozenset[str] = field(default_factory=frozenset)
    io_type: frozenset[str] = field(default_factory=frozenset)
    vendor_tag: frozenset[str] = field(default_factory=frozenset)

    def in_lookup_order(self) -> tuple[tuple[str, frozenset[str]], ...]:
        """The order in which a token is looked up; it differs from the order in which tokens are classified."""
        return (
            ("VENDOR_TAG", self.vendor_tag),
            ("IO_TYPE", self.io_type),
            ("EQUIP", self.equip),
            ("SUBCOMP", self.subcomp),
            ("POINT_FUNC", self.point_func),
        )
