"""Run parameters with their defaults and permitted ranges, and the fixed values of the domain."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

#: rank of an era in chronological order; all others come last (fixed values)
ERA_RANK = {"ancient_classical": 0, "7th_8th": 1, "9th_10th": 2, "11th_12th": 3}
OTHER_ERA = 9
CONTROL_ERA = "ancient_classical"
COMMONPLACE = "ancient_commonplace"

WINDOW, OVERLAP = 140, 25
STEP = WINDOW - OVERLAP
UNIT_TOKENS = 400
#: units of a work that are compared; None compares all
UNITS_PER_WORK: int | None = None


@dataclass(frozen=True)
class Package:
    """A work package: an unordered pair of eras with floors of chain length and score."""

    name: str
    era_a: str
    era_b: str
    least_chain: int
    least_score: float


#: the first three packages (fixed values); the fourth takes every era and keeps tags
PACKAGES = (
    Package("wp1", CONTROL_ERA, "7th_8th", 6, 0.001),
    Package("wp2", CONTROL_ERA, "9th_10th", 6, 0.001),
    Package("wp3", CONTROL_ERA, "11th_12th", 8, 0.01),
)


@dataclass(frozen=True)
class Params:
    """Parameters of a comparison. ``clamped`` tells which were moved into their range, from what."""

    ngram: int = 4
    n_out: int = 1
    min_chain: int = 2
    fuzz: float = 0.75
    similarity: float | None = None
    min_shared: int = 3
    max_candidates: int = 4000
    mode: str = "v2"
    idf_scope: str = "corpus"
    #: a bigram is frequent in a work if more units have it than this and than a 25th of them
    cap_floor: int = 40
    #: bigrams that stand in more works than this make no candidates; None sets no bound
    most_works: int | None = None
    clamped: dict[str, object] = field(default_factory=dict)

    def checked(self) -> Params:
        if self.mode not in ("v1", "v2") or self.idf_scope not in ("call", "corpus"):
            raise ValueError("mode is v1 or v2, idf_scope call or corpus")
        ranges = {"ngram": (2, 8), "n_out": (0, 2), "min_chain": (1, None), "fuzz": (0.5, 1.0)}
        values, moved = asdict(self), {}
        for name, (low, high) in ranges.items():
            v = max(low, values[name])
            v = v if high is None else min(high, v)
            if v != values[name]:
                moved[name], values[name] = values[name], v
        values["clamped"] = moved
        return Params(**values)

    @property
    def kept(self) -> int:
        """Words of a gram: the window less those left out."""
        return max(1, self.ngram - self.n_out)
