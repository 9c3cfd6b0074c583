"""Validated parameter records shared by operators and plans."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

METRICS = ("l2", "ip")


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")
    return metric


@dataclass(frozen=True)
class CarveParams:
    """How the point set is carved into leaves.

    ``cmax`` is the largest group left unsplit, ``fanout`` the number of leaves
    a point may belong to, and ``seed`` feeds the hash that picks leaders.
    """

    cmax: int = 128
    fanout: int = 2
    leader_frac: float = 0.02
    max_leaders: int = 1000
    seed: int = 17
    metric: str = "l2"

    def __post_init__(self):
        check_metric(self.metric)
        if self.cmax <= 0:
            raise ValueError("cmax must be positive")
        if self.max_leaders <= 0:
            raise ValueError("max_leaders must be positive")
        if self.max_leaders < 2:
            raise ValueError("max_leaders must be at least 2, or no group can be split")


@dataclass(frozen=True)
class CarveRoots:
    """Several ways to carve one point set, each with its replicas, as numbered roots of one forest.

    ``roots`` holds (settings, replica number) pairs; all settings share the metric.
    """

    roots: tuple[tuple[CarveParams, int], ...]

    def __post_init__(self):
        if len({settings.metric for settings, _ in self.roots}) != 1:
            raise ValueError("carvings of one forest need one metric")

    @property
    def metric(self) -> str:
        return self.roots[0][0].metric

    def values(self, name: str) -> list:
        """A setting of every root; ``seed`` has the replica number added."""
        if name == "seed":
            return [settings.seed + replica for settings, replica in self.roots]
        return [getattr(settings, name) for settings, _ in self.roots]

    @classmethod
    def of(cls, params, replicas: int = 1) -> "CarveRoots":
        return params if isinstance(params, cls) else cls(tuple((params, r) for r in range(replicas)))


@dataclass(frozen=True)
class CandidateParams:
    carve: CarveParams = field(default_factory=CarveParams)
    replicas: int = 1
    leaf_k: int = 12
    cap: int = 256
    bidirected: bool = True

    @property
    def replica_count(self) -> int:
        return max(1, self.replicas)


@dataclass(frozen=True)
class PruneParams:
    hash_bits: int = 12
    max_degree: int = 32
    seed: int = 7

    def __post_init__(self):
        if not 0 <= self.hash_bits <= 63:
            raise ValueError("hash_bits must be between 0 and 63")


@dataclass(frozen=True)
class BuildParams:
    carve: CarveParams = field(default_factory=CarveParams)
    prune: PruneParams = field(default_factory=PruneParams)
    replicas: int = 1
    leaf_k: int = 12
    bidirected: bool = True

    def candidates(self) -> CandidateParams:
        """Candidate settings: the shortlist holds eight times the final degree."""
        return CandidateParams(
            carve=self.carve,
            replicas=self.replicas,
            leaf_k=self.leaf_k,
            cap=max(1, 8 * self.prune.max_degree),
            bidirected=self.bidirected,
        )

    def with_metric(self, metric: str) -> "BuildParams":
        return replace(self, carve=replace(self.carve, metric=metric))


@dataclass(frozen=True)
class SearchParams:
    """``prefetch`` is how many frontier nodes are looked up per round; it
    changes the number of rounds, never the result."""

    beam: int = 128
    topk: int = 10
    entry: int = 0
    metric: str = "l2"
    prefetch: int = 16

    def __post_init__(self):
        check_metric(self.metric)
        if self.prefetch < 1:
            raise ValueError("prefetch must be positive")
