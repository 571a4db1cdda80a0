"""Engine settings: typed, validated, immutable."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from .functions.orderings import ORDERINGS

DESCRIPTIONS = {
    "orderings": "candidates of the ordering choice, by commas; the fewest factor entries win",
    "tile_size": "edge of the blocks of the blocked layout",
    "tile_ordering": "ordering of the block quotient graph in the blocked layout",
    "dense_below": "matrices of up to so many unknowns are one dense block without an ordering",
    "widest_front": "most columns of a front",
    "blocked_from": "matrices of so many unknowns are factored block by block over the cluster",
    "checkpoint_every": "levels of the blocked factorisation between two written stages",
    "drop_zero_tiles": "whether blocks of zeros alone are left out of the blocked layout",
    "symbolic_only": "stop after ordering and pattern",
    "log_level": "Spark's log level",
}


@dataclass(frozen=True)
class EngineConf:
    orderings: str = "dense_last,rcm,nested_dissection"
    tile_size: int = 64
    tile_ordering: str = "min_degree"
    dense_below: int = 96
    widest_front: int = 128
    blocked_from: int = 50_000
    checkpoint_every: int = 1
    drop_zero_tiles: bool = True
    symbolic_only: bool = False
    log_level: str = "WARN"

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            kind = type(f.default)
            if type(value) is not kind:
                raise TypeError(f"{f.name} is a {kind.__name__}")
            if kind is int and value < 1:
                raise ValueError(f"{f.name} is at least 1")
        for name in [*self.ordering_list, self.tile_ordering]:
            if name not in ORDERINGS:
                raise ValueError(f"no ordering {name!r}; there are {', '.join(ORDERINGS)}")
        if self.log_level not in ("DEBUG", "INFO", "WARN", "ERROR"):
            raise ValueError("log_level is DEBUG, INFO, WARN or ERROR")

    @property
    def ordering_list(self) -> list[str]:
        return [x.strip() for x in self.orderings.split(",")]

    def with_(self, **changes) -> EngineConf:
        return replace(self, **changes)

    def reset(self, *names: str) -> EngineConf:
        """The named settings back at their defaults; all of them if none is named."""
        own = EngineConf()
        return own if not names else replace(self, **{n: getattr(own, n) for n in names})

    def as_dict(self) -> dict:
        return asdict(self)

    def describe(self, spark: SparkSession) -> DataFrame:
        """(name, value, description), one row for each setting."""
        rows = [(k, str(v).lower() if isinstance(v, bool) else str(v), DESCRIPTIONS[k]) for k, v in self.as_dict().items()]
        return spark.createDataFrame(rows, "name string, value string, description string")
