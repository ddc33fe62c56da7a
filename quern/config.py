"""Settings in one place."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from quern.operators import features


@dataclass(frozen=True)
class Config:
    """Defaults of the engine; ``replace`` gives variants."""

    seed: int = 13
    gram: int = 3
    k1: float = 1.2
    b: float = 0.75
    rrf_k: int = 60
    first_stage: int = 1000
    neighbours: int = features.NEIGHBOURS
    power: int = features.POWER
    weights: dict[str, float] = field(default_factory=lambda: dict(features.WEIGHTS))
    cutoffs: tuple[int, ...] = (1, 5, 10, 20)
    resamples: int = 1000

    @classmethod
    def checked(cls, given: dict) -> Config:
        """Settings from saved ones: unknown names, wrong types and numbers out of range are errors."""
        known = {f.name: getattr(cls(), f.name) for f in fields(cls)}
        clean = {}
        for name, value in given.items():
            if name not in known:
                raise ValueError(f"unknown setting {name!r}")
            kind = type(known[name])
            if kind is float and isinstance(value, int) and not isinstance(value, bool):
                value = float(value)
            if kind is tuple and isinstance(value, list):
                value = tuple(value)
            if not isinstance(value, kind) or isinstance(value, bool):
                raise ValueError(f"{name} must be of type {kind.__name__}")
            numbers = value.values() if kind is dict else value if kind is tuple else (value,)
            if any(isinstance(x, bool) or not isinstance(x, (int, float)) or not 0 <= x < float("inf") for x in numbers):
                raise ValueError(f"{name} must hold finite numbers that are not negative")
            if kind is dict and set(value) - set(known[name]):
                raise ValueError(f"{name} has an unknown feature")
            clean[name] = value
        return cls(**clean)
