"""The versioned registry of rolling primitives."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from causeway.operators.graph import Graph

FIELDS = ("open", "high", "low", "close", "volume")


class RegistryError(ValueError):
    """An unknown, repeated or withdrawn primitive."""


class ParameterError(ValueError):
    """A parameter that a primitive does not take, or a value out of bounds."""


@dataclass(frozen=True)
class Primitive:
    name: str
    version: int
    build: Callable[..., str]
    family: str
    summary: str
    deprecated: bool = False

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"

    @property
    def defaults(self) -> dict[str, object]:
        """Parameters with their defaults; ``inspect.Parameter.empty`` where one must be given."""
        return {k: p.default for k, p in list(inspect.signature(self.build).parameters.items())[1:]}

    def column(self, graph: Graph, **params) -> str:
        """The primitive's column in a graph. Parameters are checked, closed and typed."""
        known = self.defaults
        if unknown := params.keys() - known.keys():
            raise ParameterError(f"{self.key} takes no {', '.join(sorted(unknown))}")
        bound = {k: params.get(k, d) for k, d in known.items()}
        for k, v in bound.items():
            if v is inspect.Parameter.empty:
                raise ParameterError(f"{self.key} needs {k}")
            if k in ("field", "other") and v not in FIELDS:
                raise ParameterError(f"{k} must be one of {', '.join(FIELDS)}, not {v!r}")
            least = 2 if k in ("seed_multiplier", "lookback_multiplier") else 0 if k == "ddof" else 1
            if isinstance(v, bool) or k == "output" or not isinstance(v, (int, float)):
                continue
            if isinstance(known[k], float):
                continue
            if v != int(v) or v < least:
                raise ParameterError(f"{k} must be a whole number of at least {least}, not {v}")
        return self.build(graph, **bound)

    def warmup(self, **params) -> int:
        """Closed bars that a value needs."""
        graph = Graph()
        return graph.needs[self.column(graph, **params)]


_ALL: dict[str, Primitive] = {}


def primitive(name: str, family: str, version: int = 1) -> Callable:
    """Registers a builder ``(graph, **params) -> column``."""

    def register(build: Callable[..., str]) -> Callable[..., str]:
        key = f"{name}@{version}"
        if key in _ALL:
            raise RegistryError(f"{key} is already registered")
        _ALL[key] = Primitive(name, version, build, family, (build.__doc__ or "").strip())
        return build

    return register


def get(ref: str) -> Primitive:
    """By ``name@version``, or by ``name`` for the latest version that is not deprecated."""
    _load()
    if "@" in ref:
        if ref not in _ALL:
            raise RegistryError(f"unknown primitive {ref}")
        return _ALL[ref]
    found = [p for p in _ALL.values() if p.name == ref and not p.deprecated]
    if not found:
        raise RegistryError(f"unknown primitive {ref}")
    return max(found, key=lambda p: p.version)


def deprecate(ref: str) -> None:
    """A deprecated version stays resolvable by its full name."""
    p = get(ref)
    _ALL[p.key] = Primitive(p.name, p.version, p.build, p.family, p.summary, True)


def everything() -> dict[str, Primitive]:
    _load()
    return dict(sorted(_ALL.items()))


def _load() -> None:
    from causeway.functions import averages, bands, directional, flow, momentum, statistics, transforms, volatility  # noqa: F401
