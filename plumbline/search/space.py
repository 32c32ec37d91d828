"""Search spaces: parameters with ranges, conditions and forbidden combinations; all of it small and on the driver."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from math import exp, log

import numpy as np

Config = dict[str, object]


@dataclass(frozen=True)
class Parameter:
    """``kind``: float, int, cat or const. ``when`` names a parent and the values that make this one active."""

    name: str
    kind: str
    low: float = 0.0
    high: float = 1.0
    choices: tuple = ()
    default: object = None
    log: bool = False
    when: tuple[str, tuple] | None = None

    def sample(self, rng: np.random.Generator) -> object:
        if self.kind == "cat":
            return self.choices[int(rng.integers(len(self.choices)))]
        if self.kind == "const":
            return self.default
        return self.decode(float(rng.random()))

    def decode(self, u: float) -> object:
        """From the unit interval."""
        v = exp(log(self.low) + u * (log(self.high) - log(self.low))) if self.log else self.low + u * (self.high - self.low)
        return int(min(self.high, max(self.low, round(v)))) if self.kind == "int" else float(v)

    def encode(self, value: object) -> float:
        if self.kind == "cat":
            return self.choices.index(value) / max(1, len(self.choices) - 1)
        if self.kind == "const":
            return 0.0
        if self.log:
            return (log(float(value)) - log(self.low)) / (log(self.high) - log(self.low) or 1.0)
        return (float(value) - self.low) / ((self.high - self.low) or 1.0)

    def first(self) -> object:
        if self.default is not None:
            return self.default
        return self.choices[0] if self.kind == "cat" else self.decode(0.5)


def uniform(name: str, low: float, high: float, default: float | None = None, log: bool = False, when=None) -> Parameter:
    return Parameter(name, "float", low, high, default=default, log=log, when=when)


def integer(name: str, low: int, high: int, default: int | None = None, log: bool = False, when=None) -> Parameter:
    return Parameter(name, "int", low, high, default=default, log=log, when=when)


def categorical(name: str, choices: list, default: object = None, when=None) -> Parameter:
    return Parameter(name, "cat", choices=tuple(choices), default=default, when=when)


def constant(name: str, value: object, when=None) -> Parameter:
    return Parameter(name, "const", default=value, when=when)


@dataclass
class SearchSpace:
    parameters: list[Parameter] = field(default_factory=list)
    forbidden: list[Callable[[Config], bool]] = field(default_factory=list)

    def add(self, *parameters: Parameter) -> SearchSpace:
        self.parameters += parameters
        return self

    def union(self, other: SearchSpace) -> SearchSpace:
        return SearchSpace([*self.parameters, *other.parameters], [*self.forbidden, *other.forbidden])

    def active(self, config: Config) -> Config:
        """Without the parameters whose condition doesn't hold; parents stand before their children."""
        out: Config = {}
        for p in self.parameters:
            if p.name in config and (p.when is None or out.get(p.when[0]) in p.when[1]):
                out[p.name] = config[p.name]
        return out

    def allowed(self, config: Config) -> bool:
        return not any(f(config) for f in self.forbidden)

    def default(self) -> Config:
        return self.active({p.name: p.first() for p in self.parameters})

    def sample(self, rng: np.random.Generator, fixed: Config | None = None) -> Config:
        for _ in range(1000):
            c = self.active({**{p.name: p.sample(rng) for p in self.parameters}, **(fixed or {})})
            if self.allowed(c):
                return c
        raise ValueError("no allowed configuration found")

    def distinct(self, n: int, rng: np.random.Generator, seen: set[str] | None = None, fixed: Config | None = None) -> list[Config]:
        """Up to ``n`` configurations that differ, the default first, 50 tries for each."""
        seen = set(seen or ())
        out: list[Config] = []
        first = self.active({**self.default(), **(fixed or {})})
        if config_id(first) not in seen and self.allowed(first):
            out.append(first)
            seen.add(config_id(first))
        while len(out) < n:
            for _ in range(50):
                c = self.sample(rng, fixed)
                if config_id(c) not in seen:
                    seen.add(config_id(c))
                    out.append(c)
                    break
            else:
                break
        return out[:n]

    def vector(self, config: Config) -> np.ndarray:
        """One number per parameter, -1 where it isn't active."""
        return np.array([p.encode(config[p.name]) if p.name in config else -1.0 for p in self.parameters])

    def neighbours(self, config: Config, rng: np.random.Generator, n: int = 4) -> list[Config]:
        """Configurations that differ in one active parameter."""
        out = []
        for p in self.parameters:
            if p.name not in config or p.kind == "const":
                continue
            options = [c for c in p.choices if c != config[p.name]] if p.kind == "cat" else [p.decode(float(np.clip(p.encode(config[p.name]) + rng.normal(0, 0.2), 0, 1))) for _ in range(n)]
            for v in options:
                base = {**{q.name: q.first() for q in self.parameters}, **config, p.name: v}
                c = self.active(base)
                if self.allowed(c) and c != config:
                    out.append(c)
        return out


def config_id(config: Config) -> str:
    """The digest of the sorted key-value pairs, numbers rounded to five places."""
    parts = sorted(f"{k}-{round(v, 5) if isinstance(v, float) else v}" for k, v in config.items())
    return hashlib.sha1(",".join(parts).encode()).hexdigest()
