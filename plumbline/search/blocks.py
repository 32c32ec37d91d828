"""Plans of a search: joint over everything, one arm per algorithm with elimination, or alternating halves."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from plumbline.search.optimizers import Evaluate, Optimizer, Trial, build
from plumbline.search.space import Config, SearchSpace


@dataclass
class Joint:
    """One optimizer on the whole space."""

    space: SearchSpace
    evaluate: Evaluate
    optimizer: str = "smac"
    fixed: Config = field(default_factory=dict)
    options: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.engine: Optimizer = build(self.optimizer, self.space, self.evaluate, fixed=self.fixed, **self.options)
        self.rewards: list[float] = []

    def iterate(self, n: int = 1) -> bool:
        more = self.engine.iterate(n)
        self.rewards.append(self.best.score if self.best else float("-inf"))
        return more

    @property
    def history(self) -> list[Trial]:
        return self.engine.history

    @property
    def best(self) -> Trial | None:
        return self.engine.best


@dataclass
class Alternating:
    """Feature steps and model parameters in turn, each with the other's best fixed."""

    space: SearchSpace
    evaluate: Evaluate
    optimizer: str = "smac"
    fixed: Config = field(default_factory=dict)
    options: dict = field(default_factory=dict)
    prefix: str = "fe:"

    def __post_init__(self) -> None:
        self.rewards: list[float] = []
        self.history: list[Trial] = []
        self.turn = 0

    def iterate(self, n: int = 1) -> bool:
        base = self.best.config if self.best else self.space.default()
        half = [p for p in self.space.parameters if p.name.startswith(self.prefix) == (self.turn % 2 == 0)]
        held = {p.name: base.get(p.name, p.first()) for p in self.space.parameters if p not in half}
        engine = build(self.optimizer, self.space, self.evaluate, fixed={**held, **self.fixed}, **{**self.options, "seed": self.options.get("seed", 1) + self.turn})
        engine.history = [t for t in self.history if all(t.config.get(k) == v for k, v in held.items() if k in t.config)]
        known = len(engine.history)
        engine.iterate(n)
        self.history += engine.history[known:]
        self.turn += 1
        self.rewards.append(self.best.score if self.best else float("-inf"))
        return len(engine.history) > known or self.turn % 2 == 1

    @property
    def best(self) -> Trial | None:
        return max((t for t in self.history if t.status == 0), key=lambda t: t.score, default=None)


@dataclass
class Conditioning:
    """One child per algorithm, in turn. After ``alpha`` rounds an arm goes whose bound can't reach another arm's best.

    The bound carries the slope of an arm's last rewards on over the rounds left; it supposes scores of at most 1.
    """

    space: SearchSpace
    evaluate: Evaluate
    arms: list[str]
    on: str = "algorithm"
    child: type = Joint
    optimizer: str = "smac"
    alpha: int = 4
    rounds: int = 20
    options: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.children = {a: self.child(self.space, self.evaluate, self.optimizer, {self.on: a}, self.options) for a in self.arms}
        self.alive = list(self.arms)
        self.round = 0

    def iterate(self, n: int = 1) -> bool:
        for _ in range(n):
            for a in list(self.alive):
                self.children[a].iterate(1)
            self.round += 1
            self.eliminate()
        return True

    def eliminate(self) -> None:
        if self.round < self.alpha or len(self.alive) < 2:
            return
        low = {a: self.children[a].rewards[-1] for a in self.alive}
        up = {}
        for a in self.alive:
            r = np.array(self.children[a].rewards[-self.alpha :])
            slope = (r[-1] - r[0]) / max(1, len(r) - 1) if np.isfinite(r).all() else 1.0
            up[a] = min(1.0, low[a] + slope * max(0, self.rounds - self.round))
        best = max(low.values())
        self.alive = [a for a in self.alive if up[a] >= best or low[a] == best]

    @property
    def history(self) -> list[Trial]:
        return [t for c in self.children.values() for t in c.history]

    @property
    def best(self) -> Trial | None:
        return max((c.best for c in self.children.values() if c.best), key=lambda t: t.score, default=None)


def plan(number: int, space: SearchSpace, evaluate: Evaluate, arms: list[str], optimizer: str = "smac", **options):
    """0: joint. 1: arms of joint searches. 2: arms of alternating ones. 3: alternating. 4: joint by random search."""
    if number == 1:
        return Conditioning(space, evaluate, arms, child=Joint, optimizer=optimizer, options=options)
    if number == 2:
        return Conditioning(space, evaluate, arms, child=Alternating, optimizer=optimizer, options=options)
    if number == 3:
        return Alternating(space, evaluate, optimizer, options=options)
    return Joint(space, evaluate, "random" if number == 4 else optimizer, options=options)
