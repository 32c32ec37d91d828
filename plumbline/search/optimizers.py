"""Search strategies over a space. A trial is a function (configuration, share of the data) -> score, larger is better."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from math import ceil, floor, isfinite, log

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from plumbline.search.space import Config, SearchSpace, config_id
from plumbline.search.surrogate import Forest, GaussianProcess, RankedEnsemble, acquisition, density_ratio

SUCCESS, TIMEOUT, ERROR, MEMORY, CRASHED = range(5)
Evaluate = Callable[[Config, float], float]


@dataclass
class Trial:
    config: Config
    score: float
    status: int
    fidelity: float
    seconds: float
    error: str = ""


class Watch:
    """Cancels the Spark jobs that this thread starts inside the block once ``seconds`` are over; ``late`` tells whether it did.

    Cancelling is repeated, for a trial may start another job after the first was cancelled.
    """

    def __init__(self, seconds: float | None) -> None:
        self.seconds, self.late, self.over = seconds, False, threading.Event()

    def __enter__(self) -> Watch:
        session = SparkSession.getActiveSession()
        if self.seconds is None:
            return self
        self.context = session.sparkContext if session else None
        group = f"trial-{uuid.uuid4().hex}"
        if self.context:
            self.context.setJobGroup(group, "a trial of a search", interruptOnCancel=True)

        def watch() -> None:
            wait = self.seconds
            while not self.over.wait(wait):
                self.late, wait = True, 0.2
                if self.context:
                    self.context.cancelJobGroup(group)

        self.thread = threading.Thread(target=watch, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.over.set()
        if self.seconds is not None:
            self.thread.join()
            if self.context:
                self.context.setLocalProperty("spark.jobGroup.id", None)
                self.context.setLocalProperty("spark.job.interruptOnCancel", None)


@dataclass
class Optimizer:
    """Trials so far, and a strategy for the next ones. ``parallel`` trials run in driver threads, each a set of Spark jobs.

    The search stops early once it has tried as many configurations as the space seems to have, and at the time ``until``.
    A trial that takes longer than ``per_run`` seconds is cancelled, with its Spark jobs, and counts as TIMEOUT.
    """

    space: SearchSpace
    evaluate: Evaluate
    seed: int = 1
    parallel: int = 1
    fixed: Config = field(default_factory=dict)
    history: list[Trial] = field(default_factory=list)
    spark: SparkSession | None = None
    until: float | None = None
    per_run: float | None = None

    def __post_init__(self) -> None:
        self.rng = np.random.default_rng(self.seed)
        probe = np.random.default_rng(0)
        self.limit = min(1500, len({config_id(self.space.sample(probe, self.fixed)) for _ in range(5000)}) if self.space.parameters else 1)

    def run(self, configs: list[Config], fidelity: float = 1.0) -> list[Trial]:
        def one(c: Config) -> Trial:
            began = time.time()
            if self.until is not None and began >= self.until:
                return Trial(c, float("-inf"), TIMEOUT, fidelity, 0.0, "no time left")
            left = min((x for x in (self.per_run, self.until and self.until - began) if x is not None), default=None)
            watch = Watch(left)
            try:
                with watch:
                    score, status, error = float(self.evaluate(c, fidelity)), SUCCESS, ""
                if not isfinite(score):
                    score, status = float("-inf"), ERROR
            except MemoryError as e:
                score, status, error = float("-inf"), MEMORY, str(e)
            except Exception as e:  # a failed trial is a result of the search
                score, status, error = float("-inf"), TIMEOUT if watch.late else ERROR, f"{type(e).__name__}: {e}"[:500]
            if watch.late and status == SUCCESS:
                score, status, error = float("-inf"), TIMEOUT, "too slow"
            return Trial(c, score, status, fidelity, time.time() - began, error)

        if self.parallel > 1 and len(configs) > 1:
            target = inheritable_thread_target(one) if self.spark is None else inheritable_thread_target(self.spark)(one)
            with ThreadPoolExecutor(self.parallel) as pool:
                done = list(pool.map(target, configs))
        else:
            done = [one(c) for c in configs]
        self.history += done
        return done

    def seen(self) -> set[str]:
        return {config_id(t.config) for t in self.history if t.fidelity == 1.0}

    def suggest(self, n: int) -> list[Config]:
        return self.space.distinct(n, self.rng, self.seen(), self.fixed)

    def iterate(self, n: int = 1) -> bool:
        """Up to ``n`` more trials; False once the space is used up."""
        while n > 0:
            if len(self.seen()) >= self.limit or (self.until is not None and time.time() >= self.until):
                return False
            batch = self.suggest(min(n, self.parallel))
            if not batch:
                return False
            self.run(batch)
            n -= len(batch)
        return True

    @property
    def best(self) -> Trial | None:
        good = [t for t in self.history if t.status == SUCCESS]
        top = max((t.fidelity for t in good), default=None)
        return max((t for t in good if t.fidelity == top), key=lambda t: t.score, default=None)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, config_id(t.config), {k: str(v) for k, v in t.config.items()}, t.fidelity, t.score if isfinite(t.score) else None, t.status, t.seconds) for i, t in enumerate(self.history)]
        return spark.createDataFrame(rows, "trial_id int, config_id string, config map<string,string>, fidelity double, score double, status int, seconds double")


class RandomSearch(Optimizer):
    pass


@dataclass
class ModelSearch(Optimizer):
    """Sequential model-based search: a forest or process over past trials, the configuration of the highest acquisition next.

    The acquisition is maximised over random configurations and the neighbours of the best; every fourth suggestion is random.
    ``past`` holds trials of other tasks (vectors, scores); their models then help as far as they rank this task's trials right.
    """

    surrogate: str = "forest"
    kind: str = "ei"
    start: int = 3
    past: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def suggest(self, n: int) -> list[Config]:
        good = [t for t in self.history if t.status == SUCCESS and t.fidelity == 1.0]
        if len(good) < self.start or len(self.history) % 4 == 3:
            return super().suggest(n)
        x = np.array([self.space.vector(t.config) for t in good])
        y = np.array([t.score for t in good])
        if self.past:
            model = RankedEnsemble([GaussianProcess().fit(px, py) for px, py in self.past], seed=self.seed).fit(x, y)
        else:
            model = (Forest(seed=self.seed) if self.surrogate == "forest" else GaussianProcess()).fit(x, y)
        best = max(good, key=lambda t: t.score).config
        pool = [self.space.sample(self.rng, self.fixed) for _ in range(100)]
        pool += [c for c in self.space.neighbours(best, self.rng) if all(c.get(k) == v for k, v in self.fixed.items())]
        done, fresh = self.seen(), {}
        for c in pool:
            if config_id(c) not in done:
                fresh.setdefault(config_id(c), c)
        if not fresh:
            return super().suggest(n)
        configs = list(fresh.values())
        value = acquisition(self.kind, *model.predict(np.array([self.space.vector(c) for c in configs])), float(y.max()))
        return [configs[i] for i in np.argsort(-value, kind="stable")[:n]]


@dataclass
class TPE(Optimizer):
    """The configuration that is most likely among the good trials and least among the others."""

    share: float = 0.25
    start: int = 4

    def suggest(self, n: int) -> list[Config]:
        good = sorted([t for t in self.history if t.status == SUCCESS and t.fidelity == 1.0], key=lambda t: -t.score)
        if len(good) < self.start:
            return super().suggest(n)
        k = max(2, ceil(len(good) * self.share))
        x = np.array([self.space.vector(t.config) for t in good])
        pool = [c for c in (self.space.sample(self.rng, self.fixed) for _ in range(128)) if config_id(c) not in self.seen()]
        if not pool:
            return super().suggest(n)
        value = density_ratio(x[:k], x[k:] if len(x) > k else x, np.array([self.space.vector(c) for c in pool]))
        return [pool[i] for i in np.argsort(-value, kind="stable")[:n]]


@dataclass
class Hyperband(Optimizer):
    """Many configurations on small nested shares of the data, the best 1 / eta on larger ones, up to all."""

    R: int = 81
    eta: int = 3

    def brackets(self) -> list[list[tuple[int, float]]]:
        """For each bracket the rounds as (configurations, share of the data)."""
        top = floor(log(self.R) / log(self.eta) + 1e-9)
        out = []
        for s in range(top, -1, -1):
            n = ceil((top + 1) / (s + 1) * self.eta**s)
            out.append([(max(1, floor(n * self.eta**-i)), self.eta ** (i - s)) for i in range(s + 1)])
        return out

    def propose(self, n: int) -> list[Config]:
        return self.space.distinct(n, self.rng, self.seen(), self.fixed)

    def iterate(self, n: int = 1) -> bool:
        """``n`` brackets."""
        brackets = self.brackets()
        for k in range(n):
            rounds = brackets[k % len(brackets)]
            configs = self.propose(rounds[0][0])
            if not configs:
                return False
            for i, (_, share) in enumerate(rounds):
                done = sorted(self.run(configs, share), key=lambda t: -t.score)
                if i + 1 < len(rounds):
                    configs = [t.config for t in done[: max(1, min(rounds[i + 1][0], len(done)))]]
        return True


@dataclass
class BOHB(Hyperband):
    """Hyperband whose configurations come from good past trials, at the largest share that has enough of them; 30 % are random."""

    R: int = 27
    random_share: float = 0.3
    generator: str = "kde"

    def propose(self, n: int) -> list[Config]:
        by: dict[float, list[Trial]] = {}
        for t in self.history:
            if t.status == SUCCESS:
                by.setdefault(t.fidelity, []).append(t)
        ready = [f for f, ts in by.items() if len(ts) >= 6]
        if not ready:
            return super().propose(n)
        trials = sorted(by[max(ready)], key=lambda t: -t.score)
        x, y = np.array([self.space.vector(t.config) for t in trials]), np.array([t.score for t in trials])
        fresh = super().propose(ceil(n * self.random_share))
        pool = [self.space.sample(self.rng, self.fixed) for _ in range(max(64, 4 * n))]
        points = np.array([self.space.vector(c) for c in pool])
        k = max(2, len(trials) // 4)
        value = density_ratio(x[:k], x[k:], points) if self.generator == "kde" else acquisition("ei", *self.model(x, y, by).predict(points), float(y.max()))
        out, known = list(fresh), {config_id(c) for c in fresh}
        for i in np.argsort(-value, kind="stable"):
            if len(out) >= n:
                break
            if config_id(pool[i]) not in known:
                known.add(config_id(pool[i]))
                out.append(pool[i])
        return out

    def model(self, x: np.ndarray, y: np.ndarray, by: dict[float, list[Trial]]):
        return Forest(seed=self.seed).fit(x, y)


class _Weighted:
    def __init__(self, parts: list[tuple[float, Forest, float, float]]) -> None:
        self.parts = parts

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = [(w, *f.predict(x), m, s) for w, f, m, s in self.parts]
        total = sum(w for w, *_ in got)
        return sum(w * (mean - m) / s for w, mean, _, m, s in got) / total, sum((w / total) ** 2 * v / s**2 for w, _, v, _, s in got)


@dataclass
class MFES(BOHB):
    """BOHB with one surrogate per share of the data, weighted by how well each ranks the trials on the largest share."""

    generator: str = "ei"

    def model(self, x: np.ndarray, y: np.ndarray, by: dict[float, list[Trial]]):
        parts = []
        for f, trials in by.items():
            if len(trials) < 3:
                continue
            xs, ys = np.array([self.space.vector(t.config) for t in trials]), np.array([t.score for t in trials])
            forest = Forest(seed=self.seed).fit(xs, ys)
            mean, _ = forest.predict(x)
            pairs = (mean[:, None] - mean[None]) * (y[:, None] - y[None])
            right = float((pairs > 0).sum()) / max(1, int((y[:, None] != y[None]).sum()))
            parts.append((right**3 + 1e-6, forest, float(ys.mean()), float(ys.std() or 1.0)))
        return _Weighted(parts)

    def propose(self, n: int) -> list[Config]:
        # scores are standardised per share, so the acquisition's best is too
        return super().propose(n)


def build(name: str, space: SearchSpace, evaluate: Evaluate, evaluation: str = "holdout", **kw) -> Optimizer:
    """A strategy by name; partial evaluation needs one that uses shares of the data."""
    if evaluation == "partial" and name not in ("hyperband", "bohb", "mfes"):
        name = "mfes"
    return {"random": RandomSearch, "smac": ModelSearch, "tlbo": ModelSearch, "tpe": TPE, "hyperband": Hyperband, "bohb": BOHB, "mfes": MFES}[name](space, evaluate, **kw)
