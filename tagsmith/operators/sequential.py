"""Parameter search that learns from its own trials.

After some random draws, the trials so far are split into the best ones and the rest. New candidates are
drawn from a density around the best, and the one that is likeliest there compared with the rest is
tried next. A trial is any function of parameters, usually a cross-validated fit on Spark, so the trials
run one after the other and each sees all earlier ones.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass

#: Trials drawn at random, share of trials that count as good, candidates compared for each trial.
WARM_UP, GOOD, CANDIDATES = 10, 0.1, 24
Trial = tuple[dict, float]


@dataclass(frozen=True)
class Choice:
    """One of some values."""

    values: tuple

    def draw(self, rng: random.Random):
        return rng.choice(self.values)

    def near(self, rng: random.Random, seen: list):
        weights = [1 + seen.count(v) for v in self.values]
        return rng.choices(self.values, weights)[0]

    def log_density(self, value, seen: list) -> float:
        return math.log((1 + seen.count(value)) / (len(self.values) + len(seen)))


@dataclass(frozen=True)
class Uniform:
    """A number between two bounds, evenly or evenly in its logarithm."""

    low: float
    high: float
    log: bool = False

    def _on(self, value: float) -> float:
        """The value's place between 0 and 1."""
        f = math.log if self.log else float
        return (f(value) - f(self.low)) / (f(self.high) - f(self.low))

    def _at(self, place: float) -> float:
        if self.log:
            return math.exp(math.log(self.low) + place * (math.log(self.high) - math.log(self.low)))
        return self.low + place * (self.high - self.low)

    def _width(self, seen: list) -> float:
        """Less around every trial the more there are."""
        return max(0.05, 0.5 / math.sqrt(len(seen) + 1))

    def draw(self, rng: random.Random) -> float:
        return self._at(rng.random())

    def near(self, rng: random.Random, seen: list) -> float:
        if not seen or rng.random() < 1 / (len(seen) + 1):
            return self.draw(rng)
        center, width = self._on(rng.choice(seen)), self._width(seen)
        while not 0 <= (place := rng.gauss(center, width)) <= 1:
            pass
        return self._at(place)

    def log_density(self, value: float, seen: list) -> float:
        x, width = self._on(value), self._width(seen)
        total = 1.0  # the even density, as one more trial
        for c in map(self._on, seen):
            inside = 0.5 * (math.erf((1 - c) / (width * math.sqrt(2))) + math.erf(c / (width * math.sqrt(2))))
            total += math.exp(-0.5 * ((x - c) / width) ** 2) / (width * math.sqrt(2 * math.pi) * inside)
        return math.log(total / (len(seen) + 1))


Space = dict[str, Choice | Uniform]


def propose(space: Space, trials: list[Trial], rng: random.Random) -> dict:
    """The parameters to try next."""
    if len(trials) < WARM_UP:
        return {name: d.draw(rng) for name, d in space.items()}
    ranked = sorted(trials, key=lambda t: t[1])
    cut = max(1, math.ceil(GOOD * len(ranked)))
    good, rest = ([p for p, _ in part] for part in (ranked[:cut], ranked[cut:]))

    def seen(part: list[dict], name: str) -> list:
        return [p[name] for p in part]

    drawn = [{name: d.near(rng, seen(good, name)) for name, d in space.items()} for _ in range(CANDIDATES)]
    return max(drawn, key=lambda p: sum(
        d.log_density(p[name], seen(good, name)) - d.log_density(p[name], seen(rest, name)) for name, d in space.items()))


def sequential_search(error: Callable[[dict], float], space: Space, trials: int = 50, seed: int = 42) -> tuple[dict, list[Trial]]:
    """The parameters of least error, the first of equal ones, and all trials in their order. The same seed
    and errors give the same trials; an error that isn't a number counts as infinite."""
    if trials < 1:
        raise ValueError("at least one trial is needed")
    rng, done = random.Random(seed), []
    for _ in range(trials):
        params = propose(space, done, rng)
        found = float(error(params))
        done.append((params, math.inf if math.isnan(found) else found))
    return min(done, key=lambda t: t[1])[0], done
