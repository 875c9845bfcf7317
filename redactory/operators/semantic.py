"""Scorers that confirm candidates: questions in, scores from 0 to 1 (None: no answer) out, one call a batch of texts.

A remote scorer plugs in as any callable of that shape; nothing here reaches a network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Preset:
    """A stand-in that answers by rule."""

    def __init__(self, scores: dict[str, float], default: float | None = None):
        self.scores, self.default = scores, default

    def __call__(self, questions: Iterable[dict]) -> list[float | None]:
        return [self.scores.get(q["rule_id"], self.default) for q in questions]


class Batched:
    """Calls a scorer with at most so many questions at a time."""

    def __init__(self, scorer: Callable[[list[dict]], list[float | None]], size: int = 32):
        self.scorer, self.size = scorer, size

    def __call__(self, questions: Iterable[dict]) -> list[float | None]:
        asked = list(questions)
        return [s for k in range(0, len(asked), self.size) for s in self.scorer(asked[k : k + self.size])]
