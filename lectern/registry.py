"""Plug-ins by name: chunkers, rerankers, generators, judges, prompts, analysers, metrics (UD-10)."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry:
    def __init__(self, kind: str):
        self.kind, self._found = kind, {}

    def register(self, name: str) -> Callable[[Any], Any]:
        def keep(x: Any) -> Any:
            self._found[name] = x
            return x

        return keep

    def get(self, name: str) -> Any:
        if name not in self._found:
            raise ValueError(f"no {self.kind} named {name!r}; there are {', '.join(sorted(self._found))}")
        return self._found[name]

    def names(self) -> list[str]:
        return sorted(self._found)


chunkers = Registry("chunker")
rerankers = Registry("reranker")
generators = Registry("generator")
generation_prompts = Registry("generation prompt")
judges = Registry("judge")
judge_prompts = Registry("judge prompt")
split_analyzers = Registry("split-point analyser")
retrieval_analyzers = Registry("retrieval analyser")
embedding_analyzers = Registry("embedding analyser")
embedding_metrics = Registry("embedding metric")
