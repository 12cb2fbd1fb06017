"""Registry of language models and embedders; hosted ones are plugins that a user registers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

from quarry.functions.text import fake_embedding, model_slug


@dataclass(frozen=True)
class Completion:
    content: str
    model: str
    prompt_tokens: int | None = None
    completion_tokens: int | None = None


class LanguageModel(Protocol):
    name: str
    model: str

    def complete(self, messages: list[dict[str, str]], *, temperature: float = 0.0, max_tokens: int = 1024) -> Completion: ...


@dataclass(frozen=True)
class Embedder:
    """``embed`` makes a vector column of a text column."""

    name: str
    model: str
    dim: int
    embed: Callable

    @property
    def slug(self) -> str:
        return model_slug(self.model)


_models: dict[str, Callable[[str], LanguageModel]] = {}
_embedders: dict[str, Callable[[str], Embedder]] = {"fake": lambda model: Embedder("fake", model or "fake", 8, fake_embedding)}


def register_model(name: str, make: Callable[[str], LanguageModel]) -> None:
    _models[name] = make
    get_model.cache_clear()


def register_embedder(name: str, make: Callable[[str], Embedder]) -> None:
    _embedders[name] = make
    get_embedder.cache_clear()


@lru_cache
def get_model(name: str, model: str = "") -> LanguageModel:
    if name not in _models:
        raise ValueError(f"unknown language model provider {name!r}")
    return _models[name](model)


@lru_cache
def get_embedder(name: str = "fake", model: str = "") -> Embedder:
    if name not in _embedders:
        raise ValueError(f"unknown embedder {name!r}")
    return _embedders[name](model)
