"""Models and recognisers behind plain functions: lists of texts in, answers out.

The registered defaults are deterministic and work offline.  A networked model is a function of the same shape; it is
called in Arrow batches on executors, so it should batch its requests and keep its own client.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Provider = Callable[[list[str]], list[str]]
PROVIDERS: dict[str, Provider] = {}


def provider(name: str) -> Callable[[Provider], Provider]:
    def add(f: Provider) -> Provider:
        PROVIDERS[name] = f
        return f

    return add


def get(name: str) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"no provider {name!r}; there are {sorted(PROVIDERS)}")
    return PROVIDERS[name]


@provider("lead")
def lead(prompts: list[str], sentences: int = 2) -> list[str]:
    """The first sentences of each prompt."""
    return [" ".join([s for s in re.split(r"(?<=[.!?])\s+|\n+", p.strip()) if s][:sentences]) for p in prompts]


@provider("lines")
def lines(prompts: list[str]) -> list[str]:
    """Each sentence as a bullet: claims for tests."""
    return ["\n".join(f"- {s}" for s in re.split(r"(?<=[.!?])\s+|\n+", p.strip()) if s) for p in prompts]


@provider("echo")
def echo(prompts: list[str]) -> list[str]:
    return list(prompts)
