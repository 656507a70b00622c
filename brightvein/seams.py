"""What the engine asks of models and stores: plain callables, so that a caller can put in their own.

Each has a deterministic stand-in for tests and dry runs. A callable that can't
answer raises `Unavailable`; what it was needed for then goes on without it and
says so in a `degraded` list.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field


class Unavailable(RuntimeError):
    """A model or store can't be reached."""


class Truncated(RuntimeError):
    """A generator had to cut its prompt."""


class WrongShape(ValueError):
    """A generator's answer breaks the contract."""


#: Embeds a batch of texts: one vector each.
Embedder = Callable[[list[str]], list[list[float]]]
#: Scores a query against a batch of texts.
Reranker = Callable[[str, list[str]], list[float]]
#: Answers a prompt with JSON.
Generator = Callable[[str], str]
#: Counts the tokens of a text.
TokenCounter = Callable[[str], int]
#: Finds pages' blocks or tables in a file's bytes: rows as dicts.
Detector = Callable[[bytes], Iterable[dict]]


def estimated_tokens(text: str) -> int:
    return len(text) // 4 + 1


def word_tokens(text: str) -> int:
    return len(text.split())


def stand_in_embedder(dimensions: int = 32) -> Embedder:
    """Unit vectors from digests of the text and a counter; equal texts get equal vectors."""

    def one(text: str) -> list[float]:
        raw = b"".join(hashlib.sha256(i.to_bytes(4, "big") + text.encode()).digest() for i in range(-(-dimensions // 8)))
        values = [x / 2**31 - 1.0 for (x,) in struct.iter_unpack(">I", raw)][:dimensions]
        norm = sum(x * x for x in values) ** 0.5
        return [x / norm for x in values] if norm else values

    return lambda texts: [one(t) for t in texts]


def stand_in_reranker(query: str, texts: list[str]) -> list[float]:
    """The first eight bytes of the digest of query, a zero byte and text, as a share of 2**64."""
    return [int.from_bytes(hashlib.sha256(f"{query}\0{t}".encode()).digest()[:8], "big") / 2**64 for t in texts]


@dataclass
class StandInGenerator:
    """Answers with one claim that cites the first passage of the prompt, or fails as told."""

    claim: str = "As the passage says."
    fails: Exception | None = None
    prompts: list[str] = field(default_factory=list)

    def __call__(self, prompt: str) -> str:
        self.prompts.append(prompt)
        if self.fails is not None:
            raise self.fails
        at = prompt.find('<passage id="')
        if at < 0:
            return json.dumps({"answerable": False, "claims": []})
        first = int(prompt[at + 13 : prompt.index('"', at + 13)])
        return json.dumps({"answerable": True, "claims": [{"text": self.claim, "citations": [first]}]})


@dataclass
class Recorder:
    """Keeps what was done and how long it took."""

    stages: list[tuple[str, float]] = field(default_factory=list)

    def __call__(self, stage: str, seconds: float) -> None:
        self.stages.append((stage, seconds))

    def total(self) -> float:
        return sum(s for _, s in self.stages)
