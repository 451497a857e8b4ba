"""Settings from the environment with defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    threshold: float = 0.55
    top_k: int = 3
    seed: int = 42
    image_size: int = 224
    batch_size: int = 32
    workers: int = 4

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, prefix: str = "FOLIANT_") -> Config:
        """Values of FOLIANT_THRESHOLD and so on; blanks count as unset."""
        env = os.environ if env is None else env
        given = {f.name: env.get(prefix + f.name.upper(), "").strip() for f in fields(cls)}
        return cls(**{f.name: type(f.default)(given[f.name]) for f in fields(cls) if given[f.name]})
