"""Settings from the environment (``PLENUM_...``), with defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    folder: str = "data"
    embedding_dimensions: int = 768
    embedding_batch: int = 100
    speaker_threshold: int = 85
    rate_calls: int = 60
    rate_period: float = 60.0
    chunk_size: int = 7
    chunk_overlap: int = 2

    @classmethod
    def read(cls, env: dict[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        kinds = {"str": str, "int": int, "float": float}
        return cls(**{f.name: kinds[f.type](env[f"PLENUM_{f.name.upper()}"]) for f in fields(cls) if f"PLENUM_{f.name.upper()}" in env})
