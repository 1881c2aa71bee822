"""Settings of runs: folders and default amounts, from the environment or given."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


class ConfigError(ValueError):
    """A setting that no run can use."""


LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


@dataclass
class Config:
    datasets_dir: str = "datasets"
    outputs_dir: str = "outputs"
    default_chunk_size: int = 1000
    default_num_chunks: int = 4
    log_level: str = "INFO"

    @classmethod
    def from_env(cls, prefix: str = "LUMENFOLD_") -> Config:
        given = {f.name: os.environ[key] for f in fields(cls) if (key := prefix + f.name.upper()) in os.environ}
        try:
            return cls(**{k: int(v) if k.startswith("default_") else v for k, v in given.items()})
        except ValueError as error:
            raise ConfigError(str(error)) from error

    def validate(self) -> None:
        for name in ("default_chunk_size", "default_num_chunks"):
            if getattr(self, name) <= 0:
                raise ConfigError(f"{name} must be positive")
        if self.log_level.upper() not in LEVELS:
            raise ConfigError(f"log_level must be one of {LEVELS}")
