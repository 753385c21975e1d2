"""Settings of answer validation, from defaults, the environment and overrides, in this order; all checked."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields

PREFIX = "LOAMSTACK_"


@dataclass(frozen=True)
class ValidationConfig:
    """Risks below ``low`` are low, below ``medium`` medium, below ``high`` high, all others critical."""

    low: float = 0.25
    medium: float = 0.5
    high: float = 0.75
    default_risk: float = 0.5
    least_context: int = 50
    most_context: int = 8000
    cache: bool = True
    cache_seconds: int = 3600
    cache_entries: int = 1000
    timeout_seconds: float = 30.0
    retries: int = 3
    retry_delay: float = 1.0
    issues: bool = True
    suggestions: bool = True
    backend: str = "default"
    model: str | None = None

    def __post_init__(self):
        for name in ("low", "medium", "high", "default_risk"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie between 0 and 1")
        if not self.low < self.medium < self.high:
            raise ValueError("thresholds must rise: low, medium, high")
        for name in ("least_context", "cache_seconds", "cache_entries", "timeout_seconds", "retries", "retry_delay"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.least_context > self.most_context:
            raise ValueError("least_context must not exceed most_context")

    def level(self, risk: float) -> str:
        return "low" if risk < self.low else "medium" if risk < self.medium else "high" if risk < self.high else "critical"

    def takes(self, context: str | None) -> bool:
        return self.least_context <= len(context or "") <= self.most_context

    def as_dict(self) -> dict:
        return asdict(self)


def _typed(kind: str, text: str):
    if kind == "bool":
        if text.lower() not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
            raise ValueError(f"not a truth value: {text}")
        return text.lower() in ("1", "true", "yes", "on")
    return {"int": int, "float": float}.get(kind.split(" ")[0], str)(text)


def from_env(env: Mapping[str, str] | None = None, **overrides) -> ValidationConfig:
    """Settings named LOAMSTACK_<FIELD>; overrides that aren't None come last."""
    env = os.environ if env is None else env
    read = {f.name: _typed(str(f.type), env[PREFIX + f.name.upper()]) for f in fields(ValidationConfig) if env.get(PREFIX + f.name.upper())}
    return ValidationConfig(**(read | {k: v for k, v in overrides.items() if v is not None}))
