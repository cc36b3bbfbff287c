"""Engine settings: frozen, checked when read from a mapping."""

from __future__ import annotations

import difflib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

TYPES = ("episodic", "semantic", "procedural", "research")
STATUSES = ("ativo", "arquivado", "deprecado")
CONFIDENCE = ("low", "medium", "high")


class ConfigError(ValueError):
    """A setting is unknown or out of range."""


def suggest(word: str, known: list[str]) -> str:
    near = difflib.get_close_matches(word, known, 1)
    return f"; did you mean {near[0]!r}?" if near else ""


@dataclass(frozen=True)
class Retrieval:
    vector_weight: float = 0.6
    bm25_weight: float = 0.4
    hops_default: int = 1
    hops_max: int = 2
    rerank: bool = False


@dataclass(frozen=True)
class Maintenance:
    decay_days: int = 90
    proc_stale_days: int = 180
    hot_days: int = 21
    dedup_similarity: float = 0.92


@dataclass(frozen=True)
class Scopes:
    default: str = "global"
    known: tuple[str, ...] = ()


@dataclass(frozen=True)
class Agent:
    name: str
    profiles: tuple[str, ...] = ()


@dataclass(frozen=True)
class Frontmatter:
    denylist_keys: tuple[str, ...] = ()
    denylist_tags: tuple[str, ...] = ()


@dataclass(frozen=True)
class Manifest:
    retrieval: Retrieval = field(default_factory=Retrieval)
    maintenance: Maintenance = field(default_factory=Maintenance)
    scopes: Scopes = field(default_factory=Scopes)
    frontmatter: Frontmatter = field(default_factory=Frontmatter)
    agents: tuple[Agent, ...] = ()
    research_enabled: bool = True
    reject_unverified: bool = False

    def agent(self, name: str) -> Agent:
        for a in self.agents:
            if a.name == name:
                return a
        raise ConfigError(f"unknown agent {name!r}{suggest(name, [a.name for a in self.agents])}")

    @classmethod
    def read(cls, raw: Mapping[str, Any]) -> Manifest:
        """Settings from nested mappings; an unknown key or a bad value is an error."""
        made = _build(cls, raw, "")
        r, m = made.retrieval, made.maintenance
        if abs(r.vector_weight + r.bm25_weight - 1) > 1e-9 or min(r.vector_weight, r.bm25_weight) < 0:
            raise ConfigError("retrieval: the weights must not be negative and sum to 1")
        if r.rerank:
            raise ConfigError("retrieval.rerank: not available")
        if not 0 <= r.hops_default <= r.hops_max:
            raise ConfigError("retrieval: hops_default must be between 0 and hops_max")
        if not 0 < m.dedup_similarity <= 1 or min(m.decay_days, m.proc_stale_days, m.hot_days) < 0:
            raise ConfigError("maintenance: a value is out of range")
        return made


def _build(kind: type, raw: Mapping[str, Any], at: str) -> Any:
    if not isinstance(raw, Mapping):
        raise ConfigError(f"{at or 'manifest'}: expected a mapping")
    known = {f.name: f for f in fields(kind)}
    values = {}
    for key, value in raw.items():
        if key not in known:
            raise ConfigError(f"unknown key {at + key!r}{suggest(str(key), list(known))}")
        values[key] = _value(kind, known[key], value, f"{at}{key}")
    return kind(**values)


def _value(kind: type, f: Any, value: Any, at: str) -> Any:
    sample = getattr(kind(), f.name) if kind is not Agent else (() if f.name == "profiles" else "")
    if is_dataclass(sample):
        return _build(type(sample), value, f"{at}.")
    if f.name == "agents":
        return tuple(_build(Agent, a, f"{at}.") for a in value)
    if isinstance(sample, tuple):
        if isinstance(value, str) or not all(isinstance(x, str) for x in value):
            raise ConfigError(f"{at}: expected a list of strings")
        return tuple(value)
    if isinstance(sample, bool) != isinstance(value, bool) or not isinstance(value, (int, float) if isinstance(sample, float) else type(sample)):
        raise ConfigError(f"{at}: expected {type(sample).__name__}")
    return float(value) if isinstance(sample, float) else value
