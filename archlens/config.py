"""Limits and switches, as plain values; a TOML file may override them."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class RuleConfig:
    max_file_tokens: int = 2000
    max_cognitive_complexity: int = 25
    max_nesting_depth: int = 3
    max_function_args: int = 5
    max_function_words: int = 10
    max_lcom4: int = 1
    min_ahf: float = 60.0
    max_cbo: int = 9
    max_sfout: int = 7
    ignore_naming_on: tuple[str, ...] = ()
    ignore_tokens_on: tuple[str, ...] = ()


@dataclass(frozen=True)
class LocalityConfig:
    max_distance: int = 4
    l1_threshold: int = 2
    god_module_threshold: int = 20
    deadwood_threshold: int = 2
    volatile_leaf_efferent: int = 5
    exempt_patterns: tuple[str, ...] = ()
    mode: str = "warn"


@dataclass(frozen=True)
class Config:
    rules: RuleConfig = field(default_factory=RuleConfig)
    locality: LocalityConfig = field(default_factory=LocalityConfig)
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    commands: dict = field(default_factory=dict)


def _known(kind, values: dict):
    names = {f.name for f in fields(kind)}
    return replace(kind(), **{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in names})


def parse_config(toml: str, ignore_file: str = "") -> Config:
    """A file that doesn't parse leaves the defaults. Lines of the ignore file are regular expressions; # starts a comment; bad ones are dropped."""
    try:
        data = tomllib.loads(toml)
    except tomllib.TOMLDecodeError:
        data = {}
    rules = dict(data.get("rules", {}))
    if "max_cyclomatic_complexity" in rules:
        rules.setdefault("max_cognitive_complexity", rules.pop("max_cyclomatic_complexity"))
    return Config(_known(RuleConfig, rules), _known(LocalityConfig, rules.get("locality", {})), exclude=tuple(ignore_patterns(ignore_file)), commands=data.get("commands", {}))


def ignore_patterns(text: str) -> list[str]:
    out = []
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            try:
                re.compile(line)
            except re.error:
                continue
            out.append(line)
    return out


#: Limits of files that look like systems code.
SYSTEMS_SCORE, SYSTEMS_LIMITS = 3, {"max_file_tokens": 10_000, "max_cognitive_complexity": 50, "max_lcom4": 100, "max_cbo": 100}
