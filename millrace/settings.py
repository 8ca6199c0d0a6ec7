"""Layered settings with provenance: defaults < environment block < process environment < flags."""

from __future__ import annotations

import argparse
import logging
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

PREFIX = "PIPELINE_"


def coerce(text: str) -> object:
    """true/false and whole numbers of an environment variable become bool and int."""
    low = text.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    return int(low) if re.fullmatch(r"-*[0-9]+", low) and low.count("-") <= 1 else text


@dataclass(frozen=True)
class Settings:
    values: dict[str, object]
    origin: dict[str, str] = field(default_factory=dict)

    def __getitem__(self, name: str) -> object:
        return self.values[name]

    def rows(self) -> list[tuple[str, str, str]]:
        """(setting, value, came from) in the order of the defaults."""
        return [(k, str(v), self.origin[k]) for k, v in self.values.items()]


def resolve(defaults: Mapping, environments: Mapping[str, Mapping], env: str, process: Mapping[str, str] | None = None, flags: Mapping[str, object] | None = None) -> Settings:
    """The last layer that names a setting wins; a flag that is None was not given.

    An unknown environment leaves the defaults, and is logged.
    """
    process = os.environ if process is None else process
    values, origin = dict(defaults), dict.fromkeys(defaults, "defaults")
    if env not in environments:
        logging.getLogger(__name__).warning("environment %s is not configured; defaults hold", env)
    for k, v in environments.get(env, {}).items():
        values[k], origin[k] = v, f"environments.{env}"
    for k in list(values):
        if (name := PREFIX + k.upper()) in process:
            values[k], origin[k] = coerce(process[name]), f"env var {name}"
    for k, v in (flags or {}).items():
        if v is not None:
            values[k], origin[k] = v, f"flag --{k.replace('_', '-')}"
    return Settings(values, origin)


def load(path: str, env: str, **layers) -> Settings:
    """Settings of a YAML file with ``defaults`` and ``environments``."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    return resolve(found["defaults"], found.get("environments", {}), env, **layers)


def parser(defaults: Mapping) -> argparse.ArgumentParser:
    """A flag for each setting, None unless given; integers are typed, switches only switch on."""
    out = argparse.ArgumentParser()
    out.add_argument("--env", default="dev")
    for k, v in defaults.items():
        name = f"--{k.replace('_', '-')}"
        if isinstance(v, bool):
            out.add_argument(name, action="store_true", default=None)
        else:
            out.add_argument(name, type=int if isinstance(v, int) else str, default=None)
    return out


def secret(name: str, process: Mapping[str, str] | None = None) -> str:
    """A secret, only ever from the process environment; raises if it is unset."""
    process = os.environ if process is None else process
    if not process.get(name):
        raise KeyError(f"{name} is not set")
    return process[name]


def mask(value: str | None) -> str:
    return "(not set)" if not value else "****"
