"""Experiments: combinations of strategies, each run with its errors kept apart."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Strategy:
    type: str
    params: tuple = ()

    def plain(self) -> dict:
        return {"type": self.type, "params": dict(self.params)}


@dataclass
class Experiment:
    """Lists of strategies by role; cartesian combines each with each, paired the i-th ones (all lists equally long)."""

    name: str
    roles: dict[str, list[Strategy]]
    mode: str = "cartesian"
    seed: int = 0
    errors: dict[str, str] = field(default_factory=dict)

    def combinations(self) -> list[tuple[str, dict[str, Strategy]]]:
        lists = list(self.roles.values())
        if self.mode == "paired":
            if len({len(x) for x in lists}) > 1:
                raise ValueError("paired lists must be equally long")
            rows = zip(*lists)
        elif self.mode == "cartesian":
            rows = itertools.product(*lists)
        else:
            raise ValueError(f"unknown mode {self.mode}")
        out = []
        for row in rows:
            combo = dict(zip(self.roles, row))
            canonical = json.dumps({k: v.plain() for k, v in combo.items()}, sort_keys=True, ensure_ascii=False)
            out.append(("-".join(s.type for s in row) + "-" + hashlib.sha256(canonical.encode()).hexdigest()[:8], combo))
        return out

    def run(self, build: Callable[[str, dict[str, Strategy]], DataFrame], sink: Callable[[str, DataFrame], None]) -> list[str]:
        """Builds and stores every combination; one that fails is noted in errors and doesn't stop the others."""
        done = []
        for name, combo in self.combinations():
            try:
                sink(name, build(name, combo))
                done.append(name)
            except Exception as e:  # kept apart by combination
                self.errors[name] = f"{type(e).__name__}: {e}"
        return done
