"""Configuration of a run: repositories, sampling, incremental measurement and acceptance limits."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from evispark.operators.metrics import Limits

# Repository sizes and how many files of each a review samples (0: all).
SAMPLES = {"small": 0, "medium": 20, "large": 30}
REPOSITORIES = 3


@dataclass(frozen=True)
class Repository:
    """path: a folder of tables (nodes, edges, files, ast_nodes, manifests) that Spark can read."""

    id: str
    size: str
    path: str


@dataclass(frozen=True)
class Config:
    repositories: tuple[Repository, ...]
    output: str
    trials: int = 3
    timeout_ms: float = 10_000
    samples: dict[str, int] = field(default_factory=lambda: dict(SAMPLES))
    seed: str = "review-v1"
    limits: Limits = Limits()

    def repository(self, name: str) -> Repository:
        for repo in self.repositories:
            if repo.id == name:
                return repo
        raise ValueError(f"unknown repository id: {name}")


def require(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def load(path: str) -> Config:
    """A checked configuration; relative paths are taken from the file's folder."""
    with open(path, encoding="utf8") as f:
        raw = json.load(f)
    base = os.path.dirname(os.path.abspath(path))
    at = lambda p: p if "://" in p else os.path.normpath(os.path.join(base, p))
    repos = raw.get("repositories")
    require(isinstance(repos, list) and len(repos) == REPOSITORIES, f"repositories must be a list of {REPOSITORIES}")
    for r in repos:
        require(isinstance(r, dict) and all(isinstance(r.get(k), str) and r[k] for k in ("id", "path")), "a repository needs an id and a path")
        require(r.get("size") in SAMPLES, f"size must be one of {', '.join(SAMPLES)}")
    incremental, sampling, accept = raw.get("incremental", {}), raw.get("sampling", {}), raw.get("acceptance", {})
    trials, timeout = incremental.get("trials", 3), incremental.get("timeoutMs", 10_000)
    require(isinstance(trials, int) and trials > 0 and timeout > 0, "trials and timeoutMs must be positive")
    samples = {size: sampling.get(size, n) for size, n in SAMPLES.items()}
    require(all(isinstance(n, int) and n >= 0 for n in samples.values()), "sample sizes must be whole numbers from 0")
    rates = [accept.get(k, d) for k, d in (("fileCoverage", 0.95), ("entityRecall", 0.85), ("edgePrecision", 0.90))]
    require(all(0 <= r <= 1 for r in rates), "acceptance rates must lie between 0 and 1")
    staleness = accept.get("incrementalStalenessMs", 5000)
    require(staleness > 0, "incrementalStalenessMs must be positive")
    return Config(tuple(Repository(r["id"], r["size"], at(r["path"])) for r in repos), at(raw.get("outputDirectory", "./results")), trials, timeout, samples, sampling.get("seed", "review-v1"), Limits(*rates, staleness))
