"""Runs of stages: cached by the hash of their settings and inputs, invalidated downstream, isolated by run."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import product

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def signature(settings: object, *inputs: str) -> str:
    """SHA-256 of canonical JSON and the signatures of what comes before."""
    return hashlib.sha256(json.dumps([settings, *inputs], sort_keys=True, default=str).encode()).hexdigest()


@dataclass
class Stage:
    name: str
    make: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict)


class StageRun:
    """Stages as Parquet tables in a folder; a stage is redone if its signature or an earlier one changed.

    A table counts as done once a second, one-row table says so, so a lost driver or executor
    never leaves a half-written stage in use.
    """

    def __init__(self, spark: SparkSession, folder: str, stages: Iterable[Stage]):
        self.spark, self.folder, self.stages = spark, folder.rstrip("/"), {s.name: s for s in stages}
        self.made: list[str] = []

    def signature_of(self, name: str) -> str:
        s = self.stages[name]
        return signature([name, s.settings], *(self.signature_of(n) for n in s.needs))

    def table(self, name: str) -> DataFrame:
        """The stage's table, made now unless one of this signature is there."""
        path = f"{self.folder}/{name}-{self.signature_of(name)[:12]}"
        if not self._done(path):
            s = self.stages[name]
            s.make(*(self.table(n) for n in s.needs), **s.settings).write.mode("overwrite").parquet(path)
            self.spark.range(1).write.mode("overwrite").parquet(f"{path}-done")
            self.made.append(name)
        return self.spark.read.parquet(path)

    def _done(self, path: str) -> bool:
        try:
            return self.spark.read.parquet(f"{path}-done").count() == 1
        except AnalysisException:  # no such table yet
            return False


def sweep(dimensions: dict[str, list], excluded: list[dict]) -> list[dict]:
    """Every combination of settings that no rule excludes; a rule names some settings, the others are free."""
    every = [dict(zip(dimensions, values, strict=True)) for values in product(*dimensions.values())]
    return [c for c in every if not any(all(c[k] == v for k, v in rule.items()) for rule in excluded)]


def plan(wanted: list[dict], finished: set[str], started: set[str]) -> list[tuple[dict, str]]:
    """keep, resume or run for each combination, by the signatures that are there."""
    state = lambda s: "keep" if s in finished else "resume" if s in started else "run"
    return [(c, state(signature(c))) for c in wanted]


def each_isolated(names: list[str], run: Callable[[str], object]) -> tuple[dict[str, object], dict[str, str]]:
    """Runs one by one; a failure is recorded and the others go on. Returns results and errors."""
    done, failed = {}, {}
    for n in names:
        try:
            done[n] = run(n)
        except Exception as e:
            failed[n] = f"{type(e).__name__}: {e}"
    return done, failed
