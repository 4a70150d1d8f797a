"""A catalog of named datasets: ``category/key`` paths of Parquet folders."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Catalog:
    """Names and places of datasets; reading is Spark's."""

    places: dict[str, str] = field(default_factory=dict)

    def register(self, name: str, place: str, replace: bool = False) -> None:
        if "/" not in name:
            raise ValueError("a name is category/key")
        if name in self.places and not replace:
            raise ValueError(f"{name} is registered already")
        self.places[name] = place

    def remove(self, name: str) -> str:
        return self.places.pop(name)

    def merge(self, other: Catalog, policy: str = "error") -> None:
        """Take over another catalog's names; one known already is an error, or its first or last place stays."""
        if policy not in ("error", "first", "last"):
            raise ValueError("policy is 'error', 'first' or 'last'")
        for name, place in other.places.items():
            if name not in self.places or policy != "first":
                self.register(name, place, policy == "last")

    def nested(self) -> dict:
        """Places in a tree of dictionaries."""
        out: dict = {}
        for name in self.names():
            *above, last = name.split("/")
            at = out
            for part in above:
                at = at.setdefault(part, {})
            at[last] = self.places[name]
        return out

    def names(self, below: str | None = None, recursive: bool = True) -> list[str]:
        """Sorted names, below a category if given, or only the next level's."""
        found = sorted(n for n in self.places if below is None or n.startswith(below.rstrip("/") + "/"))
        if recursive:
            return found
        skip = len(below.rstrip("/")) + 1 if below else 0
        return sorted({n[skip:].split("/")[0] for n in found})

    def place(self, name: str) -> str:
        if "/" not in name:
            raise ValueError("a name is category/key")
        return self.places[name]

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(self.place(name))

    def load_experiment(self, spark: SparkSession, name: str, **options):
        """An experiment that ``Experiment.write`` left at the place of ``name``."""
        from helixframe.plans.experiment import Experiment

        return Experiment.read(spark, self.place(name), **options)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.places.items()), "name string, place string")

    def tree(self) -> str:
        lines, seen = [], set()
        for name in self.names():
            parts = name.split("/")
            for depth in range(len(parts)):
                if (at := "/".join(parts[: depth + 1])) not in seen:
                    seen.add(at)
                    lines.append("  " * depth + parts[depth])
        return "\n".join(lines)


def save_options(path: str, options: dict, update: bool = True) -> None:
    """Options as JSON on the driver, merged into those there."""
    import os

    old = {}
    if update and os.path.exists(path):
        with open(path) as f:
            old = json.load(f)
    with open(path, "w") as f:
        json.dump(old | options, f, indent=2, sort_keys=True)
