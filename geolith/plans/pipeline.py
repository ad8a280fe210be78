"""Declared pipelines: named steps over DataFrames, locked inputs, published outputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from geolith.sources.write import config_hash, manifest, manifest_differences, publish

Step = Callable[[SparkSession, dict[str, DataFrame]], dict[str, DataFrame]]


@dataclass
class Plugin:
    """A step that others can add: what it reads, makes and promises."""

    plugin_id: str
    version: str
    inputs: tuple[str, ...]
    output: str
    run: Step
    parameters: dict = field(default_factory=dict)
    quality_controls: tuple[Callable[[DataFrame], DataFrame], ...] = ()


@dataclass
class Pipeline:
    """Steps in order; each gets all tables made so far and adds its own."""

    config: dict
    steps: list[tuple[str, Step]] = field(default_factory=list)
    controls: dict[str, list[Callable[[DataFrame], DataFrame]]] = field(default_factory=dict)

    def step(self, name: str) -> Callable[[Step], Step]:
        def add(f: Step) -> Step:
            self.steps.append((name, f))
            return f

        return add

    def plug(self, plugin: Plugin) -> None:
        def run(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
            missing = [i for i in plugin.inputs if i not in tables]
            if missing:
                raise ValueError(f"{plugin.plugin_id}: no input {missing}")
            out = plugin.run(spark, {i: tables[i] for i in plugin.inputs})
            if set(out) != {plugin.output}:
                raise ValueError(f"{plugin.plugin_id}: outputs {sorted(out)}")
            return out

        self.steps.append((plugin.plugin_id, run))
        self.controls.setdefault(plugin.output, []).extend(plugin.quality_controls)

    def run(self, spark: SparkSession, inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The tables that the steps make. A control that returns rows is an error."""
        tables = dict(inputs)
        for name, f in self.steps:
            made = f(spark, tables)
            if again := [t for t in made if t in inputs]:
                raise ValueError(f"{name} replaces inputs: {again}")
            tables |= made
        for table, controls in self.controls.items():
            for control in controls:
                if control(tables[table]).limit(1).count():
                    raise ValueError(f"{table}: a quality control failed")
        return {k: v for k, v in tables.items() if k not in inputs}

    def build(self, spark: SparkSession, inputs: dict[str, DataFrame], target: str, outputs: list[str]) -> None:
        """Run and publish exactly the declared outputs."""
        made = self.run(spark, inputs)
        if missing := [o for o in outputs if o not in made]:
            raise ValueError(f"not made: {missing}")
        publish(spark, {o: made[o] for o in outputs}, target)

    def lock(self, spark: SparkSession, path: str) -> dict:
        """Hashes of the input files and of the configuration. A bounded set of files is listed on the driver."""
        return {"config": config_hash(self.config), "files": [r.asDict() for r in manifest(spark, path).orderBy("path").collect()]}

    def check_lock(self, spark: SparkSession, path: str, lock: dict) -> list[tuple[str, str]]:
        """Files that differ from the lock, and ``config`` if the configuration does."""
        expected = spark.createDataFrame([(f["path"], f["bytes"], f["sha256"]) for f in lock["files"]], "path STRING, bytes BIGINT, sha256 STRING")
        rows = [(r["path"], r["status"]) for r in manifest_differences(manifest(spark, path), expected).collect()]
        return rows + [("config", "changed")] * (config_hash(self.config) != lock["config"])


def region_errors(config: dict) -> list[str]:
    """What is wrong with a region's declaration."""
    out = []
    layers = config.get("layers") or {}
    if not layers:
        out.append("no layers")
    for name, layer in layers.items():
        bins = [b.get("max") for b in layer.get("bins", [])]
        known = [b for b in bins if b is not None]
        if bins and not layer.get("value_field"):
            out.append(f"{name}: bins without value_field")
        if known != sorted(set(known)) or None in bins[:-1]:
            out.append(f"{name}: bins must ascend, an open one last")
        if layer.get("categories") and not layer.get("category_field"):
            out.append(f"{name}: categories without category_field")
        if not layer.get("file"):
            out.append(f"{name}: no file")
    if set(config.get("expected", {})) - set(layers):
        out.append("expected counts of unknown layers")
    return out


