"""Passes: functions of a module's tables, in a registry with their dependencies. A detector gives issue rows; a view gives a table
of facts that detectors, the report and users read (``facts``)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irloom.functions.storage import materialise
from irloom.operators.graph import pass_order
from irloom.sources.ir_text import Module

COLUMNS = ["module_id", "func", "ordinal", "kind", "severity", "confidence", "message"]


@dataclass(frozen=True)
class Pass:
    name: str
    deps: tuple[str, ...]
    run: Callable[[Module], DataFrame]
    is_view: bool = False


REGISTRY: dict[str, Pass] = {}


def detector(name: str, deps: tuple[str, ...] = ()):
    def add(f: Callable[[Module], DataFrame]):
        REGISTRY[name] = Pass(name, deps, f)
        return f

    return add


def view(name: str, deps: tuple[str, ...] = ()):
    def add(f: Callable[[Module], DataFrame]):
        REGISTRY[name] = Pass(name, deps, f, True)
        return f

    return add


def facts(module: Module, name: str) -> DataFrame:
    """The table of a view. It is made once for a module and kept in shared storage."""
    order()
    if name not in module.kept:
        module.kept[name] = materialise(REGISTRY[name].run(module), f"view-{name}")
    return module.kept[name]


def issue(df: DataFrame, kind: str, severity, confidence, message: str) -> DataFrame:
    """Issue rows of df (module_id, func, ordinal)."""
    wrap = lambda v: v if hasattr(v, "alias") else F.lit(v)
    return df.select("module_id", "func", F.col("ordinal").cast("int").alias("ordinal"), F.lit(kind).alias("kind"), wrap(severity).alias("severity"), wrap(confidence).cast("double").alias("confidence"), F.lit(message).alias("message"))


def order() -> list[str]:
    from irloom.passes import boundary, ffi, memory, safety  # noqa: F401  they register themselves

    return pass_order({n: list(p.deps) for n, p in REGISTRY.items()})


def run(module: Module, only: list[str] | None = None) -> DataFrame:
    """Issues of all detectors (or of some), with the name of their pass."""
    out = None
    for name in order():
        if (only is None or name in only) and not REGISTRY[name].is_view:
            found = REGISTRY[name].run(module).withColumn("pass", F.lit(name))
            out = found if out is None else out.unionByName(found)
    return out
