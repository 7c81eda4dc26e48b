"""Configuration: JSON settings with precedence, function registries, library contracts, language overrides, command line."""

from __future__ import annotations

import argparse
import json
import os
import tomllib
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession

NAMES = (".irloom.json", "irloom.json", "config/irloom.json")


@dataclass(frozen=True)
class Config:
    inputs: tuple[str, ...] = ()
    output: str | None = None
    format: str = "text"
    min_severity: str = "low"
    boundary_only: bool = False
    surfaces: tuple[str, ...] = ()
    leak_threshold: float = 0.65
    source_lang: str | None = None
    passes: tuple[str, ...] = ()
    log_level: str = "info"
    custom_rules: tuple[dict, ...] = field(default=())
    contracts: str | None = None  # a file of library contracts


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return from_dict(json.load(f))


def from_dict(given: dict) -> Config:
    known = {f.name for f in fields(Config)}
    unknown = sorted(set(given) - known)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def discover(start: str = ".") -> str | None:
    """The nearest settings file, from start upwards."""
    at = os.path.abspath(start)
    while True:
        for name in NAMES:
            if os.path.isfile(p := os.path.join(at, name)):
                return p
        up = os.path.dirname(at)
        if up == at:
            return None
        at = up


def merge(file: Config, line: dict) -> Config:
    """Command line over file over defaults."""
    return replace(file, **{k: v for k, v in line.items() if v is not None})


def parse_args(argv: list[str]) -> dict:
    """Settings given on the command line; those not given are None."""
    p = argparse.ArgumentParser("irloom")
    p.add_argument("inputs", nargs="*")
    p.add_argument("--output", "-o")
    p.add_argument("--format", choices=["text", "json", "sarif", "html"])
    p.add_argument("--min-severity", dest="min_severity", choices=["low", "medium", "high", "critical"])
    p.add_argument("--boundary-only", dest="boundary_only", action="store_const", const=True)
    p.add_argument("--surfaces", type=lambda s: tuple(s.split(",")))
    p.add_argument("--leak-threshold", dest="leak_threshold", type=float)
    p.add_argument("--source-lang", dest="source_lang")
    p.add_argument("--passes", type=lambda s: tuple(s.split(",")))
    p.add_argument("--log-level", dest="log_level", choices=["debug", "info", "warn", "error"])
    p.add_argument("--contracts")
    p.add_argument("--config")
    out = vars(p.parse_args(argv))
    out["inputs"] = tuple(out["inputs"]) or None
    return out


def as_json(config: Config) -> str:
    return json.dumps(asdict(config), sort_keys=True)


def function_registry(spark: SparkSession, path: str) -> DataFrame:
    """name, family, op, risk from JSON rows."""
    return spark.read.schema("name string, family string, op string, risk string").option("multiLine", True).json(path)


def contracts(spark: SparkSession, toml: str) -> DataFrame:
    """lib, pair, allocate, release, ownership, confidence: one row for each allowed pair of a contract file's text."""
    rows = []
    for lib, body in tomllib.loads(toml).get("contracts", {}).items():
        for pair in body.get("pair", []):
            for a in pair.get("allocate", []):
                for r in pair.get("release", []):
                    rows.append((lib, pair.get("name"), a, r, pair.get("ownership"), float(pair.get("confidence", 0.5))))
    return spark.createDataFrame(rows, "lib string, pair string, allocate string, release string, ownership string, confidence double")


def language_rules(given: dict) -> tuple[list[tuple[str, str, str]], str]:
    """Rules (type, pattern, language) for matching.longest_rule, and the default language."""
    return [(kind, p, lang) for kind in ("exact", "prefix", "suffix") for p, lang in given.get(kind, {}).items()], given.get("default_language", "unknown")
