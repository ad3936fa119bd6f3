"""Sources written as classes, for feeds that no mapping can express; a dataset's collector block names them."""

from __future__ import annotations

import importlib
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..model import ConfigError


class Source(Protocol):
    """What a class offers. `from_config(dataset, options, folder)` besides, if it takes options."""

    parser: str
    max_age_ms: int | None

    def candidates(self, spark: SparkSession, now_ms: int, timeout: float) -> DataFrame | None:
        """Candidates with `arrival`; None where the provider failed or has nothing new."""


def load_source(dataset: str, block: dict, folder: str = ".") -> Source:
    """The source of a collector block of kind `code`; options that a class would not read are refused."""
    options = {k: v for k, v in block.items() if k not in ("kind", "module", "class")}
    if not block.get("module") or not block.get("class"):
        raise ConfigError(f"{dataset}: a collector of kind code names a module and a class")
    try:
        made = getattr(importlib.import_module(str(block["module"])), str(block["class"]))
    except (ImportError, AttributeError) as e:
        raise ConfigError(f"{dataset}: {e}") from e
    if hasattr(made, "from_config"):
        return made.from_config(dataset, options, folder)
    if options:
        raise ConfigError(f"{dataset}: {block['class']} takes no options: {', '.join(sorted(options))}")
    return made()
