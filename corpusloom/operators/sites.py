"""Rules chosen by site: a registry of column functions, one for each host suffix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = Callable[[Column], Column]


class Registry:
    """Rules by host suffix; the longest suffix that fits a host decides, else the default."""

    def __init__(self, default: Rule):
        self.default = default
        self.rules: dict[str, Rule] = {}

    def add(self, suffix: str, rule: Rule) -> None:
        if suffix in self.rules:
            raise ValueError(f"{suffix} has a rule already")
        self.rules[suffix] = rule

    def apply(self, host: Column, value: Column) -> Column:
        """One CASE over the sites: Spark reads each row by its own rule, and no site needs a pass of its own."""
        out = self.default(value)
        for suffix in sorted(self.rules, key=len):
            out = F.when((host == suffix) | host.endswith("." + suffix), self.rules[suffix](value)).otherwise(out)
        return out
