"""Named queries over a data folder, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklake.bindings import Domain, duck


@dataclass
class Registry:
    makers: dict[str, Callable[[Domain], DataFrame]] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, oracle: str | None = None, recursive: bool = False):
        """Decorator: registers a query and, where SQL can say it on whole tables, its oracle."""

        def keep(make: Callable[[Domain], DataFrame]):
            if name in self.makers:
                raise ValueError(f"duplicate query {name}")
            self.makers[name] = make
            if oracle is not None:
                self.oracles[name] = duck(oracle, recursive)
            return make

        return keep

    def queries(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        def bind(make):
            return lambda spark, sf_dir: plain(make(Domain(spark, sf_dir)))

        return {name: bind(make) for name, make in self.makers.items()}


def plain(df: DataFrame) -> DataFrame:
    """Columns as bigint, double (6 decimals), boolean or string, so that engines compare equal."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(f.name))
    return df.select(*out)
