"""Column roles and schemas: callers' names become canonical ones once, on the way in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MissingColumnsError(ValueError):
    """Raised when a table lacks columns that an operator needs."""


def require_columns(frame: DataFrame, *names: str) -> DataFrame:
    """The frame itself, if it has all these columns."""
    missing = [n for n in names if n not in frame.columns]
    if missing:
        raise MissingColumnsError(f"missing columns {missing}; there are {frame.columns}")
    return frame


OBSERVATION = T.StructType([T.StructField(n, t) for n, t in (("obs_id", T.LongType()), ("project", T.StringType()), ("line", T.LongType()), ("seq", T.LongType()), ("lat", T.DoubleType()), ("lon", T.DoubleType()), ("h", T.DoubleType()), ("g", T.DoubleType()))])


@dataclass(frozen=True)
class ColumnRoles:
    """Names that a caller's table uses. height None: zero heights (the design step's special case)."""

    lat: str
    lon: str
    height: str | None = None
    value: str | None = None
    project: str | None = None
    line: str | None = None
    key: str | None = None

    def apply(self, frame: DataFrame) -> DataFrame:
        """Canonical columns; text that is no number becomes NULL, as do NaNs."""
        roles = (("lat", self.lat), ("lon", self.lon), ("h", self.height), ("g", self.value))
        require_columns(frame, *(n for _, n in roles if n), *(n for n in (self.project, self.line, self.key) if n))

        def number(name: str) -> F.Column:
            return F.nanvl(F.col(f"`{name}`").try_cast("double"), F.lit(None).cast("double"))

        chosen = [(number(n) if n else F.lit(0.0)).alias(role) for role, n in roles if n or role == "h"]
        if self.key:
            chosen.insert(0, F.col(f"`{self.key}`").cast("long").alias("obs_id"))
        if self.project:
            chosen.append(F.col(f"`{self.project}`").cast("string").alias("project"))
        if self.line:
            chosen.append(F.col(f"`{self.line}`").try_cast("double").cast("long").alias("line"))
        return frame.select(*chosen)
