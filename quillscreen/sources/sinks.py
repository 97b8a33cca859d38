"""Sinks: flat CSV with a fixed column order, JSON lines, and Markdown tables of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECRET = r"(?i)key|token|secret|password|authorization"


def flat(d: DataFrame, columns: list[str]) -> DataFrame:
    """All of ``columns`` as strings in that order: arrays joined by '; ', maps and structs as JSON, missing columns and nulls empty."""
    kinds = dict(d.dtypes)

    def one(c: str):
        if c not in kinds:
            return F.lit("")
        v = F.array_join(F.transform(c, lambda x: x.cast("string")), "; ") if kinds[c].startswith("array") and "struct" not in kinds[c] else F.to_json(c) if kinds[c].startswith(("map", "struct", "array")) else F.col(c).cast("string")
        return F.coalesce(v, F.lit(""))

    return d.select(*[one(c).alias(c) for c in columns])


def write_csv(d: DataFrame, path: str, columns: list[str], single: bool = False) -> None:
    """``single`` is for reports of a few rows; large results keep their partitions."""
    out = flat(d, columns)
    (out.coalesce(1) if single else out).write.mode("overwrite").csv(path, header=True, escape='"')


def write_json(d: DataFrame, path: str) -> None:
    d.write.mode("overwrite").json(path)


def redacted(details):
    """A string map with the values of secret-looking keys masked."""
    return F.transform_values(details, lambda k, v: F.when(k.rlike(SECRET), "[redacted]").otherwise(v))


def markdown(d: DataFrame, rows: int = 50) -> str:
    """The first ``rows`` rows as a Markdown table; bars and line breaks in cells are escaped."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    body = [[cell(r[c]) for c in d.columns] for r in flat(d, d.columns).limit(rows).collect()]
    return "\n".join("| " + " | ".join(x) + " |" for x in [d.columns, ["---"] * len(d.columns), *body])
