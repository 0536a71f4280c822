"""Two copies of a data model compared by platform-stable keys.

Local ids differ between the copies, so references are resolved first, table by table in the order of their
dependencies: a reference becomes the stable name of its row, which may itself hold resolved references. A reference
whose row is not there is marked and keeps the local value, so such rows never look equal by accident.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reports import semantic_diff


@dataclass
class Spec:
    """keys name a row on the platform; local is its id in the copy; refs are columns that hold local ids of other tables."""

    name: str
    keys: list[str]
    local: str | None = None
    refs: dict[str, str] = field(default_factory=dict)
    ignore: tuple[str, ...] = ()


def in_order(specs: list[Spec]) -> list[Spec]:
    """Parents before children; a cycle is an error."""
    left, done, out = {s.name: s for s in specs}, set(), []
    while left:
        ready = [s for s in left.values() if all(p in done or p not in left for p in s.refs.values())]
        if not ready:
            raise ValueError(f"references form a cycle: {sorted(left)}")
        for s in ready:
            out.append(left.pop(s.name))
            done.add(s.name)
    return out


def resolve(tables: dict[str, DataFrame], specs: list[Spec]) -> dict[str, DataFrame]:
    """The tables with references as stable names, without local ids and ignored columns."""
    names: dict[str, DataFrame] = {}
    out = {}
    for s in in_order(specs):
        df = tables[s.name]
        for column, parent in s.refs.items():
            missing = F.when(F.col(column).isNotNull(), F.concat(F.lit(f"<missing:{column}="), F.col(column).cast("string"), F.lit(">")))
            if parent not in names:
                df = df.withColumn(column, missing)
                continue
            df = df.join(names[parent].withColumnsRenamed({"__local": column}), column, "left")
            df = df.withColumn(column, F.coalesce("__stable", missing)).drop("__stable")
        stable = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in s.keys))
        if s.local:
            names[s.name] = df.select(F.col(s.local).alias("__local"), stable.alias("__stable"))
        out[s.name] = df.drop(*([s.local] if s.local and s.local not in s.keys else []), *s.ignore)
    return out


def compare(baseline: dict[str, DataFrame], candidate: dict[str, DataFrame], specs: list[Spec]) -> DataFrame:
    """table_name, key, status (missing, content, extra) of all rows that differ, over all tables."""
    a, b = resolve(baseline, specs), resolve(candidate, specs)
    parts = []
    for s in specs:
        found = semantic_diff(a[s.name], b[s.name].select(*a[s.name].columns), s.keys)
        key = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in s.keys))
        parts.append(found.select(F.lit(s.name).alias("table_name"), key.alias("key"), "status"))
    return reduce(DataFrame.unionByName, parts)
