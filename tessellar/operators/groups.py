"""Small groups of rows, one after the other in a task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def per_group(rows: DataFrame, keys: list[str], work: Callable[[tuple, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """work(key, the other columns of its rows) -> rows of schema, for each group of keys. A task holds one group at a time."""
    rest = [c for c in rows.columns if c not in keys]
    names, n = StructType.fromDDL(schema).names, len(keys)

    def run(parts):
        import pandas as pd

        key, held = None, []
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False, name=None):
                if r[:n] != key:
                    if held:
                        out += work(key, held)
                    key, held = r[:n], []
                held.append(r[n:])
            if out:
                yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(work(key, held), columns=names)

    return rows.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
