"""Incremental per-family cap (ST1): rows pass until their family has its quota, across micro-batches and restarts.

A family may hold nearly all rows of a stream. Before anything is shuffled, a task passes at most `cap` rows of a family in
a micro-batch (more can't be wanted). What is left goes to (family, salt), each of which passes `cap` rows in the life of
the stream, and only those to the family, which counts exactly. So the state task of a family sees salts * cap rows at
most, however many come."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.expr import q

SALTS = 16


class FamilyCap(StatefulProcessor):
    """Counts the rows that have passed, in the state store; one number a key."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n = self.seen.get()[0] if self.seen.exists() else 0
        before = n
        for part in rows:
            take = part.iloc[: max(0, self.cap - n)]
            n += len(take)
            if len(take):
                yield take
        if n > before:
            self.seen.update((n,))

    def close(self) -> None:
        pass


def pre_cap(df: DataFrame, family: str, cap: int) -> DataFrame:
    """At most `cap` rows of each family from every task of a micro-batch; no shuffle and no state."""
    at = df.columns.index(family)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[Any, int] = {}
        for part in batches:
            own = part.iloc[:, at]
            place = own.groupby(own, dropna=False, sort=False).cumcount() + own.map(lambda v: seen.get(None if pd.isna(v) else v, 0)).astype("int64")
            for v, n in own.value_counts(dropna=False).items():
                v = None if pd.isna(v) else v
                seen[v] = seen.get(v, 0) + int(n)
            yield part[(place < cap).to_numpy()]

    return df.mapInPandas(run, df.schema)


def stream_family_cap(stream: DataFrame, family: str, cap: int, salts: int = SALTS) -> DataFrame:
    """stream with min(cap, all) rows of each family, exactly. Needs the RocksDB state store."""
    own = stream.columns
    salted = pre_cap(stream, family, cap).withColumn("_salt", F.pmod(F.xxhash64(*[q(c) for c in own]), F.lit(salts)).cast("int"))
    some = salted.groupBy(q(family), "_salt").transformWithStateInPandas(statefulProcessor=FamilyCap(cap), outputStructType=stream.schema, outputMode="Append", timeMode="None")
    return some.groupBy(q(family)).transformWithStateInPandas(statefulProcessor=FamilyCap(cap), outputStructType=stream.schema, outputMode="Append", timeMode="None")
