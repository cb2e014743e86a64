"""Templates over streams: a stateless projection, and dedup within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.builtins import Scope
from ..operators.bindings import Bindings
from ..operators.template import Template, instantiate


def stream_triples(template: Template, rows: DataFrame, **params) -> DataFrame:
    """[s, p, o] of each row as it arrives."""
    return instantiate(template.triples, Bindings.from_df(rows).solutions(), {**template.params, **params})


def stream_distinct_triples(template: Template, rows: DataFrame, time: str, delay: str, **params) -> DataFrame:
    """Triples without repeats among rows at most ``delay`` apart in the column ``time``.

    State is bounded: a triple is forgotten once the watermark has passed it.
    """
    with_time = rows.select(F.col(time).alias("__time"), F.struct(*rows.columns).alias("__row"))
    out = None
    for triple in template.triples:
        flat = with_time.select("__time", "__row.*")
        scoped = Bindings.from_df(flat).solutions()
        scope = Scope(scoped.values(), {**template.params, **params})
        one = scoped.df.select(*(scope.value(t).term().alias(n) for n, t in zip("spo", triple, strict=True)), F.col("__time").cast("timestamp").alias("at"))
        one = one.where(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull())
        out = one if out is None else out.unionAll(one)
    return out.withWatermark("at", delay).dropDuplicatesWithinWatermark(["s", "p", "o"])
