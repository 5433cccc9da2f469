"""Queries by name, and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinoflow.plans import machine_queries as m
from kinoflow.plans import queries as q
from kinoflow.plans.machine_oracles import MACHINE_ORACLES
from kinoflow.plans.oracles import ORACLES as PLAIN_ORACLES

ORACLES: dict[str, str] = PLAIN_ORACLES | MACHINE_ORACLES
#: Two queries have no SQL. phash_distance: coefficients of the derived frames are zero but for rounding, so bits at the
#: median depend on the order of sums; phash_of_embeddings has SQL. cascade_events: all columns of all events, which the
#: tests hold against a plain machine; cascade_scenes and cascade_keyframes have SQL.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: getattr(q, name, None) or getattr(m, name) for name in (*ORACLES, "phash_distance", "cascade_events")
}
