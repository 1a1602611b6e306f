"""Deletes: by key with outcomes, cascading over the graph, and restricted."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .checks import CONFLICT, NOT_FOUND, OK
from .inserts import Changes
from .skew import join_facts


@dataclass(frozen=True)
class Edge:
    """Rows of `child` refer to rows of `parent` by child.fk = parent.pk."""

    child: str
    fk: str
    parent: str
    pk: str
    on_delete: str = "cascade"


def _firsts(requests: DataFrame, target: str, seq: str) -> DataFrame:
    """First request of each key: one row per key however often it is asked for."""
    return (
        requests.where(F.col(target).isNotNull())
        .groupBy(F.col(target).alias("_key"))
        .agg(F.min(seq).alias("_seq"))
    )


def _keys_of(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Distinct values of `key` in the table that occur in `wanted._key`."""
    keys = table.select(F.col(key).alias("_key"))
    return keys.join(wanted.select("_key"), "_key", "left_semi").distinct()


def _outcomes(requests: DataFrame, seq: str, target: str, verdict: Column) -> DataFrame:
    return requests.select(
        F.col(seq),
        verdict["code"].alias("code"),
        verdict["detail"].alias("detail"),
        F.col(target).alias("id"),
    )


def _verdict(code: int, detail: str | None) -> Column:
    return F.struct(
        F.lit(code).alias("code"), F.lit(detail).cast("string").alias("detail")
    )


def delete_rows(
    table: DataFrame, requests: DataFrame, key: str, target: str = "target_id",
    seq: str = "seq", missing: str = "not found",
) -> Changes:
    """Delete by key. The first request of an existing key is 200, every other one 404."""
    firsts = _firsts(requests, target, seq)
    gone = firsts.join(table.select(F.col(key).alias("_key")), "_key", "left_semi")
    done = requests.join(
        gone.select(F.col("_seq").alias(seq), F.lit(True).alias("_done")), seq, "left"
    )
    verdict = F.when(F.col("_done"), _verdict(OK, None)).otherwise(_verdict(NOT_FOUND, missing))
    left = table.join(firsts.select(F.col("_key").alias(key)), key, "left_anti")
    return Changes(left.select(table.columns), _outcomes(done, seq, target, verdict))


def cascade_delete(
    tables: Mapping[str, DataFrame], root: str, keys: DataFrame, edges: Iterable[Edge],
    key: str,
) -> dict[str, DataFrame]:
    """Delete rows of `root` and everything that refers to them, directly or not.

    `keys` has the doomed root keys in its column `key`. Edges that restrict deletion are
    not followed; see `restrict_delete`. Returns every table, changed or not.
    """
    left = dict(tables)
    doomed = {root: (key, keys.select(F.col(key).alias("_key")).distinct())}
    left[root] = _without(left[root], key, doomed[root][1])
    waiting = _reachable(root, [e for e in edges if e.on_delete == "cascade"])
    while waiting:
        # A table's own edges wait until everything that can doom its rows is done.
        pending = {e.child for e in waiting}
        for edge in [e for e in waiting if e.parent not in pending]:
            waiting.remove(edge)
            dead = doomed[edge.parent][1]
            own = [e for e in waiting if e.parent == edge.child]
            if own:
                # Only a child that has children of its own must name its doomed rows.
                lost = join_facts(left[edge.child], dead, [edge.fk], ["_key"], "left_semi")
                lost = lost.select(F.col(own[0].pk).alias("_key")).distinct()
                if edge.child in doomed:
                    lost = doomed[edge.child][1].union(lost).distinct()
                doomed[edge.child] = (own[0].pk, lost)
            left[edge.child] = _without(left[edge.child], edge.fk, dead)
    return left


def _reachable(root: str, edges: list[Edge]) -> list[Edge]:
    """Edges that a deletion starting at `root` can follow; the graph has no cycles."""
    found, seen = [], {root}
    while True:
        more = [e for e in edges if e.parent in seen and e not in found]
        if not more:
            return found
        found += more
        seen |= {e.child for e in more}


def _without(table: DataFrame, column: str, dead: DataFrame) -> DataFrame:
    return join_facts(table, dead, [column], ["_key"], "left_anti")


def restrict_delete(
    parent: DataFrame, child: DataFrame, requests: DataFrame, key: str, fk: str,
    target: str = "target_id", seq: str = "seq",
) -> Changes:
    """Delete parents that no child refers to; 409 for the others, 404 for unknown ones."""
    firsts = _firsts(requests, target, seq)
    # The large tables are read once each, and only rows of `firsts` go on.
    known = firsts.join(parent.select(F.col(key).alias("_key")), "_key", "left_semi")
    blocked = _keys_of(child, fk, known)
    gone = known.join(blocked, "_key", "left_anti")
    done = requests.join(
        gone.select(F.col("_seq").alias(seq), F.lit(True).alias("_done")), seq, "left"
    )
    held = blocked.withColumn("_blocked", F.lit(True))
    done = join_facts(done, held, [target], ["_key"], "left")
    verdict = (
        F.when(F.col("_done"), _verdict(OK, None))
        .when(F.col("_blocked"), _verdict(CONFLICT, "blocked by referring rows"))
        .otherwise(_verdict(NOT_FOUND, "not found"))
    )
    left = parent.join(gone.select(F.col("_key").alias(key)), key, "left_anti")
    return Changes(left.select(parent.columns), _outcomes(done, seq, target, verdict))
