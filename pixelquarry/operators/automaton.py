"""Finite automata over long ordered records: state maps of blocks, composed and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


def _map(of) -> Column:
    return F.array(*[F.struct(F.lit(to).cast("int").alias("to"), F.lit(None).cast("long").alias("at")) for to in of])


def run(rows: DataFrame, key: str, place: str, symbol: str, table: list[list[int]], start: int = 0, block: int = BLOCK) -> DataFrame:
    """(key, state, at): the state in which the automaton leaves each key's records, taken by ``place`` (numbered from 0).

    ``table[state][symbol]`` is the next state; states from ``len(table)`` on are final, and ``at`` is the place that
    reached one. A block of records becomes a map from each state to the state behind the block, and
    blocks of maps are composed in turn, so a row holds ``block`` records or maps at most (up to ``block``
    squared records a key), whatever a key has.
    """
    states, width = len(table), len(table[0])
    flat = F.array(*[F.lit(to) for row in table for to in row])

    def one(m: Column, r: Column) -> Column:
        def after(e: Column) -> Column:
            to = F.get(flat, e["to"] * width + r["symbol"])
            return F.when(e["to"] >= states, e).otherwise(F.struct(to.alias("to"), F.when(to >= states, r["at"]).alias("at")))

        return F.transform(m, after)

    def other(m: Column, r: Column) -> Column:
        return F.transform(m, lambda e: F.when(e["to"] >= states, e).otherwise(F.get(r["map"], e["to"])))

    identity = _map(range(states))
    numbered = rows.select(key, F.col(place).cast("long").alias("at"), F.col(symbol).cast("int").alias("symbol"))
    first = numbered.groupBy(key, F.expr(f"at div {block}").alias("no")).agg(F.array_sort(F.collect_list(F.struct("at", "symbol"))).alias("rs"))
    maps = first.select(key, "no", F.aggregate("rs", identity, one).alias("map"))
    packed = maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("no", "map"))).alias("rs"))
    end = F.get(F.aggregate("rs", identity, other), F.lit(start))
    return packed.select(key, end["to"].alias("state"), end["at"].alias("at"))
