"""Folds over the events of a key, in order, for keys of any number of events: nothing is gathered, and one key's events are worked on by many tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounds import running, settled

#: Events, or maps, that one row composes.
BLOCK = 1024


def numbered(events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``events`` with ``place``, from 0, within their key."""
    placed = running(events.withColumn("one_", F.lit(1).cast("long")), key, order, F.sum, "one_", lambda a, b: a + b)
    return placed.withColumn("place", F.coalesce("one__before", F.lit(0))).drop("one_", "one__before")


def end_states(events: DataFrame, key: str, states: list[str], step: Callable[[Column, Column], Column]) -> DataFrame:
    """``key, state``: where the events (key, place, event) lead from the first of ``states``.

    An event is a map of states to states. The maps of a block of events are composed to one, and these again, until one is left for a key: as
    composition may be grouped in any way, no more than ``BLOCK`` of them meet in a row."""
    number = F.create_map(*[x for k, s in enumerate(states) for x in (F.lit(s), F.lit(k))])
    to = F.array(*[F.element_at(number, step(F.lit(s), F.col("event"))) for s in states])
    maps = settled(events.select(key, F.col("place").alias("at"), to.alias("to")))
    same = F.array(*[F.lit(k) for k in range(len(states))])
    most = maps.agg(F.max("at")).first()[0] or 0
    while True:
        held = maps.groupBy(key, F.floor(F.col("at") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "to"))).alias("maps"))
        composed = F.aggregate("maps", same, lambda acc, m: F.transform(acc, lambda s: F.element_at(m["to"], s + 1)))
        maps = held.select(key, F.col("block").alias("at"), composed.alias("to"))
        most //= BLOCK
        if not most:
            break
        maps = settled(maps)
    names = F.array(*[F.lit(s) for s in states])
    return maps.select(key, F.element_at(names, F.element_at("to", 1) + 1).alias("state"))


def chain_ends(events: DataFrame, key: str) -> DataFrame:
    """``key, value, applied, n``: what stands after events (key, place, base, value, known) that each apply only to the value they name as their base.

    After an event its value stands until the next event with that base. That one is found from the events in order, and the way from a
    key's first base by following such steps, twice as far in each round."""
    first = events.where("place = 0").select(key, F.lit(-1).cast("long").alias("place"), F.col("base").alias("value"))
    made = events.where("known").select(key, "place", "value").unionByName(first)
    standing = lambda value: F.to_json(F.array(F.col(key), F.col(value).cast("string")))
    asks = made.select(standing("value").alias("stands"), key, "place", F.lit(None).cast("long").alias("fits"))
    fits = events.where("known").select(standing("base").alias("stands"), key, "place", F.col("place").alias("fits"))
    # from the end on; an event does not fit itself
    found = running(asks.unionByName(fits), "stands", [-F.col("place"), F.col("fits").isNotNull()], F.min, "fits", F.least)
    steps = found.where("fits IS NULL").select(key, "place", F.coalesce("fits_before", "place").alias("to"), F.col("fits_before").isNotNull().cast("long").alias("applied"))
    steps = settled(steps)
    while True:
        then = steps.select(key, F.col("place").alias("to"), F.col("to").alias("then"), F.col("applied").alias("more"))
        jumped = settled(steps.join(then, [key, "to"]).select(key, "place", F.col("then").alias("to"), (F.col("applied") + F.col("more")).alias("applied"), (F.col("then") != F.col("to")).alias("moved")))
        if jumped.where("moved AND place = -1").isEmpty():
            break
        steps = jumped.drop("moved")
    ends = steps.where("place = -1").select(key, F.col("to").alias("place"), "applied")
    counts = events.groupBy(key).agg(F.count("*").alias("n"))
    return ends.join(made, [key, "place"]).join(counts, key).select(key, "value", "applied", "n")
