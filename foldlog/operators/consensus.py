"""Decisions from recorded consensus messages. The protocol itself is no part of this: Spark jobs read what was recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlog.operators import ordered


def highest_ballots(votes: DataFrame) -> DataFrame:
    """The command with the highest ballot of each slot."""
    return votes.groupBy("slot").agg(F.max_by("command", "ballot").alias("command"), F.max("ballot").alias("ballot"))


def majority(n: int) -> int:
    """Simple majority of n configured members, up or down."""
    return int(n / 2 + 1)


def majority_of(members: DataFrame) -> DataFrame:
    return members.agg(F.floor(F.count(F.lit(1)) / 2 + 1).cast("long").alias("majority"))


def quorum(votes: DataFrame, members: DataFrame) -> DataFrame:
    """Ballots that enough distinct known acceptors voted for: ``slot``, ``ballot`` and ``acceptors``."""
    known = votes.join(F.broadcast(members.select("acceptor")), "acceptor", "left_semi")
    counted = known.select("slot", "ballot", "acceptor").distinct().groupBy("slot", "ballot").agg(F.count(F.lit(1)).alias("acceptors"))
    return counted.join(F.broadcast(majority_of(members)), F.col("acceptors") >= F.col("majority")).drop("majority")


def outcomes(own: DataFrame, votes: DataFrame, members: DataFrame) -> DataFrame:
    """What became of own proposals (slot, ballot) by votes in the order of their ``arrival``.

    ``decided``: enough distinct known acceptors voted for the ballot before a vote for another, higher one came;
    ``preempted``: the other vote came first; ``open``: neither. What comes after the quorum changes nothing.
    """
    mine = own.select("slot", F.col("ballot").alias("own"))
    seen = votes.join(mine, "slot")
    known = seen.where(F.col("ballot") == F.col("own")).join(F.broadcast(members.select("acceptor")), "acceptor", "left_semi")
    first = known.groupBy("slot", "acceptor").agg(F.min("arrival").alias("arrival"))
    # As many arrivals a slot as there are members, at most.
    arrivals = first.groupBy("slot").agg(F.array_sort(F.collect_list("arrival")).alias("arrivals")).join(F.broadcast(majority_of(members)))
    decided = arrivals.select("slot", F.get("arrivals", (F.col("majority") - 1).cast("int")).alias("decided"))
    other = seen.where(F.col("ballot") > F.col("own")).groupBy("slot").agg(F.min("arrival").alias("other"))
    both = mine.join(decided, "slot", "left").join(other, "slot", "left")
    outcome = F.when(F.col("other").isNotNull() & (F.col("decided").isNull() | (F.col("other") < F.col("decided"))), "preempted").when(F.col("decided").isNotNull(), "decided").otherwise("open")
    return both.select("slot", F.col("own").alias("ballot"), outcome.alias("outcome"))


def preempted(own: DataFrame, votes: DataFrame, members: DataFrame) -> DataFrame:
    """Slots whose own proposal met a higher ballot before its quorum."""
    return outcomes(own, votes, members).where("outcome = 'preempted'").select("slot")


def reaped(accepted: DataFrame, now_ms: int, retention_ms: int) -> tuple[DataFrame, int]:
    """What an acceptor keeps after reaping, and its lowest acceptable slot: all from the first slot on whose time is
    within the retention stays, whatever the times after it."""
    first = accepted.where(F.col("ts_ms") >= now_ms - retention_ms).agg(F.min("slot")).first()[0]
    highest = accepted.agg(F.max("slot")).first()[0]
    low = first if first is not None else (highest or 0) + 1
    return accepted.where(F.col("slot") >= low), low


def reproposed(own: DataFrame, decided: DataFrame, used: DataFrame, start: int) -> DataFrame:
    """Own proposals that lost their slot, each with the next free slot in order: ``slot``, ``command``, ``from_slot``."""
    lost = ordered.row_numbers(clobbered(own, decided).select("slot", "command"), "rn", "slot")
    last = used.select("slot").union(own.select("slot")).union(decided.select("slot")).agg(F.greatest(F.max("slot"), F.lit(start - 1)).alias("last"))
    return lost.join(F.broadcast(last)).select((F.coalesce("last", F.lit(start - 1)) + F.col("rn")).alias("slot"), "command", F.col("slot").alias("from_slot"))


def overlay(x: DataFrame, y: DataFrame, key: str, value: str) -> DataFrame:
    """Two maps as one; where both have a key the second wins."""
    a, b = x.select(key, F.col(value).alias("__x")), y.select(key, F.col(value).alias("__y"))
    return a.join(b, key, "full").select(key, F.coalesce("__y", "__x").alias(value))


def next_free_slot(used: DataFrame, start: int) -> DataFrame:
    """The smallest slot from ``start`` on that isn't used."""
    slots = used.select("slot").where(F.col("slot") >= start).distinct()
    after = ordered.neighbours(slots, "slot")
    end = after.where(F.col("next_slot").isNull() | (F.col("next_slot") > F.col("slot") + 1)).agg(F.min("slot").alias("end"), F.lit(0).alias("k"))
    first = slots.agg(F.min("slot").alias("first"), F.lit(0).alias("k"))
    free = F.when(F.coalesce("first", F.lit(start + 1)) > start, F.lit(start)).otherwise(F.col("end") + 1)
    return first.join(F.broadcast(end), "k").select(free.cast("long").alias("slot"))


def clobbered(own: DataFrame, decided: DataFrame) -> DataFrame:
    """Own proposals whose slot was decided for another command."""
    d = decided.select("slot", F.col("command").alias("decided"))
    return own.join(d, "slot").where(F.col("command") != F.col("decided")).select("slot", "command", "decided")


def accept(accepted: DataFrame, offered: DataFrame) -> DataFrame:
    """Accepted proposals after an offer for some slots: the higher ballot stays, the time is the offer's."""
    a = accepted.select("slot", F.struct("ballot", "command").alias("a"), F.col("ts_ms").alias("ta"))
    b = offered.select("slot", F.struct("ballot", "command").alias("b"), F.col("ts_ms").alias("tb"))
    stays = F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("a.ballot") > F.col("b.ballot")))
    both = a.join(b, "slot", "full").select("slot", F.when(stays, F.col("a")).otherwise(F.col("b")).alias("v"), F.coalesce("tb", "ta").alias("ts_ms"))
    return both.select("slot", "v.ballot", "v.command", "ts_ms")


def all_accepted(votes: DataFrame) -> DataFrame:
    """Union of what the acceptors accepted."""
    return votes.select("slot", "ballot", "command").distinct()
