"""Sequential choices per subject: request batches and exemplars."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.places import placed
from scriptorium.session import materialise, ship

ITEMS, CHARS, ITEM_CHARS = 10, 6000, 4000
EXEMPLARS, PER_TOPIC, MOST_ASKED, LEAD = 12, 2, 4, 4


#: Items, characters and number of the batch that is open.
State = tuple[int, int, int]


def packed(sizes: list[int], state: State = (0, 0, 0)) -> tuple[list[int], State]:
    """The batch of each item, in order, after `state`, and the state after them."""
    (n, total, batch), out = state, []
    for size in sizes:
        size = min(size, ITEM_CHARS)
        if n and (total + size > CHARS or n >= ITEMS):
            batch, n, total = batch + 1, 0, 0
        n, total = n + 1, total + size
        out.append(batch)
    return out, (n, total, batch)


def pack_sizes(sizes: list[int]) -> list[int]:
    """The batch of each item, in order: at most ITEMS items and CHARS characters."""
    return packed(sizes)[0]


def summary(sizes: list[int]) -> tuple[list[int], list[State]]:
    """What tells the state after a run of items from the state before it: the first sizes, at
    one of which a batch begins if there are ITEMS, and the state after a batch begun at each."""
    return sizes[:ITEMS], [packed(sizes[i:])[1] for i in range(min(ITEMS, len(sizes)))]


def after(state: State, head: list[int], ends: list[State]) -> State:
    """The state after a run with this summary."""
    for i, batch in enumerate(packed(head, state)[0]):
        if not state[0] or batch > state[2]:
            n, total, more = ends[i]
            return n, total, batch + more
    return packed(head, state)[1]


def request_batches(df: DataFrame, subject: str, order: str, size: Column) -> DataFrame:
    """subject, order, batch. Ids and sizes only, never texts, in ranges of the order: summaries of
    a subject's ranges give the state before each, and every range is packed on its own."""
    ship(df.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = placed(df.select(subject, order, F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("size")), subject, order)

    def heads(pdf: pd.DataFrame) -> pd.DataFrame:
        head, ends = summary(pdf.sort_values("_i")["size"].tolist())
        return pdf[[subject, "_range"]].head(1).assign(head=[head], ends=[[x for end in ends for x in end]])

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, before = pdf.sort_values("_range"), (0, 0, 0), []
        for head, ends in zip(pdf["head"], pdf["ends"]):
            before.append(state)
            ends = list(map(int, ends))
            state = after(state, list(map(int, head)), list(zip(ends[::3], ends[1::3], ends[2::3])))
        return pdf[[subject, "_range"]].assign(state=[list(x) for x in before])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        return pdf.assign(batch=packed(pdf["size"].tolist(), tuple(map(int, pdf["state"].iloc[0])))[0])[[subject, order, "batch"]]

    ranges = rows.groupBy(subject, "_range").applyInPandas(heads, f"{subject} {kinds[subject]}, _range int, head array<long>, ends array<long>")
    known = ranges.groupBy(subject).applyInPandas(states, f"{subject} {kinds[subject]}, _range int, state array<long>")
    known = known.withColumnsRenamed({subject: "_subject", "_range": "_of"})
    met = rows.join(known, F.col(subject).eqNullSafe(F.col("_subject")) & (F.col("_range") == F.col("_of"))).select(subject, order, "size", "_range", "_i", "state")
    return met.groupBy(subject, "_range").applyInPandas(run, f"{subject} {kinds[subject]}, {order} {kinds[order]}, batch long")


def pick_exemplars(df: DataFrame, subject: str, id_col: str) -> DataFrame:
    """subject, id, place of chosen rows (style, asked, topic, mode): rarely asked ones by style, two a
    topic at most, neither mode four ahead of the other, twelve at most.

    One row a subject and round: the first after the last chosen one that the topics and modes
    chosen so far allow. What a row was refused for can only be lifted by rows that come after
    it, which is too late, so no subject is gathered and all subjects go round together."""
    eligible = df.where((F.col("asked") <= MOST_ASKED) & F.col("style").isNotNull())
    order = F.struct((-F.col("style")).alias("s"), F.col(id_col).alias("i"))
    rows = eligible.select(F.col(subject).alias("subject"), F.col(id_col).alias("id"), F.lower(F.coalesce("topic", F.lit("misc"))).alias("topic"), F.col("mode"), order.alias("at"))
    rows = materialise(rows, "eligible")
    none = "CAST(array() AS array<string>)"
    state = rows.groupBy("subject").agg(F.min("at").alias("first")).select(F.col("subject").alias("_of"), F.lit(None).cast(rows.schema["at"].dataType).alias("last"), F.expr(none).alias("topics"), F.lit(0).alias("ahead"))
    chosen = []
    step = F.when(F.col("mode") == "spoken", 1).otherwise(-1)  # spoken ones less written ones
    for place in range(1, EXEMPLARS + 1):
        met = rows.join(state, F.col("subject").eqNullSafe(F.col("_of")))
        free = (F.col("last").isNull() | (F.col("at") > F.col("last"))) & (F.size(F.filter("topics", lambda t: t == F.col("topic"))) < PER_TOPIC) & (step * F.col("ahead") < LEAD)
        best = met.where(free).groupBy("subject", "topics", "ahead").agg(F.min_by(F.struct("id", "topic", "mode", "at"), "at").alias("x"))
        best = materialise(best.select("subject", "topics", "ahead", "x.*"), "chosen")
        if best.isEmpty():
            break
        chosen.append(best.select("subject", "id", F.lit(place).cast("long").alias("place")))
        state = best.select(F.col("subject").alias("_of"), F.col("at").alias("last"), F.array_append("topics", F.col("topic")).alias("topics"), (F.col("ahead") + step).alias("ahead"))
    if not chosen:
        return rows.select(F.col("subject").alias(subject), F.col("id").alias(id_col), F.lit(0).cast("long").alias("place"))
    return reduce(DataFrame.unionByName, chosen).withColumnsRenamed({"subject": subject, "id": id_col})
