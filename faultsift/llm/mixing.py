"""Mixing sources to target weights by pivotal dependent rounding.

A source's share of the mix is met by copying its documents: each is taken floor(r) times, and once
more with probability r - floor(r), where r is target over size. The extra copies are drawn by the
pivotal method: two fractional probabilities meet and mass moves at random from one to the other
until one of them is 0 or 1. Documents of a source meet in the order of their size. Chunks of a
bounded number of documents are reduced by themselves; the one residual of each chunk goes up to
the next level of the tree, until a source has one residual left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.positions import number_rows
from ..session import cut_lineage
from .common import words_column

#: Probabilities are whole numbers of this unit, so that sums are exact.
ONE = 1 << 30


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size) to the same with `_rank` and `target`.

    Sources in code point order, null last, take the weights in turn and share all sizes by them. A
    target ends at `most` times the source's size; the excess is shared again by weight until no
    source is above. Each turn is one small aggregation; the driver sees two numbers of it."""
    ranked = number_rows(
        sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_rank")
    pattern = F.array(*[F.lit(w) for w in weights])
    ranked = cut_lineage(ranked.select(
        "source", "source_size", F.col("_rank").cast("long").alias("_rank"),
        F.element_at(pattern, (F.col("_rank") % len(weights) + 1).cast("int")).alias("_weight")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap, level, capped = F.col("source_size") * most, 0.0, -1
    while True:
        full = (F.col("_weight") * level > cap) if capped >= 0 else F.lit(False)
        state = ranked.agg(
            F.sum(F.when(full, cap).otherwise(0)).alias("given"),
            F.sum(F.when(full, 0).otherwise(F.col("_weight"))).alias("weight"),
            F.sum(full.cast("int")).alias("capped")).first()
        if not state["weight"] or state["capped"] == capped:
            break
        capped, level = state["capped"], (total - state["given"]) / state["weight"]
    return ranked.select(
        "source", "_rank", "source_size",
        F.least(F.col("_weight") * F.lit(float(level)), cap.cast("double")).alias("target"))


# One meeting of the pivotal method: `x` is a unit, `s` the residual so far and the units that won.
# With s.p + x.p below 1, one of the two gets the sum and the other 0; else one gets 1 and the other
# the rest. The draw depends on the seed, the level and the two units alone.
_MEETING = """
    case when s.p = 0 then named_struct('pos', x.pos, 'p', x.p, 'won', s.won)
         when s.p + x.p < {one}L then named_struct(
             'pos', if({draw} * (s.p + x.p) < x.p * {one}L, x.pos, s.pos), 'p', s.p + x.p, 'won', s.won)
         else if({draw} * (2 * {one}L - s.p - x.p) < ({one}L - x.p) * {one}L,
             named_struct('pos', x.pos, 'p', s.p + x.p - {one}L, 'won', array_append(s.won, s.pos)),
             named_struct('pos', s.pos, 'p', s.p + x.p - {one}L, 'won', array_append(s.won, x.pos)))
    end"""


def pivotal_winners(units: DataFrame, seed: int = 11, width: int = 128) -> DataFrame:
    """From (group, pos, p), p in units of 1 / 2^30 and pos unique, the `pos` that are rounded up.

    Their number in a group is the sum of its probabilities, rounded up or down. A task holds at
    most `width` units of a group at once."""
    winners = None
    current, level, index = units.where((F.col("p") > 0) & (F.col("p") < ONE)), 0, F.col("pos")
    while True:
        draw = f"pmod(xxhash64({seed}, {level}, s.pos, x.pos), {ONE}L)"
        reduced = cut_lineage(
            current.withColumn("chunk", F.floor(index / width)).groupBy("group", "chunk")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "p"))).alias("units"))     # <= width
            .withColumn("s", F.expr(
                "aggregate(units, named_struct('pos', -1L, 'p', 0L, 'won', cast(array() as array<bigint>)), "
                f"(s, x) -> {_MEETING.format(one=ONE, draw=draw)})"))
            .select("group", "chunk", F.col("s.pos").alias("pos"), F.col("s.p").alias("p"),
                    F.col("s.won").alias("won")))
        level += 1
        won = reduced.select(F.explode("won").alias("pos"))
        winners = won if winners is None else winners.union(won)
        most = reduced.groupBy("group").count().agg(F.max("count")).first()[0] or 0
        current, index = reduced.where(F.col("p") > 0).select("group", "chunk", "pos", "p"), F.col("chunk")
        if most <= 1:
            last = F.pmod(F.xxhash64(F.lit(seed), F.lit(-1), F.col("pos")), F.lit(ONE)) < F.col("p")
            return winners.union(current.where(last).select("pos"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 11,
                key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row: key, `source`, `size` (words), `source_size`, `target`, `copies`, `taken`.

    A null or empty text has size 0. A source without any words has target 0 and takes nothing. Rows
    without words never win a copy. Repeated rows and null keys are separate units; other columns
    are not read. Draws depend on the position of a row in its source by size, key and text, so
    reruns agree. An empty table gives an empty table.
    """
    rows = docs.select(
        docs[key].alias("_key"), docs[source].alias("source"),
        F.size(words_column(text)).cast("long").alias("size"), F.xxhash64(docs[text]).alias("_mix"))
    rows = cut_lineage(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut_lineage(source_targets(sizes, weights, most))
    placed = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    placed = placed.withColumn("_whole", F.floor(ratio)).withColumn(
        "_extra", F.round((ratio - F.floor(ratio)) * ONE).cast("long"))
    numbered = cut_lineage(number_rows(placed, ["_rank", "size", "_key", "_mix"], "_pos"))
    units = numbered.where(F.col("size") > 0).select(
        F.col("_rank").alias("group"), F.col("_pos").cast("long").alias("pos"), F.col("_extra").alias("p"))
    winners = pivotal_winners(units, seed).withColumn("_won", F.lit(1))
    copies = F.col("_whole") + F.coalesce("_won", F.lit(0)) + (F.col("_extra") == ONE).cast("int")
    return (numbered.join(winners, numbered["_pos"] == winners["pos"], "left")
            .withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("long"))
            .select(F.col("_key").alias(key), "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))
