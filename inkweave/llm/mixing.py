"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each source gets a target of words from its weight and a cap; target over size is the number of
copies each of its rows is to have on average.  The whole part is given to every row.  The
fractions are rounded by the pivotal method: two fractions meet, a draw moves mass from one to the
other until one of them is 0 or 1, and the other goes on.  Rows of nearly the same size meet first,
so words and not only rows add up to the target.  Chunks of bounded size are rounded side by side;
what each leaves over, one fraction at most, meets in the chunks of the next level, where sizes are
classed more coarsely, until one fraction per source is left and drawn for.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.scale import cut_lineage, drop_steps, new_table_path

from .names import free_names
from .order import with_total_before

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
CHUNK = 128
CLASS_WIDTH = 0.02
COARSER = 4
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """``source``, ``source_size``, ``weight`` and ``target`` for rows with ``source`` and ``size``.

    Sources in code point order, null last, take the weights in turn.  Together the targets are
    ``share`` of all sizes; none is above ``cap`` times its source, and what would be is shared by
    weight among the rest.
    """
    by_source = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("_last", F.col("source").isNull())
    )
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    placed = cut_lineage(
        with_total_before(by_source, ["_last", "source"], F.lit(1).cast("long"), "_number").select(
            "source",
            "source_size",
            F.element_at(cycle, (F.col("_number") % len(weights) + 1).cast("int")).alias("weight"),
        ),
        "sources",
    )
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    most = F.lit(cap) * F.col("source_size")
    level, full = 0.0, -1
    while True:  # each turn caps one source more at least, or is the last
        above = F.when(most <= F.col("weight") * level, True).otherwise(False)
        row = placed.agg(
            F.sum(above.cast("int")), F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if (row[0] or 0) == full or not row[2]:
            break
        full, level = row[0] or 0, (share * total - (row[1] or 0)) / row[2]
    target = F.least(most.cast("double"), F.col("weight") * F.lit(float(level)))
    if total and not row[2]:
        target = most.cast("double")
    return placed.withColumn("target", target)


def _draw(*key: Column) -> Column:
    """A number in [0, 1) that depends on nothing but its key."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def _meet(level: int, seed: int):
    """Rounds a list of fractions, largest rows first; leaves one at most."""

    def step(acc: Column, x: Column) -> Column:
        held = acc["held"]
        both = held["p"] + x["p"]
        u = _draw(F.lit(seed), F.lit(level), held["key"], x["key"])
        settle_held = F.when(both < 1, u * both < x["p"]).otherwise(u * (2 - both) < 1 - x["p"])
        take = F.when(both < 1, 0).otherwise(1)
        rest = F.when(both < 1, both).otherwise(both - 1)
        gone = F.when(settle_held, held).otherwise(x)
        stays = F.when(settle_held, x).otherwise(held)
        settled = F.struct(gone["row"].alias("row"), take.alias("take"))
        going_on = F.struct(
            stays["order"].alias("order"), stays["key"].alias("key"), stays["row"].alias("row"), rest.alias("p")
        )
        return F.when(held.isNull(), F.struct(acc["done"].alias("done"), x.alias("held"))).otherwise(
            F.struct(F.array_append(acc["done"], settled).alias("done"), going_on.alias("held"))
        )

    return step


def pivotal_rounding(
    units: DataFrame, group: str, columns: list[str], size: str = "size", p: str = "p", seed: int = SEED
) -> DataFrame:
    """Round the fractions ``p`` in (0, 1) to 0 or 1 so that their sums per group are kept.

    ``columns`` name a row and come back with ``take``.  A row is taken with probability ``p``, and
    with the same seed always the same rows are.  Sums of ``size`` keep near their expectation too.
    """
    row = F.struct(group, *columns)
    live = units.select(
        group,
        F.floor(F.log(F.greatest(F.col(size), F.lit(1)).cast("double")) / CLASS_WIDTH).cast("long").alias("_class"),
        F.struct(
            (-F.col(size).cast("long")).alias("order"),
            F.xxhash64(F.lit(seed), group, *columns).alias("key"),
            row.alias("row"),
            F.col(p).cast("double").alias("p"),
        ).alias("_unit"),
    )
    # Every level adds what it has settled to one table, so that readers plan one scan.
    path, level = new_table_path(units.sparkSession, "settled"), 0
    while True:
        live = cut_lineage(live, "fractions")
        count = live.groupBy(F.col(group).alias("_g"), F.col("_class").alias("_c")).agg(F.count("*").alias("_n"))
        total = count.groupBy(F.col("_g").alias("_h")).agg(F.sum("_n").alias("_all"))
        count = count.join(total, F.col("_g").eqNullSafe(F.col("_h")))
        one = F.col("_all") <= CHUNK  # the rest of a group fits one chunk: no classes
        chunks = live.join(count, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_class") == F.col("_c"))).select(
            group,
            F.when(one, 0).otherwise(F.col("_class")).alias("_class"),
            F.pmod(F.xxhash64(F.lit(level), F.col("_unit.key")), F.ceil(F.when(one, 1).otherwise(F.col("_n")) / F.lit(CHUNK))).alias("_chunk"),
            "_unit",
        )
        kind = live.schema["_unit"].dataType.simpleString()
        done = f"array<struct<row:{live.schema['_unit'].dataType['row'].dataType.simpleString()},take:int>>"
        folded = cut_lineage(
            chunks.groupBy(group, "_class", "_chunk").agg(
                F.aggregate(
                    F.array_sort(F.collect_list("_unit")),
                    F.struct(F.array().cast(done).alias("done"), F.lit(None).cast(kind).alias("held")),
                    _meet(level, seed),
                ).alias("_acc")
            ),
            "rounded",
        )
        settled = folded.select(F.explode("_acc.done").alias("d")).select("d.row.*", "d.take")
        settled.write.mode("append").parquet(path)
        drop_steps(live)
        wide = folded.agg(F.max("_class"), F.count("*"), F.count_distinct(F.struct(F.xxhash64(group), F.col(group).isNull()))).first()
        live = folded.select(group, F.floor(F.col("_class") / COARSER).alias("_class"), F.col("_acc.held").alias("_unit"))
        if wide[1] == wide[2]:  # one fraction per group
            break
        level += 1
    last = live.select(
        "_unit.row.*", (_draw(F.lit(seed), F.lit(-1), F.col("_unit.key")) < F.col("_unit.p")).cast("int").alias("take")
    )
    last.write.mode("append").parquet(path)
    return units.sparkSession.read.schema(settled.schema).parquet(path)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    seed: int = SEED,
) -> DataFrame:
    """How often each row goes into a mix of the sources.

    Returns one row per row of ``docs``: ``id``, ``source``, ``text_key``, ``copy`` (these name the
    row), ``size`` in words, ``source_size``, ``target`` in words of its source, ``copies`` and
    ``taken`` (``copies * size``).  With the same rows and seed the result is the same, however the
    table is split.

    A null text has size 0; rows of size 0 take no part in the rounding and have the whole part of
    their rate as copies.  Rows without a source are a source of their own, the last.  Null ids and repeated
    rows are rows like others.  A table without words has targets of 0; an empty table gives an
    empty result.  Extra columns are ignored.
    """
    if cap < 1 or share <= 0 or share > cap or not weights or min(weights) <= 0:
        raise ValueError("need weights > 0 and 0 < share <= cap, cap >= 1")
    slim = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.col(text_col).cast("string").alias("text"),
    )
    key = ["id", "source", "text_key"]
    rows = slim.select("id", "source", F.xxhash64("text").alias("text_key"), word_count(F.col("text")).alias("size"))
    same = Window.partitionBy(*key).orderBy("size")
    rows = cut_lineage(rows.withColumn("copy", F.row_number().over(same)), "sizes")
    targets = cut_lineage(source_targets(rows, weights, share, cap), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = (
        rows.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source", "weight")
        .withColumn("whole", F.floor(rate).cast("int"))
        .withColumn("p", rate - F.floor(rate))
    )
    names = ["id", "text_key", "copy", "size", "source_size", "target", "whole"]
    split = (F.col("p") > 0) & (F.col("size") > 0)
    rounded = pivotal_rounding(joined.filter(split), "source", names, seed=seed)
    even = joined.filter(~split).select("source", *names, F.lit(0).alias("take"))
    copies = F.col("whole") + F.col("take")
    return rounded.select("source", *names, "take").union(even).select(
        "id", "source", "text_key", "copy", "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"),
    )


def take_mix(
    docs: DataFrame,
    mix: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` says, with their columns unchanged."""
    names = free_names(docs, "id", "source", "text_key", "copy", "copies", "alone")
    row = free_names(docs, "row_id", "row_source", "row_text_key", "row_copy")
    alone = F.count("*").over(Window.partitionBy("id", "source", "text_key")) == 1
    chosen = cut_lineage(
        mix.select("id", "source", "text_key", "copy", "copies", alone).toDF(*names).filter(F.col(names[4]) > 0), "mix"
    )
    named = docs.withColumns(
        {
            row[0]: F.col(f"`{id_col}`").cast("long"),
            row[1]: F.col(f"`{source_col}`").cast("string"),
            row[2]: F.xxhash64(F.col(f"`{text_col}`").cast("string")),
        }
    )
    columns = [F.col(f"`{c}`") for c in docs.columns]

    def taken(rows: DataFrame, those: DataFrame, n: int) -> DataFrame:
        match = [F.col(r).eqNullSafe(F.col(m)) for r, m in zip(row[:n], names[:n], strict=True)]
        matched = rows.join(those, reduce(and_, match))
        return matched.withColumn(row[0], F.explode(F.array_repeat(F.lit(0), F.col(names[4])))).select(*columns)

    # Only rows that share id, source and text need a number among themselves.
    several = chosen.filter(~F.col(names[5]))
    keys = several.select(*names[:3]).distinct()
    match = reduce(and_, (F.col(r).eqNullSafe(F.col(m)) for r, m in zip(row, names[:3], strict=False)))
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    numbered = named.join(keys, match, "left_semi").withColumn(
        row[3], F.row_number().over(Window.partitionBy(*row[:3]).orderBy(F.xxhash64(*plain)))
    )
    return taken(named, chosen.filter(F.col(names[5])), 3).union(taken(numbered, several, 4))
