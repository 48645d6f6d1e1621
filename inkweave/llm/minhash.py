"""Near duplicates: MinHash bands, sequential Bayesian verification, exact check of survivors.

A class is one set of word n-grams; copies are found first, by one aggregate.  Its signature has
``bands * rows`` MinHash values.  Two classes with a Jaccard similarity ``s`` agree in one value with
probability ``s``, so they share no band with probability ``(1 - s**rows)**bands``; the number of bands
follows from the chosen miss probability at the threshold.

A pair that shares a band is verified batch by batch.  With a uniform prior, after ``m`` agreements in
``n`` values the similarity has the posterior Beta(m + 1, n - m + 1), and it reaches the threshold ``t``
with probability P(Binomial(n + 1, t) <= m).  A pair leaves as soon as that falls below the miss
probability.  Whoever is left after all values is checked exactly: first by the Hamming distance of parity
sketches, which never exceeds the symmetric difference of the two sets, then on the whole sets.

Groups of near copies share most of their bands.  First each band's most connected member meets the
others, one pair per member; then the members of bands that still hold several components meet in
blocks of bounded size inside tasks.  Only pairs of different components that survive all batches and
the sketches leave a task, each in the first band in which it agrees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.scale import cut_lineage

from .graph import components
from .ngram_join import class_ids, shingle_sets
from .set_links import linked_pairs, sets_of
from .words import bytes_of, mix, slices

ROWS = 5
MISS = 1e-6
BATCH = 20
SKETCH_BITS = 2_048
BAND_MASK = (1 << 12) - 1
BLOCK = 1_024
PAIRS_AT_ONCE = 1 << 18


def number_of_bands(threshold: float, rows: int, miss: float) -> int:
    """Bands so that a pair at ``threshold`` shares none with a probability of at most ``miss``."""
    if threshold >= 1:
        return 1
    return max(1, math.ceil(math.log(miss) / math.log1p(-(threshold**rows))))


def least_agreements(threshold: float, size: int, batch: int, miss: float) -> list[tuple[int, int]]:
    """``(n, m)``: after ``n`` compared values a pair with fewer than ``m`` agreements is pruned."""
    out = []
    for n in [*range(batch, size, batch), size]:
        tail, m = 0.0, -1
        while tail < miss and m < n:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def signatures(sets: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """MinHash values of each set, ``size`` 32-bit numbers; those of an empty set are zero."""
    out = np.zeros((len(first) - 1, size), np.uint32)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        at = first[full]
        steps = np.arange(1, 2 * size + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            flips = mix(steps[:size] * np.uint64(0x9E3779B97F4A7C15))
            factors = mix(steps[size:] * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
            for i in range(size):
                out[full, i] = np.minimum.reduceat((sets ^ flips[i]) * factors[i], at) >> np.uint64(32)
    return out


def band_keys(signs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; the number of the band is in the low twelve bits."""
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signs), bands))
        for r in range(rows):
            acc = mix(acc + signs[:, r : bands * rows : rows].astype(np.uint64) + np.uint64(1))
    return acc & ~np.uint64(BAND_MASK) | np.arange(bands, dtype=np.uint64)


def parity_sketches(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One bit per value modulo ``SKETCH_BITS``: whether an odd number of a set's values have it."""
    n = len(first) - 1
    at = np.repeat(np.arange(n), np.diff(first)) * SKETCH_BITS
    at += (mix(sets ^ np.uint64(0x2C1B)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.zeros(n * SKETCH_BITS, np.uint8)
    np.bitwise_xor.at(odd, at, np.uint8(1))
    return np.packbits(odd.reshape(n, SKETCH_BITS), axis=1).view(np.uint64)


def may_link(sketches: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of sets of sizes ``n`` can have a similarity of ``num``/``den`` by their sketches."""
    far = np.bitwise_count(sketches[x] ^ sketches[y]).sum(axis=1, dtype=np.int64)
    return far * (den + num) <= (n[x] + n[y]) * (den - num)


def survivors(
    signs: np.ndarray, x: np.ndarray, y: np.ndarray, steps: list[tuple[int, int]]
) -> np.ndarray:
    """Numbers of the pairs ``(x[i], y[i])`` of signatures that no batch prunes."""
    alive, same, before = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    for n, least in steps:
        same = same + (signs[x[alive], before:n] == signs[y[alive], before:n]).sum(axis=1)
        keep = same >= least
        alive, same, before = alive[keep], same[keep], n
    return alive


def _matrix(column: pa.Array, size: int, kind: type = np.uint32) -> np.ndarray:
    data, bounds = bytes_of(column)
    return np.frombuffer(data[bounds[0] : bounds[-1]].tobytes(), kind).reshape(-1, size)


def _members(docs: DataFrame, n: int, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                sets, first = shingle_sets(part, n)
                ids = class_ids(sets, first)
                _, lead = np.unique(ids, return_index=True)  # copies in a slice send their signature once
                own, odd = signatures(sets, first, size), parity_sketches(sets, first)
                signs, sketches = [None] * part.n_texts, [None] * part.n_texts
                for i in lead.tolist():
                    if first[i] < first[i + 1]:
                        signs[i], sketches[i] = own[i].tobytes(), odd[i].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, part.n_texts),
                        pa.array(np.diff(first)),
                        batch.column(2).slice(part.first, part.n_texts),
                        pa.array(ids.view(np.int64)),
                        pa.array(signs, pa.binary()),
                        pa.array(sketches, pa.binary()),
                    ],
                    ["id", "n", "text_key", "cls", "sign", "sketch"],
                )

    return docs.select("_id", "_text", F.xxhash64("_text")).mapInArrow(
        run, "id long, n long, text_key long, cls long, sign binary, sketch binary"
    )


def _bands(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(_matrix(batch.column(1), bands * rows), bands, rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), bands))],
                ["key", "cls"],
            )

    return classes.select("cls", "sign").mapInArrow(run, "key long, cls long")


def _shared(keys: DataFrame) -> DataFrame:
    """The rows of keys that several classes have, with the number of classes.

    The aggregate is written before it is joined back, so that the join of a crowded key can be split.
    """
    several = cut_lineage(
        keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "several"
    )
    return keys.join(several, "key")


def _stars(rows: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of each key's most connected member ``a`` with the others."""
    fame = cut_lineage(rows.groupBy("cls").agg(F.sum("size").alias("fame")), "fame")
    hubs = cut_lineage(
        rows.join(fame, "cls").groupBy("key").agg(F.max(F.struct("fame", "cls"))["cls"].alias("hub")), "hubs"
    )
    return rows.join(hubs, "key").filter("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()


def _verified(pairs: DataFrame, classes: DataFrame, size: int, steps: list, num: int, den: int) -> DataFrame:
    """The pairs that sizes, sequential verification and sketches do not rule out."""
    side = lambda x: classes.select(
        F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("sign").alias(f"sign_{x}"), F.col("sketch").alias(f"sketch_{x}")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_rows
            signs = np.concatenate([_matrix(batch.column(i), size) for i in (2, 3)])
            sketches = np.concatenate([_matrix(batch.column(i), SKETCH_BITS // 64, np.uint64) for i in (4, 5)])
            n = np.concatenate([batch.column(i).to_numpy() for i in (6, 7)])
            keep = survivors(signs, np.arange(k), np.arange(k, 2 * k), steps)
            keep = keep[may_link(sketches, n, keep, keep + k, num, den)]
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep)) for i in (0, 1)], ["a", "b"])

    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .filter(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
        .select("a", "b", "sign_a", "sign_b", "sketch_a", "sketch_b", "n_a", "n_b")
        .mapInArrow(run, "a long, b long")
    )


def _left_over(
    shared: DataFrame, groups: DataFrame, classes: DataFrame, size: int, rows: int, steps: list, num: int, den: int
) -> DataFrame:
    """Pairs of different components that share a key and that neither batches nor sketches rule out.

    Keys with more than ``BLOCK`` members are cut into blocks, and each two blocks meet in one place.
    """
    placed = cut_lineage(
        shared.select("key", "cls")
        .join(groups.withColumnRenamed("node", "cls"), "cls", "left")
        .withColumn("component", F.coalesce("component", "cls")),
        "placed",
    )
    open_keys = cut_lineage(
        placed.groupBy("key")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"))
        .filter("lo < hi")
        .select("key", F.ceil(F.col("members") / F.lit(BLOCK)).cast("int").alias("blocks")),
        "open",
    )
    live = placed.join(open_keys, "key").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    meet = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "component"
    )

    def pairs(table: pa.Table) -> pa.RecordBatch:
        out = [np.zeros((0, 2), np.int64)]
        if table.num_rows:
            key, i, j, cls, component, n = (table.column(c).to_numpy() for c in range(6))
            signs = _matrix(table.column(6).combine_chunks(), size)
            sketches = _matrix(table.column(7).combine_chunks(), SKETCH_BITS // 64, np.uint64)
            number = np.cumsum(np.concatenate([[0], (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)]))
            longest = int(np.bincount(number).max())
            waiting, held = [], 0
            for apart in range(1, longest + 1):
                x = np.flatnonzero(number[apart:] == number[:-apart]) if apart < longest else np.zeros(0, np.int64)
                y = x + apart
                ok = component[x] != component[y]
                ok &= np.minimum(n[x], n[y]) * den >= np.maximum(n[x], n[y]) * num
                waiting.append((x[ok], y[ok]))
                held += int(ok.sum())
                if held >= PAIRS_AT_ONCE or apart == longest:
                    x, y = (np.concatenate(side) for side in zip(*waiting, strict=True))
                    waiting, held = [], 0
                    near = survivors(signs, x, y, steps)
                    near = near[may_link(sketches, n, x[near], y[near], num, den)]
                    x, y = x[near], y[near]
                    agree = (signs[x] == signs[y]).reshape(len(x), size // rows, rows).all(axis=2)
                    here = agree.argmax(axis=1) == (key[x] & BAND_MASK)  # in a later band they meet again
                    x, y = cls[x[here]], cls[y[here]]
                    out.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0))
        found = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            if table.num_rows == 0:
                continue
            # The last group may go on in the next batch.
            group = np.stack([table.column(i).to_numpy() for i in range(3)])
            other = np.flatnonzero((group != group[:, -1:]).any(axis=0))
            start = int(other[-1]) + 1 if len(other) else 0
            yield pairs(table.slice(0, start))
            held = table.slice(start)
        if held is not None:
            yield pairs(held)

    return (
        meet.join(classes.select("cls", "n", "sign", "sketch"), "cls")
        .select("key", "i", "j", "cls", "component", "n", "sign", "sketch")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInArrow(run, "a long, b long")
        .distinct()
    )


def minhash_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    num: int = 80,
    den: int = 100,
    rows: int = ROWS,
    miss: float = MISS,
) -> DataFrame:
    """Components of documents whose sets of word ``n``-grams have Jaccard >= ``num``/``den``.

    Returns one row per row of ``docs``: ``id`` (as long), ``n_shingles``, ``component`` (the smallest id
    reachable by links, the own id included), ``kept`` (``id`` is the component), ``text_key`` and ``cls``,
    hashes of the text and of its set.  Words are runs outside ASCII white space, A-Z folded; a text of
    fewer than ``n`` words has its whole sequence as its one n-gram.

    Every link returned is checked on the whole sets.  A link is missed where no band agrees or a
    batch prunes the pair, each with a probability of about ``miss`` at the threshold and less above it.

    A null, empty or blank text has no n-grams, size 0, links with nothing and is kept.  A row with a null
    id gets the component of its class, null where no row of the component has an id (then all these rows
    are kept: there is no id to choose by).  Repeated rows share a component and are kept alike; rows
    with one id and several texts stay separate nodes.  Extra columns are ignored.  An empty table gives
    an empty result.  Equal sets are found by a 64-bit fingerprint of 64-bit hashes of n-grams.
    """
    if n < 1 or rows < 1 or not 0 < num <= den or not 0 < miss < 1:
        raise ValueError("need n >= 1, rows >= 1, 0 < num <= den and 0 < miss < 1")
    bands = number_of_bands(num / den, rows, miss)
    size = bands * rows
    steps = least_agreements(num / den, size, BATCH, miss)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    members = cut_lineage(_members(docs, n, size), "members")
    classes = cut_lineage(
        members.filter("n > 0")
        .groupBy("cls")
        .agg(F.min("id").alias("rep"), F.min("text_key").alias("text_key"), F.min("n").alias("n"), F.max("sign").alias("sign"), F.max("sketch").alias("sketch")),
        "classes",
    )
    shared = cut_lineage(_shared(_bands(classes, bands, rows)), "shared")
    near = cut_lineage(_verified(_stars(shared), classes, size, steps, num, den), "near")
    edges = cut_lineage(linked_pairs(near, sets_of(near, classes, docs, n), num, den), "links")
    left = cut_lineage(_left_over(shared, components(edges), classes, size, rows, steps, num, den), "left")
    groups = cut_lineage(
        components(edges.union(linked_pairs(left, sets_of(left, classes, docs, n), num, den))), "groups"
    )
    placed = cut_lineage(
        classes.join(groups.withColumnRenamed("node", "cls"), "cls", "left").select(
            "cls", "rep", F.coalesce("component", "cls").alias("root")
        ),
        "placed",
    )
    least = cut_lineage(placed.groupBy("root").agg(F.min("rep").alias("component")), "least")
    named = cut_lineage(placed.join(least, "root").select("cls", "component"), "named")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return members.drop("sign", "sketch").join(named, "cls", "left").select(
        "id", F.col("n").alias("n_shingles"), component.alias("component"),
        F.col("id").eqNullSafe(component).alias("kept"), "text_key", "cls",
    )
