"""Similarity join on word n-grams with parity sketches.

Every distinct n-gram of a document toggles one bit of a sparse bit sketch, so the Hamming
distance of two sketches never exceeds the symmetric difference of the two sets.  Sizes are cut
into bands; two sets that may link lie in one band or in neighbouring ones.  For a band the
largest symmetric difference ``d`` of a link is known, and its sketches are cut into
``k = d + 1 + spare`` parts: a linked pair agrees in at least ``spare + 1`` parts, whatever
differs.  The parts (hashed) are the join keys.  Three rules keep groups small without losing a
link:

* copies of one set are one class, found by one aggregate, before any key is joined;
* blank parts are keys only of sketches with ``spare + 1`` blank parts or more;
* a sketch drops its crowded keys where they and its blank parts are at most ``spare`` together, for
  another key must agree too.

No pairs of a group are sent anywhere.  First every key's most connected member, the likely
original of a group of near copies, meets the others, which finds most components with one pair per
member.  Then the members of keys that still hold several components are compared inside their tasks,
in blocks of bounded size, on dense 1,024-bit sketches; only pairs of different components that the
sketches do not rule out leave the task.  All pairs are checked on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.scale import cut_lineage, drop_steps

from .graph import components
from .names import free_names
from .words import Slice, cut, distinct_sorted, mix, slices, windows

PART_BITS = 16
# Arrays over a slice take eight bytes for each of its own; idle workers keep some of that.
SLICE = 1 << 20
SKETCH_WORDS = 16
CROWDED = 1_000
BLOCK = 1_024
SEEN_CLASSES = 100_000
MEMBERS_PER_TASK = 512
MAX_SENT = 500_000  # two numbers each: some 16 MB in a task
MAX_SIZE = 1 << 40


class Bands:
    """Size bands, and for each the largest difference of a link and the number of parts."""

    def __init__(self, num: int, den: int):
        starts = [1]
        while starts[-1] < MAX_SIZE:
            starts.append(max(starts[-1] + 1, (starts[-1] - 1) * den // num + 1))
        if len(starts) > 256:
            raise ValueError("the threshold makes more than 255 size bands")
        largest = [s - 1 for s in starts[1:]]
        self.starts = np.array(starts[:-1], np.int64)
        self.diff = np.array([2 * (den - num) * s // (den + num) for s in largest], np.int64)
        self.spare = 2 + self.diff // 16
        self.parts = self.diff + 1 + self.spare

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, sizes, "right") - 1


def shingle_sets(part: Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, ascending; letters A-Z are folded."""
    hashes, first = windows(part.word_hashes(fold=True), part.first_word, n)
    return distinct_sorted(hashes, first)


def class_ids(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set."""
    sizes = np.diff(first)
    out = sizes.astype(np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        with np.errstate(over="ignore"):
            out[full] += np.bitwise_xor.reduceat(mix(sets), first[full])
            out[full] += np.add.reduceat(mix(sets + np.uint64(7)), first[full])
    return mix(out)


def dense_sketches(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 1,024-bit parity sketch of each set as sixteen 64-bit numbers."""
    n, bits = len(first) - 1, 64 * SKETCH_WORDS
    owner = np.repeat(np.arange(n), np.diff(first))
    at = owner * bits + (mix(sets ^ np.uint64(0x51ED)) % np.uint64(bits)).astype(np.int64)
    parity = (np.bincount(at, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(n, bits), axis=1).view(np.int64)


def _filled_parts(sets: np.ndarray, first: np.ndarray, bands: Bands, up: int) -> tuple[np.ndarray, ...]:
    """Band, use and number of parts of each set; set, number and content of each part that is not blank."""
    sizes = np.diff(first)
    band = np.minimum(bands.of(np.maximum(sizes, 1)) + up, len(bands.parts) - 1)
    use = (sizes > 0) & (bands.diff[band] > 0)
    k = np.where(use, bands.parts[band], 0)
    base = np.concatenate([[0], np.cumsum(k)])
    keep = np.repeat(use, sizes)
    own = sets[keep]
    owner = np.repeat(np.arange(len(sizes)), np.where(use, sizes, 0))
    number = ((own >> np.uint64(32)) * k[owner].astype(np.uint64)) >> np.uint64(32)
    slot = base[owner] + number.astype(np.int64)
    start = np.flatnonzero(np.diff(slot, prepend=-1))
    bit = mix((own & np.uint64((1 << PART_BITS) - 1)) + np.uint64(1))
    parity = np.bitwise_xor.reduceat(bit, start) if len(start) else bit
    start, parity = start[parity != 0], parity[parity != 0]
    who = owner[start]
    return band, use, k, who, slot[start] - base[who], parity


def blank_parts(sets: np.ndarray, first: np.ndarray, bands: Bands, up: int) -> np.ndarray:
    """How many parts of each sketch are blank, in the own band (0) or the next one (1)."""
    _, _, k, who, _, _ = _filled_parts(sets, first, bands, up)
    return k - np.bincount(who, minlength=len(k))


def part_keys(
    sets: np.ndarray, first: np.ndarray, bands: Bands, up: int
) -> tuple[np.ndarray, np.ndarray]:
    """Join keys and the set each belongs to, for the own band (0) or the next one (1).

    The number of the band is in the low eight bits of a key.
    """
    band, use, k, who, which, parity = _filled_parts(sets, first, bands, up)
    blank = k - np.bincount(who, minlength=len(k))
    for i in np.flatnonzero(use & (blank >= k - bands.diff[band])):
        missing = np.setdiff1d(np.arange(k[i]), which[who == i])
        who = np.concatenate([who, np.full(len(missing), i)])
        which = np.concatenate([which, missing])
        parity = np.concatenate([parity, np.zeros(len(missing), np.uint64)])
    place = (band[who].astype(np.uint64) << np.uint64(40)) + which.astype(np.uint64)
    keys = mix(parity ^ mix(place + np.uint64(1)))
    keys = (keys & ~np.uint64(255)) | band[who].astype(np.uint64)
    return keys, who


def _members(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            for part in slices(batch.column(1), SLICE):
                sets, first = shingle_sets(part, n)
                sketch = dense_sketches(sets, first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, part.n_texts),
                        pa.array(np.diff(first)),
                        batch.column(2).slice(part.first, part.n_texts),
                        pa.array(class_ids(sets, first).view(np.int64)),
                        pa.FixedSizeListArray.from_arrays(
                            pa.array(sketch.ravel()), SKETCH_WORDS
                        ).cast(pa.list_(pa.int64())),
                        *(pa.array(blank_parts(sets, first, bands, up)) for up in (0, 1)),
                    ],
                    ["id", "n", "text_key", "cls", "sketch", "blank", "blank_up"],
                )

    return docs.select(F.col(id_col).cast("long"), text_col, F.xxhash64(text_col)).mapInArrow(
        run, "id long, n long, text_key long, cls long, sketch array<long>, blank long, blank_up long"
    )


def _keys(docs: DataFrame, text_col: str, n: int, num: int, den: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        seen: dict[int, None] = {}
        for batch in batches:
            for part in slices(batch.column(0), SLICE):
                sets, first = shingle_sets(part, n)
                ids = class_ids(sets, first).view(np.int64)
                fresh = np.zeros(len(ids), bool)
                for i, c in enumerate(ids.tolist()):
                    if c not in seen:  # copies in one task send their keys once
                        seen[c] = None
                        fresh[i] = True
                while len(seen) > SEEN_CLASSES:
                    del seen[next(iter(seen))]
                for up in (0, 1):
                    keys, who = part_keys(sets, first, bands, up)
                    keep = fresh[who]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[keep].view(np.int64)),
                            pa.array(ids[who[keep]]),
                            pa.array(np.full(int(keep.sum()), up, np.int8)),
                        ],
                        ["key", "cls", "up"],
                    )

    return docs.select(text_col).mapInArrow(run, "key long, cls long, up byte")


def _sets(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0), SLICE):
                sets, first = shingle_sets(part, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(class_ids(sets, first).view(np.int64)),
                        pa.array([s.tobytes() for s in cut(sets, first)], pa.binary()),
                    ],
                    ["cls", "grams"],
                )

    return docs.select(text_col).mapInArrow(run, "cls long, grams binary")


def _sets_of(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """The sets of the classes in ``pairs``, each from the text of its representative.

    The representative is named by id, which may be null, and text hash.  Up to ``MAX_SENT`` of them
    their names are sent to where the texts are; beyond that texts and names are joined by a shuffle.
    Only the texts of repeated rows are made single.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    need = cut_lineage(classes.join(ends, "cls", "left_semi").select("cls", "rep", "rep_key", "again"), "need")
    send = F.broadcast if need.count() <= MAX_SENT else (lambda df: df)
    same = F.col("_id").cast("long").eqNullSafe(F.col("rep")) & (F.xxhash64("_text") == F.col("rep_key"))
    texts = docs.join(send(need), same).select("_text", "rep", "rep_key", "again")
    single = texts.filter("not again").select("_text")
    several = texts.filter("again").dropDuplicates(["rep", "rep_key"]).select("_text")
    sets = cut_lineage(_sets(single.union(several), "_text", n), "sets")
    drop_steps(need)
    return sets


def _shared(keys: DataFrame) -> DataFrame:
    """The rows of keys that several classes have, and how many rows the key has.

    Two sets of the lower band meet in their own band, so a key needs one of the upper band.
    """
    by_key = Window.partitionBy("key")
    return (
        keys.select(
            "key", "cls", "up",
            F.min("cls").over(by_key).alias("lo"), F.max("cls").over(by_key).alias("hi"),
            F.min("up").over(by_key).alias("least"), F.count("*").over(by_key).alias("size"),
        )
        .filter("lo < hi and least = 0")
        .select("key", "cls", "up", "size")
        .distinct()
    )


def _without_crowded(shared: DataFrame, classes: DataFrame, bands: Bands) -> DataFrame:
    """Leave out crowded keys of the sketches where they and the blank parts are at most ``spare``.

    All blank parts count, also where they are keys: the other sketch may not have sent its own.  So of
    a linked pair that agrees in ``spare + 1`` parts, either one agrees that is neither blank nor
    crowded, or both sketches keep their crowded keys.
    """
    crowded = shared.filter(F.col("size") > CROWDED).withColumn("band", F.pmod("key", F.lit(256)).cast("int"))
    spare = F.element_at(F.lit([int(s) for s in bands.spare]), F.col("band") + 1)
    many = (
        crowded.groupBy("cls", "band", "up")
        .agg(F.count("*").alias("crowds"))
        .join(classes.select("cls", "blank", "blank_up"), "cls")
        .filter(F.col("crowds") + F.when(F.col("up") == 0, F.col("blank")).otherwise(F.col("blank_up")) > spare)
    )
    return shared.filter(F.col("size") <= CROWDED).union(
        crowded.join(many, ["cls", "band", "up"], "left_semi").select(*shared.columns)
    )


def _stars(rows: DataFrame) -> DataFrame:
    """Pairs of each key's most connected member with the others."""
    fame = rows.groupBy("cls").agg(F.sum("size").alias("fame"))
    hubs = rows.join(fame, "cls").groupBy("key").agg(F.max(F.struct("fame", "cls"))["cls"].alias("hub"))
    return (
        rows.join(hubs, "key")
        .filter("cls <> hub")
        .select(F.col("hub").alias("a"), F.col("cls").alias("b"))
        .distinct()
    )


def _left_over(rows: DataFrame, groups: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components that share a key and that sizes and sketches do not rule out.

    Keys with more than ``BLOCK`` members are cut into blocks, and each two blocks meet in one place.
    """
    placed = rows.select("key", "cls", "up").join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "component", F.coalesce("component", "cls")
    )
    open_keys = (
        placed.groupBy("key")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"))
        .filter("lo < hi")
        .select("key", F.ceil(F.col("members") / F.lit(BLOCK)).cast("int").alias("blocks"))
    )
    live = placed.join(open_keys, "key").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    meet = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "component", "up",
    )
    described = meet.join(classes.select("cls", "n", "sketch"), "cls")

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
            start = int(np.flatnonzero((group != group[:, -1:]).any(axis=0))[-1:].sum() + 1) if (
                (group != group[:, -1:]).any()
            ) else 0
            yield pairs(table.slice(0, start))
            held = table.slice(start).combine_chunks()
        if held is not None:
            yield pairs(held)

    def pairs(table: pa.Table) -> pa.RecordBatch:
        out = [np.zeros((0, 2), np.int64)]
        if table.num_rows:
            key, i, j, cls, component, up, n = (table.column(c).to_numpy() for c in range(7))
            sketch = table.column(7).combine_chunks().flatten().to_numpy().reshape(-1, SKETCH_WORDS)
            number = np.cumsum(np.concatenate([[0], (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)]))
            longest = int(np.bincount(number).max())
            for apart in range(1, longest):
                x = np.flatnonzero(number[apart:] == number[:-apart])
                y = x + apart
                ok = (component[x] != component[y]) & (np.minimum(up[x], up[y]) == 0)
                ok &= np.minimum(n[x], n[y]) * den >= np.maximum(n[x], n[y]) * num
                x, y = x[ok], y[ok]
                far = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64)
                near = far * (den + num) <= (n[x] + n[y]) * (den - num)
                x, y = cls[x[near]], cls[y[near]]
                out.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
        found = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return (
        described.select("key", "i", "j", "cls", "component", F.col("up").cast("int").alias("up"), "n", "sketch")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInArrow(run, "a long, b long")
        .distinct()
    )


def _distance(a: str, b: str) -> Column:
    terms = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_WORDS)]
    return sum(terms[1:], terms[0])


def _may_link(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Keep the pairs that sizes and dense sketches do not rule out."""
    side = lambda x: classes.select(
        F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")
    )
    both = F.col("n_a") + F.col("n_b")
    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .filter(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
        .filter(_distance("sketch_a", "sketch_b") * (den + num) <= both * (den - num))
        .select("a", "b")
    )


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sets link.

    Members come to the set of their hub, sorted behind it; a hub with many members is sent to
    several tasks.  A task holds one hub's set at a time.
    """
    spread = pairs.groupBy("a").agg(
        F.floor(F.count("*") / F.lit(MEMBERS_PER_TASK)).cast("int").alias("more")
    )
    hubs = (
        spread.join(sets.withColumnRenamed("cls", "a"), "a")
        .select("a", F.explode(F.sequence(F.lit(0), F.col("more"))).alias("salt"), "grams")
        .select("a", "salt", F.lit(None).cast("long").alias("b"), "grams")
    )
    members = (
        pairs.join(spread, "a")
        .join(sets.withColumnRenamed("cls", "b"), "b")
        .select("a", F.pmod(F.xxhash64("b"), F.col("more") + 1).cast("int").alias("salt"), "b", "grams")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            names = (batch.column(i).to_pylist() for i in (0, 2))
            for left, right, grams in zip(*names, batch.column(3), strict=True):
                # Sets are read where they lie in the batch; that of a hub stays for longer.
                values = np.frombuffer(grams.as_buffer(), np.uint64)
                if right is None:
                    hub, own = left, values.copy()
                elif left == hub and len(own):
                    at = np.minimum(np.searchsorted(own, values), len(own) - 1)
                    common = int((own[at] == values).sum())
                    if den * common >= num * (len(own) + len(values) - common):
                        a.append(left)
                        b.append(right)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]
            )

    return (
        hubs.union(members)
        .repartition("a", "salt")
        .sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        .mapInArrow(run, "a long, b long")
    )


def ngram_jaccard_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    num: int = 80,
    den: int = 100,
) -> DataFrame:
    """Components of documents whose sets of word ``n``-grams have Jaccard >= ``num``/``den``.

    Returns one row per row of ``docs``: ``id`` (as long), ``n_shingles`` and ``component``, the
    smallest id reachable by links, the own id included, and two hashes: ``text_key`` of the text and
    ``cls`` of the set of n-grams.  Words are runs outside ASCII white
    space, A-Z folded; a text of fewer than ``n`` words has its whole sequence as its one n-gram.

    A null, empty or blank text has no n-grams, size 0 and links with nothing.  A row with a null
    id gets the component of its class, which is null where all of its class have no id.  Repeated
    rows are copies and share a component; rows with one id and several texts stay separate nodes.
    Extra columns are ignored.  An empty table gives an empty result.  Sets are compared by
    64-bit hashes of n-grams, and equal sets are found by a 64-bit fingerprint.
    """
    if n < 1 or not 0 < num <= den:
        raise ValueError("need n >= 1 and 0 < num <= den")
    docs = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    id_col, text_col = "_id", "_text"
    members = cut_lineage(_members(docs, id_col, text_col, n, num, den), "members")
    found = cut_lineage(
        members.filter("n > 0")
        .groupBy("cls")
        .agg(
            F.min(F.when(F.col("id").isNotNull(), F.struct("id", "text_key"))).alias("named"),
            F.min("text_key").alias("least_key"), F.min("n").alias("n"), F.min("sketch").alias("sketch"),
            F.min("blank").alias("blank"), F.min("blank_up").alias("blank_up"),
        )
        .select(
            "cls", F.col("named.id").alias("rep"), F.coalesce("named.text_key", "least_key").alias("rep_key"),
            "n", "sketch", "blank", "blank_up",
        ),
        "classes",
    )
    repeated = members.groupBy("id", "text_key").agg(F.count("*").alias("times")).filter("times > 1")
    twice = F.col("rep").eqNullSafe(F.col("id")) & (F.col("rep_key") == F.col("text_key"))
    classes = cut_lineage(
        found.join(repeated, twice, "left").drop("id", "text_key").withColumn("again", F.col("times").isNotNull()),
        "classes",
    )
    drop_steps(found)
    shared = cut_lineage(_shared(_keys(docs, text_col, n, num, den)), "shared")
    rows = cut_lineage(_without_crowded(shared, classes, Bands(num, den)), "keys")
    drop_steps(shared)
    near = cut_lineage(_may_link(_stars(rows), classes, num, den), "near")
    sets = _sets_of(near, classes, docs, n)
    edges = cut_lineage(_verify(near, sets, num, den), "links")
    drop_steps(near, sets)
    linked = components(edges)
    left = cut_lineage(_left_over(rows, linked, classes, num, den), "left")
    drop_steps(rows, linked)
    sets = _sets_of(left, classes, docs, n)
    groups = components(edges.union(_verify(left, sets, num, den)))
    # What is returned still reads members, classes and groups.
    drop_steps(edges, left, sets)
    placed = classes.join(groups.withColumnRenamed("node", "cls"), "cls", "left").select(
        "cls", "rep", F.coalesce("component", "cls").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("rep").alias("component"))
    named = placed.join(least, "root").select("cls", "component")
    return (
        members.join(named, "cls", "left")
        .select(
            "id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"),
            "text_key",
            "cls",
        )
    )


def one_of_each_class(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does, columns unchanged.

    ``found`` is what :func:`ngram_jaccard_classes` says of ``docs``.  The document with the smallest id
    stays, of several with this id the one whose text hash is smallest; equal rows stay once.
    Documents without n-grams are in no group and all stay.  Where no row of a group has an id, each
    set of n-grams keeps one text.
    """
    group = F.struct(F.col("component"), F.when(F.col("component").isNull(), F.col("cls")))
    stays = (
        found.filter("n_shingles > 0")
        .filter(F.col("id").eqNullSafe(F.col("component")))
        .groupBy(group.alias("group"))
        .agg(F.min("text_key").alias("text_key"))
        .select(F.col("group.component").alias("id"), "text_key")
    )
    times = found.filter("n_shingles > 0").groupBy("id", "text_key").agg(F.count("*").alias("times"))
    stays = stays.alias("s").join(
        times.alias("t"), F.expr("s.id <=> t.id and s.text_key = t.text_key"), "left"
    ).select("s.id", "s.text_key", F.col("times") > 1)
    blank = found.filter("n_shingles = 0").select("id", "text_key", F.lit(False)).distinct()
    own_id, own_key, again = free_names(docs, "id", "text_key", "again")
    chosen = cut_lineage(stays.union(blank).toDF(own_id, own_key, again), "stays")
    row_id, row_key = free_names(docs, "row_id", "row_key")
    named = docs.withColumns({row_id: F.col(f"`{id_col}`").cast("long"), row_key: F.xxhash64(F.col(f"`{text_col}`"))})
    match = F.col(row_id).eqNullSafe(F.col(own_id)) & (F.col(row_key) == F.col(own_key))
    kept = named.join(chosen, match)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Only rows that are there several times need to be told apart.
    single = kept.filter(~F.col(again)).select(*columns)
    several = kept.filter(F.col(again)).dropDuplicates([row_id, row_key]).select(*columns)
    return single.union(several)
