"""Ranked lexical search over two trees.

The score of an item and a document is a sum over the item's terms of an item coordinate (number of
occurrences times weight of the term) times a document coordinate (which grows with the
occurrences and shrinks with the length of the document).  A node of a tree holds, for every term, the
largest coordinate below it; the sum of products of two nodes' maxima is never less than the score of
any item below the one and any document below the other.

Items are dealt with in blocks of bounded size (``ITEMS_PER_BLOCK``), for each of which

1. documents are put in the order of the term of the block that counts most in them, by ranges, so that
   neighbours are alike; each task has a stretch of that order, a tree over every ``LEVELS[0]`` rows;
2. in a first pass a task opens, for each leaf of the item tree, the leaf of documents with the largest
   bound.  The kth score found there is a floor that k documents reach; the largest floor of all tasks
   is each item's first weakest score;
3. in a second pass a task goes down both trees at once.  A pair of nodes whose bound is below the least
   of the weakest kth scores under the item node is dropped as a whole; the weakest scores rise as
   scores are found.  What is left is scored exactly, and the best k of each task meet.

All arithmetic is in 64-bit integers, and a pair is dropped only where its bound is strictly below the
weakest score, so equal scores are still decided by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweave.scale import cut_lineage, new_table_path

from .order import with_total_before
from .set_links import bit_filter, maybe_in
from .words import Slice, slices

ITEMS_PER_BLOCK = 1_024
TERMS_PER_BLOCK = 1 << 20
#: Rows under one node at each level of the two trees, from the roots to single rows.
DOC_LEVELS = (2_048, 256, 32, 1)
ITEM_LEVELS = (512, 64, 8, 1)
ENTRIES_AT_ONCE = 1 << 20

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms_of(texts: pa.Array) -> Iterator[Slice]:
    """Slices of whole texts whose words are maximal runs of letters, digits and non-ASCII characters."""
    return slices(texts, inside=_TERM)


def _counted(texts: pa.Array, among: np.ndarray | None) -> Iterator[tuple]:
    """For slices of texts: the slice; owner, hash and occurrences of each distinct term, by owner and hash."""
    for part in terms_of(texts):
        hashes, owner = part.word_hashes(fold=True), part.text_of_word()
        if among is not None:
            keep = maybe_in(among, hashes)
            hashes, owner = hashes[keep], owner[keep]
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        yield part, owner[at], hashes[at].view(np.int64), np.diff(np.append(at, len(hashes)))


def _lists(bounds: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int64)))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the lists of a column, from 0, and their numbers in one array."""
    bounds = lists.offsets.to_numpy()
    return bounds - bounds[0], lists.values.to_numpy()[bounds[0] : bounds[-1]]


def _vectors(rows: DataFrame, among: np.ndarray | None) -> DataFrame:
    """Per row: id, hash of the text, number of terms, and its distinct terms (in ``among``) with counts."""
    sent = rows.sparkSession.sparkContext.broadcast(among) if among is not None else None  # FILTER_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, owner, terms, times in _counted(batch.column(1), sent.value if sent else None):
                bounds = np.searchsorted(owner, np.arange(part.n_texts + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, part.n_texts),
                        batch.column(2).slice(part.first, part.n_texts),
                        pa.array(part.n_words.astype(np.int64)),
                        _lists(bounds, terms),
                        _lists(bounds, times),
                    ],
                    ["id", "text_key", "n", "terms", "times"],
                )

    return rows.select("_id", "_text", F.xxhash64("_text")).mapInArrow(
        run, "id long, text_key long, n long, terms array<long>, times array<long>"
    )


class Sparse:
    """Rows of a sparse matrix: sorted codes ``row * width + column`` and their numbers."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, width: int, rows: int):
        code = row * width + column
        order = np.argsort(code, kind="stable")
        self.code, self.value, self.width, self.rows = code[order], value[order], width, rows
        self.start = np.searchsorted(self.code, np.arange(rows + 1) * width)

    def maxima(self, each: int) -> Sparse:
        """One row for each ``each`` rows, with the largest number of every column."""
        row, column = np.divmod(self.code, self.width)
        code = row // each * self.width + column
        order = np.argsort(code, kind="stable")
        code, value = code[order], self.value[order]
        at = np.flatnonzero(np.diff(code, prepend=-1))
        most = np.maximum.reduceat(value, at) if len(at) else value
        row, column = np.divmod(code[at], self.width)
        return Sparse(row, column, most, self.width, -(-self.rows // each))

    def products(self, other: Sparse, own: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Inner products of rows ``own[i]`` with rows ``others[i]`` of another matrix."""
        out = np.zeros(len(own), np.int64)
        size = (self.start[1:] - self.start[:-1])[own]
        total = np.concatenate([[0], np.cumsum(size)])
        at = 0
        while at < len(own):
            to = max(at + 1, int(np.searchsorted(total, total[at] + ENTRIES_AT_ONCE, "right")) - 1)
            n = size[at:to]
            first = total[at:to] - total[at]
            entry = np.repeat(self.start[own[at:to]] - first, n) + np.arange(int(n.sum()))
            want = self.code[entry] + np.repeat((others[at:to] - own[at:to]) * self.width, n)
            k = np.minimum(np.searchsorted(other.code, want), max(len(other.code) - 1, 0))
            hit = np.flatnonzero(other.code[k] == want) if len(other.code) else k[:0]
            sums = np.concatenate([[0], np.cumsum(self.value[entry[hit]] * other.value[k[hit]])])
            ends = np.searchsorted(hit, np.append(first, int(n.sum())))
            out[at:to] = sums[ends[1:]] - sums[ends[:-1]]
            at = to
        return out


class Tree(list):
    """Matrices of a tree, from the roots to single rows; ``each[i]`` rows are under a node of level ``i``."""

    def __init__(self, rows: Sparse, each: tuple[int, ...]):
        super().__init__([rows])
        for below, above in zip(each[:0:-1], each[-2::-1], strict=True):
            self.insert(0, self[0].maxima(above // below))
        self.each = each

    def children(self, nodes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The children of nodes of ``level``, and which of ``nodes`` each belongs to."""
        times = self.each[level] // self.each[level + 1]
        child = nodes[:, None] * times + np.arange(times)
        ok = child < self[level + 1].rows
        return child[ok], np.nonzero(ok)[0]


def _opened(items: Tree, docs: Tree, i: np.ndarray, d: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of node pairs of ``level``."""
    a, parent = items.children(i, level)
    b, pair = docs.children(d[parent], level)
    return a[pair], b


def _least_below(floor: np.ndarray, each: int) -> np.ndarray:
    return np.minimum.reduceat(floor, np.arange(0, len(floor), each))


class Found:
    """Item, score, id, whether it is null, and hash of the text of scored pairs, as arrays side by side."""

    def __init__(self, item, score, order, null, key):
        self.columns = [item, score, order, null, key]

    def __getitem__(self, at) -> Found:
        return Found(*(c[at] for c in self.columns))

    def with_more(self, other: Found) -> Found:
        return Found(*(np.concatenate(c) for c in zip(self.columns, other.columns, strict=True)))


class Best:
    """The best ``k`` scores of each item so far, and what a score must reach (``floor``) to matter."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = floor.copy(), k
        none = np.zeros(0, np.int64)
        self.found = Found(none, none, none, none.astype(bool), none)

    def add(self, more: Found) -> None:
        item, score = more.columns[:2]
        found = self.found.with_more(more[(score >= self.floor[item]) & (score > 0)])
        item, score, order, null, key = found.columns
        by = np.lexsort((key, null, order, -score, item))
        rank = np.arange(len(by)) - np.searchsorted(item[by], item[by])
        self.found = found[by[rank < self.k]]
        item, score = self.found.columns[:2]
        full = rank[rank < self.k] == self.k - 1
        self.floor[item[full]] = np.maximum(self.floor[item[full]], score[full])


def _search(items: Tree, docs: Tree, rows: Found, best: Best) -> int:
    """Go down both trees; offer what no bound rules out.  Returns the number of pairs that were scored."""
    i, d = (x.ravel() for x in np.meshgrid(np.arange(items[0].rows), np.arange(docs[0].rows), indexing="ij"))
    last = len(docs) - 1
    for level in range(last):
        bound = items[level].products(docs[level], i, d)
        keep = (bound >= _least_below(best.floor, items.each[level])[i]) & (bound > 0)
        i, d = _opened(items, docs, i[keep], d[keep], level)
    best.add(Found(i, items[last].products(docs[last], i, d), *rows[d].columns[2:]))
    return len(i)


def _probe(items: Tree, docs: Tree, rows: Found, best: Best) -> None:
    """Offer the documents of the leaf with the largest bound for each leaf of items."""
    last = len(docs) - 1
    i, d = (x.ravel() for x in np.meshgrid(np.arange(items[last - 1].rows), np.arange(docs[last - 1].rows), indexing="ij"))
    pick = items[last - 1].products(docs[last - 1], i, d).reshape(items[last - 1].rows, -1).argmax(axis=1)
    i, d = _opened(items, docs, np.arange(len(pick)), pick, last - 1)
    best.add(Found(i, items[last].products(docs[last], i, d), *rows[d].columns[2:]))


class ItemBlock:
    """Some items: hashes of their terms in ascending order, and the tree over them."""

    def __init__(self, rows: list, k: int):
        of_item = np.repeat(np.arange(len(rows)), [len(r["terms"]) for r in rows])
        terms = np.array([t for r in rows for t in r["terms"]], np.int64)
        weight = np.array([w for r in rows for w in r["weights"]], np.int64)
        self.terms, column = np.unique(terms, return_inverse=True)
        # Items whose heaviest terms are the same lie side by side.
        value = weight * np.array([c for r in rows for c in r["times"]], np.int64)
        lead = np.zeros(len(rows), np.int64)
        by = np.lexsort((column, value, of_item))
        lead[of_item[by]] = column.reshape(-1)[by]
        self.order = np.argsort(lead, kind="stable")
        place = np.argsort(self.order, kind="stable")
        self.numbers = np.array([rows[i]["item"] for i in self.order], np.int64)
        self.weight = np.zeros(len(self.terms), np.int64)
        self.weight[column.reshape(-1)] = weight
        self.tree = Tree(Sparse(place[of_item], column.reshape(-1), value, len(self.terms), len(rows)), ITEM_LEVELS)
        self.doc_levels = DOC_LEVELS
        self.k = k

    def __len__(self) -> int:
        return len(self.numbers)


def _coordinates(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * times // (1_000 * times + 8 * m)


def _placed(vectors: DataFrame, block, stats: dict) -> DataFrame:
    """The documents with a term of the block, their coordinates, and the terms that count most in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: ItemBlock = block.value
        for batch in batches:
            n = batch.column(2).to_numpy()
            (bounds, hashes), times = _flat(batch.column(3)), _flat(batch.column(4))[1]
            owner = np.repeat(np.arange(len(n)), np.diff(bounds))
            at = np.minimum(np.searchsorted(own.terms, hashes), len(own.terms) - 1)
            keep = own.terms[at] == hashes
            at, owner, times = at[keep], owner[keep], times[keep]
            m = 100 - 75 + (75 * n * stats["N"]) // max(stats["L"], 1)
            value = _coordinates(times, m[owner])
            some = np.unique(owner)
            edges = np.searchsorted(owner, np.append(some, len(n)))
            # The two terms with the largest weight times coordinate.
            by = np.lexsort((at, own.weight[at] * value, owner))
            first = at[by][edges[1:] - 1]
            second = np.where(np.diff(edges) > 1, at[by][np.maximum(edges[1:] - 2, edges[:-1])], -1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(some)), batch.column(1).take(pa.array(some)),
                    pa.array(first.astype(np.int64)), pa.array(second.astype(np.int64)),
                    _lists(edges, at), _lists(edges, value),
                ],
                ["id", "text_key", "first", "second", "terms", "values"],
            )

    return vectors.filter("n > 0 and size(terms) > 0").mapInArrow(
        run, "id long, text_key long, first long, second long, terms array<long>, values array<long>"
    )


def _searched(placed: DataFrame, block, floor, probe: bool) -> DataFrame:
    """The best documents of each task for each item of the block: all of them, or only a first floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: ItemBlock = block.value
        best = Best(floor.value if floor is not None else np.zeros(len(own), np.int64), own.k)
        for batch in batches:
            for at in range(0, batch.num_rows, own.doc_levels[0]):
                part = batch.slice(at, own.doc_levels[0])
                bounds, terms = _flat(part.column(2))
                values = _flat(part.column(3))[1]
                owner = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                docs = Tree(Sparse(owner, terms, values, len(own.terms), part.num_rows), own.doc_levels)
                null = np.asarray(part.column(0).is_null())
                ids = np.where(null, np.iinfo(np.int64).max, np.asarray(part.column(0).fill_null(0)))
                none = np.zeros(part.num_rows, np.int64)
                rows = Found(none, none, ids, null, np.asarray(part.column(1)))
                (_probe if probe else _search)(own.tree, docs, rows, best)
        if probe:
            full = np.flatnonzero(best.floor > 0)
            yield pa.RecordBatch.from_arrays([pa.array(own.numbers[full]), pa.array(best.floor[full])], ["item", "floor"])
        else:
            item, score, ids, null, key = best.found.columns
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.numbers[item]), pa.array(ids, mask=null), pa.array(key), pa.array(score)],
                ["item", "id", "text_key", "score"],
            )

    schema = "item long, floor long" if probe else "item long, id long, text_key long, score long"
    return placed.select("id", "text_key", "terms", "values").mapInArrow(run, schema)


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 10,
) -> DataFrame:
    """The ``k`` highest-scoring documents for each item: ``item_id, item_key, rank, doc_id, text_key, score``.

    Terms are runs of letters, digits and non-ASCII characters, A-Z folded.  With ``N`` documents that
    have a term, ``L`` terms in them and ``df`` documents with a term, its weight is
    ``floor(1000 * ln((2 N + 2) / (2 df + 1)))``; a document with ``n`` terms has ``m = 25 + 75 n N div L``,
    and the score sums ``weight * (10**9 tf div (1000 tf + 8 m))`` over the item's terms with repeats.
    Ranks are from 1 and unique; equal scores go by id (null last), then by the hash of the text.

    Every row of ``docs`` is a document, also repeated ones.  Equal rows of ``items`` are one item; an id
    with several texts is one item for each text, told apart by ``item_key``, the hash of its text.  Null
    and blank texts have no terms and no rows, and a score of 0 is none.  Extra columns are ignored.  Empty
    tables give an empty result.  Terms are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    items = items.select(
        F.col(f"`{item_col}`").cast("long").alias("_id"), F.col(f"`{item_text_col}`").cast("string").alias("_text")
    ).distinct()
    asked = cut_lineage(_vectors(items, None).filter("n > 0"), "asked")
    asked = cut_lineage(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    among = bit_filter(asked.select(F.explode("terms").alias("term")))
    vectors = cut_lineage(_vectors(docs, among), "vectors")
    stats = vectors.filter("n > 0").agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first().asDict()
    wanted = asked.select(F.explode("terms").alias("term")).distinct()
    weight = F.floor(1000 * F.log(F.lit(2.0 * stats["N"] + 2) / (2 * F.col("df") + 1))).cast("long")
    lexicon = cut_lineage(
        vectors.select(F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
        .join(wanted, "term", "left_semi")
        .select("term", weight.alias("weight")),
        "lexicon",
    )
    # An item's terms that no document has add nothing.
    known = (
        asked.select("item", F.explode(F.arrays_zip("terms", "times")).alias("t"))
        .select("item", F.col("t.terms").alias("term"), F.col("t.times").alias("times"))
        .join(lexicon, "term")
        .filter("weight > 0")
    )
    ready = cut_lineage(
        known.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "times", "weight"))).alias("t"))
        .select("item", F.col("t.term").alias("terms"), F.col("t.times").alias("times"), F.col("t.weight").alias("weights")),
        "ready",
    )
    # An item counts as its terms and a fixed part, so that a block is bounded in both.
    cost = F.size("terms").cast("long") + TERMS_PER_BLOCK // ITEMS_PER_BLOCK
    blocks = cut_lineage(
        with_total_before(ready, ["item"], cost, "before")
        .withColumn("block", F.floor(F.col("before") / TERMS_PER_BLOCK).cast("long")),
        "blocks",
    )
    numbers = [r.block for r in blocks.select("block").distinct().orderBy("block").toLocalIterator()]
    found = None
    if numbers:
        found = new_table_path(spark, "ranked")
        for number in numbers:
            own = spark.sparkContext.broadcast(ItemBlock(blocks.filter(F.col("block") == number).collect(), k))
            placed = cut_lineage(
                _placed(vectors, own, stats).repartitionByRange("first", "second", "id", "text_key")
                .sortWithinPartitions("first", "second", "id", "text_key"),
                "placed",
            )
            floors = _searched(placed, own, None, True).groupBy("item").agg(F.max("floor").alias("floor")).toArrow()
            floor = np.zeros(len(own.value), np.int64)
            where = np.argsort(own.value.numbers)
            at = where[np.searchsorted(own.value.numbers, floors["item"].to_numpy(), sorter=where)]
            floor[at] = floors["floor"].to_numpy()
            sent = spark.sparkContext.broadcast(floor)  # a number per item of the block
            _searched(placed, own, sent, False).write.mode("append").parquet(found)
            sent.destroy()
            own.destroy()
    schema = "item long, id long, text_key long, score long"
    hits = spark.read.schema(schema).parquet(found) if found else spark.createDataFrame([], schema)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "text_key")
    top = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = asked.select("item", F.col("id").alias("item_id"), F.col("text_key").alias("item_key"))
    return top.join(named, "item").select(
        "item_id", "item_key", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "text_key", "score"
    )
