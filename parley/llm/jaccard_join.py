"""Exact Jaccard self-join on 5-word shingles as a blocked sparse matrix product.

The incidence matrix has a row per distinct shingle set and a column per shingle. The product
of the matrix with its transpose has the overlap counts; only entries that can reach the
bound are computed:

* Columns are ordered by how often they occur, rarest first (estimated by a small sketch; any
  common order is exact). Two sets of similarity 0.8 must share a column within the first
  ``n - ceil(4n/5) + 1`` entries of the larger and the first ``n - ceil(8n/9) + 1`` of the
  smaller one, so only those entries are multiplied.
* A column that only one row has there drops out, found per block of columns.
* Pairs whose sizes differ by more than a fifth drop out before their overlap is counted.

Overlaps are then counted on whole sets. What is wanted are the components of the link graph,
so the product is taken in two parts: first in passes over a band (every row with a neighbour
of another component in a column), whose links join groups of near copies; then for the rows of
the columns that still have several components. Columns of few rows give a bounded number of
pairs per row; large ones are multiplied in cells of bounded size, which add up the overlaps and
give links only. So no number of near copies makes a number of rows that grows with its square.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import (
    Windows, Words, any_names, chunks, merged_chunks, received, ship, stored, table, utf8,
)
from parley.llm.components import components

SHINGLE = 5
# Columns are counted in this many cells for their order; a task sends 4 MB.
CELL_BITS = 22
# Passes of the band, each over what the ones before have not joined.
BAND_PASSES = 2
CHUNK = 1 << 16
# Entries that a task holds at a time, and text bytes per block of columns.
BATCH_ENTRIES = 500_000
BLOCK_BYTES = 16 << 20
# Columns of at most so many rows are joined to pairs after the band passes, larger ones multiplied.
PAIR_ROWS = 48
# Bounds on the rows and shingles of a part of a column, of which two make a cell of the product,
# and the columns that are multiplied at a time.
CELL_ROWS = 1_000
CELL_ENTRIES = 300_000
CELL_COLUMNS = 2_048
# Keys of candidate texts up to this number are broadcast (32 MB) to fetch their texts; more are
# joined by a shuffle.
BROADCAST_KEYS = 2_000_000


def shingle_set(text: str | None, words: Words, windows: Windows) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, none has none.

    A-Z is lower-cased, words are blank-separated.
    """
    values = words.of(utf8(text).lower())
    return np.unique(windows.of(values, min(SHINGLE, max(1, len(values)))))


def set_key(shingles: np.ndarray) -> int:
    """64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def probe_length(n: np.ndarray) -> np.ndarray:
    return n - (4 * n + 4) // 5 + 1


# Both ranks allow the overlap that the pair needs, for rows x_ and y_ of a column.
REACHES = """x_rank <= x_size - (4 * (x_size + y_size) + 8) div 9
    AND y_rank <= y_size - (4 * (x_size + y_size) + 8) div 9"""

_ROWS = "number long, text_key long, n_shingles long, node long, chunk int, data binary"


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and key of each row's set, and at the end the task's column counts."""
    words, windows = Words(), Windows()
    cells = np.zeros(1 << CELL_BITS, np.int32)
    schema = pa.schema([*((n, pa.int64()) for n in ("number", "text_key", "n_shingles", "node")),
                        ("chunk", pa.int32()), ("data", pa.binary())])
    for batch in batches:
        sizes, nodes = [], []
        for text in batch.column(2).to_pylist():
            shingles = shingle_set(text, words, windows)
            sizes.append(len(shingles))
            nodes.append(set_key(shingles) if len(shingles) else None)
            np.add.at(cells, (shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
        n = len(sizes)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
             pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
    for number, part in chunks(np.minimum(cells, 255).astype(np.uint8), CHUNK):
        yield pa.RecordBatch.from_pylist([{"chunk": number, "data": part.tobytes()}], schema)


def _levels(parts: DataFrame) -> np.ndarray:
    """The cells' counts on a logarithmic scale: one byte each."""
    counts = np.zeros(1 << CELL_BITS, np.int64)
    for row in merged_chunks(parts, "uint8", "int32", 2**31 - 1).collect():
        counts[row.chunk * CHUNK :][:CHUNK] = np.frombuffer(row.data, np.int32)
    return np.minimum(4 * np.log2(counts + 1), 255).astype(np.uint8)


# A batch of rows: keys and sizes of its sets, numbers of entries, and the columns that two of
# its rows have. A share: the columns that a batch sends to one block, by the low half of
# their hash (two columns that fall together only give more candidates), and the entries'
# ranks as shares of their row's size, rounded down to 1/1024.
_BATCH = "batch long, block long, rows binary, shared binary, columns binary, entries binary, " \
    "ranks binary"
_ARROW = pa.schema([(x.split()[0], pa.int64() if x.split()[1] == "long" else pa.binary())
                    for x in _BATCH.split(", ")])


def _entries(shipped, blocks: int):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows, levels = Words(), Windows(), received(shipped)
        base = TaskContext.get().partitionId() << 24
        seen: set[int] = set()
        rows: list[tuple[int, int, int]] = []
        found: list[np.ndarray] = []
        held = number = 0

        def flush() -> pa.RecordBatch:
            each = np.concatenate(found)
            ranks = np.concatenate([np.arange(k) * 1024 // n for _, n, k in rows])
            column = ((each % np.uint64(blocks)) << np.uint64(32)) | (each >> np.uint64(32))
            known, first, inverse, counts = np.unique(
                column, return_index=True, return_inverse=True, return_counts=True)
            mine = np.flatnonzero(counts[inverse] > 1)
            out = [{
                "batch": base + number, "rows": np.array(rows, np.int64).tobytes(),
                "shared": mine.astype(np.int32).tobytes(), "columns": column[mine].tobytes(),
            }]
            # A column of several rows here goes out once, marked by the sign of its entry.
            entry = np.where(counts > 1, -1 - first, first).astype(np.int32)
            least = np.full(len(known), 255, np.int64)
            np.minimum.at(least, inverse, ranks)
            block = (known >> np.uint64(32)).astype(np.int64)
            low = known.astype(np.uint32)
            numbers, starts = np.unique(block, return_index=True)
            cut = [np.split(x, starts[1:]) for x in (low, entry, least.astype(np.uint8))]
            for own, lows, places, least_ranks in zip(numbers.tolist(), *cut):
                out.append({"batch": base + number, "block": own, "columns": lows.tobytes(),
                            "entries": places.tobytes(), "ranks": least_ranks.tobytes()})
            return pa.RecordBatch.from_pylist(out, _ARROW)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                shingles = shingle_set(text, words, windows)
                n = len(shingles)
                if not n or (node := set_key(shingles)) in seen:
                    continue  # copies within a task are one row
                seen.add(node)
                level = levels[(shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                order = np.lexsort((shingles, level))[: int(probe_length(n))]
                rows.append((node, n, len(order)))
                found.append(shingles[order])
                held += len(order)
                if held >= BATCH_ENTRIES:
                    yield flush()
                    rows, found, held, number = [], [], 0, number + 1
        if held:
            yield flush()

    return find


def _block(rows: pa.Table) -> pa.Table:
    """The entries of one block of columns that another row shares, by batch.

    Shares r and q of two rows that reach the bound have (5 - 9r)(5 - 9q) >= 16, whatever the
    sizes. An entry is compared with the least share of the column's others.
    """
    batches, block = rows["batch"].to_pylist(), rows["block"][0].as_py()
    columns = [np.frombuffer(x, np.uint32) for x in rows["columns"].to_pylist()]
    entries = [np.frombuffer(x, np.int32) for x in rows["entries"].to_pylist()]
    column = np.concatenate(columns)
    rank = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["ranks"].to_pylist()])
    order = np.lexsort((rank, column))
    column, share = column[order], 5 - 9 * (rank[order] / 1024)
    first = np.ones(len(column), bool)
    first[1:] = column[1:] != column[:-1]
    other = share[np.maximum.accumulate(np.where(first, np.arange(len(column)), 0))]
    # The first of a column has the second as its partner, if there is one.
    alone = first & np.append(first[1:], True)
    other[first] = np.append(share[1:], 0)[first]
    useful = np.empty(len(column), bool)
    useful[order] = (share * other >= 16) & ~alone
    useful &= np.concatenate(entries) >= 0
    out = []
    for batch, own, places, flag in zip(
        batches, columns, entries, np.split(useful, np.cumsum([len(c) for c in columns])[:-1])
    ):
        if flag.any():
            full = (np.uint64(block) << np.uint64(32)) | own[flag].astype(np.uint64)
            out.append({"batch": batch, "shared": places[flag].tobytes(),
                        "columns": full.tobytes()})
    return pa.Table.from_pylist(out, pa.schema(
        [("batch", pa.int64()), ("shared", pa.binary()), ("columns", pa.binary())]))


def _shared(rows: pa.Table) -> pa.Table:
    """``(column, node, size, rank)`` of a batch's shared entries."""
    head = next(x for x in rows["rows"].to_pylist() if x is not None)
    node, size, length = np.frombuffer(head, np.int64).reshape(-1, 3).T
    place = np.concatenate([np.frombuffer(x, np.int32) for x in rows["shared"].to_pylist()])
    column = np.concatenate([np.frombuffer(x, np.int64) for x in rows["columns"].to_pylist()])
    ends = np.cumsum(length)
    row = np.searchsorted(ends, place, side="right")
    rank = place - (ends - length)[row]
    return pa.table({
        "column": column, "node": node[row], "size": size[row],
        "rank": rank,
    })


def shared_entries(df: DataFrame, text: str, levels: np.ndarray, size: int) -> DataFrame:
    """Prefix entries in columns that at least two rows of the whole table share there."""
    shipped = ship(df.sparkSession, levels)
    blocks = max(1, -(-size // BLOCK_BYTES))
    found = stored(df.select(text).mapInArrow(_entries(shipped, blocks), _BATCH), "entries")
    none = F.lit(None).cast("binary").alias("rows")
    far = (
        found.filter("block IS NOT NULL").select("batch", "block", "columns", "entries", "ranks")
        .groupBy("block").applyInArrow(_block, "batch long, shared binary, columns binary")
        .select("batch", none, "shared", "columns")
    )
    near = found.filter("block IS NULL").select("batch", "rows", "shared", "columns")
    return near.unionByName(far).groupBy("batch").applyInArrow(
        _shared, "column long, node long, size long, rank long")


def _side(rows: DataFrame, side: str, *names: str) -> DataFrame:
    return rows.select("column", *(F.col(n).alias(f"{side}_{n}") for n in names))


def labelled(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Entries with their row's component: its own key before any link is known."""
    if labels is None:
        return entries.withColumn("component", F.col("node"))
    rows = entries.join(labels, "node", "left")
    return rows.withColumn("component", F.coalesce("component", "node"))


_BAND = "kind int, a long, b long, rank long, size long, component long"


def _band(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows ``(column, rank, size, node, component)`` in the order of their columns.

    Kind 0: a row and the nearest before it of another component. Kind 1: a row and its column's
    first. The task's first column may have begun in another task, so its rows get no kind 1;
    instead the first rows of the task's first (2) and last column (3) are told.
    """
    schema = pa.schema([("kind", pa.int32()), *(
        (x, pa.int64()) for x in ("a", "b", "rank", "size", "component"))])

    def pairs(kind: int, of: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
        need = (4 * (of[2] + other[2]) + 8) // 9
        fit = (of[0] == other[0]) & (of[4] != other[4]) & (
            of[1] <= of[2] - need) & (other[1] <= other[2] - need)
        n = int(fit.sum())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(of[3, fit]), pa.array(other[3, fit]),
             *[pa.nulls(n, pa.int64())] * 3], schema=schema)

    def told(kind: int, row: np.ndarray) -> pa.RecordBatch:
        column, rank, size, node, component = row.tolist()
        return pa.RecordBatch.from_pylist([dict(
            kind=kind, a=column, b=node, rank=rank, size=size, component=component)], schema)

    # Of the current column: its first row, its last so far, and the last before the current
    # run of rows of one component. And the task's first row.
    top = last = prior = begin = None
    for batch in batches:
        part = np.stack([batch.column(i).to_numpy() for i in range(5)])
        n = part.shape[1]
        if not n:
            continue
        places = np.arange(n)
        first = np.ones(n, bool)
        first[1:] = part[0, 1:] != part[0, :-1]
        run = first.copy()
        run[1:] |= part[4, 1:] != part[4, :-1]
        start = np.maximum.accumulate(np.where(run, places, 0))
        near = part[:, np.maximum(start - 1, 0)]
        near[0, start == 0] = -1
        head = np.maximum.accumulate(np.where(first, places, 0))
        tops = part[:, head]
        if last is not None and last[0] == part[0, 0]:
            near[:, start == 0] = (prior if last[4] == part[4, 0] else last)[:, None]
            tops[:, head == 0] = top[:, None]
        if begin is None:
            begin = part[:, 0]
            yield told(2, begin)
        top, last, prior = tops[:, -1], part[:, -1], near[:, -1]
        yield pairs(0, part, near)
        whole = part[0] != begin[0]
        yield pairs(1, part[:, whole], tops[:, whole])
    if begin is not None and top[0] != begin[0]:
        yield told(3, top)


def band_pairs(rows: DataFrame, tried: DataFrame | None) -> DataFrame:
    """For every row the two untried rows of other components most often beside it in a column.

    One is the column's first row: it has the fewest entries before the column, as an unchanged
    original has. The other is the nearest before the row by rank. Columns are dealt by range,
    so one of very many rows lies in several tasks; the first rows of such columns, one per
    task at most, are broadcast.
    """
    order = ("column", "rank", "size", "node")
    band = stored(
        rows.select(*order, "component").repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(_band, _BAND).groupBy("kind", "a", "b").agg(
            F.count(F.lit(1)).alias("n"),
            *(F.first(x).alias(x) for x in ("rank", "size", "component"))), "band")
    tops = band.filter("kind >= 2").groupBy(F.col("a").alias("column")).agg(
        F.min("kind").alias("kind"), F.min("rank").alias("y_rank"),
        F.min_by(F.struct("size", "b", "component"), F.struct("rank", "size", "b")).alias("top"),
    ).filter("kind = 2").selectExpr("column", "y_rank", "top.size AS y_size", "top.b AS y_node",
                                    "top.component AS y_component")
    split = _side(rows, "x", "node", "size", "rank", "component").join(
        F.broadcast(tops), "column").filter(f"x_component <> y_component AND {REACHES}").selectExpr(
        "1 AS kind", "x_node AS a", "y_node AS b", "1L AS n")
    counted = band.filter("kind < 2").select("kind", "a", "b", "n").union(split).groupBy(
        "kind", "a", "b").agg(F.sum("n").alias("n"))
    if tried is not None:
        both = tried.union(tried.select("b", "a"))
        counted = counted.join(both, ["a", "b"], "left_anti")
    best = counted.groupBy("kind", "a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _product(rows: pa.Table) -> pa.Table:
    """Links between rows of different components in a cell, as stars with the same components.

    The product of the cell's incidence matrix with its transpose adds up the overlaps, a block
    of columns at a time.
    """
    node, component = (rows[n].to_numpy() for n in ("node", "component"))
    sets = [np.frombuffer(x, np.uint64) for x in rows["data"].to_pylist()]
    size = np.array([len(x) for x in sets], np.int64)
    known, column = np.unique(np.concatenate(sets), return_inverse=True)
    common = np.bincount(column) > 1
    place = (np.cumsum(common) - 1)[column]
    row, keep = np.repeat(np.arange(len(sets)), size), common[column]
    row, place = row[keep], place[keep]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    edges = np.searchsorted(place, np.arange(0, int(common.sum()) + CELL_COLUMNS, CELL_COLUMNS))
    for k, (begin, end) in enumerate(zip(edges, edges[1:])):
        part = np.zeros((len(sets), CELL_COLUMNS), np.float32)
        part[row[begin:end], place[begin:end] - k * CELL_COLUMNS] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    near = (100 * both >= 80 * (size[:, None] + size - both)) & (component[:, None] != component)
    star = np.full(len(sets), -1)
    for i in np.flatnonzero(near.any(axis=1)):
        if star[i] >= 0:
            continue
        star[i], open_ = i, [i]
        while open_:
            new = np.flatnonzero(near[open_.pop()] & (star < 0))
            star[new] = i
            open_ += new.tolist()
    tips = np.flatnonzero((star >= 0) & (star != np.arange(len(sets))))
    return pa.table({"a": pa.array(node[star[tips]], pa.int64()), "b": pa.array(node[tips], pa.int64())})


def mixed_rows(rows: DataFrame) -> DataFrame:
    """The rows of columns that have several components, with their column's ``n`` and ``parts``."""
    sizes = rows.groupBy("column", "component").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("entries"))
    parts = F.ceil(F.greatest(F.sum("n") / CELL_ROWS, F.sum("entries") / CELL_ENTRIES))
    columns = sizes.groupBy("column").agg(
        F.count(F.lit(1)).alias("kinds"), parts.alias("parts"), F.sum("n").alias("n"))
    return stored(rows.join(columns.filter("kinds > 1").drop("kinds"), "column"), "mixed")


def few_pairs(mixed: DataFrame, tried: DataFrame) -> DataFrame:
    """All untried pairs in columns of at most PAIR_ROWS rows that can reach the bound, of
    different components: as many for each row at most."""
    few = mixed.filter(F.col("n") <= PAIR_ROWS)
    names = ("node", "size", "rank", "component")
    pairs = _side(few, "x", *names).join(_side(few, "y", *names), "column").filter(
        f"x_component <> y_component AND x_node < y_node AND {REACHES}")
    pairs = pairs.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()
    return pairs.join(tried, ["a", "b"], "left_anti")


def product_links(df: DataFrame, text: str, keys: DataFrame, mixed: DataFrame) -> DataFrame:
    """``(a, b)``: links between rows of different components in columns of over PAIR_ROWS rows.

    The rows meet in cells of bounded size: a column of more rows is cut into parts, and every
    two parts make a cell. Tasks add up the overlaps there; only links leave a cell, at most one
    per row, so a group of texts that are near each other but not linked costs a product and no
    rows. Columns of the same rows are one.
    """
    mixed = mixed.filter(F.col("n") > PAIR_ROWS).select("column", "node", "component", "parts")
    alike = mixed.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.sum(F.pmod(F.xxhash64(F.lit("second"), "node"), F.lit(1 << 40))).alias("y"))
    one = alike.groupBy("n", "x", "y").agg(F.min("column").alias("column")).select("column")
    mixed = stored(mixed.join(one, "column", "left_semi"), "mixed")

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows = Words(), Windows()
        for batch in batches:
            data = [shingle_set(x, words, windows).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(data, pa.binary())], ["node", "data"])

    found = texts_of(df, text, keys, mixed.select("node")).mapInArrow(sets, "node long, data binary")
    own = F.pmod(F.xxhash64("node", "column"), F.col("parts"))
    dealt = mixed.join(found, "node").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    placed = dealt.select(
        "column", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        "node", "component", "data")
    return stored(placed.groupBy("column", "lo", "hi").applyInArrow(_product, "a long, b long"), "links")


def texts_of(df: DataFrame, text: str, keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, text)``: a text of each of the sets, stored.

    Their keys are picked out where the texts are read if they are few, by a shuffle if not.
    """
    wanted = stored(keys.join(nodes, "node", "left_semi"), "wanted")
    if wanted.count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    keyed = df.select(F.xxhash64(text).alias("__key"), F.col(text).alias("text"))
    return stored(keyed.join(wanted, "__key").groupBy("node").agg(F.first("text").alias("text")),
                  "texts")


def linked(df: DataFrame, text: str, keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets reach the bound, by counting their overlap.

    ``keys`` has the hash of one text of each set. Only texts of sets in a pair are moved.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows = Words(), Windows()
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            firsts, seconds = batch.column("text_a"), batch.column("text_b")
            for i, a in enumerate(batch.column("a").to_pylist()):
                if last[0] != a:
                    last = a, shingle_set(firsts[i].as_py(), words, windows)
                x, y = last[1], shingle_set(seconds[i].as_py(), words, windows)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    texts = texts_of(df, text, keys, pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    full = pairs.join(other, "b").join(one, "a").select("a", "b", "text_a", "text_b")
    return stored(full.mapInArrow(count, "a long, b long"), "links")


def _classes(df: DataFrame, id_column: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``(id, text_key, n_shingles, node)`` and the ``(node, component)`` of linked nodes."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    numbered = df.select(F.col(id_column).cast("long"), F.xxhash64(text), text)
    found = stored(numbered.mapInArrow(_sets, _ROWS), "sets")
    levels = _levels(found.filter("chunk IS NOT NULL").select("chunk", "data"))
    rows = found.filter("chunk IS NULL").select(
        F.col("number").alias("id"), "text_key", "n_shingles", "node")
    # Tasks with copies of one set each sent its entries: they are one row from here on.
    entries = stored(shared_entries(df, text, levels, size).distinct(), "shared")
    keys = stored(rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("text_key").alias("__key")), "keys")
    labels = tried = None
    links: list[DataFrame] = []
    for _ in range(BAND_PASSES):
        pairs = stored(band_pairs(labelled(entries, labels), tried), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links.append(linked(df, text, keys, pairs))
        labels = components(reduce(DataFrame.unionByName, links))
    marked = stored(labelled(entries, labels), "labelled")
    mixed = mixed_rows(marked)
    links.append(linked(df, text, keys, stored(few_pairs(mixed, tried), "pairs")))
    links.append(product_links(df, text, keys, mixed))
    return rows, components(reduce(DataFrame.unionByName, links))


def _named(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return stored(nodes.join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node")), "named")


@any_names("n_shingles", "component_id", columns=("id_column", "text"))
def jaccard_components(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row.

    Rows link whose sets have 100 * intersection >= 80 * union; ``component_id`` is the
    smallest id reachable. Null and empty texts have an empty set and are components of their
    own. Repeated rows are copies of one another. Rows with a null id link as others do; a
    component of such rows only has a null id. Ids are numbers; sets are told apart by 64-bit
    hashes. Very long texts are read whole. An empty table gives no rows. Other columns may have
    any names and are not carried.
    """
    rows, labels = _classes(df, id_column, text)
    # The smallest id of each set, then of each component; hot sets are aggregated first.
    ids = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"))
    named = _named(ids, labels)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = stored(named.join(least, "component").select("node", "component_id"), "classes")
    own = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return rows.join(by_node, "node", "left").select(
        F.col("id").alias(id_column), "n_shingles", own.alias("component_id"))


@any_names(columns=("id_column", "text"))
def keep_one_of_each(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """One row of every component: the one of the smallest id (nulls first), whole.

    Rows without words are all kept. Of equal rows one stays. Other columns stay and may have any
    names. Very long texts are read whole; an empty table stays empty.
    """
    rows, labels = _classes(df, id_column, text)
    own = F.struct("id", "text_key")
    firsts = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min(own).alias("first"))
    named = _named(firsts, labels)
    chosen = stored(
        named.groupBy("component").agg(F.min("first").alias("first"))
        .select(F.col("first.id").alias("__id"), F.col("first.text_key").alias("__key")), "chosen")
    keyed = df.withColumn("__key", F.xxhash64(text))
    kept = keyed.alias("d").join(
        chosen.alias("c"),
        (F.col("d.__key") == F.col("c.__key")) & F.col(f"d.{id_column}").eqNullSafe(F.col("c.__id")),
        "left_semi",
    ).dropDuplicates(["__key", id_column])
    bare = F.coalesce(~F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    return kept.filter(~bare).unionByName(keyed.filter(bare)).drop("__key")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the components of their near copies."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, "doc_id", "text")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sql(documents: str = "documents") -> str:
    """``(doc_id, n_shingles, component_id)`` in DuckDB."""
    return f"""
    WITH RECURSIVE jw AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w
        FROM {documents}
    ), js AS MATERIALIZED (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM (
            SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i
            FROM jw WHERE len(w) > 0)
    ), jn AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM js GROUP BY doc_id),
    jl AS MATERIALIZED (
        SELECT x.doc_id AS a, y.doc_id AS b FROM js x JOIN js y USING (s)
        JOIN jn p ON p.doc_id = x.doc_id JOIN jn q ON q.doc_id = y.doc_id
        WHERE x.doc_id <> y.doc_id
        GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(p.n) + any_value(q.n) - count(*))
    ), reach AS (
        SELECT doc_id AS a, doc_id AS b FROM jw
        UNION SELECT reach.a, jl.b FROM reach JOIN jl ON reach.b = jl.a
    )
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
    FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    LEFT JOIN jn USING (doc_id)"""


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
ORACLE = {"op10_jaccard_join": sql()}
