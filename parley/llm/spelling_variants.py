"""Words that differ by one edit, and the common form that a rare one stands for.

A word is a point whose coordinates count its letters. One replaced letter moves a point one
step up in one coordinate and one step down in another, an inserted letter one step up: in L1
distance two at most. So the words of each length are indexed by a k-d tree over their counts,
and a word's near words come from range searches in the tree of its own length and in that of
the next one. Boxes that lie too far above or below the word are pruned; what is left is
compared letter by letter.

The upper part of all trees is one small table, cut at the medians of a bounded sample. Its
leaves are the unit of distribution: every word is sent to its own leaf and to the leaves whose
boxes its searches reach, where a task builds the lower part of the tree.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import received, ship, stored, table

LEAST_LETTERS = 7
LEAST_COUNT = 2
# A form has so many times the occurrences of its variant.
FORM_RATIO = 10
# One in so many (document, run) hashes loses a letter.
DELETE_EVERY = 31
# Distinct words that a task holds before it passes them on.
HELD_WORDS = 300_000
# Bytes of a long text that are split into runs at a time.
PART_BYTES = 1 << 20
# Words that a leaf of the upper tree should hold, and the bound on the sample that places the
# cuts. The sample decides sizes only: every word is indexed and searched.
LEAF_WORDS = 4_000
SAMPLE_WORDS = 200_000
SAMPLE_LETTERS = 256
# Least number of sampled words behind a cut.
LEAST_SAMPLE = 16
# Words per leaf of the lower tree, searching words at a time, letters compared at a time.
BUCKET = 48
BLOCK = 8_192
COMPARED = 1 << 22

_LETTERS = 26 + 64
_RUN = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_LETTERS)
_GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
_VISIT = "length int, leaf int, role int, word binary, n long"
_NEAR = "word binary, n_near long, form_n long, form binary"


# Words and their counts

def _parts(data: bytes) -> Iterator[bytes]:
    """A long text in pieces that end at an ASCII character that is no letter."""
    begin = 0
    while begin < len(data):
        end = begin + PART_BYTES
        if end < len(data):
            gap = _GAP.search(data, end)
            end = gap.start() if gap else len(data)
        yield data[begin:end]
        begin = end


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({
            "word": pa.array([w.encode("latin-1") for w in counts], pa.binary()),
            "n": pa.array(list(counts.values()), pa.int64()),
        })
        counts.clear()
        return out

    for batch in batches:
        for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            runs: Counter = Counter()
            for part in [data] if len(data) <= PART_BYTES else _parts(data):
                # lower() of bytes is A-Z only.
                runs.update(_RUN.findall(part.lower().decode("utf-8", "replace")))
            begun = zlib.crc32(doc_id + b":")
            for run, times in runs.items():
                h = zlib.crc32(run.encode(), begun)
                if h % DELETE_EVERY == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < LEAST_LETTERS:
                        continue
                counts[run] += times
            if len(counts) >= HELD_WORDS:
                yield flush()
    if counts:
        yield flush()


def word_counts(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """``(word binary, n long)``: words with at least LEAST_COUNT occurrences, in Latin-1."""
    texts = df.select(*(
        F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(name)
        for name, c in (("id", id_column), ("text", text))
    ))
    return (
        texts.mapInArrow(_count_words, "word binary, n long")
        .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)
    )


# Trees

def letters(words: list[bytes]) -> np.ndarray:
    """Words of one length as rows of Latin-1 codes."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """A row of letter counts for each word; counts beyond 255 stay 255, which moves no two
    words further apart."""
    out = np.zeros((len(codes), _LETTERS), np.uint8)
    place = np.where(codes < 0xC0, codes - np.uint8(97), codes - np.uint8(0xC0 - 26))
    step = max(1, COMPARED // max(_LETTERS, codes.shape[1]))
    for begin in range(0, len(codes), step):
        part = place[begin : begin + step].astype(np.int64)
        part += np.arange(len(part))[:, None] * _LETTERS
        sums = np.bincount(part.ravel(), minlength=len(part) * _LETTERS)
        out[begin : begin + step] = np.minimum(sums, 255).reshape(len(part), _LETTERS)
    return out


class Tree:
    """A k-d tree over letter counts: ``letter <= cut`` goes left, cuts are near the median."""

    def __init__(self, points: np.ndarray, leaf_size: int) -> None:
        self.nodes: list[tuple[int, int, int, int]] = []  # letter, cut, left, right
        self.members: list[np.ndarray] = []
        self._grow(points, np.arange(len(points)), leaf_size)

    def _grow(self, points: np.ndarray, own: np.ndarray, leaf_size: int) -> int:
        """Number of the new node; leaves have numbers below zero."""
        letter, cut = (-1, 0) if len(own) <= leaf_size else _best_cut(points[own])
        if letter < 0:
            self.members.append(own)
            return -len(self.members)
        at = len(self.nodes)
        self.nodes.append((letter, cut, 0, 0))
        low = points[own, letter] <= cut
        left = self._grow(points, own[low], leaf_size)
        right = self._grow(points, own[~low], leaf_size)
        self.nodes[at] = (letter, cut, left, right)
        return at

    def __len__(self) -> int:
        return len(self.members)

    def _walk(self, points: np.ndarray, most_up: int, most_down: int) -> Iterator:
        """``(leaf, indices of points)`` for the leaves whose boxes the points reach with so many
        letters added and removed; a point that is in a leaf's box needs none."""
        none = np.zeros(len(points), np.int16)
        stack = [(0 if self.nodes else -1, np.arange(len(points)), none, none, ())]
        while stack:
            node, own, up, down, box = stack.pop()
            if not len(own):
                continue
            if node < 0:
                yield -node - 1, own
                continue
            letter, cut, left, right = self.nodes[node]
            bottom, top = 0, 255
            for where, least, most in box:
                if where == letter:
                    bottom, top = max(bottom, least), min(top, most)
            value = points[own, letter].astype(np.int16)
            more = down + np.maximum(value - cut, 0) - np.maximum(value - top, 0)
            keep = more <= most_down
            stack.append((left, own[keep], up[keep], more[keep], (*box, (letter, 0, cut))))
            more = up + np.maximum(cut + 1 - value, 0) - np.maximum(bottom - value, 0)
            keep = more <= most_up
            stack.append((right, own[keep], more[keep], down[keep], (*box, (letter, cut + 1, 255))))

    def leaves_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point lies in."""
        out = np.zeros(len(points), np.int32)
        for leaf, own in self._walk(points, 0, 0):
            out[own] = leaf
        return out

    def reached(self, points: np.ndarray, shorter: bool) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves that can hold words one edit away from words of equal or shorter length."""
        return self._walk(points, 1, 0 if shorter else 1)


def _best_cut(points: np.ndarray) -> tuple[int, int]:
    """The letter and count that halve the points best; -1 if all are equal."""
    best, place = 0, (-1, 0)
    for count in range(int(points.max())):
        below = (points <= count).sum(axis=0)
        smaller = np.minimum(below, len(points) - below)
        letter = int(np.argmax(smaller))
        if smaller[letter] > best:
            best, place = int(smaller[letter]), (letter, count)
    return place


def upper_trees(words: DataFrame, leaf_words: int = LEAF_WORDS,
                sample_words: int = SAMPLE_WORDS) -> dict[int, Tree]:
    """A tree by word length, from at most about ``sample_words`` words; lengths that are not in
    the sample have one leaf and no tree."""
    share = min(1.0, sample_words / max(1, words.count()))
    place = F.pmod(F.xxhash64("word"), F.lit(1 << 30))
    sample = (
        words.filter((place < int(share * (1 << 30))) & (F.octet_length("word") <= SAMPLE_LETTERS))
        .select("word").toArrow()
    )
    by_length: dict[int, list[bytes]] = {}
    for word in sorted(sample["word"].to_pylist()):
        by_length.setdefault(len(word), []).append(word)
    size = max(LEAST_SAMPLE, int(leaf_words * share))
    trees = {n: Tree(letter_counts(letters(own)), size) for n, own in sorted(by_length.items())}
    for tree in trees.values():
        tree.members = [np.empty(0, np.int64)] * len(tree)
    return trees


# Searches

def _visits(words: list[bytes], n: np.ndarray, trees: dict[int, Tree]) -> Iterator[pa.RecordBatch]:
    """The rows of words of one length: role 0 in the word's own leaf, 1 where it looks for words
    of its length (in later leaves: earlier ones look for it), 2 where for longer ones."""
    length = len(words[0])
    points = letter_counts(letters(words))
    column = pa.array(words, pa.binary())

    def rows(size: int, leaf: np.ndarray, role: int, own: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "length": pa.array(np.full(len(own), size), pa.int32()),
            "leaf": pa.array(leaf, pa.int32()),
            "role": pa.array(np.full(len(own), role), pa.int32()),
            "word": column.take(pa.array(own)), "n": pa.array(n[own], pa.int64()),
        })

    home = np.zeros(len(words), np.int32)
    if length in trees:
        home = trees[length].leaves_of(points)
        for leaf, own in trees[length].reached(points, shorter=False):
            own = own[home[own] < leaf]
            yield rows(length, np.full(len(own), leaf), 1, own)
    yield rows(length, home, 0, np.arange(len(words)))
    if length + 1 in trees:
        for leaf, own in trees[length + 1].reached(points, shorter=True):
            yield rows(length + 1, np.full(len(own), leaf), 2, own)
    else:
        yield rows(length + 1, np.zeros(len(words), np.int32), 2, np.arange(len(words)))


def visits(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """All words with the leaves that they lie in and those that they search."""
    shared = ship(words.sparkSession, trees)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = received(shared)
        for batch in batches:
            by_length: dict[int, list[int]] = {}
            column = batch.column("word").to_pylist()
            n = batch.column("n").to_numpy(zero_copy_only=False)
            for i, word in enumerate(column):
                by_length.setdefault(len(word), []).append(i)
            for own in by_length.values():
                for out in _visits([column[i] for i in own], n[own], known):
                    if out.num_rows:
                        yield out

    return words.select("word", "n").mapInArrow(run, _VISIT)


def _signature(points: np.ndarray) -> np.ndarray:
    """Two bits per letter: there at all, there twice. They differ in no more places than the
    counts do."""
    bits = np.zeros((len(points), 192), bool)
    bits[:, : 2 * _LETTERS : 2], bits[:, 1 : 2 * _LETTERS : 2] = points >= 1, points >= 2
    return np.packbits(bits, axis=1).view(np.uint64)


def one_edit(longer: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which rows are one replaced letter apart, or one inserted if ``other`` is shorter."""
    size = other.shape[1]
    if longer.shape[1] == size:
        return (longer != other).sum(axis=1) == 1
    # Equal up to some letter, and equal after it when the longer word skips that letter.
    before = np.cumsum(longer[:, :size] != other, axis=1) == 0
    after = np.cumsum((longer[:, 1:] != other)[:, ::-1], axis=1)[:, ::-1] == 0
    edge = np.ones((len(other), 1), bool)
    return (np.hstack([edge, before]) & np.hstack([after, edge])).any(axis=1)


class Leaf:
    """The words of one leaf of an upper tree, with the lower part of the tree."""

    def __init__(self, words: list[bytes], n: list[int]) -> None:
        self.words, self.n = words, np.array(n, np.int64)
        self.codes = letters(words)
        points = letter_counts(self.codes)
        self.tree = Tree(points, BUCKET)
        self.marks = _signature(points)

    def search(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(i, j)``: searching word i is near this leaf's word j."""
        codes = letters(words)
        points = letter_counts(codes)
        marks, shorter = _signature(points), codes.shape[1] < self.codes.shape[1]
        found = []
        step = max(1, COMPARED // self.codes.shape[1])
        for leaf, who in self.tree.reached(points, shorter):
            # Words of equal counts cannot be cut: their leaf may be large.
            every = self.tree.members[leaf]
            for members in (every[k : k + BUCKET] for k in range(0, len(every), BUCKET)):
                apart = np.bitwise_count(marks[who, None] ^ self.marks[None, members]).sum(axis=2)
                i, j = np.nonzero(apart <= (1 if shorter else 2))
                i, j = who[i], members[j]
                for begin in range(0, len(i), step):
                    a, b = i[begin : begin + step], j[begin : begin + step]
                    near = one_edit(self.codes[b], codes[a])
                    found.append((a[near], b[near]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))


def _summary(words: list[bytes], which: np.ndarray, near: list[bytes], near_n: np.ndarray,
             other: np.ndarray) -> pa.RecordBatch:
    """Count and best of the near words, by word; lists are in word order."""
    order = np.lexsort((other, -near_n[other], which))
    which, other = which[order], other[order]
    own, first, counts = np.unique(which, return_index=True, return_counts=True)
    best = other[first]
    return pa.RecordBatch.from_pydict({
        "word": pa.array([words[i] for i in own], pa.binary()),
        "n_near": pa.array(counts, pa.int64()), "form_n": pa.array(near_n[best], pa.int64()),
        "form": pa.array([near[i] for i in best], pa.binary()),
    })


def _search_leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by leaf, role and word: a leaf's words come first, then those that search it."""
    at, leaf = None, None
    words: list[bytes] = []
    n: list[int] = []

    def finish() -> Iterator[pa.RecordBatch]:
        nonlocal leaf
        if not words:
            return
        own = at[2] == 0
        if own:
            leaf = Leaf(list(words), list(n))
        if leaf is not None:
            for begin in range(0, len(words) if own else 1, BLOCK):
                part = slice(begin, begin + BLOCK) if own else slice(None)
                block, block_n = words[part], np.array(n[part], np.int64)
                i, j = leaf.search(block)
                if own:  # each pair once
                    i, j = i[i + begin < j], j[i + begin < j]
                if len(i):
                    yield _summary(block, i, leaf.words, leaf.n, j)
                    if own:
                        i = i + begin
                        yield _summary(leaf.words, j, leaf.words, leaf.n, i)
                    else:
                        yield _summary(leaf.words, j, block, block_n, i)
        words.clear()
        n.clear()

    for batch in batches:
        for *key, word, count in zip(*(c.to_pylist() for c in batch.columns)):
            if key != at:
                yield from finish()
                if at is None or key[:2] != at[:2]:
                    leaf = None
                at = key
            elif key[2] and len(words) >= BLOCK:
                yield from finish()
            words.append(word)
            n.append(count)
    yield from finish()


def near_words(words: DataFrame, leaf_words: int = LEAF_WORDS,
               sample_words: int = SAMPLE_WORDS) -> DataFrame:
    """``(word, n_near, form_n, form)``: number and best of the near words, for words with any.

    ``words`` has distinct ``(word binary, n long)`` rows and should be a stored table.
    """
    rows = visits(words, upper_trees(words, leaf_words, sample_words))
    found = (
        rows.repartition("length", "leaf").sortWithinPartitions("length", "leaf", "role", "word")
        .mapInArrow(_search_leaves, _NEAR)
    )
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def follow(forms: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)``: forms are followed to the last.

    Each round doubles the steps taken; as counts grow tenfold with each step, few are needed.
    """
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        moved = stored(roots.join(ahead, "root", "left").select(
            "word", F.coalesce("__next", "root").alias("root"),
            F.col("__next").isNotNull().alias("moved")), "roots")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        roots = moved.select("word", "root")


def spelling_variants(df: DataFrame, id_column: str, text: str, ratio: int = FORM_RATIO,
                      leaf_words: int = LEAF_WORDS, sample_words: int = SAMPLE_WORDS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``, one row per word.

    Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased, after the
    seeded loss of a letter, of at least LEAST_LETTERS letters and LEAST_COUNT occurrences. The
    form is the near word of the most occurrences, the first in code-point order among equals,
    if it has ``ratio`` times the word's. Null and empty texts have no words; a null id counts
    as the empty string. Very long texts are read in parts, between words, and very long words
    are compared whole. Repeated rows count as often as they occur. An empty table gives no
    rows. Only the two named columns are read: others may have any names.
    """
    words = stored(word_counts(df, id_column, text), "words")
    near = near_words(words, leaf_words, sample_words)
    rows = words.join(near, "word", "left")
    common = F.col("form_n") >= ratio * F.col("n")
    rows = stored(rows.select(
        "word", F.when(common, F.col("form")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(common, F.col("form_n")).alias("form_n")), "variants")
    roots = follow(rows.filter("form IS NOT NULL"))
    out = rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select(
        *(F.decode(c, "ISO-8859-1").alias(c) for c in ("word", "form", "root")),
        "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents."""
    return spelling_variants(table(spark, sf_dir, "documents"), "doc_id", "text")


# DuckDB has no CRC-32: it is folded over the bytes in hexadecimal form, eight bit steps each.
_BIT = "xor(v >> 1, 3988292384 * (v & 1))"
_CRC = f"""xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(
        regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'),
        lambda h: ('0x' || h)::BIGINT)),
    lambda c, o: list_reduce([xor(c, o), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: {_BIT})))"""

SQL = f"""
WITH RECURSIVE runs AS MATERIALIZED (
    SELECT doc_id, run, times, {_CRC} AS h FROM (
        SELECT doc_id, run, count(*) AS times FROM (
            SELECT doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run
            FROM documents)
        WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL)
), words AS MATERIALIZED (
    SELECT word, sum(times)::BIGINT AS n FROM (
        SELECT times, CASE WHEN h % {DELETE_EVERY} = 0
            THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
        FROM runs)
    WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}
), gaps AS MATERIALIZED (
    SELECT word, n, i, left(word, i - 1) AS head, substr(word, i + 1) AS tail
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS MATERIALIZED (
    SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b
        ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
    UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.head || g.tail = w.word
    UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.head || g.tail = w.word
), best AS MATERIALIZED (
    SELECT word, count(*) AS n_near, max(other_n) AS most,
        min(other) FILTER (other_n = top) AS other
    FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS top FROM near) GROUP BY word
), rows AS MATERIALIZED (
    SELECT w.word, CASE WHEN most >= {FORM_RATIO} * n THEN other END AS form, n,
        coalesce(n_near, 0) AS n_near, CASE WHEN most >= {FORM_RATIO} * n THEN most END AS form_n
    FROM words w LEFT JOIN best USING (word)
), chain AS (
    SELECT word, word AS root FROM rows
    UNION ALL
    SELECT c.word, r.form FROM chain c JOIN rows r ON c.root = r.word WHERE r.form IS NOT NULL
)
SELECT r.word, r.form, c.root, r.n, r.n_near, r.form_n
FROM rows r JOIN chain c ON r.word = c.word JOIN rows e ON e.word = c.root AND e.form IS NULL"""

QUERIES = {"op12_spelling_variants": op12_spelling_variants}
ORACLE = {"op12_spelling_variants": SQL}
