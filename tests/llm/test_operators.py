"""Training-data operators: SQL, brute force, round trips and edge cases."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import compare, database
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import (
    classifier, components, decontamination, jaccard_join, line_dedup, lm_scoring, packing,
    quality_rules, queries, sharding, substring_dedup, warc,
)
from parley.llm.common import Words, Windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [
    (None, None, None, None, None), (1, "", "en", "s", 0), (2, None, None, "s", 0),
    (3, "one two", "en", "s", 7), (3, "one two", "en", "s", 7),
    (4, "a b c d e f " * 9000, "en", None, 1), (5, "ß é 日本 " * 40, "de", "s", 1),
]


@pytest.fixture
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).withColumn("extra", F.lit("x"))


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, sf, name):
    assert compare(database(sf), queries.QUERIES[name](spark, sf), queries.ORACLE[name]) is None


@pytest.mark.parametrize("n", [1, 2, 5, 16, 17, 100, 1009])
def test_permutation_is_a_bijection(spark, n):
    steps = sharding.longest_walk(spark, n, 7)
    places = spark.range(n).selectExpr(f"{sharding.place_sql('id', n, steps, 7)} AS p")
    assert sorted(r.p for r in places.collect()) == list(range(n))


def test_shards_of_edge_cases(spark, edge, empty):
    rows = sharding.shard_rows(edge.select("doc_id", "lang"), ["doc_id", "lang"], 3).collect()
    assert sorted((r.slot * 3 + r.shard) for r in rows) == list(range(len(EDGE)))
    assert sharding.shard_rows(empty.select("doc_id"), ["doc_id"]).count() == 0


def _repeat_words(words, k=8):
    seen = {}
    for i in range(len(words) - k + 1):
        seen.setdefault(tuple(words[i : i + k]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + k)})


def test_quality_rules_by_brute_force(spark, sf, edge, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(edge.select("doc_id", "text"))
    rows = quality_rules.with_base(docs, "text").collect()
    for r in rows:
        words = [w.decode() for w in (r.text or "").encode().split()]
        lines = [x for x in (r.text or "").split("\n") if x.encode().split()]
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        assert r.n_symbols == sum((r.text or "").count(c) for c in "#*$%&|<>")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == _repeat_words(words)
    marked = docs.withColumn("t", F.col("doc_id") % 2 == 0)
    scored = quality_rules.quality_rules(marked, "text", "t", buckets=64)
    assert scored.count() == docs.count() and scored.filter("llr IS NULL").count() == 0
    assert quality_rules.quality_rules(
        empty.withColumn("t", F.lit(True)), "text", "t", buckets=8).count() == 0


@pytest.mark.parametrize("condition", ["kept", "base_failed", "llr IS NULL", "n_words > 5"])
def test_quality_rules_can_be_filtered(spark, condition):
    """Conditions on the results do not repeat the work on the texts."""
    import time

    text = " ".join(f"w{i % 7919}" for i in range(50_000))
    docs = spark.createDataFrame([(1, text, True), (2, "a b", False)], "doc_id long, text string, t boolean")
    started = time.perf_counter()
    rows = quality_rules.quality_rules(docs, "text", "t", buckets=64).filter(condition)
    assert rows.count() in (0, 1, 2) and time.perf_counter() - started < 20
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 4


def test_quality_rules_score_and_verdict(spark, edge):
    """Ratios and verdicts by plain loops over the same hashed buckets."""
    docs = edge.withColumn("t", F.col("doc_id") == 3)
    rows = quality_rules.quality_rules(docs, "text", "t", buckets=64, threshold=-0.01).collect()
    words = sorted({w for _, text, *_ in EDGE for w in (text or "").split(" ") if w})
    pairs = sorted({p for _, text, *_ in EDGE if text for p in zip(text.split(), text.split()[1:])})
    one = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(64)))
    two = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", F.pmod(F.xxhash64("a", "b"), F.lit(64)))
    bucket = {r[0]: r[1] for r in one.collect()} | {(r[0], r[1]): r[2] for r in two.collect()}

    def grams(text):
        own = (text or "").split()
        return [bucket[g] for g in [*own, *zip(own, own[1:])]]

    raw, target = Counter(), Counter()
    for doc_id, text, *_ in EDGE:
        raw.update(grams(text))
        target.update(grams(text) if doc_id == 3 else [])
    ratio = {b: np.log((target[b] + 1) / (target.total() + 64)) - np.log((raw[b] + 1) / (raw.total() + 64))
             for b in range(64)}
    for r in rows:
        own = grams(r.text)
        want = sum(ratio[b] for b in own) / len(own) if own else 0.0
        assert r.llr == pytest.approx(want, abs=1e-9)
        assert r.kept == (not r.base_failed and r.llr >= -0.01)


def test_line_dedup_ratio_decides_at_every_size(spark):
    docs = spark.createDataFrame(
        [(i, f"own {i}" + "\nfour of twenty" * (i < 4) + "\none of twenty" * (i == 4)) for i in range(20)]
        + [(100 + i, "on all four") for i in range(4)], "doc_id long, text string").withColumn(
        "source", F.when(F.col("doc_id") < 100, "a").otherwise("b"))
    rows = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(docs, "source", "text").collect()}
    assert rows == {**{i: f"own {i}" + "\none of twenty" * (i == 4) for i in range(20)},
                    **{100 + i: "" for i in range(4)}}


def test_warc_edge_cases(spark, shared_folder, tmp_path):
    body = "x" * 200
    pages = spark.createDataFrame(
        [(7, "http://a/b c", body), (3, None, body), (9, "u", ""), (10, "u", None), (3, None, body),
         (None, "u", "line\r\n\r\nWARC/1.0\r\n\r\n" * 20)],
        "page_id long, url string, html string")
    arc, out = str(tmp_path / "arc"), str(tmp_path / "warc")
    warc.write_pages_as_arc(pages, "page_id", "url", "html", arc)
    warc.convert_arc(spark, arc, out)
    rows = warc.read_warc(spark, out).collect()
    assert sorted(r.payload_bytes for r in rows) == [0, 0, 200, 200, 200, 400]
    large = [r for r in rows if r.payload_bytes == 200]
    assert sorted(r.record_type for r in large) == ["response", "revisit", "revisit"]
    assert {r.key for r in large if r.record_type == "response"} == {"3"}
    assert all(r.payload_digest == hashlib.sha256(body.encode()).hexdigest() for r in large)


def test_arc_versions_and_errors():
    for version in (1, 2):
        data = warc.arc_version_block(version, "n") + b"\n" + warc.arc_header(
            version, "http://h/", "20240102030405", "text/html", 3, "n") + b"abc\n"
        ((fields, _, block),) = warc.arc_records(data)
        assert fields["URL"] == "http://h/" and block == b"abc"
        with pytest.raises(ValueError):
            list(warc.arc_records(data[:-3]))


def test_arc_dates_types_and_bad_records(spark, tmp_path):
    def http(body):
        return b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n%s" % (len(body), body)

    def record(url, date, kind, block):
        return warc.arc_header(1, url, date, kind, len(block), "n") + block + b"\n"

    arc = tmp_path / "arc"
    arc.mkdir()
    whole = warc.arc_version_block(1, "n") + b"\n" + record("http://a/", "200001021234", "text/html", http(b"x" * 9))
    whole += record("dns:a", "20000102", "text/dns", b"a 1 IN A 0.0.0.0")
    (arc / "one.arc").write_bytes(whole)
    bad = b"http://b/ broken header\nsome text 12\n" + record("http://c/", "20000102030405", "text/html", http(b"ok"))
    (arc / "two.arc").write_bytes(whole + bad + record("http://d/", "20000102030405", "text/html", http(b"cut"))[:-3])
    with pytest.raises(Exception, match="no ARC header|ends 2 bytes"):
        warc.convert_arc(spark, str(arc), str(tmp_path / "strict"))
    out = str(tmp_path / "out")
    warc.convert_arc(spark, str(arc), out, strict=False)
    found = [(f["warc-target-uri"], f["warc-date"], f["content-type"])
             for p in sorted((tmp_path / "out").glob("part-*")) for f, _ in warc.warc_records(p.read_bytes())
             if f["warc-type"] != "warcinfo"]
    page = "application/http; msgtype=response"
    assert sorted(found) == sorted(2 * [("dns:a", "2000-01-02T00:00:00Z", "text/dns"), ("http://a/", "2000-01-02T12:34:00Z", page)]
                                   + [("http://c/", "2000-01-02T03:04:05Z", page)])
    problems = sorted((r.archive, r.position, r.problem[:13]) for r in warc.bad_arc_records(spark, str(arc)).collect())
    assert problems == [("two.arc", len(whole), "no ARC header"),
                        ("two.arc", len(whole + bad), "archive ends ")]


def test_warc_of_an_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    arc, out = str(tmp_path / "arc"), str(tmp_path / "warc")
    warc.write_pages_as_arc(pages, "page_id", "url", "html", arc)
    warc.convert_arc(spark, arc, out)
    assert warc.read_warc(spark, out).count() == 0


def test_line_dedup_edge_cases(spark, edge, empty):
    rows = line_dedup.drop_boilerplate(edge, "source", "text", ratio=0.3, min_pages=2).collect()
    assert len(rows) == len(EDGE)
    assert {(r.text, r.n_dropped) for r in rows if r.doc_id == 3} == {("", 1)}
    assert all(r.n_lines == 0 for r in rows if r.doc_id == 2)
    assert line_dedup.drop_boilerplate(empty, "source", "text").count() == 0


@pytest.mark.parametrize("pages", [2, 4, 10, 50])
def test_pipeline_drops_boilerplate_of_small_hosts(spark, sf, pages):
    shared = max(2, pages // 12)  # fewer than five pages, but over the ratio
    docs = spark.createDataFrame(
        [(i, f"own line {i}" + "\nmenu of the site" * (i < shared), "en", "h", 1)
         for i in range(pages)], SCHEMA)
    rows = corpus_pipeline.line_dedup(spark, docs, sf).collect()
    assert sorted(r.text for r in rows) == sorted(f"own line {i}" for i in range(pages))


def test_pipeline_keeps_the_lines_of_exact_copies(spark, sf):
    texts = ["clean line one\nclean line two"] * 8 + [f"menu\nown {i}" for i in range(4)]
    docs = spark.createDataFrame([(i, t, "en", "h", 1) for i, t in enumerate(texts)], SCHEMA)
    rows = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, sf).collect()}
    assert [rows[i] for i in range(12)] == texts[:8] + [f"own {i}" for i in range(4)]


def test_packing_round_trip(spark, edge, empty):
    path = packing.tokenizer_path()
    rows = packing.best_fit_packing(edge, "doc_id", "text", path, group_pieces=4).collect()
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 1024
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    ids = whole.encode(EDGE[5][1], add_special_tokens=False).ids + [2]
    own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == 4)
    for _, start, length, crc in own:
        assert zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc
    assert sum(x[2] for x in own) == len(ids) and all(x[2] == 1024 for x in own[1:])
    assert packing.best_fit_packing(empty, "doc_id", "text", path).count() == 0


@pytest.mark.parametrize("blank", [" ", "\n"])
def test_packing_of_a_very_long_blank_run(spark, blank):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    text = "a" + blank * 2_000_000 + "b"
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    rows = packing.token_pieces(docs, "doc_id", "text", path).collect()
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [2]
    own = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == 1)
    assert sum(x[1] for x in own) == len(ids) and any(r.doc_id == 2 for r in rows)
    for start, length, crc in own:
        assert zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc


def test_pack_is_close_to_the_bound():
    sizes = np.sort(np.random.default_rng(3).integers(1, 1024, 5000))[::-1]
    _, _, used = packing.pack(sizes)
    assert used <= 1.01 * -(-int(sizes.sum()) // 1024)


@pytest.mark.parametrize("capacity, n", [(7, 40), (16, 200), (50, 300)])
def test_pack_makes_the_least_sum_of_squares(capacity, n):
    """Every choice against all open sequences: least sum, then smallest gap, then the latest."""
    sizes = np.random.default_rng(capacity).integers(1, capacity + 1, n)
    gaps, order, want = [], [], []  # gap of each sequence; when it came to that gap

    def squares(open_gaps):
        return sum(k * k for g, k in Counter(open_gaps).items() if g)

    for step, size in enumerate(sizes.tolist()):
        fits = [k for k, gap in enumerate(gaps) if gap >= size]
        if not fits:
            gaps.append(capacity)
            order.append(step)
            best = len(gaps) - 1
        else:
            best = min(fits, key=lambda k: (squares([*gaps[:k], gaps[k] - size, *gaps[k + 1:]]), gaps[k], -order[k]))
        want.append((best, capacity - gaps[best]))
        gaps[best] -= size
        order[best] = step
    sequence, offset, used = packing.pack(sizes, capacity)
    assert list(zip(sequence.tolist(), offset.tolist())) == want and used == len(gaps)


@pytest.mark.parametrize("slice_", [100_000, 7])
def test_context_sums_and_pooling_by_plain_loops(monkeypatch, slice_):
    monkeypatch.setattr(classifier, "SLICE", slice_)
    random = np.random.default_rng(1)
    index, pad = classifier.index_vectors(), [classifier._PAD] * classifier.NEIGHBOURS
    ids = np.array([*pad, *random.integers(0, 5, 40), *pad, *random.integers(0, 5, 9), *pad])
    sums = np.zeros((classifier.BUCKETS + 1, classifier.DIM + 1), np.int32)
    classifier.add_contexts(ids, index, sums)
    want = np.zeros_like(sums)
    r = classifier.NEIGHBOURS
    for i in range(r, len(ids) - r):
        for d in range(-r, r + 1):
            want[ids[i], : classifier.DIM] += index[ids[i + d]] if d else 0
        want[ids[i], classifier.DIM] += 1
    assert np.array_equal(sums[: classifier.BUCKETS], want[: classifier.BUCKETS])
    vectors = random.random((classifier.BUCKETS, classifier.DIM))
    own = random.integers(0, 99, 50)
    assert classifier.pooled(own, vectors) == pytest.approx(np.mean([vectors[i] for i in own], axis=0))
    assert not classifier.pooled(own[:0], vectors).any()


def test_word_hashes_tell_words_apart():
    words, text = Words(), b"  a ab\tb a\nab\x0bc "
    values = words.of(text)
    assert len(values) == 6 and values[0] == values[3] and values[1] == values[4]
    assert len(set(values.tolist())) == 4
    big = b"word " * 600_000
    assert len(set(words.of(big).tolist())) == 1 and len(words.of(big)) == 600_000
    assert len(Windows().of(values, 7)) == 0


def test_decontamination_blocks_and_edges(spark, edge, empty):
    items = spark.createDataFrame(
        [(1, "one two"), (2, None), (3, "b c d e f a b c d e f a"), (None, "one"), (1, "one two")],
        "item_id long, text string")
    one, many = (
        sorted(map(str, decontamination.find_contamination(
            edge, "text", items, "item_id", "text", block_bytes=b).collect()))
        for b in (1 << 20, 12)
    )
    assert one == many
    rows = decontamination.find_contamination(edge, "text", items, "item_id", "text").collect()
    assert {(r.n_hit, tuple(r["items"])) for r in rows if r.doc_id == 3} == {(2, ("1",))}
    assert {r.n_hit > 53_990 for r in rows if r.doc_id == 4} == {True}
    assert decontamination.find_contamination(empty, "text", items, "item_id", "text").count() == 0


def test_classifier(spark, sf, edge, empty):
    docs = spark.createDataFrame(
        [(i, ("good words here " if i % 3 else "bad ### ### bad ") * 20, None, None, None)
         for i in range(400)], SCHEMA)
    labels = docs.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    rows = classifier.classify(docs.unionByName(edge.drop("extra")), "doc_id", "text", labels)
    found = [r for r in rows.collect() if r.held_out and r.doc_id > 5]
    assert found and all(r.predicted == (r.doc_id % 3 > 0) for r in found)
    assert classifier.classify(empty, "doc_id", "text", labels).count() == 0
    none = classifier.classify(edge, "doc_id", "text", labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_lm_scoring_by_brute_force(spark, edge, empty):
    marked = edge.withColumn("t", F.col("doc_id") == 3)
    rows = lm_scoring.score_difference(marked, "text", "t").collect()
    assert len(rows) == len(EDGE) and all(r.n_tokens == 0 == r.score for r in rows if not r.text)
    assert all(r.score < 0 for r in rows if r.doc_id == 3)
    assert all(r.score > 0 for r in rows if r.doc_id == 4)
    assert lm_scoring.score_difference(empty.withColumn("t", F.lit(True)), "text", "t").count() == 0


def test_lm_scoring_counts_every_ngram(spark):
    """More pairs than any fixed small table holds, in several batches, against plain dicts."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.2, 2000) % 40_000) for _ in range(150)]
    docs = spark.createDataFrame(
        [(i, t, i % 4 == 0) for i, t in enumerate(texts + [texts[0], None])],
        "doc_id long, text string, t boolean").repartition(3)
    single, both = ({True: Counter(), False: Counter()} for _ in range(2))
    for i, text in enumerate(texts + [texts[0]]):
        words = text.split()
        for k in {False, i % 4 == 0}:  # False: the background, of all documents
            single[k].update(words)
            both[k].update(zip(words, words[1:]))
    assert len(both[False]) > 100_000
    size = len(single[False])

    def loss(words, k):
        p = {w: (single[k][w] + 100 / size) / (single[k].total() + 100) for w in set(words)}
        pairs = zip(words, words[1:])
        return -(np.log(p[words[0]]) + sum(
            np.log((both[k][a, b] + 4 * p[b]) / (single[k][a] + 4)) for a, b in pairs)) / len(words)

    rows = {r.doc_id: r for r in lm_scoring.score_difference(docs, "text", "t").collect()}
    assert len(rows) == 152 and rows[151].n_tokens == 0 == rows[151].score
    for i in (0, 1, 77, 148, 150):
        words = (texts + [texts[0]])[i].split()
        assert rows[i].target_loss == pytest.approx(loss(words, True), rel=1e-9)
        assert rows[i].background_loss == pytest.approx(loss(words, False), rel=1e-9)


def test_substring_dedup_edge_cases(spark, edge, empty):
    rows = {r.doc_id: r for r in substring_dedup.remove_repeats(edge, "text").collect()}
    assert rows[4].n_removed == rows[4].n_words == 54_000 and rows[4].kept == ""
    assert rows[5].n_removed == 120 and rows[3].kept == "one two" and rows[1].kept == ""
    assert substring_dedup.remove_repeats(empty, "text").count() == 0


def test_sliding_argmin():
    values = np.random.default_rng(1).integers(0, 5, 200).astype(np.uint64)
    for width in (1, 2, 3, 20):
        places = substring_dedup.sliding_argmin(values, width)
        assert places.tolist() == [
            i + int(np.argmin(values[i : i + width])) for i in range(201 - width)]


def test_jaccard_by_brute_force(spark, edge, empty):
    random = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(150):
        words = list(base) if i % 3 else [f"v{i}-{j}" for j in range(30)] + base[:30]
        for at in random.integers(0, len(words), random.integers(0, 4)):
            words[at] = f"x{random.integers(0, 9)}"
        docs.append((1000 + i, " ".join(words), None, None, None))
    df = spark.createDataFrame(docs, SCHEMA).unionByName(edge.drop("extra"))
    rows = jaccard_join.jaccard_components(df, "doc_id", "text").collect()
    sets = []
    for doc_id, text, *_ in docs + EDGE:
        words = (text or "").encode().lower().split()
        k = min(5, max(1, len(words)))
        sets.append((doc_id, {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}))
    label = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and 100 * both >= 80 * (len(a) + len(b) - both):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    want = sorted(
        str((d, len(s), min((x for x, m in zip((y[0] for y in sets), label)
                             if m == label[i] and x is not None), default=None)))
        for i, (d, s) in enumerate(sets))
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in rows) == want
    assert jaccard_join.jaccard_components(empty, "doc_id", "text").count() == 0
    kept = jaccard_join.keep_one_of_each(edge, "doc_id", "text").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "4", "5", "None"]


def copies_without_a_hub(n, seed=6):
    """Copies of one text with three or four own edits each; few pairs reach the bound."""
    random = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(n):
        words = list(base)
        for k, at in enumerate(random.integers(0, 200, 3 + i % 2)):
            words[at] = f"own{i}-{k}"
        docs.append((i, " ".join(words)))
    return docs


@pytest.mark.parametrize("cell_rows, pair_rows", [(1_000, 48), (17, 5), (1_000, 1_000)])
def test_jaccard_of_copies_without_a_hub(spark, monkeypatch, cell_rows, pair_rows):
    """What leaves the product grows with the rows, not with their pairs, and no link is lost."""
    monkeypatch.setattr(jaccard_join, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(jaccard_join, "PAIR_ROWS", pair_rows)
    seen = []
    product = jaccard_join.product_links
    monkeypatch.setattr(jaccard_join, "product_links", lambda *a: (r := product(*a), seen.append(r.count()))[0])
    docs = copies_without_a_hub(150)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, "doc_id", "text").collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for _, t in docs]
    label = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 80 * len(a | b):
                old, new = sorted((label[i], label[j]))[::-1]
                label = [new if x == old else x for x in label]
    assert rows == dict(enumerate(label)) and 1 < len(set(label)) < 150
    assert seen[0] <= 150 * 60


@pytest.mark.parametrize("local_edges", [1_000_000, 50])
def test_components_of_a_long_path(spark, monkeypatch, local_edges):
    monkeypatch.setattr(components, "LOCAL_EDGES", local_edges)
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901)], "a long, b long")
    rows = components.components(edges).collect()
    assert {(r.node, r.component) for r in rows} == {
        *((i, 0) for i in range(301)), (900, 900), (901, 900)}


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf).cache()
        if name != "packing":
            assert tuple(after.columns) == corpus_pipeline.COLUMNS and 0 < after.count() <= docs.count()
            docs = after
    assert after.select("doc_id").distinct().count() == docs.count()


ADDED = {
    "shard_rows": ("row", "shard", "slot"), "quality_rules": quality_rules.RESULTS,
    "drop_boilerplate": ("n_lines", "n_dropped"),
    "score_difference": ("n_tokens", "target_loss", "background_loss", "score"),
    "find_contamination": ("n_words", "n_hit", "items"), "classify": ("held_out", "score", "predicted"),
    "remove_repeats": ("n_words", "n_removed", "kept"), "jaccard_components": ("n_shingles", "component_id"),
    "keep_one_of_each": (),
}


@pytest.mark.parametrize("name", sorted(ADDED))
def test_columns_of_any_names(spark, edge, name):
    """Clashing columns of the caller give way to results and change nothing else."""
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    labels = spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, quality int")
    run = {
        "shard_rows": lambda d, t: sharding.shard_rows(d, [t, "doc_id"], 3),
        "quality_rules": lambda d, t: quality_rules.quality_rules(d, t, "extra", buckets=16),
        "drop_boilerplate": lambda d, t: line_dedup.drop_boilerplate(d, "source", t),
        "score_difference": lambda d, t: lm_scoring.score_difference(d, t, "extra"),
        "find_contamination": lambda d, t: decontamination.find_contamination(d, t, items, "item_id", "text"),
        "classify": lambda d, t: classifier.classify(d, "doc_id", t, labels),
        "remove_repeats": lambda d, t: substring_dedup.remove_repeats(d, t),
        "jaccard_components": lambda d, t: jaccard_join.jaccard_components(d, "doc_id", t),
        "keep_one_of_each": lambda d, t: jaccard_join.keep_one_of_each(d, "doc_id", t),
    }[name]
    plain = edge.select("doc_id", "text", "source", (F.col("doc_id") == 3).alias("extra"))
    inside = ["__k1", "__words", "__batch", "__text", "__key", "id", "node", "block"]
    clash = plain.select("*", *(F.lit("own").alias(n) for n in inside), *(F.lit("own").alias(n.upper()) for n in ADDED[name]))
    mine, want = run(clash, "text"), run(plain, "text")
    kept = [] if name == "jaccard_components" else inside
    assert mine.columns == [*(c for c in want.columns if c not in ADDED[name]), *kept, *ADDED[name]]
    same = [c for c in want.columns if name != "shard_rows" or c not in ADDED[name]]
    rows = sorted(map(repr, mine.select(same).collect()))
    assert rows == sorted(map(repr, want.select(same).collect()))
    assert all(r[c] == "own" for r in mine.collect() for c in kept)
    # The text itself under a clashing name.
    odd = plain.withColumnRenamed("text", "__key")
    assert run(odd, "__key").count() == len(rows)
