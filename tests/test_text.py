import hashlib
import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from parley.functions import cues as cu
from parley.functions import detectors as dt
from parley.functions import numbers as nb
from parley.functions import patterns as rx
from parley.functions import text as tx
from parley.functions.registration import register_functions
from parley.functions.wordpiece import token_length_udf
from parley.settings import CUE_TERMS, CueTerm

# Text, clean text, duplicate key, export text, words, and the detectors that find something:
# (u)rl, (m)ail, (d)igits, repeated (p)unctuation, all-(c)aps word, (o)bfuscation.
# Derived by hand from the rules: entities and NFKC first, whitespace runs to one space, masks
# for addresses that begin at a word boundary, full case folding for the key, and for the export
# lower-case a-z and digits only.
TABLE = [
    (None, '', '', '', 0, ''),
    ('', '', '', '', 0, ''),
    (' \t', '', '', '', 0, ''),
    ('&nbsp;', '', '', '', 1, ''),
    ('\x1c', '', '', '', 0, ''),
    ('\x1c a \x1f\u2028b\xa0', 'a b', 'a b', 'a b', 2, ''),
    ('&lt;b&gt; &amp;amp; &#x41;&#66 &ampx', '<b> &amp; AB &x', '<b> &amp; ab &x', 'b ab x', 4, 'do'),
    ('ﬁne Ａ① ½ ²', 'fine A1 1⁄2 2', 'fine a1 1⁄2 2', 'fine a1 1 2 2', 4, ''),
    ('Straße STRASSE ﬀ', 'Straße STRASSE ff', 'strasse strasse ff', 'stra e strasse ff', 3, 'c'),
    ('see www.x.com/a?b now', 'see <URL> now', 'see www.x.com/a?b now', 'see now', 3, 'uo'),
    ('http://user@ex.com/p', '<URL>', 'http://user@ex.com/p', '', 1, 'umo'),
    ('mail me@ex.com.', 'mail <EMAIL>.', 'mail me@ex.com.', 'mail', 2, 'mo'),
    ('éuser@x.com .a@b.co1 a@b.co_', 'éuser@x.com .a@b.co1 a@b.co_', 'éuser@x.com .a@b.co1 a@b.co_', 'user x com a b co1 a b co', 3, 'do'),
    ('HTTPS://X.Y é www.é', '<URL> é <URL>', 'https://x.y é www.é', '', 3, 'uco'),
    ('xwww.foo.com _www.foo.com', 'xwww.foo.com _www.foo.com', 'xwww.foo.com _www.foo.com', 'xwww foo com www foo com', 2, 'o'),
    ('A  b', 'A b', 'a b', 'a b', 2, ''),
    ('a\r\nb\n\nc', 'a b c', 'a b c', 'a b c', 3, ''),
    ('f.u.c.k', 'f.u.c.k', 'f.u.c.k', 'f u c k', 1, 'o'),
    ('fuck', 'fuck', 'fuck', 'fuck', 1, 'o'),
    ('hello!', 'hello!', 'hello!', 'hello', 1, 'o'),
    ('x@y', 'x@y', 'x@y', 'x y', 1, 'o'),
    (' @foo', '@foo', '@foo', 'foo', 1, ''),
    ('é@', 'é@', 'é@', '', 1, 'o'),
    ('4x', '4x', '4x', '4x', 1, 'do'),
    ('é4', 'é4', 'é4', '4', 1, 'd'),
    ('x0é', 'x0é', 'x0é', 'x0', 1, 'd'),
    ('x0', 'x0', 'x0', 'x0', 1, 'do'),
    ('0ab_', '0ab_', '0ab_', '0ab', 1, 'd'),
    ('a-b-c', 'a-b-c', 'a-b-c', 'a b c', 1, 'o'),
    ('a_b_c', 'a_b_c', 'a_b_c', 'a b c', 1, 'o'),
    ('a-b-c_', 'a-b-c_', 'a-b-c_', 'a b c', 1, ''),
    ('a-b-cé d', 'a-b-cé d', 'a-b-cé d', 'a b c d', 2, ''),
    ('aébéc', 'aébéc', 'aébéc', 'a b c', 1, 'o'),
    ('a-b_c-d_', 'a-b_c-d_', 'a-b_c-d_', 'a b c d', 1, 'o'),
    ('a-b', 'a-b', 'a-b', 'a b', 1, ''),
    ('a--b--c1', 'a--b--c1', 'a--b--c1', 'a b c1', 1, 'do'),
    ('sooo', 'sooo', 'sooo', 'sooo', 1, 'o'),
    ('SoOo', 'SoOo', 'sooo', 'sooo', 1, 'o'),
    ('www', 'www', 'www', 'www', 1, 'o'),
    ('٣', '٣', '٣', '', 1, 'd'),
    ('7', '7', '7', '7', 1, 'd'),
    ('!!!', '!!!', '!!!', '', 1, 'po'),
    ('!?!', '!?!', '!?!', '', 1, 'o'),
    ('...', '...', '...', '', 1, 'p'),
    ('AB', 'AB', 'ab', 'ab', 1, 'c'),
    ('ABc', 'ABc', 'abc', 'abc', 1, ''),
    ('É AB', 'É AB', 'é ab', 'ab', 2, 'c'),
    ('ÉAB', 'ÉAB', 'éab', 'ab', 1, ''),
    ('AB1', 'AB1', 'ab1', 'ab1', 1, 'do'),
    ('b_i_t_c_h', 'b_i_t_c_h', 'b_i_t_c_h', 'b i t c h', 1, 'o'),
    ('shit_', 'shit_', 'shit_', 'shit', 1, ''),
    ('s h i t', 's h i t', 's h i t', 's h i t', 4, 'o'),
    ('éshit', 'éshit', 'éshit', 'shit', 1, ''),
    ('Shut  up you idiot, IDIOT! 😀 moron', 'Shut up you idiot, IDIOT! 😀 moron', 'shut up you idiot, idiot! 😀 moron', 'shut up you idiot idiot moron', 7, 'co'),
    ('idiotic', 'idiotic', 'idiotic', 'idiotic', 1, ''),
    ('édumb', 'édumb', 'édumb', 'dumb', 1, ''),
    ('hate\nyou', 'hate you', 'hate you', 'hate you', 2, ''),
    ('a black\xa0woman', 'a black woman', 'a black woman', 'a black woman', 3, ''),
    ('idıot İdiot ſtupid', 'idıot İdiot stupid', 'idıot i̇diot stupid', 'id ot i diot stupid', 3, ''),
    ('İI ıi Ŀ ŉ ǰ Σίσυφος ς', 'İI ıi L· ʼn ǰ Σίσυφος ς', 'i̇i ıi l· ʼn ǰ σίσυφοσ σ', 'i i i l n', 7, ''),
    ('é x́idiot', 'é x́idiot', 'é x́idiot', 'x idiot', 2, ''),
    ('한국어 ひらがな ｶﾞ', '한국어 ひらがな ガ', '한국어 ひらがな ガ', '', 3, ''),
    ('😀 www.😀.com', '😀 <URL>', '😀 www.😀.com', '', 2, 'uo'),
    ('Ⅷ ⅷ ª', 'VIII viii a', 'viii viii a', 'viii viii a', 3, ''),
    ('text with && & ampersands &; &a', 'text with && & ampersands &; &a', 'text with && & ampersands &; &a', 'text with ampersands a', 7, ''),
    ('trailing space ', 'trailing space', 'trailing space', 'trailing space', 2, ''),
    ('tab\there', 'tab here', 'tab here', 'tab here', 2, ''),
    ('NA', 'NA', 'na', 'na', 1, 'c'),
    ('null', 'null', 'null', 'null', 1, ''),
]
TRICKY = [row[0] for row in TABLE]


@pytest.fixture(scope="module")
def rows(spark, sf):
    known = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    turns = [r[0] for r in spark.read.parquet(f"{sf}/conversations.parquet").select("text").collect()]
    pages = [r[0] for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()]
    texts = TRICKY + known + turns + pages + noise()
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(8).cache()


def noise(n=4000):
    """Random texts of characters and pieces on which the rules could trip."""
    pick = random.Random(5)
    parts = list("aabxéß19_03!.,-+%@@/: \n'") + ["www.", "http://", ".com", "@b.de", "fu", "ck", "&amp;", "Ａ", "x\u0301", "²", "a-b-c", "_-"]
    return ["".join(pick.choice(parts) for _ in range(pick.randint(1, 40))) for _ in range(n)]


T = "text"


def results(rows, column):
    return [(r[0], r[1]) for r in rows.select("text", column.alias("x")).collect()]


def check(rows, column, expected):
    for text, got in results(rows, column):
        assert got == expected(text), repr(text)[:200]


DETECTORS = {
    "u": dt.contains_url, "m": dt.contains_email, "d": dt.contains_digits,
    "p": dt.contains_repeated_punctuation, "c": dt.contains_all_caps_token, "o": dt.has_obfuscation,
}


def test_table_of_texts(spark):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "id int, text string")
    df = tx.add_duplicate_text(tx.add_clean_text(df, T, "clean"), T, "key")
    df = tx.add_export_text(df, "clean", "export")
    flags = F.concat(*[F.when(find(F.col(T)), name).otherwise("") for name, find in DETECTORS.items()])
    found = df.select("id", T, "clean", "key", "export", tx.word_count(F.col(T)), flags).orderBy("id").collect()
    assert [tuple(r)[1:] for r in found] == TABLE


def test_normalised_texts(rows):
    for text, got in results(rows, tx.unescape_nfkc(F.col(T))):
        if text is None:
            assert got is None
            continue
        assert unicodedata.is_normalized("NFKC", got)
        if "&" not in text:
            assert got == unicodedata.normalize("NFKC", text)
    check(rows, tx.casefold(F.col(T)), lambda t: None if t is None else t.casefold())


def test_clean_texts(rows):
    once = tx.add_clean_text(rows, T, "clean")
    twice = tx.add_clean_text(once, "clean", "again")
    for r in twice.select("text", "clean", "again").collect():
        assert r.clean == " ".join(r.clean.split())
        if "&" not in (r.text or "") and "<" not in r.clean:
            assert r.again == r.clean, r.text
        if "://" not in (r.text or "") and "www." not in (r.text or "").lower() and "@" not in (r.text or ""):
            assert "<URL>" not in r.clean and "<EMAIL>" not in r.clean or "<" in (r.text or "")
    exported = tx.add_export_text(once, "clean", "export").select("export")
    assert all(re.fullmatch("(?:[a-z0-9]+(?: [a-z0-9]+)*)?", r.export) for r in exported.collect())


def test_duplicate_keys_ignore_case_blanks_and_entities(spark):
    groups = [["A  b", "a b", " a\tB\u00a0", "&#65; b", "Ａ b"], ["Straße", "STRASSE", "straße\n"], [None, "", " \t"], ["a b c"], ["<URL>"], ["www.x.com"]]
    df = spark.createDataFrame([(k, t) for k, own in enumerate(groups) for t in own], "k int, text string")
    keys = {(r.k, r.key) for r in tx.add_duplicate_text(df, T, "key").collect()}
    assert len(keys) == len(groups) == len({key for _, key in keys})
    exact = tx.add_duplicate_text(df, T, "key", fold=False).filter("k = 0").select("key").distinct().count()
    assert exact == 3  # "A b", "a b" and "a B"


def test_lengths_hashes_and_blanks(rows):
    text = F.col(T)
    check(rows, tx.word_count(text), lambda t: len((t or "").split()))
    check(rows, tx.sha256_text(text), lambda t: hashlib.sha256((t or "").encode()).hexdigest())
    check(rows, tx.is_blank(text), lambda t: not (t or "").strip())
    check(rows, tx.strip_cell(text), lambda t: (t or "").strip())


# Addresses with what may stand before and behind them, and near misses.
MAILS = ["me@ex.com", "a.b+c%d_e-f@sub.ex-am.org", "X@Y.ZZ", "1@2.co", "a@b.com.c@d.com", "é.user@x.com", "-user@x.com", "+.a@b.cc@d.ee", "éuser.name@x.com"]
NO_MAILS = ["me@ex", "me@ex.c", "@ex.com", "me@.", "me ex.com", "éuser@x.com", "_@a.bc1", "a@b.c1_"]
LINKS = ["http://x", "https://user@ex.com/p?q", "www.x", "HTTP://X", "WwW.é"]
NO_LINKS = ["http:/x", "htt://x", "ww.x.com", "xwww.foo", "_www.foo", "www. x", "http:// x", "www."]


def test_addresses_in_their_surroundings(spark):
    around = [("", ""), ("see ", " now"), ("(", ") ."), ('"', '"'), ("日本 ", " 日本"), ("\n", "\t")]
    cases = [(a + x + b, name, want) for name, want, own in (
        ("m", True, MAILS), ("m", False, NO_MAILS), ("u", True, LINKS), ("u", False, NO_LINKS)) for x in own for a, b in around
        # A link takes all that is no blank, so a mark behind the missing rest would be one.
        if want or name == "m" or b[:1] in ("", " ", "\t")]
    df = spark.createDataFrame(cases, "text string, name string, want boolean")
    found = F.when(F.col("name") == "m", dt.contains_email(F.col(T))).otherwise(dt.contains_url(F.col(T)))
    wrong = df.filter(found != F.col("want")).select(T, "name", "want").collect()
    assert not wrong
    masked = tx.add_clean_text(df, T, "clean").collect()
    assert all(("<EMAIL>" if r.name == "m" else "<URL>") in r.clean for r in masked if r.want)


def test_obfuscation_of_plain_and_changed_words(spark):
    plain = ["plain words only", "well-known facts", "it's a test.", "Ünï çödé", "a b c d", "one, two; three", "x_y", "2567", "ab89c"]
    changed = ["f.r.e.e", "h3llo", "s1lly", "wow!", "b@d", "d4ft", "n0", "sooo good", "s-h-i-t", "f u c k", "f*u*c*k", "a_b_c", "b!tch"]
    df = spark.createDataFrame([(t, False) for t in plain] + [(f"so {t} there", True) for t in changed], "text string, want boolean")
    assert not df.filter(dt.has_obfuscation(F.col(T)) != F.col("want")).collect()
    chains = ["a-b-c", "x a.b.c y", "a--b__c", "aéb-c", "a-b-c d-e"]
    broken = ["a-b", "a b c", "a-1-b", "a-b-", "1a-b-c", "a-b-c_"]
    df = spark.createDataFrame([(t, True) for t in chains] + [(t, False) for t in broken], "text string, want boolean")
    assert not df.filter(dt.has_inserted_symbols(F.col(T)) != F.col("want")).collect()


def test_terms_match_whole_words_only(spark):
    cases = [("you Idiot", True), ("idiot", True), ("(idiot)", True), ("idiotic", False), ("_idiot", False), ("anidiot", False),
             ("éidiot", False), ("idiot1", False), ("idi ot", False), ("two \t words!", True), ("twowords", False), (None, False)]
    df = spark.createDataFrame(cases, "text string, want boolean")
    found = dt.contains_any_term(F.col(T), ("idiot", "two words", "two"))
    assert not df.filter(found != F.col("want")).filter("text <> 'two'").collect()


CUES = [
    ("Shut  up you idiot, IDIOT! 😀 moron", [("shut up", [(0, 8)]), ("idiot", [(13, 18), (20, 25)]), ("moron", [(29, 34)])]),
    ("idiotic édumb", []), ("hate\nyou", [("hate you", [(0, 8)])]), (None, []), ("", []),
    ("useless trash, useless", [("useless", [(0, 7), (15, 22)]), ("trash", [(8, 13)])]),
    ("GO DIE go die", [("go die", [(0, 6), (7, 13)])]),
]


def test_cue_spans(rows, spark):
    df = spark.createDataFrame([(t,) for t, _ in CUES], "text string")
    for (text, want), r in zip(CUES, df.select("text", cu.detect_cues("text").alias("c")).collect()):
        assert [(c["keyword"], [tuple(p) for p in c["positions"]]) for c in r["c"]] == want, text
    # Whatever the text: spans cover the keyword as a whole word, in order and apart.
    known = {c.keyword for c in CUE_TERMS}
    found = rows.select("text", cu.detect_cues("text").alias("c")).collect()
    assert any(r["c"] for r in found)
    for r in found:
        for c in r["c"]:
            spans = [tuple(p) for p in c["positions"]]
            assert c["keyword"] in known and c["count"] == len(spans) and (c["start"], c["end"]) == spans[0]
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
            for start, end in spans:
                assert re.fullmatch(c["keyword"].replace(" ", r"\s+"), r["text"][start:end], re.I)
                for beside in (r["text"][start - 1 : start], r["text"][end : end + 1]):
                    assert not (beside.isalnum() or beside == "_")
        assert [c["start"] for c in r["c"]] == sorted(c["start"] for c in r["c"])


def test_segments_join_to_the_text_and_spans_do_not_overlap(spark):
    terms = [CueTerm("bad dog", "x", "High"), CueTerm("dog", "y", "Low"), CueTerm("dog food", "z", "Low"), CueTerm('say "no"', "q", "Low")]
    texts = ["bad dog food, dog food; dog", 'say "no" dog', "none", "", "😀 dog 😀"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("cues", cu.detect_cues("text", terms))
    df = df.withColumn("spans", cu.highlight_spans(F.col("text"), F.col("cues")))
    df = df.withColumn("segments", cu.highlight_segments(F.col("text"), F.col("spans")))
    for row in df.collect():
        assert "".join(s["text"] for s in row["segments"]) == row["text"]
        ends = 0
        for span in row["spans"]:
            assert span["start"] >= ends and span["end"] > span["start"]
            ends = span["end"]
        marked = [s["text"] for s in row["segments"] if s["marked"]]
        assert marked == [row["text"][s["start"]:s["end"]] for s in row["spans"]]
    first = df.filter(F.col("text").startswith("bad")).first()
    assert [(s["start"], s["end"], s["keyword"]) for s in first["spans"]] == [
        (0, 7, "bad dog"), (14, 22, "dog food"), (24, 27, "dog")]


def test_clamped_spans(spark):
    row = spark.sql(
        "SELECT 'abc' AS text, array(named_struct('keyword','k','category','c','severity','s','start',-2,'end',9,'count',2,"
        "'positions', array(named_struct('start',-2,'end',2), named_struct('start',5,'end',9)))) AS cues"
    ).select(cu.highlight_spans(F.col("text"), F.col("cues")).alias("s")).first()
    assert [(s["start"], s["end"]) for s in row["s"]] == [(0, 2)]


def test_stable_texts_need_no_python():
    inner = re.search(r"\[(.*)\]\+\+", rx._STABLE).group(1)
    stable = re.compile(f"[{inner}\\x00-\\x7f]")
    later = {0x1161 + i for i in range(21)} | {0x11A8 + i for i in range(27)}
    for code in range(0x110000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            later.add(int(parts[1], 16))
    for code in range(0x110000):
        ch = chr(code)
        if stable.fullmatch(ch):
            assert unicodedata.normalize("NFKC", ch) == ch and not unicodedata.combining(ch)
            assert code not in later
            assert ch.lower().replace("ß", "ss") == ch.casefold()


def test_hostile_texts_are_linear(spark):
    texts = ["a" * 20000, "a-" * 20000, "a_" * 20000, "a_a-" * 5000, "a." * 20000, "f-" * 20000, "0a" * 10000 + "é", " " * 30000, "a_-" * 20000, "a." * 20000 + " @"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    started = time.time()
    got = [r[0] for r in df.select(dt.has_obfuscation(F.col("text"))).collect()]
    tx.add_clean_text(df, T).select("text_clean", dt.contains_email(F.col("text")), cu.detect_cues("text")).collect()
    assert time.time() - started < 60
    assert got == [True, True, False, True, True, True, False, False, False, True]


def test_switches_and_replacement_text(spark):
    df = spark.createDataFrame([("a@b.com www.x.de  z",)], "text string")

    def clean(**options):
        return tx.add_clean_text(df, T, **options).first()["text_clean"]

    assert clean(replace_urls=False) == "<EMAIL> www.x.de z"
    assert clean(replace_emails=False) == "a@b.com <URL> z"
    assert clean(url_token="$1\\", email_token=" ") == "$1\\ z"


def test_python_is_asked_once_per_step(rows):
    """Two UDF nodes, one for entities and NFKC, one for folding, each with one call."""
    plan = tx.add_casefolded(tx.add_clean_text(rows, T), "text_clean", "x")._jdf.queryExecution().executedPlan().toString()
    nodes = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert len(nodes) == 2 and all(n.count("pythonUDF0") == 1 and "pythonUDF1" not in n for n in nodes)


def test_rounding_follows_the_binary_value(spark):
    values = [0.00015, 0.0625, 0.15, 0.00025, 0.0075, 0.849999, 0.5, 0.0, 1.0, 0.99995, 2 / 3, 0.1234500000001]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    p = F.col("p")
    for row in df.select("p", nb.round_exact(p, 4).alias("r"), nb.format_percent(p).alias("f"), nb.plain_number(p).alias("n"),
                         nb.plain_number(p, True, 4).alias("j")).collect():
        assert row["r"] == round(row["p"], 4)
        assert row["f"] == f"{row['p'] * 100:.1f}%"
        assert row["j"] == repr(row["p"])
    small = spark.createDataFrame([(1e-6,), (1.5e-7,), (3.0,)], "p double").select(nb.plain_number(F.col("p"))).collect()
    assert [r[0] for r in small] == ["0.000001", "1.5e-7", "3"]


def test_token_length_matches_a_public_tokenizer(spark, rows):
    tokenizers = pytest.importorskip("tokenizers")
    letters = [chr(c) for c in range(33, 127)] + list("äöüßñçéèêíó©·")
    pieces = letters + ["##" + c for c in letters] + ["the", "##ing", "##tion", "ent", "##er", "mail", "##ly", "un"]
    vocabulary = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", *dict.fromkeys(pieces)]
    public = tokenizers.BertWordPieceTokenizer(vocab={w: i for i, w in enumerate(vocabulary)}, lowercase=True)
    lengths = token_length_udf(spark, vocabulary)
    check(rows, lengths(F.col("text")), lambda t: len(public.encode(t or "").ids))


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("SELECT parley_text_clean('x &amp; me@ex.com') a, size(parley_detect_cues('you idiot')) b").first()
    assert tuple(row) == ("x & <EMAIL>", 1)


def test_piece_trie_takes_the_longest_piece():
    from parley.functions.wordpiece import PieceCounter, PieceTrie

    rng = random.Random(3)
    pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(25)} | {"a", "b"}
    later = {"##" + p for p in list(pieces)[:15]} | {"##a", "##c"}
    trie = PieceTrie(pieces | later)

    def longest(word):
        at = total = 0
        while at < len(word):
            lead = "##" if at else ""
            end = max((e for e in range(at + 1, len(word) + 1) if lead + word[at:e] in pieces | later), default=0)
            if not end:
                return 1
            at, total = end, total + 1
        return total

    for _ in range(3000):
        word = "".join(rng.choice("abcd" if rng.random() < 0.05 else "abc") for _ in range(rng.randint(1, 14)))
        assert trie.count(word) == longest(word), word
    assert trie.count("a" * 101) == 1
    counter = PieceCounter(["ab", "##c"])
    assert counter.words("Ab\x01c  d-e\u00a0É日本") == ["abc", "d", "-", "e", "e", "日", "本"]
    assert counter.words("Ab\x01c\td-e!") == ["abc", "d", "-", "e", "!"]
    assert counter.length(None) == 2 and counter.length("abc ABC x") == 2 + 2 + 2 + 1


def test_a_batch_is_changed_a_few_texts_at_a_time():
    """Python holds AT_ONCE texts of a batch; null stays null, and order is kept."""
    import pyarrow as pa

    from parley.functions import text as tx

    seen = []

    def change(text):
        seen.append(text)
        return text.casefold()

    texts = [None if i % 3 == 0 else f"Straße {i}" for i in range(5 * tx.AT_ONCE + 7)]
    changed = tx._text_udf(change).func
    out = changed(pa.array(texts, pa.string()))
    assert isinstance(out, pa.StringArray)
    assert out.to_pylist() == [t and f"strasse {i}" for i, t in enumerate(texts)]
    assert len(seen) == sum(t is not None for t in texts)
    assert changed(pa.nulls(3, pa.string())).to_pylist() == [None] * 3
    assert changed(pa.array([], pa.string())).to_pylist() == []
