import collections
import random

import pytest
from tokenizers import Tokenizer

from nodeweft.llm import mixing, tokens

PATH = tokens.TOKENIZERS


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(f"{PATH}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_plain_encoding(plain):
    e = tokens.FragmentEncoder("byte_bpe_50k", PATH)
    rng = random.Random(7)
    letters = "ab 'stlev\n\t  　é→字1#​́İ-\x85\x1c  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 16))) for _ in range(3000)]
    texts += ["<|endoftext|> x", "it's we're I'll ''s", "x" * 20000, "word " * 20000, "  " * 300, "\U0001f600'\U0001f600"]
    for text in texts:
        assert e.encode(text).tolist() == plain(text), repr(text[:40])


def test_every_cut_is_forced():
    e = tokens.FragmentEncoder("byte_bpe_50k", PATH)
    data = "The quick brown fox, über-allem; d'accord".encode()
    parts = e.fragments(data)
    assert b"".join(parts) == data and len(parts) > 5


def test_null_empty_and_extra_columns(spark, plain):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "héllo wörld", 0), (3, "héllo wörld", 0)], "doc_id long, text string, ids int")
    got = tokens.with_token_ids(df).collect()
    assert [r["ids"] for r in got] == [[], [], plain("héllo wörld"), plain("héllo wörld")]
    assert [r["n"] for r in df.select(tokens.token_count(df["text"]).alias("n")).collect()] == [0, 0, len(plain("héllo wörld")), len(plain("héllo wörld"))]
    assert tokens.with_token_ids(df.limit(0)).count() == 0


SIZES = "doc_id long, source string, tokens long"
TARGETS = "source string, target_share double, max_repeats int"


def test_shares_are_reached(spark):
    sizes = spark.createDataFrame([(i, "a" if i % 3 else "b", 10) for i in range(6000)], SIZES)
    targets = spark.createDataFrame([(" A", 0.5, 1), ("B", 0.5, 4), ("none", 0.1, 2)], TARGETS)
    rated = mixing.rates(sizes, targets)
    rate = {r["source"]: r["rate"] for r in rated.collect()}
    assert rate == {"a": 1.0, "b": 2.0, "none": 0.0}
    mixed = mixing.mixture(sizes, rated)
    report = {r["source"]: r for r in mixing.shares(mixed, rated).collect()}
    assert report["a"]["reached_share"] == report["b"]["reached_share"] == 0.5
    assert report["none"]["status"] == "no documents" and report["a"]["status"] == "met"
    assert max(r["copy"] for r in mixed.collect()) == 1


def test_fraction_is_a_stable_draw(spark):
    sizes = spark.createDataFrame([(i, "a", 5) for i in range(4000)] + [(i, "b", 5) for i in range(4000, 5000)], SIZES)
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 1)], TARGETS)
    rated = mixing.rates(sizes, targets)
    draw = lambda df, seed=0: sorted((r["doc_id"], r["copy"]) for r in mixing.mixture(df, rated, seed).collect())
    first = draw(sizes)
    assert first == draw(sizes.repartition(7)) and first != draw(sizes, 1)
    share = {r["source"]: r["reached_share"] for r in mixing.shares(mixing.mixture(sizes, rated), rated).collect()}
    assert abs(share["a"] - 0.7) < 0.02


def test_max_repeats_hold(spark):
    sizes = spark.createDataFrame([(1, "a", 10), (2, "b", 1000), (3, None, 5), (4, "a", 0), (5, "other", 9)], SIZES)
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 3), (None, 0.5, 1), ("a", None, 5)], TARGETS)
    rated = mixing.rates(sizes, targets, total_tokens=2000)
    got = collections.Counter(r["doc_id"] for r in mixing.mixture(sizes, rated).collect())
    assert got[1] == 3 and got[2] == 1 and set(got) == {1, 2}
    report = {r["source"]: r["status"] for r in mixing.shares(mixing.mixture(sizes, rated), rated).collect()}
    assert report["a"] == "max_repeats reached"


def test_empty_tables(spark):
    sizes, targets = spark.createDataFrame([], SIZES), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    rated = mixing.rates(sizes, targets)
    assert mixing.mixture(sizes, rated).count() == 0
    assert [r["status"] for r in mixing.shares(mixing.mixture(sizes, rated), rated).collect()] == ["no documents"]
    none = mixing.rates(sizes, targets.limit(0))
    assert mixing.shares(mixing.mixture(sizes, none), none).count() == 0


def test_whole_documents(spark):
    docs = spark.createDataFrame([(1, " Readme", "some text here"), (2, "readme", None), (3, "README ", "")], "doc_id long, source string, text string")
    sizes = mixing.document_sizes(docs)
    assert [(r["source"], r["tokens"]) for r in sizes.orderBy("doc_id").collect()] == [("readme", 3), ("readme", 0), ("readme", 0)]
