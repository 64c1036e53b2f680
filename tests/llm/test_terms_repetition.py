import collections
import math
import random
import re

from pyspark.sql import functions as F

from nodeweft.llm import repetition, terms

NODES = "id string, kind string, name string, docstring string, indexed_at int, extra string"


def words(text):
    broken = re.sub(r"([a-z])(?=[A-Z])", r"\1 ", text or "")
    return [w for w in re.findall(r"[^\W\d_]+", broken.lower()) if len(w) >= 3]


def test_words(spark):
    df = spark.createDataFrame([("getURLFromID über_naïve x2yz Ab",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(terms.words(F.col("t"))).collect()]
    assert got == [words("getURLFromID über_naïve x2yz Ab"), [], []]


def brute(records, prior=500.0):
    counts = {k: collections.Counter(words(t)) for k, t in records.items()}
    cf, df = collections.Counter(), collections.Counter()
    for c in counts.values():
        cf.update(c)
        df.update(c.keys())
    total = sum(cf.values())
    out = {}
    for k, c in counts.items():
        n = sum(c.values())
        for w, y in c.items():
            a, rest = prior * cf[w] / total, cf[w] - y
            delta = math.log((y + a) / (n + prior - y - a)) - math.log((rest + a) / (total - n + prior - rest - a))
            out[k, w] = (y, df[w], delta / math.sqrt(1 / (y + a) + 1 / (rest + a)))
    return out


def test_scores_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{chr(97 + i // 6)}{chr(97 + i % 6)}x" for i in range(30)]
    records = {f"n{i}": " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25))) for i in range(40)} | {"hot": "alpha " * 500, "none": None}
    df = spark.createDataFrame(list(records.items()), "node string, text string")
    got = {(r["node"], r["term"]): (r["tf"], r["df"], r["z"]) for r in terms.distinctive_terms(terms.term_counts(df, "node", F.col("text")), "node").collect()}
    want = brute(records)
    assert got.keys() == want.keys()
    assert all(g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-9 for g, w in ((got[k], want[k]) for k in want))


def test_common_terms_count_little(spark):
    records = [(f"n{i}", "common rareone rareone" if i < 2 else "common other words here") for i in range(200)]
    scored = terms.distinctive_terms(terms.term_counts(spark.createDataFrame(records, "node string, text string"), "node", F.col("text")), "node")
    z = {(r["node"], r["term"]): r["z"] for r in scored.collect()}
    assert z["n0", "rareone"] > 1 and abs(z["n0", "common"]) < 0.2


def test_found_uses_current_nodes(spark, rows):
    data = [
        ("a", "Function", "rebuildQuokka", "quokka", 2, "x"), ("a", "Function", "old", "zebra zebra", 1, "x"), ("a", "Function", "rebuildQuokka", "quokka", 2, "x"),
        ("b", "Class", "quokkaName", "the quokka quokka of quokka", 1, None), ("c", "Module", "quokka", "quokka quokka", 1, None), ("d", "Function", None, None, 1, None), (None, "Class", "x", "quokka quokka", 1, None), ("e", "Class", "x", "alone alone", None, None),
    ]
    df = spark.createDataFrame(data, NODES)
    assert rows(terms.marking_terms(df), "node_id", "term") == [("a", "quokka"), ("b", "quokka")]
    assert terms.marking_terms(df.limit(0)).count() == 0


def repeated(text, window=5):
    w = [x.lower() for x in re.findall(r"[^\W\d_]+", text or "")]
    seen, marked = set(), set()
    for i in range(len(w) - window + 1):
        g = tuple(w[i : i + window])
        if g in seen:
            marked.update(range(i, i + window))
        seen.add(g)
    return len(marked) / len(w) if w else 0.0


def test_repetition_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [None, "", "one two three four", "a a a a a", "a a a a a a", "Same Line, 12!\nsame line\nSAME line\nsame line", "Ärger über Öl " * 30, "x y z v w " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["repeated_words"] for r in repetition.repetition(df).collect()}
    assert all(abs(got[i] - repeated(t)) < 1e-12 for i, t in enumerate(texts))
    found = {r[0] for r in repetition.self_repeating(df).collect()}
    assert found == {i for i, t in enumerate(texts) if repeated(t) >= 0.5}


def test_measures_and_flags(spark):
    df = spark.createDataFrame([(1, "one\ntwo\none\n\none"), (2, "### *** the"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in repetition.repetition(df).collect()}
    assert got[1]["repeated_lines"] == 0.5 and got[1]["repeats_lines"] and got[1]["very_short"]
    assert got[2]["mostly_symbols"] and got[2]["stop_words"] == 1.0
    assert got[3]["words"] == 0 and got[3]["chars"] == 0 and not got[3]["repeats_itself"]
    assert repetition.repetition(df.limit(0)).count() == 0


def test_no_user_functions(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = repetition.self_repeating(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_a_collection_of_one_term(spark, rows):
    df = spark.createDataFrame([(i, "Class", "x", "quokka quokka", 1, None) for i in "ab"], NODES)
    assert rows(terms.marking_terms(df), "node_id", "term", "z") == [("a", "quokka", 0.0), ("b", "quokka", 0.0)]
