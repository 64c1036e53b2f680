"""The queries over the smallest tables: against SQL where there is some, else against a plain way to the same rows."""

import ast
import collections
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from nodeweft.llm import doc_pairs, oracle, pair_defects, queries, tokens
from tests.llm.test_neighbours import brute as nearest
from tests.llm.test_pairs_chats import brute as whole_chats
from tests.oracle import DATA, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_every_query_is_checked():
    checked = {name[5:] for name in globals() if name.startswith("test_p")} | set(oracle.oracle_sql())
    assert set(queries.queries()) == checked


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, queries.queries()[name], oracle.oracle_sql()[name])


def table(name, *columns):
    return pq.read_table(f"{DATA}/{name}.parquet", columns=list(columns) or None).to_pylist()


def latest(rows, key):
    out = {}
    for r in rows:
        if r[key] is not None and (r[key] not in out or r["indexed_at"] > out[r[key]]["indexed_at"]):
            out[r[key]] = r
    return out


def run(spark, name):
    return [r.asDict(recursive=True) for r in queries.queries()[name](spark, DATA).collect()]


def test_p1_labels(spark):
    """Every current file has a label; what lies in a folder named for its contents has theirs, and a firm's own line or a
    misleading folder makes no case."""
    got = {r["file"]: r for r in run(spark, "p1_labels")}
    files = latest(table("files"), "file")
    assert got.keys() == files.keys()
    for file, r in got.items():
        folders = set(file.split("/")[:-1])
        own = "Internal use only" in (files[file]["content"] or "")[:200]
        if folders & {"vendored", "site-packages", "_vendor", "third_party", "thirdparty"} and not own:
            assert r["label"] == "vendored" and r["p_handwritten"] < 0.5
        if folders & {"generated", "autogen"} and not own:
            assert r["label"] == "generated" and r["p_handwritten"] < 0.5
        if "vendor_portal" in folders and not any(w in (files[file]["content"] or "")[:400].lower() for w in ("generated", "copied", "licen", "package", "edit")):
            assert r["label"] == "handwritten"


def test_p1_found(spark):
    labels = {r["file"]: r for r in run(spark, "p1_labels")}
    found = [r["file"] for r in run(spark, "p1_found")]
    assert sorted(found) == sorted(f for f, r in labels.items() if r["p_handwritten"] < 0.5) and all(labels[f]["label"] != "handwritten" for f in found)
    assert 0 < len(found) < len(labels) / 2


def test_p3_found(spark):
    rows = {(r["id"], *pair_defects.defects(r["question"], r["answer"], r["context_question"])[:1]) for r in table("messages")}
    assert sorted((r["id"], r["defect"]) for r in run(spark, "p3_found")) == sorted(r for r in rows if len(r) == 2)


def test_p3_defects(spark):
    rows = {(r["id"], d) for r in table("messages") for d in pair_defects.defects(r["question"], r["answer"], r["context_question"])}
    assert sorted((r["id"], r["defect"]) for r in run(spark, "p3_defects")) == sorted(rows)


def chats():
    rows = [tuple(r[c] for c in ("id", "chat_id", "seq", "question", "answer", "context_question", "created_at")) for r in table("messages")]
    return rows, whole_chats(rows, {r["id"] for r in table("chats")})


def test_p4_found(spark):
    assert sorted((r["chat_id"], r["ids"]) for r in run(spark, "p4_found")) == chats()[1]


def test_p4_turns(spark):
    rows, whole = chats()
    by_id = {r[0]: r for r in rows}
    want = []
    for chat, ids in whole:
        for i in map(int, ids.split(",")):
            _, _, seq, question, answer, context, at = by_id[i]
            want += [(chat, seq, 0, "user", question if pair_defects.visible(question) else context, at), (chat, seq, 1, "assistant", answer, at)]
    assert sorted((r["chat_id"], r["seq"], r["turn"], r["role"], r["text"], r["at"]) for r in run(spark, "p4_turns")) == sorted(want)


def test_p5_found(spark):
    usable = {}
    for i, r in latest(table("nodes", "id", "embedding", "indexed_at"), "id").items():
        x = np.array(r["embedding"] if r["embedding"] is not None else [], dtype=np.float64)
        if len(x) == 384 and np.isfinite(x).all() and x.any():
            usable[i] = x
    ids = sorted(usable)
    want, got = nearest(ids, np.stack([usable[i] for i in ids])), {(r["node_a"], r["node_b"]) for r in run(spark, "p5_found")}
    assert len(want) > 30 and len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def documented(file, content):
    """Functions of a Python file with documentation that says something, by Python's own parser."""

    def walk(node, scope):
        for child in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = [*scope, child.name]
                if not isinstance(child, ast.ClassDef):
                    yield child.lineno, ".".join(inner), child.name, ast.get_docstring(child) or ""
            yield from walk(child, inner)

    try:
        last = {q: (n, d) for _, q, n, d in sorted(walk(ast.parse(content), []))}
    except (SyntaxError, ValueError):
        return set()
    return {f"function::{file}::{q}" for q, (n, d) in last.items() if doc_pairs.says_something(d, n)}


def test_p6_found(spark):
    files = latest(table("files"), "file")
    want = set().union(*(documented(f, r["content"] or "") for f, r in files.items() if f.endswith(".py")))
    got = [r["node_id"] for r in run(spark, "p6_found")]
    assert len(got) == len(set(got)) and {i for i in got if ".py::" in i} == want and len(want) > 50
    # A documented PHP function has the end of its comment before it.
    for i in (i for i in got if ".php::" in i):
        _, file, name = i.split("::")
        assert "*/" in files[file]["content"] and f"function {name.split('.')[-1]}(" in files[file]["content"].replace("&", "")


def test_p6_pairs(spark):
    rows, known = run(spark, "p6_pairs"), {r["id"] for r in table("nodes", "id")}
    assert sorted(r["node_id"] for r in rows) == sorted(r["node_id"] for r in run(spark, "p6_found"))
    for r in rows:
        assert r["indexed"] == (r["node_id"] in known) and r["doc"].strip() and r["name"] in r["code"] and r["node_id"].startswith(f"function::{r['file']}::")


@pytest.fixture(scope="module")
def ids():
    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return {r["doc_id"]: t.encode(r["text"], add_special_tokens=False).ids if r["text"] else [] for r in table("documents", "doc_id", "text")}


def test_p7_ids(spark, ids):
    assert {r["doc_id"]: r["ids"] for r in run(spark, "p7_ids")} == ids


def test_p8_mixture(spark, ids):
    """Each document at floor(rate) or one more, every document of a source alike, no more than max_repeats."""
    source = {r["doc_id"]: (r["source"] or "").strip().lower() for r in table("documents", "doc_id", "source")}
    targets = {r["source"].strip().lower(): r for r in table("mix_targets")}
    copies = collections.defaultdict(list)
    for r in run(spark, "p8_mixture"):
        assert r["source"] == source[r["doc_id"]] and r["tokens"] == len(ids[r["doc_id"]]) > 0
        copies[r["doc_id"]].append(r["copy"])
    rates = {r["source"]: r["rate"] for r in run(spark, "p8_shares")}
    for doc, s in source.items():
        n = len(copies[doc])
        assert sorted(copies[doc]) == list(range(n))
        if s in targets and ids[doc]:
            assert int(rates[s]) <= n <= min(int(np.ceil(rates[s])), targets[s]["max_repeats"])
        else:
            assert n == 0


def test_p8_shares(spark, ids):
    """The largest size at which every source reaches its share, and what the mixture holds of each."""
    at_hand, used = collections.Counter(), collections.Counter()
    for r in table("documents", "doc_id", "source"):
        at_hand[(r["source"] or "").strip().lower()] += len(ids[r["doc_id"]])
    for r in run(spark, "p8_mixture"):
        used[r["source"]] += r["tokens"]
    targets = {r["source"].strip().lower(): r for r in table("mix_targets")}
    size = min(t["max_repeats"] * at_hand[s] / t["target_share"] for s, t in targets.items() if at_hand[s] and t["target_share"] > 0)
    report = {r["source"]: r for r in run(spark, "p8_shares")}
    assert report.keys() == targets.keys()
    for s, r in report.items():
        assert r["available_tokens"] == at_hand[s] and r["used_tokens"] == used[s]
        assert abs(r["rate"] - (targets[s]["target_share"] * size / at_hand[s] if at_hand[s] else 0)) < 1e-6
        assert abs(r["reached_share"] - used[s] / sum(used.values())) < 1e-9
        assert (r["status"] == "no documents") == (at_hand[s] == 0)


def test_p9_repetition(spark):
    """The share of repeated words by a plain count of windows, and the documents of p9_found by it."""
    import regex

    want = {}
    for r in table("documents", "doc_id", "text"):
        w = [x.lower() for x in regex.findall(r"\p{L}+", (r["text"] or "").lower())]
        seen, covered = set(), set()
        for i in range(len(w) - 4):
            if tuple(w[i : i + 5]) in seen:
                covered.update(range(i, i + 5))
            seen.add(tuple(w[i : i + 5]))
        want[r["doc_id"]] = len(covered) / len(w) if w else 0.0
    got = {r["doc_id"]: r["repeated_words"] for r in run(spark, "p9_repetition")}
    assert got.keys() == want.keys() and all(abs((got[d] or 0.0) - want[d]) < 1e-6 for d in want)
    assert sorted(r["doc_id"] for r in run(spark, "p9_found")) == sorted(d for d, share in want.items() if share >= 0.5 and share > 0)
