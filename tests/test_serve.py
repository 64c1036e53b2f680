import json
import threading
import urllib.error
import urllib.request

import pytest

from nodeweft import __main__ as cli
from nodeweft.plans import serve


@pytest.fixture(scope="module")
def api(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("api"))
    service = serve.Service(spark, f"{folder}/chats", lambda p: cli.Folder(spark, p).store(), lambda p, root, files: cli.index(spark, root, cli.Folder(spark, p), upload=files))
    http = serve.server(service, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def call(path, body=None):
        data = None if body is None else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{http.server_port}{path}", data)) as r:
                return json.load(r) if "json" in r.headers["Content-Type"] else r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code

    yield call, folder
    http.shutdown()


def test_index_and_questions(api):
    call, folder = api
    assert call("/api/stats") == 400
    files = [{"path": "a.py", "content": "def g():\n    f()\ndef f():\n    pass\n"}, {"path": "../evil.py", "content": "x"}]
    assert call("/api/index-repo", {"db_path": f"{folder}/one", "name": "one", "files": files}) == {"changed": 1, "skipped": [{"path": "../evil.py", "reason": "outside the upload"}], "db_path": f"{folder}/one"}
    assert call("/api/index-repo", {"db_path": f"{folder}/one", "name": "one", "files": files[:1]}) == {"unchanged": 1, "db_path": f"{folder}/one"}
    assert call("/api/index-repo", {"name": "my: repo", "files": files[:1]})["db_path"] == f"{folder}/chats/uploads/my_repo"
    assert call("/api/switch-repo", {"db_path": f"{folder}/one"}) == {"db_path": f"{folder}/one"}
    assert {r["kind"]: r["n"] for r in call("/api/stats")}["Function"] == 2
    assert [r["name"] for r in call("/api/repos")] == ["my: repo", "one"]
    assert call("/api/callers?name=f") == [{"caller": "g", "file": "a.py", "line": 1}]
    assert call("/api/impact?name=f&hops=2") == [{"name": "g", "file": "a.py"}]
    assert len(call("/api/graph?limit=2")["nodes"]) == 2
    assert call("/api/cypher", {"query": "MATCH (n:Function {name: $n}) RETURN n.file AS file", "params": {"n": "f"}}) == [{"file": "a.py"}]
    assert call("/api/cypher", {"query": "CREATE (n)"}) == 400
    assert len(call("/api/cypher", {"query": "MATCH (n) RETURN n.id AS id ORDER BY id", "limit": 2, "offset": 1})) == 2
    assert "Functions that reach f" in call("/api/ask", {"question": "what breaks if I change f?"})["content"]
    assert call("/api/summarize", {})["content"] == "## a.py/\n- a.py (a.py)"
    assert "Function `f`" in call("/api/ask", {"question": "unheard of"})["content"]
    assert "<canvas" in call("/")
    assert call("/api/nothing") == 404


def test_chats(api):
    call, folder = api
    key = call("/api/chats", {"repo": "r"})["id"]
    assert call("/api/chat-messages", {"chat": key, "question": "Who?", "answer": "f"}) == {"ok": True}
    assert call("/api/chat-messages", {"chat": "none", "question": "Who?", "answer": "f"}) == 400
    assert [c["title"] for c in call("/api/chats?repo=r")] == ["Who?"]
    assert [m["seq"] for m in call(f"/api/chat-messages?chat={key}")] == [0]
    assert call("/api/chat-messages/delete", {"chat": key, "seq": 0}) == {"ok": True}
    assert call("/api/chats/delete", {"chat": key}) == {"ok": True}
    assert call("/api/chats?repo=r") == []


def test_chats_outlive_the_server(spark, tmp_path):
    make = lambda: serve.Service(spark, str(tmp_path / "chats"), lambda p: None, lambda p, root, files: {"changed": 1})
    one = make()
    key = one.post("/api/chats", {"repo": "r"})["id"]
    for k in range(9):
        one.post("/api/chat-messages", {"chat": key, "question": f"Who {k}?", "answer": "f"})
    one.post("/api/index-repo", {"db_path": "r", "name": "n"})
    two = make()
    assert [c["title"] for c in two.get("/api/chats", {"repo": "r"})] == ["Who 0?"] and [r["name"] for r in two.get("/api/repos", {})] == ["n"]
    assert [m["seq"] for m in two.get("/api/chat-messages", {"chat": key})] == list(range(9)) == [m["seq"] for m in one.get("/api/chat-messages", {"chat": key})]
    assert [m["seq"] for m in two.get("/api/chat-messages", {"chat": key, "limit": "2", "offset": "3"})] == [3, 4]
    # Superseded snapshots don't pile up.
    assert len(list((tmp_path / "chats").iterdir())) < 16
