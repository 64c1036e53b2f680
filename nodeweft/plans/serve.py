"""A JSON API over HTTP for the index, the questions and the chats.

    GET  / (a page that draws the graph) /api/stats /api/graph?limit= /api/callers?name= /api/impact?name=&hops= /api/repos /api/chats?repo= /api/chat-messages?chat=
    POST /api/cypher /api/ask /api/summarize /api/switch-repo /api/index-repo /api/chats /api/chat-messages /api/chats/delete /api/chat-messages/delete

Requests are handled in threads of one driver: Spark sessions serve concurrent reads, and writers take a lock and publish a
new snapshot. Chats and the registry are parquet snapshots beside the index, found again by a file that names those that
hold, so they outlive the server. Answers hold every row; `limit` and `offset` give a page of them. The server binds to the
local host unless told otherwise.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeweft.functions.text import slug
from nodeweft.operators import chats, graph, traverse
from nodeweft.operators.rows import latest_rows
from nodeweft.session import read_text, release, remove, write_text

from . import ask, export

CHATS = "id string, repo_db_path string, title string, created_at double, updated_at double"
MESSAGES = "id long, chat_id string, seq long, question string, answer string, type string, detail string, image_data_url string, context_question string, created_at double"
REGISTRY = "name string, db_path string, source string, added_at double"


class Service:
    """The operations behind the API; `open_store` gives the tables of a repository's index, `index` makes one."""

    def __init__(self, spark: SparkSession, folder: str, open_store: Callable[[str], ask.Store], index: Callable[[str, str, list[dict] | None], dict] | None = None, model: Callable[[str, str], str] | None = None) -> None:
        self.spark, self.folder, self.open_store, self.index, self.model = spark, folder, open_store, index, model
        self.repo = ""
        self.lock = threading.Lock()
        self.old: list[str] = []
        self.tables = {"chats": spark.createDataFrame([], CHATS), "messages": spark.createDataFrame([], MESSAGES), "registry": spark.createDataFrame([], REGISTRY)}
        self.current = json.loads(read_text(f"{folder}/CURRENT") or "{}")
        for name, path in self.current.items():
            self.tables[name] = spark.read.schema(self.tables[name].schema).parquet(f"{folder}/{path}")

    def _keep(self, **tables: DataFrame) -> None:
        """Writes changed tables as new snapshots and then the file that names them: readers of the old ones aren't
        disturbed, and all changes of a call hold or none. Of superseded snapshots the last two are kept."""
        for name, df in tables.items():
            self.current[name] = f"{name}-{uuid.uuid4().hex}"
            df.coalesce(1).write.parquet(f"{self.folder}/{self.current[name]}")
        write_text(f"{self.folder}/CURRENT", json.dumps(self.current))
        for name in tables:
            self.tables[name] = self.spark.read.schema(self.tables[name].schema).parquet(f"{self.folder}/{self.current[name]}")
            self.old.append(self.current[name])
        while len(self.old) > 2 * len(self.tables) + len(tables):
            remove(f"{self.folder}/{self.old.pop(0)}") if self.old[0] not in self.current.values() else self.old.append(self.old.pop(0))

    def store(self) -> ask.Store:
        if not self.repo:
            raise ValueError("no repository is open")
        return self.open_store(self.repo)

    @staticmethod
    def rows(df: DataFrame, q: dict | None = None) -> list[dict]:
        """All rows, or the page of them that a request asks for."""
        q = q or {}
        df = df.offset(int(q["offset"])) if "offset" in q else df
        df = df.limit(int(q["limit"])) if "limit" in q else df
        return [r.asDict(recursive=True) for r in df.toLocalIterator()]

    def get(self, path: str, q: dict[str, str]) -> object:
        if path == "/api/repos":
            return self.rows(chats.registered(self.tables["registry"]).orderBy("name", "db_path"))
        if path == "/api/chats":
            return self.rows(chats.list_chats(self.tables["chats"], q.get("repo", self.repo)), q)
        if path == "/api/chat-messages":
            return self.rows(chats.chat_messages(self.tables["messages"], q["chat"]), q)
        s = self.store()
        if path == "/":
            return export.html_page(s.nodes, s.edges, int(q.get("limit", 500)))
        if path == "/api/stats":
            return self.rows(graph.node_stats(s.nodes).unionByName(graph.edge_stats(s.edges)))
        if path == "/api/graph":
            nodes, edges = graph.exported(s.nodes, s.edges, int(q.get("limit", 500)))
            return {"nodes": self.rows(nodes.select("id", "kind", "name", "file", "docstring")), "edges": self.rows(edges.select("src", "dst", "kind"))}
        if path == "/api/callers":
            return self.rows(graph.callers(s.nodes, s.edges, ask.resolve_name(s.nodes, q["name"]) or q["name"]).orderBy("file", "caller"), q)
        if path == "/api/impact":
            return self.rows(traverse.impact(s.nodes, s.edges, ask.resolve_name(s.nodes, q["name"]) or q["name"], int(q.get("hops", 3))).orderBy("file", "name"), q)
        raise KeyError(path)

    def post(self, path: str, body: dict) -> object:
        if path == "/api/cypher":
            return self.rows(self.store().patterns().run(body["query"], **body.get("params", {})), body)
        if path == "/api/ask":
            return {"type": "answer", "content": ask.answer(self.store(), body["question"], self.model), "detail": ""}
        if path == "/api/summarize":
            return {"type": "answer", "content": ask.summary(self.store()), "detail": ""}
        with self.lock:
            if path == "/api/switch-repo":
                self.repo = body["db_path"]
                return {"db_path": self.repo}
            if path == "/api/index-repo":
                if self.index is None:
                    raise ValueError("indexing is switched off")
                # An upload that names no place gets one beside the chats, by its name.
                place = body.get("db_path") or f"{self.folder}/uploads/{self.spark.range(1).select(slug(F.lit(body.get('name') or ''))).first()[0]}"
                counts = self.index(place, body.get("root", ""), body.get("files"))
                row = self.spark.createDataFrame([(body.get("name") or place, place, body.get("root") or "upload", time.time())], REGISTRY)
                self._keep(registry=latest_rows(self.tables["registry"].unionByName(row), ["db_path"], ["added_at"]).select(*self.tables["registry"].columns))
                self.repo = place
                return counts | {"db_path": place}
            c, m = self.tables["chats"], self.tables["messages"]
            if path == "/api/chats":
                key = uuid.uuid4().hex
                self._keep(chats=chats.create_chat(c, body.get("repo", self.repo), body.get("title", ""), time.time(), key))
                return {"id": key}
            if path == "/api/chat-messages":
                c, m = chats.add_message(c, m, body["chat"], body["question"], body["answer"], time.time(), body.get("type", "answer"), body.get("detail", ""), body.get("image_data_url"), body.get("title", ""), body.get("context_question"))
                self._keep(chats=c, messages=m)
                return {"ok": True}
            if path == "/api/chats/delete":
                c, m = chats.delete_chat(c, m, body["chat"])
                self._keep(chats=c, messages=m)
                return {"ok": True}
            if path == "/api/chat-messages/delete":
                self._keep(messages=chats.delete_message(m, body["chat"], int(body["seq"])))
                return {"ok": True}
        raise KeyError(path)


def server(service: Service, host: str = "127.0.0.1", port: int = 8765) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self, run: Callable[[], object]) -> None:
            try:
                status, out = 200, run()
            except KeyError as e:
                status, out = 404, {"error": f"not found: {e}"}
            except (ValueError, TypeError) as e:
                status, out = 400, {"error": str(e)}
            finally:
                release()
            page = isinstance(out, str)
            data = (out if page else json.dumps(out, ensure_ascii=False)).encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{'text/html' if page else 'application/json'}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            url = urlparse(self.path)
            self._answer(lambda: service.get(url.path, {k: v[-1] for k, v in parse_qs(url.query).items()}))

        def do_POST(self) -> None:  # noqa: N802
            length = int(self.headers.get("Content-Length") or 0)
            raw = self.rfile.read(length)
            self._answer(lambda: service.post(urlparse(self.path).path, json.loads(raw or b"{}")))

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
