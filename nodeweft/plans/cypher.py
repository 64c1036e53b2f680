"""A graph pattern language as DataFrame plans.

    MATCH (a:Function)-[:CALLS*1..3]->(b {name: $name})
    WHERE a.file = 'x.py' RETURN DISTINCT a.name AS name, count(b) AS n ORDER BY n DESC LIMIT 10

One or more comma-separated paths of nodes and edges, labels, property maps, both directions, edge variables, bounded
lengths, conditions joined by AND / OR / NOT, aliases, DISTINCT, count(), ORDER BY, SKIP and LIMIT; CALL show_tables() and
CALL table_info('kind'). Beside the code graph's nodes and edges there are Concept, Route and Render nodes and RULE edges
(with effect, condition, lineno) where the index holds them. Writes are plans too: CREATE, MERGE .. SET, SET, DELETE and
DETACH DELETE give a new Graph (`write`). Anything else is refused with its place; relational work goes through `sql`, which
takes named parameters.

Conditions are split at their ANDs, and each part that reads one variable is applied to that variable's scan before any
join. A bounded length is walked from the end that is bound: an end is bound if its scan has a property or a condition of
its own, or if earlier parts of the pattern reached it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeweft.operators import traverse
from nodeweft.schema import EDGE_KINDS, NODE_KINDS

WEB_KINDS = ("Concept", "Route", "Render")

_TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+(?:\.\d+)?)|(?P<param>\$\w+)|(?P<word>`[^`]+`|[A-Za-z_]\w*)|(?P<op><-|->|<>|<=|>=|=~|\.\.|[-=<>(){}\[\]:,.*|;]))")
MOST_HOPS = 10


class CypherError(ValueError):
    """A query that the language doesn't cover, or one that isn't well formed."""


@dataclass
class _Node:
    var: str
    label: str | None
    props: dict[str, Column]


@dataclass
class _Edge:
    var: str | None
    kinds: list[str]
    forward: bool
    low: int = 1
    high: int = 1
    variable: bool = False


class _Parser:
    def __init__(self, text: str, params: dict) -> None:
        self.items: list[tuple[str, str]] = []
        at = 0
        text = text.strip().rstrip(";")
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                if not text[at:].strip():
                    break
                raise CypherError(f"unexpected character at {at}: {text[at : at + 10]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.params, self.fresh = 0, params, 0
        self.read: set[str] = set()

    def peek(self, ahead: int = 0) -> str:
        return self.items[self.at + ahead][1] if self.at + ahead < len(self.items) else ""

    def kind(self) -> str:
        return self.items[self.at][0] if self.at < len(self.items) else ""

    def next(self) -> str:
        if self.at >= len(self.items):
            raise CypherError("the query ends too early")
        self.at += 1
        return self.items[self.at - 1][1]

    def keyword(self, *words: str) -> bool:
        """Takes the words if they stand here."""
        if all(self.peek(k).upper() == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def expect(self, text: str) -> None:
        got = self.next()
        if got.upper() != text:
            raise CypherError(f"expected {text}, found {got!r}")

    def name(self) -> str:
        if self.kind() != "word":
            raise CypherError(f"expected a name, found {self.peek()!r}")
        return self.next().strip("`")

    def literal(self) -> Column | None:
        kind = self.kind()
        if kind == "string":
            return F.lit(re.sub(r"\\(.)", r"\1", self.next()[1:-1]))
        if kind == "number":
            v = self.next()
            return F.lit(float(v) if "." in v else int(v))
        if kind == "param":
            key = self.next()[1:]
            if key not in self.params:
                raise CypherError(f"no value for ${key}")
            return F.lit(self.params[key])
        if kind == "word" and self.peek().lower() in ("true", "false", "null"):
            return F.lit({"true": True, "false": False, "null": None}[self.next().lower()])
        return None

    def props(self) -> dict[str, Column]:
        out: dict[str, Column] = {}
        if self.peek() == "{":
            self.next()
            while self.peek() != "}":
                key = self.name()
                self.expect(":")
                value = self.literal()
                if value is None:
                    raise CypherError(f"expected a value for {key}")
                out[key] = value
                if self.peek() == ",":
                    self.next()
            self.next()
        return out

    def node(self) -> _Node:
        self.expect("(")
        var = self.name() if self.kind() == "word" else ""
        label = None
        if self.peek() == ":":
            self.next()
            label = self.name()
        props = self.props()
        self.expect(")")
        self.fresh += 1
        return _Node(var or f"_{self.fresh}", label, props)

    def edge(self) -> _Edge:
        backward = self.peek() == "<-"
        if self.next() not in ("<-", "-"):
            raise CypherError(f"expected an edge, found {self.peek(-1)!r}")
        e = _Edge(None, [], not backward)
        if self.peek() == "[":
            self.next()
            if self.kind() == "word":
                e.var = self.name()
            if self.peek() == ":":
                self.next()
                e.kinds.append(self.name())
                while self.peek() == "|":
                    self.next()
                    if self.peek() == ":":
                        self.next()
                    e.kinds.append(self.name())
            if self.peek() == "*":
                self.next()
                e.variable = True
                e.low = int(self.next()) if self.kind() == "number" else 1
                e.high = e.low if self.peek() != ".." else MOST_HOPS
                if self.peek() == "..":
                    self.next()
                    e.high = int(self.next()) if self.kind() == "number" else MOST_HOPS
                elif self.peek() == "]" and self.items[self.at - 1][1] == "*":
                    e.high = MOST_HOPS
                if not 1 <= e.low <= e.high <= MOST_HOPS:
                    raise CypherError(f"a length must lie within 1..{MOST_HOPS}")
            self.expect("]")
        end = self.next()
        if end not in ("-", "->") or backward and end == "->":
            raise CypherError(f"expected the end of an edge, found {end!r}")
        if not backward and end == "-":
            raise CypherError("an edge needs a direction")
        return e

    def path(self) -> tuple[list[_Node], list[_Edge]]:
        nodes, edges = [self.node()], []
        while self.peek() in ("-", "<-"):
            edges.append(self.edge())
            nodes.append(self.node())
        return nodes, edges

    def value(self) -> Column:
        got = self.literal()
        if got is not None:
            return got
        var = self.name()
        self.read.add(var)
        if self.peek() == "." and self.kind() == "op":
            self.next()
            return F.col(f"`{var}.{self.name()}`")
        return F.col(f"`{var}`")

    def conjuncts(self) -> list[tuple[set[str], Column]]:
        """The parts of a condition that ANDs join at the top, each with the variables it reads."""
        start, parts = self.at, []
        while True:
            self.read = set()
            part = self._not()
            parts.append((self.read, part))
            if not self.keyword("AND"):
                break
        if self.peek().upper() == "OR":
            # AND binds closer, so nothing can be split off.
            self.at, self.read = start, set()
            whole = self.condition()
            return [(self.read, whole)]
        return parts

    def condition(self) -> Column:
        out = self._and()
        while self.keyword("OR"):
            out = out | self._and()
        return out

    def _and(self) -> Column:
        out = self._not()
        while self.keyword("AND"):
            out = out & self._not()
        return out

    def _not(self) -> Column:
        if self.keyword("NOT"):
            return ~self._not()
        if self.peek() == "(":
            self.next()
            out = self.condition()
            self.expect(")")
            return out
        left = self.value()
        if self.keyword("IS", "NOT", "NULL"):
            return left.isNotNull()
        if self.keyword("IS", "NULL"):
            return left.isNull()
        if self.keyword("CONTAINS"):
            return F.contains(left, self.value())
        if self.keyword("STARTS", "WITH"):
            return F.startswith(left, self.value())
        if self.keyword("ENDS", "WITH"):
            return F.endswith(left, self.value())
        op = self.next()
        right = self.value()
        ops = {"=": left == right, "<>": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}
        if op == "=~":
            return F.rlike(left, F.concat(F.lit("^(?:"), right, F.lit(")$")))
        if op not in ops:
            raise CypherError(f"unknown comparison {op!r}")
        return ops[op]


class Graph:
    """Nodes and edges with the pattern language and SQL over them."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, concepts: DataFrame | None = None, rules: DataFrame | None = None, routes: DataFrame | None = None, renders: DataFrame | None = None) -> None:
        self.nodes, self.edges = nodes, edges
        self.others = {k: df for k, df in zip(WEB_KINDS, (concepts, routes, renders), strict=True) if df is not None}
        self.rules = rules

    def sql(self, text: str, **params) -> DataFrame:
        """SQL over the views nodes and edges and one view per kind of each, with named parameters (:name)."""
        self.nodes.createOrReplaceTempView("nodes")
        self.edges.createOrReplaceTempView("edges")
        for kind in NODE_KINDS:
            self.nodes.where(F.col("kind") == kind).createOrReplaceTempView(kind.lower())
        for kind in EDGE_KINDS:
            self.edges.where(F.col("kind") == kind).createOrReplaceTempView(kind.lower())
        for kind, df in self.others.items():
            df.createOrReplaceTempView(kind.lower())
        if self.rules is not None:
            self.rules.createOrReplaceTempView("rule")
        return self.nodes.sparkSession.sql(text, args=params or None)

    def _scan(self, n: _Node, conditions: list[tuple[set[str], Column]] = ()) -> DataFrame:
        df = self.others[n.label] if n.label in self.others else self.nodes
        if n.label in WEB_KINDS and n.label not in self.others:
            raise CypherError(f"there is no {n.label} table")
        if n.label and n.label not in self.others:
            df = df.where(F.col("kind") == n.label)
        for key, value in n.props.items():
            if key not in df.columns:
                raise CypherError(f"{n.label or 'a node'} has no {key}")
            df = df.where(F.col(key) == value)
        df = df.select(*[F.col(c).alias(f"{n.var}.{c}") for c in df.columns])
        for read, part in conditions:
            if read == {n.var}:
                df = df.where(part)
        return df

    def _links(self, e: _Edge) -> DataFrame:
        """(src, dst, kind and the like) of the kinds that an edge asks for."""
        unknown = [k for k in e.kinds if k not in EDGE_KINDS and (k != "RULE" or self.rules is None)]
        if unknown:
            raise CypherError(f"unknown edge kind {unknown[0]}")
        plain = [k for k in e.kinds if k != "RULE"]
        edges = self.edges.where(F.col("kind").isin(*plain)) if e.kinds else self.edges
        if "RULE" in e.kinds:
            rules = self.rules.select(F.col("concept_id").alias("src"), F.col("target_id").alias("dst"), F.lit("RULE").alias("kind"), "effect", "condition", "lineno")
            edges = rules if not plain else edges.unionByName(rules, allowMissingColumns=True)
        return edges

    def _hop(self, left: DataFrame, a: _Node, e: _Edge, b: _Node, seen: set[str], conditions: list[tuple[set[str], Column]]) -> DataFrame:
        edges = self._links(e)
        start, end = ("src", "dst") if e.forward else ("dst", "src")
        target = None if b.var in seen else self._scan(b, conditions)
        if e.variable:
            if e.low != 1:
                raise CypherError("a length must begin at 1")
            directed = edges.select(F.col(start).alias("src"), F.col(end).alias("dst"))
            ends = left.select(F.col(f"`{a.var}.id`").alias("id")).distinct()
            steps = _pairs(ends, directed, e.high)
        else:
            extra = [F.col(c).alias(f"{e.var}.{c}") for c in edges.columns if c not in ("src", "dst")] if e.var else []
            steps = edges.select(F.col(start).alias("_from"), F.col(end).alias("_to"), *extra)
        joined = left.join(steps, left[f"`{a.var}.id`"] == steps["_from"])
        if target is None:
            return joined.where(F.col("_to") == F.col(f"`{b.var}.id`")).drop("_from", "_to")
        return joined.join(target, joined["_to"] == target[f"`{b.var}.id`"]).drop("_from", "_to")

    def _match(self, p: _Parser) -> DataFrame:
        df: DataFrame | None = None
        seen: set[str] = set()
        wants: list[tuple[list[_Node], list[_Edge]]] = [p.path()]
        while p.peek() == ",":
            p.next()
            wants.append(p.path())
        conditions = p.conjuncts() if p.keyword("WHERE") else []
        bound = {v for read, _ in conditions if len(read) == 1 for v in read}

        def turned(nodes: list[_Node], edges: list[_Edge]) -> tuple[list[_Node], list[_Edge]]:
            return nodes[::-1], [_Edge(e.var, e.kinds, not e.forward, e.low, e.high, e.variable) for e in edges[::-1]]

        for nodes, edges in wants:
            if df is None:
                # The pattern is followed from its narrower end.
                narrow = [bool(n.props) or n.var in bound for n in (nodes[0], nodes[-1])]
                if narrow == [False, True]:
                    nodes, edges = turned(nodes, edges)
                df = self._scan(nodes[0], conditions)
            elif nodes[0].var not in seen:
                if not any(n.var in seen for n in nodes):
                    raise CypherError("paths must share a node; use sql for anything else")
                nodes, edges = turned(nodes, edges)
                if nodes[0].var not in seen:
                    raise CypherError("a further path must begin or end with a node that is already bound")
            seen.add(nodes[0].var)
            for a, e, b in zip(nodes, edges, nodes[1:], strict=False):
                df = self._hop(df, a, e, b, seen, conditions)
                seen.add(b.var)
        for read, part in conditions:
            # What reads one node has been applied to its scan.
            if len(read) != 1 or not read <= {n.var for nodes, _ in wants for n in nodes}:
                df = df.where(part)
        return df

    def run(self, text: str, **params) -> DataFrame:
        """The rows of a query; for DETACH DELETE the ids of the nodes to delete (see `delete`)."""
        p = _Parser(text, params)
        if p.keyword("CALL"):
            return self._call(p)
        p.expect("MATCH")
        df = self._match(p)
        if p.keyword("DETACH", "DELETE"):
            return df.select(F.col(f"`{p.name()}.id`").alias("id")).distinct()
        p.expect("RETURN")
        distinct = p.keyword("DISTINCT")
        plain: list[tuple[str, Column]] = []
        counts: list[tuple[str, Column]] = []
        order: list[str] = []
        while True:
            if p.peek().lower() == "count" and p.peek(1) == "(":
                p.next(), p.next()
                one = p.keyword("DISTINCT")
                what = "*" if p.peek() == "*" and p.next() else p.name()
                if p.peek() == ".":
                    p.next()
                    what = f"{what}.{p.name()}"
                elif what != "*":
                    what = f"{what}.id" if f"{what}.id" in df.columns else f"{what}.kind"
                p.expect(")")
                label = p.name() if p.keyword("AS") else f"count({what})"
                c = F.count_distinct(F.col(f"`{what}`")) if one else F.count("*" if what == "*" else F.col(f"`{what}`"))
                counts.append((label, c))
            else:
                start = p.at
                value = p.value()
                label = p.name() if p.keyword("AS") else "".join(t for _, t in p.items[start : p.at])
                plain.append((label, value))
            order.append(label)
            if p.peek() != ",":
                break
            p.next()
        if counts:
            named = df.select(*[v.alias(n) for n, v in plain], *[F.col(f"`{c}`") for c in df.columns]) if plain else df
            out = named.groupBy(*[F.col(f"`{n}`") for n, _ in plain]).agg(*[c.alias(n) for n, c in counts])
            out = out.select(*[F.col(f"`{n}`") for n in order])
        else:
            out = df.select(*[v.alias(n) for n, v in plain])
        if distinct:
            out = out.distinct()
        if p.keyword("ORDER", "BY"):
            keys = []
            while True:
                start = p.at
                p.value()
                label = "".join(t for _, t in p.items[start : p.at])
                if label not in out.columns:
                    alias = next((n for n, v in plain if str(v) == str(F.col(f"`{label}`"))), None)
                    if alias is None:
                        raise CypherError(f"ORDER BY needs a returned column, found {label}")
                    label = alias
                key = F.col(f"`{label}`")
                keys.append(key.desc() if p.keyword("DESC") or p.keyword("DESCENDING") else key.asc())
                p.keyword("ASC")
                if p.peek() != ",":
                    break
                p.next()
            out = out.orderBy(*keys)
        if p.keyword("SKIP"):
            out = out.offset(int(p.next()))
        if p.keyword("LIMIT"):
            out = out.limit(int(p.next()))
        if p.at < len(p.items):
            raise CypherError(f"unexpected {p.peek()!r}")
        return out

    def _with(self, nodes: DataFrame, edges: DataFrame) -> "Graph":
        return Graph(nodes, edges, self.others.get("Concept"), self.rules, self.others.get("Route"), self.others.get("Render"))

    def delete(self, text: str, **params) -> "Graph":
        """The graph without the nodes that a DETACH DELETE names and without their edges."""
        gone = self.run(text, **params)
        nodes = self.nodes.join(gone, "id", "left_anti").select(*self.nodes.columns)
        edges = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return self._with(nodes, edges.select(*self.edges.columns))

    def write(self, text: str, **params) -> "Graph":
        """The graph after a write to nodes and edges:

        CREATE (:Kind {id: ..}), MERGE (n:Kind {id: ..}) SET n.x = .., MATCH .. SET n.x = .., MATCH .. DELETE e,
        MATCH .. DETACH DELETE n, MATCH .. MERGE (a)-[:KIND]->(b), MATCH .. CREATE (a)-[:KIND]->(b).
        A created id that exists is an error; MERGE takes the node that is there. A column that is set must exist.
        """
        p = _Parser(text, params)
        if p.keyword("CREATE"):
            n = p.node()
            new = self._new(n)
            if self.nodes.join(new.select("id"), "id", "left_semi").take(1):
                raise CypherError("a node of this id exists")
            return self._with(self.nodes.unionByName(new, allowMissingColumns=True), self.edges)
        if p.keyword("MERGE"):
            n = p.node()
            new = self._new(n).join(self.nodes.select("id"), "id", "left_anti")
            merged = self.nodes.unionByName(new, allowMissingColumns=True)
            here = (F.col("kind") == n.label) & (F.col("id") == n.props["id"])
            return self._with(self._set(p, n.var, merged, here), self.edges) if p.keyword("SET") else self._with(merged, self.edges)
        p.expect("MATCH")
        df = self._match(p)
        if p.keyword("DETACH", "DELETE"):
            return self.delete(text, **params)
        if p.keyword("SET"):
            var = p.peek()
            ids = df.select(F.col(f"`{var}.id`").alias("id")).distinct().withColumn("_hit", F.lit(True))
            marked = self.nodes.join(ids, "id", "left")
            return self._with(self._set(p, var, marked, F.coalesce("_hit", F.lit(False))).select(*self.nodes.columns), self.edges)
        if p.keyword("DELETE"):
            raise CypherError("edges are deleted with their nodes; use DETACH DELETE")
        if p.keyword("MERGE") or p.keyword("CREATE"):
            nodes, edges = p.path()
            if len(edges) != 1 or len(edges[0].kinds) != 1 or edges[0].variable or edges[0].kinds[0] not in EDGE_KINDS:
                raise CypherError("one edge of one kind can be merged")
            a, b = nodes if edges[0].forward else nodes[::-1]
            new = df.select(F.col(f"`{a.var}.id`").alias("src"), F.col(f"`{b.var}.id`").alias("dst"), F.lit(edges[0].kinds[0]).alias("kind"))
            return self._with(self.nodes, self.edges.select("src", "dst", "kind").unionByName(new).distinct())
        raise CypherError(f"expected SET, MERGE, CREATE or DETACH DELETE, found {p.peek()!r}")

    def _new(self, n: _Node) -> DataFrame:
        if n.label not in NODE_KINDS or "id" not in n.props:
            raise CypherError("a new node needs a kind and an id")
        types = dict(self.nodes.dtypes)
        unknown = [k for k in n.props if k not in types]
        if unknown:
            raise CypherError(f"{n.label} has no {unknown[0]}")
        given = n.props | {"kind": F.lit(n.label)}
        return self.nodes.sparkSession.range(1).select(*[given.get(c, F.lit(None)).cast(types[c]).alias(c) for c in self.nodes.columns])

    def _set(self, p: _Parser, var: str, nodes: DataFrame, here: Column) -> DataFrame:
        """`nodes` with the assignments at the parser's place made where `here` holds."""
        while True:
            if p.name() != var:
                raise CypherError(f"only {var} can be set here")
            p.expect(".")
            key = p.name()
            p.expect("=")
            value = p.literal()
            if key not in self.nodes.columns or key in ("id", "kind") or value is None:
                raise CypherError(f"{key} can't be set")
            nodes = nodes.withColumn(key, F.when(here, value.cast(dict(self.nodes.dtypes)[key])).otherwise(F.col(key)))
            if p.peek() != ",":
                return nodes
            p.next()

    def _call(self, p: _Parser) -> DataFrame:
        spark, what = self.nodes.sparkSession, p.name().lower()
        p.expect("(")
        if what == "show_tables":
            rels = (*EDGE_KINDS, *(("RULE",) if self.rules is not None else ()))
            return spark.createDataFrame([(k, "NODE") for k in (*NODE_KINDS, *self.others)] + [(k, "REL") for k in rels], "name string, type string")
        if what == "table_info":
            kind = p.next().strip("'\"")
            known = self.others | {k: self.nodes for k in NODE_KINDS} | {k: self.edges for k in EDGE_KINDS} | ({"RULE": self.rules} if self.rules is not None else {})
            if kind not in known:
                raise CypherError(f"there is no {kind} table")
            fields = known[kind].schema.fields
            return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)], "property_id int, name string, type string")
        raise CypherError(f"unknown procedure {what}")


def _pairs(starts: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(_from, _to): what each start reaches in 1..hops steps, by a frontier of pairs."""
    from nodeweft.session import stage

    current = starts.select(F.col("id").alias("_from"), F.col("id").alias("_to"))
    found: DataFrame | None = None
    for depth in range(1, traverse.clamp_hops(hops) + 1):
        grown = current.join(edges, current["_to"] == edges["src"]).select("_from", F.col("dst").alias("_to")).distinct()
        if found is not None:
            grown = grown.join(found, ["_from", "_to"], "left_anti")
        grown = stage(grown, f"pairs-{depth}")
        found = grown if found is None else found.unionByName(grown)
        current = grown
        if depth < hops and not grown.take(1):
            break
    return found
