"""The graph as files for people: a vault of linked notes and a page with a drawing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeweft.functions.text import stripped
from nodeweft.operators import graph
from nodeweft.sources.tree import file_system


#: The sections of a note, by kind of edge and direction, in their order.
SECTIONS = (
    ("CONTAINS", "out", "Contains"),
    ("CONTAINS", "in", "Contained By"),
    ("IMPORTS", "out", "Imports"),
    ("IMPORTS", "in", "Imported By"),
    ("CALLS", "out", "Calls"),
    ("CALLS", "in", "Called By"),
    ("INHERITS", "out", "Inherits From"),
    ("INHERITS", "in", "Inherited By"),
)


def vault_notes(nodes: DataFrame, edges: DataFrame, tag: str = "nodeweft") -> DataFrame:
    """(title, body): a Markdown note for each node, with front matter and a section for each kind and direction of its
    edges. A note is one file by definition, so its links come together in one row."""
    headings = nodes.sparkSession.createDataFrame([(k, d, i, h) for i, (k, d, h) in enumerate(SECTIONS)], "kind string, direction string, place int, heading string")
    links = graph.vault_links(nodes, edges).join(F.broadcast(headings), ["kind", "direction"])
    listed = F.array_join(F.transform("titles", lambda t: F.concat(F.lit("- [["), t, F.lit("]]"))), "\n")
    section = F.concat(F.lit("\n\n## "), "heading", F.lit("\n"), listed)
    sections = links.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", section.alias("s")))).alias("ss"))
    file = F.replace(F.coalesce("file", F.lit("")), F.lit("\\"), F.lit("/"))
    matter = F.concat(F.lit("---\nkind: "), "kind", F.lit('\nfile: "'), file, F.lit(f'"\ntags: [{tag}, '), "kind", F.lit("]\n---\n\n# "), "name", F.lit("\n\n*"), "kind", F.lit("*"), F.when(file != "", F.concat(F.lit(" in `"), file, F.lit("`"))).otherwise(""))
    doc = stripped(F.coalesce("docstring", F.lit("")))
    body = F.concat(matter, F.when(doc != "", F.concat(F.lit("\n\n"), doc)).otherwise(""), F.coalesce(F.array_join("ss.s", ""), F.lit("")), F.lit("\n"))
    return graph.titled_nodes(nodes).join(sections, "id", "left").select("title", body.alias("body"))


def write_vault(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """The notes as files `{title}.md` in a folder or URI that every executor sees."""

    def write(rows) -> None:
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        for r in rows:
            with system.open_output_stream(f"{base}/{r['title']}.md") as f:
                f.write(r["body"].encode())

    vault_notes(nodes, edges).foreachPartition(write)


_PAGE = """<!doctype html><meta charset="utf-8"><title>graph</title>
<style>body{margin:0;font:13px sans-serif;overflow:hidden}canvas{display:block;cursor:grab}#bar{position:fixed;top:8px;left:8px;background:#ffffffdd;padding:6px}#about{white-space:pre-wrap;max-width:420px}</style>
<div id="bar"><input id="find" placeholder="find a name"> <span id="kinds"></span><div id="about"></div></div><canvas id="c"></canvas><script>
const g = @DATA@;
const canvas = document.getElementById("c"), pen = canvas.getContext("2d"), about = document.getElementById("about");
const colour = {Module: "#4878a8", Class: "#a86848", Function: "#58985a", External: "#888888"};
const hidden = new Set(), byId = new Map();
let view = {x: 0, y: 0, scale: 1}, held = null, from = null, heat = 1, chosen = null;
g.nodes.forEach((n, i) => { const r = 12 * Math.sqrt(i + 1), t = i * 2.4; byId.set(n.id, Object.assign(n, {x: r * Math.cos(t), y: r * Math.sin(t), vx: 0, vy: 0, degree: 0})); });
const links = g.edges.map(e => [byId.get(e.src), byId.get(e.dst), e.kind]).filter(l => l[0] && l[1]);
links.forEach(l => { l[0].degree++; l[1].degree++; });
const shown = n => !hidden.has(n.kind);
for (const kind of Object.keys(colour)) {
  const label = document.createElement("label"), box = document.createElement("input");
  box.type = "checkbox"; box.checked = true;
  box.onchange = () => { box.checked ? hidden.delete(kind) : hidden.add(kind); heat = 1; };
  label.append(box, kind); label.style.color = colour[kind]; document.getElementById("kinds").append(label);
}
function settle() {
  const nodes = g.nodes.filter(shown);
  for (let i = 0; i < nodes.length; i++) for (let j = i + 1; j < nodes.length; j++) {
    const a = nodes[i], b = nodes[j], dx = a.x - b.x || 0.1, dy = a.y - b.y || 0.1, push = 900 / (dx * dx + dy * dy + 20);
    a.vx += dx * push; a.vy += dy * push; b.vx -= dx * push; b.vy -= dy * push;
  }
  for (const [a, b] of links) if (shown(a) && shown(b)) {
    const dx = b.x - a.x, dy = b.y - a.y, far = Math.hypot(dx, dy) || 1, pull = (far - 70) * 0.03 / far;
    a.vx += dx * pull; a.vy += dy * pull; b.vx -= dx * pull; b.vy -= dy * pull;
  }
  for (const n of nodes) {
    n.vx = (n.vx - n.x * 0.004) * 0.7; n.vy = (n.vy - n.y * 0.004) * 0.7;
    if (n !== held) { n.x += Math.max(-30, Math.min(30, n.vx * heat)); n.y += Math.max(-30, Math.min(30, n.vy * heat)); }
  }
  heat *= 0.992;
}
function draw() {
  canvas.width = innerWidth; canvas.height = innerHeight;
  pen.setTransform(view.scale, 0, 0, view.scale, canvas.width / 2 + view.x, canvas.height / 2 + view.y);
  for (const [a, b] of links) if (shown(a) && shown(b)) {
    pen.strokeStyle = chosen && (a === chosen || b === chosen) ? "#d04040" : "#cccccc";
    pen.beginPath(); pen.moveTo(a.x, a.y); pen.lineTo(b.x, b.y); pen.stroke();
  }
  const wanted = document.getElementById("find").value.toLowerCase();
  for (const n of g.nodes) if (shown(n)) {
    const hit = wanted && n.name.toLowerCase().includes(wanted);
    pen.fillStyle = colour[n.kind] || "#000000"; pen.beginPath(); pen.arc(n.x, n.y, 3 + Math.sqrt(n.degree) + (hit ? 5 : 0), 0, 7); pen.fill();
    if (hit || n === chosen || view.scale > 0.7) pen.fillText(n.name, n.x + 6, n.y + 3);
  }
}
const place = e => ({x: (e.clientX - canvas.width / 2 - view.x) / view.scale, y: (e.clientY - canvas.height / 2 - view.y) / view.scale});
const at = p => g.nodes.find(n => shown(n) && Math.hypot(n.x - p.x, n.y - p.y) < 8);
canvas.onmousedown = e => { held = at(place(e)) || null; from = {x: e.clientX - view.x, y: e.clientY - view.y}; };
canvas.onmousemove = e => { if (!from) return; if (held) { Object.assign(held, place(e)); heat = Math.max(heat, 0.3); } else { view.x = e.clientX - from.x; view.y = e.clientY - from.y; } };
canvas.onmouseup = e => { const n = at(place(e)); if (n) { chosen = n; about.textContent = n.kind + " " + n.name + "\\n" + n.file; } held = from = null; };
canvas.onwheel = e => { e.preventDefault(); view.scale *= e.deltaY < 0 ? 1.1 : 0.9; };
(function frame() { if (heat > 0.02) settle(); draw(); requestAnimationFrame(frame); })();
</script>"""


def html_page(nodes: DataFrame, edges: DataFrame, limit: int = 500) -> str:
    """A page that draws the first `limit` nodes and the edges among them: forces lay them out, nodes can be moved, found and
    hidden by kind. A drawing is for people, so its size is the feature; names can't end its script."""
    kept, inner = graph.exported(nodes, edges, limit)
    data = {"nodes": [r.asDict() for r in kept.select("id", "kind", "name", "file").collect()], "edges": [r.asDict() for r in inner.select("src", "dst", "kind").collect()]}
    return _PAGE.replace("@DATA@", json.dumps(data, ensure_ascii=False).replace("</", "<\\/"))
