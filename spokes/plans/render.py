"""HTML view (O09-O11, O94): measures in Spark, a page of bounded size on the driver."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame

from spokes.operators import graph as G
from spokes.operators import triples as T
from spokes.operators.infer import saved_components
from spokes.sources.files import template

MOST_NODES, MOST_EDGES = 20_000, 100_000


def options(edge_smooth: str | bool = False) -> dict:
    """O11. ``edge_smooth`` is a kind of curve; true stands for one of them, false (or its name) for straight lines."""
    kind = {True: "continuous", False: ""}.get(edge_smooth, edge_smooth)
    smooth = {"type": kind} if kind and kind.lower() != "false" else False
    # The layout's constants.
    force = {"gravitationalConstant": -50, "centralGravity": 0.01, "springLength": 100, "springConstant": 0.08}
    physics = {"enabled": True, "solver": "forceAtlas2Based", "forceAtlas2Based": force, "stabilization": {"iterations": 200, "enabled": True}}
    return {
        "physics": physics,
        "edges": {"color": {"inherit": True}, "font": {"size": 11}, "smooth": smooth},
        "nodes": {"font": {"size": 14, "face": "Tahoma"}, "scaling": {"min": 10, "max": 50}},
        "interaction": {"hover": True, "navigationButtons": True, "keyboard": True, "tooltipDelay": 200},
        "layout": {"improvedLayout": True},
    }


def view(triples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, stats) as DataFrames."""
    components = saved_components(triples)
    nodes = G.node_view(triples, components)
    return nodes, T.display_edges(triples), G.stats(triples, nodes.select("community"))


def render(triples: DataFrame, path: str, edge_smooth: str | bool = False) -> dict:
    """Write the page and return the statistics; no triples give zeros and no page."""
    if triples.isEmpty():
        return {"nodes": 0, "edges": 0, "communities": 0}
    nodes, edges, stats = view(triples)
    rows, links = nodes.orderBy("node").limit(MOST_NODES + 1).collect(), edges.orderBy("src", "dst").limit(MOST_EDGES + 1).collect()
    if len(rows) > MOST_NODES or len(links) > MOST_EDGES:
        raise ValueError("too large for one page: use view() and write its tables")
    s = stats.first().asDict()
    shown = [{"id": r.node, "label": r.node, "title": r.title, "size": r.size, "color": r.color, "shape": "dot", "font": {"color": "black"}} for r in rows]
    lines = [{"from": r.src, "to": r.dst, "label": r.label, "title": r.label, "arrows": "to"} | ({"dashes": True, "color": "#555555"} if r.inferred else {}) for r in links]
    title = f"{s['nodes']} Nodes, {s['edges']} Relationships, {s['communities']} Communities"
    data = json.dumps({"nodes": shown, "edges": lines, "options": options(edge_smooth)}).replace("</", "<\\/")
    page = template()
    page = page.replace("__TITLE__", html.escape(title)).replace("__DATA__", data) if "__DATA__" in page else f"<title>{html.escape(title)}</title>{page}<script>const graph = {data}</script>"
    with open(path, "w", encoding="utf-8") as f:
        f.write(page)
    return s
