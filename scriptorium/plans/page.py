"""A whole canvas as one page of HTML, built from ordered fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions import text as T
from scriptorium.operators import canvas as C, markup as M

STYLE = "* { box-sizing: border-box } body { margin: 0; background: var(--bg); color: var(--text) } #world { position: relative } .node, .group { position: absolute; border: 2px solid var(--nc, var(--border)); border-radius: 8px; background: var(--card) } .group { background-color: transparent } #edges { position: absolute; left: 0; top: 0 } .edge-label, .file-title { position: absolute }"
# Where maths and diagrams are drawn from.
KATEX = "https://cdn.jsdelivr.net/npm/katex@0.16.11/dist/"
MERMAID = "https://cdn.jsdelivr.net/npm/mermaid@11.4.1/dist/mermaid.min.js"


def _number(value: Column) -> Column:
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def node_markup(nodes: DataFrame, ox: Column, oy: Column, theme: str = "light", root: str = "") -> DataFrame:
    """Nodes with their fragment as ``html``; ``resolved`` is the path of a file node's file and ``body`` its note or text as HTML."""
    x, y = F.col("x") - ox, F.col("y") - oy
    coloured = F.coalesce(F.col("color"), F.lit("")) != ""
    style = F.concat(F.lit("left:"), _number(x), F.lit("px;top:"), _number(y), F.lit("px;width:"), _number(F.col("width")), F.lit("px;height:"), _number(F.col("height")), F.lit("px;"), F.when(coloured, F.concat(F.lit("--nc:"), C.colour_of(F.col("color"), C.THEMES[theme]["border"]), F.lit(";"))).otherwise(""))
    extra = F.when(coloured, " coloured").otherwise("")
    kind = C.node_kind(F.col("type"), F.col("file"), F.col("resolved"))
    file, url, label = (T.escape_html(F.coalesce(F.col(c), F.lit(""))) for c in ("file", "url", "label"))

    def box(more: str, inner: Column | str) -> Column:
        return F.concat(F.lit('<div class="node'), extra, F.lit(f'{more}" style="'), style, F.lit('">'), inner if isinstance(inner, Column) else F.lit(inner), F.lit("</div>"))

    stem = T.escape_html(F.regexp_replace(T.file_name(F.col("file")), r"(?<=.)\.[^.]+\z", ""))
    title = F.concat(F.lit('<div class="file-title" style="left:'), _number(x), F.lit("px;top:"), _number(y - 26), F.lit("px;max-width:"), _number(F.col("width")), F.lit('px">'), stem, F.lit("</div>"))
    body = F.concat(F.lit('<div class="content md">'), F.coalesce("body", F.lit("")), F.lit("</div>"))
    place = M.address(F.col("resolved"), root) if root else F.col("resolved")
    card = lambda icon, text: F.concat(F.lit('<div class="content"><div class="link-icon">'), icon, F.lit('</div><div class="link-url">'), text, F.lit("</div></div>"))
    suffix = F.upper(F.regexp_extract(F.coalesce(F.col("resolved"), F.lit("")), r"\.([^./]+)\z", 1))
    named = F.when(kind == "canvas", "Canvas").when(kind == "pdf", "PDF").otherwise(F.coalesce(F.nullif(suffix, F.lit("")), F.lit("File")))
    size = F.when(F.col("backgroundStyle") == "ratio", "contain").when(F.col("backgroundStyle") == "repeat", "auto").otherwise("cover")
    repeat = F.when(F.col("backgroundStyle") == "repeat", "repeat").otherwise("no-repeat")
    background = F.when(F.col("resolved").isNotNull(), F.concat(F.lit('background-image:url("'), place, F.lit('");background-size:'), size, F.lit(";background-repeat:"), repeat, F.lit(";"))).otherwise("")
    group = F.concat(F.lit('<div class="group'), extra, F.lit('" style="'), style, background, F.lit('">'), F.when(label != "", F.concat(F.lit('<div class="group-label">'), label, F.lit("</div>"))).otherwise(""), F.lit("</div>"))
    html = (
        F.when(kind == "group", group)
        .when(kind == "text", box("", body))
        .when(kind == "link", box(" link-node", card(F.lit("🔗"), url)))
        .when(kind == "missing", box("", F.concat(F.lit('<div class="content md"><p class="unresolved">Missing file: '), file, F.lit("</p></div>"))))
        .when(kind == "image", box(" image-node", F.concat(F.lit('<img src="'), T.escape_html(place), F.lit('" alt="">'))))
        .when(kind == "note", F.concat(title, box("", body)))
        .when(kind.isin("canvas", "pdf", "file"), box(" link-node", card(F.concat(F.lit("📄 "), named), file)))
        .otherwise(box("", ""))
    )
    return nodes.withColumns({"kind": kind, "html": html})


def html_page(nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None, theme: str = "light", padding: int = C.PADDING, dots: bool = False, allow_remote: bool = True, renderer: Callable[[str], str] | None = None, root: str = "") -> DataFrame:
    """One row (html, width, height) of a canvas; no row for a canvas without nodes.

    A page is one value, so its fragments meet in one task by nature: the size of a page is the bound. ``files`` has
    (path, walk_ord, text) of the vault; with a ``root``, its images are written as addresses below it.
    """
    spark = nodes.sparkSession
    if files is None:
        files = spark.createDataFrame([], "path string, walk_ord bigint, text string")
    box = C.bounding_box(nodes, padding).select(F.struct("x0", "y0", "x1", "y1", "width", "height").alias("box"))
    wanted = nodes.withColumn("target", F.when(F.coalesce(F.col("type") == "group", F.lit(False)), F.col("background")).otherwise(F.col("file")))
    links = C.resolve_links(wanted.where("target IS NOT NULL").select("target"), files.select("path", "walk_ord"))
    placed = wanted.join(links.withColumnRenamed("path", "resolved"), "target", "left").join(files.select(F.col("path").alias("resolved"), F.col("text").alias("note")), "resolved", "left")
    ox, oy = F.col("box.x0") - padding, F.col("box.y0") - padding
    of_text = F.coalesce("type", F.lit("text")) == "text"
    notes = placed.where(of_text | F.col("note").isNotNull()).select(F.col("ord").cast("string").alias("id"), F.when(~of_text, F.col("resolved")).alias("base"), F.when(of_text, F.col("text")).otherwise(M.subpath(F.coalesce("note", F.lit("")), F.col("subpath"))).alias("text"))
    placed = placed.join(M.render_notes(notes, files, renderer, root).withColumnRenamed("id", "ord_id"), F.col("ord").cast("string") == F.col("ord_id"), "left").drop("ord_id")
    drawn = node_markup(placed.crossJoin(box), ox, oy, theme, root)  # the box is one row
    group = F.coalesce(F.col("type") == "group", F.lit(False))
    order = F.struct(F.when(group, -F.col("width") * F.col("height")).otherwise(F.lit(0.0)).alias("area"), "ord", "html")

    def join(c: Column, field: str = "html") -> Column:
        return F.array_join(F.transform(F.array_sort(c), lambda s: s[field]), "")

    fragments = drawn.agg(join(F.collect_list(F.when(group, order))).alias("groups"), join(F.collect_list(F.when(~group, order))).alias("cards"), F.bool_or(F.contains("html", F.lit('class="math"'))).alias("math"), F.bool_or(F.contains("html", F.lit('class="mermaid"'))).alias("mermaid"))
    geometry = C.edge_geometry(C.joined_edges(nodes, edges).crossJoin(box), ox, oy, theme)
    lines = C.edge_markup(geometry).agg(*(join(F.collect_list(F.struct("ord", c)), c).alias(a) for c, a in (("path", "paths"), ("label", "labels"))))
    whole = box.crossJoin(fragments).crossJoin(lines)  # one row each
    head = F.concat(F.lit(f"<style>:root{{{''.join(f'--{k}:{v};' for k, v in C.THEMES[theme].items())}}}{STYLE}</style>"), F.when(F.lit(allow_remote) & F.col("math"), f'<link rel="stylesheet" href="{KATEX}katex.min.css">').otherwise(""))
    scripts = F.concat(F.when(F.lit(allow_remote) & F.col("math"), f'<script src="{KATEX}katex.min.js"></script>').otherwise(""), F.when(F.lit(allow_remote) & F.col("mermaid"), f'<script src="{MERMAID}"></script>').otherwise(""))
    width, height = F.col("box.width").cast("string"), F.col("box.height").cast("string")
    html = F.concat(
        F.lit("<!doctype html><html><head><meta charset='utf-8'>"), head, F.lit(f'</head><body><div id="world" class="{"dots" if dots else ""}" style="width:'), width, F.lit("px;height:"), height, F.lit('px">'),
        F.col("groups"), F.lit('<svg id="edges" width="'), width, F.lit('" height="'), height, F.lit('" xmlns="http://www.w3.org/2000/svg">'), F.col("paths"), F.lit("</svg>"), F.col("cards"), F.col("labels"), F.lit("</div>"), scripts, F.lit("</body></html>"),
    )
    return whole.select(html.alias("html"), F.col("box.width").alias("width"), F.col("box.height").alias("height"))
