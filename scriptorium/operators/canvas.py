"""Node and edge canvases as tables: paint order, links, layout geometry and tile grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.functions import text as T
from scriptorium.operators.links import IMAGE_SUFFIXES, resolve_links, vault_index

__all__ = ["resolve_links", "vault_index"]

# Preset and theme colours, geometry.
PRESET_COLOURS = {"1": "#fb464c", "2": "#e9973f", "3": "#e0de71", "4": "#44cf6e", "5": "#53dfdd", "6": "#a882ff"}
THEMES = {
    "light": {"bg": "#ffffff", "card": "#ffffff", "text": "#222222", "muted": "#6c6c6c", "border": "#c8c8c8", "edge": "#a3a3a3", "code": "#f3f3f3", "link": "#7852ee", "dots": "#e2e2e2"},
    "dark": {"bg": "#1e1e1e", "card": "#262626", "text": "#dadada", "muted": "#9a9a9a", "border": "#4a4a4a", "edge": "#6f6f6f", "code": "#2f2f2f", "link": "#a88bfa", "dots": "#2e2e2e"},
}
GROUP_LABEL_HEIGHT = 40
PADDING = 80
LEAST_PULL, MOST_PULL, PULL = 40.0, 250.0, 0.5
ARROW_SIZE, ARROW_HALF_WIDTH = 12, 0.55
LEAST_TILE, DEFAULT_TILE = 64, 2048
PREVIEW = 4000
#: Longest side of a picture in its format.
MOST_PIXELS = 2**31 - 2


def colour_of(value: Column, default: str) -> Column:
    """A preset's colour, any other value as it is, and the default for null or empty."""
    presets = F.create_map(*[F.lit(x) for pair in PRESET_COLOURS.items() for x in pair])
    return F.when(value.isNull() | (value == ""), F.lit(default)).otherwise(F.coalesce(F.try_element_at(presets, value), value))


def bounding_box(nodes: DataFrame, padding: int = PADDING) -> DataFrame:
    """One row (x0, y0, x1, y1, width, height): the box of all nodes and the page's size; no row without nodes."""
    top = F.when(F.bool_or(F.coalesce(F.col("type") == "group", F.lit(False))), GROUP_LABEL_HEIGHT).otherwise(0)
    box = nodes.agg(F.min("x").alias("x0"), (F.min("y") - top).alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"))
    box = box.where("x0 IS NOT NULL")
    return box.withColumns({"width": F.ceil(F.col("x1") - F.col("x0") + 2 * padding), "height": F.ceil(F.col("y1") - F.col("y0") + 2 * padding)})


def last_by_id(nodes: DataFrame) -> DataFrame:
    """Nodes with an id; of several with one id the last in file order."""
    return nodes.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct(*(F.col(c) for c in nodes.columns if c != "id")), F.col("ord")).alias("_n")).select("id", "_n.*")


def paint_order(nodes: DataFrame) -> DataFrame:
    """Nodes with (is_group, paint): groups first by falling area, then the others in file order; ordered by both."""
    group = F.coalesce(F.col("type") == "group", F.lit(False))
    return nodes.withColumn("is_group", group).withColumn("paint", F.when(group, -F.col("width") * F.col("height"))).orderBy(F.col("is_group").desc(), F.col("paint").asc_nulls_last(), "ord")


def joined_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both their nodes as structs a and b; an edge to an unknown node is dropped.

    The nodes of a canvas are joined by id, twice; neither side is hinted, so the planner broadcasts nodes only when
    their size allows it and splits the keys of a hub otherwise.
    """
    ends = last_by_id(nodes).select("id", F.struct("x", "y", "width", "height").alias("box"))
    left = ends.select(F.col("id").alias("fromNode"), F.col("box").alias("a"))
    right = ends.select(F.col("id").alias("toNode"), F.col("box").alias("b"))
    return edges.join(left, "fromNode").join(right, "toNode")


def canvas_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (n_nodes, n_groups, n_edges)."""
    sums = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.coalesce(F.col("type") == "group", F.lit(False))).alias("n_groups"))
    return sums.crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges")))  # one row each


def _anchor(box: Column, side: Column) -> Column:
    x, y, w, h = box["x"], box["y"], box["width"], box["height"]
    ax = F.when(side == "left", x).when(side == "right", x + w).otherwise(x + w / 2)
    ay = F.when(side == "top", y).when(side == "bottom", y + h).otherwise(y + h / 2)
    return F.struct(ax.cast("double").alias("x"), ay.cast("double").alias("y"))


def _moved(point: Column, dx: Column, dy: Column) -> Column:
    return F.struct((point["x"] + dx).alias("x"), (point["y"] + dy).alias("y"))


def guessed_sides(a: Column, b: Column) -> tuple[Column, Column]:
    """The sides an edge leaves and enters by, from the centres and the first node's proportions; ties are vertical."""
    dx = (b["x"] + b["width"] / 2) - (a["x"] + a["width"] / 2)
    dy = (b["y"] + b["height"] / 2) - (a["y"] + a["height"] / 2)
    across = F.abs(dx) * F.greatest(a["height"], F.lit(1)) > F.abs(dy) * F.greatest(a["width"], F.lit(1))
    leave = F.when(across, F.when(dx > 0, "right").otherwise("left")).otherwise(F.when(dy > 0, "bottom").otherwise("top"))
    enter = F.when(across, F.when(dx > 0, "left").otherwise("right")).otherwise(F.when(dy > 0, "top").otherwise("bottom"))
    return leave, enter


def edge_geometry(joined: DataFrame, ox: Column | float = 0.0, oy: Column | float = 0.0, theme: str = "light") -> DataFrame:
    """Edges with sides, the four points of their curve, label point, ends and colour; ox and oy are the origin."""
    ox, oy = (c if isinstance(c, Column) else F.lit(float(c)) for c in (ox, oy))
    leave, enter = guessed_sides(F.col("a"), F.col("b"))
    sided = joined.withColumns({"from_side": F.coalesce(F.nullif("fromSide", F.lit("")), leave), "to_side": F.coalesce(F.nullif("toSide", F.lit("")), enter)})
    points = sided.withColumns({"p0": _moved(_anchor(F.col("a"), F.col("from_side")), -ox, -oy), "p3": _moved(_anchor(F.col("b"), F.col("to_side")), -ox, -oy)})
    pull = F.greatest(F.lit(LEAST_PULL), F.least(PULL * F.hypot(F.col("p3.x") - F.col("p0.x"), F.col("p3.y") - F.col("p0.y")), F.lit(MOST_PULL)))

    def normal(side: str) -> tuple[Column, Column]:
        s = F.col(side)
        return F.when(s == "left", -1).when(s == "right", 1).otherwise(0), F.when(s == "top", -1).when(s == "bottom", 1).otherwise(0)

    pulled = points.withColumn("k", pull)
    (lx, ly), (ex, ey) = normal("from_side"), normal("to_side")
    pulled = pulled.withColumns({"p1": _moved(F.col("p0"), lx * F.col("k"), ly * F.col("k")), "p2": _moved(F.col("p3"), ex * F.col("k"), ey * F.col("k"))})

    def middle(axis: str) -> Column:
        return reduce(lambda s, t: s + t, [w * F.col(f"p{i}.{axis}") for i, w in enumerate((0.125, 0.375, 0.375, 0.125))])

    return pulled.withColumns({
        "label_x": middle("x"),
        "label_y": middle("y"),
        "arrow_at_end": F.coalesce(F.col("toEnd"), F.lit("arrow")) == "arrow",
        "arrow_at_start": F.coalesce(F.col("fromEnd"), F.lit("none")) == "arrow",
        "stroke": colour_of(F.col("color"), THEMES[theme]["edge"]),
    })


def one_decimal(value: Column) -> Column:
    """A number with one decimal, the exact binary value rounded half to even."""
    return F.call_function("format_number", value.cast("double"), F.lit("0.0"))


def arrow_head(tip: Column, source: Column) -> Column:
    """The three points of an arrow head as text; a zero length counts as one."""
    dx, dy = tip["x"] - source["x"], tip["y"] - source["y"]
    length = F.hypot(dx, dy)
    d = F.when(length == 0, F.lit(1.0)).otherwise(length)
    bx, by = tip["x"] - dx / d * ARROW_SIZE, tip["y"] - dy / d * ARROW_SIZE
    px, py = -dy / d * ARROW_SIZE * ARROW_HALF_WIDTH, dx / d * ARROW_SIZE * ARROW_HALF_WIDTH
    return F.format_string("%s,%s %s,%s %s,%s", *map(one_decimal, (tip["x"], tip["y"], bx + px, by + py, bx - px, by - py)))


def edge_markup(geometry: DataFrame) -> DataFrame:
    """(ord, path, label): the vector path with its arrow heads, and the label's box."""
    g = {p: F.col(p) for p in ("p0", "p1", "p2", "p3")}
    numbers = [g[p][axis] for p in ("p0", "p1", "p2", "p3") for axis in ("x", "y")]
    curve = F.format_string('<path d="M%s,%s C%s,%s %s,%s %s,%s" stroke="%s" stroke-width="3" fill="none"/>', *map(one_decimal, numbers), F.col("stroke"))
    head = lambda tip, source: F.format_string('<polygon points="%s" fill="%s"/>', arrow_head(tip, source), F.col("stroke"))
    path = F.concat(curve, F.when(F.col("arrow_at_end"), head(g["p3"], g["p2"])).otherwise(""), F.when(F.col("arrow_at_start"), head(g["p0"], g["p1"])).otherwise(""))
    text = F.replace(T.escape_html(F.col("label")), F.lit("\n"), F.lit("<br>"))
    label = F.when(F.coalesce(F.col("label"), F.lit("")) != "", F.format_string('<div class="edge-label" style="left:%spx;top:%spx">%s</div>', one_decimal(F.col("label_x")), one_decimal(F.col("label_y")), text)).otherwise("")
    return geometry.select("ord", path.alias("path"), label.alias("label"))


def tile_plan(pages: DataFrame, scale: float = 2.0, tile: int = DEFAULT_TILE, preview: int = PREVIEW) -> DataFrame:
    """Pages (width, height) with output and preview sizes, tile size and the numbers of columns and rows."""
    sized = pages.withColumns({"out_width": F.ceil(F.col("width") * scale), "out_height": F.ceil(F.col("height") * scale), "tile_css": F.lit(max(LEAST_TILE, int(tile // scale)))})
    shrink = F.least(F.lit(1.0), preview / F.greatest("out_width", "out_height"))
    return sized.withColumns({
        "cols": F.ceil(F.col("width") / F.col("tile_css")),
        "rows": F.ceil(F.col("height") / F.col("tile_css")),
        "preview_width": F.greatest(F.lit(1), F.rint(F.col("out_width") * shrink).cast("bigint")),
        "preview_height": F.greatest(F.lit(1), F.rint(F.col("out_height") * shrink).cast("bigint")),
    })


def tile_manifest(planned: DataFrame, scale: float = 2.0) -> DataFrame:
    """One row a tile: place in the grid, rectangle on the page and in the output, and file name."""
    rows = planned.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1)).alias("row"))
    cells = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cols") - 1)).alias("col"))
    cells = cells.withColumns({"x": F.col("col") * F.col("tile_css"), "y": F.col("row") * F.col("tile_css")})
    cells = cells.withColumns({"tile_width": F.least(F.col("tile_css"), F.col("width") - F.col("x")), "tile_height": F.least(F.col("tile_css"), F.col("height") - F.col("y"))})
    px, py = F.rint(F.col("x") * scale).cast("bigint"), F.rint(F.col("y") * scale).cast("bigint")
    return cells.withColumns({
        "px": px,
        "py": py,
        "pw": F.least(F.rint((F.col("x") + F.col("tile_width")) * scale).cast("bigint"), F.col("out_width")) - px,
        "ph": F.least(F.rint((F.col("y") + F.col("tile_height")) * scale).cast("bigint"), F.col("out_height")) - py,
        "file": F.format_string("tile_r%04d_c%04d.png", F.col("row"), F.col("col")),
    })


def node_kind(kind: Column, file: Column, resolved: Column) -> Column:
    """How a node is drawn: group, text, link, image, note, canvas, pdf, another file, a missing one, or empty."""
    suffix = F.lower(F.regexp_extract(F.coalesce(resolved, F.lit("")), r"(?<=[^/])\.[^./]+\z", 0))
    of_file = (
        F.when(resolved.isNull(), "missing").when(suffix.isin(*IMAGE_SUFFIXES), "image").when(suffix == ".md", "note").when(suffix == ".canvas", "canvas").when(suffix == ".pdf", "pdf").otherwise("file")
    )
    kind = F.coalesce(kind, F.lit("text"))
    return F.when(kind.isin("group", "text", "link"), kind).when(kind == "file", of_file).otherwise("empty")
