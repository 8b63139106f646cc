from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import canvas, markup
from scriptorium.plans import fixtures
from scriptorium.plans.page import html_page
from scriptorium.plans.pipelines import export_canvas

NODES = [("g", 0, "group", 0.0, 0.0, 200.0, 100.0), ("a", 1, "text", 20.0, 20.0, 60.0, 40.0), ("b", 2, "text", 120.0, 20.0, 60.0, 40.0), ("a2", 3, None, 0.0, 0.0, 1.0, 1.0), (None, 4, "text", 5.0, 5.0, 1.0, 1.0)]
EDGE = "ord int, fromNode string, toNode string, fromSide string, toSide string, fromEnd string, toEnd string, color string, label string"


def nodes(spark, rows=NODES[:3]):
    return spark.createDataFrame(rows, "id string, ord int, type string, x double, y double, width double, height double")


def test_box_and_page_size(spark):
    box = canvas.bounding_box(nodes(spark)).first()
    assert (box.x0, box.y0, box.x1, box.y1, box.width, box.height) == (0, -40, 200, 100, 360, 300)
    assert canvas.bounding_box(nodes(spark, [])).count() == 0
    assert canvas.bounding_box(nodes(spark, NODES[1:2])).first().y0 == 20


def test_edge_geometry(spark):
    edges = spark.createDataFrame([(0, "a", "b", None, None, None, None, None, "x"), (1, "a", "nowhere", None, None, None, None, None, None)], EDGE)
    got = canvas.edge_geometry(canvas.joined_edges(nodes(spark), edges), -80, -120).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.from_side, r.to_side) == ("right", "left")
    assert (tuple(r.p0), tuple(r.p1), tuple(r.p2), tuple(r.p3)) == ((160, 160), (200, 160), (160, 160), (200, 160))
    assert (r.k, r.label_x, r.label_y, r.arrow_at_end, r.arrow_at_start, r.stroke) == (40, 180, 160, True, False, "#a3a3a3")


def test_last_node_of_an_id_wins_and_paint_order(spark):
    twice = nodes(spark, [*NODES, ("a", 9, "text", 1.0, 2.0, 3.0, 4.0)])
    assert {r.id: r.ord for r in canvas.last_by_id(twice).collect()} == {"g": 0, "a": 9, "b": 2, "a2": 3}
    groups = nodes(spark, [("s", 0, "group", 0.0, 0.0, 1.0, 1.0), ("t", 1, "text", 0.0, 0.0, 9.0, 9.0), ("l", 2, "group", 0.0, 0.0, 5.0, 5.0)])
    assert [r.id for r in canvas.paint_order(groups).collect()] == ["l", "s", "t"]


def test_tiles(spark):
    page = spark.createDataFrame([(360.0, 300.0)], "width double, height double")
    plan = canvas.tile_plan(page).first()
    assert (plan.out_width, plan.out_height, plan.tile_css, plan.cols, plan.rows) == (720, 600, 1024, 1, 1)
    tiles = canvas.tile_manifest(canvas.tile_plan(page, 2.0, 128)).orderBy("row", "col").collect()
    assert len(tiles) == 30
    assert (tiles[5].px, tiles[5].pw, tiles[-1].py, tiles[-1].ph) == (640, 80, 512, 88)
    assert tiles[-1].file == "tile_r0004_c0005.png"


def test_links_prefer_exact_notes_short_paths(spark):
    files = spark.createDataFrame([("n/Note.md", 1), ("Note.md", 2), ("x/Note.png", 3), (".hidden/Secret.md", 4), ("img/a b.png", 5), ("dup/one.md", 6), ("dup2/one.md", 7)], "path string, walk_ord bigint")
    targets = spark.createDataFrame([(t,) for t in ("Note", "n/Note", "note.PNG", "Secret", ".hidden/Secret.md", "a b.png", "zzz/one", " ", "missing", None)], "target string")
    got = {r.target: r.path for r in canvas.resolve_links(targets, files).collect()}
    assert got == {"Note": "Note.md", "n/Note": "n/Note.md", "note.PNG": "x/Note.png", "Secret": None, ".hidden/Secret.md": ".hidden/Secret.md", "a b.png": "img/a b.png", "zzz/one": "dup/one.md", " ": None, "missing": None, None: None}


def test_subpaths(spark):
    df = spark.createDataFrame(fixtures.ROWS["subpaths"], fixtures.SCHEMAS["subpaths"]).select("id", markup.subpath(F.col("text"), F.col("sub")).alias("s"))
    got = {r.id: r.s for r in df.collect()}
    assert got[1] == "## B\ny\n### C\nz"
    assert got[2] == "# A\nx\n## B\ny"
    assert got[6] == "# A b \n\ntext"
    assert got[7] == "## A\none"


def test_callouts_and_code_stay_apart(spark):
    df = spark.createDataFrame([("<blockquote>\n<p>[!tip]+\nbody</p></blockquote>", "a `[[x]] #t` b [[y|z]]\n```\n==c==\n```\n==d==")], "h string, t string")
    r = df.select(markup.callouts(F.col("h")).alias("h"), markup.prose_markup(F.col("t")).alias("t")).first()
    assert r.h == '<div class="callout" style="--c:#00bfbc"><div class="callout-title">Tip</div><div class="callout-body"><p>\nbody</p></div></div>'
    assert r.t == 'a `[[x]] #t` b <span class="internal-link">z</span>\n```\n==c==\n```\n<mark>d</mark>'


def test_embeds_expand_two_rounds(spark):
    notes = spark.createDataFrame([("a.md", "![[b]] ![[p.png|9]]"), ("b.md", "![[c#H]]"), ("c.md", "![[a]]")], "path string, text string")
    links = spark.createDataFrame([("b", "b.md"), ("c", "c.md"), ("a", "a.md"), ("p.png", "p.png")], "target string, path string")
    got = {(r.path, r.depth, r.embedded, r.subpath) for r in markup.expand_embeds(notes, links).where("path = 'a.md'").collect()}
    assert got == {("a.md", 1, "b.md", ""), ("a.md", 1, "p.png", ""), ("a.md", 2, "c.md", "#H")}


def test_page_has_groups_edges_cards_in_order(spark):
    make = lambda n: spark.createDataFrame(fixtures.ROWS[n], fixtures.SCHEMAS[n])
    row = html_page(make("canvas_nodes"), make("canvas_edges"), make("vault")).first()
    assert (row.width, row.height) == (360, 300)
    assert row.html.index("Group &amp; co") < row.html.index("<svg") < row.html.index('<span class="internal-link">Note</span>')
    assert "<h2>Part</h2>" in row.html and "the part" in row.html and "<h2>Intro</h2>" not in row.html
    assert row.html.count("<path") == 2 and row.html.count("<polygon") == 2
    assert "to<br>b" in row.html and "katex" in row.html and "?a=1&amp;b=2" in row.html
    empty = html_page(make("canvas_nodes").limit(0), make("canvas_edges"))
    assert empty.count() == 0


def test_canvas_files_end_to_end(spark, tmp_path):
    vault = tmp_path / "vault"
    (vault / ".obsidian").mkdir(parents=True)
    (vault / "notes").mkdir()
    (vault / "notes" / "Deep.md").write_bytes(b"# H\nDeep \xff text")
    (vault / "c.canvas").write_text(json.dumps({"nodes": [{"id": "n", "type": "file", "file": "Deep.md", "x": 0, "y": 0, "width": 100, "height": 50}], "edges": []}))
    page, manifest = export_canvas(spark, str(vault / "c.canvas"), str(tmp_path / "out"))
    assert "Deep � text" in page.first().html
    assert manifest.count() == 1
    (vault / "e.canvas").write_text(json.dumps({"nodes": []}))
    with pytest.raises(ValueError, match="no nodes"):
        export_canvas(spark, str(vault / "e.canvas"), str(tmp_path / "out2"))
