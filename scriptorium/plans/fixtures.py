"""Small fixed relations for operators whose input the tables do not hold."""

SCHEMAS = {
    "pages": "id int, width double, height double",
    "colours": "id int, color string",
    "nodes": "id int, type string, file string, resolved string",
    "subpaths": "id int, text string, sub string",
    "notes": "id int, text string",
    "html": "id int, text string",
    "sizes": "id int, size string",
    "canvas_nodes": "id string, ord int, type string, x double, y double, width double, height double, color string, label string, background string, backgroundStyle string, text string, url string, file string, subpath string",
    "canvas_edges": "ord int, fromNode string, toNode string, fromSide string, toSide string, fromEnd string, toEnd string, color string, label string",
    "vault": "path string, walk_ord bigint, text string",
}

ROWS = {
    "pages": [(1, 360.0, 300.0), (2, 64.0, 64.0), (3, 100.5, 65.25), (4, 1000.0, 3.0)],
    "colours": [(1, "1"), (2, "6"), (3, "#abcdef"), (4, ""), (5, None), (6, "7")],
    "nodes": [(1, None, None, None), (2, "group", None, None), (3, "file", "a.md", "n/a.md"), (4, "file", "p.PNG", "p.PNG"), (5, "file", "x", None), (6, "file", "b.canvas", "b.canvas"), (7, "file", "c.pdf", "d/c.pdf"), (8, "file", "Makefile", "Makefile"), (9, "link", None, None), (10, "shape", None, None), (11, "file", ".md", "d/.md")],
    "subpaths": [(1, "# A\nx\n## B\ny\n### C\nz\n## D\nw", "#B"), (2, "# A\nx\n## B\ny", "#Missing"), (3, "# A\nx", "^block"), (4, "# A\nx", ""), (5, "# A\nx", None), (6, "intro\n# A b \n\ntext\n# C", "#a B"), (7, "## A\none\n# B\n## A\ntwo", "#A"), (8, "# A\nx\n## B\ny", "#A#B")],
    "notes": [
        (1, "---\ntitle: x\n---\nHello %%hidden\nlines%% world #tag and #a/b-c but not x#no or &#39; ##"),
        (2, "See [[Note]] and [[Other|the other]] and ![[pic.png|120x80]] or ![[deep#Part|alias]] ![[#Own]]"),
        (3, "==bright== and == not == but ==two words== $x+1$ costs $5 or $ 6$, $$a\n=b$$ and \\$3$"),
        (4, "![alt](img/a%20b.png) ![web](https://example.org/x.png) ![t](c.png \"title\") plain"),
        (5, ""),
        (6, "no markup at all"),
        (7, "---\nnot closed\n[[A#B]] [[]] #_x #1no"),
    ],
    "html": [
        (1, "<ul><li>[ ] open</li><li> [x] done</li><li><p>[X] loose</p></li></ul>"),
        (2, "<blockquote>\n<p>[!warning]- Mind this<br />\nbody</p>\n</blockquote><p>after</p>"),
        (3, "<blockquote><p>[!odd]\ntext</p></blockquote><blockquote><p>plain</p></blockquote>"),
        (4, "<p>none</p>"),
        (5, '<pre><code class="language-mermaid">graph TD\nA--&gt;B</code></pre><pre><code class="language-py">x</code></pre>'),
    ],
    "sizes": [(1, "120"), (2, " 120 x 80 "), (3, "wide"), (4, None), (5, "")],
    "canvas_nodes": [
        ("g", 0, "group", 0.0, 0.0, 200.0, 100.0, "1", "Group & co", None, None, None, None, None, None),
        ("a", 1, "text", 20.0, 20.0, 60.0, 40.0, None, None, None, None, "**A** [[Note]] #tag", None, None, None),
        ("b", 2, None, 120.0, 20.0, 60.0, 40.0, None, None, None, None, "B $x$", None, None, None),
        ("f", 3, "file", 120.0, 70.0, 60.0, 20.0, None, None, None, None, None, None, "Note.md", "#Part"),
        ("l", 4, "link", 20.0, 70.0, 60.0, 20.0, None, None, None, None, None, "https://example.org/?a=1&b=2", None, None),
    ],
    "canvas_edges": [(0, "a", "b", None, None, None, None, None, "to\nb"), (1, "a", "missing", None, None, None, None, None, None), (2, "f", "l", "left", "right", "arrow", "none", "5", None)],
    "vault": [
        ("Note.md", 1, "# Intro\nx\n## Part\nthe part ![[pic.png|20x10]] ![[Deep#In]] ![[gone]]\n![alt](pic.png) ![far](no.png)\n## Next\ny"),
        ("pic.png", 2, None),
        ("d/Deep.md", 3, "# In\n> [!tip] Mind\n> body ![[Note#Next]] ![[Deep]]\n\n- [x] done\n# Out\nz"),
    ],
}

#: The page of ``canvas_nodes``, ``canvas_edges`` and ``vault``, worked out by hand from the rules of markup and geometry.
PAGE = (
    "<!doctype html><html><head><meta charset='utf-8'><style>:root{--bg:#ffffff;--card:#ffffff;--text:#222222;--muted:#6c6c6c;--border:#c8c8c8;--edge:#a3a3a3;--code:#f3f3f3;--link:#7852ee;--dots:#e2e2e2;}* { box-sizing: border-box } body { margin: 0; background: var(--bg); color: var(--text) } #world { position: relative } .node, .group { position: absolute; border: 2px solid var(--nc, var(--border)); border-radius: 8px; background: var(--card) } .group { background-color: transparent } #edges { position: absolute; left: 0; top: 0 } .edge-label, .file-title { position: absolute }</style>"
    '<link rel="stylesheet" href="https://cdn.jsdelivr.net/npm/katex@0.16.11/dist/katex.min.css"></head><body><div id="world" class="" style="width:360px;height:300px">'
    '<div class="group coloured" style="left:80px;top:120px;width:200px;height:100px;--nc:#fb464c;"><div class="group-label">Group &amp; co</div></div><svg id="edges" width="360" height="300" xmlns="http://www.w3.org/2000/svg">'
    '<path d="M160.0,160.0 C200.0,160.0 160.0,160.0 200.0,160.0" stroke="#a3a3a3" stroke-width="3" fill="none"/><polygon points="200.0,160.0 188.0,166.6 188.0,153.4" fill="#a3a3a3"/>'
    '<path d="M200.0,200.0 C160.0,200.0 200.0,200.0 160.0,200.0" stroke="#53dfdd" stroke-width="3" fill="none"/><polygon points="200.0,200.0 188.0,206.6 188.0,193.4" fill="#53dfdd"/>'
    '</svg><div class="node" style="left:100px;top:140px;width:60px;height:40px;"><div class="content md"><p><strong>A</strong> <span class="internal-link">Note</span> <span class="tag">#tag</span>'
    '</p></div></div><div class="node" style="left:200px;top:140px;width:60px;height:40px;"><div class="content md"><p>B <span class="math" data-tex="x">$x$</span>'
    '</p></div></div><div class="file-title" style="left:200px;top:164px;max-width:60px">Note</div><div class="node" style="left:200px;top:190px;width:60px;height:20px;">'
    '<div class="content md"><h2>Part</h2>\n<p>the part <img src="pic.png" alt="pic.png" style="width:20px;height:10px;"> <div class="embed"><div class="embed-title">Deep#In</div>'
    '<h1>In</h1>\n<div class="callout" style="--c:#00bfbc"><div class="callout-title">Mind</div><div class="callout-body"><p>body <div class="embed"><div class="embed-title">Note#Next</div>'
    '<h2>Next</h2>\n<p>y</p></div> <div class="embed"><div class="embed-title">Deep</div><h1>In</h1>\n<div class="callout" style="--c:#00bfbc"><div class="callout-title">Mind</div>'
    '<div class="callout-body"><p>body <span class="internal-link">Note.md</span> <span class="internal-link">Deep.md</span></p>\n</div></div>\n<ul>\n<li class="task done">☑ done</li>\n</ul>\n<h1>Out</h1>\n<p>z</p>'
    '</div></p>\n</div></div>\n<ul>\n<li class="task done">☑ done</li>\n</ul></div> <span class="unresolved">![[gone]]</span><br>\n<img src="pic.png" alt="alt"> <img alt="far" src="no.png">'
    '</p></div></div><div class="node link-node" style="left:100px;top:190px;width:60px;height:20px;"><div class="content"><div class="link-icon">🔗</div><div class="link-url">https://example.org/?a=1&amp;b=2</div>'
    '</div></div><div class="edge-label" style="left:180.0px;top:160.0px">to<br>b</div></div><script src="https://cdn.jsdelivr.net/npm/katex@0.16.11/dist/katex.min.js"></script></body></html>'
)
