from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.markdown import render
from scriptorium.operators import canvas, markup

LINK, TAG = '<span class="internal-link">%s</span>', '<span class="tag">#%s</span>'
CASES = [
    ("[[Note #x]]", LINK % "Note #x"),
    ("$x #b$ #c", '<span class="math" data-tex="x #b">$x #b$</span> ' + TAG % "c"),
    ("$$a<\n=b$$", '<div class="math" data-display="1" data-tex="a&lt;\n=b">$$a&lt;\n=b$$</div>'),
    ("$a$ [[x|$b$]]", '<span class="math" data-tex="a">$a$</span> ' + LINK % '<span class="math" data-tex="b">$b$</span>'),
    ("![[gone|100]] ==[[a]]==", '<span class="unresolved">![[gone]]</span> <mark>' + LINK % "a" + "</mark>"),
    ("`#a [[b]]`#c %%#d%%", "`#a [[b]]`" + TAG % "c" + " "),
    ("---\nt: 1\n---\n#x/y-z", TAG % "x/y-z"),
    ("$5 and $6", "$5 and $6"),
    ("", ""),
    (None, None),
]


def test_fragments_are_put_aside_in_order(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "k int, t string")
    got = {r.k: r.o for r in df.select("k", markup.prose_markup(F.col("t")).alias("o")).collect()}
    assert [got[k] for k in range(len(CASES))] == [o for _, o in CASES]


def test_embeds_images_and_their_depth(spark):
    files = spark.createDataFrame([("A.md", 1, "in A ![[B]] ![[]]"), ("B.md", 2, "in B ![[A]] [[A]]"), ("p/x y.png", 3, None), ("f.pdf", 4, None)], "path string, walk_ord bigint, text string")
    notes = spark.createDataFrame([("1", None, "![[A]] ![[x y.png|30x40]] ![[f.pdf|see]] ![i](x%20y.png) ![j](none.png) ![[zz#q]]"), ("2", None, "plain"), ("3", "A.md", None)], "id string, base string, text string")
    got = {r.id: r.body for r in markup.render_notes(notes, files, lambda t: t, "file:///v").collect()}
    picture = '<img src="file:///v/p/x%20y.png" alt="{}"{}>'
    inner_b = '<div class="embed"><div class="embed-title">B</div>in B ' + LINK % "A.md" + " " + LINK % "A" + "</div>"
    inner_a = '<div class="embed"><div class="embed-title">A</div>in A ' + LINK % "B.md" + " " + LINK % "A.md" + "</div>"
    a = '<div class="embed"><div class="embed-title">A</div>in A ' + inner_b + " " + inner_a + "</div>"
    expected = [a, picture.format("x y.png", ' style="width:30px;height:40px;"'), LINK % "see", picture.format("i", ""), "![j](none.png)", '<span class="unresolved">![[zz#q]]</span>']
    assert got == {"1": " ".join(expected), "2": "plain", "3": ""}
    assert markup.render_notes(notes.limit(0), files).count() == 0


@pytest.mark.parametrize(
    ("text", "html"),
    [
        ("# A *b* #\ntext", "<h1>A <em>b</em></h1>\n<p>text</p>"),
        ("a\nb  \n\nc **d** __e__ f_g_h", "<p>a<br>\nb</p>\n<p>c <strong>d</strong> <strong>e</strong> f_g_h</p>"),
        ("- a\n- b\n  - c\n\n1. x\n2. y", "<ul>\n<li>a</li>\n<li>b\n<ul>\n<li>c</li>\n</ul>\n</li>\n</ul>\n<ol>\n<li>x</li>\n<li>y</li>\n</ol>"),
        ("~~~py\n<a> & *b*\n~~~\nz", '<pre><code class="language-py">&lt;a&gt; &amp; *b*\n</code></pre>\n<p>z</p>'),
        ("> q\n> > r\n\nz", "<blockquote>\n<p>q</p>\n<blockquote>\n<p>r</p>\n</blockquote>\n</blockquote>\n<p>z</p>"),
        ("A|B\n-|:-:\n1|2", '<table>\n<thead>\n<tr>\n<th>A</th>\n<th style="text-align: center;">B</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>1</td>\n<td style="text-align: center;">2</td>\n</tr>\n</tbody>\n</table>'),
        ("[a](b \"c\") ![d](e) <http://f.g> `h*i*`", '<p><a href="b" title="c">a</a> <img alt="d" src="e"> <a href="http://f.g">http://f.g</a> <code>h*i*</code></p>'),
        ("a & b < c <b>d</b> &lt;", "<p>a &amp; b &lt; c <b>d</b> &lt;</p>"),
        ("***", "<hr>"),
        ("", ""),
    ],
)
def test_markdown(text, html):
    assert render(text) == html


def test_one_decimal_rounds_the_exact_value(spark):
    values = [0.25, 0.35, 160.25, 160.125, -0.04, 1234567.85, 2.5, -7.75, 0.0]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k")
    assert [r.t for r in df.select(canvas.one_decimal(F.col("v")).alias("t")).collect()] == [f"{v:.1f}" for v in values]
    assert math.isclose(values[0], 0.25)
