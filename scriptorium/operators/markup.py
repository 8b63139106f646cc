"""Note markup as column expressions: what is stripped, found, rewritten and cut out."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions.markdown import render
from scriptorium.functions.text import escape_html, file_name, strip
from scriptorium.operators.links import IMAGE_SUFFIXES, resolve_links
from scriptorium.session import cut

# The patterns of the markup, and the colours of callouts.
CODE = r"(?s)```.*?```|~~~.*?~~~|`[^`\n]+`"
FRONT_MATTER = r"(?s)\A---\s*\n.*?\n---\s*(?:\n|\z)"
MATH_BLOCK = r"(?s)\$\$(.+?)\$\$"
MATH_INLINE = r"(?<![\\$])\$(?!\s)([^$\n]+?)(?<!\s)\$(?!\d)"
EMBED = r"!\[\[([^\]|#^]*)([#^][^\]|]*)?(?:\|([^\]]*))?\]\]"
WIKILINK = r"\[\[([^\]|]*)(?:\|([^\]]*))?\]\]"
IMAGE = r'!\[([^\]]*)\]\((?!https?:|data:|file:)([^)\s]+)(?:\s+"[^"]*")?\)'
HIGHLIGHT = r"==(?=\S)(.+?)(?<=\S)=="
COMMENT = r"(?s)%%.*?%%"
TAG = r"(?<![\w&/#])#([A-Za-z_][\w/-]*)"
CALLOUT = r"(?s)<blockquote>\s*<p>\[!(\w+)\]([+-]?)([^\n<]*)(.*?)</blockquote>"
CALLOUT_COLOURS = {
    "note": "#086ddd", "info": "#086ddd", "todo": "#086ddd", "abstract": "#00bfbc", "summary": "#00bfbc", "tldr": "#00bfbc", "tip": "#00bfbc", "hint": "#00bfbc",
    "important": "#00bfbc", "success": "#08b94e", "check": "#08b94e", "done": "#08b94e", "question": "#ec7500", "help": "#ec7500", "faq": "#ec7500", "warning": "#ec7500",
    "caution": "#ec7500", "attention": "#ec7500", "failure": "#e93147", "fail": "#e93147", "missing": "#e93147", "danger": "#e93147", "error": "#e93147", "bug": "#e93147",
    "example": "#7852ee", "quote": "#9e9e9e", "cite": "#9e9e9e",
}
DEFAULT_CALLOUT = "#086ddd"
# The fragments that stand for links, tags, maths, embeds and images; the marks of tasks.
LINK_HTML = '<span class="internal-link">%s</span>'
UNRESOLVED_HTML = '<span class="unresolved">![[%s]]</span>'
TAG_HTML = '<span class="tag">#%s</span>'
MATH_BLOCK_HTML = '<div class="math" data-display="1" data-tex="%s">$$%s$$</div>'
MATH_INLINE_HTML = '<span class="math" data-tex="%s">$%s$</span>'
EMBED_HTML = '<div class="embed"><div class="embed-title">%s</div>%s</div>'
IMAGE_HTML = '<img src="%s" alt="%s"%s>'
TASKS = (
    (r"<li>\s*\[ \]\s*", '<li class="task">☐ '),
    (r"<li>\s*\[[xX]\]\s*", '<li class="task done">☑ '),
    (r"<li>\s*<p>\s*\[ \]\s*", '<li class="task"><p>☐ '),
    (r"<li>\s*<p>\s*\[[xX]\]\s*", '<li class="task done"><p>☑ '),
)

#: Unicode classes, and a dot that stops at line feeds only.
_J = "(?Ud)"
MAX_EMBED_DEPTH = 2


def strip_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, _J + FRONT_MATTER, "")


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, _J + COMMENT, "")


def on_prose(text: Column, change: Callable[[Column], Column]) -> Column:
    """Apply a change to everything but code blocks and code spans."""
    code = F.regexp_extract_all(text, F.lit(_J + CODE), F.lit(0))
    prose = F.split(text, _J + CODE, -1)
    return F.array_join(F.zip_with(prose, code, lambda p, c: F.concat(change(p), F.coalesce(c, F.lit("")))), "")


def embeds(text: Column) -> Column:
    """array(struct(target, subpath, alias)) of the embeds in a text."""
    whole = F.regexp_extract_all(text, F.lit(_J + EMBED), F.lit(0))
    return F.transform(whole, lambda m: F.struct(*(F.regexp_extract(m, _J + EMBED, k).alias(n) for k, n in ((1, "target"), (2, "subpath"), (3, "alias")))))


def wikilinks(text: Column) -> Column:
    """array(struct(target, label)) of the links in a text; the label is the alias or the whole target."""
    whole = F.regexp_extract_all(F.regexp_replace(text, _J + EMBED, ""), F.lit(_J + WIKILINK), F.lit(0))
    return F.transform(whole, lambda m: F.struct(F.regexp_extract(m, _J + WIKILINK, 1).alias("target"), F.coalesce(F.nullif(F.regexp_extract(m, _J + WIKILINK, 2), F.lit("")), F.regexp_extract(m, _J + WIKILINK, 1)).alias("label")))


def images(text: Column) -> Column:
    """array(struct(alt, target)) of local images, blanks decoded."""
    whole = F.regexp_extract_all(text, F.lit(_J + IMAGE), F.lit(0))
    return F.transform(whole, lambda m: F.struct(F.regexp_extract(m, _J + IMAGE, 1).alias("alt"), F.replace(F.regexp_extract(m, _J + IMAGE, 2), F.lit("%20"), F.lit(" ")).alias("target")))


def tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_J + TAG), F.lit(1))


def math_blocks(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_J + MATH_BLOCK), F.lit(1)), strip)


def inline_math(text: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(text, _J + MATH_BLOCK, ""), F.lit(_J + MATH_INLINE), F.lit(1))


def highlight_markup(text: Column) -> Column:
    return F.regexp_replace(text, _J + HIGHLIGHT, "<mark>$1</mark>")


def image_style(size: Column) -> Column:
    """The style of an embedded image's size, "W" or "WxH"; empty for anything else."""
    pattern = r"\A\s*(\d+)\s*(?:x\s*(\d+))?\s*\z"
    width, height = F.regexp_extract(size, pattern, 1), F.regexp_extract(size, pattern, 2)
    sized = F.concat(F.lit(' style="width:'), width, F.lit("px;"), F.when(height != "", F.concat(F.lit("height:"), height, F.lit("px;"))).otherwise(""), F.lit('"'))
    return F.when(F.coalesce(width, F.lit("")) != "", sized).otherwise("")


def task_lists(html: Column) -> Column:
    for pattern, new in TASKS:
        html = F.regexp_replace(html, "(?U)" + pattern, new)
    return html


def callouts(html: Column) -> Column:
    """Quotes that begin with a callout mark, as coloured boxes; an unknown kind has the default colour."""
    pieces = F.regexp_extract_all(html, F.lit("(?U)" + CALLOUT), F.lit(0))
    between = F.split(html, "(?U)" + CALLOUT, -1)
    colours = F.create_map(*[F.lit(x) for pair in CALLOUT_COLOURS.items() for x in pair])

    def box(quote: Column) -> Column:
        part = lambda k: F.regexp_extract(quote, "(?U)" + CALLOUT, k)
        kind = F.lower(part(1))
        title = F.coalesce(F.nullif(strip(part(3)), F.lit("")), F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, 2, 2**31 - 1)))
        rest = F.regexp_replace(part(4), r"(?U)\A\s*<br\s*/?>\s*", "")
        return F.concat(F.lit('<div class="callout" style="--c:'), F.coalesce(F.try_element_at(colours, kind), F.lit(DEFAULT_CALLOUT)), F.lit('"><div class="callout-title">'), title, F.lit('</div><div class="callout-body"><p>'), rest, F.lit("</div></div>"))

    return F.array_join(F.zip_with(between, pieces, lambda b, p: F.concat(b, F.when(p.isNull(), F.lit("")).otherwise(box(p)))), "")


def mermaid_blocks(html: Column) -> Column:
    return F.regexp_replace(html, r'(?s)<pre><code class="language-mermaid">(.*?)</code></pre>', '<pre class="mermaid">$1</pre>')


def uses_math(text: Column) -> Column:
    return text.rlike(_J + MATH_BLOCK) | text.rlike(_J + MATH_INLINE)


def uses_mermaid(html: Column) -> Column:
    return F.contains(html, F.lit('class="language-mermaid"'))


def subpath(text: Column, sub: Column) -> Column:
    """The section under a heading, up to the next heading of its level or above; the whole text where there is none.

    Within a row: the lines are numbered, the first heading of that name is found, and the section is sliced out.
    """
    lines = F.split(F.regexp_replace(text, r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85  ]", "\n"), "\n", -1)
    lines = F.when(text.endswith("\n"), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    heading = F.lower(strip(F.regexp_replace(sub, r"\A#+", "")))
    marks = F.transform(lines, lambda s: F.length(F.regexp_extract(s, r"(?U)\A(#{1,6})\s", 1)))
    names = F.transform(lines, lambda s: F.lower(strip(F.regexp_extract(s, r"(?U)\A#{1,6}\s+(.*)\z", 1))))
    places = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (F.element_at(marks, i) > 0) & (F.element_at(names, i) == heading) & F.element_at(lines, i).rlike(r"(?U)\A#{1,6}\s+"))
    at = F.try_element_at(places, F.lit(1))
    level = F.element_at(marks, at)
    ends = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (i > at) & (F.element_at(marks, i) > 0) & (F.element_at(marks, i) <= level))
    end = F.coalesce(F.try_element_at(ends, F.lit(1)), F.size(lines) + 1)
    section = F.array_join(F.slice(lines, at, end - at), "\n")
    wanted = sub.isNotNull() & sub.startswith("#")
    return F.when(wanted & at.isNotNull(), section).otherwise(text)


# ---- fragments put aside ----------------------------------------------------------------------------------------
#
# What is found in a text gives way to a mark, and its fragment goes into an array, so that neither later patterns nor
# the renderer touch it. A mark reads as a word: a letter that no note uses, and the fragment's number.

_MARK = "ᚠ"


def _mark(number: Column) -> Column:
    return F.concat(F.lit(_MARK), number.cast("string"), F.lit(_MARK))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """Use a value several times without writing its expression out again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _filled(template: str, *parts: Column) -> Column:
    pieces = template.split("%s")
    return F.concat(F.lit(pieces[0]), *(x for part, piece in zip(parts, pieces[1:], strict=True) for x in (part, F.lit(piece))))


def put_aside(state: Column, pattern: str, fragment: Callable[[Column], Column]) -> Column:
    """struct(text, held) with the fragments of all matches put aside; a match whose fragment is null stays."""

    def applied(s: Column) -> Column:
        found = F.regexp_extract_all(s["text"], F.lit(_J + pattern), F.lit(0))
        return _with(F.struct(found.alias("found"), F.transform(found, fragment).alias("made"), F.split(s["text"], _J + pattern, -1).alias("between")), lambda m: replaced(s, m))

    def replaced(s: Column, m: Column) -> Column:
        before = F.size(s["held"])
        number = lambda i: before + F.size(F.filter(F.slice(m["made"], 1, i + 1), lambda x: x.isNotNull())) - 1
        put = F.transform(m["between"], lambda text, i: F.concat(text, F.when(i >= F.size(m["found"]), F.lit("")).when(F.get(m["made"], i).isNull(), F.get(m["found"], i)).otherwise(_mark(number(i)))))
        return F.struct(F.array_join(put, "").alias("text"), F.concat(s["held"], F.filter(m["made"], lambda x: x.isNotNull())).alias("held"))

    return _with(state, applied)


def put_back(text: Column, held: Column) -> Column:
    """The text with every mark replaced, the last ones first, as they can hold earlier ones."""
    numbers = F.when(F.size(held) > 0, F.sequence(F.size(held) - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(numbers, text, lambda t, k: F.replace(t, _mark(k), F.get(held, k)))


def _group(match: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(match, _J + pattern, k)


def _maths_aside(state: Column) -> Column:
    state = put_aside(state, MATH_BLOCK, lambda m: _filled(MATH_BLOCK_HTML, escape_html(strip(_group(m, MATH_BLOCK, 1))), escape_html(_group(m, MATH_BLOCK, 1))))
    return put_aside(state, MATH_INLINE, lambda m: _filled(MATH_INLINE_HTML, escape_html(_group(m, MATH_INLINE, 1)), escape_html(_group(m, MATH_INLINE, 1))))


def _link(m: Column) -> Column:
    return _filled(LINK_HTML, escape_html(F.coalesce(F.nullif(_group(m, WIKILINK, 2), F.lit("")), _group(m, WIKILINK, 1))))


def _unresolved(m: Column) -> Column:
    return _filled(UNRESOLVED_HTML, escape_html(F.concat(_group(m, EMBED, 1), _group(m, EMBED, 2))))


def _segments(text: Column) -> Column:
    """struct(prose, code): the stretches outside code, and the code after each of them."""
    bare = strip_front_matter(text)
    return F.struct(F.split(bare, _J + CODE, -1).alias("prose"), F.regexp_extract_all(bare, F.lit(_J + CODE), F.lit(0)).alias("code"))


def calls(text: Column) -> Column:
    """The distinct embeds and local images of a note, as written, outside code and maths."""
    empty = F.array().cast("array<string>")
    prose = F.transform(_segments(text)["prose"], lambda p: _maths_aside(F.struct(strip_comments(p).alias("text"), empty.alias("held")))["text"])
    found = F.transform(prose, lambda p: F.concat(F.regexp_extract_all(p, F.lit(_J + EMBED), F.lit(0)), F.regexp_extract_all(p, F.lit(_J + IMAGE), F.lit(0))))
    return F.array_distinct(F.flatten(found))


def marked(text: Column, known: Column | None = None) -> Column:
    """struct(text, held): a note with its maths, embeds, images, links and tags put aside, outside code.

    ``known`` maps embeds and images to their fragments; an embed that it lacks counts as unresolved, an image stays.
    """
    known = F.create_map().cast("map<string,string>") if known is None else known
    empty = F.array().cast("array<string>")

    def prose(state: Column) -> Column:
        state = _maths_aside(state)
        state = put_aside(state, EMBED, lambda m: F.coalesce(F.try_element_at(known, m), _unresolved(m)))
        state = put_aside(state, IMAGE, lambda m: F.try_element_at(known, m))
        state = put_aside(state, WIKILINK, _link)
        lit = lambda s: F.struct(highlight_markup(s["text"]).alias("text"), s["held"].alias("held"))
        return put_aside(_with(state, lit), TAG, lambda m: _filled(TAG_HTML, escape_html(F.substring(m, 2, 2**31 - 1))))

    def add(done: Column, stretch: Column) -> Column:
        return _with(prose(F.struct(strip_comments(stretch["prose"]).alias("text"), done["held"].alias("held"))), lambda s: F.struct(F.concat(done["text"], s["text"], F.coalesce(stretch["code"], F.lit(""))).alias("text"), s["held"].alias("held")))

    return F.aggregate(F.arrays_zip(_segments(text)["prose"].alias("prose"), _segments(text)["code"].alias("code")), F.struct(F.lit("").alias("text"), empty.alias("held")), add)


def prose_markup(text: Column) -> Column:
    """Comments gone; maths, links, highlights and tags as markup, outside code. Embeds count as unresolved."""
    return _with(marked(text), lambda s: put_back(s["text"], s["held"]))


def with_html(notes: DataFrame, name: str, text: Column, known: Column | None = None, renderer: Callable[[str], str] | None = None) -> DataFrame:
    """``notes`` with a text as HTML by a pluggable renderer, by default the own small one; nulls count as empty.

    The renderer runs in Python over whole batches, and what was put aside is put back there; the rest are columns.
    """
    run = renderer or render

    @F.pandas_udf("string")
    def rendered(texts: pd.Series, held: pd.Series) -> pd.Series:
        out = []
        for value, fragments in zip(texts, held, strict=True):
            html = run(value)
            for k in range(len(fragments) - 1, -1, -1):
                html = html.replace(f"{_MARK}{k}{_MARK}", fragments[k])
            out.append(html)
        return pd.Series(out, dtype=object)

    whole = notes.withColumn("_marked", marked(F.coalesce(text, F.lit("")), known))
    html = whole.withColumn("_html", rendered("_marked.text", "_marked.held"))
    return html.withColumn(name, mermaid_blocks(callouts(task_lists(F.col("_html"))))).drop("_marked", "_html")


def image_tag(path: Column, alt: Column, size: Column, root: str = "") -> Column:
    """An image of the vault; with a root, its place is written as an address."""
    return _filled(IMAGE_HTML, escape_html(address(path, root) if root else path), escape_html(alt), image_style(size))


def address(path: Column, root: str) -> Column:
    """A path below a root, its characters written as addresses allow."""
    coded = F.url_encode(path)
    for old, new in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        coded = F.replace(coded, F.lit(old), F.lit(new))
    return F.concat(F.lit(root.rstrip("/") + "/"), coded)


def render_notes(notes: DataFrame, files: DataFrame, renderer: Callable[[str], str] | None = None, root: str = "", depth: int = 0) -> DataFrame:
    """(id, body): every note of ``notes`` (id, base, text) as HTML, with what it embeds, MAX_EMBED_DEPTH deep.

    ``files`` has (path, walk_ord, text) of the vault; ``base`` is the note's own path, which an embed without a target
    means. Each depth is one set of joins: the embeds of all notes are resolved together, the distinct notes and
    sections among them rendered once, and the fragments brought back as one map a note.
    """
    found = notes.select("id", "base", F.explode(calls(F.coalesce("text", F.lit("")))).alias("call"))
    is_embed = F.startswith("call", F.lit("![["))
    part = lambda k: F.when(is_embed, _group(F.col("call"), EMBED, k))
    target = F.when(is_embed, _group(F.col("call"), EMBED, 1)).otherwise(F.replace(_group(F.col("call"), IMAGE, 2), F.lit("%20"), F.lit(" ")))
    named = found.select("id", "base", "call", is_embed.alias("embed"), target.alias("target"), part(2).alias("sub"), part(3).alias("alias"))
    links = resolve_links(named.where("target <> ''").select("target"), files.select("path", "walk_ord"))
    placed = named.join(links.withColumnRenamed("path", "linked"), "target", "left").withColumn("path", F.when(F.col("target") == "", F.col("base")).otherwise(F.col("linked")))
    placed = cut(placed)  # read by the next depth and by this one
    if placed.isEmpty():
        return with_html(notes, "body", F.col("text"), None, renderer).select("id", "body")
    name = file_name(F.col("path"))
    suffix = F.lower(F.regexp_extract("path", r"(?<=[^/])\.[^./]+\z", 0))
    picture, note = suffix.isin(*IMAGE_SUFFIXES), suffix == ".md"
    shown = F.when(~F.col("embed"), image_tag(F.col("path"), _group(F.col("call"), IMAGE, 1), F.lit(None).cast("string"), root))
    shown = shown.when(F.col("path").isNull(), _unresolved(F.col("call"))).when(picture, image_tag(F.col("path"), name, F.col("alias"), root))
    link = _filled(LINK_HTML, escape_html(F.coalesce(F.nullif("alias", F.lit("")), name)))
    if depth < MAX_EMBED_DEPTH:
        inner_id = F.concat("path", F.lit("\n"), F.coalesce("sub", F.lit("")))
        wanted = placed.where(F.col("embed") & F.coalesce(note, F.lit(False))).select(inner_id.alias("id"), F.col("path").alias("base"), "sub").distinct()
        texts = wanted.join(files.select(F.col("path").alias("base"), "text"), "base", "left")
        inner = cut(texts.select("id", "base", subpath(F.coalesce("text", F.lit("")), F.col("sub")).alias("text")))
        bodies = render_notes(inner, files, renderer, root, depth + 1).withColumnRenamed("id", "inner")
        placed = placed.withColumn("inner", F.when(F.col("embed") & note, inner_id)).join(bodies, "inner", "left")
        stem = F.regexp_replace(name, r"(?<=.)\.[^.]+\z", "")
        shown = shown.when(note, _filled(EMBED_HTML, escape_html(F.concat(stem, "sub")), F.coalesce("body", F.lit(""))))
    fragments = placed.select("id", "call", shown.otherwise(link).alias("html")).where("html IS NOT NULL")
    known = fragments.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("call", "html"))).alias("known"))  # a note's own embeds
    return with_html(notes.join(known, "id", "left"), "body", F.col("text"), F.coalesce("known", F.create_map().cast("map<string,string>")), renderer).select("id", "body")


def expand_embeds(notes: DataFrame, links: DataFrame, depth: int = MAX_EMBED_DEPTH) -> DataFrame:
    """(path, depth, embedded, subpath): what notes embed, directly and through others, for so many rounds.

    ``notes`` has (path, text), ``links`` the resolved (target, path). Each round is one join on the embedded path.
    """
    direct = notes.select("path", F.explode(embeds(F.col("text"))).alias("e")).select("path", F.col("e.target").alias("target"), F.col("e.subpath").alias("subpath"))
    named = direct.join(links.select("target", F.col("path").alias("embedded")), "target", "left")
    own = named.select("path", F.when(F.col("target") == "", F.col("path")).otherwise(F.col("embedded")).alias("embedded"), "subpath")
    level = own.select("path", F.lit(1).alias("depth"), "embedded", "subpath")
    out = level
    for d in range(2, depth + 1):
        further = own.select(F.col("path").alias("_through"), F.col("embedded").alias("_next"), F.col("subpath").alias("_sub"))
        level = level.where(F.col("embedded").endswith(".md")).join(further, F.col("embedded") == F.col("_through")).select("path", F.lit(d).alias("depth"), F.col("_next").alias("embedded"), F.col("_sub").alias("subpath"))
        out = out.unionAll(level)
    return out
