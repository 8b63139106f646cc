"""A Markdown renderer without dependencies, for notes whose own markup was put aside before.

Blocks are read line by line into headings, rules, fenced code, quotes, lists (by indentation), tables and paragraphs;
line breaks within a paragraph are kept. Markup within a line: code, emphasis, links, images and addresses in angle
brackets. HTML passes as it is. It covers what notes use, not every corner of the dialect: a caller's own renderer
takes its place where more is needed.
"""

from __future__ import annotations

import html
import re

_FENCE = re.compile(r"^ {0,3}(```+|~~~+)\s*([\w+-]*)")
_HEADING = re.compile(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$")
_ITEM = re.compile(r"^(\s*)([*+-]|\d+[.)])\s+(.*)$")
_QUOTE = re.compile(r"^ {0,3}> ?")
_DELIMITER = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_CODE = re.compile(r"(`+)(.+?)(?<!`)\1(?!`)", re.S)
_IMAGE = re.compile(r"!\[([^\]]*)\]\(\s*<?([^)\s>]+)>?(?:\s+\"([^\"]*)\")?\s*\)")
_LINK = re.compile(r"\[([^\]]*)\]\(\s*<?([^)\s>]+)>?(?:\s+\"([^\"]*)\")?\s*\)")
_ADDRESS = re.compile(r"<((?:https?|mailto):[^>\s]+)>")
_STRONG = re.compile(r"(\*\*|(?<!\w)__)(?=\S)(.+?)(?<=\S)\1(?!\w)|(\*\*)(?=\S)(.+?)(?<=\S)\*\*", re.S)
_EMPHASIS = re.compile(r"(?<!\*)\*(?=[^\s*])(.+?)(?<=[^\s*])\*(?!\*)|(?<!\w)_(?=\S)(.+?)(?<=\S)_(?!\w)", re.S)
_BARE = re.compile(r"&(?!#?\w+;)|<(?![a-zA-Z/!])")


def inline(text: str) -> str:
    """The markup within a paragraph; code is put aside first, so that nothing in it is read as markup."""
    kept: list[str] = []

    def aside(fragment: str) -> str:
        kept.append(fragment)
        return f"\x00{len(kept) - 1}\x00"

    text = _CODE.sub(lambda m: aside(f"<code>{html.escape(m.group(2).strip(), quote=False)}</code>"), text)
    text = _BARE.sub(lambda m: html.escape(m.group()), text)
    title = lambda m: f' title="{html.escape(m.group(3))}"' if m.group(3) else ""
    text = _IMAGE.sub(lambda m: aside(f'<img alt="{html.escape(m.group(1))}" src="{m.group(2)}"{title(m)}>'), text)
    text = _LINK.sub(lambda m: aside(f'<a href="{m.group(2)}"{title(m)}>') + m.group(1) + "</a>", text)
    text = _ADDRESS.sub(lambda m: aside(f'<a href="{m.group(1)}">{m.group(1)}</a>'), text)
    text = _STRONG.sub(lambda m: f"<strong>{m.group(2) or m.group(4)}</strong>", text)
    text = _EMPHASIS.sub(lambda m: f"<em>{m.group(1) or m.group(2)}</em>", text)
    text = re.sub(r" *\n", "<br>\n", text)
    return re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m.group(1))], text)


def render(text: str) -> str:
    return "\n".join(_blocks(text.expandtabs(4).split("\n")))


def _blocks(lines: list[str]) -> list[str]:
    out: list[str] = []
    at = 0
    while at < len(lines):
        line = lines[at]
        if not line.strip():
            at += 1
        elif fence := _FENCE.match(line):
            end = next((k for k in range(at + 1, len(lines)) if lines[k].strip().startswith(fence.group(1)) and not lines[k].strip().strip(fence.group(1)[0])), len(lines))
            language = f' class="language-{fence.group(2)}"' if fence.group(2) else ""
            body = "".join(f"{html.escape(x, quote=False)}\n" for x in lines[at + 1 : end])
            out.append(f"<pre><code{language}>{body}</code></pre>")
            at = end + 1
        elif heading := _HEADING.match(line):
            level = len(heading.group(1))
            out.append(f"<h{level}>{inline(heading.group(2))}</h{level}>")
            at += 1
        elif _RULE.match(line):
            out.append("<hr>")
            at += 1
        elif _QUOTE.match(line):
            end = at
            while end < len(lines) and lines[end].strip() and (_QUOTE.match(lines[end]) or not _opens(lines[end])):
                end += 1
            out.append("<blockquote>\n" + "\n".join(_blocks([_QUOTE.sub("", x, count=1) for x in lines[at:end]])) + "\n</blockquote>")
            at = end
        elif "|" in line and at + 1 < len(lines) and "-" in lines[at + 1] and _DELIMITER.match(lines[at + 1]):
            end = at + 2
            while end < len(lines) and "|" in lines[end] and lines[end].strip():
                end += 1
            out.append(_table(lines[at], lines[at + 1], lines[at + 2 : end]))
            at = end
        elif _ITEM.match(line):
            end = _list_end(lines, at)
            out.append(_list(lines[at:end]))
            at = end
        else:
            end = at
            while end < len(lines) and lines[end].strip() and (end == at or not _opens(lines[end])):
                end += 1
            out.append(f"<p>{inline(chr(10).join(x.strip() for x in lines[at:end]))}</p>")
            at = end
    return out


def _opens(line: str) -> bool:
    """Whether a line begins another block than a paragraph; lists need a blank line before them."""
    return bool(_FENCE.match(line) or _HEADING.match(line) or _QUOTE.match(line) or _RULE.match(line))


def _cells(row: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", row.strip().removeprefix("|").removesuffix("|"))]


def _table(head: str, delimiter: str, body: list[str]) -> str:
    sides = [{(True, True): "center", (True, False): "left", (False, True): "right"}.get((c.startswith(":"), c.endswith(":")), "") for c in _cells(delimiter)]

    def row(tag: str, line: str) -> str:
        cells = (_cells(line) + [""] * len(sides))[: len(sides)]
        return "<tr>\n" + "\n".join(f'<{tag} style="text-align: {side};">{inline(c)}</{tag}>' if side else f"<{tag}>{inline(c)}</{tag}>" for c, side in zip(cells, sides, strict=True)) + "\n</tr>"

    rows = "\n".join(row("td", line) for line in body)
    return f"<table>\n<thead>\n{row('th', head)}\n</thead>\n<tbody>\n{rows}\n</tbody>\n</table>"


def _list_end(lines: list[str], at: int) -> int:
    """The first line after a list: one that is neither an item of its kind nor indented, after a blank line or a block."""
    first = _ITEM.match(lines[at])
    base, numbered = len(first.group(1)), first.group(2)[0].isdigit()
    end = at + 1
    while end < len(lines):
        line = lines[end]
        if not line.strip():
            following = next((k for k in range(end, len(lines)) if lines[k].strip()), len(lines))
            item = _ITEM.match(lines[following]) if following < len(lines) else None
            if following == len(lines) or not (lines[following].startswith("  ") or item and item.group(2)[0].isdigit() == numbered):
                return end
        elif (item := _ITEM.match(line)) and len(item.group(1)) <= base + 1 and item.group(2)[0].isdigit() != numbered:
            return end
        elif not item and not line.startswith(" ") and _opens(line):
            return end
        end += 1
    return end


def _list(lines: list[str]) -> str:
    base = len(_ITEM.match(lines[0]).group(1))
    items: list[list[str]] = []
    for line in lines:
        item = _ITEM.match(line)
        if item and len(item.group(1)) <= base + 1:
            items.append([item.group(3)])
        else:
            items[-1].append(line)
    loose = any(not line.strip() for item in items[:-1] for line in item)
    numbered = _ITEM.match(lines[0]).group(2)[0].isdigit()
    first = int(re.match(r"\d+", _ITEM.match(lines[0]).group(2)).group()) if numbered else 1
    rendered = []
    for item in items:
        rest = item[1:]
        shift = min((len(x) - len(x.lstrip()) for x in rest if x.strip()), default=0)
        rest = [x[shift:] for x in rest]
        own = next((k for k, x in enumerate(rest) if not x.strip() or _ITEM.match(x) or _opens(x)), len(rest))
        text = inline("\n".join([item[0], *(x.strip() for x in rest[:own])]))
        inner = _blocks(rest[own:])
        rendered.append(f"<li>{f'<p>{text}</p>' if loose else text}" + ("\n" + "\n".join(inner) + "\n" if inner else "") + "</li>")
    tag = "ol" if numbered else "ul"
    start = f' start="{first}"' if numbered and first != 1 else ""
    return f"<{tag}{start}>\n" + "\n".join(rendered) + f"\n</{tag}>"
