"""Noise of scanned pages and typed-off entries (problem 4).

A hidden Markov model labels the lines of a page, and another one those of a typed-off entry, as header, page number,
heading, body or break (the first line of a paragraph) from layout features. All their tables start from fixed values
and are re-estimated by Viterbi training on bounded samples, and the decoded states stand as they are. Words broken at line ends and wrongly recognised letters are judged against the word counts
of the whole corpus: a word is misread if undoing one usual confusion gives a word that is far more frequent.

The words that are broadcast have a relative frequency of at least MIN_SHARE, so there are at most 1 / MIN_SHARE of
them whatever the corpus. Null pages and null entries count as empty text; blank lines are never noise.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scriptorium.llm.common import bounded_sample, cut
from scriptorium.llm.sentences import rule_language

#: Least share of all words that a usual word has, and its least count in a small corpus.
MIN_SHARE, MIN_COUNT = 5e-6, 4
#: A misread word is at least so many times rarer than the word it stands for.
RARER = 100
#: A word that is itself so many times more frequent than the least usual one must be rarer by this factor.
USUAL_TIMES, MUCH_RARER = 10, 300
#: A word stands for another only if that one occurs at least so often.
USUAL_COUNT = 15
#: Pages in the training sample and the longest page in it: bounds on what reaches the driver.
SAMPLE_RECORDS, SAMPLE_CHARS = 1_500, 20_000
#: Entries of more than one line in the training sample.
SAMPLE_ENTRIES = 5_000
#: Weight of the fixed tables in training, in lines.
PRIOR = 400.0
TRAINING_ROUNDS = 2

# What a recogniser makes of what is printed.
CONFUSIONS = (
    ("e", "c"), ("a", "u"), ("n", "ri"), ("i", "l"), ("o", "0"), ("t", "f"), ("l", "1"), ("s", "5"), ("d", "cl"),
    ("u", "ii"), ("h", "li"), ("m", "rn"), ("g", "9"), ("b", "6"), ("w", "vv"), ("rn", "m"), ("ri", "h"), ("i", "1"),
)
HYPHENS = "‐‑¬\u00ad-"

#: Longer lines are no running headers; titles beyond LONG_TITLE are, if they recur or look like nothing else.
LONG_LINE, LONG_TITLE = 130, 44

STATES = ("header", "page_number", "heading", "body", "break")
HEADER, NUMBER, HEADING, BODY, BREAK = range(5)

_WORD = re.compile(r"[^\W_]+")
_OPENING_WORD = re.compile(r"[a-zß-ÿ][.!?] ([A-ZÀ-ÖØ-Þ][a-zß-ÿ]+)(?![:\w])")
_COMPOUND = re.compile(rf"[^\W\d_]+(?:-[^\W\d_]+)+")
_ROMAN = r"(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_NUMBER = rf"(?:\d[\dlIOo]{{0,4}}|[lIO]\d{{1,4}}|{_ROMAN}|{_ROMAN.upper().replace('(?=[IVXLCDM])M', '(?=[IVXLCDM])M')})"
_PAGE_NUMBER = re.compile(rf"([\W_]*)((?:page|p\.|seite|s\.|pág\.|pagina|blz\.)\s*)?({_NUMBER})(?:\s*(?:/|of|von|de)\s*\d{{1,4}})?([\W_]*)", re.I)
_DECORATION = re.compile(r"[^\w\s.,;:!?()%§$€£'\"]|page|p\.", re.I)
_EDGE_NUMBER = re.compile(rf"^\s*{_NUMBER}(?:\s*[|•·–—-]\s*|\s+)(?=\S*[^\W\d_]{{2}}|[A-Z]\s)|(?:\s*[|•·]\s*|\s{{2,}}|(?<=[^\W\d_.,])\s+){_NUMBER}\s*$")
_LEADING = re.compile(rf"^\s*{_NUMBER}\s+[A-ZÀ-ÖØ-Þ0]")
_STRONG_EDGE = re.compile(rf"^\s*{_NUMBER}\s*(?:[|•·–—]|\s\s)|(?:[|•·]\s*|\s{{2,}}){_NUMBER}\s*$")
_NAME = re.compile(r"^(?:(?:de|la|le|von|van|der|den|da|di|ten|al|el|mac|mc|o)[\s'’-]+)*[^\W\d_][\w'’-]+, (?:[^\W\d_]\.\s?)+$|^[^\W\d_][\w'’-]+(?: [^\W\d_][\w'’-]+)?, (?-i:[A-ZÀ-ÖØ-Þ])[\w'’-]+$", re.I)
_CHAPTER = re.compile(r"^(?:chapter|chapitre|kapitel|capítulo|capitolo|hoofdstuk|part|section|глава)\s+[\dIVXLC]+$", re.I)
_REFERENCES = re.compile(r"(?:references|works cited|bibliography|reading list|further reading|literature|sources|literatur|literaturverzeichnis|bibliographie|bibliografía|bibliografia|referencias|références|literatuur)", re.I)
_TERMINAL = re.compile(r"[.!?:;,。！？][\"'»”«“)\]’]*$")
_BROKEN_LINE = re.compile(rf"[^\W\d_][{HYPHENS}][^\S\n]*\n")
_QUOTED = re.compile(r"[\"„“”«»]")
_HEADING_FORM = re.compile(r"[A-ZÀ-ÖØ-Þ0][\w'’-]*(?: (?:And|[A-ZÀ-ÖØ-Þ0][\w'’-]*)){1,4}")
_ROMAN_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
_FULL_STOP = re.compile(r"[^\W\d_]{2}[.!?] [A-ZÀ-ÖØ-Þ]")
_DIGITS = re.compile(r"\d+")
_YEAR_FIRST = re.compile(r"\((?:1[5-9]|20)\d\d[a-z]?\)[.,:]?\s*|(?<=[\s,])(?:1[5-9]|20)\d\d[a-z]?[,.:]\s+(?=\S*[^\W\d_])")
_NUMBERED_ENTRY = re.compile(r"\s*(?:\[\d{1,4}\]|\d{1,4}\.)\s")
_AUTHOR = re.compile(r"\s*(?:\[\d{1,4}\]|\d{1,4}\.)\s+[^,]+,(?:\s*(?:[^\W\d_]\.[\s-]?)+,?)?\s*")
_ENTRY_START = re.compile(r"^\s*(?:(?:\[\d{1,4}\]|\d{1,4}\.)\s+)?(?:(?:de|la|von|van|der|den|da|di|ten|al|el|the)[\s-])*[^\W\d_][^,()]{1,60},? .*")
_BREAK_WORD = re.compile(rf"([^\W\d_][\w'’{HYPHENS}]*)[{HYPHENS}]\s*$")
_LINE_HYPHEN = re.compile(rf"[{HYPHENS}]\s*\n\s*")
_FIRST_WORD = re.compile(r"\s*([^\W\d_][\w'’-]*)")


def looks_german(text: str) -> bool:
    """Whether articles and conjunctions of German are as frequent as in a mostly German text."""
    return 150 * sum(text.count(w) for w in (" der ", " die ", " das ", " den ", " und ")) > len(text)


# ---- words of the corpus ----------------------------------------------------------------------------------------


def _usual_forms(text: str, german: bool) -> Iterator[str]:
    """Words as they count for the corpus: lower-case ones, compounds, first words of sentences, and all of German."""
    for word in _WORD.findall(text):
        if word[0].islower() or german and word[1:].islower():
            yield word.lower()
    if not german:
        for word in _OPENING_WORD.findall(text):
            yield word.lower()
    if "-" in text:
        for word in _COMPOUND.findall(text):
            if word.islower():
                yield word


def word_counts(records: DataFrame, entries: DataFrame) -> DataFrame:
    """(word, n) over all pages and entries; every batch is counted before the shuffle."""
    texts = records.select(F.array_join(F.transform("pages", lambda p: F.coalesce(p, F.lit(""))), "\n").alias("text")).unionAll(entries.select(F.col("raw_entry").alias("text")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    total.update(_usual_forms(text, looks_german(text)))
            if len(total) > 400_000:
                yield out()
                total.clear()
        yield out()

    return texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """Counts of the usual words, and what they say about a word of the text."""

    def __init__(self, counts: dict[str, int], least: float) -> None:
        self.counts, self.least = counts, least
        self.known: dict[str, tuple[int, int] | None] = {}

    def misread(self, word: str) -> tuple[int, int] | None:
        """Place and length of the wrong letter in a lower-case word, or None."""
        if word not in self.known:
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[word] = self._misread(word)
        return self.known[word]

    def repaired(self, word: str) -> str:
        found = self.misread(word)
        return word if found is None else self._best(word)[1]

    def _best(self, word: str) -> tuple[int, str, int, int]:
        best = (0, word, 0, 0)
        for right, wrong in CONFUSIONS:
            at = word.find(wrong)
            while at >= 0:
                other = word[:at] + right + word[at + len(wrong) :]
                n = self.counts.get(other, 0)
                if n > best[0]:
                    best = (n, other, at, len(wrong))
                at = word.find(wrong, at + 1)
        return best

    def _misread(self, word: str) -> tuple[int, int] | None:
        if len(word) < 2 or word.isdigit():
            return None
        own = self.counts.get(word, 0)
        n, _, at, size = self._best(word)
        times = MUCH_RARER if own >= USUAL_TIMES * self.least else RARER
        return (at, size) if n >= max(self.least, USUAL_COUNT) and (own <= 1 or n >= times * own) else None

    def closes(self, first: str, second: str) -> bool:
        """Whether the halves of a broken word are written without the hyphen."""
        if second[:1].isupper():
            return False
        a, b = first.lower(), second.lower()
        together, apart = a + b, f"{a}-{b}"
        one, two = self._count(together), self._count(apart)
        if "-" in a and not one:
            one = self._count(a.rsplit("-", 1)[-1] + b)
        return one >= two if one or two else True

    def _count(self, word: str) -> int:
        own = self.counts.get(word, 0)
        return own or self._best(word)[0]


def lexicon(records: DataFrame, entries: DataFrame) -> Lexicon:
    counts = cut(word_counts(records, entries))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    least = max(MIN_COUNT, MIN_SHARE * total)
    # at most 1 / MIN_SHARE words can reach this share
    return Lexicon({r["word"]: r["n"] for r in counts.where(F.col("n") >= least).collect()}, least)


# ---- lines of a page --------------------------------------------------------------------------------------------


def signature(line: str) -> str:
    """The letters of a line without numbers at its edges, alike for usual confusions."""
    if len(line) > LONG_LINE:
        return ""
    text = _EDGE_NUMBER.sub("", line.strip()).lower()
    for wrong, right in (("0", "o"), ("1", "l"), ("5", "s"), ("9", "g"), ("6", "b"), ("vv", "w"), ("rn", "m"), ("cl", "d"), ("ri", "n"), ("ii", "u"), ("li", "h"), ("i", "l"), ("e", "c"), ("f", "t"), ("u", "a")):
        text = text.replace(wrong, right)
    return "".join(c for c in text if c.isalpha())


def is_page_number(line: str) -> bool:
    found = _PAGE_NUMBER.fullmatch(line.strip())
    if not found:
        return False
    before, word, number, after = found.groups()
    if not before and after.strip() and not word or ")" in after and "(" not in before:
        return False
    return any(map(str.isdigit, number)) or not word and (len(number) > 1 or bool(before.strip()))


def _value(line: str) -> int | None:
    """The number of a page number's line, in figures or Roman letters."""
    if d := _DIGITS.search(line):
        return int(d.group())
    letters = [_ROMAN_VALUES[c] for c in line.lower() if c in _ROMAN_VALUES]
    return sum(-v if v < max(letters[k + 1 :], default=0) else v for k, v in enumerate(letters)) if letters else None


class Page:
    """Features of the lines of one page; blank lines have none."""

    def __init__(self, text: str) -> None:
        self.lines = text.split("\n")
        self.full = [k for k, line in enumerate(self.lines) if line and not line.isspace()]
        edge = {*self.full[:3], *self.full[-2:]}
        self.edge_signatures = {k: signature(self.lines[k]) for k in edge}
        self.broken = bool(_BROKEN_LINE.search(text))
        self.numbers = {k: n for k in edge if is_page_number(self.lines[k]) and (n := _value(self.lines[k])) is not None}


_NUMBER_LETTERS = "0123456789lIOoivxcdmVXLCDM|•·–—-"


def _may_hold_number(line: str) -> bool:
    """Whether a number can stand at an edge of a line, by its outer characters and words; most lines are ruled out."""
    if line[0].isdigit() or line[-1].isdigit() or "|" in line or "•" in line or "·" in line:
        return True
    words = line.split()
    return not (words[0].strip(_NUMBER_LETTERS) and words[-1].strip(_NUMBER_LETTERS))


def _in_capitals(line: str) -> bool:
    letters = [c for c in line if c.isalpha()]
    return len(letters) > 3 and sum(map(str.isupper, letters)) > 0.85 * len(letters)


def _title_case(bare: str) -> int:
    """2 for a title in sentence case, 3 for other short lines that look like a heading."""
    words = [w for w in bare.split() if w[0].isalpha()]
    return 2 if len(words) > 2 and any(w[0].islower() and len(w) > 3 for w in words) else 3


def features(pages: list[Page]) -> list[list[tuple[int, ...]]]:
    """One tuple of small numbers a line: zone, form, recurrence, case, continuation, start, neighbour, scan."""
    seen: Counter[str] = Counter()
    steps: Counter[int] = Counter()
    for p, page in enumerate(pages):
        seen.update({s for s in page.edge_signatures.values() if len(s) > 3})
        steps.update({n - p for n in page.numbers.values()})
    counted = max(steps.values(), default=0) > 1
    scanned = int(counted or any(page.broken or any(_DECORATION.search(page.lines[k]) for k in page.numbers) or any(_STRONG_EDGE.search(page.lines[k]) or _CHAPTER.match(page.lines[k].strip()) for k in page.edge_signatures) for page in pages))
    out = []
    listed = False
    for p, page in enumerate(pages):
        rows, lines, full = [], page.lines, page.full
        sizes = sorted(len(lines[k]) for k in full)
        width = sizes[-1 - len(sizes) // 6] if sizes else 0  # a few lines may be longer than the text is wide
        for j, k in enumerate(full):
            line = lines[k].strip()
            back = len(full) - 1 - j
            zone = j if j < 3 else 4 if back == 0 else 5 if back == 1 else LISTED if listed else 3
            if back == 0 and j:
                zone = 4
            following = lines[full[j + 1]].strip() if back else ""
            before = lines[full[j - 1]].rstrip() if j else ""
            blank = k > 0 and (not lines[k - 1] or lines[k - 1].isspace())
            start = 2 if blank or j == 0 else 1 if lines[k][:1].isspace() or len(before) < 0.75 * width and _TERMINAL.search(before) else 0
            goes_on = int(following[:1].islower())
            if len(line) > LONG_LINE or zone in INNER and len(line) > max(0.85 * width, 24):
                rows.append((zone, 2, 0, 4, goes_on, start, 0, scanned))  # as wide as the text: no running line has this form
                continue
            if len(line) < 40 and _REFERENCES.fullmatch(line):
                listed = True
                rows.append((zone, 2, 0, LIST_TITLE, goes_on, start, int(blank), scanned))
                continue
            if len(line) < 40 and is_page_number(line):
                near = int(any(is_page_number(x) or len(x) < 14 and (any(map(str.isdigit, x)) or not any(map(str.isalpha, x))) for x in (before.strip(), following) if x))
                # set apart by decoration, or by standing between the lines of a list's entries
                form = 0 if _DECORATION.search(line) or listed and j and back and not near else 3
                row = (zone, form, 2 if steps[page.numbers.get(k, -(10**6)) - p] > 1 else 0, 4, 0, start, near, scanned)
            else:
                edge = _may_hold_number(line)
                strong = edge and _STRONG_EDGE.search(line) is not None and sum(map(str.isalpha, line)) > 3
                weak = edge and _EDGE_NUMBER.search(line) is not None and sum(map(str.isalpha, line)) > 3
                chapter = edge and _CHAPTER.match(line) is not None
                bare = line if chapter or not edge else _EDGE_NUMBER.sub("", line, count=1).strip()
                if bare[:1] == "0":
                    bare = "O" + bare[1:]
                leads = weak and bare[:1].isupper() and _LEADING.match(line) is not None
                if (line[1:4].upper() == line[1:4] or line[-4:].upper() == line[-4:]) and _in_capitals(line):
                    case = 0
                elif "," in bare and _NAME.match(bare) or chapter or weak and _REFERENCES.fullmatch(bare):
                    case = 1
                elif strong and bare[:1].isupper() and not _TERMINAL.search(bare):
                    case = _title_case(bare)
                elif bare[:1].isupper() and not _TERMINAL.search(bare) and len(line) < 0.85 * max(width, 50) and len(lines[k].rstrip()) + 1 + len((following.split() or [""])[0]) < 0.92 * width:
                    case = _title_case(bare)
                elif bare[:1].isupper() and not _TERMINAL.search(bare) and ":" in bare and following[:1].isupper() and not _QUOTED.search(bare):
                    case = _title_case(bare)
                else:
                    case = 4
                form = 1 if strong and case < 4 or weak and case < 2 or leads and case < 4 else 2
                alone = seen[page.edge_signatures.get(k, "")] <= 1
                if case in (2, 3) and form == 2 and alone:
                    if _FULL_STOP.search(bare) or len(line) > LONG_TITLE and ":" not in bare and following[:1].islower():
                        case = 4  # the first line of a page that goes on
                    elif case == 2 and p == 0 and j == 0 and (own := rule_language(bare)) != "en" and own == rule_language(" ".join(lines[1:12])):
                        case = 3  # a heading in the language of its text
                recur = min(2, seen[page.edge_signatures.get(k, "")] - 1) if len(page.edge_signatures.get(k, "")) > 3 else 0
                row = (zone, form, max(0, recur), case, int(following[:1].islower() if back else case in (2, 3) and not _TERMINAL.search(before)), start, int(blank or back > 0 and k + 1 < len(lines) and not lines[k + 1].strip()), scanned)
            rows.append(row)
        out.append(rows)
    return out


def entry_features(lines: list[str]) -> list[tuple[int, ...]]:
    """The same features for the lines of a typed-off entry; blank lines have none."""
    full = [line.strip() for line in lines if line and not line.isspace()]
    out = []
    for j, line in enumerate(full):
        back = len(full) - 1 - j
        following = full[j + 1] if back else ""
        form, case = 2, 4
        if len(line) <= LONG_LINE and j and back:
            if is_page_number(line):
                form = STOPPED if line.endswith(".") else 0 if _DECORATION.search(line) else 3
            elif _REFERENCES.fullmatch(line):
                case = LIST_TITLE
            elif _EDGE_NUMBER.search(line) and (rest := _EDGE_NUMBER.sub("", line).strip(" |•·–—-")):
                case = 1 if _REFERENCES.fullmatch(rest) else 0 if rest.isupper() else 3 if _STRONG_EDGE.search(line) and not _TERMINAL.search(line) else 4
                form = 1 if case < 4 else 2
        out.append((0 if not j else 3 if back else 4, form, 0, case, int(following[:1].islower()), 2 if not j else 0, 0, 1))
    return out


#: Zones of lines that stand neither at the head nor at the foot of a page, the latter in a list of references; the
#: form of a number with a full stop; the case of a line that is the title of a list of references.
LISTED, STOPPED, LIST_TITLE = 6, 4, 5
INNER = (3, LISTED)

#: Fixed starting values: probabilities of each feature's values by state (header, number, heading, body, break).
START_TABLES = (
    ((0.60, 0.06, 0.01, 1e-6, 0.26, 0.05, 0.02), (0.22, 0.05, 0.03, 1e-6, 0.57, 0.08, 0.05), (0.35, 0.25, 0.1, 0.18, 0.05, 0.05, 0.02), (0.05, 0.06, 0.07, 0.6, 0.07, 0.07, 0.08), (0.05, 0.1, 0.1, 0.57, 0.05, 0.05, 0.08)),
    ((1e-5, 0.55, 0.45, 1e-6, 1e-6), (0.62, 1e-4, 1e-4, 0.38, 1e-6), (1e-4, 0.01, 0.98, 1e-4, 1e-5), (2e-4, 1e-3, 0.99, 0.008, 1e-4), (2e-4, 1e-3, 0.99, 0.002, 1e-4)),
    ((0.28, 0.32, 0.40), (0.45, 0.05, 0.50), (0.96, 0.035, 0.005), (0.988, 0.01, 0.002), (0.988, 0.01, 0.002)),
    ((0.42, 0.26, 0.26, 0.056, 0.004, 1e-5), (1e-3, 1e-3, 1e-3, 1e-3, 0.996, 1e-6), (0.03, 0.005, 0.1, 0.755, 0.01, 0.1), (1e-3, 2e-3, 0.04, 0.03, 0.927, 1e-6), (1e-3, 5e-3, 0.05, 0.04, 0.904, 1e-6)),
    ((0.55, 0.45), (0.8, 0.2), (0.97, 0.03), (0.45, 0.55), (0.5, 0.5)),
    ((0.35, 0.05, 0.6), (0.5, 0.1, 0.4), (0.15, 0.1, 0.75), (0.93, 0.05, 0.02), (0.02, 0.48, 0.5)),
    ((0.68, 0.32), (0.97, 0.03), (0.4, 0.6), (0.9, 0.1), (0.85, 0.15)),
    ((0.03, 0.97), (0.03, 0.97), (0.75, 0.25), (0.7, 0.3), (0.7, 0.3)),
)
START_MOVES = (
    (0.02, 0.08, 0.25, 0.45, 0.2),
    (0.1, 0.01, 0.19, 0.5, 0.2),
    (0.01, 0.01, 0.03, 0.35, 0.6),
    (0.02, 0.05, 0.02, 0.76, 0.15),
    (0.02, 0.04, 0.02, 0.8, 0.12),
)
START_FIRST = (0.35, 0.05, 0.2, 0.25, 0.15)
#: The same for the lines of an entry, which begins with a break and has no headings.
ENTRY_TABLES = (
    ((0.01, 0, 0, 0.98, 0.01, 0, 0), (0.01, 0, 0, 0.98, 0.01, 0, 0), (0.2, 0, 0, 0.6, 0.2, 0, 0), (0.02, 0, 0, 0.4, 0.58, 0, 0), (0.98, 0, 0, 0.01, 0.01, 0, 0)),
    ((1e-5, 0.88, 0.12, 1e-6, 1e-6), (0.62, 1e-4, 1e-4, 0.38, 1e-5), (1e-4, 0.01, 0.98, 1e-4, 1e-5), (2e-4, 1e-3, 0.989, 2e-3, 8e-3), (2e-4, 1e-3, 0.99, 0.002, 1e-4)),
    ((1, 0, 0),) * 5,
    ((0.4, 0.3, 0, 0.1, 0.05, 0.15), (1e-3, 1e-3, 1e-3, 1e-3, 0.996, 1e-6), (0.1, 0.1, 0, 0.5, 0.2, 0.1), (2e-3, 1e-5, 0, 5e-3, 0.993, 1e-6), (1e-3, 1e-5, 0, 5e-3, 0.993, 1e-6)),
    ((0.5, 0.5), (0.5, 0.5), (0.9, 0.1), (0.5, 0.5), (0.5, 0.5)),
    ((0.98, 0, 0.02), (0.98, 0, 0.02), (0.5, 0, 0.5), (0.98, 0, 0.02), (0.02, 0, 0.98)),
    ((1, 0),) * 5,
    ((0, 1),) * 5,
)
ENTRY_MOVES = (
    (0.01, 0.02, 0.001, 0.959, 0.01),
    (0.02, 0.01, 0.001, 0.959, 0.01),
    (0.01, 0.01, 0.001, 0.969, 0.01),
    (0.04, 0.06, 0.001, 0.889, 0.01),
    (0.04, 0.06, 0.001, 0.889, 0.01),
)
ENTRY_FIRST = (0.004, 0.004, 0.002, 0.01, 0.98)
#: Least probability in a table.
FLOOR = 1e-9
#: Lines of pages that are decoded at once; a longer page is decoded alone.
DECODED_LINES = 200_000


class LineModel:
    """A hidden Markov model over lines, with independent features in each state."""

    def __init__(self, tables: tuple = START_TABLES, moves: tuple = START_MOVES, first: tuple = START_FIRST) -> None:
        self.start = [np.array(table, float) for table in tables]
        self.start_moves, self.first = np.array(moves), np.array(first)
        self.tables, self.moves = self.start, self.start_moves
        self._finish()

    def _finish(self) -> None:
        self.log_tables = [np.log(np.maximum(table, FLOOR)) for table in self.tables]
        self.log_moves, self.log_first = np.log(np.maximum(self.moves, FLOOR)), np.log(np.maximum(self.first, FLOOR))
        self.seen: dict[tuple[int, ...], int] = {}
        self.scores: list[np.ndarray] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}, "scores": []}

    def _number(self, row: tuple[int, ...]) -> int:
        """The place of a row of features among those met so far, whose scores are kept."""
        at = self.seen.get(row)
        if at is None:
            at = self.seen[row] = len(self.scores)
            self.scores.append(sum(table[:, v] for table, v in zip(self.log_tables, row, strict=True)))
        return at

    def label(self, rows: list[tuple[int, ...]]) -> list[int]:
        """The likeliest states of a sequence of lines."""
        return self.label_all([rows])[0]

    def label_all(self, sequences: list[list[tuple[int, ...]]]) -> list[list[int]]:
        """The likeliest states of every sequence; sequences of about one length are decoded side by side."""
        out: list[list[int]] = [[] for _ in sequences]
        order = sorted((k for k, rows in enumerate(sequences) if rows), key=lambda k: len(sequences[k]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and len(sequences[order[stop]]) * (stop - at + 1) <= DECODED_LINES and len(sequences[order[stop]]) <= 2 * len(sequences[order[at]]) + 8:
                stop += 1
            self._decode([sequences[k] for k in order[at:stop]], order[at:stop], out)
            at = stop
        return out

    def _decode(self, sequences: list[list[tuple[int, ...]]], places: list[int], out: list[list[int]]) -> None:
        sizes = np.array([len(rows) for rows in sequences])
        n = int(sizes.max())
        numbers = np.zeros((len(sequences), n), np.int32)
        for k, rows in enumerate(sequences):
            numbers[k, : len(rows)] = [self._number(row) for row in rows]
        emission = np.array(self.scores)[numbers]
        score = self.log_first + emission[:, 0]
        back = np.zeros((len(sequences), n, len(STATES)), np.int8)
        last = np.where((sizes == 1)[:, None], score, 0.0)
        for t in range(1, n):
            reached = score[:, :, None] + self.log_moves
            back[:, t] = reached.argmax(1)
            score = reached.max(1) + emission[:, t]
            ends = sizes == t + 1
            last[ends] = score[ends]
        state = last.argmax(1)
        path = np.zeros((len(sequences), n), np.int8)
        every = np.arange(len(sequences))
        for t in range(n - 1, -1, -1):
            inside = sizes > t
            path[inside, t] = state[inside]
            state = np.where(inside & (t > 0), back[every, t, state], state)
        for k, place in enumerate(places):
            out[place] = path[k, : sizes[k]].tolist()

    def train(self, sample: list[list[tuple[int, ...]]], rounds: int = TRAINING_ROUNDS) -> LineModel:
        """Viterbi training: label the sample, count in every table, and mix with the fixed values."""
        sample = [rows for rows in sample if rows]
        flat = np.array([row for rows in sample for row in rows], int).reshape(-1, len(self.start))
        inner = np.cumsum([len(rows) for rows in sample])[:-1]
        for _ in range(rounds):
            states = np.array([s for path in self.label_all(sample) for s in path], int)
            self.tables = []
            for k, start in enumerate(self.start):
                counts = np.zeros_like(start)
                np.add.at(counts, (states, flat[:, k]), 1.0)
                self.tables.append((counts + PRIOR * start) / (counts.sum(1) + PRIOR * start.sum(1))[:, None])
            moved = np.zeros_like(self.start_moves)
            if len(states) > 1:
                within = np.ones(len(states) - 1, bool)
                within[inner - 1] = False
                np.add.at(moved, (states[:-1][within], states[1:][within]), 1.0)
            self.moves = (moved + PRIOR * self.start_moves) / (moved.sum(1) + PRIOR * self.start_moves.sum(1))[:, None]
            begun = np.bincount(states[np.concatenate([[0], inner])] if len(states) else [], minlength=len(STATES))
            self.first = (begun + PRIOR * np.array(self.first)) / (begun.sum() + PRIOR)
            self._finish()
        return self


def entry_model() -> LineModel:
    """The model of an entry's lines before any training."""
    return LineModel(ENTRY_TABLES, ENTRY_MOVES, ENTRY_FIRST)


def page_sequences(documents: list[list[str]]) -> list[list[tuple[int, ...]]]:
    return [rows for pages in documents for rows in features([Page(p) for p in pages])]


def parts(batch: pa.RecordBatch, size: int = 200) -> Iterator[tuple[list, list]]:
    """The columns of a batch, some records at a time."""
    for at in range(0, batch.num_rows, size):
        piece = batch.slice(at, size)
        yield piece.column(0).to_pylist(), piece.column(1).to_pylist()


# ---- noise ------------------------------------------------------------------------------------------------------


def _is_start(text: str, at: int) -> bool:
    """Whether a sentence starts at this place."""
    k = at - 1
    while k >= 0 and text[k] in " \t\"'«»„“‘(¿¡":
        k -= 1
    if k < 0:
        return True
    if text[k] == "\n":
        head = text[:k].rstrip(" \t")
        return not head or head[-1] in "\n.!?"
    return text[k] in ".!?:"


def misread_lines(text: str, words: Lexicon, german: bool, spans: list[tuple[int, int]]) -> set[int]:
    """Lines, from 0, of the spans of a text that have a misread word; words broken over two lines are read as one."""
    places: list[int] = []
    broken = _BROKEN_LINE.search(text) is not None
    known, misread = words.known, words.misread
    for begin, end in spans:
        skip = -1
        for m in _WORD.finditer(text, begin, end):
            word = m.group()
            start, stop = m.span()
            ends_line = broken and stop < len(text) and text[stop] in HYPHENS
            if not ends_line and start >= skip and word in known and known[word] is None:
                continue
            if start < skip or word[0].isdigit() and start and text[start - 1] in ".,":
                continue
            if word[0].isupper():
                if word.isupper() and len(word) > 1 or not (german or start == begin or _is_start(text, start)):
                    continue
            follow = _LINE_HYPHEN.match(text, stop) if ends_line else None
            if follow and (second := _WORD.match(text, follow.end())) and second.group()[0].islower():
                skip = second.end()
                joined = word + second.group()
                hit = misread(joined.lower())
                if hit is None and words.counts.get(joined.lower(), 0) == 0:
                    hit = misread(word.lower()) if len(word) > 3 and words.counts.get(f"{words.repaired(word.lower())}-{second.group()}", 0) else None
                    if hit is None and words.counts.get(f"{word.lower()}-{words.repaired(second.group())}", 0) and misread(second.group()):
                        places.append(second.start())
                        continue
                if hit:
                    places.append(start if hit[0] < len(word) else second.start())
            elif misread(word.lower()):
                places.append(start)
    if not places:
        return set()
    ends = [m.start() for m in re.finditer("\n", text)]
    lines = {bisect_left(ends, at) for at in places}
    return {k for k in lines if _readable(text[ends[k - 1] + 1 if k else 0 : ends[k] if k < len(ends) else len(text)], words)}


def _readable(line: str, words: Lexicon) -> bool:
    """Whether a line is text at all: mostly letters, and its other lower-case words mostly usual ones."""
    dense = "".join(line.split())
    if 2 * sum(map(str.isalnum, dense)) < len(dense):
        return False
    others = [w for w in _WORD.findall(line) if len(w) > 2 and w[0].islower() and words.misread(w) is None]
    return 5 * sum(w in words.counts for w in others) >= 2 * len(others)


def title_spans(text: str, begin: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Where an entry's title can stand: after the year, or after the author of a numbered entry."""
    end = len(text) if end is None else end
    numbered = _AUTHOR.match(text, begin, end)
    year = _YEAR_FIRST.search(text, begin, end)
    if numbered and not (year and year.start() - begin < 0.5 * (end - begin)):
        return [(numbered.end(), end)]
    if year:
        return [(year.end(), end)]
    first = text.find(",", begin, end)
    return [(first + 1, end)] if first >= 0 else []


def broken_words(lines: list[str], order: list[int], words: Lexicon) -> set[int]:
    """Lines that end inside a word written without hyphen; ``order`` has the lines of the running text."""
    out = set()
    for k, following in zip(order, order[1:]):
        line = lines[k]
        tail = line.rstrip()
        if tail and tail[-1] in HYPHENS and (m := _BREAK_WORD.search(tail)) and (n := _FIRST_WORD.match(lines[following])):
            if words.closes(m.group(1).strip(HYPHENS), n.group(1)):
                out.add(k)
    return out


def entry_states(texts: list[str | None], model: LineModel) -> list[dict[int, int]]:
    """The states of the lines of every entry, blank ones left out."""
    cut_up = [(text or "").split("\n") for text in texts]
    # a line by itself can only be the entry
    labelled = model.label_all([entry_features(lines) if len(lines) > 1 else [] for lines in cut_up])
    return [dict(zip([k for k, line in enumerate(lines) if line and not line.isspace()], states or [BREAK], strict=True)) if text and not text.isspace() else {} for text, lines, states in zip(texts, cut_up, labelled, strict=True)]


def entry_noise(text: str | None, words: Lexicon, model: LineModel | None = None, states: dict[int, int] | None = None) -> list[tuple[int, str]]:
    """(line_no, kind) of the noise in a typed-off entry."""
    if states is None:
        states = entry_states([text], model or entry_model())[0]
    if not states:
        return []
    lines = text.split("\n")
    out = [(k + 1, STATES[s]) for k, s in states.items() if s in (HEADER, NUMBER)]
    body = [k for k, s in states.items() if s not in (HEADER, NUMBER)]
    out += [(k + 1, "hyphen") for k in broken_words(lines, body, words)]
    clean = "\n".join(lines[k] for k in body)
    out += [(body[k] + 1, "misread") for k in misread_lines(clean, words, False, title_spans(clean))]
    return out


def all_page_states(records: list[list[str | None] | None], model: LineModel) -> list[list[tuple[Page, dict[int, int]]]]:
    """Every record's pages with the states of their lines."""
    read = [[Page(p or "") for p in pages or []] for pages in records]
    rows = [features(pages) for pages in read]
    labelled = iter(model.label_all([own for pages in rows for own in pages]))
    return [[(page, dict(zip(page.full, next(labelled), strict=True))) for page in pages] for pages in read]


def page_states(pages: list[str | None], model: LineModel) -> list[tuple[Page, dict[int, int]]]:
    return all_page_states([pages], model)[0]


def record_noise(pages: list[str | None] | None, words: Lexicon, model: LineModel) -> list[tuple[int, int, str]]:
    """(page_no, line_no, kind) of the noise of a record's pages."""
    return noise_of(page_states(pages or [], model), words)


def noise_of(read: list[tuple[Page, dict[int, int]]], words: Lexicon) -> list[tuple[int, int, str]]:
    """(page_no, line_no, kind) of the noise of pages whose lines have their states."""
    out: list[tuple[int, int, str]] = []
    order: list[tuple[int, int]] = []
    active = False
    for p, (page, states) in enumerate(read):
        for k, s in states.items():
            if s in (HEADER, NUMBER):
                out.append((p + 1, k + 1, STATES[s]))
                continue
            order.append((p, k))
            # the words of a heading are capitalised without being names
            if (s == HEADING or s == BREAK and _HEADING_FORM.fullmatch(page.lines[k].strip())) and any(words.misread(w.lower()) for w in _WORD.findall(page.lines[k]) if len(w) > 3 and not w.isupper() and not w.isdigit()):
                out.append((p + 1, k + 1, "misread"))
    flat = [read[p][0].lines[k] for p, k in order]
    out += [(order[i][0] + 1, order[i][1] + 1, "hyphen") for i in broken_words(flat, list(range(len(flat))), words)]
    if not flat:
        return out
    text = "\n".join(flat)
    german = looks_german(text)
    cited: set[int] = set()
    for i, line in enumerate(flat):
        bare = line.strip()
        if _REFERENCES.fullmatch(bare):
            active = True
        elif active:
            cited.add(i)
    starts = [0]
    for line in flat:
        starts.append(starts[-1] + len(line) + 1)
    spans, entry = [], None
    for i, line in enumerate(flat):
        begin, end = starts[i], starts[i + 1] - 1
        if i not in cited:
            if spans and spans[-1][1] == begin - 1 and (not cited or i - 1 not in cited):
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((begin, end))
    if cited:
        entry, ends = None, max(cited)
        for i in range(min(cited), ends + 1):
            opens = _ENTRY_START.match(flat[i]) and flat[i][:1].strip() and (_NUMBERED_ENTRY.match(flat[i]) or i == min(cited) or re.search(r"[.\d/]$", flat[i - 1].rstrip()) is not None)
            if entry is None or opens:
                if entry is not None:
                    spans += title_spans(text, entry, starts[i] - 1)
                entry = starts[i]
        spans += title_spans(text, entry, starts[ends + 1] - 1)
    out += [(order[i][0] + 1, order[i][1] + 1, "misread") for i in misread_lines(text, words, german, sorted(spans))]
    return list(dict.fromkeys(out))


def repaired_text(pages: list[str | None] | None, words: Lexicon, model: LineModel) -> str:
    """Paragraphs of continuous text: headers and numbers gone, broken words closed, misread words put right."""
    return text_of(page_states(pages or [], model), words)


def text_of(read: list[tuple[Page, dict[int, int]]], words: Lexicon) -> str:
    out: list[str] = []
    for page, states in read:
        for k, s in states.items():
            line = page.lines[k].strip()
            if s in (HEADER, NUMBER):
                continue
            if s in (HEADING, BREAK) or not out:
                out.append(line)
                continue
            before = out[-1]
            if before and before[-1] in HYPHENS and (m := _BREAK_WORD.search(before)) and (n := _FIRST_WORD.match(line)):
                out[-1] = (before[:-1] if words.closes(m.group(1), n.group(1)) else before) + line
            else:
                out[-1] = f"{before} {line}"
    return "\n\n".join(_WORD.sub(lambda m: words.repaired(m.group()) if m.group()[0].islower() or m.group()[0].isdigit() else m.group(), t) for t in out)


def trained_models(records: DataFrame, entries: DataFrame) -> tuple[LineModel, LineModel]:
    """The models of the lines of pages and of entries, each trained on a bounded sample."""
    size = F.aggregate("pages", F.lit(0), lambda n, p: n + F.coalesce(F.length(p), F.lit(0)))
    pages = records.where(F.col("pages").isNotNull() & (size > 0) & (size <= SAMPLE_CHARS))
    documents = [[p or "" for p in r["pages"]] for r in bounded_sample(pages, "cache_id", SAMPLE_RECORDS, pages.count()).select("pages").collect()]
    lined = entries.where(F.contains("raw_entry", F.lit("\n")) & (F.length("raw_entry") <= SAMPLE_CHARS))
    texts = [r["raw_entry"] for r in bounded_sample(lined, "entry_id", SAMPLE_ENTRIES, lined.count()).select("raw_entry").collect()]
    return LineModel().train(page_sequences(documents)), entry_model().train([entry_features(t.split("\n")) for t in texts])


def find_noise(records: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct (source, record_id, page_no, line_no, kind)."""
    spark = records.sparkSession
    shared = spark.sparkContext.broadcast((lexicon(records, entries), *trained_models(records, entries)))
    schema = "source string, record_id bigint, page_no int, line_no int, kind string"
    names = ["source", "record_id", "page_no", "line_no", "kind"]
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string())

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model, _ = shared.value
        for batch in batches:
            for keys, pages in parts(batch):
                yield rows_of([("page", key, p, k, kind) for key, read in zip(keys, all_page_states(pages, model), strict=True) for p, k, kind in set(noise_of(read, words))])

    def of_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _, model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield rows_of([("entry", key, 0, k, kind) for key, text, states in zip(batch.column(0).to_pylist(), texts, entry_states(texts, model), strict=True) for k, kind in set(entry_noise(text, words, states=states))])

    pages = records.select(F.col("cache_id").cast("bigint"), "pages").mapInArrow(of_pages, schema)
    return pages.unionAll(entries.select(F.col("entry_id").cast("bigint"), "raw_entry").mapInArrow(of_entries, schema)).distinct()


def repaired_entry(text: str | None, words: Lexicon, states: dict[int, int] | None = None) -> str:
    """A typed-off entry as continuous text: noise lines gone, broken words closed, misread words of its title put right."""
    if not text or text.isspace():
        return ""
    if states is None:
        states = entry_states([text], entry_model())[0]
    lines = text.split("\n")
    kept = [lines[k].strip() for k, s in states.items() if s not in (HEADER, NUMBER)]
    if not kept:
        return ""
    out = kept[0]
    for line in kept[1:]:
        out = _continued(out, line, words)
    begin = 0
    done = []
    for start, end in title_spans(out):
        done += [out[begin:start], _put_right(out, words, start, end)]
        begin = end
    return "".join([*done, out[begin:]])


def _continued(before: str, line: str, words: Lexicon) -> str:
    """Running text with the next line, a word broken between them closed or left as a compound."""
    if before and before[-1] in HYPHENS and (m := _BREAK_WORD.search(before)) and (n := _FIRST_WORD.match(line)):
        return (before[:-1] if words.closes(m.group(1).strip(HYPHENS), n.group(1)) else before) + line
    return f"{before} {line}"


def _put_right(text: str, words: Lexicon, start: int, end: int) -> str:
    """A part of a text with its misread words put right; names and all but the first words of sentences keep capitals."""
    out, at = [], start
    for m in _WORD.finditer(text, start, end):
        word, begin = m.group(), m.start()
        right = None
        if word[0].isdigit() and begin and text[begin - 1] in ".,":
            continue
        if word[0].isupper():
            if (len(word) == 1 or not word.isupper()) and (begin == start or _is_start(text, begin)) and words.misread(word.lower()):
                right = words.repaired(word.lower())
                right = right[:1].upper() + right[1:]
        elif words.misread(word.lower()):
            right = words.repaired(word.lower())
        if right is not None:
            out += [text[at:begin], right]
            at = m.end()
    repaired = "".join([*out, text[at:end]])
    return repaired if out and _readable(text[start:end], words) else text[start:end]


def repair_texts(records: DataFrame, entries: DataFrame) -> DataFrame:
    """(source, record_id, text): every record of pages and every entry as continuous text."""
    shared = records.sparkSession.sparkContext.broadcast((lexicon(records, entries), *trained_models(records, entries)))
    schema = "source string, record_id bigint, text string"

    def rows_of(source: str, keys: pa.Array, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([source] * len(texts), pa.string()), keys, pa.array(texts, pa.string())], names=["source", "record_id", "text"])

    def of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model, _ = shared.value
        for batch in batches:
            for keys, pages in parts(batch):
                yield rows_of("page", pa.array(keys, pa.int64()), [text_of(read, words) for read in all_page_states(pages, model)])

    def of_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _, model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield rows_of("entry", batch.column(0), [repaired_entry(text, words, states) for text, states in zip(texts, entry_states(texts, model), strict=True)])

    pages = records.select(F.col("cache_id").cast("bigint"), "pages").mapInArrow(of_pages, schema)
    return pages.unionAll(entries.select(F.col("entry_id").cast("bigint"), "raw_entry").mapInArrow(of_entries, schema))


def repair_pages(records: DataFrame, entries: DataFrame) -> DataFrame:
    """(cache_id, text): every record as continuous paragraphs."""
    return repair_texts(records, entries).where("source = 'page'").select(F.col("record_id").alias("cache_id"), "text")
