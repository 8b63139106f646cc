"""Sentence boundaries in many languages and scripts (problem 3).

Every candidate position is decided by ordered rules, each a pair of regular expressions for the text before and
after it: the first rule that matches says break or no break. The tables cascade: quotations first, then the
paragraph's language, then the script (of the mark itself, where it has one of its own, or of the language), then the
general rules. Paragraphs, separated by blank lines, always end a sentence.

Quotation marks and brackets are paired beforehand, and closing marks belong to the sentence they close. The text
before a position inside a pair that was opened in mid-sentence begins with the character INSIDE, by which the rule
for quotations knows it. In Thai the positions are those of white space as well. Null pages count as empty; blank
pages have no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scriptorium.llm.lexicon import FUNCTION_WORDS

#: Samples are broadcast up to this many ids; beyond it they are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Text shown to a rule on either side of a candidate.
BEFORE, AFTER = 40, 40
#: A pair of quotation marks or brackets spans at most so many characters.
PAIR_SPAN = 600

UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪĮİŁŃŇŌŐŒŘŚŞŠŢŤŪŮŰŲŹŻŽΆ-ΏΑ-ΫЀ-Я"
LOWER = "a-zß-öø-ÿăąćčďđęěğıłńňōőœřśşšţťūůűźżžά-ώа-џґ"
OPENING = "\"'«»„“‘(\\[（「『¿¡"

# Abbreviations. NEVER: what they announce always follows. NUMBERED: no end before a figure.
# LAST: they may end a sentence, and do if a new one starts.
NEVER = {
    "": "Dr dr Prof prof St Mt Mr Mrs Ms Messrs Rev Gen Col Capt Sgt Hon Univ Mme Mlle Sra Sr Srta Dra Dña sig dott prof avv ing Hr Fr Frl dhr mevr д-р проф ул вул им δρ κ डॉ श्री د",
    "en": "i.e e.g cf vs viz ed eds trans esp approx al ca",
    "de": "z.B d.h u.a vgl v bzw ca evtl sog hrsg Hrsg z d",
    "fr": "M MM c.-à-d cf p.ex env",
    "es": "p.ej cf Ud Uds D Da",
    "pt": "p.ex cf V Exa",
    "it": "ad.es cfr p.es es",
    "nl": "bijv d.w.z vgl o.a t.a.v drs ir ing",
    "ru": "т.е см ср напр т гр",
    "uk": "тобто див пор напр т гр",
    "el": "π.χ δηλ βλ πρβλ",
}
NUMBERED = {
    "": "no No nos Nos vol vols Vol p pp P Fig fig Figs figs ch chap sec Sec art n nn nr Nr Bd S Abb Kap t pág págs núm pag pagg fasc blz dl hfst т с стр № рис гл кн σ σελ τ αρ κεφ पृ सं खंड ص ج ع",
}
LAST = {
    "": "etc",
    "en": "a.m p.m Inc Co Ltd Jr Sr B.C A.D",
    "de": "usw usf",
    "it": "ecc",
    "nl": "enz",
    "ru": "т.д т.п др г гг в вв",
    "uk": "т.д т.п ін р рр",
    "el": "κ.λπ κ.ά κ.τ.λ",
    "pt": "etc",
}
GERMAN_MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert Jahrhunderts Jh"
REPORTING = "said|asked|replied|wrote|cried|added|answered"


def _abbreviations(words: str) -> str:
    """One alternative for each abbreviation; white space may follow its inner stops."""
    alternatives = sorted({r"\.\s*".join(re.escape(part) for part in word.split(".")) for word in words.split()}, key=len, reverse=True)
    return rf"(?:^|[\s(\[\"'«»„“‘-])(?:{'|'.join(alternatives)})\.$"


def _rules(*rows: tuple[bool, str, str]) -> tuple[tuple[bool, re.Pattern, re.Pattern], ...]:
    return tuple((decision, re.compile(before), re.compile(after)) for decision, before, after in rows)


#: Stands before the text of a position inside a quotation or bracket that was opened in mid-sentence.
INSIDE = "\x02"

#: The rule for quotations, tried first: what is quoted within a sentence, with its reporting clause, belongs to it.
QUOTED = _rules((False, rf"^{INSIDE}", r""))

#: Rules for all languages, tried last.
GENERAL = _rules(
    (False, r"\d[.,]$", r"\d"),
    (False, r"(?:^|[^.])\.{3}$|…$", rf"\s*[{LOWER}]"),
    (False, rf"(?:^|[\s(\[{OPENING}.-])[{UPPER}][a-z]?\.$", rf"\s?[{UPPER}]\w?\."),
    (False, rf"(?:^|[\s(\[\"'«»„“‘.-])[{UPPER}]\.$", rf"\s+[{UPPER}]"),
    (False, _abbreviations(NEVER[""]), r""),
    (False, _abbreviations(NUMBERED[""]), r"\s*[\d\[IVXLC]"),
    (False, _abbreviations(NUMBERED[""]), rf"\s*[{LOWER}]"),
    (True, _abbreviations(LAST[""]), rf"\s*[{OPENING}]*[{UPPER}]"),
    (False, r"[,;:]$", r""),
    (False, r"", rf"\s*[{LOWER}]"),
    (False, r"", r"\s*[,;:)\]）」』،؛，、]"),
    (True, r"", r"\s"),
    (True, r"", r"$"),
    (True, rf"[{LOWER}\d)\]\"'»”«“’؀-ۿऀ-ॿ][.!?…;]+\S*$", rf"[{OPENING}]*[{UPPER}؀-ۿऀ-ॿ一-鿿ぁ-ヿ฀-๿]"),
    (False, r"", r""),
)

#: What may not follow the end of a sentence.
_FOLLOWS = (False, r"", r"\s*[,;:)\]）」』”،؛，、]")


def _ending(marks: str) -> tuple[tuple[bool, str, str], ...]:
    """The rules of a script whose marks end a sentence without white space."""
    return (_FOLLOWS, (True, rf"[{marks}][.!?…\"'»”“’」』）)\]]*$", r""))


#: Marks that belong to one script; each ends a sentence in it.
SCRIPT_MARKS = {
    "Hani": "。！？｡．‼⁇⁈⁉", "Deva": "।॥", "Arab": "؟۔", "Ethi": "።፧፨", "Mymr": "။", "Khmr": "។៕", "Tibt": "།༎", "Armn": "։", "Mong": "᠃", "Olck": "᱾᱿", "Cans": "᙮", "Java": "꧉",
}

#: Rules of one script, tried after those of the language.
BY_SCRIPT = {script: _rules(*_ending(marks)) for script, marks in SCRIPT_MARKS.items()} | {
    "Hani": _rules(
        (False, r"…+$", r"[^\s”“」』。！？]"),
        (False, r"[。！？][”“\"」』]$", r"\s*(?:[^。！？“”「」]\s*){1,14}?(?:写\s*道|说\s*道|问\s*道|答\s*道|喊\s*道|说|问|答|道)[。！，]"),
        (False, r"[」』”]$", r"\s*(?:と|って|という)"),
        *_ending(SCRIPT_MARKS["Hani"]),
    ),
    # white space ends a sentence unless a digit or a comma stands next to it
    "Thai": _rules((False, r"[,،、]$", r"\s"), (False, r"\d$", r"\s"), (False, r"[^.!?…]$", r"\s+\d"), (True, r"[฀-๿\"'”»)ฯๆ]$", r"\s+\S"), (True, r"[^.!?…]$", r"\s+[฀-๿]")),
}
#: The script that a language's own rules are followed by.
SCRIPT_OF = {"ar": "Arab", "hi": "Deva", "ja": "Hani", "th": "Thai", "zh": "Hani"}
_SCRIPT_OF_MARK = {mark: script for script, marks in SCRIPT_MARKS.items() for mark in marks}

#: Rules of one language, tried before those of its script.
BY_LANGUAGE = {
    "ar": _rules((False, r"(?:^|[\s(])[صجعدمت]\.$", r"")),
    "de": _rules(
        (False, r"(?:^|\s)\d{1,2}\.$", rf"\s*(?:{'|'.join(GERMAN_MONTHS.split())})\b"),
        (False, r"\bv\. ?H\.$", r"\s"),
        (False, _abbreviations(NEVER["de"]), r""),
        (True, _abbreviations(LAST["de"]), rf"\s*[{OPENING}]*[{UPPER}]"),
    ),
    "el": _rules((False, _abbreviations(NEVER["el"]), r""), (True, _abbreviations(LAST["el"]), rf"\s*[{OPENING}]*[{UPPER}]"), (False, rf";$", rf"\s*[{LOWER}]"), (True, r";\S*$", r"\s|$")),
    "en": _rules(
        (False, _abbreviations(NEVER["en"]), r""),
        (False, r"[!?][\"”’']$", rf"\s+[{UPPER}]\w+ (?:{REPORTING})\b"),
        (False, r"\bPh\.$", r"\s?D\."),
        (True, _abbreviations(LAST["en"]), rf"\s*[{OPENING}]*[{UPPER}]"),
    ),
    "es": _rules((False, _abbreviations(NEVER["es"]), r"")),
    "fr": _rules((False, _abbreviations(NEVER["fr"]), r"")),
    "hi": _rules((False, r"(?:^|[\s(])(?:डॉ|पृ|सं|श्री|कु)\.$", r"")),
    "it": _rules((False, _abbreviations(NEVER["it"]), r""), (False, r"\bad es\.$", r""), (True, _abbreviations(LAST["it"]), rf"\s*[{OPENING}]*[{UPPER}]")),
    "nl": _rules((False, _abbreviations(NEVER["nl"]), r""), (True, _abbreviations(LAST["nl"]), rf"\s*[{OPENING}]*[{UPPER}]")),
    "pt": _rules((False, _abbreviations(NEVER["pt"]), r"")),
    "ru": _rules((False, _abbreviations(NEVER["ru"]), r"(?!$)"), (True, _abbreviations(LAST["ru"]), rf"\s*[{OPENING}]*[{UPPER}]")),
    "uk": _rules((False, _abbreviations(NEVER["uk"]), r"(?!$)"), (True, _abbreviations(LAST["uk"]), rf"\s*[{OPENING}]*[{UPPER}]")),
}

_PARAGRAPH_END = re.compile(r"\n(?:[^\S\n]*\n)+")
_MARK = re.compile(r"[«»„“”\"‘()\[\]（）「」『』]|(?<![^\W_])'|'(?![^\W_])")
_TERMINAL = re.compile(rf"[.!?…{''.join(SCRIPT_MARKS.values())}]+")
_GREEK_TERMINAL = re.compile(r"[.!?…;;]+")
_CLOSES = {")": "(", "]": "[", "）": "（", "」": "「", "』": "『", "”": "“„", "“": "„"}
_THAI = re.compile(r"[฀-๿]")
_THAI_GAP = re.compile(r"(?<=[฀-๿\"'”»)ฯๆ])\s+(?=\S)|(?<=\S)\s+(?=[฀-๿])")
_LATIN_WORDS = {lang: frozenset(FUNCTION_WORDS[lang].split()) for lang in ("de", "en", "es", "fr", "it", "nl", "pt")}
_SCRIPTS = (("th", re.compile(r"[฀-๿]")), ("hi", re.compile(r"[ऀ-ॿ]")), ("ar", re.compile(r"[؀-ۿ]")), ("el", re.compile(r"[Ͱ-Ͽἀ-῿]")), ("ru", re.compile(r"[Ѐ-ӿ]")), ("ja", re.compile(r"[ぁ-ヿ]")), ("zh", re.compile(r"[一-鿿]")))
_UKRAINIAN = re.compile(r"[іїєґ]", re.I)


def rule_language(paragraph: str) -> str:
    """The language whose rules a paragraph is read by: by script, and by function words within the Latin one."""
    if not paragraph.isascii():
        counts = {lang: len(pattern.findall(paragraph)) for lang, pattern in _SCRIPTS}
        best = max(counts, key=counts.get)
        if counts["ja"] and counts["ja"] * 8 > counts["zh"]:
            best = "ja" if counts["ja"] + counts["zh"] >= counts[best] else best
        if counts[best] * 3 > sum(map(str.isalpha, paragraph)):
            return "uk" if best == "ru" and _UKRAINIAN.search(paragraph) else best
    words = paragraph.lower().split()
    return max(_LATIN_WORDS, key=lambda lang: (sum(w in _LATIN_WORDS[lang] for w in words), lang == "en"))


def pair_marks(text: str) -> dict[int, int]:
    """Position of each closing mark and of the opening mark it belongs to; marks without a partner are left out."""
    stack: list[tuple[str, int]] = []
    pairs: dict[int, int] = {}
    for m in _MARK.finditer(text):
        mark, at = m.group(), m.start()
        while stack and at - stack[-1][1] > PAIR_SPAN:
            stack.pop()
        top = stack[-1][0] if stack else ""
        if mark in "«»":
            partner = "»" if mark == "«" else "«"
        elif mark in "\"'":
            partner = mark
        else:
            partner = _CLOSES.get(mark, "")
        if top and partner and top in partner:
            pairs[at] = stack.pop()[1]
        elif mark in ")]）」』”":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in partner:
                    pairs[at] = stack[k][1]
                    del stack[k:]
                    break
        elif mark != "'" or at == 0 or not text[at - 1].isalnum():
            stack.append((mark, at))
    return pairs


def paragraph_ends(text: str) -> list[int]:
    """Ends, exclusive, of the sentences of one paragraph, which is stripped of white space."""
    lang = rule_language(text)
    rules = {script: QUOTED + BY_LANGUAGE.get(lang, ()) + BY_SCRIPT.get(script, ()) + GENERAL for script in {SCRIPT_OF.get(lang, ""), "Thai"}}
    pairs = pair_marks(text)
    spans = sorted((start, end) for end, start in pairs.items())
    candidates: list[tuple[int, int]] = [(m.start(), m.end()) for m in (_GREEK_TERMINAL if lang == "el" else _TERMINAL).finditer(text)]
    gaps = set()
    if _THAI.search(text):
        for m in _THAI_GAP.finditer(text):
            candidates.append((m.start(), m.start()))
            gaps.add(m.start())
        candidates.sort()
    ends: list[int] = []
    begin = 0
    near = 0
    for start, end in candidates:
        if end <= begin:
            continue
        while True:  # closing marks belong to the sentence
            space = 1 if end + 1 < len(text) and text[end] in "    " and end + 1 in pairs and text[end + 1] in "»«" else 0
            if end + space in pairs and pairs[end + space] < start:
                end += space + 1
            elif end < len(text) and text[end] in ".!?…" and end > start and text[end - 1] in ")]\"'”»«“’":
                end += 1
            else:
                break
        while near < len(spans) and spans[near][0] < begin - PAIR_SPAN:
            near += 1
        inside = False
        for k in range(near, len(spans)):
            a, b = spans[k]
            if a >= start:
                break
            if b >= end and a > begin and text[begin:a].strip("\"'«»„“‘([（「『 \n\t"):
                inside = True
                break
        script = "Thai" if start in gaps else _SCRIPT_OF_MARK.get(text[start]) or SCRIPT_OF.get(lang, "")
        own = rules.get(script)
        if own is None:
            own = rules[script] = QUOTED + BY_LANGUAGE.get(lang, ()) + BY_SCRIPT[script] + GENERAL
        before, after = text[max(0, end - BEFORE) : end], text[end : end + AFTER]
        decision = next(d for d, x, y in own if x.search(INSIDE + before if inside else before) and y.match(after))
        if decision:
            ends.append(end)
            begin = end
            while begin < len(text) and text[begin].isspace():
                begin += 1
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return ends


def sentence_ends(page: str) -> list[int]:
    """Positions, counted from 1, of the last character of each sentence of a page."""
    out: list[int] = []
    at = 0
    bounds = [(m.start(), m.end()) for m in _PARAGRAPH_END.finditer(page)] + [(len(page), len(page))]
    for stop, following in bounds:
        raw = page[at:stop]
        text = raw.strip()
        if text:
            offset = at + len(raw) - len(raw.lstrip())
            out += [offset + end for end in paragraph_ends(text)]
        at = following
    return out


def split_sentences(page: str) -> list[str]:
    """The sentences of a page, without the white space between them."""
    out, at = [], 0
    for end in sentence_ends(page):
        out.append(page[at:end].strip())
        at = end
    return out


def sentence_positions(records: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """(cache_id, page_no, end_pos): one row for each sentence of each page, of all records or of the sampled ones."""
    chosen = records.select(F.col("cache_id").cast("bigint").alias("cache_id"), "pages")
    if sample is not None:
        ids = sample.where("cache_id IS NOT NULL").select(F.col("cache_id").cast("bigint").alias("cache_id")).distinct()
        few = sample.count() <= MAX_BROADCAST_IDS
        chosen = chosen.join(F.broadcast(ids) if few else ids, "cache_id", "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, ends = [], [], []
            for key, pages in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for number, page in enumerate(pages or [], 1):
                    found = sentence_ends(page or "")
                    keys += [key] * len(found)
                    numbers += [number] * len(found)
                    ends += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()), pa.array(ends, pa.int32())], names=["cache_id", "page_no", "end_pos"])

    return chosen.mapInArrow(read, "cache_id bigint, page_no int, end_pos int")
