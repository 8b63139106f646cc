"""Two-level taxonomies of concepts, their patterns and their variants."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Rows of a taxonomy table that may reach the driver: patterns become part of the plan.
MAX_CONCEPTS = 5_000


@dataclass(frozen=True)
class Taxonomy:
    """Frames in order, each with its concepts and their alternatives (regular expressions without word ends)."""

    frames: tuple[tuple[str, tuple[tuple[str, tuple[str, ...]], ...]], ...]

    @classmethod
    def of(cls, frames: Mapping[str, Mapping[str, Iterable[str]]]) -> Taxonomy:
        return cls(tuple((frame, tuple((c, tuple(v)) for c, v in concepts.items())) for frame, concepts in frames.items()))

    @classmethod
    def from_table(cls, table: DataFrame) -> Taxonomy:
        """From rows (frame, frame_ord, concept, concept_ord, variants)."""
        rows = table.orderBy("frame_ord", "concept_ord", "frame", "concept").limit(MAX_CONCEPTS + 1).collect()
        if len(rows) > MAX_CONCEPTS:
            raise ValueError(f"a taxonomy of more than {MAX_CONCEPTS} concepts can't be part of a plan")
        frames: dict[str, dict[str, list[str]]] = {}
        for r in rows:
            frames.setdefault(r["frame"], {})[r["concept"]] = [v for v in r["variants"] or [] if v]
        return cls.of({f: {c: v for c, v in concepts.items() if v} for f, concepts in frames.items()})

    @property
    def frame_order(self) -> list[str]:
        return [frame for frame, _ in self.frames]

    @property
    def concepts(self) -> list[str]:
        return [c for _, concepts in self.frames for c, _ in concepts]

    @property
    def frame_of(self) -> dict[str, str]:
        return {c: frame for frame, concepts in self.frames for c, _ in concepts}

    @property
    def patterns(self) -> dict[str, tuple[str, ...]]:
        return {c: v for _, concepts in self.frames for c, v in concepts}

    def with_forms(self, forms: Mapping[str, Mapping[str, Iterable[str]]]) -> Taxonomy:
        """A copy with alternatives added by frame and concept; unknown concepts are new ones."""
        out = {frame: {c: list(v) for c, v in concepts} for frame, concepts in self.frames}
        for frame, concepts in forms.items():
            for concept, variants in concepts.items():
                out[frame].setdefault(concept, []).extend(variants)
        return Taxonomy.of(out)


def pattern_of(variants: Iterable[str], flags: str = "iU") -> str:
    """One alternation between word boundaries, by default without regard to case, over all of Unicode."""
    return rf"(?{flags})\b(?:{'|'.join(variants)})\b"


def _outside_groups(variant: str) -> str:
    while (inner := re.sub(r"\((?:\\.|[^()\\])*\)", "", variant)) != variant:
        variant = inner
    return variant


def counting_pattern(variants: Iterable[str]) -> str:
    """A pattern for folded text with as many matches as the alternation has, which begins with letters if it can.

    Alternatives that are single words with a common beginning are searched by that beginning, which the engine finds
    by skipping; what stands around it is looked at only there. A match inside another is impossible for single words.
    """
    variants = tuple(variants)
    starts = [literal_start(v) for v in variants]
    stem = starts[0] if starts else ""
    while stem and not all(s.startswith(stem) for s in starts):
        stem = stem[:-1]
    if len(stem) >= 3 and all(re.fullmatch(r"[a-z?():|]+", v) for v in variants):
        return rf"(?U){stem}(?<=\b(?=(?:{'|'.join(variants)})\b){stem})"
    return pattern_of(variants, "U")


def literal_start(variant: str) -> str:
    """The lower-case letters that every match of an alternative must begin with."""
    found = re.match(r"[a-zA-Z]+", variant)
    if not found or "|" in re.sub(r"\[[^\]]*\]|\\.", "", _outside_groups(variant)):
        return ""
    word, rest = found.group(), variant[found.end() :]
    return (word[:-1] if rest[:1] in ("?", "*", "{") else word).lower()


def may_occur(folded: Column, variants: Iterable[str]) -> Column | None:
    """A cheap necessary condition on the folded text, or None if an alternative starts with no letters."""
    starts = {literal_start(v) for v in variants}
    if any(len(s) < 2 for s in starts):
        return None
    least = [s for s in starts if not any(s != t and s.startswith(t) for t in starts)]
    out = None
    for s in sorted(least):
        out = F.contains(folded, F.lit(s)) if out is None else out | F.contains(folded, F.lit(s))
    return out


#: Letters beyond ASCII that match Latin ones without regard to case, and those ones.
ODD_LETTERS, THEIR_LETTERS = "\u017f\u0131\u0130\u212a", "siik"


def folded(text: Column) -> Column:
    """Lower case, with the odd letters as the Latin ones they match; as long as the text."""
    odd = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in ODD_LETTERS])
    return F.lower(F.when(odd, F.translate(text, ODD_LETTERS, THEIR_LETTERS)).otherwise(text))


def plain_lower(variants: Iterable[str]) -> bool:
    """Whether alternatives are plain lower-case ASCII, so that the folded text can be searched with regard to case."""
    return all(v.isascii() and re.sub(r"\\.", "", v) == re.sub(r"\\.", "", v).lower() for v in variants)


# The built-in taxonomy, its phrases that discount a hit, and the forms its variants add.
NATIVE = Taxonomy.of({
    "colonialism": {
        "colonialism": [r"colonialis(?:m|t|ts)"],
        "coloniality": [r"colonialit(?:y|ies)"],
        "colonization": [r"coloniz(?:e|ed|es|ing|ation|ations)", r"colonis(?:e|ed|es|ing|ation|ations)"],
        "settler_colonialism": [r"settler[\s-]colonial(?:ism)?"],
        "decoloniality": [r"decoloni(?:al|ality|zation|sation|ze|se|zing|sing)"],
    },
    "imperialism": {
        "imperialism": [r"imperialis(?:m|t|ts)"],
        "empire": [r"empires?"],
        "neo_imperialism": [r"neo[\s-]imperialis(?:m|t|ts)"],
    },
    "racism": {
        "racism": [r"racism"],
        "racialization": [r"racializ(?:e|ed|es|ing|ation|ations)", r"racialis(?:e|ed|es|ing|ation|ations)"],
        "white_supremacy": [r"white[\s-]supremac(?:y|ist|ists)"],
        "racial_capitalism": [r"racial[\s-]capitalis(?:m|t|ts)"],
    },
    "fascism": {
        "fascism": [r"fascis(?:m|t|ts)"],
        "authoritarianism": [r"authoritarianis(?:m|t|ts)"],
        "totalitarianism": [r"totalitarianis(?:m|t|ts)"],
    },
})
NATIVE_PHRASES = ("colonial period", "colonial era", "colonial architecture", "imperial court", "imperial college", "imperial units", "imperial measurements")
ADJECTIVES = {"colonialism": {"colonial_adj": ["colonial"]}, "imperialism": {"imperial_adj": ["imperial"]}}
RACIAL_ADJECTIVE = {"racism": {"racial_adj": ["racial"]}}
OTHER_ADJECTIVES = {"fascism": {"authoritarian_adj": ["authoritarian"], "totalitarian_adj": ["totalitarian"]}}
MISSING_FORMS = {"colonialism": {"colonization": [r"coloniz(?:er|ers)", r"colonis(?:er|ers)"]}, "racism": {"racism": [r"racist(?:s)?"]}}


@dataclass(frozen=True)
class Variant:
    """A taxonomy and the unit that is counted: tokens, or sentences with a hit."""

    name: str
    taxonomy: Taxonomy
    unit: str


def variants_of(base: Taxonomy, adjectives: Mapping, racial: Mapping, others: Mapping, forms: Mapping) -> tuple[Variant, ...]:
    """The eight standard variants of a base taxonomy, from the forms that each step adds."""
    with_adjectives = base.with_forms(adjectives)
    all_adjectives = with_adjectives.with_forms(racial).with_forms(others)
    return (
        Variant("A_strict_token", base, "token"),
        Variant("B_plusAdjectives_token", with_adjectives, "token"),
        Variant("C_plusForms_token", base.with_forms(forms), "token"),
        Variant("D_plusAdjForms_token", with_adjectives.with_forms(forms), "token"),
        Variant("E_plusAdjForms_sentence", with_adjectives.with_forms(forms), "sentence"),
        Variant("F_allAdjForms_token", all_adjectives.with_forms(forms), "token"),
        Variant("G_allAdjForms_sentence", all_adjectives.with_forms(forms), "sentence"),
        Variant("H_plusRacialOnly_token", with_adjectives.with_forms(racial).with_forms(forms), "token"),
    )


NATIVE_VARIANTS = variants_of(NATIVE, ADJECTIVES, RACIAL_ADJECTIVE, OTHER_ADJECTIVES, MISSING_FORMS)
