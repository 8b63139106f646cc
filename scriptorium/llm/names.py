"""Variant spellings of names typed by people (problem 1).

Names are blocked by phonetic codes of their sorted tokens, compared by Jaro-Winkler and a nickname table, and
accepted pairs are clustered by connected components. A block is a code within a scope: a collection, or a work cited
in a collection, so that a frequent code or a work cited everywhere makes no large block by itself.

Null and empty names are no names. Equal names in one scope are compared like any others. Entries without a year or
a title are no evidence. Empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from scriptorium.llm.common import cut
from scriptorium.llm.components import components
from scriptorium.llm.scan_noise import HYPHENS, is_page_number

#: Least Jaro-Winkler similarity of two surnames, and of the words of two organisations.
SURNAME, WORD = 0.78, 0.80

# Given names and what they are called for short; words of organisations' names; particles.
NICKNAMES = (
    "alexander alex sandy sasha alec", "antonio tony toni anton", "amina mina", "anna ann anne annie nan", "charles chas charlie chuck carl karl", "daniel dan danny", "david dave",
    "dorothea dora thea dorothy dot", "edward ed eddie ted ned", "eleanor nell ellie leonora nora", "elizabeth liz beth eliza betty lisa elisabeth", "francisco paco frank francis pancho",
    "gabriela gabi gaby gabriel", "george georg jorge", "grace gracie", "hannah hanna", "henrietta hetty etta henriette", "henry harry hank heinrich", "ingrid inga inge", "james jim jimmy jamie",
    "johannes hans jan johann john jon jack", "joseph joe joey jose josef pepe", "josephine jo josie fina", "katherine kate kathy katie kit catherine cathy katharina", "leopold leo poldi", "margaret maggie meg peggy greta marg",
    "maria marie mary mia", "michael mike mick micky misha miguel", "nicholas nick nikolai kolya klaus nico nikolaus", "patrick pat paddy", "peter pete pedro pyotr", "rebecca becky becca", "richard dick rick rich",
    "robert bob rob bobby bert robin", "samuel sam sammy", "sofia sophie sophia sonya", "stephen steve stefan steven", "susanna sue susan suki zuzana susannah", "theodore ted theo teddy fyodor theodor", "thomas tom tommy", "victoria vicky viktoria",
    "wilhelm willi", "william will bill billy liam", "yusuf joe josef yosef",
)
ORGANISATIONS = "association bureau center centre commission committee council department foundation group institute institution league ministry office school society trust union university academy agency archive"
LINKING = "a an and at for in of on the f fur der die das de la le les el los del della di da do dos van von"
PARTICLES = "de la le von van der den da di do dos du ten ter al el mac mc o st san santa del della zu zur"

_FIRST_OF = {}
for _k, _names in enumerate(NICKNAMES):
    for _name in _names.split():
        _FIRST_OF.setdefault(_name, set()).add(_k)
_ORGANISATION = frozenset(ORGANISATIONS.split())
_LINKING = frozenset(LINKING.split())
_PARTICLE = frozenset(PARTICLES.split())
_CLASS = str.maketrans({**dict.fromkeys("bp", "1"), **dict.fromkeys("ckqgx", "2"), **dict.fromkeys("dt", "3"), **dict.fromkeys("fvw", "4"), "l": "5", **dict.fromkeys("mn", "6"), "r": "7", **dict.fromkeys("szjß", "8"), **dict.fromkeys("aeiouyhæøœ'", "")})
_REPEAT = re.compile(r"(.)\1+")
_SPLIT = re.compile(r"[^\w.'’]+")


@lru_cache(maxsize=200_000)
def plain(name: str) -> str:
    """Lower case, without accents."""
    lowered = name.lower().replace("ł", "l").replace("ø", "o").replace("ß", "ss").replace("’", "'")
    return "".join(c for c in unicodedata.normalize("NFKD", lowered) if not unicodedata.combining(c))


@lru_cache(maxsize=200_000)
def tokens(name: str) -> tuple[str, ...]:
    """The tokens of a name; a full stop stays with the token it shortens, and particles go with what follows."""
    parts = [p.strip("'") for p in _SPLIT.split(plain(name).replace("o'", "")) if p.strip("'.")]
    kept = tuple(p for p in parts if p.rstrip(".") not in _PARTICLE)
    return kept or tuple(parts)


def classes(token: str) -> str:
    """Classes of the consonants of a token; vowels only if there is nothing else."""
    bare = token.rstrip(".").replace("x", "ks")
    return bare.translate(_CLASS) or bare[:2]


def phonetic(token: str) -> str:
    """The classes of a token, each run once."""
    return _REPEAT.sub(r"\1", classes(token))


#: Classes of a code that are keyed; the rest of a longer code is keyed from its other end.
KEYED = 11


def _shortened(code: str) -> set[str]:
    """A code and what is left of it without one class, and without two of five or more.

    Two spellings of a code beyond KEYED classes meet in one of its ends, or in the tokens it is glued from.
    """
    if len(code) > KEYED:
        return {mark + form for mark, part in (("<", code[:KEYED]), (">", code[-KEYED:])) for form in (part, *(part[:k] + part[k + 1 :] for k in range(KEYED)))}
    out = {code}
    if len(code) > 2:
        out.update(code[:k] + code[k + 1 :] for k in range(len(code)))
    if len(code) > 4:
        out.update(code[:j] + code[j + 1 : k] + code[k + 1 :] for j in range(len(code)) for k in range(j + 1, len(code)))
    return out


@lru_cache(maxsize=200_000)
def is_organisation(name: str) -> bool:
    words = tokens(name)
    return len(words) > 2 and any(w in _ORGANISATION or w.endswith(".") and len(w) > 2 and any(o.startswith(w[:-1]) for o in _ORGANISATION) or jaro_winkler(w, o) > 0.9 for w in words for o in (_ORGANISATION if len(w) > 5 else ()) or ("",))


def block_keys(name: str) -> set[str]:
    """Phonetic codes of the sorted tokens and of all together, each also with one or two classes left out, and openings of codes."""
    words = [t for t in tokens(name) if len(t.rstrip(".")) > 1]
    own = [t for t in words if t not in _FIRST_OF and t not in _ORGANISATION and t not in _LINKING] or words
    whole = "".join(sorted(own))
    glued = "".join(t.rstrip(".") for t in own)
    out = set()
    everything = "".join(_SPLIT.sub("", plain(name)).split())
    for text in {*own, whole, glued, everything}:
        if len(text.rstrip(".")) < 3:
            continue
        code = classes(text)
        short = _REPEAT.sub(r"\1", code)
        for form in {code, short}:
            out |= _shortened(form)
        if len(text) > 4 or text.endswith("."):
            out.add("^" + short[:2])
    if len(words) > 1:
        out.update("@" + phonetic(t) for t in words if len(t) > 4)
    return out


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    first = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                first.append(c)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [b[j] for j in range(len(b)) if taken[j]]
    swaps = sum(x != y for x, y in zip(first, second, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def _given_match(a: str, b: str) -> bool:
    """Whether two given names or initials can be one person's."""
    x, y = a.rstrip("."), b.rstrip(".")
    if len(x) == 1 or len(y) == 1:
        return x[0] == y[0] or any(n.startswith(min(x, y, key=len)) for n in _also(max(x, y, key=len)))
    return bool(_FIRST_OF.get(x, set()) & _FIRST_OF.get(y, set())) or x.startswith(y) or y.startswith(x) or jaro_winkler(x, y) >= 0.8


def _also(name: str) -> Iterator[str]:
    for k in _FIRST_OF.get(name, ()):
        yield from NICKNAMES[k].split()


def _split_person(words: tuple[str, ...]) -> tuple[str, list[str]]:
    """The surname, glued together, and the given names and initials of a person."""
    given = [w for w in words if len(w.rstrip(".")) == 1 or w in _FIRST_OF]
    own = [w for w in words if w not in given]
    if not own:
        return "".join(words), []
    return "".join(own), given


def _word_match(a: str, b: str) -> bool:
    x, y = a.rstrip("."), b.rstrip(".")
    if a.endswith(".") or b.endswith("."):
        short, long = sorted((x, y), key=len)
        return bool(short) and long.startswith(short)
    return jaro_winkler(x, y) >= WORD


def _same_organisation(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Most words of the shorter name meet one of the longer, or it is an acronym of its first words."""
    one, two = ([w for w in x if w not in _LINKING] for x in sorted((a, b), key=len))
    if not one or not two:
        return False
    initials = "".join(w[0] for w in two)
    for w in one:
        if 2 <= len(w) <= 6 and w in (initials[: len(w)], initials[-len(w) :]) and len(w) + 1 >= len(two) - 1:
            rest = [v for v in one if v != w]
            if not rest or any(_word_match(v, t) for v in rest for t in two):
                return True
    met = sum(any(_word_match(w, t) for t in two) for w in one)
    return met >= 0.6 * len(one) and met >= 0.5 * len(two) or jaro_winkler("".join(sorted(one)), "".join(sorted(two))) >= 0.92 or jaro_winkler("".join(one), "".join(two)) >= 0.92


@lru_cache(maxsize=300_000)
def same_name(a: str, b: str) -> bool:
    """Whether two spellings can be one person's or one organisation's."""
    one, two = tokens(a), tokens(b)
    if not one or not two:
        return False
    if len(one) > 2 and len(two) > 1 or len(two) > 2 and len(one) > 1:
        if (is_organisation(a) or is_organisation(b)) and _same_organisation(one, two):
            return True
    (surname, given), (other, names) = _split_person(one), _split_person(two)
    if given and names and not any(_given_match(x, y) for x in given for y in names):
        return False
    short, long = sorted((surname, other), key=len)
    if short.endswith(".") or long.endswith("."):
        x, y = short.rstrip("."), long.rstrip(".")
        short, long = sorted((x, y), key=len)
        if len(short) >= 3 and (long.startswith(short) or jaro_winkler(short, long[: len(short)]) >= 0.9):
            return True
    if jaro_winkler(short, long) >= SURNAME or jaro_winkler("".join(sorted(short)), "".join(sorted(long))) >= 0.95 and len(short) > 4:
        return True
    if jaro_winkler(_SPLIT.sub("", plain(a)), _SPLIT.sub("", plain(b))) >= SURNAME + 0.08:
        return True
    parts = [[w.rstrip(".") for w in x if len(w.rstrip(".")) > 3 and w not in _FIRST_OF] for x in (one, two)]
    return any(jaro_winkler(x, y) >= 0.9 for x in parts[0] for y in parts[1])


# ---- links within a scope ---------------------------------------------------------------------------------------


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    @lru_cache(maxsize=100_000)
    def hashes(name: str) -> tuple[int, ...]:
        return tuple(xxhash.xxh3_64_intdigest(k) for k in block_keys(name))

    for batch in batches:
        ids, scopes, keys = [], [], []
        for key, scope, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for h in hashes(name):
                ids.append(key)
                scopes.append(scope)
                keys.append(h - (1 << 63))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scopes, pa.int64()), pa.array(keys, pa.int64())], names=["id", "scope", "key"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [same_name(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        batch = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"])


def link_names(names: DataFrame, scoped: DataFrame) -> DataFrame:
    """(a, b), a < b: accepted pairs of ``names`` (id, name) that meet in a scope of ``scoped`` (id, scope bigint)."""
    named = names.where("id IS NOT NULL AND name IS NOT NULL AND name <> ''")
    keyed = scoped.join(named, "id").select("id", "scope", "name").mapInArrow(_keys, "id bigint, scope bigint, key bigint")
    block = keyed.select("id", F.xxhash64("scope", "key").alias("block"))
    met = block.withColumnRenamed("id", "a").join(block.select(F.col("id").alias("b"), "block"), "block").where("a < b").select("a", "b").distinct()
    pairs = met.join(named.select(F.col("id").alias("a"), F.col("name").alias("name_a")), "a").join(named.select(F.col("id").alias("b"), F.col("name").alias("name_b")), "b")
    return pairs.select("a", "b", "name_a", "name_b").mapInArrow(_compare, "a bigint, b bigint")


# ---- works as evidence ------------------------------------------------------------------------------------------

_YEAR = re.compile(r"\((?:[^()\d]{0,12})?((?:1[5-9]|20)\d\d)[a-z]?\)[.,:]?\s*|[\s,]((?:1[5-9]|20)\d\d)[a-z]?[,.:]\s+(?=\S*[^\W\d_])")
_NUMBERED = re.compile(r"\s*(?:\[\d{1,4}\]|\d{1,4}\.)\s+")
_AUTHOR = re.compile(r"[^,]+,(?:\s*(?:[^\W\d_]\.[\s-]?){1,3},|\s*[A-ZÀ-ÖØ-Þ][\w'’-]+(?:\s[^\W\d_]\.)*,(?=\s+[A-ZÀ-ÖØ-Þ]))?\s*")
_TITLE_END = re.compile(r"\.(?:\s|$)|,\s+(?=[A-ZÀ-ÖØ-Þ(])|,\s*(?:vol|pp)\.|\shttps?://")
_CLOSE = re.compile(rf"(\w)[{HYPHENS}]\s*\n\s*(\w)")
_FOLDS = (("0", "o"), ("1", "l"), ("5", "s"), ("9", "g"), ("6", "b"), ("vv", "w"), ("rn", "m"), ("cl", "d"), ("ri", "n"), ("ii", "u"), ("li", "h"), ("i", "l"), ("e", "c"), ("f", "t"), ("u", "a"))


def work_title(entry: str) -> str:
    """The letters of an entry's title, alike for usual misreadings, line breaks and stray spaces."""
    lines = entry.split("\n")
    if len(lines) > 2:
        lines = [line for k, line in enumerate(lines) if k in (0, len(lines) - 1) or not (is_page_number(line) or re.search(r"^\W*\d+\W+\w+$|\w\W+\d+\W*$", line) and len(line) < 26 and not re.search(r"[.,:]\s", line))]
    text = "\n".join(lines)
    text = re.sub(r"\s+", " ", _CLOSE.sub(r"\1\2", text)).strip()
    year = _YEAR.search(text)
    if year and not (_NUMBERED.match(text) and year.start() > 0.45 * len(text)):
        start = year.end()
    else:
        numbered = _NUMBERED.match(text)
        author = _AUTHOR.match(text, numbered.end() if numbered else 0)
        if not author:
            return ""
        start = author.end()
    end = _TITLE_END.search(text, start + 1)
    title = plain(text[start : end.start() if end else len(text)])
    for wrong, right in _FOLDS:
        title = title.replace(wrong, right)
    return "".join(c for c in title if c.isalpha())


def _works(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        collections, surnames, works = [], [], []
        for document, surname, year, entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            digits = re.match(r"\D*(\d{4})", year or "")
            if not document or not surname or not entry or not digits:
                continue
            title = work_title(entry)
            if title:
                collections.append(document.split("/", 1)[0])
                surnames.append(surname.lower())
                works.append(xxhash.xxh3_64_intdigest(f"{digits.group(1)} {title}") - (1 << 63))
        yield pa.RecordBatch.from_arrays([pa.array(collections, pa.string()), pa.array(surnames, pa.string()), pa.array(works, pa.int64())], names=["collection", "surname", "work"])


def cited_works(authors: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, scope): the works an author's entries cite, for works cited under two or more spellings of a collection."""
    works = entries.select("document", "surname", "year", "raw_entry").mapInArrow(_works, "collection string, surname string, work bigint").distinct()
    own = authors.where("author_id IS NOT NULL").select(F.col("author_id").cast("bigint").alias("id"), "collection", F.lower("surname").alias("surname"))
    cited = own.join(works, ["collection", "surname"]).select("id", F.xxhash64("collection", "work").alias("scope")).distinct()
    often = cited.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("scope")
    return cut(cited.join(often, "scope").select("id", "scope"))


def variant_clusters(authors: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, component) of the authors linked to another spelling, and (id, scope) of the works cited."""
    works = cited_works(authors, entries)
    names = authors.select(F.col("author_id").cast("bigint").alias("id"), F.col("surname").alias("name"))
    return components(link_names(names, works), "a", "b"), works


def variant_pairs(authors: DataFrame, entries: DataFrame) -> DataFrame:
    """(author_id_a, author_id_b), a < b: spellings of one cluster whose entries cite a work in common."""
    clusters, works = variant_clusters(authors, entries)
    placed = clusters.join(works, "id").select("id", F.xxhash64("component", "scope").alias("place"))
    met = placed.select(F.col("id").alias("author_id_a"), "place").join(placed.select(F.col("id").alias("author_id_b"), "place"), "place")
    return met.where("author_id_a < author_id_b").select("author_id_a", "author_id_b").distinct()
