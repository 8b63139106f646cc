"""Per-document text quality statistics and what is not natural prose (problem 2).

A record's lines are grouped into segments of like lines. Eight statistics of every segment are measured on fixed
scales; a Gaussian mixture over the standardised statistics of all segments is fitted by expectation-maximisation.
Its components start at inspected examples, follow the corpus, and are then mapped to prose, list, table or junk by
where the examples fall among them.

Null pages count as empty text and a record without pages as an empty text; blank texts have no segments. Results
with a null count or flag raise no issue. Repeated rows give one issue each kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scriptorium.llm.common import cut
from scriptorium.llm.lexicon import FUNCTION_WORDS, UNSPACED

#: Upper ends of the levels of each statistic.
SCALES = {
    "common_words": (0.02, 0.08, 0.15, 0.24, 0.34),
    "digits": (0.01, 0.04, 0.10, 0.25, 0.5),
    "symbols": (0.005, 0.02, 0.06, 0.15, 0.4),
    "line_words": (1.5, 2.5, 4.0, 6.5, 10.0),
    "capitals": (0.1, 0.2, 0.35, 0.5, 0.75),
    "odd_words": (0.02, 0.06, 0.15, 0.4, 0.8),
    "citation_marks": (0.01, 0.04, 0.08, 0.14, 0.22),
    "item_lines": (0.1, 0.25, 0.45, 0.65, 0.9),
}
LEVELS = 6
#: A cell is one level of each statistic. At most LEVELS ** len(SCALES) = 1,679,616 of them reach the driver, as two
#: arrays of 13 MB, whatever the corpus; CHUNK of them at a time are held against the components.
CHUNK = 20_000
#: Least spread of a component, in levels; spreads that the starts begin with, in standard deviations; rounds of each.
SPREAD_FLOOR = 0.35
STARTS = (0.4, 0.6, 0.9)
ROUNDS = 25
#: Characters that an example weighs in the component founded on it: a fixed small prior beside those of the corpus.
PRIOR_CHARS = 200.0

#: Inspected examples; each founds one component of the mixture, and the fitted components get their kinds from them.
EXAMPLES = (
    ("prose", "The council met in the hall of the town, and the clerk read the letter to them without delay.\nBefore the winter it was sent to the owner of the mill, who was not at home when it came."),
    ("prose", "In 1871 the bridge at Aston was sold to Dr. J. B. Marlow (see Fig. 3.2, p. 114), and it was rebuilt between 1874 and 1880 for the town."),
    ("prose", "Der Rat kaufte 1871 das alte Haus in der Nähe von Bremen, und die Witwe wohnte zwischen 1874 und 1880 mit den Kindern in dem Haus."),
    ("prose", "Im Jahr 1871 verkaufte der Rat der Stadt das Haus (vgl. Marlow 1869, S. 114) an Dr. J. Bell, und zwischen 1874 und 1880 wohnte die Witwe mit den Kindern in der Stadt."),
    ("prose", "Nach der Ernte kaufte die Witwe das Haus am Rande der Stadt ohne Zustimmung der Nachbarn. Der Rat vergaß den Brief an den Richter, und das Amt behielt das Geld."),
    ("prose", "La viuda vendió el molino a la comunidad en el año de la sequía, según el libro de las deudas de la villa."),
    ("prose", "村里的人在河边修了一座新的桥，因为旧的桥已经被水冲走了。大家都说这是一件好事，也是一件难事。"),
    ("prose", "古い橋が水に流されてしまったので、村の人たちは1874年に川のそばに新しい橋を作った（第3巻、第12号）。"),
    ("prose", "गाँव के लोगों ने नदी के किनारे एक नया घर बनाया और उस घर को परिषद के नाम कर दिया।"),
    ("prose", "Община купила старую мельницу у вдовы, потому что осенью хлеба не хватало. Никто не знает цены."),
    ("prose", "Громада продає ліс (див. Marlow 1871, с. 114) між 1874 і 1880 роками через борги та посуху."),
    ("prose", "كان الناس في القرية يحملون الماء من النهر إلى البيوت، ولم يكن في ذلك العام مطر ولا حصاد كثير."),
    ("prose", "ชาวบ้านที่อยู่ใกล้แม่น้ำไม่ได้รับความช่วยเหลือจากเมือง เพราะทางขาดในฤดูฝน"),
    ("prose", "ชาวบ้านริมแม่น้ำซื้อโรงสีเก่าจากแม่หม้ายในปี 1874 และช่วยกันซ่อมหลังคาก่อนฤดูฝนจะมาถึง เสมียนเขียนบันทึกไว้ว่าไม่มีใครในหมู่บ้านรู้ราคาที่แท้จริง เพราะสัญญาเดิมหายไปกับน้ำท่วมครั้งใหญ่ ชาวประมงสามคนเล่าเรื่องนี้ให้ลูกหลานฟังตามที่ได้ยินมาจากพ่อแม่ หลังจากนั้นโรงเรียนก็ย้ายไปอยู่ใกล้ตลาด"),
    ("prose", "แม่หม้ายขายโรงสีเก่า พ่อค้าซื้อข้าวเปลือกริมคลอง เสมียนจดบัญชีหนี้ ชาวประมงซ่อมเรือก่อนฝนตก ครูใหญ่ย้ายโรงเรียนไปใกล้ตลาด หมู่บ้านสร้างสะพานใหม่ข้ามแม่น้ำ ช่างไม้ตัดไม้ในป่าสงวน เด็กกำพร้าเลี้ยงควายหลังวัด"),
    ("prose", "ในปี 1820 พ่อค้าย้ายตลาด\nไปริมคลอง เพราะน้ำท่วมบ่อย\nเสมียนจดไว้ 12 ครั้ง (ดู Marlow 1871, หน้า 114)\nแต่ไม่มีใครอ่าน"),
    ("prose", "老书记员把账簿藏在磨坊里，因为他怕法官来查。据Marlow\n所述，第二年春天洪水冲走了桥，村民们又花了3年才把它修好\n（见Bell 1874，第114页），但没有人记得当时的价钱。"),
    ("prose", "寡妇卖掉了磨坊。行会买下森林，渔民反对。法官没有来，书记员只好写信。\n镇议会后来失去了账簿，村民们于1874年重修了河上的桥。"),
    ("prose", "年老い\nた書記は水車小屋に帳簿を隠した（Bell 1874、114ページ）。村人は3年かけて\n橋を直したが、その値段を覚えている者はいない。"),
    ("prose", "After the flood\nThe clerk of Aston kept the letters of the widow, and nobody asked him why (Marlow 1871, p. 114; Bell 1874).\nIn the spring the mill was sold again."),
    ("list", "Harbour\nPasture\nTax-roll\nAssembly\nOrchard\nVillage\nWages"),
    ("list", "After the flood ............ 7\nThe mills of Aston ............ 19\nNotes on trade ............ 33"),
    ("list", "archive, 12, 88, 140\nbridge, 7\ncouncil, 31, 96, 102\nferry, 55, 61\nharbour, 3, 19"),
    ("list", "Marlow, J. (1987) The mill and the town. Leeds: North Press.\nPeters, A. B. (1990b) Early trade. York: Hall & Son, vol. 2."),
    ("list", "Peters-Holm, Anna 1990, After the ferry, Hall & Son.\nSociety for River Studies of Aston (1971) Orchard, mill and weir. Leeds: North Press, pp. 12–88."),
    ("list", "Archer, The river towns of Aston\nBell, Notes on early trade\nCooper, Widows and mills: debt and dowry in Leeds"),
    ("list", "- fishing rights\n- common pasture\n- mill, weir\n- tithe barns\n- river crossings"),
    ("list", "1) the letter to the widow – Aston\n2) the fishing rights (26)\n3) the use of the weir – Leeds\n4) the mill of the town"),
    ("list", "- Archer, The river towns of the north\n- Bell, Notes on the early trade\n- Cooper, Reading the widow and the mill, 1820–1860"),
    ("list", "Week 1: Mill / weir; Archer, ch. 3\nWeek 2: Debt / dowry; Bell, ch. 11\nWeek 3: Ferry / bridge; Cooper, ch. 7"),
    ("list", "1) ตลาดริมคลอง (12)\n2) โรงสีเก่าของแม่หม้าย (31)\n3) สะพานข้ามแม่น้ำ (44)"),
    ("list", "1）河边的磨坊（12）\n2）寡妇的来信（31）\n3）森林的边界（44）"),
    ("list", "Marlow, James (1871) The ferry of Bexley,\n1790–1840. Leeds: North Press.\nBell, A. (1880) The common mill. Bexley: Hall & Son, vol. 2."),
    ("table", "Place\tMills\tShops\nAston\t12\t48.5\nLeeds\t(7.25)\t1,204\nYork\t–\t388"),
    ("table", "Aston\n12\n(48.50)\n1,204\nn.d.\n–\n77.1\nYork\n3\n15,118"),
    ("table", "Aston        12.5      (88.10)     4,120\nLeeds        –         77          908.3"),
    ("table", "| Place | Mills | Shops |\n| Aston | 12 | 48.5 |\n| Leeds | (7.25) | 1,204 |"),
    ("junk", "..........................\n- - - - - - - - - - - - -\n________________________"),
    ("junk", "o o o 0 0 O\nI I l l 1\n. . : . ; ."),
    ("junk", "^%$#@{}~=+<>|\\*&^%$#@!{}[]~=+<>\n#@^&*~~=+[]{}<>\\|^%$#"),
    ("junk", "T\nh\ne\nm\ni\nl\nl\no\nf\nt\nh\ne"),
    ("junk", "(cid:12)(cid:99)(cid:140)(cid:7)(cid:88)(cid:201)\n(cid:45)(cid:3)(cid:77)(cid:190)"),
    ("junk", "ÐÐ°ÑÐµÐ»ÑÐ½Ð¸ÐºÐ¸ Ð¾Ð±ÑÐ¸Ð½Ñ Ð¿Ð¾ÑÑÑÐ¾Ð¸Ð»Ð¸ Ð½Ð¾Ð²ÑÐ¹ Ð¼Ð¾ÑÑ"),
    ("junk", "Uif dpvodjm nfu jo uif ibmm pg uif upxo, boe uif dmfsl sfbe uif mfuufs up uifn xjuipvu efmbz (jo 1871)."),
    ("junk", ".emac ti nehw emoh ta ton saw ohw ,llim eht fo renwo eht ot tnes saw ti retniw eht erofeB"),
    ("junk", "kqzxvjwpfghbnmtrdzxcvbqwrtplkjhgfdsqmnbvczqpwxkjvbntrwqzplmkqxzvbqw"),
    ("junk", "Th clrk kpt th lttrs f th wdw, nd nbdy skd hm why. n th sprng th ml ws sld gn t th twn, bt th frry wnt n s bfr. Sm sy tht th brdg t stn ws nvr pd fr."),
    ("junk", "Wkh fohun nhsw wkh ohwwhuv ri wkh zlgrz, dqg qrergb dvnhg klp zkb. Lq wkh vsulqj wkh ploo zdv vrog djdlq wr wkh wrzq (lq 1874), exw wkh ihuub zhqw rq dv ehiruh. Vrph vdb wkdw wkh eulgjh dw Dvwrq zdv qhyhu sdlg iru."),
    ("junk", "qkzjxwvbnmtrplkhgfdszxcvqwbrtplkjmhngfdsqzxcvbwrtpkljhmngfdxzqv bnmwrtplkjhgfdzxcvqwmnbrtplkjhgfdsazxqwcvbnmrtplkjhgfd"),
)

_COMMON = frozenset(w for lang, words in FUNCTION_WORDS.items() if lang not in UNSPACED for w in words.split())
#: Further frequent words of Thai, which has no particles as frequent as those of Chinese and Japanese.
THAI_WORDS = "ที่ ว่า ไป มา อยู่ แล้ว แต่ หรือ ถ้า เมื่อ ซึ่ง อีก เลย ก็ นี้ นั้น ทุก หลัง ก่อน ต่อ ตาม ถึง ด้วย ใคร ปี คน ชาว ขึ้น ลง ออก เข้า กว่า มาก ใหม่ เก่า"
_PARTICLE = re.compile("|".join(sorted({re.escape(w) for words in (*(FUNCTION_WORDS[lang] for lang in UNSPACED), THAI_WORDS) for w in words.split()}, key=len, reverse=True)))
_UNSPACED = re.compile(r"[฀-๿぀-ヿ㐀-鿿]")
_MARKS = "̀-ͯऀ-ःऺ-ॏ॑-ॗॢॣัิ-ฺ็-๎ً-ٟ​-‏­"
_SYMBOL = re.compile(rf"[^\w\s{_MARKS}.,;:!?'\"()«»“”„’‘…。、，！？：；「」『』（）।؟،؛‐–—-]")
_RULED = re.compile(r"\.{4,}|(?:[._–—-] ?){5,}")
_MOJIBAKE = re.compile(r"[Â-ôŒœŸ][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]")
_DIGIT = re.compile(r"\d")
_CITED = re.compile(r"\b(?:1[5-9]|20)\d\d[a-z]?\b|\b[A-Z]\.")
_SPARSE = re.compile(r"[Ͱ-ԯ؀-ۿऀ-ॿ]{3}")
_GLYPH = re.compile(r"\(cid:\d+\)")
_ITEM = re.compile(r"^(?=.{1,120}$)\s*(?:[-–—•*·▪»›]\s|\(?\d{1,3}[.)\]]\s|\[\d{1,4}\]\s|[^\W\d_][\w'’-]+(?: [^\W\d_][\w'’-]+)?,\s.*(?:\b(?:1[5-9]|20)\d\d|\d\s*$|[^.!?,;]$)|.*, \d{1,4}\s*$)", re.M)
_HYPHEN_BREAK = re.compile(r"(\w)-\s*\n\s*(\w)")
_MAYBE_BREAK = re.compile(r"-\s*\n")
_TABBED = re.compile(r"\t|\S {2,}\S+ {2,}\S")

#: Languages in these scripts have fewer function words; their share is multiplied by this.
SPARSE_FACTOR = 2.2
#: Lines of at most this many characters are short.
SHORT_LINE = 25
WINDOW = 5


def normalised_length(text: str) -> int:
    """Length after closing hyphenated breaks and collapsing white space; ends are not stripped."""
    if _MAYBE_BREAK.search(text):
        text = _HYPHEN_BREAK.sub(r"\1\2", text)
    words = text.split()
    if not words:
        return int(bool(text))
    return len(" ".join(words)) + text[0].isspace() + text[-1].isspace()


def segments(text: str) -> list[str]:
    """Runs of lines of one form: long, short or tabular; a lone short line stays with the lines before it.

    Runs of long lines are cut every WINDOW lines, so that prose and a bibliography below it come apart.
    """
    out: list[list[str]] = []
    form = ""
    lines = text.split("\n")
    forms = ["" if not line or line.isspace() else "t" if _TABBED.search(line.strip()) else "s" if len(line.strip()) <= SHORT_LINE else "l" for line in lines]
    n = len(lines)
    for k, line in enumerate(lines):
        own = forms[k]
        if not own:
            form = form if form == "s" and _short_again(forms, k, n) else ""
            continue
        if own == "s" and form in ("l", "t") and (k + 1 == n or forms[k + 1] != "s"):
            own = form
        if own != form or own == "l" and len(out[-1]) >= WINDOW:
            out.append([])
        out[-1].append(line)
        form = own
    return ["\n".join(lines) for lines in out]


def _short_again(forms: list[str], k: int, n: int) -> bool:
    while k < n and not forms[k]:
        k += 1
    return k < n and forms[k] == "s"


def statistics(segment: str) -> list[float]:
    words = segment.split()
    count = len(words)
    dense = sum(map(len, words))
    lines = segment.count("\n") + 1
    unspaced = len(_UNSPACED.findall(segment)) if not segment.isascii() else 0
    digits = len(_DIGIT.findall(segment))
    symbols = len(_SYMBOL.findall(segment)) + sum(m.end() - m.start() for m in _RULED.finditer(segment))
    if not segment.isascii():
        symbols += 2 * len(_MOJIBAKE.findall(segment))
    if "(cid:" in segment:
        symbols += sum(m.end() - m.start() for m in _GLYPH.finditer(segment))
    items = len(_ITEM.findall(segment)) / lines
    if unspaced > dense / 3:
        spoken = max(1.0, unspaced / 6)
        common = min(1.0, len(_PARTICLE.findall(segment)) / spoken)
        return [common * 0.6, digits / dense, min(1.0, symbols / dense), spoken / lines, 0.0, 0.0, 0.0, items]
    common = sum(w in _COMMON for w in segment.lower().split()) / count
    capitals = sum(w[0].isupper() for w in words) / count
    odd = sum(len(w) for w in words if len(w) == 1 or len(w) > 30 and not _UNSPACED.search(w) or w[0] in ",.;:!?)" and w[-1].isalpha()) / dense
    if _SPARSE.search(segment):
        common *= SPARSE_FACTOR
    cited = len(_CITED.findall(segment)) / count
    return [common, digits / dense, min(1.0, symbols / dense), count / lines, capitals, odd, cited, items]


_NAMES = tuple(SCALES)
_CUTS = np.array([SCALES[k] for k in _NAMES])


def levels(values: np.ndarray) -> np.ndarray:
    """The level, 0 to 5, of each statistic."""
    return (values[:, :, None] > _CUTS[None]).sum(2).astype(np.uint8)


class Mixture:
    """Gaussians with diagonal spreads, founded on examples, fitted to a corpus, and named by the examples again."""

    def __init__(self, examples: np.ndarray, kinds: list[str]) -> None:
        self.examples, self.kinds = examples, kinds
        self.shift, self.scale = np.zeros(examples.shape[1]), np.ones(examples.shape[1])
        self._start(0.6)
        self._name()

    def _start(self, spread: float) -> None:
        self.floor = SPREAD_FLOOR / self.scale
        self.anchor = (self.examples - self.shift) / self.scale
        self.mean, self.spread = self.anchor, np.maximum(spread, self.floor) * np.ones_like(self.anchor)
        self.weight = np.full(len(self.anchor), 1 / len(self.anchor))

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.shift) / self.scale
        out = np.empty((len(z), len(self.mean)))
        for k in range(len(self.mean)):
            out[:, k] = np.log(self.weight[k]) - np.log(self.spread[k]).sum() - 0.5 * (((z - self.mean[k]) / self.spread[k]) ** 2).sum(1)
        return out

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of the components and log-likelihood, of each row."""
        joint = self.log_joint(x)
        most = joint.max(1, keepdims=True)
        p = np.exp(joint - most)
        total = p.sum(1, keepdims=True)
        return p / total, (most + np.log(total))[:, 0]

    def fit(self, x: np.ndarray, n: np.ndarray, rounds: int = ROUNDS, prior: float = PRIOR_CHARS) -> Mixture:
        """Expectation-maximisation over cells x with weights n, from several starts; the likeliest one stays."""
        self.shift = (x * n[:, None]).sum(0) / n.sum()
        self.scale = np.sqrt((n[:, None] * (x - self.shift) ** 2).sum(0) / n.sum()) + 1e-6
        best, found = -np.inf, None
        for spread in STARTS:
            self._start(spread)
            for _ in range(rounds):
                likely = self._round(x, n, spread, prior)
            if likely > best:
                best, found = likely, (self.mean, self.spread, self.weight)
        self.mean, self.spread, self.weight = found
        self.likelihood = best / n.sum()
        self._name()
        return self

    def _round(self, x: np.ndarray, n: np.ndarray, spread: float, prior: float) -> float:
        """One round; the expectations are summed over chunks of cells."""
        mass, first, second, likely = np.zeros(len(self.mean)), np.zeros_like(self.mean), np.zeros_like(self.mean), 0.0
        for at in range(0, len(x), CHUNK):
            part, weight = x[at : at + CHUNK].astype(float), n[at : at + CHUNK]
            r, log = self.responsibilities(part)
            r *= weight[:, None]
            z = (part - self.shift) / self.scale
            mass += r.sum(0)
            first += r.T @ z
            second += r.T @ z**2
            likely += float(log @ weight)
        total = mass + prior
        self.mean = (first + prior * self.anchor) / total[:, None]
        square = (second + prior * (self.anchor**2 + spread**2)) / total[:, None]
        self.spread = np.maximum(np.sqrt(np.maximum(square - self.mean**2, 0)), self.floor)
        self.weight = total / total.sum()
        return likely

    def _name(self) -> None:
        """Probability of each kind in a component: the share of that kind's examples in what the examples leave there."""
        r, _ = self.responsibilities(self.examples)
        self.order = sorted(set(self.kinds))
        votes = np.stack([r[[k for k, own in enumerate(self.kinds) if own == kind]].sum(0) for kind in self.order], axis=1) + 1e-9
        self.names = votes / votes.sum(1, keepdims=True)

    def kind(self, x: np.ndarray) -> list[str]:
        """The kind with the greatest posterior probability over all components."""
        out: list[str] = []
        for at in range(0, len(x), CHUNK):
            r, _ = self.responsibilities(x[at : at + CHUNK].astype(float))
            out += [self.order[k] for k in (r @ self.names).argmax(1)]
        return out


def example_mixture() -> Mixture:
    """The mixture before it has seen a corpus."""
    values = levels(np.array([statistics(text) for _, text in EXAMPLES])).astype(float)
    return Mixture(values, [kind for kind, _ in EXAMPLES])


_PLACES = LEVELS ** np.arange(len(_NAMES), dtype=np.int64)


def cell_codes(found: list[str]) -> list[int]:
    """The cell of each segment, as one number."""
    return (levels(np.array([statistics(s) for s in found])) @ _PLACES).tolist() if found else []


def cell_levels(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] // _PLACES % LEVELS).astype(np.uint8)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths, blank, cells, sizes = [], [], [], []
        for pages in batch.column(1).to_pylist():
            text = "\n".join(p or "" for p in pages or [])
            lengths.append(normalised_length(text))
            blank.append(not text or text.isspace())
            found = segments(text)
            cells.append(cell_codes(found))
            sizes.append([sum(map(len, s.split())) for s in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(blank), pa.array(cells, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))], names=["cache_id", "length", "blank", "cells", "sizes"])


def measured_records(records: DataFrame) -> DataFrame:
    """(cache_id, length, blank, cells, sizes): one pass over the texts, kept in the checkpoint folder."""
    named = records.select(F.col("cache_id").cast("bigint").alias("cache_id"), "pages")
    return cut(named.mapInArrow(_measure, "cache_id bigint, length bigint, blank boolean, cells array<int>, sizes array<int>"))


def fit_mixture(measured: DataFrame) -> Mixture:
    """The mixture over every segment of the corpus, weighted by its characters."""
    pairs = measured.select(F.inline(F.arrays_zip("cells", "sizes")))
    rows = pairs.groupBy("cells").agg(F.sum("sizes").alias("chars")).orderBy("cells").toPandas()
    mixture = example_mixture()
    if not len(rows):
        return mixture
    return mixture.fit(cell_levels(rows["cells"].to_numpy().astype(np.int64)), rows["chars"].to_numpy().astype(float))


def record_kinds(measured: DataFrame, mixture: Mixture | None = None) -> DataFrame:
    """(cache_id, length, blank, prose, list, table, junk): non-space characters of each kind."""
    shared = measured.sparkSession.sparkContext.broadcast(mixture or fit_mixture(measured))
    kinds = ("prose", "list", "table", "junk")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(4).to_pylist()
            codes, where = np.unique(np.array([c for own in batch.column(3).to_pylist() for c in own], np.int64), return_inverse=True)
            of = np.array([kinds.index(k) for k in shared.value.kind(cell_levels(codes))], int)[where]
            total, at = np.zeros((batch.num_rows, len(kinds)), np.int64), 0
            for k, own in enumerate(sizes):
                for n in own:
                    total[k, of[at]] += n
                    at += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(total[:, k]) for k in range(len(kinds)))], names=["cache_id", "length", "blank", *kinds])

    return measured.mapInArrow(label, "cache_id bigint, length bigint, blank boolean, " + ", ".join(f"`{k}` bigint" for k in kinds))


def find_issues(records: DataFrame, results: DataFrame) -> DataFrame:
    """Distinct (cache_id, issue): records that are not prose, and results that contradict the text."""
    measured = measured_records(records)
    kinds = record_kinds(measured)
    other = F.col("list") + F.col("table") + F.col("junk")
    prose = kinds.where((2 * other > other + F.col("prose")) & ~F.col("blank")).select("cache_id", F.lit("not_prose").alias("issue"))
    own = results.select(F.col("cache_id").cast("bigint").alias("cache_id"), "char_count", "extraction_ok").join(measured.select("cache_id", "length", "blank"), "cache_id")
    count = own.where(~F.col("blank") & (100 * F.abs(F.col("char_count") - F.col("length")) > F.col("length"))).select("cache_id", F.lit("char_count").alias("issue"))
    flag = own.where(F.col("extraction_ok") == F.col("blank")).select("cache_id", F.lit("extraction_ok").alias("issue"))
    return prose.unionAll(count).unionAll(flag).distinct()
