from __future__ import annotations

import pytest

from scriptorium.llm import sentences

# each text with "|" where a sentence ends
CASES = [
    "Dr. J. B. Marlow of St. Ives sold it for 4.9m crowns (see Fig. 3.2, p. 14).|It closed at 6 p.m.|Nobody came.|",
    "They kept mills, inns, etc.|A ferry came at 7.30 a.m. on the first day, i.e. early.|",
    "It was late ... or so it seemed ... when they left ... or so it seemed ....|Then it rained.|",
    '"Who pays for the mill?" asked the clerk.|The clerk said, "We forgot."|"It is ours!" wrote Bell in 1911, and left.|(It was a small matter.)|The end.|',
    "The term comes from Bell, Ph.D., of Aston Univ. Press.|In 1876 it fell.|No space follows.|Here it goes on.|",
    "Es fehlten Brot, Salz usw.|Der Rat kam am 3. März, d. h. spät, mit 8,9 v. H.. |Seit dem 19. Jahrhundert z. B. im Bezirk Aston (Nr. 3, Bd. 7).|„Niemand kam.“|Wem gehörte es?|",
    "La Sra. Bell vive p. ej. en la pág. 3 del tomo.|¡Qué pérdida fue aquella!|«El agua es libre», escribió el Dr. Bell.|El escribano anotó: «Nadie vino a Aston.»|",
    "Le greffier ajouta : « Personne ne vint à Aston. »|Quelle perte ce fut !|À qui était-ce chez Mme. Bell p. ex. au t. 7 ?|",
    "Мельница стояла т. е. падала в 1876 г. по описи (см. Bell 1841, с. 13).|Писарь добавил: «Никто не пришёл».|Не хватало хлеба и т. д.|Город спал.|",
    "Ο γραφέας πρόσθεσε: «Κανείς δεν ήρθε.»|Σε ποιον ανήκε ο μύλος;|Έλειπαν ψωμί κ.λπ.|Η ένωση π.χ. στην επαρχία (τ. 7, αρ. 4).|",
    "“水是自由的。”书记员写道。|文书补充说：“没有人来。”|磨坊属于谁？|他忘记了……至少看起来如此，因为害怕。|",
    "書記は「だれも来なかった。」と書いた。|なんと大きな損失だったことか！|よその商人は……表向きは……川を見た。|",
    "लिपिक ने लिखा, \"कोई नहीं आया।\"|डॉ. Bell के साथ (खंड 2, सं. 5) बाँट दिया।|चक्की किसकी थी?|",
    "أضاف الكاتب: «لم يأت أحد.»|كانت الطاحونة حسب د. Bell (ج. 7، ع. 4) قرب البحر.|يا لها من خسارة!|",
    "ชุมชนซื้อบทเพลงชายฝั่ง|ในปี 1837 ชุมชนวัดภาษีราว 4.1 ส่วนใกล้ทะเล|ไม่มีใครมาที่นี่อีกเลย|",
    "The Old Mill|\n\nIt stood there.|\n \nIt fell|\n\n\n",
]


@pytest.mark.parametrize("marked", CASES)
def test_boundaries(marked):
    text, ends = "", []
    for part in marked.split("|")[:-1]:
        text += part if text.endswith((" ", "\n")) or part[:1] in " \n" or not text else " " + part
        ends.append(len(text.rstrip()))
    if marked is CASES[4]:
        text = text.replace("follows. Here", "follows.Here")
        ends[-1] -= 1
    if any("一" <= c <= "鿿" for c in text):
        text, ends = "", []
        for part in marked.split("|")[:-1]:
            text += part
            ends.append(len(text))
    assert sentences.sentence_ends(text) == ends, [text[:e][-12:] for e in sentences.sentence_ends(text)]


def test_every_character_is_in_one_sentence_and_long_texts_end():
    text = ('"A b." C (d. e) f. ' * 4000 + "\n\n") * 2 + "«" * 500 + "x. Y"
    ends = sentences.sentence_ends(text)
    assert ends == sorted(set(ends)) and ends[-1] == len(text)
    assert "".join("".join(sentences.split_sentences(text)).split()) == "".join(text.split())
    assert sentences.sentence_ends("") == sentences.sentence_ends(" \n \n\n") == []


def test_tables(spark):
    rows = [(1, ["One. Two.", None, "", "Three"]), (2, None), (3, []), (4, ["Four."]), (5, ["Five. Six."]), (5, ["Five. Six."])]
    df = spark.createDataFrame(rows, "cache_id bigint, pages array<string>").selectExpr("*", "1 AS page_no", "2 AS end_pos")
    sample = spark.createDataFrame([(1,), (1,), (2,), (4,), (None,), (77,)], "cache_id bigint").selectExpr("*", "'x' AS pages")
    got = sorted((r.cache_id, r.page_no, r.end_pos) for r in sentences.sentence_positions(df, sample).collect())
    assert got == [(1, 1, 4), (1, 1, 9), (1, 4, 5), (4, 1, 5)]
    assert sentences.sentence_positions(df).count() == 8
    assert sentences.sentence_positions(df, sample.limit(0)).count() == sentences.sentence_positions(df.limit(0)).count() == 0


def test_the_tables_cascade():
    assert sentences.QUOTED and sentences.BY_SCRIPT["Thai"] and sentences.BY_SCRIPT["Hani"] and sentences.GENERAL
    # the language's abbreviation decides before the general rules, the mark's script before them too
    assert sentences.split_sentences("Der Rat kam z.B. Montag in die Stadt. Dann ging er nicht nach Haus.") == ["Der Rat kam z.B. Montag in die Stadt.", "Dann ging er nicht nach Haus."]
    assert sentences.split_sentences("很久以后，约占4.4%。后来。") == ["很久以后，约占4.4%。", "后来。"]
    assert sentences.split_sentences("They wrote 春天来了。Then they left.") == ["They wrote 春天来了。", "Then they left."]


def test_marks_of_further_scripts():
    for text in ("یہ ایک جملہ ہے۔ یہ دوسرا ہے۔", "ሰላም ነው።ይህ ሁለተኛ ነው።", "ဒါက စာကြောင်း။ ဒုတိယ စာကြောင်း။", "នេះជាប្រយោគ។ នេះជាទីពីរ។", "Սա նախադասություն է։ Սա երկրորդն է։", "これは文｡これも文｡", "यह वाक्य है॥ यह दूसरा है।", "བོད་ཡིག། གཉིས་པ།"):
        assert len(sentences.split_sentences(text)) == 2, text


def test_thai_white_space_by_rules():
    assert len(sentences.split_sentences("แม่หม้ายขายโรงสี พ่อค้าซื้อข้าว")) == 2
    assert len(sentences.split_sentences("ในปี 1820 พ่อค้าซื้อข้าว")) == 1
    assert len(sentences.split_sentences("แม่หม้าย, พ่อค้า")) == 1


def test_a_quotation_belongs_to_its_sentence_by_rule():
    text = 'The clerk wrote "It is late. Go home." and left. The widow stayed.'
    assert sentences.split_sentences(text) == ['The clerk wrote "It is late. Go home." and left.', "The widow stayed."]
