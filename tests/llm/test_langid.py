from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import langid

SAMPLES = {
    "en": "The ferry was sold to the council of the town, and nobody knew why it had been built. It is on the river near the mill.",
    "de": "Die Fähre wurde an den Rat der Stadt verkauft, und niemand wusste, warum sie gebaut worden war. Sie liegt an dem Fluss bei der Mühle.",
    "fr": "Le bac a été vendu au conseil de la ville, et personne ne savait pourquoi il avait été construit. Il est sur la rivière près du moulin.",
    "es": "El barco fue vendido al concejo de la villa, y nadie sabía por qué lo habían construido. Está en el río cerca del molino.",
    "it": "Il traghetto fu venduto al consiglio della città, e nessuno sapeva perché era stato costruito. È sul fiume vicino al mulino.",
    "pt": "A barca foi vendida ao conselho da vila, e ninguém sabia por que não tinha sido construída. Está no rio perto do moinho.",
    "nl": "De veerboot werd verkocht aan de raad van de stad, en niemand wist waarom hij gebouwd was. Hij ligt op de rivier bij de molen.",
    "ru": "Паром продали совету города, и никто не знал, почему его построили. Он стоит на реке у старой мельницы.",
    "uk": "Пором продали раді міста, і ніхто не знав, чому його побудували. Він стоїть на річці біля старого млина.",
    "el": "Το πορθμείο πουλήθηκε στο συμβούλιο της πόλης και κανείς δεν ήξερε γιατί είχε χτιστεί. Είναι στο ποτάμι κοντά στον μύλο.",
    "ar": "بيعت العبارة إلى مجلس المدينة ولم يعرف أحد لماذا بنيت. وهي على النهر قرب الطاحونة القديمة.",
    "hi": "नाव नगर परिषद को बेच दी गई और किसी को नहीं पता था कि वह क्यों बनाई गई थी। वह नदी पर चक्की के पास है।",
    "ja": "渡し船は町の評議会に売られたが、なぜ造られたのかはだれも知らなかった。それは川の水車小屋の近くにある。そこには今も古い石の橋がある。",
    "zh": "渡船被卖给了镇议会，没有人知道它为什么被造出来。它在河上，靠近磨坊，旁边还有一座古老的石桥，村里的人都从那里走过去。",
    "th": "เรือข้ามฟากถูกขายให้แก่สภาเมือง และไม่มีใครรู้ว่าทำไมจึงสร้างขึ้น มันอยู่ในแม่น้ำใกล้โรงสีเก่า",
}


@pytest.fixture(scope="module")
def models():
    return langid.TrigramModels().learn([(lang, [text]) for lang, text in SAMPLES.items()])


def test_labels(spark):
    cases = {"en": "en", "EN": "en", "en-GB": "en", "English": "en", "English (UK)": "en", "deu": "de", "zh_TW": "zh", "UK": "uk", "ukr": "uk", "日本語": "ja", " fr ": "fr", "unknown": None, "und": None, "?": None, "": None, None: None, "klingon": None, "Brazilian Portuguese": "pt", "Chinese (Traditional)": "zh", "en?": "en", "simplified chinese": "zh", "not de": None, "mul": None, "xx-en": None}
    df = spark.createDataFrame([(k, v) for k, v in enumerate(cases)], "k int, v string").orderBy("k")
    assert [r.c for r in df.select(langid.label_code(F.col("v")).alias("c")).collect()] == list(cases.values())


def test_seeds_alone_know_the_languages():
    seeds = langid.TrigramModels()
    right = sum(langid.LANGUAGES[seeds.score([text])[0][0].argmax()] == lang for lang, text in SAMPLES.items())
    assert right >= 13


def test_mixed_documents(models):
    page = "\n\n".join([SAMPLES["en"], "Kurz", SAMPLES["de"] + " " + SAMPLES["de"] + " " + SAMPLES["fr"], SAMPLES["ja"]])
    got = langid.read_document([page, None, "", SAMPLES["ar"]], models)
    assert [(p, q, lang) for p, q, lang, _ in got] == [(1, 1, "en"), (1, 3, "de"), (1, 4, "ja"), (4, 1, "ar")]
    assert got[0][3] > 0.9 and got[1][3] < 0.9
    assert langid.read_document(None, models) == langid.read_document([], models) == []


def test_inference_drops_languages_without_support():
    scores = np.full((10, len(langid.LANGUAGES)), -100.0)
    scores[:, 2] = -50
    scores[4, 5] = -49
    posterior, share = langid.infer(scores)
    assert posterior.argmax(1).tolist() == [2] * 10 and share[5] == 0
    scores[4, 5] = -20
    assert langid.infer(scores)[0].argmax(1)[4] == 5


def test_tables(spark):
    records = [(k, [text, "\n\n".join([text, SAMPLES["en"]])]) for k, text in enumerate(SAMPLES.values())]
    records += [(100, None), (101, []), (102, [None, " "]), (103, [SAMPLES["fr"] * 400]), (104, [SAMPLES["es"]])]
    labels = [(k, lang) for k, lang in enumerate(SAMPLES)] + [(100, "en"), (101, None), (102, "en"), (103, "German"), (104, "unknown"), (104, None), (999, "en"), (None, "en")]
    r = spark.createDataFrame(records, "cache_id bigint, pages array<string>").selectExpr("*", "'x' AS lang", "1 AS label")
    d = spark.createDataFrame(labels, "cache_id bigint, lang string").selectExpr("*", "2 AS pages")
    got = {(x.cache_id, x.page_no, x.para_no): x.lang for x in langid.mislabelled(r, d).collect()}
    expected = {(k, 2, 2): "en" for k, lang in enumerate(SAMPLES) if lang != "en"} | {(103, 1, 1): "fr", (104, 1, 1): "es"}
    assert got == expected
    assert langid.mislabelled(r, d.limit(0)).count() == langid.mislabelled(r.limit(0), d).count() == 0


def test_the_document_decides_what_a_chunk_leaves_open():
    # one chunk looks a little more like another language: by itself it would go there, in its document it does not
    scores = np.full((12, len(langid.LANGUAGES)), -40.0)
    es, pt, de = (langid.LANGUAGES.index(k) for k in ("es", "pt", "de"))
    scores[:, es], scores[:, pt] = -10.0, -22.0
    scores[7, [es, pt]] = -10.0, -8.5
    posterior, shares = langid.infer(scores)
    assert scores[7].argmax() == pt and posterior[7].argmax() == es and shares[es] == 1 and shares[pt] == 0
    # a language that several chunks surely have stays, with its share
    scores[9:, de] = 5.0
    posterior, shares = langid.infer(scores)
    assert np.isclose(shares[de], 0.25, atol=0.01) and posterior[10].argmax() == de and shares[pt] == 0
    # the same evidence for each chunk is weaker evidence for a language in a longer document
    gain = lambda n: langid.infer(np.where(np.arange(n)[:, None] == 0, [[-9.0, 1.0]], [[-5.0, -60.0]]))[1][1]
    assert gain(3) > 0 == gain(3000)


def test_languages_of_a_document(spark):
    german = "Der Rat der Stadt verkaufte das alte Haus an die Witwe, und sie wohnte dort mit den Kindern. Niemand wusste, warum der Brief nicht gekommen war."
    english = "The council of the town sold the old house to the widow, and she lived in it with her children. Nobody knew why the letter had not come to them."
    records = [(k, [f"{german}\n\n{german}"], "de") for k in range(20)] + [(100 + k, [f"{english}\n\n{english}"], "en") for k in range(20)]
    records += [(200, [f"{german}\n\n{english}", english, None], "de"), (201, None, "de"), (202, [""], None), (203, ["1234 5678 " * 20], "en")]
    r = spark.createDataFrame([x[:2] for x in records], "cache_id bigint, pages array<string>").selectExpr("*", "1 AS lang")
    labels = spark.createDataFrame([(k, code) for k, _, code in records], "cache_id bigint, lang string")
    got = {}
    for x in langid.document_languages(r, labels).collect():
        got.setdefault(x.cache_id, {})[x.lang] = x.share
    assert set(got) == {*range(20), *range(100, 120), 200} and set(got[5]) == {"de"} and set(got[105]) == {"en"}
    assert set(got[200]) == {"de", "en"} and 0.55 < got[200]["en"] < 0.8 and abs(sum(got[200].values()) - 1) < 1e-6
    assert langid.document_languages(r.limit(0), labels).count() == langid.document_languages(r, labels.limit(0)).count() == 0
