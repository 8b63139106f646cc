"""Fixed values about languages: frequent function words, scripts and code names."""

from __future__ import annotations

#: Frequent function words of each language; for Chinese, Japanese and Thai, frequent particles inside running text.
FUNCTION_WORDS = {
    "ar": "في من على إلى عن مع هذا هذه كان كانت التي الذي أن لا ما يا لم بين قد كل بعد عند هو هي ثم أو أي حتى",
    "de": "der die das den dem des und ein eine einen einer eines mit von zu zur zum im in am an auf aus bei für über nicht war ist sich nach wie wegen ohne gegen zwischen seit als auch es",
    "el": "ο η το οι τα του της των τον την και σε με από για στο στη στην στον κατά παρά χωρίς ένα μια ένας ότι δεν να που ήταν είναι προς μεταξύ",
    "en": "the of and a an in to that was by for with as at on no each which when although because it is under near long before his her from between against its this not be or had while them",
    "es": "el la los las de del y un una en por con sin para que se al como según contra entre durante a su no sobre cerca más es fue",
    "fr": "le la les de des du et un une en par pour avec sans que qui au aux dans sur selon contre entre pendant comme d'après l' à se ne pas est ce cette chez plus",
    "hi": "के का की को ने में से पर और है हैं था थी थे यह वह एक कि किया दिया नहीं भी तक साथ बिना हर लिए इस ही तो",
    "it": "il lo la i gli le di del della dei delle e un una uno in per con senza che si al alla dei nel nella su secondo contro tra come da dal non è a più dell'",
    "ja": "の は を に が で と も た して から まで ため よう です ます ない れた った という",
    "nl": "de het een van en in op met voor zonder dat die te bij aan uit naar door om tegen tussen volgens zoals niet is was over onder elk der zijn haar",
    "pt": "o a os as de do da dos das e um uma em por com sem para que se ao à no na nos nas pelo pela segundo contra entre durante como não sua é mais",
    "ru": "и в во не на с со к у от по за из для что как о об при до без между он она оно они его их или же бы это был была были под против после между из-за году года но а над если",
    "th": "ที่ ของ และ ใน การ เป็น ได้ ไม่ ความ ให้ จาก มี กับ โดย เพราะ ตลอด ใกล้ จะ ก็ แต่",
    "uk": "і й та в у не на з із зі до від по за для що як про при без між він вона воно вони його її їх або це був була були під через проти після між році року але а над якщо",
    "zh": "的 了 是 在 和 与 有 不 也 其 这 为 对 以 于 被 把 从 而 并 将",
}

#: Names of the languages in English and in the language itself, and codes with three letters, in lower case.
LANGUAGE_NAMES = {
    "ar": "ara arabic العربية عربي",
    "de": "deu ger german deutsch",
    "el": "ell gre greek ελληνικά ελληνικα",
    "en": "eng english",
    "es": "spa spanish español espanol castellano castilian",
    "fr": "fra fre french français francais",
    "hi": "hin hindi हिन्दी हिंदी",
    "it": "ita italian italiano",
    "ja": "jpn japanese 日本語 jp",
    "nl": "nld dut dutch nederlands flemish vlaams",
    "pt": "por portuguese português portugues",
    "ru": "rus russian русский",
    "th": "tha thai ไทย ภาษาไทย",
    "uk": "ukr ukrainian українська ua",
    "zh": "zho chi chinese 中文 汉语 漢語 普通话 mandarin cmn cn",
}

LANGUAGES = tuple(sorted(FUNCTION_WORDS))
UNSPACED = ("ja", "th", "zh")
