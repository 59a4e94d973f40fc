"""Language tables. All are fixed values that results depend on; functions take them as parameters, so callers may pass their own."""

from __future__ import annotations

# Code and English name, in the order in which a source language is preferred.
NAMES = {
    "ja": "Japanese", "en": "English", "zh": "Chinese (Simplified)", "yue": "Cantonese (Traditional)", "ko": "Korean", "th": "Thai",
    "fr": "French", "de": "German", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "ru": "Russian", "id": "Indonesian",
    "vi": "Vietnamese", "tr": "Turkish", "hi": "Hindi", "ar": "Arabic", "nl": "Dutch", "pl": "Polish", "cs": "Czech", "sv": "Swedish",
    "da": "Danish", "fi": "Finnish", "no": "Norwegian", "hu": "Hungarian", "ro": "Romanian", "el": "Greek", "uk": "Ukrainian",
    "ms": "Malay", "tl": "Filipino", "fa": "Persian", "he": "Hebrew", "bn": "Bengali", "ta": "Tamil", "km": "Khmer", "lo": "Lao",
    "my": "Burmese", "ca": "Catalan", "bg": "Bulgarian", "hr": "Croatian", "sk": "Slovak", "sl": "Slovenian", "lt": "Lithuanian",
    "lv": "Latvian", "et": "Estonian",
}
# How a language names itself.
NATIVE = {
    "ja": "日本語", "en": "English", "zh": "中文（简体）", "yue": "粵語（繁體）", "ko": "한국어", "th": "ไทย", "fr": "Français", "de": "Deutsch",
    "es": "Español", "it": "Italiano", "pt": "Português", "ru": "Русский", "id": "Bahasa Indonesia", "vi": "Tiếng Việt", "tr": "Türkçe",
    "hi": "हिन्दी", "ar": "العربية", "nl": "Nederlands", "pl": "Polski", "cs": "Čeština", "sv": "Svenska", "da": "Dansk", "fi": "Suomi",
    "no": "Norsk", "hu": "Magyar", "ro": "Română", "el": "Ελληνικά", "uk": "Українська", "ms": "Bahasa Melayu", "tl": "Filipino",
    "fa": "فارسی", "he": "עברית", "bn": "বাংলা", "ta": "தமிழ்", "km": "ខ្មែរ", "lo": "ລາວ", "my": "မြန်မာ", "ca": "Català",
    "bg": "Български", "hr": "Hrvatski", "sk": "Slovenčina", "sl": "Slovenščina", "lt": "Lietuvių", "lv": "Latviešu", "et": "Eesti",
}
# Container tags besides the code and the English name.
TAGS = {
    "en": "eng", "ja": "jpn jp", "th": "tha", "zh": "zho chi cmn", "ko": "kor", "yue": "yue", "de": "ger deu", "fr": "fre fra", "es": "spa",
    "it": "ita", "pt": "por", "ru": "rus", "id": "ind", "vi": "vie", "tr": "tur", "hi": "hin", "ar": "ara", "nl": "dut nld", "pl": "pol",
    "cs": "cze ces", "sv": "swe", "da": "dan", "fi": "fin", "no": "nor nob nno", "hu": "hun", "ro": "rum ron", "el": "gre ell", "uk": "ukr",
    "ms": "may msa", "tl": "tgl fil", "fa": "per fas", "he": "heb", "bn": "ben", "ta": "tam", "km": "khm", "lo": "lao", "my": "bur mya",
    "ca": "cat", "bg": "bul", "hr": "hrv scr", "sk": "slo slk", "sl": "slv", "lt": "lit", "lv": "lav", "et": "est",
}
# Words in a track's title besides the two names; for two languages instead of them.
TITLE_EXTRA = {"zh": "中文 简体 繁體 繁体", "tl": "tagalog filipino", "fa": "farsi persian", "my": "myanmar burmese", "no": "bokmål nynorsk"}
TITLE_ONLY = {"id": ("indonesian", "bahasa indonesia", "bahasa"), "ms": ("malay", "bahasa melayu")}
# Which languages mark what a target needs to know, what stands for what, and how well each is read (least first).
MARKS = {
    "he": "gender", "ar": "gender formality", "hi": "gender formality", "bn": "formality", "ta": "gender formality", "fr": "formality",
    "de": "formality", "es": "formality", "it": "formality", "pt": "formality", "nl": "formality", "ru": "gender formality",
    "pl": "gender formality", "cs": "gender formality", "sk": "gender formality", "sl": "gender formality", "hr": "gender formality",
    "bg": "gender formality", "uk": "gender formality", "el": "gender formality", "ro": "formality", "hu": "formality", "fi": "formality",
    "tr": "formality", "ko": "politeness", "ja": "politeness gender", "th": "politeness gender", "vi": "relationship", "id": "politeness",
}
NEEDS = {
    "th": "gender politeness", "ja": "gender politeness", "ko": "politeness", "vi": "politeness relationship", "id": "politeness",
    "ms": "politeness", "my": "gender politeness", "km": "politeness", "lo": "politeness", "he": "gender", "ar": "formality gender",
    "fa": "formality", "hi": "formality gender", "bn": "formality", "ta": "formality gender", "fr": "formality", "de": "formality",
    "es": "formality", "it": "formality", "pt": "formality", "nl": "formality", "ru": "formality gender", "pl": "formality gender",
    "cs": "formality gender", "sk": "formality gender", "sl": "formality gender", "hr": "formality gender", "bg": "formality gender",
    "uk": "formality gender", "el": "formality gender", "ro": "formality", "hu": "formality", "fi": "formality", "et": "formality",
    "lt": "formality gender", "lv": "formality gender", "tr": "formality", "sv": "formality", "da": "formality", "no": "formality",
}
STANDS_FOR = {"politeness": ("politeness", "formality"), "formality": ("formality", "politeness"), "relationship": ("relationship", "formality", "politeness"), "gender": ("gender",)}
READ_BEST = "he fr de es it pt ko ja nl ru pl cs th vi el ro hu fi tr uk hr sk sl bg id hi ar ta bn".split()
# The languages preferred as a source, before all others.
SOURCES_FIRST = ("ja", "en", "zh", "ko", "th")
# Words that tell Latin-script languages apart.
FUNCTION_WORDS = {
    k: tuple(v.split())
    for k, v in {
        "en": "the and you that this with have what your they about there which would their were from just when because",
        "es": "el los las que por como pero está usted muy más también nosotros ellos tiene hay donde aquí porque una",
        "fr": "les des est vous nous une pas pour dans avec sur qui c'est très aussi même votre notre cette sont",
        "de": "und ist nicht ich sie das wir ein eine auch der die dem mit sich aber noch nur schon haben wird",
        "it": "che della delle sono perché anche questo questa come gli nel dalla essere molto quando c'è lei una",
        "pt": "não você com uma isso ele ela nós eles está muito também mas são tem porque quando aqui",
        "nl": "het een niet van dat ik hij zij wij jullie maar ook nog wel zijn heeft worden deze omdat waarom",
        "pl": "nie się jest co jak ale już tylko tego jego bardzo może czy tak jeszcze będzie przez",
        "tr": "bir ve bu için ama değil çok daha onlar yok mı nasıl şimdi burada",
        "id": "yang dan tidak ini itu dengan untuk saya kamu kita mereka adalah akan sudah bisa ada apa karena",
        "ms": "yang dan tidak ini itu dengan untuk saya awak kita mereka adalah akan sudah boleh ada apa kerana",
        "tl": "ang ng mga sa ako ikaw siya kami tayo hindi ito iyan iyon kasi lang naman ba",
        "vi": "và của không có tôi bạn anh chị chúng được này đó như rồi đã sẽ",
        "ca": "els una que amb per com però està molt també nosaltres aquest aquesta són hi",
        "ro": "și este sunt pentru dar foarte acest această noi voi lor când unde",
        "sv": "och är inte jag det att han hon också bara har kan ska ni när",
        "da": "og er ikke jeg det hun også bare har kan skal når hvor",
        "no": "og er ikke jeg det hun også bare har kan skal når hvor",
        "fi": "ja ei minä sinä hän mutta myös vain olen olet ovat kun missä",
        "hu": "és nem az egy hogy vagyok vagy ők csak még már nagyon mert",
        "cs": "ale jsem jsi jsme jste jsou tak jak taky jen už ještě proč protože",
        "sk": "ale som sme ste sú tak ako tiež len už ešte prečo pretože",
        "hr": "ali sam smo ste su tako kako također samo već još zašto jer",
        "sl": "ampak sem smo ste so tako kako tudi samo že še zakaj ker",
        "lt": "yra bet aš tu mes jūs jie taip kaip pat tik jau dar kodėl nes",
        "lv": "bet es tu mēs jūs viņi tā kā arī tikai jau vēl kāpēc jo",
        "et": "ja ei aga mina sina meie teie nemad nii kuidas ka ainult juba veel miks sest",
    }.items()
}
# Register by language, class, value and pattern. Case counts where the flag is set.
REGISTER = [
    ("th", "particle", "m", r"ครับ|คร้าบ", False), ("th", "particle", "f", r"ค่ะ|คะ", False),
    ("th", "self", "phom", r"ผม", False), ("th", "self", "chan", r"ฉัน|ดิฉัน", False), ("th", "self", "nu", r"หนู", False),
    ("th", "self", "rao", r"เรา", False), ("th", "self", "ku", r"กู|ข้า", False),
    ("th", "address", "khun", r"คุณ", False), ("th", "address", "thoe", r"เธอ", False), ("th", "address", "kae", r"แก|มึง|นาย", False),
    ("th", "address", "kin", r"พ่อ|แม่|ลุง|ป้า|น้า|อา|ปู่|ย่า|ตา|ยาย", False),
    ("fr", "tv", "tu", r"\b(?:tu|toi|te)\b|\bt'", False), ("fr", "tv", "vous", r"\b(?:vous|votre|vos)\b", False),
    ("de", "tv", "du", r"\b(?:du|dich|dir|dein|deine|deinen|deiner|deinem|deines)\b", True),
    ("de", "tv", "sie", r"\b(?:Sie|Ihnen|Ihr|Ihre|Ihren|Ihrer|Ihrem)\b", True),
    ("es", "tv", "tu", r"\b(?:tú|te|ti|contigo)\b", False), ("es", "tv", "usted", r"\b(?:usted|ustedes)\b", False),
    ("it", "tv", "tu", r"\b(?:tu|te|ti)\b", True), ("it", "tv", "lei", r"\b(?:Lei|Le)\b", True),
    ("ko", "polite", "polite", r"(?:요|습니다|니다|세요|십시오|습니까)[.?!…\"'」]*$", False),
    ("ko", "polite", "plain", r"(?:다|야|어|아|지|니|냐|네|자|군|라|걸)[.?!…\"'」]*$", False),
    ("ja", "polite", "polite", r"(?:です|ます|ました|ません|でした|ましょう)[。？！…」]*$", False),
    ("ja", "polite", "plain", r"(?:だ|だよ|だね|だろ|た|ない|る|う|よ|ね|ぞ|ぜ|か|さ|の|わ)[。？！…」]*$", False),
    ("ja", "self", "boku", r"僕|ぼく", False), ("ja", "self", "ore", r"俺|おれ", False), ("ja", "self", "watashi", r"私|わたし", False), ("ja", "self", "atashi", r"あたし", False),
    ("he", "you", "m", r"(?<![א-ת])(?:אתה)(?![א-ת])", False), ("he", "you", "f", r"(?<![א-ת])(?:את)(?![א-ת])", False),
    ("vi", "pronoun", "anh", r"\b[Aa]nh\b", True), ("vi", "pronoun", "em", r"\b[Ee]m\b", True), ("vi", "pronoun", "chi", r"\b[Cc]hị\b", True),
    ("vi", "pronoun", "toi", r"\b[Tt]ôi\b", True), ("vi", "pronoun", "cau", r"\b(?:[Cc]ậu|[Tt]ớ)\b", True), ("vi", "pronoun", "may", r"\b(?:[Mm]ày|[Tt]ao)\b", True),
    ("vi", "pronoun", "con", r"\b[Cc]on\b", True), ("vi", "pronoun", "bo", r"\b(?:[Bb]ố|[Mm]ẹ|[Bb]a|[Mm]á)\b", True), ("vi", "pronoun", "ong", r"\b(?:[Ôô]ng|[Bb]à|[Cc]háu)\b", True),
    ("cs", "tv", "ty", r"\b(?:ty|tě|tebe|ti|tobě|tvůj|tvoje|tvá|tvé)\b", False), ("cs", "tv", "vy", r"\b(?:vy|vás|vám|váš|vaše)\b", False),
    ("pl", "tv", "ty", r"\b(?:ty|ciebie|cię|tobie|ci|twój|twoja|twoje)\b", False), ("pl", "tv", "vy", r"\b(?:pan|pani|państwo|pana|panu|panią)\b", False),
    ("ru", "tv", "ty", r"\b(?:ты|тебя|тебе|тобой|твой|твоя|твоё|твои)\b", False), ("ru", "tv", "vy", r"\b(?:вы|вас|вам|вами|ваш|ваша|ваше|ваши)\b", False),
    ("uk", "tv", "ty", r"\b(?:ти|тебе|тобі|тобою|твій|твоя|твоє|твої)\b", False), ("uk", "tv", "vy", r"\b(?:ви|вас|вам|вами|ваш|ваша|ваше|ваші)\b", False),
    ("el", "tv", "esy", r"\b(?:εσύ|σε|σου|σένα)\b", False), ("el", "tv", "eseis", r"\b(?:εσείς|σας)\b", False),
    ("hu", "tv", "te", r"\b(?:te|téged|neked|tied|tiéd)\b", False), ("hu", "tv", "on", r"\b(?:ön|önt|önnek|maga|magát|magának)\b", False),
    ("hr", "tv", "ti", r"\b(?:ti|tebe|tebi|tvoj|tvoja|tvoje)\b", False), ("hr", "tv", "vi", r"\b(?:vi|vas|vama|vaš|vaša|vaše)\b", False),
]


def tags(code: str) -> tuple[str, ...]:
    """All container tags of a language."""
    return tuple(dict.fromkeys([code, NAMES[code].lower(), *TAGS.get(code, "").split()]))


def title_words(code: str) -> tuple[str, ...]:
    """Words of which one in a track's title names the language."""
    return TITLE_ONLY.get(code) or tuple(dict.fromkeys([NAMES[code].lower(), NATIVE[code].lower(), *TITLE_EXTRA.get(code, "").split()]))
