"""Script, language, cleaning and gate functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import languages

# Scripts by character class, in the order that breaks ties.
SCRIPTS = {
    "ja": "[ぁ-ゖァ-ヺー]",
    "han": "[一-鿿]",
    "th": "[\u0e00-\u0e7f]",
    "ko": "[가-힣ㄱ-ㆎ]",
    "latin": "[A-Za-zÀ-ɏ]",
    "cyrillic": "[Ѐ-ӿ]",
    "greek": "[Ͱ-Ͽ]",
    "arabic": "[\u0600-\u06ff]",
    "devanagari": "[\u0900-\u097f]",
}
# The script of languages that Latin does not write.
SCRIPT_OF_LANG = {"ja": "ja", "zh": "han", "yue": "han", "th": "th", "ko": "ko", "ru": "cyrillic", "uk": "cyrillic", "el": "greek", "ar": "arabic", "hi": "devanagari"}
# Code point ranges that a target language may use besides Latin.
TARGET_RANGES = {
    "ja": r"\u3040-\u30ff\u31f0-\u31ff\u4e00-\u9fff\uff66-\uff9f",
    "zh": r"\u4e00-\u9fff\u3400-\u4dbf\u3100-\u312f",
    "yue": r"\u4e00-\u9fff\u3400-\u4dbf",
    "ko": r"\uac00-\ud7af\u1100-\u11ff\u3130-\u318f\u4e00-\u9fff",
    "th": r"\u0e00-\u0e7f",
    "lo": r"\u0e80-\u0eff",
    "km": r"\u1780-\u17ff\u19e0-\u19ff",
    "my": r"\u1000-\u109f\uaa60-\uaa7f",
    "el": r"\u0370-\u03ff\u1f00-\u1fff",
    "ru": r"\u0400-\u052f",
    "uk": r"\u0400-\u052f",
    "bg": r"\u0400-\u052f",
    "he": r"\u0590-\u05ff\ufb1d-\ufb4f",
    "ar": r"\u0600-\u06ff\u0750-\u077f\ufb50-\ufdff\ufe70-\ufeff",
    "fa": r"\u0600-\u06ff\u0750-\u077f\ufb50-\ufdff\ufe70-\ufeff",
    "hi": r"\u0900-\u097f\ua8e0-\ua8ff",
    "bn": r"\u0980-\u09ff",
    "ta": r"\u0b80-\u0bff",
}
_LATIN = r"\u0000-\u024f\u1e00-\u1eff\u0300-\u036f\u2c60-\u2c7f\ua720-\ua7ff"
# Sounds that are no words, hedges that are none, phrases that recognisers make up.
FILLER_WORDS = ("hmm", "mmm", "mm", "ah", "ahh", "aah", "oh", "ooh", "uh", "um", "huh", "ha", "haha")
FILLER_CHARS = "あぁぃぅぇぉっんーはふむ嗯啊哦呃唔哈呀嘿哼嘛哎唉噢喔ー～〜…"
MOANS = "嗯啊哦呃唔哈呀嘿哼嘛哎唉噢喔んあぁいぃうぅえぇおぉっーはぁふぅむぅ・…～〜ー"
SLASH_WORDS = ("and/or", "yes/no", "on/off", "in/out", "input/output", "w/o", "m/f", "male/female", "tcp/ip", "i/o", "a/c", "km/h", "m/s", "r/min", "mph/kph", "n/a")
MADE_UP = ("ご視聴ありがとうございました", "ご視聴いただき", "チャンネル登録", "字幕(は|：|:)", "最後までご覧", "おやすみなさい[。！]?$")
# Patterns of captions, typesetting tags, fillers and notes.
_BARE = r"^\s*(?:[\[(（［〔【][^\])）］〕】]*[\])）］〕】]\s*)+$"
_MUSIC = r"^\s*[♪♫♬～〜\-–—\s]*(?:[\[(（［][^\])）］]*[\])）］])?[♪♫♬～〜\-–—\s]*$"
_SDH_LABEL = r"^\s*(?:[(（][^)）]{1,12}[)）]\s*|[A-ZÀ-Ý][A-ZÀ-Ý .'\-]{1,24}:\s+|[^\s：:\d]{1,10}[：:]\s*(?=\S))"
_CAP_LABEL = r"^\s*[A-ZÀ-Ý][A-ZÀ-Ý .'\-]{1,24}:\s+"
_CAP_TAG = r"\s*[\[(][A-ZÀ-Ý][A-ZÀ-Ý .,'\-]{1,40}[\])]\s*"
_TAGS = r"\\(?:1?c&H|fn|fs\d|t\(|fad|fade|bord|be\d|blur|fsc|fr[xyz]?\d|clip|shad)"
_FILLERS = r"(?i)\b(?:um+|uh+|erm+|hmm+|mm+|ah+|uh-huh)\b[,.]?\s*"
_NOTE = r"(?i)\s*\((?:TN|T/N|Note|Translator'?s? note)[^)]*\)\s*$"
_NUMBERED = r"^\s*\[?(\d+)\]?\s*(?:[\t.．:：)）\-–—]|\s)\s*(.*?)\s*$"
FUNCTION_WORDS, REGISTER = languages.FUNCTION_WORDS, languages.REGISTER
# Words that are no sign of dialogue, and small words a line should not end with.
NO_WORDS = ("hmm", "mmm", "ahh", "ooh", "aah")
SMALL_WORDS = ("the", "a", "an", "to", "of", "and", "or", "in", "on", "at", "for", "with")


def norm(text: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def script_of(text: Column) -> Column:
    names = list(SCRIPTS)

    def pick(n: Column) -> Column:
        n = {k: n[i] for i, k in enumerate(names)}
        most = F.greatest(*n.values())
        out = F.when((n["ja"] > 0) & (n["ja"] + n["han"] >= n["latin"]), "ja").when(most == 0, "none")
        for k, c in n.items():
            out = out.when(c == most, k)
        return out

    # Most texts are ASCII; only the others need every class counted.
    ascii_only = F.when(text.rlike("[A-Za-z]"), "latin").otherwise("none")
    return F.when(F.octet_length(text) == F.length(text), ascii_only).otherwise(let(F.array(*[F.regexp_count(text, F.lit(p)) for p in SCRIPTS.values()]), pick))


def script_matches(text: Column, lang: str) -> Column:
    want = SCRIPT_OF_LANG.get(lang, "latin")
    also = {"latin": ("latin", "none"), "ja": ("ja", "han")}.get(want, (want,))
    return script_of(text).isin(*also)


def words(text: Column) -> Column:
    """Distinct lower-cased Latin words."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.replace(text, F.lit("’"), F.lit("'")), F.lit("[A-Za-zÀ-ɏ']+"), 0), F.lower))


def text_language(text: Column, function_words: dict | None = None) -> Column:
    """struct<lang, hits>: the language that at least three distinct function words point to, 1.5 times the runner-up's."""
    table = function_words or FUNCTION_WORDS

    def rank(w: Column) -> Column:
        hits = [F.struct((-F.size(F.array_intersect(w, F.array(*map(F.lit, ws))))).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("lang")) for i, (k, ws) in enumerate(table.items())]
        return F.array_sort(F.array(*hits))

    def judge(x: Column) -> Column:
        return let(rank(x["known"]), lambda ranked: verdict(x["words"], ranked))

    def verdict(n_words: Column, ranked: Column) -> Column:
        n, second = -ranked[0]["n"], -ranked[1]["n"] if len(table) > 1 else F.lit(0)
        sure = (n_words >= 3) & (n >= 3) & (n >= 1.5 * second)
        return F.struct(F.when(sure, ranked[0]["lang"]).alias("lang"), F.when(sure, n).otherwise(0).alias("hits"))

    every = F.array(*[F.lit(w) for w in sorted({w for ws in table.values() for w in ws})])
    return let(let(words(text), lambda w: F.struct(F.size(w).alias("words"), F.array_intersect(w, every).alias("known"))), judge)


def script_vote(text: Column, function_words: dict | None = None) -> Column:
    """struct<lang, weight>: what script and function words say."""

    def vote(x: Column) -> Column:
        s, t = x["s"], x["t"]
        known = (s == "latin") & t["lang"].isNotNull()
        lang = F.when(s.isin("ja", "th", "ko"), s).when(s == "han", "zh").when(s == "greek", "el").when(known, t["lang"]).when(s == "latin", "en")
        weight = F.when(s.isin("ja", "th", "ko", "greek"), 0.7).when(s == "han", 0.3).when(known, 0.5).when(s == "latin", 0.15).otherwise(0.0)
        return F.struct(lang.alias("lang"), weight.alias("weight"))

    return let(F.struct(script_of(text).alias("s"), text_language(text, function_words).alias("t")), vote)


def lexical(text: Column) -> Column:
    latin = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-zÀ-ɏ]{3,}"), 0), lambda w: ~F.lower(w).isin(*NO_WORDS))
    core = F.length(F.regexp_replace(norm(text), f"[{MOANS}]", ""))
    return F.when(script_of(text) == "latin", F.size(latin) >= 2).otherwise(core >= 4)


def wordlike(text: Column) -> Column:
    bare = norm(text)
    latin = F.exists(F.regexp_extract_all(text, F.lit("[A-Za-zÀ-ɏ]{2,}"), 0), lambda w: ~F.lower(w).isin(*FILLER_WORDS))
    squeezed = F.length(F.regexp_replace(bare, r"(.)\1+", "$1"))
    core = F.length(F.regexp_replace(bare, f"[{FILLER_CHARS}]", ""))
    return (
        F.when(text.rlike("[A-Za-zÀ-ɏ]"), latin)
        .when(F.length(bare) == 1, bare.rlike("[一-鿿]"))
        .when(squeezed < F.length(bare) * 0.5, False)
        .otherwise((F.length(bare) >= 2) & (core >= 1))
    )


def made_up(text: Column, patterns=MADE_UP) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def collapse_loops(text: Column) -> Column:
    """The same 1 to 12 characters four times or more in a row become two."""
    return F.regexp_replace(text, r"(?s)(.{1,12}?)\1{3,}", "$1$1")


def hedged(text: Column) -> Column:
    """Two forms of a word joined by a slash."""
    strip = r"^[.,!?;:\"'()\[\]{}«»「」…]+|[.,!?;:\"'()\[\]{}«»「」…]+$"

    def hedge(tok: Column) -> Column:
        a, b = (F.regexp_replace(F.get(F.split(tok, "/"), i), strip, "") for i in (0, 1))
        upper = (a == F.upper(a)) & (b == F.upper(b)) & (a != F.lower(a)) & (b != F.lower(b))
        alike = F.lower(F.left(a, F.lit(3))) == F.lower(F.left(b, F.lit(3)))
        fixed = F.lower(F.concat(a, F.lit("/"), b)).isin(*SLASH_WORDS)
        return (F.length(tok) - F.length(F.replace(tok, F.lit("/"), F.lit(""))) == 1) & ~tok.rlike("[0-9]") & (a != "") & (b != "") & (F.lower(a) != F.lower(b)) & ~fixed & ~upper & ((F.length(a) <= 2) | (F.length(b) <= 5) | alike)

    return ~text.contains("://") & F.exists(F.split(text, r"\s+"), hedge)


def foreign_letters(text: Column, target: str) -> Column:
    """Letters outside the target's script and Latin."""
    own = TARGET_RANGES.get(target, "")
    marks = r"\u0e31-\u0e4e" if target == "th" else ""
    return F.length(F.regexp_replace(text, rf"[^\p{{L}}]|[{_LATIN}{own}{marks}]", ""))


def untranslated(text: Column, src: str, tgt: str) -> Column:
    empty = F.coalesce(text, F.lit("")) == ""
    if src == tgt or SCRIPT_OF_LANG.get(src, "latin") == "latin":
        return empty
    return empty | (script_matches(text, src) & ~script_matches(text, tgt))


def copy_through(text: Column, lang: str) -> Column:
    s = F.trim(F.regexp_replace(text, r"\s+", " "))
    if lang != "en":
        return s
    s = F.trim(F.regexp_replace(s, _FILLERS, ""))
    return F.regexp_replace(s, r"\s+([,.!?])", "$1")


def clean_line(text: Column, target: str = "en") -> Column:
    """A translated line without speaker tags, notes and outer quotes."""
    s = F.regexp_replace(F.trim(text), r"^\s*\[S\d+\]\s*", "")
    s = F.regexp_replace(s, _NOTE, "")
    quoted = (F.length(s) >= 2) & s.rlike("(?s)^[\"“'‘].*[\"”'’]$")
    s = F.when(quoted, F.trim(F.substr(s, F.lit(2), F.length(s) - 2))).otherwise(s)
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return s if target in ("ja", "zh", "yue", "ko") else F.translate(s, "。、", ".,")


def _by_line(text: Column, change) -> Column:
    return F.array_join(F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), change), lambda s: s != ""), "\n")


def clean_sdh(text: Column) -> Column:
    """Dialogue of a caption for the deaf: no sounds, no music, no speaker labels."""
    def line(s: Column) -> Column:
        s = F.trim(s)
        return F.when(s.rlike(_BARE) | s.rlike(_MUSIC), "").otherwise(F.trim(F.regexp_replace(s, _SDH_LABEL, "")))

    return _by_line(text, line)


def clean_captions(text: Column) -> Column:
    """Upper-case labels and tags and lines of music out of an ordinary caption."""

    def line(s: Column) -> Column:
        s = F.trim(s)
        t = F.regexp_replace(s, _CAP_LABEL, "")
        t = F.trim(F.regexp_replace(t, _CAP_TAG, " "))
        return F.when(s.rlike(_MUSIC) | t.rlike(_BARE), "").otherwise(t)

    return _by_line(text, line)


def clean_ocr(text: Column, lang: str) -> Column:
    s = F.replace(text, F.lit("\u0e4d\u0e32"), F.lit("\u0e33")) if lang == "th" else text
    steps = [(r"\\?[cl]dots", "…"), (r"(?m)^[-_](?=\S)", "- "), (r"(?<=\s)[-_](?=[^\s\-_])", "- "), (r"(?U)(?<![\w|])\|(?=['’]|\s+[a-z]|$)", "I"), (r"\biI(?=[a-z])", "I")]
    steps += [(r"(?U)(?<![\w'])l(?=['’](?:m|ll|ve|d)\b|\s+[a-z])", "I")] if lang == "en" else []
    for pattern, by in steps:
        s = F.regexp_replace(s, pattern, by)
    return _by_line(s, lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))


def is_sdh(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(r"(?i)sdh|hearing|\bcc\b|closed caption")


def decorated(body: Column) -> Column:
    """Three override blocks or more with typesetting tags."""
    return F.size(F.filter(F.regexp_extract_all(body, F.lit(r"\{[^}]*\}"), 0), lambda b: b.rlike(_TAGS))) >= 3


def symbols(text: Column) -> Column:
    """Characters that are no letters, digits, spaces, usual punctuation or combining marks."""
    return F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s.,:;!?'\"\-–—…()\[\]「」『』、。！？・“”‘’«»¿¡/&+♪\u3000\u0300-\u036f\u0e31-\u0e4e\u3099-\u309a]", ""))


def junk_line(line: Column) -> Column:
    """Two characters or more, 40 % of them digits and symbols at least."""
    body = F.regexp_replace(line, r"\s", "")
    bad = F.length(F.regexp_replace(body, r"\P{Nd}", "")) + symbols(F.regexp_replace(body, r"\p{Nd}", ""))
    return (F.length(body) >= 2) & (bad >= 0.4 * F.length(body))


def parse_numbered(text: Column) -> Column:
    """map<int, string>: lines "n. text"; the first that is not empty stays."""
    pattern = _NUMBERED
    rows = F.filter(F.split(text, r"\r\n|\r|\n"), lambda s: F.trim(s).rlike(pattern))
    pairs = F.transform(rows, lambda s, i: F.struct(F.regexp_extract(F.trim(s), pattern, 1).cast("int").alias("n"), (F.regexp_extract(F.trim(s), pattern, 2) == "").alias("empty"), i.alias("i"), F.regexp_extract(F.trim(s), pattern, 2).alias("text")))
    ranked = F.array_sort(pairs)
    first = F.filter(ranked, lambda x, i: (i == 0) | (F.get(ranked, i - 1)["n"] != x["n"]))
    return F.map_from_entries(F.transform(first, lambda x: F.struct(x["n"], x["text"])))


def wrap_lines(text: Column, width: int = 42) -> Column:
    """array<string>: one line, or the two-line split of least score (balance, with a bonus behind punctuation and a malus
    behind small words); null if neither fits."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    w = F.split(t, " ")

    def scored(k: Column) -> Column:
        a, b = F.array_join(F.slice(w, 1, k), " "), F.array_join(F.slice(w, k + 1, F.size(w)), " ")
        small = F.lower(F.get(w, k - 1)).isin(*SMALL_WORDS)
        score = F.abs(F.length(a) - F.length(b)) - F.when(a.rlike("[,.;:!?—]$"), 6).otherwise(0) + F.when(small, 8).otherwise(0)
        return F.struct(score.alias("score"), k.alias("k"), F.array(a, b).alias("lines"))

    # Two lines hold 2 * width characters and the space between them.
    splits = F.transform(F.when((F.size(w) > 1) & (F.length(t) <= 2 * width + 1), F.sequence(F.lit(1), F.size(w) - 1)).otherwise(F.array().cast("array<int>")), scored)
    fitting = F.filter(splits, lambda x: (F.length(x["lines"][0]) <= width) & (F.length(x["lines"][1]) <= width))
    return F.when(F.length(t) <= width, F.array(t)).otherwise(F.array_min(fitting)["lines"])


def language_of_text(text: Column, least: int = 200, hits: int = 10) -> Column:
    """The language of a subtitle text by its lines of dialogue: by script, or by ``hits`` function words; null if it says too little."""
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^\d+$") & ~x.contains("-->"))

    def judge(body: Column) -> Column:
        return let(F.struct(script_of(body).alias("s"), F.length(body).alias("n"), text_language(body).alias("t")), lambda x: F.when(x["n"] < least, F.lit(None).cast("string")).when(x["s"].isin("ja", "th", "ko"), x["s"]).when(x["s"] == "han", "zh").when(x["s"] == "greek", "el").when((x["s"] == "latin") & (x["t"]["hits"] >= hits), x["t"]["lang"]))

    return let(F.array_join(lines, " "), judge)


def code_from_name(name: Column) -> Column:
    """The code of a language's English name or code; null for others."""
    table = {v.lower(): k for k, v in languages.NAMES.items()} | {"mandarin": "zh", "cantonese": "yue", "chinese": "zh"}
    s = F.lower(F.trim(name))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), s), F.when(s.isin(*languages.NAMES), s))


def safe_stem(name: Column, most: int = 150) -> Column:
    """A name for files: letters, digits, - _ . and _ for all others, up to ``most`` bytes of whole characters."""
    safe = F.regexp_replace(name, r"[^\p{L}\p{N}_.-]", "_")
    cut = F.substring(safe.cast("binary"), 1, most)
    return F.when(F.octet_length(safe) <= most, safe).otherwise(_whole(safe, cut))


def _whole(safe: Column, cut: Column) -> Column:
    """The longest start of safe whose bytes are within cut: a start of as many characters, or of up to three fewer."""
    n = F.length(F.regexp_replace(F.hex(cut), "[89AB][0-9A-F]|([0-7C-F][0-9A-F])", "$1")) / 2  # the first bytes of characters
    return F.when(F.octet_length(F.left(safe, n.cast("int"))) <= F.octet_length(cut), F.left(safe, n.cast("int"))).otherwise(F.left(safe, n.cast("int") - 1))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def register(text: Column, lang: str, cls: str, table=REGISTER) -> Column:
    """array<string>: the values of the class that a line shows; politeness is read off what is behind the last slash."""
    flat = F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))
    flat = F.trim(F.element_at(F.split(flat, "/"), -1)) if cls == "polite" else flat
    shown = [F.when(flat.rlike(("(?U)" if case else "(?iU)") + p), v) for la, c, v, p, case in table if (la, c) == (lang, cls)]
    return F.array_compact(F.array(*shown)) if shown else F.array().cast("array<string>")


def features(text: Column, lang: Column, table=REGISTER) -> Column:
    """map<class, values>: what a line in its language shows; null for languages without register."""
    out = None
    for la in dict.fromkeys(x[0] for x in table):
        shown = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("class"), register(text, la, c, table).alias("values")) for c in dict.fromkeys(x[1] for x in table if x[0] == la)]), lambda e: F.size(e["values"]) > 0))
        out = F.when(lang == la, shown) if out is None else out.when(lang == la, shown)
    return out


def clean_reply(text: Column, labels: tuple[str, ...] = ("reconciled transcript", "transcript")) -> Column:
    """A model's reply without thoughts, label, outer quotes, and spaces between CJK characters."""
    s = F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", ""))
    s = F.trim(F.regexp_replace(s, rf"(?i)^(?:{'|'.join(labels)})\s*[:：]\s*", ""))
    s = F.when((F.length(s) >= 2) & s.rlike('(?s)^["“「].*["”」]$'), F.trim(F.substr(s, F.lit(2), F.length(s) - 2))).otherwise(s)
    return F.regexp_replace(s, r"(?<=[぀-ヿ一-鿿])\s+(?=[぀-ヿ一-鿿])", "")


def clean_ja_line(text: Column) -> Column:
    """A display line without override tags, sound-only brackets and a leading speaker in brackets."""
    s = F.translate(F.trim(F.regexp_replace(text, r"\{[^}]*\}", "")), "＜＞", "")
    s = F.when(s.rlike(r"^\s*(?:[(（\[［〔♪～][^)）\]］〕]*[)）\]］〕♪～]?\s*)$"), "").otherwise(s)
    return F.trim(F.regexp_replace(s, r"^[(（][^)）]{1,12}[)）]\s*", ""))
