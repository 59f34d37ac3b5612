"""Bytes to text: byte order marks, UTF-8, and a guess among legacy encodings."""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters beyond ASCII by language, the frequent ones first.
LETTERS = {
    "fr": "éèàêçôâîùûœëïÉÀÇ", "de": "üäößÜÄÖ", "es": "óáíñéú¿¡üÁÉ", "pt": "ãçéáóíêõúâàô", "it": "àèòùéìÈ", "sv": "äöåéÅÄÖ", "da": "øåæéØÅÆ", "nl": "ëéïöüè", "is": "íáðéöþóúæý",
    "cs": "íáěéčžřšýůúňťďóŽŠČ", "sk": "áíčéžšýúľťôäňďóĺŕ", "pl": "łęóążśćńźŁŚŻ", "hu": "áéöíóőüúűÉÁ", "ro": "ăîţşâ", "hr": "čšžćđŠČŽ", "tr": "ıüşğçöİÇŞÖÜâ",
    "ru": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", "uk": "оаинтіверсклудпмяьзбгйчшхїюцжєщфґ", "el": "αοιτεσνηυρπκμςλίόάέδγήύώωχθφβξζψΐϊϋ", "he": "יוהלאתרמבשנםדעקחכפטגצסזןףךץ",
    "ar": "اليمنوتربدعسفهكقحجشطةصخأزضذثغىئءإظؤآ", "th": "านรอกเงมยลวดทสต่้ีัิุูะปบคหแจพชขใไโ็์ึืถผธศณษซำ",
}
#: Single-byte encodings in the order of preference: codec, name, languages.
SINGLE = [
    ("cp1252", "windows-1252", ("fr", "de", "es", "pt", "it", "sv", "da", "nl", "is")), ("cp1250", "windows-1250", ("cs", "sk", "pl", "hu", "ro", "hr")), ("cp1254", "windows-1254", ("tr",)),
    ("cp1251", "windows-1251", ("ru", "uk")), ("koi8_u", "KOI8-U", ("ru", "uk")), ("cp866", "IBM866", ("ru",)), ("cp1253", "windows-1253", ("el",)), ("cp1255", "windows-1255", ("he",)),
    ("cp1256", "windows-1256", ("ar",)), ("cp874", "windows-874", ("th",)),
]
#: Frequent characters of languages with thousands of them.
KANA = "のにはをたがでてとしれさいるもなかすこらまうあだくりよんけどっえちめやせそみわきつ"
COMMON = {
    "ja": KANA + "".join(chr(ord(c) + 96) for c in KANA) + "ー、。人日一",
    "zh-Hans": "的一是不了在人有我他这中大来上个国到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可她里后小么心多天而能好都没起还发成事只作当想看什吗吧很怎，。",
    "zh-Hant": "的一是不了在人有我他這中大來上個國到說們為子和你地出道也時年得就那要下以生會自著去之過家學對可她裡後小麼心多天而能好都沒起還發成事只作當想看什嗎吧很怎，。",
    "ko": "이다는가을에의고하지은를로도한나어있기그사자대리시아서수인해라니정보들일게거요세습네너내안우말데만무면오마",
}
#: Multi-byte encodings: codec, name, language, first and last lead byte of its usual characters.
MULTI = [("shift_jis", "Shift_JIS", "ja", 0x81, 0x97), ("euc_jp", "EUC-JP", "ja", 0xA1, 0xCF), ("gb18030", "GBK", "zh-Hans", 0xA1, 0xD7), ("big5", "Big5", "zh-Hant", 0xA1, 0xC6), ("euc_kr", "EUC-KR", "ko", 0xA1, 0xC8)]
CODECS = {name: codec for codec, name, *_ in SINGLE + MULTI}
#: Log-likelihoods: of punctuation, of a letter that the language lacks, of a rare character; a multi-byte character takes two bytes.
MARK, ALIEN, USUAL, RARE = -4.0, -9.0, -8.5, -13.0
MIXED = re.compile(r"[A-Za-z](?=[^\W\d_A-Za-z])|(?<=[^\W\d_A-Za-z])[A-Za-z]")
RUN = re.compile(r"(?<=[^\x00-\x7f])[^\W\d_A-Za-z]")
CAPITAL = re.compile(r"(?<=[^\W\d_])[^\W\d_]")


class InvalidEncoding(ValueError):
    pass


def guess(data: bytes) -> str:
    """Name of the encoding: ``UTF-8-BOM``, ``UTF-16BE``, ``UTF-16LE``, ``UTF-8`` or a legacy one.

    Legacy text goes to the encoding under which its characters beyond ASCII are likeliest, by the letters of the languages written in
    it and by their neighbours: scripts do not mix within a word, Western accents stand alone, capitals begin words.
    """
    if data[:3] == b"\xef\xbb\xbf":
        return "UTF-8-BOM"
    if data[:2] == b"\xfe\xff":
        return "UTF-16BE"
    if data[:2] == b"\xff\xfe":
        return "UTF-16LE"
    try:
        data.decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError:
        pass
    best, name = -math.inf, "windows-1252"
    scored = [(_single(data, codec, languages), label) for codec, label, languages in SINGLE] + [(_multi(data, codec, language, first, last), label) for codec, label, language, first, last in MULTI]
    for k, (score, label) in enumerate(scored):
        score -= 0.2 * k  # the usual ones come first
        if score > best:
            best, name = score, label
    return name


@functools.cache
def _letters(language: str) -> dict[str, float]:
    """Log-probability of each letter: by its rank, and less for a capital of a listed small letter."""
    letters = LETTERS[language]
    weights = {c: 1 / (k + 1.5) for k, c in enumerate(letters)}
    total = sum(weights.values())
    out = {c.upper(): math.log(w / total) - 1.0 for c, w in weights.items() if len(c.upper()) == 1}
    return out | {c: math.log(w / total) for c, w in weights.items()}


def _single(data: bytes, codec: str, languages: tuple[str, ...]) -> float:
    try:
        text = data.decode(codec)
    except UnicodeDecodeError:
        return -math.inf
    counts = Counter(c for c in text if c > "\x7f")
    marks = sum(n for c, n in counts.items() if not c.isalpha() and not unicodedata.category(c).startswith("M"))
    odd = sum(n for c, n in counts.items() if unicodedata.category(c)[0] in "CSN" and c not in "°€№©®™")
    letters = {c: n for c, n in counts.items() if c.isalpha() or unicodedata.category(c).startswith("M")}
    latin = codec in ("cp1252", "cp1250", "cp1254")
    neighbours = -1.5 * len(RUN.findall(text)) if latin else -4.0 * len(MIXED.findall(text))
    capitals = -2.0 * sum(m[0].isupper() for m in CAPITAL.finditer(text) if m[0] > "\x7f" and text[m.start() - 1].islower())
    likely = max(sum(n * table.get(c, ALIEN) for c, n in letters.items()) for table in map(_letters, languages))
    return likely + MARK * marks - 4.0 * odd + neighbours + capitals


def _multi(data: bytes, codec: str, language: str, first: int, last: int) -> float:
    try:
        text = data.decode(codec)
    except UnicodeDecodeError:
        return -math.inf
    common = COMMON[language]
    score = 0.0
    for c, n in Counter(c for c in text if c > "\x7f").items():
        lead = c.encode(codec)
        usual = len(lead) == 2 and first <= lead[0] <= last and (lead[1] > 0x7F or codec in ("shift_jis", "big5"))
        score += n * (math.log(0.6 / len(common)) if c in common else USUAL if usual else RARE)
    return score - 3.0 * len(MIXED.findall(text))


def decode(data: bytes) -> str:
    """Text of bytes. Raises InvalidEncoding for broken UTF-16; a lone FE or FF is empty."""
    if data in (b"\xfe", b"\xff"):
        return ""
    name = guess(data)
    if name in ("UTF-8", "UTF-8-BOM"):
        return data.decode("utf-8").lstrip("﻿")
    if name in ("UTF-16BE", "UTF-16LE"):
        body = data[2:]
        try:
            return body[: len(body) // 2 * 2].decode(name)
        except UnicodeDecodeError as e:
            raise InvalidEncoding(f"invalid {name} data") from e
    return data.decode(CODECS[name], "replace")


def detect_encoding(content: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def slow(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else guess(bytes(b)))

    head = F.hex(F.substring(content, 1, 3))
    return (F.when(head == "EFBBBF", "UTF-8-BOM").when(head.startswith("FEFF"), "UTF-16BE").when(head.startswith("FFFE"), "UTF-16LE")
            .when(F.is_valid_utf8(content.cast("string")), "UTF-8").otherwise(slow(content)))


def decode_to_string(content: Column) -> Column:
    """Text, or null where the bytes are invalid."""

    @F.pandas_udf(T.StringType())
    def slow(values: pd.Series) -> pd.Series:
        def one(b):
            try:
                return None if b is None else decode(bytes(b))
            except InvalidEncoding:
                return None

        return values.map(one)

    plain = ~F.hex(F.substring(content, 1, 2)).isin("FEFF", "FFFE") & F.is_valid_utf8(content.cast("string"))
    return F.when(plain, F.regexp_replace(content.cast("string"), "^﻿+", "")).otherwise(slow(content))
