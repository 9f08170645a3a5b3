"""Letters, tones, rules and word lists that results depend on."""

# --- fixed values: Vietnamese letters -----------------------------------------------------------------------------

#: Vowels by tone, each string in the order of the level ones.
LEVEL = "aăâeêioôơuưy"
FALLING = "àằầèềìòồờùừỳ"
RISING = "áắấéếíóốớúứý"
DIPPING = "ảẳẩẻểỉỏổởủửỷ"
BROKEN = "ãẵẫẽễĩõỗỡũữỹ"
HEAVY = "ạặậẹệịọộợụựỵ"
TONES = {"falling": FALLING, "rising": RISING, "dipping": DIPPING, "broken": BROKEN, "heavy": HEAVY}
#: Vowels without tone that still bear a mark, and đ, with their plain letters.
MARKED, PLAIN = "ăâêôơưđ", "aaeooud"
#: Alphabetical order of letters.
ALPHABET = "aàáảãạăằắẳẵặâầấẩẫậbcdđeèéẻẽẹêềếểễệfghiìíỉĩịjklmnoòóỏõọôồốổỗộơờớởỡợpqrstuùúủũụưừứửữựvwxyỳýỷỹỵz"

# --- fixed values: social-media shorthand and negation --------------------------------------------------------------

TEENCODE = {
    "ko": "không", "k": "không", "hok": "không", "hem": "không", "dc": "được", "đc": "được", "dk": "được",
    "ntn": "như thế nào", "nc": "nói chuyện", "nt": "nhắn tin", "cx": "cũng", "cg": "cũng", "vs": "với", "vl": "vãi",
    "bt": "bình thường", "bth": "bình thường", "lg": "lượng", "tl": "trả lời", "ms": "mới", "r": "rồi", "mn": "mọi người",
    "mk": "mình", "ok": "tốt", "oke": "tốt", "sp": "sản phẩm", "hqua": "hôm qua", "hnay": "hôm nay", "tks": "cảm ơn",
    "thanks": "cảm ơn", "thank": "cảm ơn", "j": "gì", "z": "vậy", "v": "vậy", "đt": "điện thoại", "dt": "điện thoại",
    "lm": "làm", "ns": "nói",
}
NEGATIONS = ("không", "chẳng", "chả", "chưa", "đừng", "ko", "hok", "hem", "chăng")

# --- fixed values: stop words -----------------------------------------------------------------------------------------

STOPWORDS = [
    "có", "của", "trong", "các", "được", "đến", "và", "nhiều", "này", "một", "chỉ", "đó", "sẽ", "số", "để", "đã", "ở", "những", "vào", "qua", "đi",
    "không", "là", "ra", "mà", "khi", "rằng", "từ", "năm", "rất", "hay", "tại", "sau", "bị", "đều", "vẫn", "lần", "như", "đồng", "mình", "còn", "xảy",
    "đợt", "theo", "hiện", "tuy nhiên", "10", "gì", "tới", "lại", "về", "2",
]

# --- fixed values: abbreviations that end no sentence (any list can be given instead) ---------------------------------

ABBREVIATIONS = [
    "g.m.t", "e.g", "dr", "vs", "000", "mr", "mrs", "prof", "inc", "tp", "ts", "ths", "th", "k.l", "a.w.a.k.e", "t", "a.i", "</i", "g.w", "ass",
    "u.n.c.l.e", "t.e.s.t", "d.c", "ve…", "f.t", "b.b", "z.e", "s.g", "m.p", "g.u.y", "l.c", "g.i", "j.f", "r.r", "v.i", "m.h", "a.s", "bs", "c.k",
    "aug", "t.d.q", "b…", "ph", "j.k", "e.l", "o.t", "s.a",
]

# --- fixed values: address abbreviations and ward prefixes -------------------------------------------------------------

ADDRESS_ABBREVIATIONS = {
    "tp.": "thành phố ", "tp ": "thành phố ", "t.p.": "thành phố ", "t.p ": "thành phố ", "p.": "phường ", "q.": "quận ",
    "h.": "huyện ", "tx.": "thị xã ", "t.x.": "thị xã ", "tt.": "thị trấn ", "t.t.": "thị trấn ", "x.": "xã ",
}
WARD_PREFIXES = ("phường", "xã", "thị trấn")

# --- fixed values: sounds, by letters without tone ----------------------------------------------------------------------

ONSETS = {
    "b": "ɓ", "c": "k", "ch": "c", "d": "j", "đ": "ɗ", "g": "ɣ", "gh": "ɣ", "gi": "z", "h": "h", "k": "k", "kh": "x", "l": "l",
    "m": "m", "n": "n", "ng": "ŋ", "ngh": "ŋ", "nh": "ɲ", "ph": "f", "p": "p", "qu": "kʷ", "r": "r", "s": "ʂ", "t": "t",
    "th": "tʰ", "tr": "ʈ", "v": "v", "x": "s", "q": "k",
}
NUCLEI = {
    "a": "aː", "â": "ə", "ă": "a", "e": "ɛ", "ê": "e", "i": "i", "o": "ɔ", "ô": "o", "ơ": "əː", "u": "u", "ư": "ɨ", "y": "i",
    "ia": "iə", "iê": "iə", "oo": "ɔː", "ôô": "oː", "ua": "uə", "uô": "uə", "ưa": "ɨə", "ươ": "ɨə", "yê": "iə", "ya": "iə",
    "uơ": "uə", "ay": "aj", "ây": "əj", "uă": "a", "uâ": "ə",
}
TONE_NUMBERS = {"level": "³³", "falling": "³²", "rising": "²⁴", "dipping": "³¹²", "broken": "³ˀ⁵", "heavy": "²¹ˀ"}
TONE_LETTERS = {"level": "˧˧", "falling": "˨˩", "dipping": "˨˩", "broken": "˧˥"}
CODAS = {"c": "k", "ch": "c", "k": "k", "m": "m", "n": "n", "ng": "ŋ", "nh": "ɲ", "p": "p", "t": "t", "u": "w", "o": "w", "i": "j", "y": "j"}

# --- fixed values: token patterns, by class, in order of priority -------------------------------------------------------

_UP = "A-ZÀÁẢÃẠĂẰẮẲẴẶÂẦẤẨẪẬĐÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌÔỒỐỔỖỘƠỜỚỞỠỢÙÚỦŨỤƯỪỨỬỮỰỲÝỶỸỴ"
_ANY = _UP + _UP.lower()
TOKEN_CLASSES = {
    "special": [r"=\>", r"==>", r"->", r"\.{2,}", r"-{2,}", r">>", r"\d+x\d+", r"v\.v\.\.\.", r"v\.v\.", r"v\.v", r"°[CF]"],
    "abbr": [
        r"[A-ZĐ]+&[A-ZĐ]+", r"T\.Ư", rf"[{_UP}]+(?:\.[{_ANY}]+)+\.?", f"[{_ANY}]+['’][{_ANY}]+", r"[A-ZĐ]+\.(?!$)", r"Tp\.", r"Mr\.",
        r"Mrs\.", r"Ms\.", r"Dr\.", r"ThS\.", r"Th.S", r"Th.s", r"e-mail", r"\d+[A-Z]+\d*-\d+", r"NĐ-CP",
    ],
    "url": [
        r"(?:(?:ftp|http)s?:(?:/{1,3}|[a-z0-9%])|[a-z0-9.\-]+[.](?:[a-z]{2,13})/)"
        r"(?:[^\s()<>{}\[\]]+|\([^\s()]*?\([^\s()]+\)[^\s()]*?\)|\([^\s]+?\))+"
        r"(?:\([^\s()]*?\([^\s()]+\)[^\s()]*?\)|\([^\s]+?\)|[^\s`!()\[\]{};:'\".,<>?«»“”‘’])",
        r"(?:(?<!@)[a-z0-9]+(?:[.\-][a-z0-9]+)*[.](?:[a-z]{2,13})\b/?(?!@))",
    ],
    "email": [r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"],
    "phone": [r"\d{2,}-\d{3,}-\d{3,}"],
    "datetime": [
        r"\d{1,2}\/\d{1,2}\/\d+", r"\d{1,2}\/\d{1,4}", r"\d{1,2}-\d{1,2}-\d+", r"\d{1,2}-\d{1,4}", r"\d{1,2}\.\d{1,2}\.\d+",
        r"\d{4}\/\d{1,2}\/\d{1,2}", r"\d{2}:\d{2}:\d{2}",
    ],
    "name": [r"\d+[A-Z]+\d+", r"\d+[A-Z]+"],
    "number": [r"\d+(?:\.\d+)+,\d+", r"\d+(?:\.\d+)+", r"\d+(?:,\d+)+", r"\d+(?:[\.,_]\d+)?"],
    "emoji": [r":\)\)*", r"=\)\)+", r"♥‿♥", r":D+(?=\s)", r":D+(?=$)", r"<3"],
    "punct": [r"\.", r"\,", r"\(", r"\)", r"ʺ"],
    "word_hyphen": [r"(?<=\b)\w+\-[\w+-]*\w+"],
    "word": [r"\w+"],
    "sym": [r"\+", r"×", r"-", r"÷", r":+", r"%", r"\$", r"\>", r"\<", r"=", r"\^", r"_"],
    "non_word": [r"[^\w\s]"],
}
