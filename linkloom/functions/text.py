"""Normalisation of names and addresses.

Column expressions wherever Catalyst has the functions; Arrow UDFs only for Unicode normalisation, transliteration
and word segmentation. Blank is "", and null counts as "".
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: As objects: workers import this module, and have no session to parse names of types.
STRING, STRINGS = StringType(), ArrayType(StringType())

# Word lists, spellings and constants that results depend on.
LEGAL = (
    "private limited pvt ltd llc inc co company corp corporation the and pllc llp services service group enterprises industries "
    "international india l p c pc sas sarl sasu eurl sa sci snc sarlu"
).split()
EXPANSIONS = {
    "pvt": "private", "ltd": "limited", "llc": "llc", "inc": "inc", "corp": "corporation", "co": "company", "bros": "brothers",
    "ent": "enterprises", "ind": "industries", "svc": "services", "trd": "trading", "assoc": "associates", "tech": "technology",
    "soln": "solutions", "mgmt": "management", "intl": "international", "dept": "department", "rd": "road", "st": "street",
    "ave": "avenue", "plz": "plaza", "blvd": "boulevard", "dr": "drive", "cir": "circle", "ct": "court", "ln": "lane",
    "apt": "apartment", "bldg": "building", "fl": "floor", "no": "no", "ngr": "nagar", "ctr": "center", "praivet": "private",
    "praibhet": "private", "piraivet": "private", "praivrr": "private", "limitet": "limited", "limirrd": "limited",
    "mited": "limited", "limtid": "limited",
}
CONTRACTIONS = {
    "corporation": "corp", "incorporated": "inc", "limited": "ltd", "private": "pvt", "company": "co", "brothers": "bros",
    "enterprises": "ent", "enterprise": "ent", "industries": "ind", "industry": "ind", "services": "svc", "service": "svc",
    "traders": "trd", "trading": "trd", "associates": "assoc", "technologies": "tech", "technology": "tech", "solutions": "soln",
    "management": "mgmt", "international": "intl", "department": "dept", "road": "rd", "street": "st", "avenue": "ave",
    "plaza": "plz", "boulevard": "blvd", "drive": "dr", "circle": "cir", "court": "ct", "lane": "ln", "apartment": "apt",
    "building": "bldg", "floor": "fl", "number": "no", "shop": "shp", "market": "mkt", "nagar": "ngr", "trail": "trl",
    "blue": "blu", "center": "ctr", "centre": "ctr", "saint": "st", "sainte": "st", "rue": "st", "praivet": "pvt",
    "praibhet": "pvt", "piraivet": "pvt", "praivrr": "pvt", "limitet": "ltd", "limirrd": "ltd", "mited": "ltd", "limtid": "ltd",
    "inphra": "infra", "inphotek": "infotech", "treding": "trading", "bijnes": "business", "hospitailiti": "hospitality",
    "intrneshnl": "international", "globl": "global", "drim": "dream", "aiti": "it", "elelpi": "llp", "mharastr": "maharashtra",
    "prdesh": "pradesh", "gujrat": "gujarat", "telngan": "telangana", "krnatk": "karnataka", "hriyana": "haryana",
    "rajsthan": "rajasthan", "mdhy": "madhya", "uttr": "uttar", "keralam": "kerala", "kerln": "kerala", "tmilnatu": "tamil nadu",
}
STATES = {
    "tx": "texas", "oh": "ohio", "ut": "utah", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "nv": "nevada", "nj": "new jersey",
    "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "sc": "south carolina", "sd": "south dakota",
    "tn": "tennessee", "vt": "vermont", "wi": "wisconsin", "wy": "wyoming", "nh": "new hampshire", "ri": "rhode island",
    "wv": "west virginia", "az": "arizona", "ak": "alaska", "ct": "connecticut", "fl": "florida", "ga": "georgia",
    "pa": "pennsylvania", "ne": "nebraska", "id": "idaho", "ok": "oklahoma", "mn": "minnesota", "ar": "arkansas", "mo": "missouri",
    "va": "virginia", "ca": "california",
}
ORDINALS = (
    "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth "
    "sixteenth seventeenth eighteenth nineteenth twentieth"
).split()
STOPWORDS = "the and of near at in for a an to by opp opposite behind null www com http https".split()
STREET_STOPWORDS = (
    "no h flat plot door house unit ste suite floor the shop office room block st nd rd th street road avenue drive lane court "
    "circle plaza boulevard rue avenue boulevard place allee allée impasse chemin quai bd av r n"
).split()
FRENCH_STREETS = {
    "r": "rue", "r.": "rue", "rue": "rue", "bd": "boulevard", "blvd": "boulevard", "av": "avenue", "av.": "avenue", "ave": "avenue",
    "pl": "place", "allee": "allee", "allée": "allee", "n": "no", "n°": "no", "no": "no",
}
DIGRAPHS = [("ph", "f"), ("bh", "b"), ("kh", "k"), ("gh", "g"), ("th", "t"), ("dh", "d"), ("sh", "s"), ("ch", "c"), ("jh", "j"), ("w", "v"), ("z", "j"), ("q", "k"), ("x", "ks"), ("y", "i")]
DOMAIN_B = r"(?:https?://)?(?:www\.)?([a-z0-9][a-z0-9.-]*?)\.(?:com|in|net|org|co|biz|info|fr)(?:\b|/|$)"
DOMAIN_A = r"^(?:https?://)?(?:www\.)?([a-z0-9-]+)\.[a-z]{2,}(?:\.[a-z]{2,})?$"
#: Aliases of states and cities where no table has been mined.
ALIASES = {
    "mh": "maharashtra", "dl": "delhi", "up": "uttar pradesh", "ka": "karnataka", "tn": "tamil nadu", "wb": "west bengal",
    "gj": "gujarat", "tg": "telangana", "hr": "haryana", "rj": "rajasthan", "kl": "kerala", "br": "bihar", "mp": "madhya pradesh",
    "ap": "andhra pradesh", "or": "odisha", "od": "odisha", "pb": "punjab", "orissa": "odisha", "keralam": "kerala", "poona": "pune",
    "greater bombay": "mumbai", "bombay": "mumbai", "madras": "chennai", "calcutta": "kolkata", "bangalore": "bengaluru",
    "new delhi": "delhi", "hyderabad city region": "hyderabad", "k.v.rangareddy": "rangareddy", "tx": "texas", "oh": "ohio",
    "ny": "new york", "nc": "north carolina", "il": "illinois", "va": "virginia", "ma": "massachusetts", "az": "arizona",
    "in": "indiana", "wa": "washington", "md": "maryland", "ca": "california", "al": "alabama", "wi": "wisconsin", "mn": "minnesota",
    "ky": "kentucky", "ar": "arkansas", "mo": "missouri", "ok": "oklahoma", "pa": "pennsylvania", "ga": "georgia", "fl": "florida",
    "mi": "michigan", "nj": "new jersey", "hauts-de-france": "hauts-de-france", "nouvelle-aquitaine": "nouvelle-aquitaine",
    "pays de la loire": "pays de la loire", "nord": "nord", "gironde": "gironde", "loire-atlantique": "loire-atlantique",
    "pas-de-calais": "pas-de-calais",
}
#: The nine Brahmic scripts share one layout from these code points on; sounds by offset.
SCRIPT_BASES = range(0x0900, 0x0D80, 0x80)
SCRIPT_NAMES = "devanagari bengali gurmukhi gujarati oriya tamil telugu kannada malayalam".split()
VOWELS = (0x05, "a a i i u u r l e e e ai o o au a".split())
CONSONANTS = (0x15, "k kh g gh n c ch j jh n t th d dh n t th d dh n n p ph b bh m y r r l l l v sh s s h".split())
SIGNS = (0x3E, "a i i u u r r e e e ai o au o l".split())
DIGITS = (0x66, list("0123456789"))
SILENT = {0x01: "", 0x02: "n", 0x03: "h", 0x3C: "", 0x4D: ""}
#: A house number.
NUMBER = "[0-9]+[a-z]?(?:[/-][0-9]+)?"
UNKNOWN_COST, UNKNOWN_PER_LETTER, LONGEST_PIECE = 12.0, 2.5, 20


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _lookup(token: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), token), token)


# -- tokens ---------------------------------------------------------------------------------------------------------


def tokens(c: Column | str) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(_text(c)), F.lit("[a-z0-9]+"), 0)


def content_tokens(c: Column | str) -> Column:
    """Tokens of two characters or more that aren't legal forms."""
    return F.filter(tokens(c), lambda t: (F.length(t) >= 2) & ~t.isin(LEGAL))


def content_tokens_a(c: Column | str) -> Column:
    """Space-separated tokens of a normalised text, two characters or more, without stopwords."""
    return F.filter(F.split(_text(c), " "), lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS))


def expand(c: Column | str) -> Column:
    """Abbreviations in full, tokens joined by spaces."""
    return F.array_join(F.transform(tokens(c), lambda t: _lookup(t, EXPANSIONS)), " ")


def contract(c: Column | str, address: bool = False) -> Column:
    """Words as their abbreviations; ordinals as numerals; in addresses, state codes in full."""
    table = {w: f"{n}{'st' if n == 1 else 'nd' if n == 2 else 'rd' if n == 3 else 'th'}" for n, w in enumerate(ORDINALS, 1)}
    table |= CONTRACTIONS | (STATES if address else {})
    return F.array_join(F.flatten(F.transform(F.split(_text(c), " "), lambda t: F.split(_lookup(t, table), " "))), " ")


# -- domains, scripts, numbers ---------------------------------------------------------------------------------------


def domain_stem(c: Column | str) -> Column:
    """The name in front of a known domain ending, anywhere in the text without spaces, without hyphens; "" if none."""
    return F.replace(F.regexp_extract(F.replace(F.lower(_text(c)), F.lit(" "), F.lit("")), DOMAIN_B, 1), F.lit("-"), F.lit(""))


def domain_stem_a(c: Column | str) -> Column:
    """The name of a text that is a host as a whole, hyphens as spaces; "" if it isn't."""
    return F.replace(F.regexp_extract(F.lower(F.trim(_text(c))), DOMAIN_A, 1), F.lit("-"), F.lit(" "))


def is_domain(c: Column | str) -> Column:
    return F.replace(F.lower(_text(c)), F.lit(" "), F.lit("")).rlike(DOMAIN_B)


def is_indic(c: Column | str) -> Column:
    return _text(c).rlike(r"[\x{0900}-\x{0D7F}]")


def has_non_latin(c: Column | str) -> Column:
    """Whether any letter is beyond U+024F."""
    return _text(c).rlike(r"[\p{L}&&[^\x{0000}-\x{024F}]]")


def script_of(c: Column | str) -> Column:
    """The Brahmic script of the first such character; null if there is none."""
    first = F.regexp_extract(_text(c), r"[\x{0900}-\x{0D7F}]", 0)
    code = F.expr("0")
    n = F.floor((F.ascii(first) - 0x0900) / 0x80)
    return F.when(first != "", F.element_at(F.array(*map(F.lit, SCRIPT_NAMES)), (n + 1 + code).cast("int")))


def tag_numbers(c: Column | str) -> Column:
    """[ZIP] around numbers of 5 or 6 digits, [NUM] around the text's first number (12, 12a, 12/4, 12-4) unless that is one of them."""
    zipped = F.regexp_replace(_text(c), r"(?<![0-9])([0-9]{5,6})(?![0-9])", "[ZIP] $1 [/ZIP]")
    before = F.regexp_extract(zipped, "^[^0-9]*", 0)
    return F.when(before.rlike(r"(?s)\[ZIP\].?$"), zipped).otherwise(F.regexp_replace(zipped, f"^([^0-9]*)({NUMBER.replace('a-z', 'A-Za-z')})", "$1[NUM] $2 [/NUM]"))


# -- addresses and names --------------------------------------------------------------------------------------------


def alias_lookup(c: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """The alias of the trimmed, lower-cased text, else of its romanised form; else that form, or the text where nothing is left of it."""
    table = ALIASES if aliases is None else aliases
    key = F.lower(F.trim(_text(c)))
    roman = romanize(key)
    if not table:
        return F.when(roman != "", roman).otherwise(key)
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, key), F.element_at(pairs, roman), F.when(roman != "", roman), key)


def parse_address(c: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """struct(house, street_core, city, state) of a cleaned text: state last of the comma-separated segments, city before it, by their aliases.

    house is the first number without zeros in front; street_core the first word after it that tells a street, else the first such
    word of the first segment that isn't a number. What there is none of is "".
    """
    low = F.lower(_text(c))
    parts = F.filter(F.transform(F.split(low, ","), lambda s: F.trim(s)), lambda s: s != "")
    n = F.size(parts)
    state, city = F.when(n >= 1, F.element_at(parts, -1)), F.when(n >= 2, F.get(parts, n - 2))
    house = F.regexp_extract(low, NUMBER, 0)
    after = F.substr(low, F.instr(low, house) + F.length(house))

    def core(text: Column, numbers: bool) -> Column:
        own = F.transform(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), 0), lambda t: _lookup(t, FRENCH_STREETS))
        fit = F.filter(own, lambda t: (F.length(t) >= 3) & ~t.isin(STREET_STOPWORDS) & (F.lit(numbers) | ~t.rlike("^[0-9]+$")))
        return F.get(fit, F.lit(0))

    first = F.coalesce(F.get(parts, F.lit(0)), low)
    street = F.coalesce(F.when(house != "", core(after, True)), core(first, False), F.lit(""))
    return F.struct(F.regexp_replace(house, "^0+(?=.)", "").alias("house"), street.alias("street_core"), alias_lookup(city, aliases).alias("city"), alias_lookup(state, aliases).alias("state"))


def is_nonce(c: Column | str) -> Column:
    """An invented name: one or two content tokens, each 4 to 16 letters; no domain, script or legal form."""
    own, every = content_tokens(c), tokens(c)
    legal = F.exists(every, lambda t: t.isin(LEGAL))
    return ~is_domain(c) & ~is_indic(c) & ~legal & F.size(own).between(1, 2) & F.forall(own, lambda t: t.rlike("^[a-z]{4,16}$"))


def skeleton(c: Column | str) -> Column:
    """Sounds of a word: digraphs simplified, vowels dropped after the first letter, repeats collapsed."""
    word = reduce(lambda w, r: F.replace(w, F.lit(r[0]), F.lit(r[1])), DIGRAPHS, F.lower(_text(c)))
    body = F.concat(F.left(word, F.lit(1)), F.regexp_replace(F.substr(word, F.lit(2)), "[aeiou]", ""))
    return F.regexp_replace(body, r"(.)\1+", "$1")


def skeleton_key(c: Column | str) -> Column:
    """The skeletons of the content tokens, in order."""
    return F.array_join(F.transform(content_tokens(c), skeleton), " ")


def serialize(**fields: Column | str) -> Column:
    """'[COL] name [VAL] value' for each field that isn't blank."""
    return F.concat_ws(" ", *[F.when(F.trim(_text(v)) != "", F.concat(F.lit(f"[COL] {k} [VAL] "), F.trim(_text(v)))) for k, v in fields.items()])


def retrieval_text(name: Column | str, address: Column | str) -> Column:
    return F.trim(F.concat_ws(", ", *[F.when(_text(c) != "", _text(c)) for c in (name, address)]))


def summarize_address(c: Column | str, idf: Column, keep: int = 36, unknown: float = 8.0) -> Column:
    """The keep tokens of highest idf (a map), in their order; of equals the later ones."""
    words = F.split(F.trim(_text(c)), r"\s+")
    ranked = F.transform(words, lambda w, i: F.struct(F.coalesce(F.element_at(idf, F.lower(w)), F.lit(unknown)).alias("v"), i.alias("i"), w.alias("w")))
    best = F.slice(F.sort_array(ranked, False), 1, keep)
    return F.array_join(F.transform(F.sort_array(F.transform(best, lambda x: F.struct(x.i.alias("i"), x.w.alias("w")))), lambda x: x.w), " ")


# -- Arrow UDFs -----------------------------------------------------------------------------------------------------


@lru_cache(1)
def brahmic_table() -> dict[int, str]:
    return {base + at + k: s for base in SCRIPT_BASES for at, sounds in (VOWELS, CONSONANTS, SIGNS, DIGITS) for k, s in enumerate(sounds)} | {base + k: s for base in SCRIPT_BASES for k, s in SILENT.items()}


def clean_text(s: str | None) -> str:
    """NFKC, without <null> and empty comma slots, repeated punctuation and spaces collapsed, case folded."""
    s = unicodedata.normalize("NFKC", s or "")
    s = re.sub(r"<\s*null\s*>", " ", s, flags=re.I)
    s = re.sub(r"([^\w\s])\1+", r"\1", s)
    s = re.sub(r",(?:\s*,)+", ",", s)
    return re.sub(r"\s+", " ", s).strip(" ,").casefold()


def romanize_text(s: str | None) -> str:
    """ASCII letters for Brahmic scripts and for letters with marks; others stay."""
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFC", s or "").translate(brahmic_table()))
    return re.sub(r"\s+", " ", "".join(c for c in s if not unicodedata.combining(c))).strip().lower()


def segment(stem: str | None, counts: dict[str, int], total: int, vocabulary: int | None = None) -> list[str]:
    """The cheapest split into words by their negative log frequencies. counts may hold only the stem's own pieces if the vocabulary's size is given."""
    size = len(counts) if vocabulary is None else vocabulary
    s = re.sub("[^a-z0-9]", "", (stem or "").lower())
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(s) + 1):
        options = []
        for start in range(max(0, end - LONGEST_PIECE), end):
            n = counts.get(s[start:end], 0)
            cost = -math.log((n + 0.1) / (total + max(size, 1))) if n else UNKNOWN_COST + UNKNOWN_PER_LETTER * (end - start)
            options.append((best[start][0] + cost, start))
        best.append(min(options))
    out, end = [], len(s)
    while end:
        out.append(s[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


@F.pandas_udf(STRING)
def clean(s: pd.Series) -> pd.Series:
    return s.map(clean_text)


@F.pandas_udf(STRING)
def romanize(s: pd.Series) -> pd.Series:
    return s.map(romanize_text)


@F.pandas_udf(STRING)
def transliterate(s: pd.Series) -> pd.Series:
    return s.map(lambda x: (x or "").translate(brahmic_table()))


@F.pandas_udf(STRING)
def strip_marks(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x or "") if not unicodedata.combining(c)))


@F.pandas_udf(STRINGS)
def pieces(s: pd.Series) -> pd.Series:
    """The distinct pieces that segment may take as words."""

    def of(stem):
        x = re.sub("[^a-z0-9]", "", (stem or "").lower())
        return sorted({x[a:b] for a in range(len(x)) for b in range(a + 1, min(len(x), a + LONGEST_PIECE) + 1)})

    return s.map(of)


@F.pandas_udf(STRINGS)
def segment_by(stem: pd.Series, words: pd.Series, n: pd.Series, total: pd.Series, vocabulary: pd.Series) -> pd.Series:
    """segment, by the stem's own pieces among all words, with their counts."""
    return pd.Series([segment(s, dict(zip(w, c)), t, v) for s, w, c, t, v in zip(stem, words, n, total, vocabulary)])


@F.pandas_udf(STRING)
def plain(s: pd.Series) -> pd.Series:
    """Composed, transliterated and then without marks: a vowel sign of two parts is one sign."""

    def of(x):
        x = unicodedata.normalize("NFC", x or "").translate(brahmic_table())
        return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))

    return s.map(of)


def normalize(c: Column | str, address: bool = False) -> Column:
    """Transliterated without marks, lower case, '&' as and, anything but letters and digits as space, contracted; numbers without zeros in front."""
    s = F.lower(plain(_text(c)))
    stem = domain_stem_a(s)
    s = F.concat_ws(" ", F.replace(s, F.lit("&"), F.lit(" and ")), F.when(stem != "", stem))
    s = F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    return F.regexp_replace(contract(s, address), r"\b0+([0-9]+)\b", "$1")


def ocr_perturb(c: Column | str, key: Column | str, share: float = 0.15, seed: int = 13) -> Column:
    """Letters and digits that scanners confuse, swapped with the given chance, seeded by the key."""
    pairs = {"0": "o", "o": "0", "1": "l", "l": "1", "5": "s", "s": "5", "8": "b", "b": "8"}
    draw = lambda i: F.pmod(F.xxhash64(F.lit(seed), key, i), F.lit(10_000)) < int(share * 10_000)
    return F.array_join(F.transform(F.split(_text(c), ""), lambda ch, i: F.when(ch.isin(list(pairs)) & draw(i), _lookup(ch, pairs)).otherwise(ch)), "")
