"""Text expressions: four matching policies, from strict to transliterated."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: letters, suffixes and the Cyrillic table that the policies are defined by
FOLD_FROM, FOLD_TO = "əğıöşüçƏĞİÖŞÜÇ", "egiosucEGIOSUC"
VOWELS = "aeəıioöuü"
SUFFIXES = (
    "dan", "dən", "lar", "lər", "ıla", "ilə", "ula", "ülə", "da", "də", "la", "lə", "ın", "in",
    "un", "ün", "sı", "si", "su", "sü", "ya", "yə", "a", "ə", "ı", "i", "u", "ü",
)
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "j", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "x", "ц": "ts", "ч": "ç", "ш": "ş", "щ": "şç", "ъ": "", "ы": "ı", "ь": "", "э": "e", "ю": "yu", "я": "ya",
    "ә": "ə", "ғ": "ğ", "қ": "q", "ң": "ng", "ө": "ö", "ұ": "u", "ү": "ü", "һ": "h", "і": "i",
}
STRIPS, LEAST_STEM = 3, 3
# end of fixed values

ONE_TO_ONE = "".join(k for k, v in CYRILLIC.items() if len(v) == 1)
ONE_TO_ONE_TO = "".join(CYRILLIC[k] for k in ONE_TO_ONE)
DELETED = "".join(k for k, v in CYRILLIC.items() if not v)
ONE_TO_MANY = {k: v for k, v in CYRILLIC.items() if len(v) > 1}


@dataclass(frozen=True)
class Mode:
    name: str
    translit: bool = False
    fold: bool = False
    strip: bool = False


STRICT, MORPH = Mode("strict"), Mode("morph", strip=True)
LENIENT, TRANSLIT = Mode("lenient", fold=True, strip=True), Mode("translit", translit=True, fold=True, strip=True)
MODES = (STRICT, MORPH, LENIENT, TRANSLIT)


def suffix_pattern(folded: bool) -> str:
    """One strip: the longest suffix that leaves a stem of LEAST_STEM letters with a vowel among them.

    The stem is matched lazily, so the shortest stem, which has the longest suffix, is found first; its three
    forms have a vowel at the first, the second or a later letter.
    """
    table = str.maketrans(FOLD_FROM, FOLD_TO)
    v = "".join(dict.fromkeys(VOWELS.translate(table) if folded else VOWELS))
    s = "|".join(dict.fromkeys(x.translate(table) if folded else x for x in SUFFIXES))
    return f"^([{v}]..+?|.[{v}].+?|..+?[{v}].*?)({s})$"


def az_lower(c: Column) -> Column:
    return F.lower(F.translate(c, "Iİ", "ıi"))


def fold_diacritics(c: Column) -> Column:
    return F.translate(c, FOLD_FROM, FOLD_TO)


def transliterate(c: Column) -> Column:
    c = F.translate(c, ONE_TO_ONE + DELETED, ONE_TO_ONE_TO)
    for k, v in ONE_TO_MANY.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def nfkc(c: Column) -> Column:
    """Compatibility composition by the ICU classes on Spark's class path; ASCII texts skip it."""
    composed = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    return F.when(c.rlike("[^\\x00-\\x7F]"), composed).otherwise(c)


def reversed_suffixes(folded: bool) -> str:
    """All strips of a token that is written backwards: up to STRIPS times the longest suffix that leaves a stem, see ``suffix_pattern``.

    Read from its end a token meets its suffixes first, so nothing is tried that isn't one; what is found once isn't tried again.
    """
    table = str.maketrans(FOLD_FROM, FOLD_TO)
    v = "".join(dict.fromkeys(VOWELS.translate(table) if folded else VOWELS))
    s = "|".join(x[::-1] for x in sorted(dict.fromkeys(x.translate(table) if folded else x for x in SUFFIXES), key=len, reverse=True))
    return f"^(?>(?:{s})(?=.{{{LEAST_STEM}}})(?=.*[{v}])){{1,{STRIPS}}}+"


def strip_suffixes(token: Column, folded: bool = False) -> Column:
    return F.reverse(F.regexp_replace(F.reverse(token), reversed_suffixes(folded), ""))


def punctuation_to_space(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{P}\p{S}]", " ")


def tokens(c: Column, mode: Mode) -> Column:
    """Normalised tokens of a text; none of a null."""
    c = punctuation_to_space(az_lower(nfkc(F.coalesce(c, F.lit("")))))
    if mode.translit:
        c = transliterate(c)
    if mode.fold:
        c = fold_diacritics(c)
    found = F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")
    return F.transform(found, lambda t: strip_suffixes(t, mode.fold)) if mode.strip else found


def normalize(c: Column, mode: Mode) -> Column:
    return F.array_join(tokens(c, mode), " ")


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token arrays as multisets; 1 if both are empty, 0 if one is. The second should be the shorter one."""
    count = lambda x, t: F.size(F.filter(x, lambda y: y == t))

    def score(s: Column) -> Column:
        a, b = s["a"], s["b"]
        common = F.aggregate(F.transform(F.array_intersect(b, a), lambda t: F.least(count(a, t), count(b, t))), F.lit(0), lambda x, y: x + y)
        p, r = common / F.size(a), common / F.size(b)
        empty = (F.size(a) == 0) | (F.size(b) == 0)
        return F.when(empty, ((F.size(a) == 0) & (F.size(b) == 0)).cast("double")).when(common == 0, 0.0).otherwise(2 * p * r / (p + r))

    # bound as elements of an array, the token arrays are made once and not for every token
    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), score)[0]


def contains_tokens(text: Column, inner: Column) -> Column:
    """A token array occurs in another without a gap; an empty one doesn't."""
    spaced = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    return (F.size(inner) > 0) & F.contains(spaced(text), spaced(inner))


def has_cyrillic(c: Column) -> Column:
    return c.rlike("[\\u0400-\\u04FF]")


# fixed values: the alphabet that a text is expected in
ALPHABET = "abcçdeəfgğhxıijkqlmnoöprsştuüvyz"
# end of fixed values


def out_of_script(c: Column, alphabet: str = ALPHABET) -> Column:
    """Sorted distinct letters outside an alphabet, either case."""
    both = "".join(sorted(set(alphabet + alphabet.upper() + "İI")))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(f"[\\p{{L}}&&[^{both}]]"), F.lit(0))))
