"""Inflected forms of Azerbaijani answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qiyas.functions.text import VOWELS

# fixed values: vowel harmony and the suffixes of ordinals
BACK, HARMONY = "aıou", {"a": "ı", "ı": "ı", "e": "i", "ə": "i", "i": "i", "o": "u", "u": "u", "ö": "ü", "ü": "ü"}
SOFTENED = {"q": "ğ", "k": "y"}
DIGIT_ORDINALS = {"0": "cı", "1": "ci", "2": "ci", "3": "cü", "4": "cü", "5": "ci", "6": "cı", "7": "ci", "8": "ci", "9": "cu"}
TENS_ORDINALS = {"1": "cu", "2": "ci", "3": "cu", "4": "cı", "5": "ci", "6": "cı", "7": "ci", "8": "ci", "9": "cı"}
MAX_ALIASES = 24
# end of fixed values


def bound(c: Column, f) -> Column:
    """f of a value that is made once: as an element of an array it is a variable, where an expression would be copied to each place that names it."""
    return F.transform(F.array(c), f)[0]


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The entry of a table, null if there's none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def last_vowel(word: Column) -> Column:
    """The last vowel, null if there's none."""
    return F.nullif(F.regexp_extract(F.lower(word), f".*([{VOWELS}])", 1), F.lit(""))


def harmony2(word: Column) -> Column:
    return F.when(last_vowel(word).isin(*BACK), "a").otherwise("ə")


def harmony4(word: Column) -> Column:
    return F.coalesce(lookup(last_vowel(word), HARMONY), F.lit("i"))


def is_vowel_final(word: Column) -> Column:
    return F.lower(word).rlike(f"[{VOWELS}]$")


def syllables(word: Column) -> Column:
    low = F.lower(word)
    return F.length(low) - F.length(F.translate(low, VOWELS, ""))


def soften_final(word: Column) -> Column:
    """The last q or k softens in words of two syllables or more; case stays."""
    end = F.right(word, F.lit(1))
    soft = lookup(end, SOFTENED | {k.upper(): v.upper() for k, v in SOFTENED.items()})
    return F.when((syllables(word) >= 2) & soft.isNotNull(), F.concat(F.substring(word, F.lit(1), F.length(word) - 1), soft)).otherwise(word)


def cases(word: Column) -> dict[str, Column]:
    """Arrays of the forms in each case."""
    a, i, soft, final = harmony2(word), harmony4(word), soften_final(word), is_vowel_final(word)
    one = lambda *x: F.array(F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x]))
    both = lambda *x: F.array_distinct(F.concat(one(soft, *x), one(word, *x)))
    either = lambda x, y: F.when(final, x).otherwise(y)
    return {
        "copula": one(word, "d", i, "r"),
        "locative": either(F.concat(one(word, "d", a), one(word, "nd", a)), one(word, "d", a)),
        "ablative": either(F.concat(one(word, "d", a, "n"), one(word, "nd", a, "n")), one(word, "d", a, "n")),
        "dative": either(one(word, "y", a), both(a)),
        "genitive": either(one(word, "n", i, "n"), both(i, "n")),
        "accusative": either(one(word, "n", i), both(i)),
        "possessive3": either(one(word, "s", i), both(i)),
        "plural": one(word, "l", a, "r"),
    }


def all_forms(word: Column) -> Column:
    return bound(word, lambda w: F.array_distinct(F.concat(F.array(w), *cases(w).values())))


def _by_last_word(phrase: Column, form) -> Column:
    def said(words: Column) -> Column:
        head = F.slice(words, F.lit(1), F.size(words) - 1)
        inflected = bound(F.element_at(words, -1), lambda last: form(last, words))
        return F.when(F.size(words) == 0, F.lit("")).otherwise(F.array_join(F.concat(head, F.array(inflected)), " "))

    return bound(F.filter(F.split(phrase, r"(?U)\s+"), lambda w: w != ""), said)


def genitive(phrase: Column) -> Column:
    """The last word inflected; names, which begin with a capital, aren't softened."""

    def form(last: Column, _) -> Column:
        initial = F.substring(last, 1, 1)
        place = F.when((initial == F.upper(initial)) & (initial != F.lower(initial)), -1).otherwise(1)
        return F.element_at(cases(last)["genitive"], place)

    return _by_last_word(phrase, form)


def locative(phrase: Column) -> Column:
    """The last word inflected; in phrases of several words a final ı, i, u or ü takes an n before the ending."""

    def form(last: Column, words: Column) -> Column:
        buffered = lambda forms: (F.size(words) > 1) & F.lower(last).rlike("[ıiuü]$") & (F.size(forms) > 1)
        return bound(cases(last)["locative"], lambda forms: F.element_at(forms, F.when(buffered(forms), -1).otherwise(1)))

    return _by_last_word(phrase, form)


def az_capitalize(c: Column) -> Column:
    """The first letter in upper case, i to İ and ı to I."""
    before, letter, after = (F.regexp_extract(c, r"(?s)^(\P{L}*)(\p{L})(.*)$", k) for k in (1, 2, 3))
    upper = F.when(letter == "i", "İ").when(letter == "ı", "I").otherwise(F.upper(letter))
    return F.when(c.rlike(r"\p{L}"), F.concat(before, upper, after)).otherwise(c)


def ordinal_suffix(number: Column) -> Column:
    """The ending of a written ordinal, from its last digit that isn't 0."""
    tail = F.lpad(F.right(number, F.lit(3)), 3, "0")
    last, tens, hundreds = (F.substring(tail, k, 1) for k in (3, 2, 1))
    return F.when(last != "0", lookup(last, DIGIT_ORDINALS)).when(tens != "0", lookup(tens, TENS_ORDINALS)).when(hundreds != "0", "cü").otherwise("ci")


def year_aliases(number: Column) -> Column:
    stem = F.concat(number, F.lit("-"), ordinal_suffix(number), F.lit(" il"))
    return F.array(number, stem, F.concat(stem, F.lit("də")), F.concat(stem, F.lit("in")))


def aliases_for(answer: Column, most: int = MAX_ALIASES) -> Column:
    """Accepted forms of an answer but itself: years spelt out, else the last word in all its cases."""
    def forms_of(answer: Column) -> Column:
        words = F.filter(F.split(answer, r"(?U)\s+"), lambda w: w != "")
        head = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ")
        tail = F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))
        phrases = bound(F.when(head != "", F.concat(head, F.lit(" "))).otherwise(F.lit("")), lambda prefix: F.transform(all_forms(tail), lambda f: F.concat(prefix, f)))
        forms = F.when(answer.rlike("^[0-9]+$"), year_aliases(answer)).otherwise(phrases)
        return F.when(answer == "", F.array().cast("array<string>")).otherwise(F.slice(F.filter(F.array_distinct(forms), lambda f: f != answer), 1, most))

    return bound(F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?U)^\s+|\s+$", ""), forms_of)


def equivalence_aliases(answer_az: Column, answer_en: Column) -> Column:
    """Single words of an answer that takes more words than its English form."""
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    az, en = words(answer_az), words(answer_en)
    return F.when((F.size(az) >= 2) & (F.size(az) > F.size(en)), az).otherwise(F.array().cast("array<string>"))
