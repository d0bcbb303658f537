"""Answers out of raw responses, option letters, echoes and spend."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: labels, marks and tags that responses are read by
QUESTION_LABEL = r"^\s*(?:\*{0,3}|_{0,3})\s*(?:sual|question|q)\s*[:\-—]"
LAST_QUESTION = r"(?i)(?:sual|question)\s*[:\-—]\s*([^\r\n]*)"
ANSWER_PREFIX = r"(?iu)^\s*(?:(?:cavab|cavabı|answer|a)\s*[:\-—]|the answer is\b|cavab budur\b)\s*[:\-—]?\s*"
LETTER_PREFIX = r"(?iu)^\s*(?:cavab|answer)\s*[:.]\s*"
LETTER_END = "A-Za-zƏəĞğİıÖöŞşÇçÜü"
QUOTES = "\"“”«»'"
ANSWER_LETTERS = "0-9a-zəğışçöüA-ZƏĞIŞÇÖÜİ"
MAX_WORDS, LEAST_QUESTION = 12, 12
REASONING_TAGS = r"(?i)</?(?:thinking|think|scratchpad|antml:thinking)\b"
# end of fixed values
SPACE = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, "")


def lines(c: Column) -> Column:
    """Lines that aren't blank."""
    return F.filter(F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: strip(x) != "")


def folded_question(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(F.regexp_replace(c, r"\*{1,3}|_{1,3}|`+", "")), r"(?U)\s+", " "))


def asked_question(prompt: Column) -> Column:
    """What stands behind the prompt's last question label."""
    found = F.regexp_extract_all(prompt, F.lit(LAST_QUESTION), F.lit(1))
    return F.coalesce(strip(F.try_element_at(found, F.lit(-1))), F.lit(""))


def repeats_question(line: Column, asked: Column) -> Column:
    label = line.rlike("(?iu)" + QUESTION_LABEL)
    return (asked != "") & label & F.contains(folded_question(line), folded_question(asked))


def answers_another_question(raw: Column, prompt: Column) -> Column:
    """The first line that isn't blank has a question label, but another question than the one asked."""
    first = F.coalesce(F.try_element_at(lines(F.coalesce(raw, F.lit(""))), F.lit(1)), F.lit(""))
    asked = asked_question(prompt)
    return first.rlike("(?iu)" + QUESTION_LABEL) & (asked != "") & ~repeats_question(first, asked)


def extract_answer(raw: Column, prompt: Column | None = None, max_words: int = MAX_WORDS) -> Column:
    """The short answer in a response: its first line without thoughts, labels, marks and quotes."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?is)<think>.*?</think>", " ")
    text = strip(F.regexp_replace(text, r"(?is)<think>.*", ""))
    found = lines(text)
    if prompt is not None:
        asked = asked_question(prompt)
        # leading lines that repeat the question go, but never the last line
        leading = F.aggregate(found, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + (a["on"] & repeats_question(x, asked)).cast("int")).alias("n"), (a["on"] & repeats_question(x, asked)).alias("on")), lambda a: a["n"])
        first = F.try_element_at(found, F.least(leading, F.size(found) - 1) + 1)
        first = F.when(F.size(found) > 0, first)
    else:
        first = F.try_element_at(found, F.lit(1))
    line = strip(F.coalesce(first, F.lit("")))
    line = F.regexp_replace(line, r"\*{1,3}|_{1,3}|`+", "")
    line = strip(F.regexp_replace(line, ANSWER_PREFIX, ""))
    line = F.regexp_replace(line, f"^[{QUOTES}]+|[{QUOTES}]+$", "")
    words = F.size(F.filter(F.split(line, r"(?U)\s+"), lambda w: w != ""))
    line = F.when(words > max_words, F.element_at(F.split(line, r"(?<=[.!?])\s+"), 1)).otherwise(line)
    return strip(F.regexp_replace(line, r"[.!?,;:]+\s*$", ""))


def letter_of(raw: Column) -> Column:
    """The option letter A to D at the start of a response, else behind an answer mark, else empty."""
    raw = F.coalesce(raw, F.lit(""))
    text = F.regexp_replace(strip(raw), LETTER_PREFIX, "")
    start = F.regexp_extract(text, rf"^[\s:.\-*_`\"'(\[]*([ABCD])(?![{LETTER_END}])", 1)
    later = F.regexp_extract(raw, rf"(?iu)(?:cavab|answer)\s*[:.]\s*[*_`\"'(\[]*([ABCD])(?![{LETTER_END}])", 1)
    return F.when(start != "", start).otherwise(later)


def answer_present(raw: Column, gold: Column) -> Column:
    """The letters and digits of the gold answer occur in those of the response."""
    fold = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), f"[^{ANSWER_LETTERS}]", ""))
    return (fold(gold) != "") & F.contains(fold(raw), fold(gold))


def echoes_examples(raw: Column, prefix: Column) -> Column:
    """Two lines or more, the first of them taken from the prompt's examples."""
    found = lines(F.coalesce(raw, F.lit("")))
    return (F.size(found) >= 2) & F.contains(prefix, strip(F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))))


def echoes_question(raw: Column, question: Column) -> Column:
    body, needle = strip(F.coalesce(raw, F.lit(""))), strip(F.coalesce(question, F.lit("")))
    first = F.coalesce(F.try_element_at(lines(body), F.lit(1)), F.lit(""))
    return (body != "") & (F.length(needle) >= LEAST_QUESTION) & (F.startswith(body, needle) | F.contains(first, needle))


def leaks_reasoning(raw: Column) -> Column:
    return raw.rlike(REASONING_TAGS)


def excel_safe(c: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets a tab before it."""
    return F.when(c.rlike(r"^[=+@\-]"), F.concat(F.lit("\t"), c)).otherwise(c)
