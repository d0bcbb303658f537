"""Question items from a graph of facts: a pattern is joined from triples, filtered, and worded in turn."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qiyas.functions import morphology, text
from qiyas.operators import curation
from qiyas.operators.numbering import numbered

#: Properties of the triple table that aren't facts: a subject's class, its names (with a language) and how many pages link to it.
KIND, LABEL, LINKS = "kind", "label", "links"
#: Fewest links of a subject that is asked for.
LEAST_LINKS = 8


@dataclass(frozen=True)
class Template:
    """A kind of fact, and its wordings in both languages.

    Wordings hold {subject}, in az also {subject_gen} and {subject_loc}, its genitive and locative.
    """

    name: str
    category: str
    kind: str | None  # class that a subject must be of
    prop: str  # the property asked for
    wordings: tuple[tuple[str, str], ...]
    literal: bool = False  # the answer is a value, not a node with names
    one_value: bool = True  # subjects with several values aren't asked for
    least_links: int = LEAST_LINKS
    difficulty: str = "medium"


def name(languages: Sequence[str]) -> Column:
    """Of a node's triples, the label in the first of the languages that it has one in; of several labels the least. A struct, null without a label."""
    place = F.array_position(F.array(*map(F.lit, languages)), F.col("lang"))
    return F.min(F.when((F.col("property") == LABEL) & F.col("lang").isin(*languages), F.struct(place.alias("place"), F.col("object").alias("name"))))


def bindings(triples: DataFrame, template: Template, az: Sequence[str] = ("az",), en: Sequence[str] = ("en",), pool: DataFrame | None = None) -> DataFrame:
    """subject, subject_az, subject_en, answer_az, answer_en and links of every match of a template's pattern.

    triples(subject, property, object, lang). The guard of single values looks at the whole table, so a subject whose other values would be filtered out later
    isn't taken for one with a single value. ``az`` and ``en`` are the languages whose labels serve, the first that a node has; ``pool`` limits the
    subjects to those of a table.

    What a node is, its links and its names are gathered in one pass. All sides grow with the graph and look small when compressed, so no join may broadcast:
    tables of names and facts built in the driver take its memory.
    """
    facts = triples.where(F.col("property") == template.prop).select("subject", F.col("object").alias("answer")).distinct()
    if template.one_value:
        facts = facts.groupBy("subject").agg(F.min("answer").alias("answer"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    if pool is not None:
        facts = facts.join(pool.select("subject").hint("merge"), "subject", "left_semi")
    names = {"az": name(az).alias("az"), "en": name(en).alias("en")}
    links = F.max(F.when(F.col("property") == LINKS, F.col("object").cast("long"))).alias("links")
    is_kind = F.lit(True) if template.kind is None else F.max((F.col("property") == KIND) & (F.col("object") == template.kind))
    nodes = triples.where(F.col("property").isin(KIND, LINKS, LABEL)).groupBy("subject").agg(*names.values(), links, is_kind.alias("_kind"))
    nodes = nodes.where(F.col("_kind") & (F.col("links") >= template.least_links) & F.col("az").isNotNull() & F.col("en").isNotNull())
    found = facts.join(nodes.select("subject", *[F.col(f"{g}.name").alias(f"subject_{g}") for g in names], "links").hint("merge"), "subject")
    if template.literal:
        found = found.withColumns({f"answer_{g}": F.col("answer") for g in names})
    else:
        of = triples.where(F.col("property") == LABEL).groupBy(F.col("subject").alias("answer")).agg(*names.values()).where("az is not null and en is not null")
        found = found.join(of.select("answer", *[F.col(f"{g}.name").alias(f"answer_{g}") for g in names]).hint("merge"), "answer")
    return found.select("subject", *[F.trim(c).alias(c) for c in ("subject_az", "subject_en", "answer_az", "answer_en")], "links")


def reviewed(raw: DataFrame, source: str = "source", host: str = "wikidata.org") -> DataFrame:
    """subject: the last part of the address of every row that was looked at before, taken or not."""
    address = F.regexp_replace(source, r"/+$", "")
    return raw.where(F.col(source).contains(host)).select(F.element_at(F.split(address, "/"), -1).alias("subject")).distinct()


def candidates(found: DataFrame, done: DataFrame | None = None, quota: int = 3, node: Column | None = None) -> DataFrame:
    """Bindings with the reason for which each is rejected, null if it is kept; subjects reviewed before are left out of the kept ones."""
    rows = found.withColumnsRenamed({"subject_az": "subject_label", "answer_az": "answer"})
    judged = curation.filter_reasons(rows, list(curation.BLOCKED), quota).withColumnsRenamed({"subject_label": "subject_az", "answer": "answer_az"})
    if done is None:
        return judged
    last = F.element_at(F.split(F.col("subject"), "/"), -1) if node is None else node
    seen = done.select(F.col("subject").alias("_node")).distinct().withColumn("_seen", F.lit(True))
    out = judged.withColumn("_node", last).join(seen, "_node", "left")
    return out.withColumn("reason", F.when(F.col("reason").isNull() & F.col("_seen"), "reviewed").otherwise(F.col("reason"))).drop("_node", "_seen")


def filter_stats(judged: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """How many bindings each rule has rejected, and how many are kept. Repeated rows of a subject belong to no rule."""
    reason = F.coalesce("reason", F.lit("kept"))
    return judged.groupBy(*group, reason.alias("reason")).agg(F.count("*").alias("n")).where(F.col("reason") != "duplicate_subject")


def worded(wordings: tuple[tuple[str, str], ...], turn: Column, subject_az: Column, subject_en: Column) -> tuple[Column, Column]:
    """The question in both languages by the wording whose turn it is."""
    az = F.element_at(F.array(*[F.lit(a) for a, _ in wordings]), turn + 1)
    en = F.element_at(F.array(*[F.lit(e) for _, e in wordings]), turn + 1)
    forms = {"{subject}": subject_az, "{subject_gen}": morphology.genitive(subject_az), "{subject_loc}": morphology.locative(subject_az)}
    part = F.transform(F.split(az, r"(?<=\})|(?=\{)"), lambda p: F.coalesce(*[F.when(p == k, v) for k, v in forms.items()], p))
    plain = F.array_join(F.transform(F.split(en, r"(?<=\})|(?=\{)"), lambda p: F.when(p == "{subject}", subject_en).otherwise(p)), "")
    return morphology.az_capitalize(F.array_join(part, "")), F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 1 << 30))


def items(judged: DataFrame, template: Template, start: int = 1, most: int | None = None) -> DataFrame:
    """Kept candidates as draft rows, numbered by links (most first) and subject; wordings take turns in this order.

    ``most`` is how many items the template may give: those of the lowest numbers.
    """
    kept = judged.where("reason is null").withColumn("_order", -F.col("links"))
    order = numbered(kept, ["_order", "subject"], "_at")
    if most is not None:
        order = order.where(F.col("_at") < most)
    turn = (F.col("_at") % len(template.wordings)).cast("int")
    question_az, question_en = worded(template.wordings, turn, F.col("subject_az"), F.col("subject_en"))
    return order.select(
        F.format_string("az-%03d", F.col("_at") + start).alias("id"), question_az.alias("question_az"), question_en.alias("question_en"),
        F.col("answer_az").alias("answer"), "answer_en", morphology.aliases_for(F.col("answer_az")).alias("answer_aliases"), F.lit(template.category).alias("category"),
        F.regexp_replace("subject", "^http://www\\.wikidata\\.org/entity/", "https://www.wikidata.org/wiki/").alias("source"),
        F.lit(template.difficulty).alias("difficulty"), F.lit("wikidata-template").alias("provenance"), F.lit("pending").alias("verified_by"),
        F.concat(F.lit(f"template={template.name};variant="), turn).alias("notes"),
    )


def answer_skew(drafts: DataFrame, most_share: float = 0.15) -> DataFrame:
    """One row: items, distinct normalised answers, the most frequent of them, its share, and whether that is too large."""
    counts = drafts.groupBy(text.normalize(F.col("answer"), text.STRICT).alias("answer")).agg(F.count("*").alias("n"))
    out = counts.agg(F.sum("n").alias("items"), F.count("*").alias("answers"), F.max(F.struct("n", "answer")).alias("_top"))
    share = F.col("_top.n") / F.col("items")
    return out.select("items", "answers", F.col("_top.answer").alias("top_answer"), share.alias("share"), (share > most_share).alias("skewed"))
