"""Draft rows as people write them: raw lines checked by every rule, aliases filled in, manual rows made ready."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qiyas.functions import morphology, text
from qiyas.functions.answers import letter_of
from qiyas.functions.text import STRICT
from qiyas.operators import curation
from qiyas.operators.curation import blank, issue
from qiyas.operators.numbering import numbered
from qiyas.sources import shared

# fixed values: fields that may be left out, fields of manual rows, words that always have diacritics
OPTIONAL = ("answer_aliases", "difficulty", "notes")
MANUAL = ("question_az", "question_en", "answer", "answer_en", "category", "source")
WITHOUT_DIACRITICS = (
    "hansi", "hansisi", "nedir", "nece", "necedir", "seher", "seherdir",
    "olke", "olkenin", "ilde", "ildir", "yerlesir", "elifba", "elifbasi",
    "dilinde", "erazi", "erazisinde", "ehali", "ehalisi", "ve", "genc",
    "boyuk", "kicik", "dovlet", "dovletin", "muharibe", "resm", "sehife",
)
# end of fixed values


def lost_diacritics(question: Column) -> Column:
    """The words of a question that lack diacritics which they always have, if no letter of it has any."""
    found = F.array_intersect(text.tokens(question, STRICT), F.array(*map(F.lit, WITHOUT_DIACRITICS)))
    return F.when(question.rlike(f"[{curation.AZ_ONLY}]"), F.array().cast("array<string>")).otherwise(F.coalesce(found, F.array().cast("array<string>")))


def records(lines: DataFrame) -> DataFrame:
    """line, valid, object, keys and the fields of JSON lines(line, raw): a field that isn't text is null, aliases that aren't text are null elements."""
    v = lambda name: F.try_variant_get("_v", f"$.{name}", "variant")
    kind = lambda c: F.coalesce(F.schema_of_variant(c), F.lit(""))
    parsed = lines.select("line", "raw", F.try_parse_json("raw").alias("_v"))
    parsed = parsed.withColumn("_kind", kind(F.col("_v")))
    string = lambda name: F.when(kind(v(name)) == "STRING", F.try_variant_get("_v", f"$.{name}", "string")).alias(name)
    of_aliases = kind(v("answer_aliases"))
    aliases = F.when(of_aliases == "ARRAY<STRING>", F.try_variant_get("_v", "$.answer_aliases", "array<string>")).when(of_aliases == "ARRAY<VOID>", F.try_variant_get("_v", "$.answer_aliases", "array<string>")).when(of_aliases.startswith("ARRAY"), F.array(F.lit(None).cast("string")))
    is_object = F.col("_kind").startswith("OBJECT")
    return parsed.select(
        "line", F.col("_v").isNotNull().alias("valid"), is_object.alias("object"), F.when(is_object, F.json_object_keys("raw")).alias("keys"),
        *[string(f) for f in (*curation.REQUIRED, "difficulty", "notes")], aliases.alias("answer_aliases"),
        (~of_aliases.isin("", "VOID") & ~of_aliases.startswith("ARRAY")).alias("no_list"), (~kind(v("difficulty")).isin("", "VOID", "STRING")).alias("odd_difficulty"),
    )


def validate_lines(lines: DataFrame) -> DataFrame:
    """id, line, severity, field and message of every broken rule of JSON lines(line, raw); blank lines aren't rows.

    Lines that can't be read and those that aren't an object have one issue each; all others are judged by ``curation.validate_items``
    and by the rules that need the raw line.
    """
    rows = shared.written(records(lines.where(F.trim("raw") != "")), "records")  # read by each kind of rule
    unread = F.when(~F.col("valid"), "bad JSON").when(~F.col("object"), "not an object")
    broken = rows.where(~F.col("object")).select(F.lit(None).cast("string").alias("id"), "line", F.lit("error").alias("severity"), F.lit(None).cast("string").alias("field"), unread.alias("message"))
    good = rows.where("object")
    known = F.array(*map(F.lit, (*curation.REQUIRED, *OPTIONAL)))
    unknown = good.select("id", "line", F.lit("warning").alias("severity"), F.explode(F.array_except("keys", known)).alias("field"), F.lit("unknown field").alias("message"))
    example = (F.col("verified_by") == "human") & F.array_join(text.tokens(F.col("answer"), STRICT), " ").isin(*curation.PROMPT_EXAMPLES)
    more = F.array_compact(F.array(
        issue("error", "answer_aliases", "not a list", F.col("no_list")), issue("error", "difficulty", "unknown value", F.col("odd_difficulty")),
        issue("warning", "question_az", "lost diacritics", ~blank(F.col("question_az")) & (F.size(lost_diacritics(F.col("question_az"))) > 0)),
        issue("error", "answer", "answer of the prompt's examples", F.coalesce(example, F.lit(False))),
    ))
    extra = good.select("id", "line", F.explode(more).alias("i")).select("id", "line", "i.*")
    return curation.validate_items(good).select("id", "line", "severity", "field", "message").unionByName(extra).unionByName(unknown).unionByName(broken)


def all_aliases(answer: Column, answer_en: Column, existing: Column) -> Column:
    """The aliases that are there, then the forms of the answer, then the single words that say the same and their forms."""
    same = morphology.equivalence_aliases(answer, answer_en)
    return F.array_distinct(F.concat(F.coalesce(existing, F.array().cast("array<string>")), morphology.aliases_for(answer), same, F.flatten(F.transform(same, lambda a: morphology.aliases_for(a)))))


def fill_aliases(items: DataFrame, overwrite: bool = False) -> DataFrame:
    """Fills answer_aliases of rows that have an answer and no aliases, of all rows with an answer if ``overwrite``; adds filled."""
    empty = F.size(F.coalesce("answer_aliases", F.array().cast("array<string>"))) == 0
    wanted = ~blank(F.col("answer")) & (F.lit(overwrite) | empty)
    new = all_aliases(F.col("answer"), F.coalesce("answer_en", F.lit("")), F.col("answer_aliases"))
    filled = wanted & ~new.eqNullSafe(F.coalesce("answer_aliases", F.array().cast("array<string>")))
    out = items.withColumns({"_new": new, "filled": filled})
    return out.withColumn("answer_aliases", F.when(F.col("filled"), F.col("_new")).otherwise(F.col("answer_aliases"))).drop("_new")


def prepare_manual(rows: DataFrame, order: list[str], start: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows that people wrote, made ready: numbered in order, marked as manual and verified, with aliases; and (position, problem) of what is wrong with them.

    rows has the manual fields and answer_aliases; difficulty and notes are added where they are missing. Rows with problems stay, so that all are seen at once.
    """
    placed = numbered(rows, order, "position", 1)
    missing = F.filter(F.array(*[F.when(blank(F.col(f)), f) for f in MANUAL]), lambda f: f.isNotNull())
    odd = ~blank(F.col("category")) & ~F.col("category").isin(*curation.CATEGORIES)
    problems = placed.select("position", F.explode(F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("not filled in: "), F.array_join(missing, ", "))), F.when(odd, F.concat(F.lit("no category: "), F.col("category"))),
    ))).alias("problem"))
    added = {c: F.coalesce(c, F.lit(d)) if c in rows.columns else F.lit(d) for c, d in (("difficulty", "medium"), ("notes", ""))}
    aliases = F.when(blank(F.col("answer")), F.col("answer_aliases")).otherwise(all_aliases(F.col("answer"), F.coalesce("answer_en", F.lit("")), F.col("answer_aliases")))
    ready = placed.withColumns({"id": F.format_string("az-%03d", F.col("position") + (start - 1)), "provenance": F.lit("manual"), "verified_by": F.lit("human"), "answer_aliases": aliases, **added})
    return ready.drop("position"), problems


def written_kinds(choices: DataFrame, written: DataFrame) -> DataFrame:
    """model, items, cyrillic, echo and no_letter: written answers in Cyrillic, those that repeat the prompt's examples, and choices without a letter.

    choices(model, item_id, raw_response), written(model, item_id, raw_response).
    """
    raw = F.coalesce("raw_response", F.lit(""))
    wrote = written.groupBy("model").agg(F.count("*").alias("items"), F.count_if(text.has_cyrillic(raw)).alias("cyrillic"), F.count_if(raw.rlike("(?iu)H2O|Qahir|Каир|Мысыр")).alias("echo"))
    chose = choices.groupBy("model").agg(F.count("*").alias("choices"), F.count_if(letter_of(raw) == "").alias("no_letter"), F.count_if(text.has_cyrillic(raw)).alias("cyrillic_choices"))
    return wrote.join(chose, "model", "left").na.fill(0, ["choices", "no_letter", "cyrillic_choices"])
