"""Which sections describe procedures: an additive score in plain column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomweave.functions import lexicon as lx
from fathomweave.functions import text as tx


def _held(c: Column, words: list[str]) -> Column:
    return sum((c.contains(w).cast("int") for w in words), F.lit(0))


def _any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def score(sections: DataFrame, title_words: list[str] = lx.TITLE_WORDS, text_words: list[str] = lx.TEXT_WORDS, marks: list[str] = lx.STEP_MARKS, strict: bool = False) -> DataFrame:
    """Adds score, threshold, entity_count, passed and is_procedure to ``sections`` (title, text, has_figure).

    Step marks are looked for in the lower-cased text, so two of them, which ask for a capital, never match;
    ``strict`` looks in the text as it is.
    """
    title, text, n = F.lower(tx.squeeze(F.col("title"))), F.lower(F.col("text")), F.length("text")
    figure = F.coalesce(F.col("has_figure"), F.lit(False))
    steps = sum(((F.col("text") if strict else text).rlike(("(?i)" if strict and "[A-Z]" not in m else "") + m).cast("int") for m in marks), F.lit(0))
    rows = sections.withColumn("entity_count", _held(text, text_words)).withColumn("title_count", _held(title, title_words)).withColumn("step_count", steps)
    total = F.when(figure, 50).otherwise(0) + F.least(F.col("title_count") * 7, F.lit(20)) + F.least(F.col("entity_count") * 2, F.lit(20)) + F.least(F.col("step_count") * 3, F.lit(15)) + F.when(n > 1000, 10).when(n > 500, 5).otherwise(0)
    rows = rows.withColumn("score", total).withColumn("threshold", F.when(~figure, 80).when(n > 5000, 60).when(n > 2000, 55).when(n > 1000, 50).otherwise(45))
    words = F.size(F.filter(F.split(title, " "), lambda x: x != ""))
    excluded = F.when(figure, _any(title, lx.FIGURE_EXCLUDED) & (F.col("score") < F.col("threshold") + 30)).otherwise(_any(title, lx.PLAIN_EXCLUDED))
    rows = rows.withColumn("passed", ~excluded & (n >= 300) & words.between(1, 25))
    forced = figure & (F.col("entity_count") >= 2) & (n > 500)
    return rows.withColumn("is_procedure", forced | ((F.col("score") >= F.col("threshold")) & F.col("passed")))


def of_document(sections: DataFrame, document: str) -> DataFrame:
    return sections.where(F.col("document") == document)


def routes(sections: DataFrame, named: Column, **lists: list[str]) -> DataFrame:
    """One row: how many sections with a figure an annotator named, and how many only the score did."""
    return identify(sections, named, **lists).agg(F.count_if(named.isNotNull()).alias("by_model"), F.count_if(named.isNull()).alias("by_score"))


def identify(sections: DataFrame, named: Column | None = None, **lists: list[str]) -> DataFrame:
    """The sections with a figure that are procedures, with procedure_name: what an annotator says, else the title if the score does; what is named is not scored."""
    rows = sections.where("has_figure")
    if named is None:
        return score(rows, **lists).withColumn("procedure_name", F.when(F.col("is_procedure"), F.col("title"))).where("procedure_name is not null")
    rows = rows.withColumns({"_named": named, "_text": F.col("text"), "text": F.when(named.isNull(), F.col("text"))})
    rows = score(rows, **lists).withColumns({"procedure_name": F.coalesce("_named", F.when(F.col("is_procedure"), F.col("title"))), "text": F.col("_text")})
    return rows.drop("_named", "_text").where("procedure_name is not null")


def answer_name(answer: Column, title: Column) -> Column:
    """The procedure name in a model's answer: null unless it says yes and not no; the title where its first other line is no name."""
    low = F.lower(answer)
    line = F.try_element_at(F.filter(F.transform(F.split(answer, "\n"), tx.strip), lambda x: (x != "") & ~F.lower(x).contains("yes") & ~F.lower(x).contains("no")), F.lit(1))
    return F.when(low.contains("yes") & ~low.contains("no"), F.when(F.length(line).between(4, 79), line).otherwise(title))
