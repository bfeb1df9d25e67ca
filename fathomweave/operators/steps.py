"""Numbered steps in a section's text: finding, joining, sorting and naming them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomweave.functions import text as tx

#: The patterns decide what counts as a step.
HEAD = r"(?i)^(\d+(?:[a-z]?(?:-\d+[a-z]?)?|\([A-Za-z]\)))\.\s+(.+)"
_START = r"\.\t+([A-Z\[\(a-z])"
SPLITS = [r"(?<!^)(\d+)", r"(?<!^)(\d+[a-z])", r"(?<!^)(\d+\([A-Za-z]\))", r"(?<!^)(\d+-\d+[a-z])", r"(?<!^)(\d+-\d+)", r"(?<!^)(\d+[a-z]-\d+[a-z])"]


ACTING = [
    r"^(The\s+)?(UE|AMF|SMF|UPF|AUSF|PCF|UDM|NRF)\s+(sends?|receives?|performs?|initiates?)",
    r"^(Upon|After|When|If)\s+.+(the\s+)?(UE|AMF|SMF)",
    r"^First,?\s+(the\s+)?(UE|AMF|SMF)",
    r"^Initially,?\s+(the\s+)?(UE|AMF|SMF)",
]
# End of the fixed values.


def split_lines(text: Column, strict: bool = False) -> Column:
    """A newline before each step number that is followed by a tab.

    As a rule the plain numbers are split first, which breaks ranges such as 7-12 apart; ``strict`` takes the
    ranges first and leaves them whole.
    """
    out = text
    for p in SPLITS if not strict else [r"(?<![\d\n-])(\d+(?:[a-z]?-\d+[a-z]?|\([A-Za-z]\)|[a-z])?)"]:
        out = F.regexp_replace(out, p + _START, "\n$1. $2")
    # without a point before a tab there is nothing to split
    out = F.when(text.contains(".\t"), out).otherwise(text)
    return tx.strip(_single_blanks(F.regexp_replace(out, r"\n\s*\n\s*\n+", "\n\n")))


def _single_blanks(c: Column) -> Column:
    """Runs of blanks and tabs as one blank."""
    return F.regexp_replace(c, r"\t[ \t]*| [ \t]+", " ")


def start_line(text: Column) -> Column:
    """The first line (from 0) with which steps can begin: a numbered one, else one that tells who acts first; -1 if none."""
    lines = F.transform(F.split(text, "\n"), tx.strip)
    acting = lambda x: (F.length(x) >= 20) & ~x.rlike(r"^\d+(\.\d+)*\s+[A-Z]") & x.rlike(f"(?i){'|'.join(ACTING)}")
    place = lambda test: F.coalesce(F.array_position(F.transform(lines, lambda x: F.coalesce(test(x), F.lit(False))), True), F.lit(0))
    numbered = place(lambda x: x.rlike(HEAD))
    return (F.when(numbered > 0, numbered).otherwise(place(acting)) - 1).cast("int")


def parse(procedures: DataFrame, text: str = "text", key: str = "procedure", strict: bool = False) -> DataFrame:
    """(key, line, number, description, ord): the steps of each row's text, sorted by number; lines that follow a step belong to it.

    Steps that follow one another on a line are put on lines of their own first. A null text has none.
    """
    lines = procedures.select(key, F.posexplode(F.split(split_lines(F.col(text), strict), "\n")).alias("line", "raw")).withColumn("raw", tx.strip(F.col("raw"))).where("raw <> ''")
    lines = lines.withColumn("number", F.when(F.col("raw").rlike(HEAD), F.regexp_extract("raw", HEAD, 1))).withColumn("part", F.when(F.col("number").isNotNull(), F.regexp_extract("raw", HEAD, 2)).otherwise(F.col("raw")))
    run = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("step", F.sum(F.col("number").isNotNull().cast("int")).over(run)).where("step > 0")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line", "part"))), lambda x: x["part"])
    steps = lines.groupBy(key, "step").agg(F.max("number").alias("number"), F.min("line").alias("line"), tx.strip(F.regexp_replace(F.array_join(parts, " "), r"[ \t]+", " ")).alias("description"))
    main, letter = sort_key(F.col("number"))
    return steps.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy(main, letter, "line"))).drop("step")


def sort_key(number: Column) -> tuple[Column, Column]:
    """Number and letter; ranges and parentheses come last."""
    plain = number.rlike(r"^(\d+)([a-z]?)$")
    letter = F.regexp_extract(number, r"^\d+([a-z]?)$", 1)
    return F.when(plain, F.regexp_extract(number, r"^(\d+)", 1).try_cast("int")).otherwise(999), F.when(plain, F.when(letter == "", 0).otherwise(F.ascii(letter))).otherwise(999)


def entity_number(number: Column) -> Column:
    """The number as it stands in a step's name: 7-12b is 7_12b and 7(A) is 7A."""
    return F.when(number.rlike(r"^\d+[a-z]?$"), number).when(number.rlike(r"^\d+[a-z]?-\d+[a-z]?$"), F.regexp_replace(number, "-", "_")).when(number.rlike(r"^\d+\([A-Za-z]\)$"), F.regexp_replace(number, r"[()]", "")).otherwise(F.regexp_replace(number, "[^a-zA-Z0-9]", "_"))


def step_name(title: Column, number: Column) -> Column:
    """{clause digits}_{title}_step_{number}; a title's leading number is a clause only if white space and more follow. Each blank is an underscore."""
    return F.concat_ws("_", _name_head(title), entity_number(number))


def _name_head(title: Column) -> Column:
    numbered = r"^(\d+(?:\.\d+)*)\s+(.+)"
    clause = F.regexp_replace(F.regexp_extract(title, numbered, 1), r"\.", "")
    rest = F.when(clause != "", F.regexp_extract(title, numbered, 2)).otherwise(title)
    words = F.regexp_replace(F.regexp_replace(rest, r"(?U)[^\w\s]", ""), " ", "_")
    return F.concat_ws("_", F.when(clause != "", clause), words, F.lit("step"))


def step_entities(found: DataFrame, procedures: DataFrame, key: str = "procedure", title: str = "title") -> DataFrame:
    """(key, name, description, ord) from :func:`parse` and the titles; of steps with one name all have the last one's description."""
    named = found.join(procedures.select(key, title), key).withColumn("name", step_name(F.col(title), F.col("number")))
    last = Window.partitionBy(key, "name").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return named.select(key, "name", F.last("description").over(last).alias("description"), "ord")


def listed_steps(procedures: DataFrame, found: str = "found", key: str = "procedure", title: str = "title") -> DataFrame:
    """(key, name, description, ord) from texts like "Step 7a: ..." in the array ``found``.

    Where none of a procedure's texts is like that, they are numbered from 1 as they stand.
    """
    shape = r"(?i)^Step\s+([0-9a-z-]+):\s*(.+)"
    each = procedures.select(key, title, F.posexplode(found).alias("at", "said"), F.exists(F.col(found), lambda x: x.rlike(shape)).alias("any"))
    each = each.where(~F.col("any") | F.col("said").rlike(shape))
    number = F.when(F.col("any"), F.regexp_extract("said", shape, 1)).otherwise((F.col("at") + 1).cast("string"))
    plain = F.when(F.col("any"), F.regexp_extract("said", shape, 2)).otherwise(F.regexp_replace("said", r"(?i)^Step\s+[0-9a-z-]+:\s*", ""))
    return each.select(key, step_name(F.col(title), number).alias("name"), plain.alias("description"), F.row_number().over(Window.partitionBy(key).orderBy("at")).alias("ord"))


def in_rows(procedures: DataFrame, title: str = "procedure", text: str = "text", answer: str | None = None, out: str = "steps") -> DataFrame:
    """Adds the array ``out`` of struct (ord, name, description), in order: what :func:`completed` finds in a row's text, or else in its ``answer``.

    All of it is worked out within the row, so no text is moved; each array is a column of its own, since what a lambda holds is evaluated for every element.
    """
    at_ = [f"_{out}_{k}" for k in ("lines", "heads", "found", "sorted", "ends", "head", "said", "all")]
    lines, heads, found, sorted_, ends, head, said, whole = at_
    rows = procedures.withColumn(head, _name_head(F.col(title)))
    rows = rows.withColumn(lines, F.filter(F.transform(F.split(split_lines(F.coalesce(text, F.lit(""))), "\n"), tx.strip), lambda x: x != ""))
    one = lambda x, i: F.struct(i.alias("at"), F.regexp_extract(x, HEAD, 1).alias("number"), F.regexp_extract(x, HEAD, 2).alias("part"))
    rows = rows.withColumn(heads, F.filter(F.transform(lines, one), lambda h: h["number"] != ""))

    def step(h: Column, j: Column) -> Column:
        after = F.coalesce(F.get(F.col(heads), j + 1)["at"], F.size(lines))
        parts = F.concat(F.array(h["part"]), F.slice(F.col(lines), h["at"] + 2, after - h["at"] - 1))
        main, letter = sort_key(h["number"])
        described = tx.strip(_single_blanks(F.array_join(parts, " ")))
        return F.struct(main.alias("main"), letter.alias("letter"), h["at"].alias("at"), h["number"].alias("number"), described.alias("description"))

    rows = rows.withColumn(found, F.array_sort(F.transform(heads, step)))
    named = lambda x, i: F.struct(F.concat_ws("_", head, entity_number(x["number"])).alias("name"), (i + 1).alias("ord"), x["description"].alias("description"))
    # steps of one name stand together, and all have the description of the last
    rows = rows.withColumn(sorted_, F.array_sort(F.transform(found, named)))
    last = lambda x, i: F.coalesce(F.get(F.col(sorted_), i + 1)["name"] != x["name"], F.lit(True))
    rows = rows.withColumn(ends, F.filter(F.transform(sorted_, lambda x, i: F.when(last(x, i), F.struct(i.alias("at"), x["description"].alias("description")))), lambda e: e.isNotNull()))

    def alike(e: Column, j: Column) -> Column:
        first = F.when(j > 0, F.get(F.col(ends), j - 1)["at"] + 1).otherwise(0)
        return F.transform(F.slice(F.col(sorted_), first + 1, e["at"] - first + 1), lambda x: F.struct(x["ord"].alias("ord"), x["name"].alias("name"), e["description"].alias("description")))

    made = F.array_sort(F.flatten(F.transform(ends, alike)))
    if answer is None:
        return rows.withColumn(out, made).drop(*at_)
    shape = r"(?i)^Step\s+([0-9a-z-]+):\s*(.+)"
    rows = rows.withColumn(whole, F.when(F.size(ends) == 0, suggested(F.col(answer)))).withColumn(said, F.filter(whole, lambda x: x.rlike(shape)))
    listed = lambda x, i: F.struct((i + 1).alias("ord"), F.concat_ws("_", head, entity_number(F.regexp_extract(x, shape, 1))).alias("name"), F.regexp_extract(x, shape, 2).alias("description"))
    plain = lambda x, i: F.struct((i + 1).alias("ord"), F.concat_ws("_", head, entity_number((i + 1).cast("string"))).alias("name"), F.regexp_replace(x, r"(?i)^Step\s+[0-9a-z-]+:\s*", "").alias("description"))
    told = F.when(F.size(said) > 0, F.transform(said, listed)).otherwise(F.transform(whole, plain))
    return rows.withColumn(out, F.when(F.size(ends) > 0, made).otherwise(F.coalesce(told, made))).drop(*at_)


def suggested(answer: Column) -> Column:
    """The steps in a model's answer: its numbered lines, or the parts before numbers if those are more."""
    number = r"^\d+\.\s+"
    lines = F.transform(F.filter(F.transform(F.split(answer, "\n"), tx.strip), lambda x: x.rlike(number)), lambda x: F.regexp_replace(x, number, ""))
    parts = F.filter(F.transform(F.split(answer, r"(?=\d+\.\s+)"), lambda x: tx.strip(F.regexp_replace(tx.strip(x), number, ""))), lambda x: x != "")
    return F.when((F.size(lines) <= 1) & (F.size(parts) > F.size(lines)), parts).otherwise(lines)


def answer_lists(answer: Column) -> Column:
    """struct of network_functions, messages, parameters, keys (comma lists) and steps (parted by bars, over five letters) in a model's answer."""
    lines = F.transform(F.split(answer, "\n"), tx.strip)

    def named(kind: str, mark: str, least: int) -> Column:
        own = F.filter(lines, lambda x: F.upper(x).startswith(f"{kind.upper()}:"))
        # the part after the colon of each line that begins with the name
        return F.filter(F.flatten(F.transform(own, lambda x: F.transform(F.split(F.substring(x, F.lit(len(kind) + 2), F.length(x)), mark), tx.strip))), lambda x: F.length(x) >= least).alias(kind)

    return F.struct(*[named(k, ",", 1) for k in ("network_functions", "messages", "parameters", "keys")], named("steps", r"\|", 6))


def completed(procedures: DataFrame, key: str = "procedure", title: str = "title", text: str = "text", found: str | None = None, answer: str | None = None) -> DataFrame:
    """(key, name, description, ord, origin): the steps of every procedure from the best origin that has any.

    In turn: those numbered in the text ("text"), those in the array ``found`` ("listed"), those in the column
    ``answer`` of a model ("suggested"). A procedure with none has no rows.
    """
    done = step_entities(parse(procedures, text, key), procedures, key, title).withColumn("origin", F.lit("text"))
    rest = procedures
    for origin, column in (("listed", found), ("suggested", answer)):
        if column is None:
            continue
        rest = procedures.join(done.select(key).distinct(), key, "left_anti")
        some = rest.select(key, title, (F.col(column) if origin == "listed" else suggested(F.col(column))).alias("said"))
        done = done.unionByName(listed_steps(some, "said", key, title).withColumn("origin", F.lit(origin)))
    return done


def number_in_name(name: Column) -> Column:
    found = F.regexp_extract(name, r"_step_([\w-]+)$", 1)
    return F.when(found == "", "1").otherwise(found)
