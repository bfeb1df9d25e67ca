"""Typed entities of a procedure: lexicon and pattern matches, merging, validation, descriptions."""

from __future__ import annotations

import re
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomweave.functions import lexicon as lx
from fathomweave.functions import text as tx

#: The three shapes of a message's name.
MESSAGE_PATTERNS = [r"([A-Z][a-z]+ (?:Request|Response|Indication|Confirm))", r"(N[a-z]+_[A-Za-z_]+)", r"([A-Z]+ (?:registration|authentication|establishment))"]
# End of the fixed values.


def matches(text: Column, words: list[str], strict: bool = False, ignore_case: bool = True, among: Column | None = None) -> Column:
    """The words of a list that stand in a text as whole words, in the list's order.

    Word boundaries ask for a letter after a word that ends in a mark, so such words are hardly ever found;
    ``strict`` asks for no letter on either side instead. Each word is a pattern of its own, compiled once, and tried where
    all its runs of letters are among the text's (:func:`runs_in`), given as ``among`` where several lists share them.
    """
    if among is None:
        # within a lambda, so that the runs are found once and not for each word
        return F.get(F.transform(F.array(runs_in(text, words)), lambda runs: matches(text, words, strict, ignore_case, runs)), F.lit(0))
    flag = "(?i)" if ignore_case else ""
    pattern = lambda w: flag + (rf"(?<!\w){tx.literal(w)}(?!\w)" if strict else rf"\b{tx.literal(w)}\b")
    hit = lambda w: reduce(lambda a, b: a & b, [*[F.array_contains(among, r) for r in _runs(w)], text.rlike(pattern(w))])
    return F.array_compact(F.array(*[F.when(hit(w), F.lit(w)) for w in words]))


def _runs(word: str) -> list[str]:
    return [r for r in re.split("[^a-z0-9_]+", re.sub("[A-Z]", lambda m: m[0].lower(), word)) if r]


#: Two characters that no pattern takes for a letter of ASCII, but whose lower case has one.
_ODD = ["\u0130", "\u212a"]


def runs_in(text: Column, words: list[str]) -> Column:
    """Which runs of ASCII letters, digits and underscores of ``words``, in lower case, are whole runs of a text; all where that can't be told."""
    known = F.array(*[F.lit(r) for r in sorted({r for w in words for r in _runs(w)})]).cast("array<string>")
    odd = reduce(lambda a, b: a | b, [text.contains(c) for c in _ODD])
    # a class of single characters is looked up in a table, one of ranges is not
    return F.when(odd, known).otherwise(F.array_intersect(F.split(F.lower(text), f"[^{string.ascii_lowercase}{string.digits}_]+"), known))


def pattern_messages(text: Column) -> Column:
    """Distinct messages that one of three patterns finds, of 6 to 79 characters and no stop-words, sorted."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in MESSAGE_PATTERNS]))
    # each pattern asks for one of these
    may = reduce(lambda a, b: a | b, [text.contains(x) for x in ("_", " Request", " Response", " Indication", " Confirm", " registration", " authentication", " establishment")])
    found = F.when(text.isNull() | may, found).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: F.length(x).between(6, 79) & ~tx.is_stop_word(x, lx.STOP_WORDS, lx.STOP_PHRASES))))


def merged(a: Column, b: Column, most: int = 15) -> Column:
    """Union of two lists without stop-words and words of one or two characters, sorted, at most ``most``."""
    # blanks and case are settled once a word; expressions within a lambda are not shared
    bare = F.transform(F.array_union(F.coalesce(a, F.array()), F.coalesce(b, F.array())), tx.strip)
    pairs = F.transform(F.array_distinct(bare), lambda w: F.struct(w.alias("w"), F.lower(w).alias("low")))
    kept = F.filter(pairs, lambda x: (F.length(x["w"]) > 2) & ~tx.is_stop_low(x["low"], lx.STOP_WORDS, lx.STOP_PHRASES))
    return F.slice(F.array_sort(F.transform(kept, lambda x: x["w"])), 1, most)


def normal_function(candidate: Column, known: list[str] = lx.NETWORK_FUNCTIONS) -> Column:
    """The known network function that a candidate means; null if none."""
    up = tx.strip(F.upper(candidate))
    head, tail = F.regexp_replace(up, r"^(5G-|UE-|N[0-9]+-|CN-)", ""), F.regexp_replace(up, r"(-FUNCTION|-SERVER|-GATEWAY|-NODE)$", "")
    upper = [w.upper() for w in known]
    phrase = F.lit(None).cast("string")
    for k, v in lx.FUNCTION_PHRASES.items():
        phrase = F.when(up == k, F.lit(v)).otherwise(phrase)
    return F.coalesce(F.when(up.isin(upper), up), F.when(head.isin(upper), head), F.when(tail.isin(upper), tail), phrase)


def valid_functions(names: Column, step_text: Column) -> Column:
    """Known functions among ``names`` that the step text speaks of as whole words; all known ones if there's no step text; sorted."""
    known = F.array_distinct(F.array_compact(F.transform(names, lambda x: normal_function(x))))
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(step_text), r"\W+", " "), F.lit(" "))
    said = F.filter(known, lambda x: low.contains(F.concat(F.lit(" "), F.regexp_replace(F.lower(x), r"\W+", " "), F.lit(" "))))
    return F.array_sort(F.when(F.trim(F.coalesce(step_text, F.lit(""))) == "", known).otherwise(said))


def valid_parameters(names: Column, text: Column) -> Column:
    """Known parameters in capitals, and those of a parameter's shape that share a sentence with a word that announces one."""
    known = [w.upper() for w in lx.PARAMETERS]
    parts = F.split(text, "[.!?]")
    near = lambda x: F.exists(parts, lambda s: F.lower(s).contains(F.lower(x)) & F.lower(s).rlike("parameter|value|field|identifier|ie"))
    plausible = lambda x: F.upper(x).rlike("^[A-Z-]{3,8}$") | F.upper(x).contains("ID")
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(names, lambda x: F.when(F.upper(tx.strip(x)).isin(known), F.upper(tx.strip(x))).when(plausible(x) & near(x), x)))))


def valid_keys(names: Column, text: Column) -> Column:
    known = [w.upper() for w in lx.KEYS]
    spoken = F.lower(text).rlike("key|security|authentication|ciphering|derives")
    shape = lambda x: x.startswith("K_") | (x.startswith("K") & (F.upper(x) == x)) | x.endswith("*")
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(names, lambda x: F.when(F.upper(tx.strip(x)).isin(known), F.upper(tx.strip(x))).when(shape(x) & spoken, x)))))


def valid_messages(names: Column, text: Column) -> Column:
    known = [w.lower() for w in lx.MESSAGES]
    ends = "(request|response|accept|reject|command|complete|indication|notification)$"
    spoken = F.lower(text).rlike("send|receive|transfer|invoke|message")
    good = lambda x: F.lower(tx.strip(x)).isin(known) | ((F.length(x) > 4) & (F.lower(x).rlike(ends) | F.lower(x).rlike("^n[a-z]+_")) & spoken)
    return F.array_sort(F.array_distinct(F.filter(names, good)))


def search_description(parent: Column, name: Column, steps: Column, text: Column) -> Column:
    """Parent section, procedure and steps in order; the first 4000 characters of the text where there are no steps."""
    body = F.when(F.size(steps) > 0, F.concat(F.lit("Steps: "), F.array_join(steps, " "))).otherwise(F.substring(text, 1, 4000))
    return F.concat_ws(". ", F.when(parent.isNotNull(), F.concat(F.lit("Parent Section: "), parent)), F.concat(F.lit("Procedure: "), name), body)


def embedding_text(name: Column, kind: Column, words: Column, description: Column) -> Column:
    return F.concat(F.lit("Entity: "), name, F.lit(". Type: "), kind, F.lit(". Keywords: "), F.array_join(words, " "), F.lit(". Description: "), description)


#: What a procedure is given when nothing was found in it, by words in its name; the last one for all others.
LEAST = [
    (["authentication", "aka"], (["AUSF", "AMF", "UE", "SEAF"], ["Authentication Request", "Authentication Response"], ["SUCI", "RAND", "AUTN"], ["5G-AKA", "Kausf"])),
    (["registration"], (["AMF", "UE"], ["Registration Request", "Registration Accept"], ["5G-GUTI", "SUCI"], [])),
    ([], (["AMF", "SMF"], ["Request Message", "Response Message"], ["Identifier"], [])),
]
# End of the fixed values.


def least_entities(procedure: Column) -> Column:
    """What a procedure is given when nothing was found in it."""
    low = F.lower(procedure)

    def made(lists: tuple) -> Column:
        named = zip(("network_functions", "messages", "parameters", "keys"), lists, strict=True)
        return F.struct(*[F.array(*[F.lit(x) for x in xs]).cast("array<string>").alias(n) for n, xs in named])

    out = made(LEAST[-1][1])
    for words, lists in reversed(LEAST[:-1]):
        said = F.lit(False)
        for w in words:
            said = said | low.contains(w)
        out = F.when(said, made(lists)).otherwise(out)
    return out


def first_hit(hits: DataFrame, key: str = "section") -> DataFrame:
    """One row for each name of a section: the hit of the earliest method, then the earliest place (method_ord, pos)."""
    order = Window.partitionBy(key, "name").orderBy("method_ord", "pos", "entity_type")
    return hits.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


#: Words that are no names, whatever pattern they fit.
COMMON = ["the", "and", "for", "with", "from"]
# End of the fixed values.


def _named(name: Column) -> Column:
    return (F.length(name) > 2) & ~F.lower(name).isin(COMMON)


def recognised(sections: DataFrame, key: str = "section", text: str = "text", hits: DataFrame | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """(section, name, entity_type, method_ord, pos): the hits of four methods, the first hit of a name wins.

    1: ``hits`` of a recogniser (see :func:`from_recogniser`, with the same key), 2: known functions, 3: typed patterns, 4: ``labelled``
    (section, pos, word, label), the entities of a parser, but for functions. Pattern and parser hits of one or two characters and common words are no names.
    """
    known = sections.select(key, F.posexplode(matches(F.col(text), lx.RECOGNISED_FUNCTIONS)).alias("pos", "name")).withColumn("entity_type", F.lit("NetworkFunction")).withColumn("method_ord", F.lit(2))
    found = F.array(*[F.struct(F.lit(t).alias("entity_type"), F.lit(i).alias("k"), F.regexp_extract_all(F.col(text), F.lit(f"(?i)({p})"), F.lit(1)).alias("names")) for i, (t, p) in enumerate(lx.TYPE_PATTERNS)])
    typed = sections.select(key, F.explode(found).alias("f")).select(key, "f.entity_type", "f.k", F.posexplode("f.names").alias("at", "name"))
    typed = typed.select(key, (F.col("k") * 1000000 + F.col("at")).alias("pos"), tx.strip(F.col("name")).alias("name"), "entity_type", F.lit(3).alias("method_ord")).where(_named(F.col("name")))
    every = known.unionByName(typed)
    if hits is not None:
        every = every.unionByName(hits.select(key, "pos", "name", "entity_type", "method_ord"))
    if labelled is not None:
        told = labelled.select(key, "pos", tx.strip(F.col("word")).alias("name"), mapped_label(F.col("label")).alias("entity_type"), F.lit(4).alias("method_ord"))
        every = every.unionByName(told.where(_named(F.col("name")) & F.col("entity_type").isNotNull() & (F.col("entity_type") != "NetworkFunction")))
    return first_hit(every, key)


def classified(name: Column, context: Column) -> Column:
    """Entity type by rules on the name, then on its context."""
    low = F.lower(context)
    return (
        F.when(F.upper(name).isin(lx.RECOGNISED_FUNCTIONS), "NetworkFunction").when(name.startswith("K_") | name.endswith("*"), "Key").when(low.contains("procedure"), "Procedure")
        .when(low.rlike("parameter|identifier|value"), "Parameter").when(low.rlike("request|response|message"), "Message").when(F.upper(name).isin("UE", "GNB", "NG-ENB", "USIM", "ME", "NG-RAN", "DN", "AF"), "Actor").otherwise("Entity")
    )


def mapped_label(label: Column) -> Column:
    return F.when(label == "ORG", "Actor").when(label == "PRODUCT", "Entity").when(label == "EVENT", "Procedure").when(label.isin("PERSON", "GPE"), None).otherwise("Entity")


def substantial(sections: DataFrame, text: str = "text", least: int = 50) -> DataFrame:
    """The sections of at least ``least`` characters; the others give neither entities nor relations."""
    return sections.where(F.length(text) >= least)


def pieces(sections: DataFrame, key: str = "section", text: str = "text", size: int = 512) -> DataFrame:
    """(key, piece, context): the text in pieces of ``size`` characters, as a recogniser takes them; those of fewer than ten characters without blanks around are left out."""
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))), lambda i: F.substring(F.col(text), i * size + 1, F.lit(size)))
    rows = sections.where(F.length(text) > 0).select(key, F.posexplode(starts).alias("piece", "context"))
    return rows.where(F.length(tx.strip(F.col("context"))) >= 10)


def from_recogniser(found: DataFrame, key: str = "section", hits: str = "hits") -> DataFrame:
    """(key, name, entity_type, method_ord, pos) of a recogniser's hits (word, score) in pieces: scores over 0.8, names of over two characters, the first hit of a name."""
    rows = found.select(key, "piece", "context", F.posexplode(hits).alias("at", "h")).withColumn("name", tx.strip(F.col("h.word")))
    rows = rows.where((F.col("h.score") > 0.8) & (F.length("name") > 2))
    return first_hit(rows.select(key, "name", classified(F.col("name"), F.col("context")).alias("entity_type"), F.lit(1).alias("method_ord"), (F.col("piece") * 1000000 + F.col("at")).alias("pos")), key)
