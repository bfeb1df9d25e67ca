"""Tags, message directions and evidence filters of procedures, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomweave.functions import lexicon as lx
from fathomweave.functions import text as tx

# Fixed values.
STARTERS = ["UE", "AMF", "SMF"]
PROVIDERS = ["AUSF", "UDM", "UDR", "PCF"]
SERVICES = ["AUSF", "AMF", "SMF", "UDM", "UDR", "PCF", "NSSF", "NEF", "NRF", "SMSF", "UPF", "CHF", "BSF", "UDSF"]
REFERENCES = ["see section", "refer to", "as described in", "clause", "figure", "for more details", "as specified", "according to", "see clause"]
ACTIONS = ["perform", "execute", "send", "receive", "process", "handle", "initiate", "trigger", "validate", "authenticate", "generate", "establish", "select", "forward", "respond", "request", "shall"]
STEP_ACTIONS = [
    "send", "receive", "transmit", "forward", "verify", "authenticate", "establish", "perform", "request", "response", "initiate", "process",
    "validate", "compute", "derive", "store", "generate", "select", "indicate", "inform", "notify", "confirm", "reject", "accept",
]
STEP_THINGS = [
    "ue", "amf", "smf", "upf", "ausf", "udm", "udr", "pcf", "nrf", "network", "core", "base station", "gnb", "authentication",
    "registration", "session", "message", "procedure", "protocol",
]
META_PHRASES = ["figure shows", "as shown in", "see section", "refer to", "as described in", "according to", "as specified", "for more details", "note that", "editor"]
PROCEDURAL = [
    "the ue", "the amf", "the smf", "the network", "the procedure", "shall send", "shall receive", "shall perform", "shall verify",
    "may send", "may receive", "should send", "should receive", "then", "next", "after", "upon", "when", "if", "once",
]
TOPIC_TAGS = [
    (("authentication", "aka"), ["authentication", "security", "identity", "verification"]),
    (("registration",), ["registration", "attachment", "subscription", "identity"]),
    (("session",), ["session", "pdu", "data", "connectivity"]),
]
COMMON_TAGS = ["5g", "3gpp", "core", "network"]
# End of the fixed values.


def holds_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | c.contains(w), words, F.lit(False))


def _words(ws: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in ws]).cast("array<string>")


def search_tags(procedure: Column, functions: Column, most: int = 20) -> Column:
    """Words of the name, functions and topic tags, distinct, sorted, at most ``most``."""
    low = F.lower(procedure)
    topic = _words([])
    for marks, tags in reversed(TOPIC_TAGS):
        topic = F.when(holds_any(low, list(marks)), _words(tags)).otherwise(topic)
    own = F.filter(F.split(low, r"\s+"), lambda x: x != "")
    return F.slice(F.array_sort(F.array_distinct(F.concat(own, F.transform(functions, F.lower), topic, _words(COMMON_TAGS)))), 1, most)


def message_direction(message: Column, functions: Column, procedure: Column) -> Column:
    """struct(sender, receiver) that a message's name, else its procedure, else the order of the functions suggests."""
    low, at = F.lower(message), lambda k: F.get(functions, F.lit(k))
    pair = lambda a, b: F.struct(a.cast("string").alias("sender"), b.cast("string").alias("receiver"))
    first = lambda known: F.get(F.filter(functions, lambda f: f.isin(known)), F.lit(0))
    service = F.upper(F.regexp_extract(low, "^n([a-z]+)_", 1))
    consumer = F.get(F.filter(functions, lambda f: f != service), F.lit(0))
    by_role = first(STARTERS).isNotNull() & first(PROVIDERS).isNotNull()
    two = F.size(functions) >= 2
    name = F.lower(procedure)
    return (
        F.when(service.isin(SERVICES) & F.array_contains(functions, service), F.when(low.contains("response") & ~low.contains("request"), pair(service, consumer)).otherwise(pair(consumer, service)))
        .when(low.contains("request") & by_role, pair(first(STARTERS), first(PROVIDERS)))
        .when(low.contains("request") & two, pair(at(0), at(1)))
        .when(~low.contains("request") & low.contains("response") & by_role, pair(first(PROVIDERS), first(STARTERS)))
        .when(~low.contains("request") & low.contains("response") & two, pair(at(1), at(0)))
        .when(name.contains("authentication") & F.array_contains(functions, "AUSF") & F.array_contains(functions, "AMF"), pair(F.lit("AMF"), F.lit("AUSF")))
        .when(~name.contains("authentication") & name.contains("registration") & F.array_contains(functions, "AMF"), pair(F.when(F.array_contains(functions, "UE"), "UE"), F.lit("AMF")))
        .otherwise(pair(at(0), at(1)))
    )


def acts_in_text(function: Column, text: Column) -> Column:
    """True if a sentence names the function and an action and isn't a cross-reference."""
    return F.exists(F.split(F.lower(text), "[.!?;]"), lambda s: s.contains(F.lower(function)) & ~holds_any(s, REFERENCES) & holds_any(s, ACTIONS))


def involved_functions(functions: Column, descriptions: Column, text: Column) -> Column:
    """The functions that a step's description names, or that act in the section's text."""
    return F.filter(functions, lambda f: F.exists(descriptions, lambda d: F.lower(d).contains(F.lower(f))) | acts_in_text(f, text))


def is_step_description(c: Column) -> Column:
    """15 to 500 characters with an action and a thing of the domain, and no talk about the document."""
    low = F.lower(c)
    return F.length(c).between(15, 500) & holds_any(low, STEP_ACTIONS) & holds_any(low, STEP_THINGS) & ~holds_any(low, META_PHRASES)


def is_procedural(c: Column) -> Column:
    return holds_any(F.lower(c), PROCEDURAL)


def mentions_both(text: Column, a: Column, b: Column) -> Column:
    """True if some sentence holds both."""
    return F.exists(tx.sentences(F.lower(text)), lambda s: s.contains(F.lower(a)) & s.contains(F.lower(b)))


def is_continuation(line: Column, likeness: Column | None = None) -> Column:
    """True if a line goes on with the step before it; ``likeness``: cosine to that step's text, over 0.7 settles it.

    A null line or one of fewer than five characters goes on, one that starts like a step doesn't; else three
    tenths for a connector at its start, four for a reference back and two for under 100 characters must exceed a half.
    """
    own = tx.strip(F.coalesce(line, F.lit("")))
    low = F.lower(own)
    said = lambda c, patterns: c.rlike(f"(?U){'|'.join(patterns)}").cast("int")
    tenths = 3 * said(low, lx.CONNECTORS) + 4 * said(low, lx.BACK_REFERENCES) + 2 * (F.length(own) < 100).cast("int")
    alike = F.lit(False) if likeness is None else F.coalesce(likeness > 0.7, F.lit(False))
    starts = own.rlike(f"(?iU){'|'.join(lx.STEP_STARTS)}")
    return F.when(F.length(own) < 5, True).when(starts, False).when(alike, True).otherwise(tenths > 5)
