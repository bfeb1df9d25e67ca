"""Procedures as finite state machines: states, transitions, checks, JSON and DOT.

``steps``: procedure, name, description, entity_type; ``sends``: procedure, source_name, target_name, ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomweave.functions import text as tx
from fathomweave.runtime import drop_table, write_table


def states(steps: DataFrame) -> DataFrame:
    """(procedure, name, ord, is_initial, is_final, description, entity_type) in natural order of names."""
    order = Window.partitionBy("procedure").orderBy(tx.natural_key("name"), "name")
    rows = steps.withColumn("ord", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("procedure")))
    return rows.select("procedure", "name", "ord", (F.col("ord") == 1).alias("is_initial"), (F.col("ord") == F.col("n")).alias("is_final"), tx.shortened(F.coalesce("description", F.lit("")), 100).alias("description"), "entity_type")


def sequential(made: DataFrame) -> DataFrame:
    """A transition from each state to the next."""
    order = Window.partitionBy("procedure").orderBy("ord")
    rows = made.withColumn("target_state", F.lead("name").over(order)).where("target_state is not null")
    return rows.select("procedure", F.col("name").alias("source_state"), "target_state", F.lit("step_complete").alias("trigger"), F.lit("").alias("condition"), F.lit("proceed_to_next_step").alias("action"))


def by_message(steps: DataFrame, sends: DataFrame) -> DataFrame:
    """A transition for each step that sends something, to the next step by code point; its first message is the trigger."""
    order = Window.partitionBy("procedure").orderBy("name")
    rows = steps.select("procedure", "name").withColumn("target_state", F.lead("name").over(order)).where("target_state is not null")
    first = sends.groupBy("procedure", F.col("source_name").alias("name")).agg(F.min_by("target_name", "ord").alias("trigger"))
    action = F.concat(F.lit("send_"), F.replace(F.lower("trigger"), F.lit(" "), F.lit("_")))
    return rows.join(first, ["procedure", "name"]).select("procedure", F.col("name").alias("source_state"), "target_state", "trigger", F.lit("").alias("condition"), action.alias("action"))


def transitions(steps: DataFrame, sends: DataFrame) -> DataFrame:
    return sequential(states(steps)).unionByName(by_message(steps, sends))


def reachable_states(made: DataFrame, moves: DataFrame) -> DataFrame:
    """(procedure, name) that can be reached from the initial states, however far.

    Round k adds what lies exactly 2^k moves from the states known, and then doubles the moves, so a machine of n
    steps takes log n rounds; each round is written, so lineage does not grow. No round without a new state is followed by another.
    """
    spark = made.sparkSession
    hops, hops_path = write_table(moves.select("procedure", F.col("source_state").alias("a"), F.col("target_state").alias("b")).where("a <> b").distinct(), "hops")
    seen, path = write_table(made.where("is_initial").select("procedure", F.col("name").alias("a")).distinct(), "seen")
    n = seen.count()
    while True:
        more, new_path = write_table(seen.union(seen.join(hops, ["procedure", "a"]).select("procedure", "b")).distinct(), "seen")
        drop_table(spark, path)
        seen, path, before, n = more, new_path, n, more.count()
        if n == before:
            break
        further = hops.join(hops.select("procedure", F.col("a").alias("b"), F.col("b").alias("c")), ["procedure", "b"]).select("procedure", "a", F.col("c").alias("b")).distinct()
        hops, new_path = write_table(further, "hops")
        drop_table(spark, hops_path)
        hops_path = new_path
    drop_table(spark, hops_path)
    return seen.join(made.select("procedure", F.col("name").alias("a")), ["procedure", "a"], "left_semi").select("procedure", F.col("a").alias("name"))


def violations(made: DataFrame, moves: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(procedure, rule, detail) for each rule that a machine breaks; a procedure without states has no machine."""
    known = made.select("procedure", F.col("name").alias("s"))
    source = moves.join(known, (moves["procedure"] == known["procedure"]) & (moves["source_state"] == known["s"]), "left_anti").select("procedure", F.lit("unknown_source").alias("rule"), F.col("source_state").alias("detail"))
    target = moves.join(known, (moves["procedure"] == known["procedure"]) & (moves["target_state"] == known["s"]), "left_anti").select("procedure", F.lit("unknown_target").alias("rule"), F.col("target_state").alias("detail"))
    kind = made.where("entity_type is null or entity_type <> 'Step'").select("procedure", F.lit("not_a_step").alias("rule"), F.col("name").alias("detail"))
    per = made.groupBy("procedure").agg(F.max("is_initial").alias("i"), F.max("is_final").alias("f"))
    none = per.where("not i").select("procedure", F.lit("no_initial").alias("rule"), F.lit("").alias("detail")).unionByName(per.where("not f").select("procedure", F.lit("no_final").alias("rule"), F.lit("").alias("detail")))
    out = source.unionByName(target).unionByName(kind).unionByName(none)
    if seen is None:
        seen = reachable_states(made, moves)
    lost = made.select("procedure", "name").join(seen, ["procedure", "name"], "left_anti").select("procedure", F.lit("unreachable").alias("rule"), F.col("name").alias("detail"))
    return out.unionByName(lost).distinct()


def _machines(made: DataFrame, moves: DataFrame) -> DataFrame:
    """procedure, states (in order), transitions: sequential ones first, in the order of the states, then those by message, by source."""
    s = made.groupBy("procedure").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "is_initial", "is_final", "description"))).alias("states"))
    t = moves.groupBy("procedure").agg(F.collect_list(F.struct("source_state", "target_state", "trigger", "condition", "action")).alias("moves"))
    ords = F.map_from_entries(F.transform("states", lambda x: F.struct(x["name"], x["ord"])))
    late = lambda x: F.coalesce(x["action"] != "proceed_to_next_step", F.lit(True))
    placed = F.transform("moves", lambda x: F.struct(late(x).alias("late"), F.when(~late(x), F.coalesce(F.try_element_at("ords", x["source_state"]), F.lit(0))).alias("at"), x.alias("move")))
    rows = s.withColumn("ords", ords).join(t, "procedure", "left").withColumn("transitions", F.transform(F.array_sort(placed), lambda x: x["move"]))
    return rows.select("procedure", "states", F.coalesce("transitions", F.array()).alias("transitions"))


def to_json(made: DataFrame, moves: DataFrame) -> DataFrame:
    """(procedure, json): one document a machine, states and transitions in its order."""
    whole = F.struct(F.col("procedure").alias("procedure_name"), "states", "transitions", F.element_at("states", 1)["name"].alias("initial_state"), F.array(F.element_at("states", -1)["name"]).alias("final_states"))
    return _machines(made, moves).select("procedure", F.to_json(whole).alias("json"))


def _node(x: Column) -> Column:
    shape = F.when(x["is_final"], "doublecircle").otherwise("box")
    colour = F.when(x["is_initial"], "green").when(x["is_final"], "red").otherwise("lightblue")
    return F.format_string('  "%s" [shape=%s, style=filled, fillcolor=%s, label="%s\\n%s"];', x["name"], shape, colour, x["name"], tx.shortened(x["description"], 50))


def _move(x: Column) -> Column:
    return F.format_string('  "%s" -> "%s" [label="%s"];', x["source_state"], x["target_state"], F.when(F.coalesce(x["trigger"], F.lit("")) == "", "ε").otherwise(x["trigger"]))


def dot_lines(made: DataFrame, moves: DataFrame) -> DataFrame:
    """(procedure, part, line): the lines of a DOT drawing but for its frame; part 1 states, 2 transitions. Quotes are not escaped."""
    nodes = made.select("procedure", F.lit(1).alias("part"), _node(F.struct("*")).alias("line"))
    return nodes.unionByName(moves.select("procedure", F.lit(2).alias("part"), _move(F.struct("*")).alias("line")))


def to_dot(made: DataFrame, moves: DataFrame) -> DataFrame:
    """(procedure, dot): the whole drawing; states and transitions in the machine's order."""
    head = "digraph FSM {\n  rankdir=TB;\n  node [shape=box, style=rounded];\n\n"
    lines = F.concat(F.transform("states", _node), F.array(F.lit("")), F.transform("transitions", _move), F.array(F.lit("}")))
    return _machines(made, moves).select("procedure", F.concat(F.lit(head), F.array_join(lines, "\n")).alias("dot"))
