"""The requirement graph, verb relations, step continuation and the section gate over the driver's tables."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomweave.functions import lexicon as lx
from fathomweave.operators import build, classify, evidence, extract, live, relate, requirements, sinks
from fathomweave.plans.tables import pick, procedures, quoted, register, table
from fathomweave.plans.text_queries import _lines as document_lines
from fathomweave.plans.text_queries import derives_sql
from fathomweave.runtime import new_path

QUERIES: dict = {}
ORACLE_SQL: dict = {}
_CUTS = ", ".join(f"'{w}'" for w in requirements.CUTS)


@register(QUERIES, ORACLE_SQL, rf"""
with w as (select doc_id, source, string_split_regex(regexp_replace(text, '[.,;:!?()\[\]"|]', ' | ', 'g'), '[\x20\x09-\x0D]+') as ws from documents),
p as (select doc_id, source, list_transform(string_split(array_to_string(list_transform(ws, lambda x: case when lower(x) in ({_CUTS}) then '|' else x end), ' '), '|'), lambda x: trim(x)) as ps from w),
e as (select doc_id, unnest(list_distinct(list_filter(ps, lambda x: x <> '' and len(string_split(x, ' ')) < 4))) as target_name from p)
select cast(doc_id as varchar) as source_name, target_name, 'CONTAINS_ENTITY' as rel_type from e
union all select cast(doc_id as varchar), regexp_extract(source, '([^/]*)$', 1), 'PART_OF' from documents where source is not null""")
def requirement_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("title"), "text", "source")
    return requirements.requirement_graph(requirements.processed(d), "doc_id")[1]


_ENDS = ["AMF", "UE", "UDM", "XYZ", "SMF"]
_VERBS = ["send", "derive", "contain", "involve", "verify", "walk"]
_SUBJECT, _SECOND, _OBJECT = pick("o_custkey", _ENDS), pick("o_orderkey + o_custkey", _ENDS), pick("o_orderkey", _ENDS)
_VERB = pick("o_orderkey", _VERBS)
_KNOWN = [x for x in _ENDS if x != "XYZ"]
_TOKENS = f"""array(struct(0 as i, {_SUBJECT} as word, 'x' as lemma, 'PROPN' as pos, {pick('o_custkey', ['nsubj', 'nsubjpass', 'det'])} as dep, 2 as head),
  struct(1 as i, {_SECOND} as word, 'x' as lemma, 'PROPN' as pos, 'nsubj' as dep, case when o_custkey % 2 = 0 then 2 else 3 end as head),
  struct(2 as i, 'said' as word, {_VERB} as lemma, 'VERB' as pos, 'ROOT' as dep, 2 as head),
  struct(3 as i, {_OBJECT} as word, 'y' as lemma, 'NOUN' as pos, {pick('o_custkey', ['dobj', 'pobj', 'attr', 'advmod'])} as dep, 2 as head))"""


@register(QUERIES, ORACLE_SQL, f"""
with t as (select o_orderkey, o_custkey, {_SUBJECT} as a, {_SECOND} as b, {_OBJECT} as o, {_VERB} as verb from orders), known as (select ['{"', '".join(_KNOWN)}'] as ks),
e as (select o_orderkey, verb, case when o_custkey % 2 = 0 and list_contains(ks, b) then b when o_custkey % 3 < 2 and list_contains(ks, a) then a end as s, case when o_custkey % 4 < 3 and list_contains(ks, o) then o end as o from t, known)
select o_orderkey, 2 as "at", s as source_name, o as target_name, case verb {" ".join(f"when '{v}' then '{k}'" for k, vs in lx.VERB_RELATIONS.items() for v in vs)} end as rel_type, verb, cast(0.8 as double) as confidence
from e where s <> o and verb <> 'walk'""")
def verb_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_TOKENS).alias("tokens"), F.array(*[F.lit(x) for x in _KNOWN]).alias("names"))
    return relate.verb_relations(rows, "o_orderkey")


def _sql_says(patterns: list[str]) -> str:
    """RE2 knows no marks, so word ends and word characters of all scripts are written out."""
    full = [p.replace(r"\w", r"[\p{L}\p{N}_]") for p in patterns]
    full = [r"(^|[^\p{L}\p{N}_])" + p[2:-2] + r"($|[^\p{L}\p{N}_])" if p.startswith(r"\b") else p for p in full]
    return " or ".join(f"regexp_matches(lower(own), '{p}')" for p in full)


@register(QUERIES, ORACLE_SQL, rf"""
with l as (select doc_id, generate_subscripts(ls, 1) - 1 as line, unnest(ls) as t from (select doc_id, string_split(text, chr(10)) as ls from documents)),
o as (select doc_id, line, regexp_replace(t, '^\s+|\s+$', '', 'g') as own from l)
select doc_id, cast(line as integer) as line, case when length(own) < 5 then true when regexp_matches(own, '^\d+[a-z]*\.\s+|^step\s+\d+', 'i') then false
  else 3 * cast({_sql_says(lx.CONNECTORS)} as int) + 4 * cast({_sql_says(lx.BACK_REFERENCES)} as int) + 2 * cast(length(own) < 100 as int) > 5 end as goes_on from o""")
def step_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.select("doc_id", "line", evidence.is_continuation(F.col("text")).alias("goes_on"))


@register(QUERIES, ORACLE_SQL, "select conv_id, turn from conversations where length(text) >= 50")
def section_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.substantial(table(spark, sf_dir, "conversations")).select("conv_id", "turn")


_ONTOLOGY = [(t, w) for t, ws in lx.ONTOLOGY.items() for w in ws]
_SECTION = f"""'The ' || {pick('o_custkey', ['AMF', 'amf', 'SMFs', 'UE', 'USIM'])} || ' meets ' || {pick('o_orderkey', ['SUCI.', 'KAUSF.', 'Handover.', '5G AKA.', 'XRES*.'])} || ' ' || {pick('o_custkey + o_orderkey', ['AMF', 'AUSF', 'UDM', 'XYZ'])}
  || {pick('o_orderkey', [' sends a ', ' sends an ', ' forwards a '])} || o_orderpriority || ' to the ' || {pick('o_custkey', ['UE', 'SEAF', 'UDM'])} || '. The ' || {pick('o_orderkey + o_custkey', ['UDM', 'AMF', 'AUSF'])}
  || {pick('o_custkey', [' derives ', ' derived ', ' shall derive ', ' DERIVES '])} || {pick('o_orderkey', ['KAUSF', 'KAMF', 'nothing'])} || ' from ' || {pick('o_custkey + o_orderkey', ['AUTN', 'RAND', 'UDM'])} || '.'"""
_SENDING = r"([A-Z0-9/ -]+)\s+sends an?\s+(.+?)\s+to the\s+([A-Z0-9/ -]+)"


@register(QUERIES, ORACLE_SQL, rf"""
with t as (select o_orderkey as section, {_SECTION} as text from orders),
known(entity_type, name) as (values {", ".join(f"({quoted(t)}, {quoted(w)})" for t, w in _ONTOLOGY)}),
found as (select section, text, name, entity_type from t, known where regexp_matches(text, '(?i)\b' || regexp_escape(name) || '\b')),
n as (select distinct section, name as word from found), {derives_sql('t', 'n')},
h as (select section, trim(regexp_extract(m, '{_SENDING}', 1)) as src, trim(regexp_extract(m, '{_SENDING}', 2)) as msg, trim(regexp_extract(m, '{_SENDING}', 3)) as tgt from (select section, unnest(regexp_extract_all(text, '{_SENDING}')) as m from t)),
sent as (select h.* from h join n a on a.section = h.section and a.word = src join n b on b.section = h.section and b.word = tgt),
ents as (select section, text, name, entity_type from found union all select distinct s.section, t.text, msg, 'Message' from sent s join t using (section)),
edges as (
  select section, source_name, target_name, rel_type from derived
  union all select section, src, msg, 'SENDS_TO' from sent union all select section, msg, tgt, 'IS_SENT_TO' from sent union all select section, msg, src, 'SENT_BY' from sent
  union all select f.section, f.first, k.name, 'CONTAINS' from (select section, text, min(name) as first from found group by 1, 2) f, (select distinct name from known where entity_type in ('Key', 'Parameter')) k where contains(f.text, k.name)
  union all select distinct x.section, x.name, k.name, 'PART_OF' from ents x, known k where k.entity_type = 'Procedure' and contains(x.text, k.name) and x.name <> k.name)
select cast(section as varchar) as clause, source_name, target_name, rel_type from edges
union all select cast(section as varchar), name, entity_type, 'NODE' from ents""")
def section_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of all sections, and their nodes as rows of the kind NODE."""
    rows = table(spark, sf_dir, "orders").select(F.lit("d").alias("document"), F.col("o_orderkey").cast("string").alias("clause"), F.expr(_SECTION).alias("text"))
    entities, edges = build.from_sections(rows)
    nodes = entities.select("clause", F.col("name").alias("source_name"), F.col("entity_type").alias("target_name"), F.lit("NODE").alias("rel_type"))
    return edges.select("clause", "source_name", "target_name", "rel_type").unionByName(nodes)


_SPOKEN = f"""{pick('o_custkey', ['AMF', 'smf', 'UE', 'The', 'and', 'ausf'])} || ' ' || {pick('o_orderkey', ['registration', 'service request', 'SUCI identifier', 'K_AMF', 'XRES*s', 'ab value', 'the procedure'])} || ', '
  || {pick('o_custkey + o_orderkey', ['DN', 'USIM', 'AF and UE', 'gNB', 'with authentication'])} || ' ' || {pick('o_orderkey', ['UDM', 'none'])}"""
_TYPED = [(t, p.replace(r"\b[A-Z]{3,6}\b(?=\s+(?:parameter|identifier|value))", r"\b([A-Z]{3,6})\s+(?:parameter|identifier|value)"), int("(?=" in p)) for t, p in lx.TYPE_PATTERNS]


@register(QUERIES, ORACLE_SQL, rf"""
with t as (select o_orderkey as section, {_SPOKEN} as text from orders),
known as (select section, name, 'NetworkFunction' as entity_type, 2 as method_ord, ord as pos from t, (values {", ".join(f"({i}, '{w}')" for i, w in enumerate(lx.RECOGNISED_FUNCTIONS))}) k(ord, name) where regexp_matches(text, '(?i)\b' || name || '\b')),
typed as ({" union all ".join(f"select section, unnest(x) as name, '{t}' as entity_type, 3 as method_ord, {i} * 1000000 + generate_subscripts(x, 1) - 1 as pos from (select section, regexp_extract_all(text, '(?i){p}', {g}) as x from t)" for i, (t, p, g) in enumerate(_TYPED))}),
told as (select section, upper(text[1:4]) as name, 'Actor' as entity_type, 4 as method_ord, 0 as pos from t),
every as (select * from known union all select * from typed where length(name) > 2 and lower(name) not in ('the', 'and', 'for', 'with', 'from') union all select section, trim(name), entity_type, method_ord, pos from told where length(trim(name)) > 2 and lower(trim(name)) not in ('the', 'and', 'for', 'with', 'from')),
first as (select *, row_number() over (partition by section, name order by method_ord, pos, entity_type) as rn from every)
select section, name, entity_type, method_ord from first where rn = 1""")
def recognised_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("section"), F.expr(_SPOKEN).alias("text"))
    labelled = rows.select("section", F.lit(0).alias("pos"), F.upper(F.substring("text", 1, 4)).alias("word"), F.lit("ORG").alias("label"))
    return extract.recognised(rows, labelled=labelled).select("section", "name", "entity_type", "method_ord")


_FUNCTIONS, _PARAMETERS, _KEYS = (", ".join(f"({quoted(w)})" for w in ws if w.replace(" ", "").isalpha() and (len(w) > 2 or ws is lx.NETWORK_FUNCTIONS)) for ws in (lx.NETWORK_FUNCTIONS, lx.PARAMETERS, lx.KEYS))


@register(QUERIES, ORACLE_SQL, rf"""
with d as (select doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '[^A-Za-z\n .]', 'x', 'g'), chr(10)), lambda x: trim(x) <> '') as ls from documents where doc_id % 3 > 0),
s as (select doc_id, lower(unnest(ls)) as said from d), t as (select doc_id, array_to_string(ls, chr(10)) as text from d),
known(kind, w) as (select 'NetworkFunction', * from (values {_FUNCTIONS}) union all select 'Parameter', * from (values {_PARAMETERS}) union all select 'Key', * from (values {_KEYS})),
found as (select distinct doc_id, kind, upper(w) as w from t, known where regexp_matches(text, '(?i)\b' || w || '\b')),
none as (select doc_id from d where len(ls) = 0),
least as (select doc_id, kind, w from none, (values ('NetworkFunction', 'AMF'), ('NetworkFunction', 'SMF'), ('Message', 'Request Message'), ('Message', 'Response Message'), ('Parameter', 'Identifier')) v(kind, w)),
named as (select kind, w from found union select kind, w from least),
held as (select kind, count(*) as n from s join found using (doc_id) where contains(said, lower(w)) group by kind),
steps as (select sum(len(ls)) as n, sum(greatest(len(ls) - 1, 0)) as moves, count(*) as flows from d), bare as (select count(*) as n from none),
c as (
  select 'node' as what, kind, count(*) as n from named group by kind union all select 'node', 'Procedure', flows from steps union all select 'node', 'Step', n from steps
  union all select 'edge', 'PART_OF', n from steps union all select 'edge', 'FOLLOWED_BY', moves from steps
  union all select 'edge', 'INVOKE', count(*) from (select * from found union all select * from least) where kind = 'NetworkFunction' union all select 'edge', 'INVOLVE', n from held where kind = 'NetworkFunction'
  union all select 'edge', 'CONTAINS', sum(n) from held where kind <> 'NetworkFunction' union all select 'edge', 'SEND_BY', 4 * n from bare union all select 'edge', 'SEND_TO', 2 * n from bare)
select what, kind, cast(n as bigint) as n from c where n > 0""")
def live_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of the graph of all documents: two of three have a figure, a model has named them, and their lines are steps. Marks and letters with marks are left out of texts."""
    d = table(spark, sf_dir, "documents")
    lines = F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), f"[^{string.ascii_letters}\n .]", "x"), "\n"), lambda x: F.trim(x) != "")
    numbered = F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    title, figure = F.concat(F.lit("Flow "), F.col("doc_id")), F.col("doc_id") % 3 > 0
    rows = d.select(F.col("doc_id").cast("string").alias("document"), F.lit(0).alias("doc_seq"), F.lit(1).cast("bigint").alias("section_seq"), title.alias("title"), F.lit("1").alias("clause"), numbered.alias("text"), figure.alias("has_figure"))
    return live.counts(*live.build_graph(rows, new_path(spark, "live"), named=F.col("title")))


_SAYS = f"""{pick('o_custkey', ['Registration Request', 'registration Request', 'Namf_Communication_Transfer', 'AMF registration', 'N_x', 'Service Confirm', 'Step Request'])} || ' and ' || {pick('o_orderkey', ['Identity Response', 'SMF establishment', 'Nausf_UEAuthentication', 'none', 'A authentication'])}"""
_STOPS = ", ".join(quoted(w) for w in lx.STOP_WORDS)
_HOLDS = " or ".join(f"contains(lower(trim(m)), {quoted(w)})" for w in lx.STOP_PHRASES)


@register(QUERIES, ORACLE_SQL, rf"""
with t as (select o_orderkey, {_SAYS} as text from orders),
f as (select o_orderkey, unnest({" || ".join(f"regexp_extract_all(text, '{p}', 1)" for p in extract.MESSAGE_PATTERNS)}) as m from t)
select o_orderkey, list_sort(list_distinct(list(m))) as messages from f where length(m) between 6 and 79 and lower(trim(m)) not in ({_STOPS}) and not ({_HOLDS}) group by o_orderkey""")
def message_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_SAYS).alias("text"))
    return rows.select("o_orderkey", extract.pattern_messages(F.col("text")).alias("messages")).where("size(messages) > 0")


_ANSWER = pick("o_custkey", ["Yes\nHandover of sessions", "yes, it is\nabc", "No\nHandover", "I know: yes\nHandover", "YES\n\n  Paging  \nmore", "perhaps"])


@register(QUERIES, ORACLE_SQL, f"""
with t as (select o_orderkey, {_ANSWER} as answer from orders),
l as (select *, list_filter(list_transform(string_split(answer, chr(10)), lambda x: trim(x)), lambda x: x <> '' and not contains(lower(x), 'yes') and not contains(lower(x), 'no'))[1] as line from t)
select o_orderkey, case when length(line) between 4 and 79 then line else 'title' end as name from l where contains(lower(answer), 'yes') and not contains(lower(answer), 'no')""")
def answered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ANSWER).alias("answer"))
    return rows.select("o_orderkey", classify.answer_name(F.col("answer"), F.lit("title")).alias("name")).where("name is not null")


_LABELS = ["ORG", "PRODUCT", "EVENT", "PERSON", "GPE", "DATE"]


@register(QUERIES, ORACLE_SQL, f"""
with t as (select o_orderkey, {pick('o_custkey', _LABELS)} as label from orders)
select o_orderkey, case label when 'ORG' then 'Actor' when 'PRODUCT' then 'Entity' when 'EVENT' then 'Procedure' when 'DATE' then 'Entity' end as entity_type,
  'Entity: ' || label || '. Type: T. Keywords: a b. Description: ' || o_orderkey as said from t""")
def label_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(pick("o_custkey", _LABELS)).alias("label"))
    said = extract.embedding_text(F.col("label"), F.lit("T"), F.array(F.lit("a"), F.lit("b")), F.col("o_orderkey").cast("string"))
    return rows.select("o_orderkey", extract.mapped_label(F.col("label")).alias("entity_type"), said.alias("said"))


_RELATED = "'so: {\"relationships\": [{\"source\": \"a' || o_custkey || '\", \"target\": \"b\", \"type\": \"' || " + pick("o_orderkey", ["INVOKE", "LIKES", "SEND"]) + " || '\"}, {\"source\": \"c\", \"target\": \"d\", \"type\": \"PART_OF\"}]} end'"


@register(QUERIES, ORACLE_SQL, f"""
with t as (select o_orderkey, o_custkey, {pick('o_orderkey', ['INVOKE', 'LIKES', 'SEND'])} as kind from orders),
e as (select cast(o_orderkey as varchar) as procedure, 'a' || o_custkey as source_name, 'b' as target_name, kind as rel_type from t where kind <> 'LIKES' union all select cast(o_orderkey as varchar), 'c', 'd', 'PART_OF' from t)
select *, 'llm_extraction' as extraction_method from e""")
def annotated_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations in a model's answers, put before those of procedures without anything."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("procedure"), F.expr(_RELATED).alias("answer"))
    none = procedures(spark, sf_dir).where("false")
    return relate.required(none, relate.from_annotation(rows)).select("procedure", "source_name", "target_name", "rel_type", "extraction_method")


@register(QUERIES, ORACLE_SQL, "select l_suppkey, l_partkey from lineitem where l_returnflag = 'R' order by 'p' || l_partkey, 's' || l_suppkey limit 5")
def sampled_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    edges = li.select(F.concat(F.lit("p"), "l_partkey").alias("source_name"), F.concat(F.lit("s"), "l_suppkey").alias("target_name"), F.col("l_returnflag").alias("rel_type"), "l_suppkey", "l_partkey")
    return sinks.sample_relations(edges, "R").select("l_suppkey", "l_partkey")


@register(QUERIES, ORACLE_SQL, r"""
with l as (select doc_id, generate_subscripts(ls, 1) - 1 as para_seq, unnest(ls) as text from (select doc_id, string_split(text, chr(10)) as ls from documents))
select cast(doc_id as varchar) as document, cast(para_seq as integer) as para_seq, length(text) < 40 or regexp_matches(text, '^\d+(\.\d+)*\s+') or regexp_matches(text, '^[A-Z]\.\d+(\.\d+)*\s+[A-Z]') as is_header, case when length(text) < 40 then 'Heading 1' else 'Normal' end as style from l""")
def paragraph_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.paragraph_log(document_lines(spark, sf_dir)).select("document", "para_seq", "is_header", "style")
