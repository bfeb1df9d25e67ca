"""Sections, steps, patterns and lexicons over documents, pages and small literal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomweave.functions import chunks
from fathomweave.functions import lexicon as lx
from fathomweave.functions import text as tx
from fathomweave.operators import classify, extract, mining, packets, phrases, relate, sections, steps
from fathomweave.plans.tables import pick, register, table, word_rows

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as paragraphs; short ones stand for headings."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("para_seq", "text"))
    return d.select(F.col("doc_id").cast("string").alias("document"), F.lit(0).alias("doc_seq"), "para_seq", F.when(F.length("text") < 40, "Heading 1").otherwise("Normal").alias("style"), "text")


_LINES = "lines as (select doc_id, generate_subscripts(ls, 1) - 1 as para_seq, trim(unnest(ls), ' \t') as text from (select doc_id, string_split(text, chr(10)) as ls from documents))"


@register(QUERIES, ORACLE_SQL, f"""
with {_LINES}, l as (select *, length(text) < 40 or regexp_matches(text, '^\\d+(\\.\\d+)*\\s+') or regexp_matches(text, '^[A-Z]\\.\\d+(\\.\\d+)*\\s+[A-Z]') as h from lines where text <> ''),
g as (select *, sum(cast(h as int)) over (partition by doc_id order by para_seq rows unbounded preceding) as s from l)
select cast(doc_id as varchar) as document, cast(s as bigint) as section_seq, max(case when h then text end) as title,
  coalesce(string_agg(case when not h then chr(10) || text end, '' order by para_seq), '') as text from g where s > 0 group by doc_id, s""")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.assemble(_lines(spark, sf_dir)).select("document", F.col("section_seq").cast("bigint").alias("section_seq"), "title", "text")


@register(QUERIES, ORACLE_SQL, f"""
with {_LINES}, r as (select case when regexp_matches(text, '^\\d+(\\.\\d+)*\\s+[A-Z]') then 2 when regexp_matches(text, '^[A-Z]\\.\\d+(\\.\\d+)*\\s+[A-Z]') then 3
  when length(text) < 80 and upper(text) = text and regexp_matches(text, '[A-Z]') and len(string_split_regex(text, '\\s+')) between 2 and 7 and not regexp_matches(text, '[.:;!?]$') then 4
  when regexp_matches(text, '^([0-9]+|[A-Z])[.)]?\\s+[A-Z][a-z]') and len(string_split_regex(text, '\\s+')) < 12 and not text like '%.' then 5 else 0 end as rule from lines where text <> '')
select cast(rule as integer) as rule, count(*) as n from r group by rule""")
def section_v3_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).withColumn("text", F.regexp_replace("text", "^[ \t]+|[ \t]+$", "")).where("text <> ''")
    return lines.select(tx.header_rules(F.lit("Normal"), F.col("text")).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


_CLAUSE = f"(o_orderkey % 7 + 1) || '.' || (o_custkey % 5) || {pick('o_orderkey', ['', '.0', '.0b', '.2a', '.3.1'])}"
_CAPTION = f"{pick('o_custkey + o_orderkey', ['Figure ', 'see Figure ', 'figure ', 'no caption ', 'Figure A.'])} || (o_orderkey % 7 + 1) || '.' || (o_custkey % 5) || {pick('o_custkey', ['-1: x', 'a-2:', '.2-1', ''])}"


@register(QUERIES, ORACLE_SQL, f"""
with c as (select o_orderkey, text, clause, split_part(regexp_extract(text, '(?i)Figure\\s+([\\d\\.-]+a?):?', 1), '-', 1) as base from (select o_orderkey, {_CAPTION} as text, {_CLAUSE} as clause from orders))
select o_orderkey, text, clause, base, base <> '' and base = regexp_replace(clause, '\\.0[a-z]?$', '') as own from c""")
def figure_caption_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_CAPTION} as text", f"{_CLAUSE} as clause")
    return c.select("o_orderkey", "text", "clause", tx.figure_base(F.col("text")).alias("base"), tx.is_own_figure(F.col("text"), F.col("clause")).alias("own"))


_PARTS = f"""select *, clause || ' ' || p_name as title from (select 'd' || (p_partkey % 20) as document, p_partkey % 20 as doc_seq, p_partkey as section_seq, p_name,
  {pick('p_partkey', ['4', '5', '6', 'A'])} || {pick('p_partkey', ['', '.2', '.2.0', '.1.0', '.2.1', '.1', '.2.1.7'])} as clause from part)"""
_PARENT = "case when len(ps) >= 2 then array_to_string(ps[1:len(ps) - 1], '.') end"


@register(QUERIES, ORACLE_SQL, f"""
with s as ({_PARTS}),
p as (select *, case when string_split(clause, '.')[-1] = '0' then string_split(clause, '.')[1:len(string_split(clause, '.')) - 1] else string_split(clause, '.') end as ps from s),
l as (select clause, title from (select *, row_number() over (partition by clause order by doc_seq desc, section_seq desc) as rn from s) where rn = 1)
select p.document, p.clause, p.title, l.title as parent_title from p left join l on l.clause = {_PARENT}""")
def clause_parent_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return sections.with_parents(spark.sql(_PARTS)).select("document", "clause", "title", "parent_title")


_STEP_LINE = f"(case turn % 5 when 4 then '' else (turn + 1) || {pick('turn % 5', ['. ', 'a. ', '-12b. ', '(A). ', ''])} end) || role || ' speaks here'"
_HEAD = "^(\\d+(?:[a-z]?(?:-\\d+[a-z]?)?|\\([A-Za-z]\\)))\\.\\s+(.+)"


@register(QUERIES, ORACLE_SQL, f"""
with t as (select conv_id as procedure, list({_STEP_LINE} order by turn) as ls from conversations group by 1),
l as (select procedure, generate_subscripts(ls, 1) as line, trim(unnest(ls)) as raw from t),
m as (select *, regexp_matches(raw, '{_HEAD}') as h from l where raw <> ''),
g as (select *, sum(cast(h as int)) over (partition by procedure order by line rows unbounded preceding) as s from m),
a as (select procedure, s, min(line) as line, max(case when h then regexp_extract(raw, '{_HEAD}', 1) end) as number, string_agg(case when h then regexp_extract(raw, '{_HEAD}', 2) else raw end, ' ' order by line) as description from g where s > 0 group by 1, 2),
k as (select *, regexp_matches(number, '^\\d+[a-z]?$') as plain from a)
select procedure, number, description, cast(row_number() over (partition by procedure order by case when plain then cast(regexp_extract(number, '^\\d+') as int) else 999 end, case when not plain then 999 when regexp_extract(number, '[a-z]$') = '' then 0 else ascii(regexp_extract(number, '[a-z]$')) end, line) as integer) as ord from k""")
def step_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").selectExpr("conv_id as procedure", "turn", f"{_STEP_LINE} as line")
    texts = lines.groupBy("procedure").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("ls")).select("procedure", F.array_join("ls.line", "\n").alias("text"))
    return steps.parse(texts).select("procedure", "number", "description", "ord")


_TITLE = f"{pick('p_partkey', ['4.2.2.2.2 ', '4.2 ', '', '5G ', '6.1.3.2.0 '])} || p_name || {pick('p_partkey', [' (x)', ', Xn - based', ''])}"
_NUMBER = pick("p_partkey", ["7-12b", "7(A)", "3", "7a", "7b-12b", "1", "2"])


@register(QUERIES, ORACLE_SQL, f"""
with t as (select p_partkey, title, number, replace(regexp_extract(title, '^(\\d+(?:\\.\\d+)*)\\s', 1), '.', '') as c, replace(regexp_replace(regexp_replace(title, '^\\d+(?:\\.\\d+)*\\s+', ''), '[^\\w\\s]', '', 'g'), ' ', '_') as w,
  case when regexp_matches(number, '^\\d+[a-z]?$') then number when regexp_matches(number, '^\\d+[a-z]?-\\d+[a-z]?$') then replace(number, '-', '_') else regexp_replace(number, '[()]', '', 'g') end as n from (select p_partkey, {_TITLE} as title, {_NUMBER} as number from part)),
m as (select p_partkey, title, number, case when c <> '' then c || '_' else '' end || w || '_step_' || n as name from t)
select p_partkey, title, number, name, coalesce(nullif(regexp_extract(name, '_step_([\\w-]+)$', 1), ''), '1') as back from m""")
def step_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_TITLE} as title", f"{_NUMBER} as number").withColumn("name", steps.step_name(F.col("title"), F.col("number")))
    return t.withColumn("back", steps.number_in_name(F.col("name")))


@register(QUERIES, ORACLE_SQL, """
select doc_id, cast(generate_subscripts(s, 1) - 1 as integer) as sent, unnest(s) as sentence from (select doc_id, string_split_regex(text, '[.!?]') as s from documents)""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("sent", "sentence"))


@register(QUERIES, ORACLE_SQL, """
with c as (select doc_id, substr(text, cast(k * 1024 + 1 as bigint), 1024) as chunk from documents, range(2000) t(k) where k * 1024 < length(text))
select doc_id, count(*) as n, sum(length(chunk)) as chars, md5(min(chunk)) as least from c where length(regexp_replace(chunk, '^\\s+|\\s+$', '', 'g')) >= 10 group by doc_id""")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.chunks("text", 1024)).alias("chunk"))
    return c.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("chunk")).alias("chars"), F.md5(F.min("chunk").cast("binary")).alias("least"))


TITLE_STAND_INS, TEXT_STAND_INS, MARK_STAND_INS = ["the", "tion", "ing", "and"], ["and", "ered", "that", "on ", "with", "eau", "und", "los", "was"], [r"th.*?tion", r"\w+\.\s+a", r"que"]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.split("text", r"\.")[0].alias("title"), (F.pmod("doc_id", F.lit(3)) > 0).alias("has_figure"))
    return classify.score(d, TITLE_STAND_INS, TEXT_STAND_INS, MARK_STAND_INS)


def _count(column: str, words: list[str]) -> str:
    return " + ".join(f"cast(contains({column}, '{w}') as int)" for w in words)


_SCORED = f"""d as (select doc_id, text, lower(text) as low, doc_id % 3 > 0 as fig, lower(trim(regexp_replace(regexp_replace(string_split(text, '.')[1], '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'))) as title from documents),
c as (select *, {_count('low', TEXT_STAND_INS)} as ents, {_count('title', TITLE_STAND_INS)} as tc, {' + '.join(f"cast(regexp_matches(low, '{m}') as int)" for m in MARK_STAND_INS)} as marks from d),
s as (select *, case when fig then 50 else 0 end + least(tc * 7, 20) + least(ents * 2, 20) + least(marks * 3, 15) + case when length(text) > 1000 then 10 when length(text) > 500 then 5 else 0 end as score,
  case when not fig then 80 when length(text) > 5000 then 60 when length(text) > 2000 then 55 when length(text) > 1000 then 50 else 45 end as threshold from c),
f as (select *, not (case when fig then regexp_matches(title, 'overview|introduction|background') and score < threshold + 30 else regexp_matches(title, 'overview|general|architecture|introduction|background|summary') end)
  and length(text) >= 300 and len(list_filter(string_split(title, ' '), lambda x: x <> '')) between 1 and 25 as passed from s),
v as (select doc_id, cast(score as integer) as score, cast(threshold as integer) as threshold, passed, fig, (fig and ents >= 2 and length(text) > 500) or (score >= threshold and passed) as is_procedure from f)"""


@register(QUERIES, ORACLE_SQL, f"with {_SCORED} select doc_id, score, threshold, passed, is_procedure from v")
def procedure_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "score", "threshold", "passed", "is_procedure")


@register(QUERIES, ORACLE_SQL, f"with {_SCORED} select is_procedure, quality, count(*) as n from v join labels l using (doc_id) where fig group by 1, 2")
def procedure_filter_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return _scored(spark, sf_dir).where("has_figure").join(labels, "doc_id").groupBy("is_procedure", "quality").agg(F.count("*").alias("n"))


@register(QUERIES, ORACLE_SQL, f"""
with {_SCORED}, n as (select v.*, l.toxic = 1 as named from v join labels l using (doc_id) where fig)
select count(*) filter (where named) as by_model, count(*) filter (where not named and is_procedure) as by_score from n""")
def identification_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents stand for those that a model names."""
    named = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, F.lit("named")).alias("said"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.split("text", r"\.")[0].alias("title"), (F.pmod("doc_id", F.lit(3)) > 0).alias("has_figure"))
    return classify.routes(d.join(named, "doc_id"), F.col("said"), title_words=TITLE_STAND_INS, text_words=TEXT_STAND_INS, marks=MARK_STAND_INS)


WORDS = ["the", "of", "and", "to", "in", "is", "that", "for", "with", "was", "on", "are", "by", "this", "be", "it", "from", "as", "at", "not"]


@register(QUERIES, ORACLE_SQL, f"select doc_id, word from documents, {word_rows(WORDS)} where regexp_matches(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])' || word || '(?:$|[^\\p{{L}}\\p{{N}}_])')")
def lexicon_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(extract.matches(F.col("text"), WORDS)).alias("word"))


_RUNS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')"


@register(QUERIES, ORACLE_SQL, f"""
with b as (select {_RUNS.format('text')} as ps from benchmark), d as (select doc_id, {_RUNS.format('text')} as ps from documents),
lex as (select distinct array_to_string(ps[i:i + 4], '') as phrase from (select ps, unnest(range(1, len(ps) - 3)) as i from b) where regexp_matches(ps[i], '^[\\p{{L}}\\p{{N}}_]')),
p as (select doc_id, generate_subscripts(ps, 1) as i, unnest(ps) as piece from d),
placed as (select doc_id, piece, sum(length(piece)) over w - length(piece) as before, piece || lead(piece, 1) over w || lead(piece, 2) over w || lead(piece, 3) over w || lead(piece, 4) over w as run from p window w as (partition by doc_id order by i))
select doc_id, phrase, cast(before + 1 as integer) as start from placed join lex on lex.phrase = placed.run where regexp_matches(piece, '^[\\p{{L}}\\p{{N}}_]')""")
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place in documents where three words of a benchmark text stand one after another."""
    b = table(spark, sf_dir, "benchmark").select(F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), F.lit(0)).alias("ps"))
    three = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ps") - 4)), lambda i: (i + 4 <= F.size("ps")) & F.get("ps", i - 1).rlike(r"^[\p{L}\p{N}_]")), lambda i: F.array_join(F.slice("ps", i, F.lit(5)), ""))
    return phrases.hits(table(spark, sf_dir, "documents"), b.select(F.explode(three).alias("phrase")), "doc_id")


_STOP = ", ".join(f"'{w}'" for w in lx.STOP_WORDS)


@register(QUERIES, ORACLE_SQL, f"""
with t as (select doc_id, list_distinct(string_split_regex(text, '[^A-Za-z]+')) as ws from documents),
u as (select doc_id, unnest(ws) as w from t), k as (select doc_id, w, row_number() over (partition by doc_id order by w collate "binary") as rn from u where length(w) > 2 and length(w) <= 50 and lower(w) not in ({_STOP}))
select doc_id, cast(rn - 1 as integer) as pos, w as word from k where rn <= 15""".replace(' collate "binary"', ""))
def lexicon_merge_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", "[^A-Za-z]+")
    d = table(spark, sf_dir, "documents").withColumn("ws", words)
    half = F.floor(F.size("ws") / 2).cast("int")
    return d.select("doc_id", F.posexplode(extract.merged(F.slice("ws", F.lit(1), half + 1), F.slice("ws", half + 1, F.size("ws")))).alias("pos", "word"))


@register(QUERIES, ORACLE_SQL, """
select page_id, unnest(list_distinct(regexp_extract_all(html, '([A-Z][a-z]+ (?:the|of|and|in))', 1))) as hit from pages""")
def message_regex_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.array_distinct(F.regexp_extract_all(F.col("html"), F.lit("([A-Z][a-z]+ (?:the|of|and|in))"), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(hits).alias("hit"))


@register(QUERIES, ORACLE_SQL, f"""
with t as (select lower(unnest(string_split_regex(text, '[^A-Za-z]+'))) as w from documents)
select w as word, count(*) as n from t where w not in ({_STOP}) and length(w) between 2 and 50 group by w""")
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    return w.where(~tx.is_stop_word(F.col("word"), lx.STOP_WORDS, lx.STOP_PHRASES)).groupBy("word").agg(F.count("*").alias("n"))


_CANDIDATE = f"{pick('o_custkey', ['5G-', 'UE-', 'N12-', 'CN-', '', ' '])} || {pick('o_orderkey', ['AMF', 'ausf', 'Smf', 'W-AGF', 'gNB', 'XYZ', *lx.FUNCTION_PHRASES])} || {pick('o_custkey + o_orderkey', ['-function', '-SERVER', '', '-node', ''])}"
_UPPER = ", ".join(f"'{w.upper()}'" for w in lx.NETWORK_FUNCTIONS)
_PHRASES = " ".join(f"when '{k}' then '{v}'" for k, v in lx.FUNCTION_PHRASES.items())


@register(QUERIES, ORACLE_SQL, f"""
with c as (select o_orderkey, candidate, trim(upper(candidate)) as u from (select o_orderkey, {_CANDIDATE} as candidate from orders)),
d as (select *, regexp_replace(u, '^(5G-|UE-|N[0-9]+-|CN-)', '') as h, regexp_replace(u, '(-FUNCTION|-SERVER|-GATEWAY|-NODE)$', '') as t from c)
select o_orderkey, candidate, case when u in ({_UPPER}) then u when h in ({_UPPER}) then h when t in ({_UPPER}) then t else case u {_PHRASES} end end as normal from d""")
def nf_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_CANDIDATE} as candidate")
    return c.withColumn("normal", extract.normal_function(F.col("candidate")))


LIKELY = ["the", "ring", "tion", "UE", "user", "que", "und"]


@register(QUERIES, ORACLE_SQL, f"""
select distinct conv_id, word from conversations, {word_rows(LIKELY)} where exists (select 1 from (select unnest(string_split_regex(text, '[.!?]')) as s) where contains(lower(s), lower(word)) and regexp_matches(lower(s), 'tion|ment|ung'))""")
def validate_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    sents = table(spark, sf_dir, "conversations").select("conv_id", F.explode(tx.sentences(F.col("text"))).alias("s")).where(F.lower("s").rlike("tion|ment|ung"))
    hit = F.filter(F.array(*[F.lit(w) for w in LIKELY]), lambda w: F.lower(F.col("s")).contains(F.lower(w)))
    return sents.select("conv_id", F.explode(hit).alias("word")).distinct()


@register(QUERIES, ORACLE_SQL, """
select conv_id, 'Parent Section: ' || min(role) || '. Procedure: conv_' || conv_id || '. Steps: ' || string_agg(text, ' ' order by turn) as description from conversations group by conv_id""")
def search_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("of"), F.min("role").alias("parent"))
    return c.select("conv_id", extract.search_description(F.col("parent"), F.concat(F.lit("conv_"), F.col("conv_id")), F.col("of.text"), F.lit("")).alias("description"))


@register(QUERIES, ORACLE_SQL, """
select distinct conv_id, turn, unnest(list_filter(string_split_regex(lower(role || ' ' || text || ' step'), '\\s+'), lambda x: x <> '')) as keyword from conversations""")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(tx.keywords(F.col("role"), F.col("text"), F.lit("step"))).alias("keyword"))


NAMED = ["the", "and", "of", "with", "that"]
_KINDS = {"the": "NetworkFunction", "and": "Key", "of": "Message", "with": "Procedure", "that": "Actor"}


@register(QUERIES, ORACLE_SQL, f"""
with w as (select ord, word, case word {' '.join(f"when '{k}' then '{v}'" for k, v in _KINDS.items())} end as kind from {word_rows(NAMED)}),
s as (select doc_id, generate_subscripts(ss, 1) - 1 as sent, unnest(ss) as text from (select doc_id, string_split_regex(text, '[.!?]') as ss from documents)),
p as (select doc_id, sent, a.word as source_name, b.word as target_name, a.kind as x, b.kind as y, lower(text) as low from s, w a, w b where a.ord < b.ord and contains(text, a.word) and contains(text, b.word))
select doc_id as section, cast(sent as integer) as sent, source_name, target_name, case when x = 'Procedure' or y = 'Procedure' then 'PART_OF'
  when (x in ('Key', 'Parameter') and y in ('NetworkFunction', 'Actor')) or (y in ('Key', 'Parameter') and x in ('NetworkFunction', 'Actor')) then case when regexp_matches(low, 'derive|generate|compute') then 'DERIVES' else 'USES' end
  when x = 'Message' or y = 'Message' then case when regexp_matches(low, 'send|transmit|receive') then 'SENDS' else 'CONTAINS' end
  when x in ('NetworkFunction', 'Actor') and y in ('NetworkFunction', 'Actor') then 'INTERACTS_WITH' else 'RELATED_TO' end as rel_type from p""")
def rel_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("section"), "text")
    sents = d.select("section", F.posexplode(tx.sentences(F.col("text"))).alias("sent", "text"))
    listed = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(w).alias("name"), F.lit(_KINDS[w]).alias("entity_type")) for i, w in enumerate(NAMED)])
    return relate.co_occurrence(d.select("section", F.inline(listed)), sents)


_TEMPLATES = [(r"(\w+)\s+of\s+(\w+)", "OF"), (r"(\w+)\s+is\s+(\w+)", "IS"), (r"(\w+)\s+with\s+(\w+)", "WITH")]
_TN = ["the", "and", "on", "th", "it", "is", "of", "was"]


@register(QUERIES, ORACLE_SQL, " union all ".join(f"""
select doc_id as section, z.a as source_name, z.b as target_name, '{t}' as rel_type from (select doc_id, unnest(list_transform(range(1, len(x) + 1), lambda i: {{'a': x[i], 'b': y[i]}})) as z from
  (select doc_id, regexp_extract_all(text, '(?i){p}', 1) as x, regexp_extract_all(text, '(?i){p}', 2) as y from documents)) where z.a in ({', '.join(f"'{w}'" for w in _TN)}) and z.b in ({', '.join(f"'{w}'" for w in _TN)})""" for p, t in _TEMPLATES))
def rel_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("section"), "text", F.array(*[F.lit(w) for w in _TN]).alias("names"))
    return relate.template_pairs(d, templates=_TEMPLATES)


_ANY = ["AMF", "AUSF", "UDM", "XYZ"]
_SENT = f"'The UE checks. ' || {pick('o_custkey', _ANY)} || {pick('o_orderkey', [' sends a ', ' sends an ', ' forwards a '])} || o_orderpriority || ' to the ' || {pick('o_custkey + o_orderkey', _ANY)}"
_DERIVED = f"{pick('o_custkey', ['UDM', 'AMF', 'AUSF'])} || {pick('o_orderkey + o_custkey', [' derives ', ' derives ', ' derived ', ' shall derive ', ' DERIVES ', ' derivation of ', 'X derives '])} || {pick('o_orderkey', ['KAUSF', 'KAMF', 'nothing'])} || ' from ' || {pick('o_custkey + o_orderkey', ['AUTN', 'RAND', 'UDM', 'AMF'])} || '. Nothing here. ' || {pick('o_orderkey', ['AMF derived KAMF', 'a step', 'KAMFs, deriving AUTN for AMF, AUSF deriving KAUSF'])}"
_SN = ["AMF", "AUSF", "UDM", "KAUSF", "KAMF", "AUTN"]


@register(QUERIES, ORACLE_SQL, f"""
with h as (select section, trim(regexp_extract(m, p, 1)) as s, trim(regexp_extract(m, p, 2)) as g, trim(regexp_extract(m, p, 3)) as t from
  (select section, '([A-Z0-9/ -]+)\\s+sends an?\\s+(.+?)\\s+to the\\s+([A-Z0-9/ -]+)' as p, unnest(regexp_extract_all(text, '([A-Z0-9/ -]+)\\s+sends an?\\s+(.+?)\\s+to the\\s+([A-Z0-9/ -]+)')) as m from (select o_orderkey as section, {_SENT} as text from orders))),
k as (select * from h where s in ({', '.join(f"'{w}'" for w in _SN)}) and t in ({', '.join(f"'{w}'" for w in _SN)}))
select section, s as source_name, g as target_name, 'SENDS_TO' as rel_type from k union all select section, g, t, 'IS_SENT_TO' from k union all select section, g, s, 'SENT_BY' from k""")
def rel_sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").selectExpr("o_orderkey as section", f"{_SENT} as text").withColumn("names", F.array(*[F.lit(w) for w in _SN]))
    return relate.sends(t)


def derives_sql(sections: str, names: str) -> str:
    """Rows of ``relate.derives`` with RE2: places are lengths of what comes before. ``names``: section, word."""
    return rf"""
s as (select section, generate_subscripts(ss, 1) - 1 as sent, unnest(ss) as s from (select section, string_split_regex(text, '[.\n]') as ss from {sections})),
v as (select *, length(regexp_extract(s, '(?s)^(.*?)\bderiv(?:es|ed|ing)\b', 1)) + 1 as verb from s where regexp_matches(s, '\bderiv(?:es|ed|ing)\b')),
e as (select v.*, word, length(regexp_extract(s, '(?s)^(.*?)\b' || word || '\b', 1)) + 1 as pos from v join {names} using (section) where regexp_matches(s, '\b' || word || '\b')),
b as (select section, sent, max_by(word, pos) as b from e where pos < verb group by 1, 2), a as (select section, sent, min_by(word, pos) as a from e where pos > verb group by 1, 2), ab as (select * from b join a using (section, sent)),
c as (select ab.section, ab.sent, ab.a, min_by(word, pos) as c from ab join e on e.section = ab.section and e.sent = ab.sent where word <> a and word <> b group by 1, 2, 3),
derived as (select section, cast(sent as integer) as sent, b as source_name, a as target_name, 'DERIVES' as rel_type from ab union all select section, cast(sent as integer), a, c, 'DERIVED_FROM' from c)"""


@register(QUERIES, ORACLE_SQL, f"""
with t as (select o_orderkey as section, {_DERIVED} as text from orders), n as (select section, word from t, {word_rows(_SN)}), {derives_sql('t', 'n')} select * from derived""")
def rel_derives(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").selectExpr("o_orderkey as section", f"{_DERIVED} as text").withColumn("names", F.array(*[F.lit(w) for w in _SN]))
    return relate.derives(t)


@register(QUERIES, ORACLE_SQL, """
select page_id, substr(regexp_replace(regexp_replace(regexp_replace(url, '[<>:"/\\\\|?*]', '_', 'g'), '_+', '_', 'g'), '^[_ ]+|[_ ]+$', '', 'g'), 1, 200) as name from pages""")
def filename_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.file_name(F.col("url")).alias("name"))


@register(QUERIES, ORACLE_SQL, r"""
select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]', '.', 'g'), '[\x{80}-\x{7FF}]', '..', 'g'), '[\x{800}-\x{FFFF}]', '...', 'g'), '[\x{10000}-\x{10FFFF}]', '....', 'g') as text from documents""")
def hex_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.lower(F.hex("text")), "(..)(?=.)", "$1:").alias("hex_payload"))
    return d.select("doc_id", packets.printable("hex_payload").alias("text"))


_MIXED = "case event_id % 6 when 0 then 'GET /x ' || props || ' tail' when 1 then 'x [1, ' || props || '] z' when 2 then 'no json' when 3 then '{' || event_type when 4 then '}' || event_type || '{' else 'x [1, [2], 3] ' || props end"


@register(QUERIES, ORACLE_SQL, f"""
with p as (select id, s, instr(s, '[') as k, instr(s, '{{') as b, instr(s, ']') as e, length(s) - instr(reverse(s), '}}') + 1 as l from (select event_id as id, {_MIXED} as s from events)),
f as (select id, case when k > 0 and (b = 0 or k < b) then substr(s, k, greatest(e - k + 1, 0)) when b > 0 and contains(s, '}}') then substr(s, b, greatest(l - b + 1, 0)) end as j from p)
select id, case when json_valid(j) and j <> '' then j end as payload from f""")
def embedded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id as id", f"{_MIXED} as s").select("id", packets.embedded_json("s").alias("payload"))


@register(QUERIES, ORACLE_SQL, "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_payload_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@register(QUERIES, ORACLE_SQL, """
select event_id, case event_type when 'click' then 'TCP' when 'view' then 'udp' when 'purchase' then 'pfcp' when 'signup' then 'sctp' else 'sctp' end as protocol from events where event_type <> 'error' or user_id % 2 = 0""")
def packet_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = lambda k: F.col("event_type") == k
    layer = packets.dispatch(kind("click"), kind("view"), kind("purchase"), kind("signup"), kind("error") & (F.col("user_id") % 2 == 0))
    rows_ = e.withColumn("layer", layer).where("layer is not null")
    return rows_.select("event_id", packets.transport(F.col("layer"), F.when(kind("click"), "TCP")).alias("protocol"))


@register(QUERIES, ORACLE_SQL, """
with t as (select conv_id, 'step_' || turn || case when turn % 3 = 0 then 'a' when turn % 3 = 1 then '' else '_' || (turn * 7 % 13) end as name, turn from conversations)
select conv_id, name, cast(row_number() over (partition by conv_id order by turn) as integer) as ord from t""")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    name = F.concat(F.lit("step_"), F.col("turn"), F.when(F.col("turn") % 3 == 0, "a").when(F.col("turn") % 3 == 1, "").otherwise(F.concat(F.lit("_"), (F.col("turn") * 7 % 13).cast("string"))))
    rows_ = t.withColumn("name", name)
    return rows_.select("conv_id", "name", F.row_number().over(Window.partitionBy("conv_id").orderBy(tx.natural_key("name"))).alias("ord"))


@register(QUERIES, ORACLE_SQL, r"""
with w as (select doc_id, list_transform(list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}\s_''-]+', ' | ', 'g'), '\s+'), lambda x: x <> ''), lambda x: case when x = '|' then '' else x end) as ws from documents where text is not null),
u as (select doc_id, generate_subscripts(x, 1) as i, unnest(x) as a from (select doc_id, list_concat([''], ws, ['']) as x from w)),
p as (select lag(a) over o as before, a, lead(a) over o as b, lead(a, 2) over o as after from u window o as (partition by doc_id order by i)),
n as (select a, b, count(*) as n, count(distinct before) as lefts, count(distinct after) as rights from p where a <> '' and b <> '' group by a, b),
m as (select a as w, count(*) as m from u where a <> '' group by a), t as (select sum(m) as total from m)
select n.a, n.b, n, lefts, rights, round(log2(n * cast(total as double) / x.m / y.m), 6) as pmi from n join m x on x.w = n.a join m y on y.w = n.b, t
where n >= 5 and lefts >= 3 and rights >= 3 and log2(n * cast(total as double) / x.m / y.m) >= 3""")
def phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.collocations(table(spark, sf_dir, "documents")).withColumn("pmi", F.round("pmi", 6))


@register(QUERIES, ORACLE_SQL)
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents by a public vocabulary; tests hold them against the texts and the tokenizer."""
    rows = chunks.chunked(table(spark, sf_dir, "documents"), "doc_id", most=256)
    return rows.select("doc_id", "chunk", "start", "length", "tokens", F.md5(F.col("text").cast("binary")).alias("text_md5"))
