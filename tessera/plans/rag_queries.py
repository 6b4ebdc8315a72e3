"""Registered plans around a language model, with made-up replies in the model's place, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import context, graph, rag, training
from ..sources.fixtures import CHAIN_SQL, EDGE_SQL, Tables, chains, nodes

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_SCOPES, _ASKED = ("hadith", "quran", "both"), ("narrator_info", "count", "teachers", "content", "guess")


@query(
    f"""with q as (select event_id as id, {list(_SCOPES)}[event_id % 3 + 1] as scope, {list(_ASKED)}[event_id % 5 + 1] as intent, case when event_id % 7 = 0 then '' else 'Supplier#' || lpad((user_id * 2)::varchar, 9, '0') end as name from events),
 k as (select *, case when intent in ('narrator_info', 'count', 'narrator_hadiths', 'teachers', 'students', 'chain') and name <> '' then intent else 'content' end as known from q),
 r as (select k.*, s_suppkey as node from k left join supplier on s_name = name)
 select id, case when scope <> 'quran' and known <> 'content' and node is not null then known else 'semantic ' || scope end as plan, case when scope <> 'quran' and known <> 'content' then node end as node from r"""
)
def routed_questions(spark, sf_dir):
    """Replies about intents turned to plans: structured where the person is known, else semantic search of the scope."""
    t = Tables(spark, sf_dir)
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("event_id") % n).cast("int"))
    name = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.format_string("Supplier#%09d", F.col("user_id") * 2))
    rows = t.events.select(F.col("event_id").alias("id"), pick(_SCOPES, 3).alias("scope"), F.to_json(F.struct(pick(_ASKED, 5).alias("intent"), name.alias("name"))).alias("reply"))
    parsed = context.parse_intent(F.col("reply"))
    asked = rows.select("id", "scope", parsed["intent"].alias("intent"), parsed["name"].alias("name"))
    return rag.route(asked, t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("node")))


@query(
    f"""with {EDGE_SQL}, p as (select distinct src, dst from edge), v as (select node, count(distinct variant) as n from chain group by node), te as (select src as node, count(*) as n from p group by src), st as (select dst as node, count(*) as n from p group by dst)
 select node.id as node, '## ' || name || chr(10) || 'Generation: ' || gen || chr(10) || 'Records: ' || coalesce(v.n, 0) || chr(10) || 'Teachers: ' || coalesce(te.n, 0) || chr(10) || 'Students: ' || coalesce(st.n, 0) as context
 from node left join v on v.node = node.id left join te on te.node = node.id left join st on st.node = node.id"""
)
def node_contexts(spark, sf_dir):
    """What is known of each node as the context of an answer."""
    t = Tables(spark, sf_dir)
    c = chains(t)
    one = graph.chain_edges(c).select("src", "dst").distinct()
    degree = c.groupBy("node").agg(F.count_distinct("variant").alias("variants"))
    degree = degree.join(one.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("teachers")), "node", "full").join(one.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("students")), "node", "full")
    return rag.node_info(nodes(t), degree)


@query(
    f"""with {CHAIN_SQL}, m as (select distinct node, variant from chain), r as (select *, count(*) over (partition by node) as total, row_number() over (partition by node order by variant) as place from m),
 s as (select r.node, place, total, 'Hadith #' || variant || chr(10) || repeat(o_orderpriority || ' ', 3) || chr(10) || chr(10) as entry from r join orders on o_orderkey = variant where place <= 10)
 select node, 'Showing ' || count(*) || ' of ' || any_value(total) || ' total hadiths:' || chr(10) || chr(10) || string_agg(entry, '' order by place) as context from s group by node"""
)
def node_samples(spark, sf_dir):
    """Each node's first ten records under how many there are."""
    t = Tables(spark, sf_dir)
    members = chains(t).select("node", F.col("variant").alias("id")).distinct()
    records = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("number"), F.repeat(F.concat("o_orderpriority", F.lit(" ")), 3).alias("text"))
    return rag.node_records(members, records)


_CUT = "case when length(text) > 1000 then substr(text, 1, 1000) || '...' else text end"


@query(
    f"""with a as (select source as question, 0 as place, row_number() over (partition by source order by n_chars desc, doc_id) as rank, lang as title, text from documents),
 b as (select 'src' || conv_id % 40 as question, 1 as place, row_number() over (partition by conv_id % 40 order by conv_id, turn) as rank, role as title, text from conversations),
 u as (select * from a union all select * from b), m as (select *, count(distinct place) over (partition by question) as places from u)
 select question, md5(string_agg('[' || place + 1 || '.' || rank || '] ' || title || chr(10) || {_CUT}, chr(10) || chr(10) order by place, rank)) as context, count(*) as entries from m where rank <= case when places = 2 then 4 else 6 end group by question"""
)
def unified_contexts(spark, sf_dir):
    """Two sources as one context: four entries of each, or six of one alone."""
    t = Tables(spark, sf_dir)
    rank = lambda key, *order: F.row_number().over(Window.partitionBy(key).orderBy(*order))
    a = t.documents.select(F.col("source").alias("question"), rank("source", F.desc("n_chars"), "doc_id").alias("rank"), F.col("lang").alias("title"), "text")
    question = F.concat(F.lit("src"), (F.col("conv_id") % 40).cast("string"))
    b = t.conversations.withColumn("question", question).select("question", rank("question", "conv_id", "turn").alias("rank"), F.col("role").alias("title"), "text")
    rows = rag.unified_context(a, b)
    counts = a.where("rank <= 6").groupBy("question").agg(F.count("*").alias("a")).join(b.where("rank <= 6").groupBy("question").agg(F.count("*").alias("b")), "question", "full")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    entries = F.when(both, F.least("a", F.lit(4)) + F.least("b", F.lit(4))).otherwise(F.coalesce("a", "b"))
    return rows.join(counts, "question").select("question", F.md5(F.col("context").cast("binary")).alias("context"), entries.alias("entries"))


_CHAPTERS = "ch as (select source as book, doc_id as line, row_number() over (partition by source order by doc_id) - 1 as place from documents where n_chars % 3 = 0)"
_REPLIES = "rp as (select page_id as question, 'src' || page_id % 20 as book, [page_id, page_id * 3 % 200, page_id % 50, 7] as lines, [page_id * 7 % 200, page_id % 90] as again from pages)"
_CHOSEN = """v as (select question, book, unnest(lines[1:3]) as line, generate_subscripts(lines[1:3], 1) - 1 as place, 0 as step from rp union all select question, book, unnest(again[1:3]), generate_subscripts(again[1:3], 1) - 1, 1 from rp),
 hit as (select question, line, min(place) as place, step from v where exists (select 1 from ch where ch.book = v.book and ch.line = v.line) group by question, line, step
 union all select question, line, ch.place, 2 from rp join ch using (book) where ch.place < 2),
 chosen as (select question, line as chapter, place from (select *, min(step) over (partition by question) as best from hit) where step = best)"""


def _navigation(t: Tables):
    d, p = t.documents, t.pages
    place = F.row_number().over(Window.partitionBy("book").orderBy("line")) - 1
    chapters = d.where("n_chars % 3 = 0").select(F.col("source").alias("book"), F.col("doc_id").alias("line")).withColumn("place", place)
    i = F.col("page_id")
    book = F.concat(F.lit("src"), (i % 20).cast("string"))
    replies = p.select(i.alias("question"), book.alias("book"), F.array(i, i * 3 % 200, i % 50, F.lit(7).cast("bigint")).alias("lines"), F.array(i * 7 % 200, i % 90).alias("again"))
    return chapters, replies


def _questions(t: Tables):
    """Pages as questions to the book of their number, and the books' chapters with titles."""
    chapters, replies = _navigation(t)
    titled = chapters.withColumn("title", F.format_string("heading %d", "line"))
    return replies.select("question", "book", F.col("question").cast("string").alias("text")), titled


@query(f"with {_CHAPTERS}, {_REPLIES}, {_CHOSEN} select question, chapter, place from chosen")
def navigate_chapters(spark, sf_dir):
    """Chapters of a book for each question: a reply's, or the second reply's, or the first two."""
    return rag.choose_chapters(*_navigation(Tables(spark, sf_dir)))


def _guess(prompt: str) -> str:
    """Stands for a model: picks by arithmetic, is at a loss when asked loosely about every third question and fails on every fifth."""
    question = int(re.search(r"Question: (\d+)", prompt)[1])
    lines = [int(x) for x in re.findall(r"(?m)^(\d+): ", prompt)]
    if prompt.startswith("Question") and question % 5 == 0:
        raise RuntimeError("no answer")
    if prompt.startswith("Question") and question % 3 == 0 or question % 15 == 7:
        return "I can not tell"
    return str([x for x in lines if (x + question) % 7 == 0])


_NAVIGATED = f"""{_CHAPTERS}, q as (select page_id as question, 'src' || page_id % 20 as book from pages),
 seen as (select book, line, place from (select *, sum(strlen(line::varchar) + 11 + strlen(line::varchar)) over (partition by book order by line) as until from ch) where until <= 25000),
 picks as (select question, q.book, seen.line, row_number() over (partition by question order by seen.line) as nth from q join seen using (book) where (seen.line + question) % 7 = 0 and question % 15 <> 7),
 told as (select question, min(line) as found from picks where nth <= 3 group by question),
 calls as (select question, 0 as stage, case when question % 5 = 0 then 'failed' when question % 3 = 0 or question % 15 = 7 then 'none' when told.question is null then 'none' else 'sound' end as result from q left join told using (question)),
 again as (select question, 1, case when told.question is null then 'none' else 'sound' end from calls left join told using (question) where result <> 'sound'),
 result as (select question, line as chapter, nth - 1 as place from picks where nth <= 3 union all select q.question, ch.line, ch.place from q join ch using (book) where ch.place < 2 and q.question not in (select question from told))"""


@query(f"with {_NAVIGATED} select question, chapter, place from result")
def navigated(spark, sf_dir):
    """Chapters that a stand-in for a model picks for each question, asked a second time where it failed or named none."""
    return rag.navigate(*_questions(Tables(spark, sf_dir)), _guess)[0]


@query(f"with {_NAVIGATED}, every as (select * from calls union all select * from again) select stage, result, count(*) as calls from every group by all")
def navigation_calls(spark, sf_dir):
    """How the calls of each stage went: the second stage asks the questions alone that the first left open."""
    questions, chapters = _questions(Tables(spark, sf_dir))
    chosen, told = rag.navigate(questions, chapters, _guess)
    first = F.slice(fx.line_numbers(F.col("reply")), 1, 3)  # the lines that navigate goes by
    named = told.select("question", "stage", "reason", F.explode_outer(first).alias("line")).join(questions.select("question", "book").hint("merge"), "question")
    named = named.join(chapters.select("book", "line", F.lit(True).alias("_is")), ["book", "line"], "left")
    per = named.groupBy("question", "stage").agg(F.max(F.col("reason").isNotNull()).alias("failed"), F.max(F.coalesce("_is", F.lit(False))).alias("sound"))
    result = F.when(F.col("failed"), "failed").when(F.col("sound"), "sound").otherwise("none")
    return per.groupBy("stage", result.alias("result")).agg(F.count("*").alias("calls"))


@query(
    f"""with {_CHAPTERS}, {_REPLIES}, {_CHOSEN}, sec as (select line as chapter, line + i as line from ch, (select unnest(range(1, 6)) as i)),
 rr as (select question, chapter, unnest([{{a: chapter + 1, b: chapter + 40}}, {{a: chapter + 3, b: 0}}, {{a: chapter + 9, b: chapter + 90}}, {{a: chapter + 2, b: chapter + 9}}][1:3]) as r, unnest([0, 1, 2]) as i from chosen where (question + chapter) % 3 <> 0),
 ok as (select question, chapter, r.a as start, r.b as stop, i from rr where exists (select 1 from sec where sec.chapter = rr.chapter and sec.line = rr.r.a)),
 al as (select c.question, c.place as p, c.chapter, i, coalesce(start, c.chapter) as start, case when start is null then c.chapter + 500 when stop <= start then start + 200 else stop end as stop from chosen c left join ok using (question, chapter)),
 n as (select *, row_number() over (partition by question order by p, chapter, i nulls first) as place from al)
 select question, start, stop, cast(place as int) as place from n where place <= 5"""
)
def navigate_sections(spark, sf_dir):
    """Line ranges in the chosen chapters, checked against their sections, five at most."""
    chapters, replies = _navigation(Tables(spark, sf_dir))
    chosen = rag.choose_chapters(chapters, replies)
    sections = chapters.select(F.col("line").alias("chapter"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.col("line") + i)).alias("line"))
    c = F.col("chapter")
    pair = lambda a, b: F.struct(a.cast("bigint").alias("start"), b.cast("bigint").alias("stop"))
    told = chosen.where("(question + chapter) % 3 <> 0").select(
        "question", "chapter", F.array(pair(c + 1, c + 40), pair(c + 3, F.lit(0)), pair(c + 9, c + 90), pair(c + 2, c + 9)).alias("ranges")
    )
    return rag.choose_sections(chosen, sections, told)


@query(
    """with l as (select source as book, doc_id as line, 'heading ' || doc_id as title, case when n_chars % 4 <> 0 then lang end as text from documents),
 r as (select distinct page_id as question, 'src' || page_id % 20 as book, page_id % 997 as start, page_id % 997 + page_id % 9 as stop from pages),
 h as (select r.*, line, title, text from r join l on l.book = r.book and line between start and stop where text is not null), e as (select * from r where not exists (select 1 from h where h.question = r.question)),
 w as (select e.*, line, title, text from e join l on l.book = e.book and line between greatest(start - 200, 0) and stop + 200 where text is not null)
 select distinct question, book, line, title, text from (select * from h union all select * from w)"""
)
def sections_in_range(spark, sf_dir):
    """Lines with a text in each question's range, which is widened where it has none."""
    t = Tables(spark, sf_dir)
    lines = t.documents.select(F.col("source").alias("book"), F.col("doc_id").alias("line"), F.format_string("heading %d", "doc_id").alias("title"), F.when(F.col("n_chars") % 4 != 0, F.col("lang")).alias("text"))
    i = F.col("page_id")
    ranges = t.pages.select(i.alias("question"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("book"), (i % 997).alias("start"), (i % 997 + i % 9).alias("stop"))
    return rag.sections_in(ranges, lines)


@query(
    """with w as (select source, string_agg('--- [' || lang || '] (line ' || doc_id || ') ---' || chr(10) || text || chr(10) || chr(10), '' order by doc_id) as whole from documents group by source)
 select source, strlen(whole) as bytes, md5(case when strlen(whole) <= 25000 then whole else left(whole, list_max(list_filter(range(6250, 25001), lambda n: strlen(left(whole, n)) <= 25000))) || chr(10) || '... (content truncated)' || chr(10) end) as context from w"""
)
def answer_contexts(spark, sf_dir):
    """Excerpts of each source as one context of at most 25,000 bytes."""
    rows = Tables(spark, sf_dir).documents.select("source", F.col("doc_id").alias("line"), F.col("lang").alias("title"), "text")
    return rag.answer_context(rows, "source").select("source", "bytes", F.md5(F.col("context").cast("binary")).alias("context"))


@query(
    """with r as (select conv_id as question, turn as book, case when turn % 3 = 1 then text else ' ' end as overview, turn % 5 = 4 as failed from conversations), e as (select conv_id as question, turn as book, role <> 'user' as kept from conversations)
 select question, arg_min(overview, book) filter (where trim(overview) <> '') as overview, any_value(n.entries) as entries, any_value(n.dropped) as dropped, count(*) filter (where failed) as failed
 from r join (select question, count(*) filter (where kept) as entries, count(*) filter (where not kept) as dropped from e group by question) n using (question) group by question"""
)
def merged_extracts(spark, sf_dir):
    """Replies of several books as one: the first overview with anything in it, and counts of entries kept and dropped."""
    c = Tables(spark, sf_dir).conversations
    key = (F.col("conv_id").alias("question"), F.col("turn").alias("book"))
    replies = c.select(*key, F.when(F.col("turn") % 3 == 1, F.col("text")).otherwise(" ").alias("overview"), (F.col("turn") % 5 == 4).alias("failed"))
    return rag.merge_extracts(replies, c.select(*key, F.when(F.col("role") == "user", "quote not found").alias("reason")))


@query(
    """with s as (select conv_id as question, '[{"turns":' || count(*) || '}]' as sources, max(turn) as last from conversations group by conv_id)
 select question, 0 as seq, 'event: sources' || chr(10) || 'data: ' || sources || chr(10) || chr(10) as event from s union all
 select conv_id, turn + 1, 'data: ' || to_json({text: role || ' ' || turn}) || chr(10) || chr(10) from conversations union all
 select question, last + 2, case when question % 4 = 0 then 'event: error' || chr(10) || 'data: {"error":"timeout"}' || chr(10) || chr(10) else 'event: done' || chr(10) || 'data: {}' || chr(10) || chr(10) end from s"""
)
def answer_events(spark, sf_dir):
    """The events of streamed answers: sources, text as it came, and the end."""
    c = Tables(spark, sf_dir).conversations
    sources = c.groupBy(F.col("conv_id").alias("question")).agg(F.format_string('[{"turns":%d}]', F.count("*")).alias("sources"))
    deltas = c.select(F.col("conv_id").alias("question"), F.col("turn").alias("place"), F.concat("role", F.lit(" "), F.col("turn").cast("string")).alias("text"))
    ends = sources.select("question", F.when(F.col("question") % 4 == 0, "timeout").alias("error"))
    return rag.event_stream(sources, deltas, ends)


_SPLIT = "case when cast(('0x' || substr(md5('42:' || key), 1, 6)) as bigint) % 10 = 0 then 'valid' else 'train' end"


@query(
    f"""with {CHAIN_SQL}, own as (select variant, string_agg(name || ' (generation ' || chain.gen || ')', ', then ' order by pos) as path, count(*) as n from chain join node on node.id = chain.node group by variant),
 fam as (select family, count(distinct variant) as variants, count(distinct node) as nodes from chain group by family having count(distinct variant) > 1),
 turn as (select conv_id, turn, role, text, lead(text) over (partition by conv_id order by turn) as answer from conversations),
 x as (select 'terminology' as category, 't' || t.i || '_' || q.j as key, replace(q.question, '#', term) as question, meaning as answer from (values (0, 'mutawatir', 'At least ten nodes in every generation.'), (1, 'mashhur', 'At least three nodes in every generation.'), (2, 'aziz', 'At least two nodes in every generation.'), (3, 'gharib', 'One node in some generation.')) as t(i, term, meaning), (values (0, 'What is #?'), (1, 'Define #.')) as q(j, question)
 union all select 'chain', 'c' || variant, 'Describe the chain of record ' || variant || '.', 'The chain has ' || n || ' places: ' || path || '.' from own
 union all select 'structure', 's' || family, 'How widely is family ' || family || ' handed down?', 'Family ' || family || ' has ' || variants || ' variants through ' || nodes || ' nodes.' from fam
 union all select 'retrieval', 'r' || conv_id || '_' || turn, 'Context:' || chr(10) || substr(text, 1, 300) || chr(10) || chr(10) || 'What follows?', answer from turn where role = 'user' and answer is not null
 union all select 'commentary', 'v' || doc_id, 'Explain passage ' || doc_id || '.', array_to_string(list_filter(string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' '), lambda w: w <> '')[1:500], ' ') from documents
 union all select 'cross', 'x' || d.doc_id, 'Which label does passage ' || d.doc_id || ' of ' || source || ' have?', 'Quality ' || quality || ', toxicity ' || toxic || '.' from documents d join labels l using (doc_id))
 select category, key, {_SPLIT} as split, md5(question) as question, md5(answer) as answer from x"""
)
def training_categories(spark, sf_dir):
    """Question and answer pairs of six kinds in one reproducible split."""
    t = Tables(spark, sf_dir)
    c = chains(t)
    named = c.join(nodes(t).select(F.col("id").alias("node"), "name"), "node")
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = t.conversations.select("conv_id", "turn", "role", "text", F.lead("text").over(w).alias("answer")).where("role = 'user' and answer is not null")
    parts = {
        "terminology": training.terminology(spark),
        "chain": training.chain_pairs(named),
        "structure": training.structure_pairs(c),
        "retrieval": training.retrieval_pairs(turns.select(F.concat_ws("_", "conv_id", "turn").alias("id"), F.col("text").alias("context"), "answer")),
        "commentary": training.commentary_pairs(t.documents.select(F.col("doc_id").alias("id"), "text"), 500),
        "cross": training.label_pairs(t.documents.join(t.labels, "doc_id").select(F.col("doc_id").alias("id"), "source", "quality", "toxic")),
    }
    rows = training.with_split(parts)
    return rows.select("category", "key", "split", F.md5(F.col("question").cast("binary")).alias("question"), F.md5(F.col("answer").cast("binary")).alias("answer"))
