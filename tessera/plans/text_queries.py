"""Registered text, verification and context queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import align, context, diff, tree, verify, words
from ..sources.fixtures import Tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Names for the normalisers: the fixtures' tables hold no Arabic.
NAMES = ("أَبِي هُرَيْرَةَ", "أبى هريرة", "هشام بن عروة بن الزبير", "ابي", "فاطمة  الزهراء", "مُحَمَّدٌ ـــ رسول", "123 ابن عمر!", "امي سلمة", "")


_LIST = "[" + ", ".join(f"'{v}'" for v in NAMES) + "]"
_VALUES = f"(select doc_id as id, {_LIST}[doc_id % 9 + 1] || ' ' || {_LIST}[doc_id // 9 % 9 + 1] as text from documents) as t"
_FOLDED = "translate(regexp_replace(text, '[ً-ٰٟـؐ-ؚ]', '', 'g'), 'أإآٱةى', 'ااااهي')"
_CLEAN = f"trim(regexp_replace(regexp_replace({_FOLDED}, '[^ؠ-ي ]', '', 'g'), '\\s+', ' ', 'g'))"


@query(
    f"""with n as (select id, text, {_CLEAN} as c, regexp_replace({_FOLDED}, '[^ؠ-ي]', '', 'g') as spaceless from {_VALUES}),
 w as (select *, string_split(c, ' ') as ws from n)
 select id, array_to_string(list_transform(ws, lambda x, i: case when i < len(ws) and x in ('ابي', 'ابى', 'ابا') then 'ابو' when i < len(ws) and x in ('امي', 'اما') then 'ام' else x end), ' ') as name,
 spaceless, c as plain, replace(array_to_string(list_transform(ws, lambda x, i: case when i < len(ws) and x in ('ابي', 'ابى', 'ابا') then 'ابو' when i < len(ws) and x in ('امي', 'اما') then 'ام' else x end), ' '), ' ', '_') as slug from w"""
)
def arabic_normalise(spark, sf_dir):
    """Names of two parts, the forms of which follow from the document's id."""
    part = lambda i: F.get(F.array(*map(F.lit, NAMES)), (i % len(NAMES)).cast("int"))
    i = F.col("doc_id")
    rows = Tables(spark, sf_dir).documents.select(i.alias("id"), F.concat_ws(" ", part(i), part(F.floor(i / len(NAMES)))).alias("text"))
    t = F.col("text")
    return rows.select("id", fx.normalize_name(t).alias("name"), fx.normalize_spaceless(t).alias("spaceless"), fx.strip_diacritics(t).alias("plain"), fx.name_slug(t).alias("slug"))


@query(
    """select page_id, replace(regexp_replace(html, '<[^>]*(>|$)', '', 'g'), '>', '') as plain, length(html) as size from pages""".replace(
        "as plain, length(html) as size", "as plain"
    )
)
def strip_tags(spark, sf_dir):
    return Tables(spark, sf_dir).pages.select("page_id", fx.strip_tags(F.col("html")).alias("plain"))


_DECODE = "replace(replace(replace(replace(replace(replace({0}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&#x27;', '''')"


@query(
    f"""with p as (select page_id, url, nullif(regexp_extract(html, '<meta[^>]+property="og:title"[^>]+content="([^"]*)"', 1), '') as og, nullif(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1), '') as ti from pages)
 select page_id, {_DECODE.format('coalesce(og, ti)')} as title, nullif(regexp_extract(url, '^https?://([^/]*)', 1), '') as domain from p"""
)
def link_preview(spark, sf_dir):
    t = Tables(spark, sf_dir)
    title = F.coalesce(fx.open_graph(F.col("html"), "og:title"), fx.html_title(F.col("html")))
    return t.pages.select("page_id", title.alias("title"), fx.domain(F.col("url")).alias("domain"))


_SPLIT = "list_filter(string_split(regexp_replace({0}, '\\s+', ' ', 'g'), ' '), lambda w: w <> '')"


@query(
    f"""with p as (select conv_id, turn, {_SPLIT.format('text')} as b, lag({_SPLIT.format('text')}) over (partition by conv_id order by turn) as a from conversations)
 select conv_id, turn, round(case when len(a) + len(b) = 0 then 1.0 when len(a) * len(b) > 120000 then 0.0 else 2.0 * list_reduce(a, lambda prev, w:
 list_reduce(b, lambda acc, x: list_append(acc, greatest(acc[len(acc)], prev[len(acc) + 1], prev[len(acc)] + (w = x)::int)), [0]), list_transform(range(len(b) + 1), lambda z: 0))[-1] / (len(a) + len(b)) end::double, 6) as ratio
 from p where a is not null"""
)
def lcs_ratio(spark, sf_dir):
    """Each turn of a conversation against the turn before."""
    t = Tables(spark, sf_dir)
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.select("conv_id", "turn", "text").withColumn("before", F.lag("text").over(w)).where("before is not null")
    return rows.select("conv_id", "turn", F.round(diff.similarity(F.col("before"), F.col("text")), 6).alias("ratio"))


_RUNS = """select conv_id, turn, string_agg(kind || ' ' || words, '|' order by run) as side from (select conv_id, turn, kind, run, string_agg(word, ' ' order by pos) as words
 from (select *, sum(new) over (partition by conv_id, turn order by pos) as run from (select *, case when kind = lag(kind) over (partition by conv_id, turn order by pos) then 0 else 1 end as new from {0})) group by all) group by all"""


@query(
    f"""with recursive p as (select conv_id, turn, {_SPLIT.format('text')} as b, lag({_SPLIT.format('text')}) over (partition by conv_id order by turn) as a from conversations),
 q as (select *, len(a) as n, len(b) as m from p where a is not null),
 dp as (select *, list_reduce(a, lambda acc, w: list_append(acc, list_reduce(b, lambda r, x: list_append(r, case when x = w then acc[len(acc)][len(r)] + 1 else greatest(acc[len(acc)][len(r) + 1], r[len(r)]) end), [0])), [list_transform(range(m + 1), lambda z: 0)]) as g from q),
 line as (select conv_id, turn, a, b, unnest(g) as r, generate_subscripts(g, 1) - 1 as i from dp), cell as (select conv_id, turn, i, unnest(r) as v, generate_subscripts(r, 1) - 1 as j, a[i] as x, b from line),
 way as (select c.conv_id, c.turn, c.i, c.j, case when c.i > 0 and c.j > 0 and c.x = c.b[c.j] then 'unchanged' when c.j > 0 and (c.i = 0 or l.v >= u.v) then 'add' else 'delete' end as kind, case when c.i > 0 then c.x end as left_word, case when c.j > 0 then c.b[c.j] end as right_word
 from cell c left join cell l on l.conv_id = c.conv_id and l.turn = c.turn and l.i = c.i and l.j = c.j - 1 left join cell u on u.conv_id = c.conv_id and u.turn = c.turn and u.i = c.i - 1 and u.j = c.j where c.i + c.j > 0),
 walk as (select conv_id, turn, n as i, m as j from q union all
 select walk.conv_id, walk.turn, case when kind = 'add' then walk.i else walk.i - 1 end, case when kind = 'delete' then walk.j else walk.j - 1 end from walk join way using (conv_id, turn, i, j)),
 step as (select way.* from walk join way using (conv_id, turn, i, j)),
 lf as (select conv_id, turn, i as pos, left_word as word, kind from step where kind <> 'add'),
 rg as (select conv_id, turn, j as pos, right_word as word, kind from step where kind <> 'delete')
 select q.conv_id, q.turn, coalesce(l.side, '') as before, coalesce(r.side, '') as after from q left join ({_RUNS.format('lf')}) l using (conv_id, turn) left join ({_RUNS.format('rg')}) r using (conv_id, turn)"""
)
def lcs_segments(spark, sf_dir):
    """Each turn and the one before as runs of unchanged and other words."""
    t = Tables(spark, sf_dir)
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.select("conv_id", "turn", "text").withColumn("before", F.lag("text").over(w)).where("before is not null")
    d = rows.select("conv_id", "turn", diff.diff_segments(F.col("before"), F.col("text")).alias("d"))
    side = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(" ", s["kind"], s["text"])), "|")
    return d.select("conv_id", "turn", side("d.left").alias("before"), side("d.right").alias("after"))


@query(
    """with q as (select doc_id, text, (select min(text) from benchmark) as any_item from documents), n as (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from documents)
 select item_id, count(doc_id) as documents from benchmark left join n on contains(t, trim(regexp_replace(benchmark.text, '\\s+', ' ', 'g'))) group by item_id"""
)
def quote_verify(spark, sf_dir):
    """For each benchmark text the number of documents that hold it verbatim.

    The benchmark is a stated query set; an item meets the documents that have its longest inner word, and one
    without such a word (of two words or fewer) those that have a word which it can stand in or begin with.
    """
    t = Tables(spark, sf_dir)
    items = t.benchmark.select("item_id", fx.normalize_quote(F.col("text")).alias("fragment")).withColumn("_w", align.inner_word(F.col("fragment")))
    docs = t.documents.select("doc_id", fx.normalize_quote(F.col("text")).alias("text"))
    own = align.words_of(docs, "doc_id")
    near = own.join(items.where("_w is not null"), "_w").select("item_id", "doc_id", "fragment")
    short = align.short_hits(own, items.where("_w is null and fragment <> ''").drop("_w")).select("item_id", "doc_id", "fragment")
    near = near.unionAll(short).distinct().join(docs, "doc_id").where(verify.quote_is_verbatim(F.col("fragment"), F.col("text")))
    hits = near.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"))
    # an empty item stands in every text
    every = items.where("fragment = ''").select("item_id").crossJoin(F.broadcast(docs.where("text is not null").agg(F.count("*").alias("documents"))))
    return items.select("item_id").join(hits.unionAll(every), "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0).cast("bigint")).alias("documents"))


@query(
    """with x as (select doc_id, source as book, doc_id as page, case when lang = 'fr' then 'no such words here' else substr(text, 11, 40) end as quote from documents), a as (select distinct source as book from documents where source <> 'src3')
 select x.doc_id, case when a.book is null then 'book not allowed' when l.doc_id is null then 'no such page' when trim(regexp_replace(x.quote, '\\s+', ' ', 'g')) = '' or not contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(x.quote, '\\s+', ' ', 'g'))) then 'quote not found' end as reason
 from x left join a using (book) left join labels l on l.doc_id = x.page left join documents d on d.doc_id = l.doc_id"""
)
def extract_validate(spark, sf_dir):
    """Extracts from allowed books, existing pages (the labelled documents) and with verbatim quotes."""
    t = Tables(spark, sf_dir)
    quote = F.when(F.col("lang") == "fr", "no such words here").otherwise(F.substring("text", 11, 40))
    extracts = t.documents.select("doc_id", F.col("source").alias("book"), F.col("doc_id").alias("page"), quote.alias("quote"))
    allowed = t.documents.select(F.col("source").alias("book")).distinct().where("book <> 'src3'")
    pages = t.documents.join(t.labels.select("doc_id"), "doc_id").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "text")
    return verify.validate_extracts(extracts, allowed, pages).select("doc_id", "reason")


@query(
    """with a as (select event_id as id, 'As hadith ' || user_id || ' and number #' || event_id || ' say' as text from events), w as (select id, text, unnest(string_split(text, ' ')) as word from a),
 n as (select *, try_cast(regexp_extract(word, '^[^0-9]*([0-9]+)[^0-9]*$', 1) as bigint) as number, instr(text, word) as spot from w),
 c as (select id, number, lower(substr(text, greatest(spot - 10, 1), least(spot - 1, 10))) as before from n where number > 0 and number < 10000)
 select distinct id, number from c where (contains(before, 'hadith') or contains(before, '#') or contains(before, 'number')) and not exists (select 1 from events e where e.event_id = c.id and e.user_id = c.number)"""
)
def unverified_refs(spark, sf_dir):
    """References in made-up answers that their contexts don't hold."""
    t = Tables(spark, sf_dir)
    text = F.concat(F.lit("As hadith "), F.col("user_id").cast("string"), F.lit(" and number #"), F.col("event_id").cast("string"), F.lit(" say"))
    answers = t.events.select(F.col("event_id").alias("id"), text.alias("text"))
    known = t.events.select(F.col("event_id").alias("id"), F.col("user_id").cast("bigint").alias("number"))
    return verify.unverified_references(answers, known)


#: What the flags are tried on: each event's type with something before or behind it.
MADE_UP = ("{0}", "fake_{0}", "Auto_{0}", "unfake", "N/A", "Unknown", "a {0} forged by hand", "auto{0}", "test {0}", "dummy_", "none of {0}")


@query(
    "select event_id, text, lower(text) in ('null', 'undefined', 'n/a', 'none', 'unknown') or regexp_matches(lower(text), '^(synthetic|placeholder|fake|test|dummy|generated|auto)_') or regexp_matches(lower(text), 'fake|fabricat|forged') as made_up from (select event_id, case event_id % 11 "
    + " ".join(f"when {i} then '" + v.replace("{0}", "' || event_type || '") + "'" for i, v in enumerate(MADE_UP))
    + " end as text from events)"
)
def synthetic_flags(spark, sf_dir):
    """Values that are made up by their beginning, as a whole, or by a part."""
    e = Tables(spark, sf_dir).events
    text = F.replace(F.get(F.array(*map(F.lit, MADE_UP)), (F.col("event_id") % len(MADE_UP)).cast("int")), F.lit("{0}"), F.col("event_type"))
    rows = e.select("event_id", text.alias("text"))
    return rows.select("event_id", "text", fx.is_synthetic(F.col("text")).alias("made_up"))


#: Feature strings, # for a root, and what they say: case, gender, number, person, root.
FEATURES = (
    ("ROOT:#|LEM:x|M|GEN", ("GEN", "M", None, None, "#")), ("2MP", (None, "M", "P", "2", None)), ("MP|ROOT:#|PERF", (None, "M", "P", None, "#")),
    ("3S|PASS", (None, None, "S", "3", None)), ("S|MP", (None, "M", "P", None, None)), ("MP|S", (None, "M", "P", None, None)), ("ADJ|PN|X", (None,) * 5),
    ("P", (None, None, "P", None, None)), ("1P|FD|NOM|ACC", ("ACC", "F", "D", "1", None)),
)
_FIELDS = ("case", "gender", "number", "person", "root")


def _feature_sql(k: int) -> str:
    value = lambda v: "null" if v is None else "event_type" if v == "#" else f"'{v}'"
    return "case event_id % 9 " + " ".join(f"when {i} then {value(v[k])}" for i, (_, v) in enumerate(FEATURES)) + " end"


@query("select event_id, " + ", ".join(f'{_feature_sql(k)} as "{n}"' for k, n in enumerate(_FIELDS)) + " from events")
def feature_parse(spark, sf_dir):
    """Feature strings of every event as maps."""
    e = Tables(spark, sf_dir).events
    text = F.replace(F.get(F.array(*[F.lit(x) for x, _ in FEATURES]), (F.col("event_id") % 9).cast("int")), F.lit("#"), F.col("event_type"))
    rows = e.select("event_id", fx.parse_features(text).alias("f"))
    return rows.select("event_id", *[F.col("f")["ROOT" if k == "root" else k].alias(k) for k in _FIELDS])


@query(
    """with s as (select conv_id, turn, trim(unnest(string_split(text, '.'))) as seg, generate_subscripts(string_split(text, '.'), 1) as pos from conversations)
 select conv_id, turn, string_agg(seg, '/' order by pos) as text, arg_min(seg, pos) filter (where length(seg) > 10) as main, count(*) as segments from s where seg <> '' group by conv_id, turn"""
)
def segment_group(spark, sf_dir):
    """Segments of a turn put together in order, with the first that is long enough to be its main one."""
    t = Tables(spark, sf_dir)
    rows = t.conversations.select("conv_id", "turn", F.posexplode(F.split("text", r"\.")).alias("pos", "seg")).withColumn("seg", F.trim("seg")).where("seg <> ''")
    return rows.groupBy("conv_id", "turn").agg(
        context.ordered_join(F.col("pos"), F.col("seg"), "/").alias("text"), F.min_by("seg", F.when(F.length("seg") > 10, F.col("pos"))).alias("main"), F.count("*").alias("segments")
    )


#: Feature strings of segments, # for a root: a prefix, two stems and a suffix, and what a stem says beside root and lemma.
SEGMENTS = (("PREF|CONJ", None), ("ROOT:#|LEM:#-a|M|GEN", "case=GEN,gender=M"), ("SUFF|3MS", None), ("LEM:b|IMPF|2FP", "aspect=IMPF,gender=F,number=P,person=2"))


def _segment_sql(k: int) -> str:
    value = lambda s: "null" if s is None else f"replace('{s}', '#', event_type)"
    pick = [(v[1], "#" if "ROOT" in v[0] else None, v[0].split("LEM:")[1].split("|")[0] if "LEM" in v[0] else None, "PREF" if "PREF" in v[0] else "SUFF" if "SUFF" in v[0] else None)[k] for v in SEGMENTS]
    return "case (event_id * 7) % 4 " + " ".join(f"when {i} then {value(v)}" for i, v in enumerate(pick)) + " end"


@query(
    f"""with s as (select event_id // 4 as word, event_id % 4 as pos, substr(event_type, 1, 2) as form, event_type as tag, {_segment_sql(0)} as features, {_segment_sql(1)} as root, {_segment_sql(2)} as lemma, {_segment_sql(3)} as affix,
 coalesce({_segment_sql(3)}, '') as side from events where (event_id // 4) % 3 <> 1 or event_id % 4 < 2),
 t as (select *, case when affix = 'PREF' then 'type=CONJ' when affix = 'SUFF' then 'gender=M,number=S,person=3' else features end as said, row_number() over (partition by word order by affix is not null, pos) as rn from s),
 w as (select word, string_agg(form, '' order by pos) as text, string_agg(form || ':' || side || ':' || coalesce(root, ''), ' ' order by pos) as segments from s group by word)
 select word, text, tag as pos, root, lemma, said as features, segments from w join t using (word) where rn = 1"""
)
def folded_words(spark, sf_dir):
    """Events as segments of words: their text, and root, lemma and features of the main segment."""
    e = Tables(spark, sf_dir).events.where("(event_id div 4) % 3 <> 1 or event_id % 4 < 2")
    said = F.replace(F.get(F.array(*[F.lit(x) for x, _ in SEGMENTS]), ((F.col("event_id") * 7) % 4).cast("int")), F.lit("#"), F.col("event_type"))
    rows = e.select(F.expr("event_id div 4").alias("word"), (F.col("event_id") % 4).alias("seg"), F.substring("event_type", 1, 2).alias("form"), F.col("event_type").alias("tag"), fx.parse_features(said).alias("features"))
    pairs = F.array_sort(F.transform(F.map_entries("features"), lambda x: F.concat_ws("=", x["key"], x["value"])))
    each = F.transform("segments", lambda x: F.concat_ws(":", x["form"], F.coalesce(x["affix"], F.lit("")), F.coalesce(x["root"], F.lit(""))))
    return words.fold_segments(rows, ["word"], "seg").select("word", "text", "pos", "root", "lemma", F.array_join(pairs, ",").alias("features"), F.array_join(each, " ").alias("segments"))


@query(
    """with h as (select source as book, doc_id as line, cast(n_chars % 3 + 1 as int) as level from documents),
 l as (select *, last_value(case when level = 1 then line end ignore nulls) over w as l1, last_value(case when level = 2 then line end ignore nulls) over w as l2 from h
 window w as (partition by book order by line rows between unbounded preceding and 1 preceding))
 select book, line, level, case level when 2 then l1 when 3 then greatest(l1, l2) end as parent from l"""
)
def headings_to_tree(spark, sf_dir):
    """Documents as headings of their source's book, with levels from their length."""
    t = Tables(spark, sf_dir)
    rows = t.documents.select(F.col("source").alias("book"), F.col("doc_id").alias("line"), (F.col("n_chars") % 3 + 1).cast("int").alias("level"))
    return tree.headings_tree(rows, "book", "line", "level")


@query(
    """with l as (select source, lang, min(doc_id) as line, row_number() over (partition by source order by lang) - 1 as i from documents group by source, lang),
 d as (select source, lang, doc_id, row_number() over (partition by source, lang order by doc_id) - 1 as j from documents)
 select source as book, '0000' as path, 0 as depth, source as title, cast(0 as bigint) as line_num from l group by source union all
 select source, '0000.' || lpad(i::varchar, 4, '0'), 1, lang, line from l union all
 select d.source, '0000.' || lpad(i::varchar, 4, '0') || '.' || lpad(j::varchar, 4, '0'), 2, 'passage ' || doc_id, doc_id from d join l using (source, lang)"""
)
def tree_flatten(spark, sf_dir):
    """Books as JSON trees of languages and passages, flattened level by level."""
    d = Tables(spark, sf_dir).documents
    leaf = F.struct(F.col("doc_id").alias("line_num"), F.format_string("passage %d", "doc_id").alias("title"))
    parts = d.groupBy("source", "lang").agg(F.min("doc_id").alias("line_num"), F.array_sort(F.collect_list(leaf)).alias("nodes"))
    branch = F.struct(F.col("lang").alias("title"), "line_num", "nodes")
    roots = parts.groupBy("source").agg(F.array_sort(F.collect_list(branch)).alias("nodes"))
    whole = F.to_json(F.array(F.struct(F.col("source").alias("title"), F.lit(0).alias("line_num"), "nodes")))
    return tree.flatten_tree(roots.select("source", whole.alias("forest")), "source", "forest").select("book", "path", "depth", "title", "line_num")


@query(
    """with r as (select *, row_number() over (partition by source order by n_chars desc, doc_id) as rn from documents)
 select source, string_agg('[' || rn || '] ' || lang || chr(10) || case when length(text) > 1000 then substr(text, 1, 1000) || '...' else text end, chr(10) || chr(10) order by rn) as context, count(*) as entries from r where rn <= 4 group by source"""
)
def context_block(spark, sf_dir):
    """The four longest documents of each source as one numbered context."""
    t = Tables(spark, sf_dir)
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    top = t.documents.withColumn("rn", F.row_number().over(w)).where("rn <= 4")
    return context.context_blocks(top, "source", "rn", "lang", "text", 1000)


@query(
    """with p as (select conv_id * 1000 + turn as id, text, lead(text) over (partition by conv_id order by turn) as answer, role from conversations)
 select id, case when cast(('0x' || substr(md5('42:' || id), 1, 6)) as bigint) % 10 = 0 then 'valid' else 'train' end as split, length(text) + length(answer) as size from p where role = 'user' and answer is not null"""
)
def training_pairs(spark, sf_dir):
    """Question and answer turns as chat records in a reproducible split; the sizes stand for the records here."""
    t = Tables(spark, sf_dir)
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text", F.lead("text").over(w).alias("answer"))
    pairs = context.training_pairs(rows.where("role = 'user' and answer is not null"), "id", F.col("text"), F.col("answer"))
    messages = F.from_json("record", "messages array<struct<role:string,content:string>>")["messages"]
    return pairs.select("id", "split", F.aggregate(messages, F.lit(0).cast("bigint"), lambda a, m: a + F.length(m["content"])).alias("size"))


@query(
    """select doc_id, cast(greatest(ceil(greatest(length(text), 1) / 1300.0), 1) as int) as chunks, length(text) as size from documents""".replace(
        "length(text) as size", "cast(length(text) as bigint) as size"
    )
)
def chunker(spark, sf_dir):
    """Windows of 1500 characters that overlap by 200."""
    t = Tables(spark, sf_dir)
    return t.documents.select("doc_id", F.size(fx.chunks(F.col("text"))).alias("chunks"), F.length("text").cast("bigint").alias("size"))


@query(
    """select event_id, case event_id % 5 when 0 then event_id when 1 then user_id end as number, case when event_id % 5 = 0 and event_id > 0 then (user_id + 1) || '_' || event_id end as key,
 case when event_id % 5 = 0 then 'sb_' || event_id end as ref, cast(case event_id % 5 when 0 then user_id when 1 then user_id + 10 when 2 then 1 when 3 then 3 end as int) as gen from events"""
)
def number_parse(spark, sf_dir):
    """Numbers, keys and generations out of loosely written strings made of every event's numbers."""
    e = Tables(spark, sf_dir).events
    i, u, text = F.col("event_id"), F.col("user_id"), F.format_string
    one = lambda *values: F.get(F.array(*values), (i % 5).cast("int"))
    number = one(text("%d a", i), text("%db", u), text("a%d", i), F.lit(""), text(" %d", i))
    key = one(text("%d:%d", u + 1, i), text("%d_x", u), text("%d_2_3", i), text("0:%d", i), F.lit("a:b"))
    ref = one(text("SB-HD%04d", i), text("SB%04d", i), F.lit(""), text("HD-%d", i), F.lit("x"))
    gen = one(text("%d?", u), text("%d", u + 10), F.lit("Sahabi"), F.lit("tabi'i"), F.lit("x"))
    return e.select(
        "event_id", fx.leading_number(number).alias("number"), fx.verse_key(key).alias("key"), fx.cross_reference_key(ref).alias("ref"), fx.parse_generation(gen).alias("gen")
    )
