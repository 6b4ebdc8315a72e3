"""Registered queries of scalar functions over table columns, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
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


def cases(key, *values):
    """One of several expressions, by the key modulo their number."""
    out = F.lit(None)
    for i, v in enumerate(values):
        out = F.when(key % len(values) == i, v).otherwise(out)
    return out


def _cases_sql(key: str, *values: str) -> str:
    return "case " + " ".join(f"when {key} % {len(values)} = {i} then {v}" for i, v in enumerate(values)) + " end"


_RAW = _cases_sql("doc_id", "'Allah''s Apostle said in ' || lang", "'Allah''s Messenger (ﷺ) of ' || source", "lang || ' PBUH, Peace be upon him'", "'peace be upon him ' || source || ' Peace Be Upon Him'")
_SIGNED = "replace(replace(replace(replace({0}, 'PBUH', 'ﷺ'), 'pbuh', 'ﷺ'), 'peace be upon him', 'ﷺ'), 'Peace be upon him', 'ﷺ')"
_TITLED = "replace(replace(replace({0}, 'Allah''s Apostle', 'Allah''s Messenger (ﷺ)'), 'Allah''s Messenger', 'Allah''s Messenger (ﷺ)'), '(ﷺ) (ﷺ)', '(ﷺ)')"


@query(f"select doc_id, {_SIGNED.format(_TITLED.format('raw'))} as text, replace({_SIGNED.format('raw')}, 'Peace Be Upon Him', 'ﷺ') as name from (select doc_id, {_RAW} as raw from documents)")
def honorific_chain(spark, sf_dir):
    """Titles and phrases replaced in order, the sign never twice."""
    d = Tables(spark, sf_dir).documents
    lang, source = F.col("lang"), F.col("source")
    raw = cases(
        F.col("doc_id"), F.concat(F.lit("Allah's Apostle said in "), lang), F.concat(F.lit("Allah's Messenger (ﷺ) of "), source),
        F.concat(lang, F.lit(" PBUH, Peace be upon him")), F.concat(F.lit("peace be upon him "), source, F.lit(" Peace Be Upon Him")),
    )
    return d.select("doc_id", fx.honorifics(raw).alias("text"), fx.honorifics_of_names(raw).alias("name"))


@query(
    f"""select code, type, count(*) as n from (select {_cases_sql('user_id', "'elevated'", "'stopped'", "'sacred'", "'severed'", 'event_type')} as code from events) e
 left join (values ('elevated', 'مرفوع'), ('stopped', 'موقوف'), ('sacred', 'قدسي'), ('severed', 'مقطوع')) as t(k, name) on k = code, lateral (select coalesce(name, code) as type) group by code, type"""
)
def type_codes(spark, sf_dir):
    """Codes of events' types by name; unknown ones pass through."""
    code = cases(F.col("user_id"), *map(F.lit, ("elevated", "stopped", "sacred", "severed")), F.col("event_type"))
    rows = Tables(spark, sf_dir).events.select(code.alias("code"))
    return rows.groupBy("code", fx.code_name(F.col("code")).alias("type")).agg(F.count("*").alias("n"))


_SAID = _cases_sql(
    "doc_id", "'Narrated ' || source || ': ' || substr(text, 1, 30)", "' It is narrated on the authority of ' || lang || ' of ' || source || ' : x'", "'Narrated : ' || lang",
    "'Narrated ' || repeat(source || ' ', 30) || ': ' || lang", "source || ' said: ' || lang", "'Narrated é' || repeat('é', doc_id % 60) || ':'",
)


@query(
    f"""select doc_id, case when name <> '' and strlen(name) < 100 then name end as speaker from (select doc_id, trim(regexp_extract(trim({_SAID}), '(?s)^(?:Narrated |It is narrated on the authority of )([^:]*):', 1)) as name from documents)"""
)
def speaker_extract(spark, sf_dir):
    """The speaker whom an English text names before its first colon."""
    d = Tables(spark, sf_dir).documents
    lang, source = F.col("lang"), F.col("source")
    said = cases(
        F.col("doc_id"), F.concat(F.lit("Narrated "), source, F.lit(": "), F.substring("text", 1, 30)),
        F.concat(F.lit(" It is narrated on the authority of "), lang, F.lit(" of "), source, F.lit(" : x")), F.concat(F.lit("Narrated : "), lang),
        F.concat(F.lit("Narrated "), F.repeat(F.concat(source, F.lit(" ")), 30), F.lit(": "), lang), F.concat(source, F.lit(" said: "), lang),
        F.concat(F.lit("Narrated é"), F.repeat(F.lit("é"), (F.col("doc_id") % 60).cast("int")), F.lit(":")),
    )
    return d.select("doc_id", fx.speaker(said).alias("speaker"))


@query(
    """select event_id, case event_id % 6 when 0 then [event_id, user_id] when 1 then [event_id, user_id] when 2 then [event_id, user_id] when 3 then [event_id, user_id] when 4 then [user_id] else [] end as lines from events"""
)
def line_list_parse(spark, sf_dir):
    """Numbers out of replies that list them in different ways; what is no number is skipped."""
    e = Tables(spark, sf_dir).events
    a, b = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    reply = cases(
        F.col("event_id"), F.format_string("[%s, %s]", a, b), F.format_string('["%s", " %s "]', a, b), F.format_string('"%s, %s, x"', a, b),
        F.format_string('[{"line_num": %s}, {"line": %s}, {"other": 1}]', a, b), F.format_string('["x", null, %s, {"line": "y"}]', b), F.format_string('{"lines": [%s]}', a),
    )
    return e.select("event_id", fx.line_numbers(reply).alias("lines"))


_KEEP = "b|strong|i|em|u|s|h2|h3|blockquote|ul|ol|li|hr|br|p|div"
_TAGS = _KEEP.split("|")


def _kept_sql(html: str) -> str:
    """Other tags go; kept ones lose attributes (RE2 has no look-ahead, so kept tags are marked first)."""
    out = html
    for t in _TAGS:
        out = f"regexp_replace(regexp_replace({out}, '(?i)<{t}\\b[^>]*>', chr(1) || '{t}' || chr(2), 'g'), '(?i)</{t}\\b[^>]*>', chr(1) || '/{t}' || chr(2), 'g')"
    return f"replace(replace(regexp_replace({out}, '(?i)</?[a-z][a-z0-9]*\\b[^>]*>', '', 'g'), chr(1), '<'), chr(2), '>')"


@query(f"select page_id, regexp_matches(html, '(?i)<({_KEEP})\\b') as is_html, md5({_kept_sql('html')}) as safe from pages")
def note_markup(spark, sf_dir):
    """Pages as notes: whether they hold markup, and what of it may stay."""
    html = F.col("html")
    return Tables(spark, sf_dir).pages.select("page_id", fx.has_markup(html).alias("is_html"), F.md5(fx.safe_markup(html).cast("binary")).alias("safe"))


@query(
    """with n as (select event_id, 'see @' || user_id || ':' || event_id || ' and @sb:' || event_id || ', @narrator:n_' || user_id || ' at https://x.org/' || event_type || ' end' as note from events),
 m as (select event_id, unnest(regexp_extract_all(note, '(@[A-Za-z0-9_]+:[A-Za-z0-9_]+|https?://[^\\s<>]+)', 1)) as mention from n)
 select event_id, mention, case when regexp_matches(mention, '^@[0-9]+:[0-9]+$') then 'ayah' when starts_with(mention, '@narrator:') then 'narrator' when starts_with(mention, '@') then 'hadith' else 'url' end as kind from m"""
)
def note_mentions(spark, sf_dir):
    """Mentions and addresses in notes, by kind."""
    e = Tables(spark, sf_dir).events
    note = F.format_string("see @%d:%d and @sb:%d, @narrator:n_%d at https://x.org/%s end", "user_id", "event_id", "event_id", "user_id", "event_type")
    rows = e.select("event_id", F.explode(fx.mentions(note)).alias("mention"))
    return rows.select("event_id", "mention", fx.mention_kind(F.col("mention")).alias("kind"))


_ARABIC = "translate({0}, '0123456789', '٠١٢٣٤٥٦٧٨٩')"


@query(
    """select doc_id, d.surah, d.ayah, case when doc_id % 5 = 3 then doc_id % 9 end as trailing, case when doc_id % 5 = 4 then doc_id end as number, case when doc_id % 5 = 4 then source end as name,
 case when doc_id % 5 = 3 then [doc_id, doc_id + 1] else [] end as marked
 from documents, lateral (select unnest(case doc_id % 5 when 0 then [{surah: doc_id % 114 + 1, ayah: doc_id % 7}] when 1 then list_transform(range(doc_id % 7, doc_id % 7 + 4), lambda a: {surah: doc_id % 114 + 1, ayah: a}) when 2 then [{surah: doc_id % 114 + 1, ayah: doc_id % 7}] else [{surah: null, ayah: null}] end) as d)"""
)
def heading_references(spark, sf_dir):
    """Verses, numbers and names out of headings of several forms."""
    d = Tables(spark, sf_dir).documents
    arabic = lambda c: F.translate(c.cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    i, surah, ayah = F.col("doc_id"), F.col("doc_id") % 114 + 1, F.col("doc_id") % 7
    title = cases(
        i, F.format_string("قول [سورة %s (%s): آية %s]", "source", arabic(surah), arabic(ayah)), F.format_string("[سورة %s (%s): الآيات %s إلى %s]", "source", arabic(surah), arabic(ayah), arabic(ayah + 3)),
        F.format_string("[سورة %s (%s) : الآيات %s]", "source", surah, ayah), F.format_string("نص (%s) ﴾ [الحَدِيث %s] و[الحديث%s", arabic(i % 9), i, arabic(i + 1)), F.format_string("[%s] (خ م) %s ", i, "source"),
    )
    named = fx.numbered_name(title)
    rows = d.select("doc_id", F.explode_outer(fx.heading_verses(title)).alias("v"), fx.trailing_verse(title).alias("trailing"), named["number"].alias("number"), named["name"].alias("name"), fx.marked_numbers(title).alias("marked"))
    return rows.select("doc_id", "v.surah", "v.ayah", "trailing", "number", "name", "marked")


@query(
    """with f as (select page_id, url || case when page_id % 3 = 0 then '' else '|' || 'label ' || page_id || '|x' end as name from pages)
 select page_id, split_part(name, '|', 1) as file, case when contains(name, '|') then substr(name, instr(name, '|') + 1) else '' end as label,
 case when contains(split_part(name, '://', 2), '/') then substr(split_part(name, '://', 2), 1, instr(split_part(name, '://', 2), '/') - 1) || '_=_' || substr(split_part(name, '://', 2), instr(split_part(name, '://', 2), '/') + 1) else split_part(name, '://', 2) end as proxied from f"""
)
def file_labels(spark, sf_dir):
    """A file's name without its label, the label, and the address with its first slash replaced."""
    p = Tables(spark, sf_dir).pages
    label = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.format_string("|label %d|x", "page_id"))
    rows = p.select("page_id", F.concat("url", label).alias("name"))
    parts = fx.split_label(F.col("name"))
    return rows.select("page_id", parts["file"].alias("file"), parts["label"].alias("label"), fx.first_slash(F.split_part("name", F.lit("://"), F.lit(2))).alias("proxied"))


@query(
    """with k as (select event_id, user_id - 5 as number, props as text, case event_id % 3 when 0 then user_id || ':' || event_id when 1 then user_id || '_0' else 'x:' || event_id end as key from events)
 select event_id, number > 0 and number < 10000 and trim(text) <> '' as sound, case when regexp_matches(key, '^[0-9]+[:_][0-9]+$') and cast(split_part(replace(key, ':', '_'), '_', 1) as int) > 0 and cast(split_part(replace(key, ':', '_'), '_', 2) as int) > 0 then replace(key, ':', '_') end as verse from k"""
)
def validity_filter(spark, sf_dir):
    """Records with a positive number in bounds and a text, and their well-formed keys."""
    e = Tables(spark, sf_dir).events
    number = F.col("user_id") - 5
    key = cases(F.col("event_id"), F.format_string("%d:%d", "user_id", "event_id"), F.format_string("%d_0", "user_id"), F.format_string("x:%d", "event_id"))
    return e.select("event_id", ((number > 0) & (number < 10_000) & (F.trim("props") != "")).alias("sound"), fx.verse_key(key).alias("verse"))


@query(
    """with c as (select doc_id, s // 1300 as chunk, substr(text, s + 1, 1500) as body from documents, lateral (select unnest(range(0, greatest(length(text), 1), 1300)) as s))
 select doc_id, cast(chunk as int) as chunk, length(body) as size, md5(body) as body from c"""
)
def chunk_texts(spark, sf_dir):
    """Every window of 1500 characters that overlaps the last by 200, by its checksum."""
    d = Tables(spark, sf_dir).documents
    rows = d.select("doc_id", F.posexplode(fx.chunks(F.col("text"))).alias("chunk", "body"))
    return rows.select("doc_id", "chunk", F.length("body").cast("long").alias("size"), F.md5(F.col("body").cast("binary")).alias("body"))


_NAMES = ("أَبِي هُرَيْرَةَ", "أبى موسى الأشعرى", "إبراهيم بن يزيد", "مُحَمَّدٌ ـــ رسول", "امي سلمة", "فاطمة  الزهراء", "آمنة ۖ بنت")
_LISTED = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"
_FOLDED = "translate(regexp_replace({0}, '[ً-ٰٟـؐ-ؚۖ-ۭ]', '', 'g'), 'أإآٱةى', 'ااااهي')"


@query(
    f"""with n as (select doc_id, source || ' ' || {_LISTED}[doc_id % 7 + 1] || ' ' || {_LISTED}[doc_id // 7 % 7 + 1] as text from documents)
 select doc_id, trim(regexp_replace({_FOLDED.format('text')}, '\\s+', ' ', 'g')) as folded, trim(regexp_replace(regexp_replace({_FOLDED.format('text')}, '[^ؠ-ي ]', '', 'g'), '\\s+', ' ', 'g')) as plain,
 regexp_replace(text, '[ً-ْٰٓ-ٟۖ-ۜ۟-۪ۤۧۨ-ۭؐ-ؚ]', '', 'g') as unmarked from n"""
)
def name_folds(spark, sf_dir):
    """Both folds of names and the removal of marks, over names made of two parts and a source."""
    d = Tables(spark, sf_dir).documents
    names = F.array(*map(F.lit, _NAMES))
    pick = lambda i: F.get(names, (i % 7).cast("int"))
    text = F.concat_ws(" ", "source", pick(F.col("doc_id")), pick(F.floor(F.col("doc_id") / 7)))
    return d.select("doc_id", fx.fold_letters(text).alias("folded"), fx.strip_diacritics(text).alias("plain"), fx.remove_marks(text).alias("unmarked"))
