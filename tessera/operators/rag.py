"""Plans around a language model: routing, tools, navigation, prompts and merged replies.

Models are injected callables and only ever see text; everything that decides what they are told and
what of their replies counts is a plan over DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import honorifics_of_names, line_numbers, truncate_bytes
from . import scan
from .calls import Model, answered, ask_in_stages
from .context import ordered_join, parse_intent
from .storage import materialize

#: Lines that a section without a following one is taken to have, a whole chapter's, and what a fruitless range is widened by.
SECTION_LINES, CHAPTER_LINES, WIDER = 200, 500, 200
PROMPT_BYTES = 25_000


def reply_of(rows: DataFrame, prompt: Column, model: Callable[[str], str], name: str = "reply", at_once: int = 4, deadline: float = 180.0) -> DataFrame:
    """rows with a model's reply to each prompt; a call that fails or is late gives null, not a failed job."""
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [reply for reply, _ in answered(f["_prompt"].tolist(), model, at_once, deadline)]
            yield f.drop(columns="_prompt").assign(**{name: pd.Series(out, dtype="object", index=f.index)})

    fields = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in rows.schema)
    return rows.withColumn("_prompt", prompt).mapInPandas(run, f"{fields}, {name} string")


def classify(questions: DataFrame, model: Callable[[str], str] | None) -> DataFrame:
    """questions (id, scope, question, ...) with intent and name; the scripture's scope is not classified, and no usable reply means content."""
    if model is None:
        reply = questions.withColumn("reply", F.lit(None).cast("string"))
    else:
        asked = questions.where("scope <> 'quran'")
        prompt = F.concat(F.lit("Name the intent of the question and whom it is about, as JSON with intent and name.\n\n"), F.col("question"))
        reply = reply_of(asked, prompt, model).unionByName(questions.where("scope = 'quran'").withColumn("reply", F.lit(None).cast("string")))
    parsed = parse_intent(F.col("reply"))
    return reply.select("*", parsed["intent"].alias("intent"), parsed["name"].alias("name")).drop("reply")


def route(questions: DataFrame, people: DataFrame) -> DataFrame:
    """(id, plan, node): a structured plan for a known intent about a known person, else semantic search in the scope.

    questions: (id, scope, intent, name); people: (name, node). Structured plans need the records' scope or both.
    """
    known = people.groupBy("name").agg(F.min("node").alias("node"))
    rows = questions.join(known, "name", "left")
    structured = (F.col("scope") != "quran") & (F.col("intent") != "content") & F.col("node").isNotNull()
    return rows.select("id", F.when(structured, F.col("intent")).otherwise(F.concat(F.lit("semantic "), F.col("scope"))).alias("plan"), F.when(structured, F.col("node")).alias("node"))


def node_info(nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """(node, context): what is known of a node, for the answer to a question about it. degree: (node, variants, teachers, students)."""
    rows = nodes.select(F.col("id").alias("node"), "name", "gen").join(degree, "node", "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    text = F.format_string(
        "## %s\nGeneration: %d\nRecords: %d\nTeachers: %d\nStudents: %d", "name", "gen", count("variants"), count("teachers"), count("students")
    )
    return rows.select("node", text.alias("context"))


def node_records(members: DataFrame, records: DataFrame, most: int = 10, size: int = 300) -> DataFrame:
    """(node, context): a node's first records, each cut at `size` bytes, under how many there are. members: (node, id); records: (id, number, text)."""
    w = Window.partitionBy("node")
    rows = members.withColumns({"total": F.count("*").over(w), "place": F.row_number().over(w.orderBy("id"))}).where(F.col("place") <= most).join(records, "id")
    entry = F.format_string("Hadith #%d\n%s\n\n", "number", truncate_bytes(F.col("text"), size))
    shown = rows.groupBy("node").agg(F.first("total").alias("total"), F.count("*").alias("shown"), ordered_join(F.col("place"), entry, "").alias("body"))
    return shown.select("node", F.concat(F.format_string("Showing %d of %d total hadiths:\n\n", "shown", "total"), F.col("body")).alias("context"))


def unified_context(first: DataFrame, second: DataFrame, each: int = 4, alone: int = 6, cap: int = 1000) -> DataFrame:
    """(question, context) from two ranked sources (question, rank, title, text): `each` of both, or `alone` where only one has any."""
    def entries(df: DataFrame, place: int) -> DataFrame:
        return df.select("question", F.lit(place).alias("place"), "rank", "title", "text")

    rows = entries(first, 0).unionAll(entries(second, 1))
    w = Window.partitionBy("question")
    both = F.size(F.collect_set("place").over(w)) == 2
    rows = rows.withColumn("most", F.when(both, each).otherwise(alone)).where(F.col("rank") <= F.col("most"))
    body = F.when(F.length("text") > cap, F.concat(F.substring("text", 1, cap), F.lit("..."))).otherwise(F.col("text"))
    entry = F.format_string("[%d.%d] %s\n%s", F.col("place") + 1, F.col("rank"), F.col("title"), body)
    return rows.groupBy("question").agg(ordered_join(F.struct("place", "rank"), entry, "\n\n").alias("context"))


def choose_chapters(chapters: DataFrame, replies: DataFrame, most: int = 3, usual: int = 2) -> DataFrame:
    """(question, chapter, place): the chapters to look into. chapters: (book, line, place); replies: (question, book, lines, again).

    Of the first `most` lines of a reply those that are chapters count; without one, those of the second
    reply; without one again, the book's first `usual` chapters.
    """
    def valid(column: str, step: int) -> DataFrame:
        rows = replies.select("question", "book", F.posexplode(F.slice(F.coalesce(F.col(column), F.array().cast("array<bigint>")), 1, most)).alias("place", "line"))
        hit = rows.join(chapters.select("book", "line"), ["book", "line"], "left_semi")
        return hit.groupBy("question", "line").agg(F.min("place").alias("place")).withColumn("step", F.lit(step))

    fallback = replies.select("question", "book").join(chapters.where(F.col("place") < usual), "book").select("question", "line", "place", F.lit(2).alias("step"))
    every = valid("lines", 0).unionByName(valid("again", 1)).unionByName(fallback)
    best = F.min("step").over(Window.partitionBy("question"))
    return every.withColumn("_b", best).where(F.col("step") == F.col("_b")).select("question", F.col("line").alias("chapter"), "place")


#: What is asked for the first time, and again of those whose reply named no chapter: # stands for the question.
ASK_CHAPTERS = ("Question: #\nWhich chapters bear on it? Answer with a list of their line numbers.\n\n", "Answer with line numbers from this list alone, as [1, 2].\nQuestion: #\n\n")


def navigate(
    questions: DataFrame, chapters: DataFrame, model: Model, most: int = 3, usual: int = 2, at_once: int = 4, deadline: float = 180.0
) -> tuple[DataFrame, DataFrame]:
    """(question, chapter, place) and, of every call, (question, stage, reply, reason): chapters that a model picks for each question.

    questions: (question, book, text); chapters: (book, line, place, title). The prompt lists the book's chapters, cut at
    PROMPT_BYTES. A reply that names no chapter of the book, a failed call and a late one are asked again,
    in other words and for those questions alone; without a sound reply the book's first chapters are taken, as choose_chapters does.
    """
    rows = materialize(questions.select("question", "book", "text"))
    listed = materialize(answer_context_lines(chapters))
    prompt = lambda ask: F.concat(F.replace(F.lit(ask), F.lit("#"), F.coalesce("text", F.lit(""))), F.coalesce("list", F.lit("")))
    # one row for each question: the files of the stored ones are small where replies are alike, which says nothing of the memory that a broadcast takes
    books = rows.select("question", "book").hint("merge")
    named_lines = F.slice(line_numbers(F.col("reply")), 1, most)

    def named(told: DataFrame) -> DataFrame:
        lines = told.select("question", F.explode(named_lines).alias("line")).join(books, "question")
        return lines.join(chapters.select("book", "line"), ["book", "line"], "left_semi")

    told = ask_in_stages(rows, "question", [(prompt(a), model) for a in ASK_CHAPTERS], named, at_once, deadline, lambda some: some.join(listed, "book", "left"))
    lines = lambda stage: told.where(F.col("stage") == stage).select("question", named_lines.alias("lines" if stage == 0 else "again")).hint("merge")
    replies = books.join(lines(0), "question", "left").join(lines(1), "question", "left")
    return choose_chapters(chapters, replies, most, usual), told


def answer_context_lines(chapters: DataFrame, most_bytes: int = PROMPT_BYTES) -> DataFrame:
    """(book, list): a line for each chapter (book, line, place, title) in order, `line: title`, as many as most_bytes hold."""
    entry = F.concat(F.col("line").cast("string"), F.lit(": "), F.col("title"), F.lit("\n"))
    sized = scan.running_sum(chapters.select("book", "line", "place", "title"), "book", ["place", "line"], F.octet_length(entry).cast("long"), "_until")
    return sized.where(F.col("_until") <= most_bytes).groupBy("book").agg(ordered_join(F.struct("place", "line"), entry, "").alias("list"))


def choose_sections(chosen: DataFrame, sections: DataFrame, replies: DataFrame, each: int = 3, most: int = 5) -> DataFrame:
    """(question, place, start, stop): line ranges, at most `most`, chapter by chapter.

    chosen: of choose_chapters; sections: (chapter, line); replies: (question, chapter, ranges), ranges an array of
    (start, stop). Of a chapter's first `each` ranges those count that start at one of its sections; a
    range that does not end behind its start is given SECTION_LINES; a chapter without any counts as a whole.
    """
    listed = replies.select("question", "chapter", F.posexplode(F.slice("ranges", 1, each)).alias("i", "r")).select("question", "chapter", "i", "r.start", "r.stop")
    sound = listed.join(sections.select("chapter", F.col("line").alias("start")).distinct(), ["chapter", "start"], "left_semi")
    rows = chosen.join(sound, ["question", "chapter"], "left")
    start = F.coalesce("start", "chapter")
    stop = F.when(F.col("start").isNull(), F.col("chapter") + CHAPTER_LINES).when(F.col("stop") <= F.col("start"), F.col("start") + SECTION_LINES).otherwise(F.col("stop"))
    w = Window.partitionBy("question").orderBy("place", "chapter", "i")
    ranked = rows.select("question", start.alias("start"), stop.alias("stop"), F.row_number().over(w).alias("place"))
    return ranked.where(F.col("place") <= most)


def sections_in(ranges: DataFrame, lines: DataFrame, wider: int = WIDER) -> DataFrame:
    """(question, book, line, title, text): lines with a text in the ranges (question, book, start, stop, both inclusive), each once.

    A range without any is widened by `wider` lines on both sides. Lines meet ranges by book and bucket of lines.
    """
    width = CHAPTER_LINES
    texts = lines.where("text is not null and text <> ''").withColumn("_b", F.floor(F.col("line") / width))
    numbered = ranges.select("*", F.xxhash64("question", "book", "start", "stop").alias("_r")).distinct()

    def inside(df: DataFrame) -> DataFrame:
        spread = df.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))))
        return spread.join(texts, ["book", "_b"]).where((F.col("line") >= F.col("start")) & (F.col("line") <= F.col("stop")))

    found = inside(numbered)
    empty = numbered.join(found.select("_r").distinct(), "_r", "left_anti")
    more = inside(empty.withColumns({"start": F.greatest(F.col("start") - wider, F.lit(0)), "stop": F.col("stop") + wider}))
    columns = ["question", "book", "line", "title", "text"]
    return found.select(*columns).unionAll(more.select(*columns)).dropDuplicates(["question", "book", "line"])


def answer_context(sections: DataFrame, group: str, most_bytes: int = PROMPT_BYTES) -> DataFrame:
    """(group, bytes, context): sections (group, line, title, text) in order of lines, cut at whole characters to most_bytes with a note.

    bytes: those of all sections. A group's sections beyond the bound are known by their sizes, which are summed
    along the order without their texts; texts that count are gathered alone, each cut to the bound first. Lines of one group should differ.
    """
    entry = F.format_string("--- [%s] (line %d) ---\n%s\n\n", "title", "line", "text")
    tie = F.xxhash64("title", "text")
    sizes = sections.select(group, "line", tie.alias("_tie"), F.octet_length(entry).cast("long").alias("_size"))
    placed = scan.running_sum(sizes, group, ["line", "_tie"], F.col("_size"), "_until")
    totals = placed.groupBy(group).agg(F.sum("_size").alias("bytes"))
    first = placed.where(F.col("_until") - F.col("_size") < most_bytes).select(F.col(group).alias("_g"), F.col("line").alias("_line"), "_tie").distinct()
    here = F.col(group).eqNullSafe(F.col("_g")) & (F.col("line") == F.col("_line")) & (tie == F.col("_tie"))
    texts = sections.join(first, here, "left_semi").select(group, "line", F.substring(entry, 1, most_bytes).alias("_entry"))
    whole = texts.groupBy(group).agg(ordered_join(F.col("line"), F.col("_entry"), "").alias("_whole"))
    cut = F.concat(truncate_bytes(F.col("_whole"), most_bytes), F.lit("\n... (content truncated)\n"))
    told = totals.withColumnRenamed(group, "_g")
    return whole.join(told, F.col(group).eqNullSafe(F.col("_g"))).select(group, "bytes", F.when(F.col("bytes") > most_bytes, cut).otherwise(F.col("_whole")).alias("context"))


def merge_extracts(replies: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per question: the first overview that is not blank (by book), entries kept and dropped, and books whose call failed.

    replies: (question, book, overview, failed); entries: (question, book, reason) as validate_extracts marks them.
    """
    blank = F.trim(F.coalesce("overview", F.lit(""))) == ""
    heads = replies.groupBy("question").agg(F.min_by("overview", F.when(~blank, F.col("book"))).alias("overview"), F.count_if("failed").alias("failed"))
    counts = entries.groupBy("question").agg(F.count_if(F.col("reason").isNull()).alias("entries"), F.count_if(F.col("reason").isNotNull()).alias("dropped"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return heads.join(counts, "question", "left").select("question", "overview", zero("entries"), zero("dropped"), "failed")


def event_stream(sources: DataFrame, deltas: DataFrame, ends: DataFrame) -> DataFrame:
    """(question, seq, event) of a server-sent stream: the sources, then the text as it came, then done or an error.

    sources: (question, sources as JSON); deltas: (question, place, text); ends: (question, error).
    """
    data = lambda s: F.concat(F.lit("data: "), F.to_json(s), F.lit("\n\n"))
    head = sources.select("question", F.lit(0).cast("bigint").alias("seq"), F.concat(F.lit("event: sources\ndata: "), F.col("sources"), F.lit("\n\n")).alias("event"))
    body = deltas.select("question", (F.col("place") + 1).cast("bigint").alias("seq"), data(F.struct("text")).alias("event"))
    last = deltas.groupBy("question").agg((F.max("place") + 2).cast("bigint").alias("_n"))
    tail = ends.join(last, "question", "left").select(
        "question", F.coalesce("_n", F.lit(1).cast("bigint")).alias("seq"),
        F.when(F.col("error").isNull(), F.lit("event: done\ndata: {}\n\n")).otherwise(F.concat(F.lit("event: error\n"), data(F.struct("error")))).alias("event"),
    )
    return head.unionAll(body).unionAll(tail)


def translate(rows: DataFrame, key: str, text: str, model: Callable[[str], str], batch: int = 20, most_bytes: int = 200) -> DataFrame:
    """(key, translated): names in numbered batches to a model that answers a numbered line for each.

    Numbering is stripped; empty and overlong lines, and those of a batch whose call failed, are left out, to be asked again.
    """
    import pandas as pd

    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keys, found = [], []
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                try:
                    reply = model("\n".join(f"{i}. {t}" for i, t in enumerate(part[text], 1)))
                except Exception:
                    continue
                lines = [x.strip() for x in reply.splitlines() if x.strip()]
                for k, line in zip(part[key], lines):
                    keys.append(k)
                    found.append(line.lstrip("0123456789.) "))
            yield pd.DataFrame({key: keys, "translated": found})

    some = rows.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select(key, text)
    out = some.mapInPandas(run, f"{key} {kind}, translated string").withColumn("translated", F.trim(honorifics_of_names(F.col("translated"))))
    return out.where((F.col("translated") != "") & (F.octet_length("translated") < most_bytes))


def translate_pending(rows: DataFrame, key: str, text: str, model: Callable[[str], str], path: str, chunk: int = 200) -> int:
    """Translates what path has no result for, chunk by chunk; each chunk is stored before the next begins, so a restart goes on there.

    Returns how many chunks were stored. What a model leaves out in a chunk is not asked again in the same run.
    """
    spark, chunks = rows.sparkSession, 0
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, translated string"
    try:
        done = spark.read.schema(schema).parquet(path)
        done.limit(1).count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = spark.createDataFrame([], schema)
    pending = rows.join(done.select(key), key, "left_anti")
    parts = max(1, -(-pending.count() // chunk))
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    for i in range(parts):
        translate(pending.where(part == i), key, text, model).write.mode("append").parquet(path)
        chunks += 1
    return chunks
