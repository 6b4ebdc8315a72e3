"""Scalar text functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that normalisation drops, letters that it folds, and the letters it keeps: fixed values.
MARKS = "[ً-ٰٟـؐ-ؚ]"
MARKS_OF_VERSE = "[ً-ٰٟـؐ-ؚۖ-ۭ]"
FOLD_FROM, FOLD_TO = "أإآٱةى", "ااااهي"
LETTERS = "ؠ-ي"
FATHER_FORMS, FATHER = ("ابي", "ابى", "ابا"), "ابو"
MOTHER_FORMS, MOTHER = ("امي", "اما"), "ام"
SON = " بن "
#: Relative references: word, patronymic segment that names the person (or none), prefix otherwise: fixed values.
RELATIVES = (
    ("ابي", 2, "ابو"),
    ("ابيه", 2, "ابو"),
    ("ابيها", 2, "ابو"),
    ("جده", 3, "جد"),
    ("عمه", None, "عم"),
    ("امه", None, "ام"),
    ("اخيه", None, "اخ"),
)
#: HTML entities that previews decode, in this order: fixed values.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"))
#: What marks a value as made up: fixed values.
SYNTHETIC_PREFIXES = ("synthetic_", "placeholder_", "fake_", "test_", "dummy_", "generated_", "auto_")
SYNTHETIC_VALUES = ("null", "undefined", "n/a", "none", "unknown")
SYNTHETIC_PARTS = ("fake", "fabricat", "forged")
#: Phrases that the honorific sign stands for, in the order of their replacement: fixed values.
SIGN = "ﷺ"
PHRASES = (("PBUH", SIGN), ("pbuh", SIGN), ("peace be upon him", SIGN), ("Peace be upon him", SIGN))
PHRASES_OF_NAMES = (*PHRASES, ("Peace Be Upon Him", SIGN))
TITLES = (("Allah's Apostle", f"Allah's Messenger ({SIGN})"), ("Allah's Messenger", f"Allah's Messenger ({SIGN})"), (f"({SIGN}) ({SIGN})", f"({SIGN})"))
#: Codes of record types and their terms: fixed values.
RECORD_TYPES = (("elevated", "مرفوع"), ("stopped", "موقوف"), ("sacred", "قدسي"), ("severed", "مقطوع"))
#: What an English text that names its speaker begins with: fixed values.
SPEAKER_CUES = ("Narrated ", "It is narrated on the authority of ")
#: Tags that a note may keep: fixed values.
NOTE_TAGS = ("b", "strong", "i", "em", "u", "s", "h2", "h3", "blockquote", "ul", "ol", "li", "hr", "br", "p", "div")
#: Standalone feature tags and the pairs they stand for: fixed values.
FEATURE_TAGS = {
    "M": {"gender": "M"}, "F": {"gender": "F"},
    "MS": {"gender": "M", "number": "S"}, "FS": {"gender": "F", "number": "S"},
    "MD": {"gender": "M", "number": "D"}, "FD": {"gender": "F", "number": "D"},
    "MP": {"gender": "M", "number": "P"}, "FP": {"gender": "F", "number": "P"},
    "NOM": {"case": "NOM"}, "GEN": {"case": "GEN"}, "ACC": {"case": "ACC"},
    "PERF": {"aspect": "PERF"}, "IMPF": {"aspect": "IMPF"}, "IMPV": {"aspect": "IMPV"}, "PASS": {"voice": "PASS"},
    "ACT_PCPL": {"derivation": "ACT_PCPL"}, "PASS_PCPL": {"derivation": "PASS_PCPL"},
    "ADJ": {"type": "ADJ"}, "PN": {"type": "PN"}, "PRON": {"type": "PRON"}, "REL": {"type": "REL"},
    "DEM": {"type": "DEM"}, "CONJ": {"type": "CONJ"}, "DET": {"type": "DET"}, "NV": {"type": "NV"},
    "PREF": {"affix": "PREF"}, "SUFF": {"affix": "SUFF"},
}


def collapse(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _folded(text: Column, marks: str) -> Column:
    return F.translate(F.regexp_replace(text, marks, ""), FOLD_FROM, FOLD_TO)


def fold_kinship(text: Column) -> Column:
    """Case forms of father and mother names become the base form, except in the last word."""
    words = F.split(text, " ")

    def base(w: Column, i: Column) -> Column:
        inner = i < F.size(words) - 1
        return F.when(inner & w.isin(*FATHER_FORMS), FATHER).when(inner & w.isin(*MOTHER_FORMS), MOTHER).otherwise(w)

    return F.array_join(F.transform(words, base), " ")


def normalize_name(text: Column) -> Column:
    """Letters and single spaces only, variants folded, kinship forms folded. Not idempotent for nested forms."""
    return fold_kinship(collapse(F.regexp_replace(_folded(text, MARKS), f"[^{LETTERS} ]", "")))


def normalize_spaceless(text: Column) -> Column:
    return F.regexp_replace(_folded(text, MARKS), f"[^{LETTERS}]", "")


def strip_diacritics(text: Column) -> Column:
    """As normalize_name, with verse marks dropped and kinship forms kept."""
    return collapse(F.regexp_replace(_folded(text, MARKS_OF_VERSE), f"[^{LETTERS} ]", ""))


def normalize_quote(text: Column) -> Column:
    """For verbatim comparison: no elongation or vowel marks, white space collapsed."""
    return collapse(F.regexp_replace(text, "[ـً-ْ]", ""))


def remove_marks(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Mn}", "")


def fold_letters(text: Column) -> Column:
    """Variants of letters folded and marks dropped; all other characters stay, white space collapsed."""
    return collapse(_folded(text, MARKS_OF_VERSE))


def name_slug(text: Column) -> Column:
    return F.replace(normalize_name(text), F.lit(" "), F.lit("_"))


def latin_slug(text: Column) -> Column:
    """Lower-case letters and digits, anything between as one dash."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def strip_tags(text: Column) -> Column:
    """Without <...>; an unmatched < takes the rest, a stray > goes."""
    return F.replace(F.regexp_replace(text, r"<[^>]*(>|$)", ""), F.lit(">"), F.lit(""))


def parse_list_literal(text: Column) -> Column:
    """The strings of a literal like ['a', 'b']."""
    inner = F.regexp_replace(F.trim(text), r"^\[|\]$", "")
    parts = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", ""))
    return F.filter(parts, lambda x: x != "")


def quoted_items(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("'([^']+)'"), F.lit(1))


def replace_all(text: Column, pairs) -> Column:
    """Literal replacements in the given order."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def honorifics(text: Column) -> Column:
    """English texts: one title for the messenger with its sign once, and the sign for the phrases it stands for."""
    return replace_all(replace_all(text, TITLES), PHRASES)


def honorifics_of_names(text: Column) -> Column:
    return replace_all(text, PHRASES_OF_NAMES)


def code_name(code: Column, names=RECORD_TYPES) -> Column:
    """The term of a code; an unknown code stays."""
    out = code
    for key, name in reversed(list(names)):
        out = F.when(code == key, F.lit(name)).otherwise(out)
    return out


def speaker(text: Column, most_bytes: int = 100) -> Column:
    """The name between a text's opening cue and its first colon, of fewer than most_bytes bytes; null without one."""
    name = F.trim(F.regexp_extract(F.trim(text), "(?s)^(?:" + "|".join(SPEAKER_CUES) + ")([^:]*):", 1))
    return F.when((name != "") & (F.octet_length(name) < most_bytes), name)


def line_numbers(reply: Column) -> Column:
    """Numbers of a model's reply, whichever way it lists them: numbers, strings, objects with line_num or line, or one string with commas.

    What is none of these is skipped; anything but a list or a string gives none.
    """
    whole = r"^\s*\d+\s*$"
    parsed = F.when(F.trim(reply).startswith("["), F.from_json(reply, "array<string>"))

    def number(x: Column) -> Column:
        inner = F.coalesce(F.get_json_object(x, "$.line_num"), F.get_json_object(x, "$.line"))
        return F.when(x.rlike(whole), F.trim(x).try_cast("bigint")).when(inner.rlike(r"^\d+$"), inner.try_cast("bigint"))

    text = F.when(F.trim(reply).startswith('"'), F.from_json(F.concat(F.lit('{"x":'), reply, F.lit("}")), "x string")["x"])
    some = F.coalesce(F.transform(parsed, number), F.transform(F.split(text, ","), lambda x: F.when(x.rlike(whole), F.trim(x).try_cast("bigint"))))
    return F.coalesce(F.filter(some, lambda n: n.isNotNull()), F.array().cast("array<bigint>"))


def leading_number(text: Column) -> Column:
    return F.regexp_extract(text, r"^(\d+)", 1).try_cast("bigint")


def arabic_digits(text: Column) -> Column:
    return F.translate(text, "٠١٢٣٤٥٦٧٨٩", "0123456789")


def parse_generation(text: Column, strict: bool = False) -> Column:
    """A generation's number, else its keyword: companions 1, followers 3 (2 if strict), their followers 3."""
    low = F.lower(F.trim(text))
    number = F.regexp_replace(low, r"\?+$", "").try_cast("int")
    word = F.when(low.contains("sahab"), 1)
    if strict:
        word = word.when(low.rlike("tabi.*tabi"), 3).when(low.contains("tabi"), 2)
    else:
        word = word.when(low.contains("tabi"), 3)
    return F.coalesce(number, word)


def verse_key(text: Column) -> Column:
    """'s:a' or 's_a' with two positive numbers as 's_a'; anything else null."""
    s, a = (F.regexp_extract(text, r"^(\d+)[:_](\d+)$", i).try_cast("int") for i in (1, 2))
    return F.when((s > 0) & (a > 0), F.concat_ws("_", s, a))


def cross_reference_key(text: Column) -> Column:
    """'SB-HD0001' as 'sb_1'."""
    prefix, number = (F.regexp_extract(text, r"^([A-Za-z]+)-HD(\d+)$", i) for i in (1, 2))
    return F.when(prefix != "", F.concat_ws("_", F.lower(prefix), number.try_cast("int")))


def is_relative(word: Column) -> Column:
    return word.isin(*[r[0] for r in RELATIVES])


def resolve_relative(word: Column, referent: Column) -> Column:
    """Whom 'his father', 'his grandfather' and the like mean, given the person they relate to."""
    name = normalize_name(referent)
    parts = F.split(name, SON)
    out = F.lit(None).cast("string")
    for relative, segment, prefix in reversed(RELATIVES):
        made = F.concat(F.lit(prefix + " "), name)
        if segment:
            made = F.coalesce(F.get(parts, F.lit(segment - 1)), made)
        out = F.when(word == relative, made).otherwise(out)
    return out


def parse_features(text: Column) -> Column:
    """'K:V|TAG|...' as a map; later entries win, bare S, P and D only where no number is set yet."""
    pair = "struct<k:string,v:string>"

    def pairs(part: Column, have: Column) -> Column:
        colon = F.instr(part, ":")
        out = F.array(F.struct(part.alias("k"), F.lit("true").alias("v")))
        digit = part.rlike("^[0-9].")
        person = F.struct(F.lit("person").alias("k"), F.substring(part, 1, 1).alias("v"))
        second, third = F.substring(part, 2, 1), F.substring(part, 3, 1)
        number = lambda v: F.struct(F.lit("number").alias("k"), v.alias("v"))
        gender = F.struct(F.lit("gender").alias("k"), second.alias("v"))
        out = F.when(
            digit,
            F.when(F.length(part) >= 3, F.array(person, gender, number(third))).otherwise(F.array(person, number(second))),
        ).otherwise(out)
        bare = part.isin("S", "P", "D") & ~F.exists(have, lambda h: h["k"] == "number")
        out = F.when(bare, F.array(number(part))).otherwise(out)
        for tag, values in FEATURE_TAGS.items():
            known = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in values.items()])
            out = F.when(part == tag, known).otherwise(out)
        keyed = F.array(F.struct(F.substring_index(part, ":", 1).alias("k"), F.substring(part, colon + 1, F.length(part)).alias("v")))
        return F.when(colon > 0, keyed).otherwise(out)

    all_pairs = F.aggregate(
        F.split(text, r"\|"), F.array().cast(f"array<{pair}>"), lambda have, part: F.concat(have, pairs(part, have))
    )
    last = F.filter(
        all_pairs, lambda x, i: ~F.exists(F.slice(all_pairs, i + 2, F.greatest(F.size(all_pairs) - i - 1, F.lit(0))), lambda y: y["k"] == x["k"])
    )
    return F.map_from_entries(last)


def text_windows(text: Column, sizes: tuple[int, ...] = (40, 30, 20, 15, 10)) -> Column:
    """Keys of a text in order of preference: for each size its end, then its middle, where it is long enough."""
    n = F.length(text)
    keys = []
    for k in sizes:
        keys.append(F.when(n > k, F.struct(F.lit(k).alias("size"), F.lit(0).alias("kind"), F.substring(text, -k, k).alias("key"))))
        start = F.floor(n / 2) - k // 2
        middle = F.substring(text, (start + 1).cast("int"), F.lit(2 * (k // 2)))
        keys.append(F.when(n > 2 * k, F.struct(F.lit(k).alias("size"), F.lit(1).alias("kind"), middle.alias("key"))))
    return F.filter(F.array(*keys), lambda x: x.isNotNull())


def clamp_scale(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def rrf_term(rank: Column, k: int = 60) -> Column:
    return 1.0 / (k + rank)


def decode_entities(text: Column) -> Column:
    return replace_all(text, ENTITIES)


def open_graph(html: Column, name: str) -> Column:
    """A meta property's content, whichever attribute comes first; null where absent."""
    forward = F.regexp_extract(html, f'<meta[^>]+property="{name}"[^>]+content="([^"]*)"', 1)
    backward = F.regexp_extract(html, f'<meta[^>]+content="([^"]*)"[^>]+property="{name}"', 1)
    return decode_entities(F.coalesce(F.nullif(forward, F.lit("")), F.nullif(backward, F.lit(""))))


def html_title(html: Column) -> Column:
    return decode_entities(F.nullif(F.regexp_extract(html, "<title[^>]*>([^<]*)</title>", 1), F.lit("")))


def domain(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "^https?://([^/]*)", 1), F.lit(""))


def iso_utc(epoch_seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch_seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_synthetic(value: Column) -> Column:
    low = F.lower(value)
    found = low.isin(*SYNTHETIC_VALUES)
    for p in SYNTHETIC_PREFIXES:
        found = found | low.startswith(p)
    for p in SYNTHETIC_PARTS:
        found = found | low.contains(p)
    return found


def keyword_class(text: Column, rules, default=None) -> Column:
    """The class of the first rule (class, keywords) with a keyword in the text."""
    out = F.lit(default)
    for name, words in reversed(list(rules)):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(text), F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def truncate_chars(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def truncate_words(text: Column, n: int) -> Column:
    """The first n words, cut back to the last full stop if there is one."""
    words = F.split(collapse(text), " ")
    short = F.array_join(F.slice(words, 1, n), " ")
    stop = F.length(short) - F.instr(F.reverse(short), ".") + 1
    return F.when(F.size(words) <= n, text).otherwise(F.when(F.instr(short, ".") > 0, F.substring(short, F.lit(1), stop)).otherwise(short))


def truncate_bytes(text: Column, n: int) -> Column:
    """The longest beginning of at most n UTF-8 bytes that ends between characters."""
    data = F.encode(text, "UTF-8")
    cut = F.substring(data, 1, n)
    # a cut inside a character leaves 1 to 3 of its bytes, which then fail to decode alike
    clean = F.coalesce(*[F.try_validate_utf8(F.substring(data, F.lit(1), F.lit(n - k)).cast("string")) for k in range(4)])
    return F.when(F.octet_length(text) <= n, text).otherwise(F.coalesce(clean, cut.cast("string")))


def chunks(text: Column, size: int = 1500, overlap: int = 200) -> Column:
    """Windows of `size` characters, each starting `overlap` before the last one's end."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))


def mentions(text: Column) -> Column:
    """@s:a, @x:n and @narrator:id mentions and URLs of a note, in order."""
    return F.regexp_extract_all(text, F.lit(r"(@[A-Za-z0-9_]+:[A-Za-z0-9_]+|https?://[^\s<>]+)"), F.lit(1))


def mention_kind(mention: Column) -> Column:
    """What a mention names: a verse, a narrator, another record, or an address."""
    return (
        F.when(mention.rlike(r"^@\d+:\d+$"), "ayah").when(mention.startswith("@narrator:"), "narrator")
        .when(mention.startswith("@"), "hadith").otherwise("url")
    )


def has_markup(text: Column) -> Column:
    """Whether a note was stored as HTML."""
    return text.rlike(r"(?i)<(" + "|".join(NOTE_TAGS) + r")\b")


def safe_markup(html: Column) -> Column:
    """Tags that a note may keep, in lower case and without attributes; other tags go, their text stays."""
    listed = "|".join(NOTE_TAGS)
    kept = F.regexp_replace(html, rf"(?i)<(/?)(?!(?:{listed})\b)[a-z][a-z0-9]*\b[^>]*>", "")
    for tag in NOTE_TAGS:
        kept = F.regexp_replace(F.regexp_replace(kept, rf"(?i)<{tag}\b[^>]*>", f"<{tag}>"), rf"(?i)</{tag}\b[^>]*>", f"</{tag}>")
    return kept


def split_label(name: Column) -> Column:
    """(file, label) of a name like file|label; no label without a bar."""
    at = F.instr(name, "|")
    return F.struct(
        F.substring_index(name, "|", 1).alias("file"), F.when(at > 0, F.substring(name, at + 1, F.length(name))).otherwise(F.lit("")).alias("label")
    )


def first_slash(path: Column, by: str = "_=_") -> Column:
    """The path with its first slash alone replaced."""
    at = F.instr(path, "/")
    return F.when(at > 0, F.concat(F.substring(path, F.lit(1), at - 1), F.lit(by), F.substring(path, at + 1, F.length(path)))).otherwise(path)


def page_to_html(text: Column) -> Column:
    """Paragraphs of a page, with what follows a line of underscores as its footnotes."""
    parts = F.split(text, r"\n_{3,}\n", 2)
    paragraphs = lambda x, tag: F.array_join(F.transform(F.split(x, "\n"), lambda p: F.concat(F.lit(f"<{tag}>"), p, F.lit(f"</{tag}>"))), "")
    return F.concat(paragraphs(parts[0], "p"), F.when(F.size(parts) > 1, paragraphs(F.get(parts, F.lit(1)), "small")).otherwise(F.lit("")))


def tokenize(text: Column, lower: bool = False) -> Column:
    """Runs of letters, of digits, or of anything else but white space."""
    source = F.lower(text) if lower else text
    return F.regexp_extract_all(source, F.lit(r"(\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)"), F.lit(1))


def verse_ranges(heading: Column) -> Column:
    """The verses of a bracketed reference like [2:5-7]; a single one where no end is given."""
    a, b = F.regexp_extract(heading, r"\[\d+:(\d+)", 1).try_cast("int"), F.regexp_extract(heading, r"\[\d+:\d+-(\d+)\]", 1).try_cast("int")
    return F.when(a.isNotNull(), F.sequence(a, F.greatest(a, F.coalesce(b, a))))


def heading_verses(title: Column) -> Column:
    """(surah, ayah) of each verse that a chapter heading in brackets names: one verse, or a range; null without a reference."""
    digits = arabic_digits(title)
    head = r"\[سورة\s+.+?\s*\((\d+)\)\s*:\s*"
    part = lambda tail, i: F.regexp_extract(digits, head + tail, i).try_cast("int")
    range_of, single = r"الآيات\s+(\d+)\s*إلى\s*(\d+)\]", r"(?:آية|الآيات)\s+(\d+)\]"
    surah = F.coalesce(part(range_of, 1), part(single, 1))
    first, last = F.coalesce(part(range_of, 2), part(single, 2)), F.coalesce(part(range_of, 3), part(single, 2))
    every = F.transform(F.when(first <= last, F.sequence(first, last)), lambda a: F.struct(surah.alias("surah"), a.alias("ayah")))
    return F.when(surah.isNotNull(), every)


def trailing_verse(text: Column) -> Column:
    """The number in round brackets before a closing verse bracket."""
    return F.regexp_extract(arabic_digits(text), r"\((\d+)\)\s*﴾", 1).try_cast("int")


def numbered_name(title: Column) -> Column:
    """(number, name) of a heading like [12] (sign) name."""
    pattern = r"^\[(\d+)\]\s*(?:\([^)]*\)\s*)?(.+)"
    number = F.regexp_extract(title, pattern, 1).try_cast("int")
    return F.when(number.isNotNull(), F.struct(number.alias("number"), F.trim(F.regexp_extract(title, pattern, 2)).alias("name")))


def marked_numbers(text: Column) -> Column:
    """All numbers of markers like [الحديث 12, vowel marks aside."""
    plain = F.regexp_replace(arabic_digits(text), MARKS_OF_VERSE, "")
    return F.transform(F.regexp_extract_all(plain, F.lit(r"\[الحديث\s*(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
