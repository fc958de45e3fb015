"""Scalar text expressions. Every function takes and returns columns; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that only Turkish has, of the two languages.
TURKISH_LETTERS = "çğıöşüÇĞİÖŞÜ"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_hash(text) -> Column:
    """sha256:<hex> of the text as it is."""
    return F.concat(F.lit("sha256:"), F.sha2(_c(text), 256))


def scope_hash(texts) -> Column:
    """Hash of an ordered array of texts joined by NUL."""
    return F.sha2(F.array_join(_c(texts), "\0"), 256)


def words(text) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(_c(text), r"[\s\u0085 ]+"), lambda w: w != "")


def token_count(text) -> Column:
    """Words; 0 for null or blank text."""
    return F.coalesce(F.size(words(text)), F.lit(0))


def normal_line(text) -> Column:
    """White space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(_c(text), r"\s+", " ")))


def turkish_fold(text) -> Column:
    """Lower case with dotted and dotless i kept apart."""
    return F.lower(F.translate(_c(text), "Iİ", "ıi"))


#: Punctuation that is stripped from the edges of words.
EDGES = ".,;:!?()[]{}\"'`«»"


def content_tokens(text) -> Column:
    """Words in lower case without punctuation at their edges, if a letter or digit is left: decimals and part numbers stay whole."""
    bare = F.transform(words(F.lower(_c(text))), lambda w: F.trim(w, F.lit(EDGES)))
    return F.filter(bare, lambda w: w.rlike(r"[\p{L}\p{N}]"))


def digit_runs(text) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_c(text), F.lit(r"\d+"), F.lit(0))))


def slug(text) -> Column:
    """Heading anchor: lower case, word characters, blanks as hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(text))), r"(?U)[^\w\s-]", ""), r"\s", "-")


def item_slug(text) -> Column:
    """Lower case, letters, digits and dots, other runs as one underscore; 'unknown' if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(_c(text)), r"(?U)[^\p{L}\p{N}.]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("unknown"))


def attr_id(text) -> Column:
    """Trailing {#id}, or null."""
    return F.nullif(F.regexp_extract(_c(text), r"\{#([^}\s]+)\}\s*$", 1), F.lit(""))


def pipe_cells(line) -> Column:
    """Cells of a table row between pipes; an escaped pipe belongs to its cell."""
    inner = F.regexp_replace(F.trim(F.replace(_c(line), F.lit("\\|"), F.lit("\x01"))), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda x: F.trim(F.replace(x, F.lit("\x01"), F.lit("|"))))


def heading_number(text) -> Column:
    """Leading dotted number as an array of int, or null."""
    found = F.regexp_extract(_c(text), r"^\s*(\d{1,3}(?:\.\d{1,3})*)\.?\s+\S", 1)
    return F.when(found != "", F.transform(F.split(found, r"\."), lambda x: x.cast("int")))


def is_page_number(text) -> Column:
    return _c(text).rlike(r"(?i)^\s*(?:page|sayfa|s\.)?\s*\d{1,4}(?:\s*(?:/|of)\s*\d{1,4})?\s*$")


def toc_entry(text) -> Column:
    """struct(title, page) of a contents line, which ends in a page number, with or without dots before it; null for other lines."""
    title = F.rtrim(F.regexp_replace(F.rtrim(F.regexp_extract(_c(text), r"(?s)^(.*?)(\d+)\s*$", 1)), r"[.\s]{2,}$", ""))
    page = F.regexp_extract(_c(text), r"(\d+)\s*$", 1)
    return F.when((page != "") & (title != ""), F.struct(title.alias("title"), page.try_cast("int").alias("page")))


def product_codes(text, pattern: str = r"\b([a-z]{2,5}-\d{2,6}[a-z0-9-]*)\b") -> Column:
    """Distinct codes in order of first appearance, upper case: group 1 of the configured pattern, in any case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_c(text), F.lit(f"(?i){pattern}"), F.lit(1)), F.upper))


def numeric(text) -> Column:
    """Number of '20', ' 20.5 ' or '20,5'; null otherwise."""
    bare = F.trim(_c(text))
    return F.coalesce(bare.try_cast("double"), F.when(bare.rlike(r"^[+-]?\d+,\d+$"), F.replace(bare, F.lit(","), F.lit(".")).try_cast("double")))


def base_name(path) -> Column:
    return F.element_at(F.split(F.replace(_c(path), F.lit("\\"), F.lit("/")), "/"), -1)


def page_label(first, last) -> Column:
    """'4', '4-6', or null."""
    return F.when(_c(first).isNull(), None).when(_c(last).isNull() | (_c(first) == _c(last)), _c(first).cast("string")).otherwise(F.concat_ws("-", _c(first), _c(last)))


def section_label(path) -> Column:
    return F.array_join(_c(path), " > ")


def breadcrumb(path, last: int | None = None) -> Column:
    """**A > B**, of the last levels only if asked; empty for no path."""
    shown = _c(path) if last is None else F.slice(_c(path), F.greatest(F.lit(1), F.size(_c(path)) - last + 1), last)
    return F.when(F.size(_c(path)) > 0, F.concat(F.lit("**"), F.array_join(shown, " > "), F.lit("**"))).otherwise("")


def embed_text(path, text) -> Column:
    return F.when(F.size(_c(path)) > 0, F.concat_ws("\n\n", section_label(path), _c(text))).otherwise(_c(text))


def sentences(text) -> Column:
    return F.filter(F.split(F.trim(_c(text)), r"(?<=[.!?…])\s+"), lambda s: s != "")


# Frequent words that tell Turkish from English.
TURKISH_WORDS = ["ne", "nedir", "nasil", "nasıl", "hangi", "kac", "kaç", "icin", "için", "var", "yok", "mi", "mı", "mu", "mü", "bana", "lutfen", "lütfen", "bir", "bu", "su", "şu", "ile", "ve", "veya", "degil", "değil", "olan", "olur", "gibi", "daha", "en", "urun", "ürün", "fiyat", "teklif", "belge", "dosya", "ozellik", "özellik", "karsilastir", "karşılaştır", "goster", "göster", "listele", "istiyorum", "lazim", "lazım", "merhaba", "selam", "tesekkur", "teşekkür", "evet", "hayir", "hayır", "tamam", "tabii", "tabi", "peki", "hem", "de", "ama", "sonra", "simdi", "şimdi"]
ENGLISH_WORDS = ["what", "which", "how", "many", "much", "is", "are", "the", "a", "an", "do", "does", "can", "could", "would", "you", "i", "me", "my", "we", "our", "for", "with", "and", "or", "not", "of", "to", "in", "on", "it", "this", "that", "please", "need", "want", "show", "list", "send", "give", "tell", "about", "between", "compare", "price", "quote", "document", "file", "spec", "specs", "feature", "features", "hello", "hi", "thanks", "thank", "yes", "yeah", "yep", "no", "nope", "ok", "okay", "sure", "sounds", "good", "got", "right", "correct", "also", "then", "but", "more", "another", "other", "one", "both"]


def detect_language(text, turkish: list[str] = TURKISH_WORDS, english: list[str] = ENGLISH_WORDS) -> Column:
    """tr or en: a special letter is Turkish, else the language with more known words; ties, and text without words, are tr."""
    low = F.transform(F.regexp_extract_all(_c(text), F.lit("[a-zA-Z]+"), F.lit(0)), F.lower)
    hits = lambda known: F.size(F.filter(low, lambda w: w.isin(known)))
    return F.when(_c(text).rlike(f"[{TURKISH_LETTERS}]"), "tr").when(hits(english) > hits(turkish), "en").otherwise("tr")


def degenerate(text) -> Column:
    """Long text that is one unit over and over, or many words with few distinct ones."""
    w = words(F.lower(_c(text)))
    looped = _c(text).rlike(r"(?s)(.{3,60}?)\1{19,}")
    poor = (F.size(w) >= 60) & (F.size(F.array_distinct(w)) <= F.greatest(F.lit(4), F.floor(F.size(w) / 25)))
    return (F.length(_c(text)) >= 200) & (looped | poor)


def garbage(text, share: float = 0.6) -> Column:
    """One character other than white space makes up most of the text."""
    bare = F.regexp_replace(_c(text), r"\s", "")
    counts = F.transform(F.array_distinct(F.split(bare, "")), lambda c: F.length(bare) - F.length(F.replace(bare, c)))
    return (F.length(bare) >= 20) & (F.array_max(counts) > share * F.length(bare))


def version_behind(recorded, current) -> Column:
    """Null is behind; what is not a version is not; else by number, build suffix ignored."""
    parts = lambda v: F.transform(F.split(F.split_part(_c(v), F.lit("+"), F.lit(1)), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return F.when(_c(recorded).isNull(), True).when(~_c(recorded).rlike(r"^\d+(\.\d+)*"), False).otherwise(parts(recorded) < parts(current))


def remove_block(text, block) -> Column:
    """text without the first paragraph that equals block."""
    paragraphs = F.split(_c(text), "\n\n")
    at = F.array_position(paragraphs, _c(block))
    return F.when(at == 0, _c(text)).otherwise(F.array_join(F.concat(F.slice(paragraphs, F.lit(1), (at - 1).cast("int")), F.slice(paragraphs, (at + 1).cast("int"), F.size(paragraphs))), "\n\n"))


def snippet(text, limit: int = 280) -> Column:
    """White space collapsed; cut to limit characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(_c(text), r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 1), F.lit("…")))


def json_in_text(text) -> Column:
    """The text as JSON, else its fenced block, else its first {...}; null if none parses."""
    fenced = F.regexp_extract(_c(text), r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(_c(text), r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(_c(text)), F.try_parse_json(F.nullif(fenced, F.lit(""))), F.try_parse_json(F.nullif(braces, F.lit(""))))
