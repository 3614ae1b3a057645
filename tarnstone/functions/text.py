"""Column functions over text, paths and identifiers. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[A-Za-z0-9_]+"

#: A path's category is the first of these directories that it starts with or contains.
CATEGORIES = (
    ("NeteaseGuide", "NeteaseGuide"),
    ("QuModDocs", "QuMod"),
    ("BedrockWiki", "Wiki"),
    ("接口", "API"),
    ("事件", "Event"),
    ("枚举值", "Enum"),
    ("beta", "Beta"),
)
#: Categories that have an index; rows of others are not searched.
INDEXED = ("API", "Event", "Enum", "Wiki", "QuMod", "NeteaseGuide")
#: File extensions and their media types.
MEDIA_TYPES = {
    "txt": "text/plain", "html": "text/html", "htm": "text/html", "css": "text/css", "js": "application/javascript",
    "json": "application/json", "xml": "application/xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
    "gif": "image/gif", "svg": "image/svg+xml", "pdf": "application/pdf", "zip": "application/zip", "mp3": "audio/mpeg",
    "mp4": "video/mp4", "wav": "audio/wav", "md": "text/markdown",
}


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, and nothing else."""
    return F.translate(c, UPPER, LOWER)


def tokenize_en(c: Column) -> Column:
    """ASCII word runs in lower case, in order, repeats kept. Runs are cut before lowering, so folding makes no tokens."""
    return F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), F.lower)  # a run is ASCII, where lower folds A-Z alone


def normalize_tokens(tokens: Column) -> Column:
    return F.array_distinct(F.transform(tokens, ascii_lower))


def looks_english(c: Column) -> Column:
    """Has an ASCII word character and nothing outside ASCII."""
    return c.rlike("[A-Za-z0-9_]") & ~c.rlike(r"[^\x00-\x7F]")


def precise_identifier(c: Column, letters: int = 12) -> Column:
    """Only word characters, at least so many letters, both cases."""
    only = F.regexp_replace(c, "[^A-Za-z]", "")
    return c.rlike("^[A-Za-z0-9_]+$") & (F.length(only) >= letters) & c.rlike("[A-Z]") & c.rlike("[a-z]")


def longest_identifier(c: Column, needle: str = "Event") -> Column:
    """The longest word that starts with a capital and contains needle; the first among equals; null if there is none."""
    words = F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))
    fit = F.transform(words, lambda w, i: F.struct(F.when(w.rlike("^[A-Z]") & F.contains(w, F.lit(needle)), F.length(w)).otherwise(0).alias("n"), (-i).alias("at"), w.alias("w")))
    best = F.array_max(fit)
    return F.when(best["n"] > 0, best["w"])


def classify_path(path: Column) -> Column:
    out = F.lit("Unknown")
    for name, category in reversed(CATEGORIES):
        out = F.when(F.startswith(path, F.lit(f"{name}/")) | F.contains(path, F.lit(f"/{name}/")), F.lit(category)).otherwise(out)
    return out


def extension(path: Column) -> Column:
    return ascii_lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def media_type(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("application/octet-stream"))


def unsafe_path(path: Column) -> Column:
    return F.contains(path, F.lit(".."))


def snippet(c: Column, n: int = 300) -> Column:
    """The first n characters with dots after them, if the text has more bytes than n."""
    return F.when(F.octet_length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def truncate_value(c: Column, n: int = 120) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 3)), F.lit("..."))).otherwise(c)


def elide_lines(c: Column, most: int = 20, head: int = 12, tail: int = 6) -> Column:
    lines = F.split(c, "\n", -1)
    n = F.size(lines)
    short = F.concat(F.slice(lines, 1, head), F.array(F.concat(F.lit("... ("), (n - head - tail).cast("string"), F.lit(" lines omitted) ..."))), F.slice(lines, n - tail + 1, F.lit(tail)))
    return F.when(n > most, F.array_join(short, "\n")).otherwise(c)


def snake_case(c: Column) -> Column:
    return F.translate(c, UPPER + " -", LOWER + "__")


def pascal_case(c: Column) -> Column:
    """Each part between underscore, hyphen and space with a capital first letter, joined."""
    parts = F.split(F.translate(c, "_-", "  "), " ", -1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.translate(F.left(p, F.lit(1)), LOWER, UPPER), F.substr(p, F.lit(2)))), "")


def path_score(path: Column, keyword: str, tokens: list[str]) -> Column:
    """10 if the path contains the keyword, and 3 for each token it contains, repeated tokens again."""
    low = ascii_lower(path)
    score = F.when(F.contains(low, ascii_lower(F.lit(keyword))), 10).otherwise(0)
    for t in tokens:
        score = score + F.when(F.contains(low, F.lit(t)), 3).otherwise(0)
    return score.cast("double")


def identifier_score(ident: Column, query: str) -> Column:
    """1000 less the surplus length for a prefix, 600 less the position for a substring, else null."""
    q = query.translate(str.maketrans(UPPER, LOWER))
    low = ascii_lower(ident)
    at = F.instr(low, q)
    return F.when(at == 1, F.lit(1000) - (F.length(low) - len(q))).when(at > 1, F.lit(600) - (at - 1)).cast("double")


def pos_rule(word: Column) -> Column:
    """The tag of a word outside the dictionary: x without ASCII, m for digits alone, else eng."""
    return F.when(~word.rlike(r"[\x00-\x7F]"), "x").when(word.rlike("^[0-9]+$"), "m").otherwise("eng")


def regex_or_substring(c: Column, keyword: str) -> Column:
    """Case-blind regular expression search, or plain search where the keyword is no expression."""
    import re

    try:
        re.compile(keyword)
    except re.error:
        return F.contains(c, F.lit(keyword))
    return c.rlike(f"(?i){keyword}")
