"""Text functions (sections 2.5 #1-2, 2.10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .repair import repair

#: ASCII punctuation, as in string.punctuation.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
MASK = "•" * 8


def clean(text: Column) -> Column:
    """Punctuation to spaces, lower case, white space collapsed; null is ''."""
    spaced = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), PUNCTUATION, " "))
    return F.trim(F.regexp_replace(spaced, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Words of the cleaned text of more than one character; split in one pass, at punctuation and white space alike."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[\s!-/:-@\[-`{-~]+"), lambda w: F.length(w) > 1)


def has_token(text: Column) -> Column:
    """Whether ``tokens`` would find any; reads no further than the first."""
    return F.coalesce(F.lower(text).rlike(r"(?U)[^\s!-/:-@\[-`{-~]{2}"), F.lit(False))


def word_set(text: Column) -> Column:
    """Distinct lower-cased words, split at white space alone."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two distinct arrays; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Shared members over those of the smaller array; 0 if one is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))


def contains(column: Column, needle: str, wildcards: bool = False) -> Column:
    """Case-insensitive contains; with ``wildcards``, % and _ in the needle match as in LIKE (2.2 #7)."""
    if wildcards:
        return F.lower(column).like(f"%{needle.lower()}%")
    return F.contains(F.lower(column), F.lit(needle.lower()))


def any_contains(needle: str, *columns: Column, tags: Column | None = None) -> Column:
    """Any of the columns, or any member of ``tags``, contains the needle (2.2 #16)."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(contains(c, needle), F.lit(False))
    return out | F.coalesce(F.exists(tags, lambda t: contains(t, needle)), F.lit(False)) if tags is not None else out


def steps_text(steps: Column) -> Column:
    """The JSON text of a list with quotes, brackets and commas as spaces, lower-cased (2.2 #9)."""
    return F.lower(F.regexp_replace(F.to_json(steps), r'["\[\],]', " "))


def word_matches(words: list[str], text: Column) -> Column:
    """How many of the words occur in the text as substrings (2.5 #15)."""
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(F.coalesce(text, F.lit(""))), w)))


def masked(value: Column, sensitivity: Column) -> Column:
    """Bullets for what is highly sensitive (2.2 #18)."""
    return F.when(sensitivity == "high", F.lit(MASK)).otherwise(value)


def preview(content: Column, size: int = 200, always: bool = False) -> Column:
    """The first characters; dots after them if there are more, or always if not empty (2.2 #19)."""
    cut = F.concat(F.substring(content, 1, size), F.lit("..."))
    if always:
        return F.when(F.length(content) > 0, cut).otherwise(F.lit(""))
    return F.when(F.length(content) > size, cut).otherwise(content)


def truncate(text: Column, limit: int, note: str = "... [truncated]") -> Column:
    """Cut at a limit with a note (2.10)."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(note))).otherwise(text)


def safe_name(name: Column) -> Column:
    """A file name without path parts or special characters (2.10)."""
    base = F.element_at(F.split(name, r"[/\\]"), -1)
    return F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_"), r"^\.+", "")


def short_id(*columns: Column, size: int = 4) -> Column:
    """A letter and further letters or digits, derived from the columns: the same input gives the same id (2.10)."""
    digest = F.md5(F.concat_ws("\u0001", *columns))
    return F.concat(F.substring(F.translate(digest, "0123456789", "ghijklmnop"), 1, 1), F.substring(digest, 2, size - 1))


def steps_list(text: Column) -> Column:
    """Lines, also parted by bars, trimmed, blank ones dropped (2.10)."""
    parts = F.transform(F.split(F.regexp_replace(text, r"\n", "|"), r"\|"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def path_text(path: Column) -> Column:
    return F.array_join(path, " > ")


def has_line_numbers(text: Column) -> Column:
    """Whether a content begins like ``Line 3:``, which edits refuse (2.10)."""
    return text.rlike(r"^\s*Line \d+:")


def prompt_text(ocr: Column, size: int = 1000) -> Column:
    """Recognised text for a prompt, or a remark (2.9 #5)."""
    return F.coalesce(F.nullif(F.substring(ocr, 1, size), F.lit("")), F.lit("(no text detected)"))


def token_estimate(text: Column) -> Column:
    """Tokens at four characters each, rounded up; the store's default counter (2.10)."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def history(role: Column, text: Column, position: Column) -> Column:
    """Aggregate: ``role: text`` in order, blank lines between (2.10)."""
    rows = F.array_sort(F.collect_list(F.struct(position.alias("p"), role.alias("r"), text.alias("t"))))
    return F.array_join(F.transform(rows, lambda x: F.concat(x["r"], F.lit(": "), F.coalesce(x["t"], F.lit("")))), "\n\n")


def sentence_chunks(text: Column, size: int = 300) -> Column:
    """Sentences in order as (position, sentence) chunks of at most ``size`` characters (2.10)."""
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(s) > 0)
    return F.flatten(
        F.transform(sentences, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / size).cast("int")), lambda i: F.substring(s, i * size + 1, F.lit(size))))
    )


def json_object(text: Column, kind: str) -> Column:
    """Tolerant parse of an object: as it is, then without what stands around its braces, then repaired (2.10; see ``repair.repaired``).

    Null where no brace opens.  The first two attempts stay in the JVM; Python
    sees only texts that neither reads.
    """
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)

    def plain(c: Column) -> Column:
        return F.when(F.try_parse_json(c).isNotNull() & F.trim(c).startswith("{"), c)

    read = F.coalesce(plain(text), plain(inner))
    broken = F.when(read.isNull() & F.contains(text, F.lit("{")), text)
    return F.from_json(F.coalesce(read, repair(broken)), kind)


def part_text(kind: Column, value: Column) -> Column:
    """One typed part of a message: text as it is, an image or a file by its id, others by their type (2.10)."""
    named = {"image_url": "Image", "file_uri": "File", "google_cloud_file_uri": "Cloud File"}
    out = F.when(kind == "text", F.coalesce(value, F.lit("")))
    for name, label in named.items():
        out = out.when(kind == name, F.concat(F.lit(f"[{label}: "), F.coalesce(value, F.lit("")), F.lit("]")))
    return out.otherwise(F.concat(F.lit("[Unknown content type: "), F.coalesce(kind, F.lit("")), F.lit("]")))


def parts_text(parts: Column) -> Column:
    """The typed parts (type, value) of a message, one a line, trimmed."""
    return F.trim(F.array_join(F.transform(parts, lambda p: part_text(p["type"], p["value"])), "\n"))


def first_tokens(text: Column, most: int) -> Column:
    """Text cut to ``most`` tokens at the store's four characters each (2.10)."""
    return F.substring(text, 1, most * 4)
