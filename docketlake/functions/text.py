"""Text functions as column expressions: nothing here leaves the JVM.

White space is the set that browsers trim and split at (the byte order mark is in
it, U+0085 is not), which is not Java's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space class, for Java patterns: ASCII, every separator and the byte order mark.
WHITE = r"[\s\p{Z}\ufeff]"
_SEEN = f"[^{WHITE[1:-1]}]"  # any other character


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space texts; looks no further than the first other character."""
    return F.coalesce(~text.rlike(_SEEN), F.lit(True))


def none_if_empty(text: Column) -> Column:
    """The empty string becomes null; other values stay."""
    return F.nullif(text, F.lit(""))


def words(text: Column) -> Column:
    """Split at runs of white space; a leading or trailing run leaves an empty word."""
    return F.split(text, f"{WHITE}+", -1)


def chunks(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Overlapping windows of words, joined by one space; blank windows are left out.

    A window starts at every multiple of ``size - overlap`` below the number of
    words, so the last may lie within the one before. A text without any other
    window is its own only chunk.
    """
    if size < 1 or overlap < 0 or overlap >= size:
        raise ValueError("size must be positive and overlap from 0 to less than size")

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 1, F.lit(size - overlap))
        return F.filter(F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, size), " ")), lambda x: x.rlike(_SEEN))

    return _let(words(text), lambda w: _let(windows(w), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(F.array(text))))


def paragraphs(text: Column) -> Column:
    """Lines that are not blank, cut at runs of line ends."""
    return F.filter(F.split(text, "\n+", -1), lambda x: x.rlike(_SEEN))


def last_segment(path: Column, separator: str = "/") -> Column:
    return F.element_at(F.split(path, f"[{separator}]", -1), -1)


def extension(name: Column) -> Column:
    return last_segment(F.lower(name), ".")


def dashed(text: Column) -> Column:
    return F.regexp_replace(text, f"{WHITE}+", "-")


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """The first literal occurrence replaced; without one the text stays."""
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))).otherwise(text)


def apply_redlines(text: Column, suggestions: Column) -> Column:
    """Accepted suggestions with both texts, applied one after another in list order.

    ``suggestions``: array of structs with status, original_text, suggested_text.
    """
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    used = F.filter(suggestions, lambda s: (s["status"] == "accepted") & filled(s["original_text"]) & filled(s["suggested_text"]))
    return F.aggregate(used, text, lambda acc, s: replace_first(acc, s["original_text"], s["suggested_text"]))


def percent(share: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f%%", share * 100)


def first_text_block(blocks: Column, default: str | None = None) -> Column:
    """The text of the first block of type ``text`` in an array of (type, text)."""
    return F.coalesce(F.get(F.filter(blocks, lambda b: b["type"] == "text"), F.lit(0))["text"], F.lit(default))


def greedy(text: Column, opening: str, closing: str) -> Column:
    """From the first ``opening`` to the last ``closing``; null where there is none."""
    return F.nullif(F.regexp_extract(text, rf"(?s)\{opening}.*\{closing}", 0), F.lit(""))


def parse_reply(text: Column) -> Column:
    """struct<ready, message> of a reply that holds a JSON object somewhere.

    Ready only if exactly true. Text that doesn't parse, or an object without a
    message, gives the whole text as the message.
    """
    body = F.coalesce(greedy(text, "{", "}"), text)
    good = trim(body).startswith("{") & F.try_parse_json(body).isNotNull()
    parsed = F.when(good, F.from_json(body, "ready string, message string"))
    return F.struct(F.coalesce(parsed["ready"] == "true", F.lit(False)).alias("ready"), F.coalesce(parsed["message"], text).alias("message"))


SUGGESTION = "array<struct<clause_reference: string, original_text: string, suggested_text: string, rationale: string>>"


def parse_suggestions(text: Column) -> Column:
    """The suggestions of a reply that holds a JSON array; anything else is empty.

    Elements that are no objects come as structs of nulls.
    """
    body = F.coalesce(greedy(text, "[", "]"), text)
    good = trim(body).startswith("[") & F.try_parse_json(body).isNotNull()
    items = F.from_json(F.when(good, body), "array<string>")
    parsed = F.transform(items, lambda x: F.from_json(F.when(trim(x).startswith("{"), x).otherwise("{}"), SUGGESTION.removeprefix("array<").removesuffix(">")))
    return F.coalesce(parsed, F.from_json(F.lit("[]"), SUGGESTION))


def locale_date(when: Column) -> Column:
    """A date as browsers show it in the United States: month/day/year without zeros."""
    return F.date_format(when, "M/d/y")


def has_entries(entries: Column) -> Column:
    """Whether a help section's list holds anything; null counts as empty."""
    return F.coalesce(F.size(entries) > 0, F.lit(False))


def status_label(status: Column) -> Column:
    return F.replace(status, F.lit("_"), F.lit(" "))


def status_class(status: Column) -> Column:
    return F.when(status.isin("finalized", "executed"), "default").when(status == "not_started", "outline").otherwise("secondary")


#: The stage statuses in the order they cycle through.
STAGE_CYCLE = ("not_started", "in_progress", "complete")


def next_stage_status(status: Column) -> Column:
    """The next status; an unknown one starts the cycle."""
    at = F.coalesce(F.array_position(F.array(*map(F.lit, STAGE_CYCLE)), status), F.lit(0))
    return F.element_at(F.array(*map(F.lit, STAGE_CYCLE)), (F.pmod(at, F.lit(len(STAGE_CYCLE))) + 1).cast("int"))


def contains_query(sections_query: str, title: Column, description: Column, content: Column, faqs: Column) -> Column:
    """Case-insensitive search of a help section; an empty query finds all.

    ``content`` and ``faqs`` are arrays of structs with question and answer.
    """
    if not sections_query:
        return F.lit(True)
    q = sections_query.lower()
    has = lambda c: F.coalesce(F.lower(c).contains(q), F.lit(False))
    inside = lambda arr: F.coalesce(F.exists(arr, lambda i: has(i["question"]) | has(i["answer"])), F.lit(False))
    return has(title) | has(description) | inside(content) | inside(faqs)
