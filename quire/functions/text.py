"""Column expressions on text. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import fixed

WORD = "[a-z0-9]+"


def blank(c: Column) -> Column:
    return ~c.rlike(r"\S")


def strip(c: Column) -> Column:
    """Whitespace of every kind off both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squash(c: Column) -> Column:
    """Whitespace runs become one space, ends trimmed."""
    return strip(F.regexp_replace(c, r" \s+|[^\S ]\s*", " "))  # a space between two words is one already


def upper(c: Column) -> Column:
    """Upper case letter by letter: a letter that would become several (ß, ŉ) keeps one, so the length stays."""
    whole = F.upper(c)
    one = lambda x: F.when(F.length(F.upper(x)) == 1, F.upper(x)).when(x == "ß", "ẞ").when(F.length(F.initcap(x)) == 1, F.initcap(x)).otherwise(x)
    return F.when(F.length(whole) == F.length(c), whole).otherwise(F.array_join(F.transform(F.split(c, ""), one), ""))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def slug(c: Column) -> Column:
    """Lower case, apostrophes out, every other run a hyphen, none at the ends."""
    bare = F.regexp_replace(F.lower(c), "['’]", "")
    return F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-|-$", "")


def file_slug(name: Column) -> Column:
    stem = F.regexp_replace(F.coalesce(name, F.lit("plan")), r"\.[A-Za-z0-9]+$", "")
    hyphened = F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "-"), "^-|-$", "")
    short = F.substring(hyphened, 1, 60)
    return F.when(short == "", "plan").otherwise(short)


def clean_name(name: Column) -> Column:
    base = F.element_at(F.split(F.coalesce(name, F.lit("")), r"[\\/]"), -1)
    kept = strip(F.regexp_replace(base, r'[\x00-\x1f\x7f"<>|]', ""))
    return F.substring(F.when(kept == "", "document").otherwise(kept), 1, 160)


def normalise_code(c: Column) -> Column:
    return F.translate(F.regexp_replace(F.upper(c), r"\s+", ""), ".-", "//")


def clip_text(c: Column, most: int) -> Column:
    return F.substring(squash(c), 1, most)


def clip_list(items: Column, most: int, width: int) -> Column:
    kept = F.filter(items, lambda x: x.isNotNull() & ~blank(x))
    return F.transform(F.slice(kept, 1, most), lambda x: clip_text(x, width))


def size_label(n: Column) -> Column:
    mb, kb = 1024 * 1024, 1024
    whole = lambda unit, name: F.concat(F.floor(n / unit + F.lit(0.5)).cast("string"), F.lit(name))
    return F.when(n >= mb, whole(mb, "MB")).otherwise(whole(kb, "KB"))


def human_list(items: Column) -> Column:
    """'a, b and c'."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, F.lit("")).when(n == 1, F.element_at(items, 1)).otherwise(
        F.concat(head, F.lit(" and "), F.get(items, n - 1))
    )


def counted(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or one + "s"))


def escape_markdown(c: Column) -> Column:
    flat = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r?\n", " ")
    return F.regexp_replace(flat, r"([\\`*_\[\]<>|])", r"\\$1")


def escape_html(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def md_to_plain(c: Column) -> Column:
    """Markdown to words good enough for an index."""
    # The patterns and their order decide the result.
    steps = (
        (r"!\[[^\]]*\]\([^)]*\)", ""),
        (r"\[([^\]]+)\]\([^)]*\)", "$1"),
        (r"[*_`>#]+", ""),
        (r"(?m)^\s*[-*]\s+", "• "),
        (r"\|", " "),
        (r"\n{2,}", "\n"),
        (r"[ \t]+", " "),
    )
    for pattern, into in steps:
        c = F.regexp_replace(c, pattern, into)
    return strip(c)


MARKS = r"[\[<`*_~\\]"  # every inline mark holds one of these


def strip_inline(c: Column) -> Column:
    """Inline markup out of one line; every repeat is bounded."""
    # The patterns and their order decide the result.
    steps = (
        (r"!\[([^\]]{0,500})\]\([^)]{0,2000}\)", "$1"),
        (r"\[([^\]]{1,500})\]\([^)]{0,2000}\)", "$1"),
        (r"\[([^\]]{1,500})\]\[[^\]]{0,200}\]", "$1"),
        (r"<(https?:[^>\s]{1,2000})>", "$1"),
        (r"</?[A-Za-z][^>]{0,500}>", ""),
        (r"`([^`]{0,1000})`", "$1"),
        (r"(\*\*|__)(?=\S)([^\n]{0,500}?\S)\1", "$2"),
        (r"(^|[^\w*])\*(?=\S)([^*\n]{0,500}?\S)\*(?!\*)", "$1$2"),
        (r"(^|[^\w])_(?=\S)([^_\n]{0,500}?\S)_(?![\w])", "$1$2"),
        (r"~~(?=\S)([^\n]{0,500}?\S)~~", "$1"),
        (r"\\([\\`*_{}\[\]()#+\-.!|>~])", "$1"),
    )
    for pattern, into in steps:
        c = F.regexp_replace(c, pattern, into)
    return c


def normalise(c: Column) -> Column:
    """The form in which quotes are compared: folded, lower case, single spaces."""
    c = F.replace(c, F.lit(fixed.FOLD_ELLIPSIS), F.lit("..."))
    source = fixed.FOLD_APOSTROPHE + fixed.FOLD_QUOTE + fixed.FOLD_DASH + fixed.FOLD_SPACE
    target = (
        "'" * len(fixed.FOLD_APOSTROPHE) + '"' * len(fixed.FOLD_QUOTE)
        + "-" * len(fixed.FOLD_DASH) + " " * len(fixed.FOLD_SPACE)
    )
    folded = F.translate(c, source + fixed.FOLD_NOTHING, target)
    return F.trim(F.regexp_replace(F.lower(folded), " +", " "))


def quote_pieces(c: Column) -> Column:
    """The parts of a quote that must be found, in order: split at ellipses, ends stripped."""
    parts = F.split(normalise(c), r"\.{3,}")
    bare = F.transform(parts, lambda p: F.regexp_replace(
        F.regexp_replace(p, r"^[\s\"'\-*•>:;,.]+", ""), r"[\s\"'\-*•:;,.]+$", ""))
    return F.filter(bare, lambda p: p != "")


def stem(w: Column) -> Column:
    n = F.length(w)
    return (
        F.when((n > 5) & w.endswith("ies"), F.concat(F.left(w, n - 3), F.lit("y")))
        .when((n > 4) & w.endswith("es") & ~w.endswith("ses"), F.left(w, n - 2))
        .when((n > 3) & w.endswith("s") & ~w.endswith("ss"), F.left(w, n - 1))
        .when((n > 6) & w.endswith("ing"), F.left(w, n - 3))
        .otherwise(w)
    )


def words(c: Column) -> Column:
    """The raw a-z and 0-9 runs of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def tokens(c: Column) -> Column:
    """A text split at separators and punctuation, as the search index sees it."""
    return F.split(c, r"[\n\r\p{Z}\p{P}]+")


def index_array(c: Column) -> Column:
    """Index terms of a short text; long ones are exploded and filtered as rows instead."""
    return F.filter(tokens(F.lower(c)), lambda w: (F.length(w) > 1) & ~w.isin(fixed.INDEX_STOP))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def day_label(d: Column, long: bool = False) -> Column:
    return F.coalesce(F.date_format(d, "d MMMM yyyy" if long else "d MMM yyyy"), F.lit(""))
