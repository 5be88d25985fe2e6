"""Functions of text columns, all within the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of two to eight ideographs, or identifiers of two characters or more.
TOKEN = r"[\x{4e00}-\x{9fff}]{2,8}|[A-Za-z_][A-Za-z0-9_]+"
#: A line of at most eight characters without a letter or digit, and the number of a page between marks.
DECORATION = r"^[^\p{L}\p{N}]{1,8}$|^[-–—~·*|]{1,3}\s*[0-9]{1,4}\s*[-–—~·*|]{1,3}$|^第\s*[0-9]{1,4}\s*页$"
CHAPTER = r"^(?:第\s*([0-9]{1,3})\s*章|(?:Chapter|Kapitel)\s+([0-9]{1,3}):)\s*(.{0,60})$"


def tokens(c: Column) -> Column:
    """The tokens of a text in order, lower case; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), F.lit(1)), F.array().cast("array<string>"))


def plain_width(c: Column) -> Column:
    """Full-width forms as plain ones, white space runs as one space, lower case, trimmed."""
    wide = "".join(chr(o) for o in range(0xFF01, 0xFF5F)) + "　"
    narrow = "".join(chr(o) for o in range(0x21, 0x7F)) + " "
    return F.trim(F.regexp_replace(F.lower(F.translate(c, wide, narrow)), r"[ \t\r\n]+", " "))


def vote_key(c: Column) -> Column:
    """The same without any white space."""
    return F.replace(plain_width(c), F.lit(" "), F.lit(""))


def slices(c: Column, size: int = 200) -> Column:
    """Pieces of `size` characters; an empty array for a null or empty text."""
    at = F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0)), F.lit(size))
    return F.when(F.length(c) > 0, F.transform(at, lambda p: F.substring(c, p + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def snippet(c: Column, size: int = 120) -> Column:
    """The first characters, with an ellipsis if there are more."""
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit("…"))).otherwise(c)


def html_text(c: Column) -> Column:
    """The text of HTML: without comments, scripts, styles and tags; block ends and breaks as line ends; named entities
    and the numeric ones of ASCII decoded; runs of spaces and of blank lines shortened. Null stays null."""
    for pattern, to in (
        (r"(?s)<!--.*?-->", ""), (r"(?is)<script\b.*?</script>", ""), (r"(?is)<style\b.*?</style>", ""), (r"(?i)</(?:p|div|li|tr|h[1-6]|blockquote|section|article|figcaption)\s*>", "\n"),
        (r"(?i)<br\s*/?>", "\n"), (r"<[^>]+>", ""),
    ):
        c = F.regexp_replace(c, pattern, to)
    # numeric entities one by one; what they stand for never has an ampersand but &#38;, which comes last
    codes = [o for o in range(33, 127) if o != 38]
    for o in codes:
        if chr(o) in "<>\"'#%/=":
            c = F.regexp_replace(c, rf"&#(?:0*{o}|x0*{o:x}|x0*{o:X});", "\\" + chr(o))
    for name, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#38;", "&"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(to))
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def chapter_number(c: Column) -> Column:
    """The number of a chapter's heading, null for other lines."""
    n = F.coalesce(F.nullif(F.regexp_extract(c, CHAPTER, 1), F.lit("")), F.nullif(F.regexp_extract(c, CHAPTER, 2), F.lit("")))
    return n.cast("int")


def chapter_title(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, CHAPTER, 3))


def error_rate(found: Column, right: Column) -> Column:
    """Edit distance over the length of the right text; null if that is empty."""
    return F.when(F.length(right) > 0, F.levenshtein(found, right).cast("double") / F.length(right))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two arrays of one length, 1 if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.lit(1.0) - dot(a, b) / norm).otherwise(F.lit(1.0))


def reciprocal_rank(*ranks: Column, k: int = 60) -> Column:
    """The sum of 1 / (k + rank); a missing rank adds nothing."""
    out = F.lit(0.0)
    for r in ranks:
        out = out + F.coalesce(F.lit(1.0) / (F.lit(k) + r), F.lit(0.0))
    return out


def loose_json(c: Column) -> Column:
    """A JSON object out of a text that has more around it, as VARIANT: as it is, without a code fence, or from the first
    brace to the last. Null if none can be read."""
    bare = F.trim(F.regexp_replace(c, r"(?s)^\s*```[a-zA-Z]*|```\s*$", ""))
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(F.trim(c)), F.try_parse_json(bare), F.try_parse_json(F.nullif(inner, F.lit(""))))
