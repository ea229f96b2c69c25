"""Text functions as Column expressions: token estimate, units, index terms, splitting, parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The CJK ranges, and the white space that trimming takes off.
CJK = "\\u3400-\\u4dbf\\u4e00-\\u9fff\\u3040-\\u30ff\\uac00-\\ud7af\\uf900-\\ufaff"
SPACE = "\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
UNITS = f"[{CJK}]|[A-Za-z]+|[0-9]+(?:\\.[0-9]+)?|[{SPACE}]+|[^{SPACE}]"
SENTENCES = "[^。！？!?；;\\n]+[。！？!?；;]?[\"'”’）)]*|\\n+"
WORDS = "[a-z0-9][a-z0-9_\\-\\.]{0,30}"
EXTENSIONS = ["txt", "md", "markdown", "csv", "json", "html", "htm", "pdf", "docx"]


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def weight(c: Column) -> Column:
    """Weights of a text's characters, added from the left as doubles."""
    one = lambda ch: F.when(ch.rlike(f"[{CJK}]"), 1.0).when(ch.isin(" ", "\n", "\t"), 0.2).otherwise(0.25)
    return F.aggregate(_chars(c), F.lit(0.0), lambda n, ch: n + one(ch))


def twentieths(c: Column) -> Column:
    """A text's weight in twentieths, as a whole number that doesn't depend on the order of its characters."""
    blanks = F.length(c) - F.length(F.translate(c, " \n\t", ""))
    wide = F.when(c.rlike(f"[{CJK}]"), F.length(F.regexp_replace(c, f"[^{CJK}]+", ""))).otherwise(0)
    return 5 * F.length(c) - blanks + 15 * wide


#: Characters up to which sums of doubles stay much closer than a twentieth to the exact ones.
EXACT = 10_000_000


def count_tokens(c: Column) -> Column:
    """Estimated tokens, halves up; 0 for null. Characters are weighed one by one only near a half, where a sum of doubles can fall to either side."""
    q = twentieths(c)
    near = F.when((q % 20 != 10) & (F.length(c) <= EXACT), F.floor((q + 10) / 20)).otherwise(F.floor(weight(c) + 0.5))
    return F.coalesce(near, F.lit(0)).cast("long")


def units(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(UNITS), F.lit(0))


def index_terms(c: Column) -> Column:
    """Latin words first, then characters and pairs of each CJK run."""
    low = F.lower(F.coalesce(c, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(WORDS), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(f"[{CJK}]+"), F.lit(0))

    def grams(run: Column) -> Column:
        chars = _chars(run)
        pairs = F.zip_with(chars, F.slice(chars, 2, F.size(chars)), lambda a, b: F.concat(a, b))
        return F.concat(chars, F.filter(pairs, lambda p: p.isNotNull()))

    return F.concat(words, F.flatten(F.transform(runs, grams)))


_WORD, _RUN = re.compile(WORDS), re.compile(f"[{CJK}]+")


def terms_of(low: str) -> list[str]:
    """The terms of ``index_terms`` of a text in lower case, for what splits texts in Python tasks."""
    terms = _WORD.findall(low)
    for run in () if low.isascii() else _RUN.findall(low):
        terms += [*run, *map("".join, zip(run, run[1:]))]
    return terms


def sentences(c: Column) -> Column:
    """Sentences of a text: a terminator, its closing quotes or a line end finishes one."""
    flat = F.regexp_replace(c, "\\r\\n?", "\n")
    found = F.transform(F.regexp_extract_all(flat, F.lit(SENTENCES), F.lit(0)), trim)
    return F.filter(found, lambda s: s != "")


def paragraphs(c: Column) -> Column:
    """Parts between blank lines, or lines where there is no blank line."""
    flat = F.regexp_replace(c, "\\r\\n?", "\n")
    parts = F.split(flat, f"\\n[{SPACE}]*\\n")
    found = F.transform(F.when(F.size(parts) <= 1, F.split(flat, "\\n")).otherwise(parts), trim)
    return F.filter(found, lambda s: s != "")


def html_text(c: Column) -> Column:
    steps = [  # fixed values, in this order
        ("(?i)<script[\\s\\S]*?</script>", " "),
        ("(?i)<style[\\s\\S]*?</style>", " "),
        ("(?i)<br\\s*/?>", "\n"),
        ("(?i)</(?:p|div|li|h[1-6]|tr)>", "\n"),
        ("<[^>]+>", " "),
        ("&nbsp;", " "),
        ("&amp;", "&"),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("[ \\t]+", " "),
        ("\\n{3,}", "\n\n"),
    ]
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return trim(c)


def normalize(c: Column) -> Column:
    # fixed values, in this order
    for pattern, to in [("\\r\\n?", "\n"), ("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", ""), ("[ \\t]+\\n", "\n"), ("\\n{3,}", "\n\n")]:
        c = F.regexp_replace(c, pattern, to)
    return trim(c)


def csv_lines(c: Column) -> Column:
    """Rows as ``header: value | ...``; commas split plainly, one quote is taken off either end of a cell."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731 - a value that is worked out once, not once a line
    lines = F.filter(F.split(c, "\\r?\\n"), lambda x: trim(x) != "")
    cells = lambda x: F.transform(F.split(x, ","), lambda v: trim(F.regexp_replace(v, '^"|"$', "")))

    def line(head: Column, row: Column) -> Column:
        named = F.zip_with(head, row, lambda h, v: F.concat(h, F.lit(": "), v))
        return F.array_join(F.when(F.size(head) == F.size(row), named).otherwise(row), " | ")

    def body(ls: Column) -> Column:
        rest = F.slice(ls, 2, F.greatest(F.size(ls), F.lit(1)))
        return let(cells(F.get(ls, F.lit(0))), lambda head: F.array_join(F.transform(rest, lambda x: let(cells(x), lambda row: line(head, row))), "\n"))

    return F.coalesce(let(lines, body), F.lit(""))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))


def supported(path: Column) -> Column:
    return extension(path).isin(EXTENSIONS)


def mask_key(c: Column) -> Column:
    n = F.length(c)
    return F.when(F.coalesce(n, F.lit(0)) == 0, "").when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(c, 1, 4), F.lit("****"), F.right(c, F.lit(4))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for null, unequal sizes or a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    na, nb = dot(a, a), dot(b, b)
    fine = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return F.when(fine, dot(a, b) / (F.sqrt(na) * F.sqrt(nb))).otherwise(0.0)
