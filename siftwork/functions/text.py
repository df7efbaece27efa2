"""Text expressions: whitespace, HTML to text, decision parsing, answer encoding.

All native Spark expressions except the entity tail of ``html_to_text``, which
goes through an Arrow-batched pandas UDF only for rows that still hold an
entity after the native replacements.
"""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.functions.expr import col_

# Named entities decoded natively, in this order (``&amp;`` must be last).
NATIVE_ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&middot;", "·"),
    ("&copy;", "©"),
    ("&amp;", "&"),
]

# Decision and answer vocabularies.
DECISIONS = ("YES", "NO", "UNCERTAIN")
ANSWERS = ("YES", "NO", "UNSURE")

_ENTITY_RE = r"&(#[0-9xX]|[a-zA-Z])"  # with or without the closing semicolon
_TAG_RE = r"""<[a-zA-Z/!?](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""  # '>' inside quoted attributes belongs to the tag


def strip_unicode(c) -> Column:
    """Strip Unicode whitespace at both ends (``str.strip``); ``F.trim`` only strips spaces."""
    return F.regexp_replace(col_(c), r"(?U)^\s+|\s+$", "")


def collapse_whitespace(c) -> Column:
    """``" ".join(s.split())``: runs of Unicode whitespace to one space, trimmed."""
    return strip_unicode(F.regexp_replace(col_(c), r"(?U)\s+", " "))


def normalise_key(c) -> Column:
    """Lower-case and collapse whitespace (dedup key)."""
    return F.regexp_replace(F.lower(col_(c)), r"(?U)\s+", " ")


def _decode_native(c: Column) -> Column:
    for ent, ch in NATIVE_ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


@F.pandas_udf(T.StringType())
def _unescape_twice(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else _html.unescape(_html.unescape(x)))


def strip_markup(c) -> Column:
    """Drop comments, script/style/template blocks (before tags: scripts may hold tags; an
    unclosed one reaches to the end), then tags and processing instructions. A tag
    whose quote never closes ends at the next '>'."""
    c = F.regexp_replace(col_(c), r"(?s)<!--.*?(-->|\z)", "")
    for tag in ("script", "style", "template"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?(</{tag}\s*>|\z)", "")
    return F.regexp_replace(F.regexp_replace(c, _TAG_RE, ""), r"<[a-zA-Z/!?][^>]*>", "")


def html_to_text(c, exact_entities: bool = True) -> Column:
    """HTML to visible text: markup removed with no separator, entities decoded twice
    (parser + unescape), whitespace collapsed. Non-string input is cast to string.

    The markup passes run only on texts containing '<' and the entity passes only on
    texts containing '&', so plain text costs two scans plus the whitespace collapse."""
    x = col_(c).cast("string")
    stripped = F.when(F.instr(x, "<") > 0, strip_markup(x)).otherwise(x)
    has_amp = F.instr(stripped, "&") > 0
    native = F.when(has_amp, _decode_native(_decode_native(stripped))).otherwise(stripped)
    if exact_entities:
        needs = has_amp & native.rlike(_ENTITY_RE)
        native = F.coalesce(_unescape_twice(F.when(needs, stripped)), native)
    return collapse_whitespace(native)


def parse_decision(c) -> Column:
    """Model answer to YES / NO / UNCERTAIN: exact match after trim+upper, else contains
    YES, else contains NO (so 'UNKNOWN' is NO), else UNCERTAIN."""
    d = F.upper(strip_unicode(col_(c)))
    return (F.when(d.isin(*DECISIONS), d)
            .when(d.contains("YES"), F.lit("YES"))
            .when(d.contains("NO"), F.lit("NO"))
            .otherwise(F.lit("UNCERTAIN")))


def encode_answer(c, unsure_as_one: bool = False, strict: bool = True) -> Column:
    """NO -> 0, YES -> 1, UNSURE -> 1 or 0.5; anything else raises (strict) or is NULL."""
    v = col_(c)
    other = (F.raise_error(F.concat(F.lit("unexpected answer: "), F.coalesce(v, F.lit("NULL"))))
             if strict else F.lit(None))
    return (F.when(v == "NO", F.lit(0.0))
            .when(v == "YES", F.lit(1.0))
            .when(v == "UNSURE", F.lit(1.0 if unsure_as_one else 0.5))
            .otherwise(other.cast("double")))


def safe_name(c) -> Column:
    """Runs of characters outside [a-zA-Z0-9._-] become one underscore."""
    return F.regexp_replace(col_(c), r"[^a-zA-Z0-9._-]+", "_")


def short_model_name(c) -> Column:
    """Part after the last '/'."""
    return F.element_at(F.split(col_(c), "/"), -1)


def first_line(c) -> Column:
    return F.substring_index(col_(c), "\n", 1)


def after_first_line(c) -> Column:
    """Everything after the first newline ('' when there is none)."""
    x = col_(c)
    pos = F.instr(x, "\n")
    return F.when(pos > 0, x.substr(pos + 1, F.length(x))).otherwise(F.lit(""))
