"""DuckDB SQL fragments mirroring the Spark expressions (oracle side only)."""

from __future__ import annotations

from siftwork.functions.text import NATIVE_ENTITIES
from siftwork.sources.dimensions import price_table

# Unicode White_Space, as Java's (?U)\s sees it (RE2's \s is ASCII-only).
WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def decode(x: str) -> str:
    for ent, ch in NATIVE_ENTITIES:
        x = f"replace({x}, {sq(ent)}, {sq(ch)})"
    return x


def html_to_text(x: str) -> str:
    y = f"regexp_replace(CAST({x} AS VARCHAR), '(?s)<!--.*?(-->|\\z)', '', 'g')"
    for tag in ("script", "style", "template"):
        y = f"regexp_replace({y}, '(?is)<{tag}\\b[^>]*>.*?(</{tag}\\s*>|\\z)', '', 'g')"
    quoted = """<[a-zA-Z/!?](?:[^>"'']|"[^"]*"|''[^'']*'')*>"""
    y = f"regexp_replace(regexp_replace({y}, '{quoted}', '', 'g'), '<[a-zA-Z/!?][^>]*>', '', 'g')"
    return collapse(decode(decode(y)))


PAPERS = """papers AS (
  SELECT d.doc_id AS id, split_part(d.text, chr(10), 1) AS title,
    CASE WHEN instr(d.text, chr(10)) > 0 THEN substr(d.text, instr(d.text, chr(10)) + 1) ELSE '' END AS abstract,
    l.quality = 1 AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

MODELS = "[" + ", ".join(sq(m) for m in price_table()) + "]"

PRICES = "prices AS (SELECT * FROM (VALUES " + ", ".join(
    f"({sq(m)}, {i}::DOUBLE, {o}::DOUBLE)" for m, (i, o) in price_table().items()) + ") v(model, pin, pout))"

HASH42 = "md5(concat(CAST(id AS VARCHAR), ':42'))"
