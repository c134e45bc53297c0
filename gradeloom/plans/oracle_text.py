"""SQL snippets shared by the oracle queries."""

from __future__ import annotations

import json

from ..sources.catalog import CATALOG_TEXT

#: Unicode white space for an engine whose ``\s`` is ASCII only.
SQL_BLANK = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

#: Spanish sort key of a column or expression.
SQL_KEY = "strip_accents(replace(replace(lower({0}), 'ñ', 'nz'), 'ß', 'ss'))"


def sql_strip(expression: str) -> str:
    return f"regexp_replace({expression}, '^{SQL_BLANK}+|{SQL_BLANK}+$', '', 'g')"


def _catalog_rows() -> str:
    rows = []
    for number, (programme, items) in enumerate(json.loads(CATALOG_TEXT).items()):
        for place, item in enumerate(items):
            if item["codi"]:
                name = item["nom"].replace("'", "''")
                rows.append(f"({number}, {place}, '{item['codi']}', '{name}')")
    return ", ".join(rows)


#: Catalogue names as a subquery ``(mp_code, mp_name)``, first programme first.
CATALOG_VALUES = f"""SELECT mp_code, mp_name FROM (
 SELECT *, row_number() OVER (PARTITION BY mp_code ORDER BY p, i) AS n
 FROM (VALUES {_catalog_rows()}) AS c(p, i, mp_code, mp_name)) WHERE n = 1"""
