"""What SQL and names are let through, checked on the driver before anything is planned."""

from __future__ import annotations

import re

IDENTIFIER = re.compile(r"[a-zA-Z_][a-zA-Z0-9_-]*")
#: Words that no read-only query contains.
FORBIDDEN = frozenset(
    "INSERT UPDATE DELETE DROP CREATE ALTER TRUNCATE MERGE REPLACE GRANT REVOKE ATTACH DETACH COPY EXPORT IMPORT INSTALL LOAD CALL EXECUTE PREPARE VACUUM PRAGMA SET UNION EXCEPT INTERSECT COMMENT CHECKPOINT USE BEGIN COMMIT ROLLBACK".split()
)
#: Functions that read files.
FILE_FUNCTIONS = frozenset("read_csv read_csv_auto read_json read_json_auto read_parquet parquet_scan read_text read_blob glob read_files csv_scan sniff_csv iceberg_scan delta_scan".split())
_FORMATS = r"\b(?:parquet|csv|json|orc|text|binaryfile|avro|delta|iceberg)\s*\.\s*`"


class Rejected(ValueError):
    """A query or name that isn't let through."""


def check_name(name: str) -> str:
    if not IDENTIFIER.fullmatch(name or ""):
        raise Rejected(f"not a name: {name!r}")
    return name


def bare(sql: str) -> str:
    """SQL without comments, with its literals emptied; quoted names stay."""
    return re.sub(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", lambda m: "''" if m[0][0] == "'" else " ", sql, flags=re.S)


def _top_level_selects(text: str) -> int:
    depth, found = 0, 0
    for m in re.finditer(r"[()]|\bselect\b", text, flags=re.I):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        found += m[0].lower() == "select" and depth == 0
    return found


def check_sql(sql: str, joins: bool = True, ctes: bool = False, most: int = 16_384) -> str:
    """A single read-only SELECT (or WITH, if ``ctes``) that reads no files; else :class:`Rejected`."""
    if not sql or not sql.strip():
        raise Rejected("empty query")
    if len(sql) > most:
        raise Rejected(f"longer than {most} characters")
    text = bare(sql).strip().rstrip(";").strip()
    if ";" in text:
        raise Rejected("more than one statement")
    if not re.match(r"(?:select|with)\b" if ctes else r"select\b", text, flags=re.I):
        raise Rejected("only SELECT is let through")
    if words := FORBIDDEN & {w.upper() for w in re.findall(r"[A-Za-z_]+", re.sub(r'"[^"]*"|`[^`]*`', " ", text))}:
        raise Rejected(f"not let through: {', '.join(sorted(words))}")
    if re.search(r"\b(?:" + "|".join(FILE_FUNCTIONS) + r")\s*\(", text, flags=re.I) or re.search(_FORMATS, text, flags=re.I) or re.search(r"\bfrom\s+''", text, flags=re.I):
        raise Rejected("files can't be read from SQL")
    if not joins and re.search(r"\bjoin\b", text, flags=re.I):
        raise Rejected("joins are switched off")
    if not ctes and _top_level_selects(text) > 1:
        raise Rejected("more than one SELECT")
    return sql.strip().rstrip(";").strip()


def check_where(where: str) -> str:
    """A filter expression: no statement words, comments or file functions."""
    text = bare(where)
    if "--" in where or "/*" in where or ";" in text:
        raise Rejected("comments and statements can't stand in a filter")
    if FORBIDDEN & {w.upper() for w in re.findall(r"[A-Za-z_]+", text)} or re.search(r"\bselect\b", text, flags=re.I):
        raise Rejected("only an expression can filter")
    return where


def bound_limit(sql: str, most: int) -> str:
    """The query with its own trailing LIMIT lowered to ``most``, or with that limit added."""
    m = re.search(r"\blimit\s+(\d+)(\s+offset\s+\d+)?\s*$", sql, flags=re.I)
    return f"{sql[: m.start()]}LIMIT {min(int(m[1]), most)}{m[2] or ''}" if m else f"{sql} LIMIT {most}"
