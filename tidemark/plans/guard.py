"""Identifiers, read-only SQL, and targets that are the platform's own tables."""

from __future__ import annotations

import re

from ..model import Issue, Level

# Characters of an identifier part, words no read-only statement contains, own tables.
_PART = re.compile(r"[A-Za-z0-9_$一-龥]+")
BLOCKED = set(
    "INSERT UPDATE DELETE DROP TRUNCATE ALTER CREATE REPLACE GRANT REVOKE EXECUTE CALL MERGE RENAME LOCK UNLOCK OUTFILE DUMPFILE LOAD_FILE SHUTDOWN SET COMMIT ROLLBACK START BEGIN HANDLER PREPARE DEALLOCATE FLUSH KILL INTO".split()
)
METADATA_TABLES = {"datasource", "sync_task", "sync_record", "sync_error", "flyway_schema_history"}
#: Words that only do something with what follows them; a column or a function may be called so.
ONLY_BEFORE = {"START": r"START\s+(TRANSACTION|SLAVE|REPLICA|GROUP_REPLICATION)", "REPLACE": r"REPLACE(?!\s*\()"}
#: Functions that hold up a database or lock something in it.
HOLDING = re.compile(r"\b(SLEEP|BENCHMARK|GET_LOCK|RELEASE_LOCK|RELEASE_ALL_LOCKS)\s*\(", re.I)
_NAMES = r'"(?:[^"]|"")*"|`(?:[^`]|``)*`'
_COMMENT = r"/\*.*?(?:\*/|\Z)"
# By the rules of each kind of database: MySQL escapes with backslashes, takes # for a comment, and -- only before a blank;
# Spark escapes with backslashes too; standard SQL does neither.
_LEXERS = {
    "MYSQL": rf"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`|--(?=\s|\Z)[^\n]*|#[^\n]*|{_COMMENT}",
    "SPARK": rf"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|{_COMMENT}",
    "ANSI": rf"'(?:[^']|'')*'|{_NAMES}|--[^\n]*|{_COMMENT}",
}
_LEXERS = {kind: re.compile(pattern, re.S) for kind, pattern in _LEXERS.items()}
#: How comments begin that a database may carry out: versioned ones, and hints that can set variables.
_EXECUTED = ("/*!", "/*M!", "/*+")


def is_identifier(name: str | None) -> bool:
    """One to three parts parted by dots, no blanks around them; reserved words and Chinese names are fine."""
    if not name or name != name.strip():
        return False
    parts = name.split(".")
    return len(parts) <= 3 and all(_PART.fullmatch(p) for p in parts)


def quote(name: str) -> str:
    if not is_identifier(name):
        raise ValueError(f"not an identifier: {name!r}")
    return ".".join(f"`{p}`" for p in name.split("."))


def normalize(sql: str) -> str:
    return sql.strip().rstrip(";").rstrip()


def _lexer(kind: str) -> re.Pattern:
    return _LEXERS.get(kind) or _LEXERS["ANSI"]


def strip_literals(sql: str, kind: str = "SPARK") -> str:
    """The statement with literals, quoted names and comments blanked out, by the rules of a kind of database."""
    return _lexer(kind).sub(" ", sql)


def words(code: str) -> list[str]:
    return [w.upper() for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", code)]


def check_sql(sql: str | None, kind: str = "SPARK") -> Issue | None:
    """None for one SELECT or WITH statement without any blocked word outside literals, names and comments.

    What a literal or a comment is goes by the kind of database that gets the statement. Comments that a database may
    carry out are refused, whatever they hold.
    """

    def wrong(why: str) -> Issue:
        return Issue(Level.ERROR, "CUSTOM_SQL_INVALID", why, "give one read-only SELECT")

    if not sql or not sql.strip():
        return wrong("the statement is empty")
    sql = normalize(sql)
    if any(m[0].startswith(_EXECUTED) for m in _lexer(kind).finditer(sql)):
        return wrong("a comment that is carried out")
    code = strip_literals(sql, kind)
    if ";" in code:
        return wrong("more than one statement")
    found = words(code)
    if not found or found[0] not in ("SELECT", "WITH"):
        return wrong("a statement starts with SELECT or WITH")
    bad = sorted(w for w in set(found) & BLOCKED if w not in ONLY_BEFORE or re.search(rf"\b{ONLY_BEFORE[w]}", code, re.I))
    bad += sorted({m.upper() for m in HOLDING.findall(code)})
    return wrong(f"not read-only: {', '.join(bad)}") if bad else None


def wrap(sql: str, columns: str = "*") -> str:
    return f"SELECT {columns} FROM ({normalize(sql)}) _ds_src"


def _place(url: str) -> tuple[str, str, str] | None:
    host, base = re.search(r"//([^/:,]+):(\d+)", url or ""), re.search(r"//[^/]+/([^?;]+)", url or "")
    return (host[1].lower(), host[2], base[1].lower()) if host and base else None


def check_metadata_target(own_url: str | None, target_url: str | None, table: str | None) -> Issue | None:
    """A target in the platform's own database: an error for its own tables, else a warning. Unknown places pass."""
    if not own_url or not target_url:
        return None
    same = own_url.strip() == target_url.strip() or _place(own_url) is not None and _place(own_url) == _place(target_url)
    if not same:
        return None
    name = (table or "").rsplit(".", 1)[-1].strip("`").lower()
    own = not name or name in METADATA_TABLES or name.startswith("qrtz_")
    return Issue(Level.ERROR if own else Level.WARN, "TARGET_IS_METADATA", f"the target lies in the platform's own database{' and is one of its tables' if own else ''}", "choose another target")


def check_grants(lines: list[str], privilege: str, database: str | None) -> Issue | None:
    """An error if SHOW GRANTS can be read and nowhere covers the privilege for the database."""
    read = [m for m in (re.search(r"GRANT\s+(.*?)\s+ON\s+(.*?)\s+TO\s", line or "", re.I | re.S) for line in lines or []) if m]
    if not read:
        return None
    for m in read:
        given, scope = {p.strip().upper() for p in m[1].split(",")}, m[2].replace("`", "").strip().upper()
        if given & {"ALL", "ALL PRIVILEGES", privilege.upper()} and (scope.startswith("*.") or database and (scope == database.upper() or scope.startswith(database.upper() + "."))):
            return None
    return Issue(Level.ERROR, "PERMISSION_DENIED", f"the target account lacks {privilege.upper()}", f"grant {privilege.upper()} on the target database")
