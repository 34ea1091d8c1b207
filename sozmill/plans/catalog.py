"""Registration of named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable


class Catalog:
    """Queries of one module by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable:
        def register(f: Callable) -> Callable:
            self.queries[name or f.__name__] = f
            if sql:
                self.sql[name or f.__name__] = sql
            return f

        return register


def sql_collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x0B\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def sql_apostrophes(x: str, marks: str) -> str:
    quoted = marks.replace("'", "''")
    return f"replace(translate(regexp_replace({x}, '([ogOG])[{quoted}ʻ]', '\\1' || chr(1), 'g'), '{quoted}', '{'ʼ' * len(marks)}'), chr(1), 'ʻ')"


def sql_normalize(x: str) -> str:
    from sozmill.functions.text import CORPUS_APOSTROPHES

    return sql_collapse(f"regexp_replace(lower({sql_apostrophes(x, CORPUS_APOSTROPHES)}), '[^a-zʻʼ ]', ' ', 'g')")


def sql_raw(x: str) -> str:
    from sozmill.functions.text import CORPUS_APOSTROPHES

    return sql_collapse(sql_apostrophes(x, CORPUS_APOSTROPHES))


def sql_words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"
