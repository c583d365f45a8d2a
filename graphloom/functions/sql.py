"""The predicates of types and URLs as functions of SQL, for rules that are written in it."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text as T

_TRIMMED = f"lower(regexp_replace(kind, r'^{T._BLANK}|{T._BLANK}$', ''))"


def _listed(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _matches(value: str, pattern: str) -> str:
    return f"rlike({value}, r'{pattern}')"


_BODIES = {
    "is_http_endpoint": f"{_TRIMMED} IN ({_listed(T.HTTP_ENDPOINT_TYPES)})",
    "is_http_like": f"{_TRIMMED} IN ({_listed(T.HTTP_LIKE_TYPES)}) OR {_matches(_TRIMMED, T._word(T.HTTP_LIKE_WORDS))}",
    "is_db_like": f"{_matches('kind', T._word(T.DB_WORDS))} OR {_matches('kind', T.DB_PARTS)}",
    "is_auth_like": f"{_matches(_TRIMMED, T._word(T.AUTH_WORDS))} OR {_matches(_TRIMMED, T.AUTH_PARTS)}",
    "is_queue_like": f"{_matches(_TRIMMED, T._word(T.QUEUE_WORDS))} OR {_matches(_TRIMMED, T.QUEUE_PARTS)}",
    "is_health_url": _matches("lower(kind)", rf"(^|/)({T.HEALTH_SEGMENTS})(/|$|\?)"),
}


def registered(spark: SparkSession) -> SparkSession:
    """The session with is_http_endpoint, is_http_like, is_db_like, is_auth_like, is_queue_like and is_health_url as
    temporary functions. They are SQL themselves, so the optimizer sees through them; a null is false."""
    for name, body in _BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(kind STRING) RETURNS BOOLEAN RETURN coalesce({body}, false)")
    return spark
