"""Column functions: trimming, coercion to text, slugs, and the classes of node types.

All are pure expressions of built-in functions, so they stay inside generated code and are pushed down where possible.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts define it, which SQL's trim doesn't know.
_SPACES = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
_BLANK = rf"[\s{_SPACES}]+"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_BLANK}|{_BLANK}$", "")


def _word(words: str) -> str:
    """Whole words between ASCII word characters; the JVM's own \\b would know other letters too."""
    return rf"(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])"


# The words by which types are classified.
HTTP_ENDPOINT_TYPES = ("http", "https", "rest", "api", "graphql")
HTTP_LIKE_TYPES = (*HTTP_ENDPOINT_TYPES, "gateway", "bff", "grpc")
HTTP_LIKE_WORDS = "api|gateway|bff|graphql|grpc"
DB_WORDS = "db|database|datastore"
DB_PARTS = "postgres|mongodb|mysql|sqlite|redis|cassandra|dynamo|sql|nosql|warehouse|s3"
AUTH_WORDS = "auth|authentication|authorization|middleware|security|iam|idp|identity"
AUTH_PARTS = "oauth|jwt|saml|keycloak|okta|cognito|auth0|ldap|sso"
QUEUE_WORDS = "queue|topic|stream|pubsub|event|bus"
QUEUE_PARTS = "kafka|sns|sqs|amqp|mqtt|nats|rabbitmq|pulsar"
HEALTH_SEGMENTS = "healthz?|healthcheck|ping|status|alive|live|ready"
ASYNC_PROTOCOLS = ("async", "message", "queue", "event", "pubsub")
ASYNC_KIND_PARTS = "queue|topic|stream|kafka|sns|sqs|amqp|mqtt|nats"
AUTH_KEYS = ("auth", "authrequired", "authentication", "authorization", "security")
HTTP_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")


def is_http_endpoint(kind: Column) -> Column:
    return F.coalesce(F.lower(trimmed(kind)).isin(*HTTP_ENDPOINT_TYPES), F.lit(False))


def is_http_like(kind: Column) -> Column:
    lower = F.lower(trimmed(kind))
    return F.coalesce(lower.isin(*HTTP_LIKE_TYPES) | lower.rlike(_word(HTTP_LIKE_WORDS)), F.lit(False))


def is_db_like(kind: Column) -> Column:
    """By its own letters: neither trimmed nor lower-cased here."""
    return F.coalesce(kind.rlike(_word(DB_WORDS)) | kind.rlike(DB_PARTS), F.lit(False))


def is_auth_like(kind: Column) -> Column:
    lower = F.lower(trimmed(kind))
    return F.coalesce(lower.rlike(_word(AUTH_WORDS)) | lower.rlike(AUTH_PARTS), F.lit(False))


def is_queue_like(kind: Column) -> Column:
    lower = F.lower(trimmed(kind))
    return F.coalesce(lower.rlike(_word(QUEUE_WORDS)) | lower.rlike(QUEUE_PARTS), F.lit(False))


def is_health_url(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike(rf"(^|/)({HEALTH_SEGMENTS})(/|$|\?)"), F.lit(False))


def slug_of_service(title: Column) -> Column:
    """A service name: at most 63 of a-z, 0-9, _ and -."""
    base = F.coalesce(F.nullif(title, F.lit("")), F.lit("openapi-service"))
    slug = F.regexp_replace(F.regexp_replace(trimmed(base), r"[^a-zA-Z0-9_-]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(F.lower(slug), 1, 63), F.lit("")), F.lit("openapi-service"))


def slug_of_node(path: Column, method: Column) -> Column:
    """The id of an operation's node, of at most 80 characters."""
    slug = F.regexp_replace(F.concat(method, F.lit("_"), path), r"[^a-zA-Z0-9]+", "_")
    slug = F.lower(F.regexp_replace(slug, r"^_|_$", ""))
    return F.substring(F.concat(F.lit("openapi_"), F.coalesce(F.nullif(slug, F.lit("")), F.lit("route"))), 1, 80)


def with_slash(path: Column) -> Column:
    text = F.coalesce(F.nullif(trimmed(path), F.lit("")), F.lit("/"))
    return F.when(text.startswith("/"), text).otherwise(F.concat(F.lit("/"), text))


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_-]", "_")


def unix_lines(content: Column) -> Column:
    return F.replace(content, F.lit("\r\n"), F.lit("\n"))


def host_port(text: Column, default: int = 8080) -> Column:
    """The leading integer of a text as a port, or the default."""
    number = F.regexp_extract(trimmed(F.coalesce(text, F.lit(""))), r"^([+-]?[0-9]+)", 1).try_cast("bigint")
    return F.when(number.between(1, 65535), number.cast("int")).otherwise(F.lit(default))
