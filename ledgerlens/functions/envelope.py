"""The encrypted wire envelope: a prefix, the clear routing key, and AES-256-GCM bound to both."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
MAGIC = "FDE1"
PREFIX = MAGIC + ":"
POISON = "__undecodable__"
ROUTING_FIELD = "sender_card"


def is_encrypted(value: Column) -> Column:
    return F.coalesce(value.startswith(PREFIX), F.lit(False))


def _parts(value: Column) -> Column:
    return F.split(value, ":", 3)


def routing_key(value: Column, field: str = ROUTING_FIELD) -> Column:
    """What the stream is partitioned by, without decrypting; never null."""
    clear = F.when(F.size(_parts(value)) == 3, F.get(_parts(value), F.lit(1)))
    plain = F.get_json_object(value, f"$.{field}")
    return F.coalesce(F.when(is_encrypted(value), clear).otherwise(plain), F.lit(POISON))


def _bound(routing: Column) -> Column:
    return F.concat(F.lit(MAGIC + "|"), routing)


def encrypt(event: Column, routing: Column, key: Column) -> Column:
    """A JSON text as an envelope; null where the routing key would make it ambiguous."""
    sealed = F.aes_encrypt(event.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"),
                           _bound(routing).cast("binary"))
    body = F.regexp_replace(F.base64(sealed), r"[\r\n]", "")
    return F.when(~routing.contains(":"), F.concat(F.lit(PREFIX), routing, F.lit(":"), body))


def decrypt(value: Column, key: Column) -> Column:
    """The JSON text inside an envelope; null for a broken, truncated or re-addressed one."""
    body = F.try_to_binary(F.get(_parts(value), F.lit(2)), F.lit("base64"))
    routing = F.get(_parts(value), F.lit(1))
    text = F.try_aes_decrypt(body, key, F.lit("GCM"), F.lit("DEFAULT"), _bound(routing).cast("binary"))
    return F.when(is_encrypted(value), text.cast("string"))


def clear_text(value: Column, key: Column | None = None, require: bool = False) -> Column:
    """One way for both kinds of record. Without a key an envelope is null; `require` refuses
    plain records."""
    opened = decrypt(value, key) if key is not None else F.lit(None).cast("string")
    plain = F.lit(None).cast("string") if require else value
    return F.when(is_encrypted(value), opened).otherwise(plain)
