"""Canonical JSON, digests and message authentication as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def canonical_json(content: Column) -> Column:
    """Sorted keys, no spaces. Payload numbers should be integers or pre-rounded."""
    return F.to_json(F.parse_json(content))


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def sha256_bytes(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def _xor_pad(key_hex: Column, pad: int) -> Column:
    """The 64-byte block of an HMAC key XOR-ed with one pad byte, as hex text."""
    block = F.rpad(key_hex, 128, "0")
    pairs = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.lpad(
            F.hex(F.conv(F.substring(block, i * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(pad))),
            2, "0"))
    return F.array_join(pairs, "")


def hmac_sha256(key_hex: Column, message: Column) -> Column:
    """HMAC-SHA256 as hex for keys of at most 64 bytes given in hex."""
    inner = F.sha2(F.concat(F.unhex(_xor_pad(key_hex, 0x36)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(_xor_pad(key_hex, 0x5C)), F.unhex(inner)), 256)


def record_message_parts(log_cols: dict[str, Column] | None = None) -> tuple[Column, Column, Column]:
    """Canonical text of a record around its two uses of the prior hash.

    message = head + prior_hash + middle [+ prior_hash when the record cites it] + tail
    Only the prior hash depends on other rows, so all three parts are made row-parallel.
    """
    c = {name: F.col(name) for name in
         ("idx", "ts_ms", "rec_type", "content_json", "refs", "writer", "cites_prior")}
    c.update(log_cols or {})
    content = canonical_json(c["content_json"])
    quoted = F.transform(c["refs"], lambda r: F.concat(F.lit('"'), r, F.lit('"')))
    refs = F.array_join(quoted, ",")
    head = F.concat(F.lit('{"content":'), content, F.lit(',"content_hash":"'), F.sha2(content, 256),
                    F.lit('","index":'), c["idx"].cast("string"), F.lit(',"prior_hash":"'))
    opener = F.when(~c["cites_prior"], F.lit("")).when(F.size(c["refs"]) > 0, F.lit(',"')).otherwise(F.lit('"'))
    middle = F.concat(F.lit('","pubkey":"'), c["writer"], F.lit('","refs":['), refs, opener)
    tail = F.concat(F.when(c["cites_prior"], F.lit('"')).otherwise(F.lit("")),
                    F.lit('],"timestamp":'), c["ts_ms"].cast("string"),
                    F.lit(',"type":"'), c["rec_type"], F.lit('"}'))
    return head, middle, tail


def record_digest() -> Column:
    """Record hash recomputed from a stored row (its refs are already resolved)."""
    head, middle, tail = record_message_parts({"cites_prior": F.lit(False)})
    return F.sha2(F.concat(head, F.col("prior_hash"), middle, tail), 256)
