"""Content keys: prefix:sha1. All of them are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitloom.consts import EOS, PREFIXES

CID = f"^[{PREFIXES}]:[0-9A-Fa-f]{{40}}$"


def sha1_hex(data: Column) -> Column:
    return F.sha1(data.cast("binary"))


def is_valid_prefix(prefix: Column) -> Column:
    return prefix.rlike(f"^[{PREFIXES}]$")


def make_cid(prefix: Column, sha1: Column) -> Column:
    """prefix:sha1; null where either is malformed."""
    cid = F.concat_ws(":", prefix, sha1)
    return F.when(cid.rlike(CID), cid)


def parse_cid(cid: Column) -> Column:
    """(prefix, sha1) of a key; null where it is malformed."""
    return F.when(cid.rlike(CID), F.struct(F.substring(cid, 1, 1).alias("prefix"), F.substring(cid, 3, 40).alias("sha1")))


def token_key(tokens: Column, prefix: str = "h") -> Column:
    """prefix:sha1 of the distinct tokens, sorted, with a NUL between each two. Strings are sorted by their UTF-8 bytes."""
    if prefix not in PREFIXES:
        raise ValueError(f"no such prefix: {prefix}")
    return F.concat(F.lit(f"{prefix}:"), sha1_hex(F.array_join(F.array_sort(F.array_distinct(tokens)), EOS)))


def original_key(tokens: Column) -> Column:
    return token_key(tokens, "o")


def content_key(tokens: Column) -> Column:
    return token_key(tokens, "h")


def retained_key(tokens: Column) -> Column:
    return token_key(tokens, "r")


def departed_key(tokens: Column) -> Column:
    return token_key(tokens, "d")


def new_key(tokens: Column) -> Column:
    return token_key(tokens, "n")


def view_key(tokens: Column) -> Column:
    return token_key(tokens, "v")


def context_key(tokens: Column) -> Column:
    return token_key(tokens, "l")


def catalog_key(values: Column) -> Column:
    return token_key(values, "c")


def commit_key(data: Column) -> Column:
    return F.concat(F.lit("t:"), sha1_hex(data))


def user_key(uuid: Column) -> Column:
    """u: and the key of a UUID without its dashes; null unless 32 hex digits are left."""
    bare = F.regexp_replace(uuid, "-", "")
    return F.when(bare.rlike("^[0-9A-Fa-f]{32}$"), F.concat(F.lit("u:"), bare))


def system_key(name: Column) -> Column:
    return F.concat(F.lit("system:"), name)


def ontological_key(parent: Column, seq: Column) -> Column:
    """sha1 of the parent's hex text and the sequence number in eight bytes, lowest first; it has no prefix."""
    low = F.regexp_replace(F.lpad(F.hex(seq.cast("long")), 16, "0"), "(..)(..)(..)(..)(..)(..)(..)(..)", "$8$7$6$5$4$3$2$1")
    return F.sha1(F.concat(parent.cast("binary"), F.unhex(low)))


def cid(data: Column) -> Column:
    """The key of a block: h:sha1 of its bytes."""
    return F.concat(F.lit("h:"), sha1_hex(data))
