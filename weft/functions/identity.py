"""Stable identities (FN-1 to FN-7)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the separator between the parts of edge and metadata identities.
UNIT_SEPARATOR = "\x1f"


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def file_sha256(content: Column) -> Column:
    """Hash of raw bytes; the same expression serves ``binaryFile`` content."""
    return F.sha2(content, 256)


def canonical_json(numbers: Mapping[str, Column], strings: Mapping[str, Column]) -> Column:
    """Compact JSON with keys in sorted order and raw Unicode, of non-null values.

    Rows whose texts need no escape, nearly all, are built by plain concatenation. For the
    others ``to_json`` writes the hex digits of control characters in upper case, where the
    canonical form has lower case.
    """
    plain: list[Column] = []
    for at, name in enumerate(sorted([*numbers, *strings])):
        head = f'{"," if at else "{"}"{name}":'
        if name in numbers:
            plain += [F.lit(head), numbers[name].cast("string")]
        else:
            plain += [F.lit(head + '"'), strings[name], F.lit('"')]
    values = {**numbers, **strings}
    escaped = F.to_json(F.struct(*[values[name].alias(name) for name in sorted(values)]))
    for digit in "ABCDEF":
        # An even run of backslashes before the escape means the escape is a real one.
        escaped = F.regexp_replace(
            escaped, rf"(?<!\\)((?:\\\\)*\\u00[01]){digit}", f"$1{digit.lower()}"
        )
    special = F.concat(*strings.values()).rlike(r'[\x00-\x1f"\\]')
    return F.when(special, escaped).otherwise(F.concat(*plain, F.lit("}")))


def stable_hash(numbers: Mapping[str, Column], strings: Mapping[str, Column]) -> Column:
    return F.sha2(canonical_json(numbers, strings), 256)


# The parts of a node identity.
NODE_ID_NUMBERS = ("lineno", "col_offset", "end_lineno", "end_col_offset")
NODE_ID_STRINGS = ("repo_name", "file_path", "node_type", "structural_path")


# The columns of a node table that its identities are made of.
NODE_ID_COLUMNS = (*NODE_ID_STRINGS, *NODE_ID_NUMBERS, "name")


def node_id() -> Column:
    """Identity of one node occurrence, from the columns of a node table."""
    strings = {name: F.col(name) for name in NODE_ID_STRINGS}
    strings["name"] = F.coalesce(F.col("name"), F.lit(""))
    return stable_hash({name: F.col(name) for name in NODE_ID_NUMBERS}, strings)


def edge_id(
    repo: str = "repo_name",
    file: str = "file_path",
    edge_type: str = "edge_type",
    source: str = "source_id",
    target: str = "target_id",
) -> Column:
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, repo, file, edge_type, source, target), 256)


def metadata_id(repo: str = "repo_name", file: str = "file_path") -> Column:
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, repo, file), 256)


def file_key(repo: str = "repo_name", file: str = "file_path") -> Column:
    """``repo:file``, the key of a source file and of an error event."""
    return F.concat_ws(":", repo, file)


def packed(identity: Column) -> Column:
    """An identity as bytes: half as many for lower-case hex digits, as hashes have. Different ones stay different."""
    halved = F.unhex(identity)
    fits = halved.isNotNull() & (F.length(halved) * 2 == F.length(identity)) & (F.lower(identity) == identity)
    whole = F.concat(F.lit(bytearray(b"\x00")), identity.cast("binary"))
    return F.when(fits, F.concat(F.lit(bytearray(b"\x01")), halved)).otherwise(whole)


def unpacked(identity: Column) -> Column:
    """What :func:`packed` was given."""
    rest = F.substring(identity, 2, 1 << 30)
    return F.when(F.hex(F.substring(identity, 1, 1)) == "01", F.lower(F.hex(rest))).otherwise(rest.cast("string"))
