"""Content identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def git_object_sha(content: Column, kind: str) -> Column:
    """Lower-case hex SHA-1 of a git object of this kind with these bytes."""
    content = content.cast("binary")
    size = F.octet_length(content).cast("string").cast("binary")
    return F.sha1(F.concat(F.lit(f"{kind} ").cast("binary"), size, F.lit(b"\0"), content))


def git_blob_sha(content: Column) -> Column:
    """Lower-case hex SHA-1 of a git blob with these bytes."""
    return git_object_sha(content, "blob")


def is_blob_sha(sha: Column) -> Column:
    """40 (SHA-1) or 64 (SHA-256) hex digits."""
    return F.coalesce(sha.rlike("^([0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"), F.lit(False))


def hex_lower(content: Column) -> Column:
    return F.lower(F.hex(content))


def entry_path(sha: Column) -> Column:
    """Where an entry lies in a fanned-out tree: two digits, a slash, the rest."""
    return F.concat_ws("/", F.substring(sha, 1, 2), F.substring(sha, 3, 62))


def sha_of_entry(path: Column) -> Column:
    """The inverse of ``entry_path``; null for anything else."""
    return F.when(path.rlike("^[0-9a-fA-F]{2}/[0-9a-fA-F]{38}([0-9a-fA-F]{24})?$"), F.replace(path, F.lit("/"), F.lit("")))
