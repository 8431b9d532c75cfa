"""Spelling rules of repository names, topics and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def repository_key(name: Column) -> Column:
    """``owner/project`` in one spelling: lower case, no host, no ``.git``, no stray slashes or blanks.

    Null, blank and slash-only names give null (they name no repository).
    """
    key = F.lower(F.regexp_replace(name, r"(?U)^[\s/]+|[\s/]+$", ""))
    key = F.regexp_replace(key, r"^(?:[a-z][a-z0-9+.\-]*://[^/]+/+|git@[^:/]+[:/]+)", "")
    key = F.regexp_replace(key, r"(?U)\.git[\s/]*$", "")
    key = F.regexp_replace(key, r"(?U)\s*/[\s/]*", "/")
    key = F.regexp_replace(key, r"(?U)^[\s/]+|[\s/]+$", "")
    return F.when(key != "", key)


def topic_key(topic: Column) -> Column:
    """A topic in one spelling: lower case, separators as one blank, none at the ends; null and blank give null."""
    key = F.trim(F.regexp_replace(F.lower(topic), r"(?U)[^\p{L}\p{N}]+", " "))
    return F.when(key != "", key)
