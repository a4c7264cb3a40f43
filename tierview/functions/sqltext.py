"""Quoting helpers for the SQL expression strings that plans are made of."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def ident(name: str) -> str:
    """Back-quoted identifier."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col(ident(name))


def table_ref(*parts: str) -> str:
    """Back-quoted, dotted table name; each part may itself be dotted (``cat.db``)."""
    names = [n for part in parts if part for n in part.split(".")]
    return ".".join(ident(n) for n in names)


def string(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_regex(text: str) -> str:
    """SQL string literal of a regular expression that matches ``text`` itself."""
    if not text:
        raise ValueError("an empty delimiter cannot be split on")
    return string(text if text.isalnum() else re.sub(r"([^0-9A-Za-z])", r"\\\1", text))


def error_text(error: Exception) -> str:
    """What an error says, whole; its kind where it says nothing."""
    return str(error).strip() or type(error).__name__
