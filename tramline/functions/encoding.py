"""Repair of text that was decoded with the wrong charset; Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CYRILLIC = re.compile("[А-Яа-яЁё]")
_BROKEN = re.compile("[РС][ -¿Ђ-џ‐-™]|[ÐÑ][\u0080-¿]|�")
CHARSETS = ("utf-8", "cp1251", "koi8-r", "latin-1")


def plausible(text: str) -> int:
    """Cyrillic letters count for a text, pairs that wrong decoding leaves against it."""
    return len(_CYRILLIC.findall(text)) - 8 * len(_BROKEN.findall(text))


def repair(text: str | None) -> str:
    """The most plausible of the text and what two rounds of encoding it back and decoding it as UTF-8 give."""
    found = [text or ""]
    for _ in range(2):
        for own in list(found):
            for charset in ("cp1251", "latin-1"):
                try:
                    again = own.encode(charset).decode("utf-8")
                except UnicodeError:
                    continue
                if again not in found:
                    found.append(again)
    return max(found, key=plausible)


def decode(raw: bytes | None) -> str:
    """Bytes under the charset that makes the most plausible text; ties go to the earlier of CHARSETS."""
    if not raw:
        return ""
    found = []
    for charset in CHARSETS:
        try:
            found.append(raw.decode(charset))
        except UnicodeError:
            continue
    return repair(max(found, key=plausible))


@F.pandas_udf(T.StringType())
def repaired(texts: pd.Series) -> pd.Series:
    return texts.map(repair)


@F.pandas_udf(T.StringType())
def decoded(raws: pd.Series) -> pd.Series:
    return raws.map(decode)
