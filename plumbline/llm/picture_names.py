"""The identity of a picture that a file name means."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.hashing import by_value

_EXTENSION = re.compile(r"\.(?:jpe?g|jpe|jfif|png|webp|gif|bmp|tiff?|heic|heif|avif|img)$")
#: What file managers add to a copy's name, before or after the stem.
_BEFORE = re.compile(r"^(?:copy(?:[ _-]*\(?\d+\)?)?[ _-]+of|kopie[ _-]+von|copie[ _-]+de)[ _-]+")
_AFTER = re.compile(r"(?:[ _-]*\(\d+\)|[ _-]+\(?(?:copy|kopie|copie)(?:[ _-]*\(?\d+\)?)?\)?|~\d*)$")
_SEPARATORS = re.compile(r"[\s_.,+-]+")


def picture_name(name: str | None) -> str | None:
    """``folders/stem`` in one spelling; null and blank names mean no picture.

    Letter case, path notation (backslashes, ``.`` and empty parts), percent escapes,
    the separators between the stem's words, the extension and copy marks don't count.
    Folders keep their separators, and every character of the number that ends the
    stem stays.
    """
    if name is None:
        return None
    text, last = name, None
    while text != last:
        text, last = unquote(text), text
    path = posixpath.normpath("/" + text.strip().casefold().replace("\\", "/")).lstrip("/")
    if path in ("", "."):
        return None
    folder, _, stem = path.rpartition("/")
    last = None
    while stem != last:
        last, stem = stem, stem.strip()
        for pattern in (_EXTENSION, _BEFORE, _AFTER):
            stem = pattern.sub("", stem, count=1) or stem
    stem = _SEPARATORS.sub("-", stem).strip("-") or stem  # a stem of separators alone has no words to part
    return f"{folder}/{stem}"


@F.pandas_udf(T.StringType())
def picture_name_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for names in batches:
        yield names.map(picture_name)


by_value()
