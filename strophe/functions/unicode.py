"""Keys that need Unicode normalisation, which Spark has no function for (Arrow UDFs)."""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# executors need no copy of this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BRACKETS = {"(": ")", "[": "]", "{": "}"}


def bare(text: str) -> str:
    """Compatibility letters without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def key_of(text: str) -> str:
    return "".join(c for c in bare(text).lower() if c.isalnum())


def slug_of(text: str) -> str:
    return re.sub(r"-+", "-", "".join(c if c.isalnum() else "-" for c in bare(text).lower())).strip("-")


def squash(text: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in bare(text.lower())).split())


def plain_title(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).replace("_", " ").split())


def ending_of(line: str) -> str:
    """Last three letters of a line, for end rhymes."""
    letters = [c for c in unicodedata.normalize("NFKD", line.lower()) if c.isalpha() and not unicodedata.combining(c)]
    return "".join(letters[-3:])


def without_brackets(text: str) -> str:
    """Without bracketed parts, nested and unclosed ones too."""
    out, depth = [], 0
    for c in text:
        if c in BRACKETS:
            depth += 1
        elif c in BRACKETS.values():
            depth = max(0, depth - 1)
        elif not depth:
            out.append(c)
    return " ".join("".join(out).split())


def composed_text(text: str) -> str:
    return unicodedata.normalize("NFC", text)


def arrow_udf(f):
    """A string function over Arrow batches; null stays null."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, StringType())


name_key = arrow_udf(key_of)
name_slug = arrow_udf(slug_of)
squashed = arrow_udf(squash)
plain = arrow_udf(plain_title)
line_ending = arrow_udf(ending_of)
unaccented = arrow_udf(bare)
unbracketed = arrow_udf(without_brackets)
composed = arrow_udf(composed_text)
