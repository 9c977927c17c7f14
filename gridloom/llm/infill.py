"""Fill-in-the-middle: texts are cut at two of their tokens and put together with the middle last.

One full match of a repeated group keeps every repetition of the group, so that the ends of all tokens, and with
them their number and both cuts, come from one call of the regex library, which has no loop over tokens.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The tokens, the marks of prefix, suffix and middle, the percentages of forms.
TOKENS = regex.compile(r"([A-Za-z]++|[^A-Za-z])*+")
P, S, M = "<P>", "<S>", "<M>"
CHANGED, SUFFIX_FIRST = 90, 20

_MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: str) -> list[int]:
    """Four numbers that follow from an id."""
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(doc_id: str, text: str) -> tuple[int, str, int | None, int | None, str]:
    """Number of tokens, form, lengths of prefix and middle, and the text in that form."""
    ends = [0, *TOKENS.fullmatch(text).ends(1)]
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(doc_id)
    if not text or P in text or S in text or M in text or h3 % 100 >= CHANGED:
        return n, "plain", None, None, text
    a, b = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, f"{S}{suffix}{P}{prefix}{M}{middle}"
    return n, "psm", a, b - a, f"{P}{prefix}{S}{suffix}{M}{middle}"


def restored(output: str, form: str) -> str:
    """The text that was given this form. It holds no mark itself, so the first of each is the one that was set."""
    if form == "plain":
        return output
    first, second = (P, S) if form == "psm" else (S, P)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(M)
    return one + middle + two if form == "psm" else two + middle + one


def _made(doc_id: pd.Series, text: pd.Series) -> pd.DataFrame:
    rows = [transformed(i, t) for i, t in zip(doc_id, text, strict=True)]
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in _MADE.split(", ")])
    return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})


def _rebuilt(output: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([restored(o, f) for o, f in zip(output, form, strict=True)], dtype=object)


def transform(docs: DataFrame) -> DataFrame:
    """docs with n (tokens), form, prefix_chars, middle_chars and output; columns of these names are replaced.

    A null text is empty, and an empty one stays plain, as does one that holds a mark. Rows draw by their
    doc_id, so that repeated rows come out alike; rows without one draw as an id "null"."""
    common.small_batches(docs.sparkSession)
    rest = docs.drop(*[x.split()[0] for x in _MADE.split(", ")])
    made = F.pandas_udf(_made, _MADE)(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("text"), F.lit("")))
    names = [F.col(c) for c in rest.columns]
    return rest.select(*names, made.alias("_made")).select(*names, "_made.*")


def restore(output: Column, form: Column) -> Column:
    """The original texts of `transform`'s outputs."""
    return F.pandas_udf(_rebuilt, "string")(output, form)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and SHA-256 of outputs and of the texts rebuilt from them."""
    back = found.withColumn("_back", restore(F.col("output"), F.col("form")))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("_back").cast("binary"), 256).alias("restored_sha256"))
