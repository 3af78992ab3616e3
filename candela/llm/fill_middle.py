"""Fill-in-the-middle rewriting through a piecewise-linear learned rank index.

A document is cut at boundaries between tokens. Where the r-th boundary lies is learned from the document itself: straight
segments are fitted to all of its boundary offsets, each as long as no boundary strays from it by more than ERROR code points,
and what is left is stored as one signed byte a boundary. A cut at rank r is predicted by r's segment and put right by r's
residual, so a place is found exactly without the offsets. The index (segments and residuals) depends on the text alone:
``rank_index`` gives it as columns, so that many draws of cuts can share one fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.llm.common import fresh, with_columns

#: How far a boundary may lie from its segment; a prediction is floored, so residuals stay within a signed byte.
ERROR = 120
#: Boundaries that are tried at once; doubled while a segment goes on.
WINDOW = 512
MARKS = ("<P>", "<S>", "<M>")


def boundaries(text: str) -> np.ndarray:
    """Offsets in code points of the n + 1 boundaries of ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``: 0, the end of
    every run without white space, and the end of the text."""
    if not text:
        return np.zeros(1, np.int64)
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    space = (points == 32) | ((points >= 9) & (points <= 13))
    after = np.append(space[1:], True)
    ends = np.flatnonzero(~space & after) + 1
    return np.concatenate(([0], ends, [len(points)] if space[-1] else [])).astype(np.int64)


def fit(offsets: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first ranks, base offsets, slopes, residuals). A segment starts at a boundary and keeps the slopes by which all later
    boundaries stay within ``error``; it ends where none is left."""
    firsts, slopes, at, n = [], [], 0, len(offsets)
    while at < n:
        low, high, end, width = 0.0, np.inf, at + 1, WINDOW
        while end < n:
            some = offsets[end : end + width] - offsets[at]
            run = np.arange(end - at, end - at + len(some))
            highs, lows = np.minimum.accumulate((some + error) / run), np.maximum.accumulate((some - error) / run)
            bad = np.maximum(lows, low) > np.minimum(highs, high)
            good = int(bad.argmax()) if bad.any() else len(some)
            if good:
                low, high, end = max(low, float(lows[good - 1])), min(high, float(highs[good - 1])), end + good
            if good < len(some):
                break
            width *= 2
        firsts.append(at)
        slopes.append((low + high) / 2 if high < np.inf else 0.0)
        at = end
    first, slope = np.array(firsts, np.int64), np.array(slopes)
    base = offsets[first]
    residuals = offsets - predicted(first, base, slope, np.arange(n))
    return first, base, slope, residuals.astype(np.int8)


def predicted(first: np.ndarray, base: np.ndarray, slope: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    s = np.searchsorted(first, ranks, "right") - 1
    return base[s] + np.floor(slope[s] * (ranks - first[s])).astype(np.int64)


def located(index: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], ranks: list[int]) -> list[int]:
    """The exact offsets of the boundaries of the given ranks."""
    first, base, slope, residuals = index
    r = np.asarray(ranks, np.int64)
    return (predicted(first, base, slope, r) + residuals[r]).tolist()


SEGMENTS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("base", T.LongType()), T.StructField("slope", T.DoubleType())]))


def rank_index(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default), n (tokens), segments (first, base, slope) and residuals (a byte a boundary).

    Null and empty texts have no token and the boundary 0; very long ones are fitted whole; repeated rows are fitted each; no rows,
    no rows. A kept column with a result's name gives way to the result."""

    def make():
        def apply(texts):
            fits = [fit(boundaries(t or "")) for t in texts]
            rows = [[{"first": a, "base": b, "slope": s} for a, b, s in zip(f.tolist(), base.tolist(), slope.tolist(), strict=True)] for f, base, slope, _ in fits]
            return [len(f[3]) - 1 for f in fits], rows, [f[3].tobytes() for f in fits]

        return apply

    text = fresh(docs, "fim_text")
    fields = [T.StructField("n", T.LongType()), T.StructField("segments", SEGMENTS), T.StructField("residuals", T.BinaryType())]
    return with_columns(docs.withColumn(text, F.col(text_col).cast("string")), fields, make, [text], docs.columns if keep is None else keep)


def rewritten(text: str, digest: str, share: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, code points of prefix and middle, and the output, for the hex digest that decides the document's cuts."""
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    offsets = boundaries(text)
    n = len(offsets) - 1
    if not text or h3 % 100 >= share or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    a, b = located(fit(offsets), sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, share: int = 50, spm: int = 80, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default), n (tokens), form, prefix_chars, middle_chars (code points; null if plain) and output.

    About ``share`` in 100 documents are rewritten, ``spm`` in 100 of these with the suffix first; seed and id decide. A text that
    is empty or holds a mark stays plain, and a null text is an empty one. A null id decides as the word ``null`` would; repeated ids
    decide alike; very long texts are rewritten whole; no rows, no rows. A kept column with a result's name gives way to the result.
    """

    def make():
        def apply(texts, digests):
            return tuple(zip(*(rewritten(t or "", d, share, spm) for t, d in zip(texts, digests, strict=True)), strict=True))

        return apply

    keep = docs.columns if keep is None else keep
    text, digest = fresh(docs, "fim_text"), fresh(docs, "fim_digest")
    d = docs.withColumns({text: F.col(text_col).cast("string"), digest: F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)})
    fields = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    return with_columns(d, fields, make, [text, digest], keep)


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` made ``output`` from."""
    a, b = F.when(form == "psm", F.locate("<S>", output)).otherwise(F.locate("<P>", output)), F.locate("<M>", output)
    one, two, middle = F.substring(output, F.lit(4), a - 4), F.substring(output, a + 3, b - a - 3), F.substring(output, b + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
