"""Quality classifier: an interpolated modified Kneser-Ney character n-gram model of trusted text.

Documents are dealt into blocks of a bounded number of bytes. A block counts its n-grams once: how often each occurs in
its trusted texts, and which occur at all. Counts meet by n-gram, so the model - counts, continuation counts, context
totals - lives in shards that are joined to each other and never in one place. The distinct n-grams of all blocks are
joined to it order by order, which gives each its interpolated probability; these go back to the blocks that hold the
n-gram, and every document's perplexity is summed there. A document is kept if its perplexity lies between quantiles of
trusted documents of its language that the model was not trained on: one trusted document in ``FOLDS`` sets the quantiles,
the others train. (Training documents look less surprising than new ones, so they can't set them.)

An n-gram of order k is a long: k UTF-16 units of 16 bits, the predicted one lowest. So the context is a shift by 16 and
the shorter gram is a mask. ORDER is 4, the most that a long holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.common import slices, stored

ORDER = 4
BLOCK_BYTES, SLICE = 16 << 20, 1 << 20
#: A document goes if its perplexity is above the upper or below the lower quantile of trusted documents of its language.
UPPER, LOWER = 0.99, 0.005
FOLDS = 3
#: Allowance for the sampling error of an extreme quantile: few documents widen the bounds by this factor, and from FEW on
#: its logarithm falls with the root of their number.
MARGIN, FEW = 1.15, 25


def grams(text: str | None) -> np.ndarray:
    """The n-gram that ends at each UTF-16 unit; line feeds stand before the first."""
    units = np.frombuffer(("\n" * (ORDER - 1) + (text or "")).encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    n = len(units) - ORDER + 1
    out = np.zeros(n, np.uint64)
    for j in range(ORDER):
        out = out << np.uint64(16) | units[j : j + n]
    return out


def _pieces(table: pa.Table):
    for batch in table.combine_chunks().to_batches():
        yield from slices(batch, SLICE)


def blocked(docs: DataFrame, id_col: str, lang_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(doc_id, lang, text, block) and the number of blocks."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = docs.select(F.octet_length(text).alias("n")).agg(F.sum("n")).first()[0] or 0
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), text.alias("text"))
    return d.withColumn("block", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), "text")), F.lit(size // BLOCK_BYTES + 1)).cast("int")), size // BLOCK_BYTES + 1


def counted(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(block, gram, n): the distinct n-grams of each block, and how often its trusted texts have them."""

    def run(d: pa.Table, t: pa.Table) -> pa.Table:
        known = set(t.column("doc_id").to_pylist())
        keys, ns, at = [], [], d.column("block")[0].as_py() if d.num_rows else 0
        for part in _pieces(d):
            for good in (True, False):
                mine = [x for i, x in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) if (i in known) == good and x]
                if mine:
                    k, n = np.unique(np.concatenate([grams(x) for x in mine]), return_counts=True)
                    keys.append(k)
                    ns.append(n if good else np.zeros_like(n))
        k, where = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, np.uint64), np.zeros(0, int))
        n = np.bincount(where, np.concatenate(ns), len(k)).astype(np.int64) if keys else np.zeros(0, np.int64)
        return pa.table({"block": pa.array(np.full(len(k), at, np.int32)), "gram": pa.array(k.view(np.int64)), "n": pa.array(n)})

    return docs.groupBy("block").cogroup(trusted.groupBy("block")).applyInArrow(run, "block int, gram long, n long")


def scored(docs: DataFrame, probabilities: DataFrame) -> DataFrame:
    """(doc_id, lang, owner, n_units, nll): the summed negative log2 probability of each document."""

    def run(d: pa.Table, p: pa.Table) -> pa.Table:
        keys, logs = p.column("gram").to_numpy().view(np.uint64), p.column("logp").to_numpy()
        order = np.argsort(keys)
        keys, logs = keys[order], logs[order]
        units, nll = [], []
        for part in _pieces(d):
            each = [grams(x) for x in part.column("text").to_pylist()]
            sizes = np.array([len(g) for g in each])
            sums = np.zeros(len(each))
            if sizes.sum():
                got = logs[np.minimum(np.searchsorted(keys, np.concatenate(each)), len(keys) - 1)]
                full = sizes > 0
                sums[full] = np.add.reduceat(got, (np.cumsum(sizes) - sizes)[full])
            units.append(sizes)
            nll.append(-sums)
        cat = lambda x, t: pa.array(np.concatenate(x).astype(t)) if x else pa.array([], pa.from_numpy_dtype(t))
        return pa.table({"doc_id": d.column("doc_id"), "lang": d.column("lang"), "owner": d.column("owner"), "n_units": cat(units, np.int64), "nll": cat(nll, np.float64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.withColumn("owner", F.xxhash64("text")).groupBy("block").cogroup(probabilities.groupBy("block")).applyInArrow(run, f"doc_id {kind}, lang string, owner long, n_units long, nll double")


def _shorter(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the counts of counts (Chen and Goodman 1999); guarded where a count of counts is zero."""
    r = counts.agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, 5))).first()
    n1, n2, n3, n4 = (r[f"n{k}"] for k in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def probabilities(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, logp) of every wanted n-gram under the model of ``counts`` (gram, n; n > 0): the shards are joined order by order."""
    by_order = {ORDER: stored(counts, "counts")}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: in how many longer types a gram is the end
        by_order[k] = stored(by_order[k + 1].groupBy(_shorter(F.col("gram"), k + 1).alias("gram")).agg(F.count("*").alias("n")), "counts")
    needs = {ORDER: wanted}
    for k in range(ORDER - 1, 0, -1):
        needs[k] = needs[k + 1].select(_shorter(F.col("gram"), k + 1).alias("gram")).distinct()
    kinds = by_order[1].count()
    below = None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(by_order[k])
        n = F.col("n")
        off = F.when(n >= 3, d3).when(n == 2, d2).otherwise(d1)
        context = by_order[k].groupBy(F.shiftrightunsigned("gram", 16).alias("context")).agg(F.sum("n").alias("total"), F.sum(off).alias("freed"))
        w = needs[k].withColumn("context", F.shiftrightunsigned("gram", 16)).join(by_order[k], "gram", "left").join(context, "context", "left")
        if below is None:
            rest = F.lit(1.0 / (kinds + 1))
        else:
            w = w.withColumn("short", _shorter(F.col("gram"), k)).join(below.select(F.col("gram").alias("short"), F.col("p").alias("rest")), "short")
            rest = F.col("rest")
        p = F.when(F.col("total").isNull(), rest).otherwise((F.coalesce(n - off, F.lit(0.0)) + F.col("freed") * rest) / F.col("total"))
        below = stored(w.select("gram", p.alias("p")), "probabilities")
    return below.select("gram", F.log2("p").alias("logp"))


def dealt(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(training, calibration) ids of the trusted documents."""
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id").cast("string")), F.lit(FOLDS))
    return ids.where(fold != 0), ids.where(fold == 0)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", trusted: Column | None = None, upper: float = UPPER, lower: float = LOWER, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang, owner (xxhash64 of the text), n_units, perplexity, low, high and kept: a row a document.

    ``trusted`` picks the rows of ``labels`` whose documents train the model or set its quantiles (by default quality 1
    and toxic 0); all of them do the one or the other. Null and empty texts have no perplexity and are not kept; a null language is a language of its own; a
    language without such documents takes the quantiles of all; without any every text is kept.
    Rows with null ids are scored but never train; repeated rows are scored each, and train each if their id is trusted.
    """
    trusted = (F.col("quality") == 1) & (F.col("toxic") == 0) if trusted is None else trusted
    d, blocks = blocked(docs, id_col, lang_col, text_col)
    ids = labels.where(trusted).select(F.col(id_col).alias("doc_id")).where("doc_id is not null").distinct()
    ids = ids.withColumn("block", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(blocks)).cast("int"))
    training, calibration = dealt(ids)
    seen = stored(counted(d, training), "grams")
    logs = probabilities(seen.where("n > 0").groupBy("gram").agg(F.sum("n").alias("n")), seen.select("gram").distinct())
    s = scored(d, seen.select("block", "gram").join(logs, "gram"))
    s = stored(s.withColumn("perplexity", F.when(F.col("n_units") > 0, F.pow(F.lit(2.0), F.col("nll") / F.col("n_units")))).drop("nll"), "scores")
    marks = [F.percentile_approx("perplexity", lower, 100_000).alias("low"), F.percentile_approx("perplexity", upper, 100_000).alias("high"), F.count("*").alias("n_good")]
    good = s.where("perplexity is not null").join(calibration.select("doc_id"), "doc_id", "left_semi")
    by_lang = good.groupBy("lang").agg(*marks)
    low, high, n_good = good.agg(*marks).first()
    wider = F.pow(F.lit(margin), F.sqrt(F.lit(FEW) / F.greatest(F.lit(FEW), F.coalesce("n_good", F.lit(n_good)))))
    out = s.join(by_lang, "lang", "left").withColumns({"low": F.coalesce("low", F.lit(low).cast("double")) / wider, "high": F.coalesce("high", F.lit(high).cast("double")) * wider})
    inside = F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return out.select("doc_id", "lang", "owner", "n_units", "perplexity", "low", "high", (F.col("perplexity").isNotNull() & inside).alias("kept"))
