"""Target-distribution importance resampling by hashed word n-grams.

The log ratio of a bucket's share in the target texts to its share in the documents is the bucket's gain; a document's weight is the
mean gain of its features, and Gumbel noise from its id makes drawing the highest scores a sample without replacement. Weights are
scored by arrays: all words of a slice of texts are cut, hashed and looked up at once. The draw gathers nothing: the score
that parts drawn from undrawn documents is found by bisection, each step an exact count job over the stored scores, and so are the id
and the row among ties. Drawn rows are range-partitioned, and ranks are places in a range plus the rows of earlier ranges.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.llm.common import ALNUM_BYTES, fresh, slices, small_batches, stored

BUCKETS, SCALE = 10_000, 1000
#: Thresholds that one count job of a bisection tries.
WAYS = 15
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


def crc_states(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, states: np.ndarray) -> np.ndarray:
    """CRC-32 states (before the last inversion) after reading ``sizes`` bytes of ``data`` from ``starts``: all runs read their k-th byte at once."""
    table, out = crc_table(), states.copy()
    order = np.argsort((LONG_WORD + 1 - np.minimum(sizes, LONG_WORD + 1)).astype(np.uint8), kind="stable")  # longest first
    order, long = order[sizes[order] <= LONG_WORD], np.flatnonzero(sizes > LONG_WORD)
    at, state = starts[order], states[order]
    active = np.searchsorted(-sizes[order], -np.arange(1, LONG_WORD + 1), "right")  # runs of at least k bytes
    for k, n in enumerate(active.tolist()):
        if not n:
            break
        state[:n] = table[(state[:n] ^ data[at[:n] + k]) & 255] ^ (state[:n] >> np.uint32(8))
    out[order] = state
    for i in long.tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]], int(states[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of every word and every pair of neighbouring words, and the words of each text."""
    texts = pc.fill_null(texts, "")
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(bytes(memoryview(raw)[bounds[0] : bounds[-1]]).translate(ALNUM_BYTES) if raw else b"", np.uint8)
    bounds -= bounds[0]
    inside = np.concatenate(([False], data != 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    inner = bounds[1:-1]
    split = np.unique(inner[inside[inner + 1] & inside[inner]]) if len(inner) else inner  # texts that meet without a space between
    starts, ends = np.sort(np.concatenate((edges[::2], split))), np.sort(np.concatenate((edges[1::2], split)))
    text = np.searchsorted(bounds, starts, "right") - 1
    sizes = ends - starts
    words = crc_states(data, starts, sizes, np.full(len(starts), 0xFFFFFFFF, np.uint32))
    first = np.flatnonzero(text[:-1] == text[1:])
    table = crc_table()
    spaced = table[(words[first] ^ np.uint32(32)) & 255] ^ (words[first] >> np.uint32(8))
    pairs = crc_states(data, starts[first + 1], sizes[first + 1], spaced)
    hashes = ~np.concatenate((words, pairs))
    return (hashes % np.uint32(BUCKETS)).astype(np.int64), np.concatenate((text, text[first])), np.bincount(text, minlength=len(texts))


def bucket_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n): how often the features of all texts fall into each bucket. A task sends a row a bucket at most."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch):
                total += np.bincount(features(part.column(0))[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """floor(SCALE * ln((t + 1) (S + BUCKETS) / ((s + 1) (T + BUCKETS)))) by bucket, in doubles."""
    s_all, t_all = sum(source.values()) + BUCKETS, sum(target.values()) + BUCKETS
    return np.array([math.floor(SCALE * math.log((target.get(b, 0) + 1) * s_all / ((source.get(b, 0) + 1) * t_all))) for b in range(BUCKETS)], np.int64)


def noise(seed: int, ident) -> int:
    """floor(-SCALE * ln(-ln(u))), u from the first 8 hex digits of sha256(seed:id); a null id counts as the word null."""
    h = int(hashlib.sha256(f"{seed}:{'null' if ident is None else ident}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, *, id_col: str, text_col: str, seed: int, keep: list[str]) -> DataFrame:
    """``keep`` columns, n_words, n_features, weight and score of each row."""
    text, ident = fresh(docs, "score_text"), fresh(docs, "score_id")
    d = docs.withColumns({text: F.col(text_col).cast("string"), ident: F.col(id_col)})
    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score")]
    schema = T.StructType([d.schema[c] for c in keep] + fields)
    table = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS longs

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                bucket, row, words = features(part.column(text))
                total = np.zeros(len(words), np.int64)
                np.add.at(total, row, table.value[bucket])
                n = words + np.maximum(words - 1, 0)
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                score = weight + np.array([noise(seed, i) for i in part.column(ident).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(x.astype(np.int64)) for x in (words, n, weight, score))], names=schema.names)

    return d.select(*dict.fromkeys([*keep, text, ident])).mapInArrow(run, schema)


def least_with(rows: DataFrame, value: Column, k: int) -> int | None:
    """The least v such that at least ``k`` of the non-null ``value`` are v or less (None if there are fewer): each count job tries
    WAYS thresholds, so the range shrinks by WAYS + 1."""
    lo, hi, n = rows.agg(F.min(value), F.max(value), F.count(value)).first()
    if n < k:
        return None
    while lo < hi:
        span = hi - lo
        tried = sorted({lo + span * i // (WAYS + 1) for i in range(1, WAYS + 1)})
        counts = rows.agg(*(F.count_if(value <= v).alias(f"c{i}") for i, v in enumerate(tried))).first()
        enough = [v for v, c in zip(tried, counts, strict=True) if c >= k]
        few = [v for v, c in zip(tried, counts, strict=True) if c < k]
        lo, hi = max(few) + 1 if few else lo, min(enough) if enough else hi
    return lo


def drawn(rows: DataFrame, k: int, id_col: str, place: str) -> Column:
    """Which of ``rows`` (score, id, place; stored) are the ``k`` highest in score, ties to the smaller id, null ids last, rows of one id by place."""
    score, ident = F.col("score"), F.col(id_col)
    if k <= 0:
        return F.lit(False)
    cut = -least_with(rows, -score, k)
    more = k - rows.where(score > cut).count()
    tied = rows.where(score == cut)
    last = least_with(tied, ident.cast("long"), more)
    if last is None:
        more -= tied.where(ident.isNotNull()).count()
        before, same = ident.isNotNull(), ident.isNull()
    else:
        more -= tied.where(ident < last).count()
        before, same = F.coalesce(ident < last, F.lit(False)), F.coalesce(ident == last, F.lit(False))
    end = least_with(tied.where(same), F.col(place), more) if more else -1
    return (score > cut) | ((score == cut) & (before | (same & (F.col(place) <= end))))


def ranked(rows: DataFrame, id_col: str, place: str) -> DataFrame:
    """``rows`` with rank from 1 by falling score, then id, null ids last, then place. Ranges are cut at unique keys, so ties spread."""
    spark = rows.sparkSession
    parts, at = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), fresh(rows, "rank_at")
    keys = [F.desc("score"), F.asc_nulls_last(id_col), F.asc(place)]
    ordered = stored(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()), "ordered")
    sizes = ordered.groupBy(F.shiftright(at, 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a range
    base, before = [], 0
    for r in sorted(sizes, key=lambda r: r["p"]):
        base.append((r["p"], before))
        before += r["n"]
    p, b = fresh(ordered, "rank_part"), fresh(ordered, "rank_base")
    bases = spark.createDataFrame(base, f"{p} long, {b} long")
    inside = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn(p, F.shiftright(at, 33)).join(F.broadcast(bases), p).withColumn("rank", F.col(b) + inside + 1).drop(at, p, b)


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: int = 25, least_words: int = 20, seed: int = 7, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (the id by default) of all ``docs``, n_words, n_features, weight, score and rank, null where a row is not drawn.

    Of the N rows with at least ``least_words`` words the floor(share * N / 100) highest in score are drawn. Null and empty texts have no feature and
    weight 0; very long ones are read whole; rows that repeat an id have its noise and count each, those equal in score and id by
    their place; null ids come last among ties. Ids are integers. Without target texts all weights follow from the documents alone; no rows, no rows.
    A kept column with a result's name gives way to the result.
    """
    results = ["n_words", "n_features", "weight", "score", "rank"]
    ident, place = fresh(docs, "draw_id"), fresh(docs, "draw_place")
    keep = [c for c in (keep or [id_col]) if c.lower() not in results]
    source = dict(bucket_counts(docs, text_col).collect())  # BUCKETS rows at most, as the next
    gain = gains(source, dict(bucket_counts(target, text_col).collect()))
    d = scored(docs.withColumn(ident, F.col(id_col)), gain, id_col=ident, text_col=text_col, seed=seed, keep=[*keep, ident])
    all_rows = stored(d.withColumn(place, F.monotonically_increasing_id()), "scores")
    able = all_rows.where(F.col("n_words") >= least_words)
    chosen = (F.col("n_words") >= least_words) & drawn(able, share * able.count() // 100, ident, place)
    kept = [*keep, *results]
    return all_rows.where(~chosen).withColumn("rank", F.lit(None).cast("long")).select(*kept).unionByName(ranked(all_rows.where(chosen), ident, place).select(*kept))
