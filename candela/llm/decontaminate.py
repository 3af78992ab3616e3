"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive benchmark words. For each pattern length a shift table over blocks of words tells
how far the scan may jump, a bucket table keyed by the closing block and then the opening block selects the few
patterns that could end here, and a direct comparison of the words confirms them.

Patterns are read in blocks of about ``max_patterns`` and ``max_bytes`` at most. A block's words and window numbers, and
nothing that grows with the items, are broadcast to one scan over the documents; a benchmark that outgrows one block adds
further scans, each stored before the next begins and its block removed from all executors, so one block is out at a time.
Which items hold a window is joined to the hits in Spark.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.llm.common import alnum_words, fresh, stored, with_columns

#: A broadcast block: about this many patterns and, as a word may be of any length, this many bytes of their text at most, which
#: with the tables stay below about 100 MB in a Python worker. Patterns are dealt by hash; a block goes over by one pattern.
MAX_PATTERNS, MAX_BYTES = 100_000, 16 << 20


class WuManber:
    """Shift, bucket and prefix tables of one pattern length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], int], block: int = 2):
        self.m, self.b = length, min(block, length)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = defaultdict(dict)
        for words, number in patterns.items():
            for end in range(self.b, length + 1):
                key = words[end - self.b : end]
                self.shift[key] = min(self.shift.get(key, length), length - end)
            self.bucket[words[-self.b :]].setdefault(words[: self.b], []).append((words, number))

    def find(self, words: list[bytes]):
        """(start, pattern number) of every occurrence, left to right."""
        m, b, far = self.m, self.b, self.m - self.b + 1
        shift, end, n = self.shift.get, self.m, len(words)
        while end <= n:
            step = shift(tuple(words[end - b : end]), far)
            if step == 0:
                start, step = end - m, 1
                for pattern, number in self.bucket[tuple(words[end - b : end])].get(tuple(words[start : start + b]), ()):
                    if tuple(words[start:end]) == pattern:
                        yield start, number
            end += step


def windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = 10) -> tuple[DataFrame, DataFrame]:
    """(number, win), each distinct window once, and (number, item) of the items that hold it; both stored."""

    def make():
        def cut(texts):
            out = []
            for t in texts:
                w = [x.decode("utf-8", "replace") for x in alnum_words(t)]
                out.append([" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))] if w else [])
            return (out,)

        return cut

    b = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    cut = with_columns(b, [T.StructField("wins", T.ArrayType(T.StringType()))], make, ["text"], ["item"])
    held = stored(cut.select("item", F.explode("wins").alias("win")).distinct(), "held")
    numbered = stored(held.select("win").distinct().select(F.monotonically_increasing_id().alias("number"), "win"), "windows")
    return numbered, stored(held.where("item is not null").join(numbered, "win").select("number", "item"), "items")


def marked(docs: DataFrame, patterns: DataFrame, *, text_col: str = "text", keep: list[str], max_patterns: int = MAX_PATTERNS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``keep`` columns plus n_words, hit_spans, hit_windows (numbers of ``patterns`` (number, win) that occur) and n_hit."""
    spark = docs.sparkSession
    many, size = patterns.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("win")), F.lit(0))).first()
    blocks = max(1, math.ceil(many / max_patterns), math.ceil(size / max_bytes))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.IntegerType())), T.StructField("hit_windows", T.ArrayType(T.LongType())), T.StructField("n_hit", T.LongType())]
    text = fresh(docs, "scan_text")
    out = docs.withColumn(text, F.col(text_col).cast("string"))
    for k in range(blocks):
        mine = patterns.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == k) if blocks > 1 else patterns
        table = spark.sparkContext.broadcast([tuple(r) for r in mine.select("number", "win").collect()])

        def make(table=table):
            by_length: dict[int, dict] = defaultdict(dict)
            for number, win in table.value:
                words = tuple(x.encode() for x in win.split(" "))
                by_length[len(words)][words] = number
            machines = [WuManber(m, p) for m, p in sorted(by_length.items())]

            def apply(texts, spans_before=None, windows_before=None):
                counts, spans, found_windows, hits = [], [], [], []
                for i, t in enumerate(texts):
                    words = alnum_words(t)
                    found, numbers = [], set()
                    if spans_before is not None:
                        s = spans_before[i]
                        found, numbers = list(zip(s[::2], s[1::2], strict=True)), set(windows_before[i])
                    for wm in machines:
                        for start, number in wm.find(words):
                            found.append((start, start + wm.m))
                            numbers.add(number)
                    flat: list[int] = []
                    for a, b in sorted(found):
                        if flat and a <= flat[-1]:
                            flat[-1] = max(flat[-1], b)
                        else:
                            flat += (a, b)
                    counts.append(len(words))
                    spans.append(flat)
                    found_windows.append(sorted(numbers))
                    hits.append(sum(flat[1::2]) - sum(flat[::2]))
                return counts, spans, found_windows, hits

            return apply

        last = k == blocks - 1
        out = with_columns(out, fields, make, [text, *(["hit_spans", "hit_windows"] if k else [])], [*keep, *([] if last else [text])])
        if not last:
            out = stored(out, "marked")
            table.destroy()
    return out


def scan(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, keep: list[str] | None = None, max_patterns: int = MAX_PATTERNS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``keep`` columns (all by default) plus n_words, hit_spans array<int> (start, end, start, end, ...; merged word
    intervals, end exclusive), hit_items array<string> (sorted) and n_hit.

    Null and empty texts have no words and no hits; very long ones are scanned whole; an empty benchmark hits nothing;
    benchmark rows without an id mark words but are not listed as items; repeated rows are scanned each by itself; no rows,
    no rows. A kept column with a result's name is replaced by the result.
    """
    results = ("n_words", "hit_spans", "hit_windows", "hit_items", "n_hit")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results]
    plain = {c: f"k{i}" for i, c in enumerate(keep)}
    patterns, items = windows(benchmark, item_col, item_text, window)
    d = docs.select(*(F.col(c).alias(k) for c, k in plain.items()), F.col(text_col).cast("string").alias("scanned"))
    m = stored(marked(d, patterns, text_col="scanned", keep=list(plain.values()), max_patterns=max_patterns, max_bytes=max_bytes).withColumn("row", F.monotonically_increasing_id()), "hits")
    named = m.where("n_hit > 0").select("row", F.explode("hit_windows").alias("number")).join(items, "number").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("hit_items"))
    return m.join(named, "row", "left").select(*(F.col(k).alias(c) for c, k in plain.items()), "n_words", "hit_spans", F.coalesce("hit_items", F.array().cast("array<string>")).alias("hit_items"), "n_hit")
