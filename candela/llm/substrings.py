"""Substring removal by seed and extend.

Seeds: of every run of ``width - seed + 1`` word ``seed``-grams the one with the least hash is an anchor (winnowing), so
any two equal windows of ``width`` words share an anchor at the same place. Anchors meet by hash; those of a single text
are dropped. Extend: around each remaining anchor the windows of ``width`` words that chose it are taken, to the left and
to the right (equal windows choose alike), and equal windows meet by a 128-bit hash whose halves come from independent word hashes. A window that starts in a document with a smaller id is covered;
covered windows that overlap make up the maximal repeats, whose words are removed.

Whole copies of a text need no extension: all but the copy with the least id are covered outright. Within a slice of
documents equal anchors or windows are settled on the spot, and those that one text repeats are one row with all their
places, so a passage that very many documents share, or that one repeats, brings one document's row a slice to the shuffle.
What remains of a key is aggregated before it is shuffled and joined back to its rows, whose side of the join can be split,
so no key, however common, is one task's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.llm.common import slices, small_batches, space_words, stored, with_columns

WIDTH, SEED = 13, 5
#: Parts of a group of copies, so that a text that very many documents share is no one task's.
SALTS = 8
_ODD = np.random.default_rng(7).integers(1, 2**63, (3, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # multipliers of the rolling hashes


def rolled(words: np.ndarray, width: int, which: int) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    n = len(words) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(width if n > 0 else 0):
        out += words[j : j + n] * _ODD[which, j]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def hashed(texts: pa.Array, *keys: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The word hashes of all texts, one after the other, by each key, and the bounds of each text; a distinct word is hashed
    once."""
    from xxhash import xxh64_intdigest

    lists = pc.ascii_split_whitespace(texts)
    bounds = np.asarray(lists.offsets).astype(np.int64)
    coded = lists.flatten().cast(pa.binary()).dictionary_encode()
    names, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices)
    word = np.array([len(x) > 0 for x in names], bool)[code]  # white space at an end leaves an empty string
    bounds = np.concatenate(([0], np.cumsum(word)))[bounds - bounds[0]]
    code = code[word]
    return [np.fromiter((xxh64_intdigest(x, k) for x in names), np.uint64, len(names))[code] for k in keys], bounds


def settled(keys: tuple[np.ndarray, ...], row: np.ndarray, place: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The distinct (keys, row): an index of each, is its key in several documents here, is this a document beyond the least
    of them, its row, and the list of its places. A key that a text repeats is thus one entry, however often."""
    order = np.lexsort((place, row, doc[row], *keys))
    new_key = np.ones(len(order), bool)
    new_key[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    new = new_key.copy()
    new[1:] |= row[order][1:] != row[order][:-1]
    at = np.flatnonzero(new)
    d, group = doc[row[order[at]]], np.cumsum(new_key[at]) - 1
    starts = np.flatnonzero(new_key[at])
    least, most = d[starts][group], np.maximum.reduceat(d, starts)[group] if len(d) else d
    places = pa.ListArray.from_arrays(pa.array(np.append(at, len(order)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
    return order[at], most > least, d > least, row[order[at]], places


def least_at(values: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` values: the place of its least, the first of equals."""
    n = max(0, len(values) - span + 1)
    best, at = values[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, span):
        less = values[j : j + n] < best
        best[less], at[less] = values[j : j + n][less], j
    return at + np.arange(n)


def anchors(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(key, owner, doc_id, pos, sure) of ``docs`` (doc_id, owner, text); sure: known here to be in several texts."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                ids, owners = part.column("doc_id").to_numpy(), part.column("owner").to_numpy()
                least = np.argsort(ids, kind="stable")
                some = np.sort(least[np.unique(owners[least], return_index=True)[1]])  # of copies in this slice only the least id can count
                (words,), bounds = hashed(part.column("text").take(pa.array(some)), 11)
                if len(words) < width:
                    continue
                of = np.repeat(np.arange(len(some)), np.diff(bounds))
                inside = of[: len(of) - width + 1] == of[width - 1 :]
                grams = rolled(words, seed, 0)
                at = np.unique(least_at(grams, width - seed + 1)[inside])
                row = some[of[at]]
                index, several, beyond, row, places = settled((grams[at],), row, at - bounds[of[at]], ids)
                key, doc = grams[at][index], ids[row]
                key = np.where(beyond, key ^ (doc.astype(np.uint64) * _ODD[2, 1]) ^ (index.astype(np.uint64) * _ODD[2, 2]), key)  # settled: any key will do
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(owners[row]), pa.array(doc), places, pa.array(several)], names=["key", "owner", "doc_id", "pos", "sure"])

    return docs.select("doc_id", "owner", "text").mapInArrow(run, "key long, owner long, doc_id long, pos array<int>, sure boolean")


def extended(found: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(h1, h2, doc_id, owner, start, sure): the windows whose own anchor, the least of their seeds, is among ``at`` of ``found``
    (doc_id, owner, text, at), by a 128-bit hash of two independent halves; sure: known here to start in a smaller document."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                ids, owners, at = part.column("doc_id").to_numpy(), part.column("owner").to_numpy(), part.column("at")
                halves, bounds = hashed(part.column("text"), 11, 12)
                row = np.repeat(np.arange(len(ids)), np.diff(np.asarray(at.offsets)))
                anchor = np.zeros(len(halves[0]), bool)
                anchor[np.asarray(at.flatten()) + bounds[row]] = True
                of = np.repeat(np.arange(len(ids)), np.diff(bounds))
                own = least_at(rolled(halves[0], seed, 0), width - seed + 1)
                start = np.flatnonzero(anchor[own] & (of[: len(own)] == of[width - 1 :]))
                h1, h2 = (rolled(h, width, k)[start] for k, h in enumerate(halves))
                row = np.searchsorted(bounds, start, "right") - 1
                index, _, beyond, row, places = settled((h1, h2), row, start - bounds[row], ids)
                doc = ids[row]
                h1, h2 = h1[index], h2[index]
                h2 = np.where(beyond, h2 ^ (doc.astype(np.uint64) * _ODD[2, 1]) ^ (index.astype(np.uint64) * _ODD[2, 2]), h2)
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(doc), pa.array(owners[row]), places, pa.array(beyond)], names=["h1", "h2", "doc_id", "owner", "start", "sure"])

    return found.select("doc_id", "owner", "text", "at").mapInArrow(run, "h1 long, h2 long, doc_id long, owner long, start array<int>, sure boolean")


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, owner, starts array<int>, whole boolean: the covered windows of every document that has any."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("owner"), text.alias("text"))
    ids = d.where("doc_id is not null")
    small_batches(docs.sparkSession)
    seen = ids.select("doc_id", "owner", F.unhex(F.sha2("text", 256)).alias("digest"))
    first = seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    first = first.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    salted = seen.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    copies = stored(salted.join(first, ["digest", "salt"]).where("doc_id > first").select("doc_id", "owner").distinct(), "copies")
    at = anchors(ids, width, seed)
    several = at.groupBy("key").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"), F.bool_or("sure").alias("known")).where("known or lo < hi")
    shared = at.join(several.select("key", F.lit(True).alias("met")), "key", "left").where("sure or met")
    places = shared.groupBy("doc_id", "owner").agg(F.flatten(F.collect_list("pos")).alias("at")).join(copies, ["doc_id", "owner"], "left_anti")
    found = ids.join(stored(places, "places"), ["doc_id", "owner"])
    around = extended(found, width, seed)
    earliest = around.where("not sure").groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"))
    covered = around.join(earliest, ["h1", "h2"], "left").where("sure or lo < doc_id")
    starts = stored(covered.groupBy("doc_id", "owner").agg(F.flatten(F.collect_list("start")).alias("starts")), "covered")
    return starts.select("doc_id", "owner", "starts", F.lit(False).alias("whole")).union(copies.select("doc_id", "owner", F.lit(None).cast("array<int>"), F.lit(True)))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) a row.

    Null and empty texts have no words; texts of fewer than ``width`` words lose none; rows with a null id lose none and
    cover none; of rows that share an id none covers another. Ids are integers, or strings of digits; very long texts are
    cut whole; no rows, no rows.
    """
    hit = repeats(docs, id_col=id_col, text_col=text_col, width=width, seed=seed)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("owner"), text.alias("text")).join(hit, ["doc_id", "owner"], "left")
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]

    def make():
        def apply(texts, starts, wholes):
            counts, removed, kept = [], [], []
            for t, s, whole in zip(texts, starts, wholes, strict=True):
                words = space_words(t)
                n = len(words)
                if whole and n >= width:
                    left = []
                elif s:
                    step = np.zeros(n + 1, np.int64)
                    at = np.unique(np.array(s))
                    step[at] += 1
                    np.subtract.at(step, at + width, 1)
                    gone = np.cumsum(step)[:n] > 0
                    left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    left = words
                counts.append(n)
                removed.append(n - len(left))
                kept.append(b" ".join(left).decode())
            return counts, removed, kept

        return apply

    return with_columns(d, fields, make, ["text", "starts", "whole"], ["doc_id"])
