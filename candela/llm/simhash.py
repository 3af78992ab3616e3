"""SimHash near duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``2 r`` bits apart have a common variant at most ``r`` bits from either. Every distinct
fingerprint therefore emits all its variants within ``r`` bits, variants are shuffled, and fingerprints that meet on a
variant are verified and linked. The variants are shuffled by their first ``depth`` bits: a fingerprint is sent once for
each way to flip up to ``r`` of those bits, and the flips of the remaining bits are made where it arrives, so all
variants meet, but a fraction of the rows moves. ``depth`` grows with the number of fingerprints, which keeps the variants
that meet in one place near a constant; a place that holds more is split further by the next bits.
All fingerprints on one variant are within ``2 r`` bits of each other, so each is linked to the smallest only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.llm.common import LOWER_BYTES, fresh, slices, small_batches, stored, with_columns

#: Fingerprints that one bucket should hold, and variants that one step in a bucket sorts at once.
BUCKET, STEP = 2048, 4_000_000


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of ``width``-word shingles, as a signed integer."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").translate(LOWER_BYTES).split() if text else []
    if not words:
        return 0
    if len(words) <= width:
        hashes = np.array([xxh64_intdigest(b" ".join(words), 42)], "<u8")
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
        ends = ends.tolist()
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :], strict=False)), "<u8", len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        some = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, text_col: str = "text", keep: list[str], name: str = "fp") -> DataFrame:
    """``keep`` columns and ``name`` long. Null and empty texts have fingerprint zero."""
    text = fresh(docs, "simhash_text")
    return with_columns(docs.withColumn(text, F.col(text_col).cast("string")), [T.StructField(name, T.LongType())], lambda: lambda texts: ([fingerprint(t) for t in texts],), [text], keep)


def flips(bits: int, most: int) -> list[np.ndarray]:
    """By number of flips: the masks of that many of the low ``bits`` bits."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(bits), n)], np.uint64) for n in range(most + 1)]


def meet(fps: np.ndarray, left: np.ndarray, bits: int) -> list[np.ndarray]:
    """Edges among fingerprints that share a variant of their low ``bits`` bits, each with its number of flips ``left``."""
    if len(fps) < 2:
        return []
    by = [fps[left >= n] for n in range(int(left.max()) + 1)]
    if sum(len(f) * math.comb(bits, n) for n, f in enumerate(by)) > STEP and bits > 1:
        one = np.uint64(1 << (bits - 1))
        is_one, can = (fps & one) != 0, left > 0
        out = []
        for side in (False, True):
            same, other = is_one == side, (is_one != side) & can
            out += meet(np.concatenate((fps[same], fps[other])), np.concatenate((left[same], left[other] - 1)), bits - 1)
        return out
    low = np.uint64((1 << bits) - 1)
    masks = flips(bits, len(by) - 1)
    variants = np.concatenate([((f & low)[:, None] ^ m[None, :]).ravel() for f, m in zip(by, masks, strict=True)])
    ordered = np.sort(variants)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return []
    owners = np.concatenate([np.repeat(f, len(m)) for f, m in zip(by, masks, strict=True)])
    where = np.minimum(np.searchsorted(twice, variants), len(twice) - 1)
    hit = twice[where] == variants
    group, owner = where[hit], owners[hit]
    order = np.lexsort((owner, group))
    group, owner = group[order], owner[order]
    first = np.concatenate(([True], group[1:] != group[:-1]))
    head = owner[np.flatnonzero(first)][np.cumsum(first) - 1]
    pairs = np.stack((head, owner), 1)[head != owner]
    return [np.unique(pairs, axis=0)] if len(pairs) else []


def edges(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b) of verified links among the fingerprints in column fp (distinct, stored): enough to connect all within ``radius`` bits."""
    half = radius // 2
    count = distinct.count()
    depth = min(24, max(2, math.ceil(math.log2(max(count, 1) / BUCKET + 1))))

    def emit(batches):
        masks = flips(depth, half)
        for b in batches:
            fps = np.asarray(b.column(0)).view(np.uint64)
            top = fps >> np.uint64(64 - depth)
            for n, m in enumerate(masks):
                bucket = (top[:, None] ^ m[None, :]).ravel().astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(bucket), half - n, np.int8)), pa.array(np.repeat(fps, len(m)).view(np.int64))], names=["bucket", "left", "fp"])

    def join(table):
        fps, left = table.column("fp").to_numpy().view(np.uint64), table.column("left").to_numpy()
        found = meet(fps, left, 64 - depth)
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.uint64)
        pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= radius]
        return pa.table({"a": pa.array(np.ascontiguousarray(pairs[:, 0]).view(np.int64)), "b": pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64))})

    sent = distinct.select("fp").mapInArrow(emit, "bucket int, left tinyint, fp long")
    return sent.groupBy("bucket").applyInArrow(join, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every end of (a, b): roots agree exactly within connected parts.

    Each round every vertex points to the neighbour, itself included, of the least hashed rank, and the links are drawn
    again between what their ends point to; fresh ranks a round make the links vanish in a logarithmic number of rounds.
    """
    links = stored(links, "links")
    steps, turn = [], 0
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("r"), F.col(c).alias("v"))  # noqa: B023, E731
        to = stored(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("v"), F.least(F.col("m"), rank("a"))["v"].alias("to")), "step")
        steps.append(to)
        x, y = to.select(F.col("v").alias("a"), F.col("to").alias("na")), to.select(F.col("v").alias("b"), F.col("to").alias("nb"))
        moved = links.join(x, "a").join(y, "b").where("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct()
        links, turn = stored(moved, "links"), turn + 1
    if not steps:
        return links.select(F.col("a").alias("v"), F.col("b").alias("root"))
    root = steps[0].withColumnRenamed("to", "root")
    for to in steps[1:]:
        root = root.join(to.select(F.col("v").alias("root"), "to"), "root", "left").select("v", F.coalesce("to", "root").alias("root"))
    return root


def rooted_prints(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, root, first): every distinct fingerprint, the root of its component and its least id; ``prints`` (doc_id, fp) must be stored."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    root = components(edges(distinct, radius))
    return stored(distinct.join(root.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the least id of the component) a row; repeated rows and copies share a fingerprint
    and so a component. Null ids never name a component that has another id; an empty table gives no rows."""
    prints = stored(fingerprints(docs.withColumn("doc_id", F.col(id_col)), text_col=text_col, keep=["doc_id"]), "prints")
    rooted = rooted_prints(prints, radius)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "component_id"), "fp")


def one_row_each(docs: DataFrame, prints: DataFrame, roots: DataFrame, key: str, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of each root: ``prints`` has (doc_id, owner, ``key``), ``roots`` (``key``, root)."""
    owner = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    k_id, k_owner = fresh(docs, "one_id"), fresh(docs, "one_owner")
    one = prints.join(roots, key).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "owner")).alias("k")).select(F.col("k.doc_id").alias(k_id), F.col("k.owner").alias(k_owner))
    left = docs.join(one, F.col(id_col).eqNullSafe(F.col(k_id)) & (owner == F.col(k_owner)), "left_semi")
    twice = prints.groupBy("doc_id", "owner").count().where("count > 1")
    return left if twice.isEmpty() else left.dropDuplicates([id_col, text_col])


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """``docs`` with one row of each component: the least id, null ids last, then the least text hash.

    Rows that repeat in id and text count once. All columns stay as they are.
    """
    owner = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    prints = stored(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), owner.alias("owner")), keep=["doc_id", "owner"]), "prints")
    return one_row_each(docs, prints, rooted_prints(prints, radius).select("fp", "root"), "fp", id_col, text_col)


#: The wide search for similar texts: bands of a long SimHash, bits a band, and its least certain bits that variants flip.
BANDS, BAND_BITS, DOUBTFUL = 13, 48, 8
#: Bands of the passes that link what is easily linked: a text tries one other in each place it meets any.
EARLY = ((0, 1, 2, 3, 4, 5), (6, 7, 8, 9, 10, 11, 12))
#: Standard deviations beyond its mean at which a distance of long SimHashes rules a similarity out.
BEYOND = 4.5
#: Pairs that one step makes at once.
PAIRS = 2_000_000
#: Shingles that one bucket of the search by rare shingles should hold, and bits of the most slots in which shingles are counted for it.
SHINGLES, SLOT_BITS = 1 << 15, 20
_WORDS = -(-BANDS * BAND_BITS // 64)
_KEYS = np.arange(1, _WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int) -> set[bytes]:
    """The distinct ``width``-word shingles of the lower-cased text; fewer words make one shingle."""
    words = text.encode("utf-8", "replace").translate(LOWER_BYTES).split() if text else []
    if len(words) <= width:
        return {b" ".join(words)} if words else set()
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    return {joined[a:b] for a, b in zip(starts, ends[width - 1 :].tolist(), strict=False)}


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(x, 42) for x in shingles(text, width)), np.uint64)


def long_bits(hashes: np.ndarray) -> np.ndarray:
    """A row of ``BANDS * BAND_BITS`` bits a shingle hash (the finaliser of splitmix64 on keyed hashes)."""
    z = hashes[:, None] + _KEYS[None, :]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return np.unpackbits(z.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, : BANDS * BAND_BITS]


def banded(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bands of each text's SimHash over distinct shingles, masks of the DOUBTFUL bits nearest to a tie, and the number of shingles."""
    each = [shingle_hashes(t, width) for t in texts]
    sizes = np.array([len(h) for h in each])
    hashes, doc = np.concatenate([np.zeros(0, np.uint64), *each]), np.repeat(np.arange(len(each)), sizes)
    ones = np.zeros((len(each), BANDS * BAND_BITS), np.int32)
    for at in range(0, len(hashes), 1 << 14):
        of = doc[at : at + (1 << 14)]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        ones[of[first]] += np.add.reduceat(long_bits(hashes[at : at + (1 << 14)]), first, axis=0, dtype=np.int32)
    lean = (2 * ones - sizes[:, None]).reshape(-1, BANDS, BAND_BITS)
    place = np.uint64(1) << np.arange(BAND_BITS, dtype=np.uint64)
    doubt = np.argsort(np.abs(lean), axis=2, kind="stable")[:, :, :DOUBTFUL]
    return ((lean > 0) * place).sum(axis=2, dtype=np.uint64), place[doubt].sum(axis=2, dtype=np.uint64), sizes


def bands(docs: DataFrame, width: int = 5) -> DataFrame:
    """(owner, size, fps, doubts) of ``docs`` (owner, text)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2 << 20):
                fps, doubts, sizes = banded(part.column("text").to_pylist(), width)
                bounds = pa.array(np.arange(0, fps.size + 1, BANDS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column("owner"), pa.array(sizes, pa.int64()), *(pa.ListArray.from_arrays(bounds, pa.array(x.ravel().view(np.int64))) for x in (fps, doubts))], names=["owner", "size", "fps", "doubts"])

    small_batches(docs.sparkSession)
    return docs.select("owner", "text").mapInArrow(run, "owner long, size long, fps array<long>, doubts array<long>")


def subsets(masks: np.ndarray):
    """(rows, all sub-masks of each row's mask), for rows with equally many bits at a time."""
    many = np.bitwise_count(masks)
    for k in np.unique(many).tolist():
        rows = np.flatnonzero(many == k)
        left, out = masks[rows], np.zeros((len(rows), 1 << k), np.uint64)
        for j in range(k):
            low = left & (~left + np.uint64(1))
            left = left ^ low
            out[:, 1 << j : 2 << j] = out[:, : 1 << j] ^ low[:, None]
        yield rows, out


def groups(fps: np.ndarray, doubts: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(variant, row) of all variants of the low ``bits`` bits that several rows share, sorted by variant; places with too many
    variants are halved first. Rows are numbers into the arrays."""

    def part(rows, left, bits, high):
        if len(rows) < 2:
            return
        if (1 << np.bitwise_count(left).astype(np.int64)).sum() > STEP and bits > 1:
            one = np.uint64(1 << (bits - 1))
            is_one, can = (fps[rows] & one) != 0, (left & one) != 0
            for side in (False, True):
                mine = (is_one == side) | can
                yield from part(rows[mine], left[mine] & ~one, bits - 1, high | one if side else high)
            return
        low = np.uint64((1 << bits) - 1)
        made = [((fps[rows[some]] & low)[:, None] ^ flips, np.repeat(rows[some], flips.shape[1])) for some, flips in subsets(left)]
        variants, row = np.concatenate([v.ravel() for v, _ in made]), np.concatenate([r for _, r in made])
        order = np.argsort(variants, kind="stable")
        variants, row = variants[order], row[order]
        same = variants[1:] == variants[:-1]
        hit = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        if hit.any():
            yield variants[hit] | high, row[hit]

    low = np.uint64((1 << bits) - 1)
    yield from part(np.arange(len(fps)), doubts & low, bits, np.uint64(0))


def one_each(variants: np.ndarray, row: np.ndarray, owners: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """(a, b): for each row the busiest of those that it shares a variant with, if their roots differ. The busiest meets most others, so
    near copies of one text meet in few of them."""
    start = np.flatnonzero(np.concatenate(([True], variants[1:] != variants[:-1])))
    size = np.diff(np.append(start, len(variants)))
    busy = np.bincount(row, weights=np.repeat(size, size), minlength=len(owners))
    group = np.repeat(np.arange(len(start)), size)
    order = np.lexsort((owners[row], -busy[row], group))
    head = np.repeat(row[order][start], size)
    pick = np.lexsort((owners[head], -busy[head], row[order]))
    mine, head = row[order][pick], head[pick]
    first = np.concatenate(([True], mine[1:] != mine[:-1]))
    mine, head = mine[first], head[first]
    some = roots[mine] != roots[head]
    return np.stack((np.minimum(owners[head], owners[mine]), np.maximum(owners[head], owners[mine])), 1)[some]


def spans(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of every j from ``begin[i]`` to before ``end[i]``, about PAIRS at a time."""
    many = end - begin
    sums, at = np.cumsum(many), 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PAIRS, "right")))
        some = many[at:to]
        i = np.repeat(np.arange(at, to), some)
        yield i, begin[i] + np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some)
        at = to


def all_pairs_apart(variants: np.ndarray, row: np.ndarray, owners: np.ndarray, roots: np.ndarray, doubts: np.ndarray, more: np.ndarray, most: float) -> Iterator[np.ndarray]:
    """(a, b) of all rows with unequal roots that share a variant and whose bits in ``more`` differ in ``most`` places at most. Of the
    variants that two rows share, only that with zeros in all bits which both doubt makes the pair, so a pair is made once."""
    order = np.lexsort((roots[row], variants))
    variants, row = variants[order], row[order]
    n = len(row)
    edge = np.concatenate((np.flatnonzero((variants[1:] != variants[:-1]) | (roots[row[1:]] != roots[row[:-1]])) + 1, [n]))
    last = np.concatenate((np.flatnonzero(variants[1:] != variants[:-1]) + 1, [n]))
    at = np.arange(n)
    for i, j in spans(edge[np.searchsorted(edge, at, "right")], last[np.searchsorted(last, at, "right")]):
        x, y = row[i], row[j]
        only = (variants[i] & doubts[x] & doubts[y]) == 0
        x, y = x[only], y[only]
        near = np.bitwise_count(more[x] ^ more[y]).sum(axis=1, dtype=np.int64) <= most
        x, y = owners[x[near]], owners[y[near]]
        yield np.stack((np.minimum(x, y), np.maximum(x, y)), 1)


def apart(variants: np.ndarray, row: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """The rows that share a variant (sorted) with a row of another root."""
    start = np.flatnonzero(np.concatenate(([True], variants[1:] != variants[:-1])))
    mixed = np.minimum.reduceat(roots[row], start) != np.maximum.reduceat(roots[row], start)
    return np.unique(row[np.repeat(mixed, np.diff(np.append(start, len(row))))])


def placed(prints: DataFrame, bands: Sequence[int], find: Callable, schema: str) -> DataFrame:
    """``find(groups, owners, roots)``, arrays by column of ``schema``, of every place where variants of one of the ``bands`` of ``prints``
    (owner, root, fps, doubts; distinct, stored) meet; ``groups`` are (variant, row) of those that several rows share."""
    depth = min(24, max(2, math.ceil(math.log2(max(prints.count(), 1) / BUCKET + 1))))
    low = np.uint64((1 << (BAND_BITS - depth)) - 1)

    def emit(batches):
        for b in batches:
            owner, root = b.column("owner").to_numpy(), b.column("root").to_numpy()
            fps, doubts = (b.column(c).flatten().to_numpy().view(np.uint64).reshape(-1, BANDS) for c in ("fps", "doubts"))
            for band in bands:
                fp, doubt = np.ascontiguousarray(fps[:, band]), np.ascontiguousarray(doubts[:, band])
                for rows, flips in subsets(doubt & ~low):
                    bucket = ((fp[rows][:, None] ^ flips) >> np.uint64(BAND_BITS - depth)) | np.uint64(band << depth)
                    again = np.repeat(rows, flips.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel().view(np.int64)), pa.array((fp[again] & low).view(np.int64)), pa.array(doubt[again].view(np.int64)), pa.array(owner[again]), pa.array(root[again])], names=["bucket", "fp", "doubt", "owner", "root"])

    def join(table):
        fps, doubts, owners, roots = (table.column(c).to_numpy() for c in ("fp", "doubt", "owner", "root"))
        made = find(groups(fps.view(np.uint64), doubts.view(np.uint64), BAND_BITS - depth), owners, roots)
        return pa.table({f.split()[0]: pa.array(np.ascontiguousarray(x)) for f, x in zip(schema.split(", "), made, strict=True)})

    sent = prints.select("owner", "root", "fps", "doubts").mapInArrow(emit, "bucket long, fp long, doubt long, owner long, root long")
    return sent.groupBy("bucket").applyInArrow(join, schema)


def candidates(prints: DataFrame, bands: Sequence[int]) -> DataFrame:
    """(a, b), a < b: for every owner of ``prints`` and place one other that it meets there, if their roots differ."""

    def find(met, owners, roots):
        return np.unique(np.concatenate([np.zeros((0, 2), np.int64), *(one_each(v, row, owners, roots) for v, row in met)]), axis=0).T

    return placed(prints, bands, find, "a long, b long")


def meeting(prints: DataFrame) -> DataFrame:
    """(owner, root) of all that share a variant of any band with an owner of another root: what may still be linked."""

    def find(met, owners, roots):
        rows = np.unique(np.concatenate([np.zeros(0, np.int64), *(apart(v, row, roots) for v, row in met)]))
        return owners[rows], roots[rows]

    return placed(prints, range(BANDS), find, "owner long, root long").distinct()


def often(texts: DataFrame, width: int, bits: int) -> np.ndarray:
    """How many shingles of ``texts`` fall into each of 2^``bits`` slots by the low bits of their hashes: at least as many as texts
    hold one of them. Tasks count their own texts; only the sums, of a fixed size, reach the driver."""
    size = min(1 << bits, 4096)

    def count(batches):
        seen = np.zeros(1 << bits, np.int32)
        for batch in batches:
            for part in slices(batch):
                hashes = np.concatenate([np.zeros(0, np.uint64), *(shingle_hashes(t, width) for t in part.column("text").to_pylist())])
                seen += np.bincount((hashes & np.uint64(len(seen) - 1)).astype(np.int64), minlength=len(seen)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(0, len(seen), size)), pa.array([x.tobytes() for x in seen.reshape(-1, size)])], names=["slot", "seen"])

    def add(table):
        total = np.zeros(size, np.int64)
        for x in table.column("seen"):
            total += np.frombuffer(x.as_buffer(), np.int32)
        return pa.table({"slot": table.column("slot").slice(0, 1), "seen": [total.tobytes()]})

    out = np.zeros(1 << bits, np.int64)
    for r in texts.select("text").mapInArrow(count, "slot long, seen binary").groupBy("slot").applyInArrow(add, "slot long, seen binary").collect():
        out[r.slot : r.slot + size] = np.frombuffer(r.seen, np.int64)
    return out


def rare_first(hashes: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The shingles in whose first places a similar text must share one, rarest first, and the most shingles that a text may have to which
    the place still counts. Of n and m shingles o = similarity / (1 + similarity) (n + m) must be shared, so texts that share
    none of their first n - o + 1 and m - o + 1, in an order that is the same for all, can't be similar. No shingles count as one that stands for none."""
    n = len(hashes)
    if not n:
        return np.zeros(1, np.uint64), np.zeros(1, np.int64)
    ordered = hashes[np.lexsort((hashes, counts[(hashes & np.uint64(len(counts) - 1)).astype(np.int64)]))]
    reach = np.floor((n - np.arange(n)) * (1 + similarity) / similarity - n + 1e-6).astype(np.int64)
    some = reach >= similarity * n - 1e-6
    return ordered[some], reach[some]


def rare_pairs(shingle: np.ndarray, size: np.ndarray, reach: np.ndarray, owners: np.ndarray, roots: np.ndarray, similarity: float) -> Iterator[np.ndarray]:
    """(a, b) of all rows with unequal roots and one ``shingle``, of which neither has more shingles (``size``) than the other's ``reach``.
    Rows that reach their own size meet each other; the rest can only meet shorter ones of these, which are found by size."""
    own = reach >= size
    first, rest = np.flatnonzero(own), np.flatnonzero(~own)
    group, none = np.unique(shingle, return_inverse=True)[1].astype(np.int64), np.zeros(len(owners), np.uint64)

    def fitting(x, y):
        fit = (roots[x] != roots[y]) & (size[x] <= reach[y]) & (size[y] <= reach[x])
        x, y = owners[x[fit]], owners[y[fit]]
        return np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), 1), axis=0)

    for pairs in all_pairs_apart(group[first].view(np.uint64), first, np.arange(len(owners)), roots, none, none[:, None], 0):
        yield fitting(pairs[:, 0], pairs[:, 1])
    wide = int(size.max(initial=0)) + 2
    shorter = first[np.lexsort((size[first], group[first]))]
    keys, base = group[shorter] * wide + size[shorter], group[rest] * wide
    begin = np.searchsorted(keys, base + np.ceil(similarity * size[rest] - 1e-6).astype(np.int64))
    for i, j in spans(begin, np.maximum(begin, np.searchsorted(keys, base + reach[rest], "right"))):
        yield fitting(rest[i], shorter[j])


def rare_candidates(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b), a < b: all owners of ``texts`` (owner, root, size, text; stored) with unequal roots that share one of their first, rarest shingles, once a bucket.
    No pair of that similarity is missed. Near copies share the shingles of their common text, which come last, so a large group
    of them meets in few pairs."""
    n, total = texts.agg(F.count("owner"), F.sum("size")).first()
    counts = often(texts, width, min(SLOT_BITS, max(12, math.ceil(math.log2(n + 1)) + 4)))
    buckets = max(32, math.ceil((1 - similarity) * (total or 0) / SHINGLES))

    def emit(batches):
        for batch in batches:
            for part in slices(batch):
                hashes = [shingle_hashes(t, width) for t in part.column("text").to_pylist()]
                each = [rare_first(h, counts, similarity) for h in hashes]
                if not each:
                    continue
                again = np.repeat(np.arange(len(each)), [len(x) for x, _ in each])
                shingle, reach = (np.concatenate(x) for x in zip(*each, strict=True))
                columns = [((shingle >> np.uint64(32)) % np.uint64(buckets)).view(np.int64), shingle.view(np.int64), np.array([len(h) for h in hashes])[again], reach, part.column("owner").to_numpy()[again], part.column("root").to_numpy()[again]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "shingle", "size", "reach", "owner", "root"])

    def join(table):
        found = rare_pairs(*(table.column(c).to_numpy() for c in ("shingle", "size", "reach", "owner", "root")), similarity)
        pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
        return pa.table({"a": pa.array(np.ascontiguousarray(pairs[:, 0])), "b": pa.array(np.ascontiguousarray(pairs[:, 1]))})

    sent = texts.select("owner", "root", "text").mapInArrow(emit, "bucket long, shingle long, size long, reach long, owner long, root long")
    return sent.groupBy("bucket").applyInArrow(join, "a long, b long")


def likely(pairs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` that collide in a band, whose numbers of shingles allow the similarity and whose long SimHashes don't rule it out: at the least
    cosine of such sets, bits differ with the probability angle / pi, and a distance BEYOND that many standard deviations over the mean is too far."""
    n = BANDS * BAND_BITS
    x = prints.select(F.col("owner").alias("a"), F.col("size").alias("size_a"), F.col("fps").alias("fps_a"), F.col("doubts").alias("doubts_a"))
    y = prints.select(F.col("owner").alias("b"), F.col("size").alias("size_b"), F.col("fps").alias("fps_b"), F.col("doubts").alias("doubts_b"))
    j = pairs.join(x, "a").join(y, "b").where((F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b")))
    certain = F.zip_with("doubts_a", "doubts_b", lambda p, q: F.bitwise_not(p.bitwiseOR(q)))
    collide = F.exists(F.zip_with(F.zip_with("fps_a", "fps_b", lambda p, q: p.bitwiseXOR(q)), certain, lambda p, q: p.bitwiseAND(q)), lambda v: v == 0)
    apart = F.aggregate(F.zip_with("fps_a", "fps_b", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    cosine = F.least(F.lit(1.0), similarity / (1 + similarity) * (F.col("size_a") + F.col("size_b")) / F.sqrt(F.nullif(F.col("size_a").cast("double") * F.col("size_b"), F.lit(0.0))))
    share = F.acos(cosine) / math.pi
    return j.where(collide).where((F.least("size_a", "size_b") == 0) | (apart <= n * share + BEYOND * F.sqrt(n * share * (1 - share)))).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose ``texts`` (owner, text) have a Jaccard similarity of shingle sets of at least ``similarity``."""

    def run(batches):
        last, mine = None, set()
        for batch in batches:
            for part in slices(batch):
                keep = []
                for a, x, y in zip(part.column("a").to_pylist(), part.column("text_a").to_pylist(), part.column("text_b").to_pylist(), strict=True):
                    if a != last:
                        last, mine = a, shingles(x, width)
                    other = shingles(y, width)
                    both = len(mine & other)
                    keep.append(both >= similarity * (len(mine) + len(other) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    j = pairs.join(texts.select(F.col("owner").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("owner").alias("a"), F.col("text").alias("text_a")), "a")
    return j.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def similar(docs: DataFrame, *, width: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """For ``docs`` (doc_id, owner, text): the owners of all rows, and (owner, root) with equal roots for linked texts.

    Copies are settled by their hash. Other texts meet by ball hashing of a banded SimHash: the fingerprint of every band
    emits all variants of its DOUBTFUL least certain bits, so two meet wherever each bit in which they differ is doubtful to
    one of them, and those that collide are verified by the exact similarity of their shingle sets.

    A large group of near copies collides in very many pairs. So what is easily linked is linked first, over a few bands and with one
    trial a text and place. Then all texts that collide in any band with one that they are not linked to are searched again, as a
    set, by their rarest shingles: every similar pair shares one, few others do. Those that collide are tried, but for those that their
    sizes or long SimHashes rule out. A pair left out is linked already or not similar, so the groups are those that trying all pairs
    that collide gives.
    """
    ids = stored(docs.select("doc_id", "owner"), "ids")
    first = docs.groupBy("owner").agg(F.min("text").alias("text"))
    prints = stored(bands(first, width), "bands")

    def links(pairs: DataFrame) -> DataFrame:
        pairs = stored(likely(pairs.distinct(), prints, similarity), "candidates")
        used = pairs.select(F.col("a").alias("owner")).union(pairs.select(F.col("b").alias("owner"))).distinct()
        texts = stored(docs.join(used, "owner", "left_semi").groupBy("owner").agg(F.min("text").alias("text")), "compared")
        return stored(verified(pairs, texts, width, similarity), "verified")

    def rooted(edges: DataFrame) -> DataFrame:
        return stored(prints.join(components(edges).withColumnRenamed("v", "owner"), "owner", "left").withColumn("root", F.coalesce("root", "owner")), "roots")

    now, edges = prints.withColumn("root", F.col("owner")), None
    for some in EARLY:
        found = links(candidates(now, some))
        edges = found if edges is None else edges.unionByName(found)
        now = rooted(edges)
    met = stored(meeting(now).join(prints.select("owner", "size"), "owner"), "met")
    texts = stored(docs.join(met, "owner").groupBy("owner").agg(*(F.min(c).alias(c) for c in ("root", "size", "text"))), "open")
    return ids, rooted(edges.unionByName(links(rare_candidates(texts, width, similarity)))).select("owner", "root")


def one_of_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of texts that are linked by a Jaccard similarity of ``width``-word shingles of at
    least ``similarity``: the least id, null ids last, then the least text hash.

    Null, empty and blank texts are one group; texts of fewer words are one shingle; very long texts are compared whole; rows
    that repeat in id and text count once; no rows, no rows. All columns stay as they are and may have any name.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("owner"), text.alias("text"))
    ids, roots = similar(plain, width=width, similarity=similarity)
    return one_row_each(docs, ids, roots, "owner", id_col, text_col)
