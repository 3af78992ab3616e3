"""Fill-in-the-middle rewriting, packing in tiers and resampling against plain versions."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.llm import fill_middle, resample, tiers
from candela.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
TOKEN, ALNUM = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def test_index_is_exact():
    rnd = random.Random(3)
    for k in range(300):
        t = "".join(rnd.choice(["a", "bb", " ", "\n", "é", "漢" * rnd.randint(1, 400), " \x1c"]) for _ in range(rnd.randint(0, 40 if k else 9000)))
        want = [0, *(m.end() for m in TOKEN.finditer(t))]
        offsets = fill_middle.boundaries(t)
        index = fill_middle.fit(offsets)
        assert offsets.tolist() == want == fill_middle.located(index, list(range(len(want))))
        assert all(abs(int(r)) <= fill_middle.ERROR + 1 for r in index[3])
    assert len(fill_middle.fit(np.arange(100_000) * 7)[0]) == 1, "a straight line takes one segment"


def cut(doc_id, t):
    w, x = TOKEN.findall(t), sha(f"42:{doc_id}")
    h = [int(x[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(w), "plain", None, None, t
    return (len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_op11(spark, texts):
    for r in Q.op11_fill_middle(spark, SF).collect():
        *row, out = cut(r.doc_id, texts[r.doc_id])
        assert [r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256] == [*row, sha(out), sha(texts[r.doc_id])]


def test_marks_stay_plain_and_marks_alike_are_restored(spark):
    rows = [(k, t) for k in range(40) for t in ("a <P> b", "<P<S", "x <", "<<P ><M", " ", "é 漢 \n<S", None)]
    d = fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"), share=100)
    got = d.select("text", "form", fill_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert all(r.back == (r.text or "") and (r.form == "plain") == (r.text in ("a <P> b", None)) for r in got)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_index_as_columns_finds_every_boundary(spark, texts):
    for r in fill_middle.rank_index(spark.read.parquet(f"{SF}/documents.parquet"), keep=["doc_id", "text"]).limit(60).collect():
        columns = (np.array([s[i] for s in r.segments]) for i in range(3))
        offsets = [0, *(m.end() for m in TOKEN.finditer(r.text or ""))]
        assert fill_middle.located((*columns, np.frombuffer(r.residuals, np.int8)), list(range(r.n + 1))) == offsets


def test_op12(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(Q.vocabulary())
    rows = Q.op12_tiers(spark, SF).collect()
    of, sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        sequence[r.sequence_id].append(r)
    assert set(of) == set(texts)
    for doc_id, mine in of.items():
        ids, at = np.array([*lib.encode(texts[doc_id], add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(mine, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    steps, windows = defaultdict(set), Counter()
    for key, mine in sequence.items():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert {r.window for r in mine} == {at} and at & (at - 1) == 0 and at <= 2048 and len({r.step for r in mine}) == 1
        steps[mine[0].step].add((key, at))
        windows[at] += 1
    assert set(sequence) == set(range(len(sequence)))
    assert all(len({w for _, w in s}) == 1 for s in steps.values())
    for w in windows:
        sizes = [len(s) for s in steps.values() if next(iter(s))[1] == w]
        assert max(sizes) - min(sizes) <= 1 and max(sizes) <= 8 * 2048 // w


def test_tiers_with_ids_give_the_documents_back(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(Q.vocabulary())
    some = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    got = defaultdict(list)
    for r in sorted(tiers.pack_documents(some, Q.vocabulary(), tiers=(64, 128)).collect(), key=lambda r: (r.doc_id, r.start)):
        assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        got[r.doc_id] += r.ids
    assert all(ids == [*lib.encode(texts[k], add_special_tokens=False).ids, 1] for k, ids in got.items()) and len(got) == some.count()


def test_packed_sequences_with_ids_give_the_documents_back(spark, texts):
    from tokenizers import Tokenizer

    from candela.llm import packing

    lib = Tokenizer.from_file(Q.vocabulary())
    some = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    got, sequence = defaultdict(list), defaultdict(list)
    for r in sorted(packing.pack_documents(some, Q.vocabulary(), capacity=300, with_ids=True).collect(), key=lambda r: (r.doc_id, r.start)):
        assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        got[r.doc_id] += r.ids
        sequence[r.sequence_id].append((r.offset, r.length))
    assert all(ids == [*lib.encode(texts[k], add_special_tokens=False).ids, 1] for k, ids in got.items()) and len(got) == some.count()
    assert all(sum(n for _, n in v) <= 300 and sorted(v)[0][0] == 0 for v in sequence.values())


def test_one_repeated_row_is_ranked_over_many_tasks(spark):
    """Rows equal in id, text and length are split over the ranges, and still get gapless places."""
    from candela.llm import packing

    d = spark.createDataFrame([(1, "one two three")] * 3000, "doc_id long, text string")
    rows = packing.pack_documents(d, Q.vocabulary(), capacity=64).collect()
    assert len(rows) == 3000 and len({(r.sequence_id, r.offset) for r in rows}) == 3000
    out, part, *_ = packing.ranked(spark.createDataFrame([(4,)] * 3000, "length long"), "test")
    assert out.select(part).distinct().count() > 2


@pytest.mark.parametrize("histogram", [{}, {1: 1}, {2048: 5}, {1500: 1000}, {1: 5000}, {1025: 1000, 3: 10}, {7: 10**12, 2047: 10**11}])
def test_plans_fill_every_window(histogram):
    runs = tiers.plan(histogram)
    assert sum(n * size for _, _, n, _, size, _, _, _ in runs) == sum(x * n for x, n in histogram.items()) and len(runs) < 20_000
    ends = defaultdict(int)
    for _, _, n, _, size, window, first, offset in runs:
        ends[window] = max(ends[window], first + n)
    assert sum(w * n for w, n in ends.items()) == sum(x * n for x, n in histogram.items()), "no window has a gap"


def test_random_plans_are_partitions():
    for k in range(60):
        rnd = random.Random(k)
        histogram = {rnd.randint(1, 2048): rnd.randint(1, 30) for _ in range(rnd.randint(0, 40))}
        of, sequence = defaultdict(list), defaultdict(list)
        for x, rank, n, start, size, window, first, offset in tiers.plan(histogram):
            for i in range(n):
                of[x, rank + i].append((start, size))
                sequence[window, first + i].append((offset, size))
        assert set(of) == {(x, i) for x, n in histogram.items() for i in range(n)}
        for want, mine in [*((x, v) for (x, _), v in of.items()), *((w, v) for (w, _), v in sequence.items())]:
            at = 0
            for start, size in sorted(mine):
                assert start == at
                at += size
            assert at == want


def plain_scores(docs, bench):
    def grams(t):
        w = ALNUM.findall((t or "").translate(LOWER))
        return [zlib.crc32(x.encode()) % 10000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]

    s, t = Counter(x for _, d in docs for x in grams(d)), Counter(x for d in bench for x in grams(d))
    s_all, t_all = sum(s.values()) + 10000, sum(t.values()) + 10000
    rows = []
    for i, d in docs:
        g = grams(d)
        weight = sum(math.floor(1000 * math.log((t[x] + 1) * s_all / ((s[x] + 1) * t_all))) for x in g) // len(g) if g else 0
        h = int(sha(f"7:{'null' if i is None else i}")[:8], 16)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, rows), key=str)


def test_op13(spark, texts):
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(map(tuple, Q.op13_resample(spark, SF).collect()), key=str) == plain_scores(list(texts.items()), bench)


def test_resample_ties_nulls_and_repeats(spark):
    """Equal scores come from equal ids and texts: repeated rows are drawn one by one, null ids last."""
    text = " ".join("abcdefghijklmnopqrstuvwxyz")
    for ids in ([1] * 10, [None] * 9, [3, None, 3, None, 3, None, 5, 5], list(range(21))):
        docs = [(i, text) for i in ids]
        rows = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("a b",)], "text string"), keep=["doc_id"])
        got = sorted((tuple(r) for r in rows.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
        assert got == plain_scores(docs, ["a b"])


def test_bisection_meets_ties_and_extremes(spark):
    values = [5, 5, 5, -(1 << 62), 1 << 62, None, 7]
    d = spark.createDataFrame([(v,) for v in values], "v long")
    some = sorted(v for v in values if v is not None)
    assert [resample.least_with(d, F.col("v"), k) for k in range(1, 8)] == [*some, None]


@pytest.mark.parametrize("name", ["op11_fill_middle", "op13_resample"])
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = c.sql(Q.oracle_sql()[name])
    d = Q.queries()[name](spark, SF)
    assert sorted(map(str, rel.select(", ".join(d.columns)).fetchall())) == sorted(str(tuple(r)) for r in d.collect())
