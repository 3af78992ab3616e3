"""Selection, surrogate and conformal operators: literal cases and invariants."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.functions import sequence as S
from candela.operators import conformal
from candela.operators.selection import dpp, novelty, pareto, surrogate


def test_novelty(spark):
    d = spark.createDataFrame([("a", "ACDEFGHIKLMNPQRSTVWY"), ("b", "KKLLKKLLKKLL"), ("c", "GGGGSSSSNNNN")], "candidate_id string, sequence string")
    rows = novelty.select_batch(d, 2).orderBy("rank").collect()
    assert [r.selected for r in rows] == [True, True, False] and [r["rank"] for r in rows] == [1, 2, 3]
    assert novelty.select_batch(d, 9).where("selected").count() == 3
    with pytest.raises(ValueError):
        novelty.select_batch(d, 0)
    with pytest.raises(ValueError):
        novelty.select_batch(d.limit(0), 1)


def brute(x, s, q, tau, gamma):
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    w = np.exp((s - s.max()) / tau)
    l, chosen, logs = np.outer(w, w) * k, [], []
    for _ in range(q):
        best = max((i for i in range(len(s)) if i not in chosen), key=lambda i: (np.linalg.slogdet(l[np.ix_([*chosen, i], [*chosen, i])])[1], -i))
        chosen.append(best)
        logs.append(np.linalg.slogdet(l[np.ix_(chosen, chosen)])[1])
    return chosen, logs


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("active", [2, 9, 2048])
def test_dpp_equals_determinants(spark, seed, active, monkeypatch):
    """The picks are those of plain determinants, however few rows a pass brings."""
    monkeypatch.setattr(dpp, "ACTIVE", active)
    rng = np.random.default_rng(seed)
    x, s = rng.normal(size=(50, 5)), rng.integers(0, 100, 50).astype(float)
    d = spark.createDataFrame([(i, x[i].tolist(), float(s[i])) for i in range(50)], "i long, x array<double>, s double").repartition(3)
    trace, far = dpp.greedy_map(d, 6, order_col="i", vector_col="x", quality_col="s", temperature=20.0, gamma=0.2)
    want, logs = brute(x, s, 6, 20.0, 0.2)
    assert [t["key"] for t in trace] == want and np.allclose([t["log_det"] for t in trace], logs) and far > 0


@pytest.mark.parametrize("active", [2, 2048])
def test_dpp_diversity_and_edges(spark, active, monkeypatch):
    monkeypatch.setattr(dpp, "ACTIVE", active)
    a, b = "KWKLFKKIGAVLKVL", "GIGKFLHSAKKFGKAFVGEIMNS"
    rows = [("A1", a, 95.0), ("A2", a + "A", 94.8), ("A3", a + "G", 94.5), ("A4", a + "S", 94.2), ("B1", b, 88.0), ("B2", b + "A", 87.5), ("B3", b + "G", 87.0)]
    d = spark.createDataFrame(rows, "id string, sequence string, q double").withColumn("x", S.feature_vector(F.col("sequence")))
    keys = [t["key"] for t in dpp.greedy_map(d, 3, order_col="id", vector_col="x", quality_col="q", temperature=10.0, gamma=5.0)[0]]
    assert keys[0] == "A1" and any(k.startswith("B") for k in keys)
    assert len(dpp.greedy_map(d, 20, order_col="id", vector_col="x", quality_col="q")[0]) == 7 and dpp.greedy_map(d.limit(0), 3, order_col="id", vector_col="x", quality_col="q") == ([], 0.0)
    same = spark.createDataFrame([(i, [1.0], float(i)) for i in range(4)], "i long, x array<double>, s double")
    assert [t["key"] for t in dpp.greedy_map(same, 3, order_col="i", vector_col="x", quality_col="s")[0]] == [3, 2, 1]
    with pytest.raises(ValueError):
        dpp.greedy_map(d, 1, order_col="id", vector_col="x", quality_col="q", temperature=0)


def test_pareto(spark, monkeypatch):
    d = spark.createDataFrame([(1, 0.9, 0.9), (2, 0.95, 0.4), (3, 0.4, 0.95), (4, 0.5, 0.5)], "i int, a double, b double")
    assert {r.i: r.pareto_rank for r in pareto.fronts(d, "i", ["a", "b"]).collect()} == {1: 1, 2: 1, 3: 1, 4: 2}
    rng = np.random.default_rng(3)
    p = rng.integers(0, 12, (120, 3)).astype(float)
    e = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "i int, a double, b double, c double").repartition(4)
    left, rank, want = set(range(120)), 0, {}
    while left:
        rank += 1
        top = [i for i in left if not any((p[j] >= p[i]).all() and (p[j] > p[i]).any() for j in left)]
        want |= dict.fromkeys(top, rank)
        left -= set(top)
    monkeypatch.setattr(pareto, "BLOCK_ROWS", 7)
    assert {r.i: r.pareto_rank for r in pareto.fronts(e, "i", ["a", "b", "c"], cover=60).collect()} == {i: k for i, k in want.items() if k <= max(want[i] for i in want if sum(want[j] < want[i] for j in want) < 60)}
    assert pareto.fronts(d.limit(0), "i", ["a", "b"]).count() == 0


def test_surrogate(spark):
    d = spark.createDataFrame([(0, [0.82]), (1, [0.45])], "i int, x array<double>")
    hist, wait = spark.createDataFrame([([0.0], 10.0)], "x array<double>, y double"), spark.createDataFrame([([0.8],)], "x array<double>")
    got = {r.i: r.acquisition for r in surrogate.acquisition(d, hist, wait, seed=1, kind="UCB").collect()}
    assert set(got) == {0, 1}
    x, y = np.array([[0.0], [1.0], [2.0]]), np.array([1.0, 3.0, 2.0])
    f, w = surrogate.fit(x, y)
    mean, var = surrogate.predict(x, f, w, x)
    assert np.allclose(mean, y, atol=1e-3) and (var < 1e-3).all()
    draws = surrogate.fantasies(x, f, w, np.array([[0.5]]), 2000, 7)
    assert abs(draws.mean() - surrogate.predict(x, f, w, np.array([[0.5]]))[0][0]) < 0.08
    with pytest.raises(ValueError):
        surrogate.fit(np.zeros((0, 1)), np.zeros(0))


def test_acquisition_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist(), float(i % 7)) for i in range(60)]
    d = spark.createDataFrame(rows, "i int, x array<double>, y double")
    run = lambda n: sorted((r.i, round(r.acquisition, 9)) for r in surrogate.acquisition(d.where("i >= 20").select("i", "x").repartition(n), d.where("i < 10"), d.where("i between 10 and 19"), seed=5).collect())
    assert run(1) == run(5)


def test_conformal(spark, monkeypatch):
    rng = np.random.default_rng(42)
    y = rng.uniform(0, 1, 800)
    p = np.clip(y + rng.normal(0, 0.1, 800), 0, 1)
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p, strict=True))], "i int, y double, p double")
    m = conformal.calibrate(d.where("i < 400"), F.col("y"), F.col("p"))
    assert m == pytest.approx(np.quantile(np.abs(y - p)[:400], min(1.0, np.ceil(401 * 0.9) / 400)))
    c = conformal.intervals(F.col("p"), m)
    assert conformal.coverage(d.where("i >= 400"), F.col("y"), c["lower_bound"], c["upper_bound"]).first().coverage >= 0.85
    big = spark.range(20_000).select((F.col("id") * 7919 % 10007).cast("double").alias("v"))
    values = np.array([r.v for r in big.collect()])
    monkeypatch.setattr(conformal, "FEW_ROWS", 500)
    for level in (0.0, 0.1, 0.5, 0.9137, 1.0):
        assert conformal.quantile(big, F.col("v"), level) == pytest.approx(np.quantile(values, level))
    assert conformal.quantile(big.limit(0), F.col("v"), 0.5) is None


def test_summaries_and_feasibility(spark):
    from candela.operators import summaries

    d = spark.createDataFrame([("DBAASP; APD3",), ("APD3 ;",), (None,)], "s string")
    assert {(r.value, r.n) for r in summaries.distinct_parts(d, "s").collect()} == {("DBAASP", 1), ("APD3", 2)}
    r = spark.createDataFrame([(["SYN_LOW_YIELD", "NO_BINDING", "CYTOTOXICITY"],), (["SYN_SCALE_UP_FAILED"],)], "failure_modes array<string>")
    assert {(x.cause, x.n) for x in summaries.attribution(r).collect()} == {("synthesis", 2), ("binding", 1), ("other", 1)}
    rng = np.random.default_rng(1)
    h = spark.createDataFrame([([float(a)], int(a > 0)) for a in rng.normal(size=80)], "x array<double>, made int")
    m = summaries.feasibility_model(h)
    got = {r.x[0]: r.weighted_acquisition for r in summaries.with_feasibility(spark.createDataFrame([([2.0], 1.0), ([-2.0], 1.0)], "x array<double>, acquisition double"), m).collect()}
    assert got[2.0] > 0.9 and got[-2.0] < 0.1


@pytest.mark.parametrize("block", [7, 1000])
def test_swept_ranks(spark, monkeypatch, block):
    """Ranks of the sweep, one block and many, equal those by peeling."""
    monkeypatch.setattr(pareto, "BLOCK_ROWS", block)
    rnd = np.random.default_rng(5)
    pts = {i: (float(a), float(b), float(c)) for i, (a, b, c) in enumerate(rnd.integers(0, 6, (60, 3)))}
    d = spark.createDataFrame([(i, *p) for i, p in pts.items()], "i long, a double, b double, c double")
    got = {r.i: r.pareto_rank for r in pareto.fronts(d, "i", ["a", "b", "c"]).collect()}
    left, want, rank = set(pts), {}, 1
    over = lambda q, p: all(x >= y for x, y in zip(q, p, strict=True)) and q != p
    while left:
        top = {i for i in left if not any(over(pts[j], pts[i]) for j in left)}
        want |= {i: rank for i in top}
        left, rank = left - top, rank + 1
    assert got == want
    assert pareto.fronts(d.limit(0), "i", ["a", "b"]).count() == 0


def test_most_alike_pairs(spark):
    rnd = np.random.default_rng(6)
    sets = {i: sorted({f"k{x}" for x in rnd.integers(0, 40, rnd.integers(1, 25))}) for i in range(80)}
    sets[80], sets[81] = sets[3], []
    d = spark.createDataFrame(list(sets.items()), "i long, k array<string>")
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    pairs = [(-jac(sets[a], sets[b]), a, b) for a in sets for b in sets if a < b and set(sets[a]) & set(sets[b])]
    got = [(r.i, r.other_id, r.similarity) for r in novelty.most_alike(d, 15, id_col="i", kmers_col="k").collect()]
    assert got == [(a, b, pytest.approx(-s)) for s, a, b in sorted(pairs)[:15]]
    assert {(r.i, r.other_id) for r in novelty.alike(d, 0.3, id_col="i", kmers_col="k").collect()} == {(a, b) for s, a, b in pairs if -s >= 0.3 - 1e-9}


def test_most_alike_pairs_in_many_blocks(spark, monkeypatch):
    """Blocks of few rows: every two blocks meet, ties at the bound go by ids, and the k-mer sets' sequence is worked out once."""
    rnd = np.random.default_rng(7)
    sets = {i: sorted({f"k{x}" for x in rnd.integers(0, 12, rnd.integers(1, 6))}) for i in range(120)}
    d = spark.createDataFrame(list(sets.items()), "i long, k array<string>")
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    pairs = sorted((-jac(sets[a], sets[b]), a, b) for a in sets for b in sets if a < b and set(sets[a]) & set(sets[b]))
    monkeypatch.setattr(novelty, "BLOCK_LEAST", 15)
    for k in (3, 40, 400):
        got = [(r.i, r.other_id, r.similarity) for r in novelty.most_alike(d, k, id_col="i", kmers_col="k").collect()]
        assert got == [(a, b, -s) for s, a, b in pairs[:k]]
    few = novelty.most_alike(d.where("i < 3"), 400, id_col="i", kmers_col="k").collect()
    assert len(few) == sum(a < 3 and b < 3 for _, a, b in pairs)


def test_most_alike_meets_few_pairs_and_misses_none(spark):
    """Sets of 6 to 60 k-mers, some near copies: the search equals a plain loop at any bound, in a block and between two, and few of all pairs meet."""
    import pyarrow as pa

    rnd = np.random.default_rng(8)
    sets = [set(rnd.integers(0, 2000, n).tolist()) for n in rnd.integers(6, 61, 700)]
    for i in range(0, 120, 4):
        sets[i + 1] = {*sorted(sets[i])[i // 12 :], 2000}
    ids = rnd.permutation(700).tolist()

    def block(rows):
        k = pa.array([sorted(f"k{x}" for x in sets[r]) for r in rows])
        t, out = pa.table({"id": [ids[r] for r in rows], "k": pa.ListArray.from_arrays(k.offsets, k.values.dictionary_encode())}), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, t.schema) as w:
            w.write_table(t)
        return out.getvalue().to_pybytes()

    jac = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    every = sorted((-jac(a, b), min(ids[a], ids[b]), max(ids[a], ids[b]), (a < 350) == (b < 350)) for a in range(700) for b in range(a) if sets[a] & sets[b])
    whole, two = novelty._Sets([block(range(700))]), novelty._Sets([block(range(350)), block(range(350, 700))])
    for bound in (0.0, 0.1, 0.3, 0.5, 0.6, 0.75, 0.9, 1.0):
        for k in (5, 5000):
            assert [r[:3] for r in whole.search(k, bound)] == [p[:3] for p in every if -p[0] >= bound][:k]
            assert [r[:3] for r in two.search(k, bound)] == [p[:3] for p in every if -p[0] >= bound and not p[3]][:k]
    several = novelty._Sets([block(range(200)), block(range(200, 350)), block(range(350, 700))], [0, 0, 1])
    assert several.search(50, 0.3) == two.search(50, 0.3)
    assert len(every) > 50_000
    assert whole.search(5, 0.6, most=len(every) // 10) is not None and whole.search(5, 0.0, most=len(every) - 1) is None


def test_most_alike_copies_and_null_ids(spark, monkeypatch):
    """Of many equal sets only those of the first k + 1 ids are compared, an id of several rows counts as in a join, and a null id pairs with nothing."""
    rows = [(i, ["a", "b", "c"]) for i in range(2000)] + [(i, ["a", "b", "c", f"d{i % 7}"]) for i in range(1990, 2300)] + [(None, ["a", "b", "c"]), (5000, ["z"]), (5001, None), (5002, [])]
    d = spark.createDataFrame(rows, "i long, k array<string>")
    stored, real = {}, novelty.staged

    def staged(df, tag):
        out = real(df, tag)
        stored[tag] = out.count()
        return out

    monkeypatch.setattr(novelty, "staged", staged)
    got = [tuple(r) for r in novelty.most_alike(d, 3, id_col="i", kmers_col="k").collect()]
    assert got == [(0, 1, 1.0), (0, 2, 1.0), (0, 3, 1.0)] and stored["kmers"] == 8 * 4 + 1
    twice = spark.createDataFrame([(1, ["a", "b"]), (1, ["b", "a"]), (2, ["a", "b"]), (3, ["a", "c"]), (3, ["b"])], "i long, k array<string>")
    got = [tuple(r) for r in novelty.most_alike(twice, 9, id_col="i", kmers_col="k").collect()]
    assert got == [(1, 2, 1.0)] * 2 + [(1, 3, 0.5)] * 2 + [(2, 3, 0.5)] + [(1, 3, pytest.approx(1 / 3))] * 2 + [(2, 3, pytest.approx(1 / 3))]
    assert novelty.most_alike(twice.limit(0), 9, id_col="i", kmers_col="k").count() == 0


def test_most_alike_blocks_do_not_follow_the_partitions(spark, monkeypatch):
    """Where Spark makes more partitions than there are blocks, a block takes several of them, so no more pairs of blocks meet."""
    rnd = np.random.default_rng(9)
    sets = {i: sorted({f"k{x}" for x in rnd.integers(0, 60, rnd.integers(1, 20))}) for i in range(150)}
    d = spark.createDataFrame(list(sets.items()), "i long, k array<string>")
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    pairs = sorted((-jac(sets[a], sets[b]), a, b) for a in sets for b in sets if a < b)
    asked, meetings = [], []
    monkeypatch.setattr(novelty, "BLOCK_LEAST", 50)
    ranged, dealt = type(d).repartitionByRange, type(d).repartition
    monkeypatch.setattr(type(d), "repartitionByRange", lambda self, n, *c: asked.append(n) or ranged(self, 21, *c))
    monkeypatch.setattr(type(d), "repartition", lambda self, n, *c: meetings.append(n) or dealt(self, n, *c))
    got = [(r.i, r.other_id, -r.similarity) for r in novelty.most_alike(d, 20, id_col="i", kmers_col="k").collect()]
    assert got == [(a, b, s) for s, a, b in pairs[:20]] and asked == [3] and meetings[0] == 3 and max(meetings) <= 6


def test_acquisition_queries_against_brute_force(spark, tmp_path):
    """gp_acquisition over a small table: the posterior by plain linear algebra, one vector in ten measured."""
    from candela import queries as R

    rnd = np.random.default_rng(7)
    vec = rnd.normal(size=(45, 6)).astype("float32")
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vec)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    x, y = vec.astype(float) / 4, np.arange(45) * 37 % 101 / 100
    some = np.arange(0, 45, 10)
    k = lambda a, b: np.exp(-0.5 * ((a[:, None] - b[None]) ** 2).sum(-1))
    inv = np.linalg.inv(k(x[some], x[some]) + (1e-4 + 1e-6) * np.eye(len(some)))
    mean = k(x, x[some]) @ inv @ y[some]
    var = np.maximum(1e-10, 1 - np.einsum("ij,jk,ik->i", k(x, x[some]), inv, k(x, x[some])))
    for r in R.queries()["gp_acquisition"](spark, str(tmp_path)).collect():
        assert r.mean == pytest.approx(mean[r.vec_id], abs=2e-6) and r.variance == pytest.approx(var[r.vec_id], abs=2e-6) and r.acquisition == pytest.approx(mean[r.vec_id] + 2 * var[r.vec_id] ** 0.5, abs=4e-6)


def test_features_come_near_the_exact_posterior(spark):
    """Beyond max_rows random features take over: mean and deviation within 0.1 of the exact ones, on any partitioning, and nothing is refused."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    y = np.sin(x[:, 0]) + 0.5 * x[:, 1]
    d = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(400)], "i int, x array<double>, y double")
    seen, wait, rest = d.where("i < 300"), d.where("i between 300 and 309").select("x"), d.where("i >= 310").select("i", "x")
    run = lambda n, **k: {r.i: (r["mean"], r.variance**0.5, r.acquisition) for r in surrogate.acquisition(rest, seen.repartition(n), wait, seed=2, kind="UCB", **k).collect()}
    exact, near, again = run(1), run(3, max_rows=50, features=2048), run(7, max_rows=50, features=2048)
    # where measured rows are near; in the tails 1.96 deviations of either model hold the other's mean
    for i in exact:
        assert abs(exact[i][0] - near[i][0]) < 0.05 + 4 * (exact[i][1] + near[i][1]) and near[i] == pytest.approx(again[i], abs=1e-4)
    close = [i for i in exact if exact[i][1] < 0.02]
    assert len(close) > 50 and max(abs(exact[i][0] - near[i][0]) for i in close) < 0.1 and max(abs(exact[i][2] - near[i][2]) for i in close) < 0.2


def test_kernel_of_features():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    basis = surrogate.frequencies(3, 4096, 7)
    phi = surrogate.mapped(x, *basis)
    assert np.abs(phi @ phi.T - surrogate.kernel(x, x)).max() < 0.1


def test_default_qualities(spark):
    d = spark.createDataFrame([("a", [0.0], None, 70.0), ("b", [5.0], 90.0, 10.0), ("c", [9.0], None, None)], "id string, x array<double>, overall_score double, manufacturability_score double")
    assert [t["quality"] for t in dpp.greedy_map(d, 3, order_col="id", vector_col="x", gamma=1.0)[0]] == [90.0, 70.0, 50.0]
    got = {r.id: r.q for r in d.select("id", surrogate.outcome(d).alias("q")).collect()}
    assert got == {"a": 70.0, "b": 90.0, "c": 50.0}
    picks = surrogate.propose(d.select("id", "x"), d, batch_size=2, use_dpp=False, id_col="id", seed=1).collect()
    assert len(picks) == 2 and picks[0].id == "b"


@pytest.mark.parametrize(("cell", "high"), [(5, 12), (40, 12), (1000, 12), (9, 1000)])
def test_chains_over_a_grid(spark, monkeypatch, cell, high):
    """Ranks of two objectives over grids of any fineness equal those by peeling; repeated points and values share them."""
    monkeypatch.setattr(pareto, "CELL_ROWS", cell)
    pts = np.random.default_rng(cell + high).integers(-high // 2, high, (90, 2)).astype(float)
    got = {r.i: r.pareto_rank for r in pareto.fronts(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "i long, a double, b double"), "i", ["a", "b"]).collect()}
    left, want, rank = set(range(90)), {}, 1
    while left:
        top = {i for i in left if not any((pts[j] >= pts[i]).all() and (pts[j] > pts[i]).any() for j in left)}
        want |= dict.fromkeys(top, rank)
        left, rank = left - top, rank + 1
    assert got == want


@pytest.mark.parametrize(("together", "most"), [(False, 9), (True, 60)])
def test_diagonals_grow_with_the_root(spark, monkeypatch, together, most):
    """Of independent objectives 25 cells are nine diagonals, not 49; where they run together the grid is finer. Ranks stay."""
    monkeypatch.setattr(pareto, "CELL_ROWS", 100)
    tags, real = [], pareto.staged
    monkeypatch.setattr(pareto, "staged", lambda d, tag: (tags.append(tag), real(d, tag))[1])
    rnd = np.random.default_rng(4)
    a = rnd.permutation(2500).astype(float)
    b = a + rnd.random(2500) if together else rnd.permutation(2500).astype(float)
    got = pareto.fronts(spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i long, a double, b double"), "i", ["a", "b"]).collect()
    assert tags.count("diagonal") <= most
    best, want = [], {}
    for i in np.lexsort((-b, -a)).tolist():
        want[i] = 1 + max((r for y, r in best if y >= b[i]), default=0)
        best.append((b[i], want[i]))
    assert {r.i: r.pareto_rank for r in got} == want


def test_fronts_in_blocks(spark, monkeypatch):
    """A front of many points, all on one anti-diagonal, found a few points at a time; repeated points all stay."""
    monkeypatch.setattr(pareto, "BLOCK_ROWS", 7)
    pts = [(float(k), float(40 - k)) for k in range(40)] * 2 + [(float(k) - 0.5, float(39 - k)) for k in range(40)] + [(-0.0, 40.0)]
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "i long, a double, b double").repartition(3)
    assert {r.i for r in pareto.front(d, ["a", "b"]).collect()} == {*range(80), 120}
    assert pareto.front(d.limit(0), ["a", "b"]).count() == 0


def test_queries_over_orders_against_brute_force(spark):
    """Fronts and a diverse batch of all orders of the smallest tables, by plain loops."""
    from candela import queries as R
    from candela.queries import selection

    sf = "/root/testdata/sf0.001"
    rows = selection._orders(spark, sf).orderBy("o_orderkey").collect()
    pts = np.array([(r.price, r.day) for r in rows])
    order = sorted(range(len(rows)), key=lambda i: (-pts[i][0], -pts[i][1]))
    rank = np.zeros(len(rows), int)
    for k, i in enumerate(order):
        before = [j for j in order[:k] if pts[j][1] >= pts[i][1] and tuple(pts[j]) != tuple(pts[i])]
        rank[i] = 1 + max((rank[j] for j in before), default=0)
    assert {r.o_orderkey: r.pareto_rank for r in R.queries()["pareto_orders"](spark, sf).collect()} == {r.o_orderkey: rank[i] for i, r in enumerate(rows)}
    x, s = np.array([r.x for r in rows]), np.array([r.quality for r in rows])
    q, chosen, gains = np.exp((s - s.max()) / 50.0), [], []
    for _ in range(50):
        if chosen:
            w, k = q[chosen], np.exp(-((x[:, None] - x[chosen][None]) ** 2).sum(-1))
            inner = np.linalg.inv(np.outer(w, w) * np.exp(-((x[chosen][:, None] - x[chosen][None]) ** 2).sum(-1)))
            cross = q[:, None] * w[None] * k
            gain = q**2 - np.einsum("ij,jk,ik->i", cross, inner, cross)
        else:
            gain = q**2
        gain[chosen] = -np.inf
        chosen.append(int(gain.argmax()))
        gains.append(float(np.log(gain.max())))
    got = R.queries()["dpp_orders"](spark, sf).orderBy("step").collect()
    assert [r.o_orderkey for r in got] == [rows[i].o_orderkey for i in chosen] and got[-1].log_det == pytest.approx(sum(gains), abs=1e-2)


def test_a_pass_hands_on_few_rows_of_a_task(spark, monkeypatch):
    """With a small ACTIVE and many batches in a task the picks are those of one pass over all rows, ties and singular sets included."""
    rnd = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in rnd.integers(0, 3, 2)], float(rnd.integers(0, 5))) for i in range(600)]  # nine points: singular after nine picks
    d = spark.createDataFrame(rows, "i long, x array<double>, s double").coalesce(1)
    how = {"order_col": "i", "vector_col": "x", "quality_col": "s", "gamma": 1.0}
    want, _ = dpp.greedy_map(d, 14, **how)
    monkeypatch.setattr(dpp, "ACTIVE", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got, _ = dpp.greedy_map(d, 14, **how)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [t["key"] for t in got] == [t["key"] for t in want] and len(got) == 14


def test_a_proposal_scores_each_candidate_once(spark):
    """The passes of the diverse batch read stored acquisitions; candidates are neither read nor scored again for each of them."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(f"c{k}", [float(k % 7), float(k % 5)], k / 50) for k in range(60)]
    d = spark.createDataFrame(rows, "candidate_id string, x array<double>, y double")
    got = surrogate.propose(d.where("y >= 0.2").select("candidate_id", "x").mapInArrow(counted, "candidate_id string, x array<double>"), d.where("y < 0.2"), batch_size=3, seed=2).collect()
    assert len(got) == 3 and seen.value == 50
