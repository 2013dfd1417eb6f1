"""Baselines and model selection against brute force."""

import random

from pyspark.sql import functions as F

from textlab.operators import models as mo


def test_pareto_front_matches_brute_force(spark):
    rnd = random.Random(5)
    pts = [(i, float(rnd.randint(1, 30)), rnd.randint(1, 30)) for i in range(300)]
    df = spark.createDataFrame(pts, "id int, price double, size int")
    got = sorted(r["id"] for r in mo.pareto_front(df, {"price": "min", "size": "max"}).collect())
    want = sorted(i for i, p, s in pts if not any(q <= p and t >= s and (q < p or t > s) for _, q, t in pts))
    assert got == want


def test_pareto_front_three_objectives(spark):
    rnd = random.Random(9)
    pts = [(i, rnd.randint(1, 12), rnd.randint(1, 12), rnd.randint(1, 12)) for i in range(400)]
    df = spark.createDataFrame(pts, "id int, loss int, f1 int, acc int").repartition(5)
    got = sorted(r["id"] for r in mo._pareto_front_blocked(df, {"loss": "min", "f1": "max", "acc": "max"}, block_rows=16).collect())
    dom = lambda q, p: q[1] <= p[1] and q[2] >= p[2] and q[3] >= p[3] and (q[1] < p[1] or q[2] > p[2] or q[3] > p[3])
    want = sorted(p[0] for p in pts if not any(dom(q, p) for q in pts))
    assert got == want


def _front(pts):
    import numpy as np
    m = np.array([p[1:] for p in pts], float)
    return sorted(p[0] for p, row in zip(pts, m) if not ((m <= row).all(axis=1) & (m < row).any(axis=1)).any())


def test_pareto_front_of_opposed_objectives_is_blocked(spark, monkeypatch):
    """All rows of a plane are on the front; groups stay small, and far fewer pairs of blocks meet than there are."""
    rnd = random.Random(1)
    pts = []
    for i in range(6000):
        a, b = sorted((rnd.random(), rnd.random()))
        pts.append((i, a, b - a, 1 - b + (rnd.random() * 0.2 if i % 10 == 0 else 0)))
    pts += [(6000 + i, 0.5, 0.5, float(i % 3)) for i in range(30)] + [(7000, float("nan"), 0.0, 0.0), (7001, 0.0, 0.0, 5.0)]
    df = spark.createDataFrame(pts, "id int, a double, b double, c double")
    got = sorted(r["id"] for r in mo._pareto_front_blocked(df, {"a": "min", "b": "min", "c": "min"}, block_rows=200).collect())
    finite = [(i, float("inf") if a != a else a, b, c) for i, a, b, c in pts]
    assert got == _front(finite) and len(got) > 5000
    monkeypatch.setattr(mo, "GRID_CELLS", 1)  # one cell: the blocks alone
    assert got == sorted(r["id"] for r in mo._pareto_front_blocked(df, {"a": "min", "b": "min", "c": "min"}, block_rows=900).collect())


def test_pareto_front_of_equal_and_empty_rows(spark):
    df = spark.createDataFrame([(i, 1.0, 2.0, 3.0) for i in range(50)] + [(99, 1.0, 2.0, 4.0), (100, None, 0.0, 0.0)], "id int, a double, b double, c double")
    goal = {"a": "min", "b": "max", "c": "min"}
    assert sorted(r["id"] for r in mo.pareto_front(df, goal).collect()) == list(range(50))
    assert mo.pareto_front(df.where("false"), goal).collect() == []


def test_early_stop_matches_loop(spark):
    rnd = random.Random(3)
    rows, t = [], 0
    for run in range(6):
        for step in range(40):
            t += rnd.randint(1, 4000)
            rows.append((run, step, t, round(rnd.random() + step * 0.003 * (run % 3), 3)))
    df = spark.createDataFrame(rows, "run int, step int, ts long, metric double").withColumn("ts", F.timestamp_seconds("ts"))
    got = {r["run"]: r["stop_pos"] for r in mo.early_stop(df, "run", ["ts", "step"], "metric", patience=3, threshold=0.01).collect()}
    for run in range(6):
        best, last, stop = None, 0, None
        for pos, (_, _, _, m) in enumerate([r for r in rows if r[0] == run], 1):
            if best is None or m - best > 0.01:
                last = pos
            best = m if best is None else max(best, m)
            if stop is None and pos - last >= 3:
                stop = pos
        assert got[run] == stop


def _stops(rows, patience, threshold, sign=1):
    """Plain loop over the rows of one run, in order."""
    best, last, stop = None, 0, None
    for pos, m in enumerate(rows, 1):
        m = None if m is None or m != m else sign * m
        if best is None or (m is not None and m - best > threshold):
            last = pos
        if m is not None:
            best = m if best is None else max(best, m)
        if stop is None and pos - last >= patience:
            stop = pos
    return stop, None if best is None else sign * best


def test_early_stop_of_one_long_run_is_spread(spark, monkeypatch):
    """All rows of a run in one hour; rising, falling, flat, empty and mixed runs; both modes."""
    rnd = random.Random(4)
    runs = {"long": [rnd.random() + i * 1e-4 for i in range(5000)], "up": [i * 0.5 for i in range(900)], "down": [-float(i) for i in range(50)],
            "flat": [1.0] * 40, "none": [None] * 9, "late": [None, None, float("nan"), 0.5, None, 0.505, 0.2, 0.7, 0.7, 0.7, 0.7], "one": [0.1], None: [0.3, 0.1, 0.1]}
    rows = [(r, i, v) for r, vs in runs.items() for i, v in enumerate(vs)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "run string, step int, metric double")
    kept = []
    monkeypatch.setattr(mo, "materialize", lambda d, name, f=mo.materialize: kept.append(f(d, name)) or kept[-1])
    for patience, mode in ((1, "max"), (3, "max"), (3, "min"), (60, "max")):
        sign = 1 if mode == "max" else -1
        got = {r["run"]: r for r in mo.early_stop(df, "run", ["step"], "metric", mode, patience, 0.01).collect()}
        assert got.keys() == runs.keys()
        for run, vs in runs.items():
            stop, best = _stops(vs, patience, 0.01, sign)
            assert (got[run]["stop_pos"], got[run]["best"], got[run]["n_rows"]) == (stop, best, len(vs))
            assert (got[run]["stop_at"]["step"] if stop else got[run]["stop_at"]) == (stop - 1 if stop else None)
    sizes = [r["count"] for r in kept[0].where("_run = 'long'").groupBy("_part").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 400


def test_best_trial_and_checkpoint(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.9), (3, 0, 0.9), (4, 1, 0.1)], "trial_id int, run int, metric double")
    assert mo.best_trial(df, "metric").first()["trial_id"] == 2
    assert sorted((r["run"], r["trial_id"]) for r in mo.best_trial(df, "metric", "min", by=["run"]).collect()) == [(0, 1), (1, 4)]
    bc = {r["run"]: r["best_step"] for r in mo.best_checkpoint(df, "run", "trial_id", "metric").collect()}
    assert bc == {0: 2, 1: 4}


def test_baselines(spark):
    train = spark.createDataFrame([(i, l) for i, l in enumerate([0, 1, 1, 2, 2, 2])], "id int, label int")
    ev = spark.createDataFrame([(i, i % 3) for i in range(300)], "id int, label int")
    assert {r["y_pred"] for r in mo.baseline(train, ev, "most_frequent").collect()} == {2}
    strat = [r["y_pred"] for r in mo.baseline(train, ev, "stratified").collect()]
    assert set(strat) <= {0, 1, 2} and 100 < strat.count(2) < 200
    assert set(r["y_pred"] for r in mo.baseline(train, ev, "uniform").collect()) == {0, 1, 2}


def test_draws_of_many_classes_equal_a_plain_draw(spark):
    import bisect
    import hashlib
    from collections import Counter
    rnd = random.Random(2)
    labels = [min(int(rnd.expovariate(0.02)), 700) for _ in range(5000)] + [900] * 4000  # one class with nearly half the rows
    train = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "id int, label int")
    ev = spark.createDataFrame([(i, 0) for i in range(2000)], "id int, label int")
    count = Counter(labels)
    names, sums, total = sorted(count), [], 0
    for x in names:
        total += count[x]
        sums.append(total)
    u = {i: int(hashlib.md5(f"{i}:101".encode()).hexdigest()[:13], 16) / 16**13 for i in range(2000)}
    got = {r["id"]: r["y_pred"] for r in mo.baseline(train, ev, "stratified").collect()}
    assert got == {i: names[bisect.bisect_right([s / total for s in sums], x)] for i, x in u.items()}
    got = {r["id"]: r["y_pred"] for r in mo.baseline(train, ev, "uniform").collect()}
    assert got == {i: names[int(x * len(names))] for i, x in u.items()}
    assert {r["y_pred"] for s in ("stratified", "uniform") for r in mo.baseline(train.where("false"), ev, s).collect()} == {None}


def test_encode_pads_to_longest(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a zz")], "id int, text string")
    vocab = mo.build_vocab(df, size=2)
    enc = {r["id"]: (r["input_ids"], r["attention_mask"]) for r in mo.encode(df, vocab, max_length=416).collect()}
    assert enc[1][1] == [1, 1, 1] and enc[2][1] == [1, 1, 0]
    assert len(enc[2][0]) == 3 and enc[2][0][-1] == 0 and enc[2][0][1] == 1  # unknown word -> <unk>
