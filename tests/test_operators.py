"""Edge cases and properties of the flow operators on hand-written rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.functions import expr as X
from flowsieve.operators import calibrate, evidence, features, federated, labels, metrics, profile, report, sampling, train

RAW = [("DDoS-ICMP_Flood", "dos_ddos"), ("Mirai-greeth_flood", "dos_ddos"), ("Mirai-udpplain", "mirai"), ("MITM-ArpSpoofing", "spoofing_mitm"), ("DNS_Spoofing", "spoofing_mitm"), ("VulnerabilityScan", "recon"), ("DictionaryBruteForce", "brute_force"), ("Uploading_Attack", "web_injection"), ("Backdoor_Malware", "malware"), (None, "other"), ("", "other")]


def test_attack_family(spark):
    df = spark.createDataFrame(RAW, "raw string, want string")
    assert df.where(X.attack_family(F.col("raw")) != F.col("want")).count() == 0


def test_to_double(spark):
    cases = [("1d", None), ("1.0f", None), (" 2 ", 2.0), ("inf", float("inf")), ("nan", None), ("", None), ("1,000", None), ("1e3", 1000.0), ("5.", 5.0)]
    got = [r[0] for r in spark.createDataFrame([(c,) for c, _ in cases], "x string").select(X.to_double(F.col("x"))).collect()]
    assert got == [w for _, w in cases]


def test_profile_drops_infinite_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0, "a", 1.0), (float("inf"), 5.0, "b", 2.0), (2.0, 5.0, "a", None)], "a double, b double, c string, d double")
    kinds = {r["column_name"]: r["kind"] for r in profile.select_by_profile(profile.profile(df, df.columns), numeric_ratio=0.6).collect()}
    assert kinds == {"a": "dropped", "b": "dropped", "c": "categorical", "d": "numeric"}


def test_gate_saturation(spark):
    hints = tuple(evidence.Hint(f"h{i}", "tcp" if i < 2 else "flow", "equal", ("x",), 1) for i in range(6))
    df = spark.createDataFrame([(1.0, 0.0, 1.0, 1.0, 1.0, 0.0)], ", ".join(f"_cti_h{i} double" for i in range(6)))
    row = evidence.add_gates(df, hints, {"tcp": 0.6, "flow": 0.6}).head()
    assert row["_cti_tcp_gate"] == pytest.approx(0.3) and row["_cti_flow_gate"] == pytest.approx(0.6)
    assert row["_cti_source_gate_mean"] == pytest.approx(0.45)


@pytest.mark.parametrize("n,want", [(1, 0), (2, 0), (3, 1), (142, 36), (20618, 5154)])
def test_split_sizes(spark, n, want):
    df = spark.range(n).select(F.col("id").alias("key"), F.lit("f").alias("family"))
    assert sampling.stratified_split(df, "family", "key").where("split = 'test'").count() == want


def test_quota_equals_window(spark):
    df = spark.range(3000).select(F.col("id").alias("key"), F.when(F.col("id") < 2500, "hot").when(F.col("id") < 2990, "warm").otherwise(None).alias("family"))
    for quota in (F.lit(0), F.lit(7), F.bround(F.col("n") * 0.25, 0), F.lit(10_000)):
        a = sampling.pick_quota(df, "family", "key", quota, 1, "s").where("picked").select("key")
        b = sampling.pick_quota_by_window(df, "family", "key", quota, 1, "s").where("picked").select("key")
        assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in b.collect())


def test_netflow_golden_counts(spark):
    counts = {"injection": 460812, "benign": 198450, "ddos": 197680, "password": 144792, "xss": 99913, "scanning": 20618, "backdoor": 17243, "dos": 17056, "mitm": 1288, "ransomware": 142}
    df = spark.createDataFrame([(k, min(v, 100_000)) for k, v in counts.items()], "family string, n long")
    total, test = df.agg(F.sum("n"), F.sum(sampling.test_quota(0.25))).head()
    assert (total, test) == (556260, 139065)


def test_permutation_keeps_sums(spark):
    df = spark.range(400).select(F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"), (F.col("id") % 5 == 0).cast("double").alias("h"))
    out = evidence.permute_binary(df, ["h"], "split", "key")
    sums = lambda d: sorted(map(tuple, d.groupBy("split").agg(F.sum("h")).collect()))
    assert sums(df) == sums(out) and out.join(df.withColumnRenamed("h", "g"), "key").where("h <> g").count() > 0


def test_empty_columns_and_tables(spark):
    empty = spark.createDataFrame([], "key long, family string")
    assert sampling.family_cap(empty, "family", "key", 3).count() == 0
    assert sampling.distributed_row_number(empty, [F.col("key")], [F.col("key") % 3]).count() == 0
    assert labels.label_dimension(empty, "family").count() == 0


def test_client_parts(spark):
    df = spark.range(11).select(F.col("id").alias("key"))
    assert sorted(r["count"] for r in sampling.iid_clients(df, "key", 4).groupBy("client_id").count().collect()) == [2, 3, 3, 3]


def test_unseen_label_raises(spark):
    train_rows, test_rows = spark.createDataFrame([("a",)], "f string"), spark.createDataFrame([("b",)], "f string")
    with pytest.raises(ValueError):
        labels.encode(test_rows, labels.label_dimension(train_rows, "f"), "f")
    assert [r[0] for r in labels.unseen_labels(train_rows, test_rows, "f").collect()] == ["b"]


def test_bins_ties_and_absent_class(spark):
    df = spark.createDataFrame([(1.0, [0.5, 0.5]), (0.2, [0.2, 0.8])], "c double, p array<double>")
    assert [tuple(r) for r in df.select(X.ece_bin(F.col("c")), X.argmax(F.col("p"))).collect()] == [(14, 0), (3, 1)]
    dim = spark.range(3).select(F.col("id").cast("int").alias("label_id"))
    cells = metrics.confusion(spark.createDataFrame([(0, 0), (1, 1)], "y int, pred int"))
    s = metrics.summary_scores(metrics.family_scores(metrics.class_counts(cells, dim))).head()
    assert s["accuracy"] == 1 and s["macro_f1"] == pytest.approx(2 / 3)
    assert metrics.normal_fpr(spark.createDataFrame([(1, 0)], "y int, pred int"), [0]).head()[0] is None


def test_temperature_keeps_predictions_and_falls_back(spark):
    rows = [(i, i % 3, [float(i % 3 == k) * 3 - (i % 7) / 9 for k in range(3)], float(i >= 90)) for i in range(100)]
    df = spark.createDataFrame(rows, "key long, y int, logits array<double>, gate double")
    assert metrics.score_logits(df, temperature=4.0).join(metrics.score_logits(df).select("key", F.col("pred").alias("p")), "key").where("pred <> p").count() == 0
    whole = calibrate.best_temperature(calibrate.temperature_losses(df)).head()["temperature"]
    got, thresholds = calibrate.binned_temperatures(df, "gate", 3)
    assert thresholds == [0.0] and {r["gate_bin"]: r["temperature"] for r in got.collect()}[1] == whole


def test_aggregators(spark):
    same = spark.createDataFrame([(c, k, float(k), 3) for c in range(5) for k in range(2)], federated.UPDATE)
    for how in ("avg", "median", "trimmed_mean", "krum"):
        assert sorted(map(tuple, federated.aggregate(same, how, faulty=1).collect())) == [(0, 0.0), (1, 1.0)]
    five = spark.createDataFrame([(c, 0, v, 1) for c, v in enumerate([0.0, 1.0, 2.0, 3.0, 100.0])], federated.UPDATE)
    assert federated.trimmed_mean(five, 0.2).head()["value"] == 2.0
    assert federated.trimmed_mean(five.where("client < 4"), 0.2).head()["value"] == 1.5
    assert federated.krum(five, 1).head()["value"] == 1.0
    assert federated.communication_mb(56, 15, 10) == pytest.approx(0.0652313232421875)


def descended(x, y, classes, smoothing, penalty, weights, decay=1e-4, steps=20_000):
    """(weights, loss) at the optimum, by plain gradient steps."""
    xs, w = np.column_stack([x, np.ones(len(x))]), np.zeros((x.shape[1] + 1, classes))
    for _ in range(steps):
        loss, g = train.loss_rows((xs @ w)[:, None], y, weights[y], smoothing, penalty)
        g = xs.T @ g[:, 0] / len(y)
        g[:-1] += decay * w[:-1]
        w = w - 0.5 * g
    return w, loss.sum() / len(y) + decay / 2 * (w[:-1] ** 2).sum()


@pytest.mark.parametrize(("smoothing", "penalty"), [(0.0, 0.0), (0.05, 0.01), (0.2, 0.1)])
def test_softmax_reaches_the_optimum(spark, smoothing, penalty):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = (x @ rng.normal(size=(3, 3)) + rng.normal(size=(300, 3))).argmax(axis=1)
    weights = np.array([1.0, 2.0, 0.5])
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(300)], "key long, features array<double>, y int").repartition(3)
    w, losses = train.fit_softmax(df, 3, 3, weights=dict(enumerate(weights)), smoothing=smoothing, penalty=penalty)
    best, loss = descended(x, y, 3, smoothing, penalty, weights)
    assert all(b <= a for a, b in zip(losses, losses[1:])) and losses[-1] < losses[0]
    assert abs(losses[-1] - loss) < 1e-4 and np.allclose(w - w.mean(axis=1, keepdims=True), best - best.mean(axis=1, keepdims=True), atol=0.05)
    # the gradient is that of the loss
    z, h = rng.normal(size=(5, 1, 3)), 1e-6
    _, g = train.loss_rows(z, y[:5], weights[y[:5]], smoothing, penalty)
    for k in range(3):
        up, down = (train.loss_rows(z + d * np.eye(3)[k], y[:5], weights[y[:5]], smoothing, penalty)[0] for d in (h, -h))
        assert np.allclose((up - down) / (2 * h), g[:, :, k], atol=1e-5)


def test_stack_equals_single_models_in_as_many_scans(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 4))
    y = (x @ rng.normal(size=(4, 3))).argmax(axis=1)
    rows = spark.createDataFrame([(x[i].tolist(), int(y[i]), int(1 + (i % 3 > 0) * 2)) for i in range(240)], "features array<double>, y int, member long")
    scans = []
    summed = train.summed
    monkeypatch.setattr(train, "summed", lambda *a: (scans.append(1), summed(*a))[1])
    models = train.Models.of(4, [0.0, 0.5, 1.0], np.array([False, False, True, True]), 0.05, 0.01, 2)
    w, seen = train.fit_stack(rows, models, 3, iterations=40)
    assert len(w) == 6 and len(scans) == len(seen) <= 41
    for m in range(6):
        own = rows.where(f"(member & {1 << int(models.bit[m])}) <> 0").select("features", "y")
        alone = own.select(F.zip_with("features", F.array(*[F.lit(float(v)) for v in models.scales[m]]), lambda a, b: a * b).alias("features"), "y")
        one, losses = train.fit_softmax(alone, 3, 4, 40, smoothing=0.05, penalty=0.01)
        assert abs(losses[-1] - seen[-1][m]) < 1e-4


def test_multinomial_reaches_the_optimum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (x @ rng.normal(size=(3, 3)) + rng.normal(size=(400, 3))).argmax(axis=1)
    df = spark.createDataFrame([(x[i].tolist(), int(y[i])) for i in range(400)], "features array<double>, y int")
    model = train.fit_multinomial(df)
    counts = np.bincount(y, minlength=3)
    weights = counts.sum() / counts
    weights = weights / weights.mean()
    w, loss = descended(x, y, 3, 0.0, 0.0, weights)
    own = np.vstack([model.coefficientMatrix.toArray().T, model.interceptVector.toArray()])
    xs = np.column_stack([x, np.ones(400)])
    mine = train.loss_rows((xs @ own)[:, None], y, weights[y], 0.0, 0.0)[0].sum() / 400 + 0.5e-4 * (own[:-1] ** 2).sum()
    assert abs(mine - loss) < 1e-4


def test_reports(spark):
    df = spark.createDataFrame([("d", "traffic_only", 1, 0.5), ("d", "source_gate", 1, 0.75), ("d", "source_gate", 2, 0.8)], "dataset string, scenario string, seed int, f1 double")
    assert [r["delta_f1_vs_traffic_only"] for r in report.baseline_deltas(df, ["dataset", "seed"], "traffic_only", ["f1"]).collect()] == [0.25]
    assert {r["scenario"]: r["f1_std"] for r in report.seed_summary(df, ["scenario"], ["f1"]).collect()}["traffic_only"] is None
    with pytest.raises(ValueError):
        report.require_rows(df, "none", "scenario")


def test_feature_spec(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, None), (None, "a"), (5.0, "b")], "`x.1` double, c string")
    spec = features.fit_spec(df, numeric_ratio=0.7)
    assert features.feature_names(spec) == ["x.1", "c=a", "c=b", "c=nan"]
    assert features.transform(df, spec).head()["features"][1:] == [1.0, 0.0, 0.0]


def in_batches(keys, rows, salt, seed=42):
    """Keys in hash order, cut into runs."""
    import hashlib

    order = sorted(keys, key=lambda k: (hashlib.md5(f"{seed}|{salt}|{k}".encode()).hexdigest(), k))
    return [order[i : i + rows] for i in range(0, len(order), rows)] if rows else [order]


def step_of(w, x, y, classes):
    p = train.softmax_rows(x @ w)
    p[np.arange(len(y)), y] -= 1
    return x.T @ p / len(y)


@pytest.mark.parametrize("batch_rows", [None, 64])
def test_clients_train_in_mini_batches(spark, capsys, batch_rows):
    """As a loop over each client's batches, with a client that has most of the rows; no client meets in one task."""
    rng = np.random.default_rng(5)
    data = [(i, 0 if i % 10 else 1 + i % 30 // 10, [float(v) for v in rng.normal(size=3)], int(rng.integers(0, 2))) for i in range(600)]
    df = spark.createDataFrame(data, "key long, client_id int, features array<double>, y int").repartition(5)
    start = rng.normal(size=(4, 2))
    got = federated.train_clients(df, start, 2, epochs=2, mu=0.1, batch_rows=batch_rows)
    assert got.columns == ["client", "coord", "value", "n"]
    found = {(r["client"], r["coord"]): (r["value"], r["n"]) for r in got.collect()}
    for c in {r[1] for r in data}:
        own = {r[0]: r for r in data if r[1] == c}
        w = start
        for epoch in range(2):
            for batch in in_batches(list(own), batch_rows, f"batch{epoch}"):
                x, y = np.array([[*own[k][2], 1.0] for k in batch]), np.array([own[k][3] for k in batch])
                w = w - 0.05 * (step_of(w, x, y, 2) + 0.1 * (w - start))
        for i, v in enumerate(w.ravel()):
            assert found[c, i] == (pytest.approx(v), len(own))
    federated.client_gradients(df.select(F.col("client_id").alias("client"), F.col("features").alias("x"), F.col("y").cast("long").alias("y"), F.array(*[F.lit(0.0)] * 8).alias("w")), (4, 2), 2).explain()
    assert "FlatMapGroups" not in capsys.readouterr().out
    assert federated.train_clients(df.limit(0), start, 2).count() == 0


def test_scenarios_by_loops(spark):
    """Stacked runs and seeds against a loop per run, with every aggregator and attack, mini-batches and unequal rounds."""
    rng = np.random.default_rng(8)
    data = [(i, int(rng.integers(0, 5)), rng.normal(size=3).tolist(), int(rng.integers(0, 3))) for i in range(300)]
    df = spark.createDataFrame(data, "key long, client_id int, features array<double>, y int").repartition(3)
    held = spark.createDataFrame([(rng.normal(size=3).tolist(), int(rng.integers(0, 3))) for _ in range(80)], "features array<double>, y int")
    runs = (federated.Run("a", rounds=2), federated.Run("b", mu=0.5, rounds=3), *(federated.Run(f"{h}-{x}", h, x, 0.0, 0.4, 2) for h in ("avg", "median", "trimmed_mean", "krum") for x in ("label_flip", "update_scale")))
    weights, rows = federated.federated_rounds(df, held, 3, 3, 5, runs, (42, 7), lr=0.3, epochs=2, batch_rows=20)
    assert weights.shape == (10, 2, 4, 3) and len(rows) == sum(r.rounds for r in runs) * 2
    test = [(np.array([*r["features"], 1.0]), r["y"]) for r in held.collect()]
    tx, ty = np.array([x for x, _ in test]), np.array([y for _, y in test])
    for k, run in enumerate(runs):
        for s, seed in enumerate((42, 7)):
            w = np.vstack([np.random.default_rng(seed).normal(0.0, 0.01, (3, 3)), np.zeros((1, 3))])
            for t in range(run.rounds):
                sent, sizes = [], []
                for c in range(5):
                    own, v = {r[0]: r for r in data if r[1] == c}, w
                    for _ in range(2):
                        for batch in in_batches(list(own), 20, "batch", seed):
                            x, y = np.array([[*own[i][2], 1.0] for i in batch]), np.array([own[i][3] for i in batch])
                            y = (y + 1) % 3 if run.attack == "label_flip" and c < 2 else y
                            v = v - 0.3 * (step_of(v, x, y, 3) + run.mu * (v - w))
                    sent.append(w + 5.0 * (v - w) if run.attack == "update_scale" and c < 2 else v)
                    sizes.append(len(own))
                table = spark.createDataFrame([(c, i, float(x), sizes[c]) for c in range(5) for i, x in enumerate(sent[c].ravel())], federated.UPDATE)
                if t == run.rounds - 1 and s == 0:  # the aggregators of the update table
                    by_table = {r["coord"]: r["value"] for r in federated.aggregate(table, run.aggregator, 0.2, 0 if run.attack == "none" else 2).collect()}
                w = federated.merged(np.array([x.ravel() for x in sent]), np.array(sizes, float), run.aggregator, 0.2, 0 if run.attack == "none" else 2).reshape(4, 3)
                got = next(r for r in rows if (r["scenario"], r["seed"], r["round"]) == (run.name, seed, t + 1))
                p = train.softmax_rows(tx @ w)
                assert got["accuracy"] == pytest.approx((p.argmax(axis=1) == ty).mean()) and got["brier"] == pytest.approx(((p - np.eye(3)[ty]) ** 2).sum(axis=1).mean())
                assert got["normal_fpr"] == pytest.approx((p.argmax(axis=1)[ty == 0] != 0).mean()) and got["mean_confidence"] == pytest.approx(p.max(axis=1).mean())
            assert np.allclose(weights[k, s], w)
            if s == 0:
                assert np.allclose([by_table[i] for i in range(12)], w.ravel())
    with pytest.raises(ValueError):
        federated.federated_rounds(df, held, 3, 3, 10_000_000, runs)


def test_scenarios_scan_distinct_rows(spark, monkeypatch):
    """Rows that are equal but for the key are one row of every scan, whatever their number, with the same weights and
    figures; their batches are those of `batched`, and one client with most rows changes nothing."""
    rng = np.random.default_rng(12)
    few = [(rng.integers(0, 2, 3).astype(float).tolist(), int(rng.integers(0, 3))) for _ in range(6)]
    data = [(i, 0 if i % 10 < 7 else i % 3, *few[i % 6]) for i in range(3000)]
    df = spark.createDataFrame(data, "key long, client_id int, features array<double>, y int").repartition(3)
    rows = df.where("client_id IS NOT NULL")
    want = {r["key"]: r["batch"] for r in federated.batched(rows, "client_id", "key", 700, 7).collect()}
    got = federated.with_batches(rows, "client_id", "key", 700, (42, 7))
    assert {r["key"]: r["batches"][1] for r in got.collect()} == want and max(want.values()) == 3
    scanned, sums = [], federated.summed
    monkeypatch.setattr(federated, "summed", lambda rows, *rest: (scanned.append(rows.count()), sums(rows, *rest))[1])
    runs = (federated.Run("a", rounds=2), federated.Run("b", "median", "label_flip", 0.1, 0.4, 2))
    weights, figures = federated.federated_rounds(df, df.where("key < 300"), 3, 3, 3, runs, (42, 7), batch_rows=700)
    assert max(scanned) <= len({(c, tuple(x), y) for _, c, x, y in data}) * 4 * 4 + 6  # batches of both seeds, and test rows
    for s, seed in enumerate((42, 7)):
        w = np.vstack([np.random.default_rng(seed).normal(0.0, 0.01, (3, 3)), np.zeros((1, 3))])
        for _ in range(2):
            sent, sizes = [], []
            for c in range(3):
                own, v = {r[0]: r for r in data if r[1] == c}, w
                for batch in in_batches(list(own), 700, "batch", seed):
                    v = v - 0.05 * step_of(v, np.array([[*own[i][2], 1.0] for i in batch]), np.array([own[i][3] for i in batch]), 3)
                sent.append(v)
                sizes.append(len(own))
            w = np.average(sent, axis=0, weights=sizes)
        assert np.allclose(weights[0, s], w)
        p, ty = train.softmax_rows(np.array([[*x, 1.0] for k, _, x, _ in data if k < 300]) @ w), np.array([y for k, *_, y in data if k < 300])
        last = next(r for r in figures if (r["scenario"], r["seed"], r["round"]) == ("a", seed, 2))
        assert last["accuracy"] == pytest.approx((p.argmax(axis=1) == ty).mean()) and last["brier"] == pytest.approx(((p - np.eye(3)[ty]) ** 2).sum(axis=1).mean())


def test_evaluation_sums_are_the_table_metrics(spark):
    rng = np.random.default_rng(9)
    z, y = rng.normal(size=(200, 3)) * 3, rng.integers(0, 3, 200)
    scored = metrics.score_logits(spark.createDataFrame([(z[i].tolist(), int(y[i])) for i in range(200)], "logits array<double>, y int"))
    p = train.softmax_rows(z)
    got = metrics.scores_of(metrics.evaluation_sums(p[:120, None], y[:120])[0] + metrics.evaluation_sums(p[120:, None], y[120:])[0], 3)
    classes = spark.range(3).select(F.col("id").cast("int").alias("label_id"))
    want = {**metrics.summary_scores(metrics.family_scores(metrics.class_counts(metrics.confusion(scored), classes))).head().asDict(), **metrics.normal_fpr(scored, [0]).head().asDict(), **metrics.calibration(scored).head().asDict()}
    assert got == pytest.approx(want)


def test_alpha_grid_against_single_steps(spark):
    """Selection, temperatures and gate bins of the stack against the table operators, model by model."""
    from flowsieve.operators import posthoc

    rng = np.random.default_rng(10)
    n = 1500
    x = rng.normal(size=(n, 4))
    y = (x @ rng.normal(size=(4, 3)) + rng.normal(size=(n, 3)) * 2).argmax(axis=1)
    rows = [(i, "test" if i % 4 == 0 else "train", int(y[i]), x[i].tolist(), float(i % 7) / 7) for i in range(n)]
    df = spark.createDataFrame(rows, "key long, split string, y int, features array<double>, gate double")
    scaled, alphas = np.array([False, False, True, True]), [0.0, 0.5, 1.0]
    got = {(r["scenario"], r["seed"]): r for r in posthoc.alpha_grid(df, scaled, 3, (1, 2), alphas, iterations=40).collect()}
    assert set(got) == {(s, k) for s in posthoc.RULES for k in (1, 2)}
    classes = spark.range(3).select(F.col("id").cast("int").alias("label_id"))
    for seed in (1, 2):
        marks = posthoc.marked(df, (seed,), 0.2)
        fit, valid, test = marks.where("member = 1"), marks.where("valid = 1"), marks.where("split = 'test'")
        counts = {r["y"]: r["count"] for r in fit.groupBy("y").count().collect()}
        weights = {k: sum(counts.values()) / c for k, c in counts.items()}
        weights = {k: w / (sum(weights.values()) / 3) for k, w in weights.items()}
        tried = {}
        for alpha in alphas:
            s = np.where(scaled, alpha, 1.0)
            by = lambda d: d.withColumn("features", F.zip_with("features", F.array(*[F.lit(float(v)) for v in s]), lambda a, b: a * b))  # noqa: E731, B023
            w, _ = train.fit_softmax(by(fit), 3, 4, 40, weights=weights, smoothing=0.05, penalty=0.01)
            logits = lambda d: metrics.score_linear(by(d), w[:-1], w[-1]).select("key", "y", "gate", "logits")  # noqa: E731, B023
            v = logits(valid)
            raw = metrics.score_logits(v)
            best = calibrate.best_temperature(calibrate.temperature_losses(v)).select("temperature", F.array_min("nll").alias("nll")).head()
            figures = metrics.summary_scores(metrics.family_scores(metrics.class_counts(metrics.confusion(raw), classes))).head()["macro_f1"], *metrics.calibration(raw).select("ece", "brier").head()
            tried[alpha] = (*figures, best["nll"], best["temperature"], v, logits(test))
        table = spark.createDataFrame([(seed, a, *t[:4]) for a, t in tried.items()], "seed int, alpha double, macro_f1 double, ece double, brier double, nll double")
        for name, rule in posthoc.RULES.items():
            r = got[name, seed]
            assert r["alpha"] == calibrate.select_candidate(table, ("seed",), rule).head()["alpha"]
            f1, ece, _, nll, temperature, v, t = tried[r["alpha"]]
            assert (r["valid_macro_f1"], r["valid_raw_ece"], r["valid_nll"]) == pytest.approx((f1, ece, nll), abs=2e-3) and r["temperature"] == pytest.approx(temperature)
            assert r["temp_ece"] == pytest.approx(metrics.calibration(metrics.score_logits(t, temperature=temperature)).head()["ece"], abs=5e-3)
            for bins in (2, 3):
                fitted, edges = calibrate.binned_temperatures(v, "gate", bins)
                probs = calibrate.apply_binned(t, "gate", fitted, edges)
                judged = metrics.calibration(probs.withColumn("pred", X.argmax(F.col("probs"))).withColumn("confidence", F.array_max("probs"))).head()
                assert (r[f"group{bins}_ece"], r[f"group{bins}_brier"]) == pytest.approx((judged["ece"], judged["brier"]), abs=5e-3)


def test_alpha_grid_scans_distinct_rows(spark, monkeypatch):
    """Rows that are equal but for the key are one row of every scan, numbered by role; sums, quantiles and the numbers of
    rows are those of all rows."""
    from flowsieve.operators import posthoc
    from flowsieve.operators.quantiles import quantiles

    rng = np.random.default_rng(13)
    kinds = [(rng.normal(size=4).tolist(), int(rng.integers(0, 3)), float(i % 5)) for i in range(40)]
    rows = [(i, "test" if i % 4 == 0 else "train", kinds[i * i % 40][1], kinds[i * i % 40][0], kinds[i * i % 40][2]) for i in range(4000)]
    df = spark.createDataFrame(rows, "key long, split string, y int, features array<double>, gate double").repartition(5)
    distinct = len({(y, tuple(x)) for _, _, y, x, _ in rows})
    counted, marks = posthoc.role_counts(df, ["features", "y", "gate"], (1, 2), 0.2).persist(), posthoc.marked(df, (1, 2), 0.2).persist()
    assert counted.count() == distinct < 50
    models = train.Models.of(4, [0.0, 1.5], np.array([False, False, True, True]), 0.05, 0.01, 2)
    w, by_class = rng.normal(size=(4, 2, 5, 3)), rng.random((2, 3)) + 0.5
    for a, b in zip(train.stack_sums(counted, models, w, by_class), train.stack_sums(marks, models, w, by_class), strict=True):
        assert np.allclose(a, b, rtol=1e-10)
    valid = marks.select(*[F.when(F.shiftright("valid", k).bitwiseAND(F.lit(1).cast("long")) == 1, F.col("gate")).alias(str(k)) for k in (0, 1)])
    at = [0.1, 1 / 3, 0.5, 2 / 3]
    for few in (5, 200_000):
        assert quantiles(counted, {str(k): F.col("gate") for k in (0, 1)}, at, few, times={str(k): F.col("valid")[k] for k in (0, 1)}) == quantiles(valid, {"0": F.col("0"), "1": F.col("1")}, at)
    scanned, sums = [], train.summed
    note = lambda rows, *rest: (scanned.append(rows.count()), sums(rows, *rest))[1]
    monkeypatch.setattr(train, "summed", note)
    monkeypatch.setattr(posthoc, "summed", note)
    got = posthoc.alpha_grid(df, np.array([False, False, True, True]), 3, (1, 2), [0.0, 1.0], iterations=2).collect()
    assert scanned and max(scanned) == distinct
    for r in got:
        k = (1, 2).index(r["seed"])
        want = marks.agg(*[F.sum(F.shiftright(c, k).bitwiseAND(F.lit(1).cast("long"))) for c in ("member", "valid")]).head()
        assert (r["train_rows"], r["valid_rows"], r["test_rows"]) == (*want, 1000)


# ---- quantiles -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("few", [0, 300, 200_000])
def test_quantiles_by_selection(spark, few):
    import duckdb

    from flowsieve.operators.quantiles import quantiles

    rng = np.random.default_rng(3)
    n = 3000
    columns = {
        "uniform": rng.random(n) * 100, "signed": rng.normal(size=n), "skewed": np.exp(rng.normal(size=n) * 20), "tied": rng.integers(0, 4, n).astype(float), "mostly one": np.where(rng.random(n) < 0.9, 7.5, rng.random(n)), "tiny": rng.random(n) * 1e-300, "wide": rng.choice([-1e308, -1.0, 0.0, -0.0, 1e-308, 5e-324, 1e308], n),
        "close": 1e9 + rng.random(n) * 1e-3, "constant": np.full(n, -3.0),
    }
    frame = {k: [None if i % 11 == 0 else float(x) for i, x in enumerate(v)] for k, v in columns.items()}
    df = spark.createDataFrame(list(zip(*frame.values())), ", ".join(f"`{k}` double" for k in frame)).repartition(5)
    at = [0.0, 0.25, 0.5, 0.75, 1 / 3, 0.999, 1.0]
    got = quantiles(df, {k: X.q(k) for k in frame}, at, few=few, parts=16)
    con = duckdb.connect()
    for k, values in frame.items():
        con.execute("CREATE OR REPLACE TABLE t (x DOUBLE)")
        con.executemany("INSERT INTO t VALUES (?)", [(v,) for v in values])
        want = con.execute(f"SELECT {', '.join(f'quantile_cont(x, {a})' for a in at)} FROM t").fetchone()
        assert got[k] == pytest.approx(list(want), rel=1e-12, abs=0), k
    odd = spark.createDataFrame([(float("inf"), None, 1.0), (float("-inf"), None, float("nan")), (1.0, None, 3.0)], "a double, b double, c double")
    assert quantiles(odd, {c: X.q(c) for c in "abc"}, [0.0, 0.5, 1.0]) == {"a": [float("-inf"), 1.0, float("inf")], "b": [None] * 3, "c": [1.0, 2.0, 3.0]}
    assert quantiles(odd.limit(0), {"a": X.q("a")}, [0.5]) == {"a": [None]}


def test_profile_counts_few_values_exactly(spark):
    df = spark.range(5000).select((F.col("id") % 81).alias("eighty_one"), (F.col("id") % 80).cast("string").alias("eighty"), F.col("id").cast("string").alias("many"), F.lit(None).cast("string").alias("none"))
    got = {r["column_name"]: r for r in profile.with_kinds(profile.profile(df, df.columns), numeric_ratio=1.1).collect()}
    assert (got["eighty_one"]["n_distinct"], got["eighty"]["n_distinct"], got["none"]["n_distinct"]) == (81, 80, 0) and abs(got["many"]["n_distinct"] - 5000) < 250
    assert [got[c]["kind"] for c in df.columns] == ["dropped", "categorical", "dropped", "dropped"]
    assert profile.profile(df.limit(0), df.columns).count() == 4 and profile.profile(df, []).count() == 0


@pytest.mark.parametrize("parts", [1, 8, 33])
def test_numbering_loses_and_repeats_no_row(spark, parts):
    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") < 15_000, "b").alias("label")).repartition(parts)
    h = F.md5(F.col("key").cast("string"))
    by_hash = sampling.distributed_row_number(rows.withColumn("h", h), [F.col("h"), F.col("key")], [sampling.hash_bucket(F.col("h"))], "n").orderBy("n").select("n", "h").collect()
    assert [r["n"] for r in by_hash] == list(range(1, n + 1)) and [r["h"] for r in by_hash] == sorted(r["h"] for r in by_hash)
    clients = sampling.iid_clients(rows, "key", 7).groupBy("client_id").count().collect()
    assert sorted(r["count"] for r in clients) == sorted([n // 7 + 1] * (n % 7) + [n // 7] * (7 - n % 7))
    skew = sampling.label_skew_clients(rows, "label", "key", 5, 3).collect()
    assert sorted(r["key"] for r in skew) == list(range(n)) and {r["client_id"] for r in skew} == set(range(5))


def test_permuted_and_poisoned_columns_keep_their_values(spark):
    rows = spark.range(3000).select(F.col("id").alias("key"), (F.col("id") % 2).alias("split"), (F.col("id") * 1.0).alias("x"), (F.col("id") * 2.0).alias("y"))
    moved = evidence.permute_column(rows, "x", "split", "key").collect()
    assert sorted(r["x"] for r in moved) == [float(i) for i in range(3000)] and all(r["x"] % 2 == r["split"] for r in moved) and sum(r["x"] != r["key"] for r in moved) > 2900
    bad = evidence.poison_evidence(rows, ["x", "y"], 0.3, "split", "key").collect()
    assert sorted(r["x"] for r in bad) == [float(i) for i in range(3000)] and all(r["y"] == 2 * r["x"] and r["x"] % 2 == r["split"] for r in bad)
    assert 700 < sum(r["x"] != r["key"] for r in bad) < 1100


@pytest.mark.parametrize("parts", [1, 33])
def test_text_keys_are_numbered_in_ranges(spark, parts):
    n = 6000
    rows = spark.range(n).select(F.concat(F.lit("device-000-"), F.col("id").cast("string")).alias("key"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("label"), (F.col("id") * 1.0).alias("x")).repartition(parts)
    cut, at = sampling.with_range(rows, X.q("key"), X.q("label"))
    sizes = {(r["label"], r["_range"]): r["count"] for r in cut.groupBy("label", "_range").count().collect()}
    assert sum(sizes.values()) == n and max(v for (k, _), v in sizes.items() if k == "a") < 5400 / 64 * 4
    order = [r["key"] for r in sampling.distributed_row_number(cut, [X.q("key")], [X.q("label"), *at], "n", within=1).where("label = 'a'").orderBy("n").collect()]
    assert order == sorted(order) and len(order) == 5400
    skew = sampling.label_skew_clients(rows, "label", "key", 5, 3).collect()
    assert len({r["key"] for r in skew}) == n and {r["client_id"] for r in skew} == set(range(5))
    moved = evidence.permute_column(rows, "x", "label", "key").collect()
    assert sorted(r["x"] for r in moved) == [float(i) for i in range(n)]


def test_prefixes_without_a_limit(spark, capsys, tmp_path):
    n = 4000
    rows = spark.range(n).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("family")).repartition(7)
    names = sorted(f"k{i}" for i in range(n))
    for first in (0, 1, 63, 2500, n, n + 1):
        assert sorted(r["key"] for r in sampling.first_rows(rows, "key", first).collect()) == names[:first]
    for ranked in (1, 10, 100_000):
        assert sampling.prefix_bound(rows, "key", 2500, ranked) == (names[2499],)
    assert sampling.prefix_bound(rows.select(F.lit(7).alias("x")), "x", 9, 1) == (7,)
    want = [k for f in ("hot", "rare") for k in [x for x in names[:2500] if (int(x[1:]) % 10 == 0) == (f == "rare")][:800]]
    assert sorted(r["key"] for r in sampling.first_come_cap(rows, "family", "key", 800, 2500).collect()) == sorted(want)
    import hashlib

    order = sorted(names, key=lambda k: (hashlib.md5(f"42|rows|{k}".encode()).hexdigest(), k))
    assert sorted(r["key"] for r in sampling.random_rows(rows, "key", 2000).collect()) == sorted(order[:2000])
    sampling.random_rows(rows, "key", 2000).explain()
    assert "Limit" not in capsys.readouterr().out
    path = f"file://{tmp_path}/t"
    rows.write.parquet(path)
    told, by, at = sampling.in_file_order(spark.read.parquet(path), run=100)
    first = sampling.distributed_row_number(told, by, at, "n").where("n <= 1700").select("_file", "_row").collect()
    files = sorted((r["_file"], r["_row"]) for r in told.collect())
    assert sorted(map(tuple, first)) == files[:1700]


def test_quota_cuts_large_buckets_again(spark):
    rows = spark.range(2000).select(F.lit("g").alias("_g"), F.md5(F.col("id").cast("string")).alias("_h"), F.col("id").alias("_k"))
    whole = sorted((r["_h"], r["_k"]) for r in rows.collect())
    for need in (1, 777, 2000):
        for ranked in (1, 100_000):
            assert sampling.quota_thresholds(rows, F.lit(need), ranked) == [("g", *whole[need - 1])]


def test_distances_in_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 50)) + 1000
    updates = spark.createDataFrame([(c, k, float(x[c, k]), 1) for c in range(60) for k in range(50)], federated.UPDATE)
    got = {(r["a"], r["b"]): r["distance"] for r in federated.client_distances(updates, clients_at_once=7, coords_at_once=16).collect()}
    assert set(got) == {(a, b) for a in range(60) for b in range(60) if a != b}
    assert all(d == pytest.approx(((x[a] - x[b]) ** 2).sum()) for (a, b), d in got.items())


def test_csv_parts_by_name_and_status(spark, tmp_path):
    from flowsieve.sources import tables

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.csv").write_text("x,label\n1,dos\n2,benign\n")
    (tmp_path / "2.csv").write_text("label,x\ndos,3\n")
    (tmp_path / "3.csv").write_text("\n\n")
    (tmp_path / "4.csv").write_text("other\n7\n")
    root = f"file://{tmp_path}"
    got = tables.read_csv_files(spark, root).where("x IS NOT NULL").select("x", "label").collect()
    assert sorted((r["x"], r["label"]) for r in got) == [("1", "dos"), ("2", "benign"), ("3", "dos")]
    status = {r["file"].rsplit("/", 1)[1]: r for r in tables.scan_status(spark, root, ["x", "label"], "label").collect()}
    assert {k: r["status"] for k, r in status.items()} == {"1.csv": "ok", "2.csv": "ok", "3.csv": "empty", "4.csv": "error"}
    assert status["4.csv"]["error"] == "none of the columns" and status["1.csv"]["labels"] == '{"benign":1,"dos":1}' and status["1.csv"]["n_columns"] == 2


def test_broken_files_tell_what_they_lose(spark, tmp_path):
    import gzip

    from flowsieve.sources import csv_scan

    lines = [f"{i},{'dos' if i % 3 else 'benign'}" for i in range(5000)]
    whole = "x,label\n" + "\n".join(lines) + "\n"
    (tmp_path / "good one.csv").write_text("\ufeffX,LABEL\r\n1,dos\r\n\r\n2\r\n", newline="")  # a mark, other case, a blank line, a short row
    (tmp_path / "zipped.csv.gz").write_bytes(gzip.compress(whole.encode()))
    (tmp_path / "cut.csv.gz").write_bytes(gzip.compress(whole.encode())[:-9000])
    (tmp_path / "body.csv").write_bytes(whole.encode() + b"7,\xff\xfe\n8,dos\n")
    (tmp_path / "wide.csv").write_text('x,label\n1,"a,b"\n1,2,3\n"two\nlines",dos\n')
    (tmp_path / "binary.csv").write_bytes(bytes(range(256)))
    scan = csv_scan.scan_csv(spark, f"file://{tmp_path}", ["x", "label"])
    told = {r["file"].rsplit("/", 1)[1]: r for r in csv_scan.report(scan, "label").collect()}
    assert {k.replace("%20", " "): (r["status"], r["n_bad"]) for k, r in told.items()} == {"good one.csv": ("ok", 0), "zipped.csv.gz": ("ok", 0), "cut.csv.gz": ("partial", 0), "body.csv": ("partial", 0), "wide.csv": ("partial", 1), "binary.csv": ("error", 0)}
    assert told["zipped.csv.gz"]["n_rows"] == 5000 and told["body.csv"]["n_rows"] == 5000 and 0 < told["cut.csv.gz"]["n_rows"] < 5000
    assert told["body.csv"]["error"].startswith("UnicodeDecodeError") and told["cut.csv.gz"]["error"].startswith("EOFError") and told["zipped.csv.gz"]["labels"] == '{"benign":1667,"dos":3333}'
    rows = csv_scan.rows_of(scan).groupBy("_file").count().collect()
    assert {r["_file"].rsplit("/", 1)[1]: r["count"] for r in rows} == {k: r["n_rows"] for k, r in told.items() if r["n_rows"]}
    assert sorted((r["x"], r["label"]) for r in csv_scan.rows_of(scan).where("_file LIKE '%wide.csv'").collect()) == [("1", "a,b"), ("two\nlines", "dos")]


def test_presence_by_number_or_text(spark):
    df = spark.createDataFrame([(0.0, "0.00"), (0.0, "0.0"), (0.0, " "), (0.0, "None"), (0.0, None), (1e-13, ""), (float("nan"), "NaN"), (None, "nan"), (2.0, "0"), (0.0, "-1")], "TCP double, `tcp.x` string")
    assert [r[0] for r in df.select(evidence.present(df, ("TCP", "tcp.*"))).collect()] == [True, False, True, False, False, True, False, False, True, True]


def test_ranking_in_one_query_for_all_classes(spark):
    rng = np.random.default_rng(6)
    probs = np.round(rng.dirichlet(np.ones(4) * 0.3, 500), 3)
    y = np.array([rng.choice(4, p=p / p.sum()) for p in probs])
    y[y == 3] = 2
    long = spark.createDataFrame([(p.tolist(), int(k)) for p, k in zip(probs, y)], "probs array<double>, y int")
    rows = long.select("y", F.posexplode("probs").alias("label_id", "s")).select("label_id", "s", (F.col("y") == F.col("label_id")).alias("positive"))
    got = {r["label_id"]: r for r in metrics.ranking_by_class(rows, ranges=8).collect()}
    for k in range(4):
        a, b = probs[y == k, k], probs[y != k, k]
        if not len(a):
            assert got[k]["auroc"] is None
            continue
        assert got[k]["auroc"] == pytest.approx(((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b)))
        cut = sorted(set(probs[:, k]), reverse=True)
        tp, n = np.array([(a >= c).sum() for c in cut]), np.array([(probs[:, k] >= c).sum() for c in cut])
        assert got[k]["auprc"] == pytest.approx((np.diff(np.concatenate([[0], tp])) / len(a) * tp / n).sum())


def test_macro_ranking_and_retention(spark):
    rows = spark.createDataFrame([([0.7, 0.2, 0.1], 0), ([0.1, 0.8, 0.1], 1), ([0.3, 0.4, 0.3], 0)], "probs array<double>, y int")
    got = metrics.macro_ranking(rows, 3).head()
    assert got["n_classes"] == 2 and got["auroc"] == 1.0
    a, b = (spark.createDataFrame([("m", v)], "d string, f double") for v in (0.8, 0.6))
    assert metrics.retention(a, b, "f", ("d",)).head()["retention"] == pytest.approx(0.75)
