"""Evaluation, thresholds, ensembles, features and the baseline."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.operators import baseline as bl
from labelweave.operators import comparison as cmp
from labelweave.operators import features as ft
from labelweave.operators import hierarchy as hi
from labelweave.operators import metrics as met
from labelweave.operators import preparation as prep
from labelweave.operators import routing
from labelweave.operators import thresholds as th
from labelweave.sources import predictions as pred

LABELS = ["A", "B", "C"]


def scored_frame(spark, true, predicted):
    names = lambda row: [l for l, x in zip(LABELS, row) if x]
    rows = [(i, names(t), names(p)) for i, (t, p) in enumerate(zip(true, predicted))]
    return spark.createDataFrame(rows, "doc_id int, y_true array<string>, y_pred array<string>")


def label_frame(spark, labels=LABELS):
    return spark.createDataFrame([(l,) for l in labels], "label string")


def evaluated(spark, true, predicted):
    return met.evaluate(met.tally(scored_frame(spark, true, predicted)), label_frame(spark)).first()


TRUE = [[1, 1, 0], [1, 0, 0], [0, 1, 1], [0, 0, 1], [1, 0, 1]]
PRED = [[1, 1, 0], [1, 0, 1], [0, 0, 1], [0, 0, 1], [1, 0, 0]]


def test_hand_computed_metrics(spark):
    r = evaluated(spark, TRUE, PRED)
    # A 3 hits; B 1 hit, 1 missed; C 2 hits, 1 false, 1 missed.
    assert (r.precision_micro, r.recall_micro) == (pytest.approx(6 / 7), pytest.approx(6 / 8))
    assert r.f1_micro == pytest.approx(12 / 15)
    assert r.f1_macro == pytest.approx((1 + 2 / 3 + 2 / 3) / 3)
    assert r.f1_weighted == pytest.approx((3 * 1 + 2 * 2 / 3 + 3 * 2 / 3) / 8)
    assert r.hamming_loss == pytest.approx(3 / 15)
    assert r.exact_match == 0.4
    assert r.f1_samples == pytest.approx((1 + 2 / 3 + 2 / 3 + 1 + 2 / 3) / 5)


def test_perfect_and_all_wrong(spark):
    right = evaluated(spark, TRUE, TRUE)
    assert (right.f1_micro, right.precision_micro, right.recall_micro, right.exact_match) == (1, 1, 1, 1)
    flipped = [[1 - x for x in row] for row in TRUE]
    assert evaluated(spark, TRUE, flipped).f1_micro == 0


def test_empty_documents_count(spark):
    r = evaluated(spark, [[0, 0, 0], [1, 0, 0]], [[0, 0, 0], [1, 0, 0]])
    assert (r.exact_match, r.f1_samples, r.hamming_loss) == (1.0, 0.5, 0.0)
    assert r.f1_macro == pytest.approx(1 / 3)


def test_labels_outside_the_class_table_fail(spark):
    stray = met.tally(scored_frame(spark, TRUE, PRED))
    for evaluate in (met.evaluate, met.per_class):
        with pytest.raises(Exception, match="label outside the class table: C"):
            evaluate(stray, label_frame(spark, ["A", "B"])).collect()


def test_per_class_and_feasibility(spark):
    classes = met.per_class(met.tally(scored_frame(spark, TRUE, PRED)), label_frame(spark, [*LABELS, "D"]))
    rows = {r.label: (r.f1, r.support, r.predicted_count) for r in classes.collect()}
    assert rows["A"] == (1.0, 3, 3) and rows["D"] == (0.0, 0, 0)
    assert rows["B"] == (pytest.approx(2 / 3), 2, 1) and rows["C"] == (pytest.approx(2 / 3), 3, 3)
    assert [r.label for r in met.top_classes(classes, 2).collect()] == ["A", "B"]
    assert [r.label for r in met.bottom_classes(classes, 2).collect()] == ["D", "B"]
    flags = {r.label: (r.automation_feasible, r.high_confidence, r.needs_review) for r in met.feasibility(classes).collect()}
    assert flags == {"A": (True, True, False), "B": (True, False, False), "C": (True, False, False), "D": (False, False, False)}
    assert [r.label for r in met.classification_report(classes).collect()] == ["A", "B", "C", "D"]


def probability_frame(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        true = [l for l in LABELS if rng.random() < 0.4]
        rows.append((i, true, [(l, float(np.round(rng.random(), 2))) for l in LABELS]))
    return spark.createDataFrame(rows, "doc_id int, y_true array<string>, cells array<struct<label:string,p:double>>")


def test_sweep_equals_direct_evaluation(spark):
    docs, labels = probability_frame(spark), label_frame(spark)
    grid = [0.1, 0.25, 0.5, 0.75, 0.9]
    sweep = th.threshold_sweep(th.sweep_counts(docs, "p", grid), labels, th.document_count(docs))
    for row in sweep.collect():
        y = docs.withColumn("y_pred", met.predicted("cells", "p", row.threshold))
        direct = met.evaluate(met.tally(y), labels).first()
        assert row.f1_micro == pytest.approx(direct.f1_micro)
        assert row.f1_macro == pytest.approx(direct.f1_macro)
        assert (row.precision, row.recall) == (pytest.approx(direct.precision_micro), pytest.approx(direct.recall_micro))


def test_sweep_with_sparse_cells_keeps_support(spark):
    docs = probability_frame(spark)
    sparse = docs.withColumn("cells", F.filter("cells", lambda c: c["p"] >= 0.4))
    counts = lambda d: sorted(map(tuple, th.sweep_counts(d, "p", [0.5, 0.8]).collect()))
    assert counts(sparse) == counts(docs)


def test_best_threshold_is_the_lowest_of_equals(spark):
    sweep = spark.createDataFrame([(0.5, 0.7), (0.3, 0.7), (0.9, 0.1)], "threshold double, f1_micro double")
    assert th.best_threshold(sweep).first().threshold == 0.3


def test_degenerate_thresholds_keep_the_default(spark):
    rows = [(i, ["A"], [("A", 0.95)]) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id int, y_true array<string>, cells array<struct<label:string,p:double>>")
    counts = th.sweep_counts(docs, "p", [0.3, 0.5, 0.7])
    row = th.per_class_thresholds(counts, label_frame(spark, ["A"]), th.document_count(docs), default=0.5).first()
    assert (row.threshold, row.f1_best, row.support) == (0.5, 0.0, 4)


def test_class_thresholds_apply_in_class_order(spark):
    docs = probability_frame(spark)
    limits = spark.createDataFrame([("C", 0.2), ("A", 0.9), ("B", 0.5)], "label string, threshold double")
    limit = {"A": 0.9, "B": 0.5, "C": 0.2}
    for r in th.apply_class_thresholds(docs, limits, "p").collect():
        assert r.y_pred == [c.label for c in r.cells if c.p >= limit[c.label]]
    mixed = docs.withColumn("cells", F.reverse("cells"))
    with pytest.raises(Exception, match="differ in class"):
        th.apply_class_thresholds(mixed, limits, "p").select("y_pred").collect()


def pair_frame(spark):
    rows = [(["A"], ["A", "B"], ["A"]), (["B", "C"], ["B"], ["C"]), ([], [], ["A"]), (["A", "C"], ["A"], ["C"])]
    return spark.createDataFrame(rows, "y_true array<string>, y1 array<string>, y2 array<string>")


def test_agreement_adds_up(spark):
    r = cmp.agreement(pair_frame(spark), label_frame(spark)).first()
    assert (r.both_positive, r.only_model1, r.only_model2, r.both_negative) == (1, 3, 3, 5)
    assert r.agreement_rate == pytest.approx(0.5) and r.disagreement_rate == pytest.approx(0.5)


def test_ensembles(spark):
    pairs, labels = pair_frame(spark), label_frame(spark)
    versus = cmp.per_class_comparison(pairs, labels)
    got = {s: [sorted(r.y_pred) for r in cmp.ensemble(pairs, s, versus).collect()] for s in ("union", "intersection", "best_per_class", "weighted")}
    assert got["union"] == [["A", "B"], ["B", "C"], ["A"], ["A", "C"]]
    assert got["intersection"] == [["A"], [], [], []]
    better = {r.label: r.better_model for r in versus.collect()}
    assert better == {"A": "model1", "B": "model1", "C": "model2"}
    assert got["best_per_class"] == [["A", "B"], ["B", "C"], [], ["A", "C"]]
    with pytest.raises(ValueError):
        cmp.ensemble(pairs, "majority")
    with pytest.raises(ValueError):
        cmp.ensemble(pairs, "weighted")
    recall = lambda s: met.evaluate(met.tally(cmp.ensemble(pairs, s, versus)), labels).first().recall_micro
    assert recall("union") >= recall("best_per_class") >= recall("intersection")


def test_split_is_complete_seeded_and_keeps_copies_together(spark):
    texts = spark.range(3000).select("id", F.concat(F.lit("t"), F.col("id") % 1500).alias("text"))
    parts = prep.split(texts)
    sizes = {r.split: r["count"] for r in parts.groupBy("split").count().collect()}
    assert sum(sizes.values()) == 3000
    sd = (1500 * 0.15 * 0.85) ** 0.5 * 2
    assert abs(sizes["test"] - 450) < 3 * sd and abs(sizes["val"] - 450) < 3 * sd
    assert parts.groupBy("text").agg(F.countDistinct("split").alias("k")).where("k > 1").count() == 0
    listed = lambda seed: [r.split for r in prep.split(texts, seed=seed).orderBy("id").collect()]
    assert listed(42) == listed(42) and listed(42) != listed(7)


def test_stricter_filter_keeps_fewer_labels(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["c"]), (4, [])], "doc_id int, labels array<string>")
    from labelweave.operators.labels import label_counts

    counts = label_counts(docs)
    kept = prep.keep_viable(docs, counts, 2)
    assert sorted((r.doc_id, tuple(r.labels)) for r in kept.collect()) == [(1, ("a",)), (2, ("a",))]
    assert prep.keep_viable(docs, counts, None).count() == 4
    assert prep.viable_labels(counts, 1).count() > prep.viable_labels(counts, 2).count()
    hot = {r.doc_id: r.y for r in prep.multi_hot(docs, counts).collect()}
    assert hot == {1: [1, 1, 0], 2: [1, 0, 0], 3: [0, 0, 1], 4: [0, 0, 0]}


def test_ngrams_span_removed_words(spark):
    df = spark.createDataFrame([(1, "The cat of the House sat x")], "doc_id int, text string")
    got = ft.with_terms(df, ("the", "of"), (1, 3)).first().terms
    assert got == ["cat", "house", "sat", "cat house", "house sat", "cat house sat"]
    assert ft.with_terms(df.withColumn("text", F.lit("one")), (), (1, 2)).first().terms == ["one"]
    assert "the" in ft.english_stop_words()


def toy_training(spark, n=80, seed=0):
    rng = np.random.default_rng(seed)
    words = {"A": "apple", "B": "berry"}
    rows = []
    for i in range(n):
        labels = [l for l in words if rng.random() < 0.45]
        noise = [f"noise{rng.integers(0, 6)}" for _ in range(4)]
        shown = [words[l] for l in labels if rng.random() < 0.9] + [w for w in words.values() if rng.random() < 0.1]
        rows.append((i, labels + ["always"], " ".join(noise + shown)))
    return spark.createDataFrame(rows, "doc_id int, labels array<string>, text string")


def newton(x, y, c=1.0):
    n = len(y)
    s = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    z = np.hstack([x, np.ones((n, 1))])
    w = np.zeros(z.shape[1])
    penalty = np.r_[np.ones(x.shape[1]), 0.0]
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        grad = penalty * w + c * z.T @ (s * (p - y))
        hess = np.diag(penalty) + c * (z.T * (s * p * (1 - p))) @ z
        w -= np.linalg.solve(hess, grad)
    return w


def test_fit_matches_newton_and_scores(spark):
    docs = toy_training(spark)
    termed = ft.with_terms(docs, (), (1, 1))
    vocab = ft.fit_vocabulary(termed)
    vectors = ft.vectorize(termed, vocab)
    labels = label_frame(spark, ["A", "B", "always", "never"])
    model = {r.label: r for r in bl.fit_baseline(vectors, labels, tol=1e-6).collect()}
    assert model["always"].constant and model["never"].constant
    rows = vectors.orderBy("doc_id").collect()
    x = np.array([r.features.toArray() for r in rows])
    assert np.allclose((x ** 2).sum(axis=1), 1.0)
    for label in ("A", "B"):
        y = np.array([float(label in r.labels) for r in rows])
        want = newton(x, y)
        assert np.allclose(model[label].weights, want[:-1], atol=2e-3)
        assert model[label].intercept == pytest.approx(want[-1], abs=2e-3)
    frame = bl.model_frame(spark, [tuple(m) for m in model.values()])
    scored = bl.predict(bl.predict_proba(vectors, frame)).collect()
    assert all([c.p for c in r.cells if c.label == "always"] == [1.0] for r in scored)
    assert all([c.p for c in r.cells if c.label == "never"] == [0.0] for r in scored)
    hits = np.mean([("A" in r.y_pred) == ("A" in r.labels) for r in scored])
    assert hits > 0.75
    with pytest.raises(ValueError):
        bl.predict_proba(vectors, frame.limit(0))


def test_scores_do_not_depend_on_blocks(spark, monkeypatch):
    docs = ft.with_terms(toy_training(spark), (), (1, 1))
    vectors = ft.vectorize(docs, ft.fit_vocabulary(docs))
    width = len(vectors.first().features)
    model = bl.model_frame(spark, [(l, 0.1 * i, [0.3 * i - 0.01 * j for j in range(width)], False) for i, l in enumerate("xyz")])
    listed = lambda: [[c.p for c in r.cells] for r in bl.predict_proba(vectors, model).orderBy("doc_id").collect()]
    whole = listed()
    monkeypatch.setattr(bl, "MAX_BLOCK", 1)
    assert np.allclose(listed(), whole)


def test_fit_does_not_depend_on_blocks_parts_or_empty_tasks(spark, monkeypatch):
    docs = ft.with_terms(toy_training(spark), (), (1, 1))
    vectors = ft.vectorize(docs, ft.fit_vocabulary(docs))
    fitted = lambda frame: {r.label: [r.intercept, *r.weights] for r in bl.fit_baseline(frame, label_frame(spark, ["A", "B", "never"]), tol=1e-7).collect()}
    whole = fitted(vectors.coalesce(1))
    monkeypatch.setattr(bl, "MAX_BLOCK", 1)
    monkeypatch.setattr(bl, "FAN", 2)
    spread = fitted(vectors.repartition(7))
    assert whole.keys() == spread.keys() == {"A", "B", "never"}
    for label in ("A", "B"):
        assert np.allclose(whole[label], spread[label], atol=1e-4)
    assert spread["never"][0] == float("-inf")


def fits_with_rounds(vectors, monkeypatch, **named):
    """Coefficients by label, and how many states were written."""
    written, made = [], bl.run_dir
    monkeypatch.setattr(bl, "run_dir", lambda spark, name: (written.append(name), made(spark, name))[1])
    fitted = bl.fit_baseline(vectors, label_frame(vectors.sparkSession, ["A", "B"]), **named).collect()
    monkeypatch.setattr(bl, "run_dir", made)
    return {r.label: [r.intercept, *r.weights] for r in fitted}, written.count("fits")


def test_fit_takes_few_rounds_and_drawn_rows_do_not_change_it(spark, monkeypatch):
    docs = ft.with_terms(toy_training(spark, 200), (), (1, 2))
    vectors = ft.vectorize(docs, ft.fit_vocabulary(docs))
    whole, rounds = fits_with_rounds(vectors, monkeypatch, tol=1e-7, c=50.0)
    assert rounds <= 30
    monkeypatch.setattr(bl, "CURVATURE", 600)
    drawn, _ = fits_with_rounds(vectors, monkeypatch, tol=1e-7, c=50.0)
    for label in ("A", "B"):
        assert np.allclose(whole[label], drawn[label], atol=1e-3)


def test_drawn_rows_stand_for_all(spark, monkeypatch):
    """Rare classes stay whole, and rows divided by their share add up."""
    rows = [(["A"] if i < 5 else [], [i % 7, 7], [1.0, 0.5]) for i in range(4000)]
    frame = spark.createDataFrame(rows, "labels array<string>, i array<int>, x array<double>")
    state = {"label": "A", "w_pos": 400.0, "w_neg": 0.5, "trial": bytes(72), "steps": 0, "done": False}
    path = bl.run_dir(spark, "state")
    spark.createDataFrame([state], "label string, w_pos double, w_neg double, trial binary, steps int, done boolean").write.parquet(path)
    monkeypatch.setattr(bl, "CURVATURE", 3000)
    drawn = bl._drawn(frame, path).collect()
    assert sum(r.labels == ["A"] for r in drawn) == 5 and 500 < len(drawn) < 1300
    assert sum(1 / r.share for r in drawn) == pytest.approx(4000, rel=0.15)
    monkeypatch.setattr(bl, "CURVATURE", 12000)
    assert bl._drawn(frame, path).count() == 4000


def test_a_step_that_goes_too_far_is_worked_out_again():
    row = {
        "label": "a", "point": np.zeros(2).tobytes(), "trial": np.array([4.0, 0.0]).tobytes(), "gradient": np.array([-1.0, 0.0]).tobytes(),
        "past": b"", "scale": np.ones(2).tobytes(), "loss": 1.0, "step": 1.0, "slope": -4.0, "steps": 1, "halvings": 0, "done": False,
    }
    curvature = lambda point, scale: lambda g: 4 * g
    after = bl._advanced(row, np.array([1.0, 0.0, 50.0]), 1.0, 10, 1e-6, curvature)
    # On the way to the trial the gradient rose by 6 over 4.
    assert np.allclose(np.frombuffer(after["trial"]), [4 / 6, 0.0]) and (after["point"], after["halvings"], after["done"]) == (row["point"], 1, False)


def test_a_step_that_does_not_lower_the_loss_is_halved():
    row = {
        "label": "a", "point": np.zeros(2).tobytes(), "trial": np.array([4.0, 0.0]).tobytes(), "gradient": np.array([-1.0, 0.0]).tobytes(),
        "past": b"", "scale": np.ones(2).tobytes(), "loss": 1.0, "step": 1.0, "slope": -4.0, "steps": 1, "halvings": 0, "done": False,
    }
    after = bl._advanced(row, np.array([1.0, 0.0, 50.0]), 1.0, 10, 1e-6)
    assert np.frombuffer(after["trial"]).tolist() == [2.0, 0.0] and (after["step"], after["halvings"], after["done"]) == (0.5, 1, False)
    last = bl._advanced(row | {"halvings": bl.HALVINGS - 1}, np.array([1.0, 0.0, 50.0]), 1.0, 10, 1e-6)
    assert last["done"] and last["point"] == row["point"]


def test_penalised_gradient_is_zero_at_the_fit_only(spark):
    docs = ft.with_terms(toy_training(spark), (), (1, 1))
    vectors = ft.vectorize(docs, ft.fit_vocabulary(docs))
    model = bl.fit_baseline(vectors, label_frame(spark, ["A", "B"]), tol=1e-6)
    steep = {r.label: r.gradient for r in bl.penalised_gradient(vectors, model).collect() if r.label != "always"}
    assert max(steep.values()) < 2e-3
    moved = model.withColumn("intercept", F.col("intercept") + 0.5)
    assert min(r.gradient for r in bl.penalised_gradient(vectors, moved).collect() if r.label != "always") > 0.1


def test_tasks_add_up_residuals_before_they_move(spark):
    """Many small batches of a task give one row a label, and the components are those of plain sums."""
    docs = ft.with_terms(toy_training(spark), (), (1, 1))
    vectors = ft.vectorize(docs, ft.fit_vocabulary(docs)).coalesce(1)
    width = len(vectors.first().features)
    model = bl.model_frame(spark, [(l, 0.1, [0.3 * i - 0.1 * j for j in range(width)], False) for i, l in enumerate("AB")])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        steep = bl.penalised_gradient(vectors, model, 2.0)
        assert "posexplode" not in steep._jdf.queryExecution().executedPlan().toString()
        got = {r.label: r.gradient for r in steep.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = vectors.collect()
    x = np.array([[*r.features.toArray(), 1.0] for r in rows])
    for r in model.collect():
        y = np.array([r.label in one.labels for one in rows])
        cost = np.where(y, len(y) / 2 / y.sum(), len(y) / 2 / (~y).sum())
        w = np.array([*r.weights, r.intercept])
        want = x.T @ (cost * (1 / (1 + np.exp(-x @ w)) - y)) + np.append(w[:-1], 0) / 2
        assert got[r.label] == pytest.approx(np.abs(want).max())


def test_large_degrees_of_freedom():
    from labelweave.functions.stats import two_sided_p

    assert two_sided_p(1.96, 1e12) == pytest.approx(0.0499957902964, abs=1e-11)
    assert two_sided_p(2.5, 999_999) == pytest.approx(two_sided_p(2.5, 1_000_001), abs=1e-9)
    assert two_sided_p(1.0, 1.0) == pytest.approx(0.5)


def test_decisions_list_the_ones_and_count_the_zeros(spark):
    rows = [(1, [("A", 0.9), ("B", 0.5), ("C", 0.1)]), (2, [("A", 0.1)])]
    df = spark.createDataFrame(rows, "doc_id int, cells array<struct<label:string,p:double>>")
    assert [tuple(r) for r in th.decisions(df, "p", 0.5).collect()] == [(1, ["A", "B"], 1), (2, [], 1)]


def test_second_run_has_no_misses(spark, tmp_path):
    texts = spark.createDataFrame([(1, "w " * 40), (2, "w " * 40), (3, "v " * 50)], "doc_id int, text string")
    calls = spark.sparkContext.accumulator(0)

    def load():
        def summarize(batch):
            calls.add(len(batch))
            return [t[:3] for t in batch]

        return summarize

    path = str(tmp_path / "cache")
    run = lambda: routing.summarize_corpus(texts, path, routing.model_strategy(load, 1)).orderBy("doc_id").collect()
    first, second = run(), run()
    assert calls.value == 2
    assert [r.summary for r in first] == [r.summary for r in second] == ["w w", "w w", "v v"]
    assert not any(r.cached for r in first) and all(r.cached for r in second)


def test_head_tail_and_truncate(spark):
    df = spark.createDataFrame([("0123456789" * 10, 50)], "t string, n int")
    row = df.select(
        routing.head_tail(F.col("t"), F.col("n"), 10).alias("a"), routing.head_tail(F.col("t"), F.col("n"), 10, 1.0).alias("b")
    ).first()
    assert row.a == "01234567890123 [...] 456789"
    assert row.b == "01234567890123456789 [...] "
    texts = spark.createDataFrame([("Don't  stop, now.",), (" one  two, three four",), (None,), ("",)], "t string")
    cut = lambda n: [r[0] for r in texts.select(routing.truncated(F.col("t"), n)).collect()]
    assert cut(8) == ["Don't  stop, now", " one  two, three four", None, ""]
    assert cut(6) == ["Don't  stop", " one  two, three", None, ""]


def test_head_tail_of_a_very_long_text(spark):
    text = spark.range(1).select(F.repeat(F.lit("word "), 150_000).alias("text"), F.lit(150_002).alias("token_count"))
    row = routing.head_tail_strategy()(text).first()
    target = 750_000 * 4096 // 150_002
    assert len(row.summary) == target + len(routing.GAP) and row.summary.startswith("word word")


def test_repeated_ids_keep_their_own_summary(spark, tmp_path):
    texts = spark.createDataFrame([(1, "alpha " * 9), (1, "beta " * 9), (None, "alpha " * 9), (2, None)], "doc_id int, text string")
    load = lambda: lambda batch: [t[:4] for t in batch]
    for path in (str(tmp_path / "cache"), str(tmp_path / "cache"), None):
        done = routing.summarize_corpus(texts, path, routing.model_strategy(load)).collect()
        got = sorted(((r.doc_id, r.summary) for r in done), key=repr)
        assert got == sorted([(1, "alph"), (1, "beta"), (None, "alph"), (2, None)], key=repr)


def test_imported_entries_are_found_by_key_and_length(spark, tmp_path):
    from labelweave.sources import summaries

    texts = spark.createDataFrame([(1, "alpha beta")], "doc_id int, text string")
    key = routing.content_keys(texts).first()
    entry = spark.createDataFrame([(key.hash, 10, 3, "old")], summaries.CACHE_SCHEMA)
    path = str(tmp_path / "cache")
    summaries.append_cache(entry, path)
    done = routing.summarize_corpus(texts, path, routing.truncate_strategy()).first()
    assert (done.summary, done.cached) == ("old", True)


def test_predictions_round_trip(spark, tmp_path):
    rows = [(1, [("A", 0.9)], ["A"]), (2, [("A", 0.1)], [])]
    df = spark.createDataFrame(rows, "doc_id int, cells array<struct<label:string,p:double>>, y_pred array<string>")
    path = str(tmp_path / "preds")
    pred.save_predictions(df, path, "m", "test")
    pred.save_predictions(df, path, "m", "val")
    back = pred.load_predictions(spark, path, model="m", split="test").select(*df.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert pred.load_predictions(spark, path).count() == 4
    odd = df.withColumns({"model": F.lit("a/b=c d"), "split": F.lit("test")})
    pred.save_all(odd.limit(1), path)
    assert pred.load_predictions(spark, path, model="a/b=c d", split="test").count() == 1
    assert pred.load_predictions(spark, path).count() == 5


def test_rules(spark):
    docs = spark.createDataFrame([(["c"],), (["x", "y"],), (["m", "s"],), (["m"],)], "y_pred array<string>")
    grown = hi.expand_labels(docs, [("c", "b"), ("b", "a")], "y_pred")
    assert sorted(grown.first().y_pred) == ["a", "b", "c"]
    checked = hi.check_constraints(docs, {"m": ["s", "t"]}, [("x", "y")])
    assert [(r.violations, r.repaired) for r in checked.collect()] == [
        ([], ["c"]), (["excludes:x|y"], ["x"]), ([], ["m", "s"]), (["requires:m"], [])
    ]
    assert hi.violation_rate(checked).first().violation_rate == 0.5


def implied(spark, pairs):
    return sorted(tuple(r) for r in hi.closure(hi.relation_frame(spark, pairs)).collect())


def test_closure_ends_on_cycles_and_loops(spark):
    assert implied(spark, [("c", "b"), ("b", "a"), ("a", "c")]) == sorted((x, y) for x in "abc" for y in "abc" if x != y)
    assert implied(spark, [("a", "a"), ("a", "b"), ("a", "b"), (None, "a"), ("b", None)]) == [("a", "b")]
    assert implied(spark, []) == []


def test_closure_of_a_long_chain(spark):
    names = [f"n{i:02}" for i in range(51)]
    assert implied(spark, list(zip(names, names[1:]))) == [(x, y) for i, x in enumerate(names) for y in names[i + 1 :]]


def plainly_implied(pairs):
    above = {}
    for child, parent in pairs:
        above.setdefault(child, set()).add(parent)
    out = set()
    for child in above:
        todo, seen = [child], set()
        while todo:
            for parent in above.get(todo.pop(), ()):
                if parent not in seen:
                    seen.add(parent)
                    todo.append(parent)
        out |= {(child, parent) for parent in seen if parent != child}
    return sorted(out)


def test_closure_of_mixed_relations(spark, monkeypatch):
    monkeypatch.setattr(hi, "CELL", 3)
    monkeypatch.setattr(hi, "TASK_ROWS", 40)
    rng = np.random.default_rng(9)
    for labels, edges in ((12, 9), (30, 34), (30, 60)):
        pairs = [(f"l{a}", f"l{b}") for a, b in rng.integers(0, labels, (edges, 2)).tolist()]
        assert implied(spark, pairs) == plainly_implied(pairs)


def test_paths_that_end_at_one_label_are_dealt_over_tasks(spark):
    paths = spark.range(20_000).select(F.col("id").alias("child"), F.lit(-1).cast("bigint").alias("parent"), F.lit(False).alias("exact"))
    steps = spark.createDataFrame([(-1, -2), (-1, -3)], "child long, parent long")
    met, _ = hi._extended(paths, steps)
    shares = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 40_000 and max(shares) < 25_000
    assert met.select("child", "parent").distinct().count() == 40_000


def test_expansion_keeps_rows_nulls_and_other_columns(spark):
    docs = spark.createDataFrame([(1, ["c"], "x"), (1, ["c"], "y"), (2, [], "x"), (3, None, "x"), (4, ["z", "b"], "x")], "child int, labels array<string>, parent string")
    grown = hi.expand_labels(docs, [("c", "b"), ("b", "a")])
    assert grown.columns == docs.columns
    got = sorted((r.child, r.parent, r.labels) for r in grown.collect())
    assert got == [(1, "x", ["c", "a", "b"]), (1, "y", ["c", "a", "b"]), (2, "x", []), (3, "x", None), (4, "x", ["z", "b", "a"])]


def test_blends_counted_at_once_equal_each_weight_alone(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [l for l in LABELS if rng.random() < 0.4], [(l, *rng.random(2).round(2).tolist()) for l in LABELS[: 3 - i % 2]]) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id int, y_true array<string>, cells array<struct<label:string,p1:double,p2:double>>")
    grid, alphas = [0.25, 0.5, 0.75], [0.0, 0.3, 1.0]
    at_once = sorted(map(tuple, th.blend_counts(docs, alphas, grid).collect()))
    alone = []
    for a in alphas:
        mixed = docs.withColumn("cells", F.transform("cells", lambda c: F.struct(c["label"].alias("label"), (a * c["p1"] + (1 - F.lit(a)) * c["p2"]).alias("p"))))
        alone += [(a, *r) for r in th.sweep_counts(mixed, "p", grid).collect()]
    assert at_once == sorted(map(tuple, alone))


@pytest.mark.parametrize("floor", [0.0, 0.3, 0.5, 0.9, 1.0])
def test_cells_above_a_floor_are_those_of_all_cells(floor):
    rng = np.random.default_rng(4)
    lengths = rng.integers(0, 6, 40)
    starts, entries = np.cumsum(lengths) - lengths, lengths.sum()
    index, value = rng.integers(0, 30, entries), rng.normal(size=entries)
    matrix, offset = rng.normal(size=(30, 19)) * 2, rng.normal(size=19)
    offset[[3, 11]] = np.inf, -np.inf
    groups = np.arange(0, 19, bl.GROUP)
    model = {
        "matrix": matrix, "offset": offset, "top": np.maximum.reduceat(matrix, groups, axis=1),
        "low": np.minimum.reduceat(matrix, groups, axis=1), "top_offset": np.maximum.reduceat(offset, groups),
    }
    p = bl._sigmoid(bl._margins(starts, index, value, matrix) + offset)
    row, label, got = bl._above(starts, index, value, model, floor)
    assert list(zip(row, label)) == list(zip(*np.nonzero(p > floor)))
    assert np.allclose(got, p[row, label])


def test_products_hold_one_number_an_entry(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(bl, "ENTRIES", 20_000)
    lengths = rng.integers(0, 40, 2000)
    starts, entries = np.cumsum(lengths) - lengths, int(lengths.sum())
    index, value, weights = rng.integers(0, 50, entries), rng.normal(size=entries), rng.normal(size=(50, 64))
    dense = np.zeros((2000, 50))
    np.add.at(dense, (np.repeat(np.arange(2000), lengths), index), value)
    tracemalloc.start()
    got = bl._margins(starts, index, value, weights)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, dense @ weights)
    # The result alone is 1 MB; all labels' products of a run would be 10.
    assert peak < 4e6


def test_sparse_scores_do_not_depend_on_blocks(spark, monkeypatch):
    docs = ft.with_terms(toy_training(spark), (), (1, 1))
    vectors = ft.vectorize(docs, ft.fit_vocabulary(docs))
    width = len(vectors.first().features)
    model = bl.model_frame(spark, [(l, 0.1 * i, [0.3 * i - 0.1 * j for j in range(width)], False) for i, l in enumerate("xyz")])
    every = {r.doc_id: [tuple(c) for c in r.cells if c.p > 0.45] for r in bl.predict_proba(vectors, model).collect()}
    listed = lambda: {r.doc_id: [tuple(c) for c in r.cells] for r in bl.predict_proba(vectors, model, above=0.45).collect()}
    assert listed() == every and any(every.values()) and not all(len(c) == 3 for c in every.values())
    monkeypatch.setattr(bl, "MAX_BLOCK", 1)
    assert listed() == every
