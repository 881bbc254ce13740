"""Hand-made rows, invariants, and closed forms against naive versions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.functions import text
from siftline.operators import clusters, compress, diversity, feedback, sampling
from siftline.plans import config
from siftline.sources import readers, sinks


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_formats():
    assert [readers.detect_format(p) for p in ("hf://a:b", "a/b", "./x.jsonl", "/x/y.json", "z.parquet", "q.csv", "q")] == ["hub", "hub", "jsonl", "json", "parquet", "csv", "jsonl"]
    assert readers.parse_hub_path("hf://n:s:t") == ("n", "s", "t")
    assert readers.parse_hub_path("n") == ("n", None, None)
    assert readers.detect_fields(["Question", "context", "prompt", "answer"]) == {"instruction": "Question", "input": "context", "output": "answer"}


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"instruction": "x", "output": "😀é"}\n\nnot json\n{"instruction": null, "output": "y"}\n')
    got = readers.standard(readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "instruction string, output string"))
    assert sorted((r.instruction, r.input, r.output) for r in got.collect()) == [("", "", "y"), ("x", "", "😀é")]
    assert readers.count_jsonl(spark, str(tmp_path / "a.jsonl")) == 3
    (tmp_path / "b.json").write_text('{"samples": [{"q": 1}, {"q": 2}]}')
    assert sorted(r.q for r in readers.read_json(spark, str(tmp_path / "b.json")).collect()) == [1, 2]
    np.save(tmp_path / "v.npy", np.eye(3, dtype=np.float32))
    assert [list(r.embedding) for r in readers.read_npy(spark, str(tmp_path / "v.npy")).orderBy("pos").collect()] == np.eye(3).tolist()
    assert readers.within_length(spark.createDataFrame([("a" * 9,), ("a" * 10,), ("a" * 12,), ("a" * 13,)], "t string"), 10, 12, ("t",)).count() == 2


def test_messages(spark):
    kind = "messages array<struct<role:string,content:string>>"
    df = spark.createDataFrame([([("user", "a"), ("assistant", "b"), ("user", "c")],), ([],), ([("user", None)],)], kind)
    assert sorted((r.instruction, r.output) for r in readers.standard(df).collect()) == [("", ""), ("", ""), ("c", "b")]


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, embedding array<float>")
    sinks.append_embeddings(spark, a, str(tmp_path / "e"))
    sinks.append_embeddings(spark, a.union(spark.createDataFrame([(3, [3.0])], a.schema)), str(tmp_path / "e"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "e")).collect()) == [1, 2, 3]
    for k in (1, 2):
        sinks.save_round(a.withColumn("round", F.lit(k)), str(tmp_path / "s"), k)
    assert {r["round"] for r in sinks.load_round(spark, str(tmp_path / "s")).collect()} == {2}
    assert sinks.unknown_keys(a, spark.createDataFrame([(9,)], "id long"), "id").count() == 1


@pytest.mark.parametrize(("answer", "want"), [("so #### 1,234", "1234"), (r"\boxed{42}", "42"), ("The answer is: 7.0", "7"), ("x = 5", "5"), ("from 3 to 9", "9"), ("none", None), ("#### inf", None)])
def test_math_answer(spark, answer, want):
    df = spark.createDataFrame([(answer,)], "t string")
    assert df.select(text.normalised_answer(text.math_answer(F.col("t")))).first()[0] == want


def test_tolerance(spark):
    df = spark.createDataFrame([("1.0", "1.0005"), ("1.0", "1.01"), ("a", "a"), (None, "1")], "a string, b string")
    assert [r[0] for r in df.select(text.answers_agree(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 25), st.integers(1, 10), st.booleans())
def test_farthest_points(n, m, cosine):
    x = np.random.default_rng(n * 31 + m).normal(size=(n, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = compress.farthest_points(x, m, cosine)
    assert len(set(got.tolist())) == len(got) == min(n, m)
    assert got[0] == 0
    cost = 1 - x @ x.T if cosine else ((x[:, None] - x[None]) ** 2).sum(-1)
    if n > m:
        steps = [cost[got[k], got[:k]].min() for k in range(1, len(got))]
        assert all(a >= b - 1e-9 for a, b in zip(steps, steps[1:], strict=False))
    assert compress.farthest_points(np.ones((6, 2)), 3, cosine).tolist() == [0, 1, 2]


def test_density_labels():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.05, (40, 2)), rng.normal(3, 0.05, (40, 2)), rng.uniform(-20, 20, (6, 2))])
    labels = clusters.density_labels(x, 15, 5)
    assert len(set(labels[:40])) == len(set(labels[40:80])) == 1
    assert labels[0] != labels[40]
    assert labels[0] >= 0 and labels[40] >= 0


def test_density_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(0, 4, (30, 2)), rng.integers(0, 4, (30, 2)) + 20, np.full((12, 2), 50), rng.integers(-90, 90, (8, 2))]).astype(float)  # with copies and many equal distances
    x = x[rng.permutation(len(x))]
    want = clusters.density_labels(x, 5, 3)
    assert len(set(want)) == 4 and want.min() == -1
    assert all((clusters.density_labels(x, 5, 3, block=b) == want).all() for b in (1, 7, 33))
    for _ in range(5):  # the order of rows is nothing but the numbers of the clusters
        p = rng.permutation(len(x))
        pairs = set(zip(want[p].tolist(), clusters.density_labels(x[p], 5, 3, block=16).tolist(), strict=True))
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) and (-1, -1) in pairs
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, v array<double>")
    for _ in range(2):  # blocks are sent to all tasks, then joined
        got = clusters.density_cluster(df.repartition(3), 5, 3, block=33).orderBy("id").collect()
        assert [r.cluster for r in got] == want.tolist() and [r.v for r in got] == x.tolist()
        monkeypatch.setattr(clusters, "MODEL_BYTES", 0)
    assert [r.cluster for r in clusters.density_cluster(df.limit(1), 5, 3).collect()] == [-1] and clusters.density_cluster(df.limit(0), 5, 3).count() == 0


def test_spanning_edges_of_blocks():
    x = np.random.default_rng(6).normal(size=(60, 3))
    square = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(square, axis=1)[:, 4]
    reach = np.maximum(square, np.maximum(core[:, None], core[None]))

    def total(edges):
        group, out = list(range(len(x))), 0.0
        for w, a, b in sorted(edges):
            if group[a] != group[b]:
                out, group = out + w, [group[a] if g == group[b] else g for g in group]
        assert len(set(group)) == 1
        return out

    blocks = [clusters._block_edges(i, j, x[i : i + 25], x[j : j + 25], core[i : i + 25], core[j : j + 25]) for i in range(0, 60, 25) for j in range(i, 60, 25)]
    found = [e for a, b, w in blocks for e in zip(w.tolist(), a.tolist(), b.tolist(), strict=True)]
    assert total(found) == pytest.approx(total([(reach[a, b], a, b) for a in range(60) for b in range(a)]))


def test_nearest_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(20)], "id long, v array<double>")
    c = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(7)], "cluster int, centroid array<double>")
    at_once = sorted((r.id, r.cluster) for r in clusters.nearest(v, c).collect())
    monkeypatch.setattr(clusters, "MODEL_BYTES", 0)
    monkeypatch.setattr(clusters, "BLOCK", 2)
    assert sorted((r.id, r.cluster) for r in clusters.nearest(v, c).collect()) == at_once


def test_history_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, 0, rng.normal(size=3).tolist()) for i in range(12)], "id long, cluster int, v array<double>")
    h = v.filter("id < 5").select("v")
    at_once = sorted((r.id, round(r.nearest, 9)) for r in sampling.history_distance(v, h).collect())
    monkeypatch.setattr(sampling, "HISTORY_BLOCK", 2)
    assert sorted((r.id, round(r.nearest, 9)) for r in sampling.history_distance(v, h).collect()) == at_once
    assert {r.novelty for r in sampling.novelty(v, h.limit(0)).collect()} == {1.0}


def test_diversity(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(9, 3))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [1 - u[i] @ u[j] for i in range(9) for j in range(i)]
    assert abs(diversity.average_pairwise(v).first()["diversity"] - np.mean(pairs)) < 1e-9
    assert diversity.average_pairwise(v.limit(1)).first()["diversity"] == 0.0
    assert abs(diversity.log_determinant(v) - np.linalg.slogdet(u @ u.T + 1e-6 * np.eye(9))[1] / 9) < 1e-6


def test_priority(spark):
    assert abs(spark.range(1).select(sampling.priority(F.lit(0.8), F.lit(0.2), F.lit(0.5))).first()[0] - 0.475) < 1e-12


@pytest.mark.parametrize("seed", range(4))
def test_budget(spark, seed):
    rng = np.random.default_rng(seed)
    k, total = int(rng.integers(1, 12)), int(rng.integers(60, 300))
    data = [(i, float(rng.uniform()), int(rng.integers(0, 80))) for i in range(k)]
    got = {r.cluster: r.alloc for r in sampling.allocate(spark.createDataFrame(data, "cluster int, weight double, capacity long"), total).collect()}
    most = int(3.0 * total / k)
    assert len(got) == k and sum(got.values()) <= max(total, 5 * k)
    assert all(got[i] <= min(cap, max(most, max(5, int(total * 0.2 / k)))) for i, _, cap in data)
    room = sum(max(0, min(cap, most) - got[i]) for i, _, cap in data)
    assert sum(got.values()) >= total or room == 0


def test_mixed_selection_counts(spark):
    c = spark.createDataFrame([(i % 3, i, i * 7 % 10 / 10, i * 3 % 10 / 10) for i in range(60)], "cluster int, id long, priority double, rarity double")
    b = spark.createDataFrame([(0, 1), (1, 10), (2, 50)], "cluster int, n long")
    got = sampling.mixed_selection(c, b).groupBy("cluster").count().collect()
    assert {r["cluster"]: r["count"] for r in got} == {0: 1, 1: 10, 2: 20}


def test_posterior_and_retirement(spark):
    e = spark.createDataFrame([(1, 0, 0.2), (2, 0, 0.7)], "id long, round int, error double")
    s = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, cluster int")
    p = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.0, 1.0)], "cluster int, alpha double, beta double")
    got = {r.cluster: (round(r.alpha, 9), round(r.beta, 9)) for r in feedback.updated_posteriors(p, feedback.cluster_errors(e, s)).collect()}
    assert got == {0: (1.9, 2.1), 1: (1.0, 1.0)}
    f = spark.createDataFrame([(1, k, x) for k, x in enumerate([0.05, 0.05, 0.1, 0.0, 0.0, 0.0, 0.5])], "id long, round int, error double")
    r = feedback.retirement(f).orderBy("round").collect()
    assert [x.streak for x in r] == [1, 2, 0, 1, 2, 3, 0]
    assert [x.retired for x in r] == [False] * 5 + [True] * 2
    assert not any(x.retired for x in feedback.retirement(f, 0.0).collect())


def test_difficulty_closed_form(spark):
    errors = [0.1, 0.9, 0.4]
    f = spark.createDataFrame([(1, k, x) for k, x in enumerate(errors)], "id long, round int, error double")
    want = 0.5
    for x in errors:
        want = 0.7 * want + 0.3 * x
    assert abs(feedback.difficulties(f).first()["difficulty"] - want) < 1e-12


def test_code_is_off_by_default(spark):
    t = spark.createDataFrame([(1, "def f(x):\n    return x + 1", None, "f(2)", "3"), (1, "x = (", None, "x", "1")], "id long, code string, input string, call string, expected string")
    with pytest.raises(PermissionError):
        feedback.run_tests(t)
    assert feedback.test_errors(feedback.run_tests(t, allow_code=True)).first()["error"] == 0.5


def test_config(tmp_path):
    c = config.preset("small", {"budget": {"total": 7}}, ["thompson.ratio=0.5", "data.fields.output=a,b", "x=null"])
    assert c["budget"] == {"total": 7, "base_ratio": 0.3, "max_ratio": 1.5, "adaptive": False}
    assert c["thompson"]["ratio"] == 0.5 and c["data"]["fields"]["output"] == ["a", "b"] and c["x"] is None
    assert abs(sum(config.preset("mmlu_bbh")["prior"].values()) - 1) < 1e-9
    with pytest.raises(ValueError):
        config.preset("none")


def test_evaluators(spark):
    from siftline.operators.evaluators import EVALUATORS

    df = spark.createDataFrame([(1, 0, "The answer is: 4", "#### 4", 1.0), (2, 0, "5", "6", 1.0)], "id long, batch int, prediction string, reference string, loss double")
    assert [r.error for r in EVALUATORS["math_exact_match"](df).orderBy("id").collect()] == [0.0, 1.0]
    assert {r.error for r in EVALUATORS["loss"](df).collect()} == {0.5}
    assert [r.error for r in EVALUATORS["containment"](df).orderBy("id").collect()] == [1.0, 1.0]
    with pytest.raises(ValueError):
        EVALUATORS["loss"](df.drop("loss"))


def test_command_line(spark, tmp_path):
    from siftline.__main__ import main

    main(["sample-data", "--folder", str(tmp_path / "samples.jsonl")])
    small = ["--folder", str(tmp_path / "state"), "--preset", "small", "--set", "clustering.algorithm=kmeans", "clustering.k=4", "budget.total=30", "embedding.dim=16", "embedding.pca_dim=null", "data.min_length=1"]
    main(["offline", "--input", str(tmp_path / "samples.jsonl"), *small])
    main(["train", "--rounds", "2", *small])
    rounds = spark.read.parquet(str(tmp_path / "state" / "rounds"))
    assert rounds.count() == 2
    again = sinks.load_round(spark, str(tmp_path / "state" / "state"))
    assert again.filter("times_selected > 0").count() > 0
    table = spark.read.parquet(str(tmp_path / "state" / "clusters"))
    sinks.save_clusters(table, str(tmp_path / "c"))
    assert sinks.load_clusters(spark, str(tmp_path / "c")).filter("centroid is null").count() == 0


def test_last_wins_and_heads(spark):
    df = spark.createDataFrame([(1, "a", 3, None), (1, "b", 9, "x"), (2, "c", 1, None), (None, "d", 4, "y"), (None, "e", 2, "z")], "id long, t string, at long, _key string")
    assert sorted((r.id, r.t) for r in readers.last_wins(df.filter("id is not null"), "id", "at").collect()) == [(1, "b"), (2, "c")]
    assert [r.t for r in readers.last_wins(df.filter("id is null"), "id", "at").collect()] == ["d"]
    got = readers.heads({"one": df, "two": df.filter("at > 2")}, 2, "at").collect()
    assert sorted((r["_config"], r.t) for r in got) == [("one", "c"), ("one", "e"), ("two", "a"), ("two", "d")]


def test_positions_and_zip(spark):
    left = spark.range(1000).selectExpr("(id * 37) % 1000 AS k", "id AS a").repartition(7)
    got = readers.with_position(left, "k").collect()
    assert len(got) == 1000 and all(r.pos == r.k for r in got)
    right = spark.range(10).selectExpr("id * 5 AS k", "id AS b")
    assert sorted((r.pos, r.k, r.b) for r in readers.zipped(left, right, "k").collect()) == [(p, p, p) for p in range(10)]


def test_bounded_history(spark):
    rows = spark.range(12).withColumnRenamed("id", "round")
    assert sinks.bounded_history(rows, "round", 12, 5).count() == 12
    assert sorted(r.round for r in sinks.bounded_history(rows, "round", 11, 5).collect()) == [7, 8, 9, 10, 11]


def test_reduction_is_kept(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (60, 2)) @ rng.normal(0, 1, (2, 6)) + 3 + rng.normal(0, 1e-6, (60, 6))
    df = spark.createDataFrame([(k, [float(y) for y in r]) for k, r in enumerate(x)], "id long, v array<double>")
    model = clusters.Reduction.fit(df, variance=0.99)
    assert len(model.components) == 2 and sum(model.share) > 0.99
    centred = x - x.mean(axis=0)
    got = np.array([r.v for r in model.transform(df).orderBy("id").collect()])
    assert np.allclose(got @ got.T, centred @ centred.T, atol=1e-3)  # all that matters is in two components
    model.save(spark, str(tmp_path / "m"))
    again = clusters.Reduction.load(spark, str(tmp_path / "m"))
    new = spark.createDataFrame([(99, [float(y) for y in x[0]])], "id long, v array<double>")
    assert np.allclose(again.transform(new).first().v, got[0])
    assert len(clusters.Reduction.fit(df, 4).components) == 4


def test_large_scale_keeps_pilot_labels_and_noise(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal((10, 0), 0.1, (60, 2)), rng.normal((0, 10), 0.1, (60, 2)), [[100.0, 100.0], [-100.0, 50.0]]])
    df = spark.createDataFrame([(k, [float(y) for y in r]) for k, r in enumerate(x)], "id long, v array<double>")
    got = {r.id: r.cluster for r in clusters.large_scale_cluster(df, None, 10, 5).collect()}
    assert len(got) == 122 and got[120] == got[121] == -1 and len({got[k] for k in range(60)}) == len({got[k] for k in range(60, 120)}) == 1
    part = {r.id: r.cluster for r in clusters.large_scale_cluster(df, 80, 10, 5).collect()}
    assert len(part) == 122 and len({part[k] for k in range(60)} - {-1}) == 1
    assert sorted(r.id for r in clusters.pilot(df, 5).collect()) == sorted(r.id for r in clusters.pilot(df.repartition(3), 5).collect())


def test_feedback_with_repeated_ids_and_running_state(spark, tmp_path):
    from siftline.plans.config import preset
    from siftline.plans.pipeline import SelectionPipeline

    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(k, [float(y) for y in rng.normal(3 * (k % 2), 1, 6)]) for k in range(40)], "id long, v array<double>")
    samples = df.selectExpr("id", "cast(id as string) AS instruction", "'' AS input", "'' AS output")
    config = preset("small", {"clustering": {"algorithm": "kmeans", "k": 2}, "embedding": {"pca_dim": None, "pca_variance": 0.9}, "compression": {"metric": "euclidean", "max_representatives": 10}, "budget": {"total": 8}})
    p = SelectionPipeline(spark, str(tmp_path / "p"), config)
    p.run_offline(samples=samples, vectors=df)
    picked = p.run_online_round(1).select("id")
    errors = picked.selectExpr("id", "0.2D AS error").union(picked.selectExpr("id", "0.6D AS error"))
    before = p._snapshot("posteriors")[0].selectExpr("sum(alpha + beta)").first()[0]
    p.update_feedback(1, errors)
    state = p._snapshot("state")[0].collect()
    assert len(state) == 40 and all(abs(r.last_error_intensity - 0.4) < 1e-9 for r in state if r.times_selected)
    after = p._snapshot("posteriors")[0].selectExpr("sum(alpha + beta)").first()[0]
    assert abs(after - before - errors.count()) < 1e-6
    assert len(p.reduced(df).first().v) == len(p._read("vectors").first().v) < 6
    p.update_losses(2, p.run_online_round(2).selectExpr("id", "cast(id AS double) AS loss"))
    first = p._read("running").filter("round = 2").first()
    again = SelectionPipeline(spark, str(tmp_path / "p"), config)  # the state is read from the folder
    third = again.run_online_round(3).selectExpr("id", "cast(id AS double) + 5 AS loss").persist()
    again.update_losses(3, third)
    last, (mean, var) = again._read("running").filter("round = 3").first(), third.selectExpr("avg(loss)", "var_pop(loss)").first()
    assert abs(last["mean"] - (0.99 * first["mean"] + 0.01 * mean)) < 1e-9 and abs(last["var"] - (0.99 * first["var"] + 0.01 * var)) < 1e-9


def test_configuration_files_and_tasks(tmp_path):
    (tmp_path / "own.py").write_text("def get_own_config(total=7):\n    return {'budget': {'total': total}, 'seed': 3}\n")
    (tmp_path / "base.yaml").write_text("budget: {total: 9, base_ratio: 0.5}\n")
    (tmp_path / "top.yaml").write_text("_base_: base.yaml\nbudget: {total: 10}\n")
    got = config.load(str(tmp_path / "own.py"), total=8, settings=["seed=5"])
    assert (got["budget"]["total"], got["seed"], got["budget"]["base_ratio"]) == (8, 5, config.DEFAULTS["budget"]["base_ratio"])
    assert config.load(str(tmp_path / "top.yaml"), {"seed": 1})["budget"] == config.DEFAULTS["budget"] | {"total": 10, "base_ratio": 0.5}
    assert config.for_task("math", "x.jsonl", 5)["budget"]["total"] == 5 and config.for_task("bbh", "x.jsonl")["data"]["path"] == "x.jsonl"
    for wrong in (lambda: config.load("x.txt"), lambda: config.for_task("none", "x"), lambda: config.load_python(str(tmp_path / "own.py"), "get_config")):
        with pytest.raises((ValueError, AttributeError)):
            wrong()


def test_code_that_only_has_to_run(spark):
    t = spark.createDataFrame([(1, "x = 1", None, None, None), (2, "raise ValueError", None, None, None)], "id long, code string, input string, call string, expected string")
    assert sorted(rows(feedback.test_errors(feedback.run_tests(t, allow_code=True)))) == [(1, 0.0), (2, 1.0)]
