import numpy as np
import pytest

from millrace.llm import splits
from millrace.llm.queries import QUERIES


def frames(spark, files, traces=(), links=()):
    return (
        splits.records_of(
            spark.createDataFrame(files, "file_id long, repo_name string, split_name string, lang string, component string"),
            spark.createDataFrame([], "function_id long, repo_name string, split_name string, lang string"),
            spark.createDataFrame(list(traces), "trace_id long, problem_id string, split_name string, lang string"),
        ),
        spark.createDataFrame(list(links), "from_repo string, to_repo string, relation string"),
        spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split_name string, target_share double"),
    )


def test_groups_share_a_split(spark):
    files = [(i, f"Own/R{i % 30}", "train" if i % 2 else None, "Python", "c") for i in range(300)] + [(900, None, "test", None, "c"), (901, " own/r1.git/", "test", "C++", "c"), (901, " own/r1.git/", "test", "C++", "c")]
    links = [("own/r2", "gone/x", "fork"), ("gone/x", "Own/R3", None), ("own/r4", None, "fork"), ("own/r5", "own/r5", "fork")]
    traces = [(1, "p", "train", "Python"), (2, "p", "test", "Python"), (3, None, "test", None)]
    done = splits.assign_splits(*frames(spark, files, traces, links)).toPandas()
    assert len(done) == len(files) + len(traces)
    assert (done.groupby("component")["split"].nunique() == 1).all()
    two, three = (done[(done.record_table == "repository_files") & (done.record_id == i)]["component"].iloc[0] for i in (2, 3))
    assert two == three
    mixed = done[done.mixed]
    assert set(mixed[mixed.record_table == "repository_files"].record_id) == {i for i in range(300) if i % 30 == 1} | {901}
    assert set(mixed[mixed.record_table == "raw_traces"].record_id) == {1, 2}
    share = (done.split == "train").mean()
    assert abs(share - 0.8) < 0.05


def test_nothing_and_a_single_giant(spark):
    records, links, targets = frames(spark, [])
    assert splits.assign_splits(records, links, targets).count() == 0
    records, links, targets = frames(spark, [(i, "a/b", None, None, "c") for i in range(50)])
    done = splits.assign_splits(records, links, targets).toPandas()
    assert set(done.split) == {"train"} and not done.mixed.any()
    assert splits.assign_splits(records, links, targets.limit(0)).where("split is not null").count() == 0


def test_annealing_beats_the_hashed_start():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 40, 300).astype(float)
    labels = np.stack([np.minimum(sizes, rng.integers(0, 40, 300)), np.zeros(300)], axis=1)
    wanted = np.array([0.9, 0.06, 0.04]) * sizes.sum()
    keys = [f"k{i}" for i in range(300)]
    _, start = splits.anneal(keys, sizes, labels, ["a", "b", "c"], wanted, chains=1, steps=0)
    state, cost = splits.anneal(keys, sizes, labels, ["a", "b", "c"], wanted)
    got = np.bincount(state, weights=sizes, minlength=3)
    assert cost < start / 20 and np.abs(got - wanted).max() < 0.005 * sizes.sum()


def cost_of(state, sizes, labels, wanted):
    share = wanted / wanted.sum()
    off = [np.bincount(state, weights=sizes, minlength=len(wanted)) - wanted]
    off += [np.bincount(state, weights=labels[:, j], minlength=len(wanted)) - share * labels[:, j].sum() for j in range(labels.shape[1])]
    return sum(float((o**2).sum()) for o in off) / sizes.sum() ** 2


def test_the_state_returned_has_the_cost_returned():
    for seed, n in enumerate([1, 2, 5, 63, 64, 65, 300, 1000]):
        rng = np.random.default_rng(seed)
        sizes = rng.integers(1, 200, n).astype(float)
        labels = np.stack([rng.binomial(sizes.astype(int), 0.3), rng.binomial(sizes.astype(int), 0.1), np.zeros(n)], axis=1).astype(float)
        wanted = np.array([0.9, 0.06, 0.04]) * sizes.sum()
        keys = [f"k{i}" for i in range(n)]
        state, cost = splits.anneal(keys, sizes, labels, ["a", "b", "c"], wanted, seed=seed)
        assert abs(cost - cost_of(np.array(state), sizes, labels, wanted)) < 1e-9
        assert cost <= splits.anneal(keys, sizes, labels, ["a", "b", "c"], wanted, seed=seed, steps=0)[1] + 1e-12


def test_labels_are_balanced_one_by_one(spark):
    files = [(i, f"o/r{i % 400}", None, ["Python", "C", "English", "Java"][i % 400 % 4], "c") for i in range(4000)]
    done = splits.assign_splits(*frames(spark, files)).toPandas()
    shares = (done.split == "train").groupby(done.label).mean()
    assert set(shares.index) == {"Python", "C", "English", "Java"} and (shares - 0.8).abs().max() <= 0.011
    many = [(i, f"o/r{i}", None, f"label {i}", "c") for i in range(splits.LABELS + 1)]
    with pytest.raises(ValueError):
        splits.assign_splits(*frames(spark, many))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_shares_of_the_tables(spark, sf):
    shares = QUERIES["p3_shares"](spark, f"/root/testdata/{sf}").toPandas()
    assert len(shares) == 3 and (shares["share"] - shares["target_share"]).abs().max() < 0.002


def test_few_heavy_components_are_no_other_case(spark):
    # nearly all records in 12 components, the rest in many small ones, and the other way round
    for heavy, light, off in ((300, 30, 0.027), (20, 3000, 0.005)):  # ten of the twelve are as near as can be
        files = [(h * 1000 + i, f"h/{h}", None, "Python", "c") for h in range(12) for i in range(heavy)] + [(50_000 + i, f"l/{i}", None, "Python", "c") for i in range(light)]
        share = (splits.assign_splits(*frames(spark, files)).toPandas().split == "train").mean()
        assert abs(share - 0.8) < off
