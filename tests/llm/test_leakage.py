import random

import pyarrow.parquet as pq

from millrace.llm import leakage

STATEMENT = "Vebrozan of Kudruden keeps 1358 skipefons beside the sudden value, slowly guarded by large result. Given parallel axle, nidrugrer and 43 dial skipefons, fold vivid jar."
OTHER = "Lefegrath of Skohigux keeps 5440 roskutis beside the klamihul, quietly guarded by benateth. Given benateth, regular wagon and 48 shard roskutis, refine lefegrath now."
LEAD = "Read the task below with care and answer with one complete function that passes every hidden check. Task:\n"
ITEMS = [(i, "b", LEAD + t) for i, t in enumerate([STATEMENT, OTHER] + [f"Unrelated number {k} text {k} of item {k} alone {k}" for k in range(100)])]


def found(text, items=None):
    return sorted(p[0] for p in (items or leakage.Items(ITEMS)).passages(text))


def test_passages():
    items = leakage.Items(ITEMS)
    assert found("before " + STATEMENT + " after", items) == [0]
    assert found("# " + STATEMENT.upper().replace(" ", "\n# "), items) == [0]
    assert found("<b>" + STATEMENT.replace(" ", "</b>&nbsp;<i>") + "</i>", items) == [0]
    assert found(STATEMENT.replace("skipefons", "skipe-\nfons").replace("guarded", "gu­arded"), items) == [0]
    assert found(" ".join(STATEMENT.split()[5:19]), items) == [0]
    assert found(STATEMENT + OTHER, items) == [0, 1]
    changed = STATEMENT.split()
    changed[7], changed[15] = "house", "tree"
    assert found(" ".join(changed), items) == [0]


def test_no_passages():
    items = leakage.Items(ITEMS)
    assert found(LEAD, items) == [] and found("", items) == []
    assert found(" ".join(STATEMENT.split()[3:9]) + " and so on " + " ".join(OTHER.split()[3:9]), items) == []
    assert found(" ".join(reversed(STATEMENT.split())), items) == []
    shuffled = STATEMENT.split()
    shuffled = shuffled[1::2] + shuffled[::2]
    assert found(" ".join(shuffled), items) == []
    assert leakage.Items([]).passages("x") == [] and leakage.Items([(1, "b", "")]).passages("x") == []


def test_order_counts_and_changed_words_do_not():
    rows = pq.read_table("/root/testdata/sf0.001/benchmark.parquet").to_pylist()
    items = leakage.Items(sorted((r["item_id"], r["benchmark_name"] or "", r["text"]) for r in rows))
    shuffled = changed = pieces = 0
    for seed in range(2):
        for r in rows:
            rng = random.Random(seed * 1000 + r["item_id"])
            words = r["text"].split()
            half = words[len(words) // 2 :]
            rng.shuffle(half)
            shuffled += r["item_id"] in found(" ".join(half), items)
            other = [rng.choice(["house", "tree", "of", "notwithstanding"]) if i % 4 == seed else w for i, w in enumerate(words)]
            changed += r["item_id"] in found(" ".join(other), items)
            piece = words[len(words) // 2 :][:12]
            piece[5] = "house"
            pieces += r["item_id"] in found("so " + " ".join(piece) + " so", items)
    assert (shuffled, changed, pieces) == (0, 2 * len(rows), 2 * len(rows))


def test_operator_maps_offsets(spark):
    text = "é“x” ﬁ " + STATEMENT.replace("value", "ｖａｌｕｅ") + " end"
    docs = spark.createDataFrame([(1001, text, 1), (1002, None, 1), (1003, "", 1), (1001, text, 1), (1004, STATEMENT + "y" * 200_000, 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, n, t, "task") for i, n, t in ITEMS] + [(500, None, None, None)], "item_id long, benchmark_name string, text string, task string")
    got = leakage.leaks(docs, bench).collect()
    assert sorted((r.item_id, r.doc_id) for r in got) == [(0, 1001), (0, 1001), (0, 1004)]
    first = next(r for r in got if r.doc_id == 1001)
    assert first.passage == text[first.start : first.end] and first.passage.startswith("Vebrozan") and first.passage.endswith("vivid jar")
    assert {r.item_id: r.documents for r in leakage.leaked_items(leakage.leaks(docs, bench), bench).collect()}[0] == 3
    assert leakage.leaks(docs.limit(0), bench).count() == 0 and leakage.leaks(docs, bench.limit(0)).count() == 0
