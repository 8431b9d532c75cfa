import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.catalog import table
from millrace.llm import quality

ALPHABET = "ab.!?…| \t\n-*1’»X中é\u0301\u093fक\u00a0"


def pieces_of(text, size):
    return [quality.partial(text[i : i + size]) for i in range(0, max(1, len(text)), size)]


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=60), st.integers(1, 20))
def test_chunks_merge_to_the_whole(text, size):
    assert quality.finish(quality.merged(pieces_of(text, size))) == quality.whole(text)


def test_long_chunks_merge_in_any_order():
    rng = random.Random(9)
    for _ in range(400):
        weights = [rng.random() ** 4 for _ in ALPHABET]
        text = "".join(rng.choices(ALPHABET, weights, k=rng.randint(100, 1200)))
        states = pieces_of(text, rng.choice([7, 60, 98, 99, 150, 400]))
        while len(states) > 1:
            at = rng.randrange(len(states) - 1)
            states[at : at + 2] = [quality.merge(*states[at : at + 2])]
        assert quality.finish(states[0]) == quality.whole(text)


def test_the_state_stays_small():
    for text in ("x" * 100_000, " " * 100_000, "!" * 100_000, "A" * 100_000, "a b\t" * 30_000):
        state = quality.merged(pieces_of(text, 1000))
        assert len(json.dumps(state)) < 2000 and quality.finish(state) == quality.whole(text)


def test_verdicts(spark):
    prose = "The old man went to the market, and he bought some bread for us. It was not what we had asked for! Was it late?"
    texts = [prose, "Title\n\n" + prose * 3 + "\n- one\n- two", "\n".join(f"- item {k}" for k in range(30)), "\n".join(f"{k} | {k * 3} | {k * 7}" for k in range(30)), "the and of house tree " * 50, "", None, " \n", prose * 3000]
    frame = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, prose boolean")
    got = {r.doc_id: r.prose for r in quality.statistics(quality.text_counts(frame, chunk=5000)).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 5: None, 7: None, 8: True}


PROSE = {
    "Polish": "Stary człowiek poszedł na targ i kupił dla nas chleb. Nie było to to, o co prosiliśmy! Czy było już późno?",
    "Finnish": "Vanha mies meni torille ja osti meille leipää. Se ei ollut sitä, mitä olimme pyytäneet. Oliko jo myöhä?",
    "Russian": "Старик пошёл на рынок и купил нам хлеба. Это было не то, о чём мы просили! Было ли уже поздно?",
    "Japanese": "その老人は市場へ行き、私たちのためにパンを買ってくれた。それは頼んだものではなかった。もう遅かったのだろうか。",
    "Chinese": "老人去市场给我们买了面包。这不是我们要的东西！已经很晚了吗？",
    "Thai": "ชายชราไปตลาดและซื้อขนมปังให้พวกเรา มันไม่ใช่สิ่งที่เราขอ",
    "Hindi": "बूढ़ा आदमी बाज़ार गया और हमारे लिए रोटी लाया। यह वह नहीं था जो हमने माँगा था।",
    "Arabic": "ذهب الرجل العجوز إلى السوق واشترى لنا بعض الخبز. هل كان الوقت متأخرا؟",
    "dialogue": '"Where are you going?" she asked.\n"To the market."\n"Now?"\n"Yes, now."\n"Then I will come with you," she said.',
    "short dialogue": "“Are you ready?”\n“Yes.”\n“Then let us go.”\n“Where?”\n“Home.”",
    "dialogue with dashes": "— Where are you?\n— Here.\n— Come!\n— Why?\n— It is late.",
    "one long sentence": "When the old man, who had walked since the morning, " + "and had seen the river and the hills, " * 5 + "came home, he slept.",
    "short": "It rained.",
}
NO_PROSE = {
    "letters alone": " ".join("the old man went to the market and bought some bread. it was late. "),
    "list of short phrases": "".join(f"- quick sketch {k}.\n" for k in range(20)),
    "marked table": "+-----+\n" + "! 2112 ! 1112 ! bell\n" * 20,
    "Russian words": "рынок хлеб старик дом река " * 20,
    "Japanese words": "市場\nパン\n老人\n" * 20,
    "symbols": "@PRISM!!! %BASKET!!! &LATCH### $MAP>> " * 20,
}


def test_verdicts_know_no_language(spark):
    texts = PROSE | NO_PROSE
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id long, text string")
    got = {r.doc_id: r.prose for r in quality.statistics(quality.text_counts(frame)).collect()}
    assert {name: got[i] for i, name in enumerate(texts)} == {name: name in PROSE for name in texts}


def test_huge_texts_take_the_tree(spark):
    rng = random.Random(5)
    text = "".join(rng.choice(ALPHABET) for _ in range(30_000))
    frame = spark.createDataFrame([(1, text), (1, text), (1, text[:9000]), (None, text), (2, "x" * 20_000)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), *[r[c] for c in quality.COUNTS]) for r in quality.text_counts(frame, chunk=100).collect())
    whole = lambda t: tuple(quality.whole(quality.tidy(t)))
    assert got == sorted([(1, *whole(text)), (1, *whole(text)), (1, *whole(text[:9000])), (0, *whole(text)), (2, *whole("x" * 20_000))])
    assert quality.text_counts(frame.limit(0)).count() == 0


def test_labels_agree(spark):
    folder = "/root/testdata/sf0.01"
    stats = quality.statistics(quality.text_counts(table(spark, folder, "documents").where("category = 'text'")))
    joined = stats.join(table(spark, folder, "labels"), "doc_id").collect()
    right = sum((r.quality == "prose") == r.prose for r in joined)
    assert joined and right >= 0.98 * len(joined)
