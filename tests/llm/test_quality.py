import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from stallwise.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
        len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )


def judged(spark, texts):
    rows = [(i, t, "KEPT?", 1) for i, t in enumerate(texts)]
    out = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string, t_ int"))
    assert {"doc_id", "text", "source", "t_"} < set(out.columns)
    return {x["doc_id"]: x for x in out.collect()}


def base(x):
    return (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"])


PROSE = "\n".join(" ".join(f"word{i}x{k}" for k in range(11)) + " end." for i in range(8))


def test_defined_cases(spark):
    texts = [None, "", " \n\t\x0b", "a", "a b c a b c", "x\nx\n\nx", PROSE, "é" * 5 + " 😀 #", "w " * 30_000]
    out = judged(spark, texts)
    for i, t in enumerate(texts):
        assert base(out[i]) == brute(t), t
    assert out[0]["clean_text"] is None and out[1]["clean_text"] == ""
    assert out[6]["kept"] and out[6]["clean_text"] == PROSE
    assert not any(out[i]["kept"] for i in range(6))


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines_go_and_documents_that_lose_too_much(spark):
    menu = "home | news | sport | weather | about | contact | more of everything we have."
    shout = "THIS IS ALL IN CAPITALS AND GOES ON AND ON FOR ELEVEN WORDS!"
    junk = "these%%% words### carry&&& symbols*** in%%% every### single&&& one*** of%%% them."
    wall = "Please accept cookies to go on reading our pages, thank you."
    for bad in (menu, shout, junk, wall, "no end of sentence"):
        x = judged(spark, [PROSE + "\n" + bad, PROSE + "\n" + "\n".join([bad] * 60)])
        assert x[0]["kept"] and x[0]["clean_text"] == PROSE, bad
        assert not x[1]["kept"], bad


def test_clean_prose_is_left_alone(spark):
    prose = [
        "They made a new design in wood for the small houses of the village.", "The catalog in the hall had been spread more widely than they thought.",
        "You should read more books, she said, and sign in with your own name if you can.", "A.",
        "Der Ort lag still da, »wie im Traum«, sagte sie, und »ganz ohne Wind«, wie »immer« im Herbst.", "Die Kinder wollten im Garten bleiben, bis es dunkel wurde.",
        "Il disait « oui » puis « non » puis « peut-être » sans jamais se décider vraiment.", "La maison était grande et le jardin donnait sur la rivière.",
        "La col·lecció, l'il·lusió i la col·laboració eren paraules que els agradaven molt.", "El jardín era grande y la casa miraba hacia el río.",
        "  one two\tthree four five six seven eight nine ten eleven", "USA (1999).",
    ]
    bad = [" " * 10 + "Home", "Home\t|\tNews | Sport | Weather today and in all of the coming days of the week.", "Sign in.", "Read more!", "Tous droits réservés.", "NOW OPEN!"]
    out = judged(spark, ["\n".join([*prose, PROSE])] + [f"{PROSE}\n{x}" for x in bad])
    assert out[0]["clean_text"] == "\n".join([*prose, PROSE])
    assert [out[i + 1]["clean_text"] for i in range(len(bad))] == [PROSE] * len(bad)


def test_random_texts(spark):
    texts = []

    @settings(max_examples=120, database=None, derandomize=True)
    @given(st.text(alphabet="ab \n\t#|é\r\x1f", max_size=60))
    def collect(t):
        texts.append(t)

    collect()
    out = judged(spark, texts)
    assert [base(out[i]) for i in range(len(texts))] == [brute(t) for t in texts]


def test_accepted_rows(spark):
    docs = spark.createDataFrame([(0, None), (1, PROSE), (2, "short"), (1, PROSE)], "doc_id long, text string")
    assert [(x["doc_id"], x["clean_text"]) for x in quality.accepted(docs).collect()] == [(1, PROSE)] * 2


CLEAN = [
    "The privacy policy of the king was a subject of debate among historians.", "The use of cookies in baking goes back to Persia, they say.", "He wished to leave a comment on the matter.",
    "今天天气很好。", "他们昨天去了北京，在那里住了三天，然后回到家里看望父母和孩子们", "彼は言った「行きましょう」", "كيف حالك اليوم؟", "यह एक अच्छा दिन है।", "Նա եկավ տուն։",
]
RECIPE = "Apple cake\n\nA cake for the cold days of the year.\nIngredients\n\n- two eggs and a cup of flour\n- salt\n- three sour apples from the garden\n\nMethod\n1. Mix the eggs with the flour and salt\n2) Bake\nServe it warm.\nNotes\nIt keeps for days."


def test_clean_lines_recipes_and_lists_stay(spark):
    out = judged(spark, [f"{x}\n{PROSE}" for x in CLEAN] + [f"{RECIPE}\n{PROSE}"])
    assert [out[i]["clean_text"] for i in range(len(CLEAN))] == [f"{x}\n{PROSE}" for x in CLEAN]
    assert out[len(CLEAN)]["clean_text"] == f"{RECIPE}\n{PROSE}"


def test_menus_and_loose_lines_go(spark):
    bad = ["Home\nNews\nAbout us", "- Home\n- News\n- About us", "Privacy policy\nTerms of use", "All rights reserved by the makers of this page and their friends.", "- one item of no list", "今日 新闻"]
    out = judged(spark, [f"{PROSE}\n{x}" for x in bad] + [f"{x}\n\n{PROSE}" for x in bad[:2]])
    assert [out[i]["clean_text"] for i in range(len(bad))] == [PROSE] * len(bad)
    assert [out[len(bad) + i]["clean_text"].strip() for i in range(2)] == [PROSE] * 2
