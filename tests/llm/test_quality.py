import math
import random

from lathework.llm.quality import judged, layout, outlier_scores, statistics, tail_probabilities

COMMON = [frozenset("the a is it to of and in that for on but so not we i you was with as by".split()), frozenset("der die das und ist nicht mit es".split())]
PROSE = "It took six runs to find out that the cache drops its own rows. We had to merge the job, but that was fine."


def prose(text):
    share, repeated, salad = layout(text, COMMON)
    return share >= 0.5 and repeated <= 0.5 and salad < 0.64


def test_layout():
    assert prose(PROSE) and prose(PROSE.upper()) and prose(PROSE.lower()) and prose("> " + PROSE)
    assert prose(PROSE + "\n\n```py\nx = 1\n```\n- one\n- two\n")
    assert prose("请先确认缓存是否已经记录了大文件，然后再继续。")
    assert not prose("- one thing\n- another thing\n- third")
    assert not prose("| a | b |\n|---|---|\n| It is the case that we had it. | yes |\n| But that was the one for it. | no |")
    assert not prose((PROSE.split(".")[0] + ".\n") * 9)
    assert not prose("retry\n" * 10)
    assert not prose("the of and in that for on but so not we i you was with as by it to a")
    assert not prose("## Summary\nN/A\n** Notes\nTBD\n")
    assert layout(" \n\t", COMMON) == (None, None, None)


def words(spark):
    return spark.createDataFrame([("en", w) for w in COMMON[0]] + [("de", w) for w in COMMON[1]], "lang string, word string")


def test_statistics(spark):
    rows = [(1, "The cat is here.\nno end", "EN", "x"), (2, None, "en", None), (3, "", None, None), (4, "日本語。", "ja", None), (5, " \n ", "en", None), (6, "$$ ## a", "und", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, language string")
    got = {r.doc_id: r for r in statistics(frame, words(spark)).collect()}
    assert got[1].word_count == 6 and got[1].language == "en" and got[1].common_word_share == 2 / 6 and got[1].punctuated_line_share == 0.5
    assert got[2].word_count is None and got[2].prose_share is None
    assert got[3].word_count == 0 and got[3].mean_word_length is None and got[3].language == "und"
    assert got[4].word_count == 3 and got[4].common_word_share is None
    assert got[5].prose_share is None and got[6].symbol_ratio == 4 / 7


def test_tails_match_brute_force(spark):
    rnd = random.Random(2)
    rows = [("en" if i % 3 else "de", i % 2, float(rnd.choice([0, 0, 0, 1, 2.5, rnd.random()]))) for i in range(900)]
    frame = spark.createDataFrame(rows, "language string, stat int, value double")
    for r in tail_probabilities(frame).collect():
        same = [v for lang, s, v in rows if (lang, s) == (r.language, r.stat)]
        assert (r.n_left, r.n_right) == (sum(v <= r.value for v in same), sum(v >= r.value for v in same))
        assert (r.n_value, r.n) == (same.count(r.value), len(same))


def test_verdicts(spark):
    rows = [(i, PROSE, "en") for i in range(40)] + [(100, "- a b\n- c d\n- e f\n", "en"), (101, None, "en"), (102, "", "en"), (103, "x = 1; y(2); z = [3]", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.is_prose for r in judged(frame, words(spark)).collect()}
    assert got[0] is True and got[100] is False and got[101] is None and got[102] is None and got[103] is False and len(got) == 44
    assert judged(frame.filter("doc_id > 999"), words(spark)).collect() == []
    twice = judged(frame.unionAll(frame), words(spark)).collect()
    assert {r.doc_id: r.is_prose for r in twice} == got
    stats = statistics(frame, words(spark))
    assert outlier_scores(stats).count() == 42


def test_frequent_and_lone_junk_is_found(spark):
    rnd = random.Random(7)
    phrase = lambda: " ".join(rnd.choice(["the cache", "a job", "it is", "we had", "that was", "in the", "for a row", "on six runs"]) for _ in range(rnd.randint(4, 30)))
    rows = [(i, f"It is {phrase()}. But {phrase()}, and so we {phrase()}.", "en") for i in range(200)]
    # a third of all rows is one text, which is most of its language
    rows += [(1000 + i, "- one thing\n- another thing\n- third", "de") for i in range(130)] + [(2000 + i, rows[i][1], "de") for i in range(60)]
    rows += [(3000, "| a | b |\n|---|---|\n| c | d |", "fr"), (3001, PROSE, "ja")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in judged(frame, words(spark)).collect()}
    assert {i for i, r in got.items() if r.is_prose is False} == {*range(1000, 1130), 3000}
    assert got[1000].outlier_score >= 4 and got[3000].outlier_score == 0 and len(got) == len(rows)


def test_scores_match_brute_force(spark):
    """The verdict is the score's: against all rows of the language whose layout is that of prose."""
    rnd = random.Random(12)
    stats = [(i, rnd.choice(["en", "de"]), round(rnd.random() ** 0.3, 2), round(rnd.random() ** 6, 2), 0.0 if rnd.random() < 0.9 else round(rnd.random(), 1)) for i in range(600)]
    frame = spark.createDataFrame(stats, "doc_id long, language string, prose_share double, repeated_share double, function_share double")
    got = {r.doc_id: r for r in outlier_scores(frame).collect()}
    for i, lang, *values in stats:
        reference = [v for _, of, *v in stats if of == lang and v[0] >= 0.5 and v[1] <= 0.5 and v[2] < 0.64]
        far = [sum(r[0] <= values[0] for r in reference), sum(r[1] >= values[1] for r in reference), sum(r[2] >= values[2] for r in reference)]
        want = sum(-math.log(min((n + 1) / (len(reference) + 1), 1)) for n in far)
        assert got[i].reference_rows == len(reference) and math.isclose(got[i].outlier_score, want, abs_tol=1e-9)
