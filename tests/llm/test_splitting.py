import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lathework.llm.splitting import cut_items, merge_weakest, split_spans

ITEMS = "item_kind string, item_id string, limit_kind string, file_path string, chunk_type string, first_line int, diff boolean, text string, max_size string"
LIMITS = [("function", "chars", 100, 20), ("default", "chars", 50, 0), ("context_window", "tokens", 5, 0)]


def sound(text, max_size, overlap, diff=False):
    spans = split_spans(text, max_size, overlap, diff)
    at = 0
    for k, (over, start, end) in enumerate(spans):
        assert start == at and over <= start < max(end, 1) and end - over <= max_size
        at = end
        if k:
            assert start - over <= overlap and over >= spans[k - 1][1]
            assert (start - over > 0) == (overlap > 0 and max_size > 1)
    assert at == len(text)
    return spans


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\r\t{}#.日é🎉+-@", max_size=400), st.integers(2, 60), st.integers(0, 30), st.booleans())
def test_any_text(text, max_size, overlap, diff):
    sound(text, max_size, overlap, diff)


def test_long_lines_and_line_ends():
    rnd = random.Random(2)
    text = "".join(rnd.choice(["x" * 500, "word " * 300, "\r\n", "\n\n", "def f():\r\n", "    return 1\r\n"]) for _ in range(200))
    for _, start, end in sound(text, 200, 40):
        assert not (0 < end < len(text) and text[end - 1 : end + 1] == "\r\n")
        assert not (0 < start and text[start - 1 : start + 1] == "\r\n")


def test_cuts_fall_between_functions():
    body = "".join(f"def f{i}(x):\n    a = x\n    return a + {i}\n\n\n" for i in range(40))
    spans = split_spans(body, 200, 0)
    assert all(body[s:].startswith("def ") for _, s, _ in spans)


def test_diff_cuts_at_files():
    part = "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@\n-old\n+new\n ctx\n"
    spans = split_spans(part * 20, 200, 0, diff=True)
    assert all((part * 20)[s:].startswith("diff --git") for _, s, _ in spans)


def test_weakest_boundary_goes_first():
    # three segments; only two neighbours fit together, and the right boundary is weaker
    assert merge_weakest([5, 5, 5], [0, 3, 1], 10) == [0, 1]
    assert merge_weakest([5, 5, 5], [0, 1, 3], 10) == [0, 2]


def test_frame_cases(spark):
    long = "".join(f"line number {i}\n" for i in range(30))
    rows = [
        ("chunk", "a", "function", "p", "function", 10, False, long, "clash"),
        ("chunk", "a", "function", "p", "function", 10, False, long, "clash"),
        ("chunk", "b", "context_window", None, "context_window", None, False, "y" * 120, None),
        ("chunk", "c", None, None, None, 1, False, "z" * 50, None),
        ("chunk", "d", "other", None, "other", 1, False, "z" * 51, None),
        ("chunk", "e", "function", None, None, 1, False, None, None),
        ("chunk", "f", "function", None, None, 1, False, "", None),
    ]
    items = spark.createDataFrame(rows, ITEMS).drop("max_size")
    limits = spark.createDataFrame(LIMITS, "item_kind string, unit string, max_size int, overlap int")
    got = cut_items(items, limits).orderBy("item_id", "piece_no").collect()
    assert {r.item_id for r in got} == {"a", "b", "d"}
    a = [r for r in got if r.item_id == "a"]
    assert a[0].start_line == 10 and a[-1].end_line == 39 and [r.piece_no for r in a] == list(range(len(a)))
    assert "".join(r.text[r.overlap_chars :] for r in a) == long
    for r in a:
        assert r.n_chars == len(r.text) <= 100 and long.splitlines()[r.start_line - 10] in r.text or r.piece_no
    assert cut_items(items.filter("item_id = 'f'"), limits).collect() == []
