import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mossline.llm import splitting as S

ALPHABET = st.sampled_from(["a", " ", "\n", "\r", "\r\n", "\t", "é", "😀", "def f():\n", "\n\n", "x" * 30, "日本"])


def check(text, pieces, limit, overlap):
    done = 0
    for a, b in pieces:
        assert a <= done < b and b - a <= limit and done - a <= overlap, (a, b, done)
        done = b
    assert done == len(text)


def tables(text, limit, overlap, size):
    """The boundaries (byte, place, strength) of a text by ranges of `size` bytes, its length and its longest line, stitched by hand."""
    data, (left, right) = text.encode(), S.halos(limit, overlap)
    marks, offset, begun, longest = [], 0, 0, 0
    for begin in range(0, len(data), size):
        before, own = min(begin, left), min(size, len(data) - begin)
        chars, at, places, strengths, first, final, inner = S.boundary_table(data[begin - before : begin + own + right], before, own, begin, begin + own == len(data), S.grid_of(limit, overlap))
        marks.extend((begin + b, offset + p, s) for b, p, s in zip(at, places, strengths, strict=True))
        if first is not None:
            longest, begun = max(longest, inner, offset + first - begun), offset + final
        offset += chars
    return marks, offset, max(longest, offset - begun)


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=300), st.sampled_from([1, 7, 60, 97, 400]))
def test_tables_and_pieces_do_not_depend_on_ranges(parts, size):
    text, limit, overlap = "".join(parts), 50, 10
    marks, n, longest = tables(text, limit, overlap, size)
    assert (marks, n, longest) == tables(text, limit, overlap, 10**9)
    assert n == len(text) and longest == max(map(len, S.BREAKS.split(text)))
    assert all(len(text[:p].encode()) == b and 0 < p < n and text[p - 1 : p + 1] != "\r\n" for b, p, _ in marks) and marks == sorted(set(marks))
    check(text, [(a, b) for a, b, _ in S.pieces_between([m[1] for m in marks], [m[2] for m in marks], 0, n, limit, overlap)], limit, overlap)
    assert all(b - a <= 3 * S.grid_of(limit, overlap) + 3 for a, b in zip([0, *(m[1] for m in marks)], [m[1] for m in marks], strict=False))


def test_pieces_are_the_same_for_all_range_sizes(spark):
    rng = random.Random(5)
    text = "".join(rng.choice(["def f(x):\n", "    return x\n", "\n", "wort ", "日本語", "😀" * 40, "x" * 700, "a b c\r\n"]) for _ in range(6_000))
    frame = spark.createDataFrame([("k", text), ("one", "y" * 5_000)], "k string, t string")
    rows = {size: S.split_texts(frame, key="k", text="t", range_bytes=size, segment_bytes=30_000).orderBy("k", "piece_no").collect() for size in (3_000, 65_536, 1 << 24)}
    assert rows[3_000] == rows[65_536] == rows[1 << 24]
    own = [r for r in rows[3_000] if r.k == "k"]
    assert len(text.encode()) > 5 * 30_000
    check(text, [(r.start_char, r.end_char) for r in own], S.LIMIT, S.OVERLAP)
    assert all(r.piece == text[r.start_char : r.end_char] for r in own) and [r.piece_no for r in own] == list(range(len(own)))
    assert {r.longest_line for r in own} == {max(map(len, S.BREAKS.split(text)))}
    assert {r.k: r.t for r in S.rebuilt(spark.createDataFrame(rows[65_536]), key="k", text="t").collect()} == {"k": text, "one": "y" * 5_000}


def test_cuts_fall_before_definitions(spark):
    text = "\n".join(f"def f{i}(x):\n    return {'x' * 60}\n" for i in range(60))
    rows = S.split_texts(spark.createDataFrame([("k", text, 0)], "k string, t string, piece int"), key="k", text="t").orderBy("piece_no").collect()
    check(text, [(r.start_char, r.end_char) for r in rows], S.LIMIT, S.OVERLAP)
    assert all(text[r.end_char :].startswith("def ") for r in rows[:-1]) and all(r.piece == text[r.start_char : r.end_char] for r in rows)


def test_texts_of_any_kind(spark):
    rng = random.Random(1)
    texts = {"null": None, "empty": "", "exact": "a" * 2000, "over": "b" * 2001, "lines": "\n" * 5000, "crlf": "abc\r\n" * 900, "words": "wort " * 900, "long": "".join(rng.choice(["x", "é", "\n", " "]) for _ in range(150_000)), "emoji": "😀" * 5000}
    rows = S.split_texts(spark.createDataFrame(list(texts.items()), "k string, t string"), key="k", text="t", range_bytes=7_000).orderBy("k", "piece_no").collect()
    assert {r.k for r in rows} == {k for k, t in texts.items() if t and len(t) > 2000}
    for k in {r.k for r in rows}:
        own = [r for r in rows if r.k == k]
        check(texts[k], [(r.start_char, r.end_char) for r in own], S.LIMIT, S.OVERLAP)
        assert [r.piece_no for r in own] == list(range(len(own)))
    assert {r.k for r in rows if r.longest_line > S.LIMIT} == {"over", "words", "emoji"}
    assert S.split_texts(spark.createDataFrame([], "k string, t string"), key="k", text="t").count() == 0
    with pytest.raises(ValueError):
        S.split_texts(spark.createDataFrame([], "k string, t string"), key="k", text="t", limit=10, overlap=5)


def test_latest_row_decides(spark):
    t = datetime(2024, 1, 1)
    rows = [("a", "x" * 3000, t), ("a", "short", t + timedelta(1)), ("b", "short", t), ("b", "y" * 3000, t + timedelta(1)), ("c", "z" * 3000, None), ("c", "z" * 3000, None), ("d", None, t), ("d", "w" * 3000, None), (None, "v" * 3000, t), ("e", "u" * 2500, t), ("e", "t" * 2600, t)]
    got = S.oversized_latest(spark.createDataFrame([(*r, 1) for r in rows], "id string, code string, at timestamp, _text int"), key="id", text="code", at="at", limit=2000).collect()
    assert sorted(r.id for r in got) == ["b", "c", "e"]


def test_files_by_byte_ranges(spark, tmp_path):
    rng = random.Random(2)
    texts = {"a": "".join(rng.choice(["é", "x", "日", "\n", " ", "😀", "def g():\n"]) for _ in range(20_000)), "b": "tiny", "c": "q" * 9_000}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "empty").write_bytes(b"")
    files = S.files_below(spark, str(tmp_path))
    rows = S.split_files(files, range_bytes=5_000).orderBy("path", "piece_no").collect()
    for name, text in texts.items():
        own = [r for r in rows if r.path.endswith("/" + name)]
        check(text, [(r.start_char, r.end_char) for r in own], S.LIMIT, S.OVERLAP)
        assert all(r.piece == text[r.start_char : r.end_char] for r in own) and [r.piece_no for r in own] == list(range(len(own)))
    assert not [r for r in rows if r.path.endswith("empty")]
    assert S.split_files(files, range_bytes=1 << 20).orderBy("path", "piece_no").collect() == rows


def test_repeated_and_missing_keys(spark):
    long, other = "a b\n" * 900, "c d\n" * 700
    frame = spark.createDataFrame([("k", long, 1), ("k", long, 2), ("k", other, 3), (None, long, 4), ("n", None, 5)], "k string, t string, _text int")
    rows = S.split_texts(frame, key="k", text="t").orderBy("piece_no").collect()
    assert {r.k for r in rows} == {"k"} and rows[-1].end_char == len(long) and all(r.piece == long[r.start_char : r.end_char] for r in rows)
    assert [r.piece_no for r in rows] == list(range(len(rows)))


def test_bytes_that_are_no_text_count_one_each(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"ok \xff\xfe\x80 end\n" * 700)
    rows = S.split_files(S.files_below(spark, str(tmp_path)), range_bytes=999).orderBy("piece_no").collect()
    assert rows[-1].end_char == 11 * 700 and all("\ufffd" in r.piece and "end" in r.piece for r in rows)
