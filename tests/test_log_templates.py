from datetime import datetime

import pytest

from mossline.operators import log_templates as L

WORDS = ["12 files parsed, 3 nodes", "retry 2 of 8 - KeyError: status=5", "It looks as if one were gone", "core/x.py:5 [old] -> run", "0/9 cached=1 took 2s", "base date 2024-01-01 10:11:12 | skipped 3"]
LAYOUTS = {
    "glog": lambda i, t, m: f"{'IWEDF'[i % 5]}0301 {t}.000123 77 queue.py:{i}] {m}",
    "pipe": lambda i, t, m: f"{t}|{'IWEDF'[i % 5]}|stage{i % 3}|{m}",
    "syslog": lambda i, t, m: f"Mar  1 {t} node{i} git-walk[{i}]: {['info: ', 'warning: ', 'err: ', 'debug: ', 'crit: ', ''][i % 6]}{m}",
    "python": lambda i, t, m: f"2022-03-01 {t},123 - loc.{'abc'[i % 3]} - {['INFO', 'WARNING', 'ERROR', 'DEBUG', 'CRITICAL'][i % 5]} - {m}",
    "java": lambda i, t, m: f"2022-03-01T{t}.500Z \x1b[33m{['INFO ', 'WARN ', 'ERROR', 'DEBUG', 'FATAL'][i % 5].strip()}\x1b[0m  [pool-{i}] {'ab'[i % 2]}.seeds: {m}",
    "json": lambda i, t, m: f'{{"msg": "{m}", "logger": "causal", "level": "{["info", "warn", "error", "debug", "fatal"][i % 5]}", "time": "2022-03-01T{t}.001+00:00"}}',
    "fields": lambda i, t, m: f'ts=2022-03-01T{t}+00:00 level={["info", "warn", "error", "debug", "fatal"][i % 5]} component=key_ring msg="{m}"' + (" attempt=2" if i % 2 else ""),
    "bracket": lambda i, t, m: f"[{t}] [{['INFO', 'WARN', 'ERROR', 'DEBUG', 'FATAL'][i % 5]}] [Stage {i % 3}] {m}",
}
LEVEL = ["INFO", "WARN", "ERROR", "DEBUG", "FATAL"]
COMPONENT = {"glog": "queue.py", "syslog": "git-walk", "json": "causal", "fields": "key_ring"}


def entries(spark, lines, runs=((1, datetime(2022, 3, 1, 9)),), **options):
    frame = spark.createDataFrame([(*x, "clash") for x in lines], "run_id bigint, line_no int, message string, head string")
    started = spark.createDataFrame([(*x, 1) for x in runs], "run_id bigint, started_at timestamp, first_line int")
    rows = L.log_entries(frame, started, **options).orderBy("run_id", "first_line").collect()
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("name", LAYOUTS)
def test_each_layout_is_found_and_read(spark, name):
    lines = [(1, i + 1, LAYOUTS[name](i, f"10:{i:02}:30", WORDS[i % len(WORDS)])) for i in range(30)]
    got = entries(spark, lines)
    assert [(g[1], g[2]) for g in got] == [(i + 1, i + 1) for i in range(30)]
    assert [g[3] for g in got] == [f"2022-03-01 10:{i:02}:30" for i in range(30)]
    assert [g[6] for g in got] == [WORDS[i % len(WORDS)] for i in range(30)]
    if name == "syslog":
        assert [g[4] for g in got] == [["INFO", "WARN", "ERROR", "DEBUG", "FATAL", ""][i % 6] for i in range(30)]
    else:
        assert [g[4] for g in got] == [LEVEL[i % 5] for i in range(30)]
    if name in COMPONENT:
        assert {g[5] for g in got} == {COMPONENT[name]}


def test_entries_keep_quoted_lines_and_dates_follow_the_clock(spark):
    text = ["banner", "[23:59:50] [INFO] [vote] first", "  [01:00:00] [INFO] inner", "  > 2020-01-01 00:00:00,001 - x - ERROR - quoted", "2021-02-26 is no entry", "", "[00:00:05] [WARN] [vote]", "[00:00:05] second", "[10:00:00] third\r", "[09:00:00] [ERROR] [vote] fourth"]
    lines = [(1, i + 1, t) for i, t in enumerate(text)]
    got = entries(spark, lines + lines[:4], [(1, datetime(2021, 12, 31, 23, 0, 0, 5))])
    assert [(g[1], g[2], g[3], g[4], g[5], g[6]) for g in got] == [
        (2, 6, "2021-12-31 23:59:50", "INFO", "vote", "first"), (7, 7, "2022-01-01 00:00:05", "WARN", "vote", ""), (8, 8, "2022-01-01 00:00:05", "", "", "second"),
        (9, 9, "2022-01-01 10:00:00", "", "", "third"), (10, 10, "2022-01-02 09:00:00", "ERROR", "vote", "fourth"),
    ]
    assert entries(spark, lines, [(1, datetime(2021, 12, 31, 23))], block_lines=2) == got


def test_year_turns_and_zones(spark):
    lines = [(1, 1, "Dec 31 23:59:59 n git[1]: info: a"), (1, 2, "Jan  1 00:00:01 n git[1]: info: b"), (1, 3, "Jan  1 00:00:02 n git[1]: c d")] + [(2, i, f"ts=2022-03-01T02:00:0{i}+02:00 level=info component=a msg=\"say \\\"x\\\"\"") for i in range(3)]
    got = entries(spark, lines, [(1, datetime(2021, 12, 31, 23, 59, 59, 999)), (2, datetime(2022, 3, 1))])
    assert [g[3] for g in got] == ["2021-12-31 23:59:59", "2022-01-01 00:00:01", "2022-01-01 00:00:02"] + [f"2022-03-01 00:00:0{i}" for i in range(3)]
    assert {g[6] for g in got[3:]} == {'say "x"'}


def test_nulls_empty_tables_and_long_lines(spark):
    assert entries(spark, []) == []
    long = "x" * 200_000
    got = entries(spark, [(1, 1, None), (1, 2, f"[10:00:00] [INFO] [vote] {long}"), (None, 3, "[10:00:00] [INFO] [vote] y"), (7, 1, "[10:00:00] [INFO] [vote] no start")])
    assert [(g[0], g[1], len(g[6])) for g in got] == [(1, 2, 200_000), (7, 1, 8)]
    assert got[1][3] is None


def test_common_subsequence_marks_gaps():
    assert L.common(("a", "b", "c"), ("a", "c")) == ("a", L.GAP, "c")
    assert L.common(("a", "b"), ("a", "b")) == ("a", "b")
    assert L.fits(("a", L.GAP, "c"), ("a", "x", "y", "c")) and not L.fits(("a", "c"), ("a", "x", "c"))


def test_a_component_may_have_any_number_of_names(spark):
    lines = [(1, i, f'{{"time": "2022-03-01T10:{i // 60 % 60:02}:{i % 60:02}Z", "level": "info", "logger": "module{i % 400}.worker", "msg": "did it again"}}') for i in range(1_200)]
    assert {(r[4], r[5]) for r in entries(spark, lines)} == {("INFO", f"module{k}.worker") for k in range(400)}


OTHER_LAYOUTS = {
    "level first": (lambda i, v, t, m: f"{v} 2022-03-01 {t},123 queue.{'ab'[i % 2]} - {m}", lambda i: f"queue.{'ab'[i % 2]}"),
    "host first": (lambda i, v, t, m: f"node{i % 7} 2022-03-01 {t},123 {v} core.walk - {m}", lambda i: "core.walk"),
    "component first": (lambda i, v, t, m: f"seed.{'abc'[i % 3]} 2022-03-01T{t}Z [{v}] {m}", lambda i: f"seed.{'abc'[i % 3]}"),
    "many fields": (lambda i, v, t, m: f"{t} | {i} | a{i % 5} | b{i % 3} | {v} | core.{i % 4} | {m}", lambda i: f"core.{i % 4}"),
    "still more fields": (lambda i, v, t, m: f"{t} | " + " | ".join(f"f{k}x" for k in range(12)) + f" | {v} | core.{i % 4} | {m}", lambda i: f"core.{i % 4}"),
    "long key": (lambda i, v, t, m: f'component_identifier_long_x=queue ts=2022-03-01T{t}Z level={v.lower()} msg="{m}"', lambda i: "queue"),
    "long bracket": (lambda i, v, t, m: f"[{t}] [{v}] [a stage with a name of more than forty-eight characters, number {i % 3}] {m}", lambda i: f"a stage with a name of more than forty-eight characters, number {i % 3}"),
    "priority": (lambda i, v, t, m: f"<{30 + i % 5}>Mar  1 {t} node{i} git-walk[{i}]: {v.lower()}: {m}", lambda i: "git-walk"),
}


@pytest.mark.parametrize("name", OTHER_LAYOUTS)
def test_headers_of_any_order_and_length(spark, name):
    made, component = OTHER_LAYOUTS[name]
    lines = [(1, i + 1, made(i, LEVEL[i % 5], f"10:{i:02}:30", WORDS[i % len(WORDS)])) for i in range(30)]
    got = entries(spark, lines)
    assert [(g[1], g[2], g[3], g[4], g[5], g[6]) for g in got] == [(i + 1, i + 1, f"2022-03-01 10:{i:02}:30", LEVEL[i % 5], component(i), WORDS[i % len(WORDS)]) for i in range(30)]


def test_prose_and_marked_lines_with_a_time_are_no_entries(spark):
    text = ["[10:00:00] [INFO] [vote] first", "resumed 2022-03-01 10:00:01 as planned", "resumed 2022-03-01 10:00:02 as planned", "> [10:00:03] [INFO] [vote] inner", "| 10:00:04 [INFO] inner", "job 1646128805 error again", "job 1646128806 error again", '"2022-03-01 10:00:07" INFO said', "[10:00:08] [WARN] [vote] second"]
    got = entries(spark, [(1, i + 1, t) for i, t in enumerate(text)])
    assert [(g[1], g[2], g[4], g[6]) for g in got] == [(1, 8, "INFO", "first"), (9, 9, "WARN", "second")]


def test_a_layout_of_one_line_keeps_its_text(spark):
    got = entries(spark, [(1, 1, "2022-03-01 10:00:00,001 - a.b - INFO - tried again and again - no answer")])
    assert [(g[4], g[5], g[6]) for g in got] == [("INFO", "a.b", "tried again and again - no answer")]


def test_common_keeps_long_heads():
    head = tuple(f"t{i}" for i in range(300))
    assert L.common((*head, "a", "b"), (*head, "c", "b")) == (*head, L.GAP, "b")
    assert L.common((*head, *"abcdefghijkl"), head) == (*head, L.GAP)


def test_too_many_layouts_are_refused(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_LAYOUTS", 1)
    with pytest.raises(ValueError, match="layouts"):
        entries(spark, [(1, 1, "[10:00:00] [INFO] a"), (1, 2, "10:00:01|I|b|c")])


def test_templates_hold_what_all_lines_end_with():
    text = ["file", "7", "x=1", "a-b", "[old]", "q"]
    lines = [f"[10:00:{i:02}] [INFO] [vote] {' '.join(text[: i % 5 + 1] * 4)} (3 ms)" for i in range(30)]
    (found,) = L.mine(iter(lines)).values()
    assert found.count == 30
    assert found.symbols[:5] == ("[<clock>]", " ", "[<level>]", " ", "<group>")
    assert found.symbols[-7:] == (L.GAP, " ", "(", "<number>", " ", "<name>", ")")


def test_common_subsequence_is_of_whole_lines(monkeypatch):
    a, b = ("t", *"abcdefghijkl", ":", *"mn", "!"), ("t", *"opqrstuvwxyz", ":", "!")
    assert L.common(a, b) == ("t", L.GAP, ":", L.GAP, "!")
    assert L.fits(("t", L.GAP, ":", "n", L.GAP), ("t", ":", "m", ":", "n"))
    c, d = tuple("abcabba" * 40), tuple("cbabac" * 50)
    long = L.common(c, d)
    monkeypatch.setattr(L, "TABLE_BITS", 64)
    halved = L.common(c, d)
    assert L.fits(long, c) and L.fits(long, d) and L.fits(halved, c) and L.fits(halved, d)
    assert len([x for x in long if x != L.GAP]) == len([x for x in halved if x != L.GAP]) > 150
