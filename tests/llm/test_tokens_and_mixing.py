import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mossline.llm import mixing as M
from mossline.llm import tokens as K

PATH = K.default_ranks()


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab é\n\t '’s1２.!-日😀\u00a0\u3000\u200d"), max_size=400), st.integers(1, 40), st.integers(2, 9))
def test_parts_encode_as_the_whole(text, size, run):
    assert K.encode(text, PATH, size, run) == (K.encoder(PATH).encode_ordinary(text) if text else [])
    assert "".join(K.safe_parts(text, size)) == text
    assert K.decode_bytes(K.encode(text, PATH), PATH).decode() == text


def test_vast_runs_of_blanks():
    for blank in (" ", "\n", "\u3000", "\r\n\t "):
        text = "x" + blank * 400_000 + "y" + blank * 300_000
        assert K.decode_bytes(K.encode(text, PATH), PATH).decode() == text
        short = "x" + blank * 80_000 + " y" + blank * 12_000
        assert K.encode(short, PATH) == K.encoder(PATH).encode_ordinary(short)


def test_ids_of_a_table(spark):
    import tokenizers

    import public_tokenizers

    rng = random.Random(1)
    texts = ["", None, "hello world", "<|endoftext|>", "  two  spaces\r\n\r\nend ", "".join(rng.choice(["x ", "yz", "\n", "é ", "  "]) for _ in range(120_000)), "q" * 50_000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "a", ""), (0, "", "")]
    got = K.token_ids(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()
    assert len(got) == len(rows)
    other = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for r in got:
        if r.doc_id is not None and r.doc_id < 6:
            assert r.ids == (other.encode(texts[r.doc_id], add_special_tokens=False).ids if texts[r.doc_id] else [])
    encoded = K.token_ids(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"))
    assert {r.doc_id: r.text for r in K.decoded_texts(encoded).collect() if r.doc_id is not None} == {i: t or "" for i, t in enumerate(texts)}
    assert K.token_ids(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def plain_seats(weights, seats, caps):
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        open_ = [p for p in sorted(weights) if got[p] < caps.get(p, 0) and weights[p] > 0]
        if not open_:
            break
        got[max(open_, key=lambda p: weights[p] / (2 * got[p] + 1))] += 1
    return got


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefg"), st.floats(0.01, 10), min_size=1), st.integers(0, 200), st.data())
def test_seats_by_highest_quotients(weights, seats, data):
    caps = {p: data.draw(st.integers(0, 80)) for p in weights}
    got, exact = M.sainte_lague(weights, seats, caps), plain_seats(weights, seats, caps)
    assert sum(got.values()) == sum(exact.values()) and all(abs(got[p] - exact[p]) <= 1 for p in weights) and all(got[p] <= caps[p] for p in weights)


def mix(spark, sizes, targets, **options):
    s = spark.createDataFrame([(*x, "clash") for x in sizes], "doc_id bigint, source string, n_tokens bigint, copies string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    m = M.mixed(s, t, **options).cache()
    return m, {r.source: r for r in M.shares_reached(m, t).collect()}


def test_shares_and_repeats(spark):
    rng = random.Random(3)
    sizes = [(i, ("Big ", "small", "tiny")[0 if i % 20 else 1 if i % 40 else 2], rng.randrange(1, 400)) for i in range(20_000)]
    m, shares = mix(spark, sizes, [("big", 0.6, 1), ("SMALL", 0.3, 3), ("tiny", 0.1, 2), ("none", 0.2, 9)], block_tokens=500, shard_tokens=50_000)
    total = 0.6 + 0.3 + 0.1
    for name, share, repeats in (("big", 0.6, 1), ("small", 0.3, 3), ("tiny", 0.1, 2)):
        assert abs(shares[name].reached_share - share / total) < 0.02 and 1 <= shares[name].most_copies <= repeats
    assert shares["none"].reached_share == 0 and m.count() == m.select("doc_id").distinct().count()
    again, _ = mix(spark, sizes, [("big", 0.6, 1), ("SMALL", 0.3, 3), ("tiny", 0.1, 2), ("none", 0.2, 9)], block_tokens=500, shard_tokens=50_000)
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, again.collect()))


def test_a_total_beyond_the_caps_takes_everything(spark):
    m, shares = mix(spark, [(i, "a", 10) for i in range(10)] + [(100 + i, "b", 10) for i in range(10)], [("a", 0.9, 2), ("b", 0.1, 1)], total_tokens=10**9, block_tokens=20)
    assert shares["a"].mixed_tokens == 200 and shares["b"].mixed_tokens == 100


@pytest.mark.parametrize("sizes", [[], [(1, None, 5), (None, "a", 5), (2, "a", None), (3, "a", 0), (4, "zzz", 5)]])
def test_nothing_to_mix(spark, sizes):
    m, shares = mix(spark, sizes, [("a", 1.0, 1), (None, 0.5, 1)])
    assert m.count() == 0 and shares["a"].reached_share == 0.0
