import random

import pytest

from mossline.llm import quality as Q

RNG = random.Random(4)
SENTENCE = "The limit counts characters and not bytes, which matters for names with accents. "
PROSE = [SENTENCE * 1 + "To reproduce, clone the project and run the query from the report.", "Renvoie la liste des chemins connus, sans les fichiers de test. Nous avons corrigé le calcul.", "これは短い説明です。次の行に続きます。終わりです。", "ok", "on my machine it takes about four seconds while it used to be done in less than two and nobody knows why"]
CODE = "import os\n\ndef f(x):\n    # note\n    for i in x:\n        print(i)\n    return [\n        1,\n    ]\n"
LISTS = ["Files touched:\n" + "\n".join(f"- core/x{i}.py" for i in range(9)), "\n".join(f"{i}. fold the node ({i})" for i in range(1, 9)), "\n".join(f"[ ] item {i}" for i in range(6)), "\n".join(["stale label", "empty range", "slow frontier", "noisy graph", "cached batch"]), "\n".join(f"#{i} scan it ({i})" for i in range(5))]
TABLES = [
    "a\tb\tc\n" + "\n".join(f"{i}\tx\t{i * 2}" for i in range(9)), "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | see it |" for i in range(6)), "a,b,c\n" + "\n".join(f'{i},"x, y",z' for i in range(8)),
    "name    size  team\n" + "\n".join(f"row{i}    {i:04}  red" for i in range(8)), "┌────┐\n│ a │ b │\n├────┤\n" + "\n".join(f"│ {i} │ x │" for i in range(6)) + "\n└────┘", "a;b;c\n" + "\n".join(f"{i};x;y" for i in range(8)),
]
JUNK = [
    "".join(RNG.choice("ABCDEFabcdef0123456789+/") for _ in range(900)), "\n".join(f"{i:08x}  " + " ".join(f"{RNG.randrange(256):02x}" for _ in range(16)) for i in range(6)), "=" * 200, "Home | Docs | Login\n" * 10, SENTENCE * 20,
    "".join(RNG.choice("{}[]$%&!?<>*+~^|0123456789") for _ in range(400)), "rÃ©sultat dÃ©passe Ã©lÃ©ments et la vÃ©rification", "P\\l\\e^ase d$o n~ot m*e%r%g~e th|is u@nt%il it ha~s b#een re^bu|il@t a#nd che*ck~ed a$gain b%y ev#ery o*ne", "T h i s i s a t e x t t h a t w a s t o r n a p a r t",
    "Toreproduceclonetheprojectbuildthebundlepatchandrunthequeryfromthereportthanksforthequickanswer", "\n".join(f"[{'#' * i}{' ' * (20 - i)}] {i * 5}% 3.{i}it/s" for i in range(1, 12)), "\n".join(f"Page {i} of 30" for i in range(1, 9)),
]


@pytest.mark.parametrize("kind,texts", [("", [*PROSE, CODE, "", "  \n\t"]), ("list", LISTS), ("table", TABLES), ("junk", JUNK)])
def test_kinds(kind, texts):
    assert [Q.kind_of(Q.statistics(t), t) for t in texts] == [kind] * len(texts)


def test_prose_with_a_short_list_or_table_stays_prose():
    for inner in (LISTS[1], TABLES[1], CODE):
        text = (SENTENCE + "It looks to me as if two people had changed it. ") * 1 + "\n\n" + "\n".join(inner.split("\n")[:4]) + "\n\n" + "\n\n".join(["After the upgrade the ranking is worse, and nobody has looked at it for months.", "Please do not merge this until the label has been rebuilt.", "We noticed that the file is read twice.", "Thanks for the quick answer!", "There is no test for this."])
        assert Q.kind_of(Q.statistics(text), text) == ""


def test_statistics_of_a_small_text():
    s = Q.statistics("The cat sat. A dog, 12!\n\nThe cat sat. A dog, 12!\n\n- item")
    assert (s.n_words, s.n_lines) == (11, 3) and abs(s.duplicate_line_share - 1 / 3) < 1e-9 and abs(s.bullet_share - 1 / 3) < 1e-9 and s.duplicate_paragraph_share > 0


def test_table_of_documents(spark):
    rows = [(1, PROSE[0], "x"), (2, None, "x"), (3, "", "x"), (4, LISTS[0], "x"), (4, LISTS[0], "x"), (None, JUNK[0], "x"), (5, "word " * 300_000, "x"), (6, "a" * 1_000_000, "x")]
    got = Q.quality(spark.createDataFrame(rows, "doc_id bigint, text string, kind string")).collect()
    assert sorted((r.doc_id or 0, r.kind) for r in got) == [(0, "junk"), (1, ""), (2, ""), (3, ""), (4, "list"), (4, "list"), (5, "junk"), (6, "junk")]
    assert all(r.n_chars == 0 and r.n_words == 0 for r in got if r.doc_id in (2, 3))
    assert Q.quality(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_table_shares_are_exact_and_rows_of_any_length():
    assert Q.table_share(["a|b|c"] * 4 + ["plain"] * 6) == 0.4
    rows = ["a|b|c"] * 9 + ["a|" + "long " * 1_000 + "|c"]
    assert Q.table_share(rows) == 1.0
    assert Q.table_share([r"1 & 2 \\\\", "<td>" + "x & " * 5_000, "x & " * 20_000]) == 2 / 3


def test_common_words_are_those_of_the_whole_list():
    assert Q.statistics("we were would ich sie hat war je nous vous para com").common_share == 1.0


def test_furniture_of_any_length_and_repeated_paragraphs():
    links = "Log in | Sign up | Terms of use | Privacy policy | Back to top | All rights reserved | Share this | " * 12
    bars = "downloading 14 % [#####>....] " * 40
    prose = "The parser reads every file once and keeps what it needs to answer the next request without reading again. " * 12
    assert Q.is_furniture(links) and Q.is_furniture(bars) and not Q.is_furniture(prose) and not Q.is_furniture(prose + "All rights reserved")
    assert Q.is_furniture("=" * 60 + " page 3 of 10 " + "=" * 60)
    block = "The first line says this.\nAnother one says that.\n\n"
    text = block * 7 + "An end."
    assert Q.kind_of(Q.statistics(text), text) == "junk"
