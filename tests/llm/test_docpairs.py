import ast
from datetime import datetime, timedelta

import pytest

from mossline.llm import docpairs as D
from mossline.llm import pysource as P

T = datetime(2024, 1, 1)

SOURCES = [
    "def f(a, b=(1, 2)):\n    '''Doc of f.'''\n    def g():\n        return 1\n    return g\n",
    "class A:\n    class B:\n        async def m(self) -> int:\n            \"x\" 'y'\n            return 1\n\n    @property\n    @other(1,\n        2)\n    def p(self): return 'no doc'\n",
    "if True:\n\tdef t():\n\t\tr\"\"\"Raw.\n\t\tmore\"\"\"\nelse:\n    def t(): 'inline'\n",
    "S = '''\ndef not_one():\n    \"no\"\n'''\ndef real(\n    x,\n    # comment (\n):\n    f'not a doc'\n",
    "def a():\r\n    ('paren')\r\n    x = [\r\n        1,\r\n    ]\r\nasync def b(): b'bytes'\r\n",
    "x = 1; y = 'def z(): pass'\ndef c(): pass; 'late'\ndef d():\n    'first'; e = 2\n",
    "def ü():\n    # note\n    'after a comment'\n\nlambda: 0\n",
]


@pytest.mark.parametrize("source", SOURCES)
def test_scan_agrees_with_the_parser(source):
    expected = {}

    def walk(node, names):
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                if not isinstance(n, ast.ClassDef):
                    expected[".".join([*names, n.name]), n.lineno] = ast.get_docstring(n, clean=False)
                walk(n, [*names, n.name])
            else:
                walk(n, names)

    walk(ast.parse(source), [])
    assert {(f.qualname, f.start_line): f.docstring for f in P.scan(source)[0]} == expected


def test_scan_of_broken_files():
    broken = "x = (1, 2,\n\n@deco\ndef f():\n    'Doc.'\n    print 'old'\n<<<<<<< ours\ndef g(:\n    'Doc of g.'\n>>>>>>> theirs\nclass K\n    def h(self):\n        '''open"
    assert [(f.qualname, f.start_line) for f in P.scan(broken)[0]][0] == ("f", 4)
    assert P.scan("")[0] == [] and P.scan("'''")[0] == [] and P.scan("((((")[0] == []


def test_what_says_something():
    good = ["Return the rows that belong to it.", "Renvoie la liste des chemins.", "Keeps two entries.", "Number of open nodes.", "Sum.\n\nArgs:\n    a: the one to use.", "見出しを返す。"]
    bad = [
        "", "  ", "TODO", "TODO: describe this", "FIXME", "xxx", "...", "-", "TBD.", "N/A", "_summary_", "_summary_\n\nArgs:\n    a (_type_): _description_\nReturns:\n    _type_: _description_",
        "Docstring.", "No description.", "See base class.", "See above.", "Inherited.", "Init.", "load_seed", "load_seed()", "load_seed(a, b) -> int", "Load seed.", "The load seed function.", "LoadSeed", "loads the seed",
    ]
    assert all(D.documentation_of("load_seed", t) for t in good)
    assert not [t for t in bad if D.documentation_of("load_seed", t)]


def test_comments_that_say_nothing():
    for block in ("# noqa: E9", "# pylint: disable=x", "# type: ignore", "# fmt: off", "# ------", "# x = f(3)\n# return g(x)", "# import = self._a(9)", "#!/usr/bin/env python\n# -*- coding: utf-8 -*-"):
        assert not D.documentation_of("f", D.comment_text(block)), block
    assert D.documentation_of("f", D.comment_text("#\n# Cuts rows\n# in two.")) == "Cuts rows\nin two."


SOURCE = """# Above the first.
def first():
    pass

# Not above, a blank line follows.

def second():
    pass
x = 1
# Above the decorator.
@deco
def third():
    pass

@deco
# Above the def.
def fourth():
    pass

class C:
    # The comment is not used.
    def fifth(self, a):
        "See base class."
    def sixth(self):
        '''Counts them all.'''
"""


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "repo string, file_path string, content string, ingested_at timestamp, qualname string")
    return D.documented_functions(frame, keys=["repo", "file_path"])


def test_pairs_of_a_file(spark):
    got = run(spark, [("r", "m.py", SOURCE.replace("\n", "\r\n"), T)]).collect()
    assert {(r.qualname, r.start_line, r.documentation) for r in got} == {("first", 2, "Above the first."), ("third", 12, "Above the decorator."), ("fourth", 17, "Above the def."), ("C.sixth", 24, "Counts them all.")}
    assert [r.signature for r in got if r.qualname == "C.sixth"] == ["(self)"]
    assert [r.code.startswith("def first():") for r in got if r.qualname == "first"] == [True]


def test_latest_row_nulls_repeats_and_empty(spark):
    doc = "def {}():\n    'Says something useful.'\n".format
    rows = [("r", "a", doc("old"), T), ("r", "a", doc("new"), T + timedelta(1)), ("r", "a", doc("new"), T + timedelta(1)), ("r", "b", None, T), ("r", "c", "", T), ("r", "d", doc("kept"), None), ("r", "e", doc("gone"), T), ("r", "e", "x = 1", T + timedelta(1)), (None, "f", doc("nokey"), T)]
    assert sorted((r.file_path, r.qualname) for r in run(spark, rows).collect()) == [("a", "new"), ("d", "kept")]
    assert run(spark, []).count() == 0
    long = doc("long") + "y = '" + "z" * 500_000 + "'\n"
    assert run(spark, [("r", "l", long, T)]).count() == 1
