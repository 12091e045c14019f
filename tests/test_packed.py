import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ligaquery import session
from ligaquery.operators import packed

KEYS = ["alias", "parent"]


def values(spark, texts, keys=KEYS):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "row INT, attr STRING, skeleton STRING")
    out = packed.split_packed(df, "row", "attr", keys).collect()
    return sorted((r.row, r.attr_key, r.val_pos, r.val) for r in out)


def test_styles(spark):
    texts = [
        "ID=a;Parent=p1,p2;Alias=x%2Cy",
        'ID "a"; Parent "p1"; Alias "two, of them"; Parent "p2"; Alias "say ""hi"" now"; ',
        'Alias="a; b","c" , d ;PARENT = p ; alias=e',
        "Parent=p1|p2/p3;q4;Note=z;w",
        "Alias=, ,x,; Parent= ;Alias=\"\"",
    ]
    assert values(spark, texts) == sorted([
        (0, "parent", 1, "p1"), (0, "parent", 2, "p2"), (0, "alias", 1, "x,y"),
        (1, "parent", 1, "p1"), (1, "parent", 2, "p2"), (1, "alias", 1, "two, of them"), (1, "alias", 2, 'say "hi" now'),
        (2, "alias", 1, "a; b"), (2, "alias", 2, "c"), (2, "alias", 3, "d"), (2, "alias", 4, "e"), (2, "parent", 1, "p"),
        (3, "parent", 1, "p1"), (3, "parent", 2, "p2"), (3, "parent", 3, "p3"), (3, "parent", 4, "q4"),
        (4, "alias", 1, "x"),
    ])


def test_null_empty_long_and_odd(spark):
    long = "Alias=" + ",".join(f"v{i}" for i in range(3000))
    got = values(spark, [None, "", ".", "no key", "=x", "Alias=50%;b%zz+c", 'Alias="open; x', long, long])
    assert (5, "alias", 1, "50%") in got and (5, "alias", 2, "b%zz+c") in got
    assert (6, "alias", 1, '"open; x') in got
    assert sum(r[0] == 7 for r in got) == sum(r[0] == 8 for r in got) == 3000
    assert not [r for r in got if r[0] < 5]


def test_empty_table(spark):
    assert values(spark, []) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text('ab ;,|/="', max_size=12), max_size=4))
def test_rules_cover_disjoint_ranges(parts):
    text = ";".join(parts)
    tokens = re.findall(packed.TOKEN, text)
    skel = "".join(t if t in packed.DELIMITERS else "_" if not t.strip() else "a" if t.strip() == "a" else "*" for t in tokens)
    end, at = 0, 0
    for key, pos, lo, n, _ in packed.resolve(skel, ["a"]):
        at += 1
        assert key == "a" and pos == at and lo > end and n > 0
        end = lo + n - 1
    assert end <= len(tokens)


def test_skeleton_has_a_token_a_token(spark):
    texts = ['ID "a"; Alias = b , c', "x", "  ", '"" ;; ==', "a\tb=c\nd", " ALIAS ;aliased=alias", "*", "alias"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = {t: s for t, s in df.select("t", packed.skeleton(df.t, KEYS)).collect()}
    for t, s in got.items():
        assert len(re.findall(packed.TOKEN, s)) == len(re.findall(packed.TOKEN, t)), (t, s)
    assert got['ID "a"; Alias = b , c'] == '*"*";_alias_=*,*' and got[" ALIAS ;aliased=alias"] == "_alias_;*=alias" and got["*"] == "*"


def test_keys_inside_values_and_blank_values(spark):
    texts = ['Alias=parent,alias;Parent=Alias', 'alias = " " , b;Parent="%41"', "parents=x;my parent=y;Parent=z"]
    assert values(spark, texts) == [
        (0, "alias", 1, "parent"), (0, "alias", 2, "alias"), (0, "parent", 1, "Alias"),
        (1, "alias", 1, "b"), (1, "parent", 1, "A"), (2, "parent", 1, "z"),
    ]


def test_rules_too_large_to_broadcast(spark, monkeypatch):
    """The salted join gives the same, also where one skeleton has nearly all rows."""
    texts = [f"ID=x{i};Parent=p{i},q{i}" for i in range(300)] + ["Alias=a|b", None, "", 'Parent "r"']
    want = values(spark, texts)
    monkeypatch.setattr(session, "BROADCAST_BYTES", -1)
    assert values(spark, texts) == want and len(want) == 603


@pytest.mark.parametrize("text", ["x%41", "%C3%A9", "100%", "a+b%20c", ""])
def test_percent(spark, text):
    from urllib.parse import unquote

    df = spark.createDataFrame([(text,)], "t STRING")
    assert df.select(packed.percent_decoded(df.t)).first()[0] == unquote(text)
