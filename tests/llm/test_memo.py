"""Memos of words: equal values whatever is forgotten, and one holder a worker among those that are to be alone."""

from tessera.llm.common import Recent


def test_memos_that_are_alone_empty_each_other():
    a, b, c = Recent(len, alone=True), Recent(str.upper, alone=True), Recent(hash)
    assert [a["x"], a["yy"], c["z"]] == [1, 2, hash("z")] and len(a) == 2
    assert b["x"] == "X" and not a and not a.old and len(c) == 1
    assert a["yy"] == 2 and not b


def test_a_small_memo_gives_the_same():
    words = [f"w{i % 7}{'x' * (i % 80)}" for i in range(500)]
    small = Recent(len, most=4)
    assert [small[w] for w in words] == list(map(len, words)) and len(small) + len(small.old) <= 4
