import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stelae.llm.splitting import pieces, split


def check(octets, limit, overlap):
    found = split(octets, limit, overlap)
    assert found[0][0] == 0 and found[-1][1] == len(octets) and found[-1][2] == "end"
    for (a, b, _), (c, d, _) in zip(found, found[1:]):
        assert a < c <= b < d and b - c <= overlap
    assert all(0 < b - a <= limit for a, b, _ in found) or not octets
    joined, at = b"", 0
    for a, b, _ in found:
        joined, at = joined + octets[max(a, at) : b], b
    assert joined == octets
    return found


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=600), st.integers(8, 60), st.integers(0, 7))
def test_any_octets(octets, limit, overlap):
    check(octets, limit, overlap)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab. \n#é日。\r", max_size=400), st.integers(12, 80), st.integers(0, 8))
def test_valid_text_is_never_cut_inside_a_character(text, limit, overlap):
    octets = text.encode()
    for a, b, _ in check(octets, limit, overlap):
        octets[a:b].decode()


def test_natural_boundaries_come_first():
    sentence = b"One two three four five six seven. "
    paragraphs = b"\n\n".join([sentence * 20] * 12)
    found = check(paragraphs, 4000, 200)
    assert {level for _, _, level in found} == {"paragraph", "end"}
    assert all(paragraphs[a : a + 3] == b"One" for a, _, _ in found)
    words = b"word " * 3000
    assert {level for _, _, level in check(words, 4000, 200)} == {"word", "end"}
    blob = b"x" * 50_000
    found = check(blob, 4000, 200)
    assert {level for _, _, level in found} == {"character", "end"} and len(found) == 14
    sections = b"## Head\n\n" + sentence * 60 + b"\n\n\n\n## Next\n\n" + sentence * 60
    assert check(sections, 4000, 200)[0][2] == "section"


def test_spaces_invalid_octets_and_large_contents():
    check(b" " * 9000, 4000, 200)
    check(b"\x80" * 9000, 4000, 200)
    check("日".encode() * 5000, 4000, 200)
    check(bytes(random.Random(1).randrange(256) for _ in range(50_000)), 4000, 200)
    assert len(check(b"a b\n" * 500_000, 4000, 200)) > 500
    assert split(b"", 10, 2) == [(0, 0, "end")]
    with pytest.raises(ValueError):
        split(b"x", 5, 5)


def test_table_of_pieces(spark, rows):
    long, same = b"ab. " * 2000, b"q" * 4000
    data = [("d", long, 3, "x"), ("d", long, None, "y"), ("short", same, 99_999, ""), ("n", None, 5000, ""), ("e", b"", 5000, ""), (None, long + b"!", 1, ""), ("d", long + b"?", 1, "")]
    df = spark.createDataFrame(data, "document string, content binary, length long, piece string")
    got = pieces(df, "document", "content")
    assert rows(got.select("document").distinct()) == [("d",), (None,)]
    assert got.select("document", "content_id").distinct().count() == 3
    for item in {r.content_id for r in got.collect()}:
        mine = sorted((r for r in got.collect() if r.content_id == item), key=lambda r: r.piece)
        whole = b"".join(bytes(r.content)[r.overlap :] for r in mine)
        assert whole in (long, long + b"!", long + b"?") and [r.piece for r in mine] == list(range(len(mine)))
    assert pieces(df.limit(0), "document", "content").count() == 0
