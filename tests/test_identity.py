import hashlib

import pytest
from pyspark.sql import functions as F

from stelae.functions import identity as i
from stelae.functions.keys import packed, unpacked, utc_month
from stelae.functions.normalize import has_all_words, normalized, normalized_text, words_of
from stelae.functions.values import (
    coverage_of_run,
    fields_of,
    findings_of,
    has_run,
    is_evidence_of_absence,
    joined,
    optional_number,
    parsed_count,
    parsed_time,
    tool_argument,
)

ENTROPY = "a05035869b31af055b5b16060404ea98130701b0b0e5a25be8a78c01427a652c"
NORMAL = {
    "a\nb": "a b", "a\tb": "a b", "a\r\nb": "a b", "a\u0085b": "a b", "a\u000bb": "a b", "a\u000cb": "a b", "a b": "a b",
    "a b": "a b", "a\u001fb": "ab", "a\u0000b": "ab", "  Polish   notation  BVH  ": "Polish notation BVH", "\u0001": "",
    "\t\u0001\n\u0007\r ": "", "\u0085\u0007 ": "", "a \u0001 b": "a b", "a 　b": "a b", "": "", "É é": "É é",
}


def column(spark, values, kind="string"):
    return spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, x {kind}")


def of(df, col):
    return [r.y for r in df.select("n", col.alias("y")).orderBy("n").collect()]


def test_normalization(spark):
    given = column(spark, NORMAL)
    assert of(given, normalized(F.col("x"))) == list(NORMAL.values())
    assert [normalized_text(x) for x in NORMAL] == list(NORMAL.values())
    twice = of(given, normalized(normalized(F.col("x"))))
    assert twice == list(NORMAL.values())
    assert of(column(spark, [None]), normalized(F.col("x"))) == [None]


def test_golden_identities(spark):
    names = ["entropy", "", "énergie", "énergie", " entropy\n", "oxidation"]
    got = of(column(spark, names), i.concept_identity(F.col("x")))
    assert got[0] == ENTROPY == got[4]
    assert got[1].startswith("33a3fade") and got[1].endswith("46fe")
    assert got[2].startswith("ef53c555") and got[3].startswith("d54b4d70")
    assert got[5] == "66d1b720922d89b1777c9e5d2b9f720902f75093f6376dfcc88c828af98f574e"


def test_layout_of_every_field_kind(spark):
    mark = b"\x1f"
    seal = lambda *parts: hashlib.sha256(b"".join(p + mark for p in parts)).hexdigest()
    one = column(spark, ["x  y"])
    claim = of(one, i.claim_identity(F.lit(ENTROPY), F.col("x")))[0]
    assert claim == seal(b"kind", b"claim", b"concept", b"<identity>", bytes.fromhex(ENTROPY), b"text", b"x y")
    cited = of(one, i.assertion_identity(F.lit(claim), F.col("x"), F.lit("")))[0]
    assert cited == seal(b"kind", b"assertion", b"claim", b"<identity>", bytes.fromhex(claim), b"source", b"x y", b"scope", b"")
    document = of(one, i.document_identity(F.encode("x", "UTF-8")))[0]
    assert document == seal(b"kind", b"document", b"content", b"<opaque>", hashlib.sha256(b"x  y").digest())


def test_derivation_order_names_and_exclusions(spark):
    one = column(spark, ["v"])
    build = lambda *names: [d := i.Derivation("k"), *[d := d.text(n, F.col("x")) for n in names]][-1]
    digest = lambda d: of(one, d.seal())[0]
    assert digest(build("a", "b")) != digest(build("b", "a"))
    assert digest(build("a")) != digest(build("c"))
    assert digest(build("a")) == digest(build("a").excluding("z", "says nothing"))
    assert build("a").excluding("z", "says nothing").excluded == (("z", "says nothing"),)
    assert digest(i.Derivation("k").absent("a")) != digest(i.Derivation("k").text("a", F.lit("")))
    assert digest(i.Derivation("k").identity("a", F.lit(ENTROPY))) != digest(i.Derivation("k").text("a", F.lit(ENTROPY)))
    assert i.Derivation("k").absent("a").included == ("a",)


def test_parsing_identities(spark):
    given = [ENTROPY, ENTROPY[:-1], ENTROPY.upper(), ENTROPY[:-1] + "g", ENTROPY + "\n", "", None]
    why = of(column(spark, given), i.identity_refusal(F.col("x")))
    assert why == [None, "wrong length 63", "not a digit A", "not a digit g", "wrong length 65", "wrong length 0", "absent"]
    assert of(column(spark, given), i.is_identity(F.col("x"))) == [True, *[False] * 6]


def test_packed_keys_are_exact(spark):
    given = [ENTROPY, ENTROPY + "\n", ENTROPY.upper(), "=", "", "ключ", None, "\x01" + "a" * 32]
    df = column(spark, given)
    assert of(df, unpacked(packed(F.col("x")))) == given
    sizes = of(df, F.octet_length(packed(F.col("x"))))
    assert sizes[0] == 33 and len({bytes(b) for b in of(df, packed(F.col("x"))) if b is not None}) == len(given) - 1


def test_months(spark):
    given = [0, -1, 1709251199, 1709251200, None, 2**62, -(2**62)]
    want = ["1970-01", "1969-12", "2024-02", "2024-03", "untimed", "out of range", "out of range"]
    assert of(column(spark, given, "long"), utc_month(F.col("x"))) == want


def test_words(spark):
    assert words_of(" isolated\u001fsystem  x\n") == ["isolatedsystem", "x"]
    text = column(spark, ["an isolated system", "Isolated System"])
    assert of(text, has_all_words(F.col("x"), ["sol", "system"])) == [True, False]
    assert of(text, has_all_words(F.col("x"), [])) == [True, True]


def test_numbers_and_fields(spark):
    given = ["12", "-3", "+4", " 12 ", "12\n", "", "9223372036854775808", "x", "-"]
    df = column(spark, given)
    assert of(df, parsed_time(F.col("x"))) == [12, -3, 4, None, None, None, None, None, None]
    assert [v and int(v) for v in of(df, parsed_count(F.col("x")))] == [12, None, 4, None, None, None, 9223372036854775808, None, None]
    assert of(df, optional_number(F.col("x")))[-1] is None
    record = joined(F.col("x"), F.lit(""), F.lit("z"), F.lit(""))
    assert of(column(spark, ["a"]), fields_of(record)) == [["a", "", "z", ""]]


def test_tool_arguments():
    assert [tool_argument(x) for x in ("", "{}", '{"argument": null}', '{"argument": "a b"}')] == ["", "", "", "a b"]
    for bad in ("[1]", "nope", '{"argument": 3}'):
        with pytest.raises(ValueError):
            tool_argument(bad)


def test_coverage(spark):
    df = column(spark, [0, 3], "long")
    name = coverage_of_run(F.col("x"))
    assert of(df, name) == ["barren", "yielded"]
    assert of(df, has_run(name)) == [True, True] and of(df, is_evidence_of_absence(name)) == [True, False]
    assert of(df, findings_of(name, F.col("x"))) == [0, 3]
