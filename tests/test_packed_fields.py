import pytest

from rallygrid.operators.packed_fields import split_packed, split_rule

CASES = {
    "6-3 7-6(4)": ["6-3", "7-6(4)"],
    "6-3;7-6 (4);[10-8]": ["6-3", "7-6 (4)", "[10-8]"],
    '"6-3","7-6(4)"': ["6-3", "7-6(4)"],
    "'6-3' '7-6(4)'": ["6-3", "7-6(4)"],
    "6-3/7-6(4) / RET": ["6-3", "7-6(4)", "RET"],
    "||6-3||7-5| ": ["6-3", "7-5"],
    "W/O": ["W/O"],
    "6-1/w/o": ["6-1", "w/o"],
    '"W/O"': ["W/O"],
    '6-2|"RET the ""old"" hip"': ["6-2", 'RET the "old" hip'],
    '6-2, "RET wrist / hand"': ["6-2", "RET wrist / hand"],
    "6-3 6-4\t7-5\n[10-2]": ["6-3", "6-4", "7-5", "[10-2]"],
    '"" 6-1': ["6-1"],
    '" 6-1 "': ["6-1"],
    "é-ü Wow": ["é-ü", "Wow"],
    "": [],
    " \t": [],
    None: [],
}


@pytest.mark.parametrize("broadcast_bytes", [None, 0])
def test_pieces(spark, broadcast_bytes):
    rows = [(i, s, "x", "y") for i, s in enumerate(CASES)]
    df = spark.createDataFrame(rows, "shape long, score string, starts string, pos string")
    got = {}
    for r in split_packed(df, "shape", "score", broadcast_bytes).collect():
        got.setdefault(r[0], {})[r["pos"]] = r["piece"]
    for i, (s, want) in enumerate(CASES.items()):
        assert [got.get(i, {}).get(k + 1) for k in range(len(want))] == want and len(got.get(i, {})) == len(want), s


def test_long_repeated_and_empty(spark):
    long = ";".join(f"{i % 8}-6" for i in range(20_000))
    df = spark.createDataFrame([(1, long), (1, long), (2, '"' * 999)], "id long, t string")
    out = split_packed(df, "id", "t")
    assert out.filter("id = 1").count() == 40_000
    assert out.filter("id = 1").agg({"pos": "max"}).first()[0] == 20_000
    assert split_packed(df.limit(0), "id", "t").count() == 0


def test_rule_is_a_function_of_the_shape():
    assert split_rule("9-9 9-9 (9)") == [(1, 3, ""), (5, 7, "")]
