import pytest

from rallygrid.llm.source_mix import TOKENIZER, mix_shares, mix_sources, token_counts

DOC = "doc_id long, text string, source string, rate double"
TARGET = "source string, target_share double, max_repeats int"


def docs(spark, sizes):
    rows = [(1000 * k + i, f"{s} {i} " + "ball " * (5 + i % 40), s, 0.0) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(9001, None, "a", 0.0), (9002, "", "a", 0.0), (9003, "no source", None, 0.0), (9004, "no target", "zz", 0.0)]
    rows += [(9100 + i, rows[0][1], "b", 0.0) for i in range(30)]  # copies of one text
    return spark.createDataFrame(rows, DOC)


def test_counts_agree_between_the_libraries(spark):
    df = spark.createDataFrame([(1, "Hello wörld 123 <|endoftext|>  x"), (2, ""), (3, "don't")], "id long, t string")
    a = {r.id: r.n_tokens for r in token_counts(df, ["id"], "t").collect()}
    b = {r.id: r.n_tokens for r in token_counts(df, ["id"], "t", TOKENIZER.replace(".tiktoken", ".json")).collect()}
    assert a == b and a[2] == 0


@pytest.mark.parametrize("sub_blocks", [1, 64])
def test_shares_and_caps(spark, sub_blocks):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("empty", 0.0, 3)], TARGET)
    df = docs(spark, {"a": 900, "b": 400, "c": 60})
    mixed = mix_sources(df, targets, sub_blocks=sub_blocks)
    uses = {(r.doc_id, r.copy) for r in mixed.collect()}
    assert len(uses) == mixed.count() and not {d for d, _ in uses} & set(range(9001, 9131))
    caps = {"a": 1, "b": 2, "c": 4}
    shares = {r.source: r for r in mix_shares(mixed, targets).collect()}
    for s, want in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(shares[s].share - want) < 0.01 and shares[s].most_repeats <= caps[s]
    # The limiting source is used to its cap.
    assert any(shares[s].n_uses == caps[s] * n for s, n in (("a", 900), ("b", 400), ("c", 60)))


def test_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGET)
    df = docs(spark, {"a": 3})
    assert mix_sources(df.limit(0), targets).count() == 0
    assert mix_sources(df, targets.limit(0)).count() == 0
    assert mix_shares(mix_sources(df.limit(0), targets), targets).first().share is None
