import random

from pyspark.sql import functions as F

from rallygrid.llm.cut_text import cut_rates, judge_endings, masked, significant_lengths

_rng = random.Random(9)
_VOCABULARY = ["".join(_rng.choice("aeioubdfklmnprstvz") for _ in range(_rng.randrange(2, 9))) for _ in range(400)]


def sentence(rng):
    """Whole sentences vary; some hold or end in numbers."""
    words = [rng.choice(_VOCABULARY) for _ in range(rng.randrange(5, 13))]
    tail = rng.choice(["", "", "", " from 1.13 to 1.29 overnight", " on court 4", " by 6-3 6-4"])
    return (" ".join(words) + tail).capitalize() + rng.choice("...?!")


SIGN_OFFS = {"forum": ["lol", "cheers", "#tennis #oslo", "+1", ""], "wire": ["(oslo desk)", "\n6-3 6-4", ""], "blog": ["Until next time...", "— the team"]}


def corpus(n=3000):
    rng = random.Random(4)
    rows, truth = [], set()
    for i in range(n):
        source = rng.choice(list(SIGN_OFFS))
        parts = [sentence(rng) for _ in range(rng.randrange(2, 9))]
        text = " ".join(parts)
        whole = (text + " " + rng.choice(SIGN_OFFS[source])).strip(" ")
        if source == "wire" and len(whole) > 200:
            whole = whole[:200]
        elif rng.random() < 0.04:
            whole = text[: rng.randrange(30, len(text))] + rng.choice(["", "...", "…", " [...]"])
        else:
            rows.append((i, whole, source, "x"))
            continue
        bare = whole.removesuffix(" [...]").rstrip(".…?!")
        if not any(bare.rstrip().endswith(s.rstrip(".?!")) for s in parts):
            truth.add(i)
        rows.append((i, whole, source, "x"))
    return rows, truth


def test_held_out_accuracy(spark):
    rows, truth = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, cut string")
    judged = judge_endings(df).collect()
    got = {r.doc_id for r in judged if r.cut}
    assert len(judged) == len(rows)
    assert len(got & truth) / len(truth) > 0.97 and len(got & truth) / len(got) > 0.95
    spikes = significant_lengths(df.select("source", F.length("text").alias("length"))).collect()
    assert ("wire", 200) in {(r.source, r.length) for r in spikes}
    rates = {r.source: r for r in cut_rates(judge_endings(df)).collect()}
    assert rates["wire"].n_cut_at_limit > 50 and rates["forum"].cut_rate < 0.1


def test_edge_cases(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, "  \n", None), (4, "word " * 200_000 + "end", None), (5, "All done.", "s"), (5, "All done.", "s")]
    out = judge_endings(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted((r.doc_id, r.cut) for r in out.collect()) == [(1, False), (2, False), (3, False), (4, True), (5, False), (5, False)]
    assert judge_endings(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_mask(spark):
    df = spark.createDataFrame([("Final: 6-4 7-6(3) [10-8]",), ("#Tennis #Oslo",), ("[18+]",)], "s string")
    assert [r[0] for r in df.select(masked(F.col("s"))).collect()] == ["final: S", "#a #a", "[9+]"]


def test_copies_of_a_cut_text_are_no_habit(spark):
    rows, truth = corpus(1200)
    last, cut = max(r[0] for r in rows), "The second set went to the visitors. They were then found to be in the mid"
    copies = [(last + 1 + i, cut, ["forum", "wire", "blog"][i % 3], "x") for i in range(len(rows) // 2)]
    # Another text of the source that ends in the same words, and copies with openings of their own.
    others = [(last + 1 + len(copies) + i, x, "forum", "x") for i, x in enumerate(
        ["Rain fell, " + "they were then found to be in the mid", *[f"Report {i}: " + "long rally " * 20 + "and they won the tie" for i in range(40)]]
    )]
    df = spark.createDataFrame(rows + copies + others, "doc_id long, text string, source string, cut string")
    got = {r.doc_id for r in judge_endings(df).collect() if r.cut}
    assert {r[0] for r in copies + others} <= got
    assert len(got & truth) / len(truth) > 0.97
    # Sign-offs of distinct texts are habits still.
    assert len(got & {r[0] for r in rows}) < 1.1 * len(truth)


def test_a_limit_that_cuts_texts_in_one_form(spark):
    """Texts of one make, cut at one length, all end alike: only the length tells that from a
    sign-off."""
    rows, _ = corpus(1500)
    last = max(r[0] for r in rows)
    make = lambda i: (f"Report {i:05d} of the day. " + "All courts were dry. " * 5 + "Play went on until the light failed in the evening.")[:145]
    made = [(last + 1 + i, make(i), "wire", "x") for i in range(60)]
    df = spark.createDataFrame(rows + made, "doc_id long, text string, source string, cut string")
    flagged = lambda **k: {r.doc_id for r in judge_endings(df, **k).collect() if r.cut}
    assert {r[0] for r in made} <= flagged()
    import rallygrid.llm.cut_text as module

    lengths, module.significant_lengths = module.significant_lengths, lambda docs, fdr: lengths(docs, 1e-300)
    try:
        assert not {r[0] for r in made} & flagged()
    finally:
        module.significant_lengths = lengths


def test_half_a_decimal(spark):
    whole = [f"The price moved from 1.{i:02d} to 2.{i:02d} overnight. Play started on court 4. All was well today." for i in range(40)]
    ends = ["Rain fell today. The price moved from 1.", "Rain fell today. Play started on court 4."]
    rows = [(i, t, "s") for i, t in enumerate(whole + ends)]
    got = {r.doc_id for r in judge_endings(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect() if r.cut}
    assert got == {len(whole)}
