import random

from rallygrid.llm.leak_search import find_leaks, functions_needed, words_of

WORDS = [a + b + c for a in ("ka", "lo", "mi", "tu") for b in ("ra", "vé", "zo", "ni") for c in ("st", "n", "Ll", "x", "qu")]


def leaks(doc, item):
    d, i = words_of(doc), words_of(item)
    return any(
        sum(d[x + k] == i[y + k] for k in range(12)) >= 11 for x in range(len(d) - 11) for y in range(len(i) - 11)
    )


def test_words():
    assert words_of("Él no-sé: 7'5 STRASSE/straße  ﬁn_x") == ["el", "no", "se", "7", "5", "strasse", "strasse", "fin", "x"]
    assert words_of(None) == [] and words_of("") == []


def test_functions_grow_with_the_segment():
    assert functions_needed(8) < functions_needed(12) < functions_needed(20)


def test_against_brute_force(spark):
    rng = random.Random(2)
    text = lambda n: [rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([12, 13, 40, 90]))), "x") for i in range(12)] + [(90, " ".join(text(11)), "x"), (91, None, "x"), (None, "a", "x"), (92, "", "x")]
    docs = []
    for n in range(900):
        body = text(rng.choice([0, 3, 20, 150]))
        source = words_of(items[n % 12][1])
        length = rng.choice([10, 11, 12, 12, 14])
        at = rng.randrange(len(source) - min(length, len(source)) + 1)
        passage = source[at : at + length]
        for k in rng.sample(range(len(passage)), rng.choice([0, 1, 1, 2])):
            passage[k] = "other"
        where = rng.randrange(len(body) + 1)
        joint = rng.choice([" ", "\n", ", ", " -- "])
        docs.append((n, joint.join(body[:where] + [w.upper() for w in passage] + body[where:]), "x"))
    docs += [(5000, None, "x"), (5001, "", "x"), (None, items[3][1], "x"), docs[0], (5002, " ".join(text(60_000)) + " " + items[4][1], "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    usable = [(a, t) for a, t, _ in items if a is not None and t]
    want = {(a, b) for a, t, _ in docs[:900] for b, u in usable if leaks(t, u)} | {(5002, 4)}
    assert len(want) > 300
    got = sorted(map(tuple, find_leaks(d, i).collect()))
    assert len(got) == len(set(got))
    assert set(got) == want
    assert set(map(tuple, find_leaks(d, i, items_per_block=4).collect())) == want
    assert find_leaks(d.limit(0), i).count() == 0 and find_leaks(d, i.limit(0)).count() == 0
