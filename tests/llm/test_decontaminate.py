import random

from tokenloom.llm.decontaminate import find_leaks
from llm_fixtures import docs_of  # noqa: F401

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra", "si", "to", "vu", "ze") for b in ("bar", "den", "fol", "gim", "hus", "jat")]


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def found(df):
    return {(r.doc_id, r.item_id): r for r in df.collect()}


ITEM = "Tom has 5 apples and he gives 2 apples to Mary, who already has 5 pears at home."


def test_templates(spark, docs_of):
    docs = [(1, "Well, Bob has 7 apples and he gives 3 apples to Anna, who already has 7 pears at home. Ok"),
            (2, "Well, Bob has 7 apples and he gives 3 apples to Anna, who already has 9 pears at home."),
            (3, "xx tom HAS 5 apples and he gives 2 apples\nto mary, who already has 5 pears at home yy"),
            (4, None), (5, ""), (6, "Tom runs!"), (7, "Tom runs home"), (None, ITEM), (8, ITEM), (8, ITEM),
            (9, "filler " * 50_000 + ITEM), (10, "a train of 40 km goes 60 miles in 3 hours and stops for 10 minutes at noon")]
    items = [(1, ITEM), (2, "Tom runs."), (3, None), (4, ""), (5, ITEM),
             (6, "A train of 80 mi goes 20 km in 4 days and stops for 90 seconds at noon.")]
    got = found(find_leaks(docs_of(docs), items_of(spark, items)))
    assert set(got) == {(d, i) for d in (1, 3, 8, 9) for i in (1, 5)} | {(6, 2), (10, 6)}
    assert got[1, 1].reparameterised and not got[8, 1].reparameterised and got[8, 1].covered == got[8, 1].item_tokens == 18
    assert got[10, 6].reparameterised


def test_units_must_be_consistent(spark, docs_of):
    item = "a train of 80 km goes far and another of 80 km goes back to the station at noon"
    docs = [(1, item.replace("80", "33").replace("km", "miles")), (2, item.replace("80 km", "33 miles", 1).replace("80 km", "44 days"))]
    assert {d for d, _ in found(find_leaks(docs_of(docs), items_of(spark, [(1, item)])))} == {1}


def test_planted_copies_against_brute_force(spark, docs_of):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(15, 40))).capitalize() + ".") for i in range(20)]
    docs, want = [], set()
    for d in range(120):
        text = [" ".join(rng.choices(WORDS, k=rng.randint(0, 80)))]
        if d % 4 == 0:
            i, t = rng.choice(items)
            text.append(t)
            want.add((d, i))
        text.append(" ".join(rng.choices(WORDS, k=rng.randint(0, 80))))
        docs.append((d, rng.choice([" ", ". ", "\n"]).join(text)))
    assert set(found(find_leaks(docs_of(docs), items_of(spark, items)))) == want


def test_edited_copies_are_united_over_shifts(spark, docs_of):
    words = [f"{a}{b}" for a in WORDS[:8] for b in ("qua", "wex", "yol", "zin", "dro")]
    item = " ".join(words)
    put_in = [w + (" extra" if i in (11, 23, 35) else "") for i, w in enumerate(words)]
    left_out = [w for i, w in enumerate(words) if i not in (9, 19, 29)]
    apart = [" ".join(words[i:i + 10]) + " filler" * 60 for i in (0, 10, 20, 30)]
    backwards = [" ".join(words[i:i + 10]) + " filler" for i in (30, 20, 10, 0)]
    docs = [(1, "so it goes " + " ".join(put_in) + " and on"), (2, " ".join(left_out)), (3, " ".join(apart)), (4, " ".join(backwards)),
            (5, "filler " * 997 + " ".join(put_in))]
    got = found(find_leaks(docs_of(docs), items_of(spark, [(1, item)])))
    assert set(got) == {(1, 1), (2, 1), (5, 1)}
    # windows of eight cannot hold an edited place; what lies between the places is covered
    assert got[1, 1].covered == got[5, 1].covered == 36 and not got[1, 1].reparameterised
    assert got[2, 1].covered == 37


def test_united_slots_must_be_consistent(spark, docs_of):
    item = ("the farmer takes 12 sacks of rye to market, then a miller carries 12 loaves home and sells 30 rolls "
            "before noon; at last 12 bags remain there for all")
    good = ("the farmer takes 17 sacks of rye to market, oh then a miller carries 17 loaves home and sells 41 rolls "
            "oh before noon; at last 17 bags remain there for all")
    bad = good.replace("17 loaves", "18 loaves").replace("17 bags", "19 bags")
    assert set(found(find_leaks(docs_of([(1, good), (2, bad)]), items_of(spark, [(1, item)])))) == {(1, 1)}


def test_slots_of_several_tokens(spark, docs_of):
    item = "Then Tom has 3 cups of flour and Tom gives Mary 2 of them so how many has Tom left"
    docs = [(1, "Then Mary Ann has 1/2 cups of flour and Mary Ann gives Jean-Paul Roe 3 1/4 of them so how many has Mary Ann left"),
            (2, "Then Mary Ann has 1/2 cups of flour and Eve Lee gives Jean-Paul Roe 1 of them so how many has Eve Lee left")]
    got = found(find_leaks(docs_of(docs), items_of(spark, [(1, item)])))
    assert set(got) == {(1, 1)}
    assert got[1, 1].covered == got[1, 1].item_tokens == 20 and got[1, 1].reparameterised


def test_names_that_begin_sentences(spark, docs_of):
    item = "Anna has 3 pens. Ben has 4 pens. Carl has 5 pens. Dora has 6 pens. How many pens are there?"
    again = item.replace("Carl", "Anna").replace("Dora", "Ben")
    new = "Tim has 7 pens. Sue Ellen has 8 pens. Kim has 9 pens. Pat has 2 pens. How many pens are there?"
    docs = [(1, new), (2, "Yesterday " + new), (3, "Now Tim has 7 pens. Sue has 8 pens. Now Tim has 9 pens. Sue has 2 pens. How many pens are there?")]
    got = found(find_leaks(docs_of(docs), items_of(spark, [(1, item), (2, again)])))
    # the second item names two persons twice, the first two texts four
    assert set(got) == {(1, 1), (2, 1), (3, 1), (3, 2)}
    assert got[1, 1].covered == got[1, 1].item_tokens == 21 and all(r.reparameterised for r in got.values())


def test_without_broadcast_the_same(spark, docs_of, monkeypatch):
    from tokenloom.llm import decontaminate as D
    monkeypatch.setattr(D, "SMALL", 0)
    got = found(D.find_leaks(docs_of([(1, "so " + ITEM), (2, "nothing at all here to see but words")]), items_of(spark, [(1, ITEM)])))
    assert set(got) == {(1, 1)}


def test_empty_tables(spark, docs_of):
    assert find_leaks(docs_of([]), items_of(spark, [(1, ITEM)])).collect() == []
    assert find_leaks(docs_of([(1, ITEM)]), items_of(spark, [])).collect() == []
