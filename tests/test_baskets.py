from shoplens.operators import baskets as B

TINY = [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 2), (3, 3), (4, 4)] + [(5, i) for i in range(1, 52)]


def interactions(spark):
    rows = [(u, i, "purchase") for u, i in TINY] + [(1, 1, "add_to_cart"), (4, 9, "view")]
    return spark.createDataFrame(rows, "user_id long, product_id long, interaction_type string")


def test_hand_computed_measures(spark):
    baskets = B.extract(interactions(spark))
    assert {r.basket for r in baskets.collect()} == {1, 2, 3, 5}  # user 4 has one item only
    freq = {r.item: r.frequency for r in B.frequencies(baskets).collect()}
    assert (freq[1], freq[2], freq[3], freq[4]) == (3, 4, 3, 1)  # the basket of 51 counts here
    pairs = B.cooccurrence(baskets, largest=50)
    assert {(r.a, r.b): r.together for r in pairs.collect()} == {(1, 2): 2, (1, 3): 1, (2, 3): 2}  # but not here, by the size the caller set
    rules = {(r.item_id, r.other_id): r for r in B.associations(baskets, pairs, 1).collect()}
    assert rules[1, 2].jaccard == 2 / 5 and rules[2, 1].jaccard == 2 / 5
    assert abs(rules[1, 2].lift - (2 / 4) / ((3 / 4) * (4 / 4))) < 1e-12
    assert rules[1, 2].confidence == 2 / 3 and rules[2, 1].confidence == 2 / 4
    assert set(r[:2] for r in B.jaccard(baskets, pairs).collect()) == {(1, 2), (2, 1), (2, 3), (3, 2)}


def test_shared_buyers_count_every_user(spark):
    scores = {(r.item_id, r.other_id): r.score for r in B.shared_buyers(interactions(spark)).collect()}
    # users of 1: {1,2,5}, of 2: {1,2,3,5}, of 3: {1,3,5}; user 5's 51 items count
    assert scores == {(1, 2): 3 / 4, (2, 1): 3 / 4, (1, 3): 2 / 4, (3, 1): 2 / 4, (2, 3): 3 / 4, (3, 2): 3 / 4}


def test_itemsets(spark):
    baskets = B.extract(interactions(spark))
    found = {tuple(r["items"]): r.freq for r in B.frequent_itemsets(baskets, 0.5, 3).collect()}
    assert found == {(1,): 3, (2,): 4, (3,): 3, (1, 2): 3, (1, 3): 2, (2, 3): 3, (1, 2, 3): 2}


def test_recommendations_leave_out_the_basket(spark):
    scores = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.4), (2, 3, 0.3), (2, 1, 0.5)], "item_id long, other_id long, score double")
    current = spark.createDataFrame([(7, 1), (7, 2), (8, 1)], "basket long, item long")
    got = {(r.basket, r.other_id): (r.score, r.rank) for r in B.recommend(current, scores).collect()}
    assert got == {(7, 3): (0.7, 1), (8, 2): (0.5, 1), (8, 3): (0.4, 2)}


def test_ties_go_to_the_smaller_id(spark):
    rows = [(1, o, 0.5) for o in (9, 4, 7, 2)]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "item_id long, other_id long, score double").repartition(parts)
        assert [r.other_id for r in B.top_partners(df, 3).orderBy("rank").collect()] == [2, 4, 7]
