"""The knowledge search: its shuffles, and tokens longer than the index's pieces."""

from calltrace.operators import search


def test_hits_stay_where_their_query_is(spark):
    """Query texts are shuffled once, what they score never; a word of 40 characters is found by a token of 33 in it."""
    word = "a" * 20 + "b" * 20
    items = spark.createDataFrame([("x", 1, "", word, "", ["t"]), ("y", 2, "", "other words", "", ["t"]), ("z", 3, word, "aaa " + word, "", ["t"])], "id string, item_order int, title string, description string, details string, tags array<string>")
    queries = spark.createDataFrame([(1, word[3:36] + " other"), (2, "aaa " + word[3:36] + " " + word[3:36]), (3, "no"), (4, "c" * 33)], "query_id int, query string")
    found = search.search_items(queries, items, 2)
    assert {(r.query_id, r["rank"]): (r.id, r.score) for r in found.collect()} == {(1, 1): ("z", 7.0), (1, 2): ("x", 2.0), (2, 1): ("z", 21.0), (2, 2): ("x", 6.0), (3, 1): ("x", 0.0), (3, 2): ("y", 0.0)}
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(query_id") == 1
