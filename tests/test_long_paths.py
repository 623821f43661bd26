"""What Spark keeps of a graph's size on the driver does not grow with the rounds, and long paths are walked to their end."""

from weft.operators import graph


def _estimate(rows):
    """Digits of the estimated size of the optimized plan, as Spark prints it (past exbibytes as 1.2E+34)."""
    text = rows._jdf.queryExecution().optimizedPlan().stats().simpleString()
    return int(text.split("E+")[1].split()[0]) if "E+" in text else 0


def test_components_of_a_long_path(spark):
    edges = spark.range(3000).selectExpr("id AS u", "id + 1 AS v").union(spark.range(5000, 5002).selectExpr("id AS u", "id + 1 AS v"))
    found = graph.components(edges)
    assert _estimate(found) < 40
    assert {r["comp"]: r["count"] for r in found.groupBy("comp").count().collect()} == {0: 3001, 5000: 3}


def test_sizes_of_a_long_chain(spark):
    # left i shares a record with left i + 1, and one edge stands apart; a repeated edge is counted twice
    edges = spark.range(1000).selectExpr("id AS i1", "explode(array(id, id + 1)) AS i23").union(spark.sql("SELECT 5000L, 5000L UNION ALL SELECT 5000L, 5000L"))
    found = graph.sizes(edges)
    assert _estimate(found) < 40
    assert {tuple(r) for r in found.select("comp", "n_left", "n_right", "n_edges").collect()} == {("a0", 1000, 1001, 2000), ("a5000", 1, 1, 2)}


def test_rounds_on_a_path_in_mixed_order(spark, monkeypatch):
    written, saved = [], graph.saved
    monkeypatch.setattr(graph, "saved", lambda rows, *args: written.append(1) or saved(rows, *args))
    edges = spark.range(1000).selectExpr("id * 389 % 1009 AS u", "(id + 1) * 389 % 1009 AS v")
    found = graph.components(edges)
    assert {r["comp"] for r in found.collect()} == {0} and found.count() == 1001
    # a walk of one step a round takes hundreds
    assert 5 < len(written) < 20
