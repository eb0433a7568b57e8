from lumenbib.registry import QUERIES
from lumenbib.sources import views as V

D = "/root/testdata/sf0.001"


def test_period_windows_of_all_topics(spark, rows):
    every = QUERIES["cluster_period_windows_all"](spark, D)
    dated = V.papers(spark, D, "id", "publication_date").filter("publication_date is not null").selectExpr("id as paper_id")
    topics = {r[0] for r in V.paper_topics(spark, D).join(dated, "paper_id").select("topic_id").distinct().collect()} - {None}
    assert len(topics) > 3 and {r[0] for r in every.select("topic_id").distinct().collect()} == topics
    assert rows(every.filter("topic_id in (1, 2, 17)")) == rows(QUERIES["cluster_period_windows"](spark, D))
