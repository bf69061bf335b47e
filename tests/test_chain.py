"""The whole chain with Louvain and pruning, against SQL that is given Louvain's own partition."""

import duckdb
import pytest

import __spark_entry__ as entry
from pulseweave.plans.detection import Settings, detect_events
from pyspark.sql import functions as F
from workload import detection
from workload import views as v
from workload.check import duck, rows_of

SF_DIR = "/root/testdata/sf0.01"


def louvain_sql() -> str:
    """SQL of the exported chain, its neighbour communities exchanged for a table."""
    text, body = entry.oracle_sql()["detect_events_chain"], v._CTES["doc_partition"][0]
    assert text.count(body) == 1
    return text.replace(body, "SELECT g, node, community FROM louvain_partition")


@pytest.mark.parametrize("prune", [False, True])
def test_chain_with_louvain(spark, prune):
    places = v.gazetteer(spark, SF_DIR).withColumn("state", F.lit(None).cast("string"))
    s = Settings(
        span_ms=v.DOC_SPAN_MS, min_window_posts=1, min_cluster_posts=v.DOC_MIN_POSTS, prune=prune,
        campaign_threshold=0.4, geo_threshold=2.0,
    )
    found = detect_events(v.text_posts(spark, SF_DIR), s, places=places)

    con: duckdb.DuckDBPyConnection = duck(SF_DIR)
    con.register("louvain_partition", found.partition.select("g", "node", "community").toArrow())
    con.register("run_clusters", found.clusters.select("cluster_id", "is_unlikely").toArrow())

    # Which clusters Louvain saw: the ends of links, without those scored as ordinary.
    nodes = con.execute(
        v.sql(
            f"""SELECT node FROM (SELECT source AS node FROM doc_links UNION SELECT target FROM doc_links)
            JOIN run_clusters ON cluster_id = node WHERE NOT {prune} OR coalesce(is_unlikely, 1) <> 0""",
            "doc_links",
        )
    ).fetchall()
    seen = con.execute("SELECT node FROM louvain_partition").fetchall()
    assert sorted(nodes) == sorted(seen) and seen

    got = detection.flat_chain(found.exports)
    cur = con.execute(louvain_sql())
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == want and want[1]
