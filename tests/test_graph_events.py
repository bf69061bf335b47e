import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseweave.functions.hashing import string_hash32
from pulseweave.lineage import broadcast_if_small, plan_bytes, shared_dir
from pulseweave.operators import enrich as en
from pulseweave.operators import events as ev
from pulseweave.operators import graph as gr
from pulseweave.operators import serving as sv
from pulseweave.operators import textjobs as tj
from pulseweave.sources.exports import as_messages, event_export_sink
from tests import oracles

EDGE = "g long, source string, target string, weight double"


def edges_of(spark, edges, g=1):
    return spark.createDataFrame([(g, a, b, float(w)) for a, b, w in edges], EDGE)


def parts(rows):
    out = {}
    for r in rows:
        out.setdefault((r.g, r.community), set()).add(r.node)
    return sorted(map(sorted, out.values()))


TRIANGLES = [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("d", "e", 1), ("e", "f", 1), ("d", "f", 1)]


def test_two_triangles(spark):
    bridge = TRIANGLES + [("c", "d", 0.5)]
    both = edges_of(spark, bridge, 1).unionByName(edges_of(spark, [("a", "b", 1)], 2))
    got = parts(gr.louvain_communities(both).collect())
    assert got == [["a", "b"], ["a", "b", "c"], ["d", "e", "f"]]


def test_planted_graph_modularity(spark):
    rng = np.random.default_rng(5)
    edges = []
    for i in range(60):
        for j in range(i + 1, 60):
            if rng.random() < (0.5 if i // 12 == j // 12 else 0.03):
                edges.append((f"n{i:02d}", f"n{j:02d}", float(rng.integers(1, 4))))
    df = edges_of(spark, edges)
    part = gr.louvain_communities(df)
    got = {r.node: r.community for r in part.collect()}
    assert set(got) == {n for a, b, _ in edges for n in (a, b)}
    q = oracles.modularity(edges, got)
    assert q >= 0.9 * oracles.modularity(edges, oracles.greedy_communities(edges))
    assert gr.modularity(df, part).first().modularity == pytest.approx(q)


def test_nodes_are_rated_where_their_links_are(spark):
    """Options kept by node give the wishes of the joins, without a shuffle of links; a hub leaves them as written."""
    rng = np.random.default_rng(7)
    links = {(g, f"n{i}", f"n{j}") for g, i, j in rng.integers(0, (2, 60, 60), (900, 3)).tolist() if i != j}
    rows = [(g, a, b, float(rng.integers(1, 4))) for g, a, b in sorted(links)]
    links = spark.createDataFrame(rows, "g long, n string, m string, w double")
    nodes = links.groupBy("g", "n").agg(F.sum("w").alias("k")).withColumn("two_m", F.lit(900.0))
    state = nodes.withColumn("c", F.concat(F.lit("n"), (F.xxhash64("g", "n") % 9).cast("string")))
    options, by_node = gr._by_node(links, state)
    assert by_node and {"k", "two_m"} <= set(options.columns)
    some = state.where("pmod(xxhash64(n), 3) = 0")
    for active in (state, some):
        want = sorted(map(tuple, gr._wishes(state, active, options).collect()))
        wishes = gr._wishes_in_place(state, active, options)
        assert sorted(map(tuple, wishes.collect())) == want and len(want) > 20
    options.unpersist()


def test_a_hub_is_not_kept_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(gr, "LINKS_PER_TASK", 100)
    star = [("hub", f"n{i}", 1) for i in range(400)] + TRIANGLES
    seen = gr.both_ways(gr.undirected(edges_of(spark, star)))
    state = seen.groupBy("g", "n").agg(F.sum("w").alias("k")).select("g", "n", "k", F.lit(1.0).alias("two_m"), F.col("n").alias("c"))
    assert not gr._by_node(seen, state)[1]
    got = parts(gr.louvain_communities(edges_of(spark, star)).collect())
    assert ["a", "b", "c"] in got and sorted(map(len, got)) == [3, 3, 401]


@pytest.mark.parametrize("kind, name", [("string", lambda i: None if i % 37 == 36 else f"n{i}"), ("long", lambda i: None if i % 37 == 36 else i * 7 - 50)])
def test_rounds_in_numbers_are_those_of_the_joins(spark, monkeypatch, kind, name):
    """The same communities from the driver's numbers as from joined tables, also with null ids and weights; a round writes no table."""
    rng = np.random.default_rng(3)
    rows = [(i % 4 or None, name(int(a)), name(int(b)), float(rng.integers(1, 9)) / 3 if i % 31 else None) for i, (a, b) in enumerate(rng.integers(0, 80, (900, 2)))]
    edges = spark.createDataFrame(rows, f"g long, source {kind}, target {kind}, weight double")
    pairs = gr.materialize(gr.undirected(edges), "pairs")
    start = gr.neighbour_partition(edges) if kind == "long" else None
    written, plain = [], gr.materialize
    with monkeypatch.context() as patch:
        patch.setattr(gr, "materialize", lambda df, label: written.append(label) or plain(df, label))
        got = gr._local_moves(pairs, start)
    assert written == ["graph-state", "graph-links", "graph-numbers", "graph-state"]
    monkeypatch.setattr(gr, "NUMBERED_NODES", -1)
    want = gr._local_moves(pairs, start)
    assert got.schema == want.schema
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_turns_are_those_of_spark(spark):
    rows = spark.range(200).select(F.xxhash64("id").alias("h"), *[F.pmod(F.xxhash64("id", F.lit(t)), F.lit(2)).alias(str(t)) for t in range(5)]).collect()
    hashes = np.array([r["h"] for r in rows]).view(np.uint64)
    for t in range(5):
        assert gr._turn_bits(hashes, t).tolist() == [r[str(t)] for r in rows]


def test_blocks_hold_all_links(monkeypatch):
    monkeypatch.setattr(gr, "BLOCK_LINKS", 7)
    links = sorted({(int(a) ** 2 // 9, int(b)) for a, b in np.random.default_rng(4).integers(0, 12, (90, 2))})
    batch = gr.pa.RecordBatch.from_pydict({"i": [a for a, _ in links], "j": [b for _, b in links], "w": [a + b / 100 for a, b in links]})
    blocks = [x for b in gr._packed(iter([batch.slice(40), batch.slice(0, 40)])) for x in gr._blocks(b)]
    assert [(a, b, w) for i, at, j, ws in blocks for a, b, w in zip(i[at].tolist(), j.tolist(), ws.tolist())] == [(a, b, a + b / 100) for a, b in links]
    nodes = [n for i, *_ in blocks for n in i.tolist()]
    assert len(nodes) == len(set(nodes)) and len(blocks) > 5 and all(len(j) <= 7 or len(i) == 1 for i, _, j, _ in blocks)


def test_long_path_and_lone_nodes(spark):
    edges = [(f"n{i:04d}", f"n{i + 1:04d}", 1.0) for i in range(300)]
    nodes = spark.createDataFrame([(1, "alone"), (1, "n0003"), (2, "other")], "g long, node string")
    part = gr.louvain_communities(edges_of(spark, edges), nodes=nodes)
    got = {(r.g, r.node): r.community for r in part.collect()}
    assert len(got) == 303 and got[1, "alone"] == "alone" and got[2, "other"] == "other"
    own = {n: c for (g, n), c in got.items() if n.startswith("n")}
    assert oracles.modularity(edges, own) >= 0.97 * oracles.modularity(edges, oracles.greedy_communities(edges))


def test_init_partition_is_used(spark):
    init = spark.createDataFrame([(1, n, "z") for n in "abc"] + [(1, n, "y") for n in "def"], "g long, node string, community string")
    assert parts(gr.louvain_communities(edges_of(spark, TRIANGLES), init).collect()) == [["a", "b", "c"], ["d", "e", "f"]]


def test_modularity_with_loop(spark):
    edges = [("a", "a", 2), ("a", "b", 1), ("b", "c", 3)]
    part = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 1)], "g long, node string, community int")
    want = oracles.modularity(edges, {"a": 0, "b": 1, "c": 1})
    assert gr.modularity(edges_of(spark, edges), part).first().modularity == pytest.approx(want)


@pytest.mark.parametrize("text, want", [("", 0), ("a", 97), ("user_1", -266160053), ("日本", 837465)])
def test_string_hash(spark, text, want):
    def plain(s):
        h = 0
        for ch in s:
            h = (h * 31 + ord(ch)) & 0xFFFFFFFF
        return h - (1 << 32) if h >= 1 << 31 else h

    got = spark.range(1).select(string_hash32(F.lit(text))).first()[0]
    assert got == plain(text)


def test_user_network(spark):
    authors = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "event_id int, author string")
    follows = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "x"), ("a", "a")], "follower string, followed string")
    nodes, links = gr.user_network(authors, follows)
    assert sorted(r.name for r in nodes.collect()) == ["a", "b"] and links.count() == 1


def test_user_network_of_many_events(spark, tmp_path):
    """Followers are dealt over all tasks, and a pair is looked at once, however many events have it."""
    from workload import tags

    spark.range(60).selectExpr("id AS event_id", "id % 30 AS user_id").write.parquet(str(tmp_path / "events.parquet"))
    follows = tags.follows(spark, str(tmp_path))
    assert follows.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    known = {e: {f"user_{u}" for u in range(30) if (u * 3 + e) % 4} for e in range(5)}
    authors = spark.createDataFrame([(e, u) for e, us in known.items() for u in us] * 2, "event_id int, author string")
    pairs = {tuple(sorted(p)) for p in map(tuple, follows.collect())}
    want = sorted((e, a, b) for e, us in known.items() for a, b in pairs if a in us and b in us)
    nodes, links = gr.user_network(authors, follows)
    ids = {(r["event_id"], r["id"]): r["name"] for r in nodes.collect()}
    assert sorted((r["event_id"], ids[r["event_id"], r["source"]], ids[r["event_id"], r["target"]]) for r in links.collect()) == want
    assert len(ids) == len({(e, x) for e, *p in want for x in p}) and len(want) > 100


def events_of(spark, rows):
    return spark.createDataFrame(rows, "event_id string, start_time_ms long, end_time_ms long")


def test_user_network_hashes_an_author_once(spark):
    """Relations are numbers: no name is hashed or sorted per link. Null and repeated rows, and both directions, are one link."""
    import itertools

    rng = np.random.default_rng(11)
    names = [f"u{i}" for i in range(12)] + [None]
    who = [(f"e{i % 3}" if i % 9 else None, names[k]) for i, k in enumerate(rng.integers(0, 13, 60).tolist())]
    edges = [(names[a], names[b]) for a, b in rng.integers(0, 13, (70, 2)).tolist()] + [("u1", "u1"), ("u1", "stranger")]
    authors = spark.createDataFrame(who, "event_id string, author string")
    follows = spark.createDataFrame(edges + edges[:9], "follower string, followed string")
    nodes, links = gr.user_network(authors, follows)
    either, want, related = {frozenset(e) for e in edges if None not in e}, [], set()
    hashes = {r["author"]: r["h"] for r in authors.select("author", string_hash32(F.col("author")).alias("h")).collect()}
    for event in ("e0", "e1", "e2"):
        for a, b in itertools.combinations(sorted({x for e, x in who if e == event and x}), 2):
            if frozenset((a, b)) in either:
                want.append((event, hashes[a], hashes[b]))
                related |= {(event, hashes[a], a), (event, hashes[b], b)}
    assert len(want) > 20 and sorted(map(tuple, links.collect())) == sorted(want)
    assert sorted(map(tuple, nodes.collect())) == sorted(related)
    for found in (nodes, links):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan and "UTF-16BE" not in plan


def test_only_the_window_before_matches(spark):
    now = events_of(spark, [("n", 100, 199)])
    prior = events_of(spark, [("p", 0, 99), ("q", 0, 98)])
    tags = lambda *r: spark.createDataFrame(list(r), "event_id string, term string, weight long")
    got = ev.match_prior_events(now, tags(("n", "x", 5)), prior, tags(("p", "x", 2), ("q", "x", 9))).first()
    assert got.sibling_id == "p"
    none = ev.match_prior_events(now, tags(("n", "x", 5)), prior, tags(("p", "y", 2))).first()
    assert none.sibling_id is None


def test_export_falls_back(spark, capsys):
    events = spark.createDataFrame(
        [("e1", 0, 1500, 9), ("e2", 0, 1500, 9), ("e3", 0, 1500, 9)],
        "event_id string, start_time_ms long, end_time_ms long, topic_message_count long",
    )
    terms = "event_id string, term string, weight long, rank int"
    tags = spark.createDataFrame([("e1", "t1", 5, 1), ("e1", "t2", 4, 2)], terms)
    words = spark.createDataFrame([("e1", "w", 9, 1), ("e2", "w2", 9, 1), ("e2", "w3", 8, 2)], terms)
    camps = spark.createDataFrame([("e1", "100", 0.9), ("e1", "200", 0.5), ("e2", "100", 0.8), ("e3", "1", 0.71)], "event_id string, campaign string, share double")
    locs = spark.createDataFrame([("e1", "far", 1.0, 2.0, 5.0), ("e1", "near", 3.0, 4.0, 6.0)], "event_id string, label string, lat double, lng double, weight double")
    rows = ev.export_events(events, tags, words, camps, locs)
    got = {r.uid: r for r in rows.collect()}
    assert (got["e1"].label, got["e1"].hashtags, got["e1"].location.coordinates) == ("t1", ["t1", "t2"], [4.0, 3.0])
    assert (got["e2"].label, got["e2"].hashtags, got["e2"].location) == ("w2", ["w2"], None)
    assert (got["e3"].label, got["e3"].hashtags) == ("None", [])
    assert got["e1"].startDate == "1970-01-01T00:00:00" and got["e1"].endDate == "1970-01-01T00:00:01.500000"
    event_export_sink(rows, "print", "t")
    assert capsys.readouterr().out.count('"uid"') == 3 and as_messages(rows).columns == ["value"]


def test_place_label_and_weight(spark):
    row = spark.createDataFrame([("c", None, "k")], "a string, b string, c string").select(
        ev.place_label(F.col("a"), F.col("b"), F.col("c")), ev.place_weight(F.col("a"), F.col("b"), F.col("c"))
    ).first()
    assert row[0] == "c  k " and row[1] == pytest.approx(1.05)


def test_og_image_and_profile(spark):
    page = '<html><head><meta property="og:image" content="http://i/{}"></head></html>'
    rows = spark.createDataFrame(
        [("https://www.instagram.com/p/1", page.format("a.jpg")), ("https://twitter.com/x", page.format("Profile/a.jpg")),
         ("https://else.com/x", page.format("b.jpg"))], "url string, html string",
    )
    got = tj.page_open_graph(rows, ["instagram.com", "twitter.com"]).collect()
    assert [(r.domain, r.image_url) for r in got] == [("instagram.com", "http://i/a.jpg")]


def test_entities_longest_run(spark):
    docs = spark.createDataFrame([(1, "In New York City, York"), (2, "")], "id int, text string")
    names = spark.createDataFrame([("new york city", "LOCATION"), ("york", "PERSON"), ("in new", "DATE")], "label string, tag string")
    got = en.extract_entities(docs, "id", "text", names)
    assert sorted((r.id, r.label) for r in got.collect()) == [(1, "in new"), (1, "new york city"), (1, "york")]
    assert en.extract_entities(docs, "id", "text", names, "LOCATION").count() == 1


def test_unknown_enricher():
    with pytest.raises(KeyError):
        en.enricher("none")


def test_search_lists_event_once(spark):
    events = events_of(spark, [("e", 0, 1), ("f", 0, 1)])
    tags = spark.createDataFrame([("e", "Fire")], "event_id string, term string")
    posts = spark.createDataFrame([("e", "FIRE here", "fireman"), ("f", "calm", None)], "event_id string, text string, screen_name string")
    assert [r.event_id for r in sv.search_events(events, tags, posts, "fire").collect()] == ["e"]


def test_broadcast_only_below_limit(spark):
    df = spark.range(1000)
    assert plan_bytes(df) == 8000
    other = spark.range(10).withColumnRenamed("id", "x")
    plan = lambda d: other.join(d, F.col("x") == F.col("id"))._jdf.queryExecution().toString()
    assert "strategy=broadcast" in plan(broadcast_if_small(df, 8000))
    assert "strategy=broadcast" not in plan(broadcast_if_small(df, 7999))


class Session:
    """Just enough of a session to be asked for its folder."""

    def __init__(self, folder, master):
        self.conf, self.sparkContext = {"spark.checkpoint.dir": folder}, self
        self.master, self.applicationId = master, "app"


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(Session("hdfs:///scratch/", "yarn")) == "hdfs:///scratch/pulseweave-scratch/app"
    with pytest.raises(RuntimeError):
        shared_dir(Session(None, "yarn"))
    assert shared_dir(spark) == shared_dir(spark)


def test_messages_are_delivered_once(spark, tmp_path):
    """Two deliveries add up, attempts that do not win leave nothing, and broken tasks abort."""
    from pulseweave.sources.exports import MessageWriter, read_messages

    rows = spark.range(500).select("id", F.concat(F.lit("é\n"), F.col("id").cast("string")).alias("text")).repartition(7)
    for _ in range(2):
        event_export_sink(rows, str(tmp_path), "events")
    got = read_messages(rows, f"{tmp_path}/events")
    assert got.count() == 1000 and got.distinct().exceptAll(rows).count() == 0 and got.where("text IS NULL").count() == 0
    writer = MessageWriter(f"{tmp_path}/retry")
    first, second = (writer.write(iter(as_messages(rows.limit(3)).collect())) for _ in range(2))
    writer.commit([second, None])
    names = sorted(f.name for f in (tmp_path / "retry").iterdir())
    assert names == sorted([second.name, "_SUCCESS"]) and first.name != second.name
    writer.write(iter(as_messages(rows.limit(3)).collect()))
    writer.abort([None])
    assert sorted(f.name for f in (tmp_path / "retry").iterdir()) == names
    event_export_sink(rows.limit(0), str(tmp_path), "none")
    assert (tmp_path / "none" / "_SUCCESS").exists()


def test_keywords_and_urls_of_counted_words(spark):
    """Counts of words give what the words give; a post's words become rows in its clusters only."""
    text = "storm storm storm coast coast www.a.org the #tag http://b.org"
    rows = [("e1", f"c{c}", p, "text", text, "en") for c in range(2) for p in range(3)] + [("e2", "c9", 9, "text", None, "en")]
    posts = spark.createDataFrame(rows, "event_id string, cluster_id string, post_id long, data_type string, text string, lang string")
    words = ev.event_words(posts)
    counts = ev.word_counts(words)
    assert words.count() == 6 * 8 and counts.count() == 2 * 5 and counts.agg(F.sum("n")).first()[0] == 6 * 8
    for get in (ev.event_keywords, ev.event_urls):
        assert sorted(map(tuple, get(counts).collect())) == sorted(map(tuple, get(words).collect())) != []
    assert [(r.term, r.weight) for r in ev.event_keywords(counts).orderBy("rank").collect()] == [("storm", 18), ("coast", 12)]
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join")
