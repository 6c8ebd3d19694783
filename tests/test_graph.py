"""Entities, relations, coreference, fence and analytics on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from fencegraph import vocab
from fencegraph.functions import text as X
from fencegraph.functions.ranking import number_by_range, number_rows, running_total
from fencegraph.operators import analytics as G
from fencegraph.operators import coref, fence, quality
from fencegraph.operators import entities as E
from fencegraph.operators import relations as T1

MENTION = "work_id long, chapter_ordinal int, mention_id long, surface string, type string, subtype string, char_start int, char_end int"


def mentions(spark, rows):
    """rows of (surface, type, chapter)"""
    data = [(1, c, i, s, t, None, i * 10, i * 10 + len(s)) for i, (s, t, c) in enumerate(rows, 1)]
    return spark.createDataFrame(data, MENTION)


def test_surface_forms(spark):
    df = spark.createDataFrame([("the Heron",), ('  "Mara," ',), ("A Sky",), ("An  Odd\tOne",), ("the the Heron",), ("...",)], "s string")
    assert [r[0] for r in df.select(X.normalize_surface(F.col("s"))).collect()] == ["heron", "mara", "sky", "odd one", "the heron", ""]


def test_clusters(spark):
    m = mentions(spark, [
        ("Mara", "Character", 1), ("Mara", "Character", 1), ("Ashford", "Place", 1), ("the Ring", "Organization", 1), ("Ring", "Organization", 2),
        ("Lady Orsa", "Character", 3), ("Orsa", "Character", 3),
    ])
    nodes, linked = E.resolve(m)
    got = {r.name: (r.type, r.importance, r.first_seen_chapter) for r in nodes.collect()}
    assert got == {"Mara": ("Character", 2.0, 1), "Ashford": ("Place", 1.0, 1), "the Ring": ("Organization", 2.0, 1), "Lady Orsa": ("Character", 2.0, 3)}
    assert linked.filter("node_id IS NULL").count() == 0


def test_majority_type_and_generic_names(spark):
    m = mentions(spark, [("Ashford", "Place", 1), ("Ashford", "Organization", 1), ("Ashford", "Place", 2), ("King", "Character", 1), ("King Oren", "Character", 1)])
    nodes, _ = E.resolve(m)
    assert {(r.name, r.type) for r in nodes.collect()} == {("Ashford", "Place"), ("King", "Character"), ("King Oren", "Character")}


def greedy_hosts(names):
    """names: norm -> (tokens, members, first position); visits long and frequent names first."""
    hosts, out = [], {}
    for n, (tok, _, _) in sorted(names.items(), key=lambda kv: (-len(kv[1][0]), -kv[1][1], kv[1][2])):
        host = next((h for h in hosts if tok < names[h][0] and not tok <= set(vocab.GENERIC_NAME_TOKENS)), None)
        out[n] = host or n
        if host is None:
            hosts.append(n)
    return out


def test_folding_matches_the_greedy_rule(spark):
    rnd = random.Random(3)
    words = ["lady", "king", "ash", "oren", "mara", "vale", "ring"]
    names = {}
    for i in range(90):
        tok = rnd.sample(words, rnd.randint(1, 4))
        names.setdefault(" ".join(tok), (set(tok), rnd.randint(1, 5), i))
    df = spark.createDataFrame([(1, n, "Character", m, p, sorted(t)) for n, (t, m, p) in names.items()],
                               "work_id long, norm string, type string, members long, first_pos long, tokens array<string>")
    assert {r.norm: r.host for r in E.fold_names(df).collect()} == greedy_hosts(names)


def test_result_does_not_depend_on_partitioning(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["Mara", "Lady Mara", "Oren", "King Oren", "the Vale"]), rnd.choice(["Character", "Place"]), rnd.randint(1, 4)) for _ in range(200)]
    m = mentions(spark, rows)
    a, b = E.resolve(m)[0], E.resolve(m.repartition(7).orderBy(F.rand(1)))[0]
    assert sorted(a.collect()) == sorted(b.collect())


def linked(spark, rows):
    """rows of (node_id, type, chapter, start, end)"""
    data = [(1, c, i, n, t, s, e) for i, (n, t, c, s, e) in enumerate(rows, 1)]
    return spark.createDataFrame(data, "work_id long, chapter_ordinal int, mention_id long, node_id long, node_type string, char_start int, char_end int")


def test_structural_edges(spark):
    text = "Mara led the Ring in Ashford."
    ch = spark.createDataFrame([(1, 1, text)], "work_id long, ordinal int, clean_text string")
    m = linked(spark, [(1, "Character", 1, 0, 4), (2, "Organization", 1, 9, 17), (3, "Place", 1, 21, 28)])
    e = {(r.source_id, r.relation, r.target_id) for r in T1.build_structural(m, ch).collect()}
    assert e == {(1, "LeaderOf", 2), (1, "LocatedIn", 3), (2, "LocatedIn", 3)}
    far = linked(spark, [(1, "Character", 1, 0, 4), (3, "Place", 1, 404, 414)])
    assert T1.build_structural(far, ch).count() == 0


@pytest.mark.parametrize("window", [0, 7, 250])
def test_band_join_is_exact(spark, window):
    rnd = random.Random(window)
    rows = []
    for _ in range(300):
        s = rnd.randint(0, 900)
        rows.append((rnd.randint(1, 9), "Item", rnd.randint(1, 2), s, s + rnd.randint(1, 40)))
    got = sorted((r.a_mention_id, r.b_mention_id) for r in T1.band_pairs(linked(spark, rows), window).collect())
    ms = [(i, *r) for i, r in enumerate(rows, 1)]
    want = sorted((a[0], b[0]) for a in ms for b in ms if a[3] == b[3] and a[1] != b[1] and (a[4], a[0]) < (b[4], b[0]) and b[4] - a[5] <= window)
    assert got == want


NODE = "work_id long, node_id long, type string, name string, subtype string, importance double, first_seen_chapter int, revealed_chapter int, method string, evidence string"
EDGE = "work_id long, edge_id long, source_id long, target_id long, relation string, tier int, first_seen_chapter int, revealed_chapter int, method string, evidence string"


def nodes_df(spark, rows, work=1):
    return spark.createDataFrame([(work, i, t, n, None, float(imp), rev, rev, "gliner", None) for i, t, n, imp, rev in rows], NODE)


def edges_df(spark, rows, work=1):
    return spark.createDataFrame([(work, i, s, t, rel, vocab.RELATION_TIER[rel], rev, rev, "rule", "ev") for i, s, t, rel, rev in rows], EDGE)


def knobs(spark, pov="Sol", on=True):
    return spark.createDataFrame([(1, on, pov, None)], "work_id long, merge_on boolean, pov string, surfaces array<string>")


def coref_case(spark):
    n = nodes_df(spark, [(1, "Character", "Sol", 10, 1), (2, "Character", "you", 2, 1), (3, "Character", "I", 1, 1), (4, "Concept", "Dread", 3, 1),
                         (5, "Place", "Vale", 3, 1), (6, "Item", "Sword", 1, 1), (7, "Character", "the younger guard", 1, 1)])
    e = edges_df(spark, [(1, 1, 4, "RelatedTo", 4), (2, 2, 4, "RelatedTo", 2), (3, 2, 5, "RelatedTo", 2), (4, 3, 6, "RelatedTo", 4), (5, 2, 1, "RelatedTo", 2)])
    m = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 4)], "work_id long, mention_id long, node_id long")
    return n, e, m


def test_coref_folds_pronouns(spark):
    n, e, m = coref_case(spark)
    n2, e2, m2, rep = coref.merge(n, e, m, knobs(spark))
    r = rep.collect()[0]
    assert (r.pov_character, r.nodes_merged, r.edges_deduped, r.edges_repointed, r.self_loops_removed, r.mentions_repointed, r.ambiguous_left) == ("Sol", 2, 1, 2, 1, 2, 1)
    assert sorted((x.edge_id, x.source_id, x.target_id, x.revealed_chapter) for x in e2.collect()) == [(1, 1, 4, 2), (3, 1, 5, 2), (4, 1, 6, 4)]
    assert sorted(x.node_id for x in m2.collect()) == [1, 1, 4]
    again = coref.merge(n2, e2, m2, knobs(spark))
    assert again[3].collect()[0].skipped_reason == "no self-reference pronoun nodes"
    assert sorted(again[1].select("edge_id").collect()) == sorted(e2.select("edge_id").collect())


def test_remaining_nodes_and_repointed_mentions_need_no_edges(spark, monkeypatch):
    from fencegraph.catalog import relation_queries as Q

    d = "/root/testdata/sf0.001"
    nodes, _, mentions, _ = Q.merged(spark, d)
    want = [sorted(nodes.select("work_id", "node_id").collect()), sorted(mentions.select("work_id", "mention_id", "node_id").na.fill(-1).collect())]
    folded = coref.folding(Q.doc_nodes(spark, d), Q.knobs(spark, d))[1].count()
    assert folded and len(want[0]) == Q.doc_nodes(spark, d).count() - folded

    def built(*_):
        raise AssertionError("built without need")

    monkeypatch.setattr(Q, "edges1", built)
    monkeypatch.setattr(Q, "doc_nodes", built)
    assert sorted(Q.repointed_mentions(spark, d).na.fill(-1).collect()) == want[1]
    monkeypatch.setattr(Q, "linked", built)
    assert sorted(Q.remaining_nodes(spark, d).collect()) == want[0]


def test_coref_skips(spark):
    n, e, m = coref_case(spark)
    assert coref.merge(n, e, m, None)[3].collect()[0].skipped_reason == "disabled"
    tied = n.withColumn("importance", F.when(F.col("node_id") == 7, 10.0).otherwise(F.col("importance")))
    assert coref.merge(tied, e, m, knobs(spark, pov=""))[3].collect()[0].skipped_reason == "no unambiguous POV character"
    assert coref.merge(n, e, m, knobs(spark, pov=""))[3].collect()[0].pov_character == "Sol"
    assert coref.merge(n, e, m, knobs(spark, pov="Nobody"))[3].collect()[0].pov_character is None


def demo(spark):
    """Layered reveals: one pair holds a structural and two identity edges at different chapters."""
    n = nodes_df(spark, [(1, "Character", "Mara", 9, 1), (2, "Place", "Ashford", 5, 1), (3, "Character", "Prince Oren", 8, 2), (4, "Character", "the Gull", 4, 3), (5, "Event", "Truce", 2, 4)])
    e = edges_df(spark, [(1, 1, 2, "LocatedIn", 1), (2, 1, 3, "SECRET_IDENTITY", 2), (3, 4, 2, "LocatedIn", 1), (4, 1, 3, "TRANSMIGRATED_INTO", 4), (5, 3, 5, "ParticipatedIn", 4)])
    p = spark.createDataFrame(
        [(1, 1, 3, "fate", "drowned", 2, 2, "llm", None), (1, 2, 1, "origin", "elsewhere", 4, 4, "llm", None), (1, 3, 5, "kind", "feast", 1, 1, "llm", None), (1, 4, 3, "fate", "alive", 3, 3, "llm", None)],
        "work_id long, prop_id long, node_id long, key string, value string, first_seen_chapter int, revealed_chapter int, method string, evidence string",
    )
    return n, e, p


def test_fence(spark):
    n, e, p = demo(spark)
    sizes = {k: (fence.visible_nodes(n, k).count(), fence.visible_edges(e, n, k).count(), fence.visible_properties(p, n, k).count()) for k in range(6)}
    assert sizes == {0: (0, 0, 0), 1: (2, 1, 0), 2: (3, 2, 1), 3: (4, 3, 2), 4: (5, 5, 4), 5: (5, 5, 4)}
    eff = fence.with_effective_reveal(e, n)
    for k in range(6):
        assert sorted(r.edge_id for r in fence.visible_edges(eff, n, k).collect()) == sorted(r.edge_id for r in fence.visible_edges(e, n, k).collect())
    assert {(r.chapter, r.appearing, r.visible) for r in fence.timeline(eff, "effective_reveal").collect()} == {(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 2, 5)}
    assert fence.audit(e, n).collect()[0].violations == 0
    for bad in (-1, None, 2.5, True):
        with pytest.raises(ValueError):
            fence.visible_nodes(n, bad)


def test_projection_collapses_parallel_edges(spark):
    n, e, p = demo(spark)
    vn, ve = fence.project(n, e, p, 4)
    assert {r.relation for r in ve.filter("source_id = 1 AND target_id = 3").collect()} == {"TRANSMIGRATED_INTO"}
    assert {r.relation for r in fence.project(n, e, p, 3)[1].filter("source_id = 1 AND target_id = 3").collect()} == {"SECRET_IDENTITY"}
    assert fence.project(n, e, p, 4, collapse=False)[1].count() == 5
    assert {r.node_id: r.properties for r in vn.collect()}[3] == {"fate": "alive"}
    lines = fence.payload_lines(vn, ve).collect()
    assert len(lines) == 9 and all('"data"' in r.json for r in lines)


def test_entity_details(spark):
    n, e, p = demo(spark)
    req = spark.createDataFrame([(1, 3, 1), (1, 3, 2), (1, 1, 4)], "work_id long, node_id long, n int")
    rows = fence.entity_details(req, n, fence.with_effective_reveal(e, n), p).collect()
    got = sorted((r.node_id, r.n, r.part, r.id) for r in rows)
    assert got == [(1, 4, "edge", 1), (1, 4, "edge", 2), (1, 4, "edge", 4), (1, 4, "node", 1), (1, 4, "property", 2), (3, 2, "edge", 2), (3, 2, "node", 3), (3, 2, "property", 1)]


def test_paths_match_a_queue_search(spark):
    rnd = random.Random(11)
    pairs = sorted({(rnd.randint(1, 30), rnd.randint(1, 30)) for _ in range(40)})
    rnd.shuffle(pairs)
    e = edges_df(spark, [(i, s, t, "RelatedTo", 1) for i, (s, t) in enumerate(pairs, 1)])
    order = sorted((s, i, t) for i, (s, t) in enumerate(pairs, 1))
    adj = {}
    for s, i, t in order:
        adj.setdefault(s, []).append((t, i))
        adj.setdefault(t, []).append((s, i))

    def search(a, b):
        prev, queue = {a: None}, [a]
        for cur in queue:
            for to, i in adj.get(cur, []):
                if to not in prev:
                    prev[to] = (cur, i)
                    queue.append(to)
        if b not in prev:
            return None
        ids, ns = [], [b]
        while b != a:
            b, i = prev[b]
            ids.append(i)
            ns.append(b)
        return ns[::-1], ids[::-1]

    asks = [(k, rnd.randint(1, 30), rnd.randint(1, 32)) for k in range(40)]
    got = G.shortest_paths(spark.createDataFrame(asks, "request_id int, start_id long, end_id long"), e).collect()
    assert len(got) == 40
    for r in got:
        want = search(r.start_id, r.end_id)
        assert (None if r.hops is None else (list(r.node_ids), list(r.edge_ids))) == want


def test_view_filters(spark):
    n, e, _ = demo(spark)
    d = {r.node_id: r.degree for r in G.degrees(n, e).collect()}
    assert d == {1: 3, 2: 2, 3: 3, 4: 1, 5: 1}
    nd, shown = G.view(n, e, min_degree=2)
    assert {r.node_id for r in nd.filter("hidden").collect()} == {4, 5} and shown.count() == 3
    assert G.view(n, e, min_degree=50)[0].filter("NOT hidden").count() == 2  # clamped to the highest degree
    low = n.withColumn("name", F.lower("name"))
    assert G.view(low, e, min_degree=0)[0].filter("hidden").count() == 3
    c = G.connections(n, e).filter("node_id = 1").orderBy(F.desc("tier"), "chapter", "label").collect()
    assert [(r.label, r.step_label, r.outgoing) for r in c] == [("Prince Oren", "secret identity", True), ("Prince Oren", "transmigrated into", True), ("Ashford", "in", True)]


def test_quality(spark):
    n, e, _ = demo(spark)
    assert quality.node_vocabulary(n).count() == 0 and quality.edge_vocabulary(e).count() == 0
    assert quality.edge_vocabulary(e.withColumn("tier", F.lit(1))).count() == 2
    assert quality.dangling(e, "target_id", n.filter("node_id <> 5"), "node_id").count() == 1


def test_numbering_of_a_hot_key(spark):
    rows = [(1 if i % 3 else i, i * 37 % 1009) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, v long")
    want = {}
    for k, v in sorted(rows):
        want[(k, v)] = want.get((k, "n"), 0) + 1
        want[(k, "n")] = want[(k, v)]
    by_bucket = number_rows(df, ["k"], F.floor(F.col("v") / 50), [F.col("v")], "no").collect()
    by_range = number_by_range(df, ["k"], ["v"], "no").collect()
    for got in (by_bucket, by_range):
        assert len(got) == 900 and all(r.no == want[(r.k, r.v)] for r in got)
    total = running_total(df.filter("k = 1"), ["k"], "v", "v", "t", block=16).collect()
    assert all(r.t == sum(v for k, v in rows if k == 1 and v <= r.v) for r in total)


def test_position_columns_are_checked(spark):
    nodes = spark.createDataFrame([(1, 10, 2)], "work_id long, node_id long, revealed_chapter int")
    asked = lambda n: fence.visible_nodes(nodes.withColumn("n", F.lit(n).cast("int")), F.col("n")).collect()
    assert len(asked(2)) == 1 and asked(1) == []
    for wrong in (-1, None):
        with pytest.raises(Exception, match="reading position"):
            asked(wrong)


def test_connections_in_list_order(spark):
    conns = spark.createDataFrame(
        [(1, 5, 1, 1, 3, "b"), (1, 5, 2, 3, 9, "z"), (1, 5, 3, 3, 2, "y"), (1, 5, 4, 1, 3, "a"), (1, 5, 6, 1, 3, "a"), (1, 6, 5, 2, 1, "c")],
        "work_id long, node_id long, edge_id long, tier int, chapter int, label string",
    )
    got = {(r.node_id, r.place): r.edge_id for r in G.in_list_order(conns).collect()}
    assert got == {(5, 1): 3, (5, 2): 2, (5, 3): 4, (5, 4): 6, (5, 5): 1, (6, 1): 5}


def test_star_edges_are_stamped_as_by_joins_with_the_nodes(spark):
    """The star graph finds the reveal of an edge's ends where its lines lie; joins of every edge with the nodes gave the same."""
    from fencegraph.sources import adaptors as A

    d = "/root/testdata/sf0.001"
    lines = A.star_lines(spark, d).cache()
    nodes = A.star_nodes(spark, d, lines).cache()
    edges = A.star_edges(spark, d, lines, nodes).cache()
    again = fence.with_effective_reveal(edges.drop("effective_reveal"), nodes)
    assert edges.count() == again.count() > 0
    assert edges.exceptAll(again.select(*edges.columns)).isEmpty()


def test_audit_meets_the_nodes_once(spark):
    """Stamping and auditing the same edges took four joins; with the ends looked up it takes two, with the same counts."""
    nodes = spark.createDataFrame([(1, 10, 5), (1, 11, 2), (1, 12, 9)], "work_id long, node_id long, revealed_chapter int")
    edges = spark.createDataFrame([(1, 10, 11, 3, 5), (1, 11, 12, 4, 6), (1, 11, 13, 1, 1)], "work_id long, source_id long, target_id long, revealed_chapter int, effective_reveal int")
    met = fence.audit(fence.with_ends(edges, nodes), nodes)
    assert met.collect() == fence.audit(edges, nodes).collect()
    assert [(r.edges, r.violations, r.last_position) for r in met.collect()] == [(2, 3, 6)]
    assert met._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 2


def test_long_lists_are_numbered_in_parts_and_short_ones_whole(spark):
    rnd = random.Random(5)
    pairs = [(1, rnd.randint(2, 60)) for _ in range(200)] + [(rnd.randint(2, 60), rnd.randint(2, 60)) for _ in range(150)]
    e = edges_df(spark, [(i, s, t, rnd.choice(["RelatedTo", "Ally", "ALIAS"]), rnd.randint(1, 6)) for i, (s, t) in enumerate(pairs, 1)])
    n = nodes_df(spark, [(i, "Character", f"Name {i % 7}", 1, 1) for i in range(1, 55)])
    conns, ends = G.connections(n, e), G.list_ends(e)
    rows = sorted(conns.collect(), key=lambda r: (r.node_id, -r.tier, r.chapter, r.label, r.edge_id))
    want, seen = [], {}
    for r in rows:
        seen[r.node_id] = seen.get(r.node_id, 0) + 1
        want.append((r.node_id, r.edge_id, r.outgoing, seen[r.node_id]))
    for long, share in ((1, 1), (60, 1), (60, 8), (1 << 16, 64)):  # every list in parts, the hub's alone, as a share tells, none
        got = G.in_list_order(conns, ends, long=long, share=share)
        assert got.columns == [*conns.columns, "place"]
        assert sorted((r.node_id, r.edge_id, r.outgoing, r.place) for r in got.collect()) == sorted(want)


def test_fence_reaches_the_lines_of_the_star_graph(spark, monkeypatch):
    from fencegraph.catalog import analytics_queries as Q
    from fencegraph.catalog import fence_queries as S

    d = "/root/testdata/sf0.001"
    nodes, edges, _ = S.graph(spark, d)
    cols = ["work_id", "source_id", "target_id", "edge_id", "first_edge_id", "relation", "tier", "first_seen_chapter", "revealed_chapter", "effective_reveal"]
    want = fence.collapse_parallel(fence.visible_edges(edges.drop("method", "evidence"), nodes, S.N)).select(*cols).collect()
    shown = ["work_id", "node_id", "type", "name", "first_seen_chapter", "revealed_chapter"]
    seen = fence.visible_nodes(nodes, S.N).select(*shown).collect()

    def built(*_):
        raise AssertionError("lines behind the fence")

    for name in ("star_lines", "star_nodes", "star_edges", "star_properties"):
        monkeypatch.setattr(S, name, built)
    vn, ve = Q.payload(spark, d)
    assert sorted(ve.select(*cols).collect()) == sorted(want)
    assert sorted(vn.select(*shown).collect()) == sorted(seen)
    lines, _ = Q.early(spark, d)
    assert 0 < lines.count() and lines.filter(F.col("chapter") > S.N).isEmpty()
