"""Catalog operators: golden ranks, tiling of pages, traversal, tenancy, ingest, freshness, delivery."""

from __future__ import annotations

import hashlib
import json
import random
from dataclasses import replace

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conceptlake.catalog import Catalog
from conceptlake.errors import Ambiguous, Duplicate, InvalidParameter, NotFound
from conceptlake.functions import tsquery
from conceptlake.operators import documents, embeddings, freshness, graph, lifecycle, packages, provenance, relationships, search, temporal, workspace
from conceptlake.sources import bundle, markdown, normalize, wiki
from conceptlake.streaming import outbox


def doc(title, body, kind="Runbook", description=None, tags=None, more=""):
    head = f"---\ntype: {kind}\ntitle: {title}\n" + (f"description: {description}\n" if description else "") + (f"tags: [{', '.join(tags)}]\n" if tags else "") + more + "---\n"
    return (head + body).encode()


FILES = {
    "runbooks/failover.md": doc("Widget failover", "Promote the standby. Run failover now, then failover back. See [appendix](failover-appendix.md) and [service](/services/widget).", tags=["ops"]),
    "runbooks/failover-appendix.md": doc("Failover appendix", "After failover, and before failover, read [x](https://example.com).", description="Notes on failover", tags=["ops"]),
    "services/widget.md": doc("Widget service", "failover once failover twice failover thrice [home](../runbooks/failover.md#top) [gone](missing.md)", kind="Service"),
    "index.md": b"# no frontmatter here",
}


@pytest.fixture(scope="module")
def golden(spark):
    files = bundle.from_memory(spark, list(FILES), list(FILES.values()))
    tables = bundle.project(bundle.parse(files).cache(), 1)
    bundles = spark.createDataFrame([(1, "golden", True, None)], "bundle_id long, name string, enabled boolean, retired_at timestamp")
    return Catalog(spark, {**tables, "bundles": bundles})


def test_golden_ranks(golden):
    got = {r["concept_id"]: round(r["rank"], 4) for r in search.concept_search(golden, "failover").collect()}
    assert got == {"runbooks/failover-appendix": 1.6, "runbooks/failover": 1.2, "services/widget": 0.3}


def test_phrase_not_and_headline(golden):
    ids = lambda q: {r["concept_id"] for r in search.concept_search(golden, q).collect()}
    assert ids('"failover back"') == {"runbooks/failover"} and ids("failover -standby") == {"runbooks/failover-appendix", "services/widget"}
    assert ids("standby OR thrice") == {"runbooks/failover", "services/widget"} and ids("no(such !word") == set()
    assert ids("-standby") == {"runbooks/failover-appendix", "services/widget"} and ids("thrice OR -failover") == {"services/widget"}
    assert "<b>standby.</b>" in search.concept_search(golden, "standbys").first()["headline"]
    assert ids("failovers") == ids("failover") and ids("the") == set()  # stems; a stop word is nothing to look for


def test_links_and_neighbours(golden):
    links = {(r["source_id"], r["target"]): (r["target_id"], r["resolved"], r["is_external"]) for r in golden.table("links").collect()}
    assert links["runbooks/failover", "/services/widget"] == ("services/widget", True, False)
    assert links["services/widget", "missing.md"] == (None, False, False) and links["runbooks/failover-appendix", "https://example.com"][2]
    got = {r["neighbor_id"]: (r["hops"], r["path"]) for r in graph.concept_neighbors(golden, "runbooks/failover", 2).collect()}
    assert got == {"runbooks/failover-appendix": (1, ["runbooks/failover", "runbooks/failover-appendix"]), "services/widget": (1, ["runbooks/failover", "services/widget"])}


def test_cover_density():
    """One word: its weight; two words: two over their inverse weights, less by what stands between."""
    assert tsquery.parse('a "b c" -d OR e').clauses == (tsquery.Clause((("a",), ("b", "c")), (("d",),)), tsquery.Clause((("e",),), ()))
    with pytest.raises(InvalidParameter):
        tsquery.parse("  ")


def plain_rank(entries, terms):
    """Smallest stretches with all terms: entries (pos, lexeme, weight)."""
    total, last, was = 0.0, {}, None
    entries = sorted(e for e in entries if e[1] in terms)
    for i, (pos, lexeme, _) in enumerate(entries):
        last[lexeme] = i
        if len(last) == len(terms):
            start = min(last.values())
            if start != was:
                part = entries[start : i + 1]
                noise = max(0, pos - part[0][0] - (len(part) - 1))
                total += len(part) / sum(1 / w for _, _, w in part) / (1 + noise)
            was = start
    return total


def test_rank_equals_a_plain_one(spark):
    rng = random.Random(3)
    rows = [(1, f"d{d}", rng.choice("abcd"), p, rng.choice([1.0, 0.4, 0.1])) for d in range(40) for p in range(1, rng.randint(2, 25))]
    index = spark.createDataFrame(rows, "bundle_id long, concept_id string, lexeme string, pos int, weight double")
    for text in ("a b", "a b c", "a"):
        got = {r["concept_id"]: r["rank"] for r in search.rank(index, tsquery.parse(text)).collect()}
        for d in range(40):
            want = plain_rank([(p, x, w) for _, c, x, p, w in rows if c == f"d{d}"], set(text.split()))
            assert got.get(f"d{d}", 0) == pytest.approx(want, abs=1e-5), (text, d)


def test_pages_tile_with_ties(spark):
    rng = random.Random(1)
    rows = [(b, f"c{i}", rng.choice([0.1, 0.4, 1.0])) for b in (1, 2) for i in range(30)]
    df = spark.createDataFrame(rows, "bundle_id long, concept_id string, rank double").withColumn("rank", F.col("rank").cast("float")).cache()
    every = [tuple(r) for r in search.by_rank(df, 500).collect()]
    pages, cursor = [], None
    while page := search.by_rank(df.where(search.after(cursor)), 7).collect():
        pages += [tuple(r) for r in page]
        cursor = search.encode_cursor(page[-1]["rank"], page[-1]["bundle_id"], page[-1]["concept_id"])
    assert pages == every
    with pytest.raises(InvalidParameter):
        search.after("{}")


def test_similar_and_ambiguous(golden):
    first = search.find_similar(golden, "runbooks/failover").collect()
    assert [r["concept_id"] for r in first][0] == "runbooks/failover-appendix" and len(first) == 2
    twice = Catalog(golden.spark, {**golden.tables, "concepts": golden.table("concepts").unionByName(golden.table("concepts").withColumn("bundle_id", F.lit(2).cast("long")))})
    with pytest.raises(Ambiguous):
        search.find_similar(twice, "runbooks/failover")
    with pytest.raises(NotFound):
        search.find_similar(golden, "nothing")
    with pytest.raises(InvalidParameter):
        search.concept_search(golden, "x", limit=501)


def test_index_table_gives_the_same(golden, tmp_path):
    search.build_index(golden.table("concepts"), str(tmp_path / "index"), 4, config="english")
    index = search.read_index(golden.spark, str(tmp_path / "index"))
    for q in ("failover", "failover standby", "widget OR appendix", "-standby"):
        assert search.concept_search(golden, q, index=index).collect() == search.concept_search(golden, q).collect()
    assert search.bm25(golden, "failover widget", index=index).collect() == search.bm25(golden, "failover widget").collect()
    assert search.search_facets(golden, "failover", index=index).collect() == search.search_facets(golden, "failover").collect()
    assert search.find_similar(golden, "runbooks/failover", index=index).collect() == search.find_similar(golden, "runbooks/failover").collect()
    ranked = replace(golden, search_backend="bm25")
    with pytest.warns(UserWarning):
        assert search.ranked_search(ranked, "failover").collect() == search.concept_search(golden, "failover").collect()
    assert {r["concept_id"] for r in search.ranked_search(ranked, "failover", index=index).collect()} == {r["concept_id"] for r in search.concept_search(golden, "failover").collect()}


def test_cycles_and_complete_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "b"), ("b", "c"), ("c", "d"), ("d", "a")], "source_id string, target_id string")
    seeds = spark.createDataFrame([("a",)], "seed string")
    got = {r["node"]: (r["hops"], r["path"]) for r in graph.neighbors(edges, seeds, 5).collect()}
    assert got == {"b": (1, ["a", "b"]), "c": (2, ["a", "b", "c"]), "d": (3, ["a", "b", "c", "d"])}
    full = spark.createDataFrame([(f"n{i}", f"n{j}") for i in range(30) for j in range(30)], "source_id string, target_id string")
    got = graph.neighbors(full, spark.createDataFrame([("n0",)], "seed string"), 5).collect()
    assert len(got) == 29 and {r["hops"] for r in got} == {1}
    with pytest.raises(InvalidParameter):
        graph.neighbors(full, seeds, 0)


RELS = "source_bundle_id long, source_concept_id string, target_bundle_id long, target_concept_id string, relation_type string, direction string, unresolved boolean, tenant_id string"


def test_typed_directions(spark):
    rows = [(1, "a", 1, "b", "x:y", "directed"), (1, "c", 1, "a", "x:y", "directed"), (1, "a", 2, "d", "x:z", "undirected"), (1, "a", 2, "a", "x:y", "directed")]
    rel = spark.createDataFrame([(*r, False, "t") for r in rows] + [(1, "a", 1, "gone", "x:y", "directed", True, "t"), (3, "a", 1, "off", "x:y", "directed", False, "t")], RELS)
    bundles = spark.createDataFrame([(1, True, None), (2, True, None), (3, False, None)], "bundle_id long, enabled boolean, retired_at timestamp")
    c = Catalog(spark, {"relationships": rel, "bundles": bundles})
    ids = lambda bundle, start, **k: {tuple(r)[:2] for r in graph.relationship_neighbors(c, bundle, start, 1, **k).collect()}
    assert ids(1, "a", direction="outbound") == {(1, "b"), (2, "d"), (2, "a")} and ids(1, "a", direction="inbound") == {(1, "c"), (2, "d")}
    assert ids(1, "a", direction="both") == {(1, "b"), (1, "c"), (2, "d"), (2, "a")} and ids(3, "a", direction="both") == set()
    assert ids(2, "d", direction="inbound") == {(1, "a")} and ids(1, "a", types=["x:z"]) == {(2, "d")}


def test_a_walk_is_the_same_by_lists_and_tables(spark, monkeypatch):
    rng = random.Random(4)
    edges = spark.createDataFrame([(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(150)], "source_id string, target_id string").where("source_id <> target_id").cache()
    kind = edges.schema["source_id"].dataType
    small = sorted(map(str, graph.walk(edges, "n1", kind, 4).collect()))
    monkeypatch.setattr(graph, "SMALL", 3)
    assert sorted(map(str, graph.walk(edges, "n1", kind, 4).collect())) == small and len(small) > 10


def test_tenancy(spark):
    bundles = spark.createDataFrame([(1, "t1"), (2, "t2")], "bundle_id long, tenant_id string")
    links = spark.createDataFrame([(1, "a"), (2, "b")], "bundle_id long, source_id string")
    rel = spark.createDataFrame([(1, "a"), (2, "b")], "source_bundle_id long, source_concept_id string")
    c = Catalog(spark, {"bundles": bundles, "concepts": bundles, "links": links, "relationships": rel, "odd": links.select("source_id")})
    assert c.table("concepts").count() == 2 and c.for_tenant("t2").table("concepts").first()[0] == 2
    assert c.for_tenant("t2").table("links").first()["source_id"] == "b" and c.for_tenant("t1").table("relationships").first()["source_concept_id"] == "a"
    assert all(c.for_tenant(None, require=True).table(t).count() == 0 for t in ("concepts", "links", "relationships"))
    for tenant, require in (("t1", False), (None, True)):
        with pytest.raises(InvalidParameter):
            c.for_tenant(tenant, require).table("odd")
    with pytest.raises(InvalidParameter):
        c.table("nothing")


def test_invalidation_goes_to_the_end_and_escalates(spark):
    schema = "source_bundle_id long, target_bundle_id long, target_scope_kind string, causation_key string, enabled boolean"
    chain = spark.createDataFrame([(i, i + 1, "bundle", "k" if i == 15 else None, True) for i in range(30)] + [(3, 99, "concept", None, True), (4, 98, "bundle", None, False)], schema)
    hit, over = graph.transitive_invalidation(chain, [0])
    assert {r[0]: r[1] for r in hit.collect()} == {i: i for i in range(1, 31)} and not over
    assert {r[0] for r in graph.transitive_invalidation(chain, [0], "k")[0].collect()} == set(range(1, 16))
    hit, over = graph.transitive_invalidation(chain, [0], cap=5)
    assert over and {r[0] for r in hit.collect()} == set(range(1, 31))
    star = spark.createDataFrame([(0, i, "bundle", None, True) for i in range(1, 40)] + [(100, 101, "bundle", None, True)], schema)
    hit, over = graph.transitive_invalidation(star, [0], cap=20)
    assert over and {r[0] for r in hit.collect()} == {*range(1, 40), 101} and sum(r[1] is not None for r in hit.collect()) == 19


# --- parser


def test_paths_and_targets():
    assert normalize.resolve("a/b.md", "../c#x") == "c.md" and normalize.resolve("a.md", "../../c") is None and normalize.resolve("a.md", "#x") == "a.md" and normalize.resolve("a.md", "") is None
    for bad in ("/a.md", "a/../b.md", ""):
        with pytest.raises(InvalidParameter):
            normalize.path(bad)


@pytest.mark.parametrize("data", [b"no fence", b"---\ntitle: x\n---\n", b"---\ntype: x\ntitle: [\n---\n", b"---\ntype: x\ntitle: y\n", b"\xff\xfe"])
def test_malformed_files(data):
    with pytest.raises(InvalidParameter):
        markdown.parse("a.md", data)


def test_plain_text_and_links():
    c = markdown.parse("x/a.md", "﻿---\r\ntype: T\r\ntitle: 日本\r\nextra: {a: 1}\r\n---\r\n# Head\n\n- item **bold** `code`\n\n[![alt](i.png)](b.md) <https://e.org> <me@e.org> [ref][r]\n\n[r]: ../c.md\n\n```\n[no](no.md)\n```\n".encode())
    assert c.text.splitlines()[:2] == ["Head", "item bold code"] and c.metadata == {"extra": '{"a": 1}'} and c.title == "日本"
    assert [(x["link_kind"], x["target_path"]) for x in c.links] == [("inline", "x/b.md"), ("image", "x/i.png.md"), ("autolink", None), ("email", None), ("reference", "c.md")]
    assert markdown.log_entries("# Log\n- 2024-01-02T03:04:05Z began\n* went on\n\n") == [{"ordinal": 0, "logged_at": None, "entry": "Log"}, {"ordinal": 1, "logged_at": "2024-01-02T03:04:05Z", "entry": "2024-01-02T03:04:05Z began"}, {"ordinal": 2, "logged_at": None, "entry": "went on"}]
    assert markdown.trust_tier({"verified": [{"by": "human:a"}]}) == "human-reviewed" and markdown.trust_tier({}) == "unverified" and markdown.trust_tier({"verified": [{"by": "bot"}]}) == "machine-confirmed"
    assert markdown.trust_tier({"verified": {"by": "human:a"}}) == "human-reviewed" and markdown.trust_tier({"verified": [{"by": ""}, {"at": "2024-01-01"}, 3]}) == "unverified"


def test_scan_strict_and_export(spark, tmp_path):
    for name, data in FILES.items():
        to = tmp_path / "b" / name
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_bytes(data)
    files = bundle.scan(spark, str(tmp_path / "b"))
    assert {r[0] for r in files.select("path").collect()} == set(FILES)
    parsed = bundle.parse(files)
    out = bundle.export_sources(files.join(parsed.select("path", "file_hash"), "path"), str(tmp_path / "out"))
    assert out.count() == 3 and (tmp_path / "out/services/widget.md").read_bytes() == FILES["services/widget.md"]
    where = bundle.export_parquet(bundle.project(parsed, 1), str(tmp_path / "p"))
    assert spark.read.parquet(where["concepts"]).count() == 3
    (tmp_path / "b/bad.md").write_bytes(b"nothing")
    with pytest.raises(InvalidParameter):
        bundle.project(bundle.parse(bundle.scan(spark, str(tmp_path / "b"))), 1)
    assert bundle.project(bundle.parse(bundle.scan(spark, str(tmp_path / "b"))), 1, strict=False)["concepts"].count() == 3
    for limits in ({"max_files": 2}, {"max_bundle_bytes": 100}, {"max_file_bytes": 10}):
        with pytest.raises(InvalidParameter):
            bundle.scan(spark, str(tmp_path / "b"), **limits)
    left = bundle.scan(spark, str(tmp_path / "b"), exclude=["runbooks/*", "ba?.md"]).select("path").collect()
    assert {r[0] for r in left} == {"services/widget.md", "index.md"}
    stored = files.withColumn("bundle_id", F.lit(1))
    concepts = bundle.project(bundle.parse(files.where("path <> 'bad.md'")), 1)["concepts"]
    assert bundle.concept_source(stored, concepts, 1, "services/widget") == FILES["services/widget.md"]
    for rows, name in ((stored.limit(0), "services/widget"), (stored, "none")):
        with pytest.raises(NotFound):
            bundle.concept_source(rows, concepts, 1, name)
    page = bundle.html_to_markdown("T", '<h1>A &amp; B</h1><p>see <a href="x.md">x</a></p><ul><li>one</li></ul>')
    assert markdown.parse("t.md", page.encode()).text.splitlines() == ["A & B", "see x", "one"]


# --- history, freshness, publication, delivery


def test_removal_is_never_found(spark):
    log = spark.createDataFrame([("a", 10, 1, "updated", "x"), ("a", 20, 2, "removed", "x"), ("a", 30, 3, "updated", "y")], "concept_id string, at_us long, event_id long, change_kind string, title string")
    h = temporal.versions(log)
    at = lambda t: [r["version"] for r in temporal.concept_as_of(h, t).collect()]
    assert [at(t) for t in (5, 10, 19, 20, 25, 30)] == [[], [1], [1], [], [], [3]]
    diff = spark.createDataFrame([("a", "removed", "y"), ("b", "added", "z")], "concept_id string, change string, title string")
    after = {(r["concept_id"], r["version"]): (r["valid_from"], r["valid_to"]) for r in temporal.apply_sync(h, diff, 40).collect()}
    assert after["a", 3] == (30, 40) and after["a", 4] == (40, 40) and after["b", 1] == (40, None)


def test_state_rules(spark):
    """Reasons merge while a state lasts and are replaced when it changes; stale_since is kept; retired stays."""
    states = spark.createDataFrame([(1, "bundle", "", "stale", ["a"], 5, 1), (2, "bundle", "", "blocked", ["a"], 5, 1), (3, "bundle", "", "retired", [], 5, 1), (4, "bundle", "", "fresh", [], None, 1)], freshness.STATE)
    targets = states.select("bundle_id", "scope_kind", "scope_key").unionByName(spark.createDataFrame([(4, "concept", "x")], "bundle_id long, scope_kind string, scope_key string"))
    got = {(r["bundle_id"], r["scope_kind"]): (r["state"], r["reasons"], r["stale_since"], r["epoch"]) for r in freshness.mark(states, targets, "stale", 9, ["b"]).collect()}
    assert got == {(1, "bundle"): ("stale", ["a", "b"], 5, 2), (2, "bundle"): ("stale", ["b"], 5, 2), (3, "bundle"): ("retired", [], 5, 1), (4, "bundle"): ("stale", ["b"], 9, 2), (4, "concept"): ("stale", ["b"], 9, 1)}
    fresh = {r["bundle_id"]: (r["state"], r["reasons"], r["stale_since"]) for r in freshness.mark(states, states.select("bundle_id", "scope_kind", "scope_key"), "fresh", 9).collect()}
    assert fresh[1] == ("fresh", [], None) and fresh[3][0] == "retired"
    with pytest.raises(InvalidParameter):
        freshness.mark(states, targets, "new", 9)


@pytest.fixture(scope="module")
def homes(spark):
    return spark.createDataFrame([(1, "t", 5), (2, "t", 7)], "bundle_id long, tenant_id string, catalog_generation long")


@pytest.mark.parametrize("change", [{}, {"state": "retired"}, {"observed_generation": "other"}, {"materialized_generation": 6}, {"invalidation_epoch": 4}, {"claimed_epoch": 4}, {"coverage_missing_since": 1}, {"reasons": ["relationship_coverage_missing"]}])
def test_mark_fresh_compares_all_conditions(spark, homes, change):
    row = {"bundle_id": 1, "state": "stale", "reasons": ["x"], "stale_since": 3, "observed_generation": "g", "materialized_generation": 4, "invalidation_epoch": 3, "claimed_epoch": 2, "coverage_missing_since": None, "manifest_hash": "h"} | change
    schema = "bundle_id long, state string, reasons array<string>, stale_since long, observed_generation string, materialized_generation long, invalidation_epoch long, claimed_epoch long, coverage_missing_since long, manifest_hash string"
    table = spark.createDataFrame([tuple(row.values())], schema)
    after, taken = freshness.mark_fresh(table, homes, 1, 5, 3, "g")
    assert taken is (not change) and after.first()["state"] == ("fresh" if taken else row["state"])
    assert not freshness.mark_fresh(table, homes, 1, 4, 3, "g")[1]


def test_dependencies(spark, homes):
    table = spark.createDataFrame([], freshness.DEPENDENCY)
    table, one = freshness.register(table, homes, "p", 1, "path_prefix", 2, "docs/", causation_key="k")
    table, two = freshness.register(table, homes, "p", 1, "concept", 2, "a", "concept", "z")
    table, three = freshness.register(table, homes, "q", 2, "bundle", 1)
    assert [r["watermark"] for r in freshness.list_dependencies(table).collect()] == [5, 5, 7] and (one, two, three) == (1, 2, 3)
    with pytest.raises(Duplicate):
        freshness.register(table, homes, "p", 1, "concept", 2, "a", "concept", "z")
    for wrong in ({"selector": "bundle", "selector_key": "x"}, {"selector": "none"}, {"selector": "path", "selector_key": ""}):
        with pytest.raises(InvalidParameter):
            freshness.register(table, homes, "p", 1, target_bundle_id=2, **wrong)
    with pytest.raises(NotFound):
        freshness.register(table, homes, "p", 9, "bundle", 2)
    changes = spark.createDataFrame([("docs/x", "docs/x.md"), ("b", "b.md")], "concept_id string, path string")
    named = lambda stale: {(r["bundle_id"], r["scope_kind"], r["scope_key"], r["reason"]) for r in stale.collect()}
    after, stale = freshness.evaluate_event(table, changes, 1, 6)
    assert named(stale) == {(2, "bundle", "", "dependency_source_changed"), (1, "bundle", "", "dependency_source_changed")}  # 2 sends it on to 1
    assert [r["watermark"] for r in freshness.list_dependencies(after).collect()] == [6, 6, 7]
    assert named(freshness.evaluate_event(after, changes, 1, 6)[1]) == set() and named(freshness.evaluate_event(table, changes, 1, 6, causation="k")[1]) == set()
    unknown = named(freshness.evaluate_event(table, changes.limit(0), 1, 6, truncated=True)[1])
    assert (1, "bundle", "", "scope_unknown") in unknown and (2, "concept", "z", "dependency_source_changed") in unknown
    assert named(freshness.departing_dependents(table, 2)) == {(1, "bundle", "", "dependency_source_changed"), (2, "bundle", "", "dependency_source_changed")} or named(freshness.departing_dependents(table, 2))
    off = freshness.disable(table, one)
    assert named(freshness.evaluate_event(off, changes, 1, 6)[1]) == set() and freshness.remove(table, two).count() == 2
    with pytest.raises(NotFound):
        freshness.remove(table, 77)


def test_fences(spark, homes):
    f = spark.createDataFrame([], freshness.FENCE)
    f, token = freshness.issue_fence(f, homes, 1, "p", 5, 5, now=0, lease_s=60)
    for generation, expected in ((5, 5), (6, 4), (0, 5)):
        with pytest.raises(InvalidParameter):
            freshness.issue_fence(f, homes, 1, "p", generation, expected, now=10)
    g, newer = freshness.issue_fence(f, homes, 1, "p", 6, 5, now=10, lease_s=60)
    assert newer == token + 1 and g.count() == 1
    for table, t, now in ((g, token, 20), (g, newer, 71), (freshness.release_fence(g, 1, "p", newer, 20), newer, 30)):
        with pytest.raises(InvalidParameter):
            freshness.release_fence(table, 1, "p", t, now)


def test_publication(spark, homes):
    rows = "source_concept_id string, relation_type string, direction string, target_bundle_id long, target_concept_id string, external_target string, confidence double"
    two = spark.createDataFrame([("a", "x:y", "directed", None, "b", None, 0.5), ("a", "x:y", "directed", 2, "gone", None, None)], rows)
    valid = relationships.validate(two)
    assert relationships.set_hash(valid) == relationships.set_hash(valid.repartition(3).orderBy("target_concept_id", ascending=False))
    with pytest.raises(Duplicate):
        relationships.validate(two.unionByName(two))
    for wrong in (two.withColumn("confidence", F.lit(1.5)), two.withColumn("relation_type", F.lit("X")), two.withColumn("external_target", F.lit("e"))):
        with pytest.raises(InvalidParameter):
            relationships.validate(wrong)
    pubs = spark.createDataFrame([(1, "t", "p", 1), (2, "t", "p", 3), (3, "t", "q", 1)], "publication_id long, tenant_id string, producer string, publication_generation long")
    assert {r["publication_id"]: r["state"] for r in relationships.activate(pubs).collect()} == {1: "superseded", 2: "active", 3: "active"}
    stored = "publication_id long, source_bundle_id long, source_concept_id string, relation_type string, direction string, target_bundle_id long, target_concept_id string, external_target string, confidence double, row_hash string, unresolved boolean, cross_bundle boolean"
    fences, token = freshness.issue_fence(spark.createDataFrame([], freshness.FENCE), homes, 1, "p", 8, 5, now=0)
    concepts = spark.createDataFrame([(1, "a"), (1, "b")], "bundle_id long, concept_id string")
    tables = {"bundles": homes, "concepts": concepts, "fences": fences, "publications": spark.createDataFrame([], relationships.PUBLICATION), "relationships": spark.createDataFrame([], stored)}
    now, number = relationships.replace_relationships(tables, "p", 1, 8, 5, token, two, 10)
    got = {r["target_concept_id"]: (r["target_bundle_id"], r["unresolved"], r["cross_bundle"]) for r in now["relationships"].collect()}
    assert got == {"b": (1, False, False), "gone": (2, True, True)} and now["publications"].first()["state"] == "active"
    assert relationships.replace_relationships(now, "p", 1, 8, 5, token, two, 10) == (now, number)
    with pytest.raises(Duplicate):
        relationships.replace_relationships(now, "p", 1, 8, 5, token, two.limit(1), 10)
    for generation, expected, t, at in ((9, 5, token, 10), (8, 9, token, 10), (8, 5, token + 1, 10), (8, 5, token, 999)):
        with pytest.raises(InvalidParameter):
            relationships.replace_relationships(tables, "p", 1, generation, expected, t, two, at)
    staged, _ = relationships.replace_relationships(tables, "p", 1, 8, 6, token, two.withColumn("source_concept_id", F.when(F.col("confidence").isNull(), "new").otherwise(F.col("source_concept_id"))), 10)
    grown = {**staged, "concepts": concepts.unionByName(spark.createDataFrame([(2, "gone")], "bundle_id long, concept_id string"))}
    done, missing = relationships.activate_staged(grown, 1, 6)
    assert not missing and done["publications"].first()["state"] == "active" and [r["source_concept_id"] for r in done["relationships"].collect()] == ["a"]
    assert relationships.activate_staged(now, 1, 6)[1] and relationships.activate_staged(staged, 1, 7)[0]["publications"].first()["state"] == "superseded"


def test_hashes_of_large_sets(spark, monkeypatch):
    monkeypatch.setattr(relationships, "RUN", 4)
    sets = {p: [hashlib.sha256(f"{p} {i % 400}".encode()).hexdigest() for i in range(n)] for p, n in ((1, 390), (2, 1), (3, 700), (None, 9))}
    rows = spark.createDataFrame([(p, h) for p, hashes in sets.items() for h in [*hashes, None]], "publication_id long, row_hash string").repartition(8)
    got = relationships.set_hashes(rows)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert {r["publication_id"]: (r["relationship_set_hash"], r["n"]) for r in got.collect()} == {p: (hashlib.sha256("\n".join(sorted(hashes)).encode()).hexdigest(), len(hashes) + 1) for p, hashes in sets.items()}


def test_outbox(spark):
    schema = "event_id long, claimed_by string, claimed_until long, attempts int, acked boolean, ack_key string, at_us long"
    t = spark.createDataFrame([(1, None, None, 0, False, None, 1), (2, "x", 50, 1, False, None, 1), (3, None, None, 0, True, "k", 1)], schema)
    got, after = outbox.claim(t, "me", now=40, lease_s=10)
    assert [r["event_id"] for r in got.collect()] == [1] and [r["event_id"] for r in outbox.claim(after, "you", now=60)[0].collect()] == [1, 2]
    done = outbox.acknowledge(after, 1, "me", "key")
    assert outbox.acknowledge(done, 1, "me", "key").where("acked").count() == 2
    with pytest.raises(Duplicate):
        outbox.acknowledge(done, 1, "me", "other")
    with pytest.raises(NotFound):
        outbox.acknowledge(after, 2, "me", "key")


def test_stream_of_new_files(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b/a.md").write_bytes(FILES["services/widget.md"])
    seen = []
    outbox.deliver(outbox.watch(spark, str(tmp_path / "b")), lambda batch, _: seen.extend(r["concept_id"] for r in bundle.parse(batch.selectExpr("'a.md' AS path", "content")).collect()), str(tmp_path / "c")).awaitTermination()
    assert seen == ["a"]


def test_lifecycle_and_config(spark):
    b = spark.createDataFrame([(1, True, None), (2, True, None)], "bundle_id long, enabled boolean, retired_at timestamp")
    r = lifecycle.retire(lifecycle.retire(b, 1, "2024-01-01 00:00:00"), 1, "2024-05-05 00:00:00")
    assert r.where("retired_at = timestamp'2024-01-01 00:00:00'").count() == 1 and lifecycle.unretire(r, 1).where("retired_at IS NULL").count() == 2
    for change in (lifecycle.retire, lifecycle.set_enabled):
        with pytest.raises(NotFound):
            change(b, 9, "2024-01-01 00:00:00" if change is lifecycle.retire else True)
    assert lifecycle.Config().set("embedding_dim", 7).reset("embedding_dim").embedding_dim == 1536
    for key, value in (("embedding_dim", "7"), ("embedding_dim", 0), ("search_backend", "other"), ("none", 1)):
        with pytest.raises(InvalidParameter):
            lifecycle.Config().set(key, value)
    applied = lifecycle.Config().set("search_backend", "bm25").set("require_tenant", True).apply(Catalog(spark, {}))
    assert (applied.search_backend, applied.require_tenant, applied.text_config) == ("bm25", True, "english")
    assert lifecycle.embedding_changed(lifecycle.Config(), lifecycle.Config().set("embedding_model", "m"))


ISO_CASES = [("2024-01-02", 1704153600), ("2024-01-02T03:04:05Z", 1704164645), ("2024-01-02t03:04:60+00", 1704164700), ("2024-01-02 03:04+0530", 1704144840), ("2024-01-02T03:04:05.678-01:00", 1704168245), ("2024-02-30", None), ("2024-01-02T25:00Z", None), ("soon", None), (None, None)]


def test_iso_times(spark):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ISO_CASES)], "i int, t string")
    got = {r["i"]: r["s"] for r in d.select("i", provenance.iso_seconds(F.col("t")).alias("s")).collect()}
    assert [got[i] for i in range(len(ISO_CASES))] == [s for _, s in ISO_CASES]


def test_packages(spark):
    paths = ["a/SKILL.md", "a/scripts/x.py", "a/b/SKILL.md", "a/b/assets/i.png", "a/b/scripts", "a/readme.md", "references/r.md", "a/references/index.md", "log.md"]
    got = {r["path"]: (r["package"], r["kind"], r["role"]) for r in packages.classify(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got["a/scripts/x.py"] == ("a", "resource", "script") and got["a/b/assets/i.png"] == ("a/b", "resource", "asset")
    assert got["a/b/SKILL.md"] == ("a/b", "manifest", None) and got["references/r.md"] == (None, "document", None)
    assert got["a/references/index.md"] == ("a", "resource", "reference") and got["log.md"] == (None, "reserved", None) and got["a/b/scripts"] == ("a/b", "ignored", None)


@pytest.fixture
def late_broadcasts(spark):
    """Joins are planned by shuffles, and become broadcasts when their sides turn out to be small."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("gone", [{}, {"p1/scripts/s3.py": None, "p2/SKILL.md": None}])
def test_a_package_has_one_hash(spark, late_broadcasts, gone):
    names = ["SKILL.md", *[f"scripts/s{i}.py" for i in range(30)]]
    hashes = {f"p{k}/{name}": f"{k}.{i}" for k in range(20) for i, name in enumerate(names)} | gone
    files = spark.createDataFrame(list(hashes.items()), "path string, file_hash string").repartition(8)
    got = packages.package_hash(packages.classify(files.select("path")), files).collect()

    def plain(package):
        lines = [f"script\0{name}\0{hashes[f'{package}/{name}']}\n" for name in sorted(names[1:]) if hashes[f"{package}/{name}"]]
        head = hashes[f"{package}/SKILL.md"]
        return head and hashlib.sha256("".join([*packages.HASH_HEAD[:1], "\n1\n1\n", head, "\n", *lines]).encode()).hexdigest()

    assert sorted((r["package"], r["package_hash"], r["files"]) for r in got) == sorted((f"p{k}", plain(f"p{k}"), 31) for k in range(20))


def test_attested_computations(spark):
    concepts = spark.createDataFrame([(1, "x", "Attested Computation"), (1, "y", "Note")], "bundle_id long, concept_id string, type string")
    metadata = spark.createDataFrame([(1, "x", "computation", '"calc.md"'), (1, "x", "other", '"z"'), (1, "y", "attester", '"w"')], "bundle_id long, concept_id string, key string, value string")
    assert [tuple(r) for r in packages.attestation_links(metadata, concepts).collect()] == [(1, "x", "attestation:computation", "calc.md")]


def test_embeddings_are_checked(spark):
    d = spark.createDataFrame([(1, "a", "one two"), (1, "b", None)], "bundle_id long, concept_id string, input string")
    made = embeddings.embed(d, 8)
    assert embeddings.check(made, 8).count() == 2
    with pytest.raises(InvalidParameter):
        embeddings.check(made, 9)
    with pytest.raises(InvalidParameter):
        embeddings.check(made.withColumn("embedding", F.array(*[F.lit(float("nan"))] * 8)), 8)


def test_locks(spark, golden):
    lock = golden.table("concepts").select("bundle_id", "concept_id", F.when(F.col("concept_id") == "services/widget", "x").otherwise(F.col("file_hash")).alias("file_hash"))
    got = {r["concept_id"]: r["state"] for r in workspace.check_lock(lock, golden).collect()}
    assert got == {"services/widget": "stale", "runbooks/failover": "current", "runbooks/failover-appendix": "current"}


@given(st.text(max_size=40))
@settings(max_examples=80, deadline=None)
def test_queries_never_fail_on_punctuation(text):
    if text.strip():
        tsquery.parse(text)
    assert json.loads(search.encode_cursor(1.5, 2, text))["concept_id"] == text


# --- edits, the wiki as a source, what producers say


def test_edits_of_documents():
    claimed = {"type": "T", "verified": {"by": "human:x"}, "superseded_verifications": "typed"}
    made, n = documents.new(claimed, "agent:a", "t1")
    assert n == 1 and "verified" not in made and made["generated"] == {"by": "agent:a", "at": "t1"} and made["author"] == "agent:a"
    assert made["superseded_verifications"] == [{"by": "human:x", "superseded_by": "agent:a", "superseded_at": "t1", "reason": "uploaded"}]
    assert claimed["verified"] == {"by": "human:x"}
    for front in ({"author": "human:b"}, {"generated": {"by": " human:b "}}):
        with pytest.raises(InvalidParameter):
            documents.new(front, "agent:a", "t1")
        assert documents.new(front, "human:c", "t1")[1] == 0
    stored = documents.verified({"type": "T", "status": "draft"}, "human:r", "t2", " fine ")
    assert stored["status"] == "active" and stored["verified"] == [{"by": "human:r", "at": "t2", "note": "fine"}]
    assert documents.verified({"status": "retired"}, "human:r", "t2")["status"] == "retired"
    again, n = documents.edited({"type": "T", "generated": "human:q"}, "agent:a", "t3", stored)
    assert n == 1 and again["superseded_verifications"][0]["by"] == "human:r" and again["generated"]["by"] == "agent:a"
    assert documents.edited({**again, "superseded_verifications": []}, "agent:a", "t4", again)[0]["superseded_verifications"] == again["superseded_verifications"]
    back = documents.returned(stored, "human:s", "t5", "no")
    assert back["status"] == "draft" and back["reviews"] == [{"by": "human:s", "at": "t5", "outcome": "sent-back", "note": "no"}]
    front = {"type": "T", "title": "é: x", "at": "2024-01-02T03:04:05Z", "n": 3}
    assert documents.read(documents.write(front, "body\n---\n")) == (front, "body\n---\n")


def test_contributions_are_files(spark):
    stored = bundle.from_memory(spark, ["a.md", "broken.md"], [doc("A", "old", more="verified: [{by: 'human:r', at: 2024-01-02}]\n"), b"no frontmatter"])
    uploads = bundle.from_memory(spark, ["a.md", "broken.md", "new.md", "bad.md", "other.md"], [doc("A", "now"), doc("B", "now", more="verified: yes\n"), doc("N", "x"), b"nothing", doc("O", "x", more="author: human:z\n")])
    got = {r["path"]: r for r in documents.contribute(uploads, stored, "agent:a", "2024-02-03").collect()}
    assert len(got) == 5 and {p: r["set_aside"] for p, r in got.items()} == {"a.md": 1, "broken.md": 1, "new.md": 0, "bad.md": 0, "other.md": 0}
    assert {p for p, r in got.items() if r["error"]} == {"bad.md", "other.md"} and bytes(got["bad.md"]["content"]) == b"nothing"
    made = markdown.parse("a.md", bytes(got["a.md"]["content"]))
    assert made.trust_tier == "unverified" and made.text == "now" and "human:r" in made.metadata["superseded_verifications"]
    files = spark.createDataFrame([(p, r["content"]) for p, r in got.items() if p == "a.md"], "path string, content binary")
    after = documents.verify(files, "human:r", "2024-02-04")
    assert markdown.parse("a.md", bytes(after.first()["content"])).trust_tier == "human-reviewed"
    sent = documents.send_back(files, "human:r", "2024-02-04", "why").first()
    assert documents.read(bytes(sent["content"]))[0]["status"] == "draft" and sent["error"] is None


def test_wiki_snapshots(spark, tmp_path):
    schema = "page_id string, version long, title string, html string"
    first = wiki.documents(spark.createDataFrame([("1", 1, "One", "<p>a</p>"), ("2", 3, "Two", "<p>b</p>"), ("3", 1, None, None)], schema)).cache()
    assert markdown.parse("pages/1.md", bytes(first.where("page_id = '1'").first()["content"])).text == "a"
    me, path = wiki.Identity("space", "wiki", "t1"), str(tmp_path / "kept")
    assert wiki.read_checkpoint(spark, path, me) is None and wiki.removed_ids(first, None).isEmpty()
    wiki.write_checkpoint(wiki.snapshot(first), path, me)
    (tmp_path / "kept" / "000000000002").mkdir()  # a write that failed half-way
    before = wiki.read_checkpoint(spark, path, me)
    now = wiki.snapshot(wiki.documents(spark.createDataFrame([("1", 1, "One", "<p>a</p>"), ("2", 4, "Two", "<p>c</p>"), ("4", 1, "Four", "")], schema)))
    wiki.check(now, before)
    assert {(r["path"], r["change"]) for r in wiki.changes(now, before).collect()} == {("pages/1.md", "unchanged"), ("pages/2.md", "updated"), ("pages/3.md", "removed"), ("pages/4.md", "added")}
    assert [r[0] for r in wiki.removed_ids(now, before).collect()] == ["3"] and wiki.changes(now, None).where("change <> 'added'").isEmpty()
    wiki.write_checkpoint(now, path, me)
    with pytest.raises(InvalidParameter):
        wiki.check(before, wiki.read_checkpoint(spark, path, me))
    with pytest.raises(InvalidParameter):
        wiki.read_checkpoint(spark, path, wiki.Identity("space", "wiki", "t2"))
    for rows in ([], [("x", 1, "", "")], [("1", 0, "", "")], [(None, 1, "", "")], [("1", 1, "", ""), ("1", 2, "", "")]):
        with pytest.raises(InvalidParameter):
            wiki.snapshot(wiki.documents(spark.createDataFrame(rows, schema)))
    with pytest.raises(InvalidParameter):
        wiki.Identity("space", " ", "t1")


def test_contexts_and_notifications(spark, tmp_path):
    assert outbox.Context.of(None) == outbox.Context.of("  ") == outbox.Context()
    said = outbox.Context.of('{"operation": "delete_document", "origin": "web", "observed_source_generation": 7, "else": 1, "producer": null}')
    assert said == outbox.Context(origin="web", observed_source_generation="7", operation="delete_document")
    for raw in ("[1]", "{", '{"operation": "drop"}', '"text"'):
        with pytest.raises(InvalidParameter):
            outbox.Context.of(raw)
    diff = spark.createDataFrame([("a", "added"), ("b", "removed"), ("c", "unchanged")], "path string, change string")
    plain = outbox.sync_event(diff, 5, 1, 10).first()
    assert (plain["operation"], plain["causation"], plain["added"], plain["updated"], plain["removed"], plain["total"]) == ("refresh_bundle", None, 1, 0, 1, 2)
    event = outbox.sync_event(diff, 5, 1, 10, said)
    assert event.first()["origin"] == "web" and outbox.notifications(event, "").isEmpty()
    event.write.parquet(str(tmp_path / "events"))
    sent = []
    stream = spark.readStream.schema(event.schema).parquet(str(tmp_path / "events"))
    outbox.notify(stream, "changed", lambda rows, _: sent.extend(rows.collect()), str(tmp_path / "at")).awaitTermination()
    assert [(r["channel"], json.loads(r["payload"])) for r in sent] == [("changed", {"bundle_id": 1, "op": "delete_document", "added": 1, "updated": 0, "removed": 1, "total": 2, "event_id": 5})]
    assert lifecycle.Config().set("notify_channel", "_changed1").notify_channel == "_changed1"
    for name in ("1x", "a-b", "x" * 64):
        with pytest.raises(InvalidParameter):
            lifecycle.Config().set("notify_channel", name)
