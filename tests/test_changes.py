"""Keys, stores, discovery, single subjects, SPARQL texts and plans on small tables."""

import pytest
from pyspark.sql import functions as F

from quadrel.database import Database
from quadrel.functions.aggregates import asc, count, desc
from quadrel.functions.predicates import and_, eq, gt
from quadrel.operators import discovery, federation, keys, mutations, quads, things, validation
from quadrel.schema import boolean, column, integer, key, many, string, table, timestamp, uri
from quadrel.sources import layout
from quadrel.sources.store import Store

NS = "http://t.example/v#"
ITEMS = table("items", {"id": key(), "name": string().not_null(), "n": integer(), "tags": string().array()}, NS + "Item", namespace=NS, base="http://t.example/items", template="#{id}")
ROWS = [("a", "one", 1, ["x"]), ("b", "two", 2, ["y", "x"]), ("c", "three", 3, None)]


@pytest.fixture
def db(spark):
    return Database(spark).bind(ITEMS, spark.createDataFrame(ROWS, ITEMS.struct_type()))


def rows(df):
    return sorted(tuple(sorted(x) if isinstance(x, list) else x for x in r) for r in df.collect())


# ---- keys


def test_generated_keys_stay_the_same(db):
    db.insert(ITEMS).values([{"name": "new"}, {"name": "new"}, {"id": "own", "name": "new"}]).run()
    ids = [r.id for r in db.frames["items"].filter("name = 'new'").collect()]
    assert len(set(ids)) == 3 and "own" in ids and sorted(map(len, ids)) == [3, 21, 21]
    assert sorted(ids) == sorted(r.id for r in db.frames["items"].filter("name = 'new'").collect())
    assert all(set(i) <= set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-") for i in ids)
    numbered = table("numbered", {"id": key("bigint"), "name": string()}, NS + "N", namespace=NS)
    with pytest.raises(ValueError, match="id must have a value"):
        db.insert(numbered).values({"name": "x"}).run()


def test_key_templates(spark):
    df = spark.createDataFrame([("My Näme", "http://t.example/room/r1/index.ttl#this", "chat/general/2024/05/06/log.ttl#m1", None)], "title string, room string, msg string, none string")
    of = {c: F.col(c) for c in df.columns} | {"createdAt": F.lit("2024-02-03T23:00:00").cast("timestamp")}
    made = lambda template: df.select(keys.render_key(template, of, F.lit("KEY")).alias("v")).first().v
    assert made("{yyyy}/{MM}/{dd}.ttl#{key}") == "2024/02/03.ttl#KEY" and made("{title|slug}/{key}{none}") == "my-näme/KEY"
    assert made("{room.key}") == "r1" and made("{msg.dir}") == "chat/general" and made("{msg.doc}") == "chat/general/2024/05/06/log.ttl" and made("{msg.key}") == "m1"
    assert made("{msg[1]}") == "general" and made("{msg[0:2]}") == "chat/general" and made("{msg[-1]}") == "m1" and made("plain") == "plain"
    for wrong in ("{id}", "{nothing}", "{title.nothing}"):
        with pytest.raises(ValueError):
            made(wrong)


# ---- stores


def test_a_store_keeps_versions(spark, tmp_path):
    store = Store(spark, ITEMS, f"file://{tmp_path}/items")
    assert store.versions() == [] and store.read().count() == 0
    db = Database(spark).bind_store(ITEMS, f"file://{tmp_path}/items")
    db.insert(ITEMS).values([dict(zip(("id", "name", "n", "tags"), r, strict=True)) for r in ROWS]).run()
    db.insert(ITEMS).values({"id": "d", "name": "four"}).run()
    assert store.versions() == [1] and store.read().count() == 4
    db.update(ITEMS).set({"n": 9}).where(gt(ITEMS.c.n, 1)).run()
    db.delete(ITEMS).where({"name": "one"}).run()
    mutations.upsert(db, ITEMS, spark.createDataFrame([("d", "vier", 4, None), ("e", "five", 5, None)], ITEMS.struct_type()))
    expected = [("b", 9), ("c", 9), ("d", 4), ("e", 5)]
    assert store.versions() == [1, 2, 3, 4] and rows(store.read().select("id", "n")) == expected == rows(db.frames["items"].select("id", "n"))
    assert "version=4" in db.frames["items"].inputFiles()[0]  # read back, not rewritten on top of each other
    (tmp_path / "items" / "version=5").mkdir()  # a version whose job did not finish
    assert store.versions()[-1] == 4 and store.vacuum() == 3 and store.read().count() == 4
    with pytest.raises(ValueError, match="Duplicate primary key"):
        db.insert(ITEMS).values({"id": "b", "name": "again"}).run()


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda name, default: None)

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return type("C", (), {"get": staticmethod(lambda name: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        layout.shared_dir(Session)


# ---- lookups, sets, groups


def test_lookup_before_page(db):
    for q in (db.query(ITEMS).find_by_id("a", order_by=desc("n"), limit=1), db.query(ITEMS).find_by_iri("http://t.example/items#a", order_by=desc("n"), limit=1), db.query(ITEMS).find_by_resource("a", order_by=desc("n"), limit=1), db.query(ITEMS).find_by_locator({"id": "a"}, order_by=desc("n"), limit=1)):
        assert [r.id for r in q.collect()] == ["a"]
    assert db.query(ITEMS).find_by_id("a", offset=1).count() == 0


def test_distinct_after_groups(db):
    q = db.select(tag=ITEMS.c.name, k=count()).from_(ITEMS).group_by("name", "id").distinct()
    assert len(q.order_by(asc(ITEMS.c.name)).df().collect()) == 3
    with pytest.raises(ValueError, match="selected columns only"):
        q.order_by(ITEMS.c.id).df()


def test_check_keys_in_one_job(db, spark):
    for bad, what in (([("z", None, 1, None)], "name must have a value"), ([("z", "q", 1, None)] * 2, "stands twice"), ([("a", "q", 1, None)], "Duplicate primary key")):
        with pytest.raises(ValueError, match=what):
            db.insert(ITEMS).values(spark.createDataFrame(bad, "id string, name string, n long, tags array<string>")).run()


def test_a_page_reduces_the_child_side(db, spark):
    notes = table("notes", {"id": key(), "item": column("uri").link(ITEMS)}, NS + "Note", namespace=NS, base="http://t.example/notes", template="#{id}")
    db.bind(notes, spark.createDataFrame([(str(k), f"http://t.example/items#{'abc'[k % 3]}") for k in range(9)], notes.struct_type())).relate(ITEMS, notes=many(notes, ("id",), ("item",)))
    found = db.query(ITEMS).find_many(with_=["notes"], order_by="id", limit=1)
    assert [(r.id, len(r.notes)) for r in found.collect()] == [("a", 3)]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()


def test_changes_by_resource(db):
    mutations.update_by_resource(db, ITEMS, "b", {"n": 7})
    mutations.delete_by_resource(db, ITEMS, "http://t.example/items#c")
    assert rows(db.frames["items"].select("id", "n")) == [("a", 1), ("b", 7)]


# ---- SPARQL texts and plans


def test_texts_of_changes_do_what_the_changes_do(db, spark):
    other = Database(spark).bind(ITEMS, db.frames["items"]).load_quads(ITEMS)
    steps = [
        lambda d: d.insert(ITEMS).values([{"id": "d", "name": 'qu"o\\te\nnew', "n": 4, "tags": ["t", "u"]}, {"id": "e", "name": "five"}]), lambda d: d.update(ITEMS).set({"n": 10, "tags": ["z"]}).where(gt(ITEMS.c.n, 1)),
        lambda d: d.update(ITEMS).set({"n": None}).where({"name": "one"}), lambda d: d.update(ITEMS).set({"name": "neu"}).where(and_(eq(ITEMS.c.id, "b"), eq(ITEMS.c.n, 10))), lambda d: d.delete(ITEMS).where({"id": "c"}),
    ]
    for step in steps:
        change = step(db)
        text = change.to_sparql()
        change.run()
        other.sparql(text)
        same = lambda df: sorted((r.id, r.name, r.n, sorted(r.tags or [])) for r in df.collect())
        assert same(quads.type_scan(other.quads, ITEMS)) == same(db.frames["items"]), text
    assert db.delete(ITEMS).where({"id": "a"}).plan().kind == "delete" and db.insert(ITEMS).values({"name": "x"}).plan().rows == ({"name": "x"},)
    with pytest.raises(ValueError, match="without a key"):
        db.insert(ITEMS).values({"name": "x"}).to_sparql()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_patterns_of_distinct_quads_are_joined_without_distinct(db):
    db.load_quads(ITEMS)
    text = f"PREFIX v: <{NS}> SELECT ?a ?b WHERE {{ ?s v:name ?a ; v:n ?b }}"
    assert "HashAggregate" not in plan(db.sparql(text)) and rows(db.sparql(text)) == [("one", "1"), ("three", "3"), ("two", "2")]
    twice = Database(db.spark, db.quads.unionByName(db.quads.withColumn("g", F.lit("http://t.example/copy"))))
    assert rows(twice.sparql(text)) == rows(db.sparql(text)) and "HashAggregate" in plan(twice.sparql(text))
    db.sparql(f"PREFIX v: <{NS}> INSERT DATA {{ GRAPH <http://t.example/g> {{ <http://t.example/items#a> v:name 'one' }} }}")
    assert rows(db.sparql(text)) == [("one", "1"), ("three", "3"), ("two", "2")]


def test_variables_that_may_be_unbound_are_joined_by_equality(db):
    db.load_quads(ITEMS)
    head = f"PREFIX v: <{NS}> "
    for text, expected in (
        ("SELECT ?a ?m WHERE { ?s v:name ?a OPTIONAL { ?s v:tags ?m . FILTER(?m = 'x') } ?s v:tags ?m }", [("one", "x"), ("two", "x")]),
        ("SELECT ?a ?m WHERE { ?s v:name ?a OPTIONAL { ?s v:tags ?m . FILTER(?m = 'y') } OPTIONAL { ?s v:tags ?m } }", [("one", "x"), ("three", None), ("two", "y")]),
        ("SELECT ?a WHERE { ?s v:name ?a OPTIONAL { ?s v:tags ?m . FILTER(?m = 'y') } MINUS { ?s v:tags ?m } }", [("three",)]),
        ("SELECT ?a WHERE { ?s v:name ?a OPTIONAL { ?s v:tags ?m . FILTER(?m = 'y') } FILTER EXISTS { ?s v:tags ?m } }", [("one",), ("two",)]),
    ):
        df = db.sparql(head + text)
        assert sorted(map(tuple, df.collect()), key=str) == sorted(expected, key=str), text
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df), text


def test_paths(spark):
    edge = lambda s, p, o: ("g", f"http://x/{s}", NS + p, "iri", f"http://x/{o}", None, None)
    db = Database(spark, spark.createDataFrame([edge("a", "p", "b"), edge("b", "p", "c"), edge("c", "p", "a"), edge("c", "q", "d"), edge("e", "p", "e")], quads.QUAD), True)
    ask = lambda text: sorted(tuple(v.rsplit("/", 1)[-1] for v in r) for r in db.sparql(f"PREFIX v: <{NS}> PREFIX x: <http://x/> {text}").collect())
    assert ask("SELECT ?o WHERE { x:a v:p+ ?o }") == [("a",), ("b",), ("c",)] and ask("SELECT ?o WHERE { x:a v:p*/v:q ?o }") == [("d",)]
    assert ask("SELECT ?s WHERE { ?s v:p+ x:a }") == [("a",), ("b",), ("c",)] and ask("SELECT ?s WHERE { x:b ^v:p ?s }") == [("a",)]
    assert ask("SELECT ?o WHERE { x:c v:p|v:q ?o }") == [("a",), ("d",)] and ask("SELECT ?o WHERE { x:c v:q? ?o }") == [("c",), ("d",)]
    assert len(ask("SELECT ?s ?o WHERE { ?s v:p+ ?o }")) == 10 and len(ask("SELECT ?s ?o WHERE { ?s v:p* ?o }")) == 11
    assert ask("SELECT ?o WHERE { x:a (v:p/v:p)/v:q ?o }") == [("d",)] and ask("SELECT ?s WHERE { ?s v:p+ ?s }") == [("a",), ("b",), ("c",), ("e",)]
    assert [r.result for r in db.sparql(f"PREFIX v: <{NS}> ASK {{ <http://x/a> v:p+ <http://x/c> }}").collect()] == [True]


def test_graph_management(db):
    db.load_quads(ITEMS)
    n, count_of = db.quads.count(), lambda g: db.quads.filter(F.col("g") == g).count()
    base, copy = "http://t.example/items", "http://t.example/copy"
    assert tuple(db.sparql(f"COPY <{base}> TO <{copy}>").first()) == (n, 0) and count_of(copy) == n
    assert tuple(db.sparql(f"ADD <{base}> TO <{copy}>").first()) == (0, 0) and count_of(copy) == n
    assert tuple(db.sparql(f"MOVE <{copy}> TO <{base}>").first()) == (n, 2 * n) and count_of(copy) == 0 and count_of(base) == n
    assert tuple(db.sparql("CREATE GRAPH <http://t.example/new> ; CLEAR SILENT ALL").first()) == (0, n) and db.quads.count() == 0
    with pytest.raises(ValueError, match="LOAD"):
        db.sparql("LOAD <http://t.example/x>")


# ---- discovery, sources, single subjects


def test_discovery(spark):
    rows_ = [("C", "http://p/a/", "s1", "app1", 1), ("C", "http://p/a/", "s2", "app2", 2), ("C", "http://p/b/", None, "app2", 2), ("D", "http://p/c/", None, "app1", 1)]
    clock = [0.0]
    d = discovery.Discovery(spark.createDataFrame(rows_, "rdf_class string, container string, shape string, app string, rank int"), discovery.Cache(10, lambda: clock[0]))
    assert [(r.container, r.shapes, r.rank) for r in d.discover("C").collect()] == [("http://p/a/", ["s1", "s2"], 1), ("http://p/b/", [], 2)]
    assert [r.container for r in d.discover("C", "app1").collect()] == ["http://p/a/"] and d.discover_all().count() == 4 and d.discover_by_app("app1").count() == 2
    assert d.is_registered("D") and not d.is_registered("E")
    asked = []
    shacl = validation.to_shacl(validation.Shape(NS + "C", (validation.Constraint("title", 1, 1, predicate=NS + "title"),)))
    read = lambda s: asked.append(s) or shacl
    for _ in range(2):
        a, b = d.tables_for("C", read)
        assert set(a.columns) == {"id", "title"} and a.base == "http://p/a/" and set(b.columns) == {"id"}
    assert asked == ["s1"]
    clock[0] = 11.0
    d.tables_for("C", read)
    d.register(ITEMS, "http://p/items/", "app1")
    assert asked == ["s1", "s1"] and d.is_registered(ITEMS.type_iri)
    made = discovery.registry_tables("http://p/registry")
    assert len(made) == 6 and made["DataGrant"].predicate_of("dataOwner").endswith("interop#dataOwner") and made["AccessGrant"].columns["hasDataGrant"].is_array


def test_sources_from_an_index(spark):
    db = Database(spark)
    index = spark.createDataFrame([("C", "p2"), ("C", "p1"), ("D", "p3"), ("C", "p1")], "rdf_class string, container string")
    names = db.add_sources_from_index(index, "C", lambda place: spark.createDataFrame([(place,)], "place string"))
    assert names == db.list_sources() and spark.table(names[0]).first().place == "p1" and len(names) == 2
    db.remove_source(names[0])
    assert db.list_sources() == names[1:]


def test_error_codes_are_whole_numbers(spark):
    said = ["port 4031 refused", "got 403", "HTTP 404: gone", "14041 rows", "timed out", "401"]
    found = spark.createDataFrame([(s,) for s in said], "m string").select(federation.classify(F.col("m")).alias("c"))
    assert [r.c for r in found.collect()] == ["NETWORK_ERROR", "FORBIDDEN", "NOT_FOUND", "NETWORK_ERROR", "TIMEOUT", "FORBIDDEN"]


def test_things_and_links(spark):
    q = spark.createDataFrame([], quads.QUAD)
    q = things.create_thing(q, "http://x/d#a", {NS + "name": "A", NS + "n": 3, NS + "tags": ["x", "y", "x"], NS + "link": "http://x/d#b"})
    assert {r.p.split("#")[-1]: r["values"] for r in things.read_thing(q, "http://x/d#a").collect()} == {"name": ["A"], "n": ["3"], "tags": ["x", "y"], "link": ["http://x/d#b"]}
    with pytest.raises(ValueError, match="exists already"):
        things.create_thing(q, "http://x/d#a", {})
    q = things.batch_things(q, [("create", "http://x/d#c", {NS + "name": "C"}), ("update", "http://x/d#a", {NS + "n": 4, NS + "tags": None}), ("delete", "http://x/d#c", None)])
    assert {r.p.split("#")[-1]: r["values"] for r in things.read_thing(q, "http://x/d#a").collect()} == {"name": ["A"], "n": ["4"], "link": ["http://x/d#b"]} and q.filter("s like '%c'").isEmpty()
    me = "http://x/me#i"
    for _ in range(2):
        q = things.add_link(q, me, NS + "made", "http://x/d#a")
    assert things.is_linked(q, me, NS + "made", "http://x/d#a") and things.list_links(q, me, NS + "made").count() == 1
    assert not things.is_linked(things.remove_link(q, me, NS + "made", "http://x/d#a"), me, NS + "made", "http://x/d#a")


def test_inline_children_go_with_their_parent(spark):
    edge = lambda s, p, o, kind="iri": ("g", s, NS + p, kind, o, None, None)
    q = spark.createDataFrame([edge("http://x/d#a", "has", "http://x/d#a-1"), edge("http://x/d#a-1", "has", "_:b1", "blank"), edge("_:b1", "name", "deep", "literal"), edge("http://x/d#a", "has", "http://y/other"), edge("http://y/other", "name", "stays", "literal"), edge("http://x/d#z", "has", "http://x/d#z-1"), edge("http://x/d#z-1", "has", "http://x/d#z")], quads.QUAD)
    left = things.delete_with_children(q, spark.createDataFrame([("http://x/d#a",)], "s string"), [NS + "has"])
    assert sorted({r.s for r in left.collect()}) == ["http://x/d#z", "http://x/d#z-1", "http://y/other"]
    assert things.delete_with_children(q, spark.createDataFrame([("http://x/d#z",)], "s string"), [NS + "has"]).filter("s like '%z%'").isEmpty()


def test_row_problems(spark):
    t = table("t", {"id": key(), "n": integer().not_null(), "ok": boolean(), "at": timestamp(), "link": uri(), "tags": string().array(), "d": string().not_null().default("x")}, NS + "T", namespace=NS)
    df = spark.createDataFrame([(None, "1", "true", "2024-01-01", "http://x", ["a"], None, "x"), ("k", None, "maybe", "soon", "no iri", None, "v", None)], "id string, n string, ok string, at string, link string, tags array<string>, d string, more string")
    found = sorted((r.column, r.problem) for r in validation.row_problems(t, df).collect())
    assert found == [("at", "is no timestamp"), ("link", "is no IRI"), ("more", "is no column"), ("more", "is no column"), ("n", "must have a value"), ("ok", "is no boolean")]
    assert [(r.column, r.problem) for r in validation.row_problems(t, df.select("id")).filter("row like '%k%'").collect()] == [("n", "is missing")]
    assert validation.row_problems(t, df.select("ok").limit(1), update=True).count() == 0
    found = validation.row_problems(t, spark.createDataFrame([("a", None)], "tags string, n string"), update=True)
    assert sorted(r.problem for r in found.collect()) == ["is no list", "must have a value"]


# ---- places on storage, streams


def test_a_layout_reads_one_folder(spark, tmp_path):
    t = table("filed", {"id": key(), "kind": string(), "createdAt": timestamp()}, NS + "F", namespace=NS, base="http://t.example/filed", template="{kind}/{yyyy}/{MM}/log.ttl#{id}")
    df = spark.createDataFrame([(str(k), "ab"[k % 2], f"2024-0{1 + k % 3}-01") for k in range(12)], "id string, kind string, at string").select("id", "kind", F.col("at").cast("timestamp").alias("createdAt"))
    path = f"file://{tmp_path}/filed"
    layout.write_table(df, t, path)
    found = layout.read_table(spark, t, path, kind="a")
    assert found.count() == 6 and all("kind=a" in f for f in found.inputFiles()) or "PartitionFilters: [isnotnull(kind" in plan(found)
    listed = layout.list_container(spark, path).collect()
    assert len([r for r in listed if r.path.endswith(".parquet")]) >= 6 and all(r.size > 0 for r in listed if r.path.endswith(".parquet"))


def test_one_document_is_watched(spark, db, tmp_path):
    from quadrel.streaming import notify

    at = str(tmp_path)
    events = [("1", "Update", "http://t.example/items#a", "2024-01-01", ""), ("2", "Delete", "http://t.example/items#b", "2024-01-01", ""), ("3", "Update", "http://t.example/other#z", "2024-01-01", ""), ("1", "Update", "http://t.example/items#a", "2024-01-01", "")]
    spark.createDataFrame(events, "id string, type string, object string, published string, state string").withColumn("published", F.col("published").cast("timestamp")).write.parquet(f"{at}/in")
    seen, gone = [], []
    q = notify.subscribe_by_iri(notify.events(spark, f"{at}/in"), f"{at}/checkpoint", db, ITEMS, "http://t.example/items#a", lambda rows: seen.extend(r.id for r in rows.collect()), lambda rows: gone.extend(r.object for r in rows.collect()), once=True)
    q.awaitTermination()
    assert seen == ["a"] and gone == ["http://t.example/items#b"]
