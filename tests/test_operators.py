"""Identifiers, quads, RDF text, SPARQL, changes, merging, shapes, federation, notifications."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from quadrel.database import Database
from quadrel.functions.predicates import eq, gt
from quadrel.operators import conflicts, federation, identity, mutations, quads, validation
from quadrel.schema import boolean, column, double, integer, key, string, table, timestamp
from quadrel.sources import layout, rdf
from quadrel.streaming import notify

NS = "http://t.example/v#"
DOC = table("docs", {"id": key(), "name": string().not_null(), "age": integer(), "tags": string().array(), "at": timestamp(), "ok": boolean(), "ratio": double(), "friend": column("uri").link("http://t.example/docs#")}, NS + "Doc", namespace=NS, base="http://t.example/docs", template="#{id}")
T0 = datetime.datetime(2024, 1, 2, 3, 4, 5)


@pytest.fixture
def db(spark):
    d = Database(spark)
    d.insert(DOC).values([
        {"id": "a", "name": "Ann \"q\"", "age": 3, "tags": ["x", "y", "x"], "at": T0, "ok": True, "ratio": 0.5, "friend": "b"},
        {"id": "b", "name": "Bob\nline", "age": None, "tags": [], "at": T0, "ok": False, "ratio": 1.0, "friend": None},
    ]).run()
    return d


def test_templates(spark):
    df = spark.createDataFrame([("c1", "Café  Au—Lait!", T0), ("c2", "ﬁne", T0)], "chat string, title string, createdAt timestamp")
    made = identity.render("{chat}/{yyyy}/{MM}/{dd}/{title|slug}.ttl#m", {c: F.col(c) for c in df.columns}, F.col("createdAt"))
    assert [r[0] for r in df.select(made).collect()] == ["c1/2024/01/02/café-au-lait.ttl#m", "c2/2024/01/02/fine.ttl#m"]
    back = identity.extract(F.lit("http://x/c1/2024/m.ttl#7"), "http://x", "{chat}/{yyyy}/m.ttl#{id}")
    assert spark.range(1).select(*(c.alias(n) for n, c in back.items())).first().asDict() == {"chat": "c1", "yyyy": "2024", "id": "7"}
    assert [r[0] for r in identity.with_index(df, ["chat"]).select("index").collect()] == [1, 2]
    picks = spark.range(1).select(identity.path_pick(F.lit("/a/b/c/d"), 1), identity.path_pick(F.lit("/a/b/c/d"), -1), identity.path_pick(F.lit("/a/b/c/d"), 1, 3))
    assert tuple(picks.first()) == ("b", "d", "b/c")
    with pytest.raises(ValueError, match="needs a value"):
        identity.render("{nope}", {})
    with pytest.raises(ValueError, match="missing"):
        identity.iri_of(table("m", {"id": key()}, NS + "M", namespace=NS, template="{chat}/x#{id}"), "1")


def test_quads_roundtrip_and_ntriples(spark, db, tmp_path):
    q = quads.wide_to_quads(db.frame(DOC), DOC)
    rdf.write_ntriples(q, str(tmp_path / "nt"))
    (tmp_path / "nt" / "more.nt").write_text("this is no statement\n# a comment\n")
    back = rdf.read_ntriples(spark, str(tmp_path / "nt"))
    assert rdf.broken_lines(spark, str(tmp_path / "nt")).count() == 1
    for source in (q, back):
        rows = {r.id: r for r in quads.type_scan(source, DOC).collect()}
        assert (rows["a"].name, rows["a"].tags, rows["a"].at, rows["a"].friend, rows["a"].ratio) == ('Ann "q"', ["x", "y"], T0, "http://t.example/docs#b", 0.5)
        assert (rows["b"].name, rows["b"].age, rows["b"].tags, rows["b"].ok) == ("Bob\nline", None, [], False)
    more = q.unionByName(q.filter(F.col("o") == "3").withColumn("o", F.lit("1")))
    assert quads.conflicting_values(more, DOC).select("n_values").collect() == [(2,)]
    assert rdf.check_quads(q).count() == 0
    assert rdf.check_quads(q.withColumn("p", F.lit("oops"))).count() == q.count()


TURTLE = """@prefix ex: <http://t.example/> . @base <http://t.example/doc> .
# comment
<#a> a ex:Doc ; ex:name "A\\"b"@en , 'c' ; ex:n 1, 2.5, 1e3 ; ex:ok true ; ex:inner [ ex:x <#b> ] ; ex:list ( 1 2 ) .
ex:b ex:long \"\"\"two
lines\"\"\" ; .
"""


def test_turtle_and_jsonld(spark, tmp_path):
    found = rdf.parse_turtle(TURTLE, "g")
    a = [(q.p.rsplit("/")[-1], q.o, q.o_kind) for q in found if q.s == "http://t.example/doc#a"]
    assert ("name", 'A"b', "literal") in a and ("n", "1e3", "literal") in a and ("ok", "true", "literal") in a and len(a) == 9
    assert any(q.o == "two\nlines" for q in found) and sum(q.p == rdf.RDF + "rest" for q in found) == 2
    for bad in ("<a> <b> .", "ex:a ex:b ex:c .", "<a> <b> <c>"):
        with pytest.raises(ValueError, match="Turtle"):
            rdf.parse_turtle(bad)
    doc = {"@context": {"name": "http://t.example/name", "knows": {"@id": "http://t.example/knows", "@type": "@id"}, "ex": "http://t.example/"}, "@id": "ex:a", "@type": "ex:Doc", "name": ["x", {"@value": "y", "@language": "en"}], "knows": "ex:b", "ex:n": 3}
    assert sorted((q.p.rsplit("/")[-1], q.o) for q in rdf.parse_jsonld(json.dumps(doc))) == [("22-rdf-syntax-ns#type", "http://t.example/Doc"), ("knows", "http://t.example/b"), ("n", "3"), ("name", "x"), ("name", "y")]
    (tmp_path / "one.ttl").write_text(TURTLE)
    (tmp_path / "two.ttl").write_text("no turtle")
    read = rdf.read_documents(spark, f"{tmp_path}/*.ttl", base="http://t.example/doc")
    assert read.filter("p = 'error:'").count() == 1 and read.filter("p <> 'error:'").count() == len(found)


def sparql(db, text):
    return sorted(map(tuple, db.sparql(f"PREFIX v: <{NS}>\n{text}").collect()), key=str)


def test_sparql(spark, db):
    db.quads = quads.wide_to_quads(db.frame(DOC), DOC)
    assert sparql(db, "SELECT ?n ?f WHERE { ?s v:name ?n OPTIONAL { ?s v:friend ?x . ?x v:name ?f } }") == [('Ann "q"', "Bob\nline"), ("Bob\nline", None)]
    assert sparql(db, "SELECT ?t WHERE { ?s v:tags ?t MINUS { ?s v:tags 'x' } }") == []
    assert sparql(db, "SELECT (COUNT(DISTINCT ?t) AS ?n) WHERE { ?s v:tags ?t }") == [("2",)]
    assert sparql(db, "SELECT ?x ?f WHERE { VALUES (?x ?f) { (1 UNDEF) (2 v:a) } FILTER(!BOUND(?f) || ?x = 2) }") == [("1", None), ("2", NS + "a")]
    assert sparql(db, "SELECT ?n WHERE { ?s v:name ?n ; v:age ?a . FILTER(?a IN (1, 3) && EXISTS { ?s v:friend ?o }) }") == [('Ann "q"',)]
    assert sparql(db, "SELECT (IF(?a > 2, 'big', 'small') AS ?size) (STRLEN(STR(?a)) AS ?l) WHERE { ?s v:age ?a }") == [("big", "1")]
    assert sparql(db, "ASK { ?s v:name 'nobody' }") == [(False,)]
    assert sparql(db, "INSERT DATA { <http://t.example/docs#c> a v:Doc ; v:name 'C' } ; DELETE DATA { <http://t.example/docs#a> v:age 3 }") == [(2, 1)]
    assert sparql(db, "DELETE { ?s v:name ?n } INSERT { ?s v:name ?u } WHERE { ?s v:name ?n BIND(UCASE(?n) AS ?u) FILTER(?n != ?u) }") == [(2, 2)]
    assert sorted(r.name for r in quads.type_scan(db.quads, DOC).collect()) == ['ANN "Q"', "BOB\nLINE", "C"]
    for text, match in (("SELECT a FROM b", "SQL"), ("LOAD <http://t.example/x>", "not supported"), ("", "needed"), ("SELECT ?x WHERE { ?x nope:y 1 }", "prefix")):
        with pytest.raises(ValueError, match=match):
            db.sparql(text)


def test_changes(db):
    assert db.frames["docs"].filter("id = 'a'").first().friend == "http://t.example/docs#b"
    with pytest.raises(ValueError, match="Duplicate primary key"):
        db.insert(DOC).values({"id": "a", "name": "again"}).run()
    with pytest.raises(ValueError, match="twice"):
        db.insert(DOC).values([{"id": "n", "name": "1"}, {"id": "n", "name": "2"}]).run()
    with pytest.raises(ValueError, match="must have a value"):
        db.insert(DOC).values({"id": "n"}).run()
    assert db.update(DOC).set({"tags": ["z"], "age": None}).where({"name": "Bob\nline"}).returning("id", "tags", "age").collect() == [("b", ["z"], None)]
    with pytest.raises(ValueError, match="needs where"):
        db.update(DOC).set({"age": 1}).run()
    assert mutations.edit_set(db, DOC, "b", "tags", add=("q",), remove=("z",)).first().tags == ["q"]
    with pytest.raises(RuntimeError):
        db.transaction(lambda d: (d.delete(DOC).where({"id": "a"}).run(), (_ for _ in ()).throw(RuntimeError())))
    assert db.frames["docs"].count() == 2
    assert db.delete(DOC).where({"id": "a"}).returning("id").collect() == [("a",)]
    assert [r.id for r in db.frames["docs"].collect()] == ["b"]
    new = db.spark.createDataFrame([("b", "B2"), ("c", "C")], "id string, name string")
    assert [r.id for r in mutations.insert_once(db, DOC, new).collect()] == ["c"]
    assert {r.id: r.name for r in mutations.upsert(db, DOC, new).collect()} == {"b": "B2", "c": "C"}
    assert mutations.update_by_iri(db, DOC, "http://t.example/docs#c", {"age": 9}).first().age == 9
    assert db.batch(lambda d: d.query(DOC).count(), lambda d: d.query(DOC).count(gt(DOC.c.age, 5))) == [2, 1]
    seen = []
    hooked = table("docs", dict(DOC.columns), DOC.type_iri, namespace=NS, base=DOC.base, template="#{id}", hooks={"after_delete": lambda rows: seen.append(rows.count()) or 1 / 0})
    db.delete(hooked).where(eq(hooked.c.name, "C")).run()
    assert seen == [1]


def test_merging(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), "id int, a string, b string, at int")
    base, local, remote = df((1, "x", "y", 0), (2, "x", "y", 0), (3, "x", "y", 0)), df((1, "L", "y", 5), (2, "x", "y", 1), (4, "n", "n", 1)), df((1, "x", "R", 3), (2, "x", "y", 1), (3, "x", "y", 0))
    got = lambda d: {r.id: (r.a, r.b) for r in d.collect()}
    assert got(conflicts.last_write_wins(local, remote, "id"))[1] == ("L", "y")
    assert got(conflicts.by_timestamp(local, remote, "id", "at")) == {1: ("L", "y"), 2: ("x", "y"), 3: ("x", "y"), 4: ("n", "n")}
    assert got(conflicts.by_field(base, local, remote, "id")) == {1: ("L", "R"), 2: ("x", "y"), 4: ("n", "n")}
    assert got(conflicts.by_user(local.drop("at"), remote.drop("at"), "id", lambda c, l, r: F.concat_ws("+", l, r)))[1] == ("L+x", "y+R")  # noqa: E741
    assert sorted((r.id, r.field) for r in conflicts.conflicts(local, remote, "id").collect()) == [(1, "a"), (1, "at"), (1, "b")]


def test_shapes(spark, db):
    shape = validation.Shape(NS + "Doc", (
        validation.Constraint("name", 1, 1, quads.XSD + "string", pattern="^A"), validation.Constraint("tags", min_count=1, max_count=1),
        validation.Constraint("friend", node_kind="IRI", predicate=NS + "friend"), validation.Constraint("age", datatype=quads.XSD + "integer"),
    ))
    broken = sorted((r.id, r.path, r.constraint) for r in validation.violations(db.frame(DOC), shape, "id").collect())
    assert broken == [("a", "tags", "maxCount"), ("b", "name", "pattern"), ("b", "tags", "minCount")]
    own = validation.shape_of(DOC)
    back = validation.with_predicates(validation.from_shacl(validation.to_shacl(own)), DOC)
    assert {(c.path, c.min_count, c.max_count, c.node_kind) for c in back.constraints} == {(c.path, c.min_count, c.max_count, c.node_kind) for c in own.constraints}
    made = validation.table_of(validation.from_shacl(validation.to_shacl(own)), "again")
    assert made.columns["age"].kind == "integer" and made.columns["tags"].is_array
    assert validation.check_frame(DOC, spark.createDataFrame([("x", 1.5)], "id string, age double")) == ["name is missing", "age is double, not bigint"]


def test_federation(spark):
    parents = spark.createDataFrame([(1, ["p1", "gone"]), (2, ["p2"]), (3, [])], "id int, places array<string>")
    sources = spark.createDataFrame([("p1", True, None), ("p2", False, "request timed out")], "place string, ok boolean, message string")
    rows = spark.createDataFrame([("p1", "r1"), ("p1", "r2"), ("p2", "r3")], "place string, v string")
    good, errors = federation.remote_rows(parents, "id", lambda: F.col("places"), sources, rows)
    assert sorted((r.id, r.row.v) for r in good.collect()) == [(1, "r1"), (1, "r2")]
    assert sorted((r.id, r.code) for r in errors.collect()) == [(1, "NOT_FOUND"), (2, "TIMEOUT"), (3, "DISCOVERY_FAILED")]
    both = federation.union_sources({"a": rows, "b": rows.drop("v")})
    assert both.count() == 6 and both.filter("source = 'b' and v is null").count() == 3


def test_layout(spark, tmp_path):
    t = table("log", {"id": key(), "chat": string(), "createdAt": timestamp()}, NS + "Log", namespace=NS, template="{chat}/{yyyy}/{MM}/m.ttl#{id}")
    df = spark.createDataFrame([("1", "c1", T0), ("2", "c2", T0)], t.struct_type())
    layout.write_table(df, t, str(tmp_path / "log"))
    assert (tmp_path / "log/chat=c1/yyyy=2024/MM=01").is_dir()
    one = layout.read_table(spark, t, str(tmp_path / "log"), chat="c2")
    assert [r.id for r in one.collect()] == ["2"] and "PartitionFilters: [isnotnull(chat" in one._jdf.queryExecution().executedPlan().toString()
    assert layout.list_container(spark, str(tmp_path / "log")).count() == 2


def test_notifications(spark, db, tmp_path):
    rows = [("1", "Create", "http://t.example/docs#a", T0, None), ("1", "Create", "http://t.example/docs#a", T0, None), ("2", "Update", "http://t.example/docs#b", T0, None), ("3", "Delete", "http://else/x", T0, None)]
    spark.createDataFrame(rows, notify.EVENT).write.parquet(str(tmp_path / "in"))
    seen = {}
    run = lambda where, **more: notify.subscribe(notify.events(spark, str(tmp_path / "in")), str(tmp_path / where), {k: lambda d, k=k: seen.setdefault(k, []).extend(r.id for r in d.collect()) for k in ("Create", "Update", "Delete", "*")}, once=True, **more).awaitTermination()
    run("c1", t=DOC)
    assert {k: sorted(v) for k, v in seen.items()} == {"Create": ["1"], "Update": ["2"], "*": ["1", "2"]}
    seen.clear()
    run("c2", iri="http://else/x#frag")
    assert seen == {"Delete": ["3"], "*": ["3"]}
    changed = notify.reread(db, DOC, spark.createDataFrame([("http://t.example/docs#a",)], "object string"))
    assert [r.id for r in changed.collect()] == ["a"]
    with pytest.raises(ValueError, match="kind of event"):
        notify.subscribe(None, "", {"Nope": print})
