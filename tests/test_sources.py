import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import analyze
from lodestone.sources import tracker
from lodestone.streaming import index

TREE = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "One "}, {"type": "text", "text": "line"}]}, {"type": "bulletList", "content": [{"type": "listItem", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "item"}]}]}]}]}


def test_tree_text(spark):
    df = spark.createDataFrame([(json.dumps(TREE),), ("plain",), ("{cut",), (None,), ("",)], "t string").select(tracker.tree_text("t").alias("t"))
    assert [r[0] for r in df.collect()] == ["One line\nitem", "plain", "{cut", None, ""]


def test_front_matter(spark):
    matter, body = tracker.front_matter(F.col("t"))
    df = spark.createDataFrame([("---\nid: R-1\n---\nText\nmore",), ("no matter",), (None,)], "t string").select(matter, body)
    assert [tuple(r) for r in df.collect()] == [("id: R-1", "Text\nmore"), (None, "no matter"), (None, None)]


def test_name_status_and_degradation(spark, rows):
    log = spark.createDataFrame([("M\0a.py\0R087\0old.py\0new.py\0A\0b.py\0D\0c.py\0R100\0x.txt\0y.py\0",), ("",), (None,)], "log string")
    changes = tracker.name_status(log)
    assert rows(changes) == sorted([("modified", "a.py", "a.py"), ("renamed", "old.py", "new.py"), ("added", None, "b.py"), ("deleted", "c.py", None), ("renamed", "x.txt", "y.py")], key=str)
    kept = tracker.degrade_renames(changes, lambda p: F.coalesce(p.endswith(".py"), F.lit(False)))
    assert ("added", None, "y.py") in rows(kept) and len(rows(kept)) == 5


def test_path_allowed(spark):
    df = spark.createDataFrame([("src/a.py",), ("src/vendor/b.py",), ("docs/c.py",), ("src/gen/d.py",)], "p string")
    assert [r[0] for r in df.filter(tracker.path_allowed(F.col("p"), ["src/"], ["src/gen"], ["vendor"])).collect()] == ["src/a.py"]
    assert df.filter(tracker.path_allowed(F.col("p"), [], [], [])).count() == 4


def test_commit_records(spark, rows):
    df = spark.createDataFrame([("ab12\0Ann\x002024\0Title\nbody\0diff",), ("",)], "log string")
    assert rows(tracker.commit_records(df))[1] == ("ab12", "Ann", "2024", "Title", "Title\nbody")


def test_openapi(spark):
    spec = {
        "openapi": "3.0.0", "security": [{"key": []}], "components": {"parameters": {"Id": {"name": "id", "in": "path", "required": True}}},
        "paths": {"/a/{id}": {"parameters": [{"$ref": "#/components/parameters/Id"}], "get": {"operationId": "getA", "responses": {"200": {}, "404": {}}}, "post": {"parameters": [{"name": "q", "in": "query"}], "security": [{"oauth": ["w", "r"]}]}}},
    }
    df = spark.createDataFrame([("s.json", json.dumps(spec)), ("x", "no json"), ("y", None)], "path string, text string")
    got = {(r["method"], r["route"], r["operation_id"], tuple(r["parameters"]), tuple(r["security"]), tuple(r["responses"])) for r in tracker.openapi_operations(df).collect()}
    assert got == {("GET", "/a/{id}", "getA", ("path:id!",), ("key",), ("200", "404")), ("POST", "/a/{id}", None, ("path:id!", "query:q"), ("oauth:[r,w]",), ())}


def test_paged_source(spark, rows):
    class Pages(tracker.PagedSource):
        fetch = staticmethod(lambda page: [{"id": f"{page}-{n}"} for n in range(2)])

        @classmethod
        def name(cls):
            return "pages_of_test"

    spark.dataSource.register(Pages)
    got = spark.read.format("pages_of_test").option("pages", "3").load().select("page", "id")
    assert rows(got) == [(p, f"{p}-{n}") for p in range(3) for n in range(2)]


SOURCE = '''import requests
class Repo:
    def save(self, row):
        self.db.execute("INSERT INTO orders (id, total) VALUES (1, 2)")
        return helper(row)

@router.post("/v1/orders")
async def create(body):
    """SELECT is a word here."""
    requests.get(f"https://svc.example/api/{body.id}/x")
    return "SELECT o.id FROM Orders o JOIN customers c ON c.id = o.cid WHERE x = 'from y'"

def helper(row): return 1
def test_it(): helper(1)
'''


def test_python_symbols(spark):
    df = spark.createDataFrame([(1, "src/shop/repo.py", SOURCE), (2, "bad.py", "def ("), (3, "x.txt", "func A() {}"), (4, "n.py", None)], "file_id long, path string, text string")
    got = {r["canonical"]: r for r in analyze.symbols(df).collect()}
    assert {k: r["kind"] for k, r in got.items()} == {"shop.repo.Repo": "class", "shop.repo.Repo.save": "method", "shop.repo.create": "function", "shop.repo.helper": "function", "shop.repo.test_it": "test"}
    create = got["shop.repo.create"]
    assert create["endpoints"] == ["POST /v1/orders"] and create["external"] == ["GET https://svc.example/api/{param}/x"] and create["reads"] == ["customers", "orders"]
    assert got["shop.repo.Repo.save"]["writes"] == ["orders"] and (create["start_line"], create["end_line"]) == (8, 11)
    found = analyze.symbols(df)
    assert {tuple(r) for r in analyze.resolved_calls(found).collect()} == {("shop.repo.Repo.save", "shop.repo.helper"), ("shop.repo.test_it", "shop.repo.helper")}
    with pytest.raises(ValueError):
        analyze.register("py", analyze.python_symbols)


@pytest.mark.parametrize(
    "sql,want",
    [
        ("UPDATE a.b SET x = 1, y = (SELECT z FROM t) WHERE q = 2", [("write", "a.b", ("x", "y")), ("read", "t", ())]),
        ("WITH c AS (SELECT 1 FROM real_t) DELETE FROM d USING c", [("read", "real_t", ()), ("write", "d", ())]),
        ("SELECT 1 -- FROM no\n/* FROM no */ FROM {table} JOIN `Q` ON 'from x'", [("read", "q", ())]),
        ("INSERT INTO t DEFAULT VALUES", [("write", "t", ())]),
    ],
)
def test_sql_accesses(sql, want):
    assert analyze.sql_accesses(sql) == want


def test_streaming_index_is_incremental(spark, tmp_path, rows):
    source, root, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    make = lambda *r: spark.createDataFrame([(i, p, "python", "8", h, c, t) for i, p, h, c, t in r], index.FILES)
    make((1, "a.py", "h1", 1, "def one(): pass"), (2, "b.py", "h2", 1, "def two(): pass")).write.parquet(source)
    index.run(spark, source, root, checkpoint)
    sink = index.IndexSink(root)
    first = spark.createDataFrame(sink.files(spark).collect(), sink.files(spark).schema)
    assert {r["name"] for r in sink.symbols(spark).collect()} == {"one", "two"}
    make((3, "a.py", "h3", 2, "def three(): pass"), (4, "c.py", "h4", 2, "def four(): pass")).write.mode("append").parquet(source)
    index.run(spark, source, root, checkpoint)
    assert {r["name"] for r in sink.symbols(spark).collect()} == {"two", "three", "four"}
    assert rows(index.changes(first, sink.files(spark))) == [("a.py", "modified"), ("c.py", "added")]
    before = sink.files(spark).count()
    index.run(spark, source, root, checkpoint)
    assert sink.files(spark).count() == before
