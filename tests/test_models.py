import ast

import pytest

from lodestone.functions import models as m
from lodestone.operators import types as ty

SOURCE = '''
from db import Base as B
import requests as rq

class User(B):
    __tablename__ = "users"
    id = Column(Integer, primary_key=True)
    name: Mapped[str] = mapped_column("full_name", String(50), nullable=False, unique=True, server_default=text("'x'"))
    team = Column(ForeignKey("org.teams.id"))
    age = Column()

class Dynamic(B):
    __tablename__ = PREFIX + "x"
    id = Column(Integer)

class Repo:
    def load(self, session):
        q = select(User).where(User.age > 1)
        return session.execute(select(User.name, User.age))

    def save(self, session):
        u = User(name="a")
        session.add(u)
        v = User()
        v = Other()
        session.add(v)
        session.add_all([User(), Team()])
        session.execute(insert(User).values({"full_name": 1}).values(**more))
        session.execute(update(User).where(User.id == 1).values(age=3))

def fetch(client, url):
    return client.get(url)

def use(client):
    body = fetch(client, "https://h.example/a/b").json()
    return body["k"], body["l"]

def post(session):
    r = session.post(f"{HOST}/x/{id}", json={"a": 1, "b": 2})
    r2 = session.get(f"{a}{b}")
    session.get(f"https://{h}/x")
    return r.json()["id"]
'''


def test_tables():
    got = m.model_tables(SOURCE)
    assert [r["column"] for r in got] == ["id", "full_name", "team", "age"] and {r["entity"] for r in got} == {"users"}
    by = {r["column"]: r for r in got}
    assert (by["id"]["primary_key"], by["id"]["nullable"], by["id"]["data_type"]) == (True, False, "Integer")
    assert (by["full_name"]["unique"], by["full_name"]["nullable"], by["full_name"]["default"]) == (True, False, "text(\"'x'\")")
    assert (by["team"]["foreign_table"], by["team"]["foreign_column"], by["team"]["data_type"]) == ("org.teams", "id", None)
    assert by["age"]["nullable"] is None


def test_accesses_and_calls():
    got = {(r["function"], r["model"], r["kind"]): r["columns"] for r in m.model_accesses(SOURCE)}
    assert got == {("Repo.load", "User", "read"): ["age", "name"], ("Repo.save", "User", "write"): ["age"], ("Repo.save", "Team", "write"): []}
    calls = {(r["function"], r["url"]): r for r in m.http_calls(SOURCE)}
    assert set(calls) == {("use", "https://h.example/a/b"), ("post", "/x/{param}")}
    assert calls["use", "https://h.example/a/b"]["wrapper"] == "fetch" and calls["use", "https://h.example/a/b"]["reads"] == ["k", "l"]
    assert (calls["post", "/x/{param}"]["host"], calls["post", "/x/{param}"]["sends"], calls["post", "/x/{param}"]["reads"]) == ("HOST", ["a", "b"], ["id"])
    assert m.imports_of(ast.parse(SOURCE)) == {"B": "db.Base", "rq": "requests"}
    assert m.model_tables("def (") == m.model_accesses("") == m.http_calls("x = 1") == []


def test_over_tables(spark, rows):
    files = spark.createDataFrame([(1, SOURCE, "x"), (2, None, "x"), (3, "", "x"), (4, "def f(session):\n    session.query(User)\n    session.query(Twice)\n", "x")], "file_id long, text string, model string")
    tables = m.tables(files)
    assert tables.count() == 4
    models = tables.select("file_id", "model", "entity").union(spark.createDataFrame([(7, "Twice", "a"), (8, "Twice", "b"), (4, "Twice", "c")], "file_id long, model string, entity string"))
    found = ty.resolved_accesses(m.accesses(files), models)
    assert rows(found.filter("file_id = 4").select("entity", "kind")) == [("c", "read"), ("users", "read")]
    types = spark.createDataFrame([("s1", "User | None"), ("s2", "User | Nobody"), ("s3", "Twice"), ("s4", None), ("s5", "")], "symbol string, type string")
    assert rows(ty.resolved_types(types, models)) == [("s1", "users")]
    probes = spark.createDataFrame([("a.py", 3), ("b.py", None)], "path string, offset int").fillna(0)
    assert sorted(r["type"] for r in ty.inferred(probes, lambda: lambda p, o: f"{p}:{o}").collect()) == ["a.py:3", "b.py:0"]
    assert ty.next_layer(types, models, True) is types and ty.next_layer(types, models, False) is models


@pytest.mark.parametrize("text", ["", "\n", "class A:\n    __tablename__ = 'a'\n"])
def test_small_sources(text):
    assert all(r.get("column") is None for r in m.model_tables(text))
