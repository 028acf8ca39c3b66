import datetime as dt

import pytest

from lodestone.sources import connect, documents as doc

yaml = pytest.importorskip("yaml")
REQ = "id: REQ-1\ntype: requirement\nstatement: Users may cancel.\nfeature: FEAT-1\nimplementation:\n  - a.b.cancel\n  - {symbol: a.b.twice, repair_agent: bot}\ntests: [t.test_cancel]\nanchors:\n  - {symbol: a.b.cancel, fingerprint: f, ordinal: 2}\n"
FEAT = "---\nid: FEAT-1\nname: Cancelling\ndescription: All of it\n---\n# Text\n"


def test_documents(spark, rows):
    files = spark.createDataFrame([("x/r.yaml", REQ, "z"), ("features/f.md", FEAT, "z"), ("bad.yaml", "id: [", "z"), ("none.yaml", None, "z"), ("d.yaml", "id: D\ntype: decision\ntitle: T", "z")], "path string, text string, id string")
    got = {r["path"]: r for r in doc.parsed(files).collect()}
    r = got["x/r.yaml"]
    assert (r["id"], r["kind"], r["title"], r["status"], r["implementation_expected"]) == ("REQ-1", "requirement", "Users may cancel.", "active", True)
    assert [tuple(x) for x in r["implementation"]] == [("a.b.cancel", None, "implementation[0]"), ("a.b.twice", "bot", "implementation[1]")] and r["anchors"][0]["ordinal"] == 2
    assert got["features/f.md"]["kind"] == "feature" and got["features/f.md"]["title"] == "Cancelling"
    assert got["bad.yaml"]["error"] and got["none.yaml"]["error"] and got["d.yaml"]["error"] == "decision is missing"
    docs = doc.parsed(files).filter("error is null")
    symbols = spark.createDataFrame([("a.b.cancel", "k1"), ("a.b.cancel", "k1"), ("a.b.twice", "k2"), ("a.b.twice", "k3")], "name string, key string")
    claims, lost = doc.document_claims(docs, symbols)
    assert rows(claims) == sorted([("k1", "intent:REQ-1", "implements", "assertion", "documentation", 10000, "business_context_explicit", "implementation[0]"), ("intent:REQ-1", "intent:FEAT-1", "depends_on", "assertion", "documentation", 10000, "business_context_explicit", "feature")], key=str)
    assert rows(lost) == [("REQ-1", "a.b.twice", "ambiguous"), ("REQ-1", "t.test_cancel", "missing")]
    after = docs.filter("id = 'REQ-1'").selectExpr("id", "'other' as content_hash").union(spark.createDataFrame([("N", "h")], "id string, content_hash string"))
    assert rows(doc.document_changes(docs, after)) == [("FEAT-1", "retire"), ("N", "create"), ("REQ-1", "version")]


def test_folder_of_documents(spark, tmp_path):
    (tmp_path / "features").mkdir()
    (tmp_path / "r.yaml").write_text(REQ)
    (tmp_path / "features" / "f.md").write_text(FEAT)
    got = {r["id"]: r["path"] for r in doc.read_documents(spark, f"file://{tmp_path}").collect()}
    assert got == {"REQ-1": "r.yaml", "FEAT-1": "features/f.md"}
    (tmp_path / "again.yaml").write_text(REQ)
    with pytest.raises(ValueError, match="REQ-1"):
        doc.read_documents(spark, f"file://{tmp_path}")


def test_written_documents_read_back():
    name, text = doc.written("DEC-1", "decision", 'Say "no"', "line\nline", ["a.b"], {"DEC-2"})
    back = doc.normalised(name, text)
    assert (back["id"], back["title"], back["body"], back["implementation"][0]["symbol"]) == ("DEC-1", 'Say "no"', "line\nline", "a.b")
    with pytest.raises(FileExistsError):
        doc.written("DEC-2", "decision", "t", "b", [], {"DEC-2"})


def test_retries():
    now = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    assert connect.retry_delay("7") == 7 and connect.retry_delay("Mon, 01 Jan 2024 00:00:05 GMT", now) == 5 and connect.retry_delay("Sun, 31 Dec 2023 00:00:00 GMT", now) == 0 and connect.retry_delay("soon") is None
    slept, answers = [], iter([connect.Response(503), connect.Response(429, retry_after="90"), connect.Response(200, "ok")])
    assert connect.with_retries(lambda: next(answers), sleep=slept.append) == "ok" and slept == [1.0, 30.0]
    with pytest.raises(connect.StatusError) as e:
        connect.with_retries(lambda: connect.Response(502), sleep=lambda s: None)
    assert e.value.attempts == 4
    with pytest.raises(connect.StatusError):
        connect.with_retries(lambda: connect.Response(404), sleep=lambda s: None)


def test_batches_isolate_bad_keys():
    asked = []

    def fetch(keys):
        asked.append(list(keys))
        if "bad" in keys:
            raise connect.BadKey("bad")
        return {k: k.upper() for k in keys if k != "gone" and not (k == "shy" and len(keys) > 1)}

    found, missing = connect.resolve_batch(["a", "b", "bad", "gone", "shy"], fetch)
    assert found == {"a": "A", "b": "B", "shy": "SHY"} and sorted(missing) == ["bad", "gone"]
    assert connect.resolve_batch([], fetch) == ({}, [])
