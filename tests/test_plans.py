"""Elements, the store, the postfix language, and the queries against their SQL."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bitloom.plans.element import Element, Session, Worker, number_text
from bitloom.plans.forth import Interpreter, ParseError, parse, shown
from bitloom.sources.store import CacheStore, CasMismatch, MemoryStore, NotFound, Store


def test_elements(spark):
    s = Session(spark)
    a, b, e = s.inscribe(["a", "b", "c"]), s.tokenize("B c, d"), s.empty()
    assert (a + b) == s.inscribe("abcd") and (a * b) == s.inscribe("bc") and (a - b) == s.inscribe("a")
    assert a.symmetric_difference(b) == s.inscribe("ad") and len(a) == 3 and a.popcount == 3
    assert e.is_empty and e.card == 0 and e.key.startswith("h:") and e.jaccard(e) == 1.0
    assert a.bss_inclusion(e) == 1.0 and a.bss_exclusion(e) == 0.0 and (a * b).is_subset_of(a) and a.is_superset_of(a * b)
    assert a.approx_eq(s.inscribe("cba"), 1.0) and a.morph_to(b, 0.5, 0.5)["holds"]
    assert Element.from_bytes(spark, a.to_bytes()) == a and Element.from_bytes(spark, b"x") is None
    assert s.inscribe([1, 2.0, "x", None, True]) == s.inscribe(["1", "2", "x"])


def _laws(store):
    store.put("h:1", b"a")
    store.put("h:2", b"b")
    store.put("v:1", b"c")
    assert store.get("h:1") == b"a" and store.get("h:9") is None and store.has("v:1") and not store.has("v:2")
    assert store.list("h:") == ["h:1", "h:2"] and store.list() == ["h:1", "h:2", "v:1"]
    store.put("h:1", b"z")
    assert store.get("h:1") == b"z"
    assert store.delete("h:2") and not store.delete("h:2")


def _kept(store):
    store.pin("h:1")
    store.pin("h:1")
    store.put_tmp("system:tf", b"1")
    keys = lambda gone: gone if isinstance(gone, list) else [r.key for r in gone.collect()]
    assert keys(store.gc()) == ["v:1"] and store.list() == ["h:1"] and store.get_tmp("system:tf") == b"1"
    assert store.cas_tmp("system:tf", b"1", b"2") and store.get_tmp("system:tf") == b"2"
    with pytest.raises(CasMismatch):
        store.cas_tmp("system:tf", b"1", b"3")
    with pytest.raises(NotFound):
        store.cas_tmp("none", b"1", b"3")
    store.unpin("h:1")
    assert keys(store.gc()) == ["h:1"] and store.list() == []


def test_stores(spark, tmp_path):
    for store in (MemoryStore(), Store(spark, str(tmp_path / "store"))):
        _laws(store)
        _kept(store)
    _laws(CacheStore(MemoryStore(), 10, 60))
    small = CacheStore(MemoryStore(), 1, 60)
    _laws(small)
    assert small.cache_size() == 1 and small.gc() == []
    old = CacheStore(MemoryStore(), 5, -1.0)
    old.put("k", b"1")
    old.inner.put("k", b"2")
    assert old.get("k") == b"2"


def test_store_after_a_write_that_died(spark, tmp_path):
    """Whatever a write leaves behind when it dies, the store has what it had before."""
    import shutil

    store = Store(spark, str(tmp_path / "store"))
    store.put_all(spark.createDataFrame([(f"h:{i}", bytearray([i])) for i in range(20)] + [("v:1", None)], "key string, bytes binary"))
    store.put("h:3", b"new")
    store.pin_all(spark.createDataFrame([(f"h:{i}",) for i in range(0, 20, 2)], "key string"))
    have = {r.key: bytes(r.bytes) for r in store.contents().collect()}
    assert have == {f"h:{i}": bytes([i]) for i in range(20)} | {"h:3": b"new", "v:1": b""}
    shutil.copytree(tmp_path / "store" / "content-0" / "prefix=h", tmp_path / "store" / "content-1" / "prefix=h")  # a compaction without its marker
    (tmp_path / "store" / "content-0" / "_temporary" / "0").mkdir(parents=True)  # an append without its commit
    (tmp_path / "store" / "content-0" / "_temporary" / "0" / "part-0.parquet").write_bytes(b"half")
    again = Store(spark, str(tmp_path / "store"))
    assert {r.key: bytes(r.bytes) for r in again.contents().collect()} == have
    again.compact()
    assert {r.key: bytes(r.bytes) for r in again.contents().collect()} == have and not (tmp_path / "store" / "content-0").exists()
    assert again.gc().count() == 11 and again.list() == sorted(f"h:{i}" for i in range(0, 20, 2))
    again.put("h:1", b"back")
    assert again.get("h:1") == b"back" and Store(spark, str(tmp_path / "store")).delete("h:1") and not again.has("h:1")


@settings(max_examples=300, deadline=None)
@given(st.floats(allow_nan=False))
def test_numbers_are_written_in_full(x):
    text = number_text(x)
    assert float(text) == x and "e" not in text.lower()
    word = parse(text)[0]
    assert parse(str(word)) == [word] and number_text(1234567.0) == "1234567" and number_text(1e21) == "1" + "0" * 21


def test_host_calls(spark):
    s = Session(spark)
    assert s.eval('"a b c" TOKENIZE CARD') == 3.0 and s.eval("") is None and s.exec("1 2") == [1.0, 2.0]
    assert s.eval_element("1234567 1 INSCRIBE") == s.inscribe(["1234567"]) == s.inscribe([1234567.0]) == s.inscribe([1234567])
    with pytest.raises(ValueError):
        s.eval_element("1 2")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from bitloom.__main__ import main

    (tmp_path / "p").write_text('"x y" TOKENIZE POPCOUNT')
    assert main(["-e", "1 2.5 SWAP"]) == 0 and main(["-f", str(tmp_path / "p")]) == 0 and main(["--forth-debug", "1234567 dup"]) == 0
    assert capsys.readouterr().out.split("\n")[:3] == ["[2.5, 1]", "[2]", "1234567 dup"]
    assert main(["-e", '"open']) == 1 and "unterminated" in capsys.readouterr().err


def test_worker(spark):
    w = Worker(Session(spark))
    a, b = w.inscribe(["x", "y"]), w.inscribe(["y"])
    assert w.has_resource(a) and w.bss_inclusion(a, b) == 1.0 and w.bss_inclusion(a, "h:none") is None


def test_parsing():
    words = parse('1 -2.5 inf "a \\"b\\"" \\ to the end\n( a (nested) one ) Dup : F card ; x')
    assert [w.kind for w in words] == ["num", "num", "num", "str", "ident", "def", "ident"] and words[3].value == 'a "b"'
    assert parse(" ".join(map(str, words))) == words
    for bad in ('"x', "( x", '"x\\'):
        with pytest.raises(ParseError):
            parse(bad)


def test_programs(spark):
    run = lambda source: shown(Interpreter(Session(spark)).run(source))
    assert run('"a" "b" 2 INSCRIBE CARD') == [2]
    assert run('"a b c" tokenize "b c d" tokenize intersect popcount') == [2]
    assert run("1 2 SWAP OVER 3 ROT DROP") == [2, 2, 3] or run("1 2 SWAP") == [2, 1]
    assert run("1 2 3 ROT") == [2, 3, 1] and run("DROP DUP nothing") == ["nothing"]
    assert run('"a" 1 INSCRIBE DUP JACCARD') == [1] and run('"a b" TOKENIZE "b" TOKENIZE BSS') == [1]
    assert run(': TWO "a b" TOKENIZE CARD ; TWO') == [2, "TWO"]
    key = run('"a" 1 INSCRIBE KEY')[0]
    assert run('"a" 1 INSCRIBE STORE LOAD KEY') == [key] and run('"a" 1 INSCRIBE STORE DROP "h:" LIST') == [[key]]
    assert run('"a" 1 INSCRIBE STORE PIN GC') == [[]] and run('"a" 1 INSCRIBE STORE DUP PIN UNPIN GC') == [[key]]


def test_files(spark, tmp_path):
    from bitloom.sources import files

    (tmp_path / "a" / "target").mkdir(parents=True)
    for name, text in (("a/x.md", "hello big world"), ("a/y.bin", "no"), ("a/target/z.md", "no"), ("a/e.txt", "  ")):
        (tmp_path / name).write_text(text)
    found = files.read_files(spark, str(tmp_path / "a"), exclude=("target",))
    assert sorted(r.path.rpartition("/")[2] for r in found.collect()) == ["e.txt", "x.md"]
    row = files.records(found).collect()
    assert [(r.popcount, r.token_count, r.card) for r in row] == [(3, 3, 3.0)] and row[0].sketch_key.startswith("h:")
    assert files.not_indexed(found, files.records(found)).count() == 1
    old, new = (spark.createDataFrame(r, "path string, content string") for r in ([("a", "1"), ("b", "1"), ("c", "1")], [("a", "1"), ("b", "2"), ("d", "1")]))
    changed = files.changes(old, new)
    assert {r.path: r.status for r in changed.collect()} == {"b": "M", "c": "D", "d": "A"}
    assert files.divergence(changed).first().asDict() == {"added": 1, "deleted": 1, "difference": 0, "diverges": False}
    files.write_metadata(str(tmp_path / "m.json"), {"b": 1})
    assert (tmp_path / "m.json").read_text().startswith("{")


def test_queries_equal_their_sql(spark, sf):
    """All queries of the engine against DuckDB, at the smallest scale."""
    import os

    import duckdb

    from bitloom.plans import queries_calls, queries_more, queries_time  # noqa: F401
    from bitloom.plans.queries import QUERIES, SQL

    db = duckdb.connect()
    for f in os.listdir(sf):
        db.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")

    def rows(values):
        plain = lambda v: round(v, 9) if isinstance(v, float) else v if v is None or isinstance(v, (int, bool)) else str(v)
        return sorted((tuple(map(plain, r)) for r in values), key=repr)

    assert set(SQL) <= set(QUERIES) and len(QUERIES) >= 100
    for name, sql in SQL.items():
        df, other = QUERIES[name](spark, sf), db.sql(sql)
        cols = sorted(df.columns)
        assert cols == sorted(other.columns), name
        at = [other.columns.index(c) for c in cols]
        assert rows(tuple(r) for r in df.select(*cols).collect()) == rows(tuple(r[i] for i in at) for r in other.fetchall()), name


def test_equal_sketches_are_grouped_by_digests(spark, tmp_path):
    """Texts of the same words in any order and number; those without words, of which there may be several, are left out."""
    from bitloom.plans import queries_more  # noqa: F401
    from bitloom.plans.queries import QUERIES

    rows = [(1, "a b"), (2, "B, a a"), (3, "a"), (4, None), (5, None), (6, "..."), (7, ""), (8, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["equal_sketches"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [(1, 2), (3, 2)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.rindex("Initial Plan") :] if "Initial Plan" in plan else plan
    assert plan.count("ArrowEvalPython") == 1 and "bm" not in plan[: plan.rindex("Exchange")]
