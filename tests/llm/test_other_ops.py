"""Chat formatting, bit-sliced search, the queries' SQL and the pipeline."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sightline.llm import bitsliced, chat, linededup, mixing, packing, quality, queries, simhash
from sightline.llm.session import docs_of

DATA = "/root/testdata/sf0.001"


def test_escape_is_reversible(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\/s>", "<|end|>", "[\\\\INST]", "<<SYS>><</SYS>>", "plain\\", "<", "<|end|", "<<|end|>", "a[", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in ("</s>", "<s>", "[INST]", "[/INST]", "<|end|>", "<<SYS>>"))


def test_reply_trees(spark):
    rows = [
        (1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "<|end|>a</s>", 2.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 2, "user", None, 9.0), (1, 5, 4, None, "z", None),
        (2, 1, 2, "user", "loop", 0.0), (2, 2, 1, "user", "loop", 0.0), (2, 3, 2, "user", "below", 0.0),
        (None, 1, 7, "user", "dangling", 0.0), (3, 1, None, "user", "tie", 0.0), (3, 2, 1, "assistant", "x", 1.0), (3, 3, 1, "assistant", "y", 1.0), (3, 3, 1, "assistant", "y", 1.0),
    ]
    tree = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = {(r.tree, r["rank"]): ([tuple(t) for t in r.turns], r.learnt) for r in chat.read_back(chat.format_paths(tree, 2)).collect()}
    assert got == {
        (1, 1): ([("user", "q"), ("assistant", "<|end|>a</s>"), ("user", ""), ("", "z")], ["<|end|>a</s>"]),
        (1, 2): ([("user", "q"), ("assistant", "b")], ["b"]),
        (None, 1): ([("user", "dangling")], []),
        (3, 1): ([("user", "tie"), ("assistant", "x")], ["x"]),
        (3, 2): ([("user", "tie"), ("assistant", "y")], ["y"]),
    }


def test_long_and_odd_conversations(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} <|end|>") for k in range(70)] + [(2, None, None, None), (2, 0, "user", "a"), (2, 0, "user", "a"), (None, 0, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.tree: [tuple(t) for t in r.turns] for r in chat.read_back(chat.format_paths(chat.linear(table))).collect()}
    assert got[1] == [(r[2], r[3]) for r in rows[:70]] and got[2] == [("", ""), ("user", "a"), ("user", "a")] and got[None] == [("user", "x")]
    assert chat.format_paths(chat.linear(table.limit(0))).collect() == []


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(queries.ORACLE[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    assert sorted(map(str, df[columns].itertuples(index=False, name=None))) == sorted(map(str, want[columns].itertuples(index=False, name=None)))


def test_native_plans(spark):
    for name in ("op1_chat", "op4_mixing"):
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_bit_slices_against_products():
    draw = np.random.default_rng(2)
    for _ in range(60):
        n, d, high, k = int(draw.integers(1, 200)), int(draw.integers(1, 7)), int(draw.choice([1, 9, 1000, 2**26])), int(draw.integers(1, 12))
        values, ids, query = draw.integers(-high, high + 1, (n, d)), draw.permutation(n), draw.integers(-high, high + 1, d)
        at, scores = bitsliced.BitSliced.of(values).top(query, k, ids, int(ids[0]))
        full = values @ query
        want = sorted(range(1, n), key=lambda i: (-full[i], ids[i]))[:k]
        assert sorted(at.tolist()) == sorted(want) and (full[at] == scores).all()


@pytest.mark.parametrize("pass_queries", [3, 1000])
def test_search_odd_vectors(spark, pass_queries):
    draw = np.random.default_rng(4)
    rows = [(k, [float(x) for x in draw.normal(size=5)], 0) for k in range(60)] + [(k, [1.0, 0.0, 0.0, 0.0, 0.0], 1) for k in range(200, 230)]
    rows += [(300, None, 0), (301, [1.0, None], 0), (302, [float("nan")], 0), (303, [float("inf")], 0), (304, [], 0), (None, [1.0], 0), (305, [2e5, 3.0], 0), (310, [], 0), (311, [-3e8, 1.0], 0), (306, [3.0], 0), (7, rows[7][1], 5), (315, [3e6, -7e6], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = bitsliced.search(table, table.where("vec_id % 5 = 0"), pass_queries=pass_queries, block_rows=16).collect()
    ok = [(i, [math.floor(1024 * x) for x in v] + [0] * (5 - len(v))) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q, x in ok:
        if q % 5 == 0:
            ranked = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in ok if i != q)[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(ranked)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert bitsliced.search(table.limit(0), table.limit(0)).collect() == []


def test_search_beyond_64_bits_fails_loudly(spark):
    table = spark.createDataFrame([(1, [1e300]), (2, [1e300]), (3, [-1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        bitsliced.search(table, table.where("vec_id = 1")).collect()
    # Huge vectors that are no query's best do no harm.
    small = spark.createDataFrame([(1, [1.0]), (3, [-1e300]), *[(k, [float(k)]) for k in range(10, 30)]], "vec_id long, embedding array<double>")
    got = bitsliced.search(small, small.where("vec_id = 1")).collect()
    assert sorted(r.vec_id for r in got) == list(range(20, 30)) and max(r.score for r in got) == 29 << 20


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against what its decision must be on the stage's own input."""
    docs, steps = docs_of(spark, DATA), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        steps.append(docs)
    given = docs_of(spark, DATA)
    assert all(s.columns == given.columns for s in steps[:4]) and steps[4].columns == [c.split()[0] for c in packing.SCHEMA.split(", ")]
    rows = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    start, good, lines, single, mixed = map(rows, [given, *steps[:4]])
    model = quality.train(given, docs_of(spark, DATA, "labels"))
    assert good == {d: t for d, t in start.items() if quality.score(model, quality.grams(t.encode(), model["vocabulary"])) >= quality.REJECT_BELOW}
    report = {r.doc_id: r.kept_sha256 for r in linededup.shared_lines(steps[0]).collect()}
    assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in lines.items()} == report
    groups = {r.doc_id: r.component_id for r in simhash.near_copies(steps[1], words=simhash.NEAR_WORDS, bits=simhash.NEAR_BITS, similar=simhash.SIMILAR).collect()}
    assert set(single) == {d for d, c in groups.items() if d == c} and all(single[d] == lines[d] for d in single)
    taken = {r.doc_id: r.taken for r in mixing.mix(steps[2]).collect()}
    assert {d: len(t.split()) for d, t in mixed.items()} == {d: n for d, n in taken.items() if n}
    pieces = steps[4].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id for r in pieces} == set(mixed) and all(r.n == r.m for r in pieces)
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, steps[4].collect()))
