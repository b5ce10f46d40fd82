"""Merkle manifest and line dedup against brute force, and against DuckDB on the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from strataspark.llm import line_dedup, merkle
from strataspark.llm.base import Store
from strataspark.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, grp int, t1 long, h1 string, places long, steps int"


def make_docs():
    rng = random.Random(7)
    line = lambda k: f"Line {k} of the passage that several documents hold é{k}"
    rows = []
    for i in range(60):
        parts = [line(rng.randrange(40)) for _ in range(rng.randrange(0, 9))] + ["short line"] * (i % 3)
        parts = [rng.choice(["", " ", "\t\r", "\x0b"]) + (p.upper() if rng.random() < 0.3 else p) + rng.choice(["", " \x0c", "\xa0"]) for p in parts]
        rng.shuffle(parts)
        rows.append((i, "\n".join(parts), rng.choice(["en", None, ""]), "hot" if i % 2 else f"s{i % 9}"))
    rows += [(None, None, "en", "hot"), (None, line(1), None, None), (None, line(2) + "\n\n" + line(1), None, None), (100, "", "en", None), (101, "\n", None, ""), (102, line(3), "en", "lone")]
    rows += [(103, "\n".join([line(4)] * 3), "en", "copies")] * 6
    rows += [(104, "\n".join(f"{k} a line of a long text of its own, number {k}, as long as it takes" for k in range(3000)) + "\n" + line(5), "en", "long")]
    rows += [(110 + k, f"only documents without an id, and this {'x' * 40}", "en", f"z{k % 2}") for k in range(3)]
    rows += [(None, "a line that only documents without an id hold, five of them", "de", "none")] * 5
    return [(i, t, lang, s, None if i == 5 else len(t or ""), "clash", 1, 2, "clash", 3, 4) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make_docs(), SCHEMA).repartition(5)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(part(v) for v in (r[0], r[3], r[2], r[4], text)))

    def grow(nodes):
        """The last node, and for each leaf its runs: (place, digests)."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[k : k + 3] for k in range(0, len(nodes), 3)]
            for leaf_no, k in enumerate(at):
                paths[leaf_no].append((k % 3, runs[k // 3]))
                at[leaf_no] = k // 3
            nodes = [sha("".join(run)) for run in runs]
        return nodes[0], paths

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[name] = own, *grow([leaf(r, r[1]) for r in own])
    root, above = grow([trees[n][1] for n in names])
    out = []
    for name, upper in zip(names, above, strict=True):
        own, subroot, paths = trees[name]
        for r, path in zip(own, paths, strict=True):
            lost = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            folded = leaf(r, r[1].replace("\n", "") if lost else r[1])
            siblings = ""
            for k, run in path + upper:
                siblings += "".join(run[:k] + run[k + 1 :])
                folded = sha("".join([*run[:k], folded, *run[k + 1 :]]))
            out.append((r[0], leaf(r, r[1]), subroot, root, sha(siblings), folded, folded == root))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_manifest(spark, docs, parts):
    want = ordered(brute_manifest(make_docs()))
    store = Store(spark, "merkle-test")
    kept = merkle.manifest(docs, store, {"changed": merkle.tampered(docs)}, parts=parts)
    folded = merkle.fold(F.coalesce("changed", "leaf"), F.col("steps"))
    digests = [F.lower(F.hex(F.col(c))) for c in ("leaf", "subroot", "root")]
    got = kept.select("doc_id", *digests, merkle.proof_digest(F.col("steps")), F.lower(F.hex(folded)), folded == F.col("root")).collect()
    assert ordered(got) == want
    assert {r.source for r in kept.select("source").distinct().collect()} == {r[3] for r in make_docs()}
    store.clear()


def test_manifest_report_of_few_rows(spark, docs):
    store = Store(spark, "merkle-test")
    assert merkle.report(docs.limit(0), store).collect() == []
    for rows in (make_docs()[:1], make_docs()[:2], make_docs()[60:61], make_docs()[66:72]):
        got = merkle.report(spark.createDataFrame(rows, SCHEMA), store).collect()
        assert ordered(got) == ordered(brute_manifest(rows))
    store.clear()


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({k: k + 32 for k in range(65, 91)})


def brute_lines(rows, least=40, min_docs=5):
    """(doc_id, lines, kept text) of each row."""
    holders = defaultdict(list)
    for r in rows:
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            holders[k].append(r[0])
    last = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(k) >= least and len(ids) >= min_docs}
    gone = lambda r, x: key(x) in last and last[key(x)] != r[0]
    return [(r[0], (r[1] or "").split("\n"), [x for x in (r[1] or "").split("\n") if not gone(r, x)]) for r in rows]


@pytest.mark.parametrize("batches,least,min_docs", [(1, 40, 5), (4, 40, 5), (7, 5, 2), (3, 0, 1)])
def test_lines(spark, docs, batches, least, min_docs):
    want = [(i, len(all_), len(all_) - len(kept), sha("\n".join(kept))) for i, all_, kept in brute_lines(make_docs(), least, min_docs)]
    store = Store(spark, "lines-test")
    got = line_dedup.report(docs, store, batches=batches, least_chars=least, min_docs=min_docs).collect()
    store.clear()
    assert ordered(got) == ordered(want)
    assert least < 40 or sum(r[2] for r in want) > 10


def test_lines_keep_other_columns(spark, docs):
    store = Store(spark, "lines-test")
    out = line_dedup.dedup(docs, store)
    assert out.columns == docs.columns
    want = [(r[0], None if r[1] is None else "\n".join(kept), *r[2:]) for r, (_, _, kept) in zip(make_docs(), brute_lines(make_docs()), strict=True)]
    assert ordered(out.collect()) == ordered(want)
    assert line_dedup.report(docs.limit(0), Store(spark, "lines-test")).collect() == []
    store.clear()


def test_runs_by_levels(spark, docs):
    """Batches in any order, merged by any fanout, count as one table does; the index goes on with later batches."""
    keys = line_dedup.line_keys(docs)
    want = ordered(line_dedup.counted(keys).where("n >= 5").select("h1", "h2", "last").collect())
    for fanout, order in ((2, range(5)), (3, (4, 0, 3, 1, 2))):
        index = line_dedup.Runs(spark, fanout=fanout, buckets=3)
        for k in order:
            index.add(keys.where(F.pmod(F.coalesce("doc_id", F.lit(-1)), F.lit(5)) == k))
        if fanout == 2:
            assert {k: len(v) for k, v in index.levels.items() if v} == {0: 1, 2: 1}
        assert ordered(index.compact().where("n >= 5").select("h1", "h2", "last").collect()) == want
        index.drop()


def test_settled_lines_stay_out_of_new_runs(spark):
    rows = [(i, "a line that all documents of both batches hold, more than enough of them") for i in range(20)]
    keys = line_dedup.line_keys(spark.createDataFrame(rows, "doc_id long, text string"))
    index = line_dedup.Runs(spark, fanout=9, buckets=2)
    index.add(keys.where("doc_id >= 10"))
    index.add(keys.where("doc_id < 10"))
    first, second = (spark.table(n) for n in index.names())
    assert [r.n for r in first.collect()] == [10] and second.count() == 0
    plan = first.join(second, ["h1", "h2"], "full")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hash", plan)
    index.drop()


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_line_dedup"])
def test_queries_against_duckdb(spark, name):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(columns)
    assert ordered(got.select(*columns).collect()) == ordered(want.fetchall())
