"""Archives, nearest neighbours, the registered queries and the pipeline."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetflow.llm import queries, vamana, warc
from streetflow.llm.common import Scratch

SF = "/root/testdata/sf0.001"
TRICK = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(3)
    bits = ["a" * 300, "é", "\nWARC/", "WARC/1.1\r\n", TRICK, "\r\n\r\n"]
    rows = [(i, f"http://x/{i}\nWARC/1.0%", "".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) if i % 7 else None) for i in range(80)]
    rows += [(200 + i, None, "z" * 2000 + TRICK) for i in (0, 1, 2, 2)] + [(None, None, "z" * 2000 + TRICK), (None, "u", "q")]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, row string").repartition(3)


@pytest.mark.parametrize("compression,block", [("none", "500b"), ("none", "128m"), ("gzip", "128m")])
def test_archives_round_trip(spark, pages, compression, block):
    path = Scratch(spark, "test").path("archives")
    warc.write_archives(warc.mark_revisits(pages), path, compression)
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = warc.page_records(spark, path).collect()
        whole = [bytes(r["payload"]) for r in warc.read_archives(spark, path).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter(
        (p, len(b), hashlib.sha1(b).hexdigest()) for p, b in rows)
    revisits = [r for r in got if r["record_type"] == "revisit"]
    same = [(p, b) for p, b in rows if len(b) >= 1000]
    assert len(revisits) == len(same) - len({b for _, b in same})
    for r in revisits:
        assert r["refers_to"] == max(p for p, b in same if hashlib.sha1(b).hexdigest() == r["payload_digest"] and p is not None)
    assert set(whole) - {b""} == {b for _, b in rows} - {b""}


def test_archives_when_the_second_scan_is_cut_otherwise(spark, pages):
    """The pieces of split records are found although blocks and tasks have changed since the first scan."""
    path = Scratch(spark, "test").path("archives")
    warc.write_archives(warc.mark_revisits(pages), path)
    want = Counter(bytes(r["payload"]) for r in warc.read_archives(spark, path).collect())
    read = warc.read_archives(spark, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = Counter(bytes(r["payload"]) for r in read.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want and any(b"\nWARC/" in b for b in want)


def test_archive_edges(spark, pages):
    path = Scratch(spark, "test").path("archives")
    warc.write_archives(warc.mark_revisits(pages.where("false")), path)
    assert warc.page_records(spark, path).count() == 0


def test_damaged_archives(spark, tmp_path):
    """A record cut short or of a wrong length is left out with what follows it in its file; other files are not touched."""
    def record(payload, length=None):
        return f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n{payload}\r\n\r\n"

    tricky = "b" * 40 + TRICK + "c" * 40
    files = {
        "whole": record("one") + record(tricky) + record("three"), "no_end": (record("four") + record("five")).rstrip("\r\n"),
        "cut": (record("six") + record("s" * 51))[:-30], "cut_inside": (record("seven") + record(tricky))[:-60],
        "huge": record("eight") + record("nine", 99_999_999_999), "long": record("ten") + record("eleven", 7) + record("twelve"),
        "short": record("thirteen") + record("fourteen", 3) + record("fifteen"), "negative": record("sixteen") + record("x", -5), "empty": ""}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    got = Counter(bytes(r["payload"]).decode() for r in warc.read_archives(spark, str(tmp_path)).collect())
    # the record before one of a wrong length still ends where a header begins; before something that is no header it does not
    assert got == Counter(["one", tricky, "three", "four", "five", "six", "seven", "eight", "ten", "thirteen"])


def test_reachable_rejects_what_no_chain_reaches(spark):
    chain = [("f", 10 * i, 10 * i + 10) for i in range(37)]
    inside = [("f", 15, 20), ("f", 113, 400), ("g", 5, 9)]
    links = spark.createDataFrame(chain + inside + [("h", 0, 8)], "file string, offset long, successor long")
    got = {tuple(r) for r in warc.reachable(Scratch(spark, "test"), links).collect()}
    assert got == {(f, o) for f, o, _ in chain} | {("h", 0)}


def exact(vectors, every=20, k=20):
    good = {(i, tuple(v)) for i, v in vectors if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    out = {}
    for q, a in good:
        if q % every == 0:
            scored = {}
            for i, b in good:
                if i != q and len(a) == len(b):
                    scored[i] = max(scored.get(i, -math.inf), float(np.dot(np.array(a), np.array(b))))
            out[q] = sorted(scored.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def test_neighbours_of_edge_cases(spark):
    rng = np.random.RandomState(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)] + [rows[20], rows[20]]  # copies and repeated rows
    rows += [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [None] + [1.0] * 7), (2080, [math.nan] * 8), (2100, [math.inf] * 8),
             (None, [1.0] * 8), (3000, [1.0, 2.0]), (3001, [2.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "vec_id long, embedding array<float>, label int, score double")
    got = {}
    for r in vamana.search(df, shard_rows=120).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = exact([(i, [None if c is None else float(np.float32(c)) for c in v] if v else v) for i, v in rows])
    assert set(got) == {q for q, near in want.items() if near}
    hit = 0
    for q, near in got.items():
        near.sort()
        assert [n[0] for n in near] == list(range(1, len(near) + 1)) and len(near) == len(want[q])
        assert all((-a[2], a[1]) <= (-b[2], b[1]) for a, b in zip(near, near[1:]))
        hit += len({n[1] for n in near} & {i for i, _ in want[q]})
    assert hit >= 0.97 * sum(map(len, want.values()))
    assert vamana.search(df.where("false")).count() == 0


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found = {}
    for r in vamana.search(table).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = total = 0
    for at in np.flatnonzero(ids % 20 == 0):
        near = [i for i in np.lexsort((ids, -(x @ x[at]))) if i != at][:20]
        hit, total = hit + len(found[ids[at]] & set(ids[near].tolist())), total + 20
    assert hit >= 0.9 * total


def test_pruning_keeps_diverse_edges():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2], [0, 2.1]], np.float32)
    kept = vamana.robust_prune(x, np.array([0]), np.array([[1, 2, 3, 4, -1]]), 4, 1.2)[0]
    assert kept.tolist() == [1, 3, -1, -1]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, name):
    from compare import compare, connect

    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) == []


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scratch, now = Scratch(spark, "test"), docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, scratch.keep(stage(spark, now, SF), name)
        kept = {r["doc_id"] for r in now.select("doc_id").collect()}
        assert kept <= {r["doc_id"] for r in before.select("doc_id").collect()}
        if name != "packing":
            assert now.columns == docs.columns
        if name == "quality":
            bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
            assert len(kept & bad) <= 0.1 * len(bad)
        if name == "near_duplicates":
            from test_text_operators import brute_components, texts

            groups = brute_components(texts(before))
            assert sorted(kept) == sorted({c for d, _, c in groups})
    assert now.count() == len(kept)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect())) == sorted(
        map(tuple, now.select("doc_id", "n_tokens").collect()))


def test_pipeline_stages_on_edge_cases(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "The same text for all of these rows, nothing else to see here.", "en", "a", 5)] * 3 + [
        (None, None, None, None, None), (2, "", "en", "a", 0), (3, "wort " * 500, "de", None, None)]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert out.count() <= df.count()
            if name == "near_duplicates" and df.count():
                assert out.where("doc_id = 1").count() == 1 and out.where("doc_id is null").count() == 1


def test_pipeline_stages_keep_clashing_columns(spark):
    """Tables may have columns named like the stages' own, and very long texts."""
    import corpus_pipeline

    words = "these are the words of a text that is long " * 60_000
    rows = [(1, words, "en", "a", 5, 7, 0.5), (2, words + "end", "en", "a", 5, 8, 0.25), (3, "this is a text of the kind that there is", "en", "a", 5, 9, 0.125)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row int, _score double")
    kept = {r[0]: r for r in rows}
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns and all(tuple(r) == kept[r["doc_id"]] for r in out.collect())
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()} == {1, 3}


def test_pipeline_judges_the_rows_it_removes(spark):
    """Files are dealt to other tasks between the judgement and the removal; the rows removed stay the same."""
    import corpus_pipeline

    base = [[f"w{g}x{k}" for k in range(60)] for g in range(12)]
    bad = [(i, "0 1 2 3", None, None, 5) for i in range(12)]
    good = [(100 + g, "these are the words of a text " + " ".join(base[g]), "en", "a", 5) for g in range(12)]
    rows = [r for two in zip(bad, good) for r in two] + [(200 + r[0], *r[1:]) for r in good]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(9, "doc_id")
    docs = Scratch(spark, "test").keep(docs)
    for stage in (corpus_pipeline.language_id, corpus_pipeline.near_duplicates):
        want = sorted(r["doc_id"] for r in stage(spark, docs, SF).collect())
        assert 0 < len(want) < len(rows)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        try:
            out = stage(spark, docs, SF)
            spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            assert sorted(r["doc_id"] for r in out.collect()) == want
        finally:
            for key in ("maxPartitionBytes", "minPartitionNum", "openCostInBytes"):
                spark.conf.unset(f"spark.sql.files.{key}")
