"""Operators on texts: brute-force counterparts, round trips, held-out accuracy and edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetflow.llm import bpe, buckets, chat, chosen_path, language, pu, queries, ring, rules

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, kept boolean"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, empty and long texts, copies, repeated rows and columns of clashing names."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeghimnorst") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    base = [rng.choice(vocabulary) for _ in range(200)]
    near = base.copy()
    near[100] = "changed"
    rows = [
        (1, " ".join(base), "en", "a"), (2, " ".join(base), "en", "a"), (3, " ".join(near), "de", "a"), (4, None, None, None),
        (5, "", "en", "b"), (6, " \t\n", "", ""), (7, "one two three", "fr", "b"), (8, "One TWO three", "fr", None),
        (9, "x", "en", "b"), (10, " ".join(rng.choice(vocabulary) for _ in range(60_000)), "en", "a"),
        (None, "a text whose id is null and no more", "en", "a"), (None, None, None, None), (1, " ".join(base), "en", "a"),
        (11, "Straße\n" * 30 + "#*$%&|<>", "de", "b"), (12, "\x00  é\U0001F600 ́x 's'S\r\n\x1c\x85", "xx", "b.c.d")]
    return spark.createDataFrame([(*r, None, 0.5, 7, True) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(edge):
    return edge.where("false")


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute_components(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(docs):
        ids.setdefault(find(i), []).append(doc_id)
    least = {k: min([v for v in vs if v is not None], default=None) for k, vs in ids.items()}
    return Counter((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(docs))


def found_components(df):
    rows = chosen_path.near_duplicates(df).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)


def test_near_duplicates_of_edge_cases(edge, none):
    assert found_components(edge) == brute_components(texts(edge))
    assert chosen_path.near_duplicates(none).count() == 0


def test_near_duplicates_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found_components(docs) == brute_components(texts(docs))


def test_copies_linked_only_through_their_source(spark, monkeypatch):
    """More copies than a small node holds, all within reach of their source but not of each other."""
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 10**9)}" for _ in range(150)]
    rows = [(1000, " ".join(base))]
    for k in range(90):
        copy = base.copy()
        for at in rng.sample(range(0, 150, 8), 4):
            copy[at] = f"c{k}"
        rows.append((k, " ".join(copy)))
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(2000 + k, passage + " " + " ".join(f"u{rng.randint(0, 10**9)}" for _ in range(60))) for k in range(90)]
    assert found_components(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)
    monkeypatch.setattr(chosen_path, "SMALL", 4)
    assert found_components(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)


def test_copies_just_below_the_threshold_are_not_compared_in_pairs(spark, monkeypatch):
    """Each copy has changed five of the same six places, few to the same word: none is linked with the source."""
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 10**9)}" for _ in range(150)]
    rows = [(1000, " ".join(base))]
    for k in range(400):
        copy = base.copy()
        for at in rng.sample(range(10, 130, 20), 5):
            copy[at] = f"c{rng.randrange(200)}x"
        rows.append((k, " ".join(copy)))
    confirmed, confirm = [], chosen_path.Join.confirm

    def counted(self, pairs):
        confirmed.append(pairs.select(F.least("a", "b"), F.greatest("a", "b")).distinct().count())
        confirm(self, pairs)

    monkeypatch.setattr(chosen_path.Join, "confirm", counted)
    found = found_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == brute_components(rows)
    assert sum(confirmed) < 25 * len(rows), confirmed


def test_links_of_sets_whose_halves_coincide(spark):
    """30 of the 90 shingles in common have equal upper halves: the first filter must not throw the pair out."""
    both = [(7 << 32) + i for i in range(30)] + [(100 + i) << 32 for i in range(60)]
    sets = [(c, both + [(1000 * (c + 1) + i) << 32 for i in range(10)]) for c in (0, 1)]
    run = chosen_path.Join(spark.createDataFrame([], "doc_id long, text string"))
    run.sets = spark.createDataFrame(
        [(c, s, [h >> 32 for h in s], len(s) - len({h >> 32 for h in s})) for c, s in sets],
        "cls long, shingles array<long>, half array<int>, lost int")
    run.confirm(spark.createDataFrame([(0, 1)], "a long, b long"))
    assert [tuple(r) for x in run.links for r in x.collect()] == [(0, 1)]


def test_components_of_a_chain(spark):
    from streetflow.llm.common import Scratch

    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 60), (60, 55)], "a long, b long")
    found = {r["cls"]: r["comp"] for r in chosen_path.components(Scratch(spark, "t"), links).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 55: 50, 60: 50}


def brute_counts(text):
    words = WORD.findall(text)
    wins = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if wins[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered))


def test_rule_counts(edge, none):
    got = Counter((r["doc_id"], *(r[c] for c in rules.COUNTS)) for r in rules.measured(edge).collect())
    assert got == Counter((d, *brute_counts(t)) for d, t in texts(edge))
    verdicts = rules.filter_by_rules(edge).collect()
    assert len(verdicts) == edge.count() and not any(r["kept"] and r["base_failed"] for r in verdicts)
    assert rules.filter_by_rules(none).count() == 0


def test_thresholds_follow_language_and_source(spark):
    """Two groups of different word length: each keeps its own texts and rejects the other's."""
    short = [(i, " ".join(["ab"] * 3 + [f"w{i}x{k}" for k in range(40)]), "en", "a") for i in range(300)]
    long_ = [(1000 + i, " ".join(f"{'y' * 30}{i}x{k}" for k in range(40)), "de", "b") for i in range(300)]
    strange = [(5000, long_[0][1], "en", "a"), (5001, short[0][1], "de", "b")]
    df = spark.createDataFrame(short + long_ + strange, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in rules.filter_by_rules(df).collect()}
    assert not kept[5000] and not kept[5001] and sum(kept.values()) == 600


def test_limits_follow_the_habits_of_a_group(spark):
    """Symbols, repeated lines and repeated words that are usual in one group are rejected in another."""
    def text(i, symbols, lines, again):
        words = [f"w{i}x{k}" + " <b>" * (k < symbols) for k in range(90)]
        body = " ".join(words) + "".join(f"\nsame {i}" for _ in range(lines))
        return body + "".join(f" a{i} b{i} c{i} d{i} e{i}" for _ in range(again))

    heavy = [(i, text(i, 6 + i % 3, 2, 2), "en", "code") for i in range(200)]
    light = [(1000 + i, text(i, 0, 0, 0), "en", "news") for i in range(200)]
    odd = [(5000, text(1, 6, 0, 0), "en", "news"), (5001, text(2, 0, 2, 0), "en", "news"), (5002, text(3, 0, 0, 2), "en", "news")]
    df = spark.createDataFrame(heavy + light + odd, "doc_id long, text string, lang string, source string")
    rows = {r["doc_id"]: r for r in rules.filter_by_rules(df).collect()}
    assert not any(r["base_failed"] for r in rows.values())
    assert {d for d, r in rows.items() if not r["kept"]} == {5000, 5001, 5002}


def test_limits_move_on_whole_tables(spark):
    """At sf0.1 no limit is one and the same number for all groups."""
    counts = rules.measured(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    limits = rules.thresholds(rules.sketch(counts), 100).collect()
    assert all(len({r[f"high_{m}"] for r in limits}) >= 2 for m, *_ in rules.METRICS)


def test_sketches_merge(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = rules.measured(docs)
    whole = rules.sketch(counts)
    parts = rules.sketch(counts.where("crc32(string(doc_id)) % 2 = 0")).union(rules.sketch(counts.where("crc32(string(doc_id)) % 2 = 1")))
    assert whole.count() < parts.count()  # the parts are still apart
    for keys in (["lang", "source"], ["lang"], []):
        of_whole, of_parts = (Counter(map(tuple, rules.quantiles(x, keys).collect())) for x in (whole, parts))
        assert of_whole == of_parts and len(of_whole) >= len(rules.METRICS)
    value = [0, 1, 31, 32, 33, 63, 64, 65, 1000, 123_456]
    rows = spark.createDataFrame([(v,) for v in value], "v long").select("v", rules.bucket_value(rules.bucket(F.col("v"))).alias("w")).collect()
    assert all(r["w"] <= r["v"] <= r["w"] * (1 + 1 / 32) + 1e-9 for r in rows)


def test_bpe_matches_the_library(edge, none):
    import public_tokenizers
    import tiktoken

    path = queries.rank_file()
    merges = bpe.Merges(bpe.load_ranks(path))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges.ids, special_tokens={})
    rng = random.Random(1)
    letters = list("abcdstrevml'' '  \n\n\t\r 123½٣ⅷ中éÀßñ!?#-_ ​　\x1c\x85\x0b") + ["'s", " the", "ing", "'re", "\U0001F600"]
    samples = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [t for _, t in texts(edge)]
    for text, ids in zip(samples, merges.encode(samples)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert merges.decode(ids) == text.encode()
    got = Counter(map(tuple, bpe.digest(edge, path).collect()))
    want = Counter()
    for d, t in texts(edge):
        ids = np.array(library.encode_ordinary(t), "<u4")
        want[(d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert got == want
    decoded = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.detokenize(bpe.tokenize(edge, path), path).collect()}
    assert all(decoded[d] == t.encode() for d, t in texts(edge) if d is not None)
    assert bpe.digest(none, path).count() == 0


def test_quality_on_held_out_labels(spark, edge, none):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op7_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    scores = pu.score_quality(edge, labels)
    assert scores.count() == edge.count() and scores.where("score is null or score not between 0 and 1").count() == 0
    assert pu.score_quality(none, labels).count() == 0
    assert {r["score"] for r in pu.score_quality(edge, labels.where("false")).collect()} == {0.5}


def test_class_prior_and_non_negative_risk():
    rng = np.random.RandomState(0)
    n = pu.N_FEATURES
    good, bad = rng.normal(0.7, 0.5, (6000, n)), rng.normal(0.0, 0.5, (2000, n))
    mixed = np.vstack([good[3000:], bad])
    model = pu.fit(good[:3000], mixed)
    assert abs(model["prior"] - 0.6) < 0.12
    assert (pu.predict(model, good) > 0.5).mean() > 0.97 and (pu.predict(model, bad) < 0.5).mean() > 0.9


def test_language_edge_cases(spark, edge, none):
    def run(df):
        return language.identify(language.with_evidence(df, "doc_id", F.col("text"), F.col("lang"), F.col("source")))

    rows = run(edge).collect()
    assert len(rows) == edge.count() and all(r["language"] in (*language.LANGUAGES, "und") for r in rows)
    assert {r["language"] for r in rows if r["id"] in (4, 5, 6)} == {"und"} and not any(r["kept"] for r in rows if r["id"] in (4, 5, 6))
    assert run(none).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = run(docs).join(docs, F.col("id") == F.col("doc_id"))
    assert got.where("language = lang and kept").count() > 0.98 * got.count()


def test_language_host_prior_decides_open_cases(spark):
    """A text without a hint takes its host's language; a host without texts leans on its domain."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang in ('de', 'en')").select(
        F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("none"), "lang",
        F.when(F.col("lang") == "de", "www.a.de").otherwise("www.b.com").alias("host"))
    odd = spark.createDataFrame([(-1, "zq", None, None, "www.a.de"), (-2, "zq", None, None, "www.b.com")], docs.schema)
    df = docs.unionByName(odd)
    got = {r["id"]: r["language"] for r in language.identify(
        language.with_evidence(df, "id", F.col("text"), F.col("lang"), F.col("host"))).where("id < 0").collect()}
    assert got == {-1: "de", -2: "en"}


def plain_identify(rows, languages=language.LANGUAGES):
    """Posteriors by loops over (id, text, declared, host): the trigrams' hash is the only thing taken over."""
    def cells(text):
        raw = [32 if chr(b) in " \t\n\v\f\r0123456789" else b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()]
        padded, out = [32, *raw, 32], []
        for x, y, z in zip(padded, padded[1:], padded[2:]):
            if any(97 <= c <= 122 or c >= 128 for c in (x, y, z)):
                h = (x * 0x9E3779B1 ^ y * 0x85EBCA77 ^ z * 0xC2B2AE3D) & 0xFFFFFFFF
                out.append(((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 18)
        return out

    k = len(languages)
    model = np.zeros((k, language.CELLS))
    for _, text, declared, _ in rows:
        if declared in languages:
            for c in cells(text):
                model[languages.index(declared), c] += 1
    pooled = (model.sum(0) + 0.5) / (model.sum() + 0.5 * language.CELLS)
    model = np.log(0.95 * model / np.maximum(model.sum(1, keepdims=True), 1) + 0.05 * pooled)
    likes, seen = {}, []
    for i, text, declared, host in rows:
        found = cells(text)
        mean = model[:, found].sum(1) / max(len(found), 1)
        likes[i] = (mean - mean.max()) * len(found) / (1 + len(found) / language.INDEPENDENT)
        host = host.strip().lower() or None if host else None
        labels = host.split(".") if host and "." in host and not set(host) <= set("0123456789.") else []
        seen.append((i, int(np.argmax(likes[i])), declared, host, ".".join(labels[-2:]) or None, labels[-1] if labels else None, len(found)))
    votes = {c: {} for c in (2, 3, 4, 5)}
    overall = np.ones(k)
    for row in seen:
        if row[6]:
            overall[row[1]] += 1
            for c in votes:
                votes[c].setdefault(row[c], np.zeros(k))[row[1]] += 1
    total = overall.sum() - k
    overall /= overall.sum()
    out = {}
    for i, best, declared, host, domain, suffix, n in seen:
        prior = overall
        if domain in votes[4] and domain:
            prior = (votes[4][domain] + overall * language.DOMAIN_WEIGHT) / (votes[4][domain].sum() + language.DOMAIN_WEIGHT)
        if host in votes[3] and host:
            prior = (votes[3][host] + prior * language.HOST_WEIGHT) / (votes[3][host].sum() + language.HOST_WEIGHT)
        else:
            prior = overall
        logs = likes[i] + np.log(prior)
        for c, value in ((2, declared), (5, suffix)):
            if value and value in votes[c]:
                logs = logs + np.log((votes[c][value] + 1) / (overall * total + k))
        top = int(np.argmax(logs))
        out[i] = (languages[top], 1 / np.exp(logs - logs[top]).sum()) if n else ("und", 0.0)
    return out


def test_language_posteriors_by_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()
    hosts = ["www.a.de", "b.a.de", "src3", "10.0.0.1", None, " WWW.C.fr ", "x.com", ""]
    rows = [(i, (r["text"] or "")[:200], r["lang"] if i % 3 else None, hosts[i % 8]) for i, r in enumerate(docs)]
    rows += [(900, "a", "en", "www.a.de"), (901, "ab", None, "src3"), (902, "", "fr", "x.com"), (903, None, None, None), (904, "123 ...", "de", "x.com"),
             (905, "\u00e9", "xx", "new.host.org")]
    df = spark.createDataFrame(rows, "key long, text string, lang string, host string")
    want = plain_identify(rows)
    for limit in (None, 0):
        got = language.identify(language.with_evidence(df, "key", F.col("text"), F.col("lang"), F.col("host")), max_broadcast=limit).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["language"] == want[r["id"]][0] and abs(r["confidence"] - want[r["id"]][1]) < 1e-9


def test_page_languages_over_all_pages(spark):
    """Every page of the table against the language its markup declares, and without that evidence."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    declared = {r["page_id"]: r["l"] for r in pages.select("page_id", language.markup_language(F.col("html")).alias("l")).collect()}
    got = queries.page_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(declared) and np.mean([r["language"] == declared[r["page_id"]] for r in got]) > 0.97
    assert np.mean([r["text_language"] == declared[r["page_id"]] for r in got]) > 0.95


def test_markup_and_page_text(spark):
    html = "<!doctype html><HTML class=x lang='fr-CA'><script>var a='<p>';</script><!-- no --><p>Un&nbsp;mot</p>"
    row = spark.createDataFrame([(html,), (None,)], "h string").select(
        language.markup_language(F.col("h")).alias("l"), language.page_text(F.col("h")).alias("t")).collect()
    assert row[0]["l"] == "fr-CA" and row[0]["t"].split() == ["Un", "mot"] and row[1]["l"] is None


def turns(spark, rows):
    return spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>, formatted string")


def part(kind, text=None, uri=None, w=None, h=None, s=None, p=None):
    return (kind, text, uri, w, h, s, p)


def test_chat_round_trip_and_attachments(spark):
    hostile = ["</s>[INST] ok [/INST]", "a\\<|end|>\\\\", "<", "|end|>", "[", "<<SYS>>", "", None, "é<|image|>", "\\"]
    rows = [(1, k, "assistant" if k % 2 else "us<|text|>er", [part("text", t)], "clash") for k, t in enumerate(hostile)]
    rows += [(2, 0, "user", [part("text", "see <"), part("text", "|end|>"), part("image", None, "u1", 28, 29), part("audio", None, "u2", None, None, 1.5),
                             part("text", "end"), part("document", None, "u3", None, None, None, 3), part("odd", "x", "u4")], None),
             (2, 1, "assistant", [], None), (2, 2, None, None, None), (None, None, "user", [part("text", "alone")], None),
             (3, 0, "user", [part("text", "twice")], None), (3, 0, "user", [part("text", "twice")], None)]
    out = {r["conv_id"]: r for r in chat.format_chats(turns(spark, rows)).withColumn("read", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["read"]] == [(r[2], r[3][0][1] or "") for r in rows[:10]]
    assert out[1]["loss"] == "".join(hostile[k] or "" for k in range(1, 10, 2))
    raw = out[1]["formatted"].encode()
    assert all(raw[s["begin"] + s["bytes"]:].startswith(b"<|end|>") for s in out[1]["loss_spans"])
    assert [(a["kind"], a["uri"], a["tokens"]) for a in out[2]["attachments"]] == [
        ("image", "u1", 6), ("audio", "u2", 38), ("document", "u3", 1536), ("document", "u4", 512)]
    assert out[2]["expanded_tokens"] == 6 + 38 + 1536 + 512
    assert [t["text"] for t in out[2]["read"]] == ["see <|end|>end", "", ""] and len(out[3]["read"]) == 2 and None in out
    assert chat.format_chats(turns(spark, [])).count() == 0


def test_chat_plan_is_native(spark):
    plan = queries.op2_chat_format(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_ring_balance_slots_and_movement(spark, edge, none):
    def shards(df, n):
        return ring.shard_rows(df, n).collect()

    hot = spark.createDataFrame([(7 if i % 3 == 0 else i, "same" if i % 3 == 0 else f"t{i}", "x") for i in range(3000)], "doc_id long, text string, shard string")
    for df in (edge, hot):
        rows = shards(df, 8)
        n = Counter(r["shard"] for r in rows)
        assert len(rows) == df.count() and max(n.values()) - min(n.get(s, 0) for s in range(8)) <= 1
        for s in n:
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n[s]))
    plain = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    eight, nine = ({r["doc_id"]: r["shard"] for r in ring.shard_rows(plain, n, slack=0.1).collect()} for n in (8, 9))
    assert max(Counter(eight.values()).values()) <= 1.1 * 4000 / 8
    assert sum(eight[k] != nine[k] for k in eight) < 0.3 * len(eight)  # a ninth has to move
    assert ring.shard_rows(none).count() == 0


def test_best_bounds_against_all_choices():
    from itertools import combinations

    rng = np.random.RandomState(2)
    for _ in range(20):
        n, k = rng.randint(1, 9), rng.randint(1, 5)
        rows, longest = rng.randint(1, 30, n), np.sort(rng.choice(100, n, replace=False)) + 1

        def cost(bounds):
            return sum(r * min(b for b in bounds if b >= x) for r, x in zip(rows, longest))

        best = min(cost((*c, longest[-1])) for size in range(min(k, n)) for c in combinations(longest[:-1].tolist(), size))
        got = buckets.best_bounds(rows.astype(float), longest, k)
        assert len(got) <= k and cost(got) == best
    assert buckets.best_bounds(np.zeros(0), np.zeros(0, int), 4) == []


def test_packing(spark, edge, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (docs, edge):
        rows = buckets.pack(df, buckets.n_tokens(F.col("text")), 6, 4096).collect()
        assert len(rows) == df.count()
        by_batch = {}
        for r in rows:
            by_batch.setdefault(r["batch"], []).append(r)
        assert sorted(by_batch) == list(range(len(by_batch)))
        for batch in by_batch.values():
            assert len({r["bucket"] for r in batch}) == 1 and sorted(r["slot"] for r in batch) == list(range(len(batch)))
            assert all(r["padding"] >= 0 and r["n_tokens"] + r["padding"] == r["padded_to"] for r in batch)
            assert len(batch) == 1 or len(batch) * batch[0]["padded_to"] <= 4096
    assert buckets.pack(none, buckets.n_tokens(F.col("text"))).count() == 0


def test_packing_counts_real_tokens(spark, edge, none):
    import corpus_pipeline

    path = queries.rank_file()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (docs, edge):
        want = Counter((r["doc_id"], max(1, r["n_tokens"])) for r in bpe.digest(df, path).collect())
        assert Counter((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.packing(spark, df, SF).collect()) == want
    assert queries.count_tokens(none).count() == 0
    rows = queries.op4_length_buckets(spark, SF).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == Counter(
        (r["doc_id"], max(1, r["n_tokens"])) for r in bpe.digest(docs, path).collect())
    batches = Counter()
    for r in rows:
        assert r["n_tokens"] <= r["padded_to"]
        batches[r["batch"]] += r["padded_to"]
    alone = {b for b, n in Counter(r["batch"] for r in rows).items() if n == 1}
    assert all(n <= 65_536 or b in alone for b, n in batches.items())
