"""Vector codes, main text of pages and aligned tokenizers against plain reference computations."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from compare import compare, connect
from streetflow.llm import cross_tokens, main_text, queries, ring, slice_codes

SF = "/root/testdata/sf0.001"


# vector codes ------------------------------------------------------------------------------------------------


def plain_codes(rows, entries=256, rounds=4, parts=4):
    """The contract with Python's whole numbers and loops over all entries."""
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dim = Counter(len(v) for _, _, v in kept).most_common(1)[0][0]
    kept = [r for r in kept if len(r[2]) == dim]
    cut = [dim * p // parts for p in range(parts + 1)]
    books = [[v[a:b] for _, _, v in kept[:entries]] for a, b in zip(cut, cut[1:])]

    def nearest(x, book):
        return min((sum((s - t) ** 2 for s, t in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(zip(cut, cut[1:])):
            taken = {}
            for _, _, v in kept:
                taken.setdefault(nearest(v[a:b], books[p])[1], []).append(v[a:b])
            books[p] = [[sum(c) // len(taken[k]) for c in zip(*taken[k])] if k in taken else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, per_label = [], Counter()
    for i, label, v in kept:
        found = [nearest(v[a:b], books[p]) for p, (a, b) in enumerate(zip(cut, cut[1:]))]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        per_label[label] += out[-1][2]
    return Counter((i, c, e, per_label[label], digest) for i, c, e, label in out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as code", "1 as group_key", "2 as error")


def test_bit_slices_find_the_nearest_entry():
    r = np.random.RandomState(0)
    for d, k, width in ((16, 256, 200), (1, 256, 4), (5, 65, 30), (16, 256, 2), (2, 1, 9)):
        e, p = r.normal(0, width, (k, d)).astype(int), r.normal(0, width, (700, d)).astype(int)
        p[0] = 1 << 20
        entry, distance = slice_codes.BitSlices(e.tolist()).nearest(p)
        all_ = ((p[:, None] - e[None]) ** 2).sum(2)
        assert (all_.min(1) == distance).all() and (all_.argmin(1) == entry).all()


def test_codes_against_plain_loops(spark):
    r = np.random.RandomState(1)
    rows = [(i, r.normal(0, 0.3, 8).round(3).astype(np.float32).tolist(), int(r.randint(3)) if i % 5 else None) for i in range(400)]
    rows += [(7, rows[8][1], 1), (7, rows[7][1], 1), (None, rows[3][1], 2), (900, None, 1), (901, [None] + [0.0] * 7, 1),
             (902, [float("nan")] * 8, 1), (903, [float("inf")] + [0.0] * 7, 1), (904, [0.1] * 4, 1), (905, [], 1), (906, [0.0] * 8, None)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    for cut in (rows, rows[:20], rows[3:4]):
        got = Counter(map(tuple, slice_codes.compress(vectors(spark, cut)).collect()))
        assert got == plain_codes(cut)
    assert Counter(map(tuple, slice_codes.compress(vectors(spark, rows), max_broadcast=0).collect())) == plain_codes(rows)
    assert slice_codes.compress(vectors(spark, [])).count() == 0


def test_codes_of_huge_components_are_exact(spark):
    rows = [(i, [float(np.float32(x)) for x in (i * 0.01, -5000.5 * (i % 3), 1e9 * (i == 2), 0.25)], 0) for i in range(40)]
    got = Counter(map(tuple, slice_codes.compress(vectors(spark, rows)).collect()))
    assert got == plain_codes(rows)
    rows += [(i, [float(np.float32(x))] * 4, i) for i, x in ((99, 3e38), (98, -3e38), (97, 1.0))]
    for entries in (2, 256):
        got = Counter(map(tuple, slice_codes.compress(vectors(spark, rows), entries=entries).collect()))
        limited = [(i, c, e if e < 2**63 else None, s if s < 2**63 else None, d) for i, c, e, s, d in plain_codes(rows, entries)]
        assert got == Counter(limited)


def test_codes_match_sql(spark):
    assert compare(queries.op11_slice_codes(spark, SF), connect(SF), queries.ORACLES["op11_slice_codes"]) == []


# main text ---------------------------------------------------------------------------------------------------

LINE = "The quick brown fox jumps over the lazy dog and runs away from everything. "
PAGES = {
    "semantic": (f"<!doctype html><html><head><title>no</title></head><body class='single'><div id=page><header id=masthead><h1>Site</h1><nav>x</nav></header>"
                 f"<div class='content-sidebar-wrap'><main><article class='post-12 post'><header class=entry-header><h1>Caf&eacute; &amp; more</h1></header>"
                 f"<p>{LINE}<b>bold<br>new</b>\n\n line</p><div class='social-share'><p>share</p></div><form><p>mail</p></form><p>{LINE * 2}</p><footer>by x</footer></article>"
                 f"<section class=related><article class=teaser><p>{LINE}</p></article></section><div id=comments><ol class=comment-list><li class=comment>"
                 f"<article class=comment-body><p>{LINE * 5}</p></article></ol></div></main><aside><p>{LINE}</p></aside></div></div>",
                 f"Café & more\n{LINE}bold new line\n{(LINE * 2).strip()}"),
    "divisions": (f"<body><div class=header>Site <a href=/>home</a></div><div class='c12'><ul><li><a href=1>aa</a><li><a href=2>bb</a><li><a href=3>cc</a></ul></div>"
                  f"<div class='k1'><h2>Title</h2><p>{LINE}<p>{LINE}<button>Go</button><span class=ad>buy</span></div><div class='cookie-notice'><p>{LINE}</p></div>"
                  f"<div class=r9>short side</div><script>var a='<p>no</p>'</script>", f"Title\n{LINE.strip()}\n{LINE.strip()}"),
    "table": (f"<table><tr><td><a href=1>menu one</a><br><a href=2>menu two</a></td><td><p>{LINE}<p>{LINE}</td></tr></table>", f"{LINE.strip()}\n{LINE.strip()}"),
    "plain": ("a &lt; b\n c&nbsp;d", "a < b c d"),
    "cut": ("<p>one</p><p title=it's>two <!-- <p>no", "one\ntwo"),
    "empty": ("", ""), "markup": ("<div><p> </p></div>", ""), "null": (None, ""),
}


@pytest.mark.parametrize("name", list(PAGES))
def test_page_text(name):
    page = main_text.Page(PAGES[name][0] or "")
    assert page.text(page.best()) == PAGES[name][1]


def test_generalised_names():
    assert [main_text.general(x) for x in ("post-123", "css-1a2b3c", "Entry_Content", "a-1-2")] == ["post-#", "css-*", "entry-content", "a-#"]
    assert main_text.marked("main sidebarLeft") and main_text.marked("site-footer") and not main_text.marked("has-sidebar header address")


def test_host_votes_correct_odd_pages(spark):
    """A page whose own best container is another one is read at the path its host agrees on."""
    usual = [(i, f"https://h.org/{i}", f"<body><div class=story><p>{LINE}{i}</p></div><div class=extra><p>x{i}</p></div>", "c", "d") for i in range(5)]
    odd = (9, "http://me@H.ORG:80/9", f"<body><div class=story><p>{LINE}</p></div><div class=extra><p>{LINE[:60]}</p></div>", "c", "d")
    rest = [(20, None, "<p>alone", None, None), (21, "nonsense", None, None, None), (9, odd[1], odd[2], "c", "d")]
    df = spark.createDataFrame([*usual, odd, *rest], "page_id long, url string, html string, host string, text string")
    for limit in (None, 0):
        got = Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in main_text.extract(df, limit).collect())
        want = [(i, u, f"{LINE}{i}", len(f"{LINE}{i}")) for i, u, *_ in usual] + [(9, odd[1], LINE.strip(), len(LINE) - 1)] * 2
        assert got == Counter([*want, (20, None, "alone", 5), (21, "nonsense", "", 0)])
    assert main_text.extract(df.where("false")).count() == 0


def test_whole_table_of_pages_against_its_layout(spark):
    """Every page of the table keeps its text in the one article; markup is cut out by plain patterns here."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in queries.op12_main_text(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer|$)", r["html"] or "", re.S)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inner[1])] if inner else []
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


# aligned tokenizers ------------------------------------------------------------------------------------------


def plain_alignment(texts):
    """The contract by the libraries and sets of ends, over (doc_id, text) rows."""
    import os

    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    a_model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letter = cross_tokens.byte_of_letter()

    def piece(i):
        return bytes([int(b_model.id_to_piece(i)[3:-1], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()

    rows, count = [], Counter()
    for d, t in texts:
        a = a_model.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_model.encode(t) if t else []
        a_raw, b_raw = [bytes(letter[c] for c in a_model.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not t or b"".join(a_raw) != (" " + t).encode() or b"".join(b_raw) != (" " + t).encode():
            rows.append((d, 0, 0, [], ""))
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_raw]).tolist(), np.cumsum([len(x) for x in b_raw]).tolist()
        a_at, b_at = ({e: k + 1 for k, e in enumerate(x)} for x in (a_end, b_end))
        i, j, groups, linked = 0, 0, [], []
        for e in sorted(a_at.keys() & b_at.keys()):
            p, q = a_at[e], b_at[e]
            groups.append(f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))}")
            linked.append((a[p - 1], b[q - 1]))
            i, j = p, q
        count.update(linked)
        rows.append((d, len(a), len(b), linked, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, y), c in count.items():
        most[y] = max(most[y], c)
    return Counter((d, n, m, len(li), len(li), sum(count[x] == most[x[1]] for x in li), sum(count[x] for x in li), g) for d, n, m, li, g in rows)


def paths():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN


def test_alignment_against_sets_of_ends(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = ["", None, "<|endoftext|> <s>x</s> <unk>", "a▁b", "  lead", "trail  ", "\n\n\tx\r\n", "é漢字\U0001F600‍", "x" * 5000, " " * 700, "ok", "ok", "\x00\x1f\x7f",
           "word, 12 " * 30_000]
    extra = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(odd)] + [(None, "null id"), (0, "twice")], "doc_id long, text string")
    df = docs.unionByName(extra).selectExpr("*", "1 as pairs", "2 as n_a", "3 as _row")
    texts = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want = plain_alignment(texts)
    for looked_up in (cross_tokens.LOOKED_UP, 0):
        assert Counter(map(tuple, cross_tokens.alignment(df, *paths(), looked_up=looked_up).collect())) == want
    assert cross_tokens.alignment(df.where("false"), *paths()).count() == 0


def test_diagonal_runs():
    r = np.random.RandomState(3)
    for share in (0.1, 0.5, 0.95):
        ends = np.arange(1, 400)
        a, b = (sorted({*ends[r.rand(len(ends)) < share].tolist(), 400}) for _ in range(2))
        found = []
        for i, j, run, p, q in cross_tokens.align(np.array(a), np.array(b)):
            found += [(i + k + 1, j + k + 1) for k in range(run)] + ([(p, q)] if p > i + run else [])
        assert found == [(a.index(e) + 1, b.index(e) + 1) for e in sorted(set(a) & set(b))]
    assert cross_tokens.align(np.array([5]), np.array([5])) == [(0, 0, 1, 1, 1)] and len(cross_tokens.align(*[np.arange(1, 1000)] * 2)) == 1


def test_bytes_stand_for_letters():
    letter = cross_tokens.byte_of_letter()
    assert sorted(letter.values()) == list(range(256)) and letter["Ġ"] == 32 and letter["Ċ"] == 10 and letter["a"] == 97


# the ring of op10 --------------------------------------------------------------------------------------------


def walked(ids, n_shards=8, virtual=64, slack=0.0):
    """doc_id to (shard, slot) by walking the ring row by row: first everyone's own shard, then clockwise to the next with room."""
    from bisect import bisect_left

    def position(text):
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)

    ring_ = sorted((position(f"node/{s}/{v}"), s) for s in range(n_shards) for v in range(virtual))
    places, owners = [p for p, _ in ring_], [s for _, s in ring_] + [ring_[0][1]]
    total, used, out, late = len(ids), [0] * n_shards, {}, []
    most = [max(total // n_shards + (s < total % n_shards), int((1 + slack) * total / n_shards)) for s in range(n_shards)]

    def put(d, s):
        out[d] = (s, used[s])
        used[s] += 1

    for d in sorted(ids, key=lambda d: (position(str(d)), d)):
        arc = bisect_left(places, position(str(d)))
        if used[owners[arc]] < most[owners[arc]]:
            put(d, owners[arc])
        else:
            late.append((d, arc))
    for d, arc in late:
        step = next(k for k in range(1, len(owners) + 1) if used[owners[(arc + k) % len(owners)]] < most[owners[(arc + k) % len(owners)]])
        put(d, owners[(arc + step) % len(owners)])
    return out


@pytest.mark.parametrize(("n", "shards", "virtual", "slack"), [(3001, 8, 64, 0.0), (500, 3, 2, 0.0), (1000, 9, 64, 0.1), (5, 8, 64, 0.0)])
def test_ring_against_a_walk(spark, n, shards, virtual, slack):
    df = spark.range(n).selectExpr("id * 7 - 20 as doc_id", "concat('t', id) as text", "1 as shard", "2 as slot")
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in ring.shard_rows(df, shards, virtual, slack).collect()}
    assert got == walked([i * 7 - 20 for i in range(n)], shards, virtual, slack)
