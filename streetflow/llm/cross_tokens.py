"""Alignment of two tokenizers over the same bytes by diagonal run skipping, and the counts of linked id pairs."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetflow.llm.common import Scratch, text_pieces, with_group

#: Texts are encoded together up to about this many bytes; longer ones in stretches of this many characters.
BLOCK_BYTES, STRETCH = 1_000_000, 100_000
#: First window that is compared at a shift.
WINDOW = 16
#: Distinct pairs that a task counts before it passes them on.
TASK_PAIRS = 400_000
#: Pairs of the corpus that may be looked up in every task (16 bytes each); beyond, they are joined.
LOOKED_UP = 3_000_000
#: A blank between these always parts tokens: both tokenizers put a blank at a token's begin only.
_CUT = re.compile(r"(?<=[A-Za-z0-9.,;:!?]) (?=[A-Za-z0-9])")


def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: a printable byte is its own letter, the others take
    the code points from 256 on in turn."""
    letter, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            letter[chr(b)] = b
        else:
            letter[chr(spare)], spare = b, spare + 1
    return letter


def read_byte_level(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level BPE file, without its special tokens.

    Ids have to follow the order of the merges, so that they serve as ranks.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special, merges = {t["content"] for t in spec["added_tokens"]}, spec["model"]["merges"]
    if (spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]
            or spec["model"]["type"] != "BPE"):
        raise ValueError(f"{path} is no plain byte-level BPE")
    vocabulary, letter = spec["model"]["vocab"], byte_of_letter()
    at = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    if at != sorted(at):
        raise ValueError(f"{path} does not number its tokens in the order of their merges")
    return {bytes(letter[c] for c in t): i for t, i in vocabulary.items() if t not in special}


class Encoders:
    """Both tokenizers and the bytes of their tokens; built once per Python worker from what the driver read."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes):
        import sentencepiece
        import tiktoken

        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.parts_at_blanks = not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # ids as text with what follows them in the groups' digest: A's within a group and at its end, then B's; padded rows
        names = [f"{i}{mark}" for t, last in ((self.a_bytes, "|"), (self.b_bytes, ";")) for mark in (",", last) for i in range(len(t))]
        width = max(map(len, names))
        self.name = np.frombuffer("".join(x.ljust(width) for x in names).encode(), np.uint8).reshape(-1, width)
        self.name_kept = self.name != 32

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a blank and the text, in both; none where either does not give the bytes back."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        if len(text) <= STRETCH or not self.parts_at_blanks:
            stretches = [text]
        else:
            cuts, last = [0], 0
            for m in _CUT.finditer(text):
                if m.start() - last >= STRETCH:
                    last = m.end()
                    cuts.append(last)
            stretches = [text[i:j - 1] for i, j in zip(cuts, [*cuts[1:], len(text) + 1])]
        a, b = [], []
        for s in stretches:
            a += self.a.encode_ordinary(" " + s)
            b += self.b.encode(s)
        raw = (" " + text).encode()
        ids = np.array(a, np.int64), np.array(b, np.int64)
        # A cuts the bytes it is given, so their number tells
        if self.a_size[ids[0]].sum() != len(raw) or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return none, none
        return ids


_ENCODERS: dict[bytes, Encoders] = {}


def encoders_of(files: tuple[bytes, dict[bytes, int], str, bytes]) -> Encoders:
    digest, *rest = files
    if digest not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[digest] = Encoders(*rest)
    return _ENCODERS[digest]


def align(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Stretches (i, j, run, p, q) of two rising arrays of ends that end alike.

    ``run`` one-to-one groups start at a[i], b[j]; then one irregular group takes a up to p and b up to q, or there is
    none, p being i + run. At the current shift j - i, windows of doubling length are compared up to the first
    difference; a group of other than one token a side is walked token by token and sets a new shift.
    """
    out, i, j, n, left, right = [], 0, 0, len(a), a.tolist(), b.tolist()
    while i < n:
        run, width = 0, WINDOW
        while most := min(width, n - i - run, len(b) - j - run):
            same = a[i + run:i + run + most] == b[j + run:j + run + most]
            first = int(same.argmin())
            if not same[first]:
                run += first
                break
            run += most
            width *= 2
        p, q = i + run, j + run
        if p < n:
            x, y = left[p], right[q]
            while x != y:
                if x < y:
                    p += 1
                    x = left[p]
                else:
                    q += 1
                    y = right[q]
            p, q = p + 1, q + 1
        out.append((i, j, run, p, q))
        i, j = p, q
    return out


def _aligned(e: Encoders, text: str) -> tuple[int, int, int, str, np.ndarray]:
    """Number of A tokens, B tokens and groups, the groups' digest and the pair of every link (a << 32 | b)."""
    a, b = e.encode(text)
    if not len(a):
        return 0, 0, 0, "", np.zeros(0, np.int64)
    stretches = align(np.cumsum(e.a_size[a]), np.cumsum(e.b_size[b]))
    # the last tokens of every group: of one-to-one groups each one, of irregular ones that before p and q
    table = np.array(stretches, np.int64)
    odd = table[:, 3] > table[:, 0] + table[:, 2]
    many = table[:, 2] + odd
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    is_odd = np.repeat(odd, many) & (place == np.repeat(table[:, 2], many))
    last_a, last_b = (np.where(is_odd, np.repeat(table[:, k + 3] - 1, many), np.repeat(table[:, k], many) + place) for k in (0, 1))
    # all ids in the order of the groups, A before B within each
    in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    named_a, named_b = a.copy(), b + 2 * len(e.a_size)
    named_a[last_a] += len(e.a_size)
    named_b[last_b] += len(e.b_size)
    named = np.empty(len(a) + len(b), np.int64)
    named[np.arange(len(a)) + np.repeat(last_b + 1 - in_b, in_a)] = named_a
    named[np.arange(len(b)) + np.repeat(last_a + 1, in_b)] = named_b
    digest = hashlib.sha256(e.name[named][e.name_kept[named]].tobytes()[:-1]).hexdigest()
    return len(a), len(b), len(last_a), digest, a[last_a] << 32 | b[last_b]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]), kind))


def links(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the distinct linked pairs with how often each occurs."""
    with open(b_path, "rb") as f:
        model = f.read()
    ranks = read_byte_level(a_path)
    digest = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode() + model).digest()
    shared = docs.sparkSession.sparkContext.broadcast((digest, ranks, pattern, model))
    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoders_of(shared.value)
        for batch in batches:
            for first, data, at in text_pieces(batch.column(1), BLOCK_BYTES):
                raw = data.tobytes()
                rows = [_aligned(e, raw[i:j].decode("utf-8", "replace")) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                pairs = [np.unique(r[4], return_counts=True) for r in rows]
                n_a, n_b, n_groups = (pa.array([r[k] for r in rows], pa.int64()) for k in range(3))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(rows)), n_a, n_b, n_groups, pa.array([len(r[4]) for r in rows], pa.int64()),
                     pa.array([r[3] for r in rows], pa.string()), _lists([p for p, _ in pairs], pa.int64()), _lists([c for _, c in pairs], pa.int32())],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return kept.mapInArrow(linked, f"doc_id {kept.schema[0].dataType.simpleString()}, n_a long, n_b long, n_groups long, "
                                   "n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(linked: DataFrame) -> DataFrame:
    """pair and n: in how many links of all documents it is linked. Tasks add up their own counts first."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            pairs = np.concatenate((pairs, b.column(0).flatten().to_numpy()))
            times = np.concatenate((times, b.column(1).flatten().to_numpy().astype(np.int64)))
            pairs, back = np.unique(pairs, return_inverse=True)
            times = np.bincount(back, times, len(pairs)).astype(np.int64)  # below 2^53, so exact
            if len(pairs) > TASK_PAIRS:
                yield pa.RecordBatch.from_pydict({"pair": pairs, "n": times})
                pairs, times = pairs[:0], times[:0]
        yield pa.RecordBatch.from_pydict({"pair": pairs, "n": times})

    return linked.select("pairs", "times").mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _sums_by_lookup(linked: DataFrame, counts: DataFrame) -> DataFrame:
    table = counts.select("pair", F.when(F.col("is_best"), F.col("n")).otherwise(-F.col("n")).alias("n")).toArrow()
    pair, n = table["pair"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(pair)
    shared = linked.sparkSession.sparkContext.broadcast((pair[order], n[order]))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = linked.select(*names, "pairs", "times")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = shared.value
        for b in batches:
            times = b.column(7).flatten().to_numpy().astype(np.int64)
            found = n[np.searchsorted(pair, b.column(6).flatten().to_numpy())] if len(times) else times
            ends = np.cumsum(pc.list_value_length(b.column(6)).to_numpy())
            best, total = (np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], ends))])
                           for x in (times * (found > 0), times * np.abs(found)))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(6)], pa.array(best, pa.int64()), pa.array(total, pa.int64())],
                                             [*names, "n_best", "count_sum"])

    schema = ", ".join(f"{c} {t}" for c, t in rows.select(*names).dtypes)
    return rows.mapInArrow(summed, f"{schema}, n_best long, count_sum long")


def _sums_by_join(linked: DataFrame, counts: DataFrame) -> DataFrame:
    """The same through a join on the pair, which holds for any number of pairs; hot pairs are broadcast."""
    each = linked.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "_row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))
    groups = counts.select(F.col("pair").alias("group_key"), "n", "is_best", F.col("n").alias("group_rows"))
    sums = with_group(each, groups, "pair", 0).groupBy(F.col("_row").alias("of")).agg(
        F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return linked.join(sums, F.col("_row") == F.col("of"), "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))


def alignment(docs: DataFrame, a_path: str, b_path: str, pattern: str, looked_up: int = LOOKED_UP) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of (doc_id, text).

    A is a byte-level BPE file with its splitting ``pattern``, B a sentencepiece model that puts a blank first; special
    tokens in texts are plain text. Texts that are null or empty, or that B does not give back byte by byte, have no
    tokens: zeros and an empty digest. Repeated rows count each, in the corpus counts too; an empty table gives no
    rows; other columns are ignored. The documents' links are written once, so that they are encoded once; the counts
    of up to ``looked_up`` pairs are looked up in the tasks, of more they are joined.
    """
    scratch = Scratch(docs.sparkSession, "cross-tokens")
    linked = scratch.keep(links(docs, a_path, b_path, pattern).withColumn("_row", F.monotonically_increasing_id()), "links")
    counts, seen = scratch.keep_seen(pair_counts(linked), "pairs")
    # one row per B id, as many as the vocabulary has
    best = counts.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("n").alias("most"))
    flagged = counts.join(F.broadcast(best), F.col("pair").bitwiseAND(0xFFFFFFFF) == F.col("b")).select(
        "pair", "n", (F.col("n") == F.col("most")).alias("is_best"))
    sums = _sums_by_lookup if seen["n"] <= looked_up else _sums_by_join
    return sums(linked, flagged).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
