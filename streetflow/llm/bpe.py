"""Byte-level BPE: merges are replayed over the distinct words of a block of the corpus, then texts are looked up."""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from streetflow.llm.common import text_pieces

#: Encoded words that a Python worker keeps between batches and tasks; beyond, the store starts anew.
STORE_WORDS = 300_000
#: Text that is looked up together, and words whose merges are replayed together.
BLOCK_BYTES, BLOCK_WORDS = 2_000_000, 40_000

LETTER, NUMBER, SPACE, BLANK, OTHER = 0, 1, 2, 3, 4
#: The endings that the splitting pattern takes together with an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def load_ranks(path: str) -> list[bytes]:
    """Tokens by id from a rank file; the driver reads it, executors get it as a broadcast of fixed size."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return sorted(ranks, key=ranks.__getitem__)


def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, space, other white space, anything else."""
    kind = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        first = unicodedata.category(chr(c))[0]
        if first == "L":
            kind[c] = LETTER
        elif first == "N":
            kind[c] = NUMBER
        elif first == "Z":
            kind[c] = SPACE
    kind[[9, 10, 11, 12, 13, 0x85]] = SPACE
    kind[32] = BLANK
    return kind


def split_points(codes: np.ndarray, at: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Starts of the pieces that the splitting pattern finds in texts ``codes[at[i]:at[i + 1]]``.

    A piece is a run of one class with at most one blank before it; of a run of white space, the last character parts
    from the others unless the text ends there; a lone apostrophe takes one of ``ENDINGS`` from the letters after it.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds[codes]
    white = (kind == SPACE) | (kind == BLANK)
    group = np.where(white, SPACE, kind)
    first = np.zeros(n, bool)
    first[at[:-1][at[:-1] < n]] = True
    starts = first.copy()
    starts[1:] |= group[1:] != group[:-1]
    run = np.flatnonzero(starts)
    end = np.append(run[1:], n)
    ends_text = np.zeros(n + 1, bool)
    ends_text[at[1:]] = True
    cut = starts.copy()
    # white space followed by something else: the last character stands alone, or joins what follows if it is a blank
    spaces = white[run] & ~ends_text[end]
    cut[end[spaces] - 1] = True
    joined = end[spaces & (kind[end - 1] == BLANK)]
    cut[joined] = False
    # a lone apostrophe that no blank precedes
    mark = run[(codes[run] == 39) & (end - run == 1) & cut[run] & ~ends_text[end]]
    mark = mark[kind[mark + 1] == LETTER] if len(mark) else mark
    for m in mark.tolist():
        stop = int(at[np.searchsorted(at, m, "right")])
        for ending in ENDINGS:
            if codes[m + 1:min(stop, m + 1 + len(ending))].tolist() == [ord(c) for c in ending]:
                cut[m + 1] = False
                after = m + 1 + len(ending)
                if after < stop and kind[after] == LETTER:
                    cut[after] = True
                break
    return np.flatnonzero(cut)


class Merges:
    """The pairs of tokens that join, from the tokens alone."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.byte_id = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.joins: dict[int, int] = {}
        for i, t in enumerate(tokens):
            for k in range(1, len(t)):
                a, b = self.ids.get(t[:k]), self.ids.get(t[k:])
                if a is not None and b is not None:
                    self.joins[a << 32 | b] = i
        pairs = np.array(sorted(self.joins.items()), np.int64)
        self.pair_keys, self.pair_ranks = pairs[:, 0].copy(), pairs[:, 1].copy()
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.store: dict[str, bytes] = {}
        self.kinds = char_classes()

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of words, by applying merges in rank order to all of them at once.

        The words lie in one list of symbols with links to their neighbours. ``where`` is the inverted index from the
        id a pair joins to, which is its rank, to the positions of the pair's left symbol. The lowest rank is taken
        from a heap and applied to its positions from left to right; only the two pairs beside a new symbol are
        entered anew. Should one of them have a lower rank, that rank goes first, as it would in the word alone.
        """
        joined, heappush = self.joins.get, heapq.heappush
        size = [len(w) for w in words]
        symbol = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbol)
        last = np.zeros(n, bool)
        last[np.cumsum(size) - 1] = True
        nxt = np.where(last, -1, np.arange(1, n + 1)).tolist()
        prv = np.where(np.concatenate(([True], last[:-1])), -1, np.arange(-1, n - 1)).tolist()
        keys = symbol[:-1] << 32 | symbol[1:]
        # the index of the first pairs: ranks by binary search in the sorted pair keys, then one list per rank
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        places = np.flatnonzero((self.pair_keys[at] == keys) & ~last[:-1])
        ranks = self.pair_ranks[at[places]]
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        bounds = np.flatnonzero(np.diff(ranks, prepend=-1, append=-1))
        where = {int(ranks[a]): places[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])}
        symbol = symbol.tolist()
        heap = list(where)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = where.pop(rank)
            places.sort(reverse=True)
            while places:
                i = places.pop()
                j, left = nxt[i], symbol[i]
                if j < 0 or left < 0 or joined(left << 32 | symbol[j]) != rank:
                    continue
                symbol[i], symbol[j] = rank, -1
                k, h = nxt[j], prv[i]
                nxt[i] = k
                lower = False
                if k >= 0:
                    prv[k] = i
                    r = joined(rank << 32 | symbol[k])
                    if r is not None:
                        if r in where:
                            where[r].append(i)
                        else:
                            where[r] = [i]
                            heappush(heap, r)
                        lower = r < rank
                if h >= 0:
                    r = joined(symbol[h] << 32 | rank)
                    if r is not None:
                        if r in where:
                            where[r].append(h)
                        else:
                            where[r] = [h]
                            heappush(heap, r)
                        lower |= r < rank
                if lower and places:
                    where[rank] = places
                    heappush(heap, rank)
                    break
        ids = np.array(symbol, np.int64)
        owner = np.repeat(np.arange(len(words)), size)[ids >= 0]
        ids = ids[ids >= 0].astype("<u4")
        bounds = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(words)))))
        raw = ids.tobytes()
        return [raw[4 * a:4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def _looked_up(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """The pieces of all texts and the bounds of each text's pieces; every piece is in the store then."""
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        cuts = split_points(codes, at, self.kinds)
        bounds = np.searchsorted(cuts, at).tolist()
        cuts = [*cuts.tolist(), len(whole)]
        pieces = [whole[a:b] for a, b in zip(cuts, cuts[1:])]
        distinct = set(pieces)
        new = [w for w in distinct if w not in self.store]
        if len(self.store) + len(new) > STORE_WORDS:
            self.store.clear()
            new = list(distinct)
        replayed, raw = [], []
        for w in new:
            b = w.encode()
            known = self.ids.get(b)
            if known is None:
                replayed.append(w)
                raw.append(b)
            else:
                self.store[w] = known.to_bytes(4, "little")
        for a in range(0, len(raw), BLOCK_WORDS):
            self.store.update(zip(replayed[a:a + BLOCK_WORDS], self.replay(raw[a:a + BLOCK_WORDS])))
        return pieces, bounds

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of every text."""
        pieces, bounds = self._looked_up(texts)
        get = self.store.__getitem__
        return [b"".join(map(get, pieces[a:b])) for a, b in zip(bounds, bounds[1:])]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of a list of ids: every token's bytes, gathered from one table."""
        number = np.frombuffer(ids, "<u4").astype(np.int64)
        size = self.length[number]
        first = np.repeat(self.begin[number] - (np.cumsum(size) - size), size)
        return self.bytes[first + np.arange(len(first))].tobytes()


_MERGES: dict[bytes, Merges] = {}


def merges_of(tokens: list[bytes]) -> Merges:
    """One per Python worker and vocabulary, kept between tasks."""
    key = hashlib.sha256(b"".join(base64.b64encode(t) + b"\n" for t in tokens)).digest()
    if key not in _MERGES:
        _MERGES.clear()
        _MERGES[key] = Merges(tokens)
    return _MERGES[key]


def tokenize(docs: DataFrame, rank_file: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids binary) for every row: the ids of the whole text as little-endian unsigned 32-bit integers.

    Null texts count as empty and have no ids; repeated rows are encoded each; an empty table gives no rows; other
    columns are ignored. Bytes that are no UTF-8 count as the replacement character. Nothing is shuffled: words are
    independent of each other, so each task replays the merges over the distinct words of its own block.
    """
    spark = docs.sparkSession
    tokens = spark.sparkContext.broadcast(load_ranks(rank_file))
    kept = docs.select(id_column, docs[text_column].cast("string").alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(tokens.value)
        for b in batches:
            for first, data, at in text_pieces(b.column(1), BLOCK_BYTES):
                raw = data.tobytes()
                out = merges.encode([raw[i:j].decode("utf-8", "replace") for i, j in zip(at[:-1].tolist(), at[1:].tolist())])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(out)), pa.array(out, pa.binary())], [id_column, "ids"])

    return kept.mapInArrow(encoded, f"{id_column} {kept.schema[0].dataType.simpleString()}, ids binary")


_LIBRARY: dict[bytes, object] = {}


def _library(digest: bytes, tokens: list[bytes], pattern: str):
    """The tokenizer library's encoding, one per Python worker and vocabulary."""
    if digest not in _LIBRARY:
        import tiktoken

        _LIBRARY.clear()
        _LIBRARY[digest] = tiktoken.Encoding(
            "counts", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    return _LIBRARY[digest]


def token_counts(docs: DataFrame, rank_file: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens long) for every row: how many ids ``tokenize`` gives for the whole text.

    Where only the number is asked for, nothing has to be replayed: texts are encoded one by one by the tokenizer
    library with the same ranks and splitting ``pattern``, and no ids are kept.
    """
    tokens = load_ranks(rank_file)
    digest = hashlib.sha256(b"".join(base64.b64encode(t) + b"\n" for t in tokens) + pattern.encode()).digest()
    shared = docs.sparkSession.sparkContext.broadcast((digest, tokens, pattern))
    kept = docs.select(id_column, docs[text_column].cast("string").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _library(*shared.value).encode_ordinary
        for b in batches:
            for first, data, at in text_pieces(b.column(1), BLOCK_BYTES):
                raw = data.tobytes()
                n = [len(encode(raw[i:j].decode("utf-8", "replace"))) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(n)), pa.array(n, pa.int64())], [id_column, "n_tokens"])

    return kept.mapInArrow(counted, f"{id_column} {kept.schema[0].dataType.simpleString()}, n_tokens long")


def detokenize(tokens_table: DataFrame, rank_file: str, id_column: str = "doc_id") -> DataFrame:
    """(id, decoded binary) from ``tokenize``'s rows; null ids decode to no bytes."""
    tokens = tokens_table.sparkSession.sparkContext.broadcast(load_ranks(rank_file))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(tokens.value)
        for b in batches:
            out = [merges.decode(ids or b"") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], [id_column, "decoded"])

    kept = tokens_table.select(id_column, "ids")
    return kept.mapInArrow(decoded, f"{id_column} {kept.schema[0].dataType.simpleString()}, decoded binary")


def digest(docs: DataFrame, rank_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text: encoded, then decoded from the ids alone."""
    tokens = docs.sparkSession.sparkContext.broadcast(load_ranks(rank_file))
    ids = tokenize(docs, rank_file)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(tokens.value)
        for b in batches:
            ids = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                 pa.array([hashlib.sha256(merges.decode(x)).hexdigest() for x in ids])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = ids.schema[0].dataType.simpleString()
    return ids.mapInArrow(digested, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
