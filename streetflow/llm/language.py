"""Language identification that fuses text likelihoods with declared language, address suffix and host priors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetflow.llm.common import IS_SPACE, TO_LOWER, Scratch, broadcast_bytes, text_pieces, with_group

LANGUAGES = ("de", "en", "es", "fr")
#: Hashed byte trigrams of the text model: a fixed size, so the model can be broadcast.
CELLS = 1 << 14
POOLED = 0.05
#: Trigrams of a text depend on each other; together they count for this many independent ones at most.
INDEPENDENT = 60.0
#: Pseudo-observations with which a host leans on its domain, and a domain on the whole table.
HOST_WEIGHT, DOMAIN_WEIGHT = 10.0, 20.0


def trigram_cells(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, cell) of the trigrams around each byte of each text that hold a letter.

    Bytes are in lower case, white space, digits and the places before and after a text count as blanks, so that a
    text has a trigram as soon as it has a letter: a-z or any byte outside ASCII.
    """
    plain = TO_LOWER[data].astype(np.uint32)
    plain[IS_SPACE[data] | ((data >= 48) & (data < 58))] = 32
    before, after = (np.full(len(plain), 32, np.uint32) for _ in range(2))
    before[1:], after[:-1] = plain[:-1], plain[1:]
    some = at[1:] > at[:-1]
    before[at[:-1][some]] = 32
    after[at[1:][some] - 1] = 32
    cell = (before * np.uint32(0x9E3779B1)) ^ (plain * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))
    cell = ((cell ^ (cell >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(18)).astype(np.int64)
    good = np.zeros(len(plain), bool)
    for part in (before, plain, after):
        good |= ((part >= 97) & (part <= 122)) | (part >= 128)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return owner[good], cell[good]


def address_labels(host: Column) -> Column:
    """The labels of a host name; none for null, numeric addresses and names without a dot."""
    labels = F.split(host, r"\.")
    return F.when((F.size(labels) > 1) & ~host.rlike(r"^[0-9.]+$|[:\[]"), labels)


def with_evidence(df: DataFrame, id_column: str, text: Column, declared: Column, host: Column) -> DataFrame:
    """id, text, declared (primary subtag in lower case), host, domain (its last two labels) and suffix (its last).

    Numeric addresses and names without a dot have neither domain nor suffix; an empty host counts as null.
    """
    name = F.lower(F.nullif(F.trim(host), F.lit("")))
    labels = address_labels(name)
    return df.select(
        F.col(id_column).alias("id"), F.coalesce(text.cast("string"), F.lit("")).alias("text"),
        F.lower(F.substring_index(F.replace(F.trim(declared), F.lit("_"), F.lit("-")), "-", 1)).alias("declared"),
        name.alias("host"),
        F.array_join(F.slice(labels, -2, 2), ".").alias("domain"), F.element_at(labels, -1).alias("suffix"))


def train(texts: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """Log probabilities (languages, CELLS) of trigrams from all texts that declare one of ``languages``.

    A part ``POOLED`` of every probability is that of all languages together, so that trigrams a language has not been
    seen with speak neither for nor against it, however many texts it has. A language without texts has that part only.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), CELLS), np.int64)
        for b in batches:
            lang = np.array([languages.index(x) for x in b.column(0).to_pylist()], np.int64)
            for first, data, at in text_pieces(b.column(1)):
                owner, cell = trigram_cells(data, at)
                total += np.bincount(lang[first + owner] * CELLS + cell, minlength=total.size).reshape(total.shape)
        which, cell = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"which": which.astype(np.int32), "cell": cell.astype(np.int32), "n": total[which, cell]})

    rows = (texts.where(F.col("declared").isin(*languages)).select("declared", "text")
            .mapInArrow(count, "which int, cell int, n long").groupBy("which", "cell").agg(F.sum("n").alias("n")).toPandas())
    counts = np.zeros((len(languages), CELLS))
    counts[rows["which"].to_numpy(int), rows["cell"].to_numpy(int)] = rows["n"].to_numpy(float)
    pooled = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * CELLS)
    return np.log((1 - POOLED) * counts / np.maximum(counts.sum(1, keepdims=True), 1) + POOLED * pooled)


def text_likelihoods(texts: DataFrame, model: np.ndarray) -> DataFrame:
    """The evidence columns without the text, n (trigrams) and likes: log likelihoods per language, the best being 0."""
    kept = texts.select("id", "declared", "host", "domain", "suffix", "text")
    shared = texts.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"{n} {t}" for n, t in kept.dtypes if n != "text") + ", n long, likes array<double>"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            sums, counts = np.zeros((len(b), len(table))), np.zeros(len(b), np.int64)
            for first, data, at in text_pieces(b.column(5)):
                owner, cell = trigram_cells(data, at)
                n = len(at) - 1
                counts[first:first + n] = np.bincount(owner, minlength=n)
                for k, row in enumerate(table):
                    sums[first:first + n, k] = np.bincount(owner, row[cell], n)
            mean = sums / np.maximum(counts, 1)[:, None]
            likes = (mean - mean.max(1, keepdims=True)) * (counts / (1 + counts / INDEPENDENT))[:, None] if len(b) else sums
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(5)], pa.array(counts), pa.array(likes.tolist(), pa.list_(pa.float64()))],
                ["id", "declared", "host", "domain", "suffix", "n", "likes"])

    return kept.mapInArrow(score, schema)


def _votes(scored: DataFrame, key: str, languages: tuple[str, ...]) -> DataFrame:
    """Texts per language, going by the text alone, and rows for each value of ``key``."""
    votes = F.array(*[F.count(F.when(F.col("n_best") == i, 1)).cast("double") for i in range(len(languages))])
    return scored.where(F.col(key).isNotNull() & (F.col("n") > 0)).groupBy(key).agg(
        votes.alias(f"{key}_votes"), F.count(F.lit(1)).alias("group_rows"))


def _smoothed(votes: Column, prior: Column, weight: float) -> Column:
    total = F.aggregate(votes, F.lit(0.0), lambda a, x: a + x) + weight
    return F.zip_with(votes, prior, lambda v, p: (v + p * weight) / total)


def identify(texts: DataFrame, languages: tuple[str, ...] = LANGUAGES, min_confidence: float = 0.5,
             max_broadcast: int | None = None) -> DataFrame:
    """id, language, confidence, text_language, n_trigrams and kept for each row of ``with_evidence``.

    posterior(l) ~ text likelihood * P(declared | l) * P(suffix | l) * P(l | host). The last is smoothed towards the
    host's domain and that towards the whole table, on which hosts without a domain lean themselves; all counts are
    grouped aggregates over every row with a letter. kept: the text holds a letter (``trigram_cells``) and the posterior
    of the best language reaches ``min_confidence``. Rows without any letter get the language ``und`` and confidence 0,
    a single letter is enough for the other evidence to decide; missing evidence has no say; ties go to the first
    language; repeated rows are judged each; an empty table gives no rows.
    """
    limit = broadcast_bytes(max_broadcast)
    scratch = Scratch(texts.sparkSession, "language")
    model = train(texts, languages)
    best = F.array_position("likes", F.array_max("likes")).cast("int") - 1
    scored, seen = scratch.keep_seen(
        text_likelihoods(texts, model).withColumn("n_best", best), "likes",
        **{f"best_{i}": F.count(F.when((F.col("n") > 0) & (F.col("n_best") == i), 1)) for i in range(len(languages))})
    total = sum(seen[f"best_{i}"] for i in range(len(languages)))
    overall = F.array(*[F.lit((seen[f"best_{i}"] + 1.0) / (total + len(languages))) for i in range(len(languages))])

    domains = _votes(scored, "domain", languages).select(
        F.col("domain").alias("of_domain"), _smoothed(F.col("domain_votes"), overall, DOMAIN_WEIGHT).alias("domain_prior"))
    by_host = _votes(scored, "host", languages).withColumn("domain", F.array_join(F.slice(address_labels(F.col("host")), -2, 2), "."))
    # a host without a domain leans on the whole table
    priors = by_host.join(domains, F.col("domain") == F.col("of_domain"), "left").select(
        F.col("host").alias("group_key"), "group_rows",
        _smoothed(F.col("host_votes"), F.coalesce("domain_prior", overall), HOST_WEIGHT).alias("host_prior"))

    def emission(key: str) -> DataFrame:
        """log P(value | language) up to a constant per value, smoothed with one observation per language."""
        rate = F.zip_with(f"{key}_votes", overall, lambda v, p: (v + 1.0) / (p * total + len(languages)))
        return _votes(scored, key, languages).select(F.col(key).alias("group_key"), "group_rows", F.transform(rate, F.ln).alias(f"{key}_like"))

    zero = F.array(*[F.lit(0.0)] * len(languages))
    joined = with_group(scored, priors, "host", limit)
    for key in ("declared", "suffix"):
        joined = with_group(joined, emission(key), key, limit)
    terms = [F.col("likes"), F.transform(F.coalesce("host_prior", overall), F.ln),
             F.coalesce("declared_like", zero), F.coalesce("suffix_like", zero)]
    logs = terms[0]
    for t in terms[1:]:
        logs = F.zip_with(logs, t, lambda a, b: a + b)
    summed = joined.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    confidence = 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    named = F.array(*[F.lit(x) for x in languages])
    has = F.col("n") > 0
    out = summed.select(
        "id", F.when(has, F.element_at(named, F.array_position("logs", F.col("top")).cast("int"))).otherwise("und").alias("language"),
        F.when(has, confidence).otherwise(0.0).alias("confidence"),
        F.when(has, F.element_at(named, F.col("n_best") + 1)).otherwise("und").alias("text_language"), F.col("n").alias("n_trigrams"))
    return out.withColumn("kept", F.col("confidence") >= min_confidence)


def page_text(html: Column) -> Column:
    """What a reader sees of a page, roughly: no scripts, styles, comments, tags or entities."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&#?\w+;", " ")


def markup_language(html: Column) -> Column:
    """The value of lang in the html tag."""
    return F.nullif(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([\w-]+)""", 1), F.lit(""))
