"""WARC archives: written as text by Spark, read back in blocks with verified record boundaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streetflow.llm.common import Scratch

#: Fixed values of the format: what starts a record, what parts header and block, what ends a record.
MAGIC, BLANK_LINE, RECORD_END = "\nWARC/", "\r\n\r\n", "\r\n\r\n"
VERSIONS = ("1.0", "1.1", "0.17", "0.18")
#: Payloads of at least this many bytes are stored once.
MIN_DEDUP_BYTES = 1000
#: The date of all records: the pages carry none.
DATE = "2024-01-01T00:00:00Z"


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """page_id, url, html, row, payload_bytes, payload_digest, record_type, refers_to, refers_to_row of (page_id, url, html, …).

    Of equal payloads of at least ``min_bytes`` the row of the largest page_id is the response, the others revisit it
    and come without html. Payloads are equal if their SHA-256 and length are. Of repeated rows with that page_id one
    is the response; a null page_id is the least. Null html is an empty payload. ``row`` is unique text. Other columns
    are ignored; an empty table gives no rows.

    Only one copy of each large payload is shuffled: copies are combined before the shuffle, and revisits need none.
    """
    scratch = Scratch(pages.sparkSession, "revisits")
    raw = F.col("html").cast("binary")
    kept = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).select(
        "*", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha1(raw).alias("payload_digest"))
    order = ["page_id", "url", "html", "row", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_to_row"]
    page_id = kept.schema["page_id"].dataType
    small = kept.where(F.col("payload_bytes") < min_bytes).select(
        "page_id", "url", "html", F.concat(F.lit("s"), F.monotonically_increasing_id()).alias("row"), "payload_bytes",
        "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast(page_id).alias("refers_to"),
        F.lit(None).cast("string").alias("refers_to_row"))
    large = kept.where(F.col("payload_bytes") >= min_bytes).withColumn("same", F.sha2(raw, 256))
    slim = scratch.keep(large.select("page_id", "url", "payload_bytes", "payload_digest", "same", F.concat(
        F.lit("l"), F.monotonically_increasing_id()).alias("row")), "slim")
    heads = slim.groupBy("same", "payload_bytes").agg(F.max(F.struct("page_id", "row")).alias("head"))
    judged = slim.join(heads, ["same", "payload_bytes"]).withColumn("again", F.col("head.row") != F.col("row"))
    bodies = large.groupBy("same", "payload_bytes").agg(F.any_value("html").alias("html"))
    responses = judged.where("not again").join(bodies, ["same", "payload_bytes"]).withColumn("record_type", F.lit("response"))
    revisits = judged.where("again").withColumn("html", F.lit(None).cast("string")).withColumn("record_type", F.lit("revisit"))
    first = responses.unionByName(revisits).withColumns({
        "refers_to": F.when(F.col("again"), F.col("head.page_id")), "refers_to_row": F.when(F.col("again"), F.col("head.row"))})
    return small.select(*order).union(first.select(*order))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; line breaks and percent signs of the value are encoded."""
    safe = F.replace(F.replace(F.replace(value.cast("string"), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n"))).otherwise("")


def record(row: str = "row") -> Column:
    """One record without its last four bytes, which the writer puts between rows."""
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    return F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:x-row:"), F.col(row), F.lit(">"))), _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.col("url")), _line("X-Page-ID", F.col("page_id")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("X-Payload-Length", F.col("payload_bytes")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(""),
        _line("WARC-Refers-To", F.concat(F.lit("<urn:x-row:"), F.col("refers_to_row"), F.lit(">"))),
        _line("X-Refers-To-Page-ID", F.col("refers_to")), _line("X-Refers-To-Row", F.col("refers_to_row")),
        _line("Content-Length", F.octet_length(block)), F.lit("\r\n"), block)


def write_archives(records: DataFrame, path: str, compression: str = "none", records_per_file: int = 50_000) -> None:
    """Archives of ``record`` rows through Spark's text writer, which reaches any file system; a file per task or more."""
    (records.select(record().alias("value")).write.option("lineSep", RECORD_END).option("compression", compression)
     .option("maxRecordsPerFile", records_per_file).text(path))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block, nth, value: what lies between record marks, wherever these stand.

    Spark splits plain files at any byte and hands every piece to the block in which it begins. ``block`` and ``nth``
    depend on how files are dealt to tasks and hold for one scan only.
    """
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"), "value")


def _with_starts(pieces: DataFrame) -> DataFrame:
    """Adds ``start``, the place of a piece's first byte in its file, from the sizes of the pieces before it.

    Sums go over the blocks of a file first, of which there are few, then over the pieces of a block.
    """
    size = F.col("bytes") + len(MAGIC)
    blocks = pieces.groupBy("file", "block").agg(F.sum(size).alias("size"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.join(starts, ["file", "block"]).withColumn(
        "start", F.col("base") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("base")


def _content() -> Column:
    """What tells a piece from others of its file in any scan."""
    return F.unhex(F.sha2(F.col("value").cast("binary"), 256))


def reachable(scratch: Scratch, links: DataFrame) -> DataFrame:
    """file, offset of every record that the chain from its file's start reaches, by pointer jumping.

    ``links`` has a row (file, offset, successor) per candidate. Each round adds the records one link beyond those
    reached and joins the links with themselves, so that they span twice as many records: the rounds are the logarithm
    of the longest chain.
    """
    known = links.select("file", "offset")
    reached, seen = scratch.keep_seen(known.where("offset = 0"), "reached")
    jumps, n = links.select("file", "offset", "successor"), -1
    while seen["n"] > n:
        n = seen["n"]
        landed = reached.join(jumps, ["file", "offset"]).select("file", F.col("successor").alias("offset"))
        grown, seen = scratch.keep_seen(reached.union(landed.join(known, ["file", "offset"], "left_semi")), "reached")
        scratch.drop(reached)
        reached = grown
        onward = jumps.select("file", F.col("offset").alias("successor"), F.col("successor").alias("further"))
        longer = scratch.keep(jumps.join(onward, ["file", "successor"]).select(
            "file", "offset", F.col("further").alias("successor")), "jumps")
        if id(jumps) in scratch.kept:
            scratch.drop(jumps)
        jumps = longer
    return reached


def read_archives(spark: SparkSession, path: str, measures: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """file, offset, version, head (the header lines) and ``measures`` of the payload for every record of the archives.

    Tasks cut the archives at every record mark. Pieces that start with a whole header are candidates and point to
    where the next record must begin; only those that the chain from the file's start reaches are records, so that
    marks inside payloads are rejected. A payload that holds marks is put together from its pieces. ``measures`` are
    functions of the binary payload, by default the payload itself. A record is returned only if the next one begins where
    it says, or if its file ends there with the payload whole: one cut short, or of a wrong length, is left out, and so is
    what follows it in its file, where the chain breaks off. Empty files and folders without records give no rows.
    """
    measures = measures or {"payload": lambda p: p}
    scratch = Scratch(spark, "warc")
    # a header may end with the line end that the next mark begins with
    head = F.substring_index(F.concat("value", F.lit("\n")), BLANK_LINE, 1)
    raw = F.col("value").cast("binary")
    scanned = _pieces(spark, path).withColumn("bytes", F.octet_length("value").cast("long")).withColumn(
        "head", F.when(F.octet_length(head) <= F.col("bytes"), head)).withColumn(
        "version", F.regexp_extract("head", r"\A(?:WARC/)?(\d+\.\d+)\r\n", 1)).withColumn(
        "length", F.regexp_extract("head", r"(?i)\ncontent-length:[ \t]*(\d{1,18})[ \t]*(?=\r|\z)", 1).try_cast("long"))
    candidate = F.col("head").isNotNull() & F.col("length").isNotNull() & F.col("version").isin(*VERSIONS)
    skip = F.octet_length("head") + len(BLANK_LINE)
    whole = skip + F.col("length") <= F.col("bytes")
    inner = F.when(candidate & whole, F.substring(raw, (skip + 1).cast("int"), F.col("length").cast("int")))
    table = scratch.keep(scanned.select(
        "file", "block", "nth", _content().alias("content"), "bytes", "version", F.when(candidate, F.col("head")).alias("head"), skip.alias("skip"), "length",
        (candidate & whole).alias("whole"), *[f(inner).alias(f"m_{k}") for k, f in measures.items()]), "scanned")
    placed = scratch.keep(_with_starts(table), "placed")
    scratch.drop(table)
    # a record's offset is that of its mark's W: the first piece of a file begins with it, others right after the mark
    found = placed.where(F.col("head").isNotNull()).withColumn(
        "offset", F.when(F.col("start") == 0, F.lit(0)).otherwise(F.col("start") - len(MAGIC) + 1).cast("long")).withColumn(
        "successor", F.col("start") + F.col("skip") + F.col("length") + len(RECORD_END))
    reached = reachable(scratch, found.select("file", "offset", "successor"))
    chain = found.select("file", "offset", "start", "successor", (F.col("start") + F.col("skip") + F.col("length")).alias("end")).join(
        reached, ["file", "offset"], "left_semi")
    onward = reached.select("file", F.col("offset").alias("successor"), F.lit(True).alias("goes_on"))
    sizes = placed.groupBy("file").agg(F.max(F.col("start") + F.col("bytes")).alias("size"))
    closed = (F.col("end") <= F.col("size")) & (F.col("successor") >= F.col("size"))
    verified = chain.join(onward, ["file", "successor"], "left").join(sizes, "file").where(F.coalesce("goes_on", closed)).select("file", "offset")
    records = found.join(scratch.keep(verified, "verified"), ["file", "offset"], "left_semi")
    names = list(measures)
    simple = records.where("whole").select("file", "offset", "version", "head", *[F.col(f"m_{k}").alias(k) for k in names])
    split = records.where("not whole").select("file", "offset", "start", "skip", "length", "version", "head")
    split, seen = scratch.keep_seen(split, "split")
    if not seen["n"]:
        return simple
    return simple.unionByName(_assembled(scratch, path, placed, chain, split).select(
        "file", "offset", "version", "head", *[f(F.col("payload")).alias(k) for k, f in measures.items()]))


def _assembled(scratch: Scratch, path: str, placed: DataFrame, chain: DataFrame, split: DataFrame) -> DataFrame:
    """The records ``split`` with their payload, joined from all pieces that lie in it.

    Every piece belongs to the last record before it: the last of its block, or else of the blocks before. The archives
    are read again for the pieces, which are found by their content wherever that scan meets them.
    """
    at = placed.select("file", "block", "content", "start").join(
        chain.select("file", "start", F.col("offset").alias("owner")), ["file", "start"], "left")
    by_block = Window.partitionBy("file", "block").orderBy("start")
    last = at.groupBy("file", "block").agg(F.max("owner").alias("last"))
    carried = last.select("file", "block", F.max("last").over(
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    owned = at.withColumn("owner", F.last("owner", True).over(by_block)).join(carried, ["file", "block"]).select(
        "file", "content", "start", F.coalesce("owner", "carried").alias("offset"))
    wanted = owned.join(split.select("file", "offset"), ["file", "offset"], "left_semi")
    wanted = scratch.keep(wanted, "wanted")
    again = _pieces(scratch.spark, path).select("file", _content().alias("content"), "value").join(
        wanted.select("file", "content").distinct(), ["file", "content"], "left_semi")
    values = again.groupBy("file", "content").agg(F.any_value("value").alias("value"))
    joined = wanted.join(values, ["file", "content"]).groupBy("file", "offset").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "value"))), lambda p: p["value"]), MAGIC).alias("whole"))
    return split.join(joined, ["file", "offset"]).withColumn("payload", F.substring(
        F.col("whole").cast("binary"), (F.col("skip") + 1).try_cast("int"), F.col("length").try_cast("int")))


def header(name: str) -> Column:
    """The value of a header line, decoded as ``_line`` encodes it; null without such a line."""
    value = F.nullif(F.regexp_extract("head", rf"(?i)\n{name}: ([^\r\n]*)", 1), F.lit(""))
    return F.replace(F.replace(F.replace(value, F.lit("%0D"), F.lit("\r")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to read back from archives of ``mark_revisits``.

    Digest and length of responses come from the payload itself; revisits take those of the response they refer to.
    """
    read = read_archives(spark, path, {"bytes": F.octet_length, "digest": F.sha1})
    rows = read.select(
        header("X-Page-ID").cast("long").alias("page_id"), header("WARC-Type").alias("record_type"),
        header("X-Refers-To-Row").alias("to_row"), header("X-Refers-To-Page-ID").cast("long").alias("refers_to"),
        F.regexp_extract("head", r"\nWARC-Record-ID: <urn:x-row:(\w+)>", 1).alias("row"), "bytes", "digest")
    rows = Scratch(spark, "warc-pages").keep(rows, "records")
    originals = rows.join(rows.where("to_row is not null").select(F.col("to_row").alias("row")).distinct(), "row", "left_semi").select(
        F.col("row").alias("to_row"), F.col("bytes").alias("o_bytes"), F.col("digest").alias("o_digest"))
    # responses refer to nothing, so they need not meet the originals
    revisits = rows.where("to_row is not null").join(originals, "to_row", "left").select(
        "page_id", F.coalesce("o_bytes", "bytes").alias("bytes"), F.coalesce("o_digest", "digest").alias("digest"), "record_type", "refers_to")
    both = rows.where("to_row is null").select("page_id", "bytes", "digest", "record_type", "refers_to").union(revisits)
    return both.select("page_id", F.col("bytes").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
