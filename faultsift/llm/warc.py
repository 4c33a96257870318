"""WARC archives: writing with revisit records, and reading by boundary chains.

The writer is Spark's text sink: a record is one string of header, block and two line ends. The
reader splits archives at the record magic, wherever it stands, in as many tasks as there are
blocks of a file. Every piece is a candidate record: its header gives the offset of its
successor. From the start of a file the chain of successors is followed by pointer jumping; what it
does not reach is magic inside a payload and belongs to the record around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, new_folder

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32: 20 bits at a time, written in base 32 and renamed digit by digit."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, key: str = "page_id",
                  url: str = "url", payload: str = "html") -> None:
    """Write a record for every row below `path`, as plain WARC files.

    Of rows with equal payloads of `least_bytes` or more, the one with the largest key is a response
    and the others revisit it; rows that share the largest key and the payload are all responses, and
    so are smaller payloads. A null payload is empty, a null key is written as an empty id, a null url
    as an empty one; control characters in urls are percent-encoded. Only payloads that occur more than
    once are looked up; their table is joined by broadcast or by shuffle, as its size on disk says.
    """
    body = F.encode(F.coalesce(F.col("_payload"), F.lit("")), "UTF-8")
    rows = pages.select(pages[key].alias("_key"), pages[url].alias("_url"),
                        F.coalesce(pages[payload], F.lit("")).alias("_payload"))
    rows = rows.withColumns({"_digest": base32_sha1(body), "_bytes": F.octet_length("_payload")})
    repeated = cut_lineage(
        rows.where(F.col("_bytes") >= least_bytes).groupBy("_digest", "_bytes")
        .agg(F.max("_key").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1).drop("_n"))
    rows = rows.join(repeated, ["_digest", "_bytes"], "left")
    revisit = F.coalesce(F.col("_key") < F.col("_first"), F.col("_first").isNotNull() & F.col("_key").isNull())
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    address = F.coalesce("_url", F.lit(""))
    for code in [*range(32), 127]:
        address = F.replace(address, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    block = F.concat(F.lit(HTTP), F.when(revisit, "").otherwise(F.col("_payload")))
    header = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("_key")),
        F.lit("\r\nWARC-Target-URI: "), address,
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), name(F.col("_first")))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("_digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("_bytes").cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(END))
    # the sink ends each value with \n, the last byte of the record
    record = F.concat(header, block, F.lit(END[:-1]))
    rows.select(record.alias("value")).write.option("lineSep", "\n").text(path)


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, f"(?im)^{name}:[ \\t]*([^\\r\\n]*)", 1)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The parts of the files between magics, with their file, block and order, as a written table.

    How files are split depends on the cores of the moment, so one scan gives both the places and the bytes."""
    pieces = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("value").cast("binary").alias("data"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    step = new_folder(spark, "step")
    pieces.write.option("compression", "zstd").parquet(step)
    return spark.read.schema(pieces.schema).parquet(step)


def candidates(pieces: DataFrame) -> DataFrame:
    """Every piece as a candidate record: offset, successor, header fields, digest of its own payload."""
    head = F.substring_index(F.col("data").cast("string"), END, 1)
    pieces = pieces.select(
        "file", "block", "id", F.octet_length("data").alias("n"), "data", head.alias("head"),
        F.octet_length(head).alias("head_bytes"))
    length = _field(F.col("head"), "Content-Length").try_cast("long")
    whole_head = F.col("head_bytes") < F.col("n")
    start = F.col("head_bytes") + len(END) + len(HTTP) + 1
    return pieces.select(
        "file", "block", "id", "n", F.when(whole_head, F.col("head_bytes") + len(END)).alias("head_bytes"),
        F.when(whole_head, length).alias("length"),
        _field(F.col("head"), "WARC-Type").alias("record_type"),
        _field(F.col("head"), "WARC-Record-ID").alias("record_id"),
        _field(F.col("head"), "WARC-Refers-To").alias("refers_to"),
        _field(F.col("head"), "WARC-Target-URI").alias("url"),
        _field(F.col("head"), "WARC-Payload-Digest").alias("digest"),
        _field(F.col("head"), "X-Payload-Length").alias("payload_length"),
        F.when(whole_head & (F.col("n") == F.col("head_bytes") + 2 * len(END) + length), base32_sha1(
            F.substring(F.col("data"), start, F.greatest(length - len(HTTP), F.lit(0)).cast("int"))
        )).alias("own_digest"))


def _located(found: DataFrame) -> DataFrame:
    """Add `offset`, `successor` and `ordinal` (in the file) to candidates.

    A block's first offset is the sum of the blocks before it: one row per block meets by file."""
    step = F.col("n") + len(MAGIC)
    blocks = found.groupBy("file", "block").agg(F.sum(step).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"),
                          F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rank"))
    inside = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    located = found.join(bases, ["file", "block"]).withColumns({
        "offset": F.col("base") + F.coalesce(F.sum(step).over(inside), F.lit(0)) - len(MAGIC),
        "ordinal": F.col("rank") + F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0))})
    return located.drop("base", "rank").where(F.col("offset") >= 0).withColumn(
        "successor", F.col("offset") + len(MAGIC) + F.col("head_bytes") + F.col("length") + len(END))


def reachable(located: DataFrame) -> DataFrame:
    """The candidates on the chain from the start of their file.

    Inside a block, candidates that follow one another without a gap form a run, which the chain
    leaves at one place; pointer jumping is over the places where runs are left and entered."""
    order = Window.partitionBy("file", "block").orderBy("offset")
    linked = F.coalesce(F.lead("offset").over(order) == F.col("successor"), F.lit(False))
    rows = located.withColumn("_linked", linked).withColumns({
        "run": F.count(F.when(~F.col("_linked"), 1)).over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "leaves": F.first(F.when(~F.col("_linked"), F.coalesce("successor", F.lit(-1))), ignorenulls=True).over(
            order.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    rows = cut_lineage(rows.drop("_linked"))
    entries = rows.select("file", F.col("leaves").alias("offset")).union(
        rows.select("file", F.lit(0).cast("long").alias("offset"))).distinct()
    jumps = cut_lineage(rows.join(entries, ["file", "offset"], "left_semi").select(
        "file", "offset", F.col("leaves").alias("to")))
    places = jumps.select("file", "offset")
    reached = cut_lineage(jumps.where(F.col("offset") == 0).select("file", "offset"))
    size = reached.count()
    while True:
        ahead = reached.join(jumps, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        ahead = ahead.join(places, ["file", "offset"], "left_semi")
        grown = cut_lineage(reached.union(ahead).distinct())
        if (new_size := grown.count()) == size:
            break
        reached, size = grown, new_size
        further = jumps.select("file", F.col("offset").alias("to"), F.col("to").alias("beyond"))
        jumps = cut_lineage(jumps.join(further, ["file", "to"]).select("file", "offset", F.col("beyond").alias("to")))
    entered = rows.join(reached, ["file", "offset"], "left_semi").groupBy("file", "block", "run").agg(
        F.min("offset").alias("_entered"))
    return rows.join(entered, ["file", "block", "run"]).where(
        F.col("offset") >= F.col("_entered")).drop("run", "leaves", "_entered")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below `path`: file, offset, record_id, record_type, refers_to, url,
    payload_bytes, payload_digest, digest_ok.

    Payload digests of responses are computed from what was read, also where the payload holds the
    record magic; of revisits the header's are given. A file that does not start with a record gives
    none; a record that claims more than the file has ends its chain. No files give no rows.
    """
    pieces = _pieces(spark, path)
    located = cut_lineage(_located(candidates(pieces)))
    records = cut_lineage(reachable(located))
    response = F.col("record_type") == "response"
    broken = cut_lineage(records.where(response & F.col("own_digest").isNull()).select(
        "file", "offset", "successor", "ordinal", "head_bytes", "length"))
    joined = _joined_digests(pieces, located, broken)
    records = records.join(joined, ["file", "offset"], "left").withColumn(
        "_digest", F.coalesce("own_digest", "joined_digest"))
    stated = F.regexp_replace("digest", "^sha1:", "")
    return records.where(~response | F.col("_digest").isNotNull()).select(
        "file", "offset", "record_id", "record_type", "refers_to", "url",
        F.when(response, F.col("length") - len(HTTP)).otherwise(
            F.col("payload_length").try_cast("long")).alias("payload_bytes"),
        F.when(response, F.col("_digest")).otherwise(stated).alias("payload_digest"),
        (~response | (F.col("_digest") == stated)).alias("digest_ok"))


def _joined_digests(pieces: DataFrame, located: DataFrame, broken: DataFrame) -> DataFrame:
    """Digests of records whose payload holds the magic: their pieces are put together again.

    What one task holds is one record."""
    if broken.isEmpty():
        return broken.select("file", "offset", F.lit(None).cast("string").alias("joined_digest"))
    after = located.select("file", F.col("offset").alias("successor"), F.col("ordinal").alias("_next"))
    last = located.groupBy("file").agg(F.max("ordinal").alias("_last"))
    spread = broken.join(after, ["file", "successor"], "left").join(last, "file").select(
        "file", "offset", "head_bytes", "length", F.explode(F.sequence(
            "ordinal", F.coalesce("_next", F.col("_last") + 1) - 1)).alias("ordinal"))
    wanted = cut_lineage(spread.join(located.select("file", "ordinal", "id"), ["file", "ordinal"]))
    whole = pieces.select("id", F.col("data").cast("string").alias("data")).join(wanted, "id").groupBy("file", "offset", "head_bytes", "length").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "data"))).alias("parts"))
    data = F.array_join(F.col("parts.data"), MAGIC).cast("binary")
    start = (F.col("head_bytes") + len(HTTP) + 1).cast("int")
    return whole.where(F.octet_length(data) == F.col("head_bytes") + F.col("length") + len(END)).select(
        "file", "offset", base32_sha1(F.substring(
            data, start, (F.col("length") - len(HTTP)).cast("int"))).alias("joined_digest"))
