"""WARC records of pages, and the Merkle fixity audit of replicas.

A record's leaf covers its bytes; runs of leaves in order of offset are ranges with hashes of their own, up
to one root for each file. Replicas are compared by their roots, and only branches that mismatch
are descended, level by level, to the records that differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwise.llm.ordering import in_order, with_ranks
from siftwise.llm.scratch import Scratch

#: Consecutive ids that share a file, and children of a tree's node.
FILE_IDS, FANOUT = 1_000, 16


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC record of a page, up to its last line end, which the writer adds."""
    body = F.coalesce(html, F.lit(""))
    lines = [
        F.lit("WARC/1.1"),
        F.lit("WARC-Type: resource"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.sha2(body, 256)),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
        F.lit(""),
        F.concat(body, F.lit("\r\n\r")),
    ]
    return F.concat_ws("\r\n", *lines)


def to_records(pages: DataFrame, file_ids: int = FILE_IDS) -> DataFrame:
    """file, page_id, place, record: one record for each page; pages of consecutive ids share a file.

    Pages without an id are dealt to files -1 to -4096 by their content. place orders records of one id.
    """
    dealt = -1 - F.pmod(F.xxhash64("url", "html"), F.lit(4096))
    file = F.coalesce(F.floor(F.col("page_id") / file_ids), dealt).cast("long")
    made = pages.select(file.alias("file"), "page_id", record_text(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    return made.select("file", "page_id", F.xxhash64("record").alias("place"), "record")


def write_warc(records: DataFrame, path: str) -> None:
    """A folder of WARC files for each `file`. Any file system that Spark writes to serves. Nulls and repeated records are as
    to_records() made them; an empty table makes an empty folder."""
    ordered = records.repartition("file").sortWithinPartitions("file", "page_id", "place")
    ordered.select("file", "record").write.partitionBy("file").option("lineSep", "\n").text(path)


def parse_warc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and body of each record; bodies are found by their length, whatever they hold."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode().split("\r\n")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        begin = head + 4
        end = begin + int(headers["Content-Length"])
        yield at, headers, data[begin:end]
        at = end + 4


def read_warc(spark, path: str) -> DataFrame:
    """file, offset, page_id, url, html of the records under a folder that write_warc() made. A file is read by one task, whatever
    its length. A null page_id is read back as null, a null url or html as an empty one; repeated records are rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = int(name.rsplit("/file=", 1)[1].split("/")[0])
                rows = [
                    (file, at, int(i) if (i := h["WARC-Record-ID"][10:-1]) else None, h["WARC-Target-URI"], body.decode())
                    for at, h, body in parse_warc(data)
                ]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["file", "offset", "page_id", "url", "html"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "file long, offset long, page_id long, url string, html string")


def manifest(records: DataFrame, scratch: Scratch) -> DataFrame:
    """file, seq, page_id, offset, length, digest: what an archive says of each record, in order of page_id.

    Offsets and sequence numbers follow from lengths by a range sort, so a file of any number of records is spread over tasks.
    """
    length = (F.octet_length("record") + 1).cast("long")
    slim = scratch.save(records.select("file", "page_id", "place", length.alias("length"), F.sha2(F.concat("record", F.lit("\n")), 256).alias("digest")))
    ordered = in_order(slim, scratch, "file", "page_id", "place", "digest")
    return scratch.save(with_ranks(ordered, ["file"], "seq", offset="length").drop("place"))


def levels_for(*leaves: DataFrame) -> int:
    """Levels above the leaves until one node is left of the longest file."""
    longest = max(t.agg(F.max("seq")).first()[0] or 0 for t in leaves)
    levels = 1
    while longest >= FANOUT**levels:
        levels += 1
    return levels


def tree_levels(leaves: DataFrame, levels: int, scratch: Scratch | None = None) -> list[DataFrame]:
    """From file, seq, offset, length, digest: level 0 are the leaves, the last level the roots; each stored once if scratch is given.

    Nodes: file, node, begin, end (the offset range), hash. A node's hash covers its range and those of its FANOUT children at most.
    """
    save = scratch.save if scratch else lambda t: t
    end = F.col("offset") + F.col("length")
    made = [save(leaves.select("file", F.col("seq").cast("long").alias("node"), F.col("offset").alias("begin"), end.alias("end"), F.col("digest").alias("hash")))]
    for _ in range(levels):
        children = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "hash"))), lambda c: c["hash"]), ",")
        begin, end = F.min("begin"), F.max("end")
        digest = F.sha2(F.concat_ws(":", begin.cast("string"), end.cast("string"), children), 256)
        nodes = made[-1].groupBy("file", F.floor(F.col("node") / FANOUT).alias("node"))
        made.append(save(nodes.agg(begin.alias("begin"), end.alias("end"), digest.alias("hash"))))
    return made


def audit(first: list[DataFrame], second: list[DataFrame], scratch: Scratch) -> DataFrame:
    """file and node of the leaves that differ between two trees of equal height, missing ones too.

    Files whose roots agree are left at once; below, only children of mismatching nodes are compared.
    """
    wrong = None
    for level in range(len(first) - 1, -1, -1):
        a, b = (t[level].select("file", "node", "hash") for t in (first, second))
        if wrong is not None:
            up = wrong.select(F.col("file").alias("_file"), F.col("node").alias("_node"))
            a, b = (t.join(up, (t["file"] == up["_file"]) & (F.floor(t["node"] / FANOUT) == up["_node"]), "left_semi") for t in (a, b))
        both = a.join(b.select("file", "node", F.col("hash").alias("other")), ["file", "node"], "full")
        wrong = scratch.save(both.filter(~F.col("hash").eqNullSafe(F.col("other"))).select("file", "node"))
    return wrong


def damaged(records: DataFrame) -> DataFrame:
    """A replica as bad storage leaves it, for drills: of ids that leave 7 when divided by 101 a byte is flipped, of those that leave 3 when divided by 211 the end is overwritten."""
    flipped = F.concat(F.expr("substring(record, 1, 12)"), F.lit("X"), F.expr("substring(record, 14)"))
    torn = F.concat(F.expr("substring(record, 1, length(record) - 5)"), F.lit("#####"))
    how = F.when(F.col("page_id") % 101 == 7, flipped).when(F.col("page_id") % 211 == 3, torn).otherwise(F.col("record"))
    return records.withColumn("record", how)


def audit_pages(pages: DataFrame) -> DataFrame:
    """Archives pages, damages a replica as damaged() says, audits it, and returns every record.

    page_id, file, seq, record_offset, record_length, digest, corrupt. A null url or html is written as
    an empty one; null page_ids are dealt to files of their own; repeated rows are records each, equal ones in any order; a very long
    page is one record; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    records = to_records(pages)
    kept, replica = manifest(records, scratch), manifest(damaged(records), scratch)
    levels = levels_for(kept, replica)
    wrong = audit(tree_levels(kept, levels, scratch), tree_levels(replica, levels, scratch), scratch).select(F.col("file").alias("_file"), F.col("node").alias("_node"))
    told = kept.join(wrong, (F.col("file") == F.col("_file")) & (F.col("seq") == F.col("_node")), "left")
    return told.select(
        "page_id", "file", F.col("seq").cast("long").alias("seq"), F.col("offset").alias("record_offset"), F.col("length").alias("record_length"), "digest", F.col("_node").isNotNull().alias("corrupt")
    )
