"""WARC fixity audit with Merkle trees: find where a replica of an archive differs, looking only into what differs.

Archive. Records stand in files, in order of offset. A leaf is the SHA-256 of a record's place and content: its offset, length and the SHA-256 of the whole record (header and
block). An inner node covers an ordered range of offsets: the records whose slots in the file share all but the last digits in base ``FANOUT``; its hash is
over its children's places and hashes, and files are the leaves of the tree above, up to one root. ``records`` makes an archive of pages, with files by ranges of id
(``FILE_RECORDS`` ids a file, slots by id, so that a lost record shifts no slot); ``read_warc`` reads one from WARC files, where slots count records by offset.

Audit. Compare the roots; then, level by level, only children of nodes that differ. What is left at the leaves are the
records that differ: changed, moved (the same record at another offset), missing in the replica, or only in the replica. Every inner node has ``FANOUT`` children at most, so no
task gathers more than that for one node. Damaged bytes of a file are a record of their own, up to where the next one begins.

Defined cases. Null payloads and urls: as empty. Null ids: left out of the archive (a record needs an id). Repeated ids: one leaf over all of
them, a sum of their hashes, so that none of them is gathered. Ids that aren't whole numbers are refused. Very long records: one value each. Empty tables: an empty
archive; two empty ones are equal. Other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_number, written

FILE_RECORDS, FANOUT = 512, 8
CONTENT_LENGTH = re.compile(rb"(?i)\r\ncontent-length:[ \t]*([0-9]{1,15})[ \t]*(?=\r\n|$)")


def warc_record(id_: Column, url: Column, block: Column) -> Column:
    """A response record of the WARC format, version 1.0."""
    body = F.coalesce(block, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), id_.cast("string"), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", block_col: str = "html") -> DataFrame:
    """(id, record): the text of every record."""
    return pages.where(F.col(id_col).isNotNull()).select(whole_number(pages, id_col).alias("id"), warc_record(F.col(id_col), F.col(url_col), F.col(block_col)).alias("record"))


def parse_warc(data: bytes) -> list[tuple[int, int, bytes]]:
    """(offset, length, record) of every record of an uncompressed WARC file. Bytes that make no record are one, up to where the next one begins."""
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        length = CONTENT_LENGTH.search(data, at, end) if data.startswith(b"WARC/", at) and end >= 0 else None
        stop = end + 4 + int(length[1]) + 4 if length else 0
        if not stop or data[stop - 4 : stop] != b"\r\n\r\n":
            after = data.find(b"\r\n\r\nWARC/", at + 1)
            stop = after + 4 if after >= 0 else len(data)
        out.append((at, stop - at, data[at:stop]))
        at = stop
    return out


def read_warc(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, offset, length, record) from a binaryFile table of WARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = parse_warc(data.as_py() or b"")
                cols = list(zip(*found, strict=True)) if found else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["path", "offset", "length", "record"])

    return files.select(path_col, content_col).mapInArrow(run, "path string, offset long, length long, record binary")


def manifest(archive: DataFrame) -> DataFrame:
    """(id, file, slot, offset, length, sha256) of every record; ``archive``: (id, record)."""
    slim = archive.select("id", F.call_function("div", F.col("id") - F.pmod(F.col("id"), F.lit(FILE_RECORDS)), F.lit(FILE_RECORDS).cast("long")).alias("file"), F.pmod(F.col("id"), F.lit(FILE_RECORDS)).alias("slot"),
                          F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256"))
    # equal ids (one slot) are summed up first: however many there are, the window of a file holds a row for each slot
    slots = slim.groupBy("file", "slot").agg(F.sum("length").alias("length"))
    before = Window.partitionBy("file").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.select("file", "slot", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    return slim.join(starts, ["file", "slot"]).select("id", "file", "slot", "offset", "length", "sha256")


def file_manifest(found: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, file, slot, offset, length, sha256) of the records of ``read_warc``; ``paths``: (path, file). Slots count a file's records by offset; the id names file and slot."""
    by_offset = Window.partitionBy("path").orderBy("offset")
    slim = found.select("path", "offset", "length", F.sha2("record", 256).alias("sha256")).withColumn("slot", F.row_number().over(by_offset).cast("long") - 1)
    return slim.join(paths, "path").select((F.col("file") * F.lit(1 << 32) + F.col("slot")).alias("id"), "file", "slot", "offset", "length", "sha256")


def levels(spans: tuple[int, int], fanout: int = FANOUT) -> tuple[int, int]:
    """Inner levels within a file and above the files, for files from spans[0] to spans[1]."""
    inner, outer, n = 0, 0, FILE_RECORDS
    while n > 1:
        n, inner = -(-n // fanout), inner + 1
    low, high = spans
    while low != high:
        low, high, outer = low // fanout, high // fanout, outer + 1
        if (low, high) == (-1, 0):  # ids on both sides of zero never meet by division
            outer += 1
            break
    return inner, outer


def up_one(place: str, fanout: int) -> Column:
    """Floor of place / fanout, exact."""
    return F.call_function("div", F.col(place) - F.pmod(F.col(place), F.lit(fanout)), F.lit(fanout).cast("long"))


def leaf_hash() -> Column:
    """The hash of a leaf, as an aggregate: that of its record's offset, length and content; of several records at one place, of the sums of four parts of their hashes and their number."""
    own = F.sha2(F.concat_ws(":", "offset", "length", "sha256"), 256)
    parts = [F.sum(F.conv(F.substring(own, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return F.when(F.count("*") == 1, F.min(own)).otherwise(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *parts), 256))


def trees(leaves: DataFrame, spans: tuple[int, int], fanout: int = FANOUT) -> list[DataFrame]:
    """Nodes (place, hash) level by level, leaves first and the root last. A place is (file, slot // fanout ** level), above files (-, file // fanout ** level)."""
    inner, outer = levels(spans, fanout)
    now = written(leaves.groupBy("file", "slot").agg(leaf_hash().alias("hash")), "tree")
    out = [now]
    for level in range(inner + outer):
        up = now.withColumns({"child": F.concat_ws(":", "file", "slot"), "file": F.col("file") if level < inner else (up_one("file", fanout) if level < inner + outer - 1 else F.lit(0).cast("long")),
                              "slot": up_one("slot", fanout)})
        now = written(up.groupBy("file", "slot").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("child", "hash"))), lambda x: F.concat(x["child"], F.lit("="), x["hash"])), ","), 256).alias("hash")), "tree")
        out.append(now)
    return out


def differing_leaves(ours: list[DataFrame], theirs: list[DataFrame], spans: tuple[int, int], fanout: int = FANOUT) -> DataFrame:
    """(file, slot) of the leaves that differ: from the roots down, children of differing nodes only."""
    inner, outer = levels(spans, fanout)

    def compared(level: int, within: DataFrame | None) -> DataFrame:
        a, b = ours[level], theirs[level]
        if within is not None:
            place = {"up_file": F.col("file") if level < inner else (up_one("file", fanout) if level < inner + outer - 1 else F.lit(0).cast("long")), "up_slot": up_one("slot", fanout)}
            up = within.select(F.col("file").alias("up_file"), F.col("slot").alias("up_slot"))
            a, b = (x.withColumns(place).join(up, ["up_file", "up_slot"], "left_semi").drop("up_file", "up_slot") for x in (a, b))
        return a.join(b.withColumnRenamed("hash", "other"), ["file", "slot"], "full").where("not (hash <=> other)").select("file", "slot")

    found = None
    for level in range(len(ours) - 1, -1, -1):
        found = written(compared(level, found), "differing")
    return found


def audited(a: DataFrame, b: DataFrame) -> DataFrame:
    """The audit of two written manifests."""
    low, high = a.select("file").union(b.select("file")).agg(F.min("file"), F.max("file")).first()
    spans = (low or 0, high or 0)
    bad = differing_leaves(trees(a, spans), trees(b, spans), spans)
    suspects = lambda m: m.join(bad, ["file", "slot"], "left_semi").groupBy("file", "slot").agg(content().alias("content"), leaf_hash().alias("leaf"))
    content = lambda: F.concat_ws(":", F.count("*").cast("string"), *[F.sum(F.conv(F.substring("sha256", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)])
    pairs = suspects(a).join(suspects(b).select("file", "slot", F.col("content").alias("other"), F.col("leaf").alias("other_leaf")), ["file", "slot"], "full")
    status = F.when(F.col("other").isNull(), "missing").when(F.col("content").isNull(), "extra").when(F.col("content") != F.col("other"), "changed").when(F.col("leaf") != F.col("other_leaf"), "moved").otherwise("ok")
    verdict = written(pairs.select("file", "slot", status.alias("verdict")), "fixity-verdicts")
    ours_out = a.join(verdict, ["file", "slot"], "left").select("id", "file", "offset", "length", "sha256", F.coalesce("verdict", F.lit("ok")).alias("status"))
    extra = b.join(verdict.where("verdict = 'extra'"), ["file", "slot"]).select("id", "file", "offset", "length", "sha256", F.col("verdict").alias("status"))
    return ours_out.unionByName(extra)


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(id, file, offset, length, sha256, status) for each record of either replica; status: ok, changed, moved, missing or extra.

    ``ours``, ``theirs``: (id, record). Offsets, lengths and hashes are ours, for extra records theirs. Records are hashed once; the manifests are written.
    """
    return audited(written(manifest(ours), "manifest"), written(manifest(theirs), "manifest"))


def audit_files(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(path, offset, length, sha256, status) for each record of two sets of WARC files, given as (path, content) with the same paths in both."""
    a, b = read_warc(ours), read_warc(theirs)
    names = ours.select("path").union(theirs.select("path")).distinct()
    paths = written(names.select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("file")), "fixity-paths")  # a row for each file
    found = audited(written(file_manifest(a, paths), "manifest"), written(file_manifest(b, paths), "manifest"))
    return found.join(paths, "file").select("path", "offset", "length", "sha256", "status")


def planted_replica(pages: DataFrame) -> DataFrame:
    """A replica of ``pages`` with faults by rule: of 97 ids one block has letters overwritten and one its url's case, at their places; of 2,048 one record is lost, which moves those
    after it in its file; of 211 one is added in files of its own."""
    k = F.col("page_id")
    changed = pages.select("page_id", F.when(F.pmod(k, F.lit(97)) == 41, F.upper("url")).otherwise(F.col("url")).alias("url"),
                           F.when(F.pmod(k, F.lit(97)) == 13, F.translate("html", ">", "]")).otherwise(F.col("html")).alias("html")).where(F.pmod(k, F.lit(2048)) != 103)
    top = pages.agg(F.max("page_id")).first()[0] or 0
    # above the largest id; where that would leave the range of ids, below zero
    added = pages.where(F.pmod(k, F.lit(211)) == 100).select((k + F.lit(top + 1) if top < 1 << 61 else -1 - F.abs(k)).alias("page_id"), "url", "html")
    return changed.unionByName(added)


FIXITY_SQL = rf"""
WITH rec AS (SELECT page_id, url, html FROM pages),
bad AS (SELECT page_id, CASE WHEN page_id % 97 = 41 THEN upper(url) ELSE url END AS url, CASE WHEN page_id % 97 = 13 THEN translate(html, '>', ']') ELSE html END AS html
        FROM rec WHERE page_id % 2048 <> 103
        UNION ALL SELECT page_id + (SELECT max(page_id) + 1 FROM rec), url, html FROM rec WHERE page_id % 211 = 100),
a AS (SELECT page_id AS id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
        || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM rec),
b AS (SELECT page_id AS id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
        || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM bad),
ma AS (SELECT id, id // {FILE_RECORDS} AS file, strlen(record)::BIGINT AS length, sha256(record) AS sha256 FROM a),
mb AS (SELECT id, id // {FILE_RECORDS} AS file, strlen(record)::BIGINT AS length, sha256(record) AS sha256 FROM b),
oa AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM ma),
ob AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM mb)
SELECT oa.id, oa.file, oa."offset", oa.length, oa.sha256, CASE WHEN ob.id IS NULL THEN 'missing' WHEN oa.sha256 <> ob.sha256 THEN 'changed' WHEN oa."offset" <> ob."offset" THEN 'moved' ELSE 'ok' END AS status FROM oa LEFT JOIN ob ON oa.id = ob.id
UNION ALL SELECT ob.id, ob.file, ob."offset", ob.length, ob.sha256, 'extra' FROM ob ANTI JOIN oa ON oa.id = ob.id
"""
