"""WARC archives: written by Spark's text sink, read back by boundary-chain verification.

Writing. A record is one line of a text file whose lines end with the two line breaks that end a WARC record. Of pages
with equal payloads the one with the largest id is a response, the others are revisits that name it and carry the HTTP
head alone. Payloads are compared by their SHA-256 and length.

Reading. The record magic is the line separator, so splits of large files are read in parallel and each task emits a
candidate for every magic it meets: its offset and that of its successor. A magic inside a payload gives a false
candidate. Each split follows its own chains first; then pointer jumping from the start of each file, over splits,
retains the reachable records only. Records whose payload holds a magic arrive in several pieces; these few are put
together in a second scan.

At scale: no payload is shuffled but those of pages that occur more than once (found by a filter whose size is checked) and
those in pieces; a file may be of any size, and the rounds grow with the logarithm of the splits of a file.

Edge cases: null html is an empty payload; a null id is written as such and comes back as null, as the smallest id; of
repeated rows (same id, same payload) one is the response, each keeps its url; control characters of a url become blanks; an empty table
gives no records; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import key_filter, new_path, stored, with_maybe

MAGIC = b"WARC/1.0\r\n"
BREAK = "\r\n"
END = b"\r\n\r\n"
#: Stands for a null id: before every other one.
NO_ID = -(2**63)
RECORDS_PER_FILE = 20_000
#: Pieces of records that are handed on together.
PIECES_AT_ONCE = 256


def base32(sha1_hex: Column) -> Column:
    """The base32 text of a SHA-1 in hex: twenty bits at a time, digits then replaced by the alphabet."""
    fours = [F.lpad(F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fours), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: Column, page: Column, nth: Column, url: Column, body: Column, size: Column, sha1: Column, refers: Column, date: str) -> Column:
    """The text of one record without the line breaks that end it."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), size.cast("string"), F.lit(BREAK * 2))
    block = F.concat(http, F.when(kind == "response", body).otherwise(""))
    name = lambda c: F.when(c == NO_ID, F.lit("null")).otherwise(c.cast("string"))
    profile = "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest" + BREAK
    return F.concat(
        F.lit(MAGIC.decode() + "WARC-Type: "), kind, F.lit(f"{BREAK}WARC-Record-ID: <urn:x-page:"), name(page), F.lit(":"), nth.cast("string"),
        F.lit(f">{BREAK}WARC-Date: {date}{BREAK}WARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x1F\x7F]", " "), F.lit(BREAK),
        F.when(kind == "revisit", F.concat(F.lit(profile + "WARC-Refers-To: <urn:x-page:"), name(refers), F.lit(f":1>{BREAK}"))).otherwise(""),
        F.lit("WARC-Payload-Digest: sha1:"), base32(sha1), F.lit(f"{BREAK}Content-Type: application/http; msgtype=response{BREAK}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(BREAK * 2), block,
    )


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 0, date: str = "2024-01-01T00:00:00Z"
) -> None:
    """Writes a record for each row to the folder path. revisit_from: smaller payloads are never revisits."""
    rows = pages.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    )
    whole = F.sha2("html", 256)
    digests = stored(rows.select("page", F.unhex(whole).alias("sha"), F.octet_length("html").alias("size")), "warc-digests")
    groups = digests.filter(F.col("size") >= revisit_from).groupBy("sha").agg(F.max("page").alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = stored(groups, "warc-groups")
    members = digests.join(groups, "sha").select("page")
    marked = with_maybe(rows, F.col("page"), key_filter(members, "page"))
    alone = marked.filter("not _maybe").withColumns({"kind": F.lit("response"), "nth": F.lit(1), "first": F.lit(None).cast("long")})
    doubt = marked.filter("_maybe").withColumn("sha", F.unhex(whole)).join(groups, "sha", "left")
    first = F.col("page") == F.col("first")
    response = F.col("first").isNull()
    others = doubt.filter(response | ~first).withColumns({"kind": F.when(response, "response").otherwise("revisit"), "nth": F.lit(1)})
    # the rows of the page that others revisit, with their own urls; where there are several, the further ones revisit
    # the first. A page may be that of several payloads, hence the sha among the keys
    own = ["page", "first", "sha"]
    kept = doubt.filter(first).groupBy(*own, "url").agg(F.min("html").alias("html"), F.count("*").alias("times"))
    before = Window.partitionBy(own).orderBy("url").rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumn("before", F.coalesce(F.sum("times").over(before), F.lit(0)))
    nth = F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("times"))).alias("nth")
    kept = kept.select("page", "first", "url", "html", nth)
    kept = kept.withColumn("kind", F.when(F.col("nth") == 1, "response").otherwise("revisit"))
    columns = ["page", "url", "html", "kind", "nth", "first"]
    every = alone.select(columns).unionByName(others.select(columns)).unionByName(kept.select(columns))
    text = _record(F.col("kind"), F.col("page"), F.col("nth"), F.col("url"), F.col("html"), F.octet_length("html"), F.sha1("html"), F.col("first"), date)
    every.select(text.alias("value")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_PAGE = re.compile(rb"<urn:x-page:(-?\d+|null):\d+>")
PIECE_ARROW = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("local", pa.int64()), ("size", pa.int64()), ("span", pa.int64()), ("kind", pa.string()), ("page", pa.int64()),
    ("refers", pa.int64()), ("bytes", pa.int64()), ("digest", pa.string()), ("whole", pa.bool_()),
])
PIECE_SCHEMA = "file string, block long, local long, size long, span long, kind string, page long, refers long, bytes long, digest string, whole boolean"


def _head(piece: bytes) -> tuple[int, dict[bytes, bytes]] | None:
    """The length of a record's head after the magic, and its fields; None if there is none."""
    end = piece.find(END)
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    if not fields.get(b"content-length", b"").isdigit() or b"warc-type" not in fields:
        return None
    return end + len(END), fields


def _page(value: bytes) -> int | None:
    found = _PAGE.fullmatch(value)
    return None if not found else NO_ID if found[1] == b"null" else int(found[1])


def _described(piece: bytes) -> tuple:
    """span, kind, page, refers, bytes, digest, whole of a piece that follows a magic; span is None for no record."""
    if (head := _head(piece)) is None:
        return (None,) * 6 + (False,)
    length, fields = head
    size = int(fields[b"content-length"])
    kind = fields[b"warc-type"].decode("latin-1")
    block = piece[length : length + size]
    whole = piece[length + size : length + size + 4] == END
    http = block.find(END)
    payload = block[http + 4 :] if http >= 0 else block
    bytes_, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if kind == "revisit":
        said = re.search(rb"(?mi)^content-length:\s*(\d+)", block)
        bytes_, digest = int(said[1]) if said else 0, fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:")
    span = length + size + len(END) + len(MAGIC)
    return span, kind, _page(fields.get(b"warc-record-id", b"")), _page(fields.get(b"warc-refers-to", b"")), bytes_, digest, whole


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, block, local, piece): local counts from the first piece of a split, in bytes."""
    at, local = None, 0
    for batch in batches:
        for value, file, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if at != (file, block):
                at, local = (file, block), 0
            yield file, block, local, value
            local += len(value) + len(MAGIC)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for file, block, local, piece in _located(batches):
        rows.append((file, block, local, len(piece) + len(MAGIC), *_described(piece)))
        if len(rows) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECE_ARROW, strict=True)], schema=PIECE_ARROW)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECE_ARROW, strict=True)], schema=PIECE_ARROW)


def _exits(split: pa.Table) -> pa.Table:
    """Where the chain from each candidate of a split leaves the split."""
    split = split.sort_by("pos")
    pos, succ = split.column("pos").to_numpy(), split.column("succ").to_numpy()
    inside = np.searchsorted(pos, succ)
    out = succ.copy()
    for i in range(len(pos) - 1, -1, -1):
        j = inside[i]
        if j < len(pos) and pos[j] == succ[i]:
            out[i] = out[j]
    return pa.table({"file": split.column("file"), "pos": pos, "leave": out})


def _marked(split: pa.Table) -> pa.Table:
    """Whether each candidate of a split is on the chain from its entry, and the record each piece belongs to."""
    split = split.sort_by("pos")
    pos, succ, entry = (split.column(c).to_numpy(zero_copy_only=False) for c in ("pos", "succ", "entry"))
    on = entry.astype(bool).copy()
    inside = np.searchsorted(pos, succ)
    for i in range(len(pos)):
        j = inside[i]
        if on[i] and j < len(pos) and pos[j] == succ[i]:
            on[j] = True
    return split.select(["file", "block", "local", "pos", "succ", "kind", "page", "refers", "bytes", "digest", "whole"]).append_column("real", pa.array(on))


def reachable(pieces: DataFrame) -> DataFrame:
    """Candidates with their place in the file and whether the chain from the start of the file reaches them."""
    splits = pieces.groupBy("file", "block").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    found = pieces.join(splits, ["file", "block"]).withColumn("pos", F.col("base") + F.col("local")).withColumn("succ", F.coalesce(F.col("pos") + F.col("span"), F.lit(-1)))
    found = stored(found.drop("base", "size", "span"), "warc-candidates")
    records = found.filter("succ >= 0").select("file", "block", "pos", "succ")
    # a row for each record, small on disk and large in memory: never to be broadcast, hence the hints
    jumps = stored(records.groupBy("file", "block").applyInArrow(_exits, "file string, pos long, leave long"), "warc-jumps")
    entries = stored(jumps.filter(F.col("pos") == len(MAGIC)).select("file", "pos"), "warc-entries")
    while True:
        on = entries.join(jumps.hint("merge"), ["file", "pos"]).select("file", F.col("leave").alias("pos"))
        on = on.join(jumps.select("file", "pos").hint("merge"), ["file", "pos"], "left_semi").join(entries, ["file", "pos"], "left_anti").distinct()
        on = stored(on, "warc-reached")
        if on.isEmpty():
            break
        entries = stored(entries.unionByName(on), "warc-entries")
        onward = jumps.select("file", F.col("pos").alias("leave"), F.col("leave").alias("further"))
        jumps = stored(jumps.join(onward.hint("merge"), ["file", "leave"], "left").select("file", "pos", F.coalesce("further", "leave").alias("leave")), "warc-jumps")
    start = found.join(entries.withColumn("entry", F.lit(True)), ["file", "pos"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    schema = "file string, block long, local long, pos long, succ long, kind string, page long, refers long, bytes long, digest string, whole boolean, real boolean"
    return start.groupBy("file", "block").applyInArrow(_marked, schema)


def _together(parts: pa.Table) -> pa.Table:
    """The record whose pieces these are."""
    rows = sorted(zip(parts.column("pos").to_pylist(), parts.column("value").to_pylist(), strict=True))
    found = _described(MAGIC.join(v for _, v in rows))
    return pa.table({k: pa.array([v], t) for k, v, t in zip(("kind", "page", "refers", "bytes", "digest"), found[1:6], (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)})


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    lines = _lines(spark, path)
    pieces = stored(lines.mapInArrow(_candidates, PIECE_SCHEMA), "warc-pieces")
    found = stored(reachable(pieces), "warc-found")
    columns = ["kind", "page", "refers", "bytes", "digest"]
    out = found.filter("real and whole").select(columns)
    broken = found.filter("real and not whole").select("file", F.col("pos").alias("owner"), F.col("succ").alias("stop"))
    if not broken.isEmpty():  # pieces of records that hold a magic: read again, by their place
        order = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        owned = found.withColumn("owner", F.last(F.when(F.col("real"), F.col("pos")), ignorenulls=True).over(order))
        owned = owned.join(broken, ["file", "owner"]).filter(F.col("pos") < F.col("stop")).select("file", "block", "local", "pos", "owner")
        owned = stored(owned, "warc-owned")
        place = F.xxhash64("file", "block", "local")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            located = _located(batches)
            while rows := list(islice(located, PIECES_AT_ONCE)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "block", "local", "value"])

        again = lines.mapInArrow(run, "file string, block long, local long, value binary").withColumn("_place", place)
        again = with_maybe(again, F.col("_place"), key_filter(owned.withColumn("_place", place), "_place")).filter("_maybe")
        parts = again.join(owned, ["file", "block", "local"]).select("file", "owner", "pos", "value")
        out = out.unionByName(parts.groupBy("file", "owner").applyInArrow(_together, "kind string, page long, refers long, bytes long, digest string"))
    as_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(
        as_id("page").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), as_id("refers").alias("refers_to")
    )


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages and reads the archives back."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path)
