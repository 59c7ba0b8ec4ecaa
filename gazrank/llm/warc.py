"""WARC derivatives: linked metadata and plain-text conversion records of responses.

For each response record two records are made: ``conversion`` (the payload as
plain text) and ``metadata`` (``application/warc-fields``: the source record's
own WARC headers and digests, its HTTP status and headers, the outlinks). Both
name the response in ``WARC-Refers-To`` and keep its target URI and date; the
conversion's id is in the metadata and the other way round.

Scale: one pass, no shuffle; a response's records are made where it is read,
and a task holds one bounded chunk of payloads.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import texts as X

VERSION = "WARC/1.1"
CRLF = "\r\n"
#: Elements whose content is no text, and elements that end a line.
SILENT = ("script", "style", "title", "noscript", "template", "textarea", "svg")
BLOCK = ("address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure",
         "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "option", "p",
         "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul")

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_SILENT = re.compile(rf"<({'|'.join(SILENT)})\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BLOCK = re.compile(rf"</?(?:{'|'.join(BLOCK)})\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!?][^<>]*(?:>|\Z)")
_TITLE = re.compile(r"<title\b[^<>]*>([^<]*)</title\s*>", re.S | re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
_META = re.compile(r"<meta\b[^<>]*?\bcharset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
_LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLANK = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")


def plain_text(markup: str) -> str:
    """Text of a page: block elements end lines, runs of blanks are one space, empty lines go."""
    text = _COMMENT.sub("", markup)
    text = _SILENT.sub("\n", text)
    text = _BLANK.sub(" ", text.replace("\n", " ").replace("\r", " "))
    text = _TAG.sub("", _BLOCK.sub("\n", text))
    return _LINES.sub("\n", _BLANK.sub(" ", html.unescape(text))).strip(" \n")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, source: str) -> str:
    """A name-based id: the same source gives the same id on every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {source}')}>"


def one_line(value: str) -> str:
    """Header values hold no line ends."""
    return " ".join(value.split())


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return CRLF.join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response; a block without a status line is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1" if not _is_utf8(head) else "utf-8").split(CRLF)
    fields = [x.partition(":") for x in lines]
    return status, [(k.strip(), v.strip()) for k, _, v in fields], payload


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def decoded(payload: bytes, fields: list[tuple[str, str]]) -> str:
    """The payload as text: by a byte order mark, the charset of the HTTP header, that of a ``meta`` element, else UTF-8.

    An unknown charset counts as UTF-8; bytes that it does not have become replacement characters.
    """
    marks = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
    kind = next((v for k, v in fields if k.lower() == "content-type"), "")
    named = _CHARSET.search(kind) or _META.search(payload[:4096].decode("latin-1"))
    name = next((n for mark, n in marks if payload.startswith(mark)), named[1] if named else "utf-8")
    try:
        return payload.decode(name, "replace")
    except (LookupError, UnicodeError):
        return payload.decode("utf-8", "replace")


def derive(source_id: str, uri: str, date: str, block: bytes, headers: dict | None = None) -> dict:
    """The two records of one response, with the fields that link them.

    ``headers``: the response record's own WARC headers, kept in the metadata record under ``source-``; those that are
    not given are made from the record. Digests are of the response's bytes.
    """
    status, fields, payload = parse_http(block)
    markup = decoded(payload, fields)
    text = plain_text(markup)
    body = text.encode("utf-8", "replace")
    ids = {k: record_id(k, source_id) for k in ("conversion", "metadata")}
    digests = {"block": digest(block), "payload": digest(payload)}
    title = _TITLE.search(markup)
    links = [html.unescape(a or b or c) for a, b, c in _LINK.findall(markup)]
    own = {"WARC-Record-ID": source_id, "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Block-Digest": digests["block"],
           "WARC-Payload-Digest": digests["payload"], "Content-Length": str(len(block))}
    given = {one_line(k): v or "" for k, v in (headers or {}).items() if one_line(k)}
    taken = {k.lower() for k in given}
    about = [(f"source-{k}", v) for k, v in own.items() if k.lower() not in taken]
    about += [(f"source-{k}", v) for k, v in sorted(given.items())] + [("http-status", status)]
    about += [(f"http-header-{k.lower()}", v) for k, v in fields]
    about += [("conversion-WARC-Record-ID", ids["conversion"]), ("conversion-Block-Digest", digest(body)),
              ("title", html.unescape(title[1]) if title else "")]
    about += [("outlink", x) for x in links]
    meta = "".join(f"{k}: {one_line(v)}{CRLF}" for k, v in about).encode("utf-8", "replace")
    shared = [("WARC-Target-URI", one_line(uri)), ("WARC-Date", one_line(date)), ("WARC-Refers-To", source_id)]
    return {
        "conversion_id": ids["conversion"], "metadata_id": ids["metadata"], "refers_to": source_id,
        "source_block_digest": digests["block"], "source_payload_digest": digests["payload"],
        "text": text, "text_digest": digest(body), "metadata": meta.decode(), "n_links": len(links),
        "conversion_record": record([("WARC-Type", "conversion"), ("WARC-Record-ID", ids["conversion"]), *shared,
                                     ("Content-Type", "text/plain; charset=utf-8"), ("WARC-Block-Digest", digest(body))], body),
        "metadata_record": record([("WARC-Type", "metadata"), ("WARC-Record-ID", ids["metadata"]), *shared,
                                   ("WARC-Concurrent-To", ids["conversion"]), ("Content-Type", "application/warc-fields"),
                                   ("WARC-Block-Digest", digest(meta))], meta)}


FIELDS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("conversion_id", "metadata_id", "refers_to", "source_block_digest",
                                                "source_payload_digest", "text", "text_digest", "metadata")]
    + [T.StructField("n_links", T.LongType())]
    + [T.StructField(c, T.BinaryType()) for c in ("conversion_record", "metadata_record")])
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}


def responses(pages: DataFrame, date: Column, id_col: str = "page_id", url: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as response records: ``record_id``, ``target_uri``, ``date``, ``http_block``.

    The id is made of the page's id and url; a null url is an empty one, a null page an empty payload.
    """
    uri, body = F.coalesce(F.col(url), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    name = F.md5(F.concat_ws(" ", F.lit("response"), F.col(id_col).cast("string"), uri))
    dashed = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col(id_col).alias("source_key"), F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")).alias("record_id"),
                        uri.alias("target_uri"), date.cast("string").alias("date"), F.concat(head, body).alias("http_block"))


def derivatives(source: DataFrame, keep: list[str] | None = None, fields: list[str] | None = None,
                headers: str | None = None) -> DataFrame:
    """Columns ``keep`` (default: all of the source) plus ``fields`` (default: all of ``FIELDS``).

    ``source`` has ``record_id``, ``target_uri``, ``date``, ``http_block`` (bytes, or a string as UTF-8); ``headers``
    names a map column of the records' other WARC headers (address, truncation, profile ...), which are kept.

    * null values are read as empty strings; an empty payload gives records with an empty text.
    * payloads are read by their charset (:func:`decoded`); a very long one is a chunk of its own.
    * a block that does not begin with ``HTTP/`` is all payload.
    * repeated responses give the same records again, one pair for each row.
    * an empty table gives an empty table; kept columns named like the new ones are replaced.
    """
    chosen = [f for f in FIELDS if fields is None or f.name in fields]
    taken = {f.name.lower() for f in chosen}
    kept = [c for c in (source.columns if keep is None else keep) if c.lower() not in taken]
    needs = ("record_id", "target_uri", "date", "http_block")
    more = F.col(headers) if headers else F.lit(None).cast("map<string,string>")
    block = F.coalesce(F.col("http_block").cast("binary"), F.lit("").cast("binary"))
    at = source.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)],
                       *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"s{i}") for i, c in enumerate(needs[:3])],
                       block.alias("s3"), more.cast("map<string,string>").alias("s4"))
    schema = T.StructType(at.schema.fields[:len(kept)] + [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(chosen)])
    names, n = schema.fieldNames(), len(kept)
    wanted = [(f.name, f.dataType.simpleString()) for f in chosen]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.chunks(batch, n + 3):
                made = [derive(*row[:4], dict(row[4] or ())) for row in zip(*[part.column(n + i).to_pylist() for i in range(5)], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:n], *[pa.array([m[c] for m in made], _ARROW[kind]) for c, kind in wanted]], names=names)

    return at.mapInArrow(run, schema).toDF(*kept, *[c for c, _ in wanted])


def write_warc(made: DataFrame, path: str) -> None:
    """Gzipped WARC files of whole records, metadata before conversion; needs the two record columns."""
    records = made.select(F.explode(F.array("metadata_record", "conversion_record")).alias("b")).select(
        F.col("b").cast("string").alias("r"))
    # Every record ends with two line ends; the writer puts them.
    records.select(F.expr("left(r, length(r) - 4)").alias("value")).write.option(
        "lineSep", CRLF * 2).option("compression", "gzip").text(path)
