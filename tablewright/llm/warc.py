"""WARC derivative builder: metadata and plain-text conversion records for response records.

A response is an HTTP message (status line, headers, blank line, payload). For each one come a
``metadata`` record (application/warc-fields: the source's status and headers, its digests, title,
links) and a ``conversion`` record (text/plain). Both name the response in WARC-Refers-To, keep its
target and date, and carry block digests of their own. Record ids are name-based UUIDs, so a task
that runs again makes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.llm.common import blocks

DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6f1b4c1e-58d4-5a37-9a10-2b8f3f1b7c55")

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<head\b.*?(?:</head\s*>|(?=<body\b)|\Z)", re.S | re.I)
_BREAK = re.compile(r"<(?:br|/?(?:p|div|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|blockquote|pre|main|aside|form|dd|dt|hr))\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!?][^>]*>")
_BLANKS, _LINES = re.compile(r"[^\S\n]{2,}|[^\S\n ]"), re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LINK = re.compile(r"""<a\s[^>]*?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join((kind, *names)))}>"


def plain_text(page: str) -> str:
    """The visible text of a page: a line for each block element, entities decoded, blanks collapsed."""
    page = _BLANKS.sub(" ", _HIDDEN.sub(" ", page).replace("\n", " "))
    page = html.unescape(_TAG.sub("", _BREAK.sub("\n", page)))
    return _LINES.sub("\n", _BLANKS.sub(" ", page)).strip()


def response(url: str, payload: bytes, date: str = DATE, status: str = "HTTP/1.1 200 OK", headers: tuple = ()) -> dict:
    """A response record for a page that has no HTTP headers of its own."""
    lines = [status, *(f"{k}: {v}" for k, v in headers or (("Content-Type", "text/html; charset=UTF-8"), ("Content-Length", str(len(payload)))))]
    block = "\r\n".join(lines).encode() + b"\r\n\r\n" + payload
    return {"id": record_id("response", url, date, digest(payload)), "url": url, "date": date, "block": block}


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP message; a block without them is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    headers = [(k.strip(), v.strip()) for k, colon, v in (x.partition(":") for x in lines) if colon]
    return status, headers, payload


def _clean(value: str) -> str:
    return " ".join(value.split())


def _decoded(headers: list[tuple[str, str]], payload: bytes) -> str:
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    charset = re.search(r"charset=\"?([\w.:-]+)", kind)
    try:
        return payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derivatives(source: dict) -> list[dict]:
    """The metadata and the conversion record of a response."""
    status, headers, payload = split_http(source["block"])
    page = _decoded(headers, payload)
    title = _TITLE.search(page)
    fields = [("source-status", status)] if status else []
    fields += [(f"source-header-{_clean(k).lower()}", _clean(v)) for k, v in headers]
    fields += [("source-block-digest", digest(source["block"])), ("source-payload-digest", digest(payload))]
    fields += [("title", _clean(html.unescape(title[1])))] if title else []
    fields += [("outlink", _clean(html.unescape(a or b or c))) for a, b, c in _LINK.findall(page)]
    made = []
    for kind, content_type, block in (
        ("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode()),
        ("conversion", "text/plain; charset=UTF-8", plain_text(page).encode()),
    ):
        head = [
            ("WARC-Type", kind),
            ("WARC-Record-ID", record_id(kind, source["id"], digest(block))),
            ("WARC-Date", source["date"]),
            ("WARC-Target-URI", source["url"]),
            ("WARC-Refers-To", source["id"]),
            ("WARC-Block-Digest", digest(block)),
            ("Content-Type", content_type),
            ("Content-Length", str(len(block))),
        ]
        made.append({"kind": kind, "headers": head, "block": block, "payload_digest": digest(payload), "n_outlinks": sum(k == "outlink" for k, _ in fields)})
    return made


def serialised(record: dict) -> bytes:
    """A record as it stands in a WARC file."""
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in record["headers"]).encode() + b"\r\n" + record["block"] + b"\r\n\r\n"


def parse(data: bytes) -> list[dict]:
    """Records of an uncompressed WARC file, as serialised() writes them."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"not a WARC record at byte {at}")
        headers = [tuple(x.split(": ", 1)) for x in lines]
        size = int(dict(headers)["Content-Length"])
        out.append({"kind": dict(headers)["WARC-Type"], "headers": headers, "block": data[end + 4 : end + 4 + size]})
        at = end + 4 + size + 4
    return out


def build(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Two records for every page (page_id, url, html; other columns are ignored).

    Returns page_id, warc_type, record_id, refers_to, target_uri, headers (map), block (binary), payload_digest
    and n_outlinks. A null url is an empty one, a null page an empty payload; equal pages give equal record ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "html"):
            out = []
            for page, url, text in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                source = response(_clean(url or ""), (text or "").encode("utf-8", "surrogatepass"), date)
                for r in derivatives(source):
                    head = dict(r["headers"])
                    out.append((page, r["kind"], head["WARC-Record-ID"], source["id"], source["url"], r["headers"], r["block"], r["payload_digest"], r["n_outlinks"]))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                ["page_id", "warc_type", "record_id", "refers_to", "target_uri", "headers", "block", "payload_digest", "n_outlinks"],
            )

    schema = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, headers map<string,string>, block binary, payload_digest string, n_outlinks long"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def write(records: DataFrame, path: str) -> None:
    """A column of serialised records to binary part tables; concatenating ``data`` in a part gives a WARC file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "block"):
            data = [serialised({"headers": h, "block": b}) for h, b in zip(part.column("headers").to_pylist(), part.column("block").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("record_id"), pa.array(data, pa.binary())], ["record_id", "data"])

    records.select("record_id", "headers", "block").mapInArrow(run, "record_id string, data binary").write.parquet(path)
