"""WARC derivatives: responses become linked metadata and plain-text conversion records.

For each response record two records are built. The metadata record holds, as
JSON, the source record's headers and the HTTP status line and headers (as pairs
in their order, repeated ones too), and the page's title, language, encoding and
links. The conversion record holds the
page's text: no scripts, styles or markup, character references resolved, block
elements on lines of their own. Both name the response in WARC-Refers-To, keep
its target, date and payload digest, and carry a digest of their own block; the
identifiers are made from the source's, so a second run gives the same records.

Bodies lose their chunks and their gzip or deflate coding first. Pages (HTML, or
no content type) and other ``text/`` bodies have a conversion record; a body of
any other type, or in a coding that isn't known, has a metadata record alone.
The encoding is that of a byte order mark, else of the HTTP header, else of a
meta element in the first 1,024 bytes, else UTF-8.

Each response is its own unit: one pass, no shuffle, an executor's loss repeats
its partition. Parsing is linear in the page (one scan with one pattern).

Edge cases: a null page is an empty one and a null URL an empty target; markup
that isn't closed runs to the end of the page; bytes outside the encoding are
replaced; a body that isn't in the coding its headers name is taken as it is, a
stream that ends early as far as it goes; rows that repeat an id give records with equal identifiers; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

VERSION = "WARC/1.1"
CRAWL_DATE = "2024-01-01T00:00:00Z"

#: Elements whose content isn't text, and elements that stand on lines of their own.
HIDDEN = ("noscript", "template", "iframe")
BLOCK = (
    "address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul"
).split()

#: Attributes that hold a link, by element.
LINKS = {
    "a": ("href",), "area": ("href",), "link": ("href",), "base": ("href",), "img": ("src", "srcset"), "source": ("src", "srcset"),
    "script": ("src",), "iframe": ("src",), "frame": ("src",), "embed": ("src",), "audio": ("src",), "video": ("src", "poster"),
    "track": ("src",), "input": ("src",), "form": ("action",), "object": ("data",), "blockquote": ("cite",), "q": ("cite",),
}
#: Elements whose content is raw text, in which nothing is markup; the other hidden ones hold markup.
RAW = ("script", "style", "textarea")

# attributes of a tag; a quoted value may hold ">", a quote that isn't closed is an ordinary character
_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+"""
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})\b(?P<rattrs>{_ATTRS})>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>{_ATTRS})(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_BLOCKS = frozenset(BLOCK)
_CHUNK = re.compile(rb"(?:\r?\n)?([0-9A-Fa-f]{1,8})[ \t]*(?:;[^\r\n]*)?\r?\n")
_CANDIDATE = re.compile(r"[\s,]*([^\s]+)")

#: Byte order marks, and the names that mean Windows code page 1252 in pages.
MARKS = {b"\xef\xbb\xbf": "utf-8", b"\xfe\xff": "utf-16-be", b"\xff\xfe": "utf-16-le"}
WINDOWS = dict.fromkeys(("iso-8859-1", "iso8859-1", "latin1", "latin-1", "ascii", "us-ascii", "windows-1252"), "cp1252")
PAGES = ("", "text/html", "application/xhtml+xml")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(parts))}>"


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def page_response(page_id: int | None, url: str | None, page: str | None, date: str = CRAWL_DATE) -> tuple[list[tuple[str, str]], bytes]:
    """A crawled page as a response record: its headers and block."""
    url, body = re.sub(r"[\r\n]+", " ", url or ""), (page or "").encode()
    block = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    )
    headers = [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), url)),
        ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Payload-Digest", digest(body)),
        ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return headers, block


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, body) of an HTTP response."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", [], block
    lines = head.decode("latin-1").split("\r\n")
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])], body


def unchunked(body: bytes) -> bytes:
    """A body in chunks (RFC 9112, 7.1) put together; one that doesn't start with a chunk as it is."""
    out, at = [], 0
    while m := _CHUNK.match(body, at):
        size = int(m[1], 16)
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size
        if not size or at >= len(body):
            return b"".join(out)
    return b"".join(out) if out else body


def inflated(body: bytes, coding: str) -> bytes | None:
    """A gzip or deflate body unpacked, all members of it; None for another coding."""
    if coding not in ("gzip", "x-gzip", "deflate"):
        return None
    out, rest = [], body
    for kind in (47, -15) if coding == "deflate" else (47,):  # deflate without the zlib header is common
        try:
            while rest:
                unpack = zlib.decompressobj(kind)
                out.append(unpack.decompress(rest) + unpack.flush())
                if rest is body and kind == 47 and not unpack.eof and not out[-1]:
                    break
                rest = unpack.unused_data
        except zlib.error:
            pass
        if b"".join(out):
            return b"".join(out)
        out = []
    return body


def entity(http: list[tuple[str, str]], body: bytes) -> tuple[bytes | None, str]:
    """(body without transfer and content codings, or None; media type, in small letters)."""
    values = lambda name: [x.strip().lower() for k, v in http if k.lower() == name for x in v.split(",")]
    if "chunked" in values("transfer-encoding"):
        body = unchunked(body)
    for coding in reversed([c for c in values("transfer-encoding") + values("content-encoding") if c not in ("", "identity", "chunked")]):
        body = inflated(body, coding)
        if body is None:
            break
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    return body, kind.partition(";")[0].strip().lower()


def charset_of(http: list[tuple[str, str]], body: bytes, page: bool) -> str:
    """Name of the encoding: byte order mark, header, meta element of a page, UTF-8."""
    for mark, name in MARKS.items():
        if body.startswith(mark):
            return name
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    found = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind, re.I)
    if not found and page:
        found = re.search(rb"<meta\b[^>]*?\bcharset\s*=\s*[\"']?([\w.:-]+)", body[:1024], re.I)
    name = (found[1].decode() if found and isinstance(found[1], bytes) else found[1] if found else "utf-8").lower()
    return WINDOWS.get(name, name)


def decoded(body: bytes, charset: str) -> str:
    try:
        text = body.decode(charset, "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    return text.removeprefix("\ufeff")


def srcset(value: str) -> Iterator[str]:
    """URLs of a srcset: each runs to white space; commas end a candidate only after its URL and outside of brackets."""
    at = 0
    while m := _CANDIDATE.match(value, at):
        at, url = m.end(), m[1]
        if url.endswith(","):
            url = url.rstrip(",")
        else:
            depth = 0
            while at < len(value) and (value[at] != "," or depth):
                depth = max(0, depth + (value[at] == "(") - (value[at] == ")"))
                at += 1
        if url:
            yield url


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


def _links(tag: str, got: dict[str, str]) -> Iterator[dict]:
    for key in LINKS.get(tag, ()):
        if value := got.get(key, "").strip():
            parts = srcset(value) if key == "srcset" else [value]
            yield from ({"path": f"{tag}@/{key}", "url": p} for p in parts)


def read_page(page: str) -> dict:
    """text, title, lang and links of a page; links also from elements whose content isn't text."""
    parts: list[str] = []
    title, lang, links, at, title_at, inside = None, "", [], 0, None, []
    for m in _MARKUP.finditer(page):
        if not inside:
            parts.append(page[at : m.start()])
        at = m.end()
        if m["raw"]:
            links += _links(m["raw"].lower(), attributes(m["rattrs"]))
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in HIDDEN:
            if not m["close"]:
                links += _links(tag, attributes(m["attrs"]))
                inside.append(tag)
            elif tag in inside:
                del inside[inside.index(tag) :]
            continue
        if tag in _BLOCKS and not inside:
            parts.append("\0")  # a line break, told apart from those of the source
        if m["close"]:
            if tag == "title" and title_at is not None and title is None:
                title = "".join(parts[title_at:])
        elif tag == "title":
            title_at = len(parts)
        elif tag == "html" or tag in LINKS:
            got = attributes(m["attrs"])
            if tag == "html":
                lang = lang or got.get("lang", "")
            links += _links(tag, got)
    if not inside:
        parts.append(page[at:])
    tidy = lambda s: " ".join(html.unescape(s.replace("\0", " ")).split())
    lines = [" ".join(html.unescape(x).split()) for x in "".join(parts).split("\0")]
    return {"text": "\n".join(x for x in lines if x), "title": tidy(title or ""), "lang": lang, "links": links}


def derive(headers: list[tuple[str, str]], block: bytes) -> list[tuple[str, list[tuple[str, str]], bytes, dict]]:
    """(type, headers, block, facts) of a response's metadata record, and of its conversion record if it is text."""
    source = {k.lower(): v for k, v in headers}
    status, http, body = split_http(block)
    plain, kind = entity(http, body)
    page = kind in PAGES
    charset = charset_of(http, plain or b"", page)
    facts = {"text": None, "title": "", "lang": "", "links": []}
    if plain is not None and page:
        facts = read_page(decoded(plain, charset))
    elif plain is not None and kind.startswith("text/"):
        facts["text"] = decoded(plain, charset)
    origin = source.get("warc-record-id", "")
    payload = source.get("warc-payload-digest") or digest(body)
    meta = json.dumps(
        {
            "source": headers, "payload-digest": payload, "http": {"status": status, "headers": http},
            "html": {"title": facts["title"], "lang": facts["lang"], "charset": charset, "links": facts["links"]},
        },
        ensure_ascii=False, sort_keys=True,
    ).encode()
    out = []
    for what, content, data in (
        ("metadata", "application/json", meta),
        ("conversion", "text/plain; charset=utf-8", facts["text"]),
    ):
        if data is None:
            continue
        data = data if what == "metadata" else data.encode()
        own = [
            ("WARC-Type", what), ("WARC-Record-ID", record_id(what, origin)), ("WARC-Refers-To", origin),
            ("WARC-Target-URI", source.get("warc-target-uri", "")), ("WARC-Date", source.get("warc-date", "")),
            ("WARC-Refers-To-Payload-Digest", payload), ("WARC-Block-Digest", digest(data)),
        ]
        own += [(k, v) for k, v in headers if k.lower() in KEPT]
        if what == "conversion" and facts["lang"]:
            own.append(("WARC-Identified-Content-Language", facts["lang"]))
        own += [("Content-Type", content), ("Content-Length", str(len(data)))]
        out.append((what, own, data, facts))
    return out


def parse_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record of a WARC file, gzipped by record or as a whole or not; unpacked as it is read."""
    f = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        f = io.BufferedReader(gzip.GzipFile(fileobj=f), 1 << 20)
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = []
        while (line := f.readline().rstrip(b"\r\n")):
            if line[:1] in b" \t" and headers:  # a folded line goes on with the header before
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.decode('utf-8', 'replace').strip()}")
                continue
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers.append((k.strip(), v.strip()))
        length = next((int(v) for k, v in headers if k.lower() == "content-length" and v.isdigit()), 0)
        yield headers, f.read(length)


#: Headers of the response that both records keep, as often as they stand there.
KEPT = ("warc-ip-address", "warc-warcinfo-id", "warc-truncated", "warc-concurrent-to")
OUT = (
    "page_id long, record_type string, record_id string, refers_to string, target_uri string, source_digest string, "
    "block_digest string, content_length long, n_links long, title string, record_sha256 string, record binary"
)


def _rows(page_id, headers, block) -> Iterator[tuple]:
    for what, own, data, facts in derive(headers, block):
        h = dict(own)
        record = record_bytes(own, data)
        yield (
            page_id, what, h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Target-URI"], h["WARC-Refers-To-Payload-Digest"],
            h["WARC-Block-Digest"], len(data), len(facts["links"]), facts["title"], hashlib.sha256(record).hexdigest(), record,
        )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in OUT.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _from_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[tuple] = []
        for i, url, page in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            rows += _rows(i, *page_response(i, url, page))
        yield _batch(rows)


def _from_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data in b.column(0):
            rows: list[tuple] = []
            for headers, block in parse_records(data.as_py()):
                if any(k.lower() == "warc-type" and v == "response" for k, v in headers):
                    rows += _rows(None, headers, block)
                if len(rows) >= 500:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)


def derive_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html): both derived records of each page's response, with the record's bytes."""
    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_from_pages, OUT)


def derive_files(spark: SparkSession, path: str) -> DataFrame:
    """The same from the response records of WARC files; a task holds one file as it is packed (2 GB at most) and one record."""
    small_batches(spark, 1)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_from_files, OUT)


def write_warc(records: DataFrame, folder: str, compress: bool = True) -> None:
    """One WARC file for each partition of records(record), through the file system that the folder's URI names."""
    def write(rows) -> None:
        from pyarrow import fs
        from pyspark import TaskContext

        at = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/part-{at.partitionId():05d}.warc" + (".gz" if compress else "")
        temp = f"{name}.{at.taskAttemptId()}.tmp"  # a lost task leaves no half file under the final name
        with store.open_output_stream(temp) as out:
            for r in rows:
                out.write(gzip.compress(r["record"], mtime=0) if compress else bytes(r["record"]))
        store.move(temp, name)

    records.select("record").foreachPartition(write)


def derived_digests(pages: DataFrame) -> DataFrame:
    """The query's columns: everything but the bytes, of which it gives the hash."""
    return derive_pages(pages).drop("record")
