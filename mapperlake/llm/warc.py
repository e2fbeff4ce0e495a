"""WARC derivatives: each response record gets a metadata record (JSON) and a plain-text conversion record.

Derived records keep the response's target, date, payload digest and, in the metadata, all of its WARC and
HTTP headers; WARC-Refers-To names the response. Rows are independent: no shuffle, and no page waits for another.

Files: derived records are UTF-8 text that ends with two line ends, so Spark's text writer, with these as its line
separator, writes WARC files (gzip) to any store that it reaches and leaves nothing of a lost task. They are read by its
text reader, a file in order by one task, and put together again by Content-Length. `write` makes files with a gzip
member for each record, which can be cut and joined anywhere, in a folder that executors have mounted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage_path

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs
#: A tag without < or > in it; or what may begin another one. Nothing in it is tried twice: the first way to match is the only one.
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9]*+)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9]*+")
_SPECIAL = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
#: Numbers of characters that no page needs: without them html.unescape can't be made to read endless digits.
_ENDLESS = re.compile(r"&#(?:[xX][0-9a-fA-F]{20,}+|[0-9]{20,}+);?")
_HIDDEN = {x: re.compile(rf"</{x}\s*+>", re.I) for x in ("script", "style", "template", "noscript", "title")}
_LINE_ENDS = re.compile(r"[\r\n]+")
_CHARSET = re.compile(r"charset=([-\w]+)")
_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)")
_BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record, uncompressed. Line ends in values become blanks."""
    head = "".join([f"{k}: {_LINE_ENDS.sub(' ', v) if '\n' in v or '\r' in v else v}\r\n" for k, v in headers])
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of one record, gzip member or plain."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
    return headers, rest[: int(dict((k.lower(), v) for k, v in headers)["content-length"])]


def urn(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(31).join(parts))}>"


def response(page_id: str, url: str, html: str, date: str) -> bytes:
    """A response record around a page."""
    body = html.encode("utf-8", "replace")
    payload = digest(body)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    return record([("WARC-Type", "response"), ("WARC-Record-ID", urn("response", page_id, url, payload)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", payload), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")], block)


class Page:
    """A page's mark-up, read once from front to back: whatever its text, no part of it is searched more than a few times."""

    def __init__(self, html: str):
        self.html = html
        self.absent: set[str] = set()
        self.dead: set[int] = set()
        self.next_special = -1

    def find(self, what: str, start: int) -> int:
        """Where `what` occurs next; once it doesn't, it isn't looked for again."""
        k = self.html.find(what, start) if what not in self.absent else -1
        if k < 0:
            self.absent.add(what)
        return k

    def closing(self, name: str, start: int):
        """The next closing tag of an element whose content isn't text."""
        m = _HIDDEN[name].search(self.html, start) if "/" + name not in self.absent else None
        if not m:
            self.absent.add("/" + name)
        return m

    def tag_end(self, start: int) -> int:
        """The place behind the > that ends a tag, outside of quotes; -1 if there is none. Places from which there is none are kept."""
        html, seen = self.html, []
        if self.next_special < start:
            m = _SPECIAL.search(html, start)
            self.next_special = m.start() if m else len(html)
        at = self.next_special
        while at < len(html) and at not in self.dead:
            if html[at] == ">":
                return at + 1
            seen.append(at)
            end = self.find(html[at], at + 1)
            m = _SPECIAL.search(html, end + 1) if end >= 0 else None
            at = m.start() if m else len(html)
        self.dead.update(seen)
        return -1

    def other(self, start: int) -> tuple[int, str, str, str]:
        """The end, slash, name and attributes of what begins at `start` but isn't a plain tag; -1 if nothing does."""
        html = self.html
        if html[start + 1] in "!?":
            end = -1
            for opened, closed in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if html.startswith(opened, start) and (k := self.find(closed, start + len(opened))) >= 0:
                    end = k + len(closed)
            if end < 0 and (k := self.find(">", start + 2)) >= 0:
                end = k + 1
            return end, "", "", ""
        slash = "/" if html[start + 1] == "/" else ""
        m = _NAME.match(html, start + 1 + len(slash))
        end = self.tag_end(m.end())
        return end, slash, m[0], html[m.end() : end - 1] if end >= 0 else ""


def unescape(text: str) -> str:
    return entities.unescape(_ENDLESS.sub("\ufffd", text)) if "&" in text else text


def plain(html: str) -> tuple[str, str, list[str]]:
    """Text (a line per block, white space collapsed), title and link targets, in order. Scripts, styles and comments are left out; what only looks like mark-up stays text. Time is linear in the page's length, whatever is in it."""
    page, parts, links = Page(html), [], []
    title: str | None = None
    search, told, hiding, blocks = _TAG.search, parts.append, _HIDDEN, _BLOCKS
    at = look = 0
    while m := search(html, look):
        start, end = m.span()
        name = m[2]
        if name:
            slash, attributes = m[1], ""
        else:
            end, slash, name, attributes = page.other(start)
        name = name.lower()
        hidden = page.closing(name, start + 1) if name in hiding and not slash else None
        if name == "title":
            if hidden and title is None and end > 0:
                title = html[end : hidden.start()]
            hidden = None
        if hidden:
            end = hidden.end()
        elif end < 0:
            look = start + 1
            continue
        if at < start:
            told(html[at:start].replace("\n", " "))
        at = look = end
        if hidden:
            told(" ")
        elif name in blocks:
            told("\n")
        elif name == "a" and not slash:
            links += [unescape(x[2] or x[3] or x[4] or "") for x in _ATTRIBUTE.finditer(m[3] if m[2] else attributes) if x[1].lower() == "href"]
    told(html[at:].replace("\n", " "))
    lines = [" ".join(unescape(x).split()) for x in "".join(parts).split("\n") if x]
    return "\n".join([x for x in lines if x]), " ".join(unescape(title or "").split()), links


def derive(data: bytes, page_id: int | None = None) -> dict:
    """The metadata and conversion records (uncompressed) of a response record, and what they link."""
    headers, block = parse(data)
    of = {k.lower(): v for k, v in headers}
    head, _, body = block.partition(b"\r\n\r\n")
    status, *http = head.decode("latin-1").split("\r\n")
    fields = [[k.strip(), v.strip()] for k, _, v in (x.partition(":") for x in http)]
    charset = _CHARSET.search(" ".join(v for k, v in fields if k.lower() == "content-type"))
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    text, title, links = plain(page)
    source, found = of["warc-record-id"], digest(body)
    about = {"page_id": page_id, "envelope": {"warc": headers, "status": status, "http": fields, "payload_digest": found, "digest_matches": found == of.get("warc-payload-digest", found)}, "title": title, "links": links}
    shared = [("WARC-Date", of["warc-date"]), ("WARC-Target-URI", of["warc-target-uri"]), ("WARC-Refers-To", source), ("WARC-Source-Payload-Digest", found)]
    out = {"page_id": page_id, "response_id": source, "source_digest": found, "digest_matches": about["envelope"]["digest_matches"], "n_links": len(links), "title": title}
    for kind, mime, content in (("metadata", "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True)), ("conversion", "text/plain; charset=utf-8", text)):
        content = content.encode("utf-8", "replace")
        out[f"{kind}_id"] = urn(kind, source)
        out[f"{kind}_refers_to"] = source
        out[f"{kind}_digest"] = digest(content)
        out[f"{kind}_length"] = len(content)
        out[kind] = record([("WARC-Type", kind), ("WARC-Record-ID", out[f"{kind}_id"]), *shared, ("WARC-Block-Digest", out[f"{kind}_digest"]), ("Content-Type", mime)], content)
    return out


DERIVED = "page_id long, response_id string, source_digest string, digest_matches boolean, n_links int, title string, metadata_id string, metadata_refers_to string, metadata_digest string, metadata_length long, metadata binary, conversion_id string, conversion_refers_to string, conversion_digest string, conversion_length long, conversion binary"


#: What a derived file's records say of a page.
READ = "page_id long, response_id string, source_digest string, digest_matches boolean, n_links int, title string, metadata_id string, metadata_refers_to string, metadata_digest string, metadata_length long, conversion_id string, conversion_refers_to string, conversion_digest string, conversion_length long"
END = "\r\n\r\n"


def _table(rows: list[dict], shape: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [c.split() for c in shape.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], kinds[kind]) for name, kind in fields], [name for name, _ in fields])


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """page_id, record: a response record (gzip member) of each page, with `date` as the time of its visit (pages have none of their own). Null urls and pages count as empty; pages of any length are one record; other columns don't matter."""

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)
            yield _table([{"page_id": p, "record": gzip.compress(response(str(p), u or "", h or "", date), 1, mtime=0)} for p, u, h in rows], "page_id long, record binary")

    return _asked(pages).mapInArrow(run, "page_id long, record binary")


def _asked(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))


def derivatives(records: DataFrame) -> DataFrame:
    """DERIVED of each response record (page_id, record). Repeated records give equal derivatives; no records give none."""

    def run(batches):
        for batch in batches:
            rows = zip(batch.column("page_id").to_pylist(), batch.column("record"), strict=True)
            yield _table([derive(r.as_py(), p) for p, r in rows], DERIVED)

    return records.select("page_id", "record").mapInArrow(run, DERIVED)


def page_texts(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """value: the text of both records of `derivatives(responses(pages, date))`, the metadata first, without the line ends at their end. A page's response record goes from one to the other as it is, in one task, and isn't compressed on the way."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for p, u, h in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                told = derive(response(str(p), u or "", h or "", date), p)
                texts += [told[kind][: -len(END)].decode() for kind in ("metadata", "conversion")]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])

    return _asked(pages).mapInArrow(run, "value string")


def write_files(derived: DataFrame, path: str) -> None:
    """Write both records of each row, the metadata first, to gzip WARC files below `path`, in any store that Spark reaches."""
    both = F.array(*[F.col(kind).cast("string") for kind in ("metadata", "conversion")])
    text = F.explode(both).alias("value")
    write_texts(derived.select(text).select(F.expr(f"substring(value, 1, char_length(value) - {len(END)})").alias("value")), path)


def write_texts(texts: DataFrame, path: str) -> None:
    """Write records (value: their text without the line ends at their end) in order to gzip WARC files below `path`."""
    texts.write.option("lineSep", END).option("compression", "gzip").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """READ of each pair of records below `path`, from what the files hold: lengths and digests are those of the contents read, and digest_matches says whether they and the response's are what the headers claim."""

    def run(batches):
        import pyarrow as pa

        ends = END.encode()
        held, need, pair, file = bytearray(), 0, None, None
        for batch in batches:
            out = []
            for name, row in zip(batch.column("file").to_pylist(), batch.column("value").cast(pa.binary()).to_pylist(), strict=True):
                if name != file:
                    if held or pair:
                        raise ValueError(f"{file} ends within a record")
                    file = name
                held += row
                held += ends
                while held:
                    if not need:
                        k = held.find(ends)
                        need = k + len(END) + int(_LENGTH.search(held, 0, k)[1]) + len(END)
                    if len(held) < need:
                        break
                    headers, content = parse(bytes(held[:need]))
                    del held[:need]
                    need = 0
                    if held == ends:  # put behind a file's last row, which had none
                        held.clear()
                    of = dict(headers)
                    if of["WARC-Type"] == "metadata":
                        pair = of, content
                    else:
                        out.append(linked(*pair, of, content))
                        pair = None
            if out:
                yield _table(out, READ)
        if held or pair:
            raise ValueError(f"{file} ends within a record")

    return spark.read.option("lineSep", END).text(path).select(F.col("_metadata.file_path").alias("file"), "value").mapInArrow(run, READ)


def linked(meta: dict, about: bytes, conversion: dict, text: bytes) -> dict:
    said = json.loads(about)
    out = {"page_id": said["page_id"], "response_id": meta["WARC-Refers-To"], "source_digest": meta["WARC-Source-Payload-Digest"], "n_links": len(said["links"]), "title": said["title"]}
    out["digest_matches"] = said["envelope"]["digest_matches"] and conversion["WARC-Source-Payload-Digest"] == out["source_digest"] == said["envelope"]["payload_digest"]
    for kind, headers, content in (("metadata", meta, about), ("conversion", conversion, text)):
        found = digest(content)
        out |= {f"{kind}_id": headers["WARC-Record-ID"], f"{kind}_refers_to": headers["WARC-Refers-To"], f"{kind}_digest": found, f"{kind}_length": len(content)}
        out["digest_matches"] = out["digest_matches"] and found == headers["WARC-Block-Digest"]
    return out


def write_and_read(pages: DataFrame) -> DataFrame:
    """READ of the files that the pages' derivatives are written to, in the shared folder: a row per page."""
    path = stage_path(pages.sparkSession, "warc")
    write_texts(page_texts(pages), path)
    return read_files(pages.sparkSession, path)


def write(derived: DataFrame, kind: str, folder: str) -> DataFrame:
    """Write records of a kind (metadata or conversion) to a WARC file per partition, each a gzip member, in a folder that all executors share (a mounted path). Returns file, records; a task that runs again replaces its file as a whole."""

    def run(batches):
        from pyspark import TaskContext

        name = os.path.join(folder, f"{kind}-{TaskContext.get().partitionId():05d}.warc.gz")
        part, n = f"{name}.{uuid.uuid4().hex}", 0
        os.makedirs(folder, exist_ok=True)
        with open(part, "wb") as f:
            for batch in batches:
                for r in batch.column(kind):
                    f.write(gzip.compress(r.as_py(), mtime=0))
                    n += 1
        os.replace(part, name)
        yield _table([{"file": name, "records": n}], "file string, records long")

    return derived.select(kind).mapInArrow(run, "file string, records long")
