"""Media columns: interleaved document sequences.

A page is parsed into an ordered sequence of structs (position, kind, text, digest, caption):
runs of text, and references to media by the digest of their payload, each with the caption of
its figure. Payloads lie in a media store, a table (digest, media) of stored forms; references
are resolved by a join on the digest. Positions count both kinds, so the order of text and
media stays as it was in the page.

Here a payload is a text's UTF-8 bytes, filled with 255 to a positive multiple of 576 and
stored as a grey PGM picture 24 samples wide. What a reference needs to know of its payload is
computed where the stored bytes are read back, once for each, and only digests and results
take part in the join: no payload is shuffled, however often it is referred to.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.llm.text import join_spread
from oriel.session import stage
from oriel.sources import read_table

FRAME, FILL, WIDTH = 576, b"\xff", 24
#: Elements whose text isn't part of a page's text, and those that end a run of text.
HIDDEN = {"script", "style", "title", "template"}
BLOCKS = {"p", "div", "article", "section", "figure", "figcaption", "li", "ul", "ol", "table", "tr", "td", "h1", "h2", "h3", "h4", "h5", "h6", "br", "nav", "header", "footer", "body", "blockquote", "pre"}
MEDIA = {"img", "audio", "video", "source"}
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"


class _Page(HTMLParser):
    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.hidden: list[str] = []
        #: Hidden elements that nothing closes hide nothing.
        self.closing = {tag: html.lower().count(f"</{tag}") for tag in HIDDEN}
        #: First item of the open figure, None outside; its captions so far, and the open one.
        self.figure: int | None = None
        self.captions: list[str] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text, self.run = "".join(self.run).strip(), []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def end_caption(self) -> None:
        said = "".join(self.caption or []).strip()
        self.caption = None
        if said and self.figure is None:  # outside a figure it is text like other text
            self.run.append(said)
            self.flush()
        elif said:
            self.captions.append(said)

    def end_figure(self) -> None:
        """All captions of a figure, wherever they stand in it, go to its media; without media they are text."""
        if self.figure is None:
            return
        self.end_caption()
        self.flush()
        media = [x for x in self.items[self.figure :] if x["kind"] == "media"]
        said, self.captions, self.figure = " ".join(self.captions), [], None
        for item in media:
            item["caption"] = said or item["caption"]
        if said and not media:
            self.run.append(said)
            self.flush()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in HIDDEN and self.closing[tag] > 0:
            self.closing[tag] -= 1
            self.hidden.append(tag)
        if tag in BLOCKS or tag in MEDIA:
            if self.caption is None:
                self.flush()
            else:
                self.caption.append(" ")
        if tag == "figure":
            self.end_figure()
            self.figure = len(self.items)
        if tag == "figcaption":
            self.end_caption()
            self.caption = []
        if tag in MEDIA and (source := dict(attrs).get("src")) and not self.hidden:
            named = dict(attrs).get("alt")
            self.items.append({"kind": "media", "text": None, "digest": source.removeprefix("sha256:"), "caption": named or None})

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            self.hidden.remove(tag)
        if tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            self.end_figure()
        elif tag in BLOCKS:
            if self.caption is None:
                self.flush()
            else:
                self.caption.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)

    def finish(self) -> None:
        self.close()
        self.end_figure()
        self.end_caption()
        self.flush()


def parse_page(html: str) -> list[dict]:
    """Ordered items of one page; unknown elements don't matter, and unclosed ones end where the page does."""
    page = _Page(html)
    page.feed(html)
    page.finish()
    return [item | {"position": k} for k, item in enumerate(page.items)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse_page(x.as_py() or "") for x in batch.column(1)], kind)], ["doc_id", "items"])


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Rows (doc_id, items), one for each page; a null or empty page has no items."""
    return pages.select(pages[id_col].alias("doc_id"), pages[html_col].alias("html")).mapInArrow(_parse, f"doc_id {pages.schema[id_col].dataType.simpleString()}, items array<{ITEM}>")


def to_payload(data: bytes) -> bytes:
    return data + FILL * (max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


def to_media(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_media(media: bytes) -> bytes:
    """The samples of a stored picture; its header says how many there are."""
    kind, width, height, most = media.split(maxsplit=4)[:4]
    if kind != b"P5" or most != b"255":
        raise ValueError("not a grey picture of 8-bit samples")
    start = len(kind) + len(width) + len(height) + len(most) + 4
    samples = media[start:]
    if len(samples) != int(width) * int(height):
        raise ValueError("a picture with too few or too many samples")
    return samples


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 500):  # payloads of a few rows at a time
            texts = [x.as_py() or b"" for x in batch.column(0).slice(k, 500).cast(pa.binary())]
            payloads = [to_payload(x) for x in texts]
            digests = [hashlib.sha256(x).hexdigest() for x in payloads]
            yield pa.RecordBatch.from_arrays([pa.array(map(len, texts), pa.int64()), pa.array(digests), pa.array(map(to_media, payloads), pa.binary())], ["n_bytes", "digest", "media"])


def feature(samples: bytes) -> str:
    """Mean, spread and quarter shares of the samples, with six decimals, joined by spaces."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    levels, n = np.arange(256), max(1, len(samples))
    mean = float((counts * levels).sum() / n)
    spread = float(np.sqrt(max(0.0, (counts * levels**2).sum() / n - mean**2)))
    return " ".join(f"{x:.6f}" for x in [mean, spread, *(counts.reshape(4, 64).sum(axis=1) / n)])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        rows = []
        for digest, n_bytes, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            media = stored.as_py()
            samples = from_media(media)
            rows.append((digest, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def resolve(store: DataFrame) -> DataFrame:
    """One row for each digest of a store (digest, media, n_bytes), from the stored bytes, and how many stored forms there were."""
    read = store.select("digest", "n_bytes", "media").mapInArrow(_read_back, "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return read.groupBy("digest").agg(*[F.min(c).alias(c) for c in read.columns[1:]], F.count("*").alias("stored"))


def resolve_references(items: DataFrame, store: DataFrame) -> DataFrame:
    """Media items of sequences, one row each, with what is known of their payloads; null where the store lacks the digest."""
    references = stage(items.select("doc_id", F.explode("items").alias("item")).where("item.kind = 'media'").select("doc_id", "item.position", "item.caption", "item.digest"), "references")
    known = stage(resolve(store), "payloads")
    counts = references.groupBy("digest").agg(F.count("*").alias("copies"))
    found = join_spread(references, known.join(counts, "digest"), ["digest"], "copies", references.count()).drop("copies", "stored")
    lacking = references.join(known.select("digest"), "digest", "left_anti")
    return found.unionByName(lacking, allowMissingColumns=True)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A page for each document: its first line, a figure with its payload, and its other lines."""
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part, pages = batch.slice(k, 500), []
            for name, text in zip(part.column(1).to_pylist(), part.column(2), strict=True):
                text = text.as_py() or ""
                first, _, rest = text.partition("\n")
                digest = hashlib.sha256(to_payload(text.encode())).hexdigest()
                pages.append(f"<p>{escape(first)}</p><figure><figcaption>document {escape(name or '')}</figcaption><img src='sha256:{digest}'></figure><p>{escape(rest)}</p>")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pages, pa.string())], ["page_id", "html"])


def op9_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a page with its lines and one figure, whose payload is in the store; a null text has the payload of an empty one.

    Repeated rows are pages of their own; a null doc_id is kept.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    store = stage(docs.select("text").mapInArrow(_encode, "n_bytes long, digest string, media binary"), "media")
    pages = docs.select("doc_id", F.col("doc_id").cast("string").alias("name"), "text").mapInArrow(_pages, f"page_id {kind}, html string")
    found = resolve_references(sequences(pages), store)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
