"""Page snapshots: the fixed nested schema, the extractor, and snapshots made from columns.

A snapshot measures and never judges. ``extract`` reads raw HTML (static mode: whatever needs layout is
null); live snapshots come as JSON or Parquet of the same schema through ``read``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, LongType, MapType, StructField, StructType

from pagewright.functions import dom, urls
from pagewright.functions.text import QUESTION_WORDS

META = "struct<count:int,content:string,all:array<string>>"
NODE = "struct<types:array<string>,id:string,present:array<string>,sameAs:array<string>>"
SCHEMA = f"""
schemaVersion int, mode string, url string, origin string, host string, protocol string, pathname string, search string, hash string,
baseHref string, referrerPolicy string, title struct<count:int,text:string,all:array<string>>,
description {META}, keywords {META}, robotsMeta {META}, googlebotMeta {META}, metaRefresh string,
canonical struct<count:int,href:string,raw:string,all:array<string>>, lang string, dir string, charset string, metaCharset string, viewport string,
og map<string,string>, twitter map<string,string>, otherMeta map<string,string>,
headings array<struct<level:int,text:string,empty:boolean,hidden:boolean,region:string>>,
content struct<bodyWords:int,mainWords:int,hasMain:boolean,mainSelector:string,textLength:bigint,htmlLength:bigint,textRatio:double,domNodes:int,
 shape:struct<paragraphs:int,firstParagraphWords:int,longestParagraphWords:int,paragraphsOver120Words:int,lists:int,listItems:int,tables:int,definitionLists:int,blockquotes:int,timeElements:array<string>,contentInIframes:int>,
 questionHeadings:int,preview:string>,
links array<struct<href:string,raw:string,kind:string,text:string,rel:string,target:string,internal:boolean,region:string,hidden:boolean,hasImage:boolean,ariaLabel:string>>,
linksTruncated boolean, linkCount int, specialLinks struct<mailto:int,tel:int,javascript:int,fragment:int>,
images array<struct<src:string,isData:boolean,ext:string,alt:string,hasAlt:boolean,title:string,loading:string,decoding:string,widthAttr:string,heightAttr:string,broken:boolean,naturalWidth:int,naturalHeight:int,displayWidth:int,displayHeight:int,inViewport:boolean,srcset:boolean,inPicture:boolean,region:string,hidden:boolean>>,
imagesTruncated boolean, imageCount int, hreflang array<struct<hreflang:string,href:string>>,
structuredData struct<jsonLd:array<struct<index:int,ok:boolean,data:string,bytes:int,error:string,preview:string,nodes:array<{NODE}>>>,microdataItems:int,rdfaItems:int>,
alternates struct<amphtml:string,prev:string,next:string,manifest:string,favicons:array<struct<rel:string,href:string,sizes:string>>>,
loaded struct<hosts:array<struct<host:string,count:int,thirdParty:boolean,how:array<string>>>,thirdPartyHosts:int,requestedUrls:array<string>,scriptUrls:array<string>,html:string,htmlTruncated:boolean,markupLength:bigint>,
page struct<readyState:string,iframes:int,forms:int,scripts:int,inlineScripts:int,stylesheets:int,noscript:int,passwordFields:int,viewportWidth:int,viewportHeight:int,generator:string>, error string
"""
#: How much of a page is kept.
LINK_CAP, IMAGE_CAP, HTML_CAP, REQUEST_CAP = 5000, 2000, 600_000, 600
OWN_META = ("description", "robots", "googlebot", "viewport", "keywords")
#: Words that open a question, with an ASCII word boundary behind them.
QUESTION = re.compile(f"(?:{'|'.join(QUESTION_WORDS)})(?![A-Za-z0-9_])", re.IGNORECASE)


@cache
def schema() -> StructType:
    """The snapshot type; needs a running session, for Spark parses it."""
    return StructType.fromDDL(SCHEMA.replace("\n", " "))


def row_schema() -> StructType:
    return StructType([StructField("page_id", LongType()), StructField("s", schema())])


def json_ld(raw: str, index: int) -> dict:
    def refuse(x: str) -> None:
        raise ValueError(f"unexpected {x}")

    try:
        data = json.loads(raw, parse_constant=refuse)
    except (ValueError, RecursionError) as e:
        return {"index": index, "ok": False, "bytes": len(raw), "error": str(e), "preview": dom.squeeze(raw, 200), "nodes": []}
    return {"index": index, "ok": True, "data": raw, "bytes": len(raw), "nodes": nodes_of(data)}


def as_list(x) -> list:
    return x if isinstance(x, list) else [x]


def nodes_of(data) -> list[dict]:
    """Top-level nodes of a JSON-LD document: its graph, or itself. A null document has none."""
    graph = data.get("@graph") if isinstance(data, dict) else None
    out = []
    for n in as_list(graph or data):
        if isinstance(n, dict):
            out.append({
                "types": [t for t in as_list(n.get("@type")) if isinstance(t, str) and t],
                "id": str(n["@id"]) if n.get("@id") else None,
                "present": [k for k, v in n.items() if v is not None and v != ""],
                "sameAs": [u for u in as_list(n.get("sameAs")) if isinstance(u, str)],
            })
    return out


#: Parts of a snapshot that cost something, and can be left out of an extraction: what is left out is as if nothing had been found.
PARTS = ("head", "headings", "content", "links", "images", "structuredData", "loaded", "page")


def asks(text: str) -> bool:
    """Whether a heading is a question."""
    return bool(text) and (text.endswith("?") or QUESTION.match(text) is not None)


def count_words(s: str) -> int:
    return len(s.split()) if s.isascii() else len([w for w in dom.SPACE.split(s) if w])


def address(url: str) -> dict:
    """What a snapshot says of the page's own address."""
    page = urls.normal(url or "") or ""
    here, split = urls.host(page), urls.urlsplit(page)
    return {"url": url, "origin": f"{split.scheme}://{here}" if here else "", "host": here, "protocol": split.scheme + ":" if split.scheme else "", "pathname": split.path, "search": "?" + split.query if split.query else "", "hash": "#" + split.fragment if split.fragment else ""}


def measure(html: str, url: str, parts: tuple[str, ...] = PARTS, closed: bool = False) -> dict:
    """One page's snapshot as nested Python values; only these parts of it. closed: references without a semicolon are text."""
    squeeze, tree, of_url = dom.squeeze, dom.parse(html, dom.closed_references) if closed else dom.parse(html), address(url)
    nodes, of, here = tree.nodes, tree.of, of_url["host"]
    page = urls.normal(url or "") or ""
    base = next((n for n in of("base") if "href" in n.attrs), None)
    base_url = (urls.resolve(base.attrs["href"], page) or page) if base is not None else page
    known: dict[str, str | None] = {}

    def absolute(href: str | None) -> str | None:
        if not href:
            return None
        if href not in known:
            known[href] = urls.resolve(href, base_url)
        return known[href]

    has = set(parts).__contains__
    metas, link_nodes, scripts = of("meta"), of("link"), of("script")
    named: dict[str, list[dom.Node]] = {}
    for n in metas:
        named.setdefault((n.get("name") or "").lower(), []).append(n)

    def meta(name: str) -> dict:
        found = [n.attrs.get("content", "") for n in named.get(name, ())]
        return {"count": len(found), "content": found[0] if found else None, "all": found}

    first_meta = lambda name: next((n.get("content") for n in named.get(name, ())), None)
    rel = lambda n: (n.attrs.get("rel") or "").lower().split()
    linked = lambda token: next((absolute(n.get("href")) for n in link_nodes if token in rel(n)), None)
    out: dict = {"schemaVersion": 1, "mode": "static", **of_url, "baseHref": base_url if base is not None else None}
    maps: dict[str, dict[str, str]] = {"og": {}, "twitter": {}, "otherMeta": {}}
    if has("head"):
        for n in metas:
            key, value = (n.get("property") or n.get("name") or "").lower(), n.attrs.get("content")
            if not key or value is None:
                continue
            if key.startswith(("og:", "article:", "product:")):
                maps["og"][key] = squeeze(value, 500)
            elif key.startswith("twitter:"):
                maps["twitter"][key] = squeeze(value, 500)
            elif key not in OWN_META:
                maps["otherMeta"][key] = squeeze(value, 300)
        titles = [squeeze(tree.text(n)) for n in of("title") if n.in_head]
        canonicals = [n for n in link_nodes if "canonical" in rel(n)]
        out |= {
            "referrerPolicy": first_meta("referrer"), "title": {"count": len(titles), "text": titles[0] if titles else None, "all": titles},
            "description": meta("description"), "keywords": meta("keywords"), "robotsMeta": meta("robots"), "googlebotMeta": meta("googlebot"), "metaRefresh": next((n.get("content") for n in metas if (n.get("http-equiv") or "").lower() == "refresh"), None),
            "canonical": {"count": len(canonicals), "href": absolute(canonicals[0].get("href")) if canonicals else None, "raw": canonicals[0].get("href") if canonicals else None, "all": [absolute(n.get("href")) for n in canonicals]},
            "lang": tree.html.get("lang") or None, "dir": tree.html.get("dir") or None, "charset": None, "metaCharset": next((n.get("charset") for n in metas if "charset" in n.attrs), None), "viewport": first_meta("viewport"),
            "hreflang": [{"hreflang": n.get("hreflang"), "href": absolute(n.get("href"))} for n in link_nodes if "hreflang" in n.attrs and "alternate" in rel(n)],
            "alternates": {"amphtml": linked("amphtml"), "prev": linked("prev"), "next": linked("next"), "manifest": linked("manifest"), "favicons": [{"rel": n.get("rel"), "href": absolute(n.get("href")), "sizes": n.get("sizes")} for n in link_nodes if {"icon", "apple-touch-icon"} & set(rel(n))]},
        }
    out |= maps
    headings = []
    if has("headings") or has("content"):
        for n in sorted((n for k in range(1, 7) for n in of(f"h{k}")), key=lambda n: n.at):
            text = squeeze(tree.text(n), 200)
            headings.append({"level": int(n.tag[1]), "text": text, "empty": not text, "hidden": None, "region": n.region})
    out["headings"] = headings if has("headings") else []
    links, special = [], {"mailto": 0, "tel": 0, "javascript": 0, "fragment": 0}
    for n in of("a") if has("links") else ():
        attrs = n.attrs
        raw = attrs.get("href")
        href, kind, internal = None, "no-href", None
        if raw is not None:
            low = raw.strip().lower()
            other = "fragment" if low.startswith("#") else next((k for k in ("mailto", "tel", "javascript") if low.startswith(k + ":")), None) if ":" in low else None
            if other:
                special[other] += 1
                continue
            href, kind, raw = absolute(raw), "link", squeeze(raw, 300)
            internal = urls.host(href) == here if href else None
        links.append({"href": href, "raw": raw, "kind": kind, "text": squeeze(tree.text(n), 120), "rel": squeeze(attrs.get("rel"), 120), "target": attrs.get("target") or None, "internal": internal, "region": n.region, "hidden": None, "hasImage": n.images_end > n.images, "ariaLabel": squeeze(attrs.get("aria-label"), 120)})
    out |= {"links": links[:LINK_CAP], "linksTruncated": len(links) > LINK_CAP, "linkCount": len(links), "specialLinks": special}
    images = []
    for n in of("img") if has("images") else ():
        get = n.attrs.get
        src = absolute(get("src"))
        ext = urls.path_of(src).rpartition(".")[2].lower()[:5] if src else None
        images.append({
            "src": src, "isData": (get("src") or "").startswith("data:"), "ext": ext, "alt": squeeze(get("alt"), 200) if "alt" in n.attrs else None, "hasAlt": "alt" in n.attrs, "title": squeeze(get("title"), 120),
            "loading": get("loading") or None, "decoding": get("decoding") or None, "widthAttr": get("width") or None, "heightAttr": get("height") or None, "broken": None, "naturalWidth": None, "naturalHeight": None, "displayWidth": None, "displayHeight": None, "inViewport": None,
            "srcset": bool(get("srcset")), "inPicture": n.in_picture, "region": n.region, "hidden": None,
        })
    out |= {"images": images[:IMAGE_CAP], "imagesTruncated": len(images) > IMAGE_CAP, "imageCount": len(images)}
    if has("content"):
        body = of("body")[0]
        main = next((n for n in nodes if n.tag == "main" or n.attrs.get("role") == "main"), None) or next(iter(of("article")), None)
        body_text = squeeze(tree.spoken(body), None)
        main_text = squeeze(tree.spoken(main), None) if main is not None else ""
        scope = tree.below(main if main is not None else body)
        within: dict[str, int] = {}
        for n in scope:
            within[n.tag] = within.get(n.tag, 0) + 1
        paragraphs = [count_words(tree.spoken(n)) for n in scope if n.tag == "p"] if "p" in within else []
        tally = lambda *tags: sum(within.get(t, 0) for t in tags)
        shape = {
            "paragraphs": len(paragraphs), "firstParagraphWords": next((w for w in paragraphs if w), 0), "longestParagraphWords": max(paragraphs, default=0), "paragraphsOver120Words": sum(w > 120 for w in paragraphs),
            "lists": tally("ul", "ol"), "listItems": tally("li"), "tables": tally("table"), "definitionLists": tally("dl"), "blockquotes": tally("blockquote"),
            "timeElements": [n.attrs["datetime"] for n in scope if n.tag == "time" and "datetime" in n.attrs][:10] if "time" in within else [], "contentInIframes": tally("iframe"),
        }
        out["content"] = {"bodyWords": count_words(body_text), "mainWords": count_words(main_text), "hasMain": main is not None, "mainSelector": main.tag if main is not None else None, "textLength": len(body_text), "htmlLength": len(html), "textRatio": round(len(body_text) / len(html), 4) if html else 0.0, "domNodes": len(nodes) + 1, "shape": shape, "questionHeadings": sum(asks(h["text"]) for h in headings), "preview": (main_text or body_text)[:400]}
    if has("structuredData"):
        out["structuredData"] = {"jsonLd": [json_ld(tree.text(n), i) for i, n in enumerate(n for n in scripts if (n.get("type") or "").lower() == "application/ld+json")], "microdataItems": sum("itemscope" in n.attrs for n in nodes), "rdfaItems": sum("typeof" in n.attrs or "vocab" in n.attrs for n in nodes)}
    if has("loaded"):
        hosts: dict[str, dict] = {}
        for tag, attr in (("script", "src"), ("link", "href"), ("img", "src"), ("iframe", "src"), ("source", "src"), ("video", "src")):
            for n in of(tag):
                if h := urls.host(absolute(n.attrs.get(attr))):
                    row = hosts.setdefault(h, {"host": h, "count": 0, "thirdParty": h != here, "how": ["markup"]})
                    row["count"] += 1
        out["loaded"] = {"hosts": sorted(hosts.values(), key=lambda h: -h["count"]), "thirdPartyHosts": sum(h["thirdParty"] for h in hosts.values()), "requestedUrls": [], "scriptUrls": [u for u in (absolute(n.attrs.get("src")) for n in scripts if "src" in n.attrs) if u], "html": html[:HTML_CAP], "htmlTruncated": len(html) > HTML_CAP, "markupLength": len(html)}
    if has("page"):
        out["page"] = {"readyState": None, "iframes": len(of("iframe")), "forms": len(of("form")), "scripts": len(scripts), "inlineScripts": sum(not n.get("src") for n in scripts), "stylesheets": sum("stylesheet" in rel(n) for n in link_nodes), "noscript": len(of("noscript")), "passwordFields": sum((n.get("type") or "").lower() == "password" for n in of("input")), "viewportWidth": None, "viewportHeight": None, "generator": first_meta("generator")}
    return out


def measured(html: str | None, url: str | None, parts: tuple[str, ...] = PARTS, closed: bool = False) -> dict:
    """measure(), or what is known of a page that cannot be measured, with the reason in `error`."""
    try:
        return measure(html or "", url or "", parts, closed)
    except Exception as e:  # noqa: BLE001  one page must not end the job; the row says what happened
        return {"schemaVersion": 1, "mode": "static", "url": url, "og": {}, "twitter": {}, "otherMeta": {}, "headings": [], "links": [], "images": [], "hreflang": [], "error": f"{type(e).__name__}: {e}"[:300]}


def extract(pages: DataFrame, parts: tuple[str, ...] = PARTS, closed: bool = False) -> DataFrame:
    """pages (page_id, url, html) -> page_id, s: one pass a page, Arrow batches, no shuffle. A null html measures as empty.

    parts names what is wanted of a page: the rest isn't measured and costs nothing on the way.
    With closed, character references without their semicolon (`&amp` where a title was cut) stay text; browsers read some of them.
    """
    out = row_schema()
    arrow, parts = to_arrow_schema(out), tuple(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at, html = (b.column(c).to_pylist() for c in ("page_id", "url", "html"))
            for lo in range(0, len(ids), 128):
                rows = [{"page_id": i, "s": measured(h, u, parts, closed)} for i, u, h in zip(ids[lo : lo + 128], at[lo : lo + 128], html[lo : lo + 128], strict=True)]
                for r in rows:  # maps are lists of pairs to Arrow
                    for k in ("og", "twitter", "otherMeta"):
                        r["s"][k] = list(r["s"][k].items())
                yield from pa.Table.from_pylist(rows, schema=arrow).to_batches()

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, out)


def empty(kind: DataType) -> Column:
    """What a field that was not measured holds: empty lists and maps, structs of such, else null."""
    if isinstance(kind, StructType):
        return F.struct(*(empty(f.dataType).alias(f.name) for f in kind.fields))
    if isinstance(kind, ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, MapType):
        return F.create_map().cast(kind)
    return F.lit(None).cast(kind)


def snapshot(values: dict[str, Column]) -> Column:
    """A snapshot struct from some of its fields, by dotted path."""

    def build(kind: StructType, at: str) -> Column:
        cols = []
        for f in kind.fields:
            path = f"{at}{f.name}"
            if path in values:
                c = values[path].cast(f.dataType)
            elif isinstance(f.dataType, StructType) and any(p.startswith(path + ".") for p in values):
                c = build(f.dataType, path + ".")
            else:
                c = empty(f.dataType)
            cols.append(c.alias(f.name))
        return F.struct(*cols)

    return build(schema(), "")


def read(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Stored snapshots (page_id, s); JSON is read with the fixed schema, never inferred."""
    return spark.read.schema(row_schema()).format(form).load(path)
