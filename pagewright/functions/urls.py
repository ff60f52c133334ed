"""URL resolution for the DOM tier, in plain Python: what a browser's URL parser gives for web addresses."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit

DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21}


#: Addresses that are normal as they stand, and paths that only need an origin before them.
SEGMENT = r"[A-Za-z0-9_~%-][A-Za-z0-9_.~%-]*"
REST = rf"(?:{SEGMENT}(?:/{SEGMENT})*/?)?(?:\?[A-Za-z0-9=&_.~%-]*)?(?:#[A-Za-z0-9_.~%-]*)?"
PLAIN = re.compile(rf"https?://[a-z0-9-]+(?:\.[a-z0-9-]+)+/{REST}")
PATH = re.compile(rf"/{REST}")
ORIGIN = re.compile(r"https?://[a-z0-9-]+(?:\.[a-z0-9-]+)+(?=[/?#]|$)")


def normal(url: str) -> str | None:
    try:
        p = urlsplit(url)
        port = p.port
    except ValueError:
        return None
    if not p.scheme:
        return None
    if p.scheme not in DEFAULT_PORTS:
        return url
    if not p.hostname:
        return None
    host = p.hostname
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            return None
    if any(c in host for c in " <>^|%\\") or not host:
        return None
    if ":" in host:
        host = f"[{host}]"
    user = p.netloc.rpartition("@")[0]
    net = (user + "@" if user else "") + host + (f":{port}" if port and port != DEFAULT_PORTS[p.scheme] else "")
    path = quote(p.path or "/", safe="/%:@!$&'()*+,;=~-._[]|^\\")
    out = f"{p.scheme}://{net}{path}"
    if p.query or "?" in url.split("#")[0]:
        out += "?" + quote(p.query, safe="/%:@!$&()*+,;=~-._[]|^?`{}\\") if p.query else "?"
    if p.fragment or url.endswith("#"):
        out += "#" + quote(p.fragment, safe="/%:@!$&'()*+,;=~-._[]|^?{}\\#")
    return out


def resolve(href: str | None, base: str) -> str | None:
    """href against base, normalised; null if either cannot be read."""
    if not href:
        return None
    if PLAIN.fullmatch(href):
        return href
    if (o := ORIGIN.match(base)) and PATH.fullmatch(href):
        return o[0] + href
    href = href.strip(" \t\n\r\f").replace("\t", "").replace("\n", "").replace("\r", "")
    try:
        return normal(urljoin(base, href) if href else base)
    except ValueError:
        return None


def path_of(url: str) -> str:
    """The path of an address that can be read."""
    return url[o.end() :].partition("#")[0].partition("?")[0] if (o := ORIGIN.match(url)) else urlsplit(url).path


def host(url: str | None) -> str:
    if not url:
        return ""
    if o := ORIGIN.match(url):
        return o[0].partition("://")[2]
    try:
        p = urlsplit(url)
        if not p.hostname:
            return ""
        port = p.port
    except ValueError:
        return ""
    return p.hostname + (f":{port}" if port and port != DEFAULT_PORTS.get(p.scheme) else "")
