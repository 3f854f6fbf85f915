"""Canonical web addresses, what makes them unsafe to publish, and the identity of what they point to."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import parse_qsl, unquote, urlencode, urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerloom.functions import text as T

_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_UNRESERVED = frozenset(_ALNUM + "-._~")
_IN_PATH = _UNRESERVED | frozenset("!$&'()*+,;=:@/")
_IN_QUERY = _IN_PATH | {"?"}
_TOKEN = re.compile(r"%([0-9A-Fa-f]{2})|(%)|([^%]+)")
_LABEL = re.compile(r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?")
_CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f]")
_EMAIL, _PHONE = re.compile(T.EMAIL), re.compile(T.PHONE)
_EDGES = re.compile(f"^{T.WHITE_SPACE}+|{T.WHITE_SPACE}+$")
_PORTS = {"http": 80, "https": 443}

# Names of parameters that carry credentials, ends of names written without signs, words of names written with signs, and starts.
SENSITIVE_KEYS = frozenset({
    "access_token", "api_key", "apikey", "auth", "authorization", "code", "credential", "credentials", "id_token", "jsessionid", "jwt", "key", "key_pair_id", "oauth_token", "passwd", "password",
    "private_token", "refresh_token", "samlresponse", "secret", "session", "session_id", "sessionid", "sharedaccesssignature", "sig", "signature", "token",
})
SENSITIVE_ENDS = (
    "accesstoken", "apikey", "accesskeyid", "authorization", "credential", "credentials", "idtoken", "jsessionid", "jwt", "oauthtoken", "password", "passwd", "phpsessid", "privatekey", "privatetoken",
    "refreshtoken", "samlresponse", "secret", "secretaccesskey", "secretkey", "session", "sessionid", "sharedaccesssignature", "signature", "signingkey", "keypairid", "token",
)
SENSITIVE_WORDS = frozenset({"auth", "authorization", "credential", "credentials", "jwt", "passwd", "password", "secret", "session", "token"})
SENSITIVE_LAST = ("_password", "_secret", "_signature", "_token")
SENSITIVE_STARTS = ("x_amz_", "x_goog_")
PHONE_KEYS = frozenset({"contact", "mobile", "phone", "telephone", "tel"})
TRACKING_KEYS = frozenset({"utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref_source"})
# Host names that are not public, and networks of addresses with a special use.
PRIVATE_SUFFIXES = ("home.arpa", "internal", "lan", "local", "localdomain", "localhost")
SPECIAL_NETWORKS = tuple(map(ipaddress.ip_network, (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::/96", "::ffff:0:0/96", "64:ff9b::/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3ffe::/16", "3fff::/20", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8",
)))
# Sites with identities of their own, by host.
SITES = {
    "reddit.com": "reddit", "old.reddit.com": "reddit", "new.reddit.com": "reddit", "np.reddit.com": "reddit", "www.reddit.com": "reddit",
    "github.com": "github", "news.ycombinator.com": "hackernews", "www.news.ycombinator.com": "hackernews",
}
SITE_HOST = {"reddit": "www.reddit.com", "github": "github.com", "hackernews": "news.ycombinator.com"}


class BadUrl(ValueError):
    """Why an address has no canonical form; the message is the fault's name."""


def percent_normal(part: str, safe: frozenset[str] = _IN_QUERY) -> str:
    """Escapes of unreserved characters decoded, others in upper case, all that isn't safe escaped. Malformed escapes raise."""

    def one(m: re.Match) -> str:
        if m[2]:
            raise BadUrl("escape")
        if m[1]:
            ch = chr(int(m[1], 16))
            return ch if ch in _UNRESERVED else f"%{m[1].upper()}"
        return "".join(ch if ch in safe else "".join(f"%{b:02X}" for b in ch.encode()) for ch in m[3])

    return _TOKEN.sub(one, part)


def without_dots(path: str) -> str:
    """A path without its `.` and `..` segments; empty segments stay."""
    out: list[str] = []
    parts = path.split("/")
    for k, part in enumerate(parts):
        if part == "..":
            if len(out) > 1:
                out.pop()
        elif part != ".":
            out.append(part)
            continue
        if k == len(parts) - 1:
            out.append("")
    return "/".join(out) or "/"


def decoded_layers(text: str, rounds: int = 3) -> list[str]:
    """A text and what it is when its escapes are decoded once, twice, ... as long as that changes it."""
    out = [text]
    while len(out) <= rounds and (after := unquote(out[-1])) != out[-1]:
        out.append(after)
    return out


def parameter_pairs(part: str) -> Iterator[tuple[str, str]]:
    """(name, value) of a query or fragment, of each of its layers, parted by `&` and `;`."""
    for layer in decoded_layers(part.lstrip("?#")):
        for piece in re.split("[&;]", layer):
            if piece:
                yield from parse_qsl(piece, keep_blank_values=True)


def key_name(key: str) -> str:
    """A parameter's name: decoded, letters and digits in lower case, all else as one underscore."""
    return re.sub(r"[^a-z0-9]+", "_", T.label_of(decoded_layers(key)[-1])).strip("_")


def sensitive_key(key: str) -> bool:
    """Whether a parameter's name suggests a credential."""
    name = key_name(key)
    return (
        name in SENSITIVE_KEYS
        or name.startswith(SENSITIVE_STARTS)
        or name.endswith(SENSITIVE_LAST)
        or ("_" in name and not SENSITIVE_WORDS.isdisjoint(name.split("_")))
        or name.replace("_", "").endswith(SENSITIVE_ENDS)
    )


def _sensitive(url: str, path: str, query: str, fragment: str) -> str | None:
    """What an address must not hold when it is published: `personal` or `credential`."""
    if _EMAIL.search(decoded_layers(url)[-1]):
        return "personal"
    matrix = (segment.split(";", 1)[1] for layer in decoded_layers(path) for segment in layer.split("/") if ";" in segment)
    for key, value in (pair for part in (query, *matrix, fragment) for pair in parameter_pairs(part)):
        if sensitive_key(key):
            return "credential"
        value = decoded_layers(value)[-1]
        if _EMAIL.search(value) or _PHONE.search(value) and (key_name(key) in PHONE_KEYS or any(x in value for x in "+() ")):
            return "personal"
    last = decoded_layers(fragment)[-1]
    return "personal" if _EMAIL.search(last) or "+" in last and _PHONE.search(last) else None


def base36_id(text: str) -> str:
    """The one spelling of a positive base-36 number of at most 32 digits."""
    plain = text.lower().lstrip("0")
    if not re.fullmatch(r"[0-9A-Za-z]{1,32}", text) or not plain:
        raise BadUrl("native_id")
    return plain


def decimal_id(text: str) -> str:
    """The one spelling of a positive decimal number of at most 20 digits."""
    plain = text.lstrip("0")
    if not re.fullmatch(r"[0-9]{1,20}", text) or not plain:
        raise BadUrl("native_id")
    return plain


class Parts(NamedTuple):
    scheme: str
    host: str
    port: int | None
    path: str
    query: str
    fragment: str


def _address(host: str):
    try:
        return ipaddress.ip_address(host)
    except ValueError:
        return None


def checked_parts(url: str) -> Parts:
    """The parts of an address, scheme and host in their one spelling; faults raise."""
    if _CONTROL.search(url) or "\\" in url:
        raise BadUrl("character")
    try:
        found = urlsplit(_EDGES.sub("", url))
        name, user, password = found.hostname or "", found.username, found.password
    except ValueError:
        raise BadUrl("syntax") from None
    host = name.rstrip(".").lower() if name.isascii() else ""
    if not found.scheme or not host or "%" in name:
        raise BadUrl("host")
    address, authority = _address(host), found.netloc.rpartition("@")[2]
    if authority.startswith("[") and (address is None or address.version != 6):
        raise BadUrl("host")
    if address is not None:
        host = address.compressed
    if ":" not in host and (len(host) > 253 or not all(map(_LABEL.fullmatch, host.split(".")))):
        raise BadUrl("host")
    if found.scheme not in _PORTS:
        raise BadUrl("scheme")
    if user is not None or password is not None:
        raise BadUrl("userinfo")
    try:
        port = found.port
    except ValueError:
        raise BadUrl("syntax") from None
    if port == 0 or len(re.sub(r"^\[.*\]|^[^:]*", "", authority).lstrip(":")) > 5:
        raise BadUrl("port")
    return Parts(found.scheme, host, None if port == _PORTS[found.scheme] else port, found.path, found.query, found.fragment)


def _pairs(parts: Parts, without: frozenset[str]) -> list[tuple[str, str]]:
    return [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if T.label_of(k) not in without]


def _steps(path: str) -> list[str]:
    return [x for x in path.split("/") if x]


def _reddit(parts: Parts, path: str) -> tuple[str, str, str]:
    steps = _steps(re.sub(r"^/[a-z]{2}(?:-[A-Z]{2})?(?=/r/)", "", re.sub("/+", "/", path)))
    low = [x.lower() for x in steps]
    if len(steps) > 3 and low[0] == "r" and low[2] == "comments":
        steps[:4] = ["r", low[1], "comments", base36_id(steps[3])]
        if len(steps) > 5:
            steps[5] = base36_id(steps[5])
    return "/".join(["", *steps, ""]), "", ""


def _github(parts: Parts, path: str) -> tuple[str, str, str]:
    steps = _steps(path)
    if len(steps) == 4 and steps[2].lower() in ("issues", "discussions") and re.fullmatch("[0-9]+", steps[3]):
        steps[3] = decimal_id(steps[3])
    comment = re.fullmatch(r"(?:issuecomment|discussioncomment|discussion_r)-[0-9]+", parts.fragment)
    return "/" + "/".join(steps), urlencode(_pairs(parts, TRACKING_KEYS | {"notification_referrer_id"}), doseq=True), parts.fragment if comment else ""


def _hackernews(parts: Parts, path: str) -> tuple[str, str, str]:
    path = "/" + "/".join(_steps(path))
    if path != "/item":
        return path, "", ""
    items = [v for k, v in _pairs(parts, TRACKING_KEYS) if k == "id"]
    if len(items) != 1:
        raise BadUrl("native_id")
    return path, f"id={decimal_id(items[0])}", ""


_SITE_FORM: dict[str, Callable[[Parts, str], tuple[str, str, str]]] = {"reddit": _reddit, "github": _github, "hackernews": _hackernews}


def _canonical_parts(url: str) -> Parts:
    parts = checked_parts(url)
    if fault := _sensitive(url, parts.path, parts.query, parts.fragment):
        raise BadUrl(fault)
    path = without_dots(percent_normal(parts.path or "/", _IN_PATH))
    site = SITES.get(parts.host)
    if not site:
        return parts._replace(path=path, query=percent_normal(parts.query), fragment=percent_normal(parts.fragment))
    if parts.port is not None:
        raise BadUrl("port")
    return Parts("https", SITE_HOST[site], None, *_SITE_FORM[site](parts, path))


def _joined(p: Parts) -> str:
    host = f"[{p.host}]" if ":" in p.host else p.host
    return f"{p.scheme}://{host}{'' if p.port is None else f':{p.port}'}{p.path}{'?' + p.query if p.query else ''}{'#' + p.fragment if p.fragment else ''}"


@lru_cache(maxsize=50_000)
def _canonical_or_fault(url: str) -> tuple[Parts | None, str | None]:
    try:
        return _canonical_parts(url), None
    except BadUrl as fault:
        return None, str(fault)


def canonical_url(url: str) -> tuple[str | None, str | None]:
    """(canonical form, None), or (None, name of the fault): character, syntax, host, scheme, userinfo, port, escape, credential, personal or native_id."""
    parts, fault = _canonical_or_fault(url)
    return (_joined(parts) if parts else None), fault


class BadIdentity(ValueError):
    """(fault, field) of a record whose address doesn't identify it."""


def _need(good: object, fault: str, field: str) -> None:
    if not good:
        raise BadIdentity(fault, field)


def _reddit_identity(unit: Parts, thread: Parts, kind: str) -> tuple[str, str]:
    own, root = _steps(unit.path.lower()), _steps(thread.path.lower())
    post = lambda s: len(s) > 3 and s[0] == "r" and s[2] == "comments"
    _need(post(root) and len(root) < 6, "thread_permalink", "thread_url")
    _need(post(own), "thread_permalink", "url")
    _need((own[1], own[3]) == (root[1], root[3]), "thread_mismatch", "thread_url")
    _need(kind in ("post", "comment") and (kind == "comment" or len(own) < 6), "source_type", "source_type")
    _need(kind == "post" or len(own) == 6, "comment_permalink", "url")
    top = f"reddit:t3_{root[3]}"
    return (top if kind == "post" else f"reddit:t1_{own[5]}"), top


def _github_identity(unit: Parts, thread: Parts, kind: str) -> tuple[str, str]:
    own, root = _steps(unit.path.lower()), _steps(thread.path.lower())
    _need(len(root) == 4 and root[2] in ("issues", "discussions") and re.fullmatch("0*[1-9][0-9]*", root[3]) and not thread.query and not thread.fragment, "thread_permalink", "thread_url")
    _need(own == root and not unit.query, "thread_mismatch", "thread_url")
    thing = root[2][:-1]
    top = f"github:{root[0]}/{root[1]}:{thing}:{root[3].lstrip('0')}"
    comment = unit.fragment.lower()
    if kind == "comment":
        _need(re.fullmatch(f"{thing}comment-[1-9][0-9]*", comment), "comment_permalink", "url")
        return f"{top}#{comment}", top
    _need(kind == thing and not comment, "source_type", "source_type")
    return top, top


def _hackernews_identity(unit: Parts, thread: Parts, kind: str) -> tuple[str, str]:
    item = lambda p: re.fullmatch("id=([1-9][0-9]*)", p.query) if p.path == "/item" else None
    own, root = item(unit), item(thread)
    _need(root, "thread_permalink", "thread_url")
    _need(own, "thread_permalink", "url")
    _need(kind in ("story", "comment"), "source_type", "source_type")
    _need(kind == "comment" or own[1] == root[1], "thread_mismatch", "thread_url")
    _need(kind == "story" or own[1] != root[1], "comment_is_thread", "url")
    return f"hackernews:item:{own[1]}", f"hackernews:item:{root[1]}"


_IDENTITY = {"reddit": _reddit_identity, "github": _github_identity, "hackernews": _hackernews_identity}


def public_identity(platform: str | None, url: str | None, thread_url: str | None, source_type: str | None) -> tuple[str | None, str | None, str | None, str | None, str | None]:
    """(unit, thread, thread key, fault, field) of a public record. On the known sites they follow from what the address points to, however it is
    written; elsewhere they are the canonical addresses. Records without a usable address have a fault."""
    unit, unit_fault = _canonical_or_fault(url or "")
    thread, thread_fault = _canonical_or_fault(thread_url or "")
    if unit is None or thread is None:
        return None, None, None, unit_fault or thread_fault, "url" if unit is None else "thread_url"
    try:
        _need((unit.host, unit.port) == (thread.host, thread.port), "thread_host", "thread_url")
        rule = _IDENTITY.get(T.platform_of(platform or ""))
        if rule:
            own, top = rule(unit, thread, source_type or "")
            return own, top, top, None, None
    except BadIdentity as bad:
        return None, None, None, *bad.args
    return _joined(unit), _joined(thread), "url:" + _joined(thread), None, None


def thread_key(visibility: str | None, platform: str | None, url: str | None, thread_url: str | None, source_type: str | None, thread_id: str | None) -> str:
    """What threads are counted by: the identity's key, else the thread's canonical address; of records that aren't public, platform and label of the thread."""
    if visibility != "public":
        return f"private:{T.platform_of(platform or '')}:{T.label_of(thread_id or '')}"
    key = public_identity(platform, url, thread_url, source_type)[2]
    if key is None:
        form = canonical_url(thread_url or "")[0]
        key = "url:" + form if form else "invalid-public-thread"
    return key


def derived_community(platform: str | None, url: str | None) -> str | None:
    """The community that a canonical address implies on the known sites."""
    parts, _ = _canonical_or_fault(url or "")
    name = T.platform_of(platform or "")
    steps = _steps(parts.path) if parts else []
    if parts and name == "hackernews" and parts.host == SITE_HOST[name]:
        return parts.host
    if name == "reddit" and len(steps) > 1 and steps[0].lower() == "r":
        return f"r/{steps[1]}"
    return f"{steps[0]}/{steps[1]}" if name == "github" and len(steps) > 1 and parts.host == SITE_HOST[name] else None


def platform_family(visibility: str | None, url: str | None) -> str:
    """The platform that a record counts for, by its address and not by what it declares."""
    if visibility == "supplied_private":
        return "export"
    parts, _ = _canonical_or_fault(url or "")
    return "invalid-public-platform" if parts is None else SITES.get(parts.host) or f"web:{parts.host}"


def special_address(host: str) -> bool:
    """Whether a literal address is of a network with a special use, by the pinned list."""
    address = _address(host.partition("%")[0])
    return address is not None and any(address in network for network in SPECIAL_NETWORKS if network.version == address.version)


def private_host(host: str) -> bool:
    """Whether a host can't be reached by the public: special addresses, local names, names of one label, and numbers that only old parsers take for addresses."""
    if _address(host.partition("%")[0]) is not None:
        return special_address(host)
    labels = host.split(".")
    return len(labels) == 1 or any(host == s or host.endswith("." + s) for s in PRIVATE_SUFFIXES) or all(re.fullmatch("0[xX][0-9A-Fa-f]+|[0-9]+", x) for x in labels)


def reserved_example(url: str) -> bool:
    """Whether the host is of the domain that is reserved for examples."""
    try:
        name = (urlsplit(url).hostname or "").rstrip(".").lower()
    except ValueError:
        return False
    return name == "example" or name.endswith(".example")


def _fields(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def _structs(rows: list[tuple], kind: StructType) -> pa.Array:
    columns = list(zip(*rows)) or [()] * len(kind)
    return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=kind.names)


_CANONICAL, _IDENTITY_KIND = _fields("canonical", "error"), _fields("unit", "thread", "thread_key", "error", "field")


@F.arrow_udf(_CANONICAL)
def _canonical(batch: pa.Array) -> pa.Array:
    return _structs([(None, None) if u is None else canonical_url(u) for u in batch.to_pylist()], _CANONICAL)


@F.arrow_udf(_IDENTITY_KIND)
def _identities(platform: pa.Array, url: pa.Array, thread: pa.Array, kind: pa.Array) -> pa.Array:
    return _structs([public_identity(*row) for row in zip(*(c.to_pylist() for c in (platform, url, thread, kind)))], _IDENTITY_KIND)


@F.arrow_udf(StringType())
def _thread_keys(*columns: pa.Array) -> pa.Array:
    return pa.array([thread_key(*row) for row in zip(*(c.to_pylist() for c in columns))], pa.string())


@F.arrow_udf(StringType())
def _communities(platform: pa.Array, url: pa.Array) -> pa.Array:
    return pa.array([derived_community(*row) for row in zip(platform.to_pylist(), url.to_pylist())], pa.string())


@F.arrow_udf(StringType())
def _families(visibility: pa.Array, url: pa.Array) -> pa.Array:
    return pa.array([platform_family(*row) for row in zip(visibility.to_pylist(), url.to_pylist())], pa.string())


@F.arrow_udf(StringType())
def _private(batch: pa.Array) -> pa.Array:
    return pa.array([None if h is None else "private" if private_host(h) else "public" for h in batch.to_pylist()], pa.string())


def canonical(url: Column) -> Column:
    """struct<canonical, error> of an address; nulls for null."""
    return _canonical(url)


def identity(platform: Column, url: Column, thread_url: Column, source_type: Column) -> Column:
    """struct<unit, thread, thread_key, error, field>, see public_identity()."""
    return _identities(platform, url, thread_url, source_type)


def thread_keys(visibility: Column, platform: Column, url: Column, thread_url: Column, source_type: Column, thread_id: Column) -> Column:
    return _thread_keys(visibility, platform, url, thread_url, source_type, thread_id)


def communities(platform: Column, url: Column) -> Column:
    return _communities(platform, url)


def families(visibility: Column, url: Column) -> Column:
    return _families(visibility, url)


def reach(host: Column) -> Column:
    """`public` or `private` for a host, null for null."""
    return _private(host)


def host(url: Column) -> Column:
    """The host in lower case, without port and final dots; null where there is none."""
    found = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://([^/?#:@]+)", 1)
    found = F.regexp_replace(found, r"\.+$", "")
    return F.when(found != "", found)


def port(url: Column) -> Column:
    """The port that is written, null where none is."""
    found = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#:@]+:([0-9]{1,5})(?:[/?#]|$)", 1)
    return F.when(found != "", found.cast("int"))


def parameter_names(url: Column) -> Column:
    """The names of the query's parameters, in order, each once."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.array_distinct(F.filter(F.transform(F.split(query, "[&;]"), lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1)))), lambda p: p != ""))
