"""Host, URL and key expressions (G1-G4, G8-G15, G23, G28). All are native columns; null in gives null out unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Registrable domains that are infrastructure, not publishers. Fixed values.
INFRA_DOMAINS = [
    "github.com", "gitlab.com", "bitbucket.org", "npmjs.com", "pypi.org", "shields.io", "star-history.com", "youtube.com", "youtu.be", "reddit.com", "wikipedia.org",
    "twitter.com", "x.com", "discord.com", "discord.gg", "medium.com", "dev.to", "linkedin.com", "buymeacoffee.com", "patreon.com", "opencollective.com", "glama.ai",
]
#: Suffixes of more than one label under which names are registered: a documented subset of the public list. Fixed values.
PUBLIC_SUFFIXES = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.nz", "org.nz", "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp", "com.br", "org.br",
    "gov.br", "co.in", "org.in", "ac.in", "co.za", "org.za", "com.cn", "org.cn", "net.cn", "com.mx", "com.tr", "com.sg", "com.hk", "com.tw", "co.kr", "or.kr", "com.ar", "com.pl", "co.il",
    "github.io", "gitlab.io", "vercel.app", "netlify.app", "pages.dev", "workers.dev", "web.app", "firebaseapp.com", "herokuapp.com", "azurewebsites.net", "fly.dev", "onrender.com", "blogspot.com",
]
#: Number of host shards. Fixed value.
SHARDS = 8192
#: URLs in running text. Fixed pattern.
TEXT_URL = r"""(https?://[^\s<>"')\]]+)"""


def dedup_key(kind: Column, natural: Column) -> Column:
    """Key of a work item: lower-case hex SHA-256 of ``kind:natural`` (G1)."""
    return F.sha2(F.concat(kind, F.lit(":"), natural), 256)


def host_shard(host: Column) -> Column:
    """FNV-1a (32 bit) of the host's UTF-8 bytes, modulo SHARDS."""
    octets = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(host), F.lit(1))), lambda i: F.conv(F.substring(F.hex(F.encode(host, "UTF-8")), i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    start = F.lit(2166136261).cast("long")

    def step(h: Column, x: Column) -> Column:
        mixed = h.bitwiseXOR(x)
        # 16777619 = 2^24 + 403; the product stays within 64 bits and is cut to 32.
        return (mixed * F.lit(403) + F.shiftleft(mixed.bitwiseAND(F.lit(255)), 24)).bitwiseAND(F.lit(4294967295))

    hashed = F.when(host == "", start).otherwise(F.aggregate(octets, start, step))
    return F.when(host.isNotNull(), F.pmod(hashed, F.lit(SHARDS)).cast("int"))


def url_host(url: Column) -> Column:
    """Host of a URL without port and userinfo, case kept; null when there is none."""
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?(\[[^\]/]*\]|[^/:?#]*)", 1), F.lit(""))


def fetch_host(url: Column, host: Column) -> Column:
    """Host that a work item is fetched from: that of its URL, else its host column."""
    return F.coalesce(url_host(url), host)


def host_of(url: Column) -> Column:
    """Host with port and without userinfo, case kept; null when empty."""
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/?#]*)", 1), F.lit(""))


def is_valid_hostname(name: Column) -> Column:
    """At most 253 bytes, labels of 1 to 63 signs of [a-z0-9-] without a hyphen at an edge."""
    return (F.octet_length(name) <= 253) & name.rlike(r"^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)*\z")


def sanitize_host(raw: Column) -> Column:
    """A bare domain name from a listed one, null when it isn't one.

    White space, one leading ``*.`` and one trailing dot go; the name is lowered, needs a dot, must not be an IP address.
    """
    name = F.lower(F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), r"^\*\.", ""))
    name = F.regexp_replace(name, r"\.$", "")
    ip = name.rlike(r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\z")
    return F.when(name.contains(".") & ~ip & is_valid_hostname(name), name)


def reverse_host(host: Column) -> Column:
    """``com.acme`` to ``acme.com``."""
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def domain_of_reverse_dns(name: Column) -> Column:
    """``com.Acme/server`` to ``acme.com``; null without a slash or with fewer than two labels."""
    head = F.substring_index(name, "/", 1)
    return F.when(name.contains("/") & (F.size(F.split(head, r"\.")) >= 2), F.lower(reverse_host(head)))


def domains_of_server(name: Column, remote_urls: Column) -> Column:
    """Hosts of a server's remotes in order, then the domain of its name."""
    remotes = F.filter(F.transform(F.coalesce(remote_urls, F.array().cast("array<string>")), url_host), lambda h: h.isNotNull())
    return F.array_compact(F.concat(remotes, F.array(domain_of_reverse_dns(name))))


def domain_of_repository(full_name: Column, homepage: Column) -> Column:
    """Host of the homepage, else the project site when the repository is named like it."""
    owner, repo = F.substring_index(full_name, "/", 1), F.substring_index(full_name, "/", -1)
    site = F.lower(F.concat(owner, F.lit(".github.io")))
    return F.coalesce(url_host(F.trim(homepage)), F.when(full_name.contains("/") & (F.lower(repo) == site), site))


def registrable_domain(host: Column) -> Column:
    """Public suffix plus one label; null for a name that is itself a suffix (G21, subset of the public list)."""
    low = F.lower(host)
    n = F.size(F.split(low, r"\."))
    two = F.substring_index(low, ".", -2)
    return F.when(two.isin(PUBLIC_SUFFIXES), F.when(n >= 3, F.substring_index(low, ".", -3))).when((n >= 2) & ~low.rlike(r"^\.|\.\.|\.$"), two)


def registrable_equal(a: Column, b: Column) -> Column:
    """Equal without case, or of one registrable domain; false when either has none (G20, ASCII names)."""
    return F.coalesce(F.lower(a) == F.lower(b), F.lit(False)) | F.coalesce(registrable_domain(a) == registrable_domain(b), F.lit(False))


def is_infra_host(host: Column) -> Column:
    """Whether the host belongs to a domain of INFRA_DOMAINS."""
    return F.coalesce(registrable_domain(host), F.lower(host)).isin(INFRA_DOMAINS)


def hosts_of_text(text: Column) -> Column:
    """Hosts of all http(s) URLs of a text in order, infrastructure dropped (G14); repeats stay."""
    hosts = F.transform(F.regexp_extract_all(text, F.lit(TEXT_URL), 1), url_host)
    return F.filter(hosts, lambda h: h.isNotNull() & ~is_infra_host(h))


def is_catalog_rel(rel: Column) -> Column:
    """Whether a rel attribute has the token ai-catalog in any case."""
    return F.array_contains(F.split(F.lower(rel), r"\s+"), "ai-catalog")


def bare_content_type(ct: Column) -> Column:
    """A content type without parameters, 'unknown' when empty."""
    bare = F.trim(F.substring_index(F.coalesce(ct, F.lit("")), ";", 1))
    return F.when(bare == "", "unknown").otherwise(bare)


def is_json_content_type(ct: Column) -> Column:
    """Whether a content type mentions json."""
    return F.coalesce(F.lower(ct).contains("json"), F.lit(False))


def looks_like_json(ct: Column, body: Column) -> Column:
    """By content type, or by the first sign of the body that isn't white space."""
    return is_json_content_type(ct) | F.coalesce(body.rlike(r"^[ \t\r\n]*[\[{]"), F.lit(False))
