"""URL and domain expressions. All are built-in column expressions, none is a Python function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Country-code second levels that a registrable domain skips, fixed values of two tables that differ.
REGISTRABLE_SECOND_LEVEL = ("co", "com", "org", "net", "gov", "edu", "ac", "or", "ne", "go", "gob", "nom", "me")
SITE_SECOND_LEVEL = ("co", "com", "org", "net", "gov", "ac", "edu")

_SPACE = r"[\s ]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def host(url: str | Column) -> Column:
    """The lower-case host of an absolute URL, without user and port; '' if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def scheme(url: str | Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(_col(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit(""))


def path(url: str | Column) -> Column:
    """The path of an absolute URL; '' if there is none."""
    return F.coalesce(F.regexp_extract(_col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), F.lit(""))


def query(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(_col(url), r"\?([^#]*)", 1), F.lit(""))


def strip_www(h: Column) -> Column:
    return F.regexp_replace(h, r"^www\.", "")


def normalize_domain(value: str | Column) -> Column:
    """Lower-case host of a bare domain or a URL: no scheme, user, path, port, outer dots or leading www."""
    v = F.lower(F.regexp_replace(_col(value), rf"^{_SPACE}|{_SPACE}$", ""))
    h = F.regexp_extract(v, r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.coalesce(strip_www(F.regexp_replace(h, r"^\.+|\.+$", "")), F.lit(""))


def same_site(a: str | Column, b: str | Column) -> Column:
    """Equal hosts but for a leading www.; two URLs without a host are the same site."""
    return strip_www(host(a)) == strip_www(host(b))


def trivial_redirect(a: str | Column, b: str | Column) -> Column:
    """Only scheme, www. or trailing slashes differ."""
    return same_site(a, b) & (F.rtrim(path(a), F.lit("/")) == F.rtrim(path(b), F.lit("/"))) & (query(a) == query(b))


def norm_url(url: str | Column) -> Column:
    """Host without www. and path without trailing slashes, in lower case; the query is dropped."""
    return F.lower(F.concat(strip_www(host(url)), F.rtrim(path(url), F.lit("/"))))


def url_key(url: str | Column) -> Column:
    """The URL without fragment and one trailing slash."""
    return F.regexp_replace(F.regexp_replace(_col(url), r"#.*$", ""), r"/$", "")


def segments(url: str | Column) -> Column:
    """The non-empty path segments."""
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def path_depth(url: str | Column) -> Column:
    return F.size(segments(url))


def url_template(url: str | Column) -> Column:
    """The path's shape: its first segment (a year as {year}) and a star for each other one; '/*' for a single segment."""
    segs = segments(url)
    n = F.size(segs)
    first = F.when(segs[0].rlike(r"^(19|20)\d{2}$"), F.lit("{year}")).otherwise(segs[0])
    tail = F.when(path(url).endswith("/"), F.lit("/")).otherwise(F.lit(""))
    shape = F.when(n == 1, F.concat(F.lit("/*"), tail)).otherwise(F.concat(F.lit("/"), first, F.repeat(F.lit("/*"), n - 1), tail))
    return F.when(n == 0, F.lit("/")).otherwise(shape)


def registrable(h: Column) -> Column:
    """The last two labels of a host, three under a country code's second level."""
    parts = F.split(strip_www(F.lower(h)), r"\.")
    n = F.size(parts)
    deep = (n >= 3) & (F.length(F.element_at(parts, -1)) == 2) & F.try_element_at(parts, F.lit(-2)).isin(*REGISTRABLE_SECOND_LEVEL)
    return F.array_join(F.slice(parts, -F.least(n, F.when(deep, F.lit(3)).otherwise(F.lit(2))), F.lit(3)), ".")


def site_name(h: Column) -> Column:
    """The registrable label of a host: 'x' of x.com and of x.co.uk."""
    parts = F.split(h, r"\.")
    n = F.size(parts)
    deep = (n >= 3) & (F.length(F.element_at(parts, -1)) == 2) & F.try_element_at(parts, F.lit(-2)).isin(*SITE_SECOND_LEVEL)
    return F.when(deep, F.try_element_at(parts, F.lit(-3))).when(n >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(parts[0])


def host_matches(h: Column, domain: Column | str) -> Column:
    """Equal to the domain or below it."""
    d = F.lit(domain) if isinstance(domain, str) else domain
    return (d != "") & ((h == d) | h.endswith(F.concat(F.lit("."), d)))


#: Tracking of affiliates: (label, host part, pattern of the query), in order, fixed values.
AFFILIATE_RULES = (
    ("Amazon tag=", "amazon.", r"(^|&)tag="),
    ("Viator pid=", "viator.com", r"(^|&)pid=p\d+"),
    ("Booking.com aid=", "booking.com", r"(^|&)aid=\d+"),
    ("GetYourGuide partner_id=", "getyourguide.", r"partner_id="),
    ("Expedia affcid=", "expedia.", r"affcid="),
    ("affiliate click id", "", r"(^|&)(irclickid|clickid|affiliate_id|aff_id|affid|afftrack)="),
)
#: Hosts of affiliate networks, fixed values.
AFFILIATE_HOSTS = (
    "awin1.com", "shareasale.com", "shrsl.com", "anrdoezrs.net", "dpbolvw.net", "tkqlhce.com", "jdoqocy.com", "kqzyfj.com", "linksynergy.com", "go.skimresources.com", "viglink.com", "prf.hn",
    "partner.booking.com", "amzn.to", "cj.dotomi.com", "sjv.io", "pxf.io", "go2cloud.org", "tp.media", "c.travelpayouts.com", "redirect.viglink.com",
)


def affiliate_kind(url: str | Column) -> Column:
    """A label if the URL carries affiliate tracking, else ''."""
    h, q = host(url), F.lower(query(url))
    out = F.when(F.lit(False), "")
    for label, part, pattern in AFFILIATE_RULES:
        out = out.when((h.contains(part) if part else F.lit(True)) & q.rlike(pattern), label)
    network = h.startswith("affiliate.")
    for name in AFFILIATE_HOSTS:
        network = network | h.contains(name)
    return out.when(network, h).otherwise("")


#: Platforms by host fragment, in order, fixed values.
SOCIAL_PLATFORMS = (
    ("facebook.com", "Facebook"), ("fb.com", "Facebook"), ("fb.me", "Facebook"), ("instagram.com", "Instagram"), ("twitter.com", "X / Twitter"), ("x.com", "X / Twitter"), ("linkedin.com", "LinkedIn"),
    ("youtube.com", "YouTube"), ("youtu.be", "YouTube"), ("tiktok.com", "TikTok"), ("pinterest.", "Pinterest"), ("yelp.com", "Yelp"), ("tripadvisor.", "TripAdvisor"), ("threads.net", "Threads"),
    ("threads.com", "Threads"), ("reddit.com", "Reddit"), ("snapchat.com", "Snapchat"), ("t.me", "Telegram"), ("telegram.me", "Telegram"), ("wa.me", "WhatsApp"), ("whatsapp.com", "WhatsApp"),
    ("discord.gg", "Discord"), ("discord.com", "Discord"), ("medium.com", "Medium"), ("github.com", "GitHub"), ("bsky.app", "Bluesky"),
)


def social_platform(h: Column) -> Column:
    """The platform whose fragment begins the host or one of its labels; null if none."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for part, name in SOCIAL_PLATFORMS:
        out = out.when(h.startswith(part) | h.contains("." + part), name)
    return out


def csp_allows(sources: Column, script: Column, page: Column) -> Column:
    """Whether a list of policy sources lets the page load a script."""
    h, s = host(script), scheme(script)

    def one(token: Column) -> Column:
        t = F.lower(token)
        own = t == "'self'"
        bare = F.regexp_replace(t, r"^[a-z][a-z0-9+.-]*://", "")
        name = F.regexp_extract(bare, r"^([^:/]*)", 1)
        port = F.regexp_extract(bare, r"^[^:/]*:(\d+|\*)", 1)
        own_port = F.regexp_extract(script, r"^[a-z]+://[^/?#:]*:(\d+)", 1)
        named_scheme = F.regexp_extract(t, r"^([a-z][a-z0-9+.-]*)://", 1)
        fits = F.when(name.startswith("*."), h.endswith(F.substring(name, F.lit(2), F.length(name)))).otherwise(h == name)
        ports = (port == "") | (port == "*") | (port == own_port)
        return (t == "*") | (own & (h == host(page))) | (F.rtrim(t, F.lit(":")) == s) & t.endswith(":") | (fits & (name != "") & ports & ((named_scheme == "") | (named_scheme == s)))

    return F.exists(sources, one)
