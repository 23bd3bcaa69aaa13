"""Web pages: which URLs may be fetched, which are the same, and the text of pages."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.urls import bits, let, parsed_url

PAGES_IN_PART, RULE = 64, "\n\n---\n\n"
#: fixed values: services that expose private hosts
TUNNEL_SUFFIXES = ("ngrok.io", "ngrok-free.app", "ngrok.app", "ngrok.dev", "pinggy.io", "pinggy.link", "pinggy.online", "loca.lt")
#: fixed values: IPv4 ranges that are not globally routable
PRIVATE_RANGES = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.31.196.0/24", "192.52.193.0/24", "192.88.99.0/24", "192.168.0.0/16", "192.175.48.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "224.0.0.0/4", "240.0.0.0/4")
#: elements whose content is no text, tags that end a line, and the entities that are read
SKIPPED = "(?is)" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "noscript", "svg")) + "|<!--.*?-->"
BLOCK_ENDS = r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/title|/ul|/ol|/table|/section|/article|/nav|/header|/footer)\b[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def _private(u: Column) -> Column:
    """Whether a parsed URL's host is an address that is not globally routable."""
    inside = F.lit(False)
    for r in PRIVATE_RANGES:
        net = ipaddress.ip_network(r)
        inside |= u["address"].between(int(net.network_address), int(net.broadcast_address))
    # of IPv6 only 2000::/3 is routable, and of that not documentation, 6to4 and Teredo ranges
    six = F.when(u["host"].startswith("["), ~u["host"].rlike(r"^\[[23][0-9a-f]{0,3}:") | u["host"].rlike(r"^\[(2001:0{0,3}db8:|2001:0*:|2002:)"))
    return F.coalesce(inside, F.lit(False)) | F.coalesce(six, F.lit(False))


def filter_urls(urls: DataFrame, blocklists: DataFrame | None = None, url_col: str = "url") -> DataFrame:
    """Adds ``reason``: null for an http(s) URL of a public host without credentials, that no blocklist names. Hosts are read as a fetcher would: ``2130706433``, ``127.1`` and
    ``0x7f.0.0.1`` are 127.0.0.1.

    ``blocklists``: kind (``suffix`` or ``cidr``), value: hosts with all below them, and ranges of IPv4 or IPv6 addresses; other rows and unreadable values
    block nothing. Each
    distinct host meets the list by equal keys: its own suffixes, and the beginnings of its address as long as some range's."""

    def reason(u: Column) -> Column:
        tunnel = F.lit(False)
        for s in TUNNEL_SUFFIXES:
            tunnel |= (u["host"] == s) | u["host"].endswith("." + s)
        return (F.when(~u["scheme"].isin("http", "https"), "scheme").when(u["at"], "credentials").when(u["host"] == "localhost", "loopback")
            .when(~u["valid"], "host").when(_private(u), "private-address").when(tunnel, "tunnel"))

    if blocklists is None:
        return urls.withColumn("reason", let(parsed_url(url_col), reason))
    judged = urls.withColumn("__u", let(parsed_url(url_col), lambda u: F.struct(reason(u).alias("reason"), u["host"].alias("host"))))
    own = F.when(F.col("__u.reason").isNull(), F.col("__u.host"))
    blocked = blocked_hosts(judged.select(own.alias("host")).where("host is not null").distinct(), blocklists)
    rows = judged.withColumn("__host", own).join(blocked.select(F.col("host").alias("__host"), F.lit("blocked").alias("__blocked")), "__host", "left")
    return rows.select(*urls.columns, F.coalesce("__u.reason", "__blocked").alias("reason"))


def _range(value: Column) -> Column:
    """The key of an address range: the bits that its addresses begin with, behind 4 or 6."""
    b, size = bits(F.substring_index(value, "/", 1)), F.when(value.contains("/"), F.substring_index(value, "/", -1).try_cast("int"))
    length = F.coalesce(size, F.when(~value.contains("/"), F.length(b)))
    return F.when((length >= 0) & (length <= F.length(b)), F.concat(F.when(F.length(b) == 32, "4:").otherwise("6:"), F.left(b, length)))


def blocked_hosts(hosts: DataFrame, blocklists: DataFrame) -> DataFrame:
    """The distinct hosts (host) that a list blocks."""
    value = F.lower(F.trim("value"))
    key = F.when(F.col("kind") == "suffix", F.concat(F.lit("h:"), F.regexp_replace(value, r"^\*?\.+|\.+$", ""))).when(F.col("kind") == "cidr", _range(value))
    keys = blocklists.select(key.alias("key")).where("key is not null and key <> 'h:'").distinct()
    lengths = keys.where("key not like 'h:%'").select(F.left("key", F.lit(1)).alias("family"), (F.length("key") - 2).alias("n")).distinct().collect()  # 162 at most
    labels = F.split(F.regexp_replace("host", r"\.+$", ""), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    begins = F.array(*[F.when(F.length("__bits") == (32 if r["family"] == "4" else 128),
                F.concat(F.lit(f"{r['family']}:"), F.left("__bits", F.lit(r["n"])))) for r in lengths]) if lengths else F.array().cast("array<string>")
    candidates = F.when(F.col("__bits").isNull(), suffixes).otherwise(F.filter(begins, lambda k: k.isNotNull()))
    return hosts.withColumn("__bits", bits(F.col("host"))).select("host", F.explode(candidates).alias("key")).join(keys, "key", "left_semi").select("host").distinct()


def url_key(url: str | Column) -> Column:
    """What makes two URLs one: scheme, host and port, path without slashes at its end, query; never the fragment. Text that is no URL is its own key."""
    raw = F.trim(F.col(url) if isinstance(url, str) else url)

    def key(u: Column) -> Column:
        path = F.regexp_replace(u["path"], "/+$", "")
        return F.when(u["valid"],
            F.concat(u["scheme"], F.lit("://"), u["host"],
                F.when(u["port"].isNotNull(), F.concat(F.lit(":"), u["port"].cast("string"))).otherwise(""), F.when(path == "", "/").otherwise(path),
                u["query"]))

    return F.coalesce(let(parsed_url(raw), key), F.regexp_replace(F.lower(raw), "/+$", ""))


def dedupe_urls(urls: DataFrame) -> DataFrame:
    """(key, url, pos, duplicates): the first spelling of each key by position."""
    return urls.withColumn("key", url_key("url")).groupBy("key").agg(F.min_by("url", "pos").alias("url"), F.min("pos").alias("pos"), (F.count("*") - 1).alias("duplicates"))


def reconcile_results(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """(key, verdict): matched, missing, unexpected, repeated or empty. ``returned``: url, content."""
    want = requested.select(url_key("url").alias("key")).distinct().withColumn("wanted", F.lit(True))
    got = returned.select(url_key("url").alias("key"), "content").groupBy("key").agg(F.count("*").alias("n"), F.bool_or(F.coalesce(F.trim("content"), F.lit("")) != "").alias("filled"))
    verdict = F.when(F.col("wanted").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(~F.col("filled"), "empty").otherwise("matched")
    return want.join(got, "key", "full_outer").select("key", verdict.alias("verdict"))


def page_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds ``text``, the readable text: scripts, styles and tags out, blocks on lines, spaces collapsed."""
    t = F.regexp_replace(html_col, SKIPPED, " ")
    t = F.regexp_replace(t, BLOCK_ENDS, "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, "[ \t ]+", " "), r"\n\s*\n\s*\n+", "\n\n")
    return pages.withColumn("text", F.trim(F.regexp_replace(t, r"^\s+|\s+$", "")))


def text_profile(pages: DataFrame) -> DataFrame:
    """Pages and text lengths by host."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#:]*)", 1))
    n = F.length("text").cast("long")
    return pages.groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.sum(n).alias("chars"), F.max(n).alias("longest"))


def combine_pages(pages: DataFrame, group_col: str, run: int = PAGES_IN_PART) -> DataFrame:
    """(group, part, pages, combined): the pages of a group in order, with title and source, repeated texts dropped first.

    ``pages``: pos, title, url, text and the group. A page without a title is called by its URL; a null text is empty. A part holds the pages of ``run``
    positions, so a group of any size is rendered in pieces of a bounded
    number of pages; its parts in order, with the rule between them, are the whole."""
    own = F.struct("pos", F.coalesce(F.when(F.trim("title") != "", F.col("title")), "url", F.lit("")).alias("title"),
        F.coalesce("url", F.lit("")).alias("url"), F.coalesce("text", F.lit("")).alias("text"))
    first = pages.groupBy(group_col, F.sha2(F.coalesce("text", F.lit("")), 256).alias("__h")).agg(F.min_by(own, "pos").alias("p"))
    block = F.concat(F.lit("# "), F.col("p.title"), F.lit("\nSource: "), F.col("p.url"), F.lit("\n\n"), F.col("p.text"))
    g = first.groupBy(group_col, F.floor(F.col("p.pos") / run).alias("part")).agg(F.array_sort(F.collect_list(F.struct(F.col("p.pos").alias("pos"), block.alias("b")))).alias("l"))
    return g.select(group_col, "part", F.size("l").cast("long").alias("pages"), F.array_join(F.transform("l", lambda x: x["b"]), RULE).alias("combined"))
