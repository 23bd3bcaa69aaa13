"""URLs taken apart as a browser does, in expressions: numeric hosts, default ports, dot segments, odd slashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _number(part: Column) -> Column:
    """One part of a numeric host: hexadecimal, octal or decimal; null if it is none of these."""
    base = lambda digits, b: F.conv(digits, b, 10).cast("decimal(20,0)")
    return (F.when(part.rlike("^0[xX]$"), F.lit(0).cast("decimal(20,0)")).when(part.rlike("^0[xX][0-9a-fA-F]{1,16}$"), base(F.substring(part, 3, 16), 16))
            .when(part.rlike("^0[0-7]{1,20}$"), base(part, 8)).when(part.rlike("^(0|[1-9][0-9]{0,18})$"), part.cast("decimal(20,0)")))


def ipv4(host: Column) -> Column:
    """(numeric, address): whether a host is a number in any spelling, and as which 32 bits; a null address is no valid one."""
    parts = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")

    def read(s: Column) -> Column:
        n = s["n"]
        last = F.element_at(n, -1)
        rest = F.slice(n, 1, F.size(n) - 1)
        ok = (F.size(n) <= 4) & F.forall(n, lambda x: x.isNotNull()) & F.forall(rest, lambda x: x < 256) & (last < F.pow(F.lit(256.0), 5 - F.size(n)))
        address = F.aggregate(F.transform(rest, lambda x, i: x.cast("long") * F.pow(F.lit(256.0), 3 - i).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x) + last.cast("long")
        return F.struct(s["numeric"].alias("numeric"), F.when(s["numeric"] & ok, address).alias("address"))

    numeric = F.element_at(parts, -1).rlike(r"^([0-9]+|0[xX][0-9a-fA-F]*)$")
    return let(F.struct(numeric.alias("numeric"), F.transform(parts, _number).alias("n")), read)


def dotted(address: Column) -> Column:
    return F.concat_ws(".", *[(F.shiftright(address, 24 - 8 * i).bitwiseAND(255)).cast("string") for i in range(4)])


def _escaped(text: Column, also: str) -> Column:
    """What may not stand in a path or query as it is, percent-encoded."""
    odd = f'[^!-~]|["<>{also}]'
    one = lambda c: F.when(c == " ", "%20").when(c.rlike(odd), F.call_function("url_encode", c)).otherwise(c)
    return F.when(text.rlike(odd), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def _path(path: Column) -> Column:
    """A path without dot segments; empty is the root."""
    dot, two = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"
    parts = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))
    kept = F.aggregate(parts,
        F.array().cast("array<string>"), lambda a, s: F.when(s.rlike(two), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(s.rlike(dot), a)
        .otherwise(F.concat(a, F.array(s))))
    tail = F.when(F.element_at(parts, -1).rlike(two) | F.element_at(parts, -1).rlike(dot), "/").otherwise("")
    return F.when(path == "", "/").when(~path.rlike(r"(?i)/(\.|%2e)"), path).otherwise(let(kept, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(F.size(k) > 0, tail).otherwise(""))))


_LABEL = "[A-Za-z][A-Za-z0-9-]*"
_SEGMENT = "[A-Za-z0-9_~-]+"
#: URLs that need no closer look: named host, no port, no dot segments, nothing to encode
_SIMPLE = rf"^(https?)://({_LABEL}(?:\.{_LABEL})*)((?:/{_SEGMENT}(?:\.{_SEGMENT})*)*/?)(\?[A-Za-z0-9=&_.~-]+)?(#.*)?$"


def _simple(u: Column) -> Column:
    """The parts of a URL that ``_SIMPLE`` holds for."""
    part = lambda i: F.regexp_extract(u, _SIMPLE, i)
    none = F.lit(None).cast("long")
    return F.struct(part(1).alias("scheme"), F.lit(False).alias("at"), F.lower(part(2)).alias("host"), none.alias("address"), none.alias("port"),
        F.when(part(3) == "", "/").otherwise(part(3)).alias("path"), part(4).alias("query"), F.lit(True).alias("valid"))


def bits(host: Column) -> Column:
    """The bits of an address in text, 32 for a dotted IPv4 and 128 for an IPv6 with or without brackets, as zeros and ones; null for anything else."""
    h = F.regexp_replace(F.lower(F.trim(host)), r"^\[|\]$|%.*$", "")
    binary = lambda n, wide: F.lpad(F.conv(n, 10, 2), wide, "0")
    four = lambda t: F.when(t.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(F.split(t, r"\."), lambda x: x.cast("int") < 256),
        F.array_join(F.transform(F.split(t, r"\."), lambda x: binary(x, 8)), ""))

    def six(t: Column) -> Column:
        tail = F.substring_index(t, ":", -1)  # the last 32 bits may be dotted
        whole = F.when(tail.contains("."),
            F.concat(F.substring(t, F.lit(1), F.length(t) - F.length(tail)), F.conv(F.substring(four(tail), 1, 16), 2, 16), F.lit(":"),
                F.conv(F.substring(four(tail), 17, 16), 2, 16))).otherwise(t)
        groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")

        def filled(w: Column) -> Column:
            front, back = groups(F.substring_index(w, "::", 1)), F.when(w.contains("::"), groups(F.substring_index(w, "::", -1))).otherwise(F.array().cast("array<string>"))
            n = F.size(front) + F.size(back)
            every = F.concat(front, F.when(w.contains("::") & (n < 8), F.array_repeat(F.lit("0"), 8 - n)).otherwise(F.array().cast("array<string>")), back)
            right = w.rlike("^[0-9a-f:]+$") & (F.size(F.split(w, "::")) <= 2) & (F.size(every) == 8) & F.forall(every, lambda g: F.length(g) <= 4)
            return F.when(right, F.array_join(F.transform(every, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), ""))

        return let(whole, filled)

    return F.coalesce(four(h), F.when(h.contains(":"), six(h)))


def parsed_url(url: str | Column) -> Column:
    """(scheme, user, host, address, port, path, query, valid) of a URL; ``address`` is that of a numeric host. International names keep their letters."""
    u = F.col(url) if isinstance(url, str) else url
    u = F.regexp_replace(F.regexp_replace(u, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")

    def split(s: Column) -> Column:
        scheme, rest = F.lower(F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.regexp_replace(F.regexp_replace(s, r"^[A-Za-z][A-Za-z0-9+.-]*:", ""), "#.*$", "")
        special = scheme.isin(*DEFAULT_PORTS)
        front = F.regexp_extract(rest, r"^([^?]*)", 1)
        front = F.when(special, F.regexp_replace(F.regexp_replace(front, r"\\", "/"), "^/*", "//")).otherwise(front)
        query = F.regexp_extract(rest, r"(?s)\?(.+)$", 1)
        return let(F.struct(scheme.alias("scheme"), special.alias("special"), front.alias("front"), query.alias("query")), authority)

    def authority(s: Column) -> Column:
        has = s["front"].startswith("//")
        own = F.when(has, F.regexp_extract(s["front"], "^//([^/]*)", 1)).otherwise("")
        user = F.regexp_extract(own, "^(.*)@", 1)
        place = F.regexp_replace(own, "^.*@", "")
        port = F.regexp_extract(place, r":(\d*)$", 1)
        host = F.lower(F.regexp_replace(place, r":\d*$", ""))
        host = F.when(host.contains("%"), F.coalesce(F.lower(F.call_function("try_url_decode", host)), host)).otherwise(host)
        host = F.translate(host, "０１２３４５６７８９．。", "0123456789..")
        path = F.when(has, F.regexp_replace(s["front"], "^//[^/]*", "")).otherwise(s["front"])
        return let(F.struct(s["scheme"].alias("scheme"), s["special"].alias("special"), (own.contains("@")).alias("at"), user.alias("user"),
                host.alias("host"), port.alias("port"), path.alias("path"), s["query"].alias("query"), ipv4(host).alias("ip")), done)

    def done(s: Column) -> Column:
        numeric = s["special"] & s["ip"]["numeric"]
        port = F.coalesce(s["port"].try_cast("long"), F.lit(-1))
        default = F.coalesce(*[F.when(s["scheme"] == k, p) for k, p in DEFAULT_PORTS.items()], F.lit(-2))
        host = F.when(numeric & s["ip"]["address"].isNotNull(), dotted(s["ip"]["address"])).otherwise(s["host"])
        bad = s["host"].rlike(r"[\x00-\x20#%/<>?@\\^|\x7f]") | (s["host"].contains(":") & ~s["host"].rlike(r"^\[[0-9a-f:.]+\]$")) | (numeric
                & s["ip"]["address"].isNull()) | (port > 65535) | (s["special"] & (s["host"] == ""))
        path = F.when(s["special"] | s["path"].startswith("/"), _path(s["path"])).otherwise(s["path"])
        return F.struct(s["scheme"].alias("scheme"), s["at"].alias("at"), host.alias("host"), F.when(numeric, s["ip"]["address"]).alias("address"),
            F.when((port >= 0) & (port != default), port).alias("port"), _escaped(path, "`{}").alias("path"),
            F.when(s["query"] != "", F.concat(F.lit("?"), _escaped(s["query"], "'"))).otherwise("").alias("query"),
            ((s["scheme"] != "") & ~bad).alias("valid"))

    simple = F.col(url) if isinstance(url, str) else url
    return F.when(simple.rlike(_SIMPLE), _simple(simple)).otherwise(let(u, split))
