"""URL safety: scheme, host names, host characters and resolved addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions import urls
from weir.functions.text import let, or_empty

# Host names and networks that are never fetched.
BLOCKED_HOSTS = [
    "localhost", "metadata.google.internal", "metadata.googleusercontent.com", "169.254.169.254",
]
BLOCKED_NETWORKS = [
    "127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "::1/128", "fd00::/8",
]
HOST_CHARACTERS = r"^[\p{L}\p{M}\p{Nd}\-.。．｡]*$"
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"


def guard_reason(url: Column) -> Column:
    """Why a URL is refused before any lookup; NULL when it may go on. No URL counts as an empty one."""
    url = or_empty(url)
    sch = urls.scheme(url)

    def by_host(host: Column) -> Column:
        named = urls.any_of([(host == b) | host.endswith("." + b) for b in BLOCKED_HOSTS])
        literal_v6 = host.contains(":")
        return (
            F.when(~sch.isin("http", "https"), F.concat(F.lit("unsupported scheme: "), sch))
            .when(host == "", "no hostname")
            .when(named, "reserved hostname")
            .when(~literal_v6 & ~host.rlike(HOST_CHARACTERS), "invalid hostname characters")
        )

    return let(urls.hostname(url), by_host)


def ipv4_number(ip: Column) -> Column:
    """Dotted address as a whole number; NULL for anything else."""
    fold = F.aggregate(F.split(ip, r"\."), F.lit(0).cast("bigint"), lambda acc, x: acc * 256 + x.cast("bigint"))
    return F.when(ip.rlike(IPV4), fold)


def ipv6_hex(ip: Column) -> Column:
    """Address as 32 hex digits, so that ranges compare as text; NULL for anything else."""
    groups = lambda text: F.filter(F.split(text, ":"), lambda g: g != "")
    padded = lambda arr: F.array_join(F.transform(arr, lambda g: F.lpad(g, 4, "0")), "")

    def expand(a: Column) -> Column:
        left = F.when(a.contains("::"), F.substring_index(a, "::", 1)).otherwise(a)
        right = F.when(a.contains("::"), F.substring_index(a, "::", -1)).otherwise("")
        head, tail = padded(groups(left)), padded(groups(right))
        gap = F.greatest(F.lit(32) - F.length(head) - F.length(tail), F.lit(0))
        return F.concat(head, F.repeat(F.lit("0"), gap), tail)

    # A dotted tail (::ffff:1.2.3.4) counts as its two hex groups.
    dotted = F.regexp_extract(ip, r"([0-9]+\.[0-9.]+)$", 1)
    number = ipv4_number(dotted)
    low = F.when(
        number.isNotNull(),
        F.concat(
            F.regexp_replace(ip, r"[0-9]+\.[0-9.]+$", ""),
            F.hex(F.shiftright(number, 16)), F.lit(":"), F.hex(number.bitwiseAND(F.lit(65535))),
        ),
    ).otherwise(F.regexp_replace(ip, "%.*$", ""))
    return F.when(ip.contains(":"), let(F.lower(low), expand))


def network_bounds(network: str) -> tuple[int, str | int, str | int]:
    """(version, lowest, highest) of one network, in the form the address columns use."""
    import ipaddress

    net = ipaddress.ip_network(network)
    if net.version == 4:
        return 4, int(net.network_address), int(net.broadcast_address)
    return 6, f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}"


def in_networks(ip: Column, networks: list[str] | None = None) -> Column:
    """True when the address lies in one of the networks; a constant range test, not a join."""
    bounds = [network_bounds(n) for n in (networks or BLOCKED_NETWORKS)]

    def four(n: Column) -> Column:
        tests = [n.between(lo, hi) for version, lo, hi in bounds if version == 4]
        return urls.any_of(tests) if tests else F.lit(False)

    def six(h: Column) -> Column:
        tests = [h.between(lo, hi) for version, lo, hi in bounds if version == 6]
        return urls.any_of(tests) if tests else F.lit(False)

    return F.coalesce(let(ipv4_number(ip), four), F.lit(False)) | F.coalesce(let(ipv6_hex(ip), six), F.lit(False))


def with_guard(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``reason`` (NULL when fine) and ``allowed``; names and characters only."""
    return df.withColumn("reason", guard_reason(F.col(url))).withColumn("allowed", F.col("reason").isNull())


def with_address_guard(df: DataFrame, dns: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``reason``/``allowed`` including resolved addresses.

    ``dns(host, ip)`` is a snapshot of lookups. It shrinks to one verdict per
    host before the join; URLs of one busy host are split over tasks by the
    adaptive skew join. Literal addresses need no lookup; a host without an
    entry is refused.
    """
    verdicts = dns.groupBy(F.lower("host").alias("_host")).agg(
        F.bool_or(in_networks(F.col("ip"))).alias("_bad")
    )
    literal = F.col("_host").rlike(IPV4) | F.col("_host").contains(":")
    looked_up = F.when(literal, in_networks(F.col("_host"))).otherwise(F.col("_bad"))
    return (
        df.withColumn("_host", urls.hostname(or_empty(F.col(url))))
        .join(verdicts, "_host", "left")
        .withColumn(
            "reason",
            F.coalesce(
                guard_reason(F.col(url)),
                F.when(looked_up.isNull(), "cannot resolve hostname").when(looked_up, "private address"),
            ),
        )
        .withColumn("allowed", F.col("reason").isNull())
        .drop("_host", "_bad")
    )


def preflight(entries: DataFrame, run: str, dns: DataFrame | None = None) -> DataFrame:
    """Per run: how many URLs there are and how many the guard refuses; one refusal stops the run.

    Literal private addresses are refused always, resolved ones with the lookups ``dns(host, ip)``.
    Without lookups a host name counts as public.
    """
    if dns is not None:
        checked = with_address_guard(entries, dns)
    else:
        host = urls.hostname(or_empty(F.col("url")))
        literal = let(host, lambda h: (h.rlike(IPV4) | h.contains(":")) & in_networks(h))
        reason = F.coalesce(guard_reason(F.col("url")), F.when(literal, "private address"))
        checked = entries.withColumn("allowed", reason.isNull())
    return checked.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_urls"),
        F.count_if(~F.col("allowed")).alias("n_blocked"),
    ).withColumn("may_run", F.col("n_blocked") == 0)
