"""Network addresses: any spelling as 128 bits, tunnels unwrapped, longest prefix of a table of networks."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.words import bound

# Networks that are not for public traffic, and the public ones inside them (special-purpose address registries).
CLOSED = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "5f00::/16", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8",
)
OPEN = ("192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
_MAPPED, _SIX_TO_FOUR, _NAT64, _TEREDO = "0" * 20 + "ffff", "2002", "0064ff9b" + "0" * 16, "20010000"


def _v4_hex(text: Column) -> Column:
    """Eight hex digits of a dotted address of four plain numbers up to 255; null for other texts (a leading zero could mean octal)."""
    parts = F.transform(F.split(text, r"\."), lambda p: F.when(p.rlike("^(?:0|[1-9][0-9]{0,2})$"), p.cast("int")))
    good = text.rlike(r"^[0-9.]+$") & (F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(p.between(0, 255), F.lit(False)))
    return F.when(good, F.array_join(F.transform(parts, lambda p: F.lower(F.lpad(F.hex(p.cast("long")), 2, "0"))), ""))


def _v6_hex(text: Column) -> Column:
    """32 hex digits of an address of colon groups, of which one run of zeros may be left out and the last two may be dotted."""
    tail = F.regexp_extract(text, r"([0-9.]+)$", 1)
    dotted = F.when(tail.contains("."), _v4_hex(tail))
    plain = F.when(tail.contains("."), F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(tail)), F.substring(dotted, 1, 4), F.lit(":"), F.substring(dotted, 5, 4))).otherwise(text)

    def groups(t: Column) -> Column:
        halves = F.split(t, "::", -1)
        of = lambda h: F.filter(F.split(F.coalesce(h, F.lit("")), ":", -1), lambda g: g != "")
        left, right = of(F.get(halves, F.lit(0))), of(F.get(halves, F.lit(1)))
        gap = F.lit(8) - F.size(left) - F.size(right)
        cut = F.size(halves) == 2
        whole = F.when(cut & (gap >= 1), F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right)).when(~cut & (gap == 0), left)
        tidy = F.forall(halves, lambda h: (h == "") | h.rlike("^[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*$")) & (F.size(halves) <= 2)
        return F.when(tidy, F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))

    return F.when(text.contains(":"), bound(plain, groups))


def address_hex(text: Column) -> Column:
    """8 hex digits for a version 4 address, 32 for version 6, null for what is no address. Brackets and a zone behind % are passed over."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.trim(text), r"^\[|\]$", ""), r"%\w+$", ""))
    return F.coalesce(_v4_hex(bare), _v6_hex(bare))


def unwrapped(hexed: Column) -> Column:
    """The version 4 address that a mapped, 6to4 or NAT64 address carries, else the address itself."""
    v6 = F.length(hexed) == 32
    return F.when(v6 & (hexed.startswith(_MAPPED) | hexed.startswith(_NAT64)), F.substring(hexed, 25, 8)).when(v6 & hexed.startswith(_SIX_TO_FOUR), F.substring(hexed, 5, 8)).otherwise(hexed)


def bits_of(hexed: Column) -> Column:
    """'4:' or '6:' and the address's bits."""
    part = lambda i: F.lpad(F.conv(F.substring(hexed, i, 8), 16, 2), 32, "0")
    return F.when(F.length(hexed) == 8, F.concat(F.lit("4:"), part(1))).when(F.length(hexed) == 32, F.concat(F.lit("6:"), *(part(i) for i in (1, 9, 17, 25))))


def carried_bits(text: Column) -> Column:
    """The bits of what an address carries; each step is evaluated once."""
    return bound(address_hex(text), lambda h: bound(unwrapped(h), bits_of))


def prefix_of(network: str) -> str:
    """A network's version and leading bits."""
    n = ipaddress.ip_network(network, strict=False)
    return f"{n.version}:{int(n.network_address):0{n.max_prefixlen}b}"[: 2 + n.prefixlen]


def is_public(bits: Column) -> Column:
    """Whether the longest network of the two tables that holds the address is a public one; an address in none is."""
    table = {prefix_of(n): False for n in CLOSED} | {prefix_of(n): True for n in OPEN}
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    longest_first = sorted({len(p) for p in table}, reverse=True)
    return F.coalesce(*(F.when(F.length(bits) >= n, known[F.substring(bits, 1, n)]) for n in longest_first), F.lit(True))


def address_fault(text: Column) -> Column:
    """Why an address must not be called: NOT_AN_ADDRESS, TEREDO_IP, NON_GLOBAL_IP; null for a public one. Tunnels count as what they carry."""

    def judged(h: Column) -> Column:
        teredo = (F.length(h) == 32) & h.startswith(_TEREDO)
        return F.when(h.isNull(), "NOT_AN_ADDRESS").when(teredo, "TEREDO_IP").when(~bound(bound(unwrapped(h), bits_of), is_public), "NON_GLOBAL_IP")

    return bound(address_hex(text), judged)


def matched_networks(addresses: DataFrame, networks: DataFrame, column: str = "address") -> DataFrame:
    """Addresses with the longest of any number of networks (network as '10.0.0.0/8' in any spelling, label) that holds each, null for none.

    An address has one key per prefix length that the table has; the join is an equality, and the longest match stays.
    """
    base, size = F.substring_index("network", "/", 1), F.substring_index("network", "/", -1).cast("int")
    nets = networks.select("label", "network", F.substring(bound(address_hex(base), bits_of), F.lit(1), size + 2).alias("prefix"), (size + 2).alias("n")).filter("prefix IS NOT NULL")
    lengths = sorted(r.n for r in nets.select("n").distinct().collect())
    marked = addresses.withColumn("_bits", carried_bits(F.col(f"`{column}`")))
    keys = marked.select(F.col(f"`{column}`").alias("_a"), "_bits").distinct().filter("_bits IS NOT NULL").withColumn("n", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>"))).filter(F.length("_bits") >= F.col("n")).withColumn("prefix", F.substring(F.col("_bits"), F.lit(1), F.col("n")))
    best = keys.join(nets, ["n", "prefix"]).groupBy("_a").agg(F.max_by(F.struct("network", "label"), F.struct("n", "network")).alias("m"))
    return marked.join(best, F.col(f"`{column}`") == F.col("_a"), "left").select(*addresses.columns, F.col("m.network").alias("network"), F.col("m.label").alias("label"))
