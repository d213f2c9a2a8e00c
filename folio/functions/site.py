"""Hosts: registrable domain, same site, trackers, relation of two addresses, address policy. Native expressions."""

from __future__ import annotations

from ipaddress import ip_address

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["is_private_v4", "is_tracker", "is_tracker_host", "matches_host", "policy_error", "registrable_domain", "same_site", "same_site_hosts", "site_relation"]

#: Suffixes under which a name is registered at the third label (fixed values).
SUFFIXES = (
    "co.uk org.uk ac.uk gov.uk me.uk net.uk sch.uk com.au net.au org.au edu.au gov.au co.nz net.nz org.nz govt.nz co.za org.za co.jp or.jp ne.jp ac.jp go.jp "
    "com.br net.br org.br gov.br com.cn net.cn org.cn gov.cn edu.cn com.hk com.sg com.tr com.mx com.ar com.tw co.kr or.kr co.in net.in org.in gov.in com.ua com.pl com.es com.it "
    "co.il com.my com.ph com.vn com.co com.pe com.eg com.sa com.ng com.pk com.bd com.ec com.uy com.ve com.do "
    "org.ru net.ru pp.ru com.ru msk.ru spb.ru edu.ru gov.ru int.ru ac.ru org.ua net.ua kiev.ua org.kz net.kz "
    "github.io gitlab.io pages.dev workers.dev vercel.app netlify.app herokuapp.com azurewebsites.net cloudfront.net s3.amazonaws.com web.app firebaseapp.com appspot.com blogspot.com "
    "wordpress.com myshopify.com surge.sh fly.dev onrender.com koyeb.app"
).split()
#: Hosts of measurement, advertising and chat; of entries with a path only the host counts (fixed values).
TRACKERS = (
    "google-analytics.com googletagmanager.com googletagservices.com googlesyndication.com googleadservices.com doubleclick.net adservice.google.com analytics.google.com segment.com segment.io "
    "amplitude.com mixpanel.com heapanalytics.com fullstory.com hotjar.com hotjar.io clarity.ms mouseflow.com luckyorange.com quantserve.com scorecardresearch.com chartbeat.com chartbeat.net parsely.com "
    "newrelic.com nr-data.net sentry.io bugsnag.com rollbar.com datadoghq.com logrocket.com logrocket.io smartlook.com matomo.cloud statcounter.com yandex.ru/metrika mc.yandex.ru top-fwz1.mail.ru "
    "top.mail.ru tns-counter.ru mediascope.net adriver.ru rambler.ru/counter vk.com/rtrg criteo.com criteo.net "
    "adnxs.com rubiconproject.com pubmatic.com openx.net casalemedia.com taboola.com outbrain.com sharethrough.com smartadserver.com adform.net yieldmo.com indexww.com 3lift.com bidswitch.net adsrvr.org "
    "everesttech.net moatads.com adsafeprotected.com serving-sys.com flashtalking.com teads.tv buysellads.com carbonads.net media.net amazon-adsystem.com buzzoola.com sape.ru relap.io digitaltarget.ru "
    "betweendigital.com rtb-media.ru "
    "facebook.net connect.facebook.net fbcdn.net twitter.com/i/adsct ads-twitter.com t.co linkedin.com/px licdn.com/li.lms-analytics snapchat.com tiktok.com/i18n analytics.tiktok.com pinterest.com/ct "
    "reddit.com/pixel bat.bing.com clarity.microsoft.com "
    "cookiebot.com cookielaw.org onetrust.com trustarc.com usercentrics.eu intercom.io intercomcdn.com zdassets.com zopim.com livechatinc.com crisp.chat tawk.to drift.com hubspot.com hs-scripts.com "
    "hs-analytics.net jivosite.com jivo.ru carrotquest.io usedesk.ru verbox.ru marketo.net pardot.com mktoresp.com omtrdc.net demdex.net 2o7.net"
).split()
TRACKER_HOSTS = list(dict.fromkeys(t.split("/")[0] for t in TRACKERS))

_V4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def _folded(host: Column) -> Column:
    from folio.functions.text import ascii_lower

    return ascii_lower(F.regexp_replace(host, r"\.+$", ""))


def registrable_domain(host: Column) -> Column:
    """Last two labels of a host, three under a suffix of two; numbers and short hosts as they are."""
    h = _folded(host)
    labels = F.split(h, r"\.")
    n = F.size(labels)
    two = F.array_join(F.slice(labels, -2, 2), ".")
    short = (n < 3) | h.rlike(_V4) | F.contains(h, F.lit(":"))
    return F.when(short, h).when(two.isin(*SUFFIXES), F.array_join(F.slice(labels, -3, 3), ".")).otherwise(two)


def same_site(a: Column, b: Column) -> Column:
    return (a != "") & (registrable_domain(a) == registrable_domain(b))


def _registrable_text(host: str) -> str:
    host = host.rstrip(".").lower()
    try:
        ip_address(host.strip("[]"))
        return host
    except ValueError:
        pass
    labels = host.split(".")
    return host if len(labels) < 3 else ".".join(labels[-3 if ".".join(labels[-2:]) in SUFFIXES else -2 :])


def same_site_hosts(a: str, b: str) -> bool:
    return bool(a) and _registrable_text(a) == _registrable_text(b)


def is_tracker_host(host: str) -> bool:
    host = host.rstrip(".").lower()
    parts = host.split(".")
    tails = {".".join(parts[k:]) for k in range(len(parts))}
    return not tails.isdisjoint(TRACKER_HOSTS) or _registrable_text(host) in TRACKER_HOSTS


def is_tracker(host: Column) -> Column:
    """Whether the host, or what follows one of its dots, is on the list."""
    h = _folded(host)
    parts = F.split(h, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.arrays_overlap(tails, F.array(*map(F.lit, TRACKER_HOSTS))) | registrable_domain(host).isin(*TRACKER_HOSTS)


def _last_two(host: Column) -> Column:
    return F.array_join(F.slice(F.split(F.lower(host), r"\."), F.when(F.size(F.split(host, r"\.")) > 2, -2).otherwise(1), F.lit(2)), ".")


def site_relation(referer: Column, url: Column) -> Column:
    """``none``, ``same-origin``, ``same-site`` (the last two labels alone) or ``cross-site`` of two absolute addresses."""

    def origin(u: Column) -> Column:
        scheme, host, port = (F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d+))?", k)) for k in (1, 2, 3))
        port = F.when(port != "", port).when(scheme == "https", "443").when(scheme == "http", "80").otherwise("")
        return F.concat_ws("|", scheme, host, port)

    host = lambda u: F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(referer.isNull(), "none").when(origin(referer) == origin(url), "same-origin").when(_last_two(host(referer)) == _last_two(host(url)), "same-site").otherwise("cross-site")


def matches_host(host: Column, pattern: Column) -> Column:
    """The host itself or one below it."""
    p = F.lower(F.regexp_replace(pattern, r"^\.+", ""))
    return (host == p) | F.endswith(host, F.concat(F.lit("."), p))


def is_private_v4(host: Column) -> Column:
    """Addresses that are not public: loopback, private, link-local, shared, reserved, documentation and the like."""
    o = [F.try_element_at(F.split(host, r"\."), F.lit(k)).try_cast("int") for k in (1, 2, 3, 4)]
    a, b, c = o[0], o[1], o[2]
    return host.rlike(_V4) & (
        a.isin(127, 10, 0) & (~(a == 0) | (host == "0.0.0.0"))
        | (a == 172) & b.between(16, 31)
        | (a == 192) & (b == 168)
        | (a == 169) & (b == 254)
        | (a == 192) & (b == 0) & c.isin(0, 2)
        | (a == 198) & (b == 51) & (c == 100)
        | (a == 203) & (b == 0) & (c == 113)
        | (a == 100) & b.between(64, 127)
        | (a == 198) & b.between(18, 19)
        | (a >= 240)
    )


def _private_v6(host: str) -> bool:
    try:
        ip = ip_address(host.strip("[]"))
    except ValueError:
        return False
    if ip.version == 4:
        return False
    if ip.ipv4_mapped is not None:
        v = ip.ipv4_mapped
        o = v.packed
        return v.is_loopback or v.is_link_local or v.is_unspecified or o[0] >= 240 or o[0] == 10 or o[0] == 172 and 16 <= o[1] < 32 or o[:2] == b"\xc0\xa8" or o[0] == 100 and 64 <= o[1] < 128 \
            or o[:3] in (b"\xc0\0\0", b"\xc0\0\2", b"\xc6\x33\x64", b"\xcb\0\x71") or o[0] == 198 and o[1] in (18, 19)
    return ip.is_loopback or ip.is_unspecified or int(ip) >> 121 == 0xFC >> 1 or int(ip) >> 118 == 0xFE80 >> 6


def _private_v6_column(host: Column) -> Column:
    @F.arrow_udf("boolean")
    def of(h: pa.Array) -> pa.Array:
        return pa.array([None if x is None else _private_v6(x) for x in h.to_pylist()], pa.bool_())

    return of(host)


def policy_error(url: Column, block_private: bool = True, allow: list[str] | None = None, deny: list[str] | None = None, v6: bool = True) -> Column:
    """Why an address must not be fetched: ``scheme``, ``no host``, ``host``, ``private address``; null if it may be.

    The deny list comes first, then the allow list if there is one, then addresses that are not public.
    """
    scheme = F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1))
    listed = lambda names: F.exists(F.array(*map(F.lit, names)), lambda p: matches_host(host, p))
    out = F.when(~scheme.isin("http", "https"), "scheme").when(host == "", "no host")
    if deny:
        out = out.when(listed(deny), "host")
    if allow:
        out = out.when(~listed(allow), "host")
    if block_private:
        private = is_private_v4(host)
        if v6:
            private = private | _private_v6_column(host)
        out = out.when(private, "private address").when((host == "localhost") | F.endswith(host, F.lit(".localhost")), "host")
    return out
