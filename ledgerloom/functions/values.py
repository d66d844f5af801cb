"""Scalar functions over names, amounts and dates, as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# Scale words, currency rates to USD, corporate suffixes, plausible round sizes, cue phrases.
SCALES = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mm": 1e6, "mn": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9, "t": 1e12, "tn": 1e12, "trillion": 1e12}
FX_TO_USD = {"EUR": 1.08, "GBP": 1.27, "JPY": 0.0067, "CHF": 1.12, "CAD": 0.73, "AUD": 0.66, "CNY": 0.14, "USD": 1.0}
CORPORATE_SUFFIXES = ["inc", "incorporated", "corp", "corporation", "llc", "ltd", "limited", "co", "company", "gmbh", "plc", "sa", "ag"]
STAGE_BANDS = {"pre-seed": (5e4, 3e6), "seed": (1e5, 1.5e7), "series a": (2e6, 8e7), "series b": (1e7, 3e8), "series c": (2e7, 8e8)}
CUMULATIVE_CUE = r"(?i)\bto\s+date\b|\btotal\s+(?:raised|funding)\b|\bhas\s+raised\b|\bbringing\s+(?:its\s+)?total\b|\bcumulative\b|\braised\s+so\s+far\b"
EXTENSION_CUE = r"(?i)\bextension\b|\bextended\s+(?:its\s+)?series\b|\btop[- ]?up\b|\bsecond\s+close\b|\bfollow[- ]?on\s+tranche\b"
MONEY_SPELLING = r"(?i)^(?:usd|us\$|\$|€|£)?\s*(\d[\d,]*(?:\.\d+)?)\s*([a-z]+)?\s*(?:usd|dollars?)?$"
AMOUNT_SPELLING = r"(?i)^(?:usd|us\$|\$|€|£|eur|gbp)?\s*(\d[\d,]*(?:\.\d+)?)\s*([a-z]+)?$"
SCREEN_SUFFIX = r"\b(inc|incorporated|corp|corporation|co|company|llc|l\.l\.c|lp|l\.p|ltd|limited|holdings|technologies|technology|labs|systems|group|the)\b\.?"
RESOLVER_SUFFIX = r"\b(inc|corp|corporation|llc|ltd|limited|co|company)\b\.?"
MONEY_ATTRIBUTES = ["amount", "post_money", "valuation", "raised"]
DATE_ATTRIBUTES = ["date", "announced", "closed", "filed"]
AMENDMENT = r"(?i)(/A\b|amend|updated)"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"

WORD = r"[\p{L}\p{N}_]+"


def lookup(key: Column, table: dict, kind: str = "double") -> Column:
    """The table's value for a key, null for an unknown one."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key).cast(kind)


def number_text(x: Column) -> Column:
    """A double as text: integral ones without a point or exponent."""
    return F.when(x == F.floor(x), F.floor(x).cast("decimal(38,0)").cast("string")).otherwise(x.cast("string"))


def canonical_value(raw: Column) -> Column:
    """One spelling for one value: dates as they are, amounts in base units, other text in lower case.

    Null and blank become the empty string. A number followed by an unknown word is text.
    """
    s = F.btrim(F.coalesce(raw, F.lit("")), F.lit(" \t\r\n\f\x0b"))
    scale = F.lower(F.regexp_extract(s, MONEY_SPELLING, 2))
    # "40 usd" gives the unit to the scale group first; the spelling then has no scale.
    scale = F.when(scale.isin("usd", "dollar", "dollars"), "").otherwise(scale)
    n = F.regexp_replace(F.regexp_extract(s, MONEY_SPELLING, 1), ",", "").try_cast("double")
    factor = F.when(scale == "", F.lit(1.0)).otherwise(lookup(scale, SCALES))
    text = F.lower(F.regexp_replace(s, r"\s+", " "))
    return F.when(s == "", s).when(s.rlike(ISO_DATE), s).when(n.isNotNull() & factor.isNotNull(), number_text(n * factor)).otherwise(text)


def parsed_amount(raw: Column) -> Column:
    """Struct (num, unit, reject) of one money spelling."""
    s = F.btrim(F.coalesce(raw, F.lit("")), F.lit(" \t\r\n\f\x0b"))
    n = F.regexp_replace(F.regexp_extract(s, AMOUNT_SPELLING, 1), ",", "").try_cast("double")
    unit = F.lower(F.regexp_extract(s, AMOUNT_SPELLING, 2))
    reject = F.when(n.isNull(), "amount_unparseable").when((unit != "") & lookup(unit, SCALES).isNull(), "amount_unit_unknown")
    return F.struct(F.when(reject.isNull(), n).alias("num"), F.when(reject.isNull(), unit).alias("unit"), reject.alias("reject"))


def money_usd(raw: Column, currency: Column) -> Column:
    """Struct (usd, flags, reject): base-unit dollars. A missing currency rejects, it is never assumed."""
    a, cur = parsed_amount(raw), F.upper(currency)
    rate = lookup(cur, FX_TO_USD)
    reject = F.when(a["reject"].isNotNull(), a["reject"]).when(currency.isNull(), "currency_missing").when(rate.isNull(), F.concat(F.lit("fx_unknown_currency:"), currency))
    usd = a["num"] * F.when(a["unit"] == "", F.lit(1.0)).otherwise(lookup(a["unit"], SCALES)) * F.when(cur == "USD", F.lit(1.0)).otherwise(rate)
    flags = F.when(cur != "USD", F.array(F.concat(F.lit("fx:"), cur), F.lit("fx_static_rate"))).otherwise(F.array().cast("array<string>"))
    return F.struct(F.when(reject.isNull(), usd).alias("usd"), F.when(reject.isNull(), flags).alias("flags"), reject.alias("reject"))


def stage_plausible(stage: Column, usd: Column) -> Column:
    """False only if the stage has a band and the amount lies outside."""
    low = lookup(F.lower(stage), {k: v[0] for k, v in STAGE_BANDS.items()})
    high = lookup(F.lower(stage), {k: v[1] for k, v in STAGE_BANDS.items()})
    return F.coalesce(usd.between(low, high), F.lit(True))


def round_checks(passage: Column, usd: Column, stage: Column, post_money: Column, cumulative: Column) -> Column:
    """Struct (reject, flags) of a funding round's amount."""
    p = F.coalesce(passage, F.lit(""))
    reject = F.when(p.rlike(CUMULATIVE_CUE), "cumulative_not_round").when((cumulative != 0) & (usd != 0) & (usd > cumulative * 1.001), "round_exceeds_cumulative")
    flags = F.array_compact(F.array(F.when(p.rlike(EXTENSION_CUE), F.lit("series_extension")), F.when((post_money != 0) & (usd != 0) & (usd > 0.8 * post_money), F.lit("amount_near_postmoney")), F.when(~stage_plausible(stage, usd), F.lit("magnitude_outlier"))))
    return F.struct(reject.alias("reject"), flags.alias("flags"))


def surface_key(s: Column) -> Column:
    """Lower-case words without corporate suffixes; what has none other keeps its trimmed text."""
    low = F.lower(F.coalesce(s, F.lit("")))
    words = F.filter(F.regexp_extract_all(low, F.lit(f"({WORD})"), F.lit(1)), lambda w: ~w.isin(CORPORATE_SUFFIXES))
    key = F.array_join(words, " ")
    return F.when(key == "", F.btrim(low)).otherwise(key)


def match_surface(s: Column) -> Column:
    """Lower-case letters, digits and blanks only, trimmed: the key by which two readers agree."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9 ]", ""))


def screen_name(s: Column) -> Column:
    """A registered name's core for screening."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(s), SCREEN_SUFFIX, " "), "[^a-z0-9]+", " "))


def _unmarked() -> tuple[str, str]:
    """Lower-case Latin letters with marks, up to U+1EFF, and the ASCII letters that they decompose to."""
    pairs = [(chr(c), [x for x in unicodedata.normalize("NFKD", chr(c)) if x.isascii()]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(c, x[0]) for c, x in pairs if len(x) == 1 and c == c.lower()]
    return "".join(c for c, _ in pairs), "".join(x.lower() for _, x in pairs)


_MARKED, _PLAIN = _unmarked()


def resolver_name(s: Column) -> Column:
    """Sorted lower-case words without company forms or marks; characters outside ASCII go."""
    t = F.regexp_replace(F.translate(F.lower(s), _MARKED, _PLAIN), r"[^\x00-\x7F]", "")
    t = F.regexp_replace(F.regexp_replace(t, RESOLVER_SUFFIX, ""), r"[^A-Za-z0-9_\s]", " ")
    return F.array_join(F.array_sort(F.filter(F.split(t, r"\s+"), lambda w: w != "")), " ")


def implied_tolerance(x: Column) -> Column:
    """Half a unit of the last stated digit, one per cent at most: 12,000,000 stands for +- 120,000."""
    digits = F.bround(F.abs(x)).cast("decimal(38,0)").cast("string")
    zeros = F.when(digits == "0", 0).otherwise(F.length(digits) - F.length(F.rtrim(digits, F.lit("0"))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.least(F.lit(0.5) * F.pow(F.lit(10.0), zeros), F.lit(0.01) * F.abs(x)))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def query_key(q: Column) -> Column:
    """A search's words in order of the alphabet: rephrased searches are the same."""
    return F.array_join(F.array_sort(tokens(q)), " ")


def shingles(words: Column, k: int = 5) -> Column:
    """Distinct k-word shingles; none of fewer words."""
    n = F.size(words)
    return F.when(n >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " ")))).otherwise(F.array().cast("array<string>"))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


# Source classes by domain, in order, and suffixes of investors' own pages; reliability by class.
CLASS_DOMAINS = {
    "regulatory": ["sec.gov", "data.sec.gov", "clinicaltrials.gov", "uspto.gov", "europa.eu"],
    "vendor": ["crunchbase.com", "pitchbook.com", "dealroom.co", "tracxn.com"],
    "news": ["prnewswire.com", "businesswire.com", "globenewswire.com", "techcrunch.com", "reuters.com", "bloomberg.com", "ft.com", "wsj.com", "venturebeat.com"],
    "investor": ["a16z.com", "sequoiacap.com", "kleinerperkins.com", "indexventures.com", "accel.com", "lightspeed.com"],
    "social": ["linkedin.com"],
}
INVESTOR_ENDINGS = ["vc.com", "ventures.com", "capital.com"]
CLASSES = ["regulatory", "vendor", "news", "investor", "social", "other"]
CLASS_PRIOR = {"registry": 0.95, "regulatory": 0.95, "vendor": 0.80, "news": 0.60, "investor": 0.60, "blog": 0.40, "social": 0.40, "other": 0.50}
QUERY_WORDS = {
    "vendor": ["crunchbase", "pitchbook", "dealroom", "vendor"],
    "regulatory": ["filing", "10-k", "10k", "8-k", "form d", "sec ", "edgar", "nct"],
    "news": ["press release", "announce", "news", "techcrunch", "reuters"],
    "investor": ["portfolio", "fund page", "investor page"],
    "social": ["linkedin", "employees", "headcount"],
}
QBAR = 0.30


def under_any(h: Column, suffixes: list[str]) -> Column:
    """Whether a host is one of the suffixes or below one; a name that merely ends alike is not."""
    found = F.lit(False)
    for s in suffixes:
        found = found | (h == s) | h.endswith("." + s)
    return F.coalesce(found, F.lit(False))


def source_class(domain: Column) -> Column:
    d = F.regexp_replace(F.lower(domain), r"^www\.", "")
    out = F.lit("investor")
    ends = F.lit(False)
    for e in INVESTOR_ENDINGS:
        ends = ends | d.endswith(e)
    out = F.when(ends, "investor").otherwise("other")
    for name, domains in reversed(CLASS_DOMAINS.items()):
        out = F.when(under_any(d, domains), name).otherwise(out)
    return out


def query_class(q: Column) -> Column:
    """The class that a search aims at, by its first telling word group."""
    low, out = F.lower(q), F.lit("other")
    for name, words in reversed(QUERY_WORDS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def reliability(klass: Column, anchored: Column, refined: Column | None = None) -> Column:
    """Refined reliability if there is one, else the class prior (0.5 if unknown); capped where no identity is anchored."""
    q = F.coalesce(lookup(klass, CLASS_PRIOR), F.lit(0.5))
    q = q if refined is None else F.coalesce(refined, q)
    return F.when(anchored, q).otherwise(F.least(q, F.lit(QBAR)))


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles and hidden fact blocks go with their content, other tags leave a blank."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|ix:header|ix:hidden|ix:references|ix:resources)\b.*?</\1>", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]+>", " "), r"\s+", " "))


# Readings of loosely written numbers and dates

NUMBER = r"-?\d+(?:\.\d+)?"


def first_number(raw: Column, default: Column | None = None) -> Column:
    """The first number in a text, whatever stands around it; the default (null) where there is none."""
    x = F.regexp_extract(F.coalesce(raw, F.lit("")), f"({NUMBER})", 1).try_cast("double")
    return x if default is None else F.coalesce(x, default)


def scaled_number(raw: Column) -> Column:
    """The first number, times the scale of a k, m or b that follows it at once: '$40M' is 40,000,000, '46 pts' is 46."""
    s = F.regexp_replace(F.lower(F.btrim(raw)), r"[,$]", "")
    unit = F.regexp_extract(s, f"({NUMBER})([kmb]?)", 2)
    return first_number(s) * F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).otherwise(1.0)


def aggregate_key(raw: Column) -> Column:
    """One spelling for the echoes of one number ('24', '24 points', '24.0'); null without a number."""
    return number_text(scaled_number(raw))


def numeric(value: Column, value_num: Column) -> Column:
    """The stored number, else what the value's one spelling reads as."""
    return F.coalesce(value_num, canonical_value(value).try_cast("double"))


def dollars(value: Column, value_num: Column) -> Column:
    """The stored number, else the value without commas and dollar signs."""
    return F.coalesce(value_num, F.regexp_replace(value, "[,$]", "").try_cast("double"))


def year_of(text: Column) -> Column:
    """The first year from 1900 to 2099."""
    y = F.regexp_extract(F.coalesce(text, F.lit("")), r"\b((?:19|20)\d{2})\b", 1)
    return F.when(y != "", y.cast("int"))


def instant(text: Column) -> Column:
    """A point in time from an ISO, compact, US or spelled-out date; null for anything else."""
    s = F.btrim(text)
    return F.coalesce(F.try_to_timestamp(F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")), *(F.try_to_timestamp(s, F.lit(f)) for f in ("yyyyMMdd", "M/d/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy")))


def base_kind(kind: Column) -> Column:
    """A record kind without its instance: 'funding_round/series_b' is a funding_round."""
    return F.get(F.split(kind, "/"), F.lit(0))


def truth_key(registry_key: Column, kind: Column, date: Column) -> Column:
    """The registry's key of a record, else base kind and date, else null."""
    return F.coalesce(registry_key, F.when(date.isNotNull(), F.concat(base_kind(kind), F.lit("|"), date.cast("string"))))


def hashed_id(*parts: Column, length: int = 16) -> Column:
    """First hex digits of the SHA-256 of the parts, bar between."""
    return F.left(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), F.lit(length))


def pair_id(a: Column, b: Column) -> Column:
    """One id for a pair in either order."""
    return F.left(F.sha1(F.concat_ws("|", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))), F.lit(16))


def in_scope(surface: Column, aliases: Column) -> Column:
    """Whether a name contains, or is contained in, one of the aliases, both without corporate suffixes."""
    s = surface_key(surface)
    hit = F.exists(aliases, lambda a: (surface_key(a) != "") & (s.contains(surface_key(a)) | surface_key(a).contains(s)))
    return (s != "") & F.coalesce(hit, F.lit(False))


def validated(mention: dict[str, Column], context: dict[str, Column]) -> Column:
    """Struct (value_num, flags, reject) of a mention, by the rules for its attribute.

    ``mention``: attribute, kind, value, currency, passage, date_role;
    ``context``: stage, post_money, cumulative, any of them null. Money is read in
    dollars; an amount of a funding round is held against the round's context; a
    date without a role is flagged; other attributes pass. A rejected mention keeps
    its reason and nothing else.
    """
    m, c = mention, context
    money, date = m["attribute"].isin(MONEY_ATTRIBUTES), m["attribute"].isin(DATE_ATTRIBUTES)
    usd = money_usd(m["value"], m["currency"])
    of_round = (m["attribute"] == "amount") & m["kind"].startswith("funding_round")
    checks = round_checks(m["passage"], usd["usd"], c["stage"], c["post_money"], c["cumulative"])
    none = F.array().cast("array<string>")
    reject = F.when(money & usd["reject"].isNotNull(), usd["reject"]).when(money & of_round, checks["reject"])
    flags = F.when(money, F.concat(usd["flags"], F.when(of_round, checks["flags"]).otherwise(none))).when(date & m["date_role"].isNull(), F.array(F.lit("date_role_missing"))).otherwise(none)
    return F.struct(F.when(reject.isNull() & money, usd["usd"]).alias("value_num"), F.when(reject.isNull(), flags).alias("flags"), reject.alias("reject"))
