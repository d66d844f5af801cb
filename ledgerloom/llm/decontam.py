"""Benchmark decontamination by template canonicalisation, in native expressions only.

Words become template tokens: numbers, units and names turn into typed
placeholders, the rest is lower-cased without punctuation. Windows of ``K``
tokens of the benchmark are hash-joined with those of every document. On each
diagonal (document position minus item position) the slots that placeholders
stand for must map consistently: one value of the item to one of the document
and back. A re-parameterised question keeps such a mapping, a chance match of
templates does not.

The window rows of documents exist only inside the scan's generated code, where
the join with the small benchmark side drops all but the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import narrow

#: Tokens of a window, least literal tokens of a benchmark window, windows in a row that prove a leak (fewer for short items).
K, LITERAL, ENOUGH = 8, 4, 6
#: Benchmark windows up to which their table is broadcast (about 200 bytes each); beyond, the join shuffles.
BROADCAST = 200_000

#: Unit words.
UNITS = "mm cm m km in inch inches ft foot feet yd yards mi mile miles mg g kg lb lbs oz ton tons tonnes ml l liter liters litre litres gal gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent pct degree degrees hz khz mhz kb mb gb tb w kw v mph kph".split()
#: Deleted characters; the sentence ends . ! ? are trimmed from words after they have served.
DELETED = "\"'`,;:()[]{}<>|*#$%&_~^=+\\/«»“”‘’…–—-"

_SPACE = r"\x20\x09-\x0D"
#: DELETED as a class. The wide ones stand inside a range, so that most characters are told by one comparison.
_GONE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in DELETED if ord(c) < 256) + r"[\x{2013}-\x{2026}&&[" + "".join(f"\\x{{{ord(c):x}}}" for c in DELETED if ord(c) > 255) + "]]]"
#: White space other than one blank, and sentence ends where a word begins or ends.
_GAP = rf"[\x09-\x0D][{_SPACE}]*|\x20[{_SPACE}]+"
_EDGE = r"[.!?]+(?![^\x20])|(?<![^\x20])[.!?]+"


def _words(text: Column) -> Column:
    """The text's words as written, between single blanks; a line's end is a sentence's."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" . "))
    return F.btrim(F.regexp_replace(F.regexp_replace(t, _GONE, ""), _GAP, " "), F.lit(" "))


def _need(n: Column) -> Column:
    """Least literal tokens of a benchmark window of n tokens."""
    return F.least(F.lit(LITERAL), F.greatest(F.lit(1), n - 1))


def _templates(df: DataFrame) -> DataFrame:
    """Adds to a table with ``text`` the values ``v`` and templates (#num, #unit, #name, or the lower-cased word): ``t``, where a sentence's first word is a literal, and ``u``, where it is a name if it can be one."""

    def kind(core: Column, low: Column) -> Column:
        name = (core != low) & (F.length(core) > 1) & (F.left(core, F.lit(1)) != F.left(low, F.lit(1))) & (F.substr(core, F.lit(2)) == F.substr(low, F.lit(2)))
        return F.when(core.rlike("[0-9]"), "#num").when(low.isin(UNITS), "#unit").when(name, "#name").otherwise(low)

    def opening(kind: Column, before: Column) -> Column:
        return F.when((kind == "#name") & before.rlike(r"[.!?]$"), "#open").otherwise(kind)

    # Trimmed and lowered as one text, which keeps its blanks: the three have a word at the same place.
    # One column a step: inside a lambda every use of a word would be worked out again.
    kept = [c for c in df.columns if c != "text"]
    df = df.withColumn("_x", _words(F.col("text"))).withColumn("_y", F.regexp_replace("_x", _EDGE, ""))
    df = df.withColumn("_l", F.split(F.lower("_y"), " "))
    kinds = F.zip_with(F.split("_y", " "), "_l", kind)
    kinds = F.slice(F.zip_with(kinds, F.concat(F.array(F.lit(".")), F.split("_x", " ")), opening), F.lit(1), F.size("_l"))
    # A word of sentence ends only is empty here and there.
    df = df.withColumn("_k", F.array_remove(kinds, "")).withColumn("_v", F.array_remove("_l", ""))
    t = F.zip_with("_k", "_v", lambda k, v: F.when(k == "#open", v).otherwise(k))
    return df.select(*kept, F.col("_v").alias("v"), t.alias("t"), F.transform("_k", lambda k: F.when(k == "#open", "#name").otherwise(k)).alias("u"))


def _hashed(df: DataFrame, source: str, lengths: list[int], out: str) -> DataFrame:
    """Adds ``{out}{n}``: at each token the hash of the n templates from it; at the last n - 1, of the fewer left, which no benchmark window has.

    Hashes of 2, 4, ... templates are made of two of half the length, the others of these: no window is cut out.
    """
    spans = {1: f"{out}1"}
    df = df.withColumn(spans[1], F.transform(source, lambda x: F.xxhash64(x)))

    def joined(x: str, y: str, by: int) -> Column:
        return F.zip_with(F.col(x), F.slice(F.col(y), F.lit(by + 1), F.greatest(F.size(y), F.lit(1))), lambda p, q: F.xxhash64(p, q))

    def span(df: DataFrame, n: int) -> DataFrame:
        if n in spans:
            return df
        high = 1 << (n.bit_length() - 1)
        high = high // 2 if high == n else high
        df = span(span(df, high), n - high)
        spans[n] = f"{out}{n}"
        return df.withColumn(spans[n], joined(spans[high], spans[n - high], high))

    for n in lengths:
        df = span(df, n)
    return df


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = K) -> DataFrame:
    """``item_id, ipos, reading, n, h, iv, it, windows, strongs``: an item's windows of n tokens, how many it has and how many have enough literal tokens.

    A window is in the table once for each reading: ``t`` and ``u`` as in _templates, ``s`` is ``u`` but with the item's first
    token a literal. One with too few literal tokens has no templates to tell it: it is there as ``v``, by its values.
    """
    b = _templates(narrow(benchmark, item_id=item_col, text=text_col).where(F.col("text").isNotNull()).distinct())
    b = b.where(F.exists("t", lambda x: ~x.startswith("#"))).withColumn("n", F.least(F.size("v"), F.lit(k)))
    b = b.withColumn("s", F.transform("u", lambda x, i: F.when(i == 0, F.get("t", i)).otherwise(x)))
    for r in "tus":
        b = _hashed(b, r, list(range(1, k + 1)), f"{r}_")
    at = lambda r: F.coalesce(*(F.when(F.col("n") == n, F.get(f"{r}_{n}", F.col("ipos"))) for n in range(1, k + 1)))
    b = b.select("*", F.explode(F.sequence(F.lit(0), F.size("v") - F.col("n"))).alias("ipos"))
    cut = lambda c: F.slice(c, F.col("ipos") + 1, F.col("n"))
    literal = lambda x: F.size(F.filter(x, lambda y: ~y.startswith("#"))) >= _need(F.col("n"))
    b = b.select("item_id", "ipos", "n", cut("v").alias("iv"), *(x for r in "tus" for x in (cut(r).alias(r), at(r).alias(f"h{r}"))))
    b = b.withColumn("strong", literal(F.col("t")))
    row = lambda r, h, t: F.struct(F.lit(r).alias("reading"), h.alias("h"), t.alias("it"))
    t, u, s = F.col("t"), F.col("u"), F.col("s")
    rows = F.array(
        F.when(F.col("strong"), row("t", F.col("ht"), t)).otherwise(row("v", F.xxhash64("iv"), t)),
        F.when((u != t) & literal(u), row("u", F.col("hu"), u)),
        F.when((s != t) & (s != u) & literal(s), row("s", F.col("hs"), s)),
    )
    one = "over (partition by item_id)"
    b = b.withColumn("windows", F.expr(f"count(*) {one}")).withColumn("strongs", F.expr(f"count_if(strong) {one}"))
    return b.select("item_id", "ipos", "n", "iv", "windows", "strongs", F.explode(F.array_compact(rows)).alias("r")).select("*", "r.*").drop("r")


def _document_windows(docs: DataFrame, by_template: list[int], by_value: list[int]) -> DataFrame:
    """Adds ``w``: for each length of window, hashes at each token, so that an entry's place modulo the tokens is its position."""
    d = _templates(docs)
    for r in "tu":
        d = _hashed(d, r, by_template, f"{r}_")
    # Under the second reading only the windows that it changes.
    parts = [x for n in by_template for x in (F.col(f"t_{n}"), F.zip_with(f"t_{n}", f"u_{n}", lambda p, q: F.when(p != q, q)))]
    # By values only the windows that have as few literal tokens as the benchmark's that are looked for so.
    slots = F.size(F.filter("t", lambda x: x.startswith("#")))
    for n in by_value:
        few = lambda x: F.size(F.filter(x, lambda y: ~y.startswith("#"))) < _need(F.lit(n))  # noqa: B023, E731
        values = F.transform(F.sequence(F.lit(1), F.size("v")), lambda i: F.when(few(F.slice("t", i, F.lit(n))), F.xxhash64(F.slice("v", i, F.lit(n)))))  # noqa: B023
        parts.append(F.when(slots > n - _need(F.lit(n)), values).otherwise(F.array_repeat(F.lit(None).cast("bigint"), F.size("v"))))
    return d.select("doc_id", "text_hash", "v", F.concat(*parts).alias("w"))


def _consistent(rows: Column) -> Column:
    """The rows without a conflicting slot: one whose value stands for another value, or whose other value stands for it, elsewhere on the diagonal. A value kept as it is never conflicts."""
    pairs = F.array_distinct(F.flatten(F.transform(rows, lambda r: r["slots"])))
    bad = F.filter(pairs, lambda p: (p["i"] != p["d"]) & F.exists(pairs, lambda q: (p["i"] == q["i"]) != (p["d"] == q["d"])))
    return F.filter(rows, lambda r: ~F.arrays_overlap(r["slots"], bad))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = K, enough: int = ENOUGH) -> DataFrame:
    """``doc_id, text_hash, item_id, matched, windows, renamed`` of each document and item that it leaks.

    matched: the item's windows found with consistent slots; a leak needs
    ``enough`` of them or half of the item's, whichever is less. Where the
    windows with enough literal tokens prove it as written, these alone are
    matched and windows; else all windows and readings are. Windows that touch a
    conflicting slot don't count, the others on the diagonal do. renamed: some
    slot has another value than the item's. Null and empty texts leak nothing; items without
    text, or of placeholders only, can't be leaked. An item of fewer than k
    tokens is one window, looked for at every place of a document. Windows of
    few literal tokens count where all values are equal. A capitalised word that
    opens a sentence is tried as a literal and as a name. Rows with the same id
    and text count once; null ids stay null.
    """
    spark = docs.sparkSession
    b = benchmark_windows(benchmark, item_col, item_text_col, k)
    # At most k lengths, each in two ways.
    kinds = b.groupBy("n", (F.col("reading") == "v").alias("v")).count().collect()
    small = sum(r["count"] for r in kinds) <= BROADCAST
    lengths = [sorted(r.n for r in kinds if r.v == v) for v in (False, True)]
    if not kinds:
        lengths = [[k], []]
    text = docs[text_col]
    d = _document_windows(narrow(docs, doc_id=id_col, text=text, text_hash=F.xxhash64(text)), *lengths)
    # posexplode_outer: the plain one infers a filter that repeats all of this below itself.
    d = d.select("doc_id", "text_hash", "v", F.posexplode_outer("w").alias("at", "h"))
    # On the 64-bit hash alone, a long key: comparing the windows themselves would either build a key of
    # strings for every window or break the generated code, and a leak needs several hits on one diagonal.
    m = d.join(F.broadcast(b) if small else b, "h")
    # With the place in w, whether both sides are read as written: even parts are of templates t.
    m = m.withColumn("pos", F.col("at") % F.size("v")).withColumn("plain", (F.col("reading") == "t") & (F.floor(F.col("at") / F.size("v")) % 2 == 0))
    m = m.select("doc_id", "text_hash", "item_id", "windows", "strongs", "ipos", "plain", "reading", (F.col("pos") - F.col("ipos")).alias("diagonal"), "iv", "it", F.slice("v", F.col("pos") + 1, F.col("n")).alias("dv"))
    slots = F.transform(F.filter(F.arrays_zip("iv", "dv", "it"), lambda x: x["it"].startswith("#")), lambda x: F.struct(x["iv"].alias("i"), x["dv"].alias("d")))
    key = ["doc_id", "text_hash", "item_id", "windows", "strongs"]
    # The hash alone has joined them: literals must be equal as well, and values where the window is looked for by these.
    # Not a filter of its own, which would go into the join and there cut out a window of every token.
    same = F.forall(F.arrays_zip("iv", "dv", "it"), lambda x: x["it"].startswith("#") | (x["it"] == x["dv"])) & ((F.col("reading") != "v") | (F.col("iv") == F.col("dv")))
    g = m.groupBy(*key, "diagonal").agg(F.collect_set(F.when(same, F.struct("ipos", "plain", slots.alias("slots")))).alias("rows"))
    # A name read into a sentence's opening must not spoil what matches as written.
    g = g.select(*key, _consistent(F.col("rows")).alias("any"), _consistent(F.filter("rows", lambda r: r["plain"])).alias("plain"))
    at = lambda c: F.transform(c, lambda r: r["ipos"]).alias(f"{c}_at")
    renamed = lambda c: F.exists(c, lambda r: F.exists(r["slots"], lambda x: x["i"] != x["d"])).alias(f"{c}_renamed")
    g = g.select(*key, *(f(c) for c in ("any", "plain") for f in (at, renamed)))
    # What is found as written on one diagonal counts beside what is found by any reading on another.
    g = g.withColumn("any_at", F.array_union("any_at", "plain_at"))
    g = g.groupBy(*key).agg(*(x for c in ("any", "plain") for x in (F.size(F.array_distinct(F.flatten(F.collect_list(f"{c}_at")))).cast("bigint").alias(c), F.max(f"{c}_renamed").alias(f"{c}_renamed"))))
    proves = lambda found, of: (F.col(found) > 0) & (F.col(found) >= F.least(F.lit(enough), F.ceil(F.col(of) / 2)))
    g = g.withColumn("written", proves("plain", "strongs")).where(F.col("written") | proves("any", "windows"))
    as_written = lambda x, y: F.when(F.col("written"), F.col(x)).otherwise(F.col(y))
    return g.select("doc_id", "text_hash", "item_id", as_written("plain", "any").alias("matched"), as_written("strongs", "windows").alias("windows"), as_written("plain_renamed", "any_renamed").alias("renamed"))


def leak_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark).drop("text_hash")
