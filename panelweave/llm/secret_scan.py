"""Secrets in whole texts, with built-in expressions only.

Base rules find assignments, access keys and hex strings. Other long strings without a gap go through a battery: chi-squared
uniformity over the alphabet of the encoding they seem to have, a runs test and a serial correlation. A string that
passes as random is compared with what ordinary writing of its length would give; the resulting p-values, of all
candidates in all documents, are cut by the Benjamini-Hochberg rule per length class. Positions are code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.staging import stage
from .quality_rules import bound
from .text import columns

# fixed: the base rules, in the order in which their names sort at equal starts; the last is the method's own
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_CHARS = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a shorter run of these characters holds no longer one
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

HEX_ALPHABET = "0123456789abcdef"
BASE32_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
UNEVENNESS = {16: 0.6, 32: 1.1, 64: 3.0}  # alphabet size * sum of squared letter shares of ordinary writing, less 1
LEAST_BODY = 8  # characters that the battery is given at least
NOT_RANDOM = 3.0  # deviations from randomness that fail a test of the battery
FALSE_SHARE = 0.01
BINS_PER_DECADE = 10
TOP_BIN = 300
RUN = 512  # matches that are placed together; keeps a text with very many matches from quadratic copying
MARK = "[SECRET]"


def _placed(lengths: Column) -> Column:
    """array<struct<gap, len, ok>> -> array<struct<start, end, ok>> by running sums, in blocks of RUN."""
    at = F.lit(0).cast("bigint")
    none = F.array().cast("array<struct<start:bigint,end:bigint,ok:boolean>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + p["len"]
        return F.struct(
            end.alias("at"),
            F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["ok"].alias("ok")))).alias("out"),
        )

    blocks = F.transform(
        F.sequence(F.lit(0), ((F.size(lengths) - 1) / RUN).cast("int")),
        lambda b: F.aggregate(F.slice(lengths, b * RUN + 1, F.lit(RUN)), F.struct(at.alias("at"), none.alias("out")), step),
    )

    def shifted(parts: Column) -> Column:
        sums = F.aggregate(
            parts,
            F.struct(at.alias("at"), F.array().cast("array<bigint>").alias("offs")),
            lambda acc, p: F.struct(
                (acc["at"] + p["at"]).alias("at"), F.concat(acc["offs"], F.array(acc["at"])).alias("offs")
            ),
        )
        return bound(
            sums["offs"],
            lambda offs: F.flatten(
                F.transform(
                    parts,
                    lambda p, i: F.transform(
                        p["out"],
                        lambda s: F.struct(
                            (s["start"] + F.get(offs, i)).alias("start"),
                            (s["end"] + F.get(offs, i)).alias("end"),
                            s["ok"].alias("ok"),
                        ),
                    ),
                )
            ),
        )

    return bound(blocks, shifted)


def spans(text: Column, pattern: str, group: int = 0, least: int = 1) -> Column:
    """array<struct<start, end, ok>> of all leftmost matches; ``ok`` if the group has ``least`` characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    none = F.array().cast("array<struct<start:bigint,end:bigint,ok:boolean>>")
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if group else None

    def lengths(g: Column) -> Column:
        m = whole if group else g
        return F.transform(
            F.arrays_zip(F.slice(F.split(text, pattern), F.lit(1), F.size(g)).alias("gap"), m.alias("m"), g.alias("g")),
            lambda z: F.struct(
                F.char_length(z["gap"]).alias("gap"),
                F.char_length(z["m"]).alias("len"),
                (F.char_length(z["g"]) >= least).alias("ok"),
            ),
        )

    return bound(found, lambda g: F.when(F.size(g) == 0, none).otherwise(bound(lengths(g), _placed)))


def _normal(z: Column) -> Column:
    """The normal distribution function, by its logistic approximation (error below 2e-4)."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def _scored(token: Column) -> Column:
    """Bin of the p-value that ordinary writing looks as random as ``token``; 0 if the battery finds it not random.

    What is left of a token without its closing = signs has to have ``LEAST_BODY`` characters for tests to mean anything; a
    shorter one is a candidate that is not random, and so is one letter repeated."""
    plain = F.regexp_replace(token, "=+$", "")
    body = F.when(plain.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lower(plain)).otherwise(F.translate(plain, "-_", "+/"))

    def by_body(b: Column) -> Column:
        size = F.when(b.rlike("^[0-9a-f]+$"), 16).when(b.rlike("^[A-Z2-7]+$"), 32).otherwise(64)
        return F.when(F.char_length(b) < LEAST_BODY, 0).otherwise(bound(size, lambda a: tests(b, a)))

    def tests(b: Column, a: Column) -> Column:
        letters = F.when(a == 16, HEX_ALPHABET).when(a == 32, BASE32_ALPHABET).otherwise(BASE64_ALPHABET)
        chars = F.filter(F.split(b, ""), lambda c: c != "")
        return bound(
            chars,
            lambda c: bound(
                F.transform(c, lambda x: (F.instr(letters, x) - 1).cast("double")), lambda v: battery(b, a, c, v)
            ),
        )

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)

    def battery(b: Column, a: Column, c: Column, v: Column) -> Column:
        n = F.size(v).cast("double")
        squares = total(
            F.transform(
                F.array_distinct(c),
                lambda x: F.pow((F.char_length(b) - F.char_length(F.replace(b, x, F.lit("")))).cast("double"), F.lit(2)),
            )
        )
        free = (a - 1).cast("double")
        chi = F.try_divide(a * squares, n) - n
        uneven = F.when(a == 16, UNEVENNESS[16]).when(a == 32, UNEVENNESS[32]).otherwise(UNEVENNESS[64])
        z_chi = (F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))  # free is 15, 31 or 63
        mean = free + uneven * (n - 1)
        p = _normal(F.try_divide(chi - mean, F.sqrt(2 * free + 4 * uneven * (n - 1))))
        high = total(F.transform(v, lambda x: (x >= a / 2).cast("double")))
        changes = total(
            F.transform(
                v, lambda x, i: F.coalesce(((x >= a / 2) != (F.get(v, i + 1) >= a / 2)).cast("double"), F.lit(0.0))
            )
        )
        hi_lo = 2 * high * (n - high)
        runs_mean = F.try_divide(hi_lo, n) + 1
        runs_sd = F.sqrt(F.greatest(F.try_divide(hi_lo * (hi_lo - n), n * n * (n - 1)), F.lit(0.0)))
        z_runs = F.coalesce(F.try_divide(changes + 1 - runs_mean, runs_sd), F.lit(2 * NOT_RANDOM))
        mid = F.try_divide(total(v), n)
        serial = bound(
            mid,
            lambda m: F.try_divide(
                total(F.transform(v, lambda x, i: F.coalesce((x - m) * (F.get(v, i + 1) - m), F.lit(0.0)))),
                total(F.transform(v, lambda x: (x - m) * (x - m))),
            ),
        )
        z_serial = F.coalesce(serial * F.sqrt(n), F.lit(2 * NOT_RANDOM))
        fails = F.coalesce((z_chi > NOT_RANDOM) | (F.abs(z_runs) > NOT_RANDOM) | (F.abs(z_serial) > NOT_RANDOM), F.lit(True))
        binned = F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * BINS_PER_DECADE), F.lit(TOP_BIN)).cast("int")
        return F.when(fails, 0).otherwise(F.greatest(binned, F.lit(0)))

    return bound(body, by_body)


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``q``: base (array of start, kind, end in order) and candidates (start, end, stratum, bin, token)."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    placed = docs.withColumn("q", t).withColumn(
        "q",
        F.struct(
            F.col("q").alias("t"),
            spans(F.col("q"), ASSIGN, 2, ASSIGN_CHARS).alias("assign"),
            spans(F.col("q"), ACCESS).alias("access"),
            spans(F.col("q"), HEX).alias("hex"),
            F.regexp_extract_all(F.col("q"), F.lit(CANDIDATE), F.lit(0)).alias("tokens"),
        ),
    )

    def of_kind(k: int) -> Column:
        return F.transform(
            F.filter(f"q.{KINDS[k]}", lambda s: s["ok"]),
            lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")),
        )

    ordered = F.sort_array(F.concat(*[of_kind(k) for k in range(3)]))
    with_base = placed.withColumn("q", F.struct("q.t", "q.tokens", ordered.alias("base")))
    apart = lambda c: ~F.exists("q.base", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    zipped = F.zip_with(
        spans(F.col("q.t"), CANDIDATE),
        F.col("q.tokens"),
        lambda s, token: F.struct(s["start"].alias("start"), s["end"].alias("end"), token.alias("token")),
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint,token:string>>")
    free = F.when(F.size("q.tokens") == 0, none).otherwise(F.filter(zipped, apart))
    with_free = with_base.withColumn("q", F.struct("q.t", "q.base", free.alias("free")))
    scored = F.transform(
        "q.free",
        lambda c: F.struct(
            c["start"].alias("start"),
            c["end"].alias("end"),
            F.floor(F.log2((c["end"] - c["start"]).cast("double"))).cast("int").alias("stratum"),
            _scored(c["token"]).alias("bin"),
            c["token"].alias("token"),
        ),
    )
    return with_free.withColumn("q", F.struct("q.t", "q.base", scored.alias("candidates")))


def cuts(candidates: DataFrame) -> dict[int, int]:
    """Least bin that is a discovery, per length class with any (Benjamini-Hochberg on binned p-values, upper edges).

    ``candidates`` has one array column ``candidates``. Counted over all rows; the result has at most one entry for each
    power of two that a length can have."""
    from pyspark.sql import Window

    binned = candidates.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.bin").agg(F.count("*").alias("n"))
    down = Window.partitionBy("stratum").orderBy(F.desc("bin"))  # at most TOP_BIN + 1 rows
    whole = Window.partitionBy("stratum")
    cut = (
        binned.withColumn("found", F.sum("n").over(down))
        .withColumn("all", F.sum("n").over(whole))
        .filter(F.col("bin") > 0)
        .filter(F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE) * F.col("all") <= FALSE_SHARE * F.col("found"))
        .groupBy("stratum")
        .agg(F.min("bin").alias("bin"))
    )
    return {r.stratum: r.bin for r in cut.collect()}


def _is_found(c: Column, limits: dict[int, int]) -> Column:
    limit = F.lit(TOP_BIN + 1)
    for stratum, least in sorted(limits.items()):
        limit = F.when(c["stratum"] == stratum, least).otherwise(limit)
    return c["bin"] >= limit


def _text_of(array: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            array,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def secret_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null text counts as empty and has no span: base_sha256 is that of an empty string, spans is empty. Rows are
    scanned one by one, so repeated rows repeat their result; equal strings in one length class share one verdict. Without
    candidates nothing is cut; an empty table gives an empty table. Other columns are ignored. Very long texts are read
    whole, by expressions over one row."""
    found = stage(scanned(columns(docs, doc_id="bigint", text="string")).select("doc_id", "q.base", "q.candidates"), "secrets")
    limits = cuts(found)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    extra = F.transform(
        F.filter("candidates", lambda c: _is_found(c, limits)),
        lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")),
    )
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_text_of(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _text_of(F.sort_array(F.concat("base", extra))).alias("spans"),
    )


def _marked(text: Column, pattern: str, group: int, hit) -> Column:
    """``text`` with MARK in place of the matches that ``hit`` accepts, joined from the parts between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.transform(
        F.arrays_zip(F.split(text, pattern).alias("gap"), found.alias("m"), groups.alias("g")),
        lambda z: F.concat(z["gap"], F.when(z["m"].isNull(), "").when(hit(z["g"]), MARK).otherwise(z["m"])),
    )
    return F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret of its texts replaced by a mark, and n_chars (if there) counted anew; other columns as
    they are. Null texts stay null."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    seen = stage(scanned(packed.withColumn("text", F.col("row.text"))).select("row", "q.candidates"), "secrets")
    limits = cuts(seen)
    tokens = F.transform(F.filter("candidates", lambda c: _is_found(c, limits)), lambda c: c["token"])
    out = seen.select("row", tokens.alias("tokens"), F.col("row.text").cast("string").alias("t"))
    long = lambda n: lambda g: F.char_length(g) >= n
    for pattern, group, hit in ((ASSIGN, 2, long(ASSIGN_CHARS)), (ACCESS, 0, long(1)), (HEX, 0, long(1))):
        out = out.withColumn("t", _marked(F.col("t"), pattern, group, hit))
    random = _marked(F.col("t"), CANDIDATE, 0, lambda g: F.array_contains(F.col("tokens"), g))
    out = out.withColumn("t", F.when(F.size("tokens") > 0, random).otherwise(F.col("t")))
    kind = dict(docs.dtypes)
    new = {"text": F.col("t")} | ({"n_chars": F.char_length("t").cast(kind["n_chars"])} if "n_chars" in kind else {})
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
