"""Personal data by fixed forms and by bootstrapped contexts, natively.

The fixed forms (e-mail, IP, card, phone) are the seeds, and so are long hexadecimal keys, of the
kind secret. The one, two and three words before a seed are lexical patterns. In a few rounds over
the pattern-instance graph a pattern is believed by the share of believed instances among all
identifiers (words with a digit) that it precedes, an instance by its patterns. Identifiers that
trusted patterns precede are personal data too, of the kind of the pattern's seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylode.llm.common import LOWER, UPPER, table, written

KINDS = ("email", "ip", "card", "phone")
#: Found through patterns only: no form of the base has it.
SECRET = ("secret", r"\A(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,}\z")
NAMES = (*KINDS, SECRET[0])
#: The contract's forms. Possessive where nothing can be given back, so that long runs take no deep
#: recursion; a match begins where its first run does (\G: after the match before), which is what
#: a leftmost search finds, without trying every suffix of a long run. The card form takes only
#: whole runs of 16 to 19 digits, since all others are dropped.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: An identifier: a word with a digit.
IDENTIFIER = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
#: Cheap signs without which a text has no match of a form.
SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9\x20-]{14}", "phone": r"\+[0-9]", None: "[0-9]"}
BYTE = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"
#: Words of the longest pattern; items of a block of a long list.
CONTEXT, PIECE = 3, 64
ROUNDS, TRUST, SEEDS = 3, 0.8, 3
SPAN = "array<struct<k:int,s:bigint,e:bigint,left:array<string>,value:string>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum divides by 10."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -(i + 1), F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _holds(kind: str, c: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(c, r"\."), lambda x: F.rlike(x, F.lit(BYTE)))
    if kind == "card":
        return F.length(_digits(c)).between(16, 19) & luhn(_digits(c))
    if kind == "phone":
        return F.length(_digits(c)).between(8, 15)
    return F.lit(True)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _patterns(before: Column) -> Column:
    """The last one, two and three words of a text, as patterns: digits are all 0, signs that touch
    what follows do not count."""
    last = F.reverse(F.regexp_extract(F.reverse(before), rf"\A(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){{0,{CONTEXT + 1}}}", 0))
    bare = F.regexp_replace(F.regexp_replace(F.translate(last, UPPER, LOWER), r"[^\x20\x09-\x0D\p{L}\p{N}]++\z", ""), "[0-9]++", "0")
    split = F.filter(F.split(bare, r"[\x20\x09-\x0D]++"), lambda w: w != "")
    sizes = F.array(*[F.lit(k) for k in range(1, CONTEXT + 1)])
    return _let(split, lambda w: F.transform(F.filter(sizes, lambda k: k <= F.size(w)), lambda k: F.array_join(F.slice(w, F.size(w) - k + 1, k), " ")))


def _running(items: Column, value, plus) -> Column:
    """What plus makes of the values of all items before each item, from 0: in blocks of PIECE items,
    so that no step carries (and copies) a long list. items is not empty."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    block = lambda b: F.slice(items, b * PIECE + 1, F.lit(PIECE))
    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PIECE).cast("int"))
    sums = F.transform(blocks, lambda b: F.aggregate(block(b), zero, lambda acc, x: plus(acc, value(x))))

    def inside(b: Column, before: Column) -> Column:
        begin = F.struct(F.aggregate(F.slice(before, F.lit(1), b), zero, plus).alias("at"), none.alias("all"))
        step = lambda acc, x: F.struct(plus(acc["at"], value(x)).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
        return F.aggregate(block(b), begin, step, lambda acc: acc["all"])

    return _let(sums, lambda before: F.flatten(F.transform(blocks, lambda b: inside(b, before))))


def _apart(other: Column, base: Column) -> Column:
    """The spans of other, none of which touches another, that touch none of base: in the order of
    all spans, none of base before reaches into one, and the next does not begin in it."""
    marked = lambda c, b: F.transform(c, lambda x: F.struct(x["s"].alias("s"), F.lit(b).alias("b"), x["e"].alias("e"), x.alias("x")))
    order = F.array_sort(F.concat(marked(base, 0), marked(other, 1)))

    def kept(r: Column) -> Column:
        reach = _running(r, lambda x: F.when(x["b"] == 0, x["e"]).otherwise(F.lit(0).cast("long")), lambda a, b: F.greatest(a, b))
        after = F.concat(F.slice(r, F.lit(2), F.size(r) - 1), F.slice(r, F.size(r), F.lit(1)))  # the last one has itself
        bounds = F.zip_with(reach, after, lambda end, x: F.struct(end.alias("end"), F.when(x["b"] == 0, x["s"]).alias("next")))
        clear = lambda item, o: (item["b"] == 1) & (item["s"] >= o["end"]) & (o["next"].isNull() | (o["next"] >= item["e"]))
        return F.array_compact(F.zip_with(r, bounds, lambda item, o: F.when(clear(item, o), item["x"])))

    return F.when((F.size(base) == 0) | (F.size(other) == 0), other).otherwise(_let(order, kept))


def spans_of(text: Column, kind: str | None) -> Column:
    """All matches of a kind's form that hold (None: identifiers), as structs: start and end in code
    points, the patterns before (the match before counts as a number), the value.

    Each match begins after the piece of text between it and the match before. Pieces and matches
    are read once each; then one walk over them adds up the offsets, linear in text and matches.
    """
    form = FORMS[kind] if kind else IDENTIFIER
    pieces = F.arrays_zip(F.split(text, form, -1).alias("gap"), F.regexp_extract_all(text, F.lit(form), F.lit(0)).alias("match"))

    def read(piece: Column, i: Column) -> Column:
        gap, match = piece["gap"], piece["match"]
        if kind:
            holds, k, value, off = match.isNotNull() & _holds(kind, match), F.lit(NAMES.index(kind)), match, F.lit(0)
        else:
            long = F.regexp_replace(match, r"[^\p{L}\p{N}]++\z", "")
            value = F.regexp_replace(long, r"\A[^\p{L}\p{N}+]++", "")
            holds, off = match.isNotNull(), F.length(long) - F.length(value)
            k = F.when(F.rlike(value, F.lit(SECRET[1])), NAMES.index(SECRET[0])).otherwise(-1)
        before = F.concat(F.when(i > 0, "0").otherwise(""), gap)
        found = F.struct(k.alias("k"), off.cast("long").alias("s"), F.length(value).cast("long").alias("e"), _patterns(before).alias("left"), value.alias("value"))
        return F.struct(F.length(gap).alias("g"), F.coalesce(F.length(match), F.lit(0)).alias("m"), F.when(holds, found).alias("x"))

    def placed(p: Column, before: Column) -> Column:
        x, at = p["x"], before + p["g"]
        return F.when(x.isNotNull(), F.struct(x["k"].alias("k"), (at + x["s"]).alias("s"), (at + x["s"] + x["e"]).alias("e"), x["left"].alias("left"), x["value"].alias("value")))

    lengths = lambda p: (p["g"] + p["m"]).cast("long")
    walked = _let(F.transform(pieces, read), lambda r: F.array_compact(F.zip_with(r, _running(r, lengths, lambda a, b: a + b), placed)).cast(SPAN))
    sign = F.contains(text, F.lit("@")) if kind == "email" else F.rlike(text, F.lit(SIGNS[kind]))
    return F.when(sign, walked).otherwise(F.array().cast(SPAN))


def scanned(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, row (a hash of the text), base and other: spans by kind, and identifiers that do not
    touch one."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(*[spans_of(t, k) for k in KINDS])
    scan = written(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("row"), base.alias("base"), spans_of(t, None).alias("other")))
    return scan.select("doc_id", "row", "base", _apart(F.col("other"), F.col("base")).alias("other"))


def trusted(edges: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, seeds: int = SEEDS) -> DataFrame:
    """left, kind, score: the patterns that the pattern-instance graph trusts.

    edges has a row for each (left, value), with the value's seed kind or -1. A pattern's score
    for a kind is the mean belief in its instances, smoothed by two unbelieved ones; a seed is
    believed fully, another instance as much as the patterns before it are on average. Patterns
    need so many different seeds.
    """
    kinds = range(len(NAMES))
    belief = edges.select("left", "value", F.col("k").alias("seed"), F.col("k").alias("kind"), F.when(F.col("k") >= 0, 1.0).otherwise(0.0).alias("belief"))
    for _ in range(rounds):
        sums = belief.groupBy("left").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col("kind") == k, F.col("belief")).otherwise(0.0)).alias(f"b{k}") for k in kinds], *[F.count_if(F.col("seed") == k).alias(f"s{k}") for k in kinds])
        best = F.array_max(F.array(*[F.struct((F.col(f"b{k}") / (F.col("n") + 2)).alias("score"), F.lit(-k).alias("k"), F.col(f"s{k}").alias("seeds")) for k in kinds]))
        patterns = sums.select("left", best.alias("best")).select("left", (-F.col("best.k")).alias("pk"), F.col("best.score").alias("score"), F.col("best.seeds").alias("seeds"))
        patterns = written(patterns.filter((F.col("seeds") >= seeds) & (F.col("score") > 0)))
        scored = belief.filter("seed < 0").select("left", "value").join(patterns, "left", "left")
        sums = scored.groupBy("value").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col("pk") == k, F.col("score")).otherwise(0.0)).alias(f"b{k}") for k in kinds])
        found = sums.select("value", F.array_max(F.array(*[F.struct((F.col(f"b{k}") / F.col("n")).alias("b"), F.lit(-k).alias("k")) for k in kinds])).alias("x"))
        found = found.select("value", (-F.col("x.k")).alias("nk"), F.col("x.b").alias("nb"))
        belief = belief.join(found, "value", "left").select("left", "value", "seed", F.when(F.col("seed") >= 0, F.col("kind")).otherwise(F.coalesce("nk", F.lit(-1))).alias("kind"), F.when(F.col("seed") >= 0, 1.0).otherwise(F.coalesce("nb", F.lit(0.0))).alias("belief"))
        belief = written(belief)
    return patterns.filter(F.col("score") >= trust).select("left", F.col("pk").alias("kind"), "score")


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, trust: float = TRUST, seeds: int = SEEDS) -> DataFrame:
    """doc_id, base and spans (structs k, s, e): one row for each row of docs.

    A null text counts as empty and has no spans; equal rows have equal spans; an empty table gives
    no rows; other columns are not read, so their names do not matter. An identifier that several
    trusted patterns precede gets the kind of the best.
    """
    scan = scanned(docs, doc_id, text)
    seen = scan.select(F.explode(F.concat("base", "other")).alias("x")).select("x.k", "x.value", F.explode("x.left").alias("left"))
    patterns = trusted(written(seen.groupBy("left", "value").agg(F.max("k").alias("k"))), rounds, trust, seeds)
    tokens = scan.select("doc_id", "row", F.explode("other").alias("x")).select("doc_id", "row", "x.s", "x.e", F.explode("x.left").alias("left"))
    more = tokens.join(patterns, "left").groupBy(F.col("doc_id").alias("_ql_id"), F.col("row").alias("_ql_row"), "s", "e").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("best"))
    more = more.groupBy("_ql_id", "_ql_row").agg(F.collect_list(F.struct((-F.col("best.k")).alias("k"), "s", "e")).alias("more"))
    plain = F.transform("base", lambda b: F.struct(b["k"].alias("k"), b["s"].alias("s"), b["e"].alias("e")))
    base = scan.select("doc_id", "row", plain.alias("base"))
    joined = base.join(more, base["doc_id"].eqNullSafe(F.col("_ql_id")) & (base["row"] == F.col("_ql_row")), "left")
    return joined.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<k:int,s:bigint,e:bigint>>")))).alias("spans"))


def _of_kind(k: int):
    return lambda b: b["k"] == k


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents: base counts and digest, and all spans."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
