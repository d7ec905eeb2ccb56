"""Matching inputs to companies: a ranked cascade of exact joins, then scored text search.

All strategies give candidates (input_id, rank, domain, fields, scores); the lowest rank of an
input wins. Text search runs only for inputs that no exact strategy has matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylode.functions.normalize import normalize_company_name, normalize_facebook, normalize_phone, normalize_url, usable_fields
from quarrylode.functions.quality import agreement, match_quality, squash, weighted_confidence
from quarrylode.operators.stored import stored
from quarrylode.operators.textindex import TextIndex, expand_fuzzy, grams, name_tokens
from quarrylode.operators.topsearch import contenders

#: Weights of the name fields, boosts of the clauses, thresholds of the two searches.
FIELDS = {"commercial_name": 3.0, "legal_name": 2.0, "all_names": 1.0}
BOOST = {"domain": 10.0, "phone": 8.0, "facebook": 7.0, "name": 5.0, "grams": 2.0, "exact": 5.0}
COMPOSITE, NAME_ONLY = 0.3, 0.2


def normalize_inputs(inputs: DataFrame) -> DataFrame:
    """input_id, domain, phone, facebook_id, name, usable from raw website, phone, facebook, name."""
    keys = inputs.select("input_id", normalize_url(F.col("website")).alias("domain"), normalize_phone(F.col("phone")).alias("phone"), normalize_facebook(F.col("facebook")).alias("facebook_id"), normalize_company_name(F.col("name")).alias("name"))
    return keys.withColumn("usable", usable_fields(F.col("domain"), F.col("phone"), F.col("facebook_id"), F.col("name")))


def _scores(**fields) -> Column:
    return F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))])


def _candidate(rank: int, fields: Column, scores: Column, source: str) -> list[Column]:
    return [F.col("input_id"), F.lit(rank).alias("rank"), F.col("domain"), fields.alias("matched_on"), scores.alias("scores"), F.lit(source).alias("match_source")]


def by_domain(keys: DataFrame, companies: DataFrame) -> DataFrame:
    found = keys.filter("domain is not null").join(companies.select("domain", "commercial_name"), "domain")
    both = F.col("name").isNotNull() & (F.coalesce("commercial_name", F.lit("")) != "")
    return found.select(*_candidate(1, F.array(F.lit("website")), F.when(both, _scores(website=1.0, company_name=0.8)).otherwise(_scores(website=1.0)), "exact_domain"))


def by_phone(keys: DataFrame, companies: DataFrame) -> DataFrame:
    """Only where exactly one company has the phone: counted for each phone before the join."""
    owners = companies.select("domain", F.explode(F.array_distinct("phone_numbers")).alias("phone"))
    only = owners.groupBy("phone").agg(F.count_distinct("domain").alias("n"), F.min("domain").alias("domain")).filter("n = 1").drop("n")
    return keys.select("input_id", "phone").filter("phone is not null").join(only, "phone").select(*_candidate(2, F.array(F.lit("phone")), _scores(phone=0.95), "exact_phone"))


def by_facebook(keys: DataFrame, companies: DataFrame) -> DataFrame:
    first = companies.filter("facebook_id is not null").groupBy("facebook_id").agg(F.min("domain").alias("domain"))
    return keys.select("input_id", "facebook_id").filter("facebook_id is not null").join(first, "facebook_id").select(*_candidate(3, F.array(F.lit("facebook")), _scores(facebook=0.90), "exact_facebook"))


def best(candidates: DataFrame) -> DataFrame:
    one = Window.partitionBy("input_id").orderBy("rank", "domain")
    return candidates.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")


def name_index(companies: DataFrame) -> TextIndex:
    """The index of the name fields, written once: all searches read it."""
    tokens = {f: name_tokens(F.array_join(f, " ") if f == "all_names" else F.col(f)) for f in FIELDS}
    return TextIndex.build(companies, "domain", tokens | {"grams": grams(F.col("commercial_name"))}).written()


def name_terms(keys: DataFrame, index: TextIndex, prefix: int, boost: float) -> DataFrame:
    """qid, field, token, weight of the name clauses: fuzzy terms of each field, grams."""
    named = keys.filter("name is not null").select(F.col("input_id").alias("qid"), "name")
    lists = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(w * boost).alias("weight")) for f, w in FIELDS.items()])
    terms = named.select("qid", F.explode(F.array_distinct(name_tokens(F.col("name")))).alias("token")).select("qid", "token", F.inline(lists))
    runs = named.select("qid", F.lit("grams").alias("field"), F.explode(F.array_distinct(grams(F.col("name")))).alias("token"), F.lit(BOOST["grams"]).alias("weight"))
    return expand_fuzzy(terms, index.terms, prefix).unionByName(runs)


def _contenders(terms: DataFrame, index: TextIndex, extra: DataFrame) -> DataFrame:
    found = contenders(terms, index, {"name": tuple(FIELDS), "grams": ("grams",)}, extra)
    return found.select(F.col("qid").alias("input_id"), F.col("key").alias("domain"), "score")


def top_one(scored: DataFrame) -> DataFrame:
    """Scores that differ by rounding errors only, as sums in another order do, are ties."""
    one = Window.partitionBy("input_id").orderBy(F.desc(F.round("score", 6)), "domain")
    return scored.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")


def by_composite(keys: DataFrame, companies: DataFrame, index: TextIndex) -> DataFrame:
    """At least two usable fields: clause scores of keys and names summed, the best company."""
    several = keys.filter(F.size("usable") >= 2)
    phones = companies.select(F.col("domain").alias("key"), F.explode(F.array_distinct("phone_numbers")).alias("phone"))
    spread = phones.groupBy("phone").agg(F.count(F.lit(1)).alias("df"))
    total = companies.agg(F.count(F.lit(1)).alias("total"))  # one row
    owners = phones.join(spread, "phone").crossJoin(F.broadcast(total))
    idf = F.ln(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    hits = several.join(owners, "phone").select(F.col("input_id").alias("qid"), "key", (F.lit(BOOST["phone"]) * idf).alias("score"))
    scored = _contenders(name_terms(several, index, 0, BOOST["name"]), index, hits)
    found = top_one(scored).join(several.select("input_id", "phone", "name"), "input_id").join(companies.select("domain", "phone_numbers"), "domain")
    same = F.coalesce(F.array_contains("phone_numbers", F.col("phone")), F.lit(False))
    fields = F.array_compact(F.array(F.when(same, F.lit("phone")), F.when(F.col("name").isNotNull(), F.lit("name"))))
    c = agreement(squash(F.col("score")), F.size(fields))
    scores = F.map_from_entries(F.transform(fields, lambda f: F.struct(F.when(f == "name", "company_name").otherwise(f), c)))
    return found.filter(c > COMPOSITE).select(*_candidate(4, fields, scores, "composite_multi_field"))


def by_name(keys: DataFrame, companies: DataFrame, index: TextIndex) -> DataFrame:
    """Name as the only usable field."""
    alone = keys.filter((F.size("usable") == 1) & F.col("name").isNotNull())
    whole = companies.select(F.lower("commercial_name").alias("name"), F.col("domain").alias("key"))
    same = alone.join(whole, "name").select(F.col("input_id").alias("qid"), "key", F.lit(BOOST["exact"]).alias("score"))
    found = top_one(_contenders(name_terms(alone, index, 1, 1.0), index, same))
    c = squash(F.col("score"))
    return found.filter(c > NAME_ONLY).select(*_candidate(5, F.array(F.lit("name")), F.create_map(F.lit("company_name"), c), "fuzzy_name"))


def match_companies(inputs: DataFrame, companies: DataFrame, fuzzy: bool = True) -> DataFrame:
    """input_id, domain, matched_on, scores, match_source, confidence, match_quality for all inputs.

    Inputs without a match keep a row with a null domain, confidence 0 and quality NO_MATCH.
    """
    keys = normalize_inputs(inputs)
    exact = best(by_domain(keys, companies).unionByName(by_phone(keys, companies)).unionByName(by_facebook(keys, companies)))
    found = exact
    if fuzzy:
        left = stored(keys.join(exact.select("input_id"), "input_id", "left_anti"))
        index = name_index(companies)
        found = exact.unionByName(best(by_composite(left, companies, index).unionByName(by_name(left, companies, index))))
    out = keys.select("input_id").join(found, "input_id", "left")
    confidence = F.coalesce(weighted_confidence(F.col("scores")), F.lit(0.0))
    return out.withColumn("confidence", confidence).withColumn("match_quality", F.when(F.col("domain").isNull(), "NO_MATCH").otherwise(match_quality(F.col("confidence"), F.col("matched_on"))))
