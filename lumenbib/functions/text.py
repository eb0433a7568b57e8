"""Text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that open or close no candidate phrase (fixed values).
STOPWORDS = (
    "a about above after again against ain all am an and any are aren as at be because been before being below between both but by can couldn d did didn do "
    "does doesn doing don down during each few for from further had hadn has hasn have haven having he her here hers herself him himself his how i if in "
    "into is isn it its itself just ll m ma me mightn more most mustn my myself needn no nor not now o of off on once only or other our ours ourselves out "
    "over own re s same shan she should shouldn so some such t than that the their theirs them themselves then there these they this those through to too "
    "under until up ve very was wasn we were weren what when where which while who whom why will with won wouldn y you your yours yourself yourselves "
).split()
TOKEN = r"[a-z0-9]+(?:-[a-z0-9]+)*"


def whitespace(x: Column) -> Column:
    """Runs of white space as one space, ends cut; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))


def is_blank(x: Column) -> Column:
    return x.isNull() | (F.length(F.trim(x)) == 0)


def normalize_doi(x: Column) -> Column:
    """Lower case, without resolver address or `doi:`; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(F.trim(x)), r"^(https?://(dx\.)?doi\.org/|doi:)", "")), F.lit(""))


def normalize_external_id(x: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(F.trim(x), "/+$", "")), F.lit(""))


def last_segment(x: Column) -> Column:
    """What follows the last slash of an address, trailing slashes aside."""
    return F.substring_index(F.regexp_replace(x, "/+$", ""), "/", -1)


def normalize_keyword(x: Column) -> Column:
    return F.lower(F.trim(x))


def truncate(x: Column, limit: int) -> Column:
    """Normalised text of at most limit characters, the last three being dots if something was cut off."""
    t = whitespace(x)
    cut = F.substring(t, 1, limit) if limit <= 3 else F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("..."))
    return F.when(F.length(t) <= limit, t).otherwise(cut)


def embedding_text(title: Column, abstract: Column, topics: Column, keywords: Column) -> Column:
    """The lines Title, Abstract, Topics and Keywords, of those that hold anything."""
    line = lambda name, v: F.concat(F.lit(name + ": "), v)
    joined = lambda a: F.nullif(F.array_join(F.filter(F.transform(a, whitespace), lambda x: x.isNotNull()), ", "), F.lit(""))
    return F.concat_ws("\n", line("Title", whitespace(title)), line("Abstract", whitespace(abstract)), line("Topics", joined(topics)), line("Keywords", joined(keywords)))


def text_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def topic_of_cluster(key: Column) -> Column:
    """The number in `topic:<number>`, -1 for anything else."""
    return F.coalesce(F.expr("1") * F.nullif(F.regexp_extract(key, r"^topic:(\d{1,18})$", 1), F.lit("")).cast("bigint"), F.lit(-1)).cast("bigint")


def merge_keywords(taxonomy: Column, extracted: Column) -> Column:
    """Taxonomy keywords, then extracted ones: trimmed, blanks dropped, of those that differ in case only the first kept."""
    all_ = F.filter(F.transform(F.concat(F.coalesce(taxonomy, F.array().cast("array<string>")), F.coalesce(extracted, F.array().cast("array<string>"))), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
    keep = lambda seen, x: F.when(F.exists(seen, lambda y: F.lower(y) == F.lower(x)), seen).otherwise(F.concat(seen, F.array(x)))
    return F.aggregate(all_, F.array().cast("array<string>"), keep)


def candidate(x: Column, longest: int = 4) -> Column:
    """The cleaned candidate phrase, or null: at most `longest` tokens, a letter somewhere, no stopword at either end."""
    t = F.regexp_extract_all(F.lower(x), F.lit(f"({TOKEN})"), 1)
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    ok = (F.size(t) > 0) & (F.size(t) <= longest) & F.array_join(t, " ").rlike("[a-z]") & ~F.array_contains(stop, F.get(t, F.lit(0))) & ~F.array_contains(stop, F.element_at(F.concat(F.array(F.lit("")), t), -1))
    return F.when(ok, F.array_join(t, " "))


def inverted_index_text(index: Column) -> Column:
    """map<token, positions> as text in order of position; of tokens at one place the later in the map stays."""
    flat = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    numbered = F.transform(flat, lambda x, i: F.struct(x["p"].alias("p"), i.alias("i"), x["w"].alias("w")))
    last = F.filter(numbered, lambda x: ~F.exists(numbered, lambda y: (y["p"] == x["p"]) & (y["i"] > x["i"])))
    return F.nullif(F.array_join(F.transform(F.array_sort(last), lambda x: x["w"]), " "), F.lit(""))


def compact_json(fields: dict[str, Column]) -> Column:
    """A JSON object of the fields, leaving out null, '' and empty arrays; 0 and false stay."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "true"})
