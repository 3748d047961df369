"""The shorter pipelines: dictionary lookup, argmin matching, reconciliation, the municipality bridge, geocoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toponexus.functions import responses, text
from toponexus.functions.similarity import edit_distance
from toponexus.operators import phrases, relational
from toponexus.sources import providers


def dictionary_lookup(names: DataFrame, master: DataFrame, answers: DataFrame, glue: bool = True) -> DataFrame:
    """Rows (row_id, name, pos, match): the first phrase of each Latin name that the Arabic master (column name) holds.

    ``answers`` (token, cands) are the words' transliterations. ``glue`` writes the article together
    with its word; for a single word, its forms with and without article are tried as well.
    """
    key = F.lower(F.replace(text.strip(F.col("name")), F.lit("-"), F.lit(" ")))
    forms = names.select("row_id", "name", F.posexplode(text.article_variants(text.glue_article(key)) if glue else F.array(key)).alias("form", "key"))
    split = forms.select("row_id", "name", "form", F.posexplode(text.words(F.col("key"))).alias("pos", "token"))
    known = split.join(answers, "token", "left").withColumn("options", phrases.word_options(F.col("token"), F.col("cands"), None))
    ordered = known.groupBy("row_id", "name", "form").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "options"))), lambda x: x["options"]).alias("options"))
    # a phrase's first word is a word of some option, so only the names that begin with one are walked
    heads = F.array_distinct(F.flatten(F.transform(F.flatten("options"), lambda x: F.split(x, " "))))
    begun = ordered.withColumn("head", F.explode(heads))
    listed = master.where("name is not null").select(F.col("name").alias("match")).distinct().withColumn("head", F.element_at(F.split(F.ltrim("match"), " "), 1))
    made = begun.join(listed, "head").select("row_id", "name", "form", "match", phrases.place_in_product(F.col("options"), F.col("match")).alias("nth")).where("nth is not null")
    options = made.withColumn("pos", F.struct("form", "nth"))
    hits = relational.first_hit(options, listed.select("match"), "row_id", "pos", "match", ["name"])
    return hits.select("row_id", "name", F.col("pos.form").alias("form"), F.col("pos.nth").alias("nth"), "match")


def argmin_match(keys: DataFrame, names: DataFrame, band: int = 2) -> DataFrame:
    """Rows (key, latin, name, distance): for each (key, latin) the nearest of ``names`` (name, ord), kept where the lengths of name and key differ by ``band`` at most."""
    distance = edit_distance(F.col("latin"), F.col("name"))
    best = relational.nearest(keys, names, ["key", "latin"], distance, "ord")
    return best.where(text.within_length(F.col("name"), F.col("key"), band)).select("key", "latin", "name", "distance")


def latinise(keys: DataFrame, cache: DataFrame, fetch: providers.Fetch) -> DataFrame:
    """Rows (key, latin) through a cache (key, value): what it lacks is asked for."""
    got, lacks = relational.cached(keys, cache, "key")
    asked = providers.ask(lacks, "key", fetch).select("key", F.get("cands", F.lit(0)).alias("value"))
    known = got.where("value is not null").select("key", "value").unionByName(asked.where("value is not null"))
    return known.select("key", F.col("value").alias("latin")).distinct()


def bridge(arabic: DataFrame, english: DataFrame, arabic_towns: DataFrame, english_towns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fill both sides through two aligned lists of towns (row_id, town): equal position is equal town."""
    aligned = relational.by_position(
        arabic_towns.select(F.col("row_id").alias("i"), F.col("town").alias("town_ar")), english_towns.select(F.col("row_id").alias("j"), F.col("town").alias("town_en")), "i", "j"
    ).where("town_ar is not null and town_en is not null")
    open_english = relational.work_queue(english, "counterpart").select(F.col("name").alias("town_en")).distinct()
    pairs = aligned.join(open_english, "town_en", "left_semi").join(relational.work_queue(arabic, "counterpart").select(F.col("name").alias("town_ar")).distinct(), "town_ar", "left_semi")
    new_arabic = relational.fill_blank(arabic, pairs.select(F.col("town_ar").alias("name"), F.col("town_en").alias("__v"), F.col("i").alias("__o")), "name", "counterpart", "__v", "__o")
    new_english = relational.fill_blank(english, pairs.select(F.col("town_en").alias("name"), F.col("town_ar").alias("__v"), F.col("i").alias("__o")), "name", "counterpart", "__v", "__o")
    return new_arabic, new_english


def geocode(english: DataFrame, cache: DataFrame, fetch: providers.Fetch, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(English rows with the raw answer and the filled counterpart, the new pairs (key, value)).

    Only open names are asked for, and those of the cache (key, value) not again; an answer counts if
    it holds a place in the country.
    """
    gaps = relational.work_queue(english, "counterpart").select(F.col("name").alias("key")).distinct()
    got, lacks = relational.cached(gaps, cache, "key")
    asked = providers.ask(lacks, "key", fetch).select("key", F.get("cands", F.lit(0)).alias("raw"))
    hits = asked.where(F.col("raw").isNotNull() & responses.geocoder_hit(F.col("raw"), strict))
    found = hits.select("key", responses.place_name(F.col("raw")).alias("value"))
    known = got.where("value is not null and value <> ''").select("key", "value").unionByName(found.where("value is not null")).withColumn("o", F.lit(0))
    filled = relational.fill_blank(english, known.withColumnRenamed("key", "name"), "name", "counterpart", "value", "o")
    raw = hits.select(F.col("key").alias("name"), F.col("raw").alias("openMapsData"))
    return filled.join(raw, "name", "left").select(*english.columns, F.coalesce("openMapsData", F.lit("")).alias("openMapsData")), found
