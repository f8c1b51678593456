"""Queries of the training-data operators; each takes (spark, folder of the tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .canonical import canonical_places, map_values
from .layout import layout_duplicates, layout_records
from .leakage import leaked_items
from .lookalike import consistent_form, look_alike_matches
from .packing import containers, pack
from .quantiles import disagreeing_parts, exact_quantiles, quantile_sketches, sketch_quantiles
from .subjects import subject_areas
from .survivors import consensus_fields, surviving_fields
from .terms import term_frequencies

#: Percentiles of populations that are reported.
PERCENTILES = [0.01, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "demo_city").where(F.col("population") > 0)
    return layout_duplicates(rows, "row_id", ["city", "country"], ["population"])


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "demo_city").where(F.col("population") > 0)
    return layout_records(rows, "row_id", ["city", "country"], ["population"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = term_frequencies(_table(spark, sf_dir, "demo_city"), ["city", "country"])
    return terms.where(F.col("mark").isNotNull()).select("field_name", "term", "mark")


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequencies(_table(spark, sf_dir, "demo_city"), ["city", "country"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cities, places = _table(spark, sf_dir, "demo_city"), _table(spark, sf_dir, "ref_places")
    coded = places.join(_table(spark, sf_dir, "ref_countries").select("country_id", "code"), "country_id", "left")
    return look_alike_matches(cities, "row_id", "city", "country", coded, "place_id", "city", "country", "code")


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent_form(_table(spark, sf_dir, "demo_city"), "city", ["row_id", "city"]).select("row_id", "city", "form", "key")


def _stated_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of demo_city with a population whose country is spelled as in ref_countries."""
    rows = _table(spark, sf_dir, "demo_city").where(F.col("population") > 0).select("country", "batch_no", "population")
    return rows.join(_table(spark, sf_dir, "ref_countries").select("country").distinct(), "country", "left_semi")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disagreeing_parts(_stated_populations(spark, sf_dir), "country", "batch_no", "population")


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each country: exact ones, found from the bounds of the sketches, and whether these bounds hold."""
    found = exact_quantiles(_stated_populations(spark, sf_dir), ["country"], "population", PERCENTILES)
    holds = (F.col("low") <= F.col("exact")) & (F.col("exact") <= F.col("high")) & (F.col("low") <= F.col("value")) & (F.col("value") <= F.col("high"))
    return found.select("country", "n", "q", "exact", holds.alias("holds"))


def p4_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each country from its sketch alone, with the bounds of each."""
    sketches = quantile_sketches(_stated_populations(spark, sf_dir), ["country"], "population")
    return sketch_quantiles(sketches, ["country"], PERCENTILES)


def _ranked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = _table(spark, sf_dir, "feeds").groupBy("feed").agg(F.min("trust_rank").alias("trust_rank"))
    rows = _table(spark, sf_dir, "demo_city").select("row_id", "entry_no", "feed", "city", "country", "population", "recorded_at")
    return rows.join(ranks, "feed", "left")


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("trust_rank"), -F.unix_micros(F.col("recorded_at").cast("timestamp"))]
    return surviving_fields(_ranked_rows(spark, sf_dir), "entry_no", "row_id", ["city", "country", "population"], order)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = ["city_row_id", "country_row_id", "population_row_id"]
    return _survivors(spark, sf_dir).dropna(subset=ids).select("entry_no", *ids)


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir).select(
        "entry_no", "n_rows", "city", "country", F.col("population").cast("int").alias("population")
    )


def p5_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City and country of each entry by consensus of tokens; a row votes with 1 by the rank of its feed."""
    rows = _ranked_rows(spark, sf_dir)
    order = [F.col("trust_rank"), -F.unix_micros(F.col("recorded_at").cast("timestamp"))]
    found = consensus_fields(rows, "entry_no", "row_id", ["city", "country"], order, F.lit(1.0) / F.col("trust_rank"))
    return found.select("entry_no", "n_rows", "city_row_id", "city", "country_row_id", "country")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, countries = _table(spark, sf_dir, "ref_places"), _table(spark, sf_dir, "ref_countries")
    return canonical_places(_table(spark, sf_dir, "demo_city"), "row_id", places, countries)


def p6_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest place of the Latin letters of each distinct city, whatever the country."""
    letters = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z]", ""))
    none = F.lit(None).cast("long").alias("scope")
    values = _table(spark, sf_dir, "demo_city").select(letters("city").alias("value"), none).distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = _table(spark, sf_dir, "ref_places").select(F.col("place_id").alias("ref_id"), letters("city").alias("text"), none)
    found = map_values(values.repartition(parts, "value"), entries, affixes=[])
    return found.select("value", "ref_id", F.round("jaccard", 6).alias("jaccard"), F.round("share", 6).alias("share"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(_table(spark, sf_dir, "documents"), "doc_id", F.octet_length("text"))
    return packed.where((F.col("parts") > 1) & (F.col("part") == 0)).select("doc_id")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(pack(_table(spark, sf_dir, "documents"), "doc_id", F.octet_length("text")))


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing in one row: what was packed, containers that hold too much, and whether there are more than needed.

    No packing has fewer containers than the tokens fill; 2 % and one container a group more are allowed.
    """
    packed = pack(_table(spark, sf_dir, "documents"), "doc_id", F.octet_length("text"))
    held = containers(packed)
    totals = packed.agg(F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"))
    bins = held.agg(
        F.sum((F.col("unused") < 0).cast("int")).alias("overfull"), F.count(F.lit(1)).alias("_n"), F.count_distinct("group_no").alias("_groups"),
        F.sum("used").alias("_used"),
    )
    wasteful = F.col("_n") > 1.02 * F.ceil(F.col("_used") / 8192) + F.col("_groups")
    return totals.crossJoin(bins).select("documents", "pieces", "tokens", "overfull", wasteful.alias("wasteful"))  # one row each


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_passages(spark, sf_dir).where("kind = 'verbatim'").select("doc_id", "item_id").distinct()


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items")
    return leaked_items(docs, "doc_id", "text", items, "item_id", "text")


def p8_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest, then first, run of consecutive words of each document and item that share 13 or more."""
    return p8_passages(spark, sf_dir).where("kind = 'verbatim'").select("doc_id", "item_id", "words", "first_word")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subject_areas(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "doc_labels"))
    return found.select("doc_id", "subject").distinct()


def queries() -> dict:
    own = globals()
    return {name: own[name] for name in sorted(own) if name[:1] == "p" and name[1:2].isdigit()}
