"""Queries of the operators; each takes (spark, folder of the tables) and covers its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..operators import constraints as I
from ..operators import dedup as D
from ..operators import features as M
from ..operators import outliers as O
from ..operators import transform as P
from ..sources import io
from ..storage import new_folder
from ..streaming import cleaning as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

HOSPITAL = I.parse_rules({"rules": [
    {"type": "fd", "value": ["ZIPCode | City, State"]},
    {"type": "fd", "value": ["ProviderNumber | City, PhoneNumber"]},
]})


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dirty_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("  "), F.upper("p_name"), F.lit("!"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").withColumn("p_name", dirty)


def _dirty_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    segment = F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, "").otherwise(F.col("c_mktsegment"))
    balance = F.when((k % 11 == 0) | (k % 17 == 0), F.lit(None)).otherwise(F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").withColumns({"c_mktsegment": segment, "c_acctbal": balance})


def _dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    mixed = F.when(k == 0, "12").when(k == 1, "1.5").when(k == 2, F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", mixed.alias("mixed"))


# ---- projections


@query
def select_cols(spark, d):
    return P.select(table(spark, d, "orders"), ["o_custkey", "o_orderkey"])


@query
def select_idx(spark, d):
    return P.select_positions(table(spark, d, "orders"), [0, 2, 3])


@query
def keep_cols(spark, d):
    return P.keep_columns(table(spark, d, "orders"), ["o_totalprice", "o_orderkey"])


@query
def drop_cols(spark, d):
    return P.drop_columns(table(spark, d, "orders"), ["o_orderdate", "o_orderpriority"])


@query
def rename_cols(spark, d):
    return P.rename_columns(table(spark, d, "supplier"), [("s_name", "supplier"), ("s_acctbal", "balance")])


@query
def move_col(spark, d):
    return P.move_column(table(spark, d, "supplier"), "s_acctbal", "s_suppkey", "after")


@query
def cast_cols(spark, d):
    events = table(spark, d, "events").select("event_id", F.regexp_extract("props", r"(\d+)", 1).alias("k"), "event_type")
    return P.cast_columns(events, [("k", "integer"), ("event_type", "double"), ("event_id", "string")])


@query
def set_col_expr(spark, d):
    return P.set_columns(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), ["l_quantity"], lambda c: c * 2 + 1, "double")


@query
def set_col_python(spark, d):
    return P.set_columns(table(spark, d, "nation"), ["n_name"], lambda name: name[::-1].lower(), "string", python=True)


@query
def split_str_col(spark, d):
    return P.split_column(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", ["first", "second", "third"], " ")


@query
def add_primary_key_det(spark, d):
    return P.add_ordered_key(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], "id")


@query
def add_primary_key(spark, d):
    keyed = P.add_primary_key(table(spark, d, "orders").select("o_orderkey"))
    return keyed.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"))


@query
def add_count(spark, d):
    return P.add_count(table(spark, d, "nation"), "counts", 7)


@query
def sql_this(spark, d):
    return P.sql(table(spark, d, "orders"), "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS dearest FROM __THIS__ GROUP BY o_custkey")


@query
def columns_by_type(spark, d):
    from ..functions.columns import columns_of_type

    df = table(spark, d, "lineitem")
    rows = [(kind, name) for kind in ("string", "integer", "double", "date") for name in columns_of_type(df, kind)]
    return spark.createDataFrame(rows, "type string, name string")


# ---- filters and null handling


@query
def delete_row(spark, d):
    return P.filter_rows(table(spark, d, "lineitem"), F.col("l_quantity") > 45).select("l_orderkey", "l_linenumber", "l_quantity")


def _by_type(kind: str):
    return lambda spark, d: P.filter_by_type(_dirty_events(spark, d), "mixed", kind)


for _kind in ("integer", "float", "string", "null"):
    QUERIES[f"row_filter_by_type_{_kind}"] = _by_type(_kind)


@query
def row_filter_by_type_city(spark, d):
    return P.filter_by_type(table(spark, d, "demo_city").select("row_id", "city"), "city", "null")


@query
def remove_empty_rows_any(spark, d):
    return P.remove_empty_rows(table(spark, d, "demo_gdp"), "any")


@query
def remove_empty_rows_all(spark, d):
    return P.remove_empty_rows(table(spark, d, "demo_city").select("city", "country", "population"), "all")


@query
def replace_na(spark, d):
    return P.replace_nulls(table(spark, d, "demo_gdp"), {"city": "nowhere", "population": -1, "averageGDP": 0.0})


@query
def replace_na_number(spark, d):
    return P.replace_nulls(_dirty_customer(spark, d), 0.5, "*")


@query
def empty_str_to_str(spark, d):
    return P.empty_to_text(_dirty_customer(spark, d).select("c_custkey", "c_mktsegment"), "*", "none given")


@query
def impute_mean(spark, d):
    filled = P.impute(table(spark, d, "demo_gdp").select("row_id", "averageGDP", "population"), ["averageGDP", "population"], ["gdp", "people"], "mean")
    return filled.select("row_id", F.round("gdp", 4).alias("gdp"), F.round("people", 4).alias("people"))


@query
def impute_median(spark, d):
    return P.impute(table(spark, d, "demo_gdp").select("row_id", "averageGDP"), ["averageGDP"], ["gdp"], "median").select("row_id", "gdp")


@query
def replace_col(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return P.replace_value(P.replace_value(df, "BUILDING", "CONSTRUCTION", "*"), 7, 70, ["c_nationkey"])


@query
def lookup_list(spark, d):
    return P.lookup(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "URGENT", ["1-URGENT", "2-HIGH"])


@query
def lookup_dict(spark, d):
    chain = {"high": ["1-URGENT", "2-HIGH"], "any": ["high", "3-MEDIUM"], "low": ["5-LOW"]}
    return P.lookup(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", chain)


@query
def replace_by_id(spark, d):
    ids = table(spark, d, "orders").where("o_totalprice > 400000").select("o_custkey")
    return P.replace_by_id(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "GOLD", "c_mktsegment", ids, "c_custkey")


# ---- texts and dates


@query
def lower_case(spark, d):
    return P.lower_case(table(spark, d, "demo_city").select("row_id", "city", "country"), "*")


@query
def upper_case(spark, d):
    return P.upper_case(table(spark, d, "part").select("p_partkey", "p_name"), ["p_name"])


@query
def trim_col(spark, d):
    return P.trim(table(spark, d, "demo_city").select("row_id", "city", "country"), "*")


@query
def clear_accents(spark, d):
    return P.clear_accents(table(spark, d, "documents").select("doc_id", "text"), "text")


@query
def clear_accents_places(spark, d):
    return P.clear_accents(table(spark, d, "ref_places").select("place_id", "city", "country"), ["city", "country"])


@query
def remove_special_chars(spark, d):
    return P.remove_special_chars(table(spark, d, "demo_city").select("row_id", "city", "country"), "*")


@query
def remove_special_chars_regex(spark, d):
    return P.remove_special_chars_regex(table(spark, d, "demo_city").select("row_id", "city"), "city", "[^A-Za-z]")


@query
def date_transform(spark, d):
    dates = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    broken = dates.withColumn("day", F.when(F.col("o_orderkey") % 10 == 0, "unknown").otherwise(F.col("day")))
    return P.transform_dates(broken, "day", "dd/MM/yyyy", "yyyy-MM")


@query
def age_calculate(spark, d):
    dates = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return P.calculate_age(dates, "day", "yyyy-MM-dd", "age", "2024-03-15").select("o_orderkey", F.regexp_replace("age", ",", "").cast("double").alias("age"))


# ---- rows


@query
def count_items(spark, d):
    return P.count_items(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "urgent", "1-URGENT")


@query
def remove_duplicates(spark, d):
    return P.remove_duplicates(table(spark, d, "demo_city").select("city", "country", "population"), ["city", "country", "population"])


@query
def remove_duplicates_det(spark, d):
    return P.remove_duplicates(table(spark, d, "demo_city").select("row_id", "city", "country", "population"), ["city", "country"], [F.col("row_id")])


# ---- clusters and records


@query
def fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"))


@query
def fingerprint_city(spark, d):
    return table(spark, d, "demo_city").select("row_id", X.fingerprint(F.col("city")).alias("fingerprint"))


@query
def key_collision_clusters(spark, d):
    return D.key_collision(_dirty_part(spark, d), "p_name", "p_partkey")


@query
def key_collision_city(spark, d):
    return D.key_collision(table(spark, d, "demo_city"), "city", "row_id")


@query
def dedup_resolve_fingerprint(spark, d):
    dirty = _dirty_part(spark, d).select("p_partkey", "p_name")
    return D.resolve(dirty, "p_name", D.key_collision(dirty, "p_name", "p_partkey"))


@query
def dedup_resolve_city(spark, d):
    rows = table(spark, d, "demo_city").select("row_id", "city")
    return D.resolve(rows, "city", D.key_collision(rows, "city", "row_id"))


@query
def lineitem_fingerprint_resolve(spark, d):
    name = F.concat(F.col("l_returnflag"), F.col("l_linestatus"), F.lit(" supplier "), F.col("l_suppkey").cast("string"))
    dirty = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit(" "), F.upper(name), F.lit("!"))).otherwise(name)
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), dirty.alias("name"))
    return D.resolve(rows, "name", D.key_collision(rows, "name", "line"))


@query
def cluster_affected_rows(spark, d):
    return D.rows_affected(D.key_collision(_dirty_part(spark, d), "p_name", "p_partkey"))


@query
def cluster_preview(spark, d):
    return D.preview(D.key_collision(table(spark, d, "demo_city"), "country", "row_id"), 5)


@query
def record_matching(spark, d):
    return D.record_matching(_dirty_part(spark, d), ["p_name"], ["p_brand", "p_size"], "p_partkey").withColumn("key", F.col("key")[0])


@query
def record_matching_city(spark, d):
    fixes = D.record_matching(table(spark, d, "demo_city"), ["city", "country"], ["population"], "row_id")
    return fixes.withColumn("key", F.array_join("key", "|"))


@query
def resolve_records(spark, d):
    dirty = _dirty_part(spark, d)
    fixes = D.record_matching(dirty, ["p_name"], ["p_brand", "p_size"], "p_partkey")
    return D.resolve_records(dirty.select("p_partkey", "p_name", "p_brand", "p_size"), ["p_name"], ["p_brand", "p_size"], fixes)


@query
def matched_rows(spark, d):
    fixes = D.record_matching(_dirty_part(spark, d), ["p_name"], ["p_brand"], "p_partkey")
    return D.matched_rows(_dirty_part(spark, d), ["p_name"], fixes, "p_partkey").select("p_partkey")


@query
def build_pairs(spark, d):
    return D.build_pairs(table(spark, d, "nation"), ["n_name"], "n_nationkey")


@query
def build_pairs_blocked(spark, d):
    return D.build_pairs(table(spark, d, "supplier"), ["s_name"], "s_suppkey", "s_nationkey")


def _pairs(method: str):
    def run(spark, d):
        pairs = D.blocked_pairs(table(spark, d, "part"), "p_name", "p_partkey", 6, method, 0.6)
        return pairs.withColumn("similarity", F.round("similarity", 6))

    return run


for _method in S.METHODS:
    QUERIES[f"lsh_pairs_{_method}"] = _pairs(_method)


@query
def lsh_resolve(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name")
    return D.resolve(rows, "p_name", D.blocked_pairs(rows, "p_name", "p_partkey", 6, "levenshtein", 0.6))


@query
def lsh_matched_rows(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name")
    return D.pair_rows(rows, "p_name", D.blocked_pairs(rows, "p_name", "p_partkey", 6, "levenshtein", 0.6), "p_partkey")


@query
def lsh_pairs_city(spark, d):
    """Hot blocks: many spellings of one city share theirs."""
    pairs = D.blocked_pairs(table(spark, d, "demo_city"), "city", "row_id", 4, "hamming", 0.85)
    return pairs.select("value_l", "value_r", F.round("similarity", 6).alias("similarity"), "canonical", "total")


@query
def record_preview(spark, d):
    """The ten largest groups with a fix, one row for each of their rows."""
    dd = D.Deduplicator(table(spark, d, "demo_city").select("row_id", "city", "country", "population"), "row_id")
    fixes = dd.record_matching(["city", "country"], ["population"])
    shown = dd.preview_records(fixes, 10, ["city", "country"])
    return shown.select(F.array_join("key", "|").alias("key"), "column", "canonical", "total", "row_id")


@query
def record_variants(spark, d):
    dirty = _dirty_part(spark, d).select("p_partkey", "p_name", "p_brand")
    fixes = D.record_matching(dirty, ["p_name"], ["p_brand"], "p_partkey")
    return D.record_variants(dirty.drop("p_partkey"), ["p_name"], fixes).withColumn("key", F.col("key")[0])


# ---- functional dependencies


def _hospital(spark, d):
    return table(spark, d, "hospital_like")


@query
def fd_violations(spark, d):
    return I.violations(_hospital(spark, d), HOSPITAL[0])


@query
def fd_histogram(spark, d):
    return I.histogram(_hospital(spark, d), HOSPITAL[1])


@query
def fd_violations_orders(spark, d):
    return I.violations(table(spark, d, "orders"), I.Dependency(("o_custkey",), ("o_orderpriority",)))


@query
def fd_row_rules(spark, d):
    return I.row_rules(_hospital(spark, d), HOSPITAL, "row_id").withColumn("rules", F.array_join(F.col("rules").cast("array<string>"), ","))


@query
def fd_repair_greedy(spark, d):
    return I.repair_greedy(_hospital(spark, d), HOSPITAL)


@query
def fd_repair_greedy_orders(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return I.repair_greedy(orders, [I.Dependency(("o_custkey",), ("o_orderpriority",))])


@query
def replace_sub_df(spark, d):
    """The rarest combinations of each ZIP code become the most frequent ones, first for first."""
    counts = I.histogram(_hospital(spark, d), HOSPITAL[0])
    ends = counts.groupBy("ZIPCode").agg(F.min("count").alias("lo"), F.max("count").alias("hi")).where("lo < hi")
    both = counts.join(ends, "ZIPCode")
    bad, good = (both.where(f"count = {x}").select("ZIPCode", "City", "State") for x in ("lo", "hi"))
    return P.replace_sub_table(_hospital(spark, d), bad, good, ["ZIPCode"])


@query
def fd_repair_fixpoint(spark, d):
    """The left values that still violate the rule after ever more passes: those whose counts tie."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderpriority")
    rule = I.Dependency(("o_custkey",), ("o_orderpriority",))
    return I.violations(I.repair_greedy(orders, [rule], passes=4), rule)


@query
def fd_repair_holistic(spark, d):
    return I.repair_holistic(_hospital(spark, d), HOSPITAL, "row_id")


# ---- outliers and features


@query
def minmax_normalize(spark, d):
    return O.normalize(table(spark, d, "events").select("event_id", "value"), "value").withColumn("value", F.round("value", 9))


@query
def outlier_bounds(spark, d):
    return O.bounds_frame(table(spark, d, "events"), "value", accuracy=1_000_000)


@query
def outlier_flag(spark, d):
    return O.flag_outliers(table(spark, d, "demo_outlier_int"), "population", accuracy=1_000_000).select("row_id", "is_outlier")


@query
def outlier_delete(spark, d):
    return O.delete_outliers(table(spark, d, "events").select("event_id", "value"), "value", accuracy=1_000_000)


@query
def outlier_delete_price(spark, d):
    return O.delete_outliers(table(spark, d, "price_area"), "Price", accuracy=1_000_000)


@query
def outlier_ids(spark, d):
    return O.OutlierDetector(table(spark, d, "events").select("event_id", "value"), "value", accuracy=1_000_000, id_column="event_id").outlier_ids()


@query
def outlier_kmeans(spark, d):
    rated = O.distance_ratio(table(spark, d, "demo_gdp"), ["population", "averageGDP"], 3)
    return rated.select("row_id", F.round("distance_ratio", 6).alias("distance_ratio"))


@query
def outlier_centre_ratio(spark, d):
    """Ratios to given centres."""
    centres = [[1000.0, 500.0], [500_000.0, 20_000.0], [9_000_000.0, 60_000.0]]
    rated = O.centre_ratio(table(spark, d, "demo_gdp"), ["population", "averageGDP"], centres, [(0.0, 1000.0), (0.0, 10.0)], "ratio")
    return rated.select("row_id", F.round("ratio", 6).alias("ratio"))


@query
def outlier_kmeans_delete(spark, d):
    return O.delete_outliers_kmeans(table(spark, d, "demo_gdp"), ["population", "averageGDP"], 0.9).select("row_id")


@query
def vector_assemble(spark, d):
    made = M.vector_assembler(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    v = vector_to_array("features")
    return made.select("p_partkey", v[0].alias("a"), v[1].alias("b"))


@query
def minmax_scale_vec(spark, d):
    v = vector_to_array("scaled")
    rows = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return M.scale_vec_col(rows, ["p_size", "p_retailprice"], "scaled").select("p_partkey", F.round(v[0], 9).alias("a"), F.round(v[1], 9).alias("b"))


@query
def normalize_vec(spark, d):
    made = M.vector_assembler(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    v = vector_to_array("features_normalized")
    return M.normalizer(made, "features").select("p_partkey", F.round(v[0], 9).alias("a"), F.round(v[1], 9).alias("b"))


@query
def string_index(spark, d):
    return M.string_to_index(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "p_brand_index")


@query
def index_string_roundtrip(spark, d):
    indexed = M.string_to_index(table(spark, d, "part").select("p_partkey", "p_type"), "p_type")
    return M.index_to_string(indexed, "p_type_index").select("p_partkey", "p_type", F.col("p_type_index_string").alias("back"))


@query
def one_hot(spark, d):
    indexed = M.string_to_index(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")
    v = vector_to_array("c_mktsegment_index_encoded")
    return M.one_hot_encoder(indexed, "c_mktsegment_index").select("c_custkey", F.size(v).alias("size"), F.coalesce(F.array_position(v, 1.0), F.lit(0)).cast("int").alias("place"))


# ---- sources and sinks


@query
def csv_roundtrip(spark, d):
    path = new_folder(spark, "csv")
    io.write_csv(table(spark, d, "nation"), path, sep=";")
    return io.read_csv(spark, path, sep=";")


@query
def json_roundtrip(spark, d):
    path = new_folder(spark, "json")
    source = table(spark, d, "supplier")
    io.write_json(source, path)
    return spark.read.schema(source.schema).json(path)


@query
def csv_to_parquet(spark, d):
    a, b = new_folder(spark, "csv"), new_folder(spark, "parquet")
    io.write_csv(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), a)
    io.csv_to_parquet(spark, a, b, num_partitions=2)
    return spark.read.parquet(b)


@query
def parquet_read(spark, d):
    return io.read_parquet(spark, f"file://{d}/nation.parquet" if d.startswith("/") else f"{d}/nation.parquet")


@query
def create_data_frame(spark, d):
    return io.create_data_frame(spark, [(1, "a", 0.5), (2, None, 1.5)], ["k", "name", "x"])


def _served(spark: SparkSession) -> Path:
    """A new folder of the shared file system, whose files the driver reads by file:// URLs."""
    folder = Path(new_folder(spark, "url").removeprefix("file:"))
    folder.mkdir(parents=True)
    return folder


@query
def url_csv_read(spark, d):
    folder = _served(spark)
    table(spark, d, "region").toPandas().to_csv(folder / "region.csv", index=False)  # five rows
    return io.read_url(spark, f"file://{folder}/region.csv")


@query
def url_json_read(spark, d):
    folder = _served(spark)
    io.write_json_array(table(spark, d, "region"), str(folder / "region.json"))
    out = io.read_url(spark, f"file://{folder}/region.json", "json")
    return out.select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


@query
def checkpointed(spark, d):
    return P.Cleaner(table(spark, d, "supplier")).lower_case("s_name").check_point().upper_case("s_name").df


@query
def checkpointed_often(spark, d):
    """A long chain of operators whose plan is cut as it grows."""
    chain = P.Cleaner(table(spark, d, "supplier").select("s_suppkey", "s_name"), checkpoint_every=10)
    for _ in range(12):
        chain = chain.lower_case("s_name").upper_case("s_name")
    return chain.df


@query
def load_demo(spark, d):
    return io.load_demo(spark)


@query
def column_dictionary(spark, d):
    rows = [("n_name", "nation", "string"), ("n_regionkey", "region", "double")]
    pairs = io.ColumnDictionary(spark, df=spark.createDataFrame(rows, ["Feature Name", "Code Name", "DataType"]))
    df = P.rename_columns(table(spark, d, "nation"), pairs.read_col_names())
    return P.cast_columns(df, pairs.read_col_types())


# ---- streams


@query
def stream_clean_events(spark, d):
    clean = lambda df: P.filter_by_type(P.upper_case(df, ["event_type"]), "event_type", "null").select("event_id", "event_type")
    return R.run_available(R.read_stream(spark, f"{d}/events.parquet"), clean, new_folder(spark, "stream"))


@query
def stream_window_counts(spark, d):
    counts = lambda df: R.windowed_counts(df, "ts", "event_type", "1 hour", "10 minutes")
    return R.run_available(R.read_stream(spark, f"{d}/events.parquet"), counts, new_folder(spark, "stream"), "complete")
