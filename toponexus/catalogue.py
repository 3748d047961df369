"""Queries over the synthetic tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toponexus import sinks
from toponexus.functions import responses, similarity, text, translit
from toponexus.operators import assignment, near_names, phrases, relational
from toponexus.plans import linkage, lookups
from toponexus.sources import providers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its name."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    """
    WITH scored AS (
        SELECT s.s_suppkey AS eng_id, s.s_name AS eng_name, c.c_custkey AS cand_id, c.c_name AS cand,
               CAST(levenshtein(lower(s.s_name), lower(c.c_name)) AS DOUBLE) AS distance
        FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey)
    SELECT eng_id, eng_name, cand_id, cand, distance FROM (
        SELECT *, row_number() OVER (PARTITION BY eng_id ORDER BY distance, cand_id) AS rn FROM scored)
    WHERE rn = 1
    """
)
def blocked_levenshtein_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_names.best(*_sides(spark, sf_dir), 1, by_distance=True).select("eng_id", "eng_name", "cand_id", "cand", "distance")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers (eng_id, eng_name, block) and customers (cand_id, cand, block), with nations as blocks."""
    left = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("eng_id"), F.col("s_name").alias("eng_name"), F.col("s_nationkey").alias("block"))
    right = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cand_id"), F.col("c_name").alias("cand"), F.col("c_nationkey").alias("block"))
    return left, right


SCORED = """scored AS (
    SELECT s.s_suppkey AS eng_id, s.s_name AS eng_name, c.c_custkey AS cand_id, c.c_name AS cand, s.s_nationkey AS block,
           100 - 100 * CAST(levenshtein(lower(s.s_name), lower(c.c_name)) AS DOUBLE) / greatest(length(s.s_name), length(c.c_name)) AS score
    FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey)"""
RANKED = SCORED + """, ranked AS (
    SELECT *, row_number() OVER (PARTITION BY eng_id ORDER BY score DESC, cand_id) AS rn FROM scored)"""


@query(f"WITH {RANKED} SELECT eng_id, cand_id, round(score, 6) AS score, CAST(rn AS BIGINT) AS rn FROM ranked WHERE rn <= 5")
def blocked_topk5(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = near_names.best(*_sides(spark, sf_dir), 5)
    return best.select("eng_id", "cand_id", F.round("score", 6).alias("score"), F.col("rn").cast("long"))


@query(
    f"""WITH {RANKED} SELECT eng_id,
        max(CASE WHEN rn = 1 THEN cand END) AS "Cand1", round(max(CASE WHEN rn = 1 THEN score END), 6) AS "Cand1_Score",
        max(CASE WHEN rn = 2 THEN cand END) AS "Cand2", round(max(CASE WHEN rn = 2 THEN score END), 6) AS "Cand2_Score",
        max(CASE WHEN rn = 3 THEN cand END) AS "Cand3", round(max(CASE WHEN rn = 3 THEN score END), 6) AS "Cand3_Score"
    FROM ranked WHERE rn <= 3 GROUP BY eng_id"""
)
def review_pivot_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = near_names.best(*_sides(spark, sf_dir), 3).withColumn("score", F.round("score", 6))
    return relational.pivot_ranked(best, ["eng_id"], {"cand": "Cand{}", "score": "Cand{}_Score"})


@query(
    f"""WITH {RANKED} SELECT eng_id, cand, round(score, 6) AS score, score >= 80 AS accepted FROM ranked WHERE rn = 1"""
)
def accept_review_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = near_names.best(*_sides(spark, sf_dir), 1)
    return best.select("eng_id", "cand", F.round("score", 6).alias("score"), (F.col("score") >= 80).alias("accepted"))


@query(f"WITH {SCORED} SELECT block, count(*) AS n_pairs, count(*) FILTER (score >= 80) AS n_strong FROM scored GROUP BY block")
def threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_names.strong(*_sides(spark, sf_dir), 80)


@query(
    """WITH names AS (SELECT p_name AS name, min(p_partkey) AS ord FROM part GROUP BY p_name),
        pairs AS (SELECT n_nationkey AS id, n_name AS key, name, ord, CAST(levenshtein(lower(n_name), lower(name)) AS DOUBLE) AS distance FROM nation, names)
    SELECT id, key, name, distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, ord) AS rn FROM pairs) WHERE rn = 1"""
)
def cross_argmin_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = relational.ordered_distinct(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("ord")), "name", "ord")
    keys = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("key"))
    best = relational.nearest(keys, names, ["id", "key"], similarity.edit_distance(F.col("key"), F.col("name")), "ord")
    return best.select("id", "key", "name", "distance")


@query(
    """WITH names AS (SELECT p_name AS name, min(p_partkey) AS ord FROM part GROUP BY p_name),
        pairs AS (SELECT n_name AS key, n_name AS latin, name, ord, CAST(levenshtein(lower(n_name), lower(name)) AS DOUBLE) AS distance FROM nation, names),
        best AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY distance, ord) AS rn FROM pairs)
    SELECT key, latin, name, distance FROM best WHERE rn = 1 AND abs(length(name) - length(key)) <= 2"""
)
def argmin_length_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = relational.ordered_distinct(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("ord")), "name", "ord")
    keys = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_name").alias("latin"))
    return lookups.argmin_match(keys, names)


@query("SELECT c_custkey, lower(regexp_replace(trim(c_name), '[-_#]', ' ', 'g')) AS k, lower(regexp_replace(trim(c_mktsegment), '[-_]', ' ', 'g')) AS seg FROM customer")
def norm_hyphen_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.name_key(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("k"), text.name_key(F.col("c_mktsegment")).alias("seg"))


LATIN_NAMES = ["Al-Bireh", "el  Kfar", "Alma", "EL_Mina", "al:Ain", "Beit el Din", ""]
ARABIC_NAMES = ["البيرة", " ال-حي", "وادي خالد", "حي الوادي", "منارة-البحر", "بيت مري", "ال", "الحيّ القديم"]


def _values(names: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(names)) + ") AS t(id, name)"


def _literals(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "id int, name string")


@query(rf"SELECT id, regexp_replace(name, '^(al|el)[\s\-_:]+', '', 'i') AS bare FROM {_values(LATIN_NAMES)}")
def strip_latin_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literals(spark, LATIN_NAMES).select("id", text.drop_latin_article(F.col("name")).alias("bare"))


@query(rf"SELECT id, regexp_replace(name, '^\s*ال[\s\-_:]*', '') AS bare FROM {_values(ARABIC_NAMES)}")
def strip_arabic_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literals(spark, ARABIC_NAMES).select("id", text.drop_arabic_article(F.col("name")).alias("bare"))


_STOP = ", ".join(f"'{w}'" for w in text.LOCALITY_WORDS)


@query(
    rf"""WITH w AS (SELECT id, [x FOR x IN regexp_split_to_array(name, '[\s\-–—]+') IF x <> ''] AS p FROM {_values(ARABIC_NAMES)})
    SELECT id, array_to_string([regexp_replace(x, '^ال', '') FOR x IN p IF x NOT IN ({_STOP}) AND regexp_replace(x, '^ال', '') NOT IN ({_STOP})], ' ') AS core FROM w"""
)
def locality_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literals(spark, ARABIC_NAMES).select("id", text.drop_locality_words(F.col("name")).alias("core"))


@query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part")
def tokenize_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(text.words(F.col("p_name"))).alias("token")).distinct()


_CACHE = "(VALUES ('red', ['rouge', 'vermeil']), ('blue', ['bleu']), ('small', []), ('ring', ['anneau', 'bague'])) AS c(token, cands)"


def _cache(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("red", ["rouge", "vermeil"]), ("blue", ["bleu"]), ("small", []), ("ring", ["anneau", "bague"])], "token string, cands array<string>")


def _part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(text.words(F.col("p_name"))).alias("pos", "token"))


@query(f"SELECT DISTINCT token FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part) WHERE token NOT IN (SELECT token FROM {_CACHE})")
def token_anti_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.cached(_part_words(spark, sf_dir), _cache(spark), "token")[1]


@query(
    f"""SELECT p_partkey, t.token, CASE WHEN c.token IS NULL THEN 'unknown' WHEN len(cands) = 0 THEN 'miss' ELSE array_to_string(cands, '/') END AS known
    FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part) t LEFT JOIN {_CACHE} ON c.token = t.token"""
)
def token_left_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relational.cached(_part_words(spark, sf_dir), _cache(spark), "token")[0]
    known = F.when(F.col("cands").isNull(), "unknown").when(F.size("cands") == 0, "miss").otherwise(F.array_join("cands", "/"))
    return found.select("p_partkey", "token", known.alias("known"))


@query("SELECT doc_id, regexp_matches(text, '[éèêçñóíáßäöü]') AS accented FROM documents")
def contains_script_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike("[éèêçñóíáßäöü]").alias("accented"))


@query(rf"SELECT id, regexp_matches(name, '[\x{{0600}}-\x{{06FF}}\x{{0750}}-\x{{077F}}\x{{08A0}}-\x{{08FF}}]') AS arabic FROM {_values(ARABIC_NAMES + LATIN_NAMES)}")
def arabic_script_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literals(spark, ARABIC_NAMES + LATIN_NAMES).select("id", text.has_arabic(F.col("name")).alias("arabic"))


@query("SELECT doc_id, count(*) AS n_articles FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) WHERE regexp_full_match(w, '(?i)(al|el|the|le|la|de|du)') GROUP BY doc_id")
def article_token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"))).alias("w"))
    return words.where(text.is_article(F.col("w"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_articles"))


ANSWERS = ["بيت/1|بيد/2", "A/1|B/2|C/3", "", "X"]


@query(rf"SELECT id, array_to_string([x FOR x IN regexp_split_to_array(name, '(?:/[0-9]\|)|(?:/[0-9])') IF x <> ''], ',') AS cands FROM {_values(ANSWERS)}")
def candidate_regex_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literals(spark, ANSWERS).select("id", F.array_join(responses.candidates(F.col("name")), ",").alias("cands"))


@query(
    """WITH l AS (SELECT doc_id, regexp_extract_all(text, '[0-9]{2,}') AS l FROM documents)
    SELECT doc_id, array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF list_position(l, l[i]) = i], ' ') AS runs FROM l"""
)
def regexp_extract_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]{2,})"))), " ").alias("runs"))


RESPONSES = ['cb({"data":"{\\"r\\":\\"بيت/1|بيد/2\\"}"});', 'x.y({"data":"{\\"r\\":\\"\\"}"})', "cb(oops بيت مري oops)", "[]"]


@query("SELECT * FROM (VALUES (0, 'بيت,بيد'), (1, ''), (2, 'بيت مري'), (3, '')) AS t(id, cands)")
def jsonp_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literals(spark, RESPONSES).select("id", F.array_join(responses.transliterations(F.col("name")), ",").alias("cands"))


@query("""SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, coalesce(props->>'$.a', props->>'$.b', props->>'$.k') AS first_of FROM events""")
def json_path_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda name: F.get_json_object("props", f"$.{name}")
    return table(spark, sf_dir, "events").select("event_id", path("k").cast("long").alias("k"), F.coalesce(path("a"), path("b"), path("k")).alias("first_of"))


PLACES = ['[{"address":{"village":"Bsharri","county":"North","country_code":"lb"}}]', '[{"address":{"city":"Tyre","village":"x","country_code":"lb"}}]', "[]", '[{"address":{"state":"lb"}}]']


@query("SELECT * FROM (VALUES (0, true, true, 'Bsharri'), (1, true, true, 'Tyre'), (2, false, false, NULL), (3, true, false, NULL)) AS t(id, hit, strict_hit, place)")
def geocoder_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("name")
    return _literals(spark, PLACES).select("id", responses.geocoder_hit(c).alias("hit"), F.coalesce(responses.geocoder_hit(c, True), F.lit(False)).alias("strict_hit"), responses.place_name(c).alias("place"))


_OPTIONS = f"""opts AS (
    SELECT p_partkey, string_split(p_name, ' ')[1] AS w1, string_split(p_name, ' ')[2] AS w2 FROM part),
    known AS (
    SELECT p_partkey, CASE WHEN len(a.cands) > 0 THEN a.cands ELSE [w1] END AS o1, CASE WHEN len(b.cands) > 0 THEN b.cands ELSE [w2] END AS o2
    FROM opts LEFT JOIN {_CACHE.replace('AS c(', 'AS a(')} ON a.token = w1 LEFT JOIN {_CACHE.replace('AS c(', 'AS b(')} ON b.token = w2),
    phrases AS (SELECT p_partkey, [x || ' ' || y FOR x IN o1 FOR y IN o2] AS p FROM known)"""
_OPTIONS = _OPTIONS.replace("[x || ' ' || y FOR x IN o1 FOR y IN o2]", "flatten([[x || ' ' || y FOR y IN o2] FOR x IN o1])")


def _phrases(spark: SparkSession, sf_dir: str, most: int | None) -> DataFrame:
    known = relational.cached(_part_words(spark, sf_dir), _cache(spark), "token")[0]
    options = known.select("p_partkey", "pos", phrases.word_options(F.col("token"), F.col("cands"), None).alias("options"))
    ordered = relational.ordered_lists(options, "p_partkey", "options", "pos")
    return ordered.select("p_partkey", phrases.product(F.col("values"), most).alias("phrases"))


@query(f"WITH {_OPTIONS} SELECT p_partkey, array_to_string(p, '|') AS phrases FROM phrases")
def token_product_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrases(spark, sf_dir, None).select("p_partkey", F.array_join("phrases", "|").alias("phrases"))


@query(f"WITH {_OPTIONS} SELECT p_partkey, array_to_string(p[1:3], '|') AS phrases FROM phrases")
def token_product_phrases_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrases(spark, sf_dir, 3).select("p_partkey", F.array_join("phrases", "|").alias("phrases"))


@query(
    f"""WITH {_OPTIONS}, flat AS (SELECT p_partkey, unnest(p) AS match, unnest(range(0, len(p))) AS pos FROM phrases),
        master AS (SELECT * FROM (VALUES ('vermeil anneau'), ('rouge bague'), ('bleu bague'), ('small bague'), ('bleu bolt')) AS m(match))
    SELECT p_partkey, arg_min(match, pos) AS match, CAST(min(pos) AS BIGINT) AS pos FROM flat WHERE match IN (SELECT match FROM master) GROUP BY p_partkey"""
)
def dictionary_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _phrases(spark, sf_dir, None).select("p_partkey", F.posexplode("phrases").alias("pos", "match"))
    master = spark.createDataFrame([("vermeil anneau",), ("rouge bague",), ("bleu bague",), ("small bague",), ("bleu bolt",)], "match string")
    hits = relational.first_hit(flat, master, "p_partkey", "pos", "match")
    return hits.select("p_partkey", "match", F.col("pos").cast("long"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL")
def null_work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return relational.work_queue(both, "quality").select("doc_id")


@query("SELECT d.doc_id, CAST(quality AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL")
def notnull_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.where("quality is not null").select("doc_id", F.col("quality").cast("long"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O'")
def isin_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") == "O")).select("o_orderkey", "o_orderpriority")


@query("SELECT DISTINCT quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NOT NULL")
def dropna_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.select("quality").na.drop(subset=["quality"]).distinct()


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(asked, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(asked, "c_custkey", "left_anti")


@query(
    """WITH a AS (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS i FROM region), b AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS j FROM nation)
    SELECT i, r_name, n_name FROM a JOIN b ON i = j"""
)
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = relational.ordinals(table(spark, sf_dir, "region"), "r_regionkey", "i")
    right = relational.ordinals(table(spark, sf_dir, "nation"), "n_nationkey", "j")
    return relational.by_position(left, right, "i", "j").select("i", "r_name", "n_name")


@query(
    """SELECT s.s_suppkey, s.s_nationkey, coalesce(v.o_orderpriority, s.s_name) AS s_name FROM supplier s LEFT JOIN (
        SELECT o_custkey AS k, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey) v ON v.k = s.s_suppkey"""
)
def update_overwrite_lastwins(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    source = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "s_suppkey")
    return relational.overwrite(target, source, "s_suppkey", "s_name", "o_orderpriority", "o_orderkey")


_BLANKED = "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE s_name END AS s_name FROM supplier"


@query(
    f"""SELECT s.s_suppkey, CASE WHEN s.s_name IS NULL OR trim(s.s_name) = '' THEN coalesce(v.p, s.s_name) ELSE s.s_name END AS s_name FROM ({_BLANKED}) s LEFT JOIN (
        SELECT o_custkey AS k, arg_min(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY o_custkey) v ON v.k = s.s_suppkey"""
)
def update_fill_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    blanked = F.when(F.col("s_suppkey") % 3 == 0, F.lit(None)).when(F.col("s_suppkey") % 3 == 1, " ").otherwise(F.col("s_name"))
    target = table(spark, sf_dir, "supplier").select("s_suppkey", blanked.alias("s_name"))
    source = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "s_suppkey")
    return relational.fill_blank(target, source, "s_suppkey", "s_name", "o_orderpriority", "o_orderkey")


@query(
    """WITH l AS (SELECT n_nationkey AS row_id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE 'x' || n_nationkey END AS other FROM nation),
        r AS (SELECT n_nationkey AS row_id, 'x' || n_nationkey AS name, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS other FROM nation),
        l2 AS (SELECT l.row_id, l.name, coalesce(l.other, r.name) AS other FROM l LEFT JOIN r ON r.other = l.name),
        r2 AS (SELECT r.row_id, r.name, coalesce(r.other, l2.name) AS other FROM r LEFT JOIN l2 ON l2.other = r.name)
    SELECT 'left' AS side, row_id, name, other FROM l2 UNION ALL SELECT 'right', row_id, name, other FROM r2"""
)
def reconcile_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    coded = F.concat(F.lit("x"), F.col("n_nationkey"))
    left = nation.select(F.col("n_nationkey").alias("row_id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 != 0, coded).alias("other"))
    right = nation.select(F.col("n_nationkey").alias("row_id"), coded.alias("name"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).alias("other"))
    left, right = relational.reconcile(left, right, "name", "other", "name", "other", "row_id")
    return left.select(F.lit("left").alias("side"), "*").unionByName(right.select(F.lit("right").alias("side"), "*"))


@query("SELECT p_name FROM part EXCEPT ALL SELECT p_name FROM part WHERE p_size <= 10")
def bag_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return relational.bag_difference(part.select("p_name"), part.where("p_size <= 10").select("p_name"))


@query("SELECT k, count(*) AS n FROM (SELECT o_orderkey AS k FROM orders UNION ALL SELECT l_orderkey FROM lineitem) GROUP BY k")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).unionByName(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")))
    return both.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.set_union(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")))


@query("SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def ordered_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.ordered_distinct(table(spark, sf_dir, "part").select("p_name", "p_partkey"), "p_name", "p_partkey")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def lastwins_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.last_wins(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("SELECT user_id, event_type, max(value) AS value FROM events GROUP BY ALL HAVING max(value) > 0")
def max_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.merge_max(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value")


@query("SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS keys FROM orders GROUP BY o_custkey")
def group_ordered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = relational.ordered_lists(table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey").cast("string")), "o_custkey", "k", "o_orderkey")
    return lists.select("o_custkey", F.array_join("values", ",").alias("keys"))


@query(
    f"""WITH {RANKED} SELECT block, count(DISTINCT eng_id) AS eng_count, count(DISTINCT cand) AS cand_count,
        greatest(count(DISTINCT eng_id), count(DISTINCT cand)) AS square_size,
        CASE WHEN greatest(count(DISTINCT eng_id), count(DISTINCT cand)) <= 500 THEN 'hungarian' ELSE 'greedy' END AS method
    FROM ranked WHERE rn <= 5 GROUP BY block"""
)
def group_sizes_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = near_names.best(*_sides(spark, sf_dir), 5)
    return assignment.sizes(best, best, group="block")


@query("SELECT user_id, bool_or(event_type = 'error') AS any_error, count(*) FILTER (event_type = 'click') AS n_clicks, max(value) AS best FROM events GROUP BY user_id")
def any_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("any_error"), F.count_if(F.col("event_type") == "click").alias("n_clicks"), F.max("value").alias("best"))


@query("SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY o_orderstatus")
def count_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("n_customers"))


@query("SELECT s_suppkey, greatest(s_acctbal, 0, s_nationkey) AS best FROM supplier")
def rowwise_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.greatest("s_acctbal", F.lit(0.0), F.col("s_nationkey").cast("double")).alias("best"))


@query("""SELECT 'names=' || '[' || string_agg('"' || n_name || '"', ',' ORDER BY n_nationkey) || ']' AS value FROM nation""")
def array_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.array_literal(table(spark, sf_dir, "nation"), "names", "n_name", "n_nationkey")


@query(
    """WITH RECURSIVE pairs AS (SELECT n_nationkey AS id, p_name AS name, lower(n_name) AS a FROM nation, (SELECT DISTINCT p_name FROM part)),
        lcs AS (
            SELECT id, name, a, 0 AS i, [0 FOR z IN range(0, length(name))] AS prev FROM pairs
            UNION ALL
            SELECT id, name, a, i + 1, [list_max([greatest(prev[k], CASE WHEN substr(a, i + 1, 1) = substr(name, k, 1) THEN 1 + CASE WHEN k > 1 THEN prev[k - 1] ELSE 0 END ELSE 0 END)
                FOR k IN range(1, j + 1)]) FOR j IN range(1, length(name) + 1)]
            FROM lcs WHERE i < length(a))
    SELECT id, name, round(200.0 * prev[length(name)] / (length(a) + length(name)), 6)::DOUBLE AS score FROM lcs WHERE i = length(a)"""
)
def indel_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    keys = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("a"))
    # a list of some dozens of nations against some dozens of names
    pairs = keys.join(names, F.lit(True))
    return pairs.select("id", "name", F.round(similarity.similarity("indel_ratio", F.col("a"), F.col("name")), 6).alias("score"))


@query(
    """WITH pairs AS (SELECT a.p_name AS x, b.p_name AS y, string_split(a.p_name, ' ') AS p, string_split(b.p_name, ' ') AS q
        FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON list_has_any(string_split(a.p_name, ' '), string_split(b.p_name, ' ')))
    SELECT x, y, len(list_intersect(p, q)) = len(list_distinct(p)) AS inside FROM pairs WHERE len(list_intersect(p, q)) = len(list_distinct(p))"""
)
def token_set_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names that share a word and score 100: one side's words lie within the other's."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("x")).distinct()
    left = names.select("x", F.explode(text.words(F.col("x"))).alias("w"))
    pairs = left.join(left.select(F.col("x").alias("y"), "w"), "w").select("x", "y").distinct()
    full = pairs.where(similarity.similarity("token_set_ratio", F.col("x"), F.col("y")) == 100)
    return full.select("x", "y", F.lit(True).alias("inside"))


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("eng_id"), F.col("eng_id").alias("eng_ord"), F.col("block").cast("string").alias("group"), "cand", F.col("cand_id").alias("cand_ord"), "score")


@query(
    f"""WITH RECURSIVE {RANKED},
        edges AS (SELECT *, block || ':' || cand AS name, row_number() OVER (ORDER BY score DESC, eng_id, cand_id) AS i FROM ranked WHERE rn <= 5 AND score >= 60),
        run AS (
            SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS rows, CAST([] AS VARCHAR[]) AS names, false AS ok
            UNION ALL
            SELECT i, CASE WHEN free THEN list_append(rows, eng_id) ELSE rows END, CASE WHEN free THEN list_append(names, name) ELSE names END, free FROM (
                SELECT e.i, rows, names, eng_id, name, NOT list_contains(rows, eng_id) AND NOT list_contains(names, name) AS free FROM run r JOIN edges e ON e.i = r.i + 1))
    SELECT eng_id, eng_id AS eng_ord, CAST(block AS VARCHAR) AS "group", cand, cand_id AS cand_ord, score FROM edges JOIN run USING (i) WHERE ok"""
)
def greedy_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignment.greedy(_edges(near_names.best(*_sides(spark, sf_dir), 5)), 60.0)


@query()
def optimal_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignment.assign(_edges(near_names.best(*_sides(spark, sf_dir), 5)), 60.0)


@query(
    f"""WITH RECURSIVE {SCORED},
        wishes AS (SELECT eng_id, block, row_number() OVER (ORDER BY eng_id) AS i, list({{'cand': cand, 'cand_ord': cand_id, 'score': score}} ORDER BY score DESC, cand_id) AS l
            FROM scored WHERE score >= 60 GROUP BY eng_id, block),
        run AS (
            SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS taken, l[1] AS x FROM wishes WHERE i = 1
            UNION ALL
            SELECT i, CASE WHEN x IS NULL THEN taken ELSE list_append(taken, x.cand) END, x FROM (
                SELECT w.i, taken, [e FOR e IN l IF NOT list_contains(taken, e.cand)][1] AS x FROM run r JOIN wishes w ON w.i = r.i + 1))
    SELECT eng_id, eng_id AS eng_ord, CAST(block AS VARCHAR) AS "group", x.cand AS cand, x.cand_ord AS cand_ord, x.score AS score FROM wishes JOIN run USING (i) WHERE i > 0 AND x IS NOT NULL"""
)
def sequential_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignment.in_order(_edges(near_names.within(*_sides(spark, sf_dir), 60.0)), 60.0)


def _linkage(spark: SparkSession, sf_dir: str, options: linkage.Options) -> linkage.Result:
    """Suppliers as one side, customers as the other, nations as districts."""
    english = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("district"), F.lit(None).cast("string").alias("counterpart"))
    arabic = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("district"), F.lit(None).cast("string").alias("counterpart"))
    districts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("district_en"), F.col("n_nationkey").cast("string").alias("district_ar"))
    return linkage.match(english, arabic, districts, spark.createDataFrame([], "token string, cands array<string>"), options)


@query()
def linkage_optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linkage(spark, sf_dir, linkage.Options(threshold=50.0)).results


@query()
def linkage_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linkage(spark, sf_dir, linkage.sequential()).review


@query("SELECT p_partkey, contains(p_name, 'el') AS has_el, p_name LIKE 'r%' AS from_r FROM part")
def substring_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").contains("el").alias("has_el"), F.col("p_name").startswith("r").alias("from_r"))


@query("SELECT s.s_suppkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, count(*) AS n FROM supplier s JOIN orders o ON o.o_custkey = s.s_suppkey GROUP BY s.s_suppkey")
def exact_join_lastwins(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("s_suppkey"))
    return joined.groupBy("s_suppkey").agg(F.max_by("o_orderkey", "o_orderkey").alias("o_orderkey"), F.count(F.lit(1)).alias("n"))


@query(
    """WITH m AS (SELECT DISTINCT n_nationkey AS a, n_regionkey AS b FROM nation WHERE n_regionkey <> 2)
    SELECT s_suppkey, b AS region, s_nationkey AS a FROM supplier JOIN m ON m.a = s_nationkey
    UNION ALL SELECT s_suppkey, NULL, s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT a FROM m)"""
)
def translate_and_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), F.when(F.col("n_regionkey") != 2, F.col("n_regionkey")).alias("region"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("a"))
    mapped, unmapped = relational.translate_keys(rows, mapping, "a", "region")
    return mapped.select("s_suppkey", "region", "a").unionByName(unmapped.select("s_suppkey", F.lit(None).cast("int").alias("region"), "a"))


@query(
    f"""WITH {_OPTIONS}, flat AS (SELECT p_partkey, unnest(p) AS via, unnest(range(0, len(p))) AS pos FROM phrases),
        scored AS (SELECT p_partkey, via, pos, CAST(levenshtein(via, 'bleu bague') AS DOUBLE) AS distance FROM flat)
    SELECT p_partkey, via, distance FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY distance, pos) AS rn FROM scored) WHERE rn = 1"""
)
def best_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _phrases(spark, sf_dir, None).select("p_partkey", F.posexplode("phrases").alias("pos", "via"))
    distance = similarity.edit_distance(F.col("via"), F.lit("bleu bague"))
    best = flat.groupBy("p_partkey").agg(F.min_by(F.struct("via", distance.alias("distance")), F.struct(distance, "pos")).alias("x"))
    return best.select("p_partkey", "x.via", "x.distance")


@query("SELECT * FROM (VALUES (0, 'albyr@'), (1, ' al-hy'), (2, 'wady khald'), (3, 'hy alwady'), (4, 'mnar@-albhr'), (5, 'byt mry'), (6, 'al'), (7, 'alhy alqdym')) AS t(id, latin)")
def latin_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literals(spark, ARABIC_NAMES).select("id", translit.latin_column(F.col("name")).alias("latin"))


GLUED = ["el kantara", "kfar el din", "al ain", "beirut", "elmal"]


@query("SELECT * FROM (VALUES (0, 'elkantara', 'elkantara|elelkantara|kantara'), (1, 'kfar eldin', 'kfar eldin'), (2, 'alain', 'alain|elalain|ain'), (3, 'beirut', 'beirut|elbeirut'), (4, 'elmal', 'elmal|elelmal|mal|elm')) AS t(id, glued, variants)")
def article_gluing(spark: SparkSession, sf_dir: str) -> DataFrame:
    glued = text.glue_article(F.col("name"))
    return _literals(spark, GLUED).select("id", glued.alias("glued"), F.array_join(text.article_variants(glued), "|").alias("variants"))


@query("""SELECT event_id, CAST(json_extract(json_extract_string(to_json({'data': props}), '$.data'), '$.k') AS BIGINT) AS k FROM events""")
def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("props").alias("data"))).alias("body"))
    return packed.select("event_id", F.from_json(F.get_json_object("body", "$.data"), "k bigint")["k"].alias("k"))


@query("SELECT id, CAST(score AS DOUBLE) AS score FROM (VALUES (0, 100), (1, 80), (2, 80), (3, 0)) AS t(id, score)")
def partial_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame([(0, "abc", "xxabcxx"), (1, "abcde", "xabxdex"), (2, "abc", "bcd"), (3, "", "x")], "id int, a string, b string")
    return pairs.select("id", F.round(similarity.similarity("partial_ratio", F.col("a"), F.col("b")), 6).alias("score"))


def _nations_and_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation (a) with every distinct part name (b). The nations are a list of fixed size, so the product grows with the names only."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("b")).distinct()
    nations = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("a"))
    return names.join(nations, F.lit(True))


@query()
def partial_ratio_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations_and_parts(spark, sf_dir).select("a", "b", F.round(similarity.similarity("partial_ratio", F.col("a"), F.col("b")), 6).alias("score"))


@query()
def token_set_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct()
    # part names come from a word list of fixed size
    pairs = names.join(names.select(F.col("a").alias("b")), F.lit(True))
    return pairs.select("a", "b", F.round(similarity.similarity("token_set_ratio", F.col("a"), F.col("b")), 6).alias("score"))


@query()
def latin_fallback_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matchers' score where no word is in the cache, without and with the score of single words."""
    pairs = _nations_and_parts(spark, sf_dir).withColumn("bare", text.drop_latin_article(F.col("a"))).withColumn("none", F.array().cast("array<string>"))
    score = {name: similarity.scored(F.col("a"), F.col("bare"), F.col("none"), F.col("b"), F.lit(by_word)) for name, by_word in (("whole", False), ("by_word", True))}
    return pairs.select("a", "bare", "b", *(F.round(kernel["score"], 6).alias(name) for name, kernel in score.items()))


@query("SELECT id, best, CAST(100 AS DOUBLE) AS score FROM (VALUES (0, 'بيت مري'), (1, 'البيرة'), (2, 'وادي خالد')) AS t(id, best)")
def script_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases against names in Arabic script, with and without article and locality words."""
    phrases_of = spark.createDataFrame([(0, "بيت مري"), (1, "بيرة"), (2, "خالد")], "id int, phrase string")
    names = _literals(spark, ARABIC_NAMES).select(F.col("id").alias("ord"), F.trim("name").alias("best"))
    scored = phrases_of.join(names, F.lit(True)).withColumn("score", similarity.similarity("script_score", F.col("best"), F.col("phrase")))
    return relational.top_k(scored, "id", "score", "ord", 1).select("id", "best", "score")


def _towns(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "row_id long, name string, district string, counterpart string")


@query("SELECT * FROM (VALUES ('ar', 0, 'A'), ('ar', 1, 'kept'), ('ar', 2, NULL), ('en', 0, 'ا'), ('en', 1, NULL), ('en', 2, NULL)) AS t(side, row_id, counterpart)")
def town_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    arabic = _towns(spark, [(0, "ا", "d", None), (1, "ب", "d", "kept"), (2, "ج", "d", None)])
    english = _towns(spark, [(0, "A", "d", None), (1, "B", "d", None), (2, "C", "d", None)])
    towns = [spark.createDataFrame(list(enumerate(names)), "row_id long, town string") for names in (["ا", "ب"], ["A", "B"])]
    new_arabic, new_english = lookups.bridge(arabic, english, *towns)
    return new_arabic.select(F.lit("ar").alias("side"), "row_id", "counterpart").unionByName(new_english.select(F.lit("en").alias("side"), "row_id", "counterpart"))


@query("SELECT * FROM (VALUES (0, 'Bsharri', true), (1, 'x', false), (2, NULL, false), (3, 'Sour', false)) AS t(row_id, counterpart, asked)")
def geocode_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    english = _towns(spark, [(0, "Bcharre", "d", None), (1, "Done", "d", "x"), (2, "Nowhere", "d", None), (3, "Tyre", "d", None)])
    cache = spark.createDataFrame([("Tyre", "Sour")], "key string, value string")
    filled, _ = lookups.geocode(english, cache, providers.from_mapping({"Bcharre": [PLACES[0]], "Nowhere": ["[]"]}))
    return filled.select("row_id", "counterpart", (F.col("openMapsData") != "").alias("asked"))


@query("SELECT * FROM (VALUES (0, 'الكفر'), (1, 'بيت مري'), (3, 'الميناء')) AS t(row_id, match)")
def dictionary_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(0, "El Kfar"), (1, "Beit-Mery"), (2, "None"), (3, "Mina")], "row_id long, name string")
    master = spark.createDataFrame([("الكفر",), ("بيت مري",), ("الميناء",)], "name string")
    answers = spark.createDataFrame([("elkfar", ["x", "الكفر"]), ("beit", ["بيت"]), ("mery", ["ميري", "مري"]), ("elmina", ["الميناء"])], "token string, cands array<string>")
    return lookups.dictionary_lookup(names, master, answers).select("row_id", "match")


@query("SELECT * FROM (VALUES ('a', 'x'), ('miss', ''), ('b', 'B'), ('bad', '')) AS t(token, cands)")
def provider_through_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = spark.createDataFrame([("a", ["x"]), ("miss", [])], "token string, cands array<string>")
    keys = spark.createDataFrame([("a",), ("miss",), ("b",), ("b",), ("bad",)], "token string")
    found = providers.ask_through_cache(keys, cache, "token", providers.from_mapping({"b": ["B"]}), workers=2)
    return found.select("token", F.array_join("cands", ",").alias("cands"))
