"""Queries over the driver's tables for catalogs, matching, the stored index and profiles, each beside its DuckDB SQL.

The shop is made of the whole ``part`` table: every part is a product whose fields follow from its key, name and size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embedding as E
from ..functions.lexicons import ALIASES, plain
from ..operators import analytics as A
from ..operators import hybrid as H
from ..operators import index as I
from ..operators import matching as M
from ..operators import profiles as P
from ..operators import ranking as K
from ..operators.normalize import facets, normalize
from ..storage import scratch_path
from ..streaming import session
from .queries import SQL, WEIGHTS, _bm25, asked, load, query


def _pick(n: int, *texts: str | None) -> Column:
    """One of ``texts`` by the key modulo ``n``; the last for the rest."""
    out = F.lit(texts[-1])
    for i in range(len(texts) - 2, -1, -1):
        out = F.when(F.col("p_partkey") % n == i, texts[i]).otherwise(out)
    return out


def shop(spark: SparkSession, d: str) -> DataFrame:
    """Products as ``read_catalog`` gives them."""
    path = F.when(F.col("p_partkey") % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Shoes"), _pick(4, "Women", "Men", "Winter Boots", "Sneakers")))
    kind = F.when(F.col("p_partkey") % 11 == 0, F.lit(None)).when(F.col("p_partkey") % 4 == 0, "string").otherwise("number")
    price = F.when(F.col("p_partkey") % 11 == 0, F.lit(None)).when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("$"), F.col("p_retailprice").cast("string"))).otherwise(F.col("p_retailprice").cast("string"))
    rows = load(spark, d, "part").select(
        F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("parent_asin"), F.concat("p_name", _pick(5, " cotton", " faux leather", " navy blue", "")).alias("title"),
        F.array(F.col("p_type"), _pick(3, "Water-resistant", "for hiking", "plain")).alias("features"), F.when(F.col("p_partkey") % 7 == 0, F.array(F.lit("Soft wool."))).otherwise(F.array().cast("array<string>")).alias("description"),
        price.alias("price"), path.alias("categories"), F.create_map(F.lit("Color"), F.when(F.col("p_size") % 2 == 0, "Grey").otherwise("Red"), F.lit("Brand"), F.col("p_brand")).alias("details"),
        (F.col("p_size") / 10).alias("average_rating"), (F.col("p_partkey") % 997).cast("long").alias("rating_number"), F.lit(None).cast("string").alias("store"), kind.alias("price_kind"),
    )
    line = F.struct("parent_asin", "title", "features", "description", F.when(F.col("price_kind") == "number", F.col("price").cast("double")).alias("price"), "categories", "details", "average_rating", "rating_number")
    return rows.withColumn("raw", F.to_json(line))


_SHOP = """shop AS (
  SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS parent_asin, p_partkey AS k, p_size AS size, p_brand AS brand, p_retailprice AS price,
    p_name || CASE p_partkey % 5 WHEN 0 THEN ' cotton' WHEN 1 THEN ' faux leather' WHEN 2 THEN ' navy blue' ELSE '' END AS title,
    p_type AS f1, CASE p_partkey % 3 WHEN 0 THEN 'Water-resistant' WHEN 1 THEN 'for hiking' ELSE 'plain' END AS f2,
    CASE WHEN p_partkey % 7 = 0 THEN 'Soft wool.' ELSE '' END AS description,
    CASE WHEN p_partkey % 13 = 0 THEN '' ELSE CASE p_partkey % 4 WHEN 0 THEN 'Women' WHEN 1 THEN 'Men' WHEN 2 THEN 'Winter Boots' ELSE 'Sneakers' END END AS leaf,
    CASE WHEN p_size % 2 = 0 THEN 'gray' ELSE 'red' END AS color, p_partkey % 11 = 0 AS bare, p_partkey % 4 = 0 AS texted
  FROM part)"""


def _known(field: str, text: str) -> str:
    """SQL of the distinct canonical values named in a text."""
    names = {plain(a): c for a, c in ALIASES[field].items()}
    pattern = r"\b(?:" + "|".join(r"[\s_-]+".join(p.split()) for p in sorted(names, key=lambda p: (-len(p), p))).replace("'", "''") + r")\b"
    pairs = ", ".join(f"'{k.replace(chr(39), chr(39) * 2)}': '{v}'" for k, v in names.items())
    return f"list_distinct(list_transform(regexp_extract_all(lower({text}), '{pattern}'), lambda x: map_extract(MAP {{{pairs}}}, regexp_replace(x, '[\\s_-]+', ' ', 'g'))[1]))"


def _phrase(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(replace(lower({text}), '_', ' '), '-', ' '), '[^a-z0-9&+'' ]', ' ', 'g'), ' +', ' ', 'g'))"


_EVIDENCE = f"""ev AS (
  SELECT parent_asin, 'color' AS field, color AS value, 'details:Color' AS source, 0.95::DOUBLE AS confidence FROM shop
  UNION ALL SELECT parent_asin, 'brand', {_phrase("brand")}, 'details:Brand', 0.95 FROM shop
  UNION ALL SELECT parent_asin, f, unnest(v), 'features', 0.75 FROM (SELECT parent_asin, 'color' AS f, {_known("color", "f1 || ' / ' || f2")} AS v FROM shop UNION ALL SELECT parent_asin, 'material', {_known("material", "f1 || ' / ' || f2")} FROM shop)
  UNION ALL SELECT parent_asin, f, unnest(v), 'title', 0.65 FROM (SELECT parent_asin, 'color' AS f, {_known("color", "title")} AS v FROM shop UNION ALL SELECT parent_asin, 'material', {_known("material", "title")} FROM shop)
  UNION ALL SELECT parent_asin, f, unnest(v), 'description', 0.5 FROM (SELECT parent_asin, 'color' AS f, {_known("color", "description")} AS v FROM shop UNION ALL SELECT parent_asin, 'material', {_known("material", "description")} FROM shop)
), best AS (
  SELECT parent_asin, field, value, arg_max(source, confidence) AS source, max(confidence) AS confidence FROM ev GROUP BY ALL
), named AS (
  SELECT parent_asin, field, string_agg(value || '/' || source || '/' || confidence, ';' ORDER BY confidence DESC, value) AS listed FROM best GROUP BY ALL
), tags AS (
  SELECT parent_asin, unnest(list_distinct(list_concat([{_phrase("f1")}, {_phrase("f2")}], list_concat({_known("feature", "f1 || ' / ' || f2 || ' / ' || title || ' / ' || description")}, {_known("use_case", "f1 || ' / ' || f2 || ' / ' || title || ' / ' || description")})))) AS tag FROM shop
), prod AS (
  SELECT shop.*, coalesce((SELECT listed FROM named n WHERE n.parent_asin = shop.parent_asin AND field = 'color'), '') AS colors, coalesce((SELECT listed FROM named n WHERE n.parent_asin = shop.parent_asin AND field = 'material'), '') AS materials,
    replace({_phrase("brand")}, '', '') AS brand_name, t.features,
    CASE WHEN leaf = '' THEN '' ELSE CASE leaf WHEN 'Winter Boots' THEN 'winter_boots' ELSE lower(leaf) END END AS leaf_name
  FROM shop JOIN (SELECT parent_asin, string_agg(tag, ';' ORDER BY tag) AS features FROM tags WHERE tag <> '' GROUP BY 1) t USING (parent_asin)
)"""


def _listed(column: str) -> Column:
    return F.array_join(F.transform(column, lambda v: F.concat_ws("/", v["value"], v["source"], v["confidence"].cast("string"))), ";")


@query(f"""WITH {_SHOP}, {_EVIDENCE}
SELECT parent_asin, leaf_name AS leaf, colors, materials, brand_name || '/details:Brand/0.95' AS brands, features, CASE WHEN NOT bare THEN price END AS price,
  CASE WHEN bare THEN NULL WHEN texted THEN 0.9::DOUBLE ELSE 0.95::DOUBLE END AS price_confidence, round(least(size / 10, 5), 4) AS average_rating FROM prod""")
def catalog_normalized(spark: SparkSession, d: str) -> DataFrame:
    n = normalize(shop(spark, d))
    leaf = F.coalesce(F.get(F.transform(F.filter("leaf_categories", lambda v: v["source"] == "categories:leaf"), lambda v: v["value"]), F.lit(0)), F.lit(""))
    return n.select("parent_asin", leaf.alias("leaf"), *(_listed(c).alias(c) for c in ("colors", "materials", "brands")), F.array_join("features", ";").alias("features"), F.col("price.value").alias("price"), F.col("price.confidence").alias("price_confidence"), F.round("average_rating", 4).alias("average_rating"))


def _terms(**fields: list[str]) -> Column:
    kind = "array<struct<field:string,values:array<string>>>"
    return F.array(*(F.struct(F.lit(f).alias("field"), F.array(*map(F.lit, v)).alias("values")) for f, v in fields.items())).cast(kind)


HARD, SOFT, OUT = {"color": ["gray", "navy"], "price_max": ["950"], "category": ["winter_boots"]}, {"feature": ["water_resistant"], "material": ["cotton", "wool"]}, {"material": ["faux_leather"], "color": ["red"]}
# the confidence of a value in a "value/source/confidence" list, null where it is not there
_SURE = "nullif(regexp_extract({}, '(?:^|;){}/[^/]+/([0-9.]+)', 1), '')::DOUBLE"
_STATES = f"""st AS (
  SELECT *, greatest({_SURE.format("colors", "gray")}, {_SURE.format("colors", "navy")}) AS wanted_color, {_SURE.format("colors", "red")} AS red, {_SURE.format("materials", "faux_leather")} AS faux,
    greatest({_SURE.format("materials", "cotton")}, {_SURE.format("materials", "wool")}) AS wanted_material, nullif(regexp_extract(materials, '^[^/]+/[^/]+/([0-9.]+)', 1), '')::DOUBLE AS any_material,
    CASE WHEN texted THEN 0.9 ELSE 0.95 END::DOUBLE AS price_sure, k % 13 = 0 AS pathless
  FROM prod
), ms AS (
  SELECT *, CASE WHEN wanted_color IS NOT NULL THEN 'match' ELSE 'mismatch' END AS color_state,
    CASE WHEN bare THEN 'unknown' WHEN price <= 950 THEN 'match' ELSE 'mismatch' END AS price_state,
    CASE WHEN pathless THEN 'unknown' WHEN leaf_name = 'winter_boots' THEN 'match' WHEN leaf_name = 'sneakers' THEN 'unknown' ELSE 'unknown' END AS category_state,
    CASE WHEN regexp_matches(features, 'water.resistant') THEN 'match' ELSE 'unknown' END AS feature_state,
    CASE WHEN any_material IS NULL THEN 'unknown' WHEN wanted_material IS NOT NULL THEN 'match' WHEN any_material < 0.85 THEN 'unknown' ELSE 'mismatch' END AS material_state,
    CASE WHEN any_material IS NULL THEN 'unknown' WHEN faux >= 0.85 THEN 'mismatch' WHEN faux IS NOT NULL THEN 'unknown' WHEN any_material < 0.85 THEN 'unknown' ELSE 'match' END AS no_faux_state,
    CASE WHEN red >= 0.85 THEN 'mismatch' WHEN red IS NOT NULL THEN 'unknown' ELSE 'match' END AS no_red_state
  FROM st
)"""


@query(f"""WITH {_SHOP}, {_EVIDENCE}, {_STATES}
SELECT parent_asin, concat_ws(';', color_state, price_state, category_state) AS hard, concat_ws(';', feature_state, material_state) AS soft, concat_ws(';', no_faux_state, no_red_state) AS excluded,
  color_state = 'mismatch' OR price_state = 'mismatch' OR no_red_state = 'mismatch' AS filtered FROM ms""")
def constraint_evaluation(spark: SparkSession, d: str) -> DataFrame:
    n = normalize(shop(spark, d))
    rows = n.select("parent_asin", M.evaluate(_terms(**HARD)).alias("h"), M.evaluate(_terms(**SOFT)).alias("s"), M.evaluate(_terms(**OUT), True).alias("x"))
    listed = lambda c: F.array_join(M.states(F.col(c)), ";")
    return rows.select("parent_asin", listed("h").alias("hard"), listed("s").alias("soft"), listed("x").alias("excluded"), M.decisive(F.col("h"), F.col("x")).alias("filtered"))


def _pool(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select((F.col("p_size") % 10).cast("string").alias("qid"), F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("id"), (1 / (60 + F.col("p_partkey") % 211)).alias("rrf"))


def _requests(spark: SparkSession) -> DataFrame:
    hard = {k: v for k, v in HARD.items() if k == "color"}
    return spark.range(10).select(
        F.col("id").cast("string").alias("qid"), F.lit("winter_boots").alias("category"), _terms(**hard).alias("hard"), _terms(**SOFT).alias("soft"), _terms(material=["faux_leather"]).alias("excluded"),
        F.lit("gray cotton boots for the winter").alias("structured_query"), F.lit("boots").alias("current_message"), F.array(F.lit("soft wool"), F.lit("hiking boots")).alias("tags"),
    )


@query(f"""WITH {_SHOP}, {_EVIDENCE}, {_STATES}, docs AS (
  SELECT *, trim(regexp_replace(replace(concat_ws(' ', CASE WHEN pathless THEN '' ELSE 'shoes ' || CASE leaf_name WHEN 'winter_boots' THEN 'winter boots' ELSE leaf_name END END, replace(leaf_name, '_', ' '),
    CASE WHEN leaf IN ('Women', 'Men') THEN leaf_name ELSE '' END, replace(regexp_replace(materials, '/[^;]*', '', 'g'), ';', ' '), replace(regexp_replace(colors, '/[^;]*', '', 'g'), ';', ' '), brand_name, replace(features, ';', ' ')), '_', ' '), ' +', ' ', 'g')) AS doc
  FROM ms
), words AS (
  SELECT *, list_distinct(list_filter(regexp_extract_all(doc, '[a-z0-9]+'), lambda x: length(x) > 1)) AS w, ' ' || doc || ' ' AS spaced FROM docs
), feats AS (
  SELECT parent_asin, CAST(size % 10 AS VARCHAR) AS qid, 1.0::DOUBLE / (60 + k % 211) AS raw, k % 997 AS n,
    (color_state = 'mismatch') OR (no_faux_state = 'mismatch') AS filtered,
    (CAST(contains(spaced, ' winter boots ') AS INT) + CAST(contains(spaced, ' gray ') AS INT) + CAST(contains(spaced, ' navy ') AS INT) + CAST(contains(spaced, ' water resistant ') AS INT) + CAST(contains(spaced, ' cotton ') AS INT) + CAST(contains(spaced, ' wool ') AS INT)) / 6.0::DOUBLE AS exact_phrase,
    len(list_intersect(w, ['gray', 'cotton', 'boots', 'winter'])) / 4.0::DOUBLE AS feature_overlap,
    CASE WHEN leaf_name = 'winter_boots' THEN 1.0 ELSE 0.0 END::DOUBLE AS category_match,
    CASE WHEN category_state = 'match' AND color_state = 'match' THEN 1.0 WHEN category_state = 'match' OR color_state = 'match' THEN CASE WHEN category_state = 'unknown' THEN 1.0 ELSE 0.5 END ELSE 0.0 END::DOUBLE AS hard_match,
    CASE WHEN feature_state = 'match' OR material_state = 'match' THEN CASE WHEN material_state = 'mismatch' THEN 0.5 ELSE 1.0 END ELSE 0.0 END::DOUBLE AS soft_match,
    len(list_intersect(w, ['soft', 'wool', 'hiking', 'boots'])) / 4.0::DOUBLE AS profile,
    greatest(CASE WHEN color_state = 'mismatch' THEN 0.95 ELSE 0 END, CASE WHEN no_faux_state = 'mismatch' THEN faux ELSE 0 END, CASE WHEN material_state = 'mismatch' THEN any_material / 2 ELSE 0 END)::DOUBLE AS penalty
  FROM words
), scaled AS (
  SELECT *, raw / max(raw) OVER (PARTITION BY qid) AS rrf, ln(1 + n) / max(CASE WHEN NOT filtered THEN ln(1 + n) END) OVER (PARTITION BY qid) AS popularity FROM feats
), scored AS (
  SELECT *, round(rrf + 0.35 * exact_phrase + 0.25 * feature_overlap + 0.25 * category_match + 0.25 * hard_match + 0.15 * soft_match + 0.03 * popularity + 0.03 * profile - 0.8 * penalty, 6) AS score FROM scaled WHERE NOT filtered
)
SELECT qid, parent_asin AS id, score, round(exact_phrase, 6) AS exact_phrase, round(feature_overlap, 6) AS feature_overlap, hard_match, soft_match, round(profile, 6) AS profile, category_match,
  CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, parent_asin) AS INT) AS rank FROM scored""")
def ranker_features(spark: SparkSession, d: str) -> DataFrame:
    rows = K.explain(_requests(spark), _pool(spark, d), normalize(shop(spark, d))).filter("not filtered")
    rows = rows.withColumn("score", F.round("score", 6)).drop("rank")
    ranked = K.top(rows, 1 << 30)
    return ranked.select("qid", "id", "score", *(F.round(c, 6).alias(c) for c in ("exact_phrase", "feature_overlap", "hard_match", "soft_match", "profile", "category_match")), "rank")


_INDEXED = _bm25("true").replace("regexp_extract_all(lower(text), '[a-z0-9]+')", r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{M}\p{N}]+')")


@query(f"WITH {_INDEXED}, r AS (SELECT qid, id, round(score, 6) AS score, score AS raw FROM scored) SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY raw DESC, id) AS INT) AS rank FROM r QUALIFY rank <= 10")
def bm25_stored_index(spark: SparkSession, d: str) -> DataFrame:
    """Built, stored and searched: words as they are, without accents."""
    path = scratch_path(spark, "index")
    I.build(load(spark, d, "documents"), path, list(WEIGHTS), "doc_id", stem=False)
    return I.Index(spark, path).search(asked(spark), 10, WEIGHTS).withColumn("score", F.round("score", 6))


@query()
def bm25_stems(spark: SparkSession, d: str) -> DataFrame:
    """The same by Porter stems, over the shop."""
    path = scratch_path(spark, "index")
    I.build(shop(spark, d), path)
    said = spark.createDataFrame([(1, "hikes in water-resistant boots"), (2, "navy blue cottons")], "qid int, query string")
    return I.Index(spark, path).search(said, 20).withColumn("score", F.round("score", 6))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS qid, place, route, query, weight FROM customer, LATERAL (
  SELECT * FROM (VALUES (0, 'active_context_bm25', 'see ' || c_name, CASE WHEN c_nationkey % 2 = 0 THEN 1.4 ELSE 1.1 END::DOUBLE), (1, 'current_turn_bm25', c_mktsegment, CASE WHEN c_nationkey % 2 = 0 THEN 0.85 ELSE 0.55 END::DOUBLE),
    (2, 'category_anchor_bm25', CASE WHEN c_nationkey % 2 = 0 THEN 'winter boots' ELSE 'winter boots boots' END, CASE WHEN c_nationkey % 2 = 0 THEN 0.25 ELSE 0.35 END::DOUBLE),
    (3, CASE WHEN c_nationkey % 2 = 0 THEN 'structured_constraint_bm25' ELSE 'use_case_bm25' END, CASE WHEN c_nationkey % 2 = 0 THEN 'navy blue ' || lower(c_mktsegment) ELSE lower(c_mktsegment) END, 0.75::DOUBLE)) v(place, route, query, weight))""")
def route_plan(spark: SparkSession, d: str) -> DataFrame:
    term = lambda f, v: F.array(F.struct(F.lit(f).alias("field"), F.array(v).alias("values")))
    rows = load(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("qid"), F.when(F.col("c_nationkey") % 2 == 0, "buying").otherwise("browsing").alias("route"), F.concat(F.lit(" see "), "c_name").alias("raw_context"), F.lit("").alias("structured_query"),
        F.col("c_mktsegment").alias("current_message"), F.lit("winter_boots").alias("category"), F.lit("boots").alias("base_request"), term("color", F.lit("navy_blue")).alias("hard"), term("use_case", F.lower("c_mktsegment")).alias("soft"),
    )
    return H.plan(rows)


@query("""WITH p AS (SELECT CAST(l_orderkey AS VARCHAR) AS qid, CAST(l_partkey AS VARCHAR) AS id, l_linenumber % 3 AS place, min(CAST(l_quantity AS INT)) AS rank FROM lineitem GROUP BY ALL),
s AS (SELECT *, CASE place WHEN 0 THEN 1.4 WHEN 1 THEN 0.85 ELSE 0.25 END::DOUBLE AS weight FROM p)
SELECT qid, id, string_agg(place || ':' || rank, ',' ORDER BY place) AS evidence, round(sum(weight / (60 + rank)), 9) AS rrf FROM s GROUP BY qid, id""")
def route_evidence(spark: SparkSession, d: str) -> DataFrame:
    hits = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("qid"), F.col("l_partkey").cast("string").alias("id"), (F.col("l_linenumber") % 3).alias("place")).agg(F.min(F.col("l_quantity").cast("int")).alias("rank"))
    weight = F.when(F.col("place") == 0, 1.4).when(F.col("place") == 1, 0.85).otherwise(0.25)
    fused = H.fuse(hits.withColumns({"route": F.concat(F.lit("r"), "place"), "score": F.lit(0.0), "weight": weight}))
    return fused.select("qid", "id", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["place"], e["rank"])), ",").alias("evidence"), F.round("rrf", 9).alias("rrf"))


@query("""SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS id, CASE WHEN hard OR out THEN 'buying' WHEN strong THEN 'buying' WHEN exploring THEN 'browsing' WHEN cat THEN 'browsing' ELSE 'browsing' END AS route,
  CASE WHEN hard OR out THEN 0.9 WHEN strong THEN 0.78 WHEN exploring THEN 0.88 WHEN cat THEN 0.72 ELSE 0.6 END::DOUBLE AS confidence,
  concat_ws(',', CASE WHEN hard THEN 'has_hard_constraint' END, CASE WHEN hard THEN 'has_budget' END, CASE WHEN out THEN 'has_exclusion' END, CASE WHEN strong THEN 'strong_buying_language' END, CASE WHEN exploring THEN 'browsing_language' END, CASE WHEN weak THEN 'weak_buying_language' END, CASE WHEN cat THEN 'has_category' END) AS signals
FROM (SELECT conv_id, turn, conv_id % 5 = 0 AS hard, turn % 4 = 3 AS out, conv_id % 2 = 0 AS cat, regexp_matches(s, '\\b(must|only|under|below|no more than|at most|exactly)\\b') AS strong,
  regexp_matches(s, '\\b(still exploring|ideas?|not sure|open to|something for|just browsing)\\b') AS exploring, regexp_matches(s, '\\b(looking for|need|want)\\b') AS weak
  FROM (SELECT *, lower(coalesce(text, '') || CASE turn % 3 WHEN 0 THEN ' only' WHEN 1 THEN ' not sure' ELSE ' I need it' END) AS s FROM conversations))""".replace("\\\\b", "\\b"))
def route_signals(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 0, " only").when(F.col("turn") % 3 == 1, " not sure").otherwise(" I need it"))
    none = _terms()
    hard, out = F.when(F.col("conv_id") % 5 == 0, _terms(price_max=["5"])).otherwise(none), F.when(F.col("turn") % 4 == 3, _terms(color=["red"])).otherwise(none)
    made = A.decision(said, hard, out, F.when(F.col("conv_id") % 2 == 0, "boots"), F.lit(False), ascii=True)
    return load(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), made.alias("m")).select("id", "m.route", "m.confidence", F.array_join("m.signals", ",").alias("signals"))


def _count(field: str, kind: str, when: str = "true") -> str:
    return f"SELECT '{field}' AS field, '{kind}' AS type, count(*) AS n FROM part WHERE {when}"


@query("SELECT * FROM (" + " UNION ALL ".join([_count(f, k) for f, k in (("parent_asin", "string"), ("title", "string"), ("features", "array"), ("description", "array"), ("categories", "array"), ("details", "object"), ("rating_number", "integer"), ("store", "null"))]
       + [_count("average_rating", "number"), _count("price", "null", "p_partkey % 11 = 0 OR p_partkey % 4 = 0"), _count("price", "number", "p_partkey % 11 <> 0 AND p_partkey % 4 <> 0")]) + ") WHERE n > 0")
def json_types(spark: SparkSession, d: str) -> DataFrame:
    return P.types(shop(spark, d))


@query("WITH n AS (SELECT CAST(user_id AS VARCHAR) AS k, count(*) AS n FROM events GROUP BY 1) SELECT count(*) AS unique_count, count(*) FILTER (n > 1 AND coalesce(k, '') <> '') AS duplicate_key_count, CAST(coalesce(sum(n - 1) FILTER (n > 1 AND coalesce(k, '') <> ''), 0) AS BIGINT) AS duplicate_row_count, CAST(coalesce(sum(n) FILTER (NOT regexp_matches(coalesce(k, ''), '^[0-9]{2}$')), 0) AS BIGINT) AS invalid_format_count FROM n")
def key_profile(spark: SparkSession, d: str) -> DataFrame:
    return P.keys(load(spark, d, "events"), "user_id", "^[0-9]{2}$")


@query("WITH t AS (SELECT array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ' ') AS t, count(*) AS n FROM part GROUP BY 1) SELECT count(*) FILTER (t <> '') AS distinct_titles, CAST(coalesce(sum(n) FILTER (t <> '' AND n > 1), 0) AS BIGINT) AS repeated_rows, coalesce(sum(n) FILTER (t <> '' AND n > 1), 0) / sum(n) AS repeated_rate FROM t")
def title_profile(spark: SparkSession, d: str) -> DataFrame:
    return P.titles(load(spark, d, "part"), F.col("p_name"))


@query("SELECT count(*) FILTER (NOT b AND NOT t) AS numeric_count, count(*) FILTER (NOT b AND NOT t) / count(*) AS numeric_coverage_rate, count(*) FILTER (NOT b AND t) AS string_count, 0::BIGINT AS parseable_string_count, count(*) FILTER (NOT b AND t) AS invalid_string_count, count(*) FILTER (NOT b AND NOT t AND p <= 0) AS non_positive_count, count(*) FILTER (NOT b AND NOT t AND p > 1000) AS above_1000_count FROM (SELECT p_partkey % 11 = 0 AS b, p_partkey % 4 = 0 AS t, p_retailprice AS p FROM part)")
def price_profile(spark: SparkSession, d: str) -> DataFrame:
    return P.prices(shop(spark, d), F.col("price"), F.coalesce(F.col("price_kind") == "string", F.lit(False)))


@query("SELECT count(*) FILTER (NOT coalesce(value / 50 BETWEEN 0 AND 5, false)) AS invalid_average_rating_count, count(*) FILTER (NOT coalesce(user_id - 3 >= 0, false)) AS invalid_rating_number_count, count(*) FILTER (user_id - 3 = 0) AS zero_rating_number_count FROM events")
def rating_profile(spark: SparkSession, d: str) -> DataFrame:
    return P.ratings(load(spark, d, "events"), F.col("value") / 50, F.col("user_id") - 3)


@query("WITH c AS (SELECT 'Shoes' AS v, 'all' AS level, k FROM (SELECT p_partkey AS k FROM part WHERE p_partkey % 13 <> 0) UNION ALL SELECT CASE p_partkey % 4 WHEN 0 THEN 'Women' WHEN 1 THEN 'Men' WHEN 2 THEN 'Winter Boots' ELSE 'Sneakers' END, unnest(['all', 'leaf']), p_partkey FROM part WHERE p_partkey % 13 <> 0) SELECT v AS value, count(*) AS n, level FROM c GROUP BY v, level")
def category_profile(spark: SparkSession, d: str) -> DataFrame:
    return P.categories(shop(spark, d), F.col("categories"))[0]


@query("SELECT 5::BIGINT AS distinct_categories, 4::BIGINT AS distinct_leaves, 2 AS least_depth, 2.0::DOUBLE AS mean_depth, 2 AS most_depth")
def category_depth(spark: SparkSession, d: str) -> DataFrame:
    return P.categories(shop(spark, d), F.col("categories"))[1]


@query("SELECT unnest(['Color', 'Brand']) AS value, count(*) AS n FROM part GROUP BY 1")
def detail_key_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.detail_keys(shop(spark, d), F.col("details"))


@query("SELECT field, CAST(populated AS BIGINT) AS populated, populated / n AS rate FROM (SELECT count(*) AS n, count(*) FILTER (coalesce(text, '') <> '') AS text, count(*) FILTER (coalesce(source, '') <> '') AS source, count(*) FILTER (lang IS NOT NULL) AS lang, count(*) FILTER (coalesce(text, '') <> '' OR coalesce(source, '') <> '' OR lang IS NOT NULL) AS \"any\" FROM (SELECT doc_id, text, source, nullif(lang, '') AS lang FROM documents)) UNPIVOT (populated FOR field IN (text, source, lang, \"any\"))")
def search_coverage(spark: SparkSession, d: str) -> DataFrame:
    return P.coverage(load(spark, d, "documents"), ["text", "source", "lang"])


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """A session for each customer, whose target is a part or none."""
    of = F.col("c_custkey")
    scenario = F.when(of % 4 == 0, "buying").when(of % 4 == 1, "browsing").when(of % 4 == 2, "intent_override").otherwise("boundary")
    return load(spark, d, "customer").select(of.cast("string").alias("sample_id"), scenario.alias("scenario_type"), F.lower("c_mktsegment").alias("difficulty_bucket"), F.concat(F.lit("P"), F.lpad((of * 2).cast("string"), 9, "0")).alias("target"))


_SAMPLES = "sam AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'buying' WHEN 1 THEN 'browsing' WHEN 2 THEN 'intent_override' ELSE 'boundary' END AS scenario, lower(c_mktsegment) AS difficulty, c_custkey * 2 AS target FROM customer)"


@query(f"WITH {_SAMPLES} SELECT 'scenario' AS segment, scenario AS value, count(*) AS n FROM sam GROUP BY 2 UNION ALL SELECT 'difficulty', difficulty, count(*) FROM sam GROUP BY 2 UNION ALL SELECT 'both', scenario || '/' || difficulty, count(*) FROM sam GROUP BY 2")
def session_profile(spark: SparkSession, d: str) -> DataFrame:
    return P.sessions(_samples(spark, d), shop(spark, d))[0]


@query(f"WITH {_SAMPLES} SELECT count(*) AS rows, count(DISTINCT target) AS distinct_targets, count(*) FILTER (p_partkey IS NULL) AS missing_targets FROM sam LEFT JOIN part ON target = p_partkey")
def session_targets(spark: SparkSession, d: str) -> DataFrame:
    return P.sessions(_samples(spark, d), shop(spark, d))[1]


_FLAGS = "flags AS (SELECT p_partkey AS id, p_partkey % 11 <> 0 AS price, p_partkey % 13 <> 0 AS categories, p_partkey % 7 = 0 AS description FROM part)"
_LONG = "SELECT segment, value, n, field, CAST(populated AS BIGINT) AS populated FROM ({}) UNPIVOT (populated FOR field IN (price, categories, description))"


@query(f"""WITH {_SAMPLES}, {_FLAGS}, b AS (SELECT sam.*, price, categories, description FROM sam JOIN flags ON target = flags.id),
g AS (SELECT 'overall' AS segment, 'all' AS value, count(*) AS n, count(*) FILTER (price) AS price, count(*) FILTER (categories) AS categories, count(*) FILTER (description) AS description FROM b
  UNION ALL SELECT 'scenario_type', scenario, count(*), count(*) FILTER (price), count(*) FILTER (categories), count(*) FILTER (description) FROM b GROUP BY 2
  UNION ALL SELECT 'difficulty_bucket', difficulty, count(*), count(*) FILTER (price), count(*) FILTER (categories), count(*) FILTER (description) FROM b GROUP BY 2),
l AS ({_LONG.format("SELECT * FROM g")}), base AS (SELECT field, rate FROM (SELECT avg(price::INT) AS price, avg(categories::INT) AS categories, avg(description::INT) AS description FROM flags) UNPIVOT (rate FOR field IN (price, categories, description)))
SELECT segment, value, field, n, populated, round(populated / n, 9) AS rate, round(base.rate, 9) AS catalog_rate, round((populated / n - base.rate) * 100, 6) AS points, round(populated / n / nullif(base.rate, 0), 6) AS multiple FROM l JOIN base USING (field)""")
def target_coverage(spark: SparkSession, d: str) -> DataFrame:
    out = P.target_coverage(_samples(spark, d), shop(spark, d), fields=["price", "categories", "description"])
    return out.withColumns({"rate": F.round("rate", 9), "catalog_rate": F.round("catalog_rate", 9), "points": F.round("points", 6), "multiple": F.round("multiple", 6)})


@query("SELECT l_returnflag, count(*) AS n, round(avg((coalesce(r, 10000) <= 10)::INT), 9) AS top_10_rate, round(avg((coalesce(r, 10000) <= 50)::INT), 9) AS top_50_rate, round(avg((coalesce(r, 10000) <= 100)::INT), 9) AS top_100_rate, round(avg((coalesce(r, 10000) <= 1000)::INT), 9) AS top_1000_rate, round(avg(coalesce(1.0 / r, 0)), 9) AS mrr, quantile_cont(r, 0.5)::DOUBLE AS median_found_rank, count(*) FILTER (r IS NULL) AS not_found FROM (SELECT l_returnflag, CASE WHEN l_linenumber < 6 THEN CAST(l_quantity AS INT) * l_linenumber END AS r FROM lineitem) GROUP BY 1")
def rank_summaries(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") < 6, F.col("l_quantity").cast("int") * F.col("l_linenumber")).alias("rank"))
    out = P.rank_summary(rows, ["l_returnflag"])
    return out.withColumns({c: F.round(c, 9) for c in ("top_10_rate", "top_50_rate", "top_100_rate", "top_1000_rate", "mrr")})


@query("WITH o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT 'floor' AS kind, any_value(v) AS value FROM o WHERE i = CAST(floor(0.95 * (n - 1)) AS BIGINT) UNION ALL SELECT 'round', any_value(v) FROM o WHERE i = least(n - 1, CAST(round_even(0.95 * (n - 1), 0) AS BIGINT))")
def index_percentiles(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    of = lambda name, f: f(o, "o_totalprice", 0.95).select(F.lit(name).alias("kind"), F.col("o_totalprice").alias("value"))
    return of("floor", P.floor_percentile).unionByName(of("round", P.round_percentile))


@query(f"""WITH {_SAMPLES}, w AS (SELECT scenario, difficulty, unnest([{{'role': 'hard', 'k': 'style', 's': 'color'}}, {{'role': 'soft', 'k': 'budget', 's': 'price'}}]) AS x FROM sam)
SELECT * FROM (SELECT 'kind' AS "by", x.k AS value, count(*) AS n FROM w GROUP BY 2 UNION ALL SELECT 'source', x.s, count(*) FROM w GROUP BY 2 UNION ALL SELECT 'role', x.role, count(*) FROM w GROUP BY 2 UNION ALL SELECT 'source_kind', x.s || '/' || x.k, count(*) FROM w GROUP BY 2
UNION ALL SELECT 'scenario_kind', scenario || '/' || x.k, count(*) FROM w GROUP BY 2 UNION ALL SELECT 'difficulty_kind', difficulty || '/' || x.k, count(*) FROM w GROUP BY 2)""")
def hidden_constraints(spark: SparkSession, d: str) -> DataFrame:
    wish = lambda role, text, source: F.struct(F.lit(role).alias("role"), F.lit(text).alias("text"), F.lit(source).alias("source"))
    cards = _samples(spark, d).select("scenario_type", "difficulty_bucket", F.explode(F.array(wish("hard", "a loose fit", "color"), wish("soft", "under 20", "price"))).alias("w"))
    return P.hidden_constraints(cards.select("scenario_type", "difficulty_bucket", "w.*"))


@query(f"""WITH {_SHOP} SELECT parent_asin, 'Product: ' || title || '.' || CASE WHEN leaf = '' THEN '' ELSE ' Category: Shoes > ' || leaf || '.' END || ' Features: ' || CASE WHEN f1 = f2 THEN f1 ELSE f1 || '; ' || f2 END || '.'
  || ' Details: color ' || CASE WHEN size % 2 = 0 THEN 'Grey' ELSE 'Red' END || '.' || CASE WHEN description = '' THEN '' ELSE ' Description: Soft wool.' END AS text FROM shop""")
def product_texts(spark: SparkSession, d: str) -> DataFrame:
    return shop(spark, d).select("parent_asin", E.product_text().alias("text"))


@query(f"""WITH {_SHOP}, {_EVIDENCE} SELECT attribute, value, count(*) AS n FROM (SELECT 'color' AS attribute, nullif(array_to_string(list_sort(string_split(regexp_replace(colors, '/[^;]*', '', 'g'), ';')), '|'), '') AS value FROM prod
  UNION ALL SELECT 'material', nullif(array_to_string(list_sort(string_split(regexp_replace(materials, '/[^;]*', '', 'g'), ';')), '|'), '') FROM prod UNION ALL SELECT 'brand', brand_name FROM prod
  UNION ALL SELECT 'budget', CASE WHEN bare THEN NULL WHEN price < 25 THEN 'under_25' WHEN price < 50 THEN '25_50' WHEN price < 100 THEN '50_100' WHEN price < 200 THEN '100_200' ELSE '200_plus' END FROM prod) GROUP BY ALL""")
def candidate_facets(spark: SparkSession, d: str) -> DataFrame:
    rows = facets(normalize(shop(spark, d)))
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in ("color", "material", "brand", "budget")))).alias("x")
    return rows.select(each).groupBy("x.attribute", "x.value").agg(F.count(F.lit(1)).alias("n"))


@query()
def dialogue_fold(spark: SparkSession, d: str) -> DataFrame:
    """The state after every customer message of the conversations, with a request worked in by the turn."""
    said = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.element_at(F.array(*map(F.lit, ("I need red boots", "no leather, under $80", "cotton instead of wool", "actually a warm jacket", "any color is fine"))), (F.col("turn") % 5 + 1).cast("int")))
    return session.fold(load(spark, d, "conversations").filter("role = 'user'").withColumn("text", said))


@query()
def closed_loop(spark: SparkSession, d: str) -> DataFrame:
    """Simulated customers, one for each nation, in dialogues of up to ten turns against the engine over the whole shop."""
    from ..engine import Engine
    from ..evaluation import evaluate

    of = F.col("n_nationkey")
    scenario = F.when(of % 4 == 0, "buying").when(of % 4 == 1, "browsing").when(of % 4 == 2, "intent_override").otherwise("boundary")
    rows = load(spark, d, "nation").select(of.cast("string").alias("sample_id"), scenario.alias("scenario_type"), F.lit("easy").alias("difficulty_bucket"), F.concat(F.lit("P"), F.lpad((of * 3).cast("string"), 9, "0")).alias("target"))
    return evaluate(Engine(spark, shop(spark, d)), rows.withColumn("raw", F.to_json(F.struct("sample_id", "scenario_type"))))


__all__ = ["SQL", "shop"]
