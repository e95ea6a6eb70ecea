"""The engine over a small catalog: normalisation, matching, index, routes, ranking, answers, evaluation, profiles."""

import itertools
import json
import math

import pytest
from pyspark.sql import functions as F

from tessera import benchmarks as B
from tessera.__main__ import main
from tessera.engine import Agent, Engine
from tessera.evaluation import evaluate, read_samples, records, report
from tessera.functions import embedding as E
from tessera.operators import contracts, hybrid, profiles, ranking
from tessera.operators import index as I
from tessera.operators import matching as M
from tessera.operators.normalize import document, facets, normalize
from tessera.sources.catalog import CatalogError, read_catalog, read_lenient, read_objects

TERMS = "array<struct<field:string,values:array<string>>>"
PRODUCTS = [
    {"parent_asin": "BOOT000001", "title": "Trail winter boot", "features": ["Wool lining", "Water-proof"], "description": ["For hiking &amp; snow"], "price": 80.5, "categories": ["Shoes", "Women's", "Winter Boots"], "details": {"Color": "Black", "Material": "95% polyester, 5% spandex"}, "average_rating": 4.5, "rating_number": 120, "store": "Acme"},
    {"parent_asin": "BOOT000002", "title": "City boot black", "features": ["faux leather"], "description": [], "price": "$60", "categories": ["Shoes", "Men", "Boots"], "details": {"Color": "white", "Brand": "Zed", "Size": "9 w"}, "average_rating": 4.0, "rating_number": 30, "store": "Zed"},
    {"parent_asin": "SHOE000003", "title": "Running shoe", "features": ["breathable mesh", "lightweight"], "description": ["Runs well"], "price": "from $9", "categories": ["Shoes", "Running Shoes"], "details": {}, "average_rating": 3.5, "rating_number": 900, "store": None},
    {"parent_asin": "DRESS00004", "title": "Summer dress, red", "features": [], "description": ["A café dress"], "price": None, "categories": [], "details": {"Department": "womens", "Style": "Casual"}, "average_rating": 9, "rating_number": -4, "store": ""},
    {"parent_asin": "HOODIE0005", "title": "Warm hoodie grey", "features": ["100% Cotton fleece"], "categories": ["Clothing", "Hoodies"], "details": {"Color": "grey"}, "average_rating": 4.9, "rating_number": 45, "price": 25},
]
SAMPLES = [{"sample_id": f"{s}{i}", "scenario_type": s, "difficulty_bucket": d, "user_profile": {"preference_tags": ["comfort"], "average_prior_rating": 4}, "ground_truth": {"parent_asin": PRODUCTS[i]["parent_asin"]}}
           for i, (s, d) in enumerate([("buying", "easy"), ("browsing", "hard"), ("intent_override", "easy"), ("boundary", "medium"), ("buying", "hard")])]


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    d = tmp_path_factory.mktemp("shop")
    (d / "catalog.jsonl").write_text("\n\n".join(json.dumps(p) for p in PRODUCTS) + "\n")
    (d / "samples.jsonl").write_text("\n".join(json.dumps(s) for s in SAMPLES) + "\n")
    return str(d / "catalog.jsonl"), str(d / "samples.jsonl"), d


@pytest.fixture(scope="module")
def engine(spark, paths):
    return Engine(spark, paths[0])


def test_readers_name_the_bad_line(spark, tmp_path):
    def file(*lines):
        p = tmp_path / f"{abs(hash(lines))}.jsonl"
        p.write_text("\n".join(lines))
        return str(p)

    good = '{"parent_asin": "A"}'
    for lines, said in [((good, "", "{"), "line 3 is not JSON"), ((good, "[1]"), "line 2 is not an object"), (('{"parent_asin": " "}',), "line 1 has no parent_asin"), ((good, good), "duplicate parent_asin A")]:
        with pytest.raises(CatalogError, match=said):
            read_catalog(spark, file(*lines))
    with pytest.raises(CatalogError, match="line 2"):
        read_objects(spark, file("{}", "x"))
    rows, left_out = read_lenient(spark, file(good, "x", "", "3"), "parent_asin string")
    assert rows.count() == 1 and left_out == 2 and read_catalog(spark, file("")).count() == 0


def values(row, column):
    return [(v["value"], v["source"], v["confidence"]) for v in row[column]]


def test_normalize(engine):
    got = {r["parent_asin"]: r for r in engine.normalized.collect()}
    boot, city, shoe, dress, hoodie = (got[p["parent_asin"]] for p in PRODUCTS)
    assert values(boot, "materials") == [("95_polyester_5_spandex", "details:Material", 0.95), ("polyester", "details:Material", 0.95), ("spandex", "details:Material", 0.95), ("wool", "features", 0.75)]
    assert values(boot, "leaf_categories") == [("winter_boots", "categories:leaf", 0.85)] and list(boot["category_path"]) == ["shoes", "women's", "winter_boots"]
    assert values(boot, "audiences") == [("women", "categories:path", 0.85)] and values(boot, "brands") == [("acme", "store", 0.85)]
    assert list(boot["features"]) == ["hiking", "water proof", "waterproof", "winter", "wool lining"] and tuple(boot["price"]) == (80.5, "price:number", 0.95)
    assert values(city, "colors") == [("white", "details:Color", 0.95), ("black", "title", 0.65)] and values(city, "materials") == [("faux_leather", "features", 0.75)]
    assert tuple(city["price"]) == (60.0, "price:string", 0.9) and values(city, "sizes") == [("9 W", "details:Size", 0.95)] and values(city, "brands") == [("zed", "details:Brand", 0.95)]
    assert shoe["price"] is None and shoe["brands"] == [] and values(dress, "leaf_categories") == [("dresses", "title", 0.65)]
    assert (dress["average_rating"], dress["rating_number"]) == (5.0, 0) and values(dress, "audiences")[0] == ("women", "details:Department", 0.95) and values(dress, "styles")[0][0] == "casual"
    assert values(hoodie, "colors") == [("gray", "details:Color", 0.95)] and [v[0] for v in values(hoodie, "materials")] == ["cotton", "fleece"]
    text = engine.normalized.filter("parent_asin = 'BOOT000001'").select(document().alias("d")).first()["d"]
    assert text == "shoes women's winter boots winter boots women 95 polyester 5 spandex polyester spandex wool black acme hiking water proof waterproof winter wool lining"
    facet = {r["parent_asin"]: r for r in facets(engine.normalized).collect()}
    assert (facet["BOOT000001"]["budget"], facet["BOOT000001"]["use_case"], facet["SHOE000003"]["budget"], facet["HOODIE0005"]["budget"]) == ("50_100", "hiking|winter", None, "25_50")
    assert normalize(engine.products.limit(0)).count() == 0


def test_evaluate_terms(spark, engine):
    def states(asin, hard, excluded=False, threshold=M.THRESHOLD):
        row = engine.normalized.filter(F.col("parent_asin") == asin)
        terms = F.lit(None).cast(TERMS) if hard is None else F.array(*(F.struct(F.lit(f).alias("field"), F.array(*map(F.lit, v)).alias("values")) for f, v in hard)).cast(TERMS)
        return [(m["state"], round(m["confidence"], 2)) for m in row.select(M.evaluate(terms, excluded, threshold).alias("m")).first()["m"]]

    assert states("BOOT000001", [("color", ["black"]), ("color", ["red"]), ("material", ["wool", "polyester"]), ("size", ["9"])]) == [("match", 0.95), ("mismatch", 0.95), ("match", 0.95), ("unknown", 0.0)]
    assert states("BOOT000002", [("color", ["black"]), ("material", ["leather"])], True) == [("unknown", 0.65), ("unknown", 0.75)] and states("BOOT000002", [("material", ["leather"])], False, 0.7) == [("mismatch", 0.75)]
    assert states("BOOT000001", [("price_max", ["100"]), ("price_min", ["100"]), ("feature", ["waterproof"]), ("feature", ["proof wool"])]) == [("match", 0.95), ("mismatch", 0.95), ("match", 0.75), ("unknown", 0.75)]
    assert states("BOOT000001", [("category", ["boots"]), ("category", ["dresses"]), ("category", ["winter_boots"])]) == [("unknown", 0.5), ("mismatch", 0.85), ("match", 0.85)]
    assert states("SHOE000003", [("price_max", ["1"]), ("feature", ["lightweight"])], True) == [("unknown", 0.0), ("unknown", 0.75)]
    with pytest.raises(ValueError):
        M.threshold_of(2)
    phrases = spark.createDataFrame([("women's boots", "men's"), ("men's boots", "men's"), ("a r&b c", "r&b"), ("abc", "")], "t string, p string")
    assert [r[0] for r in phrases.select(M.phrase_in(F.col("t"), F.col("p"))).collect()] == [False, True, True, False]


def test_index_breaks_ties_by_id(spark, tmp_path):
    """Documents whose counts are each other's in another order score alike, in whatever order floats are added."""
    orders = list(itertools.permutations((1, 2, 5, 9)))
    docs = [(i, " ".join(w for w, n in zip(("ant", "bee", "cat", "dog"), order) for _ in range(n))) for i, order in enumerate(orders)] + [(100 + i, "fox") for i in range(53)]
    I.build(spark.createDataFrame(docs, "id long, text string").repartition(5), str(tmp_path / "i"), ["text"], "id")
    asked = spark.createDataFrame([(1, "ant bee cat dog"), (2, "dog cat bee ant"), (3, "bee")], "qid int, query string")
    got = [(r["qid"], r["rank"], r["id"]) for r in I.Index(spark, str(tmp_path / "i")).search(asked, 10, {"text": 1.0}).orderBy("qid", "rank").collect()]
    assert got[:20] == [(q, r + 1, r) for q in (1, 2) for r in range(10)]
    assert [i for *_, i in got[20:]] == sorted(range(24), key=lambda i: (-orders[i][1], i))[:10]


def test_search_gives_on_the_best_of_each_task_alone(spark, tmp_path):
    """A word of every document: rows that leave the tasks are few, and queries of the same terms are one."""
    path = str(tmp_path / "c")
    I.build(spark.range(3000).select("id", F.concat(F.lit("shoe "), (F.col("id") % 7).cast("string"), F.lit("x")).alias("text")).repartition(4), path, ["text"], "id")
    index = I.Index(spark, path)
    asked = spark.range(50).select(F.col("id").alias("qid"), F.lit("shoe 3x").alias("query"))
    assert index.asked(asked).select("terms").distinct().count() == 1
    sent = index.blocks.mapInArrow(I._best(["shoe 3x"], index._idf(["3x", "shoe"], None), I.np.ones(1), [0], index.meta["mean"], 10), "terms string, id long, score double")
    assert 10 <= sent.count() <= 10 * index.blocks.rdd.getNumPartitions()
    got = index.search(asked, 10, {"text": 1.0}).collect()
    assert len(got) == 500 and {(r["rank"], r["id"]) for r in got} == {(n + 1, 3 + 7 * n) for n in range(10)}


def test_index_blocks_equal_a_plain_search(spark, tmp_path, monkeypatch):
    """Many small blocks and queries in lots of two, against sums over all documents."""
    monkeypatch.setattr(I, "QUERIES", 2)
    texts = [(f"d{i:03}", " ".join(f"w{j}" for j in range(1, 12) for _ in range(i * j % 4)) or None, f"w{i % 3} w{i % 5}") for i in range(150)]
    docs = spark.createDataFrame(texts, "id string, text string, title string")
    queries = {1: "w1 w2 w3", 2: "w4", 3: "w0 w9 nothing", 4: "w1 w2 w3", 5: "w10 w5 w7 w8"}
    asked = spark.createDataFrame(list(queries.items()), "qid int, query string")
    weights = {"text": 1.5, "title": 4.0}
    for fields in (None, ["title"]):
        path = str(tmp_path / f"b{len(fields or [])}")
        I.build(docs.repartition(3), path, list(weights), "id")
        words = {i: {"text": (t or "").split(), "title": h.split()} for i, t, h in texts}
        size = {i: len(w["text"]) + len(w["title"]) for i, w in words.items()}
        mean = sum(size.values()) / len(size)
        has = lambda i, t: any(t in words[i][f] for f in fields or weights)
        want = []
        for q, text in queries.items():
            score = {}
            for t in text.split():
                df = sum(has(i, t) for i in words)
                idf = max(math.log((150 - df + 0.5) / (df + 0.5)), 1e-6)
                for i in filter(lambda i: has(i, t), words):
                    f = sum(weights[x] * words[i][x].count(t) for x in fields or weights)
                    score[i] = score.get(i, 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size[i] / mean))
            best = sorted(score, key=lambda i: (-round(score[i], 12), i))[:20]
            want += [(q, n, i, pytest.approx(score[i], abs=1e-9)) for n, i in enumerate(best, 1)]
        got = I.Index(spark, path).search(asked, 20, weights, fields).orderBy("qid", "rank").collect()
        assert [(r["qid"], r["rank"], r["id"], r["score"]) for r in got] == want


def test_index(spark, engine, tmp_path):
    def search(index, text, **how):
        return [(r["id"], r["rank"]) for r in index.search(spark.createDataFrame([(1, text)], "qid int, query string"), 3, **how).orderBy("rank").collect()]

    assert [i for i, _ in search(engine.index, "hikes boots")] == ["BOOT000001", "BOOT000002"] and search(engine.index, "the of") == []
    assert search(engine.index, "cafe dresses")[0] == ("DRESS00004", 1) and search(engine.index, "boots", fields=["description"]) == []
    plain = str(tmp_path / "plain")
    I.build(engine.products, plain, stem=False)
    assert [i for i, _ in search(I.Index(spark, plain), "boots")] == ["BOOT000002", "BOOT000001"] and search(I.Index(spark, plain), "hikes") == []
    got = engine.index.exact_rank(spark.createDataFrame([(1, "boot"), (2, "boot")], "qid int, query string"), spark.createDataFrame([(1, "BOOT000002"), (2, "NONE")], "qid int, target string"), 10)
    assert sorted((r["qid"], r["rank"]) for r in got.collect()) == [(1, 1), (2, None)]
    with pytest.raises(I.IndexError_):
        I.Index(spark, str(tmp_path / "none"))
    I.build(engine.products.limit(0), str(tmp_path / "empty"))
    assert search(I.Index(spark, str(tmp_path / "empty")), "boots") == []


def requests(spark, **more):
    row = {"qid": "q", "route": "buying", "current_message": "boots", "raw_context": "boots", "base_request": "boots", "structured_query": "", "category": "boots", "hard": [], "soft": [], "excluded": [], "tags": [], "turn": 1,
           "blocked": [], "average_prior_rating": None, "legacy_query": "boots"} | more
    kinds = f"qid string, route string, current_message string, raw_context string, base_request string, structured_query string, category string, hard {TERMS}, soft {TERMS}, excluded {TERMS}, tags array<string>, turn int, blocked array<string>, average_prior_rating double, legacy_query string"
    return spark.createDataFrame([tuple(row[k.split()[0]] for k in kinds.split(", "))], kinds)


def test_routes_and_fallbacks(spark, engine):
    plan = {r["route"]: (r["query"], r["weight"]) for r in hybrid.plan(requests(spark, route="browsing", soft=[("use_case", ["hiking"])]), 0.35).collect()}
    assert plan["category_anchor_bm25"] == ("boots", 0.35) and plan["use_case_bm25"] == ("hiking", 0.75) and plan["dense_semantic"][0] == "Looking for boots. Use: hiking. Request: boots."
    pool, found = hybrid.retrieve(requests(spark), engine.index, engine.popular)
    rows = pool.orderBy("rank").collect()
    assert [r["id"] for r in rows] == ["BOOT000002", "BOOT000001"] and [e["route"] for e in rows[0]["evidence"]] == ["active_context_bm25", "current_turn_bm25", "category_anchor_bm25"]
    assert abs(rows[0]["rrf"] - (1.4 + 0.85 + 0.25) / 61) < 1e-12 and not contracts.check_pool(pool) and not found.first()["attempted"]
    nothing, _ = hybrid.retrieve(requests(spark, current_message="zzz", raw_context="zzz", base_request="", category=None), engine.index, engine.popular)
    assert [r["id"] for r in nothing.orderBy("rank").collect()][:2] == ["SHOE000003", "BOOT000001"] and nothing.first()["evidence"][0]["route"] == "popularity_fallback"
    with pytest.raises(hybrid.RetrievalError):
        hybrid.retrieve(requests(spark, current_message="zzz", raw_context="zzz", base_request="", category=None), engine.index, [])
    legacy = hybrid.legacy(requests(spark), engine.index, engine.popular, 4).orderBy("rank").collect()
    assert [(r["id"], r["score"] > 0) for r in legacy] == [("BOOT000002", True), ("BOOT000001", True), ("SHOE000003", False), ("HOODIE0005", False)]


def test_dense_modes(spark, engine):
    vectors = spark.createDataFrame([(p["parent_asin"], [1.0, float(i)]) for i, p in enumerate(PRODUCTS)], "id string, embedding array<double>")
    encoder = lambda texts: texts.select("qid", F.array(F.lit(0.0), F.lit(1.0)).alias("embedding"))
    asked = requests(spark, route="browsing")
    got = {}
    for mode in ("shadow", "on"):
        pool, found = hybrid.retrieve(asked, engine.index, engine.popular, mode=mode, vectors=vectors, encoder=encoder)
        got[mode] = (pool.count(), found.first())
    assert got["shadow"][0] == 2 and got["on"][0] == 5
    assert [got[m][1]["contributed"] for m in got] == [0, 5] and got["on"][1]["exclusive"] == 3 and got["on"][1]["returned"] == 5
    def broken(texts):
        raise RuntimeError("no model")

    pool, found = hybrid.retrieve(asked, engine.index, engine.popular, mode="on", vectors=vectors, encoder=broken)
    assert pool.count() == 2 and found.first()["error"] == "RuntimeError" and profiles.dense_summary(found).first()["error_turns"] == 1


def test_ranking(spark, engine):
    asked = requests(spark, structured_query="black boots wool", hard=[("audience", ["women"])], soft=[("material", ["wool"])], excluded=[("color", ["white"])], tags=["wool boots"])
    pool, _ = hybrid.retrieve(asked, engine.index, engine.popular)
    got = {r["id"]: r for r in ranking.explain(asked, pool, engine.normalized).collect()}
    boot, city = got["BOOT000001"], got["BOOT000002"]
    assert city["filtered"] and city["rank"] is None and boot["rank"] == 1 and boot["unknowns"] == 1
    assert (boot["exact_phrase"], boot["feature_overlap"], boot["hard_match"], boot["soft_match"], boot["popularity"], boot["profile"], boot["penalty"]) == (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0)
    assert abs(boot["score"] - sum(M.WEIGHTS[f] * boot[f] for f in ranking.FEATURES)) < 1e-12
    explained = ranking.explain(asked, pool, engine.normalized)
    assert not contracts.check_ranking(explained, ranking.FEATURES) and tuple(ranking.counts(explained).first())[1:] == (2, 1, 1)
    nobody = ranking.explain(requests(spark, hard=[("price_max", ["1"])]), pool, engine.normalized)
    assert [r["fallback"] for r in ranking.best_or_rrf(nobody, 5).collect()] == ["rrf_ranking"] * 2
    with pytest.raises(Exception, match="candidate is no product"):
        ranking.explain(asked, pool.withColumn("id", F.lit("X")), engine.normalized).collect()
    for bad in ({"shape": 1}, {"rrf": -1}, {"profile": 0.5}):
        with pytest.raises(ValueError):
            ranking.weights(**bad)
    assert ranking.weights(penalty=0.5)["penalty"] == -0.5


def test_contracts(spark):
    assert not contracts.check_requests(requests(spark))
    bad = requests(spark, turn=11, route="x", hard=[("color", []), ("color", ["a", "a"])], current_message=" ", average_prior_rating=7.0)
    assert contracts.check_requests(bad.unionByName(bad)) == {"turn": 2, "route": 2, "hard": 2, "current_message": 2, "average_prior_rating": 2, "repeated": 1}
    with pytest.raises(contracts.ContractError):
        contracts.require({"turn": 1}, "request")
    assert json.loads(contracts.as_json(requests(spark)).first()[0])["contract_version"] == "1.0"


def test_agent(spark, engine):
    agent = Agent(engine)
    with pytest.raises(RuntimeError):
        agent.respond("s", "boots", 1)
    agent.reset("s", {"preference_tags": ["comfort"]})
    first = agent.respond("s", "I'm looking for women's boots under $100, must be wool", 1, 50)
    assert first["ask_attribute"] == "feature" and set(first["usage"].values()) == {0}
    assert first["recommendations"][0]["parent_asin"] == "BOOT000001" and len(first["recommendations"]) == 5 and agent.fallbacks("s") == ()
    assert agent.memory("s").state.hard_constraints == {"audience": ["women"], "material": ["wool"], "price_max": 100}
    agent.reset("t", None)
    assert agent.respond("t", "nothing at all", 1)["recommendations"] and agent.memory("s").base_request != agent.memory("t").base_request
    with pytest.raises(ValueError):
        agent.respond("s", "boots", 11)


def test_question_modes(spark, paths, engine):
    import copy

    for mode in ("shadow", "dynamic"):
        other = copy.copy(engine)
        other.questions = mode
        agent = Agent(other)
        agent.reset("s", {})
        said = agent.respond("s", "I'm looking for boots", 1)
        seen = agent.question_diagnostics("s")
        assert seen["mode"] == mode and seen["policy_attribute"] not in (None, "category")
        assert said["ask_attribute"] == (seen["policy_attribute"] if mode == "dynamic" else "material")
    for bad in ({"runtime": "x"}, {"limit": 0}, {"local": False, "dense": "on"}, {"guard": 2}):
        with pytest.raises(ValueError):
            Engine(spark, paths[0], **bad)


def test_evaluate_and_benchmarks(spark, paths, engine):
    samples = read_samples(spark, paths[1])
    done = evaluate(engine, samples).collect()
    assert len(done) == 5 and all(r["hit"] for r in done)
    assert {r["first_hit_turn"] for r in done if r["scenario_type"] != "intent_override"} == {1} and [r["first_hit_turn"] for r in done if r["scenario_type"] == "intent_override"][0] in (3, 4)
    out = report(spark.createDataFrame(done))
    assert out["sample_count"] == 5 and out["hit_rate_at_10"] == 1.0 and set(out["scenario_metrics"]) == {"buying", "browsing", "intent_override", "boundary"} and profiles.compared(out, out) == {"exact_match": True, "different_fields": []}
    assert report(spark.createDataFrame(done).limit(0), False)["mttc"] is None
    first = {r["sample_id"]: r for r in records(samples, engine.products).collect()}
    assert first["buying0"]["initial_query"] == "I'm looking for Women's Winter Boots. A key requirement is: wool."
    recall = B.retrieval(engine, samples)
    assert recall["recall_at_200"]["overall"] == 1.0 and recall["target_rank"]["median"] >= 1
    ranked = B.ranker(engine, samples)
    assert ranked["candidate_recall_at_200"] == 1.0 and ranked["target_filter_survival"] + 0.2 * len(ranked["target_filter_failures"]) == 1.0
    with pytest.raises(Exception, match="target is no product"):
        evaluate(engine, samples.withColumn("target", F.lit("X"))).collect()


def test_profiles(spark, paths, engine):
    samples, p = read_samples(spark, paths[1]), engine.products
    types = {(r["field"], r["type"]): r["n"] for r in profiles.types(p).collect()}
    assert types["price", "number"] + types.get(("price", "integer"), 0) == 2 and types["price", "string"] == 2 and types["store", "null"] == 2
    assert tuple(profiles.keys(p.unionByName(p.limit(1)), "parent_asin").first()) == (5, 1, 1, 0)
    assert profiles.prices(p, F.col("price"), F.coalesce(F.col("price_kind") == "string", F.lit(False))).first().asDict() == {"numeric_count": 2, "numeric_coverage_rate": 0.4, "string_count": 2, "parseable_string_count": 0, "invalid_string_count": 2, "non_positive_count": 0, "above_1000_count": 0}
    assert tuple(profiles.ratings(p, F.col("average_rating"), F.col("rating_number")).first()) == (1, 1, 0)
    common, depth = profiles.categories(p, F.col("categories"))
    assert common.filter("level = 'all'").first()["value"] == "Shoes" and tuple(depth.first()) == (8, 4, 2, 2.5, 3)
    counted, targets = profiles.sessions(samples, p.filter("parent_asin <> 'BOOT000001'"))
    assert tuple(targets.first()) == (5, 5, 1) and counted.filter("segment = 'scenario' and value = 'buying'").first()["n"] == 2
    cover = {(r["segment"], r["value"], r["field"]): r for r in profiles.target_coverage(samples, p).collect()}
    assert cover["overall", "all", "price"]["rate"] == 0.8 and cover["scenario_type", "boundary", "price"]["points"] == pytest.approx(-80)
    assert {r["value"]: r["n"] for r in profiles.hidden_constraints(profiles.wishes(samples, p)).filter("by = 'role'").collect()}["hard"] == 10
    ranks = spark.createDataFrame([(1,), (20,), (None,), (4,)], "rank int")
    assert tuple(profiles.rank_summary(ranks).first())[:3] == (4, 0.5, 0.75)
    assert profiles.floor_percentile(ranks, "rank", 0.95).first()[0] == 4 and profiles.round_percentile(ranks, "rank", 0.95).first()[0] == 20 and profiles.floor_percentile(ranks.limit(0), "rank", 0.5).first()[0] is None


def test_embedding_texts(spark, engine):
    text = {r["parent_asin"]: r["t"] for r in engine.products.select("parent_asin", E.product_text().alias("t")).collect()}
    assert text["BOOT000001"] == "Product: Trail winter boot. Category: Shoes > Women's > Winter Boots. Features: Wool lining; Water-proof. Details: material 95% polyester, 5% spandex; color Black. Description: For hiking & snow."
    assert text["DRESS00004"] == "Product: Summer dress, red. Details: department womens; style Casual. Description: A café dress."
    rows = spark.createDataFrame([("a <b>x</b>&#233;&nbsp;&lt;i&gt; ;.", ["red", "navy red"]), (None, [])], "t string, w array<string>")
    assert [r[0] for r in rows.select(E.clean(F.col("t"))).collect()] == ["a x é", ""]
    said = spark.createDataFrame([("A Navy Red one, reddish red!", ["red", "navy red"])], "t string, w array<string>").select(E.redacted(F.col("t"), F.col("w"))).first()[0]
    assert said == "A one, reddish !"


def test_command_line(spark, paths):
    catalog, _, d = paths
    (d / "few.jsonl").write_text("\n".join(json.dumps(s) for s in SAMPLES[:2]) + "\n")
    out = main(["evaluate", "--catalog", catalog, "--dataset", str(d / "few.jsonl"), "--output", str(d / "out.json")], spark)
    assert json.loads((d / "out.json").read_text())["hit_rate_at_10"] == out["hit_rate_at_10"] == 1.0 and out["sample_count"] == 2
    assert main(["index", "--catalog", catalog, "--output", str(d / "index")], spark)["docs"] == 5
    assert [t["ask_attribute"] for t in main(["demo", "--catalog", catalog], spark)["turns"]][0] == "material"
