import json
import math
import os
import sqlite3

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import constraints as K
from tessera.functions.analysis import phrase, stems
from tessera.operators.questions import TAGS, choose
from tessera.functions import text as X
from tessera.functions.lexicons import known_values
from tessera.operators import analytics as A
from tessera.operators import matching as M
from tessera.operators import retrieval as R
from tessera.plans.queries import QUERIES, SQL
from tessera.sources import catalog
from tessera.sources.vectors import VectorsError, optional_vectors, read_vectors, write_vectors
from tessera.streaming import session

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].astype(object).where(x[columns].notna(), None) for x in (got, want))
    key = lambda rows: sorted([str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r] for r in rows.values.tolist())
    assert key(got) == key(want)


def test_bm25_equals_fts5(spark):
    texts = ["red shoe run", "blue shoe shoe", "green boot", "red red boot walk", "hat", "scarf wool red", "long blue coat wool"]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(text, tokenize='unicode61')")
    db.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", enumerate(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["score"] for r in R.search(docs, spark.createDataFrame([(1, "red wool")], "qid int, query string"), {"text": 1.0}, "id").collect()}
    want = {i: -s for i, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH 'red OR wool'")}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in got)


def test_fusion_and_guard(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "qid int, id long, rank int")
    b = spark.createDataFrame([(1, 9, 1), (1, 7, 3)], "qid int, id long, rank int")
    got = {r["id"]: r["rrf"] for r in R.fuse([(a, 1.40), (b, 0.85)], 10).collect()}
    assert got[7] == pytest.approx(1.40 / 61 + 0.85 / 63) and set(got) == {7, 8, 9}
    legacy = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "qid int, id long, rank int")
    formal = spark.createDataFrame([(1, 2, 1)], "qid int, id long, rank int")
    blend = {r["id"]: r["blend"] for r in R.guarded(legacy, formal, F.lit(0.4)).collect()}
    assert blend[2] == pytest.approx(0.7) and blend[1] == pytest.approx(0.6 + 0.4 / 201)


#: Texts in which words end as DuckDB sees them: at letters that are not of a-z, at marks, at a capital dotted I.
ODD = ["underätzt", "ciónonly", "must\u0301 do", "İdeas", "\u0130dea", "no_must", "loo\u212aing for", "MUST", "ideas", "only1", "", None]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of conversations that say ODD."""
    path = f"{tmp_path_factory.mktemp('odd')}"
    rows = [(c, t, "user", text) for c in range(len(ODD)) for t, text in enumerate(ODD)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def odd_rows(spark, path, name):
    """(rows of the query, rows of its SQL), sorted."""
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    got = QUERIES[name](spark, path)
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


def test_route_decision_ends_words_as_its_sql(spark, odd):
    got, want = odd_rows(spark, odd, "route_decision")
    assert got == want and len({r[2:] for r in got}) == 4
    name, sure = A.route(F.lit("underätzt"), F.lit(False), F.lit(False), F.lit("boots"))  # by itself, words have letters of any script
    assert (value(spark, name), value(spark, sure)) == ("browsing", 0.72)


def test_route_signals_end_words_as_their_sql(spark, odd):
    got, want = odd_rows(spark, odd, "route_signals")
    assert got == want and any("strong_buying_language" in r[3] and "browsing_language" in r[3] for r in got)


def test_popularity_keeps_larger_id_at_the_border(spark):
    items = spark.createDataFrame([(1, 10, 1.0), (2, 5, 1.0), (3, 5, 1.0)], "id long, n long, r double")
    assert [r["id"] for r in R.popular(items, "id", "n", "r", 2).collect()] == [1, 3]


def test_popularity_compares_rounded_scores(spark, tmp_path):
    """7 * (61 / 7) is a little less than 61: as before rounding, the largest id would lose the tie."""
    rows = [(i, 61.0) for i in range(200)] + [(200, q) for q in (1.0, 10.0, 10.0, 10.0, 10.0, 10.0, 10.0)]
    spark.createDataFrame(rows, "l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(c.execute(SQL["popularity_topk"]).fetchall())
    assert sorted(map(tuple, QUERIES["popularity_topk"](spark, f"{tmp_path}").collect())) == want and want[-1] == (200, 61.0) and len(want) == 200


@pytest.mark.parametrize("text, want", [("12", 12.0), ("$ 12.50", 12.5), ("from $9", None), ("abc", None), ("-3", None), ("NaN", None)])
def test_price(spark, text, want):
    assert value(spark, X.parsed_price(F.lit(text))) == want


def test_budget_takes_the_first_form(spark):
    low, high = X.budget(F.lit("between $10 and 20, under 5"))
    assert (value(spark, low), value(spark, high)) == (10.0, 20.0)
    low, high = X.budget(F.lit("increase my budget to 90"))
    assert (value(spark, low), value(spark, high)) == (None, 90.0)
    assert value(spark, X.price_bucket(F.lit(99.99))) == "<100"


def test_lexicon_keeps_faux_leather_apart(spark):
    assert value(spark, known_values(F.lit("Faux leather and 100% Cotton, grey"), "material")) == ["faux_leather", "cotton"]
    assert value(spark, known_values(F.lit(None).cast("string"), "color")) == []


def test_three_states(spark):
    red = F.array(F.lit("red"))
    state = lambda v, c, **k: value(spark, M.match_value(F.lit(v).cast("string"), F.lit(c), red, **k))
    assert [state("red", 0.5), state("blue", 0.95), state("blue", 0.65), state(None, 0.9)] == ["match", "mismatch", "unknown", "unknown"]
    assert [state("red", 0.95, excluded=True), state("red", 0.75, excluded=True), state("blue", 0.95, excluded=True)] == ["mismatch", "unknown", "match"]
    assert value(spark, M.match_ratio(F.array(F.lit("match"), F.lit("unknown"), F.lit("mismatch")))) == 0.5


def test_metrics(spark):
    got = A.metrics(spark.createDataFrame([(2, 2), (None, None)], "rank int, turn int")).first()
    assert (got["hit"], got["mrr"], got["mttc"]) == (0.5, 0.25, 6.5)


def test_entropy_is_zero_below_two_values(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", None), ("b", "x"), ("b", "y")], "attribute string, value string")
    got = {r["attribute"]: r for r in A.facet_scores(rows).collect()}
    assert got["a"]["entropy"] == 0.0 and got["a"]["coverage"] == 0.5 and got["b"]["entropy"] == pytest.approx(1.0)


def test_catalog(spark, tmp_path):
    lines = [{"parent_asin": "A", "price": 20.0}, {"parent_asin": "B", "price": "$12.50"}, {"parent_asin": "C", "price": "from $9"}, {"parent_asin": "D"}]
    path = tmp_path / "c.jsonl"
    path.write_text("\n\n".join(map(json.dumps, lines)))
    got = {r["parent_asin"]: (r["price_value"], r["price_confidence"]) for r in catalog.priced(catalog.read_catalog(spark, str(path))).collect()}
    assert got == {"A": (20.0, 0.95), "B": (12.5, 0.9), "C": (None, None), "D": (None, None)}
    for bad in ('{"title": "x"}', "[1]", '{"parent_asin": "A"}\n{"parent_asin": "A"}', "{bad"):
        path.write_text(bad)
        with pytest.raises(Exception):
            catalog.read_catalog(spark, str(path)).collect()


def test_batch_fold_equals_stream(spark, tmp_path):
    rows = [(1, 0, "a red or blue one under $50"), (1, 1, "not blue"), (1, 2, "hm"), (2, 0, None), (2, 1, "leather"), (2, 2, "start over")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    want = {(r["conv_id"], r["turn"]): r["state"] for r in session.fold(turns).collect()}
    after = json.loads(want[1, 1])
    assert (after["soft_preferences"], after["hard_constraints"], after["excluded"], after["turn"]) == ({"color": ["red"]}, {"price_max": 50}, {"color": ["blue"]}, 2)
    assert json.loads(want[1, 2]) == after | {"turn": 3} and json.loads(want[2, 2]) == {"schema_version": "0.1.0", "turn": 3}
    assert [r["dry"] for r in session.fold(turns).orderBy("conv_id", "turn").collect()] == [0, 0, 1, 1, 0, 0]
    turns.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in"))
    q = session.stream(stream).writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["conv_id"], r["turn"]): r["state"] for r in spark.table("folded").collect()} == want


def test_dense_answers_the_whole_query_set_in_blocks(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = sorted(r["vec_id"] for r in v.filter("vec_id % 50 = 0").collect())
    assert sorted({r["qid"] for r in QUERIES["dense_topk"](spark, SF).collect()}) == want
    rows = [(i, [float(i % 7), float(i % 3) - 1, 0.5]) for i in range(1203)] + [(1203, None)]
    many = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k, block in ((4, 1000), (1300, 500)):
        asked = many.filter("vec_id % 400 = 0" if k > 4 else "true").withColumnRenamed("vec_id", "qid")
        got = {}
        for r in R.dense(many, asked, k, block=block).collect():
            got.setdefault(r["qid"], {})[r["rank"]] = r["id"], r["score"]
        assert len(got) == asked.count()
        for q, found in got.items():
            score = lambda v: None if v is None or rows[q][1] is None else round(sum(x * y for x, y in zip(v, rows[q][1])), 6)
            all_ = sorted(((i, score(v)) for i, v in rows), key=lambda x: math.inf if x[1] is None else -x[1])  # stable: ties by id
            assert [found[n + 1] for n in range(len(found))] == all_[:k]


def test_entry(spark):
    assert isinstance(entry.entry(spark).toPandas(), pd.DataFrame)
    assert set(entry.oracle_sql()) <= set(entry.queries())


# Published pairs of Porter's algorithm.
STEMS = "caresses:caress ponies:poni ties:ti agreed:agre plastered:plaster motoring:motor conflated:conflat hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat rational:ration vietnamization:vietnam sensibiliti:sensibl electriciti:electr hopeful:hope replacement:replac adoption:adopt controll:control roll:roll cease:ceas rate:rate women:women Café:cafe naïve:naiv"


def test_stems(spark):
    want = dict(p.split(":") for p in STEMS.split())
    got = stems(spark.createDataFrame([(w,) for w in [*want, *want, None]], "word string"))
    assert {r.word: r.stem for r in got.collect()} == want


def test_phrase_is_nfkc(spark):
    rows = spark.createDataFrame([("ﬁne_Knit",), ("Ｂｌｕｅ-x",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(phrase(F.col("t"))).collect()] == ["fine knit", "blue x", None, ""]


def test_constraint_phrases(spark):
    said = ["Under $20", "soft cotton", "navy blue", "wide", "crew neck", "for work", "nice", None]
    rows = spark.createDataFrame([(s,) for s in said], "t string")
    assert [r[0] for r in rows.select(K.kind(F.col("t"))).collect()] == ["budget", "material", "color", "size", "style", "use_case", "feature", "feature"]
    rows = spark.createDataFrame([("Running Shoes",), ("T shirt",), ("earring",), ("watches",), ("lamp",), (None,)], "t string")
    assert [r[0] for r in rows.select(K.family(F.col("t"))).collect()] == ["footwear", "clothing", "jewelry", "watches", None, None]
    rows = spark.createDataFrame([(" -; a \n b ,.",), ("x" * 179 + " yy",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(K.cleaned(F.col("t"))).collect()] == ["a b", "x" * 179, "", None]
    rows = spark.createDataFrame([(["Clothing, Shoes & Jewelry", "Women", "Shoes", "Boots"],), (["Clothing"],), ([],), (None,)], "p array<string>")
    assert [r[0] for r in rows.select(K.coarse_category(F.col("p"))).collect()] == ["Shoes Boots", "clothing item", "clothing item", "clothing item"]


def test_match_category(spark):
    rows = [(["boots"], ["boots"], []), (["boots"], ["sandals"], []), (["boots"], ["jacket"], []), (["boots"], [], []), (["lamp"], ["boots"], []), (["shoes"], ["boots"], ["shoes"])]
    rows = spark.createDataFrame(rows, "w array<string>, l array<string>, p array<string>")
    c = [F.col(x) for x in "wlp"]
    state, sure = K.match_category(*c, F.lit(0.65))
    assert [tuple(r) for r in rows.select(state, sure).collect()] == [("match", 0.65), ("unknown", 0.5), ("mismatch", 0.65), ("unknown", 0.0), ("unknown", 0.5), ("match", 0.65)]
    assert [r[0] for r in rows.select(K.match_category(*c, F.lit(0.65), excluded=True)[0]).collect()] == ["mismatch", "unknown", "match", "unknown", "unknown", "mismatch"]


def test_questions(spark):
    empty = []
    sessions = [
        (1, 10, "buying", "c", empty, empty, empty, 0, False), (2, 1, "buying", None, empty, empty, empty, 0, False), (3, 3, "buying", "c", empty, empty, empty, 2, False),
        (4, 3, "buying", "c", empty, empty, empty, 2, True), (5, 3, "browsing", "c", ["color"], empty, empty, 0, False), (6, 1, "buying", "c", ["material", "feature"], ["color", "style"], None, 0, False),
        (7, 1, "browsing", "c", list(TAGS.values()), empty, ["fit"], 0, False),
    ]
    sessions = spark.createDataFrame(sessions, "qid int, turn int, route string, category string, known array<string>, blocked array<string>, tags array<string>, dry int, other_used boolean")
    facets = spark.createDataFrame([(q, "color", v) for q in (4, 5) for v in ("a", "b", None, "unknown")] + [(5, "size", "s"), (5, "size", "m"), (5, "budget", "x")], "qid int, attribute string, value string")
    got = {r.qid: (r.attribute, r.value) for r in choose(sessions, facets).collect()}
    assert got == {1: (None, None), 2: ("category", None), 3: ("other", None), 4: ("color", 0.2375), 5: ("size", 0.175), 6: ("size", 0.0), 7: (None, None)}
    asked = spark.createDataFrame([([], [], ["material", "feature"]), (["feature"], ["color"], ["material"]), (K.QUESTION_ORDER, [], [])], "a array<string>, n array<string>, m array<string>")
    assert [r[0] for r in asked.select(K.safe_question(F.col("a"), F.col("n"), F.col("m"))).collect()] == ["feature", "style", None]


def test_vectors_whatever_file_is_read_first(spark, tmp_path):
    from tessera.sources.vectors import validate_vectors, vectors_error

    rows = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 2.0])], "id string, embedding array<double>")
    path = str(tmp_path / "v")
    write_vectors(rows, path, model_id="m", model_revision="r", catalog_sha256="c")
    assert vectors_error(spark, path) is None and vectors_error(spark, path, "other") == "VectorsError"
    for foreign in (rows.selectExpr("'x' AS id", "1 AS embedding"), rows.selectExpr("2.5D AS id", "embedding")):
        foreign.coalesce(1).write.mode("append").parquet(f"{path}/vectors")
        with pytest.raises(VectorsError):
            read_vectors(spark, path)
        assert optional_vectors(spark, path) == ("off", None)
    odd = spark.createDataFrame([("a", [0.6, 0.8]), (None, [2.0]), ("c", None), ("d", [0.0])], rows.schema)
    assert validate_vectors(odd) == {"null_ids": 1, "unusable": 2, "not_unit": 1, "dimensions": 3, "rows": 4}


def test_close_scores_keep_their_order(spark):
    v = spark.createDataFrame([(1, [1.0]), (2, [1.0000003]), (3, [1.0000003])], "vec_id int, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0])], "qid int, embedding array<double>")
    assert [r["id"] for r in R.dense(v, asked, 2).orderBy("rank").collect()] == [2, 3]


def test_vectors(spark, tmp_path):
    rows = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 2.0])], "id string, embedding array<double>")
    names = {"model_id": "m", "model_revision": "r", "catalog_sha256": "c"}
    path = str(tmp_path / "good")
    write_vectors(rows, path, **names)
    assert {r.id: [round(x, 6) for x in r.embedding] for r in read_vectors(spark, path, "c").collect()} == {"a": [0.6, 0.8], "b": [0.0, 1.0]}
    assert optional_vectors(spark, path, "d") == ("off", None) and optional_vectors(spark, None) == ("off", None)
    assert optional_vectors(spark, path)[0] == "on"
    rows.write.mode("append").parquet(f"{path}/vectors")
    with pytest.raises(VectorsError):
        read_vectors(spark, path)
    for k, bad in enumerate(([("a", [1.0]), ("a", [2.0])], [("a", [1.0]), ("b", [2.0, 1.0])], [])):
        with pytest.raises(VectorsError):
            write_vectors(spark.createDataFrame(bad, rows.schema), str(tmp_path / str(k)), **names)
        assert optional_vectors(spark, str(tmp_path / str(k))) == ("off", None)
    for k, bad in enumerate((None, [0.0], [float("nan")], [])):
        with pytest.raises(Exception, match="not finite"):
            write_vectors(spark.createDataFrame([("a", bad)], rows.schema), str(tmp_path / f"x{k}"), **names)
