import collections
import hashlib
import io
import itertools
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import bpe, chat, decontaminate, jaccard, langid, quality, queries, secrets, shards, urlfilter, warc

PROSE = "the quick brown fox jumps over a lazy dog while seven wizards brew strange potions under old stone bridges near quiet rivers every long winter night"
LONG = " ".join(f"w{i * i % 9973}" for i in range(30_000))
TEXTS = [None, "", "\n\n", "one", "one two", PROSE, PROSE, PROSE + " again", "A b c d e\n" * 9, "é ü\n\x0b é ü\né ü", "▁ x▁", LONG]


def docs(spark, texts=TEXTS, **more):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # names that operators use inside
    return df.withColumns({"id": F.lit("x"), "key": F.lit(1), "label": F.lit(2), "doc": F.lit("y"), "w": F.lit(3.5)} | more)


def brute_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)


def test_quality(spark):
    got = {r["doc_id"]: r for r in quality.rules(docs(spark)).collect()}
    for i, t in enumerate(TEXTS):
        assert tuple(got[i])[1:7] == brute_rules(t)
    assert [got[i]["kept"] for i in (0, 1, 5, 8)] == [False, False, True, False]
    assert quality.rules(docs(spark).limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in quality.kept(docs(spark)).collect()) == [i for i in got if got[i]["kept"]]


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(10, len(v))
        for i, j in itertools.product(range(len(v) - n + 1 if v else 0), range(len(w) - n + 1)):
            if v[i : i + n] == w[j : j + n]:
                hit |= set(range(j, j + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark):
    items = [(1, PROSE), (2, "ONE, two!"), (3, None), (4, "..."), (10, PROSE.title()), (5, "dog"), (6, "never seen here")]
    texts = [*TEXTS, "x " + PROSE.upper() + " y " + PROSE, "the quick brown fox jumps over a lazy dog"]
    table = docs(spark, texts).unionByName(docs(spark, texts).filter("doc_id = 5"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("win", F.lit(0))
    got = decontaminate.contamination(table, bench).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"]) == brute_hits(texts[r["doc_id"]], items)
    assert {r["doc_id"] for r in decontaminate.clean(table, bench).collect()} == {r["doc_id"] for r in got if not r["n_hit"]}
    assert decontaminate.contamination(table.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(table, bench.limit(0)).collect()} == {0}


def test_proximity(spark):
    table = docs(spark, ["alpha beta x gamma", "alpha beta x x x x x gamma", "gamma beta alpha", "alpha beta gamma"])
    found = decontaminate.windows(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"), "item_id", "text", 10)
    index = decontaminate.PositionalIndex(table, found.select(F.explode(F.split("phrase", " ")).alias("term")))
    keys = {r["doc"]: r["doc_id"] for r in table.select("doc_id", decontaminate.doc_key("doc_id", "text").alias("doc")).collect()}
    near = lambda slop: sorted(keys[r["doc"]] for r in index.proximity_matches(found, slop).collect())
    assert near(0) == [3] and set(near(1)) >= {0, 3} and 1 not in near(1)
    assert sorted(keys[r["doc"]] for r in index.phrase_matches(found).collect()) == [3]


def test_language(spark):
    en, de = "the cat and the dog were in the house with their friends", "der hund und die katze waren in dem haus mit ihren freunden"
    rng = random.Random(1)
    mixed = [(i, " ".join(rng.sample(t.split(), 9)), lang) for i, (t, lang) in enumerate([(en, "en"), (de, "de")] * 40)]
    train = spark.createDataFrame([*mixed, (900, None, "en"), (901, "x", None), (902, "123", "de")], "doc_id long, text string, lang string")
    model = langid.fit(train)
    asked = [None, "", "12 !?", en, de, "der", en * 2000]
    got = [r for r in langid.predict(docs(spark, asked), model).orderBy("doc_id").collect()]
    assert [r["nearest"] for r in got] == ["und", "und", "und", "en", "de", "de", "en"]
    assert all(0 <= r["score"] <= 1 for r in got) and [r["score"] for r in got[:3]] == [0.0] * 3
    assert {r["nearest"] for r in langid.predict(docs(spark, asked), langid.fit(train.limit(0))).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op3_language_id(spark, d).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) >= 0.98 * len(rows)


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    near = lambda a, b: a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * (k := len(a & b)) >= 75 * (len(a) + len(b) - k)
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if near(sets[i], sets[j])]
    for _ in texts:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return [(len(s), x) for s, x in zip(sets, label)]


@pytest.mark.parametrize("centers, held, hot", [(1, 1 << 23, 16), (64, 40, 1 << 20), (64, 40, 2)])
def test_jaccard(spark, monkeypatch, centers, held, hot):
    """With one center to the end, with buckets that stream, with hot tokens that are spread."""
    for name, value in (("CENTERS", centers), ("HELD", held), ("HOT", hot)):
        monkeypatch.setattr(jaccard, name, value)
    rng, texts = random.Random(3), [*TEXTS, PROSE.upper(), "ONE  two", LONG + " tail"]
    base = [f"v{i}" for i in range(60)]
    for k in range(14):  # a family of edits on both sides of the limit, and a shared passage
        w = list(base)
        for _ in range(k % 5):
            w[rng.randrange(60)] = f"u{rng.random()}"
        texts.append(" ".join(w))
        texts.append(" ".join([*base[:45], *(f"z{k}_{i}" for i in range(15 + k % 3))]))
    table = docs(spark, texts)
    got = sorted((r["doc_id"], r["size"], r["component"]) for r in jaccard.join(table).collect())
    want = brute_components(texts)
    assert got == [(i, *want[i]) for i in range(len(texts))]
    left = sorted(r["doc_id"] for r in jaccard.one_of_each(table.unionByName(table.filter("doc_id = 5"))).collect())
    assert left == [i for i in range(len(texts)) if want[i][1] == i]


def test_jaccard_empty(spark):
    assert jaccard.join(docs(spark).limit(0)).count() == 0


def github(body):
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        out = secrets.BASE62[d] + out
    return f"ghp_{body}{out}"


def test_secrets(spark):
    token = github("aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0")
    texts = [None, "", f"é {token}.", token[:-1] + "!", "PassWord=\"abcdefgh1\" token=secret=abcdefghi", "api_key: 'ABCD/efg+hij", "AKIAAKIAAKIA1234567 AKIA12", "0123456789abcdef" * 3 + "ß", "ſecret=abcdefgh1 passwd=short", "a" * 100_000]
    assign = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = [[tuple(s) for s in r["spans"]] for r in secrets.find(docs(spark, texts)).orderBy("doc_id").collect()]
    for t, spans in zip(texts, got):
        t = t or ""
        want = [("assign", *m.span()) for m in assign.finditer(t) if len(m[1]) >= 8]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert sorted(s for s in spans if s[0] in secrets.KINDS[:3]) == sorted(want)
    assert ("github", 2, 42) in got[2] and not got[3]
    masked = {r["doc_id"]: r["text"] for r in secrets.mask(docs(spark, texts)).collect()}
    assert masked[0] is None and masked[2] == "é <SECRET>." and masked[3] == texts[3] and masked[9] == "<SECRET>"


def test_chat(spark):
    rows = [(1, 0, "user", "a<|im_end|>\\ <\\| <"), (1, 1, "assistant", "b\\"), (1, 2, None, None), (1, 3, "assistant", "<|x"), (2, 0, "ro\nle", "q"), (3, 0, "assistant", ""), (3, 0, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    out = chat.expand(turns)
    got = {r["conv_id"]: r for r in chat.digest(out).collect()}
    for c in (1, 2, 3):
        own = [(r or "", t or "") for i, _, r, t in rows if i == c]
        said = "".join(t for r, t in own if r == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["loss_chars"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    whole = chat.materialise(out).filter("conv_id = 1").orderBy("example").collect()
    assert [r["prompt"].count(chat.START) for r in whole] == [2, 4]
    assert [r["prompt"][r["target_start"] : r["target_end"]] for r in whole] == ["b\\\\", "<\\|x"]
    assert got[1]["formatted_chars"] == sum(len(r["prompt"]) for r in whole)
    assert chat.digest(chat.expand(turns.limit(0))).count() == 0


def test_chat_digest_reads_whole_examples(spark, monkeypatch):
    rows = [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (1, 0, "user", "qq"), (1, 1, "assistant", "b")]
    out = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    whole = {r["conv_id"]: r["prompt"] for r in chat.materialise(out).collect()}
    got = {r["conv_id"]: (r["loss_chars"], r["formatted_chars"]) for r in chat.digest(out).collect()}
    assert got == {c: (1, len(p)) for c, p in whole.items()}
    real = chat.materialise
    monkeypatch.setattr(chat, "materialise", lambda x: real(x).filter("conv_id = 1"))
    assert {r["conv_id"]: r["formatted_chars"] for r in chat.digest(out).collect()} == {None: 0, 1: len(whole[1])}


def test_chat_sql_counts_backslashes(spark, tmp_path):
    import duckdb

    rows = [(5, 0, "us\\er", "a\\b <| \\\\"), (5, 1, "assistant", "\\<|"), (6, 0, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = duck.execute(queries.OP6_SQL)
    columns = [c[0] for c in want.description]
    assert sorted(want.fetchall()) == sorted(tuple(r[c] for c in columns) for r in queries.op6_chat_formatting(spark, str(tmp_path)).collect())


def test_url_filters(spark):
    urls = [None, "", "nope", "http://A.Example.NET/en/x?q=/de/", "https://x.net", "https://x.net#/", "ftp://example.com/de/a#b", "http://m.adult-x.example.com/de", "http://a.org/fr/://", "http://b.org?x", "http://notexample.com/de/"]
    pages = spark.createDataFrame(list(enumerate([*urls, urls[3]])), "page_id long, url string").withColumn("key", F.lit(1))
    got = [tuple(r[c] for c in ("host", "path", "rule", "verdict")) for r in urlfilter.judge(pages).orderBy("page_id").collect()]
    assert got[:3] == [("", "", None, "allow")] * 3
    assert got[3] == got[-1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[4:8] == [("x.net", "", None, "allow")] * 2 + [("example.com", "/de/a", "example.com/de/", "block"), ("m.adult-x.example.com", "/de", None, "block")]
    assert got[8:11] == [("a.org", "/fr/://", "org/fr/", "allow"), ("b.org", "", None, "allow"), ("notexample.com", "/de/", None, "allow")]
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_list_of_hosts_as_a_table(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 300}.org/x") for i in range(900)], "page_id long, url string")
    hosts = spark.createDataFrame([(f"H{i}.org",) for i in range(0, 300, 3)] + [(None,), ("h0.org",), ("elsewhere",)], "host string")
    got = {(r["host"], r["verdict"]) for r in urlfilter.judge(pages, listed=hosts).collect()}
    assert got == {(f"h{i}.org", "allow" if i % 3 else "block") for i in range(300)}


def test_bloom_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    levels = urlfilter.cascade(universe)
    assert len(levels) >= 2
    assert universe.filter(urlfilter.member(F.col("key"), levels) != F.col("listed")).count() == 0


def test_long_lists_take_several_cascades(spark, monkeypatch):
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    monkeypatch.setattr(urlfilter, "MAX_BITS", urlfilter.BITS_PER_KEY * 300)
    levels = urlfilter.cascade(universe)
    assert levels[0].parts > 1 and {x.part for x in levels} == set(range(levels[0].parts))
    assert all(x.bits <= urlfilter.MAX_BITS for x in levels)
    assert universe.filter(urlfilter.member(F.col("key"), levels) != F.col("listed")).count() == 0


def naive(word, scores, key, least):
    parts = [(i, i + 1) for i in range(len(word))]
    mask, skipped = (1 << 64) - 1, set()
    while True:
        best = None
        for (a, b), (_, c) in zip(parts, parts[1:]):
            s = scores.get(word[a:c])
            if s is not None and (a, b, c) not in skipped and (best is None or (-s, a) < best[0]):
                best = (-s, a), (a, b, c)
        if best is None:
            return [word[a:b] for a, b in parts]
        a, b, c = best[1]
        if least and ((key ^ a << 42 ^ b << 21 ^ c) * 0xD6E8FEB86659FD93 & mask) < least:
            skipped.add((a, b, c))
            continue
        parts = [p for p in parts if not a <= p[0] < c]
        parts = sorted([*parts, (a, c)])


def test_sentencepiece(spark):
    import sentencepiece

    model, v = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES), bpe.Vocabulary.load(queries.PIECES)
    plain = [t for t in TEXTS if t and "▁" not in t] + ["  Hi  there\nx é 日本 ", " ", "\n", "a" * 3000]
    coder = bpe.Coder(v)
    for t in plain:
        assert list(struct.unpack(f"<{len(x := coder.encode(t)) // 4}i", x)) == model.encode(t)
    for word in ("▁strange", "▁potions,", "bridges"):
        for key in range(50):
            assert bpe.segment(word, v.scores, key * 0x9E3779B97F4A7C15, 1 << 62) == naive(word, v.scores, key * 0x9E3779B97F4A7C15, 1 << 62)
    words = sorted({w for t in plain for w in coder._split(t)}) + ["\u2581\n日😀é", "é", "\n", "aaaaaaaa"]
    for least in (0, 1 << 62):
        keys = [0x9E3779B97F4A7C15 * k % (1 << 64) for k in range(len(words))]
        for w, key, raw in zip(words, keys, coder.lockstep.run(words, np.array(keys, np.uint64), least)):
            want = [i for p in bpe.segment(w, v.scores, key, least) for i in ([v.ids[p]] if p in v.ids else [v.byte_ids[b] for b in p.encode()])]
            assert list(struct.unpack(f"<{len(want)}i", raw)) == want
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs(spark), queries.PIECES, 1, 0.3).collect()}
    other = {r["doc_id"]: r["ids"] for r in bpe.encode(docs(spark), queries.PIECES, 2, 0.3).collect()}
    assert got[0] is None and got[1] == [] and got[5] != other[5]
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs(spark), queries.PIECES, 1, 0.3), queries.PIECES).collect()}
    assert [back[i] for i in range(len(TEXTS))] == TEXTS
    assert bpe.encode(docs(spark).limit(0), queries.PIECES).count() == 0


def test_dropout_is_decided_for_each_occurrence(spark, monkeypatch):
    v = bpe.Vocabulary.load(queries.PIECES)
    long = " " + "strangepotions" * 5
    texts = ["strange potions, bridges " * 40 + "▁日" + long * 3, "strange bridges" + long, "strange potions, bridges " * 40]
    monkeypatch.setattr(bpe, "CACHE", 40)
    for seed, dropout in ((1, 0.1), (2, 0.5)):
        coder = bpe.Coder(v, seed, dropout)
        keys = [bpe.xxhash.xxh64_intdigest(str(k), seed) for k in range(len(texts))]
        for _ in range(2):  # with and without what is kept
            for text, key, raw in zip(texts, keys, coder.encode_all(texts, keys)):
                words = coder._split(text)
                want = []
                for w, own in zip(words, bpe.occurrences(np.array([key], np.uint64), np.array([len(words)])).tolist()):
                    want += [v.byte_ids[b] for b in "▁".encode()] if w is None else [i for p in bpe.segment(w, v.scores, own, coder.least) for i in ([v.ids[p]] if p in v.ids else [v.byte_ids[b] for b in p.encode()])]
                assert np.frombuffer(raw, "<i4").tolist() == want
                assert coder.decode(raw) == text
    rows = [(i, "strange potions") for i in range(200)]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), queries.PIECES, 1, 0.3).collect()
    assert len({tuple(r["ids"]) for r in got}) > 4  # more ways than two lanes gave
    one = bpe.encode(spark.createDataFrame([(0, "strange " * 200)], "doc_id long, text string"), queries.PIECES, 1, 0.3).first()["ids"]
    assert len({tuple(one[i : i + 2]) for i in range(len(one) - 1)}) > 4


def test_hilbert_curve_moves_one_cell_at_a_time():
    cell = sorted(range(4096), key=shards.curve(3, 4).__getitem__)
    at = [(c >> 8, c >> 4 & 15, c & 15) for c in cell]
    assert len(set(cell)) == 4096 and all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in zip(at, at[1:]))


def test_sharding(spark):
    rows = docs(spark, [*TEXTS, *[PROSE] * 200], lang=F.when(F.col("doc_id") % 5 == 0, None).otherwise("en")).withColumn("size", F.length("text"))
    got = shards.assign(rows, {"lang": F.col("lang"), "size": F.col("size")}, "doc_id", F.lit(0), 40).collect()
    count = collections.Counter(r["shard"] for r in got)
    assert len(got) == len(TEXTS) + 200 and set(count) == set(range(40)) and max(count.values()) - min(count.values()) <= 1
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = [r["cell"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)
    assert shards.assign(rows.limit(0), {"lang": F.col("lang")}, "doc_id", F.lit(0), 40).count() == 0


def test_sharding_against_brute_force(spark, tmp_path):
    """Shards, slots and cells with names that clash, long prefixes, doubles and nulls, in blocks of a few rows."""
    rng = random.Random(5)
    data = [(i, None if i % 17 == 0 else f"https://example.org/{rng.choice('abcdefgh')}/{i % 3}", None if i % 13 == 0 else rng.random(), i % 7) for i in range(600)]
    rows = spark.createDataFrame(data, "doc_id long, url string, score double, shard int").withColumns({"cell": F.lit(1), "_row": F.lit(2), "_total": F.lit(3), "row": F.lit(4), "tie": F.lit(5)})
    got = shards.assign(rows, {"url": F.col("url"), "score": F.col("score")}, "doc_id", F.lit(0), 40, block_rows=7).collect()
    assert got[0]["_row"] == 2 and got[0]["tie"] == 5 and len(got) == 600

    def cuts(values, n=16):
        values = sorted(v for v in values if v is not None)
        return [values[len(values) * i // n] for i in range(1, n)]

    urls = cuts([r[1] for r in data])
    place = {r[0]: sum(r[1] is not None and r[1] >= c for c in urls) for r in data}
    at = {v: k for k, v in enumerate(shards.curve(2, 4))}
    cell = {r["doc_id"]: r["cell"] for r in got}
    assert all(at[cell[i]] >> 4 == place[i] for i in cell)  # strings are cut by whole values
    scores = collections.defaultdict(list)
    for r in data:
        scores[at[cell[r[0]]] & 15].append(-1.0 if r[2] is None else r[2])
    order = [scores[k] for k in sorted(scores)]
    assert len(order) == 16 and all(max(a) <= min(b) for a, b in zip(order, order[1:]))  # numbers as doubles
    ranked = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["cell"] for r in ranked] == sorted(cell.values())
    want = [(k * 40 // 600, k) for k in range(600)]
    assert [r["shard"] for r in ranked] == [s for s, _ in want]
    assert [r["slot"] for r in ranked] == [k - min(j for t, j in want if t == s) for s, k in want]
    path = str(tmp_path / "shards")
    shards.write(spark.createDataFrame(got), path)
    stats = {r["shard"]: r for r in shards.prune_stats(spark.read.parquet(path), ["url", "score"]).collect()}
    wide = [s for s, r in stats.items() if r["min_url"] <= "https://example.org/b/1" <= r["max_url"]]
    assert sum(r["n_rows"] for r in stats.values()) == 600 and len(wide) < 20  # readers skip more than half of the shards


def test_warc(spark):
    pages = [(1, "http://a/\r\nX: y", "z" * 200), (2, None, "z" * 200), (3, "u", None), (4, "u", "small"), (5, "u", "small"), (0, "é", "é" * 150)] + [(10 + i, "v", f"<html>{i} {PROSE}</html>") for i in range(40)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("id", F.lit("x"))
    got = {r["page_id"]: r for r in warc.round_trip(table).collect()}
    assert len(got) == len(pages) and (got[2]["record_type"], got[2]["refers_to"]) == ("revisit", 1)
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert got[i]["record_type"] == "revisit" if i == 2 else got[i]["payload"] == raw
    assert warc.round_trip(table.limit(0)).count() == 0


def test_warc_reads_archives_in_parallel_and_shuffles_beyond_a_broadcast(spark, monkeypatch, tmp_path):
    from tessera.llm import decontaminate as D

    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    monkeypatch.setattr(warc, "SALT_ROWS", 50)
    monkeypatch.setattr(warc, "_small", lambda df: D._small(df, 0))
    pages = spark.createDataFrame([(i, "u", ("same " * 40 if i % 3 else f"page {i} " * 20)) for i in range(200)], "page_id long, url string, html string")
    folder = "file://" + str(tmp_path / "w")
    manifest = warc.write(pages, folder)
    back = warc.read(manifest, folder)
    assert manifest.count() > 8 and back.rdd.getNumPartitions() == manifest.count()
    rows = back.collect()
    assert len(rows) == 200 and sum(r["record_type"] == "revisit" for r in rows) == 132 and {r["refers_to"] for r in rows} == {None, 1}


def test_warc_reader_refuses_bad_archives():
    import zstandard

    good = warc.record("response", 1, "u", b"hello", hashlib.sha256(b"hello").hexdigest(), 5, None, "1970-01-01T00:00:00Z")
    assert warc.parse(good)["payload"] == b"hello"
    for bad in (good[:-1], good.replace(b"hello", b"hullo"), good.replace(b"Content-Length", b"Content-Lengt"), b"x" + good, good + good):
        with pytest.raises(ValueError):
            warc.parse(bad)
    book = warc.train([PROSE.encode() + str(i).encode() * 30 for i in range(200)])
    assert book
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(book)).compress
    for lead in (book, zstandard.ZstdCompressor().compress(book)):
        raw = struct.pack("<II", warc.SKIPPABLE, len(lead)) + lead + frame(good) + frame(good)
        assert list(warc.frames(io.BytesIO(raw), 64)) == [good, good]
        with pytest.raises(ValueError):
            list(warc.frames(io.BytesIO(raw[:-3]), 64))


def test_stages(spark):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("text").collect()
    leak = PROSE + " " + max((r["text"] for r in items), key=len)
    table = docs(spark, [*TEXTS, leak, PROSE.replace("fox", "token=abcdefgh12")])
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, table, "/root/testdata/sf0.001")
        assert stage(spark, table.limit(0), "/root/testdata/sf0.001").count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert new.columns == table.columns
            table = new
            table = spark.createDataFrame(new.collect(), new.schema)
    left = {r["doc_id"]: r["text"] for r in table.collect()}
    assert 5 in left and not {0, 1, 2, 3, 6, 8, len(TEXTS)} & set(left)
    assert not any("abcdefgh12" in t for t in left.values())


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def brute_kept(text):
    """The verdict of op1 from plain word and line lists."""
    base, limits = brute_rules(text), quality.Limits()
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    chars = sum(map(len, w))
    lines = [[x for x in re.findall(r"[^\x20\x09-\x0D]+", line)] and line for line in (text or "").split("\n")]
    lines = [x for x in lines if x]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    own = len(lines)
    if base[5] or (own and (len(again) / own > limits.lines or sum(map(len, again)) / max(sum(map(len, lines)), 1) > limits.line_chars)):
        return False
    for n, most in limits.ngrams.items():
        grams = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        inside = {j for i in range(len(w) - n + 1) if grams[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        if chars and sum(len(w[j]) for j in inside) / chars > most:
            return False
    return True


def test_op1_query_against_brute_force(spark, texts):
    got = {r["doc_id"]: r for r in queries.op1_quality_rules(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        assert tuple(got[i])[1:7] == brute_rules(t) and got[i]["kept"] == brute_kept(t), i


def test_op3_query_against_plain_centroids(spark, texts):
    """Predictions from n-gram counts in dictionaries, against the fitted centroids."""
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs_.filter(~langid.held_out()))
    got = {r["doc_id"]: r for r in queries.op3_language_id(spark, SF).collect()}
    assert set(got) == set(texts)
    mask, m = (1 << 64) - 1, 0x9E3779B97F4A7C15
    for i, t in texts.items():
        low = (t or "").lower()
        letters = "".join(c if c.isalpha() else " " for c in low)
        if not letters.strip():
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        points = [32, *(ord(c) for k, c in enumerate(letters) if c != " " or not k or letters[k - 1] != " "), 32]
        count = collections.Counter()
        for k, p in enumerate(points):
            for size, salt in ((1, 1), (2, 2), (3, 3)):
                if k + size <= len(points):
                    x = 0
                    for q in points[k : k + size]:
                        x = x * 0x110000 + q
                    count[((x * m + salt) * m & mask) >> 64 - langid.BITS] += 1
        v = np.zeros(langid.SIZE)
        for b, n in count.items():
            v[b] = np.log1p(n) * model.idf[b]
        cosine = model.centroids @ (v / np.linalg.norm(v))
        best = int(cosine.argmax())
        assert abs(got[i]["score"] - min(max(cosine[best], 0), 1)) < 1e-4 and cosine[model.names.index(got[i]["lang_pred"])] is not None
        near = [n for n, c in zip(model.names, cosine) if c > cosine[best] - 1e-5]
        assert got[i]["lang_pred"] in near


def test_op5_query_against_brute_force(spark, texts):
    assign = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in queries.op5_secret_scans(spark, SF).collect():
        t = texts[r["doc_id"]] or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        listed = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, k, _ in found) for n in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest() and set(listed) <= set(r["spans"].split(","))


def test_secret_checks_of_npm_and_extended_keys():
    body = "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0"
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        out = secrets.BASE62[d] + out
    assert ("npm", 4, 44) in secrets.scan(f"see npm_{body}{out} ".encode()) and not secrets.scan(f"see npm_{body}{out[:-1]}- ".encode())
    # an extended private key: 78 bytes and four of their double SHA-256, in base 58
    raw = bytes.fromhex("0488ADE4") + bytes(range(74))
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    n, key = int.from_bytes(raw, "big"), ""
    while n:
        n, d = divmod(n, 58)
        key = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"[d] + key
    assert [s[0] for s in secrets.scan(f" {key} ".encode())] == ["xprv"] and not secrets.scan(f" {key[:-1]}x ".encode())


def test_op8_query_against_plain_merging(spark, texts):
    v = bpe.Vocabulary.load(queries.PIECES)
    least = bpe.Coder(v, 42, 0.1).least
    coder = bpe.Coder(v)
    for r in queries.op8_sentencepiece(spark, SF).collect():
        t = texts[r["doc_id"]]
        if t is None:
            assert r["n_tokens"] is None
            continue
        raw = t.encode()
        assert r["lossless"] and r["decoded_sha256"] == hashlib.sha256(raw).hexdigest()
        if len(t) > 3000:
            continue
        words = coder._split(t)
        key = bpe.xxhash.xxh64_intdigest(str(r["doc_id"]), 42)
        own = bpe.occurrences(np.array([key], np.uint64), np.array([len(words)])).tolist()
        ids = []
        for w, k in zip(words, own):
            ids += [v.byte_ids[b] for b in "▁".encode()] if w is None else [i for p in naive(w, v.scores, k, least) for i in ([v.ids[p]] if p in v.ids else [v.byte_ids[b] for b in p.encode()])]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}i", *ids)).hexdigest())


def test_op9_query_against_brute_force(spark, texts):
    got = queries.op9_hilbert_sharding(spark, SF).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts.items()}
    ranked = sorted(got, key=lambda r: (r["cell"], r["doc_id"]))  # one block a cell at this size
    for k, r in enumerate(ranked):
        shard = k * 40 // len(ranked)
        assert (r["law"], r["shard"], r["slot"], r["grown_shard"]) == ("rows", shard, k - -(-shard * len(ranked) // 40), None)


def test_pipeline_query_against_brute_force(spark, texts):
    """run(): quality, one of each near-duplicate group, decontamination, masked secrets, tokens that decode to them."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {i: t for i, t in texts.items() if brute_kept(t)}
    ids = sorted(left)
    label = brute_components([left[i] for i in ids])
    left = {i: left[i] for k, i in enumerate(ids) if not label[k][0] or label[k][1] == k}
    rule = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: rule.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + min(10, len(w))]) for w in map(words, (t for _, t in items)) if w for i in range(len(w) - min(10, len(w)) + 1)}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    left = {i: t for i, t in left.items() if not hit(words(t))}

    def masked(t):
        raw, out, end = t.encode(), [], 0
        for a, _, b in secrets._scan(raw, secrets.automaton()):
            if a >= end:
                out += [raw[end:a], b"<SECRET>"]
            end = max(end, b)
        return b"".join([*out, raw[end:]]).decode()

    got = {r["doc_id"]: r for r in entry.queries()["pipeline"](spark, SF).collect()}
    assert sorted(got) == sorted(left)
    coder = bpe.Coder(bpe.Vocabulary.load(queries.PIECES))
    for i, t in left.items():
        assert got[i]["n_tokens"] == len(got[i]["ids"]) and coder.decode(np.array(got[i]["ids"], "<i4").tobytes()) == masked(t)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import os

    import duckdb

    duck, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for f in os.listdir(sf):
        duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    want = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(want.fetchall(), key=str) == sorted((tuple(r[c] for c in columns) for r in entry.queries()[name](spark, sf).collect()), key=str)
