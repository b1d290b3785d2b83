"""Tokens, sharding, mixing, toxicity, nearest neighbours and the pipeline."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import ann, byte_bpe, mixing, sharding, token_orc, toxicity
from sensorloom.llm._common import new_path
from tests.llm.conftest import columns_as_before

P = pytest.importorskip("public_tokenizers")


def documents(n, seed=0):
    rng = random.Random(seed)
    syllables = ["ka", "to", "Mi", "é", "ren", "s'", ", ", " ", "  ", "\n", "7", "12", "😀", "don't", "ı", "Σ"]
    return [(i, "".join(rng.choice(syllables) for _ in range(rng.randrange(80)))) for i in range(n)]


@pytest.fixture(scope="module")
def texts(spark, edge):
    return spark.createDataFrame(documents(150), "doc_id long, text string").unionByName(edge.select("doc_id", "text")).repartition(4)


def test_byte_bpe_is_tiktoken(texts, nothing):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    key = lambda i, raw: (i, hashlib.sha256(raw).hexdigest())
    want = collections.Counter()
    for r in texts.collect():
        t = r["text"] or ""
        ids = enc.encode_ordinary(t)
        want[r["doc_id"], len(ids), *key(0, np.array(ids, "<u4").tobytes())[1:], hashlib.sha256(t.encode()).hexdigest()] += 1
    out = byte_bpe.encode(texts)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect()) == want
    back = byte_bpe.decode(out.select("doc_id", "ids")).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back) == sorted((r["doc_id"] or -1, r["text"] or "") for r in texts.collect())
    assert byte_bpe.encode(nothing).count() == 0


def test_token_orc_round_trip(spark, texts, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [(r["doc_id"], r["text"] or "") for r in texts.where("doc_id is not null and doc_id <> 7").dropDuplicates(["doc_id"]).collect()]
    rows += [(1000, "<|startoftext|> <|endoftext|> hello"), (1001, "a<|ENDOFTEXT|>b <|end of text|>"), (1002, "x" * 300 + " don't " + "ab" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = new_path(spark, "orc-test")
    token_orc.write(df, path)
    got = {r["doc_id"]: tuple(r) for r in token_orc.digest(token_orc.read(spark, path)).collect()}
    start = 0
    for i, x in sorted(rows):
        ids = [*t.encode(x, add_special_tokens=False).ids, 1]
        assert got[i] == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r["doc_id"] for r in token_orc.lookup(spark, path, [20]).collect()] == [20]
    assert list(t.encode(rows[-3][1], add_special_tokens=False).ids) == [49406, 49407, 3306]
    empty = new_path(spark, "orc-test")
    token_orc.write(nothing, empty)
    assert token_orc.read(spark, empty).count() == 0
    every = new_path(spark, "orc-test")
    token_orc.write(texts, every)
    assert token_orc.read(spark, every).count() == texts.count()


def test_token_orc_prunes(spark, monkeypatch):
    import glob

    from pyarrow import orc

    monkeypatch.setitem(token_orc.ORC_OPTIONS, "orc.stripe.size", str(200_000))
    noise = F.concat_ws(" ", *[F.md5((F.col("id") * 7 + k).cast("string").cast("binary")) for k in range(2)])
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), noise.alias("text"))
    path = new_path(spark, "orc-test")
    token_orc.write(df, path)
    files = sorted(glob.glob(path.removeprefix("file:").replace("//", "/") + "/*.orc"))
    assert len(files) == 4 and max(orc.ORCFile(f).nstripes for f in files) > 1
    # of a sought id one row group is read, of ids that no range holds none
    for ids, most in (([7777], 1000), ([7777, 15], 2000), ([10**9], 0)):
        found = token_orc.lookup(spark, path, ids)
        assert len(found.collect()) == len([i for i in ids if i < 60_000])
        plan = found._jdf.queryExecution().executedPlan()
        while plan.children().size():
            plan = plan.children().head()
        assert plan.metrics().apply("numOutputRows").value() <= most


def test_token_orc_null_ids(spark):
    df = spark.createDataFrame([(None, f"text {i}") for i in range(400)] + [(3, "x")], "doc_id long, text string").repartition(3)
    path = new_path(spark, "orc-test")
    token_orc.write(df, path)
    rows = token_orc.read(spark, path).orderBy("start").collect()
    assert len(rows) == 401 and rows[-1]["doc_id"] == 3
    assert [r["start"] for r in rows] == [sum(len(x["ids"]) for x in rows[:k]) for k in range(401)]
    assert spark.read.orc(path).select("part").distinct().count() > 1  # one id, several ranges


def test_shards(texts, nothing, edge):
    rows = sharding.shard(texts, 16).collect()
    assert len(rows) == texts.count() and sharding.shard(nothing).count() == 0
    total = sum(r["size"] for r in rows)
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]))
    before, slots = 0, collections.Counter()
    for r in order:
        want = min(15, (2 * before + r["size"]) * 16 // (2 * total))
        assert (r["shard"], r["slot"]) == (want, slots[want])
        slots[want] += 1
        before += r["size"]
    assert {r["doc_id"]: r["text_crc32"] for r in rows}[4] == zlib.crc32(b"a")


def test_shards_of_rows_alike_and_files(spark, edge, nothing):
    same = spark.createDataFrame([(1, "alike")] * 500 + [(2, "b")], "doc_id long, text string").repartition(5)
    rows = sharding.shard(same, 4).collect()
    assert collections.Counter(r["shard"] for r in rows) == {0: 125, 1: 125, 2: 125, 3: 126}
    assert all(sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(125 + (k == 3))) for k in range(4))
    path = new_path(spark, "shards")
    sharding.write_shards(edge, path, 4)
    back = spark.read.parquet(path)
    assert back.count() == edge.count() and set(back.columns) == {*edge.columns, "shard_"} and columns_as_before(edge, back)
    sharding.write_shards(nothing, path + "0", 4)


def split(total, children):
    """Shares of (weight, capacity) children: by weight, none above its capacity."""
    out, left = {}, dict(children)
    while left:
        level = total / sum(w for w, _ in left.values())
        full = {k: c for k, (w, c) in left.items() if c <= level * w}
        if not full:
            return out | {k: level * w for k, (w, _) in left.items()}
        for k, c in full.items():
            out[k] = c
            total -= c
            del left[k]
    return out


def test_budgets_against_brute_force(spark):
    rng = random.Random(3)
    leaves = [(d, g, s, rng.randrange(0, 900), 5) for d in ("web", "books") for g in ("en", "de", None) for s in ("a", "b")]
    total, weights = 3000, {"domain": {"web": 2.0}, "lang": {"en": 3.0}, "source": {"a": 0.5}}
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long, rows long")
    got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.budgets(df, float(total), weights=weights, max_epochs=1).collect()}

    def down(budget, path):
        if len(path) == 3:
            return {path: budget}
        kids = {x[len(path)] for x in leaves if x[: len(path)] == path}
        level = mixing.TREE[len(path)]
        share = split(budget, {k: (weights[level].get(k, 1.0), sum(x[3] for x in leaves if x[: len(path) + 1] == (*path, k))) for k in kids})
        return {p: b for k in kids for p, b in down(share[k], (*path, k)).items()}

    want = down(min(total, sum(x[3] for x in leaves)), ())
    assert all(abs(got[k] - want[k]) <= 1 for k in want)


def mixed(rows, plan, max_epochs, seed=mixing.SEED):
    """doc_id: epochs, leaf by leaf: whole epochs, then the longest prefix of tokens in the order of the hash."""
    import xxhash

    def chain(*cells):
        h = 42
        for size, x in cells:
            h = xxhash.xxh64_intdigest(x.to_bytes(size, "little", signed=True), h)
        return h - (1 << 64) if h >> 63 else h

    out = collections.Counter()
    for leaf, (tokens, budget) in plan.items():
        whole = budget // tokens if tokens else 0
        rest, before = budget - whole * tokens, 0
        own = [r for r in rows if (r["domain"], r["lang"], r["source"]) == leaf]
        for r in sorted(own, key=lambda r: chain((4, seed), (4, whole), (8, r["doc_id"]), (8, r["text_hash"]))):
            before += r["tokens"] * r["copies"]
            out[r["doc_id"]] = min(max_epochs, whole + (rest > 0 and before <= rest))
    return out


@pytest.mark.parametrize(("share", "epochs"), [(0.7, 2), (1.3, 2), (2.0, 2), (0.9, 1), (1.0, 1)])
def test_mix_takes_prefixes(spark, monkeypatch, share, epochs):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    rng = random.Random(4)
    rows = [(i, " ".join("ab"[: rng.randrange(1, 3)] for _ in range(rng.choice([0, 0, 0, 3, 5, 17]))), rng.choice(["en", "de", None]), rng.choice(["src1", "src15", "new"])) for i in range(240)]
    df = spark.createDataFrame(rows + rows[:30] * 3, "doc_id long, text string, lang string, source string").repartition(5)
    out = mixing.mix(df, budget_share=share, max_epochs=epochs)
    got = out.collect()
    leaves = out.groupBy(*mixing.TREE).agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("rows"))
    total = int(sum(r["tokens"] * r["copies"] for r in got) * share)
    plan = {(r["domain"], r["lang"], r["source"]): (r["tokens"], r["budget"]) for r in mixing.budgets(leaves, total, max_epochs=epochs).collect()}
    assert {r["doc_id"]: r["epochs"] for r in got} == mixed(got, plan, epochs)
    assert max(r["epochs"] for r in got) <= epochs and {r["domain"] for r in got} == {"web", "books", "other"}


def test_mix_edges(spark, edge, nothing):
    assert mixing.mix(edge).agg(F.sum("copies")).first()[0] == edge.count() and mixing.mix(nothing).count() == 0
    again = [[tuple(r) for r in mixing.mix(edge.repartition(n)).orderBy("doc_id", "text_hash").collect()] for n in (2, 7)]
    assert again[0] == again[1]
    blank = spark.createDataFrame([(i, "", "en", "src0") for i in range(9)], "doc_id long, text string, lang string, source string")
    assert {r["epochs"] for r in mixing.mix(blank).collect()} == {0}


def test_toxicity_learns_and_leaves_clean_rows(spark, edge, nothing):
    rng = random.Random(8)
    plain = ["".join(rng.choice("aeioubcdfg") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        for _ in range(2 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["scumlord", "m0ron", "mоron", "vexquo", "vexqui", "vexqua"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    docs, own = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(docs, own)
    out = toxicity.score(docs, lexicon).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    wrong = [r["doc_id"] for r in out if (r["score"] >= 0.5) != (r["doc_id"] % 4 == 0)]
    assert sum(r["held"] for r in out) > 60 and len(wrong) <= 6
    assert {r["doc_id"] for r in out if r["held"]} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    scored = toxicity.score(edge, lexicon)
    assert scored.columns == [*edge.columns, "score"] and all(0 <= r["score"] < 0.5 for r in scored.collect())
    assert toxicity.learn(nothing, own).terms == {} and toxicity.score(nothing, toxicity.Lexicon()).count() == 0


def test_toxicity_with_few_labels_drops_nothing(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["ba", "cedo", "figu", "scumlord"]) for _ in range(20)) if i % 9 else "") for i in range(60)], "doc_id long, text string")
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]  # those that may be learned from
    for n in (1, 2, 3):
        labels = spark.createDataFrame([(i, int(k < n)) for k, i in enumerate(ids)], "doc_id long, toxic int")
        lexicon = toxicity.learn(docs, labels)
        assert lexicon == toxicity.Lexicon() and {round(r["score"], 9) for r in toxicity.score(docs, lexicon).collect()} == {toxicity.DEFAULT_SCORE}


def test_toxicity_of_a_text_without_a_match(spark):
    lexicon = toxicity.Lexicon({"vex": 1.0})
    toxicity._fit(lexicon, spark.createDataFrame([("vex a", 0), ("b vex", 0), ("c", 1), ("d e", 1)], "text string, label int"))
    assert lexicon.score(0.0, 1) < 0.5


def test_toxicity_rules():
    x = toxicity.Lexicon({"trash": 3.0, "vex*": 2.0}, {"trash bin"})
    a = x.automaton()
    for text, want in (("TRASH", 3), ("tr4sh!", 3), ("trаsh", 3), ("trashy", 0), ("a trash bin", 0), ("trash trash bin", 3), ("vexed convex", 2), ("", 0)):
        assert x.measure(a, text)[0] == want, text


def naive(lexicon, text):
    """The weight of a folded text's matches, place by place."""
    t = toxicity.fold(text)
    alone = lambda lo, hi: not (lo and t[lo - 1].isalpha()) and (hi == len(t) or not t[hi].isalpha())
    spared = {p for e in lexicon.exceptions for lo in range(len(t)) if t.startswith(e, lo) and alone(lo, lo + len(e)) for p in range(lo, lo + len(e))}
    total = 0.0
    for lo in range(len(t)):
        if lo in spared or (lo and t[lo - 1].isalpha()):
            continue
        total += max((w for k, w in lexicon.terms.items() if t.startswith(k.rstrip("*"), lo) and (k.endswith("*") or alone(lo, lo + len(k)))), default=0.0)
    return total


def test_toxicity_matches_like_a_naive_matcher():
    rng = random.Random(1)
    words = ["ab", "abc", "bab", "cab", "a", "bc", "ca"]
    for k in range(300):
        terms = {rng.choice(words) + rng.choice(["", "*"]): rng.choice([1.0, 2.0, 4.0]) for _ in range(rng.randrange(5))}
        x = toxicity.Lexicon(terms, {f"{rng.choice(words)} {rng.choice(words)}" for _ in range(rng.randrange(4))})
        text = "".join(rng.choice(["a", "b", "c", "4", " ", " ", "A", "а", "-"]) for _ in range(rng.randrange(60)))
        assert x.measure(x.automaton(), text)[0] == naive(x, text), (k, terms, x.exceptions, text)


def test_toxicity_learns_exceptions_and_keeps_all_terms(spark):
    rng = random.Random(2)
    plain = ["".join(rng.choice("aeioubcdfg") for _ in range(rng.randint(3, 7))) for _ in range(200)]
    bad = [f"vile{a}{b}{c}zed" for a in "klmnpqrst" for b in "aeiou" for c in "klm"]
    rows, labels = [], []
    for i in range(1500):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 30))]
        if i % 3 == 0:
            for _ in range(12):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        elif i % 10 == 1:
            w.insert(rng.randrange(len(w)), f"anti {bad[0]}")
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    labels += [(i, 1 - y) for i, y in labels[:40] if i % 10 != 1] + labels[:40]  # contradicted, and repeated
    lexicon = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert f"anti {bad[0]}" in lexicon.exceptions and set(bad[1:]) <= set(lexicon.terms) and lexicon.power > 0
    a = lexicon.automaton()
    assert lexicon.score(*lexicon.measure(a, f"he was anti {bad[0]} then")) < 0.5 < lexicon.score(*lexicon.measure(a, f"{bad[1]} and {bad[2]}"))


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[:200] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    odd = [(3000, None), (3001, []), (3002, [0.0] * 24), (3003, [1.0] * 23 + [float("nan")]), (3004, [1.0] * 23 + [None]), (3005, [1.0, 2.0]), (None, [1.0] * 24), (2900, x[2900].tolist())]
    df = df.unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<float>")).withColumn("rank", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 100 = 0")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in range(0, 3000, 100):
        far = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        best = sorted((d, i) for i, d in enumerate(far) if i != q)[:10]
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, 11)) and all(abs(far[i] - d) < 1e-12 for _, i, d in mine)
        assert mine == [(k, i, d) for k, (d, i) in enumerate(sorted((d, i) for _, i, d in mine), 1)]
        hits += len({i for _, i in best} & {i for _, i, _ in mine})
        total += 10
    assert set(got) == set(range(0, 3000, 100)) and hits >= 0.9 * total
    double = spark.createDataFrame([(i, (v + 1e-9 * i).tolist()) for i, v in enumerate(x[200:260].astype(np.float64))], "vec_id long, embedding array<double>")
    exact = np.array([r["embedding"] for r in double.orderBy("vec_id").collect()])
    for r in ann.nearest(double, double.where("vec_id = 0"), 3).collect():
        assert abs(r["score"] - np.sqrt(((exact[0] - exact[r["vec_id"]]) ** 2).sum())) < 1e-14
    few = df.where("vec_id in (100, 101, 102)")
    assert ann.nearest(few, few.where("vec_id = 100")).count() == 2
    assert ann.nearest(df.where("false"), df).count() == 0


def test_codes_within_a_radius():
    rng = np.random.default_rng(2)
    c = ann.Codes(rng.normal(size=(500, 40)), 5)
    codes = c.encode(rng.normal(size=(800, 40)))
    index = ann.BlockIndex(codes)
    for q in codes[:20]:
        far = np.bitwise_count(codes ^ q).sum(1)
        for radius in (0, 5, 40, 180, 230, c.bits):
            assert set(index.within(q, radius)) == set(np.flatnonzero(far <= radius))


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_dedup import components, prose

    rng = random.Random(21)
    rows, labels = [], []
    for i in range(300):
        w = prose(rng, rng.randint(30, 60)).split()
        for _ in range(5 * (i % 4 == 0)):
            w.insert(rng.randrange(len(w)), rng.choice(["vexquorum", "m0rondo", "scumlord"]))
        rows.append((i, " ".join(w), rng.choice(["en", "de"]), f"src{i % 3 * 9}", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    clean = [r for r in rows if r[0] % 4]
    for k in range(60):
        i, t, *more = rng.choice(clean)
        copy = [t.replace(" ", "  "), t + " end", t.upper(), t][k % 4]
        rows.append((1000 + k, copy, *more))
    rows += [(None, clean[0][1], "en", None, 1), (None, None, None, None, 2), (2000, "", "en", "src0", 3), clean[1], clean[1]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf, docs = f"file://{tmp_path}", spark.read.parquet(f"{tmp_path}/documents.parquet")

    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), *([docs.schema] if name != "byte bpe" else []))
        steps[name] = [tuple(r) for r in docs.collect()]
    toxic, exact, near, mix, ids = steps.values()
    assert sorted(map(repr, toxic)) == sorted(repr(r) for r in rows if r[0] is None or r[0] >= 300 or r[0] % 4)
    bare = lambda t: "".join((t or "").split())
    groups = collections.defaultdict(list)
    for r in toxic:
        groups[bare(r[1])].append(r)
    best = {k: min((-len(r[1] or ""), r[0] is None, r[0] or 0) for r in g) for k, g in groups.items()}
    assert sorted((-len(r[1] or ""), r[0] is None, r[0] or 0) for r in exact) == sorted(best.values())
    numbered = dict(enumerate(sorted(exact, key=lambda r: (r[0] is None, r[0] or 0))))
    low = components([(k, r[1]) for k, r in numbered.items()], 5, 80)
    assert sorted(map(repr, near)) == sorted(repr(numbered[k]) for k, (_, first) in low.items() if k == first)
    kept = spark.createDataFrame(near, "doc_id long, text string, lang string, source string, n_chars long")
    taken = {r["doc_id"] for r in mixing.mix(kept, budget_share=corpus_pipeline.MIX_SHARE, max_epochs=1).collect() if r["epochs"]}
    assert {r[0] for r in mix} == taken and set(mix) <= set(near) and 0.8 < sum(len(r[1] or "") for r in mix) / sum(len(r[1] or "") for r in near) < 0.95
    assert sorted((r[0] or -1, r[3]) for r in ids) == sorted((r[0] or -1, hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in mix)
    whole = corpus_pipeline.run(spark, sf)
    assert collections.Counter(r["doc_id"] for r in whole.collect()) == collections.Counter(r[0] for r in ids)


def test_pipeline_edges(spark, edge, nothing, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (edge, nothing):
        seen = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, seen, f"file://{tmp_path}")
            n = out.count()
            if name == "byte bpe":
                assert n == seen.count()
                break
            assert out.columns == docs.columns and columns_as_before(docs, out) and n <= seen.count() and (n > 0) == (docs is edge)
            seen = spark.createDataFrame(out.collect(), docs.schema)
