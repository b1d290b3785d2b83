"""Exact, near, substring and line dedup against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import exact_dedup, line_dedup, near_dedup, substring_dedup
from sensorloom.llm.mph import MinimalPerfectHash
from tests.llm.conftest import columns_as_before


def prose(rng, n):
    return " ".join("".join(rng.choice(["ka", "to", "mi", "ren", "sul", "pa"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    f = MinimalPerfectHash(keys)
    assert sorted(f.lookup(keys).tolist()) == list(range(n))
    others = f.lookup(keys * np.uint64(3) + np.uint64(2))
    assert ((others >= -1) & (others < max(n, 1))).all()
    with pytest.raises(ValueError):
        MinimalPerfectHash(np.array([5, 5], np.uint64))


def test_exact(edge, nothing):
    got = exact_dedup.resolve(edge).collect()
    rows = edge.select("doc_id", "text").collect()
    bare = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t or "")
    groups = collections.defaultdict(list)
    for r in rows:
        groups[hashlib.sha256(bare(r["text"]).encode()).hexdigest()].append(r)
    assert len(got) == len(rows)
    for sha, members in groups.items():
        best = min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        own = [g for g in got if g["text_sha256"] == sha]
        assert {(g["keep_id"], g["group_size"]) for g in own} == {(best["doc_id"], len(members))}
        assert sum(g["kept"] for g in own) == 1
    assert exact_dedup.resolve(nothing).count() == 0
    kept = exact_dedup.keep_one(edge)
    assert kept.columns == edge.columns and kept.count() == len(groups) and exact_dedup.keep_one(nothing).count() == 0
    assert columns_as_before(edge, kept)


def test_exact_keeps_one_of_rows_alike(spark):
    rows = [(1, "a b", k) for k in range(50)] + [(1, "ab", 50), (None, "c", 51), (None, "c", 52), (2, "a  b", 53)]
    kept = exact_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _own_sha long").repartition(6)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "c"), (2, "a  b")]


def test_exact_history_finds_members(spark):
    old, new = (spark.createDataFrame(x, "doc_id long, text string") for x in ([(1, "a"), (2, "b")], [(3, "a"), (4, "c"), (5, " c")]))
    index = exact_dedup.build_index(exact_dedup.groups(exact_dedup.digests(old)), 2)
    out = {r["digest"].hex(): (r["member"], r["n"]) for r in exact_dedup.assign(exact_dedup.groups(exact_dedup.digests(new)), index, 2).collect()}
    assert out == {hashlib.sha256(b"a").hexdigest(): (True, 2), hashlib.sha256(b"c").hexdigest(): (False, 2)}


def components(rows, size=3, per_cent=85):
    """doc_id: (set size, smallest linked doc_id), from all pairs."""
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w)} if 0 < len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= per_cent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("rule", [near_dedup.CONTRACT, near_dedup.FIVE_WORDS])
def test_near_against_all_pairs(spark, monkeypatch, rule):
    rng, texts = random.Random(2), []
    for _ in range(25):
        base = prose(rng, rng.choice([2, 5, 60, 300])).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(8)):
            copy = list(base)
            for _ in range(rng.randrange(max(1, len(copy) // 25) + 1)):
                copy[rng.randrange(len(copy))] = rng.choice(["zap", "Zip"])
            texts.append(rng.choice([" ", "\n"]).join(copy))
    chain = prose(rng, 200).split()  # each links with the next, the ends don't
    for i in range(0, 60, 5):
        texts.append(" ".join(["q%d" % k for k in range(i)] + chain[i:]))
    rows = [(i, t) for i, t in enumerate(texts + ["", " ", "a", "A", "a b"])]
    monkeypatch.setattr(near_dedup, "BLOCK", 8)  # large buckets go over many cells
    monkeypatch.setattr(near_dedup, "CELL_BYTES", 1 << 14)  # and pairs over many groups
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.link(df, rule=rule).collect()}
    want = components(rows, rule.shingle, rule.per_cent)
    assert got == want
    if rule is near_dedup.FIVE_WORDS:
        assert sorted(r["doc_id"] for r in near_dedup.keep_one(df).collect()) == sorted({low for _, low in want.values()})


def test_near_edges(edge, nothing):
    out = near_dedup.link(edge).collect()
    assert len(out) == edge.count()
    assert all(r["kept"] and r["n_shingles"] == 0 and r["component_id"] == r["doc_id"] for r in out if r["doc_id"] in (1, 2, 3))
    assert {r["component_id"] for r in out if r["doc_id"] in (6, 7)} == {6}
    assert near_dedup.link(nothing).count() == 0 and near_dedup.keep_one(nothing).count() == 0
    kept = near_dedup.keep_one(edge)
    assert kept.columns == edge.columns and columns_as_before(edge, kept)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert {1, 2, 3, 6} <= set(ids) and 7 not in ids and len(ids) == len(set(ids))


def test_near_keeps_one_row_whatever_the_ids(spark):
    rng = random.Random(12)
    base = prose(rng, 80)
    other = prose(rng, 80)
    rows = [(5, base), (5, base + " end"), (5, base.upper()), (None, base), (None, other), (None, other), (None, other + " x"), (7, "")] + [(7, "")]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 5, 7, 7]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 63, 900, dtype=np.uint64), rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    assert (np.maximum(near_dedup.sketch(a), near_dedup.sketch(b)) == near_dedup.sketch(np.concatenate([a, b]))).all()
    one = np.array([900]), np.array([900])
    for share, want in ((0.95, True), (0.5, False)):
        c = np.concatenate([a[: int(900 * share)], rng.integers(0, 1 << 63, 900 - int(900 * share), dtype=np.uint64)])
        assert near_dedup.may_link(near_dedup.CONTRACT, near_dedup.sketch(a)[None], near_dedup.sketch(c)[None], *one)[0] == want


def test_components(spark):
    links = [(b"%03d" % i, b"%03d" % (i + 1)) for i in range(40)] + [(b"900", b"%03d" % i) for i in range(901, 960)] + [(b"500", b"500")]
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in links], "a binary, b binary")
    got = {bytes(r["key"]): bytes(r["root"]) for r in near_dedup.components(df).collect()}
    assert got == {b"%03d" % i: b"000" for i in range(1, 41)} | {b"%03d" % i: b"900" for i in range(901, 960)}
    assert near_dedup.components(df.where("false")).count() == 0


def test_cuts_come_back_after_an_insertion():
    rng = random.Random(1)
    text = prose(rng, 2000).encode()
    cut = lambda t: {t[a:b] for e in [substring_dedup.cuts(np.frombuffer(t, np.uint8)).tolist()] for a, b in zip([0, *e[:-1]], e)}
    a, b = cut(text), cut(text[:3000] + b"inserted" + text[3000:])
    assert b"".join(text[x:y] for e in [substring_dedup.cuts(np.frombuffer(text, np.uint8)).tolist()] for x, y in zip([0, *e[:-1]], e)) == text
    assert len(a - b) <= 3 and max(map(len, a)) <= substring_dedup.MAX_BYTES


def test_substring_finds_passages(spark, edge, nothing):
    rng = random.Random(4)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, 80) + (f" {passage} " if i in (3, 8, 20) else " ") + prose(rng, 80)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spans = substring_dedup.repeated_spans(df).collect()
    assert sorted((s["doc_id"], s["keep_doc_id"]) for s in spans) == [(8, 3), (20, 3)]
    text = dict(rows)
    for s in spans:
        assert text[s["doc_id"]].encode()[s["start"] : s["start"] + s["n_bytes"]].decode() in passage
    cleaned = {r["doc_id"]: r for r in substring_dedup.clean(df).collect()}
    assert cleaned[3]["text"] == text[3] and len(cleaned[8]["text"].encode()) == len(text[8].encode()) - cleaned[8]["n_removed"] and cleaned[8]["n_removed"] > 200
    assert substring_dedup.repeated_spans(nothing).count() == 0
    out = substring_dedup.clean(edge)
    assert out.columns == [*edge.columns, "n_removed"] and out.count() == edge.count() and columns_as_before(edge, out)


def test_substring_finds_every_short_passage(spark):
    rng = random.Random(7)
    passages = [prose(rng, 51) for _ in range(300)] + [" ".join([f"{prose(rng, 1)}{i:03d}"] * 51) for i in range(40)]
    rows = [(i, f"{prose(rng, rng.randint(1, 90))} {passages[i // 2]} {prose(rng, rng.randint(1, 90))}") for i in range(2 * len(passages))]
    spans = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    # passages of 51 very short words may be missed: their ends take most of them
    assert len({s["doc_id"] for s in spans} & set(range(1, len(rows), 2))) >= 0.98 * len(passages)


def spans_of(rows, min_words, min_core):
    """(doc_id, start, size) of the spans, chunk by chunk in plain Python."""
    first, out = {}, set()
    for i, t in rows:
        raw, found = t.encode(), []
        ends = substring_dedup.cuts(np.frombuffer(raw, np.uint8)).tolist()
        for a, b in zip([0, *ends[:-1]], ends):
            at = first.setdefault(raw[a:b], (i, a))
            starts = [k for k in range(a, b) if raw[k : k + 1].strip() and (k == 0 or not raw[k - 1 : k].strip())]
            found.append((a, b, None if at == (i, a) else at, len(starts)))
        here = {}
        for a, _, at, _ in found:
            here.setdefault(at, a)
        runs, run = [], []
        for c in [*found, (None, None, None, 0)]:
            if c[2] is None:
                runs.append(run)
                run = []
            else:
                run.append(c)
        for run in runs:
            words, reach = collections.Counter(), {}
            for a, _, at, n in run:
                words[at[0], here[at] - at[1]] += n
                reach[at[0], here[at] - at[1]] = a
            far, part = -1, []
            for a, b, at, n in [*run, (None, None, None, 0)]:
                if at is not None:
                    k = at[0], here[at] - at[1]
                    far = max(far, reach[k]) if words[k] >= min_core else far
                if at is not None and a <= far:
                    part.append((a, b, n))
                elif part:
                    if sum(n for *_, n in part) >= min_words:
                        out.add((i, part[0][0], part[-1][1] - part[0][0]))
                    part = []
    return out


@pytest.mark.parametrize(("min_words", "min_core"), [(0, 0), (24, 16), (10, 8)])
def test_substring_against_brute_force(spark, min_words, min_core):
    rng = random.Random(6)
    parts = [prose(rng, n) for n in (40, 40, 40, 3, 4, 5, 12, 30)] + ["to " * 40, "pa mi " * 30]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(9)))) for i in range(40)]
    got = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), min_words=min_words, min_core=min_core).collect()
    assert {(r["doc_id"], r["start"], r["n_bytes"]) for r in got} == spans_of(rows, min_words, min_core)


def test_substring_leaves_chance_repeats(spark):
    rng = random.Random(11)
    phrases = [prose(rng, 8) for _ in range(60)]  # each repeated, never two of them in the same order
    rows = [(i, p) for i, p in enumerate(phrases)] + [(100 + i, " ".join(rng.sample(phrases, 12))) for i in range(20)]
    spans = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert not spans


def repeated_lines(rows, w):
    """(doc_id, line) deleted: all lines of all common runs with an earlier place, straight from lists.

    A run counts if it has ``w`` lines or holds a long one; blank lines are no lines.
    """
    bare = [(i, [(k, x.strip(" \t\n\x0b\x0c\r")) for k, x in enumerate((t or "").split("\n"))]) for i, t in rows]
    docs = [(i, [(k, x) for k, x in ls if x]) for i, ls in bare]
    long = lambda x: len(x.split()) >= line_dedup.LONG_WORDS or len(x) >= line_dedup.LONG_CHARS
    places, out = collections.defaultdict(list), set()
    for d, (_, ls) in enumerate(docs):
        for p, (_, x) in enumerate(ls):
            places[x].append((d, p))
    for d, (i, ls) in enumerate(docs):
        for p, (_, x) in enumerate(ls):
            for e, q in places[x]:
                if (e, q) >= (d, p):
                    break
                other, n = docs[e][1], 0
                while p + n < len(ls) and q + n < len(other) and ls[p + n][1] == other[q + n][1]:
                    n += 1
                if n >= w or any(long(y) for _, y in ls[p : p + n]):
                    out |= {(i, k) for k in range(ls[p][0], ls[p + n - 1][0] + 1)}
    return out


def test_lines_against_brute_force(spark, edge, nothing):
    rng = random.Random(9)
    lines = [prose(rng, 4) for _ in range(40)] + [prose(rng, 30) for _ in range(5)] + ["", "  "]
    runs = [[rng.choice(lines) for _ in range(7)] for _ in range(4)]
    rows = []
    for i in range(30):
        text = [prose(rng, 5) for _ in range(rng.randrange(9))]
        for _ in range(rng.randrange(3)):
            text += rng.choice(runs) + [rng.choice(lines)]
        rows.append((i, "\n".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    runs = line_dedup.repeated_lines(df).collect()
    got = {(r["doc_id"], r["first_line"] + k) for r in runs for k in range(r["n_lines"])}
    assert got == repeated_lines(rows, line_dedup.WINDOW)
    cleaned = {r["doc_id"]: r for r in line_dedup.clean(df).collect()}
    for i, t in rows:
        assert cleaned[i]["text"] == "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in got)
    assert line_dedup.repeated_lines(nothing).count() == 0
    out = line_dedup.clean(edge)
    assert out.columns == [*edge.columns, "n_deleted"] and out.count() == edge.count() and columns_as_before(edge, out)


@pytest.mark.parametrize("n_lines", [1, 2, 3])
def test_lines_find_passages_of_few_lines(spark, n_lines):
    rng = random.Random(n_lines)
    own = lambda: [prose(rng, rng.randint(3, 30)) for _ in range(rng.randint(2, 6))]
    rows, want = [], set()
    for i in range(100):
        passage = [prose(rng, -(-51 // n_lines)) for _ in range(n_lines)]
        rows.append((2 * i, "\n".join(own() + passage + own())))
        before = own()
        rows.append((2 * i + 1, "\n".join(before + passage + own())))
        want |= {(2 * i + 1, len(before) + k) for k in range(n_lines)}
    runs = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = {(r["doc_id"], r["first_line"] + k) for r in runs for k in range(r["n_lines"])}
    assert want <= got


def test_lines_long_without_spaces_and_short_ones_alone(spark):
    rng = random.Random(5)
    long, pair, three = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(170)), "so it\ngoes on", "one\ntwo\n\nthree"
    rows = [(i, "\n".join([prose(rng, 5), x, prose(rng, 6)])) for i, x in enumerate([long, pair, three] * 20)]
    runs = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["first_line"], r["n_lines"]) for r in runs} == {(i, 1, 1 if i % 3 == 0 else 4) for i in range(3, 60) if i % 3 != 1}


def test_line_that_documents_share_stays(spark):
    rng = random.Random(15)
    rows = [(i, "\n".join([*[prose(rng, 6) for _ in range(rng.randrange(1, 9))], "Read more", *[prose(rng, 6) for _ in range(rng.randrange(1, 9))]])) for i in range(40)]
    assert line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
