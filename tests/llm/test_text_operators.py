"""Each operator on small fixtures against brute force: nulls, empty and long texts, ties, repeats, clashing names, empty tables."""

import hashlib
import math
import pathlib
import random
import re
import textwrap
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from logloom.llm import components, decontamination, embedding_dedup, jaccard, language_id, licenses, packing, secrets, suffix_dedup, token_counts, toxicity  # noqa: E402
from logloom.llm.queries import vocabulary  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, row long, key string, grp string, t1 long"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def prose(seed, n, alphabet="aeioutnrs"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(1, 7))) for _ in range(n))


def texts():
    a, b = prose(1, 300), prose(2, 200)
    words = a.split()
    near = words[:]
    near[40] = "changed"
    return [
        None, "", " ", "one", "two  words", a, a, " ".join(near), " ".join(words[:150]) + " " + b, b + "\n\n" + b, "x" * 1500, prose(3, 4000),
        "Ünïcode ſ İ 中文字   tab\tend \n\n  spaces  <|endoftext|> after<|endoftext|>", "A B c D", "a b C d", "\x00\x01 0123", "it's we'll I'd",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, 7, "k", "g", 1) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[5]], SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts())}


@pytest.mark.parametrize("head", [1 << 18, 5])
def test_token_counts(docs, empty, ids, head):
    rows = token_counts.count_tokens(docs, vocabulary(), 1024, head).collect()
    assert len(rows) == len(texts()) + 1
    for r in rows:
        text = texts()[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), len(ids[r["doc_id"]]), len(ids[r["doc_id"]]) > 1024)
    assert token_counts.count_tokens(empty, vocabulary()).count() == 0


def test_packing(docs, empty, ids):
    rows = packing.pack(docs, vocabulary(), 300).collect()
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, own in ids.items():
        whole = [*own, 0]
        copies = 2 if i == 5 else 1
        assert sum(r["length"] for r in pieces[i]) == copies * len(whole)
        for r in pieces[i]:
            part = whole[r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(array("I", part).tobytes()) == r["ids_crc32"]
            assert r["length"] == 300 or r["piece"] == 0
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 300
    assert packing.pack(empty, vocabulary()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan(seed):
    r = random.Random(seed)
    sizes = Counter(min(2048, int(r.lognormvariate(6, 1)) + 1) for _ in range(4000))
    runs = packing.plan(dict(sizes), 2048)
    placed, used = Counter(), Counter()
    for size, lo, hi, first, _ in runs:
        placed[size] += hi - lo
        for k in range(hi - lo):
            used[first + k] += size
    assert placed == sizes and max(used.values()) <= 2048
    assert len(used) <= 1.02 * math.ceil(sum(s * n for s, n in sizes.items()) / 2048) + 1


def test_decontamination(spark, docs, empty):
    a = texts()[5].split()
    items = [(1, " ".join(a[10:40])), (2, "one"), (10, "nowhere to be found"), (3, None), (4, "  "), (2, "one"), (5, " ".join(a[20:33]).upper()), (None, " ".join(a[50:70])), (None, "two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = defaultdict(set)
    for i, t in items:
        w = word.findall(lower(t or ""))
        for k in range(max(1, len(w) - 12) if w else 0):
            wins[tuple(w[k : k + 13])] |= {str(i)} - {"None"}  # an item without an id hits, but has no name
    for r in decontamination.find_contamination(docs, bench).collect():
        w = word.findall(lower(texts()[r["doc_id"]] or ""))
        hit, found = [False] * len(w), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if (own := wins.get(tuple(w[k : k + size]))) is not None:
                    found |= own
                    hit[k : k + size] = [True] * size
        n = sum(hit)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), n, len(found), sha, n > 0 and 20 * n >= len(w))
    rejected = {r["doc_id"] for r in decontamination.find_contamination(docs, bench).collect() if r["contaminated"]}
    clean = decontamination.only_clean(docs, bench)
    assert rejected and clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == set(range(len(texts()))) - rejected
    assert decontamination.find_contamination(empty, bench).count() == 0
    assert not decontamination.find_contamination(docs, bench.limit(0)).filter("contaminated").count()


def test_parts_of_a_benchmark():
    items = [(str(i), f"w{i} x y z".encode()) for i in range(10)]
    parts = list(decontamination.tables(iter(items), 13, part_windows=3))
    assert len(parts) == 4
    spans, found = decontamination.occurrences([b"w3 x y z w8 x y z".split()], [lambda p=p: p for p in parts])
    assert decontamination.covered(spans[0]) == 8 and found[0] == {"3", "8"}


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


@pytest.mark.parametrize(("size", "num", "den"), [(4, 85, 100), (5, 4, 5)])
def test_jaccard(spark, docs, empty, size, num, den):
    r = random.Random(size)
    base = prose(9, 60).split()
    variants = []
    for _ in range(60):
        w = base[:]
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice("pqxyz")
        variants.append(" ".join(w))
    all_texts = dict(enumerate(texts())) | {100 + i: t for i, t in enumerate(variants)}
    more = spark.createDataFrame([(100 + i, t, None, 7, "k", "g", 1) for i, t in enumerate(variants)], SCHEMA)
    sets = {i: shingles(t, size) for i, t in all_texts.items()}
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                least[b] = a
    rows = jaccard.join_similar(docs.union(more), size, num, den).collect()
    assert len(rows) == len(all_texts) + 1
    for r in rows:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]))
    assert jaccard.join_similar(empty).count() == 0


def test_jaccard_in_blocks(spark, monkeypatch):
    """Large groups, in blocks of 3 members, rounds of a few pairs and small hands of signatures."""
    for name, value in (("BLOCK", 3), ("PAIRS", 7), ("HELD", 60), ("SEEN", 5)):
        monkeypatch.setattr(jaccard, name, value)
    r = random.Random(8)
    rows = []
    for k in range(3):
        base = prose(20 + k, 60).split()
        for _ in range(14):
            w = base[:]
            for _ in range(r.randint(0, 4)):
                w[r.randrange(60)] = r.choice("pqxyz")
            rows.append((len(rows), " ".join(w)))
    sets = [shingles(t, 4) for _, t in rows]
    least = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    found = jaccard.join_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 85, 100).collect()
    assert {x["doc_id"]: x["component_id"] for x in found} == dict(enumerate(least)) and 3 < len(set(least)) < 30


@pytest.mark.parametrize(("num", "den"), [(85, 100), (4, 5), (1, 2), (1, 1)])
def test_similar_sets_share_a_signature(num, den):
    r, bands = np.random.default_rng(num), jaccard.Bands(num, den)
    test = jaccard.may_be_similar(num, den)
    for n in [*range(1, 40), 100, 333, 1000, 5000]:
        for _ in range(6):
            pool = np.unique(r.integers(0, 1 << 63, 3 * n + 8, dtype=np.uint64))
            both = int(r.integers(max(1, n // 2), n + 1))
            more = int((den * both / num - both) + 1e-9)  # elements that one side or the other may have besides
            left = int(r.integers(0, more + 1))
            r.shuffle(pool)
            a, b = np.sort(pool[: both + left]), np.sort(np.concatenate([pool[:both], pool[both + left : both + more]]))
            shared = len(np.intersect1d(a, b))
            assert den * shared >= num * (len(a) + len(b) - shared)
            assert np.intersect1d(jaccard.signatures(a, bands), jaccard.signatures(b, bands)).size
            assert test(jaccard.sketch(a), jaccard.sketch(b), len(a), len(b))


def test_packed_signatures():
    r = np.random.default_rng(3)
    held = [r.integers(0, 1 << 63, k, dtype=np.uint64) for k in (0, 5, 700, 1)]
    held[1][:3] = held[2][:3]
    found = defaultdict(list)
    for bucket, base, low, own in jaccard.dealt(held, 7, 100):
        sigs = np.frombuffer(low, np.uint8).reshape(-1, 5)
        sigs = np.column_stack([sigs, np.zeros((len(sigs), 3), np.uint8)]).view("<u8").ravel()
        found[bucket] += zip(sigs.tolist(), (base + np.frombuffer(own, "<u2").astype(np.int64)).tolist(), strict=True)
    assert set(found) <= set(range(7)) and sum(map(len, found.values())) == sum(map(len, held))
    pairs = []
    for own in found.values():
        sigs, ids = (np.array(x) for x in zip(*own, strict=True))
        grp, members = jaccard.shared_groups(sigs.astype(np.uint64), ids)
        pairs += [tuple(sorted(members[grp == g].tolist())) for g in np.unique(grp)]
    assert set(pairs) == {(101, 102)}  # equal groups once in each bucket


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (3, None)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def without_repeats(data, length=400):
    seen = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize(("group", "span"), [(20_000, 1 << 19), (1, 700)])
def test_suffix_dedup(docs, empty, group, span, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "SPAN", span)
    data = [(t or "").encode() for t in texts()]
    data.append(data[5])
    expected = {}
    for i, (t, gone) in enumerate(zip(data[:-1], without_repeats(data), strict=False)):
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        expected[i] = (len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())
    rows = suffix_dedup.remove_repeats(docs).collect()
    assert len(rows) == len(data)
    for r in rows:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected[r["doc_id"]]
    if group == 1:
        assert suffix_dedup.remove_repeats(empty).count() == 0


def test_index_opened_again(spark, tmp_path):
    shared = [prose(50 + i, 150) for i in range(3)]
    parts = [[prose(100 * k + i, 60) + " " + shared[(i + k) % 3] + " " + prose(100 * k + i + 50, 60) for i in range(k % 2 + 1)] for k in range(5)]
    data = [t.encode() for p in parts for t in p]
    frames = [suffix_dedup.keyed(spark.createDataFrame([(k * 10 + i, t) for i, t in enumerate(p)], "doc_id long, text string")) for k, p in enumerate(parts)]
    path, ranks = str(tmp_path / "index"), []
    for f in frames:
        index = suffix_dedup.LogIndex(spark, path, 3)
        index.add(suffix_dedup.suffixes(f, 400))
        for name in [*index.state["levels"].values(), *index.state["hits"]]:
            spark.sql(f"DROP TABLE IF EXISTS loom_{name}")  # the next one knows only what the folder holds
        ranks.append(sorted(int(r) for r in index.state["levels"]))
    assert ranks == [[0], [1], [0, 1], [2], [0, 2]]
    opened = suffix_dedup.LogIndex(spark, path)
    assert opened.state["batches"] == 5 and opened.state["buckets"] == 3
    docs = frames[0]
    for f in frames[1:]:
        docs = docs.union(f)
    found = defaultdict(list)
    ids = {(r["t1"], r["t2"]): bytes(r["text"]) for r in docs.collect()}
    for r in suffix_dedup.repeated_spans(opened.matches(), docs, 400, suffix_dedup.Folder(spark)).collect():
        found[ids[r["t1"], r["t2"]]].append((r["start"], r["stop"]))
    for t, gone in zip(data, without_repeats(data), strict=True):
        own = np.zeros(len(t), bool)
        for a, z in found[t]:
            own[a:z] = True
        assert gone.any() and (own == gone).all()
    plan = opened.levels[0].select("p1", "p2").hint("merge").join(opened.levels[2].select("p1", "p2"), ["p1", "p2"], "left_semi")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    opened.drop()


def test_embeddings(spark):
    r = np.random.default_rng(1)
    rows = []
    for label in ("a", "b"):
        base = r.normal(size=(30, 16))
        for i, v in enumerate(base):
            for k in range(1 + 6 * (i == 0)):
                rows.append((len(rows), (v + r.normal(size=16) * 0.02 * k).tolist(), label))
    rows += [(1000, rows[0][1], "a"), (1001, [2 * x for x in rows[1][1]], "a"), (1002, rows[0][1], None), (1003, None, "a"), (1004, [0.0] * 16, "a"), (1005, [math.nan] * 16, "a"), (1006, [1.0, None], "a"), (1007, [1e300] * 16, "b"), (1007, [1e300] * 16, "b"), (1008, [], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")

    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v) / max(abs(y) for y in v)
        return x / np.linalg.norm(x)

    units = [unit(v) if label else None for _, v, label in rows]
    near = [[a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and i != j and a @ b >= 0.98 for j, b in enumerate(units)] for i, a in enumerate(units)]
    comp = list(range(len(rows)))
    for _ in rows:
        comp = [min([comp[i], *(comp[j] for j in range(len(rows)) if near[i][j])]) for i in range(len(rows))]
    expected = Counter((rows[i][0], sum(near[i]), min(rows[j][0] for j in range(len(rows)) if comp[j] == comp[i])) for i in range(len(rows)))
    found = embedding_dedup.link_vectors(df).collect()
    assert Counter((x["vec_id"], x["n_links"], x["component_id"]) for x in found) == expected
    assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in found)
    assert embedding_dedup.link_vectors(df.limit(0)).count() == 0


def test_families_of_near_copies(spark):
    r = np.random.default_rng(2)
    a, b = np.linalg.qr(r.normal(size=(32, 2)))[0].T
    centres = [a, 0.985 * a + math.sqrt(1 - 0.985**2) * b]
    v = np.array([c + r.normal(size=32) * 0.001 for c in centres for _ in range(100)])
    v /= np.linalg.norm(v, axis=1)[:, None]
    s = v @ v.T
    assert s[:100, :100].min() > 0.9999 and 0.98 < s[:100, 100:].min() and s[:100, 100:].max() < 0.99
    df = spark.createDataFrame([(i, x.tolist(), "a") for i, x in enumerate(v)], "vec_id long, embedding array<double>, label string")
    found = embedding_dedup.link_vectors(df).collect()
    assert sorted((x["vec_id"], x["n_links"], x["component_id"]) for x in found) == [(i, 199, 0) for i in range(200)]


def test_rare_near_copies(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(3000, 128))
    v /= np.linalg.norm(v, axis=1)[:, None]
    for i in range(10):  # the only links: pairs (i, 2990 + i)
        w = v[2990 + i] - v[2990 + i] @ v[i] * v[i]
        v[2990 + i] = 0.6 * v[i] + 0.8 * w / np.linalg.norm(w)
    s = np.triu(v @ v.T, 1)
    assert [tuple(x) for x in np.argwhere(s >= 0.55).tolist()] == [(i, 2990 + i) for i in range(10)]
    df = spark.createDataFrame([(i, x.tolist(), "a") for i, x in enumerate(v)], "vec_id long, embedding array<double>, label string")
    found = embedding_dedup.link_vectors(df, threshold=0.55).filter("n_links > 0").collect()
    assert sorted((x["vec_id"], x["n_links"], x["component_id"]) for x in found) == sorted((j, 1, i) for i in range(10) for j in (i, 2990 + i))


def test_cross_parsing():
    samples = {"aa": b" abab cc ab ", "bb": b" xyxy zz "}
    p = language_id.Parser(samples)

    def count(text, sample):
        n, at = 1, 0
        for i in range(1, len(text) + 1):
            if i - at > 1 and text[at:i] not in sample or i - at == 1 and text[at:i] not in sample:
                n, at = n + 1, i if text[i - 1 : i] not in sample else i - 1
        return n

    texts_ = [b" abab ", b" xyz ab cc ", b"", b" zz zz xyxy abab "]
    found = p.phrases(texts_)
    for k, lang in enumerate(p.langs):
        for i, t in enumerate(texts_):
            assert found[k, i] == (count(t, samples[lang]) if t else 0)


def test_language_id(spark, docs, empty):
    samples = {"en": language_id.normalise(prose(1, 2000, "theandr")), "de": language_id.normalise(prose(2, 2000, "schuimö"))}
    rows = spark.createDataFrame([(0, prose(5, 30, "theandr")), (1, prose(6, 30, "schuimö")), (2, "123 !"), (3, None), (4, "—")], "doc_id long, text string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(rows, samples).collect()}
    assert [found[i][0] for i in range(5)] == ["en", "de", "und", "und", "und"] and all(0 <= s <= 1 for _, s in found.values())
    assert language_id.identify(docs, samples).columns == ["doc_id", "lang_pred", "score"]
    kept = language_id.only_identified(rows, samples)
    assert kept.columns == rows.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1]
    assert language_id.only_identified(docs, samples).columns == docs.columns
    assert language_id.identify(empty, samples).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(rows, {}).collect()} == {"und"}


def test_toxicity(spark, docs, empty):
    r = random.Random(4)
    y = [i % 4 == 0 for i in range(240)]
    own = [prose(100 + i, 40) + (" vileword" + r.choice("abc") if bad else "") for i, bad in enumerate(y)]
    model = toxicity.train(own, [int(b) for b in y], [i % 5 == 1 for i in range(240)], {"xx": b" some text "})
    test = [prose(900 + i, 40) + (" vileword" + r.choice("def") if i % 2 else "") for i in range(40)]
    rows = spark.createDataFrame([*enumerate(test), (50, None), (51, "")], "doc_id long, text string")
    found = {x["doc_id"]: x for x in toxicity.classify(rows, model).collect()}
    right = sum(found[i]["predicted"] == i % 2 for i in range(40))
    assert right >= 38 and found[50]["score"] == found[51]["score"] and found[50]["predicted"] == 0
    assert toxicity.classify(docs, model).count() == docs.count() and toxicity.classify(empty, model).count() == 0


def test_training_carries_the_scores():
    r = random.Random(5)
    y = [i % 3 == 0 for i in range(300)]
    own = [prose(i, 40) + (f" {prose(i, 1)} vile" + r.choice("abc") if bad else "") for i, bad in enumerate(y)]
    test = [toxicity.words_of(prose(900 + i, 40) + (" viled" if i % 2 else "")) for i in range(60)]

    def right(model):
        z = model.logits(test, toxicity.Vectors(model.emb))
        return sum((z > np.median(z)) == (np.arange(60) % 2 == 1))

    trained = toxicity.fit(own, [int(b) for b in y])
    assert right(trained) >= 57 > 45 > right(toxicity.fit(own, [int(b) for b in y], epochs=0))
    z = trained.logits(test, toxicity.Vectors(trained.emb))
    for k in range(len(toxicity.WIDTHS)):  # each width takes part
        part = trained.out.copy()
        part[k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS] = 0
        less = toxicity.Model(trained.emb, trained.filters, trained.bias, part, trained.out_bias)
        assert np.abs(less.logits(test, toxicity.Vectors(trained.emb)) - z).max() > 0.1


def test_sample_of_labels(spark):
    docs = spark.createDataFrame([(i, "x" * (1000 if i == 3 else 10), None) for i in range(40)] + [(41, None, None)], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, i % 4 // 3, 7) for i in range(42)] + [(5, 0, 7), (None, 1, 7), (6, 2, 7)], "doc_id long, toxic int, text int")
    texts_, y, held = toxicity.sample(docs, labels, "doc_id % 5 = 1", {1: 6, 0: 9}, 500)
    assert len(texts_) == len(y) == len(held) and sum(y) in (5, 6) and y.count(0) == 9 and all(len(t) == 10 for t in texts_)  # the long text is passed over
    assert toxicity.sample(docs, labels.limit(0), "true") == ([], [], [])


def test_sample_of_languages(spark):
    rows = [(i, "en", f"hello number {i} here") for i in range(30)] + [(100, "de", "ü" * 900), (101, "de", "zwei"), (102, "fr", "é" * 900), (103, None, "nothing")]
    found = language_id.sample_texts(spark.createDataFrame(rows, "doc_id long, lang string, text string").filter("lang is not null"), 10, 200)
    assert set(found) == {"en", "de", "fr"} and len(found["en"]) <= 200 and found["de"] == b" zwei " and len(found["fr"]) > 900
    kept = language_id.only_identified(spark.createDataFrame(rows + [(104, None, "12")], "doc_id long, lang string, text string"), {})
    assert kept.count() == len(rows)  # nothing was learned: what has a letter stays


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.labelled_findings(spark))


def test_secrets(spark, empty, forest):
    sha = hashlib.sha1(b"x").hexdigest()
    rows = [
        (0, f'first token = "{sha}" then AKIA{"Q7ZX" * 4} end', "z"), (1, "call 4929123412341234 now", "z"), (2, None, "z"), (3, "", "z"), (4, f"commit {sha} merged", "z"),
        (0, f'first token = "{sha}" then AKIA{"Q7ZX" * 4} end', "z"), (5, "\x01\x02 plain", "z"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    found = secrets.scan(df, forest).collect()
    by = defaultdict(list)
    for x in found:
        assert rows[[r[0] for r in rows].index(x["doc_id"])][1][x["start"] : x["start"] + x["length"]] == x["candidate"]
        by[x["doc_id"]].append(x["is_secret"])
    assert by == {0: [True] * 4, 1: [False], 4: [False]}
    clean = secrets.redact(df, forest)
    assert clean.columns == df.columns and clean.count() == len(rows)
    masked = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert masked == dict((r[0], r[1]) for r in rows) | {0: 'first token = "[SECRET]" then [SECRET] end'}
    assert secrets.scan(empty, forest).count() == 0 and secrets.redact(empty, forest).count() == 0


def test_licenses(spark, empty):
    mit = licenses.KNOWN[0][1]
    rows = [(0, "Copyright (c) 2020 A\n\n" + mit.upper()), (1, "text\nReleased under the MIT Licence!\n"), (2, None), (3, ""), (4, mit + " extra"), (1, "text\nReleased under the MIT Licence!\n")]
    found = licenses.scan(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, digest string")).collect()
    assert sorted((r["doc_id"], r["license_id"], r["n_notices"], r["notice_ids"]) for r in found if r["doc_id"] != 2) == [(0, "MIT", 0, ""), (1, None, 1, "MIT"), (1, None, 1, "MIT"), (3, None, 0, ""), (4, None, 0, "")]
    assert licenses.scan(empty).count() == 0


def test_wrapped_and_long_licenses(spark):
    short = {i: t for i, t in reversed(licenses.KNOWN) if len(t) > 400}
    rows = [(i, f"{notice}\n\n" + "\n\n".join(textwrap.fill(p, w) for p in t.split("\n\n"))) for i, t in short.items() for notice in ("Copyright (c) 2020 A", "Copyright The Authors", "© A") for w in range(55, 81)]
    assert any(re.search("(?mi)^copyright (notice|holder)", t) for _, t in rows)
    common = pathlib.Path("/usr/share/common-licenses")
    if common.is_dir():
        text = {i: (common / f).read_text() for i, f in {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0"}.items()}
        rows += [*text.items(), ("Apache-2.0", text["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 A"))]
    found = licenses.scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["license_id"] for r in found} == {k: i for k, (i, _) in enumerate(rows)}


def test_secrets_with_compound_names(spark, forest):
    github, aws = "ghp_" + "aZ3kQ9xW7bT2" * 3, "wJalrXUtnFEMIK7MDENGbPxRfiCYzKq81LmNoPqs"
    values = ["S3cr3t!pw", "correcthorsebattery", "abcdefghijklmnopqrst", github, aws, "ghp_" + "bY4mR8vU6cN1" * 3]
    texts_ = ['DB_PASSWORD = "S3cr3t!pw"', "client_secret: correcthorsebattery", '{"access_token": "abcdefghijklmnopqrst"}', f"GITHUB_TOKEN={github} more", f"AWS_SECRET_ACCESS_KEY={aws} more", f"GITHUB_PAT={values[5]} more"]
    df = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    found = {(r["doc_id"], r["start"], r["candidate"], r["is_secret"]) for r in secrets.scan(df, forest).collect()}
    assert found == {(i, t.index(v), v, True) for i, (t, v) in enumerate(zip(texts_, values, strict=True))}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df, forest).collect()}
    assert clean == {i: t.replace(v, "[SECRET]") for i, (t, v) in enumerate(zip(texts_, values, strict=True))}


def near_vectors(first):
    r = np.random.default_rng(4)
    base = r.normal(size=(60, 16))
    rows = [base[i % 60] + r.normal(scale=0.03, size=16) for i in range(240)]
    return [(first + 100 * k + 1, v.tolist(), 1) for k, v in enumerate(rows)]


@pytest.mark.parametrize("bad", [False, True])
def test_vectors_without_an_audited_id(spark, monkeypatch, caplog, bad):
    """No id is divisible by 100: planted links measure the recall; forests that find nothing end in the exact comparison."""
    if bad:
        monkeypatch.setattr(embedding_dedup, "LEAF", 2)
        monkeypatch.setattr(embedding_dedup, "ROUNDS", 0)
        monkeypatch.setattr(embedding_dedup, "FORESTS", 1)
        monkeypatch.setattr(embedding_dedup, "trees_for", lambda depth, threshold: 1)
    rows = near_vectors(7)
    df = spark.createDataFrame([*rows, (None, rows[0][1], 1)], "vec_id long, embedding array<double>, label int")
    with caplog.at_level("INFO", logger="logloom.llm.embedding_dedup"):
        found = embedding_dedup.link_vectors(df).collect()
    unit = np.array([v for _, v, _ in [*rows, rows[0]]])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    expected = {i: int(n) - 1 for (i, _, _), n in zip([*rows, (None, 0, 0)], near.sum(axis=1), strict=True)}
    assert {r["vec_id"]: r["n_links"] for r in found} == expected and sum(expected.values()) > 200
    said = " ".join(caplog.messages)
    assert "planted links" in said and "unmeasured (no links)" in said and ("comparing all" in said) == bad
    ids = [i for i, _, _ in rows]
    for r in found:
        if r["vec_id"] is not None:
            assert r["component_id"] <= r["vec_id"] and r["component_id"] in ids


def test_gathered_batches():
    import pyarrow as pa

    own = [pa.RecordBatch.from_arrays([pa.array([k] * 10)], ["x"]) for k in range(7)]
    assert [b.num_rows for b in decontamination.gathered(iter(own), [1, 2])] == [10] * 7
    joined = list(decontamination.gathered(iter(own), [1, 2, 3], most=200))
    assert [b.num_rows for b in joined] == [30, 30, 10] and [x for b in joined for x in b.column(0).to_pylist()] == [k for k in range(7) for _ in range(10)]
