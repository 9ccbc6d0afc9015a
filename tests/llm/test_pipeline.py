"""The pipeline's stages, alone and together, against brute force on a small table."""

import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from logloom.llm.queries import vocabulary  # noqa: E402
from test_text_operators import lower, prose, shingles  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, row long, key string, t1 long, root long"
#: names that the operators use inside
CLASHES = "m_id m_t1 m_t2 d r g first spans k1 k2 text_digest hit lines grp n_shingles score start length candidate words same".split()
SECRET = "ghp_aZ3kQ9xW7bT2aZ3kQ9xW7bT2aZ3kQ9xW7bT2"
PASSAGE = prose(77, 40, "klmnopqr")


def rows():
    base = prose(5, 200).split()
    near = base[:]
    near[60] = "changed"
    other = prose(6, 150, "schuimö")
    own = [
        (1, " ".join(base), "en"), (2, " ".join(near), "en"), (3, " ".join(base), "en"), (2, prose(8, 120), "en"), (None, prose(9, 90), "en"), (None, prose(9, 90), "en"),
        (10, other, "de"), (11, other + " " + PASSAGE, "de"), (12, f"deploy with token = {SECRET} and " + prose(11, 60), "en"), (13, "", "en"), (14, None, None), (15, "123 456 !!", None),
        (16, "word", None), (16, "word", None), (17, prose(12, 5000), None), (18, "one two", "xx"), (19, prose(13, 80) + " " + SECRET[:12], None),
    ]
    return [(i, t, lang, "s", None if t is None else len(t), 7, "k", 1, 2) for i, t, lang in own]


ITEMS = [("a", PASSAGE), ("b", None), ("c", "nowhere at all")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, *[3] * len(CLASHES)) for r in rows()], COLUMNS + "".join(f", {c} int" for c in CLASHES)).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def has_letter(text):
    return any(c.isalpha() for c in text or "")


def one_of_each_group(own):
    """Rows (doc_id, text) that stay, by all pairs."""
    sets = [shingles(t, 5) for _, t in own]
    group = list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    members = defaultdict(list)
    for r, s, g in zip(own, sets, group, strict=True):
        members[g if s else object()].append(r)
    return [min(m, key=lambda r: (r[0] is None, r[0] or 0)) for m in members.values()]


def contaminated(text):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall(lower(text or ""))
    hit = set()
    for _, item in ITEMS:
        v = word.findall(lower(item or ""))
        for k in range(max(1, len(v) - 12) if v else 0):
            win = v[k : k + 13]
            for a in range(len(w) - len(win) + 1):
                if w[a : a + len(win)] == win:
                    hit |= set(range(a, a + len(win)))
    return len(hit) > 0 and 20 * len(hit) >= len(w)


def redacted(text):
    return text if text is None else text.replace(SECRET, "[SECRET]")


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    own = [(r[0], r[1]) for r in rows()]
    expected = {
        "language_id": Counter(r for r in own if has_letter(r[1])),
        "ngram_jaccard_join": Counter(one_of_each_group(own)),
        "benchmark_decontamination": Counter(r for r in own if not contaminated(r[1])),
        "secret_scans": Counter((i, redacted(t)) for i, t in own),
    }
    for name, kept in expected.items():
        out = stages[name](spark, docs, folder)
        assert out.columns == docs.columns and plain(out) == kept, name
        for r in out.collect():
            assert (r["source"], r["row"], r["key"], r["t1"], r["root"]) == ("s", 7, "k", 1, 2) and {r[c] for c in CLASHES} == {3} and r["n_chars"] == (None if r["text"] is None else len(r["text"]))
        assert stages[name](spark, docs.limit(0), folder).count() == 0
    assert stages["best_fit_packing"](spark, docs.limit(0), folder).count() == 0


def test_run(spark, folder):
    from tokenizers import Tokenizer

    own = [(r[0], r[1]) for r in rows() if has_letter(r[1])]
    kept = [(i, redacted(t)) for i, t in one_of_each_group(own) if not contaminated(t)]
    encode = Tokenizer.from_file(vocabulary()).encode
    sizes = Counter((i, len(encode(t, add_special_tokens=False).ids) + 1) for i, t in kept)
    found, places = Counter(), defaultdict(list)
    pieces = corpus_pipeline.run(spark, folder).collect()
    by = defaultdict(int)
    for r in pieces:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        by[r["doc_id"], r["start"] + r["length"]] += 1
    lasts = Counter()
    for (i, end), n in by.items():
        if (i, end) in sizes:
            lasts[i, end] += n
    found = lasts
    assert found == sizes and sum(r["length"] for r in pieces) == sum(s * n for (_, s), n in sizes.items())
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
