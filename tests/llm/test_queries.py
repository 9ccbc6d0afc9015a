"""The registered queries on a small folder and on empty tables: columns, types, folds, rows."""

import zlib
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

from logloom.llm import queries  # noqa: E402
from test_text_operators import prose  # noqa: E402

#: Columns that each contract names, with their types.
COLUMNS = {
    "op1_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op2_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_embedding_near_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op5_ngram_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op6_secret_scan": "doc_id bigint",
    "op7_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op8_suffix_array_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op9_license_scan": "doc_id bigint",
    "op10_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op11_centroid_clustering": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    "op12_chat_formatting": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op13_spelling_variants": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
}
#: Queries that return one row for each row of documents.
BY_DOCUMENT = [f"op{n}_" for n in (1, 2, 3, 5, 8, 9, 10)]
TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, row long, score double, n int, words string",
    "embeddings": "vec_id long, embedding array<float>, label int, id long, grp string",
    "benchmark": "item_id string, text string, doc_id long",
    "labels": "doc_id long, quality int, toxic int, text string",
    "conversations": "conv_id long, turn long, role string, text string, source string",
}


def rows():
    docs = []
    for i in range(60):
        lang = ["en", "de", None][i % 3]
        text = None if i == 7 else "" if i == 8 else prose(i // 2 if i % 10 == 1 else i, 40 + i, "aeioutnrs" if lang == "en" else "schuimöe")
        docs.append((i if i != 9 else None, text, lang, "s", None, 1, 0.5, 2, "w"))
    docs += [docs[3], (100, "x" * 3000, None, None, 5, 1, 0.5, 2, "w")]
    vectors = [(i, [float((i * 7 + k) % 11 - 5) for k in range(64)], i % 2, 1, "g") for i in range(30)] + [(40, None, 1, 1, "g"), (None, [1.0] * 64, None, 1, "g")]
    bench = [("a", docs[0][1], 1), (None, docs[2][1], 1), ("c", None, 1)]
    labels = [(i, i % 2, int(i % 4 == 0), "t") for i in range(60)]
    chats = [(i // 3, i % 3, ["system", "user", "assistant"][i % 3], None if i == 5 else f"turn {i} [INST]", "s") for i in range(30)]
    return {"documents": docs, "embeddings": vectors, "benchmark": bench, "labels": labels, "conversations": chats}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    whole, none = (str(tmp_path_factory.mktemp(n)) for n in ("whole", "none"))
    for name, own in rows().items():
        spark.createDataFrame(own, TABLES[name]).repartition(2).write.parquet(f"{whole}/{name}.parquet")
        spark.createDataFrame([], TABLES[name]).write.parquet(f"{none}/{name}.parquet")
    return whole, none


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_registered(spark, folders, name):
    whole, none = folders
    run = queries.queries()[name]
    df = run(spark, whole)
    kinds = dict(df.dtypes)
    for column in COLUMNS[name].split(", "):
        at, kind = column.split()
        assert kinds.get(at) == kind, (name, column, kinds)
    found = df.collect()
    if name.startswith(tuple(BY_DOCUMENT)):
        assert Counter(r["doc_id"] for r in found) == Counter(d[0] for d in rows()["documents"])
    if "held_out" in kinds:
        fold, of = (5, 0) if name.startswith("op2") else (3, 1)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold == of) for r in found if r["doc_id"] is not None)
    if "score" in kinds and "held_out" in kinds:
        assert all(0 <= r["score"] <= 1 for r in found)
    empty = run(spark, none)
    assert [c for c, _ in empty.dtypes] == [c for c, _ in df.dtypes]
    left = empty.collect()
    assert [r["conv_id"] for r in left] == [-1] if name.startswith("op12") else not left
