"""Centroid clustering, chat formatting and spelling variants against plain loops: nulls, ties, repeats, clashing names, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from logloom.llm import centroids, chat, spelling
from logloom.llm.automata import Automaton

# --- centroid clustering


def vectors():
    r = random.Random(3)
    rows = [(i, [r.choice((-1, 1)) * r.random() for _ in range(64)]) for i in range(120)]
    rows += [(200, [0.5] * 64), (200, [0.5] * 64), (201, [0.25] * 64), (None, [0.1] * 64), (202, [-0.0] * 64), (203, [1e5] * 64)]
    return [*rows, (300, None), (301, []), (302, [0.5] * 63), (303, [0.5] * 65), (304, [0.5] * 63 + [None]), (305, [0.5] * 63 + [float("nan")]), (306, [float("inf")] + [0.5] * 63)]


def plain_lloyd(rows, k, rounds):
    kept = [(i, [int(64 * x // 1) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and abs(x) < float("inf") for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        cents = [[sum(col) // len(col) for col in zip(*[v for (_, v), o in zip(kept, own, strict=True) if o == n], strict=True)] if n in own else c for n, c in enumerate(cents)]
    out = [(i, *reversed(near(v))) for i, v in kept]
    total = Counter()
    for _, n, d in out:
        total[n] += d
    return Counter((i, n, d, total[n], sum(total.values()), hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for i, n, d in out)


SCHEMA = "vec_id long, embedding array<double>, cluster string, v int, n long, sums string"


@pytest.mark.parametrize("k", [16, 3, 500])
def test_centroids(spark, k):
    rows = [(i, v, "c", 1, 2, "s") for i, v in vectors()]
    found = centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), k)
    assert Counter(tuple(r) for r in found.collect()) == plain_lloyd(vectors(), k, 3)


def test_centroids_edges(spark):
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    none = spark.createDataFrame([(1, None, "c", 1, 2, "s"), (None, [0.5] * 64, "c", 1, 2, "s")], SCHEMA)
    assert centroids.cluster(none).count() == 0  # nothing that could start a centroid
    with pytest.raises(Exception, match="squared distance"):
        centroids.cluster(spark.createDataFrame([(1, [1e7] * 64, "c", 1, 2, "s")], SCHEMA)).collect()


# --- chat formatting

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[REPLY]", "[/REPLY]", "[SYS]", "[/SYS]", "[NEXT]", "[/NEXT]", "[ROLE]", "[/ROLE]", "[END]"]


def tangled(seed):
    r = random.Random(seed)
    return "".join(r.choice([*CONTROLS, "\\", "<", "[", "]", ">", " ", "\n", "é", "🙂", "a", "<\\s>", "[\\\\INST]"]) for _ in range(r.randint(0, 12)))


def chats():
    rows = [(1, 2, "assistant", "two"), (1, 0, "system", "be brief"), (1, 1, "user", "one"), (2, 0, "user", None), (2, 1, "user", "</s>"), (2, 2, "assistant", "[NEXT]"), (2, 3, "assistant", "")]
    rows += [(3, 0, "tool", "x"), (3, 1, "tool", "y[END]"), (3, 2, "to[/ROLE]ol", "z"), (3, 3, None, "w"), (3, 4, "", "v"), (4, 0, "assistant", "only"), (4, 0, "assistant", "only"), (4, 0, None, "only")]
    rows += [(None, None, "user", "lost"), (None, 1, "assistant", "found"), (5, 0, "assistant", "long " * 200_000), (6, 0, "ass[INST]istant", "\\</s>")]
    roles = ["user", "assistant", "system", "tool", "[SYS]"]
    r = random.Random(8)
    return rows + [(c, t, r.choice(roles), tangled(100 * c + t)) for c in range(10, 60) for t in range(r.randint(1, 20))]


def order(row):
    return tuple((x is not None, x or ("" if k else 0)) for k, x in enumerate(row[1:2])), row[2] or "", row[3] or ""


def test_chat(spark):
    rows = chats()
    table = spark.createDataFrame([(*r, 5, "t", "s") for r in rows], "conv_id long, turn long, role string, text string, runs long, turns string, segments string").repartition(3)
    made = chat.format_chats(chat.with_probe(table)).persist()
    given = {}
    for row in [*rows, (-1, 0, "user", chat.PROBE_TEXT), (-1, 1, "assistant", chat.PROBE_TEXT)]:
        given.setdefault(row[0], []).append(row)
    assert {r["conv_id"] for r in made.select("conv_id").collect()} == set(given) and made.count() == len(given)
    found = {r["conv_id"]: r for r in chat.digests(made).collect()}
    for r in made.collect():
        said = [(x[2] or "", x[3] or "") for x in sorted(given[r["conv_id"]], key=order)]
        loss = "".join(t for role, t in said if role == "assistant")
        own = found[r["conv_id"]]
        assert own["n_turns"] == len(said) and own["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest(), (r["conv_id"], r["formatted"][:300])
        assert (own["loss_chars"], own["loss_sha256"], own["formatted_chars"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(r["formatted"]))
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        # one opening and one closing for each run of a role, and no other control string
        blocks = sum(i == 0 or said[i - 1][0] != x[0] for i, x in enumerate(said))
        assert len(re.findall(r"\[INST\]|\[REPLY\]|\[SYS\]|\[ROLE\]", r["formatted"])) == blocks
        assert len(re.findall(r"\[/INST\]|</s>|\[/SYS\]|\[END\]", r["formatted"])) == blocks and r["formatted"].count("[NEXT]") == len(said) - blocks
    assert chat.format_chats(table.limit(0)).count() == 0


def test_chat_stays_in_the_jvm(spark):
    table = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.digests(chat.format_chats(chat.with_probe(table)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_variants(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(((-words[v], v) for v in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 10 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def spelled(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abé÷") for _ in range(r.randint(7, 10))) for _ in range(12)]
    rows = []
    for i in range(160):
        own = []
        for _ in range(40):
            w = base[min(int(r.expovariate(0.7)), 11)]
            if r.random() < 0.15:
                at = r.randrange(len(w))
                w = w[:at] + r.choice(["", r.choice("abéÀZ"), w[at] + r.choice("ab")]) + w[at + 1 :]
            own.append(w.upper() if r.random() < 0.05 and "é" not in w else w)
        rows.append((i, " ".join(own)))
    chain = [("abcdefgh", 600), ("abcdefgx", 50), ("abcdefyx", 4), ("short", 50), ("sixsix", 90), ("seventy", 2), ("seventx", 2)]
    rows += [(1000 + k, " ".join([w] * n)) for k, (w, n) in enumerate(chain)]
    return [*rows, (None, "abcdefgh abcdefgh wörterbuch wörterbuch WÖRTERBUCH"), (None, None), (3, None), (4, ""), (5, "1234567 中文字中文字中文字"), (7, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 5001 + " " + "x" * 5001), rows[0], rows[0]]


@pytest.mark.parametrize(("seed", "most"), [(1, 1 << 15), (2, 7)])
def test_variants(spark, seed, most):
    rows = spelled(seed)
    table = spark.createDataFrame([(i, t, 3, "w", 5) for i, t in rows], "doc_id long, text string, n long, word string, near int").repartition(5)
    found = spelling.variants(table, most=most).collect()
    expected = plain_variants(rows)
    assert len(found) == len(expected) and {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in found} == expected
    assert any(r["form"] not in (None, r["root"]) for r in found)  # a chain
    assert spelling.variants(table.limit(0)).count() == 0


def test_automaton():
    r = random.Random(5)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(0, 6))) for _ in range(60)})
    found = Automaton(words)
    for k, w in enumerate(words):
        assert found.accepted(found.root, 0, w) == k
    assert found.accepted(found.root, 0, "abc") is None and found.size[found.root] == len(words)
    suffixes = {tuple(v[len(p) :] for v in words if v.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(found.edges) == len(suffixes)  # as many states as different sets of endings: minimal
    for w in words:
        assert {words[k] for k in found.replaced_or_inserted(found.root, 0, w)} == {v for v in words if one_edit(v, w) and len(v) >= len(w)}
        assert {words[k] for k in found.deleted(found.root, 0, w)} == {v for v in words if one_edit(v, w) and len(v) < len(w)}
