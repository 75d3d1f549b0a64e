"""Chat formatting, ranked search and hard negatives against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from vintage.llm import chat_format, hard_negatives, ranked_search

TALK = "conv_id long, turn long, role string, text string, segments string, turns long"
CONTROL = ["<|im_end|>", "<|im_start|>assistant\n", "<|im_next|>", "<|", "|>", "<", "|", "\\", "<\\|", "<\\/", "\\\\", "\n", "a", "é", "日", ""]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], TALK)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat_format_is_reversible(spark):
    rng = random.Random(1)
    rows = []
    for c in range(120):
        for t in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "assistant", "sys\ntem", "<|im_end|>", "a\\", None])
            rows.append((c, t, role, None if rng.random() < 0.1 else "".join(rng.choices(CONTROL, k=rng.randrange(8)))))
    rows += [(500, 0, "user", None), (None, 0, "user", "no id"), (501, None, "assistant", "late"), (501, 1, "user", "x"), (501, 1, "user", "x"), (502, 0, "assistant", "<|im_start|>" * 20_000)]
    formatted = chat_format.format_conversations(conversations(spark, rows))
    got = {r.conv_id: r for r in chat_format.format_report(formatted).collect()}
    whole = {r.conv_id: r for r in formatted.collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(text for role, text in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns))), c
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), digest(loss))
        runs = sum(1 for i, (r, _) in enumerate(turns) if i == 0 or turns[i - 1][0] != r)
        text = whole[c].formatted
        assert got[c].formatted_chars == len(text) == sum(len(s.text) for s in whole[c].segments)
        assert text.count("<|im_start|>") == text.count("<|im_end|>") == runs and text.count("<|im_next|>") == len(turns) - runs  # no text holds a marker


def test_chat_format_of_nothing_and_of_a_long_conversation(spark):
    assert chat_format.format_report(chat_format.format_conversations(conversations(spark, []))).isEmpty()
    rows = [(1, t, "user" if t % 3 else "assistant", f"turn {t}") for t in range(20_000)]
    row = chat_format.format_report(chat_format.format_conversations(conversations(spark, rows))).first()
    assert row.n_turns == 20_000 and row.loss_sha256 == digest("".join(f"turn {t}" for t in range(0, 20_000, 3)))


def test_chat_format_runs_no_python(spark):
    plan = chat_format.format_report(chat_format.format_conversations(conversations(spark, [(1, 0, "user", "x")])))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


DOCS = "doc_id long, text string, n long, terms string, item_id long, query int"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, 3, "clash", 9, 1) for i, t in texts], DOCS)


def ranked(texts, items, k=10):
    """Brute force from the definition."""
    pattern, low = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), {i: i + 32 for i in range(65, 91)}
    terms = lambda t: pattern.findall((t or "").translate(low))
    docs = [(i, Counter(terms(t))) for i, t in texts]
    docs = [(i, c, c.total()) for i, c in docs if c]
    n_docs, n_words, df = len(docs), sum(n for _, _, n in docs), Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in docs:
            m = 25 + (75 * n * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, place + 1, s[3], -s[0]) for place, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_ranked_search_equals_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(60)] + ["é", "日本", "x-y", "A"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    texts = [(i, text(rng.choice([1, 3, 10, 40, 300]))) for i in range(300)]
    texts += [(900 + i, "W0 W1 W2 same") for i in range(40)] + [(1000, None), (1001, ""), (1002, "?!"), (None, "W5 W6 W7"), (3, "W5 W6"), (3, "W5 W6")]
    items = [(i, text(rng.randrange(1, 30))) for i in range(12)] + [(50, None), (51, "unheard of"), (52, "same W0"), (None, "W5 W6"), (52, "same W0"), (53, "W1 w1 W1 A a")]
    if seed:  # many small blocks and sets of terms, and several groups of queries
        monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 37)
        monkeypatch.setattr(ranked_search, "SET_TERMS", 8)
        monkeypatch.setattr(ranked_search, "SPLIT_BYTES", 50)
    queries = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = ranked_search.rank_documents(documents(spark, texts), queries, group_bytes=120 if seed == 2 else 1 << 20)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == ranked(texts, items)


def test_ranked_search_of_empty_tables(spark):
    queries = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.rank_documents(documents(spark, []), queries).isEmpty()
    assert ranked_search.rank_documents(documents(spark, [(1, "a")]), queries.limit(0)).isEmpty()


def test_best_positions_stop_early():
    """A block whose best documents lead all lists is not read to its end."""
    n = 5000
    rng = np.random.default_rng(2)
    impacts = np.sort(rng.integers(1, 1_000_000, n))[::-1]
    docs, terms, values = np.tile(np.arange(n), 3), np.repeat(np.arange(3), n), np.tile(impacts, 3)
    block = ranked_search.Block(docs, terms, values, n, 3)
    read = []
    block.docs = Watched(block.docs, read)
    at, score = block.best(np.arange(3), np.arange(3), np.ones(3, np.int64), block.positions(np.arange(3)), 10, 0)
    assert set(range(10)) <= set(at.tolist()) and score.max() == 3 * impacts[0] and max(read) < n


class Watched(np.ndarray):
    """An array that notes how many elements each read of it takes."""

    def __new__(cls, values, read):
        out = np.asarray(values).view(cls)
        out.read = read
        return out

    def __array_finalize__(self, other):
        self.read = getattr(other, "read", None)

    def __getitem__(self, at):
        if isinstance(at, np.ndarray) and self.read is not None:
            self.read.append(at.size)
        return np.asarray(super().__getitem__(at))


VECTORS = "vec_id long, embedding array<double>, label int, row string, id long, vector string, width int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash", 2) for r in rows], VECTORS)


def mined(rows, every=100, k=5):
    """Brute force from the definition; rows of one id are told apart by their place."""
    good = [(n, i, [math.floor(256 * x) for x in v], y) for n, (i, v, y) in enumerate(rows) if v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda s: (-s[0], s[1] is None, s[1] or 0, s[2])
    out = []
    for n, i, v, y in good:
        if i is None or i % every:
            continue
        score = [(sum(a * b for a, b in zip(v, w)), j, m, z == y) for m, j, w, z in good if m != n]
        for ps, pi, _, _ in sorted((s for s in score if s[3]), key=key)[:k]:
            hits = sorted((s for s in score if not s[3] and 80 * ps <= 100 * s[0] <= 100 * ps), key=key)[:k]
            out += [(i, pi, place + 1, s[1], ps, s[0]) for place, s in enumerate(hits)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("dims", [64, 7, 16])
def test_hard_negatives_equal_brute_force(spark, dims, monkeypatch):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(6, dims))
    rows = [(i, (base[rng.integers(6)] + 0.5 * rng.normal(size=dims)).tolist(), int(rng.integers(3))) for i in range(400)]
    rows += [(1000 + i, base[0].tolist(), i % 3) for i in range(30)]  # one common vector
    rows += [(2000, None, 1), (2001, rows[0][1], None), (2100, [math.nan] + [0.0] * (dims - 1), 1), (2200, [math.inf] * dims, 1), (None, base[1].tolist(), 1), (None, base[0].tolist(), 2), (2300, [0.0] * dims, 1), (2400, base[2].tolist()[: dims // 2], 1)]
    rows += [rows[0], rows[100]]  # repeated anchors
    want = mined(rows)
    for blocks in (1 << 16, 60):
        monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", blocks)
        monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 3)
        got = hard_negatives.mine_hard_negatives(vectors(spark, rows))
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want and want


def test_hard_negatives_of_large_components_and_of_nothing(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 50, (rng.integers(-(2**18), 2**18, 6)).astype(float).tolist(), i % 2) for i in range(40)]
    assert sorted((tuple(r) for r in hard_negatives.mine_hard_negatives(vectors(spark, rows)).collect()), key=repr) == mined(rows)
    assert hard_negatives.mine_hard_negatives(vectors(spark, [])).isEmpty()
    with pytest.raises(Exception, match="components above"):
        hard_negatives.mine_hard_negatives(vectors(spark, [(0, [1e9], 1)]))


def test_segment_bounds_hold():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    raw = rng.integers(-300, 300, (50, 40))
    table = pa.table({"vector": pa.array(raw.tolist(), pa.list_(pa.int64())), "width": pa.array([48] * 50, pa.int32())})
    v = hard_negatives.Vectors(table)
    for row in range(50):
        exact, before = raw @ raw[row], None
        for level in range(len(hard_negatives.LEVELS)):
            low, high = v.bounds(level, np.arange(50), v, row)
            assert (low <= exact).all() and (exact <= high).all()
            assert before is None or (high <= before + 2).all()  # finer segments never bound worse
            before = high
