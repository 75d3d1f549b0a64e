"""Text operators against brute force, round trips and held-out accuracy, with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintage.llm import decontamination, hamming_topk, host_reputation, jaccard_join, language_id, packing, pii, queries, token_counts, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, utf8 string, cls long"


def documents(spark, texts, lang="en"):
    """Documents with two more columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "clash", 7) for i, t in enumerate(texts)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_bpe())


TEXTS = [
    None, "", "   \n\t", "Hello, World!", "it's 3.14% <|endoftext|>tail<|startoftext|>", "naïve café ÀÉÎ ß İstanbul", "日本語のテキスト 한국어", "a\u0308 J\u030c e\u0301", "x" * 5000, "tab\tsep\x0bvt\x1cfs\x85nel\u00a0nbsp",
    "don't we'll I'M they're 've", "²³ ½ ª º Ⅷ", "emoji 👍🏽 ok", "Hello, World!", "The quick brown fox. " * 400,
]


def test_token_counts_equal_the_library(spark, tokenizer):
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(documents(spark, TEXTS), queries.word_bpe(), 4000).collect()}
    want = {i: (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(TEXTS)}
    assert got == want
    assert token_counts.count_tokens(empty(spark), queries.word_bpe()).isEmpty()


def test_packing_round_trip(spark, tokenizer):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(words(rng, rng.randrange(1, 3000))) for _ in range(60)]
    rows = packing.pack_documents(documents(spark, texts), queries.word_bpe()).collect()
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], np.uint32) for i, t in enumerate(texts)}
    covered, fill = {i: np.zeros(len(v), int) for i, v in ids.items()}, {}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(piece.astype("<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id][r.start : r.start + r.length] += 1
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all((c == 1).all() for c in covered.values())
    for pieces in fill.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == 4096 or end & (end - 1) == 0
    assert packing.pack_documents(empty(spark), queries.word_bpe()).isEmpty()


def test_sum_of_squares_rule_takes_the_least_sum():
    rule, rng = packing.SumOfSquares(32), random.Random(2)
    for _ in range(500):
        size, before = rng.randrange(1, 32), rule.count.copy()

        def after(level, before=before, size=size):
            n = before.copy()
            if level:
                n[level] -= 1
            if level + size < 32:
                n[level + size] += 1
            return int((n**2).sum())

        possible = [0, *(h for h in range(1, 33 - size) if before[h])]
        assert after(rule.place(size)) == min(map(after, possible))


def brute_components(texts, n=5, percent=75):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_texts():
    rng = random.Random(3)
    base, shared = words(rng, 60), words(rng, 50)
    texts = [None, "", "one two", "ONE  two", "three"]
    for i in range(40):  # near copies of one text, each with a few words changed
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(60)] = f"x{rng.randrange(99)}"
        texts.append(" ".join(w))
    for _ in range(15):  # a passage that unrelated documents share
        texts.append(" ".join(words(rng, 30) + shared + words(rng, 30)))
    texts += [" ".join(base)] * 8  # exact copies
    chain = words(rng, 80)
    for i in range(10):  # neighbours link, the ends do not
        texts.append(" ".join(chain[: 80 - i * 0] if i == 0 else words(rng, i * 2) + chain[i * 2 :]))
    return texts


@pytest.mark.parametrize("block", [2000, 7])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    """With blocks of seven sets the near copies are a large group: delegates and the exhaustive step run."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    texts = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(documents(spark, texts)).collect()}
    assert got == dict(enumerate(brute_components(texts)))


def test_groups_strung_together_by_chance_fall_apart(spark, monkeypatch):
    """Few words make 5-grams shared by chance: one candidate group of almost all texts, of which few may meet all its blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 25)
    monkeypatch.setattr(jaccard_join, "CROWDED_SETS", 20, raising=False)
    made, plain = {}, jaccard_join.materialise

    def watched(df, what, *more):
        made[what] = plain(df, what, *more)
        return made[what]

    monkeypatch.setattr(jaccard_join, "materialise", watched)
    rng = random.Random(11)
    texts = [" ".join(rng.choices("abcdef", k=rng.randrange(30, 40))) for _ in range(250)]
    texts += [t + " g" for t in texts[:30]] + ["a a a a a a a", "a a a a a b", None]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(documents(spark, texts)).collect()}
    assert got == dict(enumerate(brute_components(texts)))
    assert made["candidates"].groupBy("part").count().agg({"count": "max"}).first()[0] > 100
    assert "rest" not in made or made["rest"].count() < 40


@pytest.mark.parametrize("heavy", [2, 70])
def test_crowded_groups_of_frequent_ngrams_equal_brute_force(spark, monkeypatch, heavy):
    """Every group goes through the exchange of crowded groups, where n-grams are frequent, some known to one task alone."""
    monkeypatch.setattr(jaccard_join, "CROWDED_SETS", 1)
    monkeypatch.setattr(jaccard_join, "HEAVY_IN_CROWD", heavy)
    monkeypatch.setattr(jaccard_join, "BUCKET_ENTRIES", 500)
    rng = random.Random(12)
    passage = words(rng, 40)
    texts = near_texts() + [" ".join(passage + words(rng, rng.randrange(0, 25))) for _ in range(150)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(documents(spark, texts)).collect()}
    assert got == dict(enumerate(brute_components(texts)))


def test_near_duplicates_of_nothing_and_of_rows_without_id(spark):
    assert jaccard_join.near_duplicates(empty(spark)).isEmpty()
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    assert sorted(r.component_id for r in jaccard_join.near_duplicates(rows).collect()) == [4, 4, 4]


def test_rows_without_id_bridge_groups(spark):
    """A links with B and B with C, but A not with C; B has no id."""
    w = [f"w{i}" for i in range(60)]
    a, b, c = w[:50], w[4:54], w[8:58]
    texts = [(1, a), (None, b), (2, c), (None, w[:3]), (None, w[:3]), (7, ["other"] * 9)]
    rows = spark.createDataFrame([(i, " ".join(t), "clash") for i, t in texts], "doc_id long, text string, cls string")
    out = sorted(((r.doc_id or 0, r.component_id) for r in jaccard_join.near_duplicates(rows).collect()), key=repr)
    assert out == sorted([(1, 1), (0, 1), (2, 1), (0, None), (0, None), (7, 7)], key=repr)
    apart = [(i, t) for i, t in texts if t is not b]
    rows2 = spark.createDataFrame([(i, " ".join(t), "clash") for i, t in apart], "doc_id long, text string, cls string")
    assert {r.component_id for r in jaccard_join.near_duplicates(rows2).where("doc_id < 3").collect()} == {1, 2}
    kept = sorted(((r.doc_id, len(r.text.split())) for r in jaccard_join.keep_one_per_group(rows).collect()), key=repr)
    assert kept == sorted([(1, 50), (None, 3), (7, 9)], key=repr)


def test_each_text_of_a_repeated_id_is_judged(spark):
    w = [f"w{i}" for i in range(60)]
    texts = [(1, w[:50]), (5, w[1:51]), (5, ["fresh", "words"] * 5), (6, ["fresh", "words"] * 5), (8, []), (8, []), (None, []), (None, w[:50])]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text[:5]) for r in jaccard_join.keep_one_per_group(rows).collect()), key=repr)
    assert kept == sorted([(1, "w0 w1"), (5, "fresh"), (8, ""), (8, ""), (None, "")], key=repr)


def test_one_of_each_group_stays(spark):
    texts = near_texts()
    kept = {r.doc_id for r in jaccard_join.keep_one_per_group(documents(spark, texts)).collect()}
    assert kept == {i for i, (_, c) in enumerate(brute_components(texts)) if i == c}


def test_prefix_tree_links_what_brute_force_links():
    rng = np.random.default_rng(4)
    for _ in range(60):
        base = rng.choice(10_000, 40, replace=False).astype(np.uint64)
        sets = []
        for _ in range(rng.integers(2, 25)):
            s = base.copy()
            change = rng.integers(0, 9)
            s[rng.choice(40, change, replace=False)] = rng.integers(10_000, 20_000, change)
            sets.append(np.unique(s[: rng.integers(25, 41)]))
        want = list(range(len(sets)))

        def find(i, want=want):
            while want[i] != i:
                i = want[i]
            return i

        for a, b in combinations(range(len(sets)), 2):
            o = len(np.intersect1d(sets[a], sets[b]))
            if 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                want[max(x, y)] = min(x, y)
        assert jaccard_join.tree_components(sets, list(range(len(sets)))) == [find(i) for i in range(len(sets))]


def test_benchmark_windows(spark):
    rng = random.Random(5)
    items = [" ".join(words(rng, 30, 60)) for _ in range(6)] + ["Two words", None, "!!!"]
    texts = [None, "", " ".join(words(rng, 200, 60)), "x " + items[0].upper() + " y", items[1][: len(items[1]) // 2], "say two-words, please", " ".join(items[2].split()[3:14]) + " " + " ".join(items[3].split()[:10]), "Two words"]
    bench = spark.createDataFrame(list(enumerate(items)) + [(None, "lost"), (0, items[0])], "item_id long, text string")
    pattern, low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), {i: i + 32 for i in range(65, 91)}
    windows: dict = {}
    for i, t in enumerate(items):
        w = pattern.findall((t or "").translate(low))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    want = {}
    for d, t in enumerate(texts):
        w, hit, own = pattern.findall((t or "").translate(low)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if o := windows.get(tuple(w[k : k + n])):
                    own |= o
                    hit |= set(range(k, k + n))
        want[d] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest())
    for size in (1 << 20, 100):  # one broadcast group, several groups
        found = decontamination.contamination_report(decontamination.find_benchmark(documents(spark, texts), bench, group_bytes=size))
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in found.collect()} == want
        clean = [r.doc_id for r in decontamination.drop_contaminated(documents(spark, [*texts, None]), bench, group_bytes=size).collect()]
        assert sorted(clean) == sorted([d for d, v in want.items() if not v[1]] + [len(texts)])
    twice = spark.createDataFrame([(None, texts[3]), (5, texts[3]), (5, "clean"), (5, texts[3])], "doc_id long, text string")  # rows without an id, and two texts of one id
    assert [tuple(r) for r in decontamination.drop_contaminated(twice, bench, group_bytes=100).collect()] == [(5, "clean")]
    assert sorted(r.n_hit for r in decontamination.contamination_report(decontamination.find_benchmark(twice, bench, group_bytes=100)).collect()) == [0, *[want[3][1]] * 3]


def base_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]


def test_personal_data_keeps_the_fixed_kinds_exactly():
    rng = random.Random(6)
    finder, pieces = pii.AnchorFinder(), ["a@b.c", "@", "x@y@z.com", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 ", "+1 (555) 010-9999", "++49 30 12", "9" * 20, "é", " ", "-", ".", "+", "7", "iban DE89370400440532013000", "http://a.b/c?d."]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert [s for s in finder.find(text) if s[0] in pii.BASE_KINDS] == base_spans(text), text


def test_personal_data_report_and_redaction(spark):
    texts = [None, "", "mail é me@x.org or +1 555 010 9999", "IBAN DE89 3704 0044 0532 0130 00 see https://a.example/x."]
    rows = {r.doc_id: r for r in pii.personal_data_report(pii.find_personal_data(documents(spark, texts))).collect()}
    assert (rows[2].n_email, rows[2].n_phone, rows[0].spans) == (1, 1, "") and rows[2].base_sha256 == pii.digest(base_spans(texts[2]))
    assert "account:5:32" in rows[3].spans and "url:" in rows[3].spans
    out = {r.doc_id: r.text for r in pii.redact(documents(spark, texts)).collect()}
    assert out[0] is None and out[2] == "mail é <EMAIL> or <PHONE>" and out[3] == "IBAN <ACCOUNT> see <URL>."


def test_archives_round_trip(spark):
    rng = random.Random(7)
    html = [None, "", "dup", "dup", "é" * 10] + [" ".join(words(rng, 50)) for _ in range(40)]
    pages = spark.createDataFrame([(i, f"http://h/{i}\n" if i % 2 else None, h) for i, h in enumerate(html)] + [(None, None, "dup")], "page_id long, url string, html string")
    rows = warc.archive_pages(pages).collect()
    first: dict = {}
    for i, h in enumerate(html):
        first.setdefault(h or "", i)
    assert len(rows) == len(html) + 1
    for r in rows:
        if r.page_id is None:
            assert (r.record_type, r.refers_to) == ("revisit", 2)
            continue
        h = html[r.page_id] or ""
        want = ("response", None) if first[h] == r.page_id else ("revisit", first[h])
        assert (r.record_type, r.refers_to) == want and r.payload_bytes == len(h.encode()) and r.payload_digest == warc.payload_digest(h.encode())
    assert {r.record_type for r in warc.archive_pages(pages, min_bytes=1000).collect()} == {"response"}
    assert warc.archive_pages(pages.where("page_id < 0")).isEmpty()


def test_archive_begins_with_its_dictionary(tmp_path):
    path = tmp_path / "a.warc.zst"
    writer = warc.ArchiveWriter(open(path, "wb"))
    records = [warc.record(i, "http://h/", (f"page number {i} " * 20).encode(), 0, "X", None, False) for i in range(200)]
    for r in records:
        writer.add(r)
    writer.close()
    assert path.read_bytes()[:4] == b"\x5d\x2a\x4d\x18"
    with open(path, "rb") as f:
        assert sum(1 for _ in warc.read_records(f)) == 200


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(300, 64)).astype(float)
    vectors[100:180] = vectors[0]  # a very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(400, None), (None, vectors[0].tolist())]
    got: dict = {}
    for r in hamming_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r.place, r.distance, r.neighbour_id))
    bits = vectors > 0
    for q in range(0, 300, 20):
        d = (bits != bits[q]).sum(1)
        want = sorted((int(d[i]), i) for i in range(300) if i != q)[:10]
        assert [(x[1], x[2]) for x in sorted(got[q])] == want
    assert set(got) == set(range(0, 300, 20))


def test_index_search_is_exact_at_any_radius():
    rng = np.random.default_rng(9)
    codes = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64))
    index, weight = hamming_topk.BucketIndex(codes), np.ones(len(codes), np.int64)
    for q in rng.integers(0, 2**63, 30):
        at, d = index.search(int(q), weight, 5, 64)
        want = np.sort(np.bitwise_count(codes ^ np.uint64(q)))[:5]
        assert np.array_equal(np.sort(d)[:5], want)


def test_languages_are_told_apart(spark):
    rng = random.Random(10)
    parts = {"aa": ["th", "ing", "er", "and", "wh"], "bb": ["ção", "nh", "lh", "que", "de"], "cc": ["sch", "ung", "ei", "ü", "keit"]}
    rows = [(i, " ".join("".join(rng.choices(p, k=3)) for _ in range(40)), lang) for i, lang in enumerate(list(parts) * 60) for p in [parts[lang]]]
    rows += [(900, None, "aa"), (901, "123 !!", "aa"), (902, "thinger", None), (None, "whand", "bb")]
    out = {r.doc_id: r for r in language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows[:180])
    assert (out[900].lang_pred, out[901].lang_pred, out[900].score, out[902].lang_pred) == ("und", "und", 0.0, "aa")
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows[:180]) and out[None].held_out
    nothing = language_id.identify_languages(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert nothing.lang_pred == "und"


def test_probabilities_of_a_context_add_up():
    models = language_id.fit([("a", b"banana bandana anagram")] * 8)
    letters = sorted(set("banana bandana anagram".replace(" ", "")))
    total = 0.0
    for end in [*letters, None]:  # every continuation of "ban", the word's end included
        word = "ban" + (end or "")
        logs, _ = models.log_probabilities([word])
        prefix, _ = models.log_probabilities(["ban"])
        grams, owner = language_id._grams([word], language_id.ORDER)
        del grams, owner, prefix
        p = np.full((len(word) + 1, 1), 1 / models.symbols, np.float32)
        g, c = language_id._grams([word], language_id.ORDER)[0], language_id._contexts([word], language_id.ORDER)
        for level, gram, context in zip(models.levels, g, c, strict=True):
            known = gram != 0
            p[known] = language_id._find(level.grams, level.probability, gram[known], 0) + language_id._find(level.contexts, level.weight, context[known], 1) * p[known]
        total += float(p[3, 0])
    assert total == pytest.approx(1, abs=0.08)


def test_toxic_documents_are_found(spark):
    rng = random.Random(11)
    stems = ["tion", "ing", "er", "wh", "and", "sti", "re", "ou"]
    bad = ["pathetic", "worthless", "disgusting", "moronic"]

    def text(toxic):
        w = ["".join(rng.choices(stems, k=rng.randrange(1, 4))) for _ in range(80)]
        if toxic:
            for i in range(0, 80, 8):
                w[i] = rng.choice(bad)
        return " ".join(w)

    truth = {i: int(i % 4 == 0) for i in range(600)}
    docs = documents(spark, [text(t) for t in truth.values()] + [None, ""])
    labels = spark.createDataFrame([(i, 1, t) for i, t in truth.items()] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    held = [i for i in truth if rows[i].held_out]
    assert sum(rows[i].predicted == truth[i] for i in held) / len(held) > 0.95
    assert 0 <= rows[600].score <= 1 and rows[600].score == rows[601].score
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert kept == {i for i, r in rows.items() if r.predicted == 0}
    assert {r.score for r in toxicity.toxicity_scores(docs, labels.where("toxic = 0")).collect()} == {0.0}


def test_url_rules_and_parts(spark):
    urls = ["http://A.Example.NET/en/x?y#z", "https://example.net/fr/", "no scheme", None, "http://example.com/de/1", "ftp://org/fr/", "http://x.org", "http://notexample.com/de/", "http://h.net?q=/", "a://b://c/d"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    out = {r.page_id: r for r in host_reputation.filter_urls(pages, none).collect()}
    assert (out[0].host, out[0].path, out[0].rule, out[0].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (out[1].rule, out[1].verdict, out[4].rule, out[5].rule, out[7].rule) == ("net/", "block", "example.com/de/", "org/fr/", None)
    assert (out[2].host, out[3].host, out[3].verdict, out[8].rule, out[9].host) == ("", "", "allow", None, "b:")


def test_reputation_shrinks_small_hosts(spark):
    rows, bad, page = [], [], 0
    for host, n, k in [("bad.x.com", 200, 190), ("good.x.com", 200, 2), ("new.y.com", 2, 2), ("ok.y.com", 300, 3)]:
        for i in range(n):
            rows.append((page, host))
            bad.append((page, i < k))
            page += 1
    out = {r.host: r for r in host_reputation.host_reputation(spark.createDataFrame(rows, "page_id long, host string"), spark.createDataFrame(bad, "page_id long, bad boolean")).collect()}
    assert out["bad.x.com"].lower > 0.8 > out["new.y.com"].mean > out["good.x.com"].mean
    assert Counter(r.n for r in out.values()) == Counter([200, 200, 2, 300])


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, sf).columns == docs.columns, name
    assert corpus_pipeline.run(spark, sf).select(F.countDistinct("doc_id")).first()[0] > 0


def frames(data):
    """The offset, length and content of each frame of an archive, read one by one with its dictionary."""
    import struct

    import zstandard

    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.DICTIONARY_FRAME and data[:4] == b"\x5d\x2a\x4d\x18"
    press, at = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])), 8 + size
    while at < len(data):
        one = press.decompressobj()
        content = one.decompress(data[at:])
        end = len(data) - len(one.unused_data)
        yield at, end - at, content
        at = end


@pytest.mark.parametrize(("count", "broadcast"), [(400, 1 << 20), (3, 1 << 20), (400, 0)])
def test_files_that_spark_wrote_hold_one_frame_a_record(spark, monkeypatch, count, broadcast):
    """Bytes on disk: the dictionary's skippable frame, then a frame for every record, each readable alone; several archives, repeats, clashing columns."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    rng = random.Random(12)
    html = {i: "copy " * 30 if i % 3 == 0 else " ".join(words(rng, 60)) for i in range(count)}
    rows = [(i, f"http://h/{i}", h, "clash", 1) for i, h in html.items()] + [(0, "http://h/0", html[0], "clash", 1), (1, "http://h/1", html[1], "clash", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, first int").repartition(2)
    manifest, folder = warc.write_archives(pages, broadcast_bytes=broadcast)
    listed = manifest.collect()
    assert sum(m.records for m in listed) == count + 2 and all(m.dictionary_bytes > 0 for m in listed)
    assert len(listed) > 2 or count == 3
    payloads = 0
    for m in listed:
        data = open(m.archive.removeprefix("file:"), "rb").read()
        found = list(frames(data))
        assert len(found) == m.records and all(c.startswith(b"WARC/1.1\r\n") and c.count(b"WARC-Record-ID") == 1 for _, _, c in found)
        payloads += sum(b"WARC-Type: response" in c for _, _, c in found)
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(manifest, folder).collect())
    want = Counter((i, "response", None) if i == 0 or i % 3 else (i, "revisit", 0) for i in [*html, 0, 1])
    assert got == want and payloads == sum(n for (_, kind, _), n in want.items() if kind == "response")


def test_windows_cover_texts_without_spaces():
    """Tabs, line ends and scripts without spaces: windows cover the text, stay short and never split a character."""
    rng = random.Random(13)
    for text in ["", "a", "x" * 9_000, "word\tnext\n" * 500, "日本語" * 2_000, "é" * 5_000, "".join(rng.choice("ab é日\n") for _ in range(4_000))]:
        data = toxicity.prepare(text.encode())
        starts, lengths = toxicity.windows(data, toxicity.WINDOW)
        assert (starts[1:] == (starts + lengths)[:-1]).all() and lengths.sum() == len(data)
        assert lengths.max() <= 3 * toxicity.WINDOW
        for a, n in zip(starts, lengths, strict=True):
            data[a : a + n].decode()


def toxic_sample(rng, n, joint=" "):
    stems, bad = ["tion", "ing", "er", "wh", "and", "sti", "re", "ou"], ["pathetic", "worthless", "disgusting", "moronic"]
    rows = []
    for i in range(n):
        w = ["".join(rng.choices(stems, k=rng.randrange(1, 4))) for _ in range(80)]
        if i % 4 == 0:
            w[::8] = [rng.choice(bad) for _ in w[::8]]
        rows.append((int(i % 4 == 0), joint.join(w).encode()))
    return rows


def test_either_dictionary_holds_its_class():
    rows = toxic_sample(random.Random(14), 400)
    model = toxicity.fit(rows)
    both = model.dictionaries
    assert all(w in both.toxic and w not in both.ordinary for w in (b"pathetic", b"worthless", b"moronic"))
    assert both.toxic.endswith(both.ordinary) and b"tion" in both.ordinary
    assert toxicity.fit([r for r in rows if r[0]]) is None and toxicity.fit([]) is None
    assert toxicity.fit(rows[::-1]) is not None


def test_toxic_words_far_into_a_text_without_spaces_are_seen():
    model = toxicity.fit(toxic_sample(random.Random(15), 400))
    clean = "\n".join(t.decode() for label, t in toxic_sample(random.Random(16), 200) if not label).replace(" ", "\n")
    assert len(clean) > 30_000
    late = clean + "\n" + "\n".join(["pathetic", "moronic", "worthless"] * 300)
    a, b = toxicity.score_texts(model, [clean.encode(), late.encode()], model.dictionaries.compressors())
    assert a < 0.5 < b


def test_toxicity_of_empty_tables_and_repeated_rows(spark):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_scores(empty(spark), labels).isEmpty() and toxicity.drop_toxic(empty(spark), labels).isEmpty()
    docs = documents(spark, ["some words here"] * 3)
    rows = toxicity.toxicity_scores(docs.unionByName(docs), labels.where("doc_id < 0")).collect()
    assert len(rows) == 6 and {r.score for r in rows} == {0.0}


def test_benchmark_of_string_ids_empty_benchmark_and_repeats(spark):
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([("b", text), ("b", text), (None, text.upper()), ("c", "nothing here")], "doc_id string, text string")
    bench = spark.createDataFrame([("x-10", text), ("x-9", text), ("x-9", text)], "item_id string, text string")
    for size in (1 << 20, 60):
        rows = decontamination.contamination_report(decontamination.find_benchmark(docs, bench, group_bytes=size)).collect()
        want = hashlib.sha256(b"x-10,x-9").hexdigest()
        assert sorted((r.doc_id or "", r.n_hit, r.n_items) for r in rows) == [("", 11, 2), ("b", 11, 2), ("b", 11, 2), ("c", 0, 0)]
        assert {r.items_sha256 for r in rows if r.n_items} == {want}
        assert [r.doc_id for r in decontamination.drop_contaminated(docs, bench, group_bytes=size).collect()] == ["c"]
    none = decontamination.contamination_report(decontamination.find_benchmark(docs, bench.limit(0))).collect()
    assert len(none) == 4 and not any(r.contaminated for r in none)


def test_language_sample_is_bounded(spark):
    """Many rows of one id and many languages bring no more rows than the parameters say; extra columns, empty tables."""
    rows = [(7, f"text {i}", "aa") for i in range(500)] + [(i, "some words", f"l{i:03d}") for i in range(60)] + [(i, "more words", "aa") for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("place", F.lit("clash")).withColumn("n", F.lit(1))
    got = Counter(lang for lang, _ in language_id.sample(docs, 20, max_languages=10))
    assert got["aa"] == 20 and len(got) == 10
    assert language_id.sample(docs.limit(0), 20) == [] and language_id.identify_languages(docs.limit(0)).isEmpty()
    long = spark.createDataFrame([(1, "thing " * 200_000, "aa"), (1, "thing " * 200_000, "aa")], "doc_id long, text string, lang string")
    assert [r.held_out for r in language_id.identify_languages(long).collect()] == [zlib.crc32(b"1") % 5 == 0] * 2
