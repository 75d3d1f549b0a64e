"""The pipeline end to end against brute force: what every stage drops, keeps and changes, with nulls, repeats and empty tables."""

import random

import pytest

import corpus_pipeline
from vintage.llm import jaccard_join, queries

from .test_text_operators import brute_components, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, docs, labels, benchmark):
    for name, frame in (
        ("documents", spark.createDataFrame(docs, DOCS)), ("labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame(benchmark, "item_id long, text string")),
    ):
        frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def corpus():
    rng = random.Random(20)
    stems, bad = ["tion", "ing", "er", "wh", "and", "sti", "re", "ou"], ["pathetic", "worthless", "disgusting", "moronic"]
    docs, toxic = [], set()
    for i in range(400):
        w = ["".join(rng.choices(stems, k=rng.randrange(1, 5))) for _ in range(80)]
        if i % 4 == 0:
            toxic.add(i)
            w[::8] = [rng.choice(bad) for _ in w[::8]]
        docs.append((i, " ".join(w)))
    base, item = words(rng, 60), words(rng, 30)
    near = {500 + i: " ".join(base[:i] + ["other"] + base[i + 1 :]) for i in range(0, 60, 20)}
    copied = {600: " ".join(words(rng, 40) + item[3:20] + words(rng, 40)), 601: " ".join(item)}
    private = {700: " ".join(words(rng, 20)) + " mail me@x.org or +1 555 010 9999"}
    odd = {800: None, 801: "", 802: "  \n", 803: "two words"}
    docs += [*near.items(), *copied.items(), *private.items(), *odd.items()]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    return rows, toxic, near, copied, private, [(1, " ".join(item)), (2, None), (None, "lost")]


def test_every_stage_decides_as_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, toxic, near, copied, private, benchmark = corpus()
    labels = [(i, 1, int(i in toxic)) for i, *_ in rows if i < 400]
    folder = tables(spark, tmp_path, rows, labels, benchmark)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [f.split()[0] for f in DOCS.split(", ")], name
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    kept = seen["toxicity"]
    assert sum(i in kept for i in toxic) <= len(toxic) * 0.1 and sum(i in kept for i in range(400) if i not in toxic) >= 290
    ids = sorted(kept)
    wanted = {ids[i] for i, (_, c) in enumerate(brute_components([kept[i] for i in ids])) if i == c}
    assert set(seen["near_copies"]) == wanted and len(set(near) & wanted) == 1
    assert set(seen["near_copies"]) - set(seen["decontamination"]) == set(copied)
    assert seen["personal_data"].keys() == seen["decontamination"].keys()
    assert seen["personal_data"][700].endswith("mail <EMAIL> or <PHONE>") and seen["personal_data"][800] is None
    tokens = Tokenizer.from_file(queries.word_bpe())
    want = {i: len(tokens.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in seen["personal_data"].items()}
    packed: dict = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed == want


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 2 + [(1, "a b c d e f", "en", None, 11)] * 3])
def test_empty_tables_and_repeated_rows(spark, tmp_path, rows):
    """Rows of null id all stay, and so do rows that repeat a kept id and text."""
    folder = tables(spark, tmp_path, rows, [], [])
    tokens: dict = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == ({None: 2, 1: 21} if rows else {})


def test_near_copies_among_texts_strung_together_by_chance(spark, monkeypatch):
    """Stage 2 keeps what brute force keeps, and no set meets all blocks of a group that chance strings together."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 25)
    monkeypatch.setattr(jaccard_join, "CROWDED_SETS", 20, raising=False)
    many, plain = [], jaccard_join.materialise

    def watched(df, what, *more):
        out = plain(df, what, *more)
        many.extend([out.count()] if what == "rest" else [])
        return out

    monkeypatch.setattr(jaccard_join, "materialise", watched)
    rng = random.Random(21)
    texts = [" ".join(rng.choices("abcdef", k=rng.randrange(30, 40))) for _ in range(220)]
    texts += [t + " g" for t in texts[:20]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {i for i, (_, c) in enumerate(brute_components(texts)) if i == c}
    assert sum(many) < 40
