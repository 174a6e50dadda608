"""The pipeline against a plain version of each stage, on what the stage before it kept."""

import itertools
import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests_llm_tools import classes, sentence, window_truth
from tilewright.llm import langid, line_dedup, order_minhash


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    at = str(tmp_path_factory.mktemp("sf"))
    items = [(i, sentence(rng, 20)) for i in range(6)]
    base = ["\n".join(sentence(rng, rng.randint(10, 30)) for _ in range(5)) for _ in range(15)]
    texts = [None, "", "123 !", "one line"] + base + [base[0], base[1].replace("\n", " "), base[2] + "\n" + items[3][1], base[3].split("\n")[0] + " " + items[1][1] + "\nmore " + items[4][1]]
    texts += [t.replace("\n", " ").replace("a", "a", 1) + " end" for t in base[4:8]]
    rows = [(i, t, "en" if i % 3 else None, "s", len(t or "")) for i, t in enumerate(texts)] + [(None, "no id", "en", "s", 5), (5, texts[5], "en", "s", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, items


def test_stages(spark, corpus, tmp_path):
    at, items = corpus
    docs, kept = spark.read.parquet(f"{at}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, at)
        if i < 4:
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{i}")
        kept[name] = docs.collect(), spark.read.parquet(f"{tmp_path}/{i}").collect()
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    key = lambda r: (r.doc_id, r.text)

    before, after = kept["language"]
    assert Counter(map(key, after)) == Counter(key(r) for r in before if langid.has_letter(r.text))

    before, after = kept["line_dedup"]
    lines = sorted({x for r in before for x in r.text.split("\n") if x.strip()})
    codes = {x: line_dedup.line_codes(x) for x in lines}
    root = classes([p for p in itertools.combinations(lines, 2) if line_dedup.similar_lines(codes[p[0]], codes[p[1]])], lines)
    first = {}
    places = sorted(((r.doc_id is not None, r.doc_id or 0, n), x) for r in before for n, x in enumerate(r.text.split("\n")) if x.strip())
    for place, x in places:
        first.setdefault(root[x], (place, x))
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
    left = {x for r in after for x in r.text.split("\n") if x.strip()}
    assert left == {x for _, x in first.values()} and all(r.n_chars == len(r.text) for r in after)

    before, after = kept["near_dedup"]
    texts = sorted({r.text for r in before})
    grams = {t: order_minhash.kmer_list(t) for t in texts}
    group = classes([p for p in itertools.combinations(texts, 2) if grams[p[0]] and grams[p[1]] and order_minhash.aligned(grams[p[0]], grams[p[1]]) >= 0.8], texts)
    assert sorted(group[r.text] for r in after) == sorted(set(group.values()))

    before, after = kept["decontamination"]
    truth = window_truth([(i, r.text) for i, r in enumerate(before)], items)
    assert Counter(map(key, after)) == Counter(key(r) for i, r in enumerate(before) if not truth[i][2])
    assert len(after) < len(before)

    before, after = kept["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    load = defaultdict(int)
    for r in after:
        load[r.sequence_id] += r.length
    assert max(load.values()) <= 2048

    assert Counter((r.doc_id, r.length) for r in corpus_pipeline.run(spark, at).collect()) == Counter((r.doc_id, r.length) for r in after)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "12", None, None, None)], [(i, "word " * 30_000 + str(i % 2), None, "s", 1) for i in range(4)]])
def test_small_and_unlabelled_corpora(spark, corpus, tmp_path, rows):
    """No rows, none that stays, and very long texts without any label: of these the first stays, and one of those that lost their only line."""
    at, _ = corpus
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{at}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == ({0, 2} if len(rows) == 4 else set())
