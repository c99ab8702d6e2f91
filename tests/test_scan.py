"""The scan of chunks for a block of questions: terms and fragments of many texts at once, each text cut and folded once."""

import random

import numpy as np
import pytest

from veinwork.operators import retrieve, scan
from veinwork.plans import catalog

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def longest(asked: str, text: str) -> int:
    if len(asked) < scan.PARTS_FROM:
        return len(asked) if len(asked) >= scan.LEAST and asked in text else 0
    return max([n for n in range(scan.LEAST, min(scan.MOST, len(asked)) + 1) if any(asked[i : i + n] in text for i in range(len(asked) - n + 1))], default=0)


@pytest.mark.parametrize("tables", [scan.TABLES, 100])
@pytest.mark.parametrize("bits", [scan.BITS, 0])
def test_same_as_plain_search(monkeypatch, tables, bits):
    monkeypatch.setattr(scan, "TABLES", tables)
    monkeypatch.setattr(scan, "BITS", bits)
    rng = random.Random(3)
    word = lambda low, high: "".join(rng.choice("abc条𠀀") for _ in range(rng.randrange(low, high)))
    compact = [word(0, 30) for _ in range(70)]
    terms = [sorted({word(2, 6) for _ in range(8)} | ({c[3:20]} if len(c) > 4 else set())) for c in compact]
    asked = scan.Asked([*range(70)], terms, [t[:3] for t in terms], compact, [""] * 70)
    texts = [word(0, 200) + "z\x00" + word(0, 9) for _ in range(40)] + ["", compact[5]]
    skip = np.array([rng.randrange(len(t) + 1) for t in texts])
    (behind, before), parts = asked.read(texts, skip, asked.trie)
    for i, (t, n) in enumerate(zip(texts, skip.tolist())):
        assert (behind[i] | before[i]).tolist() == [w in t for w in asked.all]
        assert behind[i].tolist() == [w in t[n:] for w in asked.all]
        assert parts[i].tolist() == [longest(c, t[n:]) for c in compact]
    asked.weigh({0: 3, 4: 1}, 9)
    weight = dict(zip(asked.all, asked.idf))
    share = asked.coverage(asked.terms, behind | before)
    want = [[sum(weight[w] for w in ts if w in t) / max(1e-9, sum(weight[w] for w in ts)) for ts in terms] for t in texts]
    assert np.allclose(share, want)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(5)
    words = ["".join(rng.choice("klmnop") for _ in range(rng.randrange(2, 6))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.choice([0, 5, 60, 400])) or None, "en", f"src{i % 4}", 0) for i in range(60)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, text(9)) for i in range(12)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, [rng.random() for _ in range(4)], 0) for i in range(40)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


def reads(df) -> int:
    """How often the plan reads the documents."""
    return df._jdf.queryExecution().executedPlan().toString().count("documents.parquet")


def test_lexical_topk_reads_written_chunks(spark, tables):
    got = catalog.queries()["lexical_topk"](spark, tables)
    assert reads(got) == 0 and got.count() == 12 * 24


#: How often each query's result reads the documents once its candidates are written: before, they were cut and scored again for each use.
READS = {
    "dedupe_best": 0,
    "docno_first_whole": 0,
    "compat_evidence": 0,
    "evidence_leads": 0,
    "evidence_prompt": 0,
    "hybrid_topk": 0,
    "hybrid_topk_whole": 0,
    "merge_max": 1,
    "method_topk": 0,
    "select_evidence": 0,
    "compat_ask": 0,
    "docno_first": 0,
    "source_links": 0,
    "tune_scores": 0,
    "evidence_prompt_whole": 0,
    "evidence_leads_whole": 0,
    "dedupe_best_whole": 0,
    "fallback_answer_whole": 0,
    "select_evidence_whole": 0,
}


@pytest.mark.parametrize("name", READS)
def test_documents_are_cut_once(spark, tables, name):
    assert reads(catalog.queries()[name](spark, tables)) <= READS[name]


def test_exact_match_counts_no_terms(spark, tables, monkeypatch):
    monkeypatch.setattr(retrieve, "_frequencies", None)  # its score has no weights
    assert catalog.queries()["exact_match"](spark, tables).count() == 12 * 10


def test_merge_max_whole_takes_every_document_s_vector(spark, tables):
    got = catalog.queries()["merge_max_whole"](spark, tables)
    assert reads(got) == 1 and got.count() == 12 * 30
